"""Rules, pieces, frames, votes, mixes, shards and tool calls, on edges and against plain versions."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from pagemill.llm import bytewords as bw
from pagemill.llm import extendible_shards, neighbour_vote, piece_transducer, risk_rules, soft_mixing, token_frames, tool_chat
from pagemill.llm.common import Scratch, table
from pagemill.llm.queries import tokenizer_path
from pagemill.llm.segments import SegmentCache
from tests.llm.conftest import DOCUMENTS, SMALL, WORD

TINY = "/root/testdata/sf0.001"
ODD = ["a", "b", " ", "  ", "\n", "\t", "é", "\xa0", " ", "日", "'s", "9", ".", "!", "the", "\r", "\x0b", "\x1c", "\x85", "👍", "▁", "ing", " th"]


def odd_texts(n):
    rng = random.Random(11)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 50))) for _ in range(n)]


# --- words


@pytest.mark.parametrize("size", [3, 40, 1 << 20])
def test_words_of_chunks(size):
    texts = [*odd_texts(300), None, "", "end"]
    got = []
    for c in bw.chunks(pa.array(texts).slice(5), max_bytes=size):
        h = c.word_hashes()
        for i in range(len(c)):
            a, b = c.span(i)
            got.append(([c.data[s:e].tobytes().decode() for s, e in zip(c.starts[a:b], c.ends[a:b], strict=True)], h[a:b].tolist()))
    assert [w for w, _ in got] == [WORD.findall(t or "") for t in texts[5:]]
    by_hash = {}
    for words, hashes in got:
        for w, h in zip(words, hashes, strict=True):
            assert by_hash.setdefault(h, w) == w
    assert len(by_hash) == len(set(by_hash.values()))


def test_blocks_of_a_long_text_hash_alike(monkeypatch):
    text = pa.array([" ".join(odd_texts(400))])
    (whole,) = [c.word_hashes() for c in bw.chunks(text, max_bytes=10)]
    monkeypatch.setattr(bw, "CHUNK_BYTES", 37)
    assert (next(iter(bw.chunks(text))).word_hashes() == whole).all()


def test_segment_cache_forgets_and_stays_right():
    cache = SegmentCache(lambda found: [[len(s), *s.encode()] for s in found], most_bytes=50 * SegmentCache.EACH)
    rng = random.Random(2)
    for _ in range(40):
        words = [f"{rng.randrange(10 if rng.random() < 0.5 else 5000)}" for _ in range(30)]
        data = np.frombuffer("".join(words).encode(), np.uint8)
        starts = np.cumsum([0, *map(len, words)])[:-1]
        bounds, ids = cache.encode_all(data, starts, np.array([0, int(starts[10]), len(data)]))
        assert ids.tolist() == [x for w in words for x in (len(w), *w.encode())]
        assert bounds[1] == sum(len(w) + 1 for w in words[:10])


def test_a_large_segment_cache_forgets():
    """More segments than the arrays first have room for."""
    cache = SegmentCache(lambda found: [[len(s)] for s in found], most_bytes=200_000 * SegmentCache.EACH)
    for turn in range(4):
        words = [f"{k}" for k in range(turn * 90_000, turn * 90_000 + 100_000)] * 2
        data = np.frombuffer("".join(words).encode(), np.uint8)
        starts = np.cumsum([0, *map(len, words)])[:-1]
        for _ in range(3):
            _, ids = cache.encode_all(data, starts, np.array([0, len(data)]))
            assert ids.tolist() == [len(w) for w in words]


# --- 1: rules


def counts_of(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_counts_on_edges(edges, edge_rows, labels):
    judged = risk_rules.quality_rules(edges, labels).collect()
    assert Counter((r.doc_id, *(r[c] for c in risk_rules.COUNTS)) for r in judged) == Counter((i, *counts_of(t)) for i, t, *_ in edge_rows)
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) for r in judged)
    assert all(r.kept == (not r.base_failed) for r in judged)  # too few labels for any cutoff


def test_rules_on_nothing(spark, nothing, edges, labels):
    assert risk_rules.quality_rules(nothing, labels).collect() == []
    assert risk_rules.quality_rules(edges, labels.limit(0)).count() == 21


def test_binomial_tail(spark):
    rng = random.Random(5)
    cases = [(n := rng.randint(1, 10 ** rng.randint(1, 6)), rng.randint(0, max(1, n // 100))) for _ in range(120)]
    got = spark.createDataFrame(cases, "n long, k long").withColumn("p", risk_rules.binomial_tail(F.col("n"), F.col("k"), 0.01)).collect()
    log = math.lgamma
    for n, k, p in got:
        if k < 0.01 * n:
            want = math.fsum(
                math.exp(log(n + 1) - log(j + 1) - log(n - j + 1) + j * math.log(0.01) + (n - j) * math.log(0.99)) for j in range(k + 1)
            )
            assert p == pytest.approx(want, rel=1e-6, abs=1e-200)
        else:
            assert p == 1


def test_certified_cutoffs_hold_the_risk(spark):
    """Symbols tell bad from good in one stratum; the other has too few labels."""
    rng, rows = random.Random(6), []
    for i in range(6000):
        good = i % 2 == 0
        symbols = rng.randrange(8) if good else rng.randrange(20, 200)
        rows.append((i, "en" if i < 5900 else None, good, 100, 500, symbols, 0, 0))
    held = spark.createDataFrame(rows, "doc_id long, stratum string, good boolean, " + ", ".join(f"{c} long" for c in risk_rules.COUNTS))
    found = {r.stratum: r for r in risk_rules.cutoffs(held, risk_rules.Risk()).collect()}
    assert found["en"].symbols in (10, 20)  # percent of words
    assert found["en"].dup_lines is None and found[None].symbols is None


# --- 2: pieces


@pytest.fixture(scope="module")
def vocabulary():
    return piece_transducer.read_vocabulary(tokenizer_path("piece_bpe_32k.model"))


def test_scored_pieces_take_the_least_weight():
    """A vocabulary with real scores against the least of all ways to cut a text."""
    rng = random.Random(12)
    alphabet = "ab" + piece_transducer.SPACE
    pieces = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 5))) for _ in range(60)} - {""})
    pieces = [p for p in pieces if piece_transducer.SPACE not in p.lstrip(piece_transducer.SPACE) and p != "b"]
    names = [f"<0x{b:02X}>" for b in range(256)] + pieces
    scores = [0.0] * 256 + [-round(rng.uniform(0.5, 9), 3) for _ in pieces]
    kinds = [piece_transducer.BYTE] * 256 + [piece_transducer.NORMAL] * len(pieces)
    machine = piece_transducer.Transducer(piece_transducer.Vocabulary(names, scores, kinds, merges=False))
    outside = piece_transducer.OUTSIDE - min(scores[256:])

    def least(text):
        best = [0.0] + [math.inf] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(j):
                if text[i:j] in pieces:
                    best[j] = min(best[j], best[i] - scores[names.index(text[i:j])])
            if text[j - 1] not in pieces:
                best[j] = min(best[j], best[j - 1] + outside)
        return best[-1]

    for _ in range(300):
        text = "".join(rng.choice("ab bé") for _ in range(rng.randrange(0, 12)))
        read = machine.normalise(text)
        ids = machine.shortest_path(text)
        weight, k = 0.0, 0
        while k < len(ids):  # the bytes of one character weigh ``outside``
            if ids[k] >= 256:
                weight, k = weight - scores[ids[k]], k + 1
            else:
                size = 1 if ids[k] < 0x80 else 2 if ids[k] < 0xE0 else 3
                weight, k = weight + outside, k + size
        assert weight == pytest.approx(least(read)), text
        assert machine.decode(ids) == (text[1:] if text.startswith(" ") else text)


def test_lattice_is_of_all_machines():
    names = [f"<0x{b:02X}>" for b in range(256)] + ["a", "ab", piece_transducer.SPACE]
    kinds = [piece_transducer.BYTE] * 256 + [piece_transducer.NORMAL] * 3
    machine = piece_transducer.Transducer(piece_transducer.Vocabulary(names, [0.0] * 256 + [-1.0, -3.0, -2.0], kinds, merges=False))
    lattice = machine.compose(" abé")
    assert [[(end, piece) for end, piece, _, _ in arcs] for arcs in lattice] == [[(1, 258)], [(2, 256), (3, 257)], [(3, -1)], [(4, -1)]]
    assert lattice[3][0][2] == tuple("é".encode()) and lattice[3][0][3] == 13.0
    assert machine.relax(lattice) == [258, 257, 0xC3, 0xA9]


def test_pieces_equal_the_library(vocabulary):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    texts = [*odd_texts(3000), "aaaaaaaaaaaaaaaa", " ", "  a  b", "▁▁ ▁", "\x00", "é́"]
    machine, got = piece_transducer.Transducer(vocabulary), []
    for c in bw.chunks(pa.array(texts), max_bytes=5000):
        bounds, ids, _, _ = machine.encode_chunk(c)
        got += [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(len(c))]
    assert got == model.encode(texts)
    for t, ids in zip(texts, got, strict=True):
        assert machine.decode(ids) == model.decode(ids) == t.replace("▁", " ")


def test_pieces_of_tables(spark, edges, edge_rows, nothing, vocabulary):
    out = piece_transducer.encode(edges, vocabulary)
    assert out.columns[: len(edges.columns)] == edges.columns
    back = piece_transducer.decode(out, vocabulary).collect()
    assert Counter((r.doc_id, r.decoded) for r in back) == Counter((i, t or "") for i, t, *_ in edge_rows)
    assert all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in back)
    assert piece_transducer.encode(nothing, vocabulary).collect() == []


# --- 4: tool calls

TOOL = {"f": tool_chat.Tool({"n": "integer", "b": "string"}, ("n",))}
MESSAGES = "conv_id string, turn int, role string, text string"


def call(*calls):
    return json.dumps({"tool_calls": list(calls)})


def test_tool_calls(spark):
    rows = [
        ("a", 0, "user", "hi"),
        ("a", 1, "assistant", call({"id": "x", "name": "f", "arguments": {"n": 1, "b": "q"}, "after": ["y"]})),
        ("a", 2, "assistant", call({"id": "y", "name": "f", "arguments": '{"n": 2}', "after": ["z"]})),
        ("a", 3, "assistant", call({"id": "z", "name": "f", "arguments": {"n": "bad"}}, {"id": "w", "name": "g", "arguments": {}, "after": ["nope"]})),
        ("a", 4, "tool", json.dumps({"tool_call_id": "x", "content": {"b": 1, "a": [True, None]}})),
        ("a", 5, "tool", json.dumps({"tool_call_id": "x", "content": "again"})),
        ("a", 6, "tool", json.dumps({"tool_call_id": "ghost", "content": "s"})),
        ("a", 7, "assistant", call({"id": "p", "name": "f", "arguments": {"n": 1}, "after": ["q"]})),
        ("a", 8, "assistant", call({"id": "q", "name": "f", "arguments": {"n": 1}, "after": ["p"]})),
        ("a", 9, "assistant", call({"id": "r", "name": "f", "arguments": {"n": 1}, "after": ["q"]})),
        ("a", 10, "tool", "no json"), ("a", 11, "assistant", None), ("a", 12, "assistant", call({"name": "f"})), ("a", 13, "assistant", ""),
        (None, 0, "assistant", call({"id": "x", "name": "f", "arguments": {"n": 1, "zz": 2}})),
        (None, None, "tool", json.dumps({"tool_call_id": "x", "content": 1})), (None, None, None, None),
    ]
    out = tool_chat.format_chat(spark.createDataFrame(rows + rows[:4], MESSAGES), TOOL)
    got = {(r.conv_id, r.call_id): r for r in out.collect() if r.call_id}
    status = {k: r.status for k, r in got.items()}
    assert status == {
        ("a", "x"): "linked", ("a", "y"): "no result", ("a", "z"): "invalid", ("a", "w"): "invalid", ("a", "ghost"): "no call",
        ("a", "p"): "circle", ("a", "q"): "circle", ("a", "r"): "circle", (None, "x"): "invalid",
    }
    assert got["a", "x"].json == '{"after":["y"],"arguments":{"b":"q","n":1},"id":"x","name":"f","result":{"a":[true,null],"b":1}}'
    assert got["a", "x"].n_results == 2 and got[None, "x"].errors == "unexpected parameter" and got["a", "z"].errors == "n is no integer"
    key = lambda r: (r.order_turn, r.order_hops, r.turn, r.idx)
    assert key(got["a", "z"]) < key(got["a", "y"]) < key(got["a", "x"])
    assert out.where("kind = 'message'").count() == 6


def test_no_text_of_a_tool_message_is_lost(spark):
    f = {"id": "x", "name": "f", "arguments": {"n": 1}}
    rows = [
        ("a", 1, "assistant", json.dumps({"content": "I look it up", "refusal": None, "tool_calls": [f | {"type": "function"}, {"name": "g", "note": "n"}]})),
        ("a", 2, "tool", json.dumps({"tool_call_id": "x", "content": "first", "is_error": True})),
        ("a", 2, "tool", json.dumps({"tool_call_id": "x", "content": "second"})),
        ("a", 2, "tool", json.dumps({"tool_call_id": "x", "content": "second"})),
        ("a", 3, "assistant", call(f | {"arguments": {"n": "2"}})),
        (None, 4, "assistant", call(f, f | {"arguments": {"n": 3}})),
        ("b", 0, "assistant", json.dumps({"content": None, "tool_calls": [f]})),
    ]
    out = tool_chat.format_chat(spark.createDataFrame(rows, MESSAGES), TOOL).collect()
    texts = sorted(json.loads(r.json)["text"] for r in out if r.kind == "message")
    assert texts == [
        '{"content":"I look it up","tool_calls":[{"id":"x","type":"function"}]}', '{"is_error":true}', '{"name":"g","note":"n"}',
    ]
    again = sorted(((r.conv_id or "", r.kind, r.turn, r.idx, r.json, r.errors) for r in out if r.status == "repeated identifier"))
    assert again == [
        ("", "call", 4, 1, '{"after":[],"arguments":{"n":3},"id":"x","name":"f","result":null}', ""),
        ("a", "call", 3, 0, '{"after":[],"arguments":{"n":"2"},"id":"x","name":"f","result":null}', "n is no integer"),
        ("a", "result", 2, 0, '{"id":"x","result":"second"}', ""),
    ]
    assert len(out) == 9 and sum(r.status in ("linked", "no result") for r in out) == 3


def test_tool_order_of_random_graphs(spark):
    rng, rows, after = random.Random(3), [], {}
    for c in range(6):
        names = [f"{c}-{k}" for k in range(25)]
        for turn, name in enumerate(rng.sample(names, len(names))):
            k = int(name.split("-")[1])
            after[name] = rng.sample(names[:k], min(k, rng.randrange(3)))
            rows.append((str(c), turn, "assistant", call({"id": name, "name": "f", "arguments": {"n": 1}, "after": after[name]})))
    got = {r.call_id: r for r in tool_chat.format_chat(spark.createDataFrame(rows, MESSAGES), TOOL).collect()}
    place = {i: (r.order_turn, r.order_hops, r.turn, r.idx) for i, r in got.items()}
    assert all(place[d] < place[i] for i, deps in after.items() for d in deps)
    assert not any(r.status == "circle" for r in got.values())


def test_tool_calls_of_nothing(spark):
    assert tool_chat.format_chat(spark.createDataFrame([], MESSAGES), TOOL).collect() == []


# --- 6: votes


def test_votes(spark):
    documents, known = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    scored = neighbour_vote.score(documents, neighbour_vote.fit(documents, known), keep=["doc_id"])
    held = scored.join(known, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).collect()
    assert len(held) > 100
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95


def test_votes_on_edges(spark, edges, nothing, labels):
    documents, known = table(spark, TINY, "documents"), table(spark, TINY, "labels")
    model = neighbour_vote.fit(documents, known)
    out = neighbour_vote.score(edges, model)
    assert set(out.columns) == {*edges.columns, "score", "predicted"}
    rows = out.collect()
    assert len(rows) == 21 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    blank = {r.score for r in rows if not (r.text or "").split()}
    assert len(blank) == 1
    assert neighbour_vote.score(nothing, model).collect() == []
    for few in (labels.limit(0), labels.where("quality = 1"), labels):
        assert neighbour_vote.score(edges, neighbour_vote.fit(edges, few)).count() == 21
    assert neighbour_vote.score(edges, neighbour_vote.fit(nothing, labels)).count() == 21


def test_votes_do_not_see_held_out_labels(spark):
    documents, known = table(spark, TINY, "documents"), table(spark, TINY, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    turned = known.withColumn("quality", F.when(held_out, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (neighbour_vote.fit(documents, x) for x in (known, turned))
    assert (a.vectors == b.vectors).all() and (a.labels == b.labels).all() and a.prior == b.prior


def test_votes_by_force():
    """All cosines, weights and ties, row by row, against the blocked products."""
    rng = np.random.default_rng(8)
    x = np.abs(rng.normal(size=(60, neighbour_vote.FEATURES))).astype(np.float32)
    x[40:50] = x[30:40]  # equal sample rows with other labels: ties
    x[55] = 0
    labels = (np.arange(60) % 3 == 0).astype(np.float64)
    settings = neighbour_vote.Settings(rank=6, neighbours=7)
    model = neighbour_vote.fit_arrays(x, labels, {0: 40, 1: 20}, settings)
    asked = np.concatenate([x[25:58], np.zeros((1, x.shape[1]), np.float32)] * 20)  # over two blocks
    got = neighbour_vote.votes(model, asked)
    assert len(asked) > 2 * neighbour_vote.BLOCK
    for row, score in zip(asked, got, strict=True):
        if not row.any():
            assert score == model.prior
            continue
        v = (row * model.scale) @ model.basis
        cosines = [max(0.0, float(v @ y / np.linalg.norm(v))) for y in model.vectors]
        best = sorted(range(60), key=lambda j: (-round(cosines[j], 5), j))[:7]
        weight = [cosines[j] ** settings.sharpness for j in best]
        want = sum(w * labels[j] for w, j in zip(weight, best, strict=True)) / sum(weight)
        assert abs(score - want) < 1e-3


def test_ties_go_to_the_earlier_row():
    near = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [0.2, 0.2, 0.2, 0.2, 0.2]], np.float32)
    assert [sorted(r) for r in neighbour_vote._nearest(near, 3).tolist()] == [[0, 1, 2], [0, 1, 2]]


# --- 7: frames


def test_frames(spark, edges, edge_rows, nothing):
    from tokenizers import Tokenizer

    definition = open(tokenizer_path("byte_bpe_50k.json")).read()
    tokenizer = Tokenizer.from_str(definition)
    tokenizer.encode_special_tokens = True
    ids = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    path = Scratch(spark).path("tokens")
    form = token_frames.Format(frame_tokens=400, file_bytes=60_000)
    token_frames.write(edges, definition, path, form)
    got = sorted(token_frames.read_digests(spark, path).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == Counter((i, zlib.crc32(np.array(ids(t), "<u4").tobytes())) for i, t, *_ in edge_rows)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    order = [r.doc_id for r in got]
    assert order == [None, None, *sorted(x for x in order if x is not None)]
    some = token_frames.read(spark, path, [9, 13]).collect()
    assert sorted((r.doc_id, r.ids) for r in some) == sorted((i, ids(t)) for i, t, *_ in edge_rows if i in (9, 13))
    token_frames.write(nothing, definition, path, form)
    assert token_frames.read_digests(spark, path).collect() == []


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    definition = open(tokenizer_path("byte_bpe_50k.json")).read()
    own, tokenizer, texts, got = token_frames.Encoder(definition), Tokenizer.from_str(definition), odd_texts(4000), []
    for c in bw.chunks(pa.array(texts), max_bytes=4000):
        bounds, ids = own.encode_chunk(c)
        got += [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(len(c))]
    assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_added_tokens_equal_the_library():
    from tokenizers import Tokenizer

    path, rng, mark = tokenizer_path("byte_bpe_50k.json"), random.Random(12), "<|endoftext|>"
    parts = [*ODD, mark, mark, mark, mark, "<|", "|>", "<|endoftext|", "endoftext"]
    texts = ["a <|endoftext|> b", "a  " + mark, mark, "b" + mark + mark + "'s", "<|endo", "ftext|>", "", f"a\n{mark}\nb", f" {mark} "]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(4000)]
    tokenizer = Tokenizer.from_file(path)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    for size in (300, 4000, 1 << 20):
        own, got = token_frames.Encoder(open(path).read()), []
        for c in bw.chunks(pa.array(texts), max_bytes=size):
            bounds, ids = own.encode_chunk(c)
            got += [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(len(c))]
        assert got == want


def test_reader_decompresses_only_what_is_asked():
    import io

    import zstandard

    out, docs = token_frames.FrameWriter(token_frames.Format(frame_tokens=100)), [np.arange(k + 1) * 7 for k in range(60)]
    parts = [p for k, ids in enumerate(docs) for p in out.add(k, ids)] + list(out.close())
    raw = b"".join(p + token_frames.GAP.encode() for p in parts)
    reader = token_frames.FrameReader(io.BytesIO(raw))
    assert [ids.tolist() for _, _, ids in reader.read([3, 50])] == [docs[3].tolist(), docs[50].tolist()]
    assert reader.decompressed == 2 < len(reader.frames)
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert np.frombuffer(whole, "<u4").tolist() == np.concatenate(docs).tolist()
    at = int(reader.frames[1]["at"]) + 20
    broken = raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_frames.FrameReader(io.BytesIO(broken)).frame(1)


# --- 8: mixes


def test_mix_reaches_targets(spark):
    documents, known = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    domains = documents.select("doc_id", F.col("lang").alias("domain")).join(known.select("doc_id"), "doc_id", "left_semi")
    weights = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}
    mixed, model = soft_mixing.mix(documents, domains, weights)
    rows = mixed.select("doc_id", "lang", "_n", "_p", "_rate", "_copies").collect()
    total = sum(r._n for r in rows)
    for i, d in enumerate(model.domains):
        assert sum(r._n * r._p[i] * r._rate for r in rows) == pytest.approx(weights[d] * total, rel=1e-3)
    assert model.residual == pytest.approx([0] * len(model.domains), abs=1e-3 * total)
    assert all(r._rate >= 0 and abs(r._copies - r._rate) <= 1 for r in rows)
    assert all(sum(r._p) == pytest.approx(1) for r in rows)
    good = {r.doc_id for r in known.where("quality = 1").collect()}  # the others are junk of no language
    judged = [model.domains[int(np.argmax(r._p))] == r.lang for r in rows if r._n > 20 and r.doc_id in good]
    assert sum(judged) / len(judged) > 0.95


def test_domains_of_unlabelled_documents(spark):
    documents, known = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    domains = documents.join(known, "doc_id", "left_semi").select("doc_id", F.col("lang").alias("domain"))
    model = soft_mixing.fit(documents, domains, ["en", "de", "fr", "es"])
    rest = documents.join(known, "doc_id", "left_anti").select("doc_id", "lang", "text")
    rows = soft_mixing.with_posteriors(rest, model).where("lang is not null and _n > 0").collect()
    assert len(rows) > 500 and np.mean([model.domains[int(np.argmax(r._p))] == r.lang for r in rows]) >= 0.99
    for r in rows[::7]:  # by force
        words = {w for w in regex.split(r"[^\p{L}\p{N}]+", r.text.lower()) if w}
        hashed = {xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words}
        hashed = {(h - (1 << 64) if h >> 63 else h) % 4096 for h in hashed}
        logits = [p + sum(w[b] for b in hashed) / model.temperature for p, w in zip(model.prior, model.weights, strict=True)]
        odds = np.exp(np.array(logits) - max(logits))
        assert r._p == pytest.approx(list(odds / odds.sum()), abs=1e-9)


def test_every_domain_is_drawn(spark):
    known = spark.createDataFrame([(i, "common" if i % 500 else "rare") for i in range(5000)], "doc_id long, domain string")
    drawn = Counter(r.domain for r in soft_mixing.draw(known, ["common", "rare"], 100).collect())
    assert drawn == {"common": 50, "rare": 10}


def test_rates_that_do_not_settle_say_so(spark):
    rows = spark.createDataFrame([(100, [0.5, 0.5]), (100, [0.4, 0.6])], "_n long, _p array<double>")
    with pytest.warns(UserWarning, match="not settled"):
        assert len(soft_mixing.fit_rates(rows, [150.0, 50.0], soft_mixing.Settings(max_steps=2))) == 2


def test_rates_are_the_least_squares_fit(spark):
    """Rates of soft rows against a plain projected gradient in numpy, with a target out of reach."""
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.5, 0.5, 0.5], 200)
    n = rng.integers(1, 500, 200)
    rows = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "_n long, _p array<double>")
    targets = [float(n.sum()), 0.0, float(n.sum()) / 2]
    steps = soft_mixing.fit_rates(rows, targets, soft_mixing.Settings(max_steps=150))
    got = np.array([r[0] for r in rows.select(soft_mixing.rate(steps)).collect()])
    rates, h = np.ones(200), (n[:, None] * p * p).sum(0)
    m = (n[:, None, None] * p[:, :, None] * p[:, None, :]).sum(0)
    reach = (m / np.sqrt(np.outer(h, h))).sum(1).max()
    for _ in range(len(steps)):
        rates = np.maximum(0, rates - p @ (((n * rates) @ p - targets) / h / max(reach, 1)))
    assert got == pytest.approx(rates, abs=1e-9)
    error = lambda r: ((((n * r) @ p - targets) ** 2) / h).sum()
    assert error(got) < 0.2 * error(np.ones(200))


def test_mix_on_edges(spark, edges, nothing, labels):
    domains = spark.createDataFrame([(6, "en"), (9, "en"), (10, "de"), (None, "en"), (11, None), (14, "xx")], "doc_id long, domain string")
    mixed, _ = soft_mixing.mix(edges, domains, {"en": 1.0, "de": 1.0}, keep_all=True)
    rows = mixed.collect()
    assert len(rows) == 21 and all(r._copies >= 1 for r in rows)
    assert soft_mixing.mix(nothing, domains, {"en": 1.0})[0].collect() == []
    assert soft_mixing.mix(edges, domains.limit(0), {"en": 1.0, "de": 1.0})[0].count() == 21


# --- 10: shards


def by_force(rows, limit):
    bits = {i: bin(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16))[2:].zfill(60) for i, _ in rows}
    out = {}

    def split(part, depth):
        size = sum(x for _, x in part)
        if size <= limit or len(part) == 1:
            out.update({i: (bits[i][:depth], size) for i, _ in part})
            return
        for bit in "01":
            if half := [r for r in part if bits[r[0]][depth] == bit]:
                split(half, depth + 1)

    split(rows, 0)
    return out


@pytest.mark.parametrize("limit", [5_000, 60_000, 1 << 30])
def test_shards(spark, limit):
    documents = table(spark, TINY, "documents")
    rows = [(r.doc_id, len((r.text or "").encode())) for r in documents.collect()]
    got = extendible_shards.shards(documents, extendible_shards.Limits(limit)).collect()
    assert {r.doc_id: (r.shard, r.shard_bytes) for r in got} == by_force(rows, limit) and len(got) == len(rows)


def test_shards_on_edges(spark, edges, nothing):
    got = extendible_shards.shards(edges, extendible_shards.Limits(2_000)).collect()
    assert len(got) == 21
    size = Counter()
    for r in got:
        size[r.shard] += r.n_bytes
    assert all(r.shard_bytes == size[r.shard] and r.fits == (r.shard_bytes <= 2_000) for r in got)
    assert all(Counter(r.shard for r in got)[r.shard] == 1 for r in got if not r.fits)
    assert extendible_shards.shards(nothing).collect() == []


def test_rows_of_one_id_split(spark):
    same = spark.range(400).select(F.lit(5).alias("doc_id"), F.lit("x" * 100).alias("text"))
    got = extendible_shards.shards(same, extendible_shards.Limits(5_000)).collect()
    assert len(got) == 400 and all(r.fits for r in got)


def test_written_shards(spark):
    documents = table(spark, TINY, "documents")
    path = Scratch(spark).path("shards")
    directory = extendible_shards.write_shards(documents, path, extendible_shards.Limits(100_000)).collect()
    back = spark.read.option("recursiveFileLookup", False).schema(DOCUMENTS + ", shard string").parquet(path)
    assert {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()} == {"b" + r.shard: r.n_rows for r in directory}
    assert back.drop("shard").exceptAll(documents.select(*back.columns[:-1])).isEmpty()
