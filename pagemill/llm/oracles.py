"""DuckDB twins of the queries that SQL can express."""

from pagemill.llm.extendible_shards import BITS, Limits
from pagemill.llm.risk_rules import RULES, Risk
from pagemill.llm.suffix_dedup import Passages

WORD = r"[^\x20\x09-\x0D]+"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_COUNTS = rf"""
d as (select row_number() over () as r, doc_id, lang, coalesce(text, '') as t from documents),
w as (select r, regexp_extract_all(t, '{WORD}') as w from d),
win as (select r, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as x from w),
again as (select r, i from (select r, i, count(*) over (partition by r, x) as c from win) where c > 1),
covered as (select r, count(distinct j) as n from (select r, unnest([i, i + 1, i + 2]) as j from again) group by r),
lines as (select r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as l from d),
counts as (
  select d.r, doc_id, lang, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words
  from d join w using (r) join lines using (r) left join covered using (r)
),
based as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counts)
"""


def quality_rules(risk: Risk = Risk()) -> str:  # noqa: B008
    p = risk.alpha / len(RULES)
    tests = " union all ".join(
        f"select stratum, '{rule}' as rule, {c}.0 as cutoff, count_if(good)::bigint as n, count_if(not good)::bigint as bad, "
        f"count_if(good and {ratio} > {c})::bigint as k, count_if(not good and {ratio} > {c})::bigint as hits from held group by stratum"
        for rule, (ratio, strictness) in RULES.items()
        for c in strictness
    )
    rejected = " or ".join(f"coalesce({ratio} > \"{rule}\", false)" for rule, (ratio, _) in RULES.items())
    chosen = ", ".join(f"any_value(cutoff) filter (rule = '{rule}') as \"{rule}\"" for rule in RULES)
    tail = (
        f"list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) "
        f"+ j * ln({p}) + (n - j) * ln(1 - {p}))))"
    )
    return f"""
with {_COUNTS},
known as (select doc_id, min(quality) = 1 as good from labels where quality is not null and doc_id is not null group by doc_id),
held as (
  select doc_id, bool_and(good) as good, min(lang) as stratum, min(n_words) as n_words, min(word_chars) as word_chars,
    min(n_symbols) as n_symbols, min(n_dup_lines) as n_dup_lines, min(n_repeat_words) as n_repeat_words
  from based join known using (doc_id) where not base_failed group by doc_id
),
tests as ({tests}),
strata as (select count(distinct coalesce('s' || stratum, 'n')) as m from held where good),
gains as (
  select stratum, rule, cutoff, hits / bad - {risk.cost} * (k / n) as gain from tests, strata
  where n > 0 and bad > 0 and k < n * {p} and {tail} <= {risk.delta} / (m * {len(RULES)})
),
best as (
  select stratum, rule, cutoff from gains where gain > 0
  qualify row_number() over (partition by stratum, rule order by gain desc, cutoff desc) = 1
),
limits as (select stratum, {chosen} from best group by stratum)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({rejected}) as kept
from based left join limits on lang is not distinct from stratum
"""


def repeated_passages(rule: Passages = Passages()) -> str:  # noqa: B008
    n = rule.min_words
    islands = lambda source: f"""
  select doc_id, sum(e - s) as n, string_agg(s || '-' || e, ',' order by s) as spans from (
    select doc_id, g, min(lo) as s, max(lo) + {n} as e from (
      select doc_id, lo, sum(fresh) over (partition by doc_id order by lo) as g from (
        select doc_id, lo, case when lo > lag(lo) over (partition by doc_id order by lo) + {n} then 1 else 0 end as fresh from ({source})
      )
    ) group by doc_id, g
  ) group by doc_id"""  # noqa: E731
    return rf"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
windows as (
  select doc_id, unnest(range(0, len(w) - {n - 1})) as lo,
    unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) as x from w
),
placed as (select doc_id, lo, count(*) over (partition by x) as c, row_number() over (partition by x order by doc_id, lo) as k from windows),
repeated as ({islands("select doc_id, lo from placed where c > 1")}),
later as ({islands("select doc_id, lo from placed where k > 1")})
select doc_id, coalesce(r.n, 0)::int as n_repeated_words, coalesce(l.n, 0)::int as n_cut_words,
  coalesce(r.spans, '') as repeated_spans, coalesce(l.spans, '') as cut_spans
from documents left join repeated r using (doc_id) left join later l using (doc_id)
"""


CHAT = """
with calls as (
  select conv_id, turn, min(case when text is null then '{}' else to_json({chars: length(text), text: text})::varchar end) as arguments,
    count(distinct coalesce('t' || text, 'n')) as n_calls from conversations where role = 'user' group by all
),
results as (
  select conv_id, turn - 1 as turn, min(to_json(text)::varchar) as content, count(distinct coalesce('t' || text, 'n')) as n_results
  from conversations where role = 'assistant' group by all
),
linked as (
  select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.turn, r.turn) as t, c.turn is not null as is_call,
    r.turn + 1 as result_turn, arguments, content, coalesce(n_calls, 0) as n_calls, coalesce(n_results, 0) as n_results,
    c.turn >= 2 and not exists (from calls p where p.conv_id = c.conv_id and p.turn = c.turn - 2) as dangling
  from calls c full join results r on c.conv_id = r.conv_id and c.turn = r.turn
)
select conv_id::varchar as conv_id, case when is_call then t else result_turn end as order_turn, 0::int as order_hops,
  case when is_call then t else result_turn end as turn, 0::int as idx, case when is_call then 'call' else 'result' end as kind,
  conv_id || '-' || t as call_id, result_turn, n_calls::int as n_calls, n_results::int as n_results,
  case when not is_call then 'no call' when arguments = '{}' then 'invalid' when dangling then 'missing dependency'
    when n_results = 0 then 'no result' else 'linked' end as status,
  case when is_call and arguments = '{}' then 'missing text' else '' end as errors,
  case when is_call then '{"after":[' || case when t >= 2 then '"' || conv_id || '-' || (t - 2) || '"' else '' end || '],"arguments":' || arguments
    || ',"id":"' || conv_id || '-' || t || '","name":"answer","result":' || coalesce(content, 'null') || '}'
    else '{"id":"' || conv_id || '-' || t || '","result":' || coalesce(content, 'null') || '}' end as json
from linked
union all
select conv_id::varchar, turn, 0::int, turn, 0::int, 'message', null, null, 0::int, 0::int, 'plain', '',
  '{"role":' || coalesce(to_json(role)::varchar, 'null') || ',"text":' || coalesce(to_json(text)::varchar, 'null') || '}'
from (select distinct conv_id, turn, role, text from conversations) where role is null or role not in ('user', 'assistant')
"""

JACCARD = rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '{WORD}') as w from documents
),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as x from w
),
n as (select doc_id, count(*) as n from s group by doc_id),
links as (
  select a, b from (select p.doc_id as a, q.doc_id as b, count(*) as c from s p join s q on p.x = q.x and p.doc_id <> q.doc_id group by all)
  join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)
),
reach(a, b) as (select doc_id, doc_id from n union select r.a, l.b from reach r join links l on r.b = l.a),
least as (select a as doc_id, min(b) as c from reach group by a)
select doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(c, doc_id) as component_id
from documents left join n using (doc_id) left join least using (doc_id)
"""

EMBEDDINGS = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.93
),
reach(a, b) as (select vec_id, vec_id from v union select r.a, l.b from reach r join links l on r.b = l.a),
least as (select a as vec_id, min(b) as c from reach group by a),
degree as (select a as vec_id, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(c, vec_id) as component_id, coalesce(c, vec_id) = vec_id as kept
from embeddings left join least using (vec_id) left join degree using (vec_id)
"""


def shards(limits: Limits = Limits()) -> str:  # noqa: B008
    large = f"(bytes > {limits.shard_bytes} and n > 1)"
    return f"""
with recursive d as (
  select doc_id, strlen(coalesce(text, '')) as n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, {BITS // 4}))::bigint as h from documents
),
b(depth, p, bytes, n) as (
  select 0, 0::bigint, sum(n_bytes)::bigint, count(*) from d having count(*) > 0
  union all
  select depth + 1, h >> ({BITS - 1} - depth), sum(n_bytes)::bigint, count(*)
  from b join d on (h >> ({BITS} - depth)) = p where {large} and depth < {BITS} group by all
)
select doc_id, n_bytes::bigint as n_bytes, case when depth = 0 then '' else lpad(bin(p), depth, '0') end as shard,
  depth::int as depth, bytes as shard_bytes, bytes <= {limits.shard_bytes} as fits
from b join d on (h >> ({BITS} - depth)) = p where not {large}
"""


SEARCH = """
with v as (
  select row_number() over () as k, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
  select q.k, q.vec_id as query_id, v.vec_id, list_inner_product(q.e, v.e)::bigint as score
  from v q join v on q.k <> v.k where q.vec_id % 50 = 0
)
select query_id, row_number() over (partition by k order by score desc, vec_id nulls last)::int as rank, vec_id, score
from s qualify rank <= 5
"""

_GRAMS = [f"x{k}" for k in range(1, 6)]
PHRASES = rf"""
with d as (select row_number() over () as r, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}') as t from documents),
p as (select r, lang, regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]') as ps from d),
q as (select r, lang, unnest(range(len(ps))) as piece, unnest(ps) as t from p),
u as (select r, lang, piece, regexp_extract_all(t, '[^\x20\x09]+') as w from q),
w as (select r, lang, piece, unnest(range(len(w))) as i, unnest(w) as x1 from u),
g1 as (select lang, x1, lead(x1, 1) over k as y2, lead(x1, 2) over k as y3, lead(x1, 3) over k as y4, lead(x1, 4) over k as y5
  from w window k as (partition by r, piece order by i)),
g as (select lang, x1, x1 || ' ' || y2 as x2, x1 || ' ' || y2 || ' ' || y3 as x3, x1 || ' ' || y2 || ' ' || y3 || ' ' || y4 as x4,
  x1 || ' ' || y2 || ' ' || y3 || ' ' || y4 || ' ' || y5 as x5 from g1),
f as ({" union all ".join(f"select lang, {k + 1} as size, {x} as phrase, count(*) as f from g where {x} is not null group by all" for k, x in enumerate(_GRAMS))}),
n as (select lang, sum(f)::bigint as n from f where size = 1 group by lang),
c as (select lang, size, phrase, string_split(phrase, ' ') as w, f as a from f where size > 1 and f >= 100),
k as (select lang, size as words, phrase, w, a, unnest(range(1, size)) as cut from c),
s as (
  select k.lang, words, k.phrase, k.w, a, cut, l.f as l, r.f as r, n.n, ((1000::hugeint * a * n) // (l.f::hugeint * r.f))::bigint as score
  from k join f l on l.lang = k.lang and l.phrase = array_to_string(w[1:cut], ' ')
    join f r on r.lang = k.lang and r.phrase = array_to_string(w[cut + 1:words], ' ') join n on n.lang = k.lang
),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
o as (select b.* from b where not exists (
  from c where c.lang = b.lang and c.size > b.words and contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') and 100 * c.a >= 100 * b.a))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from o qualify rank <= 2000
"""

#: Unsigned crc32 of a text of ASCII characters.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::bigint)), "
    "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
)
RUNS = rf"""
with d as (
  select row_number() over () as k, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as w, {_CRC.format("doc_id::varchar")} as h from documents
),
e as (select k, doc_id, w, len(w) as n, coalesce(h % 10 = 0 and len(w) > 0, false) as loops, h // 10 as g from d),
x as materialized (
  select k, i, x, hash(x) as h from (
    select k, i, case when loops and i >= g % n then w[g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) + 1] else w[i + 1] end as x
    from (select *, unnest(range(n)) as i from e)
  )
),
-- Of any places q apart, one in a run begins three periods.  Words are compared with xor, so that joins go by place.
lags as (select k, n, unnest(range(1, n // 4 + 1)) as q from e),
looks as (select k, q, unnest(range(0, n - 3 * q + 1, q)) as j from lags),
once as materialized (
  select l.k, q, j, a.h from looks l join x a on a.k = l.k and a.i = j join x b on b.k = l.k and b.i = j + q where xor(a.h, b.h) = 0
),
twice as materialized (select l.k, q, j, l.h from once l join x c on c.k = l.k and c.i = j + 2 * q where xor(l.h, c.h) = 0),
last as materialized (select l.k, q, j, f.h from twice l join x f on f.k = l.k and f.i = j + q - 1),
hits as materialized (select l.k, q, j from last l join x g on g.k = l.k and g.i = j + 2 * q - 1 where xor(l.h, g.h) = 0),
inside as (select k, q, j, unnest(range(j, j + 2 * q)) as i from hits),
near as materialized (select s.k, q, j, s.i, a.h from inside s join x a on a.k = s.k and a.i = s.i),
far as materialized (select s.k, q, j, xor(s.h, b.h) = 0 as same from near s join x b on b.k = s.k and b.i = s.i + q),
sure as materialized (select distinct k, q from (select k, q, j from far group by all having bool_and(same))),
every as materialized (select s.k, q, a.i, a.h from sure s join x a on a.k = s.k),
same as (
  select s.k, q, s.i, s.i - row_number() over (partition by s.k, q order by s.i) as island
  from every s join x b on b.k = s.k and b.i = s.i + q where xor(s.h, b.h) = 0
),
runs as (
  select k, min(i) as start, count(*) + q as length, q as period from same group by k, q, island
  having length >= greatest(6, 4 * q)
  qualify row_number() over (partition by k, min(i), count(*) + q order by q) = 1
),
marks as (select k, count(*) as n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period)) as s from runs group by k),
longest as (select * from runs qualify row_number() over (partition by k order by length desc, start, period) = 1),
kept as (
  select k, string_agg(x, ' ' order by i) as t from x
  where not exists (from runs where runs.k = x.k and x.i >= start + period and x.i < start + length) group by k
)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, l.start::bigint as start, l.length::bigint as length, period::bigint as period,
  (1000 * l.length // period)::bigint as exponent_milli, coalesce(s, sha256('')) as runs_sha256, sha256(coalesce(t, '')) as collapsed_sha256
from e left join marks using (k) left join longest l using (k) left join kept using (k)
"""

ORACLES: dict[str, str] = {
    "op1_quality_rules": quality_rules(),
    "op3_suffix_array_dedup": repeated_passages(),
    "op4_chat_formatting": CHAT,
    "op5_ngram_jaccard_join": JACCARD,
    "op9_embedding_near_dedup": EMBEDDINGS,
    "op10_sharding": shards(),
    "op11_exact_topk": SEARCH,
    "op12_collocations": PHRASES,
    "op13_periodic_runs": RUNS,
}
