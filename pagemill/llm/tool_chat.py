"""Tool calls of conversations, linked with their results, ordered, validated and serialised.

A message (conv_id, turn, role, text) of an assistant may hold
``{"tool_calls": [{"id", "name", "arguments", "after"}]}``; ``after`` names calls whose
results it uses.  A message of role ``tool`` holds ``{"tool_call_id", "content"}``.  Calls
and results meet in a hash join on (conversation, identifier).  Calls keep the order of
their turns except where one comes before a call that it names: those, and what depends
on them, move behind in rounds, as many as the longest such chain.  Arguments are checked
against the schemas of the tools.  JSON is canonical: keys in order, no spaces.  All of
it is DataFrame expressions; no conversation is gathered, so its length has no bound.

The order of a conversation's rows is (order_turn, order_hops, turn, idx).

Defined results: repeated rows are one; of several calls (results) with one identifier
the first by turn counts, and ``n_calls`` (``n_results``) says how many there were; the
others are rows with the status ``repeated identifier``.  A result without a call is a row
of its own.  What a message with calls or a result holds besides (its content, further
fields of its own or of its calls, but no JSON nulls) is a plain message with a JSON
object of these fields; calls in it carry their identifier.  Texts that are NULL, empty or no JSON of this form are
plain messages, also those of a tool, and so are calls without an identifier.  A named call
that is missing is reported; calls in a circle, and those that wait for them, are reported
and keep their turn.  NULL conversations are one conversation, a NULL turn comes first.
"""

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import Scratch

KEY = ["conv_id", "call_id"]
_TYPES = {
    "string": "^STRING$",
    "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$",
    "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY",
    "object": "^OBJECT",
}


@dataclass(frozen=True)
class Tool:
    """Parameters by name with their JSON type; those in ``required`` must be there."""

    parameters: dict[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ()


def canonical(variant: Column) -> Column:
    return F.to_json(variant)


def _json(**columns: Column) -> Column:
    """A JSON object with its keys in order, NULL values kept."""
    return F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))), {"ignoreNullFields": "false"})


def _fields(variant: Column, *without: str) -> Column:
    """The fields of an object but those named and JSON nulls; NULL for what is no object."""
    fields = F.try_variant_get(variant, "$", "map<string,variant>")
    return F.map_filter(fields, lambda k, v: ~k.isin(*without) & v.isNotNull() & ~F.is_variant_null(v))


def _call_rest(call: Column) -> Column:
    """What a call holds besides its known fields, and ``after`` if it is no list of names."""
    odd = F.try_variant_get(call, "$.after", "array<string>").isNull()
    return F.when(odd, _fields(call, "id", "name", "arguments")).otherwise(_fields(call, "id", "name", "arguments", "after"))


def _rest(rows: DataFrame, named: Column) -> DataFrame:
    """Messages of what calling and answering messages hold besides."""
    own = F.when(F.col("answers").isNotNull(), _fields(F.col("body"), "tool_call_id", "content")).otherwise(_fields(F.col("body"), "tool_calls"))
    more = F.filter("calls", lambda c: F.try_variant_get(c, "$.id", "string").isNotNull() & (F.size(_call_rest(c)) > 0))
    of_call = lambda c: F.map_concat(F.create_map(F.lit("id"), F.try_variant_get(c, "$.id", "variant")), _call_rest(c))
    in_calls = F.create_map(F.lit("tool_calls"), F.to_variant_object(F.transform("more", of_call)))
    held = rows.where(F.col("answers").isNotNull() | F.coalesce(named, F.lit(False))).withColumn("own", own).withColumn("more", more)
    fields = F.when(F.size("more") > 0, F.map_concat("own", in_calls)).otherwise(F.col("own"))
    held = held.where((F.size("own") > 0) | (F.size("more") > 0))
    return held.select("conv_id", "turn", "role", canonical(F.to_variant_object(fields)).alias("text"))


def parse(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls (KEY, turn, idx, name, arguments, after), results (KEY, turn, content) and plain messages."""
    rows = messages.select(F.col("conv_id").cast("string"), F.col("turn").cast("long"), "role", "text")
    body = F.when(F.col("role").isin("assistant", "tool"), F.try_parse_json("text"))
    rows = rows.withColumn("body", body)
    found = F.try_variant_get("body", "$.tool_calls", "array<variant>")
    rows = rows.withColumn("calls", F.when(F.col("role") == "assistant", found))
    rows = rows.withColumn("answers", F.when(F.col("role") == "tool", F.try_variant_get("body", "$.tool_call_id", "string")))
    each = rows.where("calls is not null").select("conv_id", "turn", F.posexplode("calls").alias("idx", "c"))
    given = F.try_variant_get("c", "$.arguments", "variant")
    text = F.try_variant_get("c", "$.arguments", "string")
    # Arguments may be written as an object or as its JSON text.
    raw = F.when(F.schema_of_variant(given) == "STRING", F.coalesce(canonical(F.try_parse_json(text)), text)).otherwise(canonical(given))
    calls = each.select(
        "conv_id", F.try_variant_get("c", "$.id", "string").alias("call_id"), "turn", "idx",
        F.try_variant_get("c", "$.name", "string").alias("name"), raw.alias("arguments"),
        F.coalesce(F.try_variant_get("c", "$.after", "array<string>"), F.array().cast("array<string>")).alias("after"),
        F.when(F.coalesce(F.size(_fields(F.col("c"), "name", "arguments")) != 0, F.lit(True)), canonical(F.col("c"))).alias("odd"),
    )
    results = rows.where("answers is not null").select(
        "conv_id", F.col("answers").alias("call_id"), "turn", canonical(F.try_variant_get("body", "$.content", "variant")).alias("content")
    )
    named = F.exists("calls", lambda c: F.try_variant_get(c, "$.id", "string").isNotNull())
    plain = rows.where(F.col("answers").isNull() & ~F.coalesce(named, F.lit(False))).select("conv_id", "turn", "role", "text")
    known = _json(arguments=F.col("arguments"), name=F.col("name"))
    nameless = calls.where("call_id is null").select(
        "conv_id", "turn", F.lit("assistant").alias("role"), F.coalesce("odd", known).alias("text")
    )
    whole = rows.where(F.coalesce(named, F.lit(False))).select("conv_id", "turn")
    nameless = nameless.join(whole.distinct(), [nameless["conv_id"].eqNullSafe(whole["conv_id"]), nameless["turn"].eqNullSafe(whole["turn"])], "left_semi")
    others = plain.unionByName(nameless).unionByName(_rest(rows, named))
    return calls.where("call_id is not null").drop("odd"), results, others.distinct()


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """One row for each identifier: its first call and its first result, either may be missing."""
    call = F.min(F.struct("turn", "idx", "name", "arguments", "after")).alias("call")
    first = calls.distinct().groupBy(*KEY).agg(call, F.count("*").cast("int").alias("n_calls"))
    answer = F.min(F.struct("turn", "content")).alias("result")
    answers = results.distinct().groupBy(*KEY).agg(answer, F.count("*").cast("int").alias("n_results"))
    # NULL conversations meet too; identifiers are never NULL here.
    safe = lambda df: df.withColumn("_conv", F.coalesce("conv_id", F.lit(""))).withColumn("_null", F.col("conv_id").isNull()).drop("conv_id")
    joined = safe(first).join(safe(answers).hint("shuffle_hash"), ["_conv", "_null", "call_id"], "full_outer")
    return joined.select(
        F.when(~F.col("_null"), F.col("_conv")).alias("conv_id"), "call_id", "call.turn", "call.idx", "call.name", "call.arguments", "call.after",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.col("result.turn").alias("result_turn"), "result.content",
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
    )


def repeated(calls: DataFrame, results: DataFrame, linked: DataFrame) -> DataFrame:
    """Rows as of ``link`` for the calls and results that are not the first of their identifier."""
    call, result = F.struct("turn", "idx", "name", "arguments", "after"), F.struct("turn", "content")

    def further(rows: DataFrame, first: DataFrame, own: Column) -> DataFrame:
        rows = rows.distinct().withColumn("own", own)
        same = [rows["conv_id"].eqNullSafe(first["conv_id"]), rows["call_id"] == first["call_id"], ~rows["own"].eqNullSafe(first["first"])]
        return rows.join(first, same).select(rows["conv_id"], rows["call_id"], "own", "n_calls", "n_results")

    both = ["n_calls", "n_results"]
    firsts = linked.where("n_calls > 1").select(*KEY, call.alias("first"), *both)
    answers = linked.where("n_results > 1").select(*KEY, F.struct(F.col("result_turn").alias("turn"), "content").alias("first"), *both)
    none = lambda kind: F.lit(None).cast(kind)
    more_calls = further(calls, firsts, call).select(
        *KEY, "own.turn", "own.idx", "own.name", "own.arguments", "own.after", *both, none("long").alias("result_turn"), none("string").alias("content"),
        F.lit(True).alias("is_call"),
    )
    more_results = further(results, answers, result).select(
        *KEY, none("long").alias("turn"), none("int").alias("idx"), none("string").alias("name"), none("string").alias("arguments"),
        none("array<string>").alias("after"), *both, F.col("own.turn").alias("result_turn"), "own.content", F.lit(False).alias("is_call"),
    )
    return more_calls.unionByName(more_results)


def order(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """(KEY, order_turn, order_hops, missing, circle) of linked calls; only what is out of order moves."""
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id")), F.lit("n")).alias("conv")
    own = scratch.save(calls.where("n_calls > 0").select(conv, *KEY, "turn", "idx", "after"), "calls")
    named = own.select("conv", "call_id", "turn", "idx", F.explode(F.array_distinct("after")).alias("dep"))
    places = own.select("conv", F.col("call_id").alias("dep"), F.col("turn").alias("dep_turn"), F.col("idx").alias("dep_idx"))
    edges = scratch.save(named.join(places, ["conv", "dep"], "left"), "edges")
    missing = edges.where("dep_idx is null").groupBy("conv", "call_id").agg(F.sort_array(F.collect_set("dep")).alias("missing"))
    edges = edges.where("dep_idx is not null")
    late = edges.where(F.struct(F.col("dep_turn"), F.col("dep_idx")) >= F.struct(F.col("turn"), F.col("idx")))
    moved = _moved(own, edges, late, scratch)
    rows = own.join(missing, ["conv", "call_id"], "left").join(moved, ["conv", "call_id"], "left")
    return rows.select(
        *KEY, F.coalesce("order_turn", "turn").alias("order_turn"), F.coalesce("order_hops", F.lit(0)).alias("order_hops"),
        "missing", F.coalesce("circle", F.lit(False)).alias("circle"),
    )


def _moved(own: DataFrame, edges: DataFrame, late: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, call_id, order_turn, order_hops, circle) of the calls that cannot stay in their turn."""
    node = ["conv", "call_id"]
    affected = scratch.save(late.select(*node).distinct(), "affected-0")
    step, fresh = 0, affected
    while not fresh.isEmpty():  # all that depends on them
        step += 1
        on = fresh.select("conv", F.col("call_id").alias("dep"))
        fresh = scratch.save(edges.join(on, ["conv", "dep"]).select(*node).distinct().join(affected, node, "left_anti"), f"fresh-{step}")
        affected = scratch.save(affected.union(fresh), f"affected-{step}")
    rest, settled, step = affected, None, 0
    base = own.join(affected, node, "left_semi").select(*node, "turn")
    inner = edges.join(affected, node, "left_semi").select(*node, "dep", "dep_turn")
    while not rest.isEmpty():
        step += 1
        on = rest.select("conv", F.col("call_id").alias("dep"))
        waiting = inner.join(rest, node, "left_semi").join(on, ["conv", "dep"], "left_semi").select(*node).distinct()
        ready = rest.join(waiting, node, "left_anti")
        after = inner.join(ready, node, "left_semi")
        if settled is None:
            after = after.select(*node, F.struct(F.col("dep_turn").alias("t"), F.lit(0).alias("h")).alias("d"))
        else:
            known = settled.select("conv", F.col("call_id").alias("dep"), F.struct(F.col("order_turn").alias("t"), F.col("order_hops").alias("h")).alias("k"))
            unmoved = F.struct(F.col("dep_turn").alias("t"), F.lit(0).alias("h"))
            after = after.join(known, ["conv", "dep"], "left").select(*node, F.coalesce("k", unmoved).alias("d"))
        last = after.groupBy(*node).agg(F.max("d").alias("d"))
        behind = F.col("d.t").isNotNull() & (F.col("turn").isNull() | (F.col("d.t") >= F.col("turn")))
        placed = base.join(ready, node, "left_semi").join(last, node, "left").select(
            *node, F.when(behind, F.col("d.t")).otherwise(F.col("turn")).alias("order_turn"),
            F.when(behind, F.col("d.h") + 1).otherwise(0).alias("order_hops"), F.lit(False).alias("circle"),
        )
        placed = scratch.save(placed, f"placed-{step}")
        if placed.isEmpty():
            break
        settled = placed if settled is None else scratch.save(settled.union(placed), f"settled-{step}")
        rest = scratch.save(rest.join(placed, node, "left_anti"), f"rest-{step}")
    stuck = base.join(rest, node, "left_semi").select(*node, F.col("turn").alias("order_turn"), F.lit(0).alias("order_hops"), F.lit(True).alias("circle"))
    return stuck if settled is None else settled.union(stuck)


def errors(tools: dict[str, Tool]) -> Column:
    """What is wrong with ``name`` and ``arguments`` under the schemas; an empty array if nothing."""
    body = F.try_parse_json("arguments")
    is_object = F.coalesce(F.schema_of_variant(body).startswith("OBJECT"), F.lit(False))
    found = [F.when(~F.col("name").isin(list(tools)) | F.col("name").isNull(), F.lit("unknown tool")), F.when(~is_object, F.lit("arguments are no object"))]
    for name, tool in sorted(tools.items()):
        this = (F.col("name") == name) & is_object
        for parameter, kind in sorted(tool.parameters.items()):
            if not re.fullmatch(r"\w+", parameter):
                raise ValueError(f"parameter name {parameter!r}")
            value = F.schema_of_variant(F.try_variant_get(body, f"$.{parameter}", "variant"))
            absent = value.isNull()
            if parameter in tool.required:
                found.append(F.when(this & absent, F.lit(f"missing {parameter}")))
            found.append(F.when(this & ~absent & ~F.coalesce(value.rlike(_TYPES[kind]), F.lit(False)), F.lit(f"{parameter} is no {kind}")))
        keys = F.json_object_keys("arguments")
        extra = F.size(F.array_except(keys, F.array(*map(F.lit, sorted(tool.parameters))))) > 0
        found.append(F.when(this & extra, F.lit("unexpected parameter")))
    return F.array_compact(F.array(*found))


def format_chat(messages: DataFrame, tools: dict[str, Tool]) -> DataFrame:
    """One row for each plain message, call, result without a call and repeated identifier, with its canonical JSON."""
    scratch = Scratch(messages.sparkSession)
    calls, results, plain = parse(messages)
    linked = scratch.save(link(calls, results), "linked")
    placed = order(linked, scratch)
    safe = [linked["conv_id"].eqNullSafe(placed["conv_id"]), linked["call_id"] == placed["call_id"]]
    rows = linked.join(placed, safe, "left").select(*(linked[c] for c in linked.columns), "order_turn", "order_hops", "missing", "circle")
    rows = rows.withColumn("is_call", F.col("n_calls") > 0).withColumn("again", F.lit(False))
    further = repeated(calls, results, linked).withColumn("order_turn", F.col("turn")).withColumn("again", F.lit(True))
    rows = further.unionByName(rows, allowMissingColumns=True)
    wrong = errors(tools)
    is_call = F.col("is_call")
    status = (
        F.when(F.col("again"), "repeated identifier")
        .when(~is_call, "no call")
        .when(F.col("circle"), "circle")
        .when(F.size("errors") > 0, "invalid")
        .when(F.col("missing").isNotNull(), "missing dependency")
        .when(F.col("n_results") == 0, "no result")
        .when(F.col("result_turn") < F.col("turn"), "early result")
        .otherwise("linked")
    )
    parsed = lambda c: F.try_parse_json(c)
    text = F.when(
        is_call,
        _json(
            after=F.col("after"), arguments=parsed("arguments"), id=F.col("call_id"), name=F.col("name"), result=parsed("content"),
        ),
    ).otherwise(_json(id=F.col("call_id"), result=parsed("content")))
    named = rows.withColumn("errors", F.when(is_call, wrong).otherwise(F.array().cast("array<string>"))).select(
        "conv_id", F.coalesce("order_turn", "result_turn").alias("order_turn"), F.coalesce("order_hops", F.lit(0)).alias("order_hops"),
        F.coalesce("turn", "result_turn").alias("turn"), F.coalesce("idx", F.lit(0)).alias("idx"),
        F.when(is_call, "call").otherwise("result").alias("kind"), "call_id", "result_turn", "n_calls", "n_results", status.alias("status"),
        F.concat_ws("; ", "errors").alias("errors"), text.alias("json"),
    )
    none = F.lit(0)
    others = plain.select(
        "conv_id", F.col("turn").alias("order_turn"), none.alias("order_hops"), "turn", none.alias("idx"), F.lit("message").alias("kind"),
        F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("long").alias("result_turn"), none.alias("n_calls"), none.alias("n_results"),
        F.lit("plain").alias("status"), F.lit("").alias("errors"), _json(role=F.col("role"), text=F.col("text")).alias("json"),
    )
    return named.unionByName(others)
