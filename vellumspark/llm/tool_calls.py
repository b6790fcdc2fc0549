"""Tool-call linking: join calls and results by identifier, order calls topologically, validate arguments, write canonical JSON.

Native: DataFrame functions only. Input is an event table: conv_id, turn, kind ('call' or 'result'), call_id, payload.
A call's payload is JSON ``{"name": ..., "arguments": {...}, "after": [call ids]}``; a result's payload is any text.

Linking: results and calls are reduced to one row for each (conversation, call_id) before a hash join, so repeated
identifiers can't multiply rows; the largest groups of calls with one identifier are looked up in a broadcast table of
fixed size. Order: a call's level is the longest chain of dependencies below it. Each round every open dependency takes
over what its target knows: its level, or its one open dependency at the sum of both distances. Chains are followed by
doubling, so their rounds grow with the logarithm of their length; calls with several open dependencies wait for all but
one. Dependencies that two others imply (back, or forth, in steps of one direction) are left out first, so ladders are
chains. A round that settles nothing leaves only calls in or behind a cycle. The order is given as sort key (level, turn,
call_id), so no task ever needs a whole conversation. Canonical JSON: keys sorted, no blanks, which is how Spark writes a
parsed variant.

Defined results: a null conv_id is a conversation of its own, other than that of the empty name; rows with a null call_id
are calls that cannot be linked and have no level; of calls with one id the first by (turn, payload) counts, of equal rows
exactly one, and the others are 'duplicate'; a null turn comes first; a result without a call or without an id is not
listed; payloads that aren't JSON objects, or have a key twice, are 'invalid'; unknown tools are 'unknown'; a dependency
on an id that isn't called is 'missing' and does not hold a call back; a call that needs itself is a cycle; texts of any
length are kept whole; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.common import delete, join_hot, store, stored

#: No chain is longer; the distances in a cycle, which double in every round, stop here.
FARTHEST = 1 << 40
#: Calls with more dependencies than this are not looked through for implied ones.
FEW = 4

#: Tool schemas: tool -> parameter -> (type, required, least, most); a string's bounds are of its length, null: none.
SCHEMAS = {
    "reply": {
        "text": ("string", True, 1, None),
        "turn": ("long", True, 0, None),
        "words": ("long", True, 1, 100_000),
    },
}
_SQL_TYPES = {"string": ("string",), "long": ("bigint", "int"), "double": ("double", "decimal", "bigint"), "boolean": ("boolean",)}


def violations(arguments: Column, name: Column, schemas: dict = SCHEMAS) -> Column:
    """Sorted array of ``parameter:reason`` of a call's arguments (a variant); null for an unknown tool."""
    out = F.lit(None).cast("array<string>")
    for tool, parameters in schemas.items():
        found = []
        for parameter, (kind, required, least, most) in sorted(parameters.items()):
            path = f"$.{parameter}"
            value = F.try_variant_get(arguments, path, "variant")
            absent = value.isNull() | F.is_variant_null(value)
            shape = F.lower(F.regexp_extract(F.schema_of_variant(value), "^[A-Za-z]+", 0))
            typed = F.try_variant_get(arguments, path, kind)
            measure = F.length(typed) if kind == "string" else typed
            reason = F.when(absent, F.lit("missing") if required else F.lit(None))
            reason = reason.when(~shape.isin(*_SQL_TYPES[kind]), F.lit("type"))
            bounds = F.lit(False)
            if least is not None:
                bounds = bounds | (measure < least)
            if most is not None:
                bounds = bounds | (measure > most)
            reason = reason.when(bounds, F.lit("range"))
            found.append(F.when(reason.isNotNull(), F.concat(F.lit(f"{parameter}:"), reason)))
        out = F.when(name == tool, F.array_compact(F.array(*found))).otherwise(out)
    return out


def reduced(edges: DataFrame) -> DataFrame:
    """Dependencies (k, needs, at, of; at and of are the turns of both) without those that two others imply.

    Only steps of one direction of turns count, in which there are no cycles: what is left reaches what it reached, over
    chains as long as before.
    """
    few = edges.join(edges.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n").between(1, FEW)), "k")
    onward = few.select(F.col("k").alias("needs"), F.col("needs").alias("x"), F.col("of").alias("far"))
    back, forth = (F.col("at") > F.col("of")) & (F.col("of") > F.col("far")), (F.col("at") < F.col("of")) & (F.col("of") < F.col("far"))
    implied = edges.hint("merge").join(onward, "needs").where(back | forth).select("k", F.col("x").alias("needs"))
    return edges.join(implied, ["k", "needs"], "left_anti")


def levels(edges: DataFrame) -> DataFrame:
    """k, level of every call that has a dependency (k, needs, at, of); null in or behind a cycle."""
    spark = edges.sparkSession
    state = reduced(store(edges.distinct(), "edges")).select("k", "needs", F.lit(1).cast("long").alias("far"), F.lit(None).cast("long").alias("least"))
    state, path = stored(state, "levels")
    before = -1
    while True:
        # what each call knows: the level that its settled dependencies ask for, and its only open one
        knows = state.groupBy("k").agg(F.max("least").alias("least"), F.count("needs").alias("open"), F.min(F.when(F.col("needs").isNotNull(), F.struct("needs", "far"))).alias("one"))
        open_ = int(state.agg(F.count("needs")).first()[0])
        if open_ in (0, before):
            return knows.select("k", F.when(F.col("open") == 0, F.col("least")).alias("level"))
        before = open_
        target = state.where("needs IS NOT NULL").select("k", "needs", "far").hint("merge").join(
            knows.select(F.col("k").alias("needs"), "least", "open", "one"), "needs", "left"
        )
        ready = F.coalesce("open", F.lit(0))
        onward = F.when(ready == 1, F.col("one.needs")).when(ready > 1, F.col("needs"))
        moved = target.select(
            "k", onward.alias("needs"), F.when(ready == 1, F.least(F.col("far") + F.col("one.far"), F.lit(FARTHEST))).when(ready > 1, F.col("far")).alias("far"),
            F.when(ready == 0, F.coalesce("least", F.lit(0)) + F.col("far")).when(ready == 1, F.col("least") + F.col("far")).alias("least"),
        )
        rows = moved.unionByName(state.where("needs IS NULL"))
        nothing = F.lit(None).cast(edges.schema["needs"].dataType)
        settled = rows.groupBy("k").agg(F.max("least").alias("least")).where("least IS NOT NULL").select("k", nothing.alias("needs"), F.lit(None).cast("long").alias("far"), "least")
        waiting = rows.where("needs IS NOT NULL").groupBy("k", "needs").agg(F.max("far").alias("far")).select("k", "needs", "far", F.lit(None).cast("long").alias("least"))
        after, to = stored(waiting.unionByName(settled), "levels")
        delete(spark, path)
        state, path = after, to


def link(events: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """One row per call: conv_id, turn, call_id, name, arguments (canonical JSON), status, violations, level, result_turn,
    result, record (canonical JSON of the linked call). Sort a conversation by (level, turn, call_id) for its order."""
    key = lambda call_id: F.struct(F.coalesce(F.concat(F.lit("="), "conv_id"), F.lit("")).alias("c"), call_id.alias("i"))
    e = events.select(
        F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "kind",
        F.col("call_id").cast("string").alias("call_id"), F.col("payload").cast("string").alias("payload"),
    )
    raw = e.where("kind = 'call'").withColumn("v", F.try_parse_json("payload"))
    shaped = F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("v"))
    parsed = raw.withColumn("v", shaped).select(
        "conv_id", "turn", "call_id", "payload",
        F.try_variant_get("v", "$.name", "string").alias("name"),
        F.try_variant_get("v", "$.arguments", "variant").alias("args"),
        F.coalesce(F.try_variant_get("v", "$.after", "array<string>"), F.array().cast("array<string>")).alias("after"),
    )
    args = F.col("args")
    object_ = F.coalesce(F.schema_of_variant(args).startswith("OBJECT"), F.lit(False))
    wrong = violations(args, F.col("name"), schemas)
    calls = store(
        parsed.select(
            "conv_id", "turn", "call_id", "name", "after", F.xxhash64("payload").alias("mark"), F.monotonically_increasing_id().alias("uid"),
            F.when(object_, F.to_json(args)).alias("arguments"),
            F.when(F.col("name").isNull() | ~object_, "invalid").when(wrong.isNull(), "unknown").when(F.size(wrong) > 0, "violates").otherwise("valid").alias("checked"),
            F.when(object_, wrong).alias("violations"), key(F.col("call_id")).alias("k"),
        ), "calls")
    # one call and one result for each identifier; partial aggregation collapses a hot identifier in every task
    named = calls.where("call_id IS NOT NULL")
    heads = named.groupBy("k").agg(F.min(F.struct("turn", "mark", "uid", "after")).alias("head"), F.count("*").alias("calls"))
    heads = store(heads.select("k", F.col("head.turn").alias("at"), F.col("head.uid").alias("head_uid"), F.col("head.after").alias("after"), "calls"), "call-heads")
    results = (
        e.where("kind = 'result' AND call_id IS NOT NULL")
        .groupBy(key(F.col("call_id")).alias("k"))
        .agg(F.min(F.struct(F.col("turn").alias("result_turn"), F.coalesce("payload", F.lit("")).alias("result"))).alias("r"))
        .select("k", "r.result_turn", "r.result")
    )
    # an edge for each named dependency that is called
    edges = heads.select("k", "at", F.explode(F.array_distinct("after")).alias("i")).where("i IS NOT NULL").select("k", "at", F.struct("k.c", "i").alias("needs"))
    called = heads.select(F.col("k").alias("needs"), F.col("at").alias("of"))
    level = levels(edges.hint("merge").join(called, "needs")).withColumn("ordered", F.lit(True))
    of_id = heads.select("k", "head_uid", "calls").join(level, "k", "left").withColumn("level", F.when(F.col("ordered"), F.col("level")).otherwise(0).cast("int")).drop("ordered")
    linked = join_hot(named, store(of_id.join(results, "k", "left"), "call-results"), "k", "calls")
    status = F.when(F.col("uid") != F.col("head_uid"), "duplicate").when(F.col("level").isNull(), "cycle").otherwise(F.col("checked"))
    alone = calls.where("call_id IS NULL").withColumn("status", F.col("checked"))
    linked = linked.withColumn("status", status).unionByName(alone, allowMissingColumns=True)
    text = lambda c: F.to_json(F.to_variant_object(F.array(F.coalesce(c, F.lit("")))))
    quoted = lambda c: F.expr(f"substr({c}, 2, length({c}) - 2)")
    linked = linked.withColumns({"_id": text(F.col("call_id")), "_n": text(F.col("name")), "_r": text(F.col("result"))})
    record = F.concat(
        F.lit('{"arguments":'), F.coalesce("arguments", F.lit("null")), F.lit(',"id":'), quoted("_id"), F.lit(',"name":'), quoted("_n"), F.lit(',"result":'),
        F.when(F.col("result").isNull(), F.lit("null")).otherwise(quoted("_r")), F.lit("}"),
    )
    return linked.select("conv_id", "turn", "call_id", "name", "arguments", "status", "violations", "level", "result_turn", "result", record.alias("record"))


def conversation_events(conversations: DataFrame) -> DataFrame:
    """A conversation table as tool events: each user turn calls the tool ``reply``, which the assistant turn after it answers.

    A call's identifier is ``c<conv_id>t<turn>``, null without a turn. Conversations fall into four kinds by the MD5 of
    their id, so that all kinds of order occur: each call needs the one before it; needs the one after it; needs the two
    before it; or, by fours, the first two need each other, the third needs the first and the fourth, which needs none.
    Other roles give no event.
    """
    turn = F.col("turn").cast("long")
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    name = lambda t: F.concat(F.lit("c"), conv, F.lit("t"), t.cast("string"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    kind, place = F.substring(F.md5(conv.cast("binary")), 1, 1), F.floor(turn / 2) % 4
    needs = (
        F.when(kind < "4", F.array(name(turn - 2)))
        .when(kind < "8", F.array(name(turn + 2)))
        .when(kind < "c", F.array(name(turn - 2), name(turn - 4)))
        .when(place == 0, F.array(name(turn + 2)))
        .when(place == 1, F.array(name(turn - 2)))
        .when(place == 2, F.array(name(turn - 4), name(turn + 2)))
        .otherwise(F.array().cast("array<string>"))
    )
    call = F.to_json(F.struct(F.lit("reply").alias("name"), F.struct(words.alias("words"), text.alias("text"), turn.alias("turn")).alias("arguments"), F.array_compact(needs).alias("after")))
    return conversations.where(F.col("role").isin("user", "assistant")).select(
        F.col("conv_id"), turn.alias("turn"),
        F.when(F.col("role") == "user", "call").otherwise("result").alias("kind"),
        name(F.when(F.col("role") == "user", turn).otherwise(turn - 1)).alias("call_id"),
        F.when(F.col("role") == "user", call).otherwise(text).alias("payload"),
    )


def contract(conversations: DataFrame) -> DataFrame:
    """link() of the conversations' events, without the texts that ``record`` holds again."""
    return link(conversation_events(conversations)).select(
        "conv_id", "turn", "call_id", "name", "status", F.array_join("violations", ",").alias("violations"), "level", "result_turn", "record"
    )


SQL = r"""
WITH RECURSIVE t AS (SELECT CAST(conv_id AS VARCHAR) AS conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE role IN ('user', 'assistant')),
c AS (SELECT *, 'c' || conv_id || 't' || turn AS call_id, len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words,
  substr(md5(conv_id), 1, 1) AS kind, (turn // 2) % 4 AS place FROM t WHERE role = 'user'),
f AS (SELECT conv_id, turn - 1 AS turn, turn AS result_turn, text AS result FROM t WHERE role = 'assistant'
      QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) = 1),
d AS (SELECT conv_id, turn, unnest(CASE WHEN kind < '4' THEN [turn - 2] WHEN kind < '8' THEN [turn + 2] WHEN kind < 'c' THEN [turn - 2, turn - 4]
  WHEN place = 0 THEN [turn + 2] WHEN place = 1 THEN [turn - 2] WHEN place = 2 THEN [turn - 4, turn + 2] ELSE [] END) AS needs FROM c),
e AS (SELECT d.* FROM d WHERE EXISTS (SELECT 1 FROM c WHERE c.conv_id = d.conv_id AND c.turn = d.needs)),
reach AS (SELECT conv_id, turn, needs FROM e UNION SELECT r.conv_id, r.turn, e.needs FROM reach r JOIN e ON e.conv_id = r.conv_id AND e.turn = r.needs),
ring AS (SELECT DISTINCT conv_id, turn FROM reach WHERE turn = needs),
stuck AS (SELECT conv_id, turn FROM ring UNION SELECT r.conv_id, r.turn FROM reach r JOIN ring g ON g.conv_id = r.conv_id AND g.turn = r.needs),
walk AS (SELECT conv_id, turn, 0 AS depth FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.conv_id = c.conv_id AND e.turn = c.turn)
  UNION SELECT e.conv_id, e.turn, w.depth + 1 FROM walk w JOIN e ON e.conv_id = w.conv_id AND e.needs = w.turn),
l AS (SELECT conv_id, turn, max(depth) AS level FROM walk w WHERE NOT EXISTS (SELECT 1 FROM stuck s WHERE s.conv_id = w.conv_id AND s.turn = w.turn) GROUP BY ALL),
v AS (SELECT c.*, f.result_turn, f.result, l.level,
  concat_ws(',', CASE WHEN length(text) < 1 THEN 'text:range' END, CASE WHEN words < 1 OR words > 100000 THEN 'words:range' END) AS violations
  FROM c LEFT JOIN f ON c.conv_id = f.conv_id AND c.turn = f.turn LEFT JOIN l ON c.conv_id = l.conv_id AND c.turn = l.turn)
SELECT conv_id, turn, call_id, 'reply' AS name, CASE WHEN level IS NULL THEN 'cycle' WHEN violations = '' THEN 'valid' ELSE 'violates' END AS status, violations, CAST(level AS INTEGER) AS level, result_turn,
  '{"arguments":{"text":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || turn || ',"words":' || words || '},"id":' || CAST(to_json(call_id) AS VARCHAR) || ',"name":"reply","result":'
  || CASE WHEN result IS NULL THEN 'null' ELSE CAST(to_json(result) AS VARCHAR) END || '}' AS record
FROM v
"""
