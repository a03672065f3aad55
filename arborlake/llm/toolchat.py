"""Chat formatting: tool-call linking.

Calls and results are hash-joined by (conversation, call id); each id links its
first result, so the join has one row a call, and the other results are rows of
their own. Calls
are put in an order in which each stands after the calls it depends on; their
arguments are validated against the tools' schemas; and each linked call is
serialised as canonical JSON (sorted keys, no blanks).

Everything is built of DataFrame functions. A conversation is never gathered:
the unit is the call, so a conversation that holds a third of all turns is
dealt over all tasks.

Arguments are brought to one form before they are checked and written: a number is
written as the shortest decimal (``1.0`` and ``1e0`` are the integer ``1``), with an
exponent below 1e-6 and from 1e21 on.

Defined cases. A call without id, conversation or result: status ``unlinked``.
A call without a turn stands at turn 0 or after what it needs.
Each result without a call, or without conversation or id: a row of its own,
status ``orphan``. Calls that share an id share its first result (least turn,
then least content, nulls last); each further result of that id is, with
``duplicates`` as in the query, an ``orphan`` row with the error
``result: duplicate``. Arguments that are no JSON object are
invalid, as are null, empty or cut-off ones. A dependency on an unknown id is ignored for the order. Calls on or after
a cycle of dependencies: status ``cycle`` and no position. Repeated calls are rows of their own with equal results.
Texts of any length are kept whole. Empty tables give no row. Only the named columns are read, so further ones change nothing.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.llm.common import Scratch

#: JSON types by the names that schema_of_variant gives.
TYPES = {"string": "STRING", "integer": r"BIGINT|DECIMAL\([0-9]+,0\)", "boolean": "BOOLEAN", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "array": "ARRAY.*", "object": "OBJECT.*"}

#: Bytes of results that one task of the hash join holds on its build side, about.
BUILD_BYTES = 64 << 20

#: The tools of the ``conversations`` projection.
SCHEMAS: Mapping[str, Mapping[str, Mapping]] = {
    "answer": {
        "prompt": {"type": "string", "required": True, "min_length": 1, "max_length": 400},
        "turn": {"type": "integer", "required": True, "minimum": 0},
        "style": {"type": "string", "enum": ["short", "long"]},
    },
    "instruct": {"prompt": {"type": "string", "required": True, "min_length": 1}, "turn": {"type": "integer", "required": True, "minimum": 0}},
}


def argument_errors(name: Column, arguments: Column, keys: Column, schemas: Mapping[str, Mapping[str, Mapping]]) -> Column:
    """The faults of a parsed arguments value (a VARIANT, null where it is no JSON) as a sorted array of strings."""
    faults = F.array(F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit("null"))))
    for tool, parameters in schemas.items():
        found: list[Column] = []
        for p, rule in parameters.items():
            value = F.try_variant_get(arguments, f"$.{p}", "variant")
            kind = F.schema_of_variant(value)
            missing = value.isNull() | (kind == "VOID")
            typed = kind.rlike(f"^({TYPES[rule['type']]})$")
            text = F.try_variant_get(arguments, f"$.{p}", "string")
            number = F.try_variant_get(arguments, f"$.{p}", "double")
            bad: list[tuple[Column, str]] = []
            if rule.get("required"):
                bad.append((missing, f"{p}: missing"))
            bad.append((~missing & ~typed, f"{p}: not {rule['type']}"))
            if "enum" in rule:
                bad.append((~missing & typed & ~text.isin(rule["enum"]), f"{p}: not in enum"))
            for key, test in (("min_length", lambda n: F.length(text) < n), ("max_length", lambda n: F.length(text) > n), ("minimum", lambda n: number < n), ("maximum", lambda n: number > n)):
                if key in rule:
                    bad.append((~missing & typed & test(rule[key]), f"{p}: {key}"))
            found += [F.when(F.coalesce(test, F.lit(False)), F.lit(message)) for test, message in bad]
        surplus = F.transform(F.array_except(keys, F.array(*[F.lit(p) for p in parameters])), lambda k: F.concat(k, F.lit(": unexpected")))
        own = F.concat(F.filter(F.array(*found), lambda x: x.isNotNull()), surplus)
        faults = F.when(name == tool, own).otherwise(faults)
    return F.array_sort(F.when(arguments.isNull() | keys.isNull(), F.array(F.lit("arguments: no JSON object"))).otherwise(faults))


def canonical_number(token: Column) -> Column:
    """A JSON number in its one form: what a double holds, without needless digits, as ECMAScript writes it."""
    value = token.cast("double")
    size = F.abs(value)
    # Java's shortest digits, brought to decimal notation between 1e-6 and 1e21.
    digits = F.regexp_replace(F.regexp_replace(value.cast("string"), r"\.0(?=E|$)", ""), "E", "e")
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%s", value.cast("decimal(38,16)")), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    small = F.concat(F.when(value < 0, "-").otherwise(""), F.lit("0."), F.repeat(F.lit("0"), F.lit(-1) - F.regexp_extract(digits, "e(-[0-9]+)", 1).cast("int")), F.regexp_replace(F.regexp_replace(digits, "e.*", ""), r"[-.]", ""))
    whole = F.when(size == 0, F.lit("0")).when(size < 1e-6, digits).when(size < 1e-3, small).when(size < 1e7, digits).when(size < 1e21, plain).otherwise(F.regexp_replace(digits, "e(?=[0-9])", "e+"))
    return F.when(token.rlike("^-?[0-9]+$") | value.isNull() | size.isin(float("inf")), token).otherwise(whole)


def canonical_numbers(text: Column) -> Column:
    """JSON with its numbers in one form; strings, and text without fractions or exponents, stay as they are."""
    pieces = F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]|\\.)*+"?|-?[0-9][0-9.eE+-]*+|[^"0-9-]++|-'), F.lit(0))
    number = lambda p: F.when(p.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), canonical_number(p)).otherwise(p)
    return F.when(text.rlike("[0-9][.eE]"), F.array_join(F.transform(pieces, number), "")).otherwise(text)


#: The position of a call on or after a cycle.
NEVER = 1 << 62


def positions(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, call_id, position): an order by position, then turn, is topological; null on or after a cycle.

    A call's position is its turn, or one more than the last position of what it
    needs. Where all dependencies stand at earlier turns, as in recorded chats,
    that is the turn. In the other conversations each call follows the need that
    stands last so far: those pointers are followed by doubling, so a chain (or a
    cycle, which no walk leaves) takes as many rounds as its length has bits; and
    pointers are chosen again until no call moves.
    """
    ids = calls.filter(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    nodes = ids.groupBy("conv_id", "call_id").agg(F.coalesce(F.max("turn"), F.lit(0)).cast("bigint").alias("position"))
    edges = ids.select("conv_id", "call_id", F.explode("depends_on").alias("needs")).distinct()

    def needed(at: DataFrame) -> DataFrame:
        """(conv_id, call_id, need): of each call the need that stands last, as (position, id)."""
        other = at.select("conv_id", F.col("call_id").alias("needs"), F.col("position").alias("before"))
        return edges.join(other, ["conv_id", "needs"]).groupBy("conv_id", "call_id").agg(F.max(F.struct("before", "needs")).alias("need"))

    late = needed(nodes).join(nodes, ["conv_id", "call_id"]).filter(F.col("need.before") >= F.col("position"))
    affected = scratch.table(late.select("conv_id").distinct(), "affected")
    if affected.isEmpty():
        scratch.drop("affected")
        return nodes
    edges = scratch.table(edges.join(affected, "conv_id", "left_semi"), "edges")
    moved = scratch.table(nodes.join(affected, "conv_id", "left_semi").withColumn("base", F.col("position")), "moved0")
    longest = moved.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    rounds = 0
    while True:
        chosen = moved.join(needed(moved), ["conv_id", "call_id"], "left")
        # best: the position that the walk so far asks for; hops: its length; ptr: where it goes on.
        walk = scratch.table(chosen.select("conv_id", "call_id", "base", "position", F.col("base").alias("best"), F.col("need.needs").alias("ptr")), f"walk{rounds}-0")
        hops = step = 0
        while hops <= longest:
            onward = walk.select("conv_id", F.col("call_id").alias("ptr"), F.col("best").alias("further"), F.col("ptr").alias("next"))
            span = 1 << step
            joined = walk.join(onward, ["conv_id", "ptr"], "left")
            best = F.greatest("best", F.col("further") + span)
            walk = scratch.table(joined.select("conv_id", "call_id", "base", "position", best.alias("best"), F.col("next").alias("ptr")), f"walk{rounds}-{step + 1}")
            scratch.drop(f"walk{rounds}-{step}")
            hops, step = hops + span, step + 1
            if walk.filter("ptr IS NOT NULL").isEmpty():
                break
        # A walk that goes on after as many hops as its conversation has calls never ends.
        found = walk.select("conv_id", "call_id", "base", "position", F.when(F.col("ptr").isNotNull(), F.lit(NEVER)).otherwise(F.col("best")).alias("now"))
        rounds += 1
        after = scratch.table(found.select("conv_id", "call_id", "base", F.greatest("position", "now").alias("position"), (F.col("now") > F.col("position")).alias("rose")), f"moved{rounds}")
        scratch.drop(f"walk{rounds - 1}-{step}")
        scratch.drop(f"moved{rounds - 1}")
        if after.filter("rose").isEmpty():
            break
        moved = after.drop("rose")
    settled = after.select("conv_id", "call_id", F.when(F.col("position") < NEVER, F.col("position")).alias("position"))
    scratch.drop("edges")
    return nodes.join(affected, "conv_id", "left_anti").unionByName(settled)


def link(calls: DataFrame, results: DataFrame, scratch: Scratch, schemas: Mapping[str, Mapping[str, Mapping]] = SCHEMAS, duplicates: bool = False) -> DataFrame:
    """Links calls (conv_id, turn, call_id, name, arguments, depends_on) and results (conv_id, turn, call_id, content).

    Returns (conv_id, call_id, turn, name, position, result_turn, status, errors, record);
    ``duplicates`` says whether further results of a call that has one are returned too.
    """
    has_key = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    keyed = results.filter(has_key)
    order = F.struct(F.col("turn").isNull().alias("no_turn"), "turn", F.col("content").isNull().alias("no_content"), "content")
    first = keyed.groupBy("conv_id", "call_id").agg(F.min(order).alias("result"))
    named = calls.filter(has_key).select("conv_id", "call_id", F.lit(True).alias("__named")).distinct()
    # Equal results are counted, not gathered, so that what a key repeats is dealt over all tasks; results without a key meet no join.
    counted = keyed.groupBy("conv_id", "call_id", "turn", "content").agg(F.count("*").alias("__n"))
    tagged = counted.join(first, ["conv_id", "call_id"]).join(named, ["conv_id", "call_id"], "left")
    is_first = F.col("turn").eqNullSafe(F.col("result.turn")) & F.col("content").eqNullSafe(F.col("result.content"))
    linked_once = F.col("__named").isNotNull() & is_first
    left = tagged.withColumn("__n", F.col("__n") - linked_once.cast("int"))
    left = left.filter((F.col("__n") > 0) & (F.lit(duplicates) | F.col("__named").isNull()))
    error = F.when(F.col("__named").isNull(), "").otherwise("result: duplicate").alias("errors")
    left = left.select("conv_id", "call_id", "turn", "content", error, F.explode(F.array_repeat(F.lit(True), F.col("__n").cast("int"))).alias("__copy")).drop("__copy")
    orphans = left.unionByName(results.filter(~has_key).select("conv_id", "call_id", "turn", "content", F.lit("").alias("errors")))
    at = positions(calls, scratch)
    # The build side of the hash join holds the texts of the results: it is dealt over tasks by their bytes.
    size = results.agg(F.sum(F.octet_length("content") + 64)).first()[0] or 0
    tasks = max(int(results.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUILD_BYTES))
    dealt = lambda df: df.repartition(tasks, "conv_id", "call_id")
    # Calls without a key meet no result and would all be dealt to one task.
    keyless = calls.filter(~has_key).withColumns({"result": F.lit(None).cast(first.schema["result"].dataType), "position": F.lit(None).cast("bigint")})
    linked = dealt(calls.filter(has_key)).join(dealt(first).hint("shuffle_hash"), ["conv_id", "call_id"], "left").join(at, ["conv_id", "call_id"], "left").unionByName(keyless)
    linked = linked.withColumn("arguments", canonical_numbers(F.col("arguments")))
    parsed = F.try_parse_json("arguments")
    keys = F.map_keys(F.from_json("arguments", "map<string,string>"))
    linked = linked.withColumn("__arguments", parsed).withColumn("errors", argument_errors(F.col("name"), F.col("__arguments"), F.when(F.schema_of_variant("__arguments").startswith("OBJECT"), keys), schemas))
    status = F.when(F.col("position").isNull() & F.col("conv_id").isNotNull() & F.col("call_id").isNotNull(), "cycle").when(F.col("result").isNull(), "unlinked").when(F.size("errors") > 0, "invalid").otherwise("ok")
    record = F.to_json(F.struct(F.col("__arguments").alias("arguments"), F.col("call_id").alias("id"), F.col("name").alias("name"), F.col("result.content").alias("result")), {"ignoreNullFields": "false"})
    out = linked.select("conv_id", "call_id", "turn", "name", "position", F.col("result.turn").alias("result_turn"), status.alias("status"), F.array_join("errors", "; ").alias("errors"), record.alias("record"))
    lone = orphans.select("conv_id", "call_id", F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("bigint").alias("position"), F.col("turn").alias("result_turn"), F.lit("orphan").alias("status"), "errors", F.to_json(F.struct(F.lit(None).cast("string").alias("arguments"), F.col("call_id").alias("id"), F.lit(None).cast("string").alias("name"), F.col("content").alias("result")), {"ignoreNullFields": "false"}).alias("record"))
    return out.unionByName(lone)


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain chats (conv_id, turn, role, text), whose turns carry no tool calls of their own.

    A user turn calls the tool ``answer``, a system turn ``instruct``; an
    assistant turn is the result of the turn before it. A call depends on the one
    two turns before. So that every case occurs, every seventh conversation (from
    3 on) lists its calls in reverse, each depending on the one two turns later,
    and every eleventh (from 5 on) on both, which is a cycle; the arguments of
    every tenth are cut off (from 7 on), have a turn that is no integer (8), or a
    surplus key and a turn written as a fraction or with an exponent (9).
    """
    asks = F.col("role").isin("user", "system")
    conv, named = F.col("conv_id"), lambda shift: F.concat_ws("-", F.lit("call"), F.col("conv_id"), F.col("turn") + shift)
    plain = F.to_json(F.struct(F.col("turn").alias("turn"), F.col("text").alias("prompt"), F.when(F.col("role") == "user", F.when(F.length("text") > 200, "long").otherwise("short")).alias("style")))
    spelt = lambda number, more="": F.concat(F.lit('{"turn":'), number, F.lit(more), F.lit(","), F.substring(F.regexp_replace(plain, '^\\{"turn":-?[0-9]+,?', "{"), 2, 1 << 30))
    arguments = (
        F.when(conv % 10 == 7, F.expr("substring(x, 1, length(x) - 1)"))
        .when(F.col("text").isNull() | F.col("turn").isNull(), F.col("x"))
        .when(conv % 10 == 8, spelt(F.concat("turn", F.lit(".5"))))
        .when(conv % 10 == 9, spelt(F.concat("turn", F.when(F.col("turn") % 4 == 0, ".0").otherwise("e0")), ',"note":1.50'))
        .otherwise(F.col("x"))
    )
    before, after = F.when(F.col("turn") >= 2, named(-2)), named(2)
    needs = F.when(conv % 11 == 5, F.array(before, after)).when(conv % 7 == 3, F.array(after)).otherwise(F.array(before))
    needs = F.filter(needs, lambda n: n.isNotNull() & F.col("turn").isNotNull())
    calls = turns.filter(asks).withColumn("x", plain).select(conv.cast("bigint"), F.col("turn").cast("bigint"), named(0).alias("call_id"), F.when(F.col("role") == "user", "answer").otherwise("instruct").alias("name"), arguments.alias("arguments"), needs.alias("depends_on"))
    results = turns.filter(F.col("role") == "assistant").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.concat_ws("-", F.lit("call"), F.col("conv_id"), F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


ORACLE = """
WITH RECURSIVE c AS (
    SELECT conv_id, turn, 'call-' || conv_id || '-' || turn AS call_id, CASE role WHEN 'user' THEN 'answer' ELSE 'instruct' END AS name, role, text FROM conversations WHERE role IN ('user', 'system')
), r AS (
    SELECT conv_id, turn AS result_turn, 'call-' || conv_id || '-' || (turn - 1) AS call_id, text AS content, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text NULLS LAST) AS nth FROM conversations WHERE role = 'assistant'
), node AS (
    SELECT conv_id, turn, call_id, count(*) OVER (PARTITION BY conv_id) AS n FROM (SELECT DISTINCT conv_id, turn, call_id FROM c)
), edge AS (
    SELECT a.conv_id, a.turn, b.turn AS need FROM node a JOIN node b ON a.conv_id = b.conv_id
    WHERE (b.turn = a.turn - 2 AND (a.conv_id % 11 = 5 OR a.conv_id % 7 <> 3)) OR (b.turn = a.turn + 2 AND (a.conv_id % 11 = 5 OR a.conv_id % 7 = 3))
), walk AS (
    SELECT conv_id, turn, turn AS place, 0 AS hops, n FROM node
    UNION SELECT w.conv_id, w.turn, e.need, w.hops + 1, w.n FROM walk w JOIN edge e ON e.conv_id = w.conv_id AND e.turn = w.place WHERE w.hops <= w.n
), p AS (
    SELECT conv_id, turn, CASE WHEN max(hops) < any_value(n) THEN max(place + hops) END AS position FROM walk GROUP BY conv_id, turn
), e AS (
    SELECT *, conv_id % 10 = 7 AS cut, conv_id % 10 = 8 AND text IS NOT NULL AS half, conv_id % 10 = 9 AND text IS NOT NULL AS noted,
        array_to_string(CASE WHEN conv_id % 10 = 7 THEN ['arguments: no JSON object'] ELSE list_sort(list_filter([
            CASE WHEN conv_id % 10 = 9 AND text IS NOT NULL THEN 'note: unexpected' END, CASE WHEN length(text) = 0 THEN 'prompt: min_length' END,
            CASE WHEN length(text) > 400 AND role = 'user' THEN 'prompt: max_length' END, CASE WHEN text IS NULL THEN 'prompt: missing' END,
            CASE WHEN conv_id % 10 = 8 AND text IS NOT NULL THEN 'turn: not integer' END], lambda x: x IS NOT NULL)) END, '; ') AS errors FROM c
)
SELECT e.conv_id, e.call_id, e.turn, e.name, p.position, r.result_turn,
    CASE WHEN p.position IS NULL THEN 'cycle' WHEN r.call_id IS NULL THEN 'unlinked' WHEN errors <> '' THEN 'invalid' ELSE 'ok' END AS status, errors,
    '{"arguments":' || CASE WHEN cut THEN 'null' ELSE '{' || CASE WHEN noted THEN '"note":1.5,' ELSE '' END || coalesce('"prompt":' || CAST(to_json(text) AS VARCHAR) || ',', '')
        || CASE WHEN role = 'user' THEN '"style":"' || CASE WHEN length(text) > 200 THEN 'long' ELSE 'short' END || '",' ELSE '' END || '"turn":' || e.turn || CASE WHEN half THEN '.5' ELSE '' END || '}' END
        || ',"id":"' || e.call_id || '","name":"' || e.name || '","result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' AS record
FROM e JOIN p USING (conv_id, turn) LEFT JOIN r ON r.conv_id = e.conv_id AND r.call_id = e.call_id AND r.nth = 1
UNION ALL
SELECT r.conv_id, r.call_id, NULL, NULL, NULL, r.result_turn, 'orphan', CASE WHEN c.call_id IS NULL THEN '' ELSE 'result: duplicate' END, '{"arguments":null,"id":"' || r.call_id || '","name":null,"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}'
FROM r LEFT JOIN (SELECT DISTINCT conv_id, call_id FROM c) c ON c.conv_id = r.conv_id AND c.call_id = r.call_id WHERE c.call_id IS NULL OR r.nth > 1
"""
