"""Tool calls of conversations: linked to their results, ordered, checked against schemas, written as canonical JSON.

Calls and results meet in an equality join on (conversation, call id). A call may name one call whose result it waits
for; its `depth` is the number of calls that must come before it, found by pointer jumping, so calls ordered by depth,
then turn, are in a valid order however long a chain is. Arguments are parsed as variants and checked natively against
the tool's parameters. All of it is DataFrame code, and no conversation is gathered in one task.

Status of a call: `duplicate` (an earlier call has its id), `cyclic` (it waits for itself, through others or not),
`invalid` (unknown tool, arguments that are no JSON object, or errors), `unanswered` (no result), else `ok`. A call that
waits for one that does not exist has an error and counts as a first one. Results without a call have status `orphan`,
those after the first of a call `extra`. Rows with a null conversation or id are not linked. Rows come out once each.
Canonical JSON has sorted keys at every depth, no blanks, and no null fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadgrid.llm import skew
from leadgrid.sources.storage import stored

#: a tool's parameters as (name, type, required); types are those of JSON
TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY<", "object": "^OBJECT<"}


def argument_errors(tools: dict[str, list[tuple[str, str, bool]]], name: Column, arguments: Column) -> Column:
    """What is wrong with a call's parsed arguments, as a sorted array of strings."""
    kind = F.schema_of_variant(arguments)
    errors = [F.when(arguments.isNull() | ~kind.startswith("OBJECT"), F.lit("arguments: not an object"))]
    known = name.isin(*tools) if tools else F.lit(False)
    errors.append(F.when(~F.coalesce(known, F.lit(False)), F.lit("name: unknown tool")))
    for tool, parameters in sorted(tools.items()):
        for parameter, wanted, required in sorted(parameters):
            value = F.try_variant_get(arguments, f"$.{parameter}", "variant")
            here = (name == tool) & kind.startswith("OBJECT")
            absent = value.isNull() | F.is_variant_null(value)
            if required:
                errors.append(F.when(here & absent, F.lit(f"{parameter}: missing")))
            wrong = here & ~absent & ~F.schema_of_variant(value).rlike(TYPES[wanted])
            errors.append(F.when(wrong, F.lit(f"{parameter}: not of type {wanted}")))
    return F.array_sort(F.array_compact(F.array(*errors)))


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, id, depth, root) of (conv_id, id, after), ids being unique; depth is null for calls that wait for
    themselves. `after` that does not exist counts as none."""
    exists = calls.select("conv_id", F.col("id").alias("after"), F.lit(True).alias("there"))
    steps = calls.join(exists, ["conv_id", "after"], "left").select(
        "conv_id", "id", F.when(F.col("there"), F.col("after")).alias("up"), F.col("there").isNotNull().cast("long").alias("hops")
    )
    steps = stored(steps, "calls-depth")
    # pointers double their reach each round, so those that still have one after as many rounds as ids have bits go round
    for _ in range(max(steps.count(), 1).bit_length() + 1):
        if steps.filter("up is not null").isEmpty():
            break
        ends = steps.select("conv_id", F.col("id").alias("up"), F.col("up").alias("further"), F.col("hops").alias("more"))
        steps = stored(
            steps.join(ends, ["conv_id", "up"], "left").select(
                "conv_id", "id", F.col("further").alias("up"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")
            ),
            "calls-depth",
        )
    return steps.select("conv_id", "id", F.when(F.col("up").isNull(), F.col("hops")).alias("depth"))


def link(calls: DataFrame, results: DataFrame, tools: dict[str, list[tuple[str, str, bool]]]) -> DataFrame:
    """One row for each call and for each result that no call takes: (conv_id, id, turn, kind, status, depth,
    result_turn, errors, json).

    `calls`: (conv_id, turn, id, name, arguments, after); `results`: (conv_id, turn, id, content).
    """
    key = ["conv_id", "id"]

    def firsts(rows: DataFrame, what: str) -> DataFrame:
        """Whether a row is the first of its id, by turn."""
        rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), what)
        first = rows.filter("conv_id is not null and id is not null").groupBy(*key).agg(
            F.min(F.struct("turn", "row")).alias("first"), F.count(F.lit(1)).alias("size")
        )
        joined = skew.join_groups(rows, stored(first, what), key, "size", how="left")
        return stored(joined.withColumn("is_first", F.coalesce(F.col("first.row") == F.col("row"), F.lit(False))).drop("first", "size", "row"), what)

    calls = firsts(calls.select(*key, "turn", "name", "arguments", "after"), "calls")
    results = firsts(results.select(*key, "turn", "content"), "results")
    linkable = F.col("conv_id").isNotNull() & F.col("id").isNotNull()
    depth = depths(calls.filter("is_first").select(*key, "after")).withColumn("is_first", F.lit(True))
    first_results = results.filter("is_first").select(*key, "is_first", F.col("turn").alias("result_turn"), "content")
    told = calls.select(*key, F.lit(True).alias("there")).filter(linkable).distinct()
    parsed = F.try_parse_json("arguments")
    names = calls.filter("is_first").select("conv_id", F.col("id").alias("after"), F.lit(True).alias("after_there"))
    rows = calls.join(depth, [*key, "is_first"], "left").join(first_results, [*key, "is_first"], "left").join(names, ["conv_id", "after"], "left")
    rows = rows.withColumn("parsed", parsed)
    lost = F.when(F.col("after").isNotNull() & F.col("after_there").isNull(), F.array(F.lit("after: no such call"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("errors", F.array_sort(F.concat(argument_errors(tools, F.col("name"), F.col("parsed")), lost)))
    status = (
        F.when(linkable & ~F.col("is_first"), "duplicate")
        .when(linkable & F.col("depth").isNull(), "cyclic")
        .when(F.size("errors") > 0, "invalid")
        .when(F.col("result_turn").isNull(), "unanswered")
        .otherwise("ok")
    )
    rows = rows.withColumn("status", status).withColumn("kind", F.lit("call"))
    call_rows = rows.select(
        *key, "turn", "kind", "status", "depth", "result_turn", F.concat_ws("; ", "errors").alias("errors"),
        F.to_json(F.struct("after", F.col("parsed").alias("arguments"), "conv_id", "depth", "id", "name", F.col("content").alias("result"), "status", "turn")).alias("json"),
    )
    loose = results.join(told, key, "left").filter(~F.col("is_first") | F.col("there").isNull())
    result_rows = loose.select(
        *key, "turn", F.lit("result").alias("kind"), F.when(F.col("there").isNull(), "orphan").otherwise("extra").alias("status")
    , "content")
    result_rows = result_rows.select(
        *key, "turn", "kind", "status", F.lit(None).cast("long").alias("depth"), F.lit(None).cast("long").alias("result_turn"),
        F.lit("").alias("errors"), F.to_json(F.struct("conv_id", "id", F.col("content").alias("result"), "status", "turn")).alias("json"),
    )
    return call_rows.unionByName(result_rows)


# Stand-ins: the conversations at hand hold no calls.
TOOLS = {
    "count": [("text", "string", True), ("limit", "integer", False)],
    "search": [("text", "string", True), ("limit", "integer", True)],
}


def stand_ins(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results made from turns: a turn that the assistant did not write is a call that waits for the one two
    turns before, and the assistant's turn is the result of the call one turn before. Some arguments break the schema."""
    turn, limit = F.col("turn").cast("long"), F.length("text").cast("string")
    name = F.when(turn % 7 == 6, "note").when(turn % 2 == 0, "search").otherwise("count")
    shown = F.when(turn % 5 == 4, F.concat(F.lit('"'), limit, F.lit('"'))).otherwise(limit)
    quoted = F.expr("substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)")
    arguments = F.concat(F.lit('{ "text" : '), quoted, F.lit(', "limit" : '), shown, F.lit(" }"))
    rows = conversations.select(F.col("conv_id").cast("long"), turn.alias("turn"), "role", F.col("text").cast("string"))
    calls = rows.filter(~F.coalesce(F.col("role") == "assistant", F.lit(False))).select(
        "conv_id", "turn", F.concat(F.lit("c"), turn).alias("id"), name.alias("name"), arguments.alias("arguments"),
        F.when(turn >= 2, F.concat(F.lit("c"), turn - 2)).alias("after"),
    )
    results = rows.filter("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("c"), turn - 1).alias("id"), F.col("text").alias("content"))
    return calls, results
