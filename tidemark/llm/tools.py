"""Tool-call linking, with DataFrame functions alone.

Calls are joined with their results by identifier, put in topological order by the calls that they
depend on, checked against the schemas of their tools, and written as canonical JSON (sorted keys, no
white space).

The order comes in rounds: a call whose dependencies all have a level gets the next one; rounds end when no
call is added. (level, turn, call_id) is a topological order of a conversation. What is left
depends on itself and gets the status ``cycle``.

Edge cases: rows without an identifier can't be linked: a call keeps the status ``no_id`` and a result is
left out. Of repeated calls with one identifier in a conversation the least (turn, name, arguments) counts,
of repeated results the least content. A dependency on a call that doesn't exist gives ``unresolved``, a
missing result ``missing_result``. Null or malformed arguments are an error (``arguments:malformed``) and
the record is written without them, as it is without a result, level or name that is null. A whole number is an integer however it
is written (1.0 is written as 1). ``link`` has one row a call, so results that it leaves out (without an identifier, without a call,
or repeated) have none there: ``orphans`` returns them with a status. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

KEY = ["conv_id", "call_id"]
#: Variant type names that each JSON type of a schema takes.
TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"]}


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """conv_id, call_id, level (from 0) of every call that can be ordered. edges: conv_id, call_id, dep_id."""
    pending = calls.select(*KEY)
    edges = cut_lineage(edges.select(*KEY, "dep_id").distinct())
    done, level = None, 0
    while True:
        free = pending.join(edges, KEY, "left_anti").withColumn("level", F.lit(level))
        fresh = cut_lineage(free)
        if fresh.isEmpty():
            return done if done is not None else fresh
        done = fresh if done is None else done.unionByName(fresh)
        pending = pending.join(fresh.select(*KEY), KEY, "left_anti")
        if edges.isEmpty():
            return done
        gone = fresh.select("conv_id", F.col("call_id").alias("dep_id"))
        # only calls that still wait for another one stay pending
        pending = edges.select(*KEY).distinct()
        edges = cut_lineage(edges.join(gone, ["conv_id", "dep_id"], "left_anti"))
        level += 1


def validate(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Errors of a call's arguments. schemas: tool to {field: (JSON type, required)}."""
    parsed = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    cases = F.when(parsed.isNull() | keys.isNull(), F.array(F.lit("arguments:malformed")))
    for tool, fields in sorted(schemas.items()):
        errors = []
        for field, (kind, required) in sorted(fields.items()):
            value = F.try_variant_get(parsed, f"$['{field}']", "variant")
            kind_of = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
            absent = value.isNull()
            fits = kind_of.isin(TYPES[kind])
            if kind == "integer":  # a whole number in any notation
                number = F.try_variant_get(parsed, f"$['{field}']", "double")
                fits = fits | (kind_of.isin(TYPES["number"]) & (number % 1 == 0))
            wrong = ~absent & ~fits
            errors += [F.when(absent & F.lit(required), F.lit(f"{field}:missing")), F.when(wrong, F.lit(f"{field}:type"))]
        known = F.array(*(F.lit(f) for f in sorted(fields))) if fields else F.array().cast("array<string>")
        extra = F.transform(F.sort_array(F.array_except(keys, known)), lambda k: F.concat(k, F.lit(":unknown")))
        cases = cases.when(name == tool, F.concat(F.filter(F.array(*errors), lambda e: e.isNotNull()) if errors else F.array().cast("array<string>"), extra))
    return cases.otherwise(F.array(F.lit("name:unknown")))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """One row a call: conv_id, turn, call_id, level, status, errors, json.

    calls: conv_id, turn, call_id, name, arguments (JSON text), depends_on (array of call ids);
    results: conv_id, call_id, content.
    """
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", "depends_on")
    nameless = calls.filter(F.col("conv_id").isNull() | F.col("call_id").isNull())
    named = calls.filter(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    named = cut_lineage(named.groupBy(*KEY).agg(F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("c")).select(*KEY, "c.*"))
    answers = results.filter(F.col("call_id").isNotNull()).groupBy(*KEY).agg(F.min("content").alias("content"), F.count("*").alias("found"))
    wanted = named.select(*KEY, F.explode("depends_on").alias("dep_id")).filter(F.col("dep_id").isNotNull())
    there = named.select("conv_id", F.col("call_id").alias("dep_id"))
    edges = wanted.join(there, ["conv_id", "dep_id"])
    lost = wanted.join(there, ["conv_id", "dep_id"], "left_anti").select(*KEY).distinct().withColumn("lost", F.lit(True))
    whole = named.join(answers, KEY, "left").join(levels(named, edges), KEY, "left").join(lost, KEY, "left")
    status = F.when(F.col("level").isNull(), "cycle").when(F.col("lost"), "unresolved").when(F.col("found").isNull(), "missing_result").otherwise("ok")
    rows = whole.withColumn("status", status).unionByName(nameless.withColumn("status", F.lit("no_id")), allowMissingColumns=True)
    rows = rows.withColumn("errors", validate(F.col("name"), F.col("arguments"), schemas))
    # names in the order of their letters
    record = F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), "level", "name", F.col("content").alias("result"), "status")
    return rows.select("conv_id", "turn", "call_id", "level", "status", "errors", F.to_json(record).alias("json"))


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results that ``link`` leaves out, one row each: conv_id, call_id, content, status.

    The status is ``no_id`` without an identifier, ``missing_call`` without a call, and ``surplus_result`` for
    each but the least content of a call's results.
    """
    keyed = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    there = calls.filter(keyed).select(*KEY).distinct().withColumn("there", F.lit(True))
    # equal results are counted, so that no group of them is gathered or sorted
    counts = results.groupBy(*KEY, "content").agg(F.count("*").alias("n"))
    least = results.filter(keyed).groupBy(*KEY).agg(F.min("content").alias("least"))
    rows = counts.join(there, KEY, "left").join(least, KEY, "left")
    used = F.when(keyed & F.col("there") & F.col("content").eqNullSafe(F.col("least")), 1).otherwise(0)
    status = F.when(~keyed, "no_id").when(F.col("there").isNull(), "missing_call").otherwise("surplus_result")
    rows = rows.withColumn("left", F.col("n") - used).filter("left > 0").withColumn("status", status)
    return rows.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("left")))).select(*KEY, "content", "status")
