"""Tool-call linking: calls and results joined by identifier, ordered, validated and written as canonical JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.session import write_out

#: What ``schema_of_variant`` calls the values that a parameter type accepts.
ACCEPTED = {
    "string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$",
    "object": "^OBJECT.*$", "array": "^ARRAY.*$",
}


#: A string or a number in JSON text.
TOKEN = r'"(?:[^"\\]++|\\.)*+"|-?\d[\d.eE+-]*'


def depths(calls: DataFrame) -> DataFrame:
    """(call_id, depth, cyclic) for ``calls`` (call_id, after): how many calls must come before each.

    ``after`` names the call whose result this one needs; null or an unknown name needs none. Every
    round doubles the distance that is known, so that a chain of n calls takes log2(n) rounds. Calls that never
    reach a start are on, or behind, a cycle; their depth is null.
    """
    known = calls.select(F.col("call_id").alias("after"), F.lit(True).alias("found"))
    up = calls.select("call_id", "after").join(known, "after", "left")
    up = up.select("call_id", F.when(F.col("found"), F.col("after")).alias("up"))
    state = write_out(up.withColumn("depth", F.col("up").isNotNull().cast("bigint")), "call-depths")
    settled, open_ = [state.filter(F.col("up").isNull())], state.filter(F.col("up").isNotNull())
    rounds = state.count().bit_length() + 1
    for _ in range(rounds):
        if open_.isEmpty():
            break
        every = reduce(DataFrame.unionByName, settled).unionByName(open_)
        beyond = every.select(F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        state = write_out(open_.join(beyond, "up").select(
            "call_id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth")), "call-depths")
        settled.append(state.filter(F.col("up").isNull()))  # these take part in no further round
        open_ = state.filter(F.col("up").isNotNull())
    every = reduce(DataFrame.unionByName, settled).unionByName(open_)
    cyclic = F.col("up").isNotNull()
    return every.select("call_id", F.when(~cyclic, F.col("depth")).alias("depth"), cyclic.alias("cyclic"))


def canonical_numbers(text: Column) -> Column:
    """JSON text with each number in one form: whole ones below 1e18 as digits, others as the shortest that gives the same double."""
    def form(token: Column) -> Column:
        value = token.try_cast("double")
        whole = (value == F.rint(value)) & (F.abs(value) < 1e18)
        return F.when(token.startswith('"') | token.rlike(r"^(0|-?[1-9]\d*)$"), token).when(
            whole, value.cast("bigint").cast("string")).otherwise(F.coalesce(value.cast("string"), token))

    tokens = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), form)
    return F.array_join(F.zip_with(F.split(text, TOKEN), tokens, lambda gap, t: F.concat(gap, F.coalesce(t, F.lit("")))), "")


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(call_id, errors): sorted messages for ``calls`` (call_id, name, args variant); calls without errors are left out.

    ``schemas`` (name, param, type, required) has one row per parameter. Unknown tools, arguments that
    are no JSON object, unknown or missing parameters and values of another type are errors.
    """
    tools = schemas.select("name").distinct().withColumn("tool", F.lit(True))
    whole = calls.join(tools, "name", "left")
    is_object = F.coalesce(F.schema_of_variant("args").startswith("OBJECT"), F.lit(False))
    flaw = F.when(F.col("tool").isNull(), "unknown tool").when(~is_object, "arguments are not an object")
    flaws = whole.select("call_id", flaw.alias("error")).filter(F.col("error").isNotNull())
    sound = whole.filter(F.col("tool").isNotNull() & is_object).select("call_id", "name", "args")
    given = sound.lateralJoin(calls.sparkSession.tvf.variant_explode(F.col("args").outer())).select(
        "call_id", "name", F.col("key").alias("param"), F.schema_of_variant("value").alias("kind"))
    wanted = schemas.select("name", "param", "type", "required")
    checked = given.join(wanted, ["name", "param"], "left")
    pattern = F.create_map(*[F.lit(x) for pair in ACCEPTED.items() for x in pair])[F.col("type")]
    odd = F.when(F.col("type").isNull(), F.concat(F.lit("unknown parameter "), "param")).when(
        ~F.expr("regexp_like(kind, pattern)"), F.concat(F.lit("not of type "), "type", F.lit(": "), "param"))
    odd = checked.withColumn("pattern", pattern).select("call_id", odd.alias("error")).filter(F.col("error").isNotNull())
    needed = sound.select("call_id", "name").join(wanted.filter("required"), "name")
    absent = needed.join(given.select("call_id", "param"), ["call_id", "param"], "left_anti")
    absent = absent.select("call_id", F.concat(F.lit("missing parameter "), "param").alias("error"))
    errors = flaws.unionByName(odd).unionByName(absent)
    return errors.groupBy("call_id").agg(F.array_sort(F.collect_list("error")).alias("errors"))  # bounded by the arguments


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call identifier in ``calls`` (conv_id, turn, call_id, name, arguments, after) or ``results``
    (conv_id, turn, call_id, content).

    conv_id, call_id, name, status (linked, unanswered, orphan), n_calls, n_results, depth, cyclic, errors and
    ``record``: canonical JSON with sorted keys and no blanks. Sorting by (conv_id, depth, turn) puts every call behind what it needs.
    An identifier that repeats is one call: its smallest (turn, name, arguments) counts, and n_calls says how many
    there were; results likewise. Rows without an identifier are left out. Arguments that are no JSON
    appear as null in the record. Arguments and contents are kept whole, however long. Other columns are ignored,
    whatever their names. Empty tables give what the other table has, or nothing.
    """
    first_call = F.struct("turn", "conv_id", "name", "arguments", "after")
    asked = calls.filter(F.col("call_id").isNotNull()).groupBy("call_id").agg(
        F.min(first_call).alias("c"), F.count("*").alias("n_calls"))
    asked = write_out(asked.select("call_id", "n_calls", "c.*"), "calls")
    answers = results.filter(F.col("call_id").isNotNull()).groupBy("call_id").agg(
        F.min(F.struct("turn", "conv_id", "content")).alias("r"), F.count("*").alias("n_results"))
    answers = answers.select("call_id", "n_results", "r")
    errors = argument_errors(asked.select("call_id", "name", F.try_parse_json("arguments").alias("args")), schemas)
    asked = asked.join(depths(asked), "call_id").join(errors, "call_id", "left")
    asked = asked.withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))
    joined = asked.hint("shuffle_hash").join(answers.hint("shuffle_hash"), "call_id", "full_outer")
    status = F.when(F.col("n_calls").isNull(), "orphan").when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    joined = joined.withColumn("status", status).withColumn("args", F.try_parse_json("arguments"))
    record = F.to_json(F.struct(
        F.col("args").alias("arguments"), F.col("call_id").alias("call_id"), F.col("errors").alias("errors"), F.col("name").alias("name"),
        F.col("r.content").alias("result"), F.col("status").alias("status")), {"ignoreNullFields": "false"})
    return joined.select(
        F.coalesce("conv_id", "r.conv_id").alias("conv_id"), F.coalesce("turn", "r.turn").alias("turn"), "call_id", "name", "status",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        "depth", F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
        F.coalesce(F.size("errors"), F.lit(0)).alias("n_errors"), canonical_numbers(record).alias("record"))
