"""Screening and parsing of text columns: questions, SQL, code and model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions.messages import REASONS
from quillframe.operators.charts import KINDS

# Keyword sets, patterns and limits.
INTENTS = {
    "trend": ["trend", "over time", "monthly", "daily", "weekly"],
    "comparison": ["compare", "vs", "versus", "difference"],
    "distribution": ["distribution", "spread", "histogram"],
    "ranking": ["top", "bottom", "highest", "lowest", "rank"],
    "correlation": ["correlation", "relationship", "impact"],
    "aggregation": ["sum", "total", "count", "average", "mean"],
}
MAX_QUESTION = 1000
MAX_SQL = 5000
MAX_CODE = 10_000
PROMPT_INJECTION = (
    r"(?i)(ignore\s+(previous|prior|above|all)\s+instructions?|forget\s+(everything|your|all)|you\s+are\s+now"
    r"|new\s+persona|act\s+as\s+if|disregard\s+(your|all)|system\s*:\s*you)"
)
FORBIDDEN_SQL = r"(?i)\b(DROP|DELETE|TRUNCATE|ALTER|INSERT|UPDATE|EXEC|EXECUTE|GRANT|REVOKE|SHUTDOWN|xp_|sp_)\b"
DANGEROUS_CODE = (
    r"(?i)(import\s+os|import\s+sys|import\s+subprocess|__import__|eval\s*\(|exec\s*\(|open\s*\(|__builtins__"
    r"|shutil|socket|requests\.get|urllib)"
)
FENCE = r"```(?:json)?\s*([\s\S]+?)\s*```"
LINE_COMMENT = r"(?m)//.*$"
INSIGHT_KEYS = ("category", "title", "description")
CHART_KEYS = ("chart", "title")

BLANK = r"^\s*$"


def detect_intent(question: Column) -> Column:
    """The first intent one of whose keywords occurs in the question, else ``general``."""
    lowered = F.lower(question)
    found = F.lit("general")
    for intent, words in reversed(INTENTS.items()):
        found = F.when(lowered.rlike("|".join(words)), intent).otherwise(found)
    return found


def _verdict(*rules: tuple[Column, str]) -> Column:
    """The reason of the first rule that holds; empty if none does."""
    reason = F.lit("")
    for test, why in reversed(rules):
        reason = F.when(test, F.lit(why)).otherwise(reason)
    return reason


def _screen(df: DataFrame, reason: Column) -> DataFrame:
    return df.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "")


def screen_questions(df: DataFrame, column: str) -> DataFrame:
    """Adds ``accepted`` and ``reason``: empty, too long, or a prompt-injection pattern."""
    q = F.col(column)
    return _screen(df, _verdict(
        (q.isNull() | q.rlike(BLANK), REASONS["question_empty"]),
        (F.length(q) > MAX_QUESTION, REASONS["question_long"].format(limit=MAX_QUESTION)),
        (q.rlike(PROMPT_INJECTION), REASONS["question_pattern"])))


def screen_sql(df: DataFrame, column: str) -> DataFrame:
    q = F.col(column)
    return _screen(df, _verdict(
        (q.rlike(FORBIDDEN_SQL), REASONS["sql_statement"]),
        (F.length(q) > MAX_SQL, REASONS["sql_long"].format(limit=MAX_SQL))))


def screen_code(df: DataFrame, column: str) -> DataFrame:
    code = F.col(column)
    return _screen(df, _verdict(
        (code.isNull() | code.rlike(BLANK), REASONS["code_empty"]),
        (code.rlike(DANGEROUS_CODE), REASONS["code_operation"]),
        (~code.contains("result_df"), REASONS["code_result"]),
        (F.length(code) > MAX_CODE, REASONS["code_long"])))


# --- JSON in free text ----------------------------------------------------------------


def _last(text: Column, mark: str) -> Column:
    """1-based place of the last ``mark``; 0 if absent."""
    from_end = F.instr(F.reverse(text), mark)
    return F.when(from_end > 0, F.length(text) - from_end + 1).otherwise(0)


def extract_json(df: DataFrame, column: str, out: str = "json") -> DataFrame:
    """Adds the JSON text found in ``column`` (null if none parses) and ``parseable``.

    A fenced block wins over the whole text; the text is cut from the first brace (or bracket)
    to the last; a second attempt drops ``//`` comments.
    """
    fenced = F.regexp_extract(F.col(column), FENCE, 1)
    step = df.withColumn("_t", F.when(F.length(fenced) > 0, fenced).otherwise(F.col(column)))
    start = F.when(F.instr("_t", "{") > 0, F.instr("_t", "{")).otherwise(F.instr("_t", "["))
    step = step.withColumn("_t", F.when(start > 0, F.substring("_t", start, F.length("_t"))))
    brace, bracket = _last(F.col("_t"), "}"), _last(F.col("_t"), "]")
    end = F.when(brace > 0, brace).when(bracket > 0, bracket).otherwise(F.length("_t"))
    step = step.withColumn("_t", F.substring("_t", F.lit(1), end))
    bare = F.regexp_replace("_t", LINE_COMMENT, "")
    found = F.when(F.try_parse_json("_t").isNotNull(), F.col("_t")).when(F.try_parse_json(bare).isNotNull(), bare)
    return step.withColumn(out, found).withColumn("parseable", F.col(out).isNotNull()).drop("_t")


def validate_insights(df: DataFrame, column: str) -> DataFrame:
    """Adds ``reason``/``accepted`` for JSON text that must hold a list of complete insights."""
    keys = F.json_object_keys(column)
    held = F.try_variant_get(F.try_parse_json(column), "$.insights", "variant")
    items = F.from_json(F.get_json_object(column, "$.insights"), "array<string>")  # each item as JSON text
    missing = F.flatten(F.transform(items, lambda item, i: F.filter(
        F.array(*[F.when(~F.coalesce(F.array_contains(F.json_object_keys(item), k), F.lit(False)),
                         F.format_string(f"Insight [%d] missing required key '{k}'.", i)) for k in INSIGHT_KEYS]),
        lambda s: s.isNotNull())))
    reason = (
        F.when(F.col(column).isNull(), REASONS["json_invalid"])
        .when(keys.isNull() | ~F.array_contains(keys, "insights"), REASONS["insights_missing"])
        .when(held.isNull() | ~F.schema_of_variant(held).startswith("ARRAY"), REASONS["insights_list"])
        .otherwise(F.coalesce(F.try_element_at(missing, F.lit(1)), F.lit("")))
    )
    return _screen(df, reason)


def validate_chart_spec(df: DataFrame, column: str) -> DataFrame:
    """Adds ``reason``/``accepted`` for JSON text that must name a chart kind and a title."""
    keys = F.json_object_keys(column)
    missing = F.array_compact(F.array(*[F.when(~F.array_contains(keys, k), F.lit(f"'{k}'")) for k in CHART_KEYS]))
    chart = F.get_json_object(column, "$.chart")
    reason = (
        F.when(F.col(column).isNull() | keys.isNull(), REASONS["json_invalid"])
        .when(F.size(missing) > 0, F.concat(F.lit("Chart output missing keys: {"), F.array_join(missing, ", "), F.lit("}")))
        .when(chart.isNull() | ~chart.isin(*KINDS), F.concat(F.lit("Invalid chart type '"), F.coalesce(chart, F.lit("None")), F.lit("' in LLM output.")))
        .otherwise("")
    )
    return _screen(df, reason)
