"""Tolerant parsing of model answers with expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import compute_once, extract_or_null, strip_ws

# Patterns, key words and the cut of the prose fallback.
CONFIDENCE = r"confidence[:\s]+(?:level\s+)?(?:of\s+)?(?:\()?(0\.\d+)"
ROOT_CAUSE = r"root\s*cause[:\s]+(.+?)(?:\n|$)"
REASONING_CUT = 500
UNKNOWN = "UNKNOWN"


def json_candidates(text: Column) -> list[Column]:
    """Places a JSON answer may sit, in order: a json fence, any fence, the outermost braces."""
    tagged, fence = "```json", "```"
    in_tagged = F.when(
        F.contains(text, F.lit(tagged)), F.get(F.split(F.get(F.split(text, tagged), F.lit(1)), fence), F.lit(0))
    )
    in_fence = F.when(F.contains(text, F.lit(fence)), F.get(F.split(text, fence), F.lit(1)))
    first = F.instr(text, "{")
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    outer = F.when((first > 0) & F.contains(text, F.lit("}")) & (last >= first), F.substr(text, first, last - first + 1))
    return [strip_ws(in_tagged), strip_ws(in_fence), outer]


def keyword_verdict(text: Column) -> Column:
    """Classification from prose. With both words present the one nearer behind "classify" /
    "classification" counts, and without such a cue the session is an anomaly."""
    upper = F.upper(text)
    has_anomaly, has_normal = F.contains(upper, F.lit("ANOMALY")), F.contains(upper, F.lit("NORMAL"))
    cue = F.greatest(F.instr(upper, "CLASSIFY"), F.instr(upper, "CLASSIFICATION"))
    behind = F.substr(upper, F.greatest(cue, F.lit(1)))
    anomaly_at, normal_at = F.instr(behind, "ANOMALY"), F.instr(behind, "NORMAL")
    after_cue = F.when((anomaly_at > 0) & ((normal_at == 0) | (anomaly_at < normal_at)), "ANOMALY").otherwise("NORMAL")
    return (
        F.when(has_anomaly & has_normal, F.when(cue > 0, after_cue).otherwise("ANOMALY"))
        .when(has_anomaly, "ANOMALY")
        .when(has_normal, "NORMAL")
    )


def parse_answers(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add source ('json', 'text' or 'none'), classification, confidence, root_cause, reasoning and the
    parsed document as VARIANT (NULL for prose)."""
    rows = df.withColumn("_t", strip_ws(F.coalesce(F.col(raw), F.lit(""))))
    document = F.coalesce(*[F.try_parse_json(c) for c in json_candidates(F.col("_t"))])
    found = {
        "classification": keyword_verdict(F.col("_t")),
        "confidence": extract_or_null(F.lower("_t"), "(?dU)" + CONFIDENCE).try_cast("double"),
        "root_cause": strip_ws(extract_or_null(F.col("_t"), "(?idU)" + ROOT_CAUSE)),
    }
    # Prose is only looked at where no JSON was found.
    rows = compute_once(rows, "document", document)
    prose = F.when(F.col("document").isNull(), F.struct(*[c.alias(name) for name, c in found.items()]))
    rows = compute_once(rows, "_prose", prose)
    rows = rows.select("*", *[F.col(f"_prose.{name}").alias(f"_{name}") for name in found])
    is_json = F.col("document").isNotNull()
    any_hit = F.coalesce(*[F.col(f"_{n}").cast("string") for n in found]).isNotNull()
    field = lambda n, t: F.try_variant_get("document", f"$.{n}", t)
    return rows.select(
        *df.columns,
        F.when(is_json, "json").when(any_hit, "text").otherwise("none").alias("source"),
        F.when(is_json, field("classification", "string")).when(any_hit, F.col("_classification")).otherwise(UNKNOWN).alias("classification"),
        F.when(is_json, field("confidence", "double")).otherwise(F.col("_confidence")).alias("confidence"),
        F.when(is_json, field("root_cause", "string")).otherwise(F.col("_root_cause")).alias("root_cause"),
        F.when(is_json, field("reasoning", "string")).when(any_hit, F.substring("_t", 1, REASONING_CUT)).alias("reasoning"),
        "document",
    )


def verdict(classification: str = "classification") -> Column:
    """1 for ANOMALY in any case, else 0 (also when missing)."""
    return F.coalesce(F.upper(classification) == "ANOMALY", F.lit(False)).cast("int")
