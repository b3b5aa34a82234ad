"""Small dimensions: metric profiles, anomaly scenarios with their remediation, prompt templates."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.sources import values

PROFILE_SCHEMA = "metric string, mean double, std double, min double, max double"
LAYER_SCHEMA = "layer string, layer_name string, metrics array<string>"
SCENARIO_SCHEMA = (
    "scenario_id string, layer string, name string, description string, root_cause string, "
    "root_cause_category string, severity string, anomaly_type string, detection_params array<string>, "
    "remediation array<string>, affected map<string, struct<kind: string, lo: double, hi: double, pattern: string>>"
)


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, *map(float, p)) for m, p in values.PROFILES.items()], PROFILE_SCHEMA)


def with_profile(df: DataFrame, table: DataFrame, default: tuple = values.DEFAULT_PROFILE) -> DataFrame:
    """Add mean/std/min/max of each row's metric; unknown metrics get the default profile."""
    dim = table.select("metric", *[F.col(c).alias(f"p_{c}") for c in ("mean", "std", "min", "max")])
    joined = df.join(dim, "metric", "left")
    for c, d in zip(("mean", "std", "min", "max"), default):
        joined = joined.withColumn(f"p_{c}", F.coalesce(f"p_{c}", F.lit(float(d))))
    return joined


def layers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, n, list(m)) for k, n, m in values.LAYERS], LAYER_SCHEMA)


def scenarios(spark: SparkSession) -> DataFrame:
    """The built-in scenarios (22 rows); a description names the scenario, its layer and its cause."""
    names = {key: name for key, name, _ in values.LAYERS}
    rows = [
        (i, la, n, f"{n} on {names[la]}: {rc}.", rc, cat, sev, typ, list(det), list(rem), {m: tuple(e) for m, *e in values.EFFECTS[i]})
        for i, la, n, rc, cat, sev, typ, det, rem in values.SCENARIOS
    ]
    return spark.createDataFrame(rows, SCENARIO_SCHEMA)


def read_scenarios(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(layers, scenarios) from a YAML or JSON configuration file of ``layers -> scenarios``."""
    text = spark.read.text(path, wholetext=True).first().value
    if path.endswith((".yaml", ".yml")):
        import yaml

        doc = yaml.safe_load(text)
    else:
        doc = json.loads(text)
    layer_rows, scenario_rows = [], []
    for layer, body in doc["layers"].items():
        layer_rows.append((layer, body.get("name", layer), body.get("metrics", [])))
        for s in body.get("scenarios", []):
            affected = {}
            for metric, effect in (s.get("affected_metrics") or {}).items():
                kind = next(k for k in ("multiplier", "additive") if k in effect)
                affected[metric] = (kind, *map(float, effect[kind]), effect.get("pattern"))
            text_fields = [s.get(k) for k in ("description", "root_cause", "root_cause_category", "severity", "anomaly_type")]
            lists = [s.get("detection_params", []), s.get("remediation", [])]
            scenario_rows.append((s["id"], layer, s["name"], *text_fields, *lists, affected))
    return (
        spark.createDataFrame(layer_rows, LAYER_SCHEMA),
        spark.createDataFrame(scenario_rows, SCENARIO_SCHEMA),
    )


def prompt_templates(spark: SparkSession) -> DataFrame:
    """The built-in prompts; ``read_prompt_templates`` loads others of the same shape."""
    rows = [(name, *texts) for name, texts in values.PROMPTS.items()]
    return spark.createDataFrame(rows, "name string, system string, user string")


def read_prompt_templates(spark: SparkSession, path: str) -> DataFrame:
    """JSON object ``name -> {system, user}`` as rows."""
    shape = "map<string, struct<system: string, user: string>>"
    docs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", shape)).alias("name", "t"))
    return docs.select("name", "t.system", "t.user")


def remediation_for(df: DataFrame, catalogue: DataFrame, scenario: str = "scenario_id") -> DataFrame:
    """Add catalogue facts to predicted scenarios; unknown ids get '?' and no action."""
    unknown = F.lit("?")

    def known(c: str) -> Column:
        return F.coalesce(F.col(f"c_{c}"), unknown)

    facts = ("name", "layer", "root_cause", "severity")
    dim = catalogue.select(
        F.col("scenario_id").alias(scenario), *[F.col(c).alias(f"c_{c}") for c in facts], F.col("remediation").alias("c_actions")
    )
    return df.join(dim, scenario, "left").select(
        *df.columns,
        *[known(c).alias(f"info_{c}") for c in facts],
        F.coalesce("c_actions", F.array().cast("array<string>")).alias("actions"),
    )
