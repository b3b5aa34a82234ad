"""Sessions as text, prompts, and the pluggable scorer."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.text import PROMPT_CUT, ellipsis
from faultline.operators.sessions import first_events
from faultline.session import materialize


def session_text(df: DataFrame, session: str = "session_id", n: int = 50, order: str = "line_no") -> DataFrame:
    """(session, n_events, session_text): header, the first ``n`` events one per line, footer.

    Missing level and component show as UNKNOWN and unknown. At most ``n`` rows per session are
    collected; the total comes from a partial count.
    """
    line = F.format_string(
        "[E%03d] [%-5s] [%s] %s",
        F.col("pos"),
        F.coalesce(F.col("level"), F.lit("UNKNOWN")),
        F.coalesce(F.col("component"), F.lit("unknown")),
        ellipsis(F.coalesce(F.col("content"), F.lit("")), PROMPT_CUT),
    )
    head = first_events(df.select(session, order, "level", "component", "content"), session, n, order)
    body = head.select(session, "pos", line.alias("line")).groupBy(session).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body")
    )
    totals = df.where(F.col(session).isNotNull()).groupBy(session).agg(F.count("*").alias("n_events"))
    text = F.concat(
        F.lit("[SESSION_START] Block: "), F.col(session).cast("string"),
        F.lit("\nTotal events: "), F.col("n_events").cast("string"),
        F.lit(", Showing: "), F.least(F.col("n_events"), F.lit(n)).cast("string"),
        F.lit("\n---\n"), F.col("body"),
        F.lit("\n---\n[SESSION_END] Total: "), F.col("n_events").cast("string"), F.lit(" events"),
    )
    return body.join(totals, session).select(session, "n_events", text.alias("session_text"))


def template_info(events: DataFrame, catalogue: DataFrame, session: str = "session_id") -> DataFrame:
    """Templates occurring in each session as lines ``id count template`` in id order."""
    used = events.where(F.col(session).isNotNull()).select(session, "event_id").distinct()
    line = F.concat_ws(" ", F.col("event_id").cast("string"), F.col("count").cast("string"), "template")
    return (
        used.join(catalogue.select("event_id", "template", "count"), "event_id")
        .groupBy(session)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("template_info"))
    )


def _fill(text: Column, values: dict[str, Column], unescape: bool) -> Column:
    """Put values into ``{name}`` slots; doubled braces of the template become single first, so braces
    inside the values stay as they are."""
    if unescape:
        text = F.replace(F.replace(text, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return text


def build_prompts(
    df: DataFrame, templates: DataFrame, kind: str, slots: dict[str, Column], session: str = "session_id",
    unescape_braces: bool = True, timestamp: str | None = None,
) -> DataFrame:
    """(session, prompt struct) with system and user text and metadata. ``templates`` has one row per kind."""
    chosen = templates.where(F.col("name") == kind)
    system, user = chosen.select("system").scalar(), chosen.select("user").scalar()
    metadata = F.struct(
        F.col(session).cast("string").alias("block_id"), F.col("n_events"), F.lit(kind).alias("prompt_type"),
        F.lit(timestamp).cast("string").alias("timestamp"),
    )
    prompt = F.struct(system.alias("system"), _fill(user, slots, unescape_braces).alias("user"), metadata.alias("metadata"))
    return df.select(session, prompt.alias("prompt"))


def classification_prompts(texts: DataFrame, templates: DataFrame, unescape_braces: bool = True, **kw) -> DataFrame:
    return build_prompts(
        texts, templates, "anomaly_classification", {"session_text": F.col("session_text")}, unescape_braces=unescape_braces, **kw
    )


def root_cause_prompts(
    texts: DataFrame, info: DataFrame | None, templates: DataFrame, session: str = "session_id",
    empty: str = "Not available", unescape_braces: bool = True, **kw,
) -> DataFrame:
    """``empty`` stands in where a session has no known template."""
    joined = texts.withColumn("template_info", F.lit(None).cast("string")) if info is None else texts.join(info, session, "left")
    slots = {"session_text": F.col("session_text"), "template_info": F.coalesce(F.col("template_info"), F.lit(empty))}
    return build_prompts(joined, templates, "root_cause_analysis", slots, session, unescape_braces, **kw)


def comparative_prompts(pairs: DataFrame, texts: DataFrame, templates: DataFrame, session: str = "session_id", **kw) -> DataFrame:
    """One prompt per (normal_id, anomaly_id) pair, keyed by the anomalous session."""
    side = texts.select(session, "session_text", "n_events")
    normal = side.select(F.col(session).alias("normal_id"), F.col("session_text").alias("normal_text"))
    anomaly = side.select(F.col(session).alias("anomaly_id"), F.col("session_text").alias("anomaly_text"), "n_events")
    joined = pairs.join(normal, "normal_id").join(anomaly, "anomaly_id").withColumn(session, F.col("anomaly_id"))
    slots = {"normal_session": F.col("normal_text"), "anomaly_session": F.col("anomaly_text")}
    return build_prompts(joined, templates, "comparative_analysis", slots, session, **kw)


#: Words by which a service says that it is asked too often.
TOO_OFTEN = ("429", "quota", "rate limit")


def ask(
    prompts: DataFrame, scorer: Callable[[str, str], str], key: str = "session_id", attempts: int = 5, wait: float = 3.0,
    longest_wait: float = 65.0, per_minute: float | None = None, answered: DataFrame | None = None,
) -> DataFrame:
    """(key, raw, error, attempts): apply ``scorer(system, user) -> answer`` to every prompt in Arrow batches.

    The function is shipped to the tasks; it may call whatever service the caller uses. What raises, or returns anything but
    a text, is tried again up to ``attempts`` times in all, after ``wait`` seconds, then twice as long each time up to
    ``longest_wait``, which follows at once where the service says it is asked too often. A prompt that never succeeds keeps
    its row, with NULL in ``raw`` and the last failure in ``error``. A task makes at most ``per_minute`` calls a minute.
    ``answered`` (of the same columns) holds earlier answers: those that succeeded are returned as they are and not asked again.
    """
    dtype = prompts.schema[key].dataType.simpleString()
    pause = 60.0 / per_minute if per_minute else 0.0

    def run(batches):
        free = 0.0
        for pdf in batches:
            told = []
            for system, user in zip(pdf["system"], pdf["user"], strict=True):
                delay = wait
                for attempt in range(1, attempts + 1):
                    time.sleep(max(0.0, free - time.monotonic()))
                    free = time.monotonic() + pause
                    try:
                        answer, error = scorer(system, user), None
                        if isinstance(answer, str):
                            break
                        error = f"no text: {answer!r}"
                    except Exception as failure:
                        error = f"{type(failure).__name__}: {failure}"
                    answer = None
                    if attempt < attempts:
                        often = any(word in error.lower() for word in TOO_OFTEN)
                        time.sleep(longest_wait if often else min(delay, longest_wait))
                        delay *= 2
                told.append((answer, error, attempt))
            raw, error, tried = zip(*told, strict=True) if told else ((), (), ())
            yield pd.DataFrame({key: pdf[key], "raw": raw, "error": error, "attempts": tried})

    flat = prompts.select(key, "prompt.system", "prompt.user")
    if answered is not None:
        done = answered.where("raw IS NOT NULL").select(key, "raw", "error", "attempts")
        flat = flat.join(done.select(F.col(key).alias("_done")), F.col(key).eqNullSafe(F.col("_done")), "left_anti")
    asked = flat.mapInPandas(run, f"`{key}` {dtype}, raw string, error string, attempts int")
    return asked if answered is None else done.unionByName(asked)


def ask_into(prompts: DataFrame, scorer: Callable[[str, str], str], path: str, key: str = "session_id", rounds: int = 16, **how) -> DataFrame:
    """Ask in rounds that append their answers to the table ``path``, and return the answers of all prompts.

    Each round takes the prompts of one hash range, so a job that is lost or stopped goes on at the next one that is not
    there yet; failed prompts are asked again by the next call. Of several rows of one key the successful one counts.
    """
    spark = prompts.sparkSession
    dtype = prompts.schema[key].dataType.simpleString()
    schema = f"`{key}` {dtype}, raw string, error string, attempts int"
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    kept = spark.read.schema(schema).parquet(path).where("raw IS NOT NULL").select(F.col(key).alias("_done")).distinct()
    kept = materialize(kept, "answered")
    left = materialize(prompts.join(kept, F.col(key).eqNullSafe(F.col("_done")), "left_anti"), "unanswered")
    for number in range(rounds):
        part = left.where(F.pmod(F.xxhash64(key), F.lit(rounds)) == number)
        ask(part, scorer, key, **how).write.mode("append").parquet(path)
    rows = spark.read.schema(schema).parquet(path)
    best = F.max_by(F.struct("raw", "error", "attempts"), F.struct(F.col("raw").isNotNull(), "attempts", "raw"))
    return rows.groupBy(key).agg(best.alias("_b")).select(key, "_b.*")


def error_evidence(df: DataFrame, session: str = "session_id", order: str = "line_no") -> DataFrame:
    """First error of each session, its position, and the components reached from there on, in order of appearance.

    All events of a session count. Both steps are partial aggregates, so a long session leaves a task as one row per
    component; ``propagation`` holds each component once.
    """
    rows = df.where(F.col(session).isNotNull()).select(session, order, "level", "component", "content")
    error = F.col("level").isin("ERROR", "FATAL", "CRITICAL")
    first = rows.where(error).groupBy(session).agg(F.min(order).alias("_at"), F.min_by("content", order).alias("first_error"))
    first = materialize(first, "first-errors").withColumnRenamed(session, "_s")
    joined = rows.join(first, F.col(session) == F.col("_s"))
    seen = joined.groupBy(session, "_at", "first_error", "component").agg(
        F.min(F.when(F.col(order) >= F.col("_at"), F.col(order))).alias("at"), F.count_if(F.col(order) <= F.col("_at")).alias("before")
    )
    reached = F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "component"))))
    return seen.groupBy(session, "_at", "first_error").agg(
        F.sum("before").cast("int").alias("first_pos"), F.transform(reached, lambda x: x["component"]).alias("propagation")
    ).select(session, "first_pos", "first_error", "propagation")
