"""The corpus pipeline: language ID, near-duplicate removal, secret redaction, mixing and tokenisation of ``documents``.

Each stage reads what the one before wrote as Parquet. Rows with a NULL id are never duplicates of others; NULL and
letterless texts have no language and go in the first stage. Columns beyond those of ``documents`` pass through whatever
their names; the stages see them inside a struct.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import byte_bpe, jaccard_join, language_id, mixing, secret_scan
from faultline.session import materialize

LEAST_SHARE = 0.3
#: At most this many ids of dropped documents (8 bytes each, about 30 in a hash table) are broadcast.
MOST_IDS = 4_000_000
MARK = "[secret]"
BPE = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one known language has at least the share LEAST_SHARE of the letters."""
    rows = docs.select("text", F.struct(*docs.columns).alias("row"))
    found = language_id.identify(rows, language_id.train(docs), with_spans=False)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies.

    Rows that share an id but are not near copies are in groups of their own, and each group keeps its row; of the rows of a
    group with the smallest id, the first by set and content stays.
    """
    joined = materialize(jaccard_join.join(docs).where("doc_id IS NOT NULL").select("doc_id", "component_id", "set_id", "part"), "joined")
    repeated = materialize(joined.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "repeated-ids")
    kept = joined.where("doc_id = component_id").groupBy("doc_id", "part").agg(F.min("set_id").alias("set_id"))
    gone = joined.where("doc_id <> component_id").select("doc_id").union(repeated).distinct()
    gone = materialize(gone, "dropped")
    # Few ids go to the texts; many cannot be broadcast, and then the texts go to the ids.
    ids = F.broadcast(gone) if gone.count() <= MOST_IDS else gone
    out = docs.where("doc_id IS NOT NULL").join(ids, "doc_id", "left_anti").select(docs.columns)
    several = kept.join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("_id"), F.col("set_id").alias("_kept"))
    several = materialize(several, "kept-of-repeated")
    rows = jaccard_join.with_set_ids(docs.join(repeated, "doc_id", "left_semi").select(docs.columns), "_set")
    rows = rows.join(several, (F.col("doc_id") == F.col("_id")) & F.col("_set").eqNullSafe(F.col("_kept")), "left_semi")
    row = F.struct(*docs.columns)
    first = rows.groupBy("doc_id", "_set").agg(F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*")
    return out.unionByName(first).unionByName(docs.where("doc_id IS NULL"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and ``n_chars`` as it is then."""
    rows = docs.select("text", F.struct(*[c for c in docs.columns if c != "text"]).alias("row"))
    found = secret_scan.scan(rows, secret_scan.train(docs), redact=MARK)
    length = F.when(F.size("secrets") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    made = {"text": F.col("text"), "n_chars": length}
    return found.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, by output shard and in its local order."""
    thin = docs.select(F.col("doc_id").alias("key"), "source", mixing.word_count(F.col("text")).alias("size"))
    sizes = materialize(thin, "sizes")
    made, shards = mixing.plan(sizes), mixing.shard_count(sizes)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("key"), "source", mixing.word_count(F.col("text")).alias("size"))
    mix = mixing.deal(mixing.draw(rows, made), made, shards)
    return mix.repartition(shards, "shard").sortWithinPartitions("shard", "place").select("row.*")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids per document as little-endian 32-bit integers, and whether they decode to the text."""
    encoded = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), *BPE, packed=True, decoded="decoded")
    exact = F.coalesce(F.col("text"), F.lit("")).cast("binary") == F.col("decoded")
    return encoded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", exact.alias("exact"))


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("byte_bpe", tokenise),
]
#: No stage's method is SQL; tests hold the stages against plain versions of their rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
