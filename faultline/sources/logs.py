"""Readers for raw log files, dataset folders, parsed tables and template catalogues."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.session import scratch_path

SPLIT_BYTES = 128 << 20
LINE_SCHEMA = "dataset string, file string, line_no bigint, value string"
TEMPLATE_SCHEMA = T.StructType(
    [
        T.StructField("cluster_id", T.IntegerType()),
        T.StructField("template", T.StringType()),
        T.StructField("count", T.LongType()),
    ]
)

# Folder and file names of the known datasets.
DATASETS = {
    "hdfs_v1": ("HDFS_v1", ("HDFS.log",), ("anomaly_label.csv", "anomaly_labels.txt")),
    "bgl": ("BGL", ("BGL.log",), ()),
    "openstack": ("OpenStack", ("openstack_abnormal.log", "openstack_normal1.log", "openstack_normal2.log"), ()),
}


def read_log_lines(
    spark: SparkSession,
    paths: str | list[str],
    max_lines: int | None = None,
    dataset: str | None = None,
    number_by: str = "file",
    encoding: str = "utf-8",
    keep_path: bool = False,
    with_header: bool = False,
    **options: str,
) -> DataFrame:
    """Lines with their 1-based number in file order; bad bytes become U+FFFD.

    Numbers come from a prefix sum over per-split line counts, taken in a first pass and kept in the
    shared folder: one row per file split, small enough to be broadcast by size unless there are very many.
    Both passes read through a session of their own that cuts files every SPLIT_BYTES, whatever the number
    of cores at the time; a line that still finds no count, or lies outside its split's count, is an error
    and never lost. ``number_by="dataset"`` numbers through all files in path order, for logs stored in
    parts. ``with_header`` adds the first line of each line's file.
    """
    reader = spark.newSession()
    for name, value in (("minPartitionNum", 1), ("maxPartitionBytes", SPLIT_BYTES), ("openCostInBytes", 4 << 20)):
        reader.conf.set(f"spark.sql.files.{name}", str(value))
    raw = reader.read.options(encoding=encoding, **options).text(paths)
    lines = raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )
    # Lines of one split have consecutive row ids, so (first id, count) locates each line.
    splits = lines.groupBy("path", "start").agg(
        F.count("*").alias("n"), F.min("row").alias("first"), *([F.min_by("value", "row").alias("top")] if with_header else [])
    )
    in_file = Window.partitionBy("path").orderBy("start")
    order = Window.orderBy("path", "start") if number_by == "dataset" else in_file
    header = [F.first("top").over(in_file).alias("header")] if with_header else []
    offsets = splits.select("path", "start", "n", "first", (F.sum("n").over(order) - F.col("n")).alias("before"), *header)
    path = scratch_path(spark, "splits")
    offsets.write.parquet(path)
    offsets = spark.read.schema(offsets.schema).parquet(path).withColumnsRenamed({"path": "_path", "start": "_start"})
    here = (F.col("path") == F.col("_path")) & (F.col("start") == F.col("_start"))
    inside = F.col("row") - F.col("first")
    changed = F.raise_error(F.concat(F.lit("the splits of this file have changed since they were counted: "), F.col("path")))
    counted = F.coalesce((inside >= 0) & (inside < F.col("n")), F.lit(False))
    numbered = offsets.join(lines, here, "right").select(
        F.lit(dataset).cast("string").alias("dataset"),
        F.element_at(F.split("path", "/"), -1).alias("file"),
        *(["path"] if keep_path else []),
        *(["header"] if with_header else []),
        F.when(counted, inside + F.col("before") + 1).otherwise(changed.cast("long")).alias("line_no"),
        "value",
    )
    return numbered if max_lines is None else numbered.where(F.col("line_no") <= max_lines)


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, bytes) of the files below ``root``; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", F.col("length").alias("bytes"))
    )


def dataset_paths(spark: SparkSession, root: str, key: str, kind: str = "log") -> list[str]:
    """Paths of a dataset's files: its own folder first, then the flat folder, then ``preprocessed``.

    A log may be a file or a folder of part files of that name. The list has one entry per part file.
    """
    name, logs, labels = DATASETS[key]
    wanted = logs if kind == "log" else labels
    if not wanted:
        return []
    folders = [f"{root}/{name}", root, f"{root}/preprocessed"]
    try:
        found = [r.path for r in list_files(spark, root, "{part-*," + ",".join(wanted) + "}").select("path").collect()]
    except AnalysisException:
        return []
    strip = lambda p: "/" + p.split(":", 1)[-1].lstrip("/")
    known = {strip(p): p for p in found}
    picked = []
    for file in wanted:
        for place in (strip(f"{folder}/{file}") for folder in folders):
            parts = sorted(p for s, p in known.items() if s == place or s.startswith(f"{place}/part-"))
            if parts:
                picked += parts
                break
    return picked


def read_dataset(spark: SparkSession, root: str, key: str, max_lines: int | None = None) -> DataFrame:
    """Lines of all log files of a known dataset; an absent dataset gives an empty frame."""
    paths = dataset_paths(spark, root, key)
    if not paths:
        return spark.createDataFrame([], LINE_SCHEMA)
    parts = any("/part-" in p for p in paths)
    return read_log_lines(spark, paths, max_lines, dataset=key, number_by="dataset" if parts else "file")


def file_inventory(spark: SparkSession, paths: str | list[str], **options: str) -> DataFrame:
    """Size in MB and number of lines of each file."""
    raw = spark.read.options(**options).text(paths)
    return (
        raw.groupBy(F.col("_metadata.file_path").alias("path"))
        .agg(F.count("*").alias("lines"), F.max("_metadata.file_size").alias("bytes"))
        .select("path", "lines", (F.col("bytes") / (1024 * 1024)).alias("size_mb"))
    )


def largest_file(inventory: DataFrame) -> DataFrame:
    return inventory.orderBy(F.desc("size_mb"), "path").limit(1)


def read_parsed(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.options(header=True, quote='"', escape='"', multiLine=True)
    return reader.format(fmt).load(path)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TEMPLATE_SCHEMA).csv(path, header=True, quote='"', escape='"')


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, label 0/1) from a label file with any of the known header conventions."""
    from faultline.operators.parse import normalize_label

    table = spark.read.csv(path, header=True, inferSchema=True)
    return labels_from(table, normalize_label)


def labels_from(table: DataFrame, normalize) -> DataFrame:
    names = table.columns
    key = next((c for c in ("BlockId", "block_id") if c in names), names[0])
    label = next((c for c in ("Label", "label") if c in names), names[1])
    return table.select(F.col(key).cast("string").alias("session_id"), normalize(table, label).alias("label"))
