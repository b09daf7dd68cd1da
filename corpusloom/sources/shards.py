"""Columnar shards and label files."""

from __future__ import annotations

from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.joins import DataError, require_columns

CLIPS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("audio", T.StructType([T.StructField("bytes", T.BinaryType()), T.StructField("path", T.StringType())])),
    T.StructField("text", T.StringType()),
    T.StructField("duration", T.DoubleType()),
])
LABELS = T.StructType([T.StructField("id", T.LongType()), T.StructField("duration", T.DoubleType()), T.StructField("text_raw", T.StringType()), T.StructField("cleaned_text", T.StringType())])
PATTERN, EXCLUDED = "train-*.parquet", "investigation_results"


def shard_files(spark: SparkSession, folder: str, pattern: str = PATTERN, excluded: str = EXCLUDED) -> list[str]:
    """Sorted shard paths in ``folder``, else in its ``data``, else at any depth below, there without paths that hold
    ``excluded``."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(conf)
    for place in (folder, f"{folder}/data"):
        if hits := system.globStatus(jvm.org.apache.hadoop.fs.Path(f"{place}/{pattern}")):
            return sorted(h.getPath().toString() for h in hits)
    found: list[str] = []
    files = system.listFiles(root, True) if system.exists(root) else None
    while files is not None and files.hasNext():
        path = files.next().getPath()
        below = path.toString()[len(system.makeQualified(root).toString()) :]
        if fnmatchcase(path.getName(), pattern) and excluded not in below:
            found.append(path.toString())
    if not found:
        raise DataError(f"no {pattern} below {folder}")
    return sorted(found)


def read_shards(spark: SparkSession, folder: str, columns: tuple[str, ...] = ("id", "audio", "text", "duration"), first: int | None = None, schema: T.StructType = CLIPS, pattern: str = PATTERN) -> DataFrame:
    """The shards' rows with ``text_raw`` never null and ``row_order`` (file, position) taken at the scan.

    Only ``columns`` are read; ``first`` limits the scan to that many shards.
    """
    files = shard_files(spark, folder, pattern)[:first]
    df = spark.read.schema(T.StructType([f for f in schema.fields if f.name in columns])).parquet(*files)
    order = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    df = df.select("*", order.alias("row_order"))
    return df.withColumn("text", F.coalesce("text", F.lit(""))).withColumnRenamed("text", "text_raw") if "text" in columns else df


def read_labels(spark: SparkSession, path: str, schema: T.StructType = LABELS, needed: tuple[str, ...] = ("id", "cleaned_text"), usable: bool = False) -> DataFrame:
    """Labels from CSV with a header and doubled quotes; a byte-order mark is passed over, 'NA' is text, empty is null.
    With ``usable`` a null or blank label is an error when the rows are read."""
    header = require_columns(spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).limit(0), *needed)
    kinds = {f.name: f.dataType for f in schema.fields}
    full = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in header.columns])
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    labels = spark.read.schema(full).options(header=True, escape='"', multiLine=True, **blanks).csv(path)
    return usable_labels(labels) if usable else labels


def usable_labels(labels: DataFrame, text: str = "cleaned_text") -> DataFrame:
    """Raises when the rows are read if a label is null or blank."""
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    return labels.withColumn(text, F.when(blank, F.raise_error(F.concat(F.lit("blank label of id "), F.coalesce(F.col("id").cast("string"), F.lit("null"))))).otherwise(F.col(text)))
