"""Tables by suffix, partitioned lakes with dry runs and resumption, and the columnar redaction job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.privacy import check_qi
from ..operators.spans import mask_by_patterns

FORMATS = {"csv": "csv", "tsv": "csv", "jsonl": "json", "ndjson": "json", "parquet": "parquet", "orc": "orc"}


def _format(path: str) -> str:
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in FORMATS:
        raise ValueError("the suffix names no known format")
    return suffix


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """csv and tsv (with a header, as text unless a schema says otherwise), jsonl, ndjson, parquet, orc."""
    suffix = _format(path)
    reader = spark.read.schema(schema) if schema else spark.read
    if FORMATS[suffix] == "csv":
        reader = reader.option("header", True).option("sep", "\t" if suffix == "tsv" else ",").option("multiLine", True).option("escape", chr(34)).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    return reader.format(FORMATS[suffix]).load(path)


def write_table(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write by suffix. The committer makes it whole or nothing; an existing table is kept unless ``overwrite``."""
    suffix = _format(path)
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    if FORMATS[suffix] == "csv":
        writer = writer.option("header", True).option("sep", "\t" if suffix == "tsv" else ",").option("escape", chr(34)).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.format(FORMATS[suffix]).save(path)


def column_qi_report(df: DataFrame, qi: list[str], k: int) -> DataFrame:
    """class_sha256, size of the classes below ``k``: digests, no values."""
    key = F.sha2(F.to_json(F.struct(*check_qi(df, qi)), {"ignoreNullFields": "false"}).cast("binary"), 256)
    return df.groupBy(key.alias("class_sha256")).agg(F.count("*").alias("size")).where(F.col("size") < k)


def redact_columns(df: DataFrame, columns: list[str], labels: list[str]) -> DataFrame:
    """The table with these text columns masked; the others are neither read nor changed by the masking."""
    return df.withColumns({c: mask_by_patterns(c, labels) for c in columns})


def plan_lake(df: DataFrame, partition: str) -> DataFrame:
    """Dry run: rows of each partition."""
    return df.groupBy(partition).agg(F.count("*").alias("rows"))


def redact_lake(spark: SparkSession, source: str, target: str, partition: str, columns: list[str], labels: list[str]) -> DataFrame:
    """Redact a Hive-partitioned table into another, partition by partition, leaving out those already done.

    A partition counts as done once its marker is in the manifest, which is written after the data. Returns the rows
    written in this run, by partition.
    """
    rows = spark.read.parquet(source)
    manifest = f"{target.rstrip('/')}_manifest"
    path = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        done = spark.read.parquet(manifest).select(F.col("partition").alias("_done")).distinct()
        rows = rows.join(F.broadcast(done), F.col(partition).cast("string") == F.col("_done"), "left_anti")  # a row for each partition
    plan = plan_lake(rows, partition).select(F.col(partition).cast("string").alias("partition"), "rows").collect()  # a row for each partition
    out = spark.createDataFrame([tuple(r) for r in plan], "partition string, rows long")
    if plan:
        redact_columns(rows, columns, labels).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(target)
        out.write.mode("append").parquet(manifest)
    return out


def binary_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of a folder of documents in any store that Spark reads."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def quarantine(docs: DataFrame, text_col: str = "text", most_chars: int = 5_000_000) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused with reason): null, empty, oversized texts and those with control or replacement characters."""
    t = F.col(text_col)
    reason = F.when(t.isNull(), "missing").when(F.length(F.trim(t)) == 0, "empty").when(F.char_length(t) > most_chars, "oversized").when(t.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"), "control_characters").when(t.contains("�"), "undecodable")
    marked = docs.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")
