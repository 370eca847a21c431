"""File sources and sinks: tolerant CSV and mixed directories, tagged datasets, bundles with their metadata."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sentrymill.operators.etl import SYSTEM_COLUMNS


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType | str | None = None, skip_bad: bool = False, sep: str = ",") -> DataFrame:
    """CSV with a header, in UTF-8. Without a schema the types are inferred by an additional pass; malformed lines are dropped or kept with nulls."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("sep", sep).option("mode", "DROPMALFORMED" if skip_bad else "PERMISSIVE")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path if isinstance(path, str) else list(path))


def read_directory(spark: SparkSession, folder: str, tolerant: bool = True) -> DataFrame:
    """CSV and Parquet files of a folder united by name; with ``tolerant`` unreadable files are skipped."""
    spark_files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    listed = [str(s.getPath()) for s in spark_files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(spark_files)]
    parts = []
    csv = sorted(p for p in listed if p.endswith((".csv", ".csv.gz")))
    parquet = sorted(p for p in listed if p.endswith(".parquet"))
    if csv:
        parts.append(read_csv(spark, csv))
    if parquet:
        parts.append(spark.read.option("ignoreCorruptFiles", tolerant).parquet(*parquet))
    if not parts:
        raise FileNotFoundError(folder)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def with_file(df: DataFrame) -> DataFrame:
    """Adds the name of the file each row comes from."""
    return df.withColumn("file_name", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def metadata(df: DataFrame, system: Sequence[str] = SYSTEM_COLUMNS) -> DataFrame:
    """One row: samples, features (columns that aren't system columns) and their names."""
    names = [c for c in df.columns if c not in system]
    return df.agg(F.count("*").alias("n_samples")).select("n_samples", F.lit(len(names)).alias("n_features"), F.array(*[F.lit(n) for n in names]).alias("feature_names"))


def write_bundle(df: DataFrame, folder: str, partition_by: str | None = None, labels: Sequence[str] = ("label_binary", "label_family")) -> None:
    """Data and metadata with the label distributions below one folder."""
    root = PurePosixPath(folder)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(str(root / "data"))
    metadata(df).write.mode("overwrite").json(str(root / "metadata"))
    for c in labels:
        if c in df.columns:
            df.groupBy(c).count().write.mode("overwrite").json(str(root / f"distribution_{c}"))


def write_features(df: DataFrame, folder: str, features: Sequence[str], keep: Sequence[str]) -> None:
    """The feature matrix in single precision beside the columns kept."""
    df.select(*keep, *[F.col(c).cast("float").alias(c) for c in features]).write.mode("overwrite").parquet(folder)
