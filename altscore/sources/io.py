"""Readers and writers.

Reads always carry an explicit schema (no inference on large inputs); writes
go to paths the caller names — on a cluster, shared storage such as the
checkpoint folder, never a machine-local directory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import stored

FORMATS = ("parquet", "csv", "json")


def scan(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Parquet by suffix, anything else CSV with a header row."""
    if path.rstrip("/").endswith(".parquet"):
        r = spark.read
        return (r.schema(schema) if schema is not None else r).parquet(path)
    r = spark.read.option("header", True)
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


CORRUPT = "_corrupt_record"
QUARANTINE = "file string, line string, reason string"


def scan_checked(spark: SparkSession, path: str, schema: StructType, fmt: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """CSV or JSON lines as (rows, QUARANTINE).

    A line that does not fit the schema is in no row: neither it nor a field of it
    becomes NULL unseen.  It is kept with its file and the reason: the fields that are
    not of their type, or that the line has too few or too many of them, or is no JSON object.  An
    empty field of a CSV file and a missing one of a JSON record are NULL, as ever.
    """
    if fmt not in ("csv", "json"):
        raise ValueError(f"Unsupported format: {fmt}")
    r = spark.read.schema(StructType(list(schema.fields)).add(CORRUPT, "string")).option("mode", "PERMISSIVE")
    r = r.option("columnNameOfCorruptRecord", CORRUPT)
    raw = r.option("header", header).csv(path) if fmt == "csv" else r.json(path)
    # stored: Spark reads the corrupt column only beside all others
    raw = stored(raw.withColumn("_file", F.col("_metadata.file_path")), "scan-checked")
    names = schema.fieldNames()
    text = StructType([StructField(n, StringType()) for n in names])
    line = F.from_csv(CORRUPT, text.simpleString()[7:-1].replace(":", " ")) if fmt == "csv" else F.from_json(CORRUPT, text)
    bad = raw.where(F.col(CORRUPT).isNotNull()).withColumn("_text", line)
    wrong = F.array_compact(F.array(*[
        F.when(F.col(f"`{n}`").isNull() & (F.length(F.col(f"_text.`{n}`")) > 0), F.lit(f"{n} is not {schema[n].dataType.simpleString()}")) for n in names]))
    other = F.lit("wrong number of fields" if fmt == "csv" else "not a JSON object")
    bad = bad.select(F.col("_file").alias("file"), F.col(CORRUPT).alias("line"),
                     F.when(F.size(wrong) > 0, F.concat_ws("; ", wrong)).otherwise(other).alias("reason"))
    return raw.where(F.col(CORRUPT).isNull()).select(*[F.col(f"`{n}`") for n in names]), bad


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Parquet (snappy), CSV with header or JSON lines; other
    format names raise ``ValueError``."""
    if fmt not in FORMATS:
        raise ValueError(f"Unsupported format: {fmt}")
    w = df.write.mode(mode)
    if fmt == "parquet":
        w.option("compression", "snappy").parquet(path)
    elif fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.json(path)
    return path


def read_back(spark: SparkSession, path: str, fmt: str, schema) -> DataFrame:
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    if fmt == "csv":
        return spark.read.option("header", True).schema(schema).csv(path)
    return spark.read.schema(schema).json(path)


def detect_input_kind(df: DataFrame) -> str:
    """S3: raw applications carry the nested transaction list."""
    return "applications" if "sms_transactions" in df.columns else "features"


def json_struct(df: DataFrame, cols: list[str], name: str) -> DataFrame:
    """Pack columns into one JSON text column."""
    return df.withColumn(name, F.to_json(F.struct(*cols)))
