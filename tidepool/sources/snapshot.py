"""Whole-database snapshot: one folder of JSON lines (or Parquet) per table plus a manifest table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SNAPSHOT_TYPE = "tidepool-snapshot"
SNAPSHOT_VERSION = 1
MANIFEST = "type STRING, version INT, exported_at STRING, table STRING, format STRING"


def export_snapshot(tables: dict[str, DataFrame], path: str, exported_at: str, fmt: str = "json") -> None:
    """Writes every table; names starting with 'system.' are bookkeeping and left out."""
    kept = {name: df for name, df in tables.items() if not name.startswith("system.")}
    for name, df in kept.items():
        writer = df.write.mode("overwrite").format(fmt)
        if fmt == "json":
            writer = writer.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").option("ignoreNullFields", "false")
        writer.save(f"{path}/{name}")
    spark = next(iter(kept.values())).sparkSession
    rows = [(SNAPSHOT_TYPE, SNAPSHOT_VERSION, exported_at, name, fmt) for name in sorted(kept)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/_snapshot_manifest")


def import_snapshot(spark: SparkSession, path: str, schemas: dict[str, StructType]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables of a snapshot plus their row counts; the caller overwrites, never merges.

    ValueError when the folder is no snapshot of ours. The manifest has one row per table.
    """
    try:
        manifest = spark.read.schema(MANIFEST).json(f"{path}/_snapshot_manifest").collect()
    except Exception as error:
        raise ValueError("not a snapshot folder") from error
    if not manifest or any(row["type"] != SNAPSHOT_TYPE for row in manifest):
        raise ValueError("not a snapshot folder")
    tables = {}
    for row in manifest:
        if row["table"] not in schemas:
            raise ValueError(f"no schema given for table {row['table']}")
        reader = spark.read.schema(schemas[row["table"]]).format(row["format"])
        if row["format"] == "json":
            reader = reader.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").option("mode", "FAILFAST")
        tables[row["table"]] = reader.load(f"{path}/{row['table']}")
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()]
    return tables, reduce(DataFrame.unionByName, counts)
