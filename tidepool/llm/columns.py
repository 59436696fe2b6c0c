"""Column expressions that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running_sums(lengths: Column, block: int = 256) -> Column:
    """For an array of BIGINTs the array of sums of all earlier entries (0 first).

    Appending to an array copies it, so sums are made in blocks: first each block's own, then the blocks' starts.
    """

    def scan(part: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("seen"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["seen"], F.array(acc["at"])).alias("seen"))
        return F.aggregate(part, start, step, lambda acc: acc["seen"])

    count = F.ceil(F.size(lengths) / F.lit(block)).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda k: F.slice(lengths, (k - 1) * block + 1, F.lit(block)))
    totals = F.transform(blocks, lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda acc, x: acc + x))
    zipped = F.zip_with(blocks, scan(totals), lambda part, at: F.transform(scan(part), lambda x: x + at))
    return F.flatten(zipped)


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text; NULL counts 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
