"""Session set-up and the few distribution helpers the operators share.

``stage``        cuts lineage by writing a Parquet table to the shared checkpoint folder
``skew_join``    fact-to-dimension join that never shuffles the rows of a hot key
``top_k``        first k rows per key, limited on the map side
``number_rows``  1-based row numbers inside a key of any size, without one task per key
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

# A key with more fact rows than this is "hot" (override: spark.tidepool.hotRows).
HOT_ROWS = 5_000_000
_local_root: str | None = None


def build_session(cores: str = "8", app: str = "tidepool", **conf: str) -> SparkSession:
    """Session for tests, the bench and single-machine use; a cluster brings its own."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": cores if cores.isdigit() else "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stage_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: spark.checkpoint.dir, or a temp folder in local mode."""
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="tidepool-")
    return _local_root


@dataclass
class Staged:
    """A staged table and where it lives; ``drop`` removes it once nothing reads it any more."""

    df: DataFrame
    path: str
    metrics: dict

    def drop(self) -> None:
        spark = self.df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stage_table(df: DataFrame, name: str, **metrics: Column) -> Staged:
    """Writes ``df`` to the shared folder; ``metrics`` (aggregates) are observed during the write."""
    spark = df.sparkSession
    path = f"{stage_root(spark)}/tidepool/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    watch = Observation() if metrics else None
    watched = df.observe(watch, *[metric.alias(key) for key, metric in metrics.items()]) if metrics else df
    watched.write.option("compression", "zstd").parquet(path)
    return Staged(spark.read.schema(df.schema).parquet(path), path, watch.get if metrics else {})


def stage(df: DataFrame, name: str) -> DataFrame:
    """Materialise ``df`` in the shared folder and continue from the written table (at once, if it is one already)."""
    if getattr(df, "_is_staged", False):
        return df
    written = stage_table(df, name).df
    written._is_staged = True
    return written


def hot_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.tidepool.hotRows", str(HOT_ROWS)))


def broadcast_limit(spark: SparkSession) -> int:
    """spark.sql.autoBroadcastJoinThreshold in bytes (-1 when switched off)."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower()
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    digits = text.removesuffix("b")
    if digits and digits[-1] in units:
        return int(digits[:-1]) * units[digits[-1]]
    return int(digits)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate for the optimised plan."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _only_scans(df: DataFrame) -> bool:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return not any(step in plan for step in ("Join", "Aggregate", "Window", "Generate", "Union", "Repartition", "Sort", "Distinct"))


def skew_join(facts: DataFrame, dim: DataFrame, on: list[str] | str, how: str = "inner", fact_rows: int | None = None, sliced: bool = False) -> DataFrame:
    """Join ``facts`` to ``dim`` when some keys may hold a large share of all facts.

    Nothing special is needed when Spark will broadcast the dimension or when the facts are fewer than
    one hot key. Otherwise one pass over the fact keys (pre-aggregated on the map side) lists the keys
    with more than ``hot_rows`` facts. That list has at most rows/hot_rows entries, so it is safe to
    broadcast; it is usually empty, and then this is a plain shuffle join. Facts that are more than a
    filtered scan are staged before they are counted, so that a chain of such joins makes each of its
    steps once. If there are hot keys, their facts are joined apart:

    - ``dim`` has at most a few rows per key (the default): the hot keys' dimension rows are
      broadcast and the hot facts are never shuffled;
    - ``sliced``: ``dim`` may have many rows per key, so each hot key is cut into slices of
      ``hot_rows`` facts and its dimension rows are repeated once per slice (inner joins only).
    """
    on = [on] if isinstance(on, str) else list(on)
    spark = facts.sparkSession
    limit = hot_rows(spark)
    if fact_rows is None and plan_bytes(facts) <= limit:  # not even one byte per row of a hot key
        fact_rows = limit
    if (fact_rows is not None and fact_rows <= limit) or plan_bytes(dim) <= broadcast_limit(spark):
        return facts.join(dim, on, how)
    if not _only_scans(facts):
        held = stage_table(facts, "hot-facts", rows=F.count(F.lit(1)))
        facts = held.df
        if (held.metrics["rows"] or 0) <= limit:
            return facts.join(dim, on, how)
    counted = facts.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / F.lit(limit)).alias("_slices")).filter("_slices > 1")
    listed = stage_table(counted, "hot-keys", keys=F.count(F.lit(1)))
    if not listed.metrics["keys"]:
        listed.drop()
        return facts.join(dim, on, how)
    sizes = listed.df
    hot = sizes.select(*on)
    # NULL keys meet nothing: they pass by the join instead of meeting in one task.
    lacking = reduce(or_, [F.col(c).isNull() for c in on])
    passed, facts = facts.filter(lacking), facts.filter(~lacking)
    shuffled = facts.join(F.broadcast(hot), on, "left_anti").join(dim, on, how)
    if sliced:
        assert how == "inner"
        cut = F.pmod(F.xxhash64(*[F.col(c) for c in facts.columns]), F.col("_slices"))
        hot_facts = facts.join(F.broadcast(sizes), on).withColumn("_slice", cut).drop("_slices")
        copies = dim.join(F.broadcast(sizes), on).withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1))).drop("_slices")
        return hot_facts.join(copies, [*on, "_slice"]).drop("_slice").unionByName(shuffled)
    hot_dim = dim.join(F.broadcast(hot), on, "left_semi")
    on_map_side = facts.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(hot_dim), on, how)
    joined = on_map_side.unionByName(shuffled)
    return joined.unionByName(passed, allowMissingColumns=True) if how in ("left", "left_anti") else joined


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str, spread: int = 1) -> DataFrame:
    """First ``k`` rows per key with their 1-based rank.

    Spark keeps k rows per key on each map task before the shuffle (WindowGroupLimit). With
    ``spread`` > 1 a key is first cut down in that many slices, for keys that span very many tasks.
    """
    if spread > 1:
        slices = df.withColumn("_slice", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(spread)))
        inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = slices.withColumn("_rn", F.row_number().over(inside)).filter(F.col("_rn") <= k).drop("_rn", "_slice")
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Row number inside ``keys`` by ascending ``order`` columns, for keys too big for one task.

    Rows are range-partitioned on keys + order, numbered inside each range, and shifted by the
    number of rows the same key has in earlier ranges.
    """
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    slices = stage(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = slices.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    local = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order))
    return skew_join(slices.withColumn("_local", local), shift, [*keys, "_range"]).select(
        *df.columns, (F.col("_local") + F.col("_shift")).cast("long").alias(name)
    )
