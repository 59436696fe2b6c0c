"""As-of join: every fact meets the last observation of its key at or before the fact's own time.

Facts and observations are sorted together by (key, time) in ranges that Spark samples, so a key of any size spans many
tasks. Inside a range a running ``last`` gives the answer; what a key last saw in earlier ranges is one row per key and
range and is carried over the border. Nothing is paired, so the work is linear in both inputs.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.runtime import skew_join, stage


def asof_join(facts: DataFrame, observations: DataFrame, on: list[str] | str, fact_time: str, seen_time: str, values: list[str], ttl: Column | None = None) -> DataFrame:
    """``facts`` with the columns ``values`` of ``observations``, each as of the fact's time.

    Every value has its own last observation (a NULL is no observation). With ``ttl`` (an interval) an observation
    counts for less than that long: one of exactly that age is too old. Of observations of one key and time the
    largest value counts. Facts without a key, a time or an observation get NULL.
    """
    on = [on] if isinstance(on, str) else list(on)
    lacking = reduce(or_, [F.col(c).isNull() for c in [*on, fact_time]])
    seen = observations.groupBy(*on, F.col(seen_time).alias("_t")).agg(*[F.max(v).alias(v) for v in values])
    stamped = [F.when(F.col(v).isNotNull(), F.struct(F.col("_t").alias("at"), F.col(v).alias("value"))).alias(f"_{v}") for v in values]
    left = seen.select(*on, "_t", F.lit(0).alias("_kind"), *stamped)
    right = facts.filter(~lacking).select(*on, F.col(fact_time).alias("_t"), F.lit(1).alias("_kind"), F.struct(*facts.columns).alias("_fact"))
    both = left.unionByName(right, allowMissingColumns=True)
    # The last sort key cuts facts of one key and time, however many there are.
    spread = F.when(F.col("_kind") == 1, F.xxhash64("_fact")).otherwise(F.lit(0).cast("long"))
    ranged = both.withColumn("_spread", spread).repartitionByRange(*on, "_t", "_kind", "_spread")
    slices = stage(ranged.drop("_spread").withColumn("_range", F.spark_partition_id()), "asof-ranges")

    ends = slices.filter("_kind = 0").groupBy(*on, "_range").agg(*[F.max(f"_{v}").alias(f"_{v}") for v in values])
    here = slices.filter("_kind = 1").select(*on, "_range").distinct()
    borders = here.join(ends, [*on, "_range"], "full_outer")
    before = Window.partitionBy(*on).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = borders.select(*on, "_range", *[F.max(f"_{v}").over(before).alias(f"_carried_{v}") for v in values])
    carried = carried.filter(reduce(or_, [F.col(f"_carried_{v}").isNotNull() for v in values]))

    so_far = Window.partitionBy("_range", *on).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = slices.withColumns({f"_{v}": F.last(f"_{v}", ignorenulls=True).over(so_far) for v in values}).filter("_kind = 1")
    found = skew_join(local, carried, [*on, "_range"], "left")

    def value(v: str) -> Column:
        last = F.coalesce(f"_{v}", f"_carried_{v}")
        fresh = F.lit(True) if ttl is None else last["at"] > F.col("_t") - ttl
        return F.when(fresh, last["value"]).alias(v)

    kinds = {f.name: f.dataType for f in observations.schema}
    passed = facts.filter(lacking).select("*", *[F.lit(None).cast(kinds[v]).alias(v) for v in values])
    return found.select("_fact.*", *[value(v) for v in values]).unionByName(passed)
