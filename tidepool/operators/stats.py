"""Headline, daily and rollup statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.schemas import STATS_MIN_VOLUME_USD


def launch_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def creator_rollup(df: DataFrame) -> DataFrame:
    """Per creator: number of launches, first and last launch."""
    return df.groupBy(F.col("creator").alias("address")).agg(
        F.count("*").alias("launch_count"),
        F.min("created_at").alias("first_launch_at"),
        F.max("created_at").alias("last_launch_at"),
    )


def creator_parts(df: DataFrame, keys: list[str]) -> DataFrame:
    """``creator_rollup`` within ``keys``: what a ``BucketedTable`` keeps per partition."""
    return df.groupBy(*keys, F.col("creator").alias("address")).agg(
        F.count("*").alias("launch_count"), F.min("created_at").alias("first_launch_at"), F.max("created_at").alias("last_launch_at")
    )


def creator_rollup_of(parts: DataFrame) -> DataFrame:
    """``creator_rollup`` from its parts."""
    return parts.groupBy("address").agg(
        F.sum("launch_count").alias("launch_count"), F.min("first_launch_at").alias("first_launch_at"), F.max("last_launch_at").alias("last_launch_at")
    )


def creator_count(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("creator").alias("total"))


def creator_page_summary(page: DataFrame) -> DataFrame:
    """Totals over the creator rows loaded so far."""
    return page.agg(
        F.coalesce(F.sum("launch_count"), F.lit(0)).alias("launches"),
        F.count(F.when(F.col("launch_count") > 1, 1)).alias("repeat_creators"),
        F.coalesce(F.max("launch_count"), F.lit(0)).alias("top_count"),
    )


def day_stats(df: DataFrame, as_of: Column, window_hours: float = 24, min_volume: float = STATS_MIN_VOLUME_USD) -> DataFrame:
    """One row of headline numbers over the launches of the last ``window_hours``; zeros when there are none.

    Real volume counts analysed launches only, whatever value an unanalysed one may carry.
    """
    recent = df.filter(F.col("created_at") >= as_of - F.make_dt_interval(secs=F.lit(window_hours * 3600)))
    analysed = F.col("intel_updated_at").isNotNull()
    volume, real = F.coalesce("volume_usd", F.lit(0.0)), F.coalesce("external_volume_usd", F.lit(0.0))

    def total(amount: Column) -> Column:
        return F.coalesce(F.sum(amount), F.lit(0.0))

    return recent.agg(
        F.count("*").alias("day_launch_count"),
        total(volume).alias("day_volume_usd"),
        total(F.when(analysed, real).otherwise(0.0)).alias("day_real_volume_usd"),
        total(F.when(analysed, 0.0).otherwise(volume)).alias("day_analyzing_volume_usd"),
        F.count(F.when(analysed & (real >= min_volume), 1)).alias("day_launch_count_min_volume"),
        F.countDistinct("creator").alias("day_active_creators"),
    ).withColumn("min_volume_usd", F.lit(float(min_volume)))


def day_fake_volume(stats: DataFrame) -> DataFrame:
    """What is neither real nor still being analysed, and its rounded share of the total."""
    fake = F.greatest(F.lit(0.0), F.col("day_volume_usd") - F.col("day_real_volume_usd") - F.col("day_analyzing_volume_usd"))
    share = F.when(F.col("day_volume_usd") > 0, F.floor(fake / F.col("day_volume_usd") * 100 + F.lit(0.5)).cast("long")).otherwise(F.lit(0).cast("long"))
    return stats.withColumn("day_fake_volume_usd", fake).withColumn("day_fake_pct", share)


def daily_analytics(df: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """One row per UTC day of the last ``days`` including today; days without launches are zero."""
    today = F.to_date(as_of)
    since = F.date_sub(today, days - 1)
    points = df.filter(F.col("created_at") >= since.cast(df.schema["created_at"].dataType)).groupBy(F.to_date("created_at").alias("date")).agg(
        F.count("*").alias("launch_count"), F.sum(F.coalesce("volume_usd", F.lit(0.0))).alias("volume_usd")
    )
    calendar = df.sparkSession.range(1).select(F.explode(F.sequence(since, today)).alias("date"))
    return calendar.join(points, "date", "left").select(
        "date",
        F.coalesce("launch_count", F.lit(0)).alias("launch_count"),
        F.coalesce("volume_usd", F.lit(0.0)).alias("volume_usd"),
    )


def daily_parts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Launches and volume per day within ``keys``."""
    return df.groupBy(*keys, F.to_date("created_at").alias("date")).agg(
        F.count("*").alias("launch_count"), F.sum(F.coalesce("volume_usd", F.lit(0.0))).alias("volume_usd")
    )


def daily_analytics_of(parts: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """``daily_analytics`` from parts per day; filters on the parts' other columns go before it."""
    today = F.to_date(as_of)
    since = F.date_sub(today, days - 1)
    points = parts.filter(F.col("date") >= since).groupBy("date").agg(F.sum("launch_count").alias("launch_count"), F.sum("volume_usd").alias("volume_usd"))
    calendar = parts.sparkSession.range(1).select(F.explode(F.sequence(since, today)).alias("date"))
    return calendar.join(points, "date", "left").select(
        "date", F.coalesce("launch_count", F.lit(0)).alias("launch_count"), F.coalesce("volume_usd", F.lit(0.0)).alias("volume_usd")
    )


def daily_summary(points: DataFrame) -> DataFrame:
    """Totals, peaks, average and the busiest day (the earliest on a tie) of a daily series."""
    busiest = F.max(F.struct(F.col("launch_count"), (-F.unix_date("date")).alias("early"), F.col("date")))
    row = points.agg(
        F.coalesce(F.sum("launch_count"), F.lit(0)).alias("total_launches"),
        F.coalesce(F.sum("volume_usd"), F.lit(0.0)).alias("total_volume_usd"),
        F.coalesce(F.max("launch_count"), F.lit(0)).alias("peak_launches"),
        F.coalesce(F.max("volume_usd"), F.lit(0.0)).alias("peak_volume_usd"),
        F.coalesce(F.round(F.avg("launch_count"), 1), F.lit(0.0)).alias("avg_launches"),
        busiest.alias("_busiest"),
    )
    return row.withColumn("busiest_day", F.col("_busiest.date")).drop("_busiest")


def trade_side_counts(trades: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Buys and the rest (counted as sells), per key if given."""
    buys = F.count(F.when(F.col("side") == "buy", 1))
    return trades.groupBy(*(keys or [])).agg(buys.alias("buys"), (F.count("*") - buys).alias("sells"))


def api_usage(calls: DataFrame) -> DataFrame:
    """Calls, errors and last call per method with the overall totals.

    There are only as many result rows as methods, so the totals are a window over the rollup.
    """
    from pyspark.sql import Window

    per_method = calls.groupBy("method").agg(
        F.count("*").alias("calls"),
        F.count(F.when(F.col("is_error"), 1)).alias("errors"),
        F.max("called_at").alias("last_called_at"),
    )
    everything = Window.partitionBy(F.lit(0))
    return per_method.withColumn("total_calls", F.sum("calls").over(everything)).withColumn(
        "total_errors", F.sum("errors").over(everything)
    ).orderBy(F.desc("calls"), "method")
