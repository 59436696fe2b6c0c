"""Time-varying curriculum: mix sources to target weights over a training run.

Every source has a weight schedule over training time t in [0, 1]: ``weight * (1 + slope * (2 t - 1))``. Its
integral is the weight, which fixes the source's share of all tokens; the cumulative demand
``(1 - slope) t + slope t**2`` is inverted to turn "the source's n-th token" into a training position. The plan
is DataFrame expressions only.

- A source of any size is cut into ``BUCKETS`` hash buckets, so running sums need no task with a whole source.
- Demand above ``cap`` times a source's size is spread over the others by weight until no source is above it.
- A document takes the tokens of its stretch [c, c + size) that lie below the target, and again in the second
  pass [S + c, S + c + size); the document on the border takes a part.

Defined cases: NULL text has size 0 and takes nothing; a NULL source is a source of its own and comes last;
repeated rows are rows of their own; ties in the hash order go by id, then size; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.columns import word_count
from tidepool.runtime import number_rows, stage, stage_table

BUCKETS_LOG2 = 12
WEIGHTS = (3.0, 1.0, 2.0)
SLOPES = (-0.5, 0.0, 0.5)


def _cycled(values: tuple[float, ...], rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(slim: DataFrame, weights: tuple[float, ...], slopes: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """One row per source: source, source_size, weight, slope, target."""
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_last", F.col("source").isNull())
    ranked = number_rows(sizes, [], ["_last", "source"], "rank")
    table = stage_table(
        ranked.select("source", "source_size", _cycled(weights, F.col("rank")).alias("weight"), _cycled(slopes, F.col("rank")).alias("slope")),
        "mix-sources", total=F.sum("source_size"),
    )
    sources, goal = table.df, share * (table.metrics["total"] or 0)
    limit = F.col("source_size") * F.lit(cap)
    level, settled = -1.0, False
    while not settled:  # raises the level until no further source reaches its limit
        full = limit <= F.col("weight") * F.lit(level)
        held, open_weight = sources.agg(F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_weight:
            break
        raised = (goal - (held or 0.0)) / open_weight
        settled, level = raised <= level, max(raised, level)
    return sources.withColumn("target", F.least(limit, F.col("weight") * F.lit(level)))


def _when_due(words: Column, target: Column, slope: Column) -> Column:
    """Training time at which a source's demand reaches ``words``."""
    part = F.when(target > 0, F.least(words / target, F.lit(1.0))).otherwise(F.lit(0.0))
    bent = (F.sqrt((1 - slope) * (1 - slope) + 4 * slope * part) - (1 - slope)) / (2 * slope)
    return F.when(slope == 0, part).otherwise(bent)


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, share: float = 1.5, cap: float = 2.0,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, passes, position, second_position; sorted by position.

    ``passes`` is ``taken`` in whole documents (the border document rounds); the positions are NULL for passes that
    take nothing. ``cap`` of at most 2 is assumed by the two position columns.
    """
    slim = stage(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
            F.xxhash64(F.col(doc_id), F.col(text)).alias("_h"),
        ).withColumn("_b", F.shiftrightunsigned("_h", 64 - BUCKETS_LOG2)),
        "mix-slim",
    )
    targets = source_targets(slim, weights, slopes, share, cap)
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = slim.groupBy("source", "_b").agg(F.sum("size").alias("_n"))
    starts = starts.select(F.col("source").alias("_s"), F.col("_b").alias("_sb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = slim.withColumn("_own", F.sum("size").over(inside) - F.col("size"))
    laid = laid.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_sb")))
    laid = laid.select("doc_id", "source", "size", (F.col("_start") + F.col("_own")).alias("_c"))
    laid = laid.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    goal = F.round("target").cast("long")
    taken = [F.greatest(F.lit(0), F.least(F.col("size"), goal - F.col("_c") - shift)) for shift in (F.lit(0), F.col("source_size"))]
    due = [
        F.when(part > 0, _when_due(F.col("_c") + shift + F.col("size") / 2, F.col("target"), F.col("slope")))
        for part, shift in zip(taken, (F.lit(0), F.col("source_size")), strict=True)
    ]
    return laid.select(
        "doc_id", "source", "size", "source_size", "target", (taken[0] + taken[1]).alias("taken"),
        F.round((taken[0] + taken[1]) / F.greatest(F.col("size"), F.lit(1))).cast("int").alias("passes"),
        due[0].alias("position"), due[1].alias("second_position"),
    ).orderBy("position", "doc_id")


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The rows of ``docs``, each as often as its ``passes``. Rows alike in id, text and source share their passes evenly."""
    keyed = docs.withColumn("_row", F.xxhash64(doc_id, text, source))
    rows = keyed.select(F.col("_row").alias("_id"), F.col(text).alias("text"), F.col(source).alias("source"))
    taken = mix(rows, "_id", **settings).groupBy(F.col("doc_id").alias("_row")).agg(F.round(F.avg("passes")).cast("int").alias("_passes"))
    due = keyed.join(taken.filter("_passes > 0"), "_row")
    return due.withColumn("_pass", F.explode(F.sequence(F.lit(1), F.col("_passes")))).select(*docs.columns)
