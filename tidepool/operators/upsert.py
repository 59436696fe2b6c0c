"""Table maintenance: partial upserts, labels, index checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.text import valid_address
from tidepool.schemas import INDEX_VERSION, LABEL_KINDS


def latest_per_key(updates: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """One update row per key: the last by ``order``; where that ties or is not given, the largest by value.

    An aggregate, so replays of a hot key collapse before the shuffle.
    """
    rest = [c for c in updates.columns if c not in key]
    row = F.struct(*[F.col(c) for c in rest])
    by = F.struct(*[F.col(c) for c in [*(order or []), *rest]])
    return updates.groupBy(*key).agg(F.max_by(row, by).alias("_row")).select(*key, *[F.col("_row")[c].alias(c) for c in rest])


def upsert(target: DataFrame, updates: DataFrame, key: list[str], columns: list[str], insert: bool = True, order: list[str] | None = None) -> DataFrame:
    """``target`` with the given columns overwritten from ``updates``; other columns keep their values.

    ``insert=False`` updates existing rows only. ``columns`` missing on an inserted row become NULL.
    """
    fresh = latest_per_key(updates, key, order).select(
        *key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit")
    )
    merged = target.join(fresh, key, "full_outer" if insert else "left")

    def value(name: str) -> Column:
        if name in key or name not in columns:
            return F.col(name)
        return F.when(F.col("_hit"), F.col(f"_new_{name}")).otherwise(F.col(name)).alias(name)

    return merged.select(*[value(name) for name in target.columns])


MARKET_COLUMNS = ["liquidity_usd", "volume_usd", "external_volume_usd", "insider_volume_usd", "market_data_updated_at"]
MARKET_FALLBACK_COLUMNS = ["liquidity_usd", "volume_usd", "market_data_updated_at"]
INTEL_COLUMNS = ["external_volume_usd", "insider_volume_usd", "insider_ratio", "insider_buyer_count", "external_buyer_count", "intel_updated_at"]
METRIC_COLUMNS = ["liquidity_usd", "volume_usd", "first_trades", "risk"]


def upsert_launches(launches: DataFrame, rows: DataFrame, overwrite_metrics: bool = False) -> DataFrame:
    """Ingested launch rows by pool address.

    Of several rows of a pool the last by block and log counts. A re-ingested pool keeps its computed metrics; ``overwrite_metrics`` resets liquidity, volume,
    first_trades and risk to the (empty) ingested values, and never touches intel columns.
    """
    known = [c for c in rows.columns if c in launches.columns and c != "pool_address"]
    order = [c for c in ("block_number", "log_index") if c in rows.columns]
    identity = [c for c in known if c not in METRIC_COLUMNS + INTEL_COLUMNS + ["market_data_updated_at"]]
    if overwrite_metrics:
        return upsert(launches, rows, ["pool_address"], identity + METRIC_COLUMNS, order=order)
    merged = upsert(launches, rows, ["pool_address"], identity, order=order)
    return merged.withColumn("risk", F.coalesce("risk", F.lit("unrated"))) if "risk" in merged.columns else merged


def save_market_data(launches: DataFrame, data: DataFrame) -> DataFrame:
    """Writes the market columns that ``data`` carries; a fallback batch leaves real/insider alone."""
    columns = [c for c in MARKET_COLUMNS if c in data.columns]
    return upsert(launches, data, ["pool_address"], columns, insert=False)


def save_launch_intel(launches: DataFrame, intel: DataFrame) -> DataFrame:
    return upsert(launches, intel, ["pool_address"], INTEL_COLUMNS, insert=False)


def checked_labels(updates: DataFrame) -> DataFrame:
    """Label requests with a well-formed address and a known kind."""
    return updates.filter(valid_address(F.trim("address")) & F.col("kind").isin(LABEL_KINDS))


def set_labels(labels: DataFrame, updates: DataFrame, as_of: Column, order: list[str] | None = None) -> DataFrame:
    """Upserts kind and note; created_at is set on insert only; addresses lower-cased, blank notes NULL."""
    clean = updates.withColumns({
        "address": F.lower(F.trim("address")),
        "note": F.nullif(F.trim("note"), F.lit("")),
    })
    merged = upsert(labels, clean, ["address"], ["kind", "note"], order=order)
    return merged.withColumn("created_at", F.coalesce(F.col("created_at"), as_of.cast(labels.schema["created_at"].dataType)))


def remove_labels(labels: DataFrame, addresses: DataFrame) -> DataFrame:
    gone = addresses.select(F.lower("address").alias("address")).distinct()
    return labels.join(gone, "address", "left_anti")


def list_labels(labels: DataFrame) -> DataFrame:
    return labels.orderBy(F.desc_nulls_last("created_at"), "address")


def label_addresses(labels: DataFrame, kind: str) -> DataFrame:
    return labels.filter(F.col("kind") == kind).select(F.lower("address").alias("address"))


def state_id(dex: str) -> str:
    return f"{dex}-pools"


def indexed_block(state: DataFrame, dex: str, default: int) -> DataFrame:
    """Current checkpoint of an exchange, or ``default``."""
    return state.filter(F.col("id") == state_id(dex)).agg(F.coalesce(F.max("indexed_block"), F.lit(default).cast("long")).alias("indexed_block"))


def prepare_index(launches: DataFrame, state: DataFrame, dex: str, start_block: int, version: int = INDEX_VERSION, default_dex: bool = False) -> tuple[DataFrame, DataFrame]:
    """Launches and checkpoint to start indexing from.

    A version change drops the exchange's rows (the default exchange also drops rows without one) and
    resets the checkpoint; otherwise rows before ``start_block`` go and the checkpoint is raised.
    """
    row = state.filter(F.col("id") == state_id(dex)).select("version").head()
    others = state.filter(F.col("id") != state_id(dex))
    before = F.lit(start_block - 1).cast("long")
    kept_version = F.lit(version).cast("int").alias("version")
    own = F.coalesce(F.col("dex") == dex, F.lit(False))
    if row is None or row["version"] != version:
        drop = own | F.col("dex").isNull() if default_dex else own
        fresh = state.sparkSession.range(1).select(F.lit(state_id(dex)).alias("id"), before.alias("indexed_block"), kept_version)
        return launches.filter(~drop), others.unionByName(fresh)
    raised = state.filter(F.col("id") == state_id(dex)).select("id", F.greatest("indexed_block", before).alias("indexed_block"), kept_version)
    return launches.filter(~(own & (F.col("block_number") < start_block))), others.unionByName(raised)


def save_indexed_block(state: DataFrame, dex: str, block: int, version: int = INDEX_VERSION) -> DataFrame:
    """Advances the checkpoint; call after the rows are written."""
    row = state.sparkSession.range(1).select(
        F.lit(state_id(dex)).alias("id"), F.lit(block).cast("long").alias("indexed_block"), F.lit(version).cast("int").alias("version")
    )
    return upsert(state, row, ["id"], ["indexed_block", "version"])
