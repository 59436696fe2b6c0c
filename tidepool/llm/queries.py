"""The registered queries of this subpackage and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import chat, decontaminate, jaccard, language, mixing, neighbours, oracles, packing, phrases, quality, secrets, sharding, suffix_dedup, treap
from tidepool.llm.columns import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; ``source`` is the owner, its documents of one language a repository."""
    repository = F.concat_ws("/", "source", "lang")
    found = secrets.scan(table(spark, sf_dir, "documents"), F.col("source"), repository)
    return found.withColumn("base_sha256", F.sha2(F.col("base_spans").cast("binary"), 256)).drop("base_spans")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes, in order of doc_id."""
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every row whose vec_id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.search(rows, rows.filter(F.col("vec_id") % 20 == 0), 20)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under the Jaccard join on 4-word shingles at 85 %."""
    return jaccard.classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat 100 bytes from earlier on."""
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a benchmark item covers; ``longest_match`` in words."""
    found = decontaminate.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct("_found.items"))
    return found.select(
        "doc_id", F.col("_found.n_words").alias("n_words"), decontaminate.covered(F.col("_found.hits")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("_found.hits") > 0).alias("contaminated"), F.coalesce(F.array_max(F.transform("_found.matches", lambda m: m["length"])), F.lit(0)).alias("longest_match"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from every document, and when."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return language.identify(table(spark, sf_dir, "documents"))


def op10_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's side; masks as start:end, comma-joined."""
    seen = chat.perspectives(table(spark, sf_dir, "conversations"))
    masks = F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"], m["end"])), ",")
    return seen.withColumn("masks", masks)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return treap.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best collocations of every language."""
    return phrases.top(table(spark, sf_dir, "documents"), 2000)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in sequences of at most 2,048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_sharding, op3_neighbours, op4_quality, op5_jaccard_join, op6_suffix_dedup, op7_decontamination, op8_mixing,
        op9_language, op10_chat_rotation, op11_lexical_search, op12_collocations, op13_packing,
    )
}
ORACLES: dict[str, str] = {"op11_lexical_search": oracles.LEXICAL, "op12_collocations": oracles.PHRASES}
