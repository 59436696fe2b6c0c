"""Quality classifier: supervised subword embeddings (``subword``) on the quality labels of a training fold.

Defined cases: a document with several labels counts with the largest; labels of unknown documents and NULL labels
are left out; NULL and empty texts have no features and score the model's prior; repeated rows score alike; without any
usable label, or with one class only, every score is 1 or 0 by that class (0.5 with none); no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm import subword

FOLDS = 5
THRESHOLD = 0.3


def held_out(doc_id: str = "doc_id", folds: int = FOLDS, fold: int = 0) -> Column:
    """Rows no model learns from: the CRC of the id's text falls in ``fold``. A NULL id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(True))


def annotate(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = subword.MAX_ROWS) -> DataFrame:
    """``docs`` with one more column, ``_score``. The labels of the training fold are all the model learns from."""
    known = labels.filter(~held_out(doc_id)).groupBy(F.col(doc_id).alias("_d")).agg(F.max(label).alias("_y")).filter("_y IS NOT NULL")
    # Only labels of documents at hand; the ids alone are read for that.
    known = known.join(docs.select(F.col(doc_id).alias("_d")).distinct(), "_d").withColumn("_h", F.xxhash64("_d"))
    drawn = known.orderBy("_h", "_d").limit(max_rows)
    labelled = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(drawn), F.col("_id") == F.col("_d"))
    model = subword.train(labelled, "text", "_y", ["_h", "_d"], lower=False, max_rows=max_rows)
    good = model.classes.index("1") if "1" in model.classes else None
    scored = subword.score(docs, model, text)
    score = F.element_at("_probabilities", good + 1) if good is not None else F.lit(0.5 if model.classes == ["?"] else 0.0)
    return scored.withColumn("_score", score).drop("_probabilities")


def scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = subword.MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted (score of at least THRESHOLD) per document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scored = annotate(rows, labels.withColumnRenamed(doc_id, "doc_id"), label=label, max_rows=max_rows)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
