"""Language identification: averaged hashed subword embeddings with a linear softmax (``subword``), with rejection.

The probability is temperature-calibrated on rows the model did not learn from; ``accepted`` is false below the
probability that keeps 99 % of those rows, for callers who prefer no answer to a doubtful one.

Defined cases: NULL text, or one without a letter, is ``und`` with score 0; NULL languages are not learned; without
any learned language every answer is ``und``; repeated rows answer alike; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm import subword
from tidepool.llm.quality import held_out

FOLDS = 3
FOLD = 1
UNKNOWN = "und"


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = subword.MAX_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted per document."""
    out_of_training = held_out(doc_id, FOLDS, FOLD)
    learned = docs.filter(~out_of_training & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    learned = learned.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(doc_id).alias("_h"), F.xxhash64(text).alias("_t"))
    model = subword.train(learned, "text", "lang", ["_h", "_t"], lower=True, max_rows=max_rows)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    scored = subword.score(rows, model).withColumn("_best", F.array_max("_probabilities"))
    names = F.array(*[F.lit(c) for c in model.classes])
    can = F.col("_letters") & F.lit(model.classes != ["?"])
    return scored.select(
        "doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"),
        F.when(can, F.element_at(names, F.array_position("_probabilities", F.col("_best")).cast("int"))).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(can, F.col("_best")).otherwise(0.0).alias("score"), (can & (F.col("_best") >= model.reject_below)).alias("accepted"),
    )
