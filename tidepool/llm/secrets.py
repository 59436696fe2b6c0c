"""Secret scan with corpus-wide ownership frequency, in DataFrame expressions only.

Spans: three fixed kinds, leftmost and non-overlapping per kind, plus ``token``, a bare random-looking string. The
candidate values of all documents are hashed and counted by distinct repository and owner. A value that more than
``MAX_OWNERS`` owners or more than ``MAX_REPOSITORIES`` repositories have is a widely copied example; any other one that
looks random is live. Bare tokens become spans only if they are live, so both counts decide what is reported.

Positions come from ``split`` and ``regexp_extract_all`` with one pattern: a match starts where the pieces and
matches before it end.

Defined cases: NULL text is empty; a NULL owner or repository counts as one of its own; rows that repeat in full
give repeated rows; documents of one text share spans but are counted by their own owners; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.columns import running_sums
from tidepool.runtime import skew_join, stage

# Fixed patterns of the contract (kinds in report order), and the bare token.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
# The alternatives before the last one consume what the other kinds may report.
TOKEN = rf"{ASSIGN}|(?-i:AKIA[A-Z0-9]+)|([A-Za-z0-9_-]{{20,}})"
#: kind, pattern that is quick to test, pattern, group with the value, least length of that value
KINDS = (
    ("assign", ASSIGN, ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]{16}", ACCESS, 0, 20),
    ("hex", r"[0-9a-f]{24}", HEX, 0, 24),
    ("token", r"[A-Za-z0-9_-]{20}", TOKEN, 3, 20),
)
BASE_KINDS = 3
MAX_OWNERS = 2
MAX_REPOSITORIES = 4
RANDOM_LENGTH = 16
RANDOM_LETTERS = 10


def _looks_random(value: Column) -> Column:
    """Long, with digits and letters, and with many different characters."""
    different = F.size(F.array_distinct(F.split(value, "")))
    return (F.length(value) >= RANDOM_LENGTH) & value.rlike("[0-9].*[0-9]") & value.rlike("[A-Za-z]") & (different >= RANDOM_LETTERS)


def _spans(df: DataFrame, rank: int, kind: str, test: str, pattern: str, group: int, least: int) -> DataFrame:
    """Adds ``_kind``: array of (start, rank, end, value hash, random) of one kind."""
    text, hit = F.col("_text"), F.col("_text").rlike(test)
    none = F.array().cast("array<string>")
    df = df.withColumns({
        "_match": F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
        "_value": F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none),
        "_piece": F.when(hit, F.split(text, pattern, -1)).otherwise(F.array(F.lit(""))),
    })
    size = F.size("_match")
    before = F.transform(F.slice("_piece", F.lit(1), size), lambda p: F.length(p).cast("long"))
    df = df.withColumn("_before", before).withColumn("_long", F.zip_with("_before", "_match", lambda b, m: b + F.length(m)))
    df = df.withColumn("_at", F.zip_with("_before", running_sums(F.col("_long")), lambda b, s: b + s))
    keep = lambda x: (F.length(x["_value"]) >= least) & (_looks_random(x["_value"]) if kind == "token" else F.lit(True))
    end = lambda x: x["_at"] + F.length(x["_match"])
    made = F.transform(
        F.filter(F.arrays_zip("_at", "_match", "_value"), keep),
        lambda x: F.struct(
            x["_at"].alias("start"), F.lit(rank).alias("rank"), end(x).alias("end"), F.xxhash64(x["_value"]).alias("hash"), _looks_random(x["_value"]).alias("random")
        ),
    )
    return df.withColumn(f"_{kind}", made).drop("_match", "_value", "_piece", "_before", "_long", "_at")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, owner: Column, repository: Column, doc_id: str = "doc_id", text: str = "text", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_token, n_live, n_example, most_owners, most_repositories, base_spans, spans.

    ``n_live`` and ``n_example`` count all reported spans by what the corpus says about their value; ``most_owners`` and
    ``most_repositories`` are the counts of the reported value that most have (0 without spans).
    """
    found = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.xxhash64(text, owner, repository).alias("_row"),
        owner.alias("owner"), repository.alias("repository"),
    )
    for rank, kind in enumerate(KINDS):
        found = _spans(found, rank, *kind)
    names = [f"_{k[0]}" for k in KINDS]
    found = stage(found.select("doc_id", "_row", "owner", "repository", *names), "secrets-found")

    every = found.select("doc_id", "_row", "owner", "repository", F.explode(F.concat(*names)).alias("s"))
    owned = every.groupBy(F.col("s.hash").alias("hash"), "owner", "repository").agg(F.count("*").alias("n"))
    owned = owned.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    counts = owned.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    copied = (F.col("owners") > max_owners) | (F.col("repositories") > max_repositories)
    judged = skew_join(every.withColumn("hash", F.col("s.hash")), counts, "hash").select(
        "doc_id", "_row", F.struct("s.start", "s.rank", "s.end", copied.alias("example"), (F.col("s.random") & ~copied).alias("live"), "owners", "repositories").alias("s")
    ).filter((F.col("s.rank") < BASE_KINDS) | F.col("s.live"))
    per_doc = judged.groupBy(F.col("doc_id").alias("_d"), F.col("_row").alias("_r")).agg(F.collect_set("s").alias("_all"))

    joined = found.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_row") == F.col("_r")), "left")
    everything = F.coalesce(F.col("_all"), F.array().cast(per_doc.schema["_all"].dataType))
    base = F.concat(*[F.transform(n, lambda s: F.struct(s["start"], s["rank"], s["end"])) for n in names[:BASE_KINDS]])
    return joined.select(
        "doc_id",
        *[F.size(f"_{k[0]}").cast("long").alias(f"n_{k[0]}") for k in KINDS[:BASE_KINDS]],
        F.size(F.filter(everything, lambda s: s["rank"] >= BASE_KINDS)).cast("long").alias("n_token"),
        F.size(F.filter(everything, lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter(everything, lambda s: s["example"])).cast("long").alias("n_example"),
        *[F.coalesce(F.array_max(everything[c]), F.lit(0)).cast("long").alias(f"most_{c}") for c in ("owners", "repositories")],
        _joined(base).alias("base_spans"),
        _joined(F.transform(everything, lambda s: F.struct(s["start"], s["rank"], s["end"]))).alias("spans"),
    )
