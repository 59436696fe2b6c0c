"""The exchanges: ids, factories, event topics and quote tokens.

``DexSpec`` is the one extension point: a new exchange is one more entry in ``DEXES`` (or in the list a caller passes).
It states where its events keep what; decoding compiles that into column expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.schemas import QUOTE_TOKENS

# Token addresses, symbols and decimals.
WETH = "0x4200000000000000000000000000000000000006"
USDC = "0x833589fcd6edb6e08f4c7c32d4f71b54bda02913"
USDT = "0xfde4c96c8593536e31f229ea8f37b2ada2699bb2"
VIRTUAL = "0x0b3e328455c4059eeb9e3f84b5543f74e24e7e1b"
AERO = "0x940181a94a35a4569e4529a3cdfb74e38fd98631"
SHARED_QUOTES = [(WETH, "WETH", 18), (USDC, "USDC", 6), (USDT, "USDT", 6), (VIRTUAL, "VIRTUAL", 18)]
STABLE_QUOTES = [USDC, USDT]

# Event signature hashes.
PAIR_CREATED = "0x0d3648bd0f6ba80134a33ba9275ac585d9d315f0ad8355cddefde31afa28d0e9"
POOL_CREATED_FEE = "0x783cca1c0412dd0d695e784568c96da2e9c22ff989357a2e8b1d9b2b4e6b7118"
POOL_CREATED_STABLE = "0x2128d88d14c80cb081c1252a5acff7a264671bf199ce226b53788fb26065005e"
SWAP_V2 = "0xd78ad95fa46c994b6551d0da85fc275fe613ce37657fb8d5e3d130840159d822"
SWAP_AERODROME = "0xb3e2773606abfd36b5bd91394b3a54d1398336c65005baf7bf7a05efeffaf75b"
SWAP_V3 = "0xc42079f94a6350d7e6235f29174924f928cc2ac818eb64fed8004e115fbcca67"


@dataclass(frozen=True)
class DexSpec:
    """``pool_word``: data word of a creation event that holds the pool. ``pool_kind``: what tells the pool type, the
    third indexed topic as a ``fee`` or as a stable ``flag``, or nothing (``fixed``: volatile). ``swap_in`` and
    ``swap_out``: data words with what was paid in and out of token0 and token1; a signed event has one word for both.
    ``swap_words``: data words an event must have. ``recipient_topic``: the topic that names who was paid.
    ``reserve``: the pool's own reserves (``pair``) or its ``balance`` of the quote token.
    """

    id: str
    label: str
    factory: str
    launch_topic: str
    swap_topic: str
    signed_swaps: bool
    pool_types: tuple[tuple[str, str], ...]
    extra_quotes: tuple[tuple[str, str, int], ...] = ()
    network: str = "Base"
    default: bool = False
    pool_word: int = 0
    pool_kind: str = "fixed"
    swap_in: tuple[int, int] = (0, 1)
    swap_out: tuple[int, int] = (2, 3)
    swap_words: int = 4
    recipient_topic: int = 2
    reserve: str = "pair"

    @property
    def quotes(self) -> list[tuple[str, str, int]]:
        return [*SHARED_QUOTES, *self.extra_quotes]


# The supported exchanges, default first.
DEXES: list[DexSpec] = [
    DexSpec(
        id="uniswap-v2", label="Uniswap V2", factory="0x8909dc15e40173ff4699343b6eb8132c65e18ec6",
        launch_topic=PAIR_CREATED, swap_topic=SWAP_V2, signed_swaps=False,
        pool_types=(("volatile", "Volatile"),), default=True,
    ),
    DexSpec(
        id="aerodrome", label="Aerodrome", factory="0x420dd381b31aef6683db6b902084cb0ffece40da",
        launch_topic=POOL_CREATED_STABLE, swap_topic=SWAP_AERODROME, signed_swaps=False,
        pool_types=(("volatile", "Volatile"), ("stable", "Stable")), extra_quotes=((AERO, "AERO", 18),), pool_kind="flag",
    ),
    DexSpec(
        id="uniswap-v3", label="Uniswap V3", factory="0x33128a8fc17869897dce68ed026d694621f6fdfd",
        launch_topic=POOL_CREATED_FEE, swap_topic=SWAP_V3, signed_swaps=True,
        pool_types=(("100", "0.01%"), ("500", "0.05%"), ("3000", "0.30%"), ("10000", "1.00%")),
        pool_word=1, pool_kind="fee", swap_words=5, reserve="balance",
    ),
]


def dex_by_id(dex: str | None) -> DexSpec:
    """The named exchange; unknown or missing names give the default one."""
    return next((spec for spec in DEXES if spec.id == dex), next(spec for spec in DEXES if spec.default))


def dex_catalog(spark: SparkSession) -> DataFrame:
    """One row per exchange and pool-type option."""
    rows = [
        (position, spec.id, spec.label, spec.network, spec.factory, value, label)
        for position, spec in enumerate(DEXES)
        for value, label in spec.pool_types
    ]
    return spark.createDataFrame(
        rows, "position INT, dex STRING, label STRING, network STRING, factory STRING, pool_type STRING, pool_type_label STRING"
    )


def per_dex(specs: list[DexSpec], key: Column, own: Callable[[DexSpec], str], value: Callable[[DexSpec], object]) -> Column:
    """``value`` of the exchange whose ``own`` name ``key`` holds, as one expression; equal values share a branch."""
    by_value: dict[object, list[str]] = {}
    for spec in specs:
        by_value.setdefault(value(spec), []).append(own(spec))
    if len(by_value) == 1:
        return F.lit(next(iter(by_value)))
    out = None
    for v, names in by_value.items():
        out = F.when(key.isin(names), F.lit(v)) if out is None else out.when(key.isin(names), F.lit(v))
    return out


def quote_dim(spark: SparkSession, dex: str | None = None) -> DataFrame:
    """Effective quote tokens (shared + own) of one exchange, or of all of them."""
    specs = DEXES if dex is None else [dex_by_id(dex)]
    rows = [(spec.id, address, symbol, decimals) for spec in specs for address, symbol, decimals in spec.quotes]
    return spark.createDataFrame(rows, QUOTE_TOKENS)


def quote_token(df: DataFrame, quotes: DataFrame, col: str) -> DataFrame:
    """Adds symbol and decimals of the quote token in ``col`` (NULL when it is no known quote).

    ``quotes`` is the dimension of one exchange, or carries ``dex`` to match on when ``df`` has it.
    """
    dim = quotes.select(
        *[F.col("dex").alias("_dex") if c == "dex" else F.col(c) for c in quotes.columns]
    ).withColumnsRenamed({"address": "_address", "symbol": f"{col}_symbol", "decimals": f"{col}_decimals"})
    match = F.lower(F.col(col)) == F.col("_address")
    if "dex" in df.columns and "dex" in quotes.columns:
        match = match & (F.col("dex") == F.col("_dex"))
    elif "dex" in quotes.columns:
        dim = dim.drop("_dex").distinct()
    return df.join(F.broadcast(dim), match, "left").drop("_address", "_dex")


def is_known_quote(df: DataFrame, quotes: DataFrame, col: str) -> DataFrame:
    """Adds ``<col>_is_quote``."""
    tagged = quote_token(df, quotes, col)
    return tagged.withColumn(f"{col}_is_quote", F.col(f"{col}_symbol").isNotNull()).drop(f"{col}_symbol", f"{col}_decimals")


def is_quote_token0(quote: Column, token: Column) -> Column:
    """Fixed-width lower-case hex orders like the numbers it spells."""
    return F.lower(quote) < F.lower(token)
