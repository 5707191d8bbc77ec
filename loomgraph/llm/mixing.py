"""Temperature mixing of sources, with SQL functions only.

A source's weight is its share of all tokens to the power ``a``, normalised: 1 keeps the shares, 0 makes
all sources equal. The exponent is found by bisection so that the weights reach a target entropy (as a
part of its maximum) and no source repeats more often than a limit. Weights become quotas of a token
budget. Each source is dealt by hash into a fixed number of blocks; each pass takes the blocks in a fresh
permutation; whole passes, then whole blocks, then documents of the boundary block fill the quota. The sum
is short of the quota by less than one document.

The budget is a number of tokens, ``None`` for all tokens, or ``"cover"`` for the least budget in which
every document occurs. Only a table with one row per source (at most ``MAX_SOURCES``, checked) reaches the
driver; a hot source is pre-aggregated to its blocks before anything is ordered.

Defined results: a null source is a source of its own; null or empty texts have no tokens and go with
their block; repeated ids are drawn together; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import literal_table, materialise, words_of

BLOCKS = 1024
MAX_SOURCES = 100_000
SEED = 20_240_501


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def tempered(shares: list[float], a: float) -> list[float]:
    powered = [s**a if s > 0 else 0.0 for s in shares]
    total = sum(powered)
    return [p / total for p in powered]


def budget_for(tokens: list[int], weights: list[float], budget: float | str | None) -> float:
    if budget == "cover":
        return max(t / w for t, w in zip(tokens, weights) if w > 0)
    return float(sum(tokens) if budget is None else budget)


def solve(tokens: list[int], target_entropy: float, max_repeat: float, budget: float | str | None, steps: int = 60) -> tuple[float, list[float]]:
    """The exponent and the weights.

    Lowering the exponent raises both entropy and repetition. The target entropy asks for the largest exponent that
    reaches it; the limit on repetition asks for the least exponent that keeps it. The limit wins.
    """
    total = sum(tokens)
    shares = [t / total for t in tokens]
    top = math.log(sum(s > 0 for s in shares)) or 1.0

    def bisect(holds) -> float:
        """The largest exponent in 0..1 for which ``holds``, which is true below it."""
        lo, hi = 0.0, 1.0
        if holds(hi):
            return hi
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if holds(mid) else (lo, mid)
        return lo

    def repeats(a: float) -> float:
        w = tempered(shares, a)
        b = budget_for(tokens, w, budget)
        return max(b * x / t for x, t in zip(w, tokens) if t)

    a = bisect(lambda x: entropy(tempered(shares, x)) >= target_entropy * top)
    if repeats(a) > max_repeat:
        a = min(1.0, bisect(lambda x: repeats(x) > max_repeat) + 1e-9)
    return a, tempered(shares, a)


def mix(
    docs: DataFrame,
    target_entropy: float = 0.95,
    max_repeat: float = 4.0,
    budget: float | str | None = None,
    seed: int = SEED,
    blocks: int = BLOCKS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each time a document is drawn: doc_id, source, n_tokens, weight, epoch, block, mix_key, and the ``carry`` columns.

    Reading in the order of (epoch, mix_key) is the block permutation over all sources.
    """
    spark = docs.sparkSession
    ids = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    words = F.size(words_of(F.col(text_col))).cast("long")
    thin = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            words.alias("n_tokens"),
            F.pmod(F.xxhash64(F.lit(seed), ids), F.lit(blocks)).cast("int").alias("block"),
            F.xxhash64(F.lit(seed + 1), ids).alias("draw"),
            *(F.col(c).alias(f"carried_{c}") for c in carry),
        ),
        "mix",
    )
    by_block = thin.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"))
    sources = by_block.groupBy("source").agg(F.sum("tokens").alias("tokens")).orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    tokens = [int(r["tokens"]) for r in sources]
    if not sum(tokens):
        a, weights, total = 1.0, [0.0] * len(tokens), 0.0
    else:
        a, weights = solve(tokens, target_entropy, max_repeat, budget)
        total = budget_for(tokens, weights, budget)
    plan = []
    for r, t, w in zip(sources, tokens, weights):
        quota = total * w
        full = math.floor(quota / t + 1e-9) if t else 1
        plan.append({"s": r["source"], "weight": w, "full": full, "rest": int(max(0, math.floor(quota - full * t + 1e-6))) if t else 0})
    quotas = literal_table(spark, plan, "s string, weight double, full int, rest bigint")
    # Of the pass after the last whole one, each source's blocks come in the order of `turn` until its rest is used up.
    turn = F.xxhash64(F.lit(seed), F.col("full") + 1, F.col("source"), F.col("block"))
    ordered = Window.partitionBy("source").orderBy("turn", "block")
    placed = by_block.join(F.broadcast(quotas), F.col("source").eqNullSafe(F.col("s"))).withColumn("turn", turn)
    placed = placed.withColumn("upto", F.sum("tokens").over(ordered))
    edge = (
        placed.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("tokens") <= F.col("rest")) & (F.col("tokens") > 0))
        .groupBy("source")
        .agg(F.min(F.struct("turn", "block", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("room"))).alias("e"))
        .select(F.col("source").alias("es"), F.col("e.turn").alias("edge_turn"), F.col("e.block").alias("edge_block"), F.col("e.room").alias("room"))
    )
    plan2 = quotas.join(F.broadcast(edge), F.col("s").eqNullSafe(F.col("es")), "left").drop("es")
    edges = [r.asDict() for r in plan2.collect()]
    table = literal_table(spark, edges, "s string, weight double, full int, rest bigint, edge_turn bigint, edge_block int, room bigint")
    rows = thin.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("s"))).withColumn("turn", turn)
    at_edge = (F.col("turn") == F.col("edge_turn")) & (F.col("block") == F.col("edge_block"))
    before = (F.col("turn") < F.col("edge_turn")) | ((F.col("turn") == F.col("edge_turn")) & (F.col("block") < F.col("edge_block")))
    inside = F.when(F.col("edge_turn").isNull(), F.col("rest") > 0).otherwise(before)
    # The boundary block holds one part in `blocks` of its source; its documents come in the order of `draw`.
    boundary = rows.where(at_edge).groupBy("s", "draw", "room").agg(F.sum("n_tokens").alias("n"))
    cut = (
        boundary.withColumn("upto", F.sum("n").over(Window.partitionBy("s").orderBy("draw")))
        .where(F.col("upto") > F.col("room"))
        .groupBy("s")
        .agg(F.min("draw").alias("cut"))
    )
    cuts = literal_table(spark, [{"c": r["s"], "cut": r["cut"]} for r in cut.collect()], "c string, cut bigint")
    taken = rows.join(F.broadcast(cuts), F.col("s").eqNullSafe(F.col("c")), "left")
    part = inside | (at_edge & (F.col("cut").isNull() | (F.col("draw") < F.col("cut"))))
    copies = F.col("full") + F.coalesce(part, F.lit(False)).cast("int")
    return taken.where(copies > 0).select(
        "doc_id", "source", "n_tokens", "weight", "block", F.explode(F.sequence(F.lit(1), copies)).alias("epoch"), *(F.col(f"carried_{c}").alias(c) for c in carry)
    ).withColumn("mix_key", F.xxhash64(F.lit(seed), F.col("epoch"), F.col("source"), F.col("block")))
