"""Temperature mixing of sources to target weights, realised as budgeted block permutations.

Shares of tokens p are raised to an exponent t and normalised. The exponent (1: as the corpus is, 0: all sources
alike, above 1: large sources gain) is bisected to meet a target entropy or a limit on repetition. Each source then gets its weight's part of
the token budget: whole epochs over all its blocks, and of one more epoch the first blocks of a permutation until
the budget is met; of the block where the budget ends, the first documents of a permutation.

Permutations are orders of seeded hashes, so what a document's source does is told by a few numbers: whole epochs,
the last hash of a block that is taken, and the last hash of a document in the block where the budget ends. They
are found by sums over blocks; texts are never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NULL_ID, SPACE_CLASS, fresh, id_key, quoted, stage

#: Hashed cells of a source, which make up its blocks: the most blocks that a source can have.
_CELLS = 1 << 16
#: The table of sources is broadcast; more sources than this are refused.
MAX_SOURCES = 100_000


def tempered(tokens: dict, exponent: float) -> dict:
    """Normalised weights of sources with tokens; a source without any has weight 0."""
    most = max(tokens.values(), default=0)
    raised = {s: (n / most) ** exponent if n else 0.0 for s, n in tokens.items()}
    total = sum(raised.values())
    return {s: x / total if total else 0.0 for s, x in raised.items()}


def entropy(weights: dict) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def budget_to_cover(tokens: dict, weights: dict) -> int:
    """The least budget at which every source is used whole at least once."""
    return math.ceil(max((n / weights[s] for s, n in tokens.items() if n), default=0) - 1e-9)


def most_repeats(tokens: dict, weights: dict, budget: float | None) -> float:
    """Epochs over the source that is repeated most; without a budget, at the least one that covers every source."""
    budget = budget_to_cover(tokens, weights) if budget is None else budget
    return max((weights[s] * budget / n for s, n in tokens.items() if n), default=0.0)


#: An exponent is sought between 0 (all sources alike) and this.
MOST_EXPONENT = 64.0


def _bisect(good, lo: float, hi: float, steps: int) -> float:
    """The number nearest to lo, between lo and hi (either may be larger), at which good() turns true; hi if it never does."""
    if good(lo):
        return lo
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if good(mid) else (mid, hi)
    return hi


def fit_exponent(tokens: dict, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None, most: float = MOST_EXPONENT, steps: int = 60) -> float:
    """The exponent that meets the entropy, then moved as far toward 1 (the corpus as it is) as the limit on repetition asks.

    Below 1 small sources gain, above 1 large ones do; with `most` of 1 the target is a least entropy, and a corpus
    that lies below it in sharpness stays as it is. Sources all alike have the same entropy under every exponent.
    """
    exponent = 0.0
    if target_entropy is not None:
        # doubled until it brackets the target, so that bisection is not spent on far exponents
        upper = 1.0
        while upper < most and entropy(tempered(tokens, upper)) > target_entropy:
            upper = min(most, 2 * upper)
        exponent = _bisect(lambda t: entropy(tempered(tokens, t)) <= target_entropy, 0.0, upper, steps)
    if max_repeats is not None:
        exponent = _bisect(lambda t: most_repeats(tokens, tempered(tokens, t), budget) <= max_repeats, exponent, 1.0, steps)
    return exponent


def word_count(text: str | Column) -> Column:
    """Words parted by ASCII white space, the default measure of tokens; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.size(F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != "")), F.lit(0)).cast("long")


def _hash01(*parts: Column) -> Column:
    """A hash as an even number from 0 to 2**53 - 1: exact as a double, and order means permutation."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    entropy_share: float | None = None,
    max_repeats: float | None = None,
    budget: str | int = "total",
    block_tokens: int = 100_000,
    tokens: Column | None = None,
    seed: int = 17,
    most_exponent: float = MOST_EXPONENT,
) -> DataFrame:
    """One row per document and epoch in which it is used: id, source, n_tokens, epoch, block, position.

    `position` (0 to 1) orders all rows so that sources run out together; within a source it goes epoch by epoch,
    block by block, document by document. `entropy_share` is the target entropy as a share of the logarithm of the
    number of sources, met as nearly as exponents from 0 to `most_exponent` and the limit on repetition allow; `budget`
    is tokens, "total" (as many as there are) or "cover" (the least budget at which every document is used).

    A null source is the source ''. Documents without tokens follow their block. Rows that share an id share their
    fate. A source without tokens is used once. An empty table gives an empty table; other columns are ignored.
    """
    measured, sources = _planned(docs, id_col, source_col, text_col, entropy_share, max_repeats, budget, block_tokens, tokens, seed, most_exponent)
    rows = _used(measured, sources, "source", "key", seed, {c: c for c in _WORK})
    id_of = F.when(F.col("id") != F.lit(NULL_ID), F.col("id")).alias(id_col)
    return rows.select(id_of, "source", "n_tokens", "epoch", "block", "weight", "position")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17, **options) -> DataFrame:
    """The documents as the mixture uses them: rows of `docs`, all columns, repeated where a source is repeated. Options as in mix_sources()."""
    defaults = {"entropy_share": None, "max_repeats": None, "budget": "total", "block_tokens": 100_000, "tokens": None, "most_exponent": MOST_EXPONENT}
    _, sources = _planned(docs, id_col, source_col, text_col, seed=seed, **(defaults | options))
    names = dict(zip(_WORK, fresh(docs, *_WORK)))
    source, key = fresh(docs, "source_key", "id_hash")
    rows = docs.withColumns({source: _source(source_col), key: _hash01(id_key(F.col(quoted(id_col))), F.lit(seed))})
    return _used(rows, sources, source, key, seed, names).select(*[F.col(quoted(c)) for c in docs.columns])


def _source(source_col: str) -> Column:
    return F.coalesce(F.col(quoted(source_col)).cast("string"), F.lit(""))


def _planned(docs: DataFrame, id_col: str, source_col: str, text_col: str, entropy_share, max_repeats, budget, block_tokens: int, tokens, seed: int, most_exponent: float) -> tuple[DataFrame, DataFrame]:
    """Measures of every document (id, source, n_tokens, key, cell), and what is to be used of each source."""
    key = _hash01(id_key(F.col(quoted(id_col))), F.lit(seed))
    tokens = word_count(F.col(quoted(text_col))) if tokens is None else tokens
    cell = F.pmod(key, F.lit(_CELLS))
    measured = docs.select(id_key(F.col(quoted(id_col))).alias("id"), _source(source_col).alias("source"), tokens.cast("long").alias("n_tokens"), key.alias("key"), cell.alias("cell"))
    measured = stage(measured, "tokens")
    cells = stage(measured.groupBy("source", "cell").agg(F.sum("n_tokens").alias("t")), "cells")
    totals = {r["source"]: r["t"] for r in cells.groupBy("source").agg(F.sum("t").alias("t")).limit(MAX_SOURCES + 1).collect()}
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    plan = _plan(totals, entropy_share, max_repeats, budget, block_tokens, most_exponent)
    spark = docs.sparkSession
    plan_df = spark.createDataFrame(plan or [("", 0.0, 0, 0, 1, 0.0)], "source string, weight double, whole long, rest long, per_block long, epochs double")
    block = (F.col("cell") / F.col("per_block")).cast("long")
    order = _hash01(F.col("source"), F.col("block"), F.col("whole"), F.lit(seed))

    # where the budget of the last, partial epoch ends: at most _CELLS blocks to a source
    blocks = cells.join(F.broadcast(plan_df), "source").withColumn("block", block).groupBy("source", "block", "whole", "rest").agg(F.sum("t").alias("t"))
    blocks = blocks.withColumn("order", order)
    by_order = Window.partitionBy("source").orderBy("order", "block")
    blocks = blocks.withColumn("before", F.coalesce(F.sum("t").over(by_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ends = blocks.where("before < rest").groupBy("source").agg(F.max(F.struct("order", "block")).alias("last"), F.max_by(F.col("rest") - F.col("before"), "before").alias("room"))
    ends = stage(ends.select("source", F.col("last.order").alias("last_order"), F.col("last.block").alias("last_block"), "room"), "ends")
    edge = measured.join(F.broadcast(plan_df.join(ends, "source")), "source").withColumn("block", block).where("block = last_block")
    edge = edge.withColumn("doc_order", _hash01(F.col("key"), F.col("whole")))
    by_doc = Window.partitionBy("source").orderBy("doc_order")
    edge = edge.withColumn("before", F.sum("n_tokens").over(by_doc.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens"))
    edge = edge.where("before < room").groupBy("source").agg(F.max("doc_order").alias("last_doc"))
    return measured, stage(plan_df.join(ends, "source", "left").join(edge, "source", "left"), "sources")


#: Columns that tell what is used of a source, and those made of them for each use of a document.
_PLAN = ("weight", "whole", "rest", "per_block", "epochs", "last_order", "last_block", "room", "last_doc")
_WORK = _PLAN + ("block", "uses", "epoch", "position")


def _used(rows: DataFrame, sources: DataFrame, source: str, key: str, seed: int, n: dict[str, str]) -> DataFrame:
    """A row for each epoch in which a row is used; working columns are named by n."""
    plan = sources.select(F.col("source").alias(source), *[F.col(c).alias(n[c]) for c in _PLAN])
    rows = rows.join(F.broadcast(plan), source)  # at most MAX_SOURCES rows
    rows = rows.withColumn(n["block"], (F.pmod(key, F.lit(_CELLS)) / F.col(n["per_block"])).cast("long"))
    order = _hash01(F.col(source), F.col(n["block"]), F.col(n["whole"]), F.lit(seed))
    before_end = (order < F.col(n["last_order"])) | ((order == F.col(n["last_order"])) & (F.col(n["block"]) < F.col(n["last_block"])))
    at_end = (F.col(n["block"]) == F.col(n["last_block"])) & (_hash01(F.col(key), F.col(n["whole"])) <= F.col(n["last_doc"]))
    once_more = F.when(F.coalesce(before_end | at_end, F.lit(False)), 1).otherwise(0)
    rows = rows.withColumn(n["uses"], F.col(n["whole"]) + once_more).where(F.col(n["uses"]) > 0)
    rows = rows.withColumn(n["epoch"], F.explode(F.sequence(F.lit(0).cast("long"), F.col(n["uses"]) - 1)))
    scale = float(1 << 53)
    place = _hash01(F.col(source), F.col(n["block"]), F.col(n["epoch"]), F.lit(seed)) / scale
    within = _hash01(F.col(key), F.col(n["epoch"])) / scale / _CELLS
    return rows.withColumn(n["position"], (F.col(n["epoch"]) + place * (1 - 1 / _CELLS) + within) / F.greatest(n["epochs"], F.lit(1e-12)))


def _plan(totals: dict, entropy_share: float | None, max_repeats: float | None, budget: str | int, block_tokens: int, most_exponent: float = MOST_EXPONENT) -> list[tuple]:
    """(source, weight, whole epochs, tokens of the last epoch, cells to a block, epochs) of each source."""
    used = {s: n for s, n in totals.items() if n}
    target = None if entropy_share is None else entropy_share * math.log(max(1, len(used)))
    fixed = None if budget == "cover" else sum(used.values()) if budget == "total" else int(budget)
    exponent = fit_exponent(used, target, max_repeats, fixed, most_exponent) if target is not None or max_repeats is not None else 1.0
    weights = tempered(used, exponent)
    spend = budget_to_cover(used, weights) if fixed is None else fixed
    out = []
    for s, n in totals.items():
        if not n:
            out.append((s, 0.0, 1, 0, 1, 1.0))
            continue
        mine = max(n, round(weights[s] * spend)) if budget == "cover" else round(weights[s] * spend)
        cells = min(_CELLS, max(1, math.ceil(block_tokens * _CELLS / n)))
        out.append((s, weights[s], mine // n, mine % n, cells, mine / n))
    return out
