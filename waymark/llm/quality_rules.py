"""Quality rules with risk-controlled thresholds.

Each rule is a number that is higher for worse texts. All rules' cutoffs in a stratum move together along one path, from
lenient to strict, which is laid without the holdout: at step k each rule takes its strictest cutoff by which an
estimated share LEVELS[k] of good documents at most would be rejected. The estimate is the share of unlabelled documents
above the cutoff, less what bad documents explain of it by the bad-labelled ones.

The labelled good documents are the holdout. Step by step, the exact (Clopper-Pearson) upper bound of the share of them
that any rule rejects is compared with the risk; the walk stops at the first step that fails (fixed-sequence testing),
so neither steps nor rules need a correction; strata share the error probability (Bonferroni). With probability
`1 - error`, every stratum loses at most `risk` of its good documents to the rules. A stratum with too few labels gets
no cutoff and loses none, and so does one without unlabelled documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, id_key, joined, key_id, mix64, quoted, stage, text_bytes, window_hashes, word_hashes, word_spans

SYMBOLS = b"#*$%&|<>"
#: The fixed rules: fewer words, or a larger share (percent) of words in repeated windows, fail.
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
#: Measured rules: shares of a text, 0 to 1.
RULES = ("symbol_share", "capital_share", "exclaim_share", "dup_line_share", "repeat_share", "stutter_share")
#: Cutoffs of every rule, lenient to strict.
GRID = tuple(round(0.97**k, 6) for k in range(200))
#: Estimated shares of good documents that a rule may reject, by steps of the path.
LEVELS = (0.0, *(round(0.0005 * 1.15**k, 8) for k in range(40)))
#: Strata up to this many have their cutoffs broadcast; more are joined.
_BROADCAST_STRATA = 10_000

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of flags between offsets."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_NOT_SPACE = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80
_CAPITAL = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_SMALL = (np.arange(256) >= 97) & (np.arange(256) <= 122)
_EXCLAIM = np.arange(256) == 33


def _measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Counts and rules of each text."""
    buf, offsets = joined(texts)
    starts, ends = word_spans(buf)
    first = np.searchsorted(starts, offsets)
    n_words = np.diff(first)
    chars = _sums(_NOT_SPACE[buf] & _STARTS_CHAR[buf], offsets)
    symbols, capitals, small, exclaims = (_sums(t[buf], offsets) for t in (_SYMBOL, _CAPITAL, _SMALL, _EXCLAIM))
    hashes = word_hashes(buf, starts, ends, 7)
    doc = np.repeat(np.arange(len(texts)), n_words)
    repeated = np.zeros(len(starts) + 1, dtype=np.int64)
    if len(starts) >= REPEAT_WINDOW:
        n = len(starts) - REPEAT_WINDOW + 1
        at = np.flatnonzero(doc[:n] == doc[REPEAT_WINDOW - 1 :])
        keys = mix64(window_hashes(hashes, REPEAT_WINDOW)[at] ^ mix64(doc[at].astype(np.uint64)))
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        twice = at[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
        np.add.at(repeated, twice, 1)
        np.add.at(repeated, twice + REPEAT_WINDOW, -1)
    repeats = _sums(np.cumsum(repeated[:-1]) > 0, first)
    stutter = np.zeros(len(starts), dtype=bool)
    stutter[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    lines, dup_lines = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        worded = [x for x in text.split(b"\n") if x and not x.isspace()]
        lines[k], dup_lines[k] = len(worded), len(worded) - len(set(worded))
    share = lambda a, b: a / np.maximum(b, 1)
    return {
        "n_words": n_words,
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeats,
        "symbol_share": share(symbols, chars),
        "capital_share": share(capitals, capitals + small),
        "exclaim_share": share(exclaims, chars),
        "dup_line_share": share(dup_lines, lines),
        "repeat_share": share(repeats, n_words),
        "stutter_share": share(_sums(stutter, first), n_words),
    }


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """(id, stratum, counts, rules, base_failed) of every document."""
    schema = pa.schema([("id", pa.int64()), ("stratum", pa.string())] + [(c, pa.int64()) for c in _COUNTS] + [(c, pa.float64()) for c in RULES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            for lo, hi in chunks(texts):
                made = _measure(texts[lo:hi])
                yield pa.record_batch([b.column(0)[lo:hi], b.column(1)[lo:hi], *(pa.array(made[c], type=schema.field(c).type) for c in (*_COUNTS, *RULES))], schema=schema)

    stratum = F.coalesce(F.col(quoted(stratum_col)).cast("string"), F.lit("")) if stratum_col else F.lit("")
    rows = docs.select(id_key(F.col(quoted(id_col))).alias("id"), stratum.alias("stratum"), text_bytes(F.col(quoted(text_col))).alias("text"))
    made = rows.mapInArrow(run, "id long, stratum string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", " + ", ".join(f"{c} double" for c in RULES))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return made.withColumn("base_failed", failed)


def _beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    total = d
    for m in range(1, 100_000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + t * d or 1e-300), 1 + t / c or 1e-300
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total


def upper_bound(k: int, n: int, error: float) -> float:
    """Clopper-Pearson: the largest rate at which at most k of n events has probability `error`."""
    if k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - _beta_cdf(mid, k + 1, n - k) > error else (lo, mid)
    return hi


def last_step(rejected: np.ndarray, n: int, risk: float, error: float) -> int:
    """The last step of a walk before the first whose rejected good documents, of n, have too high a bound; -1 if none."""
    for k, lost in enumerate(rejected):
        if not n or upper_bound(int(lost), n, error) > risk:
            return k - 1
    return len(rejected) - 1


#: Bad documents above a cutoff, from which on it serves to estimate their share.
_ENOUGH_BAD = 10


def _above(rest: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bad documents at or above each cutoff, and shares above it: of unlabelled and of bad ones, each with one more that is not bad."""
    above, bad_above = np.cumsum(rest)[: len(GRID)], np.cumsum(bad)[: len(GRID)]
    return bad_above, np.where(above > 0, above + 1, 0) / (rest.sum() + 1), np.maximum(bad_above - 1, 0) / max(1, bad.sum()), bad_above >= _ENOUGH_BAD


def share_of_bad(sides: list[tuple[np.ndarray, np.ndarray]]) -> float:
    """The share of bad documents among unlabelled ones: the least ratio of the shares above a cutoff, over all rules and cutoffs.

    Where only bad documents lie above a cutoff the ratio is their share, elsewhere it is larger; unlike the share
    among labels it does not depend on how documents were chosen for labelling. Ratios are raised by two standard
    errors, so that the least is not one of few documents.
    """
    ratios = []
    for bad_above, of_rest, of_bad, enough in (_above(*s) for s in sides):
        ratios += (of_rest[enough] / of_bad[enough] * (1 + 2 / np.sqrt(bad_above[enough]))).tolist()
    return float(min([1.0, *ratios])) if ratios else 0.0


def path(rest: np.ndarray, bad: np.ndarray, bad_share: float) -> np.ndarray:
    """For each level of LEVELS, the place in GRID of a rule's cutoff; len(GRID) is none.

    `rest` (unlabelled) and `bad` count documents by how many of GRID's cutoffs lie above their value. A cutoff that
    catches fewer than two bad documents is none.
    """
    if not rest.sum():
        return np.full(len(LEVELS), len(GRID))
    bad_above, of_rest, of_bad, _ = _above(rest, bad)
    lost = np.maximum.accumulate(np.maximum(of_rest - bad_share * of_bad, 0))
    steps = np.searchsorted(lost, np.array(LEVELS) + 1e-12, side="right") - 1  # the strictest cutoff within each level
    # no stricter than its bad documents ask: the most lenient cutoff that rejects as many of them
    caught = bad_above[steps]
    return np.where((steps < 0) | (caught < 2), len(GRID), np.searchsorted(bad_above, caught))


_PATH = "stratum string, " + ", ".join(f"{r} array<int>" for r in RULES)


def fit_cutoffs(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """(stratum, n_good, step, cutoff of each rule) from the documents that pass the fixed rules; `measured` is staged.

    Ids labelled both ways count as unlabelled; of rows that share a labelled id each is an example.
    """
    grid = F.array(*map(F.lit, GRID))

    def above(rule: str):
        return lambda cutoff: F.col(rule) < cutoff

    y = F.col(quoted(label_col))
    known = labels.where(y.isin(0, 1)).select(id_key(F.col(quoted(id_col))).alias("id"), y.cast("int").alias("y"))
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").select("id", "y")
    # how many of the grid's cutoffs keep a value; the stricter rest reject it
    binned = measured.where("not base_failed").select("id", "stratum", *[F.size(F.filter(grid, above(r))).alias(r) for r in RULES])
    binned = stage(binned.join(known, "id", "left").select("stratum", F.coalesce("y", F.lit(-1)).alias("y"), *RULES), "binned")
    counts = binned.groupBy("stratum", "y").agg(F.count("*").alias("n"))
    strata = counts.where("y = 1").count()
    long = binned.where("y <> 1").unpivot(["stratum", "y"], list(RULES), "rule", "bin").groupBy("stratum", "y", "rule", "bin").agg(F.count("*").alias("n"))

    def lay(rows: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"stratum": [rows["stratum"].iloc[0]]}
        sides = []
        for rule in RULES:
            mine = [rows[(rows["rule"] == rule) & (rows["y"] == y)] for y in (-1, 0)]
            sides.append(tuple(np.bincount(m["bin"].to_numpy(int), weights=m["n"].to_numpy(float), minlength=len(GRID) + 1) for m in mine))
        share = share_of_bad(sides)
        out |= {rule: [path(*s, share).tolist()] for rule, s in zip(RULES, sides)}
        return pd.DataFrame(out)

    paths = stage(long.groupBy("stratum").applyInPandas(lay, _PATH), "paths")  # at most 2 * rules * grid rows a stratum
    few = paths.limit(_BROADCAST_STRATA + 1).count() <= _BROADCAST_STRATA
    laid = paths.select("stratum", *[F.col(r).alias(f"path_{r}") for r in RULES])
    good = binned.where("y = 1").join(F.broadcast(laid) if few else laid, "stratum", "left")
    # the first step at which some rule rejects: cutoffs only get stricter along the path
    first = F.least(*[F.coalesce(F.size(F.filter(f"path_{r}", _spares(r))), F.lit(len(LEVELS))) for r in RULES])
    steps = good.select("stratum", first.alias("step")).groupBy("stratum", "step").agg(F.count("*").alias("n"))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        lost = np.bincount(rows["step"].to_numpy(int), weights=rows["n"].to_numpy(float), minlength=len(LEVELS) + 1)
        n = int(lost.sum())
        return pd.DataFrame({"stratum": [rows["stratum"].iloc[0]], "n_good": [n], "step": [last_step(np.cumsum(lost)[: len(LEVELS)], n, risk, error / max(1, strata))]})

    walked = steps.groupBy("stratum").applyInPandas(walk, "stratum string, n_good long, step int")  # at most a row a level
    at = {r: F.element_at(r, F.greatest("step", F.lit(0)) + 1) for r in RULES}
    cutoff = [F.when((F.col("step") >= 0) & (at[r] < len(GRID)), F.element_at(grid, at[r] % len(GRID) + 1)).alias(f"max_{r}") for r in RULES]
    return walked.join(paths, "stratum", "left").select("stratum", "n_good", "step", *cutoff)


def _spares(rule: str):
    """Whether a step's cutoff lies above a document's value: the value's bin counts the cutoffs above it."""
    return lambda cutoff: (cutoff == len(GRID)) | (cutoff < F.col(rule))


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", label_col: str = "quality", risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """One row per document: id, the counts, base_failed, kept, failed_rules, stratum.

    A text is kept if it passes the fixed rules and no rule is at or above its stratum's cutoff. Null texts have no words and
    fail; a null stratum is the stratum ''; repeated rows are judged alike; labels with a null or other value are
    unused; an empty table gives an empty table; other columns are ignored.
    """
    measured = stage(measure(docs, id_col, text_col, stratum_col), "measures")
    cutoffs = stage(fit_cutoffs(measured, labels, id_col, label_col, risk, error), "cutoffs")
    few = cutoffs.limit(_BROADCAST_STRATA + 1).count() <= _BROADCAST_STRATA
    rows = measured.join(F.broadcast(cutoffs) if few else cutoffs, "stratum", "left")
    failed = F.array_compact(F.array(*[F.when(F.col(r) >= F.col(f"max_{r}"), F.lit(r)) for r in RULES]))
    rows = rows.withColumn("failed_rules", failed)
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    return rows.select(key_id("id").alias(id_col), *_COUNTS, "base_failed", kept.alias("kept"), "failed_rules", "stratum")
