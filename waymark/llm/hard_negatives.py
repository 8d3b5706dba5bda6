"""Hard negatives by distributed radix selection.

Scores are integers (vectors are scaled and floored), so the k-th best row of a window of scores can be found digit by
digit: each task counts the rows of its part of the table in 2**DIGIT buckets of every window, Spark sums these
histograms, the bucket that holds the k-th row becomes the window's interval, and the next scan counts by the next
digit. Scores that tie are told apart by the digits of the row's place in the order of ids. When few enough rows are left, up
to and with that bucket, a last scan gathers just these. Rows are never sorted or sent as pairs; histograms end at
the bucket in which the task itself has k rows, for the k-th of all can't come later.

Anchors are taken in blocks of ANCHORS, each compared with all rows: a first selection finds an anchor's positives, a
second the negatives within the window of scores that each positive sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_folder, quoted, stage

#: Anchors of a block: what is broadcast at a time. Bits of a digit. Anchors and rows multiplied at a time.
ANCHORS, DIGIT, _SIDE, _ROWS = 4096, 8, 512, 4096
#: Rows of a task, about; rows that are gathered for each row that is asked for, at most.
PART, GATHER = 8192, 8
#: Scores are below this, so that percentages of them fit 64 bits.
MOST = 2**56

RESULT = "anchor_id {id}, positive_id {id}, rank int, negative_id {id}, positive_score long, negative_score long"


@dataclass(frozen=True)
class Anchors:
    """A block of anchors: their rows' places, labels and vectors."""

    row: np.ndarray
    label: pa.Array
    vector: np.ndarray

    def codes(self, labels: pa.Array) -> np.ndarray:
        """A number for each label: the first anchor that has it, or -1."""
        return pc.fill_null(pc.index_in(labels, value_set=self.label), -1).to_numpy(zero_copy_only=False)


@dataclass(frozen=True)
class Windows:
    """Windows of scores, in order of their anchors. u is how far a score lies below the window's top."""

    anchor: np.ndarray
    top: np.ndarray
    low: np.ndarray  # the bucket of the k-th row: from low to high (exclusive) in u, or in places where u ties
    high: np.ndarray
    shift: np.ndarray
    tied: np.ndarray  # the u that ties, or -1
    need: np.ndarray  # rows that are still to be found in the bucket
    open: np.ndarray

    @classmethod
    def between(cls, anchor: np.ndarray, low: np.ndarray, top: np.ndarray, k: int) -> Windows:
        width = np.maximum(top - low + 1, 0)
        return cls(anchor, top, np.zeros_like(top), width, _first_shift(width), np.full_like(top, -1), np.full_like(top, k), width > 0)

    def inside(self, w: np.ndarray, u: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these rows lie in their windows' present buckets, and at which coordinate."""
        tied = self.tied[w]
        at = np.where(tied >= 0, place, u)
        return (at >= self.low[w]) & (at < self.high[w]) & ((tied < 0) | (u == tied)), at

    def taken(self, w: np.ndarray, u: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which of these rows lie before their windows' buckets or in them."""
        tied = self.tied[w]
        return (u >= 0) & np.where(tied >= 0, (u < tied) | (u == tied) & (place < self.high[w]), u < self.high[w])

    def narrowed(self, bucket: np.ndarray, before: np.ndarray, count: np.ndarray, k: int, places: int) -> Windows:
        """After a scan: the k-th row's bucket (-1: fewer rows than needed, so all are taken), the rows before it and in it."""
        found = self.open & (bucket >= 0)
        low = np.where(found, self.low + (bucket << self.shift), self.low)
        high = np.where(found, np.minimum(low + (1 << self.shift), self.high), self.high)
        need = np.where(found, self.need - before, self.need)
        still = found & (k - need + count > GATHER * k)
        exact = still & (self.shift == 0)
        tied = np.where(exact & (self.tied < 0), low, self.tied)
        now_tied = exact & (self.tied < 0)
        low, high = np.where(now_tied, 0, low), np.where(now_tied, places, high)
        shift = np.where(now_tied, _first_shift(high), np.maximum(self.shift - DIGIT, 0))
        return replace(self, low=low, high=high, shift=shift, tied=tied, need=need, open=still & ~(exact & ~now_tied))


def _first_shift(width: np.ndarray) -> np.ndarray:
    bits = np.array([max(0, int(x) - 1).bit_length() for x in width], dtype=np.int64)
    return np.maximum(bits - DIGIT, 0)


def _matrix(values: pa.Array, width: int, kind: str) -> np.ndarray:
    """Rows of numbers; shorter ones are filled up with zeros."""
    sizes = pc.list_value_length(values).to_numpy(zero_copy_only=False)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width).astype(kind)
    out = np.zeros((len(sizes), width), dtype=kind)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _near(batches: Iterator[pa.RecordBatch], anchors: Anchors, windows: Windows, only: np.ndarray, same: bool):
    """Rows in the outer bounds of the windows `only`, as (window, u, row's place, id's index in the batch, batch)."""
    first = np.searchsorted(windows.anchor, np.arange(len(anchors.row) + 1))
    each = int(np.diff(first).max(initial=0))
    asked = np.flatnonzero(np.bincount(windows.anchor[only], minlength=len(anchors.row)))
    kind = anchors.vector.dtype
    # outer bounds of an anchor's scores
    most = np.full(len(anchors.row), -(2**62))
    least = np.full(len(anchors.row), 2**62)
    np.maximum.at(most, windows.anchor[only], windows.top[only])
    deep = np.where(windows.tied >= 0, windows.tied + 1, windows.high)
    np.minimum.at(least, windows.anchor[only], (windows.top - deep + 1)[only])
    own = anchors.codes(anchors.label)
    for batch in batches:
        codes, places = anchors.codes(batch["label"]), batch["place"].to_numpy()
        for lo in range(0, batch.num_rows, _ROWS):
            part = _matrix(batch["vector"].slice(lo, _ROWS), anchors.vector.shape[1], kind)
            code, place = codes[lo : lo + _ROWS], places[lo : lo + _ROWS]
            for at in range(0, len(asked), _SIDE):
                a = asked[at : at + _SIDE]
                scores = anchors.vector[a] @ part.T
                alike = own[a][:, None] == code[None]
                hit = (scores >= least[a][:, None].astype(kind)) & (scores <= most[a][:, None].astype(kind))
                hit &= alike & (anchors.row[a][:, None] != place[None]) if same else ~alike
                i, j = np.nonzero(hit)
                s, i, p = scores[i, j].astype(np.int64), a[i], place[j]
                for n in range(each):
                    w = first[i] + n
                    ok = w < first[i + 1]
                    w = np.where(ok, w, 0)
                    ok &= only[w]
                    yield w[ok], windows.top[w[ok]] - s[ok], p[ok], lo + j[ok], batch


def _histograms(batches: Iterator[pa.RecordBatch], anchors: Anchors, windows: Windows, same: bool) -> Iterator[pa.RecordBatch]:
    live = np.flatnonzero(windows.open)
    dense = np.zeros(len(windows.open), dtype=np.int64)
    dense[live] = np.arange(len(live))
    size = 1 << DIGIT
    counts = np.zeros(len(live) * size, dtype=np.int64)
    for w, u, place, _, _ in _near(batches, anchors, windows, windows.open, same):
        ok, at = windows.inside(w, u, place)
        w = w[ok]
        cell, n = np.unique(dense[w] * size + ((at[ok] - windows.low[w]) >> windows.shift[w]), return_counts=True)
        counts[cell] += n
    counts = counts.reshape(-1, size)
    before = np.cumsum(counts, axis=1) - counts
    i, bucket = np.nonzero((counts > 0) & (before < windows.need[live][:, None]))
    yield pa.record_batch([pa.array(live[i]), pa.array(bucket), pa.array(counts[i, bucket])], ["window", "bucket", "n"])


def _gathered(batches: Iterator[pa.RecordBatch], anchors: Anchors, windows: Windows, same: bool) -> Iterator[pa.RecordBatch]:
    for w, u, place, index, batch in _near(batches, anchors, windows, windows.high > 0, same):
        ok = windows.taken(w, u, place)
        if ok.any():
            columns = [pa.array(w[ok]), pa.array((windows.top[w] - u)[ok]), pa.array(place[ok]), batch["id"].take(pa.array(index[ok]))]
            yield pa.record_batch(columns, ["window", "score", "place", "id"])


def _select(rows: DataFrame, anchors, windows: Windows, k: int, same: bool, places: int) -> DataFrame:
    """The k best rows of each window: (window, score, place, id, rank)."""
    context = rows.sparkSession.sparkContext
    while windows.open.any():
        now = context.broadcast(windows)
        counts = rows.mapInArrow(lambda b, now=now: _histograms(b, anchors.value, now.value, same), "window long, bucket long, n long")
        total = counts.groupBy("window", "bucket").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("window").orderBy("bucket"))
        # one row at most for each window of the block
        found = total.withColumn("upto", upto).join(F.broadcast(_needs(rows.sparkSession, windows)), "window").where("upto >= need and upto - n < need").toPandas()
        bucket, before, count = (np.full(len(windows.open), fill, dtype=np.int64) for fill in (-1, 0, 0))
        w = found["window"].to_numpy()
        bucket[w], before[w], count[w] = found["bucket"], found["upto"] - found["n"], found["n"]
        windows = windows.narrowed(bucket, before, count, k, places)
    last = context.broadcast(windows)
    id_type = rows.schema["id"].dataType.simpleString()
    kept = rows.mapInArrow(lambda b: _gathered(b, anchors.value, last.value, same), f"window long, score long, place long, id {id_type}")
    rank = F.row_number().over(Window.partitionBy("window").orderBy(F.desc("score"), "place"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k)


def _needs(spark: SparkSession, windows: Windows) -> DataFrame:
    live = np.flatnonzero(windows.open)
    return spark.createDataFrame(pa.table({"window": live, "need": windows.need[live]}))


def _prepared(vectors: DataFrame, is_anchor: Column, id: str, label: str, vector: str, scale: int) -> DataFrame:
    """Rows that take part, staged in order of their ids: (place, anchor, id, label, vector of whole numbers)."""
    own = vectors[quoted(vector)]
    finite = F.forall(own, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    whole = F.transform(own, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    taken = vectors.where(own.isNotNull() & vectors[quoted(label)].isNotNull() & finite)
    columns = [F.coalesce(is_anchor, F.lit(False)).alias("anchor"), vectors[quoted(id)].alias("id"), vectors[quoted(label)].alias("label"), whole.alias("vector")]
    parts = max(1, -(-vectors.count() // PART))
    ordered = taken.select(*columns).repartitionByRange(parts, "id").sortWithinPartitions("id")
    return stage(ordered.withColumn("place", F.monotonically_increasing_id()), "hard_rows")


def mine_negatives(vectors: DataFrame, is_anchor: Column, id: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256) -> DataFrame:
    """For each anchor and each of its best rows of the same label, the best rows of other labels whose score is between
    `least` and `most` percent of that row's score: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the inner product of vectors whose components are floor(scale * x). Exact for any table; higher scores
    come first, ties by smaller id.

    Rows with a null label, a null vector or a null or non-finite component take no part. Rows with a null id do, before
    all other ids in ties; they are anchors only if is_anchor says so (null: no). Repeated rows count one by one, and an
    anchor's own row alone is left out of its positives. Shorter vectors count as filled up with zeros. A positive score
    below zero leaves no negatives, one of zero those of score zero. An empty table or one without anchors gives an
    empty result. Other columns are ignored whatever their names. Vectors whose squared norm reaches 2**56 (scaled) raise
    ValueError: their scores would not fit.
    """
    spark = vectors.sparkSession
    rows = _prepared(vectors, is_anchor, id, label, vector, scale)
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    mask = (1 << 33) - 1
    size = rows.agg(F.max(norm).alias("norm"), F.max(F.size("vector")).alias("width"), F.max(F.col("place").bitwiseAND(F.lit(mask))).alias("index"), F.max("place").alias("place")).first()
    if (size["norm"] or 0) >= MOST:
        raise ValueError("scores would not fit 64 bits; take a smaller scale")
    if size["place"] is None:
        return spark.createDataFrame([], RESULT.format(id=rows.schema["id"].dataType.simpleString()))
    # partition and index of a row, side by side without the bits that none needs
    bits = int(size["index"]).bit_length()
    place = F.shiftleft(F.shiftright("place", 33), bits) + F.col("place").bitwiseAND(F.lit(mask))
    rows = rows.withColumn("place", place)
    places = ((size["place"] >> 33) + 1) << bits
    limit = int(size["norm"]) + 1
    kind = "float32" if limit < 2**24 else "float64" if limit < 2**53 else "int64"
    after, made = -1, []
    while True:
        block = rows.where(F.col("anchor") & (F.col("place") > after)).orderBy("place").limit(ANCHORS).toArrow()
        if not block.num_rows:
            break
        after = block["place"][-1].as_py()
        width = max(1, size["width"])
        at = block["place"].to_numpy()
        anchors = spark.sparkContext.broadcast(Anchors(at, block["label"].combine_chunks(), _matrix(block["vector"].combine_chunks(), width, kind)))
        every = np.arange(len(at))
        whole = Windows.between(every, np.full(len(at), -limit), np.full(len(at), limit), positives)
        best = stage(_select(rows, anchors, whole, positives, True, places), "hard_positives")
        chosen = best.orderBy("window", "rank").toArrow()
        score = chosen["score"].to_numpy()
        bands = Windows.between(chosen["window"].to_numpy(), -((-least * score) // 100), most * score // 100, negatives)
        found = _select(rows, anchors, bands, negatives, False, places)
        key = {"window": np.arange(len(score)), "anchor_id": block["id"].take(chosen["window"]), "positive_id": chosen["id"], "positive_score": score}
        named = found.join(F.broadcast(spark.createDataFrame(pa.table(key))), "window")
        made.append(new_folder(spark, "hard_negatives"))
        named.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(made[-1])
    schema = RESULT.format(id=rows.schema["id"].dataType.simpleString())
    return spark.read.schema(schema).parquet(*made) if made else spark.createDataFrame([], schema)
