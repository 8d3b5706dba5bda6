"""Exact substring deduplication: Rabin-Karp hashes of every window of `width` words, counted in Spark.

A window is repeated if its word sequence also starts earlier (smaller id, or earlier in the same document).
Every window is hashed; what is shuffled are runs of consecutive windows that share their minimiser, the smallest
Rabin-Karp hash of the `anchor`-word windows within. Equal windows have equal minimisers, and a run never holds
two equal windows, so nothing is lost:

1. runs are counted by minimiser; a minimiser seen once holds no repeated window. The others are marked in a bitmap
   of bounded size, by which each task drops runs before they are shuffled; a wrongly kept run does no harm;
2. runs with equal words (a second, independent hash) repeat as a whole, all but the earliest;
3. where a minimiser has runs with different words, the windows of each earliest run are counted one by one.

Repeated windows then merge into maximal removal intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_long, chunks, fresh, id_key, join_heavy, joined, key_id, quoted, stage, text_bytes, window_hashes, word_hashes, word_spans

#: Bits of the bitmap of repeated minimisers: 16 to each, up to 32 MB, however large the corpus. A full bitmap only drops
#: less: a run is a row of six numbers for about seven words, so the shuffle stays below the size of the texts.
_BITS_PER_KEY, _BITMAP_BITS = 16, 1 << 28
_SLICES = 256  # the bitmap comes to the driver in so many, a power of two
_FIRST, _SECOND = 11, 29  # seeds of the two independent hash families
_BASE = 0xD1B54A32D192ED03  # of the windows' second hash


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Where the leftmost smallest value of each window of `width` values is."""
    n = len(values) - width + 1
    best, at, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        right = best[step:] < best[:-step]
        best, at = np.where(right, best[step:], best[:-step]), np.where(right, at[step:], at[:-step])
        span += step
    return at[:n]


def _words(texts: list[bytes]):
    """Words of all texts: the buffer, their first bytes and ends, the text of each, and each text's first word."""
    buf, offsets = joined(texts)
    starts, ends = word_spans(buf)
    first = np.searchsorted(starts, offsets)
    return buf, starts, ends, np.repeat(np.arange(len(texts)), np.diff(first)), first[:-1]


def _marks(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """The two bits of each key in a bitmap of `bits` bits, a power of two."""
    return [(keys >> np.uint64(shift)) & np.uint64(bits - 1) for shift in (0, 32)]


def _runs_of(texts: list[bytes], width: int, anchor: int):
    """Runs of windows that share a minimiser: key, first word and size of each, and the words they come from."""
    words = _words(texts)
    buf, starts, ends, doc, _ = words
    if len(doc) < width:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), words
    n = len(doc) - width + 1
    whole = doc[:n] == doc[width - 1 :]
    anchors = window_hashes(word_hashes(buf, starts, ends, _FIRST), anchor)
    where = _window_min(anchors, width - anchor + 1)
    new = whole.copy()
    new[1:] &= ~whole[:-1] | (where[1:] != where[:-1])
    begin = np.flatnonzero(new)
    stop = np.flatnonzero(whole & np.append(new[1:] | ~whole[1:], True)) + 1
    return anchors[where[begin]], begin, stop - begin, words


def _keys(width: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            for lo, hi in chunks(texts):
                yield pa.record_batch([pa.array(as_long(_runs_of(texts[lo:hi], width, anchor)[0]))], names=["key"])

    return run


_RUN = "key long, words long, doc long, part long, at long, n int"
_RUN_SCHEMA = pa.schema([("key", pa.int64()), ("words", pa.int64()), ("doc", pa.int64()), ("part", pa.int64()), ("at", pa.int64()), ("n", pa.int32())])


def _runs(width: int, anchor: int, bitmap: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for b in batches:
            ids, parts, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_pylist()
            for lo, hi in chunks(texts):
                keys, begin, sizes, (buf, starts, ends, doc, first) = _runs_of(texts[lo:hi], width, anchor)
                keep = np.ones(len(keys), dtype=bool)
                for mark in _marks(keys, 64 * len(bits)):
                    keep &= (bits[mark >> np.uint64(6)] >> (mark & np.uint64(63))) & np.uint64(1) == 1
                keys, begin, sizes = keys[keep], begin[keep], sizes[keep]
                if not len(keys):
                    continue
                second = word_hashes(buf, starts, ends, _SECOND)
                words = np.empty(len(begin), dtype=np.uint64)
                for size in np.unique(sizes):
                    pick = np.flatnonzero(sizes == size)
                    words[pick] = window_hashes(second, int(size) + width - 1, _BASE)[begin[pick]]
                words = words * np.uint64(0x9E3779B97F4A7C15) + sizes.astype(np.uint64)
                d = doc[begin]
                yield pa.record_batch([pa.array(as_long(keys)), pa.array(as_long(words)), pa.array(ids[lo:hi][d]), pa.array(parts[lo:hi][d]), pa.array(begin - first[d]), pa.array(sizes.astype(np.int32))], schema=_RUN_SCHEMA)

    return run


def _windows(width: int):
    """(id, part, text, [(at, n)]) to the windows of those runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, parts, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_pylist()
            runs = b.column(3)
            for lo, hi in chunks(texts):
                buf, starts, ends, doc, first = _words(texts[lo:hi])
                take = [np.arange(first[k - lo] + at, first[k - lo] + at + n) for k in range(lo, hi) for at, n in zip(*_places(runs[k]))]
                if take:
                    w = np.concatenate(take)
                    one, two = (window_hashes(word_hashes(buf, starts, ends, seed), width, base)[w] for seed, base in ((_FIRST, _BASE), (_SECOND, _BASE)))
                    d = doc[w]
                    yield pa.record_batch([pa.array(as_long(one)), pa.array(as_long(two)), pa.array(ids[lo:hi][d]), pa.array(parts[lo:hi][d]), pa.array(w - first[d]), pa.array(np.ones(len(w), dtype=np.int32))], schema=_RUN_SCHEMA)

    return run


def _places(runs: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """First words and sizes of runs."""
    at, n = (runs.values.field(f).to_numpy(zero_copy_only=False) for f in ("at", "n"))
    return at, n.astype(np.int64)


def _part(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, bool]:
    """0 where ids are unique. Else a hash of the text: rows alike in id and text are one part of a document. And whether they are."""
    unique = docs.groupBy(id_key(F.col(quoted(id_col))).alias("doc")).agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    return F.lit(0).cast("long") if unique else F.xxhash64(text_bytes(F.col(quoted(text_col)))), unique


def _rows(docs: DataFrame, id_col: str, text_col: str, part: Column) -> DataFrame:
    return docs.select(id_key(F.col(quoted(id_col))).alias("doc"), part.alias("part"), text_bytes(F.col(quoted(text_col))).alias("text"))


#: Where a run stands; its order is that of documents, parts and places.
_PLACE = ("doc", "part", "at", "n")


def _first(rows: DataFrame) -> DataFrame:
    """Each (key, words) with its first place and how often it stands."""
    return rows.groupBy("key", "words").agg(F.min(F.struct(*_PLACE)).alias("first"), F.count("*").alias("c"))


def _after(rows: DataFrame, first: DataFrame) -> DataFrame:
    """The places whose (key, words) also stand at an earlier one; `first` is staged."""
    again = join_heavy(rows, first.where("c > 1"), ["key", "words"], "c")
    return again.where(F.struct(*_PLACE) > F.col("first")).select(*_PLACE)


def _of_docs(places: DataFrame, unique: bool) -> DataFrame:
    """The places in each part of a document as one array; what alike rows repeat counts once."""
    return (places if unique else places.distinct()).groupBy("doc", "part").agg(F.collect_list(F.struct("at", "n")).alias("runs"))


def _slice_of(words: int):
    """One slice of the bitmap, of `words` words, from its (word, bits)."""

    def pack(table: pa.Table) -> pa.Table:
        out = np.zeros(words, dtype="<u8")
        out[table["word"].to_numpy() & (words - 1)] = table["bits"].to_numpy().view(np.uint64)
        return pa.table({"slice": pa.array([table["slice"][0].as_py()], pa.int32()), "bits": pa.array([out.tobytes()], pa.binary())})

    return pack


def _bitmap(keys: DataFrame) -> np.ndarray:
    """The bitmap of keys: bits are joined and packed in Spark, so the driver gets _SLICES rows and no more bytes than the bitmap has."""
    size = min(_BITMAP_BITS, 1 << max(16, (_BITS_PER_KEY * keys.count()).bit_length()))
    words = size // 64 // _SLICES
    marks = [F.shiftrightunsigned("key", shift).bitwiseAND(F.lit(size - 1)) for shift in (0, 32)]
    bits = keys.select(F.explode(F.array(*marks)).alias("m")).select(F.shiftright("m", 6).alias("word"), F.expr("shiftleft(1L, cast(m & 63 as int))").alias("bit"))
    joined_bits = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).withColumn("slice", F.expr(f"cast(word div {words} as int)"))
    found = joined_bits.groupBy("slice").applyInArrow(_slice_of(words), "slice int, bits binary").toArrow()
    out = np.zeros((_SLICES, words), dtype=np.uint64)
    for k, part in zip(found["slice"], found["bits"]):
        out[k.as_py()] = np.frombuffer(part.as_buffer(), dtype="<u8")
    return out.reshape(-1)


def _spans(rows: DataFrame, unique: bool, width: int, anchor: int) -> DataFrame:
    counted = rows.mapInArrow(_keys(width, anchor), "key long").groupBy("key").agg(F.count("*").alias("c"))
    repeated = stage(counted.where("c > 1").select("key"), "repeated")
    bitmap = rows.sparkSession.sparkContext.broadcast(_bitmap(repeated))
    runs = stage(rows.mapInArrow(_runs(width, anchor, bitmap), _RUN), "runs")
    first = stage(_first(runs), "first_runs")
    # windows of the earliest run of each word sequence, where a minimiser has several
    mixed = stage(first.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"), "mixed")
    single = join_heavy(first, mixed, ["key"], "k").select("first.*")
    windows = rows.join(_of_docs(single, unique), ["doc", "part"]).select("doc", "part", "text", "runs").mapInArrow(_windows(width), _RUN)
    windows = stage(windows, "windows")
    return _after(runs, first).unionByName(_after(windows, stage(_first(windows), "first_windows")))


def _intervals(starts: np.ndarray, sizes: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal word intervals covered by windows that begin at `starts`, `sizes` of them in a row each."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    ends = np.maximum.accumulate(starts + sizes[order] + width - 1)
    cut = np.flatnonzero(starts[1:] > ends[:-1])
    return list(zip(starts[np.concatenate(([0], cut + 1))].tolist(), ends[np.concatenate((cut, [len(ends) - 1]))].tolist()))


def _cut(text: bytes, at: np.ndarray, n: np.ndarray, width: int) -> tuple[int, int, list[tuple[int, int]], str]:
    """Words, removed words, the word intervals to remove, and the text without them."""
    starts, _ = word_spans(np.frombuffer(text, dtype=np.uint8))
    spans = _intervals(at, n, width)
    kept, done = [], 0
    for lo, hi in spans:
        kept.append(text[done : starts[lo]])
        done = int(starts[hi]) if hi < len(starts) else len(text)
    kept.append(text[done:])
    return len(starts), sum(hi - lo for lo, hi in spans), spans, b"".join(kept).decode("utf-8", "replace")


def _removal(width: int):
    none = np.empty(0, dtype=np.int64)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", span), ("kept_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_cut(t, *(_places(r) if r.is_valid else (none, none)), width) for t, r in zip(b.column(2).to_pylist(), b.column(3))]
            spans = [[{"start": lo, "end": hi} for lo, hi in m[2]] for m in made]
            yield pa.record_batch([b.column(0), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()), pa.array(spans, span), pa.array([m[3] for m in made], pa.string())], schema=schema)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, anchor: int | None = None) -> DataFrame:
    """One row per document: id, n_words, n_removed, removed (maximal word intervals), kept_text.

    Words are runs of bytes other than ASCII white space. kept_text is the text without the removed words and the
    white space after them. Null texts have no words and an empty kept_text; texts shorter than `width` words are
    kept; a null id comes before all others. Rows that share an id are parts of one document, in an order by hash;
    windows don't span parts, and rows alike in id and text are one part, which does not repeat itself. An empty
    table gives an empty table; other columns are ignored.
    """
    part, unique = _part(docs, id_col, text_col)
    rows = _rows(docs, id_col, text_col, part)
    spans = _spans(rows, unique, width, anchor or max(1, min(6, width // 3)))
    cut = rows.join(_of_docs(spans, unique), ["doc", "part"], "left").select("doc", "part", "text", "runs")
    made = cut.mapInArrow(_removal(width), "doc long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string")
    return made.select(key_id("doc").alias(id_col), "n_words", "n_removed", "removed", "kept_text")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """All columns of `docs`, with repeated passages cut from the text; every row stays. Odd rows as in remove_repeats()."""
    part_of, unique = _part(docs, id_col, text_col)
    spans = _of_docs(_spans(_rows(docs, id_col, text_col, part_of), unique, width, max(1, min(6, width // 3))), unique)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([_cut(text, at, n, width)[3] for text, at, n in zip(texts, starts, sizes)], dtype=object)

    text = F.col(quoted(text_col))
    none = F.array().cast("array<long>")
    doc, part, at, n = fresh(docs, "doc", "part", "at", "n")
    found = docs.withColumns({doc: id_key(F.col(quoted(id_col))), part: part_of})
    found = found.join(spans.select(F.col("doc").alias(doc), F.col("part").alias(part), F.col("runs.at").alias(at), F.col("runs.n").cast("array<long>").alias(n)), [doc, part], "left")
    changed = F.col(at).isNotNull()
    kept = cut(F.when(changed, text_bytes(text)).otherwise(F.lit(b"")), F.coalesce(at, none), F.coalesce(n, none))
    return found.select(*[F.when(changed, kept).otherwise(text).alias(c) if c == text_col else F.col(quoted(c)) for c in docs.columns])
