"""Best-fit packing of token sequences by large-item matching.

Sizes are whole numbers from 1 to the capacity, so the whole packing is decided on the histogram of sizes: items
above a third of the capacity are matched greedily, at most two to a bin (the largest item takes the largest
partner that fits); smaller items go, largest first, into the smallest gap that holds them. The plan names bins for
ranges of ranks within a size. It has as many entries as sizes and gaps ask for, whatever the number of documents,
and is exact: it places every item as the one-by-one algorithm over the whole corpus would. Ranks are counted in
hashed buckets, so that no size, however common, is gathered in one task.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, id_key, joined, key_id, stage, text_bytes, word_hashes, word_spans

#: A worker forgets its words when it holds this many; they are only a cache.
_CACHED_WORDS = 600_000
#: Ranks are counted over buckets of about this many items.
_BUCKET_ITEMS = 20_000


@dataclass(frozen=True)
class Segment:
    """Items `rank` to `rank + count - 1` of one size: `per_bin` go side by side into each bin from `bin` on, at `offset`."""

    size: int
    rank: int
    count: int
    per_bin: int
    bin: int
    offset: int


def plan_bins(histogram: dict[int, int], capacity: int) -> list[Segment]:
    """Bins for all items of a histogram of sizes (1 to capacity)."""
    left = {s: n for s, n in histogram.items() if n}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError("sizes are 1 to the capacity")
    rank: dict[int, int] = defaultdict(int)
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # gap: (first bin, bins)
    out: list[Segment] = []
    bins = 0

    def place(size: int, count: int, per_bin: int, first: int, gap: int) -> None:
        out.append(Segment(size, rank[size], count, per_bin, first, capacity - gap))
        rank[size] += count
        left[size] -= count

    for a in sorted((s for s in left if 3 * s > capacity), reverse=True):
        while left[a]:
            b = next((s for s in range(min(a, capacity - a), capacity // 3, -1) if left.get(s, 0) > (s == a)), 0)
            n = left[a] // 2 if b == a else min(left[a], left[b]) if b else left[a]
            place(a, n, 1, bins, capacity)
            if b:
                place(b, n, 1, bins, capacity - a)
            gaps[capacity - a - b].append((bins, n))
            bins += n
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        gap = s
        while left[s]:
            while gap < capacity and not gaps[gap]:
                gap += 1
            per_bin = gap // s
            first, n = gaps[gap].pop() if gaps[gap] else (bins, -(-left[s] // per_bin))
            bins = max(bins, first + n)
            full = min(n, left[s] // per_bin)
            if full:
                place(s, full * per_bin, per_bin, first, gap)
                gaps[gap - per_bin * s].append((first, full))
            used = full
            if used < n and 0 < left[s]:
                rest = left[s]
                place(s, rest, rest, first + used, gap)
                gaps[gap - rest * s].append((first + used, 1))
                used += 1
            if used < n:
                gaps[gap].append((first + used, n - used))
    return out


def _byte_letters() -> str:
    """The letters by which byte-level vocabularies write bytes: printable bytes as they are, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(others)) for b in range(256))


_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_SMALL = (_BYTES >= 97) & (_BYTES <= 122)
_MARK = np.isin(_BYTES, list(b".,!?;:*&%$#|"))


#: Longer words are merged one at a time; so many words are merged side by side.
_LONGEST, _SIDE_BY_SIDE = 32, 1 << 14
_NO_MERGE = np.int32(2**31 - 1)


class Merges:
    """The merges of a byte-level vocabulary with word ends, for many words side by side.

    In each round every word takes its next merge: the one of lowest rank, the leftmost of equal ones.
    """

    def __init__(self, tokenizer):
        model = json.loads(tokenizer.to_str())["model"]
        vocabulary, end, letters = model["vocab"], model.get("end_of_word_suffix") or "", _byte_letters()
        inner, last = ([vocabulary.get(x + mark, -1) for x in letters] for mark in ("", end))
        self.fits = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "ignore_merges")) and min(inner + last) >= 0
        if not self.fits:
            return
        self.none = max(vocabulary.values()) + 1  # the id beyond a word's ends
        made = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.made = np.array([vocabulary[a + b] for a, b in made], dtype=np.int32)
        pairs = self._pair(np.array([vocabulary[a] for a, _ in made], dtype=np.int64), np.array([vocabulary[b] for _, b in made], dtype=np.int64))
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = np.append(pairs[order], 2**62), np.append(order, 0).astype(np.int32)
        self.first = np.array(inner + last, dtype=np.int32)  # of a byte, and of one that ends its word
        codes = np.repeat(self.first, len(self.first)), np.tile(self.first, len(self.first))
        self.start = self._keys(*codes, np.int32(0)).reshape(len(self.first), -1)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.int64) * (self.none + 1) + b

    def _keys(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank and place of the merge of a and b, as one number; _NO_MERGE if there is none."""
        pair = self._pair(a, b)
        i = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[i] == pair, self.ranks[i] * _LONGEST + at, _NO_MERGE).astype(np.int32)

    def apply(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and how many each word has, of words of at most _LONGEST bytes that stand one after another in `data`."""
        longest, n = int(sizes.max()), len(sizes)
        begins = np.cumsum(sizes) - sizes
        word, place = np.repeat(np.arange(n), sizes), np.arange(len(data)) - np.repeat(begins, sizes)
        codes = data.astype(np.int64)
        codes[begins + sizes - 1] += 256
        # a column for each word; the last row is beyond its ends
        ids = np.full((longest + 1, n), self.none, dtype=np.int32)
        ids[place, word] = self.first[codes]
        alive = ids != self.none
        keys = np.full((longest + 1, n), _NO_MERGE, dtype=np.int32)
        both = np.flatnonzero(word[1:] == word[:-1])
        start = self.start[codes[both], codes[both + 1]]
        keys[place[both], word[both]] = np.where(start == _NO_MERGE, start, start + place[both])
        after, before = (np.repeat(np.arange(longest + 1, dtype=np.int32)[:, None] + step, n, axis=1) for step in (1, -1))
        after[sizes - 1, np.arange(n)] = longest
        while True:
            best = keys.min(axis=0)
            at = np.flatnonzero(best != _NO_MERGE)
            if not len(at):
                return ids.T[alive.T], alive.sum(axis=0)
            best = best[at]
            left, made = best % _LONGEST, self.made[best // _LONGEST]
            right, prior = after[left, at], before[left, at]
            then = after[right, at]
            ids[left, at], alive[right, at], keys[right, at] = made, False, _NO_MERGE
            after[left, at], before[then, at] = then, left
            keys[left, at] = self._keys(made, ids[then, at], left)
            keys[prior, at] = self._keys(ids[prior, at], made, prior)


def _gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of `data` one after another, and where each begins."""
    begins = np.cumsum(lengths) - lengths
    return data[np.repeat(starts - begins, lengths) + np.arange(int(lengths.sum()))], begins


def _letters_alone(text: str) -> bool:
    """Whether a text, lower-cased in A-Z, is letters alone that the tokenizer's normalizer leaves as they are."""
    return text.isalpha() and (text.isascii() or text == text.lower() and unicodedata.is_normalized("NFC", text))


class WordIds:
    """Ids of texts under a lower-casing, space-dropping tokenizer with word-end merges.

    Such a tokenizer never joins across white space, nor a letter with the marks that end a word, so these units are
    hashed, encoded once and remembered. A unit of small letters alone is one unit of the vocabulary's merges, which
    all such units take side by side; any other goes through the whole tokenizer, and so does a text that may hold
    special tokens.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Merges(self.tokenizer)
        self.letters = _byte_letters()
        self.forget()

    def forget(self) -> None:
        self.hashes, self.rows = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)  # in the order of hashes
        self.ids, self.begins, self.sizes = np.empty(0, dtype="<u4"), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def _encode(self, unit: bytes) -> list[int]:
        text = unit.decode("utf-8", "replace")
        if _letters_alone(text):
            return [t.id for t in self.tokenizer.model.tokenize(text if text.isascii() else "".join(self.letters[b] for b in unit))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Remembers the ids of units of `low`; returns the row of each."""
        lengths = ends - starts
        raw = low.tobytes()
        data, begins = _gathered(low, starts, lengths)
        fits = np.add.reduceat(_SMALL[data], begins, dtype=np.int64) == lengths
        for k in np.flatnonzero(~fits).tolist():
            fits[k] = _letters_alone(raw[starts[k] : ends[k]].decode("utf-8", "replace"))
        fits &= self.merges.fits & (lengths <= _LONGEST)
        short, rest = np.flatnonzero(fits), np.flatnonzero(~fits)
        short = short[np.argsort(lengths[short], kind="stable")]
        groups = [short[lo : lo + _SIDE_BY_SIDE] for lo in range(0, len(short), _SIDE_BY_SIDE)]
        made = [self.merges.apply(_gathered(low, starts[g], lengths[g])[0], lengths[g]) for g in groups]
        others = [self._encode(raw[starts[k] : ends[k]]) for k in rest.tolist()]
        sizes = np.concatenate([n for _, n in made] + [np.fromiter(map(len, others), dtype=np.int64, count=len(others))])
        rows = np.empty(len(sizes), dtype=np.int64)
        rows[np.concatenate((short, rest))] = np.arange(len(self.sizes), len(self.sizes) + len(sizes))
        self.begins = np.concatenate((self.begins, len(self.ids) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.ids = np.concatenate([self.ids, *(ids for ids, _ in made), np.fromiter(chain.from_iterable(others), dtype="<u4")], dtype="<u4", casting="unsafe")
        return rows

    def batch(self, texts: list[bytes]) -> list[np.ndarray]:
        """Little-endian 32-bit ids of each text."""
        if len(self.rows) > _CACHED_WORDS:
            self.forget()
        special = [k for k, t in enumerate(texts) if b"<|" in t]
        buf, offsets = joined([b"" if b"<|" in t else t for t in texts] if special else texts)
        low = _LOWER[buf]
        starts, ends = word_spans(low)
        # where the marks that end a word begin
        letters = np.maximum.accumulate(np.where(_MARK[low], -1, np.arange(len(low))))
        cut = np.maximum(letters[ends - 1] + 1, starts)
        two = (cut > starts) & (cut < ends) & _SMALL[low[cut - 1]]
        counts = 1 + two
        first = np.cumsum(counts) - counts
        unit_starts, unit_ends = np.repeat(starts, counts), np.repeat(ends, counts)
        unit_ends[first[two]] = unit_starts[first[two] + 1] = cut[two]
        hashes, unit = np.unique(word_hashes(low, unit_starts, unit_ends, 13), return_inverse=True)
        at = np.searchsorted(self.hashes, hashes)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == hashes[known]
        rows = np.empty(len(hashes), dtype=np.int64)
        rows[known] = self.rows[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            where = np.empty(len(hashes), dtype=np.int64)
            where[unit] = np.arange(len(unit))
            rows[new] = self._learn(low, unit_starts[where[new]], unit_ends[where[new]])
            self.hashes, self.rows = np.insert(self.hashes, at[new], hashes[new]), np.insert(self.rows, at[new], rows[new])
        row = rows[unit]
        sizes = self.sizes[row]
        total = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.ids[np.repeat(self.begins[row] - total[:-1], sizes) + np.arange(total[-1])]
        of_text = total[np.append(first, len(unit))[np.searchsorted(starts, offsets)]]
        out = [ids[a:b] for a, b in zip(of_text[:-1].tolist(), of_text[1:].tolist())]
        for k in special:
            out[k] = np.array(self.tokenizer.encode(texts[k].decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4")
        return out


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def _ids(texts: list[bytes], path: str) -> Iterator[bytes]:
    """Little-endian 32-bit ids of each text."""
    for lo, hi in chunks(texts):
        yield from (x.tobytes() for x in _word_ids(path).batch(texts[lo:hi]))


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Pieces of at most `capacity` ids: (doc, piece, start, length, ids_crc32[, ids]); every document ends with `end_id`."""
    end = np.array([end_id], dtype="<u4").tobytes()
    fields = [("doc", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            out: list[list] = [[] for _ in fields]
            for doc, made in zip(ids, _ids(b.column(1).to_pylist(), tokenizer_path)):
                made += end
                for piece, at in enumerate(range(0, len(made), 4 * capacity)):
                    part = made[at : at + 4 * capacity]
                    row = [doc, piece, at // 4, len(part) // 4, zlib.crc32(part)]
                    for column, value in zip(out, row + [np.frombuffer(part, dtype="<i4")] * with_ids):
                        column.append(value)
            yield pa.record_batch([pa.array(c, type=t) for c, (_, t) in zip(out, fields)], schema=schema)

    rows = docs.select(id_key(F.col(f"`{id_col}`")).alias("doc"), text_bytes(F.col(f"`{text_col}`")).alias("text"))
    return rows.mapInArrow(run, "doc long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack_items(items: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc, piece, length (1 to capacity) and ids_crc32."""
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = sorted(plan_bins(counts, capacity), key=lambda s: (s.size, s.rank))
    table = np.array([(s.size, s.rank, s.per_bin, s.bin, s.offset) for s in plan], dtype=np.int64).reshape(-1, 5)
    begins = (table[:, 0] << 48) | table[:, 1]
    shared = items.sparkSession.sparkContext.broadcast((begins, table))

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        begins, table = shared.value
        size, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        row = table[np.searchsorted(begins, (size << 48) | rank, side="right") - 1]
        at = rank - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 3] + at // row[:, 2], "offset": row[:, 4] + at % row[:, 2] * size})

    buckets = max(64, sum(counts.values()) // _BUCKET_ITEMS)
    rows = items.withColumn("bucket", F.pmod(F.xxhash64("doc", "piece"), F.lit(buckets)))
    before = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = before.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "bucket"])
    return ranked.withColumn("slot", slot("length", F.col("rank") + F.col("before"))).select(*items.columns, "slot.sequence_id", "slot.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Documents longer than `capacity` ids are cut into whole sequences and a rest; nothing else is cut. A null or
    empty text is the end id alone; repeated rows and null ids are packed like any other row; an empty table gives
    an empty table; other columns are ignored.
    """
    items = stage(tokenize_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, with_ids), "pieces")
    packed = pack_items(items, capacity)
    return packed.select(key_id("doc").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
