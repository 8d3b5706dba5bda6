"""Near-duplicate groups of documents at a shingle similarity, by wide SimHash prints and deletion-variant signatures.

A text is the set of hashes of its word shingles (a shorter text has one, all its words); texts with the same set are
one class. Two sets of Jaccard similarity s differ in a bit of their SimHash with a chance of acos(2s / (1 + s)) / pi
at most, about 0.15 for 0.8. A print is therefore wide, and cut into so many segments that a pair at the similarity
has a segment that differs by at most one bit with a chance of `recall` at least (`segments_for`); for pairs that are
more alike, and for those whose prints differ in fewer than twice as many bits as there are segments, it is surer or
certain. Segments grow with the logarithm of the number of texts, so that a key holds about as many classes at any
size. The variants of a segment, each with one bit wildcarded, are the keys of an equality match. A match is verified
by the whole print inside the key's group, then by the sizes and the whole sets. A pair counts only in the first key
that it shares.

Keys with few matches yield all of them. The members of others are compared once more after the first links are verified,
with their sets at hand: only members in different components by then, and what joins two components is told once. So
that few are apart by then, each class is linked to an earlier one near it, once for each segment that they have alike.
For that, members go to the home of their segment's own value once, and to that of a value that differs by the wildcard
bit only from the smaller side of a key. So large groups of near copies yield few rows, and no two members stay apart unseen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, id_key, key_id, mix64, quoted, stage, text_bytes, window_hashes, word_hashes, word_spans
from .components import connected_components

#: A key holds about 2**LOAD classes.
LOAD = 6
#: Keys with up to this many classes are matched in one table; larger ones around leaders.
_SMALL = 512
#: Pairs are made in blocks of about this many.
_BLOCK = 1 << 16


def shingle_set(text: bytes, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased text's shingles; empty for a text without words."""
    buf = np.frombuffer(text.lower(), dtype=np.uint8)
    starts, ends = word_spans(buf)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    values = word_hashes(buf, starts, ends, seed)
    return np.unique(mix64(window_hashes(values, min(shingle, len(values))) + np.uint64(min(shingle, len(values)))))


def set_hash(values: np.ndarray) -> np.uint64:
    """A hash of a whole sorted set."""
    return np.uint64(len(values)) + mix64(values + np.arange(1, len(values) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)


def bit_chance(similarity: float) -> float:
    """The chance that a SimHash bit differs between sets of a Jaccard similarity, at most."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def bits_for(n: int) -> int:
    """Bits of a segment, for n texts."""
    return min(40, max(8, math.ceil(math.log2(max(2, n))) + 1 - LOAD))


def segments_for(bits: int, similarity: float, recall: float) -> int:
    """Segments that a print needs, so that one of them differs by at most one bit with a chance of `recall`."""
    p = bit_chance(similarity)
    one = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - one))) if one < 1 else 1


def distance_for(bits: int, similarity: float, miss: float = 1e-4) -> int:
    """The most differing bits that a pair at the similarity has, but for a chance of `miss`."""
    p = bit_chance(similarity)
    below = 0.0
    for k in range(bits + 1):
        below += math.comb(bits, k) * p**k * (1 - p) ** (bits - k)
        if below >= 1 - miss:
            return k
    return bits


def wide_print(values: np.ndarray, width: int) -> np.ndarray:
    """SimHash of a set in `width` 64-bit numbers: majority over the bits of as many scramblings of each hash."""
    out = np.zeros(width, dtype=np.uint64)
    for w in range(width):
        counts = np.zeros(64, dtype=np.int64)
        for lo in range(0, len(values), 1 << 16):
            mixed = mix64(values[lo : lo + (1 << 16)] + np.uint64(0x9E3779B97F4A7C15 * (w + 1) & (2**64 - 1)))
            counts += np.unpackbits(mixed.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(counts * 2 > len(values), bitorder="little").view(np.uint64)[0]
    return out


def variant_keys(prints: np.ndarray, bits: int, segments: int) -> np.ndarray:
    """Rows of prints to rows of keys: every segment with each of its bits cleared in turn, tagged by segment and bit."""
    flags = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")[:, : bits * segments]
    parts = flags.reshape(len(prints), segments, bits).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
    masks = ~(1 << np.arange(bits, dtype=np.int64))
    tags = (np.arange(segments)[:, None] * bits + np.arange(bits)).astype(np.int64) << 40
    return ((parts[:, :, None] & masks) | tags).reshape(len(prints), -1)


def _keyed(bits: int, segments: int, width: int):
    schema = pa.schema([(c, pa.int64()) for c in ("key", "same", *_words(width))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = b.column(0).to_numpy(zero_copy_only=False)
            prints = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint64).reshape(-1, width)
            for lo in range(0, len(same), 2000):
                keys = variant_keys(prints[lo : lo + 2000], bits, segments)
                again = [np.repeat(c[lo : lo + 2000], keys.shape[1]) for c in (same, *prints.view(np.int64).T)]
                yield pa.record_batch([pa.array(keys.ravel()), *map(pa.array, again)], schema=schema)

    return run


def _words(width: int) -> list[str]:
    return [f"p{w}" for w in range(width)]


def _near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Where prints (along the last axis) differ in at most `most` bits."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32) <= most


def _masks(bits: int, segments: int, width: int) -> np.ndarray:
    """The bits of each segment in the words of a print."""
    flags = np.zeros((segments, 64 * width), dtype=np.uint8)
    for s in range(segments):
        flags[s, s * bits : (s + 1) * bits] = 1
    return np.packbits(flags, axis=1, bitorder="little").view(np.uint64)


def _is_first(apart: np.ndarray, key: int, bits: int, segments: int) -> np.ndarray:
    """Whether a key that pairs share is the first that they do, by their prints' differences (pairs x words)."""
    segment, bit = divmod(int(key) >> 40, bits)
    masks = _masks(bits, segments, apart.shape[1])
    # a segment that differs by one bit is shared with that bit cleared, an equal one with any
    own = np.bitwise_count(apart & masks[segment]).sum(axis=1, dtype=np.int16)
    at = np.flatnonzero((own == 1) | ((own == 0) & (bit == 0)))
    for s in range(segment):
        at = at[np.bitwise_count(apart[at] & masks[s]).sum(axis=1, dtype=np.int16) > 1]
    out = np.zeros(len(apart), dtype=bool)
    out[at] = True
    return out


def _is_first_segment(apart: np.ndarray, segment: int, bits: int, segments: int) -> np.ndarray:
    """Whether pairs that share a key of this segment share none of an earlier one."""
    masks = _masks(bits, segments, apart.shape[1])
    at = np.arange(len(apart))
    for s in range(segment):
        at = at[np.bitwise_count(apart[at] & masks[s]).sum(axis=1, dtype=np.int16) > 1]
    out = np.zeros(len(apart), dtype=bool)
    out[at] = True
    return out


def _values(prints: np.ndarray, bits: int, segments: int) -> np.ndarray:
    """Rows of prints to rows of their segments' values."""
    flags = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")[:, : bits * segments]
    return flags.reshape(len(prints), segments, bits).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def _homes(bits: int, segments: int, width: int):
    """Classes with their prints to a row for each segment: its home (segment and value)."""
    schema = pa.schema([(c, pa.int64()) for c in ("key", "same", *_words(width))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = b.column(0).to_numpy(zero_copy_only=False)
            prints = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint64).reshape(-1, width)
            keys = _values(prints, bits, segments) | (np.arange(segments, dtype=np.int64) << 40)
            again = [np.repeat(c, segments) for c in (same, *prints.view(np.int64).T)]
            yield pa.record_batch([pa.array(keys.ravel()), *map(pa.array, again)], schema=schema)

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The rows of each key, of rows sorted by it, as columns."""
    held: list[np.ndarray] = []
    for b in batches:
        if not b.num_rows:
            continue
        rows = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)])
        starts = np.flatnonzero(rows[0, 1:] != rows[0, :-1]) + 1
        if held and held[0][0, 0] != rows[0, 0]:
            yield np.concatenate(held, axis=1)
            held = []
        cuts = [0, *starts.tolist(), rows.shape[1]]
        for lo, hi in zip(cuts[:-2], cuts[1:-1]):
            yield np.concatenate([*held, rows[:, lo:hi]], axis=1) if held else rows[:, lo:hi]
            held = []
        held.append(rows[:, cuts[-2] :])
    if held:
        yield np.concatenate(held, axis=1)


def _match(key: int, prints: np.ndarray, most: int, bits: int, segments: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of places of near prints whose first key this is, and whether others may be left out; if so, each place that has an earlier such one is in a pair."""
    m = len(prints)
    if m <= _SMALL:
        i, j = np.nonzero(np.triu(_near(prints[:, None], prints, most), 1))
        if len(i):
            first = _is_first(prints[i] ^ prints[j], key, bits, segments)
            i, j = i[first], j[first]
        if len(i) <= m // 2:
            return i, j, False
        j, at = np.unique(j, return_index=True)  # i rises, so the first is the smallest
        return i[at], j, True
    left, u, v = np.arange(m), [], []
    while len(left) > 1:
        hub, left = left[0], left[1:]
        apart = prints[left] ^ prints[hub]
        near = np.flatnonzero(np.bitwise_count(apart).sum(axis=1, dtype=np.int32) <= most)
        near = near[_is_first(apart[near], key, bits, segments)] if len(near) else near
        if len(near):
            v.append(left[near])
            u.append(np.full(len(near), hub))
            left = np.delete(left, near)
    return (np.concatenate(u), np.concatenate(v), True) if u else (left[:0], left[:0], False)


def _matched(most: int, bits: int, segments: int, width: int):
    """Rows sorted by key to pairs (u, v); of keys that are to be compared once more, the homes wanted (u: home, v: 1 if
    its members are to be compared with each other) and the guests of homes (u: home, v, print)."""
    schema = pa.schema([("kind", pa.string()), *((c, pa.int64()) for c in ("u", "v", *_words(width)))])

    def batch(kind: str, *columns: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array([kind] * len(columns[0])), *map(pa.array, columns)], schema=schema)

    def pairs(us: list, vs: list, kind: str = "pair") -> pa.RecordBatch:
        u, v = np.concatenate(us), np.concatenate(vs)
        return batch(kind, u, v, *[np.zeros(len(u), dtype=np.int64)] * width)

    def once_more(key: int, same: np.ndarray, words: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        segment, bit = divmod(key >> 40, bits)
        values = _values(np.stack(words, axis=1).view(np.uint64), bits, segments)[:, segment]
        set_bit = (values >> bit & 1).astype(bool)
        home = (segment << 40) | (key & ((1 << 40) - 1))
        homes = home, home | (1 << bit)
        sides = np.flatnonzero(~set_bit), np.flatnonzero(set_bit)
        large = int(len(sides[1]) > len(sides[0]))
        guests = sides[1 - large]
        if bit == 0:  # here pairs with equal segments are told too
            wanted = [h for h, side in zip(homes, sides) if len(side) > 1]
            if wanted:
                yield pairs([np.array(wanted)], [np.ones(len(wanted), dtype=np.int64)], "home")
        if len(guests):
            yield pairs([np.array([homes[large]])], [np.zeros(1, dtype=np.int64)], "home")
            yield batch("guest", np.full(len(guests), homes[large]), same[guests], *[w[guests] for w in words])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us: list[np.ndarray] = []
        vs: list[np.ndarray] = []
        n = 0
        for key, same, *words in _groups(batches):
            if len(same) < 2:
                continue
            i, j, more = _match(key[0], np.stack(words, axis=1).view(np.uint64), most, bits, segments)
            if more:
                yield from once_more(int(key[0]), same, words)
                if int(key[0] >> 40) % bits:
                    continue  # first links are told under the first variant of a segment; all pairs are compared once more
            if not len(i):
                continue
            us.append(np.minimum(same[i], same[j]))
            vs.append(np.maximum(same[i], same[j]))
            n += len(i)
            if n >= _BLOCK:
                yield pairs(us, vs)
                us, vs, n = [], [], 0
        if n:
            yield pairs(us, vs)

    return run


def _bitsets(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of bits for the members that at least two sets hold: all that intersections need."""
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    place = np.cumsum(shared) - 1
    keep = shared[at]
    out = np.zeros((len(sets), max(1, -(-int(shared.sum()) // 64))), dtype=np.uint64)
    bit = place[at[keep]]
    np.bitwise_or.at(out, (of[keep], bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out


def _joining(key: int, alone: bool, guest: np.ndarray, labels: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], similarity: float, most: int, bits: int, segments: int) -> Iterator[tuple[int, int]]:
    """Places of members in different components whose sets have the similarity, in the first segment that they share; a pair that joins components already joined is left out.

    Guests are compared with members that are at home, these with each other unless guests came `alone` for them.
    """
    shared, sizes = _bitsets(sets), np.array([len(s) for s in sets])
    labels = labels.copy()
    step = max(1, _BLOCK // len(labels))
    for lo in range(0, len(labels), step):
        hi = min(lo + step, len(labels))
        near = (labels[lo:hi, None] != labels) & (np.arange(lo, hi)[:, None] < np.arange(len(labels)))
        near &= (guest[lo:hi, None] != guest) if alone else ~(guest[lo:hi, None] & guest)
        near &= np.minimum(sizes[lo:hi, None], sizes) >= similarity * np.maximum(sizes[lo:hi, None], sizes) - 1e-9
        near &= _near(prints[lo:hi, None], prints, most)
        i, j = np.nonzero(near)
        if not len(i):
            continue
        i += lo
        first = _is_first_segment(prints[i] ^ prints[j], key >> 40, bits, segments)
        i, j = i[first], j[first]
        both = np.concatenate([np.bitwise_count(shared[i[k : k + 4096]] & shared[j[k : k + 4096]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), 4096)]) if len(i) else np.empty(0, np.int64)
        for a, b in np.stack([i, j], axis=1)[both / (sizes[i] + sizes[j] - both) >= similarity].tolist():
            if labels[a] != labels[b]:
                labels[labels == labels[b]] = labels[a]
                yield a, b


def _across(similarity: float, most: int, bits: int, segments: int):
    """Rows (key, c, same, part, set, print) sorted by the first two to pairs (u, v) that join components; part: 0 for guests, 1 at home, 2 at home and to be compared with each other."""

    def pairs(rows: list[list]) -> pa.RecordBatch:
        key, c, same, part, sets, *words = rows
        prints, part = np.array(words, dtype=np.int64).T.view(np.uint64), np.array(part)
        found = list(_joining(key[0], bool(part.max() < 2), part == 0, np.array(c, dtype=np.int64), np.ascontiguousarray(prints), [np.frombuffer(x, dtype=np.uint64) for x in sets], similarity, most, bits, segments))
        return pa.record_batch([pa.array([min(same[a], same[b]) for a, b in found], pa.int64()), pa.array([max(same[a], same[b]) for a, b in found], pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            keys = np.array(columns[0], dtype=np.int64)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if held and lo < len(keys) and held[0][0] != columns[0][lo]:
                    yield pairs(held)
                    held = []
                part = [c[lo:hi] for c in columns]
                held = [h + p for h, p in zip(held, part)] if held else part
        if held and held[0]:
            yield pairs(held)

    return run


def _set_hashes(shingle: int, seed: int):
    """A text's set as an array, and as the bytes of its sorted numbers."""

    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, shingle, seed).view(np.int64) for t in texts])

    @F.pandas_udf("binary")
    def blobs(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, shingle, seed).tobytes() for t in texts])

    return hashes, blobs


def _sets(wanted: DataFrame, classes: DataFrame, texts: DataFrame, hashes) -> DataFrame:
    """(same, hashes) of the wanted classes, each made from one of its texts."""
    wanted = classes.join(wanted, "same", "left_semi").select("same", "least.id", "least.th")
    return texts.join(wanted, ["id", "th"]).select("same", hashes("text").alias("hashes")).dropDuplicates(["same"])


def _similar(pairs: DataFrame, classes: DataFrame, texts: DataFrame, similarity: float, hashes) -> DataFrame:
    """The pairs (u, v) of classes whose whole sets have the similarity."""
    sizes = [classes.select(F.col("same").alias(s), F.col("n").alias(f"n{s}")) for s in "uv"]
    near = pairs.join(sizes[0], "u").join(sizes[1], "v").where(F.least("nu", "nv") >= similarity * F.greatest("nu", "nv") - 1e-9)
    near = stage(near.select("u", "v"), "near")
    sets = stage(_sets(near.select(F.col("u").alias("same")).union(near.select("v")).distinct(), classes, texts, hashes), "sets")
    left, right = (sets.select(F.col("same").alias(s), F.col("hashes").alias(h)) for s, h in (("u", "a"), ("v", "b")))
    both = F.size(F.array_intersect("a", "b"))
    return stage(near.join(right, "v").join(left, "u").where(both / (F.size("a") + F.size("b") - both) >= similarity).select("u", "v"), "similar")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text_bytes(text))


def _members(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, recall: float, seed: int) -> DataFrame:
    """(id, th, same, c): each row's id key, hash of its text, class, and a number for the class's component."""
    text = F.col(quoted(text_col))
    texts = docs.select(id_key(F.col(quoted(id_col))).alias("id"), _text_hash(text).alias("th"), text_bytes(text).alias("text"))
    bits = bits_for(docs.count())
    segments = segments_for(bits, similarity, recall)
    width = max(2, -(-bits * segments // 64))

    @F.pandas_udf("struct<n long, same long, print binary>")
    def sketches(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, shingle, seed) for t in texts]
        same = np.array([set_hash(s) for s in sets], dtype=np.uint64).view(np.int64)
        return pd.DataFrame({"n": [len(s) for s in sets], "same": same, "print": [wide_print(s, width).tobytes() for s in sets]})

    made = stage(texts.select("id", "th", sketches("text").alias("s")).select("id", "th", "s.*"), "sketches")
    classes = made.groupBy("same").agg(F.min(F.struct("id", "th")).alias("least"), F.max("n").alias("n"), F.max("print").alias("print"))
    classes = stage(classes, "classes")
    most, (hashes, blobs) = distance_for(64 * width, similarity), _set_hashes(shingle, seed)
    words = _words(width)
    longs = ", ".join(f"{w} long" for w in words)

    rows = classes.where("n > 0").select("same", "print").mapInArrow(_keyed(bits, segments, width), f"key long, same long, {longs}")
    rows = rows.repartition("key").sortWithinPartitions("key", "same").mapInArrow(_matched(most, bits, segments, width), f"kind string, u long, v long, {longs}")
    rows = stage(rows, "matches")
    links = _similar(rows.where("kind = 'pair'").select("u", "v"), classes, texts, similarity, hashes)
    labels = stage(connected_components(links), "labels")
    homes = rows.where("kind = 'home'").groupBy(F.col("u").alias("key")).agg((F.max("v") + 1).alias("part"))
    if not homes.isEmpty():
        at_home = classes.where("n > 0").select("same", "print").mapInArrow(_homes(bits, segments, width), f"key long, same long, {longs}").join(homes, "key")
        again = at_home.unionByName(rows.where("kind = 'guest'").select(F.col("u").alias("key"), F.col("v").alias("same"), *words, F.lit(0).cast("long").alias("part")))
        again = stage(again.join(labels, again.same == labels.node, "left").select("key", F.coalesce("component", "same").alias("c"), "same", "part", *words), "again")
        sets = stage(_sets(again.select("same").distinct(), classes, texts, blobs), "sets")
        again = again.join(sets, "same").select("key", "c", "same", "part", "hashes", *words)
        more = again.repartition("key").sortWithinPartitions("key", "c", "same").mapInArrow(_across(similarity, most, bits, segments), "u long, v long")
        labels = stage(connected_components(links.unionByName(stage(more, "more"))), "labels")
    named = labels.select(F.col("node").alias("same"), F.col("component").alias("c"))
    return stage(made.select("id", "th", "same").join(named, "same", "left").select("id", "th", "same", F.coalesce("c", "same").alias("c")), "members")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, recall: float = 0.98, seed: int = 42) -> DataFrame:
    """One row per document: id, component_id, the smallest id reachable over links of at least the similarity.

    Null or empty texts are alike; a null id counts as smaller than every id, so a component that holds one has a
    null component_id; repeated rows give repeated rows; an empty table gives an empty table; other columns are ignored.
    """
    made = _members(docs, id_col, text_col, shingle, similarity, recall, seed)
    first = made.groupBy("c").agg(F.min("id").alias("component"))
    return made.join(first, "c").select(key_id("id").alias(id_col), key_id("component").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id, of several texts under it by hash. All columns are kept.

    Options are those of similar_groups(). Rows that share an id but whose texts are not alike are all kept; of rows
    alike in id and text one stays, whatever their other columns hold. A null id counts as the smallest; null and
    empty texts are alike, so one of them stays; an empty table gives an empty table.
    """
    made = _members(docs, id_col, text_col, **({"shingle": 5, "similarity": 0.8, "recall": 0.98, "seed": 42} | options))
    key, th = fresh(docs, "key", "hash")
    stays = made.groupBy("c").agg(F.min(F.struct("id", "th")).alias("first")).select(F.col("first.id").alias(key), F.col("first.th").alias(th))
    rows = docs.withColumns({key: id_key(F.col(quoted(id_col))), th: _text_hash(F.col(quoted(text_col)))})
    return rows.join(stays, [key, th], "left_semi").dropDuplicates([key, th]).select(*[F.col(quoted(c)) for c in docs.columns])
