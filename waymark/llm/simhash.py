"""Near-duplicate groups of documents by SimHash and deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Of two fingerprints with at most three differing bits,
one segment differs by at most one bit, so some variant of that segment with one bit wildcarded is equal in both.
Variants are the keys of an equality match; a match is verified by the Hamming distance of whole fingerprints.

What is matched are distinct fingerprints, never documents: copies share one. Within a key only the links of a
spanning forest leave the task, so large groups of near copies cost no pairs. Keys with more fingerprints than
`dense` are cut anew by the bits that their key leaves open (16-bit, then 8-bit segments), which bounds every
group at 2**11 fingerprints without losing a link.

This is the form with exact bit distances. `similar.py` holds the same method for groups by shingle similarity, which
needs wider prints, and drops near-duplicates by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_key, key_id, stage, text_bytes, word_spans
from .components import connected_components

#: Fingerprints within this many bits are linked; two segments with one wildcard are exact up to three.
MAX_DISTANCE = 3


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of one text: majority over the bits of XXH64 of its word shingles, repeats included."""
    return int(_fingerprints([text], shingle, seed)[0])


def _fingerprints(texts: list[bytes], shingle: int, seed: int) -> np.ndarray:
    out = np.zeros(len(texts), dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for k, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        plain = b" ".join(words)
        if len(words) <= shingle:
            out[k] = digest(plain, seed)
            continue
        starts, ends = word_spans(np.frombuffer(plain, dtype=np.uint8))
        n = len(words) - shingle + 1
        spans = zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())
        hashes = np.fromiter((digest(plain[a:b], seed) for a, b in spans), dtype=np.uint64, count=n)
        counts = np.zeros(64, dtype=np.int64)
        for lo in range(0, n, 1 << 16):
            bits = np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64)
            counts += bits.sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0]
    return out


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = 3, seed: int = 42, name: str = "fp") -> DataFrame:
    """All columns and the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def prints(texts):
        return texts.__class__(_fingerprints(list(texts), shingle, seed).view(np.int64))

    return docs.withColumn(name, prints(text_bytes(F.col(f"`{text_col}`"))))


def _variants(open_bits: Column, width: int, segments: int) -> Column:
    """Array of keys: every segment of `width` bits with each of its bits cleared in turn, tagged by segment and bit."""
    made = []
    for s in range(segments):
        part = F.shiftrightunsigned(open_bits, s * width).bitwiseAND(F.lit((1 << width) - 1))
        made += [part.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << b))).bitwiseOR(F.lit((s * width + b) << 32)) for b in range(width)]
    return F.array(*made)


def _forest(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph that joins values within `distance` bits."""
    left, links, queue = values, [], []
    while len(left) or queue:
        if not queue:
            if len(left) == 1:
                break
            queue, left = [left[0]], left[1:]
        hub = queue.pop()
        near = np.bitwise_count(left ^ hub) <= distance
        if near.any():
            found = left[near].tolist()
            links += [(int(hub), x) for x in found]
            queue += [np.uint64(x) for x in found]
            left = left[~near]
        if not len(left):
            break
    return links


def _link_runs(distance: int, dense: int, last: bool):
    """Reads rows sorted by key; yields links, or the rows of keys with too many fingerprints."""
    schema = pa.schema([("spilled", pa.bool_()), ("k1", pa.int64()), ("k2", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])

    def batch(over: bool, k1, k2, u, v) -> pa.RecordBatch:
        n = len(u)
        return pa.record_batch([pa.array(np.full(n, over)), pa.array(np.resize(np.asarray(k1, dtype=np.int64), n)), pa.array(np.resize(np.asarray(k2, dtype=np.int64), n)), pa.array(u, type=pa.int64()), pa.array(v, type=pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the run that may go on in the next batch
        key, spilled = None, False
        u: list[int] = []
        v: list[int] = []

        def close():
            nonlocal held
            values = np.concatenate(held) if held else np.empty(0, dtype=np.uint64)
            held = []
            if not spilled and len(values) > 1:
                for a, b in _forest(np.unique(values), distance):
                    u.append(a)
                    v.append(b)

        for b in batches:
            k = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            fp = b.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(fp):
                continue
            cuts = np.concatenate(([0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1, [len(fp)]))
            sizes = np.diff(cuts)
            # runs wholly inside the batch, but for its first and last
            inner = np.arange(1, len(sizes) - 1)
            pairs = cuts[inner[sizes[inner] == 2]]
            near = pairs[np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= distance]
            near = near[fp[near] != fp[near + 1]]
            u.extend(fp[near].tolist())
            v.extend(fp[near + 1].tolist())
            for i in sorted({0, len(sizes) - 1} | set(inner[sizes[inner] > 2].tolist())):
                lo, hi = cuts[i], cuts[i + 1]
                this = tuple(k[:, lo].tolist())
                if this != key:
                    close()
                    key, spilled = this, False
                held.append(fp[lo:hi])
                if not last and (spilled or sum(map(len, held)) > dense):
                    rows = np.concatenate(held)
                    held, spilled = [], True
                    yield batch(True, key[0], key[1], rows.view(np.int64), np.zeros(len(rows), dtype=np.int64))
            if len(u) >= 50_000:
                yield batch(False, 0, 0, np.array(u, dtype=np.uint64).view(np.int64), np.array(v, dtype=np.uint64).view(np.int64))
                u, v = [], []
        close()
        if u:
            yield batch(False, 0, 0, np.array(u, dtype=np.uint64).view(np.int64), np.array(v, dtype=np.uint64).view(np.int64))

    return run


def fingerprint_links(prints: DataFrame, fp: str = "fp", distance: int = MAX_DISTANCE, dense: int = 4096) -> DataFrame:
    """Distinct fingerprints (longs) to (u, v) links whose components are those of all links within `distance`."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments with one wildcard are exact for distances 0 to 3")
    spark = prints.sparkSession
    rows = prints.select(F.explode(_variants(F.col(fp), 32, 2)).alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).cast("long").alias("k3"), F.col(fp).alias("fp"))
    found = []
    for level in (1, 2, 3):
        made = rows.repartition("k1", "k2", "k3").sortWithinPartitions("k1", "k2", "k3", "fp")
        made = stage(made.mapInArrow(_link_runs(distance, dense, level == 3), "spilled boolean, k1 long, k2 long, u long, v long"), f"links{level}")
        found.append(made.where("not spilled").select("u", "v"))
        over = made.where("spilled")
        if level == 3 or over.isEmpty():
            break
        # the key's tag is segment * width + bit; what it leaves open is the other segment
        if level == 1:
            rest = F.when(F.shiftrightunsigned("k1", 32) < 32, F.shiftrightunsigned("u", 32)).otherwise(F.col("u")).bitwiseAND(F.lit(0xFFFFFFFF))
            rows = over.select("k1", F.explode(_variants(rest, 16, 2)).alias("k2"), F.lit(0).cast("long").alias("k3"), F.col("u").alias("fp"))
        else:
            rest = F.when(F.shiftrightunsigned("k1", 32) < 32, F.shiftrightunsigned("u", 32)).otherwise(F.col("u")).bitwiseAND(F.lit(0xFFFFFFFF))
            rest = F.when(F.shiftrightunsigned("k2", 32) < 16, F.shiftrightunsigned(rest, 16)).otherwise(rest).bitwiseAND(F.lit(0xFFFF))
            rows = over.select("k1", "k2", F.explode(_variants(rest, 8, 2)).alias("k3"), F.col("u").alias("fp"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, distance: int = MAX_DISTANCE, dense: int = 4096) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id.

    A document's component is the smallest id reachable over links of at most `distance` bits.
    Null or empty texts have fingerprint zero and link like any other; a null id counts as smaller than
    every id, so a component that holds one has a null component_id; repeated rows give repeated rows;
    an empty table gives an empty table; other columns are ignored.
    """
    made = with_fingerprint(docs.select(id_key(F.col(f"`{id_col}`")).alias("id"), F.col(f"`{text_col}`").alias("text")), "text", shingle, seed)
    made = stage(made.select("id", "fp"), "fingerprints")
    classes = made.groupBy("fp").agg(F.min("id").alias("least"))
    linked = connected_components(fingerprint_links(classes.select("fp"), "fp", distance, dense))
    joint = classes.join(linked, classes.fp == linked.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    joint = stage(joint, "classes")
    first = joint.groupBy("c").agg(F.min("least").alias("component"))
    named = joint.join(first, "c").select("fp", "component")
    return made.join(named, "fp").select(key_id("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), key_id("component").alias("component_id"))
