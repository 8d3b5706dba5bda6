"""Shared helpers of the training-data operators: staging, words and hashes."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null id sorts before every other id.
NULL_ID = -(2**63)

#: Bytes that part words: space and \t \n \v \f \r.
SPACE_BYTES = (9, 10, 11, 12, 13, 32)
SPACE_CLASS = r"[\x20\x09-\x0D]"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACE_BYTES)] = True

#: Words are hashed in blocks of about this many bytes, so that memory stays flat for very long texts.
_BLOCK = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where a local session sets none."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(spark.sparkContext, "_waymark_shared", None)
        if base is None:
            base = spark.sparkContext._waymark_shared = "file://" + tempfile.mkdtemp(prefix="waymark-")
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns, unlike any column of the table."""
    taken = {c.lower() for c in df.columns}
    mark = "_"
    while any((mark + n).lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def all_of(df: DataFrame) -> list[Column]:
    """The table's columns, whatever their names hold."""
    return [df[quoted(c)] for c in df.columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


#: Fewer keys than this are heavy.
HEAVY = 5000


def join_heavy(rows: DataFrame, table: DataFrame, on: list[str], count: str) -> DataFrame:
    """rows joined with a staged table of one row per key; `count` is how many rows meet the key.

    Keys that more than one in HEAVY of these rows meet are fewer than HEAVY, so they are broadcast, and no task gathers
    a hot key; the others are dealt by key.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    heavy = table.where(F.col(count) * HEAVY > F.lit(total))
    rest = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(table.where(F.col(count) * HEAVY <= F.lit(total)), on)
    return rows.join(F.broadcast(heavy), on).unionByName(rest)


def id_key(column: str | Column) -> Column:
    """A never-null long for a possibly null id."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("long"), F.lit(NULL_ID))


def key_id(column: str | Column) -> Column:
    """The id of an id_key()."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column != NULL_ID, column)


def text_bytes(column: str | Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit("")).cast("binary")


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each run of bytes other than ASCII white space."""
    word = ~_SPACE[buf]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    return edges[::2], edges[1::2]


@lru_cache(maxsize=4)
def _family(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random byte codes, powers of an odd base and of its inverse, modulo 2**64."""
    rng = np.random.default_rng(seed)
    codes = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = (int(rng.integers(2**40, 2**62)) & ~7) | 3
    inverse = pow(base, -1, 2**64)
    powers, inverses = np.ones(2 * _BLOCK, dtype=np.uint64), np.ones(2 * _BLOCK, dtype=np.uint64)
    for table, step in ((powers, base), (inverses, inverse)):
        n = 1
        while n < len(table):
            table[n : 2 * n] = table[:n] * np.uint64(pow(step, n, 2**64))
            n *= 2
    return codes, powers, inverses


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each word's bytes: Rabin-Karp over prefix sums, then scrambled."""
    out = np.empty(len(starts), dtype=np.uint64)
    codes, powers, inverses = _family(seed)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + _BLOCK, side="right")))
        size = int(ends[j - 1] - lo)
        if size <= len(powers):
            sums = np.zeros(size + 1, dtype=np.uint64)
            np.cumsum(codes[buf[lo : lo + size]] * powers[:size], out=sums[1:])
            out[i:j] = (sums[ends[i:j] - lo] - sums[starts[i:j] - lo]) * inverses[starts[i:j] - lo]
        else:  # one word longer than the tables: fold it block by block
            total = np.uint64(0)
            for at in range(int(lo), int(ends[i]), _BLOCK):
                part = codes[buf[at : min(at + _BLOCK, int(ends[i]))]]
                total = mix64(np.array([total + (part * powers[: len(part)]).sum()], dtype=np.uint64))[0]
            out[i] = total
        i = j
    return mix64(out + (ends - starts).astype(np.uint64))


def window_hashes(values: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Rabin-Karp hashes (modulo 2**64) of every window of `width` consecutive values, by doubling."""
    if len(values) < width:
        return np.empty(0, dtype=np.uint64)
    n = len(values) - width + 1
    out = np.zeros(n, dtype=np.uint64)
    power, span, done = values, 1, 0
    while True:
        if width & span:
            out = out * np.uint64(pow(base, span, 2**64)) + power[done : done + n]
            done += span
        if span * 2 > width:
            return out
        power = power[:-span] * np.uint64(pow(base, span, 2**64)) + power[span:]
        span *= 2


def chunks(texts: list[bytes], most: int = 1 << 20):
    """Slices of a batch of texts that hold about `most` bytes together; a longer text stands alone."""
    lo = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield lo, i
            lo, size = i, 0
        size += len(text) + 1
    if lo < len(texts):
        yield lo, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts parted by newlines, and where each begins (and the end)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    return buf, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
