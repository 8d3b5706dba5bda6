"""Fill-in-the-middle: a text is cut into prefix, middle and suffix, which are told in another order.

Cuts are drawn in units (code points, or lines), but texts are bytes. The starts of the units of a batch of texts make up one packed
bitvector with a directory of the ones before each block; ranks at a text's ends give its number of units n, and select
on two ranks gives the bytes where it is cut, so that no text is decoded or walked unit by unit.

Draws come from the row's own key alone: h1 to h4 are the first four 8-digit groups of the hex sha256 of `1:` and the
key. The prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, quoted, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: 64-bit words to a block of the directory.
BLOCK = 8


class Boundaries:
    """A packed bitvector with the number of ones before each block: rank and select for many places at once."""

    def __init__(self, marks: np.ndarray):
        self.size = len(marks)
        packed = np.zeros(-(-self.size // (64 * BLOCK)) * 8 * BLOCK + 8 * BLOCK, dtype=np.uint8)
        packed[: -(-self.size // 8)] = np.packbits(marks, bitorder="little")
        self.words = packed.view("<u8").reshape(-1, BLOCK)
        self.counts = np.bitwise_count(self.words)
        self.before = np.concatenate(([0], np.cumsum(self.counts.sum(axis=1, dtype=np.int64))))
        self.total = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before these places."""
        block, bit = np.divmod(at, 64 * BLOCK)
        word, bit = np.divmod(bit, 64)
        earlier = np.where(np.arange(BLOCK) < word[:, None], self.counts[block], 0).sum(axis=1, dtype=np.int64)
        low = (np.uint64(1) << bit.astype(np.uint64)) - np.uint64(1)
        return self.before[block] + earlier + np.bitwise_count(self.words[block, word] & low)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Places of the ones of these ranks (from 0); the vector's size for the rank after the last."""
        out = np.full(len(k), self.size, dtype=np.int64)
        inside = np.flatnonzero(k < self.total)
        k = k[inside]
        block = np.searchsorted(self.before, k, side="right") - 1
        rest = k - self.before[block]
        upto = np.cumsum(self.counts[block], axis=1, dtype=np.int64)
        word = (upto <= rest[:, None]).sum(axis=1)
        rest -= np.where(word > 0, np.take_along_axis(upto, np.maximum(word - 1, 0)[:, None], axis=1)[:, 0], 0)
        bits = np.unpackbits(self.words[block, word][:, None].view(np.uint8), axis=1, bitorder="little")
        bit = (np.cumsum(bits, axis=1, dtype=np.int64) <= rest[:, None]).sum(axis=1)
        out[inside] = block * 64 * BLOCK + word * 64 + bit
        return out


def _marks(buf: np.ndarray, starts: np.ndarray, unit: str) -> np.ndarray:
    """Where units begin in texts that follow one another."""
    if unit == "char":
        return (buf & 0xC0) != 0x80
    marks = np.zeros(len(buf), dtype=bool)
    marks[1:] = buf[:-1] == 10
    marks[starts[:-1][starts[:-1] < starts[1:]]] = True
    return marks


def cut(texts: list[bytes], first: np.ndarray, second: np.ndarray, unit: str = "char") -> tuple[np.ndarray, ...]:
    """Of each text: its units n, the units of prefix and of prefix with middle, and the bytes where both end."""
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    bounds = Boundaries(_marks(buf, starts, unit))
    ranks = bounds.rank(starts)
    n = np.diff(ranks)
    a, b = first % (n + 1), second % (n + 1)
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    return n, lo, hi, bounds.select(ranks[:-1] + lo) - starts[:-1], bounds.select(ranks[:-1] + hi) - starts[:-1]


_CUT = "n long, prefix long, middle long, output binary"
_CUT_ARROW = pa.struct([("n", pa.int64()), ("prefix", pa.int64()), ("middle", pa.int64()), ("output", pa.binary())])


def _cutter(unit: str):
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    @F.arrow_udf(_CUT)
    def cut_texts(text: pa.Array, form: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        sizes = [len(x.as_buffer()) for x in text]
        forms, h1, h2 = form.to_pylist(), first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False)
        parts = []
        at = 0
        for lo, hi in chunks([range(x) for x in sizes]):
            texts = text.slice(lo, hi - lo).to_pylist()
            n, pre, mid, x, y = cut(texts, h1[lo:hi], h2[lo:hi], unit)
            out = []
            for t, f, i, j in zip(texts, forms[lo:hi], x.tolist(), y.tolist()):
                if f == "psm":
                    t = b"".join((p, t[:i], s, t[j:], m, t[i:j]))
                elif f == "spm":
                    t = b"".join((s, t[j:], p, t[:i], m, t[i:j]))
                out.append(t)
            plain = np.array([f == "plain" for f in forms[lo:hi]], dtype=bool)
            columns = [pa.array(n), pa.array(pre, mask=plain), pa.array(mid - pre, mask=plain), pa.array(out, pa.binary())]
            parts.append(pa.StructArray.from_arrays(columns, fields=list(_CUT_ARROW)))
            at = hi
        return pa.concat_arrays(parts) if at else pa.array([], _CUT_ARROW)

    return cut_texts


def _draw(key: Column, group: int) -> Column:
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", column: str = "fim", rate: int = 90, suffix_first: int = 20, unit: str = "char") -> DataFrame:
    """The table with one more column: struct<n, form, prefix, middle, output>.

    n: the text's units; form: `plain` (the text as it is), `psm` (`<P>`prefix`<S>`suffix`<M>`middle) or `spm`
    (`<S>`suffix`<P>`prefix`<M>`middle); prefix, middle: units in these, null where plain; output: the text told anew.
    `rate` of 100 rows are cut, `suffix_first` of 100 of those are spm. Texts that hold a mark stay plain, so restored()
    is exact. Rows are judged one by one and none is shuffled.

    Null texts count as empty, empty texts stay plain (n 0), null keys count as an empty key, rows that share a key share
    their draws, an empty table gives an empty one, a column named `column` is replaced, others stay whatever their names.
    Very long texts are cut whole, one at a time. unit: `char` (code points) or `line` (with its newline).
    """
    if unit not in ("char", "line"):
        raise ValueError("unit is char or line")
    whole, k = text_bytes(docs[quoted(text)]), docs[quoted(key)]
    string = whole.cast("string")
    marked = F.contains(string, F.lit(PREFIX)) | F.contains(string, F.lit(SUFFIX)) | F.contains(string, F.lit(MIDDLE))
    plain = (F.octet_length(whole) == 0) | marked | (_draw(k, 3) % 100 >= rate)
    form = F.when(plain, "plain").when(_draw(k, 4) % 100 < suffix_first, "spm").otherwise("psm")
    made = _cutter(unit)(whole, form, _draw(k, 1), _draw(k, 2))
    fields = {"n": made["n"], "form": form, "prefix": made["prefix"], "middle": made["middle"], "output": made["output"].cast("string")}
    return docs.withColumn(column, F.struct(*(v.alias(n) for n, v in fields.items())))


def restored(fim: Column) -> Column:
    """The exact text, rebuilt from output and form alone."""
    output, form = fim["output"], fim["form"]
    body = F.substring(output, 1 + len(PREFIX), 2**31 - 1)
    ends = F.substring_index(body, MIDDLE, 1)
    middle = F.substring_index(body, MIDDLE, -1)
    psm = F.concat(F.substring_index(ends, SUFFIX, 1), middle, F.substring_index(ends, SUFFIX, -1))
    spm = F.concat(F.substring_index(ends, PREFIX, -1), middle, F.substring_index(ends, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
