"""URL filters: explicit rules, and a character language-model ratio for the rest.

Two Markov models of variable order (contexts of 0 to ORDER bytes, Witten-Bell smoothed) are counted over all accepted
and all rejected URLs. A URL's score is the log-likelihood difference per byte; it is blocked below a cutoff that is
calibrated on held-out URLs to reject at most `risk` of the accepted ones.

The models are tables in Spark: counts of every sequence of ORDER + 1 bytes that the examples hold, and from them, order
by order, those of shorter contexts. What they hold grows with the examples. The log ratio of each distinct sequence in
the URLs to be judged is found once by joins, and a URL's score is a sum over its sequences.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_heavy, quoted, stage

ORDER = 5
#: Log ratios are summed as whole numbers of this fraction, so that sums do not depend on their order.
_UNIT = 1 << 20


def _grams(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the ORDER bytes before it (zeros before a URL) as a number, of all URLs, and each URL's length."""
    sizes = np.array([len(u) for u in urls], dtype=np.int64)
    buf = np.frombuffer(b"".join(bytes(ORDER) + u for u in urls), dtype=np.uint8).astype(np.int64)
    grams = np.zeros(max(0, len(buf) - ORDER), dtype=np.int64)
    for k in range(ORDER + 1):
        grams = grams << 8 | buf[k : len(buf) - ORDER + k]
    # gram t ends at byte t + ORDER; those that end in the zeros before a URL are not its own
    real = np.ones(len(buf), dtype=bool)
    begins = np.concatenate(([0], np.cumsum(sizes + ORDER)[:-1])) if len(urls) else np.empty(0, dtype=np.int64)
    for k in range(ORDER):
        real[begins + k] = False
    return grams[real[ORDER:]], sizes


def _exploded(rows: DataFrame) -> DataFrame:
    """(bytes, tag) to (gram, tag), a row for each byte."""
    schema = pa.schema([("gram", pa.int64()), ("tag", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                grams, sizes = _grams(part.column(0).to_pylist())
                yield pa.record_batch([pa.array(grams), pa.array(np.repeat(part.column(1).to_numpy(zero_copy_only=False), sizes))], schema=schema)

    return rows.select("bytes", "tag").mapInArrow(run, "gram long, tag long")


def count_grams(examples: DataFrame) -> DataFrame:
    """(gram, n0, n1): how often rejected and accepted URLs (bytes, accepted) hold each sequence."""
    rows = _exploded(examples.select("bytes", F.col("accepted").cast("long").alias("tag")))
    return rows.groupBy("gram").agg(F.count_if(F.col("tag") == 0).alias("n0"), F.count_if(F.col("tag") == 1).alias("n1"))


def _tail(gram: str | Column, size: int) -> Column:
    return (F.col(gram) if isinstance(gram, str) else gram).bitwiseAND(F.lit((1 << 8 * size) - 1))


def log_ratios(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, n, ratio): for each distinct gram the log of accepted over rejected probability of its last byte, in units.

    With t examples of a context, d distinct bytes among them and n of this byte, a probability is (n + d * p) / (t + d),
    where p is that after the context without its first byte; 1 / 256 before any context.
    """
    found = None
    for order in range(ORDER + 1):
        level = counts.groupBy(_tail("gram", order + 1).alias("tail")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        byte = _tail("tail", 1).cast("int")
        entries = F.collect_list(F.struct(byte.alias("k"), F.struct("n0", "n1").alias("v")))  # at most 256 to a context
        totals = [f(F.col(f"n{s}")).alias(f"{c}{s}") for s in (0, 1) for c, f in (("t", F.sum), ("d", lambda n: F.count_if(n > 0)))]
        contexts = level.groupBy(F.shiftrightunsigned("tail", 8).alias("context")).agg(F.map_from_entries(entries).alias("bytes"), *totals)
        tails = grams.select(_tail("gram", order + 1).alias("tail")).distinct()
        tails = tails.withColumn("context", F.shiftrightunsigned("tail", 8)).join(contexts, "context", "left")
        if found is None:
            tails = tails.withColumns({f"p{s}": F.lit(1 / 256) for s in (0, 1)})
        else:
            tails = tails.withColumn("shorter", _tail("tail", order)).join(found.withColumnRenamed("tail", "shorter"), "shorter")
        seen = F.try_element_at("bytes", byte)
        p = [F.when(F.col(f"t{s}") > 0, (F.coalesce(seen[f"n{s}"], F.lit(0)) + F.col(f"d{s}") * F.col(f"p{s}")) / (F.col(f"t{s}") + F.col(f"d{s}"))).otherwise(F.col(f"p{s}")).alias(f"p{s}") for s in (0, 1)]
        found = tails.select("tail", *p)
    ratio = F.round((F.log("p1") - F.log("p0")) * _UNIT).cast("long")
    return grams.join(found.select(F.col("tail").alias("gram"), ratio.alias("ratio")), "gram").select("gram", "n", "ratio")


def parse_rule(rule: str) -> tuple[str, str, str]:
    """'allow example.com/en/7' to (verdict, host, path)."""
    verdict, _, place = rule.partition(" ")
    host, slash, path = place.partition("/")
    if verdict not in ("allow", "block"):
        raise ValueError(f"a rule begins with allow or block: {rule}")
    return verdict, host.lower(), slash + path


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end."""
    url = F.col(url) if isinstance(url, str) else url
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase), part(2)


def _with_rules(rows: DataFrame, rules: list[str]) -> DataFrame:
    """Adds rule and by_rule to rows with host and path. A host's own suffixes are looked up, so many rules cost no more."""
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, host, path in map(parse_rule, rules):
        by_host.setdefault(host, []).append((path, host + path, verdict))
    shared = rows.sparkSession.sparkContext.broadcast(by_host)  # the caller's own list

    @F.pandas_udf("rule string, verdict string")
    def match(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        known = shared.value
        out = []
        for host, path in zip(hosts, paths):
            labels = host.split(".") if host else []
            fits = [(len(name), name, verdict) for k in range(len(labels)) for start, name, verdict in known.get(".".join(labels[k:]), ()) if path.startswith(start)]
            out.append(max(fits)[1:] if fits else (None, None))
        return pd.DataFrame(out, columns=["rule", "verdict"])

    return rows.withColumn("matched", match("host", "path")).select(*rows.columns, F.col("matched.rule").alias("rule"), F.col("matched.verdict").alias("by_rule"))


def _scored(urls: DataFrame, counts: DataFrame | None) -> DataFrame:
    """(url, rows, score) of distinct URLs (url: a hash, bytes, rows); an empty URL scores 0, and so do all without a model."""
    if counts is None:
        return urls.select("url", "rows", F.lit(0.0).alias("score"))
    positions = stage(_exploded(urls.select("bytes", F.col("url").alias("tag"))), "positions")
    grams = stage(positions.groupBy("gram").agg(F.count("*").alias("n")), "grams")
    ratios = stage(log_ratios(grams, counts), "ratios")
    sums = join_heavy(positions, ratios, ["gram"], "n").groupBy(F.col("tag").alias("url")).agg((F.sum("ratio") / F.count("*") / _UNIT).alias("score"))
    return urls.select("url", "rows").join(sums, "url", "left").select("url", "rows", F.coalesce("score", F.lit(0.0)).alias("score"))


def judge_urls(pages: DataFrame, rules: list[str], id_col: str = "page_id", url_col: str = "url", examples: DataFrame | None = None, risk: float = 0.01, holdout: int = 5) -> DataFrame:
    """One row per page: id, host, path, rule, verdict (allow or block), score.

    `examples` (url, accepted boolean) are what the models learn; by default the URLs that the rules decide. One URL
    in `holdout` by hash is kept for calibration. The longest rule that fits decides; for the rest the score does.
    With no accepted or no rejected examples all the rest is allowed. Null URLs and URLs without :// have an empty
    host and path and are judged like any text (null as ''); repeated rows are judged alike; an empty table gives
    an empty table; other columns are ignored. URLs are told apart by a 64-bit hash.
    """
    host, path = host_and_path(F.col(quoted(url_col)))
    raw = F.coalesce(F.col(quoted(url_col)), F.lit("")).cast("binary")
    rows = pages.select(F.col(quoted(id_col)).alias("id"), raw.alias("bytes"), host.alias("host"), path.alias("path"))
    ruled = stage(_with_rules(rows, rules).withColumn("url", F.xxhash64("bytes")), "ruled")
    if examples is None:
        known = ruled.where("by_rule is not null").select("bytes", (F.col("by_rule") == "allow").alias("accepted"))
    else:
        known = examples.where("url is not null and accepted is not null").select(F.col("url").cast("binary").alias("bytes"), "accepted")
    known = known.withColumn("url", F.xxhash64("bytes")).withColumn("fold", F.pmod("url", F.lit(holdout)))
    counts = stage(count_grams(known.where("fold <> 0")), "counts")
    both = counts.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    learned = bool(both["n0"] and both["n1"])
    held = known.where("fold = 0 and accepted").select("url", "bytes", F.lit(0).alias("page"))
    urls = ruled.select("url", "bytes", F.lit(1).alias("page")).unionByName(held)
    urls = stage(urls.groupBy("url").agg(F.first("bytes").alias("bytes"), F.sum("page").alias("rows")), "urls")
    scores = stage(_scored(urls, counts if learned else None), "scores")
    cutoff = _calibrate(held.join(scores, "url"), risk) if learned else -np.inf
    verdict = F.coalesce("by_rule", F.when(F.col("score") < F.lit(float(cutoff)), "block").otherwise("allow"))
    judged = join_heavy(ruled.select("id", "host", "path", "rule", "by_rule", "url"), scores, ["url"], "rows")
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")


def _calibrate(accepted: DataFrame, risk: float, cells: int = 1000) -> float:
    """The largest cutoff, at most 0, below which at most `risk` of accepted URLs fall; in steps of 1 / cells."""
    binned = accepted.select(F.floor(F.greatest(F.lit(-20.0), F.least(F.lit(0.0), F.col("score"))) * cells).alias("bin"))
    counts = binned.groupBy("bin").agg(F.count("*").alias("n")).orderBy("bin").collect()  # at most 20 * cells + 1 rows
    total, below = sum(r["n"] for r in counts), 0
    for r in counts:
        if r["bin"] >= 0 or below + r["n"] > risk * total:
            return min(0.0, r["bin"] / cells)
        below += r["n"]
    return 0.0 if total else -np.inf
