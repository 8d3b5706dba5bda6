"""Quality rules against brute force; bounds against exact sums."""

import math

import pytest

from tests.compare import DATA
from waymark.llm.quality_rules import GRID, LEVELS, RULES, fit_cutoffs, judge_quality, last_step, measure, upper_bound


def plain(text):
    text = text or ""
    words = text.encode().split()
    lines = text.split("\n")
    dup = sum(bool(x.encode().split()) and x in lines[:i] for i, x in enumerate(lines))
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= set(range(i, i + 5))
    n = len(words)
    return n, sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_counts(docs):
    short = docs.where("text is null or length(text) < 8000")
    want = {r["doc_id"]: plain(r["text"]) for r in short.collect()}
    for r in measure(short).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want[r["id"]]


def test_counts_on_generated_documents(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").where("length(text) < 4000")
    want = {r["doc_id"]: plain(r["text"]) for r in rows.collect()}
    for r in measure(rows).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want[r["id"]]


@pytest.mark.parametrize("k, n", [(0, 1), (0, 50), (3, 40), (20, 300), (299, 300)])
def test_upper_bound_is_exact(k, n):
    for error in (0.05, 0.001):
        p = upper_bound(k, n, error)
        tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert tail == pytest.approx(error, rel=1e-6)
    assert upper_bound(n, n, 0.05) == 1.0


def test_walk_stops_at_the_first_failure():
    assert last_step([0] * 30 + [500] + [0] * 10, 1000, 0.02, 0.01) == 29
    assert last_step([0] * 41, 10, 0.02, 0.01) == last_step([0] * 41, 0, 0.02, 0.01) == -1
    assert last_step([0] * 41, 1000, 0.02, 0.01) == 40


def plain_cutoffs(rows, quality, risk, error):
    """{(stratum, rule): cutoff} of measured rows and {id: 0 or 1}, by plain loops over documents and exact tails."""
    rows = [r for r in rows if not r["base_failed"]]
    strata = sorted({r["stratum"] for r in rows})
    tested = sum(any(r["stratum"] == s and quality.get(r["id"]) == 1 for r in rows) for s in strata)

    def within(k, n):  # the exact bound is at most risk: so few are improbable at a rate of risk
        return n > 0 and k < n and sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1)) <= error / tested

    out = {}
    for s in strata:
        mine = [r for r in rows if r["stratum"] == s]
        rest, bad, good = ([r for r in mine if quality.get(r["id"], -1) == y] for y in (-1, 0, 1))
        laid, counts = {}, {rule: [[sum(r[rule] >= c for r in side) for c in GRID] for side in (rest, bad)] for rule in RULES}
        ratios = [((a + 1 if a else 0) / (len(rest) + 1)) / ((b - 1) / len(bad)) * (1 + 2 / math.sqrt(b)) for pair in counts.values() for a, b in zip(*pair) if b >= 10]
        bad_share = min([1.0, *ratios]) if ratios else 0.0
        for rule in RULES:
            above, worse = counts[rule]
            lost, at = 0.0, []
            for a, b in zip(above, worse):
                now = ((a + 1 if a else 0) / (len(rest) + 1) - bad_share * max(b - 1, 0) / max(1, len(bad))) if rest else 1.0
                lost = max(lost, now)
                at.append(lost)
            laid[rule] = []
            for level in LEVELS:
                fits = [k for k in range(len(GRID)) if at[k] <= level + 1e-12]
                caught = worse[fits[-1]] if fits else 0
                laid[rule].append(worse.index(caught) if caught >= 2 else None)
        step = -1
        for k in range(len(LEVELS)):
            lost = sum(any(laid[r][k] is not None and x[r] >= GRID[laid[r][k]] for r in RULES) for x in good)
            if not within(lost, len(good)):
                break
            step = k
        for rule in RULES:
            out[s, rule] = None if step < 0 or laid[rule][step] is None else GRID[laid[rule][step]]
    return out


@pytest.mark.parametrize("risk, error", [(0.02, 0.05), (0.1, 0.2)])
def test_cutoffs_and_verdicts_against_plain_loops(spark, risk, error):
    d = f"{DATA}/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    measured = measure(docs).cache()
    rows, quality = measured.collect(), {r["doc_id"]: r["quality"] for r in labels.collect()}
    want = plain_cutoffs(rows, quality, risk, error)
    found = {(r["stratum"], rule): r[f"max_{rule}"] for r in fit_cutoffs(measured, labels, risk=risk, error=error).collect() for rule in RULES}
    assert found == want and any(c is not None for c in found.values())
    kept = {r["doc_id"]: (r["kept"], r["failed_rules"]) for r in judge_quality(docs, labels, risk=risk, error=error).collect()}
    for r in rows:
        failed = [rule for rule in RULES if want[r["stratum"], rule] is not None and r[rule] >= want[r["stratum"], rule]]
        assert kept[r["id"]] == (not r["base_failed"] and not failed, failed)


def test_risk_holds_on_fresh_labels(spark):
    """Cutoffs from one half of the labels lose at most `risk` of the good documents of the other half, and reject bad ones."""
    d = f"{DATA}/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = judge_quality(spark.read.parquet(f"{d}/documents.parquet"), labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    for s in ("en", "de", "fr"):
        good = [bool(r["failed_rules"]) for r in rows if r["stratum"] == s and r["quality"] == 1 and not r["base_failed"]]
        assert sum(good) <= 0.02 * len(good)
    bad = [r["kept"] for r in rows if r["stratum"] == "en" and r["quality"] == 0]
    assert sum(bad) < 0.1 * len(bad)


def test_odd_rows(spark, docs, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (5, 1), (None, 1), (7, None)], "doc_id long, quality int")
    rows = judge_quality(odd_docs, labels).collect()
    assert len(rows) == 8 and all(r["base_failed"] for r in rows if r["n_words"] == 0)
    assert all(r["kept"] != r["base_failed"] for r in rows)  # too few labels: no cutoff
    assert judge_quality(no_docs, labels).count() == 0
    assert judge_quality(docs, labels.limit(0)).count() == docs.count()
    both = spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, quality int")
    assert fit_cutoffs(measure(docs), both).count() == 0
    assert set(RULES) <= set(measure(docs).columns)
