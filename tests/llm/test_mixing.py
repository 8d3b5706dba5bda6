"""Mixing against a plain version of the same permutations, and its targets."""

import math
import struct

import pytest
import xxhash

from waymark.llm.mixing import budget_to_cover, entropy, fit_exponent, mix_sources, mixed_documents, most_repeats, tempered

TOKENS = {"a": 1000, "b": 100, "c": 10, "d": 0}


def test_tempering():
    used = {s: n for s, n in TOKENS.items() if n}
    assert tempered(used, 1.0) == pytest.approx({s: n / 1110 for s, n in used.items()})
    assert tempered(used, 0.0) == pytest.approx({s: 1 / 3 for s in used})
    assert tempered({}, 0.5) == {}


def test_exponent_meets_targets():
    used = {s: n for s, n in TOKENS.items() if n}
    target = 0.8 * math.log(3)
    assert entropy(tempered(used, fit_exponent(used, target))) == pytest.approx(target, abs=1e-6)
    sharp = fit_exponent(used, 0.1 * math.log(3))
    assert sharp > 1 and entropy(tempered(used, sharp)) == pytest.approx(0.1 * math.log(3), abs=1e-6)
    assert fit_exponent(used, 0.1 * math.log(3), most=1.0) == 1.0  # a floor only
    assert most_repeats(used, tempered(used, fit_exponent(used, 0.1 * math.log(3), 1.05, 1110)), 1110) <= 1.05 + 1e-9
    assert fit_exponent({"a": 5, "b": 5}, 0.1) == 64.0
    for limit in (1.5, 4.0, 20.0):
        t = fit_exponent(used, max_repeats=limit, budget=1110)
        assert most_repeats(used, tempered(used, t), 1110) <= limit + 1e-9
        assert t == 0 or most_repeats(used, tempered(used, t - 1e-6), 1110) > limit - 1e-3
    weights = tempered(used, 0.5)
    assert all(weights[s] * budget_to_cover(used, weights) >= n - 1e-6 for s, n in used.items())


def corpus(spark, sizes):
    rows = [(k * 1000 + i, " ".join(["w"] * (5 + i % 7)), s, "x") for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, epoch string").repartition(3)


def used_tokens(rows):
    out = {}
    for r in rows:
        out[r["source"]] = out.get(r["source"], 0) + r["n_tokens"]
    return out


def test_budgets_are_met(spark):
    docs = corpus(spark, {"big": 900, "mid": 150, "low": 20})
    rows = mix_sources(docs, entropy_share=0.9, max_repeats=4, block_tokens=200).collect()
    got, total = used_tokens(rows), sum(5 + i % 7 for n in (900, 150, 20) for i in range(n))
    weights = {r["source"]: r["weight"] for r in rows}
    for s, w in weights.items():
        assert abs(got[s] - w * total) <= 12  # the last document may pass the budget
    # each epoch but the last holds every document once; an epoch is a set of whole blocks but for one
    natural = {"big": 900, "mid": 150, "low": 20}
    for s, n in natural.items():
        epochs = {}
        for r in rows:
            if r["source"] == s:
                epochs.setdefault(r["epoch"], []).append(r)
        for e, mine in epochs.items():
            assert len({r["doc_id"] for r in mine}) == len(mine)
            if e < max(epochs):
                assert len(mine) == n
    # positions run from 0 to about 1 in every source
    for s in natural:
        at = sorted(r["position"] for r in rows if r["source"] == s)
        assert 0 <= at[0] and at[-1] <= 1.2


def plain_mixture(docs, entropy_share, block_tokens, seed=1700001):
    """(doc_id, epoch) pairs: tokens counted, weights bisected by a scan, and permutations walked one document at a time."""
    hashed = docs.selectExpr("doc_id", "coalesce(source, '') source", "text", f"shiftrightunsigned(xxhash64(coalesce(cast(doc_id as long), {-(2**63)}L), {seed}), 11) as k").collect()
    rows = [(r["doc_id"], r["source"], len((r["text"] or "").encode().split()), r["k"]) for r in hashed]
    totals = {}
    for _, s, n, _ in rows:
        totals[s] = totals.get(s, 0) + n
    used = {s: n for s, n in totals.items() if n}

    def shares(t):
        raised = {s: n**t for s, n in used.items()}
        return {s: x / sum(raised.values()) for s, x in raised.items()}

    def spread(t):
        return -sum(w * math.log(w) for w in shares(t).values())

    lo, hi = 0.0, 64.0  # entropy falls as the exponent grows
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if spread(mid) <= entropy_share * math.log(len(used)) else (mid, hi)
    weights, total, out = shares(hi), sum(used.values()), []

    def order(*parts):
        """Spark's xxhash64 of strings, longs and ints (here the seed alone), without its lowest bits."""
        h = 42
        for p in parts:
            h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else struct.pack("<i" if p is seed else "<q", p), seed=h)
        return h >> 11

    for s, n in totals.items():
        mine = [r for r in rows if r[1] == s]
        if not n:
            out += [(r[0], 0) for r in mine]
            continue
        budget = round(weights[s] * total)
        whole, rest = budget // n, budget % n
        out += [(r[0], e) for r in mine for e in range(whole)]
        cells = min(1 << 16, max(1, math.ceil(block_tokens * (1 << 16) / n)))
        blocks = {}
        for r in mine:
            blocks.setdefault((r[3] % (1 << 16)) // cells, []).append(r)
        ordered = sorted(blocks, key=lambda b: (order(s, b, whole, seed), b))
        for b in ordered:
            if rest <= 0:
                break
            size, room = sum(r[2] for r in blocks[b]), rest
            rest -= size
            if size <= room:
                # a block that ends on the budget is the last; documents without tokens after its last hash are left
                taken = blocks[b]
            else:
                taken = []
            if rest <= 0:
                taken = []
                for r in sorted(blocks[b], key=lambda r: order(r[3], whole)):
                    if room <= 0:
                        break
                    taken.append(r)
                    room -= r[2]
            out += [(r[0], whole) for r in taken]
    return sorted(out, key=repr)


@pytest.mark.parametrize("share", [0.9, 0.3])
def test_against_plain_permutations(spark, share):
    docs = corpus(spark, {"big": 160, "mid": 40, "low": 7})
    found = sorted(((r["doc_id"], r["epoch"]) for r in mix_sources(docs, entropy_share=share, block_tokens=200, seed=1700001).collect()), key=repr)
    assert found == plain_mixture(docs, share, 200)


def test_working_names_stay_the_callers(spark):
    docs = corpus(spark, {"big": 40, "low": 5}).selectExpr("*", "'k' as _key", "'s' as __source", "'w' as _whole", "'w' as weight", "'u' as _uses", "'p' as position")
    kept = mixed_documents(docs, entropy_share=0.9)
    assert kept.columns == docs.columns
    assert {(r["_key"], r["__source"], r["_whole"], r["weight"], r["_uses"], r["position"], r["epoch"]) for r in kept.collect()} == {("k", "s", "w", "w", "u", "p", "x")}
    assert kept.count() == mix_sources(docs, entropy_share=0.9).count()


def test_partial_epoch_takes_whole_blocks_but_one(spark):
    docs = corpus(spark, {"big": 900, "low": 100})
    rows = mix_sources(docs, entropy_share=1.0, block_tokens=300).collect()
    big = [r for r in rows if r["source"] == "big"]
    whole = {}
    for r in mix_sources(docs, block_tokens=300).collect():
        if r["source"] == "big":
            whole[r["block"]] = whole.get(r["block"], 0) + 1
    taken = {}
    for r in big:
        assert r["epoch"] == 0
        taken[r["block"]] = taken.get(r["block"], 0) + 1
    assert sum(taken[b] != whole[b] for b in taken) <= 1


def test_cover_uses_all(spark, docs, no_docs, odd_docs):
    rows = mix_sources(docs, entropy_share=0.95, max_repeats=2, budget="cover").collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert "" in {r["source"] for r in rows}  # the null source
    kept = mixed_documents(docs, entropy_share=0.95, max_repeats=2, budget="cover")
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert mixed_documents(odd_docs, budget="cover").count() == 8
    assert mix_sources(no_docs).count() == 0


def test_same_again(spark, docs):
    one = mix_sources(docs, entropy_share=0.9).collect()
    assert sorted(one, key=repr) == sorted(mix_sources(docs.repartition(7), entropy_share=0.9).collect(), key=repr)
