"""URL filters: hosts and rules against plain Python, models against plain counts."""

import math
from collections import Counter

import pytest
import xxhash

from waymark.llm.queries import URL_RULES, op7_url_filter
from waymark.llm.url_model import ORDER, _grams, judge_urls

from tests.compare import DATA


def plain(url):
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", "", None, None
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host = rest[: min(ends)] if ends else rest
    tail = rest[len(host) :]
    ends = [tail.find(c) for c in "?#" if c in tail]
    path = tail[: min(ends)] if ends else tail
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule in URL_RULES:
        verdict, place = rule.split(" ")
        h, slash, p = place.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p) and (best is None or len(place) > len(best[0])):
            best = (place, verdict)
    return host, path, *(best or (None, None))


URLS = [None, "", "no scheme", "http://EXAMPLE.com/en/7x", "http://a.example.com/en/8?q#f", "https://example.net/de/8", "http://example.net?de/", "x://y.org/es/", "http://org/es/1", "http://com", "HTTP://ÄB.Com/en/é", "a://b://c/en/", "http://notcom/en/", "http://x.com/en/\n/z", "://", "http://net/de/"]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(0, None, "h"), (None, URLS[3], "h")], "page_id long, url string, host string")
    rows = judge_urls(pages, URL_RULES).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        host, path, rule, verdict = plain(URLS[3 if r["page_id"] is None else r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")
    assert judge_urls(pages.limit(0), URL_RULES).count() == 0


def test_generated_pages(spark):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").select("page_id", "url").collect()}
    for r in op7_url_filter(spark, f"{DATA}/sf0.01").collect():
        host, path, rule, verdict = plain(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (rule is None or r["verdict"] == verdict)


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def url_hash(url):
    return signed(xxhash.xxh64_intdigest(url, seed=42))


class PlainModel:
    """Witten-Bell over dictionaries, one byte at a time."""

    def __init__(self, urls):
        self.counts = Counter()
        for u in urls:
            padded = bytes(ORDER) + u
            for t in range(ORDER, len(padded)):
                for k in range(ORDER + 1):
                    self.counts[padded[t - k : t], padded[t]] += 1
        self.total, self.kinds = Counter(), Counter()
        for (context, _), n in self.counts.items():
            self.total[context] += n
            self.kinds[context] += 1

    def p(self, context, byte):
        lower = self.p(context[1:], byte) if context else 1 / 256
        t, d = self.total[context], self.kinds[context]
        return (self.counts[context, byte] + d * lower) / (t + d) if t else lower

    def log(self, url):
        padded = bytes(ORDER) + url
        return [math.log(self.p(padded[t - ORDER : t], padded[t])) for t in range(ORDER, len(padded))]


def plain_verdicts(urls, known, risk=0.01, holdout=5):
    """{url: (score, verdict of the model)} with known {url: accepted} as (url, accepted) rows, counted, calibrated and judged by loops."""
    train = [(u, a) for u, a in known if url_hash(u) % holdout]
    good, bad = (PlainModel([u for u, a in train if a == side]) for side in (True, False))

    def score(u):
        return sum(round((a - b) * 2**20) for a, b in zip(good.log(u), bad.log(u))) / len(u) / 2**20 if u else 0.0

    held = sorted(math.floor(max(-20.0, min(0.0, score(u))) * 1000) for u, a in known if a and not url_hash(u) % holdout)
    cutoff = 0.0
    for at in sorted(set(held)):
        if at >= 0 or sum(h <= at for h in held) > risk * len(held):
            cutoff = min(0.0, at / 1000)
            break
    return {u: (score(u), "block" if score(u) < cutoff else "allow") for u in urls}


def test_grams():
    grams, sizes = _grams([b"ab", b"", b"http://a.b/c1"])
    assert sizes.tolist() == [2, 0, 13] and len(grams) == 15
    assert grams[:2].tolist() == [97, 97 << 8 | 98] and grams[-1] == int.from_bytes(b".b/c1"[-6:].rjust(6, b"a"), "big")


@pytest.mark.parametrize("given", [False, True])
def test_scores_and_verdicts_against_plain_counts(spark, given):
    """Repeated URLs count each time; verdicts outside the rules are the model's."""
    rows = [(i, u) for i, u in enumerate(URLS + [f"https://h{i % 9}.{'com/en' if i % 3 else 'net/de'}/p{i % 40}" for i in range(250)] + [f"http://h{i}.other/{'abc' * (i % 4)}" for i in range(30)])]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    examples = [(u or "", i % 3 == 0) for i, u in rows if u is not None and i % 2] if given else None
    df = spark.createDataFrame(examples, "url string, accepted boolean") if given else None
    found = judge_urls(pages, URL_RULES, examples=df, risk=0.1).collect()
    if not given:
        examples = [(u or "", plain(u)[3] == "allow") for _, u in rows if plain(u)[2]]
    want = plain_verdicts({(u or "").encode() for _, u in rows}, [(u.encode(), a) for u, a in examples], 0.1)
    urls = dict(rows)
    for r in found:
        score, verdict = want[(urls[r["page_id"]] or "").encode()]
        assert math.isclose(r["score"], score, abs_tol=1e-5)
        assert r["verdict"] == (plain(urls[r["page_id"]])[3] or verdict)
    assert {r["verdict"] for r in found if not r["rule"]} >= {"block"}


def test_learns_to_reject(spark):
    good = [f"https://site{i}.example/news/story-{i}" for i in range(300)]
    bad = [f"http://win{i}.bets/?bonus=casino{i}&x=free" for i in range(300)]
    examples = spark.createDataFrame([(u, True) for u in good[:200]] + [(u, False) for u in bad[:200]], "url string, accepted boolean")
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(good[200:] + bad[200:])], "page_id long, url string")
    rows = {r["page_id"]: r["verdict"] for r in judge_urls(pages, [], examples=examples).collect()}
    assert sum(rows[i] == "allow" for i in range(100)) >= 95
    assert sum(rows[i] == "block" for i in range(100, 200)) >= 95
    only = judge_urls(pages, [], examples=examples.where("accepted")).select("verdict").distinct().collect()
    assert [r[0] for r in only] == ["allow"]


def test_bad_rule():
    from waymark.llm.url_model import parse_rule

    with pytest.raises(ValueError):
        parse_rule("deny com/")
