"""Licence scans: Dice coefficient over word bigrams, in DataFrame functions only.

Texts are normalised: A-Z lower-cased, runs of other characters than a-z and 0-9 become one space. Units and templates
are sets of word bigrams. Units are each line, a text of several lines as a whole, and windows of words, wherever they
stand and however lines break. With Dice at least t, a template of b bigrams fits only units of t * b / (2 - t) to
b * (2 - t) / t bigrams that share t * b / (2 - t) of its own at least. So:

- a text without any of a template's key words (`key_words`), which too many of its bigrams hold, is passed over whole;
- templates are listed under each size of unit that they fit, and an equality join on the size yields the candidates;
- a window that fits holds one of the template's anchors, more than b * (2 - 2 t) / (2 - t) of its bigrams. Windows as
  long as the template are laid where one of its anchors stands in its place, and each that fits is told unless a
  better one overlaps it. A text's bigrams are cut into overlapping blocks first, so work is linear in its length.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import quoted, text_bytes
from .licence_texts import TEMPLATES

#: Words that most texts hold anyway: no key words where others suffice.
_COMMON = frozenset("a all an and any are as at be but by can either for from general if in including is it language no not of on or other particular permission provided source subject such that the this to under use version was with without you".split())
#: The `line` of a text as a whole, and of a window.
TEXT, WINDOW = -1, -2


def normalised_words(text: Column) -> Column:
    return F.split(F.trim(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " "))), " ")


def all_bigrams(words: Column) -> Column:
    """The pairs of neighbouring words, in order."""
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>"))


def bigrams(words: Column) -> Column:
    return F.array_distinct(all_bigrams(words))


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def bigrams_of(text: str) -> set[tuple[str, str]]:
    words = template_words(text)
    return set(zip(words, words[1:]))


def sizes_for(b: int, dice: float) -> tuple[int, int]:
    """The least and most bigrams of a unit that a template of b bigrams can fit."""
    return max(1, math.ceil(dice * b / (2 - dice) - 1e-9)), math.floor(b * (2 - dice) / dice + 1e-9)


def key_words(text: str, dice: float) -> list[str]:
    """Words of which a unit that fits the template holds at least one: the bigrams without them are too few to fit. Rare and long ones first."""
    left, out = bigrams_of(text), []
    least = sizes_for(len(left), dice)[0]
    while left and len(left) >= least:
        counts: dict[str, int] = {}
        for pair in left:
            for w in set(pair):
                counts[w] = counts.get(w, 0) + 1
        best = min(counts, key=lambda w: (w in _COMMON, -counts[w] * len(w) ** 2, w))
        out.append(best)
        left = {p for p in left if best not in p}
    return out


def anchors(text: str, dice: float) -> list[tuple[str, int]]:
    """(bigram, word at which it stands) of so many of the template's bigrams that a unit that fits holds one; long ones first."""
    words, pairs = template_words(text), bigrams_of(text)
    chosen = set(sorted(pairs, key=lambda p: (-len(p[0]) - len(p[1]), p))[: len(pairs) - sizes_for(len(pairs), dice)[0] + 1])
    return [(" ".join(p), t) for t, p in enumerate(zip(words, words[1:])) if p in chosen]


def _templates(spark: SparkSession, templates: dict[str, str], dice: float) -> DataFrame:
    """(licence, pairs, b, size) for each size of unit that the template can fit: a table of the caller's templates alone."""
    rows = spark.createDataFrame([(name, sorted(" ".join(p) for p in bigrams_of(t))) for name, t in templates.items()], "licence string, pairs array<string>")
    rows = rows.withColumn("b", F.size("pairs"))
    least = F.greatest(F.lit(1), F.ceil(dice * F.col("b") / (2 - dice) - 1e-9)).cast("int")
    most = F.floor(F.col("b") * (2 - dice) / dice + 1e-9).cast("int")
    return rows.where("b > 0").withColumn("size", F.explode(F.sequence(least, most)))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, dice: float = 0.8) -> DataFrame:
    """One row per unit and fitting template: id, line (from 0; -1: the text as a whole, -2: a window), start, licence, dice.

    Of windows of one licence that overlap, one is told if none that overlaps it has a larger coefficient, or the same and
    an earlier start; `start` is its first word, null for other units. Very long texts are scanned whole, block by
    block. Null and empty texts fit nothing; repeated rows give repeated
    matches, but for windows, which texts alike under one id give once; units that fit several templates, tied or not,
    give a row for each; an empty table gives an empty table; other columns are ignored.
    """
    templates = {name: t for name, t in (TEMPLATES if templates is None else templates).items() if bigrams_of(t)}
    if not templates:
        return docs.select(F.col(quoted(id_col)).alias(id_col), F.lit(0).alias("line"), F.lit(0).alias("start"), F.lit("").alias("licence"), F.lit(0.0).alias("dice")).limit(0)
    keys = sorted({w for t in templates.values() for w in key_words(t, dice)})
    text = F.col(quoted(text_col))
    rows = docs.where(text.rlike(f"(?i)(?<![A-Za-z0-9])(?:{'|'.join(keys)})(?![A-Za-z0-9])")).select(F.col(quoted(id_col)).alias("id"), text.alias("text"))
    known = _templates(docs.sparkSession, templates, dice)
    found = _units(rows, templates, known, dice).unionByName(_windows(rows, templates, known, dice))
    return found.withColumnRenamed("id", id_col)


def _units(rows: DataFrame, templates: dict[str, str], known: DataFrame, dice: float) -> DataFrame:
    """Lines and whole texts that fit."""
    lines = F.split("text", "\n")
    units = rows.select("id", F.posexplode(F.when(F.size(lines) > 1, F.concat(lines, F.array("text"))).otherwise(lines)).alias("at", "unit"), F.size(lines).alias("n_lines"))
    line = F.when(F.col("at") < F.col("n_lines"), F.col("at")).otherwise(TEXT)
    # exploding an array of one keeps what is made in it from being made again by each later use
    words = units.select("id", line.alias("line"), F.explode(F.array(normalised_words(F.col("unit")))).alias("words"))
    # n distinct bigrams hold at most n + 1 distinct words: units too large for any template go before they are paired
    most = max(sizes_for(len(bigrams_of(t)), dice)[1] for t in templates.values())
    fits = F.when(F.size("words") > most + 1, F.size(F.array_distinct("words")) <= most + 1).otherwise(F.size("words") > 1)
    paired = words.where(fits).select("id", "line", F.explode(F.array(bigrams(F.col("words")))).alias("unit_pairs")).withColumn("size", F.size("unit_pairs"))
    score = 2.0 * F.size(F.array_intersect("unit_pairs", "pairs")) / (F.col("size") + F.col("b"))
    found = paired.join(F.broadcast(known), "size")
    return found.select("id", "line", F.lit(None).cast("int").alias("start"), "licence", score.alias("dice")).where(F.col("dice") >= dice)


def _windows(rows: DataFrame, templates: dict[str, str], known: DataFrame, dice: float) -> DataFrame:
    """The windows of each text that fit each licence, without those that a better one overlaps."""
    lengths = {name: len(template_words(text)) for name, text in templates.items()}
    longest = max(lengths.values())
    step, reach = 2 * longest, longest**2
    # places scaled so that windows of any licence overlap if theirs are at most `reach` apart
    places = [(pair, name, t, lengths[name], reach // max(1, lengths[name] - 1)) for name, text in templates.items() for pair, t in anchors(text, dice)]
    table = rows.sparkSession.createDataFrame(places, "pair string, licence string, place int, length int, scale long")
    every = F.lit(sorted({p[0] for p in places}))
    made = rows.select("id", F.xxhash64(text_bytes("text")).alias("text_hash"), F.explode(F.array(all_bigrams(normalised_words(F.col("text"))))).alias("all_pairs"))
    # a window lies in the block in which it starts: `step` starts to a block
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("all_pairs") - 1) / step).cast("int")), lambda k: F.struct((k * step).alias("from"), F.slice("all_pairs", k * step + 1, step + longest).alias("pairs")))
    blocks = made.where(F.size("all_pairs") > 0).select("id", "text_hash", F.explode(cut).alias("block")).select("id", "text_hash", "block.from", F.col("block.pairs").alias("block"))
    blocks = blocks.withColumn("present", F.array_intersect("block", every)).where(F.size("present") > 0)
    hits = F.filter(F.transform("block", lambda p, i: F.struct(p.alias("pair"), i.alias("at"))), lambda h: F.array_contains("present", h["pair"]))
    hits = blocks.select("id", "text_hash", "from", "block", F.explode(hits).alias("hit")).select("id", "text_hash", "from", "block", "hit.*")
    hits = hits.join(F.broadcast(table), "pair")  # bounded by the caller's templates
    inside = F.col("at") - F.col("place")
    hits = hits.withColumn("inside", F.when(F.col("from") == 0, F.greatest(F.lit(0), inside)).otherwise(inside)).where((F.col("inside") >= 0) & (F.col("inside") < step))
    laid = hits.select("id", "text_hash", "licence", "scale", (F.col("from") + F.col("inside")).alias("start"), F.explode(F.array(F.array_distinct(F.slice("block", F.col("inside") + 1, F.col("length") - 1)))).alias("unit_pairs"))
    laid = laid.withColumn("size", F.size("unit_pairs")).join(F.broadcast(known), ["size", "licence"])
    score = 2.0 * F.size(F.array_intersect("unit_pairs", "pairs")) / (F.col("size") + F.col("b"))
    fit = laid.select("id", "text_hash", "licence", "scale", "start", score.alias("dice")).where(F.col("dice") >= dice)
    fit = fit.groupBy("id", "text_hash", "licence", "scale", "start").agg(F.max("dice").alias("dice"))
    near = Window.partitionBy("id", "text_hash", "licence").orderBy(F.col("start") * F.col("scale")).rangeBetween(-reach, reach)
    best = F.max(F.struct("dice", (-F.col("start")).alias("back"))).over(near)
    told = fit.withColumn("best", best).where((F.col("best.dice") == F.col("dice")) & (F.col("best.back") == -F.col("start")))
    return told.select("id", F.lit(WINDOW).alias("line"), F.col("start").cast("int").alias("start"), "licence", "dice")


def oracle(dice: float = 0.8) -> str:
    """DuckDB SQL for scan_licenses() over documents, whose ids are distinct."""
    values = ", ".join(f"('{name}', '{text}', {len(template_words(text))})" for name, text in TEMPLATES.items())
    places = ", ".join(f"('{pair}', '{name}', {t})" for name, text in TEMPLATES.items() for pair, t in anchors(text, dice))
    words = "string_split(trim(lower(regexp_replace({}, '[^A-Za-z0-9]+', ' ', 'g'))), ' ')"
    in_order = "list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])"
    pairs = f"list_distinct({in_order})"
    fits = f"len({{u}}) >= {dice}e0 * len(t.pairs) / {2 - dice}e0 - 1e-9 AND len({{u}}) <= len(t.pairs) * {2 - dice}e0 / {dice}e0 + 1e-9"
    return f"""
WITH templates AS (SELECT licence, m, {pairs} AS pairs FROM (SELECT licence, m, {words.format('text')} AS words FROM (VALUES {values}) v(licence, text, m))),
places AS (SELECT * FROM (VALUES {places}) v(pair, licence, place)),
split AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, unnest(range(len(lines))) AS line, unnest(lines) AS unit FROM split
  UNION ALL SELECT doc_id, -1 AS line, text AS unit FROM split WHERE len(lines) > 1),
paired AS (SELECT doc_id, line, {pairs} AS pairs FROM (SELECT doc_id, line, {words.format('unit')} AS words FROM units) WHERE len(words) > 1),
by_unit AS (
  SELECT u.doc_id, u.line, t.licence, 2.0e0 * len(list_intersect(u.pairs, t.pairs)) / (len(u.pairs) + len(t.pairs)) AS dice
  FROM paired u JOIN templates t ON {fits.format(u='u.pairs')}),
whole AS (SELECT doc_id, {in_order} AS pairs FROM (SELECT doc_id, {words.format('text')} AS words FROM split) WHERE len(words) > 1),
stands AS (SELECT doc_id, unnest(range(len(pairs))) AS i, unnest(pairs) AS pair FROM whole),
starts AS (SELECT DISTINCT doc_id, licence, greatest(0, i - place) AS start FROM stands JOIN places USING (pair)),
laid AS (
  SELECT s.doc_id, s.licence, s.start, t.m, list_distinct(w.pairs[s.start + 1 : s.start + t.m - 1]) AS u, t.pairs
  FROM starts s JOIN templates t USING (licence) JOIN whole w ON w.doc_id = s.doc_id),
by_window AS (
  SELECT doc_id, licence, start, m, 2.0e0 * len(list_intersect(u, t.pairs)) / (len(u) + len(t.pairs)) AS dice
  FROM laid t WHERE {fits.format(u='u')}),
fit AS (SELECT * FROM by_window WHERE dice >= {dice}e0),
best AS (SELECT * FROM fit a WHERE NOT EXISTS (SELECT 1 FROM fit b WHERE b.doc_id = a.doc_id AND b.licence = a.licence AND b.start <> a.start AND abs(b.start - a.start) < a.m AND (b.dice > a.dice OR b.dice = a.dice AND b.start < a.start)))
SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(NULL AS INTEGER) AS start, licence, dice FROM by_unit WHERE dice >= {dice}e0
UNION ALL SELECT doc_id, -2 AS line, CAST(start AS INTEGER) AS start, licence, dice FROM best"""
