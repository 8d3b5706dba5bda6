"""The byte network: gradients, whole texts, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.compare import DATA
from waymark.llm.byte_cnn import CHUNK, FILTERS, STEP, WIDTH, Model, _largest, _padded, fit_quality, quality_scores, score_text, train, with_quality
from waymark.llm.queries import op5_byte_cnn


def plain_score(model, text):
    """Chunk by chunk, place by place."""
    x, rows, values = _padded(text), model.tables, []
    for a in range(0, len(x) - CHUNK - WIDTH + 2, STEP):
        values.append(np.max([sum(rows[j][x[t + j]] for j in range(WIDTH)) for t in range(a, a + CHUNK)], axis=0))
    pooled = np.maximum(np.array(values) + model.bias, 0)
    return 1 / (1 + np.exp(-(np.concatenate([pooled.mean(axis=0), pooled.max(axis=0)]) @ model.head + model.shift)))


def test_chunks_cover_whole_texts():
    rng = np.random.default_rng(0)
    model = Model(rng.normal(size=(WIDTH, 256, FILTERS)).astype(np.float32), rng.normal(size=FILTERS).astype(np.float32), rng.normal(size=2 * FILTERS).astype(np.float32) / 8, 0.1)
    for n in (0, 1, 5, 6, 250, 256, 261, 262, 700, 17_000):
        text = bytes(rng.integers(32, 120, n, dtype=np.uint8))
        assert abs(score_text(model, text) - plain_score(model, text)) < 1e-5


def test_training_reads_whole_texts():
    """The largest values of every chunk, and the bytes that give them; the last chunk of a long text counts."""
    rng = np.random.default_rng(1)
    tables = rng.normal(size=(WIDTH, 256, FILTERS)).astype(np.float32)
    text = bytes(rng.integers(32, 120, 40_000, dtype=np.uint8))
    values, windows = _largest(tables, text)
    x = _padded(text)
    assert len(values) == (len(x) - CHUNK - WIDTH + 1) // STEP + 1
    assert np.allclose(sum(tables[j][windows[:, j], np.arange(FILTERS)] for j in range(WIDTH)), values, atol=1e-4)
    plain = [max(sum(tables[j, x[t + j], 0] for j in range(WIDTH)) for t in range(a, a + CHUNK)) for a in (0, STEP * (len(values) - 1))]
    assert np.allclose(values[[0, -1], 0], plain, atol=1e-4)
    rows = [b"z" * 9000 + (b" bad#end" if k % 2 else b" all well") for k in range(60)]
    model = train(rows, np.arange(60) % 2, 0.5)
    assert all((score_text(model, t) > 0.5) == k % 2 for k, t in enumerate(rows))


def test_training_is_bounded_by_labelled_ids(spark):
    """Many rows under one labelled id, or under null, are one training text; ids with both labels are none."""
    rows = [(k % 2 if k < 400 else None, f"text {k} " + ("#" if k % 2 else "plain") * 30) for k in range(800)] + [(3, "both")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (3, 0), (3, 1), (9, 0)], "doc_id long, quality int")
    from waymark.llm import byte_cnn

    sample, totals = byte_cnn._sample(labels, "doc_id", "quality", 10, 3)
    assert totals == {0: 2, 1: 2} and sample.count() == 4
    scored = {r["text"][:7]: r["score"] for r in with_quality(df, fit_quality(df, labels), "score").collect()}
    assert scored["text 1 "] < scored["text 0 "]


def test_held_out_accuracy(spark):
    rows = op5_byte_cnn(spark, f"{DATA}/sf0.01").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/sf0.01/labels.parquet").collect()}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p == y for p, y in held]) > 0.93


def test_one_class_and_odd_rows(spark, docs, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (4, 1), (7, None), (10, 3)], "doc_id long, quality int")
    model = fit_quality(docs, labels)
    assert all(r[0] > 0.9 for r in quality_scores(docs, model).select("score").collect())
    none = fit_quality(no_docs, labels.limit(0))
    assert [r[0] for r in quality_scores(odd_docs, none).select("score").collect()] == [0.5] * 8
    assert quality_scores(no_docs, none).count() == 0


def test_learns_a_pattern_anywhere(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(300))
        at = rng.randrange(len(text))
        rows.append((i, text[:at] + "#@#@#@" * 3 + text[at:] if i % 2 else text, 1 - i % 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = fit_quality(df.select("doc_id", "text"), df.where("doc_id < 200").select("doc_id", "quality"))
    scored = with_quality(df.where("doc_id >= 200"), model, "score").select(F.avg(((F.col("score") > 0.5).cast("int") == F.col("quality")).cast("int"))).first()[0]
    assert scored > 0.9
