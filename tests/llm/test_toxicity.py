import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from netframe.llm import toxicity

BAD = ["vile", "crude", "nasty"]


def made(n=900, seed=4):
    r = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = [f"w{r.randrange(400)}" for _ in range(40)]
        bad = r.random() < 0.15
        if bad:
            words[r.randrange(40)] = r.choice(BAD) + r.choice(["", ",", "."])
        rows.append((k, " ".join(words)))
        if r.random() < 0.6:
            labels.append((k, 1, int(bad)))
    return rows, labels, {k for k, t in rows if any(b in t for b in BAD)}


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows, labels, bad = made()
    docs, marks = frames(spark, rows, labels)
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs, marks).collect()}
    assert len(out) == len(rows)
    held = [k for k in out if out[k]["held_out"]]
    assert {k for k in out if zlib.crc32(str(k).encode()) % 5 == 0} == set(held)
    right = sum((out[k]["predicted"] == 1) == (k in bad) for k in held)
    assert right / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out.values())


def test_held_out_labels_do_not_matter(spark):
    rows, labels, _ = made(300)
    docs, marks = frames(spark, rows, labels)
    turned = marks.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, marks), toxicity.train(docs, turned)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def slow_risk(f_p, f_u, prior):
    loss = lambda z: np.log1p(np.exp(-z))
    return prior * sum(map(loss, f_p)) / len(f_p), sum(loss(-z) for z in f_u) / len(f_u) - prior * sum(loss(-z) for z in f_p) / len(f_p)


def test_risk_and_its_slopes_against_brute_force():
    rng = np.random.default_rng(3)
    seen = set()
    for prior, shift in ((0.1, 0), (0.3, 2), (0.6, 3), (0.05, -2), (0.8, 4)):
        f_p, f_u = rng.normal(shift, 2, 13), rng.normal(-1, 2, 29)
        first, second, slopes = toxicity.nn_risk(f_p, f_u, prior)
        assert np.allclose((first, second), slow_risk(f_p, f_u, prior))
        seen.add(second >= 0)
        step = 1e-6
        for k in range(42):
            up, down = (np.concatenate([f_p, f_u]) for _ in "ab")
            up[k] += step
            down[k] -= step
            (a1, a2), (b1, b2) = slow_risk(up[:13], up[13:], prior), slow_risk(down[:13], down[13:], prior)
            want = (a1 + a2 - b1 - b2) if second >= 0 else -(a2 - b2)
            assert abs(slopes[k] - want / (2 * step)) < 1e-6
    assert seen == {True, False}


def test_training_lowers_the_non_negative_risk():
    rng = np.random.default_rng(5)
    positive = [np.unique(np.append(rng.integers(0, 200, 20), 300 + rng.integers(0, 3))).astype(np.int32) for _ in range(300)]
    unlabelled = [np.unique(rng.integers(0, 200, 20)).astype(np.int32) for _ in range(900)] + positive[:90]

    def risk(model):
        f_p, f_u = (model.logits(np.concatenate(x), np.cumsum([len(t) for t in x])) for x in (positive, unlabelled))
        first, second, _ = toxicity.nn_risk(f_p, f_u, 0.1)
        return first + max(0.0, second)

    before, after = risk(toxicity.fit(positive, unlabelled, 0.1, bits=9, epochs=0)), risk(toxicity.fit(positive, unlabelled, 0.1, bits=9))
    assert 0 <= after < 0.5 * before


def test_ends_in_odd_cases(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.toxicity(docs, none).collect()} == {0}
    odd = spark.createDataFrame([(3, 1, 1), (3, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs.withColumn("score", F.lit("x")).withColumn("features", F.lit(1)), odd).count() == docs.count()
    assert toxicity.toxicity(empty, odd).count() == 0


def test_drop_toxic(spark):
    rows, labels, bad = made()
    docs, marks = frames(spark, rows, labels)
    docs = docs.withColumn("n_chars", F.length("text"))
    left = toxicity.drop_toxic(docs, marks)
    assert left.columns == docs.columns
    ids = {r[0] for r in left.select("doc_id").collect()}
    assert len(ids & bad) < 0.1 * len(bad) and len(ids - bad) > 0.97 * (len(rows) - len(bad))
