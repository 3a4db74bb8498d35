import zlib

import numpy as np
import pyarrow as pa

from weftline.llm import quality as Q


def test_features_by_hand():
    x = Q.features(pa.array(["ab ab", "", None, "A|B\nA|B"]))
    assert x.shape == (4, Q.FEATURES) and not x[1, :256].any() and (x[1] == x[2]).all()
    assert np.isclose(x[0, ord("a")], np.log1p(100 * 2 / 5)) and np.isclose(x[0, 256], np.log1p(100 * 2 / 5))
    assert np.isclose(x[0, -3:], [0.5, 0.5, 1]).all() and np.isclose(x[3, -1], 0.5)
    sliced = pa.array(["zz", "ab ab"]).slice(1)
    assert (Q.features(sliced)[0] == x[0]).all()


def test_positive_unlabelled_learning_separates():
    rng = np.random.default_rng(0)
    good = rng.normal(0, 1, (2000, Q.FEATURES)).astype(np.float32)
    good[:, :40] += 1.5
    bad = rng.normal(0, 1, (1000, Q.FEATURES)).astype(np.float32)
    model = Q.train(good[:800], np.concatenate([good[800:1800], bad[:500]]), 2 / 3)
    scores = model.raw(np.concatenate([good[1800:], bad[500:]]))
    assert (scores[:200, None] > scores[None, 200:]).mean() > 0.97


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r.doc_id: r for r in Q.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    told = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in told if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i in held) and sum(r.held_out for r in got.values()) == sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in got)
    right = np.mean([got[i].predicted == told[i] for i in held])
    assert right > 0.97
    kept = np.mean([got[i].predicted for i in held if told[i]])
    assert kept > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())


def test_held_out_labels_do_not_matter(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a, b = ({r.doc_id: r.score for r in Q.classify(documents, x).collect()} for x in (labels, turned))
    assert a == b


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 0), (8, 0), (None, 1), (99, 1), (1, None)], "doc_id long, quality int")
    out = Q.classify(odd, labels, keep_row=True)
    assert out.count() == odd.count() and out.select("row.*").columns == odd.columns
    assert Q.classify(odd, labels.limit(0)).select("score").distinct().count() == 1
    assert Q.classify(odd.limit(0), labels).count() == 0


def test_risk_against_its_formula_and_slope_against_differences():
    rng = np.random.default_rng(3)
    for shift in (3.0, -4.0):  # with the negative part above and below zero
        p, u, prior = rng.normal(1, 2, 40), rng.normal(shift, 0.5, 30), 0.7
        softplus = lambda z: np.log(1 + np.exp(z))
        plus = prior * sum(softplus(-z) for z in p) / 40
        minus = sum(softplus(z) for z in u) / 30 - prior * sum(softplus(z) for z in p) / 40
        assert np.allclose(Q.risk(p, u, prior), (plus, minus)) and (minus < 0) == (shift < 0)
        # Below zero it is the negative part itself that the step reduces the other way.
        value = lambda p, u: sum(Q.risk(p, u, prior)) if shift > 0 else -Q.risk(p, u, prior)[1]  # noqa: E731, B023
        slope, e = Q.risk_slope(p, u, prior), 1e-6
        for k in range(70):
            a, b = np.concatenate([p, u]), np.concatenate([p, u])
            a[k] += e
            b[k] -= e
            assert abs((value(a[:40], a[40:]) - value(b[:40], b[40:])) / (2 * e) - slope[k]) < 1e-6


def test_prior_and_calibration_need_no_negatives():
    rng = np.random.default_rng(4)
    for prior in (0.3, 0.8):
        y = rng.random(20_000) < prior
        u, p = np.where(y, rng.normal(3, 1, 20_000), rng.normal(-3, 1, 20_000)), rng.normal(3, 1, 4_000)
        assert abs(Q.estimate_prior(p, u) - prior) < 0.03
        slope, shift = Q.calibrate(p, u, prior)
        s = 1 / (1 + np.exp(-(slope * u + shift)))
        assert abs(s.mean() - prior) < 0.02 and ((s >= 0.5) == y).mean() > 0.99
    assert Q.estimate_prior(np.zeros(0), u) == 0.5 and Q.calibrate(p[:3], u, 0.5) == (1.0, 0.0)


def test_labels_of_negatives_are_never_read(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    a, b = ({r.doc_id: r.score for r in Q.classify(documents, x).collect()} for x in (labels, labels.where("quality = 1")))
    assert a == b
