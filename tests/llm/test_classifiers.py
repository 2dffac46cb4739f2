import zlib

import numpy as np
import pytest

from detlake.llm import langid, toxicity
from detlake.llm.queries import QUERIES

LONG = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, fp int"
SF = "/root/testdata/sf0.01"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, None, None, "clash", 1) for r in rows], LONG)


def _fold(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def test_language_held_out(spark):
    got = {r.doc_id: r for r in QUERIES["op6_langid"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    assert len(got) == len(docs)
    assert all(got[d.doc_id].held_out == (_fold(d.doc_id, 4) == 2) for d in docs)
    held = [got[d.doc_id].lang_pred == d.lang for d in docs if got[d.doc_id].held_out]
    assert np.mean(held) > 0.98


def test_language_is_naive_bayes(spark):
    """Scores equal a plain computation over the same bins."""
    texts = [(1, "Das ist ein Haus", "de"), (2, "this is a house", "en"), (3, "das Haus", "de"), (4, "the house", "en")]
    model = langid.fit(_docs(spark, texts))
    lines = {}
    for _, text, lang in texts:
        points = np.array([ord(c) for c in text], np.uint32)
        bins, _, _ = langid.grams(points, np.array([0, len(points)]))
        lines.setdefault(lang, []).append(bins.ravel())
    counts = np.stack([np.bincount(np.concatenate(lines[n]), minlength=langid.BINS) for n in ("de", "en")], 1) + 0.5
    assert model.langs == ["de", "en"]
    np.testing.assert_allclose(model.logp, np.log(counts / counts.sum(0)), rtol=1e-5)
    probe = "das this"
    points = np.array([ord(c) for c in probe], np.uint32)
    bins, _, _ = langid.grams(points, np.array([0, len(points)]))
    z = model.prior + model.logp[bins.ravel()].astype(float).sum(0)
    row = langid.predict(_docs(spark, [(9, probe, None)]), model).first()
    assert row.lang_pred == model.langs[z.argmax()]
    assert row.score == pytest.approx(np.exp(z - z.max()).max() / np.exp(z - z.max()).sum(), rel=1e-6)


def test_grams_stay_within_rows_and_words():
    def bins(*texts):
        points = np.array([ord(c) for t in texts for c in t], np.uint32)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        b, rows, has = langid.grams(points, at)
        return [b[rows == i].tolist() for i in range(len(texts))], has.tolist()

    (one, two, blank), has = bins("Ab c", "dé", " 12 ")
    assert [one] == bins("ab -- c")[0] and [two] == bins("DÉ")[0]
    assert has == [True, True, False]


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", None), (None, "hello there", "en"), (5, "hello " * 300_000, None), (5, "hello", "en")]
    got = langid.predict(_docs(spark, rows), langid.fit(_docs(spark, rows))).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en", "en", "en"]
    assert [r.score for r in got[:3]] == [0, 0, 0]
    assert got[3].score == 1.0
    none = _docs(spark, [])
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.predict(_docs(spark, rows), langid.fit(none)).collect()} == {"und"}


def test_toxicity_held_out(spark):
    got = {r.doc_id: r for r in QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.1").collect()}
    assert len(got) == 10_000
    assert all(r.held_out == (_fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in got.values())
    assert all(r.predicted == (r.score >= 0.5) for r in got.values())
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels if got[r.doc_id].held_out]
    hit = sum(p and t for p, t in held)
    assert hit / sum(p for p, _ in held) > 0.95
    assert hit / sum(t for _, t in held) > 0.75


def test_machine_learns_a_pair():
    """Two terms that are harmless alone and decide together."""
    rng = np.random.default_rng(1)
    terms, y = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.3
        terms.append(np.array(sorted([1] * int(a) + [2] * int(b) + rng.choice(np.arange(10, 60), 6, replace=False).tolist())))
        y.append(float(a and b))
    model = toxicity.fit_features(np.array(y), np.ones(len(y)), terms)

    def score(*t):
        return toxicity.score_rows(model, np.zeros(len(t), int), np.array(t, int), 1)[0]

    assert score(1, 2, 15) > 0.9
    assert max(score(1, 15), score(2, 15), score(15), score()) < 0.2


def test_toxicity_edges(spark):
    docs = _docs(spark, [(i, t, None) for i, t in [(1, None), (2, ""), (3, "a bad word"), (3, "a bad word"), (None, "x"), (6, "bad " * 400_000)]])
    labels = spark.createDataFrame([(3, 0, 1), (3, 0, 0), (1, 1, None), (99, 1, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for some in (labels, labels.filter("false")):
        model = toxicity.fit(docs, some)
        got = toxicity.predict(docs, model).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
        assert got[2].score == got[3].score
    assert all(r.score == 0 for r in got)
    assert toxicity.judge(docs.filter("false"), labels).count() == 0


def test_score_matches_the_formula():
    model = toxicity.Model(-0.3, np.full(toxicity.BINS, -1, np.int32), np.array([0.5, -1.0, 2.0]), np.arange(6.0).reshape(3, 2) / 5)
    model.slot[[10, 20, 30]] = [0, 1, 2]
    z = -0.3 + 0.5 + 2.0 + model.v[0] @ model.v[2]
    rows = np.array([0, 0, 0, 0, 1])
    got = toxicity.score_rows(model, rows, np.array([10, 30, 30, 77, 77]), 3)
    np.testing.assert_allclose(got, 1 / (1 + np.exp([-z, 0.3, 0.3])))
