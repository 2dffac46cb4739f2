import re
import zlib

import numpy as np
import pytest

import corpus_pipeline as cp
from detlake.llm import decontaminate, mixing, passages

SF = "/root/testdata/sf0.001"
NAMES = ["language", "near_duplicates", "repeated_passages", "benchmark", "mix"]


def _rows(df):
    return sorted(map(str, df.collect()))


def test_stages_against_plain_versions(spark):
    assert [n for n, _ in cp.STAGES] == NAMES
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = {}
    for name, stage in cp.STAGES:
        before, docs = docs, cp.materialize(stage(spark, docs, SF), f"test-{name}")
        made[name] = (before, docs)
        if name != "mix":
            assert docs.columns == before.columns and docs.schema == before.schema
    # language: only texts without letters may go where the labels are right
    before, after = made["language"]
    gone = {r.doc_id: r for r in before.collect()}.keys() - {r.doc_id for r in after.collect()}
    texts = {r.doc_id: r.text for r in before.collect()}
    assert all(len(re.findall(r"[^\W\d_]", texts[i])) < 30 for i in gone)
    # near duplicates: one of each component, by the brute-force version of its test
    from tests.llm.test_simhash import _brute

    before, after = made["near_duplicates"]
    keep = {c for _, _, c in _brute([(r.doc_id, r.text) for r in before.collect()])}
    assert {r.doc_id for r in after.collect()} == keep
    # passages: later copies of exact runs of fifty words are gone, first ones stay
    before, after = made["repeated_passages"]
    seen: dict[str, int] = {}
    left = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text.lower()) for r in after.orderBy("doc_id").collect()}
    for i, w in left.items():
        for g in {" ".join(w[j:j + 50]) for j in range(len(w) - 49)}:
            assert seen.setdefault(g, i) == i
    untouched = {r.doc_id for r in before.collect()} - {r.doc_id for r in passages.repeated_passages(before).collect()}
    olds, news = ({r.doc_id: r for r in t.collect()} for t in (before, after))
    assert all(olds[i] == news[i] for i in untouched)
    # benchmark: no text left holds an item, and nothing else is missing
    before, after = made["benchmark"]
    items = [" ".join(re.findall(r"[^\W_]+", r.text.lower())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = {r.doc_id: " ".join(re.findall(r"[^\W_]+", r.text.lower())) for r in before.collect()}
    found = {r.doc_id for r in decontaminate.contaminated(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {i for i, t in plain.items() if any(x in t for x in items)} <= found
    assert {r.doc_id for r in after.collect()} == plain.keys() - found
    # mix: what is drawn, with its probability
    before, after = made["mix"]
    want = {(r.doc_id, r.topic, r.prob) for r in mixing.mix_sources(before).filter("kept").collect()}
    assert {(r.doc_id, r.topic, r.prob) for r in after.collect()} == want and want
    assert _rows(cp.run(spark, SF)) == _rows(after)


@pytest.mark.parametrize("stage", range(5))
def test_stage_edges(spark, stage):
    """Nulls, blanks, long and repeated rows, clashing columns, and an empty table."""
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, topic string, _w int, score double, rows array<int>"
    rng = np.random.default_rng(0)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 9999, n))
    same = words(80)
    data = [(1, None), (2, ""), (3, "   \n"), (4, same), (4, same), (5, same + " more"), (None, same), (None, None), (6, words(60_000)), (7, words(70)), (8, words(70))]
    rows = [(i, t, lang, None if i == 7 else "s", len(t or ""), "clash", 1, 0.5, [1]) for (i, t), lang in zip(data, ["en", None, "de"] * 4)]
    docs = spark.createDataFrame(rows, kind)
    name, f = cp.STAGES[stage]
    got = f(spark, docs, SF)
    extra = ["topic_", "prob"] if name == "mix" else []  # the column that was there keeps its name
    assert got.columns == docs.columns + extra
    assert {r.topic for r in got.collect()} <= {"clash"}
    assert got.count() <= len(rows)
    assert f(spark, docs.filter("false"), SF).count() == 0
    if name in ("benchmark", "repeated_passages"):
        assert {r.doc_id for r in got.collect()} >= {1, 4, 6, 7, 8}
    if name == "language":
        assert {r.doc_id for r in got.collect()} == {4, 5, None, 6, 7, 8}
    if name == "near_duplicates":
        assert sorted((r.doc_id for r in got.collect() if r.doc_id is not None)) == [1, 4, 6, 7, 8]


INTERNAL = ["key", "_key", "id", "_id", "text_id", "_text_id", "spans", "_spans", "lower", "_lower", "source_name", "_source", "lang_name",
            "_lang", "topic", "prob", "a", "b", "fp", "n", "place", "weight", "_w", "draw", "groups", "n_tokens", "component_id", "root", "x"]


@pytest.mark.parametrize("stage", range(5))
def test_columns_named_like_the_work_columns_are_kept(spark, stage):
    rng = np.random.default_rng(1)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 9999, 90))
    texts = [text() for _ in range(6)]
    rows = [(i % 5, t, "en", "s", len(t), *(f"{c}{i}" for c in INTERNAL)) for i, t in enumerate([*texts, texts[0] + " more", texts[0] + " " + text()])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in INTERNAL))
    name, f = cp.STAGES[stage]
    got = f(spark, docs, SF)
    assert got.columns[:len(docs.columns)] == docs.columns
    whole = {tuple(r[5:5 + len(INTERNAL)]) for r in got.collect()}
    assert whole and whole <= {tuple(r[5:]) for r in rows}
    if name == "near_duplicates":  # ids 0, 1 and 2 are on unlike texts too
        assert got.count() == 7 and {r.text for r in got.collect()} >= set(texts)


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    from detlake.llm import simhash

    rng = np.random.default_rng(2)
    text = [" ".join(f"w{x}" for x in rng.integers(0, 9999, 60)) for _ in range(4)]
    docs = spark.createDataFrame([(7, text[0]), (7, text[1]), (8, text[2]), (9, text[0]), (7, text[1]), (None, text[3]), (None, text[2])], "doc_id bigint, text string")
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=str)
    assert kept == sorted([(7, text[0]), (7, text[1]), (8, text[2]), (None, text[3])], key=str)


def test_ids_that_are_no_whole_numbers_are_told_at_once(spark):
    docs = spark.createDataFrame([("a", "x y")], "doc_id string, text string")
    with pytest.raises(TypeError, match="string"):
        passages.repeated_passages(docs)


def test_targets_that_cannot_be_met_are_told(spark):
    docs = spark.createDataFrame([(i, "w " * 9, "en" if i % 2 else "de", "a" if i % 2 else "b") for i in range(8)], "doc_id bigint, text string, lang string, source string")
    with pytest.warns(UserWarning, match="off"):
        out = mixing.mix_sources(docs, langs_to={"en": 0.9, "de": 0.1}, sources_to={"a": 0.1, "b": 0.9})
    assert out.first().off > 0.1
    assert mixing.mix_sources(docs).first().off < 1e-3


def test_fold_is_crc32(spark):
    from detlake.llm.sample import fold

    rows = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", fold(4).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 4 for r in rows)
