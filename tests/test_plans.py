"""Scoring and evaluation runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from detlake import schema
from detlake.operators.resume import coverage_gate, coverage_stats, run_stats, top_failures
from detlake.plans import evaluate as E, scoring as Sc


def manifest(spark, n=200):
    rows = [(ds, f"u{i:03d}", i % 2, "test" if i % 4 else "dev", f"A{i % 3}" if i % 2 else None)
            for ds in ("a", "b") for i in range(n)]
    return spark.createDataFrame(rows, "dataset_id string, utt_id string, label long, split string, attack_type string")


SELECTORS = [("a", "test"), ("b", "test")]


def test_run_identity(spark):
    m = manifest(spark)
    base = E.RunConditions("w", 1, "m", "f", 400, "fixed", SELECTORS)
    same = E.RunConditions("w", 1, "m", "f", 400, "fixed", SELECTORS[::-1])
    assert E.run_id(m, base) == E.run_id(m, same)
    for other in [E.RunConditions("v", 1, "m", "f", 400, "fixed", SELECTORS),
                  E.RunConditions("w", 2, "m", "f", 400, "fixed", SELECTORS),
                  E.RunConditions("w", 1, "m", "f", 400, "fixed", SELECTORS[:1])]:
        assert E.run_id(m, other) != E.run_id(m, base)


def test_evaluation_resumes_and_guards_coverage(spark, tmp_path):
    m = manifest(spark)
    calls = []

    def score(rows, keep="true"):
        calls.append(rows.count())
        s = F.col("label") + (F.crc32("utt_id") % 100) / 60.0
        return m.join(rows.select("dataset_id", "utt_id"), ["dataset_id", "utt_id"], "left_semi").filter(
            keep).select("dataset_id", "utt_id", s.alias("score"))

    cond = E.RunConditions("w", 3, "m", "f", 400, "fixed", SELECTORS)
    args = dict(selectors=SELECTORS, conditions=cond, shards=str(tmp_path / "s"), n_boot=40)
    with pytest.raises(E.CoverageTooLow, match="below 0.99"):
        E.evaluate_experiment(m, score=lambda r: score(r, "utt_id < 'u100'"), **args)
    history = spark.createDataFrame([(3, 0.7, 1), (3, 0.9, 2)], "epoch long, val_threshold double, seq int")
    out = E.evaluate_experiment(m, score=score, history=history, **args)
    assert calls == [300, 150]
    assert out["scores"].count() == 300
    assert out["scores"].columns == ["dataset_id", "utt_id", "split", "label", "attack_type", "score"]
    cov = out["coverage"].first()
    assert (cov["n_requested"], cov["n_scored"], cov["ratio"], cov["passed"]) == (300, 300, 1.0, True)
    for r in out["summary"].collect():
        assert r["n"] == 150 and r["ci_lo"] <= r["eer"] <= r["ci_hi"] and r["bootstrap_n"] == 40
    points = {(r["dataset_id"], r["at"]): r for r in out["operating_points"].collect()}
    assert len(points) == 4 and points["a", "val"]["threshold"] == 0.7
    assert {r["attack_type"] for r in out["by_attack"].collect()} == {"A0", "A1", "A2"}
    assert out["report"].count() == 2
    E.evaluate_experiment(m, score=score, **args)
    assert calls[-1] == 0
    with pytest.raises(NotImplementedError):
        E.evaluate_experiment(m, SELECTORS, score, E.RunConditions("w", window="full"), str(tmp_path / "x"))


def test_coverage_of_nothing(spark):
    empty = manifest(spark).limit(0)
    row = coverage_gate(coverage_stats(empty, empty), 0.99).first()
    assert row["ratio"] == 0.0 and not row["passed"]


def test_run_stats(spark):
    df = spark.createDataFrame([("a", "ok"), ("a", "failed"), ("b", "failed"), ("c", "done")],
                               "dataset_id string, status string")
    got = {r["dataset_id"]: r["ok"] for r in run_stats(df).collect()}
    assert got == {"a": True, "b": False, "c": True}
    f = spark.createDataFrame([("a", f"u{i}") for i in range(9)], "dataset_id string, utt_id string")
    assert top_failures(f).count() == 5


def pooled(spark, n=400):
    rng = np.random.default_rng(0)
    y = rng.random(n) < 0.7
    x = rng.normal(size=(n, 3)) + y[:, None] * np.array([1.0, 0, -0.5])
    return spark.createDataFrame(
        [("d", f"u{i}", int(y[i]), [float(v) for v in x[i]]) for i in range(n)],
        "dataset_id string, utt_id string, label long, features array<double>")


def test_weighted_fit_and_scores(spark):
    df = pooled(spark)
    n1 = df.filter("label = 1").count()
    assert Sc.class_weight(df) == pytest.approx((400 - n1) / n1)
    assert Sc.class_weight(df, "none") == 1.0 and Sc.class_weight(df, 2) == 2.0
    assert Sc.class_weight(df.filter("label = 1")) == 1.0
    model = Sc.fit_scorer(df)
    scored = Sc.batch_score(model, df)
    w, b = model.coefficients.toArray(), model.intercept
    x = {r["utt_id"]: np.array(r["features"]) for r in df.collect()}
    for r in scored.collect():
        assert r["score"] == pytest.approx(float(x[r["utt_id"]] @ w + b))
    best, _, table = Sc.select_by_val_eer(df, df, [{"reg": 100.0}, {"reg": 0.0}, {"reg": 0.0}])
    eers = {r["candidate"]: r["val_eer"] for r in table.collect()}
    assert eers[best] == min(eers.values()) and best != 2
    with pytest.raises(ValueError, match="one class"):
        Sc.select_by_val_eer(df, df.filter("label = 1"), [{"reg": 0.0}])


def test_statpool_masks_padding():
    rng = np.random.default_rng(0)
    w = Sc.StatPoolWeights(rng.normal(size=(5, 4)), rng.normal(size=5), rng.normal(size=(5, 10)),
                           rng.normal(size=5), rng.normal(size=5), 0.3)
    x = rng.normal(size=(2, 9, 4))
    full = Sc.statpool_logits(x[:, :6], np.array([6, 6]), w)
    padded = Sc.statpool_logits(x, np.array([6, 6]), w)
    np.testing.assert_allclose(full, padded)


def test_stored_manifest_reads_back(spark, tmp_path):
    from detlake.operators.manifest import select_split
    from detlake.plans.manifest import build_manifest
    from detlake.sources.tables import scan_manifest

    rows = [(f"u{i}", f"a/u{i}.wav", str(i % 2), "train" if i < 4 else "dev", "s", f"u{i}", "A1" if i % 2 else None) for i in range(6)]
    index, out = str(tmp_path / "index"), str(tmp_path / "m")
    spark.createDataFrame(rows, ", ".join(f"{c} string" for c in schema.INDEX_COLUMNS)).write.csv(index, header=True)
    listing = spark.createDataFrame([(r[1],) for r in rows], "path string")
    build_manifest(spark, "csv_index", "mini", out=out, index_path=index, audio_root=listing)
    back = scan_manifest(spark, out, ["dataset_id", "utt_id", "split"])
    assert "ReadSchema: struct<dataset_id:string,utt_id:string,split:string>" in back._jdf.queryExecution().toString()
    assert select_split(scan_manifest(spark, out), [("mini", "dev")]).count() == 2


def test_losses_and_empty_choices_are_loud(spark):
    from detlake.operators import frames as Fr, manifest as M, profile as P, resume as R

    df = spark.createDataFrame([("d", "a", 0, None), ("d", "b", 1, "A1")], "dataset_id string, utt_id string, label long, attack_type string")
    with pytest.raises(M.NoRows):
        M.filter_conjunctive(df, label=7)
    with pytest.raises(ValueError, match="no attack"):
        P.attack_counts(df.filter("label = 0"))
    frames = spark.createDataFrame([("d", "a", 0), ("d", "a", 1)], "dataset_id string, utt_id string, frame int")
    present, missing = R.present_or_stop(df, frames)
    assert (present.count(), missing) == (1, 1)
    with pytest.raises(R.NothingPresent):
        R.present_or_stop(df, frames.filter("false"))
    with pytest.raises(ValueError, match="without frames"):
        Fr.assert_frames(df, frames)


def test_mini_dataset_skips_sources_without_audio(spark):
    from detlake.operators import manifest as M

    rows = [(d, f"{d}{i}", f"{d}/{i}.wav", i % 2, "train", None) for d in ("x", "y") for i in range(10)]
    m = spark.createDataFrame(rows, "dataset_id string, utt_id string, path string, label long, split string, attack_type string")
    listing = m.select("path").filter("path <> 'y/3.wav'")
    got = {r["source_dataset_id"] for r in M.mini_dataset(m, 5, listing).collect()}
    assert got == {"x"}
    gone = M.sources_without_audio(M.first_k_per_class(m, 5), listing).collect()
    assert [(r["dataset_id"], r["reason"]) for r in gone] == [("y", "no audio: y/3.wav")]


def test_preflight_and_contract_stop_the_run(spark, tmp_path):
    from detlake.operators import quality as Q
    from detlake.plans import extract as X
    from detlake.plans.evaluate import RunConditions, evaluate_experiment
    from detlake.sources.tables import scan_features

    waves = spark.createDataFrame([("d", "a", 16000, [0.1] * 3200)], "dataset_id string, utt_id string, sr int, samples array<float>")
    lfcc, root = X.get_extractor("lfcc"), str(tmp_path / "features")
    X.extract_features(waves, lfcc, root)
    built = X.specs(X.read_table(spark, root))
    assert [(r["feature_id"], r["channels"], r["recipe"]) for r in built.collect()] == [(lfcc.feature_id, 60, lfcc.text)]
    assert scan_features(spark, root, lfcc.feature_id, channels=60).count() == 21
    with pytest.raises(Q.FeatureMismatch, match="width 60"):
        scan_features(spark, root, lfcc.feature_id, channels=80)
    cases = [(lfcc.feature_id, 60, lfcc.feature_id, 60, None), ("other", 60, "other", 60, "not built"), (lfcc.feature_id, 80, None, None, "width differs"),
             (lfcc.feature_id, 60, "other", 60, "other features"), (lfcc.feature_id, 60, None, 80, "another width")]
    manifest = spark.createDataFrame([("d", "a", 0, "test", None)], "dataset_id string, utt_id string, label long, split string, attack_type string")
    for want, channels, trained, width, problem in cases:
        wanted = spark.createDataFrame([("m", want, channels)], "name string, feature_id string, channels int")
        models = spark.createDataFrame([("m", trained, width)], "name string, feature_id string, in_channels int")
        checked = Q.spec_preflight(wanted, built, models)
        if problem is None:
            Q.assert_preflight(checked)
            continue
        with pytest.raises(Q.FeatureMismatch, match=problem):
            evaluate_experiment(manifest, [("d", "test")], lambda rows: rows, RunConditions("w"), str(tmp_path / "s"), preflight=checked)


def test_intermediates_can_be_discarded(spark, tmp_path):
    from detlake import session

    kept = session._made(spark)[:]
    session._made(spark).clear()
    table = session.materialize(spark.range(3), "scrap")
    path = session._made(spark)[0]
    table.write.parquet(str(tmp_path / "result"))
    assert session.discard(spark) == 1
    from detlake.sinks.tables import path_exists

    assert not path_exists(spark, path) and spark.read.parquet(str(tmp_path / "result")).count() == 3
    session._made(spark).extend(kept)


def _waves(spark, names, sr=16000):
    return spark.createDataFrame([("d", n, sr, [0.1] * 3200) for n in names], "dataset_id string, utt_id string, sr int, samples array<float>")


def test_each_drain_reads_the_finished_keys_of_its_own_folders(spark, tmp_path, monkeypatch):
    """Three drains of a stream: what is read of the index follows the batch, not what was finished before."""
    from detlake.plans import extract as X, finished
    from detlake.streaming.incremental import incremental_features, waveform_stream

    monkeypatch.setattr(finished, "BUCKETS", 64)
    read, among = [], finished.among

    def counted(keys, done, *args):
        out = among(keys, done, *args)
        read.append((keys.count(), out.count()))
        return out

    monkeypatch.setattr(finished, "among", counted)
    folder, root, checkpoint = (str(tmp_path / n) for n in ("in", "features", "stream"))
    lfcc = X.get_extractor("lfcc")
    drains = [[f"a{i}" for i in range(400)], ["b0", "b1", "a7"], ["c0", "a1", "b1"]]
    for names in drains:
        batch = _waves(spark, names)
        batch.coalesce(1).write.mode("append").parquet(folder)
        incremental_features(waveform_stream(spark, folder, batch.schema), lfcc, root, checkpoint)
    table = X.read_table(spark, root)
    keys = [r["utt_id"] for r in X.done_keys(table, lfcc.feature_id).collect()]
    assert len(keys) == len(set(keys)) == 403
    assert [n for n, _ in read] == [3, 3] and all(n < 60 for _, n in read)  # 400 finished keys in 64 folders
    assert set(finished.marks(spark, root, lfcc.feature_id).values()) == {True}


def test_a_stopped_run_is_found_in_the_table(spark, tmp_path, monkeypatch):
    from detlake.plans import extract as X, finished

    lfcc, root = X.get_extractor("lfcc"), str(tmp_path / "features")

    def stop(*args):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(finished, "settle", stop)
        with pytest.raises(RuntimeError):
            X.extract_features(_waves(spark, ["a", "b"]), lfcc, root, attempt=1)
    assert finished.marks(spark, root, lfcc.feature_id) == {1: False}
    X.extract_features(_waves(spark, ["a", "b", "c"]), lfcc, root, attempt=1)  # the batch again
    X.extract_features(_waves(spark, ["a", "b", "c", "e"]), lfcc, root)
    assert sorted(r["utt_id"] for r in X.done_keys(X.read_table(spark, root), lfcc.feature_id).collect()) == ["a", "b", "c", "e"]
    assert set(finished.marks(spark, root, lfcc.feature_id).values()) == {True}


def test_a_table_from_before_the_index_is_indexed(spark, tmp_path):
    import shutil

    from detlake.plans import extract as X, finished

    lfcc, root = X.get_extractor("lfcc"), str(tmp_path / "features")
    X.extract_features(_waves(spark, ["a", "b"]), lfcc, root)
    for name in ("_marks", "_finished"):
        shutil.move(f"{root}/{name}", str(tmp_path / name))
    for names in (["a", "c"], ["a", "b", "c"]):
        X.extract_features(_waves(spark, names), lfcc, root)
    assert sorted(r["utt_id"] for r in X.done_keys(X.read_table(spark, root), lfcc.feature_id).collect()) == ["a", "b", "c"]
    assert spark.read.parquet(f"{root}/_finished").count() == 3


def test_other_bytes_under_one_name_are_another_run(spark, tmp_path, monkeypatch):
    import hashlib

    from detlake.plans.evaluate import RunConditions, run_id
    from detlake.sources import files

    monkeypatch.setattr(files, "BLOCK", 1000)
    folder = tmp_path / "best"
    folder.mkdir()
    raw = np.random.default_rng(0).integers(0, 256, 4321, dtype=np.uint8).tobytes()
    (folder / "w.bin").write_bytes(raw)
    (folder / "empty").write_bytes(b"")
    blocks = "".join(hashlib.sha256(raw[i:i + 1000]).hexdigest() for i in range(0, 4321, 1000))
    got = {r["path"]: (r["length"], r["digest"]) for r in files.content_digests(spark, str(folder)).collect()}
    assert got["w.bin"] == (4321, hashlib.sha256(blocks.encode()).hexdigest()) and got["empty"][0] == 0
    one = files.content_digests(spark, str(folder / "w.bin")).collect()
    assert [(r["path"], r["digest"]) for r in one] == [("w.bin", got["w.bin"][1])]
    cond = RunConditions("best", 3, weights_path=str(folder))
    first = run_id(spark.range(1), cond)
    assert run_id(spark.range(1), cond) == first != run_id(spark.range(1), RunConditions("best", 3))
    (folder / "w.bin").write_bytes(raw[:2500] + b"!" + raw[2501:])
    assert run_id(spark.range(1), cond) != first


def test_runs_on_a_feature_table_are_checked_before_scoring(spark, tmp_path):
    from detlake.operators.quality import FeatureMismatch
    from detlake.plans import extract as X
    from detlake.plans.evaluate import RunConditions, evaluate_experiment

    lfcc, root = X.get_extractor("lfcc"), str(tmp_path / "features")
    X.extract_features(_waves(spark, ["a"]), lfcc, root)
    manifest = spark.createDataFrame([("d", "a", 0, "test", None)], "dataset_id string, utt_id string, label long, split string, attack_type string")
    models = spark.createDataFrame([("m", lfcc.feature_id, 80)], "name string, feature_id string, in_channels int")

    def never(rows):
        raise AssertionError("scored")

    for cond, kw, problem in [(RunConditions("w", feature_id="other"), {}, "not built"),
                              (RunConditions("w", feature_id=lfcc.feature_id, channels=61), {}, "width differs"),
                              (RunConditions("w", model_name="m", feature_id=lfcc.feature_id), {"models": models}, "another width")]:
        with pytest.raises(FeatureMismatch, match=problem):
            evaluate_experiment(manifest, [("d", "test")], never, cond, str(tmp_path / "s"), features=root, **kw)
    with pytest.raises(AssertionError, match="scored"):
        evaluate_experiment(manifest, [("d", "test")], never, RunConditions("w", feature_id=lfcc.feature_id, channels=60), str(tmp_path / "s"), features=root)


def test_statpool_from_moments_is_the_forward_pass(spark):
    rng = np.random.default_rng(4)
    C, H, T = 5, 7, 40
    w = Sc.StatPoolWeights(rng.normal(size=(H, C)), rng.normal(size=H), rng.normal(size=(H, 2 * H)), rng.normal(size=H), rng.normal(size=H), 0.3)
    x = {f"u{i}": rng.normal(size=(n, C)) * 3 + 50 for i, n in enumerate([1, 2, 7, 39, 40, 41, 90, 13, 20])}
    rows = [("d", u, f, [float(v) for v in m[f]], len(m)) for u, m in x.items() for f in range(len(m))]
    frames = spark.createDataFrame(rows, "dataset_id string, utt_id string, frame int, coeffs array<double>, n_frames int").repartition(7)
    want = {}
    for u, m in x.items():
        fixed = np.concatenate([m] * (-(-T // len(m))))[:T]
        want[u] = Sc.statpool_logits(fixed[None], np.array([T]), w)[0]
    for table in (frames, frames.drop("n_frames"), frames.orderBy("utt_id", "frame").coalesce(1)):
        got = {r["utt_id"]: r["score"] for r in Sc.score_statpool_mlp(table, C, T, w).collect()}
        assert set(got) == set(want) and all(abs(got[u] - want[u]) < 1e-8 for u in want)
    assert Sc.score_statpool_mlp(frames.limit(0), C, T, w).collect() == []
    # with stored lengths no coefficient meets an exchange
    plan = Sc.score_statpool_mlp(frames, C, T, w)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("MapInArrow _moments")[0] if "MapInArrow _moments" in plan else plan[:plan.rindex("MapInArrow")]
    assert "coeffs" not in "".join(line for line in above.splitlines() if "Exchange" in line)
    with pytest.raises(Exception, match="coefficients"):
        Sc.score_statpool_mlp(frames, C + 1, T, w).collect()
