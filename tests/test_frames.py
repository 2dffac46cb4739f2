"""Frames, signals, extraction and its resume behaviour."""

import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from detlake import fixed_values as fv
from detlake.functions import recipes, signal as S
from detlake.operators import frames as Fr
from detlake.operators.quality import contract_failures
from detlake.plans import extract as X
from detlake.sources import files, waveforms as W
from detlake.sources.listing import scan_audio_listing


def frame_table(spark, lengths, seed=0):
    rng = np.random.default_rng(seed)
    rows = [("d", u, f, float(rng.normal())) for u, t in lengths.items() for f in range(t)]
    return spark.createDataFrame(rows, "dataset_id string, utt_id string, frame int, value double"), rows


def values(rows, utt):
    return np.array([v for _, u, f, v in sorted(rows, key=lambda r: r[2]) if u == utt])


def fit_derivative(x, order, width=9):
    """Derivative of the least-squares polynomial around each frame."""
    w = min(width, len(x))
    w -= 1 - w % 2
    h = w // 2
    out = []
    for i in range(len(x)):
        c = min(max(i, h), len(x) - 1 - h)
        fit = np.polynomial.polynomial.Polynomial.fit(
            np.arange(-h, h + 1), x[c - h:c + h + 1], order).convert()
        out.append(fit.deriv(order)(0))
    return np.array(out)


def test_fix_length(spark):
    df, rows = frame_table(spark, {"short": 3, "equal": 8, "long": 10})
    got = Fr.fix_length(df, 8).collect()
    for utt in ("short", "equal", "long"):
        x = values(rows, utt)
        want = np.tile(x, 3)[:8] if utt == "short" else x[:8]
        mine = [r["value"] for r in sorted(got, key=lambda r: r["frame"]) if r["utt_id"] == utt]
        assert mine == list(want)


def test_fix_length_array(spark):
    df = spark.createDataFrame([([1, 2, 3],), (list(range(1, 11)),)], "x array<int>")
    got = [r[0] for r in df.select(Fr.fix_length_array(F.col("x"), 8)).collect()]
    assert got == [[1, 2, 3, 1, 2, 3, 1, 2], [1, 2, 3, 4, 5, 6, 7, 8]]
    empty = spark.createDataFrame([([],)], "x array<int>")
    with pytest.raises(Exception, match="without frames"):
        empty.select(Fr.fix_length_array(F.col("x"), 8)).collect()


def test_random_crop_is_seeded_and_inside(spark):
    df, rows = frame_table(spark, {"a": 40, "b": 5})
    one = {(r["utt_id"], r["frame"]): r["value"] for r in Fr.random_crop(df, 10, epoch=1).collect()}
    again = {(r["utt_id"], r["frame"]): r["value"] for r in Fr.random_crop(df, 10, epoch=1).collect()}
    sized = df.withColumn("n", F.when(F.col("utt_id") == "a", 40).otherwise(5))
    stored = {(r["utt_id"], r["frame"]): r["value"]
              for r in Fr.random_crop(sized, 10, epoch=1, n_frames="n").collect()}
    assert one == again == stored and len(one) == 20
    x = values(rows, "a")
    crop = np.array([one["a", f] for f in range(10)])
    assert any(np.array_equal(crop, x[i:i + 10]) for i in range(31))
    starts = set()
    for epoch in range(6):
        r = Fr.random_crop(df, 10, epoch=epoch).filter("utt_id = 'a' and frame = 0").first()
        starts.add(r["value"])
    assert len(starts) > 1


@pytest.mark.parametrize("piece", [4096, 16])
@pytest.mark.parametrize("order", [1, 2])
def test_deltas_match_polynomial_fit(spark, monkeypatch, piece, order):
    monkeypatch.setattr(Fr, "PIECE", piece)
    lengths = {"t3": 3, "t4": 4, "t8": 8, "t9": 9, "t14": 14, "t17": 17, "t33": 33, "t70": 70}
    df, rows = frame_table(spark, lengths)
    name = "delta" if order == 1 else "delta2"
    got = Fr.with_delta(df, order=order).collect()
    assert len(got) == len(rows)
    for utt in lengths:
        mine = [r[name] for r in sorted(got, key=lambda r: r["frame"]) if r["utt_id"] == utt]
        np.testing.assert_allclose(mine, fit_derivative(values(rows, utt), order), atol=1e-9)
        np.testing.assert_allclose(
            S.deltas(values(rows, utt)[:, None], 9, order)[:, 0], mine, atol=1e-9)


def test_deltas_of_too_short_signals(spark):
    df, _ = frame_table(spark, {"t2": 2})
    assert [r["delta"] for r in Fr.with_delta(df).collect()] == [None, None]
    with pytest.raises(ValueError, match="too short"):
        S.deltas(np.zeros((2, 1)), 9, 1)


def test_masked_pool(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(12, 3))
    m[:, 2] = 1.0
    rows = [("d", "u", f, [float(v) for v in m[f]]) for f in range(12)]
    df = spark.createDataFrame(rows, "dataset_id string, utt_id string, frame int, coeffs array<float>")
    got = Fr.masked_stat_pool(df, 3, valid=F.col("frame") < 7).first()
    np.testing.assert_allclose(got["mean"], m[:7].mean(axis=0), rtol=1e-5)
    np.testing.assert_allclose(got["std"], np.sqrt(np.maximum(m[:7].var(axis=0), 1e-5)), rtol=1e-5)


def test_default_extractors_on_a_tone():
    """Full-size parameters: shapes, the tone's band, slopes of a steady tone."""
    y = np.sin(2 * np.pi * 1000 * np.arange(16000) / 16000).astype(np.float32)
    lfcc, mel = X.get_extractor("lfcc"), X.get_extractor("logmel")
    a, b = (X.checked(e.matrix(y), e.channels) for e in (lfcc, mel))
    assert a.shape == (101, 60) and b.shape == (101, 80)
    assert np.abs(a[20:80, 20:40]).max() < 1e-6
    corner = S.mel_to_hz(np.linspace(0, S.hz_to_mel(8000.0), 82))
    band = int(b[50].argmax())
    assert corner[band] < 1000 < corner[band + 2]
    assert lfcc.feature_id != recipes.lfcc("lfcc", fv.LFCC_PARAMS | {"with_deltas": False}).feature_id


def test_power_matches_direct_transform():
    rng = np.random.default_rng(0)
    y = rng.normal(size=500)
    got = S.power(y, 64, 16, 40)
    x = np.pad(y, 32)
    w = np.pad(0.5 - 0.5 * np.cos(2 * np.pi * np.arange(40) / 40), 12)
    assert got.shape == (1 + 500 // 16, 33)
    for t in (0, 7, 31):
        for k in (0, 5, 32):
            z = sum(x[16 * t + i] * w[i] * np.exp(-2j * np.pi * k * i / 64) for i in range(64))
            assert got[t, k] == pytest.approx(abs(z) ** 2)


def test_power_in_blocks_equals_the_whole():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 500, 1001):
        y = rng.normal(size=n)
        whole = S.power(y, 64, 16, 40)
        for block in (1, 3, 7, 100):
            parts = list(S.power_blocks(y, 64, 16, 40, block))
            np.testing.assert_allclose(np.concatenate(parts), whole)
            assert max(len(p) for p in parts) <= block


def test_values_that_overflow_when_stored_fail():
    with pytest.raises(ValueError, match="Inf"):
        X.checked(np.array([[1e300]]).astype(np.float32), 1)


def wav_bytes(x, rate=16000, width=2, channels=1):
    buf = io.BytesIO()
    with wave.open(buf, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(x)
    return buf.getvalue()


def test_decode_pcm_widths():
    v = np.array([0, 100, -100, 32767, -32768])
    for width, data in [
        (1, (np.array([128, 255, 0]).astype(np.uint8)).tobytes()),
        (2, v.astype("<i2").tobytes()),
        (3, b"".join(int(i * 256).to_bytes(3, "little", signed=True) for i in v)),
        (4, (v.astype("<i4") * 65536).tobytes()),
    ]:
        rate, x = W.pcm_to_mono(wav_bytes(data, width=width))
        want = [0, 127 / 128, -1] if width == 1 else v / 32768
        np.testing.assert_allclose(x, want, atol=1e-7)
        assert rate == 16000


def test_filters_decode_no_file_twice(spark):
    rows = [(i, bytearray(wav_bytes(b"\0\1" * 8, rate=8000 if i % 3 == 0 else 16000))) for i in range(9)]
    decoded = W.decode_wav(spark.createDataFrame(rows, "id int, content binary"), 16000)
    good = decoded.filter("error is null").select("id", F.posexplode("samples"))
    assert good._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert good.count() == 6 * 8 and decoded.filter("error is not null").count() == 3


def test_files_to_features_and_resume(spark, tmp_path):
    """Real WAV files: good ones, a wrong rate, a broken one, a missing one, a short one."""
    rng = np.random.default_rng(0)
    folder = tmp_path / "raw"
    folder.mkdir()
    for i in range(4):
        pcm = (rng.normal(size=3200) * 3000).astype("<i2")
        (folder / f"u{i}.wav").write_bytes(wav_bytes(pcm.tobytes()))
    (folder / "rate.wav").write_bytes(wav_bytes(b"\0\0" * 3200, rate=8000))
    (folder / "broken.wav").write_bytes(b"not a wav")
    (folder / "short.wav").write_bytes(wav_bytes(b"\0\0" * 100))
    names = ["u0", "u1", "u2", "u3", "rate", "broken", "short", "missing"]
    manifest = spark.createDataFrame(
        [("d", n, f"{n}.wav") for n in names], "dataset_id string, utt_id string, path string")
    waves = W.waveform_ingest(spark, manifest, str(folder), 16000)
    assert waves.count() == 8
    root = str(tmp_path / "features")
    lfcc = X.get_extractor("lfcc")

    part = X.extract_features(waves, lfcc, root, limit=3).first()
    assert (part["total"], part["written"], part["failed"]) == (3, 0, 3)  # broken, missing, rate
    full = X.extract_features(waves, lfcc, root).first()
    assert (full["total"], full["written"], full["skipped"], full["failed"], full["ok"]) == (8, 4, 0, 4, True)
    again = X.extract_features(waves, lfcc, root).first()
    assert (again["total"], again["written"], again["skipped"], again["failed"]) == (8, 0, 4, 4)

    table = X.read_table(spark, root)
    log = {r["utt_id"]: r["error"] for r in X.failures(table, lfcc.feature_id).collect()}
    assert set(log) == {"rate", "broken", "short", "missing"}
    assert "too short" in log["short"] and "8000" in log["rate"] and "no audio" in log["missing"]

    pcm = (rng.normal(size=3200) * 3000).astype("<i2")
    (folder / "broken.wav").write_bytes(wav_bytes(pcm.tobytes()))
    fixed = W.waveform_ingest(spark, manifest, str(folder), 16000)
    third = X.extract_features(fixed, lfcc, root).first()
    assert (third["written"], third["skipped"], third["failed"]) == (1, 4, 3)
    assert X.failures(X.read_table(spark, root), lfcc.feature_id).count() == 3

    frames = X.read_table(spark, root).filter("status = 'ok'")
    assert frames.count() == 5 * 21
    assert contract_failures(frames, 60).count() == 0
    assert frames.groupBy("utt_id", "frame").count().filter("count > 1").count() == 0


def test_clean_full_run_clears_the_log(spark, tmp_path):
    wave_of = lambda names, sr: spark.createDataFrame(
        [("d", n, sr, [0.1] * 3200) for n in names], "dataset_id string, utt_id string, sr int, samples array<float>")
    lfcc, root = X.get_extractor("lfcc"), str(tmp_path / "features")
    X.extract_features(wave_of(["gone"], 8000), lfcc, root)
    assert X.failures(X.read_table(spark, root), lfcc.feature_id).count() == 1
    X.extract_features(wave_of(["good"], 16000), lfcc, root)
    assert X.failures(X.read_table(spark, root), lfcc.feature_id).count() == 0


def test_ingest_decodes_only_what_is_left(spark, tmp_path):
    folder = tmp_path / "raw" / "part=1"
    folder.mkdir(parents=True)
    for i in range(3):
        (folder / f"u{i}.wav").write_bytes(wav_bytes(b"\0\1" * 64))
    (folder / "u0.wav").write_bytes(b"broken, but done before")
    manifest = spark.createDataFrame([("d", f"u{i}", f"part=1/u{i}.wav") for i in range(4)], "dataset_id string, utt_id string, path string")
    done = spark.createDataFrame([("d", "u0"), ("d", "u9")], "dataset_id string, utt_id string")
    waves = W.waveform_ingest(spark, manifest, str(tmp_path / "raw"), 16000, done=done)
    assert {r["utt_id"]: r["error"] for r in waves.collect()} == {"u1": None, "u2": None, "u3": "FileNotFoundError: no audio file"}
    # files are opened above the last shuffle, which moves paths only
    lines = waves._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = next(i for i, line in enumerate(lines) if "MapInArrow" in line)
    assert not any(kind in line for line in lines[:depth] for kind in ("Join", "Repartition"))
    listed = spark.createDataFrame([(f"part=1/u{i}.wav",) for i in range(3)], "path string")
    again = W.waveform_ingest(spark, manifest, str(tmp_path / "raw"), 16000, listing=listed)
    assert again.filter("error like 'FileNot%'").count() == 1 and again.count() == 4


def test_bytes_read_follow_the_files_wanted(spark, tmp_path, monkeypatch):
    """Of 60 files 12 are wanted: those bytes are read, in bundles, and files that are not wanted stay closed."""
    sizes = {}
    for i in range(60):
        folder = tmp_path / f"part={i % 3}"
        folder.mkdir(exist_ok=True)
        raw = wav_bytes(b"\0\1" * (200 * i + 64))
        (folder / f"u{i}.wav").write_bytes(raw)
        sizes[i] = len(raw)
        (folder / f"u{i}.wav").chmod(0o644)
    path = lambda i: f"part={i % 3}/u{i}.wav"
    manifest = spark.createDataFrame([("d", f"u{i}", path(i)) for i in range(60)] + [("d", "gone", "part=0/gone.wav"), ("d", "folder", "part=1"), ("d", "none", None)],
                                     "dataset_id string, utt_id string, path string")
    done = spark.createDataFrame([("d", f"u{i}") for i in range(60) if i % 5], "dataset_id string, utt_id string")
    wanted = [i for i in range(60) if i % 5 == 0]
    for i in set(range(60)) - set(wanted):
        (tmp_path / path(i)).unlink()
        (tmp_path / path(i)).mkdir()  # opening it as a file would fail the task
    monkeypatch.setattr(W, "BUNDLE", 50_000)
    monkeypatch.setattr(W, "OPENING", 100)
    waves = W.waveform_ingest(spark, manifest, str(tmp_path), 16000, done=done)
    rows = {r["utt_id"]: r for r in waves.collect()}
    assert len(rows) == 15 and sum(r["n_bytes"] for r in rows.values()) == sum(sizes[i] for i in wanted)
    assert all(rows[f"u{i}"]["n_bytes"] == sizes[i] and len(rows[f"u{i}"]["samples"]) == 200 * i + 64 for i in wanted)
    assert {k for k, r in rows.items() if r["error"]} == {"gone", "folder", "none"}
    tasks = waves.filter("n_bytes > 0").groupBy(F.spark_partition_id().alias("task")).agg(F.sum("n_bytes").alias("n")).collect()
    assert len(tasks) >= 3 and max(r["n"] for r in tasks) <= 50_000 + max(sizes.values())
    listed = spark.createDataFrame([(path(i), sizes[i]) for i in wanted], "path string, length long")
    again = W.waveform_ingest(spark, manifest, str(tmp_path), 16000, done=done, listing=listed)
    assert sorted(map(str, again.collect())) == sorted(map(str, waves.collect()))
    assert W.waveform_ingest(spark, manifest.limit(0), str(tmp_path), 16000).count() == 0


def test_a_store_that_only_spark_opens_is_scanned(spark, tmp_path):
    (tmp_path / "u0.wav").write_bytes(wav_bytes(b"\0\1" * 64))
    manifest = spark.createDataFrame([("d", "u0", "u0.wav"), ("d", "u1", "u1.wav")], "dataset_id string, utt_id string, path string")
    plain = W.waveform_ingest(spark, manifest, str(tmp_path), 16000)
    scanned = W._scan_and_decode(spark, manifest, str(tmp_path), 16000, None)
    assert plain.columns == scanned.columns
    assert sorted(map(str, plain.collect())) == sorted(map(str, scanned.collect()))
    assert not files.reachable("viewfs://lake/raw")


def test_walk_lists_as_the_file_source_does(spark, tmp_path):
    for name in ("a/b/c/x.wav", "a/b/y.FLAC", "z.mp3", "a/.hidden/n.wav", "a/_temporary/m.wav", ".x.wav", "a/b/_y.wav", "notes.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    (tmp_path / "empty").mkdir()
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    want = {r["path"].removeprefix(f"file:{tmp_path}/") for r in source.select("path").collect()}
    assert {(r["path"], r["length"]) for r in files.walk(spark, str(tmp_path)).collect()} == {(p, 5) for p in want}
    listed = scan_audio_listing(spark, f"file://{tmp_path}")
    assert {r["rel"] for r in listed.collect()} == {"a/b/c/x.wav", "a/b/y.FLAC", "z.mp3"}
    assert files.walk(spark, str(tmp_path / "empty")).count() == 0
    plan = listed._jdf.queryExecution().optimizedPlan().toString()
    assert "binaryFile" not in plan


def test_stream_repeats_move_alone(spark):
    from detlake.streaming.incremental import one_per_key

    rows = [("d", "a", 16000, [1.0]), ("d", "a", 16000, [2.0]), ("d", "a", 8000, [3.0]), ("d", "b", 16000, [4.0])]
    batch = spark.createDataFrame(rows, "dataset_id string, utt_id string, sr int, samples array<float>")
    first = sorted(map(str, one_per_key(batch).collect()))
    assert len(first) == 2 and first == sorted(map(str, one_per_key(batch.orderBy("samples", ascending=False)).collect()))


def test_contract_reports_width_and_values(spark):
    rows = [("d", "a", 0, [1.0, 2.0]), ("d", "b", 0, [1.0]), ("d", "c", 0, [float("nan"), 1.0]),
            ("d", "e", 0, [float("-inf"), 1.0]), ("d", "f", 0, None)]
    df = spark.createDataFrame(rows, "dataset_id string, utt_id string, frame int, coeffs array<float>")
    bad = {r["utt_id"]: r["error"] for r in contract_failures(df, 2).collect()}
    assert set(bad) == {"b", "c", "e", "f"}
