"""Adapters on real files, validation, sampling and sinks."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from detlake.functions import labels as L, paths as P
from detlake.functions.numeric import probit
from detlake.operators import manifest as M, profile, quality as Q, resume as R
from detlake.plans.manifest import build_all, build_manifest, passport, read_passport
from detlake.registry import Registry
from detlake.sinks import tables as sinks
from detlake.sources import adapters as A, protocol as proto, tables as src
from detlake.sources.listing import scan_audio_listing

LINES = {
    5: ["LA_0001 U_0001 - - bonafide", "LA_0002 U_0002 - A07 spoof"],
    8: ["LA_0003 U_0003 none - bonafide bonafide notrim eval",
        "LA_0004 U_0004 g722 loc_tx A09 spoof notrim eval"],
    13: ["LA_0005 U_0005 nocodec src - bonafide notrim eval bonafide - - - -",
         "LA_0006 U_0006 low_mp3 src A10 spoof notrim eval unknown - - - -"],
}


def touch(path):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"x")


def rows_of(df):
    return {r["utt_id"]: r.asDict() for r in df.collect()}


def test_protocol_driven(spark, tmp_path):
    for word, utt in [("train", 1), ("dev", 2), ("eval", 3)]:
        p = tmp_path / "proto" / f"x.cm.{word}.txt"
        p.parent.mkdir(exist_ok=True)
        p.write_text(f"LA_1 U_{utt} - - bonafide\n\n  LA_2 U_{utt}0 - A0{utt} spoof \n")
        for u in (f"U_{utt}", f"U_{utt}0", f"LA_D_A{utt}"):
            touch(tmp_path / "audio" / f"LA_{word}" / "flac" / f"{u}.flac")
    args = dict(protocol_dir=str(tmp_path / "proto"), audio_root=str(tmp_path / "audio"))
    m = rows_of(build_manifest(spark, "protocol_5", "proto5", **args))
    assert len(m) == 6  # enrolment files stay out
    assert m["U_30"]["split"] == "test" and m["U_30"]["attack_type"] == "A03"
    assert m["U_1"]["attack_type"] is None and m["U_1"]["codec"] == "flac"
    assert m["U_2"]["path"] == "LA_dev/flac/U_2.flac" and m["U_2"]["condition"] is None

    (tmp_path / "audio" / "LA_dev" / "flac" / "U_20.flac").unlink()
    with pytest.raises(A.IndexProblem, match="without audio"):
        build_manifest(spark, "protocol_5", "proto5", **args)
    (tmp_path / "proto" / "y.dev.txt").write_text("a b c d spoof\n")
    with pytest.raises(A.IndexProblem, match="exactly one"):
        build_manifest(spark, "protocol_5", "proto5", **args)


@pytest.mark.parametrize("width", [8, 13])
def test_listing_driven(spark, tmp_path, width):
    keys = tmp_path / "keys.txt"
    keys.write_text("\n".join(LINES[width] + [LINES[width][0].replace("U_000", "ABSENT")]) + "\n")
    for line in LINES[width]:
        touch(tmp_path / "flac" / f"{line.split()[1]}.FLAC")
    args = dict(keys_path=str(keys), audio_root=str(tmp_path / "flac"))
    m = rows_of(build_manifest(spark, f"keys_{width}", "ds", **args))
    assert len(m) == 2 and {r["split"] for r in m.values()} == {"test"}
    if width == 8:
        assert m["U_0003"]["condition"] == "none" and m["U_0003"]["transmission"] is None
        assert m["U_0004"]["transmission"] == "loc_tx" and m["U_0004"]["attack_type"] == "A09"
    else:
        assert m["U_0005"]["condition"] == "nocodec" and m["U_0005"]["vocoder"] is None
        assert m["U_0006"]["vocoder"] is None and m["U_0006"]["attack_type"] == "A10"
    touch(tmp_path / "flac" / "stray.flac")
    with pytest.raises(A.IndexProblem, match="without a key"):
        build_manifest(spark, f"keys_{width}", "ds", **args)


def test_directory_driven_and_build_all(spark, tmp_path):
    for rel in ["training/real/a.wav", "training/fake/a.wav", "testing/fake/b.x.mp3", "testing/other/c.wav",
                "validation/real/n.txt"]:
        touch(tmp_path / rel)
    jobs = [dict(adapter="directories", dataset_id="dirs", audio_root=str(tmp_path)),
            dict(adapter="directories", dataset_id="none", audio_root=str(tmp_path / "validation"))]
    built, failed = build_all(spark, jobs)
    assert set(built) == {"dirs"} and set(failed) == {"none"}
    m = rows_of(built["dirs"])
    assert set(m) == {"training__real__a", "training__fake__a", "testing__fake__b.x"}
    assert m["testing__fake__b.x"]["label"] == 1 and m["testing__fake__b.x"]["codec"] == "mp3"
    doc = passport(built["dirs"])
    balance = {r["split"]: r.asDict() for r in doc["class_balance"].collect()}
    assert balance["train"] == {"split": "train", "bonafide": 1, "spoof": 1, "total": 2}
    assert doc["fingerprint"].first() == profile.table_fingerprint(built["dirs"].repartition(3)).first()


def test_manifest_is_stored_with_its_passport_and_replaced_by_name(spark, tmp_path):
    for rel in ("training/real/a.wav", "training/fake/a.wav"):
        touch(tmp_path / "raw" / rel)
    args = dict(adapter="directories", dataset_id="dirs", audio_root=str(tmp_path / "raw"))
    built = build_manifest(spark, out=str(tmp_path / "m"), **args)
    assert src.scan_manifest(spark, str(tmp_path / "m")).count() == spark.read.parquet(str(tmp_path / "m")).count() == 2
    stored = read_passport(spark, str(tmp_path / "m"))
    assert stored.keys() == passport(built).keys()
    for name, part in passport(built).items():
        assert sorted(map(str, stored[name].collect())) == sorted(map(str, part.collect()))
    table, root = "manifest_by_name", str(tmp_path / "versions")
    build_manifest(spark, out=root, table=table, **args)
    touch(tmp_path / "raw" / "testing/fake/b.wav")
    build_manifest(spark, out=root, table=table, **args)
    assert spark.table(table).count() == 3
    assert read_passport(spark, sinks.table_location(spark, table))["fingerprint"].first()["n_rows"] == 3
    spark.sql(f"drop table {table}")


def test_mini_round_trip(spark, tmp_path):
    rows = [(ds, f"u{i:02d}", f"flac/u{i:02d}.flac", i % 2, "train", f"A{i}" if i % 2 else None)
            for ds, n in [("big", 14), ("small", 8)] for i in range(n)]
    m = spark.createDataFrame(
        rows, "dataset_id string, utt_id string, path string, label long, split string, attack_type string")
    index = M.mini_dataset(m)
    got = index.collect()
    assert len(got) == 10 and {r["source_dataset_id"] for r in got} == {"big"}
    counts = {}
    for r in got:
        counts[r["split"], r["label"]] = counts.get((r["split"], r["label"]), 0) + 1
    assert counts == {(s, y): q for s, q in [("train", 2), ("dev", 2), ("test", 1)] for y in (0, 1)}
    assert M.skipped_sources(m).first()["dataset_id"] == "small"
    path = str(tmp_path / "index")
    sinks.write_csv(index, path)
    for r in got:
        touch(tmp_path / "audio" / r["path"])
    back = rows_of(build_manifest(spark, "csv_index", "mini", index_path=path, audio_root=str(tmp_path / "audio")))
    assert {r["utt_id"]: r["attack_type"] for r in got} == {u: r["attack_type"] for u, r in back.items()}


def test_group_limit_is_pushed_below_the_shuffle(spark, sf_dir):
    from detlake.catalog.manifest_queries import _sources

    plan = M.first_k_per_class(_sources(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def defective(spark):
    ok = ("d", "U1", "flac/U1.flac", 1, "train", "A07", None)
    rows = [
        ok, ("d", "U2", "flac/U2.flac", 0, "dev", None, None),
        ("d", None, "a.flac", 0, "dev", None, None), ("d", "U3", "a.flac", 2, "dev", None, None),
        ("d", "U4", "a.flac", 0, "eval", None, None), ok,
        ("d", "U5", "a.flac", 1, "dev", "Unknown", "-"), ("d", "a/b", "a.flac", 0, "dev", None, None),
        ("d", "..", "a.flac", 0, "dev", None, None), ("d", "U6", "/abs", 0, "dev", None, None),
        ("d", "U7", "a\\b", 0, "dev", None, None), ("d", "U8", "a/../b", 0, "dev", None, None),
        ("other", "U9", "a..b.flac", 0, "dev", None, None),
    ]
    return spark.createDataFrame(
        rows, "dataset_id string, utt_id string, path string, label long, split string, "
        "attack_type string, vocoder string")


def test_validator_reports_everything_at_once(spark):
    report = {(r["check"], r["item"]): r["n_bad"] for r in Q.validation_report(defective(spark), "d").collect()}
    assert report == {
        ("null_required", "utt_id"): 1, ("label_domain", "2"): 1, ("split_domain", "eval"): 1,
        ("duplicate_key", None): 2, ("sentinel", "attack_type=unknown"): 1, ("sentinel", "vocoder=-"): 1,
        ("unsafe_utt_id", None): 2, ("unsafe_path", None): 3, ("foreign_dataset", "other"): 1,
    }
    with pytest.raises(Q.ManifestInvalid) as e:
        Q.assert_valid(defective(spark), "d")
    assert all(k in str(e.value) for k, _ in report)
    good = defective(spark).filter("utt_id = 'U2'")
    Q.assert_valid(good, "d")
    short = Q.validation_report(good.drop("path"))
    assert [(r["check"], r["item"]) for r in short.collect()] == [("missing_column", "path")]


def test_coerce_rejects_garbage_and_missing_columns(spark):
    df = defective(spark)
    assert M.coerce_schema(df).columns[:5] == ["dataset_id", "utt_id", "path", "label", "split"]
    with pytest.raises(M.SchemaProblem, match="split"):
        M.coerce_schema(df.drop("split"))
    with pytest.raises(Exception):
        M.coerce_schema(df.withColumn("label", F.lit("spoof"))).collect()


def test_labels_and_conditions(spark):
    words = [" Spoof ", "BONAFIDE", "weird"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    lax = [r[0] for r in df.select(L.label_to_int(F.col("w"), strict=False)).collect()]
    assert lax == [1, 0, None]
    with pytest.raises(Exception, match="weird"):
        df.select(L.label_to_int(F.col("w"))).collect()
    values = [("A07", 1), ("A07", 0), (" Unknown", 1), ("-", 1), ("none", 1), ("N/A", 1), (None, 1), ("aBc ", 1)]
    v = spark.createDataFrame(values, "a string, y long")
    attack = [r[0] for r in v.select(L.norm_attack(F.col("a"), F.col("y"))).collect()]
    assert attack == ["A07", None, None, None, None, None, None, "aBc"]
    condition = [r[0] for r in v.select(L.norm_condition(F.col("a"))).collect()]
    assert condition == ["A07", "A07", "Unknown", None, "none", None, None, "aBc"]


def test_paths(spark):
    names = ["a/b.c.FLAC", "noext", "d/.hidden", "x/y.wav", "trail."]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = df.select(P.container_codec(F.col("p")), P.stem(F.col("p")), P.utt_id_from_path(F.col("p"))).collect()
    assert [r[0] for r in got] == ["flac", None, None, "wav", None]
    assert [r[1] for r in got] == ["b.c", "noext", ".hidden", "y", "trail."]
    assert got[0][2] == "a__b.c" and got[3][2] == "x__y"


def test_short_and_repeated_protocol_lines(spark, tmp_path):
    p = tmp_path / "keys.txt"
    p.write_text("a b c d e f g h\n\n \na b\nq w e r t y u i\nz\n")
    lines = proto.with_line_number(proto.read_protocol(spark, str(p)))
    from detlake import fixed_values as fv

    short = proto.short_lines(lines, fv.KEYS_8_FIELDS)
    assert sorted((r["line_no"], r["n_fields"]) for r in short.collect()) == [(2, 2), (4, 1)]
    with pytest.raises(A.IndexProblem, match="too short"):
        A._checked_rows(proto.read_protocol(spark, str(p)), fv.KEYS_8_FIELDS)
    p.write_text("a b c d e f g h\na b c d e f g h\n")
    with pytest.raises(A.IndexProblem, match="repeated"):
        A._checked_rows(proto.read_protocol(spark, str(p)), fv.KEYS_8_FIELDS)


def test_line_numbers_over_many_blocks(spark, tmp_path):
    p = tmp_path / "long.txt"
    p.write_text("".join(f"k{i} v\n" + ("\n" if i % 3 == 0 else "") for i in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = proto.with_line_number(proto.read_protocol(spark, str(p)))
        assert lines.select("block").distinct().count() > 3
        assert lines.filter(F.concat(F.lit("k"), F.col("line_no") - 1) != F.get("parts", F.lit(0))).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_listing_reads_no_content(spark, tmp_path):
    for n in ["a.wav", "b.FLAC", "c.txt", "sub/d.Ogg"]:
        touch(tmp_path / n)
    df = scan_audio_listing(spark, str(tmp_path))
    assert {r["rel"] for r in df.collect()} == {"a.wav", "b.FLAC", "sub/d.Ogg"}
    plan = df._jdf.queryExecution().executedPlan().toString().replace(str(tmp_path), "")
    assert "content" not in plan


def test_scans_prune_and_push_down(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderpriority").alias("dataset_id"), F.col("o_orderstatus").alias("split"), "o_orderkey")
    plan = M.select_split(df, [("1-URGENT", "F")]).select("dataset_id")._jdf.queryExecution().executedPlan().toString()
    assert "o_orderkey" not in plan.split("ReadSchema")[1]
    assert "PushedFilters: [" in plan and "EqualTo(o_orderpriority,1-URGENT)" in plan


def test_selectors(spark):
    df = defective(spark)
    twice = M.select_split(df, [("d", "train"), ("d", "train")])
    assert twice.count() == 2 * df.filter("split = 'train'").count()
    with pytest.raises(M.SchemaProblem, match="nowhere"):
        M.select_split(df, [("nowhere", "train")])


def test_atomic_table_and_history(spark, tmp_path):
    root = str(tmp_path / "t")
    v1 = sinks.write_table_atomic(spark.range(3), root)
    v2 = sinks.write_table_atomic(spark.range(5), root)
    assert [spark.read.parquet(v).count() for v in (v1, v2)] == [3, 5]
    assert sinks.path_exists(spark, v1) and not sinks.path_exists(spark, f"{root}/none")

    path = str(tmp_path / "h")
    cols = "epoch long, train_loss double, val_eer double, val_threshold double, lr double"
    first = [(0, 1.0, 0.4, 0.1, 1e-3), (1, 0.9, None, None, 1e-3), (2, 0.8, 0.3, 0.2, 1e-3)]
    second = [(2, 0.7, 0.2, 0.3, 1e-3), (3, 0.6, 0.2, 0.4, 1e-3)]
    for part in (first, second):
        sinks.append_history(spark.createDataFrame(part, cols).coalesce(1), path)
    log = src.scan_history(spark, path)
    assert log.count() == 5
    last = R.latest_wins(log, ["epoch"], ["seq"])
    assert last.filter("epoch = 2").first()["val_eer"] == 0.2
    assert R.first_wins(log, ["epoch"], ["seq"]).filter("epoch = 2").first()["val_eer"] == 0.3
    assert R.best_epoch(last).first()["epoch"] == 2
    sinks.truncate_history(spark, path, 1)
    assert sorted(r["epoch"] for r in src.scan_history(spark, path).collect()) == [0, 1]


def test_profile_edges(spark):
    df = defective(spark).filter("label in (0, 1)")
    assert profile.pos_weight(df.filter("label = 1")).first()["pos_weight"] is None
    approx = {r["column"]: r["n_unique"] for r in profile.column_profile_approx(df).collect()}
    exact = {r["column"]: r["n_unique"] for r in profile.column_profile(df).collect()}
    assert approx == exact
    many = spark.range(100).select(
        F.lit("d").alias("dataset_id"), F.concat(F.lit("c"), "id").alias("condition"),
        (F.col("id") % 64).cast("string").alias("codec"))
    assert {r["column"] for r in profile.value_counts_capped(many).collect()} == {"codec"}


def test_histogram_counts_and_density(spark):
    rng = np.random.default_rng(0)
    t = rng.integers(50, 400, 500)
    df = spark.createDataFrame([("d", f"u{i}", int(v)) for i, v in enumerate(t)],
                               "dataset_id string, utt_id string, n_frames long")
    got = profile.duration_histogram(df, 160, 16000).orderBy("bin").collect()
    density, edges = np.histogram(t * 160 / 16000, bins=60, density=True)
    assert sum(r["n"] for r in got) == 500
    np.testing.assert_allclose([r["left_sec"] for r in got], edges[:-1])
    assert abs(np.array([r["density"] for r in got]) - density).max() < 0.02


def test_probit(spark):
    from statistics import NormalDist

    p = [1e-9, 1e-4, 0.02, 0.3, 0.5, 0.9, 0.99999]
    df = spark.createDataFrame([(v,) for v in p] + [(0.0,), (1.0,)], "p double")
    got = [r[0] for r in df.select(probit(F.col("p"))).collect()]
    np.testing.assert_allclose(got[:-2], [NormalDist().inv_cdf(v) for v in p], rtol=2e-8, atol=1e-9)
    assert got[-2:] == [None, None]


def test_registry():
    r = Registry("thing")
    r.register("a")(1)
    with pytest.raises(ValueError, match="already"):
        r.add("a", 2)
    with pytest.raises(ValueError, match="name"):
        r.add("", 2)
    with pytest.raises(KeyError, match="registered: \\['a'\\]"):
        r.get("b")


def test_first_rows_are_chosen_where_they_are(spark):
    rng = np.random.default_rng(2)
    rows = [(f"d{rng.integers(3)}", f"u{rng.integers(400)}" if i % 9 else None, int(rng.integers(5))) for i in range(1500)]
    rows += [("d1", "hot", i % 2) for i in range(900)] + [("d1", "same", 7)] * 300
    df = spark.createDataFrame(rows, "dataset_id string, utt_id string, x int").repartition(6)
    order = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    for n in (0, 1, 250, 1350, 2000, 2699, 2700, 9999):
        got = M.limit_first_n(df, n).collect()
        assert [(r[0], r[1]) for r in got] == [r[:2] for r in order[:n]]
        assert not Counter(map(tuple, got)) - Counter(rows)
        sample = M.seeded_sample_n(df, n, seed=5).collect()
        assert len(sample) == min(n, 2700) and not Counter(map(tuple, sample)) - Counter(rows)
    by_hash = sorted(rows, key=lambda r: hashlib.md5(",".join(["5", *(c for c in r[:2] if c is not None)]).encode()).hexdigest())
    got = Counter((r[0], r[1]) for r in M.seeded_sample_n(df, 700, seed=5).collect())
    assert got == Counter(r[:2] for r in by_hash[:700])
    assert M.limit_first_n(df.limit(0), 5).collect() == []
    plan = M.limit_first_n(df, 1350)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "rangepartitioning" in plan


def test_a_table_is_replaced_under_its_name(spark, tmp_path):
    root, name = str(tmp_path / "t"), "replaced_table"
    v1 = sinks.replace_table(spark.range(3), name, root)
    before = spark.table(name)
    v2 = sinks.replace_table(spark.range(5), name, root)
    assert v1 != v2 and spark.table(name).count() == 5 and before.count() == 3  # a reader that has begun
    assert sinks.table_location(spark, name).endswith(v2)
    with pytest.raises(ValueError, match="columns"):
        sinks.replace_table(spark.range(5).withColumnRenamed("id", "x"), name, root)
    with pytest.raises(Exception, match="broken"):  # a write that fails changes nothing
        sinks.replace_table(spark.range(9).selectExpr("coalesce(id, raise_error('x')) id").selectExpr("if(id > 4, raise_error('broken'), id) id"), name, root)
    assert spark.table(name).count() == 5
    v3 = sinks.replace_table(spark.range(6), name, root)
    assert sinks.expire_versions(spark, name, root, keep=2) >= 1
    assert spark.table(name).count() == 6 and not sinks.path_exists(spark, v1)
    sinks.expire_versions(spark, name, root)
    assert spark.table(name).count() == 6 and not sinks.path_exists(spark, v2) and sinks.path_exists(spark, v3)
    spark.sql(f"drop table {name}")


def test_row_count_comes_from_the_footers(spark, tmp_path):
    from detlake.sources.tables import footer_rowcount

    spark.range(1000).repartition(4).write.parquet(str(tmp_path / "t"))
    found = footer_rowcount(spark, str(tmp_path / "t"))
    assert found.collect()[0]["n_rows"] == 1000
    assert "PushedAggregation: [COUNT(*)]" in found._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
