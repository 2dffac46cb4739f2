"""EER, ROC and bootstrap against plain definitions on small inputs."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from detlake.catalog import detection_queries
from detlake.functions.md5 import md5_heads
from detlake.operators import bootstrap, bracket, detection as D, prefix

GOLDEN = [
    ([.1, .2, .8, .9], [0, 0, 1, 1], 0.0, 0.8),
    ([.9, .8, .2, .1], [0, 0, 1, 1], 1.0, 0.8),
    ([1, 1, 1, 1], [0, 1, 0, 1], 0.5, None),
    ([.1, .4, .35, .8], [0, 0, 1, 1], 0.5, 0.4),
    ([1, 2, 3, 4, 5, 6], [0, 0, 1, 0, 1, 1], 1 / 3, 4.0),
    ([1, 2, 2, 3, 3, 3, 4], [0, 0, 1, 0, 1, 1, 1], 0.3, 3.1),
    ([5, 4, 3, 2, 1], [1, 1, 0, 1, 0], 1 / 3, 10 / 3),
    ([1, 2], [1, 1], None, None),
    # the crossing lies before the first node: threshold +inf
    ([3, 3, 3, 3, 1], [0, 0, 1, 1, 1], 0.6, float("inf")),
]


def score_table(spark, groups):
    rows = [(g, float(s), int(y)) for g, (scores, labels) in groups.items()
            for s, y in zip(scores, labels)]
    return spark.createDataFrame(rows, "dataset_id string, score double, label long")


def brute_eer(scores, labels):
    """EER by walking all thresholds, without the node rule (same value)."""
    scores, labels = np.asarray(scores, float), np.asarray(labels)
    p, n = (labels == 1).sum(), (labels == 0).sum()
    if not p or not n:
        return None
    prev = (0.0, 1.0)
    for t in sorted(set(scores), reverse=True):
        hit = scores >= t
        cur = ((hit & (labels == 0)).sum() / n, 1 - (hit & (labels == 1)).sum() / p)
        gap, before = cur[1] - cur[0], prev[1] - prev[0]
        if gap <= 0:
            w = before / (before - gap)
            return prev[0] + w * (cur[0] - prev[0])
        prev = cur


def test_golden(spark):
    df = score_table(spark, {f"g{i}": (s, y) for i, (s, y, _, _) in enumerate(GOLDEN)})
    got = {r["dataset_id"]: r for r in D.eer(df, ["dataset_id"]).collect()}
    for i, (_, _, eer, threshold) in enumerate(GOLDEN):
        row = got[f"g{i}"]
        assert row["eer"] == (None if eer is None else pytest.approx(eer))
        assert row["threshold"] == (None if threshold is None else pytest.approx(threshold))


def random_groups(seed, ties):
    rng = np.random.default_rng(seed)
    out = {}
    for g, size in enumerate([5, 40, 400, 1500]):
        y = rng.integers(0, 2, size)
        y[:2] = 0, 1
        s = rng.normal(y * 1.2, 1.0)
        out[f"g{g}"] = (np.round(s, 1) if ties else s, y)
    return out


@pytest.mark.parametrize("ties", [False, True])
def test_eer_matches_brute_force_and_ranges(spark, ties):
    groups = random_groups(3, ties)
    df = score_table(spark, groups)
    plain = {r["dataset_id"]: r for r in D.eer(df, ["dataset_id"]).collect()}
    for g, (s, y) in groups.items():
        assert plain[g]["eer"] == pytest.approx(brute_eer(s, y))
    for parts in ("1", "23"):  # ranges are shuffle partitions: one, and more than there are scores
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        cut = {r["dataset_id"]: r for r in D.eer(df, ["dataset_id"]).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        for g in groups:
            assert cut[g]["eer"] == pytest.approx(plain[g]["eer"])
            assert cut[g]["threshold"] == pytest.approx(plain[g]["threshold"])


def test_long_runs_around_the_crossing(spark):
    """Thresholds depend on where equal steps end, however far that is."""
    groups = {
        "separated": (np.r_[np.arange(100) + 200.0, np.arange(100) * 1.0], np.r_[np.ones(100), np.zeros(100)]),
        "reversed": (np.r_[np.arange(100) * 1.0, np.arange(100) + 200.0], np.r_[np.ones(100), np.zeros(100)]),
        "blocks": (np.arange(210.0), np.r_[np.zeros(30), np.ones(60), np.zeros(60), np.ones(60)]),
        "pairs": (np.repeat(np.arange(90.0), 2), np.tile([0, 1], 90)),
        "single": (np.full(9, 5.0), np.r_[np.ones(4), np.zeros(5)]),
        "one_class": (np.arange(9.0), np.ones(9)),
    }
    df = score_table(spark, groups)
    results = []
    for parts in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append({r["dataset_id"]: (r["eer"], r["threshold"]) for r in D.eer(df, ["dataset_id"]).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] and set(results[0]) == set(groups)


@pytest.mark.parametrize("ends", [[1e12, -1e12, 1e3], [np.inf, -np.inf, 0.0], [1.5e308, -1.5e308, 1e308]])
def test_extreme_scores_do_not_break_ranges(spark, ends):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 4000)
    s = np.concatenate([rng.normal(y, 1.0) * 1e-9, ends])
    y = np.concatenate([y, [1, 0, 1]])
    df = score_table(spark, {"g": (s, y), "hot": (np.round(np.r_[s[:-3], 1e-9, 0, 0], 9), y)})
    got = {r["dataset_id"]: r["eer"] for r in D.eer(df, ["dataset_id"]).collect()}
    assert got["g"] == pytest.approx(brute_eer(s, y))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    nodes = D.score_nodes(df.filter("dataset_id = 'g'"), ["dataset_id"])
    sizes = [r["count"] for r in D.ranged_nodes(nodes, ["dataset_id"]).groupBy("_range").count().collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 4 and max(sizes) < 2 * 4003 / 4


def test_gate_sets_the_same_rows_aside_everywhere(spark):
    rows = [("g", s, y) for s, y in [(1.0, 0), (2.0, 1), (3.0, 0), (4.0, 1), (float("nan"), 0), (float("nan"), 1),
                                      (None, 1), (float("inf"), 1), (float("-inf"), 0), (5.0, None), (5.0, 7)]]
    df = spark.createDataFrame(rows, "dataset_id string, score double, label long")
    gate = D.score_gate(df, ["dataset_id"]).first().asDict()
    assert gate == {"dataset_id": "g", "n": 11, "n_null": 1, "n_nan": 2, "n_no_label": 2, "n_infinite": 2, "n_used": 6}
    at = D.confusion_at(df, ["dataset_id"], 2.5).first()
    assert (at["tn"], at["fp"], at["fn"], at["tp"]) == (2, 1, 1, 2)
    assert D.eer_report(df).first()["n"] == 6
    s, y = zip(*[(s, y) for _, s, y in rows if y in (0, 1) and s is not None and s == s])
    got = D.eer(df, ["dataset_id"]).first()
    assert got["eer"] == pytest.approx(brute_eer(s, y)) and got["threshold"] == got["threshold"]
    only_nan = df.filter("isnan(score)")
    assert D.eer(only_nan, ["dataset_id"]).count() == 0


def test_ranks_of_tied_scores(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "PIECE", 7)
    s = [1.0] * 40 + [2.0] * 3 + [0.5] * 20
    got = bootstrap.ranked_scores(score_table(spark, {"g": (s, [1] * len(s))}), "dataset_id")
    assert {r["i"]: r["score"] for r in got.collect()} == dict(enumerate(sorted(s)))


def test_hashed_draws_are_shared_out_by_their_number(spark, monkeypatch):
    """A few nodes become many draws: tasks follow the draws, and results do not depend on them."""
    rng = np.random.default_rng(4)
    labels = rng.integers(0, 2, 3000)
    df = score_table(spark, {"g": ((rng.integers(0, 3, 3000) + labels).astype(float).tolist(), labels.tolist())})
    once = bootstrap.eer_replicates_hashed(df, 4).orderBy("rep").collect()
    monkeypatch.setattr(bootstrap, "PIECE", 50)
    monkeypatch.setattr(bootstrap, "DRAWS", 400)
    assert bootstrap.eer_replicates_hashed(df, 4).orderBy("rep").collect() == once and len(once) == 4
    nodes = bootstrap._class_nodes(df, "dataset_id")
    draws = bootstrap._drawn(nodes, 4, 1337, "dataset_id", bootstrap._tasks(nodes, 4))
    sizes = [r["count"] for r in draws.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 12_000 and max(sizes) <= 3 * bootstrap.DRAWS


def drawn_by_hand(scores, labels, name, n_boot):
    """EER of each replicate, drawn one by one."""
    scores, labels, out = np.asarray(scores, float), np.asarray(labels), []
    for rep in range(n_boot):
        picked = []
        for y in (0, 1):
            own = np.sort(scores[labels == y])
            heads = [int(hashlib.md5(f"1337,{name},{y},{rep},{i}".encode()).hexdigest()[:8], 16) for i in range(len(own))]
            picked.append(own[np.array(heads, int) % max(1, len(own))])
        out.append(brute_eer(np.concatenate(picked), np.repeat([0, 1], [len(p) for p in picked])))
    return out


def test_report_draws_the_default_number_of_replicates(spark, tmp_path):
    rng = np.random.default_rng(11)
    rows = [(i, 1, "FO"[rng.integers(0, 2)], float(rng.integers(100, 130) * 1000), f"{1 + i % 2}-P") for i in range(120)]
    orders = spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string")
    orders = orders.withColumn("o_totalprice", F.col("o_totalprice") - F.when(F.col("o_orderstatus") == "O", 55_000).otherwise(0))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "M")], "c_custkey bigint, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["dataset_id"]: r for r in detection_queries.q_eer_report_ci(spark, str(tmp_path)).collect()}
    assert got.keys() == {"1-P", "2-P"}
    for name, row in got.items():
        own = [(price // 1000 + (5 if s == "O" else 0), int(s == "O")) for _, _, s, price, d in rows if d == name]
        lo, hi = np.quantile(drawn_by_hand(*zip(*own), name, 1000), [0.025, 0.975])
        assert (row["ci_lo_pct"], row["ci_hi_pct"]) == (pytest.approx(100 * lo, abs=0.0051), pytest.approx(100 * hi, abs=0.0051))


def test_counted_draws_are_the_joined_ones(spark, monkeypatch):
    """Replicates that are not proven, groups that are left out and cut units give the same as rows joined one by one."""
    rng = np.random.default_rng(12)
    labels = rng.integers(0, 2, 2500)
    groups = {"tied": (rng.integers(0, 4, 2500) + labels, labels), "ü, own": (rng.normal(labels, 1.0), labels), "few": ([1, 2, 2, 3], [0, 1, 0, 1]),
              "steps": (np.arange(200.0), np.tile([0, 1], 100)), "ends": (np.r_[rng.normal(0, 1, 90), [np.inf, -np.inf] * 5], rng.integers(0, 2, 100)),
              "one_class": ([1, 2], [1, 1])}
    df = score_table(spark, groups).union(spark.createDataFrame([(None, 1.0, 0), (None, 2.0, 1)], "dataset_id string, score double, label long"))
    want = {(g, k): e for g, (s, y) in groups.items() for k, e in enumerate(drawn_by_hand(s, y, g, 12))}
    called, joined = [], bootstrap._joined
    monkeypatch.setattr(bootstrap, "_joined", lambda *a: called.append(a) or joined(*a))
    for case in ({}, {"COUNTED": 300, "AT_ONCE": 64, "SIGMAS": 0.2}, {"MOST": 50}):
        with monkeypatch.context() as m:
            for name, value in case.items():
                m.setattr(bootstrap, name, value)
            got = {(r["dataset_id"], r["rep"]): r["eer"] for r in bootstrap.eer_replicates_hashed(df, 12).collect()}
        assert got.keys() == want.keys()
        for k, e in want.items():
            assert got[k] == (None if e is None else pytest.approx(e))
        assert called or not case
    with monkeypatch.context() as m:  # nothing is sent on one by one where the bracket holds
        m.setattr(bootstrap, "_joined", None)
        assert bootstrap.eer_replicates_hashed(df.filter("dataset_id = 'tied'"), 12).count() == 12


@pytest.mark.parametrize("name", [b"1337,g,1,", b"x" * 50 + b",", "ü".encode() * 64])
def test_md5_of_many_texts(name):
    for reps, ranks in (((0, 13), (0, 120)), ((8, 10), (95, 1105)), ((998, 1001), (9990, 10010))):
        pieces = [zip(np.broadcast_to(r, len(h)).tolist(), h.tolist()) for r, h in md5_heads(name, *reps, *ranks, 70)]
        want = [(r, int(hashlib.md5(name + f"{r},{i}".encode()).hexdigest()[:8], 16)) for r in range(*reps) for i in range(*ranks)]
        assert sorted(x for p in pieces for x in p) == sorted(want)


def test_running_totals(spark):
    rng = np.random.default_rng(1)
    rows = [("ab"[i % 3 == 0], float(v), int(i)) for i, v in enumerate(rng.integers(0, 30, 200))]
    df = spark.createDataFrame(rows, "g string, v double, w long")
    for down in (False, True):
        for r in prefix.running_totals(df, ["g"], "v", ["w"], descending=down).collect():
            want = sum(w for g, v, w in rows if g == r["g"] and (v >= r["v"] if down else v <= r["v"]))
            assert r["cum_w"] == want


def test_ordinal_within(spark):
    rows = [("k", float(i % 17), i) for i in range(100)]
    df = spark.createDataFrame(rows, "g string, v double, id long")
    got = {r["id"]: r["pos"] for r in prefix.ordinal_within(df, ["g"], "v", ["id"], "pos").collect()}
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    assert got == {r[2]: i for i, r in enumerate(order)}


def test_properties(spark):
    groups = random_groups(7, True)
    df = score_table(spark, groups)
    base = {r["dataset_id"]: r["eer"] for r in D.eer(df, ["dataset_id"]).collect()}
    monotone = df.withColumn("score", F.exp(F.col("score") / 3) * 5 - 1)
    mirrored = df.withColumn("score", -F.col("score")).withColumn("label", 1 - F.col("label"))
    for other in (monotone, mirrored):
        for r in D.eer(other, ["dataset_id"]).collect():
            assert r["eer"] == pytest.approx(base[r["dataset_id"]])
            assert 0 <= r["eer"] <= 1


def test_by_group_matches_separate_sets(spark):
    rng = np.random.default_rng(5)
    rows = []
    for ds in "xy":
        for i in range(300):
            y = int(rng.random() < 0.6)
            kind = [None, "A", "B", "C"][rng.integers(0, 4)] if y else None
            rows.append((ds, kind, float(np.round(rng.normal(y * 0.8, 1), 1)), y))
    rows += [("z", "A", 1.0, 1), ("w", None, 1.0, 0)]
    rows += [("perfect", "A", 2.0, 1), ("perfect", None, 1.0, 0)]
    df = spark.createDataFrame(rows, "dataset_id string, attack_type string, score double, label long")
    for parts in ("1", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {(r["dataset_id"], r["attack_type"]): r for r in D.eer_by_group(df, ["dataset_id"]).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert set(got) == {(d, k) for d, k, _, y in rows if y and k}
        for (ds, kind), r in got.items():
            part = [(s, y) for d, k, s, y in rows if d == ds and (y == 0 or k == kind)]
            want = brute_eer([s for s, _ in part], [y for _, y in part])
            assert r["n_spoof"] == sum(y for _, y in part)
            assert r["eer"] == (None if want is None else pytest.approx(want, abs=1e-6))


def test_null_threshold_predicts_bonafide(spark):
    df = score_table(spark, {"g": ([1, 1, 1, 1], [0, 1, 0, 1])})
    row = D.operating_points(df).first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (2, 0, 2, 0)
    assert (row["fpr"], row["fnr"]) == (0.0, 1.0)


def test_rates_of_an_empty_class(spark):
    df = score_table(spark, {"g": ([1, 2], [1, 1])})
    row = D.error_rates(D.confusion_at(df, ["dataset_id"], 1.5)).first()
    assert row["fpr"] is None and row["fnr"] == 0.5


def test_bootstrap_follows_the_resampling_law(spark):
    rng = np.random.default_rng(11)
    y = (np.arange(240) % 3 > 0).astype(int)
    s = np.round(rng.normal(y * 1.0, 1.0), 1)
    df = score_table(spark, {"g": (s, y)})
    direct = []
    for _ in range(300):
        pos, neg = rng.choice(s[y == 1], (y == 1).sum()), rng.choice(s[y == 0], (y == 0).sum())
        direct.append(brute_eer(np.concatenate([pos, neg]), np.r_[np.ones(len(pos)), np.zeros(len(neg))]))
    got = [r["eer"] for r in bootstrap.eer_replicates(df, 300).collect()]
    assert len(got) == 300
    assert np.mean(got) == pytest.approx(np.mean(direct), abs=0.01)
    assert np.std(got) == pytest.approx(np.std(direct), rel=0.25)


def test_bootstrap_is_repeatable_and_bounded(spark):
    df = score_table(spark, random_groups(2, True))
    a = bootstrap.eer_bootstrap(df, 60, seed=1).orderBy("dataset_id").collect()
    b = bootstrap.eer_bootstrap(df.repartition(3), 60, seed=1).orderBy("dataset_id").collect()
    assert a == b
    point = {r["dataset_id"]: r["eer"] for r in D.eer(df, ["dataset_id"]).collect()}
    for r in a:
        assert r["n_boot"] == 60
        if r["dataset_id"] == "g3":
            assert r["lo"] <= point["g3"] <= r["hi"]
    assert bootstrap.eer_bootstrap(df, 0).count() == 0


def _shape(df):
    """Operators of the plan of a stored curve, without names and numbers."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return [line.strip(" :+-|").split(" ")[0] for line in lines]


def test_roc_has_no_window_over_a_whole_group(spark):
    """Row-level windows are partitioned by range, and the plan is the same at any size."""
    from detlake.catalog.views import view

    shapes = []
    for sf_dir in ("/root/testdata/sf0.001", "/root/testdata/sf0.1"):
        df = D.roc_nodes(view(spark, sf_dir, "v_line_scores"), ["dataset_id"])
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        rows = [line for line in plan.splitlines() if "Window [" in line and "score#" in line]
        assert rows and all("_range" in line for line in rows)
        assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()
        shapes.append(_shape(df))
    assert shapes[0] == shapes[1]


# --- brackets ------------------------------------------------------------------

def _bracket_cases():
    """Score tables where the crossing is easy, tied, at an end, on a long straight run, or infinite."""
    rng = np.random.default_rng(11)
    rows = []

    def add(g, label, scores):
        rows.extend((g, f"k{i % 3}", label, float(x)) for i, x in enumerate(scores))

    for g in range(6):
        n, m = int(rng.integers(1, 3000)), int(rng.integers(1, 3000))
        add(f"normal{g}", 1, rng.normal(rng.uniform(-1, 2), 1, n))
        add(f"normal{g}", 0, rng.normal(0, 1, m))
    add("ties", 1, rng.integers(0, 5, 2000))
    add("ties", 0, rng.integers(-2, 4, 2000))
    add("half", 1, [0.5] * 900 + list(rng.uniform(0, 1, 900)))
    add("half", 0, [0.5] * 900 + list(rng.uniform(0, 1, 900)))
    add("apart", 1, rng.uniform(2, 3, 1500))
    add("apart", 0, rng.uniform(0, 1, 1500))
    add("turned", 1, rng.uniform(0, 1, 1500))
    add("turned", 0, rng.uniform(2, 3, 1500))
    add("run", 1, np.r_[np.arange(0, 10), np.arange(5000, 5010)])  # the crossing lies in a run of 4000 equal steps
    add("run", 0, np.r_[np.arange(100, 4100), np.arange(6000, 6400)])
    add("same", 1, [1.0] * 50)
    add("same", 0, [1.0] * 70)
    add("infinite", 1, np.r_[[np.inf] * 300, rng.normal(1, 1, 300), [-np.inf] * 200])
    add("infinite", 0, np.r_[[np.inf] * 150, rng.normal(0, 1, 300), [-np.inf] * 400])
    add("largest", 1, np.r_[[1.7976931348623157e308] * 30, [np.inf] * 30, rng.normal(1, 1, 300)])
    add("largest", 0, np.r_[[1.7976931348623157e308] * 30, [np.inf] * 20, rng.normal(0, 1, 300)])
    add("one", 1, rng.normal(0, 1, 40))
    add("few", 1, [0.3])
    add("few", 0, [0.1, 0.2, 0.4])
    rows += [("normal0", None, 1, 0.1), ("normal0", "k0", 1, float("nan")), ("normal0", "k0", None, 0.2), ("normal0", "k0", 0, None)]
    return rows


@pytest.fixture(scope="module")
def bracket_cases(spark):
    rows = _bracket_cases()
    return spark.createDataFrame(rows, "g string, kind string, label int, score double").repartition(5), rows


def _same(got, want):
    assert set(got) == set(want)
    for k, v in want.items():
        for a, b in zip(got[k], v):
            assert (a is None and b is None) or a == b or abs(a - b) < 1e-9, (k, got[k], v)


@pytest.mark.parametrize("margin, few, grid", [(bracket.MARGIN, bracket.FEW, bracket.GRID), (1e-6, 0.0, 8)])
def test_bracketed_eer_is_the_whole_curves(spark, bracket_cases, monkeypatch, margin, few, grid):
    """Also with margins that miss the crossing at first and have to be widened."""
    monkeypatch.setattr(bracket, "MARGIN", margin)
    monkeypatch.setattr(bracket, "FEW", few)
    monkeypatch.setattr(bracket, "GRID", grid)
    df, rows = bracket_cases
    key = lambda r: (r["eer"], r["threshold"])
    whole = {r["g"]: key(r) for r in D.eer_of_nodes(D.score_nodes(df, ["g"]), ["g"]).collect()}
    _same({r["g"]: key(r) for r in D.eer(df, ["g"]).collect()}, whole)

    kinds = df.filter("label = 1 and kind is not null").select("g", F.col("kind").alias("attack_type")).distinct()
    copies = kinds.join(df, "g").filter("label = 0 or kind = attack_type")
    each = D.eer_of_nodes(D.score_nodes(copies, ["g", "attack_type"]), ["g", "attack_type"])
    want = {(r["g"], r["attack_type"]): (None if r["eer"] is None else round(r["eer"], 6),) for r in each.collect()}
    got = D.eer_by_group(df.withColumnRenamed("kind", "attack_type"), ["g"])
    n = {(r["g"], r["kind"]): r["n"] for r in D.gate(df).filter("label = 1").groupBy("g", "kind").agg(F.count("*").alias("n")).collect()}
    found = got.collect()
    assert all(r["n_spoof"] == n[r["g"], r["attack_type"]] for r in found)
    for r in found:
        a, b = r["eer"], want[r["g"], r["attack_type"]][0]
        assert (a is None and b is None) or abs(a - b) < 2e-6
    assert len(found) == len(want)


def test_few_scores_are_kept_inside_a_bracket(spark, monkeypatch):
    rows = spark.range(300_000).select(
        F.expr("if(id % 3 = 0, 'a', 'b')").alias("g"), F.expr("cast(id % 2 as int)").alias("label"),
        (F.randn(5) + F.expr("id % 2")).alias("score"))
    rows = rows.withColumn("attack_type", F.expr("if(label = 1, concat('k', hash(score) % 4), null)"))
    seen = {}
    store = D.materialize

    def counted(df, name):
        out = store(df, name)
        seen[name] = out.count()
        return out

    rows = store(rows, "bracket-scores")
    monkeypatch.setattr(D, "materialize", counted)
    D.eer(rows, ["g"]).collect()
    assert 0 < seen["eer_nodes"] < 0.06 * 300_000
    D.eer_by_group(rows, ["g"]).collect()
    assert 0 < seen["kind_scores"] < 0.12 * 300_000


def test_bracketed_eer_of_no_rows(spark):
    none = spark.createDataFrame([], "g string, attack_type string, label int, score double")
    assert D.eer(none, ["g"]).collect() == [] and D.eer_by_group(none, ["g"]).collect() == []


def test_negatives_at_or_above_the_top(spark, bracket_cases):
    df, rows = bracket_cases
    got = {(r["g"], r["kind"]): (r["n_spoof"], r["n_bonafide"], r["n_bonafide_at_top"]) for r in D.negatives_at_or_above(df, ["g"], ["kind"]).collect()}
    ok = [r for r in rows if r[2] is not None and r[3] is not None and not np.isnan(r[3])]
    want = {}
    for g, k in {(r[0], r[1]) for r in ok if r[2] == 1 and r[1] is not None}:
        spoof = [r[3] for r in ok if r[:2] == (g, k) and r[2] == 1]
        bona = [r[3] for r in ok if r[0] == g and r[2] == 0]
        if bona:
            want[g, k] = (len(spoof), len(bona), sum(x >= max(spoof) for x in bona))
    assert got == want
