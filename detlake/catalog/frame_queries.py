"""Registered queries: frames, signals and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from detlake import fixed_values as fv
from detlake.catalog.base import query, rounded
from detlake.catalog.views import view
from detlake.functions import recipes, signal as S
from detlake.operators import frames as Fr
from detlake.operators.quality import contract_failures
from detlake.plans import extract as X
from detlake.session import shared_path

# A small parameter set, so that the oracle can spell out the transform in SQL.
SR, N_FFT, HOP, WIN, N_FILTER, N_MELS, CEPS, WIDTH = 16000, 16, 4, 12, 6, 5, 6, 9


SMALL = {
    "target_sr": SR, "n_fft": N_FFT, "hop_length": HOP, "win_length": WIN, "n_filter": N_FILTER, "n_lfcc": CEPS,
    "n_mels": N_MELS, "with_deltas": True, "delta_width": WIDTH, "log_eps": 1e-10, "fmin": 0.0, "fmax": None,
}
SMALL_LFCC = recipes.lfcc("lfcc_small", SMALL)
SMALL_LOGMEL = recipes.logmel("logmel_small", SMALL)


def _frames(spark, sf_dir):
    return view(spark, sf_dir, "v_frames")


def _emb(spark, sf_dir):
    return view(spark, sf_dir, "v_emb_frames")


def _waves(spark, sf_dir):
    return view(spark, sf_dir, "v_wave")


# --- length ------------------------------------------------------------------

T = 70

SQL_FIX = f"""with c as (select utt_id u, count(*) t from v_frames where frame<{T} group by utt_id),
r as (select v.*, t, unnest(range(cast(ceil({T}.0/t) as bigint))) j
      from v_frames v join c on u=utt_id where frame<{T})
select dataset_id, utt_id, cast(frame+j*t as integer) frame, value from r where frame+j*t<{T}"""


@query("fix_length", SQL_FIX, ["v_frames"])
def q_fix_length(spark, sf_dir):
    return Fr.fix_length(_frames(spark, sf_dir), T)


@query("fix_length_arrays", """select utt_id, cast(i as integer) frame, samples[i%64+1] x
from (select *, unnest(range(100)) i from v_wave)""", ["v_wave"])
def q_fix_length_arrays(spark, sf_dir):
    fixed = _waves(spark, sf_dir).select("utt_id", Fr.fix_length_array(F.col("samples"), 100).alias("s"))
    return fixed.select("utt_id", F.posexplode("s").alias("frame", "x"))


@query("random_crop", """with c as (select utt_id u, max(frame)+1 t from v_frames group by utt_id),
s as (select v.*, ('0x' || substr(md5(concat_ws(',', '1337', '3', dataset_id, utt_id)),1,8))::bigint
   % (greatest(t-50,0)+1) st from v_frames v join c on u=utt_id),
m as (select dataset_id, utt_id, frame-st frame, value from s where frame>=st and frame-st<50),
k as (select utt_id u, count(*) t from m group by utt_id),
r as (select m.*, t, unnest(range(cast(ceil(50.0/t) as bigint))) j from m join k on u=utt_id)
select dataset_id, utt_id, cast(frame+j*t as integer) frame, value from r where frame+j*t<50""", ["v_frames"])
def q_random_crop(spark, sf_dir):
    return Fr.random_crop(_frames(spark, sf_dir), 50, epoch=3)


# --- slopes ------------------------------------------------------------------

def sql_delta(src: str, part: str, order: int, value: str = "value", width: int = 9) -> str:
    """Slope or curvature by window sums; edges take the nearest full window."""
    hs = range(1, width // 2 + 1)
    def weighted(h):
        w = [float(v) for v in S.slope_weights(h, order)]
        terms = []
        for i in range(-h, h + 1):
            if i < 0:
                terms.append(f"lag({value},{-i}) over w * ({w[i + h]!r})")
            elif i > 0:
                terms.append(f"lead({value},{i}) over w * ({w[i + h]!r})")
            else:
                terms.append(f"{value} * ({w[h]!r})")
        return " + ".join(terms)
    cases = " ".join(f"when h={h} then {weighted(h)}" for h in hs)
    return f"""with t as (select *, count(*) over (partition by {part}) n from {src}),
hh as (select *, cast(floor((least({width}, n)-1)/2) as bigint) h from t),
d as (select *, case {cases} end raw from hh window w as (partition by {part} order by frame)),
f as (select {part} part, frame fr, raw from d),
g as (select d.*, least(greatest(frame, h), n-1-h) near from d)
select g.* exclude (raw, near), f.raw d from g left join f on f.part=g.{part} and f.fr=g.near"""


@query("delta", f"select dataset_id, utt_id, frame, value, round(d, 6)+0.0 delta from ({sql_delta('v_frames', 'utt_id', 1)})",
       ["v_frames"])
def q_delta(spark, sf_dir):
    return Fr.with_delta(_frames(spark, sf_dir)).withColumn("delta", rounded("delta", 6))


@query("delta2", f"select dataset_id, utt_id, frame, value, round(d, 6)+0.0 delta2 from ({sql_delta('v_frames', 'utt_id', 2)})",
       ["v_frames"])
def q_delta2(spark, sf_dir):
    return Fr.with_delta(_frames(spark, sf_dir), order=2).withColumn("delta2", rounded("delta2", 6))


# --- pooling -----------------------------------------------------------------

POOL = ", ".join(f"round(avg(c{i}), 6)+0.0 mean{i}" for i in range(4)) + ", " + ", ".join(
    f"round(sqrt(greatest(var_pop(c{i}), 1e-5)), 6)+0.0 std{i}" for i in range(4))


def _spread(df, arrays):
    cols = [rounded(F.get(F.col(a), F.lit(i)), 6).alias(f"{n}{i}") for n, a in arrays for i in range(4)]
    return df.select("dataset_id", "utt_id", *cols)


@query("masked_stat_pool", f"""select dataset_id, utt_id, {POOL} from v_emb_frames
where frame < 8 + length(utt_id) group by dataset_id, utt_id""", ["v_emb_frames"])
def q_masked_stat_pool(spark, sf_dir):
    valid = F.col("frame") < 8 + F.length("utt_id")
    pooled = Fr.masked_stat_pool(_emb(spark, sf_dir), 4, valid=valid)
    return _spread(pooled, [("mean", "mean"), ("std", "std")])


@query("pooled_features", f"""with r as (select * from v_emb_frames
  union all select * replace (frame+16 as frame) from v_emb_frames)
select dataset_id, utt_id, {POOL} from r where frame<24 group by dataset_id, utt_id""", ["v_emb_frames"])
def q_pooled_features(spark, sf_dir):
    p = Fr.pooled_features(_emb(spark, sf_dir), 4, 24).select(
        "dataset_id", "utt_id", F.slice("features", 1, 4).alias("m"), F.slice("features", 5, 4).alias("s"))
    return _spread(p, [("mean", "m"), ("std", "s")])


@query("feature_contract", """select dataset_id, utt_id, count(*) n_bad, min(error) error from
(select dataset_id, utt_id, case when frame=15 and cast(substr(utt_id,2) as bigint)%10=0 then 'width 3, expected 4'
  when frame%4=1 and cast(substr(utt_id,2) as bigint)%7=0 then 'NaN or Inf in features' end error from v_emb_frames)
where error is not null group by dataset_id, utt_id""", ["v_emb_frames"])
def q_feature_contract(spark, sf_dir):
    """Frames with defects planted by key: a missing channel, NaN, infinity."""
    n = F.substring("utt_id", 2, 20).cast("long")
    bad = F.when(F.col("frame") == 1, F.lit(float("nan"))).otherwise(F.lit(float("inf"))).cast("float")
    damaged = (
        F.when((F.col("frame") == 15) & (n % 10 == 0), F.slice("coeffs", 1, 3))
        .when((F.col("frame") % 4 == 1) & (n % 7 == 0), F.concat(F.slice("coeffs", 1, 3), F.array(bad)))
        .otherwise(F.col("coeffs"))
    )
    return contract_failures(_emb(spark, sf_dir).withColumn("coeffs", damaged), 4)


# --- signal ------------------------------------------------------------------

SQL_FRAMES = f"""select dataset_id, utt_id, cast(f as integer) frame, cast(i as integer) i,
 case when {HOP}*f+i-{N_FFT // 2} between 0 and 63 then samples[{HOP}*f+i-{N_FFT // 2}+1] else 0.0 end x
from (select *, unnest(range(17)) f from v_wave), range({N_FFT}) r(i)"""


@query("frame_signal", SQL_FRAMES, ["v_wave"])
def q_frame_signal(spark, sf_dir):
    framed = Fr.frame_signal(_waves(spark, sf_dir), N_FFT, HOP)
    return framed.select("dataset_id", "utt_id", "frame", F.posexplode("samples").alias("i", "x"))


LEFT = (N_FFT - WIN) // 2
SQL_POWER = f"""select dataset_id, utt_id, frame, k,
 power(sum(x*w*cos(2*pi()*k*i/{N_FFT})), 2) + power(sum(x*w*sin(2*pi()*k*i/{N_FFT})), 2) e
from (select *, case when i between {LEFT} and {LEFT + WIN - 1} then 0.5-0.5*cos(2*pi()*(i-{LEFT})/{WIN}) else 0 end w
      from ({SQL_FRAMES})), (select cast(unnest(range({N_FFT // 2 + 1})) as integer) k)
group by dataset_id, utt_id, frame, k"""


def _long(spark, sf_dir, extractor, index, value, digits):
    frames = X.extracted(X.extract(_waves(spark, sf_dir), extractor, double=True))
    rows = frames.select("dataset_id", "utt_id", "frame", F.posexplode("coeffs").alias(index, value))
    return rows.withColumn(value, rounded(value, digits))


@query("power_spectrum", f"select dataset_id, utt_id, frame, k, round(e, 7)+0.0 e from ({SQL_POWER})", ["v_wave"])
def q_power_spectrum(spark, sf_dir):
    return _long(spark, sf_dir, recipes.spectrum("power_small", SMALL), "k", "e", 7)


def sql_triangles(edges: str, n: int, norm: bool) -> str:
    """``m, k, w``: triangles over the bins between the corners of ``edges(j, hz)``."""
    area = "2/(r.hz-l.hz)" if norm else "1"
    f = f"(k*{SR / 2.0!r}/{N_FFT // 2})"
    return f"""select cast(c.j-1 as integer) m, cast(k as integer) k, {area} *
 greatest(0, least(({f}-l.hz)/(c.hz-l.hz), (r.hz-{f})/(r.hz-c.hz))) w
from ({edges}) l join ({edges}) c on c.j=l.j+1 join ({edges}) r on r.j=c.j+1, range({N_FFT // 2 + 1}) b(k)
where c.j between 1 and {n}"""


LINEAR_EDGES = f"select j, j*{SR / 2.0!r}/{N_FILTER + 1} hz from range({N_FILTER + 2}) e(j)"
SQL_BANK = f"""select dataset_id, utt_id, frame, m, sum(e*w) e
from ({SQL_POWER}) p join ({sql_triangles(LINEAR_EDGES, N_FILTER, False)}) f using (k)
group by dataset_id, utt_id, frame, m"""


@query("linear_filterbank", f"select dataset_id, utt_id, frame, m, round(e, 7)+0.0 e from ({SQL_BANK})", ["v_wave"])
def q_linear_filterbank(spark, sf_dir):
    return _long(spark, sf_dir, recipes.bands("bands_small", SMALL), "m", "e", 7)


SQL_CEPS = f"""select dataset_id, utt_id, utt_id || ':' || cast(c as string) uc, frame, cast(c as integer) c,
 sum(ln(e+1e-10)*cos(pi()*c*(2*m+1)/(2.0e0*{N_FILTER}))) * sqrt(2.0e0/{N_FILTER}) * case when c=0 then sqrt(0.5e0) else 1 end v
from ({SQL_BANK}), range({CEPS}) q(c) group by dataset_id, utt_id, frame, c"""


@query("lfcc", f"""with ceps as ({SQL_CEPS}), d1 as ({sql_delta('ceps', 'uc', 1, 'v')}),
d2 as ({sql_delta('ceps', 'uc', 2, 'v')})
select dataset_id, utt_id, frame, c, round(v, 5)+0.0 v from ceps
union all select dataset_id, utt_id, frame, cast(c+{CEPS} as integer), round(d, 5)+0.0 from d1
union all select dataset_id, utt_id, frame, cast(c+{2 * CEPS} as integer), round(d, 5)+0.0 from d2""", ["v_wave"])
def q_lfcc(spark, sf_dir):
    return _long(spark, sf_dir, SMALL_LFCC, "c", "v", 5)


MEL_TOP = float(S.hz_to_mel(SR / 2.0))
KNEE = fv.MEL_BREAK_HZ / fv.MEL_HZ_PER_STEP
MEL_EDGES = f"""select j, case when j*{MEL_TOP!r}/{N_MELS + 1} < {KNEE!r}
 then j*{MEL_TOP!r}/{N_MELS + 1}*{fv.MEL_HZ_PER_STEP!r}
 else 1000.0e0*exp(ln(6.4e0)/27.0e0*(j*{MEL_TOP!r}/{N_MELS + 1}-{KNEE!r})) end hz from range({N_MELS + 2}) e(j)"""


@query("logmel", f"""select dataset_id, utt_id, frame, m, round(10*log10(greatest(1e-10, sum(e*w))), 5)+0.0 v
from ({SQL_POWER}) p join ({sql_triangles(MEL_EDGES, N_MELS, True)}) f using (k)
group by dataset_id, utt_id, frame, m""", ["v_wave"])
def q_logmel(spark, sf_dir):
    return _long(spark, sf_dir, SMALL_LOGMEL, "m", "v", 5)


@query("feature_variants", " union all ".join(
    f"select dataset_id, '{e.feature_id}' feature_id, {e.channels} channels, count(*)*17 n_frames from v_wave group by dataset_id"
    for e in (SMALL_LFCC, SMALL_LOGMEL)), ["v_wave"])
def q_feature_variants(spark, sf_dir):
    """Two parameter sets over the same signals stay apart by ``feature_id``."""
    out = []
    for e in (SMALL_LFCC, SMALL_LOGMEL):
        frames = X.extracted(X.extract(_waves(spark, sf_dir), e))
        out.append(frames.groupBy("dataset_id").agg(
            F.lit(e.feature_id).alias("feature_id"), F.max(F.size("coeffs")).alias("channels"),
            F.count("*").alias("n_frames")))
    return out[0].unionByName(out[1])


def _flawed_waves(spark, sf_dir):
    """Signals of which some have another sample rate, so that their rows fail."""
    odd = F.substring("utt_id", 2, 20).cast("long") % 25 == 3
    return _waves(spark, sf_dir).withColumn("sr", F.when(odd, 8000).otherwise(F.col("sr")))


SQL_RUN = """select dataset_id, cast(count(*) as bigint) total,
 cast(sum(case when cast(substr(utt_id,2) as bigint)%25=3 then 0 else 1 end) as bigint) written,
 cast(0 as bigint) skipped, cast(sum(case when cast(substr(utt_id,2) as bigint)%25=3 then 1 else 0 end) as bigint) failed,
 true ok from v_wave group by dataset_id"""


@query("extract_features", SQL_RUN, ["v_wave"])
def q_extract_features(spark, sf_dir):
    return X.extract_features(_flawed_waves(spark, sf_dir), SMALL_LFCC, shared_path(spark, "features"))


@query("run_stats", SQL_RUN.replace("cast(count(*) as bigint) total,\n cast(sum(case when cast(substr(utt_id,2) as bigint)%25=3 then 0 else 1 end) as bigint) written,\n cast(0 as bigint) skipped",
       "cast(count(*) as bigint) total, cast(0 as bigint) written,\n cast(sum(case when cast(substr(utt_id,2) as bigint)%25=3 then 0 else 1 end) as bigint) skipped"), ["v_wave"])
def q_run_stats(spark, sf_dir):
    """Counts of a second run: everything that worked is skipped, failures fail again."""
    root = shared_path(spark, "features")
    X.extract_features(_flawed_waves(spark, sf_dir), SMALL_LFCC, root)
    return X.extract_features(_flawed_waves(spark, sf_dir), SMALL_LFCC, root)


@query("write_features", f"""select dataset_id, '{SMALL_LFCC.feature_id}' feature_id, count(*) n_utt, count(*)*17 n_rows
from v_wave where cast(substr(utt_id,2) as bigint)%25<>3 group by dataset_id""", ["v_wave"])
def q_write_features(spark, sf_dir):
    root = shared_path(spark, "features")
    X.extract_features(_flawed_waves(spark, sf_dir), SMALL_LFCC, root)
    t = X.read_table(spark, root).filter(F.col("status") == "ok")
    return t.groupBy("dataset_id", "feature_id").agg(
        F.count_if(F.col("frame") == 0).alias("n_utt"), F.count("*").alias("n_rows"))


@query("scan_features", """select dataset_id, utt_id, cast(17 as bigint) n_frames, cast(18 as integer) channels
from v_wave where dataset_id='emb1' and cast(substr(utt_id,2) as bigint)%25<>3""", ["v_wave"])
def q_scan_features(spark, sf_dir):
    from detlake.sources.tables import scan_features

    root = shared_path(spark, "features")
    X.extract_features(_flawed_waves(spark, sf_dir), SMALL_LFCC, root)
    frames = scan_features(spark, root, SMALL_LFCC.feature_id, ["emb1"])
    return frames.groupBy("dataset_id", "utt_id").agg(
        F.count("*").alias("n_frames"), F.min(F.size("coeffs")).alias("channels"))


@query("incremental_features", """select dataset_id, count(*) n_utt, count(*)*17 n_rows from v_wave group by dataset_id""",
       ["v_wave"])
def q_incremental_features(spark, sf_dir):
    """Two drains of the same folder as a stream; the second finds nothing new."""
    from detlake.streaming.incremental import incremental_features, waveform_stream

    schema = spark.read.parquet(f"{sf_dir}/embeddings.parquet").schema
    root, checkpoint = shared_path(spark, "features"), shared_path(spark, "stream")
    for _ in range(2):
        raw = waveform_stream(spark, sf_dir, schema, "embeddings.parquet")
        waves = raw.select(
            F.concat(F.lit("emb"), F.col("vec_id") % 3).alias("dataset_id"),
            F.concat(F.lit("E"), "vec_id").alias("utt_id"),
            F.lit(SR).alias("sr"), F.col("embedding").alias("samples"))
        incremental_features(waves, SMALL_LFCC, root, checkpoint)
    t = X.read_table(spark, root).filter(F.col("status") == "ok")
    return t.groupBy("dataset_id").agg(
        F.count_if(F.col("frame") == 0).alias("n_utt"), F.count("*").alias("n_rows"))
