"""Domain views over the given tables.

Each view is one SQL text that Spark and the oracle both understand, with the
base tables as ``{name}``. They stand for the tables a user of the package has:
scores, manifests, protocols, listings, frames, waveforms, histories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from detlake.operators.prefix import ordinal_within
from detlake.session import materialize

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS: dict[str, str] = {}

# Scores: 5 datasets, 3 splits, 2 classes, 5 attacks, spoof without attack, ties.
VIEWS["v_scores"] = """
select o_orderpriority dataset_id, concat('O', cast(o_orderkey as string)) utt_id,
 case when o_orderkey%10<6 then 'train' when o_orderkey%10<8 then 'dev' else 'test' end split,
 cast(case when o_orderstatus='F' then 0 else 1 end as bigint) label,
 case when o_orderstatus<>'F' and o_orderkey%50<>0 then c_mktsegment end attack_type,
 cast(floor(o_totalprice/1000) as double) + case when o_orderstatus='F' then 0.0 else 60.0 end score
from {orders} join {customer} on o_custkey=c_custkey"""

# A canonical manifest over the same rows.
VIEWS["v_manifest"] = """
select o_orderpriority dataset_id, concat('O', cast(o_orderkey as string)) utt_id,
 concat('flac/O', cast(o_orderkey as string), '.flac') path,
 cast(case when o_orderstatus='F' then 0 else 1 end as bigint) label,
 case when o_orderkey%10<6 then 'train' when o_orderkey%10<8 then 'dev' else 'test' end split,
 case when o_orderstatus<>'F' and o_orderkey%50<>0 then c_mktsegment end attack_type,
 case when o_orderkey%4=0 then 'none' when o_orderkey%4=1 then 'low_mp3'
      when o_orderkey%4=2 then 'nocodec' end "condition",
 cast(null as string) transmission,
 case when o_orderstatus='O' and o_orderkey%3=0 then 'neural' end vocoder,
 concat('C', cast(o_custkey as string)) speaker_id,
 cast(16000 as bigint) sample_rate, 'flac' codec, o_totalprice/10000 duration
from {orders} join {customer} on o_custkey=c_custkey"""

# The same manifest with every kind of defect.
VIEWS["v_dirty"] = """
select case when o_orderkey%211=0 then 'elsewhere' else 'd' end dataset_id,
 case when o_orderkey%101=0 then null when o_orderkey%103=0 then '..'
      when o_orderkey%107=0 then concat('a/', cast(o_orderkey as string))
      when o_orderkey%109=0 then concat('O', cast(o_orderkey%7 as string))
      else concat('O', cast(o_orderkey as string)) end utt_id,
 case when o_orderkey%113=0 then '/abs.flac' when o_orderkey%127=0 then 'a/../b.flac'
      when o_orderkey%131=0 then concat('a', chr(92), 'b.flac')
      when o_orderkey%139=0 then null else 'flac/x.flac' end path,
 cast(case when o_orderkey%137=0 then 2 when o_orderkey%149=0 then 7
      when o_orderstatus='F' then 0 else 1 end as bigint) label,
 case when o_orderkey%151=0 then 'eval' when o_orderkey%157=0 then 'Train'
      when o_orderkey%10<6 then 'train' else 'test' end split,
 case when o_orderkey%163=0 then 'Unknown' when o_orderkey%167=0 then '-'
      when o_orderstatus<>'F' then 'A07' end attack_type,
 case when o_orderkey%173=0 then '-' when o_orderkey%179=0 then ' - ' end vocoder
from {orders}"""

# Protocol lines: 8-field layout with placeholders, and a 5-field one per split.
VIEWS["v_keys"] = """
select concat_ws(' ', source, concat('D_', cast(d.doc_id as string)),
 case when d.doc_id%3=0 then '-' when d.doc_id%3=1 then 'none' else 'low_mp3' end,
 case when d.doc_id%4=0 then '-' else 'loc_tx' end,
 case when quality=1 then case when d.doc_id%2=0 then '-' else 'bonafide' end
      when d.doc_id%5=0 then 'unknown' else lang end,
 case when quality=1 then 'bonafide' else 'spoof' end, 'notrim', 'eval',
 case when quality=1 then 'bonafide' when d.doc_id%5=1 then 'unknown' else 'neural' end,
 '-', '-', '-', '-') line,
 d.doc_id doc_id
from {documents} d join {labels} l on d.doc_id=l.doc_id"""

VIEWS["v_protocol"] = """
select case when o_orderkey%10<6 then 'train' when o_orderkey%10<8 then 'dev' else 'eval' end word,
 concat_ws('  ', concat('C', cast(o_custkey as string)), concat('O', cast(o_orderkey as string)), '-',
 case when o_orderstatus='F' then '-' when o_orderkey%50=0 then 'unknown' else replace(o_orderpriority, ' ', '_') end,
 case when o_orderstatus='F' then 'bonafide' else 'Spoof' end) line, o_orderkey
from {orders}"""

# Listings: one for the 5-field protocol with gaps and enrolment files, one by directory.
VIEWS["v_flac"] = """
select concat(case when o_orderkey%10<6 then 'set_train' when o_orderkey%10<8 then 'set_dev'
  else 'set_eval' end, case when o_orderkey%11=0 then '/flac/E' else '/flac/O' end,
  cast(o_orderkey as string), case when o_orderkey%2=0 then '.flac' else '.FLAC' end) path
from {orders} where o_orderkey%13<>0"""

VIEWS["v_listing"] = """
select concat(case when doc_id%4=0 then 'training/real/' when doc_id%4=1 then 'training/fake/'
 when doc_id%4=2 then 'validation/real/' else 'testing/fake/' end, 'D_', cast(doc_id as string),
 case when doc_id%2=0 then '.flac' when doc_id%3=0 then '.txt' else '.WAV' end) path
from {documents} where doc_id%7<>0"""

# Score parts: a key repeats; its records are ordered by date, part and supplier.
VIEWS["v_shards"] = """
select concat('L', cast(l_orderkey as string)) dataset_id,
 cast(l_linenumber as string) utt_id, l_shipdate, l_partkey, l_suppkey,
 l_extendedprice score from {lineitem}"""

# Epoch histories: three runs, a record per month and append.
VIEWS["v_history"] = """
select l_returnflag run, cast(year(l_shipdate)*12+month(l_shipdate)-23900 as bigint) epoch,
 cast(l_linenumber as bigint) seq,
 round(avg(l_tax), 6) train_loss,
 case when (year(l_shipdate)*12+month(l_shipdate))%9=0 then null
      else round(avg(l_discount), 3) end val_eer,
 round(avg(l_quantity), 3) val_threshold, 0.001e0 lr
from {lineitem} group by l_returnflag, year(l_shipdate)*12+month(l_shipdate), l_linenumber"""

# Embeddings as a signal of 64 samples and as 16 frames of 4 channels.
VIEWS["v_wave"] = """
select concat('emb', cast(vec_id%3 as string)) dataset_id,
 concat('E', cast(vec_id as string)) utt_id, 16000 sr, embedding samples,
 cast(label%2 as bigint) label from {embeddings}"""

# Bench scores: 3 datasets, 2 classes, one attack per ship year.
VIEWS["v_line_scores"] = """
select l_returnflag dataset_id,
 concat_ws('_', cast(l_orderkey as string), cast(l_linenumber as string)) utt_id, 'test' split,
 cast(case when l_linestatus='F' then 0 else 1 end as bigint) label,
 case when l_linestatus<>'F' then concat('Y', cast(year(l_shipdate) as string)) end attack_type,
 l_extendedprice + case when l_linestatus='F' then 0.0 else 9000.0 end score
from {lineitem}"""

# Frames: the events of a user in time order. Spark numbers them range by range.
VIEWS["v_frames"] = """
select 'ev' dataset_id, cast(user_id as string) utt_id,
 cast(row_number() over (partition by user_id order by ts, event_id)-1 as integer) frame, value
from {events}"""

VIEWS["v_emb_frames"] = """
select concat('emb', cast(vec_id%3 as string)) dataset_id,
 concat('E', cast(vec_id as string)) utt_id, cast(label%2 as bigint) label, cast(f as integer) frame,
 cast(embedding[4*f+1] as double) c0, cast(embedding[4*f+2] as double) c1,
 cast(embedding[4*f+3] as double) c2, cast(embedding[4*f+4] as double) c3
from (select *, unnest(range(16)) f from {embeddings})"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view as a DataFrame."""
    if name == "v_frames":
        return _frames(spark, sf_dir)
    if name == "v_emb_frames":
        return _emb_frames(spark, sf_dir)
    text = VIEWS[name].replace('"condition"', "condition")
    used = {t: table(spark, sf_dir, t) for t in BASE if "{" + t + "}" in text}
    return spark.sql(text, **used)


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.lit("ev").alias("dataset_id"), F.col("user_id").cast("string").alias("utt_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("t"),
        "event_id", "value",
    )
    numbered = ordinal_within(
        events, ["dataset_id", "utt_id"], "t", ["event_id"], "frame"
    )
    return materialize(
        numbered.select(
            "dataset_id", "utt_id", F.col("frame").cast("int").alias("frame"), "value"
        ),
        "frames",
    )


def _emb_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    waves = view(spark, sf_dir, "v_wave")
    rows = F.transform(
        F.sequence(F.lit(0), F.lit(15)), lambda f: F.slice("samples", f * 4 + 1, F.lit(4))
    )
    return waves.select(
        "dataset_id", "utt_id", "label", F.posexplode(rows).alias("frame", "coeffs")
    )


def oracle(views: list[str], body: str) -> str:
    """The body over the named views, as one statement on the base tables."""
    if not views:
        return body
    names = {t: t for t in BASE}
    parts = [f"{v} as ({VIEWS[v].format(**names)})" for v in views]
    return "with " + ",\n".join(parts) + f"\nselect * from ({body}) q"
