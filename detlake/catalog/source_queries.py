"""Registered queries: sources, sinks, normalisation and manifest indexes."""

from __future__ import annotations

import io
import uuid
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from detlake import fixed_values as fv, schema
from detlake.catalog.base import query, rounded
from detlake.catalog.views import table, view
from detlake.functions import labels as L, paths as P
from detlake.operators import resume
from detlake.plans.manifest import build_manifest
from detlake.session import shared_path
from detlake.sinks import tables as sinks
from detlake.sources import adapters as A, protocol as proto, tables as src
from detlake.sources.files import content_digests, write_files
from detlake.sources.listing import describe_listing, scan_audio_listing
from detlake.sources.waveforms import decode_wav, waveform_ingest


# --- stored inputs derived from the tables -----------------------------------

def key_lines(spark, sf_dir) -> DataFrame:
    """Key lines as text files, with blank lines between, read as a protocol."""
    path = shared_path(spark, "keys")
    v = view(spark, sf_dir, "v_keys")
    text = F.when(F.col("doc_id") % 4 == 0, F.concat("line", F.lit("\n  \n"))).otherwise(
        F.concat(F.lit("  "), F.replace("line", F.lit(" "), F.lit("\t")))
    )
    v.select(text.alias("value")).write.text(path)
    return proto.read_protocol(spark, path)


def key_rows(spark, sf_dir) -> DataFrame:
    return proto.protocol_fields(key_lines(spark, sf_dir), fv.KEYS_13_FIELDS)


def protocol_rows(spark, sf_dir) -> DataFrame:
    """Rows of the 5-field protocol with their split."""
    v = view(spark, sf_dir, "v_protocol")
    lines = v.select("word", proto.split_fields(F.col("line")).alias("parts"))
    rows = proto.protocol_fields(lines, fv.PROTOCOL_5_FIELDS)
    return rows.withColumn("split", L.native_split(F.col("word"))).drop("word")


def flac_listing(spark, sf_dir) -> DataFrame:
    files = describe_listing(view(spark, sf_dir, "v_flac"))
    word = F.regexp_extract(P.path_part(F.col("rel"), 0), r"set_(\w+)", 1)
    return files.withColumn("split", L.native_split(word))


# --- scans -------------------------------------------------------------------

SQL_PARTS = """select line, string_split(line, ' ') p from v_keys"""


@query("scan_protocol", "select array_to_string(p, '|') fields, cast(len(p) as integer) n_fields from (" + SQL_PARTS + ")",
       ["v_keys"])
def q_scan_protocol(spark, sf_dir):
    return key_lines(spark, sf_dir).select(
        F.array_join("parts", "|").alias("fields"), F.size("parts").alias("n_fields"))


@query("protocol_fields", """select p[1] speaker_id, p[2] utt_id, p[3] "condition", p[5] attack, p[6] label, p[9] vocoder
from (""" + SQL_PARTS + ")", ["v_keys"])
def q_protocol_fields(spark, sf_dir):
    return key_rows(spark, sf_dir).drop("file", "block", "pos")


@query("scan_audio_listing", """select 'event_type=' || event_type folder, '.wav' suffix, count(distinct user_id % 16) n_files,
 true has_bytes from events group by event_type""")
def q_scan_audio_listing(spark, sf_dir):
    """Files with audio names that the events are written to: per type a folder of up to 16, one file in each."""
    root = shared_path(spark, "listing")
    events = table(spark, sf_dir, "events").select("event_type", "user_id", "value", F.expr("user_id % 16").alias("part"))
    events.repartition("event_type", "part").write.partitionBy("event_type", "part").option("extension", "wav").csv(root)
    files = scan_audio_listing(spark, root)
    return files.groupBy(P.path_part(F.col("rel"), 0).alias("folder"), "suffix").agg(
        F.count("*").alias("n_files"), (F.sum("length") > 0).alias("has_bytes"))


SQL_NA = """('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>',
 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"""
SQL_INDEX = """select utt_id, path, cast(label as string) label, split, dataset_id source_dataset_id, utt_id source_utt_id,
 case when attack_type is null then case when utt_id like '%1' then 'NA' else '' end
  when attack_type='MACHINERY' then 'say "hi", there' else attack_type end attack_type from v_manifest"""


def _csv_index(spark, sf_dir):
    """The manifest written as an index CSV, with quotes and missing-value tokens."""
    path = shared_path(spark, "index")
    m = view(spark, sf_dir, "v_manifest")
    attack = (
        F.when(F.col("attack_type").isNull(), F.when(F.endswith("utt_id", F.lit("1")), "NA").otherwise(""))
        .when(F.col("attack_type") == "MACHINERY", 'say "hi", there')
        .otherwise(F.col("attack_type"))
    )
    index = m.select("utt_id", "path", F.col("label").cast("string").alias("label"), "split",
                     F.col("dataset_id").alias("source_dataset_id"),
                     F.col("utt_id").alias("source_utt_id"), attack.alias("attack_type"))
    sinks.write_csv(index, path)
    return src.scan_csv_index(spark, path)


@query("scan_csv_index", f"select * replace (case when attack_type in {SQL_NA} then null else attack_type end as attack_type) from ({SQL_INDEX})",
       ["v_manifest"])
def q_scan_csv_index(spark, sf_dir):
    return _csv_index(spark, sf_dir)


@query("write_csv", "select source_dataset_id, count(*) n_rows, count(distinct utt_id) n_utt from (" + SQL_INDEX + ") group by 1",
       ["v_manifest"])
def q_write_csv(spark, sf_dir):
    return _csv_index(spark, sf_dir).groupBy("source_dataset_id").agg(
        F.count("*").alias("n_rows"), F.countDistinct("utt_id").alias("n_utt"))


@query("scan_manifest_pruned", """select replace(dataset_id, ' ', '_') || '__' || utt_id utt_id, 'audio/' || dataset_id || '/' || utt_id || '.flac' path
from v_manifest""", ["v_manifest"])
def q_scan_manifest_pruned(spark, sf_dir):
    """A manifest built by an adapter, stored, and read back with two columns."""
    m = view(spark, sf_dir, "v_manifest")
    name = F.concat_ws("__", F.replace("dataset_id", F.lit(" "), F.lit("_")), "utt_id")
    path = shared_path(spark, "index")
    place = F.concat(F.lit("audio/"), "dataset_id", F.lit("/"), "utt_id", F.lit(".flac"))
    index = m.select(name.alias("utt_id"), place.alias("path"), F.col("label").cast("string").alias("label"), "split",
                     F.col("dataset_id").alias("source_dataset_id"), F.col("utt_id").alias("source_utt_id"), "attack_type")
    sinks.write_csv(index, path)
    out = shared_path(spark, "manifest")
    build_manifest(spark, "csv_index", "mini", out=out, index_path=path, audio_root=index.select("path"))
    return src.scan_manifest(spark, out, ["utt_id", "path"])


@query("table_rowcount", "select count(*) n_rows from lineitem")
def q_table_rowcount(spark, sf_dir):
    return src.footer_rowcount(spark, f"{sf_dir}/lineitem.parquet")


SQL_LATEST = """select run, epoch, train_loss, val_eer, val_threshold, lr from v_history
 qualify row_number() over (partition by run, epoch order by seq desc)=1"""


def _history_files(spark, sf_dir):
    """History records as JSON lines in append order, with broken and blank lines."""
    path = shared_path(spark, "history")
    h = view(spark, sf_dir, "v_history")
    rec = F.to_json(F.struct("run", "epoch", "train_loss", "val_eer", "val_threshold", "lr"),
                    {"ignoreNullFields": "false"})
    line = F.when(F.col("epoch") % 5 == 0, F.concat(rec, F.lit('\n\n{"epoch": 12, "train_'))).otherwise(rec)
    (h.repartition("run", "epoch").sortWithinPartitions("run", "epoch", "seq")
     .select(line.alias("value")).write.text(path))
    return path


def _run_history_schema():
    from pyspark.sql import types as T

    return T.StructType([T.StructField("run", T.StringType())] + schema.HISTORY.fields)


@query("scan_history_jsonl", SQL_LATEST, ["v_history"])
def q_scan_history_jsonl(spark, sf_dir):
    log = src.scan_history(spark, _history_files(spark, sf_dir), _run_history_schema())
    return resume.latest_wins(log, ["run", "epoch"], ["seq"]).drop("seq")


@query("append_history", SQL_LATEST.replace("from v_history", "from v_history where epoch<=60"), ["v_history"])
def q_append_history(spark, sf_dir):
    """Seven appends per run, then the tail after epoch 60 cut as a resume does."""
    path = shared_path(spark, "history")
    h = view(spark, sf_dir, "v_history")
    cols = ["run", "epoch", "train_loss", "val_eer", "val_threshold", "lr"]
    for seq in range(1, 8):
        sinks.append_history(h.filter(F.col("seq") == seq).select(*cols), path)
    log = src.scan_history(spark, path, _run_history_schema())
    last = resume.latest_wins(log, ["run", "epoch"], ["seq"]).drop("seq")
    return resume.history_truncate(last, 60)


def _encode_wav(samples: DataFrame) -> DataFrame:
    """Stereo 16-bit WAV bytes of each signal; the channels differ by a constant."""

    @F.pandas_udf("binary")
    def encode(col: pd.Series, sr: pd.Series) -> pd.Series:
        out = []
        for x, rate in zip(col, sr):
            left = np.round(np.asarray(x, np.float64) * 20000).astype(np.int64)
            pcm = np.stack([left, left + 64], axis=1).astype("<i2")
            buf = io.BytesIO()
            with wave.open(buf, "wb") as f:
                f.setnchannels(2)
                f.setsampwidth(2)
                f.setframerate(int(rate))
                f.writeframes(pcm.tobytes())
            out.append(buf.getvalue())
        return pd.Series(out)

    return samples.withColumn("content", encode("samples", "sr")).drop("samples")


def _wav_rows(spark, sf_dir):
    """WAV bytes of the signals: some at another rate, some cut inside the header."""
    n = F.substring("utt_id", 2, 20).cast("long")
    rows = view(spark, sf_dir, "v_wave").withColumn("sr", F.when(n % 25 == 3, 8000).otherwise(16000))
    wav = _encode_wav(rows).drop("sr", "label")
    return wav.withColumn("content", F.when(n % 25 == 4, F.substring("content", 1, 20)).otherwise(F.col("content")))


@query("decode_wav", """select dataset_id, utt_id,
 case when n%25 in (3,4) then null else cast(64 as integer) end n_samples,
 case when n%25=3 then 'ValueError: sample rate 8000, expected 16000' when n%25=4 then 'EOFError: ' end error
from (select *, cast(substr(utt_id,2) as bigint) n from v_wave)""", ["v_wave"])
def q_decode_wav(spark, sf_dir):
    d = decode_wav(_wav_rows(spark, sf_dir), 16000)
    return d.select("dataset_id", "utt_id",
                    F.when(F.col("samples").isNotNull(), F.size("samples")).alias("n_samples"), "error")


@query("waveform_ingest", """select dataset_id, utt_id,
 case when n%25 in (3,4,5) then null else cast(64 as integer) end n_samples,
 case when n%25=3 then 'ValueError: sample rate 8000, expected 16000' when n%25=4 then 'EOFError: '
      when n%25=5 then 'FileNotFoundError: no audio file' end error
from (select *, cast(substr(utt_id,2) as bigint) n from v_wave) where n%4<>1""", ["v_wave"])
def q_waveform_ingest(spark, sf_dir):
    """Real files in a folder per dataset: some missing, some broken, a quarter done before."""
    n = F.substring("utt_id", 2, 20).cast("long")
    path = F.concat(F.lit("set="), "dataset_id", F.lit("/"), "utt_id", F.lit(".wav"))
    rows = _wav_rows(spark, sf_dir).withColumn("path", path)
    root = shared_path(spark, "audio")
    write_files(rows.filter(n % 25 != 5), root)
    manifest = view(spark, sf_dir, "v_wave").select("dataset_id", "utt_id", path.alias("path"))
    waves = waveform_ingest(spark, manifest, root, 16000, done=manifest.filter(n % 4 == 1))
    return waves.select("dataset_id", "utt_id",
                        F.when(F.col("samples").isNotNull(), F.size("samples")).alias("n_samples"), "error")


@query("downmix_mono", """select dataset_id, utt_id, cast(i as integer) i,
 round((round_even(cast(samples[i+1] as double)*20000, 0)+32)/32768.0e0, 6)+0.0 x
from (select *, cast(unnest(range(64)) as bigint) i from v_wave) where cast(substr(utt_id,2) as bigint)%25 not in (3,4)""", ["v_wave"])
def q_downmix_mono(spark, sf_dir):
    d = decode_wav(_wav_rows(spark, sf_dir), 16000).filter("error is null")
    return d.select("dataset_id", "utt_id", F.posexplode("samples").alias("i", "x")).withColumn(
        "x", rounded(F.col("x").cast("double"), 6))


# --- sinks -------------------------------------------------------------------

@query("write_table_atomic", "select dataset_id, count(*) n_rows from v_manifest where split='dev' group by dataset_id",
       ["v_manifest"])
def q_write_table_atomic(spark, sf_dir):
    """A table is replaced under its name: what the name means afterwards counts."""
    root, name = shared_path(spark, "versioned"), f"manifest_{uuid.uuid4().hex}"
    m = view(spark, sf_dir, "v_manifest")
    sinks.replace_table(m, name, root)
    sinks.replace_table(m.filter("split = 'dev'"), name, root)
    return spark.table(name).groupBy("dataset_id").agg(F.count("*").alias("n_rows"))


@query("content_digests", """select c_nationkey || '.txt' path, cast(length(t) as bigint) length, sha256(sha256(t)) digest
from (select c_nationkey, string_agg(c_name, ',' order by c_name) t from customer group by c_nationkey)""")
def q_content_digests(spark, sf_dir):
    """Files with the customers of each nation, told apart by what is in them."""
    names = F.array_join(F.sort_array(F.collect_list("c_name")), ",")
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.encode(names, "utf-8").alias("content"))
    root = shared_path(spark, "weights")
    write_files(rows.select(F.concat("c_nationkey", F.lit(".txt")).alias("path"), "content"), root)
    return content_digests(spark, root)


@query("write_score_shards", """select dataset_id, utt_id, round(cast(cast(score + case when cast(substr(utt_id,2) as bigint)%3=0 then 0.5 else 0 end as float) as double), 3) score
from v_scores""", ["v_scores"])
def q_write_score_shards(spark, sf_dir):
    """Two parts of one run and one of another; a third of the keys is scored again."""
    root = shared_path(spark, "shards")
    s = view(spark, sf_dir, "v_scores").select("dataset_id", "utt_id", "score")
    again = s.filter(F.substring("utt_id", 2, 20).cast("long") % 3 == 0)
    sinks.write_score_shards(s, root, "run-a")
    sinks.write_score_shards(s.withColumn("score", F.lit(0.0)), root, "run-b")
    sinks.write_score_shards(again.withColumn("score", F.col("score") + 0.5), root, "run-a")
    merged = sinks.merge_score_shards(sinks.read_score_shards(spark, root, "run-a"))
    return merged.withColumn("score", rounded(F.col("score").cast("double"), 3))


# --- normalisation -----------------------------------------------------------

def sql_norm(col: str, words: str) -> str:
    t = f"trim(coalesce({col}, ''))"
    return f"case when lower({t}) in {words} then null else {t} end"


SPOOF_WORDS = "('', '-', 'bonafide', 'unknown', 'none', 'n/a')"
SQL_KEYROWS = """select p[1] speaker_id, p[2] utt_id, p[3] cond, p[4] trans, p[5] attack, p[6] lab, p[9] voc,
 case when lower(p[6])='spoof' then cast(1 as bigint) else cast(0 as bigint) end l from (select string_split(line, ' ') p from v_keys)"""


def _keys(spark, sf_dir):
    lines = view(spark, sf_dir, "v_keys").select(proto.split_fields(F.col("line")).alias("parts"))
    return proto.protocol_fields(lines, {**fv.KEYS_13_FIELDS, "transmission": 3})


@query("label_to_int", f"select utt_id, l label from ({SQL_KEYROWS})", ["v_keys"])
def q_label_to_int(spark, sf_dir):
    k = _keys(spark, sf_dir).withColumn("label", F.concat(F.lit(" "), F.initcap("label"), F.lit("\t")))
    return k.select("utt_id", L.label_to_int(F.col("label")).alias("label"))


@query("norm_attack", f"select utt_id, case when l=0 then null else {sql_norm('attack', SPOOF_WORDS)} end attack_type from ({SQL_KEYROWS})",
       ["v_keys"])
def q_norm_attack(spark, sf_dir):
    label = L.label_to_int(F.col("label"))
    return _keys(spark, sf_dir).select("utt_id", L.norm_attack(F.col("attack"), label).alias("attack_type"))


@query("norm_vocoder", f"select utt_id, case when l=0 then null else {sql_norm('voc', SPOOF_WORDS)} end vocoder from ({SQL_KEYROWS})",
       ["v_keys"])
def q_norm_vocoder(spark, sf_dir):
    label = L.label_to_int(F.col("label"))
    return _keys(spark, sf_dir).select("utt_id", L.norm_vocoder(F.col("vocoder"), label).alias("vocoder"))


CONDITION_WORDS = "('', '-', 'n/a')"


@query("norm_condition", f"""select utt_id, {sql_norm('cond', CONDITION_WORDS)} "condition",
 {sql_norm('trans', CONDITION_WORDS)} transmission from ({SQL_KEYROWS})""", ["v_keys"])
def q_norm_condition(spark, sf_dir):
    return _keys(spark, sf_dir).select(
        "utt_id", L.norm_condition(F.col("condition")).alias("condition"),
        L.norm_condition(F.col("transmission")).alias("transmission"))


URL_NAME = "regexp_extract(url, '([^/]*)$', 1)"


@query("container_codec", f"""select page_id, nullif(lower(regexp_extract({URL_NAME}, '^.+\\.([^.]+)$', 1)), '') codec from pages""")
def q_container_codec(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.container_codec(F.col("url")).alias("codec"))


SQL_AUDIO = r"select path, regexp_extract(path, '([^/]+)\.[^.]+$', 1) stem from {src} where lower(path) similar to '.*\.(flac|wav|mp3|m4a|ogg)'"


@query("path_relative_stem", "select path rel, stem utt_id from (" + SQL_AUDIO.format(src="v_flac") + ")", ["v_flac"])
def q_path_relative_stem(spark, sf_dir):
    rooted = view(spark, sf_dir, "v_flac").select(F.concat(F.lit("/data/raw/la/"), "path").alias("path"))
    files = describe_listing(rooted, "/data/raw/la")
    return files.select("rel", F.col("stem").alias("utt_id"))


SQL_DIRS = SQL_AUDIO.format(src="v_listing")


@query("utt_id_from_path", f"select path, replace(regexp_replace(path, '\\.[^.]*$', ''), '/', '__') utt_id from ({SQL_DIRS})",
       ["v_listing"])
def q_utt_id_from_path(spark, sf_dir):
    files = describe_listing(view(spark, sf_dir, "v_listing"))
    return files.select("path", P.utt_id_from_path(F.col("rel")).alias("utt_id"))


SQL_DIR_INDEX = f"""select 'dirs' dataset_id, replace(regexp_replace(path, '\\.[^.]*$', ''), '/', '__') utt_id, path,
 cast(case split_part(path,'/',2) when 'real' then 0 else 1 end as bigint) label,
 case split_part(path,'/',1) when 'training' then 'train' when 'validation' then 'dev' else 'test' end split,
 lower(regexp_extract(path, '\\.([^.]*)$', 1)) codec from ({SQL_DIRS})"""


@query("split_label_from_dirs", SQL_DIR_INDEX, ["v_listing"])
def q_split_label_from_dirs(spark, sf_dir):
    out = A.index_directory_driven("dirs", describe_listing(view(spark, sf_dir, "v_listing")))
    return out.select("dataset_id", "utt_id", "path", "label", "split", "codec")


@query("split_normalize", "select o_orderkey, case when word='eval' then 'test' else word end split from v_protocol",
       ["v_protocol"])
def q_split_normalize(spark, sf_dir):
    return view(spark, sf_dir, "v_protocol").select("o_orderkey", L.native_split(F.col("word")).alias("split"))


# --- indexes -----------------------------------------------------------------

MANIFEST_REST = 'cast(null as string) transmission, cast(null as bigint) sample_rate, cast(null as double) duration'


@query("index_protocol_driven", f"""select 'la19' dataset_id, 'O'||cast(r.o_orderkey as string) utt_id, f.path,
 l label, case when word='eval' then 'test' else word end split,
 case when l=0 then null else {sql_norm('attack', SPOOF_WORDS)} end attack_type,
 cast(null as string) "condition", cast(null as string) vocoder, sp speaker_id, 'flac' codec, {MANIFEST_REST}
from (select *, regexp_split_to_array(line, '\\s+')[1] sp, regexp_split_to_array(line, '\\s+')[4] attack,
  case when lower(regexp_split_to_array(line, '\\s+')[5])='spoof' then cast(1 as bigint) else cast(0 as bigint) end l from v_protocol) r
join v_flac f on regexp_extract(f.path, '([^/]+)\\.[^.]+$', 1) = 'O'||cast(r.o_orderkey as string)
 and split_part(f.path, '/', 1) = 'set_' || word""", ["v_protocol", "v_flac"])
def q_index_protocol_driven(spark, sf_dir):
    return A.index_protocol_driven("la19", protocol_rows(spark, sf_dir), flac_listing(spark, sf_dir))


@query("index_listing_driven", f"""select 'df21' dataset_id, k.utt_id, f.path, l label, 'test' split,
 case when l=0 then null else {sql_norm('attack', SPOOF_WORDS)} end attack_type,
 {sql_norm('cond', CONDITION_WORDS)} "condition", case when l=0 then null else {sql_norm('voc', SPOOF_WORDS)} end vocoder,
 speaker_id, lower(regexp_extract(f.path, '\\.([^.]*)$', 1)) codec, {MANIFEST_REST}
from ({SQL_KEYROWS}) k join ({SQL_DIRS}) f on f.stem=k.utt_id""", ["v_keys", "v_listing"])
def q_index_listing_driven(spark, sf_dir):
    files = describe_listing(view(spark, sf_dir, "v_listing"))
    return A.index_listing_driven("df21", files, key_rows(spark, sf_dir))


@query("index_csv_driven", f"""select 'mini' dataset_id, utt_id, path, cast(label as bigint) label, split,
 case when attack_type in {SQL_NA} then null else attack_type end attack_type, cast(null as string) "condition",
 cast(null as string) vocoder, cast(null as string) speaker_id, 'flac' codec, {MANIFEST_REST} from ({SQL_INDEX})""", ["v_manifest"])
def q_index_csv_driven(spark, sf_dir):
    return A.index_csv_driven("mini", _csv_index(spark, sf_dir))
