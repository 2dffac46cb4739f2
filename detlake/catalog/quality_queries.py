"""Registered queries: data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from detlake import fixed_values as fv
from detlake.catalog.base import query
from detlake.catalog.views import view
from detlake.operators import quality as Q, resume
from detlake.sources import adapters as A, protocol as proto
from detlake.catalog.source_queries import flac_listing, key_lines, key_rows, protocol_rows


def _dirty(spark, sf_dir):
    return view(spark, sf_dir, "v_dirty")


SENT = "('', '-', 'bonafide', 'unknown', 'none', 'n/a')"


@query("dq_null_required", " union all ".join(
    f"select '{c}' \"column\", cast(sum(case when {c} is null then 1 else 0 end) as bigint) n_bad from v_dirty"
    for c in ["dataset_id", "utt_id", "path", "label", "split"]), ["v_dirty"])
def q_null_required(spark, sf_dir):
    return Q.null_required(_dirty(spark, sf_dir))


@query("dq_label_domain", """select cast(label as string) "value", count(*) n_rows from v_dirty
 where label is not null and label not in (0,1) group by label""", ["v_dirty"])
def q_label_domain(spark, sf_dir):
    return Q.domain_violations(_dirty(spark, sf_dir), "label", [fv.LABEL_BONAFIDE, fv.LABEL_SPOOF])


@query("dq_split_domain", """select split "value", count(*) n_rows from v_dirty
 where split is not null and split not in ('train','dev','test') group by split""", ["v_dirty"])
def q_split_domain(spark, sf_dir):
    return Q.domain_violations(_dirty(spark, sf_dir), "split", fv.SPLITS)


@query("dq_duplicate_key", """select dataset_id, utt_id, count(*) n_rows from v_dirty
 group by dataset_id, utt_id having count(*)>1""", ["v_dirty"])
def q_duplicate_key(spark, sf_dir):
    return Q.duplicate_keys(_dirty(spark, sf_dir))


@query("dq_sentinels", f"""select 'attack_type' "column", lower(attack_type) "value", count(*) n_rows from v_dirty
 where lower(attack_type) in {SENT} group by 2 union all select 'vocoder', lower(vocoder), count(*) from v_dirty
 where lower(vocoder) in {SENT} group by 2""", ["v_dirty"])
def q_sentinels(spark, sf_dir):
    return Q.sentinel_values(_dirty(spark, sf_dir))


BAD_UTT = "utt_id is not null and (not regexp_full_match(utt_id, '[A-Za-z0-9._-]+') or utt_id in ('.','..'))"
BAD_PATH = "path is not null and (path like '/%' or contains(path, chr(92)) or list_contains(string_split(path,'/'),'..'))"


@query("dq_unsafe_utt_id", f"select utt_id, count(*) n_rows from v_dirty where {BAD_UTT} group by utt_id", ["v_dirty"])
def q_unsafe_utt_id(spark, sf_dir):
    bad = _dirty(spark, sf_dir).filter(Q.unsafe_utt_id(F.col("utt_id")))
    return bad.groupBy("utt_id").agg(F.count("*").alias("n_rows"))


@query("dq_unsafe_path", f"select path, count(*) n_rows from v_dirty where {BAD_PATH} group by path", ["v_dirty"])
def q_unsafe_path(spark, sf_dir):
    bad = _dirty(spark, sf_dir).filter(Q.unsafe_path(F.col("path")))
    return bad.groupBy("path").agg(F.count("*").alias("n_rows"))


@query("dq_foreign_dataset", """select dataset_id, count(*) n_rows from v_dirty
 where dataset_id is distinct from 'd' group by dataset_id""", ["v_dirty"])
def q_foreign_dataset(spark, sf_dir):
    return Q.foreign_dataset(_dirty(spark, sf_dir), "d")


KEY = "concat_ws('/', dataset_id, utt_id)"


@query("validation_report", f"""with v as (
{" union all ".join(f"select 'null_required' chk, '{c}' item, {KEY} example, 1 n from v_dirty where {c} is null" for c in ["dataset_id", "utt_id", "path", "label", "split"])}
union all select 'label_domain', cast(label as string), {KEY}, 1 from v_dirty where label not in (0,1)
union all select 'split_domain', split, {KEY}, 1 from v_dirty where split not in ('train','dev','test')
union all select 'sentinel', 'attack_type=' || lower(attack_type), {KEY}, 1 from v_dirty where lower(attack_type) in {SENT}
union all select 'sentinel', 'vocoder=' || lower(vocoder), {KEY}, 1 from v_dirty where lower(vocoder) in {SENT}
union all select 'unsafe_utt_id', null, utt_id, 1 from v_dirty where {BAD_UTT}
union all select 'unsafe_path', null, path, 1 from v_dirty where {BAD_PATH}
union all select 'foreign_dataset', dataset_id, {KEY}, 1 from v_dirty where dataset_id is distinct from 'd'
union all select 'duplicate_key', null, {KEY}, count(*) from v_dirty group by dataset_id, utt_id having count(*)>1),
r as (select *, row_number() over (partition by chk, item order by example) rn from v)
select chk "check", item, cast(sum(n) as bigint) n_bad,
 string_agg(example, '|' order by example) filter (where rn<=3) examples from r group by chk, item""", ["v_dirty"])
def q_validation_report(spark, sf_dir):
    out = Q.validation_report(_dirty(spark, sf_dir), "d")
    return out.withColumn("examples", F.array_join("examples", "|"))


# --- protocol and listing ----------------------------------------------------

@query("dq_protocol_duplicate", """select split_part(line, ' ', 1) source, count(*) n from v_keys
 group by 1 having count(*)>1""", ["v_keys"])
def q_protocol_duplicate(spark, sf_dir):
    """The key lines under a field that repeats, so that duplicates exist."""
    rows = proto.protocol_fields(key_lines(spark, sf_dir), {"source": 0, "utt_id": 1})
    return A.protocol_duplicates(rows, ["source"])


@query("dq_protocol_width", """select source, rn line_no, cast(n as integer) n_fields from
(select split_part(line, ' ', 1) source, row_number() over (partition by split_part(line, ' ', 1) order by doc_id) rn,
 case when doc_id%10=3 then 4 else 13 end n from v_keys) where n<6""", ["v_keys"])
def q_protocol_width(spark, sf_dir):
    """Short lines of a protocol file per source, by their number among non-blank lines.

    Every tenth line is cut and blank lines are put between; each file is written
    by one task in document order.
    """
    from detlake.session import shared_path

    v = view(spark, sf_dir, "v_keys")
    cut = F.when(F.col("doc_id") % 10 == 3, F.substring_index("line", " ", 4)).otherwise(F.col("line"))
    text = F.when(F.col("doc_id") % 6 == 0, F.concat(cut, F.lit("\n \n"))).otherwise(cut)
    path = shared_path(spark, "protocol")
    rows = v.select(F.substring_index("line", " ", 1).alias("source"), "doc_id", text.alias("value"))
    rows = rows.repartition("source").sortWithinPartitions("source", "doc_id").drop("doc_id")
    rows.write.partitionBy("source").text(path)
    lines = proto.with_line_number(proto.read_protocol(spark, path))
    short = proto.short_lines(lines, fv.KEYS_8_FIELDS)
    source = F.regexp_extract("file", "source=([^/]+)/", 1)
    return short.select(source.alias("source"), F.col("line_no").cast("long").alias("line_no"), "n_fields")


SQL_RE = "'.*/'"


@query("dq_missing_audio", """select case when word='eval' then 'test' else word end split,
 'O' || cast(o_orderkey as string) utt_id from v_protocol
where o_orderkey%13=0 or o_orderkey%11=0""", ["v_protocol"])
def q_missing_audio(spark, sf_dir):
    rows, files = protocol_rows(spark, sf_dir), flac_listing(spark, sf_dir)
    missing = A.missing_audio(rows, files.withColumn("utt_id", F.col("stem")), ["split", "utt_id"])
    return missing.select("split", "utt_id")


@query("dq_unlabelled_audio", """select path from v_listing
 where lower(path) similar to '.*\\.(flac|wav|mp3|m4a|ogg)'
 and regexp_extract(path, '([^/]+)\\.[^.]+$', 1) not in (select split_part(line, ' ', 2) from v_keys)""",
       ["v_listing", "v_keys"])
def q_unlabelled_audio(spark, sf_dir):
    from detlake.sources.listing import describe_listing

    files = describe_listing(view(spark, sf_dir, "v_listing")).withColumn("utt_id", F.col("stem"))
    return A.unlabelled_audio(files, key_rows(spark, sf_dir), ["utt_id"]).select("path")


@query("dq_protocol_file_unique", """with f as (select word, count(distinct o_orderkey % 4) n from v_protocol
 where word='train' and o_orderkey%4=1 or word='dev' or word='eval' and o_orderkey<0 group by word)
select w split_word, cast(coalesce(n, 0) as bigint) n_files from (values ('train'), ('dev'), ('eval')) v(w)
left join f on word=w where coalesce(n, 0)<>1""", ["v_protocol"])
def q_protocol_file_unique(spark, sf_dir):
    """One file per word and order group: one for train, several for dev, none for eval."""
    from detlake.session import shared_path

    root = shared_path(spark, "protocols")
    group = F.concat(F.lit("g"), F.col("o_orderkey") % 4)
    v = view(spark, sf_dir, "v_protocol").withColumn("grp", group)
    kept = v.filter("word = 'train' and o_orderkey % 4 = 1 or word = 'dev' or word = 'eval' and o_orderkey < 0")
    kept.select("word", "grp", "line").repartition("word", "grp").write.partitionBy("word", "grp").text(root)
    lines = proto.read_protocol(spark, root)
    part = lambda name: F.regexp_extract("file", rf"{name}=(\w+)/", 1)
    return A.protocol_file_problems(lines.withColumn("file", F.concat_ws(".", part("word"), part("grp"))))


@query("spec_preflight", """with w as (select distinct source name from documents)
select name, name || '-1' feature_id, cast(60 as integer) channels,
 case ascii(substr(name,-1,1))%5 when 0 then 'features not built' when 1 then 'built width differs'
  when 2 then 'model trained on other features' when 3 then 'model expects another width' end problem from w""")
def q_spec_preflight(spark, sf_dir):
    """One wanted set per document source; what is wrong follows from its name."""
    from detlake.catalog.views import table

    kind = F.ascii(F.substring("name", -1, 1)) % 5
    names = table(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct()
    wanted = names.select("name", F.concat("name", F.lit("-1")).alias("feature_id"), F.lit(60).alias("channels"))
    specs = wanted.filter(kind != 0).select("feature_id", F.when(kind == 1, 80).otherwise(60).alias("channels"))
    models = wanted.select(
        "name", F.when(kind == 2, "other-0").when(kind == 4, None).otherwise(F.col("feature_id")).alias("feature_id"),
        F.when(kind == 3, 80).when(kind == 4, None).otherwise(60).alias("in_channels"))
    return Q.spec_preflight(wanted, specs, models)


SQL_COVER = """select (select count(*) from v_manifest) n_requested,
 (select count(*) from v_scores where score >= 100) n_scored"""


@query("coverage_stats", f"select *, round_even(cast(n_scored as double)/n_requested, 6) ratio from ({SQL_COVER})",
       ["v_manifest", "v_scores"])
def q_coverage_stats(spark, sf_dir):
    scored = view(spark, sf_dir, "v_scores").filter("score >= 100")
    return resume.coverage_stats(view(spark, sf_dir, "v_manifest"), scored)


@query("coverage_gate", f"""select *, round_even(cast(n_scored as double)/n_requested, 6) ratio,
 cast(n_scored as double)/n_requested >= 0.99 passed from ({SQL_COVER})""", ["v_manifest", "v_scores"])
def q_coverage_gate(spark, sf_dir):
    return resume.coverage_gate(q_coverage_stats(spark, sf_dir), fv.DEFAULT_MIN_COVERAGE)
