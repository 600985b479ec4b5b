"""Queries over texts: tokens, views, labels, dates, header fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import text as T
from docketry.registry import CORE
from docketry.session import table

VIEW_LIMIT = 3000

_PATTERN = dict(T.OUTCOMES)


def _sql_mask(column: str, patterns: list[str]) -> str:
    for p in patterns:
        column = f"regexp_replace({column}, '{p}', ' outcome_phrase ', 'g')"
    return column


_MASKS = ["(?i)" + p for p in _PATTERN.values()]
_STARTS = [p.replace("'", "''") for p in T.BODY_STARTS]
_JUDGMENTS = "(select distinct case_id, text from judgments where case_id is not null and text is not null) j"


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "judgments").select("case_id", "text").filter("case_id is not null and text is not null").distinct()


@CORE.add("tokenize_terms", "TXT-01", "AGG-24", sql="""
select doc_id, len(t) n_terms, len(list_distinct(t)) n_distinct
from (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') t from documents where text is not null)""")  # fmt: skip
def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", T.terms(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@CORE.add("classifier_words", "TXT-02", sql="""
select word, count(*) n from (select unnest(regexp_extract_all(lower(view_text), '[a-z][a-z-]{2,}')) word from examples where view_text is not null) group by 1""")  # fmt: skip
def classifier_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "examples").select(F.explode(T.words(F.col("view_text"))).alias("word"))
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@CORE.add("whitespace_normalise", "TXT-03", sql=r"""
select case_id, md5(trim(regexp_replace(text, '[ \t\r\n\f\x0B]+', ' ', 'g'))) digest from """ + _JUDGMENTS)  # fmt: skip
def whitespace_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments(spark, sf_dir).select("case_id", F.md5(T.one_space(F.col("text"))).alias("digest"))


@CORE.add("section_keys", "TXT-04", sql="""
select distinct act_id, section, coalesce(try_cast(case when regexp_matches(section, '^[0-9]+[A-Z]{0,2}$') then regexp_extract(section, '^([0-9]+)', 1) end as int), 1000000000) number,
  case when regexp_matches(section, '^[0-9]+[A-Z]{0,2}$') then regexp_extract(section, '^[0-9]+([A-Z]*)$', 1) else section end suffix
from provisions where section is not null""")  # fmt: skip
def section_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "provisions").filter("section is not null").select("act_id", "section").distinct()
    return rows.withColumn("k", T.section_key(F.col("section"))).select("act_id", "section", "k.number", "k.suffix")


_MONTHS = T._MONTHS


@CORE.add("decision_dates", "TXT-05", sql=rf"""
with h as (select case_id, text[1:4000] h from {_JUDGMENTS}),
m as (select case_id, regexp_extract(h, '(?i)\b({_MONTHS})\s+(\d{{1,2}}),?\s+(\d{{4}})\b', ['m', 'd', 'y']) a, regexp_extract(h, '(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({_MONTHS}),?\s+(\d{{4}})\b', ['d', 'm', 'y']) b from h),
r as (select case_id, coalesce(try_strptime(a.m || ' ' || a.d || ' ' || a.y, '%B %d %Y'), try_strptime(b.m || ' ' || b.d || ' ' || b.y, '%B %d %Y'))::date header_date from m)
select case_id, header_date from r""")  # fmt: skip
def decision_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments(spark, sf_dir).select("case_id", T.decision_date(F.col("text")).alias("header_date"))


@CORE.add("input_view", "TXT-07", sql=f"select case_id, md5({_sql_mask(f'text[1:{VIEW_LIMIT}]', _MASKS)}) view_digest from {_JUDGMENTS}")
def input_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments(spark, sf_dir).select("case_id", F.md5(T.input_view(F.col("text"), VIEW_LIMIT)).alias("view_digest"))


def _sql_start(i: int) -> str:
    return f"case when regexp_matches(text, '{_STARTS[i]}') then length(regexp_extract(text, '{_lead(_STARTS[i])}', 1)) end"


def _lead(p: str) -> str:
    flags = "(?ism)" if "(?m)" in p else "(?is)"
    body = p.replace("(?i)", "").replace("(?m)", "")
    return ("(?sm)" if "(?m)" in p else flags) + "\\A(.*?)" + ("(?:" + body + ")")


_START_SQL = "coalesce(" + ", ".join(_sql_start(i) for i in range(3)) + ")"


@CORE.add("body_start", "TXT-08", sql=f"select case_id, {_START_SQL} body_start from {_JUDGMENTS}")
def body_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments(spark, sf_dir).select("case_id", T.body_start(F.col("text")).cast("long").alias("body_start"))


_BODY_SQL = f"""
with s as (select case_id, text, {_START_SQL} st from {_JUDGMENTS}),
w as (select case_id, text, st, least(st + {VIEW_LIMIT}, floor(length(text) * 0.7::double)::int) en from s)
select case_id, md5({_sql_mask('text[st + 1:en]', _MASKS + list(T.BODY_MASKS))}) view_digest from w where en - st >= 500"""


@CORE.add("body_view", "TXT-09", "TXT-08", sql=_BODY_SQL)
def body_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judgments(spark, sf_dir).select("case_id", T.body_view(F.col("text"), VIEW_LIMIT).alias("view"))
    return rows.filter("view is not null").select("case_id", F.md5("view").alias("view_digest"))


def _sql_label(column: str) -> str:
    parts = []
    for label, p in _PATTERN.items():
        parts.append(f"case when regexp_matches({column}, '(?i){p}') then {{'start': length(regexp_extract({column}, '(?is)^(.*){p}', 1)), 'end': length(regexp_extract({column}, '(?is)^(.*{p})', 1)), 'label': '{label}'}} end")
    return f"list_max(list_filter([{', '.join(parts)}], lambda x: x is not null)).label"


@CORE.add("disposition_labels", "LAB-01", "LAB-02", sql=f"""
with r as (select case_id, text[floor(length(text) * 0.8::double)::int + 1:] region from {_JUDGMENTS})
select case_id, length(region) region_chars, {_sql_label('region')} label from r""")  # fmt: skip
def disposition_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judgments(spark, sf_dir).withColumn("region", T.label_region(F.col("text")))
    return rows.select("case_id", F.length("region").cast("long").alias("region_chars"), T.disposition(F.col("region")).alias("label"))


_VALUES = [("Appeal(s)  Allowed", "allowed"), ("Case Partly Allowed", "partly_allowed"), (" dismissed ", "dismissed"), ("Disposed off", "disposed"), ("Adjourned", None), (None, None)]


@CORE.add("official_labels", "LAB-03", sql="select * from (values ('Appeal(s)  Allowed', 'allowed'), ('Case Partly Allowed', 'partly_allowed'), (' dismissed ', 'dismissed'), ('Disposed off', 'disposed'), ('Adjourned', null), (null, null)) t(disposal, label)")
def official_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(d,) for d, _ in _VALUES], "disposal string").select("disposal", T.official_label(F.col("disposal")).alias("label"))


@CORE.add("node_feature_texts", "TXT-10", "JOIN-07", sql="""
with p as (select node_id, max(text) text from provisions where node_id is not null group by 1),
n as (select lower(trim(node_id)) k, node_id, label, node_type, row_number() over (partition by lower(trim(node_id)) order by ingested_at desc) rn from nodes)
select n.node_id, md5(case when n.node_type = 'provision' then trim(n.label || '. ' || coalesce(p.text, '')[1:400], E' \\n\\r\\t') else n.label end) feature_digest
from n left join p on p.node_id = n.node_id where rn = 1""")  # fmt: skip
def node_feature_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label, and for provisions the first 400 characters of their text; no other text reaches a feature."""
    from docketry.operators.asof import latest_delivery

    texts = table(spark, sf_dir, "provisions").filter("node_id is not null").groupBy("node_id").agg(F.max("text").alias("text"))
    nodes = latest_delivery(table(spark, sf_dir, "nodes").select("node_id", "label", "node_type", "ingested_at", F.lower(F.trim("node_id")).alias("k")).filter("node_id is not null"), "k", "ingested_at")
    feature = F.when(F.col("node_type") == "provision", F.trim(F.concat(F.col("label"), F.lit(". "), F.substring(F.coalesce("text", F.lit("")), 1, 400)), F.lit(" \n\r\t"))).otherwise(F.col("label"))
    return nodes.join(texts, "node_id", "left").select("node_id", F.md5(feature).alias("feature_digest"))


@CORE.add("outcome_words", "TXT-15", sql="""
select split, avg((regexp_matches(lower(view_text), 'allow'))::int::double) allow_share, avg((regexp_matches(lower(view_text), 'dismiss'))::int::double) dismiss_share,
       sum(length(regexp_replace(lower(view_text), '[a-z]*(?:allow|dismiss|dispos)[a-z]*', '', 'g')))::bigint chars_left
from (select lower(trim(split)) split, view_text from examples where view_text is not null) group by 1""")  # fmt: skip
def outcome_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residual outcome words in the views, and the characters left when they are stripped."""
    rows = table(spark, sf_dir, "examples").filter("view_text is not null").select(F.lower(F.trim("split")).alias("split"), F.lower("view_text").alias("v"))
    return rows.groupBy("split").agg(
        F.avg(F.col("v").rlike("allow").cast("int")).alias("allow_share"), F.avg(F.col("v").rlike("dismiss").cast("int")).alias("dismiss_share"),
        F.sum(F.length(F.regexp_replace("v", "[a-z]*(?:allow|dismiss|dispos)[a-z]*", ""))).alias("chars_left"),
    )


@CORE.add("header_metadata", "TXT-14", "AGG-23", sql=r"""
with b as (select distinct case_id, lower(attributes['lead_party']) p, lower(attributes['matter_no']) m, attributes['bench_size'] bench, decision_date from judgments where case_id is not null),
f as (select case_id,
  case when p is null or trim(p) in ('', '-') then 'unknown' when regexp_matches(p, '\b(state|union|government|govt) of\b') then 'government' when regexp_matches(p, '\b(ltd|limited|pvt|private)\b') then 'company' when regexp_matches(p, '\b(bank|board|corporation|authority|university)\b') then 'institution' else 'person' end party_type,
  case when regexp_matches(m, '^\s*(civil appeal|c\.a\.)') then 'civil_appeal' when regexp_matches(m, '^\s*(criminal appeal|crl\.a\.)') then 'criminal_appeal' when regexp_matches(m, '^\s*(writ petition|w\.p\.)') then 'writ_petition' else 'other' end case_type,
  year(decision_date) - try_cast(nullif(regexp_extract(m, '([0-9]{4})\s*$', 1), '') as int) age, regexp_extract(coalesce(bench, ''), '([0-9]+)', 1) bench from b)
select party_type, case_type, case when age is null or age < 0 then 'na' when age <= 4 then age::varchar when age <= 7 then '5_7' else '8plus' end age_bucket, bench, count(distinct case_id) cases
from f group by all""")  # fmt: skip
def header_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header fields as tokens, counted: kind of party, kind of matter, age of the matter, size of the bench."""
    rows = table(spark, sf_dir, "judgments").filter("case_id is not null").select("case_id", F.lower(F.col("attributes")["lead_party"]).alias("p"), F.lower(F.col("attributes")["matter_no"]).alias("m"), F.col("attributes")["bench_size"].alias("b"), "decision_date").distinct()
    p, m = F.col("p"), F.col("m")
    party = (
        F.when(p.isNull() | F.trim(p).isin("", "-"), "unknown").when(p.rlike(r"\b(state|union|government|govt) of\b"), "government").when(p.rlike(r"\b(ltd|limited|pvt|private)\b"), "company")
        .when(p.rlike(r"\b(bank|board|corporation|authority|university)\b"), "institution").otherwise("person")
    )
    kind = F.when(m.rlike(r"^\s*(civil appeal|c\.a\.)"), "civil_appeal").when(m.rlike(r"^\s*(criminal appeal|crl\.a\.)"), "criminal_appeal").when(m.rlike(r"^\s*(writ petition|w\.p\.)"), "writ_petition").otherwise("other")
    filed = F.nullif(F.regexp_extract(m, r"([0-9]{4})\s*$", 1), F.lit("")).cast("int")
    age = F.year("decision_date") - filed
    bucket = F.when(age.isNull() | (age < 0), "na").when(age <= 4, age.cast("string")).when(age <= 7, "5_7").otherwise("8plus")
    rows = rows.select("case_id", party.alias("party_type"), kind.alias("case_type"), bucket.alias("age_bucket"), F.regexp_extract(F.coalesce("b", F.lit("")), "([0-9]+)", 1).alias("bench"))
    return rows.groupBy("party_type", "case_type", "age_bucket", "bench").agg(F.countDistinct("case_id").alias("cases"))


@CORE.add("experiment_keys", "TXT-16", sql=r"""
select distinct experiment_id, array_to_string(string_split(experiment_id, '-')[1:2], '-') || coalesce('-' || nullif(regexp_extract(experiment_id, '-(s[0-9]+)-v[0-9]+$', 1), ''), '') control_key from configs""")  # fmt: skip
def experiment_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family and seed of an experiment: the key of its control."""
    seed = F.nullif(F.regexp_extract("experiment_id", r"-(s[0-9]+)-v[0-9]+$", 1), F.lit(""))
    key = F.concat(F.substring_index("experiment_id", "-", 2), F.coalesce(F.concat(F.lit("-"), seed), F.lit("")))
    return table(spark, sf_dir, "configs").select("experiment_id", key.alias("control_key")).distinct()


@CORE.add("path_keys", "TXT-17", sql="select * from (values ('2013-1-1-9-en', '2013_1_1_9'), ('2015-2-5-9', '2015_2_5_9')) t(stem, path_key)")
def path_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("2013-1-1-9-en",), ("2015-2-5-9",)], "stem string")
    return rows.select("stem", F.replace(F.regexp_replace("stem", "-en$", ""), F.lit("-"), F.lit("_")).alias("path_key"))


@CORE.add("token_blocks", "TXT-20", sql="""
with t as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') t from documents where text is not null),
b as (select doc_id, t, unnest(range(0, len(t), 256)) s from t)
select doc_id, s::bigint block_start, len(t[s + 1:s + 256]) n_tokens, md5(array_to_string(t[s + 1:s + 256], ' ')) digest from b where len(t[s + 1:s + 256]) >= 16""")  # fmt: skip
def token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 256 tokens in a row; shorter ends are kept from 16 tokens on."""
    t = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", T.terms(F.col("text")).alias("t")).filter(F.size("t") > 0)
    b = t.select("doc_id", "t", F.explode(F.sequence(F.lit(0), F.size("t") - 1, F.lit(256))).alias("s"))
    part = F.slice("t", F.col("s") + 1, 256)
    return b.filter(F.size(part) >= 16).select("doc_id", F.col("s").cast("long").alias("block_start"), F.size(part).cast("long").alias("n_tokens"), F.md5(F.array_join(part, " ")).alias("digest"))
