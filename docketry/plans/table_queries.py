"""Queries of selection, joins, aggregates, windows, sets and samples over the project's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions import text as T
from docketry.operators import statutes
from docketry.plans.model_queries import _EX, examples
from docketry.plans.text_queries import _sql_label
from docketry.registry import CORE
from docketry.session import materialise, table



# ---- selection

_RECORDS = f"""
rec as (select j.case_id path, j.text, j.decision_date, j.ingested_at, j.attributes, row_number() over (partition by lower(j.case_id) order by j.ingested_at, j.title) ord from judgments j where j.case_id is not null),
lab as (select case_id, max(label) official from examples group by 1),
ext as (select distinct lower(case_id) k from judgments where lower(trim(origin_split)) = 'external'),
why as (select rec.path, year(decision_date) yr, case when ord > 1 then 'duplicate_report' when lower(path) in (select k from ext) then 'already_external' when decision_date is null then 'no_decision_date'
  when year(decision_date) not between 1995 and 2019 then 'other_year' when text is null or trim(text) = '' then 'no_text' when official is null then 'no_four_way_disposal'
  when {_sql_label('text[floor(length(text) * 0.8::double)::int + 1:]')} is null then 'no_disposition_phrase_in_text'
  when {_sql_label('text[floor(length(text) * 0.8::double)::int + 1:]')} <> official then 'text_disagrees_with_official_label' end reason
  from rec left join lab on lab.case_id = rec.path)
"""


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, yr, reason`` of every judgment row: the first rule that leaves it out, NULL where it is kept.

    A repeated report is one whatever became of the first.
    """
    rows = table(spark, sf_dir, "judgments").filter("case_id is not null")
    order = Window.partitionBy(F.lower("case_id")).orderBy("ingested_at", "title")
    rows = rows.withColumn("ord", F.row_number().over(order))
    official = table(spark, sf_dir, "examples").groupBy("case_id").agg(F.max("label").alias("official"))
    external = rows.filter(F.lower(F.trim("origin_split")) == "external").select(F.lower("case_id").alias("k"), F.lit(True).alias("external")).distinct()
    rows = rows.join(official, "case_id", "left").join(external, F.lower("case_id") == F.col("k"), "left")
    inferred = T.disposition(T.label_region(F.col("text")))
    year = F.year("decision_date")
    reason = (
        F.when(F.col("ord") > 1, "duplicate_report").when(F.col("external"), "already_external").when(F.col("decision_date").isNull(), "no_decision_date").when(~year.between(1995, 2019), "other_year")
        .when(F.col("text").isNull() | (F.trim("text") == ""), "no_text").when(F.col("official").isNull(), "no_four_way_disposal").when(inferred.isNull(), "no_disposition_phrase_in_text").when(inferred != F.col("official"), "text_disagrees_with_official_label")
    )
    return rows.select(F.col("case_id").alias("path"), year.alias("yr"), reason.alias("reason"))


@CORE.add("selection_cascade", "FLT-05", "JOIN-06", "FLT-08", "LAB-03", sql=f"with {_RECORDS} select coalesce(reason, 'kept') reason, count(*) n from why group by 1")
def selection_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@CORE.add("selection_funnel", "FLT-06", sql=f"""with {_RECORDS}
select coalesce(yr::varchar, case when grouping(yr) = 1 then 'all' else 'undated' end) yr, count(*) extracted, count(*) filter (reason is null) retained, round(100.0::double * count(*) filter (reason is null) / count(*), 6) percent from why group by rollup (yr)""")  # fmt: skip
def selection_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection(spark, sf_dir).rollup("yr").agg(F.count(F.lit(1)).alias("extracted"), F.count_if(F.col("reason").isNull()).alias("retained"), F.grouping("yr").alias("g"))
    name = F.when(F.col("g") == 1, "all").otherwise(F.coalesce(F.col("yr").cast("string"), F.lit("undated")))
    return rows.select(name.alias("yr"), "extracted", "retained", F.round(100.0 * F.col("retained") / F.col("extracted"), 6).alias("percent"))


@CORE.add("run_exclusions", "FLT-07", sql="select * from (values ('diag-x', 'diagnostic'), ('run-a', 'excluded'), ('run-b', 'other_view'), ('run-c', 'diverged'), ('run-d', null)) t(run_id, reason)")
def run_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nan = float("nan")
    runs = spark.createDataFrame([("diag-x", "body", [1.0]), ("run-a", "body", [1.0]), ("run-b", "prefix", [nan]), ("run-c", "body", [0.5, nan]), ("run-d", "body", [0.4])], "run_id string, view string, losses array<double>")
    diverged = F.exists("losses", lambda x: F.isnan(x))
    return runs.select("run_id", F.when(F.col("run_id").startswith("diag-"), "diagnostic").when(F.col("run_id").isin("run-a"), "excluded").when(F.col("view") != "body", "other_view").when(diverged, "diverged").alias("reason"))


@CORE.add("split_counts", "AGG-04", "SNK-08", "JOIN-03", sql="with " + _EX + "z as (select 1) select split, coalesce(label, '_unlabelled') label, split || ':' || coalesce(label, '_unlabelled') split_label, count(*) n from ex group by all")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.coalesce("label", F.lit("_unlabelled"))
    return examples(spark, sf_dir).groupBy("split", label.alias("label")).agg(F.count(F.lit(1)).alias("n")).select("split", "label", F.concat_ws(":", "split", "label").alias("split_label"), "n")


@CORE.add("label_supports", "AGG-06", "FLT-04", sql="with " + _EX + "z as (select 1) select split, " + ", ".join(f"count(*) filter (label = '{x}') {x}" for x in T.LABELS) + ", count(*) filter (label is null) unlabelled from ex group by 1")
def label_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = examples(spark, sf_dir).withColumn("label", F.coalesce("label", F.lit("unlabelled")))
    return rows.groupBy("split").pivot("label", [*T.LABELS, "unlabelled"]).count().na.fill(0)


@CORE.add("hashed_splits", "SRC-04", "SRT-03", sql="""
with r as (select case_id, max(raw_sha256) raw from judgments where case_id is not null and raw_sha256 is not null group by 1), b as (select case_id, ('0x' || raw[1:8])::bigint % 10 b from r)
select case_id, case when b < 8 then 'train' when b = 8 then 'validation' else 'test' end split from b""")  # fmt: skip
def hashed_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "judgments").filter("case_id is not null and raw_sha256 is not null").groupBy("case_id").agg(F.max("raw_sha256").alias("raw"))
    return rows.select("case_id", T.bucket_split(F.col("raw")).alias("split"))


# ---- references and provisions

@CORE.add("references_per_case", "AGG-15", sql="""
with j as (select distinct document_id from judgments where document_id is not null), c as (select document_id, count(distinct extraction_id) k from candidates group by 1)
select coalesce(k, 0) n_references, count(*) cases from j left join c using (document_id) group by 1""")  # fmt: skip
def references_per_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "judgments").filter("document_id is not null").select("document_id").distinct()
    c = table(spark, sf_dir, "candidates").groupBy("document_id").agg(F.countDistinct("extraction_id").alias("k"))
    return j.join(c, "document_id", "left").groupBy(F.coalesce("k", F.lit(0)).alias("n_references")).agg(F.count(F.lit(1)).alias("cases"))


@CORE.add("unresolved_by_kind", "AGG-17", "SNK-07", sql="""
with c as (select distinct extraction_id, kind, document_id from candidates), r as (select extraction_id, max(resolved_target_id) target, max(unresolved_reason) reason from resolutions group by 1),
u as (select c.kind, c.document_id, coalesce(r.reason, 'no_reason') reason from c left join r using (extraction_id) where r.target is null),
d as (select kind, document_id, count(*) k from u group by all)
select kind, (select count(*) from u where u.kind = d.kind) unresolved, count(*) documents, median(k)::double median_per_document from d group by 1""")  # fmt: skip
def unresolved_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "candidates").select("extraction_id", "kind", "document_id").distinct()
    r = table(spark, sf_dir, "resolutions").groupBy("extraction_id").agg(F.max("resolved_target_id").alias("target"))
    d = c.join(r, "extraction_id", "left").filter("target is null").groupBy("kind", "document_id").agg(F.count(F.lit(1)).alias("k"))
    return d.groupBy("kind").agg(F.sum("k").alias("unresolved"), F.count(F.lit(1)).alias("documents"), F.median("k").alias("median_per_document"))


@CORE.add("provisions_per_act", "AGG-18", sql="""
with p as (select node_id, max(act_id) act_id, max(text) text from provisions where node_id is not null group by 1)
select act_id, count(*) provisions, median(length(text))::double median_chars, round(avg(length(text)), 6) mean_chars, count(*) filter (text is null) without_text from p group by 1""")  # fmt: skip
def provisions_per_act(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "provisions").filter("node_id is not null").groupBy("node_id").agg(F.max("act_id").alias("act_id"), F.max("text").alias("text"))
    return p.groupBy("act_id").agg(F.count(F.lit(1)).alias("provisions"), F.median(F.length("text")).alias("median_chars"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"), F.count_if(F.col("text").isNull()).alias("without_text"))


_SECTIONS = """
p as (select node_id, max(act_id) act_id, max(section) section, max(source_page_start) p0, max(source_page_end) p1, max(text) text from provisions where node_id is not null group by 1),
k as (select *, case when regexp_matches(section, '^[0-9]+[A-Z]{0,2}$') then regexp_extract(section, '^([0-9]+)', 1)::int end num, case when regexp_matches(section, '^[0-9]+[A-Z]{0,2}$') then regexp_extract(section, '^[0-9]+([A-Z]*)$', 1) else section end suffix from p where section is not null)
"""


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provision candidates of an act in order of their pages (then of their id)."""
    p = table(spark, sf_dir, "provisions").filter("node_id is not null").groupBy("node_id").agg(F.max("act_id").alias("act_id"), F.max("section").alias("section"), F.max("source_page_start").alias("p0"), F.max("source_page_end").alias("p1"), F.max("text").alias("text"))
    return p.filter("section is not null").withColumn("k", T.section_key(F.col("section"))).withColumn("num", T.section_number(F.col("section")))


@CORE.add("monotone_sections", "EXT-05", "WIN-01", sql="with " + _SECTIONS + """
, m as (select *, max({'a': coalesce(num, 1000000000), 'b': suffix}) over (partition by act_id order by p0, node_id rows between unbounded preceding and 1 preceding) before from k)
select act_id, node_id, section, before is null or {'a': coalesce(num, 1000000000), 'b': suffix} > before kept from m""")  # fmt: skip
def monotone_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heading is kept if its section comes after every one before it; the others are reported. An act is one window."""
    w = Window.partitionBy("act_id").orderBy("p0", "node_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = headings(spark, sf_dir).withColumn("before", F.max("k").over(w))
    return rows.select("act_id", "node_id", "section", (F.col("before").isNull() | (F.col("k") > F.col("before"))).alias("kept"))


@CORE.add("audit_findings", "EXT-06", "EXT-07", "WIN-02", sql="with " + _SECTIONS + r"""
, l as (select *, lag(num ignore nulls) over (partition by act_id order by p0, node_id) prev from k),
f as (select act_id, section, p0, p1, 'section_number_reset' category, 'drops from ' || prev || ' to ' || section message from l where num < prev
  union all select act_id, section, p0, p1, 'structural_heading', 'a heading of a schedule, appendix or amendment' from k where regexp_matches(regexp_replace(text[1:350], '^\s*\d+[A-Z]?\.\s*', ''), '""" + statutes.OTHER_MATERIAL + r"""')
  union all select act_id, section, last(p0 order by p0, node_id), last(p1 order by p0, node_id), 'duplicate_section', count(*) || ' times on pages ' || string_agg(p0 || '-' || p1, ', ' order by p0, node_id) from k group by 1, 2 having count(*) > 1)
select act_id, category, section, p0 page_start, p1 page_end, message from f""")  # fmt: skip
def audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops in section numbers, headings of other material, sections found more than once."""
    rows = materialise(headings(spark, sf_dir))
    w = Window.partitionBy("act_id").orderBy("p0", "node_id")
    drops = rows.withColumn("prev", F.last("num", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).filter("num < prev")
    row = lambda df, category, message: df.select("act_id", F.lit(category).alias("category"), "section", F.col("p0").alias("page_start"), F.col("p1").alias("page_end"), message.alias("message"))
    structural = rows.filter(F.regexp_replace(F.substring("text", 1, 350), r"^\s*\d+[A-Z]?\.\s*", "").rlike(statutes.OTHER_MATERIAL))
    seen = F.array_sort(F.collect_list(F.struct("p0", "node_id", "p1")))
    twice = rows.groupBy("act_id", "section").agg(seen.alias("seen")).filter(F.size("seen") > 1)
    pages = F.array_join(F.transform("seen", lambda x: F.concat_ws("-", x["p0"].cast("string"), x["p1"].cast("string"))), ", ")
    twice = twice.withColumn("p0", F.element_at("seen", -1)["p0"]).withColumn("p1", F.element_at("seen", -1)["p1"])
    parts = [
        row(drops, "section_number_reset", F.concat(F.lit("drops from "), F.col("prev").cast("string"), F.lit(" to "), F.col("section"))),
        row(structural, "structural_heading", F.lit("a heading of a schedule, appendix or amendment")),
        row(twice, "duplicate_section", F.concat(F.size("seen").cast("string"), F.lit(" times on pages "), pages)),
    ]
    return reduce(DataFrame.unionByName, parts)


@CORE.add("citation_matrix_join", "JOIN-16", "RET-11", sql="""
with e as (select distinct lower(trim(source_id)) c, lower(trim(target_id)) p from edges where relation_type = 'refers_to_provision' and target_id is not null),
y as (select lower(trim(case_id)) c, max("year") yr from examples where "year" is not null group by 1), v as (select e.*, yr from e join y using (c)),
h as (select p, yr, count(*) k from v group by 1, 2), b as (select p, yr, sum(k) over (partition by p order by yr rows between unbounded preceding and 1 preceding) earlier from h)
select v.c case_id, count(*) provisions, coalesce(sum(earlier), 0)::bigint earlier_citations from v join b using (p, yr) group by 1""")  # fmt: skip
def citation_matrix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every case, how often strictly earlier years cite its provisions: counts per provision and year, then a running sum, not pairs of cases."""
    e = table(spark, sf_dir, "edges").filter("relation_type = 'refers_to_provision' and target_id is not null").select(F.lower(F.trim("source_id")).alias("c"), F.lower(F.trim("target_id")).alias("p")).distinct()
    y = table(spark, sf_dir, "examples").filter("year is not null").groupBy(F.lower(F.trim("case_id")).alias("c")).agg(F.max("year").alias("yr"))
    v = materialise(e.join(y, "c"))
    w = Window.partitionBy("p").orderBy("yr").rowsBetween(Window.unboundedPreceding, -1)  # a row per year
    b = v.groupBy("p", "yr").agg(F.count(F.lit(1)).alias("k")).withColumn("earlier", F.sum("k").over(w))
    return v.join(b, ["p", "yr"]).groupBy(F.col("c").alias("case_id")).agg(F.count(F.lit(1)).alias("provisions"), F.coalesce(F.sum("earlier"), F.lit(0)).alias("earlier_citations"))


@CORE.add("page_of_offset", "JOIN-17", "EXT-04", sql="""
with d as (select doc_id, length(text) n from documents where text is not null and text <> ''), o as (select doc_id, unnest([0, n // 2, n - 1]) off from d)
select distinct doc_id, off::bigint off, (off // 1000 + 1)::bigint page from o""")  # fmt: skip
def page_of_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets to pages of 1,000 characters: the last page that begins at or before the offset."""
    d = table(spark, sf_dir, "documents").filter("text is not null and text <> ''").select("doc_id", F.length("text").cast("long").alias("n"))
    o = d.select("doc_id", F.explode(F.array(F.lit(0).cast("long"), F.floor(F.col("n") / 2), F.col("n") - 1)).alias("off"), F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(1000).cast("long")).alias("starts"))
    return o.select("doc_id", "off", F.size(F.filter("starts", lambda s: s <= F.col("off"))).cast("long").alias("page")).distinct()


# ---- aggregates

@CORE.add("top_parties", "AGG-14", "SRT-02", sql="""
with p as (select case_id, trim(unnest(string_split(title, ' v. '))) party from (select distinct case_id, title from judgments where title is not null))
select party, count(*) n from p where party <> '' group by 1 order by n desc, party limit 15""")  # fmt: skip
def top_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen parties named most often in titles."""
    rows = table(spark, sf_dir, "judgments").filter("title is not null").select("case_id", "title").distinct()
    p = rows.select(F.explode(F.split("title", r" v\. ")).alias("party")).select(F.trim("party").alias("party")).filter("party <> ''")
    return p.groupBy("party").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "party").limit(15)


@CORE.add("monthly_labels", "AGG-16", sql="with " + _EX + "z as (select 1) select coalesce(strftime(decision_date, '%Y-%m'), 'undated') m, coalesce(label, 'none') label, count(*) n, quantile_cont(length(view_text), 0.5)::double median_chars, max(floor(log2(length(view_text))))::int top_bin from ex where view_text is not null and view_text <> '' group by all")
def monthly_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = examples(spark, sf_dir).filter("view_text is not null and view_text <> ''")
    month = F.coalesce(F.date_format("decision_date", "yyyy-MM"), F.lit("undated"))
    return rows.groupBy(month.alias("m"), F.coalesce("label", F.lit("none")).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.percentile(F.length("view_text"), 0.5).alias("median_chars"), F.max(F.floor(F.log2(F.length("view_text")))).cast("int").alias("top_bin"))


@CORE.add("year_label_margins", "AGG-19", sql="with " + _EX + "z as (select 1) select case when grouping(yr) = 1 then 'all' else coalesce(yr::varchar, 'undated') end yr, case when grouping(label) = 1 then 'all' else coalesce(label, 'none') end label, count(*) n from ex group by cube (yr, label)")
def year_label_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = examples(spark, sf_dir).cube("yr", "label").agg(F.count(F.lit(1)).alias("n"), F.grouping("yr").alias("gy"), F.grouping("label").alias("gl"))
    return rows.select(F.when(F.col("gy") == 1, "all").otherwise(F.coalesce(F.col("yr").cast("string"), F.lit("undated"))).alias("yr"), F.when(F.col("gl") == 1, "all").otherwise(F.coalesce("label", F.lit("none"))).alias("label"), "n")


@CORE.add("latency_summary", "AGG-21", sql="""
with o as (select event_type, value, row_number() over (partition by event_type order by value) - 1 r, count(*) over (partition by event_type) n from events where value is not null)
select event_type, round(avg(value), 6) mean_value, median(value) median_value, max(value) filter (r = floor(0.95::double * (n - 1))) p95, max(value) max_value from o group by 1""")  # fmt: skip
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median, the value at index 0.95 (n - 1) and the largest, per event type: two exact percentiles, no list of values."""
    rows = table(spark, sf_dir, "events").filter("value is not null")
    sizes = rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    counts = rows.groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("k")).join(sizes, "event_type")
    reach = F.sum("k").over(Window.partitionBy("event_type").orderBy("value"))
    p95 = counts.withColumn("reach", reach).filter(F.col("reach") > F.floor(0.95 * (F.col("n") - 1))).groupBy("event_type").agg(F.min("value").alias("p95"))
    out = rows.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.median("value").alias("median_value"), F.max("value").alias("max_value"))
    return out.join(p95, "event_type")


@CORE.add("yearly_extraction", "AGG-22", "SRC-09", sql="""
with j as (select case_id, max(decision_date) d, max(text) t from judgments where case_id is not null group by 1)
select coalesce(year(d)::varchar, 'undated') yr, count(*) judgments, median(length(t))::double median_chars, count(*) filter (t is null or trim(t) = '') without_text from j group by 1""")  # fmt: skip
def yearly_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "judgments").filter("case_id is not null").groupBy("case_id").agg(F.max("decision_date").alias("d"), F.max("text").alias("t"))
    return j.groupBy(F.coalesce(F.year("d").cast("string"), F.lit("undated")).alias("yr")).agg(F.count(F.lit(1)).alias("judgments"), F.median(F.length("t")).alias("median_chars"), F.count_if(F.col("t").isNull() | (F.trim("t") == "")).alias("without_text"))


@CORE.add("seed_statistics", "AGG-20", sql="""
select o_orderpriority family, round(avg(o_totalprice), 6) mean_price, round(coalesce(stddev_samp(o_totalprice), 0), 4) std_price, count(*) n from orders group by 1""")  # fmt: skip
def seed_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and sample deviation (0 of a single value) per group."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("family")).agg(F.round(F.avg("o_totalprice"), 6).alias("mean_price"), F.round(F.coalesce(F.stddev_samp("o_totalprice"), F.lit(0.0)), 4).alias("std_price"), F.count(F.lit(1)).alias("n"))


@CORE.add("majority_share", "AGG-25", "CLS-05", sql="with " + _EX + ", ".join(["c as (select split, label, count(*) n from ex where label is not null group by all)"]) + " select split, max(n) / sum(n)::double majority_prior, sum(n)::double / 4 balanced from c group by 1")
def majority_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = examples(spark, sf_dir).filter("label is not null").groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("split").agg((F.max("n") / F.sum("n")).alias("majority_prior"), (F.sum("n") / 4).alias("balanced"))


# ---- windows

@CORE.add("interval_losses", "WIN-04", "WIN-05", sql="""
with l as (select user_id epoch, event_id ord, (event_id % 40) + 1 step, 1.0 + (event_id % 11) / 10.0 mean from events),
m as (select *, max(step) over (partition by epoch order by ord rows between unbounded preceding and 1 preceding) top from l),
k as (select * from m where top is null or step > top),
g as (select *, lag(step, 1, 0) over (partition by epoch order by ord) s0, lag(mean, 1, 0.0) over (partition by epoch order by ord) m0 from k),
i as (select epoch, ord, step, (mean * step - m0 * s0) / (step - s0) loss from g)
select epoch, step, round(loss, 9) interval_loss, round(avg(loss) over (partition by epoch order by ord rows 3 preceding), 9) trailing_mean from i""")  # fmt: skip
def interval_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses between two prints from running means; repeated steps of a resumed log are skipped; a trailing mean of four."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("epoch"), F.col("event_id").alias("ord"), (F.col("event_id") % 40 + 1).alias("step"), (1.0 + F.col("event_id") % 11 / 10.0).alias("mean"))
    w = Window.partitionBy("epoch").orderBy("ord")
    kept = rows.withColumn("top", F.max("step").over(w.rowsBetween(Window.unboundedPreceding, -1))).filter("top is null or step > top")
    s0, m0 = F.lag("step", 1, 0).over(w), F.lag("mean", 1, 0.0).over(w)
    out = kept.withColumn("loss", (F.col("mean") * F.col("step") - m0 * s0) / (F.col("step") - s0))
    return out.select("epoch", "step", F.round("loss", 9).alias("interval_loss"), F.round(F.avg("loss").over(w.rowsBetween(-3, 0)), 9).alias("trailing_mean"))


@CORE.add("ladder_deltas", "WIN-06", sql="""
with l(ord, variant, acc) as (values (1, 'text', 0.50::double), (2, 'graph', 0.55::double), (3, 'both', 0.58::double))
select variant, lag(acc, 1, 0.468) over (order by ord) from_accuracy, acc to_accuracy, round(acc - lag(acc, 1, 0.468) over (order by ord), 9) delta, round(acc - 0.468, 9) cumulative_delta from l""")  # fmt: skip
def ladder_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step by step from the measured baseline."""
    rows = spark.createDataFrame([(1, "text", 0.50), (2, "graph", 0.55), (3, "both", 0.58)], "ord int, variant string, acc double")
    before = F.lag("acc", 1, 0.468).over(Window.orderBy("ord"))
    return rows.select("variant", before.alias("from_accuracy"), F.col("acc").alias("to_accuracy"), F.round(F.col("acc") - before, 9).alias("delta"), F.round(F.col("acc") - 0.468, 9).alias("cumulative_delta"))


@CORE.add("first_mentions", "WIN-08", sql="""
select document_id, canonical_hint, span_start from candidates where canonical_hint is not null
qualify row_number() over (partition by document_id, canonical_hint order by span_start, extraction_id) = 1""")  # fmt: skip
def first_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first place of every reference in its document: an aggregate, not a sorted window."""
    rows = table(spark, sf_dir, "candidates").filter("canonical_hint is not null")
    return rows.groupBy("document_id", "canonical_hint").agg(F.min(F.struct("span_start", "extraction_id")).alias("m")).select("document_id", "canonical_hint", "m.span_start")


@CORE.add("rolling_windows", "WIN-11", "WIN-12", sql="with " + _EX + """y as (select yr, count(*) n from ex where yr is not null group by 1)
select a.yr, g::int ahead, sum(b.n)::bigint train_cases, round(sum(b.n * pow(0.5, (a.yr - b.yr) / 4.0)), 9) recency_mass from y a, range(1, 4) t(g), y b where b.yr between a.yr - g - 1 and a.yr - g group by 1, 2""")  # fmt: skip
def rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-year training windows one to three years before each year, with weights that halve in four years."""
    y = examples(spark, sf_dir).filter("yr is not null").groupBy("yr").agg(F.count(F.lit(1)).alias("n"))
    asked = y.select(F.col("yr").alias("at"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("ahead")).select("at", "ahead", F.explode(F.array(F.col("at") - F.col("ahead") - 1, F.col("at") - F.col("ahead"))).alias("yr"))
    hit = asked.join(y, "yr")
    return hit.groupBy(F.col("at").alias("yr"), "ahead").agg(F.sum("n").alias("train_cases"), F.round(F.sum(F.col("n") * F.pow(F.lit(0.5), (F.col("at") - F.col("yr")) / 4.0)), 9).alias("recency_mass")).withColumnRenamed("at", "yr")


# ---- samples and sets

@CORE.add("stable_sample", "SRT-03", sql="select doc_id from documents order by sha256('13|' || doc_id), doc_id limit 100")
def stable_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred documents in the order of a seeded hash."""
    return table(spark, sf_dir, "documents").orderBy(F.sha2(F.concat(F.lit("13|"), F.col("doc_id").cast("string")), 256), "doc_id").limit(100).select("doc_id")


@CORE.add("stratified_folds", "SRT-07", sql="with " + _EX + "z as (select 1) select case_id, ((row_number() over (partition by label order by sha256('5|' || case_id), case_id) - 1) % 5)::int fold from ex where label is not null")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds of equal size per label.

    Numbers within a label are running sums over hash prefixes first and within a prefix then, so a label of a third of
    all rows is not sorted by one task.
    """
    rows = examples(spark, sf_dir).filter("label is not null").select("case_id", "label", F.sha2(F.concat(F.lit("5|"), "case_id"), 256).alias("h"))
    rows = materialise(rows.withColumn("part", F.substring("h", 1, 2)))
    parts = rows.groupBy("label", "part").agg(F.count(F.lit(1)).alias("k"))  # 256 a label
    parts = parts.select("label", "part", (F.sum("k").over(Window.partitionBy("label").orderBy("part")) - F.col("k")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("label", "part").orderBy("h", "case_id"))
    return rows.join(parts, ["label", "part"]).select("case_id", F.pmod(F.col("before") + inside - 1, F.lit(5)).cast("int").alias("fold"))


@CORE.add("merged_sources", "SET-01", "SET-05", "SRT-08", sql="""
select case_id from judgments where lower(trim(origin_split)) <> 'external' union select case_id from examples where lower(trim(split)) = 'external'""")  # fmt: skip
def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case ids of two sources, each once."""
    a = table(spark, sf_dir, "judgments").filter(F.lower(F.trim("origin_split")) != "external").select("case_id")
    return a.unionByName(table(spark, sf_dir, "examples").filter(F.lower(F.trim("split")) == "external").select("case_id")).distinct()


@CORE.add("id_set_differences", "SET-02", "SET-03", "SET-04", "SNK-11", "JOIN-18", sql="""
select 'judgments only' side, count(*) n from (select case_id from judgments except select case_id from examples)
union all select 'examples only', count(*) from (select case_id from examples except select case_id from judgments)
union all select 'both', count(*) from (select case_id from judgments intersect select case_id from examples)""")  # fmt: skip
def id_set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of one table, of the other and of both: they agree if the first two are 0."""
    a, b = table(spark, sf_dir, "judgments").select("case_id"), table(spark, sf_dir, "examples").select("case_id")
    count = lambda df, side: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    return count(a.subtract(b), "judgments only").unionByName(count(b.subtract(a), "examples only")).unionByName(count(a.intersect(b), "both"))


# ---- the star schema: what the engine's joins and aggregates do at volume

@CORE.add("pricing_summary", "AGG-22", sql="""
select l_returnflag, l_linestatus, round(sum(l_quantity), 2) sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) sum_disc_price, round(avg(l_discount), 6) avg_disc, count(*) n
from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")  # fmt: skip
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@CORE.add("regional_revenue", "JOIN-02", sql="""
select r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, count(distinct o_orderkey) orders
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""")  # fmt: skip
def regional_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    places = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")
    sums = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))  # before the join
    rows = sums.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(places, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("r_name", "n_name").agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.count(F.lit(1)).alias("orders"))
