"""Queries of reports: forecasts as sequences, feature blocks, choices on an inner split, averaged scores, lines of text, logs, runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions import text as T
from docketry.operators import classify, evaluate
from docketry.plans import model_queries as M
from docketry.registry import CORE
from docketry.session import materialise, shared_folder, table
from docketry.sources import files, sinks

_SEQUENCES = "with matrix as (" + CORE.oracle["projected_confusion"] + "), sq as (select gold, predicted, unnest(range(1, n + 1)) i from matrix where n > 0)"
BASELINE = 0.468


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projected matrix as one row per case."""
    return evaluate.sequences(M.projected_confusion(spark, sf_dir))


@CORE.add("confusion_sequences", "EVA-08", sql=_SEQUENCES + " select gold, predicted, i from sq")
def confusion_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir)


@CORE.add("projection_report", "EVA-14", "EVA-05", "EVA-07", "EVA-08", "EVA-09", "WIN-06", sql=_SEQUENCES + f""",
lab(label) as {M._LABELS_SQL},
pc as (select lab.label, count(*) filter (gold = lab.label) support, count(*) filter (predicted = lab.label) said, count(*) filter (gold = lab.label and predicted = lab.label) hit from sq, lab group by 1),
a as (select count(*) cases, count(*) filter (gold = predicted) hits from sq),
w as (select *, hits / cases::double p, {evaluate.Z * evaluate.Z!r} z2, {evaluate.Z!r} z from a)
select cases, round(p, 9) accuracy, round((select avg(case when said + support > 0 then 2.0 * hit / (said + support) else 0 end) from pc), 9) macro_f1,
  round(greatest(0, ((p + z2 / (2 * cases)) - z * sqrt(p * (1 - p) / cases + z2 / (4.0 * cases * cases))) / (1 + z2 / cases)), 9) "lower", round(least(1, ((p + z2 / (2 * cases)) + z * sqrt(p * (1 - p) / cases + z2 / (4.0 * cases * cases))) / (1 + z2 / cases)), 9) "upper",
  round(p - {BASELINE}, 9) delta, {BASELINE} between greatest(0, ((p + z2 / (2 * cases)) - z * sqrt(p * (1 - p) / cases + z2 / (4.0 * cases * cases))) / (1 + z2 / cases)) and least(1, ((p + z2 / (2 * cases)) + z * sqrt(p * (1 - p) / cases + z2 / (4.0 * cases * cases))) / (1 + z2 / cases)) baseline_inside from w""")  # fmt: skip
def projection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forecast as one row: the assumed matrix as cases, its measures, their interval, and what it is ahead of a measured baseline."""
    rows = materialise(sequences(spark, sf_dir))
    hits = rows.agg(F.count_if(F.col("gold") == F.col("predicted")).alias("hits"), F.count(F.lit(1)).alias("n")).select(evaluate.wilson(F.col("hits").cast("double"), F.col("n").cast("double")).alias("w"))
    one = evaluate.summary(rows).join(hits)  # two single rows
    r = lambda c: F.round(c, 9)
    inside = F.lit(BASELINE).between(F.col("w.lower"), F.col("w.upper"))
    return one.select("cases", r("accuracy").alias("accuracy"), r("macro_f1").alias("macro_f1"), r("w.lower").alias("lower"), r("w.upper").alias("upper"), r(F.col("accuracy") - BASELINE).alias("delta"), inside.alias("baseline_inside"))


# ---- classifiers

_WEIGHTS = {"words": 1.0, "source": 0.5, "year": 0.25}


@CORE.add("block_features", "CLS-07", sql="with " + M._EX + f"""
w as (select case_id, regexp_extract_all(lower(view_text), '[a-z][a-z-]{{2,}}') t from tr),
f as (select distinct case_id, 'words' block, unnest(t) feature from w union all select case_id, 'source', coalesce(source, '') from tr union all select case_id, 'year', yr::varchar from tr where yr is not null),
k as (select block, feature from f group by 1, 2 having count(*) >= 2),
b as (select case_id, block, count(*) n from f join k using (block, feature) group by 1, 2),
v as (select case_id, block, n, case block {" ".join(f"when '{b}' then {w}::double" for b, w in _WEIGHTS.items())} end weight from b)
select case_id, block, n, round(weight / sqrt(n), 9) as value, round(sqrt(sum(weight * weight) over (partition by case_id) - weight * weight), 9) norm_without from v""")  # fmt: skip
def block_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary bags of three kinds of features that two cases have at least, each of length one times its weight; and the stacked norm without each."""
    train = M.training(spark, sf_dir)
    blocks = {"words": F.array_distinct(T.words(F.col("view_text"))), "source": F.array(F.coalesce("source", F.lit(""))), "year": F.when(F.col("yr").isNotNull(), F.array(F.col("yr").cast("string")))}
    rows = classify.stack(classify.bags(train, "case_id", blocks), _WEIGHTS)
    w = Window.partitionBy("case_id")
    each = rows.groupBy("case_id", "block").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("value"))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in _WEIGHTS.items() for x in kv]), F.col("block"))
    return each.select("case_id", "block", "n", F.round("value", 9).alias("value"), F.round(F.sqrt(F.sum(weight * weight).over(w) - weight * weight), 9).alias("norm_without"))


_HALF_LIVES = (1, 2, 4, 8)


@CORE.add("grid_choice", "CLS-08", sql="with " + M._EX + f"""
t as (select * from tr where yr is not null), top as (select max(yr) y from t),
g(half_life) as (values {", ".join(f"({h})" for h in _HALF_LIVES)}),
votes as (select half_life, coalesce(source, '') source, label, round(sum(pow(0.5, ((select y from top) - yr) / half_life::double)), 9) mass from t, g where yr < (select y from top) group by all),
said as (select half_life, source, label from votes qualify row_number() over (partition by half_life, source order by mass desc, label) = 1),
scored as (select half_life, count(*) cases, count(*) filter (said.label = t.label) hits from t join said on said.source = coalesce(t.source, '') where yr = (select y from top) group by 1)
select half_life, cases, hits, row_number() over (order by hits desc, half_life) = 1 chosen from scored""")  # fmt: skip
def grid_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-lives tried on an inner split: labels weighted by age in the years before the last train year say the label of a source's cases in it."""
    train = materialise(M.training(spark, sf_dir).filter("yr is not null"))
    grid = F.explode(F.array(*[F.lit(h) for h in _HALF_LIVES])).alias("half_life")
    last = train.agg(F.max("yr").alias("y"))  # one row
    dated = train.join(F.broadcast(last)).withColumn("source", F.coalesce("source", F.lit("")))
    votes = dated.filter("yr < y").select("*", grid).groupBy("half_life", "source", "label").agg(F.round(F.sum(F.pow(F.lit(0.5), (F.col("y") - F.col("yr")) / F.col("half_life"))), 9).alias("mass"))
    said = votes.groupBy("half_life", "source").agg(F.min_by("label", F.struct((-F.col("mass")).alias("m"), "label")).alias("said"))
    scored = dated.filter("yr = y").join(said, "source").groupBy("half_life").agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("said") == F.col("label")).alias("hits"))
    return scored.withColumn("chosen", F.row_number().over(Window.orderBy(F.desc("hits"), "half_life")) == 1)  # a row per half-life


@CORE.add("averaged_scores", "CLS-09", sql=M._NB_PREDICT + f""",
pr as (select label, count(*) / (select count(*) from tr)::double q from tr group by 1),
av as (select case_id, pp.label, round((p + coalesce(q, 0)) / 2, 8) a, list_position([{", ".join(f"'{x}'" for x in M.L)}], pp.label) o from pp left join pr using (label))
select case_id, label predicted, round(a, 6) confidence from av qualify row_number() over (partition by case_id order by a desc, o) = 1""")  # fmt: skip
def averaged_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of the largest mean of two models' probabilities: words, and how frequent a label is."""
    train = materialise(M.training(spark, sf_dir))
    held = M.examples(spark, sf_dir).filter("split in ('validation', 'test') and view_text is not null")
    words = classify.predict(classify.fit(train, "case_id", "view_text", "label"), held, "case_id", "view_text").select("case", "label", F.round("probability", 8).alias("p"))
    priors = train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("q", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row per label
    both = words.join(priors.select("label", "q"), "label", "left").withColumn("q", F.coalesce("q", F.lit(0.0)))
    found = classify.averaged(both, "case", "p", "q")
    return found.select(F.col("case").alias("case_id"), F.col("label").alias("predicted"), F.round("mean", 6).alias("confidence"))


# ---- lines of text

@CORE.add("summary_lines", "EVA-15", "EVA-16", sql=M._EVAL + M._PC.format(by="source,") + """,
pa as (select lab.label, count(*) filter (gold = lab.label) support, count(*) filter (predicted = lab.label) said, count(*) filter (gold = lab.label and predicted = lab.label) hit from ev, lab group by 1),
m as (select coalesce(source, '') source, avg(f1) f from pf group by 1 union all select '*', avg(case when said + support > 0 then 2.0 * hit / (said + support) else 0 end) from pa),
c as (select coalesce(source, '') source, count(*) n, avg((gold = predicted)::int::double) acc from ev group by 1 union all select '*', count(*), avg((gold = predicted)::int::double) from ev)
select source, printf('%d cases: accuracy %.3f, macro-F1 %.3f', n, acc, f) line from c join m using (source)""")  # fmt: skip
def summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of measures for all cases (``*``) and for each source."""
    rows = materialise(M.evaluated(spark, sf_dir).withColumn("source", F.coalesce("source", F.lit(""))))
    both = evaluate.summary(rows, "source").unionByName(evaluate.summary(rows).withColumn("source", F.lit("*")))
    return both.select("source", F.format_string("%d cases: accuracy %.3f, macro-F1 %.3f", "cases", "accuracy", "macro_f1").alias("line"))


@CORE.add("progress_lines", "WIN-07", "WIN-03", sql="with curve as (" + CORE.oracle["running_curve"] + """)
select n, round(n / max(n) over ()::double, 9) done, round(2.9::double * n, 6) elapsed, round(2.9::double * (max(n) over () - n), 6) remaining, accuracy, macro_f1 from curve""")  # fmt: skip
def progress_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running curve with the share done and the seconds left, at 2.9 seconds a case."""
    rows = M.running_curve(spark, sf_dir).withColumn("elapsed", 2.9 * F.col("n"))
    return evaluate.progress(rows, "n", "elapsed").select("n", F.round("done", 9).alias("done"), F.round("elapsed", 6).alias("elapsed"), F.round("remaining", 6).alias("remaining"), "accuracy", "macro_f1")


# ---- logs and runs

@CORE.add("log_interval_losses", "SRC-17", "EVA-13", "WIN-04", "WIN-05", sql="""
with l as (select user_id epoch, event_id as o, (event_id % 40) + 1 step, round(1.0 + (event_id % 11) / 10.0, 1)::double mean from events),
m as (select *, max(step) over (partition by epoch order by o rows between unbounded preceding and 1 preceding) top from l),
k as (select * from m where top is null or step > top),
g as (select *, lag(step, 1, 0) over (partition by epoch order by o) s0, lag(mean, 1, 0.0) over (partition by epoch order by o) m0 from k)
select epoch::int epoch, step::int step, round((mean * step - m0 * s0) / (step - s0), 6) loss from g""")  # fmt: skip
def log_interval_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training log written as text and read back line by line; lines of other kinds and repeated steps of a resumed run are passed over."""
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    e = F.col("event_id")
    line = F.format_string("%012d | epoch %d step %d/%d loss %.1f elapsed %d", e, F.col("user_id"), e % 40 + 1, F.lit(40), 1.0 + e % 11 / 10.0, e)
    other = F.format_string("%012d | saved checkpoint", e)
    table(spark, sf_dir, "events").select(F.explode(F.array(line, other)).alias("value")).write.text(path)
    lines = spark.read.text(path).select(F.split("value", r" \| ").alias("v")).select(F.col("v")[0].cast("long").alias("at"), F.col("v")[1].alias("line"))
    w = Window.partitionBy("epoch").orderBy("at")
    kept = files.log_steps(lines).withColumn("top", F.max("step").over(w.rowsBetween(Window.unboundedPreceding, -1))).filter("top is null or step > top")
    s0, m0 = F.lag("step", 1, 0).over(w), F.lag("mean", 1, 0.0).over(w)
    return kept.select("epoch", "step", F.round((F.col("mean") * F.col("step") - m0 * s0) / (F.col("step") - s0), 6).alias("loss"))


@CORE.add("seed_groups", "EVA-06", "AGG-11", sql="""
with r(experiment, seed, validation, test) as (values ('a', 1, 0.4::double, 0.5::double), ('a', 2, 0.6, 0.7), ('b', 1, 0.5, 0.6), ('b', 2, 0.3, null), ('c', 1, 0.2, 0.1))
select experiment, count(*) seeds, round(avg(validation), 9) validation, round(case when bool_and(test is not null) then avg(test) end, 9) test, round(case when bool_and(test is not null) then coalesce(stddev_samp(test), 0) end, 9) deviation from r group by 1""")  # fmt: skip
def seed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of an experiment's seeds; test measures only where every seed has them."""
    runs = spark.createDataFrame([("a", 1, 0.4, 0.5), ("a", 2, 0.6, 0.7), ("b", 1, 0.5, 0.6), ("b", 2, 0.3, None), ("c", 1, 0.2, 0.1)], "experiment string, seed int, validation double, test double")
    return evaluate.seed_groups(runs, "experiment", "validation", "test")


@CORE.add("figure_inputs", "SRC-19", sql="with " + M._EX + "z as (select 1) select case_id, length(view_text) chars, coalesce(label, 'none') label, coalesce(strftime(decision_date, '%Y-%m'), 'undated') as month from ex")
def figure_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What figures are drawn from: length, label and month of every example."""
    rows = M.examples(spark, sf_dir)
    return rows.select("case_id", F.length("view_text").alias("chars"), F.coalesce("label", F.lit("none")).alias("label"), F.coalesce(F.date_format("decision_date", "yyyy-MM"), F.lit("undated")).alias("month"))


@CORE.add("versioned_provisions", "SNK-01", "SNK-09", sql="select node_id, count(*) n, md5(max(text)) digest from provisions where node_id is not null and text is not null group by 1")
def versioned_provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisions written as a new version, whose digest is that of the table read back; a second write of the version is refused."""
    rows = table(spark, sf_dir, "provisions").filter("node_id is not null and text is not null").select("node_id", "text", "section")
    path = f"{shared_folder(spark)}/version-{uuid.uuid4().hex}/provisions_version=1"
    sinks.write_new(rows, path)
    try:
        sinks.write_new(rows, path)
    except FileExistsError:
        pass
    else:
        raise AssertionError("a version was written twice")
    back = spark.read.parquet(path)
    if sinks.table_digest(back, "node_id") != sinks.table_digest(rows, "node_id"):
        raise AssertionError("the table read back is another")
    return back.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.md5(F.max("text")).alias("digest"))


@CORE.add("json_lines_in_order", "SNK-02", "SNK-03", "SNK-06", sql="select document_id, extraction_id, canonical_hint from candidates where extraction_id is not null")
def json_lines_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates written as sorted gzip JSON lines and read back."""
    path = f"{shared_folder(spark)}/candidates-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "candidates").filter("extraction_id is not null").select("document_id", "extraction_id", "canonical_hint")
    sinks.write_json_lines(rows, path, "document_id", "extraction_id")
    return spark.read.schema(rows.schema).json(path)
