"""Queries of ranking, classification and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions import text as T
from docketry.operators import classify, evaluate, ranking
from docketry.plans.text_queries import _sql_label
from docketry.registry import CORE
from docketry.session import materialise, table

L = T.LABELS
_LABELS_SQL = "(values " + ", ".join(f"('{x}')" for x in L) + ")"


# ---- ranking

_BM_DOC = """
with t as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') t from documents where text is not null),
d as (select doc_id, t, len(t) length from t where len(t) > 0),
post as (select term, doc_id, count(*) tf, any_value(length) length from (select doc_id, length, unnest(t) term from d) group by 1, 2),
fr as (select term, count(*) df from post group by 1), c as (select count(*) n, avg(length) average from d)
"""


@CORE.add("bm25_index_stats", "BM-01", "AGG-05", "SRC-13", sql=_BM_DOC + "select (select n from c) documents, round((select average from c), 6) average_length, (select count(*) from fr) n_terms, (select count(*) from post) n_postings, (select max(df) from fr) max_df")
def bm25_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranking.build(table(spark, sf_dir, "documents"), "doc_id", "text")
    terms = index.frequencies.agg(F.count(F.lit(1)).alias("n_terms"), F.sum("df").alias("n_postings"), F.max("df").alias("max_df"))
    return index.corpus.select(F.col("n").alias("documents"), F.round("average", 6).alias("average_length")).join(terms)  # two single rows


@CORE.add("bm25_search", "BM-02", "SRT-01", "JOIN-08", sql=_BM_DOC + """
, q as (select item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) term from eval_items where item_id % 20 = 0),
s as (select q.item_id, p.doc_id, round(sum(ln(1 + (c.n - fr.df + 0.5) / (fr.df + 0.5)) * p.tf * 2.5 / (p.tf + 1.5 * (1 - 0.75 + 0.75 * p.length / c.average))), 9) score
  from q join fr using (term) join post p using (term), c group by 1, 2),
r as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) rn from s)
select item_id, rn::int rnk, doc_id, round(score, 6) score from r where rn <= 10""")  # fmt: skip
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every twentieth evaluation item, against all documents."""
    index = ranking.build(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = ranking.search(index, table(spark, sf_dir, "eval_items").filter("item_id % 20 = 0"), "item_id", "text", 10)
    return found.select(F.col("query").alias("item_id"), F.col("rank").alias("rnk"), F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@CORE.add("bm25_evidence", "BM-04", "SRT-09", "JOIN-09", "TXT-11", sql="""
with pr as (select node_id, max(text) text from provisions where node_id is not null and text is not null group by 1),
d as (select node_id, text, t, len(t) length from (select node_id, text, regexp_extract_all(lower(text), '[a-z0-9]+') t from pr) where len(t) > 0),
post as (select term, node_id, count(*) tf, any_value(length) length from (select node_id, length, unnest(t) term from d) group by 1, 2),
fr as (select term, count(*) df from post group by 1), c as (select count(*) n, avg(length) average from d),
x as (select case_id, max(view_text) view_text, coalesce(max(decision_date), make_date(max("year"), 1, 1)) as_of from examples where lower(trim(split)) = 'test' group by 1),
q as (select case_id, unnest(list_distinct(regexp_extract_all(lower(view_text), '[a-z0-9]+'))) term from x),
s as (select q.case_id, p.node_id, round(sum(ln(1 + (c.n - fr.df + 0.5) / (fr.df + 0.5)) * p.tf * 2.5 / (p.tf + 1.5 * (1 - 0.75 + 0.75 * p.length / c.average))), 9) score
  from q join fr using (term) join post p using (term), c group by 1, 2),
r as (select case_id, node_id, score, row_number() over (partition by case_id order by score desc, node_id) rn from s qualify rn <= 80),
since as (select node_id, min(available_from) since from nodes where node_type = 'provision' group by 1),
k as (select r.case_id, r.node_id, row_number() over (partition by r.case_id order by rn) pos from r join x using (case_id) left join since using (node_id) where coalesce(since <= as_of, true)),
top as (select k.case_id, pos, '- ' || upper(split_part(k.node_id, ':', 3)) || ': ' || trim(regexp_replace(d.text, '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g'))[1:500] line from k join d using (node_id) where pos <= 4)
select case_id, count(*) provisions, md5(string_agg(line, E'\\n' order by pos)) digest from top group by 1""")  # fmt: skip
def bm25_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the test examples, lines of the four best provisions in force: dates are applied after eighty are taken."""
    texts = table(spark, sf_dir, "provisions").filter("node_id is not null and text is not null").groupBy("node_id").agg(F.max("text").alias("text"))
    index = ranking.build(texts, "node_id", "text")
    cases = table(spark, sf_dir, "examples").filter(F.lower(F.trim("split")) == "test").groupBy("case_id").agg(F.max("view_text").alias("view_text"), F.max("decision_date").alias("d"), F.max("year").alias("y"))
    cases = cases.select("case_id", "view_text", F.coalesce("d", F.make_date("y", F.lit(1), F.lit(1))).alias("as_of"))
    since = table(spark, sf_dir, "nodes").filter("node_type = 'provision'").groupBy(F.col("node_id").alias("doc")).agg(F.min("available_from").alias("since"))
    top = ranking.evidence(index, cases, "case_id", "view_text", "as_of", since, 4).join(texts.withColumnRenamed("node_id", "doc"), "doc")
    line = F.concat(F.lit("- "), F.upper(F.get(F.split("doc", ":"), F.lit(2))), F.lit(": "), F.substring(T.one_space(F.col("text")), 1, 500))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n")
    return top.groupBy(F.col("query").alias("case_id")).agg(F.count(F.lit(1)).alias("provisions"), F.md5(lines).alias("digest"))


# ---- classification

_EX = """
ex as (select case_id, max(lower(trim(split))) split, max(view_text) view_text, max(label) label, max(source) source, max(decision_date) decision_date, max("year") yr from examples where case_id is not null group by 1),
tr as (select * from ex where split = 'train' and label is not null and view_text is not null),
"""


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per case."""
    rows = table(spark, sf_dir, "examples").filter("case_id is not null").groupBy("case_id")
    return rows.agg(F.max(F.lower(F.trim("split"))).alias("split"), F.max("view_text").alias("view_text"), F.max("label").alias("label"), F.max("source").alias("source"), F.max("decision_date").alias("decision_date"), F.max("year").alias("yr"))


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples(spark, sf_dir).filter("split = 'train' and label is not null and view_text is not null")


_NB = "with " + _EX + f"""
tk as (select case_id, label, token, count(*) n from (select case_id, label, unnest(regexp_extract_all(lower(view_text), '[a-z][a-z-]{{2,}}')) token from tr) group by all),
vo as (select token from (select token, count(distinct case_id) df from tk group by 1) order by df desc, token limit 2000),
ct as (select token, label, sum(n) n from tk join vo using (token) group by all),
lab(label) as {_LABELS_SQL},
cl as (select lab.label, coalesce(d, 0) documents, coalesce(t, 0) tokens from lab left join (select label, count(*) d from tr group by 1) using (label) left join (select label, sum(n) t from ct group by 1) using (label)),
"""


@CORE.add("nb_statistics", "CLS-01", "AGG-07", "SRT-04", sql=_NB + "z as (select 1) select label, documents::bigint documents, tokens::bigint tokens, (select count(*) from vo) vocabulary from cl")
def nb_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = classify.fit(training(spark, sf_dir), "case_id", "view_text", "label")
    return model.classes.select("label", "documents", "tokens", F.lit(model.size).cast("long").alias("vocabulary"))


_NB_PREDICT = _NB + """
he as (select case_id, view_text from ex where split in ('validation', 'test') and view_text is not null),
fo as (select case_id, token, count(*) f from (select case_id, unnest(regexp_extract_all(lower(view_text), '[a-z][a-z-]{2,}')) token from he) join vo using (token) group by all),
sc as (select he.case_id, cl.label, ln((cl.documents + 1.0) / ((select count(*) from tr) + 4.0)) + coalesce((select sum(fo.f * ln((coalesce(ct.n, 0) + 1.0) / (cl.tokens + 1.0 * (select count(*) from vo)))) from fo left join ct on ct.token = fo.token and ct.label = cl.label where fo.case_id = he.case_id), 0) score from he, cl),
ee as (select case_id, label, exp(score - max(score) over (partition by case_id)) e from sc),
pp as (select case_id, label, round(e / sum(e) over (partition by case_id), 8) p from ee)
"""


@CORE.add("nb_predict", "CLS-02", "CLS-03", "FLT-04", sql=_NB_PREDICT + "select case_id, max({'p': p, 'label': label}).label predicted, round(max(p), 6) confidence from pp group by 1")
def nb_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the held-out examples by a model of the train examples only."""
    model = classify.fit(training(spark, sf_dir), "case_id", "view_text", "label")
    held = examples(spark, sf_dir).filter("split in ('validation', 'test') and view_text is not null")
    found = classify.best(classify.predict(model, held, "case_id", "view_text"))
    return found.select(F.col("case").alias("case_id"), F.col("label").alias("predicted"), F.round("probability", 6).alias("confidence"))


@CORE.add("tfidf_vectors", "CLS-04", sql="with " + _EX + """
w as (select case_id, regexp_extract_all(lower(view_text), '[a-z][a-z-]{2,}') t from tr),
g as (select case_id, unnest(t) term from w union all select case_id, t[i] || ' ' || t[i + 1] from (select case_id, t, unnest(range(1, len(t))) i from w)),
c as (select case_id, term, count(*) tf from g group by all),
df as (select term, count(*) df from c group by 1 having count(*) >= 2),
we as (select case_id, term, (1 + ln(tf)) * (ln((1 + (select count(*) from tr)) / (1.0 + df)) + 1) w from c join df using (term)),
no as (select case_id, sqrt(sum(w * w)) nrm from we group by 1)
select case_id, count(*) n_terms, round(sum(w / nrm), 6) weight_sum, round(max(w / nrm), 6) weight_max from we join no using (case_id) group by 1""")  # fmt: skip
def tfidf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors of the train views, summed up per case."""
    rows = classify.tfidf(training(spark, sf_dir), "case_id", "view_text")
    return rows.groupBy(F.col("doc").alias("case_id")).agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("weight"), 6).alias("weight_sum"), F.round(F.max("weight"), 6).alias("weight_max"))


@CORE.add("class_weights", "AGG-13", sql="with " + _EX + """
c as (select label, count(*) n from tr group by 1), r as (select label, n, sum(n) over () / (count(*) over () * n)::double raw from c)
select label, n, round(raw * sum(n) over () / sum(raw * n) over (), 9) weight from r""")  # fmt: skip
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = training(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return classify.class_weights(counts).select("label", "n", F.round("weight", 9).alias("weight"))


@CORE.add("logistic_predictions", "CLS-04")
def logistic_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-balanced logistic regression on hashed tf-idf features; rows only, its solver is its own."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, StringIndexer

    train = training(spark, sf_dir)
    weights = F.broadcast(classify.class_weights(train.groupBy("label").agg(F.count(F.lit(1)).alias("n"))).select("label", "weight"))  # a row per label
    train = materialise(train.join(weights, "label").withColumn("t", T.words(F.col("view_text"))))
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(train)
    steps = [HashingTF(inputCol="t", outputCol="tf", numFeatures=1 << 14), IDF(inputCol="tf", outputCol="x", minDocFreq=2), LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", regParam=0.01, maxIter=30)]
    model = Pipeline(stages=steps).fit(index.transform(train))
    held = examples(spark, sf_dir).filter("split in ('validation', 'test') and view_text is not null").withColumn("t", T.words(F.col("view_text")))
    names = F.array(*[F.lit(x) for x in index.labels])
    return model.transform(held).select("case_id", F.get(names, F.col("prediction").cast("int")).alias("predicted"))


@CORE.add("mean_pooled_vectors", "CLS-10", sql="""
select label, i::int as pos, round(avg(v), 6) mean_value, count(*) n from (select label, unnest(embedding) v, unnest(range(len(embedding))) i from embeddings) group by 1, 2""")  # fmt: skip
def mean_pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector per owner, position by position."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    return rows.groupBy("label", "pos").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean_value"), F.count(F.lit(1)).alias("n"))


@CORE.add("picked_labels", "CLS-13", sql="""
with s as (select event_id, 1.0 * (event_id % 7) / 7 a, 1.0 * (event_id % 5) / 5 b, 1.0 * (event_id % 3) / 3 c, 0.5 d from events)
select event_id, case when round(a, 9) >= greatest(round(b, 9), round(c, 9), d) then 'allowed' when round(b, 9) >= greatest(round(c, 9), d) then 'dismissed' when round(c, 9) >= d then 'disposed' else 'partly_allowed' end label from s""")  # fmt: skip
def picked_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of the largest stored score, of equal ones the first of the schema."""
    e = F.col("event_id")
    scores = {"allowed": F.round((e % 7) / 7, 9), "dismissed": F.round((e % 5) / 5, 9), "disposed": F.round((e % 3) / 3, 9), "partly_allowed": F.lit(0.5)}
    return table(spark, sf_dir, "events").select("event_id", classify.pick_label(scores).alias("label"))


@CORE.add("learning_rates", "CLS-14", sql="""
select u::int "update", round(case when u < 10 then (u + 1) / 10.0 else greatest(0.0, (100 - u) / 90.0) end, 9) factor from range(0, 110) t(u)""")  # fmt: skip
def learning_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(110).select(F.col("id").cast("int").alias("update"), F.round(classify.learning_rate(F.col("id"), 100, 0.1, "linear"), 9).alias("factor"))


# ---- evaluation: the label in the examples against the one that the judgment's text states; B always says the most frequent

_EVAL = "with " + _EX + f"""
jt as (select case_id, max(text) text from judgments where case_id is not null and text is not null group by 1),
lb as (select case_id, {_sql_label('text[floor(length(text) * 0.8::double)::int + 1:]')} label from jt),
ev as (select ex.case_id, ex.split, ex.source, ex.label gold, coalesce(lb.label, 'dismissed') predicted from ex join lb using (case_id) where ex.label is not null),
lab(label) as {_LABELS_SQL},
"""


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "judgments").filter("case_id is not null and text is not null").groupBy("case_id").agg(F.max("text").alias("text"))
    said = texts.select("case_id", F.coalesce(T.disposition(T.label_region(F.col("text"))), F.lit("dismissed")).alias("predicted"))
    return examples(spark, sf_dir).filter("label is not null").join(said, "case_id").select("case_id", "split", "source", F.col("label").alias("gold"), "predicted")


@CORE.add("confusion_matrix", "AGG-08", "EVA-01", sql=_EVAL + "z as (select 1) select a.label gold, b.label predicted, (select count(*) from ev where gold = a.label and predicted = b.label) n from lab a, lab b")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(evaluated(spark, sf_dir))


_PC = """
pc as (select {by} lab.label, count(*) filter (gold = lab.label) support, count(*) filter (predicted = lab.label) said, count(*) filter (gold = lab.label and predicted = lab.label) hit from ev, lab group by all),
pf as (select *, case when said > 0 then hit / said::double else 0 end prec, case when support > 0 then hit / support::double else 0 end rec, case when said + support > 0 then 2.0 * hit / (said + support) else 0 end f1 from pc)
"""


@CORE.add("per_class_metrics", "AGG-09", "EVA-16", sql=_EVAL + _PC.format(by="") + "select label, support, round(prec, 9) \"precision\", round(rec, 9) recall, round(f1, 9) f1 from pf")
def per_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.per_class(evaluated(spark, sf_dir)).select("label", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@CORE.add("metrics_by_source", "AGG-10", "JOIN-15", sql=_EVAL + _PC.format(by="source,") + """
, a as (select source, count(*) cases, avg((gold = predicted)::int::double) acc from ev group by 1)
select a.source, cases, round(acc, 9) accuracy, round(m, 9) macro_f1 from a join (select source, avg(f1) m from pf group by 1) b on a.source = b.source where (select count(*) from a) >= 2""")  # fmt: skip
def metrics_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures per source, where there are two or more."""
    rows = evaluate.summary(materialise(evaluated(spark, sf_dir)), "source")
    several = F.count(F.lit(1)).over(Window.partitionBy()) >= 2  # a row per source
    return rows.withColumn("several", several).filter("several").select("source", "cases", F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"))


@CORE.add("running_curve", "WIN-03", sql=_EVAL + """
o as (select row_number() over (order by case_id) n, gold, predicted from ev),
c as (select n, sum((gold = predicted)::int) over w hits, """ + ", ".join(f"sum((gold = '{x}' and predicted = '{x}')::int) over w h{i}, sum((gold = '{x}')::int) over w g{i}, sum((predicted = '{x}')::int) over w p{i}" for i, x in enumerate(L)) + """
  from o window w as (order by n rows unbounded preceding))
select n, round(hits / n::double, 9) accuracy, round((""" + " + ".join(f"case when g{i} + p{i} > 0 then 2.0 * h{i} / (g{i} + p{i}) else 0 end" for i in range(4)) + """) / 4, 9) macro_f1 from c where n % 25 = 0 or n = (select count(*) from o)""")  # fmt: skip
def running_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.running_curve(evaluated(spark, sf_dir), "case_id", 25)
    return rows.select(F.col("n").cast("long").alias("n"), F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"))


_U = "(('0x' || sha256({seed})[1:8])::bigint / 4294967296.0)"


@CORE.add("paired_bootstrap", "EVA-02", "EVA-03", "EVA-04", "SRT-06", "JOIN-10", sql=_EVAL + """
o as (select row_number() over (order by case_id) i, gold, predicted a, 'dismissed' b from ev), n as (select count(*) n from o),
dr as (select r resample, floor(""" + _U.format(seed="'boot|' || r || '|' || k") + """ * n)::int + 1 i from n, range(0, 200) t(r), lateral (select unnest(range(1, n + 1)) k)),
s as (select resample, gold, a, b from dr join o using (i) union all select -1, gold, a, b from o),
x as (select resample, label, count(*) filter (gold = label and a = label) ha, count(*) filter (gold = label and b = label) hb, count(*) filter (a = label) pa, count(*) filter (b = label) pb, count(*) filter (gold = label) g from s, lab group by all),
d as (select resample, round(avg(case when pa + g > 0 then 2.0 * ha / (pa + g) else 0 end) - avg(case when pb + g > 0 then 2.0 * hb / (pb + g) else 0 end), 12) delta from x group by 1),
q as (select delta, row_number() over (order by delta, resample) - 1 r from d where resample >= 0)
select round((select delta from d where resample = -1), 9) delta, round(max(delta) filter (r = 5), 9) lower, round(max(delta) filter (r = 195), 9) upper, avg((delta <= 0)::int::double) share_not_better from q""")  # fmt: skip
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label stated in the text against always saying dismissed, over 200 resamples drawn by hash."""
    rows = materialise(evaluated(spark, sf_dir).select("case_id", "gold", F.col("predicted").alias("a"), F.lit("dismissed").alias("b")))
    out = evaluate.paired_bootstrap(rows, "case_id", 200, "boot")
    return out.select(*[F.round(c, 9).alias(c) for c in ("delta", "lower", "upper")], "share_not_better")


@CORE.add("mcnemar", "EVA-19", sql=_EVAL + """
c as (select count(*) filter (gold = predicted and gold <> 'dismissed') b, count(*) filter (gold <> predicted and gold = 'dismissed') c from ev)
select b a_only, c b_only, round(least(1.0, 2 * (select sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2))) from range(0, least(b, c) + 1) t(k))), 9) p_value from c""")  # fmt: skip
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact two-sided test on the cases that one of the two systems gets right."""
    from math import lgamma, log

    right_a, right_b = F.col("gold") == F.col("predicted"), F.col("gold") == "dismissed"
    row = evaluated(spark, sf_dir).agg(F.count_if(right_a & ~right_b).alias("b"), F.count_if(~right_a & right_b).alias("c")).first()  # two numbers
    n = row.b + row.c
    from math import exp

    p = min(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * log(2)) for k in range(min(row.b, row.c) + 1)))
    return spark.createDataFrame([(row.b, row.c, round(p, 9))], "a_only long, b_only long, p_value double")


@CORE.add("wilson_intervals", "EVA-09", "EVA-05", "JOIN-12", sql=_EVAL + f"""
a as (select split, count(*) n, count(*) filter (gold = predicted) k from ev group by 1), z as (select {evaluate.Z} z),
w as (select split, n, k / n::double p, 1 + z * z / n den, z from a, z),
v as (select split, n, p, (p + z * z / (2 * n)) / den centre, z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / den spread from w)
select split, n, round(p, 9) point, round(greatest(0, centre - spread), 9) lower, round(least(1, centre + spread), 9) upper, 0.8 between greatest(0, centre - spread) and least(1, centre + spread) inside from v""")  # fmt: skip
def wilson_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy per split with its interval, and whether 0.8 lies in it."""
    rows = evaluated(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gold") == F.col("predicted")).alias("k")).withColumn("w", evaluate.wilson(F.col("k"), F.col("n")))
    return rows.select("split", "n", *[F.round(F.col("w")[c], 9).alias(c) for c in ("point", "lower", "upper")], F.lit(0.8).between(F.col("w.lower"), F.col("w.upper")).alias("inside"))


_RECALL = {"allowed": 0.86, "dismissed": 0.78, "disposed": 0.6, "partly_allowed": 0.38}
_WEIGHT = {a: {b: w for b, w in zip([x for x in L if x != a], (0.5, 0.3, 0.2), strict=True)} for a in L}


@CORE.add("projected_confusion", "EVA-07", "AGG-06", sql="with " + _EX + f"""
su as (select label gold, count(*) n from ex where split = 'validation' and label is not null group by 1),
re(gold, recall) as (values {", ".join(f"('{a}', {r}::double)" for a, r in _RECALL.items())}),
we(gold, predicted, weight) as (values {", ".join(f"('{a}', '{b}', {w}::double)" for a, x in _WEIGHT.items() for b, w in x.items())}),
ba as (select gold, n, least(n, greatest(0, floor(n * recall + 0.5)::bigint)) correct from su join re using (gold)),
sh as (select ba.gold, predicted, n - correct errors, weight * (n - correct) share, floor(weight * (n - correct))::bigint whole from ba join we using (gold)),
ra as (select *, errors - sum(whole) over (partition by gold) lft, row_number() over (partition by gold order by share - whole desc, predicted) r from sh)
select gold, gold predicted, correct n from ba union all select gold, predicted, (whole + (r <= lft)::int)::bigint from ra""")  # fmt: skip
def projected_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recalls assumed for the validation split as a matrix of whole cases."""
    supports = examples(spark, sf_dir).filter("split = 'validation' and label is not null").groupBy(F.col("label").alias("gold")).agg(F.count(F.lit(1)).alias("n"))
    recalls = spark.createDataFrame(list(_RECALL.items()), "gold string, recall double")
    weights = spark.createDataFrame([(a, b, w) for a, x in _WEIGHT.items() for b, w in x.items()], "gold string, predicted string, weight double")
    return evaluate.projected_confusion(supports, recalls, weights)


@CORE.add("learning_curve", "EVA-10", sql="""
select n::bigint labelled_cases, round(0.9 - (0.9 - 0.6) * pow(1000, 0.35) / pow(n, 0.35), 6) projected_accuracy, n = 1000 is_current from (values (250), (500), (1000), (2000), (5000), (20000)) t(n)""")  # fmt: skip
def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A power law through accuracy 0.6 at 1,000 labelled cases, towards 0.9."""
    points = spark.createDataFrame([(n,) for n in (250, 500, 1000, 2000, 5000, 20000)], "labelled_cases long")
    n = F.col("labelled_cases")
    return points.select("labelled_cases", F.round(0.9 - (0.9 - 0.6) * F.pow(F.lit(1000.0), F.lit(0.35)) / F.pow(n.cast("double"), F.lit(0.35)), 6).alias("projected_accuracy"), (n == 1000).alias("is_current"))


@CORE.add("binomial_simulation", "EVA-11", "EVA-12", "WIN-10", sql="""
with d as (select t, count(*) filter (""" + _U.format(seed="'sim|' || t || '|' || i") + """ < 0.7) a, count(*) filter (""" + _U.format(seed="'ref|' || t || '|' || i") + """ < 0.6) b from range(0, 300) x(t), range(0, 60) y(i) group by 1)
select a correct, count(*) draws, count(*) / sum(count(*)) over () share, count(*) filter (a > b) wins from d group by 1""")  # fmt: skip
def binomial_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """300 draws of 60 cases at accuracy 0.7, by hash; wins are those ahead of one at 0.6."""
    grid = spark.range(300).select(F.col("id").cast("string").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(59))).alias("i")).withColumn("i", F.col("i").cast("string"))
    d = grid.groupBy("t").agg(F.count_if(T.uniform(F.lit("sim"), F.col("t"), F.col("i")) < 0.7).alias("a"), F.count_if(T.uniform(F.lit("ref"), F.col("t"), F.col("i")) < 0.6).alias("b"))
    out = d.groupBy(F.col("a").alias("correct")).agg(F.count(F.lit(1)).alias("draws"), F.count_if(F.col("a") > F.col("b")).alias("wins"))
    return out.select("correct", "draws", (F.col("draws") / F.sum("draws").over(Window.partitionBy())).alias("share"), "wins")  # at most 61 rows


@CORE.add("prefill_cost", "EVA-18", sql="""
select experiment_id, max_seq_length tokens, 2.0 * 8e9 * max_seq_length + 4.0 * 36 * 4096 * max_seq_length * max_seq_length flops from (select distinct experiment_id, max_seq_length from configs)""")  # fmt: skip
def prefill_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations to read a full prompt: two per weight and token, and attention over all pairs."""
    n = F.col("max_seq_length").cast("double")
    return table(spark, sf_dir, "configs").select("experiment_id", F.col("max_seq_length").alias("tokens"), (2.0 * 8e9 * n + 4.0 * 36 * 4096 * n * n).alias("flops")).distinct()


@CORE.add("controlled_runs", "JOIN-11", "EVA-06", sql="""
with r(run_id, acc) as (values ('qwen-a-graph-s1-v1', 0.5::double), ('qwen-a-graph-s2-v1', 0.7), ('qwen-a-text-s1-v1', 0.45), ('qwen-a-text-s2-v1', 0.6), ('other-b-graph-v1', 0.3)),
k as (select *, array_to_string(string_split(run_id, '-')[1:2], '-') || coalesce('-' || nullif(regexp_extract(run_id, '-(s[0-9]+)-v[0-9]+$', 1), ''), '') control_key, run_id like '%text%' is_text from r)
select a.run_id, b.run_id control, round(a.acc - b.acc, 9) gain from k a left join k b on a.control_key = b.control_key and b.is_text where not a.is_text""")  # fmt: skip
def controlled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs beside the text run of their family and seed."""
    rows = spark.createDataFrame([("qwen-a-graph-s1-v1", 0.5), ("qwen-a-graph-s2-v1", 0.7), ("qwen-a-text-s1-v1", 0.45), ("qwen-a-text-s2-v1", 0.6), ("other-b-graph-v1", 0.3)], "run_id string, acc double")
    seed = F.nullif(F.regexp_extract("run_id", r"-(s[0-9]+)-v[0-9]+$", 1), F.lit(""))
    keyed = rows.withColumn("key", F.concat(F.substring_index("run_id", "-", 2), F.coalesce(F.concat(F.lit("-"), seed), F.lit("")))).withColumn("text", F.col("run_id").contains("text"))
    control = keyed.filter("text").select("key", F.col("run_id").alias("control"), F.col("acc").alias("of_control"))
    return keyed.filter("not text").join(control, "key", "left").select("run_id", "control", F.round(F.col("acc") - F.col("of_control"), 9).alias("gain"))


@CORE.add("small_draws", "EVA-17", "SRT-06", sql=_EVAL + """
s as (select r, gold = predicted hit_a, gold = 'dismissed' hit_b, row_number() over (partition by r order by sha256('draw|' || r || '|' || case_id), case_id) k from ev, range(0, 50) t(r)),
d as (select r, avg(hit_a::int::double) - avg(hit_b::int::double) delta from s where k <= 46 group by 1)
select count(*) draws, round(avg(delta), 9) mean_delta, round(stddev_samp(delta), 9) sd, avg((delta < 0)::int::double) order_flips from d""")  # fmt: skip
def small_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far two fixed systems move apart on 50 hash-drawn sets of 46 cases, and how often their order flips."""
    rows = evaluated(spark, sf_dir).select("case_id", (F.col("gold") == F.col("predicted")).cast("int").alias("a"), (F.col("gold") == "dismissed").cast("int").alias("b"))
    drawn = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("r")).withColumn("h", F.sha2(F.concat_ws("|", F.lit("draw"), F.col("r").cast("string"), "case_id"), 256))
    k = F.row_number().over(Window.partitionBy("r").orderBy("h", "case_id"))  # an evaluation set
    d = drawn.withColumn("k", k).filter("k <= 46").groupBy("r").agg((F.avg("a") - F.avg("b")).alias("delta"))
    return d.agg(F.count(F.lit(1)).alias("draws"), F.round(F.avg("delta"), 9).alias("mean_delta"), F.round(F.stddev_samp("delta"), 9).alias("sd"), F.avg((F.col("delta") < 0).cast("int")).alias("order_flips"))
