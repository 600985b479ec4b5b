"""Queries of problem 3: judgments that share an author, a lead party or a matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import splits
from docketry.llm.registry import LLM
from docketry.session import materialise, table

# Words of titles, of placeholders and of a company's legal form, and the short forms of matters.
TITLES = r"\b(hon\W?ble|justice|chief|mr|mrs|ms|dr|shri|smt|the)\b"
PLACEHOLDERS = r"^(|per curiam|not recorded|unknown|na|n a|none|nil)$"
LEGAL_FORM = r"\b(pvt|private|p|ltd|limited)\b"
GOVERNMENT = r"^(the )?(state|union) of\b"


def _plain(c: Column) -> Column:
    """Lower case; everything but letters and digits is one space."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def author_key(c: Column) -> Column:
    """Initials and surname: ``HON'BLE JUSTICE D. K. RIMOROTE`` and ``d k rimorote j`` to ``a|dk rimorote``."""
    plain = _plain(F.regexp_replace(F.lower(c), TITLES, " "))
    plain = F.regexp_replace(plain, r"(?<=\S) (c j i|c j|cj|cji|j j|jj|j)$", "")
    surname = F.regexp_extract(plain, r"(\S+)$", 1)
    # a given name written out counts by its initial; two letters are two initials written together
    initials = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"\S+$", ""), r"\b(\p{L})\p{L}{2,}", "$1"), " ", "")
    return F.when(~_plain(c).rlike(PLACEHOLDERS) & (surname != ""), F.concat(F.lit("a|"), initials, F.lit(" "), surname))


def party_key(c: Column) -> Column:
    plain = F.trim(F.regexp_replace(_plain(F.regexp_replace(F.lower(c), r"^\s*(m/s\b|messrs\b)", " ")), LEGAL_FORM, " "))
    plain = F.regexp_replace(plain, " +", " ")
    return F.when(~_plain(c).rlike(PLACEHOLDERS) & ~_plain(c).rlike(GOVERNMENT) & (plain != ""), F.concat(F.lit("p|"), plain))


def matter_key(c: Column) -> Column:
    """Initials of the kind, number and year: ``C.A. No. 85943/2006`` and ``CIVIL APPEAL NO.85943 OF 2006`` agree."""
    plain = F.regexp_replace(_plain(c), r"\bcrl\b", "criminal")
    kind = F.regexp_replace(F.regexp_replace(F.regexp_extract(plain, r"^(.*?)(?: nos?)? \d+ (?:of )?\d{4}$", 1), r"\bcriminal\b", "crl"), r"\b(\p{L})\p{L}*", "$1")
    criminal = F.when(plain.rlike(r"^criminal\b"), F.lit("cr")).otherwise(F.lit(""))
    number, year = F.regexp_extract(plain, r"(\d+) (?:of )?\d{4}$", 1), F.regexp_extract(plain, r"(\d{4})$", 1)
    found = plain.rlike(r"^\D*\d+ (of )?\d{4}$")
    return F.when(found, F.concat(F.lit("m|"), criminal, F.regexp_replace(kind, " ", ""), F.lit("|"), F.regexp_replace(number, "^0+", ""), F.lit("|"), year))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``record, component`` of the judgments."""
    rows = table(spark, sf_dir, "judgments").select("case_id", "attributes")
    keys = [author_key(F.col("attributes")["author"]), party_key(F.col("attributes")["lead_party"]), matter_key(F.col("attributes")["matter_no"])]
    return splits.components(rows, "case_id", keys)


_SQL = r"""
with recursive base as (
  select distinct case_id, lower(trim(origin_split)) origin, attributes['author'] au, attributes['lead_party'] pa, attributes['matter_no'] ma from judgments where case_id is not null),
words as (
  select case_id, origin,
    trim(regexp_replace(lower(au), '[^a-z0-9]+', ' ', 'g')) au0,
    regexp_replace(trim(regexp_replace(regexp_replace(lower(au), '\b(hon\W?ble|justice|chief|mr|mrs|ms|dr|shri|smt|the)\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), ' j$', '') au1,
    trim(regexp_replace(lower(pa), '[^a-z0-9]+', ' ', 'g')) pa0,
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(pa), '^\s*m/s\b', ' '), '[^a-z0-9]+', ' ', 'g'), '\b(pvt|private|p|ltd|limited)\b', ' ', 'g'), ' +', ' ', 'g')) pa1,
    trim(regexp_replace(lower(ma), '[^a-z0-9]+', ' ', 'g')) ma0
  from base),
keyed as (
  select case_id, origin,
    case when au0 not in ('', 'per curiam', 'not recorded') then 'a|' || replace(regexp_extract(au1, '^(.*) \S+$', 1), ' ', '') || ' ' || regexp_extract(au1, '(\S+)$', 1) end a,
    case when pa0 not in ('', 'not recorded') and not regexp_matches(pa0, '^(state|union) of ') then 'p|' || pa1 end p,
    case when regexp_matches(ma0, '^[^0-9]*[0-9]+ (of )?[0-9]{4}$') then
      case when ma0 like 'cr%' then 'm|cr' when ma0 like 'w%' then 'm|w' else 'm|c' end || regexp_extract(ma0, '([0-9]+) (of )?[0-9]{4}$', 1) || '|' || right(ma0, 4) end m
  from words),
held as (select case_id, unnest([x for x in [a, p, m] if x is not null]) k from keyed),
links as (select distinct x.k u, y.k v from held x join held y on x.case_id = y.case_id and x.k <> y.k),
reach(k, l) as (select k, k from (select distinct k from held) union select e.v, r.l from reach r join links e on e.u = r.k where r.l < e.v),
label as (select k, min(l) l from reach group by 1),
member as (select case_id, min(l) l from held join label using (k) group by 1),
whole as (select b.case_id, b.origin, coalesce(m.l, 'r|' || b.case_id) l from base b left join member m using (case_id)),
named as (select l, min(case_id) group_id, count(distinct origin) splits, count(distinct case_id) members from whole group by 1)
"""


@LLM.add("p3_found", "GROUPS", sql=_SQL + "select distinct case_id, group_id from whole join named using (l) where splits > 1")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the groups that today's splits tear apart."""
    members = materialise(groups(spark, sf_dir))
    origin = table(spark, sf_dir, "judgments").select(F.col("case_id").alias("record"), F.lower(F.trim("origin_split")).alias("origin"))
    torn = members.join(origin, "record").groupBy("component").agg(F.min("origin").alias("a"), F.max("origin").alias("b")).filter("a <> b")
    return members.join(torn.select("component"), "component").select(F.col("record").alias("case_id"), F.col("component").alias("group_id")).distinct()


@LLM.add("p3_groups", "GROUPS", sql=_SQL + "select group_id, members, splits from named where members > 1")
def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group of two members or more, with the number of today's splits it lies in."""
    origin = table(spark, sf_dir, "judgments").select(F.col("case_id").alias("record"), F.lower(F.trim("origin_split")).alias("origin"))
    rows = groups(spark, sf_dir).join(origin, "record").groupBy(F.col("component").alias("group_id"))
    return rows.agg(F.countDistinct("record").alias("members"), F.countDistinct("origin").alias("splits")).filter("members > 1")


@LLM.add(
    "p3_splits", "GROUPS",
    sql=_SQL + """,
laid as (select l, group_id, members, members > 0.005 * sum(members) over () heavy, sum(members) over () total from named),
placed as (select l, group_id, (sum(members) over (order by case when heavy then -members else 1 end, md5(group_id), group_id) - members) / total spot from laid),
cuts as (
  select split_name, sum(share) over (order by share desc, split_name) / sum(share) over () edge, row_number() over (order by share, split_name desc) = 1 is_last
  from split_shares where split_name is not null and share > 0),
chosen as (select l, group_id, arg_min(split_name, case when is_last then 2 else edge end) split from placed, cuts where is_last or spot < edge - 1e-12 group by 1, 2)
select distinct case_id, group_id, split from whole join chosen using (l)""",
)
def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new split of every judgment: no group in two splits, shares of the records as in split_shares."""
    given = table(spark, sf_dir, "split_shares").filter("split_name is not null and share > 0")
    shares = [(r.split_name, float(r.share)) for r in given.orderBy(F.desc("share"), "split_name").collect()]
    members = materialise(groups(spark, sf_dir))
    return members.join(splits.assign(members, shares), "component").select(F.col("record").alias("case_id"), F.col("component").alias("group_id"), F.col("split"))
