"""Statistics plans: counts of labels, contingency, correlations by group, comparisons of sources and methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators import relational, stats
from parlance.plans.corpus import phi_sql
from parlance.plans.registry import ORACLES, query, table

JOINED = "(select d.lang, d.source, coalesce(l.quality, 0) = 1 as positive, coalesce(l.quality, 1) = 0 as negative, coalesce(l.toxic, 0) = 1 as emphatic, coalesce(l.toxic, 1) = 0 as hedged from documents d join labels l using (doc_id))"


def labels(spark, sf_dir) -> DataFrame:
    """Labels on the documents' dimensions: quality plays valence, toxic modality."""
    one = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select("lang", "source", one("quality", 1).alias("positive"), one("quality", 0).alias("negative"), one("toxic", 1).alias("emphatic"), one("toxic", 0).alias("hedged"))


@query(f"select source, count(*) as total, count(*) filter (positive) as pos, count(*) filter (negative) as neg, count(*) filter (emphatic) as emph, count(*) filter (hedged) as hedged, round(count(*) filter (negative) / count(*), 4) as p_negative from {JOINED} group by source having count(*) >= 5")
def label_counts(spark, sf_dir):
    """Counts and micro-averaged shares by speaker, from five labels on."""
    agg = labels(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(c)).alias(n) for c, n in (("positive", "pos"), ("negative", "neg"), ("emphatic", "emph"), ("hedged", "hedged"))))
    return agg.where("total >= 5").withColumn("p_negative", F.round(F.col("neg") / F.col("total"), 4))


AXES = {"pos_emp": ("positive", "emphatic"), "pos_hed": ("positive", "hedged"), "neg_emp": ("negative", "emphatic"), "neg_hed": ("negative", "hedged")}


@query(phi_sql(JOINED, "source", AXES, 10))
def contingency_phi(spark, sf_dir):
    """Four phi coefficients by speaker with ten labels, and pooled over all."""
    return stats.phi_table(labels(spark, sf_dir), "source", {n: (F.col(a), F.col(b)) for n, (a, b) in AXES.items()})


R = "case when stddev_pop({0}) = 0 or stddev_pop({1}) = 0 then null else covar_pop({0}, {1}) / (stddev_pop({0}) * stddev_pop({1})) end"
DAYS = "select user_id, cast(date_trunc('day', ts) as date) as day, cast(count(*) as double) as n, count(*) filter (event_type = 'click') / cast(count(*) as double) as clicks, count(*) filter (event_type = 'view') / cast(count(*) as double) as views from events group by all"


def days(spark, sf_dir) -> DataFrame:
    part = lambda kind: (F.count_if(F.col("event_type") == kind) / F.count(F.lit(1))).alias(kind + "s")
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("n"), part("click"), part("view"))


@query(f"select user_id, count(*) as n_days, round({R.format('clicks', 'views')}, 4) as r from ({DAYS}) group by user_id having count(*) >= 4")
def pearson_by_group(spark, sf_dir):
    """Correlation of two shares over a user's days, from four days on."""
    agg = days(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_days"), F.round(stats.pearson(F.col("clicks"), F.col("views")), 4).alias("r"))
    return agg.where("n_days >= 4")


# Student's t of whole degrees of freedom has a closed form: with sin = |r| and cos = sqrt(1 - r * r), a sum over powers of cos
_T_EVEN = "abs(r) * list_sum(list_transform(range(0, (n_days - 2) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * power(1 - r * r, k)))"
_T_ODD = "2 / pi() * (asin(abs(r)) + coalesce(abs(r) * sqrt(1 - r * r) * list_sum(list_transform(range(0, (n_days - 3) // 2), lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5)) * sqrt(pi()) / 2 * power(1 - r * r, k))), 0))"


@query(f"select *, round(case when n_days < 3 or r is null then null when n_days % 2 = 0 then 1 - {_T_EVEN} else 1 - {_T_ODD} end, 6) as p from ({ORACLES['pearson_by_group']})")
def pearson_pvalues(spark, sf_dir):
    """The same with two-sided p-values; also tested against published values."""
    return stats.with_pvalue(pearson_by_group(spark, sf_dir), "r", "n_days", "p")


@query(f"""with s as (select user_id, user_id % 7 as domain, count(*) as n_days, {R.format('clicks', 'views')} as r from ({DAYS}) group by user_id having count(*) >= 4)
select domain, count(*) as n_speakers, round(avg(r), 4) as r_mean, round(stddev_pop(r), 4) as r_std, round(count(*) filter (abs(r) > 0.5) / count(*), 3) as strong_share from s where domain < 6 group by domain""")
def domain_typology(spark, sf_dir):
    """Mean, population spread and share of strong correlations by listed domain."""
    s = days(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_days"), stats.pearson(F.col("clicks"), F.col("views")).alias("r")).where("n_days >= 4")
    listed = spark.createDataFrame([(i,) for i in range(6)], "domain long")
    rows = s.withColumn("domain", F.col("user_id") % 7).join(relational.small(listed), "domain")
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n_speakers"), F.round(F.avg("r"), 4).alias("r_mean"), F.round(F.stddev_pop("r"), 4).alias("r_std"), F.round(F.count_if(F.abs("r") > 0.5) / F.count(F.lit(1)), 3).alias("strong_share"))


@query("""with v as (select p_size % 7 as g, p_retailprice as x from part), r as (select g, x, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rk from v),
s as (select sum(ss / k) as s, sum(k) as n, count(*) as groups from (select g, sum(rk) * sum(rk) as ss, count(*) as k from r group by g)),
t as (select coalesce(sum(c * c * c - c), 0) as ties from (select cast(count(*) as double) as c from v group by x))
select round((12.0 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 4) as kruskal_h, groups - 1 as df from s, t""")
def kruskal_h(spark, sf_dir):
    """H over prices by group, ties corrected."""
    rows = table(spark, sf_dir, "part").select((F.col("p_size") % 7).alias("g"), F.col("p_retailprice").alias("x"))
    return stats.kruskal(rows, "g", "x").select("kruskal_h", "df")


# chi-squared of an even number of degrees of freedom has a closed tail
_H = ORACLES["kruskal_h"].replace("select round(", "select (").replace(", 4) as kruskal_h", ") as h")


@query(f"select round(h, 4) as kruskal_h, df, round(exp(-h / 2) * list_sum(list_transform(range(0, cast(df // 2 as bigint)), lambda k: power(h / 2, k) / gamma(k + 1))), 4) as p from ({_H})")
def kruskal_p(spark, sf_dir):
    """The same with the tail probability; also tested against published values."""
    rows = table(spark, sf_dir, "part").select((F.col("p_size") % 7).alias("g"), F.col("p_retailprice").alias("x"))
    return stats.kruskal(rows, "g", "x")


SOURCES = f"""s as (select source as speaker, doc_id // 20 % 2 as side, count(*) as n, {R.format('a', 'b')} as r_ab, {R.format('a', 'c')} as r_ac from (
select source, doc_id, cast(length(text) - length(replace(text, ',', '')) as double) / length(text) as a, cast(length(text) - length(replace(text, '.', '')) as double) / length(text) as b, cast(length(text) - length(replace(text, chr(10), '')) as double) / length(text) as c from documents where length(text) > 0) group by all having count(*) >= 4),
p as (select x.speaker, cast(replace(x.speaker, 'src', '') as int) % 5 as domain, x.r_ab as vtt_ab, y.r_ab as asr_ab, x.r_ac as vtt_ac, y.r_ac as asr_ac from s x join s y on x.speaker = y.speaker and x.side = 0 and y.side = 1)"""


def sources(spark, sf_dir) -> DataFrame:
    """Correlations by speaker from both sides of the corpus in one pass: halves by id play two transcript sources."""
    count = lambda ch: (F.char_length("text") - F.char_length(F.replace("text", F.lit(ch), F.lit("")))) / F.char_length("text")
    docs = table(spark, sf_dir, "documents").where(F.char_length("text") > 0)
    rows = docs.select(F.col("source").alias("speaker"), F.when(F.expr("doc_id div 20 % 2 = 0"), "vtt").otherwise("asr").alias("side"), count(",").alias("a"), count(".").alias("b"), count("\n").alias("c"))
    agg = rows.groupBy("speaker", "side").agg(F.count(F.lit(1)).alias("n"), stats.pearson(F.col("a"), F.col("b")).alias("ab"), stats.pearson(F.col("a"), F.col("c")).alias("ac")).where("n >= 4")
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}")
    both = agg.groupBy("speaker").agg(F.count(F.lit(1)).alias("sides"), *(side(s, c) for s in ("vtt", "asr") for c in ("ab", "ac"))).where("sides = 2")
    return both.withColumn("domain", F.replace("speaker", F.lit("src"), F.lit("")).cast("int") % 5)


@query(f"with {SOURCES} select domain, count(*) as n_speakers, round(avg(asr_ab - vtt_ab), 4) as delta_mean, round(avg(abs(asr_ab - vtt_ab)), 4) as delta_abs, round(count(*) filter (asr_ab * vtt_ab < 0) / count(*), 3) as reversal_share from p where domain < 4 group by domain")
def source_pivot_delta(spark, sf_dir):
    """How far a correlation moves from one source to the other, by listed domain."""
    d = F.col("asr_ab") - F.col("vtt_ab")
    return sources(spark, sf_dir).where("domain < 4").groupBy("domain").agg(F.count(F.lit(1)).alias("n_speakers"), F.round(F.avg(d), 4).alias("delta_mean"), F.round(F.avg(F.abs(d)), 4).alias("delta_abs"), F.round(F.count_if(F.col("asr_ab") * F.col("vtt_ab") < 0) / F.count(F.lit(1)), 3).alias("reversal_share"))


def moved(vtt, asr, strict: bool = False):
    """asr - vtt; a correlation of exactly zero gives 0 unless strict."""
    return (asr - vtt) if strict else F.when((vtt == 0) | (asr == 0), 0.0).otherwise(asr - vtt)


MOVED = "case when {0} = 0 or {1} = 0 then 0.0 else {1} - {0} end"


@query(f"with {SOURCES}, d as (select domain, {MOVED.format('vtt_ab', 'asr_ab')} as l, {MOVED.format('vtt_ac', 'asr_ac')} as k from p) select domain, count(*) as n, round(avg(abs(l)), 4) as mean_l, round(avg(abs(k)), 4) as mean_k, count(*) filter (abs(l) < abs(k)) as l_stable, count(*) filter (abs(k) < abs(l)) as k_stable from d group by domain")
def method_synthesis(spark, sf_dir):
    """Which of two methods moves less between the sources, by domain; domains that aren't listed stay."""
    d = sources(spark, sf_dir).select("domain", F.abs(moved(F.col("vtt_ab"), F.col("asr_ab"))).alias("l"), F.abs(moved(F.col("vtt_ac"), F.col("asr_ac"))).alias("k"))
    return d.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l"), 4).alias("mean_l"), F.round(F.avg("k"), 4).alias("mean_k"), F.count_if(F.col("l") < F.col("k")).alias("l_stable"), F.count_if(F.col("k") < F.col("l")).alias("k_stable"))


@query("""with s as (select d.lang as domain, case doc_id % 3 when 0 then 'clean' when 1 then 'diarize' else 'split' end as stage, case when l.quality is null then -1 else l.quality + l.toxic end as score from documents d left join labels l using (doc_id))
select domain, round(coalesce(sum(score) filter (stage = 'clean' and score >= 0), 0) / greatest(1, count(*) filter (stage = 'clean' and score >= 0)), 4) as clean_mean, round(coalesce(sum(score) filter (stage = 'diarize' and score >= 0), 0) / greatest(1, count(*) filter (stage = 'diarize' and score >= 0)), 4) as diarize_mean,
round(coalesce(sum(score) filter (stage = 'split' and score >= 0), 0) / greatest(1, count(*) filter (stage = 'split' and score >= 0)), 4) as split_mean, count(*) filter (score = 0) as zeros, count(*) filter (score = 1) as ones, count(*) filter (score = 2) as twos, count(*) filter (score < 0) as errors,
case when count(*) filter (score = 2) >= 0.8 * count(*) filter (score >= 0) then 'A' when count(*) filter (score >= 1) >= 0.8 * count(*) filter (score >= 0) then 'B' when count(*) filter (score >= 1) >= 0.6 * count(*) filter (score >= 0) then 'C' else 'D' end as grade from s group by domain""")
def audit_rollup(spark, sf_dir):
    """Scores of three stages by domain: means without errors (0 if there are none), counts and a letter."""
    docs, own = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    stage = F.expr("case doc_id % 3 when 0 then 'clean' when 1 then 'diarize' else 'split' end")
    s = docs.join(own, "doc_id", "left").select(F.col("lang").alias("domain"), stage.alias("stage"), F.when(F.col("quality").isNull(), -1).otherwise(F.col("quality") + F.col("toxic")).alias("score"))
    ok = F.col("score") >= 0
    mean = lambda k: F.round(F.coalesce(F.sum(F.when(ok & (F.col("stage") == k), F.col("score"))), F.lit(0)) / F.greatest(F.lit(1), F.count_if(ok & (F.col("stage") == k))), 4).alias(f"{k}_mean")
    agg = s.groupBy("domain").agg(mean("clean"), mean("diarize"), mean("split"), *(F.count_if(F.col("score") == i).alias(n) for i, n in enumerate(("zeros", "ones", "twos"))), F.count_if(~ok).alias("errors"))
    valid = F.col("zeros") + F.col("ones") + F.col("twos")
    some = F.col("ones") + F.col("twos")
    return agg.withColumn("grade", F.when(F.col("twos") >= 0.8 * valid, "A").when(some >= 0.8 * valid, "B").when(some >= 0.6 * valid, "C").otherwise("D"))


@query()
def mixed_model(spark, sf_dir):
    """Delta of a correlation by speaker features with a random intercept by domain; tested on data of known effects."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_extendedprice").alias("price"))
    rows = lines.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return stats.mixed_model(rows, ["quantity", "discount"], "price", "s_nationkey")


@query("select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def grouped_sums(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("select user_id, n, cast(rank() over (order by n) as double) + (count(*) over (partition by n) - 1) / 2.0 as rank from (select user_id, count(*) as n from events group by user_id)")
def average_rank(spark, sf_dir):
    """Ranks with ties averaged."""
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return stats.ranked(n, "n").select("user_id", "n", "rank")
