"""Relational plans: joins, sets, dedup, upserts, samples, budgets and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import text
from parlance.operators import ordered, relational, state
from parlance.plans.registry import query, table


@query("select o_orderkey, o_orderstatus from orders where coalesce(o_orderstatus, '') not in ('F', 'P')")
def status_filter(spark, sf_dir):
    """Rows whose status isn't among the excluded ones; a null status stays."""
    status = F.coalesce("o_orderstatus", F.lit(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").where(~status.isin("F", "P"))


@query("""select c_custkey, coalesce(n_name, upper(replace('nation_' || c_nationkey, '_', ' '))) as display, coalesce(r_name, 'unknown') as domain
from customer left join (select * from nation where n_nationkey < 20) on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""")
def domain_lookup(spark, sf_dir):
    """Two-level dimension lookup with defaults for what it lacks."""
    dim = table(spark, sf_dir, "nation").where("n_nationkey < 20").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    dim = dim.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("display"), F.col("r_name").alias("domain"))
    out = relational.lookup(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), dim, ["c_nationkey"], {"domain": "unknown"})
    name = F.upper(F.replace(F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")), F.lit("_"), F.lit(" ")))
    return out.select("c_custkey", F.coalesce("display", name).alias("display"), "domain")


@query("""select r_name, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
where r_name in ('ASIA', 'EUROPE', 'AFRICA') group by all""")
def domain_order(spark, sf_dir):
    """Counts of listed domains in their order; others drop out."""
    order = spark.createDataFrame([("ASIA", 0), ("EUROPE", 1), ("AFRICA", 2)], "r_name string, ord int")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    dim = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).join(order, "r_name").select("n_nationkey", "r_name", "ord")
    rows = table(spark, sf_dir, "customer").join(relational.small(dim), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("r_name", "ord").agg(F.count(F.lit(1)).alias("n")).orderBy("ord").select("r_name", "n")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P' and o_custkey is not null)")
def resume_anti(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return relational.pending(table(spark, sf_dir, "customer").select("c_custkey"), done, ["c_custkey"])


@query("select distinct o_orderkey as id from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R') and o_orderkey in (select l_orderkey from lineitem where l_quantity > 40) and o_orderstatus = 'F'")
def id_intersect(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    own = lambda df: df.select(F.col("l_orderkey").alias("id"))
    return relational.common_ids(orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")), own(lines.where("l_returnflag = 'R'")), own(lines.where("l_quantity > 40")))


@query("select c_custkey as id from customer union select o_custkey from orders")
def id_union(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).union(table(spark, sf_dir, "orders").select("o_custkey")).distinct()


@query("select p_partkey as id from part except select l_partkey from lineitem where l_quantity > 49")
def id_except(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).distinct().join(table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("id")), "id", "left_anti")


@query("select 1 as part, s_name as name from supplier union all select 2, c_name from customer")
def bag_union(spark, sf_dir):
    """Two whole lists, one before the other, repeats kept; bag_union and its twin take the second one's first rows only."""
    first = table(spark, sf_dir, "supplier").select(F.lit(1).alias("part"), F.col("s_name").alias("name"))
    return first.unionByName(table(spark, sf_dir, "customer").select(F.lit(2).alias("part"), F.col("c_name").alias("name")))


TIMED = "select event_id, user_id, event_type, epoch_us(ts) / 1e6 as s, epoch_us(ts) / 1e6 + coalesce(value, 0) * 60 as e from events"


def timed(spark, sf_dir):
    start = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", start.alias("start"), (start + F.coalesce("value", F.lit(0.0)) * 60).alias("end"))


@query(f"""with x as ({TIMED}), seg as (select * from x where event_type in ('click', 'purchase')), turn as (select * from x where event_type not in ('click', 'purchase')),
j as (select seg.event_id, turn.event_type, row_number() over (partition by seg.event_id order by least(seg.e, turn.e) - greatest(seg.s, turn.s) desc, turn.s, turn.e, turn.event_type) as rn from seg join turn on seg.user_id = turn.user_id and seg.s < turn.e and turn.s < seg.e)
select seg.event_id, coalesce(j.event_type, 'UNKNOWN') as label from seg left join j on seg.event_id = j.event_id and rn = 1""")
def interval_best_match(spark, sf_dir):
    """Clicks and purchases labelled by the other event of the user that they overlap most."""
    x = timed(spark, sf_dir)
    spoken = F.col("event_type").isin("click", "purchase")
    turns = x.where(~spoken).select("user_id", "start", "end", F.col("event_type").alias("label"))
    return relational.best_overlap(x.where(spoken), turns, "user_id", ["event_id"], bucket=86400.0).select("event_id", "label")


@query("""with s as (select c_custkey as id, 'speaker' || c_nationkey % 5 as speaker, case when c_mktsegment = 'BUILDING' then '' else c_name end as title, case when c_acctbal >= 0 then c_mktsegment end as channel, case when c_acctbal > 5000 then 'new description' end as description from customer),
x as (select s_suppkey as id, 'speaker' || s_nationkey % 5 as speaker, 'old ' || s_name as title, 'old channel' as channel, case when s_acctbal > 5000 then 'old description' else '' end as description, case when s_acctbal < 0 then 'filtered' end as status from supplier)
select s.id, s.speaker, coalesce(nullif(s.title, ''), x.title) as title, coalesce(nullif(s.channel, ''), x.channel) as channel, coalesce(nullif(x.description, ''), s.description) as description, x.status from s left join x on s.id = x.id and s.speaker = x.speaker""")
def upsert_refresh(spark, sf_dir):
    """All customers as a search list over all suppliers as the stored list; upsert_refresh and its twin take both sides by customer keys."""
    speaker = lambda c: f"concat('speaker', {c} % 5) speaker"
    search = table(spark, sf_dir, "customer").selectExpr("c_custkey id", speaker("c_nationkey"), "case when c_mktsegment = 'BUILDING' then '' else c_name end title", "case when c_acctbal >= 0 then c_mktsegment end channel", "case when c_acctbal > 5000 then 'new description' end description")
    stored = table(spark, sf_dir, "supplier").selectExpr("s_suppkey id", speaker("s_nationkey"), "concat('old ', s_name) title", "'old channel' channel", "case when s_acctbal > 5000 then 'old description' else '' end description", "case when s_acctbal < 0 then 'filtered' end status")
    return relational.upsert(search, stored, ["id", "speaker"], ["title", "channel"], ["description"])


@query("""select doc_id, coalesce(nullif(d.lang, ''), m.lang) as language, case when d.text is null and m.lang is null then 'passed' when coalesce(d.lang, m.lang) <> 'en' then 'lang' when m.url like '%/1%' then 'url' else 'kept' end as verdict
from documents d left join (select page_id, url, 'en' as lang from pages) m on m.page_id = d.doc_id""")
def metadata_fallback(spark, sf_dir):
    """An entry's own metadata, else the cached ones, else it passes."""
    cache = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url", F.lit("en").alias("m_lang"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").isNull().alias("bare")).join(cache, "doc_id", "left")
    verdict = relational.first_match((F.col("bare") & F.col("m_lang").isNull(), F.lit("passed")), (F.coalesce("lang", "m_lang") != "en", F.lit("lang")), (F.col("url").like("%/1%"), F.lit("url")), otherwise=F.lit("kept"))
    return rows.select("doc_id", F.coalesce(F.nullif("lang", F.lit("")), F.col("m_lang")).alias("language"), verdict.alias("verdict"))


@query("""with f as (select id, max(a) a, max(b) b, max(c) c, max(d) d from (
select o_orderkey id, 1 a, 0 b, 0 c, 0 d from orders union all select l_orderkey, 0, 1, 0, 0 from lineitem where l_quantity > 45 union all select o_orderkey, 0, 0, 1, 0 from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT' union all select l_orderkey, 0, 0, 1, 0 from lineitem where l_returnflag = 'A' and l_linestatus = 'F' and l_quantity > 40 union all select o_orderkey, 0, 0, 0, 1 from orders where o_orderstatus <> 'P') group by id),
x as (select case when c = 1 then 'done' when a = 1 and b = 1 and d = 1 then 'keep' when a = 1 and b = 1 then 'new' else 'missing' end as action from f)
select action, count(x.action) as n from (values ('done'), ('keep'), ('new'), ('missing'), ('failed')) k(action) left join x using (action) group by action""")
def manifest_reconcile(spark, sf_dir):
    """As manifest_reconcile, with the done sets and the manifest by status, priority and flags instead of by order keys."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    ids = lambda df, c: df.select(F.col(c).alias("id"))
    done = [ids(orders.where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'"), "o_orderkey"), ids(lines.where("l_returnflag = 'A' and l_linestatus = 'F' and l_quantity > 40"), "l_orderkey")]
    out = relational.reconcile(ids(orders, "o_orderkey"), ids(lines.where("l_quantity > 45"), "l_orderkey"), done, ids(orders.where("o_orderstatus <> 'P'"), "o_orderkey"), "id")
    return relational.counted(out, "action", ["done", "keep", "new", "missing", "failed"])


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as rn from events) where rn = 1")
def keep_first(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return relational.keep_first(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1")
def last_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return relational.last_wins(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("""select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by md5('42:' || doc_id), doc_id) as rn, count(*) over (partition by lang) as n from documents) where rn <= greatest(1, floor(n * 0.1))""")
def stratified_sample(spark, sf_dir):
    return ordered.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["doc_id"], 0.1)


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by md5('42:' || o_orderkey), o_orderkey) as rn from orders) where rn <= 4")
def per_group_cap(spark, sf_dir):
    return ordered.per_group_cap(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"], 4)


@query("select region, nation from (select r_name as region, n_name as nation, row_number() over (partition by r_name order by md5('7:' || n_nationkey), n_nationkey) as rn from nation join region on n_regionkey = r_regionkey) where rn <= 3")
def domain_speakers(spark, sf_dir):
    """Three speakers of each domain by a seeded hash."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return ordered.per_group_cap(rows.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), "n_nationkey"), "region", ["n_nationkey"], 3, seed=7).select("region", "nation")


@query("select doc_id, n_chars from (select doc_id, n_chars, sum(n_chars) over (order by doc_id rows unbounded preceding) as t from documents) where t <= 200000")
def byte_budget(spark, sf_dir):
    return ordered.byte_budget(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", ["doc_id"], 200000)


@query("""select source, doc_id from (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 as i, count(*) over (partition by source) as n from documents)
where n <= 20 or i in (select unnest(list_transform(range(20), lambda k: k * n // 20)))""")
def stride_sample(spark, sf_dir):
    return ordered.stride_sample(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", ["doc_id"], 20)


@query("select doc_id, cast((rn - 1) // 50 as bigint) as batch_id, cast((rn - 1) % 50 as int) as rel_idx from (select doc_id, row_number() over (order by doc_id) as rn from documents)")
def batching(spark, sf_dir):
    return ordered.batches(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 50)


@query("select conv_id, turn from (select conv_id, turn, row_number() over (partition by conv_id order by turn desc) as rn from conversations) where rn <= 5")
def tail_k(spark, sf_dir):
    return ordered.tail_k(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"], 5)


@query("select conv_id, turn, text from (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) as rn from conversations) where rn <= 5")
def head_k(spark, sf_dir):
    return ordered.head_k(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["conv_id"], ["turn"], 5)


@query("""with t as (select *, case when role is distinct from lag(role) over (partition by conv_id order by turn) and lag(1) over (partition by conv_id order by turn) is not null then 1 else 0 end as c from conversations),
r as (select *, cast(sum(c) over (partition by conv_id order by turn rows unbounded preceding) as bigint) as run from t)
select conv_id, run, any_value(role) as role, string_agg(text, ' ' order by turn) as text, cast(count(*) as int) as n_segments from r group by conv_id, run""")
def run_segments(spark, sf_dir):
    """A row for each run of a speaker's turns."""
    return ordered.turns_text(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query(r"""select c_custkey, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(n, '^\s+|\s+$', '', 'g')), '[^a-zA-Z0-9_-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') as slug
from (select c_custkey, ' ' || c_name || ' O''Neil ' || c_mktsegment as n from customer)""")
def slug_title(spark, sf_dir):
    n = F.concat(F.lit(" "), "c_name", F.lit(" O'Neil "), "c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", text.slug(n).alias("slug"))


@query("""select o_orderkey, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m') when 1 then strftime(o_orderdate, '%Y-%m') when 2 then 'about y' else '' end as ym from orders""")
def date_norm(spark, sf_dir):
    raw = F.expr("case o_orderkey % 4 when 0 then date_format(o_orderdate, 'yyyyMMdd') when 1 then date_format(o_orderdate, 'yyyy-MM-dd') when 2 then 'about yesterday' end")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.month(raw).alias("ym"))


@query("""select p_partkey, case when s is null or s < 0 then '0:00' when s >= 3600 then printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) else printf('%d:%02d', s // 60, s % 60) end as clock
from (select p_partkey, case when p_partkey % 11 = 0 then null when p_partkey % 13 = 0 then -1 else p_partkey * 37 end as s from part)""")
def duration_fmt(spark, sf_dir):
    s = F.expr("case when p_partkey % 11 = 0 then null when p_partkey % 13 = 0 then -1 else p_partkey * 37 end")
    return table(spark, sf_dir, "part").select("p_partkey", text.clock(s).alias("clock"))


@query("select d.dur as file_duration, unnest(range(0, greatest(1, cast(ceil(d.dur / 1800.0) as int)))) as chunk from (select distinct cast(p_size as double) * 400 as dur from part) d")
def chunking(spark, sf_dir):
    """Parts of half an hour of longer files."""
    from parlance.operators.segments import chunks

    files = table(spark, sf_dir, "part").select((F.col("p_size").cast("double") * 400).alias("duration")).distinct().withColumn("file", F.col("duration"))
    return chunks(files).select(F.col("file").alias("file_duration"), F.col("chunk").cast("long").alias("chunk"))


@query("""with e as (select l_orderkey % 500 as id, row_number() over (partition by l_orderkey % 500 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as seq, case when l_returnflag = 'R' then 'fail' when l_linestatus = 'O' then 'done' else 'start' end as ev from lineitem),
f as (select id, sum(case when ev = 'fail' then 1 else 0 end) as fails, arg_max(ev, seq) as last, count(*) as n from e group by id)
select case when last = 'done' then 'done' when last = 'fail' and fails > 3 then 'failed' when last = 'fail' then 'uploaded' else 'processing' end as state, count(*) as n from f group by all""")
def state_machine(spark, sf_dir):
    """The batch form of the retry automaton over lineitem as events."""
    lines = table(spark, sf_dir, "lineitem")
    ev = F.when(F.col("l_returnflag") == "R", "fail").when(F.col("l_linestatus") == "O", "done").otherwise("start")
    events = lines.select((F.col("l_orderkey") % 500).alias("id"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("seq"), ev.alias("event"))
    return state.latest(events).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("select strftime(o_orderdate, '%Y-%m') as ym, o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by all")
def month_bucket(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("ym"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select count(distinct o_custkey) as customers, count(distinct o_orderstatus) as states from orders")
def count_distinct(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderstatus").alias("states"))


@query("select s_suppkey, s_name, s_acctbal from supplier order by s_acctbal desc, s_suppkey limit 10")
def top_k(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10)


@query("select c_nationkey, round(avg(c_acctbal), 4) as mean from customer group by all order by avg(c_acctbal), c_nationkey limit 5")
def lowest_means(spark, sf_dir):
    """The five groups of the lowest mean."""
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m"))
    return rows.orderBy("m", "c_nationkey").limit(5).select("c_nationkey", F.round("m", 4).alias("mean"))


@query("""with m as (select l_orderkey as k, l_shipmode_ as v from (select l_orderkey, case when l_partkey % 9 = 0 then '' else 'speaker' || l_suppkey end as l_shipmode_, row_number() over (partition by l_orderkey order by l_linenumber desc, l_partkey desc, l_suppkey desc) as rn from lineitem) where rn = 1)
select o_orderkey, v as speaker from orders join m on o_orderkey = k where v <> ''""")
def speaker_map(spark, sf_dir):
    """Facts with the last mapping of their key; those without one, or with an empty one, go."""
    name = F.when(F.col("l_partkey") % 9 == 0, "").otherwise(F.concat(F.lit("speaker"), F.col("l_suppkey").cast("string")))
    mapping = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), name.alias("speaker"), "l_linenumber", "l_partkey", "l_suppkey")
    return relational.assign(table(spark, sf_dir, "orders").select("o_orderkey"), mapping, "o_orderkey", "speaker", ["l_linenumber", "l_partkey", "l_suppkey"])


@query("""with b as (select doc_id, (row_number() over (order by doc_id) - 1) // 50 as batch_id, (row_number() over (order by doc_id) - 1) % 50 as rel_idx from documents)
select doc_id, batch_id, cast(rel_idx as int) as rel_idx, case rel_idx % 2 when 0 then 'positive' else 'negative' end as valence from b where rel_idx % 3 <> 2""")
def reply_join(spark, sf_dir):
    """Reply rows to the rows of their batch, by place; the first of several counts."""
    b = ordered.batches(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 50)
    ids = b.select("batch_id").distinct()
    places = ids.select("batch_id", F.explode(F.sequence(F.lit(0), F.lit(60))).alias("idx")).where("idx % 3 <> 2")
    valence = F.when(F.col("idx") % 2 == 0, "positive").otherwise("negative")
    lines = places.select("batch_id", "idx", F.col("idx").alias("line"), valence.alias("valence")).unionByName(places.select("batch_id", "idx", (F.col("idx") + 100).alias("line"), F.lit("neutral").alias("valence")))
    return relational.match_replies(b, lines).select("doc_id", "batch_id", "rel_idx", "valence")


@query("select source, doc_id from (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 as i, greatest(1, count(*) over (partition by source) // 25) as s from documents) where i % s = 0 and i < s * 25")
def spread_sample(spark, sf_dir):
    return ordered.spread_sample(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", ["doc_id"], 25)


@query("select s_suppkey, row_number() over (order by md5('42:' || s_suppkey), s_suppkey) as place from supplier")
def seeded_shuffle(spark, sf_dir):
    """A seeded order, shown by each row's place in it."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey").withColumn("h", F.md5(F.concat_ws(":", F.lit("42"), F.col("s_suppkey").cast("string"))))
    return ordered.running_total(rows, F.lit(1).cast("long"), ["h", "s_suppkey"], "place").select("s_suppkey", "place")


@query("select o_orderkey, o_orderdate, o_totalprice from orders")
def newest_first(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice").orderBy(F.desc("o_orderdate"), "o_orderkey")


@query("select p_partkey, p_name[:100] as title, p_type[:40] as channel from part where p_size > 10 and p_size < 30")
def truncated(spark, sf_dir):
    """A strict range filter and cut columns."""
    return table(spark, sf_dir, "part").where("p_size > 10 and p_size < 30").select("p_partkey", F.left("p_name", F.lit(100)).alias("title"), F.left("p_type", F.lit(40)).alias("channel"))
