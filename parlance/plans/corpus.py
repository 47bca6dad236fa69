"""Corpus plans: sentences, lines, lexicon scores and readers of markup.

Documents play transcripts: doc_id the video, lang the domain, source the speaker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import evidence, lexicon, text
from parlance.operators import ordered, relational, stats
from parlance.plans.registry import query, table

# The same steps in DuckDB's SQL
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
SENTENCES = r"""sent as (
  select doc_id, lang, source, row_number() over (partition by doc_id order by i) - 1 as idx, s from (
    select doc_id, lang, source, generate_subscripts(p, 1) as i, regexp_replace(unnest(p), '^\s+|\s+$', '', 'g') as s from (
      select doc_id, lang, source, string_split(regexp_replace(text, '([.!?])\s+([A-Z"''(])', '\1' || chr(1) || '\2', 'g'), chr(1)) as p from documents))
  where s <> '')"""
WORDS = r"case when regexp_replace({0}, '^\s+|\s+$', '', 'g') = '' then 0 else len(string_split_regex(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\s+')) end"
CLEAN = r"regexp_replace(lower({0}), '[^a-z\s/-]', ' ', 'g')"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def count_sql(column: str, category: str) -> str:
    raw = " + ".join(f"len(regexp_extract_all({column}, {_quoted(p)}))" for p in lexicon.CATEGORIES[category])
    negated = lexicon.negated_categories()
    hits = {c: " + ".join(f"len(list_filter(regexp_extract_all({column}, {_quoted(p)}, 1), lambda w: w in ({', '.join(map(_quoted, ws))})))" for p in lexicon.NEGATIONS) for c, ws in negated.items() if ws}
    if category in hits:
        return f"greatest(0, {raw} - ({hits[category]}))"
    return raw + (" + " + " + ".join(hits.values()) if category == lexicon.NEGATED_INTO else "")


COUNTS = ", ".join(f"{count_sql('t', c)} as {lexicon.column_name(c)}" for c in lexicon.CATEGORIES)
POS = " + ".join(map(lexicon.column_name, lexicon.POSITIVE))
NEG = " + ".join(map(lexicon.column_name, lexicon.NEGATIVE))
LABELS = f"case when {POS} > {NEG} then 'positive' when {NEG} > 0 then 'negative' else 'neutral' end as valence, case when emphatic_certain > hedging_doubt then 'high' when hedging_doubt > 0 then 'low' else 'medium' end as certainty"
MODAL = "case certainty when 'high' then 'emphatic' when 'low' then 'hedged' else 'neutral' end"


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", F.posexplode(text.sentences(F.col("text"))).alias("idx", "s"))


def scored(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """`keep` columns, cleaned text and counts by category, each computed once."""
    clean = df.select(*keep, text.keyword_clean(F.col(column)).alias("t")).withColumn("hit", lexicon.any_hit(F.col("t")))
    return clean.select(*keep, "t", *(n.cast("long").alias(c) for c, n in lexicon.counts(F.col("t"), F.col("hit")).items()))


def labelled(df: DataFrame, column: str, *keep: str) -> DataFrame:
    rows = scored(df, column, *keep).select(*keep, lexicon.valence().alias("valence"), lexicon.certainty().alias("certainty"))
    return rows.withColumn("modality", lexicon.modality(F.col("certainty")))


@query(f"select doc_id, {WORDS.format('text')} as n_words from documents where {WORDS.format('text')} between 50 and 400")
def word_filter(spark, sf_dir):
    n = text.word_count(F.col("text")).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n_words")).where("n_words between 50 and 400")


@query(f"with {SENTENCES} select doc_id, idx, s as sentence, n_words from (select *, {WORDS.format('s')} as n_words from sent) where n_words between 6 and 80")
def sentence_split(spark, sf_dir):
    rows = sentences(spark, sf_dir).select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("s").alias("sentence"), text.word_count(F.col("s")).cast("long").alias("n_words"))
    return rows.where("n_words between 6 and 80")


@query(r"""with lines as (select doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) - 1 as sentence_index, unnest(string_split(text, chr(10))) as s from documents)
select doc_id as video_id, source as speaker, sentence_index, regexp_replace(s, '^\s+|\s+$', '', 'g') as sentence from lines where regexp_replace(s, '^\s+|\s+$', '', 'g') <> '' and source <> ''""")
def corpus_rows(spark, sf_dir):
    """A row for each line with text; its index counts blank lines too."""
    docs = table(spark, sf_dir, "documents").where("source <> ''")
    lines = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("i", "s"))
    return lines.select(F.col("doc_id").alias("video_id"), F.col("source").alias("speaker"), F.col("i").cast("long").alias("sentence_index"), text.strip(F.col("s")).alias("sentence")).where("sentence <> ''")


@query(f"with c as (select doc_id, {CLEAN.format('text')} as t from documents) select doc_id, length(t) as chars, {COUNTS} from c")
def keyword_clean_counts(spark, sf_dir):
    return scored(table(spark, sf_dir, "documents"), "text", "doc_id").withColumn("chars", F.char_length("t").cast("long")).drop("t")


def _fixture_sql(rows: list[tuple[int, str]]) -> str:
    return "(values " + ", ".join(f"({i}, {_quoted(t)})" for i, t in rows) + ") v(id, text)"


NEGATION_ROWS = [
    (1, "not strong"),
    (2, "not stable"),
    (3, "growth and no growth, a lack of progress"),
    (4, "better but worse"),
    (5, "deteriorate"),
    (6, "I think so, maybe"),
    (7, "of course it is always strong; never weak"),
    (8, "losing prosperity without progress is a severe crisis"),
    (9, "absence of growth, hardly healthy, barely successful"),
]


@query(f"with d as (select cast(doc_id as bigint) as id, text from documents union all select cast(-id as bigint), text from {_fixture_sql(NEGATION_ROWS)}), c as (select id, {CLEAN.format('text')} as t from d), n as (select id, {COUNTS} from c) select *, {LABELS} from n")
def lexicon_negation(spark, sf_dir):
    """All documents, and fixed sentences by their negated ids: a negated positive word leaves its category and counts as decline."""
    fixed = spark.createDataFrame([(-i, t) for i, t in NEGATION_ROWS], "id long, text string")
    df = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), "text").unionByName(fixed)
    return scored(df, "text", "id").drop("t").withColumns({"valence": lexicon.valence(), "certainty": lexicon.certainty()})


@query(f"with {SENTENCES}, c as (select doc_id, idx, {CLEAN.format('s')} as t from sent where {WORDS.format('s')} > 3), n as (select doc_id, idx, {COUNTS} from c) select doc_id, valence, certainty, count(*) as n from (select doc_id, {LABELS} from n) group by all")
def valence_certainty(spark, sf_dir):
    rows = sentences(spark, sf_dir).where(text.word_count(F.col("s")) > 3)
    return labelled(rows, "s", "doc_id").groupBy("doc_id", "valence", "certainty").agg(F.count(F.lit(1)).alias("n"))


DENSITY = " ,".join(f"round(({e}) / (length(t) / 30000.0), 4) as {n}" for n, e in (("neg_density", NEG), ("emph_density", "emphatic_certain"), ("hedge_density", "hedging_doubt")))


@query(f"with c as (select doc_id, {CLEAN.format('text')} as t from documents), n as (select doc_id, t, {COUNTS} from c where length(t) / 30000.0 >= 0.001) select doc_id, {DENSITY} from n")
def keyword_density(spark, sf_dir):
    rows = scored(table(spark, sf_dir, "documents"), "text", "doc_id").withColumn("chars", F.char_length("t")).where(F.col("chars") / 30000.0 >= 0.001)
    of = {"neg_density": lexicon.total(lexicon.NEGATIVE), "emph_density": F.col("emphatic_certain"), "hedge_density": F.col("hedging_doubt")}
    return rows.select("doc_id", *(F.round(lexicon.density(n, F.col("chars")), 4).alias(c) for c, n in of.items()))


@query(f"""with c as (select source, '2024-' || lpad(cast(doc_id % 12 + 1 as varchar), 2, '0') as ym, {CLEAN.format('text')} as t from documents), n as (select source, ym, length(t) as chars, {COUNTS} from c),
m as (select source, ym, sum(chars) as chars, count(*) as videos, sum({NEG}) as neg, sum(emphatic_certain) as emph, sum(hedging_doubt) as hedge, sum({POS}) as pos, sum(intensity_boosters) as boost from n group by all)
select source as speaker, ym, cast(chars as bigint) as chars, videos, {', '.join(f'round({c} / greatest(chars / cast(videos as double) / 30000.0, 0.001), 4) as {c}_norm' for c in ('neg', 'emph', 'hedge', 'pos'))} from m where neg + emph + hedge + pos + boost > 0""")
def monthly_density(spark, sf_dir):
    """Counts by speaker and month for an average text; months without any hit vanish."""
    docs = table(spark, sf_dir, "documents").withColumn("ym", F.concat(F.lit("2024-"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0")))
    rows = scored(docs, "text", "source", "ym")
    parts = {"neg": lexicon.total(lexicon.NEGATIVE), "emph": F.col("emphatic_certain"), "hedge": F.col("hedging_doubt"), "pos": lexicon.total(lexicon.POSITIVE), "boost": F.col("intensity_boosters")}
    agg = rows.groupBy(F.col("source").alias("speaker"), "ym").agg(F.sum(F.char_length("t")).cast("long").alias("chars"), F.count(F.lit(1)).alias("videos"), *(F.sum(n).alias(c) for c, n in parts.items()))
    norm = F.greatest(F.col("chars") / F.col("videos") / 30000.0, F.lit(0.001))
    return agg.where("neg + emph + hedge + pos + boost > 0").select("speaker", "ym", "chars", "videos", *(F.round(F.col(c) / norm, 4).alias(f"{c}_norm") for c in ("neg", "emph", "hedge", "pos")))


PAIRS = {"pos_emp": ("positive", "emphatic"), "pos_hed": ("positive", "hedged"), "neg_emp": ("negative", "emphatic"), "neg_hed": ("negative", "hedged")}


def phi_sql(rows: str, by: str, pairs: dict[str, tuple[str, str]], least: int) -> str:
    cells = ", ".join(f"count(*) filter ({a} and {b}) as {n}_n11, count(*) filter ({a} and not {b}) as {n}_n10, count(*) filter (not {a} and {b}) as {n}_n01, count(*) filter (not {a} and not {b}) as {n}_n00" for n, (a, b) in pairs.items())
    phi = lambda n: f"round(({n}_n11::double * {n}_n00 - {n}_n10::double * {n}_n01) / nullif(sqrt(({n}_n11 + {n}_n10)::double * ({n}_n01 + {n}_n00) * ({n}_n11 + {n}_n01) * ({n}_n10 + {n}_n00)), 0), 4) as {n}_phi"
    return f"select {by}, pooled, n, {', '.join(f'{n}_n11' for n in pairs)}, {', '.join(map(phi, pairs))} from (select {by}, cast(grouping({by}) as int) as pooled, count(*) as n, {cells} from {rows} group by rollup({by})) where pooled = 1 or n >= {least}"


@query(f"with {SENTENCES}, c as (select lang, {CLEAN.format('s')} as t from sent where {WORDS.format('s')} between 6 and 80), n as (select lang, {COUNTS} from c), l as (select lang, valence, {MODAL} as modality from (select lang, {LABELS} from n)) " + phi_sql("l", "lang", {n: (f"(valence = '{a}')", f"(modality = '{b}')") for n, (a, b) in PAIRS.items()}, 10))
def lexicon_phi(spark, sf_dir):
    """The flagship: sentences, lexicon labels, and phi of both axes by language and over all, in one pass."""
    rows = sentences(spark, sf_dir).where(text.word_count(F.col("s")).between(6, 80))
    rows = labelled(rows, "s", "lang")
    return stats.phi_table(rows, "lang", {n: (F.col("valence") == a, F.col("modality") == b) for n, (a, b) in PAIRS.items()})


RULE_SQL = "case " + " ".join(f"when regexp_matches(trim(d), {_quoted(p)}) then '{n}'" for n, p in evidence.DESCRIPTION_RULES.items()) + " when lower(l) in (" + ", ".join(map(_quoted, evidence.OTHER_LANGUAGES)) + ") then 'lang:' || lower(l) else '' end"
_DESCRIPTIONS = ["A mini documentary on power", "The biography of a king", "A lightning rod for conspiracy", "From rags to riches", "A book about the treasury: the Fed and its chair", "An interview", ""]


@query(f"select doc_id, {RULE_SQL} as reason from (select doc_id, lang as l, text as d from documents)")
def rule_classifier(spark, sf_dir):
    """The first description rule that holds for a document's own, whole text, else the language."""
    return table(spark, sf_dir, "documents").select("doc_id", evidence.exclusion(F.col("text"), F.col("lang")).alias("reason"))


@query(f"with {SENTENCES}, h as (select case when w <= 5 then '1-5' when w <= 15 then '6-15' when w <= 30 then '16-30' when w <= 60 then '31-60' when w <= 100 then '61-100' else '101+' end as bucket from (select {WORDS.format('s')} as w from sent)) select bucket, count(*) as n from h group by all")
def histogram(spark, sf_dir):
    """Sentences by length; empty buckets don't show."""
    w = sentences(spark, sf_dir).select(text.word_count(F.col("s")).alias("w"))
    limits = [(5, "1-5"), (15, "6-15"), (30, "16-30"), (60, "31-60"), (100, "61-100")]
    return w.select(relational.first_match(*((F.col("w") <= k, F.lit(b)) for k, b in limits), otherwise=F.lit("101+")).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {SENTENCES} select lang, count(*) as sentences, count(*) filter ({WORDS.format('s')} >= 61) as still_long from sent group by all")
def long_sentences(spark, sf_dir):
    rows = sentences(spark, sf_dir).select("lang", text.word_count(F.col("s")).alias("w"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("sentences"), F.count_if(F.col("w") >= 61).alias("still_long"))


@query("""with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as idx, unnest(string_split(text, chr(10))) as line from documents),
n as (select doc_id, idx, case when idx % 3 = 0 and length(line) > 40 and doc_id % 2 = 0 then [line[:20], line[21:]] when idx % 3 = 0 and length(line) > 40 then ['changed since'] else null end as new, case when doc_id % 2 = 0 then line else 'other' end as old, line from l),
r as (select doc_id, idx, case when new is not null and old = line then new else [line] end as new from n),
x as (select doc_id, idx, generate_subscripts(new, 1) as j, unnest(new) as line from r)
select doc_id, row_number() over (partition by doc_id order by idx, j) - 1 as idx, line from x""")
def positional_replace(spark, sf_dir):
    """Long lines split in place, unless the line has changed since; the rest moves down."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    long_ = lines.where("idx % 3 = 0 and char_length(line) > 40")
    split = F.array(F.substring("line", 1, 20), F.expr("substring(line, 21)"))
    changes = long_.select("doc_id", "idx", F.when(F.col("doc_id") % 2 == 0, F.col("line")).otherwise("other").alias("line"), F.when(F.col("doc_id") % 2 == 0, split).otherwise(F.array(F.lit("changed since"))).alias("new"))
    return relational.replace_lines(lines, changes, "doc_id", "idx", "line").withColumn("idx", F.col("idx").cast("long"))


_LAST = r"""regexp_replace(lower(regexp_extract(now, '(\S+)\s*$', 1)), '^[.,!?;:''"()\[\]-]+|[.,!?;:''"()\[\]-]+$', '', 'g')"""
_LOWER = rf"regexp_matches(ltrim(line), {_quoted(ordered._CONTINUES)})"
_BOUNDARY = rf"(not regexp_matches(lower(now), '(?:{'|'.join(a.replace('.', chr(92) + '.') for a in dict.fromkeys(ordered.ABBREVIATIONS))})$') and regexp_matches(now, {_quoted(ordered._ENDS)}))"
_JOINS = rf"(regexp_matches(now, '(,|[-–—]+)$') or {_LAST} in ({', '.join(map(_quoted, ordered.FUNCTION_WORDS))}) or {_LOWER} or len(string_split_regex(trim(now), '\s+')) <= 3 and not regexp_matches(now, '[.!?…]$'))"


@query(rf"""with recursive d as (select doc_id, string_split(text, chr(10)) as lines, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\s+$', '')), lambda x: trim(x) <> '') as l from documents),
f as (select doc_id, 0 as i, cast([] as varchar[]) as done, cast(null as varchar) as now from d union all
select doc_id, i + 1, case when now is null or more then done else list_append(done, now) end, case when now is null or not more then line when regexp_matches(now, '[-–—]$') then now || line else now || ' ' || line end
from (select *, now is not null and not ({_BOUNDARY} and not {_LOWER}) and {_JOINS} as more from (select f.doc_id, f.i, f.done, f.now, d.l[f.i + 1] as line, len(d.l) as n from f join d using (doc_id)) where i < n)),
e as (select doc_id, case when now is null then done else list_append(done, now) end as folded from f join d using (doc_id) where i = len(d.l))
select doc_id, len(lines) as n_lines, len(folded) as n_folded, array_to_string(folded, chr(10)) as text from d join e using (doc_id)""")
def line_fold(spark, sf_dir):
    """Broken lines joined again; also tested on fixed lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    return docs.select("doc_id", F.size("lines").alias("n_lines"), ordered.folded(F.col("lines")).alias("folded")).select("doc_id", "n_lines", F.size("folded").alias("n_folded"), F.array_join("folded", "\n").alias("text"))


@query(r"""with p as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda x: x <> '') as l from documents)
select doc_id, len(l) as n_lines, len(list_filter(l, lambda x, i: i = 1 or x <> l[i - 1])) as n_kept from p""")
def consecutive_dedup(spark, sf_dir):
    lines = F.filter(F.transform(F.split("text", "\n"), text.squeeze), lambda x: x != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", lines.alias("l"))
    return rows.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.size(ordered.dedup_consecutive(F.col("l"))).cast("long").alias("n_kept"))


@query(r"""with l as (select page_id, list_filter(list_transform(string_split(html, chr(10)), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda x: x <> '') as l from pages),
k as (select page_id, list_filter(l, lambda x, i: i = 1 or x <> l[i - 1]) as k from l) select page_id, len(k) as n_lines, array_to_string(k, ' ') as text from k""")
def markup_strip(spark, sf_dir):
    """Tags off each line, blank lines and lines equal to the one before dropped."""
    lines = F.filter(F.transform(F.split("html", "\n"), lambda x: text.squeeze(F.regexp_replace(x, "<[^>]+>", ""))), lambda x: x != "")
    rows = table(spark, sf_dir, "pages").select("page_id", lines.alias("l")).select("page_id", ordered.dedup_consecutive(F.col("l")).alias("k"))
    return rows.select("page_id", F.size("k").cast("long").alias("n_lines"), F.array_join("k", " ").alias("text"))


@query(f"select lang, cast(sum(w) as bigint) as total_words, round(avg(w), 4) as mean_words, round(median(w), 4) as median_words, round(sum(w) / 150.0, 4) as minutes, round(sum(w) / 150.0 * 0.015, 4) as hosted_cost, round(sum(w) / 150.0 / 90.0 / 60.0 * 0.35 * 0.24, 6) as local_cost from (select lang, {WORDS.format('text')} as w from documents) group by lang")
def cost_model(spark, sf_dir):
    """Words at 150 a minute; hosted at 0.015 a minute, or 350 W at 0.24 a kWh and 90 times real time."""
    rows = table(spark, sf_dir, "documents").select("lang", text.word_count(F.col("text")).alias("w"))
    agg = rows.groupBy("lang").agg(F.sum("w").alias("total_words"), F.round(F.avg("w"), 4).alias("mean_words"), F.round(F.median("w"), 4).alias("median_words"))
    minutes = F.col("total_words") / 150.0
    return agg.withColumns({"minutes": F.round(minutes, 4), "hosted_cost": F.round(minutes * 0.015, 4), "local_cost": F.round(minutes / 90.0 / 60.0 * 0.35 * 0.24, 6)})


@query(r"""with a as (select doc_id, 'Welcome to the show. ' || text as t, regexp_replace(text[12:], '^\s+|\s+$', '', 'g') as c from documents where length(text) > 200),
p as (select doc_id, lower(t) as t, list_transform([120, 80, 50, 30], lambda n: strpos(lower(t), lower(regexp_replace(c[:n], '(?s) [^ ]*$', '')))) as f, list_filter(string_split_regex(c[:200], '\s+'), lambda w: length(w) > 5 and lower(w) not in ('there', 'their', 'these', 'those', 'about', 'which', 'would', 'could', 'should')) as w from a),
q as (select doc_id, t, list_filter(f, lambda i: i > 0) as f, list_filter(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: strpos(t, lower(array_to_string(w[i:i + 2], ' ')))), lambda i: i > 0) as g from p)
select doc_id, cast(coalesce(f[1] - 1, g[1] - 1, length(t) // 3) as int) as at from q""")
def text_alignment(spark, sf_dir):
    """Where a cleaned text begins in its transcript."""
    docs = table(spark, sf_dir, "documents").where(F.char_length("text") > 200)
    rows = docs.select("doc_id", F.concat(F.lit("Welcome to the show. "), "text").alias("t"), F.expr("substring(text, 12)").alias("c"))
    return rows.select("doc_id", text.alignment(F.col("t"), F.col("c")).alias("at"))


@query("select item_id, trim(regexp_replace(t[greatest(1, strpos(t, n) - 130):strpos(t, n) + length(n) + 129], '\\s+', ' ', 'g')) as excerpt, 'Item ' || item_id || ': ' || n as prompt from (select item_id, text as t, text[60:70] as n from benchmark)")
def excerpts(spark, sf_dir):
    """Text around a needle, and a filled template."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("t"), F.substring("text", 60, 11).alias("n"))
    return rows.select("item_id", text.excerpt(F.col("t"), F.col("n")).alias("excerpt"), text.filled("Item {id}: {needle}", {"id": F.col("item_id"), "needle": F.col("n")}).alias("prompt"))


@query(f"with {SENTENCES} select doc_id, idx, {WORDS.format('s')} as n_words from sent where {WORDS.format('s')} >= 61")
def long_addresses(spark, sf_dir):
    """Where the sentences of 61 words or more stand."""
    rows = sentences(spark, sf_dir).select("doc_id", F.col("idx").cast("long").alias("idx"), text.word_count(F.col("s")).cast("long").alias("n_words"))
    return rows.where("n_words >= 61")
