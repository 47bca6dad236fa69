"""Review plans: records and grade items of the format votes, status filters, reports, distributions and dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import evidence, replies
from parlance.operators import annotate, relational, segments as seg, state
from parlance.plans import quality, statistics  # noqa: F401  the twins below build on theirs
from parlance.plans.corpus import WORDS, _quoted
from parlance.plans.registry import ORACLES, query, table
from parlance.sources import dimensions, files

_T = "lower(case page_id % 6 " + " ".join(f"when {i} then {_quoted(t)}" for i, t in enumerate(quality._TITLES)) + " end)"
_D = "lower(case page_id % 5 when 0 then '' when 1 then 'Ada Lovelace sits down with us' when 2 then 'A documentary' when 3 then 'A panel' else 'Thoughts of Ada Lovelace' end)"
_W = WORDS.format("html")
_ASKED = "(length(html) - length(replace(html, '?', '')))"
_HEARD = "(contains(lower(html), 'ada') or contains(lower(html), 'lovelace'))"
_NAMED = "(contains(t, 'ada lovelace') or contains(t, 'lovelace'))"


def _why(*named: tuple[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"case when {test} then '{name}' end" for test, name in named) + "], lambda k: k is not null), ';')"


def _also(why: str, *rules: tuple[str, str]) -> str:
    return f"concat_ws(';', nullif({why}, ''), case " + " ".join(f"when {test} then {more}" for test, more in rules) + " end)"


_INTERVIEW, _DOC, _PANEL = (quality._any("t", x) for x in (evidence.TITLE_INTERVIEW, evidence.TITLE_DOCUMENTARY, evidence.TITLE_PANEL))
_DOUBTFUL = "(" + " or ".join(f"regexp_matches(t, {_quoted(p)})" for p in evidence.TITLE_DOUBTFUL) + ")"
_TALK, _FILM, _TABLE = (quality._any("d", x) for x in (evidence.TEXT_INTERVIEW, evidence.TEXT_DOCUMENTARY, evidence.TEXT_PANEL))
_ABOUT = "contains(d, 'ada lovelace')"
WHY_TITLE = _also(_why((_NAMED, "speaker_in_title"), (_INTERVIEW, "interview_keyword"), (_DOC, "doc_keyword"), (_PANEL, "panel_keyword"), (_DOUBTFUL, "low_conf_pattern")), (f"not {_NAMED}", "'no_speaker_in_title'"))
WHY_DESCRIPTION = _also(_why((_ABOUT, "speaker_in_desc"), (_TALK, "interview_in_desc"), (_FILM, "doc_in_desc"), (_TABLE, "panel_in_desc")), (f"d = '' or ({_FILM} and not {_TALK})", "null"), (f"{_TALK} and {_ABOUT}", "'desc_confirms_interview'"))
_RATIO = "(2000 * asked + n) // greatest(2 * n, 1)"
_LENGTHS = [("n < 200", "vtt_too_short"), ("n < 500", "vtt_short"), ("q > 0.003 and h", "dialogue_with_speaker"), ("q > 0.003", "dialogue_detected"), ("n > 2000 and h", "long_monologue"), ("n > 5000", "long_vtt_no_dialogue"), ("true", "unclear_format")]
WHY_TRANSCRIPT = f"case when html = '' then '' else concat_ws(';', 'vtt_' || n || 'w', 'q_ratio=' || ({_RATIO}) // 1000 || '.' || lpad(cast(({_RATIO}) % 1000 as varchar), 3, '0'), case when h then 'speaker_in_vtt' end, case " + " ".join(f"when {a} then '{b}'" for a, b in _LENGTHS) + " end) end"
REVIEW = "confidence = 'low' or round_even(mean_vote, 1) < 3 and confidence <> 'high'"
RECORDS = f"""with p as ({ORACLES["tsp_predict"]}),
w as (select page_id, {_T} as t, {_D} as d, html, {_W} as n, {_ASKED} as asked, {_ASKED} / greatest({_W}, 1) as q, {_HEARD} as h from pages),
y as (select page_id, {WHY_TITLE} as why_title, {WHY_DESCRIPTION} as why_description, {WHY_TRANSCRIPT} as why_transcript, n as vtt_words from w),
z as (select page_id, round_even(mean_vote, 1) as tsp, confidence, {REVIEW} as needs_review, why_title, why_description, why_transcript, vtt_words from p join y using (page_id))"""


def _records(spark, sf_dir):
    title = F.element_at(F.array(*map(F.lit, quality._TITLES)), (F.col("page_id") % 6 + 1).cast("int"))
    d = F.expr("case page_id % 5 when 0 then '' when 1 then 'Ada Lovelace sits down with us' when 2 then 'A documentary' when 3 then 'A panel' else 'Thoughts of Ada Lovelace' end")
    name, html = F.lit("ada lovelace"), F.coalesce("html", F.lit(""))
    votes = {"vt": evidence.vote_title(title, name), "vd": evidence.vote_description(d, name), "vx": evidence.vote_transcript(F.col("html"), name)}
    rows = table(spark, sf_dir, "pages").select("page_id", *(v.alias(k) for k, v in votes.items()), F.regexp_count(html, F.lit(r"\S+")).cast("long").alias("vtt_words"))
    out = evidence.combined(F.col("vt"), F.col("vd"), F.col("vx"))
    rows = rows.withColumns({"tsp": out["tsp"], "confidence": out["confidence"]})
    return rows.withColumn("needs_review", (F.col("confidence") == "low") | (F.col("tsp") < 3) & (F.col("confidence") != "high"))


@query(RECORDS + " select * from z")
def tsp_records(spark, sf_dir):
    """Predictions with the reasons of each vote and the transcript's length: lowest first, those to review before others, short transcripts first."""
    rows = _records(spark, sf_dir)
    why = lambda c: F.array_join(f"{c}.reasons", ";")
    out = rows.select("page_id", "tsp", "confidence", "needs_review", why("vt").alias("why_title"), why("vd").alias("why_description"), why("vx").alias("why_transcript"), "vtt_words")
    return out.orderBy("tsp", F.desc("needs_review"), "vtt_words", "page_id")


@query(RECORDS + " select page_id, tsp, confidence, needs_review, greatest(0, least(4, cast(round_even(tsp, 0) as int) - 1)) as grade_hint, vtt_words from z")
def tsp_review(spark, sf_dir):
    """What a person should look at: the same order."""
    return tsp_records(spark, sf_dir).select("page_id", "tsp", "confidence", "needs_review", evidence.grade_hint(F.col("tsp")).alias("grade_hint"), "vtt_words")


@query(RECORDS + " select page_id as video_id, cast(round_even(tsp, 0) as int) as grade, greatest(0, least(4, cast(round_even(tsp, 0) as int) - 1)) as grade_hint, confidence, needs_review, concat_ws(';', nullif(why_title, ''), nullif(why_transcript, '')) as reasons from z")
def tsp_grade_items(spark, sf_dir):
    """The second projection of the same records, for the grading tool: reasons of title and transcript."""
    rows = _records(spark, sf_dir)
    out = rows.select(F.col("page_id").alias("video_id"), F.bround("tsp", 0).cast("int").alias("grade"), evidence.grade_hint(F.col("tsp")).alias("grade_hint"), "confidence", "needs_review", F.array_join(F.concat("vt.reasons", "vx.reasons"), ";").alias("reasons"), "tsp", "vtt_words")
    return out.orderBy("tsp", F.desc("needs_review"), "vtt_words", "video_id").drop("tsp", "vtt_words")


_STATUS = "case when o_totalprice < 50000 then 'unavailable' when o_totalprice < 90000 then 'no_captions' when o_totalprice < 130000 then 'audio_failed' when o_totalprice < 170000 then 'filtered' end"
_AUDIO = "select l_orderkey from lineitem where l_returnflag = 'R'"
_STAGES = {"captions": ("unavailable", "no_captions", "audio_failed", "filtered"), "rules": ("unavailable", "no_captions", "filtered"), "selection": ("unavailable", "no_captions", "audio_failed", "filtered")}


@query(" union all ".join(f"select '{k}' as stage, o_orderkey as id from (select o_orderkey, {_STATUS} as status from orders) where coalesce(status, '') not in ({', '.join(map(_quoted, v))})" + (f" and o_orderkey not in ({_AUDIO})" if k == "selection" else "") for k, v in _STAGES.items()))
def status_stages(spark, sf_dir):
    """What each stage still has to do: captions and selection leave out four statuses, the rules three; selection also leaves out what has audio."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_STATUS).alias("status"))
    audio = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    out = None
    for stage in state.EXCLUDED:
        one = state.open_for(rows, stage, audio if stage == "selection" else None).select(F.lit(stage).alias("stage"), "id")
        out = one if out is None else out.unionByName(one)
    return out


_REPORT = """with s as (select cast(l_returnflag as varchar) as domain, 'speaker' || l_suppkey as speaker, l_orderkey as video_id, l_linenumber as pos, '  ' || case l_linenumber % 3 when 0 then 'clean' when 1 then 'diarize' else 'split' end || ': score=' || case when l_discount > 0.08 then '?' when l_discount > 0.05 then '2' else cast(l_linenumber % 2 as varchar) end || '  ' || l_linestatus as line from lineitem),
h as (select distinct domain, speaker, video_id from s),
r as (select domain, speaker, video_id, 0 as pos, '[' || domain || '] ' || speaker || '/' || video_id as line from h union all select domain, speaker, video_id, cast(row_number() over (partition by domain, speaker, video_id order by pos, line) as int), line from s)
select * from r union all select domain, speaker, video_id, cast(count(*) as int) as pos, '' as line from r group by domain, speaker, video_id"""


@query(_REPORT)
def audit_report(spark, sf_dir):
    """The text report's lines: a head for each video, its stages with scores and reasons, and a blank line."""
    lines = table(spark, sf_dir, "lineitem")
    stage = F.expr("case l_linenumber % 3 when 0 then 'clean' when 1 then 'diarize' else 'split' end")
    score = F.expr("case when l_discount > 0.08 then -1 when l_discount > 0.05 then 2 else cast(l_linenumber % 2 as int) end")
    rows = lines.select(F.col("l_returnflag").alias("domain"), F.concat(F.lit("speaker"), F.col("l_suppkey").cast("string")).alias("speaker"), F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("pos"), stage.alias("stage"), score.alias("score"), F.col("l_linestatus").alias("reason"))
    return files.audit_lines(rows)


@query(f"select identity_status, count(*) as n from ({ORACLES['identity_score']}) group by identity_status")
def identity_distribution(spark, sf_dir):
    return quality.identity_score(spark, sf_dir).groupBy("identity_status").agg(F.count(F.lit(1)).alias("n"))


@query("select lang, source, count(*) as n from documents group by lang, source")
def groups_by_size(spark, sf_dir):
    """Groups, the largest first."""
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang", "source")


@query("""with n as (select conv_id, case role when 'system' then 'UNKNOWN' else role end as speaker, count(*) as k from conversations group by all)
select conv_id as file, string_agg(speaker || '=' || k, ',' order by k desc, speaker) as shares from n group by conv_id""")
def speaker_shares(spark, sf_dir):
    """Each file's speakers with their segments, the largest share first."""
    speaker = F.when(F.col("role") == "system", "UNKNOWN").otherwise(F.col("role"))
    return seg.speaker_shares(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), speaker.alias("speaker")))


@query("""with x as (select 0 as part, s_suppkey as pos, 'Customer' || substr(s_name, 9) as name from supplier union all select 1, c_custkey, c_name from customer)
select name, min((part, pos))[1] as part, min((part, pos))[2] as pos from x group by name""")
def ordered_union(spark, sf_dir):
    """Two lists as one: the first of equal names stays, in the order of the lists."""
    first = table(spark, sf_dir, "supplier").select(F.lit(0).alias("part"), F.col("s_suppkey").cast("long").alias("pos"), F.expr("concat('Customer', substr(s_name, 9))").alias("name"))
    every = first.unionByName(table(spark, sf_dir, "customer").select(F.lit(1).alias("part"), F.col("c_custkey").cast("long").alias("pos"), F.col("c_name").alias("name")))
    return relational.keep_first(every, ["name"], ["part", "pos"]).select("name", "part", "pos").orderBy("part", "pos")


_RULE = "case " + " ".join(f"when regexp_matches(trim(coalesce(ud, '')), {_quoted(p)}) then '{n}'" for n, p in evidence.DESCRIPTION_RULES.items()) + " when lower(coalesce(ul, '')) in (" + ", ".join(map(_quoted, evidence.OTHER_LANGUAGES)) + ") then 'lang:' || lower(ul) else '' end"


@query(f"""with v as (select page_id, identity_status, case when page_id % 3 = 0 then html else '' end as od, case when page_id % 3 = 0 then 'EN' else '' end as ol, case when page_id % 7 = 1 then 'unavailable' end as status from ({ORACLES["identity_score"]}) join pages using (page_id)),
c as (select v.*, d.text as cd, d.lang as cl, (od = '' or ol = '') as bare from v left join documents d on d.doc_id = 2 * page_id),
u as (select *, case when bare then cd else od end as ud, case when bare then cl else ol end as ul from c),
r as (select *, {_RULE} as rule from u),
w as (select *, case when bare and cd is null and cl is null then 'passed' when bare and coalesce(status = 'unavailable', false) then 'skipped' when rule <> '' or identity_status = 'high_risk' then 'filtered' else 'passed' end as verdict from r)
select page_id, verdict, case when verdict <> 'filtered' then '' when rule <> '' then rule else 'low_identity_score' end as reason, case when ol <> '' then ol else coalesce(cl, '') end as language, length(case when od <> '' then od else coalesce(left(cd, 1000), '') end) as n_description from w""")
def filter_decision(spark, sf_dir):
    """What becomes of each video: its own metadata or the fetched ones, the rules, then the identity."""
    videos = quality.identity_score(spark, sf_dir).select("page_id", "identity_status").join(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    own = {"description": F.expr("case when page_id % 3 = 0 then html else '' end"), "language": F.expr("case when page_id % 3 = 0 then 'EN' else '' end")}
    cached = table(spark, sf_dir, "documents").select((F.col("doc_id") / 2).alias("half"), F.col("text").alias("cd"), F.col("lang").alias("cl"))
    rows = videos.join(cached, F.col("page_id").cast("double") == F.col("half"), "left").withColumns({"od": own["description"], "ol": own["language"]})
    made = evidence.filter_decision({"description": F.col("od"), "language": F.col("ol")}, {"description": F.col("cd"), "language": F.col("cl")}, F.expr("case when page_id % 7 = 1 then 'unavailable' end"), F.col("identity_status"))
    d = rows.select("page_id", made.alias("d"))
    return d.select("page_id", "d.verdict", "d.reason", "d.language", F.char_length("d.description").cast("long").alias("n_description"))


@query("""with e as (select o_orderkey, case o_orderpriority when '1-URGENT' then 'ERROR: Video unavailable' when '2-HIGH' then 'age-restricted' when '3-MEDIUM' then 'Playback restricted' when '4-NOT SPECIFIED' then 'timed out' else 'age.restricted' end as m from orders)
select o_orderkey, case when regexp_matches(lower(m), 'video unavailable|private video|age.restrict|removed|not available|playback restricted|community guidelines') then 'unavailable' else 'failed' end as captions, case when regexp_matches(lower(m), 'video unavailable|private video|age\\.restrict|removed|not available') then 'unavailable' else 'failed' end as metadata from e""")
def fetch_errors(spark, sf_dir):
    """What becomes of an item whose fetch failed: the metadata stage knows fewer messages."""
    said = F.expr("case o_orderpriority when '1-URGENT' then 'ERROR: Video unavailable' when '2-HIGH' then 'age-restricted' when '3-MEDIUM' then 'Playback restricted' when '4-NOT SPECIFIED' then 'timed out' else 'age.restricted' end")
    return table(spark, sf_dir, "orders").select("o_orderkey", *(files.fetch_status(said, k).alias(k) for k in ("captions", "metadata")))


_DIM = "(values " + ", ".join(f"({_quoted(a)}, {_quoted(b)}, {_quoted(c)})" for a, b, c in dimensions.SPEAKERS) + ") as m(speaker, display, domain)"
_SLUGS = "[" + ", ".join(_quoted(a) for a, _, _ in dimensions.SPEAKERS) + "]"


@query(f"""with r as (select c_custkey, case when c_custkey % 9 = 0 then 'someone_else' else {_SLUGS}[1 + c_custkey % {len(dimensions.SPEAKERS)}] end as speaker from customer)
select c_custkey, r.speaker, coalesce(display, 'Someone Else') as display, coalesce(domain, 'unknown') as domain from r left join {_DIM} on r.speaker = m.speaker where coalesce(domain, 'unknown') <> 'politics'""")
def domain_exclusion(spark, sf_dir):
    """Speakers with name and domain, one domain left out; unlisted ones are unknown."""
    slugs = F.array(*(F.lit(a) for a, _, _ in dimensions.SPEAKERS))
    speaker = F.when(F.col("c_custkey") % 9 == 0, "someone_else").otherwise(F.element_at(slugs, (F.col("c_custkey") % len(dimensions.SPEAKERS) + 1).cast("int")))
    return dimensions.with_domain(table(spark, sf_dir, "customer").select("c_custkey", speaker.alias("speaker"))).where("domain <> 'politics'")


@query("""with w as (select s_suppkey, replace(replace(lower(s_name), '#', '_'), ' ', '_') as slug from supplier),
d as (select s_suppkey, slug, regexp_extract(slug, '^[a-z]+') as a, regexp_extract(slug, '[0-9]+') as b from w)
select s_suppkey, slug, upper(a[1]) || a[2:] || ' ' || b as display, a || ' ' || b || ',' || b || ',' || a[1] || b[1] as aliases from d""")
def speaker_aliases(spark, sf_dir):
    """Display names and search names of slugs, longest first; the listed exceptions are tested on their own."""
    slug = F.translate(F.lower("s_name"), "# ", "__")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", slug.alias("slug")).withColumn("display", evidence.display_name(F.col("slug")))
    return rows.select("s_suppkey", "slug", "display", F.array_join(evidence.aliases(F.col("display"), F.col("slug")), ",").alias("aliases"))


@query("""with t as (select conv_id as file, turn as idx, case role when 'system' then 'UNKNOWN' else role end as speaker, text from conversations),
p as (select *, row_number() over (partition by file, speaker order by idx) - 1 as i, count(*) over (partition by file, speaker) as n from t where speaker <> 'UNKNOWN'),
k as (select * from p where n <= 20 or i in (select v * n // 20 from range(20) r(v))),
b as (select file, speaker, left(string_agg(text, chr(10) order by i), 1200) as body from k group by file, speaker)
select file, string_agg('--- ' || speaker || ' ---' || chr(10) || body, chr(10) || chr(10) order by speaker) as prompt from b group by file""")
def speaker_prompts(spark, sf_dir):
    """What a provider is shown of each file's speakers."""
    speaker = F.when(F.col("role") == "system", "UNKNOWN").otherwise(F.col("role"))
    return annotate.speaker_prompts(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("idx"), speaker.alias("speaker"), "text"))


@query("""with r as (select conv_id, list_sort(list_distinct(list(upper(role) || ' 1'))) as known, max(turn) as t from conversations group by conv_id)
select conv_id, case when t % 3 = 0 then known[1] when t % 3 = 1 and len(known) > 1 then known[2] end as guest from r""")
def guest_labels(spark, sf_dir):
    """The guest whom a reply names, by a key that is equal but for case and spaces."""
    roles = F.array_sort(F.collect_set(F.concat(F.upper("role"), F.lit(" 1"))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(roles.alias("known"), F.max("turn").alias("t"))
    key = F.when(F.col("t") % 3 == 0, F.get("known", F.lit(0))).when(F.col("t") % 3 == 1, F.get("known", F.lit(1)))
    reply = F.when(key.isNotNull(), F.concat(F.lit('Sure: {"nobody": "host", "'), F.lower(key), F.lit('": " Guest "}'))).otherwise("no labels")
    # names are slugs with underscores; keys of replies have spaces
    slugs = F.transform("known", lambda x: F.replace(x, F.lit(" "), F.lit("_")))
    rows = rows.select("conv_id", reply.alias("reply"), slugs.alias("slugs"))
    return rows.select("conv_id", F.replace(replies.guest_label(F.col("reply"), F.col("slugs")), F.lit("_"), F.lit(" ")).alias("guest"))
