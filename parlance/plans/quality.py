"""Quality plans: segments of transcripts, guests, evidence, and model replies.

Conversations play segments: the turn's place gives its time, the length of its text how long it lasts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import evidence, replies
from parlance.operators import segments as seg
from parlance.plans.corpus import WORDS, _quoted
from parlance.plans.registry import ORACLES, query, table

SEG = "seg as (select conv_id as file, turn as idx, case role when 'system' then 'UNKNOWN' else role end as speaker, turn * 20.0 + conv_id % 7 as s, turn * 20.0 + conv_id % 7 + length(text) / 10.0 as e, text, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') as t from conversations), dur as (select file, max(e) + 3 as duration from seg group by file)"


def segments(spark, sf_dir) -> DataFrame:
    start = F.col("turn") * 20.0 + F.col("conv_id") % 7
    speaker = F.when(F.col("role") == "system", "UNKNOWN").otherwise(F.col("role"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("idx"), speaker.alias("speaker"), start.alias("start"), (start + F.char_length("text") / 10.0).alias("end"), "text")


def durations(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file").agg((F.max("end") + 3).alias("duration"))


FILLERS = ", ".join(map(_quoted, seg.FILLERS))
TEXT = f"""w as (select file, t, string_split_regex(lower(t), '\\s+') as ws, {WORDS.format("t")} as n from seg),
x as (select file, t, n, case when n = 0 then 0 else len(list_filter(ws, lambda k: trim(k, '.,!?;:"''') in ({FILLERS}))) end as f from w),
tq0 as (select file, count(*) as segments, cast(sum(n) as bigint) as total_words, count(*) filter (n <= 2) as short_segments, count(*) filter (n = 0) as empty_segments, cast(sum(f) as bigint) as filler_words, count(*) filter (regexp_matches(t, '{seg.CAPTION}')) as caption_segments, count(*) filter (regexp_matches(t, '[^\\x00-\\x7F]')) as non_english_segments from x group by file),
tq1 as (select *, total_words / duration as wps, short_segments / segments as sh, empty_segments / segments as em, case when total_words = 0 then 0.0 else filler_words / total_words end as fi from tq0 join dur using (file)),
tq as (select *, greatest(0, 100 - case when wps < 1 then 15 when wps > 5 then 10 else 0 end - case when sh > 0.5 then 20 when sh > 0.3 then 10 else 0 end - case when em > 0.05 then 15 else 0 end - case when fi > 0.15 then 10 else 0 end - case when non_english_segments > 0 then 10 else 0 end) as text_score,
array_to_string(list_filter([case when wps < 1 then 'WARN:very_low_wps' when wps > 5 then 'WARN:high_wps' end, case when sh > 0.5 then 'FAIL:excessive_short_segments' when sh > 0.3 then 'WARN:many_short_segments' end, case when fi > 0.2 then 'WARN:high_filler_ratio' end], lambda k: k is not null), ',') as text_flags from tq1)"""
DIAR = """d0 as (select *, e - s as d, case when lag(1) over w is not null and speaker is distinct from lag(speaker) over w then 1 else 0 end as c from seg window w as (partition by file order by idx)),
d1 as (select file, count(*) as n, count(distinct speaker) as speakers, count(*) filter (d < 1) as very_short, count(*) filter (speaker = 'UNKNOWN') as unknown, cast(sum(c) as bigint) as changes, avg(d) as m, stddev_pop(d) as sd from d0 group by file),
dq as (select *, case when m > 0 then sd / m else 0.0 end as cv, greatest(0, 100 - case when speakers = 1 then 10 when speakers >= 8 then 25 when speakers >= 6 then 10 else 0 end - case when very_short / n > 0.2 then 20 when very_short / n > 0.1 then 10 else 0 end - case when unknown / n > 0.3 then 25 when unknown / n > 0.1 then 10 else 0 end - case when changes / n > 0.6 then 15 else 0 end - case when case when m > 0 then sd / m else 0.0 end > 2 then 10 else 0 end) as diarization_score,
array_to_string(list_filter([case when speakers >= 8 then 'FAIL:too_many_speakers' when speakers >= 6 then 'WARN:many_speakers' when speakers <= 1 then 'WARN:single_speaker' end, case when unknown / n > 0.3 then 'FAIL:high_unknown_ratio' when unknown / n > 0.1 then 'WARN:some_unknown' end, case when very_short / n > 0.2 then 'FAIL:excessive_short_segments' when very_short / n > 0.1 then 'WARN:many_short_segments' end, case when changes / n > 0.6 then 'WARN:high_turn_rate' end], lambda k: k is not null), ',') as diarization_flags from d1)"""
TIME = """g0 as (select *, s - lag(e) over (partition by file order by s, idx) as g from seg),
g1 as (select file, sum(e - s) as covered, sum(case when g > 0.5 then g else 0 end) as total_gap, max(case when g > 0.5 then g else 0 end) as max_gap, count(*) filter (g > 0.5) as n_gaps, sum(case when -g > 0.1 then -g else 0 end) as total_overlap, count(*) filter (-g > 0.1) as n_overlaps from g0 group by file),
g2 as (select *, covered / duration as coverage, total_gap / duration as gr, total_overlap / duration as orr from g1 join dur using (file)),
gq as (select *, greatest(0, 100 - case when coverage < 0.5 then 30 when coverage < 0.7 then 15 else 0 end - case when gr > 0.2 then 20 when gr > 0.1 then 10 else 0 end - case when max_gap > 30 then 15 when max_gap > 10 then 5 else 0 end - case when orr > 0.05 then 10 else 0 end) as temporal_score,
array_to_string(list_filter([case when coverage < 0.5 then 'FAIL:low_coverage' when coverage < 0.7 then 'WARN:moderate_coverage' end, case when gr > 0.2 then 'FAIL:large_gaps' when gr > 0.1 then 'WARN:some_gaps' end, case when max_gap > 30 then 'WARN:long_silence' end, case when orr > 0.05 then 'WARN:overlap' end], lambda k: k is not null), ',') as temporal_flags from g2)"""
TRI = """tw as (select file, string_split_regex(regexp_replace(string_agg(lower(t), ' ' order by idx), '^\\s+|\\s+$', '', 'g'), '\\s+') as ws from seg group by file),
tri as (select file, trigram, count(*) as n from (select file, unnest(list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: array_to_string(ws[i:i + 2], ' '))) as trigram from tw) group by all having count(*) >= 5)"""
ANOM = f"""{TRI}, a0 as (select file, count(*) filter (length(t) > 50 and not contains(t, ' ')) as long_words, count(*) filter (regexp_matches(t, {_quoted(seg.ODD_CHARACTER)})) as odd_characters, count(*) filter (e - s < 0.5 and t <> '') as ultrashort, count(*) filter (e - s > 30) as overlong from seg group by file),
tail as (select file, count(*) filter (rn <= 5 and regexp_matches(t, '{seg.CAPTION}')) as tail_captions from (select *, row_number() over (partition by file order by idx desc) as rn from seg) group by file),
a1 as (select file, coalesce(x.k, 0) as trigrams, long_words, odd_characters, ultrashort, overlong, tail_captions from a0 join tail using (file) left join (select file, count(*) as k from tri group by file) x using (file)),
aq as (select *, greatest(0, 100 - 15 * (cast(trigrams > 0 as int) + cast(long_words > 3 as int) + cast(odd_characters > 5 as int) + cast(ultrashort > 10 as int) + cast(overlong > 3 as int))) as anomaly_score,
array_to_string(list_filter([case when trigrams > 0 then 'WARN:repeated_trigrams:' || trigrams end, case when long_words > 3 then 'WARN:long_word_segments' end, case when odd_characters > 5 then 'WARN:special_characters' end, case when ultrashort > 10 then 'WARN:ultrashort_with_text' end, case when overlong > 3 then 'WARN:long_segments_no_change' end, case when tail_captions >= 3 then 'INFO:trailing_captions' end], lambda k: k is not null), ',') as anomaly_flags from a1)"""


@query(f"with {SEG}, {TEXT} select file, segments, total_words, short_segments, empty_segments, filler_words, caption_segments, non_english_segments, text_score, text_flags from tq")
def text_quality(spark, sf_dir):
    s = segments(spark, sf_dir)
    return seg.text_quality(s, durations(s)).withColumn("text_flags", F.array_join("text_flags", ","))


@query(f"with {SEG}, {DIAR} select file, speakers, very_short, unknown, changes, round(m, 6) as mean_duration, round(cv, 6) as duration_cv, diarization_score, diarization_flags from dq")
def diarization_stability(spark, sf_dir):
    return seg.diarization_stability(segments(spark, sf_dir)).withColumn("diarization_flags", F.array_join("diarization_flags", ","))


@query(f"with {SEG}, {TIME} select file, round(coverage, 3) as coverage, round(total_gap, 2) as total_gap, round(max_gap, 2) as max_gap, n_gaps, round(total_overlap, 2) as total_overlap, n_overlaps, temporal_score, temporal_flags from gq")
def temporal_quality(spark, sf_dir):
    s = segments(spark, sf_dir)
    return seg.temporal_quality(s, durations(s)).withColumn("temporal_flags", F.array_join("temporal_flags", ","))


@query(f"with {SEG}, {ANOM} select file, trigrams, long_words, odd_characters, ultrashort, overlong, tail_captions, anomaly_score, anomaly_flags from aq")
def anomaly_quality(spark, sf_dir):
    return seg.anomaly_quality(segments(spark, sf_dir)).withColumn("anomaly_flags", F.array_join("anomaly_flags", ","))


@query("with g as (select doc_id, string_split_regex(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+') as ws from documents) select doc_id, trigram, count(*) as n from (select doc_id, unnest(list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: array_to_string(ws[i:i + 2], ' '))) as trigram from g) group by all having count(*) >= 5")
def repeated_trigrams(spark, sf_dir):
    """Trigrams that a document has five times or more."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.lit(0).alias("idx"), "text")
    return seg.repeated_trigrams(rows).withColumnRenamed("file", "doc_id")


OVERALL = "0.3 * text_score + 0.35 * diarization_score + 0.2 * temporal_score + 0.15 * anomaly_score"


@query(f"""with {SEG}, {TEXT}, {DIAR}, {TIME}, {ANOM}, o as (select file, text_score, diarization_score, temporal_score, anomaly_score, round({OVERALL}, 6) as v, string_split(concat_ws(',', nullif(text_flags, ''), nullif(diarization_flags, ''), nullif(temporal_flags, ''), nullif(anomaly_flags, '')), ',') as f from tq join dq using (file) join gq using (file) join aq using (file))
select file, text_score, diarization_score, temporal_score, anomaly_score, round(cast(v as double), 2) as overall_score, case when v >= 80 then 'GOOD' when v >= 60 then 'FAIR' when v >= 40 then 'POOR' else 'BAD' end as grade, len(list_filter(f, lambda k: starts_with(k, 'FAIL'))) as fails, len(list_filter(f, lambda k: starts_with(k, 'WARN'))) as warns from o""")
def overall_grade(spark, sf_dir):
    s = segments(spark, sf_dir)
    return seg.overall_grade(s, durations(s)).withColumns({c: F.col(c).cast("long") for c in ("fails", "warns")})


@query(f"""with {SEG}, {TEXT}, {DIAR}, {TIME}, {ANOM}, o as (select round(cast({OVERALL} as double), 2) as v from tq join dq using (file) join gq using (file) join aq using (file)),
g as (select case when v >= 80 then 'GOOD' when v >= 60 then 'FAIR' when v >= 40 then 'POOR' else 'BAD' end as grade, v from o)
select k.grade, count(g.v) as n, round(avg(v), 4) as mean, round(min(v), 2) as low, round(max(v), 2) as high, round(median(v), 4) as median from (values ('GOOD'), ('FAIR'), ('POOR'), ('BAD')) k(grade) left join g using (grade) group by k.grade""")
def grade_distribution(spark, sf_dir):
    """All four grades with counts and spread."""
    s = segments(spark, sf_dir)
    rows = seg.overall_grade(s, durations(s)).select("grade", F.col("overall_score").alias("v"))
    every = spark.createDataFrame([("GOOD",), ("FAIR",), ("POOR",), ("BAD",)], "grade string")
    return every.join(rows, "grade", "left").groupBy("grade").agg(F.count("v").alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.min("v"), 2).alias("low"), F.round(F.max("v"), 2).alias("high"), F.round(F.median("v"), 4).alias("median"))


GUEST = f"""sw as (select file, speaker, cast(sum({WORDS.format("t")}) as bigint) as n, min(idx) as f from seg {{0}} group by all),
r as (select *, row_number() over (partition by file order by n desc, f, speaker) as rn, count(*) over (partition by file) as k, sum(n) over (partition by file) as total, min(n) over (partition by file) as least from sw)"""


@query(f"""with {SEG}, {GUEST.format("where speaker <> 'UNKNOWN'")} select a.file, a.speaker as target, case when a.k = 1 then 'single' when a.k = 2 and b.n / greatest(a.n, 1) < 0.3 then 'duration' else 'provider' end as method, cast(a.k as int) as n_speakers, cast(a.total as bigint) as total_words, a.n as guest_words from r a left join r b on a.file = b.file and b.rn = 2 where a.rn = 1""")
def guest_argmax(spark, sf_dir):
    return seg.guest(segments(spark, sf_dir))


@query(f"""with {SEG}, {GUEST.format("")} select file, speaker as target, case when k = 1 then 'single_speaker' when least / greatest(n, 1) < 0.25 then 'duration_clear' else 'duration_ambiguous' end as method, k as n_speakers, n as most, least from r where rn = 1""")
def guest_argmax_min(spark, sf_dir):
    return seg.guest_hosted(segments(spark, sf_dir))


@query(f"with {SEG} select file, speaker, string_agg(t, chr(10) order by idx) as text from seg group by all")
def guest_text(spark, sf_dir):
    return seg.guest_text(segments(spark, sf_dir))


@query(f"""with x as (select item_id, item_id % 60 as i, {WORDS.format("text")} as w from benchmark),
l as (select item_id, unnest(string_split(case item_id % 6 when 0 then i || '|Positive| hedged ' when 1 then i || '|bad|neutral' when 2 then 'x|neutral|neutral' when 3 then i || '|neutral' when 4 then '-1|negative|emphatic' else i || '|negative|EMPHATIC' || chr(10) || w || '|neutral|neutral|more' end, chr(10))) as line from x),
p as (select item_id, list_transform(string_split(line, '|'), lambda k: lower(trim(k))) as p from l)
select item_id, try_cast(p[1] as int) as idx, p[2] as valence, p[3] as modality from p where try_cast(p[1] as int) >= 0 and p[2] in ('positive', 'negative', 'neutral') and p[3] in ('emphatic', 'hedged', 'neutral')""")
def reply_parse(spark, sf_dir):
    """Valid rows of pipe replies; the rest is skipped."""
    from parlance.functions.text import word_count

    x = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 60).alias("i"), word_count(F.col("text")).alias("w"))
    reply = F.expr("case item_id % 6 when 0 then i || '|Positive| hedged ' when 1 then i || '|bad|neutral' when 2 then 'x|neutral|neutral' when 3 then i || '|neutral' when 4 then '-1|negative|emphatic' else i || '|negative|EMPHATIC' || chr(10) || w || '|neutral|neutral|more' end")
    return x.select("item_id", F.inline(replies.labelled_lines(reply)))


@query("""select event_id, case when event_id % 5 < 3 and cast(json_extract(props, '$.k') as int) % 4 < 3 then cast(json_extract(props, '$.k') as int) % 4 else -1 end as score from events""")
def json_reply(spark, sf_dir):
    """Scores of bare, fenced and wrapped JSON; -1 for others and for scores out of range."""
    k = F.get_json_object("props", "$.k").cast("int") % 4
    body = F.concat(F.lit('{"score": '), k.cast("string"), F.lit(', "reason": "x"}'))
    mod = F.col("event_id") % 5
    reply = F.when(mod == 0, body).when(mod == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).when(mod == 2, F.concat(F.lit("I would say "), body, F.lit(" as asked."))).when(mod == 3, "no idea").otherwise('{"other": 1}')
    return table(spark, sf_dir, "events").select("event_id", replies.json_score(reply).cast("int").alias("score"))


_TITLES = ["Interview with Ada Lovelace on debt", "Ada Lovelace", "The history of money", "Panel: Lovelace and others", "Who is Ada Lovelace documentary", "Breaking news"]


def _videos(spark, sf_dir) -> DataFrame:
    title = F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("page_id") % 6 + 1).cast("int"))
    channel = F.when(F.col("page_id") % 4 == 0, "CNBC News").when(F.col("page_id") % 4 == 1, "Ada Lovelace").otherwise("Channel")
    rows = table(spark, sf_dir, "pages").select("page_id", title.alias("title"), channel.alias("channel"), F.lit("Ada Lovelace").alias("display"), F.col("html").alias("transcript"))
    return rows.withColumn("aliases", evidence.aliases(F.col("display")))


def _norm(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9&''+ -]+', ' ', 'g'), '\s+', ' ', 'g'))"


def _any(c: str, terms: list[str]) -> str:
    return "(" + " or ".join(f"contains({c}, {_quoted(t)})" for t in terms) + ")"


_NAMES = ["ada lovelace", "lovelace", "al"]
_HIT = lambda c: "case " + " ".join(f"when contains(' ' || {c} || ' ', ' {a} ') then '{a}'" for a in _NAMES) + " end"


@query(f"""with v as (select page_id, {_norm("case page_id % 6 " + " ".join(f"when {i} then {_quoted(t)}" for i, t in enumerate(_TITLES)) + " end")} as t, {_norm("case page_id % 4 when 0 then 'CNBC News' when 1 then 'Ada Lovelace' else 'Channel' end")} as c from pages),
h as (select *, {_HIT("t")} as ta, {_HIT("c")} as ca, regexp_matches(t || ' ' || c, '\\bada\\b') and regexp_matches(t || ' ' || c, '\\blovelace\\b') as tok, {_any("t", evidence.INTERVIEW_TERMS)} as iv, {_any("c", evidence.NEWS_CHANNELS)} as g, list_sort(list_filter([{', '.join(map(_quoted, evidence.RISK_TERMS))}], lambda r: contains(t, r))) as risks from v),
s as (select *, 4 * cast(ta is not null as int) + 3 * cast(ca is not null as int) + 3 * cast(tok and ta is null as int) + cast(iv as int) - cast(g and ta is null as int) - least(3, len(risks)) - 4 * cast(ta is null and ca is null and not tok as int) as score from h)
select page_id, cast(score as int) as identity_score, case when score >= 4 then 'likely_match' when score >= 1 then 'review' else 'high_risk' end as identity_status, array_to_string(list_filter([case when ta is not null then 'title_name:' || ta end, case when ca is not null then 'channel_name:' || ca end, case when tok and ta is null then 'all_name_tokens' end, case when iv then 'interview_or_speech_term' end, case when g and ta is null then 'generic_news_channel_without_title_name' end, case when len(risks) > 0 then 'risk_terms:' || array_to_string(risks[1:4], '|') end, case when ta is null and ca is null and not tok then 'no_name_match' end], lambda k: k is not null), '; ') as identity_reasons from s""")
def identity_score(spark, sf_dir):
    """Metadata evidence that the named speaker is the one in the video."""
    v = _videos(spark, sf_dir)
    out = evidence.identity(F.col("title"), F.col("channel"), F.col("display"), F.col("aliases"))
    return v.select("page_id", *(c.alias(n) for n, c in out.items() if n != "transcript_score"))


_ALIASED = "(?:ada lovelace|lovelace)"
_HEARD = rf"""(4 * cast(regexp_matches(e, '\b(?:{"|".join(x.replace("'", "''") for x in evidence.INTRODUCTIONS)})\b.{{0,120}}\b{_ALIASED}\b') or regexp_matches(e, '\b{_ALIASED}\b.{{0,80}}\b(?:{"|".join(x.replace("'", "''") for x in evidence.INTRODUCTIONS)})\b') as int)
+ 4 * cast(regexp_matches(e, '\b(?:{"|".join(x.replace("'", "''") for x in evidence.SELF_INTRODUCTIONS)})\b.{{0,40}}\b{_ALIASED}\b') as int) + 3 * cast(regexp_matches(e, '\bada\b') and regexp_matches(e, '\blovelace\b') as int)
+ case when len(regexp_extract_all(x, '\blovelace\b')) >= 3 then 3 when len(regexp_extract_all(x, '\blovelace\b')) >= 1 then 1 else 0 end)"""


@query(f"""with m as ({ORACLES["identity_score"]}), x as (select page_id, {_norm("strip_accents(html)")} as x from pages), e as (select page_id, x, left(x, 8000) as e from x),
h as (select page_id, {_HEARD} as heard from e), s as (select m.*, cast(heard as int) as heard, identity_score + heard as score from m join h using (page_id))
select page_id, cast(score as int) as identity_score, case when score >= 4 then 'likely_match' when score >= 1 then 'review' else 'high_risk' end as identity_status, concat_ws('; ', nullif(identity_reasons, ''), case when heard > 0 then 'transcript_evidence:' || heard end) as identity_reasons, heard as transcript_score from s""")
def identity_with_transcript(spark, sf_dir):
    """The same with what the transcript adds, each page's whole html; tested on fixed texts."""
    v = _videos(spark, sf_dir)
    return v.select("page_id", *(c.alias(n) for n, c in evidence.identity(F.col("title"), F.col("channel"), F.col("display"), F.col("aliases"), F.col("transcript")).items()))


_VT = "case when not (contains(t, 'ada lovelace') or contains(t, 'lovelace')) then (1, 1) when " + _any("t", evidence.TITLE_DOCUMENTARY) + " or " + " or ".join(f"regexp_matches(t, {_quoted(p)})" for p in evidence.TITLE_DOUBTFUL) + " then (2, 2) when " + _any("t", evidence.TITLE_INTERVIEW) + " and not " + _any("t", evidence.TITLE_PANEL) + " then (4, 3) else (3, 2) end"
_VD = "case when d = '' then null when " + _any("d", evidence.TEXT_DOCUMENTARY) + " and not " + _any("d", evidence.TEXT_INTERVIEW) + " then (2, 3) when " + _any("d", evidence.TEXT_INTERVIEW) + " and contains(d, 'ada lovelace') then (4, 3) when " + _any("d", evidence.TEXT_PANEL) + " then (3, 2) when contains(d, 'ada lovelace') then (3, 1) else null end"


@query(f"""with v as (select page_id, lower(case page_id % 6 {" ".join(f"when {i} then {_quoted(t)}" for i, t in enumerate(_TITLES))} end) as t, lower(case page_id % 5 when 0 then '' when 1 then 'Ada Lovelace sits down with us' when 2 then 'A documentary' when 3 then 'A panel' else 'Thoughts of Ada Lovelace' end) as d, html as x from pages),
w as (select page_id, {_VT} as vt, {_VD} as vd, {WORDS.format("x")} as n, (length(x) - length(replace(x, '?', ''))) / greatest({WORDS.format("x")}, 1) as q, contains(lower(x), 'ada') or contains(lower(x), 'lovelace') as h from v),
z as (select page_id, vt, vd, case when n < 200 then (1, 3) when n < 500 then (2, 2) when q > 0.003 and h then (4, 3) when q > 0.003 then (3, 2) when n > 2000 and h then (3, 1) when n > 5000 then (3, 1) else (2, 1) end as vx from w),
y as (select page_id, vt[1] as a, vt[2] as wa, vd[1] as b, coalesce(vd[2], 0) as wb, vx[1] as c, vx[2] as wc from z)
select page_id, (a * wa + coalesce(b * wb, 0) + c * wc) / (wa + wb + wc)::double as mean_vote, a as vote_title, b as vote_description, c as vote_transcript, case when len(list_distinct([a, b, c])) = 1 and wa = 3 and wc = 3 then 'high' when len(list_distinct([a, b, c])) <= 2 and cast(wa >= 2 as int) + cast(wb >= 2 as int) + cast(wc >= 2 as int) >= 2 then 'high' when len(list_distinct([a, b, c])) <= 2 then 'medium' else 'low' end as confidence from y""")
def tsp_predict(spark, sf_dir):
    """Votes of title, description and transcript, and their weighted mean (unrounded here, so that ties can't differ)."""
    title = F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("page_id") % 6 + 1).cast("int"))
    d = F.expr("case page_id % 5 when 0 then '' when 1 then 'Ada Lovelace sits down with us' when 2 then 'A documentary' when 3 then 'A panel' else 'Thoughts of Ada Lovelace' end")
    name = F.lit("ada lovelace")
    v = table(spark, sf_dir, "pages").select("page_id", evidence.vote_title(title, name).alias("vt"), evidence.vote_description(d, name).alias("vd"), evidence.vote_transcript(F.col("html"), name).alias("vx"))
    out = evidence.combined(F.col("vt"), F.col("vd"), F.col("vx"))
    weight = lambda c: F.when(F.col(f"{c}.tsp").isNull(), 0).when(F.col(f"{c}.conf") == "high", 3).when(F.col(f"{c}.conf") == "medium", 2).otherwise(1)
    total = weight("vt") + weight("vd") + weight("vx")
    mean = (F.col("vt.tsp") * weight("vt") + F.coalesce(F.col("vd.tsp") * weight("vd"), F.lit(0)) + F.col("vx.tsp") * weight("vx")) / total
    return v.select("page_id", mean.alias("mean_vote"), F.col("vt.tsp").alias("vote_title"), F.col("vd.tsp").alias("vote_description"), F.col("vx.tsp").alias("vote_transcript"), out["confidence"].alias("confidence"))
