"""Evidence that a named speaker really talks: description rules, identity scores and format votes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.text import contains_any, identity_normal, let, title_name, word_count
from parlance.operators.relational import first_match

# Patterns of descriptions that aren't by the speaker, in the order in which they count.
DESCRIPTION_RULES = {
    "repost_documentary": r"(?i)(?:mini.documentary|this\s+(?:new\s+)?documentary\s+(?:on|about|reveals))",
    "about_person_not_by": r"(?i)\b(?:biography\s+of|book\s+(?:of|about)\s+the\b.*?(?:secretary|treasury|fed|chair))",
    "news_report_about": r"(?i)\b(?:lightning\s+rod\s+for\s+conspiracy\b)",
    "doc_trope": r"(?i)\b(?:rags\s+to\s+riches|untold\s+story)\b",
}
OTHER_LANGUAGES = ["it", "fr", "de", "es", "pt", "ru", "zh", "ja", "ko", "ar", "hi"]

# Terms of titles and channels.
INTERVIEW_TERMS = ["interview", "conversation", "talk", "speech", "lecture", "keynote", "podcast", "debate", "remarks", "address", "testimony", "hearing", "forum", "summit", "panel", "q&a", "qa", "fireside", "live", "full", "discusses", "explains", "on "]
RISK_TERMS = ["documentary", "biography", "history of", "rise and fall", "story of", "explained", "profile", "tribute", "almost crashed", "who is", "why ", "how ", "news", "breaking", "analysis of", "reacts to", "exposed", "secret", "scandal", "compilation"]
NEWS_CHANNELS = ["news", "pbs", "frontline", "cnn", "msnbc", "fox", "cnbc", "bbc", "bloomberg", "reuters", "ap archive", "associated press", "guardian"]
INTRODUCTIONS = ["our guest", "my guest", "joining us", "joined by", "welcome", "pleased to welcome", "today we have", "with us", "in conversation with", "keynote", "speaker is", "this is"]
SELF_INTRODUCTIONS = ["i am", "i'm", "my name is", "this is"]
PLAIN_SURNAMES = ["news", "power", "rice", "wood", "gross", "marks", "gates", "hill", "warren", "cotton", "johnson", "williams", "brooks", "rubio"]

# Keywords of the format votes. Patterns with capitals never match lower-cased titles.
TITLE_INTERVIEW = ["on ", " with ", " interview", " talks ", " discusses ", " joins ", " conversation", " live", " says ", " explains ", " moderated by", " in conversation", " speaks with", " sits down with"]
TITLE_DOCUMENTARY = ["biography", "the man who", "the story of", "rise and fall", "documentary", "profile", "history of", "legend of", "life and times", "a biography", "the true story", "full documentary"]
TITLE_PANEL = ["panel", "roundtable", "moderated by", "featuring", "and "]
TITLE_DOUBTFUL = [r"^(The\s+)?(Story|Truth|History|Rise|Fall|Life|Legend)\s+(of|behind|about)", r"(documentary|biography|profile|exposed)\s*:?\s*$", r"^(Who|What|Why|How)\s+(is|was|are|were)\s+", r"(evil|puppet|master|exposed|destroy)"]
TEXT_INTERVIEW = ["sits down with", "conversation with", "joins", "interview", "discusses with", "speaks with", "in conversation"]
TEXT_DOCUMENTARY = ["documentary", "biography of", "the story of", "profile of", "this film", "this documentary"]
TEXT_PANEL = ["panel", "roundtable", "moderated by"]

# Display names that a slug's words don't give.
DISPLAY_NAMES = {
    "mohamed_el_erian": "Mohamed El-Erian",
    "mohamed_el-erian": "Mohamed El-Erian",
    "volodymyr_zelenskyy": "Volodymyr Zelenskyy",
    "recep_erdogan": "Recep Tayyip Erdogan",
    "lawrence_summers": "Lawrence Summers",
    "robert_shiller": "Robert Shiller",
    "marc_andreessen": "Marc Andreessen",
    "neel_kashkari": "Neel Kashkari",
    "james_mattis": "James Mattis",
    "jd_vance": "JD Vance",
    "mohamed_a_el_erian": "Mohamed A. El-Erian",
}

# Other names that speakers go by.
OTHER_NAMES = {
    "jd_vance": ["j d vance", "j.d. vance", "j.d vance", "jd vance"],
    "mohamed_el_erian": ["mohamed el erian", "mohamed el-erian"],
    "mohamed_el-erian": ["mohamed el erian", "mohamed el-erian"],
    "volodymyr_zelenskyy": ["volodymyr zelensky", "zelensky", "zelenskyy"],
    "recep_erdogan": ["recep tayyip erdogan", "erdogan"],
    "robert_shiller": ["bob shiller", "robert j shiller"],
    "lawrence_summers": ["larry summers", "lawrence summers"],
    "james_mattis": ["jim mattis", "james mattis"],
    "neel_kashkari": ["neel kashkari", "neal kashkari"],
    "marc_andreessen": ["mark andreessen", "marc andreessen"],
}


def display_name(slug: Column) -> Column:
    """A speaker's name as it is shown: the listed one, or the slug's words with capitals."""
    listed = F.create_map(*(F.lit(x) for pair in DISPLAY_NAMES.items() for x in pair))
    return F.coalesce(F.element_at(listed, slug), title_name(slug))


def exclusion(description: Column, language: Column) -> Column:
    """Why a video is left out: the first description rule that holds, then the language; '' if none."""
    d, lang = F.coalesce(F.trim(description), F.lit("")), F.lower(F.coalesce(language, F.lit("")))
    rules = [(F.regexp_like(d, F.lit(p)), F.lit(name)) for name, p in DESCRIPTION_RULES.items()]
    return first_match(*rules, (lang.isin(OTHER_LANGUAGES), F.concat(F.lit("lang:"), lang)), otherwise=F.lit(""))


def aliases(display: Column, slug: Column | None = None) -> Column:
    """Normalised names that stand for a speaker, longest first: full, first and last, a surname of five letters or more that is no plain word, initials; with a slug, its words and the listed other names."""
    full = identity_normal(display)
    parts = F.filter(F.split(full, r"\s+"), lambda p: p != "")
    last = F.element_at(parts, -1)
    many = F.size(parts) >= 2
    initials = F.array_join(F.transform(parts, lambda p: F.substring(p, 1, 1)), "")
    own = F.array(full, F.when(many, F.concat_ws(" ", F.get(parts, F.lit(0)), last)), F.when(many & (F.char_length(last) >= 5) & ~last.isin(PLAIN_SURNAMES), last), F.when(many, initials))
    if slug is not None:
        listed = F.create_map(*(x for k, v in OTHER_NAMES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
        others = F.coalesce(F.element_at(listed, slug), F.array().cast("array<string>"))
        own = F.concat(own, F.array(identity_normal(F.replace(slug, F.lit("_"), F.lit(" ")))), F.transform(others, identity_normal))
    own = F.filter(own, lambda x: F.coalesce(x, F.lit("")) != "")
    return F.array_sort(F.array_distinct(own), lambda a, b: F.when(F.char_length(a) != F.char_length(b), F.char_length(b) - F.char_length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))


def alias_hit(text: Column, names: Column) -> Column:
    """The longest alias that stands in normalised text as whole words; null if none."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    inside = lambda a: F.when(F.char_length(a) <= 2, F.regexp_like(text, F.concat(F.lit(r"\b"), a, F.lit(r"\b")))).otherwise(F.contains(padded, F.concat(F.lit(" "), a, F.lit(" "))))
    return F.get(F.filter(names, inside), F.lit(0))


def all_tokens(text: Column, display: Column) -> Column:
    """Whether all tokens of a name of two or more stand in normalised text as words."""
    tokens = F.filter(F.split(identity_normal(display), " "), lambda t: (F.char_length(t) > 1) & ~t.isin("von", "der", "de", "of", "the"))
    return (F.size(tokens) >= 2) & F.forall(tokens, lambda t: F.regexp_like(text, F.concat(F.lit(r"\b"), t, F.lit(r"\b"))))


def _near(text: Column, names: Column, patterns: list[str], reach: int, back: int | None = None) -> Column:
    """Whether a pattern stands up to `reach` characters before an alias of four letters or more (or `back` after it)."""
    some = "(?:" + "|".join(patterns) + ")"

    def hit(a: Column) -> Column:
        ahead = F.regexp_like(text, F.concat(F.lit(rf"\b{some}\b.{{0,{reach}}}\b"), a, F.lit(r"\b")))
        return ahead if back is None else ahead | F.regexp_like(text, F.concat(F.lit(r"\b"), a, F.lit(rf"\b.{{0,{back}}}\b{some}\b")))

    return F.exists(F.filter(names, lambda a: F.char_length(a) >= 4), hit)


def transcript_score(text: Column, names: Column, display: Column) -> Column:
    """Points for introductions, an early full name and repeated aliases in a normalised transcript."""
    return let(text, lambda t: _transcript_score(t, names, display))


def _transcript_score(text: Column, names: Column, display: Column) -> Column:
    early = F.substring(text, 1, 8000)
    long_names = F.filter(names, lambda a: F.char_length(a) >= 4)
    hits = F.coalesce(F.array_max(F.transform(long_names, lambda a: F.regexp_count(text, F.concat(F.lit(r"\b"), a, F.lit(r"\b"))))), F.lit(0))
    return F.when(_near(early, names, INTRODUCTIONS, 120, 80), 4).otherwise(0) + F.when(_near(early, names, SELF_INTRODUCTIONS, 40), 4).otherwise(0) + F.when(all_tokens(early, display), 3).otherwise(0) + F.when(hits >= 3, 3).when(hits >= 1, 1).otherwise(0)


def identity(title: Column, channel: Column, display: Column, names: Column, transcript: Column | None = None) -> dict[str, Column]:
    """Score, status and reasons for one video. The columns must be materialised ones: each is used many times."""
    t, ch = identity_normal(title), identity_normal(channel)
    title_alias, channel_alias = alias_hit(t, names), alias_hit(ch, names)
    title_hit, channel_hit = title_alias.isNotNull(), channel_alias.isNotNull()
    tokens = all_tokens(identity_normal(F.concat_ws(" ", title, channel)), display)
    interview, generic = contains_any(t, INTERVIEW_TERMS), contains_any(ch, NEWS_CHANNELS)
    risks = F.array_sort(F.filter(F.array(*map(F.lit, RISK_TERMS)), lambda r: F.contains(t, r)))
    none = ~(title_hit | channel_hit | tokens)
    points = lambda test, n: F.when(test, n).otherwise(0)
    meta = points(title_hit, 4) + points(channel_hit, 3) + points(tokens & ~title_hit, 3) + points(interview, 1) - points(generic & ~title_hit, 1) - F.least(F.lit(3), F.size(risks)) - points(none, 4)
    heard = transcript_score(identity_normal(transcript), names, display) if transcript is not None else F.lit(0)
    score = meta + heard
    reasons = F.array_compact(
        F.array(
            F.when(title_hit, F.concat(F.lit("title_name:"), title_alias)),
            F.when(channel_hit, F.concat(F.lit("channel_name:"), channel_alias)),
            F.when(tokens & ~title_hit, F.lit("all_name_tokens")),
            F.when(interview, F.lit("interview_or_speech_term")),
            F.when(generic & ~title_hit, F.lit("generic_news_channel_without_title_name")),
            F.when(F.size(risks) > 0, F.concat(F.lit("risk_terms:"), F.array_join(F.slice(risks, 1, 4), "|"))),
            F.when(none, F.lit("no_name_match")),
            F.when(heard > 0, F.concat(F.lit("transcript_evidence:"), heard.cast("string"))),
        )
    )
    status = F.when(score >= 4, "likely_match").when(score >= 1, "review").otherwise("high_risk")
    return {"identity_score": score, "identity_status": status, "identity_reasons": F.array_join(reasons, "; "), "transcript_score": heard}


def _reasons(*named: tuple[Column, str]) -> Column:
    """Names of the tests that hold, in order."""
    return F.array_compact(F.array(*(F.when(test, name) for test, name in named)))


def _votes(reasons: Column, *rules: tuple[Column, int | None, str, str | None]) -> Column:
    """The vote of the first rule (test, vote, confidence, reason that it adds) that holds; the last rule's test is always true."""
    made = [(test, F.struct(F.lit(tsp).cast("int").alias("tsp"), F.lit(conf).alias("conf"), (F.concat(reasons, F.array(F.lit(more))) if more else reasons).alias("reasons"))) for test, tsp, conf, more in rules]
    return first_match(*made[:-1], otherwise=made[-1][1])


def speaker_in(text: Column, name: Column) -> Column:
    """Whether lower-cased text holds a lower-case name or, of a name of several words, its last."""
    parts = F.split(name, " ")
    return (name != "") & (F.contains(text, name) | (F.size(parts) > 1) & F.contains(text, F.element_at(parts, -1)))


def vote_title(title: Column, name: Column) -> Column:
    """Votes of a title for how far a talk is in the speaker's own words, 1 to 4, with confidence and reasons."""
    t = F.lower(F.coalesce(title, F.lit("")))
    named, interview, doc, panel = speaker_in(t, name), contains_any(t, TITLE_INTERVIEW), contains_any(t, TITLE_DOCUMENTARY), contains_any(t, TITLE_PANEL)
    doubtful = F.regexp_like(t, F.lit("|".join(TITLE_DOUBTFUL)))
    why = _reasons((named, "speaker_in_title"), (interview, "interview_keyword"), (doc, "doc_keyword"), (panel, "panel_keyword"), (doubtful, "low_conf_pattern"))
    return _votes(why, (~named, 1, "low", "no_speaker_in_title"), (doubtful | doc, 2, "medium", None), (interview & ~panel, 4, "high", None), (F.lit(True), 3, "medium", None))


def vote_description(description: Column, name: Column) -> Column:
    d = F.lower(F.coalesce(description, F.lit("")))
    named = (name != "") & F.contains(d, name)
    interview, doc, panel = contains_any(d, TEXT_INTERVIEW), contains_any(d, TEXT_DOCUMENTARY), contains_any(d, TEXT_PANEL)
    why = _reasons((named, "speaker_in_desc"), (interview, "interview_in_desc"), (doc, "doc_in_desc"), (panel, "panel_in_desc"))
    return _votes(why, (d == "", None, "none", None), (doc & ~interview, 2, "high", None), (interview & named, 4, "high", "desc_confirms_interview"), (panel, 3, "medium", None), (named, 3, "low", None), (F.lit(True), None, "none", None))


def vote_transcript(text: Column, name: Column) -> Column:
    """By length, share of question marks, and whether a part of the name of over two letters is heard."""
    t = F.coalesce(text, F.lit(""))
    n = word_count(t)
    asked = F.char_length(t) - F.char_length(F.replace(t, F.lit("?"), F.lit("")))
    questions = asked / F.greatest(n, F.lit(1))
    heard = F.exists(F.split(name, " "), lambda p: (F.char_length(p) > 2) & F.contains(F.lower(t), p))
    thousandths = F.floor((asked * 2000 + n) / F.greatest(n * 2, F.lit(1))).cast("int")
    ratio = F.format_string("q_ratio=%d.%03d", F.floor(thousandths / 1000).cast("int"), thousandths % 1000)
    why = F.when(t == "", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(F.format_string("vtt_%dw", n), ratio, F.when(heard, "speaker_in_vtt"))))
    return _votes(
        why,
        (t == "", None, "none", None),
        (n < 200, 1, "high", "vtt_too_short"),
        (n < 500, 2, "medium", "vtt_short"),
        ((questions > 0.003) & heard, 4, "high", "dialogue_with_speaker"),
        (questions > 0.003, 3, "medium", "dialogue_detected"),
        ((n > 2000) & heard, 3, "low", "long_monologue"),
        (n > 5000, 3, "low", "long_vtt_no_dialogue"),
        (F.lit(True), 2, "low", "unclear_format"),
    )


def combined(title: Column, description: Column, transcript: Column) -> dict[str, Column]:
    """The weighted mean of the votes to one digit, and how far they agree. The votes must be materialised columns."""
    weight = lambda v: F.when(v["conf"] == "high", 3).when(v["conf"] == "medium", 2).otherwise(1)
    votes = F.filter(F.array(title, description, transcript), lambda v: v["tsp"].isNotNull())
    total = F.aggregate(votes, F.lit(0), lambda a, v: a + weight(v))
    mean = F.try_divide(F.aggregate(votes, F.lit(0), lambda a, v: a + v["tsp"] * weight(v)), total)
    kinds = F.size(F.array_distinct(F.transform(votes, lambda v: v["tsp"])))
    strong = F.size(F.filter(votes, lambda v: weight(v) >= 2))
    conf = F.when((kinds == 1) & (title["conf"] == "high") & (transcript["conf"] == "high"), "high").when((kinds <= 2) & (strong >= 2), "high").when(kinds <= 2, "medium").otherwise("low")
    return {"tsp": F.coalesce(F.bround(mean, 1), F.lit(1.0)), "confidence": conf}


def grade_hint(tsp: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(4), F.bround(tsp, 0).cast("int") - 1))


def filter_decision(own: dict[str, Column], cached: dict[str, Column], status: Column, identity_status: Column) -> Column:
    """verdict (passed, filtered or skipped), reason, and description and language as they are then known, of a video.

    own and cached: description and language of the entry and of the fetched metadata, where both of the latter are null if nothing was
    fetched. An entry that lacks either goes by the fetched ones: without any it passes, whatever its identity,
    and one known to be gone is skipped. Else the first description rule or the language counts, then the identity.
    """
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    bare = ~full(own["description"]) | ~full(own["language"])
    unfetched = cached["description"].isNull() & cached["language"].isNull()
    used = {k: F.when(bare, cached[k]).otherwise(own[k]) for k in own}
    rule = exclusion(used["description"], used["language"])
    reason = F.when(rule != "", rule).when(identity_status == "high_risk", "low_identity_score").otherwise("")
    verdict = first_match((bare & unfetched, F.lit("passed")), (bare & F.coalesce(status == "unavailable", F.lit(False)), F.lit("skipped")), (reason != "", F.lit("filtered")), otherwise=F.lit("passed"))
    known = {k: F.when(full(own[k]), own[k]).otherwise(F.coalesce(F.left(cached[k], F.lit(1000)), F.lit(""))) for k in own}
    return F.struct(verdict.alias("verdict"), F.when(verdict == "filtered", reason).otherwise("").alias("reason"), known["description"].alias("description"), known["language"].alias("language"))
