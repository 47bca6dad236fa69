"""Golden cases of the functions and operators, worked out by hand."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parlance.functions import evidence, lexicon, replies, tails, text
from parlance.operators import annotate, ordered, relational, segments, state, stats


def one(spark, column, **values):
    """A column over one row of literals (a filter keeps the optimiser from folding them away)."""
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'bigint'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("raw, n", [("  a  b\n", 2), ("", 0), (" \n\t ", 0), (None, 0), ("one", 1)])
def test_word_count(spark, raw, n):
    assert one(spark, text.word_count(F.col("t")), t=raw) == n


def test_sentences(spark):
    assert one(spark, text.sentences(F.col("t")), t='He left. "Why?" she asked. ok') == ["He left.", '"Why?" she asked. ok']
    assert one(spark, text.sentences(F.col("t")), t="A one!  (Two) three? Four\nfive. ") == ["A one!", "(Two) three?", "Four\nfive."]
    assert one(spark, text.sentences(F.col("t")), t="") == []


@pytest.mark.parametrize("s, want", [(3661, "1:01:01"), (59, "0:59"), (-1, "0:00"), (3600, "1:00:00")])
def test_clock(spark, s, want):
    assert one(spark, text.clock(F.col("s")), s=s) == want


@pytest.mark.parametrize("raw, want", [("20240115", "2024-01"), ("2024-03-09", "2024-03"), ("", ""), ("about yesterday", "about y"), (None, "")])
def test_month(spark, raw, want):
    assert one(spark, text.month(F.col("t")), t=raw) == want


def test_names(spark):
    assert one(spark, text.slug(F.col("t")), t=" Ada O'Neil ") == "ada_o_neil"
    assert one(spark, text.title_name(F.col("t")), t="anna_el-sayed") == "Anna El-Sayed"
    assert one(spark, text.identity_normal(F.col("t")), t="José  Ñandú, (O'Neil)!") == "jose nandu o'neil"


def labels_of(spark, sentences):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sentences)], "i int, t string")
    rows = df.select("i", *(c.alias(n) for n, c in lexicon.counts(text.keyword_clean(F.col("t"))).items()))
    return [r.asDict() for r in rows.withColumns({"valence": lexicon.valence(), "certainty": lexicon.certainty()}).orderBy("i").collect()]


def test_lexicon(spark):
    got = labels_of(spark, ["not strong", "not stable", "growth but war", "I think so", "deteriorate", "strong growth", "maybe", "of course"])
    assert (got[0]["strength_success"], got[0]["decline_destruction"], got[0]["valence"]) == (0, 1, "negative")
    assert got[1]["decline_destruction"] == 0 and got[1]["valence"] == "neutral"
    assert got[2]["valence"] == "negative" and got[3]["hedging_doubt"] == 0 and got[4]["decline_destruction"] == 2
    assert got[5]["valence"] == "positive" and got[6]["certainty"] == "low" and got[7]["certainty"] == "high"
    assert {c: len(p) for c, p in lexicon.CATEGORIES.items()} == {"Hope/Optimism": 14, "Strength/Success": 14, "Stability/Order": 8, "Fear/Anxiety": 19, "Anger/Conflict": 16, "Decline/Destruction": 37, "Crisis/Urgency": 14, "Financial/Political Risk": 19, "Emphatic/Certain": 30, "Hedging/Doubt": 25, "Intensity Boosters": 24}


def test_negation_never_adds_a_positive_hit(spark):
    rnd = random.Random(2)
    words = lexicon.NEGATABLE + ["war", "maybe", "always", "the"]
    plain = [" ".join(rnd.choice(words) for _ in range(6)) for _ in range(30)]
    negated = [s.replace(" ", " not ", 1) for s in plain]
    pos = [lexicon.column_name(c) for c in lexicon.POSITIVE]
    for a, b in zip(labels_of(spark, plain), labels_of(spark, negated)):
        assert sum(b[c] for c in pos) <= sum(a[c] for c in pos)


def test_phi(spark):
    cells = spark.createDataFrame([(1, 1, 1, 1), (2, 0, 0, 2), (3, 1, 0, 0)], "x_n11 long, x_n10 long, x_n01 long, x_n00 long")
    assert [r[0] for r in cells.select(stats.phi("x")).collect()] == [0.0, 1.0, None]


def test_line_fold(spark):
    fold = lambda *lines, strict=False: one(spark, ordered.folded(F.col("l"), strict), l=list(lines))
    assert fold("in the", "United States.") == ["in the United States."]
    assert fold("He left.", "She stayed.") == ["He left.", "She stayed."]
    assert fold("He did his best.", "Then he left.") == ["He did his best.", "Then he left."]
    assert fold("That is what we have.", "She left.") == ["That is what we have. She left."]
    assert fold("That is what we have.", "She left.", strict=True) == ["That is what we have.", "She left."]
    assert fold("I met Dr.", "Smith said so.") == ["I met Dr.", "Smith said so."]
    assert fold("well-", "known", "", "end,", "Then.", "more") == ["well-known end, Then. more"]
    assert fold() == [] and fold("", "  ") == []
    assert fold("Two words", "Next one here is long.") == ["Two words Next one here is long."]


def test_best_overlap(spark):
    segs = spark.createDataFrame([("f", 1, 0.0, 10.0), ("g", 2, 0.0, 4.0), ("h", 3, 0.0, 1.0)], "file string, seg int, start double, end double")
    turns = spark.createDataFrame([("f", 0.0, 4.0, "A"), ("f", 4.0, 9.0, "B"), ("f", 9.0, 10.0, "A"), ("g", 0.0, 2.0, "A"), ("g", 2.0, 4.0, "B"), ("h", 5.0, 6.0, "A")], "file string, start double, end double, label string")
    for bucket in (None, 3.0):
        got = {r.seg: r.label for r in relational.best_overlap(segs, turns, "file", ["seg"], bucket=bucket).collect()}
        assert got == {1: "B", 2: "A", 3: "UNKNOWN"}


def test_gaps_and_changes(spark):
    s = spark.createDataFrame([("f", i, sp, a, b, "x") for i, (sp, a, b) in enumerate([("A", 0.0, 1.0), ("A", 1.5, 2.0), ("B", 2.6, 3.0), ("A", 2.8, 4.0)])], "file string, idx int, speaker string, start double, end double, text string")
    g = ordered.gaps(s, "file", "start", "end", ["idx"]).select(F.sum("gap"), F.count_if(F.col("gap") > 0), F.sum("overlap"), F.count_if(F.col("overlap") > 0)).first()
    assert [round(x, 6) for x in g] == [0.6, 1, 0.2, 1]
    assert segments.diarization_stability(s).first().changes == 2
    assert segments.overall_grade(s, spark.createDataFrame([("f", 4.0)], "file string, duration double")).count() == 1


@pytest.mark.parametrize("b, guest, method", [(29, "A", "duration"), (30, "A", "provider")])
def test_guest(spark, b, guest, method):
    s = spark.createDataFrame([("f", 0, "A", "w " * 100), ("f", 1, "B", "w " * b), ("f", 2, "UNKNOWN", "w " * 500)], "file string, idx int, speaker string, text string")
    r = segments.guest(s).first()
    assert (r.target, r.method) == (guest, method)


def test_guest_hosted(spark):
    s = spark.createDataFrame([("f", 0, "A", "w " * 100), ("f", 1, "B", "w " * 90), ("f", 2, "C", "w " * 5)], "file string, idx int, speaker string, text string")
    r = segments.guest_hosted(s).first()
    assert (r.target, r.method) == ("A", "duration_clear")


def test_stratified_sizes(spark):
    df = spark.createDataFrame([("a", i) for i in range(25)] + [("b", i) for i in range(3)], "domain string, id int")
    out = ordered.stratified_sample(df, "domain", ["domain", "id"], 0.1).groupBy("domain").count().collect()
    assert {r.domain: r["count"] for r in out} == {"a": 2, "b": 1}
    big = spark.range(20000).select(F.lit("x").alias("domain"), "id")
    h = lambda i: __import__("hashlib").md5(f"42:{i}".encode()).hexdigest()
    want = sorted(range(20000), key=h)[:200]
    assert {r.id for r in ordered.stratified_sample(big, "domain", ["id"], 0.01).collect()} == set(want)


def test_byte_budget(spark):
    df = spark.createDataFrame([(1, 40), (2, 50), (3, 20), (4, 5)], "id int, size long")
    assert sorted(r.id for r in ordered.byte_budget(df, "size", ["id"], 100).collect()) == [1, 2]


def test_running_total_over_many_ranges(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("v"))
    got = {r.id: r.t for r in ordered.running_total(df, F.col("v"), ["id"], "t").collect()}
    total, want = 0, {}
    for i in range(5000):
        total += i % 7
        want[i] = total
    assert got == want


def test_replies(spark):
    raw = "0|Positive|hedged\n1|bad|neutral\nx|neutral|neutral\n2|neutral\n-1|neutral|neutral"
    assert [(r.idx, r.valence, r.modality) for r in one(spark, replies.labelled_lines(F.col("t")), t=raw)] == [(0, "positive", "hedged")]
    assert [(r.idx, r.text) for r in one(spark, replies.numbered_lines(F.col("t")), t="1|a|b\nno\n2|c")] == [(1, "a|b"), (2, "c")]
    score = lambda t: one(spark, replies.json_score(F.col("t")), t=t)
    assert [score(t) for t in ('{"score": 2}', 'x ```json\n{"score": 1}\n```', 'so {"score": 0, "reason": "r"} ok', '{"score": 7}', "none", None)] == [2, 1, 0, -1, -1, -1]
    assert one(spark, replies.guest_label(F.col("t")), t='Sure: {"A": "host", "B": " Guest "}') == "B"


def test_tails():
    # published values: t = 2.228 at 10 degrees of freedom is 0.05 two-sided; chi-square 3.841 at 1 and 18.307 at 10 are 0.05
    r = 2.228138852 / math.sqrt(10 + 2.228138852**2)
    assert abs(tails.pearson_p(r, 12) - 0.05) < 1e-8
    assert abs(tails.chi2_p(3.841458821, 1) - 0.05) < 1e-9 and abs(tails.chi2_p(18.30703805, 10) - 0.05) < 1e-9
    assert tails.pearson_p(0.0, 10) == pytest.approx(1) and tails.pearson_p(1.0, 10) == 0 and math.isnan(tails.pearson_p(0.5, 2))


def test_kruskal(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3)] + [("b", float(x)) for x in (4, 5, 6)], "g string, v double")
    r = stats.kruskal(df, "g", "v").first()
    assert (r.kruskal_h, r.df) == (3.8571, 1) and abs(r.p - 0.0495) < 1e-4


def test_mixed_model(spark):
    rng = np.random.default_rng(1)
    g = np.repeat(np.arange(12), 40)
    x = rng.normal(size=(480, 2))
    y = 2 * x[:, 0] - x[:, 1] + rng.normal(0, 1.5, 12)[g] + rng.normal(0, 0.5, 480)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y, "g": g}))
    r = stats.mixed_model(df, ["a", "b"], "y", "g").first()
    assert abs(r.a - 2 * x[:, 0].std()) < 0.1 and abs(r.b + x[:, 1].std()) < 0.1
    assert 0.8 < r.random_effects_var < 6 and abs(r.residual_var - 0.25) < 0.05
    assert stats.mixed_model(df.limit(5), ["a", "b"], "y", "g").first().log_likelihood is None


def test_state_machine(spark):
    ev = [("a", 1, "start"), ("a", 2, "done"), ("b", 1, "fail"), *(("c", i, "fail") for i in range(4)), ("d", 1, "start")]
    got = {r.id: r.state for r in state.latest(spark.createDataFrame(ev, "id string, seq int, event string")).collect()}
    assert got == {"a": "done", "b": "uploaded", "c": "failed", "d": "processing"}
    m = spark.createDataFrame([("a", "uploading", 0), ("b", "processing", 1), ("c", "failed", 3), ("d", "uploading", 0)], "id string, state string, retries int")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert {r.id: r.state for r in state.recovered(m, ids("a", "b"), ids("b")).collect()} == {"a": "uploaded", "b": "done", "c": "failed", "d": "pending"}
    assert {r.id: (r.state, r.retries) for r in state.reset_failed(m).collect()}["c"] == ("pending", 0) and state.retryable(m).count() == 0


def test_replace_lines(spark):
    lines = spark.createDataFrame([("f", 0, "a"), ("f", 1, "b"), ("f", 2, "c")], "v string, i int, t string")
    changes = spark.createDataFrame([("f", 1, "b", ["b1", "b2"]), ("f", 2, "was", ["x"])], "v string, i int, t string, new array<string>")
    assert [r.t for r in relational.replace_lines(lines, changes, "v", "i", "t").orderBy("i").collect()] == ["a", "b1", "b2", "c"]


def test_upsert_keeps_orphans(spark):
    new = spark.createDataFrame([("1", "new", "")], "id string, title string, lang string")
    old = spark.createDataFrame([("1", "old", "en", "x"), ("2", "gone", "de", "y")], "id string, title string, lang string, status string")
    rows = lambda keep: sorted(tuple(r) for r in relational.upsert(new, old, ["id"], ["title"], ["lang"], keep).collect())
    assert rows(False) == [("1", "new", "en", "x")] and rows(True) == [("1", "new", "en", "x"), ("2", "gone", "de", "y")]


def test_zero_delta(spark):
    from parlance.plans.statistics import moved

    assert one(spark, moved(F.col("a"), F.col("b")), a=0.0, b=0.4) == 0.0
    assert one(spark, moved(F.col("a"), F.col("b"), strict=True), a=0.0, b=0.4) == 0.4


def test_votes(spark):
    t, d, v = (spark.createDataFrame([("Interview with Ada Lovelace", "Ada Lovelace sits down with us", "word? ada " * 600)], "t string, d string, v string").select(f(F.col(c), F.lit("ada lovelace")).alias("x")).first().x for f, c in ((evidence.vote_title, "t"), (evidence.vote_description, "d"), (evidence.vote_transcript, "v")))
    assert (t.tsp, t.conf, d.tsp, d.conf, v.tsp, v.conf) == (4, "high", 4, "high", 4, "high")
    votes = spark.createDataFrame([((3, "medium"), (None, "none"), (2, "low")), ((4, "high"), (4, "high"), (4, "high"))], "a struct<tsp: int, conf: string>, b struct<tsp: int, conf: string>, c struct<tsp: int, conf: string>")
    out = votes.select(*(x.alias(n) for n, x in evidence.combined(F.col("a"), F.col("b"), F.col("c")).items())).collect()
    assert [(r.tsp, r.confidence) for r in out] == [(2.7, "medium"), (4.0, "high")]
    assert one(spark, evidence.grade_hint(F.col("t")), t=2.5) == 1 and one(spark, evidence.grade_hint(F.col("t")), t=3.5) == 3


def test_identity_transcript(spark):
    df = spark.createDataFrame([("welcome our guest is ada lovelace today lovelace lovelace", "Ada Lovelace"), ("nobody here", "Ada Lovelace"), ("i am ada lovelace", "Ada Lovelace")], "t string, d string").withColumn("a", evidence.aliases(F.col("d")))
    assert df.first().a == ["ada lovelace", "lovelace", "al"]
    got = [r.x for r in df.select(evidence.transcript_score(F.col("t"), F.col("a"), F.col("d")).alias("x")).collect()]
    assert got == [10, 0, 8]


def test_providers(spark):
    s = spark.createDataFrame([("v", 0, "strong growth, of course"), ("v", 1, "a crisis, maybe")], "video_id string, sentence_index int, text string")
    out = {r.sentence_index: (r.valence, r.modality) for r in annotate.annotate(s).collect()}
    assert out == {0: ("positive", "emphatic"), 1: ("negative", "hedged")}
    done = s.where("sentence_index = 0")
    assert [r.sentence_index for r in annotate.annotate(s, done).collect()] == [1]
    provider = lambda it: (b.assign(valence="neutral", modality=["hedged", "bad"][: len(b)] if len(b) > 1 else "hedged") for b in it)
    assert annotate.annotate(s.coalesce(1), provider=provider).count() == 1
    calls, waits = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError
        return x

    assert annotate.retried(flaky, sleep=waits.append)(5) == 5 and waits == [1, 2]
    b = ordered.batches(s, ["sentence_index"], 50)
    assert annotate.prompts(b).first().prompt == "0. strong growth, of course\n1. a crisis, maybe"
