"""Overrides, reasons, prompts, reports, rewrites, dimensions and polling, on fixed cases."""

import json

import pytest
from pyspark.sql import functions as F

from parlance.functions import evidence, replies
from parlance.operators import annotate, state
from parlance.sources import dimensions, files
from parlance.streaming import labels


def test_overrides(spark):
    slugs = ["mohamed_el_erian", "jd_vance", "ray_dalio", "recep_erdogan"]
    rows = spark.createDataFrame([(s,) for s in slugs], "slug string").withColumn("display", evidence.display_name(F.col("slug")))
    out = {r.slug: (r.display, r.a) for r in rows.select("slug", "display", evidence.aliases(F.col("display"), F.col("slug")).alias("a")).collect()}
    assert out["mohamed_el_erian"] == ("Mohamed El-Erian", ["mohamed el erian", "mohamed el-erian", "el-erian", "me"])
    assert out["jd_vance"] == ("JD Vance", ["j d vance", "jd vance", "vance", "jv"])
    assert out["ray_dalio"] == ("Ray Dalio", ["ray dalio", "dalio", "rd"])
    assert out["recep_erdogan"][1] == ["recep tayyip erdogan", "recep erdogan", "erdogan", "rte"]


def test_vote_reasons(spark):
    df = spark.createDataFrame([("Panel: Lovelace and others with guests", "", "a? b ada " * 300)], "t string, d string, v string")
    name = F.lit("ada lovelace")
    r = df.select(evidence.vote_title(F.col("t"), name).alias("t"), evidence.vote_description(F.col("d"), name).alias("d"), evidence.vote_transcript(F.col("v"), name).alias("v")).first()
    assert r.t.reasons == ["speaker_in_title", "interview_keyword", "panel_keyword"] and r.t.tsp == 3
    assert (r.d.tsp, r.d.conf, r.d.reasons) == (None, "none", [])
    assert r.v.reasons == ["vtt_900w", "q_ratio=0.333", "speaker_in_vtt", "dialogue_with_speaker"]


def test_guest_label(spark):
    df = spark.createDataFrame([('x {"Speaker 01": "Guest", "SPEAKER_00": "host"}',), ("none",), ('{"other": "guest"}',)], "t string")
    known = F.array(F.lit("UNKNOWN"), F.lit("SPEAKER_01"), F.lit("SPEAKER_00"))
    assert [r[0] for r in df.select(replies.guest_label(F.col("t"), known)).collect()] == ["SPEAKER_01", None, None]


def test_prompts(spark):
    rows = [("f", i, "B", f"b{i}") for i in range(50)] + [("f", 99, "A", "y" * 2000), ("f", 100, "UNKNOWN", "no")]
    got = annotate.speaker_prompts(spark.createDataFrame(rows, "file string, idx int, speaker string, text string")).first().prompt
    want = "--- A ---\n" + "y" * 1200 + "\n\n--- B ---\n" + "\n".join(f"b{int(i * 50 / 20)}" for i in range(20))
    assert got == want
    long = spark.createDataFrame([(0, 2, "second"), (0, 1, "first")], "batch_id int, idx int, text string")
    assert annotate.segment_prompts(long).first().prompt == "--- Segment 1 ---\nfirst\n\n--- Segment 2 ---\nsecond"


def test_open_for(spark):
    v = spark.createDataFrame([("a", None), ("b", "audio_failed"), ("c", "filtered"), ("", None), ("d", "selected")], "id string, status string")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(state.open_for(v, "captions")) == ["a", "d"] and ids(state.open_for(v, "rules")) == ["a", "b", "d"]
    assert ids(state.open_for(v, "selection", spark.createDataFrame([("a",)], "id string"))) == ["d"]


def test_transcript_errors(spark, tmp_path):
    for n, t in (("good", '{"filename": "x", "segments": []}'), ("report", '{"score": 1}'), ("bad", "{oops"), ("list", "[1]")):
        (tmp_path / f"{n}.json").write_text(t)
    got = {r.file: r.error for r in files.transcript_errors(spark, str(tmp_path)).collect()}
    assert set(got) == {"report", "bad", "list"} and "segments" in got["report"] and "object" in got["bad"]


def test_rewritten(spark, tmp_path):
    path, old = str(tmp_path / "t"), str(tmp_path / "backup")
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string").write.json(path)
    rows = lambda p: sorted((r.id, r.s) for r in spark.read.schema("id int, s string").json(p).collect())
    files.rewritten(spark.read.schema("id int, s string").json(path).withColumn("s", F.upper("s")), path, old)
    assert rows(path) == [(1, "A"), (2, "B")] and rows(old) == [(1, "a"), (2, "b")]
    files.rewritten(spark.read.schema("id int, s string").json(path).where("id = 1"), path)
    assert rows(path) == [(1, "A")] and sorted(p.name for p in tmp_path.iterdir()) == ["backup", "t"]


def test_report(spark, tmp_path):
    rows = [("fin", "s", "v1", 0, "clean", 2, "ok"), ("fin", "s", "v1", 1, "split", -1, "failed"), ("art", "s", "v2", 0, "clean", 0, None)]
    lines = files.audit_lines(spark.createDataFrame(rows, "domain string, speaker string, video_id string, pos int, stage string, score int, reason string"))
    files.write_report(lines, str(tmp_path / "r"))
    got = "\n".join(r.value for r in spark.read.text(str(tmp_path / "r")).collect())
    want = ["Pipeline Quality Audit Report", "=" * 60, "", "[art] s/v2", "  clean: score=0  ", "", "[fin] s/v1", "  clean: score=2  ok", "  split: score=?  failed", ""]
    assert got == "\n".join(want)


def test_dimensions(spark):
    assert dimensions.speakers(spark).count() == 125 and [r.domain for r in dimensions.domains(spark).orderBy("domain_ord").collect()][0] == "finance"
    assert {r.domain for r in dimensions.speakers(spark).collect()} <= {r.domain for r in dimensions.domains(spark).collect()} and dimensions.events(spark).count() == 6
    got = dimensions.with_domain(spark.createDataFrame([("ray_dalio", 1), ("new_one", 2)], "speaker string, n int")).orderBy("n").collect()
    assert [(r.display, r.domain) for r in got] == [("Ray Dalio", "finance"), ("New One", "unknown")]


@pytest.mark.parametrize("every", [None, 1.0])
def test_poll(spark, tmp_path, every):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src, said = tmp_path / "in", []
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps({"id": i, "seq": s, "event": e}) for i, s, e in [("a", 1, "start"), ("b", 1, "fail"), ("a", 2, "done"), ("b", 2, "done")]))
    events = labels.stream(spark, str(src), "id string, seq int, event string")
    out = labels.poll(events, str(tmp_path / "s"), str(tmp_path / "cp"), said.append, every=every)
    assert out == {"done": 2} == said[-1]
    assert {r.id: r.failures for r in labels.states(spark, str(tmp_path / "s")).collect()} == {"a": 0, "b": 1}


def test_counts_of_groups_are_those_of_patterns():
    """Each pattern stands in one group; on all of their words and mixtures, a group's matches are the sum of its patterns'."""
    import random
    import re

    from parlance.functions import lexicon

    rnd = random.Random(3)
    words = sorted({w.rstrip("*") for ps in lexicon.CATEGORIES.values() for p in ps for w in lexicon._word_forms(p) or ()})
    assert len(words) > 200 and lexicon._word_forms(r"\bimprov(e|ed|ement)\b") == {"improve", "improved", "improvement"} and lexicon._word_forms(r"\bcrisis|cr(ises|isis)\b") is None
    texts = words + [w + "s" for w in words] + [" ".join(rnd.choice(words + ["the", "of course", "opportunityhub", "de-globalization"]) + rnd.choice(["", "", "-", "/"]) for _ in range(30)) for _ in range(300)]
    for ps in lexicon.CATEGORIES.values():
        groups = lexicon.counted_together(ps)
        assert sorted(p for g in groups for p in g) == sorted(ps) and len(groups) < len(ps)
        for g in groups:
            if len(g) > 1:
                one = re.compile(lexicon._any_of(g))
                assert all(sum(1 for _ in one.finditer(t)) == sum(len(re.findall(f"(?:{p})", t)) if "(" not in p else sum(1 for _ in re.finditer(p, t)) for p in g) for t in texts)
