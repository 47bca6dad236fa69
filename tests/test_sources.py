"""Readers, writers and streams on small files."""

import json

import pytest

from parlance.sources import files
from parlance.streaming import labels


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "1", "state": "done"}\n\n{"id": "2"\n{"id": "3", "state": "failed"}\n')
    assert sorted(r.id for r in files.jsonl(spark, str(p), "id string, state string", strict=False).collect()) == ["1", "3"]
    with pytest.raises(Exception):
        files.jsonl(spark, str(p), "id string, state string").collect()
    assert files.jsonl(spark, str(tmp_path / "none.jsonl"), "id string").count() == 0


def test_documents(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"v1": "2024-01", "v2": "2024-02"}')
    assert {r.key: r.value for r in files.json_map(spark, str(tmp_path / "m.json")).collect()} == {"v1": "2024-01", "v2": "2024-02"}
    for sp, rows in (("ann", [{"id": "1", "title": "t"}, {"id": ""}]), ("bob", None)):
        (tmp_path / "s" / sp).mkdir(parents=True)
        (tmp_path / "s" / sp / "video_list.json").write_text(json.dumps(rows) if rows else "not json")
    assert [(r.id, r.title, r.speaker) for r in files.directory_arrays(spark, str(tmp_path / "s")).collect()] == [("1", "t", "ann")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "v1.json").write_text(json.dumps({"duration": 9.0, "segments": [{"start": 0.0, "end": 1.0, "text": "hi", "speaker": "A"}, {"start": 1.0, "end": 2.0, "text": "yo"}]}))
    (tmp_path / "t" / "v2.json").write_text('{"duration": 1.0}')
    assert [(r.file, r.idx, r.speaker) for r in files.transcripts(spark, str(tmp_path / "t")).orderBy("idx").collect()] == [("v1", 0, "A"), ("v1", 1, None)]


def test_transcript_lines(spark, tmp_path):
    said = lambda name, *texts: json.dumps({"filename": name, "duration": 9.0, "segments": [{"start": 0.0, "end": 1.0, "text": x, "speaker": "A"} for x in texts]})
    (tmp_path / "many.txt").write_text("\n".join([said("v1", "a\nb", "c"), '{"duration": 1.0}', "no json", said("v2", "d"), said(None, "e")]))
    got = sorted(((r.file, r.idx, r.text) for r in files.transcripts(spark, str(tmp_path), lines=True).collect()), key=str)
    assert got == sorted([("v1", 0, "a\nb"), ("v1", 1, "c"), ("v2", 0, "d"), (None, 0, "e")], key=str)
    (tmp_path / "array").mkdir()
    (tmp_path / "array" / "own.json").write_text(f"[{said('v1', 'a')},\n {said(None, 'b')}]")
    assert [(r.file, r.text) for r in files.transcripts(spark, str(tmp_path / "array")).orderBy("text").collect()] == [("v1", "a"), ("own", "b")]


def test_transcript_files_follow_tasks(spark, tmp_path, monkeypatch):
    from parlance.plans import roundtrips

    monkeypatch.setattr(roundtrips, "shared_dir", lambda spark, name: str(tmp_path / name))
    docs = [(c, t, "user" if t else None, None if t == 2 else f" x  {c} ") for c in [*range(60), None] for t in range(3)]
    spark.createDataFrame(docs, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "in" / "conversations.parquet"))
    got = sorted(((r.file, r.idx, r.speaker, r.start, r.end, r.text) for r in roundtrips.transcript_rows(spark, str(tmp_path / "in")).collect()), key=str)
    want = [(None if c is None else str(c), t, role, t * 1.0, t + 0.5, "" if x is None else f"x {c}") for c, t, role, x in docs]
    assert got == sorted(want, key=str)
    written = [p for p in (tmp_path / "transcripts").rglob("part-*")]
    assert 0 < len(written) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_texts(spark, tmp_path):
    (tmp_path / "v1.txt").write_text("One.\n\n  Two. \nmore\n")
    assert [(r.video_id, r.sentence_index, r.sentence) for r in files.lines(spark, str(tmp_path)).orderBy("sentence_index").collect()] == [("v1", 0, "One."), ("v1", 2, "Two."), ("v1", 3, "more")]
    assert [r.paragraph for r in files.paragraphs(spark, str(tmp_path)).orderBy("idx").collect()] == ["One.", "Two. more"]
    (tmp_path / "x.m4a").write_text("x")
    assert [r.id for r in files.file_ids(spark, str(tmp_path), [".m4a"]).collect()] == ["x"]


def test_names_and_months(spark, tmp_path):
    for name, body in (("a.txt", "Ann\n\nBob\nAnn\n"), ("b.json", '["Ann", "Bob"]'), ("c.jsonl", '{"speaker": "Ann"}\n{"speaker": "Bob"}\n')):
        (tmp_path / name).write_text(body)
        assert [r.name for r in files.names(spark, str(tmp_path / name)).orderBy("pos").collect()] == ["Ann", "Bob"]
    (tmp_path / "l" / "ann").mkdir(parents=True)
    for n in ("2024-01", "_notes"):
        (tmp_path / "l" / "ann" / f"{n}.jsonl").write_text('{"video_id": "v", "valence": "negative"}\n')
    assert [(r.speaker, r.ym, r.valence) for r in files.month_labels(spark, str(tmp_path / "l")).collect()] == [("ann", "2024-01", "negative")]


VTT = "WEBVTT\nKind: captions\nLanguage: en\n\n00:00:01.000 --> 00:00:02.000\n>> hello &amp; <c>welcome</c>\n\n00:00:02.000 --> 00:00:03.000\nhello there\n\n00:00:03.000 --> 00:00:04.000\nhello there\n"


@pytest.mark.parametrize("mode, want", [("identity", "hello & welcome hello there"), ("plain", "Kind: captions Language: en >> hello &amp; welcome hello there hello there"), ("audit", "hello there")])
def test_captions(spark, tmp_path, mode, want):
    (tmp_path / "v.en.vtt").write_text(VTT)
    r = files.captions(spark, str(tmp_path), mode).first()
    assert (r.video_id, r.text) == ("v", want)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("v", 1, "b"), ("v", 0, "é")], "video_id string, idx int, sentence string")
    files.write_jsonl(df, str(tmp_path / "j"))
    assert files.jsonl(spark, str(tmp_path / "j"), "video_id string, idx int, sentence string").count() == 2
    files.write_texts(df, str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t"), wholetext=True).select("value").collect()] == ["é\nb\n"]
    turns = spark.createDataFrame([("f", 1, "B", "yes"), ("f", 0, "A", "so")], "file string, run int, speaker string, text string")
    files.write_speaker_turns(turns, str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s"), wholetext=True).first().value == "[A]\nso\n\n[B]\nyes\n"
    assert json.loads(files.report(df.orderBy("idx")))[0]["sentence"] == "é"


def test_label_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"ts": f"2024-01-0{d}T10:00:00", "valence": "negative", "modality": "hedged"} for d in (1, 1, 2, 9)]
    (src / "a.json").write_text("\n".join(map(json.dumps, rows)))
    run = lambda: labels.append(labels.daily_counts(labels.stream(spark, str(src), "ts string, valence string, modality string")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (src / "b.json").write_text(json.dumps({"ts": "2024-01-20T00:00:00", "valence": "neutral", "modality": "neutral"}))
    run()
    run()  # resumes after what is done
    got = {(str(r.day)[:10], r.n) for r in spark.read.schema("day timestamp, n long").json(str(tmp_path / "out")).collect()}
    assert got == {("2024-01-01", 2), ("2024-01-02", 1), ("2024-01-09", 1)}


def test_manifest_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = tmp_path / "in"
    src.mkdir()
    schema = "id string, seq int, event string"
    (src / "a.json").write_text("\n".join(json.dumps({"id": i, "seq": s, "event": e}) for i, s, e in [("a", 1, "start"), ("b", 1, "fail")]))
    events = labels.stream(spark, str(src), schema, files=1)
    run = lambda: labels.manifest(events).writeStream.outputMode("update").foreachBatch(lambda df, n: seen.update({r.id: (r.state, r.failures) for r in df.collect()})).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    seen: dict = {}
    run()
    (src / "b.json").write_text("\n".join(json.dumps({"id": i, "seq": s, "event": e}) for i, s, e in [("a", 2, "done"), ("b", 2, "fail"), ("b", 3, "fail"), ("b", 4, "fail")]))
    run()
    assert seen == {"a": ("done", 0), "b": ("failed", 4)}


def test_config():
    from parlance.sources import config

    env = {"SET": "1"}
    config.dotenv("# note\nA=x y \nB = \"q=1\"\nSET=2\nnothing\nC='z'\nD=\n", env)
    assert env == {"SET": "1", "A": "x y", "B": "q=1", "C": "z", "D": ""}
    assert config.output_name("p", "/x/sample_manifest_0.01_v3.jsonl") == "p_annotations_default_0.01_v3.jsonl"
    assert config.output_name("p", "own.jsonl", thinking=True) == "p_annotations_thinking_own.jsonl"
    assert config.provider_parameters("reasoning", True) == {"reasoning": {"effort": "xhigh"}} and config.provider_parameters(None, True) == {}


def test_crawl_rows(spark):
    rows = [(0, 0, "a", None, " T ", "20240105", 61.0, "", "up", "d", None), (1, 0, "a", "other", "x", "20240105", 61.0, "c", "u", "d", "en"), (1, 1, "b", "Full", "t", "2024-03-01", 4000.0, "ch", "u", None, "en"), (1, 2, "", "n", "n", "", 61.0, "", "", "", ""), (1, 3, "c", "n", "n", "", 10.0, "", "", "", "")]
    raw = spark.createDataFrame(rows, "query_idx int, pos int, id string, fulltitle string, title string, upload_date string, duration double, channel string, uploader string, description string, language string")
    got = [tuple(r) for r in files.crawl_rows(raw, min_seconds=10).collect()]
    assert got == [("b", "Full", "2024-03", "1:06:40", "ch", "", "en"), ("a", "T", "2024-01", "1:01", "up", "d", "")]
    errors = spark.createDataFrame([("ERROR: Video unavailable",), ("timeout",)], "e string")
    assert [r[0] for r in errors.select(files.fetch_status(errors.e)).collect()] == ["unavailable", "failed"]


def test_speakers(spark, tmp_path):
    for d, sub in (("ann", "transcripts"), (".hidden", "transcripts"), ("bob", "audio")):
        (tmp_path / d / sub).mkdir(parents=True)
        (tmp_path / d / sub / "f.txt").write_text("x")
    assert [r.speaker for r in files.speakers(spark, str(tmp_path)).collect()] == ["ann"]
