"""Quality rules, decontamination and license scans against brute force."""

import pytest
from pyspark.sql import functions as F

from parlance.llm import decontamination, license_scan, quality_rules

from . import brute


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def pairs(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


def test_measures(docs, rows, real, nothing):
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert got(quality_rules.verdicts(docs), *cols) == sorted(brute.op1(rows), key=str)
    assert got(quality_rules.verdicts(real), *cols) == sorted(brute.op1(pairs(real)), key=str)
    assert quality_rules.verdicts(nothing).count() == 0


def test_thresholds_adapt(spark):
    """A source whose texts all have many symbols keeps them; the same share is odd in another source."""
    clean, noisy = "word " * 30, "wo#d " * 30
    data = [(i, " ".join(f"{w}{i}{j}" for j, w in enumerate((clean if i % 2 else noisy).split())), "en", "plain" if i % 2 else "code") for i in range(600)]
    data.append((600, " ".join(f"wo#d{j}" for j in range(30)), "en", "plain"))
    out = {r.doc_id: r.kept for r in quality_rules.verdicts(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    assert out[600] is False and all(v for k, v in out.items() if k < 600)


def test_limits_differ(spark):
    """No limit is one fixed number: each rate has several over the groups of sf0.1."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    limits = quality_rules.limits(quality_rules.sketches(quality_rules._with_rates(d).where("not base_failed"))).collect()
    assert all(len({r[f"max_{k}"] for r in limits}) > 1 for k in quality_rules.RATES)


def test_keep_documents_by_row(spark, docs, nothing):
    """Rows that share a doc_id, or have none, are judged by their own text; clashing columns stay."""
    good = " ".join(f"word{i}" for i in range(60))
    data = [(1, good, "en", "s", 1, 2), (1, "too short", "en", "s", 3, 4), (None, good + " more", "en", "s", 5, 6), (None, None, None, None, 7, 8), (1, good, "en", "s", 1, 2)]
    own = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_words int, row int")
    kept = quality_rules.keep_documents(own)
    assert kept.columns == own.columns and sorted(map(str, kept.collect())) == sorted(map(str, (r for r in own.collect() if r.text and len(r.text) > 20)))
    assert quality_rules.keep_documents(docs).columns == docs.columns and quality_rules.keep_documents(nothing).count() == 0


def test_sketch_bucket(spark):
    rows = spark.range(5000).select("id", quality_rules.bucket(F.col("id")).alias("b")).collect()
    assert all(r.b <= r.id <= r.b * (1 + 2**-quality_rules.GRAIN_BITS) for r in rows) and all(r.b == r.id for r in rows[:64])


ITEMS = [(1, "word3x word4x, word5x WORD6X word7x word8x word9x word10x word11x word12x word13x word14x word15x word16x"), (2, "Line two"), (3, None), (4, ""), (10, "line TWO"), (5, "t5w3 t5w4 t5w5 t5w6 t5w7 t5w8 t5w9 t5w10 t5w11 t5w12 t5w13 t5w14 t5w15")]


@pytest.mark.parametrize("limit", [10**6, 0])
def test_decontamination(spark, docs, rows, real, limit):
    cols = ["doc_id", "n_words", "n_hit", "n_items", "sha", "contaminated"]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    named = lambda d: d.withColumn("sha", F.sha2(F.array_join("items", ","), 256))
    assert got(named(decontamination.report(docs, bench, limit)), *cols) == sorted(brute.op6(rows, ITEMS), key=str)
    own = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert got(named(decontamination.report(real, own, limit)), *cols) == sorted(brute.op6(pairs(real), [(r.item_id, r.text) for r in own.collect()]), key=str)


def test_decontaminate(spark, docs, rows, nothing):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    bad = {r[0] for r in brute.op6(rows, ITEMS) if r[5]}
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - bad
    spans = {r.doc_id: r.text for r in decontamination.decontaminate(docs, bench, spans=True).collect()}
    assert set(spans) == {i for i, _ in rows} and all(r[2] == 0 for r in brute.op6(list(spans.items()), ITEMS))
    assert all(spans[i] == t for i, t in rows if brute.op6([(i, t)], ITEMS)[0][2] == 0)
    assert decontamination.report(nothing, bench).count() == 0 and decontamination.report(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_repeated_rows(spark, docs, rows):
    twice = docs.unionByName(docs)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.report(twice, bench).count() == license_scan.scan(twice).count() == quality_rules.verdicts(twice).count() == 2 * len(rows)


def test_license_base(docs, rows, real, nothing):
    cols = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    assert got(license_scan.scan(docs), *cols) == sorted(brute.op8(rows), key=str)
    assert got(license_scan.scan(real), *cols) == sorted(brute.op8(pairs(real)), key=str)
    assert license_scan.scan(nothing).count() == 0


def test_license_templates(spark):
    text = "x y Permission is hereby granted, free of charge, to any person obtaining a copy of THIS software and associated documentation files z"
    out = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame([(1, text), (2, "GNU General Public License, version 3."), (3, "hereby granted")], "doc_id long, text string")).collect()}
    assert (out[1].labels, out[1].base_labels, out[1].score) == ("mit", "", 1.0) and out[2].labels == "gpl-3" and (out[3].labels, out[3].score) == ("", 0.0)
