"""Queries that cover whole tables, without a choice of rows by id."""

from pyspark.sql import functions as F

from parlance.functions import evidence
from parlance.operators import ordered
from parlance.plans import catalogue, corpus

SF = "/root/testdata/sf0.001"


def size(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").count()


def test_bag_union_whole(spark):
    rows = catalogue.QUERIES["bag_union"](spark, SF).groupBy("part").count().collect()
    assert size(spark, "customer") > 100
    assert {r.part: r["count"] for r in rows} == {1: size(spark, "supplier"), 2: size(spark, "customer")}


def test_canned_descriptions(spark):
    want = ["repost_documentary", "about_person_not_by", "news_report_about", "doc_trope", "about_person_not_by", "", "lang:de"]
    rows = list(zip(corpus._DESCRIPTIONS, ["en"] * 6 + ["DE"], want))
    df = spark.createDataFrame(rows, "d string, l string, want string")
    assert [r.got for r in df.select(evidence.exclusion(F.col("d"), F.col("l")).alias("got")).collect()] == want


def test_rule_classifier_whole(spark, tmp_path):
    """A rule's phrase counts in every document, and behind character 1,000."""
    rows = [(i, "x " * 800 + "the untold story", "en", "s") for i in range(8)] + [(8, None, "fr", "s"), (9, "plain", None, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.reason for r in catalogue.QUERIES["rule_classifier"](spark, str(tmp_path)).collect()}
    assert got == {i: "doc_trope" for i in range(8)} | {8: "lang:fr", 9: ""}


def test_identity_reads_every_transcript(spark, tmp_path):
    """Evidence in the html of any page counts; a missing transcript adds nothing."""
    said = "welcome our guest is ada lovelace today"
    spark.createDataFrame([(i, "u", said if i < 12 else None) for i in range(24)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = {r.page_id: r for r in catalogue.QUERIES["identity_with_transcript"](spark, str(tmp_path)).collect()}
    assert all(rows[i].transcript_score > 0 for i in range(12)) and all(not rows[i].transcript_score for i in range(12, 24))
    assert [rows[i].identity_score - rows[i].transcript_score for i in range(12)] == [rows[i].identity_score for i in range(12, 24)]


def test_stratified_sample_of_nulls_and_shared_keys(spark):
    """A null stratum is sampled, and rows of one hash are enough for their stratum."""
    rows = [(i, None) for i in range(1000)] + [(i, "en") for i in range(1000)]
    rows += [(7, f"same{k}") for k in range(3) for _ in range(1000)] + [(k, f"key{k}") for k in range(100, 120) for _ in range(1000)] + [(None, "none")] * 1000
    df = spark.createDataFrame(rows, "doc_id long, lang string")
    got = {r.lang: r["count"] for r in ordered.stratified_sample(df, "lang", ["doc_id"], 0.1).groupBy("lang").count().collect()}
    assert got == {lang: 100 for _, lang in rows}
    assert ordered.stratified_sample(df, "lang", ["doc_id"], 0.1).columns == df.columns


def test_upsert_refresh_whole(spark):
    """Every customer returns, those of each rest of the key."""
    rows = catalogue.QUERIES["upsert_refresh"](spark, SF).collect()
    assert sorted(r.id for r in rows) == sorted(r.c_custkey for r in spark.read.parquet(f"{SF}/customer.parquet").collect())


def test_manifest_reconcile_whole(spark):
    """Each order is counted once, and no rest of the order key is left out of any action."""
    out = {r.action: r.n for r in catalogue.QUERIES["manifest_reconcile"](spark, SF).collect()}
    assert sum(out.values()) == size(spark, "orders") and all(out[a] for a in ("done", "keep", "new", "missing"))


def test_lexicon_negation_whole(spark):
    """A row for each document besides the fixed sentences."""
    rows = catalogue.QUERIES["lexicon_negation"](spark, SF)
    assert rows.where("id >= 0").count() == size(spark, "documents") and rows.where("id < 0").count() == len(corpus.NEGATION_ROWS)
