"""Repeated rows in several batches, whose replies have equal keys."""

import random

from parlance.llm import suffix_dedup

from . import brute
from .test_repeats import COLS10, got


def test_repeated_rows_ask_for_a_third_document(spark):
    """Two copies of a row in two partitions; a third document shares a passage in another context."""
    rnd = random.Random(11)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    copies, others = [], []
    for i in range(40):
        passage = word(430)
        copies.append((i, word(300) + passage + word(300)))
        others.append((1000 + i, word(200) + passage + word(200)))
    apart = lambda rows: spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "doc_id long, text string")
    df = apart(copies + copies + others)
    assert got(suffix_dedup.report(df), *COLS10) == sorted(brute.op10(copies + copies + others))
    # null ids too: the same context at the same place
    copies, others = [(None, t) for _, t in copies], [(None, t) for _, t in others]
    df = apart(copies + copies + others)
    key = lambda r: r[1:]
    assert sorted(map(tuple, suffix_dedup.report(df).select(*COLS10).collect()), key=key) == sorted(brute.op10(copies + copies + others), key=key)
