import pytest

SENTENCE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone twentytwo"
PASSAGE = " ".join(f"word{i}x" for i in range(90))


def texts():
    """Nulls, empties, ties, repeats, copies and near copies, long words and long texts."""
    own = lambda a, n: " ".join(f"t{a}w{i}" for i in range(n))
    near = own(7, 60).split()
    return [
        None,
        "",
        "   \t\n\r\x0b\x0c ",
        "a",
        "a b c",
        "a b c",
        SENTENCE,
        SENTENCE + " " + SENTENCE,
        own(1, 40) + " " + PASSAGE + " " + own(2, 30),
        PASSAGE + "\n" + own(3, 25),
        own(4, 25) + "\n" + PASSAGE,
        own(5, 50),
        own(5, 50),
        own(5, 50) + " ",
        " ".join(near),
        " ".join([*near[:59], "changed"]),
        " ".join([*near[:20], "other", *near[21:]]),
        "x " * 2000,
        "aB " * 700 + "tail",
        "z" * 5000,
        "The The The The " * 12,
        "Line one is here\nLine one is here\n\nLine two\nLine one is here\n \n",
        "Released under the MIT License. Apache License, Version 2.0! CC BY-NC 4.0, cc by nc",
        "UNDER\x00THE-MIT license İ É é ß 漢字 \U0001F600 mit license",
        "Don't  stop'll  \n\n 'tis   1234's <|endoftext|> ok ",
        " ".join(f"w{i % 7}" for i in range(300)),
        "### $$$ %%% &&& | < > " * 10,
        own(8, 3000),
        own(8, 1500) + " " + own(9, 1500),
        "é" * 450 + "q" + "é" * 450,
    ]


@pytest.fixture(scope="session")
def rows():
    return list(enumerate(texts()))


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names clash with the operators' own."""
    data = [(i, t, ["en", "de", None][i % 3], f"s{i % 2}", 1, "n", -1, "key") for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n int, words string, at int, key string").repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
