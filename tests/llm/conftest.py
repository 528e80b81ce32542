import random

import pytest
from corpus_made import prose


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and extra columns whose names clash."""
    rng = random.Random(5)
    base = prose(rng, 120)
    words = base.split()
    near = words[:]
    near[7] = "changed"
    long = prose(rng, 30_000)
    quote = " ".join(words[10:30])
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), None, "b"), (4, None, "fr", None), (5, "", None, "a"), (6, long, "de", "a"), (7, "one", "en", "c"),
        (8, prose(rng, 40), "en", "b"), (8, prose(rng, 40), "en", "b"), (9, base, None, None), (9, base, None, None), (None, prose(rng, 25), "en", "a"), (10, "\t \n", "en", "a"),
        (11, prose(rng, 60) + " " + quote + " " + prose(rng, 60), "en", "a"), (12, "É Ü ñ ß İ ſ 𝔘 ☃ é", "de", "a"), (13, "same same same same same same same same same same same same", "en", "b"),
    ]
    wide = [(*r, None if r[1] is None else len(r[1]), "x", 1, 2.0, True) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, p string, n_words int, score double, held_out boolean"
    return spark.createDataFrame(wide, schema)


@pytest.fixture(scope="session")
def folder(spark, odd_docs, tmp_path_factory):
    """A folder of tables: the odd documents, benchmark, labels and pages with odd rows; and one of empty tables."""
    at = tmp_path_factory.mktemp("tables")
    words = odd_docs.where("doc_id = 1").first()["text"].split()
    tables = {
        "documents": odd_docs,
        "benchmark": spark.createDataFrame([(1, " ".join(words[10:25]).upper()), (2, " ".join(words[12:22])), (3, None), (4, ""), (5, "one"), (5, "one"), (None, "one")], "item_id long, text string"),
        "labels": spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (None, None, None), (99, 1, 1), (7, None, 0)], "doc_id long, quality int, toxic int"),
        "pages": spark.createDataFrame(
            [(1, "HTTP://Sub.Example.NET/en/x?q#f"), (2, "https://a.example.net/de/"), (3, "http://example.com/de/1"), (4, "http://x.org/fr/"), (5, "http://notnet/"), (6, None), (7, "no scheme"), (8, ""),
             (9, "http://net"), (9, "http://net/"), (None, "ftp://b.net:80/x"), (10, "http://casino-x.example.com/a"), (11, "http://" + "l" * 5000 + ".example.com/" + "p" * 5000)], "page_id long, url string"),
    }
    for name, df in tables.items():
        df.coalesce(2).write.parquet(f"{at}/full/{name}.parquet")
        df.limit(0).write.parquet(f"{at}/none/{name}.parquet")
    return at
