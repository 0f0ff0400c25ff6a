import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="session")
def vocabulary():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def documents(spark):
    """Every text of the smallest table, with nulls, empty and odd texts, repeated rows, and columns that clash."""
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    odd = [(100000, None, None, None, None), (100001, "", "en", None, 0), (100002, " \n\t ", None, "src0", 4), (100003, "one", "en", "src0", 3), (100003, "one", "en", "src0", 3), (None, "lost id words here now", "en", "src0", 21), (100004, "É<|endoftext|>A, B. <|ENDOFTEXT|>́x", "en", "src0", 30), (100005, "long " * 30000 + "z" * 9000, "en", "src0", 159000)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {c: F.lit("x") for c in ("fp", "ids", "decoded", "node", "blob", "spans", "length", "score", "evidence", "host", "path", "part", "y", "bucket", "_blob", "_spans", "_clean", "_first", "h", "p", "row")}
    return df.withColumns(extra).repartition(3).cache()


@pytest.fixture(scope="session")
def plain(documents):
    return [(r.doc_id, r.text or "") for r in documents.collect()]


@pytest.fixture(scope="session")
def empty(documents):
    return documents.limit(0)
