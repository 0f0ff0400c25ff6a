import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from litlode.llm import packing, queries, quality, secrets, toxicity

from test_similar import survivors

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def test_stages_by_hand(spark, tmp_path, vocabulary):
    """Each stage against its operator's decisions over all that the stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    stages = [f for _, f in corpus_pipeline.STAGES]

    def through(k, df):
        stages[k](spark, df, SF).write.parquet(str(tmp_path / str(k)))
        return spark.read.parquet(str(tmp_path / str(k)))

    good = through(0, docs)
    rated = quality.rate(docs, quality.fit(docs, labels))
    assert good.columns == columns and {r[0] for r in good.select("doc_id").collect()} == {r[0] for r in rated.filter("kept").select("doc_id").collect()}
    clean = through(1, good)
    told = toxicity.severity(good, toxicity.fit(good, labels))
    assert {r[0] for r in clean.select("doc_id").collect()} == {r[0] for r in told.filter("not toxic").select("doc_id").collect()}
    once = through(2, clean)
    assert sorted(r[0] for r in once.select("doc_id").collect()) == survivors([(r.doc_id, r.text) for r in clean.collect()])
    safe = through(3, once)
    assert safe.columns == columns and safe.count() == once.count()
    assert secrets.secrets_digest(safe).agg(F.max(F.length("spans"))).first()[0] == 0
    packed = through(4, safe)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter(f"n > {packing.CAPACITY}").count() == 0
    assert packed.select("doc_id").distinct().count() == safe.count()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run_whole(spark, name):
    df = queries.queries()[name](spark, SF)
    rows = [tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect()]
    if name in queries.oracle_sql():
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        cursor = con.execute(queries.oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        assert sorted(rows) == sorted(tuple(str(r[names.index(c)]) for c in sorted(df.columns)) for r in cursor.fetchall())
    elif name not in ("op6_best_fit_packing", "op8_projection_forest"):
        assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
