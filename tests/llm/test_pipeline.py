"""The registered queries and the pipeline."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from helpers import decontaminated, groups, without_repeats

import __spark_entry__
import corpus_pipeline
from crosslume.llm.queries import QUERIES
from crosslume.llm.sql import ORACLE

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = __spark_entry__.queries().keys()
    assert {*QUERIES, "pipeline"} <= names and ORACLE.keys() <= __spark_entry__.oracle_sql().keys()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def canonical(df):
    return df[sorted(df.columns)].sort_values(sorted(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    got = canonical(QUERIES[name](spark, SF).toPandas())
    pd.testing.assert_frame_equal(got, canonical(con.execute(ORACLE[name]).df()), check_dtype=False)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_keep_every_row(spark, name):
    rows = QUERIES[name](spark, SF)
    if "doc_id" in rows.columns:
        ids = {r["doc_id"] for r in rows.select("doc_id").collect()}
        assert ids == {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    else:
        assert rows.count() > 0


def test_stages_against_brute_force(spark):
    some = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    rows = [(r["doc_id"], r["text"]) for r in some.collect()]

    def after(name):
        out = stages[name](spark, some, SF)
        assert out.columns == some.columns
        return {r["doc_id"]: r for r in out.collect()}

    assert 0 < len(rows) - len(after("quality")) < 0.3 * len(rows)
    assert after("near_dedup").keys() == {i for i, (_, c) in groups(rows, 5).items() if i == c}
    left, want = after("substring_dedup"), without_repeats(rows)
    assert all(len(left[i]["text"].split()) == n - gone for i, (n, gone, _) in want.items() if gone)
    assert all(left[i]["text"] == t for i, t in rows if not want[i][1])
    assert after("decontaminate").keys() == {i for i, w in decontaminated(rows, items).items() if not w[3]}


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).toPandas()
    assert (rows.groupby("sequence_id").length.sum() <= 2048).all()
    kept = rows.doc_id.nunique()
    assert 0.4 * 200 < kept < 200


def test_clashing_columns_are_kept(spark):
    some = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = ["n_words", "hits", "items", "contaminated", "n_removed", "kept", "kept_sha256", "spans", "score"]
    names += ["predicted", "component_id", "n_shingles", "id", "Label", "bucket", "lang_pred", "_repeat"]
    more = some.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, more, SF)
        assert left.columns == more.columns and left.schema == more.schema, name
        rows = left.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names), name
    assert corpus_pipeline.pack(spark, more, SF).count() >= 60


def test_stages_take_tables_without_rows_and_null_rows(spark):
    some = spark.read.parquet(f"{SF}/documents.parquet")
    nulls = some.limit(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in some.schema])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, some.limit(0), SF).count() == 0, name
        assert stage(spark, some.limit(20).unionByName(nulls), SF).count() > 0, name
