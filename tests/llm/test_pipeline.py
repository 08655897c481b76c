"""The corpus pipeline against a plain version of its stages, and the registered queries."""

import duckdb
import pytest

import corpus_pipeline
from tallyweft.llm import mixing, queries
from tallyweft.llm import sentencepiece_sa as sp


def test_stage_order_and_columns(spark, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "private_values", "source_mix", "token_ids"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = kept
        kept = spark.createDataFrame(stage(spark, before, small).toPandas().astype(object).where(lambda d: d.notna(), None), stage(spark, before, small).schema)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert kept.columns == columns
        ids = {r[0] for r in kept.select("doc_id").distinct().collect()}
        assert ids and ids <= {r[0] for r in before.select("doc_id").distinct().collect()}
    # mixing and tokens, redone plainly from the third stage's documents
    direct = corpus_pipeline.run(spark, small).groupBy("doc_id", "n_tokens").count().collect()
    third = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        third = stage(spark, third, small)
    rows = third.select("doc_id", "text", "source").toPandas()
    documents = rows  # noqa: F841  read by DuckDB
    plan = duckdb.sql(mixing.PLAN_SQL).df()
    size = dict(zip(plan.doc_id, plan["size"], strict=True))
    taken = dict(zip(plan.doc_id, plan.taken, strict=True))
    pieces = sp.Pieces(sp.default_model())
    n = {i: len(t) for i, t in zip(rows.doc_id, pieces.encode(list(rows.text)), strict=True)}
    assert {(r["doc_id"], r["n_tokens"], r["count"]) for r in direct} == {(i, n[i], taken[i] // size[i]) for i in n if taken[i]}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_cover_their_table(spark, small, name):
    out = queries.QUERIES[name](spark, small)
    op = name.split("_")[0]
    table = {"op1": "embeddings", "op6": "pages", "op7": "pages", "op11": "conversations", "op12": "benchmark", "op13": "embeddings"}.get(op, "documents")
    n = spark.read.parquet(f"{small}/{table}.parquet")
    want = {"op1": lambda: 20 * n.where("vec_id % 20 = 0").count(), "op11": lambda: n.select("conv_id").distinct().count() + 1, "op12": out.count, "op13": lambda: 4 * n.count()}.get(op, n.count)()
    assert out.count() == want
    if op == "op12":  # items may match fewer than 50 documents; the SQL has the rows
        assert out.select("item_id").distinct().count() == n.count() and out.groupBy("item_id").count().where("count > 50").isEmpty()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for table in ("pages", "documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, small).toPandas(), con.sql(queries.SQL[name]).df()
    key = ["page_id"] if name.startswith("op6") else ["item_id", "rank"] if "rank" in want else ["doc_id"]
    a, b = (d.sort_values(key).reset_index(drop=True)[sorted(d)] for d in (got, want))
    assert list(a) == list(b) and ((a == b) | (a.isna() & b.isna())).all().all()
