"""Shapes of plans: pushed filters, pruned columns, group limits, codegen."""

from pyspark.sql import functions as F

from cuelight.operators import relational, search

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = plan(docs.filter(F.col("doc_id") > 10).select("doc_id", "source"))
    assert "GreaterThan(doc_id,10)" in text and "ReadSchema: struct<doc_id:bigint,source:string>" in text


def test_group_limits(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    assert plan(relational.first_per_key(orders, ["o_custkey"], ["o_orderkey"], 2)).count("WindowGroupLimit") == 2
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    q = e.filter("vec_id < 3").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    text = plan(search.nearest(q, e, 5, "q", "qv", "vec_id", "embedding"))
    assert text.count("WindowGroupLimit") == 2 and "Python" not in text and "Arrow" not in text


def test_one_shuffle_for_context(spark):
    from cuelight.plans.queries import chunk_rows

    text = plan(chunk_rows(spark, SF))
    assert text.count("Exchange hashpartitioning") == 1 and "Python" not in text


def test_upsert_is_an_anti_join(spark):
    base = spark.range(10).withColumnRenamed("id", "k").withColumn("v", F.lit(1))
    assert "LeftAnti" in plan(relational.upsert(base, base.limit(2), ["k"]))
