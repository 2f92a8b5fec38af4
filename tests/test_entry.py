"""Registered queries against DuckDB, shared helpers, and the guard around the corpus operators."""

import ast
import glob
import os
import pathlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fathomrank.plans import catalogue
from fathomrank.shared import global_index, join_by_class

SF = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).parent.parent


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def rows(cursor_columns, data):
    order = sorted(range(len(cursor_columns)), key=lambda i: cursor_columns[i])
    return sorted(cursor_columns), sorted((tuple(r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = duck.sql(catalogue.SQL[name])
    assert got == rows(want.columns, want.fetchall())


def test_names_and_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_recall_and_lists(spark):
    assert 0 < catalogue.recall_at_k(spark, SF).first().recall <= 1
    assert catalogue.ivf_assignment(spark, SF).agg(F.sum("members")).first()[0] == 200


def test_nothing_else_imports_the_corpus_operators():
    for p in [*(ROOT / "fathomrank").rglob("*.py")]:
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), p


def test_global_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(6)
    assert [r.i for r in global_index(df, [F.col("x")], "i", "t").orderBy("x").collect()] == list(range(1000))


def test_join_by_class_with_a_hot_key(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    classes = df.groupBy("k").agg(F.count("*").alias("n"))
    out = join_by_class(df, classes, "k", "n", 6000)
    assert out.count() == 6000 and out.where("n = 3000").count() == 3000
