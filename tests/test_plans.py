"""Plan shapes the jobs rely on: pushdown, pruning, shuffle counts, no nested-loop joins."""

import re

import pytest
from pyspark.sql import functions as F

from etlvault.operators import pii, quality, recon, scan, vault
from etlvault.workload import recon_queries, vault_queries

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return len(re.findall(r"\bExchange (?:hashpartitioning|rangepartitioning|RoundRobin|SinglePartition)", text))


@pytest.fixture(scope="module")
def orders(spark):
    return spark.read.parquet(f"{SF_DIR}/orders.parquet")


def test_delta_filter_reaches_the_scan(orders):
    text = plan(recon.row_counts(recon.delta(orders, "o_orderdate", "1998-01-01", "1999-01-01"), orders))
    assert "GreaterThanOrEqual(o_orderdate" in text
    assert "ReadSchema: struct<o_orderdate" in text and "o_totalprice" not in text


def test_report_shuffles_keys_once(orders):
    text = plan(recon.reconcile(orders, orders, "o_orderkey", ["o_totalprice"], "r"))
    assert text.count("hashpartitioning") == 1 and exchanges(text) == 2
    assert text.count("FileScan") == 2


def test_key_presence_is_one_hash_aggregate(orders):
    text = plan(recon.missing_keys(orders, orders, "o_orderkey"))
    assert exchanges(text) == 1 and "SortAggregate" not in text and "ReadSchema: struct<o_orderkey:bigint>" in text


def test_scalar_rules_share_one_scan(orders):
    rules = [{"rule_id": str(i), "dimension": "D", "column": c, "check_type": "NOT_NULL"} for i, c in enumerate(orders.columns)]
    text = plan(quality.evaluate(orders, rules))
    assert text.count("FileScan") == 1


def test_projections_do_not_shuffle(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert exchanges(plan(pii.detect(docs, "doc_id"))) == 0
    assert exchanges(plan(pii.anonymise(docs, "d", "r", "doc_id"))) == 0
    files = docs.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    text = plan(scan.scan(files))
    assert exchanges(text) == 0 and "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_batch_link_shuffles_keys_not_hashes(spark, orders):
    text = plan(vault.load_link_batch(orders, "L", {"C": ["o_custkey"], "O": ["o_orderkey"]}, "2024-01-01", "S"))
    assert exchanges(text) == 1 and "SortAggregate" not in text
    assert "md5" not in text[text.index("Exchange"):]


def test_no_nested_loops_or_cross_products(spark):
    for query in (vault_queries.order_360, vault_queries.pit, vault_queries.ghost, vault_queries.sat_incremental, recon_queries.report, recon_queries.value_mismatch):
        text = plan(query(spark, SF_DIR))
        assert "NestedLoop" not in text and "CartesianProduct" not in text
