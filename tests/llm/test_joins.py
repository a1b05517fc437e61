"""Joins of rows that an explode has multiplied: Spark sizes them as if there were no more than before."""

from strandframe.llm import simhash


def joins(df):
    """The joins of the plan that ran."""
    rows = sorted(map(tuple, df.collect()))
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return rows, plan


def test_variants_are_not_broadcast_however_few_the_fingerprints(spark):
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    prints = spark.range(2000).selectExpr("xxhash64(id div 2) ^ (id % 2) AS fp")
    rows, plan = joins(simhash.links(prints))
    assert len(rows) == 1000 and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_salted_values_of_components_are_not_broadcast(spark):
    nodes = spark.range(400).selectExpr("id AS fp", "id + 7 AS least_id")
    roots = spark.range(300).selectExpr("id AS node", "id div 100 AS root")
    rows, plan = joins(simhash._least(nodes, roots, "least_id"))
    assert rows == [(i, i // 100 * 100 + 7 if i < 300 else i + 7) for i in range(400)]
    assert "SortMergeJoin [root" in plan
