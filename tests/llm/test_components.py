import random

from strandframe.llm import components


def test_few_edges_are_united_by_one_task_and_many_by_rounds(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)]
    frame = spark.createDataFrame(edges, "u long, v long")
    rounds = {r["node"]: r["root"] for r in components.connected_components(frame, few=0).collect()}
    context = spark.sparkContext
    context.setJobGroup("united", "")
    united = {r["node"]: r["root"] for r in components.connected_components(frame).collect()}
    jobs = len(context.statusTracker().getJobIdsForGroup("united"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert united == rounds and len(rounds) > 200 and jobs < 12


def test_no_edges_give_no_rows(spark):
    assert components.connected_components(spark.createDataFrame([(1, 1)], "u long, v long")).collect() == []


def test_many_edges_of_few_nodes_become_trees_instead_of_rounds(spark, monkeypatch):
    edges = [(a, b) for a in range(60) for b in range(a)] + [(100 + i, 101 + i) for i in range(30)]
    monkeypatch.setattr(components, "_star", None)
    found = components.connected_components(spark.createDataFrame(edges, "u long, v long"), few=200).collect()
    assert {r["node"]: r["root"] for r in found} == {**dict.fromkeys(range(60), 0), **dict.fromkeys(range(100, 131), 100)}
