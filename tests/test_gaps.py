"""Findings on a link graph whose rows are dealt out to more tasks than the session makes."""

from lexaloom import session
from lexaloom.operators import graph
from lexaloom.plans import catalog

SF_DIR = "/root/testdata/sf0.001"


def test_edges_are_made_by_more_tasks_the_more_rows_there_are(spark, monkeypatch):
    few = {name: catalog.QUERIES[name](spark, SF_DIR).collect() for name in ("knowledge_gaps", "community_cohesion", "edge_distinct")}
    made = catalog.part_edges(spark, SF_DIR).rdd.getNumPartitions()
    assert made <= 4
    lines = session.table(spark, SF_DIR, "lineitem").count()
    monkeypatch.setattr(session, "TASK_ROWS", lines // 10, raising=False)
    assert catalog.part_edges(spark, SF_DIR).rdd.getNumPartitions() in (10, 11)
    for name, rows in few.items():
        assert sorted(catalog.QUERIES[name](spark, SF_DIR).collect()) == sorted(rows)


def test_gaps_are_the_same_in_any_number_of_tasks(spark):
    nodes = spark.createDataFrame([(i, i % 4, 0 if i == 30 else 2) for i in range(31)], "id long, community long, n_links long")
    edges = spark.createDataFrame([(0, b) for b in range(1, 30)] + [(b, b + 4) for b in range(1, 25)] + [(3, 99)], "a long, b long")
    got = [tuple(r) for r in graph.gaps(nodes, edges).collect()]
    # (0, b) with b in 4, 8, ..., 28 lie within community 0, as do (4, 8), ..., (24, 28)
    assert ("sparse", 0, 0.464286) not in got and got[0] == ("isolated", 0, 1.0)
    assert {s: n for k, s, n in got if k == "bridge"} == {0: 4.0}
    for tasks in (1, 7):
        assert [tuple(r) for r in graph.gaps(nodes, edges, tasks=tasks).collect()] == got
