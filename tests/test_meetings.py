"""Lists of linked nodes meet block by block: the same rows for any number of blocks, and little to shuffle and to keep."""

import random
import time

import numpy as np
import pytest

from lexaloom.operators import graph
from lexaloom.session import cut_statistics


def _stages(spark) -> int:
    """Bytes that stages have shuffled so far."""
    context = spark.sparkContext
    lists, none = context._jvm.java.util.ArrayList, context._gateway.new_array(context._jvm.double, 0)
    found = context._jsc.sc().statusStore().stageList(lists(), False, False, none, lists())
    return sum(found.apply(i).shuffleWriteBytes() for i in range(found.size()))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_any_number_of_blocks(spark, monkeypatch, kind):
    rng = random.Random(5)
    name = int if kind == "long" else "page-{}".format
    pairs = lambda n: {(name(a), name(b)) for a, b in (rng.sample(range(30), 2) for _ in range(n))}
    frame = lambda rows, ddl: spark.createDataFrame(sorted(rows, key=str), ddl.format(kind))
    edges, related = frame(pairs(120) | {(name(0), name(b)) for b in range(1, 30)}, "src {0}, dst {0}"), frame(pairs(40), "src {0}, dst {0}")
    nodes = frame({(name(a), rng.choice([*graph.TYPES, None])) for a in range(27)}, "id {0}, type string")
    sources = frame({(name(rng.randrange(25)), rng.choice("pqrs")) for _ in range(60)} | {(name(1), None)}, "id {0}, source string")
    rows = lambda: sorted(map(str, graph.relevance(nodes, edges, related, sources).selectExpr("a", "b", "direct", "listed", "shared", "round(adamic, 6)", "round(relevance, 6)").collect()))
    whole = rows()
    monkeypatch.setattr(graph, "TASK_ROWS", 20)
    assert rows() == whole


def test_lists_do_not_go_with_each_pair(spark):
    """All of 60 nodes link each other and have 300 sources, which made 1770 rows of 300 sources to shuffle."""
    rng = random.Random(1)
    edges = spark.createDataFrame([(a, b) for a in range(60) for b in range(a)], "src long, dst long")
    sources = spark.createDataFrame([(a, rng.getrandbits(60)) for a in range(60) for _ in range(300)], "id long, source long")
    nodes = spark.createDataFrame([(a, "entity") for a in range(60)], "id long, type string")
    given = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "60")  # else rows of a node lie together and pack well
    try:
        before = _stages(spark)
        assert graph.relevance(nodes, edges, edges.limit(0), sources).count() == 1770
        wrote = _stages(spark) - before
        assert wrote < 1_500_000, wrote
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", given)


def test_shuffle_files_go_when_a_table_is_written(spark):
    files = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().size()
    before = files()
    made = cut_statistics(spark.range(1000).repartition(7).groupBy("id").count())
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and made.count() == 1000


def test_spread_in_parts(monkeypatch):
    from lexaloom.operators import meetings

    monkeypatch.setattr(meetings, "AT_ONCE", 5)
    first, counts = np.array([0, 4, 10, 3]), np.array([4, 0, 12, 2])
    parts = list(meetings._spread(first, counts))
    i, j = (np.concatenate(x) for x in zip(*parts))
    assert len(parts) > 1 and i.tolist() == [0] * 4 + [2] * 12 + [3] * 2 and j.tolist() == [*range(4), *range(10, 22), 3, 4]
    keys = meetings._Keys(np.array([7, 3, 11]))
    assert [x.tolist() for x in keys.find(np.array([1, 3, 11, 12]))] == [[1, 2], [1, 2]]
