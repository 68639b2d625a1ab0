"""Neighbours of every vector against brute force: copies, blocks, cells, recall and rows that are no vectors."""

import numpy as np
import pyarrow as pa
import pytest

from lexaloom.operators import neighbours

DDL = "id long, vector array<double>"


def brute(rows, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    far = np.round(((x[:, None] - x[None]) ** 2).sum(2), neighbours.PLACES)
    out = {}
    for i, a in enumerate(ids):
        order = [j for j in np.lexsort((ids, far[i])) if j != i][:k]
        out[a] = [(ids[j], far[i][j]) for j in order]
    return out


def joined(spark, rows, k, **how):
    got = {}
    for r in neighbours.nearest_join(spark.createDataFrame(rows, DDL).repartition(3), k, **how).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["other"], r["distance"]))
    return got


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(12, 16)) * 2
    rows = [(k, (middle[k % 12] + rng.normal(size=16)).tolist()) for k in range(400)]
    rows += [(1000 + k, rows[5][1]) for k in range(150)]  # a hot vector
    return rows


def test_exact(spark, clustered, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    want = brute(clustered, 5)
    got = joined(spark, clustered, 5, probes=2, cells=10, exact=True)
    assert {a: [b for b, _ in v] for a, v in got.items()} == {a: [b for b, _ in v] for a, v in want.items()}
    assert all(np.allclose([d for _, d in got[a]], [d for _, d in want[a]], atol=1e-8) for a in want)


def test_recall_of_few_probes(spark, clustered):
    want = brute(clustered, 10)
    got = joined(spark, clustered, 10, probes=4, cells=12)
    assert set(got) == set(want)
    recall = np.mean([len({b for b, _ in got[a]} & {b for b, _ in want[a]}) / 10 for a in want])
    assert recall >= 0.9


def test_rows_that_are_no_vectors(spark):
    rows = [(1, [0.0, 1.0]), (2, None), (3, []), (4, [float("nan"), 1.0]), (5, [0.0, 2.0]), (None, [0.0, 3.0]), (6, [0.0, 1.0])]
    assert joined(spark, rows, 3, exact=True) == {1: [(6, 0.0), (5, 1.0)], 6: [(1, 0.0), (5, 1.0)], 5: [(1, 1.0), (6, 1.0)]}
    assert joined(spark, rows[:1], 3) == {}
    assert joined(spark, [], 3) == {}


class Shared:
    def __init__(self, value):
        self.value = value


def test_batches_stay_small_whatever_is_asked():
    x = np.random.default_rng(1).normal(size=(5000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(5000)), pa.array(np.arange(5000)), pa.array(x.tolist(), pa.list_(pa.float64()))], ["class", "first", "vector"])
    out = list(neighbours._asked(Shared(x[:50]), 8)(iter([batch])))
    assert sum(b.num_rows for b in out) == 40000 and max(b.num_rows for b in out) <= 8 * neighbours.STEP


def test_exact_in_many_parts(spark, clustered, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    monkeypatch.setattr(neighbours, "PART_BLOCKS", 1)
    want = brute(clustered, 5)
    got = joined(spark, clustered, 5, probes=1, cells=6, exact=True)
    assert {a: [b for b, _ in v] for a, v in got.items()} == {a: [b for b, _ in v] for a, v in want.items()}
