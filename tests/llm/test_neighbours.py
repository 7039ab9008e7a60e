import operator
import random
from functools import reduce

import numpy as np
import pytest

from sitesift.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k):
    """The row-by-row definition: {(query_id, vector): [(score, vec_id)]}."""
    def usable(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    rows = sorted({(i, tuple(np.float32(x).item() for x in v)) for i, v in rows if i is not None and usable(v)})
    asked = sorted({(i, tuple(np.float32(x).item() for x in v)) for i, v in queries if i is not None and usable(v)})
    out = {}
    for q, qv in asked:
        scored = sorted((-reduce(operator.add, map(operator.mul, qv, v), 0.0), i) for i, v in rows if i != q)
        out.setdefault(q, []).append([(i, -s) for s, i in scored[:k]])
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


@pytest.fixture(scope="module")
def clusters():
    r = random.Random(3)
    centres = [[r.gauss(0, 1) for _ in range(24)] for _ in range(12)]
    rows = [(i, [x + r.gauss(0, 0.5) for x in r.choice(centres)], 0) for i in range(3000)]
    hot = rows[0][1]
    return rows + [(10_000 + i, hot, 1) for i in range(1500)]          # a third of all rows equal


def test_recall_scores_and_order_with_a_hot_vector(spark, clusters, monkeypatch):
    monkeypatch.setattr(neighbours, "UNIT_BYTES", 24 * 8 * 200)       # large lists are dealt over several units
    monkeypatch.setattr(neighbours, "SMALL", 128)
    df = spark.createDataFrame(clusters, SCHEMA)
    got = answers(neighbours.nearest(df.where("vec_id % 20 = 0"), df, k=20))
    want = brute([r[:2] for r in clusters], [r[:2] for r in clusters if r[0] % 20 == 0], 20)
    assert set(got) == set(want)
    hits = total = 0
    for q, (truth,) in want.items():
        found = got[q]
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        exact = {i: s for i, s in truth}
        for _, i, s in found:
            if i in exact:
                assert s == exact[i]                                   # in component order, in double
        total += 20
        hits += len({i for _, i, _ in found} & set(exact))
    assert hits / total >= 0.9


def test_small_tables_are_exact_with_ties_copies_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20, [1.0, 0.0], 0), (20, [1.0, 0.0], 0), (40, [1.0, 0.0], 1), (1, [1.0, 0.0], 0), (2, [0.5, 0.5], 0),
            (3, [0.5, 0.5], 0), (60, [0.0, 2.0], 0), (60, [3.0, 0.0], 0), (4, [0.0, 0.0], 0), (5, None, 0),
            (6, [1.0, None], 0), (7, [nan, 1.0], 0), (8, [inf, 1.0], 0), (None, [1.0, 1.0], 0), (9, [-1.0], 0),
            (80, [], 0), (100, [0.25, 0.25, 0.25], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = answers(neighbours.nearest(df.where("vec_id % 20 = 0"), df, k=3))
    pad = [(i, v if v is None else v + [0.0] * (3 - len(v))) for i, v, _ in rows]
    want = brute(pad, [r for r in pad if r[0] is not None and r[0] % 20 == 0], 3)
    assert set(got) == set(want)
    for q, lists in want.items():
        assert sorted(got[q]) == sorted((n + 1, i, s) for one in lists for n, (i, s) in enumerate(one))


def test_one_id_on_many_vectors(spark):
    r = random.Random(9)
    rows = [(0, [r.gauss(0, 1) for _ in range(4)], 0) for _ in range(60)] + [(i, [r.gauss(0, 1) for _ in range(4)], 0)
                                                                           for i in range(1, 40)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = neighbours.nearest(df.where("vec_id % 20 = 0"), df, k=5)
    assert found.where("query_id = vec_id").count() == 0
    assert found.where("query_id = 0").count() == 60 * 5 and found.where("query_id = 20").count() == 5


def test_empty_and_other_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert neighbours.nearest(none, none).collect() == []
    odd = spark.createDataFrame([(20, [1.0], 1, 2, 3), (21, [2.0], 1, 2, 3)],
                                "vec_id long, embedding array<double>, q int, unit int, ids int")
    assert [tuple(r) for r in neighbours.nearest(odd.where("vec_id = 20"), odd).collect()] == [(20, 1, 21, 2.0)]
    assert neighbours.nearest(odd.where("vec_id = 20"), odd.where("vec_id = 20")).collect() == []


def test_abandoning_keeps_nearly_all_and_skips_most():
    """On one list: the column tests lose almost no true neighbour and leave few candidates to score."""
    r = np.random.default_rng(1)
    x = r.standard_normal((4000, 64))
    x /= np.sqrt((x ** 2).sum(axis=1))[:, None]
    space = neighbours.Space(64, 1.0)
    y, (q, _) = space.candidates(x), space.queries(x[:50])
    unit = type("U", (), {"y": y})()
    gap = 2 - 2 * (x[:50] @ x.T)
    kth = np.partition(gap, 20, axis=1)[:, 20]
    row, col = neighbours.survivors(space, q, unit, 0, len(x), kth * (1 + 1e-9))
    near = {(a, b) for a, b in zip(*np.nonzero(gap <= kth[:, None]))}
    assert len(near & set(zip(row.tolist(), col.tolist()))) >= 0.98 * len(near)
    assert len(row) < 0.02 * gap.size
