import numpy as np
import pytest

from trelliq.llm import near_vectors, neighbours
from trelliq.llm.common import Scratch
from trelliq.llm.graph import components


def table(spark, rng, n=260, d=8):
    centres = rng.normal(size=(12, d))
    x = centres[rng.integers(0, 12, n)] + 0.25 * rng.normal(size=(n, d))
    rows = [(i, [float(np.float32(v)) for v in x[i]], int(i % 3) if i % 11 else None, "x") for i in range(n)]
    rows += [(n + i, rows[5][1], rows[5][2], "x") for i in range(30)]
    bad = [None, [], [0.0] * d, [float("nan")] + [1.0] * (d - 1), [float("inf")] + [1.0] * (d - 1), [None] + [1.0] * (d - 1), [1.0] * (d - 1)]
    rows += [(n + 100 + i, v, 1, "x") for i, v in enumerate(bad)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, kept string"), rows


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v)


@pytest.mark.parametrize("block, leaf", [(1024, 128), (16, 4)])
def test_near_vectors_against_all_pairs(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    monkeypatch.setattr(near_vectors, "LEAF", leaf)
    df, rows = table(spark, np.random.default_rng(3))
    got = {r.vec_id: r for r in near_vectors.near_vectors(df).collect()}
    links, root = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    good = [r for r in rows if usable(r[1]) and r[2] is not None]
    for i, a in enumerate(good):
        for b in good[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.float32(a[1]).astype(float), np.float32(b[1]).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[a[0]] += 1
                    links[b[0]] += 1
                    p, q = sorted((find(a[0]), find(b[0])))
                    root[q] = p
    assert len(got) == len(rows) and sum(links.values()) > 0
    for i, r in got.items():
        assert (r.n_links, r.component_id, r.kept) == (links[i], find(i), find(i) == i)
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_of_a_length_the_sample_lacks(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "FIT_ROWS", 5)
    df, rows = table(spark, np.random.default_rng(3))
    n = len(rows)
    few = [(1000 + 10 * d + i, [1.0] * (d - 1) + [1.0 + 0.01 * i], 1, "x") for d in range(2, 8) for i in range(2)]
    got = {r.vec_id: r for r in near_vectors.near_vectors(df.unionByName(spark.createDataFrame(few, df.schema))).collect()}
    assert len(got) == n + len(few)
    for d in range(2, 7):
        assert [(got[1000 + 10 * d + i].n_links, got[1000 + 10 * d + i].component_id) for i in range(2)] == [(1, 1000 + 10 * d)] * 2
    want = {r.vec_id: r for r in near_vectors.near_vectors(df).collect()}
    assert all(got[i] == want[i] for i in range(260))


def test_neighbours(spark):
    df, rows = table(spark, np.random.default_rng(4), 900, 16)
    got = {}
    for r in neighbours.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = {r[0]: np.float32(r[1]).astype(float) for r in rows if usable(r[1]) and len(r[1]) == 16}
    asked = [i for i in good if i % 20 == 0]
    assert sorted(got) == sorted(asked)
    hit = 0
    for q in asked:
        want = sorted((-(good[q] @ v), i) for i, v in good.items() if i != q)[:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and all(abs(good[q] @ good[i] - s) < 1e-12 for _, i, s in mine)
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        hit += len({i for _, i in want} & {i for _, i, _ in mine})
    assert hit / (20 * len(asked)) >= 0.9
    few = neighbours.nearest(df.filter("vec_id <= 3")).collect()
    assert [(r.query_id, r["rank"]) for r in sorted(few)] == [(0, 1), (0, 2), (0, 3)]
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "test")).collect()}
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_near_vectors_of_doubles(spark):
    """A cosine just above the limit, that floats would put below it, and one just below."""
    import math

    over, under = 0.93 + 2e-9, 0.93 - 2e-9
    rows = [(1, [1.0, 0.0], 1), (2, [over, math.sqrt(1 - over**2)], 1), (11, [1.0, 0.0], 2), (12, [under, math.sqrt(1 - under**2)], 2)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 11: (0, 11), 12: (0, 12)}


def test_nearest_of_every_length_and_in_turns(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ASKERS", 3)
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=6 if i < 200 else 3).tolist()) for i in range(260)]
    rows += [(300 + i, rows[0][1]) for i in range(8)] + [(400, None), (420, [0.0] * 6), (440, [float("nan")] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, k=5, share=50.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    held = [r for r in rows if r[0] < 400]
    for q, v in held:
        if q % 20 == 0:
            best = sorted((-float(np.dot(v, w)), i) for i, w in held if i != q and len(w) == len(v))[:5]
            assert [i for _, i, _ in sorted(got[q])] == [i for _, i in best] and np.allclose([s for _, _, s in sorted(got[q])], [-s for s, _ in best])
    assert set(got) == {q for q, _ in held if q % 20 == 0}


def test_a_session_keeps_the_batch_size_that_it_names(spark):
    from trelliq.llm import common

    before = spark.conf.get(common.BATCH_SETTING)
    try:
        for named, want in (("1234567", "1234567"), (f"{common.BATCH_DEFAULT}b", str(common.BATCH_BYTES))):
            spark.conf.set(common.BATCH_SETTING, named)
            common.small_batches(spark)
            assert spark.conf.get(common.BATCH_SETTING).rstrip("b") == want
    finally:
        spark.conf.set(common.BATCH_SETTING, before)
