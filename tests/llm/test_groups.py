import random
from datetime import datetime

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from memlake.llm import components, mih


def roots(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in parent}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components_equal_union_find(spark, pairs):
    rows = [(f"n{a:02}", f"n{b:02}") for a, b in pairs]
    df = spark.createDataFrame([*rows, (None, "n00"), ("n01", None), *rows[:2]], "a string, b string")
    got = {r.vertex: r.label for r in components.connected_components(df, "a", "b").collect()}
    assert got == roots([p for p in rows if p[0] != p[1]])


def test_long_chain_and_hub(spark):
    order = list(range(300))
    random.Random(1).shuffle(order)
    chain = [(f"c{order[i]:04}", f"c{order[i + 1]:04}") for i in range(299)]
    hub = [("h", f"x{i}") for i in range(300)]
    df = spark.createDataFrame(chain + hub, "a string, b string")
    got = {r.vertex: r.label for r in components.connected_components(df, "a", "b").collect()}
    assert {got[v] for p in chain for v in p} == {"c0000"} and {got[f"x{i}"] for i in range(300)} == {"h"}


def test_version_groups_reads_dirty_relations(spark):
    t = datetime(2024, 1, 1)
    rows = [("a", "b", " Evolved-Into", None), ("b", "c", "SUPERSEDES", None), ("c", "d", "supersedes", t), ("e", "e", "supersedes", None), ("x", "y", "supports", None), (None, "z", "supersedes", None), ("p", "q", None, None)]
    df = spark.createDataFrame(rows, "from_memory_id string, to_memory_id string, relation string, valid_until timestamp").selectExpr("*", "1 AS v", "2 AS p", "3 AS label")
    assert {(r.memory_id, r.group_id) for r in components.version_groups(df).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}


def exact(rows, k):
    ids, vecs = zip(*[(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and None not in v and any(v)])
    x = np.array([v / np.linalg.norm(v) for v in vecs])
    s = np.round(x @ x.T, 9)
    out = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))
        out |= {(ids[i], ids[j]) for j in order[:k]}
    return out


def test_nearest_small_and_dirty(spark):
    rng = np.random.default_rng(3)
    rows = [(f"v{i:03}", [float(x) for x in rng.normal(size=8)]) for i in range(60)]
    rows += [("copy1", rows[0][1]), ("copy2", [2 * x for x in rows[0][1]]), ("null", None), ("zero", [0.0] * 8), ("hole", [None] + [1.0] * 7), ("short", [1.0, 2.0]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "id string, embedding array<float>").selectExpr("*", "1 AS cid", "2 AS code")
    got = {(r.id, r.neighbour_id) for r in mih.nearest_neighbours(df, "id", "embedding", leaf=4).collect()}
    usable = [r for r in rows if r[0] not in ("short",)]
    want = exact(usable, 5)
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)
    assert mih.nearest_neighbours(df.limit(0), "id", "embedding").count() == 0
    assert {(r.id, r.neighbour_id) for r in mih.nearest_neighbours(df.where("id IN ('v001', 'v002')"), "id", "embedding").collect()} == {("v001", "v002"), ("v002", "v001")}


def test_hot_group_of_copies_gets_smallest_ids(spark):
    rows = [(f"c{i:03}", [1.0, 0.0, 0.0, 0.5]) for i in range(40)] + [("z", [0.0, 1.0, 0.0, 0.0])]
    got = {}
    for r in mih.nearest_neighbours(spark.createDataFrame(rows, "id string, embedding array<float>"), "id", "embedding").collect():
        got.setdefault(r.id, set()).add(r.neighbour_id)
    assert got["c010"] == {"c000", "c001", "c002", "c003", "c004"} and got["c000"] == {"c001", "c002", "c003", "c004", "c005"}
    assert got["z"] == {"c000", "c001", "c002", "c003", "c004"}


def test_recall_on_clustered_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(120, 32))
    rows = [(f"v{i:05}", [float(x) for x in centres[i % 120] + 0.45 * rng.normal(size=32)]) for i in range(3000)]
    got = {(r.id, r.neighbour_id) for r in mih.nearest_neighbours(spark.createDataFrame(rows, "id string, embedding array<float>"), "id", "embedding", leaf=15).collect()}
    want = exact(rows, 5)
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_exact_setting_misses_nothing_in_many_blocks(spark):
    rng = np.random.default_rng(6)
    rows = [(f"v{i:05}", [float(x) for x in np.float32(rng.normal(size=6))]) for i in range(700)]
    rows += [(f"w{i:05}", [float(np.float32(x + 1e-5 * rng.normal())) for x in rows[0][1]]) for i in range(8)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    got = {(r.id, r.neighbour_id) for r in mih.nearest_neighbours(df, "id", "embedding", leaf=5, exact=True).collect()}
    assert got == exact(rows, 5)


def test_probing_follows_the_flipped_bits_weights():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4000, 16))
    index = mih.Index(x, 4000, 2, 200.0, 6, 1)
    at = index.project(x[:300])
    for t, (children, cuts, held) in enumerate(index.trees):
        leaves = np.flatnonzero(children[:, 0] < 0)
        assert held[leaves].max() <= 200
        paths = {}

        def walk(node, path):
            if children[node, 0] < 0:
                paths[node] = path
            else:
                walk(children[node, 0], [*path, (node, 0)])
                walk(children[node, 1], [*path, (node, 1)])

        walk(0, [])
        got = index.probed(at[:, t * index.bits : (t + 1) * index.bits], (children, cuts, held))
        for i in range(300):
            cost = {}
            for leaf, path in paths.items():
                away = [at[i, t * index.bits + d] - cuts[node] for d, (node, _) in enumerate(path)]
                cost[leaf] = sum(a * a for a, (_, bit) in zip(away, path) if (a > 0) != bool(bit))
            assert sorted(cost[n] for n in got[i]) == pytest.approx(sorted(cost.values())[:6], abs=1e-5) and cost[got[i, 0]] == 0


def test_bucket_that_bits_cannot_cut_is_split(spark):
    rng = np.random.default_rng(8)
    x = np.r_[rng.normal(size=(40, 8)), np.ones((300, 8)) + 1e-9 * rng.normal(size=(300, 8))]
    index = mih.Index(x[:1], 340, 1, 20.0, 1, 1)
    buckets, at = index.buckets(x, np.arange(340))
    met = {}
    for i in range(340):
        for b in buckets[at[i] : at[i + 1]]:
            met.setdefault(b, set()).add(i)
    assert max(map(len, met.values())) < 200
    assert {(i, j) for rows in met.values() for i in rows for j in rows} == {(i, j) for i in range(340) for j in range(340)}


@pytest.mark.parametrize("n,dims", [(1, 4), (5, 3), (70, 8)])
def test_block_search_and_packing(n, dims):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, dims))
    back = mih.unpack(mih.pack(x / np.abs(x).max(axis=1, keepdims=True)))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert np.abs((back[:, :dims] * unit).sum(axis=1) - 1).max() < 1e-5
    places, values = mih.best_in_block(unit.astype(np.float32), 3)
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    for i in range(n):
        have = np.sort(values[i][values[i] > -1.5])
        assert np.allclose(have, np.sort(s[i])[::-1][: min(3, n - 1)][::-1], atol=1e-5)
