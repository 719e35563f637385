import itertools
import random
import re

import numpy as np

from memlake.llm import neardup, setsim
from memlake.llm.minhash import bitmaps, band_keys


def normal(v):
    v = re.sub(r"^\s+|\s+$", "", v.lower())
    return re.sub(r"[\s\-_]+", "-", v) if v else None


def brute_sets(rows):
    sets = [(i, {normal(v) for v in [*(t or []), *(p or [])] if v is not None} - {None}) for i, t, p in rows if i is not None]
    out = set()
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i != j and len(a) >= 4 and len(b) >= 4 and 5 * len(a & b) >= 3 * len(a | b):
            out.add((min(i, j), max(i, j)))
    return out


def test_similar_sets_equal_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for g in range(25):
        core = [f"v{g}-{k}" for k in range(rng.randint(4, 9))]
        for m in range(rng.randint(1, 4)):
            vals = [v.replace("-", rng.choice(["-", "_", "  "])).upper() if rng.random() < 0.3 else v for v in core if rng.random() < 0.9]
            rows.append((f"id{g}-{m}", vals + [None, " "], [" hot "] + vals[:1]))
    rows += [("n1", None, None), ("n2", [], []), (None, list("abcd"), None), ("c1", list("abcd"), None), ("c2", None, list("dcba")), ("c2", None, list("dcba")), ("c3", list("abc"), None)]
    df = spark.createDataFrame(rows, "id string, topics array<string>, people array<string>").selectExpr("*", "1 AS cid", "2 AS values", "3 AS key")
    got = [(r.id_a, r.id_b) for r in setsim.similar_sets(df, "id", ["topics", "people"]).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_sets(rows)
    assert setsim.similar_sets(df.limit(0), "id", ["topics", "people"]).count() == 0


def test_threshold_is_included(spark):
    rows = [("a", list("abcd")), ("b", list("abcdxy")), ("c", list("abcdefgh")), ("d", list("abcdepqrst")), ("e", list("abcde"))]
    df = spark.createDataFrame([(i, t, None) for i, t in rows], "id string, topics array<string>, people array<string>")
    got = {(r.id_a, r.id_b) for r in setsim.similar_sets(df, "id", ["topics", "people"]).collect()}
    assert got == brute_sets([(i, t, None) for i, t in rows]) and ("a", "b") in got


def test_hot_value_in_a_third_of_rows_loses_nothing(spark):
    rng = random.Random(2)
    rows = [(f"h{i:03}", ["hot"] + rng.sample([f"w{k}" for k in range(30)], 4), None) for i in range(150)]
    df = spark.createDataFrame(rows, "id string, topics array<string>, people array<string>")
    got = {(r.id_a, r.id_b) for r in setsim.similar_sets(df, "id", ["topics", "people"]).collect()}
    want = brute_sets(rows)
    assert got <= want and len(got) >= 0.999 * len(want)


def word_sets(rows):
    out = []
    for i, c in rows:
        if i is None or c is None:
            continue
        plain = re.sub(r"\[see also:.*?\]", "", re.sub(r"<!--.*?-->", "", c, flags=re.S), flags=re.S | re.I)
        out.append((i, {w.lower() for w in re.findall(r"[^\W_]+", plain)}))
    return out


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"word{k}" for k in range(400)]
    rows = []
    for g in range(30):
        base = rng.sample(vocabulary, rng.randint(8, 40))
        for m in range(4):
            words = [w for w in base if rng.random() < 0.95] + rng.sample(vocabulary, rng.randint(0, 3))
            rng.shuffle(words)
            rows.append((f"d{g}-{m}", " ".join(w.upper() if rng.random() < 0.2 else w for w in words) + rng.choice(["", " <!-- a\nb -->", " [see also: q]", "!"])))
    rows += [("x", None), ("y", ""), ("z", "  "), ("short", "a b c"), (None, rows[0][1]), ("copy", rows[0][1]), ("copy", rows[0][1]), ("long", " ".join(vocabulary * 50))]
    df = spark.createDataFrame(rows, "id string, content string").selectExpr("*", "content AS values")
    got = [(r.id_a, r.id_b) for r in neardup.near_duplicates(df, "id", "content").collect()]
    want = set()
    for (i, a), (j, b) in itertools.combinations(word_sets(rows), 2):
        if i != j and len(a) >= 8 and len(b) >= 8 and 10 * len(a & b) >= 7 * len(a | b):
            want.add((min(i, j), max(i, j)))
    assert len(got) == len(set(got)) and set(got) <= want and len(set(got)) >= 0.999 * len(want)


def forest_of(sets, crowd=4, split=4000, depth=4):
    sets = [np.unique(np.array(x, dtype=np.int64)) for x in sets]
    offsets = np.r_[0, np.cumsum([len(x) for x in sets])]
    flat = np.concatenate(sets).view(np.uint64)
    forest = neardup.Forest(0.7, depth, 0.9995, 3)
    forest.learn(flat, offsets[:-1], len(sets), crowd, split)
    return forest, flat, offsets


def test_prefixes_are_long_where_records_crowd():
    rng = np.random.default_rng(1)
    dense = [np.r_[np.arange(30), 10_000 + rng.integers(0, 10**9, 2)] for _ in range(60)]
    sparse = [rng.integers(10**10, 10**15, 30) for _ in range(60)]
    forest, flat, offsets = forest_of(dense + sparse)
    row, key, length = forest.lookups(flat, offsets)
    assert length[row < 60].mean() > 3 and (length[row >= 60] == 1).all()
    trees = np.bincount(row)
    assert (trees[60:] < 10).all() and (trees[:60] == forest.trees).all()
    # Those that share a key have it at the same length, and no shorter prefix of it is crowded.
    for k in np.unique(key)[:200]:
        assert len(set(length[key == k])) == 1


def test_pairs_at_the_threshold_meet(spark):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(30_000)]
    common = words[:12]
    rows, want = [], set()
    for g in range(250):
        own = [words[i] for i in rng.choice(np.arange(50, 30_000), 9, replace=False)]
        shared = [*common[: rng.integers(3, 12)], *own]
        room = int(len(shared) * 3 / 7)
        for side, extra in (("a", room // 2), ("b", room - room // 2)):
            rows.append((f"{g:03}{side}", " ".join([*shared, *(f"x{g}{side}{i}" for i in range(extra))])))
        want.add((f"{g:03}a", f"{g:03}b"))
    got = {(r.id_a, r.id_b) for r in neardup.near_duplicates(spark.createDataFrame(rows, "id string, content string"), "id", "content", crowd=4).collect()}
    assert len(want - got) <= 1


def test_crowded_prefix_is_split_without_loss(spark):
    rng = random.Random(6)
    base = [f"word{k}" for k in range(40)]
    rows = [(f"d{i:03}", " ".join([*base, f"edit{i}"])) for i in range(120)] + [(f"e{i}", " ".join(rng.sample([f"v{k}" for k in range(500)], 20))) for i in range(60)]
    got = [(r.id_a, r.id_b) for r in neardup.near_duplicates(spark.createDataFrame(rows, "id string, content string"), "id", "content", split=20).collect()]
    assert len(got) == len(set(got)) and {(f"d{i:03}", f"d{j:03}") for i in range(120) for j in range(i + 1, 120)} == set(got)


def test_pairs_within_runs():
    key = np.array([1, 1, 1, 2, 3, 3, 9])
    pairs = {(int(a), int(b)) for i, j in neardup.neighbours_in_runs(key) for a, b in zip(i, j)}
    assert pairs == {(0, 1), (0, 2), (1, 2), (4, 5)}


def test_classes_and_members_need_no_expansion(spark):
    rows = [(f"h{i:03}", list("abcde"), None) for i in range(50)] + [("k", list("abcd"), None), ("z", list("pqrs"), None)]
    pairs, members = setsim.similar_set_classes(spark.createDataFrame(rows, "id string, topics array<string>, people array<string>"), "id", ["topics", "people"])
    of = {r.id: r.cid for r in members.collect()}
    assert len(set(of.values())) == 3 and [{r.cid_a, r.cid_b} for r in pairs.collect()] == [{of["h000"], of["k"]}]


def test_bitmap_bound_never_exceeds_the_difference():
    rng = np.random.default_rng(0)
    sets = [rng.integers(0, 50, rng.integers(1, 20)).astype(np.int64) for _ in range(60)]
    sets = [np.unique(s) for s in sets]
    offsets = np.r_[0, np.cumsum([len(s) for s in sets])]
    maps = bitmaps(np.concatenate(sets), offsets, 2)
    for i in range(0, 60, 2):
        bits = sum(bin(int(m[i]) ^ int(m[i + 1]) & (2**64 - 1)).count("1") if (m[i] >= 0 and m[i + 1] >= 0) else bin((int(m[i]) ^ int(m[i + 1])) & (2**64 - 1)).count("1") for m in maps)
        assert bits <= len(np.setxor1d(sets[i], sets[i + 1]))
    assert band_keys(np.concatenate(sets), offsets, 3, 2, 1).shape == (60, 3)
