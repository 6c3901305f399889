"""Brute-force checks of pair search, components, ranks and splits, hot groups included."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lumentab.functions.hashing import coefficient_bits, from_hex16, to_hex16
from lumentab.operators import dedup as D, joins as J, splits as S
from lumentab.operators.graph import components
from lumentab.operators.phash import low_dct, perceptual_hash
from lumentab.operators.ranking import exact_quantiles, row_numbers, running_sum


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


def bits(v):
    return bin(v & ((1 << 64) - 1)).count("1")


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=6), st.integers(1, 3))
def test_block_masks_cover_every_near_pair(value, flips, picks):
    other = value
    for f in flips:
        other ^= 1 << f
    assert any((value ^ other) & m == 0 for m in D.block_masks(6, picks))


def corpus(seed, copies=40):
    """Random hashes, near copies, a third of all rows in one copy group, a hot bucket."""
    rng = random.Random(seed)
    rows, n = [], 0

    def add(p, d):
        nonlocal n
        rows.append((n * 7 % 1009, rng.randrange(3), signed(p), signed(d)))
        n += 1

    flip = lambda v, k: v ^ sum(1 << b for b in rng.sample(range(64), k))
    for _ in range(60):
        p, d = rng.getrandbits(64), rng.getrandbits(64)
        add(p, d)
        for _ in range(rng.randrange(3)):
            add(flip(p, rng.randrange(9)), flip(d, rng.randrange(9)))
    for _ in range(copies):
        add(2**63 + 5, 0)
    for _ in range(60):  # same low bands of both hashes, other bits random
        add((rng.getrandbits(40) << 24) | 3, (rng.getrandbits(40) << 24) | 9)
    base = rng.getrandbits(64)
    for _ in range(25):
        add(flip(base, rng.randrange(5)), 77)
    return rows


def brute(rows):
    out = set()
    rows = sorted(rows)
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            dp, dd = bits(a[2] ^ b[2]), bits(a[3] ^ b[3])
            if dp <= 6 and dd <= 6:
                out.add((a[0], a[1], b[0], b[1], dp, dd, a[1] == b[1]))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "image_id long, class_index int, phash long, dhash long")


@pytest.mark.parametrize("hot,picks", [(20000, 1), (32, 1), (20000, 2), (None, None), (48, (0, 3))])
def test_pairs_equal_brute_force(spark, hot, picks):
    rows = corpus(1)
    h = frame(spark, rows)
    want = brute(rows)
    got = [tuple(r) for r in D.image_pairs(h, hot=hot, picks=picks).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    s = D.near_summary(D.near_duplicates(h, hot=hot), h).first()
    assert s["candidate_pairs"] == len(want) and s["same_class_pairs"] == sum(w[-1] for w in want)


@pytest.mark.parametrize("k", [3, 40, 2000])
def test_closest_pairs_equal_brute_force(spark, k):
    rows = corpus(2)
    want = sorted(brute(rows), key=lambda r: (r[6], r[4] + r[5], r[4], r[0], r[2]))[:k]
    assert [tuple(r) for r in D.closest_pairs(frame(spark, rows), k).collect()] == want


def repeating(seed):
    """Every id stands in about four rows: with other codes, with one code in two classes, and twice over."""
    rows = [(i * 5 % 47, *r) for i, (_, *r) in enumerate(corpus(seed, copies=25))]
    return rows + rows[:20] + [(i, (c + 1) % 3, p, d) for i, c, p, d in rows[40:70]]


def brute_rows(rows):
    out = []
    for a in rows:
        for b in rows:
            dp, dd = bits(a[2] ^ b[2]), bits(a[3] ^ b[3])
            if a[0] < b[0] and dp <= 6 and dd <= 6:
                out.append((a[0], a[1], b[0], b[1], dp, dd, a[1] == b[1]))
    return out


def test_rows_of_one_image_id_are_no_pairs(spark):
    rows = repeating(3)
    h, want = frame(spark, rows), brute_rows(rows)
    assert sorted(tuple(r) for r in D.image_pairs(h).collect()) == sorted(want)
    s = D.near_summary(D.near_duplicates(h), h).first()
    assert (s["candidate_pairs"], s["same_class_pairs"]) == (len(want), sum(w[-1] for w in want))
    codes = {}
    for i, _, p, d in rows:
        codes.setdefault((p, d), []).append(i)
    compact = {}
    for a in rows:
        for b in rows:
            dp, dd = bits(a[2] ^ b[2]), bits(a[3] ^ b[3])
            if a[0] < b[0] and dp <= 6 and dd <= 6:
                x, y = codes[a[2:]], codes[b[2:]]
                f, g = (x, y) if min(x) <= min(y) else (y, x)
                n = compact.setdefault((min(f), min(g), dp, dd, len(f), len(g)), [0, 0])
                n[0] += 1
                n[1] += a[1] == b[1]
    assert {tuple(r)[:6]: list(r)[6:] for r in D.near_duplicates(h).collect()} == compact
    assert D.near_duplicates(h).count() == len(compact)


@pytest.mark.parametrize("k", [1, 40, 500])
def test_closest_pairs_of_repeated_ids(spark, k):
    rows = repeating(4)
    order = lambda r: (r[6], r[4] + r[5], r[4], r[0], r[2])
    want = sorted(brute_rows(rows), key=order)
    got = [tuple(r) for r in D.closest_pairs(frame(spark, rows), k).collect()]
    assert [order(r) for r in got] == [order(r) for r in want[:k]]
    # the order leaves the classes of one pair of ids open at the cut only
    last = order(want[k - 1])
    assert sorted(r for r in got if order(r) != last) == sorted(r for r in want if order(r) < last) and set(got) <= set(want)


def test_components_of_repeated_ids(spark):
    rows = repeating(5)[:60]
    root = {r[0]: r[0] for r in rows}
    for a, _, b, *_ in brute_rows(rows):
        low, high = sorted((root[a], root[b]))
        root = {k: low if v == high else v for k, v in root.items()}
    got = sorted(tuple(r) for r in D.similarity_components(frame(spark, rows)).collect())
    assert got == sorted((r[0], r[1], root[r[0]]) for r in rows)


def scattered(spark, n):
    """Codes of which a fifth share 20 bits of both hashes."""
    flat = lambda c: F.when(F.col("id") % 5 == 0, c.bitwiseAND(F.lit(-1048576))).otherwise(c)
    return spark.range(n).select(F.col("id").alias("code_id"), flat(F.xxhash64("id", F.lit(1))).alias("phash"), flat(F.xxhash64("id", F.lit(2))).alias("dhash"))


def test_keys_grow_with_the_codes_and_candidates_do_not(spark):
    per_code, keys = [], []
    for n in (1000, 32000):
        k = D.code_keys(scattered(spark, n), 6, 6, copy=1, hot=10**9)
        held = k.rows.groupBy(*k.on).count().withColumn("c", F.col("count").cast("double"))
        pairs = held.agg(F.sum(F.col("c") * (F.col("c") - 1) / 2)).first()[0]
        per_code.append(pairs / n)
        keys.append(len(k.phash) * len(k.dhash))
    assert keys[0] < keys[1]
    # one choice for both sizes would give 32 times the candidates
    assert per_code[1] < 8 * max(per_code[0], 1)


def test_closest_pairs_stop_in_a_wide_level_of_ties(spark):
    # 400 codes of one image at distance 2 or 4 from each other (79,800 pairs), and one group of 300 copies of two classes
    ties = [(1000 + i, i % 3, 1 << (i % 20), 1 << (i // 20)) for i in range(400)]
    near = [t for t in ties if t[0] < 1020] + [(5000 + i, i % 2, -1, -1) for i in range(300)]
    for rows in (ties, near):
        full = sorted(brute(rows), key=lambda r: (r[6], r[4] + r[5], r[4], r[0], r[2]))
        for k in (7, 45):
            assert [tuple(r) for r in D.closest_pairs(frame(spark, rows), k).collect()] == full[:k]


def test_closest_pairs_of_one_class_only(spark):
    rows = [(i, 1, i % 4, 9) for i in range(30)]
    want = sorted(brute(rows), key=lambda r: (r[6], r[4] + r[5], r[4], r[0], r[2]))[:50]
    assert [tuple(r) for r in D.closest_pairs(frame(spark, rows), 50).collect()] == want
    assert D.closest_pairs(frame(spark, rows[:1]), 5).collect() == []


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 180)]
    rng.shuffle(chain)
    star = [(500, i) for i in range(501, 620)]
    noise = [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    zigzag = [(2000 + (i * 37) % 64, 2000 + ((i + 1) * 37) % 64) for i in range(63)]
    edges, nodes = chain + star + noise + zigzag, list(range(0, 2100))
    e = spark.createDataFrame(edges, "u long, v long")
    n = spark.createDataFrame([(i,) for i in nodes], "id long")
    got = {r["id"]: r["component"] for r in components(n, e).collect()}
    assert got == union_find(nodes, edges)


def test_components_without_edges(spark):
    n = spark.range(3)
    e = spark.createDataFrame([], "u long, v long")
    assert {r["id"]: r["component"] for r in components(n, e).collect()} == {0: 0, 1: 1, 2: 2}


def greedy_by_steps(groups, seed=42):
    """The split rule one group at a time."""
    import hashlib

    out, by_class = {}, {}
    for c, g, n in groups:
        by_class.setdefault(c, []).append((g, n))
    for c, items in by_class.items():
        items.sort(key=lambda t: (-t[1], hashlib.md5(f"{seed}:{c}:{t[0]}".encode()).hexdigest(), t[0]))
        total = sum(n for _, n in items)
        target = [total * 0.70, total * 0.15, total * 0.15]
        have = [0, 0, 0]
        for i, (g, n) in enumerate(items):
            k = i if i < 3 else max(range(3), key=lambda k: (target[k] - have[k], -have[k], -k))
            have[k] += n
            out[g] = S.SPLITS[k]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_grouped_split_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    groups = []
    for c in range(6):
        for i in range(rng.choice([3, 20, 77, 400])):
            groups.append((c, f"g{c}_{i}", rng.choice([1, 1, 1, 2, 3, 5, rng.randrange(1, 40)])))
    if seed == 3:  # one class holds most rows, nearly all of one size
        groups += [(9, f"h{i}", 1) for i in range(6000)] + [(9, "big", 700)]
    df = spark.createDataFrame(groups, "class_index int, group_id string, group_size long")
    got = {r["group_id"]: r["split"] for r in S.grouped_split(df).collect()}
    assert got == greedy_by_steps(groups)


def test_sliced_ranks_sums_and_quantiles(spark):
    """More rows than the sample, one key with a third of them, many equal values."""
    rng = np.random.default_rng(5)
    n = 9000
    key = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 40, n))
    val = np.where(rng.random(n) < 0.3, 1.5, np.round(rng.normal(size=n), 3))
    df = spark.createDataFrame(list(zip(range(n), key.tolist(), val.tolist())), "id long, key long, val double").repartition(5)
    ranked = {r["id"]: r["r"] for r in row_numbers(df, ["val", "id"], "r").collect()}
    order = sorted(range(n), key=lambda i: (val[i], i))
    assert all(ranked[i] == pos + 1 for pos, i in enumerate(order))
    per = {r["id"]: r["s"] for r in running_sum(df, ["id"], F.lit(1).cast("bigint"), "s", ["key"]).collect()}
    seen = {}
    for i in range(n):
        seen[key[i]] = seen.get(key[i], 0) + 1
        assert per[i] == seen[key[i]]
    q = exact_quantiles(df.withColumn("twice", F.col("val") * 2), {"a": ("val", 0.01), "b": ("val", 0.5), "c": ("twice", 0.99)}).first()
    assert np.allclose([q["a"], q["b"], q["c"]], [np.percentile(val, 1), np.percentile(val, 50), np.percentile(val * 2, 99)])


def test_adjacent_images_across_splits(spark):
    rows = [("IMG_1", 0, "train", 1), ("IMG_2", 0, "test", 2), ("IMG_4", 0, "test", 4), ("IMG_9", 0, "train", 9), ("x", 0, "train", None), ("IMG_3", 1, "train", 3)]
    m = spark.createDataFrame(rows, "stem string, class_index int, split string, number long")
    got = [tuple(r) for r in S.adjacent_across_splits(m, 2, ["number", "stem"]).collect()]
    assert got == [(0, "IMG_1", "train", "IMG_2", "test", 1)]
    with pytest.raises(ValueError):
        S.adjacent_across_splits(m, -1, ["number", "stem"])


def test_folds_drop_the_remainder(spark):
    f = S.contiguous_folds(spark.range(23).withColumnRenamed("id", "i"), "i", 4).collect()
    valid = {(r["fold"], r["i"]) for r in f if r["part"] == "valid"}
    assert valid == {(i // 5, i) for i in range(20)} and len(f) == 80
    with pytest.raises(ValueError):
        S.contiguous_folds(spark.range(3), "id", 1)


def test_class_map_problems(spark):
    bad = lambda rows: {r["check"]: r["violations"] for r in J.class_map_problems(spark.createDataFrame(rows, "name string, idx int")).collect()}
    assert sum(bad([("a", 0), ("b", 1)]).values()) == 0
    assert bad([("a", 0), ("b", 2)])["contiguous"] == 1
    assert bad([("a", 1), ("b", 1)])["repeated_index"] == 1
    assert bad([])["empty"] == 1


def test_hex_round_trip_of_negative_hashes(spark):
    values = [0, 1, -1, -(2**63), 2**63 - 1, 81985529216486895]
    df = spark.createDataFrame([(v,) for v in values], "h long").withColumn("x", to_hex16(F.col("h")))
    assert all(r["h"] == r["b"] and len(r["x"]) == 16 for r in df.withColumn("b", from_hex16(F.col("x"))).collect())


def test_dct_hash_equals_numpy(spark):
    rng = np.random.default_rng(6)
    imgs = rng.integers(0, 256, size=(4, 32, 32)).astype(float)
    k = np.arange(32)
    dct = np.sqrt(np.where(k == 0, 1, 2) / 32)[:, None] * np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / 64)
    df = spark.createDataFrame([(i, im.ravel().tolist()) for i, im in enumerate(imgs)], "i int, cells array<double>")
    for r in df.select("i", low_dct(F.col("cells")).alias("d"), perceptual_hash(F.col("cells")).alias("h")).collect():
        low = (dct @ imgs[r["i"]] @ dct.T)[:8, :8].ravel()
        assert np.allclose(r["d"], low)
        want = int("".join("1" if v > np.median(low[1:]) else "0" for v in low), 2)
        assert r["h"] == signed(want)


def test_even_median(spark):
    df = spark.createDataFrame([([9.0, 1.0, 2.0, 3.0, 4.0],)], "v array<double>")
    assert df.select(coefficient_bits(F.col("v"))).first()[0] == 0b10011
