"""Vector operators against brute force, with their defined edge cases."""

import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trailspark.llm import negatives, permutation, queries, vectorcode

SMALL = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def vectors(spark, data):
    df = spark.createDataFrame([(i, v, y) for i, v, y in data], KIND)
    for name in ("dims", "i", "v", "y", "code", "error", "rank", "score", "list", "shelf", "block", "q", "of"):  # names that operators use inside
        df = df.withColumn(name, F.lit("clash"))
    return df


def clustered(rng, n, dims=16, centers=6, spread=0.15):
    middles = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(centers)]
    out = []
    for i in range(n):
        c = rng.randrange(centers)
        out.append((i, [float(np.float32(x + rng.gauss(0, spread))) for x in middles[c]], c % 3 if rng.random() < 0.8 else rng.randrange(3)))
    return out


def odd(rng, dims=16):
    """Rows that take no part, repeated rows, equal vectors, ties."""
    some = [float(np.float32(rng.gauss(0, 1))) for _ in range(dims)]
    none = [(900, None, 1), (901, [None] + some[1:], 1), (902, [NAN] + some[1:], 1), (903, [INF] + some[1:], 2), (904, [-INF] + some[1:], 2)]
    return none + [(910, some, 1), (910, some, 1), (911, some, 2), (912, some, None), (914, some, 1), (1000, some, 0), (1000, some, 0), (1100, some, 1)]


def whole(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def floored(v, scale):
    return [math.floor(scale * float(x)) for x in v]


# --- codes


def brute_codes(data, parts=8, entries=16, rounds=6, scale=4096):
    kept = sorted(((i, floored(v, scale), y) for i, v, y in data if whole(v)), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
    if not kept:
        return [], None
    dims = len(kept[0][1])
    at = [p * dims // parts for p in range(parts + 1)]
    cut = lambda v: [v[at[p] : at[p + 1]] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assigned():
        return [[min((far(s, e), k) for k, e in enumerate(books[p])) for p, s in enumerate(cut(v))] for _, v, _ in kept]

    for _ in range(rounds):
        found = assigned()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(v)[p] for (_, v, _), f in zip(kept, found, strict=True) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = assigned()
    error = [sum(d for d, _ in f) for f in found]
    of_label = {y: sum(e for e, (_, _, z) in zip(error, kept, strict=True) if z == y) for _, _, y in kept}
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, y, "".join(f"{k:02x}" for _, k in f), e, of_label[y]) for (i, _, y), f, e in zip(kept, found, error, strict=True)), key=repr), sha


def coded(spark, data, **options):
    df, _ = vectorcode.encode(vectors(spark, data), **options)
    assert df.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    rows = df.collect()
    assert len({r.codebooks_sha256 for r in rows}) <= 1
    return sorted(((r.vec_id, r.label, r.code, r.error, r.label_error) for r in rows), key=repr), rows[0].codebooks_sha256 if rows else None


@pytest.mark.parametrize(("dims", "n"), [(16, 120), (64, 40), (13, 60), (3, 50), (16, 5)])
def test_codes_are_brute_force(spark, dims, n):
    rng = random.Random(dims * n)
    data = clustered(rng, n, dims) + odd(rng, dims) + [(None, [0.5] * dims, None)]
    rng.shuffle(data)
    assert coded(spark, data) == brute_codes(data)


def test_codes_without_a_broadcast_and_of_few_values(spark):
    rng = random.Random(1)
    data = [(i, [rng.choice((-1.0, 0.0, 1.0)) for _ in range(8)], rng.choice((None, 1, 2))) for i in range(150)]  # ties everywhere
    assert coded(spark, data, broadcast_bytes=0) == brute_codes(data)
    assert coded(spark, data, entries=3, parts=2, rounds=2) == brute_codes(data, parts=2, entries=3, rounds=2)


def test_codes_of_large_components_are_exact(spark):
    data = [(i, [float(2**38 + i % 19 * 2**15)] * 8, i % 2) for i in range(40)]
    assert coded(spark, data) == brute_codes(data)
    with pytest.raises(Exception, match="64 bits"):
        vectorcode.encode(vectors(spark, [(i, [1e12 * i] * 8, 1) for i in range(40)]))[0].collect()


def test_codes_of_several_lengths_and_of_nothing(spark):
    rng = random.Random(3)
    a, b = clustered(rng, 30, 8), [(100 + i, v, y) for i, v, y in clustered(rng, 30, 16)]
    df, books = vectorcode.encode(vectors(spark, a + b))
    got = {(r.vec_id, r.code, r.error) for r in df.collect()}
    assert got == {(i, c, e) for i, _, c, e, _ in brute_codes(a)[0] + brute_codes(b)[0]} and set(books) == {8, 16}
    assert coded(spark, []) == ([], None) and coded(spark, [(1, None, 1), (2, [NAN], 1)]) == ([], None)


def test_exponion_finds_the_nearest_with_fewer_distances():
    rng = np.random.default_rng(5)
    for spread in (1, 50, 5000):
        entries = rng.integers(-4000, 4000, (16, 8))
        rows = entries[rng.integers(0, 16, 3000)] + rng.integers(-spread, spread + 1, (3000, 8))
        all_ = ((rows[:, None] - entries[None]) ** 2).sum(-1)
        for start in (np.zeros(3000, np.int64), rng.integers(0, 16, 3000), all_.argmin(1)):
            code, best, taken = vectorcode.nearest(rows, start, entries)
            assert (code == all_.argmin(1)).all() and (best == all_.min(1)).all()
            if spread == 1 and start is not None and (start == all_.argmin(1)).all():
                assert taken == 3000  # a row at its entry tries no other
            assert taken <= all_.size


# --- permutation index


def brute_nearest(data, k=10, every=100):
    kept = [(i, np.array(v, float)) for i, v, _ in data if i is not None and whole(v) and any(x != 0 for x in v)]
    out = {}
    for at, (i, v) in enumerate(kept):
        if i % every == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for x, (j, w) in enumerate(kept) if x != at and len(w) == len(v))[:k]
            out.setdefault(i, []).append(near)
    return out


def found_nearest(spark, data, **options):
    df = vectors(spark, data)
    return permutation.search(*permutation.build_index(df, **options), df.where("vec_id % 100 = 0")).collect()


def test_agreement_is_the_footrule_distance():
    rng = np.random.default_rng(1)
    orders = np.stack([rng.permutation(30)[:8] for _ in range(50)]).astype(np.int16)
    files = permutation.files_of(orders, 30)
    for a in orders:
        shared = permutation.agreement(a, 50, *files)
        assert [8 * 9 - 2 * s for s in shared] == [permutation.footrule(a, b) for b in orders]


@pytest.mark.parametrize("block_rows", [40, 1 << 13])
def test_nearest_found_against_brute_force(spark, block_rows):
    rng = random.Random(8)
    data = [(i * 5, v, y) for i, v, y in clustered(rng, 400)] + odd(rng) + [(200, [0.0] * 16, 1), (300, [-0.0] * 16, 1), (None, [1.0] * 16, 1)]
    got, want = found_nearest(spark, data, block_rows=block_rows), brute_nearest(data)
    assert {r.query_id for r in got} == set(want)
    hits = total = 0
    for q, lists in want.items():
        own = [r for r in got if r.query_id == q]
        assert sorted(r["rank"] for r in own) == sorted(x for near in lists for x in range(1, len(near) + 1))
        known = {(j, round(d, 9)) for near in lists for d, j in near}
        total += sum(map(len, lists))
        hits += sum((r.vec_id, round(r.score, 9)) in known for r in own)
    assert hits >= 0.9 * total
    equal = sorted(r.vec_id for r in got if r.query_id == 1000 and r.score == 0)  # of both rows 1000, each without itself
    assert equal == [910] * 4 + [911] * 2 + [912] * 2 + [914] * 2 + [1000] * 2 + [1100] * 2


def test_nearest_among_near_copies_few_rows_and_none(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=16)
    near = [(i, [float(np.float32(x)) for x in middle + rng.normal(scale=1e-3, size=16)], 1) for i in range(300)]
    data = near + [(i, v, y) for i, v, y in clustered(random.Random(2), 900) if i >= 300]
    got, want = found_nearest(spark, data), brute_nearest(data)
    hits = sum((r.vec_id in {j for near in want[r.query_id] for _, j in near}) for r in got)
    assert hits >= 0.9 * sum(len(n) for lists in want.values() for n in lists)
    few = found_nearest(spark, [(0, [1.0, 2.0], 1), (1, [1.0, 3.0], 1), (2, [9.0, 3.0], 1), (100, [1.0, 2.0, 3.0], 1), (4, [], 1)])
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1, 1, 1.0), (0, 2, 2, math.sqrt(65))]
    assert found_nearest(spark, []) == []


def test_recall_on_the_given_vectors(spark):
    got = queries.op12_permutation_index(spark, "/root/testdata/sf0.1").collect()
    held = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute_nearest([(i, v, None) for i, v in zip(held.vec_id, held.embedding, strict=True)])
    known = {(q, j) for q, lists in want.items() for near in lists for _, j in near}
    assert len(got) == len(known) and len({(r.query_id, r.vec_id) for r in got} & known) >= 0.9 * len(known)


# --- hard negatives


def brute_negatives(data, positives=5, negatives_=10, window=(30, 90), scale=256):
    kept = [(i, floored(v, scale), y) for i, v, y in data if i is not None and y is not None and whole(v)]
    out = []
    for at, (i, v, y) in enumerate(kept):
        if i % 100:
            continue
        met = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for x, (j, w, z) in enumerate(kept) if x != at and len(w) == len(v))
        for s, p, _ in [m for m in met if m[2] == y][:positives]:
            fits = [(j, -t) for t, j, z in met if z != y and window[0] * -s <= 100 * -t <= window[1] * -s][:negatives_]
            out += [(i, p, r + 1, j, -s, t) for r, (j, t) in enumerate(fits)]
    return sorted(out)


def mined(spark, data, **options):
    df = vectors(spark, data)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = negatives.mine(df, df.where("vec_id % 100 = 0"), **options)
    assert got.columns == names
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("options", [{}, {"shelf_rows": 16, "lists": 9, "pack_rows": 3}, {"lists": 1, "shelf_rows": 50}])
def test_negatives_are_brute_force(spark, options):
    rng = random.Random(6)
    data = [(i * 4, v, y) for i, v, y in clustered(rng, 300)] + [(i, v, y) for i, v, y in odd(rng) if i not in (910, 1000) or True]
    data += [(None, [1.0] * 16, 1), (5000, [1.0] * 8, 1), (5001, [1.0] * 8, 1), (5002, [0.5] * 8, 2), (6000, [], 1)]
    distinct = list({(i, None if v is None else tuple(map(str, v)), y): (i, v, y) for i, v, y in data}.values())
    assert mined(spark, distinct, **options) == brute_negatives(distinct)


def test_negatives_of_ties_and_copies(spark):
    rng = random.Random(7)
    data = [(i, [float(rng.choice((0, 1))) for _ in range(6)], rng.choice((1, 2))) for i in range(240)]
    assert mined(spark, data, lists=5, shelf_rows=20) == brute_negatives(data)
    wide = [(i, [float(rng.randrange(-(2**20), 2**20)) for _ in range(4)], i % 2) for i in range(120)]
    assert mined(spark, wide) == brute_negatives(wide)
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(i, [2.0**28] * 4, i % 2) for i in range(20)])


def test_negatives_of_nothing(spark):
    assert mined(spark, []) == [] and mined(spark, [(0, [1.0], 1)]) == [] and mined(spark, [(0, [1.0], 1), (1, [2.0], 1)]) == []


def test_bounds_skip_lists():
    """On vectors in tight groups a query visits few lists, and bounds hold the scores."""
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(20, 16)) * 1000
    rows = np.round(middles[rng.integers(0, 20, 2000)] + rng.normal(scale=10, size=(2000, 16))).astype(np.int64)
    own, far = negatives.nearest(rows.astype(float), middles)
    radius = np.array([far[own == c].max() for c in range(20)])
    lower, upper = negatives.bounds(rows[:50], middles, radius)
    met = rows[:50] @ rows.T
    assert all((lower[q, own] <= met[q]).all() and (met[q] <= upper[q, own]).all() for q in range(50))
    order = np.argsort(own, kind="stable")
    shelf = pd.Series({"ids": order.astype(np.int64).tobytes(), "lists": own[order].astype(np.int32).tobytes(), "wide": True, "held": rows[order].tobytes(), "n": 2000, "dims": 16, "labels": np.zeros(2000, np.int32).tobytes(), "names": ["x"]})
    directory = negatives.Directory(middles, radius, np.zeros(20, np.int64), np.ones(20, np.int64))
    least, most = np.full(50, -(1 << 63)), np.full(50, (1 << 63) - 1)
    best, visits = negatives.visit(shelf, directory, rows[:50], ["x"] * 50, np.arange(50), least, most, least, k=5, same=True)
    for q, b in enumerate(best):
        assert list(zip(-b.scores, b.ids, strict=True)) == sorted((-met[q, j], j) for j in range(2000) if j != q)[:5]
    assert visits < 50 * 20 / 4
