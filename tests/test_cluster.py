"""Clustering against plain sequential loops on small random inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinframe.operators import cluster, pairs

SCHEMA = "face_order long, face_id long, label string, face_quality string, embedding array<float>"


def unit(v):
    return (v / np.linalg.norm(v)).astype(np.float32)


def make_faces(seed, n=60, dim=8, groups=6, spread=0.9, copies=True):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    rows = []
    for i in range(n):
        g = int(rng.integers(groups))
        v = unit(centres[g] + spread * rng.normal(size=dim))
        tier = str(rng.choice(["high", "medium", "low"], p=[0.5, 0.25, 0.25]))
        rows.append([i, 1000 + i, f"g{g}", tier, v])
    if copies:
        for i in range(0, n - 8, 9):
            for k in range(1, 4):
                rows[i + k][4] = rows[i][4]
    return [(r[0], r[1], r[2], r[3], [float(x) for x in r[4]]) for r in rows]


def cos(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    d = np.sqrt(a @ a) * np.sqrt(b @ b)
    return float(a @ b / d) if d > 0 else 0.0


def naive_root(rows, t, low_join=0.6):
    """Scan for the best pair of live roots, merge, repeat."""
    m = len(rows)
    low = [r[3] in ("low", "very_low") for r in rows]
    s = np.zeros((m, m))
    for i in range(m):
        for j in range(i + 1, m):
            same = rows[i][4] == rows[j][4]
            s[i, j] = s[j, i] = float(np.float32(1.0 if same else cos(rows[i][4], rows[j][4])))
    root, size, blocked = list(range(m)), [1] * m, set()
    while True:
        best, pick = t, None
        for i in range(m):
            for j in range(i + 1, m):
                a, b = root[i], root[j]
                if a != b and s[a, b] > best and (min(a, b), max(a, b)) not in blocked:
                    best, pick = s[a, b], (a, b)
        if pick is None:
            return root
        a, b = pick
        if (low[a] and low[b]) or ((low[a] or low[b]) and best < low_join):
            blocked.add((min(a, b), max(a, b)))
            continue
        keep, gone = (a, b) if size[a] >= size[b] else (b, a)
        size[keep] += size[gone]
        root = [keep if r == gone else r for r in root]


def naive_greedy(rows, t, low_join, low_low):
    m = len(rows)
    group = {i: [i] for i in range(m)}
    of = list(range(m))
    cent = {i: np.asarray(rows[i][4], np.float32) for i in range(m)}
    edges = sorted(
        ((cos(rows[i][4], rows[j][4]), i, j) for i in range(m) for j in range(i + 1, m)),
        key=lambda e: (-round(e[0], 12), e[1], e[2]),
    )
    for s, i, j in edges:
        lows = (rows[i][3] == "low") + (rows[j][3] == "low")
        if s < t - 1e-12 or s < [t, low_join, low_low][lows] - 1e-12:
            continue
        a, b = of[i], of[j]
        if a == b or cos(cent[a], cent[b]) < t:
            continue
        na, nb = len(group[a]), len(group[b])
        cent[a] = ((cent[a].astype(float) * na + cent[b].astype(float) * nb) / (na + nb)).astype(np.float32)
        for k in group[b]:
            of[k] = a
        group[a] += group.pop(b)
    return [min(group[of[i]]) for i in range(m)]


def partition(labels):
    groups = {}
    for i, g in enumerate(labels):
        groups.setdefault(g, set()).add(i)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("path", ["local", "rounds", "implicit"])
def test_root_linkage(spark, seed, path):
    rows = make_faces(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    kw = {"local": {}, "rounds": {"local_edges": 3, "block_rows": 16}, "implicit": {"edges_per_face": 0, "sure_edges": 0, "block_rows": 16}}[path]
    got = {r["face_order"]: (r["root"], r["cluster"]) for r in cluster.cluster_faces(df, 0.45, **kw).collect()}
    want = naive_root(rows, 0.45)
    assert [got[i][0] for i in range(len(rows))] == want
    first = {r: min(i for i, x in enumerate(want) if x == r) for r in set(want)}
    assert [got[i][1] for i in range(len(rows))] == [first[r] for r in want]


def test_quality_example(spark):
    """Two synthetic identities: the low face joins, the very_low one has no vector."""
    vec = lambda seed: [float(x) for x in unit(np.sin(seed * np.arange(1, 65)) * 0.01)]
    rows = [
        (1, 1, None, "high", vec(1)), (2, 2, None, "high", vec(1)), (3, 3, None, "low", vec(1)),
        (4, 4, None, "high", vec(2)), (5, 5, None, "very_low", None), (6, 6, None, "high", vec(2)),
    ]
    got = {r["face_order"]: r["cluster"] for r in cluster.cluster_faces(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 6: 4}


@pytest.mark.parametrize("seed,local_edges", [(3, 100_000), (4, 100_000), (3, 2), (4, 2)])
def test_greedy(spark, seed, local_edges):
    rows = make_faces(seed, n=26)
    df = spark.createDataFrame(rows, SCHEMA)
    out = cluster.cluster_greedy(df, 0.5, low_join=0.6, low_low=0.65, local_edges=local_edges, block_rows=16).collect()
    got = {r["face_order"]: r["cluster"] for r in out}
    assert partition([got[i] for i in range(len(rows))]) == partition(naive_greedy(rows, 0.5, 0.6, 0.65))


def test_running_average(spark):
    rows = make_faces(5, n=80, copies=False)
    got = {r["face_order"]: (r["label"], r["cluster"]) for r in
           cluster.cluster_running_average(spark.createDataFrame(rows, SCHEMA), 0.6).collect()}
    for label in {r[2] for r in rows}:
        centres = []
        for r in (r for r in rows if r[2] == label):
            best, at = 0.6, None
            for k, c in enumerate(centres):
                if cos(r[4], c) > best:
                    best, at = cos(r[4], c), k
            if at is None:
                centres.append(np.asarray(r[4], float))
                at = len(centres) - 1
            else:
                centres[at] = (centres[at] + np.asarray(r[4], float)) / 2
            assert got[r[0]] == (label, at + 1)


def test_running_average_of_one_hot_label(spark):
    """Hundreds of centroids, over many blocks and batches, beside small labels."""
    rng = np.random.default_rng(4)
    rows = [(i, "hot" if i % 9 else f"l{i % 4}", rng.normal(size=6).astype(np.float32).tolist()) for i in range(3000)]
    rows[77] = (77, "hot", [0.0] * 6)
    df = spark.createDataFrame(rows, "face_order long, label string, embedding array<float>")
    got = {r.face_order: r.cluster for r in cluster.cluster_running_average(df, 0.9).collect()}
    centres = {}
    for order, label, v in rows:
        v, mine = np.asarray(v, float), centres.setdefault(label, [])
        sims = [cos(c, v) if np.any(v) and np.any(c) else 0.0 for c in mine]
        at = int(np.argmax(sims)) if sims and np.any(v) else -1
        if at < 0 or sims[at] <= 0.9:
            mine.append(np.float32(v).astype(float))
            at = len(mine) - 1
        else:
            mine[at] = np.float32((mine[at] + v) / 2).astype(float)
        assert got[order] == at + 1
    assert len(centres["hot"]) > 300


@pytest.mark.parametrize("local", [cluster.LOCAL_EDGES, 0])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(cluster, "LOCAL_EDGES", local)
    edges = [(i, i + 1) for i in range(0, 30) if i % 7] + [(40, 41), (41, 40), (50, 99)]
    got = {r["id"]: r["component"] for r in cluster.connected_components(spark.createDataFrame(edges, "id_a long, id_b long")).collect()}
    parent = {}
    for a, b in edges:
        parent.setdefault(a, a), parent.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(parent[a], parent[b])
            if parent[a] != low or parent[b] != low:
                parent[a] = parent[b] = low
                changed = True
    assert got == parent


@pytest.mark.parametrize("block_rows", [4096, 7])
def test_similar_pairs(spark, block_rows):
    rows = make_faces(6, n=70)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["id_a"], r["id_b"]): round(r["sim"], 6) for r in pairs.similar_pairs(df, 0.8, block_rows=block_rows).collect()}
    want = {
        (a[1], b[1]): round(cos(a[4], b[4]), 6)
        for i, a in enumerate(rows) for b in rows[i + 1:] if cos(a[4], b[4]) >= 0.8 - 1e-12
    }
    assert got == want
    # Linked copies carry the same information: following the links gives all pairs back.
    linked = {(r["id_a"], r["id_b"]): round(r["sim"], 6) for r in pairs.similar_pairs(df, 0.8, block_rows=block_rows, copies="linked").collect()}
    assert set(linked) < set(want) and all(want[k] == s for k, s in linked.items())
    by_vec = {}
    for r in rows:
        by_vec.setdefault(tuple(r[4]), []).append(r[1])
    lead = {i: g[0] for g in by_vec.values() for i in g}
    rebuilt = {
        (a, b) for i, a in enumerate(sorted(lead)) for b in sorted(lead)[i + 1:]
        if lead[a] == lead[b] or tuple(sorted((lead[a], lead[b]))) in linked
    }
    assert rebuilt == set(want)
    assert {(lead[i], i) for i in lead if lead[i] != i} <= set(linked)


@pytest.mark.parametrize("block_rows", [4096, 9])
def test_pair_reducers(spark, block_rows):
    rows = make_faces(7, n=50)
    df = spark.createDataFrame(rows, SCHEMA)
    sims = [(cos(a[4], b[4]), a, b) for i, a in enumerate(rows) for b in rows[i + 1:]]
    reps = pairs.materialize(pairs.collapse_copies(df, "face_id", "embedding"))
    found = {r["id"] for r in pairs.rows_with_partner(reps, 0.9, block_rows).collect()}
    lone = {a[1] for a in rows} - {x[1] for s, a, b in sims if s >= 0.9 - 1e-12 for x in (a, b)}
    kept = {r["id"] for r in reps.collect()}
    assert found == kept - lone

    labelled = pairs.materialize(pairs.collapse_copies(df, "face_id", "embedding", ["label"]))
    same = lambda a, b: (a["label"] == b["label"]).astype(int)
    got = pairs.similarity_quantiles(labelled, ["label"], same, 2, [0.0, 0.1, 0.5, 0.9, 1.0], block_rows=block_rows)
    for code in (0, 1):
        ordered = sorted(np.float32(s) for s, a, b in sims if (a[2] == b[2]) == bool(code))
        n, values = got[code]
        assert n == len(ordered)
        for p, v in values.items():
            assert abs(v - ordered[min(n - 1, int(np.floor(p * n)))]) < 2e-7

    top = [(round(r["sim"], 9), r["id_a"], r["id_b"]) for r in pairs.closest_pairs(reps, 10, block_rows).collect()]
    distinct = [(s, a, b) for s, a, b in sims if a[1] in kept and b[1] in kept]
    want = sorted(((round(s, 9), a[1], b[1]) for s, a, b in distinct), key=lambda r: (-r[0], r[1], r[2]))[:10]
    assert top == want
