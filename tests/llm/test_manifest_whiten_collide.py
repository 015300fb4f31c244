"""Manifest, whitening and collision counting against brute force."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.llm import collide, merkle, whiten


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    rows = [leaves]
    while len(rows[-1]) > 1:
        rows.append([h(*rows[-1][i : i + 8]) for i in range(0, len(rows[-1]), 8)])
    return rows


def siblings(rows, i):
    out = []
    for row in rows[:-1]:
        first = i // 8 * 8
        out.append((row[first:i], row[i + 1 : first + 8]))
        i //= 8
    return out


@pytest.mark.parametrize("n", [1, 2, 8, 9, 63, 64, 65, 512, 513, 700, 4096])
def test_fractal_traversal_gives_every_path(n):
    leaves = [h(str(i)) for i in range(n)]
    rows = tree(leaves)
    got = list(merkle.traverse(leaves, merkle.height(n)))
    assert got == [siblings(rows, i) for i in range(n)]
    assert all(merkle.fold(leaf, path) == rows[-1][0] for leaf, path in zip(leaves, got, strict=True))
    assert merkle.block_root(leaves, merkle.height(n)) == rows[-1][0]


def test_traversal_of_a_short_last_block_climbs_all_levels():
    leaves = [h(str(i)) for i in range(3)]
    paths = list(merkle.traverse(leaves, 4))
    assert [len(p) for p in paths] == [4, 4, 4] and paths[0][1:] == [([], [])] * 3
    assert merkle.fold(leaves[1], paths[1]) == merkle.block_root(leaves, 4) == h(h(h(h(*leaves))))


def test_subtrees_hold_little():
    tree_ = merkle.Subtree([h(str(i)) for i in range(4096)], 1, 0, 4)
    for _ in range(4096):
        tree_.grow()
        assert sum(map(len, tree_.open)) <= 7 * 4 and sum(map(len, tree_.rows)) <= 64 + 8 + 1


def brute_manifest(rows):
    """rows (lang, doc_id, leaf, claim) -> sorted result rows."""
    groups = {}
    for lang, doc_id, leaf, claim in rows:
        groups.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, claim or "", doc_id, claim))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([r[2] for r in sorted(groups[g])]) for g in names}
    top = tree([trees[g][-1][0] for g in names]) if names else None
    out = []
    for at, g in enumerate(names):
        for i, (_, _, leaf, _, doc_id, claim) in enumerate(sorted(groups[g])):
            path = siblings(trees[g], i) + siblings(top, at)
            folded = merkle.fold(claim or leaf, path)
            out.append((g, doc_id, leaf, trees[g][-1][0], top[-1][0], h(*[d for b, a in path for d in b + a]), folded, folded == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["mixed", "alone", "copies"])
def test_manifest(spark, kind):
    claim = lambda i: h(f"x{i}") if i % 3 == 0 else None
    rows = {
        "mixed": [("en", i, h(str(i)), claim(i)) for i in range(4200)] + [(f"l{i % 9}", i, h(f"l{i}"), claim(i)) for i in range(90)]
        + [(None, None, h("n"), h("m")), (None, 7, h("7"), None), ("é", 2**60 + 1, h("big"), None), ("en", None, h("none"), None)],
        "alone": [("en", 1, h("1"), None)],
        "copies": [("en", 1, h("1"), None)] * 5000 + [("en", 1, h("1"), h("2"))] * 3 + [("de", 5, h("5"), None)] * 9,
    }[kind]
    df = spark.createDataFrame(rows, "lang string, doc_id bigint, leaf string, claim string").withColumn("root", F.lit("clash")).repartition(3)
    got = merkle.manifest(df, claim="claim", siblings=True).collect()
    assert sorted([tuple(r[:8]) for r in got], key=str) == brute_manifest(rows)
    assert all(h(*r["siblings"]) == r["proof_sha256"] for r in got)


def test_every_row_is_folded(spark, monkeypatch):
    monkeypatch.setattr(merkle, "fold", lambda digest, path: "folded")
    df = spark.createDataFrame([("en", i, h(str(i)), h("x") if i % 3 == 0 else None) for i in range(20)], "lang string, doc_id bigint, leaf string, claim string")
    assert {(r["folded_root"], r["verified"]) for r in merkle.manifest(df, claim="claim").collect()} == {("folded", False)}


def test_empty_manifest(spark):
    assert merkle.manifest(spark.createDataFrame([], "lang string, doc_id bigint, leaf string")).count() == 0


def test_document_leaves(spark):
    row = (12, "Ünï A", None, "s", 5)
    df = spark.createDataFrame([row, (None, None, None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars int")
    got = {r["doc_id"]: r for r in merkle.document_leaves(df).collect()}
    assert got[12]["leaf"] == h("2:12", "1:s", "-", "1:5", "7:Ünï A") and got[None]["leaf"] == h("-----") and got[None]["claim"] is None


def test_residues_are_exact():
    r = np.random.default_rng(1)
    x = r.integers(-(2**50), 2**50, (5000, 3))
    n, sums = 5000, [int(s) for s in x.astype(object).sum(0)]
    y = x.astype(object) * n - np.array(sums, object)
    moduli = whiten.basis(n * int(np.abs(y).max()) ** 2)
    assert (whiten.reconstruct(whiten.scatter_residues(x, n, sums, moduli), moduli) == y.T @ y).all()
    assert len(set(moduli)) == len(moduli) and all(p < 2**21 and all(p % d for d in range(2, 1449)) for p in moduli)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("x", F.lit("clash")).repartition(3)


def brute_whitening(x):
    u = sorted({tuple(v) for v in x})
    n, d = len(u), len(u[0])
    sums = [sum(v[i] for v in u) for i in range(d)]
    y = [[n * v[i] - sums[i] for i in range(d)] for v in u]
    cov = np.array([[float(Fraction(sum(a[i] * a[j] for a in y), n**3)) for j in range(d)] for i in range(d)])
    return n, sums, cov


def test_whitening(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(400, 5)) @ r.normal(size=(5, 5)) + 100
    rows = [(i, [float(np.float32(c)) for c in v], 1) for i, v in enumerate(base)]
    rows += [(5, rows[5][1], 1), (900, rows[5][1], 1), (None, rows[6][1], 1), (901, None, 1), (902, [1.0, None, 1.0, 1.0, 1.0], 1), (903, [float("nan")] * 5, 1), (904, [float("inf")] * 5, 1), (905, [], 1), (906, [1.0], 1), (907, [3e30] * 5, 1)]
    got = whiten.whiten(vectors(spark, rows)).collect()
    whole = {i: [math.floor(64 * np.float64(np.float32(c))) + 1_000_000 for c in v] for i, v in [(i, v) for i, v, _ in rows] if v and len(v) == 5 and all(c is not None and abs(c) < 1e9 for c in v)}
    n, sums, cov = brute_whitening(whole.values())
    e, w = np.linalg.eigh(cov)
    assert len(got) == 403 * 5 and {r["n"] for r in got} == {n} and {r["identity_error"] for r in got}.pop() < 1e-9
    by_component = {}
    for r in got:
        own = whole[r["vec_id"]]
        assert r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(own, sums, strict=True))
        value, vector = e[-r["component"]], w[:, -r["component"]]
        want = float(np.array([(n * a - s) / n for a, s in zip(own, sums, strict=True)]) @ vector) / math.sqrt(value)
        assert abs(r["explained"] - value / np.trace(cov)) < 1e-10 and abs(abs(r["whitened"]) - abs(want)) < 1e-6
        if abs(want) > 1e-3:
            by_component.setdefault(r["component"], set()).add(r["whitened"] * want > 0)
    assert all(len(s) == 1 for s in by_component.values())


def test_whitening_without_variance(spark):
    assert whiten.whiten(vectors(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)])).count() == 0
    assert whiten.whiten(vectors(spark, [(1, None, 1)])).count() == 0
    flat = whiten.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 5.0], 1) for i in range(50)])).collect()
    assert {r["component"] for r in flat} == {1} and abs(flat[0]["explained"] - 1) < 1e-12


def brute_links(rows, cosine):
    fine = [k for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    part, links = list(range(len(rows))), [0] * len(rows)

    def find(a):
        while part[a] != a:
            a = part[a]
        return a

    for a in fine:
        for b in fine:
            if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.float32(rows[a][1]).astype(float), np.float32(rows[b][1]).astype(float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[a] += 1
                    part[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k in fine:
        least[find(k)] = min(least.get(find(k), rows[k][0]), rows[k][0])
    return sorted([(i, links[k], least.get(find(k), i)) for k, (i, _, _) in enumerate(rows)], key=str)


@pytest.fixture(scope="module")
def planted_rows():
    r = np.random.default_rng(4)
    base = r.normal(size=(60, 32))
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(base)]
    for k in range(120):  # cosines on both sides of the threshold, chains included
        of = base[k % 20]
        rows.append((100 + k, (of * r.uniform(0.1, 9) + r.normal(size=32) * np.linalg.norm(of) / math.sqrt(32) * 0.2).tolist(), k % 20 % 3))
    rows += [(300 + k, base[0].tolist(), 0) for k in range(30)] + [(0, base[0].tolist(), 0), (7, base[8].tolist(), 2)]
    return rows + [(400, None, 0), (401, [0.0] * 32, 0), (402, [0.0] * 32, 0), (403, [float("nan")] * 32, 0), (404, base[0].tolist(), None), (None, base[0].tolist(), 0), (405, [1.0], 0), (406, [2.0], 0), (407, [], 0), (408, [1.0, None], 0)]


@pytest.mark.parametrize("cell", [5000, 12])
def test_collisions(spark, planted_rows, monkeypatch, cell):
    monkeypatch.setattr(collide, "CELL", cell)
    got = collide.near_duplicates(vectors(spark, planted_rows)).collect()
    want = brute_links(planted_rows, 0.98)
    assert sorted([(r["vec_id"], r["n_links"], r["component_id"]) for r in got], key=str) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got) and sum(x[1] for x in want) > 1000


def test_collisions_of_nothing(spark):
    assert collide.near_duplicates(vectors(spark, [])).count() == 0
    assert [tuple(r) for r in collide.near_duplicates(vectors(spark, [(1, None, 1)])).collect()] == [(1, 0, 1, True)]


def test_calibrated_count_keeps_planted_pairs():
    sample = np.random.default_rng(6).normal(size=(2000, 64))
    plan = collide.calibrate(sample, 0.98)
    x, y = collide.planted(np.random.default_rng(7).normal(size=(4000, 64)), 0.98)
    a = collide.directions(64)
    close = np.abs(x @ a - y @ a) <= plan.window
    passed = close.sum(1) >= plan.least
    assert passed.mean() > 0.997 and np.allclose((x * y).sum(1), 0.98)
    # Whatever passes collides in all windows of one group, and there the query visits the member's cell.
    grid = collide.Plan(plan.cosine, plan.window, plan.least, 4)
    whole = np.stack([close[:, g].all(1) for g in grid.groups], 1)
    assert whole.any(1)[passed].all()
    for q, m, inside in list(zip(x @ a, y @ a, whole, strict=True))[:500]:
        assert all(collide.visits(m, grid, g)[0] in collide.visits(q, grid, g) for g, ok in zip(grid.groups, inside, strict=True) if ok)


def test_every_vector_calibrates(spark, monkeypatch):
    monkeypatch.setattr(collide, "TOGETHER", 64)
    monkeypatch.setattr(collide, "CELL", 50)
    v = np.random.default_rng(5).normal(size=(300, 16))
    rows = [(i, i % 2, {"vec_id": i, "a": i, "b": -i}, x.tolist(), 16) for i, x in enumerate(v)]
    entries = spark.createDataFrame(rows, f"n int, label int, node {collide.NODE}, v array<double>, d int").repartition(5)
    # All but the smallest counts of one pair in a thousand must be reached, whatever holds them.
    monkeypatch.setattr(collide, "reached", lambda vectors, plan: np.bincount([7] * len(vectors), minlength=collide.PROJECTIONS + 1))
    assert collide.calibrate_all(entries, 0.98).least == 7
    plan = collide.Plan(0.98, collide.open_plan(0.98).window, 22)
    group = plan.groups[0]
    at = np.floor(collide.units(v) @ collide.directions(16) / (4 * plan.window))[:, group]
    most = [max(np.unique(at[label::2, :k], axis=0, return_counts=True)[1].max() for label in (0, 1)) for k in range(1, len(group) + 1)]
    assert collide.grid_size(entries, plan, 150) == next((k for k, m in enumerate(most, 1) if m <= 50), len(group))
