import random

import numpy as np
from pyspark.sql import functions as F

from strandlake.llm import ann, near_dup

LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def brute_components(rows, k, percent=80):
    sets = []
    for i, t in rows:
        w = [x for x in (t or "").translate(LOWER).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
        sets.append((i, {tuple(w)} if 0 < len(w) < k else {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else set()))
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(((i is None), i or 0, len(s), None if i is None else find(i)) for i, s in sets)


def answer(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in df.collect())


def test_near_duplicates(docs, texts):
    for k in (2, 5):
        out = near_dup.near_duplicates(docs, k=k)
        assert answer(out) == brute_components(texts, k)
        assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in out.collect())


def test_stars_chains_and_edges_of_the_threshold(spark):
    """A centre with many copies that are not alike among themselves, a chain, and pairs just above and below 0.8."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = [(1000, " ".join(base))]
    for i in range(40):
        other = list(base)
        for at in rng.sample(range(100), 4):
            other[at] = f"s{i}x{at}"
        rows.append((900 - i, " ".join(other)))
    walk = [f"c{i}" for i in range(100)]
    for i in range(25):
        walk = list(walk)
        walk[(i * 7) % 100] = f"n{i}"
        walk[(i * 7 + 3) % 100] = f"m{i}"
        rows.append((2000 - i, " ".join(walk)))
    rows += [(3000, "a b c d e f"), (3001, "a b c d e"), (3002, "a b c d"), (3003, "A  B\tc d"), (3004, " ".join(f"t{i}" for i in range(10))), (3005, " ".join(f"t{i}" for i in range(1, 10)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert answer(near_dup.near_duplicates(df, k=2)) == brute_components(rows, 2)


def test_recall_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert answer(near_dup.near_duplicates(docs, k=2)) == brute_components(rows, 2)


def test_nothing_to_link(spark, empty):
    assert near_dup.near_duplicates(empty).count() == 0
    assert answer(near_dup.near_duplicates(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))) == [(False, 1, 0, 1), (False, 2, 0, 2)]


def test_components(spark):
    rng = random.Random(1)
    for n, m in ((50, 30), (60, 90), (200, 150)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n, n + 40)]
        root = {}
        find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
        for a, b in edges:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        got = {r.id: r.comp for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert all(got.get(x, x) == find(x) for x in root)


def exact(vectors, queries, k=10):
    out = {}
    for q, v in queries:
        d = sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, x in vectors if i != q)
        out[q] = d[:k]
    return out


def test_nearest_neighbours(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = [(r.vec_id, np.array(r.embedding, np.float32).astype(np.float64)) for r in df.collect()]
    want = exact(vectors, [v for v in vectors if v[0] % 20 == 0])
    for cells, recall in ((5_000, 0.99), (100, 0.9)):  # one cell, and many of which some are probed
        got = ann.nearest_neighbours(df, df.where("vec_id % 20 = 0"), rows_per_cell=cells).collect()
        hit = sum(r.vec_id in {i for _, i in want[r.query_id]} for r in got)
        assert len(got) == 10 * len(want) and hit / len(got) >= recall
        by = {}
        for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
            by.setdefault(r.query_id, []).append((r.score, r.vec_id))
        known = dict(vectors)
        for q, rows in by.items():
            assert rows == sorted(rows) and len({i for _, i in rows}) == len(rows)
            assert all(abs(s - np.sqrt(((known[q] - known[i]) ** 2).sum())) < 1e-12 for s, i in rows)


def test_ties_copies_and_unusable_vectors(spark):
    one, nan, inf = [1.0, 0.0, 0.0], float("nan"), float("inf")
    rows = [(i, one) for i in range(200, 0, -1)] + [(500, [0.0, 1.0, 0.0]), (501, [0.0, 0.0, 0.0]), (502, None), (503, [1.0, None, 0.0]), (504, [nan, 0.0, 1.0]), (505, [inf, 0.0, 0.0]), (506, [1.0]), (None, one), (500, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cell", F.lit(1))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest_neighbours(df, df.where("vec_id % 100 = 0 or vec_id > 500")).collect())
    assert [g[2] for g in got if g[0] == 100] == list(range(1, 11)) and all(g[3] == 0 for g in got if g[0] in (100, 200))
    assert [(g[1], g[2]) for g in got if g[0] == 500] == [(i, i) for i in range(1, 11)]
    assert {g[0] for g in got} == {100, 200, 500}
    few = spark.createDataFrame([(0, one), (1, one), (2, [0.0, 2.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id) for r in ann.nearest_neighbours(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    none = few.where("vec_id < 0")
    assert ann.nearest_neighbours(none, none).count() == 0


def test_codes_pay_for_the_parallel_error():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    index = ann.fit_index(x.astype(np.float32), 1)
    long = ann.extended(x)
    books = index.books.astype(np.float64)
    error = {}
    for eta in (1.0, 8.0):
        codes = ann.assign_codes(long - ann.extended(index.cells.astype(np.float64)), ann._direction(long), books, eta)
        e = (long - ann.extended(index.cells.astype(np.float64))) - np.concatenate([books[s][codes[:, s]] for s in range(len(books))], 1)
        error[eta] = float(((e * ann._direction(long)).sum(1) ** 2).mean())
    assert error[8.0] < error[1.0] and u.shape == x.shape


def _recall(got, want):
    return sum(r.vec_id in {i for _, i in want[r.query_id]} for r in got) / sum(map(len, want.values()))


def test_a_tight_cluster_loses_no_neighbours(spark):
    """A third of all rows in one cluster of a twentieth of the usual spread, no two of them equal."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4500, 32)).astype(np.float32)
    x[::3] = (2 + 0.05 * rng.normal(size=(1500, 32))).astype(np.float32)
    vectors = [(i, v.astype(np.float64)) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors], "vec_id long, embedding array<float>")
    asked = {i for i in range(0, 4500, 75)} | {i for i in range(1, 4500, 150)}
    want = exact(vectors, [vectors[i] for i in sorted(asked)])
    hot = {i: w for i, w in want.items() if i % 3 == 0}
    queries = df.where(F.col("vec_id").isin(sorted(asked)))
    got = ann.nearest_neighbours(df, queries).collect()  # one cell: exact
    assert len(got) == 10 * len(want) and _recall(got, want) == 1
    got = ann.nearest_neighbours(df, queries, rows_per_cell=300).collect()
    assert _recall([r for r in got if r.query_id in hot], hot) >= 0.95


def test_further_cells_until_enough_are_found(spark):
    """Cells of few rows, and ids repeated with equal and with other vectors."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=3) + 40 * (i // 4)).tolist()) for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest_neighbours(df, df, rows_per_cell=8, probe=1).groupBy("query_id").count().collect()
    assert len(got) == 240 and {r["count"] for r in got} == {10}
    rows = [(1, [1.0, 1.0])] * 30 + [(2, [1.0, 1.0 + i / 1000]) for i in range(200)] + [(i, [1.0, 1.0]) for i in range(3, 9)] + [(i, [5.0, float(i)]) for i in range(9, 300)]
    few = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = ann.nearest_neighbours(few, few.where("vec_id = 3").limit(1)).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 4, 5, 6, 7, 8, 9, 10, 11]


def test_copies_are_cut_by_distinct_ids(spark):
    """Twelve rows of one id and ten further ids with the same vector, in one task and in four."""
    df = spark.createDataFrame([(1, [1.0, 2.0])] * 12 + [(i, [1.0, 2.0]) for i in range(2, 12)] + [(50 + i, [3.0, float(i)]) for i in range(9)], "vec_id long, embedding array<float>")
    for parts in (1, 4):
        got = ann.nearest_neighbours(df.repartition(parts), df.where("vec_id = 5").limit(1)).orderBy("rank").collect()
        assert [(r.vec_id, r.score) for r in got] == [(i, 0.0) for i in (1, 2, 3, 4, 6, 7, 8, 9, 10, 11)]


def test_doubles_stay_doubles(spark):
    rows = [(0, [1.0, 1.0]), (1, [1.0 + 1e-9, 1.0]), (2, [1.0 + 2e-9, 1.0]), (3, [1e60, 1.0]), (4, [1e200, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest_neighbours(df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3] and all(abs(r.score - np.sqrt(sum((x - 1) ** 2 for x in dict(rows)[r.vec_id]))) <= 1e-15 * r.score for r in got)


def test_all_cells_probed_is_exact_and_large_tables_keep_recall(spark):
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(50, 16))[rng.integers(50, size=50_000)] * 2 + rng.normal(size=(50_000, 16))).astype(np.float32)
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": [v.tolist() for v in x]}), "vec_id long, embedding array<float>").repartition(8)
    asked = np.arange(0, len(x), 500)
    want = {}
    for i in asked:
        d = np.sqrt(((x[i].astype(np.float64) - x.astype(np.float64)) ** 2).sum(1))
        d[i] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        want[int(i)] = [(float(d[j]), int(j)) for j in best]
    queries = df.where("vec_id % 500 = 0")
    assert _recall(ann.nearest_neighbours(df, queries).collect(), want) >= 0.9
    assert _recall(ann.nearest_neighbours(df, queries, rows_per_cell=500, probe=10**6).collect(), want) == 1
