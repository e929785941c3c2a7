import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import ODD, documents

from fieldloom.llm import hamming, mixing

VECTORS = "vec_id long, embedding array<float>, label int, id string, vec string, score int"


def brute(vectors, k, query):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], float)
    out = {}
    for i in ids:
        if query(i):
            others = ids != i
            s = x[others] @ np.array(vectors[i], float)
            best = np.lexsort((ids[others], -s))[:k]
            out[int(i)] = list(zip(ids[others][best].tolist(), s[best].tolist()))
    return out


@pytest.mark.parametrize("unit", [True, False])
def test_recall_against_all_pairs(spark, monkeypatch, unit):
    monkeypatch.setattr(hamming, "BLOCK", 700)
    monkeypatch.setattr(hamming, "QUERY_BLOCK", 40)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 24)) + rng.standard_normal((10, 24))[rng.integers(0, 10, 2000)]
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x * rng.uniform(0.5, 2, (2000, 1))
    x = x.astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist(), 0, "z", "z", 1) for i, v in enumerate(x)], VECTORS)
    got = hamming.nearest(table, F.col("id") % 20 == 0, 20).collect()
    want = brute(dict(enumerate(x.astype(float))), 20, lambda i: i % 20 == 0)
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(found) == set(want) and all(sorted(f) == list(range(1, 21)) for f in found.values())
    hits = sum(len({v for v, _ in found[q].values()} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q, f in found.items():
        ordered = [f[r] for r in range(1, 21)]
        assert ordered == sorted(ordered, key=lambda p: (-p[1], p[0]))
        assert all(s == pytest.approx(float(x[q].astype(float) @ x[v].astype(float)), abs=1e-12) for v, s in ordered)


def test_index_retrieves_every_code_in_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 16, (3000, 8), dtype=np.uint16)
    codes[1000:2000] = codes[:1000] ^ (np.uint16(1) << rng.integers(0, 16, (1000, 8)).astype(np.uint16))
    index = hamming.Index(codes)
    for i in range(0, 3000, 300):
        d = np.array([sum(bin(int(v)).count("1") for v in row) for row in codes ^ codes[i]])
        for radius in (0, 5, 8, 20, 45, 60):
            assert index.within(codes[i], radius).tolist() == np.flatnonzero(d <= radius).tolist()


def test_odd_vectors_ties_and_few_rows(spark):
    one = [1.0, 0.0]
    rows = [
        (0, one), (1, one), (2, one), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, []),
        (8, [float("inf"), 0.0]), (None, one), (20, [-1.0, 0.5]), (2, one), (40, [0.0, 0.0]),
    ]
    table = spark.createDataFrame([(i, v, 0, "z", "z", 1) for i, v in rows], VECTORS)
    got = hamming.nearest(table, F.col("id") % 20 == 0, 20).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, -1.0), (20, 1, 0, -1.0), (20, 2, 1, -1.0), (20, 3, 2, -1.0)]
    empty = hamming.nearest(table.where("false"), F.col("id") % 20 == 0)
    assert empty.collect() == [] and empty.columns == got[0].__fields__
    assert hamming.nearest(table.where("vec_id = 0"), F.col("id") % 20 == 0).collect() == []
    assert hamming.nearest(table, F.col("id") == 77).collect() == []


def corpus(rng, n=300):
    kinds = {"clean": "river stone garden window", "low": "buy click sale offer", "toxic": "grob fnord zark vlek"}
    rows, labels = [], []
    for i in range(n):
        kind = rng.choices(list(kinds), [8, 2, 1])[0]
        rows.append((i, " ".join(rng.choices((kinds[kind] + " the of and").split(), k=rng.randint(20, 80)))))
        if i % 2:
            labels.append((i, int(kind == "clean"), int(kind == "toxic")))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_totals_meet_the_targets(spark):
    rng = random.Random(4)
    rows, labels = corpus(rng)
    docs = documents(spark, rows + [(900 + (i or 0), t) for i, t in ODD if i != 5])
    lab = spark.createDataFrame(labels + [(5000, 1, 0), (None, 1, 0), (1, None, None), (1, 1, 0)], LABELS)
    got = mixing.rates(docs, lab, {"clean": 0.6, "low": 0.3, "toxic": 0.1}).toPandas()
    assert len(got) == len(rows) + len(ODD) - 1
    p = got[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    assert np.allclose(p.sum(axis=1), 1) and (got.rate >= 0).all()
    total = (p * (got.n_tokens * got.rate).to_numpy()[:, None]).sum(axis=0) / got.n_tokens.sum()
    assert np.abs(total - [0.6, 0.3, 0.1]).max() < 2 * mixing.TOLERANCE
    assert ((got.copies == np.floor(got.rate)) | (got.copies == np.floor(got.rate) + 1)).all()
    assert got[got.doc_id.isin([901, 902, 903])].n_tokens.tolist() == [0, 0, 0]
    truth = {i: t for i, t in rows}
    named = got[got.doc_id < 300]
    right = [("fnord" in truth[i] or "zark" in truth[i]) == (q > 0.5) for i, q in zip(named.doc_id, named.p_toxic)]
    assert np.mean(right) > 0.95


def test_rates_solve_the_least_squares_problem(spark):
    """Against a direct projected gradient in numpy that runs very long."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet([2, 1, 0.5], 60)
    n = rng.integers(1, 90, 60)
    table = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    goal = np.array([0.55, 0.25, 0.2])
    history = mixing.solve(table, dict(zip(mixing.DOMAINS, goal)), steps=200)
    x, _ = mixing.fold_rates(p, history)
    share = (p * n[:, None]).sum(axis=0) / n.sum()
    y = np.ones(60)
    for _ in range(100_000):
        y = np.maximum(0, y - p @ (((p * (n * y)[:, None]).sum(axis=0) / n.sum() - goal) / share))
    assert np.abs((p * (n * x)[:, None]).sum(axis=0) / n.sum() - goal).max() < 2 * mixing.TOLERANCE
    assert np.abs((p * (n * y)[:, None]).sum(axis=0) / n.sum() - goal).max() < 1e-6
    assert np.abs(x - y).max() < 0.05


def test_resampling_repeats_rows_and_keeps_columns(spark):
    rows, labels = corpus(random.Random(4), 120)
    docs = documents(spark, [*rows, (None, "river stone"), (3, None)])
    lab = spark.createDataFrame(labels, LABELS)
    rates = {(r.doc_id, r.n_tokens): r.copies for r in mixing.rates(docs, lab).collect()}
    got = mixing.resample(docs, lab)
    assert got.columns == docs.columns
    count = {}
    for r in got.collect():
        key = (r.doc_id, len((r.text or "").split()))
        count[key] = count.get(key, 0) + 1
    assert count == {k: v for k, v in rates.items() if v}
    assert mixing.resample(documents(spark, []), lab).collect() == []
    flat = mixing.rates(docs, lab.where("false")).collect()
    assert {round(r.p_toxic, 9) for r in flat} == {round(1 / 3, 9)}


def test_a_rare_domain_meets_its_target_and_a_miss_is_reported(spark):
    rng = np.random.default_rng(6)
    kind = rng.choice(3, 200, p=[0.05, 0.75, 0.2])  # a twentieth is clean, which is to be most of it
    p = np.eye(3)[kind] * 0.97 + 0.01
    n = rng.integers(20, 90, 200)
    table = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    table = table.coalesce(1)
    goal = np.array([0.8, 0.17, 0.03])
    history, residual = mixing.solved(table, dict(zip(mixing.DOMAINS, goal)))
    x, _ = mixing.fold_rates(p, history)
    total = (p * (n * x)[:, None]).sum(axis=0) / n.sum()
    assert x.max() > 4 and np.abs(total - goal).max() < mixing.TOLERANCE
    assert residual == pytest.approx(total - goal, abs=1e-9)
    with pytest.warns(UserWarning, match="clean -"):
        history, residual = mixing.solved(table, dict(zip(mixing.DOMAINS, goal)), steps=8, most=4.0)
    assert residual[0] < -0.1 and mixing.fold_rates(p, history, 4.0)[0].max() == 4.0
