"""Block codecs: exact inverses, bounds, and a plain loop to compare scans with."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldloom import SENTINEL
from fieldloom.functions import blockscan, entropy, kriging
from fieldloom.functions.scalars import RADIUS


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-3, 40), max_size=3000), st.integers(0, 3))
def test_huffman_round_trip(values, wide):
    a = np.array(values, np.int64) * 10**wide
    assert np.array_equal(entropy.huffman_decode(entropy.huffman_encode(a)), a)


def test_huffman_is_within_one_bit_of_the_entropy():
    rng = np.random.default_rng(0)
    a = rng.geometric(0.2, 5000)
    _, f = np.unique(a, return_counts=True)
    lengths = entropy.code_lengths(f)
    h = -(f * np.log2(f / f.sum())).sum()
    assert abs((2.0 ** -lengths.astype(float)).sum() - 1) < 1e-12
    assert h <= (f * lengths).sum() < h + len(a)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=200), max_size=5))
def test_payload_sections(sections):
    assert entropy.unpack(entropy.pack(sections)) == sections


def local_mesh(n, seed=0, degree=8):
    rng = np.random.default_rng(seed)
    pos = rng.random((n, 2)) * [50, 100]
    slots, raw, starts = [], [], [0]
    for i in range(n):
        c = np.unique(rng.integers(0, i, min(i, degree))) if i else np.array([], int)
        d = np.sqrt(((pos[c] - pos[i]) ** 2).sum(1))
        by = np.argsort(d, kind="stable")
        slots += c[by].tolist()
        raw += (1 / d[by]).tolist()
        starts.append(len(slots))
    return blockscan.LocalMesh(np.array(starts), np.array(slots, int), np.array(raw), pos - pos.mean(0))


def field(n, steps, seed=1, holes=True):
    rng = np.random.default_rng(seed)
    x = (np.cumsum(rng.normal(size=(n, steps)), axis=0) + 20).astype(np.float32)
    if holes:
        x[rng.random((n, steps)) < 0.2] = SENTINEL
    return x


def fit_table(mesh, x):
    design = np.hstack((np.ones((mesh.n, 1)), mesh.pos))
    coefs = np.linalg.lstsq(design, x.astype(float), rcond=None)[0].T
    return np.hstack((np.arange(x.shape[1])[:, None] % 2, coefs))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 64, 200])
@pytest.mark.parametrize("method", sorted(blockscan.SCANS))
def test_round_trip_and_bound(method, n):
    mesh, x = local_mesh(n), field(n, 6)
    eb = np.array([0.5, 0.01, 3.0, 0.0, 0.2, 1e-9])
    table = fit_table(mesh, x) if method == "fitted" else None
    options = {"min_neighbors": 3, "max_iter": 15}
    writer = blockscan.Writer(x, eb)
    written = blockscan.SCANS[method](blockscan.Job(mesh, 4, options, table), writer)
    reader = blockscan.Reader(writer.payload(), x.shape, eb)
    read = blockscan.SCANS[method](blockscan.Job(mesh, 4, options, table), reader)
    assert np.array_equal(written, read)
    assert (np.abs(read.astype(float) - x) <= eb).all()


def test_scan_equals_a_vertex_by_vertex_loop():
    mesh, x, eb = local_mesh(120), field(120, 1, holes=False), 0.3
    writer = blockscan.Writer(x, np.array([eb]))
    blockscan.scan_neighbours(blockscan.Job(mesh, 4), writer)
    dec = np.zeros(120, np.float32)
    for i in range(120):
        near = slice(mesh.starts[i], min(mesh.starts[i] + 4, mesh.starts[i + 1]))
        w = mesh.raw[near] / mesh.raw[near].sum() if mesh.raw[near].size else np.zeros(0)
        pred = sum(a * float(dec[j]) for a, j in zip(w, mesh.slots[near]))
        diff = float(x[i, 0]) - pred
        h = int((abs(diff) / eb + 1) / 2) * (1 if diff > 0 else -1)
        value = np.float32(pred + 2 * h * eb)
        if abs(float(value) - float(x[i, 0])) < eb:
            assert writer.q[i, 0] == RADIUS + h
            dec[i] = value
        else:
            assert writer.q[i, 0] == 0
            dec[i] = x[i, 0]


def test_masked_scan_ignores_missing_neighbours():
    mesh, x = local_mesh(150), field(150, 3)
    x[:, 1:] = x[:, :1]
    writer = blockscan.Writer(x, np.full(3, 0.1))
    blockscan.scan_masked(blockscan.Job(mesh, 4), writer)
    gone = x[:, 0] == np.float32(SENTINEL)
    assert (writer.q[gone] == RADIUS).all()
    blind = blockscan.Writer(x, np.full(3, 0.1))
    blockscan.scan_neighbours(blockscan.Job(mesh, 4), blind)
    assert len(writer.payload()) < len(blind.payload())


@pytest.mark.parametrize("n", range(1, 80))
def test_interpolation_visits_every_slot_once_after_its_sources(n):
    seen = {0}
    for _, groups in blockscan.interpolation_plan(n):
        fresh = set()
        for at, rule in groups:
            for offset, _c in rule:
                assert set((at + offset).tolist()) <= seen
            assert not fresh & set(at.tolist())
            fresh |= set(at.tolist())
        assert not fresh & seen
        seen |= fresh
    assert seen == set(range(n))


def test_variogram_fit_recovers_its_parameters():
    rng = np.random.default_rng(4)
    lag = rng.uniform(0.5, 20, (50, 6))
    reach, sill = rng.uniform(3, 10, 50), rng.uniform(1, 9, 50)
    half = sill[:, None] * (1 - np.exp(-((lag / reach[:, None]) ** 2)))
    r, s = kriging.fit_variograms(lag, half, 200)
    cost = ((half - s[:, None] * (1 - np.exp(-((lag / r[:, None]) ** 2)))) ** 2).sum(1)
    assert np.median(cost) < 1e-6


def test_kriging_weights_sum_to_one_and_honour_a_coincident_point():
    rng = np.random.default_rng(5)
    pos = rng.random((30, 2)) * 10
    nbr = np.array([[1, 2, 3], [4, 5, 6]])
    near, pair = kriging.neighbour_distances(pos, np.array([0, 4]), nbr)
    lam, good = kriging.kriging_weights(near, pair, np.full(2, 4.0), np.full(2, 2.0))
    assert good.all() and np.allclose(lam.sum(1), 1)
    assert np.allclose(lam[1], [1, 0, 0], atol=1e-6)


def test_kriging_expressions_agree_with_the_stacked_systems(spark):
    """Two, three and four neighbours, none, coincident ones and equal values."""
    from pyspark.sql import functions as F

    from fieldloom.functions import kriged

    rng, rows = np.random.default_rng(1), []
    for i in range(80):
        m = {1: 2, 2: 0}.get(i % 20, 4 if i % 3 else 3)
        p, v = rng.normal(size=(5, 2)) * 20, rng.normal(size=4) * 30
        if i % 10 == 0:
            p[1] = p[2]
        if i % 10 == 3:
            v[:] = 7.0
        sq = lambda a, b: float(((a - b) ** 2).sum())
        near = [sq(p[j], p[4]) if j < m else None for j in range(4)]
        pair = [sq(p[a], p[b]) if b < m else None for a in range(4) for b in range(a + 1, 4)]
        rows.append((i, near, pair, [float(x) if j < m else None for j, x in enumerate(v)]))
    df = spark.createDataFrame(rows, "i long, near array<double>, pair array<double>, v array<double>")
    half = kriged.half_squares([F.col("v")[j] for j in range(4)])
    fitted = df.withColumn("f", kriged.fit(F.col("pair"), half))
    got = {r.i: r for r in fitted.select("i", "f", kriged.weights(F.col("near"), F.col("pair"), F.col("f.reach")).alias("w")).collect()}
    usable = 0
    for i, near, pair, v in rows:
        m, g = sum(x is not None for x in near), got[i]
        if m < 3:
            assert g.f is None and g.w is None
            continue
        spots = [(a, b) for a in range(4) for b in range(a + 1, 4)]
        whole = np.zeros((4, 4))
        for (a, b), x in zip(spots, pair):
            whole[a, b] = whole[b, a] = np.sqrt(x or 0.0)
        at = np.triu_indices(m, 1)
        lag, h = whole[at][None], np.array([[(v[a] - v[b]) ** 2 / 2 for a, b in zip(*at)]])
        cost = lambda r, s: ((h - s * (1 - np.exp(-((lag / r) ** 2)))) ** 2).sum()  # noqa: E731, B023
        r, s = kriging.fit_variograms(lag, h, 200)
        assert cost(g.f.reach, g.f.sill) <= 3 * cost(r[0], s[0]) + 1e-6
        if i % 10 == 0:
            assert g.w is None
        if g.w is not None:
            lam, _ = kriging.kriging_weights(np.sqrt([near[:m]]), whole[None, :m, :m], np.array([g.f.reach]), np.array([g.f.sill]))
            assert np.allclose(g.w[:m], lam[0], atol=2e-6) and all(x == 0 for x in g.w[m:]) and abs(sum(g.w) - 1) < 1e-5
            usable += 1
    assert usable > 40


def test_sweeps_use_every_causal_edge_and_decode_from_the_blob(spark, monkeypatch):
    """A ring with chords over several windows: no edge between colours is lost, the bound
    holds, and the decoder needs nothing but indices, escapes, mesh and bounds."""
    import math

    from fieldloom.operators import neighbours
    from fieldloom.plans import sweeps

    n, steps, batch = 60, 7, 3
    pairs = {(i, (i + d) % n) for i in range(n) for d in (1, 2, 7)}
    edges = spark.createDataFrame([p for a, b in pairs for p in ((a, b), (b, a))], "src bigint, dst bigint").distinct()
    pos = spark.createDataFrame([(i, [math.cos(i), math.sin(2.0 * i)]) for i in range(n)], "vid bigint, pos array<double>")
    dist = neighbours.with_distance(edges, pos)
    colours = {r.vid: r.c for r in pos.select("vid", sweeps.colour().alias("c")).collect()}
    assert set(colours.values()) <= set(range(sweeps.COLOURS)) and len(set(colours.values())) > 4
    every = sweeps.causal_edges(dist, 100).collect()
    causal = {(r.src, r.dst) for r in dist.collect() if colours[r.dst] < colours[r.src]}
    assert {(r.vid, r.src) for r in every} == causal

    def value(v, i, t):
        return -99999.0 if v == "b" and (i + t) % 5 == 0 else math.sin(i / 9 + t) * 40

    field = spark.createDataFrame(
        [(v, i, [value(v, i, t) for t in range(steps)]) for v in "ab" for i in range(n)], "var string, vid bigint, vals array<float>"
    )
    rows = sweeps.rows_of(field, ("a", "b"), steps, batch)
    monkeypatch.setattr(sweeps, "COLOURS", 3)
    near = sweeps.causal_edges(dist, 4)
    for masked, relative, eb in ((False, True, 1e-2), (True, False, 0.5)):
        bounds = sweeps.bounds_of(rows, eb, relative)
        blob = sweeps.compress(rows, near, bounds, 4, masked)
        back = sweeps.decompress(blob, near, bounds, 4, masked)
        truth = {(r.var, r.t, r.vid): r.vals for r in sweeps.samples(rows, "vals", ("a", "b"), steps, batch).collect()}
        coded = {(r.var, r.t, r.vid): r.decs for r in sweeps.samples(blob, "decs", ("a", "b"), steps, batch).collect()}
        again = {(r.var, r.t, r.vid): r.decs for r in sweeps.samples(back, "decs", ("a", "b"), steps, batch).collect()}
        assert len(truth) == 2 * n * steps and coded == again
        limit = 0.5 if not relative else 0.8
        assert all(abs(coded[k] - truth[k]) <= limit for k in truth)
        if masked:
            assert all((coded[k] == -99999.0) == (truth[k] == -99999.0) for k in truth)


@pytest.mark.parametrize("n", [1, 2, 21])
def test_levels_interpolate_the_whole_order(spark, n):
    """Indices as a plain loop gives them, with an escape, several windows and a decoder that
    reads the blob and the bounds alone; one slot, and ends where points are missing."""
    from fieldloom.plans import levels

    steps, eb = 2, 0.25
    rng = np.random.default_rng(n)
    x = np.cumsum(rng.normal(size=(n, 2, steps)), axis=0).astype(np.float32)
    if n > 5:
        x[5, 0, 0] = 3e30
    rows = spark.createDataFrame(
        [(p, tb, 100 - p, [float(v) for v in x[p, tb]]) for p in range(n) for tb in range(2)], "place bigint, tb int, vid bigint, vals array<float>"
    )
    bounds = spark.createDataFrame([(tb, [eb] * steps) for tb in range(2)], "tb int, eb array<double>")
    blob = levels.compress(rows, n, bounds)
    got = {(r.place, r.tb): r for r in blob.collect()}
    assert len(got) == 2 * n and all(r.vid == 100 - r.place for r in got.values())
    dec = np.zeros((n, 2, steps), np.float32)
    plan = [(0, [0])] + [(s, list(range(s, n, 2 * s))) for s in (1 << k for k in range(10, -1, -1)) if s < n]
    for stride, at in plan:
        width = eb / 2 if stride > 2 else eb
        for p in at:
            for tb in range(2):
                for t in range(steps):
                    d = lambda o: float(dec[p + o * stride, tb, t])  # noqa: E731, B023
                    if stride == 0:
                        pred = 0.0
                    elif p - 3 * stride >= 0 and p + 3 * stride < n:
                        pred = -d(-3) / 16 + 9 * d(-1) / 16 + 9 * d(1) / 16 - d(3) / 16
                    else:
                        pred = d(-1) / 2 + d(1) / 2 if p + stride < n else d(-1)
                    q, value = got[p, tb].q[t], got[p, tb].decs[t]
                    if q == 0:
                        assert value == x[p, tb, t] == got[p, tb].raw[t]
                    else:
                        assert value == np.float32(pred + 2.0 * (q - RADIUS) * width) and abs(float(value) - float(x[p, tb, t])) < width
                    dec[p, tb, t] = value
    again = {(r.place, r.tb): r.decs for r in levels.decompress(blob, n, bounds).collect()}
    assert again == {k: r.decs for k, r in got.items()}
    assert n <= 5 or got[5, 0].q[0] == 0


@pytest.mark.parametrize("method", ["neighbours", "interpolated", "adaptive", "masked", "kriged", "fitted"])
def test_fields_of_a_block_are_written_as_if_alone(monkeypatch, method):
    """Payloads and facts equal those of a scan per field; the neighbours' fronts are found once a part."""
    rng = np.random.default_rng(8)
    n, owner = 300, np.sort(rng.integers(1, 300, 900))
    slots = np.array([rng.integers(0, o) for o in owner])

    def mesh():
        return blockscan.LocalMesh(np.searchsorted(owner, np.arange(n + 1)), slots, weights, spots)

    weights, spots = rng.random(len(owner)) + 0.1, rng.random((n, 2))
    xs = [(np.cumsum(rng.standard_normal((n, 5)), axis=0) * s).astype(np.float32) for s in (1, 30, 0.01, 5)]
    for x in xs:
        x[rng.random(n) < 0.2] = blockscan.SENTINEL
    ebs = [np.full(5, e) for e in (0.1, 1.0, 0.01, 2.0)]
    fits = [np.hstack([rng.integers(0, 2, (5, 1)), rng.random((5, 3))]).astype(float) for _ in xs] if method == "fitted" else []
    options = {"min_neighbors": 3.0, "max_iter": 20.0}
    alone = []
    for i, (x, eb) in enumerate(zip(xs, ebs)):
        writer = blockscan.Writer(x, eb)
        if fits:
            writer.note(lambda: fits[i])
        blockscan.SCANS[method](blockscan.Job(mesh(), 4, options, fits[i] if fits else None), writer)
        alone.append(writer)
    found, made = [], blockscan.fronts
    monkeypatch.setattr(blockscan, "fronts", lambda *a: found.append(1) or made(*a))
    both = blockscan.written(method, blockscan.Job(mesh(), 4, options), xs, ebs, fits)
    assert [w.payload() for w in both] == [w.payload() for w in alone] and [w.facts for w in both] == [w.facts for w in alone]
    assert len(found) <= (4 if method == "masked" else 1)


def test_rounds_of_few_levels_give_what_one_round_gives(spark, monkeypatch):
    """Blocks with halos: an order longer than a block is coded as if it were one, a slot that lacks a row included."""
    from fieldloom.plans import levels

    n, steps, eb = 150, 2, 0.25
    x = np.cumsum(np.random.default_rng(3).normal(size=(n, 2, steps)), axis=0).astype(np.float32)
    rows = spark.createDataFrame(
        [(p, tb, 7 * p, [float(v) for v in x[p, tb]]) for p in range(n) for tb in range(2) if p != 77], "place bigint, tb int, vid bigint, vals array<float>"
    )
    bounds = spark.createDataFrame([(tb, [eb] * steps) for tb in range(2)], "tb int, eb array<double>")
    whole = sorted(map(tuple, levels.compress(rows, n, bounds).collect()))
    assert len(whole) == 2 * n - 2
    for bits in (2, 3, 5):
        monkeypatch.setattr(levels, "TIER", bits)
        blob = levels.compress(rows, n, bounds, as_bytes=True)
        back = levels.decompress(blob.withColumnRenamed("decs", "first"), n, bounds)
        assert back.where("first <> decs").count() == 0 and back.count() == len(whole)
        assert sorted(map(tuple, levels.compress(rows, n, bounds).collect())) == whole


def test_kriging_of_rows_is_that_of_columns(spark):
    """Reach and weights of numpy equal those of the column expressions; absent, coincident and useless neighbours too."""
    from pyspark.sql import functions as F

    from fieldloom.functions import kriged, kriged_rows

    rng = np.random.default_rng(11)
    data = []
    for i in range(200):
        m, p = 4 - i % 3, rng.uniform(0, 9, (5, 2)).round(i % 4)
        near = [float(((p[j] - p[4]) ** 2).sum()) if j < m else None for j in range(4)]
        pair = [float(((p[a] - p[b]) ** 2).sum()) if b < m else None for a, b in kriged_rows.PAIRS]
        data.append((i, near, pair, [float(v) if j < m and (i % 7 or j != 1) else None for j, v in enumerate(rng.normal(0, 5, 4))]))
    df = spark.createDataFrame(data, "i int, near array<double>, pair array<double>, v array<double>")
    fitted = df.withColumn("f", kriged.fit(F.col("pair"), kriged.half_squares([F.col("v")[j] for j in range(4)])))
    want = {r.i: r for r in fitted.select("i", "f.reach", kriged.weights(F.col("near"), F.col("pair"), F.col("f.reach")).alias("w")).collect()}
    near, pair, v = (np.array([[np.nan if x is None else x for x in r[c]] for r in data]).T for c in (1, 2, 3))
    apart = np.array([v[a] - v[b] for a, b in kriged_rows.PAIRS])
    reach = kriged_rows.reach(pair, apart * apart / 2, ~np.isnan(pair) & ~np.isnan(apart))
    got = kriged_rows.weights(near, pair, ~np.isnan(near), ~np.isnan(pair), reach)
    assert sum(r.w is not None for r in want.values()) > 20 < sum(r.w is None for r in want.values())
    for i in range(len(data)):
        assert (want[i].reach is None and np.isnan(reach[i])) or abs(want[i].reach - reach[i]) < 1e-9
        assert (want[i].w is None and np.isnan(got[:, i]).all()) or np.abs(np.array(want[i].w) - got[:, i]).max() < 1.5e-6


def test_a_colour_is_one_job_whatever_predicts(spark, monkeypatch):
    """Nothing but the rows themselves is stored beside the results; a vertex without a row gets no prediction and sends none."""
    from fieldloom.plans import sweeps

    stored, kept = [], sweeps.materialize
    monkeypatch.setattr(sweeps, "materialize", lambda df, name, *by: stored.append(name) or kept(df, name, *by))
    n = 12
    rows = spark.createDataFrame([(i, 0, [float(i % 5), -99999.0, None]) for i in range(n) if i != 3] + [(3, 1, None)], "vid bigint, tb int, vals array<float>")
    pairs = spark.createDataFrame([(i, j, 1.0 + abs(i - j)) for i in range(n + 2) for j in range(n + 2) if i != j], "src bigint, dst bigint, dist double")
    edges = sweeps.causal_edges(pairs, 4)
    bounds = spark.createDataFrame([(t, [0.1, 0.1, 0.1]) for t in (0, 1)], "tb int, eb array<double>")
    blob = sweeps.compress(rows, edges, bounds, 4, True)
    got = {(r.vid, r.tb): r for r in blob.collect()}
    assert stored == ["causal", "sweep-own"] and len(got) == n and got[3, 1].decs is None and got[3, 1].q is None
    for (i, _), r in got.items():
        assert i == 3 or (abs(r.decs[0] - i % 5) < 0.1 and r.q[1:] == [-1, 0] and r.decs[1] == -99999.0 and r.decs[2] is None and r.raw[2] is None)
    assert {(r.vid, r.tb): r.decs for r in sweeps.decompress(blob, edges, bounds, 4, True).collect()} == {k: r.decs for k, r in got.items()}
