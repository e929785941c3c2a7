"""Whole jobs on small random meshes: regions, vector fields, raw files, streaming."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom import SENTINEL
from fieldloom.operators import adjacency, critical, masks, neighbours, regions, regression, stats, traverse
from fieldloom.functions import entropy
from fieldloom.plans import blocks, transform
from fieldloom.plans import critical as cp
from fieldloom.plans.workflow import MeshWorkflow
from fieldloom.session import materialize, scratch_dir
from fieldloom.sources import artefacts, rawarray
from fieldloom.streaming.masks import stream_mask_changes, stream_mask_events


def ring(spark, n, chords=0, seed=0):
    rng = random.Random(seed)
    e = {(i, (i + 1) % n) for i in range(n)} | {tuple(rng.sample(range(n), 2)) for _ in range(chords)}
    return materialize(
        spark.createDataFrame(sorted({(a, b) for a, b in e} | {(b, a) for a, b in e}), "src bigint, dst bigint"), "ring"
    )


@pytest.mark.parametrize("eb", [0.5, 3.0, 100.0])
def test_level_sets_are_greedy(spark, eb):
    rng = random.Random(int(eb))
    vals = [np.float32(rng.choice([7.0, rng.uniform(0, 40)])) for _ in range(150)]
    f = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "vid bigint, val float")
    got = {r.vid: r.set_id for r in regions.level_sets(f, eb).collect()}
    start, number, expected = None, -1, {}
    for v in sorted({float(x) for x in vals}):
        if start is None or v > start + eb:
            start, number = v, number + 1
        expected[v] = number
    assert all(got[i] == expected[float(v)] for i, v in enumerate(vals))


def test_regions_round_trip_with_an_isolated_vertex(spark):
    n, eb = 80, 4.0
    vals = [float(np.float32(10 * np.sin(i / 9))) for i in range(n)] + [99.0]
    f = spark.createDataFrame(list(enumerate(vals)), "vid bigint, val float")
    e = ring(spark, n, 4)
    stored = regions.decompose(f, e, eb)
    summary = {r.rid: r for r in stored.regions.collect()}
    labels = {r.vid: r.rid for r in stored.labels.collect()}
    assert summary[labels[n]].nb == 0 and summary[labels[n]].ni == 1
    dec = regions.recompose(stored, f.select("vid"), e)
    rows = f.join(dec, "vid").collect()
    assert len(rows) == n + 1 and all(abs(r.val - r.dec) <= eb for r in rows)
    edges = [tuple(r) for r in e.collect()]
    cut = {a for a, b in edges if labels[a] != labels[b]}
    assert sum(r.nb for r in summary.values()) == len(cut)
    assert all(labels[a] == labels[b] for a, b in edges if a not in cut)


def test_block_jobs_on_a_collinear_mesh(spark):
    """Rank-deficient regression, constant steps, all-missing steps, uneven parts."""
    n, steps, batch = 50, 7, 3
    pos = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(n)], "vid bigint, pos array<double>")
    mesh = blocks.lay_out_mesh(pos, ring(spark, n, 60), 16, traverse.Order.PRIORITY_BREADTH)
    rows = [
        (v, i, [5.0, SENTINEL] + [float(np.float32(i * 0.3 + t)) for t in range(steps - 2)])
        for v in ("a", "b") for i in range(n)
    ]
    f = spark.createDataFrame(rows, "var string, vid bigint, vals array<float>")
    laid = materialize(blocks.lay_out_field(f, mesh, steps, batch), "laid")
    bounds = materialize(blocks.step_bounds(laid, 1e-3), "bounds")
    fits = regression.quantize_coefficients(regression.fit_parts(laid, mesh, 2), 2)
    side = regression.as_side_rows(fits, F.lit(1.0))
    for method, kw in (
        ("neighbours", {}), ("neighbours", {"joint": True}), ("masked", {}), ("adaptive", {}),
        ("fitted", {"fit": side}), ("kriged", {"min_neighbors": 3, "max_iter": 10}),
    ):
        blob = materialize(blocks.compress(laid, mesh, bounds, method, steps, batch, **kw), "blob")
        dec = blocks.decompress(blob, mesh, steps, batch)
        report = blocks.bound_report(blocks.paired(laid, dec, bounds, batch)).collect()
        assert len(report) == 2 * steps and all(r.n == n and r.inside == n for r in report), method


def test_coefficient_deltas_restore_the_grid(spark):
    rows = [(p, 0, "a", i, [0.37 * p + i, -1.5 * p]) for p in range(9) for i in range(2)]
    fits = spark.createDataFrame(rows, "part bigint, tb int, var string, i int, coefs array<double>")
    q = regression.quantize_coefficients(fits, 1)
    back = regression.coefficients_from_deltas(regression.coefficient_deltas(q), 1)
    for r in back.collect():
        assert r.restored == r.grid
        assert all(abs(k - c) <= 0.05 + 1e-12 for k, c in zip(r.kept, r.coefs))


def random_tets(n, m, seed):
    rng = random.Random(seed)
    return [(i, sorted(rng.sample(range(n), 4))) for i in range(m)]


@pytest.mark.parametrize("dense", [70, 25])
def test_critical_points_survive(spark, dense):
    n = 60
    rng = np.random.default_rng(7)
    uvw = rng.normal(size=(n, 3)).astype(np.float32)
    uvw[3, 1] = 0.0  # an exact zero in a component
    vectors = spark.createDataFrame([(i, *map(float, uvw[i])) for i in range(n)], "vid bigint, u float, v float, w float")
    pos = spark.createDataFrame([(i, rng.random(3).tolist()) for i in range(n)], "vid bigint, pos array<double>")
    tets = random_tets(n, dense, 1)
    cells = spark.createDataFrame(tets, "cid bigint, verts array<bigint>")
    dist = neighbours.with_distance(adjacency.from_cells(cells, 4), pos)
    blob = materialize(cp.compress(cells, vectors, dist, 0.1), "cp")
    rows = {r.vid: r for r in blob.collect()}
    assert len(rows) == n
    for _, vs in tets:  # cell-exclusive, and every colour follows an earlier one
        free = [rows[v].colour for v in vs if rows[v].colour >= 0]
        assert len(free) == len(set(free))
    assert {r.colour for r in rows.values()} == set(range(-1, max(r.colour for r in rows.values()) + 1))
    alone = set(range(n)) - {v for _, vs in tets for v in vs}
    assert all(rows[v].colour == 0 for v in alone)
    dec = materialize(cp.decompress(blob, dist), "dec")
    got = {r.vid: (r.u, r.v, r.w) for r in dec.collect()}
    assert len(got) == n
    changed = 0
    for i in range(n):
        for a, b in zip(uvw[i], got[i]):
            assert abs(float(a) - b) <= 0.1 * abs(float(a))
            assert a != 0 or b == 0
            changed += float(a) != b
        assert rows[i].level > 0 or got[i] == tuple(map(float, uvw[i]))
    assert changed > 0
    c = critical.counts(
        critical.compare(critical.extract(cells, vectors, pos), critical.extract(cells, dec, pos))
    ).head()
    assert c.tp == c.truth > 0 and c.fp == c.fn == c.ft == 0


def test_a_field_without_free_vertices_and_one_without_cells(spark):
    vectors = spark.createDataFrame([(i, *x) for i, x in enumerate([(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (-1.0, -1.0, -1.0)])], "vid bigint, u float, v float, w float")
    pos = spark.createDataFrame([(i, [float(i), i * i * 1.0, i % 2 * 1.0]) for i in range(4)], "vid bigint, pos array<double>")
    for tets, frozen in (([(0, [0, 1, 2, 3])], 4), ([], 0)):
        cells = spark.createDataFrame(tets, "cid bigint, verts array<bigint>")
        dist = neighbours.with_distance(adjacency.from_cells(cells, 4), pos)
        blob = materialize(cp.compress(cells, vectors, dist, 0.1), "cp")
        assert blob.where("colour = -1").count() == frozen
        got = {tuple(r) for r in cp.decompress(blob, dist).collect()}
        assert len(got) == 4 and (frozen == 0 or got == {tuple(r) for r in vectors.collect()})


def test_zero_place_and_kind_against_numpy(spark):
    rng = np.random.default_rng(11)
    n = 400
    uvw, xyz = rng.normal(size=(n, 3)), rng.normal(size=(n, 3))
    uvw = uvw.astype(np.float32).astype(float)
    vectors = spark.createDataFrame([(i, *uvw[i].tolist()) for i in range(n)], "vid bigint, u double, v double, w double")
    pos = spark.createDataFrame([(i, xyz[i].tolist()) for i in range(n)], "vid bigint, pos array<double>")
    tets = [(i, list(range(4 * i, 4 * i + 4))) for i in range(n // 4)]
    cells = spark.createDataFrame(tets, "cid bigint, verts array<bigint>")
    got = {r.cid: r for r in critical.extract(cells, vectors, pos).collect()}
    for cid, v in tets:
        mu = np.linalg.solve(np.vstack((uvw[v].T, np.ones(4))), [0, 0, 0, 1])
        assert (cid in got) == bool(((mu >= 0) & (mu < 1)).all())
        if cid in got:
            r = got[cid]
            assert np.allclose([r.x, r.y, r.z], mu @ xyz[v])
            jac = (uvw[v[:3]] - uvw[v[3]]).T @ np.linalg.inv((xyz[v[:3]] - xyz[v[3]]).T)
            roots = np.linalg.eigvals(jac)
            negative, spiral = int((roots.real < 0).sum()), bool((np.abs(roots.imag) > 1e-12).any())
            assert r.kind == 1 + 2 * negative + spiral


def test_margin_keeps_zeros_where_they_are(spark):
    rng = np.random.default_rng(13)
    uvw = rng.integers(-9, 10, size=(200, 3)).astype(float)
    vectors = spark.createDataFrame([(i, *uvw[i].tolist()) for i in range(200)], "vid bigint, u double, v double, w double")
    cells = spark.createDataFrame([(i, list(range(4 * i, 4 * i + 4))) for i in range(50)], "cid bigint, verts array<bigint>")

    def zero_inside(p):
        m = np.vstack((p.T, np.ones(4)))
        if abs(np.linalg.det(m)) < 1e-9:
            return None
        mu = np.linalg.solve(m, [0, 0, 0, 1])
        return bool((mu > -1e-12).all())

    for r in critical.corner_margins(cells, vectors).collect():
        base = uvw[4 * r.cid : 4 * r.cid + 4]
        before = zero_inside(base)
        if before is None or r.margin == 0:
            continue
        for _ in range(8):
            moved = base.copy()
            moved[r.vid - 4 * r.cid] *= 1 + r.margin * 0.999 * rng.uniform(-1, 1, 3)
            assert zero_inside(moved) == before


def test_error_statistics(spark):
    rows = [(0, 1.0, 1.5), (1, 2.0, 1.5), (2, 9.0, 9.0), (3, SENTINEL, SENTINEL)]
    df = spark.createDataFrame(rows, "vid bigint, val float, dec float").withColumn("k", F.lit(0))
    r = stats.error_stats(df, ["k"], SENTINEL).head()
    assert (r.lo, r.hi, r.max_err, r.worst_vid, r.mse_all) == (1.0, 9.0, 0.5, 0, 0.125)
    assert abs(r.psnr - 20 * np.log10(8 / np.sqrt(0.125))) < 1e-9
    exact = stats.error_stats(df.withColumn("dec", F.col("val")), ["k"]).head()
    assert exact.psnr is None and exact.max_err == 0


def test_raw_files_are_plain_arrays(spark, tmp_path):
    n = 1000
    df = spark.createDataFrame([(i, [float(i), i / 2]) for i in range(n)], "idx bigint, vals array<double>")
    rawarray.write_raw(df, str(tmp_path / "a"), "float64")
    plain = b"".join(p.read_bytes() for p in sorted((tmp_path / "a").glob("seg-*")))
    assert np.array_equal(np.frombuffer(plain).reshape(n, 2), [[i, i / 2] for i in range(n)])
    (tmp_path / "one.dat").write_bytes(plain)
    for path in ("a", "one.dat"):
        back = rawarray.read_raw(spark, str(tmp_path / path), "float64", 2).orderBy("idx").collect()
        assert [tuple(r.vals) for r in back] == [(float(i), i / 2) for i in range(n)]
    with pytest.raises(Exception, match="no multiple"):
        rawarray.read_raw(spark, str(tmp_path / "one.dat"), "float64", 3).count()
    with pytest.raises(Exception, match="missing.dat"):
        rawarray.read_raw(spark, str(tmp_path / "missing.dat")).count()


def test_step_files_of_both_layouts(spark, tmp_path):
    f = spark.createDataFrame(
        [(v, i, [float(i), float(-i)]) for v in ("p", "q") for i in range(40)], "var string, vid bigint, vals array<float>"
    )
    rawarray.write_steps(f, str(tmp_path / "s"))
    np.arange(40, dtype="<f4").tofile(tmp_path / "s" / "r.dat.7")
    got = rawarray.read_steps(spark, str(tmp_path / "s"))
    assert sorted({(r["var"], r.t) for r in got.collect()}) == [("p", 0), ("p", 1), ("q", 0), ("q", 1), ("r", 7)]
    assert {r.vid: r.val for r in got.where("var='q' and t=1").collect()} == {i: float(-i) for i in range(40)}


def test_tables_are_reused(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert artefacts.reuse_or_build(spark, str(tmp_path / "cp"), build).count() == 3
    assert len(calls) == 1


def test_stream_of_steps_equals_the_batch_form(spark, tmp_path):
    rng = random.Random(5)
    n, steps, batch = 50, 9, 2
    rows = [("a", i, [SENTINEL if rng.random() < 0.3 else 1.0 for _ in range(steps)]) for i in range(n)]
    f = spark.createDataFrame(rows, "var string, vid bigint, vals array<float>")
    expected = sorted(map(tuple, masks.changes(f, batch).collect()))
    long = f.select("var", "vid", F.posexplode("vals").alias("t", "val"))
    src, ckpt, out = (str(tmp_path / d) for d in ("in", "ckpt", "out"))
    for low, high in ((0, 4), (5, 8)):  # two runs, the second resumes from the checkpoint
        for t in range(low, high + 1):
            long.where(F.col("t") == t).write.mode("append").parquet(src)
        stream = spark.readStream.schema("var string, vid bigint, t int, val float").parquet(src)
        q = (
            stream_mask_changes(stream, batch, bucket=16)
            .writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
            .trigger(availableNow=True).start()
        )
        q.awaitTermination()
    got = sorted((r["var"], r.vid, r.t) for r in spark.read.parquet(out).collect())
    assert got == expected


def test_late_repeated_and_split_steps_end_no_stream(spark, tmp_path):
    """Arrivals in any order, replayed in plain Python: a vertex takes a step only after its last one."""
    rng = random.Random(9)
    every = [(t, v, SENTINEL if rng.random() < 0.4 else 1.0) for t in (0, 2, 4, 6, 8) for v in range(40)]
    runs = [[], [], []]
    for row in every:
        runs[rng.choice([0, 0, 1, 2])].append(row)
    runs[2] += every[:5] + [(None, 3, 1.0), (4, None, 1.0), (3, 7, SENTINEL)]
    runs[1].append((6, 1000, None))
    src, ckpt, out = (str(tmp_path / d) for d in ("in", "ckpt", "out"))
    seen, mask, want = {}, {}, []
    for run in runs:
        rng.shuffle(run)
        rows = [("a", v, t, x) for t, v, x in run]
        spark.createDataFrame(rows, "var string, vid bigint, t int, val float").write.mode("append").parquet(src)
        stream = spark.readStream.schema("var string, vid bigint, t int, val float").parquet(src)
        q = (
            stream_mask_events(stream, 2, bucket=16).writeStream.format("parquet").partitionBy("late")
            .option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        )
        q.awaitTermination()
        for t, v, x in sorted((r for r in run if r[0] is not None and r[1] is not None and r[0] % 2 == 0), key=lambda r: r[0]):
            if seen.get(v, -1) >= t:
                want.append((v, t, True))
                continue
            if mask.get(v, False) != (x == SENTINEL):
                want.append((v, t, False))
            seen[v], mask[v] = t, x == SENTINEL
    got = sorted((r.vid, r.t, r.late) for r in spark.read.schema("vid bigint, t int, late boolean").parquet(out).collect())
    assert got == sorted(want) and sum(late for *_, late in got) > 20


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_depth_first_numbers_follow_the_forest(spark, shape):
    """A long path, a hub, several trees with lone vertices, and no vertex at all; by a plain walk."""
    from collections import deque

    from fieldloom.operators import forest

    rng = random.Random(12)
    n = 0 if shape == "none" else 14 if shape == "path" else 60
    pairs = {
        "path": [(i, i + 1) for i in range(n - 1)], "star": [(7, i) for i in range(n) if i != 7],
        "random": [tuple(rng.sample(range(60), 2)) for _ in range(45)], "none": [],
    }[shape]
    both = sorted({p for a, b in pairs for p in ((a, b), (b, a))})
    got = forest.depth_first_numbers(
        spark.createDataFrame([(i,) for i in range(n)], "vid bigint"), spark.createDataFrame(both, "src bigint, dst bigint")
    )
    parent, level = {}, {}
    for root in range(n):
        if root in level:
            continue
        parent[root], level[root], queue = None, 0, deque([root])
        while queue:
            v = queue.popleft()
            for w in sorted(b for a, b in both if a == v):
                if w not in level:
                    parent[w], level[w] = v, level[v] + 1
                    queue.append(w)
    pre, post = {}, {}

    def walk(v):
        pre[v] = len(pre)
        for w in range(n):
            if parent[w] == v:
                walk(w)
        post[v] = len(post)

    for v in range(n):
        if parent[v] is None:
            walk(v)
    want = [(v, parent[v], level[v], pre[v], post[v]) for v in range(n)]
    assert sorted((r.vid, r.parent, r.level, r.pre, r.post) for r in got.collect()) == want


def test_scratch_is_local_only_in_local_mode(spark):
    assert spark.sparkContext.master.startswith("local")
    assert scratch_dir(spark) == scratch_dir(spark)


def test_workflow_covers_every_method(spark):
    n, steps = 40, 4
    rng = np.random.default_rng(3)
    pos = spark.createDataFrame([(i, rng.random(3).tolist()) for i in range(n)], "vid bigint, pos array<double>")
    cells = spark.createDataFrame(random_tets(n, 60, 2), "cid bigint, verts array<bigint>")
    vals = rng.normal(size=(n, steps)).astype(np.float32)
    f = spark.createDataFrame([("a", i, vals[i].tolist()) for i in range(n)], "var string, vid bigint, vals array<float>")
    wf = MeshWorkflow.lay_out(pos, cells, "tets", steps, part_size=20, batch=2)
    laid = wf.place(f)
    b = wf.bounds(laid, 0.05, relative=False)
    for method in (1, 2, 3, 4, 5, 6, "interpolated", "transform"):
        blob = materialize(wf.compress(laid, b, method), "blob")
        s = wf.statistics(wf.pairs(laid, wf.decompress(blob, b), b)).collect()
        assert len(s) == steps and all(r.n == n and r.max_err <= 0.05 for r in s), method
    step = f.select("vid", F.col("vals")[0].alias("val"))
    back = step.join(wf.recompose(wf.decompose(step, 0.05)), "vid").collect()
    assert len(back) == n and all(abs(r.val - r.dec) <= 0.05 for r in back)
    with pytest.raises(ValueError):
        wf.compress(laid, b, 7)


@pytest.mark.parametrize("method", [2, 3, 4, "interpolated"])
def test_workflow_codes_the_whole_mesh_and_writes_step_files(spark, method):
    n, steps, rng = 30, 5, np.random.default_rng(8)
    pos = spark.createDataFrame([(i, rng.random(3).tolist()) for i in range(n)], "vid bigint, pos array<double>")
    cells = spark.createDataFrame(random_tets(n, 40, 3), "cid bigint, verts array<bigint>")
    vals = rng.normal(size=(2, n, steps)).astype(np.float32)
    vals[1, ::4, 2] = SENTINEL
    f = spark.createDataFrame([(v, i, vals[j, i].tolist()) for j, v in enumerate("ab") for i in range(n)], "var string, vid bigint, vals array<float>")
    wf = MeshWorkflow.lay_out(pos, cells, "tets", steps, part_size=20, batch=2)
    coded = wf.code(f, 0.05, method, relative=False)
    assert set(coded.blob.columns) <= {"vid", "tb", "place", "q", "raw"}
    back = materialize(wf.decode(coded), "decoded")
    got = {(r.var, r.vid): r.vals for r in back.collect()}
    assert len(got) == 2 * n
    assert all(np.abs(np.array(got[v, i]) - vals[j, i]).max() <= 0.05 for j, v in enumerate("ab") for i in range(n))
    folder = f"{scratch_dir(spark)}/decoded-{method}"
    rawarray.write_steps(back, folder)
    files = {(r.var, r.t, r.vid): r.val for r in rawarray.read_steps(spark, folder).collect()}
    assert len(files) == 2 * n * steps and all(files[v, t, i] == got[v, i][t] for v, t, i in files)
    if method == 2:
        with pytest.raises(ValueError):
            wf.code(f, 0.05, 5)
    if method == "interpolated":
        with pytest.raises(ValueError):
            wf.code(f.where("vid > 3"), 0.05, method)


def test_points_are_located_in_the_smallest_cell(spark):
    """All points against all cells in numpy: small and large cells, corners, faces, flat cells,
    nulls and repeated points; weights give the vectors of the corners back."""
    from fieldloom.operators import locate

    rng = np.random.default_rng(4)
    corners, points = {}, {}
    for cid in range(120):
        at = rng.random(3) * 90
        x = at + rng.random((4, 3)) * (90 if cid % 5 == 0 else 9 if cid % 2 else 1)
        corners[cid] = np.round(x)
    corners[7] = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [1, 1, 0.0]])
    for pid in range(150):
        home = corners[pid % 120]
        w = rng.dirichlet([1] * 4) if pid % 3 else np.eye(4)[pid % 4]
        points[pid] = home.T @ w if pid % 7 else rng.random(3) * 120
    names = [f"{a}{i}" for i in range(4) for a in "xyz"]
    rows = [(cid, *[float(v) for v in x.ravel()], *[float(v) for v in (x * 2 + 1).ravel()]) for cid, x in corners.items()]
    rows.append((-5, None, *rows[0][2:]))
    cells = spark.createDataFrame(rows, "cid bigint, " + ", ".join(f"{c} double" for c in names + [f"{a}{i}" for i in range(4) for a in "uvw"]))
    some = [(p, *[float(v) for v in x]) for p, x in points.items()] + [(900, None, 1.0, 1.0), (901, float("nan"), 1.0, 1.0)]
    probes = spark.createDataFrame(some + some[:1], "pid bigint, px double, py double, pz double")

    def volumes(x, p):
        a, b, c, d = x - p
        det = lambda *m: float(np.dot(m[0], np.cross(m[1], m[2])))
        return np.array([det(b, c, d), -det(a, c, d), det(a, b, d), -det(a, b, c)])

    sure, never = {}, set()
    for pid, p in points.items():
        share = {}
        for cid, x in corners.items():
            s = volumes(x, p)
            share[cid] = (s / s.sum()).min() if abs(s.sum()) > 1e-9 else -1.0
        sure[pid] = {c for c, m in share.items() if m > 1e-9}, {c for c, m in share.items() if m > -1e-9}
        if not sure[pid][1]:
            never.add(pid)
    found = locate.locate(probes, cells, finest=4)
    got = {r.pid: r.cid for r in found.collect()}
    assert never and not never & set(got), [(p, got[p], volumes(corners[got[p]], points[p])) for p in sorted(never & set(got))][:3]
    assert not {900, 901} & set(got)
    for pid, (inside, perhaps) in sure.items():
        if pid in got:
            assert got[pid] in perhaps and got[pid] <= min(inside, default=got[pid])
        else:
            assert not inside
    assert sum(bool(inside) for inside, _ in sure.values()) > 40  # the rounded small cells are flat
    assert {r.pid: r.cid for r in locate.locate(probes, cells).collect()} == got
    for r in locate.interpolate(probes.distinct(), found, cells).collect():
        assert np.allclose([r.u, r.v, r.w], points[r.pid] * 2 + 1, atol=1e-6)
    assert locate.locate(probes, cells.limit(0)).count() == 0 and locate.locate(probes.limit(0), cells).count() == 0


def test_points_meet_few_cells_once_a_run_has_located_them(spark, monkeypatch):
    """Cells as wide as the mesh: the pairs that meet stay far below points x cells, by both ways of meeting."""
    from fieldloom.operators import locate

    rng = np.random.default_rng(5)
    x = rng.random((3000, 4, 3))
    names = [f"{a}{i}" for i in range(4) for a in "xyz"]
    cells = spark.createDataFrame([(c, *[float(v) for v in x[c].ravel()]) for c in range(len(x))], "cid bigint, " + ", ".join(f"{n} double" for n in names))
    at = 0.1 + 0.8 * rng.random((60, 3))
    probes = spark.createDataFrame([(p, *[float(v) for v in at[p]]) for p in range(60)], "pid bigint, px double, py double, pz double")
    first = {}
    for p in range(60):
        a, b, c, d = (x[:, i] - at[p] for i in range(4))
        det = lambda m, n, o: np.einsum("ij,ij->i", m, np.cross(n, o))
        s = np.stack([det(b, c, d), -det(a, c, d), det(a, b, d), -det(a, b, c)])
        inside = ((s > 0).all(0) | (s < 0).all(0)).nonzero()[0]
        if len(inside):
            first[p] = int(inside[0])
    met, hits = [], locate._hits
    monkeypatch.setattr(locate, "FIRST_RUN", 64)
    monkeypatch.setattr(locate, "_hits", lambda points, run, *more: met.append(points.count() * run.count()) or hits(points, run, *more))
    assert {r.pid: r.cid for r in locate.locate(probes, cells).collect()} == first
    assert len(met) > 2 and sum(met) < 60 * 3000 / 2
    monkeypatch.setattr(locate, "BROADCAST_ROWS", 10)
    assert {r.pid: r.cid for r in locate.locate(probes, cells).collect()} == first


def test_masked_series_equal_the_masks_step_by_step(spark, monkeypatch):
    """Bits and arrays against one join a step: coincident and lone vertices, a popular one, samples that are all missing; small slices."""
    rng = random.Random(9)
    n, steps = 60, 37
    monkeypatch.setattr(masks, "SLICE", 7)
    vals = {v: [SENTINEL if t == 5 or rng.random() < 0.5 else float(rng.randrange(50)) for t in range(steps)] for v in range(n)}
    pairs = {(a, b) for a in range(n - 1) for b in rng.sample(range(n - 1), 6) if a != b} | {(n - 2, b) for b in range(n - 2)}
    dist = {p: float(rng.randrange(4)) for p in pairs}
    edges = spark.createDataFrame([(a, b, d) for (a, b), d in dist.items()], "src bigint, dst bigint, dist double")
    series = spark.createDataFrame(list(vals.items()), "vid bigint, vals array<float>")
    state = series.select("vid", F.posexplode("vals").alias("t", "val"))
    expected = {(r.t, r.vid): r.pred for r in masks.masked_open_loop(edges, state, 4, ["t"]).collect()}
    got = masks.masked_open_loop_series(edges, series, 4, steps).collect()
    assert len(got) == n
    for r in got:
        for t in range(steps):
            pred = SENTINEL if vals[r.vid][t] == SENTINEL else r.preds[t] if r.preds else 0.0
            assert abs(pred - expected[t, r.vid]) < 1e-9


def test_transform_moves_windows_and_agrees_with_its_columns(spark):
    """Blobs hold what the column expressions give, and decoding gives a row a slot, not a row a sample."""
    rng = np.random.default_rng(5)
    vals = {("a", p): rng.normal(size=(n, 3)).astype(np.float32) for p, n in ((0, 9), (1, 1), (2, 4))}
    vals["b", 0] = (rng.normal(size=(9, 3)) * [1e30, 1.0, 1.0]).astype(np.float32)
    vals["b", 0][2, 1], vals["b", 0][5, 2] = np.nan, np.inf
    rows = [(p, 0, v, s, 100 * p + s, [float(x) for x in x[s]]) for (v, p), x in vals.items() for s in range(len(x))]
    laid = spark.createDataFrame(rows, "part bigint, tb int, var string, slot int, vid bigint, vals array<float>")
    b = spark.createDataFrame([("a", 0, [0.25, 0.0, None]), ("b", 0, [1e-9, 0.5, 0.5])], "var string, tb int, eb array<double>")
    blob = materialize(transform.compress(laid, b), "blob")
    expected = {}
    for r in transform.encode_blocks(laid, b).orderBy("i", "block").collect():
        expected.setdefault((r.var, r.part), []).append(r)
    found = blob.collect()
    assert len(found) == len(expected)
    for r in found:
        bits, raw, *coded = entropy.unpack(r.payload)
        want = expected[r.var, r.part]
        verbatim = [w.q0 is None for w in want]
        assert r.n * r.steps == len(want) and np.unpackbits(np.frombuffer(bits, np.uint8), count=len(want)).astype(bool).tolist() == verbatim
        for k in range(4):
            assert entropy.huffman_decode(coded[k]).tolist() == [w[f"q{k}"] for w in want if w.q0 is not None]
        kept = np.array([[w[f"r{k}"] for w in want if w.q0 is None] for k in range(4)], np.float32)
        assert np.array_equal(np.frombuffer(raw, np.float32), kept.ravel(), equal_nan=True)
    decoded = transform.decompress(blob, b)
    assert decoded.count() == sum(4 * -(-len(x) // 4) for x in vals.values())
    for r in blocks.paired(laid, decoded, b, 3).collect():
        if r.eb is None or not np.isfinite(r.val):
            assert r.dec == r.val or (np.isnan(r.dec) and np.isnan(r.val))
        else:
            assert abs(r.dec - r.val) <= r.eb


def test_edges_bring_the_masks_and_carry_used_values_alone(spark):
    """Edges to smaller ids with the other end's bits, no edge looked up; of an edge's values, the used ones travel."""
    import pyarrow as pa

    from fieldloom.functions import packed
    from fieldloom.sources import tables

    sf = "/root/testdata/sf0.001"
    wide = tables.wide_field(spark, sf).select("vid", F.concat(*tables.VARIABLES).alias("vals"))
    known = masks.valid_bits(wide)
    alive = {r.vid: bytes(r.alive) for r in known.collect()}
    for r in wide.collect():
        assert alive[r.vid] == np.packbits(np.array(r.vals, np.float32) != SENTINEL).tobytes()
    want = {(r.dst, r.src, r.dist, alive[r.src]) for r in tables.order_distances(spark, sf).collect()}
    got = [(r.src, r.dst, r.dist, bytes(r.there)) for r in tables.order_earlier(spark, sf, known).collect()]
    assert set(got) == want and len(got) == len(want) and all(a > b for a, b, _, _ in got)
    vals = np.arange(30, dtype=np.float32).reshape(3, 10)
    used = np.zeros((3, 10), bool)
    used[0, 3], used[2, [1, 8, 9]] = True, True
    ids, dist = pa.array([1, 2, 3]), pa.array([1.0, 2.0, 3.0])
    batch = pa.RecordBatch.from_arrays([ids, ids, dist, packed.column(np.packbits(used, axis=1)), packed.column(vals)], names=["src", "dst", "dist", "used", "vals"])
    (out,) = masks.picked(10)(iter([batch]))
    assert [np.frombuffer(v, np.float32).tolist() for v in out.column("vals").to_pylist()] == [[3.0], [], [21.0, 28.0, 29.0]]


def test_points_in_no_cell_meet_few_of_the_wide_cells(monkeypatch):
    """The tree gives what all pairs give, corners and faces included; cells as wide as the mesh test few points that they miss."""
    from fieldloom.operators import locate

    rng = np.random.default_rng(7)
    spots = np.concatenate([rng.random((400, 3)), rng.integers(0, 5, (300, 3)) / 4, 1 - rng.random((2000, 3)) * 0.02])
    cells = np.concatenate([rng.random((300, 4, 3)) * 0.98, rng.integers(0, 5, (200, 4, 3)) / 4])
    volume = np.abs(np.linalg.det(cells[:, 1:] - cells[:, :1]))
    cells = cells[volume > 1e-9]
    cells[0, :, 2] = [0.0, 0.0, 0.0, 1.0]
    cells[0, :, :2] = [[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]  # wide: its box holds all points, it holds none near (1, 1, 1)
    cid, real, tested = rng.permutation(len(cells)) * 10, locate._volumes, []
    every = np.full(len(spots), np.iinfo(np.int64).max)
    for c in range(len(cells)):
        s = np.array(real(spots, np.broadcast_to(cells[c], (len(spots), 4, 3))))
        total = s[0] + s[1] + s[2] + s[3]
        boxed = ((spots >= cells[c].min(0)) & (spots <= cells[c].max(0))).all(axis=1)
        inside = ((s >= 0).all(0) & (total > 0) | (s <= 0).all(0) & (total < 0)) & boxed
        every[inside] = np.minimum(every[inside], cid[c])
    monkeypatch.setattr(locate, "_volumes", lambda p, c: tested.append(len(p)) or real(p, c))
    for pairs, leaf in ((1 << 14, 16), (50, 3)):
        monkeypatch.setattr(locate, "PAIRS", pairs)
        monkeypatch.setattr(locate, "LEAF", leaf)
        tree = locate.Tree(spots, locate.FINEST)
        best = np.full(len(spots), np.iinfo(np.int64).max)
        locate.smallest_holders(tree, cells, cid, best)
        assert (best == every[tree.order]).all() and (best < np.iinfo(np.int64).max).sum() > 300
    tested.clear()
    far = locate.Tree(spots[-2000:], locate.FINEST)
    locate.smallest_holders(far, np.repeat(cells[:1], 1000, axis=0), np.arange(1000), np.full(2000, 1 << 40))
    assert sum(tested) == 0


def test_sizes_open_indices_alone_and_stored_pairs_are_not_stored_again(spark, monkeypatch):
    """Bits need no samples: neither the encoder's nor the decoder's are read; components take pairs as they are."""
    from fieldloom.catalogue import fields
    from fieldloom.functions import packed
    from fieldloom.operators import components as cc
    from fieldloom.plans import sweeps

    names = fields.tables.VARIABLES
    monkeypatch.setattr(fields.tables, "steps", lambda *_: 3)
    arrays = spark.createDataFrame([(i, 0, [i] * 12, [0.5] * 12, [0.5] * 11 + [None]) for i in range(5)], "vid bigint, tb int, q array<int>, first array<float>, decs array<float>")
    both = packed.packed(arrays)
    assert {f.dataType.simpleString() for f in both.schema.fields[2:]} == {"binary"}
    assert sorted(map(tuple, sweeps.opened(both).collect())) == sorted(map(tuple, arrays.collect()))
    short = fields._indices(spark, "", both)
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, fields._long(spark, "", both).select("var", "t", "vid", "q").collect()))
    assert short.count() == 5 * 3 * len(names) and "decs" not in short._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[1].split("\n")[0]
    stored, kept = [], cc.materialize
    monkeypatch.setattr(cc, "materialize", lambda df, name: stored.append(name) or kept(df, name))
    pairs = kept(spark.createDataFrame([(0, 2), (2, 4), (1, 3)], "src bigint, dst bigint"), "pairs")
    ways = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    vertices = spark.range(6).withColumnRenamed("id", "vid")
    assert {r.vid: r.root for r in cc.components(vertices, ways, pairs).collect()} == {0: 0, 2: 0, 4: 0, 1: 1, 3: 1, 5: 5}
    assert "cc-edges" not in stored
