"""Blockwise compression and decompression of time-stepped fields.

A block is (part, time window). Parts hold at most ``part_size`` vertices and a
window at most ``batch`` steps, so a group of one task is bounded by
part_size x batch x variables, whatever the mesh or the number of steps. Edges
that cross parts are dropped when the mesh is laid out, so blocks are
independent and need no halo.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom import SENTINEL, schema
from fieldloom.functions.blockscan import SCANS, Job, LocalMesh, Reader, written
from fieldloom.functions.scalars import compression_ratio, valid
from fieldloom.operators import adjacency, neighbours, partition, traverse
from fieldloom.operators.stats import absolute_bound
from fieldloom.session import broadcast_if_small, materialize, spread

DECODED = "part bigint, tb int, var string, slot int, vid bigint, decs array<float>"
_BLOB_ARROW = pa.schema(
    [
        ("part", pa.int64()), ("tb", pa.int32()), ("var", pa.string()), ("method", pa.string()),
        ("n", pa.int32()), ("steps", pa.int32()), ("eb", pa.list_(pa.float64())),
        ("params", pa.map_(pa.string(), pa.float64())), ("payload", pa.binary()),
    ]
)


def lay_out_mesh(
    positions: DataFrame,
    edges: DataFrame,
    part_size: int,
    order: traverse.Order,
    parts: DataFrame | None = None,
) -> DataFrame:
    """(part, slot, vid, pos, nbr_slots, nbr_raw): the mesh ready for block jobs.

    Built once and reused by every field, step and method. Coordinates are
    centred per part; neighbours are the causal part-local ones, nearest first.
    ``parts`` (vid, part) overrides the space-filling curve, e.g. for id ranges; edges
    (part, src, dst) are those inside these parts already.
    """
    if parts is None:
        parts = partition.assign_parts(positions, part_size)
    parts = materialize(parts, "parts")
    local = adjacency.local_with_distance(edges, positions.join(parts, "vid"))
    rows = materialize(traverse.order_parts(parts, local, order), "ordered")
    lists = (
        rows.where("dst_slot < src_slot")
        .withColumn("raw", neighbours.raw_weight())
        .groupBy(F.col("src").alias("vid"))
        .agg(F.array_sort(F.collect_list(F.struct("dist", "dst", "dst_slot", "raw"))).alias("l"))
        .select(
            "vid",
            F.transform("l", lambda s: s["dst_slot"]).alias("nbr_slots"),
            F.transform("l", lambda s: s["raw"]).alias("nbr_raw"),
        )
    )
    verts = rows.where("dst is null").select("part", F.col("src_slot").alias("slot"), F.col("src").alias("vid"))
    placed = verts.join(positions, "vid")
    d = len(positions.select("pos").head()[0])
    centres = placed.groupBy("part").agg(F.array(*[F.avg(F.col("pos")[i]) for i in range(d)]).alias("mid"))
    laid = (
        placed.join(centres, "part")
        .join(lists, "vid", "left")
        .select(
            "part", "slot", "vid",
            F.zip_with("pos", "mid", lambda a, b: a - b).alias("pos"),
            F.coalesce("nbr_slots", F.array().cast("array<int>")).alias("nbr_slots"),
            F.coalesce("nbr_raw", F.array().cast("array<double>")).alias("nbr_raw"),
        )
    )
    return materialize(laid, "mesh")


def lay_out_field(field: DataFrame, mesh: DataFrame, steps: int, batch: int) -> DataFrame:
    """(part, tb, var, slot, vid, vals): the field in slot order, cut into time windows.

    The one join by vertex; afterwards a block job needs a single shuffle.
    """
    placed = field.join(mesh.select("vid", "part", "slot"), "vid")
    return windows(placed.select("part", "var", "slot", "vid", "vals"), steps, batch).select("part", "tb", "var", "slot", "vid", "vals")


def windows(field: DataFrame, steps: int, batch: int) -> DataFrame:
    """Rows with an array ``vals`` of all steps, cut into time windows ``tb`` of ``batch`` steps."""
    longest = field.agg(F.max(F.size("vals"))).first()[0]
    if longest is not None and longest > steps:
        raise ValueError(f"the field has {longest} steps, not {steps}")
    starts = F.sequence(F.lit(0), F.lit((steps - 1) // batch))
    part = F.slice("vals", F.col("tb") * batch + 1, F.lit(batch)).alias("vals")
    return field.withColumn("tb", F.explode(starts)).select(*[c for c in field.columns if c != "vals"], "tb", part)


def step_bounds(laid: DataFrame, eb: float, relative: bool = True, sentinel: float | None = SENTINEL) -> DataFrame:
    """(var, tb, eb): absolute bound of every step of a window, from its valid range."""
    long = laid.select("var", "tb", F.posexplode("vals").alias("i", "val"))
    seen = (F.col("val") if sentinel is None else valid(F.col("val"), sentinel)).cast("double")
    spans = long.groupBy("var", "tb", "i").agg((F.max(seen) - F.min(seen)).alias("span"))
    bound = absolute_bound(F.col("span"), eb, relative)
    return spans.groupBy("var", "tb").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("i", bound.alias("b")))), lambda s: s["b"]
        ).alias("eb")
    )


def _windows(mesh: DataFrame, steps: int, batch: int, k: int | None, places: bool = True) -> DataFrame:
    """Mesh rows for every time window, cut to the neighbours and columns needed."""
    pos = F.col("pos") if places else F.array(F.lit(0.0)).alias("pos")
    lists = [F.slice(c, 1, k).alias(c) if k else F.col(c) for c in ("nbr_slots", "nbr_raw")]
    tb = F.explode(F.sequence(F.lit(0), F.lit((steps - 1) // batch))).alias("tb")
    return mesh.select("part", tb, "slot", "vid", pos, *lists)


def _rows(column: pa.ChunkedArray, n: int, dtype) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1).astype(dtype, copy=False)


def _local_mesh(table: pa.Table) -> tuple[LocalMesh, np.ndarray]:
    table = table.sort_by("slot")
    lists = table.column("nbr_slots").combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    mesh = LocalMesh(
        starts,
        lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
        table.column("nbr_raw").combine_chunks().flatten().to_numpy(zero_copy_only=False),
        _rows(table.column("pos"), len(table), float),
    )
    return mesh, table.column("vid").to_numpy()


def compress(
    laid: DataFrame,
    mesh: DataFrame,
    bounds: DataFrame,
    method: str,
    steps: int,
    batch: int,
    k: int = 4,
    fit: DataFrame | None = None,
    joint: bool = False,
    **options: float,
) -> DataFrame:
    """Blob rows, one per (part, window, variable), or per (part, window) when joint.

    ``fit`` optionally gives (part, tb, var, aux) with a regression flag and
    coefficients per step. ``joint`` puts all variables of a block into one
    entropy-coded stream, the layout of a multi-variable snapshot.
    """
    left = (
        laid.join(broadcast_if_small(bounds), ["var", "tb"])
        .select("part", "tb", "var", "slot", "vals", F.when(F.col("slot") == 0, F.col("eb")).alias("aux"))
    )
    if fit is not None:
        left = left.unionByName(
            fit.select(
                "part", "tb", "var", F.lit(-1).alias("slot"),
                F.lit(None).cast("array<float>").alias("vals"), "aux",
            )
        )
    whole_lists = method == "masked"
    params = {"k": float(k), **{name: float(v) for name, v in options.items()}}

    def run(key, fields: pa.Table, mesh_rows: pa.Table) -> pa.Table:
        local, _ = _local_mesh(mesh_rows)
        names = sorted(set(fields.column("var").to_pylist()))
        xs, ebs, fits = [], [], []
        for name in names:
            mine = fields.filter(pa.compute.equal(fields.column("var"), name)).sort_by("slot")
            extra = mine.filter(pa.compute.less(mine.column("slot"), 0))
            if len(extra):
                fits.append(np.asarray(extra.column("aux")[0].as_py(), float))
                mine = mine.slice(1)
            ebs.append(np.asarray(mine.column("aux")[0].as_py(), float))
            xs.append(_rows(mine.column("vals"), local.n, np.float32))
        if joint:
            names, xs, ebs = [",".join(names)], [np.hstack(xs)], [np.concatenate(ebs)]
            fits = [np.concatenate(fits)] if fits else []
        tables = [aux.reshape(x.shape[1], -1) for aux, x in zip(fits, xs)]
        out = [
            {
                "part": key[0].as_py(), "tb": key[1].as_py(), "var": name, "method": method,
                "n": writer.shape[0], "steps": writer.shape[1], "eb": writer.eb.tolist(),
                "params": [*params.items(), ("fitted", float(bool(tables))), *writer.facts.items()],
                "payload": writer.payload(),
            }
            for name, writer in zip(names, written(method, Job(local, k, params), xs, ebs, tables))
        ]
        return pa.Table.from_pylist(out, _BLOB_ARROW)

    right = _windows(mesh, steps, batch, None if whole_lists else k, method in ("kriged", "fitted"))
    left, right = spread(left, "part", "tb"), spread(right, "part", "tb")
    return (
        left.groupBy("part", "tb").cogroup(right.groupBy("part", "tb")).applyInArrow(run, schema.BLOB)
    )


def decompress(blob: DataFrame, mesh: DataFrame, steps: int, batch: int) -> DataFrame:
    """(part, tb, var, slot, vid, decs): everything needed comes from blob and mesh."""

    def run(key, blobs: pa.Table, mesh_rows: pa.Table) -> pa.Table:
        local, vids = _local_mesh(mesh_rows)
        pieces = []
        for b in blobs.to_pylist():
            params = dict(b["params"])
            reader = Reader(b["payload"], (b["n"], b["steps"]), np.asarray(b["eb"]))
            table = None
            if params["fitted"]:
                table = reader.note(lambda: None, float).reshape(b["steps"], -1)
            job = Job(local, int(params["k"]), params, table)
            dec = SCANS[b["method"]](job, reader)
            names = b["var"].split(",")
            for name, cols in zip(names, np.split(dec, len(names), axis=1)):
                size = cols.shape[1]
                offsets = np.arange(0, local.n * size + 1, size, dtype=np.int32)
                pieces.append(
                    pa.table(
                        {
                            "part": pa.array(np.full(local.n, b["part"])),
                            "tb": pa.array(np.full(local.n, b["tb"], np.int32)),
                            "var": pa.array([name] * local.n),
                            "slot": pa.array(np.arange(local.n, dtype=np.int32)),
                            "vid": pa.array(vids),
                            "decs": pa.ListArray.from_arrays(offsets, pa.array(cols.ravel())),
                        }
                    )
                )
        return pa.concat_tables(pieces)

    right = _windows(mesh, steps, batch, None)
    blob, right = spread(blob, "part", "tb"), spread(right, "part", "tb")
    return (
        blob.groupBy("part", "tb").cogroup(right.groupBy("part", "tb")).applyInArrow(run, DECODED)
    )


def paired(laid: DataFrame, decoded: DataFrame, bounds: DataFrame, batch: int) -> DataFrame:
    """Long rows (var, t, vid, val, dec, eb) of original and decoded samples."""
    both = (
        laid.join(decoded.drop("vid"), ["part", "tb", "var", "slot"])
        .join(broadcast_if_small(bounds), ["var", "tb"])
    )
    return both.select(
        "var", "tb", "vid", F.posexplode(F.arrays_zip("vals", "decs", "eb")).alias("i", "z")
    ).select(
        "var", (F.col("tb") * batch + F.col("i")).alias("t"), "vid",
        F.col("z.vals").alias("val"), F.col("z.decs").alias("dec"), F.col("z.eb").alias("eb"),
    )


def bound_report(pairs: DataFrame) -> DataFrame:
    """Per variable and step: rows, rows inside the bound, range of the valid samples."""
    err = F.abs(F.col("dec").cast("double") - F.col("val").cast("double"))
    seen = valid(F.col("val"), SENTINEL).cast("double")
    return pairs.groupBy("var", "t").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(err <= F.col("eb")).alias("inside"),
        F.round(F.min(seen), 4).alias("lo"),
        F.round(F.max(seen), 4).alias("hi"),
    )


def ratio(blob: DataFrame, keys: list[str]) -> DataFrame:
    """Stored bytes and compression ratio per key."""
    values = F.sum(F.col("n").cast("bigint") * F.col("steps"))
    stored = F.sum(F.length("payload"))
    return blob.groupBy(*keys).agg(
        values.alias("samples"), stored.alias("bytes"), compression_ratio(values, stored).alias("ratio")
    )


def shares(blob: DataFrame) -> DataFrame:
    """(method, share, value): how often a block took the alternative predictor."""
    sizes = F.col("n").cast("double") * F.col("steps")
    rows = blob.select("method", sizes.alias("size"), F.explode("params").alias("share", "value"))
    return (
        rows.where(F.col("share").endswith("_share"))
        .groupBy("method", "share")
        .agg((F.sum(F.col("value") * F.col("size")) / F.sum("size")).alias("value"))
    )
