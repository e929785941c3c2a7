"""One object per mesh: lay it out once, then compress, decompress and judge fields."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom import SENTINEL
from fieldloom.operators import adjacency, components, neighbours, regions, regression, stats
from fieldloom.operators.traverse import Order
from fieldloom.plans import blocks, levels, sweeps, transform
from fieldloom.session import materialize

# Method numbers of the command line.
METHOD_NUMBERS = {
    1: "regression", 2: "neighbours", 3: "kriging", 4: "masked",
    5: "adaptive-interpolation", 6: "adaptive-fit", 7: "regions",
}


@dataclass
class Coded:
    """A field coded over the whole mesh: ``blob`` and ``bounds`` are all that decoding reads of it."""

    blob: DataFrame
    bounds: DataFrame
    method: str
    variables: tuple[str, ...]
    k: int


@dataclass
class MeshWorkflow:
    """Reusable mesh layout. ``batch`` steps form one time window."""

    positions: DataFrame
    edges: DataFrame
    mesh: DataFrame
    d: int
    steps: int
    batch: int
    kept: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def lay_out(
        cls, positions: DataFrame, connectivity: DataFrame, kind: str, steps: int,
        wedges: DataFrame | None = None, part_size: int = 4096, order: Order = Order.PRIORITY_DEPTH, batch: int = 10,
    ) -> "MeshWorkflow":
        """``kind``: "triangles", "tets", "edges" or "padded" (1-based neighbour table)."""
        if kind == "edges":
            edges = adjacency.from_pairs(connectivity)
        elif kind == "padded":
            edges = adjacency.from_padded_table(connectivity)
        else:
            corners = {"triangles": 3, "tets": 4}[kind]
            edges = (
                adjacency.from_cells(connectivity, corners) if wedges is None
                else adjacency.from_cells_and_wedges(connectivity, corners, wedges)
            )
        edges = materialize(edges, "edges")
        mesh = blocks.lay_out_mesh(positions, edges, part_size, order)
        d = len(positions.select("pos").head()[0])
        return cls(positions, edges, mesh, d, steps, batch)

    def place(self, field: DataFrame) -> DataFrame:
        """Field (var, vid, vals) in slot order; do this once per field."""
        return materialize(blocks.lay_out_field(field, self.mesh, self.steps, self.batch), "laid")

    def bounds(self, laid: DataFrame, eb: float, relative: bool = True) -> DataFrame:
        return materialize(blocks.step_bounds(laid, eb, relative), "bounds")

    def compress(
        self, laid: DataFrame, bounds: DataFrame, method: str | int, k: int = 4, sampling: float = 0.1,
        min_neighbors: int = 3, max_iter: int = 20, joint: bool = False,
    ) -> DataFrame:
        """Blob table of one method, by name or number ("interpolated", "transform" too)."""
        name = METHOD_NUMBERS.get(method, method)
        args = dict(steps=self.steps, batch=self.batch, k=k)
        if name in ("regression", "adaptive-fit"):
            fits = regression.quantize_coefficients(regression.fit_parts(laid, self.mesh, self.d), self.d)
            if name == "regression":
                side = regression.as_side_rows(fits, F.lit(1.0))
            else:
                fits = materialize(fits, "fits")
                choice = regression.compare_predictors(laid, self.mesh, fits, k, sampling, self.d)
                side = regression.as_side_rows(choice, F.col("use_fit"))
            return blocks.compress(laid, self.mesh, bounds, "fitted", fit=side, **args)
        if name == "kriging":
            return blocks.compress(
                laid, self.mesh, bounds, "kriged", min_neighbors=min_neighbors, max_iter=max_iter, **args
            )
        if name == "transform":
            return transform.compress(laid, bounds)
        if name == "regions":
            raise ValueError("level-set regions work on one step: use decompose()")
        scan = {"neighbours": "neighbours", "masked": "masked", "interpolated": "interpolated"}
        return blocks.compress(
            laid, self.mesh, bounds, scan.get(name) or {"adaptive-interpolation": "adaptive"}[name], joint=joint, **args
        )

    def decompress(self, blob: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
        """(part, tb, var, slot, vid, decs); "transform" blobs give no vid."""
        if "method" not in blob.columns:
            return transform.decompress(blob, bounds)
        return blocks.decompress(blob, self.mesh, self.steps, self.batch)

    def pairs(self, laid: DataFrame, decoded: DataFrame, bounds: DataFrame) -> DataFrame:
        """(var, t, vid, val, dec, eb)."""
        return blocks.paired(laid, decoded, bounds, self.batch)

    def _once(self, name: str, build) -> DataFrame:
        if name not in self.kept:
            self.kept[name] = materialize(build(), name)
        return self.kept[name]

    def causal(self, k: int) -> DataFrame:
        """Edges along which a colour predicts from smaller ones, the k nearest of a vertex."""
        return self._once(f"causal-{k}", lambda: sweeps.causal_edges(neighbours.with_distance(self.edges, self.positions), k))

    def shape(self, k: int) -> DataFrame:
        """Distances among the neighbours that predict a vertex, for kriging."""
        return self._once(f"shape-{k}", lambda: sweeps.geometry(self.causal(k), self.positions))

    def seats(self) -> DataFrame:
        """(vid, place): breadth-first queue order of the whole mesh."""
        order = lambda: components.breadth_first_order(self.positions.select("vid"), self.edges)
        return self._once("seats", lambda: order().select("vid", F.col("rank").alias("place")))

    def code(self, values: DataFrame, eb: float, method: str | int = "neighbours", k: int = 4, relative: bool = True) -> Coded:
        """Code (var, vid, vals) over the whole mesh, no part cut: "neighbours" (2), "kriging" (3, k = 4),
        "masked" (4), "interpolated".

        Every vertex of the mesh has every variable; an empty field gives an empty blob.
        """
        name = METHOD_NUMBERS.get(method, method)
        variables = tuple(r[0] for r in values.select("var").distinct().orderBy("var").collect())
        rows = materialize(sweeps.rows_of(values, variables, self.steps, self.batch), "rows")
        bounds = sweeps.bounds_of(rows, eb, relative)
        if name in ("neighbours", "masked", "kriging"):
            shape = self.shape(k) if name == "kriging" else None
            blob = sweeps.compress(rows, self.causal(k), bounds, k, name == "masked", shape, len(variables))
        elif name == "interpolated":
            n = self.seats().count()
            seated = rows.join(self.seats(), "vid")
            if (found := seated.where("tb = 0").count()) not in (0, n):
                raise ValueError(f"the field has {found} of {n} vertices")
            blob = levels.compress(seated, n, bounds)
        else:
            raise ValueError(f"{name} is not coded over the whole mesh: use compress()")
        return Coded(blob.drop("decs"), bounds, name, variables, k)

    def decode(self, coded: Coded) -> DataFrame:
        """(var, vid, vals) in the field's own layout, as ``rawarray.write_steps`` takes it."""
        if coded.method == "interpolated":
            back = levels.decompress(coded.blob, self.seats().count(), coded.bounds)
        else:
            k, shape = coded.k, self.shape(coded.k) if coded.method == "kriging" else None
            back = sweeps.decompress(coded.blob, self.causal(k), coded.bounds, k, coded.method == "masked", shape, len(coded.variables))
        return sweeps.series(back, "decs", coded.variables, self.steps, self.batch)

    def statistics(self, pairs: DataFrame) -> DataFrame:
        return stats.error_stats(pairs, ["var", "t"], SENTINEL)

    def decompose(self, step: DataFrame, eb: float) -> regions.Decomposition:
        """Level-set regions of one step (vid, val)."""
        return regions.decompose(step, self.edges, eb)

    def recompose(self, stored: regions.Decomposition) -> DataFrame:
        return regions.recompose(stored, self.positions.select("vid"), self.edges)
