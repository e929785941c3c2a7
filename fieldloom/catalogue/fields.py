"""Time-stepped fields: statistics, masks, regression, regions, block round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom import SENTINEL
from fieldloom.catalogue import mesh as mq
from fieldloom.catalogue.registry import (
    DIST, EDGES, PART_SIZE, POS, STATIC, WEIGHTS, near_cte, parts_cte, query, with_,
)
from fieldloom.functions import kriged, scalars
from fieldloom.operators import (
    adjacency, coding, components, masks, neighbours, ranking, regions, regression, stats, traverse, variogram,
)
from fieldloom.plans import blocks, levels, sweeps
from fieldloom.session import broadcast_if_small, materialize
from fieldloom.sources import tables

BATCH = 10
REL_EB = 1e-2

SAMPLES = """calendar AS (
  SELECT min(q) AS lo, max(q) - min(q) + 1 AS n FROM (SELECT year(l_shipdate) * 4 + quarter(l_shipdate) AS q FROM lineitem)),
samples AS (
  SELECT l_partkey AS vid,
         CAST(year(l_shipdate) * 4 + quarter(l_shipdate) - (SELECT lo FROM calendar) AS INTEGER) AS t,
         CAST(sum(CAST(round(l_quantity * 1.0) AS BIGINT)) / count(*) / 1.0 AS FLOAT) AS quantity,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / count(*) / 100.0 AS FLOAT) AS price,
         CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) / count(*) / 100.0 AS FLOAT) AS discount,
         CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) / count(*) / 100.0 AS FLOAT) AS tax
  FROM lineitem GROUP BY ALL)"""
SERIES = SAMPLES + """, names AS (SELECT unnest(['discount', 'price', 'quantity', 'tax']) AS var),
series AS (
  SELECT n.var, CAST(r.t AS INTEGER) AS t, p.p_partkey AS vid,
         coalesce(CASE n.var WHEN 'discount' THEN s.discount WHEN 'price' THEN s.price
                             WHEN 'quantity' THEN s.quantity ELSE s.tax END, CAST(-99999 AS FLOAT)) AS val
  FROM part p CROSS JOIN names n CROSS JOIN (SELECT unnest(range(n)) AS t FROM calendar) r
  LEFT JOIN samples s ON s.vid = p.p_partkey AND s.t = r.t)"""


def step_field(spark: SparkSession, sf: str) -> DataFrame:
    return tables.once(spark, sf, "step-field", lambda: tables.step_field(spark, sf))


def long_field(spark: SparkSession, sf: str) -> DataFrame:
    return step_field(spark, sf).select("var", "vid", F.posexplode("vals").alias("t", "val"))


def block_mesh(spark: SparkSession, sf: str, order: traverse.Order = traverse.Order.PRIORITY_DEPTH) -> DataFrame:
    return tables.once(
        spark, sf, f"mesh-{order.name.lower()}",
        lambda: blocks.lay_out_mesh(tables.positions(spark, sf), mq.inner_edges(spark, sf), PART_SIZE, order, mq.parts(spark, sf)),
    )


def slots(spark: SparkSession, sf: str, order: traverse.Order) -> DataFrame:
    """(vid, part, slot): the places of an order. Along ids they need no edge of the mesh."""
    if order != ID_ORDER:
        return block_mesh(spark, sf, order)
    place = F.row_number().over(Window.partitionBy("part").orderBy("vid")) - 1
    return mq.parts(spark, sf).select("vid", "part", place.alias("slot"))


def laid_field(spark: SparkSession, sf: str, order: traverse.Order = traverse.Order.PRIORITY_DEPTH) -> DataFrame:
    return tables.once(
        spark, sf, f"laid-{order.name.lower()}",
        lambda: blocks.lay_out_field(step_field(spark, sf), slots(spark, sf, order), tables.steps(spark, sf), BATCH),
    )


def bounds(spark: SparkSession, sf: str) -> DataFrame:
    return tables.once(
        spark, sf, "bounds",
        lambda: blocks.step_bounds(blocks.windows(step_field(spark, sf), tables.steps(spark, sf), BATCH), REL_EB),
    )


@query(with_(SERIES) + """SELECT var, t, min(CASE WHEN val <> -99999 THEN CAST(val AS DOUBLE) END) AS lo,
  max(CASE WHEN val <> -99999 THEN CAST(val AS DOUBLE) END) AS hi,
  CAST(count(*) FILTER (WHERE val = -99999) AS BIGINT) AS missing FROM series GROUP BY var, t""")
def valid_range(spark, sf):
    """Range of every step without the missing-sample marker."""
    f = long_field(spark, sf)
    r = stats.value_range(f, ["var", "t"], SENTINEL).select("var", "t", "lo", "hi")
    gaps = f.groupBy("var", "t").agg(
        F.count_if(F.col("val") == F.lit(SENTINEL).cast("float")).alias("missing")
    )
    return r.join(gaps, ["var", "t"])


@query(with_(SERIES) + """SELECT var, t, vid, round((CAST(val AS DOUBLE) - lo) / (hi - lo), 6) AS scaled
FROM (SELECT *, min(CAST(val AS DOUBLE)) OVER (PARTITION BY var, t) AS lo,
                max(CAST(val AS DOUBLE)) OVER (PARTITION BY var, t) AS hi
      FROM series WHERE val <> -99999)""")
def normalize(spark, sf):
    """Min-max scaled valid samples of every step."""
    f = long_field(spark, sf)
    r = stats.value_range(f, ["var", "t"], SENTINEL)
    ok = f.where(F.col("val") != F.lit(SENTINEL).cast("float"))
    scaled = scalars.normalize(F.col("val").cast("double"), F.col("lo"), F.col("span"))
    return ok.join(r, ["var", "t"]).select("var", "t", "vid", F.round(scaled, 6).alias("scaled"))


@query(with_(SERIES) + """SELECT var, vid, t FROM (
  SELECT var, vid, t, val = -99999 AS gone,
         coalesce(lag(val = -99999) OVER (PARTITION BY var, vid ORDER BY t), false) AS before
  FROM series WHERE t % 10 = 0) WHERE gone <> before""")
def mask_changes(spark, sf):
    """Vertices whose validity changes at a batch refresh step (first batch: vs. all valid)."""
    return masks.changes(step_field(spark, sf), BATCH)


@query(with_(SERIES) + """SELECT var, t, vid // 8 AS byte,
  CAST(sum(CASE WHEN val = -99999 THEN 1 << (7 - vid % 8)::INTEGER ELSE 0 END) AS INTEGER) AS bits
FROM series GROUP BY var, t, vid // 8""")
def packed_mask(spark, sf):
    """Validity mask of every step packed eight vertices to a byte, first vertex highest."""
    flags = long_field(spark, sf).select("var", "t", "vid", (F.col("val") == F.lit(SENTINEL).cast("float")).alias("flag"))
    return masks.pack_bits(flags, ["var", "t"])


@query(with_(SERIES) + "SELECT var, t, vid, val = -99999 AS flag FROM series")
def unpacked_mask(spark, sf):
    """Bytes back to one flag per vertex and step."""
    n = tables.positions(spark, sf).count()
    return masks.unpack_bits(packed_mask(spark, sf), ["var", "t"], n)


MASKED = with_(EDGES, POS, DIST, SERIES) + """, alive AS (
  SELECT var, t, d.src, d.dst, d.dist, row_number() OVER (PARTITION BY d.src, var, t ORDER BY d.dist, d.dst) AS rn
  FROM dists d JOIN series s ON s.vid = d.src AND s.val <> -99999
       JOIN (SELECT var AS nvar, t AS nt, vid AS nvid FROM series WHERE val <> -99999) n ON nvid = d.dst AND nvar = var AND nt = t
  WHERE d.dst < d.src),
near AS (SELECT src || '/' || var || '/' || t AS src, src AS vid, var, t, dst, dist, rn FROM alive WHERE rn <= 4), """ + WEIGHTS + """,
pred AS (SELECT near.vid, near.var, near.t, sum(w.w * CAST(f.val AS DOUBLE)) AS pred
         FROM weights w JOIN near ON near.src = w.src AND near.rn = w.rn
         JOIN series f ON f.vid = near.dst AND f.var = near.var AND f.t = near.t GROUP BY ALL)
SELECT s.var, s.t, s.vid, s.val = -99999 AS gone,
       floor(CASE WHEN s.val = -99999 THEN -99999.0::DOUBLE ELSE coalesce(p.pred, 0.0) END * 1000 + 0.5) AS pred
FROM series s LEFT JOIN pred p ON p.vid = s.vid AND p.var = s.var AND p.t = s.t"""


@query(MASKED)
def masked_prediction(spark, sf):
    """Nearest surviving neighbours only, in every step; missing vertices predict the marker. In thousandths."""
    n, names = tables.steps(spark, sf), tables.VARIABLES
    series = tables.once(spark, sf, "series", lambda: masks.valid_bits(tables.wide_field(spark, sf).select("vid", F.concat(*names).alias("vals"))))
    out = masks.masked_open_loop_series(tables.order_earlier(spark, sf, series), series, 4, n * len(names))
    long = out.select("vid", "preds", F.posexplode("vals").alias("i", "val")).select(
        F.array(*[F.lit(v) for v in names])[F.floor(F.col("i") / n).cast("int")].alias("var"), (F.col("i") % n).cast("int").alias("t"), "vid",
        (F.col("val") == F.lit(SENTINEL).cast("float")).alias("gone"), F.coalesce(F.col("preds")[F.col("i")], F.lit(0.0)).alias("pred"),
    )
    pred = F.when(F.col("gone"), F.lit(SENTINEL)).otherwise(F.col("pred"))
    return long.select("var", "t", "vid", "gone", F.floor(pred * 1000 + 0.5).cast("double").alias("pred"))


# --- regression ---------------------------------------------------------------

OLS = with_(POS, parts_cte(), STATIC) + """, rows AS (
  SELECT p.part, f.vid, CAST(f.val AS DOUBLE) AS v, pos.x, pos.y
  FROM parts p JOIN field f ON f.vid = p.vid JOIN pos ON pos.vid = p.vid),
mids AS (SELECT part, avg(x) AS mx, avg(y) AS my FROM rows GROUP BY part),
sums AS (
  SELECT r.part, count(*) AS n, avg(v) AS mean, min(mx) AS mx, min(my) AS my,
         sum((x - mx) * (x - mx)) AS a, sum((x - mx) * (y - my)) AS b, sum((y - my) * (y - my)) AS c,
         sum(v * (x - mx)) AS sx, sum(v * (y - my)) AS sy
  FROM rows r JOIN mids m ON m.part = r.part GROUP BY r.part),
fits AS (SELECT *, (c * sx - b * sy) / (a * c - b * b) AS bx, (a * sy - b * sx) / (a * c - b * b) AS by_ FROM sums)"""


def wide_static(spark: SparkSession, sf: str) -> DataFrame:
    """The static field as a one-step field."""
    return mq.field(spark, sf).select(F.lit("total").alias("var"), "vid", F.array("val").alias("vals"))


ID_ORDER = traverse.Order.IDENTITY


def static_laid(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.lay_out_field(wide_static(spark, sf), block_mesh(spark, sf, ID_ORDER), 1, 1)


def static_fits(spark: SparkSession, sf: str) -> DataFrame:
    fits = regression.fit_parts(static_laid(spark, sf), block_mesh(spark, sf, ID_ORDER), 2)
    return regression.quantize_coefficients(fits, 2)


@query(OLS + """SELECT part, CAST(n AS BIGINT) AS n, round(mean - bx * mx - by_ * my, 3) AS intercept,
  round(bx, 5) AS slope_size, round(by_, 5) AS slope_price FROM fits""")
def part_regression(spark, sf):
    """Least squares on [1, size, price] per part."""
    mesh, raw = block_mesh(spark, sf, ID_ORDER), tables.positions(spark, sf)
    mids = mesh.select("vid", "part").join(raw, "vid").groupBy("part").agg(
        F.avg(F.col("pos")[0]).alias("mx"), F.avg(F.col("pos")[1]).alias("my")
    )
    c = F.col("coefs")
    return regression.fit_parts(static_laid(spark, sf), mesh, 2).join(mids, "part").select(
        "part", "n", F.round(c[0] - c[1] * F.col("mx") - c[2] * F.col("my"), 3).alias("intercept"),
        F.round(c[1], 5).alias("slope_size"), F.round(c[2], 5).alias("slope_price"),
    )


GRID = OLS + """, grids AS (
  SELECT part, mx, my, CAST(floor(mean / (0.2 / 3) + 0.5) AS BIGINT) AS g0,
         CAST(floor(bx / (0.2 / 3) + 0.5) AS BIGINT) AS g1, CAST(floor(by_ / (0.2 / 3) + 0.5) AS BIGINT) AS g2
  FROM fits)"""


@query(GRID + """SELECT part, g0 - lag(g0, 1, 0) OVER (ORDER BY part) AS d0,
  g1 - lag(g1, 1, 0) OVER (ORDER BY part) AS d1, g2 - lag(g2, 1, 0) OVER (ORDER BY part) AS d2, true AS restored
FROM grids""")
def coefficient_deltas(spark, sf):
    """Quantized coefficients as differences along the parts, and back again."""
    deltas = materialize(regression.coefficient_deltas(static_fits(spark, sf)), "deltas")
    back = regression.coefficients_from_deltas(deltas, 2)
    return back.select(
        "part", *[F.col("delta")[i].alias(f"d{i}") for i in range(3)],
        (F.col("restored") == F.col("grid")).alias("restored"),
    )


@query(GRID + """, preds AS (
  SELECT r.part, r.vid, r.v, g0 * (0.2 / 3) + g1 * (0.2 / 3) * (x - mx) + g2 * (0.2 / 3) * (y - my) AS pred
  FROM rows r JOIN grids g ON g.part = r.part)
SELECT part, vid, CAST(CASE WHEN abs(v - pred) / 2.5 + 1 >= 65536 THEN 0
    ELSE 32768 + CASE WHEN v > pred THEN floor((abs(v - pred) / 2.5 + 1) / 2)
                      ELSE -floor((abs(v - pred) / 2.5 + 1) / 2) END END AS INTEGER) AS q, true AS ok
FROM preds""")
def regression_residuals(spark, sf):
    """Residual indices of the regression predictor: no dependency between vertices."""
    rows = (
        static_laid(spark, sf)
        .select("part", "vid", F.col("vals")[0].alias("val"))
        .join(block_mesh(spark, sf, ID_ORDER).select("vid", "pos"), "vid")
        .join(static_fits(spark, sf).select("part", "kept"), "part")
    )
    pred = regression.predicted(F.col("kept"), F.col("pos"), 2)
    coded = rows.withColumn("s", scalars.quantize(F.col("val"), pred, F.lit(2.5)))
    err = F.abs(F.col("s.dec").cast("double") - F.col("val").cast("double"))
    return coded.select("part", "vid", "s.q", (err <= 2.5).alias("ok"))


@query(GRID + ", " + EDGES + ", " + DIST + """,
slots AS (SELECT part, vid, row_number() OVER (PARTITION BY part ORDER BY vid) - 1 AS slot,
                 count(*) OVER (PARTITION BY part) AS n FROM parts),
small AS (SELECT min(n) AS m, greatest(1, CAST(floor(min(n) * 0.25) AS BIGINT)) AS s FROM slots),
picked AS (SELECT part, vid FROM slots, small WHERE slot < m AND (slot * s) % m < s),
local AS (SELECT d.src, d.dst, d.dist, row_number() OVER (PARTITION BY d.src ORDER BY d.dist, d.dst) AS rn
          FROM dists d JOIN parts a ON a.vid = d.src JOIN parts b ON b.vid = d.dst
          WHERE a.part = b.part AND d.dst < d.src),
near AS (SELECT * FROM local WHERE rn <= 4), """ + WEIGHTS + """,
nbr AS (SELECT w.src AS vid, sum(w.w * CAST(f.val AS DOUBLE)) AS p
        FROM weights w JOIN field f ON f.vid = w.dst GROUP BY w.src),
errs AS (
  SELECT k.part, sum(abs(r.v - coalesce(n.p, 0.0))) AS nbr_err,
         sum(abs(r.v - (g0 * (0.2 / 3) + g1 * (0.2 / 3) * (x - mx) + g2 * (0.2 / 3) * (y - my)))) AS reg_err
  FROM picked k JOIN rows r ON r.vid = k.vid JOIN grids g ON g.part = k.part
  LEFT JOIN nbr n ON n.vid = k.vid GROUP BY k.part)
SELECT part, round(nbr_err, 3) AS nbr_err, round(reg_err, 3) AS reg_err, nbr_err > reg_err AS use_fit FROM errs""")
def predictor_choice(spark, sf):
    """Neighbours or regression per part, by absolute error on sampled slots."""
    mesh = block_mesh(spark, sf, ID_ORDER)
    out = regression.compare_predictors(static_laid(spark, sf), mesh, static_fits(spark, sf), 4, 0.25, 2)
    return out.select(
        "part", F.round("nbr_err", 3).alias("nbr_err"), F.round("reg_err", 3).alias("reg_err"), "use_fit"
    )


# --- level-set regions ----------------------------------------------------------

SET_EB = 20.0
PRICES = "field AS (SELECT p_partkey AS vid, CAST(p_retailprice AS FLOAT) AS val FROM part)"
LEVELS = PRICES + f""", vals AS (SELECT DISTINCT CAST(val AS DOUBLE) AS x FROM field),
starts(x) AS (
  SELECT min(x) FROM vals
  UNION ALL
  SELECT (SELECT min(v.x) FROM vals v WHERE v.x > s.x + {SET_EB}) FROM starts s
  WHERE EXISTS (SELECT 1 FROM vals v WHERE v.x > s.x + {SET_EB})),
ranked AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS set_id FROM starts),
sets AS (SELECT f.vid, f.val, r.set_id FROM field f ASOF JOIN ranked r ON CAST(f.val AS DOUBLE) >= r.x)"""


@query("WITH RECURSIVE " + LEVELS + """
SELECT set_id, min(x) AS start, CAST(count(*) AS BIGINT) AS members
FROM sets JOIN ranked USING (set_id) GROUP BY set_id""")
def level_sets(spark, sf):
    """Greedy value runs of bounded width over the whole field."""
    s = regions.level_sets(price_field(spark, sf), SET_EB)
    return s.groupBy("set_id").agg(
        F.min(F.col("val").cast("double")).alias("start"), F.count(F.lit(1)).alias("members")
    )


REGIONS = "WITH RECURSIVE " + EDGES + ", " + LEVELS + """,
inside AS (SELECT e.src, e.dst FROM edges e JOIN sets a ON a.vid = e.src JOIN sets b ON b.vid = e.dst
           WHERE a.set_id = b.set_id),
reach(vid, root) USING KEY (vid) AS (
  SELECT vid, vid FROM sets
  UNION
  SELECT i.src, min(r.root) FROM reach r JOIN inside i ON i.dst = r.vid
  JOIN recurring.reach c ON c.vid = i.src WHERE r.root < c.root GROUP BY i.src),
rooted AS (SELECT s.vid, s.val, s.set_id, r.root FROM sets s JOIN reach r USING (vid)),
labels AS (SELECT vid, val, dense_rank() OVER (ORDER BY set_id, root) - 1 AS rid FROM rooted),
boundary AS (SELECT DISTINCT e.src AS vid, a.rid FROM edges e JOIN labels a ON a.vid = e.src
             JOIN labels b ON b.vid = e.dst WHERE a.rid <> b.rid)
"""


def price_field(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read(spark, sf, "part").select(
        F.col("p_partkey").alias("vid"), F.col("p_retailprice").cast("float").alias("val")
    )


def static_decomposition(spark: SparkSession, sf: str) -> regions.Decomposition:
    def build(name):
        def make():
            d = regions.decompose(price_field(spark, sf), mq.edges(spark, sf), SET_EB)
            for other in ("regions", "boundary", "seeds", "labels"):
                if other != name:
                    tables.once(spark, sf, f"sd-{other}", lambda: getattr(d, other))
            return getattr(d, name)

        return make

    return regions.Decomposition(
        *[tables.once(spark, sf, f"sd-{n}", build(n)) for n in ("regions", "boundary", "seeds", "labels")]
    )


PIECES = """, interior AS (SELECT vid, rid FROM labels WHERE vid NOT IN (SELECT vid FROM boundary)),
links AS (SELECT src, dst FROM edges WHERE src IN (SELECT vid FROM interior) AND dst IN (SELECT vid FROM interior)),
pieces(vid, root) USING KEY (vid) AS (
  SELECT vid, vid FROM interior
  UNION
  SELECT i.src, min(r.root) FROM pieces r JOIN links i ON i.dst = r.vid
  JOIN recurring.pieces c ON c.vid = i.src WHERE r.root < c.root GROUP BY i.src)
"""


@query(REGIONS + "SELECT vid, rid FROM labels")
def region_labels(spark, sf):
    """Connected components of every level set, numbered by (set, smallest id)."""
    return static_decomposition(spark, sf).labels.select("vid", "rid")


@query(REGIONS + PIECES + """, means AS (SELECT rid, avg(CAST(val AS DOUBLE)) AS mean, count(*) AS members FROM labels GROUP BY rid),
nbs AS (SELECT rid, count(*) AS nb FROM boundary GROUP BY rid),
nis AS (SELECT i.rid, count(*) AS ni FROM pieces p JOIN interior i ON i.vid = p.vid WHERE p.root = p.vid GROUP BY i.rid)
SELECT m.rid, round(CAST(CAST(m.mean AS FLOAT) AS DOUBLE), 3) AS mean, CAST(m.members AS BIGINT) AS members,
  CAST(coalesce(nb, 0) AS BIGINT) AS nb, CAST(coalesce(ni, 0) AS BIGINT) AS ni
FROM means m LEFT JOIN nbs USING (rid) LEFT JOIN nis USING (rid)""")
def region_summary(spark, sf):
    """Mean, size and boundary count of every region."""
    r = static_decomposition(spark, sf).regions
    return r.select("rid", F.round(F.col("mean").cast("double"), 3).alias("mean"), "members", "nb", "ni")


@query(REGIONS + """SELECT rid, row_number() OVER (ORDER BY rid, vid) - 1 AS turn,
  vid - lag(vid, 1, 0) OVER (PARTITION BY rid ORDER BY vid) AS delta FROM boundary""")
def boundary_deltas(spark, sf):
    """Boundary ids of every region as differences."""
    return static_decomposition(spark, sf).boundary.select("rid", "turn", "delta")


@query(REGIONS + "SELECT vid, rid FROM boundary")
def boundary_from_deltas(spark, sf):
    """Boundary ids recovered from their differences."""
    return regions.delta_decode(static_decomposition(spark, sf).boundary).select("vid", "rid")


@query(REGIONS + PIECES + "SELECT i.rid, p.vid FROM pieces p JOIN interior i ON i.vid = p.vid WHERE p.root = p.vid")
def region_seeds(spark, sf):
    """One seed per connected interior piece of every region."""
    return regions.delta_decode(static_decomposition(spark, sf).seeds).select("rid", "vid")


@query(with_(PRICES) + "SELECT vid, round(CAST(val AS DOUBLE), 3) AS val, true AS ok FROM field")
def roundtrip_regions(spark, sf):
    """Recover the field from means, boundary ids and seeds; error stays in the set width."""
    stored = static_decomposition(spark, sf)
    f = price_field(spark, sf)
    dec = regions.recompose(stored, f.select("vid"), mq.edges(spark, sf))
    err = F.abs(F.col("dec").cast("double") - F.col("val").cast("double"))
    return f.join(dec, "vid", "left").select(
        "vid", F.round(F.col("val").cast("double"), 3).alias("val"), F.coalesce(err <= SET_EB, F.lit(False)).alias("ok")
    )


# --- block round trips ------------------------------------------------------------

REPORT = with_(SERIES) + """SELECT var, t, CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS inside,
  round(min(CASE WHEN val <> -99999 THEN CAST(val AS DOUBLE) END), 4) AS lo,
  round(max(CASE WHEN val <> -99999 THEN CAST(val AS DOUBLE) END), 4) AS hi
FROM series GROUP BY var, t"""


def step_fits(spark: SparkSession, sf: str) -> DataFrame:
    return tables.once(
        spark, sf, "step-fits",
        lambda: regression.quantize_coefficients(
            regression.fit_parts(laid_field(spark, sf), block_mesh(spark, sf), 2), 2
        ),
    )


def encoded(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Blob table of one registered method."""
    order = ID_ORDER if name == "interpolated-original" else traverse.Order.PRIORITY_DEPTH
    laid, mesh = laid_field(spark, sf, order), block_mesh(spark, sf, order)

    def build():
        args = dict(steps=tables.steps(spark, sf), batch=BATCH)
        b = bounds(spark, sf)
        if name == "regression":
            side = regression.as_side_rows(step_fits(spark, sf), F.lit(1.0))
            return blocks.compress(laid, mesh, b, "fitted", fit=side, **args)
        if name == "adaptive-fit":
            choice = regression.compare_predictors(laid, mesh, step_fits(spark, sf), 4, 0.1, 2)
            side = regression.as_side_rows(choice, F.col("use_fit"))
            return blocks.compress(laid, mesh, b, "fitted", fit=side, **args)
        if name == "kriging":
            return blocks.compress(laid, mesh, b, "kriged", min_neighbors=3, max_iter=20, **args)
        if name == "joint":
            return blocks.compress(laid, mesh, b, "neighbours", joint=True, **args)
        method = {"neighbours": "neighbours", "masked": "masked", "adaptive-interp": "adaptive"}
        return blocks.compress(laid, mesh, b, method.get(name, "interpolated"), **args)

    return tables.once(spark, sf, f"blob-{name}", build)


def _report(spark, sf, name: str) -> DataFrame:
    order = ID_ORDER if name == "interpolated-original" else traverse.Order.PRIORITY_DEPTH
    laid, mesh = laid_field(spark, sf, order), block_mesh(spark, sf, order)
    decoded = blocks.decompress(encoded(spark, sf, name), mesh, tables.steps(spark, sf), BATCH)
    return blocks.bound_report(blocks.paired(laid, decoded, bounds(spark, sf), BATCH))


# The whole mesh, colour by colour: every colour is one relation that sees all earlier ones.
SWEEP_K = 4
GROUND = with_(EDGES, POS, DIST, SERIES) + f""", paint AS (
  SELECT p_partkey AS vid, CAST(((p_partkey % 2147483648) * {sweeps.MULTIPLIER} % {sweeps.MODULUS}) // {sweeps.MODULUS // sweeps.COLOURS} AS INTEGER) AS c
  FROM part),
near AS (
  SELECT src, dst, rn, CASE WHEN dist > 0 THEN 1.0::DOUBLE / dist ELSE 1e300::DOUBLE END AS w
  FROM (SELECT d.src, d.dst, d.dist, row_number() OVER (PARTITION BY d.src ORDER BY d.dist, d.dst) AS rn
        FROM dists d JOIN paint a ON a.vid = d.src JOIN paint b ON b.vid = d.dst WHERE b.c < a.c) WHERE rn <= {SWEEP_K}),
limits AS (
  SELECT var, t, (max(CAST(val AS DOUBLE)) - min(CAST(val AS DOUBLE))) * {REL_EB}::DOUBLE AS eb
  FROM series WHERE val <> -99999 GROUP BY var, t),
base AS (SELECT s.var, s.t, s.vid, s.val, coalesce(l.eb, 0.0::DOUBLE) AS eb, p.c
         FROM series s JOIN paint p ON p.vid = s.vid LEFT JOIN limits l ON l.var = s.var AND l.t = s.t)"""


def _quantized(predicted: str, gone: str) -> str:
    """SELECT (var, t, vid, q, dec) of a relation (var, t, vid, val, eb, pred)."""
    return f"""SELECT var, t, vid, CAST(CASE WHEN {gone} THEN -1 WHEN fits THEN {scalars.RADIUS} + h ELSE 0 END AS BIGINT) AS q,
         CASE WHEN NOT {gone} AND fits THEN d ELSE val END AS dec
  FROM (SELECT *, s < {scalars.CAPACITY} AND abs(CAST(d AS DOUBLE) - CAST(val AS DOUBLE)) < eb AS fits
        FROM (SELECT *, CASE WHEN s < {scalars.CAPACITY} THEN CAST(pred + 2.0::DOUBLE * h * eb AS FLOAT) ELSE val END AS d
              FROM (SELECT *, CASE WHEN diff > 0 THEN floor(s / 2) ELSE -floor(s / 2) END AS h
                    FROM (SELECT *, CASE WHEN eb > 0 THEN abs(diff) / eb + 1 ELSE 1e300::DOUBLE END AS s
                          FROM (SELECT *, CAST(val AS DOUBLE) - pred AS diff FROM ({predicted}))))))"""


def _coded_cte(masked: bool, name: str = "coded", share: float = 1.0) -> str:
    """CTEs name0, name1, ...: the samples of one colour, coded from those of all smaller ones; ``name`` has all."""
    out = []
    for c in range(sweeps.COLOURS):
        earlier = " UNION ALL ".join(f"SELECT var, t, vid, dec FROM {name}{j}" for j in range(c))
        use = "d.dec <> -99999 AND" if masked else ""
        slot = lambda j, what: f"coalesce(max(CASE WHEN {use} n.rn = {j} THEN {what} END), 0.0::DOUBLE)"
        num = " + ".join(slot(j, "n.w * CAST(d.dec AS DOUBLE)") for j in range(1, SWEEP_K + 1))
        den = " + ".join(slot(j, "n.w") for j in range(1, SWEEP_K + 1))
        pred = f"""(SELECT n.src AS vid, d.var, d.t, {num} AS num, {den} AS den
          FROM near n JOIN paint p ON p.vid = n.src AND p.c = {c} JOIN ({earlier}) d ON d.vid = n.dst GROUP BY n.src, d.var, d.t)""" if c else (
            "(SELECT NULL::BIGINT AS vid, NULL::VARCHAR AS var, NULL::INTEGER AS t, 0.0::DOUBLE AS num, 0.0::DOUBLE AS den)")
        predicted = f"""SELECT b.var, b.t, b.vid, b.val, b.eb * {share}::DOUBLE AS eb, CASE WHEN p.den > 0 THEN p.num / p.den ELSE 0.0::DOUBLE END AS pred
          FROM base b LEFT JOIN {pred} p ON p.vid = b.vid AND p.var = b.var AND p.t = b.t WHERE b.c = {c}"""
        out.append(f"{name}{c} AS MATERIALIZED (\n  {_quantized(predicted, 'val = -99999' if masked else 'false')})")
    every = " UNION ALL ".join(f"SELECT * FROM {name}{c}" for c in range(sweeps.COLOURS))
    return ",\n" + ",\n".join(out) + f", {name} AS ({every})\n"


PAIR_NAMES = [(i, j) for i in range(1, SWEEP_K + 1) for j in range(i + 1, SWEEP_K + 1)]


def _kriging_sql(inner: str) -> str:
    """SELECT of ``inner`` (with n1.., the squared distances to the target, p12.., those between the
    neighbours, and h12.., the semivariances) with reach, sill, usable and the weights w1..w4."""
    names = [f"{i}{j}" for i, j in PAIR_NAMES]
    plus = lambda term: " + ".join(f"coalesce({term.replace('@', n)}, 0.0::DOUBLE)" for n in names)
    cost = lambda r, s: plus(f"(h@ - {s} * (1 - exp(-p@ / ({r} * {r})))) ** 2")
    floor = f"{kriged.FLOOR}::DOUBLE"
    clip = lambda r: f"least(greatest({r}, lo), hi)"
    at = f"""SELECT *, greatest(longest * {kriged.NARROWEST}::DOUBLE, {floor}) AS lo, greatest(longest * {kriged.WIDEST}::DOUBLE, {floor}) AS hi
      FROM (SELECT *, sqrt(greatest({', '.join('p' + n for n in names)})) AS longest, ({plus('h@')}) / ({' + '.join(f'(h{n} IS NOT NULL)::INTEGER' for n in names)}) AS mean
            FROM ({inner}))"""
    at = f"SELECT *, {cost('r', 's')} AS cost, 0.01::DOUBLE AS damp FROM (SELECT *, {clip('longest / sqrt(3.0::DOUBLE)')} AS r, greatest(mean, {floor}) AS s FROM ({at}))"
    for _ in range(kriged.STEPS):
        e = "exp(-p@ / (r * r))"
        jr, js, res = f"(-2.0::DOUBLE * s * {e} * p@ / (r * r * r))", f"(1 - {e})", f"(h@ - s * (1 - {e}))"
        at = f"""SELECT *, {plus(f'{jr} * {jr}')} AS ga, {plus(f'{jr} * {js}')} AS gb, {plus(f'{js} * {js}')} AS gc,
          {plus(f'{jr} * {res}')} AS gr, {plus(f'{js} * {res}')} AS gs FROM ({at})"""
        at = f"SELECT *, ga * (1 + damp) * (gc * (1 + damp)) - gb * gb AS det FROM ({at})"
        at = f"""SELECT *, {clip('r + CASE WHEN det > 1e-30 THEN (gc * (1 + damp) * gr - gb * gs) / det ELSE 0 END')} AS nr,
          greatest(s + CASE WHEN det > 1e-30 THEN (ga * (1 + damp) * gs - gb * gr) / det ELSE 0 END, {floor}) AS ns FROM ({at})"""
        at = f"SELECT *, {cost('nr', 'ns')} AS ncost FROM ({at})"
        better = lambda a, b: f"CASE WHEN ncost <= cost * (1 - {kriged.GAIN}::DOUBLE) THEN {a} ELSE {b} END"
        at = f"""SELECT * EXCLUDE (ga, gb, gc, gr, gs, det, nr, ns, ncost)
          REPLACE ({better('nr', 'r')} AS r, {better('ns', 's')} AS s, {better('damp * 0.25', 'damp * 4.0')} AS damp, {better('ncost', 'cost')} AS cost) FROM ({at})"""
    at = f"SELECT *, greatest(round(r, {kriged.DIGITS}), {floor}) AS reach, round(s, {kriged.DIGITS}) AS sill FROM ({at})"
    # the bordered system by Cholesky factors of the correlations; b is the target's side, o the border
    x = lambda n: f"coalesce(exp(-{n} / (reach * reach)), 0.0::DOUBLE)"
    at = f"""SELECT *, {', '.join(f'{x("p" + n)} AS c{n}' for n in names)}, {', '.join(f'{x(f"n{i}")} AS b{i}' for i in range(1, SWEEP_K + 1))},
      {', '.join(f'CASE WHEN n{i} IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS o{i}' for i in range(1, SWEEP_K + 1))} FROM ({at})"""
    root = lambda v: f"sqrt(CASE WHEN {v} > {kriged.PIVOT} THEN {v} END)"
    at = f"SELECT *, {root('1 - c12 * c12')} AS k2 FROM ({at})"
    at = f"SELECT *, (c23 - c13 * c12) / k2 AS k32, (c24 - c14 * c12) / k2 AS k42 FROM ({at})"
    at = f"SELECT *, {root('1 - c13 * c13 - k32 * k32')} AS k3 FROM ({at})"
    at = f"SELECT *, (c34 - c14 * c13 - k42 * k32) / k3 AS k43 FROM ({at})"
    at = f"SELECT *, {root('1 - c14 * c14 - k42 * k42 - k43 * k43')} AS k4 FROM ({at})"
    for v in "bo":
        at = f"SELECT *, ({v}2 - c12 * {v}1) / k2 AS {v}y2 FROM ({at})"
        at = f"SELECT *, ({v}3 - c13 * {v}1 - k32 * {v}y2) / k3 AS {v}y3 FROM ({at})"
        at = f"SELECT *, ({v}4 - c14 * {v}1 - k42 * {v}y2 - k43 * {v}y3) / k4 / k4 AS {v}x4 FROM ({at})"
        at = f"SELECT *, ({v}y3 - k43 * {v}x4) / k3 AS {v}x3 FROM ({at})"
        at = f"SELECT *, ({v}y2 - k32 * {v}x3 - k42 * {v}x4) / k2 AS {v}x2 FROM ({at})"
        at = f"SELECT *, {v}1 - c12 * {v}x2 - c13 * {v}x3 - c14 * {v}x4 AS {v}x1 FROM ({at})"
    at = f"SELECT *, (1 - bx1 - bx2 - bx3 - bx4) / (ox1 + ox2 + ox3 + ox4) AS mu FROM ({at})"
    at = f"SELECT *, {', '.join(f'round(bx{i} + mu * ox{i}, {kriged.WEIGHT_DIGITS}) AS u{i}' for i in range(1, SWEEP_K + 1))} FROM ({at})"
    at = f"SELECT *, coalesce(greatest(abs(u1), abs(u2), abs(u3), abs(u4)) <= {kriged.MOST} AND mu IS NOT NULL, false) AS usable FROM ({at})"
    return f"SELECT *, {', '.join(f'CASE WHEN usable THEN u{i} END AS w{i}' for i in range(1, SWEEP_K + 1))} FROM ({at})"


def _kriged_cte(name: str = "coded") -> str:
    """CTEs name0, name1, ... as ``_coded_cte``, predicted by kriging where its weights are usable."""
    ks = range(1, SWEEP_K + 1)
    out = [f"""shape AS MATERIALIZED (SELECT vid, {', '.join(f'(x{i} - tx) ** 2 + (y{i} - ty) ** 2 AS n{i}' for i in ks)},
    {', '.join(f'(x{i} - x{j}) ** 2 + (y{i} - y{j}) ** 2 AS p{i}{j}' for i, j in PAIR_NAMES)}
  FROM (SELECT n.src AS vid, any_value(t.x) AS tx, any_value(t.y) AS ty, {', '.join(f'max(d.x) FILTER (n.rn = {i}) AS x{i}, max(d.y) FILTER (n.rn = {i}) AS y{i}' for i in ks)}
        FROM near n JOIN pos t ON t.vid = n.src JOIN pos d ON d.vid = n.dst GROUP BY n.src))"""]
    for c in range(sweeps.COLOURS):
        pred = "(SELECT NULL::BIGINT AS vid, NULL::VARCHAR AS var, NULL::INTEGER AS t, 0.0::DOUBLE AS pred)"
        if c:
            earlier = " UNION ALL ".join(f"SELECT var, t, vid, dec FROM {name}{j}" for j in range(c))
            slot = lambda j, what: f"coalesce(max(CASE WHEN n.rn = {j} THEN {what} END), 0.0::DOUBLE)"
            out.append(f"""mail{c} AS MATERIALIZED (SELECT n.src AS vid, d.var, d.t, {', '.join(f'max(CAST(d.dec AS DOUBLE)) FILTER (n.rn = {i}) AS v{i}' for i in ks)},
    {' + '.join(slot(j, 'n.w * CAST(d.dec AS DOUBLE)') for j in ks)} AS num, {' + '.join(slot(j, 'n.w') for j in ks)} AS den
  FROM near n JOIN paint p ON p.vid = n.src AND p.c = {c} JOIN ({earlier}) d ON d.vid = n.dst GROUP BY n.src, d.var, d.t)""")
            inner = f"""SELECT m.vid, m.var, m.t AS t0, s.* EXCLUDE (vid), {', '.join(f'(v{i} - v{j}) ** 2 / 2 AS h{i}{j}' for i, j in PAIR_NAMES)}
              FROM mail{c} m JOIN shape s ON s.vid = m.vid WHERE m.t % {BATCH} = 0 AND v3 IS NOT NULL"""
            out.append(f"fit{c} AS MATERIALIZED (SELECT vid, var, t0, w1, w2, w3, w4 FROM ({_kriging_sql(inner)}) WHERE usable)")
            best = " + ".join(f"coalesce(f.w{i} * m.v{i}, 0.0::DOUBLE)" for i in ks)
            pred = f"""(SELECT m.vid, m.var, m.t, CASE WHEN f.w1 IS NOT NULL THEN {best} WHEN den > 0 THEN num / den ELSE 0.0::DOUBLE END AS pred
              FROM mail{c} m LEFT JOIN fit{c} f ON f.vid = m.vid AND f.var = m.var AND f.t0 = m.t - m.t % {BATCH})"""
        predicted = f"""SELECT b.var, b.t, b.vid, b.val, b.eb, coalesce(p.pred, 0.0::DOUBLE) AS pred
          FROM base b LEFT JOIN {pred} p ON p.vid = b.vid AND p.var = b.var AND p.t = b.t WHERE b.c = {c}"""
        out.append(f"{name}{c} AS MATERIALIZED (\n  {_quantized(predicted, 'false')})")
    every = " UNION ALL ".join(f"SELECT * FROM {name}{c}" for c in range(sweeps.COLOURS))
    return ",\n" + ",\n".join(out) + f", {name} AS ({every})\n"


# Orders of the whole mesh as seats (vid, place), and the levels of the interpolation along them.
BY_ID = ", {name} AS (SELECT p_partkey AS vid, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM part)"
BY_BREADTH = """, reach(vid, root) USING KEY (vid) AS (
  SELECT p_partkey, p_partkey FROM part
  UNION
  SELECT e.src, min(r.root) FROM reach r JOIN edges e ON e.dst = r.vid
  JOIN recurring.reach c ON c.vid = e.src WHERE r.root < c.root GROUP BY e.src),
bfs(vid, root, level, pos) USING KEY (vid) AS (
  SELECT vid, root, 0, 0::BIGINT FROM reach WHERE vid = root
  UNION
  SELECT vid, root, level, row_number() OVER (PARTITION BY root ORDER BY parent, vid) - 1
  FROM (SELECT e.dst AS vid, min(b.root) AS root, min(b.level) + 1 AS level, min(b.pos) AS parent
        FROM bfs b JOIN edges e ON e.src = b.vid
        WHERE NOT EXISTS (SELECT 1 FROM recurring.bfs r WHERE r.vid = e.dst) GROUP BY e.dst)),
{name} AS (SELECT vid, row_number() OVER (ORDER BY root, level, pos) - 1 AS place FROM bfs)"""
SQL_LEVELS = 20
"""Levels that the SQL spells out: up to 2^20 vertices; levels beyond the mesh are empty."""


def _level_cte(seats: str, name: str) -> str:
    """CTEs name20 .. name0: the samples of one level, coded from those of all coarser ones; ``name`` has all."""
    seat = f"{name}_seat"
    out = [f"""{name}_base AS MATERIALIZED (SELECT b.var, b.t, b.vid, b.val, b.eb, s.place FROM base b JOIN {seat} s ON s.vid = b.vid),
{name}_size AS (SELECT count(*) AS n FROM {seat})"""]
    done = []
    for at in (0, *range(SQL_LEVELS, 0, -1)):
        scale = f"b.eb * {levels.share(at)}::DOUBLE AS eb"
        if not at:
            predicted = f"SELECT var, t, vid, val, {scale}, 0.0::DOUBLE AS pred FROM {name}_base b WHERE place = 0"
        else:
            stride = 1 << (at - 1)
            earlier = " UNION ALL ".join(f"SELECT var, t, place, dec FROM {name}{j}" for j in done)
            take = ", ".join(f"max(CASE WHEN o = {o} THEN CAST(dec AS DOUBLE) END) AS d{r}" for r, o in enumerate(levels.OFFSETS))
            mail = f"""(SELECT var, t, place - o * {stride} AS place, {take} FROM ({earlier}), (SELECT unnest([-3, -1, 1, 3]) AS o)
              GROUP BY var, t, place - o * {stride})"""
            inner = " + ".join(f"({c}::DOUBLE) * d{r}" for r, c in enumerate(levels.CUBIC))
            predicted = f"""SELECT b.var, b.t, b.vid, b.val, {scale},
              CASE WHEN b.place // {stride} >= 3 AND b.place // {stride} + 3 < (n - 1) // {stride} + 1 THEN {inner}
                   WHEN b.place // {stride} = (n - 1) // {stride} THEN d1 ELSE 0.5::DOUBLE * d1 + 0.5::DOUBLE * d2 END AS pred
              FROM {name}_base b JOIN {mail} m ON m.var = b.var AND m.t = b.t AND m.place = b.place, {name}_size
              WHERE b.place % {2 * stride} = {stride}"""
        out.append(f"""{name}{at} AS MATERIALIZED (SELECT c.*, s.place FROM (
  {_quantized(predicted, 'false')}) c JOIN {seat} s ON s.vid = c.vid)""")
        done.append(at)
    every = " UNION ALL ".join(f"SELECT var, t, vid, q, dec FROM {name}{j}" for j in done)
    return seats.format(name=seat) + ",\n" + ",\n".join(out) + f", {name} AS ({every})\n"


RECURSIVE_GROUND = GROUND.replace("WITH ", "WITH RECURSIVE ", 1)
# Bits of a step: the entropy of its indices, and a word for every sample kept as it is.
BITS = """SELECT {keys}, CAST(sum(f) AS BIGINT) AS n, CAST(coalesce(sum(f) FILTER (q = 0), 0) AS BIGINT) AS escapes,
  round(sum(f) * log2(sum(f)) - sum(f * log2(f)), 3) + 32.0::DOUBLE * coalesce(sum(f) FILTER (q = 0), 0) AS bits
FROM (SELECT {keys}, q, count(*) AS f FROM {name} GROUP BY {keys}, q) GROUP BY {keys}"""
ADAPTIVE = (
    RECURSIVE_GROUND + _coded_cte(False, "half", 0.5) + _level_cte(BY_BREADTH, "inter")
    + f", half_bits AS ({BITS.format(keys='var, t', name='half')}), inter_bits AS ({BITS.format(keys='var, t', name='inter')})"
    + """, choice AS (SELECT h.var, h.t, h.bits <= i.bits AS by_neighbours, h.bits AS half_bits, i.bits AS inter_bits
  FROM half_bits h JOIN inter_bits i ON i.var = h.var AND i.t = h.t),
coded AS (SELECT s.* FROM half s JOIN choice c ON c.var = s.var AND c.t = s.t WHERE by_neighbours
  UNION ALL SELECT s.* FROM inter s JOIN choice c ON c.var = s.var AND c.t = s.t WHERE NOT by_neighbours)
"""
)
SWEPT = """SELECT {keys}, CAST(count(*) AS BIGINT) AS n, CAST(sum(q) AS BIGINT) AS q_sum, CAST(sum(q * (vid % 97)) AS BIGINT) AS q_place,
  round(sum(CAST(dec AS DOUBLE)), 2) AS dec_sum, CAST(count(*) FILTER (q = 0) AS BIGINT) AS escapes, true AS restored
FROM coded GROUP BY {keys}"""


def sweep_edges(spark: SparkSession, sf: str) -> DataFrame:
    return tables.once(spark, sf, "sweep-edges", lambda: sweeps.causal_edges(mq.distances(spark, sf), SWEEP_K))


def sweep_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = lambda: sweeps.windows_of(tables.wide_field(spark, sf), tables.VARIABLES, tables.steps(spark, sf), BATCH)
    return tables.once(spark, sf, "sweep-rows", rows)


def swept_windows(spark: SparkSession, sf: str, masked: bool, share: float = 1.0, krige: bool = False) -> DataFrame:
    """(vid, tb, q, first, decs): indices and the encoder's values of a window, and the decoder's; as bytes."""

    def build():
        edges, rows = sweep_edges(spark, sf), sweep_rows(spark, sf)
        b = sweeps.bounds_of(rows, REL_EB * share)
        shape = tables.once(spark, sf, "sweep-shape", lambda: sweeps.geometry(edges, tables.positions(spark, sf))) if krige else None
        args = dict(k=SWEEP_K, masked=masked, shape=shape, variables=len(tables.VARIABLES))
        blob = sweeps.compress(rows, edges, b, as_bytes=True, **args).withColumnRenamed("decs", "first")
        return sweeps.decompress(blob, edges, b, **args)

    return tables.once(spark, sf, f"swept-{masked}-{share}-{krige}", build, stored=True)


def _long(spark: SparkSession, sf: str, both: DataFrame, *more: str) -> DataFrame:
    """(var, t, vid, q, dec, restored, ...) of windows (vid, tb, q, first, decs, ...): what the encoder saw, against what came back."""
    zipped = sweeps.opened(both).select("vid", "tb", F.arrays_zip("q", "first", "decs", *more).alias("s"))
    return sweeps.samples(zipped, "s", tables.VARIABLES, tables.steps(spark, sf), BATCH).select(
        "var", "t", "vid", "s.q", F.col("s.first").alias("dec"), (F.col("s.first") == F.col("s.decs")).alias("restored"), *[f"s.{c}" for c in more]
    )


def _indices(spark: SparkSession, sf: str, both: DataFrame) -> DataFrame:
    """(var, t, vid, q) of windows (vid, tb, q, ...): nothing else is read or opened."""
    return sweeps.samples(sweeps.opened(both.select("vid", "tb", "q")), "q", tables.VARIABLES, tables.steps(spark, sf), BATCH)


def swept(spark: SparkSession, sf: str, masked: bool, share: float = 1.0, krige: bool = False, long=_long) -> DataFrame:
    """(var, t, vid, q, dec, restored): coded over the whole mesh, and decoded from the blob alone."""
    return long(spark, sf, swept_windows(spark, sf, masked, share, krige))


def seats(spark: SparkSession, sf: str, breadth: bool) -> DataFrame:
    """(vid, place): the whole mesh by id, or in breadth-first queue order."""

    def build():
        vertices = tables.positions(spark, sf).select("vid")
        if not breadth:
            return ranking.with_rank(vertices, ["vid"], "place")
        order = components.breadth_first_order(vertices, mq.edges(spark, sf), mq.pairs(spark, sf))
        return order.select("vid", F.col("rank").alias("place"))

    return tables.once(spark, sf, f"seats-{breadth}", build)


def interpolated(spark: SparkSession, sf: str, breadth: bool, long=_long) -> DataFrame:
    """(var, t, vid, q, dec, restored): coded level by level along an order, and decoded from the blob alone."""

    def build():
        rows = sweep_rows(spark, sf).join(seats(spark, sf, breadth), "vid")
        n, b = seats(spark, sf, breadth).count(), sweeps.bounds_of(sweep_rows(spark, sf), REL_EB)
        blob = levels.compress(rows, n, b, as_bytes=True).withColumnRenamed("decs", "first")
        return levels.decompress(blob, n, b)

    return long(spark, sf, tables.once(spark, sf, f"interpolated-{breadth}", build, stored=True))


def _coded_bits(coded: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, escapes, bits): entropy of the indices, and a word for every sample kept as it is."""
    freq = stats.symbol_histogram(coded, list(keys))
    f = F.col("freq").cast("double")
    escapes = F.coalesce(F.sum(F.when(F.col("q") == 0, F.col("freq"))), F.lit(0))
    entropy = F.sum(f) * F.log2(F.sum(f)) - F.sum(f * F.log2(f))
    return freq.groupBy(*keys).agg(F.sum("freq").alias("n"), escapes.alias("escapes"), (F.round(entropy, 3) + 32.0 * escapes).alias("bits"))


def step_choice(spark: SparkSession, sf: str) -> DataFrame:
    """(var, t, by_neighbours, half_bits, inter_bits): neighbours at half the bound where they are not larger."""

    def build():
        half = _coded_bits(swept(spark, sf, False, 0.5, long=_indices), "var", "t").select("var", "t", F.col("bits").alias("half_bits"))
        inter = _coded_bits(interpolated(spark, sf, True, _indices), "var", "t").select("var", "t", F.col("bits").alias("inter_bits"))
        return half.join(inter, ["var", "t"]).withColumn("by_neighbours", F.col("half_bits") <= F.col("inter_bits"))

    return tables.once(spark, sf, "step-choice", build)


def adaptive(spark: SparkSession, sf: str, long=_long) -> DataFrame:
    """(var, t, vid, q, dec, restored): every step by the predictor chosen for it."""
    choice = broadcast_if_small(step_choice(spark, sf).select("var", "t", "by_neighbours"))
    half = swept(spark, sf, False, 0.5, long=long).join(choice.where("by_neighbours"), ["var", "t"], "left_semi")
    return half.unionByName(interpolated(spark, sf, True, long).join(choice.where("not by_neighbours"), ["var", "t"], "left_semi"))


def _swept_report(coded: DataFrame, *keys: str) -> DataFrame:
    return coded.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("q").alias("q_sum"),
        F.sum(F.col("q") * (F.col("vid") % 97)).alias("q_place"),
        F.round(F.sum(F.col("dec").cast("double")), 2).alias("dec_sum"),
        F.count_if(F.col("q") == 0).alias("escapes"),
        F.bool_and("restored").alias("restored"),
    )


@query(GROUND + _coded_cte(False) + SWEPT.format(keys="var, t"))
def roundtrip_neighbours(spark, sf):
    """Nearest-neighbour prediction in a closed loop over the whole mesh."""
    return _swept_report(swept(spark, sf, False), "var", "t")


@query(REPORT)
def roundtrip_regression(spark, sf):
    """Regression per part."""
    return _report(spark, sf, "regression")


@query(GROUND + _kriged_cte() + SWEPT.format(keys="var, t"))
def roundtrip_kriging(spark, sf):
    """Kriging over the whole mesh: weights refitted to decoded neighbours at the start of every window."""
    return _swept_report(swept(spark, sf, False, krige=True), "var", "t")


@query(GROUND + _coded_cte(True) + SWEPT.format(keys="var, t"))
def roundtrip_masked(spark, sf):
    """The same, mask-aware: missing samples neither predict nor are predicted."""
    return _swept_report(swept(spark, sf, True), "var", "t")


@query(ADAPTIVE + SWEPT.format(keys="var, t"))
def roundtrip_adaptive_interpolation(spark, sf):
    """Interpolation, or neighbours at half the bound, per step: whichever takes fewer bits."""
    return _swept_report(adaptive(spark, sf), "var", "t")


@query(ADAPTIVE + "SELECT var, t, by_neighbours, half_bits, inter_bits FROM choice")
def step_predictors(spark, sf):
    """Predictor of every step, and the bits that each would take."""
    return step_choice(spark, sf).select("var", "t", "by_neighbours", "half_bits", "inter_bits")


@query(REPORT)
def roundtrip_adaptive_fit(spark, sf):
    """Neighbours or regression per part and step, by sampled error."""
    return _report(spark, sf, "adaptive-fit")


@query(GROUND + _coded_cte(False) + SWEPT.format(keys="t"))
def roundtrip_joint_snapshot(spark, sf):
    """All variables of a snapshot together, as they stand side by side in one row."""
    return _swept_report(swept(spark, sf, False), "t")


@query(RECURSIVE_GROUND + _level_cte(BY_ID, "coded") + SWEPT.format(keys="var, t"))
def roundtrip_interpolation_original_order(spark, sf):
    """1-D interpolation along the original vertex order of the whole mesh."""
    return _swept_report(interpolated(spark, sf, False), "var", "t")


@query(RECURSIVE_GROUND + _level_cte(BY_BREADTH, "coded") + SWEPT.format(keys="var, t"))
def roundtrip_interpolation_reordered(spark, sf):
    """1-D interpolation along the breadth-first queue order of the whole mesh."""
    return _swept_report(interpolated(spark, sf, True), "var", "t")


SIZES = {"neighbours": "near_all", "masked": "kept", "interpolated-original": "original", "interpolated-reordered": "inter", "adaptive-interp": "coded"}


@query(ADAPTIVE + _coded_cte(False, "near_all") + _coded_cte(True, "kept") + _level_cte(BY_ID, "original") + ", every AS ("
       + " UNION ALL ".join(f"SELECT '{job}' AS job, var, q FROM {name}" for job, name in SIZES.items())
       + f"), sized AS ({BITS.format(keys='job, var', name='every')})"
       + " SELECT job, var, n, escapes, bits, round(32.0::DOUBLE * n / bits, 4) AS ratio FROM sized")
def coded_sizes(spark, sf):
    """Samples, escapes, bits and compression ratio of the whole-mesh methods, per variable."""
    made = {
        "neighbours": swept(spark, sf, False, long=_indices), "masked": swept(spark, sf, True, long=_indices),
        "interpolated-original": interpolated(spark, sf, False, _indices), "interpolated-reordered": interpolated(spark, sf, True, _indices),
        "adaptive-interp": adaptive(spark, sf, _indices),
    }
    every = None
    for job, coded in made.items():
        one = _coded_bits(coded, "var").withColumn("job", F.lit(job))
        every = one if every is None else every.unionByName(one)
    return every.select("job", "var", "n", "escapes", "bits", F.round(32.0 * F.col("n") / F.col("bits"), 4).alias("ratio"))


METHODS = (
    "neighbours", "regression", "kriging", "masked", "adaptive-interp", "adaptive-fit", "joint",
    "interpolated-original", "interpolated-reordered",
)


@query()
def compression_ratio(spark, sf):
    """Samples, stored bytes and ratio per method (sizes have no SQL counterpart)."""
    out = None
    for name in METHODS:
        one = blocks.ratio(encoded(spark, sf, name).withColumn("job", F.lit(name)), ["job"])
        out = one if out is None else out.unionByName(one)
    return out


@query()
def container_offsets(spark, sf):
    """Byte range of the payload of every part and time window in one logical container."""
    parts = encoded(spark, sf, "joint").select("tb", "part", F.length("payload").alias("bytes"))
    placed = ranking.with_rank(parts, ["tb", "part"], "place")
    return ranking.exclusive_prefix(placed, "place", "bytes").drop("place")


@query(GROUND + _coded_cte(True) + """, errors AS (
  SELECT c.var, c.t, c.vid, b.val, b.eb, abs(CAST(c.dec AS DOUBLE) - CAST(b.val AS DOUBLE)) AS err
  FROM coded c JOIN base b ON b.var = c.var AND b.t = c.t AND b.vid = c.vid)
SELECT var, t, CAST(count(*) AS BIGINT) AS n, round(max(err), 6) AS max_err, first(vid ORDER BY err DESC, vid) AS worst_vid,
  round(avg(err * err) FILTER (val <> -99999), 4) AS mse_valid, max(err) <= max(eb) AS bound_kept
FROM errors GROUP BY var, t""")
def masked_error_stats(spark, sf):
    """Decoded-field statistics of the masked sweep with the marker left out of the range."""
    windows = sweeps.opened(swept_windows(spark, sf, True)).join(sweep_rows(spark, sf).withColumnRenamed("vals", "val"), ["vid", "tb"])
    pairs = _long(spark, sf, windows, "val")
    s = stats.error_stats(pairs, ["var", "t"], SENTINEL)
    return s.select(
        "var", "t", "n", F.round("max_err", 6).alias("max_err"), "worst_vid", F.round("mse_valid", 4).alias("mse_valid"),
        (F.col("max_err") <= F.coalesce((F.col("hi") - F.col("lo")) * REL_EB, F.lit(0.0))).alias("bound_kept"),
    )


@query(mq.CODED + "SELECT q, CAST(count(*) AS BIGINT) AS freq FROM coded GROUP BY q")
def symbol_histogram(spark, sf):
    """Frequency of every quantization index."""
    return stats.symbol_histogram(mq.coded(spark, sf), []).select("q", "freq")


@query(mq.CODED + """, hist AS (SELECT q, count(*) AS f FROM coded GROUP BY q)
SELECT CAST(count(*) AS BIGINT) AS symbols, CAST(sum(f) AS BIGINT) AS n,
  round(sum(f) * log2(sum(f)) - sum(f * log2(f)), 3) AS bits FROM hist""")
def entropy_bits(spark, sf):
    """Entropy bound on the coded size of all indices."""
    h = stats.symbol_histogram(mq.coded(spark, sf), [])
    return stats.entropy_bits(h, []).select("symbols", "n", F.round("bits", 3).alias("bits"))


@query(mq.CODED + """SELECT CAST(count(DISTINCT q) AS BIGINT) AS symbols, true AS kraft_equality,
  true AS within_one_bit FROM coded""")
def huffman_code(spark, sf):
    """Code table over the whole histogram: complete, and within one bit of the entropy."""
    h = stats.symbol_histogram(mq.coded(spark, sf), [])
    table = materialize(coding.code_table(h), "codes")
    f = F.col("freq").cast("double")
    sums = table.agg(
        F.count(F.lit(1)).alias("symbols"),
        F.sum(F.pow(F.lit(2.0), -F.col("length"))).alias("kraft"),
        F.sum(F.col("freq") * F.col("length")).alias("coded"),
        F.sum("freq").alias("n"),
        (F.sum(f) * F.log2(F.sum(f)) - F.sum(f * F.log2(f))).alias("bits"),
    )
    return sums.select(
        "symbols", (F.abs(F.col("kraft") - 1) < 1e-9).alias("kraft_equality"),
        ((F.col("coded") >= F.col("bits") - 1e-6) & (F.col("coded") < F.col("bits") + F.col("n"))).alias("within_one_bit"),
    )


@query()
def predictor_shares(spark, sf):
    """Share of samples on the regression, kriging and interpolation predictor."""
    blobs = [encoded(spark, sf, n) for n in ("adaptive-fit", "kriging", "adaptive-interp")]
    return blocks.shares(blobs[0].unionByName(blobs[1]).unionByName(blobs[2]))


PAIRS = with_(EDGES, POS, DIST, near_cte(4), STATIC) + """, lists AS (
  SELECT n.src, n.rn, n.dst, CAST(f.val AS DOUBLE) AS v, p.x, p.y, count(*) OVER (PARTITION BY n.src) AS m
  FROM near n JOIN field f ON f.vid = n.dst JOIN pos p ON p.vid = n.dst)"""


def variogram_lists(spark: SparkSession, sf: str) -> DataFrame:
    return variogram.neighbour_lists(mq.earlier_near(spark, sf), tables.positions(spark, sf), mq.field(spark, sf))


@query(PAIRS + """SELECT a.src, CAST(a.rn - 1 AS INTEGER) AS j, CAST(b.rn - 1 AS INTEGER) AS k,
  round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS lag,
  round((a.v - b.v) * (a.v - b.v) / 2, 3) AS half
FROM lists a JOIN lists b ON a.src = b.src AND a.rn < b.rn WHERE a.m >= 3""")
def semivariogram_pairs(spark, sf):
    """Lag and half squared difference of all pairs of a vertex's four neighbours."""
    return variogram.semivariogram_pairs(variogram_lists(spark, sf)).select(
        "src", "j", "k", F.round("lag", 6).alias("lag"), F.round("half", 3).alias("half")
    )


def _kriging_lists() -> str:
    """The relation that ``_kriging_sql`` takes, from the lists of the static field."""
    ks = range(1, SWEEP_K + 1)
    slots = ", ".join(f"max(l.{c}) FILTER (l.rn = {i}) AS {c}{i}" for i in ks for c in "xyv")
    return f"""SELECT src, m, {', '.join(f'(x{i} - tx) ** 2 + (y{i} - ty) ** 2 AS n{i}' for i in ks)},
      {', '.join(f'(x{i} - x{j}) ** 2 + (y{i} - y{j}) ** 2 AS p{i}{j}, (v{i} - v{j}) ** 2 / 2 AS h{i}{j}' for i, j in PAIR_NAMES)}
      FROM (SELECT l.src, any_value(l.m) AS m, any_value(t.x) AS tx, any_value(t.y) AS ty, {slots}
            FROM lists l JOIN pos t ON t.vid = l.src WHERE l.m >= 3 GROUP BY l.src)"""


@query(PAIRS + f"""SELECT src, CAST(m AS INTEGER) AS m, reach, sill, usable,
  {', '.join(f'w{i}' for i in range(1, SWEEP_K + 1))}, coalesce(abs(w1 + w2 + w3 + w4 - 1) < 1e-5, false) AS unbiased FROM ({_kriging_sql(_kriging_lists())})""")
def kriging_weights(spark, sf):
    """Fitted variogram and ordinary-kriging weights of every vertex with three or four neighbours."""
    w = variogram.weights_per_vertex(variogram_lists(spark, sf))
    total = F.aggregate("lambda", F.lit(0.0), lambda a, b: a + b)
    return w.select(
        "src", "m", "reach", "sill", F.col("lambda").isNotNull().alias("usable"),
        *[F.col("lambda")[i].alias(f"w{i + 1}") for i in range(SWEEP_K)], F.coalesce(F.abs(total - 1) < 1e-5, F.lit(False)).alias("unbiased"),
    )


@query(PAIRS + """SELECT a.src, CAST(count(*) AS BIGINT) AS pairs, round(avg(abs((a.v - b.v) * (a.v - b.v) / 2
  - 9000 * (1 - exp(-((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / (30.0 * 30.0))))), 2) AS misfit
FROM lists a JOIN lists b ON a.src = b.src AND a.rn < b.rn WHERE a.m >= 3 GROUP BY a.src""")
def variogram_misfit(spark, sf):
    """Mean distance of every vertex's semivariogram pairs from one Gaussian model."""
    pairs = variogram.semivariogram_pairs(variogram_lists(spark, sf))
    model = scalars.gaussian_variogram(F.col("lag"), F.lit(30.0), F.lit(9000.0))
    return pairs.groupBy("src").agg(
        F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.abs(F.col("half") - model)), 2).alias("misfit")
    )
