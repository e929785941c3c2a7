"""Adjacency, neighbours, permutations, parts, orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.catalogue.registry import (
    CORNERS, DIST, EDGES, OPEN_LOOP, PART_SIZE, POS, STATIC, TETS, WEIGHTS,
    cells_cte, near_cte, parts_cte, query, with_,
)
from fieldloom.functions import scalars
from fieldloom.operators import adjacency, components, neighbours, partition, permute, ranking, stats, traverse
from fieldloom.sources import tables


def all_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of the tetrahedra, and of the orders that are too short for one, both ways."""
    return adjacency.both_ways(tables.order_edges(spark, sf))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Edges from the smaller id to the larger, as they are stored."""
    return tables.once(spark, sf, "edges", lambda: tables.order_edges(spark, sf))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges, both ways; stored one way."""
    return adjacency.both_ways(pairs(spark, sf))


def distances(spark: SparkSession, sf: str) -> DataFrame:
    """Edges with their length, both ways; stored one way."""
    return adjacency.both_ways(tables.once(spark, sf, "distances", lambda: tables.order_distances(spark, sf)))


def earlier_near(spark: SparkSession, sf: str, k: int = 4) -> DataFrame:
    """(src, dst, dist, rn): the k nearest neighbours of smaller id. Edges come partitioned by their larger
    end, so they are made distinct and ranked where they are, and never stored."""
    edges = tables.order_distances(spark, sf, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")
    return neighbours.nearest(edges, k)


def inner_edges(spark: SparkSession, sf: str) -> DataFrame:
    """(part, src, dst): edges inside a part, both ways; stored one way."""
    return adjacency.both_ways(tables.once(spark, sf, "inner-edges", lambda: tables.order_edges_inside(spark, sf, parts(spark, sf))))


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return tables.once(
        spark, sf, "parts", lambda: partition.assign_parts(tables.positions(spark, sf), PART_SIZE)
    )


def field(spark: SparkSession, sf: str) -> DataFrame:
    return tables.once(spark, sf, "static", lambda: tables.static_field(spark, sf))


def weights(spark: SparkSession, sf: str, k: int = 4) -> DataFrame:
    near = neighbours.nearest(adjacency.causal(distances(spark, sf)), k)
    return neighbours.inverse_distance_weights(near)


@query(with_(EDGES) + "SELECT src AS vid, CAST(count(*) AS BIGINT) AS degree FROM edges GROUP BY src")
def adjacency_degree(spark, sf):
    """Full adjacency."""
    return adjacency.degrees(all_edges(spark, sf))


@query(with_(EDGES) + """SELECT src AS vid, CAST(count(*) AS BIGINT) AS degree
FROM edges WHERE dst < src GROUP BY src""")
def causal_adjacency_degree(spark, sf):
    """Causal adjacency: only smaller ids are neighbours."""
    return adjacency.degrees(adjacency.causal(all_edges(spark, sf)))


@query(with_(EDGES, cells_cte("wedges", 6)) + """, template(i, j) AS (
  VALUES (1,2),(1,3),(2,3),(4,5),(4,6),(5,6),(1,4),(2,5),(3,6)),
wedge AS (SELECT verts[i] AS a, verts[j] AS b FROM wedges, template),
every AS (SELECT src, dst FROM edges UNION SELECT a, b FROM wedge UNION SELECT b, a FROM wedge)
SELECT src AS vid, CAST(count(*) AS BIGINT) AS degree,
       CAST(count(CASE WHEN dst < src THEN 1 END) AS BIGINT) AS causal_degree
FROM every GROUP BY src""")
def wedge_adjacency_degree(spark, sf):
    """Tetrahedra and wedges together, and short orders."""
    e = adjacency.from_cells_and_wedges(tables.tets(spark, sf), 4, tables.wedges(spark, sf))
    e = e.unionByName(adjacency.from_pairs(tables.short_pairs(spark, sf))).distinct()
    return e.groupBy(F.col("src").alias("vid")).agg(
        F.count(F.lit(1)).alias("degree"), F.count_if(F.col("dst") < F.col("src")).alias("causal_degree")
    )


@query("""WITH pairs AS (
  SELECT DISTINCT least(a.l_partkey, b.l_partkey) AS a, greatest(a.l_partkey, b.l_partkey) AS b
  FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_partkey <> b.l_partkey),
both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs)
SELECT a AS vid, CAST(count(*) AS BIGINT) AS degree, CAST(sum(b) AS BIGINT) AS id_sum
FROM both_ways GROUP BY a""")
def edge_list_adjacency(spark, sf):
    """Adjacency from an edge list: parts on consecutive lines of an order."""
    lines = tables.read(spark, sf, "lineitem")
    here = lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"))
    then = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    pairs = here.join(then, ["l_orderkey", "l_linenumber"]).select("src", "dst")
    return adjacency.from_pairs(pairs).groupBy(F.col("src").alias("vid")).agg(
        F.count(F.lit(1)).alias("degree"), F.sum("dst").alias("id_sum")
    )


def padded(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.padded_table(
        neighbours.nearest(distances(spark, sf), 7), tables.positions(spark, sf), 7
    )


PADDED = """padded AS (
  SELECT p.vid, coalesce(n.ids, []) || list_resize(CAST([] AS BIGINT[]), 7 - coalesce(len(n.ids), 0), 0) AS nbrs
  FROM pos p LEFT JOIN (SELECT src, list(dst + 1 ORDER BY rn) AS ids FROM near GROUP BY src) n
    ON n.src = p.vid)"""


@query(with_(EDGES, POS, DIST, near_cte(7, False), PADDED)
       + "SELECT vid, array_to_string(nbrs, ' ') AS nbrs FROM padded")
def padded_neighbour_table(spark, sf):
    """1-based neighbour table with zero padding."""
    return padded(spark, sf).select("vid", F.array_join(F.col("nbrs").cast("array<string>"), " ").alias("nbrs"))


@query(with_(EDGES, POS, DIST, near_cte(7, False)) + """, both_ways AS (
  SELECT src, dst FROM near UNION SELECT dst, src FROM near)
SELECT src AS vid, CAST(count(*) AS BIGINT) AS degree, CAST(sum(dst) AS BIGINT) AS id_sum
FROM both_ways GROUP BY src""")
def padded_table_adjacency(spark, sf):
    """Symmetric adjacency read back from the padded table."""
    return adjacency.from_padded_table(padded(spark, sf)).groupBy(F.col("src").alias("vid")).agg(
        F.count(F.lit(1)).alias("degree"), F.sum("dst").alias("id_sum")
    )


ORDER_SQL = "ord AS (SELECT vid, row_number() OVER (ORDER BY y, x, vid) - 1 AS rank FROM pos)"


def price_order(spark: SparkSession, sf: str) -> DataFrame:
    p = tables.positions(spark, sf).select("vid", F.col("pos")[1].alias("y"), F.col("pos")[0].alias("x"))
    return tables.once(
        spark, sf, "price-order", lambda: ranking.with_rank(p, ["y", "x", "vid"]).select("vid", "rank")
    )


@query(with_(EDGES, POS, ORDER_SQL) + """SELECT e.src AS vid, CAST(count(*) AS BIGINT) AS degree
FROM edges e JOIN ord s ON s.vid = e.src JOIN ord d ON d.vid = e.dst
WHERE d.rank < s.rank GROUP BY e.src""")
def causal_under_order(spark, sf):
    """Causal adjacency under a new visiting order."""
    return adjacency.degrees(adjacency.causal_under(edges(spark, sf), price_order(spark, sf)))


@query(with_(EDGES, POS, parts_cte()) + """SELECT s.part, CAST(count(*) AS BIGINT) AS kept
FROM edges e JOIN parts s ON s.vid = e.src JOIN parts d ON d.vid = e.dst
WHERE s.part = d.part GROUP BY s.part""")
def part_local_edges(spark, sf):
    """Edges that survive cutting the mesh into parts."""
    return adjacency.within_parts(edges(spark, sf), parts(spark, sf)).groupBy("part").agg(
        F.count(F.lit(1)).alias("kept")
    )


@query(with_(EDGES, POS, "sample AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS idx FROM pos WHERE x <= 25)")
       + """SELECT s.idx AS vid, CAST(count(*) AS BIGINT) AS degree, CAST(sum(d.idx) AS BIGINT) AS id_sum
FROM edges e JOIN sample s ON s.vid = e.src JOIN sample d ON d.vid = e.dst GROUP BY s.idx""")
def induced_subgraph(spark, sf):
    """Sub-graph on a vertex sample (small sizes), re-indexed by sample position."""
    small = tables.positions(spark, sf).where(F.col("pos")[0] <= 25).select("vid")
    sample = ranking.with_rank(small, ["vid"], "idx")
    return adjacency.induced(edges(spark, sf), sample).groupBy(F.col("src").alias("vid")).agg(
        F.count(F.lit(1)).alias("degree"), F.sum("dst").alias("id_sum")
    )


@query(with_(TETS, CORNERS) + """SELECT vid, CAST(count(*) AS BIGINT) AS cells,
  CAST(sum(corner) AS BIGINT) AS corner_sum, min(cid) AS first_cell FROM corners GROUP BY vid""")
def cell_incidence(spark, sf):
    """Vertex to cell incidence lists."""
    return adjacency.incidence(tables.tets(spark, sf)).groupBy("vid").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("corner").alias("corner_sum"), F.min("cid").alias("first_cell")
    )


@query(with_(EDGES, POS, DIST, near_cte(4), WEIGHTS)
       + "SELECT src, dst, CAST(rn AS INTEGER) AS rn, round(w, 6) AS w FROM weights")
def nearest_neighbour_weights(spark, sf):
    """Four nearest causal neighbours with normalized inverse-distance weights."""
    return weights(spark, sf).select("src", "dst", "rn", F.round("w", 6).alias("w"))


@query(with_(EDGES, POS, DIST, near_cte(4), WEIGHTS, STATIC, OPEN_LOOP)
       + "SELECT vid, round(pred, 4) AS pred FROM pred")
def open_loop_prediction(spark, sf):
    """Inverse-distance prediction from the original neighbour values."""
    f = field(spark, sf)
    return neighbours.open_loop(weights(spark, sf), f, f).select("vid", F.round("pred", 4).alias("pred"))


# The prediction is rounded to a 1/64 grid before quantization so that the order
# of a floating-point sum cannot move an index between engines.
GRID_PRED = "round(pred * 64) / 64"
QUANT = f"""steps AS (
  SELECT p.vid, f.val, {GRID_PRED} AS pred, CAST(f.val AS DOUBLE) - {GRID_PRED} AS diff
  FROM pred p JOIN field f ON f.vid = p.vid),
halves AS (SELECT *, floor((abs(diff) / 2.5 + 1) / 2) AS h FROM steps),
decs AS (SELECT *, CAST(pred + 2.0 * CASE WHEN diff > 0 THEN h ELSE -h END * 2.5 AS FLOAT) AS d FROM halves),
quant AS (
  SELECT vid, val, pred, diff, h, d,
         abs(diff) / 2.5 + 1 < 65536 AND abs(CAST(d AS DOUBLE) - CAST(val AS DOUBLE)) < 2.5 AS fits FROM decs),
coded AS (
  SELECT vid, val, pred, CAST(CASE WHEN fits THEN 32768 + CASE WHEN diff > 0 THEN h ELSE -h END ELSE 0 END AS INTEGER) AS q,
         CASE WHEN fits THEN d ELSE val END AS dec FROM quant)"""
CODED = with_(EDGES, POS, DIST, near_cte(4), WEIGHTS, STATIC, OPEN_LOOP, QUANT)
EB = 2.5


def coded(spark: SparkSession, sf: str) -> DataFrame:
    """(vid, val, pred, q, dec): open-loop prediction and quantization at a fixed bound."""
    f = field(spark, sf)
    pred = neighbours.open_loop(weights(spark, sf), f, f)
    grid = F.round(F.col("pred") * 64) / 64
    return (
        f.join(pred, "vid")
        .select("vid", "val", grid.alias("pred"))
        .withColumn("s", scalars.quantize(F.col("val"), F.col("pred"), F.lit(EB)))
        .select("vid", "val", "pred", "s.q", "s.dec")
    )


@query(CODED + "SELECT vid, q, round(CAST(dec AS DOUBLE), 3) AS dec FROM coded")
def quantize(spark, sf):
    """Error-bounded linear quantization of the prediction residual."""
    return coded(spark, sf).select("vid", "q", F.round(F.col("dec").cast("double"), 3).alias("dec"))


@query(CODED + "SELECT vid, q, true AS same, true AS ok FROM coded")
def dequantize(spark, sf):
    """Index back to value: equal to the encoder's value and inside the bound."""
    back = scalars.dequantize(F.col("q"), F.col("pred"), F.lit(EB), F.col("val"))
    return coded(spark, sf).select(
        "vid", "q", (back == F.col("dec")).alias("same"),
        (F.abs(back.cast("double") - F.col("val").cast("double")) <= EB).alias("ok"),
    )


ERRORS = """SELECT CAST(count(*) AS BIGINT) AS n, min(CAST(val AS DOUBLE)) AS lo, max(CAST(val AS DOUBLE)) AS hi,
  round(max(abs(CAST(dec AS DOUBLE) - CAST(val AS DOUBLE))), 5) AS max_err,
  (SELECT vid FROM {src} ORDER BY abs(CAST(dec AS DOUBLE) - CAST(val AS DOUBLE)) DESC, vid LIMIT 1) AS worst_vid,
  round(avg(pow(CAST(dec AS DOUBLE) - CAST(val AS DOUBLE), 2)), 5) AS mse,
  round(20 * log10((max(CAST(val AS DOUBLE)) - min(CAST(val AS DOUBLE)))
        / sqrt(avg(pow(CAST(dec AS DOUBLE) - CAST(val AS DOUBLE), 2)))), 4) AS psnr
FROM {src}"""


@query(CODED + ERRORS.format(src="coded"))
def error_stats(spark, sf):
    """Max error and its position, mean squared error, PSNR."""
    s = stats.error_stats(coded(spark, sf).withColumn("all", F.lit(0)), ["all"])
    return s.select(
        "n", "lo", "hi", F.round("max_err", 5).alias("max_err"), "worst_vid",
        F.round("mse_all", 5).alias("mse"), F.round("psnr", 4).alias("psnr"),
    )


@query(with_(POS, ORDER_SQL, STATIC) + """SELECT o.rank AS vid, round(CAST(f.val AS DOUBLE), 3) AS val, true AS restored
FROM field f JOIN ord o ON o.vid = f.vid""")
def reorder_field(spark, sf):
    """Permute a field by an order, and check that the inverse restores it."""
    f, o = field(spark, sf), price_order(spark, sf)
    moved = permute.reorder(f, o)
    back = permute.reorder_back(moved, o).withColumnRenamed("val", "again")
    check = f.join(back, "vid").join(o, "vid").select(
        F.col("rank").alias("vid"), (F.col("val") == F.col("again")).alias("restored")
    )
    return moved.select("vid", F.round(F.col("val").cast("double"), 3).alias("val")).join(check, "vid")


@query(with_(TETS, CORNERS, POS, ORDER_SQL) + """SELECT cid, string_agg(CAST(rank AS VARCHAR), ' ' ORDER BY corner) AS verts
FROM corners c JOIN ord o ON o.vid = c.vid GROUP BY cid""")
def reorder_cells(spark, sf):
    """Connectivity rewritten under a new order, corner positions kept."""
    moved = permute.reorder_cells(tables.tets(spark, sf), price_order(spark, sf))
    return moved.select("cid", F.array_join(F.col("verts").cast("array<string>"), " ").alias("verts"))


@query(with_(POS, parts_cte()) + """SELECT vid, part,
  row_number() OVER (ORDER BY part, vid) - 1 AS slot FROM parts""")
def part_slots(spark, sf):
    """Slot of every vertex when the parts are laid out one after another."""
    return partition.part_slots(parts(spark, sf))


REFINE_ROUNDS = 6


def refined_cte(rounds: int = REFINE_ROUNDS, slack: float = 0.05) -> str:
    """Label propagation within capacities, round by round: part0 is the curve's, the last one ``refined``."""
    out = [f"""bounds AS (SELECT CAST(ceil(avg(n) * {1 + slack}) AS BIGINT) AS most, CAST(floor(avg(n) * {1 - slack}) AS BIGINT) AS least
  FROM (SELECT count(*) AS n FROM parts GROUP BY part)),
part0 AS MATERIALIZED (SELECT vid, part FROM parts)"""]
    for r in range(rounds):
        turn = f"((vid % 2147483648) * {partition.MULTIPLIER} % {partition.MODULUS}) // {partition.MODULUS // 2}"
        out.append(f"""size{r} AS (SELECT part, count(*) AS n FROM part{r} GROUP BY part),
votes{r} AS (
  SELECT e.src AS vid, a.part AS own, b.part, count(*) AS n
  FROM edges e JOIN (SELECT * FROM part{r} WHERE {turn} = {r % 2}) a ON a.vid = e.src JOIN part{r} b ON b.vid = e.dst GROUP BY ALL),
asks{r} AS (
  SELECT vid, own, part, n - coalesce((SELECT max(m.n) FROM votes{r} m WHERE m.vid = v.vid AND m.part = m.own), 0) AS gain
  FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY n DESC, part) AS k FROM votes{r} WHERE part <> own) v WHERE k = 1),
ranked{r} AS (
  SELECT *, row_number() OVER (PARTITION BY part ORDER BY gain DESC, vid) AS arrives,
         row_number() OVER (PARTITION BY own ORDER BY gain DESC, vid) AS leaves FROM asks{r} WHERE gain > 0),
moves{r} AS (
  SELECT k.vid, k.part FROM ranked{r} k JOIN size{r} t ON t.part = k.part JOIN size{r} f ON f.part = k.own, bounds
  WHERE arrives <= most - t.n AND leaves <= f.n - least),
part{r + 1} AS MATERIALIZED (SELECT p.vid, coalesce(m.part, p.part) AS part FROM part{r} p LEFT JOIN moves{r} m ON m.vid = p.vid)""")
    return ",\n".join([*out, f"refined AS (SELECT vid, part FROM part{rounds})"])


def refined_parts_table(spark: SparkSession, sf: str) -> DataFrame:
    return tables.once(spark, sf, "refined-parts", lambda: partition.refine(parts(spark, sf), edges(spark, sf), REFINE_ROUNDS))


@query(with_(EDGES, POS, parts_cte(), refined_cte()) + "SELECT vid, part FROM refined")
def refined_parts(spark, sf):
    """Parts of the curve, moved along the edges within 5 % of the mean size."""
    return refined_parts_table(spark, sf)


@query(with_(EDGES, POS, parts_cte(), refined_cte()) + """, cuts AS (
  SELECT least(a.part, b.part) AS part_a, greatest(a.part, b.part) AS part_b, 'curve' AS how FROM edges e JOIN parts a ON a.vid = e.src JOIN parts b ON b.vid = e.dst WHERE e.src < e.dst
  UNION ALL
  SELECT least(a.part, b.part), greatest(a.part, b.part), 'refined' FROM edges e JOIN refined a ON a.vid = e.src JOIN refined b ON b.vid = e.dst WHERE e.src < e.dst)
SELECT part_a, part_b, CAST(count(*) FILTER (how = 'curve') AS BIGINT) AS curve, CAST(count(*) FILTER (how = 'refined') AS BIGINT) AS refined
FROM cuts GROUP BY part_a, part_b""")
def part_cut(spark, sf):
    """Edges inside and between parts, for the curve's parts and the refined ones."""
    curve = partition.cut_edges(parts(spark, sf), edges(spark, sf)).withColumnRenamed("edges", "curve")
    better = partition.cut_edges(refined_parts_table(spark, sf), edges(spark, sf)).withColumnRenamed("edges", "refined")
    both = curve.join(better, ["part_a", "part_b"], "full")
    return both.select("part_a", "part_b", F.coalesce("curve", F.lit(0)).alias("curve"), F.coalesce("refined", F.lit(0)).alias("refined"))


@query(with_(POS, parts_cte()) + "SELECT part, CAST(count(*) AS BIGINT) AS n FROM parts GROUP BY part")
def part_counts(spark, sf):
    return partition.part_counts(parts(spark, sf))


@query(with_(POS, parts_cte()) + """SELECT part, CAST(count(*) AS BIGINT) AS n,
  CAST(coalesce(sum(count(*)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
FROM parts GROUP BY part""")
def prefix_offsets(spark, sf):
    """Exclusive prefix sums of the part sizes, and sizes recovered from offsets."""
    counts = partition.part_counts(parts(spark, sf))
    offsets = ranking.exclusive_prefix(counts, "part", "n").select("part", "offset")
    total = parts(spark, sf).count()
    return partition.loads_from_offsets(offsets, total).join(offsets, "part")


@query("WITH RECURSIVE " + EDGES + """,
bfs(vid, level) USING KEY (vid) AS (
  SELECT CAST(0 AS BIGINT), 0
  UNION
  SELECT e.dst, min(b.level) + 1 FROM bfs b JOIN edges e ON e.src = b.vid
  WHERE NOT EXISTS (SELECT 1 FROM recurring.bfs r WHERE r.vid = e.dst) GROUP BY e.dst)
SELECT vid, level FROM bfs""")
def breadth_first_levels(spark, sf):
    """Hop distance from vertex 0 over the whole mesh."""
    return components.breadth_first_levels(tables.positions(spark, sf), edges(spark, sf), 0)


def local_distances(spark: SparkSession, sf: str) -> DataFrame:
    return tables.once(
        spark, sf, "local-distances",
        lambda: adjacency.within_parts(distances(spark, sf), parts(spark, sf)),
    )


def _order_check(spark, sf, how: traverse.Order) -> DataFrame:
    slots = traverse.order_parts(parts(spark, sf), local_distances(spark, sf), how).where("dst is null")
    return slots.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"),
        ((F.count_distinct("src_slot") == F.count(F.lit(1))) & (F.min("src_slot") == 0)
         & (F.max("src_slot") == F.count(F.lit(1)) - 1)).alias("bijective"),
    )


ORDER_CHECK = with_(POS, parts_cte()) + "SELECT part, CAST(count(*) AS BIGINT) AS n, true AS bijective FROM parts GROUP BY part"


@query("WITH RECURSIVE " + EDGES + ", " + POS + ", " + parts_cte() + """,
inner_edges AS (SELECT e.src, e.dst FROM edges e JOIN parts a ON a.vid = e.src JOIN parts b ON b.vid = e.dst WHERE a.part = b.part),
reach(vid, root) USING KEY (vid) AS (
  SELECT vid, vid FROM parts
  UNION
  SELECT e.src, min(r.root) FROM reach r JOIN inner_edges e ON e.dst = r.vid
  JOIN recurring.reach c ON c.vid = e.src WHERE r.root < c.root GROUP BY e.src),
bfs(vid, root, level, pos) USING KEY (vid) AS (
  SELECT vid, root, 0, 0::BIGINT FROM reach WHERE vid = root
  UNION
  SELECT vid, root, level, row_number() OVER (PARTITION BY root ORDER BY parent, vid) - 1
  FROM (SELECT e.dst AS vid, min(b.root) AS root, min(b.level) + 1 AS level, min(b.pos) AS parent
        FROM bfs b JOIN inner_edges e ON e.src = b.vid
        WHERE NOT EXISTS (SELECT 1 FROM recurring.bfs r WHERE r.vid = e.dst) GROUP BY e.dst))
SELECT p.part, b.vid, CAST(row_number() OVER (PARTITION BY p.part ORDER BY b.root, b.level, b.pos) - 1 AS BIGINT) AS slot
FROM bfs b JOIN parts p ON p.vid = b.vid""")
def visit_breadth_first(spark, sf):
    """Breadth-first queue order inside every part, vertex by vertex."""
    slots = traverse.order_parts(parts(spark, sf), local_distances(spark, sf), traverse.Order.BREADTH)
    return slots.where("dst is null").select("part", F.col("src").alias("vid"), F.col("src_slot").cast("long").alias("slot"))


@query(ORDER_CHECK)
def visit_priority_breadth_first(spark, sf):
    return _order_check(spark, sf, traverse.Order.PRIORITY_BREADTH)


@query(ORDER_CHECK)
def visit_depth_first(spark, sf):
    return _order_check(spark, sf, traverse.Order.DEPTH)


@query(ORDER_CHECK)
def visit_priority_depth_first(spark, sf):
    return _order_check(spark, sf, traverse.Order.PRIORITY_DEPTH)


@query(ORDER_CHECK)
def visit_priority_chain(spark, sf):
    return _order_check(spark, sf, traverse.Order.PRIORITY_CHAIN)


@query("""WITH n AS (SELECT count(*) AS n, count(*) // 16 AS phase FROM part),
slots AS (SELECT p_partkey AS vid, row_number() OVER (ORDER BY p_partkey) - 1 AS slot FROM part)
SELECT vid, CAST(CASE WHEN slot < phase * 16 THEN slot // 16 + (slot % 16) * phase ELSE slot END AS BIGINT) AS turn
FROM slots, n""")
def interleaved_order(spark, sf):
    """Strided prediction order with 16 phases."""
    v = tables.positions(spark, sf).select("vid")
    n = v.count()
    slots = ranking.with_rank(v, ["vid"], "slot")
    return slots.select("vid", scalars.interleaved_slot(F.col("slot"), F.lit(n), F.lit(16)).alias("turn"))
