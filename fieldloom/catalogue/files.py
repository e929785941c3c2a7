"""Raw files, step files, block transform and streaming form."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.catalogue import fields as fq
from fieldloom.catalogue import mesh as mq
from fieldloom.catalogue import vectors as vq
from fieldloom.catalogue.registry import CELL_EDGES, DIST, EDGES, POS, STATIC, parts_cte, query, with_
from fieldloom.operators import adjacency, components, critical, forest, neighbours, traverse
from fieldloom.plans import blocks, reorder, transform
from fieldloom.session import scratch_dir
from fieldloom.sources import artefacts, rawarray, tables
from fieldloom.streaming.masks import stream_mask_changes, stream_mask_events


def folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT p_partkey AS vid, CAST(CAST(p_size AS FLOAT) AS DOUBLE) AS x, round(CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE), 3) AS y FROM part")
def raw_positions(spark, sf):
    """Positions written as a raw float file and read back by byte range."""
    path = folder(spark, "raw-positions")
    rawarray.write_raw(tables.positions(spark, sf).select("vid", F.col("pos").alias("vals")), path, "float32", "vid")
    back = rawarray.read_raw(spark, path, "float32", 2)
    v = F.col("vals")
    return back.select(
        F.col("idx").alias("vid"), v[0].cast("double").alias("x"), F.round(v[1].cast("double"), 3).alias("y")
    )


@query(with_(fq.SERIES) + """SELECT var, t, CAST(count(*) AS BIGINT) AS n, round(sum(CAST(val AS DOUBLE)), 2) AS total
FROM series GROUP BY var, t""")
def step_files(spark, sf):
    """All steps of every variable written as <var>.dat.<t> arrays, listed and read back."""
    path = folder(spark, "steps")
    rawarray.write_steps(fq.step_field(spark, sf), path)
    back = rawarray.read_steps(spark, path)
    total = F.round(F.sum(F.col("val").cast("double")), 2)
    return back.groupBy("var", "t").agg(F.count(F.lit(1)).alias("n"), total.alias("total"))


TRANSFORM = with_(POS, parts_cte(), STATIC) + """, slots AS (
  SELECT p.part, CAST(f.val AS DOUBLE) AS v, row_number() OVER (PARTITION BY p.part ORDER BY p.vid) - 1 AS slot
  FROM parts p JOIN field f ON f.vid = p.vid),
fours AS (SELECT part, slot // 4 AS block, max(CASE WHEN slot % 4 = 0 THEN v END) AS a,
  coalesce(max(CASE WHEN slot % 4 = 1 THEN v END), max(CASE WHEN slot % 4 = 0 THEN v END)) AS b,
  max(CASE WHEN slot % 4 = 2 THEN v END) AS c0, max(CASE WHEN slot % 4 = 3 THEN v END) AS d0
  FROM slots GROUP BY part, slot // 4),
full4 AS (SELECT part, block, a, b, coalesce(c0, b) AS c, coalesce(d0, c0, b) AS d FROM fours)
SELECT part, CAST(block AS INTEGER) AS block,
  CAST(floor((4*a + 4*b + 4*c + 4*d) / 16 / 1.0 + 0.5) AS BIGINT) AS q0,
  CAST(floor((5*a + b - c - 5*d) / 16 / 1.0 + 0.5) AS BIGINT) AS q1,
  CAST(floor((-4*a + 4*b + 4*c - 4*d) / 16 / 1.0 + 0.5) AS BIGINT) AS q2,
  CAST(floor((-2*a + 6*b - 6*c + 2*d) / 16 / 1.0 + 0.5) AS BIGINT) AS q3 FROM full4"""


@query(TRANSFORM)
def block_transform(spark, sf):
    """Four-point transform of consecutive slots, rounded for a bound of 2.5."""
    laid = fq.static_laid(spark, sf)
    bound = laid.select("var", "tb").distinct().withColumn("eb", F.array(F.lit(2.5)))
    return transform.encode_blocks(laid, bound).select("part", "block", "q0", "q1", "q2", "q3")


def _transform_report(spark, sf, order: traverse.Order) -> DataFrame:
    laid, b = fq.laid_field(spark, sf, order), fq.bounds(spark, sf)
    blob = tables.once(spark, sf, f"blob-transform-{order.name}", lambda: transform.compress(laid, b))
    decoded = transform.decompress(blob, b)
    return blocks.bound_report(blocks.paired(laid, decoded, b, fq.BATCH))


@query(fq.REPORT)
def roundtrip_transform_original_order(spark, sf):
    """Block transform along the original vertex order of a part."""
    return _transform_report(spark, sf, traverse.Order.IDENTITY)


@query(fq.REPORT)
def roundtrip_transform_reordered(spark, sf):
    """Block transform along the depth-first order of a part."""
    return _transform_report(spark, sf, traverse.Order.PRIORITY_DEPTH)


@query(with_(fq.SERIES) + """SELECT var, vid, t FROM (
  SELECT var, vid, t, val = -99999 AS gone,
         coalesce(lag(val = -99999) OVER (PARTITION BY var, vid ORDER BY t), false) AS before
  FROM series WHERE t % 10 = 0) WHERE gone <> before""")
def streamed_mask_changes(spark, sf):
    """Mask changes found by a stateful stream over step snapshots."""
    base = folder(spark, "stream")
    long = fq.long_field(spark, sf)
    for t in range(0, tables.steps(spark, sf), fq.BATCH):
        long.where(F.col("t") == t).write.mode("append").parquet(f"{base}/in")
    stream = (
        spark.readStream.schema("var string, vid bigint, t int, val float")
        .parquet(f"{base}/in")
    )
    q = (
        stream_mask_changes(stream, fq.BATCH)
        .writeStream.format("parquet").outputMode("append")
        .option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema("var string, vid bigint, t int").parquet(f"{base}/out")


@query(with_(fq.SERIES) + f""", arrivals AS (
  SELECT var, vid, t, val = -99999 AS gone,
    vid % 7 = 0 AND t = {fq.BATCH} AND t < (SELECT max(t) FROM series WHERE t % {fq.BATCH} = 0) AS late
  FROM series WHERE t % {fq.BATCH} = 0)
SELECT var, vid, t, false AS late FROM (
  SELECT *, coalesce(lag(gone) OVER (PARTITION BY var, vid ORDER BY t), false) AS before FROM arrivals WHERE NOT late) WHERE gone <> before
UNION ALL SELECT var, vid, t, true FROM arrivals WHERE late""")
def streamed_late_steps(spark, sf):
    """All steps arrive, but every seventh vertex's samples of one step only after a restart: the
    changes that the stream finds, and beside them the samples that came too late."""
    base = folder(spark, "late-stream")
    long = fq.long_field(spark, sf).where(F.col("t") % fq.BATCH == 0)
    held = (F.col("vid") % 7 == 0) & (F.col("t") == fq.BATCH)
    for arrivals in (long.where(~held), long.where(held)):
        arrivals.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema("var string, vid bigint, t int, val float").parquet(f"{base}/in")
        q = (
            stream_mask_events(stream, fq.BATCH)
            .writeStream.format("parquet").outputMode("append").partitionBy("late")
            .option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True).start()
        )
        q.awaitTermination()
    return spark.read.schema("var string, vid bigint, t int, late boolean").parquet(f"{base}/out")


@query(with_(fq.SERIES) + "SELECT unnest(['discount', 'price', 'quantity', 'tax']) AS var, (SELECT count(*) FROM part) * (SELECT count(DISTINCT t) FROM series) AS samples")
def variable_list(spark, sf):
    """Variable names kept as a text list, joined with what the field holds."""
    path = folder(spark, "names")
    f = fq.step_field(spark, sf)
    f.select("var").distinct().coalesce(1).write.text(path)
    names = artefacts.read_variables(spark, path)
    per_var = f.groupBy("var").agg(F.sum(F.size("vals").cast("bigint")).alias("samples"))
    return names.join(per_var, "var").select("var", "samples")


@query(mq.ORDER_CHECK)
def part_tables(spark, sf):
    """Part assignment kept as a table and reused on the second request."""
    path = folder(spark, "part-table")
    artefacts.reuse_or_build(spark, path, lambda: mq.parts(spark, sf))

    def never():
        raise AssertionError("the table exists")

    again = artefacts.reuse_or_build(spark, path, never)
    return again.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) == F.count_distinct("vid")).alias("bijective")
    )


@query(with_(CELL_EDGES, POS, DIST) + """SELECT CAST(count(*) AS BIGINT) AS edges, round(sum(dist), 2) AS length,
  (SELECT CAST(count(*) AS BIGINT) FROM part) AS vertices, true AS dense_ids FROM dists""")
def reordered_mesh(spark, sf):
    """Positions, cells and field renumbered by part and visiting order: same mesh, new ids."""
    order = reorder.order_from_layout(fq.block_mesh(spark, sf))
    pos, cells, f = reorder.reorder_mesh(
        tables.positions(spark, sf), tables.tets(spark, sf), mq.field(spark, sf), order
    )
    lengths = neighbours.with_distance(adjacency.from_cells(cells, 4), pos)
    ids = f.agg(
        F.count(F.lit(1)).alias("vertices"),
        ((F.min("vid") == 0) & (F.max("vid") == F.count_distinct("vid") - 1)).alias("dense_ids"),
    )
    one = lengths.agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("dist"), 2).alias("length"))
    both = one.unionByName(ids, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


@query(with_(vq.TETS, vq.CORNERS, vq.VECTORS, vq.PLACES, vq.gather_sql(), vq.FOUND) + "SELECT cid FROM found")
def critical_point_table(spark, sf):
    """Critical points of the original field kept as a table and reused."""
    path = folder(spark, "critical-points")

    def build():
        return critical.extract(tables.tets(spark, sf), vq.vectors(spark, sf), tables.positions3(spark, sf))

    artefacts.reuse_or_build(spark, path, build)
    return artefacts.reuse_or_build(spark, path, build).select("cid")


QUEUE = "WITH RECURSIVE " + EDGES + """,
reach(vid, root) USING KEY (vid) AS (
  SELECT p_partkey, p_partkey FROM part
  UNION
  SELECT e.src, min(r.root) FROM reach r JOIN edges e ON e.dst = r.vid
  JOIN recurring.reach c ON c.vid = e.src WHERE r.root < c.root GROUP BY e.src),
bfs(vid, root, level, pos) USING KEY (vid) AS (
  SELECT vid, root, 0, row_number() OVER (ORDER BY root) - 1 FROM reach WHERE vid = root
  UNION
  SELECT vid, root, level, row_number() OVER (ORDER BY parent, vid) - 1
  FROM (SELECT e.dst AS vid, min(b.root) AS root, min(b.level) + 1 AS level, min(b.pos) AS parent
        FROM bfs b JOIN edges e ON e.src = b.vid
        WHERE NOT EXISTS (SELECT 1 FROM recurring.bfs r WHERE r.vid = e.dst) GROUP BY e.dst))
"""


@query(QUEUE + """SELECT vid, CAST(level AS INTEGER) AS level, CAST(row_number() OVER (ORDER BY root, level, pos) - 1 AS BIGINT) AS rank FROM bfs""")
def breadth_first_order(spark, sf):
    """Exact breadth-first queue order over the whole mesh."""
    return components.breadth_first_order(tables.positions(spark, sf).select("vid"), mq.edges(spark, sf))


@query(QUEUE + """, seated AS (SELECT vid, level, row_number() OVER (ORDER BY root, level, pos) AS rank FROM bfs),
hung AS (
  SELECT o.vid, CAST(o.level AS INTEGER) AS level, min_by(s.vid, s.rank) AS parent
  FROM seated o LEFT JOIN edges e ON e.dst = o.vid LEFT JOIN seated s ON s.vid = e.src AND s.level = o.level - 1 GROUP BY o.vid, o.level),
paths(vid, path) AS (
  SELECT vid, [vid] FROM hung WHERE level = 0
  UNION ALL
  SELECT h.vid, list_append(p.path, h.vid) FROM paths p JOIN hung h ON h.parent = p.vid),
sizes AS (SELECT vid, count(*) AS size FROM (SELECT unnest(path) AS vid FROM paths) GROUP BY vid),
entered AS (SELECT vid, row_number() OVER (ORDER BY path) - 1 AS pre FROM paths)
SELECT vid, parent, level, CAST(pre AS BIGINT) AS pre, CAST(pre - level + size - 1 AS BIGINT) AS post
FROM hung JOIN entered USING (vid) JOIN sizes USING (vid)""")
def depth_first_numbers(spark, sf):
    """Entry and exit numbers of the breadth-first forest over the whole mesh."""
    return forest.depth_first_numbers(tables.positions(spark, sf).select("vid"), mq.edges(spark, sf))
