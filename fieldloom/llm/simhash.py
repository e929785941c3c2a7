"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints link at ``distance`` = 2 or fewer differing bits. Cut into two
segments of 32 bits, a linked pair has a segment that differs by at most one bit.
So every distinct fingerprint is indexed, per segment, under its exact value and
under its 32 one-wildcard variants (one bit deleted); equal keys are candidates
and the whole fingerprint is verified. A wildcard key counts only between a row
with that bit set and one without, so a pair meets once per variant, not 32 times.

Copies collapse to one row per fingerprint first. A key shared by more than
``PAIRWISE`` fingerprints (one segment common to a large group of near copies)
is not paired up: there the other segment is expanded the same way, by two
wildcards under an exact key and by one under a wildcard key. Rows of equal
expanded keys differ in two named bits only, so at most four fingerprints meet,
all of them linked. Both ways are exact; work is linear in the size of a hot key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from fieldloom.llm import shingles
from fieldloom.llm.common import free_name, text, utf8
from fieldloom.llm.shingles import SEED, SHINGLE, fingerprint  # noqa: F401
from fieldloom.operators.components import components
from fieldloom.session import materialize, spread

DISTANCE = 2
HALF = 32
"""Bits of a segment; two segments make a fingerprint."""
PAIRWISE = 128
"""Fingerprints under one key that are compared pairwise; larger keys are expanded."""


@F.arrow_udf(LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    raw, at, _ = utf8(texts)
    values = (fingerprint(raw[at[i] : at[i + 1]].tobytes()) for i in range(len(texts)))
    return pa.array(np.fromiter(values, np.uint64, len(texts)).view(np.int64))


def fingerprint_column(col: str | Column) -> Column:
    """The fingerprint's 64 bits as a (signed) long; null and wordless texts give 0."""
    return _fingerprints(text(col))


def _variants(prints: DataFrame) -> DataFrame:
    """(key, side, fp): 33 keys per segment; side tells the deleted bit, 2 where none is."""
    halves = F.explode(
        F.array(
            F.struct(F.lit(0).alias("seg"), F.col("fp").bitwiseAND(0xFFFFFFFF).alias("v")),
            F.struct(F.lit(1).alias("seg"), F.shiftrightunsigned("fp", HALF).alias("v")),
        )
    ).alias("h")
    rows = prints.select("fp", halves).select(
        "fp", "h.seg", "h.v", F.explode(F.sequence(F.lit(0), F.lit(HALF))).alias("p")
    )
    bit = F.expr("shiftright(v, least(p, 31)) & 1")
    side = F.when(F.col("p") == HALF, 2).otherwise(bit).cast("byte")
    kept = F.expr("case when p = 32 then v else v & ~shiftleft(1L, p) end")
    key = kept.bitwiseOR(F.expr("shiftleft(cast(p * 2 + seg as bigint), 32)"))
    return rows.select(key.alias("key"), side.alias("side"), "fp")


def _expanded(members: DataFrame) -> DataFrame:
    """Edges inside large keys: wildcards over the other segment, at most four rows a group."""
    p = F.expr("cast(shiftrightunsigned(key, 33) as int)")
    seg = F.expr("shiftrightunsigned(key, 32) & 1")
    other = F.when(seg == 0, F.shiftrightunsigned("fp", HALF)).otherwise(F.col("fp").bitwiseAND(0xFFFFFFFF))
    one = F.expr("transform(sequence(0, 31), q -> shiftleft(1L, q))")
    two = F.expr(
        "flatten(transform(sequence(0, 30), q -> transform(sequence(q + 1, 31),"
        " r -> shiftleft(1L, q) | shiftleft(1L, r))))"
    )
    wild = members.select("key", "fp", other.alias("o"), F.explode(F.when(p == HALF, two).otherwise(one)).alias("m"))
    met = (
        wild.groupBy("key", "m", F.expr("o & ~m").alias("rest"))
        .agg(F.sort_array(F.collect_set("fp")).alias("fps"))
        .where(F.size("fps") > 1)
    )
    return met.select(F.col("fps")[0].alias("src"), F.explode(F.expr("slice(fps, 2, 3)")).alias("dst"))


def links(prints: DataFrame) -> DataFrame:
    """(src, dst) between distinct fingerprints ``fp``: enough links to join all that are
    within DISTANCE bits of one another, each of them verified or linked by construction.

    A fingerprint has 66 keys, so few bytes of them make much work: they are dealt to all tasks.
    """
    prints = spread(prints, "fp")
    keys = materialize(
        _variants(prints)
        .groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("fp").alias("lo"),
            F.max("fp").alias("hi"),
            F.min("side").alias("s0"),
            F.max("side").alias("s1"),
        )
        .where("n > 1 and (s0 = 2 or s0 < s1)"),
        "simhash-keys",
    )
    near = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= DISTANCE
    two = keys.where("n = 2").select(F.col("lo").alias("src"), F.col("hi").alias("dst")).where(near)
    members = materialize(
        _variants(prints).join(keys.where("n > 2").select("key", "n"), "key"), "simhash-members"
    )
    few = members.where(F.col("n") <= PAIRWISE)
    a = few.select("key", F.col("side").alias("a"), F.col("fp").alias("src"))
    b = few.select("key", F.col("side").alias("b"), F.col("fp").alias("dst"))
    pairs = a.join(b, "key").where("(a = 2 and src < dst) or (a = 0 and b = 1)").where(near)
    many = _expanded(members.where(F.col("n") > PAIRWISE))
    found = two.unionByName(pairs.select("src", "dst")).unionByName(many)
    return found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def _rooted(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, fp), and per fingerprint (fp, first, root): its smallest id, null only if it has
    no other, and the fingerprint that names its component."""
    rows = materialize(
        docs.select(F.col(id_col).alias("id"), fingerprint_column(text_col).alias("fp")), "simhash"
    )
    prints = materialize(rows.groupBy("fp").agg(F.min("id").alias("first")), "simhash-prints")
    edges = materialize(links(prints.select("fp")), "simhash-links")
    touched = edges.select(F.explode(F.array("src", "dst")).alias("vid")).distinct()
    roots = components(touched, edges).withColumnRenamed("vid", "fp")
    return rows, prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, component_id): one row per row of ``docs``.

    component_id is the smallest id reachable over links, the row's own included.
    Null, empty and wordless texts have fingerprint 0 and link like any other. Rows
    repeated under one id give repeated rows; a null id stays null and is the
    smallest only where a component has no other. Other columns are ignored.
    """
    rows, rooted = _rooted(docs, id_col, text_col)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, less near duplicates: one row per component.

    Linked are fingerprints within DISTANCE bits and, beyond them, texts that share 0.8 or
    more of their five-word shingles (module ``shingles``). The row that stays has the
    component's smallest id (null only if there is no other); of rows that share that id, the
    one with the smallest fingerprint, and of those the first read. Texts without words link
    to each other. Columns may be of any type that Parquet stores, with any names; empty
    tables stay empty.
    """
    uid, found = free_name(docs, "row"), free_name(docs, "signature")
    marked = docs.withColumn(uid, F.monotonically_increasing_id()).withColumn(found, shingles.signature(text(text_col)))
    marked = materialize(marked, "simhash-marked")  # every text is read and hashed once
    rows = marked.select(F.col(uid).alias("uid"), F.col(id_col).alias("id"), f"{found}.*")
    prints = materialize(rows.select("fp").distinct(), "simhash-prints")
    close = links(prints)
    alike = shingles.links(rows.select("set", "n"), marked.select(F.col(f"{found}.set").alias("set"), text(text_col).alias("text")))
    # a set of shingles and the fingerprints of its texts are vertices of one graph
    same = rows.where("set <> fp").select(F.col("fp").alias("src"), F.col("set").alias("dst")).distinct()
    one_way = close.unionByName(alike).unionByName(same)
    edges = materialize(one_way.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "simhash-links")
    touched = edges.select(F.explode(F.array("src", "dst")).alias("vid")).distinct()
    roots = components(touched, edges).withColumnRenamed("vid", "fp")
    rooted = rows.select("uid", "id", "fp").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp", "uid"))
    stays = rooted.groupBy("root").agg(first.alias("s")).select(F.col("s.uid").alias("uid"))
    gone = materialize(rows.select("uid").join(stays, "uid", "left_anti"), "simhash-gone")
    return marked.join(gone, F.col(uid) == F.col("uid"), "left_anti").select(*docs.columns)
