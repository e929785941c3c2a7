"""Word shingles: SimHash fingerprints, and links of texts that share most of their shingles.

Two texts with a Jaccard similarity of at least ``SIMILAR`` share a shingle among the first
n - ceil(SIMILAR n) + 1 of each, in any common order of shingles (prefix filter). So every
distinct set of shingles goes to the keys of its prefix, in the order of their hashes, but with
popular shingles last: a passage that many texts share is a key only of texts that hold little
else. Which shingles count as popular is read from a sample; any choice gives the same links.
Under a key, sets meet in pairs; pairs pass if their sizes and their counts of shingles by leading
bits of the hash allow the similarity, first by 64 counts and then by about one a shingle (all of
them bounds that no similar pair misses), and what passes is verified on the whole sets.

A key of more than ``PAIRWISE`` sets is still a popular one, or a large group of near copies. Its
members first meet the smallest sets of ``PIVOTS`` classes of the key, and links join components.
Then every member outside the key's largest component meets all members of other components, by
bands of sizes. So all similar pairs are links, or lie in one component: nothing is left out. A
group of near copies is joined over its pivots and costs linear work; only members of a popular
key that are unlike meet in pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fieldloom.llm.common import mix64, slices, span_hashes, utf8, word_spans
from fieldloom.operators.components import components
from fieldloom.session import materialize

SEED = 42
SHINGLE = 3
"""Words of a shingle of the fingerprint."""
WORDS = 5
"""Words of a shingle of the similarity."""
SIMILAR = 0.8
PAIRWISE = 32
PIVOTS = 8
POPULAR = 1 << 16
"""Most shingles that are put last."""
SAMPLED = 32
"""One set in so many is searched for them; a shingle counts from OFTEN of these sets on."""
OFTEN = 3
SLICE = 1 << 18
"""Text that one numpy step holds; the arrays over it are some forty times larger."""
BAND = math.log(1.26)
"""Sizes of similar sets differ by a factor of 1.25 at most: in neighbouring bands."""


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of UTF-8 text: the majority bit of the shingles' XXH64 values.

    A-Z is lower-cased and words are split at ASCII white space; bytes.lower and
    bytes.split do exactly that and leave other code points whole. Fewer words than
    a shingle are one shingle; no word gives 0.
    """
    words = data.lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    last = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for lo in range(0, last, 1 << 14):
        h = np.fromiter(
            (digest(join(words[i : i + shingle]), SEED) for i in range(lo, min(last, lo + (1 << 14)))),
            np.dtype("<u8"),
        )
        bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > last, bitorder="little").view("<u8")[0])


def shingle_sets(raw: np.ndarray, at: np.ndarray, lo: int, hi: int, words: int = WORDS) -> list[np.ndarray]:
    """The distinct shingle hashes of rows lo..hi, ascending; fewer words are one shingle, none is none."""
    b = raw[at[lo] : at[hi]]
    b = np.where((b >= 0x41) & (b <= 0x5A), b | 0x20, b).astype(np.uint8)
    starts, ends, row = word_spans(b, at[lo : hi + 1] - at[lo])
    edge = np.searchsorted(row, np.arange(hi - lo + 1))
    each = span_hashes(b.astype(np.uint64) + np.uint64(1), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    out = []
    for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
        n = max(1, j - i - words + 1) if j > i else 0
        h = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(min(words, j - i)):
                h = mix64(h * np.uint64(31) + each[i + k : i + k + n])
        out.append(np.unique(h))
    return out


SIGNATURE = StructType([StructField("fp", LongType()), StructField("set", LongType()), StructField("n", LongType())])


@F.arrow_udf(SIGNATURE)
def _signatures(texts: pa.Array) -> pa.Array:
    raw, at, _ = utf8(texts)
    prints, names, sizes = [], [], []
    for lo, hi in slices(at, SLICE):
        for i, s in enumerate(shingle_sets(raw, at, lo, hi), lo):
            prints.append(fingerprint(raw[at[i] : at[i + 1]].tobytes()))
            names.append(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)) if len(s) else np.uint64(0))
            sizes.append(len(s))
    columns = [np.array(prints, np.uint64).view(np.int64), np.array(names, np.uint64).view(np.int64), np.array(sizes, np.int64)]
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=SIGNATURE.names)


def signature(texts: Column) -> Column:
    """(fp, set, n): fingerprint, name and size of the set of shingles."""
    return _signatures(texts)


def _per_text(texts: DataFrame, rows: Callable[[list[np.ndarray], pa.Array], dict], schema: str) -> DataFrame:
    """``rows`` of the shingle sets of texts (set, text), slice by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at, _ = utf8(batch.column("text"))
            for lo, hi in slices(at, SLICE):
                yield pa.RecordBatch.from_pydict(rows(shingle_sets(raw, at, lo, hi), batch.column("set")[lo:hi]))

    return texts.select("set", "text").mapInArrow(run, schema)


def _lists(values: list[np.ndarray], kind: type) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*values, np.zeros(0, kind)]).astype(kind)))


def _popular(texts: DataFrame) -> np.ndarray:
    """Hashes of shingles that many of the sampled sets hold, ascending; at most POPULAR."""
    some = texts.where(F.pmod("set", F.lit(SAMPLED)) == 0).dropDuplicates(["set"])
    held = _per_text(some, lambda sets, _: {"key": np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)}, "key long")
    counts = held.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    top = counts.orderBy(F.desc("n"), "key").limit(POPULAR).select("key").toArrow()
    return np.sort(top.column("key").to_numpy().astype(np.int64).view(np.uint64))


def fine_counts(s: np.ndarray) -> np.ndarray:
    """Shingles by the leading bits of their hash: about one count a shingle, of a byte each."""
    bits = max(6, (len(s) - 1).bit_length())
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def fine_apart(a: np.ndarray, b: np.ndarray) -> int:
    """By how much the fine counts of two sets differ in all; the longer ones are added up to the shorter's."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    b = np.minimum(b.reshape(len(a), -1).sum(axis=1, dtype=np.int64), 255)
    return int(np.abs(a.astype(np.int64) - b).sum())


def described(texts: DataFrame, popular: np.ndarray) -> DataFrame:
    """(set, n, counts, prefix, fine) of every text (set, text): the set's name and size, its shingles by
    the first six bits of their hash, the prefix of the order that has ``popular`` ones last, and size
    and fine counts as bytes."""

    def last(s: np.ndarray) -> np.ndarray:
        if not len(popular):
            return np.zeros(len(s), bool)
        return popular[np.minimum(np.searchsorted(popular, s), len(popular) - 1)] == s

    def rows(sets: list[np.ndarray], names: pa.Array) -> dict:
        counts, prefixes = [], []
        for s in sets:
            counts.append(np.minimum(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=64), 127).astype(np.int8))
            hot = last(s)
            prefixes.append(np.concatenate([s[~hot], s[hot]])[: len(s) - -(-len(s) * 4 // 5) + 1].view(np.int64))
        fine = pa.array([np.int64(len(s)).tobytes() + fine_counts(s).tobytes() for s in sets], pa.binary())
        return {"set": names, "n": np.array([len(s) for s in sets], np.int64), "counts": _lists(counts, np.int8), "prefix": _lists(prefixes, np.int64), "fine": fine}

    return _per_text(texts, rows, "set long, n long, counts array<tinyint>, prefix array<long>, fine binary")


def _passes(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) of members whose sizes and counts allow the similarity.

    At a similarity of 0.8 or more, at most a ninth of all shingles are in one set only, and counts
    by any rule cannot differ by more.
    """
    sizes = F.least("a.n", "b.n") * 5 >= F.greatest("a.n", "b.n") * 4
    apart = F.aggregate(F.zip_with("a.counts", "b.counts", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda s, v: s + v)
    fits = pairs.where(sizes).where(apart * 9 <= F.col("a.n") + F.col("b.n"))
    return fits.select(F.least("a.set", "b.set").alias("src"), F.greatest("a.set", "b.set").alias("dst"))


def _members(sets: DataFrame) -> DataFrame:
    """(key, m, s): the sets of every key that m > 1 sets share; s is (set, n, counts)."""
    keys = sets.select("set", F.explode("prefix").alias("key"))
    counts = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "shingle-keys")
    shared = keys.join(counts, "key")  # ids alone are exchanged; sizes and counts join those that are left
    return materialize(shared.join(sets.select("set", "n", "counts"), "set").select("key", "m", F.struct("set", "n", "counts").alias("s")), "shingle-members")


def _first_meetings(few: DataFrame, many: DataFrame) -> DataFrame:
    """(src, dst): all pairs of small keys, and the members of large ones with the key's pivots."""
    a, b = few.select("key", F.col("s").alias("a")), few.select("key", F.col("s").alias("b"))
    pairs = a.join(b, "key").where("a.set < b.set")
    kind = F.pmod(F.col("s.set"), F.lit(PIVOTS))
    pivots = materialize(many.groupBy("key", kind.alias("kind")).agg(F.min("s").alias("b")), "shingle-pivots")
    stars = many.select("key", F.col("s").alias("a")).join(pivots, "key").where("a.set <> b.set")
    return _passes(pairs).unionByName(_passes(stars)).distinct()


def _later_meetings(many: DataFrame, joined: DataFrame) -> DataFrame:
    """(src, dst): pairs of large keys whose ends are not yet joined by the links ``joined``.

    Of two sets in different components one at least is outside the key's largest component.
    """
    ends = joined.select(F.explode(F.array("src", "dst")).alias("vid")).distinct()
    roots = components(ends, joined).select(F.col("vid").alias("set"), "root")
    placed = many.select("key", "s", F.col("s.set").alias("set")).join(roots, "set", "left").select("key", "s", F.coalesce("root", "set").alias("root"))
    sizes = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    tops = sizes.groupBy("key").agg(F.max(F.struct("c", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    band = F.floor(F.log(F.col("s.n").cast("double")) / F.lit(BAND))
    split = materialize(placed.join(tops.select("key", F.col("top.root").alias("top")), "key").withColumn("band", band), "shingle-split")
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band")
    a = split.where("root <> top").select("key", near, F.col("s").alias("a"), F.col("root").alias("ra"))
    b = split.select("key", "band", F.col("s").alias("b"), F.col("root").alias("rb"))
    return _passes(a.join(b, ["key", "band"]).where("ra <> rb")).distinct()


def links(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(src, dst) between names of sets of similarity SIMILAR or more, verified on whole sets: all such
    pairs, but for those under large keys that other links join already.

    ``rows`` are (set, n) of all texts, ``texts`` (set, text).
    """
    if rows.where("n > 0").isEmpty():  # no text has a word
        return rows.select(F.col("set").alias("src"), F.col("set").alias("dst")).limit(0)
    worded = texts.where("set <> 0")
    each = described(worded, _popular(worded)).groupBy("set")
    sets = materialize(each.agg(*[F.first(c).alias(c) for c in ("n", "counts", "prefix", "fine")]), "shingle-sets")
    members = _members(sets)
    few, many = members.where(F.col("m") <= PAIRWISE), members.where(F.col("m") > PAIRWISE)
    found = materialize(_verified(_first_meetings(few, many), sets, worded), "shingle-links")
    if many.isEmpty():
        return found
    return found.unionByName(_verified(_later_meetings(many, found), sets, worded)).distinct()


def _holding(pairs: DataFrame, sides: DataFrame, good: Callable[[bytes, bytes], bool]) -> DataFrame:
    """The pairs (src, dst) for which ``good`` holds on the ``data`` of both ends in ``sides`` (set, data)."""
    both = pairs.join(sides.select(F.col("set").alias("src"), F.col("data").alias("a")), "src").join(sides.select(F.col("set").alias("dst"), F.col("data").alias("b")), "dst")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [good(a.as_py(), b.as_py()) for a, b in zip(batch.column("a"), batch.column("b"))]
            yield batch.select(["src", "dst"]).filter(pa.array(kept, pa.bool_()))

    return both.select("src", "dst", "a", "b").mapInArrow(held, "src long, dst long")


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (src, dst) of sets that have the similarity, by the whole sets of their texts.

    Fine counts go first: an eighth of a set's size, and they leave hardly any pair that is not similar.
    """

    def fits(a: bytes, b: bytes) -> bool:
        n = sum(int(np.frombuffer(x, np.int64, 1)[0]) for x in (a, b))
        return fine_apart(*(np.frombuffer(x, np.uint8, offset=8) for x in (a, b))) * 9 <= n

    def similar(a: bytes, b: bytes) -> bool:
        a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
        return 5 * both >= 4 * (len(a) + len(b) - both)

    pairs = materialize(pairs, "shingle-pairs")
    pairs = materialize(_holding(pairs, sets.select("set", F.col("fine").alias("data")), fits), "shingle-near")
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("set")).distinct()
    one_text = texts.join(ends, "set", "left_semi").groupBy("set").agg(F.min("text").alias("text"))
    hashed = _per_text(one_text, lambda sets, names: {"set": names, "data": pa.array([s.tobytes() for s in sets], pa.binary())}, "set long, data binary")
    return _holding(pairs, materialize(hashed, "shingle-whole"), similar)
