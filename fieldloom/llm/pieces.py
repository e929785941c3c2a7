"""SentencePiece segmentations by forward filtering and backward sampling, and decoding.

A text is a lattice of vocabulary pieces; a path has the product of its pieces'
probabilities (to the power ``alpha``). Forward sums over all paths reach every node,
then a path is drawn backwards, piece by piece, in proportion to what reaches each
node. The random number at a node is a hash of the row's key and the node's position,
so a row gets the same segmentation in any batch, partition or retry.

Where two neighbouring characters stand together in no piece, every path has a node
between them, so the lattice falls apart into units (mostly a word and the blank before
it). The forward pass runs once per distinct unit and is kept for later texts, up to
KEPT_EDGES; the backward pass runs over all units of a slice at once, both in numpy. Characters without a piece become byte pieces, and so does a
literal U+2581, which would otherwise read as a blank; decoding is therefore lossless.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from fieldloom.llm.common import asset, codepoints, mix64, slices, span_hashes, text, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 1.0
"""Exponent of the piece probabilities: larger is closer to the best path, 0 is uniform."""
SEED = 10
BUCKET_BITS = 17
PAIR_BITS = 22
SLICE = 1 << 18
"""Bytes of text per numpy step."""
KEPT_EDGES = 2_000_000
"""Lattice edges a task keeps between slices (24 bytes each); beyond it, it starts anew."""

BLANK = 0x2581
LITERAL = 0x110000
"""Code inside the lattice of a U+2581 that stands in the text itself."""


@dataclass
class Vocabulary:
    """Sorted hashes of all piece prefixes, piece probabilities, and the bytes of every id."""

    hashes: np.ndarray
    bucket: np.ndarray  # first hash with given leading bits
    ids: np.ndarray  # the piece that a prefix is, or -1
    longer: np.ndarray  # whether a longer piece begins with it
    longest: int
    pairs: np.ndarray  # by hash: whether two characters may stand side by side in a piece
    log_p: np.ndarray
    byte_ids: np.ndarray
    table: pa.Array
    size: int

    def joined(self, codes: np.ndarray) -> np.ndarray:
        """Whether each character may share a piece with the one before it. A chance hit of
        the hash only makes a longer unit."""
        out = np.zeros(len(codes), bool)
        out[1:] = self.pairs[_pair(codes[:-1], codes[1:])]
        return out

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, or -1: leading bits give a bucket of very few entries."""
        top = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        at, stop = self.bucket[top], self.bucket[top + 1]
        out = np.full(len(h), -1, np.int64)
        live = np.flatnonzero(at < stop)
        while len(live):
            i = at[live]
            hit = self.hashes[i] == h[live]
            out[live[hit]] = i[hit]
            at[live] += 1
            live = live[~hit & (i + 1 < stop[live])]
        return out


def _code(piece: str) -> np.ndarray:
    return np.frombuffer(piece.encode("utf-32-le"), np.uint32).astype(np.uint64)


_PLANE = mix64(np.arange(1, (1 << 16) + 1))


def _values(codes: np.ndarray) -> np.ndarray:
    if len(codes) and codes.max() >= 1 << 16:
        return mix64(codes.astype(np.uint64) + np.uint64(1))
    return _PLANE[codes]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) * 40503 + b.astype(np.int64)) & ((1 << PAIR_BITS) - 1)


@lru_cache(2)
def load(model: bytes, alpha: float = ALPHA, ranked: bool = True) -> Vocabulary:
    """``ranked``: scores are merge ranks (a BPE model) and a piece weighs 1 / (rank + 1), by
    Zipf's law; otherwise they are log probabilities."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    byte_ids = np.full(256, -1, np.int64)
    raw = [b""] * n
    for i in range(n):
        if sp.is_byte(i):
            byte_ids[int(names[i][3:5], 16)] = i
            raw[i] = bytes([int(names[i][3:5], 16)])
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces, so some texts could not be decoded")
    log_p = np.full(n, -np.inf)
    score = np.array([sp.get_score(i) for i in range(n)])
    log_p[plain] = -np.log1p(-score[plain]) if ranked else score[plain]
    log_p[byte_ids] = log_p[plain].min() - np.log(2.0)  # a byte is rarer than the rarest piece
    log_p = alpha * (log_p - np.logaddexp.reduce(log_p[np.isfinite(log_p)]))
    for i in plain:
        raw[i] = names[i].replace(chr(BLANK), " ").encode()
    # all prefixes of all pieces, by their hashes
    piece, size = np.array(plain), np.array([len(names[i]) for i in plain])
    values, begin = _values(_code("".join(names[i] for i in plain))), np.cumsum(size) - size
    parts = []
    for k in range(1, int(size.max()) + 1):
        mine = size >= k
        h, where = np.unique(span_hashes(values, begin[mine], begin[mine] + k), return_inverse=True)
        own, longer = np.full(len(h), -1), np.zeros(len(h), bool)
        own[where[size[mine] == k]] = piece[size == k]
        longer[where[size[mine] > k]] = True
        parts.append((h, own, longer))
    h, ids, longer = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.argsort(h)
    bucket = np.searchsorted(h[order] >> np.uint64(64 - BUCKET_BITS), np.arange((1 << BUCKET_BITS) + 1, dtype=np.uint64))
    pairs = np.zeros(1 << PAIR_BITS, bool)
    for i in plain:
        codes = _code(names[i])
        pairs[_pair(codes[:-1], codes[1:])] = True
    return Vocabulary(
        h[order], bucket, ids[order], longer[order], int(size.max()), pairs, log_p, byte_ids,
        pa.array(raw, pa.binary()), n,
    )


@dataclass
class Lattice:
    """Edges sorted by the node they lead to, then by length."""

    src: np.ndarray
    piece: np.ndarray  # id, or vocabulary size + code point for a character spelt in bytes
    cum: np.ndarray  # cumulative probability among the edges into the node
    first: np.ndarray  # first edge into each node, and one more
    start: np.ndarray  # first node of each unit


class Kept:
    """Lattices of the units seen so far, by hash."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.units = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        n = KEPT_EDGES + KEPT_EDGES // 4
        whole, real = np.int32, np.float64
        self.lattice = Lattice(np.empty(n, whole), np.empty(n, whole), np.empty(n, real), np.zeros(n + 1, whole), np.empty(n, whole))
        self.edges = self.nodes = self.n_units = 0

    def _add(self, name: str, at: int, more: np.ndarray) -> None:
        """Write ``more`` into an array from ``at`` on, which grows only for a very large slice."""
        held = getattr(self.lattice, name)
        if at + len(more) > len(held):
            held = np.concatenate([held[:at], np.empty(len(more) * 2, held.dtype)])
            setattr(self.lattice, name, held)
        held[at : at + len(more)] = more

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.units[at], -1)

    def units_of(self, hashes: np.ndarray, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Index of each (distinct, ascending) unit; those not seen before are added."""
        if self.edges > KEPT_EDGES:
            self._clear()
        found = self._find(hashes)
        new = np.flatnonzero(found < 0)
        if len(new):
            at = np.concatenate([[0], np.cumsum(size[new])])
            inside = np.arange(at[-1]) - np.repeat(at[:-1], size[new])
            more = forward(self.v, codes[np.repeat(start[new], size[new]) + inside], at)
            found[new] = self.n_units + np.arange(len(new))
            self._add("src", self.edges, more.src + self.nodes)
            self._add("piece", self.edges, more.piece)
            self._add("cum", self.edges, more.cum)
            self._add("first", self.nodes, more.first + self.edges)
            self._add("start", self.n_units, more.start + self.nodes)
            self.edges, self.nodes, self.n_units = self.edges + len(more.src), self.nodes + len(more.first) - 1, self.n_units + len(new)
            where = np.searchsorted(self.hashes, hashes[new])
            self.hashes = np.insert(self.hashes, where, hashes[new])
            self.units = np.insert(self.units, where, found[new])
        return found


def _utf8_length(code: np.ndarray) -> np.ndarray:
    code = np.where(code == LITERAL, BLANK, code)
    return 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)


def _order_by(step: np.ndarray) -> np.ndarray:
    """Stable order; steps of 16 bits are sorted by radix."""
    return np.argsort(step.astype(np.uint16) if step.max(initial=0) < 1 << 16 else step, kind="stable")


def forward(v: Vocabulary, codes: np.ndarray, at: np.ndarray) -> Lattice:
    """Lattice of the units codes[at[u]:at[u + 1]] with the forward sums folded in."""
    size = np.diff(at)
    unit = np.repeat(np.arange(len(size)), size)
    values = _values(codes)
    # a unit of n characters has n + 1 nodes; lengths come in ascending order, so an edge's
    # rank among those into its node is the number already seen there
    entering = np.zeros(len(codes) + len(size), np.int64)
    parts = []
    live = np.arange(len(codes))
    end = at[1:][unit]
    for k in range(1, v.longest + 1):
        live = live[live + k <= end[live]]
        if not len(live):
            break
        where = v.find(span_hashes(values, live, live + k))
        piece = np.where(where >= 0, v.ids[where], -1)
        if k == 1:  # every character has an edge of its own, in bytes if it is no piece
            code = codes.astype(np.int64)
            spelt = piece < 0
            cost = np.where(spelt, v.log_p[v.byte_ids[0]] * _utf8_length(code), v.log_p[piece])
            src, piece = live + unit, np.where(spelt, v.size + code, piece)
        else:
            is_piece = piece >= 0
            src, piece = live[is_piece] + unit[live[is_piece]], piece[is_piece]
            cost = v.log_p[piece]
        dst = src + k
        parts.append((src, dst, piece, cost, entering[dst]))
        entering[dst] += 1
        live = live[(where >= 0) & v.longer[where]]
    first = np.concatenate([[0], np.cumsum(entering)])
    total = int(first[-1])
    src, dst, piece = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total, np.int64)
    log_p = np.empty(total)
    for s, d, i, c, rank in parts:
        e = first[d] + rank
        src[e], dst[e], piece[e], log_p[e] = s, d, i, c
    # sums inside a node go by length, so they do not depend on what else is in the slice
    node_at = at[:-1] + np.arange(len(size))
    step = dst - np.repeat(node_at, first[np.append(node_at[1:], len(entering))] - first[node_at])
    order = _order_by(step)
    alpha = np.zeros(len(entering))
    weight = np.empty(total)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(step, minlength=1))])
    for a, b in zip(bounds[:-1], bounds[1:]):
        if a == b:
            continue
        e = order[a:b]
        x = alpha[src[e]] + log_p[e]
        d = dst[e]
        head = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        many = np.diff(np.append(head, b - a))
        top = np.maximum.reduceat(x, head)
        w = np.exp(x - np.repeat(top, many))
        sums = np.add.reduceat(w, head)
        alpha[d[head]] = top + np.log(sums)
        weight[e] = w / np.repeat(sums, many)
    rank = np.arange(total) - first[dst]
    for r in range(1, int(rank.max(initial=0)) + 1):
        e = np.flatnonzero(rank == r)
        weight[e] += weight[e - 1]
    return Lattice(src, piece, weight, first, node_at)


def sample(kept: Kept, codes: np.ndarray, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, row offsets): one path per row of lattice codes, drawn by the rows' keys."""
    v, rows = kept.v, len(at) - 1
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
    opens = ~v.joined(codes)
    opens[at[:-1][np.diff(at) > 0]] = True
    start = np.flatnonzero(opens)
    stop = np.append(start[1:], len(codes))
    hashes, one, which = np.unique(span_hashes(_values(codes), start, stop), return_index=True, return_inverse=True)
    unit = kept.units_of(hashes, codes, start[one], (stop - start)[one])[which]
    near = np.argsort(unit)  # equal units side by side keep the lattice in cache
    start, stop, unit, lattice = start[near], stop[near], unit[near], kept.lattice
    row = np.searchsorted(at, start, side="right") - 1
    key, zero = keys[row], start - at[row]  # a unit's key and its place in the row
    first = lattice.start[unit].astype(np.int64)
    node = first + (stop - start)
    slot = np.full(len(codes), -1, np.int64)
    live = np.arange(len(start))
    while len(live):
        n, f = node[live], first[live]
        spot = (zero[live] + (n - f)).astype(np.uint64)
        u = (mix64(key[live] ^ mix64(spot)) >> np.uint64(11)) * 2.0**-53
        e, stay = lattice.first[n], lattice.first[n + 1] - 1
        wait = np.flatnonzero(e < stay)
        while len(wait):  # as often as a node has edges
            wait = wait[lattice.cum[e[wait]] <= u[wait]]
            e[wait] += 1
            wait = wait[e[wait] < stay[wait]]
        slot[start[live] + (n - f) - 1] = lattice.piece[e]
        node[live] = lattice.src[e]
        live = live[node[live] > f]
    taken = np.flatnonzero(slot >= 0)
    ids = slot[taken]
    spelt = ids >= v.size
    count = np.ones(len(ids), np.int64)
    count[spelt] = _utf8_length(ids[spelt] - v.size)
    out = np.repeat(ids, count)
    begin = np.cumsum(count) - count
    for i in np.flatnonzero(spelt) if not _all_short(count, spelt) else ():
        data = chr(BLANK if ids[i] - v.size == LITERAL else ids[i] - v.size).encode()
        out[begin[i] : begin[i] + count[i]] = v.byte_ids[list(data)]
    if _all_short(count, spelt):
        out[begin[spelt]] = v.byte_ids[ids[spelt] - v.size]
    ends = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(taken, at)]
    return out.astype(np.int32), ends


def _all_short(count: np.ndarray, spelt: np.ndarray) -> bool:
    return bool((count[spelt] == 1).all())


def encode_slices(kept: Kept, texts: pa.Array, keys: pa.Array, seed: int = SEED) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, end row, piece ids) for runs of rows of about SLICE bytes."""
    raw, at, _ = utf8(texts)
    seeds = np.fromiter(
        (xxhash.xxh64_intdigest(b"" if k is None else b"=" + k.encode(), seed) for k in keys.to_pylist()), np.uint64, len(keys)
    )
    for lo, hi in slices(at, SLICE):
        points, starts = codepoints(raw, at, lo, hi)
        n = np.diff(starts)
        lead = (n > 0).astype(np.int64)  # a text is led in by one blank, an empty one is not
        offsets = np.concatenate([[0], np.cumsum(n + lead)])
        codes = np.full(offsets[-1], BLANK, np.uint32)
        body = np.where(points == 32, BLANK, np.where(points == BLANK, LITERAL, points))
        codes[np.arange(len(points)) + np.repeat(np.cumsum(lead), n)] = body
        got, ends = sample(kept, codes, offsets, seeds[lo:hi])
        yield lo, hi, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(got))


def encode_rows(v: Vocabulary, texts: pa.Array, keys: pa.Array, seed: int = SEED) -> pa.Array:
    parts = [ids for _, _, ids in encode_slices(Kept(v), texts, keys, seed)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


def decode_rows(v: Vocabulary, ids: pa.Array) -> pa.Array:
    ids = ids.fill_null([]) if ids.null_count else ids
    parts = pa.ListArray.from_arrays(pc.subtract(ids.offsets, ids.offsets[0]), v.table.take(ids.flatten()))
    whole = pc.binary_join(parts, pa.scalar(b"", pa.binary()))
    return pa.array([b[1:].decode() if b[:1] == b" " else b.decode() for b in whole.to_pylist()], pa.string())


class Pieces:
    """Encoding and decoding columns for one model file."""

    def __init__(self, spark, model: str = MODEL, alpha: float = ALPHA, seed: int = SEED, ranked: bool = True):
        held = asset(spark, model)

        @F.arrow_udf(ArrayType(IntegerType()))
        def encode(texts: pa.Array, keys: pa.Array) -> pa.Array:
            return encode_rows(load(held.value, alpha, ranked), texts, keys, seed)

        @F.arrow_udf(StringType())
        def decode(ids: pa.Array) -> pa.Array:
            return decode_rows(load(held.value, alpha, ranked), ids)

        self._encode, self._decode = encode, decode

    def encode(self, text_col: str | Column, key_col: str | Column) -> Column:
        key = F.col(key_col) if isinstance(key_col, str) else key_col
        return self._encode(text(text_col), key.cast("string"))

    def decode(self, ids: str | Column) -> Column:
        return self._decode(ids)


def segment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """(id_col, ids, n_pieces, n_chars, lossless): one row per row of ``docs``.

    The sampled piece ids and whether decoding them gives the text back. Null and empty
    texts have no pieces. Equal ids with equal texts are segmented alike; a null id is a
    key of its own. Other columns are ignored.
    """
    held = asset(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(held.value, alpha)
        kept = Kept(v)  # for this task's rows
        for batch in batches:
            ids, texts, keys = batch.columns
            for lo, hi, got in encode_slices(kept, texts, keys, seed):
                said = texts[lo:hi]
                columns = [
                    ids[lo:hi], got, pc.list_value_length(got).cast(pa.int64()), pc.utf8_length(said).cast(pa.int64()),
                    pc.equal(decode_rows(v, got), said),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", *_COLUMNS])

    slim = docs.select(
        F.col(id_col).alias("id"), F.coalesce(text(text_col), F.lit("")).alias("text"), F.col(id_col).cast("string").alias("key")
    )
    kinds = zip(_COLUMNS, (ArrayType(IntegerType()), LongType(), LongType(), BooleanType()))
    out = StructType([slim.schema["id"], *[StructField(c, t) for c, t in kinds]])
    return slim.mapInArrow(run, out).withColumnRenamed("id", id_col)


_COLUMNS = ("ids", "n_pieces", "n_chars", "lossless")
