"""Cross-tokenizer alignment with corpus-wide pair counts behind a minimal perfect hash.

Two tokenizers encode the same bytes (a space and the text). Where tokens of both end at
one byte, the document is cut into groups; every token pair that shares bytes is linked.
How many documents hold a pair linked is counted over the whole corpus:

1. Every document is encoded once. Its token ids go to a scratch table, and each task adds
   the distinct pairs it met with the number of its documents that hold them.
2. The distinct pairs are spread over shards of about ``SHARD_KEYS`` by their hash. A shard
   gets a minimal perfect hash: levels of bit arrays, where a key that is alone on its bit
   stays and the rest go on to the next level; the slot of a key is the rank of its bit.
   Keys stand beside their slots, so a stranger is recognised.
3. Counts are dense vectors indexed by slot: ``PIECES`` of them per shard, each filled by
   one streaming pass over the pairs of its tasks, then added up as a tree.
4. A second pass aligns the documents again, from their stored ids, and looks the counts
   up. While the whole index stays below ``MODEL_BYTES`` it is sent to the executors; beyond
   that the documents' pairs travel to the shards and sums come back. Both ways give the
   same numbers.

Memory is bounded everywhere: by a slice of text, ``TALLY`` pairs, or one shard.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from fieldloom.llm.common import STEP, asset, mix64, slices, text, utf8
from fieldloom.session import materialize

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"

SHARD_KEYS = 1 << 14
"""Pairs per shard, about."""
PIECES = 8
"""Dense vectors that are filled side by side per shard."""
TALLY = 1 << 20
"""Distinct pairs a task keeps before it hands its counts on."""
MODEL_BYTES = 64 << 20
"""Largest index that is sent to every executor; a larger one stays spread over the shards."""
SPACING = 1.5
"""Bits per key and level of the hash."""

# Fixed value: the pattern that cuts text for byte-level merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# --- tokenizers ---------------------------------------------------------------------


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def _load_a(data: bytes):
    """(encoder, bytes per id) of a byte-level merge tokenizer file; its special strings are plain text."""
    spec = json.loads(data)
    cut = spec["pre_tokenizer"] or {}
    if spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex"):
        raise ValueError("a plain byte-level tokenizer is wanted")
    special = {t["content"] for t in spec["added_tokens"] if t["special"]}
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    spelt = [b""] * (max(spec["model"]["vocab"].values()) + 1)
    for b, i in ranks.items():
        spelt[i] = b
    coder = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return coder, pa.array(spelt, pa.binary())


@lru_cache(2)
def _load_b(data: bytes):
    coder = sentencepiece.SentencePieceProcessor(model_proto=data)
    spelt = []
    for i in range(coder.get_piece_size()):
        piece = coder.id_to_piece(i)
        spelt.append(bytes([int(piece[3:5], 16)]) if coder.is_byte(i) else piece.replace("▁", " ").encode())
    return coder, pa.array(spelt, pa.binary())


def _spelling(table: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, memoryview]:
    """(byte offset of every token and the end, all bytes) of a run of tokens."""
    if not len(ids):
        return np.zeros(1, np.int64), memoryview(b"")
    taken = table.take(pa.array(ids, pa.int32()))
    _, offsets, data = taken.buffers()
    at = np.frombuffer(offsets, np.int32)[taken.offset : taken.offset + len(taken) + 1].astype(np.int64)
    return at - at[0], memoryview(data).cast("B")[at[0] : at[-1]] if data is not None else memoryview(b"")


class Pair:
    """Both tokenizers, loaded once per worker."""

    def __init__(self, a: bytes, b: bytes):
        (self.a, self.spelt_a), (self.b, self.spelt_b) = _load_a(a), _load_b(b)
        self.kinds = [np.uint16 if len(t) <= 1 << 16 else np.uint32 for t in (self.spelt_a, self.spelt_b)]
        self.lengths = [np.diff(np.frombuffer(t.buffers()[1], np.int32)[: len(t) + 1]).astype(np.int64) for t in (self.spelt_a, self.spelt_b)]

    def encode(self, raw: np.ndarray, at: np.ndarray, lo: int, hi: int):
        """Token ids of rows lo..hi by A and by B, each flat with row offsets; rows whose tokens
        do not spell a space and the text have none."""
        said = [raw[at[i] : at[i + 1]].tobytes() for i in range(lo, hi)]
        full = [i for i, s in enumerate(said) if s]
        texts = [said[i].decode() for i in full]
        ids_a = [self.a.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]
        ids_b = [np.array(x, np.int64) for x in self.b.encode(texts, num_threads=1)] if texts else []
        flat, ok = [], np.ones(len(full), bool)
        for ids, spelt in ((ids_a, self.spelt_a), (ids_b, self.spelt_b)):
            whole = np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64)
            ends = np.cumsum([len(x) for x in ids], dtype=np.int64)
            spans, data = _spelling(spelt, whole)
            edge = spans[np.concatenate([[0], ends])]
            for j, i in enumerate(full):
                ok[j] &= data[edge[j] : edge[j + 1]] == b" " + said[i]
            flat.append(ids)
        out = []
        for ids in flat:
            n = np.zeros(hi - lo, np.int64)
            n[full] = [len(x) if good else 0 for x, good in zip(ids, ok)]
            kept = [x for x, good in zip(ids, ok) if good]
            out.append((np.concatenate([*kept, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([[0], np.cumsum(n)])))
        return out


# --- alignment ----------------------------------------------------------------------


class Aligned:
    """Groups and links of a run of documents, from token ids with row offsets."""

    def __init__(self, pair: Pair, ids_a: np.ndarray, at_a: np.ndarray, ids_b: np.ndarray, at_b: np.ndarray):
        self.ids_a, self.at_a, self.ids_b, self.at_b = ids_a, at_a, ids_b, at_b
        end_a, end_b = np.cumsum(pair.lengths[0][ids_a]), np.cumsum(pair.lengths[1][ids_b])
        size = int(end_a[-1]) if len(end_a) else 0
        self.docs = np.concatenate([[0], end_a])[at_a]  # byte offset of every row
        cut_a, cut_b = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
        cut_a[end_a] = cut_b[end_b] = True
        both = cut_a & cut_b
        links = np.flatnonzero(cut_a | cut_b)  # each stretch between cuts lies in one token of A and one of B
        self.key = ids_a[np.cumsum(cut_a)[links - 1]] << 32 | ids_b[np.cumsum(cut_b)[links - 1]] if size else np.zeros(0, np.int64)
        groups = np.cumsum(both)
        self.n_groups = np.diff(groups[self.docs])
        self.n_links = np.diff(np.searchsorted(links, self.docs, side="right"))
        self.row = np.repeat(np.arange(len(at_a) - 1), self.n_links)
        self.last_a, self.last_b = both[end_a], both[end_b]
        self.group_a, self.group_b = groups[end_a - 1], groups[end_b - 1]

    def spelled(self, names: pa.Array, n_a: int, n_b: int) -> tuple[np.ndarray, memoryview]:
        """(row offsets, bytes) of ``a1,a2|b1;a3|b2`` with a ``;`` after each group."""
        total = int(self.group_a[-1]) + 1 if len(self.group_a) else 0
        before_a = np.concatenate([[0], np.cumsum(np.bincount(self.group_a, minlength=total))])
        before_b = np.concatenate([[0], np.cumsum(np.bincount(self.group_b, minlength=total))])
        codes = np.empty(len(self.ids_a) + len(self.ids_b), np.int64)
        codes[np.arange(len(self.ids_a)) + before_b[self.group_a]] = self.ids_a + np.where(self.last_a, n_a, 0)
        codes[np.arange(len(self.ids_b)) + before_a[self.group_b + 1]] = 2 * n_a + self.ids_b + np.where(self.last_b, n_b, 0)
        at, data = _spelling(names, codes)
        return at[self.at_a + self.at_b], data


@lru_cache(2)
def _names(n_a: int, n_b: int) -> pa.Array:
    """Decimal ids of A with ``,`` and with ``|``, then of B with ``,`` and with ``;``."""
    ways = ((n_a, ","), (n_a, "|"), (n_b, ","), (n_b, ";"))
    return pa.array([f"{i}{end}".encode() for n, end in ways for i in range(n)], pa.binary())


class Tally:
    """Distinct keys and sums, merged whenever the new ones outnumber the old."""

    def __init__(self):
        self.keys, self.sums, self.new, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray, sums: np.ndarray) -> None:
        self.new.append((keys, sums))
        self.size += len(keys)
        if self.size > max(1 << 16, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.new)])
        sums = np.concatenate([self.sums, *(s for _, s in self.new)])
        by = np.argsort(keys, kind="stable")
        keys, sums = keys[by], sums[by]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.sums = keys[first], np.add.reduceat(sums, first) if len(keys) else sums
        self.new, self.size = [], 0


# --- minimal perfect hash -------------------------------------------------------------


def _bit(keys: np.ndarray, level: int, size) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = mix64(keys.view(np.uint64) + np.uint64((level + 1) * STEP & (1 << 64) - 1))
    return (h % size).astype(np.int64)


def build_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(bits per level, 64-bit words of all levels, keys in slot order) of distinct keys."""
    sizes, words, slots, left = [], [], [], keys
    while len(left):
        size = -(-int(len(left) * SPACING) // 64) * 64 or 64
        at = _bit(left, len(sizes), np.uint64(size))
        alone = np.bincount(at, minlength=size) == 1
        stays = alone[at]
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        slots.append(left[stays][np.argsort(at[stays])])
        sizes.append(size)
        left = left[~stays]
        if len(sizes) > 200:
            raise ValueError("keys repeat")
    none = np.zeros(0, np.uint64)
    return sizes, np.concatenate([none, *words]), np.concatenate([np.zeros(0, np.int64), *slots])


class Index:
    """Hashes of one or more shards side by side; slots number on from shard to shard."""

    def __init__(self, sizes: list[list[int]], words: list[np.ndarray], slots: list[np.ndarray]):
        self.depth = max((len(s) for s in sizes), default=0)
        self.sizes = np.zeros((len(sizes), self.depth), np.uint64)
        self.base = np.zeros((len(sizes), self.depth), np.int64)
        at = 0
        for i, s in enumerate(sizes):
            for j, size in enumerate(s):
                self.sizes[i, j], self.base[i, j] = size, at
                at += size
        self.words, self.slots = np.concatenate(words), np.concatenate(slots)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def find(self, keys: np.ndarray, shard: np.ndarray | int = 0) -> np.ndarray:
        """The slot of every key; a key that is not in the index raises."""
        out = np.full(len(keys), -1, np.int64)
        left, shard = np.arange(len(keys)), np.broadcast_to(shard, len(keys))
        for level in range(self.depth):
            s = shard[left]
            size = self.sizes[s, level]
            left, s, size = left[size > 0], s[size > 0], size[size > 0]
            at = self.base[s, level] + _bit(keys[left], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            low = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.ranks[at[hit] >> 6] + np.bitwise_count(low)
            left = left[~hit]
        if len(left) or (self.slots[out] != keys).any():
            raise KeyError("a pair is not in the index")
        return out


# --- jobs -----------------------------------------------------------------------------

_ENCODED = [
    ("uid", LongType()), ("piece", IntegerType()), ("a", BinaryType()), ("b", BinaryType()),
    ("key", LongType()), ("hash", LongType()), ("n", LongType()),
]


def encode(docs: DataFrame, id_col: str, text_col: str, files: tuple) -> DataFrame:
    """Rows (uid, id, a, b) with the token ids of every document, and (piece, key, hash, n) with
    the documents of a task that hold a pair; written once."""
    a, b = files
    slim = docs.select(F.col(id_col).alias("id"), text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, tally = Pair(a.value, b.value), Tally()
        piece = TaskContext.get().partitionId()
        uid = piece << 40

        def emptied() -> pa.RecordBatch:
            tally.merge()
            n = len(tally.keys)
            none = [pa.nulls(n, t) for t in (pa.int64(), kind, pa.binary(), pa.binary())]
            hashed = mix64(tally.keys.view(np.uint64)).view(np.int64)
            out = [none[0], pa.array(np.full(n, piece, np.int32)), *none[1:], *(pa.array(x) for x in (tally.keys, hashed, tally.sums))]
            tally.__init__()
            return pa.RecordBatch.from_arrays([out[0], out[1], *out[2:]], names=names)

        kind, names = None, ["uid", "piece", "id", "a", "b", "key", "hash", "n"]
        for batch in batches:
            ids, texts = batch.columns
            kind = ids.type
            raw, at, _ = utf8(texts)
            for lo, hi in slices(at):
                (ids_a, at_a), (ids_b, at_b) = pair.encode(raw, at, lo, hi)
                one = Aligned(pair, ids_a, at_a, ids_b, at_b)
                keys, local = np.unique(one.key, return_inverse=True)
                held = np.unique(one.row * max(1, len(keys)) + local)
                tally.add(keys, np.bincount(held % max(1, len(keys)), minlength=len(keys)))
                n = hi - lo
                stored = [_packed(x.astype(k), e) for x, e, k in ((ids_a, at_a, pair.kinds[0]), (ids_b, at_b, pair.kinds[1]))]
                gaps = [pa.nulls(n, pa.int64())] * 3
                columns = [pa.array(np.arange(uid, uid + n)), pa.array(np.full(n, piece, np.int32)), ids[lo:hi], *stored, *gaps]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                uid += n
                if len(tally.keys) > TALLY:
                    yield emptied()
        if kind is not None:
            yield emptied()

    fields = [StructField(n, t) for n, t in _ENCODED]
    return materialize(slim.mapInArrow(run, StructType([*fields[:2], slim.schema["id"], *fields[2:]])), "crosstokens")


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value per row out of a flat array."""
    at = pa.py_buffer((ends * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, at, pa.py_buffer(values)])


def _unpacked(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(b.as_py(), kind) for b in column]
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
    return np.concatenate([*parts, np.zeros(0, kind)]).astype(np.int64), at


def _shard(bits: int) -> Column:
    return F.shiftrightunsigned("hash", 64 - bits).cast("int") if bits else F.lit(0)


_SHARD = "shard int, sizes array<int>, words binary, slots binary"


def _index_of(row: dict) -> Index:
    return Index([row["sizes"]], [np.frombuffer(row["words"], np.uint64)], [np.frombuffer(row["slots"], np.int64)])


def _streamed(rows: DataFrame, index: DataFrame, out: str, begin, take, end) -> DataFrame:
    """Stream rows (shard, piece, ...) past the index row of their shard: ``begin(index row)``
    gives a state, ``take(state, columns)`` and ``end(shard, piece, state)`` give result rows."""
    heads = index.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1)))).withColumn("kind", F.lit(0))
    both = heads.unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    both = both.repartition("shard", "piece").sortWithinPartitions("shard", "piece", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = at = None
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            cuts = [*np.flatnonzero(kinds == 0).tolist(), len(kinds)]
            if cuts[0] > 0:
                yield from take(state, batch.slice(0, cuts[0]))
            for i, j in zip(cuts, cuts[1:]):
                if state is not None:
                    yield from end(*at, state)
                row = batch.slice(i, 1).to_pylist()[0]
                at, state = (row["shard"], row["piece"]), begin(row)
                if j > i + 1:
                    yield from take(state, batch.slice(i + 1, j - i - 1))
        if state is not None:
            yield from end(*at, state)

    return both.mapInArrow(run, out)


def count_pairs(pairs: DataFrame) -> tuple[DataFrame, int, int]:
    """(index rows with dense counts, bits of the shard number, distinct pairs)."""
    keys = materialize(pairs.select("key", "hash").distinct(), "crosstokens-keys")
    total = keys.count()
    bits = max(0, (max(total, 1) // SHARD_KEYS).bit_length())

    def build(key, group):
        sizes, words, slots = build_hash(group.column("key").to_numpy())
        return pa.table({"shard": [key[0].as_py()], "sizes": [sizes], "words": [words.tobytes()], "slots": [slots.tobytes()]}, schema=_arrow)

    _arrow = pa.schema([("shard", pa.int32()), ("sizes", pa.list_(pa.int32())), ("words", pa.binary()), ("slots", pa.binary())])
    index = materialize(keys.select(_shard(bits).alias("shard"), "key").groupBy("shard").applyInArrow(build, _SHARD), "crosstokens-index")

    def begin(row):
        found = _index_of(row)
        return found, np.zeros(len(found.slots), np.int64)

    def take(state, batch):
        np.add.at(state[1], state[0].find(batch.column("key").to_numpy()), batch.column("n").to_numpy())
        return ()

    def end(shard, piece, state):
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "counts": [state[1].tobytes()]})

    rows = pairs.select(_shard(bits).alias("shard"), F.pmod("piece", F.lit(PIECES)).alias("piece"), "key", "n")
    dense = _streamed(rows, index, "shard int, counts binary", begin, take, end)

    def added(key, group):
        vectors = [np.frombuffer(b.as_py(), np.int64) for b in group.column("counts")]
        while len(vectors) > 1:
            vectors = [sum(vectors[i : i + 2]) for i in range(0, len(vectors), 2)]
        return pa.table({"shard": [key[0].as_py()], "counts": [vectors[0].tobytes()]}, schema=pa.schema([("shard", pa.int32()), ("counts", pa.binary())]))

    sums = dense.groupBy("shard").applyInArrow(added, "shard int, counts binary")
    return materialize(index.join(sums, "shard"), "crosstokens-counts"), bits, total


def pair_counts(index: DataFrame) -> DataFrame:
    """(a, b, n_docs): every linked pair of ids and the number of documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slots, counts in zip(batch.column("slots"), batch.column("counts")):
                keys, n = np.frombuffer(slots.as_py(), np.int64), np.frombuffer(counts.as_py(), np.int64)
                yield pa.RecordBatch.from_pydict({"a": keys >> 32, "b": keys & 0xFFFFFFFF, "n_docs": n})

    return index.select("slots", "counts").mapInArrow(run, "a long, b long, n_docs long")


def _best(index: DataFrame) -> np.ndarray:
    """Highest count of every id of A; as many rows as A's vocabulary at most."""
    top = pair_counts(index).groupBy("a").agg(F.max("n_docs").alias("n")).toArrow()
    out = np.zeros(max(top.column("a").to_pylist(), default=0) + 1, np.int64)
    out[top.column("a").to_numpy()] = top.column("n").to_numpy()
    return out


_COUNTED = "n_a long, n_b long, n_groups long, n_links long"


def align(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B,
    digest: bool = False, model_bytes: int = MODEL_BYTES,
) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups): one row per row of ``docs``.

    ``groups`` lists token ids as ``a1,a2|b1;a3|b2,b3``; with ``digest`` it is ``groups_sha256``
    instead, the hash of that string ('' for documents without tokens). A link's count is the
    number of documents that hold its pair of ids linked; n_best counts the links whose count
    is the highest of their A id (ties included), count_sum adds counts up. Texts that are
    null or empty, or that a tokenizer does not spell back byte by byte, have no tokens and
    zeros. Every row is a document of its own, under repeated and null ids too. Texts are
    encoded whole, however long. Other columns are ignored, an empty table gives no row.
    """
    spark = docs.sparkSession
    files = asset(spark, tokenizer_a), asset(spark, tokenizer_b)
    coded = encode(docs, id_col, text_col, files)
    index, bits, total = count_pairs(coded.where("n is not null"))
    best = spark.sparkContext.broadcast(_best(index))
    documents = coded.where("n is null").select("uid", "id", "a", "b")
    told = "groups_sha256" if digest else "groups"
    kind = documents.schema["id"]
    known = [(c, LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")] + [(told, StringType())]
    sent = [(c, LongType()) for c in ("n_best", "count_sum")]

    def described(pair: Pair, ids_a, at_a, ids_b, at_b):
        """The alignment of a slice and its own columns."""
        one = Aligned(pair, ids_a, at_a, ids_b, at_b)
        n_a, n_b = len(pair.spelt_a), len(pair.spelt_b)
        at, data = one.spelled(_names(n_a, n_b), n_a, n_b)
        whole = [data[i : max(i, j - 1)] for i, j in zip(at.tolist(), at[1:].tolist())]
        words = [(sha256(w).hexdigest() if digest else bytes(w).decode()) if len(w) else "" for w in whole]
        return one, [np.diff(at_a), np.diff(at_b), one.n_groups, one.n_links, pa.array(words, pa.string())]

    def parts(batch: pa.RecordBatch, pair: Pair):
        """Slices of stored documents, bounded by their bytes."""
        sizes = [len(b) if b is not None else 0 for b in batch.column("a").to_pylist()]
        for lo, hi in slices(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])):
            cut = batch.slice(lo, hi - lo)
            yield cut, described(pair, *_unpacked(cut.column("a"), pair.kinds[0]), *_unpacked(cut.column("b"), pair.kinds[1]))

    if total * 16 + total <= model_bytes:
        rows = sorted(index.toArrow().to_pylist(), key=lambda r: r["shard"])
        place = np.zeros(1 << bits, np.int64)
        place[[r["shard"] for r in rows]] = np.arange(len(rows))
        whole = Index(
            [r["sizes"] for r in rows], [np.frombuffer(r["words"], np.uint64) for r in rows] or [np.zeros(0, np.uint64)],
            [np.frombuffer(r["slots"], np.int64) for r in rows] or [np.zeros(0, np.int64)],
        )
        counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["counts"], np.int64) for r in rows)])
        model = spark.sparkContext.broadcast((place, whole, counts))

        def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair, (place, found, counts), top = Pair(files[0].value, files[1].value), model.value, best.value
            for batch in batches:
                for cut, (one, columns) in parts(batch, pair):
                    keys, local = np.unique(one.key, return_inverse=True)
                    shard = mix64(keys.view(np.uint64)) >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.int64)
                    n = counts[found.find(keys, place[shard.astype(np.int64)])] if len(keys) else np.zeros(0, np.int64)
                    good = n == top[keys >> 32]
                    rows = [np.bincount(one.row[good[local]], minlength=len(cut)), np.zeros(len(cut), np.int64)]
                    np.add.at(rows[1], one.row, n[local])
                    yield pa.RecordBatch.from_arrays([cut.column("id"), *(pa.array(c) for c in (*columns, *rows))], names=["id", *out.names[1:]])

        out = StructType([kind, *[StructField(c, t) for c, t in (*known, *sent)]])
        result = documents.mapInArrow(looked_up, out)
    else:
        names = ["uid", "id", *(c for c, _ in known), "key", "hash", "links"]

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair = Pair(files[0].value, files[1].value)
            for batch in batches:
                for cut, (one, columns) in parts(batch, pair):
                    gaps = [pa.nulls(len(cut), pa.int64())] * 3
                    yield pa.RecordBatch.from_arrays([cut.column("uid"), cut.column("id"), *(pa.array(c) for c in columns), *gaps], names=names)
                    keys, local = np.unique(one.key, return_inverse=True)
                    held, links = np.unique(one.row * max(1, len(keys)) + local, return_counts=True)
                    uid, key = cut.column("uid").to_numpy()[held // max(1, len(keys))], keys[held % max(1, len(keys))]
                    gaps = [pa.nulls(len(held), t) for t in (cut.column("id").type, *[pa.int64()] * 4, pa.string())]
                    asks = [pa.array(x) for x in (key, mix64(key.view(np.uint64)).view(np.int64), links)]
                    yield pa.RecordBatch.from_arrays([pa.array(uid), *gaps, *asks], names=names)

        fields = [StructField(c, t) for c, t in (*known, *[(c, LongType()) for c in ("key", "hash", "links")])]
        second = materialize(documents.mapInArrow(asked, StructType([StructField("uid", LongType()), kind, *fields])), "crosstokens-second")

        def begin(row):
            found, n = _index_of(row), np.frombuffer(row["counts"], np.int64)
            return found, n, n == best.value[found.slots >> 32]

        def take(state, batch):
            found, n, good = state
            at, links = found.find(batch.column("key").to_numpy()), batch.column("links").to_numpy()
            uid, local = np.unique(batch.column("uid").to_numpy(), return_inverse=True)
            sums = [np.zeros(len(uid), np.int64) for _ in range(2)]
            np.add.at(sums[0], local, links * good[at])
            np.add.at(sums[1], local, links * n[at])
            yield pa.RecordBatch.from_pydict({"uid": uid, "n_best": sums[0], "count_sum": sums[1]})

        asks = second.where("key is not null").select(
            _shard(bits).alias("shard"), F.pmod("uid", F.lit(PIECES)).cast("int").alias("piece"), "uid", "key", "links"
        )
        answers = _streamed(asks, index, "uid long, n_best long, count_sum long", begin, take, lambda *_: ())
        sums = answers.groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
        result = second.where("key is null").join(sums, "uid", "left").select("id", *[c for c, _ in known], *filled)
    return result.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", told)
