"""Language identification by interpolated Kneser-Ney character models.

Texts are reduced to lower-case letters and single blanks. A gram of up to ORDER = 4
characters packs into 64 bits (16 bits a character; characters beyond the basic
plane share one code), so counting is a sort of integers. Every task counts the
4-grams of its training rows per language, Spark sums them, and all lower orders
follow from the distinct 4-grams, since Kneser-Ney uses continuation counts there.

The model of a language is, per order, a sorted array of mixed 64-bit keys with the
interpolated log probability of each gram, and one of contexts with their back-off
weight. A text gets the language of the lowest cross-entropy per character. It is
accepted if that lies near what the training documents of the language reach under its
model, each scored without the grams that it alone brings: within DEVIATIONS standard
deviations of them, or half-way to the nearest other language but at most ROOM. How
far away further languages are does not matter. Short texts have a margin on top.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from fieldloom.llm.common import codepoints, free_name, mix64, slices, text, utf8, with_result
from fieldloom.session import materialize

ORDER = 4
ALPHABET = 1 << 16
"""Characters that the order below single ones spreads its mass over, seen or not."""
MAX_LANGUAGES = 256
"""Languages a model may hold; more are an error, not cut."""
MARGIN = 3.0
"""Standard errors that a short text may lie above the rejection threshold."""
DEVIATIONS = 4.0
"""Standard deviations between training documents that a text may lie above their mean."""
ROOM = 1.0
"""Nats per character above the mean that count as the language, whatever its documents' deviation,
unless another language is nearer than twice that."""
SHARPNESS = 8.0
"""Nats of cross-entropy per character to the exponent of the score."""

UND = "und"
OTHER = 0xFFFF
BLANK = 32
SLICE = 1 << 18
"""Bytes of text that one numpy step holds here: a character takes up to some hundred bytes on its way."""
FLUSH = 1 << 20
"""Grams a counting task holds before it hands them on."""

RESULT = StructType(
    [
        StructField("lang_pred", StringType()),
        StructField("score", DoubleType()),
        StructField("cross_entropy", DoubleType()),
        StructField("n_letters", LongType()),
        StructField("accepted", BooleanType()),
    ]
)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code of every basic-plane character: its lower-case letter, or a blank."""
    table = np.full(1 << 16, BLANK, np.uint16)
    for c in range(1 << 16):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
    return table


def normalise(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, row offsets, letters per row): letters and single blanks, every row
    led in by ORDER - 1 blanks and closed by one."""
    rows = len(starts) - 1
    codes = _letters()[np.minimum(points, OTHER)]
    far = points > OTHER
    if far.any():  # letters of other planes share a code
        codes[far] = [OTHER if chr(c).isalpha() else BLANK for c in points[far]]
    blank = codes == BLANK
    first = np.zeros(len(codes) + 1, bool)
    first[starts] = True
    keep = ~(blank & (np.concatenate([[True], blank[:-1]]) | first[:-1]))
    row = np.repeat(np.arange(rows), np.diff(starts))[keep]
    codes = codes[keep]
    kept = np.bincount(row, minlength=rows)
    letters = np.bincount(row[codes != BLANK], minlength=rows)
    at = np.concatenate([[0], np.cumsum(kept + ORDER)])
    out = np.full(at[-1], BLANK, np.uint16)
    out[np.arange(len(codes)) + row * ORDER + ORDER - 1] = codes
    return out, at, letters


def grams(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed 4-grams, row offsets) of what ``normalise`` gave."""
    c = codes.astype(np.uint64)
    n = max(0, len(c) - ORDER + 1)
    keys = np.zeros(n, np.uint64)
    for k in range(ORDER):
        keys = (keys << np.uint64(16)) | c[k : k + n]
    inside = np.ones(n, bool)
    for k in range(1, ORDER):  # windows that run over the end of a row
        ends = at[1:-1] - k
        inside[ends[ends < n]] = False
    return keys[inside], np.concatenate([[0], np.cumsum(np.maximum(np.diff(at) - ORDER + 1, 0))])


def _count(batches):
    """Arrow batches (lang, text) to (lang, gram, n), summed within the task."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def emit(langs):
        for lang in langs:
            keys, n = held.pop(lang)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]).take(pa.array(np.zeros(len(keys), np.int32))), pa.array(keys.view(np.int64)), pa.array(n)],
                names=["lang", "gram", "n"],
            )

    for batch in batches:
        langs = np.asarray(batch.column(0).to_pylist(), object)
        raw, at, _ = utf8(batch.column(1))
        for lo, hi in slices(at, SLICE):
            keys, ends = grams(*normalise(*codepoints(raw, at, lo, hi))[:2])
            for lang in set(langs[lo:hi]):
                mine = np.repeat(langs[lo:hi] == lang, np.diff(ends))
                got, n = np.unique(keys[mine], return_counts=True)
                if lang in held:
                    both = np.concatenate([held[lang][0], got])
                    got, where = np.unique(both, return_inverse=True)
                    n = np.bincount(where, weights=np.concatenate([held[lang][1], n])).astype(np.int64)
                held[lang] = (got, n.astype(np.int64))
            if sum(len(k) for k, _ in held.values()) > FLUSH:
                yield from emit(list(held))
    yield from emit(list(held))


@dataclass
class Model:
    """Sorted arrays per language and order, and the thresholds."""

    langs: list[str]
    tables: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]
    floor: np.ndarray  # log probability of a character never seen, per language
    near: np.ndarray  # smallest cross-entropy of another language's texts; infinite if there is none
    limit: np.ndarray  # cross-entropy that still counts as the language
    spread: np.ndarray  # standard deviation of a character's log probability


def _hash(keys: np.ndarray, order: int) -> np.ndarray:
    return mix64(keys ^ np.uint64(order * 0x9E3779B97F4A7C15 % 2**64))


def _discount(n: np.ndarray) -> float:
    ones, twos = int((n == 1).sum()), int((n == 2).sum())
    return ones / (ones + 2 * twos) if ones and twos else 0.75


def fit_language(keys: np.ndarray, counts: np.ndarray):
    """Kneser-Ney tables of one language from its distinct 4-grams; (tables by order, floor)."""
    levels, grams_, n = [], keys, counts.astype(np.float64)
    for order in range(ORDER, 0, -1):
        levels.append((order, grams_, n))
        shorter = grams_ & np.uint64((1 << 16 * (order - 1)) - 1)  # without the first character
        grams_, n = np.unique(shorter, return_counts=True)  # continuation counts
        n = n.astype(np.float64)
    lower_keys, lower_p = None, None
    tables = []
    for order, g, n in reversed(levels):
        d = _discount(n)
        context, where, kinds = np.unique(g >> np.uint64(16), return_inverse=True, return_counts=True)
        total = np.bincount(where, weights=n)
        back = d * kinds / total
        p = np.maximum(n - d, 0) / total[where]
        if order == 1:
            p = p + back[where] / ALPHABET
            floor = math.log(back[0] / ALPHABET)
        else:
            shorter = g & np.uint64((1 << 16 * (order - 1)) - 1)
            p = p + back[where] * lower_p[np.searchsorted(lower_keys, shorter)]
        lower_keys, lower_p = g, p
        hg, hc = _hash(g, order), _hash(context, order)
        a, b = np.argsort(hg), np.argsort(hc)
        tables.append((hg[a], np.log(p)[a], hc[b], np.log(back)[b]))
    return tables, floor


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def log_probabilities(tables, floor: float, keys: np.ndarray, unseen: bool = False) -> np.ndarray:
    """Log probability of each 4-gram's last character after the three before it; with
    ``unseen`` as if none of the 4-grams themselves stood in the tables."""
    out = np.zeros(len(keys))
    open_ = np.arange(len(keys))
    for order in range(ORDER, 0, -1):
        hg, lp, hc, back = tables[order - 1]
        g = keys[open_] & np.uint64((1 << 16 * order) - 1)
        at, hit = _find(hg, _hash(g, order))
        if unseen and order == ORDER:
            hit = np.zeros(len(g), bool)
        out[open_[hit]] += lp[at[hit]]
        open_, g = open_[~hit], g[~hit]
        if not len(open_):
            return out
        if order == 1:
            out[open_] += floor
        else:
            at, seen = _find(hc, _hash(g >> np.uint64(16), order))
            out[open_[seen]] += back[at[seen]]
    return out


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model from per-language 4-gram counts."""
    langs = sorted(counts)
    fitted = [fit_language(*counts[lang]) for lang in langs]
    cross = np.empty((len(langs), len(langs)))  # text language, model language
    spread = np.empty(len(langs))
    for i, lang in enumerate(langs):
        keys, n = counts[lang]
        share = n / n.sum()
        for j, (tables, floor) in enumerate(fitted):
            lp = log_probabilities(tables, floor, keys)
            cross[i, j] = -(share * lp).sum()
            if i == j:
                spread[j] = math.sqrt(max((share * lp * lp).sum() - cross[i, i] ** 2, 0.0))
    near = np.array([np.delete(cross[:, j], j).min(initial=np.inf) for j in range(len(langs))])
    limit = cross.diagonal() + np.minimum(ROOM, (near - cross.diagonal()) / 2)  # until calibrated
    return Model(langs, [t for t, _ in fitted], np.array([f for _, f in fitted]), near, limit, spread)


def own_scores(model: Model, counts: dict[str, tuple[np.ndarray, np.ndarray]], batches):
    """Arrow batches (lang, text) to (lang, m, s, q): characters, and the sums over them of the
    document's cross-entropy under its own language and of its square. A 4-gram that only
    this document brought to the counts is scored as one that the model has not seen."""
    for batch in batches:
        langs = np.asarray(batch.column(0).to_pylist(), object)
        raw, at, _ = utf8(batch.column(1))
        for lo, hi in slices(at, SLICE):
            codes, offsets, letters = normalise(*codepoints(raw, at, lo, hi))
            keys, ends = grams(codes, offsets)
            n = np.diff(ends)
            row = np.repeat(np.arange(hi - lo), n)
            for lang in set(langs[lo:hi]):
                j = model.langs.index(lang)
                mine = (langs[lo:hi] == lang) & (letters > 0)
                inside = mine[row]
                if not inside.any():
                    continue
                distinct, where = np.unique(keys[inside], return_inverse=True)
                held, total = counts[lang]
                at_, hit = _find(held, distinct)
                total = np.where(hit, total[at_], 0)
                pair, times = np.unique(row[inside] * len(distinct) + where, return_counts=True)
                doc, gram = pair // len(distinct), pair % len(distinct)
                tables, floor = model.tables[j], model.floor[j]
                lp = np.where(
                    total[gram] > times,
                    log_probabilities(tables, floor, distinct)[gram],
                    log_probabilities(tables, floor, distinct, unseen=True)[gram],
                )
                sums = -np.bincount(doc, weights=times * lp, minlength=hi - lo)[mine]
                m = n[mine].astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.array([m.sum()]), pa.array([sums.sum()]), pa.array([(sums * sums / m).sum()])],
                    names=["lang", "m", "s", "q"],
                )


def calibrate(rows: DataFrame, model: Model, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model with limits from what its training rows (lang, text) score."""
    held = rows.sparkSession.sparkContext.broadcast((model, counts))
    scored = rows.mapInArrow(lambda batches: own_scores(*held.value, batches), "lang string, m double, s double, q double")
    for r in scored.groupBy("lang").agg(F.sum("m").alias("m"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect():
        j = model.langs.index(r["lang"])
        own = r["s"] / r["m"]
        deviation = math.sqrt(max(r["q"] / r["m"] - own * own, 0.0))
        model.limit[j] = own + max(DEVIATIONS * deviation, min(ROOM, (model.near[j] - own) / 2))
    held.unpersist()
    return model


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_grams: int | None = None) -> Model | None:
    """Model of the languages named in ``docs``; None if no row has both text and language.

    All rows and whole texts are counted, and the model keeps every gram. It is gathered
    in the driver and sent to all executors, so it must fit them. Only where ``max_grams``
    is given are a larger language's least frequent grams left out; the count that they
    need is taken from a histogram, so ties at the border go together.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), text(text_col).alias("text"))
    rows = rows.where("lang is not null and text is not null")
    counted = rows.mapInArrow(_count, "lang string, gram long, n long")
    sums = materialize(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "langid-grams")
    sizes = {r["lang"]: r["grams"] for r in sums.groupBy("lang").agg(F.count(F.lit(1)).alias("grams")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return None
    kept = F.lit(False)
    for lang, n in sizes.items():
        least = 1 if max_grams is None or n <= max_grams else _least_count(sums.where(F.col("lang") == lang), max_grams)
        kept = kept | ((F.col("lang") == lang) & (F.col("n") >= least))
    model = sums.where(kept).toArrow().combine_chunks()
    names = np.asarray(model["lang"].to_pylist(), object)
    grams_ = model["gram"].to_numpy().view(np.uint64)
    n = model["n"].to_numpy()
    counts = {}
    for lang in sizes:
        mine = names == lang
        order = np.argsort(grams_[mine])
        if mine.any():
            counts[lang] = (grams_[mine][order], n[mine][order])
    return calibrate(rows.where(F.col("lang").isin(*counts)), build(counts), counts)


def _least_count(sums: DataFrame, most: int) -> int:
    """Smallest count such that at most ``most`` grams have it or more (powers of two and between)."""
    width = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    held, steps = 0, sums.groupBy(width.alias("w")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n"))
    least = None
    for r in sorted(steps.collect(), key=lambda r: -r["w"]):
        held += r["k"]
        if held > most:
            break
        least = r["n"]
    return least if least is not None else 1 << 62


def score_rows(model: Model, raw: np.ndarray, at: np.ndarray, valid: np.ndarray) -> pa.StructArray:
    """Predictions of consecutive rows of UTF-8 text."""
    rows, k = len(at) - 1, len(model.langs)
    entropy = np.full((rows, k), np.inf)
    letters = np.zeros(rows, np.int64)
    length = np.ones(rows)
    for lo, hi in slices(at, SLICE):
        codes, offsets, letters[lo:hi] = normalise(*codepoints(raw, at, lo, hi))
        keys, ends = grams(codes, offsets)
        distinct = np.unique(keys)
        where = np.searchsorted(distinct, keys)
        n = np.diff(ends)
        length[lo:hi] = np.maximum(n, 1)
        for j in range(k):
            lp = log_probabilities(model.tables[j], model.floor[j], distinct)
            total = np.concatenate([[0.0], np.cumsum(lp[where])])
            entropy[lo:hi, j] = -(total[ends[1:]] - total[ends[:-1]]) / length[lo:hi]
    best = entropy.argmin(axis=1)
    least = entropy[np.arange(rows), best]
    known = valid & (letters > 0)
    least = np.where(known, least, 0.0)
    rest = np.exp(-SHARPNESS * np.minimum(np.where(known[:, None], entropy - least[:, None], 0.0), 80.0)).sum(axis=1)
    accepted = known & (least <= model.limit[best] + MARGIN * model.spread[best] / np.sqrt(length))
    names = np.asarray(model.langs + [UND], object)[np.where(known, best, k)]
    return pa.StructArray.from_arrays(
        [
            pa.array(names, pa.string()),
            pa.array(np.where(known, 1.0 / rest, 0.0)),
            pa.array(np.where(known, least, np.nan), mask=~known),
            pa.array(letters),
            pa.array(accepted),
        ],
        names=RESULT.names,
    )


def predictor(docs: DataFrame, model: Model | None):
    """Function from a text column to a struct (lang_pred, score, cross_entropy, n_letters, accepted).

    Null texts and texts without a letter give ``und``, score 0, not accepted; so does
    every text if there is no model. Ties go to the language first in the alphabet.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def predict(texts: pa.Array) -> pa.Array:
        raw, at, valid = utf8(texts)
        if held.value is None or not len(texts):
            n = len(texts)
            return pa.array([{"lang_pred": UND, "score": 0.0, "cross_entropy": None, "n_letters": 0, "accepted": False}] * n, pa.struct(
                [("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("n_letters", pa.int64()), ("accepted", pa.bool_())]))
        return score_rows(held.value, raw, at, valid)

    return lambda col: predict(text(col))


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Whether the row's id falls into the fold that is never learned from; a null id does not."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score, ...): one row per row of ``docs``, learned from
    the rows outside the held-out fold that name a language; a null id is outside of it."""
    model = train(docs.where(~held_out(id_col)), lang_col, text_col)
    got, name = with_result(docs.select(id_col, text_col), predictor(docs, model)(text_col), "language")
    return got.select(id_col, held_out(id_col).alias("held_out"), f"{name}.*")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is accepted."""
    model = train(docs.where(~held_out(id_col)), lang_col, text_col)
    name = free_name(docs, "language")
    got = docs.withColumn(name, predictor(docs, model)(text_col)["accepted"])
    return got.where(F.col(name)).drop(name)
