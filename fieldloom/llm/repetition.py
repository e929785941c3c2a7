"""Quality rules by repetition coverage: characters inside duplicated n-grams and lines.

Words get 64-bit polynomial hashes from prefix sums over the bytes, n-grams rolling
hashes from prefix sums over the words; both are plain numpy over many rows at once.
A window is repeated if its hash occurs twice or more in the same text, and every
word inside a repeated window is covered once, however many windows overlap there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from fieldloom.llm.common import mix64, slices, span_hashes, text, utf8, with_result, word_spans

BASE_WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
COVERAGE = {5: 0.50, 10: 0.40, 20: 0.30}
"""Share of a text's word characters inside repeated n-grams (first ones included) above
which the text is rejected, by n. A long window repeats by chance less often."""
LINE_CHARS = 0.30
"""Share of a text's characters in lines equal to an earlier line above which it is rejected."""

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BYTE = mix64(np.arange(1, 257))

RESULT = StructType(
    [StructField(c, LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [StructField("line_coverage", DoubleType())]
    + [StructField(f"coverage_{n}", DoubleType()) for n in COVERAGE]
    + [StructField("base_failed", BooleanType()), StructField("kept", BooleanType())]
)


def covered_words(words: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Which words stand in an n-gram that occurs twice or more in their row."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(len(words), bool)
    inside = np.flatnonzero(row[:count] == row[n - 1 :])
    keys = span_hashes(words, inside, inside + n) ^ mix64(row[inside].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    hit = np.zeros(len(keys), bool)
    hit[order[1:]] |= same
    hit[order[:-1]] |= same
    open_close = np.zeros(len(words) + 1, np.int32)
    open_close[inside[hit]] += 1
    open_close[inside[hit] + n] -= 1
    return np.cumsum(open_close[:-1]) > 0


def _lines(data: bytes) -> tuple[int, int]:
    """(lines with a word that equal an earlier line, their code points)."""
    seen: set[bytes] = set()
    lines = chars = 0
    for line in data.split(b"\n"):
        if line in seen:
            lines += 1
            chars += len(line.decode())
        elif line and not line.isspace():  # bytes.isspace knows exactly the six separators
            seen.add(line)
    return lines, chars


def measure(raw: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of consecutive rows of UTF-8 text; ``at`` are their byte offsets."""
    b = raw[at[0] : at[-1]]
    at = at - at[0]
    n = len(at) - 1
    starts, ends, row = word_spans(b, at)
    char = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    size = char[ends] - char[starts]
    symbol = np.concatenate([[0], np.cumsum(_SYMBOL[b])])

    def per_row(weights: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=weights, minlength=n)[:n]

    out = {
        "n_words": np.bincount(row, minlength=n)[:n],
        "word_chars": per_row(size).astype(np.int64),
        "n_symbols": symbol[at[1:]] - symbol[at[:-1]],
    }
    words = span_hashes(_Hashed(b), starts, ends)
    lines = np.array([_lines(b[at[i] : at[i + 1]].tobytes()) for i in range(n)], np.int64).reshape(n, 2)
    out["n_dup_lines"] = lines[:, 0]
    out["n_repeat_words"] = per_row(covered_words(words, row, BASE_WINDOW)).astype(np.int64)
    chars = char[at[1:]] - char[at[:-1]]
    out["line_coverage"] = lines[:, 1] / np.maximum(chars, 1)
    for g in COVERAGE:
        out[f"coverage_{g}"] = per_row(covered_words(words, row, g) * size) / np.maximum(out["word_chars"], 1)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (
        100 * out["n_repeat_words"] > REPEAT_PERCENT * out["n_words"]
    )
    bad = out["base_failed"] | (out["line_coverage"] > LINE_CHARS)
    for g, most in COVERAGE.items():
        bad = bad | (out[f"coverage_{g}"] > most)
    out["kept"] = ~bad
    return out


class _Hashed:
    """Bytes seen through the table of byte hashes, one chunk at a time."""

    def __init__(self, b: np.ndarray):
        self.b = b

    def __getitem__(self, part: slice) -> np.ndarray:
        return _BYTE[self.b[part]]


@F.arrow_udf(RESULT)
def _measures(texts: pa.Array) -> pa.Array:
    raw, at, _ = utf8(texts)
    parts = [measure(raw, at[lo : hi + 1]) for lo, hi in slices(at)] or [measure(raw, at[:1])]
    columns = [pa.array(np.concatenate([p[f.name] for p in parts])) for f in RESULT]
    return pa.StructArray.from_arrays(columns, names=RESULT.names)


def measures(col: str | Column = "text") -> Column:
    """Struct of all measures and the verdict ``kept`` of a text column.

    Null is a text without words; a text of fewer than MIN_WORDS words (so also a
    null, empty or blank one) is rejected. Rows are independent: repeated rows and
    other columns change nothing.
    """
    return _measures(text(col))


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, all measures, kept): one row per row of ``docs``, null ids included."""
    got, name = with_result(docs.select(id_col, text_col), measures(text_col), "quality")
    return got.select(id_col, f"{name}.*")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text passes."""
    got, name = with_result(docs, measures(text_col)["kept"], "quality")
    return got.where(F.col(name)).drop(name)
