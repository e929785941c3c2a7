"""License notices: exact phrases, and short notices with a bounded number of edits.

A notice of m characters may differ by up to ``edits`` insertions, deletions or
substitutions. Split into edits + 1 pieces, at least one piece must stand in the text
unchanged, so an Aho-Corasick automaton over all pieces of all notices finds every
candidate in one pass. Around a candidate, one bit-parallel pass gives the least edit
distance of the notice to any stretch of the window; where that is within the bound, the
regex library matches the whole notice with as many edits and gives the span. What stands
in front of a match and behind it is searched in the same way.
"""

from __future__ import annotations

import bisect
import itertools
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from fieldloom.llm.common import text, utf8, with_result

PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
"""Exact phrases (words that stand consecutively) and their labels."""

NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2.0"),
    ("under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("all rights reserved", "all-rights-reserved"),
)
"""Short notices, as lower-case words, and their labels."""

EDIT_SHARE = 0.1
"""Edits allowed per character of a notice, rounded down."""
_NOT_WORD = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

MATCH = StructType(
    [
        StructField("label", StringType()),
        StructField("notice", IntegerType()),
        StructField("first_word", LongType()),
        StructField("last_word", LongType()),
        StructField("edits", IntegerType()),
        StructField("similarity", DoubleType()),
    ]
)
RESULT = StructType(
    [StructField(c, LongType()) for c in ("n_words", "n_base", "first_word", "last_word")]
    + [StructField("base_labels", ArrayType(StringType())), StructField("labels", ArrayType(StringType()))]
    + [StructField("score", DoubleType()), StructField("matches", ArrayType(MATCH))]
)


@dataclass
class Searcher:
    """The automaton over all pieces and one bounded-error pattern per notice."""

    automaton: ahocorasick.Automaton
    edits: list[int]


@lru_cache(1024)
def _pattern(notice: str, edits: int) -> regex.Pattern:
    return regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={edits}}}")


@lru_cache(256)
def _positions(notice: str) -> dict[str, int]:
    """Bit i of a character: whether it is the notice's i-th."""
    out: dict[str, int] = {}
    for i, c in enumerate(notice):
        out[c] = out.get(c, 0) | 1 << i
    return out


def least_edits(notice: str, words: str, lo: int, hi: int) -> int:
    """Least edit distance between the notice and any stretch of words[lo:hi]: columns of the
    distance table as bit vectors of its steps down (+1 in ``up``, -1 in ``down``)."""
    where, m = _positions(notice), len(notice)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, now = full, 0, m
    best = m
    for c in words[lo:hi]:
        same = where.get(c, 0)
        flat = (((same & up) + up) ^ up) | same | down
        rise, fall = down | full & ~(flat | up), up & flat
        now += bool(rise & top) - bool(fall & top)
        rise, fall = rise << 1 & full, fall << 1 & full
        up, down = fall | full & ~((same | down) | rise), rise & (same | down)
        best = min(best, now)
    return best


def seeds(notice: str, share: float) -> list[tuple[int, int]]:
    """Spans of edits + 1 pieces of nearly equal length, wherever they fall in words: a text
    within the edits holds one of them unchanged."""
    k = int(len(notice) * share) + 1
    return [(i * len(notice) // k, (i + 1) * len(notice) // k) for i in range(k)]


@lru_cache(4)
def searcher(notices: tuple[tuple[str, str], ...], share: float) -> Searcher:
    pieces: dict[str, list[tuple[int, int]]] = {}
    edits = []
    for i, (words, _) in enumerate(notices):
        spans = seeds(words, share)
        for a, b in spans:
            pieces.setdefault(words[a:b], []).append((i, a))
        edits.append(len(spans) - 1)
    automaton = ahocorasick.Automaton()
    for piece, where in pieces.items():
        automaton.add_word(piece, (len(piece), where))
    automaton.make_automaton()
    return Searcher(automaton, edits)


def normalise(data: bytes) -> str:
    """Lower-case words joined by single blanks; byte-wise, since every other code point
    is made of bytes from 0x80 on."""
    return b" ".join(data.lower().translate(_NOT_WORD).split()).decode()


def places(words: str, phrases=PHRASES) -> list[tuple[int, str]]:
    """(start word, label) wherever a phrase's words stand consecutively."""
    padded, found = f" {words} ", []
    for phrase, label in phrases:
        needle, at, word = f" {phrase} ", 0, 0
        while (hit := padded.find(needle, at)) >= 0:
            word += padded.count(" ", at, hit)
            found.append((word, label))
            at, word = hit + 1, word + 1
    return found


def fuzzy(words: str, notices=NOTICES, share: float = EDIT_SHARE) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, edits) of the best matches, character spans in ``words``.

    Windows of overlapping candidates of a notice are merged before they are verified,
    and every match in a window is reported, so nothing depends on which piece hit.
    """
    s = searcher(notices, share)
    windows: dict[int, list[list[int]]] = {}
    for end, (size, where) in s.automaton.iter(words):
        for i, offset in where:
            k = s.edits[i]
            lo = max(0, end + 1 - size - offset - k)
            hi = min(len(words), end + 1 - size - offset + len(notices[i][0]) + k)
            own = windows.setdefault(i, [])
            # by end of the hit, so starts may go back a little
            while own and own[-1][1] >= lo:
                last = own.pop()
                lo, hi = min(lo, last[0]), max(hi, last[1])
            own.append([lo, hi])
    found = []
    for i, own in windows.items():
        notice = notices[i][0]
        while own:
            lo, hi = own.pop()
            if hi - lo < len(notice) - s.edits[i] or (least := least_edits(notice, words, lo, hi)) > s.edits[i]:
                continue
            m = _pattern(notice, least).search(words, lo, hi)
            found.append((i, m.start(), m.end(), sum(m.fuzzy_counts)))
            own += ([lo, m.start()], [max(m.end(), m.start() + 1), hi])
    return best_readings(found)


def best_readings(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Without matches that overlap one with fewer edits (version 3 read as version 2)."""
    kept: list[tuple[int, int, int, int]] = []
    for edits in sorted({m[3] for m in found}):
        spans = sorted((a, b) for _, a, b, _ in kept)
        starts = [a for a, _ in spans]
        reach = list(itertools.accumulate((b for _, b in spans), max))

        def free(a: int, b: int) -> bool:
            i = bisect.bisect_left(starts, b)  # kept spans that begin before b
            return i == 0 or reach[i - 1] <= a

        kept += [m for m in found if m[3] == edits and free(m[1], m[2])]
    return kept


def _row(data: bytes) -> dict:
    words = normalise(data)
    base = places(words)
    matches = []
    at = first = 0
    for i, a, b, e in sorted(fuzzy(words), key=lambda m: m[1]):
        first, at = first + words.count(" ", at, a), a
        if words[a] == " ":  # the match begins with the blank before its first word
            first, at, a = first + 1, a + 1, a + 1
        matches.append(
            {
                "label": NOTICES[i][1],
                "notice": i,
                "first_word": first,
                "last_word": first + words[a:b].rstrip().count(" "),
                "edits": e,
                "similarity": 1.0 - e / len(NOTICES[i][0]),
            }
        )
    base_labels = sorted({label for _, label in base})
    return {
        "n_words": words.count(" ") + 1 if words else 0,
        "n_base": len(base),
        "first_word": min((w for w, _ in base), default=None),
        "last_word": max((w for w, _ in base), default=None),
        "base_labels": base_labels,
        "labels": sorted({*base_labels, *(m["label"] for m in matches)}),
        "score": 1.0 if base else max((m["similarity"] for m in matches), default=0.0),
        "matches": sorted(matches, key=lambda m: (m["first_word"], m["notice"])),
    }


_ARROW = pa.struct(
    [(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")]
    + [("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64())]
    + [
        (
            "matches",
            pa.list_(
                pa.struct(
                    [("label", pa.string()), ("notice", pa.int32()), ("first_word", pa.int64()),
                     ("last_word", pa.int64()), ("edits", pa.int32()), ("similarity", pa.float64())]
                )
            ),
        )
    ]
)


@F.arrow_udf(RESULT)
def _scan(texts: pa.Array) -> pa.Array:
    raw, at, _ = utf8(texts)
    return pa.array([_row(raw[at[i] : at[i + 1]].tobytes()) for i in range(len(texts))], _ARROW)


def scan_column(col: str | Column = "text") -> Column:
    return _scan(text(col))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, matches).

    One row per row of ``docs``. Base figures count the exact PHRASES; ``labels`` adds those
    of notices found within their edit bound, whose word spans are in ``matches``. The score
    is 1 if a phrase stands in the text, else the best similarity of a notice, else 0. A null
    or wordless text has no words and no labels; ids may be null or repeat.
    """
    got, name = with_result(docs.select(id_col, text_col), scan_column(text_col), "licenses")
    return got.select(id_col, f"{name}.*")
