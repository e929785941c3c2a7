"""Importance resampling against a plain version; the sort against Python's."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from helpers import LONG, ODD, documents, lower

from fieldloom.llm import resampling as rs
from fieldloom.llm.common import utf8


def features(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    return w, [*w, *map(" ".join, zip(w, w[1:]))]


def plain(rows, target, percent=25, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x in rows], target))
    big_s, big_t = s.total(), t.total()
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (big_s + 10_000) / ((s[k] + 1) * (big_t + 10_000))))
    out = []
    for i, x in rows:
        w, fs = features(x)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append([i, len(fs), weight, score, None, len(w) >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for n, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = n + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def run(spark, rows, target, **args):
    got = rs.resample(documents(spark, rows), spark.createDataFrame([(x,) for x in target], "text string"), **args)
    return sorted(map(tuple, got.collect()), key=repr)


def test_draw_matches_plain_version(spark, monkeypatch):
    rng = random.Random(5)
    words = [*"abcdefgh", "naïve", "日本語", "x" * 70, "İ", "ÀB", "K2"]
    rows = [(rng.randrange(-(10**9), 10**9), " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for _ in range(200)]
    rows += [(i, "the same text again and again " * 5) for i in range(30)]
    target = ["a b a b naïve", "x" * 70 + " 日本語", None, ""]
    monkeypatch.setattr(rs, "LEAST_BLOCK", 16)
    assert run(spark, rows, target) == plain(rows, target)
    assert run(spark, rows, [], percent=100, min_words=0) == plain(rows, [], 100, 0)


def test_odd_rows(spark):
    rows = [*ODD, (8, LONG), (-(1 << 63), LONG), ((1 << 63) - 1, LONG), (None, LONG)]
    assert run(spark, rows, ["a b"], percent=100) == plain(rows, ["a b"], 100)
    assert run(spark, [], ["a b"]) == [] and run(spark, ODD[:3], []) == plain(ODD[:3], [])
    with pytest.raises(TypeError):
        rs.resample(documents(spark, ODD), documents(spark, ODD), id_col="text")


@pytest.mark.parametrize("slice_rows", [1, 3, 100])
def test_features_are_hashed_like_zlib(slice_rows):
    texts = ["One two THREE", None, "", "...", "a", "a" * 64, "b" * 65 + " c " + "d" * 200, "e" * 130 + "-" + "f" * 66, "é日本 İ9_z", "x y"]
    raw, at, _ = utf8(pa.array(texts))
    for lo in range(0, len(texts), slice_rows):
        hi = min(len(texts), lo + slice_rows)
        words, one, pairs, two = rs.features(raw, at, lo, hi, 1 << 30)
        for i in range(lo, hi):
            w, f = features(texts[i])
            got = [*one[words[i - lo] : words[i - lo + 1]], *two[pairs[i - lo] : pairs[i - lo + 1]]]
            assert got == [zlib.crc32(x.encode()) % (1 << 30) for x in f]


@pytest.mark.parametrize("bits,block", [(1, 4), (3, 7), (12, 1 << 20)])
def test_radix_ranks_are_stable(spark, bits, block):
    rng = random.Random(bits)
    rows = [(i // 40 << 40 | i, rng.choice([None, *range(-3, 4)]), rng.randrange(5)) for i in range(150)]
    df = spark.createDataFrame(rows, "uid long, a long, b long").repartition(4)
    ranks, n = rs.radix_ranks(df, [("b", False), ("a", True)], bits, block)
    want = sorted(rows, key=lambda r: (-r[2], r[1] is None, r[1] or 0, r[0]))
    assert n == 150 and {r.uid: r["rank"] for r in ranks.collect()} == {r[0]: i + 1 for i, r in enumerate(want)}
    assert np.array(want).shape == (150, 3)
