"""Line dedup against a plain version, whatever the ranges and batches."""

import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest
from helpers import LONG, ODD, documents, lower

from fieldloom.llm import lines


def key(line):
    return lower(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))


def plain(rows, least=lines.MIN_POINTS, common=lines.MIN_DOCS):
    order = lambda i: (i is not None, i)
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(order(i))
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        gone = [len(held[key(p)]) >= common and max(held[key(p)]) != order(i) for p in parts]
        kept = "\n".join(p for p, g in zip(parts, gone) if not g)
        out.append((i, len(parts), sum(gone), kept))
    return out


def run(spark, rows, **args):
    docs = documents(spark, rows)
    got = lines.apply(docs, lines.bitmaps(docs, **args))
    assert set(docs.columns) <= set(got.columns)
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()), key=repr)


def made(n, seed):
    rng = random.Random(seed)
    pool = [f"Line number {i} that many documents share" for i in range(12)] + ["short"] * 3 + ["  ", ""]
    dress = [str, str.upper, lambda s: f"\t{s} \r", lambda s: s + " "]
    return [(rng.randrange(n), "\n".join(rng.choice(dress)(rng.choice(pool)) for _ in range(rng.randrange(9)))) for _ in range(n)]


@pytest.mark.parametrize("shuffle,batch", [("4", "10000"), ("37", "3"), ("1", "1")])
def test_lines_match_plain_version(spark, shuffle, batch):
    hot = [(1000 + i, "the one line that is everywhere\n" * (1 + i % 3)) for i in range(120)]
    rows = [*made(150, 3), *hot, (None, "the one line that is everywhere"), (5, "twice is not common enough"), (6, "TWICE is not common enough ")]
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for k, v in zip(old, (shuffle, batch)):
            spark.conf.set(k, v)
        assert run(spark, rows) == sorted(plain(rows), key=repr)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_odd_rows(spark):
    rows = [*ODD, (8, LONG), (9, LONG), (9, "\n\n"), (None, LONG)]
    assert run(spark, rows) == sorted(plain(rows), key=repr)
    assert run(spark, rows, min_points=1, min_docs=2) == sorted(plain(rows, 1, 2), key=repr)
    assert run(spark, []) == []


def test_streams_agree_however_the_ranges_are_cut():
    rng = random.Random(7)
    rows = sorted((rng.randrange(4), 0, -rng.randrange(6), rng.randrange(2), i) for i in range(160))
    rows = [(h, g, None if d == 0 else -d, f, p) for h, g, d, f, p in rows]
    names = ["h1", "h2", "doc", "fp", "pos"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    schema = pa.schema([("kind", pa.int32()), ("range", pa.int32()), *zip(names, kinds), ("last", pa.int64()), ("n", pa.int64())])
    docs = {h: {r[2] for r in rows if r[0] == h} for h in range(4)}
    top = {h: next(r[2] for r in rows if r[0] == h) for h in range(4)}
    for least in (2, 3, 5, 9):
        want = sorted(p for h, _, d, _, p in rows if len(docs[h]) >= least and d != top[h])
        for _ in range(20):
            cuts = sorted(rng.sample(range(len(rows) + 1), rng.randrange(6)))
            got, open_rows, parts = [], [], defaultdict(list)
            for place, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
                some = sorted(rng.sample(range(lo, hi + 1), rng.randrange(min(4, hi - lo + 1))))
                batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a:b]), kinds)] if b > a else [pa.array([], t) for t in kinds], names=names) for a, b in zip([lo, *some], [*some, hi])]
                for b in lines.stream(iter(batches), schema, least, place):
                    for r in b.to_pylist():
                        if r["kind"] == lines.DROP:
                            got.append(r["pos"])
                        elif r["kind"] == lines.OPEN:
                            open_rows.append(r)
                        else:
                            parts[r["h1"]].append(r)
            for h, ps in parts.items():
                n = sum(p["n"] for p in ps) - sum(a["last"] == b["doc"] for a, b in zip(ps, ps[1:]))
                if n >= least:
                    got += [r["pos"] for r in open_rows if r["h1"] == h and r["doc"] != ps[0]["doc"]]
            assert sorted(got) == want


def test_bitmaps_are_exact():
    keep = lines.keep_flags(lines.zlib.compress(bytes([0b00010101, 3])), 7)
    assert keep.tolist() == [True, False, True, False, True, True, True]
