import itertools
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from helpers import ODD, documents

import corpus_pipeline
from fieldloom.llm import langid, mixing, pieces, repetition, simhash


@pytest.fixture(scope="module")
def vocabulary():
    with open(pieces.MODEL, "rb") as f:
        return pieces.load(f.read())


def encode(v, texts, keys=None):
    return pieces.encode_rows(v, pa.array(texts, pa.string()), pa.array(keys or [str(i) for i in range(len(texts))], pa.string()))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet=" \n▁the\x00é😀", max_size=40)), max_size=6))
def test_decoding_gives_the_text_back(vocabulary, texts):
    got = pieces.decode_rows(vocabulary, encode(vocabulary, texts)).to_pylist()
    assert got == [t or "" for t in texts]


def paths(v, text):
    """All segmentations with their probabilities, by plain recursion."""
    names = {v.table[i].as_py(): i for i in range(v.size) if np.isfinite(v.log_p[i]) and v.byte_ids[v.table[i].as_py()[0]] != i}
    data = " " + text

    def walk(at):
        if at == len(data):
            yield (), 0.0
        for end in range(at + 1, len(data) + 1):
            piece = data[at:end].encode()
            if piece in names:
                for rest, lp in walk(end):
                    yield (names[piece], *rest), lp + v.log_p[names[piece]]
            elif end == at + 1:
                own = tuple(int(i) for i in v.byte_ids[list(piece)])
                for rest, lp in walk(end):
                    yield own + rest, lp + len(own) * v.log_p[v.byte_ids[0]]

    found = dict(walk(0))
    top = np.logaddexp.reduce(list(found.values()))
    return {k: np.exp(x - top) for k, x in found.items()}


@pytest.mark.parametrize("text", ["the", "in on", "été\n"])
def test_samples_follow_the_lattice(vocabulary, text):
    n = 20_000
    got = Counter(map(tuple, encode(vocabulary, [text] * n).to_pylist()))
    want = paths(vocabulary, text)
    assert set(got) <= set(want)
    for path, p in want.items():
        assert abs(got[path] - n * p) < 5 * np.sqrt(n * p * (1 - p)) + 3


def test_same_row_same_pieces_in_any_batch(vocabulary, monkeypatch):
    texts = [f"some words {i} and the others {i * i} thntstndonre" for i in range(400)]
    keys = [str(i % 300) for i in range(400)]
    whole = encode(vocabulary, texts, keys).to_pylist()
    monkeypatch.setattr(pieces, "SLICE", 64)
    monkeypatch.setattr(pieces, "KEPT_EDGES", 500)
    order = list(range(399, -1, -1))
    again = encode(vocabulary, [texts[i] for i in order], [keys[i] for i in order]).to_pylist()
    assert [again[399 - i] for i in range(400)] == whole
    other = pieces.encode_rows(vocabulary, pa.array(texts), pa.array(keys), seed=11).to_pylist()
    assert sum(a != b for a, b in zip(whole, other)) > 50


def test_segment_odd_rows(spark):
    got = pieces.segment(documents(spark, [*ODD, (8, "x" * 20_000), (9, None)])).collect()
    assert len(got) == len(ODD) + 2 and all(r.lossless for r in got)
    assert [r.ids for r in got if r.doc_id in (1, 2, 9)] == [[], [], []]
    twice = [r.ids for r in got if r.doc_id == 4]
    assert twice[0] == twice[1]
    assert pieces.segment(documents(spark, [])).collect() == []


def test_stages_match_plain_versions(spark, tmp_path):
    """Every stage on what the one before it kept, at the smallest test size."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "mixture", "segmentation"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        seen[name] = (docs, spark.read.parquet(f"{tmp_path}/{name}"))
        docs = seen[name][1]
        assert name == "segmentation" or docs.columns == columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    before, after = seen["language"]
    known = {r.doc_id for r in langid.identify(before).collect() if r.accepted}
    assert ids(after) == sorted(known) and len(known) >= 0.98 * before.count()

    from test_rules import plain

    before, after = seen["quality"]
    assert ids(after) == sorted(r.doc_id for r in before.collect() if plain(r.text)["kept"])

    from test_simhash import components, similar_pairs
    from test_simhash import plain as fingerprint

    before, after = seen["near_duplicates"]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    roots = components([fingerprint(t) for _, t in rows], similar_pairs([t for _, t in rows]))
    assert ids(after) == [rows[i][0] for i in sorted(set(roots))]

    before, after = seen["mixture"]
    want = mixing.rates(before, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert ids(after) == sorted(itertools.chain.from_iterable([r.doc_id] * r.copies for r in want))

    before, after = seen["segmentation"]
    assert ids(after) == ids(before) and all(r.lossless for r in after.collect())
    assert ids(corpus_pipeline.run(spark, sf)) == ids(after)


def test_stages_take_odd_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (ODD, []):
        docs = documents(spark, [(i, t, "en" if i and i % 2 else None) for i, t in rows])
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.count() <= 2 * len(rows) + 2
            assert name == "segmentation" or out.columns == docs.columns
    assert simhash.DISTANCE == 2 and repetition.BASE_WINDOW == 8
