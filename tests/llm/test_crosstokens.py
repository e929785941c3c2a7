"""Cross-tokenizer alignment against a plain version with the tokenizers' own libraries."""

from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from helpers import LONG, ODD, documents
from tokenizers import Tokenizer

from fieldloom.llm import crosstokens as ct

A = Tokenizer.from_file(ct.TOKENIZER_A)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=ct.TOKENIZER_B)
TEXTS = [
    "the house by the river", "the house by the sea", "of the, of the\n\nof  the", "<|endoftext|> and </s> <s> <unk>", "▁ is no blank",
    "naïve café 😀 日本語 x", "\ttabs\r\n and  blanks ", "x" * 5000, "\x00 and <0x41>", " lead",
]


def tokens(text):
    if not text:
        return [], []
    ids_a, ids_b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    letters = ct._byte_letters()
    spelt_a = [bytes(letters[c] for c in A.id_to_token(i)) for i in ids_a]
    spelt_b = []
    for i in ids_b:
        p = B.id_to_piece(i)
        spelt_b.append(bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode())
    if {b"".join(spelt_a), b"".join(spelt_b)} != {b" " + text.encode()}:
        return [], []
    return list(zip(ids_a, spelt_a)), list(zip(ids_b, spelt_b))


def spans(coded):
    at, out = 0, []
    for i, b in coded:
        out.append((i, at, at + len(b)))
        at += len(b)
    return out


def plain(texts):
    """Rows of ``align`` for a list of texts."""
    coded = [tuple(map(spans, tokens(t))) for t in texts]
    links = [[(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] for a, b in coded]
    held = Counter(p for ls in links for p in set(ls))
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    out = []
    for (a, b), ls in zip(coded, links):
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        inside = lambda ts, lo, hi: ",".join(str(i) for i, s, e in ts if lo <= s and e <= hi)
        groups = ";".join(f"{inside(a, lo, hi)}|{inside(b, lo, hi)}" for lo, hi in zip([0, *cuts], cuts))
        best = sum(held[p] == top[p[0]] for p in ls)
        out.append((len(a), len(b), len(cuts), len(ls), best, sum(held[p] for p in ls), groups))
    return out, held


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def test_alignment_matches_plain_version_both_ways(spark, monkeypatch):
    texts = [*TEXTS, *TEXTS[:3], *(f"word{i % 7} and the {i * i}th of them" for i in range(40))]
    want, held = plain(texts)
    assert want[4][0] == 0 and want[3][0] > 0  # a literal U+2581 is not spelt back; special strings are text
    docs = documents(spark, list(enumerate(texts))).repartition(5)
    monkeypatch.setattr(ct, "SHARD_KEYS", 32)
    for limit in (ct.MODEL_BYTES, 0):
        got = {r[0]: tuple(r)[1:] for r in ct.align(docs, model_bytes=limit).select(*NAMES).collect()}
        assert [got[i] for i in range(len(texts))] == want
    files = ct.asset(spark, ct.TOKENIZER_A), ct.asset(spark, ct.TOKENIZER_B)
    index, bits, total = ct.count_pairs(ct.encode(docs, "doc_id", "text", files).where("n is not null"))
    assert bits > 0 and total == len(held)
    assert {(r.a, r.b): r.n_docs for r in ct.pair_counts(index).collect()} == dict(held)


def test_odd_rows_and_digest(spark):
    rows = [r for r in ODD if r[1] != LONG]
    want, _ = plain([t for _, t in rows])
    got = ct.align(documents(spark, rows), digest=True).collect()
    digest = lambda g: sha256(g.encode()).hexdigest() if g else ""
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(map(tuple, got), key=key) == sorted(((i, *w[:6], digest(w[6])) for (i, _), w in zip(rows, want)), key=key)
    assert ct.align(documents(spark, [])).collect() == []


def test_long_text_and_small_slices(spark, monkeypatch):
    rows = [(1, LONG), (2, LONG), (3, "short one")]
    want = [tuple(r) for r in ct.align(documents(spark, rows)).orderBy("doc_id").collect()]
    ids_a = A.encode(" " + LONG, add_special_tokens=False).ids
    assert want[0][1] == want[1][1] == len(ids_a) and want[0][5] <= want[0][4]
    assert want[0][7].split(";")[0].split("|")[0].split(",")[0] == str(ids_a[0])


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 5000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 40, n))
    sizes, words, slots = ct.build_hash(keys)
    index = ct.Index([sizes], [words], [slots])
    assert sorted(index.find(keys).tolist()) == list(range(len(keys)))
    if n:
        with pytest.raises(KeyError):
            index.find(np.array([(1 << 50) + 1]))


def test_tally_merges():
    tally, want = ct.Tally(), Counter()
    rng = np.random.default_rng(1)
    for _ in range(30):
        keys = np.unique(rng.integers(0, 20_000, 9_000))
        tally.add(keys, np.full(len(keys), 2))
        want.update(dict.fromkeys(keys.tolist(), 2))
    tally.merge()
    assert dict(zip(tally.keys.tolist(), tally.sums.tolist())) == want


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError):
        ct._load_a(open("/opt/tokenizers/word_bpe_49k.json", "rb").read())
    assert pa.array([b""]).type == pa.binary()
