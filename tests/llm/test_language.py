import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import ODD, documents

from fieldloom.llm import langid

SYLLABLES = {"en": "the and ing ion ent for tha her", "de": "der die und sch ein ich ung ver", "es": "que los aci des con ado ero nte"}


def sentences(lang, n, rng):
    parts = SYLLABLES[lang].split()
    return [" ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(rng.randint(5, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows, i = [], 0
    for lang in SYLLABLES:
        for text in sentences(lang, 60, rng):
            rows.append((i, text, lang))
            i += 1
    return rows


def probabilities(counts, gram):
    """Interpolated Kneser-Ney by its definition, one gram at a time."""
    levels = [dict(counts)]
    for _ in range(3):
        nxt = Counter(g[1:] for g in levels[-1])
        levels.append(dict(nxt))

    def p(g, level):
        c = levels[level]
        n = np.array(list(c.values()), float)
        d = langid._discount(n)
        same = {k: v for k, v in c.items() if k[:-1] == g[:-1]}
        if not same:
            return p(g[1:], level + 1)
        total = sum(same.values())
        lower = 1 / langid.ALPHABET if len(g) == 1 else p(g[1:], level + 1)
        return max(c.get(g, 0) - d, 0) / total + d * len(same) / total * lower

    return p(gram, 0)


def pack(gram):
    out = 0
    for c in gram:
        out = out << 16 | ord(c)
    return np.uint64(out)


def test_tables_give_kneser_ney_probabilities():
    text = "   the theme then thin hen ten net the  "
    counts = Counter(text[i : i + 4] for i in range(len(text) - 3))
    grams = sorted(counts, key=pack)
    tables, floor = langid.fit_language(np.array([pack(g) for g in grams]), np.array([counts[g] for g in grams]))
    for gram in [*grams, "thet", "xthe", "qqqq", "hexx", "theq"]:
        got = langid.log_probabilities(tables, floor, np.array([pack(gram)]))[0]
        assert np.exp(got) == pytest.approx(probabilities(counts, gram), rel=1e-9), gram


def test_normalise_splits_rows_and_keeps_letters():
    texts = ["Ab1c", "", "  É!x", "\U00020000a"]
    points = np.array([ord(c) for c in "".join(texts)], np.uint32)
    codes, at, letters = langid.normalise(points, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    rows = ["".join(map(chr, codes[a:b])) for a, b in zip(at, at[1:])]
    assert rows == ["   ab c ", "    ", "   é x ", "   ￿a "]
    assert letters.tolist() == [3, 0, 2, 2]
    keys, ends = langid.grams(codes, at)
    assert ends.tolist() == [0, 5, 6, 10, 13] and len(keys) == 13
    assert keys[0] == pack("   a") and keys[5] == pack("    ") and keys[12] == pack("￿a ".rjust(4))


def test_held_out_accuracy_and_odd_rows(spark, corpus):
    odd = [(1000 + (i or 0), t) for i, t in ODD] + [(None, "the and ing"), (2000, "xq zj kq vw xz qj " * 9), (2001, "日本語の文章です" * 9)]
    got = langid.identify(documents(spark, corpus + odd)).collect()
    assert len(got) == len(corpus) + len(odd)
    truth = {i: lang for i, _, lang in corpus}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 20
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got) and all(r.accepted for r in got if r.doc_id in truth)
    by_id = {r.doc_id: r for r in got}
    for i in (1001, 1002, 1003, 1007):  # null, empty, blank, no letter
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].accepted) == ("und", 0.0, False)
    assert not by_id[2000].accepted and not by_id[2001].accepted
    assert by_id[None].lang_pred == "en" and by_id[None].held_out is False


def test_nothing_is_learned_from_the_fold_or_the_label(spark, corpus):
    import zlib

    fold = {i for i, _, _ in corpus if zlib.crc32(str(i).encode()) % 4 == 2}
    lie = [(i, t, "de" if i in fold else lang) for i, t, lang in corpus]
    a = {r.doc_id: r for r in langid.identify(documents(spark, corpus)).collect()}
    b = {r.doc_id: r for r in langid.identify(documents(spark, lie)).collect()}
    assert a == b and {i for i, r in a.items() if r.held_out} == fold


def test_filter_and_tables_without_labels(spark, corpus):
    docs = documents(spark, [*corpus[:90], (500, None), (501, "123")])
    got = langid.keep_identified(docs)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == {i for i, _, _ in corpus[:90]}
    assert langid.identify(documents(spark, [])).collect() == []
    unlabelled = langid.identify(documents(spark, [(1, "words")])).collect()
    assert [(r.lang_pred, r.score, r.accepted) for r in unlabelled] == [("und", 0.0, False)]


def test_rarest_grams_go_first_when_the_model_is_full(spark, corpus):
    full = langid.train(documents(spark, corpus))
    small = langid.train(documents(spark, corpus), max_grams=40)
    assert small.langs == full.langs
    assert all(0 < len(t[3][0]) <= 40 < len(f[3][0]) for t, f in zip(small.tables, full.tables))


def elsewhere(text):
    """The text in letters of another script."""
    return "".join(chr(ord(c) + 0x4E00) if c.isalpha() else c for c in text)


@pytest.mark.parametrize("learned", [("en", "de"), ("en",)])
def test_a_language_in_another_script_does_not_open_the_limits(spark, corpus, learned):
    """Random letters and a language not learned stay out, and what was learned stays in."""
    rng = random.Random(8)
    rows = [r for r in corpus if r[2] in learned]
    rows += [(i + 10_000, elsewhere(t), "far") for i, t, lang in corpus if lang == "de"]
    junk = [(20_000 + i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(30)), None) for i in range(10)]
    left_out = [(30_000 + i, t, None) for i, t, lang in corpus if lang == "es" and len(t) > 60]
    got = langid.identify(documents(spark, rows + junk + left_out)).collect()
    assert all(r.accepted for r in got if r.doc_id < 20_000)
    assert not any(r.accepted for r in got if r.doc_id >= 20_000)


def test_two_names_of_one_language_do_not_shut_it_out(spark, corpus):
    rows = [(i, t, "en" if i % 2 else "eng") for i, t, lang in corpus if lang == "en"]
    assert sum(r.accepted for r in langid.identify(documents(spark, rows)).collect()) >= 0.9 * len(rows)


def test_no_gram_is_left_out_of_a_large_model(spark):
    rng = random.Random(9)
    texts = ["".join(map(chr, rng.choices(range(0x4E00, 0x9F00), k=210_000))) for _ in range(5)]
    want = set()
    for t in texts:
        padded = f"   {t} "
        want.update(padded[i : i + 4] for i in range(len(padded) - 3))
    assert len(want) > 1_000_000
    model = langid.train(documents(spark, [(i, t, "zh") for i, t in enumerate(texts)]))
    assert len(model.tables[0][3][0]) == len(want)


def test_memory_of_a_step_does_not_follow_the_batch():
    """Counting and scoring a batch of long texts hold arrays for a slice of it, not for a megabyte of characters at a time."""
    import tracemalloc

    import pyarrow as pa

    from fieldloom.llm.common import utf8

    words = ["lorem", "ipsum", "dolor", "sit", "amet"]
    texts = [" ".join(words[(i * 7 + j * j) % 5] for j in range(400)) for i in range(1500)]
    batch = pa.record_batch({"lang": ["xx"] * len(texts), "text": texts})
    got = list(langid._count([batch]))
    keys = np.concatenate([b.column(1).to_numpy().view(np.uint64) for b in got])
    counts = {"xx": (np.sort(keys), np.concatenate([b.column(2).to_numpy() for b in got])[np.argsort(keys)])}
    model = langid.build(counts)
    raw, at, valid = utf8(batch.column(1))
    for step in (lambda: list(langid._count([batch])), lambda: list(langid.own_scores(model, counts, [batch])), lambda: langid.score_rows(model, raw, at, valid)):
        step()
        tracemalloc.start()
        step()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 30e6
