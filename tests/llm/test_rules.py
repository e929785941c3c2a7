import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from helpers import ODD, documents, lower, words

from fieldloom.llm import licenses, repetition


def covered(w, n):
    grams = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    hit = set()
    for i in range(len(w) - n + 1):
        if grams[tuple(w[i : i + n])] > 1:
            hit |= set(range(i, i + n))
    return hit


def plain(text):
    text = text or ""
    w = words(text)
    lines = Counter(x for x in text.split("\n") if words(x))
    again = covered(w, 8)
    chars = sum(map(len, w))
    out = {
        "n_words": len(w),
        "word_chars": chars,
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": sum(n - 1 for n in lines.values()),
        "n_repeat_words": len(again),
        "line_coverage": sum((n - 1) * len(x) for x, n in lines.items()) / max(len(text), 1),
    }
    for n in repetition.COVERAGE:
        out[f"coverage_{n}"] = sum(len(w[i]) for i in covered(w, n)) / max(chars, 1)
    out["base_failed"] = len(w) < 20 or 100 * len(again) > 30 * len(w)
    out["kept"] = not (
        out["base_failed"]
        or out["line_coverage"] > repetition.LINE_CHARS
        or any(out[f"coverage_{n}"] > most for n, most in repetition.COVERAGE.items())
    )
    return out


REPEATS = [
    "the same words " * 40,
    " ".join(f"w{i}" for i in range(60)),
    "\n".join(["one line here with several words in it"] * 5 + [f"x{i} y{i} z{i}" for i in range(30)]),
    " ".join(f"w{i} " * 8 for i in range(12)),
    "é ü\n" * 30 + "# * | <b>",
]


def test_measures_match_a_plain_count(spark):
    rows = ODD + [(20 + i, t) for i, t in enumerate(REPEATS)]
    got = repetition.assess(documents(spark, rows)).collect()
    want = Counter(repr((i, plain(t))) for i, t in rows)
    assert Counter(repr((r.doc_id, {k: v for k, v in r.asDict().items() if k != "doc_id"})) for r in got) == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\x1cé", max_size=60), max_size=6))
def test_rows_do_not_touch_each_other(texts):
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    got = repetition.measure(raw, at)
    for i, t in enumerate(texts):
        assert {k: v[i] for k, v in got.items()} == plain(t)


def test_filter_keeps_columns_and_good_rows(spark):
    good = " ".join(f"word{i}" for i in range(50))
    docs = documents(spark, [(1, good), (2, "the same words " * 40), (3, None), (1, good)])
    got = repetition.keep_good(docs)
    assert got.columns == docs.columns
    assert [r.doc_id for r in got.collect()] == [1, 1]
    assert repetition.keep_good(documents(spark, [])).collect() == []


def test_long_words_and_chunks(monkeypatch):
    """Prefix sums in chunks give what one sum gives."""
    from fieldloom.llm import common

    monkeypatch.setattr(common, "CHUNK", 64)
    common._powers.cache_clear()
    text = "x" * 500 + " " + "some words come again and again here " * 20
    raw = np.frombuffer(text.encode(), np.uint8)
    got = repetition.measure(raw, np.array([0, len(raw)]))
    common._powers.cache_clear()
    assert {k: v[0] for k, v in got.items()} == plain(text)


def plain_places(text):
    import re

    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    found = []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), sorted(found)


TEXTS = [
    "Released under the MIT License, mit license mit  license!",
    "cc-by CC BY cc by-nc; GNU GENERAL public-license é",
    "x" * 3000 + " apache license " + "y " * 3000,
    "ſ K mit license",  # letters whose lower case is ASCII stay as they are
]


@pytest.mark.parametrize("text", TEXTS + [t for _, t in ODD])
def test_exact_places(text):
    got = licenses._row((text or "").encode())
    n, found = plain_places(text)
    assert (got["n_words"], got["n_base"]) == (n, len(found))
    assert got["first_word"] == min((i for i, _ in found), default=None)
    assert got["last_word"] == max((i for i, _ in found), default=None)
    assert got["base_labels"] == sorted({x for _, x in found})


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        last = list(range(len(b) + 1)) if i == 1 else last
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        last = row
    return last[-1]


@pytest.mark.parametrize("notice", range(len(licenses.NOTICES)))
def test_every_edit_within_the_bound_is_found(notice):
    """Edits anywhere leave one seed whole, so the notice is found and its edits are right."""
    words_, label = licenses.NOTICES[notice]
    bound = len(licenses.seeds(words_, licenses.EDIT_SHARE)) - 1
    assert bound == len(words_) // 10
    step = max(1, len(words_) // 9)
    for shift in range(0, step, 2):
        s = list(words_)
        for k, at in enumerate(range(shift, len(s) - 1, step)):
            if k == bound:
                break
            s[at] = {0: "q", 1: s[at] + "q", 2: ""}[k % 3]
        text = "zebra " * 5 + "".join(s) + " quokka" * 5
        found = licenses.fuzzy(licenses.normalise(text.encode()))
        mine = [m for m in found if licenses.NOTICES[m[0]][1] == label]
        assert mine or bound == 0 or any(m[3] <= bound for m in found), text
        for i, a, b, e in mine:
            assert e == distance(licenses.NOTICES[i][0], text[a:b]) <= bound or text[a:b] != words_


def test_better_reading_wins_and_clean_text_has_none(spark):
    rows = [(1, "This work is licensed under the GNU General Public License, version 3."), (2, "license of the public general version"), (3, None)]
    got = {r.doc_id: r for r in licenses.scan(documents(spark, rows)).collect()}
    assert got[1].labels == ["gpl", "gpl-3.0"] and got[1].score == 1.0
    assert (got[1].matches[0].first_word, got[1].matches[0].last_word) == (0, 11)
    assert got[2].labels == got[3].labels == [] and got[2].score == got[3].score == 0.0
    fuzzy = licenses._row(b"Relaesed under the MIT-License".replace(b"ae", b"e"))
    assert fuzzy["labels"] == ["mit"]
    assert licenses.scan(documents(spark, [])).collect() == []


def test_least_edits_is_the_distance_to_the_nearest_stretch():
    rng = random.Random(2)
    for _ in range(150):
        notice = "".join(rng.choice("ab ") for _ in range(rng.randrange(1, 12)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 14)))
        want = min([len(notice)] + [distance(notice, text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1)])
        assert licenses.least_edits(notice, text, 0, len(text)) == want


def test_matches_in_front_of_and_behind_the_best_one_are_found():
    notice = licenses.NOTICES[6][0]
    text = f"{notice[:8]}x{notice[8:]} {notice} {notice[:20]}yy{notice[20:]}"
    found = sorted((a, e) for i, a, b, e in licenses.fuzzy(text) if i == 6)
    assert [e for _, e in found] == [1, 0, 2]
