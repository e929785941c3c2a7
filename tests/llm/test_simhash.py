import random
import sys
from pathlib import Path

import numpy as np
import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).parent))
from helpers import ODD, documents, lower, words

from fieldloom.llm import shingles, simhash


def plain(text):
    w = words(lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def shingle_set(text):
    w = words(lower(text))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar_pairs(texts):
    """Index pairs of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = list(map(shingle_set, texts))
    where, out = {}, set()
    for i, s in enumerate(sets):
        shared = {}
        for g in s:
            for j in where.setdefault(g, []):
                shared[j] = shared.get(j, 0) + 1
            where[g].append(i)
        out |= {(j, i) for j, n in shared.items() if 5 * n >= 4 * (len(s) + len(sets[j]) - n)}
    return out


def components(prints, more=()):
    """Smallest index reachable over links of at most two bits, all pairs compared, or ``more``."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    for i, j in more:
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    return [root(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", [None, "", "a", "A b", "a b c", "x " * 50, "Zoë\x1c said hi all \x0b ok", ODD[6][1]])
def test_fingerprint_is_the_majority_of_shingle_hashes(text):
    assert simhash.fingerprint((text or "").encode()) == plain(text)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("pairwise", [128, 2, 0])
def test_links_join_what_all_pairs_join(spark, monkeypatch, pairwise):
    """Also with every key treated as a large one."""
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rng = random.Random(5)
    prints = {0, (1 << 64) - 1}
    for _ in range(25):
        p = rng.getrandbits(64)
        prints.add(p)
        for _ in range(6):
            for _ in range(rng.choice([1, 1, 2, 2, 3])):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    base = rng.getrandbits(32)  # one segment in common, neighbours in the other
    prints |= {base << 32 | (1 << i) | (1 << j) for i in range(0, 12) for j in range(0, 12)}
    prints = sorted(prints)
    table = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = {(r.src, r.dst) for r in simhash.links(table).collect()}
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in found)
    parent = {signed(p): signed(p) for p in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in found:
        parent[root(b)] = root(a)
    want = components(prints)
    got = [root(signed(p)) for p in prints]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_near_duplicates_of_odd_rows(spark):
    got = simhash.near_duplicates(documents(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append((r.fingerprint, r.component_id))
    assert by_id[1] == by_id[2] == by_id[3] == [("0" * 16, 1)]
    assert by_id[4] == by_id[None] * 2 == [(f"{plain('a b c d'):016x}", 4)] * 2
    assert [r.component_id for r in got if r.doc_id == 7] == [7]


def test_empty_table(spark):
    docs = documents(spark, [])
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.keep_one(docs).collect() == []


def test_one_row_of_a_group_stays_with_all_columns(spark):
    text = " ".join(f"w{i}" for i in range(400))
    near = text + " w7"
    assert bin(plain(text) ^ plain(near)).count("1") <= 2
    docs = documents(spark, [(9, text), (3, near), (3, near), (8, text), (3, "other words stand here alone"), (1, "zzz"), (None, None), (None, "")])
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    assert (1, "zzz") in kept and (9, text) not in kept and (8, text) not in kept
    assert sum(r[0] is None for r in kept) == 1 and len(kept) == len(set(kept))


def test_components_that_share_an_id_or_have_none_keep_a_row_each(spark):
    """Unlike texts without ids, or under one id, are components of their own."""
    texts = [" ".join(f"{stem}{i}" for i in range(60)) for stem in "abcdef"]
    prints = [plain(t) for t in texts]
    assert min(bin(a ^ b).count("1") for i, a in enumerate(prints) for b in prints[:i]) > 2
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (9, texts[4]), (None, texts[5]), (8, texts[5])]
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(documents(spark, rows)).collect()), key=repr)
    want = [(None, t) for t in texts[:3]] + [(7, texts[3]), (7, texts[4]), (8, texts[5])]
    assert kept == sorted(want, key=repr)


def copies(rng, words_, n, most):
    """Near copies: a few words of ``words_`` changed in each."""
    for i in range(n):
        w = list(words_)
        for _ in range(rng.randrange(most + 1)):
            w[rng.randrange(len(w))] = f"new{i}x{rng.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize("pairwise", [32, 3])
def test_links_are_the_pairs_of_similar_shingles(spark, monkeypatch, pairwise):
    """With a hot passage in most texts, and with every larger key treated as a hot one."""
    monkeypatch.setattr(shingles, "PAIRWISE", pairwise)
    rng = random.Random(11)
    texts = ["", "one two", "One TWO", "one two three four five", "one two three four five six"]
    passage = " ".join(f"passage{i}" for i in range(30))
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(rng.choice([8, 60, 200]))]
        texts += [f"{t} {passage}" if g % 2 and len(base) > 8 else t for t in copies(rng, base, 4, 2 + len(base) // 60)]
    docs = documents(spark, list(enumerate(texts)))
    marked = docs.select("doc_id", "text", shingles.signature(docs["text"]).alias("s")).select("doc_id", "text", "s.*")
    found = {(r.src, r.dst) for r in shingles.links(marked, marked).collect()}
    name = {r.doc_id: r["set"] for r in marked.collect()}
    want = {tuple(sorted((name[i], name[j]))) for i, j in similar_pairs(texts) if name[i] != name[j]}
    assert found <= want and len(want) > 30
    if pairwise == 32:
        assert found == want
    else:
        assert len(found) >= 0.8 * len(want)


def test_large_group_of_near_copies(spark):
    """All keys of the group are hot: over pivots most, not all, of what all pairs join is joined (129 rows stay, not 94)."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = [*copies(rng, base, 300, 5), *(" ".join(f"o{i}x{j}" for j in range(50)) for i in range(20))]
    roots = components([simhash.fingerprint(t.encode()) for t in texts], similar_pairs(texts))
    want = set(roots)
    kept = {r.doc_id for r in simhash.keep_one(documents(spark, list(enumerate(texts)))).collect()}
    assert want <= kept and {0, *range(300, 320)} <= kept and len(kept) <= len(want) + 40


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_near_copies_of_the_tables_are_caught(spark, sf):
    """All pairs of similarity 0.8 and more, and none of the others beyond two bits."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").where("text is not null")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    pairs = similar_pairs([t for _, t in rows])
    prints = [simhash.fingerprint(t.encode()) for _, t in rows]
    roots = components(prints, pairs)
    assert len(pairs) > 10
    kept = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    assert kept == [rows[i][0] for i in sorted(set(roots))]


def test_maps_and_structs_are_carried(spark):
    docs = documents(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, "other")]).selectExpr("*", "map('k', doc_id) AS m", "named_struct('a', 1) AS `__row`")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_every_near_copy_of_a_large_group_is_joined(spark):
    """The rows that all pairs leave, where all keys of a group are hot and pivots alone leave 129 rows."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = [*copies(rng, base, 300, 5), *(" ".join(f"o{i}x{j}" for j in range(50)) for i in range(20))]
    roots = components([simhash.fingerprint(t.encode()) for t in texts], similar_pairs(texts))
    kept = sorted(r.doc_id for r in simhash.keep_one(documents(spark, list(enumerate(texts)))).collect())
    assert kept == sorted(set(roots)) and len(kept) == 94


@pytest.mark.parametrize("often", [3, 1])
def test_pairs_under_hot_keys_only_are_joined(spark, monkeypatch, often):
    """Short texts whose prefix is one shared passage, whatever is put last; fingerprints may differ in many bits."""
    monkeypatch.setattr(shingles, "PAIRWISE", 3)
    monkeypatch.setattr(shingles, "PIVOTS", 1)
    monkeypatch.setattr(shingles, "SAMPLED", 1)
    monkeypatch.setattr(shingles, "OFTEN", often)
    rng = random.Random(4)
    passage = " ".join(f"passage{i}" for i in range(24))
    texts = []
    for g in range(25):
        own = [f"g{g}w{i}" for i in range(rng.choice([3, 9, 30]))]
        texts += [" ".join([passage, *own, f"end{i}"]) for i in range(2)]
    docs = documents(spark, list(enumerate(texts)))
    marked = docs.select("text", shingles.signature(docs["text"]).alias("s")).select("text", "s.*").collect()
    name = [next(r["set"] for r in marked if r.text == t) for t in texts]
    rows = spark.createDataFrame([(r["set"], r.n, r.text) for r in marked], "set long, n long, text string")
    found = {(r.src, r.dst) for r in shingles.links(rows, rows).collect()}
    place = {n: i for i, n in enumerate(name)}
    want = similar_pairs(texts)
    assert {tuple(sorted((place[a], place[b]))) for a, b in found} <= want
    apart = [1 << i for i in range(len(texts))]  # no fingerprint joins anything
    apart = [a << 40 | a << 80 | a for a in apart]
    assert components(apart, [(place[a], place[b]) for a, b in found]) == components(apart, want)


def test_fine_counts_bound_what_two_sets_do_not_share():
    """Never more than the shingles in one set only, at sizes that need folding and at counts beyond a byte."""
    rng = np.random.default_rng(5)
    for n, few in [(1, 0), (70, 9), (64, 6), (65, 8), (1030, 90), (4000, 700)]:
        a = np.unique(rng.integers(0, 2**64, n, np.uint64, endpoint=False))
        b = np.unique(np.concatenate([a[few:], rng.integers(0, 2**64, few // 2, np.uint64, endpoint=False)]))
        for x, y in [(a, b), (a >> np.uint64(30), b >> np.uint64(30))]:  # all under one count, too
            x, y = np.unique(x), np.unique(y)
            apart = len(np.setxor1d(x, y))
            assert shingles.fine_apart(shingles.fine_counts(x), shingles.fine_counts(y)) <= apart
    far = [np.unique(rng.integers(0, 2**64, 1500, np.uint64, endpoint=False)) for _ in range(2)]
    assert shingles.fine_apart(*map(shingles.fine_counts, far)) * 9 > 2 * 1500 * 4


def test_whole_sets_of_unlike_pairs_are_not_moved(spark, monkeypatch):
    """Long texts that share a passage and little else meet under its keys; only similar ones are compared whole."""
    whole = []
    kept = shingles.materialize

    def seen(df, name):
        out = kept(df, name)
        if name == "shingle-whole":
            whole.append(out.count())
        return out

    monkeypatch.setattr(shingles, "materialize", seen)
    monkeypatch.setattr(shingles, "SAMPLED", 1 << 40)  # nothing is known as popular
    passage = " ".join(f"p{i}" for i in range(150))
    texts = [passage + " " + " ".join(f"o{i}x{j}" for j in range(1200)) for i in range(12)]
    texts += [texts[0] + " more"]
    kept_ids = sorted(r.doc_id for r in simhash.keep_one(documents(spark, list(enumerate(texts)))).collect())
    assert kept_ids == list(range(12)) and whole and whole[0] == 2


def test_keys_of_few_fingerprints_are_dealt_to_all_tasks(spark, monkeypatch):
    """A few kilobytes of fingerprints make sixty-six keys each: no task makes them all."""
    tasks, made = [], simhash._variants

    def variants(prints):
        tasks.append(prints.rdd.getNumPartitions())
        return made(prints)

    monkeypatch.setattr(simhash, "_variants", variants)
    docs = documents(spark, [(i, " ".join(f"o{i}x{j}" for j in range(20))) for i in range(50)])
    assert simhash.keep_one(docs).count() == 50
    assert tasks and set(tasks) == {int(spark.conf.get("spark.sql.shuffle.partitions"))}
