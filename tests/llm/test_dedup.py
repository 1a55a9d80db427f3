import random

import numpy as np
import pytest

from harborline.llm import jaccard_join, substring_dedup
from harborline.llm.components import connected

from .helpers import brute_components, brute_substrings, corpus, frame, prose, sha


@pytest.mark.parametrize("shard", [1, 128])
def test_substrings_by_automata_and_by_windows(spark, shard):
    rows = corpus(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup(frame(spark, rows), shard=shard).collect()}
    assert got == brute_substrings(rows) and any(x[1] for x in got.values())


def test_substrings_small_tables(spark):
    none = substring_dedup.dedup(frame(spark, []))
    assert none.collect() == []
    twice = [(1, "a b c"), (1, "a b c"), (None, "d"), (2, None)]
    got = substring_dedup.dedup(frame(spark, twice)).collect()
    assert len(got) == 4 and all(r["n_removed"] == 0 for r in got)
    copies = [(None, "w " * 30), (5, " w" * 30)]  # a null id comes first; the text repeats itself
    got = {r["doc_id"]: r for r in substring_dedup.dedup(frame(spark, copies)).collect()}
    assert got[None]["n_removed"] == 29 and got[5]["n_removed"] == 30 and got[5]["kept_sha256"] == sha("")


@pytest.mark.parametrize("shard", [1, 128])
def test_substrings_of_shared_and_missing_ids(spark, shard):
    """Rows that share an id, or have none, are cut by their own text alone."""
    rng = random.Random(11)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    inside = prose(rng, 10) + " " + c
    rows = [(1, a), (5, a), (5, b), (None, c), (None, inside), (None, d), (9, a), (9, a)]
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "doc_id long, text string, spans int, n_words string")
    got = {r["spans"]: r["n_removed"] for r in substring_dedup.dedup(df.drop("n_words"), keep=["doc_id", "spans"], shard=shard).collect()}
    assert (got[0], got[1], got[2], got[5], got[6], got[7]) == (0, 60, 0, 0, 60, 60)
    # of two without an id that share a passage one keeps it
    assert sorted([got[3], got[4]]) == [0, 60]


def test_suffix_automaton_against_brute_force():
    rng = random.Random(5)
    for _ in range(40):
        texts = [[rng.choice("abc") for _ in range(rng.randint(1, 25))] for _ in range(4)]
        m = substring_dedup.SuffixAutomaton()
        for t in texts[:3]:
            m.add(t)
        runs = {tuple(t[i:j]) for t in texts[:3] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        want = [max((n for n in range(1, e + 1) if tuple(texts[3][e - n : e]) in runs), default=0) for e in range(1, len(texts[3]) + 1)]
        assert m.matching(texts[3]) == want


def test_long_spans():
    assert substring_dedup.long_spans([0, 1, 2, 3, 4, 0, 3], 3) == [(1, 2), (4, 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rows = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.components(frame(spark, rows), buckets=3).collect()}
    assert got == brute_components(rows) and len({c for _, c in got.values()}) < len(rows)


def test_components_of_chains_and_tiny_sets(spark):
    """Chains of near copies whose ends are far apart, and sets of few shingles at the threshold."""
    rng = random.Random(9)
    rows, w = [], prose(rng, 60).split()
    for i in range(25):
        rows.append((i, " ".join(w)))
        w = list(w)
        w[rng.randrange(60)] = f"new{i}"
    for i in range(60):
        w = ["a", "b", "c", "d", "e", "f", "g", "h", "i", "j", "k", "l"][: rng.randint(1, 12)]
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = "z"
        rows.append((100 + i, " ".join(w)))
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.components(frame(spark, rows), buckets=2).collect()}
    assert got == brute_components(rows)


def test_components_small_tables(spark):
    assert jaccard_join.components(frame(spark, [])).collect() == []
    got = sorted((tuple(r) for r in jaccard_join.components(frame(spark, [(None, "x"), (3, "x"), (3, "x"), (1, None), (2, "")])).collect()), key=str)
    assert got == sorted([(None, 1, None), (3, 1, 3), (3, 1, 3), (1, 0, 1), (2, 0, 2)], key=str)


def test_allocation_spends_the_budget():
    J = jaccard_join
    n = 30
    assert J.distance(2 * n) + 1 == 9

    def spend(slack, fat, segments):
        """segments: cost, further cost (of the segment with one left out), offered. Returns the allowances and done."""
        flags = [J.OWN | (J.FAT if offered else 0) for _, _, offered in segments]
        rows = [np.array(c, np.int64) for c in ([0] * len(segments), range(len(segments)), flags, [c + 1 for c, _, _ in segments], [m for _, m, _ in segments])]
        e, done = J.allocate(*rows, np.array([n]), np.array([slack]), np.array([fat]))
        return e.tolist(), done.tolist()

    # exactly enough free segments: nothing that costs is looked at
    assert spend(4, 0, [(5, 1, False)] * 4) == ([-1] * 4, [True])
    # two short: the two cheapest
    assert spend(2, 0, [(9, 0, False), (1, 0, False), (3, 0, False), (9, 0, False)]) == ([-1, 0, 0, -1], [False])
    # the further allowance of a cheap segment before a dear one
    assert spend(1, 1, [(1, 1, True), (50, 0, False), (60, 0, False)]) == ([1, -1, -1], [False])


def test_two_texts_of_one_id_are_linked_each(spark):
    rng = random.Random(3)
    text = lambda: [rng.choice("abcdefghijklmnopqrst") * rng.randint(1, 4) for _ in range(120)]
    a, b = text(), text()
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join([*a[:-1], "z"])), (9, " ".join(["z", *b[1:]])), (11, " ".join(text()))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.components(frame(spark, rows), buckets=2).collect()}
    assert got == {5: 5, 7: 5, 9: 5, 11: 11}


def test_large_group_around_a_centre(spark):
    """Copies near and far from one text: far ones meet nobody by chance, and chains between far ones are found."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows, chain = [(i, " ".join(base)) for i in range(5)], base
    for i in range(120):
        w = list(base)
        for k in rng.sample(range(150), rng.randint(1, 14)):
            w[k] = f"x{rng.randrange(100_000)}"
        rows.append((100 + i, " ".join(w)))
    for i in range(6):
        chain = list(chain)
        for k in rng.sample(range(150), 4):
            chain[k] = f"y{rng.randrange(100_000)}"
        rows.append((900 + i, " ".join(chain)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.components(frame(spark, rows), buckets=2).collect()}
    assert got == brute_components(rows)


def test_connected(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[200] == got[150] == 100
    assert connected(spark.createDataFrame([], "u long, v long")).collect() == []
