"""Divergence of sources, mixing of sources, runs of words: against brute force on small tables."""

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborline.llm import divergence, mixing, periodic_runs
from harborline.llm.common import PIECE_BYTES

from .helpers import WORD, corpus, frame, prose, save, sha

LETTERS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def _runs(w, least):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def test_runs_against_brute_force():
    rng = random.Random(4)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 5)):
            n, k = rng.randint(0, 70), rng.randint(1, 4)
            w = [rng.randrange(k) for _ in range(n)]
            if n > 4 and rng.random() < 0.4:
                a, p = rng.randrange(n), rng.randint(1, 6)
                w = [w[min(n - 1, a + (i - a) % p)] if i >= a else x for i, x in enumerate(w)]
            texts.append(w)
        fibonacci = [[0], [0, 1]]
        while len(fibonacci[-1]) < 80:
            fibonacci.append(fibonacci[-1] + fibonacci[-2])
        texts.append(fibonacci[-1])
        first = np.cumsum([0, *map(len, texts)])
        least = rng.choice([2, 3, 4, 7, 12])
        got = [tuple(r) for r in periodic_runs.runs_of(np.array(sum(texts, []), np.int64), first, least).tolist()]
        assert got == [(t, *r) for t, w in enumerate(texts) for r in sorted(_runs(w, least), key=lambda r: (r[0], r[2]))]


@pytest.mark.parametrize("words", [[0] * 50_000, list(range(500)) * 100, [i % 2 for i in range(50_000)]])
def test_one_long_run(words):
    found = periodic_runs.runs_of(np.array(words), np.array([0, len(words)]))
    assert found.tolist() == [[0, 0, len(words), len(set(words))]]


def test_query_of_runs(spark, tmp_path):
    rng = random.Random(2)
    rows = corpus(2) + [(9000, "x y " * 40), (9000, "x y " * 40), (None, "a b c " * 9), (9003, prose(rng, 9) + " z" * 30 + " q q " * 20), (9004, "é" * 10)]
    rows += [(10_000 + i, prose(rng, rng.randint(0, 400))) for i in range(60)]
    save(frame(spark, rows), tmp_path, "documents")
    got = periodic_runs.query(spark, str(tmp_path)).collect()
    want = []
    for d, t in rows:
        w, n = WORD.findall(t or ""), len(WORD.findall(t or ""))
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
        found = sorted(_runs(w, 12), key=lambda r: (r[0], r[2]))
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        want.append((d, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert sum(x[1] for x in want) > 15 and any(zlib.crc32(str(x[0]).encode()) % 10 == 0 and x[1] for x in want)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_runs_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b " * 8, "k", 5)], "doc_id long, text string, kept string, __text int")
    row = periodic_runs.runs(df, ["doc_id", "kept", "__text"]).first()
    assert row["kept"] == "k" and row["__text"] == 5 and row["collapsed_text"] == "a b" and [tuple(r) for r in row["runs"]] == [(0, 16, 2)]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert periodic_runs.runs(empty).count() == divergence.divergence(empty).count() == mixing.mix(empty).count() == 0


def _shares(counts, kept):
    n, v = sum(counts[t] for t in kept), len(kept)
    return {t: 1 + 1_000_000_000 * (counts[t] + 2) // (n + 2 * v) for t in kept}


def _audit(rows, min_docs):
    """(lang, source, part, item, value, rank) of (text, lang, source), term by term."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in ((t or "", a or "", s or "") for t, a, s in rows):
        terms = LETTERS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    apart = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang, held in docs.items():
        kept = [t for t, n in held.items() if n >= min_docs]
        groups = {s: c for (a, s), c in counts.items() if a == lang}
        shares = {s: _shares(c, kept) for s, c in groups.items()}
        whole = _shares(sum(groups.values(), Counter()), kept)
        for s, c in groups.items():
            pairs = [(sum(apart(shares[s][t], shares[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(apart(shares[s][t], whole[t]), t) for t in kept if c[t] and shares[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_divergence_against_brute_force(spark, seed):
    rng = random.Random(seed)
    names = ["Alpha", "beta", "GAMMA", "delta", "Épée", "épée", "ŒUVRE", "œuvre", "x1y", "o'clock", "zeta eta", *(prose(rng, 1) for _ in range(60))]
    rows = []
    for i in range(260):
        source = rng.choice(["s1"] * 5 + ["s2", "s3", "é", "", None])
        lang = rng.choice(["en", "en", "en", "fr", "", None]) if source != "é" else "en"
        text = rng.choice([None, ""]) if rng.random() < 0.1 else " ".join(rng.choices(names[: rng.randint(2, len(names))], k=rng.randint(0, 40)))
        rows.append((text, lang, source))
    rows += rows[:40] + [("1 2 3", "de", "alone"), ("only once", "it", "a"), ("nothing kept", "it", "b"), ("x" * 50 + " alpha " * 200, "en", "s1")]
    df = spark.createDataFrame([(i % 50, *r, "c") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, count string").repartition(3)
    got = sorted(map(tuple, divergence.divergence(df).collect()))
    assert got == _audit(rows, 10) and {r[2] for r in got} == {"pair", "term"} and len({r[0] for r in got}) == 4


def test_terms_of_a_long_text_count_one_document(spark):
    text = " ".join(f"alpha{'x' * (i % 7)} beta" for i in range(PIECE_BYTES // 4))
    assert len(text) > 2 * PIECE_BYTES
    df = spark.createDataFrame([(text, "en", "a"), ("alpha beta", "en", "b")], "text string, lang string, source string")
    got = {(r["source"], r["term"]): (r["count"], r["docs"]) for r in divergence.counted(df).collect()}
    want = Counter(text.split())
    assert {k[1]: v for k, v in got.items() if k[0] == "a" and k[1]} == {t: (n, 1) for t, n in want.items()} and got["b", "beta"] == (1, 1)


def test_counts_beyond_64_bits_of_a_product(spark):
    big = 3 * 10**13
    row = spark.range(1).select(divergence._share(F.lit(big), F.lit(2 * big), F.lit(5)).alias("x")).first()
    assert row["x"] == 1 + 10**9 * (big + 2) // (2 * big + 10)


def _wanted(sizes):
    """Targets as exact fractions: deal, stop those above twice their size, deal the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, out = Fraction(3, 2) * sum(sizes.values()), set(names), {}
    while open_:
        each = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * each > 2 * sizes[s]}
        if not over:
            return out | {s: weight[s] * each for s in open_}
        for s in over:
            out[s] = Fraction(2 * sizes[s])
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixing_meets_targets(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(i // 2 if i % 9 == 0 else i, None if rng.random() < 0.05 else prose(rng, int(rng.paretovariate(0.8)) % 3000), rng.choice(["a"] * 6 + ["b", "ç", "", None, "z", "empty"])) for i in range(300)]
    rows = [(d, "" if s == "empty" else t, s) for d, t, s in rows] + [(None, "no id", "a"), (7, "w " * 20_000, "z")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, target int, slot string")
    save(df, tmp_path, "documents")
    got = mixing.query(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.query(spark, str(tmp_path)).repartition(5).collect()), key=repr)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    assert sorted(((r["doc_id"], r["size"], r["source_size"]) for r in got), key=repr) == sorted(((d, len(WORD.findall(t or "")), sizes[s]) for d, t, s in rows), key=repr)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    want, by = _wanted(sizes), {n: s for s, n in sizes.items()}
    assert len(by) == len(sizes)  # sizes tell sources apart here
    taken = Counter()
    for r in got:
        s = by[r["source_size"]]
        assert r["target"] == pytest.approx(float(want[s]), rel=1e-12)
        taken[s] += r["taken"]
    assert all(taken[s] == int(want[s] + Fraction(1, 2)) for s in sizes)


def test_schedule_is_even_and_whole(spark):
    plan = mixing.targets(spark.createDataFrame([("a", 90_000), ("b", 400_000), ("c", 7_000), (None, 250_000), ("d", 0)], "source string, size long"))
    rows = sorted(mixing.schedule(plan, 100).collect(), key=lambda r: r["slot"])
    target = {r["at"]: r["target"] for r in plan.collect()}
    assert [r["slot"] for r in rows] == sorted({r["slot"] for r in rows})
    seen, total = Counter(), sum(target.values())
    for k, r in enumerate(rows):
        assert r["rank"] == seen[r["at"]]  # a source's slots come in order, each block after the one before
        seen[r["at"]] += 1
        if k % 50 == 49:
            assert all(abs(seen[s] - (k + 1) * t / total) < 8 for s, t in target.items())
    words = Counter()
    for r in rows:
        words[r["at"]] += r["length"]
    assert all(words[s] == int(t + 0.5) for s, t in target.items())


def test_mixing_of_sources_that_hold_nothing(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, None), (2, "  ", "b")], "doc_id long, text string, source string")
    assert {(r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"], r["slot"]) for r in mixing.mix(df).collect()} == {(1, 0, 0, 0.0, 0, None), (2, 0, 0, 0.0, 0, None)}
