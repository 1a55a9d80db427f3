"""Small tables and brute-force versions for the corpus operators."""

import hashlib
import itertools
import random
import re

from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0D]+")
SYLLABLES = ["the", "on", "er", "an", "re", "he", "in", "ed", "nd", "ha"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


def corpus(seed: int = 1) -> list[tuple]:
    """(doc_id, text): copies, near copies, shared passages, nulls, empty and long texts, repeated words."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(30)]
    passage = prose(rng, 40)
    texts: list = list(base)
    for b in base[:8]:
        w = b.split()
        for _ in range(rng.randint(1, 5)):
            c = list(w)
            for _ in range(rng.randint(0, 3)):
                c[rng.randrange(len(c))] = "changed" + str(rng.randint(0, 9))
            texts.append(" ".join(c))
    for _ in range(12):
        texts.append(prose(rng, rng.randint(0, 30)) + "\n" + passage[: rng.randint(60, len(passage))] + "\t" + prose(rng, rng.randint(0, 30)))
    texts += [None, "", "   ", "one", "two words", "la " * 70, base[0], base[0].upper(), prose(rng, 3000), "é ü ñ " * 12]
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    """As documents, with extra columns whose names operators use themselves."""
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_words": F.lit("x"), "score": F.lit(None).cast("double"), "lang": F.lit("en"), "source": F.lit("s")})


def save(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def brute_substrings(rows, window=20):
    seen, gone = {}, {}
    docs = {d: WORD.findall(t or "") for d, t in rows}
    for d in sorted(docs):
        w = docs[d]
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), (d, i))
    for d, w in docs.items():
        cut = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] < (d, i):
                cut |= set(range(i, i + window))
        gone[d] = (len(w), len(cut), sha(" ".join(x for j, x in enumerate(w) if j not in cut)))
    return gone


def brute_components(rows, percent=75, k=5):
    def shingles(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}
