"""Toxicity scores: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as an embedding of its hash joined with the maximum over embeddings of its character n-grams (4 and 5
bytes, with marks at both ends). Windows of WINDOW words that overlap by half run through the network, the attention
pools each window, and a text scores as its worst window; a logistic curve fitted on held-back training texts turns
that into 0 to 1. All windows of all texts are scored, so no part of a long text is left out.

Training has labels of texts only. Both embedding tables start with one column of smoothed log-odds of the hashes, which
points to likely windows; the network learns from these and then, twice, from the windows it finds worst itself: the
worst of a toxic text is toxic, all of a clean text are clean.

The network is fitted on a bounded sample: at most TRAIN_DOCS labelled texts of each class, of up to TRAIN_CHARS
characters each. Where these are too few, that many characters from some place of longer texts are added.

Defined cases: null and word-less texts score as a window without words; without rows of both classes every score is
the share of toxic rows (0 if there are none); repeated rows get equal scores, and one of the rows of a doc_id is learned
from; null labels are not used. A long text is
scored in runs of BLOCK windows, one after another. Empty documents give no rows, empty labels scores of 0. Columns of any
name may be kept but "score" and "predicted".
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, mix, nameless, pieces, table, text_buffers, trimmed

WINDOW = 24
STRIDE = 12
#: Windows that run through the network at a time.
BLOCK = 8192
TRAIN_DOCS = 2500
TRAIN_CHARS = 10_000
THRESHOLD = 0.7
TABLE = 1 << 16
WORD_DIM = CHAR_DIM = 8
HIDDEN = 8
GRAMS = (4, 5)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Vocabulary:
    """The distinct words of some texts: hash buckets, and buckets of their character n-grams (CSR)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.words = w = Words(raw, offsets, lower=True)
        self.first = w.first
        hashes, where, self.of = np.unique(w.hash, return_index=True, return_inverse=True)
        self.word = (hashes & np.uint64(TABLE - 1)).astype(np.int64)
        start, end = w.start[where], w.end[where]
        # bytes of the distinct words, one mark before and after each
        n = end - start + 2
        at = np.concatenate([[0], np.cumsum(n)])
        data = np.full(at[-1], 1, np.uint64)
        inner = np.arange(at[-1]) - np.repeat(at[:-1], n)
        body = (inner > 0) & (inner < np.repeat(n, n) - 1)
        data[body] = w.raw[np.repeat(start, n - 2) + inner[body] - 1]
        owner = np.repeat(np.arange(len(n)), n)
        grams, owners = [], []
        for k in GRAMS:
            size = len(data) - k + 1
            if size <= 0:
                continue
            h = np.full(size, k, np.uint64)
            for i in range(k):
                h = h * np.uint64(257) + data[i : i + size]
            ok = owner[:size] == owner[k - 1 :]
            grams.append(mix(h[ok]))
            owners.append(owner[:size][ok])
        # every word has one gram at least: itself
        grams.append(mix(hashes + np.uint64(7)))
        owners.append(np.arange(len(n)))
        owners = np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        self.gram = (np.concatenate(grams)[order] & np.uint64(TABLE - 1)).astype(np.int64)
        self.gram_at = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(n)))])


def window_counts(first: np.ndarray) -> np.ndarray:
    n = np.diff(first)
    return np.where(n <= WINDOW, 1, -(-(n - WINDOW) // STRIDE) + 1)


def window_block(first: np.ndarray, at: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Of windows i to j: the word index of each place (-1: none), and the text. at: the n+1 offsets of texts in the windows."""
    number = np.arange(i, j)
    text = np.searchsorted(at, number, "right") - 1
    index = (first[text] + (number - at[text]) * STRIDE)[:, None] + np.arange(WINDOW)
    return np.where(index < first[text + 1][:, None], index, -1), text


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word index of each place of each window (-1: none), and the n+1 offsets of texts in the windows."""
    at = np.concatenate([[0], np.cumsum(window_counts(first))])
    return window_block(first, at, 0, int(at[-1]))[0], at


class Network:
    """Parameters and passes; arrays have the direction first: 0 reads forwards, 1 backwards."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) * 0.15).astype(np.float32)
        D, H = WORD_DIM + CHAR_DIM, HIDDEN
        self.p = {
            "word": f(TABLE, WORD_DIM), "char": f(TABLE, CHAR_DIM), "W": f(D, 6 * H) * 2, "b": np.zeros(6 * H, np.float32), "U": f(2, H, 3 * H),
            "A": f(2 * H, H) * 2, "v": f(H) * 2, "o": f(2 * H) * 2, "c": np.full(1, -1.0, np.float32),
        }
        self.scale, self.prior = (1.0, 0.0), None

    def inputs(self, v: Vocabulary) -> np.ndarray:
        """Projected inputs of the distinct words, with a row of zeros for no word at the end."""
        x = np.concatenate([self.p["word"][v.word], np.maximum.reduceat(self.p["char"][v.gram], v.gram_at[:-1])], 1) if len(v.word) else np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        return np.concatenate([x @ self.p["W"] + self.p["b"], np.zeros((1, 6 * HIDDEN), np.float32)])

    def run(self, proj: np.ndarray, index: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows. index: rows of proj, -1 where there is no word. keep: gets what the way back needs."""
        H, (B, T) = HIDDEN, index.shape
        mask = (index >= 0).astype(np.float32)
        states = np.empty((T, B, 2 * H), np.float32)
        steps = []
        for d in (0, 1):
            h = np.zeros((B, H), np.float32)
            U = self.p["U"][d]
            for t in range(T) if d == 0 else range(T - 1, -1, -1):
                a = proj[index[:, t], 3 * H * d : 3 * H * (d + 1)]
                hu = h @ U
                zr = 1 / (1 + np.exp(-(a[:, : 2 * H] + hu[:, : 2 * H])))
                z, g = zr[:, :H], zr[:, H:]
                n = np.tanh(a[:, 2 * H :] + g * hu[:, 2 * H :])
                m = mask[:, t : t + 1]
                new = h + m * (1 - z) * (n - h)
                if keep is not None:
                    steps.append((d, t, h, z, g, n, hu[:, 2 * H :], m))
                h = new
                states[t, :, d * H : (d + 1) * H] = h
        u = np.tanh(states @ self.p["A"])
        e = np.exp(np.clip(u @ self.p["v"], -20, 20)) * mask.T
        alpha = e / np.maximum(e.sum(0), 1e-9)
        pooled = np.einsum("tb,tbk->bk", alpha, states)
        if keep is not None:
            keep.append((steps, states, u, alpha, pooled))
        return pooled @ self.p["o"] + self.p["c"][0]

    def learn(self, v: Vocabulary, index: np.ndarray, gold: np.ndarray, weight: np.ndarray, opt: dict, rate: float) -> None:
        """One step of Adam on windows whose index counts words of v.of."""
        H, p = HIDDEN, self.p
        used, local = np.unique(np.where(index >= 0, v.of[index], -1), return_inverse=True)
        local = local.reshape(index.shape)
        if used[0] < 0:
            used, local = used[1:], local - 1
        lo, hi = v.gram_at[used], v.gram_at[used + 1]
        n = hi - lo
        at = np.concatenate([[0], np.cumsum(n)])
        gram = v.gram[np.arange(at[-1]) - np.repeat(at[:-1] - lo, n)]
        emb = p["char"][gram]
        top = np.maximum.reduceat(emb, at[:-1])
        hit = emb == np.repeat(top, n, 0)
        x = np.concatenate([p["word"][v.word[used]], top], 1)
        proj = np.concatenate([x @ p["W"] + p["b"], np.zeros((1, 6 * H), np.float32)])
        kept: list = []
        logit = self.run(proj, local, kept)
        steps, states, u, alpha, pooled = kept[0]
        d_logit = ((_sigmoid(logit) - gold) * weight / len(gold)).astype(np.float32)
        g = {"o": pooled.T @ d_logit, "c": np.array([d_logit.sum()])}
        d_pooled = d_logit[:, None] * p["o"]
        d_alpha = np.einsum("bk,tbk->tb", d_pooled, states)
        d_states = alpha[:, :, None] * d_pooled
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(0))
        g["v"] = np.einsum("tb,tbk->k", d_e, u)
        d_u = d_e[:, :, None] * p["v"] * (1 - u * u)
        g["A"] = np.einsum("tbi,tbj->ij", states, d_u)
        d_states += d_u @ p["A"].T
        d_proj = np.zeros_like(proj)
        g["U"] = np.zeros_like(p["U"])
        back = {0: np.zeros((len(gold), H), np.float32), 1: np.zeros((len(gold), H), np.float32)}
        for d, t, h, z, r, nn, hun, m in reversed(steps):
            dh = back[d] + d_states[t, :, d * H : (d + 1) * H]
            dn = dh * m * (1 - z) * (1 - nn * nn)
            dz = dh * m * (h - nn) * z * (1 - z)
            dr = dn * hun * r * (1 - r)
            da = np.concatenate([dz, dr, dn], 1)
            dhu = np.concatenate([dz, dr, dn * r], 1)
            g["U"][d] += h.T @ dhu
            np.add.at(d_proj[:, 3 * H * d : 3 * H * (d + 1)], local[:, t], da)
            back[d] = dh * (1 - m * (1 - z)) + dhu @ p["U"][d].T
        d_proj = d_proj[:-1]
        g["W"], g["b"] = x.T @ d_proj, d_proj.sum(0)
        d_x = d_proj @ p["W"].T
        opt["t"] += 1
        for k, q in g.items():
            m, s = opt.setdefault(k, [np.zeros_like(p[k]), np.zeros_like(p[k])])
            m += 0.1 * (q - m)
            s += 0.001 * (q * q - s)
            p[k] -= rate * (m / (1 - 0.9 ** opt["t"])) / (np.sqrt(s / (1 - 0.999 ** opt["t"])) + 1e-8)
        # the tables learn by plain steps; the column of log-odds stays as it was counted
        d_word, d_char = d_x[:, :WORD_DIM].copy(), np.repeat(d_x[:, WORD_DIM:], n, 0) * hit
        d_word[:, 0] = d_char[:, 0] = 0
        np.add.at(p["word"], v.word[used], -10 * rate * d_word)
        np.add.at(p["char"], gram, -10 * rate * d_char)

    def window_logits(self, v: Vocabulary, index: np.ndarray, most: int = BLOCK) -> np.ndarray:
        proj = self.inputs(v)
        rows = np.where(index >= 0, v.of[index], -1) if len(v.of) else index
        return np.concatenate([self.run(proj, rows[i : i + most]) for i in range(0, len(rows), most)])

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """0 to 1 for each text."""
        if self.prior is not None:
            return np.full(len(offsets) - 1, self.prior)
        return _sigmoid(self.scale[0] * self.worst(raw, offsets).astype(np.float64) + self.scale[1])

    def worst(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The highest logit of any window of each text."""
        v = Vocabulary(raw, offsets)
        proj = self.inputs(v)
        at = np.concatenate([[0], np.cumsum(window_counts(v.first))])
        out = np.full(len(at) - 1, -np.inf, np.float32)
        for i in range(0, int(at[-1]), BLOCK):
            index, owner = window_block(v.first, at, i, min(int(at[-1]), i + BLOCK))
            rows = np.where(index >= 0, v.of[index], -1) if len(v.of) else index
            np.maximum.at(out, owner, self.run(proj, rows))
        return out


class _Counts:
    """How many texts of each class have each bucket."""

    def __init__(self):
        self.n = np.zeros((2, TABLE), np.int64)

    def add(self, buckets: np.ndarray, docs: np.ndarray, gold: np.ndarray) -> None:
        pair = np.unique(buckets * len(gold) + docs)
        bucket, doc = pair // len(gold), pair % len(gold)
        for k in (0, 1):
            self.n[k] += np.bincount(bucket[gold[doc] == k], minlength=TABLE)

    def log_odds(self, n0: int, n1: int) -> np.ndarray:
        """How much more of the toxic texts have a bucket, smoothed, within -1 and 1.5."""
        neg, pos = self.n
        odds = np.log((pos + 0.4) / (n1 + 0.8)) - np.log((neg + 0.4) / (n0 + 0.8))
        odds[pos + neg == 0] = 0
        z = odds / np.sqrt(1 / (pos + 0.4) + 1 / (neg + 0.4))
        return np.clip(np.where(np.abs(z) > 2, odds, odds * 0.2) / 3, -1, 1.5).astype(np.float32)


def _levels(net: Network, v: Vocabulary, index: np.ndarray, hint: bool) -> np.ndarray:
    """What is thought of each window: by log-odds of its words, or by the network."""
    if not hint:
        return net.window_logits(v, index)
    if not len(v.word):
        return np.full(len(index), -9.0)
    word = net.p["word"][v.word, 0] + np.maximum.reduceat(net.p["char"][v.gram, 0], v.gram_at[:-1])
    return np.where(index >= 0, word[v.of[np.maximum(index, 0)]], -9).max(1)


def _window_text(v: Vocabulary, row: np.ndarray) -> str:
    w, row = v.words, row[row >= 0]
    return bytes(w.raw[w.start[row[0]] : w.end[row[-1]]]).decode()


def train(texts: list[str], gold: list[int], seed: int = 7, rounds: int = 3, epochs: int = 3) -> Network:
    """Texts are gone through in small pieces each time; only the windows that a round learns from are kept."""
    net, y = Network(seed), np.array(gold, np.int64)
    if len(set(gold)) < 2:
        net.prior = float(y.mean()) if len(y) else 0.0
        return net
    r = np.random.default_rng(seed)
    held = r.random(len(y)) < 0.2
    if held[y == 1].sum() < 5:
        held[:] = False  # too few rows: calibrate on what was learned
    raw, off = text_buffers(pa.array(texts, pa.string()))
    word, char = _Counts(), _Counts()
    for i, j in pieces(off):
        v, own = Vocabulary(raw, off[i : j + 1]), y[i:j]
        docs = np.repeat(np.arange(j - i), np.diff(v.first))
        use = ~held[i:j][docs]
        seen = np.unique(v.of[use] * (j - i) + docs[use])  # distinct (word, text)
        w, doc = seen // (j - i), seen % (j - i)
        word.add(v.word[w], doc, own)
        n = v.gram_at[w + 1] - v.gram_at[w]
        to = np.concatenate([[0], np.cumsum(n)])
        char.add(v.gram[np.arange(to[-1]) - np.repeat(to[:-1] - v.gram_at[w], n)], np.repeat(doc, n), own)
    totals = int((1 - y)[~held].sum()), int(y[~held].sum())
    net.p["word"][:, 0], net.p["char"][:, 0] = word.log_odds(*totals), char.log_odds(*totals)
    opt: dict = {"t": 0}
    for turn in range(rounds):
        chosen: list[str] = []
        t: list[int] = []
        for i, j in pieces(off):
            v = Vocabulary(raw, off[i : j + 1])
            index, at = windows(v.first)
            level = _levels(net, v, index, turn == 0)
            for k in range(i, j):
                a, b = at[k - i], at[k - i + 1]
                if held[k] or index[a, 0] < 0:
                    continue
                # the worst window of a toxic text; of a clean one the two worst and one at random
                top = a + np.argsort(-level[a:b], kind="stable")[: 2 - y[k]]
                some = top if y[k] else np.append(top, a + r.integers(b - a))
                chosen += [_window_text(v, index[x]) for x in some]
                t += [int(y[k])] * len(some)
        gold_ = np.array(t, np.float64)
        if len(set(t)) < 2:
            break
        weight = np.where(gold_ == 1, len(t) / (2 * gold_.sum()), len(t) / (2 * (1 - gold_).sum()))
        v = Vocabulary(*text_buffers(pa.array(chosen, pa.string())))
        index, at = windows(v.first)
        index = index[at[:-1]]
        for _ in range(max(epochs, -(-60 * 128 // len(t)))):
            mixed = r.permutation(len(t))
            for i in range(0, len(t), 128):
                b = mixed[i : i + 128]
                net.learn(v, index[b], gold_[b], weight[b], opt, 0.01 if turn < rounds - 1 else 0.004)
    worst = np.concatenate([net.worst(raw, off[i : j + 1]) for i, j in pieces(off)]).astype(np.float64)
    fit = held if held.any() else np.ones(len(y), bool)
    X, t_, w_ = np.stack([worst[fit], np.ones(fit.sum())], 1), y[fit], np.array([1.0, 0.0])
    for _ in range(50):
        q = _sigmoid(X @ w_)
        H = (X * (q * (1 - q))[:, None]).T @ X + np.diag([0.5, 0.05])
        w_ = w_ - np.clip(np.linalg.solve(H, X.T @ (q - t_) + np.array([0.5 * (w_[0] - 1), 0.05 * w_[1]])), -1, 1)
    net.scale = (max(0.05, float(w_[0])), float(w_[1]))
    return net


def sample(documents: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS) -> DataFrame | None:
    """toxic, long, h, text of some more than `most` labelled texts of each class, by hash of doc_id. Only ids within that bound are
    joined to the texts. Of longer texts it is `max_chars` characters from some place; of rows that repeat an id, one. None without labels."""
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not counts:
        return None
    limit = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int((1 << 40) * min(1.0, 1.2 * most / n + 20 / n))).cast("long"))])
    ids = rows.where(F.col("h") < limit[F.col("toxic")]).distinct()
    start = (F.pmod(F.xxhash64("text"), F.length("text") - max_chars + 1) + 1).cast("int")
    texts = documents.select("doc_id", "text", (F.length("text") > max_chars).alias("long")).join(F.broadcast(ids), "doc_id").where(F.length("text") > 0)
    texts = texts.withColumn("text", F.when(F.col("long"), F.substr("text", start, F.lit(max_chars))).otherwise(F.col("text")))
    return texts.groupBy("doc_id", "toxic", "h").agg(F.min(F.struct("long", "text")).alias("of")).select("toxic", "of.long", "h", "of.text")


def train_in_task(rows: DataFrame, most: int = TRAIN_DOCS) -> Network:
    """The network of the first `most` rows (toxic, long, h, text) of each class, parts of long texts last. One task trains it, so that the driver holds
    neither the texts nor what training needs; another executor does so again if that one is lost."""

    def run(parts):
        by: dict[int, list] = {0: [], 1: []}
        for batch in parts:
            for toxic, *row in zip(*(c.to_pylist() for c in batch.columns)):
                by[toxic].append(row)
        chosen = [(t, k) for k in (0, 1) for _, _, t in sorted(by[k])[:most]]
        net = train([t for t, _ in chosen], [k for _, k in chosen])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])

    got = rows.repartition(1).mapInArrow(trimmed(run), "net binary").collect()
    return pickle.loads(got[0]["net"]) if got else train([], [])


def score(documents: DataFrame, net: Network, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns and score, predicted."""
    shared = documents.sparkSession.sparkContext.broadcast(net)
    kept = documents.select(*(documents[f"`{c}`"] for c in keep)).schema

    def run(parts):
        m = shared.value
        for batch in parts:
            raw, off = text_buffers(batch.column(len(keep)))
            got = np.concatenate([m.scores(raw, off[i : j + 1]) for i, j in pieces(off)]) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(got, pa.float64()), pa.array((got >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return nameless(documents.select(*(documents[f"`{c}`"] for c in keep), "text")).mapInArrow(trimmed(run), f"{fields}, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fitted(documents: DataFrame, labels: DataFrame) -> Network:
    """The network of the labels that are not held out."""
    rows = sample(documents, labels.where(~held_out(F.col("doc_id"))))
    return train([], []) if rows is None else train_in_task(rows)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    net = fitted(documents, table(spark, sf_dir, "labels"))
    return score(documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), net, ["doc_id", "held_out"])
