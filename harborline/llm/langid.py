"""Language identification: an interpolated Kneser-Ney character model for each language.

Texts become lower-case letters with one space for each run of anything else. The models of all languages share one
sorted array of n-gram hashes for each order (a bijective mix of the packed characters, so no two n-grams meet), with a
column of log-probabilities for each language, and one of context hashes with back-off weights. A text gets the
language of the lowest cross-entropy a character. The margin to the runner-up, as a log-likelihood ratio, is calibrated
on training texts that the models have not seen, also in short snippets; a text whose calibrated score is below
`reject`, or whose cross-entropy lies above what its language shows on such texts, is rejected.

Models are fitted on a bounded sample: at most TRAIN_DOCS labelled rows of each language of up to TRAIN_CHARS
characters each, and windows of longer texts where a language has too few of these. Every language is learned, however
many there are, in memory for all n-grams times all languages. All texts are scored whole.

Defined cases: null texts and texts without letters are "und" with score 0; a single learned language gives score 1
for texts it does not reject; without any labelled row every text is "und"; ties go to the first language by name;
repeated rows are each scored, alike; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, nameless, pieces, table, text_buffers

ORDER = 4
#: Bounds of the training sample, for each language.
TRAIN_DOCS = 600
TRAIN_CHARS = 20_000
#: Share of the sample that calibrates instead of fitting.
HELD = 0.2
REJECT = 0.5
BITS = 12
ALPHABET = (1 << BITS) - 2  # 0: space, 1: a character not learned
_TABLE = 0x20000


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and letter-ness of code points below _TABLE; those above are taken for letters."""
    lower, letter = np.arange(_TABLE, dtype=np.uint32), np.zeros(_TABLE, bool)
    for c in range(_TABLE):
        s = chr(c)
        if s.isalpha():
            letter[c] = True
            t = s.lower()
            if len(t) == 1:
                lower[c] = ord(t)
    return lower, letter


_LOWER: np.ndarray | None = None
_LETTER: np.ndarray | None = None


def symbols(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of texts with 0 between words and around each text; the n+1 offsets of texts in them."""
    global _LOWER, _LETTER
    if _LOWER is None:
        _LOWER, _LETTER = _tables()
    base = int(offsets[0])
    data = raw[base : int(offsets[-1])]
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets - base]
    small = np.minimum(code, _TABLE - 1)
    letter = _LETTER[small] | (code >= _TABLE)
    code = np.where(letter, np.where(code < _TABLE, _LOWER[small], code), 0)
    # each text starts anew after a 0
    n = len(offsets) - 1
    code = np.insert(code, chars[:-1], 0)
    start = chars[:-1] + np.arange(n)
    first = np.zeros(len(code), bool)
    first[start] = True
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0) | first[1:]
    at = np.concatenate([np.cumsum(keep)[start] - 1, [int(keep.sum())]])
    return code[keep], at


class Model:
    """The fitted models of all languages; plain arrays, so that it can be broadcast."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER):
        self.langs, self.order = sorted(texts), order
        fit = {k: v[: max(1, len(v) - int(HELD * len(v)))] for k, v in texts.items()}
        coded = {k: symbols(*text_buffers(pa.array(v, pa.string()))) for k, v in fit.items()}
        seen, n = np.unique(np.concatenate([c for c, _ in coded.values()]), return_counts=True)
        best = np.argsort(-n, kind="stable")[: ALPHABET]
        self.alphabet = np.sort(seen[best][seen[best] != 0])
        self._fit({k: self._ids(*c) for k, c in coded.items()})
        self._calibrate({k: v[len(fit[k]) :] or v for k, v in texts.items()})

    def _ids(self, code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.minimum(np.searchsorted(self.alphabet, code), len(self.alphabet) - 1)
        return np.where(code == 0, 0, np.where(self.alphabet[i] == code, i + 2, 1)).astype(np.uint64), at

    def _grams(self, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        """The k-gram that ends at each symbol; before the start of a text lie spaces."""
        out = ids.copy()
        place = np.arange(len(ids)) - np.repeat(at[:-1], np.diff(at))
        for back in range(1, k):
            before = np.zeros(len(ids), np.uint64)
            before[back:] = ids[:-back]
            before[place < back] = 0
            out |= before << np.uint64(BITS * back)
        return out

    def _fit(self, ids: dict) -> None:
        shift, V = np.uint64(BITS), len(self.alphabet) + 2
        L = len(self.langs)
        self.grams, self.contexts = [], []
        below: tuple | None = None  # keys and probabilities of the order below
        raw = {k: [np.unique(self._grams(*v, o), return_counts=True) for o in range(1, self.order + 1)] for k, v in ids.items()}
        for o in range(1, self.order + 1):
            keys = np.unique(np.concatenate([raw[k][o - 1][0] for k in self.langs] + ([np.arange(V, dtype=np.uint64)] if o == 1 else [])))
            prob = np.zeros((len(keys), L))
            contexts = np.unique(keys >> shift)
            gamma = np.ones((len(contexts), L))
            for j, lang in enumerate(self.langs):
                g, c = raw[lang][o - 1]
                if o < self.order:  # continuation counts: how many symbols come before
                    longer = raw[lang][o][0]
                    g, c = np.unique(longer & np.uint64((1 << (BITS * o)) - 1), return_counts=True)
                n1, n2 = int((c == 1).sum()), int((c == 2).sum())
                D = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
                ctx, where = np.unique(g >> shift, return_inverse=True)
                total, types = np.bincount(where, c), np.bincount(where)
                weight = np.ones(len(contexts))
                spot = np.searchsorted(contexts, ctx)
                weight[spot] = D * types / total
                own = np.zeros(len(keys))
                own[np.searchsorted(keys, g)] = (c - D) / total[where]
                lower = np.full(len(keys), 1 / V) if o == 1 else below[1][np.searchsorted(below[0], keys & np.uint64((1 << (BITS * (o - 1))) - 1)), j]
                prob[:, j] = own + weight[np.searchsorted(contexts, keys >> shift)] * lower
                gamma[:, j] = weight
            below = keys, prob
            self.grams.append(self._sorted(keys, prob))
            self.contexts.append(self._sorted(contexts, gamma))

    @staticmethod
    def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys.copy())
        order = np.argsort(h)
        return h[order], np.log(values[order]).astype(np.float32)

    def entropy(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats a symbol of each text under each language, its symbols, and how many are letters."""
        code, at = symbols(raw, offsets)
        ids, at = self._ids(code, at)
        top = self._grams(ids, at, self.order)
        total = np.zeros((len(ids), len(self.langs)), np.float32)
        left = np.arange(len(ids))
        for o in range(self.order, 0, -1):
            keys, values = self.grams[o - 1]
            gram = top[left] & np.uint64((1 << (BITS * o)) - 1)
            h = mix(gram.copy())
            i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            found = keys[i] == h
            total[left[found]] += values[i[found]]
            left, gram = left[~found], gram[~found]
            if not len(left):
                break
            keys, values = self.contexts[o - 1]
            h = mix(gram >> np.uint64(BITS))
            i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            found = keys[i] == h
            total[left[found]] += values[i[found]]
        # the 0 that opens a text counts for nothing
        total[at[:-1]] = 0
        n = np.diff(at) - 1
        sums = np.add.reduceat(total, at[:-1], dtype=np.float64)
        letters = np.add.reduceat((code != 0).astype(np.int64), at[:-1])
        return -sums / np.maximum(n, 1)[:, None], n, letters

    def _calibrate(self, held: dict[str, list[str]]) -> None:
        texts, gold = [], []
        for j, lang in enumerate(self.langs):
            for t in held[lang]:
                words = t.split()
                for snippet in (t, " ".join(words[:1]), " ".join(words[:3]), " ".join(words[-10:])):
                    texts.append(snippet)
                    gold.append(j)
        raw, off = text_buffers(pa.array(texts, pa.string()))
        h, n, letters = self.entropy(raw, off)
        gold_, ok = np.array(gold), letters > 0
        best, z = self._margin(h, n)
        right = (best == gold_)[ok].astype(float)
        x = z[ok]
        # logistic regression of being right on the margin, by Newton's method with a little shrinkage
        w = np.array([0.0, 1.0])
        X = np.stack([np.ones(len(x)), x], 1)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
            g = X.T @ (p - right) + 0.01 * w
            H = (X * (p * (1 - p))[:, None]).T @ X + 0.01 * np.eye(2)
            w = w - np.clip(np.linalg.solve(H, g), -2, 2)
        self.scale = (float(w[0]), max(0.0, float(w[1])))
        # what a language's own whole texts cost at most, with room
        self.worst = np.array([np.quantile(h[(gold_ == j) & ok & (n >= 20), j], 0.99) * 1.3 if ((gold_ == j) & ok & (n >= 20)).any() else np.inf for j in range(len(self.langs))])

    def _margin(self, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best = np.argmin(h, 1)
        if h.shape[1] == 1:
            return best, np.full(len(h), 10.0)
        two = np.partition(h, 1, axis=1)
        return best, np.log1p((two[:, 1] - two[:, 0]) * n)

    def predict(self, raw: np.ndarray, offsets: np.ndarray, reject: float = REJECT) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, rejected and cross-entropy of each text."""
        h, n, letters = self.entropy(raw, offsets)
        best, z = self._margin(h, n)
        score = 1 / (1 + np.exp(-np.clip(self.scale[0] + self.scale[1] * z, -30, 30)))
        none = letters == 0
        score[none] = 0
        low = h[np.arange(len(h)), best]
        names = [("und" if e else self.langs[j]) for j, e in zip(best, none)]
        return names, score, none | (score < reject) | (low > self.worst[best]), np.where(none, np.nan, low)


def sample(rows: DataFrame, label: str, most: int, max_chars: int = TRAIN_CHARS) -> dict[str, list[str]]:
    """At most `most` texts of each label, those of the smallest hashes; texts of 1 to max_chars characters and, for labels that
    have fewer than `most` of them, windows of max_chars characters from longer texts."""
    rows = rows.select(F.col("doc_id"), F.col("text"), F.col(label).cast("string").alias("label")).where("label is not null and text != ''")
    rows = rows.withColumns({"h": F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)), "long": F.length("text") > max_chars})
    counts: dict[str, dict[bool, int]] = {}
    for r in rows.groupBy("label", "long").count().collect():
        counts.setdefault(r["label"], {})[r["long"]] = r["count"]
    if not counts:
        return {}
    below: dict[bool, list] = {False: [], True: []}
    for k, n in sorted(counts.items()):
        wanted = most
        for long in (False, True):
            if wanted > 0 and n.get(long):
                below[long] += [F.lit(k), F.lit(int((1 << 40) * min(1.0, 1.3 * wanted / n[long] + 20 / n[long]))).cast("long")]
            wanted -= n.get(long, 0)
    at = lambda pairs: F.create_map(*pairs)[F.col("label")] if pairs else F.lit(None).cast("long")
    start = (F.col("h") % (F.length("text") - max_chars + 1) + 1).cast("int")
    text = F.when(F.col("long"), F.substr("text", start, F.lit(max_chars))).otherwise(F.col("text")).alias("text")
    chosen = rows.where(F.col("h") < F.when(F.col("long"), at(below[True])).otherwise(at(below[False])))
    found: dict[str, list[tuple]] = {}
    # about 1.3 times `most` rows of each label reach the driver
    for r in chosen.select("label", "long", "h", text).toLocalIterator():
        found.setdefault(r["label"], []).append((r["long"], r["h"], r["text"]))
    return {k: [t for _, _, t in sorted(v)[:most]] for k, v in found.items()}


def train(labelled: DataFrame, most: int = TRAIN_DOCS, order: int = ORDER) -> Model | None:
    """Models of the column lang of labelled (doc_id, text, lang)."""
    texts = sample(labelled, "lang", most)
    return Model(texts, order) if texts else None


def identify(documents: DataFrame, model: Model | None, keep: list[str], reject: float = REJECT) -> DataFrame:
    """The kept columns and lang_pred (not yet rejected), score, rejected, cross_entropy."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kept = documents.select(*(documents[f"`{c}`"] for c in keep)).schema

    def run(parts):
        m = shared.value
        for batch in parts:
            raw, off = text_buffers(batch.column(len(keep)))
            parts_ = [[], [], [], []]
            for i, j in pieces(off):
                got = m.predict(raw, off[i : j + 1], reject) if m else (["und"] * (j - i), np.zeros(j - i), np.ones(j - i, bool), np.full(j - i, np.nan))
                for a, b in zip(parts_, got):
                    a.extend(b)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(parts_[0], pa.string()), pa.array(parts_[1], pa.float64()), pa.array(parts_[2], pa.bool_()), pa.array(parts_[3], pa.float64(), from_pandas=True)],
                names=[*keep, "lang_pred", "score", "rejected", "cross_entropy"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return nameless(documents.select(*(documents[f"`{c}`"] for c in keep), "text")).mapInArrow(run, f"{fields}, lang_pred string, score double, rejected boolean, cross_entropy double")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))))
    rows = documents.select("doc_id", "text", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"))
    return identify(rows, model, ["doc_id", "held_out"])
