import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from harborline.llm import decontam, fingerprints, langid, packing, toxicity
from harborline.llm.common import Words, pieces, shared_dir, text_buffers

from .helpers import WORD, corpus, frame, prose, save, sha


def test_shared_folder_is_needed_on_a_cluster():
    class Conf:
        def __init__(self, **k):
            self.of = k

        def get(self, key, default=None):
            return self.of.get(key, default)

        def set(self, key, value):
            self.of[key] = value

    class Session:
        def __init__(self, master):
            self.conf = Conf(**{"spark.master": master})
            self.sparkContext = self

        def getConf(self):
            return Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session("spark://host:7077"))
    assert shared_dir(Session("local[4]")).startswith("file:/")


def test_words_and_pieces():
    texts = [t for _, t in corpus(4)] + ["a", "b", "", "c"]
    raw, off = text_buffers(pa.array(texts, pa.string()))
    seen: dict = {}
    for most in (1, 300, 1 << 20):
        got = []
        for i, j in pieces(off, most):
            w = Words(raw, off[i : j + 1])
            words = [bytes(w.raw[a:b]).decode() for a, b in zip(w.start, w.end)]
            got += [words[a:b] for a, b in zip(w.first, w.first[1:])]
            for x, h in zip(words, w.hash.tolist()):
                assert seen.setdefault(x, h) == h  # the same wherever a word stands
        assert got == [WORD.findall(t or "") for t in texts]
    assert len(set(seen.values())) == len(seen)


def fold(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(rows, items):
    wins = [(k, tuple(w[i : i + 10])) for k, t in items if (w := fold(t)) for i in range(max(1, len(w) - 9))]
    out = {}
    for d, t in rows:
        w, hit, who = fold(t), set(), set()
        for k, win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    who.add(k)
        out[d] = (len(w), len(hit), len(who), sha(",".join(sorted(map(str, who)))), bool(hit))
    return out


@pytest.mark.parametrize("bound", [32 << 20, 200])
def test_contamination(spark, tmp_path, bound):
    rows = corpus(6)
    long = max((t for _, t in rows if t and len(t) < 2000), key=len)
    items = [(1, " ".join(long.split()[3:18])), (20, long.upper()[:90]), (3, "two, WORDS!"), (4, None), (5, "..."), (6, "nowhere to be found"), (20, "é ü ñ é")]
    items = [(k, t and t[:190]) for k, t in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    save(frame(spark, rows), tmp_path, "documents")
    save(bench, tmp_path, "benchmark")
    want = brute_contamination(rows, items)
    got = {r["doc_id"]: tuple(r)[1:] for r in decontam.query(spark, str(tmp_path)).collect()}
    assert got == want and any(x[4] for x in want.values())
    other = {r["doc_id"]: (r["n_hit"], sorted(r["items"])) for r in decontam.contamination(frame(spark, rows), bench, ["doc_id"], max_pattern_bytes=bound).collect()}
    assert {d: h for d, (h, _) in other.items()} == {d: x[1] for d, x in want.items()}
    # ids may be strings; repeated rows and rows without an id are scanned as any other
    named = bench.select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("item_id"), "text")
    again = frame(spark, [*rows, rows[0], (None, long)])
    got = decontam.contamination(again, named, ["doc_id", "lang"], max_pattern_bytes=bound).drop("lang").collect()
    assert len(got) == len(rows) + 2 and {i for r in got for i in r["items"]} == {f"q{i}" for _, ids in other.values() for i in ids}
    assert [r["n_hit"] for r in got if r["doc_id"] is None] == [next(want[d][1] for d, t in rows if t == long)]


def test_contamination_by_long_items_in_shards(spark):
    """An item longer than a shard takes at once: windows over the joints are found, and nothing else."""
    rng = random.Random(12)
    w = [f"{rng.getrandbits(30):x}" for _ in range(decontam.ITEM_WORDS + 5000)]
    at = decontam.ITEM_WORDS
    rows = [(1, " ".join(["x", *w[at - 7 : at + 8], "y"])), (2, " ".join(w[at : at + 9])), (3, " ".join(w[-12:] + w[:9])), (4, " ".join(w[at - 9 : at + 1]))]
    item = spark.createDataFrame([("a", " ".join(w)), ("b", "x"), ("c", None)], "item_id string, text string")
    for bound in (1 << 30, 300_000):
        got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontam.contamination(frame(spark, rows), item, ["doc_id"], max_pattern_bytes=bound).collect()}
        assert got == {1: (16, ["a", "b"]), 2: (0, []), 3: (12, ["a"]), 4: (10, ["a"])}, bound


def test_blocks_find_all_windows():
    rng = random.Random(13)
    for window in (1, 2, 5, 10):
        make = lambda n: [rng.choice(["a", "b", "cc"]) for _ in range(n)]
        items = [(k, " ".join(make(rng.randint(1, 3 * window)))) for k in range(4)]
        for _ in range(60):
            w = make(rng.randint(0, 40))
            hit, who = set(), set()
            for k, text in items:
                of = text.split()
                size = min(window, len(of))
                for i in range(len(of) - size + 1):
                    for j in range(len(w) - size + 1):
                        if w[j : j + size] == of[i : i + size]:
                            hit |= set(range(j, j + size))
                            who.add(k)
            spans, found = decontam.Machine(items, window).scan([x.encode() for x in w])
            assert {x for i, j in spans for x in range(i, j)} == hit and found == who


def test_contamination_spans_are_of_the_original(spark):
    text = "Är  ONE—two\tthree; End"
    bench = spark.createDataFrame([(1, "one—TWO three")], "item_id long, text string")
    r = decontam.contamination(frame(spark, [(1, text), (2, None)]), bench, ["doc_id"], clean=True).orderBy("doc_id").collect()
    a, b = r[0]["spans"][0]
    assert text[a:b] == "ONE—two\tthree" and r[0]["clean_text"] == "Är  ; End" and r[1]["clean_text"] is None
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(frame(spark, [(1, text)]), empty, ["doc_id"]).first()["n_hit"] == 0


def test_fingerprints(spark, tmp_path):
    rows = [(d, t) for d, t in corpus(7)]
    save(frame(spark, rows), tmp_path, "documents")
    got = {r["doc_id"]: r for r in fingerprints.query(spark, str(tmp_path)).collect()}
    order = sorted(rows, reverse=True)
    by_text: dict = {}
    for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == sha(e)
        assert by_text.setdefault(t, got[d]["fingerprint"]) == got[d]["fingerprint"]
        assert 0 <= got[d]["near_next"] <= 1
    assert len(set(by_text.values())) == len(by_text)
    long = [d for d, t in rows if t and len(t) > 200]
    assert np.mean([got[d]["near_edited"] for d in long]) > np.mean([got[d]["near_next"] for d in long]) + 0.2


def test_hashes_of_a_paragraph_are_independent(spark):
    """Each component starts from its own seed: none follows from another."""
    df = spark.range(200).select(fingerprints.equality(F.concat(F.lit("p"), F.col("id").cast("string"))).alias("e"))
    rows = [tuple(r["e"])[:4] for r in df.collect()]
    h = [F.xxhash64(F.lit(s), F.lit("p7")).bitwiseAND(fingerprints.EQUAL_MASK) for s in fingerprints.SEEDS]
    assert tuple(spark.range(1).select(*h).first()) == rows[7]
    # with a seed after the text all four would be functions of one hash of the text
    after = df.select(F.xxhash64(F.lit("p7"), F.lit(1)).bitwiseAND(fingerprints.EQUAL_MASK)).first()[0]
    assert after not in rows[7]
    bits = np.array([[x >> b & 1 for x in r for b in range(62)] for r in rows])
    assert np.abs(np.corrcoef(bits.T) - np.eye(248)).max() < 0.4
    empty = fingerprints.with_next(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.collect() == []


def test_fingerprints_are_sums(spark):
    texts = ["b\na\nc", "a\nb\nc", "a\nb", "c", "", "a\nb\nc\nc"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.struct(fingerprints.equality(F.col("t")).alias("equal"), fingerprints.counters(F.col("t")).alias("counts")).alias("f"))
    fp = {r["i"]: r["f"] for r in df.collect()}
    assert fp[0] == fp[1] != fp[5]
    a, b, c = (df.where(f"i = {i}").select(F.col("f").alias(n)) for i, n in ((2, "x"), (3, "y"), (1, "z")))
    r = a.crossJoin(b).crossJoin(c).select(fingerprints.add(F.col("x"), F.col("y")).alias("sum"), fingerprints.add(F.col("z"), F.col("y"), -1).alias("rest")).first()
    assert r["sum"] == fp[1] and r["rest"] == fp[2]


def test_likeness_of_long_texts(spark):
    rng = random.Random(9)
    lines = lambda n: "\n".join(f"{rng.getrandbits(40):x}" for _ in range(n))
    one, other = lines(100_000), lines(100_000)
    half = one[: len(one) // 2] + other[len(other) // 2 :]
    pairs = [(0, one, other), (1, one, half), (2, "ab cd\n" * 100, "ef gh\n" * 100), (3, "ab cd\n" * 100_000, "ef gh\n" * 100_000)]
    df = spark.createDataFrame(pairs, "i int, a string, b string")
    prints = df.select("i", *(f(F.col(c)).alias(c + k) for c in "ab" for k, f in (("e", fingerprints.equality), ("c", fingerprints.counters)))).checkpoint()
    signs = prints.select("i", "ae", "be", *(fingerprints.signs(F.col(c)).alias(c) for c in ("ac", "bc")))
    got = {r["i"]: r["x"] for r in signs.select("i", fingerprints.likeness(F.col("ae"), F.col("ac"), F.col("be"), F.col("bc")).alias("x")).collect()}
    assert got[0] < 0.4 and 0.3 < got[1] < 0.75 and abs(got[2] - got[3]) < 1e-9


def test_next_wraps_over_many_ranges(spark):
    ids = [5, 9, 2, 2, None, 7, 100, -4]
    df = spark.createDataFrame([(d, f"t{k}", k) for k, d in enumerate(ids)], "doc_id long, text string, k int")
    for buckets in (1, 3, 50):
        got = {r["k"]: r["next"]["k"] for r in fingerprints.with_next(df, buckets).collect()}
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, -(ids[k] or 0), [-ord(c) for c in f"t{k}"]))
        assert got == {a: b for a, b in zip(order, order[1:] + order[:1])}


def test_language_models():
    rng = random.Random(2)
    make = lambda letters: " ".join("".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(60))
    texts = {"aa": [make("aeioubc") for _ in range(40)], "bb": [make("aeiouxyz") for _ in range(40)]}
    m = langid.Model(texts)
    # probabilities of all next characters sum to one, after contexts seen and unseen
    for j in range(2):
        for context in ("ab", "ax", "zz"):
            chars = "".join(chr(c) for c in m.alphabet)
            raw, off = text_buffers(pa.array([context + c for c in chars] + [context + "ж", context + " "]))
            base, _, _ = m.entropy(*text_buffers(pa.array([context])))
            h, n, _ = m.entropy(raw, off)
            assert abs(np.exp(-(h[:, j] * n - base[0, j] * len(context))).sum() - 1) < 1e-3
    raw, off = text_buffers(pa.array([make("aeioubc"), make("aeiouxyz"), "12 ?!", None, ""], pa.string()))
    names, score, rejected, _ = m.predict(raw, off)
    assert names == ["aa", "bb", "und", "und", "und"] and list(rejected) == [False, False, True, True, True] and score[:2].min() > 0.9 and score[2] == 0
    raw, off = text_buffers(pa.array(["жщы жжж щы " * 5]))
    assert m.predict(raw, off)[2][0]  # nothing like the training texts


def test_language_query(spark, tmp_path):
    rng = random.Random(3)
    make = lambda letters: " ".join("".join(rng.choices(letters, k=4)) for _ in range(30))
    rows = [(i, make("aeioubc" if i % 2 else "aeiouxyz"), "aa" if i % 2 else "bb") for i in range(80)] + [(100, None, "aa"), (101, "--", None), (102, make("abc"), None)]
    save(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")), tmp_path, "documents")
    got = {r["doc_id"]: r for r in langid.query(spark, str(tmp_path)).collect()}
    assert len(got) == 83 and all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d in got)
    assert np.mean([got[d]["lang_pred"] == lang for d, _, lang in rows[:80]]) > 0.97
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == "und"
    # repeated rows and long texts, other columns, no rows
    more = [*rows, rows[0], (200, make("aeioubc") * 200, None)]
    save(spark.createDataFrame(more, "doc_id long, text string, lang string").withColumns({"lang_pred": F.lit(1), "held_out": F.lit("x")}), tmp_path, "documents")
    again = langid.query(spark, str(tmp_path)).collect()
    assert len(again) == 85 and len({tuple(r) for r in again if r["doc_id"] == 0}) == 1 and [r["lang_pred"] for r in again if r["doc_id"] == 200] == ["aa"]
    save(spark.createDataFrame([], "doc_id long, text string, lang string"), tmp_path, "documents")
    assert langid.query(spark, str(tmp_path)).collect() == []
    save(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang", F.lit(None).cast("string")), tmp_path, "documents")
    assert {r["lang_pred"] for r in langid.query(spark, str(tmp_path)).collect()} == {"und"}


def test_every_label_is_learned(spark):
    rows = [(i, f"text {i}", f"l{i % 300}") for i in range(600)] + [(1000 + i, f"{i} " + "long " * 30, "far" if i % 2 else "l0") for i in range(10)]
    got = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "lang", 2, 100)
    assert set(got) == {f"l{i}" for i in range(300)} | {"far"}
    assert sorted(got["l0"]) == ["text 0", "text 300"] and [len(t) for t in got["far"]] == [100, 100]


def _gradient_loss(net, v, index, gold):
    proj = net.inputs(v)
    z = net.run(proj, np.where(index >= 0, v.of[np.maximum(index, 0)], -1))
    return float(np.mean(np.log1p(np.exp(-np.where(gold == 1, z, -z)))))


def test_network_learns_and_its_gradient_is_right():
    rng = random.Random(1)
    texts = [prose(rng, 30) for _ in range(8)]
    net = toxicity.Network()
    v = toxicity.Vocabulary(*text_buffers(pa.array(texts)))
    index, at = toxicity.windows(v.first)
    index, gold = index[at[:-1]], np.array([0, 1] * 4, float)
    before = {k: p.copy() for k, p in net.p.items()}
    opt: dict = {"t": 0}
    rate = 1e-4
    start = _gradient_loss(net, v, index, gold)
    net.learn(v, index, gold, np.ones(8), opt, rate)
    moments = {k: m[0] * 10 for k, m in opt.items() if k != "t"}  # the first gradient
    net.p = {k: p.copy() for k, p in before.items()}
    for k in ("W", "U", "A", "v", "o", "b", "c"):
        flat = int(np.argmax(np.abs(moments[k])))
        step = 3e-2
        losses = []
        for sign in (1, -1):
            net.p[k] = before[k].copy()
            net.p[k].ravel()[flat] += sign * step
            losses.append(_gradient_loss(net, v, index, gold))
        net.p[k] = before[k].copy()
        assert abs((losses[0] - losses[1]) / (2 * step) - moments[k].ravel()[flat]) < 0.1 * abs(moments[k].ravel()[flat]) + 1e-4, k
    for _ in range(60):
        net.learn(v, index, gold, np.ones(8), opt, 0.02)
    assert _gradient_loss(net, v, index, gold) < start / 2


def test_toxicity_query(spark, tmp_path):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(240):
        w, bad = prose(rng, rng.choice([10, 40, 150])).split(), i % 4 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["moronic", "scumbag", "scumlike"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (902, "  ")]
    labels += [(900, None), (0, 1), (None, 1)]
    save(frame(spark, rows), tmp_path, "documents")
    save(spark.createDataFrame(labels, "doc_id long, toxic int"), tmp_path, "labels")
    got = {r["doc_id"]: r for r in toxicity.query(spark, str(tmp_path)).collect()}
    assert len(got) == 243 and all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d in got)
    held = [d for d in range(240) if got[d]["held_out"]]
    assert np.mean([got[d]["score"] for d in held if d % 4 == 0]) > np.mean([got[d]["score"] for d in held if d % 4]) + 0.4
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values()) and got[900]["score"] == got[901]["score"]
    net = toxicity.fitted(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    # equal texts score alike; one bad passage far inside a long text counts; other columns may have any name
    long = " ".join([prose(rng, 3000), "moronic scumbag scumlike moronic", prose(rng, 3000)])
    more = spark.createDataFrame([(1, long, "a"), (1, long, "b"), (None, prose(rng, 6000), None)], "doc_id long, text string, net string")
    out = {r["net"]: r["score"] for r in toxicity.score(more, net, ["doc_id", "net"]).collect()}
    assert out["a"] == out["b"] > out[None]
    assert toxicity.score(frame(spark, []), net, ["doc_id"]).collect() == []
    save(spark.createDataFrame([], "doc_id long, toxic int"), tmp_path, "labels")
    assert {r["score"] for r in toxicity.query(spark, str(tmp_path)).collect()} == {0.0}


def test_windows_cover_every_word():
    first = np.array([0, 0, 5, 29, 100, 124])
    index, at = toxicity.windows(first)
    for k in range(5):
        assert set(index[at[k] : at[k + 1]].ravel()) - {-1} == set(range(first[k], first[k + 1]))


def tokens(text):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(P.path("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids, 2]


def test_packing(spark, tmp_path):
    odd = [(5000 + i, t) for i, t in enumerate(["<|endoftext|> X", "É  a\u0085b\x1cc", "a.b, C. 'S x'. 12.", "<|STARTOFTEXT|>", "Ó. ﬁ. ²,", "word " * 9000])]
    rows = corpus(8) + odd + [(0, "again")]
    save(frame(spark, rows).repartition(5), tmp_path, "documents")
    got = packing.query(spark, str(tmp_path)).collect()
    want = sorted((d, tuple(tokens(t))) for d, t in rows)
    seqs: dict = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append(r)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 4096
    by: dict = {}
    for r in got:
        by.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    ids = {d: i for d, i in want if d}
    for (d, n), parts in by.items():
        if d:
            at = 0
            for r in sorted(parts, key=lambda r: r["start"]):
                assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[d][at : at + r["length"]], "<u4").tobytes())
                at += r["length"]
            assert at == n == len(ids[d])
    assert sum(r["length"] for r in got) == sum(len(i) for _, i in want)
    assert len({d for d, _ in by}) == len({d for d, _ in want})


def test_packing_is_bounded_and_tight():
    rng = random.Random(0)
    p = packing.Packer(0, 128, 4, 8)
    sizes = [rng.randint(1, 300) for _ in range(400)]
    for d, n in enumerate(sizes):
        p.add(d, np.arange(n, dtype=np.int32))
        assert len(p.open) <= 4
    packing._finish(p, 128)
    used: dict = {}
    for r in p.rows:
        used[r[5]] = used.get(r[5], 0) + r[2]
    assert sum(used.values()) == sum(sizes)
    padding = sum(0 if n & (n - 1) == 0 else 128 - n for n in used.values())
    assert padding < 0.05 * sum(sizes)


def test_other_tokenizers_are_refused():
    import public_tokenizers as P

    with pytest.raises(ValueError, match="lower-case"):
        packing.Encoder(P.path("byte_bpe_50k.json"))


def test_packing_nothing(spark, tmp_path):
    save(frame(spark, []), tmp_path, "documents")
    assert packing.query(spark, str(tmp_path)).collect() == []
    assert hashlib.sha256(b"").hexdigest() == sha("")


def test_blocks_that_many_items_share():
    """The cost of a block in a document does not grow with the items that hold it."""
    import time

    rng = random.Random(14)
    some = lambda n: " ".join(f"{rng.getrandbits(30):x}" for _ in range(n))
    took = {}
    for name, opening in (("shared", lambda: "which of the following is"), ("own", lambda: some(5))):
        items = [(k, f"{opening()} {some(25)}") for k in range(20_000)]
        machine = decontam.Machine(items)
        text = " ".join(f"which of the following is {some(3)}" for _ in range(500))
        w = decontam.words(f"{text} {items[7][1]} and {items[19_999][1]}")
        begun = time.perf_counter()
        for _ in range(20):
            spans, found = machine.scan(w)
        took[name] = time.perf_counter() - begun
        assert found == {7, 19_999}
        assert sum(j - i for i, j in decontam.merged(spans)) == 60
    assert took["shared"] < 2 * took["own"] + 0.5


def test_names_that_operators_use_themselves(spark):
    """Columns of any name may be kept."""
    from harborline.llm import substring_dedup

    names = ["__text", "text_", "spans_", "__m", "__at", "__ids", "at", "ids", "m", "kept", "doc", "u", "a.b"]
    rows = [(1, "One two three four five six seven eight nine ten eleven"), (2, None), (3, "five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.concat(F.lit(f"{n} "), F.col("doc_id")) for n in names})
    bench = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven"), (2, "five")], "item_id long, text string")
    keep = ["doc_id", *names, "text"]
    net = toxicity.train(["bad words here", "a kind text"] * 20, [1, 0] * 20)
    for bound in (1 << 20, 20):
        got = decontam.contamination(docs, bench, keep, max_pattern_bytes=bound)
        assert {r["doc_id"]: (r["n_hit"], r["items"]) for r in got.collect()} == {1: (10, [1, 2]), 2: (0, []), 3: (1, [2])}
        _as_they_were(got, names, rows)
    for got in (toxicity.score(docs, net, keep), langid.identify(docs, None, keep), substring_dedup.dedup(docs, keep=keep)):
        _as_they_were(got, names, rows)


def _as_they_were(got, names, rows):
    texts = dict(rows)
    for r in got.collect():
        assert r["text"] == texts[r["doc_id"]] and [r[n] for n in names] == [f"{n} {r['doc_id']}" for n in names]


def test_long_labelled_texts_are_learned(spark):
    """All labelled texts are longer than what is learned of one, and one id has many rows."""
    rng = random.Random(15)
    rows = [(k, " ".join(f"{rng.choice(['vile', 'nasty', 'filth'])} {prose(rng, 2)}" if k % 2 else prose(rng, 3) for _ in range(900))) for k in range(40)]
    docs = spark.createDataFrame([*rows, *[(1, f"{k} {rows[1][1]}") for k in range(30)]], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, toxic int")
    assert min(len(t) for _, t in rows) > toxicity.TRAIN_CHARS
    chosen = toxicity.sample(docs, labels)
    assert chosen.count() == 40 and chosen.agg(F.max(F.length("text"))).first()[0] == toxicity.TRAIN_CHARS
    net = toxicity.train_in_task(chosen)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs.dropDuplicates(["doc_id"]), net, ["doc_id"]).collect()}
    assert min(v for k, v in got.items() if k % 2) > max(v for k, v in got.items() if k % 2 == 0)
