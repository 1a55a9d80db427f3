"""Set similarity join of word n-grams: universe partition with a pigeonhole over segments, verified exactly.

A document's set holds its distinct shingles of five words. Two sets r and s with Jaccard similarity of at least 0.75
differ in at most H = (|r| + |s|) / 7 shingles. Sizes fall into bands by powers of two; a band hashes all shingles into
M segments, so if s differs from r in at most H shingles and r spends a budget of H + 1 over its segments, some segment
with allowance e >= 0 differs by at most e. A set is indexed in its own band and, if a set a third larger can lie there,
in the next. Allowances are

* -1: the segment is not looked at (always so for empty ones, which nearly all sets would share),
* 0: it must be equal, found by a hash of the segment's shingles (gain 1),
* 1: it may differ by one shingle, found by the hashes of the segment with each shingle left out (gain 2). Offered to sets
  of up to SMALL shingles, where these hashes are few; a longer set would need as many as it has shingles.

How often each hash occurs is counted over all documents, and every set spends its budget where it meets the fewest
others. Most sets have enough segments that no other set shares, and are done: nothing can be similar to them.

Hashes travel packed: each task sorts its own into blobs by bucket, so a shuffle has a few rows for each task and bucket.
Equal sets of a task send their hashes once, so groups of copies do not pile up in a bucket.

Candidates of a hash are not paired with each other. First each meets the least document of its hash only; those pairs
are verified and give components. A hash whose documents are in one component is done. Sets that meet a set of another
component in some hash are partitioned once more, as finely as can be: each shingle is a segment, its cost is how many of
these sets have it, and a set spends on the cheapest. Of |r & s| >= t shingles in common at least one is among the
|r| - t + 1 cheapest of r and the |s| - t + 1 cheapest of s, so only sets of different components that meet there are
paired. A member of a large group that is too far from its centre differs from it in more shingles than that, and these
are its own: it meets nobody, however large the group.

Defined cases: null and word-less texts have an empty set, linked with nothing; texts below five words are one shingle;
of rows that repeat a doc_id each is linked by its own text and all are one node; a null doc_id is linked with nothing.
An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, mix, pieces, release, rolling, shuffle_partitions, stage, table, text_buffers, trimmed, unstage
from .components import connected

SHINGLE = 5
#: Similarity as a percentage.
PERCENT = 75
SMALL = 256
#: The bits of the hash of a set that tell sets of one doc_id apart.
TAG = 0x7FFF
#: The bits of a hash that travel: 56 of 64, the rest compress to nothing. Hashes that meet by chance cost a look, not a link.
KEPT = 0xFFFFFFFFFFFFFF00
#: Hashes a task holds before it sends them.
HELD = 600_000
#: Rows for which budgets are spent at a time.
SPENT = 100_000


def distance(total: int, percent: int = PERCENT) -> int:
    """How many shingles two sets of `total` shingles together may differ in."""
    return (100 - percent) * total // (100 + percent)


def distance_array(total: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return (100 - percent) * total // (100 + percent)


class Band:
    """Sets of lo to hi shingles, and the segments that they are hashed into."""

    def __init__(self, number: int, percent: int = PERCENT):
        self.number, self.lo, self.hi, self.percent = number, 1 << number, (2 << number) - 1, percent
        self.segments = math.ceil(1.3 * (distance(2 * self.hi, percent) + 1)) + 10

        # segments that a set of n shingles may spend its budget on: enough that are not empty, with room; never fewer for a larger set
        n = np.arange(self.lo, self.hi + 1)
        need = (100 - percent) * 2 * n // (100 + percent) + 1
        room = np.ceil((1.1 * need + 14) / (1 - np.exp(-n / self.segments)))
        self._used = np.minimum(self.segments, np.maximum.accumulate(room)).astype(np.int64)

    def used(self, n: np.ndarray) -> np.ndarray:
        return self._used[np.clip(n, self.lo, self.hi) - self.lo]

    def indexed(self, n: np.ndarray) -> np.ndarray:
        """Segments in which a set is indexed that may have partners of up to n * 100 / percent shingles in this band."""
        return self.used(100 * n // self.percent)


_BANDS: dict[tuple[int, int], Band] = {}


def band(number: int, percent: int = PERCENT) -> Band:
    if (number, percent) not in _BANDS:
        _BANDS[number, percent] = Band(number, percent)
    return _BANDS[number, percent]


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of texts, one text after another, and the n+1 offsets of texts in them."""
    w = Words(raw, offsets, lower=True)
    h, n = w.hash, np.diff(w.first)
    doc = w.doc()
    gram = rolling(h, k)
    ok = doc[: len(gram)] == doc[k - 1 :] if len(gram) else np.zeros(0, bool)
    keys, owners = [gram[ok]], [doc[: len(gram)][ok]]
    for i in np.flatnonzero((n > 0) & (n < k)):
        keys.append(rolling(h[w.first[i] : w.first[i + 1]], int(n[i])))
        owners.append(np.array([i]))
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    if len(key):
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        key, owner = key[new], owner[new]
    return key, np.searchsorted(owner, np.arange(len(n) + 1))


def set_hashes(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set."""
    out = []
    for seed in (0x51, 0xC3):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(key + np.uint64(seed)))])
        out.append(mix(total[at[1:]] - total[at[:-1]] + np.uint64(seed)))
    return out[0], out[1]


#: Flags of a hash: of a segment that the set may spend on; with one shingle left out; of a segment with two shingles or more.
OWN, DELETED, FAT = 1, 2, 4


def signatures(key: np.ndarray, at: np.ndarray, which: np.ndarray, percent: int = PERCENT) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """Of the sets numbered in `which`: rows (hash, set number, flags, segment), and for all sets how many segments they may
    spend on beyond their budget (slack) and how many of these have two shingles or more (fat, for small sets)."""
    n = np.diff(at)
    number = np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1
    token = mix(key ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    chosen = np.zeros(len(n), bool)
    chosen[which] = True
    chosen &= n > 0
    slack, fat = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    out: list[tuple] = []
    for b in np.unique(number[chosen]):
        for up in (0, 1):
            B = band(int(b) + up, percent)
            sets = np.flatnonzero(chosen & (number == b) & ((100 * n >= percent * B.lo) if up else True))
            if not len(sets):
                continue
            size = n[sets]
            limit = B.indexed(size)
            row = np.repeat(np.arange(len(sets)), size)
            pick = np.arange(size.sum()) + np.repeat(at[sets] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
            t = token[pick]
            seg = ((t >> np.uint64(20)) % np.uint64(B.segments)).astype(np.int64)
            keep = seg < limit[row]
            t, place = t[keep], row[keep] * B.segments + seg[keep]
            order = np.argsort(place, kind="stable")
            place, t = place[order], t[order]
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(place)), bool), place[1:] != place[:-1]]))
            if not len(first):
                continue
            inner = mix(t.copy())
            value = np.add.reduceat(inner, first)
            count = np.diff(np.append(first, len(t)))
            r, s = place[first] // B.segments, place[first] % B.segments
            if not up:
                usable = s < B.used(size)[r]
                slack[sets] = np.bincount(r[usable], minlength=len(sets)) - (distance_array(2 * size, percent) + 1)
                fat[sets] = np.where(size <= SMALL, np.bincount(r[usable & (count > 1)], minlength=len(sets)), 0)
            own = np.where((not up) & (s < B.used(size)[r]), OWN, 0)
            salt = mix(s.astype(np.uint64) + np.uint64((B.number + 1) << 40))
            # a longer set has one row a segment, so that the segment's number need not travel
            seg = np.where((size[r] <= SMALL) & (own > 0), s, 0)
            out.append((mix(value ^ salt), sets[r], (own | np.where((count > 1) & (size[r] <= SMALL), FAT, 0)).astype(np.uint8), seg))
            ok = np.repeat((count > 1) & (size[r] <= SMALL), count)
            if ok.any():
                less = np.repeat(value, count)[ok] - inner[ok]
                out.append((mix(less ^ np.repeat(salt, count)[ok]), sets[np.repeat(r, count)[ok]], (np.repeat(own, count)[ok] | DELETED | FAT).astype(np.uint8), np.repeat(seg, count)[ok]))
    if not out:
        z = np.zeros(0, np.int64)
        return (z.astype(np.uint64), z, z.astype(np.uint8), z), slack, fat
    return tuple(np.concatenate(x) for x in zip(*out)), slack, fat


# -- packed hashes -------------------------------------------------------------------------------------------------


def _planes(a: np.ndarray) -> bytes:
    """Bytes of equal weight together, which compress."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


_ROW = (np.uint64, np.uint32, np.uint8, np.uint16)  # hash, number of the document in the blob, flags, segment
_DOC = (np.int64, np.uint32, np.int16, np.uint8, np.int32)  # doc, n, slack, fat, tag


def pack(sig: np.ndarray, doc: np.ndarray, n: np.ndarray, slack: np.ndarray, fat: np.ndarray, tag: np.ndarray, flags: np.ndarray, seg: np.ndarray) -> bytes:
    """Rows sorted by hash; what is known of a set stands once. A tag tells sets of one doc_id apart."""
    order = np.lexsort((n, tag, doc))
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order[1:]] != c[order[:-1]] for c in (doc, tag, n)])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    first = order[new]
    head = np.array([len(sig), len(first)], np.int64).tobytes()
    rows = [np.diff(sig, prepend=np.uint64(0)), number, flags, seg]
    docs = [c[first] for c in (doc, n, slack, fat, tag)]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(_planes(c.astype(k)) for c, k in zip([*rows, *docs], _ROW + _DOC)))


def unpack(blob: bytes) -> list[np.ndarray]:
    """sig, doc, n, slack, fat, tag, flags, seg."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    lengths, at, out = data[:16].view(np.int64), 16, []
    for i, kind in enumerate(_ROW + _DOC):
        n, width = int(lengths[int(i >= len(_ROW))]), np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(data[at : at + n * width].reshape(width, n).T).view(kind).ravel())
        at += n * width
    sig, number, flags, seg, *docs = out
    return [np.cumsum(sig, dtype=np.uint64), *(c[number] for c in docs), flags, seg]


def _documents(documents: DataFrame, shingle: int) -> DataFrame:
    """doc, n and hashes of the set of each document."""

    def run(parts):
        for batch in parts:
            raw, off = text_buffers(batch.column(1))
            for i, j in pieces(off):
                key, at = shingle_sets(raw, off[i : j + 1], shingle)
                h1, h2 = set_hashes(key, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at).astype(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=["doc", "n", "h1", "h2"])

    return documents.mapInArrow(trimmed(run), "doc long, n long, h1 long, h2 long")


_BLOB = pa.schema([("bucket", pa.int64()), ("blob", pa.binary()), ("doc", pa.int64()), ("n", pa.int64())])


def _blobs(documents: DataFrame, buckets: int, percent: int, shingle: int) -> DataFrame:
    """Packed hashes of a bucket; and with bucket -1 the doc and n of sets whose segments fall short of their budget."""

    def run(parts):
        held: list[list] = []
        count = 0

        def flush():
            columns = [np.concatenate(x) for x in zip(*held)]
            order = np.argsort(columns[0])
            columns = [c[order] for c in columns]
            edge = np.searchsorted(columns[0], np.array([b * (1 << 64) // buckets for b in range(1, buckets)], np.uint64))
            cuts = [0, *edge.tolist(), len(order)]
            made = [(b, pack(*(c[i:j] for c in columns))) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
            for i in range(0, len(made), 64):
                some = made[i : i + 64]
                none = pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in some], pa.int64()), pa.array([x for _, x in some], pa.binary()), none, none], schema=_BLOB)

        met: set = set()
        for batch in parts:
            null = np.asarray(batch.column(0).is_null())
            ids = np.asarray(batch.column(0).fill_null(0)).astype(np.int64)
            raw, off = text_buffers(batch.column(1))
            for i, j in pieces(off):
                key, at = shingle_sets(raw, off[i : j + 1], shingle)
                h1, h2 = set_hashes(key, at)
                n = np.diff(at)
                # of the sets this task has met before nothing more is sent
                fresh = []
                for k, pair in enumerate(zip(h1.tolist(), h2.tolist())):
                    if n[k] and not null[i + k] and pair not in met:
                        met.add(pair)
                        fresh.append(k)
                (sig, row, flags, seg), slack, fat = signatures(key, at, np.array(fresh, np.int64), percent)
                if (short := np.flatnonzero(slack + fat < 0)).size:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(short), -1)), pa.nulls(len(short), pa.binary()), pa.array(ids[i + short]), pa.array(n[short].astype(np.int64))], schema=_BLOB)
                tag = (h1 & np.uint64(TAG)).astype(np.int32)
                held.append([sig & np.uint64(KEPT), ids[i + row], n.astype(np.uint32)[row], np.clip(slack, -32768, 32767).astype(np.int16)[row], fat.astype(np.uint8)[row], tag[row], flags, seg.astype(np.uint16)])
                count += len(sig)
                if count >= HELD:
                    yield from flush()
                    held, count = [], 0
                    if len(met) > 1_000_000:
                        met = set()
        if count:
            yield from flush()

    return documents.mapInArrow(trimmed(run), "bucket long, blob binary, doc long, n long")


_SHARED = pa.schema([("sig", pa.int64()), ("doc", pa.int64()), ("n", pa.int64()), ("slack", pa.int32()), ("fat", pa.int32()), ("tag", pa.int32()), ("flags", pa.int32()), ("seg", pa.int64()), ("full", pa.int64()), ("less", pa.int64())])


def _shared(blobs: DataFrame) -> DataFrame:
    """Rows of hashes that two documents or more have, with how many have it full (full) or with one left out (less). Rows
    without a hash name sets whose segments fall short."""

    def emit(held):
        columns = [np.concatenate(x) for x in zip(*(unpack(b) for b in held))]
        held.clear()
        # most hashes are met once
        order = np.argsort(columns[0], kind="stable")
        sig = columns[0][order]
        again = np.concatenate([[False], sig[1:] == sig[:-1]])
        again[:-1] |= again[1:]
        order = order[again]
        if not len(order):
            return
        columns = [c[order] for c in columns]
        order = np.lexsort((columns[5], columns[1], columns[0]))
        sig, doc, n, slack, fat, tag, flags, seg = (c[order] for c in columns)
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        many = np.diff(np.append(first, len(sig)))
        docs = np.add.reduceat(np.concatenate([[True], (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]).astype(np.int64), first)
        full = np.add.reduceat((flags & DELETED == 0).astype(np.int64), first)
        ok = np.repeat((docs > 1) & (full > 0), many)
        full, less = np.repeat(full, many)[ok], np.repeat(many - full, many)[ok]
        rows = [sig[ok].view(np.int64), doc[ok], n[ok], slack[ok], fat[ok], tag[ok], flags[ok], seg[ok], full, less]
        for i in range(0, len(full), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000]).cast(f.type) for c, f in zip(rows, _SHARED)], schema=_SHARED)

    def run(parts):
        current, held = None, []
        for batch in parts:
            for b, blob, doc, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3)):
                if b < 0:
                    yield pa.RecordBatch.from_pylist([{"doc": doc.as_py(), "n": n.as_py()}], schema=_SHARED)
                    continue
                if b != current:
                    if held:
                        yield from emit(held)
                    current, held = b, []
                held.append(blob.as_py())
        if held:
            yield from emit(held)

    ddl = "sig long, doc long, n long, slack int, fat int, tag int, flags int, seg long, full long, less long"
    return blobs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(run), ddl)


def allocate(group: np.ndarray, seg: np.ndarray, flags: np.ndarray, full: np.ndarray, less: np.ndarray, n: np.ndarray, slack: np.ndarray, fat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spend the budget of each set where it costs least.

    Rows are the shared hashes of sets 0.. (group); n, slack, fat stand once for each set. Segments without a shared hash cost
    nothing. Another shared segment costs the sets that have it too; allowance 1 costs further those with one left out.
    Returns the allowance of each row's segment (-1: not looked at), and for each set whether it is done: nothing that it
    has to spend on costs anything.
    """
    own = np.flatnonzero(flags & OWN)
    width = int(seg.max()) + 1 if len(seg) else 1
    where, place = np.unique(group[own] * width + seg[own], return_inverse=True)
    of = where // width
    deleted = flags[own] & DELETED > 0
    add = lambda w: np.bincount(place, weights=w, minlength=len(where)).astype(np.int64)
    cost = add(np.where(deleted, 0, full[own] - 1))
    further = add(np.where(deleted, full[own], less[own]))
    more = (add(flags[own] & FAT) > 0) & (n[of] <= SMALL)
    touched = np.bincount(of, minlength=len(n))
    need = touched - slack - np.where(n <= SMALL, fat - np.bincount(of[more], minlength=len(n)), 0)
    # of a segment the first allowance never comes after the second
    price = np.concatenate([cost, np.maximum(cost, further)[more]])
    item = np.concatenate([np.arange(len(where)), np.flatnonzero(more)])
    second = np.arange(len(item)) >= len(where)
    order = np.lexsort((second, price, of[item]))
    at = of[item[order]]
    rank = np.arange(len(order)) - np.searchsorted(at, at)
    pays = price[order] > 0
    spent = (rank < need[at]) | ~pays
    allowance = np.bincount(item[order][spent], minlength=len(where)) - 1
    done = np.bincount(at[spent & pays], minlength=len(n)) == 0
    out = np.full(len(group), -1, np.int64)
    out[own] = allowance[place]
    return out, done


_CHOSEN = pa.schema([("sig", pa.int64()), ("doc", pa.int64()), ("tag", pa.int32()), ("deleted", pa.bool_()), ("probe", pa.int32())])


def _choose(shared: DataFrame) -> DataFrame:
    """The rows of shared with probe: 0 not looked up, 1 among full segments, 2 also among those with one left out. A set whose
    budget is met where nobody else is looks nowhere: no set of this size or less can be similar."""

    def decide(columns):
        sig, doc, n, slack, fat, tag, flags, seg, full, less = columns
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (n[1:] != n[:-1]) | (tag[1:] != tag[:-1])])
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        # a longer set has one row a segment
        seg = np.where(n > SMALL, np.arange(len(n)) - first[group], seg)
        e, done = allocate(group, seg, flags, full, less, n[first], slack[first], fat[first])
        deleted = flags & DELETED > 0
        probe = np.where(deleted, e == 1, np.where(e < 0, 0, e + 1)) * ~done[group]
        yield from pa.Table.from_arrays([pa.array(c).cast(f.type) for c, f in zip((sig, doc, tag, deleted, probe), _CHOSEN)], schema=_CHOSEN).to_batches(50_000)

    def run(parts):
        held: list[list] = []
        count = 0
        for batch in parts:
            held.append([np.asarray(c) for c in batch.columns])
            count += batch.num_rows
            if count < SPENT:
                continue
            columns = [np.concatenate(c) for c in zip(*held)]
            # the last set may go on in the next batch
            other = np.flatnonzero((columns[1] != columns[1][-1]) | (columns[2] != columns[2][-1]) | (columns[5] != columns[5][-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from decide([c[:cut] for c in columns])
            held = [[c[cut:].copy() for c in columns]]
            count = len(held[0][0])
        if count:
            yield from decide([np.concatenate(c) for c in zip(*held)])

    return shared.repartition("doc").sortWithinPartitions("doc", "n", "tag").mapInArrow(trimmed(run), "sig long, doc long, tag int, deleted boolean, probe int")


def _sets(documents: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """doc, h1, t, p of the documents named in wanted: a hash of the set, the shingles, and a bit for each of 64 * 2^k classes of them that tells whether it
    has an odd number. Where the bits of two sets differ, so do the sets, once at least."""

    def run(parts):
        for batch in parts:
            raw, off = text_buffers(batch.column(1))
            for i, j in pieces(off, 1 << 18):
                key, at = shingle_sets(raw, off[i : j + 1], shingle)
                words = 1 << np.maximum(0, np.ceil(np.log2(np.maximum(1, np.diff(at)) / 16)).astype(np.int64))
                where = np.concatenate([[0], np.cumsum(words)])
                owner = np.repeat(np.arange(j - i), np.diff(at))
                h = mix(key ^ np.uint64(0x3C3C3C3C3C3C3C3C))
                parity = np.zeros(where[-1], np.uint64)
                np.bitwise_xor.at(parity, where[owner] + ((h >> np.uint64(6)).astype(np.int64) & (words[owner] - 1)), np.uint64(1) << (h & np.uint64(63)))
                lists = [pa.ListArray.from_arrays(pa.array(a.astype(np.int32)), pa.array(v.view(np.int64))) for a, v in ((at, key), (where, parity))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(set_hashes(key, at)[0].view(np.int64)), *lists], names=["doc", "h1", "t", "p"])

    return documents.join(wanted, "doc", "left_semi").mapInArrow(trimmed(run), "doc long, h1 long, t array<bigint>, p array<bigint>")


def _folded(p: Column, size: Column) -> Column:
    """Parities of half as many classes, if size is half."""
    return F.when(F.size(p) == size, p).otherwise(F.zip_with(F.slice(p, F.lit(1), size), F.slice(p, size + 1, size), lambda x, y: x.bitwiseXOR(y)))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are similar. Parities, an eighth as large as the sets, first drop what is certainly too far apart; the
    shingles of what is left are counted."""
    far = sets.select("doc", "p", F.size("t").alias("n"))
    a, b = (far.select(F.col("doc").alias(k), F.col("p").alias(f"p{k}"), F.col("n").alias(f"n{k}")) for k in "uv")
    size = F.least(F.size("pu"), F.size("pv"))
    apart = F.aggregate(F.zip_with(_folded(F.col("pu"), size), _folded(F.col("pv"), size), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    near = (100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")) & (apart * (100 + percent) <= (100 - percent) * (F.col("nu") + F.col("nv")))
    left = stage(pairs.join(a, "u").join(b, "v").where(near).select("u", "v"), "jaccard-near")
    a, b = sets.select(F.col("doc").alias("u"), F.col("t").alias("a")), sets.select(F.col("doc").alias("v"), F.col("t").alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    return left.join(a, "u").join(b, "v").where(100 * shared >= percent * (F.size("a") + F.size("b") - shared)).select("u", "v")


def _least(n: str, m: str, percent: int) -> str:
    """SQL for how many shingles similar sets of n and m have in common at least."""
    return f"(({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent})"


def _tops(rows: DataFrame) -> DataFrame:
    """g, top, lo of the shingles whose rows (g, c, n) are in several components: the one with the most rows, and the least n."""
    most = rows.groupBy("g", "c").agg(F.count("*").alias("k"), F.min("n").alias("lo"))
    most = most.groupBy("g").agg(F.max(F.struct("k", "c")).alias("top"), F.count("*").alias("several"), F.min("lo").alias("lo"))
    return stage(most.where("several > 1").select("g", F.col("top.c").alias("top"), "lo"), "jaccard-tops")


def _apart(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs u < v of documents that may be similar, of sets (doc, h1, n, c, t) of different c: each shingle is a segment, and
    sets spend on those that the fewest have."""
    shingles = sets.select("doc", "h1", "n", "c", F.explode("t").alias("g"))
    many = stage(shingles.groupBy("g").agg(F.count("*").alias("f")).where("f > 1"), "jaccard-frequent")
    of_set = Window.partitionBy("doc", "h1")
    # place in the order of costs, after the shingles that nobody else has
    at = F.col("n") - F.count("*").over(of_set) + F.row_number().over(of_set.orderBy("f", "g")) - 1
    cheap = shingles.join(many, "g").withColumn("at", at).where(F.expr(f"100 * at <= {100 - percent} * n")).drop("h1", "f")
    cheap = stage(cheap, "jaccard-cheap")
    unstage(many)
    # a shingle that no set has cheap enough for the sizes that meet there is not looked at, so one that all of a group have is no rendezvous
    reach = f"at <= n - {_least('n', f'greatest(lo, {percent} * n div 100)', percent)}"
    m = stage(cheap.join(_tops(cheap), "g").where(reach).drop("lo"), "jaccard-meet")
    unstage(cheap)
    x, m = (m.select("g", *(F.col(c).alias(c + k) for c in ("doc", "n", "c", "at"))) for k, m in (("v", m), ("u", m.where("c != top"))))
    least = _least("nu", "nv", percent)
    near = f"cu != cv and 100 * nv >= {percent} * nu and 100 * nu >= {percent} * nv and atu <= nu - {least} and atv <= nv - {least}"
    pairs = m.withColumnRenamed("g", "gu").join(x, F.expr(f"g = gu and {near}"))
    return pairs.select(F.least("docu", "docv").alias("u"), F.greatest("docu", "docv").alias("v")).where("u != v").distinct()


def components(documents: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, buckets: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc"), "text")
    docs = stage(_documents(rows, shingle), "jaccard-docs")
    shared = stage(_shared(_blobs(rows, buckets or 4 * shuffle_partitions(spark), percent, shingle)), "jaccard-shared")
    release(spark)
    chosen = stage(_choose(shared.where("sig is not null")), "jaccard-chosen")
    weak = stage(shared.where("sig is null").select("n").distinct(), "jaccard-weak")
    unstage(shared)
    known = docs.where("doc is not null and n > 0")
    # aggregates are tables of their own: a join whose sides are both dealt anew can be split where a key is hot
    probed = stage(chosen.groupBy("sig").agg(F.max("probe").alias("p"), F.min(F.when(~F.col("deleted"), F.col("doc"))).alias("d0")).where("p > 0").drop("p"), "jaccard-hashes")
    meet = stage(chosen.join(probed, "sig").select("sig", "doc", "tag", "d0"), "jaccard-probed")
    unstage(chosen)
    unstage(probed)
    release(spark)
    wanted = meet.select("doc")
    # sets whose segments fall short of their budget are compared with all of their size; the room given to segments makes these next to none
    short = None
    if weak.limit(1).count():
        sizes = weak.select(F.explode(F.expr(f"sequence(cast(ceil({percent} * n / 100) as bigint), n * 100 div {percent})")).alias("n")).distinct()
        short = stage(known.join(sizes, "n", "left_semi").select("doc", "h1"), "jaccard-short")
        wanted = wanted.unionByName(short.select("doc"))
    sets = stage(_sets(rows, wanted.distinct(), shingle), "jaccard-sets")
    release(spark)
    pair = (F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    first = stage(meet.where("doc != d0").select(F.col("d0").alias("u"), F.col("doc").alias("v")).select(*pair).distinct(), "jaccard-pairs")
    edges = stage(_verified(first, sets, percent), "jaccard-edges")
    release(spark)
    classes = stage(known.groupBy("h1", "h2", "n").agg(F.min("doc").alias("u"), F.count("*").alias("c")).where("c > 1").drop("c"), "jaccard-classes")
    copies = known.join(classes, ["h1", "h2", "n"]).where("doc != u").select("u", F.col("doc").alias("v"))
    found = connected(edges.unionByName(copies))
    # sets that meet one of another component, each once
    label = found.select(F.col("node").alias("doc"), F.col("component").alias("c"))
    placed = stage(meet.select("sig", "doc", "tag").join(label, "doc", "left").withColumn("c", F.coalesce("c", "doc")), "jaccard-placed")
    unstage(meet)
    several = stage(placed.groupBy("sig").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least != most").select("sig"), "jaccard-several")
    mixed = placed.join(several, "sig").select("doc", "tag", "c").distinct()
    mixed = known.join(mixed, "doc").where(F.col("h1").bitwiseAND(TAG).cast("int") == F.col("tag")).select("doc", "h1", "h2", "n", "c")
    if short is not None:
        mixed = mixed.unionByName(known.join(short, ["doc", "h1"], "left_semi").join(label, "doc", "left").select("doc", "h1", "h2", "n", F.coalesce("c", "doc").alias("c")))
    mixed = stage(mixed.groupBy("h1", "h2", "n").agg(F.min(F.struct("doc", "c")).alias("m")).select("m.doc", "h1", "n", "m.c"), "jaccard-mixed")
    unstage(placed)
    release(spark)
    second = _apart(sets.select("doc", "h1", "t").join(mixed, ["doc", "h1"]), percent)
    second = stage(second.join(first, ["u", "v"], "left_anti"), "jaccard-second")
    release(spark)
    more = stage(_verified(second, sets, percent), "jaccard-more")
    if more.limit(1).count():
        found = connected(edges.unionByName(copies).unionByName(more))
    result = docs.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles")).join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    return result.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT u, v FROM p JOIN n a ON u = a.doc_id JOIN n b ON v = b.doc_id WHERE 100 * k >= 75 * (a.n + b.n - k)
), r AS (
  SELECT doc_id AS node, doc_id AS seen FROM d
  UNION
  SELECT r.node, e.v FROM r JOIN e ON r.seen = e.u
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(seen) FROM r WHERE node = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""
