"""N-gram Jaccard join by parity sketches.

A document is its set of distinct word shingles (64-bit hashes).  XOR-hashing
the set gives two sketches:

* a bit sketch of 2^j >= n bits in which every shingle toggles one bit.  The
  Hamming distance of two such sketches is at most the size of the sets'
  symmetric difference.  Halves XOR to the sketch of half the length, so
  sketches of neighbouring sizes can be compared;
* for each size band, ``p`` words: the hash space is cut into ``p`` ranges and
  a range's word is the XOR of its shingles.

Sets with Jaccard >= t differ in at most (1-t)/(1+t) (a+b) shingles, which is
at most n/3 for the smaller set at t = 0.75.  A band has more ranges than
that, so by the pigeonhole principle a linked pair agrees in at least one
range that is not empty: pairs are looked for among equal words only.  A
document with too few non-empty ranges for that promise also gives its single
shingles as words, so two such documents meet there.  Bands follow the size
of the smaller set; a document also takes part in the band below when it can
be the larger one.

A set with ``w`` words in a band agrees with a linked one in at least
``w - n/3`` of them, not just in one.  By the prefix principle two sets that
agree in ``s`` words still share one when each leaves out up to ``s - 1`` of its
last words in one common order.  So every document leaves the largest of its
groups, as many as this bound allows: a passage that thousands of documents
share is then no reason to compare them, and no linked pair is lost.

Words meet in hash shards, packed as byte blocks.  A band has its own shards, by
its share of the words, so that a set's words go to few of them and its id, sent
once a shard, costs little beside them at any size of the corpus.  Groups of equal words:

* up to ``SMALL`` members: all pairs;
* more, of the members that have not left: pairs with the least member
  (linear).  After these are verified, only groups with members in different
  components go on (of groups with the same members, one): their sketches are
  folded to about their sizes in bits and compared in blocks, which gives a
  spanning forest of the pairs within the Hamming bound.  Once that is verified,
  the sets that these pairs join, each once, are compared in blocks again where
  they are of different components still, now with their exact sets: a block gives
  a spanning forest of its links.
  So copies are never expanded into all pairs, no call returns more pairs than it
  has members, and no link between different components is missed.

Other pairs within the Hamming bound are verified on the exact shingle sets of
their texts: first one pair a set, then those whose sets are still in different
components.
Equal sets are one class throughout (64-bit set hash), so exact copies cost one
entry a batch.

Defined results: null or blank text: empty set, linked with nothing, its own
component; fewer than five words: the whole sequence is the one shingle;
repeated rows are copies; a null doc_id is no candidate for a component's
least id unless all are null; extra columns are ignored; empty table: empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandlens.llm.common import WORD, cut, prepare
from demandlens.llm.components import components
from demandlens.llm.shingles import mix, shingle_set

K = 5
NUM, DEN = 75, 100          # linked when DEN * intersection >= NUM * union
BAND = 1.75                 # ratio of a band's sizes; above DEN / NUM
SMALL = 6
SPARE = 2                   # words kept beyond the bound, for words that share a 32-bit key
BLOCK = 2048
VOLUME = 4_000_000          # shingles of a block whose exact sets are compared
SHARD_ENTRIES = 1_200_000
FLUSH_ENTRIES = 1_500_000
DOCS_A_FLUSH = 4000         # below 2^12: a block's entries number its sets in 12 bits
SLICE = 256
PACKS = 8                   # calls a shuffle partition that compare groups of one block
MARKS = 32                  # bits a key of the filter that holds back texts not asked for
MOST_MARKS = 1 << 26        # most bits of that filter: a broadcast of 8 MB

_EDGES = [1]
while _EDGES[-1] < 1 << 40:
    _EDGES.append(max(_EDGES[-1] + 1, int(_EDGES[-1] * BAND)))


def most_apart(n: int) -> int:
    """The largest symmetric difference that a set of ``n`` can have with a linked one."""
    return n * (DEN - NUM) // NUM


def spaces(n: int) -> list[tuple[int, int]]:
    """(band, ranges) in which a set of ``n`` shingles takes part."""
    own, low = bisect_right(_EDGES, n) - 1, bisect_right(_EDGES, -(-n * NUM // DEN)) - 1
    out = []
    for band in {own, low}:
        d = most_apart(_EDGES[band + 1] - 1)
        out.append((band, d + 3 + -(-d * 40 // 100)))
    return out


def set_id(s: np.ndarray) -> int:
    """64-bit hash of a set, as a signed long."""
    return int(mix(np.array([mix(s).sum(dtype=np.uint64) ^ np.uint64(len(s) * 0x9E3779B97F4A7C15 % (1 << 64))]))[0].view(np.int64))


def bit_sketch(s: np.ndarray) -> np.ndarray:
    bits = max(64, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def marked_words(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The words of a sorted set in all its bands, as 64-bit keys; the kind of
    each (its band's parity, 2 for single shingles); the band of each; and how
    many words of either parity the set may leave out."""
    out, kinds, bands, spare = [], [], [], [0, 0]
    for band, p in spaces(len(s)):
        part = ((s >> np.uint64(32)) * np.uint64(p)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        salt = np.uint64(band + 1) << np.uint64(40)
        out.append(mix(np.bitwise_xor.reduceat(mix(s), first) ^ mix(part[first] + salt)))
        kinds.append(np.full(len(first), band & 1, dtype=np.uint16))
        spare[band & 1] = len(first) - most_apart(len(s)) - 1 - SPARE
        if len(first) <= most_apart(len(s)):
            out.append(mix(s ^ mix(np.array([salt], dtype=np.uint64))))
            kinds.append(np.full(len(s), 2, dtype=np.uint16))
        bands.append(np.full(sum(map(len, out)) - sum(map(len, bands)), band, dtype=np.uint8))
    keys = np.concatenate(out)
    same_key = len(keys) - len(np.unique(keys.astype(np.uint32)))
    return keys, np.concatenate(kinds), np.concatenate(bands), [max(0, k - same_key) for k in spare]


def words_of(s: np.ndarray) -> np.ndarray:
    """The words of a sorted set in all its bands, as 64-bit keys."""
    return marked_words(s)[0]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield tuple(c.to_pylist() for c in part.columns)


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("tx", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()),
                        ("sk", pa.list_(pa.int64()))])
    with np.errstate(over="ignore"):
        for ids, texts, tx in _texts(batches):
            sets = [shingle_set(t, K) for t in texts]
            yield pa.record_batch([
                pa.array(ids, pa.int64()), pa.array(tx, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([bit_sketch(s) if len(s) else None for s in sets], pa.list_(pa.int64()))], schema=schema)


def _word_blocks(first: list[int]):
    """Texts -> (shard, block): the words of a few thousand sets, each set once.
    Band ``k`` has the shards from ``first[k]`` to before ``first[k + 1]``.
    A block has only the sets with a word in its shard: their number, their ids,
    what each may leave out in the shard's band, then the low halves of the words
    and (kind, set number in the block) of each."""
    shards, base = first[-1], np.array(first, dtype=np.uint64)
    parity = np.repeat(np.arange(len(first) - 1) & 1, np.diff(first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int32()), ("block", pa.binary())])
        sids: dict[int, int] = {}
        words: list[np.ndarray] = []
        kinds: list[np.ndarray] = []
        bands: list[np.ndarray] = []
        spare: list[list[int]] = []
        total = 0

        def flush():
            w = np.concatenate(words)
            number = np.repeat(np.arange(len(words)), [len(x) for x in words])
            band = np.concatenate(bands)
            shard = (base[band] + (w >> np.uint64(32)) % (base[band + 1] - base[band])).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            ends = np.searchsorted(shard[order], np.arange(shards + 1))
            ids, may = np.array(list(sids), dtype=np.int64), np.array(spare, dtype=np.int32)
            low, number, kind = w.astype(np.uint32)[order], number[order], np.concatenate(kinds)[order] << np.uint16(12)
            for k in range(shards):
                a, b = ends[k], ends[k + 1]
                if a < b:
                    new = np.diff(number[a:b], prepend=-1) != 0         # numbers ascend within a shard
                    own = number[a:b][new]
                    idx = (np.cumsum(new) - 1).astype(np.uint16) | kind[a:b]
                    head = np.int64(len(own)).tobytes() + ids[own].tobytes() + may[own, parity[k]].tobytes()
                    yield pa.record_batch([pa.array([k], pa.int32()), pa.array(
                        [head + low[a:b].tobytes() + idx.tobytes()], pa.binary())], schema=schema)

        with np.errstate(over="ignore"):
            for _, texts in _texts(batches):
                for t in texts:
                    s = shingle_set(t, K)
                    sid = set_id(s) if len(s) else None
                    if sid is None or sid in sids:
                        continue
                    sids[sid] = len(sids)
                    keys, kind, band, leave = marked_words(s)
                    words.append(keys)
                    kinds.append(kind)
                    bands.append(band)
                    spare.append(leave)
                    total += len(keys)
                    if total >= FLUSH_ENTRIES or len(sids) >= DOCS_A_FLUSH:
                        yield from flush()
                        sids, words, kinds, bands, spare, total = {}, [], [], [], [], 0
            if words:
                yield from flush()
    return run


def _groups(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One shard -> rows (a, b): pairs of small groups; for every member of a
    large group (a: the least member, b: it, grp, m: members, kind of the word,
    spare: how many words of this kind the member may leave out)."""
    sig, sid, kind, spare = [], [], [], []
    for raw in table.column("block").to_pylist():
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        ids = np.frombuffer(raw, np.int64, n, 8)
        may = np.frombuffer(raw, np.int32, n, 8 + 8 * n)
        m = (len(raw) - 8 - 12 * n) // 6
        sig.append(np.frombuffer(raw, np.uint32, m, 8 + 12 * n))
        mark = np.frombuffer(raw, np.uint16, m, 8 + 12 * n + 4 * m)
        k, i = mark >> np.uint16(12), mark & np.uint16(0xFFF)
        sid.append(ids[i])
        kind.append(k.astype(np.int8))
        spare.append(np.where(k < 2, may[i], 0).astype(np.int32))
    sig, sid, kind, spare = (np.concatenate(x) for x in (sig, sid, kind, spare))
    order = np.argsort(sig, kind="stable")
    shared = sig[order]
    same = np.concatenate(([False], shared[1:] == shared[:-1]))
    keep = order[same | np.concatenate((same[1:], [False]))]
    sig, sid, kind, spare = sig[keep], sid[keep], kind[keep], spare[keep]
    order = np.lexsort((kind, sid, sig))
    sig, sid, kind, spare = sig[order], sid[order], kind[order], spare[order]
    new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1]))) if len(sig) else np.zeros(0, bool)
    sig, sid, kind, spare = sig[new], sid[new], kind[new], spare[new]
    starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate((starts, [len(sig)])))
    at = np.arange(len(sig)) - np.repeat(starts, size)
    m = np.repeat(size, size)
    a, b = [], []
    for gap in range(1, SMALL):
        left = np.flatnonzero((m <= SMALL) & (at + gap < m))
        a.append(sid[left])
        b.append(sid[left + gap])
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
    big = np.flatnonzero(m > SMALL)
    grp = (np.int64(key[0].as_py()) << np.int64(32)) | sig[big].astype(np.int64)
    none = len(pairs)

    def column(values, kind, small=None):
        small = pa.nulls(none, kind) if small is None else pa.array(small, kind)
        return pa.concat_arrays([small, pa.array(values, kind)])

    return pa.table({
        "a": column(np.repeat(sid[starts], size)[big], pa.int64(), pairs[:, 0]),
        "b": column(sid[big], pa.int64(), pairs[:, 1]),
        "grp": column(grp, pa.int64()), "m": column(m[big], pa.int64()),
        "kind": column(kind[big], pa.int8()), "spare": column(spare[big], pa.int32())})


def _fold(sk: np.ndarray, words: int) -> np.ndarray:
    while len(sk) > words:
        sk = sk[:len(sk) // 2] ^ sk[len(sk) // 2:]
    return sk


def _folded(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sketches (``size`` words of ``flat`` from ``at`` on) folded to the shortest's length."""
    words = int(size.min())
    out = np.empty((len(size), words), dtype=np.uint64)
    for length in np.unique(size):
        rows = np.flatnonzero(size == length)
        sk = flat[at[rows][:, None] + np.arange(length)]
        while sk.shape[1] > words:
            half = sk.shape[1] // 2
            sk = sk[:, :half] ^ sk[:, half:]
        out[rows] = sk
    return out


def _candidates(n, comp, sk, left, right) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ``left`` and ``right`` (positions, ordered by n) of different
    components within the size and Hamming bounds, 64 of ``left`` at a time.  With
    left = right every pair is seen once.  ``comp`` may change between the times."""
    sk, once = sk.T.copy(), left is right
    for at in range(0, len(left), 64):
        x = left[at:at + 64]
        lo = np.searchsorted(n[right], -(-n[x[0]] * NUM // DEN))
        hi = np.searchsorted(n[right], n[x[-1]] * DEN // NUM, "right")
        y = right[max(lo, at) if once else lo:hi]
        apart = np.zeros((len(x), len(y)), dtype=np.int32)
        for w in sk:
            apart += np.bitwise_count(w[x][:, None] ^ w[y][None, :])
        nx, ny = n[x][:, None], n[y][None, :]
        ok = (apart * (DEN + NUM) <= (DEN - NUM) * (nx + ny)) & (comp[x][:, None] != comp[y][None, :])
        ok &= np.minimum(nx, ny) * DEN >= np.maximum(nx, ny) * NUM
        if once:
            ok &= x[:, None] < y[None, :]
        r, c = np.nonzero(ok)
        yield x[r], y[c]


def _near_forest(n, comp, sk, left, right) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the candidates."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    for u, v in _candidates(n, comp, sk, left, right):
        if len(u):
            ends = np.sort(np.stack([comp[u], comp[v]], axis=1), axis=1)
            ends, one = np.unique(ends, axis=0, return_index=True)
            new = []
            for k, (cu, cv) in zip(one, ends.tolist()):
                ru, rv = root(cu), root(cv)
                if ru != rv:
                    parent[ru] = rv
                    new.append(k)
            yield u[new], v[new]


def _linked_forest(n, comp, sets, left, right) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between the exact ``sets``, a spanning forest of all links in the group:
    a pair whose ends are joined by earlier links is not compared again."""
    flat, at, size = sets
    sketches = [bit_sketch(flat[a:a + k]).view(np.uint64) for a, k in zip(at, size)]
    length = np.array([len(x) for x in sketches])
    sk = _folded(np.concatenate(sketches), np.cumsum(length) - length, length)
    comp = comp.copy()
    for u, v in _candidates(n, comp, sk, left, right):
        for p, q in zip(u.tolist(), v.tolist()):
            if comp[p] == comp[q]:
                continue
            x, y = flat[at[p]:at[p] + size[p]], flat[at[q]:at[q] + size[q]]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if DEN * both >= NUM * (len(x) + len(y) - both):
                comp[comp == comp[p]] = comp[q]
                yield np.array([p]), np.array([q])


def _in_blocks(exact: bool):
    """Members of two blocks (i, j) of a large group, or of several groups of one
    block -> pairs (grp, a, b), fewer than members a group and call: candidates by
    sketches (``data``) of n bits or more, or links by exact sets (``data``)."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        grp, blk, sid, n, comp = (table.column(c).to_numpy() for c in ("grp", "blk", "sid", "n", "comp"))
        lists = pa.concat_arrays(table.column("data").chunks)
        flat, size = lists.flatten().to_numpy().view(np.uint64), np.diff(lists.offsets.to_numpy())
        at = np.cumsum(size) - size
        order = np.lexsort((sid, n, grp))
        g, a, b = [], [], []
        for rows in np.split(order, np.flatnonzero(np.diff(grp[order])) + 1):
            left = np.flatnonzero(blk[rows] == i)
            right = left if i == j else np.flatnonzero(blk[rows] == j)
            if exact:
                found = _linked_forest(n[rows], comp[rows], (flat, at[rows], size[rows]), left, right)
            else:
                found = _near_forest(n[rows], comp[rows], _folded(flat, at[rows], size[rows]), left, right)
            for u, v in found:
                x, y = sid[rows][u], sid[rows][v]
                g.append(np.full(len(x), grp[rows[0]]))
                a.append(np.minimum(x, y))
                b.append(np.maximum(x, y))
        g, a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (g, a, b))
        return pa.table({"grp": pa.array(g, pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, text) -> (sid, data), the exact shingle set."""
    with np.errstate(over="ignore"):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                data = [shingle_set(t, K).view(np.int64) for t in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("sid"), pa.array(data, pa.list_(pa.int64()))], names=["sid", "data"])


def _verify_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, ta, tb) -> (a, b) where the exact shingle sets are linked."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    with np.errstate(over="ignore"):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                cols = batch.slice(at, SLICE).to_pydict()
                keep, last, sa = [], None, None
                for k, (a, ta, tb) in enumerate(zip(cols["a"], cols["ta"], cols["tb"])):
                    if a != last:
                        last, sa = a, shingle_set(ta, K)
                    sb = shingle_set(tb, K)
                    both = len(np.intersect1d(sa, sb, assume_unique=True))
                    keep.append(DEN * both >= NUM * (len(sa) + len(sb) - both))
                yield pa.record_batch([pa.array([v for v, k in zip(cols[c], keep) if k], pa.int64()) for c in "ab"],
                                      schema=schema)


def asked_for(rows: DataFrame, used: DataFrame) -> DataFrame:
    """The ``rows`` whose key (did, tx) is in ``used``, and a few others that share a
    bit with one: their texts need not be shuffled to find that out.  The keys' bits
    are broadcast as bitmaps of 4 KB, ``MOST_MARKS`` bits in all; beyond
    ``MOST_MARKS / MARKS`` keys more other rows pass, and none is lost."""
    bit = F.pmod(F.xxhash64("did", "tx"), F.lit(min(MOST_MARKS, MARKS * max(used.count(), 1024))))
    marks = used.select(bit.alias("bit")).select("bit", F.bitmap_bucket_number("bit").alias("bucket")).repartition("bucket") \
        .groupBy("bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("marks"))
    place = F.bitmap_bit_position(bit).cast("int")
    byte = F.conv(F.hex(F.substring("marks", F.shiftright(place, 3) + 1, 1)), 16, 10).cast("int")
    return rows.join(F.broadcast(marks), F.bitmap_bucket_number(bit) == F.col("bucket")) \
        .filter(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), place.bitwiseAND(F.lit(7)) + 1)) != 0) \
        .select(*rows.columns)


class ParityJoin:
    """One run of the join over ``docs`` (doc_id, text)."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        prepare(self.spark)
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        # a row's key: (did, tx); a null id reads as -1, which the text's hash keeps from mixing texts
        self.keyed = self.docs.select(F.coalesce("doc_id", F.lit(-1)).alias("did"), F.xxhash64("text").alias("tx"), "text")
        keyed = self.docs.select("doc_id", "text", F.xxhash64("text").alias("tx"))
        self.rows = cut(keyed.mapInArrow(_sketch_rows, "doc_id long, tx long, n long, sid long, sk array<long>"), "ng-rows")
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tx", "n", "sk"))
        self.sets = cut(self.rows.filter(F.col("sid").isNotNull()).groupBy("sid").agg(least.alias("r"))
                        .select("sid", "r.doc_id", "r.tx", "r.n", "r.sk"), "ng-sets")

    def shards(self) -> list[int]:
        """The first shard of every band, by the shingles of its sets (one row a band
        comes to the driver), and the number of all shards."""
        edges = F.array(*[F.lit(e).cast("long") for e in _EDGES])
        band = lambda n: F.size(F.filter(edges, lambda e: e <= n)) - 1
        least = F.ceil(F.col("n") * NUM / DEN)
        use = self.sets.select("n", F.explode(F.array_distinct(F.array(band(F.col("n")), band(least)))).alias("band"))
        total = {r["band"]: r["s"] for r in use.groupBy("band").agg(F.sum("n").alias("s")).collect()}
        first = [0]
        for k in range(len(_EDGES)):
            first.append(first[-1] + (1 + int(total[k]) // 2 // SHARD_ENTRIES if k in total else 0))
        return first

    def words(self) -> DataFrame:
        first = self.shards()
        blocks = self.docs.filter(F.col("text").isNotNull()).mapInArrow(_word_blocks(first), "shard int, block binary")
        return cut(blocks.repartition(max(1, first[-1]), "shard").groupBy("shard").applyInArrow(
            _groups, "a long, b long, grp long, m long, kind byte, spare int"), "ng-groups")

    def members(self, groups: DataFrame) -> DataFrame:
        """(grp, least, sid) of the large groups, without those members that may
        leave: of every set and kind of word, the ``spare`` largest groups."""
        order = Window.partitionBy("b", "kind").orderBy(F.desc("m"), F.desc("grp"))
        kept = groups.filter("grp is not null").withColumn("place", F.row_number().over(order)).filter("place > spare")
        return cut(kept.select("grp", F.col("a").alias("least"), F.col("b").alias("sid")), "ng-kept")

    def _with_sketch(self, pairs: DataFrame) -> DataFrame:
        for side in "ab":
            s = self.sets.select(F.col("sid").alias(side), F.col("n").alias(f"n{side}"), F.col("sk").alias(f"k{side}"),
                                 F.col("doc_id").alias(f"d{side}"))
            pairs = pairs.join(s, side)
        return pairs

    def near(self, pairs: DataFrame) -> DataFrame:
        """Pairs within the size and Hamming bounds, each once, by their sketches."""
        fold = lambda k: F.zip_with(F.slice(k, 1, (F.size(k) / 2).cast("int")),
                                    F.slice(k, (F.size(k) / 2).cast("int") + 1, (F.size(k) / 2).cast("int")),
                                    lambda x, y: x.bitwiseXOR(y))
        p = self._with_sketch(pairs.filter("a <> b").distinct())
        p = p.filter(f"least(na, nb) * {DEN} >= greatest(na, nb) * {NUM}")
        ka, kb = F.col("ka"), F.col("kb")
        p = p.withColumn("xa", F.when(F.size(ka) > F.size(kb), fold(ka)).otherwise(ka)) \
             .withColumn("xb", F.when(F.size(kb) > F.size(ka), fold(kb)).otherwise(kb))
        apart = F.aggregate(F.zip_with("xa", "xb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        return p.filter(apart * (DEN + NUM) <= F.lit(DEN - NUM) * (F.col("na") + F.col("nb"))).select("a", "b")

    def texts_of(self, sids: DataFrame) -> DataFrame:
        """(sid, text) of distinct set ids."""
        used = cut(sids.join(self.sets, "sid").select("sid", F.coalesce("doc_id", F.lit(-1)).alias("did"), "tx"), "ng-used")
        # rows repeated whole give their text once; the join has brought them together already
        texts = asked_for(self.keyed, used).join(used, ["did", "tx"]).dropDuplicates(["did", "tx"]).select("sid", "text")
        return cut(texts, "ng-texts")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose exact sets are linked."""
        pairs = cut(pairs, "ng-near")
        texts = self.texts_of(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct())
        with_a = pairs.join(texts.select(F.col("sid").alias("a"), F.col("text").alias("ta")), "a")
        with_b = with_a.join(texts.select(F.col("sid").alias("b"), F.col("text").alias("tb")), "b")
        return cut(with_b.select("a", "b", "ta", "tb").mapInArrow(_verify_texts, "a long, b long"), "ng-links")

    def joining(self, pairs: DataFrame) -> DataFrame:
        """Verified links among ``pairs``, enough to join all that they link:
        a pair of every set first, then the pairs still between components."""
        pairs = cut(pairs, "ng-pairs")
        first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        links = self.verified(first)
        comp = components(links)
        for side in "ab":
            pairs = pairs.join(comp.select(F.col("node").alias(side), F.col("root").alias(f"r{side}")), side, "left")
        rest = pairs.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b").join(first, ["a", "b"], "left_anti")
        return links.union(self.verified(rest))

    def links(self) -> DataFrame:
        """Verified links (a, b) between set ids: all of those of small groups,
        and enough of those of large groups to join every component."""
        groups = self.words()
        members = self.members(groups)
        links = self.joining(self.near(groups.filter("grp is null").select("a", "b")
                                       .union(members.select(F.col("least").alias("a"), F.col("sid").alias("b")))))
        short = self.sets.select("sid", F.col("sk").alias("data"))
        comp = components(links)
        inside = members.join(comp, members["sid"] == comp["node"], "left").select("grp", "sid", F.coalesce("root", "sid").alias("comp"))
        near = cut(self.compared(inside, short, exact=False).select("a", "b"), "ng-open")
        links = cut(links.union(self.verified(self.near(near))), "ng-links")
        # the forest of candidates missed the links that close its circles.  Ends of a link are joined
        # by candidates, so each set is needed once, with the sets that candidates join it to
        comp, joined = components(links), components(links.union(near))
        open_sets = members.select("sid").distinct().join(joined.select(F.col("node").alias("sid"), F.col("root").alias("grp")), "sid")
        inside = open_sets.join(comp, open_sets["sid"] == comp["node"], "left").select("grp", "sid", F.coalesce("root", "sid").alias("comp"))
        return links.union(cut(self.compared(inside, None, exact=True).select("a", "b"), "ng-exact"))

    def compared(self, inside: DataFrame, data: DataFrame | None, exact: bool) -> DataFrame:
        """(grp, a, b) between the components ``comp`` of the sets in each group of
        ``inside`` (grp, sid, comp), compared in blocks by ``data`` (sid, data); None:
        by their exact sets."""
        inside = inside.join(self.sets.select("sid", "n"), "sid")
        open_ = inside.groupBy("grp").agg(
            F.count(F.lit(1)).alias("m"), F.sum("n").alias("volume"), F.min("comp").alias("lo"), F.max("comp").alias("hi"),
            *[F.bit_xor(F.xxhash64("sid", F.lit(i))).alias(f"h{i}") for i in range(2)]).filter("lo < hi")
        blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("volume") / VOLUME) if exact else F.lit(1))
        open_ = open_.groupBy("m", "volume", "h0", "h1").agg(F.min("grp").alias("grp")).select("grp", blocks.cast("int").alias("blocks"))
        block = inside.join(open_, "grp")
        if exact:
            block = cut(block, "ng-inside")
            texts = self.texts_of(block.select("sid").distinct())
            data = cut(texts.mapInArrow(_set_rows, "sid long, data array<long>"), "ng-exact-sets")
        block = block.join(data, "sid").withColumn("blk", F.pmod(F.xxhash64("sid"), "blocks").cast("int"))
        # every block with itself and with every other block of its group
        spread = block.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
            .withColumn("i", F.least("blk", "o")).withColumn("j", F.greatest("blk", "o"))
        # groups of one block share calls; a larger group has a call for two blocks
        packs = PACKS * int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        shared = F.when(F.col("blocks") == 1, -1 - F.pmod(F.xxhash64("grp"), F.lit(packs))).otherwise(F.col("grp"))
        return spread.select(shared.alias("call"), "i", "j", "grp", "blk", "sid", "n", "comp", "data").groupBy("call", "i", "j") \
            .applyInArrow(_in_blocks(exact), "grp long, a long, b long")

    def linked_rows(self) -> DataFrame:
        """doc_id, tx (hash of the text), n, sid, root (a component's key) and the
        component's least id, for every document."""
        comp = components(self.links())
        sets = self.sets.join(comp, self.sets["sid"] == comp["node"], "left") \
                        .select("sid", "doc_id", F.coalesce("root", "sid").alias("root"))
        least = sets.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        of_set = sets.join(least, "root").select("sid", "root", "component_id")
        out = self.rows.select("doc_id", "tx", "n", "sid").join(of_set, "sid", "left")
        return out.select("doc_id", "tx", "n", "sid", "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every component (its least doc_id) and every
    row without words.  Only the rows that stay are joined back to their texts
    by (id, text hash); rows repeated whole are then thinned to one."""
    rows = cut(ParityJoin(docs).linked_rows(), "ng-members")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tx")
    keep = (rows.filter(F.col("root").isNotNull()).groupBy("root", "doc_id", "tx").agg(F.count(F.lit(1)).alias("times"))
            .groupBy("root").agg(F.min(F.struct(key.alias("k"), "times")).alias("m"))
            .select(F.col("m.k.doc_id").alias("k_id"), F.col("m.k.tx").alias("k_tx"), F.col("m.times").alias("k_times")))
    wordless = docs.filter(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)) == 0)
    # a row travels as one column, so that no column of ``docs`` clashes with those of the join
    rows_ = docs.select(F.col("doc_id").cast("long").alias("d_id"), F.xxhash64("text").alias("d_tx"), F.struct("*").alias("doc"))
    hit = rows_.join(keep, F.col("d_id").eqNullSafe(F.col("k_id")) & (F.col("d_tx") == F.col("k_tx")))
    once = hit.filter("k_times = 1").select("doc.*")
    again = hit.filter("k_times > 1").dropDuplicates(["k_id", "k_tx"]).select("doc.*")
    return once.unionByName(again).unionByName(wordless)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_shingles, component_id, set_id."""
    out = ParityJoin(docs).linked_rows()
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("sid").alias("set_id"))
