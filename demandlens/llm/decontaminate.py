"""Benchmark decontamination by size-partitioned MinHash containment search.

Queries are the benchmark items (sets of ``q`` word shingles, mostly short),
the searched domain is every document (sets of ``n`` shingles, up to very
long).  Jaccard similarity of a short item and a long document is tiny, so
documents are partitioned by size (powers of two) and the signature grows
with the class: one-permutation MinHash with ``DENSITY`` bins a shingle of the
class's lower bound, keeping the least hash of every bin.  A shared shingle is
its bin's minimum on the document's side with probability (1 - e^-x) / x for
x <= 1/4 shingles a bin, at least 0.88; an item with ``q`` >= ``TINY``
shingles and containment >= 0.75 is then missed with probability below
(0.12)^(0.75 q) < 1e-5.  Items of fewer shingles use one bin a hash value
(the whole set), which misses nothing.  Candidates are verified by exact
shingle containment on the same sets.

The items' signatures are collected only up to ``BLOCK`` shingles at a time
(counted first); a larger benchmark is searched in several such blocks.  The
pass over the documents is narrow: nothing is shuffled, so copies and hot
sources cost nothing extra.

Defined results: null or blank texts and items hold nothing and match
nothing; fewer than five words are one shingle, so a short item matches only a
text that is the same short sequence; repeated items and repeated rows match
each; extra columns pass through; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import prepare
from demandlens.llm.shingles import shingle_set

K = 5
NUM, DEN = 75, 100           # contained when DEN * shared >= NUM * size of the item
DENSITY = 8                  # bins for each shingle of the class's lower bound
TINY = 8
BLOCK = 2_000_000            # shingles of items in one broadcast
SLICE = 256
MATCHES = "__matches"
_KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("n_item", pa.int64()), ("n_shared", pa.int64())]))


def minima(s: np.ndarray) -> np.ndarray:
    """The least hash of every bin of a sorted set, by its size class."""
    bits = (DENSITY * (1 << (len(s).bit_length() - 1))).bit_length() - 1
    part = s >> np.uint64(64 - min(bits, 63))
    return s[np.concatenate(([True], part[1:] != part[:-1]))]


class ItemIndex:
    """Sorted hashes of the items of one block and who has them."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = items
        self.tiny = self._post([i for i, (_, s) in enumerate(items) if 0 < len(s) < TINY])
        self.rest = self._post([i for i, (_, s) in enumerate(items) if len(s) >= TINY])

    def _post(self, which: list[int]) -> tuple[np.ndarray, np.ndarray]:
        if not which:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.concatenate([self.items[i][1] for i in which])
        who = np.repeat(np.array(which), [len(self.items[i][1]) for i in which])
        order = np.argsort(h, kind="stable")
        return h[order], who[order]

    def search(self, s: np.ndarray) -> list[dict]:
        if not len(s):
            return []
        found: set[int] = set()
        for (h, who), sig in ((self.rest, minima(s)), (self.tiny, s)):
            if len(h):
                lo, hi = np.searchsorted(h, sig, "left"), np.searchsorted(h, sig, "right")
                for a, b in zip(lo[lo < hi], hi[lo < hi]):
                    found.update(who[a:b].tolist())
        out = []
        for i in sorted(found):
            item, q = self.items[i]
            both = len(np.intersect1d(q, s, assume_unique=True))
            if DEN * both >= NUM * len(q):
                out.append({"item_id": item, "n_item": len(q), "n_shared": both})
        return out


def _item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("item_id", pa.int64()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])
    with np.errstate(over="ignore"):
        for b in batches:
            sets = [shingle_set(t, K).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                                   pa.array(sets, pa.list_(pa.int64()))], schema=schema)


def _searcher(index, text_at: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    hits = [index.value.search(shingle_set(t, K)) for t in part.column(text_at).to_pylist()]
                    yield part.append_column(name, pa.array(hits, _KIND))
    return run


def with_matches(docs: DataFrame, items: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """``docs`` with one more column ``MATCHES``: array of (item_id, n_item,
    n_shared), a benchmark item each that the text contains."""
    spark = docs.sparkSession
    prepare(spark)
    sets = items.select(F.col("item_id").cast("long").alias("item_id"), "text") \
                .mapInArrow(_item_sets, "item_id long, n long, s array<long>").filter("n > 0")
    total = sets.agg(F.sum("n")).first()[0] or 0
    blocks = 1 + int(total) // block
    out, columns = docs, []
    for k in range(blocks):
        rows = sets.filter(F.pmod(F.xxhash64("item_id", F.xxhash64("s")), F.lit(blocks)) == k).select("item_id", "s").collect()
        index = spark.sparkContext.broadcast(ItemIndex([(r.item_id, np.sort(np.array(r.s, np.int64).view(np.uint64))) for r in rows]))
        name = f"{MATCHES}{k}"
        columns.append(name)
        schema = out.select("*", F.lit(None).cast("array<struct<item_id:long,n_item:long,n_shared:long>>").alias(name)).schema
        out = out.mapInArrow(_searcher(index, docs.columns.index("text"), name), schema)
    return out.select(*docs.columns, F.concat(*columns).alias(MATCHES))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for every document and benchmark item that it contains."""
    hits = with_matches(docs.select("doc_id", "text"), items)
    m = hits.select("doc_id", F.explode(MATCHES).alias("m"))
    return m.select("doc_id", "m.item_id", F.col("m.n_item").alias("n_item_shingles"),
                    F.col("m.n_shared").alias("n_shared"),
                    (F.col("m.n_shared") / F.col("m.n_item")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that contain no benchmark item."""
    return with_matches(docs, items).filter(F.size(MATCHES) == 0).select(*docs.columns)
