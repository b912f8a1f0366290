"""Merkle fixity audit of WARC records.

A replica of a collection is a table of records (file, offset, length, record
hash).  A file's tree has one leaf for every ``LEAF`` bytes of offsets: the
SHA-256 of its records' (offset, length, hash) in order of offset.  A node of
the next level covers ``FAN`` ranges and hashes its children (range number,
hash) in order, up to one root a file.  Trees of a bounded fan-out are built
level by level with grouped aggregations; a group holds the records of one
offset range, never a file.

The audit compares roots, then only the children of nodes that differ, down
to leaves and the records in them: what is read below a level is limited to
mismatching branches.

Defined results: a record missing on one side, an extra one or a changed one
is reported with its offset; records at the same offset count as a multiset;
files on one side only have every record reported; null files form one file
named '' and a null payload is the empty one; an empty replica differs from
the other everywhere; two empty ones not at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlens.llm.common import cut

LEAF = 1 << 16
FAN = 16


def warc_record(uri: Column, payload: Column, kind: str = "response") -> Column:
    """The bytes of a WARC/1.1 record: header, payload and the record's end."""
    body = F.coalesce(payload, F.lit("")).cast("binary")
    head = F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")),
                    F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def manifest(records: DataFrame) -> DataFrame:
    """``records`` (file, pos, record: bytes) -> (file, pos, offset, length, hash):
    the layout of the files, record after record in order of pos."""
    record = F.coalesce("record", F.lit("").cast("binary"))
    slim = records.select(F.coalesce("file", F.lit("")).alias("file"), "pos", F.octet_length(record).cast("long").alias("length"),
                          F.sha2(record, 256).alias("hash"))
    before = Window.partitionBy("file").orderBy("pos", "hash").rowsBetween(Window.unboundedPreceding, -1)
    return slim.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def _node(items: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(items)),
                                           lambda x: F.concat_ws(":", *[x[f"f{i}"].cast("string") for i in range(3)])), "\n"), 256)


def tree(man: DataFrame, levels: int, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """(file, level, node, hash) of all levels; level 0 are the leaves."""
    item = F.struct(F.col("offset").alias("f0"), F.col("length").alias("f1"), F.col("hash").alias("f2"))
    out = [man.groupBy("file", F.floor(F.col("offset") / leaf).alias("node")).agg(_node(item).alias("hash"))
              .select("file", F.lit(0).alias("level"), "node", "hash")]
    for level in range(1, levels):
        child = F.struct(F.lit(level).alias("f0"), F.col("node").alias("f1"), F.col("hash").alias("f2"))
        out.append(out[-1].groupBy("file", F.floor(F.col("node") / fan).alias("node")).agg(_node(child).alias("hash"))
                          .select("file", F.lit(level).alias("level"), "node", "hash"))
    return reduce(DataFrame.unionByName, out)


def levels_for(last_offset: int, leaf: int = LEAF, fan: int = FAN) -> int:
    """Levels up to one root for offsets up to ``last_offset``."""
    n, levels = last_offset // leaf, 1
    while n > 0:
        n, levels = n // fan, levels + 1
    return levels


def _differ(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose hashes differ or that one side lacks."""
    joined = a.select(*keys, F.col("hash").alias("ha")).join(b.select(*keys, F.col("hash").alias("hb")), keys, "full_outer")
    return joined.filter(~F.col("ha").eqNullSafe(F.col("hb"))).select(*keys)


def audit(a: DataFrame, b: DataFrame, *, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """Manifests ``a`` and ``b`` -> (file, offset, status, length_a, length_b,
    hash_a, hash_b), a row for every record that is not the same in both."""
    last = a.select("offset").union(b.select("offset")).agg(F.max("offset")).first()[0] or 0
    levels = levels_for(int(last), leaf, fan)
    ta, tb = (cut(tree(m, levels, leaf, fan), "merkle-tree") for m in (a, b))
    at = lambda t, k: t.filter(F.col("level") == k)
    bad = cut(_differ(at(ta, levels - 1), at(tb, levels - 1), ["file", "node"]), "merkle-differ")
    for level in range(levels - 2, -1, -1):
        up = bad.select(F.col("file").alias("u_file"), F.col("node").alias("u_node"))
        below = lambda t: at(t, level).join(
            up, (F.col("file") == F.col("u_file")) & (F.floor(F.col("node") / fan) == F.col("u_node")), "left_semi")
        bad = cut(_differ(below(ta), below(tb), ["file", "node"]), "merkle-differ")
    up = bad.select(F.col("file").alias("u_file"), F.col("node").alias("u_node"))

    def inside(m, side):
        hit = m.join(up, (F.col("file") == F.col("u_file")) & (F.floor(F.col("offset") / leaf) == F.col("u_node")), "left_semi")
        nth = F.row_number().over(Window.partitionBy("file", "offset").orderBy("hash"))
        return hit.select("file", "offset", nth.alias("nth"), F.col("length").alias(f"length_{side}"), F.col("hash").alias(f"hash_{side}"))

    both = inside(a, "a").join(inside(b, "b"), ["file", "offset", "nth"], "full_outer")
    status = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("changed")
    return both.filter(~F.col("hash_a").eqNullSafe(F.col("hash_b"))) \
               .select("file", "offset", status.alias("status"), "length_a", "length_b", "hash_a", "hash_b")
