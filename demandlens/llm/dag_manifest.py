"""Merkle manifest of a dataset as a content-addressed DAG, with proofs by descent.

Every record is a leaf digest.  The leaves of a source, by document id, are the
lowest nodes of its tree: every ``FAN`` consecutive nodes become the digest of
their concatenated digests until one is left, the source's subroot; the subroots,
by source, make the tree of the root in the same way.  Every inner node is one
row ``(digest, children)`` of the store, kept once for each digest: equal subtrees
are one record.

A proof needs no positions of nodes, only the store.  A request names a leaf by
its rank digits (base ``FAN``, one hexadecimal digit a level: those of its source
among the sources, then those of the leaf in its source).  All requests descend
from the root together, a level at a time: requests with the same digits so far
are one entry, which looks up its digest in the store, goes on to the children
that some request selects and takes the unselected ones along as a segment of the
path.  At the leaf, the reversed segments are the proof from the leaf up.

Size: a level has one entry for each distinct prefix, the last one a sixteenth of
the leaves; the long paths are never carried by single leaves through a shuffle,
they meet their leaves in the last join, which hashes them away.  No source is
gathered in a task (``ranks.ranked``) and no group holds more than ``FAN`` nodes.

Defined results: nulls are records of their own (``-``); a null source is first
among the sources and unlike an empty one; null ids come first in their source;
rows with one source and id stand by their digests, equal rows are leaves of their
own; an empty table has no rows and no root; a single row is its own root with the
digest of the empty text as its proof.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import cut
from demandlens.llm.ranks import numbered, ranked

FAN = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def record_digest(values: Sequence[Column]) -> Column:
    """sha256 of the values' records: ``-`` for null, else UTF-8 bytes, ``:``, value."""
    parts = []
    for v in values:
        s = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def height(n: int) -> int:
    """Levels above ``n`` nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _height(n: Column) -> Column:
    return sum(((n > F.lit(FAN ** k)).cast("int") for k in range(1, 15)), (n > 1).cast("int"))


def _digits(rank: Column, length: Column) -> Column:
    return F.lpad(F.lower(F.hex(rank)), length, F.lit("0"))


@dataclass
class Manifest:
    """``store`` (digest, children), ``root`` (None for an empty table) and
    ``leaves``: the given columns, ``leaf`` and ``path``, its rank digits from
    the root; ``top`` digits of a path choose the source."""

    store: DataFrame
    root: str | None
    leaves: DataFrame
    top: int


def _tree(nodes: DataFrame, most: int, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """(key, digest) of the trees' tops and the inner nodes by level, of nodes
    (key, n, pos, digest) with at most ``most`` nodes a key."""
    tops, inner = [nodes.filter("n = 1").select("key", "digest")], []
    for level in range(height(most)):
        children = F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"])
        run = (nodes.filter("n > 1").groupBy("key", "n", F.floor(F.col("pos") / FAN).alias("run"))
               .agg(children.alias("children")))
        nodes = cut(run.select("key", F.ceil(F.col("n") / FAN).alias("n"), F.col("run").alias("pos"),
                               F.sha2(F.array_join("children", ""), 256).alias("digest"), "children"), f"{name}-{level}")
        inner.append(nodes.select("digest", "children"))
        tops.append(nodes.filter("n = 1").select("key", "digest"))
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out, inner


def build(rows: DataFrame, source: str, order: Sequence[str], leaf: str = "leaf") -> Manifest:
    """The manifest of ``rows``: digests ``leaf``, trees by ``source``, leaves in
    ascending ``order`` and then by digest."""
    keyed = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")))
    placed = ranked(numbered(keyed, "manifest-rows"), "key", [*order, leaf], "manifest", rows.columns)
    most, groups = placed.agg(F.max("n"), F.max("groups")).first()
    top = height(groups or 0)
    path = F.concat(_digits(F.col("group_pos"), F.lit(top)), _digits(F.col("pos"), _height(F.col("n"))))
    leaves = cut(placed.withColumn("path", path), "manifest-leaves")
    subroots, inner = _tree(leaves.select("key", "n", "pos", F.col(leaf).alias("digest")), most or 0, "manifest-source")
    tops = cut(leaves.filter("pos = 0").select("key", F.col("groups").alias("n"), F.col("group_pos").alias("pos"))
               .join(subroots, "key").select(F.lit("").alias("key"), "n", "pos", "digest"), "manifest-subroots")
    last, above = _tree(tops, groups or 0, "manifest-root")
    root = last.first()
    store = leaves.select(F.col(leaf).alias("digest"), F.array(F.col(leaf)).alias("children")).limit(0)
    for nodes in inner + above:
        store = store.unionByName(nodes)
    store = cut(store.groupBy("digest").agg(F.first("children").alias("children")), "manifest-store")
    return Manifest(store, root["digest"] if root else None,
                    leaves.drop("key", "n", "pos", "group_pos", "groups"), top)


def _sides(children: Column, i: Column) -> Column:
    """What stands left and right of child ``i`` (from 0)."""
    return F.struct(F.array_join(F.slice(children, F.lit(1), i), "").alias("left"),
                    F.array_join(F.slice(children, i + 2, F.lit(FAN)), "").alias("right"))


def _digit(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("int")


def descend(manifest: Manifest, paths: DataFrame) -> DataFrame:
    """(prefix, children, subroot, trail): the store's record above every leaf that
    ``paths`` (a column ``path``) asks for, with the unselected children of the
    records above it, the root's first.  ``subroot`` is null where a leaf is one."""
    spark = paths.sparkSession
    runs = cut(paths.filter("path <> ''").select(F.expr("left(path, length(path) - 1)").alias("prefix")).distinct(), "descent-runs")
    deepest = runs.agg(F.max(F.length("prefix"))).first()[0]
    root = F.lit(manifest.root).cast("string")
    subroot = root if manifest.top == 0 else F.lit(None).cast("string")
    trail = F.array().cast("array<struct<left:string,right:string>>")
    entries = spark.range(1).select(F.lit("").alias("prefix"), root.alias("digest"), subroot.alias("subroot"), trail.alias("trail"))
    out = None
    for depth in range(0 if deepest is None else deepest + 1):
        at = cut(entries.join(manifest.store, "digest").select("prefix", "children", "subroot", "trail"), f"descent-{depth}")
        here = at.join(runs.filter(F.length("prefix") == depth), "prefix", "left_semi")
        out = here if out is None else out.unionByName(here)
        selected = (runs.filter(F.length("prefix") > depth)
                    .groupBy(F.expr(f"left(prefix, {depth})").alias("prefix"))
                    .agg(F.collect_set(F.substring("prefix", depth + 1, 1)).alias("digits")))
        child = F.get("children", _digit(F.col("digit")))
        entries = (at.join(selected, "prefix").select("*", F.explode("digits").alias("digit"))
                   .select(F.concat("prefix", "digit").alias("prefix"), child.alias("digest"),
                           (child if depth + 1 == manifest.top else F.col("subroot")).alias("subroot"),
                           F.concat("trail", F.array(_sides(F.col("children"), _digit(F.col("digit"))))).alias("trail")))
    if out is None:
        out = entries.select("prefix", F.array("digest").alias("children"), "subroot", "trail").limit(0)
    return out


def prove(manifest: Manifest, requests: DataFrame, leaf: str = "leaf") -> DataFrame:
    """``requests`` (rows of ``manifest.leaves``) with ``subroot``, ``root`` and
    ``proof``: (left, right) siblings from the leaf up."""
    found = descend(manifest, requests.select("path"))
    above = requests.withColumn("prefix", F.expr("left(path, length(path) - 1)"))
    root = F.lit(manifest.root).cast("string").alias("root")
    at = _digit(F.substring("path", -1, 1))
    proof = F.concat(F.array(_sides(F.col("children"), at)), F.reverse("trail"))
    kept = [c for c in requests.columns if c != "path"]
    deep = (above.filter("path <> ''").join(found, "prefix")
            .select(*kept, F.coalesce("subroot", leaf).alias("subroot"), root, proof.alias("proof")))
    alone = requests.filter("path = ''").select(
        *kept, F.col(leaf).alias("subroot"), root, F.array().cast("array<struct<left:string,right:string>>").alias("proof"))
    return deep.unionByName(alone)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and its siblings give."""
    return F.aggregate(proof, leaf, lambda cur, s: F.sha2(F.concat(s["left"], cur, s["right"]), 256))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def audit_tampered(docs: DataFrame) -> DataFrame:
    """Every document's proof, held against documents of which some are changed:
    where 5 divides crc32 of the id, the text's A-Z are in lower case."""
    cols = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = docs.select("doc_id", "source", record_digest([*cols, F.col("text")]).alias("leaf"),
                       F.when(hit, record_digest([*cols, F.translate("text", UPPER, LOWER)])).alias("other"))
    manifest = build(rows, "source", ["doc_id"])
    proved = prove(manifest, manifest.leaves)
    out = proved.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"),
                        folded(F.coalesce("other", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
