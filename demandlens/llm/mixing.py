"""Mixing sources to target weights by Pareto order sampling.

Sources get targets in words: ``share`` of all words is dealt by weight, a
target stops at ``cap`` times its source's words and the excess is dealt
again among the others (water filling, in closed form over the sources
sorted by cap / weight).

Inside a source a document's expected copies are ``m = r + a * (x - mean)``:
``r`` is target / size of the source, ``x`` in [0, 1) grows with the length
of the document, ``mean`` is its word-weighted mean (so the expected words
are exactly the target) and ``a = tilt * min(r, cap - r)`` keeps ``m`` in
[0, cap].  ``floor(m)`` copies are certain.  The fraction ``p`` is the
inclusion probability of one more copy: with a uniform number ``u`` hashed
from the document's id, documents are ranked by

    odds(u) / odds(p) = u (1 - p) / ((1 - u) p)

and the smallest ranks are taken until the words left over in the target
are filled (the sample's size is fixed in words).

No task holds a source: the rank, mapped to (0, 1), is counted in ``BINS``
equal bins, then the bin in which the target falls in ``BINS`` finer ones;
only the documents of that last bin are sorted.  Every document then decides
for itself against its source's cut, so texts are never shuffled.

Defined results: a null text has size 0; a null source is a source of its
own, sorted last; documents of size 0 take 0 words; an empty table gives an
empty result.  Rows that agree in id, source and size share one number and
are taken or left together.  Reruns agree: all sums are of integers and the
random numbers are hashes of the ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlens.llm.common import cut, n_words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
TILT = 0.25
SEED = "mix"
BINS = 512
HALF_LENGTH = 100      # words at which x reaches one half
SCALE = 1000           # x is kept as an integer in thousandths


def source_targets(sizes: DataFrame, *, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(src, source_size, sx) -> the same with ``target``.  One row a source."""
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    most = F.col("source_size") * F.lit(float(cap))
    ranked = (sizes.withColumn("w", w).withColumn("most", most)
              .withColumn("total", F.sum("source_size").over(all_rows) * F.lit(share)))
    by_ratio = Window.orderBy(F.col("most") / F.col("w"), F.col("src").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = ((F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(onward))
    open_ = F.col("w") * F.col("level") < F.col("most")
    water = F.min(F.when(F.col("open"), F.struct("pos", "level"))).over(all_rows)
    filled = (ranked.withColumn("level", level).withColumn("pos", F.row_number().over(by_ratio))
              .withColumn("open", open_).withColumn("water", water))
    target = F.when(F.col("pos") < F.coalesce(F.col("water.pos"), F.lit(1 << 30)), F.col("most")) \
              .otherwise(F.col("w") * F.col("water.level"))
    return filled.select("src", "source_size", "sx", target.alias("target"))


def _uniform(key: Column) -> Column:
    """(0, 1): 52 bits of an md5, so that any engine can repeat it."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(":" + SEED)).cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def _ranked(rows: DataFrame, sources: DataFrame, tilt: float, cap: int) -> DataFrame:
    """Adds certain copies ``c``, ``p``, the rank ``v`` in (0, 1) and its bins."""
    r = F.col("target") / F.col("source_size")
    mean = F.col("sx") / F.col("source_size")
    a = F.lit(tilt) * F.least(r, F.lit(float(cap)) - r)
    m = r + a * (F.col("x") - mean) / F.lit(float(SCALE))
    joined = rows.join(sources, rows["src"].eqNullSafe(sources["s_src"]), "left").drop("s_src")
    out = joined.withColumn("m", F.when(F.col("size") > 0, m).otherwise(F.lit(0.0)))
    out = out.withColumn("c", F.floor("m")).withColumn("p", F.col("m") - F.col("c"))
    u, p = F.col("u"), F.col("p")
    out = out.withColumn("v", F.when(p > 0, u * (1 - p) / (u * (1 - p) + (1 - u) * p)))
    out = out.withColumn("b1", F.floor(F.col("v") * BINS))
    return out.withColumn("b2", F.floor((F.col("v") * BINS - F.col("b1")) * BINS))


def _keyed(docs: DataFrame, keep: list[Column]) -> DataFrame:
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    size = n_words(F.col("text"))
    rows = docs.select(*keep, F.col("source").alias("src"), key.alias("key"), size.alias("size"))
    x = F.floor(F.col("size") * SCALE / (F.col("size") + HALF_LENGTH))
    return rows.withColumn("x", x.cast("long")).withColumn("u", _uniform(F.col("key")))


def _cuts(rows: DataFrame, *, weights, share, cap, tilt) -> DataFrame:
    """One row a source: sizes, target and the cut of its ranks."""
    sizes = rows.groupBy("src").agg(F.sum("size").alias("source_size"),
                                    F.sum(F.col("size") * F.col("x")).alias("sx"))
    sources = cut(source_targets(sizes, weights=weights, share=share, cap=cap)
                  .withColumnRenamed("src", "s_src"), "mix-sources")
    ranked = _ranked(rows, sources, tilt, cap)
    certain = ranked.groupBy("src").agg(F.sum(F.col("c") * F.col("size")).alias("sure"))
    rest = (sources.join(certain, F.col("s_src").eqNullSafe(F.col("src"))).drop("src")
            .withColumn("rest", F.col("target") - F.col("sure")))
    for b, base in (("b1", []), ("b2", ["b1"])):
        here = ranked.filter(F.col("p") > 0)
        if base:
            near = rest.select(F.col("s_src").alias("n_src"), F.col("cut_b1").alias("n_b1"))
            here = here.join(near, here["src"].eqNullSafe(near["n_src"]) & (here["b1"] == near["n_b1"]), "left_semi")
        counts = here.groupBy("src", b).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("src").orderBy(b)
        counts = counts.withColumn("before", F.sum("words").over(run) - F.col("words"))
        left = rest.select(F.col("s_src").alias("n_src"), "rest")
        # the last bin that starts before the words that are left are full
        edge = (counts.join(left, counts["src"].eqNullSafe(left["n_src"]))
                .filter((F.col("before") < F.col("rest")) | (F.col("before") == 0))
                .groupBy("src").agg(F.max(F.struct(F.col(b), F.col("before"))).alias("edge")))
        rest = (rest.join(edge, rest["s_src"].eqNullSafe(edge["src"]), "left").drop("src")
                .withColumn("rest", F.col("rest") - F.coalesce(F.col("edge.before"), F.lit(0)))
                .withColumn(f"cut_{b}", F.col(f"edge.{b}")).drop("edge"))
        rest = cut(rest, f"mix-{b}")
    near = rest.select(F.col("s_src").alias("n_src"), "cut_b1", "cut_b2", "rest")
    last = (ranked.filter(F.col("p") > 0)
            .join(near, ranked["src"].eqNullSafe(near["n_src"]) & (F.col("b1") == F.col("cut_b1"))
                  & (F.col("b2") == F.col("cut_b2")))
            .groupBy("src", "v", "key").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")))
    run = Window.partitionBy("src").orderBy("v", "key")
    taken = last.withColumn("before", F.sum("words").over(run) - F.col("words")) \
        .filter(F.col("before") + F.col("words") / 2 <= F.col("rest"))
    final = taken.groupBy("src").agg(F.max(F.struct("v", "key")).alias("cut"))
    return (rest.join(final, rest["s_src"].eqNullSafe(final["src"]), "left").drop("src", "rest", "sure"))


def pareto_mix(docs: DataFrame, *, weights=WEIGHTS, share: float = SHARE, cap: int = CAP,
               tilt: float = TILT) -> DataFrame:
    """``docs`` (doc_id, text, source, any more) -> one row a document:
    ``doc`` (a struct of all its columns), size, source_size, target, copies,
    taken.  Documents that the mix leaves out have 0 copies."""
    slim = cut(_keyed(docs, []), "mix-rows")
    cuts = cut(_cuts(slim, weights=weights, share=share, cap=cap, tilt=tilt), "mix-cuts")
    rows = _keyed(docs, [F.struct(*[docs[c] for c in docs.columns]).alias("doc")])
    ranked = _ranked(rows, cuts, tilt, cap)
    b1, b2 = F.col("b1"), F.col("b2")
    inside = (b1 < F.col("cut_b1")) | ((b1 == F.col("cut_b1")) & (
        (b2 < F.col("cut_b2")) | ((b2 == F.col("cut_b2")) & F.coalesce(
            F.struct("v", "key") <= F.col("cut"), F.lit(False)))))
    more = ((F.col("p") > 0) & F.coalesce(inside, F.lit(False))).cast("long")
    copies = F.col("c") + more
    return ranked.select("doc", "size", "source_size", "target", copies.alias("copies"),
                         (copies * F.col("size")).alias("taken"))
