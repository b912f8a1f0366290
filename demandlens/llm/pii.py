"""Personal data: base patterns plus bootstrapped contextual extraction.

1. Base spans (email, ip, card, phone) are the leftmost non-overlapping
   matches of fixed patterns; a match that fails its kind's check is dropped.
   Positions come from splitting the text at the same matches, in code points.
2. Every word with a digit or an ``@`` is a candidate instance.  Its contexts
   are the lexical patterns (left word, shape) and (right word, shape), where
   the shape writes digits as 0 and runs of letters as a.
3. Candidates inside base spans are seeds of that kind.  On the graph of
   patterns and instances, Spark scores by turns: a pattern's score for a kind
   is the share of its distinct instances that are that kind, smoothed, and an
   instance's score is one minus the product of (1 - score) of its patterns.
   An unseen instance of a confident pattern becomes a seed of the next round,
   so patterns that no base span supports are learnt from what was discovered.
4. After ``ROUNDS`` rounds, patterns with a score of at least ``CONFIDENT`` from
   at least ``SUPPORT`` distinct seeds discover their unseen instances; every
   place of a discovered instance, in any context, is added as a span of the
   pattern's kind (of several, the first).  Base spans always stay.

Only DataFrame functions are used.  The two passes over the texts are narrow;
what is shuffled is the candidates' short contexts, summed map-side to
distinct (pattern, instance) pairs.  Pattern scores are joined to the pairs
with a salt on both sides, so that one very common context is spread.  Spans
depend on the text alone, so additions are found once for each distinct text
(by its SHA-256) and joined back to the narrow rows, not to the texts.

Defined results: a null text counts as empty; without matches the digest is
that of the empty string and ``spans`` is ''; repeated rows and copies give
equal results; an empty table gives an empty result.  Context words longer
than 64 characters are cut to the 64 nearest the candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlens.llm.common import cut

# The kinds in the order of the digest, and their patterns.  They
# match what the plain patterns match; possessive repeats and the rule that a
# match starts at the start of its run (or where the last match ended) keep
# the work linear in very long runs.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = r"(?<![^ \t-\r])[^0-9@ \t-\r]*+[0-9@][^ \t-\r]*+"

ROUNDS = 2
SUPPORT = 5
CONFIDENT = 0.9
SMOOTH = 1.0
SALTS = 16
RUN = 128
CONTEXT = 64


def _with_running_sums(df: DataFrame, numbers: Column, name: str) -> DataFrame:
    """Adds ``name``: the sums of the first, the first two, ... of an array, by runs of
    ``RUN`` numbers and then over the runs: appending to one long array would copy it
    for every number.  Each step is a column that the next reads more than once, so
    that Spark does not move it into the lambda that reads it."""
    add = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))
    none = F.array().cast("array<int>")
    df = df.withColumn("_l", numbers)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("_l") / RUN).cast("int") - 1, F.lit(0))),
                       lambda c: F.aggregate(F.slice("_l", c * RUN + 1, F.lit(RUN)), none, add))
    df = df.withColumn("_r", runs)
    last = F.transform("_r", lambda r: F.coalesce(F.try_element_at(r, F.lit(-1)), F.lit(0)))
    before = F.slice(F.concat(F.array(F.lit(0)), F.aggregate(last, none, add)), 1, F.size("_r"))
    return df.withColumn(name, F.flatten(F.zip_with("_r", before, lambda r, b: F.transform(r, lambda e: e + b)))).drop("_l", "_r")


def _pieces(df: DataFrame, name: str, pattern: str, text: str = "_t") -> DataFrame:
    """Adds ``name``: array of (start, end, word, before, after) of the matches."""
    p = F.lit(pattern)
    df = (df.withColumn("_m", F.regexp_extract_all(F.col(text), p, F.lit(0)))
            .withColumn("_s", F.when(F.size("_m") > 0, F.split(F.col(text), pattern, -1))
                        .otherwise(F.array().cast("array<string>"))))
    lengths = F.transform("_m", lambda m, i: F.length(F.element_at("_s", i + 1)) + F.length(m))
    df = _with_running_sums(df, lengths, "_e")
    spans = F.transform("_m", lambda m, i: F.struct(
        (F.element_at("_e", i + 1) - F.length(m)).alias("start"), F.element_at("_e", i + 1).alias("end"),
        m.alias("word"),
        F.when(i == 0, F.element_at("_s", i + 1)).otherwise(
            F.concat(F.element_at("_m", F.greatest(i, F.lit(1))), F.element_at("_s", i + 1))).alias("before"),
        F.concat(F.element_at("_s", i + 2), F.coalesce(F.try_element_at("_m", i + 2), F.lit(""))).alias("after")))
    return df.withColumn(name, spans).drop("_m", "_s", "_e")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.split(F.reverse(_digits(m)), "")
    total = F.aggregate(F.transform(d, lambda x, i: F.when(
        i % 2 == 1, F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), x.cast("int") + 1))
        .otherwise(x.cast("int"))), F.lit(0), lambda acc, x: acc + x)
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda x: F.coalesce(
            F.length(F.regexp_replace(x, "^0+", "")) <= 3, F.lit(False))
            & (F.substring(F.regexp_replace(x, "^0+(?=[0-9])", ""), 1, 4).cast("int") <= 255))
    if kind == "card":
        return n.between(13, 19) & F.when(n.between(13, 19), _luhn(m)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def base_spans(df: DataFrame, text: str = "_t") -> DataFrame:
    """Adds ``_base``: array of (kind number, start, end), by kind and start."""
    found = []
    for k, kind in enumerate(KINDS):
        df = _pieces(df, "_x", PATTERNS[kind], text)
        good = F.filter("_x", lambda x: _valid(kind, x["word"]))
        df = df.withColumn(f"_{kind}", F.transform(good, lambda x: F.struct(
            F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))).drop("_x")
        found.append(f"_{kind}")
    return df.withColumn("_base", F.concat(*found)).drop(*found)


def _shape(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, "[0-9]", "0"), r"\p{L}+", "a")


def _context(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), "[0-9]", "0")


def with_candidates(df: DataFrame, text: str = "_t") -> DataFrame:
    """Adds ``_cand``: array of (start, end, kind or null, word, shape, left, right).
    Start and end are those of the word without outer punctuation."""
    df = _pieces(df, "_x", CANDIDATE, text)
    last = lambda s: F.regexp_extract(F.right(F.rtrim(F.regexp_replace(F.right(s, F.lit(2 * CONTEXT)), r"[\t-\r]", " ")),
                                              F.lit(CONTEXT)), "([^ ]*)$", 1)
    first = lambda s: F.regexp_extract(F.ltrim(F.regexp_replace(F.left(s, F.lit(2 * CONTEXT)), r"[\t-\r]", " ")),
                                       "^([^ ]{0,64})", 1)

    def trimmed(x):
        lead = F.length(F.regexp_extract(x["word"], r"^[^\p{L}0-9+@]*", 0))
        core = F.regexp_replace(F.substring(x["word"], lead + 1, F.length(x["word"])), r"[^\p{L}0-9]+$", "")
        return F.struct((x["start"] + lead).alias("start"), (x["start"] + lead + F.length(core)).alias("end"),
                        core.alias("word"), last(x["before"]).alias("left"), first(x["after"]).alias("right"))

    df = df.withColumn("_x", F.filter(F.transform("_x", trimmed), lambda x: F.length(x["word"]) > 0))

    def labelled(x):
        kind = F.array_min(F.transform(
            F.filter("_base", lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"])), lambda b: b["kind"]))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), kind.alias("kind"), x["word"].alias("word"),
                        _shape(x["word"]).alias("shape"), _context(x["left"]).alias("left"),
                        _context(x["right"]).alias("right"))

    return df.withColumn("_cand", F.transform("_x", labelled)).drop("_x")


def _occurrences(rows: DataFrame) -> DataFrame:
    """One row a candidate and side: (tx, start, end, kind, inst, pat)."""
    c = rows.select("tx", F.explode("_cand").alias("c")).select("tx", "c.*")
    pat = lambda side, word: F.xxhash64(F.lit(side), word, F.col("shape"))
    sides = F.array(F.when(F.length("left") > 0, pat("l", F.col("left"))),
                    F.when(F.length("right") > 0, pat("r", F.col("right"))))
    return (c.withColumn("inst", F.xxhash64("word", "shape")).withColumn("pat", F.explode(F.array_compact(sides)))
             .select("tx", "start", "end", "kind", "inst", "pat"))


def learn_patterns(occurrences: DataFrame, *, rounds: int = ROUNDS, support: int = SUPPORT,
                   confident: float = CONFIDENT) -> DataFrame:
    """The scored pattern-instance graph: (pat, kind) of confident patterns."""
    pairs = cut(occurrences.groupBy("pat", "inst").agg(F.min("kind").alias("kind")), "pii-graph")
    scores = None
    for _ in range(rounds):
        edges = pairs.select("pat", "inst", "kind", F.when(F.col("kind").isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0)).alias("s"))
        if scores is not None:
            salt = F.pmod("inst", F.lit(SALTS))
            spread = scores.select("pat", F.col("kind").alias("p_kind"), "score",
                                   F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).alias("salt"))
            open_ = pairs.filter(F.col("kind").isNull()).withColumn("salt", salt)
            guess = (open_.join(spread, ["pat", "salt"])
                     .groupBy("inst", F.col("p_kind").alias("kind"))
                     .agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("s"), F.max("score").alias("top")))
            # what a confident pattern discovered is a seed from here on
            guess = guess.withColumn("s", F.when(F.col("top") >= confident, 1.0).otherwise(F.col("s")))
            best = guess.groupBy("inst").agg(F.max(F.struct("s", "kind")).alias("b")) \
                        .select("inst", F.col("b.kind").alias("g_kind"), F.col("b.s").alias("g"))
            known = edges.filter(F.col("kind").isNotNull())
            guessed = (edges.filter(F.col("kind").isNull()).join(best, "inst", "left")
                       .select("pat", "inst", F.col("g_kind").alias("kind"), F.coalesce("g", F.lit(0.0)).alias("s")))
            edges = known.unionByName(guessed)
        by_kind = (edges.groupBy("pat", "kind").agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("n"),
                                                    F.sum((F.col("s") == 1.0).cast("long")).alias("seeds")))
        scores = (by_kind.groupBy("pat").agg(F.sum("n").alias("n"), F.max(F.struct("s", "kind", "seeds")).alias("top"))
                  .select("pat", F.col("top.kind").alias("kind"), F.col("top.seeds").alias("seeds"),
                          (F.col("top.s") / (F.col("n") + SMOOTH)).alias("score"))
                  .filter(F.col("kind").isNotNull() & (F.col("seeds") >= support)))
        scores = cut(scores, "pii-scores")
    return scores.filter(F.col("score") >= confident).select("pat", "kind")


def _line(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, *, rounds: int = ROUNDS, support: int = SUPPORT,
             confident: float = CONFIDENT) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, tx (SHA-256 of the text), base and
    spans as arrays of (kind number, start, end)."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    rows = with_candidates(base_spans(text)).select("doc_id", F.sha2("_t", 256).alias("tx"),
                                                    F.col("_base").alias("base"), "_cand")
    rows = cut(rows, "pii-rows")
    occ = _occurrences(rows)
    patterns = learn_patterns(occ, rounds=rounds, support=support, confident=confident)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).alias("salt")
    open_ = occ.filter(F.col("kind").isNull())
    found = cut(open_.withColumn("salt", F.pmod("inst", F.lit(SALTS)))
                .join(patterns.select("pat", F.col("kind").alias("p_kind"), salts), ["pat", "salt"])
                .groupBy("inst").agg(F.min("p_kind").alias("i_kind")), "pii-found")
    more = (open_.withColumn("salt", F.pmod(F.xxhash64("tx", "start"), F.lit(SALTS)))
            .join(found.select("inst", "i_kind", salts), ["inst", "salt"])
            .groupBy("tx", "start", "end").agg(F.min("i_kind").alias("kind"))
            .groupBy("tx").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more")))
    more = more.withColumnRenamed("tx", "m_tx")
    joined = rows.join(more, rows["tx"] == more["m_tx"], "left")
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:int,start:int,end:int>>"))))
    return joined.select("doc_id", "tx", "base", spans.alias("spans"))


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans."""
    count = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
                        F.sha2(_line(F.col("base")), 256).alias("base_sha256"), _line(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with every found span written as ``[kind]`` in the text;
    overlapping spans become one, named by the first; ``n_chars``, where there
    is one, becomes the new length of a changed text.  Other columns stay."""
    spans = found.filter(F.size("spans") > 0).groupBy(F.col("tx").alias("s_tx")).agg(F.first("spans").alias("spans"))
    # a row travels as one column, so that no column of ``docs`` clashes with those of the join
    keyed = docs.select(F.struct("*").alias("doc"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("d_tx"))
    joined = keyed.join(spans, F.col("d_tx") == F.col("s_tx"), "left").withColumn("text", F.col("doc.text"))
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                                                    s["kind"].alias("kind"))))
    step = lambda acc, s: F.struct(
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, s["start"] - acc["at"]),
                                                F.element_at(names, s["kind"] + 1))).otherwise(acc["out"]).alias("out"),
        F.greatest(acc["at"], s["end"]).alias("at"))
    done = F.aggregate(by_start, state, step,
                       lambda acc: F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, F.length("text"))))
    joined = joined.withColumn("new", F.when(F.col("spans").isNotNull(), done).otherwise(F.col("text")))
    new = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("spans").isNotNull(), F.length("new").cast("long")).otherwise(F.col("doc.n_chars"))
    return joined.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
