"""Chat formatting by quotation linking.

A message's lines have a quote level (leading ``>`` marks, possibly spaced).
Lines of one level that follow each other are a passage; passages are
normalised (marks off, A-Z lower-cased, every run of other than letters and
digits one space) sentence by sentence and hashed, so that re-wrapped and
partial quotes still match.  A sentence's original is the earliest message of
its conversation that wrote it at level 0.  A message replies to the earlier
message that wrote most of its level-1 sentences (by characters; ties to the
later turn); deeper levels are tried in order when the first has no original.

Replies form trees: pointer jumping gives every message its thread (the turn
of the tree's root) and depth.  Within a conversation, messages in order of
(thread, turn) are a reply-ordered conversation: a reply always has a later
turn than what it answers.

Only conversations with quotes have their sentences shuffled.  Originals are
reduced to one row a (conversation, hash) map-side first, so a sentence that a
conversation repeats very often joins one row; nothing is collected for a
whole conversation.

Defined results: null text is '' and stays a message; rows that repeat a
(conversation, turn) are separate rows with the same links; quotes without an
original are removed all the same; attribution lines directly before a quote
("On ... wrote:") go with it; a null conversation or turn is linked with
nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import cut

_MARKS = r"^((?:[ \t]{0,3}>)+)[ \t]?"
_ATTRIBUTION = r"(?i)^\s*(?:on\b.{0,200}\bwrote|.{1,100}\b(?:wrote|said|writes))\s*:\s*$"
MIN_CHARS = 12        # a shorter normalised sentence links only as a whole passage


def _lines(text: Column) -> Column:
    """array of (level, line without marks)."""
    marks = lambda s: F.regexp_extract(s, _MARKS, 1)
    return F.transform(F.split(text, r"\r\n|\r|\n"), lambda s: F.struct(
        F.length(F.regexp_replace(marks(s), "[^>]", "")).alias("level"), F.regexp_replace(s, _MARKS, "").alias("line")))


def _passages(lines: Column) -> Column:
    """array of (level, text): the lines of one level that follow each other."""
    empty = F.array().cast("array<struct<level:int,text:string>>")
    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(
            x["level"].alias("level"), F.concat(last["text"], F.lit("\n"), x["line"]).alias("text"))))
        return F.when((F.size(acc) > 0) & (last["level"] == x["level"]), grown).otherwise(
            F.concat(acc, F.array(F.struct(x["level"].alias("level"), x["line"].alias("text")))))
    return F.aggregate(lines, empty, step)


def normal(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                                   r"[^\p{L}\p{N}]+", " "))


def _sentences(text: Column) -> Column:
    """Distinct normalised sentences of a passage, and the passage itself."""
    flat = F.regexp_replace(text, r"\s+", " ")
    parts = F.transform(F.split(flat, r"(?<=[.!?])\s"), normal)
    return F.array_distinct(F.filter(F.concat(F.filter(parts, lambda s: F.length(s) >= MIN_CHARS), F.array(normal(flat))),
                                     lambda s: F.length(s) > 0))


def _unquoted(lines: Column) -> Column:
    """The text without quoted lines and the attributions before them."""
    own = F.filter(lines, lambda x, i: (x["level"] == 0) & ~(
        x["line"].rlike(_ATTRIBUTION) & F.coalesce(F.try_element_at(lines, i + 2)["level"] > 0, F.lit(False))))
    text = F.regexp_replace(F.array_join(F.transform(own, lambda x: x["line"]), "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def link(messages: DataFrame) -> DataFrame:
    """``messages`` (conv_id, turn, role, text) -> conv_id, thread, turn, depth,
    reply_to, role, text (without quotes), n_quotes, n_linked."""
    m = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("raw"))
    quoting = F.col("raw").rlike(r"(?m)^(?:[ \t]{0,3}>)")
    slim = m.select("conv_id", "turn", "raw", quoting.alias("quoting")).filter("conv_id is not null and turn is not null")
    with_quotes = slim.filter("quoting").select("conv_id").distinct()
    part = (slim.join(with_quotes, "conv_id", "left_semi")
            .select("conv_id", "turn", F.explode(_passages(_lines(F.col("raw")))).alias("p"))
            .select("conv_id", "turn", "p.level", F.explode(_sentences(F.col("p.text"))).alias("s"))
            .select("conv_id", "turn", "level", F.xxhash64("s").alias("h"), F.length("s").alias("chars")).distinct())
    part = cut(part, "quote-sentences")
    origin = part.filter("level = 0").groupBy("conv_id", "h").agg(F.min("turn").alias("origin"))
    quoted = part.filter("level > 0")
    votes = (quoted.join(origin, ["conv_id", "h"]).filter("origin < turn")
             .groupBy("conv_id", "turn", "level", "origin").agg(F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("n")))
    best = votes.groupBy("conv_id", "turn").agg(
        F.max(F.struct((-F.col("level")).alias("near"), "chars", "origin")).alias("b"), F.sum("n").alias("n_linked"))
    reply = cut(best.select("conv_id", "turn", F.col("b.origin").alias("reply_to"), "n_linked"), "quote-replies")
    # pointer jumping over the messages that reply
    reach = reply.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).alias("depth"))
    while True:
        up = reach.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("u_thread"), F.col("depth").alias("u_depth"))
        step = cut(reach.join(up, ["conv_id", "thread"], "left")
                   .select("conv_id", "turn", F.coalesce("u_thread", "thread").alias("thread"),
                           (F.col("depth") + F.coalesce("u_depth", F.lit(0))).alias("depth"),
                           F.col("u_thread").isNotNull().alias("moved")), "quote-threads")
        reach = step.drop("moved")
        if step.filter("moved").isEmpty():
            break
    links = reply.join(reach, ["conv_id", "turn"])
    lines = _lines(F.col("raw"))
    out = m.join(links, ["conv_id", "turn"], "left")
    clean = F.when(quoting, _unquoted(lines)).otherwise(F.col("raw"))
    n_quotes = F.when(quoting, F.size(F.filter(_passages(lines), lambda p: p["level"] > 0))).otherwise(F.lit(0))
    return out.select("conv_id", F.coalesce("thread", "turn").alias("thread"), "turn", F.coalesce("depth", F.lit(0)).alias("depth"),
                      "reply_to", "role", clean.alias("text"), n_quotes.cast("long").alias("n_quotes"),
                      F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"))


def to_chat(linked: DataFrame) -> DataFrame:
    """Adds ``chat``: the message in a plain chat layout, role line and text."""
    return linked.withColumn("chat", F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), "text", F.lit("\n")))
