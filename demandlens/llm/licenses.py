"""Licence scan by a positional index of rare licence words.

Licence notices are kept as templates: label, words, and the key phrases that must
not be missing.  Their words are the licence vocabulary.  A word's weight is its
information over all documents in whole bits (one more than the binary digits of
N / (documents with it + 1)), which any engine computes alike.

1. A file looks up its licence words of the highest weights: those at or above the
   least weight that some template's rarest key word has.  So every template keeps a
   word of a key phrase among the looked-up ones, and none can be missed.
2. The index has the postings (word, template, place).  A file's word at ``p`` and a
   posting at ``q`` vote for the template at offset ``p - q``; votes for one offset
   are words in the template's relative positions.  An alignment that holds half of
   the template's looked-up weight is a candidate.
3. A candidate is verified when every key phrase stands, word by word, within
   ``SLACK`` words of its place in the alignment, so a filled-in name or year before
   it does no harm.

Besides the templates' labels, three plain phrases give base labels wherever their
words stand one after the other.

Only DataFrame functions are used.  Texts are read twice, by narrow passes: for the
document frequencies (summed map-side to one row a licence word) and for what the
rest needs, a small row a document with its places.  That row has a number of its
own, written down once, so later joins have no hot key.  Templates, postings and
weights are as large as the list below, whatever the input.

Defined results: a null text is empty; a file without words has no places, null
first and last word, empty labels and score 0; repeated rows give equal results; the
score is the best verified share of a template's weight; an empty table has no rows.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import cut
from demandlens.sources.local import local_frame

# The separators of words, the plain phrases, and the notices of
# public licences with their key phrases.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files", ("permission is hereby granted free of charge", "associated documentation files")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted", ("copy modify and or distribute this software", "with or without fee is hereby granted")),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("epl-2.0", "under the terms of the eclipse public license 2 0", ("eclipse public license 2 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc0", "released under cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held "
             "liable", ("without any express or implied warranty", "authors be held liable")),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited", ("unauthorized copying of this file",)),
)
SLACK = 8
VOCABULARY = sorted({w for _, text, _ in TEMPLATES for w in text.split()})
PHRASES = sorted({p for _, _, phrases in TEMPLATES for p in phrases})
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def weight(files: int, with_word: int) -> int:
    """Information of a word in whole bits, at least 1."""
    return 1 + (files // (with_word + 1)).bit_length()


def word_weights(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """The weight of every licence word over all documents: one row a word."""
    vocabulary = F.array(*[F.lit(w) for w in VOCABULARY])
    # the empty word stands for the document itself
    seen = F.concat(F.array(F.lit("")), F.array_intersect(words(F.col(text)), vocabulary))
    counts = dict(docs.select(F.explode(seen).alias("word")).groupBy("word").count().collect())
    return {w: weight(counts.get("", 0), counts.get(w, 0)) for w in VOCABULARY}


def looked_up(weights: dict[str, int]) -> dict[str, int]:
    """The words of the highest weights, down to the last template's rarest key word."""
    least = min(max(weights[w] for p in phrases for w in p.split()) for _, _, phrases in TEMPLATES)
    return {w: b for w, b in weights.items() if b >= least}


def _starts(tokens: Column, joined: Column, phrase: str) -> Column:
    """Where the phrase's words stand one after the other; only texts with it are walked."""
    parts = phrase.split()
    last = F.size(tokens) - len(parts)

    def at(i: Column) -> Column:
        cond = F.get(tokens, i) == parts[0]
        for k, w in enumerate(parts[1:], 1):
            cond = cond & (F.get(tokens, i + k) == w)
        return cond

    return F.when(joined.contains(f" {phrase} "), F.filter(F.sequence(F.lit(0), last), at)).otherwise(F.array().cast("array<int>"))


def _tagged(starts: Column, tag: Column) -> Column:
    return F.transform(starts, lambda i: F.struct(tag, i.alias("at")))


def places(docs: DataFrame, probes: dict[str, int]) -> DataFrame:
    """(file, doc_id, n_words, base, hits, found): every document's starts of the base
    phrases, its looked-up words and its key phrases, with a number of its own."""
    tokens, joined = F.col("tokens"), F.col("joined")
    read = docs.select("doc_id", words(F.col("text")).alias("tokens"))
    read = read.select("*", F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" ")).alias("joined"))
    base = F.flatten(F.array(*[_tagged(_starts(tokens, joined, p), F.lit(label).alias("label")) for p, label in BASE]))
    hit = F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in probes]))
    hits = F.filter(F.transform(tokens, lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: x["word"].isin(*probes))
    found = F.flatten(F.array(*[_tagged(_starts(tokens, joined, p), F.lit(k).alias("phrase")) for k, p in enumerate(PHRASES)]))
    return read.select(F.monotonically_increasing_id().alias("file"), "doc_id", F.size(tokens).cast("long").alias("n_words"),
                       base.alias("base"), F.when(hit, hits).alias("hits"), F.when(hit, found).alias("found"))


def matches(files: DataFrame, probes: dict[str, int]) -> DataFrame:
    """(file, label, share): verified alignments of ``places``."""
    spark = files.sparkSession
    postings, needs = [], []
    for t, (label, text, phrases) in enumerate(TEMPLATES):
        parts = text.split()
        total = sum(probes.get(w, 0) for w in parts)
        postings += [(w, t, q, probes[w]) for q, w in enumerate(parts) if w in probes]
        for p in phrases:
            q = f" {text} ".index(f" {p} ")
            needs.append((PHRASES.index(p), t, len(text[:q].split()), len(phrases), total, label))
    index = F.broadcast(local_frame(spark, postings, [("word", "STRING"), ("template", "INT"), ("place", "INT"), ("weight", "INT")]))
    keys = F.broadcast(local_frame(spark, needs, [("phrase", "INT"), ("template", "INT"), ("place", "INT"), ("n_phrases", "INT"),
                                                  ("total", "INT"), ("label", "STRING")]))
    votes = (files.filter("hits is not null").select("file", F.explode("hits").alias("h")).select("file", "h.word", "h.at")
             .join(index, "word").groupBy("file", "template", (F.col("at") - F.col("place")).alias("offset"))
             .agg(F.sum("weight").alias("got")))
    candidates = votes.withColumn("near", F.floor(F.col("offset") / SLACK))
    bucket = F.floor(F.col("due") / SLACK)
    due = (files.filter("found is not null").select("file", F.explode("found").alias("f")).select("file", "f.phrase", "f.at")
           .join(keys, "phrase").select("file", "template", "phrase", "n_phrases", "total", "label", (F.col("at") - F.col("place")).alias("due"))
           .select("*", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("near")))
    return (candidates.join(due, ["file", "template", "near"])
            .filter((2 * F.col("got") >= F.col("total")) & (F.abs(F.col("offset") - F.col("due")) <= SLACK))
            .groupBy("file", "template", "offset", "got", "n_phrases", "total", "label")
            .agg(F.countDistinct("phrase").alias("stands")).filter("stands = n_phrases")
            .select("file", "label", (F.col("got") / F.col("total")).alias("share")))


def scan(docs: DataFrame) -> DataFrame:
    """Licence labels of every document, from base phrases and templates."""
    docs = docs.select("doc_id", "text")
    probes = looked_up(word_weights(docs))
    files = cut(places(docs, probes), "licence-places")
    per_file = matches(files, probes).groupBy("file").agg(F.collect_set("label").alias("more"), F.max("share").alias("score"))
    at, base = F.expr("transform(base, b -> b.at)"), F.expr("array_distinct(transform(base, b -> b.label))")
    every = F.array_union(base, F.coalesce("more", F.array().cast("array<string>")))
    return files.join(per_file, "file", "left").select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"), F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
