"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary of pieces (a sentencepiece model file, its path a
parameter) gives every language a unigram distribution over pieces.  The
probability of a word is the sum over all its segmentations into pieces,
computed by the forward algorithm

    alpha[0] = 1,  alpha[i] = sum over pieces ending at i of alpha[i - len] p(piece)

and a text's log probability is the sum over its words (pieces do not cross
white space).  The language with the largest posterior under equal priors wins.

Learning counts pieces (as the vocabulary's own segmentation gives them) in
training documents, at most about ``PER_LANG`` a language: a document is in
the sample when the hash of its id is below PER_LANG / documents of its
language.  Counts are summed in Spark, (language, piece) rows only; smoothed
counts, languages x vocabulary, are what is collected and broadcast.

Scoring reads whole texts in one narrow pass; the forward sums run over all
distinct words of one length in a batch of texts together.

Defined results: documents whose id is null are not learned from and not held
out; a null text, or one without letters, is ``und`` with score 0; so is
everything if nothing can be learned; ties go to the first language by code
point; words over ``LONG`` characters are scored in parts of that length;
characters outside the vocabulary have one small probability in any language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import prepare

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
PER_LANG = 3000
SMOOTH = 0.1
LONG = 24
SLICE = 512


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def load_pieces(model: bytes) -> list[str]:
    """The vocabulary's text pieces; control and byte pieces are left out."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


def _counter(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        counts: dict[str, Counter] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE).to_pydict()
                for lang, ids in zip(part["lang"], sp.encode(part["text"], num_threads=1)):
                    counts.setdefault(lang, Counter()).update(ids)
        for lang, c in counts.items():
            yield pa.record_batch([pa.array([lang] * len(c), pa.string()),
                                   pa.array([sp.id_to_piece(i) for i in c], pa.string()),
                                   pa.array(list(c.values()), pa.int64())], names=["lang", "piece", "n"])
    return run


def piece_counts(docs: DataFrame, model, per_lang: int = PER_LANG) -> DataFrame:
    """(lang, piece, n) over the sample of the training documents of ``docs``."""
    train = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id")) != 0))
    # one number a language: the rate is an expression, so the texts are not shuffled
    rate = F.lit(0.0)
    for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).collect():
        rate = F.when(F.col("lang") == r.lang, F.lit(per_lang / r.docs)).otherwise(rate)
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("langid")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = train.filter(place < rate)
    return sample.select("lang", "text").mapInArrow(_counter(model), "lang string, piece string, n long") \
                 .groupBy("lang", "piece").agg(F.sum("n").alias("n"))


class Trie:
    """Every prefix of every piece by its polynomial hash, with the row of the
    piece that it is (or none)."""

    BITS = 19

    def __init__(self, pieces: list[str]):
        rows: dict[str, int] = {}
        for i, piece in enumerate(pieces):
            for k in range(1, len(piece)):
                rows.setdefault(piece[:k], -1)
            rows[piece] = i
        keys = np.array([self._hash(x) for x in rows], dtype=np.uint64)
        values = np.array(list(rows.values()), dtype=np.int64)
        self.slots = []
        while len(keys):                      # a further layer for what shares a bucket
            at, first = np.unique(self._bucket(keys), return_index=True)
            layer = (np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, -1, np.int64))
            layer[0][at], layer[1][at] = keys[first], values[first]
            self.slots.append(layer)
            keys, values = np.delete(keys, first), np.delete(values, first)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * _BASE + ord(c) + 1) % (1 << 64)
        return h

    @classmethod
    def _bucket(cls, h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - cls.BITS)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is a prefix, row or -1) of hashes."""
        b = self._bucket(h)
        known, row = np.zeros(len(h), bool), np.full(len(h), -1, np.int64)
        for keys, values in self.slots:
            also = np.flatnonzero(keys[b] == h)
            known[also] = True
            row[also] = values[b[also]]
        return known, row


_BASE = 0x100000001B3
_SPACES = np.array([chr(i).isspace() for i in range(1 << 16)])
_LETTERS = np.array([chr(i).isalpha() for i in range(0x110000)])
_MARK = 0x2581          # the vocabulary's sign for the start of a word


class Scorer:
    """log P(text | language), the forward algorithm run over all distinct words
    of one length in a batch of texts together."""

    def __init__(self, pieces: list[str], probs: np.ndarray, unknown: np.ndarray):
        self.trie = Trie(pieces)
        self.p, self.unknown = probs, unknown

    def _forward(self, codes: np.ndarray) -> np.ndarray:
        """(words, characters) -> (words, languages) log probabilities."""
        words, n = codes.shape
        alpha = np.zeros((n + 1, words, len(self.unknown)))
        alpha[0] = 1.0
        codes = codes.T.astype(np.uint64) + np.uint64(1)
        for j in range(n):
            live, h = np.arange(words), np.zeros(words, dtype=np.uint64)
            for i in range(j, n):
                h = h * np.uint64(_BASE) + codes[i][live]
                known, row = self.trie.find(h)
                hit = np.flatnonzero(row >= 0)
                if len(hit):
                    alpha[i + 1][live[hit]] += alpha[j][live[hit]] * self.p[row[hit]]
                if i == j:
                    strange = np.flatnonzero(row < 0)
                    alpha[i + 1][strange] += alpha[j][strange] * self.unknown
                live, h = live[known], h[known]
                if not len(live):
                    break
        return np.log(np.maximum(alpha[n], 1e-300))

    def scores(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Log probabilities of whole texts; None without letters."""
        joined = "\n".join(t or "" for t in texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if not len(codes):
            return [None] * len(texts)
        low = np.minimum(codes, 0xFFFF)
        letters = np.concatenate(([0], np.cumsum(_LETTERS[codes])))
        ends = np.cumsum([len(t or "") + 1 for t in texts])
        firsts = ends - np.array([len(t or "") + 1 for t in texts])
        has = letters[np.minimum(ends - 1, len(codes))] > letters[firsts]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACES[low], [True])).view(np.int8)))
        starts, size = edge[0::2], edge[1::2] - edge[0::2]
        parts = (size + LONG - 1) // LONG
        if len(parts) and parts.max() > 1:          # long words in parts
            rank = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            starts, size = np.repeat(starts, parts) + LONG * rank, np.repeat(size, parts) - LONG * rank
            size = np.minimum(size, LONG)
        else:
            rank = np.zeros(len(starts), dtype=np.int64)
        owner = np.searchsorted(ends, starts, side="right")
        total = np.zeros((len(texts), len(self.unknown)))
        for n in np.unique(size):
            for head in (True, False):
                mine = np.flatnonzero((size == n) & ((rank == 0) == head))
                if not len(mine):
                    continue
                chars = codes[starts[mine][:, None] + np.arange(n)]
                h = np.zeros(len(mine), dtype=np.uint64)
                for k in range(n):
                    h = h * np.uint64(_BASE) + chars[:, k] + np.uint64(1)
                _, first, back = np.unique(h, return_index=True, return_inverse=True)
                word = chars[first]
                if head:
                    word = np.concatenate((np.full((len(word), 1), _MARK, dtype=np.uint32), word), axis=1)
                logp = np.concatenate([self._forward(word[a:a + 8192]) for a in range(0, len(word), 8192)])
                for k in range(total.shape[1]):
                    total[:, k] += np.bincount(owner[mine], weights=logp[back, k], minlength=len(texts))
        return [total[i] if has[i] else None for i in range(len(texts))]


def _predictor(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, pieces, probs, unknown = model.value
        old = np.seterr(over="ignore")
        scorer = Scorer(pieces, probs, unknown) if langs else None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = part.column(2).to_pylist()
                pred, score = [], []
                for s in (scorer.scores(texts) if scorer else [None] * len(texts)):
                    best = 0 if s is None else int(np.argmax(s))
                    pred.append("und" if s is None else langs[best])
                    score.append(0.0 if s is None else float(1.0 / np.exp(s - s[best]).sum()))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(pred, pa.string()),
                                       pa.array(score, pa.float64())],
                                      names=["doc_id", "held_out", "lang_pred", "score"])
        np.seterr(**old)
    return run


def learn(docs: DataFrame, *, vocabulary: str = VOCABULARY, per_lang: int = PER_LANG):
    """(languages, pieces, probabilities, unknown probability) of ``docs``."""
    with open(vocabulary, "rb") as f:
        raw = f.read()
    pieces = load_pieces(raw)
    counts = piece_counts(docs, docs.sparkSession.sparkContext.broadcast(raw), per_lang).collect()
    langs = sorted({r.lang for r in counts})
    row = {p: i for i, p in enumerate(pieces)}
    n = np.full((len(pieces) + 1, len(langs)), SMOOTH)
    for r in counts:
        if r.piece in row:
            n[row[r.piece], langs.index(r.lang)] += r.n
    p = n / n.sum(axis=0) if langs else n
    # the same for every language: a strange character says nothing about it
    unknown = np.full(len(langs), 1e-7)
    return langs, pieces, p[:-1], unknown


def identify(docs: DataFrame, *, vocabulary: str = VOCABULARY, per_lang: int = PER_LANG) -> DataFrame:
    """``docs`` (doc_id, text, lang) -> doc_id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    prepare(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = spark.sparkContext.broadcast(learn(base, vocabulary=vocabulary, per_lang=per_lang))
    held = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    return base.select("doc_id", held.alias("held_out"), "text") \
               .mapInArrow(_predictor(model), "doc_id long, held_out boolean, lang_pred string, score double")
