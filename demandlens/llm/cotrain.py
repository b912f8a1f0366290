"""Quality classifier by co-training on two views of a document.

* Content view: hashed byte trigrams of the whole text (log counts, unit
  length) and how often words repeat the word before.
* Metadata view: source, language and length columns (hashed or binned) and
  the page's layout: line and word lengths, shares of capitals, digits and
  signs, share of distinct words.

Each view has a logistic regression.  Over ``ROUNDS`` rounds the view's most
confident documents of an unlabelled pool become pseudo-labels for the other
view, in the class balance of the labels.  Both are then calibrated (Platt) on
labelled documents that no round trained on, and combined as independent
views: the sum of their calibrated log odds less the prior's.

Fitting uses bounded samples: about ``LABELLED`` labelled and ``POOL``
unlabelled documents, taken by a hash of their ids at a rate computed from the
counts (both parameters).  Labelled documents are sampled by class: half of
``LABELLED`` each, or all that there are, the other class filling up the rest; a
quarter of each class, one at least, is kept for calibration.  The share of
the classes in the whole table is put back into the prior and the calibration.
The only broadcast is that sample of ids and the
two weight vectors.  Every document is scored, from its whole text, in one
narrow pass.

Defined results: a null text is scored as empty; labels that are null, or that
contradict each other for one document, are left out; without two labelled
documents of each class every document gets score 1 (nothing is rejected); repeated rows get
equal scores; extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import prepare
from demandlens.llm.shingles import word_hashes

LABELLED = 4000
POOL = 4000
ROUNDS = 3
GIVE = 0.1                # share of the pool that a view labels in a round
SURE = 0.95
TRIGRAMS = 2048
CONTENT = TRIGRAMS + 11
META = 64 + 16 + 32 + 7 * 12
KEEP = 0.25              # least score of a document that stays
SLICE = 256
SCORES = "__quality"
_SCORE_TYPE = pa.struct([("score", pa.float64()), ("content", pa.float64()), ("meta", pa.float64())])


def _bin(x: float, bins: int = 11) -> int:
    return int(min(max(x, 0.0), 1.0) * (bins - 1) + 0.5)


def content_view(text: str | None) -> np.ndarray:
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.int64)
    out = np.zeros(CONTENT, dtype=np.float32)
    if len(b) > 2:
        h = (b[:-2] * 7919 + b[1:-1] * 104729 + b[2:] * 1299709) % 2_147_483_647 * 31 // 7 % TRIGRAMS
        c = np.log1p(np.bincount(h, minlength=TRIGRAMS))
        out[:TRIGRAMS] = c / np.sqrt((c * c).sum())
    w = word_hashes(text)
    out[TRIGRAMS + _bin((w[1:] == w[:-1]).mean() * 4 if len(w) > 1 else 0.0)] = 1.0
    return out


def _slot(value, slots: int) -> int:
    h = 0
    for c in ("\0" if value is None else str(value)).encode():
        h = (h * 257 + c + 1) % 1_000_003
    return h % slots


def meta_view(text: str | None, source, lang, n_chars) -> np.ndarray:
    text = text or ""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n, w = max(len(b), 1), word_hashes(text)
    out = np.zeros(META, dtype=np.float32)
    out[_slot(source, 64)] = 1.0
    out[64 + _slot(lang, 16)] = 1.0
    out[80 + min(int(2 * np.log2(1 + max(len(text) if n_chars is None else n_chars, 0))), 31)] = 1.0
    lines = 1 + int((b == 10).sum())
    kinds = np.bincount(_KIND[b], minlength=4) / n
    shares = (np.log2(1 + n / lines) / 16, kinds[1] * 2, kinds[2] * 5, kinds[3] * 2,
              n / (len(w) + 1) / 16, len(np.unique(w)) / max(len(w), 1), np.log2(1 + lines) / 12)
    for k, x in enumerate(shares):
        out[112 + 12 * k + _bin(float(x), 12)] = 1.0
    return out


_KIND = np.zeros(256, dtype=np.int64)
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 200) -> np.ndarray:
    """Weights (last: intercept) by accelerated gradient descent; classes weigh the same."""
    return _fit(_rows(x, np.arange(len(x))), y, ridge, steps)


def _rows(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Some rows of ``x`` with a last column of ones, copied once, a few at a time."""
    out = np.ones((len(rows), x.shape[1] + 1), dtype=x.dtype)
    for at in range(0, len(rows), SLICE):
        out[at:at + SLICE, :-1] = x[rows[at:at + SLICE]]
    return out


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 200) -> np.ndarray:
    """``fit_logistic`` of rows that have their column of ones already."""
    c = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1)).astype(x.dtype)
    bound = 0.25 * float(c @ np.einsum("ij,ij->i", x, x)) + ridge
    w, z = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for k in range(steps):
        p = _sigmoid(x @ z.astype(x.dtype))
        new = z - (x.T @ (c * (p - y)).astype(x.dtype) + ridge * z) / bound
        z = new + k / (k + 3.0) * (new - w)
        w = new
    return w


def _sigmoid(t):
    return 1.0 / (1.0 + np.exp(-np.clip(t, -40, 40)))


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _logits(x: np.ndarray, rows: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``_logit`` of some rows, a few at a time: no copy of all of them in double precision."""
    return np.concatenate([np.zeros(0), *[_logit(x[rows[at:at + SLICE]], w) for at in range(0, len(rows), SLICE)]])


def platt(t: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b): the calibrated log odds are a t + b.  Newton steps on smoothed targets."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    def loss(a, b):
        z = a * t + b
        return (np.logaddexp(0.0, z) - target * z).sum() + 5e-3 * (a - 1.0) ** 2

    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * t + b)
        g = np.array([((p - target) * t).sum() + 1e-2 * (a - 1.0), (p - target).sum()])
        s = p * (1 - p)
        h = np.array([[(s * t * t).sum() + 1e-2, (s * t).sum()], [(s * t).sum(), s.sum() + 1e-6]])
        step, size, now = np.linalg.solve(h, g), 1.0, loss(a, b)
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(size * step).max() < 1e-8:
            break
    return float(a), float(b)


def split(ids: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Marks a quarter of the labelled documents of each class, by a hash of
    their ids; both parts get a document of a class that has two or more."""
    held = np.zeros(len(y), bool)
    for label in (0, 1):
        of = np.unique(ids[y == label])
        place = of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        some = of[np.argsort(place, kind="stable")[:max(len(of) // 4, 1)]] if len(of) > 1 else of[:0]
        held |= (y == label) & np.isin(ids, some)
    return held


def cotrain(content: np.ndarray, meta: np.ndarray, y: np.ndarray, held: np.ndarray,
            rates: tuple[float, float] = (1.0, 1.0)) -> dict | None:
    """Views of the sample; ``y`` is 1, 0 or -1 (pool); ``held`` marks the
    labelled documents kept for calibration; ``rates`` are the shares of class 0
    and class 1 that were sampled.  None without both classes in both parts."""
    train, fold, pool = (y >= 0) & ~held, (y >= 0) & held, np.flatnonzero(y < 0)
    if len(np.unique(y[train])) < 2 or len(np.unique(y[fold])) < 2:
        return None
    views = (content, meta)
    rows = [np.flatnonzero(train), np.flatnonzero(train)]
    marks = [y[train].astype(np.float64), y[train].astype(np.float64)]
    weight = 1.0 / np.asarray(rates)[np.where(y[train] == 1, 1, 0)]
    prior = float((weight * y[train]).sum() / weight.sum())
    free = [np.ones(len(pool), bool), np.ones(len(pool), bool)]
    for _ in range(ROUNDS):
        weights = [_fit(_rows(v, r), m) for v, r, m in zip(views, rows, marks)]
        for giver, taker in ((0, 1), (1, 0)):
            p = _sigmoid(_logits(views[giver], pool, weights[giver]))
            for label, sure, share in ((1.0, p, prior), (0.0, 1 - p, 1 - prior)):
                can = np.flatnonzero(free[taker] & (sure >= SURE))
                pick = can[np.argsort(-sure[can], kind="stable")[:int(GIVE * share * len(pool))]]
                rows[taker] = np.concatenate((rows[taker], pool[pick]))
                marks[taker] = np.concatenate((marks[taker], np.full(len(pick), label)))
                free[taker][pick] = False
    weights = [_fit(_rows(v, r), m) for v, r, m in zip(views, rows, marks)]
    shift = float(np.log(rates[0] / rates[1]))     # sampling by class moves the log odds by a constant
    scale = [(a, b + shift) for a, b in (platt(_logits(v, np.flatnonzero(fold), w), y[fold]) for v, w in zip(views, weights))]
    return {"weights": weights, "scale": scale, "prior": float(np.log(prior / (1 - prior)))}


def _place(doc_id: Column, salt: str) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                d = part.to_pydict()
                rows = []
                for t, s, l, n in zip(d["text"], d["source"], d["lang"], d["n_chars"]):
                    x = np.concatenate((content_view(t), meta_view(t, s, l, n)))
                    at_ = np.flatnonzero(x)
                    rows.append(at_.astype(np.int16).tobytes() + x[at_].tobytes())
                yield pa.record_batch([part.column("doc_id"), part.column("quality"), pa.array(rows, pa.binary())],
                                      names=["doc_id", "quality", "x"])


def class_rates(n0: int, n1: int, labelled: int) -> tuple[float, float]:
    """Shares of the two classes to sample: half of ``labelled`` each, or all,
    the larger class taking what the smaller leaves."""
    least = min(n0, n1, labelled // 2)
    return tuple(min(1.0, (least if n <= min(n0, n1) else labelled - least) / max(n, 1)) for n in (n0, n1))


def learn(docs: DataFrame, labels: DataFrame, *, labelled: int = LABELLED, pool: int = POOL) -> dict | None:
    """The fitted views of ``docs`` (doc_id, text, source, lang, n_chars) and
    ``labels`` (doc_id, quality)."""
    spark = docs.sparkSession
    good = (labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id")
            .agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most").drop("most"))
    n_docs = docs.count()
    known = good.join(docs.select("doc_id"), "doc_id", "left_semi").groupBy(F.col("quality").cast("int").alias("q")).count()
    counts = {r["q"]: r["count"] for r in known.collect()}
    rates = class_rates(counts.get(0, 0), counts.get(1, 0), labelled)
    some = good.filter(_place(F.col("doc_id"), "labelled") < F.when(F.col("quality") == 1, rates[1]).otherwise(rates[0])) \
               .withColumnRenamed("doc_id", "l_id")
    base = docs.select("doc_id", "text", "source", "lang", "n_chars")
    # about ``labelled`` rows of two numbers: a bounded broadcast
    sample = base.join(F.broadcast(some), base["doc_id"] == some["l_id"], "left").drop("l_id") \
        .filter(F.col("quality").isNotNull() | (_place(F.col("doc_id"), "pool") < pool / max(n_docs, 1)))
    got = sample.select("doc_id", F.col("quality").cast("int").alias("quality"), "text", "source", "lang", "n_chars") \
                .mapInArrow(_views, "doc_id long, quality int, x binary").toArrow().sort_by([("doc_id", "ascending")])
    if not got.num_rows:
        return None
    x = np.zeros((got.num_rows, CONTENT + META), dtype=np.float32)
    for i, raw in enumerate(got.column("x")):
        raw = raw.as_buffer()
        m = len(raw) // 6
        x[i, np.frombuffer(raw, np.int16, m)] = np.frombuffer(raw, np.float32, m, 2 * m)
    y = np.array([-1 if q is None else q for q in got.column("quality").to_pylist()])
    ids = np.array([0 if i is None else i for i in got.column("doc_id").to_pylist()], dtype=np.int64)
    del got, raw            # the driver fits with the sample's matrix alone
    pa.default_memory_pool().release_unused()
    return cotrain(x[:, :CONTENT], x[:, CONTENT:], y, split(ids, y), rates)


def _scorer(model, columns: list[str]):
    at_text, at_source, at_lang, at_n = (columns.index(c) for c in ("text", "source", "lang", "n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        with np.errstate(over="ignore"):
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    cols = [part.column(i).to_pylist() for i in (at_text, at_source, at_lang, at_n)]
                    if m is None:
                        out = [{"score": 1.0, "content": 1.0, "meta": 1.0}] * part.num_rows
                    else:
                        out = []
                        for t, s, l, n in zip(*cols):
                            odds = [a * float(_logit(v, w)) + b for v, w, (a, b) in zip(
                                (content_view(t), meta_view(t, s, l, n)), m["weights"], m["scale"])]
                            p = [float(_sigmoid(o)) for o in (sum(odds) - m["prior"], *odds)]
                            out.append(dict(zip(("score", "content", "meta"), p)))
                    yield part.append_column(SCORES, pa.array(out, _SCORE_TYPE))
    return run


def with_scores(docs: DataFrame, labels: DataFrame, *, labelled: int = LABELLED, pool: int = POOL) -> DataFrame:
    """``docs`` with one more column ``SCORES``: struct of score (probability of
    good quality), and the calibrated probabilities of the two views."""
    spark = docs.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast(learn(docs, labels, labelled=labelled, pool=pool))
    schema = docs.select("*", F.lit(None).cast("struct<score:double,content:double,meta:double>").alias(SCORES)).schema
    return docs.mapInArrow(_scorer(model, docs.columns), schema)


def keep_good(docs: DataFrame, labels: DataFrame, *, least: float = KEEP) -> DataFrame:
    """The documents that the classifier does not reject."""
    return with_scores(docs, labels).filter(F.col(f"{SCORES}.score") >= least).select(*docs.columns)
