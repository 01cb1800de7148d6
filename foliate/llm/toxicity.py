"""Toxicity by averaged subword embeddings and a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_size, share_of_hash, sole, text_of

#: Punctuation that is cut from the ends of a word.
EDGES = ".,;:!?\"'()[]{}…«»“”‘’¡¿*#%$&|-_"


#: Empty words (vectors of zero) that every text's mean counts besides its own: with few words one odd word tells little.
PAD = 50


def words_of(text: str, long: int = 64, piece: int = 16, shared: int = 4) -> list[str]:
    """Words between white space. A run of over `long` characters, as of a script without spaces or of words joined by
    signs, is many words: it counts as pieces that share so many characters that every n-gram of it lies in one."""
    out = []
    for w in (x.strip(EDGES) for x in text.lower().split()):
        if len(w) > long:
            out += [w[i : i + piece] for i in range(0, len(w) - shared, piece - shared)]
        elif w:
            out.append(w)
    return out


def subwords(word: str, buckets: int, shortest: int = 3, longest: int = 5) -> list[int]:
    """Hashed features of a word: itself and its character n-grams between boundary marks. A word that was never
    seen, such as a misspelling, still shares most n-grams with words that were."""
    from zlib import crc32

    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in range(shortest, longest + 1) for i in range(len(marked) - n + 1)]
    return [crc32(g.encode()) % buckets for g in (f"={word}", *grams)]


@dataclass
class Model:
    """Since a text's vector is the mean of its words' vectors, and a word's the mean of its subwords', the log odds
    of a text are the mean of its subwords' log odds: `odds` holds (embedding . softmax row difference) by bucket."""

    odds: np.ndarray
    bias: float

    def word(self, word: str) -> float:
        return float(self.odds[subwords(word, len(self.odds))].mean())


def weighted(texts: list[str], buckets: int, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its buckets and how much of the text's mean each is. Buckets of fewer than `least` texts would
    only tell those texts apart and are left out."""
    features: dict[str, np.ndarray] = {}
    docs = []
    for text in texts:
        found, counts = np.unique(words_of(text), return_counts=True)
        for w in found:
            if w not in features:
                features[w] = np.array(subwords(str(w), buckets), np.int32)
        parts = [features[w] for w in found]
        sizes = np.array([len(p) for p in parts], np.int32)
        weight = np.repeat(counts / (counts.sum() + PAD) / np.maximum(sizes, 1), sizes) if len(parts) else np.zeros(0)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        at, inverse = np.unique(flat, return_inverse=True)
        docs.append((at, np.bincount(inverse, weight, len(at)).astype(np.float32)))
    met = np.bincount(np.concatenate([at for at, _ in docs]), minlength=buckets) >= least
    return [(at[met[at]], weight[met[at]]) for at, weight in docs]


def descend(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, buckets: int, dim: int, epochs: int, batch: int, rate: float, penalty: float, seed: int) -> np.ndarray:
    """Log odds by bucket: embeddings and softmax trained together by Adagrad over shuffled batches, the embeddings
    with a penalty on their squares; both classes weigh alike. Buckets that no text has stay at zero."""
    rng = np.random.default_rng(seed)
    e = np.zeros((buckets, dim), np.float32)
    met = np.unique(np.concatenate([at for at, _ in docs]))
    e[met] = rng.uniform(-1 / dim, 1 / dim, (len(met), dim))
    w = rng.normal(0, 1, (dim, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    ge, gw, gb = np.full(buckets, 1e-8, np.float32), np.full((dim, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    share = np.array([0.5 / max((y == c).mean(), 1e-9) for c in (0, 1)], np.float32)
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // batch)):
            at = np.concatenate([docs[i][0] for i in some])
            weight = np.concatenate([docs[i][1] for i in some])
            sizes = [len(docs[i][0]) for i in some]
            doc = np.repeat(np.arange(len(some)), sizes)
            known, local = np.unique(at, return_inverse=True)
            rows = e[known]
            mean = np.stack([np.bincount(doc, rows[local, k] * weight, len(some)) for k in range(dim)], 1).astype(np.float32)
            z = mean @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p *= share[y[some]][:, None]
            g = (p @ w.T)[doc] * weight[:, None]
            grad = np.stack([np.bincount(local, g[:, k], len(known)) for k in range(dim)], 1).astype(np.float32) + penalty * rows
            ge[known] += (grad**2).mean(1)
            e[known] -= rate * grad / np.sqrt(ge[known])[:, None]
            dw, db = mean.T @ p, p.sum(0)
            gw += dw**2
            gb += db**2
            w -= rate * dw / np.sqrt(gw)
            b -= rate * db / np.sqrt(gb)
    return (e @ (w[:, 1] - w[:, 0])).astype(np.float32)


def fit(texts: list[str], toxic: list[int], buckets: int = 1 << 17, dim: int = 8, epochs: int = 8, batch: int = 32, least: int = 4, rate: float = 0.25, penalty: float = 1e-4, folds: int = 3, missed: float = 2.0, seed: int = 7) -> Model:
    """A model of all texts, its bias set where it parts best the scores that texts got from models that had not seen
    them (each fold by a model of the others), since a model's scores of its own texts tell little of new ones. A
    toxic text on the wrong side counts `missed` times a clean one. Without both classes (in each model) every text
    scores 0.5, or its only class."""
    y = np.array(toxic, int)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(buckets, np.float32), 0.0 if not len(y) else (5.0 if y[0] else -5.0))
    docs = weighted(texts, buckets, least)
    of = lambda some: descend([docs[i] for i in some], y[some], buckets, dim, epochs, batch, rate, penalty, seed)
    raw = lambda odds, some: np.array([float(odds[docs[i][0]] @ docs[i][1]) for i in some])
    # every fold has its share of either class
    fold = np.empty(len(y), int)
    for c in (0, 1):
        fold[y == c] = np.arange((y == c).sum()) % folds
    unseen = np.zeros(len(y))
    if min((y == 0).sum(), (y == 1).sum()) >= folds:
        for f in range(folds):
            own = np.flatnonzero(fold == f)
            unseen[own] = raw(of(np.flatnonzero(fold != f)), own)
    odds = of(np.arange(len(y)))
    if not unseen.any():
        unseen = raw(odds, range(len(y)))
    return Model(odds, -best_cut(unseen, y, missed))


def best_cut(raw: np.ndarray, y: np.ndarray, missed: float = 1.0) -> float:
    """The middle of the gap between neighbours that leaves the least weight of texts on the wrong side, a toxic one
    weighing `missed`; of equal ones the widest gap."""
    order = np.argsort(raw, kind="stable")
    raw, y = raw[order], y[order]
    wrong = missed * np.concatenate([[0], np.cumsum(y)]) + np.concatenate([[0], np.cumsum(1 - y[::-1])])[::-1]
    inner = wrong[1:-1]
    least = np.flatnonzero(inner == inner.min())
    gaps = raw[least + 1] - raw[least]
    k = least[gaps.argmax()]
    return float((raw[k] + raw[k + 1]) / 2)


_SCORES: dict[bytes, dict[str, float]] = {}


class Scorer:
    """Scores by a model; the scores of up to `room` words stay with the worker, under the model's digest."""

    def __init__(self, model: Model, room: int = 600_000):
        from hashlib import sha256

        self.model, self.room = model, room
        key = sha256(model.odds.tobytes()).digest()
        if key not in _SCORES:
            _SCORES.clear()
        self.known = sole(_SCORES).setdefault(key, {})

    def score(self, text: str) -> float:
        words, known = words_of(text), self.known
        if len(known) > self.room:
            known.clear()
        total = 0.0
        for w in words:
            s = known.get(w)
            if s is None:
                s = known[w] = self.model.word(w)
            total += s
        return float(1 / (1 + np.exp(-np.clip(total / (len(words) + PAD) + self.model.bias, -30, 30))))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, toxic: int = 900, clean: int = 2700) -> Model:
    """A model from at most `toxic` and `clean` labelled documents that are not held out, by the order of a hash of
    doc_id. The bound is part of the method: more rows change little, and these come to the driver. Rows with one id
    count once; labels without an id, a value or a document are left out."""
    usable = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    order = [F.xxhash64("doc_id"), "doc_id", "toxic"]
    there = {r[0]: r[1] for r in usable.groupBy("toxic").count().collect()}
    of_class = lambda c, n: usable.filter(F.col("toxic") == c).filter(share_of_hash("doc_id", n, there.get(c, 0))).orderBy(*order).limit(n)
    some = of_class(1, toxic).unionByName(of_class(0, clean))
    some = some.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = sorted(texts.collect())
    return fit([r[1] for r in rows], [r[2] for r in rows])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Each row of docs as the struct `row`, and `score`: 0 to 1 of its whole text (null as empty)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(model)
        for batch in batches:
            texts = batch.column(0).field("text").cast(pa.string()).fill_null("")
            found = [own.score(t) for run in by_size(t.as_py() for t in texts) for t in run]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["row", "score"])

    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(score, f"row {rows.schema['row'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, the model trained on labels that are not held out.

    Null and empty texts have the score of a text without words; texts and runs of any length are scored whole. Equal
    texts have equal scores, and a score of exactly 0.5 counts as toxic. Repeated rows are scored one by one, a null
    id is that of the empty text for held_out, extra columns are left out, and an empty table gives no rows. Without
    labels of both classes all texts score alike.
    """
    rows = scored(docs.select("doc_id", "text"), train(docs, labels))
    return rows.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below 0.5, with all their columns; otherwise as toxicity(): null and empty texts
    score alike, repeated rows stay or go together, columns named like this operator's own keep their values, and an
    empty table stays empty."""
    return scored(docs, train(docs, labels)).filter("score < 0.5").select("row.*")
