"""Quality classifier (operator 4): random indexing, then a small network.

Each token has an index vector, sparse and ternary, made from a hash of the token. A word vector
is the sum of the index vectors around the word's occurrences, weighted down for frequent
neighbours. A document is the mean of its tokens' vectors. Two numpy layers turn it into a
probability, calibrated by a temperature fitted on rows that training has left out.

A word gives two tokens, its lower-cased form and its shape (runs of letter case, digits and marks),
so that words outside the vocabulary count as well; a word that repeats the one before gives a third.

Words are counted, and index vectors summed, over all documents. Only the two layers are fitted to a
bounded sample of labelled rows: at most ``SAMPLE_ROWS``. Scores cover all rows and whole texts; labels,
language, source and id are no inputs of a score.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only_cache, written

#: Labelled rows that fit the model; words and shapes with vectors of their own; vector length; hidden units.
SAMPLE_ROWS, VOCABULARY, SHAPES, LENGTH, HIDDEN = 12_000, 6000, 600, 64, 32
#: Score from which a document counts as good.
THRESHOLD = 0.3
#: Tokens read at a time; words whose tokens a task remembers; texts pooled at a time; parts in which the tasks' sums are added up.
CHUNK_TOKENS, CACHE_WORDS, POOL_ROWS, PARTS = 100_000, 150_000, 64, 32
#: The most frequent words, whose index vectors add to those of their neighbours; shapes all do.
CONTEXTS = 1000


class _Kinds(dict):
    """What stands for a character in a shape, by code point."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = kind = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        return kind


_KINDS, _RUN = _Kinds(), re.compile(r"(.)\1+", re.S)


def shape(word: str) -> str:
    """The runs of upper case, lower case, digits and marks of the whole word; marks stand for themselves."""
    stem, end = (word, "") if word.isalpha() else (word[:-1], word[-1:])
    if stem.isalpha() and (not end or _KINDS[ord(end)] == end):  # most words, without looking at each character
        if stem.islower():
            return "x" + end
        if stem[0].isupper() and stem[1:].islower():
            return "Xx" + end
    return _RUN.sub(r"\1", word.translate(_KINDS))


def _index_vector(token: str, length: int) -> np.ndarray:
    """Eight entries of +1 or -1 at places that the token's hash gives."""
    h = np.frombuffer(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=32).digest(), np.uint16)
    v = np.zeros(length, np.float32)
    v[h[:8] % length] += np.where(h[8:16] & 1, 1, -1)
    return v


@dataclass
class Vocabulary:
    """Numbers of the tokens: words, then shapes, then "other word", "other shape", "again"."""

    words: dict[str, int]
    shapes: dict[str, int]

    @property
    def size(self) -> int:
        return len(self.words) + len(self.shapes) + 3

    def names(self) -> list[str]:
        return [*(f"w {x}" for x in self.words), *(f"s {x}" for x in self.shapes), "other w", "other s", "again"]


class _Numbers(dict):
    """Numbers words as they come, and keeps the token numbers of those that are new."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.other, self.fresh = vocabulary, len(vocabulary.words) + len(vocabulary.shapes), []

    def __missing__(self, word: str) -> int:
        self.fresh.append((self.v.words.get(word.lower(), self.other), self.v.shapes.get(shape(word), self.other + 1)))
        self[word] = number = len(self)
        return number


class Reader:
    """Turns texts into token numbers: per word its number and its shape's, and which words repeat."""

    def __init__(self, vocabulary: Vocabulary):
        self.seen, self.pairs = _Numbers(vocabulary), np.empty((0, 2), np.int64)

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word numbers, shape numbers, repeats the word before, number of words of each text)."""
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
            self.pairs = self.pairs[:0]
        words = [t.split() for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        ids = np.fromiter(map(self.seen.__getitem__, chain.from_iterable(words)), np.int64, sizes.sum())
        if self.seen.fresh:
            self.pairs = np.concatenate([self.pairs, np.array(self.seen.fresh, np.int64)])
            self.seen.fresh = []
        again = np.r_[False, ids[1:] == ids[:-1]][: len(ids)]
        again[np.cumsum(sizes)[:-1][np.cumsum(sizes)[:-1] < len(ids)]] = False
        return self.pairs[ids, 0], self.pairs[ids, 1], again, sizes


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) with a bounded number of characters, one text at least."""
    first, held, part = 0, 0, []
    for i, t in enumerate(texts):
        t = t.as_py() or ""
        if part and held + len(t) > 5 * CHUNK_TOKENS:
            yield first, part
            first, held, part = i, 0, []
        part.append(t)
        held += len(t)
    if part:
        yield first, part


def pool(texts: list[str], reader: Reader, vectors: np.ndarray) -> np.ndarray:
    """The mean word and shape vectors of each text, the share of repeats as their pseudo-token's; zeros without words."""
    word, form, again, sizes = reader.read(texts)
    out = np.zeros((len(texts), 2 * vectors.shape[1]), np.float32)
    full = sizes > 0
    if not full.any():
        return out
    begin = (np.cumsum(sizes) - sizes)[full]
    share = np.add.reduceat(again.astype(np.float32), begin) / sizes[full]
    half, size = vectors.shape[1], len(vectors)
    for at in range(0, len(texts), POOL_ROWS):
        # Counts by text and token, times the vectors: one matrix product for some texts.
        rows = slice(at, at + POOL_ROWS)
        own, first = sizes[rows], int(sizes[:at].sum())
        text = np.repeat(np.arange(len(own)) * size, own)
        for k, ids in enumerate((word, form)):
            counts = np.bincount(text + ids[first : first + len(text)], minlength=len(own) * size).reshape(len(own), size)
            out[rows, k * half : (k + 1) * half] = counts.astype(np.float32) @ vectors / np.maximum(own, 1)[:, None]
    out[full, half:] += share[:, None] * vectors[-1]
    return out


@dataclass
class Model:
    """Everything that a score needs."""

    vocabulary: Vocabulary
    vectors: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float

    def score(self, pooled: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.layers
        hidden = np.tanh((pooled - mean) / scale @ w1 + b1)
        logit = np.clip((hidden @ w2 + b2)[:, 0] / self.temperature, -30, 30)
        return 1 / (1 + np.exp(-logit.astype(np.float64)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 60, seed: int = 3) -> tuple[tuple[np.ndarray, ...], float]:
    """Layers and temperature of the network for pooled vectors x and labels y (0 or 1)."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, own = order[: len(x) // 5], order[len(x) // 5 :]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = ((x - mean) / scale).astype(np.float32)
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, 1)), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0

    def logits(rows: np.ndarray) -> np.ndarray:
        return (np.tanh(z[rows] @ p[0] + p[1]) @ p[2] + p[3])[:, 0]

    def loss(l: np.ndarray, t: np.ndarray) -> float:
        return float(np.mean(np.logaddexp(0, l) - t * l)) if len(l) else 0.0

    best = (np.inf, [a.copy() for a in p])
    for _ in range(epochs if len(own) else 0):
        for rows in np.array_split(rng.permutation(own), max(1, len(own) // 128)):
            h = np.tanh(z[rows] @ p[0] + p[1])
            l = (h @ p[2] + p[3])[:, 0]
            d = ((1 / (1 + np.exp(-l)) - y[rows]) / len(rows))[:, None]
            dh = d @ p[2].T * (1 - h**2)
            grads = [z[rows].T @ dh + 1e-4 * p[0], dh.sum(axis=0), h.T @ d + 1e-4 * p[2], d.sum(axis=0)]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g**2
                p[k] -= 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        now = loss(logits(held), y[held])
        if now < best[0]:
            best = (now, [a.copy() for a in p])
    p[:] = best[1]
    temperatures = np.geomspace(0.25, 4, 81)
    l = logits(held)
    t = float(temperatures[np.argmin([loss(l / t, y[held]) for t in temperatures])]) if len(held) else 1.0
    return (mean.astype(np.float32), scale.astype(np.float32), *(a.astype(np.float32) for a in p)), t


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """(text, y, id) of at most ``rows`` labelled documents, those of the smallest id hashes; never held-out ones."""
    marks = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col("quality").cast("int").alias("y")).dropDuplicates(["_id"])
    marks = marks.where(~held_out(F.col("_id")))
    picked = marks.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return own.join(F.broadcast(picked), "_id").select("text", "y", F.col("_id").alias("id"))  # at most ``rows`` ids


def held_out(doc_id: Column) -> Column:
    """Whether a document's label may not be learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """The model for (doc_id, text) and labels (doc_id, quality 0 or 1); labels of held-out ids aren't read.

    Words and their neighbours are those of all documents, whole texts; the layers are fitted to at most
    ``rows`` labelled rows, the same for the same table. Rows that repeat count as often as they come.
    Sums may differ in their last digits with the order of rows. Without any label every score is 0.5.
    """
    sc = docs.sparkSession.sparkContext
    sample = written(labelled_sample(docs, labels, id_col, text_col, rows))
    texts = docs.select(F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("quality")
        own = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words, shapes = Counter(), Counter()
            for w, n in own.items():
                words[w.lower()] += n
                shapes[shape(w)] += n
            for kind, found in (("w", words), ("s", shapes)):
                yield pa.record_batch([pa.array([kind] * len(found), pa.string()), pa.array(found, pa.string()), pa.array(found.values(), pa.int64())], names=["kind", "token", "n"])

        for batch in batches:
            for t in batch.column(0):
                own.update((t.as_py() or "").split())
                if len(own) > CACHE_WORDS:
                    yield from out()
                    own.clear()
        yield from out()

    def top(kind: str, most: int) -> dict[str, int]:
        return {r.token: r.n for r in counts.where(F.col("kind") == kind).orderBy(F.desc("n"), "token").limit(most).collect()}

    counts = written(texts.mapInArrow(count, "kind string, token string, n long").groupBy("kind", "token").agg(F.sum("n").alias("n")))
    words, shapes = top("w", VOCABULARY), top("s", SHAPES)
    vocabulary = Vocabulary({w: i for i, w in enumerate(words)}, {s: len(words) + i for i, s in enumerate(shapes)})
    index = np.stack([_index_vector(t, LENGTH) for t in vocabulary.names()])
    n = np.array([*words.values(), *shapes.values(), 1, 1, 1], np.float64)
    index *= (1 / np.sqrt(1 + n / max(1, n.sum()) * 1e4))[:, None]
    shared = sc.broadcast((vocabulary, index))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task's sums of index vectors around each token: two words each way, their shapes, its own pair.

        Neighbours are counted, and the counts multiplied by the vectors at the end.
        """
        vocabulary, index = shared.value
        reader = Reader(vocabulary)
        # Columns of the counts: frequent words, then what comes after all words, then a column for words that don't count.
        n_words, n_contexts = len(vocabulary.words), min(CONTEXTS, len(vocabulary.words))
        column = np.r_[np.arange(n_contexts), np.full(n_words - n_contexts, vocabulary.size - n_words + n_contexts), np.arange(n_contexts, vocabulary.size - n_words + n_contexts)]
        width = vocabulary.size - n_words + n_contexts + 1
        counts = np.zeros(vocabulary.size * width, np.int32)
        for batch in batches:
            for _, texts in _chunks(batch.column(0)):
                word, form, again, sizes = reader.read(texts)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                cells = [c for ids in (word, form) for c in (ids * width + column[form], ids[again] * width + (width - 2))]
                for k in (1, 2):
                    left = np.flatnonzero(doc[k:] == doc[:-k])
                    for a, b in ((left, left + k), (left + k, left)):
                        cells += [ids * width + column[near] for ids in (word[a], form[a]) for near in (word[b], form[b])]
                cell, n = np.unique(np.concatenate(cells).astype(np.int32), return_counts=True)
                counts[cell] += n.astype(np.int32)
        used = np.r_[index[:n_contexts], index[n_words:], np.zeros((1, LENGTH), np.float32)]
        total = np.concatenate([part.astype(np.float32) @ used for part in np.array_split(counts.reshape(vocabulary.size, width), 16)])
        for k in range(PARTS):
            own = np.flatnonzero(total[k::PARTS].any(axis=1)).astype(np.int32)
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([own.tobytes()], pa.binary()), pa.array([total[k::PARTS][own].astype(np.float32).tobytes()], pa.binary())], names=["part", "rows", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of each part, over all tasks."""
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, own, sums in zip(*(c.to_pylist() for c in batch.columns)):
                total = held.setdefault(part, np.zeros((-(-(size - part) // PARTS), LENGTH)))
                total[np.frombuffer(own, np.int32)] += np.frombuffer(sums, np.float32).reshape(-1, LENGTH)
        for part, total in held.items():
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    size = vocabulary.size
    vectors = np.zeros((size, LENGTH))
    # One matrix of fixed size in all, whatever the number of tasks.
    for r in texts.mapInArrow(around, "part int, rows binary, sums binary").repartition(PARTS, "part").mapInArrow(added, "part int, sums binary").collect():
        vectors[r.part :: PARTS] = np.frombuffer(r.sums, np.float64).reshape(-1, LENGTH)
    vectors = vectors.round(3)
    vectors += index * np.linalg.norm(vectors, axis=1, keepdims=True) / np.maximum(np.linalg.norm(index, axis=1, keepdims=True), 1e-9)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.where(norms > 0, vectors / np.maximum(norms, 1e-9), index / np.maximum(np.linalg.norm(index, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    again = sc.broadcast((vocabulary, vectors))

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, vectors = again.value
        reader = Reader(vocabulary)
        for batch in batches:
            for first, texts in _chunks(batch.column(0)):
                x = pool(texts, reader, vectors)
                yield pa.record_batch([pa.array([r.tobytes() for r in x], pa.binary()), *(batch.column(k).slice(first, len(texts)) for k in (1, 2))], names=["x", "y", "id"])

    rows_ = sample.mapInArrow(pooled, "x binary, y int, id long").orderBy("id", "y", "x").collect()  # at most ``rows`` short vectors
    if not rows_:
        zero = np.zeros
        return Model(vocabulary, vectors, (zero(2 * LENGTH), np.ones(2 * LENGTH), zero((2 * LENGTH, 1)), zero(1), zero((1, 1)), zero(1)), 1.0)
    x = np.stack([np.frombuffer(r.x, np.float32) for r in rows_]).astype(np.float64)
    layers, temperature = train(x, np.array([r.y for r in rows_], np.float64))
    return Model(vocabulary, vectors, layers, temperature)


def classify(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` plus score (0 to 1, higher: better) and predicted (1 from ``threshold``, else 0).

    Null and empty texts have the score of a text without words. Repeated rows get equal scores, and
    texts of any length are read whole, some at a time. Other columns pass through; columns named score
    or predicted are replaced. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passed = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in passed), "score double, predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        reader = Reader(model.vocabulary)
        for batch in batches:
            for first, texts in _chunks(batch.column(batch.num_columns - 1)):
                score = model.score(pool(texts, reader, model.vectors))
                rows = batch.slice(first, len(texts))
                yield pa.record_batch(rows.columns[:-1] + [pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*passed, "score", "predicted"])

    return docs.select(*passed, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, columns unchanged."""
    columns = docs.columns
    return classify(docs, fit(docs, labels, **options)).where("predicted = 1").select(*columns)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: whether its label was held out, its score and the prediction."""
    own = docs.select("doc_id", "text")
    scored = classify(own, fit(own, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
