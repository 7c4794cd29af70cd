"""Substring deduplication (operator 7) by recompression.

Recompression parses a word sequence in rounds. A round names each maximal run of one symbol,
then names pairs: every symbol is left or right by one bit of a salted hash, and a left symbol
followed by a right one becomes a pair. Names are hashes of what they stand for, so all tasks
name alike and no round needs a lookup. The parse is locally consistent: equal substrings get the
same symbols, but near their ends. Each symbol here carries the stretch of words that it was
derived from, its extent; wherever those words occur, that symbol occurs.

1. All documents are parsed to ``LEVEL``; symbols with an extent within a window are counted
   over documents. One that stands in a single document ends every window around its extent.
2. The windows left are named by 128-bit hashes; those found in a smaller document are removed.

Step 1 alone never decides that something is a repeat and never loses one, so runs, periodic
text and windows without any symbol come out right as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_order, hash128, written

#: Words in a window; rounds of recompression; words that a symbol must stand for to be counted.
WINDOW, LEVEL, SYMBOL_WORDS = 50, 5, 4
#: Words parsed at a time (one document at least).
CHUNK_WORDS = 200_000
#: Words whose hashes a task keeps.
CACHE_WORDS = 300_000

_FAR = 1 << 40
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words(dict):
    """Numbers words and keeps the 128-bit hash of each, in two halves, up to a bound."""

    def __init__(self):
        self.fresh: list[bytes] = []
        self.names = np.empty((0, 2), np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number

    def hashes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > CACHE_WORDS:
            self.clear()
            self.names = self.names[:0]
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            digests = b"".join(map(xxhash.xxh128_digest, self.fresh))
            self.names = np.concatenate([self.names, np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)])
            self.fresh = []
        return self.names[at, 0], self.names[at, 1]


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def recompress(names: np.ndarray, doc: np.ndarray, rounds: int = LEVEL) -> tuple[np.ndarray, ...]:
    """(symbol, doc, begin, end, from, to) after ``rounds`` rounds; [from, to) is the extent.

    names: a hash for each word; doc: the number of its document, ascending. Symbols never cross
    documents. Where a symbol's shape depends on a document's end, its extent is unbounded.
    """
    sym = names
    begin = np.arange(len(sym), dtype=np.int64)
    end = begin + 1
    frm, to = begin, end
    for r in range(1, rounds + 1):
        if not len(sym):
            break
        salt = _U(r * 0x2545F491)
        # Runs. Whether a run is maximal depends on both neighbours.
        new_doc = np.r_[True, doc[1:] != doc[:-1]]
        head = np.flatnonzero(new_doc | np.r_[True, sym[1:] != sym[:-1]])
        tail = np.r_[head[1:], len(sym)] - 1
        before = np.where(new_doc[head], -_FAR, frm[head - 1])
        after = np.where(np.r_[new_doc[1:], True][tail], _FAR, to[(tail + 1) % len(sym)])
        count = tail - head + 1
        sym = np.where(count > 1, _mix(sym[head] ^ _mix(count.astype(_U) + salt)), sym[head])
        frm = np.minimum(np.minimum.reduceat(frm, head), before)
        to = np.maximum(np.maximum.reduceat(to, head), after)
        begin, end, doc = begin[head], end[tail], doc[head]
        # Pairs. A symbol that joins none depends on the one neighbour it might have joined.
        right = (_mix(sym ^ salt) >> _U(17)) & _U(1) == 1
        with_next = np.r_[doc[1:] == doc[:-1], False]
        first = ~right & with_next & np.r_[right[1:], False]
        second = np.r_[False, first[:-1]]
        alone = ~(first | second)
        prev_from = np.r_[-_FAR, np.where(with_next[:-1], frm[:-1], -_FAR)]
        next_to = np.r_[np.where(with_next[:-1], to[1:], _FAR), _FAR]
        frm2 = np.where(alone & right, np.minimum(frm, prev_from), frm)
        to2 = np.where(alone & ~right, np.maximum(to, next_to), to)
        at = np.flatnonzero(~second)
        pair, mate = first[at], np.minimum(at + 1, len(sym) - 1)
        sym = np.where(pair, _mix(sym[at] * _U(3) + _mix(sym[mate] + salt)), sym[at])
        frm = np.where(pair, np.minimum(frm2[at], frm2[mate]), frm2[at])
        to = np.where(pair, np.maximum(to2[at], to2[mate]), to2[at])
        begin, end, doc = begin[at], np.where(pair, end[mate], end[at]), doc[at]
    return sym, doc, begin, end, frm, to


def _chunks(texts: pa.Array, cache: _Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, words of each row, names, second names) for some rows at a time."""
    first, sizes, words = 0, [], []

    def out():
        return first, np.array(sizes, dtype=np.int64), *cache.hashes(words)

    for i, text in enumerate(texts):
        own = words_of(text.as_py())
        if words and len(words) + len(own) > CHUNK_WORDS:
            yield out()
            first, sizes, words = i, [], []
        sizes.append(len(own))
        words += own
    if sizes:
        yield out()


def _interior(names: np.ndarray, sizes: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, ...]:
    """(symbol, row, from, to) of the high-level symbols whose extent fits in a window."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    sym, doc, begin, end, frm, to = recompress(names, row, rounds)
    fits = (to - frm <= window) & (end - begin >= SYMBOL_WORDS)
    return sym[fits], doc[fits], frm[fits], to[fits]


def _window_names(names: np.ndarray, window: int, base: int) -> np.ndarray:
    """A polynomial hash of each stretch of ``window`` names."""
    n = len(names)
    powers = np.cumprod(np.r_[_U(1), np.full(n - 1, _U(base))]) if n else names
    sums = np.r_[_U(0), np.cumsum(names * powers)]
    inverse = np.cumprod(np.r_[_U(1), np.full(n - 1, _U(pow(base, -1, 2**64)))]) if n else names
    return (sums[window:] - sums[: n + 1 - window]) * inverse[: n + 1 - window] if n >= window else names[:0]


def _symbols(batches: Iterator[pa.RecordBatch], window: int, rounds: int) -> Iterator[pa.RecordBatch]:
    cache = _Words()
    for batch in batches:
        rows = batch.column(0).to_numpy()
        for first, sizes, names, _ in _chunks(batch.column(1), cache):
            sym, doc, _, _ = _interior(names, sizes, window, rounds)
            order = np.lexsort((sym, doc))
            sym, doc = sym[order], doc[order]
            new = np.r_[True, (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])][: len(sym)]
            yield pa.record_batch([pa.array(sym[new].view(np.int64)), pa.array(rows[first + doc[new]])], names=["sym", "row"])


def _windows(batches: Iterator[pa.RecordBatch], window: int, rounds: int) -> Iterator[pa.RecordBatch]:
    """Windows that may be repeats. Columns in: id order, both text hashes, text, shared symbols, (second hash, smallest id) of texts with copies."""
    cache = _Words()
    for batch in batches:
        ids, rows, seconds = (batch.column(k).to_numpy() for k in (0, 1, 2))
        for first, sizes, names, more in _chunks(batch.column(3), cache):
            part = slice(first, first + len(sizes))
            shared = batch.column(4).slice(first, len(sizes)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            firsts = batch.column(5).slice(first, len(sizes)).to_pylist()
            copy = np.array([any(f["t2"] == t and d > f["first"] for f in own or ()) for d, t, own in zip(ids[part].tolist(), seconds[part].tolist(), firsts)])
            sym, _, frm, to = _interior(names, sizes, window, rounds)
            alone = ~np.isin(sym, shared)
            ends = np.zeros(len(names) + 2, np.int64)
            np.add.at(ends, np.maximum(to[alone] - window, 0), 1)
            np.add.at(ends, frm[alone] + 1, -1)
            open_ = np.cumsum(ends)[: len(names)] == 0
            row = np.repeat(np.arange(len(sizes)), sizes)
            begin = np.cumsum(sizes) - sizes
            start = np.arange(len(names)) - begin[row]
            at = np.flatnonzero(open_ & (start + window <= sizes[row]) & ~copy[row])
            a, b = _window_names(names, window, _BASES[0])[at], _window_names(more, window, _BASES[1])[at]
            yield pa.record_batch(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(ids[first + row[at]]), pa.array(rows[first + row[at]]), pa.array(start[at].astype(np.int32))],
                names=["h1", "h2", "d", "row", "start"],
            )


def _kept(batches: Iterator[pa.RecordBatch], window: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, sha, texts = [], [], [], []
        for text, starts in zip(batch.column(1), batch.column(2)):
            words, starts = words_of(text.as_py()), starts.as_py()
            keep = words
            if starts and starts[0] < 0:
                keep = words if len(words) < window else []
            elif starts:
                s = np.array(starts)
                covered = np.zeros(len(words) + 1, np.int64)
                np.add.at(covered, s, 1)
                np.add.at(covered, np.minimum(s + window, len(words)), -1)
                keep = [w for w, c in zip(words, np.cumsum(covered).tolist()) if not c]
            line = b" ".join(keep)
            n_words.append(len(words))
            n_removed.append(len(words) - len(keep))
            sha.append(hashlib.sha256(line).hexdigest())
            if with_text:
                texts.append(line.decode("utf-8", "surrogatepass"))
        columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            columns.append(pa.array(texts, pa.string()))
            names.append("kept_text")
        yield pa.record_batch(columns, names=names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rounds: int = LEVEL, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) for every row.

    Each word goes that is covered by a stretch of ``window`` words which also starts in a
    document with a smaller id; what is left is joined by one space. Null and empty texts have no
    words. A missing id counts as larger than any other. Rows with one id never remove each
    other's words; repeated rows get equal results. Other columns aren't read. Texts whose words
    are a copy of a smaller document's text as a whole are found by that text's hash; they are
    windows like any other, only not listed one by one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    t1, t2 = hash128(text)
    order = doc_order(F.col(id_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), order.alias("d"), t1.alias("row"), t2.alias("t2"), text.alias("text"))
    keys = docs.select(order.alias("d"), t1.alias("row"), t2.alias("t2"))
    firsts = keys.groupBy("row", "t2").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last").drop("last")
    firsts = written(firsts)
    copies = keys.join(firsts, ["row", "t2"]).where("d > first").select("d", "row").distinct()

    # Symbols are counted by texts: what only copies of one text share ends windows as well.
    seen = written(rows.select("row", "text").mapInArrow(lambda b: _symbols(b, window, rounds), "sym long, row long"))
    shared = written(seen.groupBy("sym").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low < high").select("sym"))
    first = F.struct("t2", "first")
    notes = seen.join(shared, "sym").select("row", "sym", F.lit(None).cast("struct<t2: bigint, first: bigint>").alias("first")).union(firsts.select("row", F.lit(None).cast("long"), first))
    flags = written(notes.groupBy("row").agg(F.collect_set("sym").alias("syms"), F.collect_set("first").alias("firsts")))

    found = rows.select("d", "row", "t2", "text").join(flags, "row", "left").select("d", "row", "t2", "text", "syms", "firsts")
    windows = written(found.mapInArrow(lambda b: _windows(b, window, rounds), "h1 long, h2 long, d long, row long, start int"))
    earliest = windows.groupBy("h1", "h2").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last").drop("last")
    earliest = written(earliest)  # with both sides plain tables, Spark splits a hot window's rows in the join
    repeated = windows.join(earliest, ["h1", "h2"]).where("d > first").groupBy("d", "row").agg(F.collect_set("start").alias("starts"))
    removed = written(repeated.union(copies.select("d", "row", F.array(F.lit(-1)))))

    joined = rows.join(removed, ["d", "row"], "left").select("doc_id", "text", "starts")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.mapInArrow(lambda b: _kept(b, window, with_text), schema)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: word counts and the SHA-256 of the kept words."""
    return remove_repeats(docs.select("doc_id", "text"), with_text=False)


#: DuckDB form of ``digest``.
SQL = rf"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda s: s <> '') AS ws FROM documents
), k AS (
  SELECT doc_id, s, array_to_string(ws[s:s + {WINDOW - 1}], ' ') AS body
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS s FROM w WHERE len(ws) >= {WINDOW}) x
), f AS (SELECT body, min(doc_id) AS first_doc FROM k GROUP BY body),
c AS (
  SELECT DISTINCT doc_id, s + o AS pos FROM (SELECT doc_id, s FROM k JOIN f USING (body) WHERE first_doc < doc_id) r, (SELECT unnest(range(0, {WINDOW})) AS o) t
), p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
g AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.pos) FILTER (WHERE c.pos IS NULL) AS kept, count(c.pos) AS n_removed
  FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.pos = c.pos GROUP BY p.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(g.n_removed, 0) AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""
