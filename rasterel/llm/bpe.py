"""BPE encoding and decoding (operator 1) with a minimal acyclic transducer as lexicon.

The words of all documents are counted, the most frequent ones encoded once and compiled into a
minimal acyclic automaton: words share prefixes and suffixes, every arc carries the number of
words passed by, so that a walk adds up to the word's number, and the number is its place in
the table of id outputs. The automaton is a flat file that tasks map into memory and walk for
many words at a time. Words outside it are merged exactly, pair by pair in order of rank. The
lexicon thus decides about speed only.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only_cache, written

#: Most words in the lexicon and the fewest times one occurs; fixed bounds at any corpus size.
LEXICON_WORDS, LEXICON_MIN_COUNT = 1 << 17, 2
#: Distinct chunks that a task counts before it hands its counts on; encoded chunks that it keeps.
COUNT_WORDS, CACHE_WORDS = 500_000, 400_000
#: Chunks encoded at a time (one document at least).
CHUNK_WORDS = 200_000

#: White space as the tokenizer's \s understands it.
_SPACE = r"\t-\r \x85\xa0  -     　"
#: Fixed values of the tokenizer file's pre-tokenizer, with its \s spelt out.
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
_NO_SPACE = regex.compile(rf"[^{_SPACE}]+")
_ODD = regex.compile(r"[\x1c-\x1f]")
#: Stands for a pair that no merge joins.
_NEVER = 1 << 62


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {b: chr(b) for b in plain}
    others = (b for b in range(256) if b not in letters)
    return [x for _, x in sorted((letters | {b: chr(256 + k) for k, b in enumerate(others)}).items())]


class Model:
    """Vocabulary, merges and text rules of one tokenizer file (lower case, word ends)."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        bpe = spec["model"]
        self.ids: dict[str, int] = bpe["vocab"]
        self.suffix = bpe["end_of_word_suffix"] or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in bpe["merges"])
        # By pair: rank and new id in one number.
        self.merges = {(self.ids[a], self.ids[b]): rank << 20 | self.ids[a + b] for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.digits = {i: str(i) for i in self.tokens}
        letters = _byte_letters()
        self.inner = [self.ids.get(x) for x in letters]
        self.final = [self.ids.get(x + self.suffix) for x in letters]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def chunks(self, text: str | None) -> list[str]:
        """Normalised stretches without white space; an added token found in the raw text is one after a space."""
        if not text:
            return []
        if self.cut is None or not self.cut.search(text):
            return self._split(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [" " + part] if part in self.special else self._split(part)
        return out

    @staticmethod
    def _split(text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        # Letter by letter where it matters: the tokenizer knows no final sigma.
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        # str.split() also splits at four control characters that are no white space here.
        return text.split() if not _ODD.search(text) else _NO_SPACE.findall(text)

    def words_of_chunk(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk."""
        if chunk.isalpha() or chunk[0] == " ":
            return [chunk]
        if chunk[-1] in ".,!?;:" and chunk[:-1].isalpha():  # the usual case, without the pattern
            return [chunk[:-1], chunk[-1]]
        return _WORD.findall(chunk)

    def words(self, text: str | None) -> list[str]:
        """The pre-tokens of a text in order."""
        return [w for c in self.chunks(text) for w in self.words_of_chunk(c)]

    def merge(self, word: str) -> list[int]:
        """The ids of one pre-token by exact merging: lowest rank first, leftmost of equals."""
        if word[:1] == " ":
            return [self.special[word[1:]]]
        data = word.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in data[:-1]] + [self.final[data[-1]]]
        if None in ids:
            ids = [i for i in ids if i is not None]
        get = self.merges.get
        found = [get(p, _NEVER) for p in zip(ids, ids[1:])]
        while found and (best := min(found)) != _NEVER:
            at = found.index(best)
            new = ids[at] = best & 0xFFFFF
            del ids[at + 1], found[at]
            if at < len(found):
                found[at] = get((new, ids[at + 1]), _NEVER)
            if at:
                found[at - 1] = get((ids[at - 1], new), _NEVER)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The tokens of ids joined by spaces: the file names no decoder. Unknown ids are left out."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


class Transducer:
    """A memory-mapped minimal acyclic automaton from words to id sequences.

    Arrays: arc keys (state * 256 + byte, ascending), arc targets, words passed by on each arc,
    final states, where each word's ids begin, ids, and a hash table from keys to arcs.
    """

    FIELDS = (("keys", np.int64), ("targets", np.int32), ("skips", np.int32), ("finals", np.bool_), ("starts", np.int64), ("outputs", np.int32), ("slots", np.int32))

    def __init__(self, buffer):
        head = np.frombuffer(buffer, np.int64, len(self.FIELDS))
        at = head.nbytes
        for (name, kind), n in zip(self.FIELDS, head.tolist()):
            setattr(self, name, np.frombuffer(buffer, kind, n, at))
            at += -(-n * np.dtype(kind).itemsize // 8) * 8
        self.output_list, self.start_list = self.outputs.tolist(), self.starts.tolist()

    @staticmethod
    def _place(keys: np.ndarray, bits: int) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)

    @classmethod
    def _hashed(cls, keys: np.ndarray) -> np.ndarray:
        """A table of arc numbers, twice as large as needed: an arc stands at its key's place or soon after."""
        bits = max(4, int(len(keys) * 2).bit_length())
        table, at, todo = np.full(1 << bits, -1, np.int32), cls._place(keys, bits), np.arange(len(keys))
        while len(todo):
            free = table[at[todo]] < 0
            table[at[todo[free]]] = todo[free]  # of several, one stays
            todo = todo[table[at[todo]] != todo]
            at[todo] = (at[todo] + 1) & ((1 << bits) - 1)
        return table

    def _arcs(self, keys: np.ndarray) -> np.ndarray:
        """The number of the arc with each key, -1 for none."""
        mask = len(self.slots) - 1
        at = self._place(keys, mask.bit_length())
        out = self.slots[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            out[todo] = self.slots[at[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[out[todo]] != keys[todo])]
        return out

    @classmethod
    def open(cls, path: str) -> Transducer:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    @classmethod
    def compile(cls, lexicon: dict[bytes, list[int]]) -> bytes:
        """The file for a lexicon. Sorted words are added one by one; finished states are merged with equal ones."""
        arcs: list[dict[int, int]] = [{}]
        final = [False]
        known: dict[tuple, int] = {}
        path = [0]  # states of the last word

        def close(down_to: int, word: bytes) -> None:
            for depth in range(len(path) - 1, down_to, -1):
                state = path.pop()
                form = (final[state], tuple(arcs[state].items()))
                arcs[path[-1]][word[depth - 1]] = known.setdefault(form, state)

        last = b""
        for word in sorted(lexicon):
            common = next((i for i, (x, y) in enumerate(zip(word, last)) if x != y), min(len(word), len(last)))
            close(common, last)
            for byte in word[common:]:
                arcs.append({})
                final.append(False)
                arcs[path[-1]][byte] = len(arcs) - 1
                path.append(len(arcs) - 1)
            final[path[-1]] = True
            last = word
        close(0, last)
        number = {0: 0}  # states in use, breadth first
        queue = [0]
        for state in queue:
            for target in arcs[state].values():
                if target not in number:
                    number[target] = len(number)
                    queue.append(target)
        below: dict[int, int] = {}
        stack = [0]
        while stack:  # words that can be completed from each state
            state = stack[-1]
            todo = [t for t in arcs[state].values() if t not in below]
            if todo:
                stack += todo
            else:
                below[state] = final[state] + sum(below[t] for t in arcs[state].values())
                stack.pop()
        keys, targets, skips = [], [], []
        for state in queue:
            passed = int(final[state])
            for byte, target in sorted(arcs[state].items()):
                keys.append(number[state] * 256 + byte)
                targets.append(number[target])
                skips.append(passed)
                passed += below[target]
        outputs = [lexicon[w] for w in sorted(lexicon)]
        slots = cls._hashed(np.array(keys, np.int64))
        fields = (keys, targets, skips, [final[s] for s in queue], np.cumsum([0, *map(len, outputs)]), [i for x in outputs for i in x], slots)
        arrays = [np.asarray(x, kind) for x, (_, kind) in zip(fields, cls.FIELDS)]
        parts = [np.array([len(a) for a in arrays], np.int64).tobytes()]
        for a in arrays:
            parts.append(a.tobytes() + b"\0" * (-a.nbytes % 8))
        return b"".join(parts)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for those outside; all words step together, byte by byte."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(sizes) - sizes
        state, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live = np.flatnonzero(sizes > 0) if len(self.keys) else np.empty(0, np.int64)
        out = np.full(len(words), -1, np.int64)
        depth = 0
        while len(live):
            arc = self._arcs(state[live] * 256 + text[begin[live] + depth])
            hit = arc >= 0
            live, arc = live[hit], arc[hit]
            state[live] = self.targets[arc]
            number[live] += self.skips[arc]
            depth += 1
            done = sizes[live] == depth
            ended = live[done]
            ended = ended[self.finals[state[ended]]]
            out[ended] = number[ended]
            live = live[~done]
        return out

    def ids(self, number: int) -> list[int]:
        return self.output_list[self.start_list[number] : self.start_list[number + 1]]


def _model(data: bytes, digest: str) -> Model:
    held = only_cache("bpe")
    if digest not in held:
        held[digest] = Model(data)
    return held[digest]


class Encoder:
    """Encodes chunks word by word through the transducer, else by merging; keeps what it has encoded up to a bound."""

    def __init__(self, model: Model, lexicon: Transducer | None = None):
        self.model, self.lexicon = model, lexicon
        self.id_text: dict[str, str] = {}
        self.token_text: dict[str, str] = {}
        self.last: set[str] = set()

    def learn(self, chunks: set[str]) -> None:
        if len(self.id_text) + len(chunks) > CACHE_WORDS:  # what the last call and this one use stays
            kept = (self.last | chunks).intersection(self.id_text)
            self.id_text = {c: self.id_text[c] for c in kept}
            self.token_text = {c: self.token_text[c] for c in kept}
        self.last = chunks
        id_text, token_text = self.id_text, self.token_text
        fresh = chunks.difference(id_text)
        parts = {c: self.model.words_of_chunk(c) for c in fresh}
        words = list({w for p in parts.values() for w in p}.difference(id_text))
        numbers = self.lexicon.find([w.encode("utf-8", "surrogatepass") for w in words]).tolist() if self.lexicon and words else [-1] * len(words)
        digits, tokens = self.model.digits, self.model.tokens
        for word, number in zip(words, numbers):
            ids = self.lexicon.ids(number) if number >= 0 else self.model.merge(word)
            id_text[word] = " ".join([digits[i] for i in ids])
            token_text[word] = " ".join([tokens[i] for i in ids])
        for chunk, part in parts.items():
            if len(part) != 1 or part[0] != chunk:
                id_text[chunk] = " ".join([id_text[w] for w in part])
                token_text[chunk] = " ".join([token_text[w] for w in part])

    def encode(self, chunks: list[str]) -> tuple[str, str]:
        """(decimal ids joined by spaces, decoded text) of chunks that ``learn`` has seen."""
        return " ".join(map(self.id_text.__getitem__, chunks)), " ".join(map(self.token_text.__getitem__, chunks))


def word_counts(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(word, n) over the whole texts of ``docs``."""
    data = open(tokenizer, "rb").read()
    shared, digest = docs.sparkSession.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, found = _model(shared.value, digest), Counter()

        def out():
            counts: dict[str, int] = {}
            for chunk, n in found.items():
                for w in model.words_of_chunk(chunk):
                    counts[w] = counts.get(w, 0) + n
            words = [w.encode("utf-8", "surrogatepass") for w in counts]
            return pa.record_batch([pa.array(words, pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                found.update(model.chunks(text.as_py()))
                if len(found) > COUNT_WORDS:
                    yield out()
                    found.clear()
        yield out()

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer: str, text_col: str = "text", most: int = LEXICON_WORDS, min_count: int = LEXICON_MIN_COUNT) -> bytes:
    """The transducer file for the most frequent words of the whole corpus, at most ``most``.

    Words are taken from a count on that lets no more than ``most`` through: counts are compared
    in steps of an eighth of a doubling, so that a small table decides and no sort is needed.
    """
    model = Model(open(tokenizer, "rb").read())
    step = F.floor(F.log2("n") * 8)
    counts = written(word_counts(docs, tokenizer, text_col).where(F.col("n") >= min_count))
    sizes = {r.step: r.words for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()}  # 512 rows at most
    lowest, held = float("inf"), 0
    for k in sorted(sizes, reverse=True):
        held += sizes[k]
        if held > most:
            break
        lowest = k
    words = [bytes(r.word) for r in counts.where(step >= lowest).select("word").collect()] if lowest < float("inf") else []
    return Transducer.compile({w: model.merge(w.decode("utf-8", "surrogatepass")) for w in words if w})


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``docs``' columns plus n_tokens, ids_sha256, decoded_sha256[, token_ids array, decoded string].

    Encodes whole texts as the tokenizer file says, without special tokens added; special tokens
    that stand in a text are recognised. A null or empty text has no tokens and an empty decoded
    text. Rows repeat as they come. Columns of these names are replaced; ``id_col`` only has to exist.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    data = open(tokenizer, "rb").read()
    lexicon = build_lexicon(docs, tokenizer, text_col)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="rasterel-"), name)
    with open(path, "wb") as f:
        f.write(lexicon)
    sc.addFile(path)  # each executor fetches it, also one that joins later
    shared, digest = sc.broadcast(data), hashlib.sha256(data).hexdigest()
    extra = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids", "decoded"] * with_ids
    passed = [c for c in docs.columns if c not in extra] if with_ids else [id_col]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in passed), "n_tokens long, ids_sha256 string, decoded_sha256 string", *["token_ids array<int>, decoded string"] * with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = only_cache("bpe")
        if name not in held:
            for old in [k for k in held if k.startswith("lexicon-")]:
                del held[old]
            held[name] = Encoder(_model(shared.value, digest), Transducer.open(SparkFiles.get(name)))
        encoder = held[name]

        def out(rows: pa.RecordBatch, words: list[list[str]]) -> pa.RecordBatch:
            encoder.learn(set().union(*words))
            found = [encoder.encode(x) for x in words]
            columns = [
                pa.array([ids.count(" ") + 1 if ids else 0 for ids, _ in found], pa.int64()),
                pa.array([hashlib.sha256(ids.encode()).hexdigest() for ids, _ in found], pa.string()),
                pa.array([hashlib.sha256(text.encode()).hexdigest() for _, text in found], pa.string()),
            ]
            if with_ids:
                columns.append(pa.array([list(map(int, ids.split())) for ids, _ in found], pa.list_(pa.int32())))
                columns.append(pa.array([text for _, text in found], pa.string()))
            return pa.record_batch(rows.columns[:-1] + columns, names=passed + extra)

        for batch in batches:
            first, words, held = 0, [], 0
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                own = encoder.model.chunks(text.as_py())
                if words and held + len(own) > CHUNK_WORDS:
                    yield out(batch.slice(first, i - first), words)
                    first, words, held = i, [], 0
                words.append(own)
                held += len(own)
            if words:
                yield out(batch.slice(first), words)

    return docs.select(*passed, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per document: token count, SHA-256 of the ids and of the decoded text."""
    return encode(docs.select("doc_id", "text"), tokenizer, with_ids=False)
