"""Vector bin packing of tokenised examples into fixed-length sequences.

An example is a vector of tokens, one segment and loss-bearing tokens; a sequence limits all three
at once.  Each partition streams its examples through a pool of bounded size.  The open sequence
takes the pool's feasible example with the largest dot product of its vector and the sequence's
free space, both in units of the limits, so an example goes where it uses up what is most plentiful.
No shuffle is needed and no task holds more than a pool, whatever the partition's size.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, loss_tokens long")


@dataclass(frozen=True)
class Limits:
    """Most tokens, segments and loss-bearing tokens in one sequence."""
    tokens: int = 4096
    segments: int = 512
    loss: int = 4096


@dataclass
class Example:
    """A run of a document's ids (little-endian unsigned 32-bit) that starts at ``start``."""
    doc_id: int | None
    start: int
    ids: bytes
    total: int
    loss: np.ndarray | None = None      # per id; None: every id bears loss

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def loss_tokens(self) -> int:
        return self.length if self.loss is None else int(self.loss.sum())

    def head(self, room: int, loss_room: int) -> int:
        """The most ids from the start that fit into the tokens and the loss given."""
        n = min(self.length, room)
        if self.loss is None:
            return min(n, loss_room)
        return int(np.searchsorted(np.cumsum(self.loss[:n]), loss_room, side="right"))

    def cut(self, n: int) -> tuple[Example, Example]:
        a, b = (None, None) if self.loss is None else (self.loss[:n], self.loss[n:])
        return (Example(self.doc_id, self.start, self.ids[:4 * n], self.total, a),
                Example(self.doc_id, self.start + n, self.ids[4 * n:], self.total, b))


class Pool:
    """Examples that wait for a sequence, with their vectors in one array."""

    def __init__(self, limits: Limits, size: int):
        self.limits, self.size = limits, size
        self.units = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.float64)
        self.vectors = np.zeros((size + 1, 3))
        self.examples: list[Example] = []

    def add(self, e: Example) -> None:
        self.vectors[len(self.examples)] = (e.length, 1, e.loss_tokens())
        self.examples.append(e)

    def take(self, k: int) -> Example:
        last = self.examples.pop()
        if k == len(self.examples):
            return last
        out, self.examples[k] = self.examples[k], last
        self.vectors[k] = self.vectors[len(self.examples)]
        return out

    def best(self, free: np.ndarray) -> int | None:
        """The feasible example with the largest dot product with the free space."""
        v = self.vectors[:len(self.examples)]
        score = np.where((v <= free).all(axis=1), v @ (free / self.units ** 2), -1.0)
        k = int(score.argmax())
        return k if score[k] >= 0 else None

    def longest(self) -> int:
        return int(self.vectors[:len(self.examples), 0].argmax())


def _fill(pool: Pool, cut: bool) -> list[Example]:
    """The pieces of one sequence."""
    limits, out = pool.limits, []
    free = pool.units.copy()
    while pool.examples and free[0] > 0 and free[1] > 0:
        k = pool.best(free)
        if k is not None:
            e = pool.take(k)
        else:
            k = pool.longest()
            n = pool.examples[k].head(int(free[0]), int(free[2]))
            # An example over the limits has to be cut; others only where cutting is allowed.
            if n == 0 or not (cut or not out):
                break
            e, rest = pool.take(k).cut(n)
            pool.add(rest)
        out.append(e)
        free -= (e.length, 1, e.loss_tokens())
    return out


def _tail(pieces: list[Example], limits: Limits) -> Iterator[list[Example]]:
    """An unfilled sequence as sequences of power-of-two lengths, which need no padding."""
    left = sum(e.length for e in pieces)
    while left:
        want = left if left == limits.tokens else 1 << (left.bit_length() - 1)
        left -= want
        part: list[Example] = []
        while want:
            e = pieces.pop(0)
            if e.length > want:
                e, rest = e.cut(want)
                pieces.insert(0, rest)
            part.append(e)
            want -= e.length
        yield part


def place(examples: Iterator[Example], limits: Limits, cut: bool = True, pool_size: int = 512) -> Iterator[list[Example]]:
    """Sequences, each a list of pieces in order; every id lies in exactly one piece."""
    pool, more = Pool(limits, pool_size), True
    while True:
        while more and len(pool.examples) < pool_size:
            e = next(examples, None)
            if e is None:
                more = False
                break
            # Whole sequences come off a long example at once; what is left waits in the pool.
            while e.length >= limits.tokens and (n := e.head(limits.tokens, limits.loss)) == limits.tokens and limits.segments:
                whole, e = e.cut(n)
                yield [whole]
            if e.length:
                pool.add(e)
        if not pool.examples:
            return
        pieces = _fill(pool, cut)
        if not pieces:
            raise ValueError(f"an example cannot be placed under {limits}")
        if cut:
            yield from _tail(pieces, limits)
        else:
            yield pieces


def _rows(sequences: Iterator[list[Example]], first: int, at_once: int = 4096) -> Iterator[pd.DataFrame]:
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]

    def frame(rows):
        out = pd.DataFrame(rows, columns=columns)
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    rows: list[tuple] = []
    for k, pieces in enumerate(sequences):
        offset = 0
        for e in pieces:
            rows.append((e.doc_id, e.start, e.length, zlib.crc32(e.ids), e.total, first + k, offset, e.loss_tokens()))
            offset += e.length
        if len(rows) >= at_once:
            yield frame(rows)
            rows = []
    if rows:
        yield frame(rows)


def _first_id() -> int:
    """Sequence ids of a partition start here, so that no two partitions share one."""
    return TaskContext.get().partitionId() << 40


class WordCache:
    """Ids of texts as bytes, through a cache of the tokenizer's ids of space-separated words.

    The tokenizer drops white space before its merges and no merge or normalisation crosses it, so
    the ids of a text are those of its words in order.  Texts that hold a special token's string
    are tokenised as a whole.  Words live in two generations of ``most`` each: the young one becomes
    the old one when it is full, and words met again come back, so frequent words stay.
    """

    #: Punctuation that is neither white space nor part of a contraction.
    TAIL = ".,;:!?#$%&*|"

    def __init__(self, path: str, most: int = 800_000):
        from tokenizers import Tokenizer
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.young: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each word from one call on all of them.

        Where every word is one run of letters, it ends with the one token that ends a run;
        otherwise offsets tell whose a token is.
        """
        e = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ids = np.array(e.ids, dtype="<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(texts) and all(map(str.isalpha, texts)):
            ends = [0, *ends.tolist()]
        else:
            starts = np.cumsum([0] + [len(t) + 1 for t in texts])
            ends = np.searchsorted(np.array([start for start, _ in e.offsets], dtype=np.int64), starts).tolist()
        raw = ids.tobytes()
        return (raw[4 * i:4 * j] for i, j in zip(ends, ends[1:]))

    def _learn(self, missing: set[bytes]) -> None:
        """Words new to the young generation, from the old one or the tokenizer.

        Letters with punctuation behind them are two words to the tokenizer, so such a word is put
        together from its parts; ASCII letters are looked up in lower case.
        """
        young, old, joined = self.young, self.old, []
        letters: dict[bytes, str] = {}
        other: dict[bytes, str] = {}
        for w in missing:
            if w in old:
                young[w] = old[w]
                continue
            text = w.decode()
            stem = text.rstrip(self.TAIL)
            low = stem.lower()
            if not stem.isalpha() or len(low) != len(stem):     # a few letters become two in lower case
                other[w] = text
                continue
            if not stem.isascii():
                low = stem
            parts = low.encode(), text[len(stem):].encode()
            joined.append((w, *parts))
            for part, run, kind in zip(parts, (low, text[len(stem):]), (letters, other)):
                if part in old:
                    young[part] = old[part]
                elif part not in young:
                    kind[part] = run
        for new in (letters, other):
            words, texts = list(new), list(new.values())
            for i in range(0, len(words), 1000):
                young.update(zip(words[i:i + 1000], self._encode(texts[i:i + 1000])))
        for w, low, tail in joined:
            young[w] = young[low] + young[tail]

    def _of_words(self, words: list[bytes]) -> list[bytes]:
        if len(self.young) > self.most:
            self.old, self.young = self.young, {b"": b""}
        found = list(map(self.young.get, words))
        gaps, i = [], -1
        try:
            while True:
                i = found.index(None, i + 1)
                gaps.append(i)
        except ValueError:
            pass
        if gaps:
            self._learn({words[i] for i in gaps})
            for i in gaps:
                found[i] = self.young[words[i]]
        return found

    def ids(self, text: str) -> bytes:
        return self.many([text])[0]

    def many(self, texts: list[str], at_once: int = 50_000) -> list[bytes]:
        """Ids of each text; words of several texts are looked up together, long texts in runs."""
        out: list[bytes] = []
        words: list[bytes] = []
        ends: list[int] = []

        def flush() -> None:
            found, start = self._of_words(words), 0
            for end in ends:
                out.append(b"".join(found[start:end]))
                start = end
            words.clear()
            ends.clear()

        for text in texts:
            if any(s in text for s in self.special):
                flush()
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes())
                continue
            own = text.encode("utf-8").split()
            if len(own) > at_once:
                flush()
                out.append(b"".join(b"".join(self._of_words(own[i:i + at_once])) for i in range(0, len(own), at_once)))
                continue
            words += own
            ends.append(len(words))
            if len(words) >= at_once:
                flush()
        flush()
        return out


class WholeTexts:
    """Ids of texts as bytes by the tokenizer itself, for tokenizers that a word cache does not fit."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)

    def many(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


def by_words(path: str) -> bool:
    """Whether the tokenizer lower-cases, marks the ends of words and drops the white space between them, as the word cache assumes."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    suffix = spec["model"].get("end_of_word_suffix")
    if suffix != "</w>" or '"Lowercase"' not in json.dumps(spec["normalizer"]):
        return False
    from tokenizers import Tokenizer
    ids = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in ("Two\n \tWORDS", "two", "words")]
    return ids[0] == ids[1] + ids[2]


@lru_cache(maxsize=2)
def word_cache(path: str) -> WordCache | WholeTexts:
    """One source of ids per worker process and tokenizer, kept from task to task."""
    return WordCache(path) if by_words(path) else WholeTexts(path)


def pack_texts(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), end_id: int = 2,
               cut: bool = True) -> DataFrame:
    """Pieces of the packed texts of ``docs(doc_id, text)``, columns as in ``SCHEMA``.

    Tokenizers of lower-cased words go through a cache of words, any other tokenizes whole texts.
    A document is its ids followed by ``end_id``; a null text is empty, so just that id.  Every id
    bears loss.  With ``cut`` documents are cut freely and no sequence needs padding: it is full or
    its length is a power of two.  Without, only documents over the limits are cut and sequences
    are padded.  Rows that share a doc_id, or have none, are packed each on their own.
    ``sequence_id`` is the partition number times 2^40 plus a counter.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, end = word_cache(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()

        def examples() -> Iterator[Example]:
            for b in batches:
                for i in range(0, len(b), 256):
                    some = b.iloc[i:i + 256]
                    for doc_id, ids in zip(some["doc_id"].astype("Int64"), cache.many([t or "" for t in some["text"]])):
                        yield Example(None if doc_id is pd.NA else int(doc_id), 0, ids + end, len(ids) // 4 + 1)

        yield from _rows(place(examples(), limits, cut), _first_id())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, SCHEMA)


def pack_examples(rows: DataFrame, limits: Limits = Limits(), cut: bool = False) -> DataFrame:
    """Like ``pack_texts`` for tokenised examples ``rows(doc_id, ids array<int>, loss array<boolean>)``.

    ``loss`` marks the loss-bearing ids; a null one means all.  Examples with null or no ids have
    no pieces.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def examples() -> Iterator[Example]:
            for b in batches:
                for doc_id, ids, loss in zip(b["doc_id"].astype("Int64"), b["ids"], b["loss"]):
                    if ids is None or len(ids) == 0:
                        continue
                    marks = None if loss is None else np.asarray(loss, dtype=np.int64)
                    yield Example(None if doc_id is pd.NA else int(doc_id), 0,
                                  np.asarray(ids).astype("<u4").tobytes(), len(ids), marks)

        yield from _rows(place(examples(), limits, cut), _first_id())

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids", "loss").mapInPandas(run, SCHEMA)


def _word_bpe() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_texts(docs, _word_bpe())


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as packed pieces."""
    return pack_texts(docs, _word_bpe())
