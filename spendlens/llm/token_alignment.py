"""Alignment of two tokenizers of the same bytes by divide and conquer at shared cuts.

Both tokenizers cut a text's bytes; where tokens of both end, the text falls apart.  An interval looks
for a common end near its middle, by bisecting the other tokenizer's ends for those of the one, outward
from the middle; both halves go on alone, and an interval without a common end inside is a group.  All
intervals of many texts go down a level together.

Tokens of a group are linked, every one of A with every one of B.  How many documents hold a pair of ids
linked is counted by blocks: a task numbers the distinct pairs of some documents, so that counts travel
once per block and pair and not per document, and return to the block's documents by these numbers.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from spendlens.llm.shared import shared_folder

#: Text bytes that are aligned together, and distinct pairs (by document) after which a block ends.
SLICE, BLOCK = 1 << 20, 1 << 20
#: Characters after which a text is encoded in parts.
PART = 1 << 16
#: A group with more links than this is expanded by its distinct ids.
WIDE = 1 << 14
#: A single space between characters that are no white space.  Byte-level tokens of this pattern never reach
#: over its left side, and pieces do not where no piece holds a space after another character.
CUT = re.compile("(?<=[!-~¡-ᙿ]) (?=[!-~¡-ᙿ])")

#: Texts of these characters only are cut alike by all engines of the pattern: printable ASCII, its white space, and Latin
#: letters and signs whose Unicode classes have long been settled.
PLAIN = re.compile("[\t\n\r -~¡-ɏ]*")
#: Fixed value: the pattern by which byte-level tokenizers of this kind cut a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable bytes stand for themselves, others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Strings:
    """Byte strings by number, one after another."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(x) for x in strings], dtype=np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.joined_bytes = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def joined(self, numbers: np.ndarray) -> np.ndarray:
        """Bytes of the strings so numbered, one after another."""
        n = self.size[numbers]
        return self.joined_bytes[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.at[numbers], n)]

    def spell(self, rows: list[np.ndarray], want: list[bytes]) -> list[bool]:
        """Whether the strings of each row make up the bytes wanted."""
        sizes = np.array([len(w) for w in want], dtype=np.int64)
        fits = np.array([int(self.size[r].sum()) for r in rows], dtype=np.int64) == sizes
        got = self.joined(np.concatenate([np.zeros(0, np.int64)] + [r for r, k in zip(rows, fits) if k]))
        wrong = got != np.frombuffer(b"".join([w for w, k in zip(want, fits) if k]), dtype=np.uint8)
        faults = np.diff(np.concatenate([[0], np.cumsum(wrong)])[np.concatenate([[0], np.cumsum(sizes[fits])])])
        fits[fits] = faults == 0
        return fits.tolist()


class TokenizerPair:
    """Both tokenizers with the bytes of their ids."""

    def __init__(self, a_path: str, b_path: str):
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_strings, self.b_strings = Strings(a_bytes), Strings(b_bytes)
        self.by_word = not any(re.search("[^▁]▁", p) for p in pieces)
        self.plain = self._plain(json.loads(self.a.to_str()), a_bytes)
        #: Decimal ids with what follows them: A inside and at the end of a group, then B.
        self.decimals = Strings([f"{i}{end}".encode() for n, ends in ((len(a_bytes), ",|"), (len(b_bytes), ",;")) for i in range(n) for end in ends])

    def _plain(self, spec: dict, a_bytes: list[bytes]) -> tiktoken.Encoding | None:
        """The byte-level tokenizer again, faster, for plain texts; None unless ids follow the order of merges.

        Other texts are left to the first one, whose Unicode tables may differ.
        """
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"].get("merges", [])]
        vocab = self.a.get_vocab(with_added_tokens=False)
        byte_level = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if spec["normalizer"] or not byte_level or any(vocab.get(m) != 256 + k for k, m in enumerate(merges)):
            return None
        ranks = {a_bytes[i]: i for i in range(256 + len(merges))}
        return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(merges) else None

    def parts(self, text: str) -> list[str]:
        """A long text cut where both tokenizers cut it; each part is encoded with a space before it."""
        out, start = [], 0
        while self.by_word and len(text) - start > PART and (m := CUT.search(text, start + PART)):
            out.append(text[start:m.start()])
            start = m.end()
        return out + [text[start:]]

    def _ids(self, parts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of either tokenizer; None where the bytes of one differ from a space and the part."""
        kinds = [self.plain is not None and PLAIN.fullmatch(p) is not None for p in parts]
        others = iter(self.a.encode_batch_fast([" " + p for p, k in zip(parts, kinds) if not k], add_special_tokens=False))
        a = [self.plain.encode_ordinary(" " + p) if k else next(others).ids for p, k in zip(parts, kinds)]
        a, b = ([np.array(x, np.int64) for x in ids] for ids in (a, self.b.encode(parts, num_threads=1)))
        want = [b" " + p.encode() for p in parts]
        same = [x and y for x, y in zip(self.a_strings.spell(a, want), self.b_strings.spell(b, want))]
        return [(x, y) if k else None for x, y, k in zip(a, b, same)]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and of B for each text; None for null, empty, and texts whose bytes a tokenizer changes."""
        parts = [self.parts(t) if t else [] for t in texts]
        ids, out = iter(self._ids([p for ps in parts for p in ps])), []
        for ps in parts:
            mine = [next(ids) for _ in ps]
            fine = mine and all(x is not None for x in mine)
            out.append(tuple(np.concatenate([x[k] for x in mine]) for k in (0, 1)) if fine else None)
        return out


@lru_cache(maxsize=2)
def tokenizer_pair(a_path: str, b_path: str) -> TokenizerPair:
    return TokenizerPair(a_path, b_path)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after another, and the range that each is of."""
    n = hi - lo
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n), np.repeat(np.arange(len(lo)), n)


def _middle_cuts(ends_a: np.ndarray, ends_b: np.ndarray, lo: np.ndarray, hi: np.ndarray, mid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For A's tokens ``lo`` to ``hi``, the last left out: that with an end in both nearest to byte ``mid``, and B's token there; -1 for none."""
    at_a, at_b = np.full(len(lo), -1), np.full(len(lo), -1)
    centre = np.clip(np.searchsorted(ends_a, mid), lo, hi - 1)
    left, right, open_, width = centre.copy(), centre.copy(), np.arange(len(lo)), 1
    while len(open_):
        l, r = np.maximum(left[open_] - width, lo[open_]), np.minimum(right[open_] + width, hi[open_])
        before, i = _ranges(l, left[open_])
        after, j = _ranges(right[open_], r)
        token, owner = np.concatenate([before, after]), open_[np.concatenate([i, j])]
        end = ends_a[token]
        place = np.searchsorted(ends_b, end)
        hit = np.nonzero(ends_b[place] == end)[0]
        if width > 1:                       # the nearest is written last
            hit = hit[np.argsort(-np.abs(token[hit] - centre[owner[hit]]), kind="stable")]
        at_a[owner[hit]], at_b[owner[hit]] = token[hit], place[hit]
        left[open_], right[open_] = l, r
        open_ = open_[(at_a[open_] < 0) & ((l > lo[open_]) | (r < hi[open_]))]
        width *= 2
    return at_a, at_b


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, a_lo: np.ndarray, a_hi: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last tokens of all groups, in order, of A and of B.

    ``ends_a`` and ``ends_b`` are growing byte offsets; A's tokens from ``a_lo`` up to ``a_hi`` cover the same bytes as
    B's from ``b_lo`` up to ``b_hi``, one such interval per text.
    """
    last_a, last_b = [a_hi - 1], [b_hi - 1]
    while len(a_lo):
        more = (a_hi - a_lo > 1) & (b_hi - b_lo > 1)
        a_lo, a_hi, b_lo, b_hi = a_lo[more], a_hi[more], b_lo[more], b_hi[more]
        at_a, at_b = _middle_cuts(ends_a, ends_b, a_lo, a_hi - 1, (ends_a[a_lo] + ends_a[a_hi - 1]) // 2)
        cut = at_a >= 0
        a_lo, a_hi, b_lo, b_hi, at_a, at_b = a_lo[cut], a_hi[cut], b_lo[cut], b_hi[cut], at_a[cut], at_b[cut]
        last_a.append(at_a)
        last_b.append(at_b)
        # Halves side by side: intervals stay in order, which makes bisecting for all of them cheap.
        a_lo, a_hi, b_lo, b_hi = (np.stack(x, axis=1).ravel() for x in ((a_lo, at_a + 1), (at_a + 1, a_hi), (b_lo, at_b + 1), (at_b + 1, b_hi)))
    return np.sort(np.concatenate(last_a)), np.sort(np.concatenate(last_b))


class Aligned:
    """Ids of some texts one after another, and the last tokens of their groups."""

    def __init__(self, pair: TokenizerPair, texts: list[str | None]):
        ids = pair.encode(texts)
        self.there = [x is not None for x in ids]
        some = [x for x in ids if x is not None]
        none = [np.zeros(0, np.int64)]
        self.a, self.b = (np.concatenate(none + [x[k] for x in some]) for k in (0, 1))
        self.a_at, self.b_at = (np.cumsum([0] + [len(x[k]) for x in some]) for k in (0, 1))
        self.a_last, self.b_last = shared_cuts(*(np.cumsum(z).astype(np.int32) for z in (pair.a_strings.size[self.a], pair.b_strings.size[self.b])),
                                               self.a_at[:-1], self.a_at[1:], self.b_at[:-1], self.b_at[1:])
        self.groups_at = np.searchsorted(self.a_last, self.a_at)
        self.n_a, self.n_b = np.diff(self.a_last, prepend=-1), np.diff(self.b_last, prepend=-1)

    def written(self, pair: TokenizerPair) -> Iterator[bytes]:
        """Each text's groups as decimal ids, ``a1,a2|b1;a3|b2``."""
        group_a, group_b = np.repeat(np.arange(len(self.n_a)), self.n_a), np.repeat(np.arange(len(self.n_b)), self.n_b)
        out = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        place_a = np.arange(len(self.a)) + (self.b_last - self.n_b + 1)[group_a]
        place_b = np.arange(len(self.b)) + (self.a_last + 1)[group_b]
        out[place_a], out[place_b] = 2 * self.a, 2 * (self.b + len(pair.a_strings.size))
        out[place_a[self.a_last]] += 1
        out[place_b[self.b_last]] += 1
        text = pair.decimals.joined(out).tobytes()
        ends = np.concatenate([[0], np.cumsum(pair.decimals.size[out])])[self.a_at + self.b_at]
        for s, e in zip(ends, ends[1:]):
            yield text[s:e - 1]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each text's distinct linked pairs (A's id times 2^32 plus B's) in order, and how often each is linked."""
        links = self.n_a * self.n_b
        narrow = links <= WIDE
        token = np.repeat(np.where(narrow, self.n_b, 0), self.n_a)      # links of each of A's tokens
        upto = np.concatenate([[0], np.cumsum(token)])
        first = np.repeat(self.b_last - self.n_b + 1, self.n_a)
        other = self.b[np.arange(upto[-1]) - np.repeat(upto[:-1] - first, token)]
        key = (np.repeat(self.a, token) << 32) | other
        for s, e, g, h in zip(self.a_at[:-1], self.a_at[1:], self.groups_at[:-1], self.groups_at[1:]):
            keys, n = np.unique(key[upto[s]:upto[e]], return_counts=True)
            wide = g + np.nonzero(~narrow[g:h])[0]
            if len(wide):
                keys, n = [keys], [n]
                for k in wide:
                    x, c = np.unique(self.a[self.a_last[k] - self.n_a[k] + 1:self.a_last[k] + 1], return_counts=True)
                    y, d = np.unique(self.b[self.b_last[k] - self.n_b[k] + 1:self.b_last[k] + 1], return_counts=True)
                    keys.append(((x[:, None] << 32) | y).ravel())
                    n.append(np.outer(c, d).ravel())
                keys, back = np.unique(np.concatenate(keys), return_inverse=True)
                n = np.bincount(back, np.concatenate(n)).astype(np.int64)
            yield keys, n


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    """Ids and texts of a batch, about ``SLICE`` characters of text at a time."""
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column("doc_id"), batch.column("text")):
        ids.append(i.as_py())
        texts.append(t.as_py())
        size += len(texts[-1] or "")
        if size >= SLICE:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")


def alignments(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``(doc_id, a_ids, b_ids, a_ends, b_ends)``: ids of either tokenizer, and the number of ids up to the end of each group.

    A byte-level tokenizer reads a space and the text, a piece tokenizer that adds the space reads the text.  Null and
    empty texts, and those whose bytes a tokenizer changes, have empty arrays.  Other columns of ``docs`` are ignored,
    repeated rows and null ids stay rows of their own, an empty table gives no rows.
    """
    paths = _paths(a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizer_pair(*paths)
        for b in batches:
            for ids, texts in _slices(b):
                x, rows, k = Aligned(pair, texts), [], 0
                for there in x.there:
                    if not there:
                        rows.append([[]] * 4)
                        continue
                    (s, e), (u, v), (g, h) = x.a_at[k:k + 2], x.b_at[k:k + 2], x.groups_at[k:k + 2]
                    rows.append([x.a[s:e], x.b[u:v], x.a_last[g:h] + 1 - s, x.b_last[g:h] + 1 - u])
                    k += 1
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array([r[c] for r in rows], pa.list_(pa.int32())) for c in range(4)]],
                                                 ["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")


#: Rows of the first pass: one per document, and for each block one with its distinct pairs (``pairs``) and their documents.
_PASS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary, pairs array<long>, docs array<int>"
_NAMES = [f.split()[0] for f in _PASS.split(", ")]


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(x.astype(np.int32).tobytes(), codec="zstd", asbytes=True)


def _unpacked(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, decompressed_size=4 * n, codec="zstd", asbytes=True), np.int32)


def _block(number: int, rows: list[tuple]) -> pa.RecordBatch:
    """The documents of a block and its distinct pairs, documents naming pairs by their places in these."""
    pairs, place, n = np.unique(np.concatenate([np.zeros(0, np.int64)] + [r[-2] for r in rows]), return_inverse=True, return_counts=True)
    cols: list[list] = [[] for _ in _NAMES]
    at = 0
    for *head, keys, times in rows:
        mine = place[at:at + len(keys)]
        at += len(keys)
        for c, v in zip(cols, [number, *head, len(keys).to_bytes(4, "little") + _packed(np.diff(mine, prepend=0)), _packed(times), None, None]):
            c.append(v)
    for c, v in zip(cols, [number, *[None] * (len(_NAMES) - 3), pairs, n.astype(np.int32)]):
        c.append(v)
    kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], _NAMES)


def link_statistics(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, block: int = BLOCK) -> DataFrame:
    """Per document ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` beside ``doc_id``.

    A pair's count is the number of documents (rows) that hold it linked.  ``n_best`` counts links whose count is the highest
    of their A id, ties included, ``count_sum`` adds up the counts over links.  Documents without tokens (see
    ``alignments``) have zeros and ''.  Nulls, repeated rows, other columns and empty tables as there.

    The first pass is written to the shared folder by blocks of about ``block`` distinct pairs, one document at least.
    """
    paths = _paths(a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number, rows, held = tokenizer_pair(*paths), TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            for ids, texts in _slices(b):
                x = Aligned(pair, texts)
                found, k = zip(x.written(pair), x.pairs()), 0
                for doc_id, there in zip(ids, x.there):
                    if not there:
                        rows.append((doc_id, 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)))
                        continue
                    text, (keys, times) = next(found)
                    rows.append((doc_id, int(x.a_at[k + 1] - x.a_at[k]), int(x.b_at[k + 1] - x.b_at[k]), int(x.groups_at[k + 1] - x.groups_at[k]),
                                 int(times.sum()), hashlib.sha256(text).hexdigest(), keys, times))
                    held, k = held + len(keys), k + 1
                    if held >= block:
                        yield _block(number, rows)
                        number, rows, held = number + 1, [], 0
        if rows:
            yield _block(number, rows)

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right["place"].to_numpy()
        n, top = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        n[at], top[at] = right["n"].to_numpy(), right["top"].to_numpy()
        best, total = [], []
        for places, times in zip(left["places"], left["times"]):
            raw = places.as_py()
            size = int.from_bytes(raw[:4], "little")
            mine, times = np.cumsum(_unpacked(raw[4:], size)), _unpacked(times.as_py(), size).astype(np.int64)
            best.append(int((times * top[mine]).sum()))
            total.append(int((times * n[mine]).sum()))
        return left.select(out[:5]).append_column("n_best", pa.array(best, pa.int64())).append_column(
            "count_sum", pa.array(total, pa.int64())).append_column("groups_sha256", left["groups_sha256"])

    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PASS).write.parquet(path)
    first = spark.read.parquet(path)
    pairs = first.where("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "x"))
    pairs = pairs.select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.shiftright("pair", 32))
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    counts = counts.join(highest, "a").select(F.col("pair").alias("_pair"), "n", (F.col("n") == F.col("most")).cast("int").alias("top"))
    back = pairs.join(counts, F.col("pair") == F.col("_pair")).select(F.col("block").alias("block"), F.col("place").alias("place"), "n", "top")
    rows = first.where("places IS NOT NULL").select("block", *out, "groups_sha256", "places", "times")
    # New names: the two sides of a cogroup may not share columns of one origin.
    rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])
    return rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(
        counted, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    """Alignment of the byte-level and the piece tokenizer over every document."""
    return link_statistics(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
