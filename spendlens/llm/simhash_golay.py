"""SimHash near-duplicates found with Golay-code fuzzy hashing.

The perfect Golay code [23,12,7] has exactly one codeword within distance 3 of any 23-bit word.
Listing all codewords within distance 4 gives a word one key, or six if its nearest codeword is at
distance 3, and two words at distance 2 or less always share one: the codeword nearest to a word
halfway between them is within 4 of both.  A 64-bit fingerprint is cut into segments of 22, 21 and
21 bits.  Of two differing bits at most, some segment is free by the pigeonhole principle, and the
others hold at most two, so (a segment as it is, codewords near the next segment) makes keys of
33 bits or more that no link escapes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from spendlens.llm.graph import components
from spendlens.llm.shared import checkpointed, packed

#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
LENGTH, CHECK_BITS = 23, 11
#: (shift, width) of the three segments of a fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: A key with more members than two to one than the 65 keys of a radius-1 ball is cheaper by balls.
HOT_KEY = 128


def _remainders() -> np.ndarray:
    """Remainder of x^i modulo the generator for every bit of a word."""
    out, r = [], 1
    for _ in range(LENGTH):
        out.append(r)
        r <<= 1
        if r >> CHECK_BITS:
            r ^= GENERATOR
    return np.array(out, dtype=np.int64)


def syndrome(words: np.ndarray, rem: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), dtype=np.int64)
    for i in range(LENGTH):
        out ^= ((words >> i) & 1) * rem[i]
    return out


@lru_cache
def decoding_table() -> tuple[np.ndarray, np.ndarray]:
    """Remainders, and for each syndrome the error patterns of weight 4 or less (six, padded)."""
    rem = _remainders()
    table = np.zeros((1 << CHECK_BITS, 6), dtype=np.int64)
    filled = np.zeros(1 << CHECK_BITS, dtype=np.int64)
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            error = sum(1 << b for b in bits)
            s = int(np.bitwise_xor.reduce(rem[list(bits)])) if bits else 0
            if filled[s] < 6:
                table[s, filled[s]:] = error if filled[s] == 0 else table[s, 0]
                table[s, filled[s]] = error
                filled[s] += 1
    return rem, table


def near_codewords(words: np.ndarray, rem: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords within distance 4, six per word, repeats as padding."""
    return (words[:, None] ^ table[syndrome(words, rem)]) >> CHECK_BITS


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash over XXH64 (seed 42) of the lower-cased word shingles; 0 for a text without words."""
    if not text:
        return 0
    w = text.encode("utf-8").lower().split()
    if not w:
        return 0
    runs = iter([w]) if len(w) < shingle else zip(*(w[i:] for i in range(shingle)))
    ones, n, digest = np.zeros(64, dtype=np.int64), 0, xxhash.xxh64_intdigest
    while hashes := [digest(b" ".join(run), 42) for run in islice(runs, 8192)]:
        ones += np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp, hash)``: one row per document, ``fp`` the fingerprint's 64 bits as a signed long.

    ``hash`` is the XXH64 of the text as it is, which tells rows that share an id.

    Only the letters A to Z are lower-cased and only space and tab to carriage return separate
    words.  Texts of any length are hashed in chunks of shingles.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:       # a text at a time leaves the batch
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64)), b.column("hash")], ["doc_id", "fp", "hash"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    return rows.mapInArrow(run, "doc_id long, fp long, hash long")


def golay_keys(fps: DataFrame) -> DataFrame:
    """``(key, fp)``: up to 18 keys of each distinct fingerprint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rem, table = decoding_table()
        for b in batches:
            fp = b.column("fp").to_numpy()
            u = fp.view(np.uint64)
            seg = [((u >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
            keys, owners = [], []
            for i in range(3):
                near = np.sort(near_codewords(seg[(i + 1) % 3], rem, table), axis=1)
                fresh = np.ones(near.shape, dtype=bool)
                fresh[:, 1:] = near[:, 1:] != near[:, :-1]
                k = (i << 36) | (seg[i][:, None] << 12) | near
                keys.append(k[fresh])
                owners.append(np.broadcast_to(fp[:, None], near.shape)[fresh])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def links(fps: DataFrame, max_distance: int = 2, hot_key: int = HOT_KEY) -> DataFrame:
    """Edges ``(a, b)`` that join exactly the components of distinct fingerprints ``fps(fp)``.

    Members of a key are joined in pairs and verified by their differing bits.  A key with more
    than ``hot_key`` members is not paired: its members meet on all words within one bit of them,
    which two fingerprints share if and only if they differ in two bits or fewer, and each is
    linked to the smallest fingerprint on that word.  That is exact and linear in the members.
    """
    if max_distance != 2:
        raise ValueError("the keys are built for links at two or fewer differing bits")
    keys = checkpointed(golay_keys(fps))
    counts = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keys.join(counts, "key")
    cool = shared.where(F.col("n") <= hot_key).select("key", "fp")
    a, b = cool.withColumnRenamed("fp", "a"), cool.withColumnRenamed("fp", "b")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = a.join(b, "key").where((F.col("a") < F.col("b")) & (apart <= max_distance)).select("a", "b")
    hot = shared.where(F.col("n") > hot_key).select("fp").distinct()
    ball = hot.select("fp", F.explode(F.expr("concat(array(0L), transform(sequence(0, 63), i -> shiftleft(1L, i)))"))
                      .alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    low = ball.groupBy("word").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").drop("z")
    stars = ball.join(low, "word").where("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def _grouped(docs: DataFrame, shingle: int = 3, max_distance: int = 2, hot_key: int = HOT_KEY) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows, and ``(fp, low, root)``: smallest doc_id and component of each distinct one."""
    marked = checkpointed(fingerprints(docs, shingle))
    classes = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    found = components(links(classes, max_distance, hot_key))
    return marked, classes.join(found, classes["fp"] == found["node"], "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 2, hot_key: int = HOT_KEY) -> DataFrame:
    """``(doc_id, fp, component_id)``: one row per input row.

    Documents whose fingerprints differ in at most ``max_distance`` bits are linked;
    ``component_id`` is the smallest doc_id reachable.  Equal fingerprints form one class before
    any join, so exact copies cost a partial aggregation only.  Texts without words share
    fingerprint 0 and are linked like any others.  A null doc_id is ignored by the minimum; a
    component of null ids only has a null component_id.  An empty table gives no rows.
    """
    marked, labelled = _grouped(docs, shingle, max_distance, hot_key)
    roots = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    names = labelled.join(roots, "root").select("fp", "component_id")
    return marked.join(names, "fp").select("doc_id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component: that with the smallest doc_id, then hash of the text.

    Null ids come last, so a component of null ids only keeps one of its rows too.  Rows alike in
    doc_id and text are interchangeable and one of them stays.  All columns come back unchanged,
    whatever their names; an empty table gives no rows.
    """
    marked, labelled = _grouped(docs)
    keep = (marked.join(labelled.select("fp", "root"), "fp").groupBy("root")
            .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash")).alias("_keep"))
            .select(F.col("_keep.doc_id").alias("_id"), F.col("_keep.hash").alias("_hash")))
    # Plain keys, null ids told by a flag: what the join deals out is dealt out for the last step too.
    key = [F.coalesce("_id", F.lit(0)).alias("_id"), F.col("_id").isNull().alias("_none"), "_hash"]
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"), packed(docs.columns).alias("_row"))
    rows = rows.select(*key, "_row").join(keep.select(*key), ["_id", "_none", "_hash"], "left_semi")
    return rows.dropDuplicates(["_id", "_none", "_hash"]).select("_row.*")
