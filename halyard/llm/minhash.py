"""Near-duplicate texts by SuperMinHash signatures, banding, verification and union-find.

1. One pass hashes each text's word shingles to a set, and the set to a
   SuperMinHash signature: element e gives slot p(0) the value 0+u, slot p(1)
   the value 1+u', ... for a permutation p of the slots drawn by e, and each
   slot keeps its least value.  The ranks of one element are a permutation, so
   slots are negatively correlated and the estimate varies less than plain
   MinHash's; once every slot holds a value below j+1, later ranks cannot win
   and the element stops early.  Slot equality has probability J exactly for
   any way to draw p; p is affine here, a*j+b mod m with odd a.
2. Texts with equal sets become one class.  A hash of each band of slots is a
   bucket; in a bucket, 8-bit sketches of whole signatures part chance
   meetings from likely pairs (five standard deviations of slack).  Small sets
   also meet by the least of their elements, which finds all their pairs, and
   are compared there as they are.
3. Connected likely pairs form neighbourhoods.  Within each, all pairs are
   confirmed on the full sets by a matrix product of the shingle incidence.
   A neighbourhood or bucket beyond a block is dealt into blocks, every pair
   of blocks one task.
4. Confirmed links form the components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm import hashing
from halyard.llm.groups import TEXT_BLOCK, Group, UnionFind, compare_in_blocks, components, key_sizes, one_by_one
from halyard.llm.shared import KeyFilter, bounded_batches, free, join_hot, map_texts, settled, table, tidy

SLOTS = 256
_LOW = np.uint64(0x0000FFFFFFFFFFFF)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def superminhash(s: np.ndarray, m: int = SLOTS) -> np.ndarray:
    """Signature of a set of 64-bit hashes; m is a power of two.  Rank in the upper 16 bits, fraction below."""
    sig = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    mask = np.uint64(m - 1)
    a = ((s >> np.uint64(7)) | np.uint64(1)) & mask
    b = (s >> np.uint64(33)) & mask
    at = 0
    while at < m:
        ranks = min(m - at, max(1, math.ceil(m * (math.log(m) + 1) / len(s)) if at == 0 else 2))
        j = np.arange(at, at + ranks, dtype=np.uint64)[:, None]
        slot = (a * j + b) & mask
        value = (hashing.mix(s + j * _GOLD) & _LOW) | (j << np.uint64(48))
        np.minimum.at(sig, slot.ravel().astype(np.intp), value.ravel())
        at += ranks
        if int(sig.max()) >> 48 < at:
            break
    return sig


def band_rows(threshold: float, m: int = SLOTS, miss: float = 4e-6) -> int:
    """The most slots a band can have if a pair at the threshold may be missed with this probability."""
    return max(r for r in range(1, 33) if (1 - threshold**r) ** (m // r) <= miss)


#: Sets of at most so many shingles are also found by prefixes: their slots depend on each other too much for bands.
FEW = 25


def _band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """Even numbers, one for each band."""
    n = len(sig) // rows
    k = (hashing.mix(sig[: n * rows].reshape(n, rows)) * hashing._STEP[:rows]).sum(axis=1, dtype=np.uint64)
    return hashing.mix(k + np.arange(n, dtype=np.uint64) * _GOLD) & ~np.uint64(1)


def _prefix_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """Odd numbers for the least elements of a set: two sets at the threshold share one, since each lacks few of the other's."""
    return hashing.mix(s[: len(s) - -(-percent * len(s) // 100) + 1] ^ _GOLD) | np.uint64(1)


_SIGNATURE = "n_shingles long, set_id binary, keys array<long>, sketch binary, few binary"


def signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The other columns of docs, and for each text its number of shingles, set id, keys, sketch and, of few, the set; null without words."""
    rows = band_rows(percent / 100)

    def make(texts: list[str | None]) -> list[pa.Array]:
        out: list[tuple] = []
        for words in hashing.word_hashes(texts):
            s = hashing.shingles(words, k)
            if not len(s):
                out.append((0, None, None, None, None))
                continue
            sig, few = superminhash(s), len(s) <= FEW
            keys = _band_keys(sig, rows)
            keys = np.concatenate((keys, _prefix_keys(s, percent))) if few else keys
            out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), keys.view(np.int64), sig.astype(np.uint8).tobytes(), s.tobytes() if few else None))
        types = pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()
        return [pa.array([x[i] for x in out], t) for i, t in enumerate(types)]

    return map_texts(docs, [c for c in docs.columns if c != "text"], make, _SIGNATURE)


def _likely(percent: int, m: int = SLOTS):
    threshold = percent / 100
    least = m * (threshold - 5 * math.sqrt(threshold * (1 - threshold) / m))

    def links(group: Group) -> Iterator[tuple[int, int]]:
        if int(group["key"][0]) & 1:
            yield from _alike([np.frombuffer(x, np.uint64) for x in group["few"]], percent)
            return
        x = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(-1, m)
        n = group["n_shingles"]
        rest = np.arange(len(x))
        while len(rest) > 1:  # one search outwards from each member that nobody has reached
            front, rest = [int(rest[0])], rest[1:]
            while front and len(rest):
                i = front.pop()
                near = (np.count_nonzero(x[rest] == x[i], axis=1) >= least) & (np.minimum(n[rest], n[i]) >= threshold * np.maximum(n[rest], n[i]))
                for j in rest[near].tolist():
                    yield i, j
                    front.append(j)
                rest = rest[~near]

    return links


def _alike(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """A forest of the pairs of sets with 100 * intersection >= percent * union."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        if 100 * both >= percent * (sizes.sum() - both):
            yield 0, 1
        return
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[column] > 1  # a shingle of one text is in no intersection
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    step = max(64, 4_000_000 // len(sets))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        lo, hi = np.searchsorted(column, [at, at + step])
        part = np.zeros((len(sets), step), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    a, b = np.nonzero(np.triu(100 * both >= percent * (sizes[:, None] + sizes[None, :] - both), 1))
    uf = UnionFind(len(sets))
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        if uf.union(i, j):
            yield i, j


def _confirmed(k: int, percent: int):
    def links(group: Group) -> Iterator[tuple[int, int]]:
        yield from _alike([hashing.shingles(w, k) for w in hashing.word_hashes(group["text"].tolist())], percent)

    return links


def row_keys() -> list[Column]:
    """Two hashes that tell rows of documents (doc_id, text) apart, whatever is null."""
    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return [F.xxhash64(doc, text), F.xxhash64(F.lit("2"), text, doc)]


def one_of_each(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """documents, all their columns, with one row of each group of near-duplicates: the least doc_id, once.

    Rows of one doc_id and one text are one row, also without words: the first
    of them stays.  Rows without doc_id count as in near_duplicates.
    """
    names = documents.columns
    r, r2 = free(names, "_r", "_r2")
    columns = [F.col("row").alias(r), F.col("row2").alias(r2)]
    kept = settled(lambda: near_duplicates(documents, words, percent).filter("kept").select(*columns).distinct(), "kept")
    keyed = documents.withColumns(dict(zip((r, r2), row_keys(), strict=True)))
    # The join has brought equal rows together, so dropping repeats moves nothing again.
    return keyed.join(kept, [r, r2], "left_semi").dropDuplicates([r, r2]).drop(r, r2)


def _members(classes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, id, n_shingles, sketch, few): the classes by those of their keys that others have too."""
    sieve = KeyFilter(sizes, "key")
    names = ["key", "id", "n_shingles", "sketch", "few"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                lists = batch.column(0)
                key = lists.flatten().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
                there = np.flatnonzero(sieve.may_hold(key))
                odd = (key[there] & 1).astype(bool)
                rows = pa.array(owner[there])
                # Keys of bands bring the sketch, those of prefixes the set.
                sketch = batch.column(3).take(pa.array(owner[there], mask=odd))
                few = batch.column(4).take(pa.array(owner[there], mask=~odd))
                yield pa.RecordBatch.from_arrays([pa.array(key[there]), batch.column(1).take(rows), batch.column(2).take(rows), sketch, few], names)

    return classes.select("keys", "set_id", "n_shingles", "sketch", "few").mapInArrow(tidy(run), "key long, id binary, n_shingles long, sketch binary, few binary")


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, row, row2) of each row of documents (doc_id, text).

    Texts link if 100 * intersection >= percent * union of their distinct
    ``words``-word shingles.  component_id is the least doc_id that a row
    reaches over links; kept says that it is the row's own.  Null, empty and
    blank texts have no set and link with nothing.  Repeated rows are equal
    texts: rows that share the least doc_id are all kept.  A row without
    doc_id has its component's least doc_id (null if there is none) and is
    kept only in the latter case.  row and row2 are hashes of doc_id and text.
    An empty table gives no rows; very long texts are read whole.  Other
    columns are not read.
    """
    bounded_batches(documents.sparkSession)
    one, two = row_keys()
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), one.alias("row"), two.alias("row2"), F.col("text").cast("string").alias("text"))
    sets = table(signatures(docs, words, percent), "signatures")
    # What leads to the components is dropped once they are known.
    component = settled(lambda: _component_of_sets(docs, sets, words, percent), "component")
    columns = ["doc_id", "n_shingles", "component_id", "row", "row2"]
    full = join_hot(sets.select("doc_id", "n_shingles", "set_id", "row", "row2").filter("set_id is not null"), component, "set_id", "n", written=True).select(*columns)
    bare = sets.filter("set_id is null").withColumn("component_id", F.col("doc_id")).select(*columns)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return full.union(bare).select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "row", "row2")


def _component_of_sets(docs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """(set_id, component_id, n): the least doc_id that each set reaches, and the number of rows that have the set."""
    firsts = [F.first(c).alias(c) for c in ("n_shingles", "keys", "sketch", "few")]
    whole = sets.filter("set_id is not null").groupBy("set_id")
    # A set may be that of a third of all rows: the number of its rows tells.
    classes = table(whole.agg(F.min("doc_id").alias("least"), F.min("row").alias("own"), F.count("*").alias("n"), *firsts), "classes")
    sizes = key_sizes(classes.select(F.explode("keys").alias("key")))
    likely = components(compare_in_blocks(_members(classes, sizes), one_by_one(_likely(percent)), 2000, sizes=sizes))
    likely = table(likely.select(F.col("node").alias("id"), F.col("root").alias("key")), "likely")
    held = table(likely.join(classes.select(F.col("set_id").alias("id"), F.col("own").alias("row")), "id"), "held")
    # Only texts that stand for a class are shuffled, by a key that few rows share.
    found = docs.select("row", "text").filter(KeyFilter(held, "row").column(F.col("row"))).join(held, "row").select("key", "id", "text")
    texts = table(_with_set(found, words), "neighbours")
    links = compare_in_blocks(texts, one_by_one(_confirmed(words, percent)), 1000, F.length("text"), TEXT_BLOCK)
    roots = components(links).select(F.col("node").alias("set_id"), "root")
    joined = classes.select("set_id", "least", "n").join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    joined = table(joined, "joined")
    least = joined.groupBy("root").agg(F.count("*").alias("sets"), F.min("least").alias("component_id"))
    return join_hot(joined.select("set_id", "root", "n"), least, "root", "sets").select("set_id", "component_id", "n")


def _with_set(rows: DataFrame, k: int) -> DataFrame:
    """The rows (key, id, text) whose text has the set id; one of each."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            own = [hashlib.blake2b(hashing.shingles(w, k).tobytes(), digest_size=16).digest() for w in hashing.word_hashes(batch.column(2).to_pylist())]
            yield batch.filter(pa.array([a == b for a, b in zip(own, batch.column(1).to_pylist(), strict=True)], pa.bool_()))

    return rows.mapInArrow(tidy(run), rows.schema).dropDuplicates(["id"])
