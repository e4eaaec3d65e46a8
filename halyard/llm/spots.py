"""Document fingerprints by SpotSigs.

A signature is a common word (the anchor) and the chain of content words that
follow it.  The hashes of a text's signatures are its set; the fingerprint
writes that set down.  Sets are partitioned by length: those as alike as a
bound are in one partition or in neighbouring ones, and others are not
compared.  The Jaccard similarity of the rest is pruned: it stops as soon as
what is left of the two sets cannot reach the bound.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm import hashing
from halyard.llm.groups import TEXT_BLOCK, Group, compare_in_blocks, components, one_by_one
from halyard.llm.shared import bounded_batches, free, join_hot, table, tidy

#: Common words that anchor chains, in English, German, French and Spanish, and words that chains skip.
ANCHORS = "the a is of to and in it be was for der die das und ist ein den zu von le la les de des un une et que est el los las en y es con".split()
SKIPPED = "that on as with by are this at an from or mit für sich auf im qui pour par sur dans su para por del al se".split()
CHAIN = 2
#: Tables, lists and other languages hold few common words: in stretches of GAP words without one, one word in SPARE is an anchor, by hash.
GAP, SPARE = 16, 4

_ANCHOR = np.sort(np.concatenate(list(hashing.word_hashes(ANCHORS))))
_COMMON = np.sort(np.concatenate([_ANCHOR, *hashing.word_hashes(SKIPPED)]))


def _plain(text: str) -> str:
    """ASCII punctuation is white space, letters are lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).decode("utf-8", "surrogatepass")


_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _member(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_, x)
    at[at == len(sorted_)] = 0
    return sorted_[at] == x


def signature_set(text: str | None) -> np.ndarray:
    """Sorted distinct 32-bit signatures, that of a text's beginning among them.

    A text without any has one, of all its words or of itself; an empty one none.
    """
    if not text:
        return np.empty(0, np.uint32)
    words = next(iter(hashing.word_hashes([_plain(text)])))
    content = np.flatnonzero(~_member(words, _COMMON))
    common, at = _member(words, _ANCHOR), np.arange(len(words))
    bare = at - np.maximum.accumulate(np.where(common, at, -1)) > GAP
    spots = np.flatnonzero(common | bare & (words % np.uint64(SPARE) == 0))
    after = np.concatenate(([0], np.searchsorted(content, spots, side="right")))
    anchor = np.concatenate((np.zeros(1, np.uint64), words[spots]))
    whole = after + CHAIN <= len(content)
    spots, after = anchor[whole], after[whole]
    if not len(spots):
        own = words
        if not len(own) and text.strip():
            own = next(iter(hashing.word_hashes([text])))
        if not len(own):
            own = np.frombuffer(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), np.uint64)
        own = hashing.mix(own + np.arange(len(own), dtype=np.uint64)).sum(keepdims=True, dtype=np.uint64)
        return (own >> np.uint64(32)).astype(np.uint32)
    h = spots
    for j in range(CHAIN):
        h = hashing.mix(h * hashing._STEP[0] + words[content[after + j]])
    return np.unique((h >> np.uint64(32)).astype(np.uint32))


def written(s: np.ndarray) -> str:
    return base64.b64encode(s.astype("<u4").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def length_class(n: int, least: float) -> int:
    """Partition of a set length: sets as alike as ``least`` are in the same or in neighbouring ones."""
    return int(np.floor(np.log(max(n, 1)) / -np.log(least) + 1e-9))


_STEP = 256


def likeness(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Jaccard similarity of two sorted sets, 1 for two empty ones; 0 if it is under ``least``, which lengths or a part may already show."""
    if len(a) > len(b):
        a, b = b, a
    if not len(b):
        return 1.0
    if not len(a) or abs(length_class(len(a), least) - length_class(len(b), least)) > 1 or len(a) < least * len(b):
        return 0.0
    both = 0
    for at in range(0, len(a), _STEP):
        part = a[at : at + _STEP]
        both += int(_member(part, b).sum())
        most = both + len(a) - at - len(part)
        if most < least * (len(a) + len(b) - most):
            return 0.0
    return both / (len(a) + len(b) - both)


def fingerprints(documents: DataFrame) -> DataFrame:
    """documents with n_spots and fingerprint, for their column text; null and empty texts have an empty one.

    Columns that documents have already are kept, and these are named with a
    leading underscore.
    """
    names = documents.columns
    spots, written_, s = free(names, "n_spots", "fingerprint", "_s")

    @F.pandas_udf("n long, f string")
    def spot(texts):
        import pandas as pd

        sets = [signature_set(t) for t in texts]
        return pd.DataFrame({"n": [len(x) for x in sets], "f": [written(x) for x in sets]})

    bounded_batches(documents.sparkSession)
    found = documents.withColumn(s, spot(F.col("text").cast("string")))
    return found.select(*[F.col(f"`{n}`") for n in names], F.col(f"{s}.n").alias(spots), F.col(f"{s}.f").alias(written_))


def _pairs(least: float):
    def links(group: Group) -> Iterator[tuple[int, int]]:
        sets = [np.frombuffer(x, "<u4") for x in group["spots"]]
        rest = np.arange(len(sets))
        while len(rest) > 1:
            front, rest = [int(rest[0])], rest[1:]
            while front and len(rest):
                i = front.pop()
                near = np.array([likeness(sets[i], sets[j], least) >= least for j in rest.tolist()])
                for j in rest[near].tolist():
                    yield i, j
                    front.append(j)
                rest = rest[~near]

    return links


def alike(documents: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, n_spots, component_id) of each row of documents (doc_id, text): groups of texts whose sets have a likeness of ``least``.

    component_id is the least doc_id that a row reaches over such pairs.  Equal
    sets are one class.  A class goes to its length partition and to the next,
    and there to each of its first signatures, of which two sets that alike
    share one; the members of each are compared by pruned Jaccard, in blocks
    if they are many.  Null and empty texts are alone.  Rows without doc_id
    have their group's least one, or null.  No rows give none.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = table(fingerprints(docs).drop("text"), "spots")
    classes = found.filter("n_spots > 0").groupBy("fingerprint").agg(F.min("n_spots").alias("n"), F.count("*").alias("rows"), F.min("doc_id").alias("least"))
    classes = table(classes.withColumns({"id": F.sha2("fingerprint", 256), "spots": F.unbase64("fingerprint")}), "spot_classes")

    def keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            key, index = [], []
            for i, data in enumerate(batch.column(1).to_pylist()):
                s = np.frombuffer(data, "<u4").astype(np.uint64)
                first = s[: len(s) - int(np.ceil(least * len(s) - 1e-9)) + 1]
                own = length_class(len(s), least)
                for partition in (own, own + 1):
                    key.append(hashing.mix(first << np.uint64(16) | np.uint64(partition)).view(np.int64))
                    index.append(np.full(len(first), i))
            take = pa.array(np.concatenate(index)) if index else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key) if key else np.empty(0, np.int64)), batch.column(0).take(take), batch.column(1).take(take)], ["key", "id", "spots"])

    members = classes.select("id", "spots").mapInArrow(tidy(keys), "key long, id string, spots binary")
    roots = components(compare_in_blocks(members, one_by_one(_pairs(least)), 1000, F.length("spots"), 4 * TEXT_BLOCK)).withColumnRenamed("node", "id")
    grouped = table(classes.select("id", "fingerprint", "rows", "least").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "spot_groups")
    low = grouped.groupBy("root").agg(F.count("*").alias("n"), F.min("least").alias("component_id"))
    fate = join_hot(grouped.select("root", "fingerprint", "rows"), low, "root", "n").select("fingerprint", "rows", "component_id")
    full = join_hot(found.filter("n_spots > 0"), fate, "fingerprint", "rows").select("doc_id", "n_spots", "component_id")
    return full.union(found.filter("n_spots = 0").select("doc_id", "n_spots", F.col("doc_id").alias("component_id")))


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


#: A likeness under this is told as 0.
LEAST = 0.01


def _row(doc: int | None, text: str, own: np.ndarray, following: str, theirs: np.ndarray, least: float) -> tuple:
    edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
    other = signature_set(edited)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc, len(text), digest, written(own), written(other), likeness(own, other, least), likeness(own, theirs, least)


#: Bytes of text of a part, and the most parts.
PART, PARTS = 16_000_000, 50_000


def against_next(documents: DataFrame, least: float = LEAST) -> DataFrame:
    """Each row's fingerprint against that of its edited text and of the next row, by descending doc_id.

    The edited text has the first code points of the next row's text in place
    of the last half of its own; the row after the last is the first.  Null
    texts are empty.  Rows of one doc_id follow by xxhash64 of their texts;
    rows without doc_id come last.  A lone row is next to itself.  An empty
    table gives none.  A likeness under ``least`` is 0.  Other columns are not
    read; very long texts are read whole.

    Rows are dealt to parts of about PART bytes by ranges of the order, and
    each part is read as a stream.  A copy of each part's first row follows
    the rows of the part before, so parts need not meet.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumns({"last": F.col("doc_id").isNull().cast("int"), "down": F.coalesce(F.bitwise_not("doc_id"), F.lit(0)), "h": F.xxhash64("text")})
    order = ["last", "down", "h"]
    keys = table(docs.select(*order, F.octet_length("text").cast("long").alias("size")), "order")
    rows, size = keys.agg(F.count("*"), F.sum("size")).first()
    parts = max(1, min(PARTS, -(-(size or 0) // PART), rows))
    some = sorted(tuple(r) for r in keys.select(*order).sample(fraction=min(1.0, 40 * parts / max(rows, 1)), seed=0).collect())  # about 40 a part
    bounds = sorted({some[i * len(some) // parts] for i in range(1, parts)}) if some else []

    @F.arrow_udf("int")
    def part_of(last: pa.Array, down: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array([bisect_right(bounds, key) for key in zip(last.to_pylist(), down.to_pylist(), h.to_pylist(), strict=True)], pa.int32())

    heads = sorted((r["part"], *r["first"]) for r in keys.withColumn("part", part_of(*order)).groupBy("part").agg(F.min(F.struct(*order)).alias("first")).collect())  # a row a part
    moved = [(heads[i - 1][0], *key) for i, (_, *key) in enumerate(heads)]
    ends = spark.createDataFrame(moved, "before int, last int, down long, h long")
    # A part's first row also goes to the part before, after all of its rows; repeats of that row go too and do no harm.
    placed = docs.withColumn("part", part_of(*order)).join(F.broadcast(ends), order, "left")
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("end"))
    copy = F.struct(F.col("before").alias("part"), F.lit(1).alias("end"))
    dealt = placed.select("doc_id", "text", *order, F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("at")).select("doc_id", "text", *order, "at.*")
    ranged = dealt.repartition(parts, "part").sortWithinPartitions("part", "end", *order).select("doc_id", "text", "end")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in it:
            out = []
            for doc, text, end in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if end and before is None:
                    continue  # a repeat of the row that closed the part
                own = signature_set(text)
                if before is not None:
                    out.append(_row(*before, text, own, least))
                before = None if end else (doc, text, own)
            names = [x.split()[0] for x in _OUT.split(", ")]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    return ranged.mapInArrow(tidy(run), _OUT)
