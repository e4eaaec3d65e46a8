"""Packing of tokenised documents into sequences: first-fit decreasing with a tournament tree.

A document's ids are cut at multiples of the sequence length; whole cuts fill
sequences of their own and the rest of each document is packed, longest first,
into the first sequence of its group with room.  The tree holds the largest
room among the sequences below each node, so first fit takes a walk from the
root.  Groups are random and of about the same number of documents, so one
task holds only the lengths of a few thousand documents, however skewed the
keys.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.shared import bounded_batches, map_texts, table
from halyard.llm.tokens import tokenizer


class Tournament:
    """Bins with room, by first fit."""

    def __init__(self, bins: int, size: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.most = [size] * (2 * self.leaves)

    def place(self, need: int) -> int:
        """The first bin with room for ``need``, whose room shrinks."""
        most, i = self.most, 1
        while i < self.leaves:
            i *= 2
            if most[i] < need:
                i += 1
        most[i] -= need
        found = i - self.leaves
        while i > 1:
            i //= 2
            most[i] = max(most[2 * i], most[2 * i + 1])
        return found


def first_fit_decreasing(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length, none above ``size``; ties go by position."""
    tree = Tournament(max(1, len(lengths)), size)
    out = [(0, 0)] * len(lengths)
    used: dict[int, int] = {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = tree.place(lengths[i])
        out[i] = (b, used.get(b, 0))
        used[b] = out[i][1] + lengths[i]
    return out


def tokenised(documents: DataFrame, path: str, end_id: int, size: int) -> DataFrame:
    """(doc_id, doc_tokens, crcs): the number of ids with the end id, and the crc32 of each cut."""

    def make(texts: list[str | None]) -> list[pa.Array]:
        tok, last = tokenizer(path), int(end_id).to_bytes(4, "little")
        n, crcs = [], []
        for text in texts:
            ids = tok.ids(text) + last
            n.append(len(ids) // 4)
            crcs.append([zlib.crc32(ids[i : i + 4 * size]) for i in range(0, len(ids), 4 * size)])
        return [pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))]

    bounded_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(docs, ["doc_id"], make, "doc_tokens long, crcs array<long>")


def pack(documents: DataFrame, path: str, size: int = 2048, end_id: int = 1, group: int = 4096, seed: int = 0) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents (doc_id, text).

    ``path`` names the tokenizer's file.  Null and empty texts have the end id
    alone.  Repeated rows, also of one doc_id, are each packed; a null doc_id
    stays null.  Ties go by the order within a group.  Texts of any length are
    tokenised whole.  An empty table gives no
    pieces.  Sequence ids are distinct over all groups.  Other columns are not
    read.
    """
    lengths = tokenised(documents, path, end_id, size)
    # Written before it is grouped: a task that runs again then draws nothing anew.
    lengths = table(lengths.withColumn("draw", F.xxhash64(F.monotonically_increasing_id(), F.lit(seed))), "tokenised")
    groups = max(1, -(-lengths.count() // group))

    def fill(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows["draw"].to_numpy(), kind="stable")))
        tokens = rows["doc_tokens"].to_numpy()
        rest = tokens % size
        packed = np.flatnonzero(rest)
        places = first_fit_decreasing(rest[packed].tolist(), size)
        bins = 1 + max((b for b, _ in places), default=-1)
        place = dict(zip(packed.tolist(), places, strict=True))
        out: list[tuple] = []
        for i, (n, crcs) in enumerate(zip(tokens.tolist(), rows["crcs"].to_pylist(), strict=True)):
            for j, crc in enumerate(crcs):
                start = j * size
                length = min(size, n - start)
                if length == size:
                    seq, offset, bins = bins, 0, bins + 1
                else:
                    seq, offset = place[i]
                out.append((i, start, length, crc, n, seq, offset))
        index, *columns = (np.array(c, np.int64) for c in zip(*out, strict=True))
        columns[4] += rows["bin_group"][0].as_py() << 40
        return pa.table([rows["doc_id"].take(pa.array(index)), *columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    dealt = lengths.withColumn("bin_group", F.pmod("draw", F.lit(groups)))
    return dealt.groupBy("bin_group").applyInArrow(fill, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
