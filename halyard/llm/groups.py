"""Connected components, and comparison within buckets of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.shared import MOST_HOT, cut, drop, join_hot, table, tidy


class UnionFind:
    """Sets of the numbers below n; the smallest number stands for its set."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _state(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


#: So many links are joined up by one task, whose shuffles would cost more than they do.
FEW = 250_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of ``edges`` (hi, lo), by union-find in one task."""
    kind = edges.schema["hi"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple] = []
        types = pa.null()
        for batch in it:
            types = batch.schema.field(0).type
            links += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        nodes = sorted({x for link in links for x in link})
        at = {x: i for i, x in enumerate(nodes)}
        sets = UnionFind(len(nodes))
        for hi, lo in links:
            sets.union(at[hi], at[lo])
        for first in range(0, len(nodes), 20_000):
            part = range(first, min(first + 20_000, len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in part], types), pa.array([nodes[sets.find(i)] for i in part], types)], ["node", "root"])

    return edges.select("hi", "lo").coalesce(1).mapInArrow(tidy(run), f"node {kind}, root {kind}")


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the least node that it reaches.

    Distributed union-find: large-star and small-star steps in turn until
    nothing moves; every step is a shuffle by node, written to the shared
    folder, so that no large set of links ever meets in one place; up to
    ``few`` links are left to one task.  The links of a
    node with very many are joined where they are (join_hot).  Loops and
    repeated links are allowed; nulls are dropped; no links give no rows.
    """
    spark = edges.sparkSession
    e, at = cut(
        edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        "edges",
    )
    before = _state(e)
    if 0 < before[0] <= few:
        return table(_in_one_task(e), "star")
    while before[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_hot(both.filter("v > u"), least, "u", "n").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large, mid = cut(large, "large")
        least = table(large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n")), "per_key")
        small = join_hot(large, least, "hi", "n", written=True).filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.select("hi", F.col("m").alias("lo"))).distinct()
        small, new = cut(small, "small")
        drop(spark, mid)
        drop(spark, at)
        e, at = small, new
        now = _state(e)
        if now == before:
            break
        before = now
    star = e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return star.union(e.select("lo", "lo").distinct())


Group = dict[str, np.ndarray]


def _runs(it: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[Group]:
    """The groups of frames sorted by ``keys``, over the borders of batches, as arrays by column."""
    held: list[Group] = []
    last = None
    for pdf in it:
        if not len(pdf):
            continue
        batch = {c: pdf[c].to_numpy() for c in pdf.columns}
        change = np.zeros(len(pdf), bool)
        for k in keys:
            change[1:] |= batch[k][1:] != batch[k][:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), len(pdf)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = {c: v[a:b] for c, v in batch.items()}
            if a == 0:
                key = tuple(part[k][0] for k in keys)
                if held and key != last:
                    yield _join(held)
                    held = []
            elif held:
                yield _join(held)
                held = []
            held.append(part)
        last = tuple(batch[k][-1] for k in keys)
    if held:
        yield _join(held)


def _join(parts: list[Group]) -> Group:
    return parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def key_sizes(members: DataFrame, weight: Column | None = None) -> DataFrame:
    """(key, rows, weight) of the keys that occur more than once, counted where they are before they are shuffled; written."""
    sizes = members.groupBy("key").agg(F.count("*").alias("rows"), (F.sum(weight) if weight is not None else F.lit(0)).cast("long").alias("weight"))
    return table(sizes.filter("rows > 1"), "keys")


#: Characters of text that a block holds: a task compares two, as arrays several times as large.
TEXT_BLOCK = 2_000_000

Links = Callable[[Iterator[Group]], Iterator[tuple[Group, int, int]]]


def one_by_one(links: Callable[[Group], Iterator[tuple[int, int]]]) -> Links:
    """Links of groups that are looked at one after another; ``links`` returns positions of rows."""

    def run(groups: Iterator[Group]) -> Iterator[tuple[Group, int, int]]:
        for group in groups:
            for i, j in links(group):
                yield group, i, j

    return run


def compare_in_blocks(members: DataFrame, links: Links, block: int, weight: Column | None = None, most: int = 1, sizes: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that ``links`` finds among the members (key, id, ...) of each key, as a forest.

    A key of up to ``block`` members and ``most`` weight is one group, met by
    a shuffle on the key.  A larger one is never shuffled by its key: its rows
    are told so by a broadcast (such keys are few, at most rows / block; their
    number is checked), are dealt by a hash of the id into blocks, and every
    pair of blocks is a group, so no task holds more than two blocks.  All
    pairs are looked at, none is dropped.  ``links`` gets the rows of a group
    and returns pairs of row positions that connect what belongs together.
    ``sizes`` are the key_sizes of members, where the caller has them.
    """
    sizes = key_sizes(members, weight) if sizes is None else sizes
    blocks = F.greatest(F.ceil(F.col("rows") / block), F.ceil(F.col("weight") / most) if weight is not None else F.lit(1), F.lit(1)).cast("int")
    hot = sizes.select("key", blocks.alias("_b")).filter("_b > 1")
    n_hot = hot.limit(MOST_HOT + 1).count()
    cold = members
    if n_hot:
        cold = members.join(F.broadcast(hot.select("key")) if n_hot <= MOST_HOT else hot.select("key"), "key", "left_anti")
    # The window asks for all rows of a key in one task, which a skew join would not.
    cold = cold.withColumn("_c", F.count("*").over(Window.partitionBy("key"))).filter("_c > 1").drop("_c").withColumns({"_x": F.lit(0), "_y": F.lit(0)})
    sorted_ = cold.sortWithinPartitions("key")
    if n_hot:
        rows = members.join(F.broadcast(hot) if n_hot <= MOST_HOT else hot, "key").withColumn("_i", F.pmod(F.xxhash64("id"), F.col("_b")).cast("int"))
        dealt = rows.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
        dealt = dealt.withColumn("_x", F.least("_i", "_j")).withColumn("_y", F.greatest("_i", "_j")).drop("_i", "_j", "_b")
        sorted_ = sorted_.unionByName(dealt.repartition("key", "_x", "_y").sortWithinPartitions("key", "_x", "_y"))
    id_type = members.schema["id"].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for group, i, j in links(g for g in _runs(it, ["key", "_x", "_y"]) if len(g["id"]) > 1):
            out.append((group["id"][i], group["id"][j]))
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        yield pd.DataFrame(out, columns=["a", "b"])

    return sorted_.mapInPandas(tidy(run), f"a {id_type}, b {id_type}")
