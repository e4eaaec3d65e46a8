"""Benchmark passages in documents, by Wu-Manber multi-pattern search over words.

The patterns are the benchmark's windows of consecutive words.  For each
window length there is a shift table over blocks of two words: a block that no
window holds lets the search skip to where a window could first begin; a block
that ends windows has shift 0 and selects, by hash, the windows to compare
directly.  Texts are searched whole, long ones in pieces that overlap by one
window less a word.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm.shared import bounded_batches, free, table

#: A-Z are lower-cased; of ASCII only digits and letters belong to words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_PIECE = 1 << 22

Window = tuple[bytes, ...]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def windows_of(words: list[bytes], size: int) -> Iterator[Window]:
    """Every window of ``size`` words; all words if there are fewer; none of none."""
    if words:
        for i in range(max(1, len(words) - size + 1)):
            yield tuple(words[i : i + size])


class WuManber:
    """Search for windows, each standing for a set of items."""

    def __init__(self, windows: dict[Window, set[str]]):
        self.single = {w[0]: items for w, items in windows.items() if len(w) == 1}
        self.tables: list[tuple[int, dict, dict]] = []
        by_length: dict[int, list[Window]] = defaultdict(list)
        for w in windows:
            by_length[len(w)].append(w)
        for size, group in sorted(by_length.items()):
            if size == 1:
                continue
            shift: dict[Window, int] = {}
            bucket: dict[Window, dict[Window, set[str]]] = defaultdict(dict)
            for w in group:
                for end in range(2, size + 1):
                    block = w[end - 2 : end]
                    shift[block] = min(shift.get(block, size - 1), size - end)
                bucket[w[-2:]][w] = windows[w]
            self.tables.append((size, shift, dict(bucket)))

    def search(self, words: list[bytes], spans: list[tuple[int, int]], items: set[str], base: int = 0, fresh: int = 0) -> None:
        """Add what ends at or after position ``fresh``; positions count from ``base``."""
        if self.single:
            for i in range(fresh, len(words)):
                if words[i] in self.single:
                    spans.append((base + i, base + i + 1))
                    items |= self.single[words[i]]
        n = len(words)
        for size, shift, bucket in self.tables:
            skip = shift.get
            i = max(size - 1, fresh)
            while i < n:
                block = (words[i - 1], words[i])
                step = skip(block, size - 1)
                if step:
                    i += step
                    continue
                found = bucket[block].get(tuple(words[i - size + 1 : i + 1]))
                if found is not None:
                    spans.append((base + i - size + 1, base + i + 1))
                    items |= found
                i += 1

    def text(self, text: str | None, overlap: int) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, spans of words and items found in a whole text."""
        data = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS)
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        kept: list[bytes] = []
        at = seen = 0
        while at < len(data):
            end = data.find(b" ", at + _PIECE) if len(data) - at > _PIECE else -1
            end = len(data) if end < 0 else end
            words = kept + data[at:end].split()
            self.search(words, spans, items, seen - len(kept), len(kept))
            seen += len(words) - len(kept)
            kept = words[-overlap:] if overlap else []
            at = end
        return seen, spans, items


def covered(spans: list[tuple[int, int]]) -> int:
    """Positions in at least one span."""
    total = end = 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _items(benchmark: DataFrame, most: int) -> list[DataFrame]:
    """The items in parts of about ``most`` characters at most: what is sent out is bounded, however many there are."""
    b = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    size = b.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    parts = -(-size // most) or 1
    return [b.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p) for p in range(parts)]


def _windows(items: DataFrame, size: int) -> dict[Window, set[str]]:
    out: dict[Window, set[str]] = defaultdict(set)
    for item, text in items.toLocalIterator():
        for w in windows_of(words_of(text), size):
            out[w].add(item)
    return dict(out)


_FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
_SCHEMA = "n_words long, spans array<long>, items array<string>"


def _finder(items: DataFrame, size: int) -> Callable[[Column], Column]:
    """A column function text -> (n_words, spans, items) for one part of the items; a span is begin * 2**32 + end, in word positions."""
    sent = items.sparkSession.sparkContext.broadcast(_windows(items, size))

    @F.arrow_udf(_SCHEMA)
    def find(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        engine = WuManber(sent.value)
        for texts in it:
            out = []
            for t in texts.to_pylist():
                n, spans, found = engine.text(t, size - 1)
                out.append({"n_words": n, "spans": [(a << 32) + b for a, b in sorted(spans)], "items": sorted(found)})
            yield pa.array(out, _FOUND)

    return find


def find_passages(documents: DataFrame, benchmark: DataFrame, size: int = 8, most: int = 32_000_000, found: str = "found") -> DataFrame:
    """documents (doc_id, text) with ``found`` (n_words, spans, items): the passages of benchmark (item_id, text) in each.

    Spans are sorted longs begin * 2**32 + end over word positions, items the
    distinct item ids as sorted strings.  Null and empty texts have no words;
    an item with fewer words than ``size`` is one window; an item without id,
    text or words is in no document.  Repeated rows are each searched, repeated
    items are one; no rows give none.  Further columns of documents stay as
    they are, those of benchmark are not read; a table that has a column
    ``found`` is refused.

    A benchmark of at most ``most`` characters is sent to the tasks.  A larger
    one is searched part by part, a pass over the texts for each: a task holds
    one part, and what was found is written and joined.
    """
    if found.lower() in map(str.lower, documents.columns):
        raise ValueError(f"documents have a column {found}; name another for the passages")
    bounded_batches(documents.sparkSession)
    text = F.col("text").cast("string")
    parts = _items(benchmark, most)
    if len(parts) == 1:
        return documents.withColumn(found, _finder(parts[0], size)(text))
    one, two, made = free(documents.columns, "_one", "_two", "_made")
    keyed = documents.withColumns({one: F.xxhash64(text), two: F.xxhash64(F.lit("2"), text)})
    texts = keyed.filter("text is not null").select(one, two, text.alias("text")).dropDuplicates([one, two])
    hits = []
    for part in parts:
        got = texts.select(one, two, _finder(part, size)("text").alias(made)).select(one, two, f"{made}.*")
        hits.append(table(got, "passages"))
    each = functools.reduce(DataFrame.unionByName, hits)
    lists = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("spans", "items")]
    whole = each.groupBy(one, two).agg(F.max("n_words").alias("n_words"), *lists).select(one, two, F.struct("n_words", "spans", "items").alias(made))
    none = F.struct(F.lit(0).cast("long").alias("n_words"), F.array().cast("array<bigint>").alias("spans"), F.array().cast("array<string>").alias("items"))
    return keyed.join(whole, [one, two], "left").select(*[F.col(f"`{c}`") for c in documents.columns], F.coalesce(made, none).alias(found))


def _covered(spans: Column) -> Column:
    """Positions in at least one of the spans."""
    zero = F.lit(0).cast("long")
    begin, end = lambda s: F.shiftright(s, 32), lambda s: s.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(
        spans,
        F.struct(zero.alias("n"), zero.alias("end")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(zero, end(s) - F.greatest(begin(s), acc["end"]))).alias("n"), F.greatest(acc["end"], end(s)).alias("end")),
        lambda acc: acc["n"],
    )


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = 8, least: int = 2, most: int = 32_000_000) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated); ``least`` items make a document contaminated.

    See find_passages for nulls, ties, repeated rows and empty tables.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = find_passages(docs, benchmark, size, most)
    n_items = F.size("found.items").cast("long")
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        _covered(F.col("found.spans")).alias("n_hit"),
        n_items.alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (n_items >= least).alias("contaminated"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, size: int = 8, least: int = 2) -> DataFrame:
    """The rows of documents, with their columns, that hold fewer than ``least`` items.  Nulls, ties and empty tables as in find_passages."""
    (found,) = free(documents.columns, "found")
    return find_passages(documents, benchmark, size, found=found).filter(F.size(f"{found}.items") < least).drop(found)
