"""Cross-entropy difference of documents under a target and a background model.

Both are interpolated bigram models over one vocabulary, so their per-token
losses differ by what they were trained on alone.  The background is the whole
corpus, the target the documents labelled as good.  A document's own bigrams
are left out of the counts that score it, so a text is never its own evidence;
a bigram that occurs once in the corpus is therefore none for anybody.

Counts are over all documents: each task adds up its own, one shuffle adds up
those.  Every bigram that occurs twice is in the inventory, a table that grows
with the corpus.  Its most frequent rows are sent to the tasks, where they
serve most tokens; the others meet the documents' bigrams in a shuffle.  Sums
of losses are what is added up, so both ways give the same scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm import hashing
from halyard.llm.shared import KeyFilter, bounded_batches, table, tidy

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BATCH = 2_000_000
#: Rows that a task hands on at a time.
_ROWS = 200_000
_START = np.array([1], np.uint64)
#: Words with a smaller share of all tokens are one unknown word: at most 1 / SHARE words have a number, in a corpus of any size.
SHARE = 5e-6


def _words(texts: list[str | None]) -> Iterator[np.ndarray]:
    return hashing.word_hashes([(t or "").encode("utf-8", "surrogatepass").translate(_TABLE).decode("utf-8", "surrogatepass") for t in texts])


class Vocabulary:
    """Numbers of words; len(self) stands for any other word, len(self) + 1 for a text's beginning."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.width = len(hashes) + 2

    def __len__(self) -> int:
        return len(self.hashes)

    def ids(self, words: np.ndarray) -> np.ndarray:
        if not len(self):
            return np.zeros(len(words), np.int64)
        at = np.searchsorted(self.hashes, words)
        at[at == len(self)] = 0
        return np.where(self.hashes[at] == words, at, len(self)).astype(np.int64)

    def contexts(self, ids: np.ndarray) -> np.ndarray:
        """What stands before each word."""
        return np.concatenate(([len(self) + 1], ids[:-1])) if len(ids) else ids


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each occurs; the array is sorted where it is."""
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(first, append=len(keys)).astype(np.int64)


def _tallied(docs: DataFrame, make, names: tuple[str, str, str]) -> DataFrame:
    """(key, n, n1): occurrences of the keys that ``make`` finds in texts (text, target), of all and of target texts."""
    schema = ", ".join(f"{x} long" for x in names)

    def add_up(keys: list[np.ndarray], marks: list[int]) -> pa.RecordBatch:
        marked = [k for k, mark in zip(keys, marks, strict=True) if mark]
        key, n = _counted(np.concatenate(keys))
        n1 = np.zeros(len(key), np.int64)
        if marked:
            there, times = _counted(np.concatenate(marked))
            n1[np.searchsorted(key, there)] = times
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n), pa.array(n1)], list(names))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = make()
        keys: list[np.ndarray] = []
        marks: list[int] = []
        size = 0
        for batch in it:
            for words, mark in zip(_words(batch.column(0).to_pylist()), batch.column(1).to_pylist(), strict=True):
                keys.append(find(words))
                marks.append(mark)
                size += len(words)
                if size > _BATCH:
                    yield add_up(keys, marks)
                    keys, marks, size = [], [], 0
        if size:
            yield add_up(keys, marks)

    counted = docs.select("text", "target").mapInArrow(tidy(run), schema)
    return counted.groupBy(names[0]).agg(*[F.sum(c).alias(c) for c in names[1:]])


class Unigrams:
    """Occurrences of each number of a vocabulary in all and in target texts, the texts' beginnings last."""

    def __init__(self, vocab: Vocabulary, counts: np.ndarray, strength: float):
        self.vocab, self.counts = vocab, counts
        words = counts[:, :-1]
        #: strength * p(word), add-one smoothed; beginnings follow nothing.
        self.prior = strength * (words + 1.0) / (words.sum(axis=1, keepdims=True) + words.shape[1])
        self.strength = strength


def unigrams(marked: DataFrame, share: float, strength: float) -> Unigrams:
    """Words with at least ``share`` of all tokens, at most 1 / share of them; the others count together."""
    # A text with words also counts its beginning.
    counts = table(_tallied(marked, lambda: lambda words: np.concatenate((_START, words)) if len(words) else words, ("h", "n", "n1")), "words")
    start = int(_START[0])
    sums = lambda rows: [int(x or 0) for x in rows.agg(F.sum("n"), F.sum("n1")).first()]
    starts, totals = sums(counts.filter(F.col("h") == start)), sums(counts.filter(F.col("h") != start))
    kept = counts.filter((F.col("n") >= share * totals[0]) & (F.col("h") != start)).toArrow()
    hashes = kept["h"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    rows = []
    for column, total, begun in zip(("n", "n1"), totals, starts, strict=True):
        c = kept[column].to_numpy()[order].astype(float)
        rows.append(np.concatenate((c, [total - c.sum(), begun])))
    return Unigrams(Vocabulary(hashes[order]), np.array(rows), strength)


def _sent_from(inventory: DataFrame, most: int) -> int:
    """The least n that leaves at most ``most`` rows at or above it, by the numbers of rows with each n."""
    level = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.lit(1024) + F.floor(F.log2(F.col("n") / 1024) * 8).cast("long"))
    least, kept = None, 0
    for row in inventory.groupBy(level.alias("level")).agg(F.count("*").alias("rows"), F.min("n").alias("n")).orderBy(F.desc("level")).collect():  # some 1,400 at most
        kept += row["rows"]
        if kept > most:
            break
        least = row["n"]
    return 2**62 if least is None else least


def _marked(docs: DataFrame, good: DataFrame, most: int = 2_000_000) -> DataFrame:
    """docs with ``target``, 1 for the ids in ``good``: all of those are sent if there are ``most`` at most, else joined."""
    if good.count() > most:
        return docs.join(good.withColumn("target", F.lit(1)), "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(0)))
    ids = docs.sparkSession.sparkContext.broadcast(np.sort(good.toArrow()["doc_id"].to_numpy().astype(np.int64)))

    @F.arrow_udf("int")
    def held(doc_id: pa.Array) -> pa.Array:
        there = np.isin(doc_id.to_numpy(zero_copy_only=False), ids.value)
        return pa.array(there.astype(np.int32))

    return docs.withColumn("target", F.when(F.col("doc_id").isNull(), 0).otherwise(held(F.coalesce("doc_id", F.lit(0).cast("long")))))


_ROW = "row long, doc_id long, target int, pair long, m int, n_tokens long, target_bits double, background_bits double"


def score_documents(documents: DataFrame, labels: DataFrame, share: float = SHARE, most: int = 1_000_000, strength: float = 50.0) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, difference) of each row of documents (doc_id, text).

    Losses are bits a token; a lower difference, target less background, means
    more like the documents whose label quality (doc_id, quality) is 1, and a
    high one a text that the corpus holds elsewhere too.  Words are runs of
    letters, digits and other characters beyond ASCII.  With c the occurrences
    in the texts of a model, those of the document itself left out for pairs
    and contexts, a word w after h costs -log2((c(h, w) + strength * p(w)) /
    (c(h) + strength)), where p(w) is add-one smoothed over the vocabulary.
    At most ``most`` pairs are sent to the tasks; the others are joined.

    Null texts and texts without words have no tokens and null losses.
    Repeated rows count as often as they occur, and score alike; repeated
    labels count once.  Without target rows the target is uniform.  An empty
    table gives no rows.  Texts of any length are read whole.  Other columns
    are not read.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    marked = _marked(docs.withColumn("row", F.xxhash64("doc_id", "text")), good)
    one = unigrams(marked, share, strength)
    context = spark.sparkContext
    sent_words = context.broadcast(one)

    def pairs():
        vocab = sent_words.value.vocab

        def find(words: np.ndarray) -> np.ndarray:
            ids = vocab.ids(words)
            return vocab.contexts(ids) * vocab.width + ids

        return find

    inventory = table(_tallied(marked, pairs, ("pair", "n", "n1")).filter("n > 1"), "bigrams")
    least = _sent_from(inventory, most)
    kept = inventory.filter(F.col("n") >= least).toArrow()  # Arrow, since as many rows as objects would not fit beside the driver
    order = np.argsort(kept["pair"].to_numpy())
    sent = context.broadcast(tuple(kept[c].to_numpy()[order] for c in ("pair", "n", "n1")))
    rest = inventory.filter(F.col("n") < least)
    sieve = KeyFilter(rest, "pair", 1 << 26)

    def told(batch: pa.RecordBatch, held: list[list[np.ndarray]]) -> pa.RecordBatch:
        index, pair, m, size, target, background = (np.concatenate(x) for x in zip(*held, strict=True))
        take, first = pa.array(index), pair < 0
        own = [pa.array(x, mask=~first) for x in (size.astype(np.int64), target, background)]
        return pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(3)), pa.array(pair), pa.array(m.astype(np.int32)), *own], [x.split()[0] for x in _ROW.split(", ")])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (often, n, n1) = sent_words.value, sent.value
        for batch in it:
            held: list[list[np.ndarray]] = []
            ready = 0
            rows = batch.column(0).to_numpy()
            for index, w in enumerate(_words(batch.column(3).to_pylist())):
                ids = words.vocab.ids(w)
                before = words.vocab.contexts(ids)
                pair, m = np.unique(before * words.vocab.width + ids, return_counts=True)
                mark = batch.column(2)[index].as_py()
                h, own = np.unique(before, return_counts=True)
                # Each token's context; the prior of each word; and what the pairs that were sent add.
                bits = [float((own * np.log2(c[h] - own * left + words.strength)).sum() - np.log2(p[ids]).sum()) for c, p, left in zip(words.counts, words.prior, (1, mark), strict=True)]
                at = np.searchsorted(often, pair)
                at[at == len(often)] = 0
                hit = often[at] == pair if len(often) else np.zeros(len(pair), bool)
                found, times, second = at[hit], m[hit], pair[hit] % words.vocab.width
                for k, (count, left) in enumerate(((n, 1), (n1, mark))):
                    bits[k] -= float((times * np.log2(1 + (count[found] - times * left) / words.prior[k][second])).sum())
                missed = np.flatnonzero(~hit)
                missed = missed[sieve.may_hold(pair[missed])]
                size = len(missed) + 1
                nothing = np.zeros(size - 1)
                # The first row is the document's own; its key is no pair, and another for each document.
                own_key = rows[index : index + 1] | np.int64(-(2**63))
                mine = ((own_key, pair[missed]), ([0], m[missed]), ([len(w)], nothing), ([bits[1]], nothing), ([bits[0]], nothing))
                held.append([np.full(size, index), *map(np.concatenate, mine)])
                ready += size
                if ready > _ROWS:
                    yield told(batch, held)
                    held, ready = [], 0
            if held:
                yield told(batch, held)

    scored = marked.select("row", "doc_id", "target", "text").mapInArrow(tidy(run), _ROW)
    number = one.vocab.width
    priors = spark.createDataFrame(pa.table({"w": pa.array(np.arange(number - 1)), "prior": one.prior[0], "prior1": one.prior[1]}))
    rest = rest.withColumn("w", F.col("pair") % number).join(F.broadcast(priors), "w").drop("w")
    met = scored.join(rest, "pair", "left")
    gain = lambda n, left, prior: F.coalesce(F.col("m") * F.log2(1 + (F.col(n) - F.col("m") * left) / F.col(prior)), F.lit(0.0))
    t = F.coalesce("target_bits", F.lit(0.0)) - gain("n1", F.col("target"), "prior1")
    b = F.coalesce("background_bits", F.lit(0.0)) - gain("n", F.lit(1), "prior")
    met = met.select("row", "doc_id", "n_tokens", t.alias("t"), b.alias("b"))
    # Rows that repeat have one sum; as many come out as went in.
    sums = met.groupBy("row", "doc_id").agg(F.count("n_tokens").alias("copies"), F.max("n_tokens").alias("n_tokens"), F.sum("t").alias("t"), F.sum("b").alias("b"))
    tokens = F.nullif(F.col("n_tokens") * F.col("copies"), F.lit(0).cast("long"))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    out = sums.select("doc_id", "n_tokens", (F.col("t") / tokens).alias("target_loss"), (F.col("b") / tokens).alias("background_loss"), copy)
    return out.select("doc_id", "n_tokens", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("difference"))
