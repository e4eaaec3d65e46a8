"""Document quality by co-training a text view and a metadata view.

Each view is a naive Bayes model over binned features.  In every round a view
is fitted to the labelled rows and to the rows that the other view is sure of,
by one aggregation of bin counts over all rows; the two then hand each other
new pseudo-labels.  Counts are all that leaves the executors: their number is
bounded by the number of bins.  At the end a logistic model on the labelled
rows calibrates the two views' log odds and combines them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm import hashing
from halyard.llm.fit import LABELLED, labelled_sample, logistic, sigmoid
from halyard.llm.shared import KeyFilter, bounded_batches, free, settled, table, tidy

BINS = 16
#: Function words of English, German, French and Spanish: running prose holds many.
FUNCTION_WORDS = frozenset(
    w.encode()
    for w in (
        "the of and to in a is that it for on was as with be by are this at an der die das und zu den von mit ein im nicht ist sich auf für "
        "la le les des et un une dans que qui pour par sur el los las en y se del con no por su al de"
    ).split()
)
TEXT_VIEW = 14
META_VIEW = 3
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_KIND = np.full(256, 3, np.uint8)  # 0 letter, 1 digit, 2 space, 3 other, 4 upper case
_KIND[[*range(97, 123), *range(128, 256)]] = 0
_KIND[65:91] = 4
_KIND[48:58] = 1
_KIND[[32, *range(9, 14)]] = 2


def _share(x: float, n: float) -> int:
    """Bin of a share: 0 for none, then by factors of two up to all."""
    if x <= 0 or n <= 0:
        return 0
    return max(1, BINS - 1 - min(BINS - 2, int(-2 * math.log2(min(1.0, x / n)))))


def _size(x: float) -> int:
    return min(BINS - 1, int(math.log2(x + 1) * 0.9))


def text_view(text: str | None) -> list[int]:
    """Bins of what the text itself looks like; all of it is read."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data.strip():
        return [0] * TEXT_VIEW
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=5)
    words = data.translate(hashing.LOWER).split()
    count = Counter(words)
    n, lines = len(words), [x for x in data.split(b"\n") if x.strip()]
    total = len(data)
    bare = sum(c for w, c in count.items() if not _LETTER[w[0]] or not _LETTER[w[-1]])
    odd = data.count(b"$") + data.count(b"%") + data.count(b"#") + data.count(b"&") + data.count(b"*") + data.count(b"|") + data.count(b"!")
    stops = sum(count[w] for w in FUNCTION_WORDS if w in count)
    ends = sum(data.count(c) for c in (b". ", b".\n", b"? ", b", "))
    repeats = sum(c - 1 for c in Counter(zip(words, words[1:], words[2:], strict=False)).values()) if n > 2 else 0
    return [
        _share(kinds[4], total),
        _share(kinds[1], total),
        _share(kinds[3], total),
        _share(odd, n),
        _share(bare, n),
        _share(stops, n),
        _share(len(count), n),
        _share(max(count.values()), n),
        _share(repeats, n),
        _share(ends, n),
        _share(len(set(lines)), len(lines)),
        min(BINS - 1, int(total / max(1, n))),
        _share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n),
        _share(sum(c for w, c in count.items() if len(w) > 14), n),
    ]


def meta_view(lang: str | None, source: str | None, n_chars: float | None) -> list[int]:
    """Bins of what is known of the page without reading it: language, source and size."""
    code = lambda s: int(hashing.mix(np.array([sum((i + 1) * b for i, b in enumerate((s or "").encode()))], np.uint64))[0] % BINS)
    size = 0 if n_chars is None or n_chars != n_chars else max(0.0, float(n_chars))
    return [code(lang), code(source), _size(size)]


def _codes(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns with bins: the codes of both views, the text's first."""
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), "bins array<int>"])
    read = ["text", "lang", "source", "n_chars"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            columns = [batch.column(len(keep) + i).to_pylist() for i in range(len(read))]
            bins = [text_view(t) + meta_view(*rest) for t, *rest in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(bins, pa.list_(pa.int32()))], [*keep, "bins"])

    return rows.select(*keep, *read).mapInArrow(tidy(run), schema)


@dataclass(frozen=True)
class Quality:
    """Log odds of each bin of each feature, and the weights that combine the views."""

    odds: np.ndarray
    prior: float
    weights: np.ndarray

    def views(self, bins: np.ndarray) -> np.ndarray:
        at = self.odds[np.arange(TEXT_VIEW + META_VIEW)[None, :], bins]
        return np.column_stack([at[:, :TEXT_VIEW].sum(1), at[:, TEXT_VIEW:].sum(1)])

    def probability(self, bins: np.ndarray) -> np.ndarray:
        return sigmoid(self.views(bins) @ self.weights[:-1] + self.weights[-1])


def _matrix(bins: pd.Series) -> np.ndarray:
    return np.array(bins.tolist(), int).reshape(len(bins), TEXT_VIEW + META_VIEW)


_READ = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "double"}


def _keys() -> list[Column]:
    """Two hashes that tell rows apart by all that the views read."""
    read = [F.col(c) for c in _READ]
    return [F.xxhash64(*read), F.xxhash64(F.lit("2"), *reversed(read))]


def _inputs(documents: DataFrame) -> DataFrame:
    """doc_id, text, lang, source, n_chars and the row's keys; what a table lacks is null."""
    rows = documents.select(*[(F.col(c) if c in documents.columns else F.lit(None)).cast(t).alias(c) for c, t in _READ.items()])
    one, two = _keys()
    return rows.withColumns({"row": one, "row2": two})


def train(documents: DataFrame, labels: DataFrame, rounds: int = 3, sure: float = 0.98, most: int = LABELLED) -> tuple[Quality, DataFrame]:
    """The model, and (doc_id, row, row2, bins) of all documents.

    At most ``most`` labelled rows (doc_id, quality) are read; pseudo-labels
    come from all rows.  A view hands over the rows whose posterior of either
    class is at least ``sure``; together they weigh as much as the labelled
    rows of that class at most.
    """
    bounded_batches(documents.sparkSession)
    rows = _inputs(documents)
    chosen = labelled_sample(labels, "quality", most)
    coded = table(_codes(rows.join(F.broadcast(chosen), "doc_id", "left"), ["doc_id", "label", "row", "row2"]), "bins")
    # An id may stand over several rows: the first ones in an order of their own are read, so a fit does not depend on how rows are dealt.
    known = coded.filter("label is not null").select("bins", "label", "row", "row2").orderBy("row", "row2").limit(4 * most).toPandas()
    x, y = _matrix(known["bins"]), known["label"].to_numpy(float)
    n = TEXT_VIEW + META_VIEW
    at = np.arange(n)
    labelled = np.zeros((2, n, BINS))
    for c in (0, 1):
        for row in x[y == c]:
            labelled[c, at, row] += 1
    share = (y.sum() + 1) / (len(y) + 2)
    prior = math.log(share / (1 - share))
    text, meta = slice(0, TEXT_VIEW), slice(TEXT_VIEW, n)
    extra = np.zeros((2, n, BINS))
    odds = np.zeros((n, BINS))
    for r in range(rounds + 1):
        for view in (text, meta):
            c = labelled[:, view] + extra[:, view] + 0.5
            p = c / c.sum(axis=2, keepdims=True)
            odds[view] = np.log(p[1]) - np.log(p[0])
        if r < rounds and len(y):
            extra = _handed_over(coded, Quality(odds.copy(), prior, np.array([1.0, 1.0, 0.0])), sure, labelled)
    model = Quality(odds, prior, np.zeros(3))
    return Quality(odds, prior, logistic(model.views(x), y, ridge=0.01)), coded


def _handed_over(coded: DataFrame, model: Quality, sure: float, labelled: np.ndarray) -> np.ndarray:
    """Counts of bins that each view gains from the unlabelled rows that the other is sure of."""
    n, edge = TEXT_VIEW + META_VIEW, math.log(sure / (1 - sure))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = np.zeros((2, n, BINS), np.int64)
        for pdf in it:
            x = _matrix(pdf["bins"])
            z = model.views(x) + model.prior
            for view, other in ((slice(0, TEXT_VIEW), 1), (slice(TEXT_VIEW, n), 0)):
                for c, picked in ((0, z[:, other] <= -edge), (1, z[:, other] >= edge)):
                    for f in range(view.start, view.stop):
                        got[c, f] += np.bincount(x[picked, f], minlength=BINS)
        at = np.argwhere(got)
        yield pd.DataFrame({"label": at[:, 0], "feature": at[:, 1], "bin": at[:, 2], "n": got[tuple(at.T)]})

    counts = coded.filter("label is null").select("bins").mapInPandas(run, "label int, feature int, bin int, n long")
    out = np.zeros((2, n, BINS))
    for row in counts.groupBy("label", "feature", "bin").agg(F.sum("n").alias("n")).collect():  # 2 * features * bins at most
        out[row["label"], row["feature"], row["bin"]] = row["n"]
    own, other = labelled.sum(axis=2, keepdims=True), out.sum(axis=2, keepdims=True)
    return out * np.minimum(1, own / np.maximum(other, 1))


def score_quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """(doc_id, text_odds, meta_odds, score, good) of each row of documents (doc_id, text, lang, source, n_chars).

    score is the probability of quality 1, good is 1 from ``threshold`` on.
    Nulls in any column, and columns that a table lacks, have bins of their
    own; empty and blank texts share one.  Repeated rows and ties score alike;
    without labels every score is 0.5; an empty table gives no rows; texts of
    any length are read whole.  Other columns are not read.
    """
    model, coded = train(documents, labels, **how)

    @F.pandas_udf("text_odds double, meta_odds double, score double")
    def score(bins: pd.Series) -> pd.DataFrame:
        x = _matrix(bins)
        z = model.views(x)
        return pd.DataFrame({"text_odds": z[:, 0], "meta_odds": z[:, 1], "score": model.probability(x)})

    out = coded.select("doc_id", score("bins").alias("s"))
    return out.select("doc_id", "s.*").withColumn("good", (F.col("score") >= threshold).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """The rows of documents, with their columns, whose score reaches ``threshold``.

    Nulls, empty texts, repeats and missing columns count as in score_quality;
    an empty table gives none.  Only rows that may be rejected are shuffled.
    """
    names = documents.columns
    r, r2 = free(names, "_r", "_r2")

    def rejects() -> DataFrame:
        model, coded = train(documents, labels, **how)

        @F.pandas_udf("boolean")
        def bad(bins: pd.Series) -> pd.Series:
            return pd.Series(model.probability(_matrix(bins)) < threshold)

        return coded.filter(bad("bins")).select(F.col("row").alias(r), F.col("row2").alias(r2)).distinct()

    rejected = settled(rejects, "rejected")
    typed = [(F.col(f"`{c}`") if c in names else F.lit(None)).cast(t) for c, t in _READ.items()]
    keyed = documents.withColumns({r: F.xxhash64(*typed), r2: F.xxhash64(F.lit("2"), *reversed(typed))})
    may = KeyFilter(rejected, r).column(F.col(r))
    doubtful = keyed.filter(may).join(rejected, [r, r2], "left_anti").select(*keyed.columns)
    return keyed.filter(~may).union(doubtful).drop(r, r2)
