"""Personal data: base formats, and identifiers found by bootstrapped context patterns.

Base matches are the seeds.  Every identifier-like token (it holds a digit or
an @) is an instance, and each occurrence ties it to patterns: the one or two
words before or after it, with a coarse class of its shape.  Spark scores the
graph of patterns and instances in rounds: a pattern is worth the share of its
weight that lies on trusted instances of a kind, an instance what its good
patterns cover of all its occurrences.  Instances that gain trust support new
patterns in the next round.  Patterns of high worth that enough different
trusted instances support turn the other tokens they meet into spans of kind
``ctx_<kind>``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.shared import bounded_batches, join_hot, map_texts, table

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Runs of digits are tried once, at their first digit: the later starts end alike.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"(?<!\S)(?=\S*[0-9@])\S+")
_WORD = re.compile(r"[^\W\d_]+")
_STRIP = ".,;:!?\"'()[]{}<>*%$#&|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, p = 0, text.find("@")
    while p >= 0:
        start = p
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < p and (m := _DOMAIN.match(text, p + 1)):
            yield start, m.end()
            done = m.end()
        p = text.find("@", max(p + 1, done))


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, by start and then kind."""
    if not text or not _ANY.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(g.lstrip("0")) < 4 and int(g.lstrip("0") or 0) <= 255 for g in m.groups())]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


class _Words:
    """The words of a text by their places; they are looked up once something is found."""

    def __init__(self, text: str):
        self.text = text
        self.places = [m.span() for m in _WORD.finditer(text)]
        self.starts, self.ends = [a for a, _ in self.places], [b for _, b in self.places]

    def _named(self, places: list[tuple[int, int]]) -> list[str]:
        return [_short(self.text[a:b].lower()) for a, b in places]

    def before(self, at: int) -> list[str]:
        """The last two words that end by ``at``."""
        k = bisect_right(self.ends, at)
        return self._named(self.places[max(0, k - 2) : k])

    def after(self, at: int) -> list[str]:
        """The first two words from ``at`` on."""
        k = bisect_left(self.starts, at)
        return self._named(self.places[k : k + 2])


def _short(text: str) -> str:
    """A text, or for a long one its digest: names and instances of any length stay apart."""
    return text if len(text) <= 64 else hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _patterns(words: list[str], token: str, last: bool) -> list[str]:
    """The nearest word and the nearest two words, each with the token's class; none at the text's edge."""
    if not words:
        return []
    near = [words[-1] if last else words[0], " ".join(words)]
    return [_class(token) + "<>"[not last] + w for w in near[: len(words)]]


def _class(token: str) -> str:
    if "@" in token:
        return "@"
    return "9" if 2 * sum(map(str.isdigit, token)) > sum(map(str.isalnum, token)) else "a"


#: A token with fewer characters tells nobody apart: years, counts, ages.
LEAST = 5


def _occurrences(text: str | None, base: list[tuple[int, int, int]]) -> list[tuple]:
    """(start, end, instance, before, after, kind) of base spans and of other identifier-like tokens."""
    if not text or not _ANY.search(text):
        return []
    spans = [(a, b, KINDS[k]) for a, k, b in base]
    # Where base spans lie, as intervals apart from each other.
    begins: list[int] = []
    ends: list[int] = []
    for a, _, b in base:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    for m in _TOKEN.finditer(text):
        token = m[0]
        a = m.start() + len(token) - len(token.lstrip(_STRIP))
        b = m.end() - (len(token) - len(token.rstrip(_STRIP)))
        k = bisect_right(ends, a)
        if b - a >= LEAST and not (k < len(begins) and begins[k] < b):
            spans.append((a, b, None))
    if not spans:
        return []
    words = _Words(text)
    return [(a, b, _short(text[a:b]), _patterns(words.before(a), text[a:b], True), _patterns(words.after(b), text[a:b], False), k) for a, b, k in spans]


def joined(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


_FIELDS = ("begin", "end", "instance", "before", "after", "kind")
_OCC = "array<struct<begin:long,end:long,instance:string,before:array<string>,after:array<string>,kind:string>>"


_SCANNED = f"n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, occurrences {_OCC}"


def scan(documents: DataFrame) -> DataFrame:
    """The other columns of documents, and n_email, n_ip, n_card, n_phone, base, base_sha256, occurrences of the texts."""

    def make(texts: list[str | None]) -> list[pa.Array]:
        out = []
        for text in texts:
            base = base_spans(text)
            all_ = joined(base, KINDS)
            found = [dict(zip(_FIELDS, x, strict=True)) for x in _occurrences(text, base)]
            out.append((*(sum(k == i for _, k, _ in base) for i in range(4)), all_, hashlib.sha256(all_.encode()).hexdigest(), found))
        lists = pa.list_(pa.string())
        occurrence = pa.struct(list(zip(_FIELDS, (pa.int64(), pa.int64(), pa.string(), lists, lists, pa.string()), strict=True)))
        types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.list_(occurrence)]
        return [pa.array([x[i] for x in out], t) for i, t in enumerate(types)]

    bounded_batches(documents.sparkSession)
    docs = documents.withColumn("text", F.col("text").cast("string"))
    return map_texts(docs, [c for c in docs.columns if c != "text"], make, _SCANNED, ["n_email", "n_ip", "n_card", "n_phone", "base", "base_sha256", "occurrences"])


def bootstrap(occurrences: DataFrame, rounds: int = 3, worth: float = 0.9, seeds: int = 5, trusted: float = 0.8) -> DataFrame:
    """(pattern, kind) of high worth from occurrences (instance, before, after, kind).

    ``kind`` is null where the instance is no seed.  A pattern's worth for a
    kind is the trusted weight on it by its whole weight plus one; patterns
    need ``seeds`` different trusted instances.  The trust of an instance that
    is no seed is the worth of the best good pattern at each of its
    occurrences, none counting 0, averaged over them all; from ``trusted`` on
    it supports patterns as seeds do.  Counts are over all occurrences.
    """
    seen = table(occurrences.select("instance", "kind", F.concat("before", "after").alias("patterns")).groupBy("instance", "kind", "patterns").agg(F.count("*").alias("n")), "occurrences")
    edges = seen.select("instance", "kind", "n", F.explode("patterns").alias("pattern"))
    graph = table(edges.groupBy("pattern", "instance", "kind").agg(F.sum("n").alias("n")), "graph")
    whole = graph.groupBy("pattern").agg(F.sum("n").alias("whole"))
    sure = table(graph.filter("kind is not null").groupBy("pattern", "kind").agg(F.count("*").alias("support"), F.sum("n").cast("double").alias("mass")), "sure")
    places = seen.filter("kind is null").select("instance", "n", "patterns", F.xxhash64("patterns").alias("place"))
    total = places.groupBy("instance").agg(F.sum("n").alias("total"))

    def good(got: DataFrame) -> DataFrame:
        """Only patterns with enough support meet the counts of all."""
        scored = got.filter(F.col("support") >= seeds).join(whole, "pattern")
        scored = scored.select("pattern", "kind", (F.col("mass") / (F.col("whole") + 1)).alias("worth")).filter(F.col("worth") >= worth)
        # Of two kinds the worthier, of equal ones the first by name.
        best = F.max_by(F.struct("kind", "worth"), F.struct("worth", -F.array_position(F.array(*map(F.lit, sorted(KINDS))), F.col("kind"))))
        return scored.groupBy("pattern").agg(best.alias("best")).select("pattern", "best.*")

    patterns = table(good(sure), "patterns")
    for r in range(rounds):
        met = _met(places.select("instance", "place", "n", F.explode("patterns").alias("pattern")), patterns)
        gain = met.groupBy("instance", "place", "kind").agg(F.max(F.col("n") * F.col("worth")).alias("gain")).groupBy("instance", "kind").agg(F.sum("gain").alias("gain"))
        trust = gain.join(total, "instance").select("instance", "kind", (F.col("gain") / F.col("total")).alias("trust")).filter(F.col("trust") >= trusted)
        gained = graph.filter("kind is null").drop("kind").join(trust, "instance").groupBy("pattern", "kind").agg(F.count("*").alias("support"), F.sum("n").cast("double").alias("mass"))
        both = sure.unionByName(gained).groupBy("pattern", "kind").agg(F.sum("support").alias("support"), F.sum("mass").alias("mass"))
        patterns = table(good(both), f"patterns{r}")
    return patterns.select("pattern", "kind")


def _met(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """rows (pattern, ...) with what is known of their patterns; a pattern that stands in very many rows is not shuffled to one task."""
    counts = rows.groupBy("pattern").agg(F.count("*").alias("rows"))
    return join_hot(rows, patterns.join(counts, "pattern"), "pattern", "rows")


def find_personal_data(documents: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row of documents (doc_id, text).

    Spans are kind:start:end in code points, end exclusive, comma-joined by
    start, then kind: base spans first as email, ip, card, phone, then those
    that context patterns add.  Null texts are empty and have no spans; rows
    that repeat are each scanned, and count as often; of kinds that tie for a
    token the first by name is taken; no rows give none; texts of any length
    are read whole; other columns are not read.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = table(scan(docs).withColumn("row", F.monotonically_increasing_id()), "pii")
    each = found.select("row", F.explode("occurrences").alias("o")).select("row", "o.*")
    patterns = bootstrap(each)
    free = each.filter("kind is null").drop("kind").select("*", F.explode(F.concat("before", "after")).alias("pattern"))
    kinds = _met(free, patterns).groupBy("row", "begin", "end").agg(F.min("kind").alias("kind"))
    told = F.concat_ws(":", F.concat(F.lit("ctx_"), "kind"), "begin", "end")
    added = kinds.groupBy("row").agg(F.collect_list(F.struct("begin", F.lit(len(KINDS)).alias("k"), told.alias("s"))).alias("added"))
    kind = F.array(*map(F.lit, KINDS))
    base = F.transform(
        F.filter(F.split("base", ","), lambda s: s != ""),
        lambda s: F.struct(F.split(s, ":")[1].cast("long").alias("begin"), F.array_position(kind, F.split(s, ":")[0]).cast("int").alias("k"), s.alias("s")),
    )
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_join(F.transform(F.array_sort(F.concat(base, "added")), lambda x: x["s"]), ","))
    out = found.drop("occurrences").join(added, "row", "left")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"))
