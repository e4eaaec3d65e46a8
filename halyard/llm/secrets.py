"""Secrets: base formats, and literals assigned to sensitive names.

A small lexer reads source and configuration syntax (``name = "x"``,
``name: x``, ``name := x``, ``"name" => 'x'``, ``export NAME=x``) into pairs of
a name and an expression.  Expressions are literals, names, or sums of both;
names stand for what was last assigned to them, so a constant is followed to
where it lands, and a sum counts as one value.  A literal is scored by the
most sensitive name that it reaches and by how random the value there looks.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.shared import bounded_batches, map_texts

KINDS = ("assign", "access", "hex", "literal")

_KEY = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_STEMS = ("passw", "secret", "token", "api")

#: Words within names, and how sensitive a name with them is.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 0.9, "token": 0.8, "apikey": 0.9, "credential": 0.9,
    "private": 0.7, "auth": 0.6, "bearer": 0.7, "access": 0.5, "key": 0.6, "session": 0.5, "salt": 0.5, "signature": 0.4,
}

# A run of name characters is tried once, at the first name in it: later starts end alike.
_PAIR = re.compile(r"""(?<![\w.-])["']?(?:(?![A-Za-z_])[\w.]*+-)*+([A-Za-z_][\w.-]*+)["']?[\x20\t]*+(?:=>|:=|==?|:)[\x20\t]*(?=["'`\w+/$])""", re.ASCII)
_TERM = re.compile(r""""([^"\n]*+)"|'([^'\n]*+)'|`([^`\n]*+)`|([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_PLUS = re.compile(r"[\x20\t]*\+[\x20\t]*", re.ASCII)
_NAME = re.compile(r"[A-Za-z_][\w.]*", re.ASCII)
_PLACEHOLDER = re.compile(r"example|changeme|placeholder|your[_-]|xxx+|\.\.\.|^<.*>$|^\$|\*\*\*|^(true|false|none|null)$", re.IGNORECASE)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, by start and then kind."""
    if not text:
        return []
    out = []
    low = text.lower()
    if any(s in low for s in _STEMS):
        out += [(m.start(), 0, m.end()) for m in _KEY.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def sensitivity(name: str) -> float:
    flat = name.lower().replace("_", "").replace("-", "").replace(".", "")
    return max((w for word, w in SENSITIVE.items() if word in flat), default=0.0)


class Letters:
    """What is known of a value's characters: how often each occurs."""

    def __init__(self, literals: Iterable[str] = (), values: Iterable[Letters] = ()):
        self.counts: Counter[str] = Counter()
        for x in literals:
            self.counts.update(x)
        for v in values:
            self.counts.update(v.counts)

    def randomness(self) -> float:
        """0 to 1: entropy of the characters, their number and the mix of their classes."""
        n = self.counts.total()
        if n < 6:
            return 0.0
        bits = -sum(c / n * math.log2(c / n) for c in self.counts.values())
        classes = sum(any(map(f, self.counts)) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in self.counts)
        return min(1.0, bits / 4) * 0.5 + min(1.0, n / 20) * 0.25 + classes / 4 * 0.25


def plausible(literal: str) -> bool:
    """No placeholder, and no running text."""
    return not _PLACEHOLDER.search(literal) and " " not in literal.strip()


def assigned_literals(text: str) -> Iterator[tuple[str, float, int, int]]:
    """(name, score, start, end): each literal with the name it reaches, also through constants and sums, that scores it most.

    A name scores what is assigned to it as a whole: its sensitivity, by how
    random the characters of all parts look together.  What is held is one
    entry for each assignment and term of the text.
    """
    last: dict[str, int] = {}
    made: list[tuple[str, list[tuple[int, int]], list[int]]] = []
    at = 0
    while m := _PAIR.search(text, at):
        pos = at = m.end()
        spans: list[tuple[int, int]] = []
        uses: list[int] = []
        while t := _TERM.match(text, pos):
            if t.lastindex == 4 and _NAME.fullmatch(t[4]) and t[4] in last:
                uses.append(last[t[4]])
            elif t[t.lastindex]:
                spans.append(t.span(t.lastindex))
            pos = t.end()
            plus = _PLUS.match(text, pos)
            if not plus:
                break
            pos = plus.end()
        if spans or uses:
            last[m[1]] = len(made)
            made.append((m[1], spans, uses))
    weights = [sensitivity(name) for name, _, _ in made]
    if not any(weights):
        return
    values: list[Letters] = []
    for _, spans, uses in made:
        values.append(Letters([text[a:b] for a, b in spans], [values[u] for u in uses]))
    best = [(w * (0.4 + 0.6 * v.randomness()) if w else 0.0, name) for w, v, (name, _, _) in zip(weights, values, made, strict=True)]
    # Constants are made before they are used, so one pass from the end takes scores back to the literals.
    for k in range(len(made) - 1, -1, -1):
        _, spans, uses = made[k]
        for u in uses:
            best[u] = max(best[u], best[k])
        for a, b in spans:
            yield best[k][1], best[k][0] if plausible(text[a:b]) else 0.0, a, b


def spans_of(text: str | None, least: float = 0.45) -> list[tuple[int, int, int]]:
    """Base spans and sensitive literals, by start and then kind."""
    base = base_spans(text)
    if not text or ("=" not in text and ":" not in text):
        return base
    found = {(a, 3, b) for _, score, a, b in assigned_literals(text) if score >= least}
    return sorted({*base, *found})


def find_secrets(documents: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row of documents (doc_id, text).

    Spans are kind:start:end in code points, end exclusive, comma-joined by
    start, then kind as assign, access, hex, literal; a literal's span is its
    text without quotes; one literal has one span, whatever names it reaches.
    Null texts are empty and have no spans; rows that repeat are each scanned;
    an empty table gives no rows; texts, names and literals of any length are
    read whole; other columns are not read.
    """

    def make(texts: list[str | None]) -> list[pa.Array]:
        out = []
        for text in texts:
            spans = spans_of(text)
            base = [s for s in spans if s[1] < 3]
            out.append((*(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
        return [pa.array([x[i] for x in out], t) for i, t in enumerate([pa.int64()] * 3 + [pa.string()] * 2)]

    bounded_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(docs, ["doc_id"], make, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
