"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers read a clause's words one after the other, each what the one
before it wrote: insults (from a lexicon learned from labelled rows), threats
(an agent, a verb of harm and a target, in either order), then negation,
reported speech and target, which tag the insults and threats that they bear
on.  Their composition writes every insult or threat with its weight and its
tags, a tag scales the weight, and a clause weighs what it matched.  A logistic
model over the clause weights of a text gives the score, so what counts is the
clause, not the lone word.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm import hashing
from halyard.llm.fit import LABELLED, labelled_sample, logistic, sigmoid
from halyard.llm.shared import bounded_batches

# Words of the grammar in English, German, French and Spanish; insults are learned.
TARGETS = frozenset("you your yours yourself u ur he she they them him her du dich dir ihr euch sie tu toi te vous votre tú usted ustedes ti ellos".split())
NEGATIONS = frozenset("not no never isn't aren't wasn't don't doesn't without nicht kein keine nie ohne pas jamais ni sin nunca".split())
REPORTS = frozenset("said says say told tells called calls wrote writes reported quoted according sagte sagt dit disait dijo dice".split())
THREATS = frozenset("kill murder hurt destroy shoot stab strangle beat burn hang töten umbringen tuer frapper matar golpear".split())
AGENTS = frozenset("i we i'll we'll i'm ich wir je nous yo nosotros".split())

_CLAUSE = re.compile(r"[.!?;:,\n()]+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")

#: A symbol: the word, its kind ("word", "insult" or "threat"), its weight and its tags.
Symbol = tuple[str, str, float, frozenset]


class Transducer:
    """A deterministic transducer: (state, symbol) -> (state, symbol)."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes, the other reads."""

        def step(state, symbol: Symbol):
            mine, out = self.step(state[0], symbol)
            theirs, out = other.step(state[1], out)
            return (mine, theirs), out

        return Transducer((self.start, other.start), step)


def insults(lexicon: Lexicon) -> Transducer:
    """Words of the lexicon become insults; one that follows another at once is tagged."""

    def step(after: bool, symbol: Symbol):
        weight = lexicon.weight(symbol[0])
        if not weight:
            return False, symbol
        return True, (symbol[0], "insult", weight, symbol[3] | {"chained"} if after else symbol[3])

    return Transducer(False, step)


#: A verb of harm weighs little alone, and the rest once an agent came before it or a target comes after it.
THREAT_WEIGHT, LONE_THREAT = 2.0, 0.15
_AGENT_REACH, _TARGET_REACH = 6, 3


def _threat_step(state: tuple[int, int], symbol: Symbol):
    """The state holds how many words an agent or target, and a lone verb, still reach."""
    near, verb = state
    word, kind, _, tags = symbol
    bears = word in AGENTS or word in TARGETS
    if kind == "word" and word in THREATS:
        weight = THREAT_WEIGHT * (1 if near else LONE_THREAT)
        return (max(0, near - 1), 0 if near else _TARGET_REACH), (word, "threat", weight, tags)
    if kind == "word" and verb and word in TARGETS:
        return (_AGENT_REACH, 0), (word, "threat", THREAT_WEIGHT * (1 - LONE_THREAT), tags)
    return (_AGENT_REACH if bears else max(0, near - 1), max(0, verb - 1)), symbol


def _tagging(cues: frozenset, tag: str, reach: int) -> Transducer:
    """Tags insults and threats that follow one of the cues by at most ``reach`` words."""

    def step(left: int, symbol: Symbol):
        word, kind, weight, tags = symbol
        if word in cues and kind == "word":
            return reach, symbol
        if left and kind != "word":
            symbol = (word, kind, weight, tags | {tag})
        return max(0, left - 1), symbol

    return Transducer(0, step)


_CONTEXT = Transducer((0, 0), _threat_step).then(_tagging(NEGATIONS, "negated", 3)).then(_tagging(REPORTS, "reported", 12)).then(_tagging(TARGETS, "targeted", 6))
#: What a tag does to the weight of its insult or threat.
SCALE = {"negated": 0.4, "reported": 0.6, "targeted": 1.5, "chained": 1.2}


#: Lengths of the stems that may stand in a lexicon, written with a star.
STEMS = (4, 5, 6)


class Lexicon(dict):
    """Weights of words; a word that is not listed has its longest listed stem's.  Its grammar is composed once."""

    def __init__(self, weights: dict[str, float]):
        super().__init__(weights)
        self.stems = [(k, {w[:-1]: x for w, x in weights.items() if w.endswith("*") and len(w) == k + 1}) for k in sorted(STEMS, reverse=True)]
        self.stems = [(k, table) for k, table in self.stems if table]

    def __reduce__(self):
        return Lexicon, (dict(self),)

    @functools.cached_property
    def grammar(self) -> Transducer:
        return insults(self).then(_CONTEXT)

    def weight(self, word: str) -> float:
        found = self.get(word)
        if found is None:
            for k, table in self.stems:
                if (found := table.get(word[:k])) is not None:
                    return found
        return found or 0.0

    def any(self, words: set[str]) -> bool:
        return not self.keys().isdisjoint(words) or any(not table.keys().isdisjoint({w[:k] for w in words}) for k, table in self.stems)


def clause_weight(words: list[str], lexicon: Lexicon) -> tuple[float, int, int]:
    """Weight of a clause, and how many insults and tagged matches it holds."""
    grammar = lexicon.grammar
    state, total, insults_, tagged = grammar.start, 0.0, 0, 0
    for w in words:
        state, (_, kind, weight, tags) = grammar.step(state, (w, "word", 0.0, frozenset()))
        if kind != "word":
            total += weight * math.prod(SCALE[t] for t in tags)
            insults_ += kind == "insult"
            tagged += bool(tags)
    return total, insults_, tagged


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Of a whole text: largest and summed clause weight, distinct insults, matched clauses, density, tagged share."""
    low = (text or "").lower()
    if not low or (not lexicon.any(words := set(_WORD.findall(low))) and THREATS.isdisjoint(words)):
        return [0.0] * 6
    weights, insults, tagged, n = [], 0, 0, 0
    seen: set[str] = set()
    for clause in _CLAUSE.split(low):
        words = _WORD.findall(clause)
        n += len(words)
        hit = [w for w in words if lexicon.weight(w)]
        if hit or any(w in THREATS for w in words):
            w, i, t = clause_weight(words, lexicon)
            weights.append(w)
            insults, tagged = insults + i, tagged + t
            seen.update(hit)
    top = max(weights, default=0.0)
    return [min(top, 12.0), math.log1p(sum(weights)), float(min(len(seen), 8)), math.log1p(len(weights)), min(1.0, 50 * len(weights) / max(n, 1)), tagged / max(insults, 1)]


def _held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def learn_lexicon(sample: DataFrame, least: int = 3, evidence: float = 16.0) -> Lexicon:
    """Words and stems that mark label 1 in (text, label), with their smoothed log odds: those of enough likelihood ratio.

    Near copies count once: of texts with the same two min-hashes one is read.
    """

    @F.pandas_udf("long")
    def key(texts: pd.Series) -> pd.Series:
        out = []
        for w in hashing.word_hashes(texts.tolist()):
            s = hashing.shingles(w, 3)
            out.append(int((s.min() ^ hashing.mix(s).min()).view(np.int64)) if len(s) else 0)
        return pd.Series(out)

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for pdf in it:
            for text, label in zip(pdf["text"], pdf["label"], strict=True):
                words = {w for w in _WORD.findall((text or "").lower()) if w.isalpha() and len(w) > 2}
                tally[label].update(words)
                for k in STEMS:
                    tally[label].update({w[:k] + "*" for w in words if len(w) >= k})
                tally[label][""] += 1
        yield pd.DataFrame([(w, c, tally[1][w]) for w, c in (tally[0] + tally[1]).items()], columns=["word", "n", "n1"])

    once = sample.withColumn("k", key("text")).dropDuplicates(["k"]).select("text", "label")
    counts = once.mapInPandas(count, "word string, n long, n1 long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))
    total = counts.filter("word = ''").first()
    if total is None or not 0 < total["n1"] < total["n"]:
        return Lexicon({})
    n, n1 = float(total["n"]), float(total["n1"])
    a, c = F.col("n1").cast("double"), F.col("n").cast("double")
    side = lambda got, of, p: F.when(got > 0, got * F.log(got / (of * p))).otherwise(0.0)
    ratio = 2 * (side(a, c, n1 / n) + side(c - a, c, 1 - n1 / n))
    odds = F.log((a + 0.5) / (n1 + 1)) - F.log((c - a + 0.5) / (n - n1 + 1))
    best = counts.filter(F.col("word") != "").filter((a >= least) & (odds > 1.0) & (ratio >= evidence)).select("word", odds.alias("odds"), ratio.alias("ratio"))
    return Lexicon({r["word"]: r["odds"] for r in best.select("word", "odds").collect()})  # as many as the labelled sample holds


def score_toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of documents (doc_id, text) with labels (doc_id, toxic).

    Fitted on at most ``most`` labelled rows whose crc32(doc_id) mod 4 is not
    2; id, language and source are no inputs of a score.  Null and empty texts
    score as texts that match nothing do.  A null doc_id is not held out.
    Repeated rows score alike; an empty table gives no rows; texts of any length
    are read whole.  Without usable labels the score is the share
    of label 1, or 0.5 if there are none.  Other columns are not read.
    """
    bounded_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = labelled_sample(labels, "toxic", most, ~_held_out())
    sample = docs.join(F.broadcast(chosen), "doc_id").select("text", "label")
    lexicon = learn_lexicon(sample)

    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: features(t, lexicon))

    # An id may stand over several texts: the first ones in an order of their own are read, so a fit does not depend on how rows are dealt.
    rows = sample.orderBy(F.xxhash64("text"), "label").limit(2 * most).select(measure("text").alias("x"), "label").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), 6)
    w = logistic(x, rows["label"].to_numpy(float))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        x = np.array([features(t, lexicon) for t in texts.to_pylist()], float).reshape(len(texts), 6)
        return pa.array(sigmoid(x @ w[:-1] + w[-1]))

    held = F.coalesce(_held_out(), F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), score("text").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
