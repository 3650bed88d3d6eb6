"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers read the words of a clause as symbols: insult (a learned weight for each word), threat (a
threatening verb followed by its target), target (whom the clause addresses), negation and reported speech
(scopes that change what an insult in them means). Their composition is one automaton, compiled to tables;
each insult or threat that it accepts adds its weight to the reading it was found in: plain, targeted,
negated, reported, or threat. A document is scored from its clauses' weights, not from single words.

The function words are fixed lists; the insults are learned: word beginnings and whole words that occur in
toxic documents far more often than chance, by a Wilson bound, weighted by smoothed log-odds. What each
reading counts is fitted by logistic regression. Both use at most about `SAMPLE` labelled rows.

Cases: a null or empty text scores as a text without a match. Without any labels, or labels of one
kind only, nothing is learned and the score is the smoothed share of toxic rows. A text without stops is
one clause. Repeated rows score alike. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octroi.llm.common import small_batches
from octroi.llm.labels import held_out, training_sample

#: Labelled rows learned from; entries of the learned lexicon; characters of a word beginning.
SAMPLE, ENTRIES, STEMS = 20_000, 4_000, range(3, 9)
#: Deviations of the Wilson bound and the share of toxic rows that it must reach.
WILSON_Z, WILSON_SHARE = 2.5, 0.5
THRESHOLD = 0.7

# Function words of the four languages.
NEGATION = set("not no never without neither nor nicht kein keine nie ohne ne pas jamais sans non nunca ni sin tampoco".split())
REPORT = set("said says say told quoted wrote claimed sagte sagt schrieb behauptet dit disait déclaré écrit dijo dice escribió".split())
TARGET = set("you your yours he she they them him his her their du dich dir ihr euch sie tu te toi vous ils elle ellos ella usted ustedes".split())
THREAT = set("kill hurt destroy beat shoot stab töten schlagen vernichten tuer frapper détruire matar golpear destruir".split())

WORD = re.compile(r"\w+")
CLAUSE = re.compile(r"[.!?;\n]+")
OTHER, INSULT, TARGETING, NEGATING, REPORTING, THREATENING = range(6)
READINGS = ("plain", "targeted", "negated", "reported", "threat")


class Transducer:
    """States 0 … n - 1, start 0; step[state][symbol] is the next state, out[state][symbol] the outputs of the arc."""

    def __init__(self, step: list[list[int]], out: list[list[frozenset]]):
        self.step, self.out = step, out


def scope(symbol: int, words: int | None, name: str) -> Transducer:
    """After `symbol` the next `words` words (None: the rest of the clause) carry `name`."""
    n = 1 if words is None else words
    step = [[n if s == symbol else (state if words is None else max(0, state - 1)) for s in range(6)] for state in range(n + 1)]
    return Transducer(step, [[frozenset({name}) if state else frozenset() for _ in range(6)] for state in range(n + 1)])


def insults() -> Transducer:
    return Transducer([[0] * 6], [[frozenset({"insult"}) if s == INSULT else frozenset() for s in range(6)]])


def threats(words: int) -> Transducer:
    """A threatening word whose target follows within some words."""
    t = scope(THREATENING, words, "pending")
    t.out = [[frozenset({"threat"}) if state and s == TARGETING else frozenset() for s in range(6)] for state in range(words + 1)]
    t.step = [[0 if state and s == TARGETING else t.step[state][s] for s in range(6)] for state in range(words + 1)]
    return t


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both read the same symbols; an arc puts out what its two arcs put out. States are pairs."""
    nb = len(b.step)
    pairs = list(product(range(len(a.step)), range(nb)))
    return Transducer([[a.step[i][s] * nb + b.step[j][s] for s in range(6)] for i, j in pairs], [[a.out[i][s] | b.out[j][s] for s in range(6)] for i, j in pairs])


def grammar() -> tuple[list[list[int]], list[list[int]]]:
    """Tables of the composed automaton: next state, and the reading of an arc (-1: none)."""
    t = insults()
    for part in (threats(4), scope(TARGETING, 4, "targeted"), scope(NEGATING, 3, "negated"), scope(REPORTING, None, "reported")):
        t = compose(t, part)

    def reading(out: frozenset) -> int:
        if not out & {"insult", "threat"}:
            return -1
        for name in ("reported", "negated"):
            if name in out:
                return READINGS.index(name)
        return READINGS.index("threat" if "threat" in out else "targeted" if "targeted" in out else "plain")

    return t.step, [[reading(o) for o in row] for row in t.out]


STEP, READING = grammar()
SYMBOLS = {w: s for words, s in ((TARGET, TARGETING), (NEGATION, NEGATING), (REPORT, REPORTING), (THREAT, THREATENING)) for w in words}


class Lexicon:
    """Weights of insults: beginnings of words, and whole words (ending in '$')."""

    def __init__(self, weights: dict[str, float]):
        import ahocorasick

        self.weights = weights
        self.trie = ahocorasick.Automaton()
        for w in {w.removesuffix("$") for w in weights} | THREAT:
            self.trie.add_word(w, len(w))
        if len(self.trie):
            self.trie.make_automaton()

    def weight(self, word: str) -> float:
        return max([self.weights.get(word + "$", 0.0), *(self.weights.get(word[:k], 0.0) for k in STEMS if k <= len(word))])

    def starts(self, low: str) -> list[int]:
        """Where words that may match begin."""
        return sorted({e - n + 1 for e, n in self.trie.iter(low) if e == n - 1 or not (low[e - n].isalnum() or low[e - n] == "_")})


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Weight found in each reading, the heaviest clause, and the matched clauses' share; logarithms of counts."""
    low = (text or "").lower()
    starts = lexicon.starts(low)
    sums, heaviest, matched = [0.0] * len(READINGS), 0.0, 0
    if starts:
        stops = [(0, 0), *(m.span() for m in CLAUSE.finditer(low)), (len(low), len(low))]
        k = 0
        for (_, a), (b, _) in zip(stops[:-1], stops[1:], strict=True):
            while k < len(starts) and starts[k] < a:
                k += 1
            if k == len(starts):
                break
            if starts[k] >= b:
                continue
            state, found = 0, 0.0
            for m in WORD.finditer(low, a, b):
                word = m[0]
                w = lexicon.weight(word)
                s = INSULT if w else SYMBOLS.get(word, OTHER)
                r = READING[state][s]
                state = STEP[state][s]
                if r >= 0:
                    sums[r] += w or 1.0
                    found += w or 1.0
            heaviest, matched = max(heaviest, found), matched + (found > 0)
        matched /= len(stops) - 1
    return [*map(math.log1p, sums), math.log1p(heaviest), math.log1p(len(READINGS) * 10 * matched)]


def learn_lexicon(sample: DataFrame, entries: int = ENTRIES) -> dict[str, float]:
    """Beginnings and words that mark toxic rows. Counted in tasks and summed by Spark; at most `entries` come back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(WORD.findall((text or "").lower()))
                seen[label > 0].update({w[:k] for w in words for k in STEMS if k <= len(w)} | {w + "$" for w in words if len(w) < 64})
            names = [w for w, n in seen[1].items()]  # what no toxic row of the batch has counts only once one has
            rest = [w for w in seen[0] if w not in seen[1]]
            yield pa.RecordBatch.from_arrays([pa.array(names + rest, pa.string()), pa.array([seen[1][w] for w in names] + [0] * len(rest), pa.int64()), pa.array([seen[0][w] for w in names + rest], pa.int64())], names=["word", "toxic", "clean"])

    totals = {r.label > 0: r.n for r in sample.groupBy(F.col("label").alias("label")).agg(F.count("*").alias("n")).collect()}
    p, q = totals.get(True, 0), totals.get(False, 0)
    if not p or not q:
        return {}
    counted = sample.select("text", "label").mapInArrow(count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where("t > 2")
    n, z = F.col("t") + F.col("c"), WILSON_Z
    share = F.col("t") / n
    bound = (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    odds = F.log((F.col("t") + 0.5) / (p - F.col("t") + 0.5)) - F.log((F.col("c") + 0.5) / (q - F.col("c") + 0.5))
    best = counted.where(bound >= WILSON_SHARE).select("word", odds.alias("odds"), "t").orderBy(F.desc("t"), "word").limit(entries).collect()
    found = {r.word: min(8.0, r.odds) for r in best if r.odds > 0}
    shorter = lambda w: [w[:k] for k in STEMS if k < len(w.removesuffix("$"))]
    return {w: x for w, x in found.items() if not any(found.get(s, 0.0) >= x for s in shorter(w))}  # a shorter beginning says as much


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights and, last, the intercept, by Newton steps on the ridge-penalised likelihood."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.r_[np.full(x.shape[1] - 1, ridge), 1e-9]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def featurise(rows: DataFrame, weights: dict[str, float], extra: str) -> DataFrame:
    """x (the features) beside one column of `rows` (text, and that column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(weights)
        for batch in batches:
            x = [features(t, lexicon) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=[extra, "x"])

    kind = dict(rows.dtypes)[extra]
    return rows.select("text", extra).mapInArrow(run, f"{extra} {kind}, x array<double>")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted and the weight found in each reading, for each row of `docs`."""
    small_batches(docs.sparkSession)
    train = training_sample(docs, labels, "toxic", sample)
    weights = learn_lexicon(train)
    rows = featurise(train, weights, "label").collect() if weights else train.select("label").collect()  # bounded by the sample
    y = np.array([r.label > 0 for r in rows], float)
    width = len(READINGS) + 2
    if weights:
        fitted = fit_logistic(np.array([r.x for r in rows]), y)
    else:
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.25
        fitted = np.r_[np.zeros(width), math.log(share / (1 - share))]
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = featurise(named, weights, "doc_id")
    logit = F.lit(float(fitted[-1]))
    for k in range(width):
        logit = logit + F.col("x")[k] * float(fitted[k])
    score = 1 / (1 + F.exp(-logit))
    found = [F.expm1(F.col("x")[k]).alias(name) for k, name in enumerate(READINGS)]
    return scored.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), *found)
