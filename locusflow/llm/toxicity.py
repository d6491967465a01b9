"""Toxicity by a lexicon trie intersected with Levenshtein automata.

The lexicon is learned: words that documents labelled toxic hold and others do
not, counted over a bounded sample of labelled rows. Its trie is intersected
with the automata of all words within some edits of it: a state is a set of (trie
node, edits left), and the deterministic automaton over such sets is built
lazily, a transition when a text first needs it. A word is walked through it
once; it is accepted with the nearest terms and their distances, and most words
leave it after a few letters. Two neighbours that changed places are one edit.
Terms of fewer than FUZZY_FROM letters are matched exactly only; signs that stand
for letters are read as letters for terms of any length.

Every hit is weighed by its context: quotation marks around it or words of
reporting near it lower its weight, words of address near it raise it. A
logistic model of the weighed hits, fitted on the same sample, gives the score;
more or weightier hits never lower it.

Defined cases: a null text is empty and scored like any; labels null or not 0/1
teach nothing, nor do ids with both; without labels the lexicon is empty and every score is 0.5, with
labels of one kind their smoothed share; rows with a null id are scored and not
held out; repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.llm.common import fresh, materialize, prepare
from locusflow.llm.labelled import held_out, training_sample

SAMPLE_ROWS = 20000
#: A term is in LEAST_DOCS or more toxic documents of the sample, of those with it at least LEAST_SHARE; so the sample bounds the lexicon.
LEAST_DOCS, LEAST_SHARE = 4, 0.9
FUZZY_FROM, EDITS, LONG_FROM, LONG_EDITS = 5, 1, 9, 2
WINDOW = 6
#: The first RISING of the model's features say how much there is.
FEATURES, RISING = 5, 4
QUOTES = frozenset("\"'“”„«»‘’‹›`")
REPORTING = frozenset("said says wrote writes quote quoted quotes quoting called term word words phrase insult slur example sagte schrieb zitat wort dit écrit citation mot dijo escribió cita palabra".split())
ADDRESS = frozenset("you your youre yourself u ur ya du dich dein ihr euch tu toi ton ta vous votre tú te usted ustedes".split())
QUOTED_WEIGHT, ADDRESS_WEIGHT, FUZZY_WEIGHT = 0.35, 1.25, 0.85
#: Signs that stand for letters inside words.
LEET = str.maketrans("013457@$", "oieastas")
_WORD = re.compile(r"[^\W_]+(?:[@$*][^\W_]+)*")
#: Words and states of the automaton that a worker keeps; beyond, it begins anew.
REMEMBERED, MOST_STATES = 200_000, 100_000


def edits_of(term: str) -> int:
    return 0 if len(term) < FUZZY_FROM else EDITS if len(term) < LONG_FROM else LONG_EDITS


class Automaton:
    """The trie of the terms with their Levenshtein automata, determinised lazily."""

    def __init__(self, terms: dict[str, float], fuzzy: dict[str, float]):
        """fuzzy: the weights of misspelled terms; terms without one are matched exactly."""
        self.terms = terms
        self.edits = {t: edits_of(t) if fuzzy.get(t, 0) > 0 else 0 for t in terms}
        self.children: list[dict[str, int]] = [{}]
        self.final: list[str | None] = [None]
        self.budget: list[int] = [0]  # edits that the best term below a node allows
        for term in sorted(terms):
            edits, node = self.edits[term], 0
            self.budget[0] = max(self.budget[0], edits)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.final.append(None)
                    self.budget.append(0)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], edits)
            self.final[node] = term
        self.letters = frozenset(c for x in self.children for c in x)
        self._begin()

    def _begin(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.start = self._state({(0, 0)})

    def _close(self, pairs: set) -> frozenset:
        """With letters of terms left out; of one node the fewest edits count. A
        node is a number, or (number, letter): the letter must come first, as the
        other half of a swap."""
        best: dict = {}
        todo = list(pairs)
        while todo:
            node, used = todo.pop()
            whole = isinstance(node, int)
            if used <= self.budget[node if whole else node[0]] and used < best.get(node, 99):
                best[node] = used
                if whole:
                    todo += [(child, used + 1) for child in self.children[node].values()]
        return frozenset(best.items())

    def _state(self, pairs: set) -> int:
        closed = self._close(pairs)
        if not closed:
            return -1
        if closed not in self.states:
            self.states[closed] = len(self.sets)
            self.sets.append(closed)
            self.moves.append({})
            ends = []
            for node, used in closed:
                term = self.final[node] if isinstance(node, int) else None
                if term is not None and used <= self.edits[term]:
                    ends.append((used, -self.terms[term], term))
            self.accepts.append((min(ends)[2], min(ends)[0]) if ends else None)
        return self.states[closed]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, used in self.sets[state]:
            if not isinstance(node, int):
                if node[1] == c:
                    out.add((node[0], used))
                continue
            for letter, child in self.children[node].items():
                out.add((child, used + (letter != c)))
                if letter != c and c in self.children[child]:
                    out.add(((self.children[child][c], letter), used + 1))
            out.add((node, used + 1))
        return self._state(out)

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its distance, of equals the weightiest."""
        if len(self.sets) > MOST_STATES:
            self._begin()
        state = self.start
        for c in word:
            key = c if c in self.letters else ""  # all letters of no term move alike
            to = self.moves[state].get(key)
            if to is None:
                to = self.moves[state][key] = self._move(state, key)
            if to < 0:
                return None
            state = to
        return self.accepts[state]


@dataclass
class Model:
    terms: dict[str, float]
    fuzzy: dict[str, float]
    weights: np.ndarray | None
    base: float

    def __post_init__(self):
        self.automaton: Automaton | None = None
        self.known: dict[str, tuple[float, int] | None] = {}

    def __getstate__(self):
        return {"terms": self.terms, "fuzzy": self.fuzzy, "weights": self.weights, "base": self.base}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def look(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of a lower-case word."""
        if word in self.known:
            return self.known[word]
        if self.automaton is None:
            self.automaton = Automaton(self.terms, self.fuzzy)
        hit = self.automaton.match(word)
        if (hit is None or hit[1]) and (plain := word.translate(LEET).replace("*", "")) != word:
            again = self.automaton.match(plain)
            # signs inside a word that hide a term are no accident: the term itself, if nothing else differs, counts whole
            if again and (hit is None or again[1] < hit[1]):
                hit = again
        out = None if hit is None else (self.fuzzy[hit[0]] if hit[1] else self.terms[hit[0]], hit[1])
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[word] = out
        return out

    def features(self, text: str) -> np.ndarray:
        """Of hits weighed by their context: the most, the sum, their density, the terms meant, and the quoted share."""
        low = text.lower()
        words = _WORD.findall(low)
        hits = {w: x for w in set(words) if (x := self.look(w))}
        if not hits:
            return np.zeros(FEATURES)
        spans = [(m.start(), m.end()) for m in _WORD.finditer(low)]
        total = most = quoted = n = weighed = 0.0
        meant: set[str] = set()
        for i, w in enumerate(words):
            if w not in hits:
                continue
            near = words[max(0, i - WINDOW) : i + WINDOW + 1]
            a, b = spans[i]
            marks = QUOTES.intersection(low[max(0, a - 2) : a]) and QUOTES.intersection(low[b : b + 3]) or _inside_quotes(low, a, b)
            if marks or REPORTING.intersection(near):
                factor = QUOTED_WEIGHT
                quoted += 1
            else:
                factor = ADDRESS_WEIGHT if ADDRESS.intersection(near) else 1.0
                meant.add(w)
            weight = hits[w][0] * factor
            total, most, n, weighed = total + weight, max(most, weight), n + 1, weighed + factor
        return np.array([most, np.log1p(total), np.log1p(100 * weighed / len(words)), min(3, len(meant)), quoted / n])

    def score(self, text: str) -> float:
        if self.weights is None:
            return self.base
        x = self.features(text)
        return float(1 / (1 + np.exp(-np.clip(self.base + self.weights @ x, -35, 35))))


def _inside_quotes(low: str, a: int, b: int) -> bool:
    """A double quotation opened up to 80 characters before and closed up to 80 after, on one line."""
    before, after = low[max(0, a - 80) : a].rpartition("\n")[2], low[b : b + 80].partition("\n")[0]
    return any(before.count(o) > (before.count(c) if o != c else before.count(o) // 2 * 2) and c in after for o, c in (('"', '"'), ("“", "”"), ("„", "“"), ("«", "»")))


def _newton(z: np.ndarray, y: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        gradient = z.T @ (p - y) + ridge * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge) + 1e-9 * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, rising: int, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Newton's method with a ridge on all but the base. Of the first rising
    features, those that would get a weight below 0 are left out, one by one."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    used = list(range(z.shape[1]))
    while True:
        own = _newton(z[:, used], y, np.array([penalty] * (len(used) - 1) + [1e-6]))
        low = [(v, i) for v, i in zip(own, used) if i < rising and v < 0]
        if not low:
            break
        used.remove(min(low)[1])
    w = np.zeros(z.shape[1])
    w[used] = own
    return w[:-1], float(w[-1])


def learn_terms(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of terms, and of their misspellings. Words of the sample (text, y)
    are counted by documents, in each task before the shuffle. A term whose
    neighbours within some edits are words of documents that aren't toxic is
    matched exactly only. The driver gets the terms, of which the bounded sample has
    at most its words over LEAST_DOCS."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            all_, toxic = Counter(), Counter()
            for text, y in zip(b["text"], b["y"]):
                words = set(_WORD.findall(text.lower()))
                all_.update(words)
                if y:
                    toxic.update(words)
            yield pd.DataFrame({"word": list(all_), "n": list(all_.values()), "toxic": [toxic[w] for w in all_]})

    words = sample.select("text", "y").mapInPandas(count, "word string, n long, toxic long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    words = materialize(words, "words")
    weight = F.log((F.col("toxic") + 0.5) / (F.col("n") - F.col("toxic") + 0.5))
    found = words.filter((F.col("toxic") >= LEAST_DOCS) & (F.col("toxic") >= LEAST_SHARE * F.col("n")) & (F.length("word") >= 3))
    rows = found.select("word", weight.alias("weight")).orderBy(F.col("weight").desc(), "word").collect()
    terms = {r["word"]: float(min(6.0, r["weight"])) for r in rows}

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(terms, terms)
        for b in batches:
            hits = [(x[0], n, t) for w, n, t in zip(b["word"], b["n"], b["toxic"]) if w not in terms and (x := automaton.match(w))]
            yield pd.DataFrame(hits, columns=["term", "n", "toxic"])

    near_rows = words.mapInPandas(near, "term string, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).collect()
    return terms, fuzzy_weights(terms, {r["term"]: (r["n"], r["toxic"]) for r in near_rows})


def fuzzy_weights(terms: dict[str, float], near: dict[str, tuple[int, int]]) -> dict[str, float]:
    """near: (documents, toxic ones) with words near a term. Without clean ones a misspelling weighs little less than the term."""
    out = {}
    for term, weight in terms.items():
        n, toxic = near.get(term, (0, 0))
        share = weight if n == toxic else np.log((toxic + 0.5) / (n - toxic + 0.5))
        if edits_of(term) and share > 1:
            out[term] = float(FUZZY_WEIGHT * min(weight, share))
    return out


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, parts: int = 5, out: int = 0) -> Model:
    spark = docs.sparkSession
    # copies teach a text once
    sample = training_sample(docs, labels, "toxic", parts, out, rows)
    first = sample.groupBy(F.sha2("text", 256).alias("copy")).agg(F.min("doc_id").alias("doc_id"))
    sample = materialize(sample.join(first.select("doc_id"), "doc_id", "left_semi"), "texts")
    kinds = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(kinds) < 2:
        n, toxic = sum(kinds.values()), kinds.get(1, 0)
        return Model({}, {}, None, (toxic + 1) / (n + 2) if n else 0.5)
    terms, fuzzy = learn_terms(sample)
    model = Model(terms, fuzzy, np.zeros(FEATURES), 0.0)
    shared = spark.sparkContext.broadcast(model)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "x": [shared.value.features(t).tolist() for t in b["text"]]})

    got = sample.select("text", "y").mapInPandas(make, "y int, x array<double>").toPandas()
    x, y = np.array(got["x"].tolist()), got["y"].to_numpy(np.float64)
    weights, base = fit_logistic(x, y, RISING)
    return Model(terms, fuzzy, weights, base)


def score_udf(model: Model, spark):
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(t or "") for t in texts], dtype="float64")

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    prepare(docs.sparkSession)
    model = fit(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, rows)
    out = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col, 5, 0).alias("held_out"), score_udf(model, docs.sparkSession)(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that score below threshold, with all their columns. Without
    labels of both kinds nothing can be told apart: all stay, unless those there
    are say toxic."""
    prepare(docs.sparkSession)
    names = docs.columns
    score = fresh(names, "__toxic")
    model = fit(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, rows)
    scored = docs.withColumn(score, score_udf(model, docs.sparkSession)(F.col(text_col)))
    return scored.filter(F.col(score) < (threshold if model.weights is not None else max(threshold, 0.5 + 1e-9))).select(*names)
