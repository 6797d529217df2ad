"""Toxicity by a lexicon trie that is read through a Levenshtein automaton, with context windows.

Learning: of at most ``ROWS_PER_CLASS`` labelled rows of each class (those with the smallest id
hash, held-out documents excepted), Spark counts in how many toxic and clean texts each word
occurs, equal texts once.  A word that chance would hardly make so toxic (the Chernoff bound of
its binomial tail, times all words tried, is below ``CHANCE``) is a term; such a prefix, if
several words share it, is a stem and stands for all words it begins.  At most ``LEXICON``
entries are kept.  A ridge logistic regression on the same rows weighs a text's hits, each
distinct word by its entry's log odds, and the text's length, since long texts hit by chance.

Matching: the trie of the terms is intersected with the Levenshtein automaton by walking the
set of (trie node, errors spent) pairs; each set met becomes a state of a deterministic automaton
whose transitions are kept.  Long terms may have more errors than short ones, stems none.
A hit between quotation marks or near a word of reporting counts as quotation, with its own weight.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchloom.llm.common import held, held_out, pick
from benchloom.session import cut

ROWS_PER_CLASS = 12_000
LEXICON = 20_000
CHANCE = 0.05
ODDS = 4.0  # least odds ratio of an entry
STEM_LETTERS = (3, 8)
STEM_WORDS = 4
WINDOW = 8
CACHED_WORDS = 300_000
STATES = 20_000
SPLIT = r"[\s.,;:!?\"()\[\]{}<>|/\\%&$#*“”„«»]+"

# Words of reporting, in the languages of Western Europe, and quotation marks.
REPORTING = frozenset(
    "said says wrote writes quote quoted quotes called word words term terms insult insults "
    "sagte sagt schrieb zitat wort begriff nannte dit écrit citation mot terme dijo dice escribió cita palabra término".split()
)
QUOTES = "\"'“”„«»‘’‚"


def allowed(term: str) -> int:
    """Errors a term may have."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """The lexicon's trie times the Levenshtein automaton, made deterministic as words pass through."""

    def __init__(self, terms: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[bool] = [False]
        self.room = [0]  # the most errors any term below a node may have
        for word, is_stem in [(t, False) for t in terms] + [(s, True) for s in stems]:
            self._add(word, is_stem)
        self._reset()

    def _add(self, word: str, is_stem: bool) -> None:
        node, errors = 0, 0 if is_stem else allowed(word)
        self.room[0] = max(self.room[0], errors)
        for letter in word:
            if letter not in self.children[node]:
                self.children[node][letter] = len(self.children)
                self.children.append({})
                self.term.append(None)
                self.stem.append(False)
                self.room.append(0)
            node = self.children[node][letter]
            self.room[node] = max(self.room[node], errors)
        if is_stem:
            self.stem[node] = True
        self.term[node] = word

    def _reset(self) -> None:
        self.states: list[dict[int, int]] = []
        self.numbers: dict[tuple, int] = {}
        self.next: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.stems: list[str | None] = []
        self.start = self._number(self._close({0: 0}))

    def _close(self, state: dict[int, int]) -> dict[int, int]:
        """Adds what skipping letters of the lexicon reaches."""
        queue = list(state.items())
        while queue:
            node, errors = queue.pop()
            for child in self.children[node].values():
                if errors + 1 <= self.room[child] and state.get(child, 9) > errors + 1:
                    state[child] = errors + 1
                    queue.append((child, errors + 1))
        return state

    def _number(self, state: dict[int, int]) -> int:
        key = tuple(sorted(state.items()))
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(state)
            self.next.append({})
            ends = [(errors, self.term[n]) for n, errors in state.items() if self.term[n] and errors <= (0 if self.stem[n] else allowed(self.term[n]))]
            self.accepts.append((lambda e: (e[1], e[0]))(min(ends)) if ends else None)
            self.stems.append(next((n for n, errors in state.items() if self.stem[n] and not errors), None))
        return self.numbers[key]

    def _step(self, number: int, letter: str) -> int:
        out: dict[int, int] = {}

        def put(node: int, errors: int) -> None:
            if errors <= self.room[node] and out.get(node, 9) > errors:
                out[node] = errors

        for node, errors in self.states[number].items():
            put(node, errors + 1)
            for edge, child in self.children[node].items():
                if edge == letter:
                    if out.get(child, 9) > errors:
                        out[child] = errors
                else:
                    put(child, errors + 1)
        to = self._number(self._close(out))
        self.next[number][letter] = to
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its allowance, an exact one before the longest stem, a stem before misspellings."""
        if len(self.states) > STATES:
            self._reset()
        at, step, stem = self.start, self.next, None
        for letter in word:
            to = step[at].get(letter)
            at = self._step(at, letter) if to is None else to
            if self.stems[at] is not None:
                stem = self.stems[at]
            if not self.states[at]:
                break
        found = self.accepts[at]
        return (self.term[stem], 0) if stem is not None and (found is None or found[1]) else found


@dataclass
class Model:
    """What is learned: log odds of terms and stems, and weights of (1, abuse, quoted, misspelled, both, length)."""

    terms: dict[str, float]
    stems: dict[str, float]
    weights: tuple[float, ...] = (-4.0, 1.0, 0.4, 0.5, 0.2, 0.0)


class Scanner:
    def __init__(self, model: Model):
        self.automaton, self.weights = Automaton(list(model.terms), list(model.stems)), np.array(model.weights)
        self.odds = model.stems | model.terms
        self.clean: set[str] = set()
        self.split = re.compile(SPLIT)

    def hits(self, text: str | None) -> list[tuple[int, str, str, int, bool]]:
        """(word number, word, term, distance, quoted) of every hit."""
        words = self.split.split((text or "").lower())
        found = {}
        for word in set(words).difference(self.clean):
            term = self.automaton.match(word.strip("'’‘-_")) if word else None
            if term:
                found[word] = term
            else:
                if len(self.clean) >= CACHED_WORDS:
                    self.clean.clear()
                self.clean.add(word)
        if not found:
            return []
        raw = text.lower()
        spans = [m.start() for m in self.split.finditer(raw)] + [len(raw)]
        return [(k, w, *found[w], self._quoted(raw, words, spans, k)) for k, w in enumerate(words) if w in found]

    def _quoted(self, raw: str, words: list[str], ends: list[int], k: int) -> bool:
        """In the window: a mark opens before the word and one closes after it, or a word of reporting stands."""
        first, last = max(0, k - WINDOW), min(len(words), k + WINDOW + 1)
        if REPORTING.intersection(words[first:k]) or REPORTING.intersection(words[k + 1 : last]):
            return True
        end = ends[k]
        before = raw[ends[first - 1] if first else 0 : end - len(words[k])]
        after = raw[end : ends[last - 1]]
        opened = sum(before.count(q) for q in '"“„«')
        return opened > 0 and before.count('"') % 2 + sum(before.count(q) for q in "“„«") > sum(before.count(q) for q in "”»") and any(q in after for q in '"”»“')

    def features(self, text: str | None) -> np.ndarray:
        out, best = np.zeros(4), {}
        for _, word, term, distance, quoted in self.hits(text):
            kind = (2 if distance else 0) + quoted
            best[word] = min(best.get(word, (9, "")), (kind, term))
        for kind, term in best.values():
            out[kind] += self.odds[term]
        return np.concatenate([[1.0], out, [np.log1p(len(text or "")) if best else 0.0]])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-self.features(text) @ self.weights)))


def _scanner(model: Model) -> Scanner:
    return held(("toxicity", tuple(model.terms.items()), tuple(model.stems.items()), tuple(model.weights)), lambda: Scanner(model))


def score(text: Column, model: Model) -> Column:
    """Score 0 to 1 of a whole text; null and empty texts get that of a text without hits."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _scanner(model)
        for texts in batches:
            yield pa.array([own.score(t.as_py()) for t in texts], pa.float64())

    return run(text.cast("string"))


def hits(text: Column, model: Model) -> Column:
    """The hits of a whole text as array<struct<word_no, word, term, distance, quoted>>; empty for null."""
    kind = "array<struct<word_no:int,word:string,term:string,distance:int,quoted:boolean>>"
    fields = pa.struct([("word_no", pa.int32()), ("word", pa.string()), ("term", pa.string()), ("distance", pa.int32()), ("quoted", pa.bool_())])

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _scanner(model)
        for texts in batches:
            yield pa.array([[dict(zip(("word_no", "word", "term", "distance", "quoted"), h, strict=True)) for h in own.hits(t.as_py())] for t in texts], pa.list_(fields))

    return run(text.cast("string"))


def _features(text: Column, model: Model) -> Column:
    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        own = _scanner(model)
        return pa.array([own.features(t.as_py()).tolist() for t in texts], pa.list_(pa.float64()))

    return run(text)


def learn(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """The model from rows of ``docs`` (doc_id, text) with a label (doc_id, toxic) outside the held-out fifth.

    Null ids and labels teach nothing.  A document labelled twice counts as toxic if one label
    says so.  Without toxic rows the lexicon is empty and every score is alike.
    """
    spark = docs.sparkSession
    marks = pick(labels, doc_id="bigint", toxic="int").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [marks.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class) for k in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1]).select(F.col("doc_id").alias("i"), "toxic")
    rows = pick(docs, doc_id="bigint", text="string").join(F.broadcast(chosen), F.col("doc_id") == F.col("i"))  # 2 * rows_per_class ids
    rows = cut(rows.select("toxic", "text").distinct(), "labelled")
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), SPLIT))
    counted = rows.select("toxic", F.explode(F.array_append(words, F.lit(None).cast("string"))).alias("word"))  # the null row counts the documents
    table = counted.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    table = table.filter("word is null or t > 0 or length(word) >= 4").persist()
    totals = table.filter("word is null").first()
    if not totals or not totals.t:
        table.unpersist()
        return Model({}, {})
    n_t, n_c = int(totals.t), int(totals.c)

    named = table.filter("word is not null and word <> ''")
    lengths = F.sequence(F.lit(STEM_LETTERS[0]), F.least(F.lit(STEM_LETTERS[1]), F.length("word") - 1))
    parts = named.filter(F.length("word") > STEM_LETTERS[0]).select("t", "c", F.explode(F.transform(lengths, lambda n: F.substring("word", F.lit(1), n))).alias("word"))
    stems = parts.groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count(F.when(F.col("t") > 0, 1)).alias("k")).filter(F.col("k") >= STEM_WORDS)

    def best(df: DataFrame, tried: int) -> dict[str, float]:
        """Entries by strength: how surely, then how much more toxic than the sample they are."""
        t, c, p = F.col("t"), F.col("c"), n_t / (n_t + n_c)
        n = t + c
        surprise = t * F.log(t / (n * p)) + F.when(c > 0, c * F.log(c / (n * (1 - p)))).otherwise(0.0)
        ranked = df.filter((t > 0) & (t / n > p)).withColumn("o", surprise)
        ranked = ranked.filter((F.col("o") >= float(np.log(max(tried, 1) / CHANCE))) & (t * (n_c + 1.0) >= ODDS * c * (n_t + 1.0)))
        odds = F.log((t + 0.5) * (n_c + 1.0) / ((c + 0.5) * (n_t + 1.0)))
        return {r.word: r.odds for r in ranked.orderBy(F.desc("o"), "word").select("word", odds.alias("odds")).limit(LEXICON // 2).collect()}

    n_words, n_stems = named.filter("t > 0").count(), stems.count()
    likely = F.broadcast(spark.createDataFrame([(s,) for s in best(stems, n_stems)], "word string"))  # at most half of LEXICON
    begun = rows.select("toxic", F.xxhash64("text").alias("doc"), F.explode(words).alias("whole")).filter(F.length("whole") > STEM_LETTERS[0])
    lengths = F.sequence(F.lit(STEM_LETTERS[0]), F.least(F.lit(STEM_LETTERS[1]), F.length("whole") - 1))
    begun = begun.select("toxic", "doc", F.explode(F.transform(lengths, lambda n: F.substring("whole", F.lit(1), n))).alias("word")).join(likely, "word").distinct()
    exact = begun.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))  # documents, not words
    model = Model(best(named, n_words), best(exact, n_stems))
    table.unpersist()
    seen = rows.select("toxic", _features(F.col("text"), model).alias("x")).groupBy("toxic", "x").count().collect()  # at most 2 * rows_per_class rows
    model.weights = _fit(np.array([r.x for r in seen]), np.array([float(r.toxic) for r in seen]), np.array([float(r["count"]) for r in seen]), np.array(model.weights))
    return model


def _fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, prior: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[float, ...]:
    """Logistic regression by Newton steps, drawn to the weights given; hits never speak for a clean text."""

    def loss(w: np.ndarray) -> float:
        return float(n @ np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w)) + ridge / 2 * ((w - prior) ** 2).sum())

    w, now = prior.copy(), loss(prior)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + ridge * (w - prior)
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + ridge * np.eye(len(w)), gradient)
        for halvings in range(20):
            trial = w - step / 2**halvings
            trial[1:5] = np.maximum(trial[1:5], 0.0)
            if loss(trial) < now - 1e-9:
                break
        else:
            break
        w, now = trial, loss(trial)
    return tuple(float(v) for v in w)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; repeated rows and null ids come out as they went in."""
    rows = pick(docs, doc_id="bigint", text="string")
    scored = rows.select("doc_id", score(F.col("text"), model).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
