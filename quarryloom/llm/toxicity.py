"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses, and each word of a clause becomes a symbol: INSULT, THREAT, TARGET, NEGATION, REPORT or PLAIN. Five
transducers stand in a row, each reading what the one before it writes: the target transducer finds out which insults and threats
are aimed at somebody; the insult and the threat transducer pay for what is aimed, called out or repeated; the negation
transducer discounts what is paid within three words of a negation, and the report transducer what is
paid after a verb of report. They are composed into one machine beforehand. An insult word by itself pays next to nothing; a
document's score is a logistic function of its matched clauses' weights.

Which words are insults is learned: labelled texts are counted by word and by word beginning, and those with
enough evidence become arcs of the insult transducer; copies of a text count once. Small closed classes (targets, negations, verbs of
report, threats) are fixed values. The fit takes at most MAX_LABELLED labelled texts, chosen by a hash of
their text's id, whatever the size of the corpus.

Null, empty and blank texts have no clauses and get the score of a text without evidence, below 0.5. A score of exactly 0.5
is predicted toxic. Repeated rows get equal scores; null ids are scored like others. Without labels, or with labels of one kind only, the seed words alone are the
grammar. Empty tables give no rows. Columns other than those named are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import beside, small_batches

MAX_LABELLED = 20_000
#: Word beginnings of these many letters can be arcs.
STEMS = range(4, 8)

#: Seed insults, and the closed classes in English, German, French and Spanish.
SEED_INSULTS = frozenset("idiot moron loser scum trash clown pathetic worthless disgusting stupid dumb fool imbecile jerk".split())
THREATS = frozenset("kill hurt destroy punch stab shoot burn beat strangle töten schlagen tuer frapper matar golpear".split())
TARGETS = frozenset("you your yours u he she they them him her people du ihr sie dich euch tu vous toi te ils usted tú ellos ustedes".split())
NEGATIONS = frozenset("not no never none nobody cannot isnt arent wasnt aint dont doesnt didnt wont kein keine keinen keiner nicht nie niemals pas jamais nunca ningún".split())
REPORTS = frozenset("said says called quoted wrote reported claims sagte nannte schrieb dit écrit appelé dijo llamó escribió".split())

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]")
INSULT, THREAT, TARGET, NEGATION, REPORT, PLAIN = range(6)
#: Written by the target transducer besides: an insult after its target; a target after an insult, after a threat. PAY ends in the score.
AIMED, AIMS_INSULT, AIMS_THREAT, PAY = range(6, 10)


#: Words that may stand between a target and an insult after it; an insult and a target after it; a threat and its target.
TO_INSULT, FROM_INSULT, TO_TARGET = 3, 1, 2
#: How many words a negation governs.
SCOPE = 3
#: Weights: an insult after its target, a target after an insult, an insult that begins its clause, one that follows another
#: in its clause, one by itself; a threat at a target; factors of what is negated and what is reported.
W_AIMED, W_AIMS, W_CALLED, W_REPEATED, W_ALONE, W_THREAT = 1.5, 1.0, 1.0, 1.0, 0.25, 1.5
NEGATED, REPORTED = 0.5, 0.6

State = tuple
#: A transducer: (state, symbol read) to (next state, symbol written, weight); () is the first state. States are finite by construction.
Transducer = Callable[[State, int], tuple[State, int, float]]


def target(state: State, symbol: int) -> tuple[State, int, float]:
    """State: what was last seen (a target, an insult or a threat) and how many words ago, as long as it can still matter."""
    seen, ago = state or (PLAIN, 0)
    if symbol == TARGET:
        if seen == INSULT and ago <= FROM_INSULT:
            return (TARGET, 0), AIMS_INSULT, 1.0
        return (TARGET, 0), AIMS_THREAT if seen == THREAT and ago <= TO_TARGET else TARGET, 1.0
    if symbol == INSULT:
        return (INSULT, 0), AIMED if seen == TARGET and ago <= TO_INSULT else INSULT, 1.0
    if symbol == THREAT:
        return (THREAT, 0), THREAT, 1.0
    ago += 1
    return ((seen, ago) if seen != PLAIN and ago <= TO_INSULT else (PLAIN, 0)), symbol, 1.0


def insult(state: State, symbol: int) -> tuple[State, int, float]:
    """State: whether the clause has begun, and whether it has had an insult."""
    begun, had = state or (False, False)
    if symbol == AIMED:
        return (True, True), PAY, W_AIMED
    if symbol == AIMS_INSULT:
        return (True, had), PAY, W_AIMS
    if symbol == INSULT:
        return (True, True), PAY, W_REPEATED if had else W_ALONE if begun else W_CALLED
    return (True, had), symbol, 1.0


def threat(state: State, symbol: int) -> tuple[State, int, float]:
    return (), *((PAY, W_THREAT) if symbol == AIMS_THREAT else (symbol, 1.0))


def negation(state: State, symbol: int) -> tuple[State, int, float]:
    """State: how many words are still governed."""
    left = state[0] if state else 0
    if symbol == NEGATION:
        return (SCOPE,), symbol, 1.0
    return (max(left - 1, 0),), symbol, NEGATED if left and symbol == PAY else 1.0


def report(state: State, symbol: int) -> tuple[State, int, float]:
    """State: whether a verb of report came before."""
    told = bool(state and state[0])
    return (told or symbol == REPORT,), symbol, REPORTED if told and symbol == PAY else 1.0


GRAMMAR: tuple[Transducer, ...] = (target, insult, threat, negation, report)


class Machine:
    """The transducers composed: a state for each combination of theirs that can be reached, an arc for each symbol of a
    clause; an arc weighs the product of theirs if PAY is what the last one writes, else nothing."""

    def __init__(self, grammar: tuple[Transducer, ...] = GRAMMAR) -> None:
        start: tuple[State, ...] = ((),) * len(grammar)
        number, todo = {start: 0}, [start]
        self.next: list[list[int]] = []
        self.weight: list[list[float]] = []
        while len(self.next) < len(todo):
            states = todo[len(self.next)]
            targets, weights = [], []
            for read in range(PLAIN + 1):
                after, symbol, weight = [], read, 1.0
                for transducer, state in zip(grammar, states, strict=True):
                    state, symbol, factor = transducer(state, symbol)
                    after.append(state)
                    weight *= factor
                if tuple(after) not in number:
                    number[tuple(after)] = len(todo)
                    todo.append(tuple(after))
                targets.append(number[tuple(after)])
                weights.append(weight if symbol == PAY else 0.0)
            self.next.append(targets)
            self.weight.append(weights)

    def clause(self, symbols: Iterable[int]) -> float:
        state, total = 0, 0.0
        for symbol in symbols:
            total += self.weight[state][symbol]
            state = self.next[state][symbol]
        return total


#: States, weights and links do not depend on what is learned.
MACHINE = Machine()


@dataclass
class Grammar:
    """Learned arcs, and the weights of the logistic function of a document's three figures."""

    words: dict[str, float]
    stems: dict[str, float]
    weights: tuple[float, float] = (-2.0, 2.0)

    def __post_init__(self) -> None:
        self.machine = MACHINE
        self._seen: dict[str, tuple[int, float]] = {}

    def symbol(self, word: str) -> tuple[int, float]:
        """A word's symbol, and for an insult the weight of its arc."""
        weight = self.words.get(word, 0.0)
        for n in STEMS:
            if len(word) < n:
                break
            weight = max(weight, self.stems.get(word[:n], 0.0))
        if weight > 0:
            return INSULT, weight
        if word.endswith("n't"):
            return NEGATION, 1.0
        for symbol, members in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            if word in members:
                return symbol, 1.0
        return PLAIN, 1.0

    def classes(self, words: Iterable[str]) -> list[tuple[int, float]]:
        """symbol() of every word, remembered for the words of a batch."""
        seen, out = self._seen, []
        for word in words:
            got = seen.get(word)
            if got is None:
                got = seen[word] = self.symbol(word)
            out.append(got)
        if len(seen) > 100_000:
            seen.clear()
        return out

    def figures(self, text: str | None) -> tuple[float, float, float]:
        """The heaviest clause, the logarithm of one plus all clauses' weights, and of one plus how many matched."""
        if not text:
            return 0.0, 0.0, 0.0
        words = WORD.findall(text.lower().replace("’", "'"))
        classes = self.classes(words)
        paying = [i for i, (s, _) in enumerate(classes) if s == INSULT or s == THREAT]
        most = total = 0.0
        matched, done = 0, -1
        for i in paying:
            if i <= done:
                continue
            low, high = i, i
            while low > 0 and words[low - 1] not in ".!?;:\n":
                low -= 1
            while high + 1 < len(words) and words[high + 1] not in ".!?;:\n":
                high += 1
            done = high
            weight = self.machine.clause(s for s, _ in classes[low : high + 1])
            if weight > 0:
                weight *= max(w for s, w in classes[low : high + 1] if s in (INSULT, THREAT))
                most, total, matched = max(most, weight), total + weight, matched + 1
        return most, float(np.log1p(total)), float(np.log1p(matched))

    def score(self, figures: tuple[float, float, float]) -> float:
        z = self.weights[0] + self.weights[1] * evidence(figures)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def evidence(figures: tuple[float, float, float]) -> float:
    most, total, matched = figures
    return most + total + 0.5 * matched


SEEDED = Grammar({w: 1.0 for w in SEED_INSULTS}, {})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, kind, toxic, clean): in how many labelled texts of each kind a word or a word beginning is, summed per task."""
    counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = {w for w in WORD.findall((text or "").lower()) if w[0].isalpha()}
            terms = {f"={w}" for w in words} | {w[:n] for w in words for n in STEMS if len(w) >= n}
            counts[bool(toxic)].update(terms)
            if len(counts[0]) + len(counts[1]) > 150_000:
                yield _counts_batch(counts)
                counts[0].clear()
                counts[1].clear()
    yield _counts_batch(counts)


def _counts_batch(counts: tuple[Counter[str], Counter[str]]) -> pa.RecordBatch:
    terms = list(counts[0].keys() | counts[1].keys())
    return pa.RecordBatch.from_arrays(
        [pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())],
        names=["term", "toxic", "clean"],
    )


def learn(labelled: DataFrame, *, max_labelled: int = MAX_LABELLED, min_texts: int = 3, max_candidates: int = 2_000) -> Grammar:
    """labelled: columns text, toxic (0 or 1), and a hash to choose by. Candidates are words and word beginnings that
    are in min_texts toxic texts at least and in hardly any clean one; arcs are those of them that explain the toxic texts."""
    bounded = labelled.orderBy("pick").limit(max_labelled).select("text", F.col("toxic").cast("int").alias("toxic"))
    bounded = bounded.dropDuplicates(["text"]).repartition(bounded.sparkSession.sparkContext.defaultParallelism).persist()
    try:
        sizes = dict(bounded.groupBy("toxic").count().collect())
        toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
        if not toxic or not clean:
            return SEEDED
        counts = bounded.mapInArrow(_counted, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        rate = (F.col("toxic") + 0.5) / (toxic + 1.0)
        odds = F.log(rate / ((F.col("clean") + 0.5) / (clean + 1.0)))
        strong = counts.where((F.col("toxic") >= max(min_texts, toxic // 500)) & (F.col("toxic") >= 20 * F.col("clean") * toxic / float(clean))).select("term", odds.alias("odds"), "toxic")
        best = strong.where("odds >= 2.5").orderBy(F.desc(F.col("odds") * F.col("toxic")), "term").limit(max_candidates).collect()
        candidates = {r["term"]: i for i, r in enumerate(best)}
        held = bounded.where("toxic = 1").mapInArrow(lambda batches: _holding(batches, candidates), "held array<int>")
        chosen = _explaining([r[0] for r in held.collect()], np.array([r["odds"] for r in best]), max(2.0, 0.004 * toxic))  # at most max_labelled rows
        words, stems = {w: 1.0 for w in SEED_INSULTS}, {}
        for i in chosen:
            term, weight = best[i]["term"], min(1.5, float(best[i]["odds"]) / 4)
            if term.startswith("="):
                words[term[1:]] = weight
            else:
                stems[term] = weight
        grammar = Grammar(words, stems)
        figures = bounded.mapInArrow(lambda batches: _figures(batches, grammar), "evidence double, toxic int")
        return _with_weights(grammar, figures.groupBy(F.round("evidence", 2).alias("evidence"), "toxic").count().collect())
    finally:
        bounded.unpersist()


def _holding(batches: Iterator[pa.RecordBatch], candidates: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Which candidates each text has."""
    for batch in batches:
        rows = []
        for text in batch.column(0).to_pylist():
            words = {w for w in WORD.findall((text or "").lower()) if w[0].isalpha()}
            terms = {f"={w}" for w in words} | {w[:n] for w in words for n in STEMS if len(w) >= n}
            rows.append(sorted(candidates[t] for t in terms if t in candidates))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32()))], names=["held"])


def _explaining(texts: list[list[int]], odds: np.ndarray, least: float) -> list[int]:
    """Candidates, chosen greedily: each explains most of what is left of the toxic texts. A text counts for less with each
    arc that it has, so the words that happen to be shared by a family of similar toxic texts are not chosen."""
    sizes = [len(held) for held in texts]
    row, arc = np.repeat(np.arange(len(texts)), sizes), np.fromiter((i for held in texts for i in held), np.int64, sum(sizes))
    left, open_, chosen = np.ones(len(texts)), np.ones(len(odds), bool), []
    while open_.any():
        gain = np.bincount(arc, left[row], len(odds)) * open_
        i = int((gain * odds).argmax())
        if gain[i] < least:
            break
        chosen.append(i)
        left[row[arc == i]] *= 0.4
        open_[i] = False
    return chosen


def _figures(batches: Iterator[pa.RecordBatch], grammar: Grammar) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [evidence(grammar.figures(x)) for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.float64()), batch.column(1).cast(pa.int32())], names=["evidence", "toxic"])


def _with_weights(grammar: Grammar, rows: list) -> Grammar:
    """Logistic regression of the label on the evidence, held by a ridge, by Newton's method with halved steps."""
    x = np.array([[1.0, r[0]] for r in rows])
    y, n = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    n *= np.where(y == 1, 500 / n[y == 1].sum(), 500 / n[y == 0].sum())  # both kinds weigh the same
    ridge, w = np.diag([0.1, 1.0]), np.zeros(2)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(n @ (np.logaddexp(0, z) - y * z) + w @ ridge @ w / 2)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (n * (y - p)) - ridge @ w)
        while loss(w + step) > loss(w) + 1e-12 and np.abs(step).max() > 1e-9:
            step /= 2
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return Grammar(grammar.words, grammar.stems, (float(w[0]), float(max(w[1], 0.1))))


def _scored(batches: Iterator[pa.RecordBatch], grammar: Grammar) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        figures = [grammar.figures(x.as_py()) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array([grammar.score(f) for f in figures], pa.float64()), pa.array([f[0] for f in figures], pa.float64()), pa.array([int(round(np.expm1(f[2]))) for f in figures], pa.int64())],
            names=["doc_id", "score", "heaviest_clause", "n_clauses"],
        )


def held_out(doc_id) -> F.Column:
    """Of these rows no label is ever used."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame) -> Grammar:
    """The grammar learned from the labelled rows that are not held out."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("toxic")).where(F.col("toxic").isNotNull() & ~held_out(F.col("_id")))
    known = known.withColumn("pick", F.xxhash64(F.col("_id"))).orderBy("pick").limit(MAX_LABELLED)
    return learn(docs.select(F.col("doc_id").alias("_doc"), "text").join(F.broadcast(known), F.col("_doc") == F.col("_id")).select("text", "toxic", "pick"))


SCORES = "doc_id long, score double, heaviest_clause double, n_clauses long"


def scores(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, score, heaviest_clause and n_clauses of every document."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda batches: _scored(batches, grammar), SCORES)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = scores(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_clauses")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns. Each row is judged where it is read, whatever its id."""
    grammar = fit(docs, labels)
    return beside(docs, lambda batches: _scored(batches, grammar), SCORES).where(F.col("score") < threshold).select("row.*")
