"""Quality rules as weak supervision.

Each rule looks at counts of one document and votes good (1), bad (-1) or abstains (0). The votes of all
documents are counted by pattern (at most 3**rules rows, whatever the input), and expectation-maximisation
over those counts estimates each rule's accuracies and the share of good documents without labels. The
posterior probability of a document's pattern replaces an all-must-pass filter: votes of a rule that often goes off on good
documents weigh little, and many good votes can outweigh them.

Null, empty and blank texts have no words: every rule abstains but the one on length, and the base test
rejects them. Rows are judged one by one, so ties, null ids and repeated rows do not matter. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import beside, small_batches
from .text import SPACED, Words, WordScanner, row_chunks, string_bytes, window_hashes

REPEAT_WINDOW = 8
MIN_WORDS = 20
SYMBOLS = b"#*$%&|<>"

STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_letters long, n_word_pairs_equal long, n_distinct_words long"


def _count(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _duplicate_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    again = 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\n\r\x0b\x0c"):
            if line in seen:
                again += 1
            seen.add(line)
    return again


def _repeated(words: Words) -> np.ndarray:
    """For each row, how many words are in windows that the row has twice or more."""
    rows, n = words.last - words.first, len(words.hashes)
    out = np.zeros(rows, np.int64)
    keys = window_hashes(words.hashes, REPEAT_WINDOW)
    if not len(keys):
        return out
    at = np.flatnonzero(np.arange(len(keys)) + REPEAT_WINDOW <= words.ends()[: len(keys)])
    row = np.repeat(np.arange(rows), words.counts)[at]
    order = np.lexsort((keys[at], row))
    k, r = keys[at][order], row[order]
    same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(n + 1, np.int64)
    begin = at[order[twice]]
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + REPEAT_WINDOW, -1)
    return _count(np.cumsum(cover)[:n] > 0, words.bounds)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = WordScanner(SPACED, fold_case=False)
    symbol, upper, letter = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    upper[0x41:0x5B] = True
    letter[0x41:0x5B] = letter[0x61:0x7B] = letter[0xC3:] = True  # and the first bytes of other scripts
    names = [x.split()[0] for x in STATS.split(",")]
    for batch in batches:
        data, offsets = string_bytes(batch.column(1))
        for words in scanner.scan(batch.column(1)):
            first, last = words.first, words.last
            counts = {c: np.zeros(last - first, np.int64) for c in ("chars", "symbols", "upper", "letters")}
            for a, b in row_chunks(offsets[first : last + 1]):
                low, high = int(offsets[first + a]), int(offsets[first + b])
                for at in range(low, high, 1 << 22) if b - a == 1 else (low,):
                    to = min(high, at + (1 << 22)) if b - a == 1 else high
                    part = data[at:to]
                    where = np.array([0, to - at]) if b - a == 1 else offsets[first + a : first + b + 1] - low
                    counts["chars"][a:b] += _count(SPACED[part] & ((part & 0xC0) != 0x80), where)
                    for name, bytes_ in (("symbols", symbol), ("upper", upper), ("letters", letter)):
                        counts[name][a:b] += _count(bytes_[part], where)
            lines = [_duplicate_lines(data[offsets[i] : offsets[i + 1]].tobytes()) for i in range(first, last)]
            h, ends = words.hashes, words.ends()
            equal = np.zeros(len(h), bool)
            if len(h) > 1:
                equal[:-1] = (h[1:] == h[:-1]) & (np.arange(1, len(h)) < ends[:-1])
            row = np.repeat(np.arange(last - first), words.counts)
            order = np.lexsort((h, row))
            new = np.ones(len(h), bool)
            if len(h) > 1:
                new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
            columns = [words.counts, counts["chars"], counts["symbols"], np.array(lines, np.int64), _repeated(words), counts["upper"], counts["letters"], _count(equal, words.bounds), _count(new, words.bounds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], names=names)


def text_stats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_stats, STATS)


def _vote(good: Column, bad: Column) -> Column:
    return F.coalesce(F.when(bad, F.lit(-1)).when(good, F.lit(1)), F.lit(0))


def rules() -> dict[str, Column]:
    """Votes by name. Thresholds leave a band in which a rule abstains."""
    c = F.col
    words = c("n_words")
    some = words > 0
    return {
        "length": _vote(words >= 40, words < 10),
        "symbols": _vote(some & (c("n_symbols") * 50 <= words), some & (c("n_symbols") * 5 > words)),
        "capitals": _vote((c("n_letters") > 0) & (c("n_upper") * 5 <= c("n_letters")), c("n_upper") * 2 > c("n_letters")),
        "repeats": _vote(some & (c("n_repeat_words") * 50 <= words), some & (c("n_repeat_words") * 10 > 3 * words)),
        "stutter": _vote(some & (c("n_word_pairs_equal") * 25 <= words), some & (c("n_word_pairs_equal") * 5 > words)),
        # A text's different words grow about as a power of its length, so both bounds do: no length is beyond the rule.
        "variety": _vote((words >= 20) & (c("n_distinct_words") >= 2 * F.pow(words.cast("double"), 0.6)), (words >= 20) & (c("n_distinct_words") < F.sqrt(words.cast("double")))),
        "letters": _vote((c("word_chars") > 0) & (c("n_letters") * 20 >= 17 * c("word_chars")), (c("word_chars") > 0) & (c("n_letters") * 3 < 2 * c("word_chars"))),
        "lines": _vote(c("n_dup_lines") == 0, c("n_dup_lines") * 12 > words),
        "word_size": _vote(some & (c("word_chars") >= 3 * words) & (c("word_chars") <= 12 * words), (c("word_chars") < 2 * words) | (c("word_chars") > 20 * words)),
    }


class LabelModel:
    """A latent class model of the votes: a class of good documents, and one of bad documents for each rule, of the defect that the
    rule looks for. In each class a rule that votes says bad with its own chance, independently of the others; abstaining says nothing.
    Shares and chances are fitted by expectation-maximisation on counts of patterns, all of them free.

    Defects seldom come together, so with a single bad class the commonest defect would be all that it learns. But a rule
    that goes off at random on good documents could then pass for a defect of its own. What tells them apart is whether other rules
    agree: where documents that a rule votes bad have other bad votes no oftener than those that it votes good, by a Bayes
    factor of EVIDENCE, the rule gets no class of its own, and its bad votes are false alarms, whose rate is fitted, and weigh accordingly.

    A bad vote never speaks for a document: no defect has a smaller chance of one than good documents have.
    STRENGTH pseudo-documents at the start's chances keep estimates defined for small and empty tables.
    """

    #: At the start: share of good documents; chances of a bad vote on good documents, by a defect's own rule, by the others.
    SHARE, GOOD, OWN, OTHERS = 0.85, 0.005, 0.95, 0.05
    STRENGTH, EVIDENCE = 20.0, 10.0

    def __init__(self, rounds: int = 200, tolerance: float = 1e-9, evidence: float = EVIDENCE):
        self.rounds, self.tolerance, self.evidence = rounds, tolerance, evidence
        #: The rules that have a class of their own; shares and chances have a row for good documents, then one for each of them.
        self.defects: list[int] = []
        self.shares, self.chances = np.ones(1), np.empty((1, 0))

    def fit(self, patterns: np.ndarray, counts: np.ndarray) -> LabelModel:
        self.defects = [r for r in range(patterns.shape[1]) if self._unsupported(r, patterns, counts) <= np.log(self.evidence)]
        self._climb(patterns, counts)
        return self

    def _unsupported(self, rule: int, patterns: np.ndarray, counts: np.ndarray) -> float:
        """Logarithm of the Bayes factor for other rules not caring about this one's bad votes, against a share of its documents getting
        another bad vote besides by the chances of the start."""
        other = np.delete(patterns < 0, rule, axis=1).any(axis=1)
        said_bad, said_good = patterns[:, rule] < 0, patterns[:, rule] > 0
        n, k = counts[said_bad].sum(), counts[said_bad & other].sum()
        usual = (counts[said_good & other].sum() + 0.5) / (counts[said_good].sum() + 1)
        share = 1 - (1 - self.OTHERS) ** (patterns.shape[1] - 1)
        q = (np.arange(400) + 0.5) / 400
        prior = (share * self.STRENGTH - 1) * np.log(q) + ((1 - share) * self.STRENGTH - 1) * np.log(1 - q)
        prior -= np.logaddexp.reduce(prior)
        p = usual + (1 - usual) * q
        return float(k * np.log(usual) + (n - k) * np.log(1 - usual) - np.logaddexp.reduce(prior + k * np.log(p) + (n - k) * np.log(1 - p)))

    def _start(self, rules: int) -> np.ndarray:
        start = np.full((len(self.defects) + 1, rules), self.OTHERS)
        start[0] = self.GOOD
        start[np.arange(1, len(start)), self.defects] = self.OWN
        return start

    def _climb(self, patterns: np.ndarray, counts: np.ndarray) -> None:
        """Expectation-maximisation."""
        start = self.chances = self._start(patterns.shape[1])
        prior = self.shares = np.array([self.SHARE] + [(1 - self.SHARE) / max(1, len(self.defects))] * len(self.defects))
        prior = self.shares = prior / prior.sum()
        bad, cast = (patterns < 0).astype(float), (patterns != 0).astype(float)
        for _ in range(self.rounds):
            held = (self.classes(patterns) * counts[:, None]).T
            chances = (held @ bad + self.STRENGTH * start) / (held @ cast + self.STRENGTH)
            chances[1:] = np.maximum(chances[1:], chances[0])
            moved = np.abs(chances - self.chances).max(initial=0)
            self.chances, self.shares = chances, (held.sum(axis=1) + self.STRENGTH * prior) / (counts.sum() + self.STRENGTH)
            if moved < self.tolerance:
                break

    def accuracies(self) -> np.ndarray:
        """Of each rule: the probability that its vote is right, for good votes and for bad ones (two rows)."""
        good, all_ = self.shares[0] * self.chances[0], self.shares @ self.chances
        return np.stack([(self.shares[0] - good) / (1 - all_), 1 - good / all_])

    def classes(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of each class (a column; the first is good) for documents with these votes."""
        logs = np.log(self.shares) + (patterns < 0) @ np.log(self.chances).T + (patterns > 0) @ np.log(1 - self.chances).T
        odds = np.exp(logs - logs.max(axis=1, keepdims=True, initial=-np.inf))
        return odds / odds.sum(axis=1, keepdims=True)

    def p_good(self, patterns: np.ndarray) -> np.ndarray:
        return self.classes(patterns)[:, 0]


def _voted(stats: DataFrame) -> DataFrame:
    """Every rule's vote, and all of them as a string of -, 0 and +."""
    votes = rules()
    voted = stats.withColumns({f"vote_{k}": v for k, v in votes.items()})
    return voted.withColumn("votes", F.concat(*(F.when(F.col(f"vote_{k}") < 0, "-").when(F.col(f"vote_{k}") > 0, "+").otherwise("0") for k in votes)))


def _posteriors(voted: DataFrame) -> DataFrame:
    """(votes, p_good) of every pattern there is, by a model fitted to all documents."""
    seen = dict(voted.groupBy("votes").count().collect())  # at most 3**rules rows
    patterns = np.array([["-0+".index(v) - 1 for v in p] for p in seen], float).reshape(len(seen), len(rules()))
    good = LabelModel().fit(patterns, np.array(list(seen.values()), float)).p_good(patterns)
    return voted.sparkSession.createDataFrame([(p, float(g)) for p, g in zip(seen, good, strict=True)], "votes string, p_good double")


def _verdicts(voted: DataFrame, posteriors: DataFrame, threshold: float) -> DataFrame:
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    # The table of patterns is bounded (3**rules rows at most), so each task can have it whole.
    return voted.join(F.broadcast(posteriors), "votes").withColumn("base_failed", base).withColumn("kept", ~base & (F.col("p_good") >= threshold))


def judged(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """text_stats with every rule's vote, the posterior p_good, base_failed and kept."""
    voted = _voted(text_stats(docs, id_col=id_col, text_col=text_col))
    return _verdicts(voted, _posteriors(voted), threshold)


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that the verdict keeps, with their own columns. Each row is judged where it is read, whatever its id."""
    posteriors = _posteriors(_voted(text_stats(docs)))
    own = beside(docs, _stats, STATS)
    return _verdicts(_voted(own), posteriors, threshold).where("kept").select("row.*")
