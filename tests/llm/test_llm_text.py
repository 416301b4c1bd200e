"""Quality, decontamination, near duplicates and toxicity against brute force on small texts."""

import gc
import hashlib
import random
import re
import weakref

import numpy as np
import pytest

from quarryloom.llm import decontamination as D, near_duplicates as N, quality as Q, toxicity as T
from quarryloom.llm.shared import Scratch

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
random.seed(3)
VOCAB = [f"w{i}" for i in range(400)] + ["Über", "ñandú", "中文", "don't", "3.14"]


def prose(n):
    return " ".join(random.choice(VOCAB) for _ in range(n))


def corpus():
    base, passage = prose(120), prose(60)
    texts = [None, "", " \n\t ", "one", "two words", "a b c d", "a b c d", base, base, base + " tail", base.upper(), base.replace("w1", "zz", 1), "x " * 50_000]
    texts += [prose(random.randint(5, 200)) for _ in range(60)] + [prose(30) + " " + passage + " " + prose(30) for _ in range(12)]
    words = base.split()
    for _ in range(40):  # a family of near copies, of one to five edits
        w = list(words)
        for _ in range(random.randint(1, 5)):
            w[random.randrange(len(w))] = f"e{random.randrange(10**6)}"
        texts.append(" ".join(w))
    return [(i * 3 + 1, t) for i, t in enumerate(texts)], passage


ROWS, PASSAGE = corpus()
SCHEMA = "doc_id long, text string, lang string, source string, id int, bucket string, votes string, item int"


def frame(spark, rows=ROWS):
    """With columns whose names clash with those that the operators use inside."""
    return spark.createDataFrame([(i, t, "en", None, 5, "b", "v", 7) for i, t in rows], SCHEMA)


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = spaced((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("small", [512, 4])
def test_near_duplicates_match_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(N, "SMALL", small)  # 4: more rounds of stars
    monkeypatch.setattr(N, "LARGE", small)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(frame(spark)).collect()}
    assert got == components(ROWS)


@pytest.mark.parametrize("run", [N.near_duplicates, N.keep_one])
def test_near_duplicates_write_in_small_plans(spark, monkeypatch, run):
    """The driver holds every query's plan, again after each of its stages: what several parts of a plan need is written first."""
    monkeypatch.setattr(N, "SMALL", 4)
    monkeypatch.setattr(N, "LARGE", 4)
    seen, write = [], Scratch.table

    def table(self, df, name):
        seen.append((len(df._jdf.queryExecution().optimizedPlan().toString().splitlines()), name))
        return write(self, df, name)

    monkeypatch.setattr(Scratch, "table", table)
    run(frame(spark))
    assert len([name for _, name in seen if name == "stars"]) > 1
    assert max(seen)[0] <= 50


def test_connected_finds_the_smallest_of_each_component(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(150, 260, 3)] + [(300, 300)] + [tuple(rng.sample(range(400, 500), 2)) for _ in range(60)]
    rng.shuffle(edges)
    root = {i: i for e in edges for i in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = {r.node: r.component for r in N.connected(spark, Scratch(spark, "test"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {i: found.get(i, i) for i in root} == {i: find(i) for i in root}


def test_near_duplicates_of_an_empty_table(spark):
    assert N.near_duplicates(frame(spark, [])).count() == 0
    assert N.keep_one(frame(spark)).columns == frame(spark).columns


def test_signature_misses_next_to_nothing():
    rng = np.random.default_rng(0)
    hits = 0
    for _ in range(200):
        both, a, b = rng.integers(0, 2**64, 170, np.uint64), rng.integers(0, 2**64, 15, np.uint64), rng.integers(0, 2**64, 15, np.uint64)
        x, y = (N.signatures(np.concatenate([both, z]), np.array([0]))[:, 0].reshape(N.BANDS, N.ROWS) for z in (a, b))
        hits += bool((x == y).all(axis=1).any())
    assert hits == 200


def brute_contamination(docs, items, window=10):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))

    wins = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[k]
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out[doc] = (len(w), len(hit), len(found), digest, bool(hit))
    return out


ITEMS = [(10, PASSAGE), (2, " ".join(PASSAGE.split()[20:45])), (33, prose(40)), (4, "one"), (5, None), (6, "two, words!"), (7, PASSAGE), (8, "")]


@pytest.mark.parametrize("block_words", [1_000_000, 60])
def test_contamination_matches_brute_force(spark, block_words):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = D.contamination(frame(spark), items, block_words=block_words)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.with_digest(found).collect()}
    assert got == brute_contamination(ROWS, ITEMS)
    longest = {r.doc_id: (r.longest_match, r.match_at, r.match_item, r.match_item_at) for r in found.collect()}
    for i, text in ROWS:
        n, at, item, item_at = longest[i]
        common = {k: brute_longest(latin(text), latin(t), min(10, len(latin(t)))) for k, t in ITEMS if t}
        assert n == max(common.values()), i
        if n:
            assert n == common[item] and latin(text)[at : at + n] == latin(dict(ITEMS)[item])[item_at : item_at + n]


def latin(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute_longest(a, b, least):
    """Words of the longest run that both have, 0 below least."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a[:3000]:  # the one longer text is a single word repeated
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, max(row))
    return best if b and best >= least else 0


@pytest.mark.parametrize("suffixes, pairs", [(1 << 18, 1 << 20), (40, 8)])
def test_every_test_suffix_is_searched(spark, monkeypatch, suffixes, pairs):
    monkeypatch.setattr(D, "SHARD_SUFFIXES", suffixes)
    monkeypatch.setattr(D, "PAIRS", pairs)
    part = " ".join(latin(prose(7)))
    items = [*ITEMS, (50, f"zz1 zz2 {part} zz3"), (51, "zz4 zz5")]
    rows = [*ROWS, (2000, f"qq {part} qq {prose(20)}"), (None, PASSAGE), (None, PASSAGE)]
    docs, frame_ = spark.createDataFrame([(t, i) for i, t in rows], "text string, doc_id long"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.item_id: r for r in D.longest_matches(docs, frame_).collect()}
    texts = {}
    for i, t in rows:
        texts.setdefault(i, latin(t))
    for item, text in items:
        w = latin(text)
        best = max((brute_longest(t, w, min(len(w), D.MIN_MATCH)) for t in texts.values()), default=0) if w else 0
        assert (got[item].longest_match if item in got else 0) == best, item
        if best:
            r = got[item]
            assert texts[r.doc_id][r.match_at : r.match_at + best] == w[r.item_at : r.item_at + best]
    assert got[50].longest_match >= 7 and 51 not in got  # shorter than a window
    found = D.contamination(docs, frame_, block_words=60).where("doc_id is null").collect()
    assert len(found) == 2 and all(len(r["items"]) == 3 for r in found)


@pytest.mark.parametrize("block_words", [1_000_000, 30])
def test_longest_match_beyond_the_depth_of_the_array(spark, block_words):
    w = [f"v{i}" for i in range(60)]
    items = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w[::-1]))], "item_id long, text string")
    ends = {10: 35, 11: 40, 12: 33, 13: 52, 14: 36, 15: 50}  # all share more words than the array orders by
    docs = spark.createDataFrame([(i, f"x{i} {' '.join(w[:n])} y{i}") for i, n in ends.items()] + [(20, None), (21, " ".join(w[59:20:-1]))], "doc_id long, text string")
    got = {r.item_id: tuple(r)[1:] for r in D.longest_matches(docs, items, block_words=block_words).collect()}
    assert got == {1: (52, 0, 13, 1), 2: (39, 0, 21, 0)}


def test_blocks_are_written_one_by_one(spark, monkeypatch):
    alive, most, make = [], [], D.TestSuffixes.__init__

    def made(self, *args):
        make(self, *args)
        alive.append(weakref.ref(self))
        gc.collect()
        most.append(sum(r() is not None for r in alive))

    monkeypatch.setattr(D.TestSuffixes, "__init__", made)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    one = {tuple(map(str, r)) for r in D.contamination(frame(spark), items).select("doc_id", "hit_from", "hit_to", "items").collect()}
    alive.clear(), most.clear()
    several = {tuple(map(str, r)) for r in D.contamination(frame(spark), items, block_words=60).select("doc_id", "hit_from", "hit_to", "items").collect()}
    assert one == several and len(most) > 2 and max(most) <= 3
    kept = sorted(r.doc_id for r in D.decontaminate(frame(spark), items).select("doc_id").collect())
    assert kept == sorted(r.doc_id for r in D.decontaminate(frame(spark), items, block_words=60).select("doc_id").collect())


def test_contamination_without_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not D.with_digest(D.contamination(frame(spark), none)).where("contaminated").count()
    assert D.contamination(frame(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
    assert D.decontaminate(frame(spark), none).count() == len(ROWS)


def brute_stats(text):
    w = spaced(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if spaced(line):
            dup += line in seen
            seen.add(line)
    count = {}
    for i in range(len(w) - 7):
        count[tuple(w[i : i + 8])] = count.get(tuple(w[i : i + 8]), 0) + 1
    hit = {k for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), dup, len(hit)


def test_quality_counts_and_verdicts(spark):
    spell = str.maketrans("0123456789", "abcdefghij")
    clean = (prose(50) + "\n" + prose(3) + "\n" + prose(50)).translate(spell)
    rows = [*ROWS, (1001, "wörd é\n" * 30), (1002, clean), (1003, " ".join(f"{w}***" for w in prose(80).split())), (1004, "a | b <c> " * 40)]
    got = {r.doc_id: r for r in Q.judged(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        r = got[i]
        n, chars, symbols, dup, repeat = brute_stats(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat), i
        assert r.base_failed == (n < 20 or 100 * repeat > 30 * n)
        assert not (r.base_failed and r.kept)
    assert got[1002].kept and not got[1003].kept
    assert Q.keep_good(frame(spark, [])).count() == 0


def drawn(rng, n, shares, chances, abstain=0.1):
    """Votes of n documents of a model's classes, and their classes."""
    kind = rng.choice(len(shares), n, p=shares)
    votes = np.where(rng.random((n, len(chances[0]))) < np.array(chances)[kind], -1.0, 1.0)
    votes[rng.random(votes.shape) < abstain] = 0
    return votes, kind


def test_label_model_recovers_shares_and_chances():
    chances = [[0.01, 0.002, 0.004], [0.95, 0.5, 0.1], [0.1, 0.9, 0.3], [0.05, 0.3, 0.95]]
    votes, kind = drawn(np.random.default_rng(2), 40_000, [0.85, 0.06, 0.05, 0.04], chances)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = Q.LabelModel(rounds=2000).fit(patterns, counts.astype(float))
    assert model.defects == [0, 1, 2] and abs(model.shares[0] - 0.85) < 0.02 and np.abs(model.chances[0] - chances[0]).max() < 0.02
    assert ((model.p_good(votes) >= 0.5) == (kind == 0)).mean() > 0.97


def test_label_model_equals_em_over_rows():
    """The same model, document by document and rule by rule."""
    rng, M = np.random.default_rng(5), Q.LabelModel
    rows = [tuple(int(x) for x in r) for r in rng.choice([-1, 0, 1], (300, 3), p=[0.2, 0.2, 0.6])]
    patterns = sorted(set(rows))
    model = M(rounds=40, evidence=np.inf).fit(np.array(patterns, float), np.array([rows.count(p) for p in patterns], float))
    prior = [M.SHARE] + [(1 - M.SHARE) / 3] * 3
    start = [[M.GOOD] * 3] + [[M.OWN if r == k else M.OTHERS for r in range(3)] for k in range(3)]
    share, chance = list(prior), [list(c) for c in start]

    def posterior(row):
        p = list(share)
        for k in range(4):
            for r, v in enumerate(row):
                p[k] *= chance[k][r] if v < 0 else 1 - chance[k][r] if v > 0 else 1
        return [x / sum(p) for x in p]

    for _ in range(40):
        held = [posterior(r) for r in rows]
        chance = [[(sum(h[k] * (row[r] < 0) for h, row in zip(held, rows)) + M.STRENGTH * start[k][r]) / (sum(h[k] * (row[r] != 0) for h, row in zip(held, rows)) + M.STRENGTH) for r in range(3)] for k in range(4)]
        chance[1:] = [[max(x, y) for x, y in zip(c, chance[0], strict=True)] for c in chance[1:]]
        share = [(sum(h[k] for h in held) + M.STRENGTH * prior[k]) / (len(rows) + M.STRENGTH) for k in range(4)]
    assert np.allclose(model.p_good(np.array(patterns, float)), [posterior(p)[0] for p in patterns], atol=1e-6)


def test_weak_rules_are_outvoted_and_strong_ones_are_not():
    chances = [[0.15, 0.002, 0.002, 0.002], [0.15, 0.95, 0.4, 0.1], [0.15, 0.1, 0.4, 0.9]]  # the first rule goes off at random
    votes, kind = drawn(np.random.default_rng(8), 30_000, [0.9, 0.06, 0.04], chances, 0.0)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = Q.LabelModel().fit(patterns, counts.astype(float))
    weak, strong, both = model.p_good(np.array([[-1, 1, 1, 1], [1, -1, 1, 1], [-1, 0, 0, -1]], float))
    assert 0 not in model.defects and weak > 0.9 and strong < 0.5 and both < 0.2
    good, bad = model.accuracies()
    assert (bad[[1, 3]] > 0.9).all() and bad[0] < 0.3 and (good > 0.85).all()
    assert np.isfinite(Q.LabelModel().fit(np.empty((0, 4)), np.empty(0)).p_good(votes[:3])).all()


def test_stages_judge_each_row_by_itself(spark):
    """Null and repeated ids, columns with names of the operators' own; the columns stay as they are."""
    good, junk = "a plain line of words that goes on for a while " * 1 + " ".join(f"word{chr(97 + i)}" for i in range(26)), "x# y* z% " * 30
    kind = "row string, p_good double, doc_id long, text string, votes string, _kept_id long, score double, items string, n_words int"
    rows = [("r", 0.1, i, t, "v", 1, 2.0, "i", 3) for i, t in [(None, good), (None, junk), (7, good), (7, good), (7, junk), (None, None), (8, "")]]
    docs = spark.createDataFrame(rows, kind)
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["7", "7", "None"]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(map(str, T.drop_toxic(docs, labels).collect())) == sorted(map(str, docs.collect()))
    items = spark.createDataFrame([(1, junk)], "item_id long, text string")
    clean = D.decontaminate(docs, items)
    assert clean.columns == docs.columns and clean.count() == 5
    one = N.keep_one(docs).collect()
    assert sorted(str(r.doc_id) for r in one) == ["7", "7", "7", "8", "None", "None", "None"]  # an id's rows stay together


def test_machine_scores_clauses():
    g = T.Grammar({"idiot": 1.0}, {"lowe": 1.0})
    heavy = lambda text: g.figures(text)[0]
    alone = heavy("the day was an idiot thing")
    assert heavy("you idiot") > alone > heavy("not an idiot thing") > 0
    assert heavy("they said he was an idiot") < heavy("he was an idiot")
    assert heavy("not today. idiot") == heavy("idiot")  # a negation ends with its clause
    assert heavy("kill you") > 0 and heavy("kill time now then you") == 0
    assert heavy("loweabc") > 0 and heavy("low") == 0
    assert heavy("you aren't an idiot") == heavy("you aren’t an idiot") == heavy("you are not an idiot") == 0.5 * heavy("he was an idiot")
    assert heavy("don't kill you") == 0.5 * heavy("I will kill you")
    assert alone == T.W_ALONE and heavy("an idiot and an idiot") == T.W_ALONE + T.W_REPEATED
    seeded = T.SEEDED
    assert seeded.score(seeded.figures("the clown at the circus")) < 0.5 <= seeded.score(seeded.figures("he is a clown"))
    assert g.score(g.figures(None)) == g.score(g.figures("plain words")) < 0.5


def test_composition_equals_the_transducers_one_after_another():
    """Every tape is written out whole before the next transducer reads it."""
    rng = random.Random(11)
    for _ in range(300):
        tape = [rng.randrange(T.PLAIN + 1) for _ in range(rng.randint(0, 14))]
        written, weight = list(tape), [1.0] * len(tape)
        for transducer in T.GRAMMAR:
            state = ()
            for i, symbol in enumerate(written):
                state, written[i], factor = transducer(state, symbol)
                weight[i] *= factor
        expected = sum(w for w, s in zip(weight, written, strict=True) if s == T.PAY)
        assert T.MACHINE.clause(tape) == pytest.approx(expected)


def test_toxicity_learns_from_training_rows_only(spark):
    bad = ["grubw", "zarp"]
    rows = [(i, prose(40) + (f" {random.choice(bad)}{random.randrange(99)}x " if i % 4 == 0 else " ") + prose(20)) for i in range(400)] + [(900, None), (901, "")]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 400)] + [(5000, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in T.toxicity(docs, labels).collect()}
    assert len(got) == len(rows)
    held = [r for r in got.values() if r.held_out and r.doc_id < 400]
    assert held and all(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    assert got[900].score == got[901].score < 0.5
    assert T.toxicity(docs, labels.where("toxic = 0")).count() == len(rows)
    assert T.drop_toxic(frame(spark, []), labels).count() == 0
