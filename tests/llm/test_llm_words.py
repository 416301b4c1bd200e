"""Spelling variants, byte-level BPE and the filter audit against brute force on small texts."""

import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import Counter

import pytest

from quarryloom.llm import byte_bpe as B, filter_audit as A, spelling as S

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, source string, id int, word string, n int, near string, part string, mask int, ids array<int>"


def frame(spark, rows, parts=3):
    """With columns whose names clash with those that the operators use inside."""
    return spark.createDataFrame([(i, t, s, 5, "w", 2, "v", "p", 1, [7]) for i, t, s in rows], SCHEMA).repartition(parts)


def spelled(rng):
    """Words with chains of rarer variants, doubled letters, accents, and lengths around the bound."""
    base = ["abcdefg", "aabbccdd", "aaaaaaaa", "straßenbahn", "élèvement", "Übermut", "mississippi", "abcdef", "zzzzzzzz"]
    out = []
    for w in base:
        for times in (40, 4, 2, 1):
            for _ in range(3):
                i, c = rng.randrange(len(w)), rng.choice("abcdefgé")
                new = rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + c + w[i:]])
                out += [new] * times
        out += [w] * 400
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def spelling_rows():
    rng = random.Random(11)
    words = spelled(rng)
    rows = [(i, " ".join(words[i * 40 : i * 40 + 40]), "s") for i in range(len(words) // 40 + 1)]
    long = "".join(rng.choice("abcd") for _ in range(300))
    return rows + [(9001, None, None), (9002, "", "s"), (9003, "short words", None), (None, "abcdefg abcdefg, straßenbahn", "s"), (3, rows[3][1], "s"), (9004, f"{long} {long[1:]} {long}x", "s"), (9005, f"{long} {long[1:]} {long}x", "s")]


def variants_brute(rows):
    n = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 2}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    close = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in close.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(close[w]), n.get(form[w])) for w in n)


@pytest.mark.parametrize("most_bytes", [S.FILTER_BYTES, 8])
def test_spelling_variants(spark, spelling_rows, most_bytes):
    found = sorted(tuple(r) for r in S.variants(frame(spark, spelling_rows), most_bytes).select("word", "form", "root", "n", "n_near", "form_n").collect())
    expected = variants_brute(spelling_rows)
    assert found == expected
    assert sum(f is not None for _, f, *_ in expected) > 10 and any(r != f for _, f, r, *_ in expected if f)


def test_a_vocabulary_beyond_one_filter_is_split(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abcdef") for _ in range(7)) for _ in range(20_000)}
    rows = [(i, " ".join([*words][i::4]), "s") for i in range(4)]
    assert S.Filter.sized(len(words), 8).parts_log2 == 1 and S.Filter.sized(1 << 26).cells_log2 == 22
    docs = frame(spark, rows + rows)
    whole, split = ({tuple(r) for r in S.variants(docs, size).collect()} for size in (S.FILTER_BYTES, 8))
    assert whole == split and len(whole) > 15_000


def test_neighbours_are_all_and_each_once():
    hasher = S.Hasher(S.np.array(sorted(map(ord, "abé")), S.np.uint32))
    for word in ("aabba", "é", "abab", "aaaa"):
        codes, made = hasher.codes([word], len(word)), []
        for kind, place, h, valid in hasher.neighbours(codes):
            for k in range(h.shape[1]):
                if valid[0, k]:
                    new = S.neighbour(word, kind, place, "" if kind == "delete" else "abé"[k])
                    made.append(new)
                    assert not new or hasher.of(hasher.codes([new], len(new)))[0] == h[0, k]
        places = range(len(word) + 1)
        full = {word[:i] + word[i + 1 :] for i in places[:-1]} | {word[:i] + c + word[i + k :] for i in places for c in "abé" for k in (0, 1) if i + k <= len(word)}
        assert len(made) == len(set(made)) and set(made) == full - {word}


def test_spelling_of_an_empty_table(spark):
    assert S.variants(frame(spark, [])).collect() == []
    assert S.variants(frame(spark, [(1, None, None), (2, "a b", None)])).collect() == []


UNICODE = "aZ9 .,'\n\t éß中文字😀👩‍👩‍👧 ́ñ　​\r\x1c\x85"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    made = ["".join(rng.choice(UNICODE) for _ in range(rng.randrange(1, 80))) for _ in range(400)]
    words = "don't the Café naïve 2024 ... -- x's <|endoftext|> We'll 中文 déjà".split()
    made += [rng.choice([" ", "\n", "  "]).join(rng.choice(words) for _ in range(60)) for _ in range(200)]
    made += [None, "", " ", "\n\n", "a" * 5000, " ".join(rng.choice(words) for _ in range(900_000)), "😀" * 300]
    return made


@pytest.fixture(scope="module")
def tik():
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


def test_ids_are_those_of_the_ranks_and_decode_to_the_text(spark, texts, tik):
    rows = [(i if i % 7 else None, t, "s") for i, t in enumerate(texts)]
    docs = frame(spark, rows, 4)
    expected = [(i, tik.encode_ordinary(t or ""), t or "") for i, t, _ in rows]
    ids = sorted((str(r[0]), r[1]) for r in B.encoded(docs).select("doc_id", "ids").collect())
    assert ids == sorted((str(i), e) for i, e, _ in expected)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = [(str(i), len(e), digest(struct.pack(f"<{len(e)}I", *e)), digest(t.encode())) for i, e, t in expected]
    found = [(str(r[0]), *r[1:4]) for r in B.round_trip(docs).collect()]
    assert sorted(found) == sorted(want)
    assert sorted(r[0] for r in B.decoded(B.encoded(docs)).select("decoded").collect()) == sorted(t for _, _, t in expected)


def test_offsets_map_tokens_to_characters(spark, texts, tik):
    short = [t for t in texts if t and len(t) < 400]
    rows = {r.doc_id: r for r in B.encoded(frame(spark, [(i, t, "s") for i, t in enumerate(short)])).collect()}
    n_split = {r.doc_id: r.n_split for r in B.round_trip(frame(spark, [(i, t, "s") for i, t in enumerate(short)])).collect()}
    assert sum(n_split.values()) > 100
    for i, t in enumerate(short):
        held = [k for k, c in enumerate(t) for _ in c.encode()]  # the character of each byte
        at, expected = 0, []
        for token in map(tik.decode_single_token_bytes, rows[i].ids):
            expected.append((at, held[at], held[at + len(token) - 1]))
            at += len(token)
        assert list(zip(rows[i].byte_at, rows[i].char_at, rows[i].last_char_at, strict=True)) == expected
        assert n_split[i] == sum(b[1] == a[2] for a, b in itertools.pairwise(expected))


def test_pieces_hold_back_split_characters(tik):
    for t in ("😀 ok", "a中文", ""):
        pieces = B.decoded_pieces(tik.encode_ordinary(t))
        assert "".join(pieces) == t and "�" not in "".join(pieces)
    split = tik.encode_ordinary("😀")
    assert len(split) > 1 and B.decoded_pieces(split)[0] == "" and B.decoded_pieces(split[:1]) == ["�"]


def test_codes_outside_the_vocabulary_and_empty_tables(spark):
    assert B.round_trip(frame(spark, [])).collect() == []
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in B.decoded(rows).collect()] == ["", ""]
    with pytest.raises(ValueError):
        B.decoder(B.default_vocabulary()).bytes(B.np.array([60_000]))


def audit_brute(rows, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    fails = []
    for i, text, source in rows:
        t, w = text or "", re.findall(r"[^\x20\x09-\x0D]+", text or "")
        f = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t))]
        f.append(i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows))
        fails.append((i, source or "", f))
    out = {}
    for order in itertools.permutations(range(5)):
        for p in {p for _, p, _ in fails}:
            for step, k in enumerate(order):
                c = Counter()
                for i, part, f in fails:
                    if part == p:
                        gone = any(f[j] for j in order[:step])
                        c["kept"] += not gone and not f[k]
                        c["redundant"] += gone and f[k]
                        c["unique_fails"] += f[k] and sum(f) == 1
                        if f[k] and not gone:
                            c["removed"] += 1
                            c["good_lost"] += i in good
                            c["toxic_lost"] += i in toxic
                out[p, "".join("ABCDE"[j] for j in order), step + 1] = c
    for (p, order, step), c in out.items():
        c["shapley"] = sum(d["removed"] for (q, o, s), d in out.items() if q == p and o[s - 1] == order[step - 1])
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted((*key, *(c[x] for x in names)) for key, c in out.items())


def test_filter_audit(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(90)] + ["ABCDEF", "50%", "x&y"]
    copies = [" ".join(rng.choice(words[:88]) for _ in range(60)) for _ in range(3)]
    texts = [" ".join(rng.choice(words[: rng.choice([20, 88, 93])]) for _ in range(rng.randrange(30, 90))) for _ in range(60)] + copies * 6 + [None, None, "", " ", "A" * 100]
    rows = [(i, t, rng.choice(["a", "b", None, ""])) for i, t in enumerate(texts)]
    rows += [(None, copies[0], "a"), (None, copies[0], "b"), (5, copies[1], "a"), (60, copies[0], "b"), (60, copies[0], "b")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 80, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (70_000, 1, 1)]
    marks = spark.createDataFrame([(*x, "p", 3) for x in labels], "doc_id long, quality int, toxic int, part string, mask int")
    found = A.audit(frame(spark, rows), marks)
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in found.select(names).collect()) == audit_brute(rows, labels)


def test_incidence_of_any_number_of_filters():
    m = A.incidence(3)
    assert {k: x.shape for k, x in m.items()} == dict.fromkeys(A.OUTCOMES, (8, 18))
    assert A.incidence(5)["removed"].shape == (32, 600)
    removed = m["removed"].reshape(8, 6, 3).sum(axis=2)
    assert (removed[1:] == 1).all() and not removed[0].any()  # each failing mask goes once in every order


def test_filter_audit_of_an_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(frame(spark, []), labels).collect() == []
    one = A.audit(frame(spark, [(None, None, None)]), labels).collect()
    assert len(one) == 600 and {r.part for r in one} == {""}
