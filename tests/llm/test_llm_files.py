"""Tokens, files, packing, archives, shards, rollups and page texts: exact round trips and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quarryloom.llm import html_text as H, packing as P, sharding as S, token_counts as C, token_files as F, tokens as K, warc as W
from quarryloom.llm.shared import Scratch
from quarryloom.sources import versions as V

random.seed(4)
WORDS = ["the", "Über", "ñandú", "don't", "3.14", "x,", "end.", "中文", "foo-bar", "THE", "a"]
ODD = ["a  b", "  x", "x\t y\n\n z ", "\n", "", " ", "don't  stop\r\n", "a\n\nb", "x <|endoftext|> y", "'s 's x's", "a \u0085b", "\x1c a b\x1f c", None, "tab\tin side", "a\nb c\n d"]
TEXTS = ODD + ["\n".join(" ".join(random.choice(WORDS) for _ in range(random.randint(1, 30))) for _ in range(random.randint(1, 5))) for _ in range(40)] + ["word " * 4000 + "end"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(K.default_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [0]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(1000 - 7 * i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, piece string, start int")


def test_encoder_is_exact(plain, monkeypatch):
    monkeypatch.setattr(K, "CHUNK_BYTES", 600)  # long texts go in parts
    got = []
    for _, _, ids, counts in K.Encoder(K.default_path()).encode(pa.array(TEXTS)):
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [plain(t) for t in TEXTS]


def test_a_word_is_learnt_once_whatever_mark_or_break_is_by_it(plain):
    encoder = K.Encoder(K.default_path())
    words = ["alpha", "été", "x3", "foo-bar"]
    text = "\n".join(" ".join([w, w, w + ",", w + ".", w]) for w in words)
    (_, _, ids, _), = encoder.encode(pa.array([text]))
    assert ids.tolist() == plain(text)
    assert len(encoder.known) == 2 * len(words)  # with a space before it, and without


def test_new_words_of_letters_share_calls_of_the_library(plain, monkeypatch):
    encoder = K.Encoder(K.default_path())
    words = [a + b + c + "é" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzabcd"]
    calls, held = [], encoder.merges

    class Counted:
        def encode_batch_fast(self, texts, **options):
            calls.extend(texts)
            return held.encode_batch_fast(texts, **options)

    monkeypatch.setattr(encoder, "merges", Counted())
    text = " ".join(words)
    (_, _, ids, _), = encoder.encode(pa.array([text]))
    assert ids.tolist() == plain(text) and len(calls) == -(-len(words) // K.AT_ONCE)


def test_encoder_is_exact_on_marks_after_every_kind_of_character(plain, monkeypatch):
    rng = random.Random(5)
    ends = ["a", "Z", "7", "é", "×", "÷", "ÿ", "ª", "ſ", "ɏ", "ɐ", "é", "٣", "²", "中", "…", ".", ",", "'s", "-", " ", "\u0085", " ", "　", "\x1c", "<|endoftext|>", "Ġ", "Ċ", "đ", "ȿ", "😀"]
    texts = []
    for _ in range(300):
        words = ["".join(rng.choices(ends, k=rng.randint(1, 4))) + rng.choice(["", ".", ",", ".,", ",,"]) for _ in range(rng.randint(1, 12))]
        texts.append("".join(w + rng.choice([" ", " ", " ", "\n"]) for w in words).rstrip(" \n"))
    monkeypatch.setattr(K, "AT_ONCE", 3)
    encoder = K.Encoder(K.default_path())
    for _ in range(2):  # words that are new, and words that are remembered
        got = []
        for _, _, ids, counts in encoder.encode(pa.array(texts)):
            got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [plain(t) for t in texts]
    monkeypatch.setattr(K, "POOL", 10)  # what is remembered is dropped again and again
    monkeypatch.setattr(K, "CHUNK_BYTES", 200)
    got = []
    for _, _, ids, counts in encoder.encode(pa.array(texts)):
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [plain(t) for t in texts]


def test_frames_round_trip():
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.integers(0, 2**32, 5000, dtype=np.uint32), np.zeros(3000, np.uint32), rng.integers(0, 2, 3001, dtype=np.uint32), rng.geometric(0.01, 4000).astype(np.uint32)])
    frame = F.Frame(F.encode_frame(np.array([5]), np.array([len(ids)]), ids))
    assert (frame.ids(0, len(ids)) == ids).all() and (frame.ids(2047, 9001) == ids[2047:9001]).all()
    assert len(frame.patch) > 0 and len(F.Frame(F.encode_frame(np.array([]), np.array([]), np.empty(0, np.uint32))).ids(0, 0)) == 0


def test_token_files(spark, plain):
    rows = {r.doc_id: r for r in F.token_files(docs(spark)).collect()}
    at = 0
    for doc, text in sorted((1000 - 7 * i, t) for i, t in enumerate(TEXTS)):
        ids = np.array(plain(text), "<u4")
        assert (rows[doc].start, rows[doc].n_tokens, rows[doc].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert F.token_files(docs(spark, [])).count() == 0


def test_token_files_stay_small_and_in_order(spark, monkeypatch):
    monkeypatch.setattr(K, "CHUNK_BYTES", 600)
    monkeypatch.setattr(F, "FILE_FRAMES", 2)
    whole = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in F.token_files(docs(spark)).collect())
    monkeypatch.undo()
    rows = F.token_files(docs(spark)).collect()
    assert whole == sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows)


def test_packing_of_many_equal_short_pieces():
    for lengths, most in ((np.full(4096, 3), 7), (np.full(4096, 1), 2), (np.tile([1, 2, 3, 5], 1024), 6)):
        bins = P.pack(lengths)
        assert len(bins) == most and sorted(i for b in bins for i in b) == list(range(4096)) and max(lengths[b].sum() for b in bins) <= 2048


def test_exchange_found_is_the_best_there_is():
    """Every exchange of up to two pieces for up to two, but not two for two, tried one by one."""
    rng = np.random.default_rng(4)
    for _ in range(60):
        lengths = rng.integers(1, 30, 14)
        bins, room = P.best_fit(lengths, 40), 40
        rng.shuffle(bins)
        search = P.LocalSearch(lengths, bins, room)
        fills = [int(lengths[b].sum()) for b in bins]
        donor = int(np.argmin(fills))
        if fills[donor] == room:
            continue
        sets = lambda b: [()] + [(i,) for i in b] + [(i, j) for x, i in enumerate(b) for j in b[x + 1 :]]
        best = 0
        for other, b in enumerate(bins):
            if other == donor or fills[other] == room or fills[other] < fills[donor]:
                continue
            for give in sets(bins[donor])[1:]:
                for take in sets(b):
                    moved = int(lengths[list(give)].sum() - lengths[list(take)].sum())
                    if not (len(give) == len(take) == 2) and 0 < moved <= room - fills[other]:
                        best = max(best, moved * (fills[other] - fills[donor] + moved))
        before = int((search.fill**2).sum())
        search._drop(donor)
        assert search._improve(donor) == (best > 0)
        assert (int((search.fill**2).sum()) - before) == 2 * best
        assert sorted(i for mine in search.held for n in mine.values() for i in n) == list(range(14))


def test_packing_covers_every_token_once(spark, plain, monkeypatch):
    monkeypatch.setattr(P, "GROUP", 16)
    rows = P.packed(docs(spark), room=64).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(TEXTS):
        ids, pieces = np.array(plain(text), "<u4"), sorted(by_doc[1000 - 7 * i], key=lambda r: r.piece)
        at = 0
        for k, r in enumerate(pieces):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 64)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids) and len(pieces) == -(-len(ids) // 64)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert P.packed(docs(spark, [])).count() == 0


def test_local_search_beats_best_fit():
    rng = np.random.default_rng(1)
    lengths = rng.integers(500, 1100, 800)
    before, after = P.best_fit(lengths, 2048), P.pack(lengths)
    assert sorted(i for b in after for i in b) == list(range(800))
    assert max(lengths[b].sum() for b in after) <= 2048
    assert -(-int(lengths.sum()) // 2048) <= len(after) < len(before)


PAGES = [(1, "http://a/\r\nx", "<p>" + "long page " * 30), (2, None, "<p>" + "long page " * 30), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", "é" * 50), (7, "u", "é" * 50), (8, "u", "é" * 49 + "z")]


def test_archives(spark, monkeypatch):
    rows = PAGES + [(100 + i, f"http://b/{i}", f"<html><body><p>{'text ' * 20}{i}</p>") for i in range(60)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, first int")
    got = {r.page_id: r for r in W.archived(pages).collect()}
    first = {}
    for page, _, html in rows:
        payload = (html or "").encode()
        digest = hashlib.sha256(payload).hexdigest()
        refers = first.setdefault(digest, page) if len(payload) >= 100 else page
        r = got[page]
        assert r.content_ok and (r.payload_bytes, r.payload_digest) == (len(payload), digest)
        assert (r.record_type, r.refers_to) == (("response", None) if refers == page else ("revisit", refers))
    assert W.archived(pages.limit(0)).count() == 0


def test_archive_files_stay_small_and_open_by_themselves(spark, tmp_path):
    rows = [(i, "u", f"<p>{'some words ' * 30}{i // 2}") for i in range(80)] + [(7, "again", "other text " * 20), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").where("page_id is not null")
    W.write_archives(pages.coalesce(1), f"file://{tmp_path}/w", value_bytes=300, file_values=2)
    files = sorted((tmp_path / "w").glob("part-*"))
    assert len(files) > 5
    got = sorted(int(h["WARC-Page-ID"]) for f in files for _, h, _ in W.read_records(f.read_bytes()))
    assert got == sorted([*range(80), 7])
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in W.read_archives(spark, f"file://{tmp_path}/w").collect() if r.page_id != 7}
    assert all(kinds[i] == (("revisit", i - 1) if i % 2 else ("response", None)) for i in kinds)


def test_one_record_by_its_offset(spark, tmp_path):
    import zstandard

    pages = spark.createDataFrame([(i, "u", f"<p>{'some words ' * 30}{i}") for i in range(40)], "page_id long, url string, html string")
    W.write_archives(pages.coalesce(1), f"file://{tmp_path}/w")
    data = next((tmp_path / "w").glob("part-*")).read_bytes()
    first = W._frame_size(memoryview(data), 0)
    at, headers, body = list(W.read_records(data))[7]
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:first]))
    assert body in opener.decompress(data[at : at + W._frame_size(memoryview(data), at)])


def test_shards_compact_and_keep_every_row(spark, tmp_path):
    shards = S.ShardSet(spark, f"file://{tmp_path}/s", small_bytes=1500, target_bytes=20_000, fanout=3)
    rows = [(i, None if i % 9 == 0 else f"text {i} " * 5) for i in range(300)]
    for k in range(8):
        shards.append(spark.createDataFrame(rows[k * 30 : k * 30 + 60], "doc_id long, text string").coalesce(1))
        shards.compact()
        tiers = [S.tier(s["bytes"], 1500, 20_000, 3) for s in shards.manifest()["shards"]]
        assert all(tiers.count(t) < 3 for t in set(tiers) if t is not None)
    expected = sorted(str(r) for k in range(8) for r in rows[k * 30 : k * 30 + 60])
    assert sorted(str(tuple(r)) for r in shards.read().collect()) == expected
    old = shards.read(2).count()
    assert old == 120 or old == 60
    assert shards.vacuum() > 0 and shards.read().count() == len(expected)


def test_compaction_ends_when_the_writer_makes_more_files(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "20")
    try:
        shards = S.ShardSet(spark, f"file://{tmp_path}/s")
        shards.append(spark.range(300).selectExpr("id as doc_id", "cast(id as string) as text").coalesce(1))
        assert len(shards.manifest()["shards"]) == 15
        assert shards.compact() == 2 and all(s["sealed"] for s in shards.manifest()["shards"])
        assert shards.compact() == 2 and shards.read().count() == 300
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_row_groups_of_shards_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "ROW_GROUP_BYTES", 1 << 20, raising=False)
    shards = S.ShardSet(spark, f"file://{tmp_path}/s")
    rows = spark.range(6000).selectExpr("id as doc_id", "concat_ws('', transform(sequence(1, 16), k -> sha2(concat(id, ':', k), 256))) as text")
    for k in range(4):
        shards.append(rows.where(f"doc_id % 4 = {k}").coalesce(1))
    appended = shards.manifest()["shards"]
    shards.compact()
    merged = shards.manifest()["shards"]
    assert len(appended) == 4 and len(merged) < 4
    for s in appended + merged:
        held = pq.read_metadata(f"{tmp_path}/s/{s['path']}")
        groups = [held.row_group(i) for i in range(held.num_row_groups)]
        assert all(sum(g.column(i).total_compressed_size for i in range(g.num_columns)) < 1.3 * (1 << 20) for g in groups)
    assert shards.read().exceptAll(rows).count() == 0 and shards.read().count() == 6000


def test_sharded_edges(spark):
    kind = "doc_id long, text string, shard string, name int, bytes long, rows long, path string"
    assert S.sharded(spark.createDataFrame([], kind)).count() == 0
    rows = [(None, "no id", "a", 1, 2, 3, "p"), (1, None, None, None, None, None, None), (1, "", "b", 1, 1, 1, "q"), (1, "", "b", 1, 1, 1, "q"), (-(2**62), "low", "c", 0, 0, 0, ""), (2**62, "é" * 400_000, "d", 0, 0, 0, "")]
    df = spark.createDataFrame(rows, kind)
    sha = lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest()
    got = sorted(str((r.doc_id, r.text_bytes, r.text_sha256)) for r in S.sharded(df).collect())
    assert got == sorted(str((i, None if t is None else len(t.encode()), sha(t))) for i, t, *_ in rows)


def test_appends_of_two_writers_and_new_columns(spark, tmp_path):
    one, other = (S.ShardSet(spark, f"file://{tmp_path}/s") for _ in range(2))
    one.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    commit = one.versions.commit

    def late(base, content):  # the other commits in between
        one.versions.commit = commit
        other.append(spark.createDataFrame([(2, "b", "x")], "doc_id long, text string, extra string"))
        return commit(base, content)

    one.versions.commit = late
    assert one.append(spark.createDataFrame([(3, "c")], "doc_id long, text string")) == 3
    assert sorted(tuple(r) for r in one.read().collect()) == [(1, "a", None), (2, "b", "x"), (3, "c", None)]


def test_a_lost_writers_claim_is_taken_over(spark, tmp_path):
    versions = V.Versions(spark, f"file://{tmp_path}/v", patience=0.3)
    assert versions.commit(0, {"a": 1}) and not versions.commit(0, {"a": 2})
    versions._create("2.claim-0", "")
    assert versions.commit(1, {"a": 3}) and versions.read(2)["a"] == 3 and versions.numbers() == [1, 2]


DELTAS = [(i, ("a b c. Über " * (i + 1)) if i % 2 else None, "s" if i % 3 else None, "en") for i in range(12)]


def counted(rows, tokenizer):
    """Totals by brute force."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t, out = Tokenizer.from_file(public_tokenizers.path(C.TOKENIZERS[tokenizer])), {}
    for _, text, source, lang in rows:
        had = out.setdefault((source, lang, tokenizer), [0, 0, 0])
        for k, n in enumerate((1, len(t.encode(text or "", add_special_tokens=False).ids), len(text or ""))):
            had[k] += n
    return {(*k, *v) for k, v in out.items()}


def test_rollups_are_idempotent(spark, tmp_path):
    data = spark.createDataFrame(DELTAS, "doc_id long, text string, source string, lang string")
    roll = C.Rollup(spark, f"file://{tmp_path}/r")
    rows = C.measured(data, "byte_bpe_50k")
    assert roll.commit("one", C.inserts(rows)) == 1 and roll.commit("one", C.inserts(rows)) == 1
    assert {tuple(r) for r in roll.totals().collect()} == counted(DELTAS, "byte_bpe_50k")
    before = sorted(map(str, roll.totals().collect()))
    roll.commit("gone", C.deletes(rows.where("doc_id < 6")))
    roll.commit("back", C.inserts(rows.where("doc_id < 6")))
    assert sorted(map(str, roll.totals().collect())) == before
    roll.commit("none", C.inserts(rows.limit(0)))
    roll.commit("all", C.deletes(rows))
    assert roll.totals().count() == 0 and roll.totals(1).count() == 2


def test_no_batch_of_two_writers_is_lost(spark, tmp_path):
    rows = C.measured(spark.createDataFrame(DELTAS, "doc_id long, text string, source string, lang string"), "byte_bpe_50k")
    one, other = (C.Rollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    one.commit("a", C.inserts(rows))
    commit = one.versions.commit

    def late(base, content):
        one.versions.commit = commit
        assert other.commit("b", C.inserts(rows)) == 2
        return commit(base, content)

    one.versions.commit = late
    assert one.commit("c", C.inserts(rows)) == 3
    assert one.totals().agg({"n_docs": "sum"}).first()[0] == 36 and one.holds("b") == 2
    one.versions.commit = lambda base, content: other.commit("d", C.deletes(rows)) and False  # the same batch, sent twice at once
    assert one.commit("d", C.deletes(rows)) == 4
    assert other.totals().agg({"n_docs": "sum"}).first()[0] == 24


@pytest.mark.parametrize("held_up", ["_delta", "totals"])
def test_a_batch_that_two_writers_send_counts_once(spark, tmp_path, monkeypatch, held_up):
    rows = C.measured(spark.createDataFrame(DELTAS, "doc_id long, text string, source string, lang string"), "byte_bpe_50k")
    slow, quick = (C.Rollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    do, sent = getattr(slow, held_up), []

    def late(*args):  # the other writer sends the batch while this one makes its delta, or has read its base
        if not sent:
            sent.append(quick.commit("day1", C.inserts(rows)))
        return do(*args)

    monkeypatch.setattr(slow, held_up, late)
    assert slow.commit("day1", C.inserts(rows)) == 1 and sent == [1]
    assert slow.version() == 1 and {tuple(r) for r in quick.totals().collect()} == counted(DELTAS, "byte_bpe_50k")


def test_maintained_of_an_empty_table(spark):
    assert C.maintained(spark.createDataFrame([], "doc_id long, text string, source string, lang string")).collect() == []


def test_archives_of_an_empty_table(spark):
    assert W.archived(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_maintained_counts_every_document(spark):
    rows = [(*r, 5) for r in [*DELTAS, (None, "no id", "s", None), (7, "again", "s", "en"), (21, "x " * 50_000, "s", "en")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, sign int")
    third = [r[:4] for r in rows if r[0] is not None and r[0] % 3 == 0]
    others = [r[:4] for r in rows if r[0] is None or r[0] % 3]
    assert {tuple(r) for r in C.maintained(docs).collect()} == counted(others, "byte_bpe_50k") | counted(third, "word_bpe_49k")
    assert C.maintained(docs.limit(0)).count() == 0


def test_page_text(spark):
    page = (
        '<html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy this now.</div>'
        "<article><h1>Head &amp; line</h1><p>First  paragraph &eacute;\n with <b>bold</b>er text.<p>Second one,<br>unclosed.</article><div class=comments><p>Nice post!</p></div><footer>&copy; me</footer></body></html>"
    )
    rows = spark.createDataFrame([(1, "u", page, 1), (2, None, None, 1), (3, "u", "", 1), (4, "u", "<<<a b='", 1)], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in H.main_text(rows).collect()}
    assert got[1].text == "Head & line\nFirst paragraph é with bolder text.\nSecond one, unclosed." and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[4].page_id == 4
    assert H.main_text(rows.limit(0)).count() == 0


def test_labeller_on_new_pages():
    rng, net, right, total = np.random.default_rng(77), H.network(), 0, 0
    for _ in range(60):
        page, labels = H.page_maker(rng)
        found = H.blocks(page)
        p = net.probabilities([found])[0]
        right, total = right + int(((p >= 0.5) == np.array([labels[b.text] for b in found])).sum()), total + len(found)
    assert right / total > 0.98


def test_gradients_are_right():
    rng, net = np.random.default_rng(1), H.Network(3)
    page, labels = H.page_maker(rng)
    pages = [H.blocks(page), H.blocks(page)[:3]]
    y = np.array([labels[b.text] for p in pages for b in p], float)
    _, grads = net.gradients(pages, y)
    for name, at in (("wf", (3, 5)), ("wb", (H.PATH_SIZE, 20)), ("out", (4,)), ("cf", (7,)), ("path", (H.path_rows(pages[0][0].path)[0], 2))):
        held, ends = net.p[name][at], []
        for step in (1e-5, -1e-5):
            net.p[name][at] = held + step
            ends.append(net.gradients(pages, y)[0])
        net.p[name][at] = held
        assert grads[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-3, abs=1e-7), name


def test_scratch_folders_can_be_dropped(spark):
    scratch = Scratch(spark, "test")
    assert scratch.table(spark.range(3), "t").count() == 3
    scratch.drop()
