import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from grainfold.llm import bpe_replay, packing

from . import cases

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aeinot sS'\n\t0 é.ñ日  \x1c")), max_size=80))
def test_replay_equals_tiktoken(text):
    enc = bpe_replay.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    ids, n = enc.encode([text])
    assert ids.tolist() == TIKTOKEN.encode_ordinary(text)
    assert enc.decode(ids) == text.encode()


def test_replay_of_a_lower_rank_made_by_a_merge():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"abc": 257, b"ab": 300, b"abcd": 258}
    enc = bpe_replay.MergeReplay(ranks)
    words = [b"abcabcd", b"ab", b"", b"aabbcc"]
    got, n = enc.encode(words)
    own = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks={**ranks, **{bytes([1, 2, 3, i]): 301 + i for i in range(0)}}, special_tokens={})
    at = 0
    for w, k in zip(words, n, strict=True):
        assert got[at : at + k].tolist() == own._encode_single_piece(w) if w else k == 0
        at += k


def test_encode_cases(spark):
    docs = cases.clashing(spark)
    got = bpe_replay.encode_texts(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, digest=True).collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = TIKTOKEN.encode_ordinary(r.text or "")
        want[(r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, got)) == want
    plain = bpe_replay.encode_texts(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).where("doc_id = 55").first()
    assert plain.decoded == cases.rows()[[r[0] for r in cases.rows()].index(55)][1]
    assert bpe_replay.encode_texts(cases.frame(spark, []), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_replay_of_cut_texts(monkeypatch):
    monkeypatch.setattr(bpe_replay, "PIECE_CHARS", 20)
    monkeypatch.setattr(bpe_replay, "STRING_CHARS", 5)
    monkeypatch.setattr(bpe_replay, "INDEX_BYTES", 64)
    enc = bpe_replay.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = ["the words of a text, don't 12345 " * 9, "", " ", " a b  c\n\nd \n e " * 7, "日本語" * 30, "x" * 99 + " y", "one\ttwo three four five six  seven "]
    ids, n = enc.encode(texts)
    for text, e, k in zip(texts, np.cumsum(n), n, strict=True):
        assert ids[e - k : e].tolist() == TIKTOKEN.encode_ordinary(text)


def test_replay_over_groups_and_shares(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(bpe_replay, "GROUP_BYTES", 60_000)
    monkeypatch.setattr(bpe_replay, "SHARE_BYTES", 20_000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = bpe_replay.encode_texts(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    ids = {r.doc_id: r.ids for r in got.collect()}
    assert ids == {r.doc_id: TIKTOKEN.encode_ordinary(r.text or "") for r in docs.select("doc_id", "text").collect()}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aeinotT sS'\n\t0é.Ñ日 ́ \x1cΣİ<|>")), max_size=60))
def test_words_equal_tokenizer(text):
    own = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert packing.word_tokens(P.path("word_bpe_49k.json")).encode([text])[0].tolist() == own.encode(text, add_special_tokens=False).ids


def test_added_tokens_and_long_texts(monkeypatch):
    own = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    enc = packing.word_tokens(P.path("word_bpe_49k.json"))
    monkeypatch.setattr(packing, "WHOLE_CHARS", 40)
    texts = ["hello <|endoftext|> world", "a<|startoftext|>b <|ENDOFTEXT|>", "日本 ἀΣ  ´ e\u0301 don't " * 30, "x " * 500 + "ß Ω", "", " "]
    for t, ids in zip(texts, enc.encode(texts), strict=True):
        assert ids.tolist() == own.encode(t, add_special_tokens=False).ids
    assert 49407 in enc.encode(texts)[0].tolist()


def check_packing(docs, got, slack):
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[(r.doc_id, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    total = 0
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
    assert len(bins) <= -(-total // 2048) + slack


def test_packing_cases(spark, sf_dir):
    docs = cases.clashing(spark)
    got = packing.pack_documents(docs, P.path("word_bpe_49k.json"))
    check_packing(docs, got.collect(), 2)
    assert got.where("size(ids) <> length").count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_packing(docs, packing.pack_documents(docs, P.path("word_bpe_49k.json"), keep_ids=False).collect(), 2)
    assert packing.pack_documents(cases.frame(spark, []), P.path("word_bpe_49k.json")).count() == 0


def test_levels_of_groups(spark):
    r = np.random.default_rng(0)
    lengths = r.integers(1, 2049, 3000)
    pieces = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "row long, length long")
    got = packing.pack_pieces(pieces, group_pieces=100, open_bins=8).toPandas()
    assert sorted(got.row) == list(range(3000))
    fill = got.assign(n=lengths[got.row]).groupby("sequence_id").n.sum()
    assert fill.max() <= 2048
    one = len(packing.pack(lengths[lengths < 2048])) + int((lengths == 2048).sum())
    assert len(fill) <= one * 1.04 + 8


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_local_search_keeps_pieces_and_never_adds_bins(sizes):
    lengths = np.array(sizes, np.int64)
    bins = packing.best_fit(lengths, 20)
    better = packing.local_search(lengths, [list(b) for b in bins], 20)
    assert sorted(i for b in better for i in b) == list(range(len(sizes)))
    assert all(lengths[b].sum() <= 20 for b in better) and len(better) <= len(bins)


def test_local_search_empties_a_bin_by_a_swap():
    lengths = np.array([6, 3, 5, 4, 2])  # 6+3, 5+4, 2 of capacity 10: 6+4, 5+3+2
    assert len(packing.local_search(lengths, [[0, 1], [2, 3], [4]], 10)) == 2
