import hashlib
from bisect import bisect_left
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from grainfold.llm import cross_tokens

from . import cases

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
A = Tokenizer.from_file(A_PATH)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=B_PATH)


ALPHABET = cross_tokens._byte_alphabet()


@cache
def a_bytes(i):
    return bytes(ALPHABET[c] for c in A.id_to_token(i))


@cache
def b_bytes(i):
    p = B.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()


def tokens(text):
    """Ids of the whole text by both libraries; none if the bytes differ."""
    if not text:
        return [], []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    whole = (" " + text).encode()
    return (a, b) if b"".join(map(a_bytes, a)) == whole == b"".join(map(b_bytes, b)) else ([], [])


def brute(texts):
    """Rows by comparing every A token with every B token near it, byte range by byte range."""
    each = []
    for text in texts:
        a, b = tokens(text)
        ranges = []
        for ids, size in ((a, a_bytes), (b, b_bytes)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(size(i))))
                at = out[-1][1]
            ranges.append(out)
        pairs, j = [], 0
        for i, (x, y) in enumerate(ranges[0]):
            while j and ranges[1][j - 1][1] > x:
                j -= 1
            while j < len(b) and ranges[1][j][0] < y:
                if ranges[1][j][1] > x:
                    pairs.append((a[i], b[j]))
                j += 1
        cuts = sorted({y for _, y in ranges[0]} & {y for _, y in ranges[1]})
        listed = [[[], []] for _ in cuts]
        for side, (ids, r) in enumerate(((a, ranges[0]), (b, ranges[1]))):
            for i, (_, y) in zip(ids, r, strict=True):
                listed[bisect_left(cuts, y)][side].append(str(i))
        groups = ["|".join(",".join(x) for x in g) for g in listed]
        each.append((len(a), len(b), len(cuts), pairs, ";".join(groups)))
    count = Counter(p for e in each for p in e[3])
    highest = {}
    for (_, b), n in count.items():
        highest[b] = max(n, highest.get(b, 0))
    return [(na, nb, ng, len(p), sum(count[x] == highest[x[1]] for x in p), sum(count[x] for x in p), g) for na, nb, ng, p, g in each]


@pytest.mark.parametrize("sizes", [(16 << 20, 2 << 20, 1 << 20), (9_000, 700, 37)])
def test_alignment_equals_brute_force(spark, sf_dir, monkeypatch, sizes):
    monkeypatch.setattr(cross_tokens, "BLOCK_BYTES", sizes[1])
    monkeypatch.setattr(cross_tokens, "WINDOW_BYTES", sizes[2])
    monkeypatch.setattr(cross_tokens.windows, "__defaults__", (sizes[2],))
    odd = ["a▁b", "x  y ", " lead", "\n  x\n\ny \t z", "<s> <|endoftext|> <0x41>", "a\x00b", "日本語テキスト" * 9, "\x1c \x85 q", "z" * 3000, "  ", " ", "▁"]
    docs = cases.clashing(spark).select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    docs = docs.where("doc_id is null or doc_id <> 56").union(spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 40").select("doc_id", "text")).withColumn("groups", F.lit(1)).withColumn("n_a", F.lit("x"))
    rows = docs.collect()
    want = Counter((r.doc_id, *w) for r, w in zip(rows, brute([r.text for r in rows]), strict=True))
    got = Counter(map(tuple, cross_tokens.align(docs, A_PATH, B_PATH, group_bytes=sizes[0]).collect()))
    assert got == want
    assert (1000, 0, 0, 0, 0, 0, 0, "") in got and any(g[0] == 1002 and g[1] for g in got)


def test_alignment_query_digests_and_empty_table(spark, sf_dir):
    got = {r.doc_id: r for r in cross_tokens.op11_batch_alignment(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r, w in zip(docs, brute([r.text for r in docs]), strict=True):
        assert tuple(got[r.doc_id])[1:] == (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "")
    empty = cross_tokens.align(cases.frame(spark, []), A_PATH, B_PATH)
    assert empty.count() == 0 and empty.columns[-1] == "groups"
    assert [tuple(r) for r in cross_tokens.align(cases.frame(spark, [(1, None, None, None, None), (2, "", "a", "b", 0)]), A_PATH, B_PATH).orderBy("doc_id").collect()] == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aeinotT sS'\n\t0é.Ñ日  \x1cΣİ<|>▁ ")), max_size=60))
def test_chunks_equal_whole_texts(text):
    e = cross_tokens.pair_tokens(A_PATH, B_PATH).encode([text, text, None])
    a, b = tokens(text)
    assert e.a.tolist() == a * 2 and e.b.tolist() == b * 2 and e.a_n.tolist() == [len(a)] * 2 + [0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=60), st.lists(st.integers(1, 9), min_size=1, max_size=60), st.integers(1, 50))
def test_windows_end_where_both_end(a, b, size):
    gap = sum(a) - sum(b)
    (b if gap > 0 else a).append(abs(gap) or 1)
    if gap == 0:
        b.append(1)
    found = list(cross_tokens.windows(np.array(a), np.array(b), size))
    ends = [np.concatenate([np.flatnonzero(m) + w.start + 1 for w, m in zip(found, marks, strict=True)]).tolist() for marks in ([w.a_ends for w in found], [w.b_ends for w in found])]
    assert ends == [np.cumsum(a).tolist(), np.cumsum(b).tolist()]
    assert all(w.a_ends[-1] and w.b_ends[-1] for w in found)
    n = sum(len(cross_tokens.links(w)[0]) for w in found)
    assert n == len(a) + len(b) - sum(int((w.a_ends & w.b_ends).sum()) for w in found)
