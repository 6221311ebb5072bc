import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from grainfold.llm import near_dups, phrase_parse
from grainfold.llm.components import components

from . import cases


def multiset(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def classes(rows):
    """doc_id -> class of (doc_id, text) rows, by brute force."""
    sets = [(d, multiset(t)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(set)
    for i, (_, s) in enumerate(sets):
        for x in s:
            index[x].add(i)
    for i, (d, s) in enumerate(sets):
        for j in {j for x in s for j in index[x] if j < i}:
            e, t = sets[j]
            both = sum(min(n, t[x]) for x, n in s.items())
            if 5 * both >= 4 * (s.total() + t.total() - both):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return {d: find(d) for d in parent}


def check(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = classes(rows)
    got = near_dups.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == Counter((d, want.get(d)) for d, _ in rows)
    return got


def test_near_duplicates(spark, sf_dir):
    check(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_near_duplicate_cases(spark):
    docs = cases.clashing(spark)
    got = {r.doc_id: r for r in check(spark, docs)}
    assert got[20].class_id == 0 and got[30].class_id == 3 and got[54].class_id == 53 and got[50].class_id == 50
    kept = near_dups.keep_one(docs)
    assert kept.columns == docs.columns
    want = Counter(r.class_id for r in got.values() if r.doc_id is not None and r.doc_id == r.class_id)
    assert Counter(r.doc_id for r in kept.collect() if r.doc_id is not None) == want
    assert kept.where("doc_id is null").count() == 1
    assert near_dups.near_duplicates(cases.frame(spark, [])).count() == 0


def test_one_large_loose_group(spark):
    """Copies of one text with up to five edits: many pairs just above and just below the link."""
    r = random.Random(4)
    base = cases.words(r, 150).split()
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(r.randint(0, 5)):
            t[r.randrange(len(t))] = cases.words(r, 1)
        rows.append((i, " ".join(t), "en", "src0", 1))
    check(spark, cases.frame(spark, rows))


def test_one_id_with_texts_that_differ(spark):
    """Each text of a repeated id keeps its own links."""
    r = random.Random(9)
    x, y = cases.words(r, 90), cases.words(r, 90)
    rows = [(1, x, "en", "s", 1), (1, y, "en", "s", 1), (2, x + " end", "en", "s", 1), (3, y + " end", "en", "s", 1), (4, y, "en", "s", 1)]
    got = {(d.doc_id, d.class_id) for d in near_dups.near_duplicates(cases.frame(spark, rows)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1)}


@pytest.mark.parametrize("few", [0, 4])
def test_stars_of_stars(spark, few, monkeypatch):
    """Groups whose texts are apart from every one centre: chains of edits, decided in rounds of stars."""
    monkeypatch.setattr(near_dups, "FEW_APART", few)
    r = random.Random(6)
    rows = []
    for g in range(3):
        t = cases.words(r, 120).split()
        for i in range(40):
            if i:
                t = list(t)
                t[(7 * i) % 120] = cases.words(r, 1)
            rows.append((100 * g + i, " ".join(t[: 120 - i % 5]), "en", "src0", 1))
    check(spark, cases.frame(spark, rows))


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(0)
    for _ in range(3):
        h = r.integers(0, 2**63, 60).astype(np.uint64)
        a, b = r.integers(1, 9, 60), r.integers(1, 9, 60)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        hits = []
        for k in range(80):
            x = h + np.uint64(7919 * k)
            s = near_dups.bag_min_hash(np.repeat([0, 1], 60), np.concatenate([x, x]), np.concatenate([a, b]), 2)
            hits.append((s[0] == s[1]).mean())
        assert abs(np.mean(hits) - true) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_removed(rows):
    first = {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], (d is None, d or 0))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        off = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < (d is None, d or 0):
                off[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, o in zip(b, off, strict=True) if not o)
        out.append((d, len(b), sum(off), sum(1 for k, o in enumerate(off) if o and (not k or not off[k - 1])), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def check_removed(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = phrase_parse.remove_repeats(docs, digest=True).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute_removed(rows)


@pytest.mark.parametrize("small", [False, True])
def test_repeats(spark, sf_dir, small, monkeypatch):
    if small:  # many groups and shares, and phrases cut at chunks
        monkeypatch.setattr(phrase_parse, "GROUP_BYTES", 40_000)
        monkeypatch.setattr(phrase_parse, "SHARE_BYTES", 60_000)
    check_removed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    check_removed(cases.clashing(spark))


def test_repeat_cases(spark):
    docs = cases.clashing(spark).drop("g", "n_bytes")
    out = phrase_parse.remove_repeats(docs)
    assert out.columns == [*docs.columns, "n_bytes", "n_removed", "n_spans"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[50].text is None and got[51].text == "" and got[20].text == ""
    assert phrase_parse.remove_repeats(cases.frame(spark, [])).count() == 0
    periodic = [(i, "ab" * (40 + 30 * i) + "x" * i, "en", "s", 1) for i in range(6)] + [(9, "ab" * 24, "en", "s", 1), (8, "b" + "ab" * 200, "en", "s", 1)]
    check_removed(cases.frame(spark, periodic))


def test_suffix_ranks():
    """Ranks order and equal the 50 bytes from each position as bytes do, however the dictionary repeats itself."""
    r = np.random.default_rng(3)
    for letters, n in ((2, 400), (20, 3000), (1, 90), (256, 300)):
        one = bytes(r.integers(0, letters, n).astype(np.uint8))
        text = one + one[: n // 2] + bytes(60) + one
        at = np.arange(len(text) - 49)
        rank = phrase_parse.suffix_ranks(np.frombuffer(text + bytes(16), np.uint8), at)
        strings = [text[i : i + 50] for i in at]
        places = {x: k for k, x in enumerate(sorted(set(strings)))}
        assert rank.tolist() == [places[x] for x in strings]


def test_equal_names_of_different_phrases():
    data = np.frombuffer(b"a" * 50 + b"b" * 50 + b"a" * 50 + b"c" * 60 + b"b" * 50, np.uint8)
    start, size = np.array([0, 50, 100, 150, 210]), np.array([50, 50, 50, 60, 50])
    assert phrase_parse._exact_names(np.zeros(5, np.uint64), data, start, size).tolist() == [0, 1, 0, 3, 1]
    assert phrase_parse._exact_names(np.array([9, 8, 9, 7, 8], np.uint64), data, start, size).tolist() == [0, 1, 0, 3, 1]


def test_phrases_hold_every_window_once():
    r = np.random.default_rng(0)
    texts = [bytes(r.integers(97, 100, n).astype(np.uint8)) for n in (0, 10, 49, 50, 51, 500, 3000)] + [b"a" * 700]
    raw, ends = phrase_parse._laid(texts)
    _, first, length = phrase_parse.phrases(raw[:-16], ends)
    windows = np.concatenate([np.arange(a, a + n) for a, n in zip(first, length, strict=True)])
    want = np.concatenate([np.arange(e - len(t), e - 49) for t, e in zip(texts, ends, strict=True) if len(t) >= 50])
    assert sorted(windows.tolist()) == want.tolist() and length.max() <= phrase_parse.MOST_WINDOWS
