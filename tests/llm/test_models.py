import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grainfold.llm import quality_cnn, quality_rules

from . import cases


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(three)
    covered = {i + k for i, x in enumerate(three) if count[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab é日\n\t#*|\x0b ")), max_size=60), max_size=5))
def test_statistics(texts):
    counts, features = quality_rules.statistics([t.encode() for t in texts])
    assert features.shape == (len(texts), len(quality_rules.FEATURES)) and np.isfinite(features).all()
    for i, t in enumerate(texts):
        assert brute(t) == tuple(int(counts[c][i]) for c in quality_rules.COUNTS)


def test_long_words_and_texts():
    texts = ["x" * 3000 + " y " + "x" * 3000 + " " + "x" * 2999 + "z", cases.words(__import__("random").Random(2), 20_000)]
    counts, _ = quality_rules.statistics([t.encode() for t in texts])
    assert [brute(t) for t in texts] == [tuple(int(counts[c][i]) for c in quality_rules.COUNTS) for i in range(2)]


def test_trees_fit_and_are_monotonic():
    r = np.random.default_rng(0)
    x = r.random((2000, 3))
    y = ((x[:, 0] + 0.3 * r.standard_normal(2000) < 0.6) ^ (x[:, 2] > 0.9)).astype(float)
    model = quality_rules.fit_trees(x, y, np.array([-1, 0, 1]))
    held = r.random((500, 3))
    assert ((model.score(held) > 0.5) == ((held[:, 0] < 0.6) ^ (held[:, 2] > 0.9))).mean() > 0.7
    for j, sign in ((0, -1), (2, 1)):
        line = np.repeat(held[:50], 40, axis=0)
        line[:, j] = np.tile(np.linspace(0, 1, 40), 50)
        steps = np.diff(model.score(line).reshape(50, 40), axis=1)
        assert (sign * steps >= -1e-12).all()


def test_flat_trees_equal_a_walk():
    r = np.random.default_rng(1)
    x = r.random((300, 4))
    model = quality_rules.fit_trees(x, (x[:, 0] > x[:, 1]).astype(float), np.zeros(4, int), trees=5)
    for row, s in zip(x[:40], model.score(x[:40]), strict=True):
        total = model.bias
        for t in range(5):
            n = 0
            while n < (1 << model.depth) - 1:
                n = 2 * n + 1 + int(row[model.feature[t, n]] > model.cut[t, n])
            total += model.leaf[t, n - (1 << model.depth) + 1]
        assert abs(1 / (1 + np.exp(-total)) - s) < 1e-12


def test_no_labels_keep_what_the_base_rules_keep(spark):
    docs = cases.clashing(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_rules.judge(docs, quality_rules.fit(docs, labels)).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((r.doc_id, *brute(r.text or "")) for r in docs.select("doc_id", "text").collect())
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed)
    kept = quality_rules.keep_documents(docs, quality_rules.fit(docs, labels))
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality_rules.judge(cases.frame(spark, []), quality_rules.fit(docs, labels)).count() == 0


def test_rules_on_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules.judge(docs, quality_rules.fit(docs, labels)).join(labels, "doc_id").collect()
    good = [r for r in got if r.quality == 1 and not r.base_failed]
    assert np.mean([r.kept for r in good]) > 0.97
    assert np.mean([r.kept for r in got if r.quality == 0]) < 0.1


def slow_pool(net, text):
    """Pooled responses of one text, position by position."""
    n = max(1, -(-(len(text) - quality_cnn.WIDTH + quality_cnn.STRIDE) // quality_cnn.STRIDE))
    raw = np.frombuffer(text + bytes(64), np.uint8)
    hot = np.array([net.embed[raw[p * quality_cnn.STRIDE : p * quality_cnn.STRIDE + quality_cnn.WIDTH]].reshape(-1) @ net.conv for p in range(n)])
    blocks = max(1, n // quality_cnn.BLOCK)
    edges = [k * quality_cnn.BLOCK for k in range(blocks)] + [n]
    chunks = [hot[edges[k] : edges[min(k + 2, blocks)]].max(0) for k in range(max(1, blocks - 1))]
    return np.concatenate([np.maximum(np.max(chunks, 0) + net.conv_bias, 0), np.maximum(np.min(chunks, 0) + net.conv_bias, 0), [np.log1p(len(text)) / 10]])


def test_pooling_covers_whole_texts():
    net = quality_cnn.Network.start()
    texts = [b"", b"a", b"abcdefgh", b"x" * 127, bytes(range(256)) * 5, "é日 ".encode() * 300, b"q" * 252 + b"end"]
    fast = quality_cnn.pooled(net, texts)
    for t, z in zip(texts, fast, strict=True):
        assert np.allclose(slow_pool(net, t), z, atol=1e-4)
    assert np.allclose(quality_cnn.pooled(net, texts[3:4]), fast[3:4], atol=1e-4)


def test_gradients():
    net = quality_cnn.Network.start(3)
    for p in net.params():
        p[...] = p.astype(np.float32)
    texts, y = [b"some text here, over and over" * 9, b"ANOTHER ONE!! " * 30, b"z"], np.array([1, 0, 1], np.float32)

    def loss():
        p = quality_cnn.probability(net, quality_cnn.pooled(net, texts))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for param, grad in zip(net.params(), quality_cnn._gradients(net, texts, y), strict=True):
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        old, eps = param[at], 1e-3
        param[at] = old + eps
        up = loss()
        param[at] = old - eps
        down = loss()
        param[at] = old
        assert abs((up - down) / (2 * eps) - grad[at]) < 0.02 * abs(grad[at]) + 1e-4


def test_cnn_on_held_out(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    from grainfold.llm.labelled import held_out

    net = quality_cnn.fit(docs, labels)
    got = quality_cnn.score(docs, net).withColumn("held", held_out()).where("held").join(labels, "doc_id").collect()
    s, y = np.array([r.score for r in got]), np.array([r.quality for r in got])
    assert (s[y == 1][:, None] > s[y == 0][None]).mean() > 0.95
    assert ((s >= quality_cnn.THRESHOLD) == y).mean() > 0.9


def test_cnn_cases(spark):
    docs = cases.clashing(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    net = quality_cnn.fit(docs, labels)
    got = quality_cnn.score(docs, net).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality_cnn.score(cases.frame(spark, []), net).count() == 0
    none = quality_cnn.fit(docs, labels.where("false"))
    assert all(abs(r.score - 0.5) < 1e-6 for r in quality_cnn.score(docs, none).collect())


def test_cnn_trains_on_whole_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_cnn, "train", lambda stream, n, share, least: seen.append((list(stream(3)), n, share)))
    monkeypatch.setattr(quality_cnn, "PART_BYTES", 70_000)
    texts = [f"{i} " + "long text " * 3_000 + "end" for i in range(8)]
    docs = spark.createDataFrame([*enumerate(texts), (0, "0 longer " + texts[0]), (1, texts[1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int")
    quality_cnn.fit(docs, labels)
    monkeypatch.setattr(quality_cnn, "PART_BYTES", 1 << 20)
    quality_cnn.fit(docs, labels)
    rows, n, share = seen[0]
    assert seen[1] == seen[0]  # the order does not depend on how much comes at a time
    turns = [rows[i : i + n] for i in range(0, len(rows), n)]
    assert len(turns) == 3 and all(sorted(t) == sorted(turns[0]) for t in turns) and len({tuple(t) for t in turns}) > 1
    assert n > 3 and share == np.mean([y for _, y in turns[0]])
    assert all(t.decode() in texts and int(t.decode()[0]) % 2 == y for t, y in turns[0])


def test_cnn_learns_whatever_the_sizes(spark, sf_dir):
    """A labelled text of 30 MB that comes first by hash: the others still are learned from."""
    from grainfold.llm.labelled import sample_ids

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    first = sample_ids(labels, 1).first()["doc_id"]
    long = docs.select("doc_id", F.when(F.col("doc_id") == first, F.repeat(F.lit("a long text of many words. "), 1_100_000)).otherwise(F.col("text")).alias("text"))
    net = quality_cnn.fit(long, labels, least=20)
    got = quality_cnn.score(docs, net).join(labels, "doc_id").where(F.col("doc_id") != first).collect()
    s, y = np.array([r.score for r in got]), np.array([r.quality for r in got])
    assert len(np.unique(s.round(6))) > 50 and (s[y == 1][:, None] > s[y == 0][None]).mean() > 0.7
