"""Quality rules: document statistics and gradient-boosted trees over them.

Statistics come from the whole text, in one pass of numpy per slice of a task's
rows. The trees are fitted on a bounded sample of labelled rows and flattened
into node arrays, by which a slice of documents descends level by level at once.
Chosen features are monotonic: more symbols, capitals or repetition never raise
the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import sample_ids
from .ragged import spans_of
from .shared import map_arrow, table

SAMPLE = 8_000
THRESHOLD = 0.3
#: Bytes of texts measured together, and of them those that take 8 bytes each at a time.
SLICE_BYTES, BLOCK_BYTES = 2 << 20, 1 << 20
#: Rules that hold before any model.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

#: Features and the sign of their effect on quality: 0 is free.
FEATURES = {
    "log_words": 0,
    "chars_per_word": 0,
    "symbols_per_word": -1,
    "dup_lines": -1,
    "repeat_words": -1,
    "upper_per_char": -1,
    "digits_per_char": 0,
    "marks_per_word": 0,
    "shouts_per_word": -1,
    "wide_per_char": 0,
    "words_per_line": 0,
    "distinct_words": 0,
}

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = np.array([pow(0x100000001B3, i, 1 << 64) for i in range(512)], np.uint64)
_BYTE_MIX = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(40))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def word_hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[first[i] : last[i]], which are not empty and in order."""
    n = last - first
    out = np.empty(len(n), np.uint64)
    for s in spans_of(n, BLOCK_BYTES):
        out[s] = _hashes(raw, first[s], n[s])
    return out


def _hashes(raw: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    start = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(start, n)
    h = _BYTE_MIX[raw[place + np.repeat(first, n)]]
    far = place >= len(_POWERS)
    if far.any():  # very long words: mixed powers, by block
        h[far] = _mix(h[far] + (place[far] // len(_POWERS)).astype(np.uint64))
        place %= len(_POWERS)
    h *= _POWERS[place]
    return _mix(np.add.reduceat(h, start) + n.astype(np.uint64))


def words_of(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of the words of texts that begin at starts."""
    word = ~_SPACE[raw]
    head = word.copy()
    head[1:] &= ~word[:-1]
    inner = starts[(starts > 0) & (starts < len(raw))]
    head[inner] = word[inner]
    tail = word.copy()
    tail[:-1] &= ~word[1:]
    tail[inner - 1] = word[inner - 1]
    return np.flatnonzero(head), np.flatnonzero(tail) + 1


def _grouped_repeats(key: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order] = same[1:] | same[:-1]
    return out


def statistics(texts: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Counts and the feature matrix of texts."""
    d = len(texts)
    size = np.fromiter(map(len, texts), np.int64, d)
    starts = np.cumsum(size) - size
    raw = np.frombuffer(b"".join(texts), np.uint8)
    hist = np.zeros((d, 256), np.int64)
    for i, t in enumerate(texts):
        for a in range(0, len(t), BLOCK_BYTES):
            hist[i] += np.bincount(np.frombuffer(t, np.uint8, min(BLOCK_BYTES, len(t) - a), a), minlength=256)
    begins = hist.copy()
    begins[:, 0x80:0xC0] = 0  # bytes within a character
    chars = begins.sum(1)
    word_chars = chars - hist[:, _SPACE].sum(1)
    symbols = hist[:, list(b"#*$%&|<>")].sum(1)
    if len(raw):
        first, last = words_of(raw, starts)
    else:
        first = last = np.zeros(0, np.int64)
    doc = np.searchsorted(starts + size, first, side="right")
    n_words = np.bincount(doc, minlength=d)
    repeat, distinct = np.zeros(d, np.int64), np.zeros(d, np.int64)
    if len(first):
        h = word_hashes(raw, first, last)
        own = _mix(h + doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        distinct = np.bincount(doc[np.unique(own, return_index=True)[1]], minlength=d)
        if len(first) > 2:
            three = _mix(own[:-2] * np.uint64(3) + _mix(h[1:-1] + np.uint64(7)) * np.uint64(5) + h[2:])
            whole = doc[:-2] == doc[2:]
            twice = np.zeros(len(three), bool)
            twice[whole] = _grouped_repeats(three[whole])
            covered = np.zeros(len(first), bool)
            for shift in range(3):
                covered[shift : len(first) - 2 + shift] |= twice
            repeat = np.bincount(doc[covered], minlength=d)
    dup_lines, lines = np.zeros(d, np.int64), np.zeros(d, np.int64)
    for i, text in enumerate(texts):
        with_word = [x for x in text.split(b"\n") if x.strip()]
        lines[i] = len(with_word)
        dup_lines[i] = len(with_word) - len(set(with_word))
    w, c = np.maximum(n_words, 1), np.maximum(chars, 1)
    features = np.column_stack(
        [
            np.log1p(n_words),
            word_chars / w,
            symbols / w,
            dup_lines / np.maximum(lines, 1),
            repeat / w,
            hist[:, 65:91].sum(1) / c,
            hist[:, 48:58].sum(1) / c,
            hist[:, list(b".,;:?")].sum(1) / w,
            hist[:, 33] / w,
            begins[:, 0xC0:].sum(1) / c,
            n_words / np.maximum(lines, 1),
            distinct / w,
        ]
    )
    counts = {"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat}
    return {k: v.astype(np.int64) for k, v in counts.items()}, features


# --- trees ---------------------------------------------------------------------------------------


@dataclass
class Trees:
    """Complete trees of one depth as arrays (tree, node): node n has the children 2n+1 and 2n+2."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for the rows of x, all rows and trees a level at a time."""
        rows = np.arange(len(x))[:, None]
        trees = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        total = self.bias + self.leaf[trees, node - (1 << self.depth) + 1].sum(1)
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Second-order boosting of log loss over quantile bins.

    A split on a feature of sign s must not order its children against s, and
    each child keeps to its side of their middle further down, so the whole
    model is monotonic in that feature.
    """
    n, k = x.shape
    inner, leaves = (1 << depth) - 1, 1 << depth
    rate_1 = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    bias = float(np.log(rate_1 / (1 - rate_1)))
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if n == 0 or y.min() == y.max():
        return Trees(feature, cut, leaf, depth, bias)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    code = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    total = np.full(n, bias)
    flat = code + np.arange(k) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        low, high = np.full(2 * leaves - 1, -np.inf), np.full(2 * leaves - 1, np.inf)
        for level in range(depth):
            for m in range((1 << level) - 1, (2 << level) - 1):
                rows = np.flatnonzero(node == m)
                low[2 * m + 1 : 2 * m + 3], high[2 * m + 1 : 2 * m + 3] = low[m], high[m]
                if len(rows) < 2:
                    node[rows] = 2 * m + 1
                    continue
                gs, hs = (np.bincount(flat[rows].ravel(), np.repeat(v[rows], k), k * bins).reshape(k, bins).cumsum(1)[:, :-1] for v in (g, h))
                gt, ht = g[rows].sum(), h[rows].sum()
                left = np.clip(gs / (hs + ridge), low[m], high[m])
                right = np.clip((gt - gs) / (ht - hs + ridge), low[m], high[m])
                gain = 2 * (left * gs + right * (gt - gs)) - left**2 * (hs + ridge) - right**2 * (ht - hs + ridge)
                base = np.clip(gt / (ht + ridge), low[m], high[m])
                gain -= 2 * base * gt - base**2 * (ht + ridge)
                for j, s in enumerate(signs):
                    gain[j, len(edges[j]) :] = -np.inf
                    if s:
                        gain[j, s * (right[j] - left[j]) < 0] = -np.inf
                gain[(hs < 1e-3) | (ht - hs < 1e-3)] = -np.inf
                j, b = np.unravel_index(np.argmax(gain), gain.shape)
                if not gain[j, b] > 1e-9:
                    node[rows] = 2 * m + 1
                    continue
                feature[t, m], cut[t, m] = j, edges[j][b]
                node[rows] = 2 * m + 1 + (code[rows, j] > b)
                if signs[j]:
                    middle = (left[j, b] + right[j, b]) / 2
                    up, down = (2 * m + 2, 2 * m + 1) if signs[j] > 0 else (2 * m + 1, 2 * m + 2)
                    low[up], high[down] = max(low[up], middle), min(high[down], middle)
        at = node - inner
        value = np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + ridge)
        leaf[t] = rate * np.clip(value, low[inner:], high[inner:])
        total += leaf[t][at]
    return Trees(feature, cut, leaf, depth, bias)


# --- Spark ---------------------------------------------------------------------------------------

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measure(docs: DataFrame, id_col: str, text_col: str, model: Trees | None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, the counts, and the features or, with a model, the score and verdict; then the extra columns."""
    schema = [f"doc_id {docs.schema[id_col].dataType.simpleString()}", *[f"{c} bigint" for c in COUNTS]]
    schema += ["features array<double>"] if model is None else ["base_failed boolean", "kept boolean", "score double"]

    def run(batches):
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).fill_null("")
            for s in spans_of(pc.binary_length(texts).to_numpy(zero_copy_only=False) + 1, SLICE_BYTES):
                counts, features = statistics(texts.slice(s.start, s.stop - s.start).cast(pa.binary()).to_pylist())
                out = {"doc_id": names.slice(s.start, s.stop - s.start)} | {c: pa.array(counts[c]) for c in COUNTS}
                if model is None:
                    out["features"] = pa.array(list(features), pa.list_(pa.float64()))
                else:
                    failed = (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED_PERCENT * counts["n_words"])
                    score = model.score(features)
                    out |= {"base_failed": pa.array(failed), "kept": pa.array(~failed & (score >= THRESHOLD)), "score": pa.array(score)}
                for c in extra:
                    out[f"x_{c}"] = batch.column(c).slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_pydict(out)

    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema += [f"`x_{c}` {types[c]}" for c in extra]
    return map_arrow(docs.select(id_col, text_col, *[c for c in extra if c not in (id_col, text_col)]), run, ", ".join(schema))


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Trees:
    """Trees from at most `sample` labelled rows; without any, every score is 1/2."""
    some = F.broadcast(sample_ids(labels, sample))
    rows = (
        _measure(docs.join(some, "doc_id", "left_semi"), "doc_id", "text", None)
        .join(some, "doc_id")
        .select("label", "features", "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "features")
        .limit(sample)
        .collect()
    )
    x = np.array([r["features"] for r in rows]).reshape(len(rows), len(FEATURES))
    y = np.array([r["label"] for r in rows], float)
    return fit_trees(x, y, np.array(list(FEATURES.values())))


def judge(docs: DataFrame, model: Trees) -> DataFrame:
    """Counts, base_failed, kept and score of every row.

    Null and empty texts have no words and fail. Repeated rows are judged each.
    An empty table gives no rows.
    """
    return _measure(docs, "doc_id", "text", model)


def keep_documents(docs: DataFrame, model: Trees) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    names = tuple(docs.columns)
    found = _measure(docs, "doc_id", "text", model, extra=names).where("kept")
    return found.select(*[F.col(f"`x_{c}`").alias(c) for c in names])


def op6_boosted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
