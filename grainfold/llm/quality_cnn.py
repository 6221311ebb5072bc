"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, and learned filters slide over the whole document. Their
responses are max-pooled over overlapping chunks; over the chunks of a document
the network takes the largest and the least pooled response of each filter (the
least is low where a chunk repeats itself), and a small dense layer combines
them into one probability. Training follows the gradient of log loss through
the positions that won the pooling.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import held_out, sample_ids
from .ragged import spans_of
from .shared import map_arrow, materialise, parts_for, table, text_or_empty

#: Labelled documents that the model is fitted on, at most; their texts are whole, of any size.
SAMPLE = 4_000
#: Bytes of the texts that come to the driver together, about.
PART_BYTES = 8 << 20
THRESHOLD = 0.3
SLICE_BYTES = 512 << 10

EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 6, 8, 3, 24, 16
#: Positions of a block; a chunk is two neighbouring blocks, so chunks overlap by half.
BLOCK = 42
#: Positions whose responses are held at a time.
POSITIONS = 1 << 15


@dataclass
class Network:
    embed: np.ndarray
    conv: np.ndarray
    conv_bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def start(cls, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        f = lambda *s, by: (r.standard_normal(s) / np.sqrt(by)).astype(np.float32)
        return cls(f(256, EMBED, by=1), f(WIDTH * EMBED, FILTERS, by=WIDTH * EMBED), np.zeros(FILTERS, np.float32), f(2 * FILTERS + 1, HIDDEN, by=2 * FILTERS), np.zeros(HIDDEN, np.float32), f(HIDDEN, 1, by=HIDDEN), np.zeros(1, np.float32))

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.conv_bias, self.dense, self.dense_bias, self.out, self.out_bias]


def _layout(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Where each document begins in a padded buffer, its positions, and the buffer's size."""
    positions = np.maximum(1, -(-(sizes - WIDTH + STRIDE) // STRIDE))
    room = positions * STRIDE + -(-WIDTH // STRIDE) * STRIDE
    end = np.cumsum(room)
    return end - room, positions, int(end[-1]) if len(end) else 0


def _patches(net: Network, raw: np.ndarray) -> np.ndarray:
    x = np.ascontiguousarray(net.embed[raw])
    m = (len(raw) - WIDTH) // STRIDE + 1
    return np.lib.stride_tricks.as_strided(x, (m, WIDTH * EMBED), (STRIDE * EMBED * 4, 4))


def _tops(net: Network, raw: np.ndarray, cuts: np.ndarray, stop: int) -> np.ndarray:
    """The largest response of each filter in the runs of positions from each cut to the next, POSITIONS at a time."""
    top = np.empty((len(cuts), FILTERS), np.float32)
    for s in spans_of(np.diff(cuts, append=stop), POSITIONS):
        lo, hi = int(cuts[s.start]), int(cuts[s.stop]) if s.stop < len(cuts) else stop
        hot = _patches(net, raw[lo * STRIDE : (hi - 1) * STRIDE + WIDTH]) @ net.conv
        top[s] = np.maximum.reduceat(hot, cuts[s] - lo, axis=0)
    return top


def pooled(net: Network, texts: list[bytes], keep: bool = False):
    """(documents, 2 * FILTERS + 1) pooled responses; with keep also the winning positions and the buffer.

    Texts are whole; what a text takes beyond its bytes is a hundredth of them.
    """
    if not texts:
        return np.zeros((0, 2 * FILTERS + 1), np.float32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    start, positions, room = _layout(sizes)
    raw = np.zeros(room + WIDTH, np.uint8)
    for t, s in zip(texts, start.tolist(), strict=True):
        raw[s : s + len(t)] = np.frombuffer(t, np.uint8)
    # blocks: BLOCK positions each, the last one of a document takes the rest
    blocks = np.maximum(1, positions // BLOCK)
    end = np.cumsum(blocks)
    of = np.repeat(np.arange(len(texts)), blocks)
    nth = np.arange(len(of)) - (end - blocks)[of]
    edge = start[of] // STRIDE + nth * BLOCK
    stop = (start // STRIDE + positions)[of]
    # put the gap after each document into runs of their own
    last = nth == blocks[of] - 1
    cuts = np.empty(len(of) + last.sum(), np.int64)
    where = np.arange(len(of)) + np.concatenate([[0], np.cumsum(last)[:-1]])
    cuts[where] = edge
    cuts[where[last] + 1] = stop[last]
    top = _tops(net, raw, cuts, (len(raw) - WIDTH) // STRIDE + 1)[where]
    # chunks: pairs of neighbouring blocks; a document of one block is one chunk
    chunks = np.maximum(1, blocks - 1)
    first = np.repeat((end - blocks) - (np.cumsum(chunks) - chunks), chunks) + np.arange(int(chunks.sum()))
    second = np.minimum(first + 1, np.repeat(end - 1, chunks))
    chunk = np.maximum(top[first], top[second])
    at = np.cumsum(chunks) - chunks
    most, least = np.maximum.reduceat(chunk, at, axis=0), np.minimum.reduceat(chunk, at, axis=0)
    size = (np.log1p(sizes) / 10).astype(np.float32)[:, None]
    z = np.concatenate([np.maximum(most + net.conv_bias, 0), np.maximum(least + net.conv_bias, 0), size], axis=1)
    if not keep:
        return z
    won = np.empty((len(texts), 2 * FILTERS), np.int64)
    p0 = start // STRIDE
    for d in range(len(texts)):
        part = chunk[at[d] : at[d] + chunks[d]]
        best = np.concatenate([part.argmax(0), part.argmin(0)])  # chunks that decide
        lo = best * BLOCK
        hi = np.where(best == chunks[d] - 1, positions[d], (best + 2) * BLOCK)
        for c in np.unique(best):  # their positions anew
            mine = np.flatnonzero(best == c)
            a, b = int(p0[d] + lo[mine[0]]), int(p0[d] + hi[mine[0]])
            hot = _patches(net, raw[a * STRIDE : (b - 1) * STRIDE + WIDTH]) @ net.conv[:, mine % FILTERS]
            won[d, mine] = a + hot.argmax(0)
    return z, won, raw


def probability(net: Network, z: np.ndarray) -> np.ndarray:
    h = np.maximum(z @ net.dense + net.dense_bias, 0)
    s = (h @ net.out + net.out_bias)[:, 0].astype(np.float64)
    return 1 / (1 + np.exp(-np.clip(s, -60, 60)))


def _gradients(net: Network, texts: list[bytes], y: np.ndarray) -> list[np.ndarray]:
    z, won, raw = pooled(net, texts, keep=True)
    h = np.maximum(z @ net.dense + net.dense_bias, 0)
    p = 1 / (1 + np.exp(-np.clip(h @ net.out + net.out_bias, -60, 60)))[:, 0]
    ds = ((p - y) / len(y)).astype(np.float32)[:, None]
    d_out, d_out_bias = h.T @ ds, ds.sum(0)
    dh = (ds @ net.out.T) * (h > 0)
    d_dense, d_dense_bias = z.T @ dh, dh.sum(0)
    dz = (dh @ net.dense.T)[:, :-1] * (z[:, :-1] > 0)
    at = won[:, :, None] * STRIDE + np.arange(WIDTH)  # documents, pooled, bytes of the patch
    patch = net.embed[raw[at]].reshape(len(y), 2, FILTERS, WIDTH * EMBED)
    dz2 = dz.reshape(len(y), 2, FILTERS)
    d_conv = np.einsum("dsfp,dsf->pf", patch, dz2)
    d_patch = (dz2[..., None] * net.conv.T[None, None]).reshape(-1, EMBED)
    d_embed = np.zeros_like(net.embed)
    np.add.at(d_embed, raw[at].reshape(-1), d_patch)
    return [d_embed, d_conv, dz2.sum((0, 1)), d_dense, d_dense_bias, d_out, d_out_bias]


def train(stream, n: int, share: float, *, epochs: int = 6, least: int = 400, batch: int = 32, rate: float = 4e-3, seed: int = 7) -> Network:
    """Adam on log loss, `least` steps or more. stream(m) gives the n documents (bytes, label) m times over, each time in another order.

    Texts are held for SLICE_BYTES at a time (one text at least): a batch's
    gradient is the weighted mean of its slices'. Without documents of both
    labels the network predicts their share.
    """
    net = Network.start(seed)
    known = float(np.clip(share, 0.01, 0.99))
    net.out_bias[:] = np.log(known / (1 - known))
    if n == 0 or share in (0, 1):
        net.out[:] = 0
        return net
    mean, square = ([np.zeros_like(p) for p in net.params()] for _ in range(2))
    each = -(-n // batch)
    rounds = max(epochs, -(-least // each))
    step, steps = 0, rounds * each
    held: list[tuple[bytes, float]] = []
    for k, row in enumerate(stream(rounds)):
        at = k % n % batch
        want = min(batch, n - (k % n - at))
        if at == 0:
            total, size = [np.zeros_like(p) for p in net.params()], 0
        held.append(row)
        size += len(row[0]) + 1
        if size < SLICE_BYTES and at < want - 1:
            continue
        part = _gradients(net, [t for t, _ in held], np.array([y for _, y in held], np.float32))
        total = [t + g * (len(held) / want) for t, g in zip(total, part, strict=True)]
        held, size = [], 0
        if at < want - 1:
            continue
        step += 1
        now = rate * min(1, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(net.params(), total, mean, square, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, least: int = 400) -> Network:
    """A network from the whole texts of at most `sample` labelled documents outside the held-out fold, whatever their sizes.

    The sample is written once; each round over it streams to the driver in an
    order of its own, about PART_BYTES (one text at least) at a time. An id of
    several rows counts once, by its shortest text (of equal length the first by
    hash). Without labels or documents the network gives 0.5.
    """
    some = F.broadcast(sample_ids(labels, sample))
    rows = docs.select("doc_id", text_or_empty().cast("binary").alias("text")).join(some.select("doc_id"), "doc_id", "left_semi")
    named = rows.withColumn("name", F.struct(F.octet_length("text").alias("size"), F.sha2("text", 256).alias("hash")))
    first = named.groupBy(F.col("doc_id").alias("of")).agg(F.min("name").alias("least"))
    one = named.join(first, (F.col("doc_id") == F.col("of")) & (F.col("name") == F.col("least"))).dropDuplicates(["doc_id"])
    kept = materialise(one.join(some, "doc_id").select("doc_id", "label", "text"))
    n, share, size = kept.agg(F.count("*"), F.avg("label"), F.sum(F.octet_length("text").cast("long"))).first()

    parts = parts_for(size or 0, PART_BYTES)

    def stream(rounds: int):
        if parts == 1:  # few bytes come once; their order in each round is the same as below
            turns = F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda t: F.xxhash64(t, "doc_id"))
            held = kept.select("text", "label", turns.alias("at")).orderBy("doc_id").collect()
            for turn in range(rounds):
                for r in sorted(held, key=lambda r: r["at"][turn]):
                    yield bytes(r.text), r.label
            return
        for turn in range(rounds):  # partitions by ranges of a hash, sorted within: one order of all
            at = F.xxhash64(F.lit(turn), "doc_id")
            place = F.least(F.floor((at / 2.0**64 + 0.5) * parts), F.lit(parts - 1)).cast("int")
            dealt = kept.withColumn("at", at).repartitionById(parts, place).sortWithinPartitions("at", "doc_id")
            for r in dealt.select("text", "label").toLocalIterator():
                yield bytes(r.text), r.label

    return train(stream, n, share or 0.0 if n else 0.5, least=least)


def score(docs: DataFrame, net: Network, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row, over its whole text; null texts count as empty, repeated rows are scored each. An empty table gives no rows; a very long text is pooled in parts."""

    def run(batches):
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).fill_null("")
            for s in spans_of(pc.binary_length(texts).to_numpy(zero_copy_only=False) + 1, SLICE_BYTES):
                part = texts.slice(s.start, s.stop - s.start).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_pydict({"doc_id": names.slice(s.start, s.stop - s.start), "score": pa.array(probability(net, pooled(net, part)))})

    return map_arrow(docs.select(id_col, text_col), run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")


def op4_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
