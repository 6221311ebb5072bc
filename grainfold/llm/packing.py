"""Best-fit packing of token sequences, improved by a swap-based local search.

Pieces are dealt at random into groups of bounded size. In a group, best fit in
decreasing order makes bins; then a local search takes the emptiest bin and
moves its pieces into fuller ones: by a plain move, by one piece for one
smaller, or by two pieces for one smaller. Each step shifts tokens from an
emptier to a fuller bin and so raises the sum of squared fills; bins that lose
their last piece are gone. The emptiest bins of all groups then meet in fewer
groups, level by level, until one group is left, so that the number of groups
does not cost sequences.
"""

from __future__ import annotations

import re
import zlib
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ragged import RaggedTable, spans_of
from .shared import map_arrow, materialise, parts_for, table

CAPACITY = 2048
#: Pieces of a group, bins of a group that stay open for the next level, groups that meet there.
GROUP_PIECES = 50_000
OPEN_BINS = 16
MEET = 64
#: Bytes of text split at a time, and strings that a worker remembers.
BATCH_BYTES = 2 << 20
REMEMBERED = 500_000
#: Marks the end of a document.
END_ID = 0

#: Words that the tokenizer gets at a time.
WORD_BATCH = 20_000
#: Characters of a text that the tokenizer gets whole, about.
WHOLE_CHARS = 1 << 20

#: Characters that str.split() takes for white space and the tokenizer does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
#: The words of the tokenizer's own split; the encoding of a text is that of its words in turn.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


# --- packing in memory ---------------------------------------------------------------------------


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that holds it."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: some bin has r tokens left
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                mask ^= 1 << r
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        r -= n
        if r:
            free[r].append(b)
            mask |= 1 << r
    return bins


def local_search(lengths: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Empty bins by moves and swaps that raise the sum of squared fills."""
    fill = np.array([int(lengths[b].sum()) for b in bins], np.int64)
    open_ = [b for b in np.argsort(fill, kind="stable").tolist() if fill[b] < capacity]
    if len(open_) < 2 or fill[open_].sum() <= 0:
        return bins
    item = np.concatenate([np.array(bins[b], np.int64) for b in open_])
    size = lengths[item].astype(np.int64)
    home = np.repeat(np.array(open_, np.int64), [len(bins[b]) for b in open_])
    total = int(lengths.sum())
    least = -(-total // capacity)
    better = True
    while better and np.count_nonzero(fill) > least:
        better = False
        for b in sorted(open_, key=lambda b: int(fill[b])):
            while _step(b, size, home, fill, capacity):
                better = True
    searched = set(open_)
    closed = [x for n, x in enumerate(bins) if n not in searched]
    by_home: dict[int, list[int]] = {}
    for i, h in zip(item.tolist(), home.tolist(), strict=True):
        by_home.setdefault(h, []).append(i)
    return closed + list(by_home.values())


def _step(b: int, size: np.ndarray, home: np.ndarray, fill: np.ndarray, capacity: int) -> bool:
    """One move or swap out of bin b, if one raises the squared fill. Longest piece first."""
    mine = np.flatnonzero(home == b)
    if not len(mine):
        return False
    mine = mine[np.argsort(-size[mine], kind="stable")]
    room = capacity - fill[home]
    other = (home != b) & (fill[home] >= fill[b])
    spare = np.where(other, room, -1)
    for y in mine:  # a move, into the bin that it fills best
        fits = spare >= size[y]
        if fits.any():
            a = home[np.flatnonzero(fits)[np.argmin(spare[fits])]]
            fill[a] += size[y]
            fill[b] -= size[y]
            home[y] = a
            return True
    best = (0, None)
    for y in mine:  # one for one: a smaller piece comes back
        gain = np.where(other, size[y] - size, 0)
        gain[gain > room] = 0
        x = int(np.argmax(gain))
        if gain[x] > best[0]:
            best = (int(gain[x]), ([y], x))
    if best[1] is None and len(mine) > 1:  # two for one
        for i, y in enumerate(mine[:-1]):
            for z in mine[i + 1 :]:
                gain = np.where(other, size[y] + size[z] - size, 0)
                gain[gain > room] = 0
                x = int(np.argmax(gain))
                if gain[x] > best[0]:
                    best = (int(gain[x]), ([y, z], x))
    if best[1] is None:
        return False
    ours, x = best[1]
    a = home[x]
    fill[a] += best[0]
    fill[b] -= best[0]
    home[ours] = a
    home[x] = b
    return True


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(lengths, best_fit(lengths, capacity), capacity)


# --- packing in Spark ----------------------------------------------------------------------------


def _pack_group(open_bins: int, capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        bins = sorted(pack(lengths, capacity), key=lambda b: int(lengths[b].sum()))
        row, number, offset, left = (np.zeros(len(pdf), np.int64) for _ in range(4))
        for n, b in enumerate(bins):
            size = lengths[b]
            end = np.cumsum(size)
            row[b], number[b], offset[b] = pdf["row"].to_numpy()[b], n, end - size
            left[b] = n < open_bins and end[-1] < capacity
        return pd.DataFrame({"row": row, "length": lengths, "pack": pdf["pack"], "bin": number, "place": offset, "left": left.astype(bool)})

    return run


def pack_pieces(pieces: DataFrame, *, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, open_bins: int = OPEN_BINS) -> DataFrame:
    """row, sequence_id, place for pieces(row, length): row is a key, 0 < length <= capacity.

    Full pieces are sequences of their own. An empty table gives no rows. Equal
    lengths are taken in the order of row.
    """
    small = pieces.where(F.col("length") < capacity).select("row", F.col("length").cast("long").alias("length"))
    level, groups = 0, parts_for(small.count(), group_pieces)
    pool = small.withColumn("pack", F.pmod(F.xxhash64("row"), F.lit(groups)))
    done = pieces.where(F.col("length") >= capacity).select("row", (F.lit(1 << 62) + F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("place"))
    shape = "row long, length long, pack long, bin long, place long, left boolean"
    while True:
        packed = materialise(pool.groupBy("pack").applyInPandas(_pack_group(open_bins if groups > 1 else 0, capacity), shape))
        number = F.lit(level << 56) + F.shiftleft(F.col("pack"), 24) + F.col("bin")
        done = done.unionByName(packed.where(~F.col("left")).select("row", number.alias("sequence_id"), "place"))
        if groups == 1:
            return done
        groups = parts_for(groups, MEET)
        level += 1
        pool = packed.where("left").select("row", "length", F.pmod("pack", F.lit(groups)).alias("pack"))


# --- tokens --------------------------------------------------------------------------------------


class WordTokens:
    """Ids of texts by a tokenizer of the tokenizers library, whose words it encodes once each."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence
        from tokenizers.pre_tokenizers import ByteLevel, Split
        from tokenizers.pre_tokenizers import Sequence as InTurn

        self.tokenizer, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # for words in lower case, one blank apart
        self.bare.encode_special_tokens = True
        self.bare.normalizer = Sequence([])
        self.bare.pre_tokenizer = InTurn([Split(" ", "removed"), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        #: Texts with the string of an added token hold that token.
        self.added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(self.tokenizer.model.end_of_word_suffix)]] = True
        self.chunks, self.words = RaggedTable(REMEMBERED), RaggedTable(REMEMBERED)

    def _whole(self, text: str) -> np.ndarray:
        """Ids of a text as the tokenizer gives them; long ones in parts, as no token has a blank."""
        out, at = [], 0
        while at < len(text):
            to = text.find(" ", at + WHOLE_CHARS)
            to = len(text) if to < 0 else to
            out += self.tokenizer.encode(text[at:to], add_special_tokens=False).ids
            at = to
        return np.array(out, np.uint32)

    def _learn_words(self, words: list[str]) -> None:
        """The last token of every word, and only that, ends a word."""
        for a in range(0, len(words), WORD_BATCH):
            part = words[a : a + WORD_BATCH]
            ids = np.array(self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            self.words.add(ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1))

    def _learn(self, chunks: list[str]) -> None:
        if len(self.words) > self.words.most:
            self.words.clear()
        split = [(c,) if c.isalpha() else _WORD.findall(c) for c in chunks]
        found, fresh = self.words.index([w for x in split for w in x])
        self._learn_words(fresh)
        ids, each = self.words.ids(found)
        n = np.fromiter(map(len, split), np.int64, len(split))
        running, end = np.concatenate([[0], np.cumsum(each)]), np.cumsum(n)
        self.chunks.add(ids, running[end] - running[end - n])

    def forget(self, most: int = REMEMBERED) -> None:
        for t in (self.chunks, self.words):
            t.most = most
            t.clear()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. White space never is part of a token, so texts split there first."""
        if len(self.chunks) > self.chunks.most:
            self.chunks.clear()
        keys: list[str] = []
        count = np.zeros(len(texts), np.int64)
        whole: dict[int, np.ndarray] = {}
        for i, text in enumerate(texts):
            if not text.isascii() and not _plain(text) or _NOT_SPACE.search(text) or any(t in text for t in self.added):
                whole[i] = self._whole(text)
                continue
            part = text.lower().split()
            keys += part
            count[i] = len(part)
        found, fresh = self.chunks.index(keys)
        if fresh:
            self._learn(fresh)
        ids, each = self.chunks.ids(found)
        running, end = np.concatenate([[0], np.cumsum(each)]), np.cumsum(count)
        return [whole[i] if i in whole else ids[running[e - n] : running[e]] for i, (e, n) in enumerate(zip(end, count, strict=True))]


def _plain(text: str) -> bool:
    """Latin text, in which lower case and composition do not depend on the context."""
    return not _BEYOND_LATIN.search(text)


_BEYOND_LATIN = re.compile("[^\x00-ÿ]")


@cache
def word_tokens(path: str) -> WordTokens:
    """One for each Python worker; tasks forget the words when they end, so an idle worker holds little."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordTokens(path)


def cut_pieces(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = True, remembered: int = REMEMBERED) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 and, if wanted, ids.

    Null texts count as empty: one piece that holds the end id. Repeated rows
    have pieces of their own. Only documents over the capacity are cut.
    remembered bounds the words that a task keeps: fewer take less memory and
    more time.
    """
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = word_tokens(path)
        enc.forget(remembered)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).fill_null("")
            for s in spans_of(pc.binary_length(texts).to_numpy(zero_copy_only=False) + 1, BATCH_BYTES):
                of, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, ids in enumerate(enc.encode(texts.slice(s.start, s.stop - s.start).to_pylist()), s.start):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at : at + capacity]
                        of.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if keep_ids:
                            kept.append(part.astype(np.int32))
                out = {"doc_id": names.take(pa.array(of, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                if keep_ids:
                    out["ids"] = pa.array(kept, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)
        enc.forget()

    columns = "piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    return map_arrow(docs.select(id_col, text_col), run, f"doc_id {key}, {columns}")


def pack_documents(docs: DataFrame, path: str, *, keep_ids: bool = True, **names) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset there."""
    pieces = materialise(cut_pieces(docs, path, keep_ids=keep_ids, **names).withColumn("row", F.monotonically_increasing_id()))
    where = pack_pieces(pieces.select("row", "length"))
    return pieces.join(where, "row").drop("row").withColumnRenamed("place", "offset")


def op5_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
