"""Alignment of two tokenizers over the same texts, with corpus-wide link counts.

A whole block of documents is one run of bytes: the token ends of tokenizer A
and of tokenizer B are byte offsets into it, counted once each by bincount. The
block is cut where both end, which gives the groups. Between two neighbouring
ends, of whichever tokenizer, lies the overlap of exactly one A token with one B
token: a link. Prefix sums over the block, read at the ends of its documents,
give every document's results.

Texts are encoded once. The first pass keeps the ids of every document and
counts the links of each id pair in a group of documents; the counts of all
groups are added by pair over the corpus and compared by B id; each group gets
back the totals of its own pairs, by which the second pass judges its links.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ragged import RaggedTable, spans_of
from .shared import map_arrow, materialise, parts_for, table

#: Bytes of text of a group of documents, of a block, and of a window of a block whose ends are counted at a time.
GROUP_BYTES, BLOCK_BYTES, WINDOW_BYTES = 8 << 20, 2 << 20, 1 << 20
GROUPS_A_TASK = 4
#: Chunks of text that a task remembers, and their characters.
REMEMBERED, REMEMBERED_CHARS = 400_000, 32 << 20
#: A pair of ids is one number: id of A times this, plus id of B.
B_IDS = 1 << 24

#: A blank after white space: only such texts need the slower split.
_RUN = re.compile(r"\s ")
#: Neither tokenizer has a token over the border from a character that is not white space to a blank.
_BORDER = re.compile(r"(?<=\S)(?= )")


# --- tokenizers ----------------------------------------------------------------------------------


def _byte_alphabet() -> dict[str, int]:
    """Characters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE of a tokenizers file; special tokens inside texts are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        of = _byte_alphabet()
        with open(path, encoding="utf-8") as f:
            written = json.load(f)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        special = {t["content"] for t in written["added_tokens"]}
        self.pieces = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.pieces[i] = t.encode() if t in special else bytes(of[c] for c in t)
        self.ranked = self._ranked(written, special)
        if self.ranked is not None:
            self.tokenizer = None  # a copy that would not be used

    def _ranked(self, written: dict, special: set[str]):
        """The same vocabulary for the faster library, where ids are the ranks of the merges; else None."""
        import public_tokenizers
        import tiktoken

        model, split = written["model"], written["pre_tokenizer"]
        ranks = {self.pieces[i]: i for t, i in model["vocab"].items() if t not in special}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != list(range(256, 256 + len(merged))) or written["normalizer"] or split != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            return None
        return tiktoken.Encoding("by rank", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.ranked is not None:
            return [self.ranked.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A sentencepiece model; it puts a blank before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.pieces = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        if any("▁" in p.lstrip("▁") for p in names):
            raise ValueError("a piece with a blank inside: texts cannot be encoded chunk by chunk")
        self.blank = [self.model.piece_to_id("▁")]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [ids if t else self.blank for t, ids in zip(texts, self.model.encode(texts, num_threads=1), strict=True)]


class Encoded(NamedTuple):
    """Ids of a block of texts one after the other, and how many each text has."""

    a: np.ndarray
    a_n: np.ndarray
    b: np.ndarray
    b_n: np.ndarray


class PairTokens:
    """Both tokenizers over the chunks of texts: white space up to the next border, each chunk encoded once."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.a_len, self.b_len = (np.array([len(p) for p in t.pieces], np.int32) for t in (self.a, self.b))
        if len(self.b_len) >= B_IDS:
            raise ValueError(f"over {B_IDS} ids of the second tokenizer")
        self.a_ids, self.b_ids = RaggedTable(REMEMBERED), RaggedTable(REMEMBERED)
        self.forget()

    def forget(self) -> None:
        self.a_ids.clear()
        self.b_ids.clear()
        #: Chunks that do not come back as the bytes they were, by number.
        self.unlike: set[int] = set()
        self.chars = 0

    def _learn(self, chunks: list[str]) -> None:
        at = len(self.a_ids)
        a, b = self.a.encode([f" {c}" for c in chunks]), self.b.encode(chunks)
        for n, (c, x, y) in enumerate(zip(chunks, a, b, strict=True), at):
            whole = f" {c}".encode()
            if b"".join(map(self.a.pieces.__getitem__, x)) != whole or b"".join(map(self.b.pieces.__getitem__, y)) != whole:
                self.unlike.add(n)
        for t, ids in ((self.a_ids, a), (self.b_ids, b)):
            each = np.fromiter(map(len, ids), np.int64, len(ids))
            t.add(np.fromiter((i for x in ids for i in x), np.uint32, int(each.sum())), each)
        self.chars += sum(map(len, chunks))

    def encode(self, texts: list[str | None]) -> Encoded:
        """Null and empty texts have no ids, nor has a text whose tokens do not make up its bytes."""
        if len(self.a_ids) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.forget()
        keys: list[str] = []
        count = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            led = f" {text}"
            part = [c[1:] for c in _BORDER.split(led)] if _RUN.search(led) else text.split(" ")
            keys += part
            count[i] = len(part)
        found, fresh = self.a_ids.index(keys)
        if fresh:
            self._learn(fresh)
        if self.unlike:
            wrong = np.isin(found, np.fromiter(self.unlike, np.int64, len(self.unlike)))
            lost = np.bincount(np.repeat(np.arange(len(texts)), count), wrong, len(texts)) > 0
            found, count = found[~np.repeat(lost, count)], np.where(lost, 0, count)
        out, end = [], np.cumsum(count)
        for t in (self.a_ids, self.b_ids):
            ids, each = t.ids(found)
            running = np.concatenate([[0], np.cumsum(each)])
            out += [ids, running[end] - running[end - count]]
        return Encoded(*out)


@cache
def pair_tokens(a_path: str, b_path: str) -> PairTokens:
    """One for each Python worker; tasks forget the chunks when they end."""
    return PairTokens(a_path, b_path)


@cache
def token_lengths(a_path: str, b_path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of every token of both tokenizers, without keeping those."""
    return tuple(np.array([len(p) for p in t.pieces], np.int32) for t in (ByteLevel(a_path), Pieces(b_path)))


# --- alignment of a block ------------------------------------------------------------------------


class Window(NamedTuple):
    """A part of a block that ends where both tokenizers end; all offsets are those of the block."""

    start: int  # bytes
    a_from: int  # tokens before the window
    b_from: int
    a_ends: np.ndarray  # 1 at each byte of the window that ends a token
    b_ends: np.ndarray


def windows(a_len: np.ndarray, b_len: np.ndarray, size: int = WINDOW_BYTES) -> Iterator[Window]:
    """Cut a block into windows of about `size` bytes, for token lengths whose sums agree."""
    a_end, b_end = np.cumsum(a_len, dtype=np.int64), np.cumsum(b_len, dtype=np.int64)
    total = int(a_end[-1]) if len(a_end) else 0
    at = ia = ib = 0
    while at < total:
        width = size
        while True:  # wider, until both end somewhere
            to = min(at + width, total)
            ja, jb = np.searchsorted(a_end, to, side="right"), np.searchsorted(b_end, to, side="right")
            a_mark = np.bincount(a_end[ia:ja] - at - 1, minlength=to - at)
            b_mark = np.bincount(b_end[ib:jb] - at - 1, minlength=to - at)
            both = np.flatnonzero(a_mark & b_mark)
            if len(both):
                break
            width *= 2
        stop = int(both[-1]) + 1
        a_mark, b_mark = a_mark[:stop], b_mark[:stop]
        yield Window(at, ia, ib, a_mark, b_mark)
        ia, ib, at = ia + int(a_mark.sum()), ib + int(b_mark.sum()), at + stop


def links(w: Window) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A token, B token and end byte of each link: the parts between neighbouring ends."""
    at = np.flatnonzero(w.a_ends | w.b_ends)
    before_a, before_b = (np.cumsum(m)[at] - m[at] for m in (w.a_ends, w.b_ends))
    return w.a_from + before_a, w.b_from + before_b, w.start + at + 1


def group_order(w: Window) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the window's A and B tokens when each group lists its A, then its B tokens; and which end their group."""
    both = w.a_ends & w.b_ends
    before = np.cumsum(both) - both
    cut = np.flatnonzero(both)
    out = []
    ends = [np.flatnonzero(m) for m in (w.a_ends, w.b_ends)]
    upto_a, upto_b = (np.cumsum(m)[cut] for m in (w.a_ends, w.b_ends))
    out.append(np.arange(len(ends[0])) + np.concatenate([[0], upto_b])[before[ends[0]]])
    out.append(np.arange(len(ends[1])) + upto_a[before[ends[1]]])
    return (*out, both[ends[0]], both[ends[1]])


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of all parts (pairs, counts), ascending, and the sums of their counts."""
    kept, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    return kept, np.bincount(at, np.concatenate([n for _, n in parts]), len(kept)).astype(np.int64)


def _doc_sums(ends: np.ndarray, values: np.ndarray, doc_end: np.ndarray, into: np.ndarray) -> None:
    """Add the values at ascending byte offsets to the documents that hold them, by differences of prefix sums."""
    if not len(ends):
        return
    first, last = np.searchsorted(doc_end, ends[[0, -1]])
    here = np.searchsorted(ends, doc_end[first : last + 1], side="right")
    running = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    into[first : last + 1] += np.diff(running[np.concatenate([[0], here])])


# --- both passes ---------------------------------------------------------------------------------


def _first_pass(a_path: str, b_path: str, key: pa.DataType, group_bytes: int):
    """Rows of kind doc (the compressed ids of a block of documents) and of kind pair (a group's links of an id pair)."""

    def run(batches):
        enc = pair_tokens(a_path, b_path)
        enc.forget()
        zip_ = zstandard.ZstdCompressor(level=3)
        part = TaskContext.get().partitionId() << 32
        held, pairs, group = 0, [], 0

        def pair_rows():
            found, n = _counted(pairs)
            for at in range(0, len(found), 1 << 16):
                p = found[at : at + (1 << 16)]
                yield _rows(len(p), key, kind=["pair"] * len(p), grp=[part + group] * len(p), pair=p, n=n[at : at + (1 << 16)])

        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            size = pc.binary_length(texts.fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            for s in spans_of(size, BLOCK_BYTES):
                more = int(size[s].sum())
                if held and held + more > group_bytes:
                    if pairs:
                        yield from pair_rows()
                    held, pairs, group = 0, [], group + 1
                held += more
                e = enc.encode(texts.slice(s.start, s.stop - s.start).to_pylist())
                for w in windows(enc.a_len[e.a], enc.b_len[e.b]):
                    a, b, _ = links(w)
                    pairs.append(np.unique(e.a[a].astype(np.int64) * B_IDS + e.b[b], return_counts=True))
                if len(pairs) > 32:
                    pairs = [_counted(pairs)]
                m = s.stop - s.start
                listed = pa.ListArray.from_arrays(pa.array([0, m], pa.int32()), names.slice(s.start, m))
                packed = {c: [zip_.compress(ids.astype(_id_type(n)).tobytes())] for c, ids, n in (("a", e.a, len(enc.a_len)), ("b", e.b, len(enc.b_len)))}
                yield _rows(1, key, kind=["doc"], grp=[part + group], doc_ids=listed, n_a=[e.a_n.tolist()], n_b=[e.b_n.tolist()], **packed)
        if pairs:
            yield from pair_rows()
        enc.forget()

    return run


def _id_type(n: int) -> str:
    return "<u2" if n <= 1 << 16 else "<u4"


def _rows(m: int, key: pa.DataType, **given) -> pa.RecordBatch:
    kinds = {"kind": pa.string(), "grp": pa.int64(), "doc_ids": pa.list_(key), "n_a": pa.list_(pa.int64()), "n_b": pa.list_(pa.int64()), "a": pa.binary(), "b": pa.binary(), "pair": pa.int64(), "n": pa.int64()}
    columns = {c: given[c] if isinstance(given.get(c), pa.Array) else pa.array(given[c], t) if c in given else pa.nulls(m, t) for c, t in kinds.items()}
    return pa.RecordBatch.from_pydict(columns)


def _second_pass(a_path: str, b_path: str, with_groups: bool):
    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        a_len, b_len = token_lengths(a_path, b_path)
        pair, total, best = (known.column(c).to_numpy() for c in ("pair", "total", "best"))
        order = np.argsort(pair)
        pair, total, best = pair[order], total[order], best[order]
        unzip = zstandard.ZstdDecompressor()
        out = []
        for row in docs.to_batches():
            for i in range(row.num_rows):
                names = row.column("doc_ids").slice(i, 1).flatten()
                n_a, n_b = (row.column(c).slice(i, 1).flatten().to_numpy() for c in ("n_a", "n_b"))
                a, b = (np.frombuffer(unzip.decompress(row.column(c)[i].as_buffer()), _id_type(len(size))) for c, size in (("a", a_len), ("b", b_len)))
                found = _measured(Encoded(a, n_a, b, n_b), a_len, b_len, pair, total, best, with_groups)
                out.append(pa.table({"doc_id": names, "n_a": n_a, "n_b": n_b} | found))
        return pa.concat_tables(out)

    return run


def _measured(e: Encoded, a_len, b_len, pair, total, best, with_groups: bool) -> dict:
    """The columns of a block's documents; pair, ascending, with its corpus-wide total and whether it is the best of its B id."""
    size = len(e.a_n)
    n_groups, n_links, n_best, count_sum = (np.zeros(size, np.int64) for _ in range(4))
    a_upto, b_upto = np.cumsum(e.a_n), np.cumsum(e.b_n)
    doc_end = np.concatenate([[0], np.cumsum(a_len[e.a], dtype=np.int64)])[a_upto]
    parts: dict[int, list[str]] = {}
    for w in windows(a_len[e.a], b_len[e.b]):
        la, lb, end = links(w)
        at = np.searchsorted(pair, e.a[la].astype(np.int64) * B_IDS + e.b[lb])
        _doc_sums(end, np.ones(len(end), np.int64), doc_end, n_links)
        _doc_sums(end, best[at].astype(np.int64), doc_end, n_best)
        _doc_sums(end, total[at], doc_end, count_sum)
        cuts = w.start + np.flatnonzero(w.a_ends & w.b_ends) + 1
        _doc_sums(cuts, np.ones(len(cuts), np.int64), doc_end, n_groups)
        if with_groups:
            _write_groups(w, e.a, e.b, len(a_len), len(b_len), _words(len(a_len), len(b_len)), doc_end, a_upto, b_upto, parts)
    found = {"n_groups": n_groups, "n_links": n_links, "n_best": n_best, "count_sum": count_sum}
    return found | ({"groups": pa.array(["".join(parts.get(i, ""))[:-1] for i in range(size)], pa.string())} if with_groups else {})


@cache
def _words(n_a: int, n_b: int) -> np.ndarray:
    """Every id as text with each mark that can follow it: A ids with , and |, B ids with , and ;"""
    return np.array([f"{i}{mark}" for n, marks in ((n_a, ",|"), (n_b, ",;")) for mark in marks for i in range(n)], object)


def _write_groups(w: Window, a, b, n_a: int, n_b: int, words, doc_end, a_upto, b_upto, parts) -> None:
    """Append the text of the window's groups to their documents."""
    place_a, place_b, last_a, last_b = group_order(w)
    k, m = len(place_a), len(place_b)
    code = np.empty(k + m, np.int64)
    code[place_a] = n_a * last_a.astype(np.int64) + a[w.a_from : w.a_from + k]
    code[place_b] = 2 * n_a + n_b * last_b.astype(np.int64) + b[w.b_from : w.b_from + m]
    stop = w.start + len(w.a_ends)
    first, last = np.searchsorted(doc_end, [w.start + 1, stop])
    at = 0
    for i in range(first, last + 1):
        to = min(int(a_upto[i] - w.a_from), k) + min(int(b_upto[i] - w.b_from), m)
        if to > at:
            parts.setdefault(i, []).append("".join(words[code[at:to]].tolist()))
        at = to


def align(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", groups: bool = True, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """How the tokens of two tokenizers align in every text.

    Returns the id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose
    pair has the highest corpus-wide count of its B id, ties included),
    count_sum (corpus-wide counts added over the links) and, if wanted, groups:
    `a1,a2|b1;a3|b2`, the ids of each group.

    A null or empty text, or one that either tokenizer does not give back byte
    by byte, has no tokens: zeros and an empty string. Repeated rows each get a
    row and count each. A very long text is a group of its own; its ends are
    counted window by window. Null ids are kept, other columns are not read. An
    empty table gives no rows.
    """
    key = docs.schema[id_col].dataType
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    from pyspark.sql.pandas.types import to_arrow_type

    shape = f"kind string, grp long, doc_ids array<{key.simpleString()}>, n_a array<long>, n_b array<long>, a binary, b binary, pair long, n long"
    first = materialise(map_arrow(rows, _first_pass(a_path, b_path, to_arrow_type(key), group_bytes), shape), by="kind")
    encoded = first.where("kind = 'doc'").select("grp", "doc_ids", "n_a", "n_b", "a", "b")
    counted = first.where("kind = 'pair'").select("grp", "pair", "n")
    totals = materialise(counted.groupBy("pair").agg(F.sum("n").alias("total")))
    # one row for each id of the second vocabulary at most
    highest = totals.groupBy((F.col("pair") % B_IDS).alias("b")).agg(F.max("total").alias("highest"))
    judged = totals.join(highest, F.col("pair") % B_IDS == F.col("b")).select("pair", "total", (F.col("total") == F.col("highest")).cast("int").alias("best"))
    known = counted.drop("n").join(judged, "pair").select(F.col("grp").alias("of"), "pair", "total", "best")
    # as many tasks as the groups need: a few groups each, at every size of the input
    tasks = parts_for(counted.select("grp").distinct().count(), GROUPS_A_TASK, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = f"doc_id {key.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long" + ", groups string" * groups
    left, right = encoded.repartition(tasks, "grp"), known.repartition(tasks, "of")
    return left.groupBy("grp").cogroup(right.groupBy("of")).applyInArrow(_second_pass(a_path, b_path, groups), out)


def op11_batch_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))
