"""Byte-level BPE by merge replay over the distinct words of the whole corpus.

Texts are dealt into groups. Every group sends each of its distinct
blank-separated strings once, to the share of the string's hash; a share holds
all strings of its hash that occur anywhere in the corpus, each once. It splits
them into words and replays the merges on all words together: an inverted index
leads from the rank of a token pair to the word positions that hold it; ranks
are applied in ascending order, and a merge only re-indexes the two pairs it
touches. A merge can create a pair of lower rank than the current one (another
split of an earlier token); that rank is then replayed first, so every word gets
its lowest, leftmost pair at each step, as an encoder that works word by word
would. The ids go back to the groups, which read the same shuffle of texts again.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ragged import Numbers, gather, spans_of
from .shared import give_back, pack_texts, parts_for, table, text_or_empty, total_bytes

#: Bytes of text of a group and of a share (before equal strings fall together), and the least number of shares.
GROUP_BYTES = 16 << 20
SHARE_BYTES = 32 << 20
LEAST_SHARES = 12
#: Bytes of distinct strings under one inverted index: it takes about 160 bytes for each.
INDEX_BYTES = 2 << 20
#: Bytes of text decoded at a time, characters of text split at a time, and of a string that is sent unsplit.
BATCH_BYTES = 2 << 20
PIECE_CHARS = 1 << 16
STRING_CHARS = 64

#: A blank that starts a word whatever stands around it, where a long text may be cut.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Text where a run of white space may cross a blank is split as a whole.
_ODD_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|[ \n][ \n]")


class MergeReplay:
    """Ranks of byte strings; the rank of a token is its id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs: dict[int, int] = {}

    def rank(self, a: int, b: int) -> int:
        """The rank of a pair of tokens, -1 if they never merge."""
        key = a << 20 | b
        r = self.pairs.get(key)
        if r is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            r = self.pairs[key] = self.ranks.get(self.token[a] + self.token[b], -1)
        return r

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words, concatenated, and the number of each word's ids."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        n = int(length.sum())
        if not n:
            return np.zeros(0, np.uint32), length
        first = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        starts = np.cumsum(length) - length
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        full = length > 0
        after[(starts + length - 1)[full]] = -1
        before[starts[full]] = -1
        index, heap = self._index(first, after)
        ids, nxt, prv = first.tolist(), after.tolist(), before.tolist()
        rank, pairs = self.rank, self.pairs
        while heap:
            r = heapq.heappop(heap)
            places = sorted(index.pop(r))
            for i, p in enumerate(places):
                a = ids[p]
                if a < 0:
                    continue
                q = nxt[p]
                if q < 0 or rank(a, ids[q]) != r:
                    continue  # changed since it was indexed
                ids[p], ids[q] = r, -1
                s = nxt[p] = nxt[q]
                lower = False
                if s >= 0:
                    prv[s] = p
                    t = pairs.get(r << 20 | ids[s])
                    if t is None:
                        t = rank(r, ids[s])
                    if t >= 0:
                        if t in index:
                            index[t].append(p)
                        else:
                            index[t] = [p]
                            heapq.heappush(heap, t)
                        lower = t < r
                o = prv[p]
                if o >= 0:
                    t = pairs.get(ids[o] << 20 | r)
                    if t is None:
                        t = rank(ids[o], r)
                    if t >= 0:
                        if t in index:
                            index[t].append(o)
                        else:
                            index[t] = [o]
                            heapq.heappush(heap, t)
                        lower = lower or t < r
                if lower and i + 1 < len(places):
                    index[r] = places[i + 1 :]
                    heapq.heappush(heap, r)
                    break
        out = np.array(ids, np.int64)
        kept = out >= 0
        running = np.concatenate([[0], np.cumsum(kept)])
        return out[kept].astype(np.uint32), running[starts + length] - running[starts]

    def _index(self, ids: np.ndarray, after: np.ndarray) -> tuple[dict[int, list[int]], list[int]]:
        """Positions of every mergeable pair by rank."""
        at = np.flatnonzero(after >= 0)
        key = ids[at] << 20 | ids[at + 1]
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        index: dict[int, list[int]] = {}
        if not len(key):
            return index, []
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        for lo, hi in zip(cut, [*cut[1:], len(key)], strict=True):
            r = self.rank(int(key[lo]) >> 20, int(key[lo]) & (1 << 20) - 1)
            if r >= 0:
                index.setdefault(r, []).extend(at[lo:hi].tolist())
        heap = list(index)
        heapq.heapify(heap)
        return index, heap


class TextEncoder:
    """Texts to strings whose ids do not depend on what surrounds them, strings to ids, ids to bytes."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.replay = MergeReplay(ranks)
        self.find = regex.compile(pattern).findall
        tokens = [self.replay.token.get(i, b"") for i in range(max(self.replay.token) + 1)]
        self.token_length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def strings(self, text: str) -> Iterator[list[str]]:
        """The text as strings, some at a time.

        A string without a blank at its head stands for itself after a blank, one
        with a blank for what follows it, one with two for the word that follows.
        """
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + PIECE_CHARS) if len(text) - at > PIECE_CHARS else None
            to = cut.start() if cut else len(text)
            yield self._strings(text[at:to])
            at = to

    def _strings(self, text: str) -> list[str]:
        if _ODD_SPACE.search(text):
            return ["  " + w for w in self.find(text)]
        out = text.split(" ")  # every blank starts a word of its own
        if out[0]:
            out[0] = " " + out[0]
        else:
            del out[0]
        if out and len(max(out, key=len)) > STRING_CHARS:
            out = [y for x in out for y in ([x] if len(x) <= STRING_CHARS else ["  " + w for w in self.find(_plain(x))])]
        return out

    def encode_strings(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of distinct strings, concatenated, and the number of each string's ids."""
        ids, count = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        size = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
        for s in spans_of(size, INDEX_BYTES):
            split = [[x[2:]] if x.startswith("  ") else self.find(_plain(x)) for x in strings[s]]
            number = Numbers()
            n = np.fromiter(map(len, split), np.int64, len(split))
            word = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
            flat, length = self.replay.encode([w.encode("utf-8", "surrogatepass") for w in number])
            ids.append(gather(flat, (np.cumsum(length) - length)[word], length[word]))
            count.append(_sums(length[word], n))
        return np.concatenate(ids), np.concatenate(count)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a few texts, concatenated, and the number of each text's ids."""
        number = Numbers()
        found, n = _numbered(self, texts, number)
        ids, length = self.encode_strings(list(number))
        return gather(ids, (np.cumsum(length) - length)[found], length[found]), _sums(length[found], n)

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.token_bytes, self.token_start[ids], self.token_length[ids]).tobytes()


def _plain(string: str) -> str:
    return string[1:] if string.startswith(" ") else " " + string


def _sums(values: np.ndarray, each: np.ndarray) -> np.ndarray:
    """Sums over consecutive runs of `each` values."""
    running = np.concatenate([[0], np.cumsum(values)])
    end = np.cumsum(each)
    return running[end] - running[end - each]


@cache
def encoder(path: str, pattern: str) -> TextEncoder:
    """One encoder for each Python worker; it lasts over tasks."""
    return TextEncoder(path, pattern)


def _numbered(enc: TextEncoder, texts, number: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """The number of every string of the texts, and how many each text has."""
    found, n = [np.zeros(0, np.int32)], []
    for text in texts:
        before = len(found)
        for part in enc.strings(text):
            found.append(np.fromiter(map(number.__getitem__, part), np.int32, len(part)))
        n.append(sum(map(len, found[before:])))
    return np.concatenate(found), np.array(n, np.int64)


def _read_group(enc: TextEncoder, docs: pa.Table, shares: int):
    """A group's rows in an order that does not depend on the shuffle, its strings by number, and their order by share."""
    docs = docs.sort_by([("h", "ascending"), ("text", "ascending")])
    number = Numbers()
    texts = (zstandard.decompress(t.as_py()).decode("utf-8") for t in docs.column("text"))
    found, n = _numbered(enc, texts, number)
    share = np.fromiter((zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in number), np.int64, len(number)) % shares
    return docs, number, found, n, share, np.argsort(share, kind="stable")


def _pack(numbers: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte of all of them, compressed."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _unpack(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _send_strings(path: str, pattern: str, shares: int):
    """By group: its distinct strings, a row for each share."""

    def run(docs: pa.Table) -> pa.Table:
        group = docs.column("g")[0].as_py()
        _, number, _, _, share, order = _read_group(encoder(path, pattern), docs, shares)
        strings = list(number)
        rows = {"share": [], "g": [], "lengths": [], "strings": []}
        cut = np.searchsorted(share[order], np.arange(shares + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            part = [strings[i] for i in order[cut[s] : cut[s + 1]].tolist()]
            rows["share"].append(s)
            rows["g"].append(group)
            rows["lengths"].append(_pack(np.fromiter(map(len, part), np.uint32, len(part))))
            rows["strings"].append(zstandard.compress("".join(part).encode("utf-8", "surrogatepass"), 3))
        give_back()
        return pa.table({"share": pa.array(rows["share"], pa.int64()), "g": pa.array(rows["g"], pa.int64()), **{c: pa.array(rows[c], pa.binary()) for c in ("lengths", "strings")}})

    return run


def _replay_share(path: str, pattern: str):
    """By share: the ids of every string that was sent, for each group in the order it sent them."""

    def run(sent: pa.Table) -> pa.Table:
        number = Numbers()
        found = []
        for lengths, strings in zip(sent.column("lengths"), sent.column("strings"), strict=True):
            text = zstandard.decompress(strings.as_py()).decode("utf-8", "surrogatepass")
            end = np.cumsum(_unpack(lengths.as_py()), dtype=np.int64).tolist()
            found.append(np.fromiter((number[text[a:b]] for a, b in zip([0, *end], end)), np.int32, len(end)))
        ids, n = encoder(path, pattern).encode_strings(list(number))
        del number
        start = np.cumsum(n) - n
        counts = [_pack(n[f]) for f in found]
        packed = [_pack(gather(ids, start[f], n[f])) for f in found]
        give_back()
        return pa.table({"g": sent.column("g"), "share": sent.column("share"), "counts": pa.array(counts, pa.binary()), "ids": pa.array(packed, pa.binary())})

    return run


def _encode_group(path: str, pattern: str, shares: int, digest: bool):
    """By group: the ids of its strings put in the places of its texts."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        enc = encoder(path, pattern)
        docs, number, found, n, _, order = _read_group(enc, docs, shares)
        strings = len(number)
        del number
        answers = answers.sort_by("share")
        counts, flat = (np.concatenate([np.zeros(0, np.uint32), *(_unpack(x.as_py()) for x in answers.column(c))]) for c in ("counts", "ids"))
        if len(counts) != strings:
            raise RuntimeError(f"ids of {len(counts)} strings came back for {strings}")
        length = np.empty(strings, np.int64)
        start = np.empty(strings, np.int64)
        length[order] = counts
        start[order] = np.cumsum(counts, dtype=np.int64) - counts
        n_ids = _sums(length[found], n)
        strings_to, rows, decoded = np.cumsum(n), [], []
        for s in spans_of(n_ids * 4 + 1, BATCH_BYTES):
            f = found[(strings_to[s.start - 1] if s.start else 0) : strings_to[s.stop - 1]]
            ids = gather(flat, start[f], length[f])
            raw = enc.decode(ids)
            size = _sums(enc.token_length[ids], n_ids[s]).tolist()
            at = below = 0
            for k, b in zip(n_ids[s].tolist(), size, strict=True):
                row, text = ids[at : at + k], raw[below : below + b]
                at, below = at + k, below + b
                if digest:
                    rows.append(hashlib.sha256(row.astype("<u4").tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(text).hexdigest())
                else:
                    rows.append(row.astype(np.int32))
                    decoded.append(text.decode("utf-8", "replace"))
        if digest:
            made = {"n_tokens": pa.array(n_ids, pa.int64()), "ids_sha256": pa.array(rows, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
        else:
            made = {"ids": pa.array(rows, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
        give_back()
        return pa.table({"doc_id": docs.column("doc_id"), **made})

    return run


def encode_texts(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc id, ids and the decoded text of every row, or with digest=True their number and hashes.

    Null texts count as empty: no ids, decoded to nothing. Repeated rows are
    encoded each; rows equal in id and text share a group. Texts are never cut,
    and very long ones are split a piece at a time. Only doc id and text are
    read, so columns of any name may stand beside them. An empty table gives no
    rows. path is read where the task runs, as the tokenizer files are installed
    on every machine.
    """
    key = docs.schema[id_col].dataType.simpleString()
    text = text_or_empty(f"`{text_col}`")
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    size = total_bytes(docs)
    groups, shares = parts_for(size, GROUP_BYTES), parts_for(size, SHARE_BYTES, LEAST_SHARES)
    h = F.xxhash64("doc_id", "text")
    texts = pack_texts(docs.select(F.pmod(h, F.lit(groups)).alias("g"), h.alias("h"), "doc_id", "text")).groupBy("g")
    sent = texts.applyInArrow(_send_strings(path, pattern, shares), "share bigint, g bigint, lengths binary, strings binary")
    answers = sent.groupBy("share").applyInArrow(_replay_share(path, pattern), "g bigint, share bigint, counts binary, ids binary")
    columns = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"
    return texts.cogroup(answers.groupBy("g")).applyInArrow(_encode_group(path, pattern, shares, digest), f"doc_id {key}, {columns}")


def op9_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)
