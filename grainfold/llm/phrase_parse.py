"""Exact substring deduplication by prefix-free parsing.

A rolling hash of k bytes triggers where it is least among the hashes of a
window of L bytes (L = 50); the windows with one trigger form a phrase, which
reaches L - 1 bytes past its last window. So phrases overlap, a phrase's text
alone says which trigger it has, and equal windows lie in phrases of equal
trigger wherever they occur. The corpus is a dictionary of distinct phrases and
a parse, the phrases of each document in turn.

The dictionary is dealt out by trigger. In each share the suffixes of its
phrases are ordered by their first L bytes: a suffix array to depth L, built by
prefix doubling on the bytes themselves. Suffixes of one rank are one L-byte
string; the parse, which gives each phrase its least document, puts the places
of each rank into corpus order. Together they tell, for every L-byte string of
the corpus, the least document where it starts. Phrases whose trigger occurs in
one document only cannot hold a repeat and are never sent.

Three passes: triggers to shares, to find those of two documents or more;
phrases with such triggers to shares, to order their suffixes; verdicts back to
the documents. Documents are dealt into groups of bounded size by a hash of
their id and text. Within tasks all is flat numpy arrays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ragged import gather, spans_of
from .shared import free_shuffles, give_back, map_arrow, materialise, pack_texts, parts_for, table, text_or_empty, total_bytes

#: Bytes of a match, and of the rolling hash.
MATCH, TRIGGER = 50, 16
#: Windows of a phrase at most: their verdict fits into 64 bits. Longer runs (periodic text) are cut.
MOST_WINDOWS = 63
#: Bytes of text of a group of documents, and of a share of the dictionary.
GROUP_BYTES, SHARE_BYTES = 6 << 20, 6 << 20
#: Bytes of phrases whose suffixes are ordered at a time.
DICTIONARY = 1 << 20
#: Bytes hashed at a time.
CHUNK = 1 << 20
#: Null ids come after all others.
LAST_ID = (1 << 63) - 1
#: A column of the way, of a name that tables do not have.
GROUP = "_group of documents"

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _C
    h ^= h >> np.uint64(29)
    return h


def _eights(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one number; raw is contiguous."""
    return np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))


def window_hash(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the MATCH bytes from each position."""
    eight = _eights(raw)
    h = np.full(len(at), _B)
    for k in (*range(0, MATCH - 8, 8), MATCH - 8):
        h += eight[at + k]
        h *= _A
        h ^= h >> np.uint64(31)
    return _mix(h)


def phrases(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigger hash, first window and number of windows of the phrases of texts laid end to end; ends: where each text ends.

    Runs also end at multiples of CHUNK; that cuts phrases, not windows.
    """
    none = np.zeros(0, np.int64)
    n = len(raw) - MATCH + 1
    if n <= 0:
        return none.astype(np.uint64), none, none
    span = MATCH - TRIGGER + 1
    out = []
    for a in range(0, n, CHUNK):
        part = raw[a : a + CHUNK + MATCH - 1]
        eight = _eights(part)
        h = eight[:-8] * _A
        h ^= h >> np.uint64(29)
        h += eight[8:] * _B
        least, width = _mix(h), 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            rest = span - width
            least = np.minimum(least[:-rest], least[rest:])
        # windows that lie in one text
        cut = np.zeros(len(least) + 1, np.int32)
        inner = ends[(ends > a) & (ends < a + len(part))] - a
        np.add.at(cut, np.maximum(inner - MATCH + 1, 0), 1)
        np.add.at(cut, np.minimum(inner, len(least)), -1)
        whole = np.cumsum(cut[:-1]) == 0
        head = whole.copy()
        head[1:] &= (least[1:] != least[:-1]) | ~whole[:-1]
        first = np.flatnonzero(head)
        stop = whole.copy()
        stop[:-1] &= (least[1:] != least[:-1]) | ~whole[1:]
        length = np.flatnonzero(stop) + 1 - first
        out.append((least[first], first + a, length))
    trigger, first, length = (np.concatenate(x) for x in zip(*out, strict=True))
    if len(length) and length.max() > MOST_WINDOWS:
        pieces = -(-length // MOST_WINDOWS)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        trigger, first, length = (np.repeat(x, pieces) for x in (trigger, first, length))
        first = first + nth * MOST_WINDOWS
        length = np.minimum(length - nth * MOST_WINDOWS, MOST_WINDOWS)
    return trigger, first, length


def phrase_key(raw: np.ndarray, trigger: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit names of phrases: trigger, length and both end windows, which cover a phrase of up to 50 windows; longer ones add the middle."""
    key = window_hash(raw, first) * np.uint64(3) + window_hash(raw, first + length - 1) * np.uint64(5)
    long = length > MATCH
    if long.any():
        key[long] += window_hash(raw, first[long] + length[long] // 2) * np.uint64(11)
    return _mix(key + trigger * np.uint64(7) + length.astype(np.uint64))


def _laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end (with slack, so that eights reach to the end), and where each ends."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    return np.frombuffer(b"".join(texts) + bytes(16), np.uint8), ends


def _runs(group_of: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], group_of[1:] != group_of[:-1]])) if len(group_of) else np.zeros(0, np.int64)


def _share_of(trigger: np.ndarray, shares: int) -> np.ndarray:
    return ((trigger * _B) >> np.uint64(20)).astype(np.int64) % shares


def _short(trigger: np.ndarray) -> np.ndarray:
    """32 bits of a trigger hash: enough to find, within a share, those that may repeat."""
    return trigger.astype(np.uint32)


def _joined(blobs, kind) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def _packed(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 3)


def _unpacked(blobs, kind) -> np.ndarray:
    return np.frombuffer(b"".join(map(zstandard.decompress, blobs)), kind)


def _triggers(shares: int):
    """Pass 1, by batch: for each share the trigger hashes of groups of documents, group by group; twice if two documents of a group have them."""

    def run(batches):
        for batch in batches:
            group = batch.column(0).to_numpy()
            raw, ends = _laid(batch.column(1).cast(pa.binary()).to_pylist())
            trigger, first, _ = phrases(raw[:-16], ends)
            doc = np.searchsorted(ends, first, side="right")
            g = group[doc]
            order = np.lexsort((doc, trigger, g))
            trigger, doc, g = trigger[order], doc[order], g[order]
            new_pair = np.ones(len(g), bool)
            new_pair[1:] = (g[1:] != g[:-1]) | (trigger[1:] != trigger[:-1])
            new_doc = new_pair.copy()
            new_doc[1:] |= doc[1:] != doc[:-1]
            nth = np.cumsum(new_doc)  # numbers a pair's documents
            nth -= np.repeat(nth[new_pair], np.diff(np.append(np.flatnonzero(new_pair), len(g))))
            keep = new_doc & (nth < 2)
            trigger, g = trigger[keep], g[keep]
            share = _share_of(trigger, shares)
            order = np.lexsort((g, share))
            trigger, g, share = trigger[order], g[order], share[order]
            cut = _runs(share)
            runs = np.union1d(cut, _runs(g))
            count = np.diff(np.append(runs, len(g)))
            rows = {c: [] for c in ("share", "groups", "counts", "triggers")}
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(g)], strict=True):
                own = slice(*np.searchsorted(runs, (a, b)))
                rows["share"].append(int(share[a]))
                rows["groups"].append(_packed(g[runs[own]]))
                rows["counts"].append(_packed(count[own]))
                rows["triggers"].append(_short(trigger[a:b]).tobytes())
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("share", pa.int64()), *[(c, pa.binary()) for c in ("groups", "counts", "triggers")]]))

    return run


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pass 1, by share: for each group of documents its triggers that occur twice or more."""
    give_back()
    trigger = _joined(pdf["triggers"], np.uint32)
    g = np.repeat(_unpacked(pdf["groups"], np.int64), _unpacked(pdf["counts"], np.int64))
    order = np.lexsort((g, trigger))
    trigger, g = trigger[order], g[order]
    same = trigger[1:] == trigger[:-1]
    twice = np.zeros(len(trigger), bool)
    twice[1:] |= same
    twice[:-1] |= same
    trigger, g = trigger[twice], g[twice]
    order = np.argsort(g, kind="stable")
    trigger, g = trigger[order], g[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (trigger[1:] != trigger[:-1])
    trigger, g = trigger[first], g[first]
    cut = _runs(g)
    share = pdf["share"].iloc[0]
    rows = [(int(g[a]), share, trigger[a:b].tobytes()) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(g)], strict=True)]
    return pd.DataFrame(rows, columns=["g", "share", "triggers"])


def _sorted_docs(t: pa.Table) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Order, texts and ids of a group's documents: by id and then text, the same in every pass."""
    ids = t.column("doc_id").cast(pa.int64()).fill_null(LAST_ID).to_numpy()
    texts = [zstandard.decompress(x) for x in t.column("text").to_pylist()]
    order = np.array(sorted(range(len(texts)), key=lambda i: (ids[i], texts[i])), np.int64)
    return order, [texts[i] for i in order], ids[order]


def _dictionary(shares: int):
    """Pass 2, by group: its distinct phrases with repeated triggers, by share, with their least document."""
    shape = pa.schema([("share", pa.int64()), ("g", pa.int64()), *[(c, pa.binary()) for c in ("trigger", "doc", "windows", "data")]])

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        give_back()  # what the group before has left
        if not docs.num_rows or not found.num_rows:
            return shape.empty_table()
        g = docs.column(GROUP)[0].as_py()
        repeated = np.sort(np.concatenate([np.frombuffer(b, np.uint32).astype(np.int64) | s << 32 for s, b in zip(found.column("share").to_pylist(), found.column("triggers").to_pylist(), strict=True)]))
        _, texts, ids = _sorted_docs(docs)
        raw, ends = _laid(texts)
        trigger, first, length = phrases(raw[:-16], ends)
        short = _share_of(trigger, shares) << 32 | _short(trigger)
        on = repeated[np.minimum(np.searchsorted(repeated, short), len(repeated) - 1)] == short
        trigger, first, length = trigger[on], first[on], length[on]
        name = phrase_key(raw, trigger, first, length)
        doc = ids[np.searchsorted(ends, first, side="right")]
        order = np.lexsort((first, name))  # documents lie in the order of their ids
        cut = _runs(name[order])
        lead = order[cut]
        later = np.maximum.reduceat(doc[order], cut) > doc[lead] if len(cut) else np.zeros(0, bool)
        share = _share_of(trigger[lead], shares)
        by = np.argsort(share, kind="stable")
        lead, share, later = lead[by], share[by], later[by]
        size = length[lead] + MATCH - 1
        data = gather(raw, first[lead], size)
        starts = np.cumsum(size) - size
        cut = _runs(share)
        stop = np.append(cut[1:], len(share))
        bounds = np.append(starts, len(data))
        windows = length[lead].astype(np.uint8) + np.where(later, 128, 0).astype(np.uint8)
        rows = {c: [] for c in shape.names}
        for a, b in zip(cut.tolist(), stop.tolist(), strict=True):
            rows["share"].append(int(share[a]))
            rows["g"].append(g)
            rows["trigger"].append(trigger[lead[a:b]].tobytes())
            rows["doc"].append(_packed(doc[lead[a:b]]))
            rows["windows"].append(windows[a:b].tobytes())
            rows["data"].append(_packed(data[bounds[a] : bounds[b]]))
        return pa.Table.from_pydict(rows, schema=shape)

    return run


def _rank(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """The rank of each key among the distinct ones, and their number."""
    order = np.argsort(keys)
    ordered = keys[order]
    step = np.zeros(len(keys), np.uint64)
    step[1:] = ordered[1:] != ordered[:-1]
    np.cumsum(step, out=step)
    rank = np.empty(len(keys), np.uint64)
    rank[order] = step
    return rank, int(step[-1]) + 1 if len(keys) else 0


def _joint(parts: list[np.ndarray], n: int) -> tuple[np.ndarray, int]:
    """Ranks of tuples of ranks below n, as many at a time as 64 bits hold."""
    bits = max(1, (n - 1).bit_length())
    rank, most = parts[0], n
    at = 1
    while at < len(parts):
        key, room = rank.copy(), 64 - max(1, (most - 1).bit_length())
        while at < len(parts) and room >= bits:
            key = key << np.uint64(bits) | parts[at]
            room -= bits
            at += 1
        rank, most = _rank(key)
    return rank, most


def suffix_ranks(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The rank of the MATCH bytes from each position of `at`, in the order of their bytes, by prefix doubling.

    data has 16 bytes of slack. Ranks of 8 bytes give those of 24, and these
    those of MATCH; where pieces overlap they agree, so order and equality are
    those of the bytes.
    """
    n = len(data) - 16
    eight, many = _rank(_eights(data)[: n + 8].byteswap())
    wide = n - 16
    ranks, many = _joint([eight[k : k + wide] for k in (0, 8, 16)], many)
    return _joint([ranks[at + k] for k in (0, 24, MATCH - 24)], many)[0]


def _exact_names(name: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers of equal phrases: those of one name are compared by bytes with the first of them."""
    order = np.argsort(name, kind="stable")
    cut = _runs(name[order])
    lead = np.empty(len(name), np.int64)
    lead[order] = np.repeat(order[cut], np.diff(np.append(cut, len(name))))
    number = lead.copy()
    later = np.flatnonzero(lead != np.arange(len(name)))
    other = size[later] != size[lead[later]]
    for s in spans_of(size[later], CHUNK):
        part = later[s][~other[s]]
        if not np.array_equal(*(gather(data, start[p], size[part]) for p in (part, lead[part]))):
            text = lambda i: data[start[i] : start[i] + size[i]].tobytes()
            other[s] |= [text(i) != text(lead[i]) for i in later[s]]
    seen: dict[tuple[int, bytes], int] = {}
    for i in later[other].tolist():  # equal names, other bytes
        number[i] = seen.setdefault((int(lead[i]), data[start[i] : start[i] + size[i]].tobytes()), i)
    return number


def _order_suffixes(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pass 2, by share: order the suffixes of the dictionary and give each group its verdicts.

    A verdict is a phrase's name and a bit for each of its windows that starts
    in a document before the group's first one with the phrase. In later
    documents of the group all windows are repeats.
    """
    give_back()
    pdf = pdf.reset_index(drop=True)
    trigger, windows = _joined(pdf["trigger"], np.uint64), _joined(pdf["windows"], np.uint8)
    doc = _unpacked(pdf["doc"], np.int64)
    later, length = windows >= 128, (windows & 127).astype(np.int64)
    data = np.frombuffer(b"".join([*map(zstandard.decompress, pdf["data"]), bytes(16)]), np.uint8)
    size = length + MATCH - 1
    start = np.cumsum(size) - size
    row = np.repeat(np.arange(len(pdf)), pdf["windows"].map(len))
    name = phrase_key(data, trigger, start, length)
    # the parse: the least document of each distinct phrase
    number = _exact_names(name, data, start, size)
    order = np.lexsort((doc, number))
    cut = _runs(number[order])
    lead = order[cut]
    least = doc[lead]
    distinct = np.empty(len(name), np.int64)
    distinct[order] = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(name))))
    # triggers with one phrase have no other place where their windows occur
    by = np.argsort(trigger[lead], kind="stable")
    runs = _runs(trigger[lead][by])
    alone = np.repeat(np.diff(np.append(runs, len(by))) == 1, np.diff(np.append(runs, len(by))))
    some = by[~alone]
    bits = np.zeros(len(lead), np.uint64)
    for s in _by_trigger(trigger[lead][some], size[lead[some]]):
        part = some[s]
        n, long = length[lead[part]], size[lead[part]]
        dictionary = np.concatenate([gather(data, start[lead[part]], long), np.zeros(16, np.uint8)])
        of = np.repeat(np.arange(len(part)), n)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        rank = suffix_ranks(dictionary, (np.cumsum(long) - long)[of] + nth)
        # the parse in the order of the suffixes: the least document of each rank
        first_doc = np.full(int(rank.max()) + 1, LAST_ID)
        np.minimum.at(first_doc, rank, least[part][of])
        seen = first_doc[rank] < least[part][of]
        bits[part] = np.bitwise_or.reduceat(np.where(seen, np.uint64(1) << nth.astype(np.uint64), np.uint64(0)), np.cumsum(n) - n)
    verdict = np.where(doc > least[distinct], ~np.uint64(0), bits[distinct])
    use = (verdict != 0) | later
    rows = []
    for r, a, b in zip(range(len(pdf)), _bounds(row, len(pdf)), _bounds(row, len(pdf), 1), strict=True):
        on = use[a:b]
        if on.any():
            rows.append((pdf["g"][r], name[a:b][on].tobytes(), verdict[a:b][on].tobytes()))
    return pd.DataFrame(rows, columns=["g", "names", "verdicts"])


def _by_trigger(trigger: np.ndarray, size: np.ndarray):
    """Slices of phrases in the order of their triggers, of about DICTIONARY bytes; those of one trigger stay together."""
    runs = _runs(trigger)
    if len(runs):
        ends = np.append(runs[1:], len(trigger))
        for s in spans_of(np.add.reduceat(size, runs), DICTIONARY):
            yield slice(int(runs[s.start]), int(ends[s.stop - 1]))


def _bounds(row: np.ndarray, n: int, shift: int = 0) -> list[int]:
    return np.searchsorted(row, np.arange(shift, n + shift), side="left").tolist()


def _removed(texts: list[bytes], ids: np.ndarray, names: np.ndarray, verdicts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts end to end, where each ends, and which bytes go."""
    raw, ends = _laid(texts)
    change = np.zeros(len(raw) + 1, np.int32)
    if len(names):
        trigger, first, length = phrases(raw[:-16], ends)
        name = phrase_key(raw, trigger, first, length)
        order = np.argsort(names)
        names, verdicts = names[order], verdicts[order]
        at = np.minimum(np.searchsorted(names, name), len(names) - 1)
        on = names[at] == name
        name, first, length, verdict = name[on], first[on], length[on], verdicts[at[on]]
        doc = ids[np.searchsorted(ends, first, side="right")]
        order = np.lexsort((first, name))
        cut = _runs(name[order])
        lead = np.empty(len(name), np.int64)
        lead[order] = np.repeat(doc[order[cut]], np.diff(np.append(cut, len(name))))
        full = (doc > lead) | (verdict == ~np.uint64(0))
        np.add.at(change, first[full], 1)
        np.add.at(change, first[full] + length[full] + MATCH - 1, -1)
        for k in range(MOST_WINDOWS):
            part = first[~full & (length > k) & (verdict >> np.uint64(k) & np.uint64(1)).astype(bool)] + k
            np.add.at(change, part, 1)
            np.add.at(change, part + MATCH, -1)
    np.cumsum(change, out=change)
    return raw, ends, change[: len(raw)] > 0


def _apply(out_schema: pa.Schema, digest: bool, counts: bool):
    """Pass 3, by group: take the repeated bytes out of its documents."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        give_back()  # what the group before has left
        if not docs.num_rows:
            return out_schema.empty_table()
        order, texts, ids = _sorted_docs(docs)
        names, verdicts = (_joined(found.column(c).to_pylist(), np.uint64) for c in ("names", "verdicts"))
        raw, ends, gone = _removed(texts, ids, names, verdicts)
        out = {c: docs.column(c).take(pa.array(order)) for c in docs.column_names if c in out_schema.names}
        kept, removed, spans = [], [], []
        for text, e in zip(texts, ends.tolist(), strict=True):
            a = e - len(text)
            off = gone[a:e]
            n = int(off.sum())
            removed.append(n)
            spans.append(int((off[1:] & ~off[:-1]).sum() + off[0]) if n else 0)
            kept.append(raw[a:e][~off].tobytes() if n else text)
        made = {"n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64())}
        out |= {c: v for c, v in made.items() if counts}
        if digest:
            out["kept_sha256"] = pa.array([hashlib.sha256(k).hexdigest() for k in kept])
        else:
            out["text"] = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
        return pa.table({c: out[c] for c in out_schema.names}).cast(out_schema)

    return run


def remove_repeats(docs: DataFrame, *, digest: bool = False, counts: bool = True) -> DataFrame:
    """Every document without the bytes of MATCH-byte strings that also start in a document of smaller doc_id.

    Returns the columns of docs with the text that is left (bytes that no longer
    make a character go too), n_bytes, n_removed and n_spans; with digest=True
    doc_id, the counts and the hash of the bytes left. Null texts stay null and
    count as empty, null ids come after all others, and rows of one id do not
    take from each other. Rows are dealt by id and text, so only rows equal in
    both meet in a task for sure. Windows are compared by their bytes; a group
    tells its own phrases apart by 64-bit names. A very long text is in one group,
    whose task holds it whole. An empty table gives no rows. Columns of docs with the
    names of the counts give way to them, unless counts=False leaves the counts out.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    size = total_bytes(docs)
    groups, shares = parts_for(size, GROUP_BYTES), parts_for(size, SHARE_BYTES)
    counted = ["n_bytes", "n_removed", "n_spans"] if counts else []
    docs = docs.drop(*counted)
    # shorter texts have no string to lose and go round the parse
    long = F.octet_length(text_or_empty()) >= MATCH
    dealt = docs.where(long).withColumn(GROUP, F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)))
    texts = pack_texts(dealt.select(GROUP, F.col("doc_id").cast("long").alias("doc_id"), "text"))

    sent = map_arrow(dealt.select(GROUP, "text"), _triggers(shares), "share bigint, groups binary, counts binary, triggers binary")
    repeated = materialise(sent.groupBy("share").applyInPandas(_repeated, "g bigint, share bigint, triggers binary"))
    free_shuffles(docs.sparkSession)

    entries = texts.groupBy(GROUP).cogroup(repeated.groupBy("g")).applyInArrow(_dictionary(shares), "share bigint, g bigint, trigger binary, doc binary, windows binary, data binary")
    verdicts = materialise(entries.groupBy("share").applyInPandas(_order_suffixes, "g bigint, names binary, verdicts binary"))
    free_shuffles(docs.sparkSession)

    numbers = "n_bytes bigint, n_removed bigint, n_spans bigint"
    if digest:
        source, kind = dealt.select(GROUP, "doc_id", "text"), docs.schema["doc_id"].dataType.simpleString()
        shape = f"doc_id {kind}, {numbers}, kept_sha256 string"
    else:
        source = dealt
        shape = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], *([numbers] if counts else [])])
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(shape))
    made = pack_texts(source).groupBy(GROUP).cogroup(verdicts.groupBy("g")).applyInArrow(_apply(arrow, digest, counts), shape)
    body = F.octet_length(text_or_empty()).cast("long")
    own = {"n_bytes": body, "n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"), "kept_sha256": F.sha2(text_or_empty(), 256)}
    short = docs.where(~long).select(*[own[c].alias(c) if c in own and (digest or c in counted) else F.col(f"`{c}`") for c in arrow.names])
    return made.union(short)


def op3_prefix_free_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)
