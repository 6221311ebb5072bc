"""Near duplicates by BagMinHash signatures, banding and verified multiset overlap.

A text is the multiset of its five-word shingles. For every shingle a Poisson
process runs over (time, weight): its weight axis is cut into the cells [0, 1),
[1, 2), [2, 4), [4, 8), ..., each with a process of its own whose rate is the
cell's length, seeded by the shingle and the cell. A text sees the points below
its weight; each point goes to a random component, and the first point of a
component is its signature value. Two texts see the same point in proportion to
the least of their weights, so agreement of components estimates the weighted
Jaccard similarity without bias. Processes are followed only while they can
still lower the largest value of their text's signature.

Texts that agree on a band meet in its bucket. A bucket is a star around one
text; the multiset overlap of each pair is verified. Links are contracted to
components after every round, and what a star leaves in another component
meets again in finer buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .quality_rules import _mix, word_hashes, words_of
from .ragged import spans_of
from .shared import free_shuffles, map_arrow, materialise, pack_texts, table, text_or_empty

WORDS = 5
#: Similarity of a link: overlap / union of the multisets, as a fraction.
LINK = (4, 5)
BANDS, ROWS = 16, 4
COMPONENTS = BANDS * ROWS
#: Texts apart in a bucket up to which they are compared directly.
FEW_APART = 32
#: Between a text that shares too little outside the centre of its star and one short enough for that.
SHORT = "short"
SLICE_BYTES = 3 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, hash, weight of the distinct shingles of texts, in the order of doc and hash.

    A text of fewer than five words, but one at least, has one shingle of all its words.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    empty = np.zeros(0, np.int64)
    if not len(raw):
        return empty, empty.astype(np.uint64), empty
    first, last = words_of(raw, np.cumsum(size) - size)
    if not len(first):
        return empty, empty.astype(np.uint64), empty
    doc = np.searchsorted(np.cumsum(size), first, side="right")
    h = word_hashes(raw, first, last)
    n = np.bincount(doc, minlength=len(texts))
    head = np.cumsum(n) - n
    place = np.arange(len(doc)) - head[doc]
    starts = np.flatnonzero(place + np.minimum(WORDS, n[doc]) <= n[doc])
    of = doc[starts]
    acc = np.full(len(starts), np.uint64(17))
    for k in range(WORDS):
        inside = k < n[of]
        word = h[np.minimum(starts + k, len(h) - 1)]
        acc = np.where(inside, _mix(acc * np.uint64(3) + word * _GOLD + np.uint64(k)), acc)
    order = np.lexsort((acc, of))
    of, acc = of[order], acc[order]
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (acc[1:] != acc[:-1])])
    at = np.flatnonzero(new)
    return of[at], acc[at], np.diff(np.append(at, len(of)))


def bag_min_hash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, m: int = COMPONENTS) -> np.ndarray:
    """(n_docs, m) signatures as uint32; rows of texts without shingles are 0."""
    values = np.full(n_docs * m, np.inf)
    # one stream for each shingle and cell of the weight axis that it reaches
    level = np.zeros(len(h), np.int64)
    streams = [(doc, h, level, weight)]
    for j in range(1, 62):
        reach = weight > (1 << (j - 1))
        if not reach.any():
            break
        streams.append((doc[reach], h[reach], level[reach] + j, weight[reach]))
    d, s, j, w = (np.concatenate(x) for x in zip(*streams, strict=True))
    low = np.where(j == 0, 0, 1 << np.maximum(j - 1, 0)).astype(np.float64)
    length = np.where(j == 0, 1, 1 << np.maximum(j - 1, 0)).astype(np.float64)
    seed = _mix(s + j.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    time = np.zeros(len(d))
    step = 0
    largest = np.full(n_docs, np.inf)
    while len(d):
        step += 1
        r = _mix(seed + np.uint64(step * int(_GOLD) % (1 << 64)))
        time = time - np.log(((r >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)) / length
        on = time < largest[d]
        if not on.all():
            d, seed, time, low, length, w, r = (x[on] for x in (d, seed, time, low, length, w, r))
        r = _mix(r + np.uint64(0x165667B19E3779F9))
        part = (r % np.uint64(m)).astype(np.int64)
        cell = low + np.floor((r >> np.uint64(12)).astype(np.float64) / float(1 << 52) * length)
        seen = cell < w
        np.minimum.at(values, d[seen] * m + part[seen], time[seen])
        touched = np.unique(d)
        largest[touched] = values.reshape(n_docs, m)[touched].max(1)
    values = values.reshape(n_docs, m)
    out = (_mix(values.view(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    out[np.isinf(values)] = 0
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, th (a hash of the text), k1, k2, n (of shingles), bands array<bigint> of every row; k1 and k2 name the multiset."""

    def run(batches):
        for batch in batches:
            names, texts, th = batch.column(0), batch.column(1).fill_null(""), batch.column(2)
            for s in spans_of(pc.binary_length(texts).to_numpy(zero_copy_only=False) + 1, SLICE_BYTES):
                part = texts.slice(s.start, s.stop - s.start).cast(pa.binary()).to_pylist()
                doc, h, weight = shingles(part)
                sig = bag_min_hash(doc, h, weight, len(part))
                n = np.bincount(doc, weight, len(part)).astype(np.int64) if len(doc) else np.zeros(len(part), np.int64)
                keys = np.zeros((2, len(part)), np.uint64)
                for i, salt in enumerate((0x9FB21C651E98DF25, 0xE7037ED1A0B428DB)):
                    np.add.at(keys[i], doc, _mix(_mix(h + np.uint64(salt)) + weight.astype(np.uint64) * _GOLD))
                acc = np.zeros((len(part), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD
                for k in range(ROWS):
                    acc = _mix(acc + sig[:, k::ROWS][:, :BANDS])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": names.slice(s.start, s.stop - s.start),
                        "th": th.slice(s.start, s.stop - s.start),
                        "k1": pa.array(keys[0].view(np.int64)),
                        "k2": pa.array(keys[1].view(np.int64)),
                        "n": pa.array(n),
                        "bands": pa.array(list(acc.view(np.int64)), pa.list_(pa.int64())),
                    }
                )

    return map_arrow(docs.select("doc_id", "text", _text_hash().alias("th")), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th bigint, k1 bigint, k2 bigint, n bigint, bands array<bigint>")


def _text_hash() -> Column:
    return F.xxhash64(text_or_empty())


def _members(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's multiset ends, and its members as distinct hashes: the first, second, ... copy of a shingle differ."""
    doc, h, weight = shingles(texts)
    of = np.repeat(doc, weight)
    copy = np.arange(len(of)) - np.repeat(np.cumsum(weight) - weight, weight)
    return np.cumsum(np.bincount(of, minlength=len(texts))), _mix(np.repeat(h, weight) + copy.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _compare(batches):
    """For pairs (a, b) of texts: whether they are linked, both sizes, the overlap, and in order the members that a has and b lacks."""
    for batch in batches:
        x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for s in spans_of(np.fromiter(map(len, x), np.int64, len(x)) + np.fromiter(map(len, y), np.int64, len(y)), SLICE_BYTES // 4):
            # a text that stands in many pairs is read once
            place: dict[bytes, int] = {}
            at_x, at_y = ([place.setdefault(t, len(place)) for t in part[s]] for part in (x, y))
            end, members = _members([zstandard.decompress(t) for t in place])
            sets = [np.sort(members[a:b]) for a, b in zip([0, *end[:-1].tolist()], end.tolist(), strict=True)]
            link, size, other, overlap, extra = [], [], [], [], []
            for i, j in zip(at_x, at_y, strict=True):
                p, q = sets[i], sets[j]
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                more = p[q[at] != p]
                both = len(p) - len(more)
                link.append(both * LINK[1] >= (len(p) + len(q) - both) * LINK[0])
                size.append(len(p))
                other.append(len(q))
                overlap.append(both)
                extra.append(more.view(np.int64))
            n = s.stop - s.start
            yield pa.RecordBatch.from_pydict({"a": batch.column(0).slice(s.start, n), "b": batch.column(1).slice(s.start, n), "link": pa.array(link, pa.bool_()), "n_a": pa.array(size, pa.int32()), "n_b": pa.array(other, pa.int32()), "both": pa.array(overlap, pa.int32()), "extra": pa.array(extra, pa.list_(pa.int64()))})


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs(a, b) of representatives with `link`, by the overlap of their whole multisets, and what _compare tells."""
    x = texts.select(F.col("rep").alias("a"), F.col("text").alias("x"))
    y = texts.select(F.col("rep").alias("b"), F.col("text").alias("y"))
    both = pairs.hint("merge").join(x, "a").hint("merge").join(y, "b").select("a", "b", "x", "y")
    kind = pairs.schema["a"].dataType.simpleString()
    return map_arrow(both, _compare, f"a {kind}, b {kind}, link boolean, n_a int, n_b int, both int, extra array<bigint>")


def _contracted(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """id, label after more links(a, b): components of the links between the labels so far."""
    if labels is None:
        return components(links)
    if not links.limit(1).count():
        return labels
    ends = links
    for c in ("a", "b"):
        ends = ends.join(labels.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label")), c, "left").withColumn(f"{c}_label", F.coalesce(f"{c}_label", c))
    ends = materialise(ends)
    merged = components(ends.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")))
    lone = ends.where("a = a_label").select(F.col("a").alias("id")).union(ends.where("b = b_label").select("b")).distinct()
    every = labels.unionByName(lone.join(labels, "id", "left_anti").select("id", F.col("id").alias("label")))
    return materialise(every.join(merged.select(F.col("id").alias("label"), F.col("label").alias("new")), "label", "left").select("id", F.coalesce("new", "label").alias("label")))


def _labelled(df: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    """df with the component of a representative; one without links is its own."""
    found = df.join(labels.select(F.col("id").alias(column), F.col("label").alias(name)), column, "left")
    return found.withColumn(name, F.coalesce(name, column))


#: What _finer tells of the members of its buckets.
MEMBER = ("bucket", "rep", "label", "same", "n", "both", "share", "rest", "short")


def _finer(known: DataFrame) -> DataFrame:
    """The buckets in which the texts that stars leave apart from their centre can meet what they are linked to.

    known: the pairs of a text a and its centre b, as verified, with `label`, the
    component of a, and `same`, whether that is the component of b. A text x
    apart from c and linked to y has an overlap with y of at least 4/9 of their
    sizes together, and of it the members of c are no more than x shares with c.
    So they share a number of members that c lacks, which follows from the sizes
    of x, c and the shortest text of the star. One of the first of those members
    of x, in one order for all (rare ones first), then is among the first of y;
    of a text in the component of c all members count, as it may need none. Where
    sizes allow a y that shares nothing outside c, all such texts meet in one bucket.
    """
    star = known.groupBy("b").agg(F.count("*").alias("c"), F.bool_and("same").alias("all"), F.min("n_a").alias("shortest"), F.max(F.when(~F.col("same"), F.col("both"))).alias("most")).where("c > 1 and not all")
    need = F.ceil(LINK[0] * (F.col("n_a") + F.col("shortest")) / F.lit(float(LINK[0] + LINK[1]))) - F.col("both")
    known = materialise(known.join(star.select("b", "shortest", "most"), "b").withColumn("need", need.cast("int")).withColumn("share", F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))))
    each = known.select("a", "b", "label", "same", "need", F.col("n_a").alias("n"), "both", "share", F.size("extra").alias("k"), F.explode("extra").alias("e"))
    # members that the centre lacks and texts of two components have
    often = each.groupBy("b", "e").agg(F.count("*").alias("c"), F.count_if(~F.col("same")).alias("apart"), (F.min("label") != F.max("label")).alias("mixed")).where("apart > 0 and mixed")
    each = each.join(often.select("b", "e", "c"), ["b", "e"])
    own = Window.partitionBy("a", "b")
    place = F.row_number().over(own.orderBy("c", "e")) + F.col("k") - F.count("*").over(own)
    each = each.withColumn("rest", (F.col("k") - place + 1).cast("int"))
    each = each.where(F.col("same") | (F.col("rest") >= F.greatest("need", F.lit(1))))
    each = each.select(F.xxhash64("b", "e").alias("bucket"), F.col("a").alias("rep"), "label", "same", "n", "both", "share", "rest", F.lit(False).alias("short"))
    # a text apart needs no member outside the centre with texts of up to 9/4 of its overlap less its size
    room = (LINK[0] + LINK[1]) * F.col("most") >= LINK[0] * (F.col("n_a") + F.col("shortest"))
    near = known.where(room & ((LINK[0] + LINK[1]) * F.col("both") >= LINK[0] * (F.col("n_a") + F.col("shortest"))))
    near = near.select(F.xxhash64("b", F.lit(SHORT)).alias("bucket"), F.col("a").alias("rep"), "label", "same", F.col("n_a").alias("n"), "both", "share", F.lit(0).alias("rest"), F.lit(True).alias("short"))
    return each.unionByName(near)


def _direct(few: DataFrame) -> DataFrame:
    """Pairs of a bucket in different components, one end apart from the centre, that can be linked.

    Links have sizes within the similarity of each other; their similarities to
    the centre differ by no more than a link's distance (that distance is a
    metric); and they share as many members as they need outside the centre
    among those that come from here on in the order.
    """
    x = few.where("not same").select("bucket", *[F.col(c).alias(f"{c}_x") for c in MEMBER[1:]])
    y = few.select("bucket", *[F.col(c).alias(f"{c}_y") for c in MEMBER[1:] if c != "short"])
    total = F.col("n_x") + F.col("n_y")
    outside = F.ceil(LINK[0] * total / F.lit(float(LINK[0] + LINK[1]))) - F.least("both_x", "both_y")
    can = (
        (F.col("label_x") != F.col("label_y"))
        & (F.col("same_y") | (F.col("rep_x") < F.col("rep_y")))
        & (LINK[1] * F.least("n_x", "n_y") >= LINK[0] * F.greatest("n_x", "n_y"))
        & (F.abs(F.col("share_x") - F.col("share_y")) <= 1 - LINK[0] / LINK[1] + 1e-9)
        & F.when(F.col("short_x"), outside <= 0).otherwise(F.least("rest_x", "rest_y") >= F.greatest(outside, F.lit(1)))
    )
    joined = x.join(y, (x["bucket"] == y["bucket"]) & can)
    return joined.select(F.greatest("rep_x", "rep_y").alias("a"), F.least("rep_x", "rep_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, copy_of, n_shingles for every row of docs(doc_id, text).

    class_id is the least doc_id among the documents that links connect; copy_of
    the least doc_id with the same shingles. Rows that share an id are one class.
    Texts without words, null ones too, are alone. A null doc_id has a null class.
    An empty table gives no rows.

    A bucket is compared with one text only, the one that meets most others; no
    pair of one component is compared again. What stars leave apart meets in
    finer buckets (see _finer). Where few texts of a bucket are apart from the
    rest they are compared with the others that they can be linked to; where
    many are, the bucket is a star again. So a round compares no more pairs than
    buckets have members, but for a bounded number of texts in each. Rounds end
    when no bucket has texts of two components that are still to be compared.
    """
    spark = docs.sparkSession
    rows = materialise(signatures(docs))
    sound = rows.where("n > 0 and doc_id is not null")
    keys = ["k1", "k2"]
    # copies first: one representative for each multiset, named by its least id and text
    reps = materialise(sound.groupBy(*keys).agg(F.min(F.struct(F.col("doc_id").alias("id"), "th")).alias("rep"), F.first("n").alias("n")))
    found = sound.select(F.struct(F.col("doc_id").alias("id"), "th").alias("rep"), "bands", *keys)
    unique = reps.join(found, [*keys, "rep"]).select("rep", "n", "bands").dropDuplicates(["rep"])
    banded = unique.select(F.explode("bands").alias("bucket"), "rep")
    crowd = banded.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    met = materialise(banded.join(crowd, "bucket"))
    # how many a text meets over all its buckets: greatest in the middle of a group
    meets = materialise(met.groupBy("rep").agg(F.sum("c").alias("meets")))
    met = met.join(meets, "rep").select("bucket", "rep", "meets")
    needed = meets.select(F.col("rep.id").alias("doc_id"), F.col("rep.th").alias("th"), "rep")
    texts = pack_texts(docs.select("doc_id", _text_hash().alias("th"), text_or_empty().alias("text"))).hint("merge").join(needed, ["doc_id", "th"])
    texts = materialise(texts.select("rep", "text").dropDuplicates(["rep"]))
    free_shuffles(spark)
    labels = judged = None
    while True:
        pairs = materialise(_centred(met).select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct())
        known = fresh = materialise(_verified(pairs if judged is None else pairs.join(judged.select("a", "b"), ["a", "b"], "left_anti"), texts))
        if judged is not None:
            known = fresh.unionByName(judged.join(pairs, ["a", "b"], "left_semi"))
        judged = fresh if judged is None else judged.unionByName(fresh)
        free_shuffles(spark)
        labels = _contracted(labels, fresh.where("link").select("a", "b"))
        known = _labelled(_labelled(known, labels, "a", "label"), labels, "b", "other")
        finer = materialise(_finer(known.withColumn("same", F.col("label") == F.col("other"))))
        crowd = finer.groupBy("bucket").agg(F.count_if(~F.col("same")).alias("apart"), (F.min("label") != F.max("label")).alias("mixed")).where("apart > 0 and mixed")
        alive = materialise(finer.join(crowd.select("bucket", "apart"), "bucket"))
        # without a new pair another star would tell nothing
        many = F.col("apart") > FEW_APART if fresh.limit(1).count() else F.lit(False)
        direct = _direct(alive.where(~many))
        for one, two in (("a", "b"), ("b", "a")):
            direct = direct.join(judged.select(F.col(one).alias("a"), F.col(two).alias("b")), ["a", "b"], "left_anti")
        more = materialise(_verified(direct, texts))
        judged = judged.unionByName(more)
        labels = _contracted(labels, more.where("link").select("a", "b"))
        free_shuffles(spark)
        left = _labelled(alive.where(many).select("bucket", "rep"), labels, "rep", "label")
        mixed = left.groupBy("bucket").agg((F.min("label") != F.max("label")).alias("mixed")).where("mixed").select("bucket")
        met = materialise(left.join(mixed, "bucket").join(meets, "rep").select("bucket", "rep", "meets"))
        if not met.limit(1).count():
            break
    # classes: rows of one id are one, whatever their texts
    again = sound.groupBy("doc_id").agg(F.min(F.struct(*keys)).alias("one"), F.max(F.struct(*keys)).alias("two")).where("one <> two").select("doc_id")
    if again.limit(1).count():
        of = sound.join(again, "doc_id", "left_semi").join(reps.select(*keys, "rep"), keys).select("doc_id", "rep")
        ends = of.groupBy("doc_id").agg(F.min("rep").alias("b"))
        labels = _contracted(labels, of.join(ends, "doc_id").select(F.col("rep").alias("a"), "b").where("a <> b").distinct())
    named = _labelled(reps.select(*keys, "rep"), labels, "rep", "label").select(*keys, F.col("label.id").alias("class_id"), F.col("rep.id").alias("copy_of"))
    out = rows.select("doc_id", "n", *[F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col(k)).alias(k) for k in keys]).join(named, keys, "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"), F.col("n").alias("n_shingles"))


def _centred(members: DataFrame) -> DataFrame:
    """bucket, rep, centre: the others of each bucket with the text that meets most others, the least id of several."""
    centre = members.groupBy("bucket").agg(F.min(F.struct((-F.col("meets")).alias("m"), "rep")).alias("c")).select("bucket", F.col("c.rep").alias("centre"))
    return members.join(centre, "bucket").where("rep <> centre").select("bucket", "rep", "centre")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near duplicates: of each class the document with the least id stays, once.

    Rows with a null id stay.
    """
    found = materialise(near_duplicates(docs))
    count = found.where("doc_id = class_id").groupBy("doc_id").count()
    single, repeated = count.where("count = 1").select("doc_id"), count.where("count > 1").select("doc_id")
    # the ids of most documents: a side that grows with the input is never broadcast
    out = docs.join(single.hint("merge"), "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    if repeated.limit(1).count():
        out = out.unionByName(docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return out


def op7_bag_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
