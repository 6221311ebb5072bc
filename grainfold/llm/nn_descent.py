"""Approximate nearest neighbours: NN-descent graph, greedy graph search.

Equal vectors are one node. Nodes start with neighbours from random hyperplane
blocks. A round of NN-descent joins every node with the vectors of a sample of
its neighbours and of the nodes that name it as one; each pair of them that
involves a new neighbour is compared, and a node hears of partners that beat its
worst neighbour. A query starts from its own node's neighbours and again and
again expands the best unexpanded nodes of its pool: the query travels to them,
joins their neighbours' vectors there and gets back those that beat its pool.
The best of the pool are scored anew in double precision on original vectors.

Graph rounds and the search compare vectors of one byte a component. State
travels as packed arrays of a few thousand nodes, so joins handle few rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import free_shuffles, materialise, parts_for, table

K = 40
TABLES, BLOCK = 8, 400
#: Rounds at most; they end when a round renews less than this share of all neighbours.
ROUNDS, SETTLED = 12, 0.01
SAMPLE, HEARD = 24, 6
#: A query's pool, and how many of it are expanded in a hop. Hops at most; they end when every pool is expanded.
POOL, WIDTH, HOPS = 240, 64, 12
RESCORED = 64
#: Nodes of a part, and in-degree over which reverse neighbours are sampled before they are dealt out.
PART, HUB = 2_000, 512


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part: finite, not zero, of the most common length."""
    v = F.col(vec_col).cast("array<double>")
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & sound)
    length = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("vector") == (length["d"] if length else 0))


def _rows(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary()) if len(x) else pa.array([], pa.binary())


def _matrix(c, kind) -> np.ndarray:
    """Binary rows of one size as a matrix."""
    rows = c.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def _quantised(x: np.ndarray) -> np.ndarray:
    """Rows of float32 scale and int8 components, as bytes."""
    top = np.abs(x).max(1, keepdims=True)
    scale = (top / 127).astype(np.float32)
    code = np.rint(x / top * 127).astype(np.int8)
    return np.concatenate([scale.view(np.uint8), code.view(np.uint8)], axis=1)


def _real(q: np.ndarray) -> np.ndarray:
    q = np.ascontiguousarray(q)
    return q[..., 4:].view(np.int8).astype(np.float32) * np.ascontiguousarray(q[..., :4]).view(np.float32)


def _best(owner: np.ndarray, ids: np.ndarray, score: np.ndarray, old: np.ndarray, n: int, k: int):
    """(n, k) ids, scores and new flags: the best k different ids of each owner; -1 where there are fewer. old ones win over equal new ones."""
    order = np.lexsort((~old, ids, owner))
    owner, ids, score, old = owner[order], ids[order], score[order], old[order]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])
    owner, ids, score, old = owner[keep], ids[keep], score[keep], old[keep]
    order = np.lexsort((ids, -score, owner))
    owner, ids, score, old = owner[order], ids[order], score[order], old[order]
    nth = np.arange(len(owner)) - np.searchsorted(owner, owner, side="left")
    on = nth < k
    out = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf, np.float32), np.zeros((n, k), bool)
    at = owner[on], nth[on]
    out[0][at], out[1][at], out[2][at] = ids[on], score[on], ~old[on]
    return out


def _by_part(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    node = group.column("node").to_numpy()
    return np.unique(node, return_inverse=True)


NODE = "node bigint, q binary, ids binary, scores binary, fresh binary, kth float, renewed int"


def _block(group: pa.Table) -> pa.Table:
    """The best neighbours within a block."""
    node, q = group.column("node").to_numpy(), _matrix(group.column("q"), np.uint8)
    x = _real(q)
    k = min(K // 2, len(node) - 1)
    if k < 1:
        return pa.table({"node": pa.array([], pa.int64()), "ids": pa.array([], pa.binary()), "scores": pa.array([], pa.binary())})
    near, score = np.empty((len(node), k), np.int64), np.empty((len(node), k), np.float32)
    for a in range(0, len(node), 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        near[a : a + 512], score[a : a + 512] = node[top], np.take_along_axis(s, top, 1)
    return pa.table({"node": pa.array(node), "ids": _rows(near), "scores": _rows(score)})


def _merge(group: pa.Table) -> pa.Table:
    """State rows (with q) and heard rows (without) of a part: the new state."""
    nodes, at = _by_part(group)
    q = [None] * len(nodes)
    owner, ids, score, old = [], [], [], []
    known = group.column("q").to_pylist()
    fresh = group.column("fresh").to_pylist()
    for i, a, b in zip(at.tolist(), group.column("ids").to_pylist(), group.column("scores").to_pylist(), strict=True):
        ids.append(np.frombuffer(a or b"", np.int64))
        score.append(np.frombuffer(b or b"", np.float32))
        owner.append(i)
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    for i, x, f in zip(owner, known, fresh, strict=True):
        if x is not None:
            q[i] = x
    old = np.concatenate([np.zeros(n, bool) if f is None else np.frombuffer(f, np.uint8) == 0 for n, f in zip(sizes, fresh, strict=True)])
    own = np.repeat(np.array(owner, np.int64), sizes)
    ids, score = np.concatenate(ids), np.concatenate(score)
    sound = (ids >= 0) & (ids != nodes[own])
    near, best, new = _best(own[sound], ids[sound], score[sound], old[sound], len(nodes), K)
    before = np.concatenate([[x is not None] for x in known]) if len(known) else np.zeros(0, bool)
    held = np.sort(_pair(own, ids)[sound & np.repeat(before, sizes)])
    arrived = (near >= 0) & ~np.isin(_pair(np.broadcast_to(np.arange(len(nodes))[:, None], near.shape), near), held)
    mine = np.array([x is not None for x in q])
    return pa.table(
        {"node": pa.array(nodes[mine]), "q": pa.array([x for x in q if x is not None], pa.binary()), "ids": _rows(near[mine]), "scores": _rows(best[mine]), "fresh": _rows(new[mine].astype(np.uint8)), "kth": pa.array(best[mine][:, -1]), "renewed": pa.array(arrived[mine].sum(1).astype(np.int32))}
    )


def _pair(place: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """One number for a node's place in its part and a neighbour."""
    return place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ ids.astype(np.uint64)


def _hash01(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    h = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64(salt * 0x165667B1 + 1)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _sampled(ids: np.ndarray, fresh: np.ndarray, node: np.ndarray, turn: int) -> np.ndarray:
    """Mask of the neighbours that take part in a turn: SAMPLE of a row, new ones first."""
    rank = np.where(ids < 0, 4.0, np.where(fresh, 0.0, 2.0)) + _hash01(np.broadcast_to(node[:, None], ids.shape), ids, turn)
    chosen = np.zeros(ids.shape, bool)
    np.put_along_axis(chosen, np.argsort(rank, axis=1)[:, :SAMPLE], True, 1)
    return chosen & (ids >= 0)


def _entries(turn: int):
    """(node, member, fresh): what takes part at each node, forward and reverse."""

    def run(batches):
        for b in batches:
            node, ids, fresh = b.column(0).to_numpy(), _matrix(b.column(1), np.int64), _matrix(b.column(2), np.uint8) > 0
            if not len(node):
                continue
            on = _sampled(ids, fresh, node, turn)
            a, m, f = np.broadcast_to(node[:, None], ids.shape)[on], ids[on], fresh[on]
            yield pa.RecordBatch.from_pydict({"node": np.concatenate([a, m]), "member": np.concatenate([m, a]), "new": np.concatenate([f, f]), "reverse": np.repeat([False, True], len(a))})

    return run


def _local_join(turn: int):
    def run(group: pa.Table) -> pa.Table:
        """Compare the members that meet at the nodes of a part; each hears of the best that beat its worst neighbour."""
        nodes, at = _by_part(group)
        member, new, reverse = (group.column(c).to_numpy() for c in ("member", "new", "reverse"))
        order = np.lexsort((_hash01(nodes[at], member, turn + 99) - new, reverse, at))
        at, member, new, reverse = at[order], member[order], new[order], reverse[order]
        first = np.searchsorted(at * 2 + reverse, at * 2 + reverse, side="left")
        on = np.arange(len(at)) - first < SAMPLE
        order, at, member, new = order[on], at[on], member[on], new[on]
        q, kth = _matrix(group.column("q").take(pa.array(order)), np.uint8), group.column("kth").to_numpy()[order]
        nth = np.arange(len(at)) - np.searchsorted(at, at, side="left")
        shape = (len(nodes), 2 * SAMPLE)
        row = np.full(shape, -1, np.int64)
        row[at, nth] = np.arange(len(at))
        out_node, out_ids, out_scores = [], [], []
        for a in range(0, len(nodes), 256):
            r = row[a : a + 256]
            x = _real(q[r])
            g = x @ x.transpose(0, 2, 1)
            gone = r < 0
            ids = np.where(gone, -1, member[r])
            is_new = new[r] & ~gone
            g[gone[:, :, None] | gone[:, None, :] | (ids[:, :, None] == ids[:, None, :]) | ~(is_new[:, :, None] | is_new[:, None, :])] = -np.inf
            g[g <= np.where(gone, np.inf, kth[r])[:, :, None]] = -np.inf
            top = np.argpartition(-g, HEARD - 1, axis=2)[:, :, :HEARD]
            s = np.take_along_axis(g, top, 2)
            w = np.take_along_axis(np.broadcast_to(ids[:, None, :], g.shape), top, 2)
            some = np.isfinite(s).any(2)
            out_node.append(ids[some])
            out_ids.append(np.where(np.isfinite(s), w, -1)[some])
            out_scores.append(s[some])
        node, ids, scores = (np.concatenate(x) for x in (out_node, out_ids, out_scores))
        return pa.table({"node": pa.array(node), "ids": _rows(ids), "scores": _rows(scores.astype(np.float32))})

    return run


def build_graph(nodes: DataFrame, n: int) -> DataFrame:
    """State rows of the graph over nodes(node, vector): the packed neighbours of each node."""
    spark = nodes.sparkSession
    parts = parts_for(n, PART)
    part = F.pmod(F.xxhash64("node"), F.lit(parts))
    bits = max(0, int(np.ceil(np.log2(max(1, n / BLOCK)))))

    def code(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column(1).to_pylist(), np.float64)
            planes = np.random.default_rng(11).standard_normal((x.shape[1], TABLES * bits)) if bits else np.zeros((x.shape[1], 0))
            side = (x @ planes > 0).reshape(len(x), TABLES, bits)
            yield pa.RecordBatch.from_pydict({"node": b.column(0), "q": _rows(_quantised(x)), "codes": pa.array(list((side * (1 << np.arange(bits))).sum(2).astype(np.int64)), pa.list_(pa.int64()))})

    coded = materialise(nodes.select("node", "vector").mapInArrow(code, "node bigint, q binary, codes array<bigint>"))
    cells = coded.select("node", "q", F.posexplode("codes").alias("t", "code"))
    size = cells.groupBy("t", "code").agg(F.ceil(F.count("*") / F.lit(2.0 * BLOCK)).alias("splits"))
    cells = cells.join(size, ["t", "code"]).withColumn("salt", F.pmod(F.xxhash64("node", "t"), F.col("splits")))
    heard = cells.select("t", "code", "salt", "node", "q").groupBy("t", "code", "salt").applyInArrow(_block, "node bigint, ids binary, scores binary")
    none = [F.lit(None).cast("binary").alias(c) for c in ("ids", "scores", "fresh")]

    def merged(state: DataFrame, heard: DataFrame) -> DataFrame:
        rows = state.unionByName(heard.select("node", F.lit(None).cast("binary").alias("q"), "ids", "scores", F.lit(None).cast("binary").alias("fresh")))
        out = materialise(rows.withColumn("part", part).groupBy("part").applyInArrow(lambda g: _merge(g), NODE))
        free_shuffles(spark)
        return out

    graph = merged(coded.select("node", "q", *none), heard)
    for turn in range(ROUNDS):
        entries = graph.select("node", "ids", "fresh").mapInArrow(_entries(turn), "node bigint, member bigint, new boolean, reverse boolean")
        entries = materialise(entries)
        hubs = entries.where("reverse").groupBy("node").agg(F.count("*").alias("degree")).where(F.col("degree") > HUB)
        entries = entries.join(hubs, "node", "left").where(F.col("degree").isNull() | ~F.col("reverse") | (F.pmod(F.xxhash64("node", "member", F.lit(turn)), F.col("degree")) < HUB)).drop("degree")
        met = entries.join(graph.select(F.col("node").alias("member"), "q", "kth"), "member").withColumn("part", part)
        heard = met.groupBy("part").applyInArrow(_local_join(turn), "node bigint, ids binary, scores binary")
        # sampled neighbours are new no longer
        graph = merged(_aged(graph, turn), heard)
        if (graph.agg(F.sum("renewed")).first()[0] or 0) <= SETTLED * n * min(K, max(1, n - 1)):
            break
    return graph


def _aged(graph: DataFrame, turn: int) -> DataFrame:
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            node, ids, fresh = b.column(0).to_numpy(), _matrix(b.column(2), np.int64), _matrix(b.column(4), np.uint8) > 0
            fresh = fresh & ~_sampled(ids, fresh, node, turn)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], _rows(fresh.astype(np.uint8))], names=["node", "q", "ids", "scores", "fresh"])

    return graph.select("node", "q", "ids", "scores", "fresh").mapInArrow(run, "node bigint, q binary, ids binary, scores binary, fresh binary")


# --- search --------------------------------------------------------------------------------------

POOLED = "node bigint, q binary, ids binary, scores binary, done binary, worst float, next array<bigint>"


def _pool(group: pa.Table) -> pa.Table:
    """Pools (with q) and what came back to them (without): the new pools and the nodes to expand next."""
    nodes, at = _by_part(group)
    q: list = [None] * len(nodes)
    for i, x in zip(at.tolist(), group.column("q").to_pylist(), strict=True):
        if x is not None:
            q[i] = x
    ids = [np.frombuffer(x or b"", np.int64) for x in group.column("ids").to_pylist()]
    score = [np.frombuffer(x or b"", np.float32) for x in group.column("scores").to_pylist()]
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    done = np.concatenate([np.zeros(n, bool) if d is None else np.frombuffer(d, np.uint8) > 0 for n, d in zip(size, group.column("done").to_pylist(), strict=True)])
    own, ids, score = np.repeat(at, size), np.concatenate(ids), np.concatenate(score)
    sound = (ids >= 0) & (ids != nodes[own])
    pool, best, fresh = _best(own[sound], ids[sound], score[sound], done[sound], len(nodes), POOL)
    over = ~fresh
    todo, chosen = [], over.copy()
    for i in range(len(nodes)):
        k = np.flatnonzero(~over[i] & (pool[i] >= 0))[:WIDTH]
        chosen[i, k] = True
        todo.append(pool[i, k])
    return pa.table(
        {"node": pa.array(nodes), "q": pa.array(q, pa.binary()), "ids": _rows(pool), "scores": _rows(best), "done": _rows(chosen.astype(np.uint8)), "worst": pa.array(best[:, -1]), "next": pa.array(todo, pa.list_(pa.int64()))}
    )


def _expand(batches):
    """Score the neighbours of an expanded node for the query that came to it."""
    for b in batches:
        if not b.num_rows:
            continue
        x = _real(_matrix(b.column(1), np.uint8))
        worst = b.column(2).to_numpy()
        ids, vectors = b.column(3).to_pylist(), b.column(4).to_pylist()
        size = np.fromiter((len(i) // 8 for i in ids), np.int64, len(ids))
        every = np.frombuffer(b"".join(ids), np.int64)
        v = np.frombuffer(b"".join(vectors), np.uint8).reshape(len(every), -1)
        of = np.repeat(np.arange(len(ids)), size)
        score = np.empty(len(every), np.float32)
        for a in range(0, len(every), 1 << 16):
            score[a : a + (1 << 16)] = np.einsum("ij,ij->i", x[of[a : a + (1 << 16)]], _real(v[a : a + (1 << 16)]))
        on = score > worst[of]
        n = np.bincount(of[on], minlength=len(ids))
        end = np.cumsum(n)
        i, s = every[on], score[on]
        yield pa.RecordBatch.from_pydict({"node": b.column(0), "ids": pa.array([i[e - k : e].tobytes() for e, k in zip(end, n, strict=True)], pa.binary()), "scores": pa.array([s[e - k : e].tobytes() for e, k in zip(end, n, strict=True)], pa.binary())})


def _unpack(batches):
    for b in batches:
        if b.num_rows:
            ids = _matrix(b.column(1), np.int64)
            on = ids >= 0
            yield pa.RecordBatch.from_pydict({"node": np.broadcast_to(b.column(0).to_numpy()[:, None], ids.shape)[on], "near": ids[on]})


def _first_unpack(batches):
    for b in batches:
        if b.num_rows:
            ids = _matrix(b.column(1), np.int64)[:, :RESCORED]
            on = ids >= 0
            yield pa.RecordBatch.from_pydict({"node": np.broadcast_to(b.column(0).to_numpy()[:, None], ids.shape)[on], "near": ids[on]})


def _packed_lists(group: pa.Table) -> pa.Table:
    """Neighbours of a part's nodes with their vectors, one row for each node."""
    nodes, at = _by_part(group)
    order = np.argsort(at, kind="stable")
    near, q = group.column("near").to_numpy()[order], group.column("q").take(pa.array(order)).to_pylist()
    end = np.cumsum(np.bincount(at, minlength=len(nodes)))
    start = np.concatenate([[0], end[:-1]])
    return pa.table({"node": pa.array(nodes), "near": pa.array([near[a:b].tobytes() for a, b in zip(start, end, strict=True)], pa.binary()), "vectors": pa.array([b"".join(q[a:b]) for a, b in zip(start, end, strict=True)], pa.binary())})


def search(graph: DataFrame, starts: DataFrame, n: int) -> DataFrame:
    """(node, near): for each node of starts(node) the RESCORED best nodes that greedy search finds."""
    spark = graph.sparkSession
    part = F.pmod(F.xxhash64("node"), F.lit(parts_for(n, PART)))
    edges = graph.select("node", "ids").mapInArrow(_unpack, "node bigint, near bigint")
    lists = edges.join(graph.select(F.col("node").alias("near"), "q"), "near").withColumn("part", part)
    lists = materialise(lists.groupBy("part").applyInArrow(_packed_lists, "node bigint, near binary, vectors binary"))
    free_shuffles(spark)
    none = F.lit(None).cast("binary")
    came = graph.join(starts, "node", "left_semi").select("node", "q", "ids", "scores", none.alias("done"))
    for hop in range(HOPS + 1):
        pools = materialise(came.withColumn("part", part).groupBy("part").applyInArrow(lambda g: _pool(g), POOLED))
        free_shuffles(spark)
        if hop == HOPS or not pools.where(F.size("next") > 0).limit(1).count():
            break
        gone = pools.select("node", "q", "worst", F.explode("next").alias("to"))
        back = gone.join(lists.withColumnRenamed("node", "to"), "to").select("node", "q", "worst", "near", "vectors").mapInArrow(_expand, "node bigint, ids binary, scores binary")
        came = pools.select("node", "q", "ids", "scores", "done").unionByName(back.select("node", none.alias("q"), "ids", "scores", none.alias("done")))
    return pools.select("node", "ids").mapInArrow(_first_unpack, "node bigint, near bigint")


def nearest(vectors: DataFrame, queries: Column | str, *, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows found for the rows where `queries` holds.

    Nearness is the inner product; ties go to the smaller vec_id. Every row but
    the query's own is a candidate, rows of the same vec_id too. Vectors that
    are null, zero, of another length than most (no inner product with them is
    defined) or hold null or non-finite components take no part. Fewer candidates
    than k are all returned. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = materialise(usable(vectors, id_col, vec_col).withColumn("row", F.monotonically_increasing_id()))
    nodes = materialise(rows.groupBy("vector").agg(F.min("row").alias("node"), F.count("*").alias("copies")))
    n = nodes.count()
    graph = build_graph(nodes.select("node", "vector"), n)
    # members of nodes: k + 1 of the smallest ids can be results; first within salted groups, so that no copy group is one task
    of = materialise(rows.join(nodes.select("vector", "node", "copies"), "vector").select("row", "vec_id", "node", "copies"))
    small = of.where("copies = 1").select("node", "vec_id", "row")
    many = of.where("copies > 1").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(256)))
    for keys in (["node", "salt"], ["node"]):
        many = many.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id", "row"))).where(F.col("r") <= k + 1)
    members = small.unionByName(many.select("node", "vec_id", "row"))
    asked = of.join(rows.where(queries).select("row"), "row", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), "node")
    starts = asked.select("node").distinct()
    found = materialise(search(graph, starts, n).unionByName(starts.select("node", F.col("node").alias("near"))))
    x, y = nodes.select("node", F.col("vector").alias("x")), nodes.select(F.col("node").alias("near"), F.col("vector").alias("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    # of a node's copies k + 1 can be results, and of its near nodes the first that have k + 1 members together
    scored = found.join(x, "node").join(y, "near").select("node", "near", dot.alias("score"))
    top = scored.join(members.withColumnRenamed("node", "near"), "near").withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "vec_id", "row"))).where(F.col("r") <= k + 1)
    pairs = asked.join(top.select("node", "vec_id", "row", "score"), "node").where("row <> query_row")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
