"""Approximate nearest neighbours: one hierarchical small-world graph per shard.

Rows are dealt to shards by a hash.  Shards grow with the square root of the rows, from `shard_rows`
on, up to what one task holds (MOST_ROWS, MOST_BYTES), as every query goes to every shard.  A shard's index is one row of
flat arrays: distinct vectors, their ids, and per layer the node numbers and a
padded neighbour array.  Graphs are built in batches with beam searches that
run for all vectors of a batch at once.  Queries go to every shard in blocks;
the shards' results are merged.

The measure is the inner product.  Inside a shard vectors get one more
component so that all have the same length, which makes inner product a metric
order for the graph.  Equal vectors are one node; of their ids the smallest
k + 1 are kept, as no query can return another one.

Vectors that are null, zero, or hold null or non-finite components take no
part; nor does a null vec_id.  Repeated rows count once.  Vectors of different
lengths never meet.  Components may be as large as doubles are; a score beyond them is infinite.  Results are ordered by score, ties by smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from . import text as T

SHARD_ROWS, MOST_ROWS, MOST_BYTES = 8192, 1 << 16, 128 << 20
LINKS, EF_BUILD, EF_SEARCH, BATCH, QUERY_BLOCK = 16, 64, 192, 512, 512


def beam_search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, ef: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ef best nodes reached from its entries, best first: numbers (-1: none) and scores."""
    n, b = len(vectors), len(queries)
    seen = np.zeros((b, n), bool)
    ids = np.full((b, ef), -1, np.int64)
    score = np.full((b, ef), -np.inf, np.float32)
    done = np.ones((b, ef), bool)
    e = entries[:, :ef]
    ids[:, : e.shape[1]] = e
    ok = e >= 0
    safe = np.where(ok, e, 0)
    score[:, : e.shape[1]] = np.where(ok, np.einsum("bkd,bd->bk", vectors[safe], queries), -np.inf)
    done[:, : e.shape[1]] = ~ok
    np.put_along_axis(seen, safe, np.take_along_axis(seen, safe, 1) | ok, 1)
    live = np.arange(b)
    while len(live):
        open_score = np.where(done[live], -np.inf, score[live])
        pick = np.argpartition(-open_score, min(width, ef - 1) - 1, axis=1)[:, :width] if ef > width else np.argsort(-open_score, 1)[:, :width]
        good = np.isfinite(np.take_along_axis(open_score, pick, 1))
        go = good.any(1)
        live, pick, good = live[go], pick[go], good[go]
        if not len(live):
            break
        done[live[:, None], pick] = True
        at = np.where(good, ids[live[:, None], pick], 0)
        near = np.where(good[:, :, None], links[at], -1).reshape(len(live), -1)
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        near = np.sort(np.where(fresh, near, n), 1)
        fresh = near < n
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        most = int(fresh.sum(1).max())
        if not most:
            continue
        near = np.take_along_axis(near, np.argsort(~fresh, 1, kind="stable")[:, :most], 1)
        fresh = np.arange(most) < fresh.sum(1)[:, None]
        near = np.where(fresh, near, 0)
        seen[np.repeat(live, fresh.sum(1)), near[fresh]] = True
        s = np.where(fresh, np.einsum("bkd,bd->bk", vectors[near], queries[live]), -np.inf)
        all_s = np.concatenate([score[live], s], 1)
        top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
        score[live] = np.take_along_axis(all_s, top, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, near, -1)], 1), top, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], 1), top, 1)
    order = np.argsort(-score, 1, kind="stable")
    ids, score = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)
    ids[~np.isfinite(score)] = -1
    return ids, score


def diverse(vectors: np.ndarray, owner: np.ndarray, cand: np.ndarray, score: np.ndarray, keep: int) -> np.ndarray:
    """Of each row of candidates (best first, -1: none) at most keep that are nearer to the owner than to one another, filled with the next best."""
    b, c = cand.shape
    v = vectors[np.maximum(cand, 0)]
    between = np.matmul(v, v.transpose(0, 2, 1))
    chosen = np.zeros((b, c), bool)
    worst = np.full((b, c), -np.inf, np.float32)  # of each candidate: the largest product with one chosen
    count = np.zeros(b, int)
    for k in range(c):
        take = (cand[:, k] >= 0) & (worst[:, k] < score[:, k]) & (count < keep)
        chosen[:, k] = take
        count += take
        worst = np.where(take[:, None], np.maximum(worst, between[:, k]), worst)
    rank = np.where(cand < 0, 2 * c + np.arange(c), np.where(chosen, 0, c) + np.arange(c))
    order = np.argsort(rank, 1)[:, :keep]
    out = np.take_along_axis(cand, order, 1)
    if out.shape[1] < keep:
        out = np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)
    return out


def build_layer(vectors: np.ndarray, keep: int) -> np.ndarray:
    """Padded neighbour array (n, keep) of a small-world graph, its nodes inserted in order and in batches."""
    n = len(vectors)
    links = np.full((n, keep), -1, np.int64)
    at = 0
    while at < n:
        size = min(BATCH, n - at, max(32, at))
        new = np.arange(at, at + size)
        own = vectors[new] @ vectors[new].T
        np.fill_diagonal(own, -np.inf)
        k = min(EF_BUILD, size - 1) if size > 1 else 0
        cand, score = np.full((size, 0), -1), np.zeros((size, 0), np.float32)
        if k:
            cand = np.argpartition(-own, k - 1, axis=1)[:, :k]
            score = np.take_along_axis(own, cand, 1)
            cand = cand + at
        if at:
            entries = np.tile(np.unique(np.linspace(0, at - 1, min(at, 8)).astype(int)), (size, 1))
            found, s = beam_search(vectors[:at], links[:at], vectors[new], entries, EF_BUILD)
            cand, score = np.concatenate([cand, found], 1), np.concatenate([score, s], 1)
        order = np.argsort(-np.where(cand >= 0, score, -np.inf), 1, kind="stable")[:, :EF_BUILD]
        cand, score = np.take_along_axis(cand, order, 1), np.take_along_axis(score, order, 1)
        links[new] = diverse(vectors, new, cand, score, keep) if cand.shape[1] else -1
        # links back: a node's own and its new ones, thinned out where they are too many
        to, of = links[new].ravel(), np.repeat(new, keep)
        of, to = of[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        of, to = of[order], to[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        for group in np.array_split(np.arange(len(nodes)), max(1, len(nodes) // 256)):
            if not len(group):
                continue
            width = int(count[group].max())
            more = np.full((len(group), width), -1)
            for i, g in enumerate(group):
                more[i, : count[g]] = of[first[g] : first[g] + count[g]]
            cand = np.concatenate([links[nodes[group]], more], 1)
            s = np.where(cand >= 0, np.einsum("bkd,bd->bk", vectors[np.maximum(cand, 0)], vectors[nodes[group]]), -np.inf)
            order = np.argsort(-s, 1, kind="stable")
            cand, s = np.take_along_axis(cand, order, 1), np.take_along_axis(s, order, 1)
            same = np.zeros(cand.shape, bool)
            same[:, 1:] = cand[:, 1:] == cand[:, :-1]
            cand, s = np.where(same, -1, cand)[:, : 3 * keep], np.where(same, -np.inf, s)[:, : 3 * keep]
            links[nodes[group]] = diverse(vectors, nodes[group], cand, s, keep)
        at += size
    return links


def build(ids: np.ndarray, vectors: np.ndarray, k: int) -> dict:
    """Flat arrays of one shard's index."""
    order = np.lexsort((ids,))
    ids, vectors = ids[order], vectors[order]
    distinct, group = np.unique(vectors, axis=0, return_inverse=True)
    group = group.ravel()
    order = np.argsort(group, kind="stable")
    first = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=len(distinct)))))
    rank = np.arange(len(order)) - first[group[order]]
    order = order[rank <= k]
    starts = np.concatenate(([0], np.cumsum(np.bincount(group[order], minlength=len(distinct)))))
    shuffle = np.random.default_rng(len(distinct)).permutation(len(distinct))
    place = np.argsort(shuffle)  # node number of each distinct vector
    ids = ids[order][np.argsort(place[group[order]], kind="stable")]
    distinct = distinct[shuffle]
    starts = np.concatenate(([0], np.cumsum(np.diff(starts)[shuffle])))
    level = np.floor(-np.log(np.random.default_rng(5).uniform(1e-12, 1, len(distinct))) / np.log(LINKS)).astype(int)
    even = evened(distinct)
    layers = []
    for depth in range(int(level.max()), -1, -1):
        nodes = np.flatnonzero(level >= depth)
        layers.append((nodes, build_layer(even[nodes], LINKS if depth else 2 * LINKS)))
    return {
        "n": len(distinct),
        "ids": ids.astype("<i8").tobytes(),
        "starts": starts.astype("<i8").tobytes(),
        "vectors": distinct.astype("<f8").tobytes(),
        "nodes": [x.astype("<i4").tobytes() for x, _ in layers],
        "links": [x.astype("<i4").tobytes() for _, x in layers],
    }


def evened(vectors: np.ndarray) -> np.ndarray:
    """float32 vectors with one more component, all as long as the longest and scaled to 1."""
    vectors = vectors / np.abs(vectors).max()  # lengths of any finite vectors are finite then
    length = np.linalg.norm(vectors, axis=1)
    most = length.max()
    rest = np.sqrt(np.maximum(0.0, 1 - (length / most) ** 2))
    return np.hstack([vectors / most, rest[:, None]]).astype(np.float32)


def search_shard(index: dict, dim: int, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the query, ids, exact scores) for each query; own: the queries' ids, never returned for themselves."""
    vectors = np.frombuffer(index["vectors"], "<f8").reshape(-1, dim)
    ids, starts = np.frombuffer(index["ids"], "<i8"), np.frombuffer(index["starts"], "<i8")
    even = evened(vectors)
    q = queries / np.abs(queries).max(axis=1, keepdims=True)
    q = np.hstack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(queries), 1))]).astype(np.float32)
    ef = max(EF_SEARCH, 4 * k)
    entries = np.zeros((len(q), 1), np.int64)
    for depth, (nodes, links) in enumerate(zip(index["nodes"], index["links"])):
        nodes = np.frombuffer(nodes, "<i4").astype(np.int64)
        links = np.frombuffer(links, "<i4").astype(np.int64).reshape(len(nodes), -1)
        last = depth == len(index["nodes"]) - 1
        local = np.searchsorted(nodes, entries)
        found, _ = beam_search(even[nodes], links, q, local, ef if last else 8)
        entries = np.where(found >= 0, nodes[np.maximum(found, 0)], nodes[0])
        if last:
            entries = np.where(found >= 0, entries, -1)
    for i in range(len(q)):
        at = np.unique(entries[i][entries[i] >= 0])
        score = (vectors[at] * queries[i]).sum(1)
        counts = starts[at + 1] - starts[at]
        got = np.concatenate([ids[starts[a] : starts[a + 1]] for a in at]) if len(at) else np.zeros(0, np.int64)
        score = np.repeat(score, counts)
        other = got != own[i]
        got, score = got[other], score[other]
        best = np.lexsort((got, -score))[:k]
        yield i, got[best], score[best]


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (doubles) and dim of the rows that take part."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .where((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))
        .withColumn("dim", F.size("v"))
        .dropDuplicates()
    )


def rows_per_shard(n: int, dim: int, least: int = SHARD_ROWS) -> int:
    """least up to 50,000 rows, then more by the square root of the rows"""
    grown = least * max(1.0, (n / 50_000) ** 0.5)
    return int(min(grown, MOST_ROWS, max(256, MOST_BYTES // (8 * dim))))


def build_index(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """The index, a row of flat arrays for each shard, and the number of shards of each length of vectors."""
    shards = {r["dim"]: max(1, round(r["n"] / rows_per_shard(r["n"], r["dim"], shard_rows))) for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    count = F.lit(1)
    for dim, n in shards.items():
        count = F.when(F.col("dim") == dim, F.lit(n)).otherwise(count)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        made = build(rows["vec_id"].to_numpy(np.int64), np.stack(rows["v"].to_numpy()).astype(np.float64), k)
        return pd.DataFrame([{"dim": key[0], "shard": key[1]} | made])

    index = (
        vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), count.cast("long")).cast("int"))
        .groupBy("dim", "shard")
        .applyInPandas(run, "dim int, shard int, n long, ids binary, starts binary, vectors binary, nodes array<binary>, links array<binary>")
    )
    return T.checkpointed(index), shards


def search(index: DataFrame, shards: dict[int, int], queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each of queries (vec_id, v, dim)."""
    top = F.lit(0)
    for dim, n in shards.items():
        top = F.when(F.col("dim") == dim, F.lit(n - 1)).otherwise(top)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    packed = (
        queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)))
        .groupBy("dim", "block")
        .agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("q"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), top)))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, r in b.iterrows():
                own = np.array([x["vec_id"] for x in r["q"]], np.int64)
                vectors = np.stack([np.asarray(x["v"], float) for x in r["q"]])
                out = [(own[i], a, s) for i, ids, score in search_shard(r, r["dim"], vectors, own, k) for a, s in zip(ids, score)]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = packed.join(index, ["dim", "shard"]).mapInPandas(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """k nearest other rows of each row whose vec_id is divisible by every."""
    embeddings.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    vectors = usable(embeddings)
    index, shards = build_index(vectors, k, shard_rows)
    return search(index, shards, vectors.where(F.pmod("vec_id", F.lit(every)) == 0), k)
