"""MinHash near-duplicates by ProbMinHash.

Every distinct shingle of five words is a Poisson process, with its weight as rate, whose
arrivals fall on random registers; a register keeps the shingle that arrives first.  A shingle
stops once its next arrival is later than all of the document's registers.  The share
of equal registers estimates the probability Jaccard index of two documents.  With `weighted` a
shingle's weight is its count; without, all weights are one and the index is the plain Jaccard
index of the shingle sets, which is what the registered query links by.

Registers are banded.  Two texts that share a bucket are compared on their
whole shingles, and linked if the index is at least 0.8; classes are
the connected components.  No group is ever compared pair by pair as long as
its members come together in another way:

1. equal texts are one node;
2. in each bucket all members are compared with one centre, that with most
   bucket neighbours (of several centres a member takes the nearest by estimate);
3. only buckets whose members are still in several components are compared
   further: every member outside the bucket's largest component with all members
   of other components, in blocks of bounded size.  Registers alone find who has to be
   compared in a block; only their texts are sent there.

Step 3 makes the result equal to that of all pairs in all buckets whose estimate is at least
LEAST_ESTIMATE (a pair of index 0.8 is under it with probability 3e-6).

Buckets and centres that hold many rows are dealt to several tasks, with their
one-row side copied to each; which these are is bounded by a share of all rows.

A null text counts as empty.  Texts without a word have no shingles and are in
one class only with equal texts; texts of one to four words are one shingle.
Repeated rows are copies of each other and returned once each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import text as T
from .graph import components

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Estimates below this (five standard errors under 0.8) are no candidates.
LEAST_ESTIMATE = 0.62
BLOCK = 256
#: Rows of one key that stay together at least, and parts of all rows beyond which a key is dealt to several tasks.
TOGETHER, PARTS = 512, 10_000


def distinct_shingles(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, their rows (in order) and counts."""
    h, row = T.shingles(data, bounds, WORDS)
    if not len(h):
        return h, row, np.zeros(0, np.int64)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.empty(len(h), bool)
    new[0] = True
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return h[at], row[at], np.diff(np.append(at, len(h)))


def signatures(data: np.ndarray, bounds: np.ndarray, weighted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Registers (rows, REGISTERS) as uint32 and whether the row has any shingle."""
    n = len(bounds) - 1
    h, row, count = distinct_shingles(data, bounds)
    rate = count.astype(float) if weighted else np.ones(len(h))
    first = np.full(n * REGISTERS, np.inf)
    winner = np.zeros(n * REGISTERS, np.uint32)
    some = np.zeros(n, bool)
    some[row] = True
    time = np.zeros(len(h))
    step = 0
    while len(h):
        step += 1
        draw = T.mix(h + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / rate
        slot = row * REGISTERS + (T.mix(draw) % np.uint64(REGISTERS)).astype(np.int64)
        hit = np.flatnonzero(time < first[slot])
        hit = hit[np.lexsort((h[hit], time[hit]))[::-1]]
        first[slot[hit]] = time[hit]
        winner[slot[hit]] = (h[hit] >> np.uint64(32)).astype(np.uint32)
        last = first.reshape(n, REGISTERS).max(1)
        live = np.flatnonzero(time < last[row])
        h, row, time, rate = h[live], row[live], time[live], rate[live]
    return winner.reshape(n, REGISTERS), some


def buckets(signature: np.ndarray) -> np.ndarray:
    """Bucket (64 bits, the band included) of each band of each row."""
    parts = signature.astype(np.uint64).reshape(len(signature), BANDS, ROWS)
    acc = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signature), 1))
    for k in range(ROWS):
        acc = T.mix(acc * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return acc.astype(np.int64)


Shingles = tuple[np.ndarray, np.ndarray]


def shingles_of(text: str) -> Shingles:
    """Distinct shingles of a text, sorted, and their counts."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    h, _, count = distinct_shingles(raw, np.array([0, len(raw)]))
    return h, count


def index_of(a: Shingles, b: Shingles, weighted: bool = False) -> float:
    """Jaccard index of two sets of shingles, or with weighted the probability Jaccard index of their counts."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not weighted:
        return len(common) / max(len(a[0]) + len(b[0]) - len(common), 1)
    # for a common shingle c: 1 / sum over all d of max(x[d] / x[c], y[d] / y[c]), which is one side or the other by x[d] / y[d]
    x, y = a[1][i].astype(float), b[1][j].astype(float)
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    first = np.searchsorted(ratio, ratio, "left")
    above = (np.concatenate((np.cumsum(x[::-1])[::-1], [0.0])) + a[1].sum() - x.sum())[first]
    under = (np.concatenate(([0.0], np.cumsum(y))) + b[1].sum() - y.sum())[first]
    return float((1.0 / (above / x + under / y)).sum())


def jaccard(a: str, b: str, weighted: bool = False) -> float:
    return index_of(shingles_of(a), shingles_of(b), weighted)


def _signed(documents: DataFrame, weighted: bool) -> DataFrame:
    """One node for each distinct text: node, k1, k2, rep (smallest doc_id) and sig (registers, null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = T.utf8(b.column("text"))
            for i, j in T.slices(offsets):
                s, some = signatures(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], weighted)
                sig = pa.array([x.tobytes() if ok else None for x, ok in zip(s, some)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("k1").slice(i, j - i), b.column("k2").slice(i, j - i), sig], ["doc_id", "k1", "k2", "sig"])

    signed = keyed(documents).mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, k1 long, k2 long, sig binary")
    nodes = signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    return T.checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))


def keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))


def dealt_join(rows: DataFrame, side: DataFrame, key: str, heavy: DataFrame, spread: str) -> DataFrame:
    """rows joined with side (one row for each key); keys of heavy (key, parts) are dealt to parts tasks by the column spread.

    heavy is broadcast: it names keys with more than a PARTS-th of all rows, so it has at most PARTS rows.
    """
    heavy = F.broadcast(heavy.select(key, F.col("parts").cast("long").alias("__parts")))
    one = F.lit(1).cast("long")
    cut = rows.join(heavy, key, "left").withColumn("__part", F.pmod(F.xxhash64(spread), F.coalesce("__parts", one))).drop("__parts")
    copies = side.join(heavy, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__parts", one) - 1))).drop("__parts")
    return cut.join(copies, [key, "__part"]).drop("__part")


def heavy_keys(sizes: DataFrame, key: str, total: int) -> DataFrame:
    """key and parts of the keys of sizes (key, size) that are dealt to several tasks."""
    limit = max(TOGETHER, total // PARTS)
    return sizes.where(F.col("size") > limit).select(key, F.ceil(F.col("size") / limit).alias("parts"))


def _heavy_centres(pairs: DataFrame) -> DataFrame:
    return heavy_keys(pairs.groupBy("b").agg(F.count("*").alias("size")), "b", pairs.count())


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, weighted: bool) -> DataFrame:
    """Those of pairs (a, b: nodes) whose texts' index is at least similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, theirs = None, None
        for b in batches:
            good = []
            for n, x, y in zip(b.column("b").to_pylist(), b.column("ta"), b.column("tb")):
                if n != centre:
                    centre, theirs = n, shingles_of(y.as_py())
                good.append(index_of(shingles_of(x.as_py()), theirs, weighted) >= similarity)
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = T.checkpointed(pairs)
    own = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = dealt_join(own, texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b", _heavy_centres(pairs), "a")
    return T.settled(both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"))


def _estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (a, b) with est, the share of equal registers, where that is high enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(v.as_py() for v in b.column(c)), np.uint32).reshape(-1, REGISTERS) for c in ("sa", "sb"))
            est = (x == y).mean(1)
            keep = est >= LEAST_ESTIMATE
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep)), pa.array(est[keep], pa.float64())], ["a", "b", "est"])

    pairs = T.checkpointed(pairs)
    own = pairs.join(nodes.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
    both = dealt_join(own, nodes.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b", _heavy_centres(pairs), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, est double")


def _rest(members: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float, heavy: DataFrame, weighted: bool) -> DataFrame:
    """Links (a, b) between components in buckets whose members are in several; at most one for each member and block.

    Members outside a bucket's largest component go to all its blocks as guests; the
    members at home in a block are held in memory, guests are read one by one.  A
    pair is compared only in the first of the bands that it shares.
    """
    m = members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = m.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    m = T.settled(dealt_join(m, mixed, "bucket", heavy, "node"))
    large = m.groupBy("bucket", "comp").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"))
    m = dealt_join(m, large, "bucket", heavy, "node").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    home = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    outside = F.col("comp") != F.col("main")
    rows = m.select("bucket", "node", "comp", outside.alias("outside"), home.alias("home"), F.explode(F.when(outside, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(home))).alias("block"))
    rows = rows.select("bucket", "block", "node", "comp", "outside", (F.col("block") != F.col("home")).alias("guest"))

    class Block:
        """The members at home in one block of a bucket; what comes out is links, or without texts the nodes to compare."""

        def __init__(self, bucket: int, final: bool):
            self.bucket, self.final, self.rows, self.out = bucket, final, [], set()
            self.known: dict[int, Shingles] = {}
            self.up: dict[int, int] = {}

        def root(self, comp: int) -> int:
            while (to := self.up.get(comp, comp)) != comp:
                comp = to
            return comp

        def shingles(self, k: int) -> Shingles:
            if k not in self.known:
                self.known[k] = shingles_of(self.rows[k]["text"])
            return self.known[k]

        def compare(self, row: dict, sig: np.ndarray) -> None:
            if not self.rows:
                return
            same = self.sigs == sig
            band = int(np.flatnonzero(buckets(sig[None])[0] == self.bucket)[0])
            first = same.reshape(-1, BANDS, ROWS).all(2).argmax(1) == band
            near = np.flatnonzero((same.mean(1) >= LEAST_ESTIMATE) & first & (self.comps != row["comp"]))
            if not self.final:
                if len(near):
                    self.out.add((row["node"], row["guest"]))
                    self.out |= {(self.rows[k]["node"], False) for k in near}
                return
            own = None
            for k in near[np.argsort(-same[near].mean(1), kind="stable")]:
                other = self.rows[k]
                if self.root(other["comp"]) == self.root(row["comp"]):
                    continue
                own = shingles_of(row["text"]) if own is None else own
                if index_of(own, self.shingles(int(k)), weighted) >= similarity:
                    self.out.add((row["node"], other["node"]))
                    self.up[self.root(row["comp"])] = self.root(other["comp"])

        def settle(self) -> None:
            """All members at home are there: compares those outside the main component with the rest."""
            self.sigs = np.frombuffer(b"".join(r["sig"] for r in self.rows), np.uint32).reshape(-1, REGISTERS)
            self.comps = np.array([r["comp"] for r in self.rows], np.int64)
            for k, r in enumerate(self.rows):
                if r["outside"]:
                    self.compare(r, self.sigs[k])

    def blocks(batches: Iterator[pa.RecordBatch], final: bool) -> Iterator[tuple[int, int, Block]]:
        """Every block once all its rows are read."""
        key, block, settled = None, None, False
        for b in batches:
            for r in b.to_pylist():
                if (r["bucket"], r["block"]) != key:
                    if block is not None:
                        if not settled:
                            block.settle()
                        yield *key, block
                    key, block, settled = (r["bucket"], r["block"]), Block(r["bucket"], final), False
                if not r["guest"]:
                    block.rows.append(r)
                    continue
                if not settled:
                    block.settle()
                    settled = True
                block.compare(r, np.frombuffer(r["sig"], np.uint32))
        if block is not None:
            if not settled:
                block.settle()
            yield *key, block

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, number, block in blocks(batches, False):
            if block.out:
                nodes_, guests = zip(*block.out)
                columns = [pa.array([bucket] * len(nodes_), pa.int64()), pa.array([number] * len(nodes_), pa.int32()), pa.array(nodes_, pa.int64()), pa.array(guests, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "block", "node", "guest"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, block in blocks(batches, True):
            if block.out:
                a, b = zip(*block.out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    signed = rows.join(nodes.select("node", "sig"), "node")
    sorted_in = lambda df: df.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "guest")
    named = T.checkpointed(sorted_in(signed).mapInArrow(wanted, "bucket long, block int, node long, guest boolean"))
    compared = signed.join(named, ["bucket", "block", "node", "guest"], "left_semi").join(texts, "node")
    return T.checkpointed(sorted_in(compared).mapInArrow(linked, "a long, b long"))


def _classes(documents: DataFrame, similarity: float, weighted: bool) -> DataFrame:
    """k1, k2, rep and top (a node that stands for its class) of every distinct text of documents (doc_id, text)."""
    nodes = _signed(documents, weighted)
    signed = nodes.where("sig is not null").select("node", "sig")

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                sig = np.frombuffer(b"".join(x.as_py() for x in b.column("sig")), np.uint32).reshape(-1, REGISTERS)
                yield pa.RecordBatch.from_arrays([pa.array(buckets(sig).ravel(), pa.int64()), pa.array(np.repeat(b.column("node").to_numpy(), BANDS), pa.int64())], ["bucket", "node"])

    banded = signed.mapInArrow(band, "bucket long, node long")
    several = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    heavy = T.checkpointed(heavy_keys(several, "bucket", BANDS * nodes.count()))
    members = T.checkpointed(dealt_join(banded, several, "bucket", heavy, "node").select("bucket", "node", "size"))

    weights = members.groupBy("node").agg(F.sum("size").alias("weight"))
    centred = members.join(weights, "node")
    centres = centred.groupBy("bucket").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("centre"))
    stars = dealt_join(centred, centres, "bucket", heavy, "node").where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    best = _estimated(stars, signed).groupBy("a").agg(F.max_by("b", F.struct("est", "b")).alias("b"))
    several = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("k1").alias("n1"), F.col("k2").alias("n2"), "rep")
    whole = keyed(documents)
    texts = T.settled(whole.join(several, (whole["k1"] == several["n1"]) & (whole["k2"] == several["n2"]) & whole["doc_id"].eqNullSafe(several["rep"])).select("node", "text").dropDuplicates(["node"]))
    edges = _verified(best, texts, similarity, weighted)
    labels = T.checkpointed(components(edges))
    more = _rest(members, labels, signed, texts, similarity, heavy, weighted)
    joined = more.join(labels.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
    joined = joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    upper = components(joined).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    tops = labels.join(upper, "comp", "full").select(F.coalesce("node", "comp").alias("node"), F.coalesce("top", "comp").alias("top"))
    return nodes.select("node", "k1", "k2", "rep").join(tops, "node", "left").select("k1", "k2", "rep", F.coalesce("top", "node").alias("top"))


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of its class) of every row of documents (doc_id, text)."""
    documents = documents.select("doc_id", "text")
    classes = _classes(documents, similarity, weighted)
    least = classes.groupBy("top").agg(F.min("rep").alias("class_id"))
    named = T.settled(classes.join(least, "top").select("k1", "k2", "class_id"))
    return keyed(documents).select("doc_id", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", "class_id")


def first_of_class(documents: DataFrame, similarity: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """documents with one row of each class: that with the smallest doc_id (one of equal rows).

    Classes are told apart by their texts, not by doc_id, which may be null or repeated; a row
    without doc_id stays only if its class has no other.
    """
    first = F.min_by(F.struct("k1", "k2", "rep"), F.struct(F.col("rep").isNull(), "rep", "k1", "k2"))
    kept = T.settled(_classes(documents.select("doc_id", "text"), similarity, weighted).groupBy("top").agg(first.alias("f")).select(F.col("f.k1").alias("__f1"), F.col("f.k2").alias("__f2"), F.col("f.rep").alias("__rep")))
    T.drop_shuffles(documents.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = documents.withColumns({"__k1": F.xxhash64(text), "__k2": F.xxhash64(F.lit(1), text)})
    same = (rows["__k1"] == kept["__f1"]) & (rows["__k2"] == kept["__f2"]) & rows["doc_id"].eqNullSafe(kept["__rep"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["__k1", "__k2"]).drop("__k1", "__k2")
