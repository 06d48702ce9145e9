"""Suffix-array dedup: removes what a document shares with an earlier place.

A byte goes if it lies in a string of `length` bytes that also starts earlier
(smaller doc_id, or further left in the same document).

Suffix arrays are built in shards, so all occurrences of a string must meet in
one shard.  Each window of `length` bytes belongs to the gram of GRAM bytes with
the smallest hash in it (the leftmost such).  Neighbouring windows with their
gram in the same half of the window are a segment; the bytes that all windows of
such a half hold are its core.  Equal windows have equal cores, so:

1. count cores over the corpus and keep those that occur again;
2. equal segments count once: all but the first occurrence of a segment are
   repeats as a whole;
3. cores with several different segments are dealt to shards by their hash.
   A shard's suffix array is built by induced sorting, its permuted LCP array
   from the irreducible entries, and windows that share `length` bytes are
   neighbours in it; all but the first of them are repeats.  A core with very
   many segments is cut into groups of PIECE windows, dealt by the longer core
   of such a group;
4. where even that core has very many groups (a line that many documents go on from
   differently), their windows are told apart one by one.

All levels of the recursion sort by induction.  At the first, with few letters, the suffixes
that a bucket induces are put into their buckets all at once; at the others, one by one.

Equal segments are told by two hashes of 64 bits, of the core and of the whole, windows in
a shard by their bytes.

A null text counts as empty; texts under `length` bytes keep all.  Rows that
repeat a doc_id with the same text are one document, listed once for each row;
with another text they are ordered by a hash of it.  A null doc_id comes first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import text as T

LENGTH, GRAM = 100, 20
SHARD_BYTES = 1 << 20
#: Distinct segments of one core beyond which they are cut into pieces.
MANY, PIECE = 2000, 8
#: Parts of the rows of one hot window.
SALTS = 16
BLOCK_BYTES = 4 << 20
_PLACE = np.uint64((1 << 24) - 1)


# ---------------------------------------------------------------- suffix array


def suffix_array(text: np.ndarray, letters: int) -> np.ndarray:
    """Suffix array of text (integers in [1, letters)), which ends with a 0 found nowhere else, by induced sorting."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    step = np.sign(text[1:].astype(np.int64) - text[:-1])
    turn = np.where(step != 0, np.arange(n - 1), n - 1)
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    small = np.ones(n, bool)  # S-type
    small[:-1] = np.append(step, 1)[turn] > 0
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    # with few letters all that a bucket induces goes at once; with many, buckets are small and suffixes go one by one
    induced = _induced if letters <= max(512, n // 64) else _induced_singly
    if len(lms) <= 1:
        return induced(text, letters, small, lms)
    order = induced(text, letters, small, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    end = np.empty(n, np.int64)
    end[lms] = np.append(lms[1:], n - 1) + 1
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(T.mix(text.astype(np.uint64) + np.uint64(1)) * T._powers(n + 1)[0][:n])))
    code = T.span_hash(prefix, order, end[order])
    new = np.concatenate(([0], (code[1:] != code[:-1]) | (np.diff(end[order] - order) != 0)))
    name = np.empty(n, np.int64)
    name[order] = np.cumsum(new)
    names = name[lms]
    if names.max() + 1 < len(lms):
        # the last name is that of the end, the smallest and the only one of its kind
        order = lms[suffix_array(names, int(names.max()) + 1)]
    return induced(text, letters, small, order)


def _induced_singly(text: np.ndarray, letters: int, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """As _induced, suffix by suffix, with a place for each bucket's next one."""
    ends = np.cumsum(np.bincount(text, minlength=letters))
    head, tail = (ends - np.bincount(text, minlength=letters)).tolist(), ends.tolist()
    letter, is_small, out = text.tolist(), small.tolist(), [-1] * len(text)
    for i in lms[::-1].tolist():
        tail[letter[i]] -= 1
        out[tail[letter[i]]] = i
    for i in out:  # places to the right are filled while this goes on
        if i > 0 and not is_small[i - 1]:
            c = letter[i - 1]
            out[head[c]] = i - 1
            head[c] += 1
    tail = ends.tolist()
    for at in range(len(out) - 1, -1, -1):
        i = out[at]
        if i > 0 and is_small[i - 1]:
            c = letter[i - 1]
            tail[c] -= 1
            out[tail[c]] = i - 1
    out[0] = len(out) - 1
    return np.array(out, np.int64)


def _induced(text: np.ndarray, letters: int, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, induced from the LMS suffixes in the given order.

    What a bucket holds when its turn comes induces at once; only what it induces into itself takes another turn.
    """
    text = text.astype(np.min_scalar_type(letters))  # short letters are sorted by radix
    great = ~small

    def deal(to: list[list[np.ndarray]], at: np.ndarray) -> None:
        if not len(at):
            return
        c = text[at]
        order = np.argsort(c, kind="stable")
        at, c = at[order], c[order]
        cut = [0, *(np.flatnonzero(c[1:] != c[:-1]) + 1).tolist(), len(at)]
        for i, j in zip(cut, cut[1:]):
            to[c[i]].append(at[i:j])

    def induce(to: list[list[np.ndarray]], at: np.ndarray, kind: np.ndarray) -> None:
        before = at - 1
        before = before[before >= 0]
        deal(to, before[kind[before]])

    seeds: list[list[np.ndarray]] = [[] for _ in range(letters)]
    deal(seeds, lms)
    large: list[list[np.ndarray]] = [[] for _ in range(letters)]
    for c in range(letters):
        k = 0
        while k < len(large[c]):
            at, k = np.concatenate(large[c][k:]), len(large[c])
            induce(large, at, great)
        for x in seeds[c]:
            induce(large, x, great)
    tails: list[list[np.ndarray]] = [[] for _ in range(letters)]  # S-type, from right to left
    for c in range(letters - 1, -1, -1):
        k = 0
        while k < len(tails[c]):
            at, k = np.concatenate(tails[c][k:]), len(tails[c])
            induce(tails, at, small)
        if large[c]:
            induce(tails, np.concatenate(large[c])[::-1], small)
    out = [np.array([len(text) - 1])]
    for c in range(letters):
        out += large[c]
        out += [x[::-1] for x in reversed(tails[c])]
    found = np.concatenate(out)
    return found if len(found) == len(text) else found[np.concatenate(([True], found[1:] != len(text) - 1))]


def permuted_lcp(raw: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place of raw (bytes) the length it shares with the suffix before it in order."""
    n = len(raw)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    at = np.arange(n)
    own = before >= 0
    alike = own & (at > 0) & (before > 0)
    alike[alike] = raw[at[alike] - 1] == raw[before[alike] - 1]
    start = np.flatnonzero(own & ~alike)
    length = np.zeros(n, np.int64)
    a, b, live = start.copy(), before[start], start.copy()
    while len(live):
        most = n - np.maximum(a, b)
        x = np.ascontiguousarray(words[a]).view("<u8").ravel() ^ np.ascontiguousarray(words[b]).view("<u8").ravel()
        same = np.where(x == 0, 8, 0)
        part = np.flatnonzero(x)
        low = x[part] & (~x[part] + np.uint64(1))
        same[part] = np.log2(low.astype(np.float64)).astype(np.int64) >> 3
        same = np.minimum(same, most)
        length[live] += same
        go = (same == 8) & (most > 8)
        live, a, b = live[go], a[go] + 8, b[go] + 8
    # reducible entries are one less than the entry before them
    value = np.where(own & alike, -1, length + at)
    last = np.maximum.accumulate(np.where(own & alike, -1, at))
    return np.where(own, np.maximum(value[np.maximum(last, 0)] - at, 0), 0)


def repeated_windows(segments: list[bytes], places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of length bytes that also start at a smaller place: segment, first window and the one after the last; places[i]: that of segment i's first byte."""
    which, begin, parts = candidates(segments, length)
    if not len(which):
        return which, begin, begin
    owner, first, after = _sorted_repeats(parts, places[which] + begin, length)
    return which[owner], begin[owner] + first, begin[owner] + after


def candidates(segments: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The parts of segments whose windows have a hash that occurs again: segment, first byte and bytes of each.

    Equal windows have equal hashes, so nothing is lost; the suffix array compares the bytes.
    """
    sizes = np.array([len(s) for s in segments])
    raw = np.frombuffer(b"".join(segments), np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    key = T.spans_hash(T.prefix_hash(raw), length)
    owner = np.repeat(np.arange(len(segments)), sizes)[: len(key)]
    window = np.arange(len(key)) + length <= (starts + sizes)[owner]
    found = key[window]
    order = np.sort(found)
    again = np.zeros(len(key), bool)
    again[window] = T.contained(found, order[1:][order[1:] == order[:-1]])
    # runs of such windows, cut where a segment ends
    on = np.concatenate(([False], again, [False]))
    lead = np.concatenate((owner, [-1])) != np.concatenate(([-1], owner))
    first = np.flatnonzero(on[1:] & (~on[:-1] | lead))[: len(key)]
    last = np.flatnonzero(on[1:-1] & (~on[2:] | lead[1:]))
    return owner[first], first - starts[owner[first]], [raw[a : b + length].tobytes() for a, b in zip(first, last)]


def _sorted_repeats(segments: list[bytes], places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """repeated_windows by the suffix array of all segments."""
    sizes = np.array([len(s) for s in segments])
    raw = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    text = np.append(raw.astype(np.int64) + 1, 0)
    used = np.unique(text)
    order = suffix_array(np.searchsorted(used, text), len(used))[1:]
    lcp = permuted_lcp(raw, order)[order]
    owner = np.repeat(np.arange(len(segments)), sizes + 1)
    inside = np.arange(len(raw)) - starts[owner]
    group = np.cumsum(lcp < length)
    window = inside[order] + length <= sizes[owner[order]]
    at, group = order[window], group[window]
    place = places[owner[at]] + inside[at]
    repeat = np.zeros(len(raw), bool)
    if len(at):
        first = np.concatenate(([True], group[1:] != group[:-1]))
        least = np.minimum.reduceat(place, np.flatnonzero(first))
        repeat[at] = place > least[np.cumsum(first) - 1]
    edge = np.diff(np.concatenate(([0], repeat.view(np.int8), [0])))  # separators end every run
    first, after = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    return owner[first], inside[first], inside[first] + (after - first)


# -------------------------------------------------------------------- segments


def segments_of(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Rows, core hashes, hashes, starts (within the row), window counts and gram places (from the start) of the segments of rows data[bounds[i]:bounds[i+1]]."""
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    prefix = T.prefix_hash(data)
    least = (T.spans_hash(prefix, GRAM) & ~_PLACE) | np.arange(len(data) - GRAM + 1, dtype=np.uint64)
    width, span = 1, length - GRAM + 1
    while 2 * width <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + length <= bounds[row + 1])
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    anchor = (least[start] & _PLACE).astype(np.int64)
    half = -(-span // 2)
    part = (anchor - start) // half
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]) | (np.diff(start) != 1) | (row[start[1:]] != row[start[:-1]]))))
    count = np.diff(np.append(first, len(start)))
    begin, anchor = start[first], anchor[first]
    core = anchor - half * part[first]
    key = T.mix(T.span_hash(prefix, core, core + length - half + 1) + part[first].astype(np.uint64))
    return row[begin], key.astype(np.int64), T.span_hash(prefix, begin, begin + count - 1 + length).astype(np.int64), begin - bounds[row[begin]], count, anchor - begin


def _segment_table(rows: DataFrame, length: int) -> DataFrame:
    """f (gram), h (segment), doc_id, k, s (start) and c (windows) of every segment of rows (doc_id, k, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = T.utf8(b.column("text"))
            for i, j in T.slices(offsets):
                lo, hi = offsets[i], offsets[j]
                blocks = [(lo, hi, offsets[i : j + 1] - lo, 0)] if hi - lo <= BLOCK_BYTES else [(x, min(hi, x + BLOCK_BYTES + length - 1), np.array([0, min(hi - x, BLOCK_BYTES + length - 1)]), x - lo) for x in range(lo, hi, BLOCK_BYTES)]
                for x, y, bounds, skipped in blocks:
                    row, f, h, s, c, _ = segments_of(data[x:y], bounds, length)
                    take = pa.array(row + i)
                    yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(h), b.column("doc_id").take(take), b.column("k").take(take), pa.array(s + skipped, pa.int64()), pa.array(c, pa.int32())], ["f", "h", "doc_id", "k", "s", "c"])

    return rows.mapInArrow(run, f"f long, h long, doc_id {dict(rows.dtypes)['doc_id']}, k long, s long, c int")


def _shard_spans(segments: DataFrame, length: int) -> DataFrame:
    """doc_id, k, a, b: spans of the segments' windows that also start at an earlier place; segments (shard, doc_id, k, s, bytes)."""
    kind = dict(segments.dtypes)["doc_id"]

    def solve(docs: list, starts: list[int], pieces: list[bytes]) -> pa.RecordBatch:
        ranks = {d: i for i, d in enumerate(sorted(set(docs), key=lambda d: (d[0] is not None, d[0], d[1])))}
        places = np.array([(ranks[d] << 36) + s for d, s in zip(docs, starts)], np.int64)
        which, first, after = repeated_windows(pieces, places, length)
        begin = np.array(starts, np.int64)[which]
        return pa.RecordBatch.from_arrays(
            [pa.array([docs[i][0] for i in which], doc_type), pa.array([docs[i][1] for i in which], pa.int64()), pa.array(begin + first, pa.int64()), pa.array(begin + after - 1 + length, pa.int64())], ["doc_id", "k", "a", "b"]
        )

    doc_type = to_arrow_type(segments.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, docs, starts, pieces = None, [], [], []
        for b in batches:
            for n, d, k, s, x in zip(*(b.column(c).to_pylist() for c in ("shard", "doc_id", "k", "s", "bytes"))):
                if n != shard:
                    if len(pieces) > 1:
                        yield solve(docs, starts, pieces)
                    shard, docs, starts, pieces = n, [], [], []
                docs.append((d, k))
                starts.append(s)
                pieces.append(bytes(x))
        if len(pieces) > 1:
            yield solve(docs, starts, pieces)

    return segments.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, f"doc_id {kind}, k long, a long, b long")


def _window_spans(pieces: DataFrame, length: int) -> DataFrame:
    """doc_id, k, a, b: windows of pieces (doc_id, k, s, bytes) that also start at an earlier place in one of them."""
    starts = F.sequence(F.lit(0), F.octet_length("bytes") - length)
    at = pieces.select("doc_id", "k", "s", "bytes", F.explode(starts).alias("i")).select("doc_id", "k", (F.col("s") + F.col("i")).alias("s"), F.expr(f"substring(bytes, i + 1, {length})").alias("w"))
    first = at.groupBy("w").agg(F.min(F.struct("doc_id", "k", "s")).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("w").alias("w2"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt2"))
    salted = at.withColumn("salt", F.pmod(F.xxhash64("doc_id", "k", "s"), F.lit(SALTS)).cast("int"))
    later = salted.join(first, (F.col("w") == F.col("w2")) & (F.col("salt") == F.col("salt2"))).where(~F.struct("doc_id", "k", "s").eqNullSafe(F.col("first")))
    return later.select("doc_id", "k", F.col("s").alias("a"), (F.col("s") + length).alias("b"))


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, k and spans (array of [a, b) bytes, possibly overlapping) of the rows (doc_id, k, text; one for each doc_id and k) that repeat something."""
    again = T.settled(_segment_table(rows, length).groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f"))
    occurrences = T.settled(_segment_table(rows, length).join(again, "f", "left_semi"))
    groups = T.settled(occurrences.groupBy("f", "h").agg(F.min(F.struct("doc_id", "k", "s")).alias("first"), F.count("*").alias("n"), F.first("c").alias("c")))
    copies = groups.where("n > 1").select("f", "h", "first")
    whole = occurrences.join(copies, ["f", "h"]).where(~F.struct("doc_id", "k", "s").eqNullSafe(F.col("first"))).select("doc_id", "k", F.col("s").alias("a"), (F.col("s") + F.col("c") - 1 + length).alias("b"))

    kinds = groups.groupBy("f").agg(F.count("*").alias("kinds"), F.sum(F.col("c") + length - 1).alias("size")).where("kinds > 1")
    total = kinds.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_BYTES))
    wanted = groups.select("f", "c", "first.*").join(kinds.select("f", "kinds"), "f")
    many = F.col("kinds") > MANY
    same = wanted["doc_id"].eqNullSafe(rows["doc_id"]) & (wanted["k"] == rows["k"])
    cut = wanted.join(rows.select("doc_id", "k", F.col("text").cast("binary").alias("raw")), same).select(
        "f", many.alias("many"), wanted["doc_id"], wanted["k"], "s", F.expr(f"substring(raw, cast(s + 1 as int), c + {length - 1})").alias("bytes")
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of at most PIECE windows at the same places around the gram, with a hash of the bytes all of them hold."""
        for b in batches:
            out, of = [], []
            for i, x in enumerate(b.column("bytes").to_pylist()):
                raw = np.frombuffer(x, np.uint8)
                anchor = int(segments_of(raw, np.array([0, len(raw)]), length)[5][0])
                want = b.column("f")[i].as_py()
                windows = len(raw) - length + 1
                lo = 0
                while lo < windows:
                    step = (anchor - lo) % PIECE + 1  # to where anchor - start is a multiple of PIECE
                    hi = min(windows, lo + step)
                    # all windows of a full group hold the bytes from -core to length - core - PIECE + 1 around the gram
                    core = (anchor - lo) // PIECE * PIECE
                    a, z = anchor - core, anchor - core + length - PIECE + 1
                    out.append((want ^ int.from_bytes(hashlib.blake2b(b"%d " % core + x[max(a, 0) : z], digest_size=8).digest(), "little", signed=True), lo, x[lo : hi - 1 + length]))
                    of.append(i)
                    lo = hi
            columns = list(zip(*out)) if out else [(), (), ()]
            take = pa.array(of, pa.int64())
            s = np.array(b.column("s").to_pylist(), np.int64)[np.array(of, int)] + np.array(columns[1], np.int64)
            key = np.array([v & 0x7FFFFFFFFFFFFFFF for v in columns[0]], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), b.column("doc_id").take(take), b.column("k").take(take), pa.array(s), pa.array(columns[2], pa.binary())], ["f", "doc_id", "k", "s", "bytes"])

    cut = T.settled(cut)
    parted = T.checkpointed(cut.where("many").select("f", "doc_id", "k", "s", "bytes").mapInArrow(pieces, f"f long, doc_id {dict(rows.dtypes)['doc_id']}, k long, s long, bytes binary"))
    hot = parted.groupBy("f").agg(F.count("*").alias("n")).where(F.col("n") > MANY).select("f")
    dealt = cut.where("not many").select("f", "doc_id", "k", "s", "bytes").unionByName(parted.join(hot, "f", "left_anti")).withColumn("shard", F.pmod(F.xxhash64("f"), F.lit(shards)))
    spans = whole.unionByName(_shard_spans(dealt, length)).unionByName(_window_spans(parted.join(hot, "f", "left_semi"), length))
    found = T.settled(spans.groupBy("doc_id", "k").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    del again, occurrences, groups, copies, whole, kinds, wanted, cut, parted, hot, dealt, spans
    T.drop_shuffles(found.sparkSession)
    return found


def _unique(rows: DataFrame) -> bool:
    n = rows.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return (n or 0) <= 1


def ordered(documents: DataFrame) -> tuple[DataFrame, Column]:
    """Rows (doc_id, k, text), one for each doc_id and k, and the k of documents' rows, which tells texts of one doc_id apart."""
    text = F.coalesce("text", F.lit(""))
    unique = _unique(documents)
    k: Column = F.lit(0).cast("long") if unique else F.xxhash64(text)
    rows = documents.select("doc_id", k.alias("k"), text.alias("text"))
    return (rows if unique else rows.dropDuplicates(["doc_id", "k"])), k


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs covered by spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def _with_spans(documents: DataFrame, length: int, keep: list[str]) -> DataFrame:
    rows, k = ordered(documents.select("doc_id", "text"))
    spans = repeated_spans(rows, length)
    whole = documents.select(*keep, F.coalesce("text", F.lit("")).alias("__text"), k.alias("__k"))
    return whole.join(spans.select(F.col("doc_id").alias("__doc"), F.col("k").alias("__k2"), F.col("spans").alias("__spans")), F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__k") == F.col("__k2")), "left").drop("__doc", "__k", "__k2")


def digests(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, s in zip(b.column("__text").to_pylist(), b.column("__spans").to_pylist()):
                raw = t.encode("utf-8", "surrogatepass")
                spans = merged(s)
                out.append((len(raw), sum(y - x for x, y in spans), len(spans), hashlib.sha256(kept_bytes(raw, spans)).hexdigest()))
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(documents, length, ["doc_id"]).mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """documents with text without its repeated bytes (a character that is cut goes as a whole) and, if there, n_chars; texts that were repeats as a whole go."""
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep = [], []
            for t, s in zip(b.column("__text").to_pylist(), b.column("__spans").to_pylist()):
                kept = kept_bytes(t.encode("utf-8", "surrogatepass"), merged(s)).decode("utf-8", "ignore") if s else t
                texts.append(kept)
                keep.append(not s or bool(kept.strip()))
            columns = {c: b.column(c) for c in names if c != "text"} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t) for t in texts], b.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names).filter(pa.array(keep, pa.bool_()))

    return _with_spans(documents, length, [c for c in names if c != "text"]).mapInArrow(run, documents.schema)
