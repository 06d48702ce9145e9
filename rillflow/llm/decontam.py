"""Benchmark decontamination: random walks over item-sized windows, bit sampling, exact edit check.

A document holds an item if some part of it is within an edit distance of `share`
of the item's length.  A walk reads a window from its start: at each step it writes down the
byte it stands on and a random bit of that step and byte says whether it moves on (the
CGK embedding).  Walks of equal randomness over two windows come together again after
an edit, so windows at a small edit distance have outputs at a small Hamming distance.

Windows are as long as the items: an item belongs to the largest of WINDOWS that is no more
than FIT of its length, and has one window for each word that leaves room, so a chance for each.
Documents have a window at every word.  For each class, sets of `bits` steps are drawn from the
whole walk; windows that agree on all steps of a set are candidates, if they
agree on LEAST_AGREEMENT of all steps drawn, too.  Walks are added until items that
are edited at random by the whole of `share` are found with probability `recall` in every
class (measured on up to TRIALS items of each; bits grow with the logarithm of the number of
item windows).  Every candidate is checked by a bit-parallel edit distance, free at the window's ends.

Texts are compared in ASCII lower case, white space runs as one space.  Words begin after white space and
punctuation, and scripts without spaces at every character.  Items are looked up in parts of about
PART_BYTES, each sent to all tasks, so what is broadcast is bounded.  Items
under MIN_BYTES bytes, or without a word, are found only as they stand, between white space, punctuation or a text's
ends.  Null and empty texts and items hold nothing.  Repeated rows are reported once each; equal items each.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import text as T

SHARE, RECALL = 0.1, 0.98
MIN_BYTES = 24
PART_BYTES = 32 << 20
#: Lengths of windows in bytes, and the largest share of an item that its windows have.
WINDOWS, FIT = (18, 30, 46, 64), 0.8
#: Sets of steps drawn from each walk for each class, most walks, and items that are edited to choose their number.
SETS, MOST_WALKS, TRIALS = 6, 16, 150
LEAST_AGREEMENT = 0.6
#: Windows of a document that are walked at a time, so that they stay in the processor's cache.
AT_ONCE = 1 << 14
#: Steps that one table look-up takes.
STRIDE = 3
#: 0 to 31 for each byte: letters apart, then stops, digits, other ASCII, and two for all others.
LETTER = np.array([b - 96 if 97 <= b <= 122 else 0 if b == 32 else 27 if b in b".," else 28 if 48 <= b <= 57 else 29 if b < 128 else 30 + (b & 1) for b in range(256)], np.uint8)


#: Bytes in lower case, white space as a space.
PLAIN = np.where(T.BYTE_KIND == 0, 32, T.LOWER).astype(np.uint8)


def normal(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in lower case with one space for each run of white space (rows begin with one), and the rows' new bounds."""
    out = PLAIN[data]
    drop = np.zeros(len(out), bool)
    if len(out):
        space = out == 32
        np.logical_and(space[1:], space[:-1], out=drop[1:])
        drop[bounds[(bounds > 0) & (bounds < len(data))]] = False
    gone = np.flatnonzero(drop)
    return (out[~drop] if len(gone) else out), bounds - np.searchsorted(gone, bounds)


def word_starts(data: np.ndarray) -> np.ndarray:
    """Where windows begin: at runs of letters and digits, and at characters of three bytes or more."""
    word = T.BYTE_KIND[data] == 1
    first = word.copy()
    first[1:] &= ~word[:-1]
    return np.flatnonzero(first | (data >= 0xE0))


@lru_cache(maxsize=64)
def walk_tables(walk: int) -> np.ndarray:
    """For every STRIDE steps of a walk and any STRIDE letters ahead, how many of them it passes."""
    random_bits = np.random.default_rng([11, walk]).integers(0, 2, (2 * WINDOWS[-1], 32), np.uint8)
    ahead = np.arange(32**STRIDE)
    letters = np.stack([ahead >> (5 * (STRIDE - 1 - k)) & 31 for k in range(STRIDE)])
    out = np.zeros((2 * WINDOWS[-1] // STRIDE, len(ahead)), np.uint8)
    for j in range(len(random_bits) // STRIDE * STRIDE):
        at = out[j // STRIDE]
        at += random_bits[j][letters[at, ahead]]
    return out


@lru_cache(maxsize=64)
def drawn(walk: int, window: int, bits: int) -> np.ndarray:
    """SETS sets of bits of the strides of a walk over a window."""
    random_sets = np.random.default_rng([12, walk, window])
    return np.stack([np.sort(random_sets.choice(2 * window // STRIDE, bits, replace=False)) for _ in range(SETS)])


class Walks:
    """Outputs of walks over data, a row for each stride."""

    def __init__(self, data: np.ndarray):
        letters = np.concatenate([LETTER[data], np.zeros(2 * WINDOWS[-1] + STRIDE, np.uint8)]).astype(np.uint16)
        self.ahead = sum(letters[k : len(letters) - STRIDE + 1 + k] << np.uint16(5 * (STRIDE - 1 - k)) for k in range(STRIDE))

    def outputs(self, starts: np.ndarray, walk: int, window: int) -> np.ndarray:
        table, at = walk_tables(walk), starts.astype(np.int64)
        out = np.empty((2 * window // STRIDE, len(at)), np.uint32)
        for g in range(len(out)):
            code = self.ahead.take(at)
            np.right_shift(code, 5 * (STRIDE - 1), out=out[g], casting="unsafe")
            at += table[g].take(code)
        return out


def keys_of(out: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """One number for each window from the outputs at a set of steps."""
    key = np.zeros(out.shape[1], np.uint32)
    for g in steps:
        key *= np.uint32(0x01000193)
        key ^= out[g]
    return key * np.uint32(0x9E3779B1)


@dataclass
class Class:
    """Item windows of one length."""

    window: int
    data: np.ndarray  # all items of the class, one after the other
    starts: np.ndarray  # of the windows in data
    owner: np.ndarray  # (item, byte offset in it) of each window
    bits: int

    @staticmethod
    def of(window: int, raw: list[bytes], numbers: list[int]) -> Class:
        starts, owner, at = [], [], 0
        for k in numbers:
            first = word_starts(np.frombuffer(raw[k], np.uint8))
            first = first[(first <= len(raw[k]) - window) | (first == first[0])]
            starts.append(first + at)
            owner.append(np.stack([np.full(len(first), k), first], 1))
            at += len(raw[k]) + 2 * window
        gap = b" " * (2 * window)
        found = np.concatenate(starts)
        # chance agreement of two letters is about 1 in 14
        bits = int(np.clip(np.ceil(np.log(len(found) / 0.02) / np.log(14)), 6, 10))
        return Class(window, np.frombuffer(gap.join(raw[k] for k in numbers) + gap, np.uint8), found, np.concatenate(owner), bits)

    def table(self, walk: int) -> tuple:
        """Per set (which leading bits of keys occur, sorted keys, their windows, shift to the leading bits); outputs at all drawn strides, these, and the sets."""
        out = Walks(self.data).outputs(self.starts, walk, self.window)
        sets = drawn(walk, self.window, self.bits)
        used = np.unique(sets)
        size = int(np.clip(np.ceil(np.log2(64 * len(self.starts))), 12, 24))
        made = []
        for steps in sets:
            key = keys_of(out, steps)
            order = np.argsort(key, kind="stable")
            slots = np.zeros(1 << size, bool)
            slots[key >> np.uint32(32 - size)] = True
            made.append((slots, key[order], order, 32 - size))
        return made, out[used].astype(np.uint8), used, sets

    def matches(self, table: tuple, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window in the document, window in the items) that agree on a set of steps and on enough of all steps."""
        made, outputs, used, sets = table
        ours, theirs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for (slots, keys, order, shift), steps in zip(made, sets):
            key = keys_of(out, steps)
            live = np.flatnonzero(slots.take(key >> np.uint32(shift)))
            lo = np.searchsorted(keys, key[live], "left")
            hit = keys.take(lo, mode="clip") == key[live]
            if not hit.any():
                continue
            live, lo = live[hit], lo[hit]
            n = np.searchsorted(keys, key[live], "right") - lo
            total = np.concatenate(([0], np.cumsum(n)))
            for i, j in T.slices(total, HITS):
                at = np.repeat(lo[i:j] - (total[i:j] - total[i]), n[i:j]) + np.arange(total[j] - total[i])
                a, b = np.repeat(live[i:j], n[i:j]), order[at]
                good = (out[used[:, None], a] == outputs[:, b]).mean(0) >= LEAST_AGREEMENT
                ours.append(a[good])
                theirs.append(b[good])
        return np.concatenate(ours), np.concatenate(theirs)


def edited(item: bytes, edits: int, rng: random.Random) -> bytes:
    """item with edits random insertions, deletions and substitutions at different places."""
    out = [item[i : i + 1] for i in range(len(item))]
    for i in rng.sample(range(len(out)), edits):
        new = bytes([rng.choice(b"abcdefghijklmnopqrstuvwxyz ")])
        out[i] = rng.choice((new, b"", out[i] + new))
    return b"".join(out)


@dataclass
class Items:
    """One part of the items."""

    raw: list[bytes]
    ids: list
    classes: list[Class]
    walks: int
    recall: dict[int, float]  # of each class, as measured on edited items
    short: list[int]  # items for exact search only
    share: float

    @staticmethod
    def of(ids: list, texts: list[str], share: float, recall: float = RECALL) -> Items:
        raw, short, dealt = [], [], {}
        for k, t in enumerate(texts):
            b = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
            n, _ = normal(b, np.array([0, len(b)]))
            raw.append(n.tobytes().strip())
            if len(raw[k]) >= MIN_BYTES and len(word_starts(np.frombuffer(raw[k], np.uint8))):
                dealt.setdefault(max(w for w in WINDOWS if w <= max(FIT * len(raw[k]), WINDOWS[0])), []).append(k)
            elif raw[k]:
                short.append(k)
        classes = [Class.of(w, raw, numbers) for w, numbers in sorted(dealt.items())]
        walks, measured = 2, {}
        for c, numbers in zip(classes, (n for _, n in sorted(dealt.items()))):
            rng = random.Random(c.window)
            tried = sorted(numbers, key=lambda k: (len(raw[k]), raw[k]))  # the shortest have the fewest windows
            tried = tried[:TRIALS // 2] + rng.sample(tried[TRIALS // 2 :], min(TRIALS - TRIALS // 2, max(0, len(tried) - TRIALS // 2)))
            found, used = np.zeros(0, bool), 0
            while used < walks or (found.mean() < recall and used < MOST_WALKS):
                now = Items._finds(c, raw, tried, used, share)
                found = now if not used else found | now
                used += 1
            walks, measured[c.window] = max(walks, used), float(found.mean())
        return Items(raw, ids, classes, walks, measured, short, share)

    @staticmethod
    def _finds(c: Class, raw: list[bytes], tried: list[int], walk: int, share: float) -> np.ndarray:
        """Which of the items a walk finds in copies with as many edits as share allows."""
        table, out = c.table(walk), np.zeros(len(tried), bool)
        gap = b" " * (2 * c.window)
        copies = [edited(raw[k], int(share * len(raw[k])), random.Random(k)) for k in tried]
        data = np.frombuffer(gap.join(copies) + gap, np.uint8)
        bounds = np.concatenate(([0], np.cumsum([len(x) + len(gap) for x in copies])))
        starts = word_starts(data)
        ours, theirs = c.matches(table, Walks(data).outputs(starts, walk, c.window))
        row = np.searchsorted(bounds, starts[ours], "right") - 1
        item, offset = c.owner[theirs].T
        near = np.abs(starts[ours] - bounds[row] - offset) <= 4 * share * np.array([len(x) for x in copies])[row] + 1
        out[row[(np.array(tried)[row] == item) & near]] = True
        return out

    def tables(self) -> list[list[tuple]]:
        return [[c.table(walk) for c in self.classes] for walk in range(self.walks)]

    def candidates(self, tables: list[list[tuple]], data: np.ndarray) -> np.ndarray:
        """Distinct (place in data, item, byte offset in the item) of windows that match."""
        starts, found = word_starts(data), [np.zeros((0, 3), np.int64)]
        if not self.classes or not len(starts):
            return found[0]
        walks = Walks(data)
        for i in range(0, len(starts), AT_ONCE):
            block = starts[i : i + AT_ONCE]
            for walk, made in enumerate(tables):
                out = walks.outputs(block, walk, self.classes[-1].window)
                for c, table in zip(self.classes, made):
                    ours, theirs = c.matches(table, out)
                    if len(ours):
                        found.append(np.column_stack([block[ours], c.owner[theirs]]))
        return np.unique(np.concatenate(found), axis=0)

    def held(self, text: bytes, hits: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, distance, byte offset of the window) of the items that a normalised text holds; hits: (start, item, offset)."""
        out = []
        for k in np.unique(hits[:, 1]):
            item = self.raw[k].decode("utf-8", "replace")
            most = int(self.share * len(item))
            size, slack = len(self.raw[k]), 4 * most
            begins = np.unique(hits[hits[:, 1] == k][:, 0] - hits[hits[:, 1] == k][:, 2])
            best, done = (most + 1, 0), -1
            for begin in begins:
                # windows that begin close together are one region
                if begin < done:
                    continue
                lo, hi = max(0, int(begin) - slack), min(len(text), int(begin) + size + 2 * slack)
                d = distance_within(item, text[lo:hi].decode("utf-8", "ignore"))
                best = min(best, (d, max(0, int(begin))))
                done = begin + max(slack, 1)
                if best[0] == 0:
                    break
            if best[0] <= most:
                out.append((int(k), *best))
        return out

    def short_finder(self):
        """Finds all short items in one pass over a text."""
        import ahocorasick

        finder = ahocorasick.Automaton()
        for k in self.short:
            key = self.raw[k].decode("latin-1")
            finder.add_word(key, (*finder.get(key, (len(key),)), k))
        finder.make_automaton()
        return finder


def exact_words(finder, text: bytes) -> list[tuple[int, int, int]]:
    """(item, 0, first place) of short items in text where no word goes on beyond the item's ends."""

    def joined(i: int) -> bool:
        return 0 < i < len(text) and T.BYTE_KIND[text[i - 1]] == 1 and T.BYTE_KIND[text[i]] == 1

    first: dict[int, int] = {}
    for last, (size, *items) in finder.iter(text.decode("latin-1")):
        if not joined(last + 1 - size) and not joined(last + 1):
            for k in items:
                first.setdefault(k, last + 1 - size)
    return [(k, 0, at) for k, at in sorted(first.items())]


def distance_within(item: str, region: str) -> int:
    """Least edit distance between item and any part of region (bit-parallel, one integer operation per character)."""
    m = len(item)
    if not m:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in region:
        eq = where.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = (mv | ~(xh | pv)) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv
        if score < best:
            best = score
    return best


def parts_of(benchmark: DataFrame, part_bytes: int = PART_BYTES) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of the items, in parts of about part_bytes."""
    rows = benchmark.select("item_id", "text").where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // part_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        found = sorted(part.collect(), key=lambda r: (r["item_id"] is not None, r["item_id"], r["text"]))
        yield [r["item_id"] for r in found], [r["text"] for r in found]


#: Matches that are compared at a time.
HITS = 1 << 18


def _found(items: Items, tables: list, finder, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """(row, what it holds) of the rows that hold an item."""
    for i, j in T.slices(offsets):
        flat, bounds = normal(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        if not len(flat):
            continue
        hits = items.candidates(tables, flat)
        owner = np.searchsorted(bounds, hits[:, 0], "right") - 1
        for r in range(j - i) if finder else np.unique(owner):
            text = flat[bounds[r] : bounds[r + 1]].tobytes()
            held = items.held(text, hits[owner == r] - np.array([bounds[r], 0, 0])) + (exact_words(finder, text) if finder else [])
            if held:
                yield i + int(r), held


def leaks(documents: DataFrame, benchmark: DataFrame, share: float = SHARE, recall: float = RECALL) -> DataFrame:
    """doc_id, item_id, distance and begin (byte offset in the normalised text) of every item that a document holds."""
    kind, item_kind = dict(documents.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = None
    for ids, texts in parts_of(benchmark):
        items = Items.of(ids, texts, share, recall)

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            tables, finder = items.tables(), items.short_finder() if items.short else None
            for b in batches:
                rows, found = [], []
                for r, held in _found(items, tables, finder, *T.utf8(b.column("text"))):
                    rows += [r] * len(held)
                    found += held
                if rows:
                    k, d, at = zip(*found)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows)), pa.array([items.ids[x] for x in k], item_type), pa.array(d, pa.int32()), pa.array(at, pa.int64())], ["doc_id", "item_id", "distance", "begin"])

        one = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, distance int, begin long")
        out = one if out is None else out.unionByName(one)
    return out


def clean(documents: DataFrame, benchmark: DataFrame, share: float = SHARE, recall: float = RECALL) -> DataFrame:
    """documents without the rows that hold an item; every row is judged by its own text, so null and repeated ids do not matter."""
    for ids, texts in parts_of(benchmark):
        items = Items.of(ids, texts, share, recall)

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            tables, finder = items.tables(), items.short_finder() if items.short else None
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for r, _ in _found(items, tables, finder, *T.utf8(b.column("text"))):
                    keep[r] = False
                yield b.filter(pa.array(keep))

        documents = documents.mapInArrow(run, documents.schema)
    return documents
