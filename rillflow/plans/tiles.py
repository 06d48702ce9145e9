"""Evaluates recurrences over grids tile by tile.

A grid is dealt to square tiles, each with a rim of one cell from its
neighbours.  A kernel solves a tile from its inputs and from what is known of
the rim.  Tiles then exchange their outermost cells, and the kernel runs again on the
tiles whose rim has changed, until none has.  A grid of one tile needs no exchange.

Tiles are packed, a row for each, and dealt to blocks of neighbouring tiles of at most
BLOCK_BYTES.  A task settles one block, whose tiles exchange their outermost cells in
memory; only the blocks' outermost cells go through Spark, so rounds grow with the blocks
that a flow path crosses.  Memory is bounded by the block, and the exchanged
data by the blocks' perimeters.

Kernels see dense arrays with NaN for NULL, so they are NumPy code without
loops over cells: `sweep` evaluates a flow graph front by front.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, functions as F

from ..functions.grid import STEPS, GridMeta

TILE = 512
#: Bytes of the inputs and results of a block's tiles.
BLOCK_BYTES = 256 << 20
#: Rows of a checkpointed table that Spark may broadcast if it finds the files small.
BROADCAST_ROWS = 100_000
UNSETTLED = "tiles did not settle"
Kernel = Callable[["Patch"], dict[str, np.ndarray]]


def checkpointed(df: DataFrame, rows_a_file: int = 0) -> DataFrame:
    """df written as Parquet to the shared checkpoint folder and read back, with its lineage cut.

    A written table knows its size.  checkpoint() would keep the plan's estimate, and in a
    loop of joins estimates multiply until planning alone takes minutes.  Files shrink
    repeated values and NULLs, so where the rows are too many to broadcast, joins are told to sort.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="rillflow-checkpoint-")
        sc.setCheckpointDir(folder)
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    return out.hint("merge") if seen.get["rows"] > BROADCAST_ROWS else out


@dataclass
class Patch:
    """One tile with its rim: arrays of (h + 2, w + 2) cells."""

    meta: GridMeta
    row0: int  # of the first cell inside
    col0: int
    h: int
    w: int
    values: dict[str, np.ndarray]
    exists: np.ndarray
    rim: dict[str, np.ndarray] = field(default_factory=dict)  # exchanged values, NaN where unknown; rows of rims
    rims: np.ndarray | None = None
    memo: dict = field(default_factory=dict)  # what a kernel keeps for its next run on the tile

    def __post_init__(self) -> None:
        self.width = self.w + 2
        self.offsets = [dr * self.width + dc for dr, dc in STEPS]
        inside = np.zeros((self.h + 2, self.width), bool)
        inside[1:-1, 1:-1] = True
        self.inside = inside.ravel() & self.exists
        dx, dy = self.meta.row_sizes(self.row0 - 1, self.h + 2)
        self.dx, self.dy = np.repeat(dx, self.width), np.repeat(dy, self.width)

    def __getitem__(self, name: str) -> np.ndarray:
        return self.values[name]

    def shifted(self, a: np.ndarray, k: int, fill: float = np.nan) -> np.ndarray:
        """For every cell a of its neighbour in direction k (1 to 8); fill outside the patch."""
        dr, dc = STEPS[k - 1]
        grid = a.reshape(self.h + 2, self.width)
        out = np.full(grid.shape, fill, a.dtype if a.dtype != np.int64 else np.int64)
        out[max(0, -dr) : grid.shape[0] - max(0, dr), max(0, -dc) : grid.shape[1] - max(0, dc)] = grid[max(0, dr) : grid.shape[0] + min(0, dr), max(0, dc) : grid.shape[1] + min(0, dc)]
        return out.ravel()

    def length(self, k: int) -> np.ndarray:
        """Length of a step in direction k from every cell."""
        return self.dx if k in (1, 5) else self.dy if k in (3, 7) else np.hypot(self.dx, self.dy)

    def lengths(self, at: np.ndarray) -> np.ndarray:
        """Length of a step in each direction from cells at, a row for each."""
        dx, dy = self.dx[at], self.dy[at]
        d = np.hypot(dx, dy)
        return np.stack([dx, d, dy, d, dx, d, dy, d])

    def bare(self, name: str) -> np.ndarray:
        """Cells with a neighbour outside the grid or NULL in name."""
        valid = self.exists & ~np.isnan(self.values[name])
        out = np.zeros(len(valid), bool)
        for k in range(1, 9):
            out |= ~self.shifted(valid, k, False)
        return out

    def blank(self) -> np.ndarray:
        return np.full(len(self.exists), np.nan)


class Near(list):
    """(source, weight) in each of the eight directions of a front's cells; j and w hold them as arrays of eight rows."""

    def __init__(self, j: np.ndarray, w: np.ndarray):
        super().__init__(zip(j, w))
        self.j, self.w = j, w


def sweep(patch: Patch, sources: np.ndarray, take: np.ndarray, known: np.ndarray, step: Callable[[np.ndarray, Near], None]) -> None:
    """Calls step(cells, near) for cells whose sources are all known, front by front.

    sources[k]: weight that the neighbour in direction k + 1 has for a cell, 0 for none.
    take: cells inside to evaluate; known: cells that wait for nothing, with those on the rim whose values are there.
    The patch keeps what is known, so a later call goes on from the cells that are known since.
    """
    offsets = np.array(patch.offsets)[:, None]
    n, memo = len(take), patch.memo
    needs = (sources > 0) & take
    flat, rows = needs.ravel(), np.arange(8)[:, None] * n

    def freed(cells: np.ndarray) -> np.ndarray:
        """Cells that waited only for cells, each once."""
        to = cells - offsets
        if not memo["inside"][cells[0]]:  # the rim: a step may leave the array
            to = np.where((to < 0) | (to >= n), cells, to)
        to = to[flat[rows + to]]
        np.subtract.at(wait, to, 1)
        to = np.sort(to[wait[to] == 0])
        return to[np.concatenate(([True], to[1:] != to[:-1]))] if len(to) > 1 else to

    if "wait" not in memo:
        wait = np.zeros(n, np.int8)
        for k, off in enumerate(patch.offsets):
            at = np.flatnonzero(needs[k])
            wait[at] += ~known[at + off]
        memo.update(wait=wait, known=known.copy(), inside=patch.inside)
        front = np.flatnonzero(take & (wait == 0) & ~known)
    else:
        wait = memo["wait"]
        fresh = np.flatnonzero(known & ~memo["known"] & ~patch.inside)
        memo["known"][fresh] = True
        front = freed(fresh) if len(fresh) else fresh
    while len(front):
        step(front, Near(front + offsets, sources[:, front]))
        memo["known"][front] = True
        front = freed(front)


def _packed(a: np.ndarray) -> bytes:
    """Bytes of a as floats of 32 bits if they are the same, else of 64."""
    with np.errstate(over="ignore", invalid="ignore"):
        small = a.astype("f4")
    return (small if np.array_equal(small, a, equal_nan=True) else a).tobytes()


def _unpacked(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, "f4" if len(b) == 4 * n else "f8").astype(float)


@dataclass(frozen=True)
class Deal:
    """How a grid is dealt to tiles and blocks of down by across tiles; both are numbered row by row."""

    meta: GridMeta
    shape: tuple[int, int]  # rows and columns of a tile
    down: int = 1
    across: int = 1

    @property
    def tiles(self) -> tuple[int, int]:
        return -(-self.meta.nrows // self.shape[0]), -(-self.meta.ncols // self.shape[1])

    @property
    def blocks(self) -> tuple[int, int]:
        return -(-self.tiles[0] // self.down), -(-self.tiles[1] // self.across)

    def block_shape(self) -> tuple[int, int]:
        return self.shape[0] * self.down, self.shape[1] * self.across

    def rect(self, number: int, shape: tuple[int, int] | None = None, wide: int | None = None) -> tuple[int, int, int, int]:
        """First row and column, rows and columns of a tile (or of a block)."""
        (h, w), wide = shape or self.shape, wide or self.tiles[1]
        row0, col0 = number // wide * h, number % wide * w
        return row0, col0, min(h, self.meta.nrows - row0), min(w, self.meta.ncols - col0)

    def patch(self, t: int, values: dict[str, np.ndarray], exists: np.ndarray, exchanged: list[str]) -> Patch:
        out = Patch(self.meta, *self.rect(t), values, exists)
        if exchanged:
            out.rims = np.full((len(exchanged), len(exists)), np.nan)
            out.rim = dict(zip(exchanged, out.rims))
        return out


class Block:
    """Tiles of one block, each with its packed inputs, its rim, and what its kernel keeps and found."""

    def __init__(self, deal: Deal, number: int, rows: pd.DataFrame, names: list[str], exchanged: list[str]):
        self.deal, self.exchanged, self.names = deal, exchanged, names
        self.row0, self.col0, self.h, self.w = deal.rect(number, deal.block_shape(), deal.blocks[1])
        self.inputs = {int(r.t): r for r in rows.itertuples(index=False)}
        self.kept: dict[int, tuple[np.ndarray, dict]] = {}  # rims and memo of a tile
        self.found: dict[int, dict[str, np.ndarray]] = {}
        for t in self.inputs:
            _, _, h, w = deal.rect(t)
            self.kept[t] = np.full((len(exchanged), (h + 2) * (w + 2)), np.nan), {}

    def open(self, t: int) -> Patch:
        row, (row0, col0, h, w) = self.inputs[t], self.deal.rect(t)
        n = (h + 2) * (w + 2)
        values = {c: _unpacked(getattr(row, c), n) for c in self.names}
        out = Patch(self.deal.meta, row0, col0, h, w, values, np.unpackbits(np.frombuffer(row.exists__, np.uint8), count=n).astype(bool))
        out.rims, out.memo = self.kept[t]
        out.rim = dict(zip(self.exchanged, out.rims))
        return out

    def around(self, rim: pd.DataFrame) -> None:
        """Puts cells beyond the block (row, col, exchanged) on the rims of its tiles."""
        r, c = rim["row"].to_numpy(), rim["col"].to_numpy()
        values = [rim[n].to_numpy(dtype=float, na_value=np.nan) for n in self.exchanged]
        for t, (rims, _) in self.kept.items():
            row0, col0, h, w = self.deal.rect(t)
            if row0 > self.row0 and col0 > self.col0 and row0 + h < self.row0 + self.h and col0 + w < self.col0 + self.w:
                continue
            on = np.flatnonzero((r >= row0 - 1) & (r <= row0 + h) & (c >= col0 - 1) & (c <= col0 + w))
            at = (r[on] - row0 + 1) * (w + 2) + c[on] - col0 + 1
            for i, v in enumerate(values):
                rims[i][at] = v[on]

    def give(self, t: int) -> list[int]:
        """Tells the outermost cells of a tile to its neighbours in the block; which of them did not know them."""
        (row0, col0, h, w), wide = self.deal.rect(t), self.deal.tiles[1]
        mine, out = [self.found[t][n].reshape(h + 2, w + 2) for n in self.exchanged], []
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                to = t + dy * wide + dx
                if not (dy or dx) or to not in self.inputs or not 0 <= t % wide + dx < wide:
                    continue
                r0, c0, th, tw = self.deal.rect(to)
                top, low, left, right = max(row0, r0 - 1), min(row0 + h, r0 + th + 1), max(col0, c0 - 1), min(col0 + w, c0 + tw + 1)
                theirs = self.kept[to][0].reshape(-1, th + 2, tw + 2)[:, top - r0 + 1 : low - r0 + 1, left - c0 + 1 : right - c0 + 1]
                new = np.stack([a[top - row0 + 1 : low - row0 + 1, left - col0 + 1 : right - col0 + 1] for a in mine])
                if not np.array_equal(new, theirs, equal_nan=True):
                    theirs[:] = new
                    out.append(to)
        return out

    def settle(self, kernel: Kernel, rounds: int) -> None:
        """Runs the tiles, forth and back in turn, until no rim changes."""
        due = set(self.inputs)
        for i in range(rounds):
            later: set[int] = set()
            order = sorted(due, reverse=i % 2 == 1)
            waiting = set(order)
            for t in order:
                waiting.discard(t)
                later.discard(t)
                self.found[t] = kernel(self.open(t))
                later.update(x for x in self.give(t) if x not in waiting)
            if not later:
                return
            due = later
        raise RuntimeError(f"{UNSETTLED} in {rounds} rounds")

    def cells(self, names: list[str], ring: bool) -> pd.DataFrame:
        """row, col and names of all cells, or of the block's outermost ones whose first exchanged value is known."""
        parts = []
        for t, found in self.found.items():
            row0, col0, h, w = self.deal.rect(t)
            n = (h + 2) * (w + 2)
            keep = np.unpackbits(np.frombuffer(self.inputs[t].exists__, np.uint8), count=n).astype(bool).reshape(h + 2, w + 2)
            keep[[0, -1], :] = False
            keep[:, [0, -1]] = False
            if ring:
                inner = np.zeros_like(keep)
                r, c = self.row0 + 1 - row0, self.col0 + 1 - col0  # of the first cell that is not in the ring
                inner[max(0, r + 1) : max(0, r + self.h - 1), max(0, c + 1) : max(0, c + self.w - 1)] = True
                keep &= ~inner & ~np.isnan(found[self.exchanged[0]]).reshape(keep.shape)
            at = np.flatnonzero(keep)
            parts.append((at // (w + 2) + row0 - 1, at % (w + 2) + col0 - 1, *(found[o][at] for o in names)))
        row, col, *values = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0)] * (2 + len(names))
        return pd.DataFrame({"row": row.astype(np.int32), "col": col.astype(np.int32)} | dict(zip(names, values)))


def shape_of(size: int, meta: GridMeta) -> tuple[int, int]:
    """Rows and columns of a tile of at most size by size cells: taller where the grid is narrow."""
    width = max(1, min(size, meta.ncols))
    return max(size, size * size // width), width


def _touched(size: tuple[int, int], meta: GridMeta) -> F.Column:
    """Tiles (ty, tx) that hold a cell inside or on their rim."""

    def span(c: str, step: int, last: int) -> F.Column:
        lo, hi = F.greatest(F.floor((F.col(c) - 1) / step), F.lit(0)), F.least(F.floor((F.col(c) + 1) / step), F.lit(last))
        return F.sequence(lo.cast("int"), hi.cast("int"))

    rows, cols = span("row", size[0], (meta.nrows - 1) // size[0]), span("col", size[1], (meta.ncols - 1) // size[1])
    return F.flatten(F.transform(rows, lambda y: F.transform(cols, lambda x: F.struct(y.alias("ty"), x.alias("tx")))))


def _nullable(df: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """df with NULL for NaN."""
    for n in names:
        gaps = np.isnan(df[n].to_numpy())
        if gaps.any():
            df[n] = pd.arrays.FloatingArray(df[n].to_numpy(), gaps)
    return df


def _pack(deal: Deal, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs rows (s, t, row, col, names) that come in the order of t, a row for each tile."""

    def start(s: int, t: int) -> tuple:
        row0, col0, h, w = deal.rect(t)
        n = (h + 2) * (w + 2)
        return s, t, np.zeros(n, bool), [np.full(n, np.nan) for _ in names]

    def whole(now: tuple) -> pa.RecordBatch:
        s, t, exists, values = now
        columns = [pa.array([s], pa.int64()), pa.array([t], pa.int64()), pa.array([np.packbits(exists).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array([_packed(v)], pa.binary()) for v in values)], names=["s", "t", "exists__", *names])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            s, t, row, col = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("s", "t", "row", "col"))
            values = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            cuts = [0, *(np.flatnonzero(np.diff(t)) + 1).tolist(), len(t)]
            for a, b in zip(cuts, cuts[1:]):
                if now is None or now[1] != t[a]:
                    if now is not None:
                        yield whole(now)
                    now = start(int(s[a]), int(t[a]))
                row0, col0, h, w = deal.rect(now[1])
                at = (row[a:b] - row0 + 1) * (w + 2) + col[a:b] - col0 + 1
                now[2][at] = True
                for mine, v in zip(now[3], values):
                    mine[at] = v[a:b]
        if now is not None:
            yield whole(now)

    return pack


def solve(cells: DataFrame, meta: GridMeta, kernel: Kernel, outputs: list[str], exchanged: list[str] | None = None, size: int = TILE, rounds: int = 10_000, summary: tuple[Callable[[Patch, dict[str, np.ndarray]], dict[str, float]], list[str]] | None = None) -> DataFrame:
    """row, col and outputs (doubles) of every cell, by kernel over tiles of cells (row, col, inputs).

    exchanged: the outputs that a kernel reads from the rim (patch.rim); its result
    for a cell must settle as the rim becomes known.  A kernel that exchanges may write into
    patch.rim and keep things in patch.memo for its next run on the tile.
    summary: (f, names) gives instead one row for each tile, of the values names that f returns for a settled patch and what was found.
    """
    names = [c for c in cells.columns if c not in ("row", "col")]
    exchanged = exchanged or []
    deal = Deal(meta, shape_of(size, meta))
    if exchanged:
        most = max(1, BLOCK_BYTES // (8 * math.prod(deal.shape) * (len(names) + 2 * len(exchanged) + 4)))
        across = min(deal.tiles[1], max(1, math.isqrt(most)))
        down = min(deal.tiles[0], max(1, most // across))
        deal = Deal(meta, deal.shape, down, min(deal.tiles[1], max(1, most // down)))
    wide, blocks_wide = deal.tiles[1], deal.blocks[1]
    tile = lambda y, x: (y * wide + x).cast("long")
    block = lambda y, x: (F.floor(y / deal.down) * blocks_wide + F.floor(x / deal.across)).cast("long")
    columns = [F.col(n).cast("double").alias(n) for n in names]
    tiled = cells.select("row", "col", *columns).withColumn("tile", F.explode(_touched(deal.shape, meta))).select(block(F.col("tile.ty"), F.col("tile.tx")).alias("s"), tile(F.col("tile.ty"), F.col("tile.tx")).alias("t"), "row", "col", *names)
    schema = ", ".join(f"{o} double" for o in summary[1]) if summary else "row int, col int, " + ", ".join(f"{o} double" for o in outputs)

    if not exchanged:

        def alone(rows: pd.DataFrame) -> pd.DataFrame:
            t = int(rows["t"].iloc[0])
            row0, col0, h, w = deal.rect(t)
            at = (rows["row"].to_numpy() - row0 + 1) * (w + 2) + rows["col"].to_numpy() - col0 + 1
            exists = np.zeros((h + 2) * (w + 2), bool)
            exists[at] = True
            values = {n: np.full(len(exists), np.nan) for n in names}
            for n in names:
                values[n][at] = rows[n].to_numpy(dtype=float, na_value=np.nan)
            patch = deal.patch(t, values, exists, [])
            found = kernel(patch)
            at = np.flatnonzero(patch.inside)
            out = pd.DataFrame({"row": at // patch.width + patch.row0 - 1, "col": at % patch.width + patch.col0 - 1} | {o: found[o][at] for o in outputs})
            return _nullable(out, outputs)

        return tiled.groupBy("t").applyInPandas(alone, schema)

    def run(s: int, rows: pd.DataFrame, rim: pd.DataFrame | None) -> Block:
        out = Block(deal, s, rows, names, exchanged)
        if rim is not None and len(rim):
            out.around(rim)
        out.settle(kernel, rounds)
        return out

    def result(s: int, rows: pd.DataFrame, rim: pd.DataFrame | None) -> pd.DataFrame:
        if not len(rows):
            return _nullable(pd.DataFrame({c: [] for c in (summary[1] if summary else ["row", "col", *outputs])}), [])
        solved = run(s, rows, rim)
        if summary:
            return pd.DataFrame([summary[0](solved.open(t), solved.found[t]) for t in solved.inputs], columns=summary[1])
        return _nullable(solved.cells(outputs, False), outputs)

    packed_schema = "s long, t long, exists__ binary, " + ", ".join(f"{n} binary" for n in names)
    packed = tiled.repartition("t").sortWithinPartitions("t").mapInArrow(_pack(deal, names), packed_schema)
    count = math.prod(deal.blocks)
    dealt = lambda df, n: df.repartition(min(2 * n, 1000), "s").groupBy("s")
    try:
        if count == 1:
            whole = packed.groupBy("s").applyInPandas(lambda key, rows: result(key[0], rows, None), schema)
            return whole if deal.tiles == (1, 1) else checkpointed(whole)

        # a scan reads many rows of a file at once, so a file holds few large tiles
        packed = checkpointed(packed, max(1, (1 << 20) // math.prod(deal.shape)))
        values = ", ".join(f"{o} double" for o in exchanged)
        edge_schema = f"s long, row int, col int, changed boolean, {values}"

        def ring(s: int, rows: pd.DataFrame, rim: pd.DataFrame | None) -> pd.DataFrame:
            own = rim["owner"] == s if rim is not None else None
            new = run(s, rows, rim[~own] if rim is not None else None).cells(exchanged, True) if len(rows) else pd.DataFrame({c: [] for c in ("row", "col", *exchanged)})
            changed = np.ones(len(new), bool)
            if rim is not None:
                old = new[["row", "col"]].merge(rim.loc[own, ["row", "col", *exchanged]], "left", ["row", "col"])
                changed = ~np.logical_and.reduce([(old[n].to_numpy(float, na_value=np.nan) == new[n].to_numpy()) | (old[n].isna().to_numpy() & new[n].isna().to_numpy()) for n in exchanged])
            new.insert(0, "s", s)
            new.insert(3, "changed", changed)
            return _nullable(new, exchanged)

        edges = checkpointed(dealt(packed, count).applyInPandas(lambda key, rows: ring(key[0], rows, None), edge_schema))
        for _ in range(rounds):
            to = F.explode(F.transform(_touched(deal.block_shape(), meta), lambda b: (b["ty"] * blocks_wide + b["tx"]).cast("long")))
            some = [r["to"] for r in edges.where("changed").select("s", to.alias("to")).where("to <> s").select("to").distinct().collect()]  # numbers of blocks
            rim = edges.select(F.col("s").alias("owner"), "row", "col", *exchanged, to.alias("s"))
            if not some:
                break
            pick = lambda df: df.where(F.col("s").isin(some))
            again = dealt(pick(packed), len(some)).cogroup(dealt(pick(rim), len(some))).applyInPandas(lambda key, rows, r: ring(key[0], rows, r), edge_schema)
            edges = checkpointed(edges.where(~F.col("s").isin(some)).withColumn("changed", F.lit(False)).unionByName(again))
        else:
            raise RuntimeError(f"{UNSETTLED} in {rounds} rounds")
        rim = rim.where("owner <> s")
        return dealt(packed, count).cogroup(dealt(rim, count)).applyInPandas(lambda key, rows, r: result(key[0], rows, r), schema)
    except (PySparkException, Py4JJavaError) as e:
        if UNSETTLED in str(e):
            raise RuntimeError(f"{UNSETTLED} in {rounds} rounds") from e
        raise
