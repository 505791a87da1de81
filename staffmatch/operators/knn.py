"""Top-k similarity join: for every requirement the k employees with the largest inner product.

No pair is ever materialised as a row. Vectors are compared block against block inside Arrow tasks
and a task gives out at most k rows per requirement and segment of its items; a window then keeps k per requirement (its
partial limit runs before the shuffle). Blocks are multiplied in single precision with a bound on the error; only what may be
among the k best is computed in double precision. Copies of a vector within a segment are compared once.

Three physical plans, chosen by the counted size of the requirement side:

* ``broadcast`` - the requirement matrix fits the byte bound: it is broadcast and the employee vectors are scanned. Where
  there are many requirements the vectors are first written down, once, in a file per core, and each file is compared with
  one part of the requirements per task, so that a task has a bounded number of pairs however many there are in all.
* ``blocks`` - it does not fit: the requirements are cut into blocks that do. The employee vectors are written down once;
  a scan of them takes many small blocks, and its k best are written down before the next scan.
* ``grid`` - on request; both sides are cut into bounded stripes of blocks by a hash of their ids and every stripe pair meets
  in one co-grouped task. Stripes are sized from counts per cell, so a cell (or a requirement set)
  holding a large part of all rows is spread over many tasks.

With ``cells`` the requirement carries the array of cells it probes and the employee its own cell;
only equal cells meet (inverted-file search). Without, everything is one cell (exact search).

Large item sides are pre-scanned on a hash sample: the k-th similarity inside the sample is a lower
bound of the true k-th similarity, so rows below it can be left out early without changing results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import SIMILARITY_DIGITS
from ..sources.tables import work_folder

_OUT = "requirement_id string, employee_id string, similarity double"
_GRID = 10.0**SIMILARITY_DIGITS
_SEGMENT_VALUES = 16_000_000  # vector components of the items that a task holds at once (64 MB as floats)
_PRODUCT_VALUES = 1 << 21  # similarities held at once (8 MB as floats)
_QUERY_ROWS = 1024  # requirements compared at once
_EXACT_ROWS = 1 << 12  # similarities computed again in double precision at once
_HEAD_SHARE = 4  # of so many turned directions one is in the first, cheap product
_HEAD_LEAST, _HEAD_MOST = 128, 2048  # dimensions of vectors that are turned
_HEAD_VALUES = 1 << 18  # shorter products computed at once (1 MB as floats, so that a core's cache holds them)
_HEAD_TRIAL = 1 << 24  # pairs after which the shorter product is given up where it has left out too little
_HEAD_SAMPLE = 4096  # vectors of a side that the directions are taken from
_PAIR_COST = 16  # products in a block that take as long as one similarity computed by itself
_NOWHERE = np.iinfo(np.int64).max
_TASK_PAIRS = 1 << 32  # pairs that a task of the broadcast plan compares at the most, about
_MOST_PARTS = 256  # parts of the requirements in one plan
_LEAST_SCANS = 8  # scans of the items that many small requirement blocks are dealt to
_NOBODY = np.zeros(0, dtype=np.int64)


@dataclass(frozen=True)
class KnnOptions:
    plan: str = "auto"  # auto (broadcast, or blocks beyond the bound) | broadcast | blocks | grid
    broadcast_bytes: int = 128 * 1024 * 1024  # most bytes of requirement vectors that are ever broadcast
    scan_bytes: int = 128 * 1024 * 1024  # most bytes of requirement vectors that one scan of the items takes
    block_rows: int | None = None  # item rows compared at once in the grid; default from the number of requirements
    spread_min_queries: int = 256  # from so many requirements on the items are written down in a file per core
    seed_fraction: float | None = None  # share of items in the pre-scan; None: 1 % for a large known item count
    seed_min_items: int = 5_000_000  # the pre-scan reads the items once more, so both sides must be large
    seed_min_queries: int = 256


# ---- inside tasks --------------------------------------------------------------------------

def _matrix(column: pa.ChunkedArray | pa.Array, dim: int | None, keep_type: bool = False) -> np.ndarray:
    """List column as a (rows, dim) matrix, doubles unless the type is kept; unequal or unexpected lengths are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    rows = len(column)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if rows == 0:
        return np.zeros((0, dim or 0))
    width = int(lengths[0]) if dim is None else dim
    if not (lengths == width).all():
        found = sorted({int(x) for x in np.unique(lengths) if x != width})
        raise ValueError(f"vector dimension must be {width}, found {found}")
    return np.asarray(column.flatten(), dtype=None if keep_type else np.float64).reshape(rows, width)


class _Side:
    """Requirements of a task: ids, vectors, floors, and the positions that probe each cell (None: no cells)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray, probes: dict[int, np.ndarray] | None):
        self.ids, self.vectors, self.floor, self.probes = pa.array(ids, type=pa.string()), vectors, np.array(floor, dtype=np.float64), probes

    def part(self, cell: int | None, start: int, end: int) -> np.ndarray:
        """Positions from ``start`` to ``end`` that search the cell, counted from ``start``."""
        if cell is None:
            return np.arange(end - start)
        wanted = self.probes.get(cell, _NOBODY)
        return wanted[np.searchsorted(wanted, start):np.searchsorted(wanted, end)] - start


class _Items:
    """Items of one cell in ascending order of ids, copies of a vector kept once with the places of their rows."""

    def __init__(self, cell: int | None, places: np.ndarray, vectors: np.ndarray):
        self.cell = cell
        rows = np.ascontiguousarray(vectors).view(np.uint8).reshape(len(vectors), -1)
        words = rows.view(np.uint32) if rows.shape[1] % 4 == 0 else rows
        odd = np.random.default_rng(1).integers(0, 1 << 62, words.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        code = np.zeros(len(rows), dtype=np.uint64)
        for j in range(words.shape[1]):  # one column at a time: no second matrix of 64-bit words
            code += words[:, j] * odd[j]
            code ^= code >> np.uint64(29)
        order = np.argsort(code, kind="stable")
        fresh = np.ones(len(rows), dtype=bool)
        fresh[1:] = code[order[1:]] != code[order[:-1]]
        same = np.flatnonzero(~fresh)
        fresh[same] = (rows[order[same]] != rows[order[same - 1]]).any(axis=1)
        starts = np.flatnonzero(fresh)
        by_first = np.argsort(order[starts], kind="stable")  # vectors in the order of their first rows
        self.counts = np.diff(np.append(starts, len(rows)))[by_first]
        self.starts = starts[by_first]
        self.copies = places[order]
        first = order[self.starts]
        self.first = places[first]
        self.vectors = vectors[first]

    def ordered(self, score: np.ndarray) -> None:
        """Puts the vectors with the largest scores first; what is found does not depend on their order."""
        order = np.argsort(-score, kind="stable")
        self.counts, self.starts, self.first, self.vectors = (x[order] for x in (self.counts, self.starts, self.first, self.vectors))


def _margin(queries: np.ndarray, items: np.ndarray) -> np.ndarray | None:
    """Bound per query on the error of a product in single precision; None where single precision cannot hold it."""
    with np.errstate(all="ignore"):
        q = np.sqrt(np.einsum("ij,ij->i", queries, queries, dtype=np.float64))
        v = np.sqrt(np.einsum("ij,ij->i", items, items, dtype=np.float64).max(initial=0.0))
        bound = q * v
    if not np.isfinite(bound).all() or bound.max(initial=0.0) > 1e30:
        return None
    return bound * (queries.shape[1] + 8) * 2.0**-23 + 2.0 / _GRID


def _directions(queries: np.ndarray, groups: list[_Items]) -> np.ndarray | None:
    """Orthonormal directions in which these requirements and items are long, as columns; None where turning the vectors
    would not pay. Any orthonormal ones give right results, these leave the least for the bound of ``_turned``."""
    dim, n = queries.shape[1], sum(len(g.vectors) for g in groups)
    if not _HEAD_LEAST <= dim <= _HEAD_MOST or len(queries) < 2 * dim or n * len(queries) < 128 * dim * dim:
        return None
    held = 0.0
    for vectors in (queries, *(g.vectors for g in groups)):
        step = -(-(n if vectors is not queries else len(queries)) // _HEAD_SAMPLE)
        some = vectors[::step].astype(np.float64)
        with np.errstate(all="ignore"):
            share = (len(vectors) / n if vectors is not queries else 1.0) / (some * some).sum()
            held = held + (some.T @ some) * share if np.isfinite(share) else held
    if np.shape(held) != (dim, dim) or not np.isfinite(held).all():
        return None
    return np.linalg.eigh(held)[1][:, ::-1][:, :dim // _HEAD_SHARE]


def _turned(vectors: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The components along the directions, and a bound on the length of the rest: the product of two such rows is not below
    the inner product of their vectors, but for what single precision takes away, which ``_margin`` covers."""
    out = np.empty((len(vectors), directions.shape[1] + 1), dtype=np.float32)
    for i in range(0, len(vectors), _EXACT_ROWS):
        part = vectors[i:i + _EXACT_ROWS].astype(np.float64)
        head = part @ directions
        length = np.einsum("ij,ij->i", part, part)
        rest = np.maximum(length - np.einsum("ij,ij->i", head, head), 0.0) + length * 1e-12  # above any rounding here
        out[i:i + _EXACT_ROWS, :-1], out[i:i + _EXACT_ROWS, -1] = head, np.sqrt(rest)
    return out


class _Gain:
    """Whether the shorter product has left out enough of the pairs it was asked about."""

    def __init__(self):
        self.pairs, self.cost, self.pays = 0, 0, True

    def count(self, pairs: int, cost: int) -> None:
        self.pairs, self.cost = self.pairs + pairs, self.cost + cost
        self.pays = self.pairs < _HEAD_TRIAL or 2 * self.cost < self.pairs


@dataclass
class _Head:
    """Turned requirements and items of a comparison."""

    queries: np.ndarray
    items: np.ndarray
    gain: _Gain


class _Best:
    """The k best vectors per query: similarities on the grid, equal ones by the place of their first row."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor, self.k = floor, k
        self.sims = np.full((len(floor), k), -np.inf)
        self.place = np.full((len(floor), k), _NOWHERE)
        self.group, self.at = np.zeros((2, len(floor), k), dtype=np.int32)

    def least(self) -> np.ndarray:
        return np.maximum(self.floor, self.sims.min(axis=1))

    def add(self, rows: np.ndarray, sims: np.ndarray, place: np.ndarray, group: int, at: np.ndarray) -> None:
        kept = sims >= self.least()[rows]
        order = np.flatnonzero(kept)
        order = order[np.argsort(rows[order], kind="stable")]
        if not len(order):
            return
        touched, first, counts = np.unique(rows[order], return_index=True, return_counts=True)
        shape = (len(touched), int(counts.max()))
        to = (np.repeat(np.arange(len(touched)), counts), np.arange(len(order)) - np.repeat(first, counts))

        def joined(held, fresh, empty):
            more = np.full(shape, empty, dtype=held.dtype)
            more[to] = fresh
            return np.concatenate([held[touched], more], axis=1)

        all_sims, all_place = joined(self.sims, sims[order], -np.inf), joined(self.place, place[order], _NOWHERE)
        top = np.argpartition(-all_sims, self.k - 1, axis=1)[:, :self.k]
        values = np.take_along_axis(all_sims, top, axis=1)
        kth = values.min(axis=1)
        tied = ((all_sims == kth[:, None]).sum(axis=1) > (values == kth[:, None]).sum(axis=1)) & np.isfinite(kth)
        if tied.any():
            top[tied] = np.lexsort((all_place[tied], -all_sims[tied]), axis=1)[:, :self.k]
        self.sims[touched], self.place[touched] = np.take_along_axis(all_sims, top, axis=1), np.take_along_axis(all_place, top, axis=1)
        self.group[touched] = np.take_along_axis(joined(self.group, group, 0), top, axis=1)
        self.at[touched] = np.take_along_axis(joined(self.at, at[order], 0), top, axis=1)


def _raised(top: np.ndarray, row: np.ndarray, sims: np.ndarray, k: int) -> None:
    """Enters similarities, by row and in no order, into the k largest per row. A row with very many is cut to its own k
    largest first, so that one row never widens all."""
    order = np.argsort(row.astype(np.uint16) if len(top) <= 1 << 16 else row, kind="stable")
    touched, first, counts = np.unique(row[order], return_index=True, return_counts=True)
    slot = np.arange(len(order)) - np.repeat(first, counts)
    values, near = sims[order], slot < 8 * k
    for i in np.flatnonzero(counts > 8 * k):
        part = slice(first[i], first[i] + counts[i])
        values[part] = -np.partition(-values[part], k - 1)
    fresh = np.full((len(touched), k + int(min(counts.max(), 8 * k))), -np.inf, dtype=top.dtype)
    fresh[:, :k] = top[touched]
    fresh[np.repeat(np.arange(len(touched)), counts)[near], k + slot[near]] = values[near]
    top[touched] = np.partition(fresh, fresh.shape[1] - k, axis=1)[:, -k:]


def _hits(sims: np.ndarray, bound: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Flat positions of the similarities from the bound of their row up; ``mask`` is room for one byte each."""
    size = -(-sims.size // 8) * 8
    mask[sims.size:size] = False
    np.greater_equal(sims, bound[:, None], out=mask[:sims.size].reshape(sims.shape))
    eights = np.flatnonzero(mask[:size].view(np.uint64) != 0)  # most are empty, and eight flags are looked at in one
    which, bit = np.nonzero(mask[:size].reshape(-1, 8)[eights])
    return eights[which] * 8 + bit


def _pairs_of(queries: np.ndarray, vectors: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The inner products of these pairs."""
    out = np.empty(len(row), dtype=queries.dtype)
    for i in range(0, len(row), _EXACT_ROWS):
        part = slice(i, i + _EXACT_ROWS)
        out[part] = np.einsum("ij,ij->i", queries[row[part]], vectors[at[part]].astype(queries.dtype, copy=False))
    return out


def _compare(best: _Best, rows: np.ndarray, queries: np.ndarray, items: _Items, number: int, most_columns: int,
             head: _Head | None = None) -> None:
    """Enters the vectors of a cell into ``best``. A product in single precision, whose error is bounded, leaves out what
    lies below the k-th similarity so far, itself known in single precision; the rest is computed again in double precision,
    once, at the end, or sooner where much of it cannot be told apart. With a ``head`` the
    shorter product of turned vectors, a bound from above, comes first, as long as it leaves out enough."""
    margin = _margin(queries, items.vectors)
    kind = np.float64 if margin is None else np.float32
    slack = np.full(len(rows), 2.0 / _GRID) if margin is None else margin
    plain, k, n = queries.astype(kind, copy=False), best.k, len(items.vectors)
    head = None if margin is None else head
    columns = min(n, most_columns if head is None else min(most_columns, max(256, _HEAD_VALUES // len(rows))))
    product, mask = np.empty(len(rows) * columns, dtype=kind), np.empty(len(rows) * columns + 8, dtype=bool)
    most_held = max(8 * len(rows) * k, _PRODUCT_VALUES // 4)
    held, fresh, n_held, n_fresh, start = [], [], 0, 0, 0
    pause, failed = 0, 0  # blocks without the shorter product, after it left out too little

    def bounds(least, top):
        # k similarities are known to lie at ``top`` or above, each within its error, and so is what is compared with them
        with np.errstate(invalid="ignore"):
            low = np.maximum(least - slack, top.min(axis=1).astype(np.float64) - 2.0 * slack)
        return np.nextafter(low.astype(kind), kind(-np.inf))

    def restart():
        top = np.nextafter(best.sims[rows].astype(kind), kind(-np.inf))
        least = best.least()[rows]
        return least, top, bounds(least, top)

    def raised():
        _raised(top, np.concatenate([x[0] for x in fresh]), np.concatenate([x[2] for x in fresh]), k)
        return np.maximum(bound, bounds(least, top))

    def enter():
        row, at, sims = (np.concatenate(x) for x in zip(*held))
        kept = sims >= (raised() if fresh and len(held) > 1 else bound)[row]
        row, at = row[kept], at[kept]
        exact = np.empty(len(row))
        for i in range(0, len(row), _EXACT_ROWS):
            part = slice(i, i + _EXACT_ROWS)
            exact[part] = np.einsum("ij,ij->i", queries[row[part]].astype(np.float64), items.vectors[at[part]].astype(np.float64))
        best.add(rows[row], np.floor(exact * _GRID + 0.5) / _GRID, items.first[at], number, at)

    def left():
        nonlocal pause, failed
        width, vectors = end - start, items.vectors[start:end]
        most = np.matmul(head.queries, head.items[start:end].T, out=product[:len(rows) * width].reshape(len(rows), width))
        found = _hits(most, bound, mask)
        row, at = np.divmod(found, width)
        columns = np.flatnonzero(np.bincount(at, minlength=width))
        if _PAIR_COST * len(found) <= len(rows) * len(columns):
            values, cost = _pairs_of(plain, vectors, row, at), _PAIR_COST * len(found)
        elif 4 * len(columns) <= 3 * width:
            sims = np.matmul(plain, vectors[columns].astype(kind, copy=False).T)
            found = _hits(sims, bound, mask)
            row, at = np.divmod(found, len(columns))
            values, at, cost = sims.reshape(-1)[found], columns[at], len(rows) * len(columns)
        else:
            row, values, cost = None, None, len(rows) * width
        failed = failed + 1 if 2 * cost > len(rows) * width else 0
        pause = 1 << min(failed - 4, 6) if failed >= 4 else 0
        head.gain.count(len(rows) * width, cost)
        if row is None:
            return None, None, None
        kept = values >= bound[row]
        return row[kept], at[kept], values[kept]

    least, top, bound = restart()
    while start < n:
        end = min(n, start + columns)
        row, at, values = left() if head is not None and head.gain.pays and pause == 0 and np.isfinite(bound).all() else (None, None, None)
        if row is None:
            pause = max(0, pause - 1)
            sims = product[:len(rows) * (end - start)].reshape(len(rows), end - start)
            np.matmul(plain, items.vectors[start:end].astype(kind, copy=False).T, out=sims)
            if start == 0 and k <= end and not np.isfinite(bound).all():
                first = np.partition(np.where(np.isnan(sims), -np.inf, sims), end - k, axis=1)[:, -k:]
                bound = np.maximum(bound, bounds(least, first))  # what these k are is entered below, with the others
            found = _hits(sims, bound, mask)
            row, at = np.divmod(found, end - start)
            values = sims.reshape(-1)[found]
        if len(row):
            held.append((row, at + start, values))
            fresh.append(held[-1])
            n_held, n_fresh = n_held + len(row), n_fresh + len(row)
        start = end
        if n_fresh >= len(rows) * k and start < n:
            bound, fresh, n_fresh = raised(), [], 0
        if n_held >= most_held and start < n:
            enter()
            held, fresh, n_held, n_fresh = [], [], 0, 0
            least, top, bound = restart()
    if held:
        enter()


def _expanded(best: _Best, groups: list[_Items]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item place, similarity) of the k best rows, where copies of a vector count one by one, and the k-th similarity."""
    counts, starts = np.zeros(best.place.shape, dtype=np.int64), np.zeros(best.place.shape, dtype=np.int64)
    base = np.cumsum([0, *[len(g.copies) for g in groups]])
    for i, items in enumerate(groups):
        here = (best.group == i) & (best.place != _NOWHERE)
        counts[here] = np.minimum(items.counts[best.at[here]], best.k)  # the first k copies by id are enough
        starts[here] = items.starts[best.at[here]] + base[i]
    if (counts > 1).any():
        order = np.argsort(-best.sims, axis=1)
        sims, counts, starts = (np.take_along_axis(x, order, axis=1) for x in (best.sims, counts, starts))
        total = np.cumsum(counts, axis=1)
        least = np.where(total[:, -1] >= best.k, np.take_along_axis(sims, (total < best.k).sum(axis=1).clip(max=best.k - 1)[:, None], axis=1)[:, 0], -np.inf)
        row, slot = np.nonzero((counts > 0) & (sims >= least[:, None]))
        sims, counts, starts = sims[row, slot], counts[row, slot], starts[row, slot]
        copies = np.concatenate([g.copies for g in groups])
        where = np.repeat(starts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        row, sims, place = np.repeat(row, counts), np.repeat(sims, counts), copies[where]
        order = np.lexsort((place, -sims, row))
        row, sims, place = row[order], sims[order], place[order]
        first = np.searchsorted(row, np.arange(len(best.sims)))
        kept = np.arange(len(row)) - first[row] < best.k
        return row[kept], place[kept], sims[kept]
    row, slot = np.nonzero(counts)
    return row, best.place[row, slot], best.sims[row, slot]


def _search(side: _Side, groups: list[_Items], item_ids: pa.Array, k: int, block_rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """The k best of these items per requirement, from its floor up; floors rise to the k-th similarity."""
    columns = block_rows or max(256, _PRODUCT_VALUES // _QUERY_ROWS)
    directions = _directions(side.vectors, groups)
    gain, turned = _Gain(), []
    for items in groups if directions is not None else ():
        items.ordered(items.vectors @ side.vectors.mean(axis=0).astype(items.vectors.dtype))  # k-th similarities rise early
        turned.append(_turned(items.vectors, directions))
    for start in range(0, len(side.ids), _QUERY_ROWS):
        end = min(start + _QUERY_ROWS, len(side.ids))
        best = _Best(side.floor[start:end], k)
        short = _turned(side.vectors[start:end], directions) if turned and gain.pays else None
        for number, items in enumerate(groups):
            rows = side.part(items.cell, start, end)
            if len(rows):
                head = None if short is None else _Head(short[rows], turned[number], gain)
                _compare(best, rows, side.vectors[start + rows], items, number, columns, head)
        row, place, sims = _expanded(best, groups)
        if len(row):
            counts = np.bincount(row, minlength=end - start)
            full = np.flatnonzero(counts >= k)
            least = np.full(end - start, np.inf)
            np.minimum.at(least, row, sims)
            side.floor[start + full] = np.maximum(side.floor[start + full], least[full])
            yield _batch(side.ids[start:end], item_ids, row, place, sims)


def _by_cell(table: pa.Table, dim: int | None, with_cells: bool) -> tuple[pa.Array, list[_Items]]:
    """Item ids in ascending order and their vectors by cell."""
    table = table.take(pc.sort_indices(table.column("employee_id"), null_placement="at_start"))
    vectors, places = _matrix(table.column("vec"), dim, keep_type=True), np.arange(table.num_rows)
    ids = pa.array(_strings(table.column("employee_id")), type=pa.string())
    if not with_cells:
        return ids, [_Items(None, places, vectors)]
    cells = table.column("cell").to_numpy()
    parts = ((int(c), np.flatnonzero(cells == c)) for c in np.unique(cells))
    return ids, [_Items(c, places[p], vectors[p]) for c, p in parts]


def _batch(query_ids: pa.Array, item_ids: pa.Array, rows, cols, sims) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            query_ids.take(pa.array(rows)),
            item_ids.take(pa.array(cols)),
            pa.array(sims, type=pa.float64()),
        ],
        names=["requirement_id", "employee_id", "similarity"],
    )


def _strings(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def _scan_task(shared: list, k: int, dim: int, with_cells: bool):
    """mapInArrow body of the broadcast plan: each block of requirements over the items of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: list[_Side] = []
        most_rows = max(256, _SEGMENT_VALUES // dim)

        def flush(held):
            if not sides:
                sides.extend(_Side(*block.value) for block in shared)
            item_ids, groups = _by_cell(pa.Table.from_batches(held), dim, with_cells)
            for side in sides:
                yield from _search(side, groups, item_ids, k)

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most_rows:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return run


def _grid_task(k: int, block_rows: int | None):
    """Co-group body of the grid plan: one bounded stripe of queries against one of items, block by block."""

    def run(queries: pa.Table, items: pa.Table) -> pa.Table:
        batches = []
        if queries.num_rows and items.num_rows:
            matrix = _matrix(queries.column("vec"), None, keep_type=True)
            item_ids, groups = _by_cell(items, matrix.shape[1], False)
            side = _Side(_strings(queries.column("requirement_id")), matrix, queries.column("floor").to_numpy(), None)
            batches.extend(_search(side, groups, item_ids, k, block_rows))
        schema = pa.schema([("requirement_id", pa.string()), ("employee_id", pa.string()), ("similarity", pa.float64())])
        return pa.Table.from_batches(batches, schema=schema)

    return run


# ---- plans ---------------------------------------------------------------------------------

def keep_top(partial: DataFrame, k: int) -> DataFrame:
    """The k best rows per requirement, numbered by ``candidate_rank``; equal similarities go by employee id."""
    best = W.partitionBy("requirement_id").orderBy(F.col("similarity").desc(), "employee_id")
    return partial.withColumn("candidate_rank", F.row_number().over(best)).where(F.col("candidate_rank") <= k)


def _cell_positions(lists: pa.ChunkedArray) -> dict[int, np.ndarray]:
    """The requirements that probe each cell, from Arrow lists without a Python object per entry."""
    lists = lists.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    position = np.repeat(np.arange(len(lists), dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False))
    cell = lists.flatten().to_numpy()
    order = np.argsort(cell, kind="stable")
    found, starts = np.unique(cell[order], return_index=True)
    return dict(zip(found.tolist(), np.split(position[order], starts[1:])))


def _broadcast_plan(queries, items, k, with_cells, bound: int | None = None, task_rows: int | None = None) -> DataFrame:
    """All of ``queries`` over a scan of ``items``, in broadcasts of at most ``bound`` bytes each. With ``task_rows`` a task
    takes about so many requirements, and ``items``, which must be a written table, is scanned again for the others."""
    spark = queries.sparkSession
    columns = ["requirement_id", "vec", "floor"] + (["cells"] if with_cells else [])
    table = queries.select(*columns).toArrow()  # bounded: the caller has counted the bytes
    if not table.num_rows:
        return spark.createDataFrame([], _OUT)
    matrix = _matrix(table.column("vec"), None, keep_type=True)
    dim, columns = matrix.shape[1], ["employee_id", "vec"] + (["cell"] if with_cells else [])
    rows = table.num_rows if task_rows is None else max(task_rows, -(-table.num_rows // _MOST_PARTS))
    sizes = np.full(table.num_rows, dim * 8 + 8) + pc.fill_null(pc.binary_length(table.column("requirement_id")), 0).to_numpy()
    if with_cells:
        sizes = sizes + table.column("cells").combine_chunks().value_lengths().to_numpy(zero_copy_only=False) * 8
    parts, start = [], 0  # broadcasts, rows and cells of each part
    before = np.concatenate([[0], np.cumsum(sizes)])
    while start < len(sizes):
        end = len(sizes) if bound is None else max(start + 1, int(np.searchsorted(before, before[start] + bound, side="right")) - 1)
        if not parts or parts[-1][1] >= rows:
            parts.append([[], 0, set()])
        end = min(end, start + rows - parts[-1][1])
        part = table.slice(start, end - start)
        probes = _cell_positions(part.column("cells")) if with_cells else None
        parts[-1][0].append(spark.sparkContext.broadcast(
            (_strings(part.column("requirement_id")), matrix[start:end], part.column("floor").to_numpy(), probes)))
        parts[-1][1] += end - start
        parts[-1][2].update(probes or ())
        start = end
    found = None
    for shared, _, everywhere in parts:
        side = items.where(F.col("cell").isin(sorted(everywhere))) if with_cells else items  # prunes cell partitions at the scan
        part = side.select(*columns).mapInArrow(_scan_task(shared, k, dim, with_cells), _OUT)
        found = part if found is None else found.unionByName(part)
    return found


def _query_bytes(dim: int, cells: bool):
    """Bytes of a requirement on the driver and in a broadcast: vector, id, floor, and positions of its cells."""
    fixed = F.lit(dim * 8 + 8) + F.octet_length("requirement_id")
    return fixed + F.size("cells") * 8 if cells else fixed


def _spread_items(items: DataFrame, with_cells: bool) -> DataFrame:
    """The items written once, in as many files as there are cores: what makes them runs once, and the work of comparing,
    which their few bytes do not show, is shared out."""
    spark = items.sparkSession
    rows = items.select("employee_id", "vec", *(["cell"] if with_cells else []))
    target = f"{work_folder(spark)}/items"
    rows.repartition(max(spark.sparkContext.defaultParallelism, 1), "employee_id").write.parquet(target)
    return spark.read.schema(rows.schema).parquet(target)


def _task_rows(queries, items, with_cells: bool, n_queries: int) -> int | None:
    """Requirements per task that keep it to about ``_TASK_PAIRS`` pairs, for items in a file per core; None: all of them."""
    files = max(items.sparkSession.sparkContext.defaultParallelism, 1)
    n_items = items.count()
    pairs = n_items * n_queries
    if pairs > files * _TASK_PAIRS and with_cells:
        probed = queries.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n_queries"))
        held = items.groupBy("cell").agg(F.count("*").alias("n_items"))
        pairs = int(probed.join(held, "cell").agg(F.sum(F.col("n_queries").cast("double") * F.col("n_items"))).first()[0] or 0)
    parts = -(-pairs // (files * _TASK_PAIRS))
    return None if parts <= 1 else max(1, -(-n_queries // parts))


def _blocks_plan(queries, items, k, with_cells, options, dim: int, total: int, search) -> DataFrame:
    """``search`` over blocks of requirements that each fit the bound. A scan of the items takes many small blocks, a
    broadcast each; the results of a scan are written down."""
    spark, folder = queries.sparkSession, work_folder(queries.sparkSession)
    if (queries.agg(F.max(_query_bytes(dim, with_cells))).first()[0] or 0) > options.broadcast_bytes:
        raise ValueError(f"a single requirement of {dim} values exceeds the broadcast bound")
    most_held = max(options.scan_bytes, options.broadcast_bytes)
    scans = max(2, math.ceil(total / most_held * 1.25), min(_LEAST_SCANS, math.ceil(total / options.broadcast_bytes * 1.25)))
    while True:
        number = F.pmod(F.xxhash64("requirement_id"), F.lit(scans))
        sizes = queries.groupBy(number.alias("scan")).agg(F.sum(_query_bytes(dim, with_cells)).alias("bytes")).orderBy("scan").collect()
        if max((r["bytes"] for r in sizes), default=0) <= most_held or scans >= 1 << 20:
            break
        scans *= 2
    found = None
    for scan in (r["scan"] for r in sizes):  # a row per scan; none is empty
        target = f"{folder}/block-{scan}"
        part = search(queries.where(number == scan), items)
        part.write.parquet(target)
        part = spark.read.schema(part.schema).parquet(target)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else keep_top(spark.createDataFrame([], _OUT), k)


def _numbers(count: str) -> F.Column:
    return F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1)


def _with_stripe_counts(queries, items, with_cells: bool, rows: int, least_rows: int, bounded_cells: bool, cell_sizes: DataFrame | None):
    """Both sides with ``cell``, ``item_stripes`` and ``query_stripes``, from the counts per cell, and how many tasks they make.

    A stripe has about ``rows`` rows; the items are cut finer, down to ``least_rows``, where that gives every core work.
    """
    cores = max(queries.sparkSession.sparkContext.defaultParallelism, 1)
    if not with_cells:
        n_items, n_queries = items.count(), queries.count()
        cut = {"item_stripes": max(1, math.ceil(n_items / rows), min(cores, math.ceil(n_items / least_rows))),
               "query_stripes": max(1, math.ceil(n_queries / rows))}
        more = [F.lit(0).alias("cell"), *[F.lit(n).cast("bigint").alias(c) for c, n in cut.items()]]
        return queries.select("*", *more), items.select("*", *more), 3 * max(cores, math.prod(cut.values()))
    queries = queries.withColumn("cell", F.explode("cells"))
    if cell_sizes is None:
        cell_sizes = items.groupBy("cell").agg(F.count("*").alias("n"))
    per_stripe = F.lit(float(rows))
    sizes = (
        cell_sizes.groupBy("cell").agg(F.sum("n").alias("n_items"))
        .join(queries.groupBy("cell").agg(F.count("*").alias("n_queries")), "cell")
        .select(
            "cell",
            F.ceil(F.col("n_items") / per_stripe).cast("bigint").alias("item_stripes"),
            F.ceil(F.col("n_queries") / per_stripe).cast("bigint").alias("query_stripes"),
        )
    )
    target = f"{work_folder(items.sparkSession)}/cells"
    sizes.write.parquet(target)
    sizes = items.sparkSession.read.schema(sizes.schema).parquet(target)
    groups = sizes.agg(F.sum(F.col("item_stripes") * F.col("query_stripes"))).first()[0] or 1
    if bounded_cells:
        sizes = F.broadcast(sizes)  # one row per cell, and their bytes have been checked
    return queries.join(sizes, "cell"), items.join(sizes, "cell"), 3 * max(cores, groups)


def _grid_plan(queries, items, k, with_cells, options: KnnOptions, dim: int, bounded_cells: bool, cell_sizes=None) -> DataFrame:
    """Cells x query stripes x item stripes, co-grouped. Stripe numbers come from counts per cell.

    A stripe holds many blocks, so a row is copied once per stripe of the other side and not once per block. The number
    of tasks is given, since the few bytes of a stripe do not show the work.
    """
    rows = max(options.block_rows or 256, _SEGMENT_VALUES // max(dim, 1))
    queries, items, tasks = _with_stripe_counts(queries, items, with_cells, rows, options.block_rows or 256, bounded_cells, cell_sizes)
    cut_items = (
        items.withColumn("item_stripe", F.pmod(F.xxhash64("employee_id"), "item_stripes"))
        .withColumn("query_stripe", F.explode(_numbers("query_stripes")))
        .select("cell", "item_stripe", "query_stripe", "employee_id", "vec")
    )
    cut_queries = (
        queries.withColumn("query_stripe", F.pmod(F.xxhash64("requirement_id"), "query_stripes"))
        .withColumn("item_stripe", F.explode(_numbers("item_stripes")))
        .select("cell", "item_stripe", "query_stripe", "requirement_id", "vec", "floor")
    )
    keys = ["cell", "item_stripe", "query_stripe"]
    cut_queries, cut_items = cut_queries.repartition(tasks, *keys), cut_items.repartition(tasks, *keys)
    return cut_queries.groupBy(*keys).cogroup(cut_items.groupBy(*keys)).applyInArrow(_grid_task(k, options.block_rows), _OUT)


def _sampled(items: DataFrame, fraction: float) -> DataFrame:
    return items.where(F.pmod(F.xxhash64("employee_id", F.lit(17)), F.lit(1_000_000)) < int(fraction * 1_000_000))


def _seed_floors(top: DataFrame, k: int) -> DataFrame:
    """Lower bound per requirement, only where ``top`` holds k candidates."""
    return (
        top.groupBy("requirement_id").agg(F.count("*").alias("n"), F.min("similarity").alias("seed"))
        .where(F.col("n") == k).select("requirement_id", "seed")
    )


def with_floors(queries: DataFrame, top: DataFrame, k: int) -> DataFrame:
    """``queries`` with ``floor``, the k-th similarity in ``top`` where that holds k, or the floor they had."""
    held = F.col("floor") if "floor" in queries.columns else F.lit(float("-inf"))
    return (queries.join(_seed_floors(top, k), "requirement_id", "left")
            .withColumn("floor", F.greatest(held, F.coalesce("seed", F.lit(float("-inf"))))).drop("seed"))


def top_k(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    *,
    cells: bool = False,
    options: KnnOptions = KnnOptions(),
    item_count: int | None = None,
    cell_count: int | None = None,
    cell_sizes: DataFrame | None = None,
) -> DataFrame:
    """``requirement_id, employee_id, similarity, candidate_rank`` of the k nearest items per query.

    ``queries``: ``requirement_id, vec`` (+ ``cells`` array when searching cells, + ``floor``, a similarity below which
    nothing is wanted), one row per id; ``items``: ``employee_id, vec`` (+ ``cell``), one row per id. Vectors are
    expected to be unit vectors. ``item_count`` (the index catalog knows it) turns the pre-scan on for large item
    sides; ``cell_sizes`` (``cell, n``, as the index stores them) spares the grid a count of the items.
    """
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    if options.plan not in ("auto", "broadcast", "blocks", "grid"):
        raise ValueError(f"unknown plan {options.plan!r}")

    # Sizes, bounds and the search itself read the requirements, and an encoder may stand before them: keep
    # what it gave. A lost executor costs its part again.
    if "floor" not in queries.columns:
        queries = queries.withColumn("floor", F.lit(float("-inf")))
    queries = queries.select("requirement_id", "vec", "floor", *(["cells"] if cells else [])).persist()
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim"),
                       F.sum(_query_bytes(0, cells)).alias("bytes")).first()
    dim = size["dim"] or 1
    total = (size["bytes"] or 0) + size["n"] * dim * 8
    small = total <= options.broadcast_bytes
    if options.plan == "broadcast" and not small:
        raise ValueError(f"{size['n']} requirement vectors of {dim} values exceed the broadcast bound")

    fraction = options.seed_fraction
    if fraction is None:
        worth_it = (item_count or 0) >= options.seed_min_items and size["n"] >= options.seed_min_queries
        fraction = 0.01 if worth_it else 0.0

    # The statistics per cell (three numbers and a key) are broadcast only if they are known to be small.
    bounded = not cells or (cell_count is not None and cell_count * 32 <= options.broadcast_bytes)

    task_rows = None

    def partial(some: DataFrame, side: DataFrame, sizes: DataFrame | None, share: float = 1.0) -> DataFrame:
        if options.plan == "grid":
            return _grid_plan(some, side, k, cells, options, dim, bounded, sizes)
        return _broadcast_plan(some, side, k, cells, options.broadcast_bytes, task_rows and math.ceil(task_rows / share))

    def search(some: DataFrame, side: DataFrame) -> DataFrame:
        if fraction > 0:
            some = with_floors(some, keep_top(partial(some, _sampled(side, fraction), None, fraction), k), k)
        return keep_top(partial(some, side, cell_sizes), k)

    if options.plan == "grid":  # lazy, so the requirements it reads later are a written table
        target = f"{work_folder(queries.sparkSession)}/requirements"
        queries.write.parquet(target)
        queries.unpersist()
        return search(queries.sparkSession.read.schema(queries.schema).parquet(target), _spread_items(items, cells))
    if size["n"] >= options.spread_min_queries or options.plan == "blocks" or not small:
        items = _spread_items(items, cells)
        task_rows = _task_rows(queries, items, cells, size["n"])
    if options.plan == "blocks" or not small:
        found = _blocks_plan(queries, items, k, cells, options, dim, total, search)
    else:
        found = search(queries, items)
    queries.unpersist()
    return found
