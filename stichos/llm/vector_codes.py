"""Vector codes: the parts of a vector as indexes into small codebooks that Lloyd's rounds fit.

Every run of rows of a partition has a cover tree per part, built once and written: a node covers its points within a radius, its
children's centres lie more than half of that apart and cover theirs within the half. Points stand in the order of the tree, so a subtree
is a range and its sum a difference of cumulative sums. In a round a subtree goes as a whole to the entry nearest to its centre, if the
triangle inequality shows that no point of it can be nearer to another; ambiguous nodes descend, and at the leaves distances are compared exactly.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stichos.llm.common import cut, ship

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
CHUNK, LEAF = 4096, 16


class Tree(NamedTuple):
    """A node covers the places low ... high - 1 of `order`; its children are `child` ... `child + children - 1`."""

    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    children: np.ndarray


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (int64) of integer points to integer entries."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if most * most * points.shape[1] < 1 << 50:                       # then every sum below is an integer that a double holds
        a, b = points.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((points - e) ** 2).sum(axis=1) for e in entries], axis=1)


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree of one part. A node of at most `leaf` points, or of equal ones, is a leaf; the first point of a node is its centre."""
    n = len(points)
    order, nodes, at = np.arange(n, dtype=np.int32), [[0, n, 0.0, 0, 0]], 0
    while at < len(nodes):
        low, high = nodes[at][:2]
        members = order[low:high]
        away = np.sqrt(squared(points[members], points[members[:1]])[:, 0].astype(np.float64))
        radius = nodes[at][2] = float(away.max(initial=0.0))
        if high - low > leaf and radius > 0:
            nodes[at][3], start, rest, taken = len(nodes), low, members.copy(), away
            while len(rest):
                near = taken <= radius / 2
                mine, rest = rest[near], rest[~near]
                order[start:start + len(mine)] = mine
                nodes.append([start, start + len(mine), 0.0, 0, 0])
                start += len(mine)
                if len(rest):
                    taken = np.sqrt(squared(points[rest], points[rest[:1]])[:, 0].astype(np.float64))
            nodes[at][4] = len(nodes) - nodes[at][3]
        at += 1
    low, high, radius, child, children = (np.array(c) for c in zip(*nodes))
    return Tree(order, low.astype(np.int32), high.astype(np.int32), radius, child.astype(np.int32), children.astype(np.int32))


def _span(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges low ... low + size - 1 behind each other."""
    return np.repeat(low - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def assign(tree: Tree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of the tree's order (low, high, entry) whose points all belong to one entry, and the other places with theirs (place, entry).

    `points` stand in the order of the tree. Ties go to the entry of the lower index: a range is only decided by a strict gap, wider than rounding.
    """
    lows, highs, whole, places, single = [], [], [], [], []
    nodes = np.zeros(1 if len(points) else 0, np.int64)
    while len(nodes):
        distance = squared(points[tree.low[nodes]], entries)
        best = distance.argmin(axis=1)
        if distance.shape[1] > 1:
            two = np.sqrt(np.partition(distance, 1, axis=1)[:, :2].astype(np.float64))
            radius = tree.radius[nodes]
            sure = (two[:, 1] - two[:, 0] > 2 * radius + 1e-9 * (two[:, 1] + radius)) | (radius == 0)
        else:
            sure = np.ones(len(nodes), bool)
        lows.append(tree.low[nodes[sure]])
        highs.append(tree.high[nodes[sure]])
        whole.append(best[sure])
        open_ = nodes[~sure]
        bottom = tree.children[open_] == 0
        leaves, inner = open_[bottom], open_[~bottom]
        if len(leaves):
            here = _span(tree.low[leaves], tree.high[leaves] - tree.low[leaves])
            places.append(here)
            single.append(squared(points[here], entries).argmin(axis=1))
        nodes = _span(tree.child[inner], tree.children[inner])
    join = lambda a: np.concatenate(a).astype(np.int64) if a else np.empty(0, np.int64)
    return join(lows), join(highs), join(whole), join(places), join(single)


def sums(tree: Tree, points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Per entry the sum of its points and, last, their number."""
    counted = np.concatenate([points, np.ones((len(points), 1), np.int64)], axis=1)
    running = np.concatenate([np.zeros((1, counted.shape[1]), np.int64), np.cumsum(counted, axis=0)])
    low, high, whole, places, single = assign(tree, points, entries)
    out = np.zeros((len(entries), counted.shape[1]), np.int64)
    np.add.at(out, whole, running[high] - running[low])
    for e in range(len(entries)):
        out[e] += counted[places[single == e]].sum(axis=0)
    return out


def codes(tree: Tree, points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The entry of every place of the tree's order."""
    low, high, whole, places, single = assign(tree, points, entries)
    out = np.empty(len(points), np.int64)
    out[_span(low, high - low)] = np.repeat(whole, high - low)
    out[places] = single
    return out


# ---- Spark -------------------------------------------------------------------------------------------------

def _stored(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _plant(ids: list, labels: list, points: np.ndarray, parts: int) -> pa.RecordBatch:
    """One run of rows with its trees, as one row."""
    width = points.shape[1] // parts
    trees = [cover_tree(points[:, p * width:(p + 1) * width]) for p in range(parts)]
    size = np.int32 if np.abs(points).max(initial=0) < 1 << 31 else np.int64
    arrays = {f: np.concatenate([getattr(t, f) for t in trees]) for f in Tree._fields}
    row = _stored(points=points.astype(size), nodes=np.array([len(t.low) for t in trees]), **arrays,
                  ids=np.array([i or 0 for i in ids], np.int64), has_id=np.array([i is not None for i in ids]),
                  labels=np.array([x or 0 for x in labels], np.int64), has_label=np.array([x is not None for x in labels]))
    return pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], ["run"])


def _trees(run: dict, parts: int) -> Iterator[tuple[Tree, np.ndarray]]:
    """Each part's tree and its points in the order of the tree."""
    points, ends = run["points"].astype(np.int64), np.concatenate([[0], np.cumsum(run["nodes"])])
    n, width = len(points), points.shape[1] // parts
    for p in range(parts):
        tree = Tree(run["order"][p * n:(p + 1) * n], *(run[f][ends[p]:ends[p + 1]] for f in Tree._fields[1:]))
        yield tree, points[tree.order, p * width:(p + 1) * width]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for row in batch.column("run"):
            with np.load(io.BytesIO(row.as_py())) as held:
                yield dict(held)


class VectorCodes(NamedTuple):
    """table: vec_id, label, code (one byte a part), error; codebooks: parts x entries x width."""

    table: DataFrame
    codebooks: np.ndarray


def compress_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, chunk: int = CHUNK) -> VectorCodes:
    """Codes of the rows of (vec_id, embedding, label); floor(scale * x) is what is compared.

    Rows whose vector is null or has a null or non-finite component are dropped, as are those of another length than the vector of
    the least vec_id. A length that `parts` does not divide is filled up with zeros; components are held to a size whose squared distances fit 64 bits
    (2^26 for 64 numbers). First entries are the parts of the `entries` least vec_ids (null last; of equal ids the lesser vector), of fewer rows as
    many. Rows listed twice count twice; other columns are ignored; an empty table has no codes and empty codebooks.

    The driver sees one codebook's sums a round (parts x entries x width numbers); rows stay in their partition from the first round to the last.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte")
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                          F.col("embedding").cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("v").isNotNull() & ~odd)
    order = [F.col("vec_id").asc_nulls_last(), F.col("v").asc()]
    least = rows.orderBy(*order).select(F.size("v").alias("size")).first()
    length = least.size if least else 0
    width = -(-length // parts)
    bound = 1 << max(0, (60 - max(1, length).bit_length()) // 2)
    rows = rows.filter(F.size("v") == length)

    def whole(values: np.ndarray) -> np.ndarray:
        held = np.clip(np.floor(values.reshape(-1, length) * scale), -bound, bound).astype(np.int64)
        return np.pad(held, ((0, 0), (0, parts * width - length)))

    first = rows.orderBy(*order).select("v").limit(entries).collect()
    seeds = whole(np.array([r.v for r in first], dtype=np.float64)) if length else np.zeros((len(first), 0), np.int64)
    books = np.stack([seeds[:, p * width:(p + 1) * width] for p in range(parts)])

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, held = [], [], []
        for batch in batches:
            values = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            points = whole(values) if length else np.zeros((batch.num_rows, 0), np.int64)
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, min(chunk, batch.num_rows - at))
                if len(ids) + part.num_rows > chunk:
                    yield _plant(ids, labels, np.concatenate(held), parts)
                    ids, labels, held = [], [], []
                ids += part.column("vec_id").to_pylist()
                labels += part.column("label").to_pylist()
                held.append(points[at:at + part.num_rows])
        if ids:
            yield _plant(ids, labels, np.concatenate(held), parts)

    runs = cut(rows.mapInArrow(plant, "run binary"))
    for _ in range(rounds):
        books = _round(runs, books, parts)
    final = books

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            n = len(run["ids"])
            code, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
            for p, (tree, points) in enumerate(_trees(run, parts)):
                mine = codes(tree, points, final[p])
                code[tree.order, p] = mine
                error[tree.order] += ((points - final[p][mine]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(run["ids"], pa.int64(), mask=~run["has_id"]), pa.array(run["labels"], pa.int64(), mask=~run["has_label"]),
                 pa.array([row.tobytes() for row in code], pa.binary()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return VectorCodes(runs.mapInArrow(label, "vec_id long, label long, code binary, error long"), final)


def _round(runs: DataFrame, books: np.ndarray, parts: int) -> np.ndarray:
    """One round: sums per task, added up by cell; an entry without points stays."""
    def part_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for run in _runs(batches):
            one = np.stack([sums(tree, points, books[p]) for p, (tree, points) in enumerate(_trees(run, parts))])
            total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int64()), pa.array(total.ravel(), pa.int64())], ["cell", "value"])

    cells = runs.mapInArrow(part_sums, "cell long, value long").groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    shape = (*books.shape[:2], books.shape[2] + 1)
    total = np.zeros(int(np.prod(shape)), dtype=object)
    for r in cells.collect():                                          # parts x entries x (width + 1) cells, however many rows
        total[r.cell] = int(r.value)
    total, out = total.reshape(shape), books.copy()
    for p in range(shape[0]):
        for e in range(shape[1]):
            if total[p, e, -1]:
                out[p, e] = [int(s // total[p, e, -1]) for s in total[p, e, :-1]]
    return out


def restore(code: bytes, codebooks: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([codebooks[p][c] for p, c in enumerate(code)]) / scale


def codebooks_sha256(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
