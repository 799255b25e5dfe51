"""Vector codes: four codebooks of integer entries, the nearest entry found in a near-neighbour tree of split points (GNAT)."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from inkwell.llm.common import staged

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Split points of a node of the tree, and entries that a leaf holds.
SPLITS, LEAF = 8, 8
#: Label sums are broadcast up to so many labels and joined by shuffle beyond.
BROADCAST_LABELS = 100_000
#: Relative slack for distances that are roots of integers rounded to doubles.
ROUNDING = 1e-12


def squared(queries: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row per query."""
    difference = queries[:, None, :] - entries[None, :, :]
    return np.einsum("qed,qed->qe", difference, difference)


def lower(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 - ROUNDING)


def upper(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 + ROUNDING)


class _Products:
    """Squared distances of queries and entries. Where all sums are integers below 2^53, products of doubles give them exactly."""

    def __init__(self, queries: np.ndarray, entries: np.ndarray):
        self.queries, self.entries = queries, entries
        largest = max(int(np.abs(queries).max(initial=0)), int(np.abs(entries).max(initial=0)))
        self.small = 4 * queries.shape[1] * largest * largest < 1 << 53
        if self.small:
            self.queries, self.entries = queries.astype(np.float64), entries.astype(np.float64)
            self.query_norms, self.entry_norms = (self.queries**2).sum(1), (self.entries**2).sum(1)

    def squares(self, rows: np.ndarray, members: np.ndarray) -> np.ndarray:
        if not self.small:
            return squared(self.queries[rows], self.entries[members])
        products = self.queries[rows] @ self.entries[members].T
        return (self.query_norms[rows, None] - 2 * products + self.entry_norms[None, members]).astype(np.int64)


@dataclass
class Node:
    """Split points (indexes of entries), the ranges of distances from each split point to each child's entries
    (low rounded down, high up), and the children; a leaf has its entries as split points and no children."""

    splits: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    children: list[Node | None] | None = None


def build(entries: np.ndarray, members: np.ndarray) -> Node:
    """Split points by farthest-first choice; every other entry goes to its nearest one. Equal entries end in one leaf."""
    if len(members) <= LEAF:
        return Node(members)
    picked = [0]
    nearest = squared(entries[members], entries[members[:1]])[:, 0]
    while len(picked) < SPLITS and nearest.max() > 0:
        picked.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squared(entries[members], entries[members[picked[-1:]]])[:, 0])
    if len(picked) == 1:
        return Node(members)
    splits = members[picked]
    rest = np.delete(members, picked)
    distances = squared(entries[rest], entries[splits])
    home = distances.argmin(1)
    low, high = np.full((len(splits), len(splits)), np.inf), np.full((len(splits), len(splits)), -np.inf)
    children: list[Node | None] = []
    for k in range(len(splits)):
        own = home == k
        if own.any():
            low[:, k], high[:, k] = lower(distances[own].min(0)), upper(distances[own].max(0))
        children.append(build(entries, rest[own]) if own.any() else None)
    return Node(splits, low, high, children)


class Search:
    """Nearest entries for many queries at once; ties go to the lower index."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = build(entries, np.arange(len(entries)))
        self.compared = 0

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) per query."""
        best = np.full(len(queries), np.iinfo(np.int64).max)
        index = np.zeros(len(queries), np.int64)
        self.compared = 0
        if len(queries):
            self._visit(self.root, _Products(queries, self.entries), np.arange(len(queries)), best, index)
        return index, best

    def _visit(self, node: Node, queries: _Products, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        squares = queries.squares(rows, node.splits)
        self.compared += squares.size
        # exact integers decide: the nearest of this node's points, of equal ones the first entry
        least = squares.min(1)
        first = np.where(squares == least[:, None], node.splits[None, :], len(self.entries)).min(1)
        better = (least < best[rows]) | ((least == best[rows]) & (first < index[rows]))
        best[rows[better]], index[rows[better]] = least[better], first[better]
        if node.children is None:
            return
        down, up = lower(squares), upper(squares)
        # each query looks at the children of its nearest split points first; it skips a child if some split point
        # proves every entry in it strictly farther than the best so far
        order = np.argsort(squares, axis=1, kind="stable")
        for turn in range(len(node.children)):
            child = order[:, turn]
            radius = upper(best[rows])[:, None]
            far = (down - radius > node.high[:, child].T) | (up + radius < node.low[:, child].T)
            left = np.flatnonzero(~far.any(1))
            if len(left):
                left = left[np.argsort(child[left], kind="stable")]
                for group in np.split(left, np.flatnonzero(np.diff(child[left])) + 1):
                    self._visit(node.children[child[group[0]]], queries, rows[group], best, index)


def bounds(width: int) -> list[int]:
    return [k * width // PARTS for k in range(PARTS + 1)]


def limit(width: int) -> int:
    """Components are held to this size either way, so that a vector's error fits a long."""
    return math.isqrt(2**60 // max(width, 1))


def integers(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, part of integers) of the rows whose vector has components, all finite."""
    whole = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(vectors[key].alias("vec_id"), vectors[label].alias("label"), vectors[vector].cast("array<double>").alias("v")).where(whole)
    most = 2.0**31
    scaled = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * F.lit(float(SCALE)), F.lit(most)), F.lit(-most))).cast("long"))
    return rows.select("vec_id", "label", scaled.alias("v"))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return np.clip(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width), -limit(width), limit(width))


def _searches(books: list[np.ndarray]) -> list[Search]:
    return [Search(book) for book in books]


def sums(rows: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """Count and component sums of the parts at each entry: added up within each task, then by Spark."""
    edges = bounds(width)
    widest = max(b - a for a, b in zip(edges, edges[1:], strict=False))
    schema = "part int, entry int, n long, s array<long>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        searches = _searches(books)
        counts = [np.zeros(len(b), np.int64) for b in books]
        totals = [np.zeros((len(b), widest), np.int64) for b in books]
        for batch in batches:
            x = matrix(batch.column(0), width)
            for p, search in enumerate(searches):
                part = x[:, edges[p] : edges[p + 1]]
                at, _ = search.nearest(part)
                counts[p] += np.bincount(at, minlength=len(counts[p]))
                np.add.at(totals[p], (at[:, None], np.arange(part.shape[1])[None, :]), part)
        found = [(p, e, int(counts[p][e]), totals[p][e].tolist()) for p in range(len(books)) for e in np.flatnonzero(counts[p]).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*found, strict=True)) or [[]] * 4, arrow, strict=True)], schema=arrow)

    local = rows.select("v").mapInArrow(run, schema)
    return local.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(widest)]).alias("s"))


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for entry in book.tolist() for v in entry).encode()).hexdigest()


def fit(rows: DataFrame, rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """Codebooks from the parts of the 256 smallest ids, moved `rounds` times to the floors of their parts' means."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    if not first:
        return [], 0
    width = len(first[0].v)
    start = np.clip(np.array([r.v for r in first if len(r.v) == width], np.int64), -limit(width), limit(width))
    edges = bounds(width)
    books = [start[:, a:b].copy() for a, b in zip(edges, edges[1:], strict=False)]
    same = rows.where(F.size("v") == width)
    for _ in range(rounds):
        moved = [book.copy() for book in books]
        for row in sums(same, books, width).collect():  # at most a row per entry
            size = books[row.part].shape[1]
            moved[row.part][row.entry] = [total // row.n for total in row.s[:size]]
        books = moved
    return books, width


def encode(rows: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """(vec_id, label, code, error): indexes of the nearest entries in part order, and the squared distances' sum."""
    edges = bounds(width)
    schema = StructType([rows.schema["vec_id"], rows.schema["label"], *StructType.fromDDL("code string, error long").fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        searches = _searches(books)
        for batch in batches:
            x = matrix(batch.column(2), width)
            found = [search.nearest(x[:, edges[p] : edges[p + 1]]) for p, search in enumerate(searches)]
            codes = np.stack([at for at, _ in found], 1).astype(np.uint8)
            texts = [row.tobytes().hex() for row in codes]
            error = sum(distance for _, distance in found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(error, pa.int64())], schema=arrow)

    return rows.where(F.size("v") == width).select("vec_id", "label", "v").mapInArrow(run, schema)


def vector_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """Per usable vector its key, label, code, error, label_error and codebooks_sha256.

    Rows whose vector is null or empty, or holds null or non-finite components, are left out; so are vectors of
    another length than that of the smallest id. Components are floors of 1024 times the value, held to the root of
    2^60 over the width. Repeated ids keep their rows (the smaller vector comes first when codebooks start), null ids come
    last. Fewer than 256 vectors give as many entries. A table without usable vectors gives no rows. Other columns are not
    read. Errors by label are added up before they are shuffled; nulls are one label.
    """
    rows = staged(integers(vectors, key, vector, label), "integers")
    books, width = fit(rows, rounds)
    if not books:
        books, width = [np.zeros((1, 0), np.int64)] * PARTS, -1
    coded = staged(encode(rows, books, width), "codes")
    per_label = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    per_label = staged(per_label.select(F.col("label").alias("of"), F.least("total", F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long").alias("label_error")), "labels")
    if per_label.count() <= BROADCAST_LABELS:
        per_label = F.broadcast(per_label)
    joined = coded.join(per_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
