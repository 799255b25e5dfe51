"""Places on a map for the nodes of a weighted graph: its strongest directions by block power iteration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators.graph import staged


def _start(node: str, width: int):
    """Columns of numbers between -1 and 1 that depend on the node alone."""
    return F.array(*[F.xxhash64(F.col(node), F.lit(k)) / F.lit(2.0**63) for k in range(width)])


def _times(matrix: DataFrame, block: DataFrame, width: int) -> DataFrame:
    """(node, x): a sparse matrix (i, j, value) times a block of columns (node, x). Products are summed within tasks before they are shuffled."""
    terms = matrix.join(block.select(F.col("node").alias("j"), "x"), "j").select(F.col("i").alias("node"), *[(F.col("value") * F.col("x")[k]).alias(f"x{k}") for k in range(width)])
    return terms.groupBy("node").agg(*[F.sum(f"x{k}").alias(f"x{k}") for k in range(width)]).select("node", F.array(*[f"x{k}" for k in range(width)]).alias("x"))


def _inner(block: DataFrame, width: int, other: DataFrame | None = None) -> np.ndarray:
    """The products of the columns of a block with each other (or with another block's): a small square."""
    both = block.select("node", "x", F.col("x").alias("y")) if other is None else block.join(other.select("node", F.col("x").alias("y")), "node")
    row = both.agg(*[F.sum(F.col("x")[a] * F.col("y")[b]).alias(f"s{a}_{b}") for a in range(width) for b in range(width)]).first()
    return np.array([0.0 if v is None else v for v in row], float).reshape(width, width)


def _turned(block: DataFrame, turn: np.ndarray) -> DataFrame:
    """A block whose columns are combined by the columns of `turn`."""
    return block.select("node", F.array(*[sum((F.col("x")[a] * F.lit(float(turn[a, b])) for a in range(turn.shape[0])), F.lit(0.0)) for b in range(turn.shape[1])]).alias("x"))


def strongest(edges: DataFrame, count: int, spare: int = 6, rounds: int = 30, near: float = 1e-9) -> tuple[DataFrame, np.ndarray]:
    """(node, x) and values: the `count` strongest directions of the symmetric matrix of the edges (a, b, weight) with ones on the diagonal.

    A few spare columns go along, so that rounds need only tell `count` directions from the `count + spare`-th on. Each round multiplies, makes the
    columns orthonormal by their small square of products (rank is dropped where they are not independent), and is written once. Rounds end when the
    values stand still.
    """
    width = count + spare
    both = edges.select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("weight").cast("double").alias("value"))
    nodes = both.select(F.explode(F.array("i", "j")).alias("node")).distinct()
    whole = both.union(both.select("j", "i", "value")).union(nodes.select("node", "node", F.lit(1.0)))
    matrix = staged(whole.groupBy("i", "j").agg(F.sum("value").alias("value")), "layout-matrix")
    block = staged(nodes.select("node", _start("node", width).alias("x")), "layout")
    values = np.zeros(0)
    for _ in range(rounds):
        if width:
            gram = _inner(block, width)
            size, turn = np.linalg.eigh(gram)
            good = size > max(size.max(), 0.0) * 1e-12
            width = int(good.sum())
            if not width:
                break
            block = _turned(block, turn[:, good] / np.sqrt(size[good]))
        moved = staged(_times(matrix, block, width), "layout")
        small = _inner(block, width, moved)
        now = np.sort(np.abs(np.linalg.eigvalsh((small + small.T) / 2)))[::-1][:count]
        done = len(now) == len(values) and np.allclose(now, values, rtol=near, atol=1e-12)
        values = now
        last, block = block, moved
        if done:
            break
    if not width:
        return nodes.select("node", F.array().cast("array<double>").alias("x")), values
    size, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(size))[:count]
    return _turned(last, turn[:, order]), size[order]


def layout(edges: DataFrame) -> DataFrame:
    """(node, x, y) between 0 and 1: two strongest directions of the nodes' profiles of associations, scaled. Signs are settled by the
    entry that is largest in size being positive; a direction without extent is 0. Without edges there are no rows."""
    found, _ = strongest(edges, 2)
    found = staged(found, "layout")
    named = found.select("node", *[F.coalesce(F.get("x", F.lit(k)), F.lit(0.0)).alias(f"v{k}") for k in (0, 1)])
    ends = named.agg(*[f(f"v{k}").alias(f"{n}{k}") for k in (0, 1) for n, f in (("low", F.min), ("high", F.max))])
    placed = named.crossJoin(F.broadcast(ends))  # one row

    def scaled(k: int):
        low, high, v = F.col(f"low{k}"), F.col(f"high{k}"), F.col(f"v{k}")
        share = F.when(high > low, F.when(high >= -low, v - low).otherwise(high - v) / (high - low)).otherwise(F.lit(0.0))
        return share

    return placed.select("node", scaled(0).alias("x"), scaled(1).alias("y"))
