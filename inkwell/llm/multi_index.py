"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut in halves; each half has a codebook of its own, and the pairs of codes form
a grid of cells. Every distinct vector is in the cell of its nearest codes. As a query it visits
cells in order of distance (the multi-sequence traversal: a queue over the two sorted lists of
half distances), up to a number of cells that reached the target recall on a bounded sample of
rows (SAMPLE; codebooks and that number are all that is fitted on it). What it meets there is
verified by cosine in double precision. Cells with many vectors are met block by block.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import connected_components, staged

SAMPLE, TARGET, SPARE, BLOCK = 8000, 0.995, 1.5, 1024
MAX_CODES, LEAST_CELLS = 64, 8


def _means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means codebook of one half (Lloyd's rounds from seeded rows)."""
    picks = np.random.default_rng(seed).permutation(len(x))[:k]
    book = x[np.sort(picks)].copy()
    for _ in range(12):
        own = _distances(x, book).argmin(1)
        total = np.zeros_like(book)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=len(book))
        book[n > 0] = total[n > 0] / n[n > 0, None]
    return book


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ book.T + (book * book).sum(1), 0)


def traverse(near: np.ndarray, far: np.ndarray, cells: int) -> list[int]:
    """Cells (first code * number of second codes + second) in order of the sum of half distances."""
    a, b = np.argsort(near, kind="stable").tolist(), np.argsort(far, kind="stable").tolist()
    n = len(b)
    queue, pushed, out = [(near[a[0]] + far[b[0]], 0, 0)], {(0, 0)}, []
    while queue and len(out) < cells:
        _, i, j = heapq.heappop(queue)
        out.append(a[i] * n + b[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < n and (x, y) not in pushed:
                pushed.add((x, y))
                heapq.heappush(queue, (near[a[x]] + far[b[y]], x, y))
    return out


class MultiIndex:
    """Two codebooks and the number of cells to visit."""

    def __init__(self, sample: np.ndarray, labels: np.ndarray, least: float):
        half = sample.shape[1] // 2
        self.half = half
        k = int(np.clip(2 ** round(np.log2(max((len(sample) / 8) ** 0.5, 1))), 1, MAX_CODES))
        self.books = (_means(sample[:, :half], k, 1), _means(sample[:, half:], k, 2))
        own = self.cell(sample)
        # found[r]: linked pairs of the sample, in each direction, whose cell is the (r + 1)-th of the row's own order
        found = np.zeros(len(self.books[0]) * len(self.books[1]), np.int64)
        for label in np.unique(labels):
            at = np.flatnonzero(labels == label)
            for i in range(0, len(at), 256):
                rows = at[i : i + 256]
                close = sample[rows] @ sample[at].T >= least
                close[np.arange(len(rows)), np.arange(i, i + len(rows))] = False
                ordered, cells = self._ordered(sample[rows])
                for row, every in enumerate(cells):
                    met = np.flatnonzero(close[row])
                    if len(met):
                        np.add.at(found, np.searchsorted(ordered[row], every[own[at[met]]]), 1)
        total = np.cumsum(found)
        need = int(np.searchsorted(total, TARGET * total[-1])) + 1 if total[-1] else 0
        self.cells = int(min(max(need * SPARE, LEAST_CELLS), len(self.books[0]) * len(self.books[1])))

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(x[:, : self.half], self.books[0]), _distances(x[:, self.half :], self.books[1])

    def cell(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return a.argmin(1) * len(self.books[1]) + b.argmin(1)

    def _ordered(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances from each row to all cells, sorted and by cell."""
        a, b = self.halves(x)
        every = (a[:, :, None] + b[:, None, :]).reshape(len(x), -1)
        return np.sort(every, 1), every

    def visits(self, x: np.ndarray) -> np.ndarray:
        """Per row the cells that it visits, its own first."""
        a, b = self.halves(x)
        return np.array([traverse(p, q, self.cells) for p, q in zip(a, b, strict=True)], np.int32).reshape(len(x), self.cells)


def unit_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """Add `unit`: the vector over its length as packed doubles; null for vectors that are null or
    zero, or hold null or non-finite components."""

    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column(batch.schema.get_field_index(vector)).to_pylist():
                x = None if v is None or not len(v) or any(c is None for c in v) else np.asarray(v, np.float64)
                if x is not None and np.isfinite(x).all() and x.any():
                    x = x / np.abs(x).max()
                    out.append((x / np.sqrt((x * x).sum())).tobytes())
                else:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "unit"])

    return rows.mapInArrow(run, "vec_id long, label long, unit binary")


def near_vectors(rows: DataFrame, least: float = 0.93, vector: str = "embedding") -> DataFrame:
    """A row per row of rows (vec_id, label, embedding): vec_id, n_links, component_id, kept.

    Vectors of one label (not null) and one length link when their cosine is `least` or more.
    Equal vectors are one to the index and count as often as they are there. Vectors without a
    direction and rows without a label link with nothing and are kept. A pair counts if either of
    its vectors visits the cell of the other.
    """
    spark = rows.sparkSession
    base = rows.select("vec_id", F.col("label").cast("long").alias("label"), F.col(vector).cast("array<double>").alias(vector))
    base = staged(unit_vectors(base, vector), "vectors")
    valid = base.where("unit IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL")
    distinct = staged(valid.groupBy("label", "unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "distinct-vectors")
    # one index for each length of vector; as a rule there is one length
    links, edges = None, None
    for (size,) in distinct.select(F.length("unit")).distinct().collect():
        same = distinct.where(F.length("unit") == size)
        found = _links(same, size // 8, least)
        links = found if links is None else links.unionByName(found)
    schema = "rep long, links long, low long"
    links = staged(links, "vector-links") if links is not None else spark.createDataFrame([], schema)
    edges = links.where("low IS NOT NULL AND low <> rep").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    components = connected_components(edges)
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    named = distinct.join(counts, "rep", "left").join(components.withColumnRenamed("id", "rep"), "rep", "left").select(
        "label", "unit", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    out = base.join(named, ["label", "unit"], "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _links(distinct: DataFrame, size: int, least: float) -> DataFrame:
    """(rep, links, low): parts of each vector's number of links, and a smaller vector that it is
    connected with. The parts add up; the pairs (rep, low) connect what the links connect."""
    spark = distinct.sparkSession
    sample = distinct.orderBy(F.xxhash64("unit"), "rep").limit(SAMPLE).select("label", "unit").toPandas()
    index = MultiIndex(np.frombuffer(b"".join(sample["unit"]), np.float64).reshape(-1, size), sample["label"].to_numpy(), least)
    shared = spark.sparkContext.broadcast(index)

    def visit(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                x = np.frombuffer(b"".join(part.column(2).to_pylist()), np.float64).reshape(-1, size)
                seen = shared.value.visits(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * seen.shape[1], pa.int32()), pa.array(seen.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], ["rep", "label", "unit", "n", "seen"])

    indexed = distinct.select("rep", "label", "unit", "n").mapInArrow(visit, "rep long, label long, unit binary, n long, seen array<int>")
    indexed = staged(indexed, "indexed").withColumn("home", F.col("seen")[0])
    members = indexed.groupBy("label", "home").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).withColumnRenamed("home", "cell")
    visits = indexed.select("rep", "label", F.explode("seen").alias("cell")).join(members, ["label", "cell"])
    callers = visits.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("calls"))
    blocks = members.join(callers, ["label", "cell"])
    spread = lambda n: (F.abs(F.xxhash64("rep")) % F.col(n)).cast("int")
    held = indexed.withColumn("cell", F.col("home")).join(blocks, ["label", "cell"]).select(
        "label", "cell", spread("blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("calls") - 1)).alias("j"),
        F.lit(True).alias("held"), "rep", "unit", "n", "home", "seen",
    )
    asked = indexed.select("rep", "label", "unit", "n", "home", F.explode("seen").alias("cell")).join(blocks, ["label", "cell"]).select(
        "label", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), spread("calls").alias("j"),
        F.lit(False).alias("held"), "rep", "unit", "n", "home", F.lit(None).cast("array<int>").alias("seen"),
    )

    def verify(key, rows: pd.DataFrame) -> pd.DataFrame:
        own, other = rows[rows["held"]], rows[~rows["held"]]
        if own.empty or other.empty:
            return pd.DataFrame({"rep": [], "links": [], "low": []}, dtype="int64")
        x = np.frombuffer(b"".join(other["unit"]), np.float64).reshape(-1, size)
        y = np.frombuffer(b"".join(own["unit"]), np.float64).reshape(-1, size)
        a, b = other["rep"].to_numpy(), own["rep"].to_numpy()
        close = (x @ y.T >= least) & (a[:, None] != b[None, :])
        n_a, n_b = other["n"].to_numpy(), own["n"].to_numpy()
        # who is held does not find the caller by itself if it does not visit the caller's cell
        home = other["home"].to_numpy()
        unseen = close & ~np.stack([np.isin(home, s) for s in own["seen"]], 1)
        ids, links = np.concatenate([a, b]), np.concatenate([close @ n_b, n_a @ unseen])
        # connect what is linked here by smallest neighbours, in both directions until nothing changes
        low_a, low_b = a.copy(), b.copy()
        top = np.iinfo(np.int64).max
        while True:
            new_a = np.minimum(low_a, np.where(close, low_b[None, :], top).min(1))
            new_b = np.minimum(low_b, np.where(close, new_a[:, None], top).min(0))
            if (new_a == low_a).all() and (new_b == low_b).all():
                break
            low_a, low_b = new_a, new_b
        out = pd.DataFrame({"rep": ids, "links": links, "low": np.concatenate([low_a, low_b])})
        return out[(out["links"] > 0) | (out["low"] != out["rep"])].astype("int64")

    return held.unionByName(asked).groupBy("label", "cell", "i", "j").applyInPandas(verify, "rep long, links long, low long")
