"""Near-duplicate documents by a chosen-path similarity join over sets of word shingles.

Each distinct set has a signature of WIDTH minwise values. A tree splits documents by chosen
coordinates of the signature: at every node the node itself picks coordinates (each with the
chance 1 / (similarity * WIDTH), one at least), and documents with equal values there go to one
child, so that about 1 / similarity copies of a document go down and similar ones stay together.
A node branches until it is small: LEAF documents, or after DEPTH levels LARGE, as every further
level costs recall at the threshold. A larger node is settled first: its documents meet two of them on full
sets, and where what is outside its largest component times its size is no more than LARGE squared, it is a leaf
as well. So a cluster of near copies of any size, which would go on branching for dozens of levels, ends
at the level that has stripped it of other documents. (After LAST levels what is left is a leaf.)
Leaves are compared exhaustively. TREES independent trees give the recall: a node picks 1.535 coordinates on
average (1.25 by chance, and one where that picks none), so at the threshold a pair meets in a child of the
root with chance 0.861, in a node of the second level with 0.775 and of the third with 0.717; all twelve trees miss it
with chance 3e-7. Each pair has still to agree on its signatures and to be confirmed on the full sets.

Only connections matter. First all documents of a node meet two pivots, and what is confirmed
links. Then the leaves compare documents of different components, block by block: documents whose
signatures agree with any other one bring their full sets into the block, links are confirmed
there, and documents that a link has joined are not compared again. So a block gives fewer links
than it has documents, however many pairs it compares.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.common import connected_components, staged, text_bytes, width

WIDTH, TREES = 128, 12
LEAF, DEPTH, LARGE, LAST = 64, 3, 4096, 24
#: Documents of a block, and shingles of a block's documents, as far as several documents go.
BLOCK, WEIGHT = 256, 2_000_000
#: Signatures that agree on so many coordinates are worth a look at the full sets: 3 deviations below 0.8.
SLACK = 3.0
#: So many ids or pairs of ids at most (4 or 8 MB) are broadcast; more are joined by shuffle.
BROADCAST_IDS = 500_000
SLICE = 1_000_000
_random = np.random.default_rng(11)
MIX, POWER = _random.integers(1, 1 << 62, 256, np.int64).astype(np.uint64), (_random.integers(1, 1 << 62, 1024, np.int64) | 1).astype(np.uint64)
STEP = (_random.integers(1, 1 << 62, 64, np.int64) | 1).astype(np.uint64)
SCALE, SHIFT = (_random.integers(1, 1 << 31, WIDTH) | 1).astype(np.uint32), _random.integers(0, 1 << 32, WIDTH).astype(np.uint32)


def _stir(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of `words` words, A-Z in lower case.
    A text of fewer words is one shingle, one without words an empty set."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    letters = ~(((data >= 9) & (data <= 13)) | (data == 32))
    starts = letters.copy()
    starts[1:] &= ~letters[:-1]
    first = np.flatnonzero(starts)
    if not len(first):
        return [np.zeros(0, np.int64) for _ in texts]
    at = np.flatnonzero(letters)
    word = np.cumsum(starts[at]) - 1
    place = at - first[word]
    value = MIX[data[at]] * POWER[place & 1023]
    begins = np.searchsorted(at, first)
    hashes = _stir(np.add.reduceat(value, begins) + np.diff(np.append(begins, len(at))).astype(np.uint64))
    ends = np.searchsorted(first, np.cumsum([len(t) + 1 for t in texts]))
    n = len(hashes)
    joined = np.zeros(max(n - words + 1, 0), np.uint64)
    for k in range(words):
        joined += hashes[k : n - words + 1 + k] * STEP[k]
    joined = _stir(joined)
    out, a = [], 0
    for b in ends.tolist():
        if b - a >= words:
            out.append(np.unique(joined[a : b - words + 1]).view(np.int64))
        elif b > a:
            out.append(_stir((hashes[a:b] * STEP[: b - a]).sum(keepdims=True) + np.uint64(b - a)).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
        a = b
    return out


def signature(values: np.ndarray) -> np.ndarray:
    """WIDTH minwise values of a set of 64-bit hashes."""
    out = np.full(WIDTH, 0xFFFFFFFF, np.uint32)
    small = (values.view(np.uint64) >> np.uint64(20)).astype(np.uint32)
    for k in range(0, len(small), 2048):
        np.minimum(out, (small[k : k + 2048, None] * SCALE + SHIFT).min(0), out=out)
    return out


def chosen(node: np.ndarray, chance: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) of what each node picks: a coordinate with the given chance, and always its first."""
    draw = _stir(node[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, WIDTH + 1, dtype=np.uint64))
    pick = draw < np.uint64(int(chance * (1 << 64)))
    pick[np.arange(len(node)), draw.argmin(1)] = True
    return np.nonzero(pick)


def _child(node: np.ndarray, coordinate: np.ndarray, value: np.ndarray) -> np.ndarray:
    return _stir(_stir(node + coordinate.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) ^ value.astype(np.uint64))


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    sizes, at = np.cumsum([len(x) for x in batch.column(column).to_pylist()]), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE)))
        yield batch.slice(at, to - at)
        at = to


def describe(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, signature, marks): set_key is a 128-bit digest of the set, marks
    are the low bytes of the minwise values, to compare by."""

    def run(batches):
        for batch in batches:
            for part in _slices(batch, 1):
                sets = shingle_sets(part.column(1).to_pylist(), words)
                signatures = [signature(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                     pa.array([s.tobytes() for s in signatures], pa.binary()), pa.array([s.astype(np.uint8).tobytes() for s in signatures], pa.binary())],
                    ["doc_id", "n_shingles", "set_key", "signature", "marks"],
                )
        pa.default_memory_pool().release_unused()  # workers live on

    rows = docs.select("doc_id", text_bytes().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, signature binary, marks binary")


def _branch(rows: DataFrame, chance: float) -> DataFrame:
    """(node, rep, signature, n) rows to those of the children; a null node stands for the roots."""

    def run(batches):
        roots = _stir(np.arange(1, TREES + 1, dtype=np.uint64))
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                rep = part.column(1).to_numpy()
                sig = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint32).reshape(-1, WIDTH)
                if part.column(0).null_count:
                    tree, coordinate = chosen(roots, chance)
                    row = np.repeat(np.arange(len(rep)), len(tree))
                    node, coordinate = np.tile(roots[tree], len(rep)), np.tile(coordinate, len(rep))
                else:
                    own = part.column(0).to_numpy().view(np.uint64)
                    row, coordinate = chosen(own, chance)
                    node = own[row]
                child = _child(node, coordinate, sig[row, coordinate])
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(rep[row]), part.column(3).take(pa.array(row))], ["node", "rep", "n"])

    return rows.select("node", "rep", "signature", "n").mapInArrow(run, "node long, rep long, n long")


def trees(reps: DataFrame, chance: float, settle: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, rep, n, size, leaf, settled) of all nodes with two documents or more. reps: rep, signature, n.

    settle: links the documents of large nodes to their pivots, and gives the components (id, component) known by
    then. Nodes and what is joined to them grow with the documents, so these joins are merges at any size."""
    level, found = staged(_branch(reps.select(F.lit(None).cast("long").alias("node"), "rep", "signature", "n"), chance), "nodes"), None
    for depth in range(LAST):
        small = LEAF if depth + 1 < DEPTH else LARGE if depth + 1 < LAST else 1 << 62
        sizes = level.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        kept = level.join(sizes.hint("merge"), "node").withColumn("leaf", F.col("size") <= small)
        kept = staged(kept.withColumn("settled", ~F.col("leaf") & F.lit(depth + 1 >= DEPTH and settle is not None)), "nodes")
        large = kept.where("NOT leaf")
        if not large.isEmpty() and settle is not None and depth + 1 >= DEPTH:
            kept = staged(_ended(kept, settle(large)), "nodes")
            large = kept.where("NOT leaf")
        found = kept if found is None else found.unionByName(kept)
        if large.isEmpty():
            break
        level = staged(_branch(large.select("node", "rep").join(reps.select("rep", "signature", "n"), "rep"), chance), "nodes")
    return found


def _ended(kept: DataFrame, components: DataFrame) -> DataFrame:
    """The nodes of a level; a large one that is nearly one component is a leaf now."""
    held = kept.where("NOT leaf").join(components.select(F.col("id").alias("rep"), "component").hint("merge"), "rep", "left")
    parts = held.groupBy("node", F.coalesce("component", "rep").alias("component")).agg(F.count("*").alias("docs"))
    whole = parts.groupBy("node").agg(F.sum("docs").alias("docs"), F.max("docs").alias("main"))
    done = whole.where((F.col("docs") - F.col("main")) * F.col("docs") <= LARGE * LARGE).select("node", F.lit(True).alias("done"))
    return kept.join(done.hint("merge"), "node", "left").withColumn("leaf", F.col("leaf") | F.coalesce("done", F.lit(False))).drop("done")


def _pivot_pairs(nodes: DataFrame, reps: DataFrame, least: int, percent: int) -> DataFrame:
    """Pairs (a < b) of nodes' documents with two documents of the node, where the signatures agree enough: for each
    document the two most alike, as what else is similar is left to the leaves."""
    pivots = nodes.groupBy("node").agg(F.min(F.struct("rep", "n")).alias("low"), F.min(F.struct(F.xxhash64("rep"), "rep", "n")).alias("any"))
    pivots = pivots.select("node", F.explode(F.array_distinct(F.array("low", F.struct("any.rep", "any.n")))).alias("pivot"))
    fits = 100 * F.least("n", "pivot.n") >= percent * F.greatest("n", "pivot.n")
    pairs = nodes.join(pivots.hint("merge"), "node").where((F.col("rep") != F.col("pivot.rep")) & fits).select(
        F.col("pivot.rep").alias("a"), F.col("rep").alias("b")
    ).distinct()
    near = _agreeing(pairs, reps, least, percent)
    best = Window.partitionBy("b").orderBy(F.desc("same"), "a")
    near = near.withColumn("at", F.row_number().over(best)).where("at <= 2").select("a", "b")
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


class _Confirmed:
    """Links confirmed so far, and the full sets that this took, each computed once."""

    def __init__(self, docs: DataFrame, words: int, percent: int):
        self.docs, self.words, self.percent = docs, words, percent
        self.looked = self.sets = self.links = self.pairs = None

    def need(self, reps: DataFrame) -> None:
        new = reps if self.looked is None else reps.join(self.looked, "rep", "left_anti")
        new = staged(new, "looked")
        more = staged(full_sets(self.docs, new, self.words), "full-sets")
        self.looked = new if self.looked is None else self.looked.unionByName(new)
        self.sets = more if self.sets is None else self.sets.unionByName(more)

    def add(self, links: DataFrame) -> DataFrame:
        """Components with the new links."""
        links = staged(links, "links")
        self.links = links if self.links is None else self.links.unionByName(links)
        return staged(connected_components(self.links), "components")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Components once pairs (a, b) are confirmed; pairs of an earlier call are not looked at again."""
        pairs = staged(pairs if self.pairs is None else pairs.join(self.pairs, ["a", "b"], "left_anti"), "pairs")
        self.pairs = pairs if self.pairs is None else self.pairs.unionByName(pairs)
        self.need(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
        return self.add(confirmed(pairs, self.sets, self.percent))


def _agreeing(pairs: DataFrame, reps: DataFrame, least: int, percent: int) -> DataFrame:
    """Pairs (a, b) with the number of coordinates on which their signatures agree, `least` at least,
    and of sizes that allow the similarity."""

    def run(batches):
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, WIDTH) for i in (2, 3))
            same = (left == right).sum(1)
            n_left, n_right = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            fits = 100 * np.minimum(n_left, n_right) >= percent * np.maximum(n_left, n_right)
            at = np.flatnonzero((same >= least) & fits)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(same[at], pa.int64())], ["a", "b", "same"]
            )

    both = pairs.join(reps.select(F.col("rep").alias("a"), F.col("marks").alias("sa"), F.col("n").alias("na")), "a").join(
        reps.select(F.col("rep").alias("b"), F.col("marks").alias("sb"), F.col("n").alias("nb")), "b"
    )
    return both.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a long, b long, same long")


def full_sets(docs: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """(rep, set) of the given reps, computed once more from their texts."""

    def run(batches):
        for batch in batches:
            for part in _slices(batch, 1):
                sets = shingle_sets(part.column(1).to_pylist(), words)
                values = pa.array(np.concatenate(sets), pa.int64())
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, values)], ["rep", "set"])
        pa.default_memory_pool().release_unused()

    if reps.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        reps = F.broadcast(reps)
    texts = docs.select(F.col("doc_id").alias("rep"), text_bytes().alias("text")).join(reps, "rep", "left_semi")
    return texts.mapInArrow(run, "rep long, set array<bigint>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    if pairs.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        pairs = F.broadcast(pairs)
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("sa")), "a").join(
        sets.select(F.col("rep").alias("b"), F.col("set").alias("sb")), "b"
    )
    both = both.withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.where(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")


def blocks(nodes: DataFrame, reps: DataFrame, components: DataFrame) -> DataFrame:
    """(node, i, j, rep, component, left, within, leaves, ...): what the leaves have still to compare.

    The documents outside a leaf's largest component (minor) are dealt out in blocks, and so is that
    component, in blocks of its own. Each minor block meets every other block of the leaf in a group
    of the two, and itself in the group with the component's first block (`within`). A leaf that is
    one component needs nothing; leaves of the same documents, from several trees, are one.
    `leaves` are all leaves of a document: a pair belongs to the least that both are in.
    """
    held = nodes.where("leaf").select("node", "rep", "n").join(components.select(F.col("id").alias("rep"), "component").hint("merge"), "rep", "left")
    held = held.withColumn("component", F.coalesce("component", "rep"))
    by_part = held.groupBy("node", "component").agg(F.count("*").alias("docs"), F.sum("n").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("mark"))
    mixed = by_part.groupBy("node").agg(
        F.count("*").alias("parts"), F.max(F.struct("docs", "component", "n")).alias("main"), F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.sum("mark").alias("mark")
    ).where("parts > 1")
    count = lambda docs, n: F.greatest(F.ceil(docs / BLOCK), F.least(docs, F.ceil(n / WEIGHT))).cast("int")
    mixed = mixed.groupBy("docs", "mark").agg(F.min(F.struct("node", "main", "n")).alias("one")).select(
        F.col("one.node").alias("node"), F.col("one.main.component").alias("main"),
        count(F.col("docs") - F.col("one.main.docs"), F.col("one.n") - F.col("one.main.n")).alias("first"), count(F.col("one.main.docs"), F.col("one.main.n")).alias("more"),
    )
    rows = held.join(mixed.hint("merge"), "node")
    lists = rows.groupBy("rep").agg(F.array_sort(F.collect_list("node")).alias("leaves"))
    rows = rows.join(lists, "rep").join(reps.select("rep", "marks"), "rep")
    # minor blocks are numbered from 0, those of the largest component from `first`
    dealt = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    rows = rows.withColumn("minor", F.col("component") != F.col("main"))
    rows = rows.withColumn("own", F.when(F.col("minor"), dealt("first")).otherwise(F.col("first") + dealt("more")))
    others = F.when(F.col("minor"), F.array_remove(F.sequence(F.lit(0), F.col("first") + F.col("more") - 1), F.col("own")))
    rows = rows.withColumn("other", F.explode(others.otherwise(F.sequence(F.lit(0), F.col("first") - 1))))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    return rows.select("node", "i", "j", "rep", "component", (F.col("own") == F.col("i")).alias("left"), (F.col("j") == F.col("first")).alias("within"), "n", "marks", "leaves")


def _dealt(rows: DataFrame) -> DataFrame:
    """By group, to as many tasks as a shuffle has: comparing takes longer than the bytes tell."""
    return rows.repartition(width(rows.sparkSession), "node", "i", "j")


class _Block:
    """The documents of one group of two blocks, and which pairs of them are to be compared."""

    def __init__(self, rows: pd.DataFrame, least: int, percent: int):
        self.rows = rows = rows.sort_values("rep").reset_index(drop=True)
        self.rep, self.part, self.left = rows["rep"].to_numpy(), rows["component"].to_numpy().copy(), rows["left"].to_numpy()
        self.n, self.within = rows["n"].to_numpy(), bool(rows["within"].iloc[0])
        self.marks = np.frombuffer(b"".join(rows["marks"]), np.uint8).reshape(-1, WIDTH)
        self.least, self.percent = least, percent

    def alike(self) -> Iterator[tuple[int, int]]:
        """Pairs (i, k), i on the left, of different components that may be similar."""
        left, every = np.flatnonzero(self.left), np.arange(len(self.rep))
        for a in range(0, len(left), 32):
            some = left[a : a + 32, None]
            fits = (self.part != self.part[some]) & (~self.left | (self.within & (every > some)))
            fits &= 100 * np.minimum(self.n, self.n[some]) >= self.percent * np.maximum(self.n, self.n[some])
            i, k = np.nonzero(fits)
            i = left[a + i]
            good = (self.marks[i] == self.marks[k]).sum(1) >= self.least
            yield from zip(i[good].tolist(), k[good].tolist(), strict=True)


def _brought(rows: DataFrame, least: int, percent: int) -> DataFrame:
    """The rows of blocks() of documents that may be similar to another one in their group."""

    def look(rows: pd.DataFrame) -> pd.DataFrame:
        block = _Block(rows, least, percent)
        node, leaves = block.rows["node"].iloc[0], block.rows["leaves"].to_numpy()
        earlier = functools.cache(lambda x: frozenset(v for v in leaves[x] if v < node))
        use = np.zeros(len(block.rep), bool)
        for i, k in block.alike():
            if not (use[i] and use[k]) and earlier(i).isdisjoint(earlier(k)):
                use[i] = use[k] = True
        return block.rows.loc[use].drop(columns="leaves")

    schema = "node long, i int, j int, rep long, component long, left boolean, within boolean, n long, marks binary"
    return _dealt(rows).groupBy("node", "i", "j").applyInPandas(look, schema)


def _linked(rows: DataFrame, sets: DataFrame, least: int, percent: int) -> DataFrame:
    """Links (a, b) of the groups, on full sets; as many as join what is similar and no more."""

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        block = _Block(rows, least, percent)
        sets = [np.asarray(x) for x in block.rows["set"]]
        _, every = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum([len(x) for x in sets])
        begins = ends - [len(x) for x in sets]
        seen, last = np.zeros(int(every.max()) + 1, bool), None
        a, b = [], []
        for i, k in block.alike():
            if block.part[i] == block.part[k]:
                continue
            if i != last:
                seen[:] = False
                seen[every[begins[i] : ends[i]]] = True
                last = i
            common = int(np.count_nonzero(seen[every[begins[k] : ends[k]]]))
            if 100 * common >= percent * (len(sets[i]) + len(sets[k]) - common):
                a.append(block.rep[i])
                b.append(block.rep[k])
                block.part[block.part == block.part[k]] = block.part[i]
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    return _dealt(rows.join(sets, "rep")).groupBy("node", "i", "j").applyInPandas(link, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents link when their sets share percent / 100 of their union; component_id is the smallest
    doc_id reachable. Equal sets are one document to the trees. Empty sets link with nothing. Rows
    with a null doc_id link with nothing and are kept, with a null component.
    """
    rows = staged(describe(docs, words), "signatures")
    full = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    groups = full.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min(F.struct("signature", "marks", F.col("n_shingles").alias("n"))).alias("of"))
    groups = groups.select("set_key", "rep", "of.*")
    # a doc_id with several texts stands for all of them
    groups = staged(groups, "sets")
    reps = groups.select("rep", "signature", "marks", "n")
    chance = 1.0 / (percent / 100.0 * WIDTH)
    share = percent / 100.0
    least = int(WIDTH * (share - SLACK * (share * (1 - share) / WIDTH) ** 0.5))
    known = _Confirmed(docs, words, percent)
    # large nodes are settled as they are found, then every other node's documents meet its pivots
    nodes = trees(reps, chance, lambda large: known.confirm(_pivot_pairs(large, reps, least, percent)))
    components = known.confirm(_pivot_pairs(nodes.where("NOT settled"), reps, least, percent))

    # then the leaves, whatever is not connected yet
    rest = staged(_brought(blocks(nodes, reps, components), least, percent), "blocks")
    if not rest.isEmpty():
        known.need(rest.select("rep").distinct())
        components = known.add(_linked(rest, known.sets, least, percent))

    named = groups.select("set_key", "rep").join(components.withColumnRenamed("id", "rep"), "rep", "left").select(
        "set_key", F.coalesce("component", "rep").alias("component")
    )
    out = rows.join(named, "set_key", "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
