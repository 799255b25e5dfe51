"""Periodic runs of words: maximal pairs of a bottom-up LCP-interval tree whose distance makes them runs."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
#: Texts are worked on together up to so many bytes; a longer text is worked on alone.
PIECE_BYTES = 4 << 20
FEW_CLASSES = 4


class Group:
    """Positions that share the words of an interval, in order, whole and by the word on their left."""

    __slots__ = ("every", "by_left")

    def __init__(self, position: int, left: int):
        self.every = [position]
        self.by_left = {left: [position]}

    def others(self, left: int, low: int, high: int) -> Iterator[int]:
        """Positions from low to high behind another word than `left`.

        Occurrences of a string within its own length of each other form few chains, in each of which
        all but the first have the same word before them. So either few words or few positions are
        asked: a text of n words costs about n log n steps, at most their product with the root of n.
        """
        if len(self.by_left) > FEW_CLASSES:
            start, end = bisect_left(self.every, low), bisect_right(self.every, high)
            if end - start <= len(self.by_left):
                same = self.by_left.get(left, ())
                for position in self.every[start:end]:
                    at = bisect_left(same, position)
                    if at == len(same) or same[at] != position:
                        yield position
                return
        for word, positions in self.by_left.items():
            if word != left:
                yield from positions[bisect_left(positions, low) : bisect_right(positions, high)]


def meet(a: Group, b: Group, shared: int, least: int, found: dict[tuple[int, int], int]) -> Group:
    """Join two children of an interval of `shared` words. A pair of positions from both behind different words
    is a maximal pair; if its distance is at most `shared`, both copies together have that period and
    no neighbour keeps it. Multiples of the smallest period give the same stretch, so the least one stays."""
    if len(a.every) < len(b.every):
        a, b = b, a
    for left, positions in b.by_left.items():
        for x in positions:
            for y in a.others(left, x - shared, x + shared):
                start, period = (x, y - x) if x < y else (y, x - y)
                if period + shared >= least:
                    stretch = (start, start + period + shared)
                    if period < found.get(stretch, period + 1):
                        found[stretch] = period
    for left, positions in b.by_left.items():
        into = a.by_left.setdefault(left, [])
        for x in positions:
            insort(into, x)
            insort(a.every, x)
    return a


def runs_of_intervals(suffixes: list[int], shared: list[int], lefts: list[int], least: int, found: dict[tuple[int, int], int]) -> None:
    """Walk the LCP intervals of sorted suffixes bottom-up; shared[k] belongs to suffixes k and k + 1."""
    open_intervals: list[list] = []
    group = Group(suffixes[0], lefts[0])
    for k, height in enumerate([*shared, 0]):
        while open_intervals and open_intervals[-1][0] > height:
            depth, first = open_intervals.pop()
            group = meet(first, group, depth, least, found)
        if k == len(shared):
            break
        if open_intervals and open_intervals[-1][0] == height:
            open_intervals[-1][1] = meet(open_intervals[-1][1], group, height, least, found)
        else:
            open_intervals.append([height, group])
        group = Group(suffixes[k + 1], lefts[k + 1])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _with_repeats(ids: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Which texts hold the same `width` words twice behind different words; others cannot hold a run.
    Hashes only choose the texts that are sorted: equal hashes by chance choose one too many."""
    chosen = np.zeros(len(lengths), bool)
    if len(ids) < width:
        return chosen
    text = np.repeat(np.arange(len(lengths)), lengths)
    left = np.concatenate([[-1], ids[:-1]])
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    left[starts] = -1
    values, count = _mixed(ids), len(ids) - width + 1
    key = _mixed(text[:count])
    for k in range(width):
        key = key * np.uint64(0x100000001B3) + values[k : k + count]
    inside = np.flatnonzero(text[:count] == text[width - 1 :])
    order = inside[np.argsort(key[inside])]
    same = (key[order[1:]] == key[order[:-1]]) & (left[order[1:]] != left[order[:-1]])
    chosen[text[order[1:][same]]] = True
    return chosen


def sorted_suffixes(ids: np.ndarray, ends: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of texts laid end to end, sorted within each text by doubling, and the words that neighbours share.

    Ranks of every doubling are kept: four bytes a word for each doubling of the longest repeat."""
    n = len(ids)
    at = np.arange(n)
    levels = [np.unique(text.astype(np.int64) * (int(ids.max()) + 1) + ids, return_inverse=True)[1].astype(np.int32)]
    step = 1
    while int(levels[-1].max()) + 1 < n:
        last = levels[-1].astype(np.int64)
        after = np.where(at + step < ends, last[np.minimum(at + step, n - 1)] + 1, 0)
        levels.append(np.unique(last * (n + 1) + after, return_inverse=True)[1].astype(np.int32))
        step *= 2
    order = np.empty(n, np.int64)
    order[levels[-1]] = at
    a, b = order[:-1].copy(), order[1:].copy()
    end_a, end_b = ends[a], ends[b]
    shared = np.zeros(n - 1, np.int64)
    live = np.flatnonzero(text[a] == text[b])
    for depth in range(len(levels) - 1, -1, -1):
        going = live[(a[live] < end_a[live]) & (b[live] < end_b[live])]
        equal = going[levels[depth][a[going]] == levels[depth][b[going]]]
        a[equal] += 1 << depth
        b[equal] += 1 << depth
        shared[equal] += 1 << depth
    return order, shared


def find(ids: np.ndarray, lengths: np.ndarray, least: int) -> dict[int, list[tuple[int, int, int]]]:
    """Runs by text: (start, length, period), by start and then period; texts without runs are left out.
    A pair within its shared length that covers `least` words shares at least half of them, so shorter intervals are never opened."""
    width = max((least + 1) // 2, 1)
    chosen = _with_repeats(ids, lengths, width)
    if not chosen.any():
        return {}
    picked = chosen[np.repeat(np.arange(len(lengths)), lengths)]
    sizes, names = lengths[chosen], np.flatnonzero(chosen)
    ids = ids[picked].astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)[text]
    order, shared = sorted_suffixes(ids, ends, text)
    left = np.concatenate([[-1], ids[:-1]])
    left[np.cumsum(sizes) - sizes] = -1
    left = left[order]
    deep = shared >= width
    edge = np.flatnonzero(np.diff(np.concatenate([[0], deep.astype(np.int8), [0]])))
    changes = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])])
    found: dict[tuple[int, int], int] = {}
    for low, high in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if changes[high] > changes[low]:  # behind one word alone no pair is maximal
            runs_of_intervals(order[low : high + 1].tolist(), shared[low:high].tolist(), left[low : high + 1].tolist(), least, found)
    base = np.cumsum(sizes) - sizes
    out: dict[int, list[tuple[int, int, int]]] = {}
    for (start, end), period in found.items():
        k = text[start]
        out.setdefault(int(names[k]), []).append((int(start - base[k]), end - start, period))
    return {k: sorted(v, key=lambda r: (r[0], r[2])) for k, v in out.items()}


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts one after another, and how many each has."""
    lists = pc.split_pattern_regex(pc.utf8_trim(pc.fill_null(texts, ""), BLANKS), SPACE)
    values, offsets = lists.flatten(), lists.offsets.to_numpy()
    full = pc.greater(pc.binary_length(values), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return values.filter(full), np.diff(before[offsets - offsets[0]])


def _piece(texts: pa.Array, least: int) -> tuple[list[int], list[list[dict]], pa.Array]:
    words, lengths = words_of(texts)
    ids = words.dictionary_encode().indices.to_numpy()
    found = find(ids, lengths, least)
    keep = np.ones(len(words), bool)
    starts = np.cumsum(lengths) - lengths
    for k, runs in found.items():
        covered = np.zeros(int(lengths[k]) + 1, np.int64)
        for start, length, period in runs:
            covered[start + period] += 1
            covered[start + length] -= 1
        keep[starts[k] : starts[k] + lengths[k]] = np.cumsum(covered)[:-1] == 0
    kept = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([starts, [len(words)]])]
    left_over = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words.filter(pa.array(keep)))
    runs = [[{"start": a, "length": b, "period": c} for a, b, c in found.get(k, ())] for k in range(len(lengths))]
    return lengths.tolist(), runs, pc.binary_join(left_over, " ")


def word_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """Per row its key, n_words long, runs (start, length, period of each; by start, then period) and collapsed text.

    A run is a stretch of at least `least` words, and of twice its smallest period, that no neighbouring word
    extends. The collapsed text keeps each run's first period only, words joined by one blank. A null or
    empty text has no words, no runs and an empty collapsed text. Rows are answered one by one, so repeated or
    null keys and equal texts need no care, and nothing is shuffled; other columns are not read.
    """
    schema = StructType([docs.schema[key], *StructType.fromDDL("n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string").fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            texts, done = batch.column(1), 0
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            while done < len(texts):
                used = sizes[done - 1] if done else 0
                upto = max(int(np.searchsorted(sizes, used + PIECE_BYTES, "right")), done + 1)
                lengths, runs, collapsed = _piece(texts.slice(done, upto - done), least)
                columns = [batch.column(0).slice(done, upto - done), lengths, runs, collapsed]
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
                )
                done = upto

    return docs.select(docs[key], docs[text].cast(StringType())).mapInArrow(run, schema)
