"""Removal of repeated passages by external induced sorting of suffixes.

A string of SPAN bytes that also starts in a document with a smaller id is removed. The suffixes
that are sorted are those at anchors: the place of the least KEY-byte hash of every window, so
that each window of SPAN bytes holds an anchor, the same one wherever it stands. All other
suffixes are induced from them.

1. Documents are packed into chunks (a row each) with the places of their anchors, and staged.
2. Keys of the anchors are dealt by value; those in one document only are done with. What is
   shared goes back to the chunks.
3. For shared keys a chunk sends suffix tuples: up to REACH bytes before the anchor, SPAN from it
   on, and the smallest document that has just this (equal ones in a chunk are one tuple). They
   are dealt by key; a task holds them in sorted runs on disk, and a queue over the runs gives
   them back in the order of their suffixes, block by block, with the common prefixes of
   neighbours.
4. From that order the suffixes one byte further left are induced, then those left of them, to
   REACH bytes: two have their next SPAN bytes in common if they have the same bytes up to the
   anchor, and the common prefix from it reaches far enough. Each such class has its smallest
   document.
5. The answers go back to the chunks, which cut their texts.

Answers to a chunk are files in the shared folder, under the chunk's number; texts are never
shuffled. Runs are in the task's own temporary folder and go when they are merged.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import fresh_path, staged, width
from inkwell.llm.files import exists, read_whole, write_whole

SPAN, KEY = 50, 24
REACH = SPAN - KEY
CHUNK = 4_000_000
BUCKET = 16_000_000
RUN = 300_000
SEGMENT = 1 << 17
LAST_ID = (1 << 63) - 1
_random = np.random.default_rng(3)
BYTE = (_random.integers(1, 1 << 62, 256, np.int64) | 1).astype(np.uint64)
ODD = (_random.integers(1, 1 << 62, 16, np.int64) | 1).astype(np.uint64)
SENT = np.dtype([("right", "u1", SPAN), ("left", "u1", REACH), ("n_left", "u1"), ("n_right", "u1"), ("doc", "<i8")])
TUPLE = np.dtype([*((n, *([SENT[n]] if SENT[n].subdtype is None else [SENT[n].base, SENT[n].shape])) for n in SENT.names), ("row", "<i4"), ("at", "<i4")])


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _stir(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * ODD[14]
    x = x ^ (x >> np.uint64(27))
    x = x * ODD[15]
    return x ^ (x >> np.uint64(31))


def _over(f, x: np.ndarray) -> np.ndarray:
    """f over every window of REACH + 1 values."""
    size = 1
    while size * 2 <= REACH + 1:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (REACH + 1 - size)], x[REACH + 1 - size :]) if size < REACH + 1 else x


def anchors(data: np.ndarray) -> np.ndarray:
    """Places of the least KEY-byte hash of every window of SPAN bytes."""
    flag = np.zeros(len(data), bool)
    for a in range(0, max(len(data) - SPAN + 1, 0), SEGMENT):
        h = BYTE[data[a : a + SEGMENT + SPAN - 1]]
        for k, size in enumerate((1, 2, 4, 8)):
            h = h[:-size] * ODD[k] + h[size:]
            if size == 4:
                eight = h
        h = _stir(h[: len(h) - 8] * ODD[4] + eight[16 : 16 + len(h) - 8])
        least = _over(np.minimum, h)
        edge = np.zeros(REACH, np.uint64)
        flag[a : a + len(h)] |= _over(np.maximum, np.concatenate([edge, least, edge])) == h
    return np.flatnonzero(flag)


class Chunk:
    """Some documents in a row: their bytes, bounds, ids and anchors."""

    def __init__(self, batch: pa.RecordBatch, id_column: int, text_column: int, places: np.ndarray | None = None):
        self.batch = batch
        texts = [b"" if t is None else t.encode() for t in batch.column(text_column).to_pylist()]
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in texts])
        self.begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.ids = np.array([LAST_ID if i is None else i for i in batch.column(id_column).to_pylist()], np.int64)
        if places is None:
            places = anchors(self.data)
            doc = np.searchsorted(self.ends, places, side="right")
            places = places[(places + KEY <= self.ends[doc]) & (self.ends[doc] - self.begins[doc] >= SPAN)]
        self.places = places
        self.doc = np.searchsorted(self.ends, places, side="right")

    def keys(self) -> np.ndarray:
        words = np.ndarray((max(len(self.data) - 7, 0),), "<u8", self.data.tobytes(), strides=(1,))
        return _stir(sum(words[self.places + 8 * k] * ODD[5 + k] for k in range(KEY // 8))) if len(self.places) else np.zeros(0, np.uint64)

    def tuples(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct suffix tuples of the anchors numbered in `shared`, the tuple of each, and the first of each."""
        p, doc = self.places[shared], self.doc[shared]
        padded = np.concatenate([np.zeros(REACH, np.uint8), self.data, np.zeros(SPAN, np.uint8)])
        around = padded[p[:, None] + np.arange(REACH + SPAN)]
        n_left = np.minimum(p - self.begins[doc], REACH)
        n_right = np.minimum(self.ends[doc] - p, SPAN)
        around[:, :REACH][np.arange(REACH) < (REACH - n_left)[:, None]] = 0
        around[:, REACH:][np.arange(SPAN) >= n_right[:, None]] = 0
        wide = np.zeros((len(p), 80), np.uint8)
        wide[:, : REACH + SPAN] = around
        wide[:, 76], wide[:, 77] = n_left, n_right
        h = np.zeros(len(p), np.uint64)
        for k, word in enumerate(wide.view("<u8").T):
            h = _stir(h * ODD[3] + word * ODD[k] + np.uint64(k))
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        least = np.full(len(first), LAST_ID, np.int64)
        np.minimum.at(least, which, self.ids[doc])
        out = np.zeros(len(first), TUPLE)
        out["left"], out["right"] = around[first, :REACH], around[first, REACH:]
        out["n_left"], out["n_right"], out["doc"] = n_left[first], n_right[first], least
        return out, which, first


def _sent(x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), SENT)
    for name in SENT.names:
        out[name] = x[name]
    return out


# --- sorted runs and induction -------------------------------------------


def _by_suffix(x: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(x), 56), np.uint8)
    wide[:, :SPAN] = x["right"]
    return np.lexsort(wide.view(">u8").astype(np.uint64).T[::-1])


def _text(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x["right"]).view(f"S{SPAN}").ravel()


class SuffixQueue:
    """A disk-backed queue of suffix tuples: sorted runs, given back in order block by block."""

    def __init__(self, run: int = RUN, block: int = 1 << 15):
        self.run, self.block, self.held, self.n, self.files = run, block, [], 0, []
        self.folder = None

    def push(self, x: np.ndarray) -> None:
        self.held.append(x)
        self.n += len(x)
        if self.n >= self.run:
            self._spill()

    def _sorted(self) -> np.ndarray:
        x = np.concatenate(self.held) if self.held else np.zeros(0, TUPLE)
        self.held, self.n = [], 0
        return x[_by_suffix(x)]

    def _spill(self) -> None:
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="runs-")
        self.files.append(os.path.join(self.folder.name, f"{len(self.files)}.run"))
        self._sorted().tofile(self.files[-1])

    def blocks(self) -> Iterator[np.ndarray]:
        """Sorted blocks; suffixes that share KEY bytes are never parted."""
        if not self.files:
            if self.n:
                yield self._sorted()
            return
        self._spill()
        sizes = [os.path.getsize(f) // TUPLE.itemsize for f in self.files]
        heads = [np.zeros(0, TUPLE)] * len(sizes)
        read = [0] * len(sizes)
        kept = np.zeros(0, TUPLE)
        while True:
            for k, size in enumerate(sizes):
                if not len(heads[k]) and read[k] < size:
                    heads[k] = np.fromfile(self.files[k], TUPLE, min(self.block, size - read[k]), offset=read[k] * TUPLE.itemsize)
                    read[k] += len(heads[k])
            more = [_text(h[-1:])[0] for k, h in enumerate(heads) if len(h) and read[k] < sizes[k]]
            if not any(len(h) for h in heads):
                break
            if more:  # what lies behind the least last tuple may still be preceded by unread ones
                least = min(more)
                cut = [int(np.searchsorted(_text(h), least, side="right")) if len(h) else 0 for h in heads]
            else:
                cut = [len(h) for h in heads]
            x = np.concatenate([kept, *[h[:c] for h, c in zip(heads, cut, strict=True)]])
            heads = [h[c:] for h, c in zip(heads, cut, strict=True)]
            x = x[_by_suffix(x)]
            open_group = (x["right"][:, :KEY] == x["right"][-1, :KEY]).all(1) if more else np.zeros(len(x), bool)
            kept = x[open_group]
            if not open_group.all():
                yield x[~open_group]
        if len(kept):
            yield kept
        self.close()

    def close(self) -> None:
        if self.folder is not None:
            self.folder.cleanup()
            self.folder, self.files = None, []


def common_prefix(x: np.ndarray) -> np.ndarray:
    """Bytes that each sorted suffix has in common with the one before (0 for the first)."""
    same = x["right"][1:] == x["right"][:-1]
    return np.concatenate([[0], np.where(same.all(1), SPAN, same.argmin(1))])


def induce(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For tuples in the order of their suffixes: the smallest document with the very tuple, and
    bits: bit a is set if the SPAN bytes from a places left of the anchor are in a smaller one."""
    prefix = common_prefix(x)
    doc = x["doc"]

    def least(name: np.ndarray, at: np.ndarray) -> np.ndarray:
        order = np.argsort(name)
        ranked = name[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        values = np.minimum.reduceat(doc[at][order], first)
        out = np.empty(len(at), np.int64)
        out[order] = np.repeat(values, np.diff(np.append(first, len(at))))
        return out

    before = np.zeros(len(x), np.uint64)
    names = []
    for a in range(REACH + 1):
        if a:  # one byte further left, named from the byte and the name to its right
            before = before * ODD[0] + x["left"][:, REACH - a] + np.uint64(1)
        names.append(_stir(np.cumsum(prefix < SPAN - a).astype(np.uint64) * ODD[1] + _stir(before)))
    every = np.arange(len(x))
    whole = np.cumsum(prefix < SPAN).astype(np.uint64)
    ends = x["n_left"].astype(np.uint64) * np.uint64(64) + x["n_right"].astype(np.uint64)
    own = least(_stir(whole * ODD[1] + _stir(before)) + ends * ODD[2], every)
    bits = np.zeros(len(x), np.uint32)
    for a, name in enumerate(names):
        at = np.flatnonzero((x["n_left"] >= a) & (x["n_right"] >= SPAN - a))
        if len(at):
            bits[at] |= (least(name[at], at) < own[at]).astype(np.uint32) << np.uint32(a)
    return own, bits


# --- Spark ---------------------------------------------------------------


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every row with its text cut and n_bytes, n_removed, n_spans, kept_sha256 added.

    Matches are on the UTF-8 bytes of the input; what is left is joined. In the text column bytes
    that are half of a cut character are left out, while kept_sha256 is over all remaining bytes.
    A null text is empty and comes back null. Rows with a null id count as the last document;
    rows of equal id are one document to each other: they never remove from each other.
    Existing columns of the added names are replaced.
    """
    spark = docs.sparkSession
    added = {"n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    names = [c for c in docs.columns if c not in added]
    docs = docs.select(*[F.col(f"`{c}`") for c in names]).withColumn(doc_id, F.col(f"`{doc_id}`").cast("long"))
    id_column, text_column = names.index(doc_id), names.index(text)
    folder = fresh_path(spark, "repeats")

    def chunk(batches):
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def pack():
            table = pa.Table.from_batches(held).combine_chunks()
            batch = table.to_batches()[0]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            made = Chunk(batch, id_column, text_column)
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([len(made.data)], pa.int64()),
                 pa.array([zstandard.ZstdCompressor(level=1).compress(sink.getvalue())], pa.binary()),
                 pa.array([_packed(np.diff(made.places, prepend=0).astype("<u4"))], pa.binary())],
                ["chunk", "n_bytes", "rows", "places"],
            )

        for batch in batches:
            sizes = np.cumsum([len(t or "") for t in batch.column(text_column).to_pylist()])
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK - size)))
                to = min(to, batch.num_rows)
                held.append(batch.slice(at, to - at))
                size += int(sizes[to - 1] - (sizes[at - 1] if at else 0))
                at = to
                if size >= CHUNK * 0.9:
                    yield pack()
                    held, size, number = [], 0, number + 1
        if held:
            yield pack()

    chunks = staged(docs.mapInArrow(chunk, "chunk long, n_bytes long, rows binary, places binary"), "chunks")
    total = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    parts = max(width(spark), -(-total // BUCKET))
    high = max(4, int(parts - 1).bit_length())  # buckets: 2 ** high

    def opened(batch: pa.RecordBatch) -> Iterator[tuple[int, Chunk]]:
        for number, rows, places in zip(*(batch.column(c).to_pylist() for c in ("chunk", "rows", "places")), strict=True):
            with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(rows)) as stream:
                inner = stream.read_next_batch()
            yield number, Chunk(inner, id_column, text_column, np.cumsum(_unpacked(places, "<u4")).astype(np.int64))

    def bucket_of(keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - high)).astype(np.int64)

    def short(keys: np.ndarray) -> np.ndarray:
        """Bucket and 40 bits more: enough to tell keys apart before texts are compared."""
        return keys >> np.uint64(24 - high)

    def dealt(number: int, bucket: np.ndarray, blobs) -> pa.RecordBatch:
        """Rows (bucket, chunk, data) for sorted buckets; blobs(a, b) packs the items from a to b."""
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        ends = np.append(first, len(bucket))
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[first], pa.int64()), pa.array(np.full(len(first), number), pa.int64()),
             pa.array([blobs(a, b) for a, b in zip(ends, ends[1:], strict=False)], pa.binary())], ["bucket", "chunk", "data"],
        )

    deal = "bucket long, chunk long, data binary"

    def send_keys(batches):
        for batch in batches:
            for number, part in opened(batch):
                keys = short(part.keys())
                order = np.lexsort((part.doc, keys))
                keys, doc = keys[order], part.ids[part.doc[order]]
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
                if not len(first):
                    continue
                several = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
                keys = keys[first]
                low = np.ascontiguousarray((keys & np.uint64((1 << 40) - 1)).view("u1").reshape(-1, 8)[:, :5])
                yield dealt(number, (keys >> np.uint64(40)).astype(np.int64), lambda a, b: low[a:b].tobytes() + np.packbits(several[a:b]).tobytes())

    def shared_keys(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys, flags, sizes = [], [], []
        for data in table.column("data").to_pylist():
            n = next(k for k in range(len(data) // 6, len(data) // 5 + 1) if 5 * k + (k + 7) // 8 == len(data))
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :5] = np.frombuffer(data, np.uint8, 5 * n).reshape(n, 5)
            keys.append(wide.view("<u8").ravel())
            flags.append(np.unpackbits(np.frombuffer(data, np.uint8, offset=5 * n), count=n).astype(bool))
            sizes.append(n)
        every, flag = np.concatenate(keys), np.concatenate(flags)
        order = np.argsort(every)
        ranked = every[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        count = np.diff(np.append(first, len(ranked)))
        good = np.empty(len(every), bool)
        good[order] = np.repeat((count > 1) | np.logical_or.reduceat(flag[order], first), count)
        ends = np.cumsum(sizes)
        out = [every[b - n : b][good[b - n : b]] | np.uint64(bucket << 40) for n, b in zip(sizes, ends, strict=True)]
        return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "data": pa.array([_packed(np.sort(o)) for o in out], pa.binary())})

    def answered(kind: str):
        """Gather what goes to one chunk into its file."""

        def write(table: pa.Table) -> pa.Table:
            table = table.sort_by("bucket")
            sink = pa.BufferOutputStream()
            with pa.ipc.new_file(sink, table.schema) as out:
                out.write_table(table)
            number = table.column("chunk")[0].as_py()
            write_whole(f"{folder}/{kind}-{number}", sink.getvalue().to_pybytes())
            return pa.table({"chunk": pa.array([number], pa.int64())})

        return write

    def answer(kind: str, number: int) -> list[bytes]:
        found = f"{folder}/{kind}-{number}"
        return pa.ipc.open_file(pa.py_buffer(read_whole(found))).read_all().column("data").to_pylist() if exists(found) else []

    def post(rows: DataFrame, kind: str) -> None:
        rows.groupBy("chunk").applyInArrow(answered(kind), "chunk long").count()

    source = chunks.select("chunk", "rows", "places")
    shared = source.mapInArrow(send_keys, deal).groupBy("bucket").applyInArrow(shared_keys, deal)
    post(shared, "keys")

    def of_chunk(number: int, part: Chunk):
        """Numbers of the anchors whose keys are shared, and their tuples in order of key."""
        some = answer("keys", number)
        known = np.concatenate([_unpacked(s, "<u8") for s in some]) if some else np.zeros(0, np.uint64)
        keys = part.keys()
        mine = short(keys)
        at = np.searchsorted(known, mine)
        at = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == mine) if len(known) else np.zeros(0, np.int64)
        if not len(at):
            return at, np.zeros(0, TUPLE), at, np.zeros(0, np.uint64)
        found, which, first = part.tuples(at)
        own = keys[at][first]
        order = np.lexsort((np.arange(len(own)), own))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return at, found[order], place[which], own[order]

    def send_tuples(batches):
        for batch in batches:
            for number, part in opened(batch):
                _, found, _, own = of_chunk(number, part)
                yield dealt(number, bucket_of(own), lambda a, b: int(a).to_bytes(4, "little") + _packed(_sent(found[a:b])))

    def sort_and_induce(batches):
        queue, bucket, numbers = SuffixQueue(), None, []

        def answers():
            parts = [(x["row"].copy(), x["at"].copy(), *induce(x)) for x in queue.blocks()]
            if not parts:
                return
            row, at, own, bits = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((at, row))
            row, at, own, bits = row[order], at[order], own[order], bits[order]
            cut = np.append(np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])), len(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cut) - 1, bucket), pa.int64()), pa.array([numbers[row[a]] for a in cut[:-1]], pa.int64()),
                 pa.array([_packed(np.concatenate([own[a:b].view("u1"), bits[a:b].view("u1")])) for a, b in zip(cut, cut[1:], strict=False)], pa.binary())],
                ["bucket", "chunk", "data"],
            )

        for batch in batches:
            for b, number, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if b != bucket:
                    if bucket is not None:
                        yield from answers()
                    queue, bucket, numbers = SuffixQueue(), b, []
                sent = _unpacked(data[4:], SENT)
                x = np.empty(len(sent), TUPLE)
                for name in SENT.names:
                    x[name] = sent[name]
                x["row"] = len(numbers)
                x["at"] = np.arange(len(x)) + int.from_bytes(data[:4], "little")
                numbers.append(number)
                queue.push(x)
        if bucket is not None:
            yield from answers()

    tuples = source.mapInArrow(send_tuples, deal).repartition(1 << high, "bucket").sortWithinPartitions("bucket")
    post(tuples.mapInArrow(sort_and_induce, deal), "answers")

    def cut(batches):
        for batch in batches:
            for number, part in opened(batch):
                start = np.zeros(len(part.data) + 1, bool)
                some = answer("answers", number)
                if some:
                    at, found, which, _ = of_chunk(number, part)
                    own, bits = [], []
                    for data in some:
                        raw = _unpacked(data, "u1")
                        n = len(raw) // 12
                        own.append(raw[: 8 * n].view("<i8"))
                        bits.append(raw[8 * n :].view("<u4"))
                    own, bits = np.concatenate(own), np.concatenate(bits)
                    p, doc = part.places[at], part.ids[part.doc[at]]
                    mine = np.where(doc > own[which], np.uint32((1 << (REACH + 1)) - 1), bits[which])
                    n_left, n_right = found["n_left"][which], found["n_right"][which]
                    for a in range(REACH + 1):
                        hit = (((mine >> np.uint32(a)) & np.uint32(1)) > 0) & (n_left >= a) & (n_right >= SPAN - a)
                        start[p[hit] - a] = True
                open_until = np.cumsum(start[:-1], dtype=np.int32)
                gone = open_until.copy()
                gone[SPAN:] -= open_until[:-SPAN]
                gone = gone > 0
                edge = gone.copy()
                edge[1:] &= ~gone[:-1]
                edge[part.begins[part.begins < len(gone)]] = gone[part.begins[part.begins < len(gone)]]
                kept, removed, spans, digests = [], [], [], []
                del open_until, start
                sums, edges = (np.concatenate([np.zeros(1, np.int32), np.cumsum(x, dtype=np.int32)]) for x in (gone, edge))
                missing = part.batch.column(text_column).is_null().to_pylist()
                for a, b, null in zip(part.begins.tolist(), part.ends.tolist(), missing, strict=True):
                    n = int(sums[b] - sums[a])
                    left = part.data[a:b][~gone[a:b]].tobytes() if n else part.data[a:b].tobytes()
                    removed.append(n)
                    spans.append(int(edges[b] - edges[a]))
                    digests.append(hashlib.sha256(left).hexdigest())
                    kept.append(None if null else left.decode("utf-8", "ignore"))
                columns = [part.batch.column(i) if i != text_column else pa.array(kept, pa.string()) for i in range(len(names))]
                columns += [pa.array(part.ends - part.begins, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*names, *added])

    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{c}` {types[c]}" for c in names] + [f"{c} {t}" for c, t in added.items()])
    return source.mapInArrow(cut, schema)
