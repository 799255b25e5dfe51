"""SentencePiece encoding and decoding by suffix-array matching.

The distinct units of a batch (runs of word marks with what follows) are joined to one text and
its suffixes are sorted. Each piece of the vocabulary is found by binary search in the sorted
suffixes: a range, whose suffixes are all its occurrences. The occurrences are edges over the
text; sorted by position, they are relaxed. The model's kind is BPE: an edge becomes a symbol
when both halves are symbols, and the best piece goes first. So edges are relaxed piece by piece
from a queue by rank; a piece whose edges joined symbols puts the pieces it is half of back.
Result: the ids of the model's own encoder. Characters outside the vocabulary become bytes.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
MARK_BYTE = b"\xfd"  # stands for the mark in matched text; UTF-8 holds neither it nor 0xFE
SLICE = 2_000_000
CACHE_UNITS = 100_000
CACHE_LENGTH = 64
_worker: dict = {}


class Pieces:
    """The vocabulary of a model file: pieces, ranks, and which pieces a piece can be half of."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte_id = np.full(256, model.unk_id(), np.int64)
        self.text: dict[int, str] = {}
        normal = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.text[i] = piece
                normal.append((-model.get_score(i), i, piece))
        self.of = {piece: i for _, i, piece in normal}
        self.single = {piece: i for piece, i in self.of.items() if len(piece) == 1}
        # longer pieces, best first
        normal = [x for x in sorted(normal) if len(x[2]) > 1]
        self.merged = [piece for _, _, piece in normal]
        self.merged_id = np.array([i for _, i, _ in normal], np.int64)
        rank = {piece: r for r, piece in enumerate(self.merged)}
        self.above: list[list[int]] = [[] for _ in self.merged]
        for r, piece in enumerate(self.merged):
            for cut in range(1, len(piece)):
                for half in {piece[:cut], piece[cut:]}:
                    other = piece[cut:] if half == piece[:cut] else piece[:cut]
                    if half in rank and other in self.of:
                        self.above[rank[half]].append(r)
        self.keys = [p.encode().replace(MARK.encode(), MARK_BYTE) for p in self.merged]
        self.sizes = np.array([len(k) for k in self.keys], np.int64)
        self.low, self.high = _number(self.keys, 0), _number(self.keys, 255)
        self.deep = np.flatnonzero(self.sizes > 8)
        self.deep_low = _number([k[8:] for k in self.keys], 0)
        self.deep_high = _number([k[8:] for k in self.keys], 255)
        self.bytes_of = [self.text[i].replace(MARK, " ").encode() if i in self.text else b"" for i in range(n)]
        for b, i in enumerate(self.byte_id.tolist()):
            if i != model.unk_id():
                self.bytes_of[i] = bytes([b])


def pieces(path: str) -> Pieces:
    if _worker.get("path") != path:
        _worker.update(path=path, pieces=Pieces(path), cache={})
    return _worker["pieces"]


def _number(heads: list[bytes], fill: int) -> np.ndarray:
    """The first 8 bytes of each as a big-endian number, shorter ones filled up."""
    return np.array([int.from_bytes((h + bytes([fill]) * 8)[:8], "big") for h in heads], np.uint64)


def suffix_order(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The suffixes of data sorted by their first bytes (data ends with 16 zero bytes).

    Returns their order, the sorted first 8 bytes as numbers, the sorted second keys (the number
    of the run of equal first 8 bytes, with the bytes after them below it), and the bits that the
    number takes: 24 of 64, more in a text of over 16 M bytes.
    """
    raw = data.tobytes()
    n = len(raw) - 15
    first = np.ndarray((n,), ">u8", raw, strides=(1,)).astype(np.uint64)
    order = np.argsort(first)
    heads = first[order]
    run = np.cumsum(np.concatenate([[False], heads[1:] != heads[:-1]])).astype(np.uint64)
    bits = max(24, int(run[-1]).bit_length())
    tail = np.ndarray((n,), ">u8", raw, offset=8, strides=(1,)).astype(np.uint64)[order] >> np.uint64(bits)
    second = (run << np.uint64(64 - bits)) | tail
    again = np.argsort(second)
    return order[again], heads, second[again], bits


def occurrences(vocabulary: Pieces, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges: for each longer piece, the sorted positions where it begins, all in a row, and the
    bounds of each piece's part. Two binary searches a piece give its range of suffixes."""
    order, heads, second, bits = suffix_order(data)
    low, high = np.searchsorted(heads, vocabulary.low, "left"), np.searchsorted(heads, vocabulary.high, "right")
    runs = second >> np.uint64(64 - bits)
    deep = vocabulary.deep
    there = deep[(high > low)[deep]]
    run = runs[low[there]] << np.uint64(64 - bits)
    low[there] = np.searchsorted(second, run | (vocabulary.deep_low[there] >> np.uint64(bits)), "left")
    high[there] = np.searchsorted(second, run | (vocabulary.deep_high[there] >> np.uint64(bits)), "right")
    counts = np.maximum(high - low, 0)
    ends = np.cumsum(counts)
    at = np.repeat(low - (ends - counts), counts) + np.arange(int(counts.sum()))
    size = np.uint64(len(data))
    both = np.sort(np.repeat(np.arange(len(counts), dtype=np.uint64), counts) * size + order[at].astype(np.uint64))
    piece, start = (both // size).astype(np.int64), (both % size).astype(np.int64)
    far = np.flatnonzero(vocabulary.sizes[piece] > 8 + (64 - bits) // 8)
    if len(far):  # compare what lies beyond the sorted depth
        raw, keys = data.tobytes(), vocabulary.keys
        good = np.ones(len(start), bool)
        good[far] = [raw.startswith(keys[p], s) for p, s in zip(piece[far].tolist(), start[far].tolist(), strict=True)]
        start, piece = start[good], piece[good]
    return start, np.searchsorted(piece, np.arange(len(counts) + 1))


def encode_units(units: list[str], vocabulary: Pieces) -> list[np.ndarray]:
    """Ids of each unit. Units are matched on one joined text, parted by bytes that no piece holds."""
    raw = b"\xfe".join([u.encode() for u in units]) + b"\xfe"
    raw = raw.replace(b"\0", b"\x01").replace(MARK.encode(), MARK_BYTE)
    data = np.frombuffer(raw + b"\0" * 16, np.uint8)
    n = len(raw)
    edges, cut = occurrences(vocabulary, data)
    # symbols: at first the characters
    inner = (data[:n] & 0xC0) == 0x80
    begins = np.flatnonzero(~inner)
    after = np.zeros(n + 1, np.int64)  # where the symbol that begins here ends; 0: none begins here
    after[begins] = np.concatenate([begins[1:], [n]])
    label = np.full(n, -1, np.int64)  # rank of the piece; -1: a character
    sizes, above = vocabulary.sizes, vocabulary.above
    queue = [r for r in range(len(sizes)) if cut[r + 1] > cut[r]]
    waiting = np.zeros(len(sizes), bool)
    waiting[queue] = True
    heapq.heapify(queue)
    while queue:
        r = heapq.heappop(queue)
        waiting[r] = False
        start = edges[cut[r] : cut[r + 1]]
        middle = after[start]
        end = start + sizes[r]
        fits = (middle > 0) & (middle < end)
        fits[fits] = after[middle[fits]] == end[fits]
        start, middle, end = start[fits], middle[fits], end[fits]
        if not len(start):
            continue
        if len(start) > 1 and (start[1:] < end[:-1]).any():  # the same piece overlaps itself: from the left
            take, free = [], 0
            for k, s in enumerate(start.tolist()):
                if s >= free:
                    take.append(k)
                    free = s + int(sizes[r])
            start, middle, end = start[take], middle[take], end[take]
        after[middle] = 0
        after[start] = end
        label[start] = r
        for up in above[r]:
            if not waiting[up] and cut[up + 1] > cut[up]:
                waiting[up] = True
                heapq.heappush(queue, up)
    # symbols to ids, units parted at their separators
    symbol = np.flatnonzero(after[:n] > 0)
    kind = label[symbol]
    parts: list[list[int]] = []
    ids = np.where(kind >= 0, vocabulary.merged_id[np.maximum(kind, 0)], -1)
    plain = np.flatnonzero(kind < 0)
    stops = symbol[plain][data[symbol[plain]] == 0xFE]
    own = ids.tolist()
    spread: dict[int, list[int]] = {}
    single, byte_id = vocabulary.single, vocabulary.byte_id
    for k in plain.tolist():
        p = symbol[k]
        character = raw[p : after[p]]
        if character == b"\xfe":
            continue
        known = single.get(MARK if character == MARK_BYTE else character.decode())
        if known is not None:
            own[k] = known
        else:
            spread[k] = [int(byte_id[b]) for b in (MARK.encode() if character == MARK_BYTE else character)]
    bounds = np.searchsorted(symbol, stops).tolist()
    first = 0
    widened = set(np.searchsorted(bounds, list(spread), side="right").tolist())
    for number, (unit, last) in enumerate(zip(units, bounds, strict=True)):
        if number in widened:
            some: list[int] = []
            for k in range(first, last):
                some.extend(spread.get(k, (own[k],)))
        else:
            some = own[first:last]
        if "\0" in unit:  # matched as \x01, which is a byte as well
            one = single.get("\x01", int(byte_id[1]))
            some = _zero_bytes(unit, some, one, int(byte_id[0]))
        parts.append(some)
        first = last + 1
    return [np.array(p, "<i4") for p in parts]


def _zero_bytes(unit: str, ids: list[int], one: int, zero: int) -> list[int]:
    """Put the id of byte 0 where a NUL was matched as byte 1, of which no piece but itself has any."""
    wanted = iter([c == "\0" for c in unit if c in "\0\x01"])
    return [zero if i == one and next(wanted) else i for i in ids]


def units_of(text: str) -> list[str]:
    """A text as units: blanks become marks, one mark goes first. An empty text has none."""
    if not text:
        return []
    if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
        return [MARK + w for w in text.split(" ")]
    return UNIT.findall(MARK + text.replace(" ", MARK))


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as packed 32-bit integers."""
    vocabulary = pieces(path)
    cache = _worker["cache"]
    cut = [units_of(t) for t in texts]
    new = {u for parts in cut for u in parts if u not in cache}
    if len(cache) + len(new) > CACHE_UNITS:
        cache.clear()
        new = {u for parts in cut for u in parts}
    fresh = list(new)
    some = dict(zip(fresh, (x.tobytes() for x in encode_units(fresh, vocabulary)), strict=True)) if fresh else {}
    cache.update(some)
    get = cache.__getitem__
    out = [b"".join(map(get, parts)) for parts in cut]
    for u in fresh:
        if len(u) > CACHE_LENGTH:
            cache.pop(u, None)
    return out


def decode_ids(ids: np.ndarray, vocabulary: Pieces) -> str:
    """Text of ids: pieces and bytes joined, marks to blanks, the first blank left out. Bytes that
    are no UTF-8 give the replacement character; control ids give nothing."""
    joined = b"".join(map(vocabulary.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return joined[1:] if joined.startswith(" ") else joined


def _lists(some: list[np.ndarray], counts: np.ndarray, missing: np.ndarray) -> pa.ListArray:
    values = pa.array(np.concatenate(some) if some else np.zeros(0, "<i4"), pa.int32())
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values, mask=pa.array(missing))


def encode(docs: DataFrame, path: str, text: str = "text", with_decoded: bool = False, packed: bool = False) -> DataFrame:
    """Every row with piece_ids (array<int>, or packed 32-bit integers), n_pieces, and on demand
    the text decoded from them (piece_text).

    A null text stays null with null ids; an empty one has none. A mark in a text cannot be told
    from a blank, so it comes back as a blank, as it does with the model's own library. Existing
    columns of the new names are replaced.
    """
    new = ["piece_ids", "n_pieces"] + ["piece_text"] * with_decoded
    names = [c for c in docs.columns if c not in new]
    position = names.index(text)
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{c}` {types[c]}" for c in names] + ["piece_ids binary" if packed else "piece_ids array<int>", "n_pieces int"] + ["piece_text string"] * with_decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(position).to_pylist()
            sizes, at = np.cumsum([len(t or "") for t in texts]), 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE)))
                coded = encode_texts([t or "" for t in texts[at:to]], path)
                some = [np.frombuffer(x, "<i4") for x in coded]
                missing = np.array([t is None for t in texts[at:to]])
                counts = np.array([len(x) for x in some])
                if packed:
                    lists = pa.array([None if m else x for x, m in zip(coded, missing, strict=True)], pa.binary())
                else:
                    lists = _lists(some, counts, missing)
                columns = [batch.column(i).slice(at, to - at) for i in range(len(names))]
                columns += [lists, pa.array(counts, pa.int32(), mask=missing)]
                if with_decoded:
                    vocabulary = pieces(path)
                    columns.append(pa.array([None if m else decode_ids(x, vocabulary) for x, m in zip(some, missing, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names + new)
                at = to
        # workers live on: what a task has learnt goes with it
        if "cache" in _worker:
            _worker["cache"].clear()
        pa.default_memory_pool().release_unused()

    os.environ.setdefault("OMP_NUM_THREADS", "1")
    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)
