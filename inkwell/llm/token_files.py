"""Token ids in binary files under one canonical, length-limited Huffman code.

Ids are made once and staged; counts over all of them give the code; documents are coded,
dealt by ranges of doc_id, and written to files of bounded size in ascending order. A file is

    b"INKHUF1\\n", header length (u32), header (zlib; see pack_file), payload

with, per document, its id, its number of ids and its first byte, and a bit offset for every
block of BLOCK ids. Blocks decode on their own: a reader takes one look-up in a table of
2^limit entries for each id, in all blocks at once.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.common import fresh_path, staged, width
from inkwell.llm.files import read_whole, write_whole

MAGIC = b"INKHUF1\n"
BLOCK = 512
FILE_BYTES = 8 << 20
CACHE_UNITS = 1_500_000
NO_ID = -(1 << 63)
_worker: dict = {}


# --- ids -----------------------------------------------------------------


#: White space other than blank and line feed, as the pre-tokenizer's pattern knows it.
ODD_SPACE = [chr(c) for c in (*range(9, 14), *range(28, 32), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288) if c != 10]
#: Marks that a word may end in.
MARKS = ".,;:!?%*"


def _single_blanks(text: str) -> bool:
    """Whether every blank stands between two characters that are no white space."""
    if text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text:
        return False
    return not any(c in text for c in ODD_SPACE)


def byte_alphabet() -> dict[int, int]:
    """What a byte-level vocabulary writes for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


class Pieces(dict):
    """Packed ids of a piece of text that follows a blank or (after="") nothing, made when first asked for.

    Words of letters go to the vocabulary's merges at once; a line feed between two words and
    marks after one are tokens apart, as the pre-tokenizer cuts there. All else is encoded by the
    whole tokenizer.
    """

    def __init__(self, tokenizer, kind: str, after: str = ""):
        self.model, self.alphabet, self.kind, self.after = tokenizer.model, byte_alphabet(), kind, after
        self.plain = Pieces(tokenizer, kind) if after else self
        self.all = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, kind).tobytes()
        self.between = functools.lru_cache(10_000)(self.all)  # a line feed, or marks

    def __missing__(self, piece: str) -> bytes:
        self[piece] = ids = self._made(piece)
        return ids

    def _made(self, piece: str) -> bytes:
        if "\n" in piece:
            lines = piece.split("\n")
            if not all(lines):
                return self.all(self.after + piece)
            feed = self.between("\n")
            return self[lines[0]] + b"".join([feed + self.plain[x] for x in lines[1:]])
        word = piece.rstrip(MARKS)
        if not word.isalpha() or not (word.isascii() or max(word) < "\u0530"):
            return self.all(self.after + piece)
        if len(word) < len(piece):
            return self[word] + self.between(piece[len(word) :])
        shown = (self.after + word).encode().decode("latin-1").translate(self.alphabet)
        return np.array([t.id for t in self.model.tokenize(shown)], self.kind).tobytes()

    def bounded(self, most: int) -> None:
        if len(self) + len(self.plain) > most:
            self.clear()
            self.plain.clear()


def cut_at_blanks(tokenizer) -> bool:
    """Whether the tokenizer is one whose texts may be cut as Pieces does: byte-level BPE with the
    usual pattern, and no added token that such a cut or such a word could touch."""
    made = json.loads(tokenizer.to_str())
    model, before = made["model"], made["pre_tokenizer"] or {}
    plain = all(not t["lstrip"] and not t["rstrip"] and not re.search(r"\s", t["content"]) and not all(c.isalpha() or c in MARKS for c in t["content"]) and not set(t["content"]) & set(MARKS) for t in made["added_tokens"])
    return (
        plain and not made["normalizer"] and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        and model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
    )


def _encoder(path: str, kind: str):
    """The tokenizer, and what this worker has already encoded with it: bounded, None where texts stay whole."""
    if _worker.get("path") != (path, kind):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _worker.update(path=(path, kind), tokenizer=tokenizer, pieces=Pieces(tokenizer, kind, " ") if cut_at_blanks(tokenizer) else None)
    return _worker["tokenizer"], _worker["pieces"]


def encode_texts(texts: list[str], path: str, kind: str = "<u4") -> list[bytes]:
    """Ids of each text as packed integers of the given kind, without special tokens.

    A byte-level pre-tokenizer always cuts before a single blank between two other characters, so
    texts are cut there and each distinct piece is encoded once. Texts with other white space
    beside a blank, or with rarer white space, are encoded whole.
    """
    tokenizer, pieces = _encoder(path, kind)
    if pieces is not None:
        pieces.bounded(CACHE_UNITS)
    out = []
    for text in texts:
        if pieces is None or not text or not _single_blanks(text):
            out.append(np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, kind).tobytes())
        else:
            parts = text.split(" ")
            parts[0] = pieces.plain[parts[0]]
            parts[1:] = map(pieces.__getitem__, parts[1:])
            out.append(b"".join(parts))
    return out


def token_ids(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, ids, counts) and the kind of integer: the ids of every text with end_id after them, packed as
    16-bit integers where the vocabulary allows, else 32-bit. A null text is an empty one. Each task
    adds one row that has only counts: how often it saw each id (64-bit, up to its largest)."""
    from tokenizers import Tokenizer

    kind = "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        end = np.asarray([end_id], kind).tobytes()
        total, names = np.zeros(0, np.int64), ["doc_id", "ids", "counts"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [x + end for x in encode_texts(part.column(1).to_pylist(), path, kind)]
                seen = np.bincount(np.frombuffer(b"".join(ids), kind), minlength=len(total))
                seen[: len(total)] += total
                total = seen
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names)
        if len(total):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([zlib.compress(total.astype("<i8").tobytes(), 1)], pa.binary())], names)

    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, counts binary"), kind


# --- the code ------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Best code lengths of at most `limit` bits (package-merge). counts: per symbol, all positive."""
    n = len(counts)
    if n == 1:
        return np.ones(1, np.uint8)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    flags, level = [np.ones(n, bool)], leaves
    for _ in range(limit - 1):
        even = len(level) // 2 * 2
        both = np.concatenate([leaves, level[0:even:2] + level[1:even:2]])
        rank = np.argsort(both, kind="stable")
        flags.append(rank < n)
        level = both[rank]
    out, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(flags):
        own = int(leaf[:take].sum())
        out[:own] += 1
        take = 2 * (take - own)
    lengths = np.empty(n, np.uint8)
    lengths[order] = out
    return lengths


class Code:
    """Canonical code of (symbol, length) pairs: codes ascend by length, then symbol."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((symbols, lengths))
        self.symbols, self.lengths = symbols[order].astype(np.int64), lengths[order].astype(np.int64)
        self.limit = int(self.lengths[-1])
        spans = 1 << (self.limit - self.lengths)
        starts = np.cumsum(spans) - spans
        self.code_of = np.zeros(int(self.symbols.max()) + 1, np.uint64)
        self.length_of = np.zeros(len(self.code_of), np.int64)
        self.code_of[self.symbols] = (starts >> (self.limit - self.lengths)).astype(np.uint64)
        self.length_of[self.symbols] = self.lengths

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and length for each value of the next `limit` bits."""
        spans = 1 << (self.limit - self.lengths)
        fill = (1 << self.limit) - int(spans.sum())
        return (
            np.concatenate([np.repeat(self.symbols, spans), np.zeros(fill, np.int64)]).astype(np.uint32),
            np.concatenate([np.repeat(self.lengths, spans), np.ones(fill, np.int64)]),
        )

    def encode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Documents (counts: ids in each) coded one after the other, each from a byte of its own.
        Returns the bytes, each document's first byte, and the bit in its document of every block."""
        lengths = self.length_of[ids]
        ends = np.cumsum(lengths)
        firsts = np.cumsum(counts) - counts
        before = np.concatenate([[0], ends])
        bits = before[firsts + counts] - before[firsts]
        size = (bits + 7) // 8
        first_byte = np.cumsum(size) - size
        inside = (ends - lengths) - np.repeat(before[firsts], counts)
        at = inside + np.repeat(first_byte * 8, counts)
        value = self.code_of[ids] << (np.uint64(64) - (at & 31).astype(np.uint64) - lengths.astype(np.uint64))
        words = int(size.sum()) // 4 + 3
        high = np.bincount(at >> 5, weights=(value >> np.uint64(32)).astype(np.float64), minlength=words)
        low = np.bincount((at >> 5) + 1, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words)
        data = (high[:words] + low[:words]).astype(np.uint64).astype(">u4").tobytes()[: int(size.sum())]
        place = np.arange(len(ids)) - np.repeat(firsts, counts)
        return data, first_byte, inside[place % BLOCK == 0]


def decode_blocks(payload: bytes, bit: np.ndarray, counts: np.ndarray, code: Code) -> np.ndarray:
    """Ids of blocks that begin at the given bits, one block after the other: step k decodes
    the k-th id of every block that has one."""
    symbol, length = code.table()
    raw = np.frombuffer(payload + b"\0" * 8, np.uint8)
    window = np.ndarray((len(raw) - 3,), ">u4", raw.data, strides=(1,))
    order = np.argsort(-counts, kind="stable")
    pos, left = bit[order].astype(np.int64), counts[order]
    to = (np.cumsum(counts) - counts)[order]
    out = np.empty(int(counts.sum()), np.uint32)
    live = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1 if len(left) else 1), side="right")
    for k, n in enumerate(live):
        p = pos[:n]
        value = (window[p >> 3].astype(np.int64) >> (32 - code.limit - (p & 7))) & ((1 << code.limit) - 1)
        out[to[:n] + k] = symbol[value]
        p += length[value]
    return out


# --- files ---------------------------------------------------------------


def pack_file(docs: list[tuple[int, int, bytes, np.ndarray]], code: Code) -> bytes:
    """docs: (doc_id, number of ids, coded bytes, bit offset in the document of every block)."""
    sizes = np.array([len(d[2]) for d in docs], np.int64)
    head = zlib.compress(
        struct.pack("<III", len(docs), len(code.symbols), BLOCK)
        + code.symbols.astype("<u4").tobytes() + code.lengths.astype("u1").tobytes()
        + np.array([d[0] for d in docs], "<i8").tobytes() + np.array([d[1] for d in docs], "<u4").tobytes()
        + sizes.astype("<i8").tobytes() + np.concatenate([d[3] for d in docs]).astype("<u4").tobytes(), 1,
    )
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(d[2] for d in docs)


def read_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_id and number of ids of each document of a file, and all its ids."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    at = len(MAGIC) + 4
    size = struct.unpack_from("<I", data, len(MAGIC))[0]
    head, payload = zlib.decompress(data[at : at + size]), data[at + size :]
    n, k, block = struct.unpack_from("<III", head)
    at = 12

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(head, kind, count, at)
        at += got.nbytes
        return got

    symbols, lengths = take("<u4", k), take("u1", k)
    doc_id, counts, sizes = take("<i8", n), take("<u4", n).astype(np.int64), take("<i8", n)
    blocks = (counts + block - 1) // block
    base = np.repeat((np.cumsum(sizes) - sizes) * 8, blocks)
    bit = base + take("<u4", int(blocks.sum()))
    place = np.arange(len(bit)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    in_block = np.minimum(np.repeat(counts, blocks) - place * block, block)
    return doc_id, counts, decode_blocks(payload, bit, in_block, Code(symbols, lengths))


def write_token_files(docs: DataFrame, path: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Tokenize and write every document in ascending order of doc_id; returns the list of files
    (path, n_docs, n_ids, start): start counts the ids of all files before.

    Documents of equal doc_id follow each other, ordered by their ids; those with a null
    doc_id come first. The only things that reach the driver are the counts of ids, bounded
    by the vocabulary, and the bounds of the ranges, one per partition.
    """
    spark = docs.sparkSession
    rows, kind = token_ids(docs, path, end_id)
    staged_ids = staged(rows, "token-ids")

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                some = np.frombuffer(zlib.decompress(packed), "<i8")
                total = np.pad(total, (0, max(0, len(some) - len(total))))
                total[: len(some)] += some
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    counts = staged_ids.where("counts IS NOT NULL").select("counts").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    ids = staged_ids.where("ids IS NOT NULL").select("doc_id", "ids")
    folder = folder or fresh_path(spark, "token-files")
    schema = "path string, bucket int, seq int, n_docs long, n_ids long"
    if counts.empty:
        return spark.createDataFrame([], schema).select("path", "n_docs", "n_ids", F.lit(0).cast("long").alias("start"))
    symbols = counts["id"].to_numpy(np.int64)
    limit = max(15, int(len(symbols)).bit_length() + 1)
    code = Code(symbols, code_lengths(counts["n"].to_numpy(np.int64), limit))
    parts = width(spark)
    marks = ids.select(F.expr(f"percentile_approx(doc_id, array({', '.join(str((i + 1) / parts) for i in range(parts - 1)) or '0.5'}), 10000)")).first()[0]
    bounds = np.unique(np.array(marks or [], np.int64))

    def encode(batches):
        for batch in batches:
            at = 0
            n_ids = np.array([len(x) for x in batch.column(1).to_pylist()]) // np.dtype(kind).itemsize
            ends = np.cumsum(n_ids)
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 1_000_000)))
                part = batch.slice(at, to - at)
                own = n_ids[at:to]
                some = np.frombuffer(b"".join(part.column(1).to_pylist()), kind).astype(np.int64)
                data, first, bit = code.encode(some, own)
                cut = [*first.tolist(), len(data)]
                blocks = np.cumsum([0, *((own + BLOCK - 1) // BLOCK)])
                doc = part.column(0).to_pylist()
                bucket = np.searchsorted(bounds, np.array([NO_ID if d is None else d for d in doc], np.int64), side="left")
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(bucket, pa.int32()), pa.array(own, pa.int64()),
                        pa.array([data[a:b] for a, b in zip(cut, cut[1:], strict=False)], pa.binary()),
                        pa.array([bit[a:b].astype("<u4").tobytes() for a, b in zip(blocks, blocks[1:], strict=False)], pa.binary()),
                    ],
                    ["doc_id", "bucket", "n_ids", "coded", "bits"],
                )
                at = to

    coded = ids.mapInArrow(encode, "doc_id long, bucket int, n_ids long, coded binary, bits binary")
    dealt = coded.repartition(parts, "bucket").sortWithinPartitions(
        "bucket", F.col("doc_id").asc_nulls_first(), "n_ids", "coded"
    )

    def write(batches):
        open_docs, open_bytes, bucket, seq, done = [], 0, None, 0, []

        def close():
            nonlocal open_docs, open_bytes, seq
            if open_docs:
                to = f"{folder}/{bucket:06d}-{seq:06d}.ids"
                write_whole(to, pack_file(open_docs, code))
                done.append((to, bucket, seq, len(open_docs), sum(d[1] for d in open_docs)))
                seq += 1
            open_docs, open_bytes = [], 0

        for batch in batches:
            for doc, b, n, data, bits in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if b != bucket or open_bytes + len(data) > FILE_BYTES:
                    close()
                    if b != bucket:
                        bucket, seq = b, 0
                open_docs.append((NO_ID if doc is None else doc, n, data, np.frombuffer(bits, "<u4")))
                open_bytes += len(data)
        close()
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("path", "bucket", "seq", "n_docs", "n_ids"), d, strict=True)) for d in done],
            pa.schema([("path", pa.string()), ("bucket", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
        )

    files = staged(dealt.mapInArrow(write, schema), "token-list")
    # a row per bucket, of which there are as many as partitions; then the files of each bucket
    sums = files.groupBy("bucket").agg(F.sum("n_ids").alias("own"))
    sums = sums.select("bucket", F.coalesce(F.sum("own").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    before = Window.partitionBy("bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("first") + F.coalesce(F.sum("n_ids").over(before), F.lit(0))
    return files.join(sums, "bucket").select("path", "n_docs", "n_ids", start.cast("long").alias("start"))


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document of the listed files; ids are packed u32."""

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_id, counts, ids = read_file(read_whole(path))
                ends = np.cumsum(counts)
                begin = ends - counts
                for at in range(0, len(doc_id), 512):
                    some = slice(at, at + 512)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([None if d == NO_ID else d for d in doc_id[some].tolist()], pa.int64()),
                            pa.array(begin[some] + start, pa.int64()),
                            pa.array([ids[a:b].tobytes() for a, b in zip(begin[some], ends[some], strict=True)], pa.binary()),
                        ],
                        ["doc_id", "start", "ids"],
                    )

    spread = files.select("path", "start").repartition(width(files.sparkSession), "path")
    return spread.mapInArrow(read, "doc_id long, start long, ids binary")
