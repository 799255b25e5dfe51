"""Which texts hold which items word for word, found by anchors that both must share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Lengths by which items are classed: an item of a class shares an anchor with every text that holds it.
CLASSES = (40, 20, 10, 5, 1)
#: Anchors of items are broadcast up to so many.
BROADCAST_ANCHORS = 1_000_000
SEED = np.uint64(0x9E3779B97F4A7C15)


def _hashes(text: str, width: int) -> np.ndarray:
    """A hash of every run of `width` characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < width:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(codes) - width + 1, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x100000001B3) + codes[k : k + len(out)] + np.uint64(1)
    out = (out ^ (out >> np.uint64(29))) * SEED
    return out ^ (out >> np.uint64(32))


def least_hashes(text: str, shared: int, first: bool = False) -> np.ndarray:
    """The least hash of each window of `shared` characters, each once: two texts that share as many characters in a row share one.
    With `first`, that of the first window alone."""
    width = max(1, shared * 3 // 10)
    hashes, span = _hashes(text, width), shared - width + 1
    if len(hashes) < span:
        return np.zeros(0, np.uint64)
    if first:
        return hashes[:span].min(keepdims=True)
    out, step = hashes, 1
    while step * 2 <= span:  # minima of doubled stretches, then of two that cover the window
        out, step = np.minimum(out[:-step], out[step:]), step * 2
    return np.unique(np.minimum(out[: len(hashes) - span + 1], out[span - step : span - step + len(hashes) - span + 1]))


def anchors(rows: DataFrame, key: str, text: str, shared: int, first: bool = False) -> DataFrame:
    """(key, anchor): nothing leaves a row but a few hashes, about two for each `shared` characters."""
    schema = StructType([rows.schema[key], *StructType.fromDDL("anchor long").fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            found = [least_hashes(t or "", shared, first) for t in batch.column(1).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            values = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(values)], schema=arrow)

    return rows.select(key, text).mapInArrow(run, schema)


def contained(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(doc, item) where the document's text holds the item's. Null and empty items are in no text.

    Items are classed by length; the least hash of an item's first window is looked for among the documents' anchors by an
    equi-join, and only documents with such a hit bring their text to be compared. Both sides' keys name one text each.
    """
    sized = items.select(F.col(item).alias("_item"), F.col(text).alias("_asked")).where(F.length("_asked") > 0)
    kind = F.coalesce(*[F.when(F.length("_asked") >= n, n) for n in CLASSES])
    sized = sized.withColumn("class", kind)
    pairs = None
    for row in sized.select("class").distinct().collect():  # five classes at most
        wanted = anchors(sized.where(F.col("class") == row["class"]), "_item", "_asked", row["class"], first=True)
        if wanted.limit(BROADCAST_ANCHORS + 1).count() <= BROADCAST_ANCHORS:
            wanted = F.broadcast(wanted)
        hits = anchors(docs, doc, text, row["class"]).join(wanted, "anchor").select(doc, "_item")
        pairs = hits if pairs is None else pairs.unionByName(hits)
    if pairs is None:
        return docs.select(doc).limit(0).crossJoin(items.select(item).limit(0))
    both = pairs.join(sized.select("_item", "_asked"), "_item").join(docs.select(doc, text), doc)
    return both.where(F.contains(F.col(text), F.col("_asked"))).select(doc, F.col("_item").alias(item)).distinct()
