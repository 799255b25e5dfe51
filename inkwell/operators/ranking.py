"""Inverted index, BM25, vectors and rank fusion."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.text import tokens


#: Words of a query batch that may stand in a plan, and be broadcast with their counts.
FEW_TOKENS = 200
#: From how many blocks on they go in rounds, each this many times what went before.
BOUNDED_FROM, LARGER = 16, 4


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, token, tf): summed within a task before the shuffle."""
    return docs.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.greatest(F.size(tokens(F.col(text))), F.lit(1)).cast("long").alias("len"))


def bm25(docs: DataFrame, queries: DataFrame, key: str = "doc_id", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(qid, key, score) of documents with a query's token. queries: qid, token.

    Only the queries' tokens are counted: up to FEW_TOKENS of them are a set of constants in the plan,
    so a document sends a row per query token it holds, not its whole index. More meet the index by joins.
    """
    wanted = sorted(r["token"] for r in queries.select("token").distinct().limit(FEW_TOKENS + 1).collect())
    if len(wanted) > FEW_TOKENS:
        from inkwell.operators.retrieval import batch_bm25

        return batch_bm25(docs, queries, key, k1, b)
    listed = F.array(*[F.lit(w) for w in wanted])
    parts = docs.select(key, tokens(F.col("text")).alias("t")).select(
        key, F.greatest(F.size("t"), F.lit(1)).cast("double").alias("len"), F.filter("t", lambda x: F.array_contains(listed, x)).alias("hits")
    )
    stats = parts.agg(F.count("*").cast("double").alias("n"), F.avg("len").alias("avgdl"))
    tf = parts.select(key, "len", F.explode("hits").alias("token")).groupBy(key, "len", "token").agg(F.count("*").cast("double").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").cast("double").alias("df"))
    joined = tf.join(queries, "token").join(F.broadcast(df), "token").crossJoin(F.broadcast(stats))  # one row
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    part = idf * F.col("tf") * F.lit(k1 + 1) / (F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("len") / F.col("avgdl")))
    return joined.groupBy("qid", key).agg(F.sum(part).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def quantized(v: Column) -> Column:
    """Unit length, then 127 steps, half to even."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.bround(x.cast("double") / norm * F.lit(127.0)).cast("int"))


def top(rows: DataFrame, k: int, by: list[str], *order, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def rounds(n: int) -> list[tuple[int, int]]:
    """Stretches of n blocks that go one after the other: all at once if they are few, else the first one and then always LARGER times what is done."""
    if n < BOUNDED_FROM:
        return [(0, n)]
    out = [(0, 1)]
    while out[-1][1] < n:
        out.append((out[-1][1], min(out[-1][1] * LARGER, n)))
    return out


def fused(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (qid, key, rank)."""
    union = lists[0].select("qid", key, "rank")
    for other in lists[1:]:
        union = union.unionByName(other.select("qid", key, "rank"))
    return union.groupBy("qid", key).agg(F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))).alias("rrf"))


def diversified(candidates: DataFrame, k: int, cap: int, buckets: list[str], ratio: float = 0.5) -> DataFrame:
    """(qid, key, pick): results picked from the buckets in turn, at most `cap` of a source, each context
    once; then the rest by score. candidates: qid, key, bucket, source, context, score, and perhaps cap, a row's own — a bounded
    list per query, as a ranked search gives it, so that one group is one small task.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "key"], ascending=[False, True])
        best = rows["score"].iloc[0] if len(rows) else 0.0
        queues = {b: iter(rows[(rows["bucket"] == b) & (rows["score"] >= ratio * best)].itertuples()) for b in buckets}
        seen, used, out = set(), Counter(), []

        def take(found) -> bool:
            for r in found:
                if r.context not in seen and used[r.source] < getattr(r, "cap", cap):
                    seen.add(r.context)
                    used[r.source] += 1
                    out.append(r.key)
                    return True
            return False

        moved = True
        while moved and len(out) < k:
            moved = False
            for b in buckets:
                if len(out) < k and take(queues[b]):
                    moved = True
        rest = iter(rows.itertuples())
        while len(out) < k and take(rest):
            pass
        return pd.DataFrame({"qid": [rows["qid"].iloc[0]] * len(out), "key": out, "pick": range(1, len(out) + 1)})

    kind = candidates.schema["qid"].dataType.simpleString()
    columns = [c for c in ("qid", "key", "bucket", "source", "context", "score", "cap") if c in candidates.columns]
    return candidates.select(columns).groupBy("qid").applyInPandas(pick, f"qid {kind}, key long, pick int")
