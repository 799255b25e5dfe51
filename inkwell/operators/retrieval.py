"""Query batches against the corpus: terms, rare-first scores, hybrid scores, windows and page matches."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.text import tokens
from inkwell.operators.contain import contained
from inkwell.operators.graph import staged
from inkwell.operators.ranking import lengths, postings, rounds, top

# Words that say nothing in a question.
STOP_WORDS = """
the a an is are was were be been being am of in on at to for with by from as into about that i me my mine we us our you your
yours he she they it its this these those what how why when where who do does did done can could would should may might will have has
had having and or but if than then so not just very really much more most some any like go get got make made let help know tell tells
say says said deal doing want need thing things way talk talks talking talked literature book books text texts reading readings passage
passages page pages chapter chapters mention mentions mentioned speak speaks speaking discuss discusses discussed write writes written
read quote quotes find found look looking show shows give gives
""".split()
# What a page match counts for, and the least it must reach.
LONG, SHORT, TOKEN, ORDERED, EARLY = 250, 160, 14, 20, 6


def asked_terms(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """The words of a question that are looked for: longer than two letters and no stop words, each once in order."""
    return F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) > 2) & ~t.isin(stop)))


def batch_bm25(docs: DataFrame, queries: DataFrame, key: str = "doc_id", k1: float = 1.5, b: float = 0.75, common: int | None = None) -> DataFrame:
    """(qid, key, score) for any number of queries (qid, token, each token once a query).

    Tokens meet the index by a join, so the batch may grow with the corpus. With `common`, tokens in more
    documents than that count only for documents that hold another token of the query; a query of common
    tokens only keeps them all.
    """
    wanted = queries.select("token").distinct()
    tf = postings(docs, key).join(wanted, "token", "left_semi").withColumn("tf", F.col("tf").cast("double"))
    size = lengths(docs, key).withColumn("len", F.col("len").cast("double"))
    stats = size.agg(F.count("*").cast("double").alias("n"), F.avg("len").alias("avgdl"))
    df = tf.groupBy("token").agg(F.count("*").cast("double").alias("df"))
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    part = idf * F.col("tf") * F.lit(k1 + 1) / (F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("len") / F.col("avgdl")))
    weighed = tf.join(df, "token").join(size, key).crossJoin(F.broadcast(stats)).select("token", key, "df", part.alias("part"))  # stats: one row
    if common is None:
        return weighed.drop("df").join(queries, "token").groupBy("qid", key).agg(F.sum("part").alias("score"))
    rare = queries.join(df, "token").withColumn("rare", F.col("df") <= common).drop("df")
    rare = rare.withColumn("some", F.max("rare").over(Window.partitionBy("qid")))
    scored = weighed.drop("df").join(rare, "token").groupBy("qid", key).agg(F.sum("part").alias("score"), F.max("rare").alias("held"), F.max("some").alias("some"))
    return scored.where("held OR NOT some").select("qid", key, "score")


#: Postings of a block of documents, queries of a block and rows that a block leaves, all in a task at a time. Words of a batch that may be broadcast.
BLOCK_POSTINGS, BLOCK_QUERIES, BLOCK_ROWS, FEW_WORDS = 4_000_000, 262_144, 4_000_000, 200_000
#: Blocks to deal a small index into, and tasks of a round at least.
LEAST_BLOCKS = 12


@dataclass
class BatchIndex:
    """The words that a batch asks for (token, tid), who asks for them (qid, token), and which documents hold them (key, len, tids, tfs)."""

    words: DataFrame
    queries: DataFrame
    held: DataFrame


def frequent_words(docs: DataFrame, k: int, key: str = "doc_id", text: str = "text", stop: list[str] = STOP_WORDS) -> DataFrame:
    """(key, token): the k most frequent words of each document, longer than two letters and no stop words, ties by word."""
    kind, left_out = docs.schema[key].dataType.simpleString(), set(stop)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words = [], []
            for i, found in zip(batch.column(0), batch.column(1), strict=True):
                tf = Counter(t for t in found.as_py() or [] if len(t) > 2 and t not in left_out)
                best = heapq.nsmallest(k, tf, key=lambda t: (-tf[t], t))
                keys += [i.as_py()] * len(best)
                words += best
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.types[0]), pa.array(words, pa.string())], [key, "token"])

    return docs.select(key, tokens(F.col(text)).alias("w")).mapInArrow(count, f"{key} {kind}, token string")


def held_words(docs: DataFrame, words: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, len, tids, tfs): a document's length, which of the words it holds by their place in the list, ascending, and how often each.

    A document is counted where it is read, so no row a word is shuffled.
    """
    kind = docs.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, of = pa.array(words, pa.string()), max(len(words), 1)
        for batch in batches:
            lists = batch.column(1)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            tid = pc.fill_null(pc.index_in(lists.flatten(), wanted), -1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)[tid >= 0]
            code, tf = np.unique(row * of + tid[tid >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(code, np.arange(len(size) + 1) * of), pa.int32())
            tids, tfs = (pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (code % of, tf))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.maximum(size, 1), pa.int32()), tids, tfs], [key, "len", "tids", "tfs"])

    return docs.select(key, tokens(F.col(text)).alias("w")).mapInArrow(count, f"{key} {kind}, len int, tids array<int>, tfs array<int>")


def batch_index(docs: DataFrame, queries: DataFrame, key: str = "doc_id") -> BatchIndex:
    """Only asked words are counted, a row a document. queries: qid, token; key: one row each."""
    spark = docs.sparkSession
    queries = staged(queries.select("qid", "token").distinct(), "batch")
    words = queries.select("token").distinct()
    few = words.limit(FEW_WORDS + 1).collect()
    if len(few) <= FEW_WORDS:
        listed = sorted(r["token"] for r in few if r["token"] is not None)
        words = staged(spark.createDataFrame(pd.DataFrame({"token": pd.Series(listed, dtype="str"), "tid": np.arange(len(listed), dtype="int32")}), "token string, tid int"), "words")
        return BatchIndex(words, queries, staged(held_words(docs, listed, key), "held"))
    words = staged(words.withColumn("tid", F.monotonically_increasing_id()), "words")
    found = postings(docs, key).join(words, "token").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("tid", F.col("tf").cast("int").alias("tf")))).alias("found"))
    none = lambda c, kind: F.coalesce(F.col(f"found.{c}"), F.array().cast(f"array<{kind}>")).alias(f"{c}s")
    held = lengths(docs, key).join(found, key, "left").select(key, F.col("len").cast("int").alias("len"), none("tid", "bigint"), none("tf", "int"))
    return BatchIndex(words, queries, staged(held, "held"))


def batch_top(docs: DataFrame, queries: DataFrame | None, k: int, key: str = "doc_id", k1: float = 1.5, b: float = 0.75, common: int | None = None, digits: int = 6, index: BatchIndex | None = None) -> DataFrame:
    """(qid, key, score, rank): the k best other documents of every query by `batch_bm25`, scores rounded, ties by key.

    Documents, each with the asked words it holds, are dealt into blocks of a bounded number of postings; each meets each block of
    queries in one task, which adds up a query's postings over the block's documents and leaves k rows a query. Many blocks go in rounds:
    after the first one, only what comes before the k-th row found so far leaves a task, so a round leaves a few times k rows a query
    however many blocks it has.
    """
    index = index or batch_index(docs, queries, key)
    held = index.held
    total = held.agg(F.count("*").cast("double").alias("n"), F.avg(F.col("len").cast("double")).alias("avgdl"), F.sum(F.size("tids")).alias("postings")).first()
    df = held.select(F.explode("tids").alias("tid")).groupBy("tid").agg(F.count("*").cast("double").alias("df"))
    idf = F.log(F.lit(1.0) + (F.lit(total["n"]) - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    words = index.words.join(df, "tid").select("token", "tid", idf.alias("idf"), (F.col("df") <= (common or 0)).alias("rare"))
    terms = F.sort_array(F.collect_list(F.struct("tid", "idf", "rare")))
    choosy = ["rare"] if common is not None else []
    asked = staged(index.queries.join(words, "token").groupBy("qid").agg(terms.alias("t")).select("qid", *[F.col(f"t.{c}").alias(f"{c}s") for c in ["tid", "idf", *choosy]]), "asked")

    asks, n = asked.count(), total["postings"] or 0
    n = max(-(-n // BLOCK_POSTINGS), min(-(-n // 20_000), LEAST_BLOCKS), 1)
    dealt = lambda column, of: F.pmod(F.xxhash64(column), F.lit(of)).cast("int")
    across = lambda low, high: F.explode(F.sequence(F.lit(low), F.lit(high - 1)))
    kinds = index.held.schema[key].dataType.simpleString(), asked.schema["qid"].dataType.simpleString()
    schema = f"qid {kinds[1]}, {key} {kinds[0]}, score double"
    mean = total["avgdl"]

    def best(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        return best_of_block(ours, theirs, k, key, mean, k1, b, digits)

    held, found = held.withColumn("i", dealt(key, n)), None
    for low, high in rounds(n):
        if found is None:
            known = asked.withColumns({"least": F.lit(float("-inf")), "last": F.lit(None).cast(kinds[0])})
        else:
            bound = found.where(F.col("rank") == k).select("qid", F.col("score").alias("least"), F.col(key).alias("last"))
            known = asked.join(bound, "qid", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        m = max(-(-asks // BLOCK_QUERIES), -(-asks * k // (max(low, 1) * BLOCK_ROWS)), -(-min(LEAST_BLOCKS, n) // (high - low)), 1)
        tasks = (high - low) * m
        left = held.where((F.col("i") >= low) & (F.col("i") < high)).withColumn("j", across(0, m)).repartition(tasks, "i", "j")
        right = known.withColumns({"i": across(low, high), "j": dealt("qid", m)}).repartition(tasks, "i", "j")
        some = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(best, schema)
        every = some if found is None else found.select("qid", key, "score").unionByName(some)
        found = staged(top(every, k, ["qid"], F.desc("score"), key), "found")
    return found


def best_of_block(ours: pa.Table, theirs: pa.Table, k: int, key: str, mean: float, k1: float, b: float, digits: int) -> pa.Table:
    """(qid, key, score): the k best documents of a block for each query that come before its last one found so far, ties by key.

    ours: key, len, tids, tfs; theirs: qid, tids, idfs, least, last, and perhaps rares: a query that has rare words asks only for documents that hold one.
    """
    none = pa.table({"qid": theirs["qid"].slice(0, 0), key: ours[key].slice(0, 0), "score": pa.array([], pa.float64())})
    if not len(ours) or not len(theirs):
        return none
    flat = lambda table, c: table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    sizes = lambda table: pc.list_value_length(table["tids"]).to_numpy()
    ids, doc = np.unique(ours[key].to_numpy(), return_inverse=True)
    of, tid = sizes(ours), flat(ours, "tids")
    order = np.argsort(tid, kind="stable")
    tid, tf, place = tid[order], flat(ours, "tfs")[order], np.repeat(doc.astype(np.int32), of)[order]
    damp = np.zeros(len(ids))
    damp[doc] = k1 * ((1 - b) + b * ours["len"].to_numpy().astype(np.float64) / mean)
    doc = place
    del order, place
    qid, least, last = theirs["qid"].to_numpy(), theirs["least"].to_numpy(), pc.fill_null(theirs["last"], ours[key][0]).to_numpy()
    asked, idf = flat(theirs, "tids"), flat(theirs, "idfs")
    rare = flat(theirs, "rares") if "rares" in theirs.column_names else np.zeros(len(asked), dtype=bool)
    ends = np.cumsum(sizes(theirs))
    starts = ends - sizes(theirs)
    word, at = np.unique(asked, return_index=True)
    part = np.zeros(len(tid))
    first, end = np.searchsorted(tid, word), np.searchsorted(tid, word, "right")
    for a, z, x in zip(first.tolist(), end.tolist(), at.tolist(), strict=True):
        part[a:z] = idf[x] * tf[a:z] * (k1 + 1) / (tf[a:z] + damp[doc[a:z]])
    del tf, damp
    place = np.searchsorted(word, asked)
    first, end = first[place], end[place]
    same: dict = {}  # queries of the same words
    for x, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        same.setdefault(asked[s:e].tobytes(), []).append(x)
    scores, slack, out = np.zeros(len(ids)), 10.0**-digits, []
    for group in same.values():
        s, e = starts[group[0]], ends[group[0]]
        scores[:] = 0.0
        for a, z in zip(first[s:e].tolist(), end[s:e].tolist(), strict=True):
            scores[doc[a:z]] += part[a:z]  # a document once a word
        low = max(least[group].min() - slack, 0.0)
        if rare[s:e].any():
            found = np.unique(np.concatenate([doc[first[x] : end[x]] for x in range(s, e) if rare[x]]))
            found = found[scores[found] > low]
        else:
            found = np.flatnonzero(scores > low)
        value = scores[found]
        if len(found) > k + 1:  # the query itself may be among them
            near = value >= np.partition(value, len(value) - k - 1)[len(value) - k - 1] - slack
            found, value = found[near], value[near]
        value = np.round(value, digits)
        order = np.lexsort((found, -value))[: k + 1]
        found, value = ids[found[order]], value[order]
        for x in group:
            mine = (found != qid[x]) & ((value > least[x]) | ((value == least[x]) & (found < last[x])))
            if mine.any():
                out.append((np.full(min(int(mine.sum()), k), qid[x]), found[mine][:k], value[mine][:k]))
    if not out:
        return none
    columns = [np.concatenate([o[c] for o in out]) for c in range(3)]
    return pa.table([pa.array(columns[0], theirs["qid"].type), pa.array(columns[1], ours[key].type), pa.array(columns[2], pa.float64())], names=["qid", key, "score"])


def hybrid(semantic: DataFrame, keyword: DataFrame, key: str = "doc_id", weight: float = 0.7) -> DataFrame:
    """(qid, key, score) of candidates (qid, key, sem) and (qid, key, kw), each side over its best of the query."""
    full = semantic.join(keyword, ["qid", key], "full").select("qid", key, F.coalesce("sem", F.lit(0.0)).alias("sem"), F.coalesce("kw", F.lit(0.0)).alias("kw"))
    w = Window.partitionBy("qid")  # bounded: the candidates of a query
    over = lambda c: F.when(F.max(c).over(w) > 0, F.col(c) / F.max(c).over(w)).otherwise(F.lit(0.0))
    return full.select("qid", key, (F.lit(weight) * over("sem") + F.lit(1 - weight) * over("kw")).alias("score"))


def windows(text: Column, width: int, step: int) -> Column:
    """The stretches of `width` characters that begin every `step` characters, made of pieces in one pass."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))

    def longer(out: Column, at: int, more: int) -> Column:
        after = F.slice(pieces, F.lit(at), F.greatest(F.size(pieces), F.lit(1)))
        return F.zip_with(out, after, lambda a, b: F.concat(a, F.coalesce(F.substring(b, 1, more), F.lit(""))))

    out = pieces
    for done in range(step, width, step):
        out = longer(out, done // step + 1, min(step, width - done))
    return out


def best_window(text: Column, terms: Column, width: int = 125, step: int = 50) -> Column:
    """struct(hits, start) of the first window with most of the terms; terms: an array column in lower case."""
    hits = F.transform(windows(F.lower(text), width, step), lambda w, i: F.struct(F.size(F.filter(terms, lambda t: F.contains(w, t))).alias("hits"), (-i).alias("start")))
    best = F.array_max(hits)
    return F.struct(F.coalesce(best["hits"], F.lit(0)).alias("hits"), F.coalesce(-best["start"] * step, F.lit(0)).alias("start"))


def page_score(text: Column, terms: Column) -> Column:
    """How well a page fits the words of a highlight (12 at most, in lower case): whole phrases, words, words in order, early words."""
    eight = F.slice(terms, 1, 8)
    inside = lambda ts, where: F.size(F.filter(ts, lambda t: F.contains(where, t)))
    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("hits"), F.lit(True).alias("on"))

    def step(s, t):
        found = F.call_function("locate", t, text, s["at"])
        on = s["on"] & (found > 0)
        return F.struct(F.when(on, found + F.length(t)).otherwise(s["at"]).alias("at"), (s["hits"] + on.cast("int")).alias("hits"), on.alias("on"))

    ordered = F.aggregate(eight, start, step, lambda s: s["hits"])
    phrases = F.when(F.contains(text, F.array_join(terms, " ")), LONG).otherwise(0) + F.when(F.contains(text, F.array_join(eight, " ")), SHORT).otherwise(0)
    return phrases + inside(terms, text) * TOKEN + ordered * ORDERED + inside(F.slice(terms, 1, 6), F.substring(text, 1, 900)) * EARLY


def fresh(known: DataFrame, found: DataFrame, key: list[str], k: int, *order) -> DataFrame:
    """Found rows that are not known by their key, the first k of each query (qid)."""
    return top(found.join(known.select("qid", *key).distinct(), ["qid", *key], "left_anti"), k, ["qid"], *order)


def merged_results(first: DataFrame, rest: DataFrame, key: list[str], k: int) -> DataFrame:
    """The first list whole, then what the other adds, k in all unless the first is longer. Both: qid, key, rank."""
    ahead = first.groupBy("qid").agg(F.count("*").alias("ahead"))
    added = rest.join(first.select("qid", *key), ["qid", *key], "left_anti").join(ahead, "qid", "left")
    w = Window.partitionBy("qid").orderBy("rank")
    added = added.withColumn("rank", (F.row_number().over(w) + F.coalesce("ahead", F.lit(0))).cast("int")).where(F.col("rank") <= k)
    return first.select("qid", *key, "rank").unionByName(added.select("qid", *key, "rank"))


def resolved(names: DataFrame, catalog: DataFrame, least: float = 0.82) -> DataFrame:
    """(name, id, how): asked names onto a catalog (id, title): same key, a single containing key, or the closest spelling.

    Closeness is one minus edits over the longer length. Names, made distinct, meet the catalog by whole keys, then by anchors
    of the keys that may hold them, then by pieces of keys: by equi-joins alone.
    """
    def keyed(text: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", ""), "^the(?=.{4})", "")

    asked = names.select("name").distinct().withColumn("key", keyed(F.col("name"))).where("key <> ''")
    books = catalog.select("id", keyed(F.col("title")).alias("book"))
    asked = staged(asked, "names")
    books = staged(books.groupBy("book").agg(F.min("id").alias("id")), "catalog")
    exact = asked.join(books, F.col("key") == F.col("book")).select("name", "id", F.lit("exact").alias("how"))
    left = staged(asked.join(exact.select("name"), "name", "left_anti"), "names")
    wanted = left.select("key").distinct()
    # a single book whose key holds the name's
    held = contained(books.select("book", F.col("book").alias("text")), wanted.where("length(key) >= 5").select("key", F.col("key").alias("text")), "book", "key")
    parts = staged(held.groupBy("key").agg(F.count("*").alias("parts"), F.min("book").alias("book")), "parts")
    single = left.join(parts.where("parts = 1"), "key").join(books, "book").select("name", "id", F.lit("part").alias("how"))
    rest = left.join(parts.where("parts = 1").select("key"), "key", "left_anti")
    pairs = similar_keys(rest.select("key").distinct(), books.select("book"), least)
    close = top(rest.join(pairs, "key"), 1, ["name"], F.desc("close"), "book").join(books, "book").select("name", "id", F.lit("close").alias("how"))
    return exact.unionByName(single).unionByName(close)


def similar_keys(keys: DataFrame, books: DataFrame, least: float) -> DataFrame:
    """(key, book, close): one minus edits over the longer length, at least `least`. keys: key; books: book.

    A key of n letters that is so close has at most e = n (1 - least) / least edits; of its e + 1 even pieces one is whole in the
    book, moved by e places at most. So pieces meet the books' pieces of their lengths by an equi-join.
    """
    n = F.length("key")
    edits = F.floor(n * ((1 - least) / least) + 1e-9).cast("int")
    cut = keys.select("key", n.alias("n"), edits.alias("e")).where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("e"))))
    bound = lambda i: F.floor(i * F.col("n") / (F.col("e") + 1)).cast("int")
    cut = cut.withColumns({"at": bound(F.col("i")), "size": bound(F.col("i") + 1) - bound(F.col("i"))}).where("size > 0")
    pieces = cut.select("key", "e", "at", F.substring(F.col("key"), F.col("at") + 1, F.col("size")).alias("piece"))
    sizes = sorted(r["size"] for r in cut.select("size").distinct().collect())  # lengths of pieces of titles
    met = None
    for size in sizes:
        starts = F.explode(F.sequence(F.lit(1), F.length("book") - size + 1)).alias("p")
        some = books.where(F.length("book") >= size).select("book", starts).select("book", (F.col("p") - 1).alias("p"), F.substring(F.col("book"), F.col("p"), F.lit(size)).alias("piece"))
        met = some if met is None else met.unionByName(some)
    if met is None:
        return keys.select("key", F.lit("").alias("book"), F.lit(0.0).alias("close")).limit(0)
    pairs = pieces.join(met, "piece").where(F.abs(F.col("p") - F.col("at")) <= F.col("e")).select("key", "book").distinct()
    close = 1 - F.levenshtein("key", "book") / F.greatest(F.length("key"), F.length("book"))
    return pairs.withColumn("close", close).where(F.col("close") >= least)
