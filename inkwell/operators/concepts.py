"""Concept labels and their graph: keys, checks, peers, places where they occur."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators.graph import cooccurrence
from inkwell.operators.ranking import top

# Words that do not tell labels apart, endings with the least length of a word that drops them,
# what a label said aloud looks like, and what no candidate may hold.
UNTOLD = ["the", "a", "an", "this", "that", "our", "of", "to", "and", "&"]
ENDINGS = [("ing", 6, ""), ("ies", 5, "y"), ("es", 6, ""), ("s", 4, ""), ("ed", 6, "")]
ALOUD = r"(?i)\b(wait|hmm|actually|final answer|that's wrong|i think|keep true)\b"
JUNK = r"\d|\b(?:ibid|doi|pp?|vol|ed|eds|isbn|www|http)\b"


def stem(word: Column) -> Column:
    out = word
    for ending, least, instead in reversed(ENDINGS):
        cut = F.concat(F.left(word, F.length(word) - len(ending)), F.lit(instead))
        out = F.when(word.endswith(ending) & (F.length(word) >= least) & ~word.endswith("ss"), cut).otherwise(out)
    return out


def merge_key(label: Column) -> Column:
    """One key for labels that differ in articles, plurals, -ing or punctuation only."""
    words = F.filter(F.regexp_extract_all(F.lower(label), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(UNTOLD))
    return F.array_join(F.transform(words, lambda w: stem(w)), " ")


def clean_label(label: Column) -> Column:
    """Blanks run together, brackets and what they hold dropped, quotes and end marks cut off."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(label, " ", " "), r"\s+", " "))
    bare = F.regexp_replace(F.regexp_replace(plain, r"\s*\([^)]*\)", ""), r"^['\"“”‘’ ]+|[.,;:·'\"“”‘’ ]+$", "")
    return F.when(bare != "", bare).otherwise(plain)


def sane_label(label: Column) -> Column:
    """Neither too short nor too long, no question, no thinking aloud, no word three times in five, mostly letters."""
    words = F.regexp_extract_all(F.lower(label), F.lit("[A-Za-z']+"), F.lit(0))
    letters = F.length(F.regexp_replace(label, r"[^\p{L}]", ""))
    repeated = F.exists(words, lambda w: F.size(words) - F.size(F.array_remove(words, w)) >= 3) & (F.size(words) >= 5)
    return F.length(label).between(2, 60) & ~label.contains("?") & ~label.rlike(ALOUD) & (F.size(words) > 0) & ~repeated & (letters / F.length(label) >= 0.6)


def junk(key: Column) -> Column:
    return key.rlike(JUNK)


def peers(hits: DataFrame, item: str, node: str, least: int = 2, floor: float = 0.02, k: int = 800) -> DataFrame:
    """(node, peer, shared, strength, rank): associated nodes, those with more shared items ahead; k of a node at most."""
    edges = cooccurrence(hits, item, node, least, floor)
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("peer"), "shared", "npmi").union(edges.select("b", "a", "shared", "npmi"))
    strength = F.round(F.col("npmi") * (1 + F.lit(0.15) * F.log1p(F.col("shared").cast("double"))), 6)
    return top(both.withColumn("strength", strength), k, ["node"], F.desc("strength"), "peer").select("node", "peer", "shared", "strength", "rank")


def strongest_edges(edges: DataFrame, k: int, weight: str = "weight") -> DataFrame:
    """Edges (a, b, weight) among the k strongest of either end."""
    both = edges.select("a", "b", weight, F.explode(F.array("a", "b")).alias("end"))
    return top(both, k, ["end"], F.desc(weight), "a", "b").select("a", "b", weight).distinct()


def places(hits: DataFrame, node: str, book: str, chapter: str, k: int = 150) -> DataFrame:
    """(node, book, chapter, count, in_book): a node's chapters by how often it occurs there, with its count in the book."""
    counts = hits.groupBy(node, book, chapter).agg(F.count("*").alias("count"))
    books = counts.groupBy(node, book).agg(F.sum("count").alias("in_book"))
    return top(counts, k, [node], F.desc("count"), book, chapter).join(books, [node, book]).select(node, book, chapter, "count", "in_book")


def in_scope(books: DataFrame, categories: list[str] | None, category: str = "category") -> DataFrame:
    """Books of the named categories; all of them if none is named."""
    if not categories:
        return books
    return books.where(F.col(category).isin(categories))


def folded_names(people: DataFrame) -> DataFrame:
    """(label, count, person): names of people under the fullest one of a surname.

    Names of a surname are one person if of any two first names one begins with the other; otherwise each stays.
    A name in two spellings goes to the more frequent one. people: label, count.
    """
    words = F.filter(F.regexp_extract_all(F.lower(F.regexp_replace("label", r"[’']s\b", "")), F.lit("[a-z]+"), F.lit(0)), lambda w: ~w.isin("dr", "mr", "mrs", "ms"))
    named = people.withColumn("words", words).where(F.size("words") > 0).withColumn("surname", F.element_at("words", -1)).withColumn("first", F.when(F.size("words") > 1, F.element_at("words", 1)))
    key = F.array_join("words", " ")
    spelled = named.groupBy(key.alias("key")).agg(F.max_by("label", F.struct("count", "label")).alias("best"), F.sum("count").alias("total"), F.first("surname").alias("surname"), F.first("first").alias("first"))
    # any two first names begin with one another just if each begins the longest
    firsts = spelled.where("first IS NOT NULL AND length(surname) >= 4").select("surname", "first").distinct()
    ends = firsts.groupBy("surname").agg(F.max_by("first", F.length("first")).alias("long"))
    odd = firsts.join(ends, "surname").groupBy("surname").agg(F.max((~F.startswith(F.col("long"), F.col("first"))).cast("int")).alias("odd"))
    best = spelled.where("length(surname) >= 4").groupBy("surname").agg(F.max_by("best", F.struct(F.col("first").isNotNull(), "total", "best")).alias("fullest"))
    by = spelled.join(odd, "surname", "left").join(best, "surname", "left")
    person = F.when((F.length("surname") >= 4) & (F.coalesce("odd", F.lit(0)) == 0), F.col("fullest")).otherwise(F.col("best"))
    return named.withColumn("key", key).join(by.select("key", person.alias("person")), "key").select("label", "count", "person")
