"""Retrieval as one function: both sides of a query batch, every factor of a chunk's score, and a varied choice of results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.text import ascii_edges
from inkwell.operators.ranking import diversified

# Marks of back-of-book indexes, endnotes, lists of steps and contents, running headers; and what they count for.
INDEX_RUN = r"(?i)\b\d{1,3}\s*,\s*\d{1,3}(?:\s*[,–\-]\s*\d{1,3})+|\bref\d+\s*,\s*ref\d+"
INDEX_ENTRY = r"(?:\bSee\s+also\b|\bSee\s+[A-Z]|\bINDEX\b|\bref\d+\b|,\s*\d{1,3}(?:[–\-]\d{1,3})?\b)"
ENDNOTE = r"(?i)(?:\bCf\.\s|\bibid\b|\bop\.\s*cit\.|\bAAGV\b|\bpp?\.\s*\d{1,3}\b)"
ENUMERATION = (
    r"(?i)(?:Step|Tradition)\s+(?:One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten|Eleven|Twelve)\s*(?:[:.)]|\d{1,3}\b)"
    r"|\b(?:[1-9]|1[0-2])\s*[.)]\s*(?:We\s+admitted|Came\s+to\s+believe|Made\s+a\s+(?:decision|list)"
    r"|Made\s+direct\s+amends|Were\s+entirely\s+ready|Humbly\s+asked|Continued\s+to\s+take"
    r"|Sought\s+through\s+prayer|Having\s+had\s+a\s+spiritual|Admitted\s+to\s+God|Became\s+willing)"
)
CONTENTS = r"\bCONTENTS\b"
HEADER = r"^(?:(?:[A-Z][A-Z\s\-\.',&]+\d+|\d+\s+[A-Z][A-Z\s\-\.',&]+|[\-•]\s*\w+\s+\d+\s*[\-•])\s*\n){1,3}"
INDEX_FACTOR, LIST_FACTOR, HEADER_FACTOR, HEADER_WORDS, MARKS = 0.20, 0.45, 0.35, 15, 5
SCALES = {"small": 1.0, "medium": 0.97, "large": 0.95, "topic": 0.96}


@dataclass
class Weights:
    """What a score is made of. works: (phrases in a question, parts of a source's name) of works named by title; priors: parts of a
    source's name and their factor where no work is named, the first that fits counting."""

    semantic: float = 0.7
    keyword: float = 0.3
    scales: dict[str, float] = field(default_factory=lambda: dict(SCALES))
    categories: dict[str, float] = field(default_factory=dict)
    works: list[tuple[list[str], list[str]]] = field(default_factory=list)
    priors: list[tuple[list[str], float]] = field(default_factory=list)
    named: float = 3.0
    per_source: int = 2
    per_named: int = 4
    ratio: float = 0.5


def _times(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(ascii_edges(pattern)), F.lit(0)))


def listed_factor(text: Column, context: Column | None = None) -> Column:
    """Less for pages of an index or of endnotes, as the text and its context show, and for bare lists of steps or contents."""
    whole = text if context is None else F.concat_ws("\n", text, context)
    index = (_times(whole, INDEX_RUN) >= 1) | (_times(whole, INDEX_ENTRY) >= 5) | (_times(whole, ENDNOTE) >= 3)
    marks = _times(text, ENUMERATION) + F.when(text.rlike(ascii_edges(CONTENTS)), 3).otherwise(0)
    return F.when(index, INDEX_FACTOR).when(marks >= MARKS, LIST_FACTOR).otherwise(1.0)


def header_factor(text: Column, scale: Column) -> Column:
    """Less for small chunks that hold little besides running headers."""
    return F.when((scale == "small") & (_times(F.regexp_replace(text, HEADER, ""), "[A-Za-z0-9]+") < HEADER_WORDS), HEADER_FACTOR).otherwise(1.0)


def named_works(question: Column, works: list[tuple[list[str], list[str]]]) -> Column:
    """Parts of the names of the sources that a question names by title."""
    low = F.lower(F.coalesce(question, F.lit("")))
    holds = lambda phrases: F.coalesce(*[F.when(low.contains(p), True) for p in phrases], F.lit(False))
    groups = [F.when(holds(phrases), F.array(*[F.lit(s) for s in sources])) for phrases, sources in works]
    return F.array_distinct(F.flatten(F.array_compact(F.array(*groups)))) if groups else F.array().cast("array<string>")


def _prior(source: Column, priors: list[tuple[list[str], float]]) -> Column:
    low = F.lower(F.coalesce(source, F.lit("")))
    fits = lambda parts: F.coalesce(*[F.when(low.contains(p), True) for p in parts], F.lit(False))
    return F.coalesce(*[F.when(fits(parts), factor) for parts, factor in priors], F.lit(1.0))


def scored(chunks: DataFrame, semantic: DataFrame, keyword: DataFrame, questions: DataFrame, weights: Weights, categories: list[str] | None = None) -> DataFrame:
    """(qid, key, score, named) of every candidate of either side.

    chunks: key, text, context, scale, category, source; semantic: qid, key, sem; keyword: qid, key, kw; questions: qid, text. Chunks
    outside the categories are left out of both sides before each is taken over its best. Both sides are a bounded list a query; chunks meet
    them by key once, after what their texts say has become a factor, and what has met is dealt by query once.
    """
    kept = chunks if not categories else chunks.where(F.col("category").isin(categories))
    weighed = kept.withColumn("listed", listed_factor(F.col("text"), F.col("context")) * header_factor(F.col("text"), F.col("scale"))).drop("text", "context")  # once a chunk
    met = semantic.join(keyword, ["qid", "key"], "full").join(weighed, "key")
    w = Window.partitionBy("qid")
    part = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / F.greatest(F.coalesce(F.max(c).over(w), F.lit(1.0)), F.lit(1e-6))
    base = met.withColumn("base", weights.semantic * part("sem") + weights.keyword * part("kw")).drop("sem", "kw")
    asked = questions.select("qid", named_works(F.col("text"), weights.works).alias("works"))
    rows = base.join(asked, "qid", "left").withColumn("works", F.coalesce("works", F.array().cast("array<string>")))
    source = F.lower(F.coalesce("source", F.lit("")))
    rows = rows.withColumn("named", F.exists("works", lambda x: source.contains(x)))
    title = F.when(F.col("named"), weights.named).when(F.size("works") > 0, 1.0).otherwise(_prior(F.col("source"), weights.priors))
    table = lambda column, values: F.coalesce(*[F.when(F.col(column) == k, v) for k, v in values.items()], F.lit(1.0))
    factors = table("scale", weights.scales) * table("category", weights.categories) * title * F.col("listed")
    return rows.select("qid", "key", (F.col("base") * factors).alias("score"), "named", "scale", "source", F.coalesce("context_id", F.col("key").cast("string")).alias("context_id"))


def retrieve(chunks: DataFrame, semantic: DataFrame, keyword: DataFrame, questions: DataFrame, k: int = 8, weights: Weights | None = None, categories: list[str] | None = None) -> DataFrame:
    """(qid, key, pick): k results a query, from small, medium and large chunks in turn, a context once and a source no more often
    than `per_source` (`per_named` if the question names it); then the best of the rest. chunks also: context_id."""
    weights = weights or Weights()
    found = scored(chunks, semantic, keyword, questions, weights, categories)
    bucket = F.when(F.col("scale") == "topic", "large").otherwise(F.col("scale"))
    rows = found.select("qid", "key", bucket.alias("bucket"), "source", F.col("context_id").alias("context"), F.round("score", 9).alias("score"), F.when(F.col("named"), weights.per_named).otherwise(weights.per_source).alias("cap"))
    return diversified(rows, k, weights.per_source, ["small", "medium", "large"], weights.ratio)
