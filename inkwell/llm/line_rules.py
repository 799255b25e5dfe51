"""Quality rules, line first: lines that fail go, then documents that lost too much (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import WORD

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BOILERPLATE = (
    "(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)|"
    "enable javascript|lorem ipsum|licensed under the|subscribe to our|click here|sign up for)"
)
TERMINAL = r"[.!?…:;,\"'”’»)\]][ \t\r]*$"
MIN_WORDS, MAX_REPEAT_PERCENT, MAX_LOST_PERCENT = 50, 50, 40


def _dropped(text: Column, characters: str) -> Column:
    """Characters of a text that are among the given ones."""
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def line_fails(line: Column) -> Column:
    """Whether a line breaks a rule. Lines without words pass: they hold no text.

    punctuation: over one symbol or doubled mark to five words, over half of five or
    more words in capitals, or under three words without an end mark; navigation:
    over one separator to four words; boilerplate: a set phrase.
    """
    words = F.regexp_count(line, F.lit(WORD))
    marks = _dropped(line, SYMBOLS) + F.regexp_count(line, F.lit("[!?]{2,}"))
    capitals = F.regexp_count(line, F.lit(r"\p{Lu}{2,}"))
    separators = _dropped(line, "|»›·>")
    return (words > 0) & (
        (marks * 5 > words)
        | ((words >= 5) & (capitals * 2 > words))
        | ((words < 3) & ~line.rlike(TERMINAL))
        | (separators * 4 > words)
        | line.rlike(BOILERPLATE)
    )


def with_repeats(df: DataFrame) -> DataFrame:
    """Add q_repeat: words covered by 3-word windows that occur twice or more in the row's q_words.

    Windows are hashed; only rows in which two are equal sort them with their places. Linear memory and n log n time in the row's length.
    """
    windows = F.expr(
        "CASE WHEN size(q_words) >= 3 THEN transform(sequence(0, size(q_words) - 3),"
        " i -> xxhash64(q_words[i], q_words[i + 1], q_words[i + 2])) ELSE CAST(array() AS array<bigint>) END"
    )
    df = df.withColumn("q_hash", windows)
    df = df.withColumn("q_twice", F.size(F.array_distinct("q_hash")) < F.size("q_hash"))
    df = df.withColumn(
        "q_pairs",
        F.expr("CASE WHEN q_twice THEN sort_array(transform(q_hash, (x, i) -> struct(x AS h, i AS i)))"
               " ELSE CAST(array() AS array<struct<h: bigint, i: int>>) END"),
    )
    df = df.withColumn(
        "q_at",
        F.expr("sort_array(transform(filter(q_pairs, (x, k) -> (k > 0 AND q_pairs[k - 1].h = x.h)"
               " OR (k + 1 < size(q_pairs) AND q_pairs[k + 1].h = x.h)), x -> x.i))"),
    )
    return df.withColumn(
        "q_repeat",
        F.expr("aggregate(transform(q_at, (x, k) -> CASE WHEN k + 1 < size(q_at) THEN least(3, q_at[k + 1] - x) ELSE 3 END),"
               " 0L, (a, x) -> a + x)"),
    ).drop("q_hash", "q_twice", "q_pairs", "q_at")


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add q_* columns to every row: the base counts, the verdict and the cleaned text.

    q_n_words, q_word_chars, q_n_symbols, q_n_dup_lines, q_n_repeat_words, q_base_failed,
    q_kept, q_kept_chars, q_clean (lines that passed, joined by line ends). A null or empty
    text has no words and fails the base rules. Everything happens inside the row: no
    shuffle, so one long text costs its own length only and equal rows get equal answers.
    """
    df = docs.withColumn("q_text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("q_words", F.expr(r"filter(split(q_text, '[\\x20\\x09-\\x0D]+'), x -> x <> '')"))
    df = df.withColumn("q_n_words", F.size("q_words").cast("long"))
    df = with_repeats(df).drop("q_words").withColumnRenamed("q_repeat", "q_n_repeat_words")
    df = df.withColumn("q_lines", F.split("q_text", "\n"))
    df = df.withColumn("q_full", F.filter("q_lines", lambda x: F.char_length(F.translate(x, BLANKS, "")) > 0))
    df = df.withColumn("q_n_dup_lines", (F.size("q_full") - F.size(F.array_distinct("q_full"))).cast("long")).drop("q_full")
    df = df.withColumn("q_good", F.filter("q_lines", lambda x: ~line_fails(x))).drop("q_lines")
    df = df.withColumn("q_clean", F.array_join("q_good", "\n")).drop("q_good")
    chars = lambda c: F.char_length(F.translate(F.col(c), BLANKS, "")).cast("long")
    df = df.withColumn("q_word_chars", chars("q_text")).withColumn("q_kept_chars", chars("q_clean"))
    df = df.withColumn("q_n_symbols", _dropped(F.col("q_text"), SYMBOLS).cast("long"))
    failed = (F.col("q_n_words") < MIN_WORDS) | (F.lit(100) * F.col("q_n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("q_n_words"))
    lost = F.lit(100) * (F.col("q_word_chars") - F.col("q_kept_chars")) > F.lit(MAX_LOST_PERCENT) * F.col("q_word_chars")
    return df.withColumn("q_base_failed", failed).withColumn("q_kept", ~failed & ~lost).drop("q_text")


def passed(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that are kept, with their cleaned text; the columns stay as they are.

    The verdict is applied by a generator: a plain filter would be pushed down through the
    projections, and every array of words would be built again for each of its elements.
    """
    cleaned = clean(docs, text)
    kept = F.explode(F.when(F.col("q_kept"), F.array("q_clean")).otherwise(F.array().cast("array<string>")))
    out = cleaned.select(*[F.col(f"`{c}`") for c in docs.columns if c != text], kept.alias(text))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
