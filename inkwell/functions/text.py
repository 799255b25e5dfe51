"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Search tokens: runs of ASCII letters, digits and apostrophes, in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9']+"), F.lit(0)), F.lower)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def ascii_edges(pattern: str) -> str:
    r"""A pattern whose \b stands between ASCII words alone, as \w does: Java's \b also takes other letters for parts of words."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def short_hash(text: Column, n: int) -> Column:
    return F.substring(F.sha1(text), 1, n)


def identity(user: Column) -> Column:
    """A user's pseudonym: 24 hex digits of a salted hash."""
    return F.substring(F.sha2(F.concat(F.lit("sc-user:"), user.cast("string")), 256), 1, 24)


def e164(digits: Column) -> Column:
    """North American numbers in E.164, else null."""
    plain = F.regexp_replace(digits, "[^0-9]", "")
    return F.when(F.length(plain) == 10, F.concat(F.lit("+1"), plain)).when(
        (F.length(plain) == 11) & plain.startswith("1"), F.concat(F.lit("+"), plain)
    )
