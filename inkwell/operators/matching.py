"""Which of thousands of forms occur in a passage: words, open stems (`resent*`) and phrases, in one walk over its tokens."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Forms are broadcast as a trie up to so many rows, and joined by their first word beyond.
BROADCAST_FORMS = 200_000
#: Tokens whose outcome a task remembers at a time.
REMEMBERED = 1 << 16
#: An open stem is this long at least.
LEAST_STEM = 3

# What a passage's and a form's tokens are, and how a last word turns into its other number (the first rule that fits counts).
TOKEN = r"[a-z0-9]+(?:'[a-z]+)?"
NUMBERS = [(r"^(.{2,})ies$", "$1y"), (r"^(.{2,}[^s])s$", "$1"), (r"^(.{2,}[^aeiou])y$", "$1ies"), (r"^(\p{L}{2,}[\p{L}&&[^s]])$", "$1s")]


def tokens(text: Column) -> Column:
    """Tokens with inner apostrophes, whatever their shape, in lower case."""
    return F.regexp_extract_all(F.translate(F.lower(text), "’‘", "''"), F.lit(TOKEN), F.lit(0))


def text_tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower().replace("’", "'").replace("‘", "'"))


def plain_tokens(text: str) -> list[str]:
    return [t.lower() for t in re.findall(r"[A-Za-z0-9']+", text)]


def other_number(word: Column) -> Column:
    """The plural of a singular or the singular of a plural; null where no rule fits."""
    out = F.lit(None).cast("string")
    for pattern, instead in reversed(NUMBERS):
        out = F.when(word.rlike(pattern), F.regexp_replace(word, pattern, instead)).otherwise(out)
    return out


def prepared(forms: DataFrame, numbers: bool = True) -> DataFrame:
    """(concept, words, open, times) of forms (concept, form): tokens of each form and of its other number.

    A trailing star opens the last word; single open words of under three characters are left out, so are forms without
    a token. A word counts once for a concept; a phrase as often as the concept gives it.
    """
    plain = F.translate(F.lower(F.trim("form")), "’", "'")
    f = forms.select("concept", plain.alias("form")).withColumn("open", F.col("form").endswith("*"))
    if numbers:
        last = F.regexp_extract("form", r"(\S*)$", 1)
        other = F.concat(F.regexp_replace("form", r"\S*$", ""), other_number(last))
        f = f.select("concept", "open", F.explode(F.array_compact(F.array("form", F.when(~F.col("open"), other)))).alias("form"))
    f = f.select("concept", tokens(F.rtrim(F.regexp_replace("form", r"\*+$", ""))).alias("words"), "open")
    f = f.where((F.size("words") > 1) | ((F.size("words") == 1) & (~F.col("open") | (F.length(F.col("words")[0]) >= LEAST_STEM))))
    counted = f.groupBy("concept", "words", "open").agg(F.count("*").alias("n"))
    return counted.select("concept", "words", "open", F.when(F.size("words") == 1, 1).otherwise(F.col("n")).cast("long").alias("times"))


class Node:
    """A place in the trie: forms that end here, stems that end with any word that begins so (by their length), and what goes on."""

    __slots__ = ("ends", "stems", "next")

    def __init__(self):
        self.ends: list[tuple[object, int]] = []
        self.stems: dict[int, dict[str, list[tuple[object, int]]]] = {}
        self.next: dict[str, Node] = {}

    def step(self, word: str) -> tuple[list[tuple[object, int]], Node | None]:
        """What a word completes at this place, and where it leads."""
        after = self.next.get(word)
        done = list(after.ends) if after else []
        for length, stems in self.stems.items():
            done += stems.get(word[:length], ()) if len(word) >= length else ()
        return done, after if after and (after.next or after.stems) else None


def trie(rows: list) -> Node:
    root = Node()
    for concept, words, is_open, times in rows:
        node = root
        for word in words[:-1] if is_open else words:
            node = node.next.setdefault(word, Node())
        if is_open:
            node.stems.setdefault(len(words[-1]), {}).setdefault(words[-1], []).append((concept, times))
        else:
            node.ends.append((concept, times))
    return root


def walked(root: Node, words: list[str], first: dict[str, tuple | None]) -> dict[object, int]:
    """Hits by concept. `first` remembers what a word does at the root: nothing for nearly all of them."""
    hits: dict[object, int] = {}
    for at, word in enumerate(words):
        known = first.get(word, ())
        if known == ():
            if len(first) >= REMEMBERED:
                first.clear()
            done, node = root.step(word)
            known = first[word] = (done, node) if done or node else None
        if known is None:
            continue
        done, node = known
        k = at + 1
        while True:
            for concept, times in done:
                hits[concept] = hits.get(concept, 0) + times
            if node is None or k >= len(words):
                break
            done, node = node.step(words[k])
            k += 1
    return hits


def matches(passages: DataFrame, forms: DataFrame, keys: list[str], text: str = "text", split: Callable[[str], list[str]] = text_tokens) -> DataFrame:
    """(keys..., concept, hits): a row per passage and concept with a form in it. forms: as `prepared` gives them.

    Passages are walked where they are read, and only hits leave the row: nothing is shuffled. Beyond BROADCAST_FORMS
    forms they meet by their first words instead. Passages are read once; null texts hit nothing.
    """
    few = forms.limit(BROADCAST_FORMS + 1).collect()
    if len(few) > BROADCAST_FORMS:
        return joined(passages, forms, keys, text)
    spark = passages.sparkSession
    shared = spark.sparkContext.broadcast(trie([(r.concept, list(r.words), r.open, r.times) for r in few]))
    rows = passages.select(*keys, text)
    schema = StructType([*rows.schema.fields[:-1], forms.schema["concept"], *StructType.fromDDL("hits long").fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        root, first = shared.value, {}
        for batch in batches:
            at, concepts, hits = [], [], []
            for i, passage in enumerate(x.as_py() for x in batch.column(batch.num_columns - 1)):  # one passage at a time leaves Arrow's memory
                for concept, n in walked(root, split(passage), first).items() if passage else ():
                    at.append(i)
                    concepts.append(concept)
                    hits.append(n)
            found = batch.select(range(batch.num_columns - 1)).take(pa.array(at, pa.int32()))  # without the texts
            yield pa.RecordBatch.from_arrays([*found.columns, pa.array(concepts, arrow.field("concept").type), pa.array(hits, pa.int64())], schema=arrow)

    return rows.mapInArrow(run, schema)


def joined(passages: DataFrame, forms: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The same rows by equi-joins on the first word, or on an open stem's first three characters; the rest is compared in the row."""
    longest = forms.agg(F.max(F.size("words"))).first()[0] or 1
    at = passages.select(*keys, tokens(F.col(text)).alias("_t")).select(*keys, "_t", F.explode(F.sequence(F.lit(1), F.greatest(F.size("_t"), F.lit(1)))).alias("_i")).where("size(_t) > 0")
    at = at.select(*keys, F.slice("_t", F.col("_i"), longest).alias("_w"))
    head = F.col("words")[0]
    lone = (F.size("words") == 1) & F.col("open")
    stems = forms.where(lone).select("concept", "times", F.substring(head, 1, LEAST_STEM).alias("_head"), head.alias("_stem"))
    by_stem = at.withColumn("_head", F.substring(F.col("_w")[0], 1, LEAST_STEM)).join(stems, "_head").where(F.startswith(F.col("_w")[0], F.col("_stem")))
    whole = forms.where(~lone).select("concept", "times", "open", "words", head.alias("_head"))
    by_word = at.withColumn("_head", F.col("_w")[0]).join(whole, "_head").where(F.size("_w") >= F.size("words"))
    n = F.size("words")
    body = F.slice("_w", F.lit(1), n - 1) == F.slice("words", F.lit(1), n - 1)
    last, asked = F.element_at("_w", n), F.element_at("words", n)
    by_word = by_word.where(body & ((last == asked) | (F.col("open") & F.startswith(last, asked))))
    both = by_stem.select(*keys, "concept", "times").unionByName(by_word.select(*keys, "concept", "times"))
    return both.groupBy(*keys, "concept").agg(F.sum("times").alias("hits"))
