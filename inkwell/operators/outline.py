"""Chapters of documents: cleaned headings, titles of the table of contents found again in the text, and page ranges of long chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.operators.graph import staged
from inkwell.operators.repair import clean_heading, title_case, title_key

CONTENT = ("paragraph", "list", "epigraph")
LEAST, MOST, REPEATS = 3, 150, 5
#: A title said again later with fewer content blocks than this before the next one is a line of the contents.
LISTED = 20
#: The contents stand in the first so many blocks, or the first eighth.
FRONT = 200
#: Titles of the contents have keys of six characters at least; forty tell them apart.
KEY, WIDE = 6, 40

# A line that ends in a page number, an entry led to its page by dots, an entry of a numbered list.
PAGED = r"(\s|\.)([0-9]{1,4}|[ivxlc]{1,7})$"
DOTTED = r"([A-Z“\"][^.\n]{2,80}?)\s*(?:\.\s*){3,}(?:[0-9]{1,4}|[ivxlc]{1,7})\b"
NUMBERED = r"(?:^|\s)([0-9]{1,2})\s+([A-Z“\"].{2,90}?)(?=\s+[0-9]{1,2}\s+[A-Z“\"]|\s*$)"
CONTENTS = r"(?i)^(table of )?contents\b"


def _doc():
    return Window.partitionBy("doc_id")


def _in_order():
    return _doc().orderBy("i")


def _measured(blocks: DataFrame) -> DataFrame:
    """Blocks with their place i and, up to and with them, the content blocks, the blocks with text, those that look listed, and words."""
    content = F.col("type").isin(*CONTENT)
    body = content | (F.col("type") == "heading")
    text = F.coalesce("text", F.lit(""))
    b = blocks.select("doc_id", "ord", "block_id", "type", text.alias("text"), "printed_page", F.coalesce("printed_page", F.col("physical_page").cast("string")).alias("page"))
    b = b.withColumn("i", F.row_number().over(_doc().orderBy("ord")) - 1)
    number = lambda c: F.sum(c.cast("long")).over(_in_order().rowsBetween(Window.unboundedPreceding, 0))
    return b.withColumns({
        "is_content": content, "n": F.count("*").over(_doc()), "content": number(content), "body": number(body),
        "listed": number(body & F.trim("text").rlike(PAGED)),
        "words": number(F.when(body, F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != ""))).otherwise(0)),
        "before_page": F.lag("page").over(_in_order()),
    })


def _headed(b: DataFrame, least: int) -> DataFrame:
    """Starts of chapters by headings. A running header, a title that a document repeats, one with little to read before
    the next other title, and the title of a list of contents open nothing."""
    heads = b.where("type = 'heading'").select("*", F.explode(F.array(clean_heading(F.col("text")))).alias("h"))  # a generator: cleaned once, not once a use
    heads = heads.withColumn("key", title_key(F.col("h.title"))).where("key <> ''")
    same = Window.partitionBy("doc_id", "key")
    heads = heads.withColumns({"times": F.count("*").over(same), "runs": F.max("h.running").over(same), "first": F.min("i").over(same)})
    heads = heads.where((F.col("times") < REPEATS) & ~(F.col("runs") & (F.col("i") > F.col("first"))))
    heads = heads.withColumn("turn", F.sum(F.coalesce(F.col("key") != F.lag("key").over(_in_order()), F.lit(True)).cast("int")).over(_in_order()))
    sums = ["content", "body", "listed", "words"]
    # where the next other title stands: the sums before it, or the document's
    after = _doc().orderBy("turn").rangeBetween(1, Window.unboundedFollowing)
    here = F.struct("i", F.col("content").alias("content"), (F.col("body") - 1).alias("body"), (F.col("listed") - F.trim("text").rlike(PAGED).cast("int")).alias("listed"),
                    (F.col("words") - F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != ""))).alias("words"))
    whole = b.where("i = n - 1").select("doc_id", *[F.col(s).alias(f"all_{s}") for s in sums])
    heads = heads.withColumn("next", F.min(here).over(after)).join(whole, "doc_id")
    between = {s: F.coalesce(F.col("next")[s], F.col(f"all_{s}")) - F.col(s) for s in sums}
    contents = (between["body"] > 0) & (2 * between["listed"] >= between["body"]) & (between["words"] < 25 * between["body"])
    heads = heads.where((between["content"] >= least) & ~contents)
    heads = heads.withColumn("said", F.lag("key").over(_in_order())).where(F.col("said").isNull() | (F.col("said") != F.col("key")))
    return heads.select("doc_id", "i", F.col("h.title").alias("title"), "key")


def listed_titles(b: DataFrame) -> DataFrame:
    """(doc_id, k, title, toc_end): entries of a document's contents in order, if there are three at least."""
    squeezed = F.trim(F.regexp_replace("text", r"\s+", " "))
    # an entry has three points in a row, or stands in a list that says so: few blocks do, and only they meet the slower patterns
    likely = F.col("text").rlike(r"\.\s*\.\s*\.") | F.lower("text").contains("contents")
    front = b.where((F.col("i") < F.greatest(F.lit(FRONT), F.floor(F.col("n") / 8))) & likely).withColumn("s", squeezed)
    dotted = F.regexp_extract_all("s", F.lit(DOTTED), F.lit(1))
    numbers = F.transform(F.regexp_extract_all("s", F.lit(NUMBERED), F.lit(1)), lambda x: x.cast("int"))
    counted = F.col("s").rlike(CONTENTS) & (F.slice(numbers, F.lit(1), F.lit(3)) == F.array(F.lit(1), F.lit(2), F.lit(3)))
    found = F.when(F.size(dotted) > 0, dotted).when(counted, F.regexp_extract_all("s", F.lit(NUMBERED), F.lit(2)))
    each = front.select("doc_id", "i", F.posexplode(found).alias("at", "title"))
    each = each.withColumns({"k": F.row_number().over(_doc().orderBy("i", "at")), "toc_end": F.max("i").over(_doc()), "entries": F.count("*").over(_doc())})
    return each.where("entries >= 3").select("doc_id", "k", F.trim("title").alias("title"), "toc_end")


def aligned(b: DataFrame) -> DataFrame:
    """Starts of chapters by the contents: each entry at the first block after the entry before that begins with its
    title. Blocks meet entries by the first characters of their keys; what is left is one pass over a document's few pairs."""
    entries = staged(listed_titles(b), "outline-entries").withColumn("key", F.left(title_key(F.col("title")), F.lit(WIDE))).where(F.length("key") >= KEY).withColumn("begin", F.left("key", F.lit(KEY)))
    begun = b.where(F.col("is_content") | (F.col("type") == "heading")).select("doc_id", "i", F.left("text", F.lit(160)).alias("text"))
    begun = begun.join(entries.select("doc_id").distinct(), "doc_id", "left_semi")  # most documents list nothing
    text = begun.select("doc_id", "i", title_key(F.regexp_replace("text", r"^[0-9]{1,3}\s+", "")).alias("head"))
    text = text.where(F.length("head") >= KEY).withColumn("begin", F.left("head", F.lit(KEY)))
    pairs = text.join(entries, ["doc_id", "begin"]).where("i > toc_end AND startswith(head, key)")
    lists = pairs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "i", "title"))).alias("p"))
    walk = """aggregate(p, named_struct('k', 0, 'i', -1, 'picked', cast(array() AS array<struct<i: int, title: string>>)),
      (s, x) -> if(x.k > s.k AND x.i > s.i, named_struct('k', x.k, 'i', x.i, 'picked', concat(s.picked, array(named_struct('i', x.i, 'title', x.title)))), s)).picked"""
    picked = lists.select("doc_id", F.expr(walk).alias("picked")).where("size(picked) >= 3").select("doc_id", F.explode("picked").alias("x"))
    bare = F.regexp_replace(F.regexp_replace("x.title", r"\s+", " "), r"^[ .]+|[ .]+$", "")
    upper = bare.rlike(r"\p{Lu}") & ~bare.rlike(r"\p{Ll}")
    title = F.when(upper, title_case(bare)).otherwise(F.concat(F.upper(F.left(bare, F.lit(1))), F.substring(bare, 2, 1 << 20)))
    return picked.select("doc_id", "x.i", title.alias("title"))


def _merged(heads: DataFrame, listed: DataFrame) -> DataFrame:
    """Headings, and entries of the contents that start more than two blocks from any other start."""
    near = heads.select("doc_id", F.explode(F.sequence(F.col("i") - 2, F.col("i") + 2)).alias("i")).distinct()
    apart = listed.join(near, ["doc_id", "i"], "left_anti").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "title"))).alias("p"))
    walk = """aggregate(p, cast(array() AS array<struct<i: int, title: string>>),
      (s, x) -> if(size(s) = 0 OR x.i - element_at(s, -1).i > 2, concat(s, array(x)), s))"""
    kept = apart.select("doc_id", F.explode(F.expr(walk)).alias("x")).select("doc_id", "x.i", "x.title", title_key(F.col("x.title")).alias("key"))
    return heads.unionByName(kept)


def _page_cuts(b: DataFrame, chapters: DataFrame, most: int) -> DataFrame:
    """Parts (doc_id, i, start) of chapters of more than `most` content blocks, cut at the first turn of a page once a part is
    full, or a third of a part later."""
    target = F.col("chapter.content") / F.ceil(F.col("chapter.content") / most)
    inside = b.join(chapters.select("doc_id", "i", F.struct(F.col("i").alias("start"), F.col("content_blocks").alias("content"), F.col("opened").alias("opened")).alias("starts")), ["doc_id", "i"], "left")
    inside = inside.withColumn("chapter", F.last("starts", ignorenulls=True).over(_in_order())).where("chapter IS NOT NULL")
    seen = F.col("content") - F.col("chapter.opened")
    inside = inside.withColumns({"target": target, "seen": seen}).withColumn("c", F.floor(F.col("seen") / F.col("target")).cast("int"))
    full = (F.col("c") >= 1) & (F.col("c") < F.ceil(F.col("chapter.content") / most)) & F.col("is_content") & (F.col("i") > F.col("chapter.start"))
    turned = ~F.col("page").eqNullSafe(F.col("before_page")) | (F.col("seen") >= F.col("target") * (F.col("c") + F.lit(1) / 3))
    cuts = inside.where((F.col("chapter.content") > most) & full & turned).groupBy("doc_id", "chapter.start", "c").agg(F.min("i").alias("i"))
    return cuts.select("doc_id", "i", "start").unionByName(chapters.select("doc_id", "i", F.col("i").alias("start")))


def outline(blocks: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Chapters in reading order: (doc_id, start, end, title, printed_page, block_id, content_blocks); start and end are places of blocks.

    blocks: doc_id, ord, block_id, type, text, printed_page (string), physical_page. A chapter longer than `most` content blocks is
    cut into page ranges; a document without chapters is cut so if it is that long. All is windows and joins by document
    over a written table; documents without blocks have no rows, null texts are empty.
    """
    b = staged(_measured(blocks), "outline-blocks")
    starts = _merged(staged(_headed(b, least), "outline-heads"), aligned(b)).join(b.select("doc_id", "i", "n", F.col("content").alias("opened")), ["doc_id", "i"])
    starts = staged(starts, "outline-starts")
    ends = lambda df: df.withColumn("end", F.lead("i").over(_in_order()))

    def counted(df: DataFrame) -> DataFrame:
        stop = b.select("doc_id", (F.col("i") + 1).alias("end"), F.col("content").alias("closed"))
        df = ends(df).withColumn("end", F.coalesce("end", "n").cast("int")).join(stop, ["doc_id", "end"])
        # the block at `end` itself is not counted: `closed` is what the block before it has seen
        return df.withColumn("content_blocks", F.col("closed") - F.col("opened"))

    again = F.lead("i").over(Window.partitionBy("doc_id", "key").orderBy("i")).isNotNull()
    starts = counted(starts).withColumn("again", again).where(~F.col("again") | (F.col("content_blocks") >= LISTED)).drop("end", "closed", "content_blocks", "again")
    starts = counted(starts).where((F.col("content_blocks") > 0) | (F.col("end") == F.col("n"))).drop("end", "closed", "content_blocks")
    chapters = staged(counted(starts).select("doc_id", "i", "title", "n", "opened", "content_blocks"), "outline-chapters")
    whole = b.where("i = n - 1").where(F.col("content") > most).select("doc_id", "n", F.col("content").alias("content_blocks")).join(chapters.select("doc_id").distinct(), "doc_id", "left_anti")
    whole = whole.join(b.where("i = 0").select("doc_id", "i", F.col("content").alias("opened")), "doc_id").withColumn("title", F.lit(""))
    chapters = staged(chapters.unionByName(whole), "outline-chapters")
    parts = _page_cuts(b, chapters, most).withColumns({"part": F.row_number().over(Window.partitionBy("doc_id", "start").orderBy("i")), "parts": F.count("*").over(Window.partitionBy("doc_id", "start"))})
    parts = parts.join(chapters.select("doc_id", F.col("i").alias("start"), "title"), ["doc_id", "start"])
    inside = b.join(parts.select("doc_id", "i", F.struct("i", "title", "part", "parts").alias("starts")), ["doc_id", "i"], "left")
    inside = inside.withColumn("p", F.last("starts", ignorenulls=True).over(_in_order())).where("p IS NOT NULL")
    paged = F.col("printed_page").isNotNull() & (F.col("printed_page") != "None")
    per = inside.groupBy("doc_id", "p").agg(
        F.min_by("printed_page", F.when(paged, F.col("i"))).alias("p1"), F.max_by("printed_page", F.when(paged, F.col("i"))).alias("p2"),
        F.min_by("printed_page", "i").alias("printed_page"), F.min_by("block_id", "i").alias("block_id"), (F.max("i") + 1).alias("end"),
        F.sum(F.col("is_content").cast("long")).alias("held"), F.min_by(F.col("is_content").cast("long"), "i").alias("first"),
    )
    pages = F.when(F.col("p1") == F.col("p2"), F.concat(F.lit("p. "), "p1")).when(F.col("p1").isNotNull(), F.concat(F.lit("pp. "), "p1", F.lit("–"), "p2"))
    place = F.coalesce(pages, F.concat(F.lit("part "), F.col("p.part").cast("string"), F.lit(" of "), F.col("p.parts").cast("string")))
    base = F.when(F.col("p.title") == "", "Text").otherwise(F.col("p.title"))
    title = F.when(F.col("p.parts") == 1, F.col("p.title")).otherwise(F.concat(base, F.lit(" ("), place, F.lit(")")))
    opened = (F.col("p.part") == 1) & (F.col("p.title") != "")
    return per.select("doc_id", F.col("p.i").alias("start"), "end", title.alias("title"), "printed_page", "block_id", (F.col("held") - F.when(opened, F.col("first")).otherwise(0)).alias("content_blocks"))
