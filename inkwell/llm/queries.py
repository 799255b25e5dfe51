"""The queries opN_<name>: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.arc import archive_pages, read_archives

    back = read_archives(archive_pages(table(spark, sf_dir, "pages")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.multi_index import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.93)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from inkwell.llm.piece_index import encode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, public_tokenizers.path("piece_bpe_32k.model"), with_decoded=True, packed=True)
    return coded.select(
        "doc_id", F.col("n_pieces").cast("long").alias("n_pieces"), F.crc32("piece_ids").alias("ids_crc32"),
        F.col("piece_text").eqNullSafe(F.col("text")).alias("same_text"),
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.mixing import mix

    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"),
    )


def op5_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.line_crf import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out)
    scored = score(docs, fit(docs.where(~held_out), labels))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.line_rules import clean

    done = clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id", F.col("q_n_words").alias("n_words"), F.col("q_word_chars").alias("word_chars"),
        F.col("q_n_symbols").alias("n_symbols"), F.col("q_n_dup_lines").alias("n_dup_lines"),
        F.col("q_n_repeat_words").alias("n_repeat_words"), F.col("q_base_failed").alias("base_failed"),
        F.col("q_kept").alias("kept"),
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.suffix_dedup import remove_repeats

    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.chosen_path import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=80)


def op9_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.brown_lm import score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    scored = score(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from inkwell.llm.token_files import read_token_files, write_token_files

    files = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    back = read_token_files(files)
    return back.select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op11_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.chat_parts import digests, text_parts, write_chats

    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")
    )
    said = F.lit("\\### Assistant: </turn> ok")
    marks = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text")
    )
    content = turns.unionByName(marks).select("conv_id", "turn", "role", text_parts("text").alias("content"))
    return digests(spark, write_chats(content))


def op12_gnat_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.gnat_codes import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.word_runs import word_runs

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    # every tenth document by hash gets a periodic end; its words are split for these rows alone
    words = F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    docs = docs.withColumn("w", words).withColumn("n", F.size("w").cast("long")).withColumn("g", F.expr("h div 10"))
    docs = docs.withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END")).withColumn("p", F.expr("CASE WHEN n > 0 THEN 1 + (n - a) div (3 + g % 8) END"))
    planted = F.expr(
        "array_join(concat(slice(w, 1, int(a)), slice(flatten(array_repeat(slice(w, int(a + 1), int(p)), int((n - a) div p + 1))), 1, int(n - a))), ' ')"
    )
    docs = docs.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))
    found = word_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("col1"), (-r["start"]).alias("col2"), (-r["period"]).alias("col3"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, start, period = (F.col("best").getField(f"col{k}") for k in (1, 2, 3))
    return found.select(
        "doc_id", "n_runs", (-start).alias("start"), length.alias("length"), (-period).alias("period"),
        F.expr("best.col1 * 1000 div -best.col3").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


QUERIES = {f.__name__: f for f in (op1_warc, op2_multi_index, op3_sentencepiece, op4_mixing, op5_line_crf, op6_line_rules, op7_suffix_dedup, op8_chosen_path, op9_brown_lm, op10_token_files, op11_chat_parts, op12_gnat_codes, op13_word_runs)}
