"""The operators of this subpackage applied to the given tables, whole tables and whole texts."""

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import (
    conversation_trie,
    decontaminate,
    kneser_ney,
    packing,
    page_difference,
    paragraphs,
    periodic,
    pii,
    quality_rules,
    sharding,
    simhash,
    suffix_dedup,
    toxicity,
)
from emberline.llm.common import documents, words


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file, 2 MB at most, read once by the driver."""
    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def op1_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.removals(documents(spark, sf_dir))


def op2_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer())


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.checked(documents(spark, sf_dir).select("doc_id", "text"))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op6_zstd_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        (toxicity.fold(F.col("doc_id")) == toxicity.HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), 8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("number").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


def op8_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("removed_by", ",").alias("removed_by"),
    )


def op9_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.col("text").alias("_text"))
    found = decontaminate.find(docs, _table(spark, sf_dir, "benchmark"), "_text")
    hits = decontaminate.n_hit(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


def op10_bucket_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.cut(documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _repeating(doc_id: Column, text: Column) -> Column:
    """Every tenth text (by the id's CRC) with its later words replaced by repetitions of a stretch."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, w = F.floor(h / 10), words(text)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, place(i).cast("int")))

    chosen = (h % 10 == 0) & F.rlike(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
    return F.when(chosen, F.array_join(F.element_at(F.transform(F.array(w), repeated), 1), " ")).otherwise(text)


def op11_dyadic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = periodic.find(docs.select("doc_id", _repeating(F.col("doc_id"), F.col("text")).alias("text")))
    # Greatest length first, then smallest start and period.
    longest = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("p")))), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        longest["s"].alias("start"),
        (-longest["n"]).alias("length"),
        longest["p"].alias("period"),
        F.floor(-1000 * longest["n"] / longest["p"]).cast("long").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_page_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_difference.extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths, conversations = conversation_trie.rebuilt(_table(spark, sf_dir, "conversations"))
    return conversation_trie.nodes_with_digests(paths, conversations).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_paragraph_minhash": op1_paragraph_minhash,
    "op2_complement_packing": op2_complement_packing,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_kneser_ney": op4_kneser_ney,
    "op5_simhash": op5_simhash,
    "op6_zstd_toxicity": op6_zstd_toxicity,
    "op7_virtual_slots": op7_virtual_slots,
    "op8_risk_rules": op8_risk_rules,
    "op9_fm_index": op9_fm_index,
    "op10_bucket_pointer": op10_bucket_pointer,
    "op11_dyadic_runs": op11_dyadic_runs,
    "op12_page_difference": op12_page_difference,
    "op13_turn_trie": op13_turn_trie,
}
