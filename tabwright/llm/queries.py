"""Registered queries of this subpackage: thin calls of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.bpe import encode_texts
from tabwright.llm.chat import format_chat
from tabwright.llm.common import kept, table
from tabwright.llm.decontaminate import contamination
from tabwright.llm.exact_dedup import exact_groups
from tabwright.llm.fill_in_middle import fill_in_middle, restore, store_frames
from tabwright.llm.jaccard_join import near_classes
from tabwright.llm.langid import learn_profiles, predict_language
from tabwright.llm.line_dedup import dedup_lines
from tabwright.llm.packing import pack
from tabwright.llm.quality import fit_quality, score_quality
from tabwright.llm.secrets import KINDS, scan_secrets, written
from tabwright.llm.spelling import spelling_groups
from tabwright.llm.topk import exact_top_k, integer_vector


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", integer_vector(F.col("embedding")).alias("v"))
    return exact_top_k(rows.where("vec_id % 50 = 0"), rows, 5)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn_profiles(docs.where(~held_out(F.col("doc_id"))))
    found = predict_language(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(table(spark, sf_dir, "conversations"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, fit_quality(docs)).select("doc_id", "posterior", "score", F.col("good").alias("kept"))


def of_kind(k: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == k  # one parameter: Spark passes the place in the array as a second


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    spans = F.col("secret_spans")
    counts = [F.size(F.filter(spans, of_kind(k))).cast("bigint").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    base = written(F.filter(spans, lambda s: s["kind"] < 3))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), written(spans).alias("spans"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "deleted_lines", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_texts(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return coded.select(
        "doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = kept(store_frames(table(spark, sf_dir, "documents")), "frames")
    done = fill_in_middle(frames)
    restored = F.sha2(restore(F.col("output"), F.col("form")).cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", restored.alias("restored_sha256"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_exact_topk, op2_language_id, op3_ngram_jaccard_join, op4_chat_format, op5_quality, op6_secret_scan, op7_exact_dedup,
              op8_line_dedup, op9_bpe, op10_best_fit_packing, op11_spelling_groups, op12_fill_in_middle, op13_decontaminate)
}
