"""Exact document dedup by skew-safe combining of content groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import kept, lookup, text_or_empty

SALTS = 32
#: Fixed value: runs of these white-space characters count as one space.
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WHITE_SPACE, " ")


def sha_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _rows(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    rows = docs.select(F.col("doc_id").alias("_id"), normalised(text_or_empty()).alias("_content"))
    return rows.select("_id", "_content", digest(F.col("_content")).alias("_digest"), sha_of(F.col("_content")).alias("_sha"))


def content_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha_of, salts: int = SALTS) -> DataFrame:
    """One row (_digest, _content, keep_id, group_size) per distinct content.

    Every stage groups by digest *and* full content, so equal digests of different texts never meet: the
    map-side combine removes copies within a partition, groups salted by row spread a hot content over ``salts``
    tasks, and the at most ``salts`` winners of a content are combined last.
    """
    rows = _rows(docs, digest).withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(salts)))
    salted = rows.groupBy("_digest", "_content", "_salt").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    return salted.groupBy("_digest", "_content").agg(F.min("_keep").alias("keep_id"), F.sum("_n").alias("group_size"))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha_of, salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs``.

    Reads doc_id and text, whatever other columns there are. Texts are compared after runs of white space became
    one space; null counts as empty. The smallest doc_id of a group stays; a null doc_id stays only where its
    group has no other. Rows that repeat the doc_id that stays are that same document and stay with it. No rows
    give no rows.

    A row finds its group by digest, without meeting all the others of a frequent one; where one digest has several
    contents, by the full content.
    """
    groups = content_groups(docs, digest, salts)
    by_digest = kept(groups.groupBy("_digest").agg(
        F.count(F.lit(1)).alias("_contents"), F.min("keep_id").alias("keep_id"), F.min("group_size").alias("group_size")), "digests")
    single = by_digest.where("_contents = 1").select("*", F.col("group_size").alias("_rows"))
    total = by_digest.agg(F.sum("group_size")).first()[0] or 0
    found = lookup(_rows(docs, digest).drop("_content"), single, ["_digest"], "_rows", total)
    shared = by_digest.where("_contents > 1")
    if shared.limit(1).count():
        some = groups.join(shared.select("_digest"), "_digest", "left_semi")
        found = found.unionByName(_rows(docs, digest).join(some, ["_digest", "_content"]), allowMissingColumns=True)
    return found.select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("_sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each text, all its columns: of equal texts that of the smallest doc_id (a null doc_id
    only where there is no other), and one of the rows that repeat it. Other texts of the same doc_id stay."""
    groups = content_groups(docs, **options).select(sha_of(F.col("_content")).alias("_kept_sha"), "keep_id")
    rows = docs.select(F.struct("*").alias("_row"), sha_of(normalised(text_or_empty())).alias("_sha"))
    first = rows.join(groups, (F.col("_sha") == F.col("_kept_sha")) & F.col("_row.doc_id").eqNullSafe(F.col("keep_id")), "left_semi")
    return first.dropDuplicates(["_sha"]).select("_row.*")
