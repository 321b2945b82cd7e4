"""Published versions of a model bundle: each is a folder that never changes, and a manifest names them in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.session import local_table
from tabwright.sources.bundle import Bundle, load_bundle, save_bundle

LAYOUT = "version bigint, path string, model_name string, published_at string"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(version, path, model_name, published_at) of every published version; no rows before the first."""
    try:
        return spark.read.schema(LAYOUT).json(f"{root}/manifest").where("version is not null")
    except Exception as e:  # the folder comes with the first version
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return local_table(spark, [], LAYOUT)


def latest(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """Version and path of the newest bundle."""
    row = manifest(spark, root).agg(F.max(F.struct("version", "path")).alias("m")).first()["m"]
    return (row["version"], row["path"]) if row else None


def publish(spark: SparkSession, bundle: Bundle, root: str) -> int:
    """Save ``bundle`` as the next version. The line in the manifest is appended last: readers see whole bundles only.
    One publisher at a time."""
    newest = latest(spark, root)
    version = newest[0] + 1 if newest else 1
    path = save_bundle(spark, bundle, f"{root}/v{version}")
    row = local_table(spark, [(version, path, bundle.model_name, bundle.created_at)], LAYOUT)
    row.coalesce(1).write.mode("append").json(f"{root}/manifest")
    return version


class Reloading:
    """The newest bundle of ``root``, loaded again only when the manifest has a newer version."""

    def __init__(self, root: str):
        self.root, self.version, self.bundle = root, 0, None

    def current(self, spark: SparkSession) -> tuple[int, Bundle]:
        newest = latest(spark, self.root)
        if newest is None:
            raise ValueError(f"no version is published: {self.root}")
        if newest[0] != self.version:
            self.bundle = load_bundle(spark, newest[1])
            self.version = newest[0]
        return self.version, self.bundle
