"""Synchronising a library with its index by content: what to prepare, rename, delete; what is visible."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VISIBLE = ("indexed", "stale")


def by_content(files: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, digest, paths): files of equal content in one row, paths sorted; the first path is the primary one."""
    return files.where("digest IS NOT NULL AND path IS NOT NULL").groupBy(*by, "digest").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def plan_sync(files: DataFrame, manifest: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(digest, action, primary_path, n_duplicates, paths, successor) for every content known on either side; with ``by``, for each of several libraries or deliveries.

    ``files`` (digest, path) is the library now, ``manifest`` (digest, paths) what was committed.  A content on
    both sides is ``unchanged``, or ``renamed`` if exactly one path left, one came and none stayed, or
    ``moved`` if paths differ otherwise.  A content only in the library is ``modified`` where one of its paths held another
    content before, else ``added``; one only in the manifest is ``replaced`` where its path lives on, else ``deleted``.
    ``successor`` is the content now at the first living path of a replaced one.
    """
    now = by_content(files, by).withColumnRenamed("paths", "now_paths")
    then = manifest.where("digest IS NOT NULL").select(*by, "digest", F.array_sort("paths").alias("then_paths"))
    content, place = [*by, "digest"], [*by, "path"]
    both = now.join(then, content, "full_outer")
    old, new = then.select(*by, "digest", F.explode("then_paths").alias("path")), now.select(*by, "digest", F.explode("now_paths").alias("path"))
    reused = new.join(old.select(*place).distinct(), place, "left_semi").select(*content).distinct().withColumn("_path_was", F.lit(True))
    living = old.join(new.withColumnRenamed("digest", "_now"), place).groupBy(*content).agg(F.min_by("_now", "path").alias("successor"))
    joined = both.join(reused, content, "left").join(living, content, "left")
    came, went = F.size(F.array_except("now_paths", "then_paths")), F.size(F.array_except("then_paths", "now_paths"))
    stayed = F.size(F.array_intersect("now_paths", "then_paths"))
    action = (
        F.when(F.col("then_paths").isNull(), F.when(F.col("_path_was"), "modified").otherwise("added"))
        .when(F.col("now_paths").isNull(), F.when(F.col("successor").isNotNull(), "replaced").otherwise("deleted"))
        .when((came == 0) & (went == 0), "unchanged")
        .when((came == 1) & (went == 1) & (stayed == 0), "renamed")
        .otherwise("moved")
    )
    first = F.coalesce(F.try_element_at("now_paths", F.lit(1)), F.try_element_at("then_paths", F.lit(1)))
    return joined.select(*by, "digest", action.alias("action"), first.alias("primary_path"), F.greatest(F.size("now_paths") - 1, F.lit(0)).alias("n_duplicates"), F.coalesce("now_paths", "then_paths").alias("paths"), F.when(action == "replaced", F.col("successor")).alias("successor"))


def sync_counts(plan: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return plan.groupBy(*by, "action").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_duplicates"), F.lit(0)).alias("n_duplicates"))


def check_deletions(plan: DataFrame, limit: float, force: bool = False) -> None:
    """Raises if a greater share of known contents than ``limit`` would be deleted."""
    deleted, known = plan.agg(F.count(F.when(F.col("action") == "deleted", 1)), F.count(F.when(~F.col("action").isin("added", "modified"), 1))).first()
    if known and deleted / known > limit and not force:
        raise ValueError(f"{deleted} of {known} indexed documents would be deleted; more than the allowed share {limit:g}")


def committed(chunks: DataFrame, owners: DataFrame) -> DataFrame:
    """Chunks that an owner row vouches for: known id, same document (if the chunk names one), same version (if the owner names one).

    The owner's first path becomes the source.
    """
    own = owners.select(F.col("chunk_id").alias("id"), F.col("document_id").alias("_document"), F.col("paths").alias("_paths"), F.col("document_version").alias("_version"))
    joined = chunks.join(own, "id")
    same = (F.col("document_id").isNull() | (F.col("document_id") == F.col("_document"))) & (F.col("_version").isNull() | (F.col("_version") == F.col("document_version")))
    return joined.where(same).withColumn("source", F.coalesce(F.try_element_at("_paths", F.lit(1)), "source")).withColumn("document_id", F.col("_document")).drop("_document", "_paths", "_version")


def obsolete(chunks: DataFrame, owners: DataFrame) -> DataFrame:
    """Ids that no owner row vouches for."""
    return chunks.select("id").distinct().join(owners.select(F.col("chunk_id").alias("id")), "id", "left_anti")


def legacy_owners(chunks: DataFrame, contents: DataFrame, digits: int = 16) -> DataFrame:
    """(id, digest) of chunks without a document whose id begins with a content's digest: an equality join on the first ``digits``; several contents with such a beginning own none.

    ``chunks``: id, document_id; ``contents``: digest.
    """
    own = contents.select("digest", F.substring("digest", 1, digits).alias("_start")).distinct()
    single = own.groupBy("_start").agg(F.count(F.lit(1)).alias("_n"), F.min("digest").alias("digest")).where("_n = 1")
    lost = chunks.where("document_id IS NULL").select("id", F.regexp_extract("id", r"^([0-9a-f]+)-", 1).alias("_prefix")).where(F.length("_prefix") >= digits)
    found = lost.withColumn("_start", F.substring("_prefix", 1, digits)).join(single, "_start")
    return found.where(F.startswith("digest", "_prefix")).select("id", "digest")


def available(chunks: DataFrame, live: DataFrame) -> DataFrame:
    """Chunks whose source or one of whose aliases still exists; the first that does becomes the source.

    ``chunks``: id, source, aliases; ``live``: path.
    """
    placed = chunks.select("id", F.posexplode(F.concat(F.array("source"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("at", "path"))
    first = placed.join(live.select("path").distinct(), "path").groupBy("id").agg(F.min_by("path", "at").alias("_live"))
    return chunks.join(first, "id").withColumn("source", F.col("_live")).drop("_live")
