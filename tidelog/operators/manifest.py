"""The file catalogue, folded from its change log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changes(commits: DataFrame) -> DataFrame:
    """Commits of several changes to one row a change, in order."""
    return commits.select(F.col("seq").alias("commit"), F.posexplode("changes").alias("pos", "c")).select((F.col("commit") * F.lit(1 << 20) + F.col("pos")).alias("seq"), "c.*")


def fold(manifest: DataFrame) -> DataFrame:
    """Files whose last change is a CREATE."""
    rest = [c for c in manifest.columns if c not in ("id", "seq")]
    one = manifest.groupBy("id").agg(F.max_by(F.struct(*rest), F.col("seq")).alias("r"), F.max("seq").alias("seq"))
    return one.filter("r.op = 'CREATE'").select("id", "seq", *(F.col(f"r.{c}").alias(c) for c in rest))


def violations(manifest: DataFrame) -> DataFrame:
    """A CREATE of a file that is there, a DELETE of one that is not, and operations of no known kind."""
    before = F.lag("op").over(Window.partitionBy("id").orderBy("seq"))
    rows = manifest.withColumn("prev_op", before)
    what = F.when(~F.col("op").isin("CREATE", "DELETE"), "unknown op").when((F.col("op") == "CREATE") & (F.col("prev_op") == "CREATE"), "create of existing").when((F.col("op") == "DELETE") & ~F.col("prev_op").eqNullSafe(F.lit("CREATE")), "delete of missing")
    return rows.withColumn("violation", what).filter("violation is not null")


def counters(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count_if(F.col("op") == "CREATE").cast("bigint").alias("creates"), F.count_if(F.col("op") == "DELETE").cast("bigint").alias("deletes"))


def needs_rewrite(manifest: DataFrame, least: int = 1000, ratio: int = 10) -> DataFrame:
    """Whether deletes are over ``least`` and over ``ratio`` times the live files."""
    return counters(manifest).crossJoin(fold(manifest).agg(F.count(F.lit(1)).alias("live"))).withColumn("rewrite", (F.col("deletes") > least) & (F.col("deletes") > ratio * F.col("live")))


def rewritten(manifest: DataFrame) -> DataFrame:
    return fold(manifest)


def directory_diff(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Files the catalogue lacks, to be removed, and files that are missing, an error."""
    known = fold(manifest).select("id")
    there = files.select("id").distinct()
    missing = known.join(there, "id", "left_anti").withColumn("state", F.lit("missing"))
    return missing.unionByName(there.join(known, "id", "left_anti").withColumn("state", F.lit("orphan")))
