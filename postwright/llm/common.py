"""Column expressions and small Spark helpers that the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of the six ASCII blanks: space, tab, line feed, vertical tab, form feed, return.
BLANKS = r"[\x20\x09-\x0D]+"
NOT_BLANK = r"[^\x20\x09-\x0D]"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or the checkpoint folder that the session was given.

    Without either, the warehouse serves where its path names a file system
    or the session runs on one machine; elsewhere a folder of one machine would
    be lost to the others, and an error says so.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/stages"
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage ends there.

    What later steps read survives the loss of any executor, and columns that
    a later step doesn't name are never read. The folders of an application
    lie together under ``stages-<application>`` and are read until the caller has its
    rows; ``forget`` deletes them.
    """
    path = f"{stage_path(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_path(spark: SparkSession) -> str:
    """The folder of this application's own intermediate files."""
    return f"{shared_dir(spark)}/stages-{spark.sparkContext.applicationId}"


def forget(spark: SparkSession) -> None:
    """Delete what ``materialize`` wrote in this application; results that aren't written yet are lost with it."""
    remove(spark, stage_path(spark))


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a whole text: runs of characters other than the six ASCII blanks; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else (``lower`` would fold accented letters as well)."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def shingle_hashes(word_list: Column, n: int) -> Column:
    """64-bit hashes of all runs of ``n`` words, repeats included.

    A text of fewer than ``n`` words gives its whole sequence as one shingle;
    a text without words gives none.
    """

    def runs(w: Column) -> Column:
        at = lambda i: [F.get(w, i + k) for k in range(1, n)]
        return (
            F.when(F.size(w) == 0, F.expr("cast(array() as array<bigint>)"))
            .when(F.size(w) < n, F.array(F.xxhash64(F.lit(n), F.array_join(w, " "))))
            .otherwise(
                F.transform(F.slice(w, F.lit(1), F.size(w) - (n - 1)), lambda x, i: F.xxhash64(x, *at(i)))
            )
        )

    return let(word_list, runs)


def shingle_set(text: Column, n: int) -> Column:
    """Sorted distinct hashes of the word shingles of the text with A-Z lower-cased."""
    return F.sort_array(F.array_distinct(shingle_hashes(words(ascii_lower(F.coalesce(text, F.lit("")))), n)))


def own_columns(df: DataFrame, keep: dict[str, str]) -> DataFrame:
    """Only the named columns, under names of ours: extra columns of the input can't clash."""
    return df.select(*[F.col(f"`{c}`").alias(name) for c, name in keep.items()])


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before each as it takes to clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    return ["_" * next(k for k in range(len(taken) + 1) if "_" * k + name not in taken) + name for name in names]
