"""What the operators of this subpackage share: reading, words, stored intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder, stored  # noqa: F401  for the operators

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more; shuffle files of finished plans go when the driver's JVM collects them."""
    context = tables[0].sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for table in tables for f in table.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    context._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(text: Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(text.cast("string"), F.lit(""))


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """The whole row as one struct, row, beside columns of an operator's own, so that no column's name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("row"), *more)


def unpacked(df: DataFrame, docs: DataFrame, changed: dict[str, Column] | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """The columns of docs out of row, some of them changed, and more columns after them."""
    changed = changed or {}
    own = [(changed[c] if c in changed else F.col("row").getField(c)).alias(c) for c in docs.columns]
    return df.select(*own, *[v.alias(k) for k, v in (more or {}).items()])


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words of a text without null, in order."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    """How many words: runs of white space are cut away at both ends and counted between."""
    inner = F.trim(text, F.lit(SPACE_CHARS))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, SPACE))).cast("long")
