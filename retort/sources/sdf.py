"""CSV, SDF and whole texts as sources and sinks. SDF files give one row per record, split by the reader itself, so that a file of any size is read in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.functions.texts3d import mol_block


#: What stands for a field of nothing while CSV is read: no text holds it.
_NOTHING = "\x00nothing"


def read_sdf(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, mol)``: the record's text, and its typed fields, null where it can't be read. Blank name lines are kept; a trailing empty record isn't one."""
    rows = spark.read.text(path, lineSep="$$$$\n").select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("block"))
    rows = rows.filter(F.length(F.trim(F.regexp_replace("block", r"[\r\n]+", ""))) > 0)
    return rows.select("file", "block", mol_block("block").alias("mol"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(file, text)``: whole files, for structure texts."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a given schema, quotes doubled within quoted fields, records over several lines allowed. A field of nothing is null, a pair of quotes an empty text."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", _NOTHING).option("emptyValue", "").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header that ``read_csv`` reads back as it was: blanks are kept, null is nothing, an empty text a pair of quotes."""
    df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_sdf(df: DataFrame, block_col: str, path: str) -> None:
    """MOL texts as SDF files; null texts are left out."""
    df.filter(F.col(block_col).isNotNull()).select(F.concat(F.col(block_col), F.lit("$$$$"))).write.text(path)


def write_texts(df: DataFrame, key_col: str, text_col: str, path: str) -> None:
    """One file per row, in a folder by its key (keys must differ); the text gets a line end."""
    df.select(key_col, text_col).repartition(key_col).write.partitionBy(key_col).option("maxRecordsPerFile", 1).text(path)
