"""Pages made from the plain tables by column expressions, so that SQL can make the same ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(text: Column | str = "text") -> Column:
    """Lines of the text, each with its words at single blanks, empty ones left out."""
    made = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \\t\\r]+", " ")))
    return F.filter(made, lambda x: x != "")


def xml(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def wiki_literal(c: Column) -> Column:
    """Wiki text that is read as just these characters: all that can be escaped is."""
    return F.regexp_replace(c, r"([*_\-~+^{}\[\]|\\!?])", r"\\$1")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, title, lines) of all documents."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.concat_ws(" ", "source", F.col("doc_id").cast("string")).alias("title"), lines().alias("lines"))


#: The same in DuckDB's SQL.
DOCUMENTS = """
SELECT doc_id AS page_id, concat_ws(' ', source, CAST(doc_id AS VARCHAR)) AS title,
       list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\r]+', ' ', 'g'))), lambda x: x <> '') AS lines
FROM documents
"""


def each(items: Column | str, before: str, after: str, write) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit(before), write(x), F.lit(after))), "")
