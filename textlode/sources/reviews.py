"""Gzip TSV reviews: header row, tab, quotes doubled, line breaks inside quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import park

#: The columns of the reviews.
ID_COLUMN, TEXT_COLUMNS = "review_id", ("review_headline", "review_body")


def header_of(spark: SparkSession, path: str, delimiter: str) -> list[str]:
    return spark.read.text(path).first()[0].split(delimiter)


def project_text(df: DataFrame, columns, name: str = "text"):
    """The wanted columns joined by a space, in the table's own order; nulls are skipped."""
    return F.concat_ws(" ", *[F.col(f"`{c}`") for c in df.columns if c in set(columns)]).alias(name)


def read_reviews(spark: SparkSession, paths: str | list[str], id_column: str = ID_COLUMN, text_columns=TEXT_COLUMNS, delimiter: str = "\t", partitions: int | None = None) -> DataFrame:
    """(ext_id, text) of all files together. Files need not have the same columns in the same order.

    A gzip file is read by one task, so rows are dealt anew right after the scan.
    """
    if not id_column or not text_columns:
        raise ValueError("an id column and at least one text column are needed")
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no files")
    found = None
    for path in paths:
        names = header_of(spark, path, delimiter)
        missing = {id_column, *text_columns} - set(names)
        if missing:
            raise ValueError(f"{path} has no columns {sorted(missing)}")
        schema = StructType([StructField(c, StringType()) for c in names])
        rows = spark.read.schema(schema).csv(path, sep=delimiter, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
        part = rows.select(F.col(f"`{id_column}`").alias("ext_id"), project_text(rows, text_columns))
        found = part if found is None else found.unionByName(part)
    return found.repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))


def number_documents(docs: DataFrame) -> DataFrame:
    """docs with a dense doc_id from 0 over all files, and so the mapping to ext_id: ordered by a digest of the id, then the id, then the other columns."""
    spread = docs.withColumn("_h", F.md5(F.col("ext_id").cast("binary")))
    others = [f"`{c}`" for c in docs.columns if c != "ext_id"]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = park(spread.repartitionByRange(n, "_h", "ext_id").sortWithinPartitions("_h", "ext_id", *others).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, local = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row a partition
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return placed.withColumn("_part", part).join(starts, "_part").withColumn("doc_id", F.col("_start") + local).drop("_h", "_at", "_part", "_start")
