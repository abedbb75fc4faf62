"""JSON lines that a writer may have left torn: what is whole is read, what is suspect is told, other caches are refused."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


class CacheKeyMismatch(ValueError):
    """Rows of another cache or of another schema version among those to go on from."""


@dataclass
class Recovered:
    rows: DataFrame  # by the schema, with `file` behind its columns
    files: DataFrame  # file, size, rows, good_bytes, torn


def _whole(line: Column) -> Column:
    """Is a line one JSON object and nothing else; parsers stop at an object's end, so it is read as the first of two items."""
    pair = F.try_parse_json(F.concat(F.lit("["), line, F.lit(",0]")))
    return F.ltrim(line).startswith("{") & F.coalesce((F.try_variant_get(pair, "$[1]", "int") == 0) & F.try_variant_get(pair, "$[2]", "string").isNull(), F.lit(False))


def _lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """file, size, place, bytes, blank, bad, row: a line's place is its split's start and its number there, so splits stay as they are."""
    fields = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("i")).alias("place"))
    line = F.rtrim(F.regexp_replace("value", r"\r$", ""))
    row = F.from_json(line, fields, {"columnNameOfCorruptRecord": CORRUPT})
    d = raw.select("file", "size", "place", (F.octet_length("value") + 1).cast("long").alias("bytes"), (F.trim(line) == "").alias("blank"), _whole(line).alias("whole"), row.alias("row"))
    return d.withColumn("bad", ~F.col("blank") & (~F.col("whole") | F.col("row").isNull() | F.col(f"row.{CORRUPT}").isNotNull()))


def recovered(spark: SparkSession, path: str, schema: T.StructType) -> Recovered:
    """The whole rows of files of JSON lines and what each file holds.

    A file's tail is torn from its first line that isn't one JSON object of the schema, or from a last line that no
    newline ends, even one that parses: its writer didn't finish it. Nothing from there on is taken. Blank lines are no
    rows but are good bytes; a key that stands twice in an object makes it no object; null and missing fields are null;
    fields that the schema doesn't name are left out. good_bytes is where a file could be cut. Files that are empty give
    no row here. Lines are read in splits and never gathered; only torn files' places are joined, by file. Files must
    not be compressed, as sizes tell whether the last newline is there.
    """
    lines = _lines(spark, path, schema)
    unfinished = F.col("total") > F.col("size")
    ends = lines.groupBy("file", "size").agg(F.sum("bytes").alias("total"), F.max("place").alias("last"), F.min(F.when(F.col("bad"), F.col("place"))).alias("first_bad"))
    torn = ends.select("file", F.least("first_bad", F.when(unfinished, F.col("last"))).alias("from")).where("from is not null")
    good = lines.join(torn, "file", "left").withColumn("good", F.col("from").isNull() | (F.col("place") < F.col("from")))
    taken = F.col("good") & ~F.col("blank")
    files = good.groupBy("file", "size").agg(F.count_if(taken).alias("rows"), F.coalesce(F.sum(F.when(F.col("good"), F.col("bytes"))), F.lit(0).cast("long")).alias("good_bytes"), F.bool_or(F.col("from").isNotNull()).alias("torn"))
    return Recovered(good.where(taken).select(*[F.col("row")[f.name].alias(f.name) for f in schema.fields], "file"), files)


def refuse_foreign(rows: DataFrame, key: str, version: str | None = None) -> None:
    """Raises CacheKeyMismatch if any row was written under another key or version; a null is another one."""
    wrong = ~F.col("cache_key").eqNullSafe(F.lit(key))
    if version is not None:
        wrong = wrong | ~F.col("schema_version").eqNullSafe(F.lit(version))
    one = rows.where(wrong).agg(F.count("*").alias("n"), F.min(F.struct("file", "cache_key")).alias("e")).first()
    if one.n:
        raise CacheKeyMismatch(f"{one.n} rows of another cache, as {str(one.e.cache_key)[:12]} in {one.e.file}; this run is {key[:12]}")


def resume(spark: SparkSession, path: str, schema: T.StructType, key: str, version: str | None = None) -> Recovered:
    """recovered(), after refusing rows of another cache: what a run may go on from by an anti-join on its keys."""
    r = recovered(spark, path, schema)
    refuse_foreign(r.rows, key, version)
    return r


def rewrite(spark: SparkSession, path: str, target: str, schema: T.StructType, key: str, version: str | None = None) -> int:
    """The whole rows as JSON lines in a new folder; how many. Files in shared storage can't be cut in place."""
    rows = resume(spark, path, schema, key, version).rows.drop("file")
    rows.write.mode("errorifexists").option("ignoreNullFields", False).json(target)
    return spark.read.text(target).count()
