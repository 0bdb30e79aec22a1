"""Sources: whole text files, JSON arrays and objects, folders of runs (survey S1 to S5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def fileid_of(path: Column, root: str = "", prefix: str = "devset/") -> Column:
    """The file id of a path: slashes instead of back slashes, what ends with ``root`` left off, the prefix before it."""
    plain = F.regexp_replace(path, r"\\", "/")
    if root:
        at = F.locate(root.rstrip("/") + "/", plain)
        plain = F.when(at > 0, plain.substr(at + F.lit(len(root.rstrip("/")) + 1), F.length(plain))).otherwise(plain)
    return F.concat(F.lit(prefix), plain)


def read_texts(spark: SparkSession, *globs: str, root: str = "", encoding: str = "utf-8") -> DataFrame:
    """fileid, text: each file of the globs as one row. A file that several globs name stands there once."""
    path = F.col("_metadata.file_path")
    files = spark.read.option("encoding", encoding).text(list(globs), wholetext=True).select(path.alias("path"), F.col("value").alias("text"))
    return files.select(fileid_of(F.col("path"), root).alias("fileid"), "text")


def read_json_array(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """The rows of files that hold one JSON array each, under an explicit schema: absent fields are null.

    Such a file is parsed by one task; large data belongs into JSON lines or Parquet, which the stages write.
    """
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_json_lines(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """The rows of files with one JSON object on each line, as stages write them; such files are split over tasks."""
    return spark.read.schema(schema).json(path)


def read_json_object(spark: SparkSession, path: str, value: str = "double") -> DataFrame:
    """key, value of a file that holds one JSON object, such as weights by feature."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def read_runs(spark: SparkSession, arms: dict[str, str]) -> DataFrame:
    """arm, run, pos, acc: each file of an arm's folder holds a JSON list of numbers; runs are numbered by file name.

    A table of file names numbers the runs, so no list is gathered with others.
    """
    out = None
    for arm, folder in arms.items():
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
        files = spark.read.text(folder, wholetext=True).select(name.alias("file"), F.from_json("value", "array<double>").alias("a"))
        run = files.select("file").withColumn("run", F.expr("row_number() OVER (ORDER BY file) - 1"))
        each = files.join(run, "file").select(F.lit(arm).alias("arm"), "run", F.posexplode("a").alias("pos", "acc"))
        out = each if out is None else out.unionByName(each)
    if out is None:
        raise ValueError("no arms")
    return out
