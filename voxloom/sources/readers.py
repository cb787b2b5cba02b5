"""Readers of the corpus' text files: fixed columns, checked at read, problems as rows.

Each gives the rows with path and line order (pos), so that first and last lines can win. Lines of white space only are
skipped. Text files have no quoting here; files of quoted fields are read by operators.rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.operators.scoring import SOURCES


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """path, pos, line of text files: pos orders lines within a file."""
    read = spark.read.text(list(paths))
    return read.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))


def filled(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("line").rlike(r"(?U)\S"))


def columns(rows: DataFrame, *names: str, most: int = -1) -> DataFrame:
    """path, pos, n (fields of the line) and the named fields; most limits the split, the last field keeping later tabs."""
    parts = rows.withColumn("f", F.split("line", "\t", most))
    return parts.select("path", "pos", F.size("f").alias("n"), *(F.get("f", F.lit(i)).alias(c) for i, c in enumerate(names)))


def utterances(rows: DataFrame) -> DataFrame:
    """utterance, speaker, text; the text keeps later tabs."""
    return columns(filled(rows), "utterance", "speaker", "text", most=3)


def speaker_split(rows: DataFrame) -> DataFrame:
    found = columns(filled(rows), "speaker", "split")
    bad = F.when(F.col("n") != 2, "expected 2 columns").when(~F.col("split").isin("train", "dev", "test"), "unknown split")
    return found.withColumn("problem", bad)


def vocabulary(rows: DataFrame) -> DataFrame:
    return columns(filled(rows), "word", "count").withColumn("count", F.expr("try_cast(count AS BIGINT)"))


def loanwords(rows: DataFrame, categories: str = "ENP") -> DataFrame:
    """word, category, english, suffix; the word clean, the suffix without joiners; other categories than those asked for are left out."""
    found = columns(filled(rows), "word", "category", "english", "suffix")
    bad = F.when(F.col("n") != 4, "expected 4 columns").when(~F.col("category").isin("E", "N", "P"), "unknown category")
    checked = found.withColumn("problem", bad).where(F.col("problem").isNotNull() | F.col("category").isin(*categories))
    return checked.withColumn("word", X.clean(F.col("word"))).withColumn("suffix", F.btrim("suffix", F.lit(X.ZWJ + X.ZWNJ)))


def split_transcripts(rows: DataFrame) -> DataFrame:
    """file, transcript of tables of seven columns, of which two are used."""
    found = columns(filled(rows), "id", "file", "transcript", "normalised", "characters", "samples", "gender")
    return found.select("path", "pos", "file", "transcript", F.when(F.col("n") != 7, "expected 7 columns").alias("problem"))


def spaced_transcripts(rows: DataFrame, extension: str = ".flac") -> DataFrame:
    """file, transcript of lines `name TEXT`, cut at the first space."""
    parts = F.split("line", " ", 2)
    named = filled(rows).select("path", "pos", F.concat(parts[0], F.lit(extension)).alias("file"), F.get(parts, F.lit(1)).alias("transcript"))
    return named.orderBy("file")


def replay(rows: DataFrame) -> DataFrame:
    """source, file, error, label; rows with another number of columns, an unknown source or no finite error of 0 or more have a problem."""
    found = columns(filled(rows), "source", "file", "error", "label").withColumn("error", F.expr("try_cast(error AS DOUBLE)"))
    error = F.col("error")
    bad_error = error.isNull() | F.isnan(error) | (error < 0) | (error == float("inf"))
    problem = F.when(F.col("n") != 4, "expected 4 columns").when(~F.col("source").isin(*(s[0] for s in SOURCES)), "unknown source").when(bad_error, "not an error")
    return found.withColumn("problem", problem)


def label_file(spark: SparkSession, *paths: str) -> DataFrame:
    """file, seconds, ms, text of labels files, sharded or not. A wrong header, a last line cut off, wrong columns, a number that is none and a file labelled twice, in any shard, are problems."""
    meta = F.col("_metadata")
    read = spark.read.option("lineSep", "\n").text(list(paths)).select(meta.file_path.alias("path"), meta.file_size.alias("bytes"), F.struct(meta.file_block_start, F.monotonically_increasing_id()).alias("turn"), F.col("value").alias("line"))
    # a file whose lines and their breaks are more than it holds ends without a break
    ends = read.groupBy("path").agg(F.max("turn").alias("turn"), (F.sum(F.octet_length("line") + 1) > F.max("bytes")).alias("cut"))
    ordered = read.withColumn("pos", F.row_number().over(Window.partitionBy("path").orderBy("turn")) - 1)
    rows = ordered.join(ends, ["path", "turn"], "left").where((F.col("line") != "") | (F.col("pos") == 0))
    found = rows.withColumn("f", F.split("line", "\t")).select("path", "pos", "line", F.coalesce("cut", F.lit(False)).alias("cut"), *(F.get("f", F.lit(i)).alias(c) for i, c in enumerate(("file", "seconds", "ms", "text"))), F.size("f").alias("n"))
    number = lambda c: F.expr(f"try_cast({c} AS DOUBLE)")
    times = found.where("pos > 0").groupBy("file").agg(F.count("*").alias("times"))
    joined = found.join(times, "file", "left")
    later = F.col("pos") > 0
    problem = F.when((F.col("pos") == 0) & (F.col("line") != "file\tseconds\tms\ttext"), "header").when(later & F.col("cut"), "cut off")
    problem = problem.when(later & (F.col("n") != 4), "expected 4 columns").when(later & number("seconds").isNull(), "not a number").when(later & (F.col("times") > 1), "labelled twice")
    return joined.select("path", "pos", "file", number("seconds").alias("seconds"), number("ms").alias("ms"), "text", problem.alias("problem")).where("pos > 0 OR problem IS NOT NULL")


def shards(spark: SparkSession, folder: str, source: str) -> list[str]:
    """The paths of a source's labels files: the files of its folder if there is one, else its one file."""
    base = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{source}")
    if base.getFileSystem(spark._jsc.hadoopConfiguration()).exists(base):
        return [f"{folder}/{source}/*.tsv"]
    return [f"{folder}/{source}.tsv"]


def records(spark: SparkSession, *paths: str) -> DataFrame:
    """audio, text of JSON lines; several files, the same file twice included, are a bag union. Malformed lines, empty audio and a missing marker are problems."""
    parts = [spark.read.schema("audio string, text string, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(p) for p in paths]
    read = parts[0]
    for p in parts[1:]:
        read = read.unionAll(p)
    problem = F.when(F.col("_corrupt").isNotNull(), "malformed").when(F.coalesce("audio", F.lit("")) == "", "no audio").when(~F.coalesce(F.col("text").contains(X.MARKER), F.lit(False)), "no marker")
    return read.withColumn("problem", problem).drop("_corrupt")


def recordings(spark: SparkSession, folder: str) -> DataFrame:
    """path, size of the folder's recordings, by extension in any case, in order of their names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", F.col("length").alias("size"))
    return files.where(F.lower("path").rlike(r"\.(wav|flac)$")).orderBy("path")


def present(rows: DataFrame, path: Column, files: DataFrame) -> DataFrame:
    """Rows whose path is among files (path)."""
    return rows.withColumn("path", path).join(files.select("path").distinct(), "path", "left_semi").drop("path")


def quantisation(rows: DataFrame) -> DataFrame:
    """group_size, bits, mode of JSON configurations (value); any other mode than affine is a problem."""
    config = F.from_json("value", "quantization struct<group_size:int,bits:int,mode:string>")["quantization"]
    mode = F.coalesce(config["mode"], F.lit("affine"))
    return rows.select(config["group_size"].alias("group_size"), config["bits"].alias("bits"), mode.alias("mode"), F.when(mode != "affine", "unknown mode").alias("problem"))
