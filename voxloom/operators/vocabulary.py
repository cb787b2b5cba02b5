"""Vocabulary of a corpus, and the merging of classified words into one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.operators.ranking import ranked

CATEGORIES = ("E", "N", "P")


def count_words(utterances: DataFrame, expression: str = X.SCRIPT_WORD) -> DataFrame:
    """word, count, first_pos, first_at of every word of utterances (pos, text): row and place of its first appearance."""
    found = utterances.select("pos", F.posexplode(F.regexp_extract_all("text", F.lit(expression), F.lit(0))).alias("at", "word"))
    first = F.min(F.struct("pos", "at")).alias("first")
    return found.groupBy("word").agg(F.count("*").alias("count"), first).select("word", "count", F.col("first.pos").alias("first_pos"), F.col("first.at").alias("first_at"))


def vocabulary(counts: DataFrame, min_count: int = 3, chunk: int = 3000) -> DataFrame:
    """word, count, rank, chunk of the words found min_count times or more: commonest first, ties by first appearance."""
    top = ranked(counts.where(F.col("count") >= min_count), "count", "first_pos", 1 << 14, ("first_at",))
    return top.select("word", "count", "rank", F.floor((F.col("rank") - 1) / chunk).alias("chunk"))


def coverage(counts: DataFrame, min_count: int = 3) -> DataFrame:
    """tokens, distinct_words, frequent_words, percent of tokens that frequent words cover."""
    often = F.col("count") >= min_count
    sums = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("tokens"), F.count("*").alias("distinct_words"), F.count_if(often).alias("frequent_words"), F.coalesce(F.sum(F.when(often, F.col("count"))), F.lit(0)).alias("covered"))
    return sums.select("tokens", "distinct_words", "frequent_words", (100.0 * F.col("covered") / F.greatest(F.lit(1), "tokens")).alias("percent"))


def judged_lines(lines: DataFrame, counts: DataFrame) -> DataFrame:
    """Lines of classified words (path, line_no, line) with their fields, frequency and the first rule they break.

    A missing fourth column is an empty suffix. Blank lines are left out.
    """
    filled = lines.where(F.col("line").rlike(r"(?U)\S")).withColumn("f", F.split("line", "\t"))
    filled = filled.withColumn("f", F.when(F.size("f") == 3, F.array_append("f", F.lit(""))).otherwise(F.col("f")))
    field = lambda i: F.get("f", F.lit(i))
    named = filled.select("path", "line_no", F.size("f").alias("n"), field(0).alias("word"), field(1).alias("category"), field(2).alias("english"), field(3).alias("suffix"))
    joined = named.join(counts.select("word", F.col("count").alias("frequency")), "word", "left")
    problem = F.when(F.col("n") != 4, F.concat(F.lit("expected 4 columns, got "), F.col("n").cast("string")))
    problem = problem.when(~F.col("category").isin(*CATEGORIES), "unknown category").when(F.col("english") == "", "no English spelling")
    return joined.withColumn("problem", problem.when(F.col("frequency").isNull(), "not in the vocabulary"))


def merge(judged: DataFrame) -> DataFrame:
    """word, category, english, suffix, frequency of the sound lines; of a word's lines the first in (path, line_no) holds."""
    first = Window.partitionBy("word").orderBy("path", "line_no")
    sound = judged.where("problem IS NULL").withColumn("turn", F.row_number().over(first))
    return sound.where("turn = 1").select("word", "category", "english", "suffix", "frequency", "path", "line_no")


def category_shares(merged: DataFrame, counts: DataFrame) -> DataFrame:
    """category, words, percent of all tokens."""
    total = counts.agg(F.greatest(F.lit(1), F.coalesce(F.sum("count"), F.lit(0))).alias("total"))
    sums = merged.groupBy("category").agg(F.count("*").alias("words"), F.sum("frequency").alias("tokens"))
    return sums.join(F.broadcast(total)).select("category", "words", (100.0 * F.col("tokens") / F.col("total")).alias("percent"))


def last_wins(rows: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """The last row by order of each key."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("v"))
    return last.select(key, *(F.col(f"v.{v}").alias(v) for v in values))


def rewritten(utterances: DataFrame, loanwords: DataFrame, particles: tuple[str, ...] = X.PARTICLES) -> DataFrame:
    """pos, text (clean), rewritten: loanwords in their English spelling, a particle apart; other inflections unchanged.

    loanwords: word, english, suffix. Only words that are rewritten at all are joined, by a join on words, so the table may be
    of any size.
    """
    pairs = rewrites(utterances, loanwords, particles)
    return pairs.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("at", "before", "after"))).alias("w")).select("pos", F.array_join(F.transform("w", lambda x: x["before"]), " ").alias("text"), F.array_join(F.transform("w", lambda x: x["after"]), " ").alias("rewritten"))


def rewrites(utterances: DataFrame, loanwords: DataFrame, particles: tuple[str, ...] = X.PARTICLES) -> DataFrame:
    """pos, at, before, after of every word."""
    suffix = F.btrim("suffix", F.lit(X.ZWJ + X.ZWNJ))
    new = F.when(suffix == "", F.col("english")).when(suffix.isin(*particles), F.concat_ws(" ", "english", suffix))
    table = loanwords.select("word", new.alias("new")).where("new IS NOT NULL").dropDuplicates(["word"])
    said = utterances.select("pos", F.posexplode(F.split(X.clean(F.col("text")), " ")).alias("at", "word")).where("word <> ''")
    return said.join(table, "word", "left").select("pos", "at", F.col("word").alias("before"), F.coalesce("new", "word").alias("after"))


def written(utterances: DataFrame, loanwords: DataFrame, particles: tuple[str, ...] = X.PARTICLES) -> DataFrame:
    """utterances (pos, text, ...) that have a word, with cleaned and written: their text clean, and with loanwords rewritten.

    pos tells utterances apart. Only words that change are brought back to their utterances.
    """
    changed = rewrites(utterances, loanwords, particles).where("before <> after")
    changes = changed.groupBy("pos").agg(F.map_from_entries(F.collect_list(F.struct("at", "after"))).alias("changes"))
    rows = utterances.withColumn("cleaned", X.clean(F.col("text"))).where("cleaned <> ''").join(changes, "pos", "left")
    words = F.transform(F.split("cleaned", " "), lambda w, i: F.coalesce(F.try_element_at("changes", i), w))
    return rows.withColumn("written", F.when(F.col("changes").isNull(), F.col("cleaned")).otherwise(F.array_join(words, " "))).drop("changes")


def broken_invariants(lines: DataFrame) -> DataFrame:
    """path, pos, reason of lines (path, pos, line) of four fields and a known category that break an invariant, with the first they break.

    The word is composed, of Sinhala letters and joiners, listed once, and longer than its suffix, which it ends in; the English
    spelling has ASCII letters, spaces and hyphens only. The order of lines is another: each file's words ascend.
    """
    fields = F.split("line", "\t")
    rows = lines.where(F.col("line").rlike(r"(?U)\S") & (F.size(fields) == 4) & fields[1].isin(*CATEGORIES)).select("path", "pos", *(fields[i].alias(c) for i, c in ((0, "word"), (2, "english"), (3, "suffix"))))
    times = rows.groupBy("word").agg(F.count("*").alias("times"))
    before = F.lag("word").over(Window.partitionBy("path").orderBy("pos"))
    known = rows.withColumn("before", before).join(times, "word").withColumn("composed", X.nfc(F.col("word")) == F.col("word"))
    rules = (
        ("word not composed", ~F.col("composed")), ("word of other letters", ~F.col("word").rlike(r"^[\x{0D80}-\x{0DFF}\x{200C}\x{200D}]+$")), ("english of other letters", ~F.col("english").rlike("^[A-Za-z][A-Za-z -]*$")),
        ("suffix isn't the word's ending", ~F.col("word").endswith(F.col("suffix")) | (F.col("word") == F.col("suffix"))), ("listed more than once", F.col("times") > 1), ("out of order", F.col("before") > F.col("word")),
    )
    reason = F.coalesce(*(F.when(test, name) for name, test in rules))
    return known.withColumn("reason", reason).where("reason IS NOT NULL").select("path", "pos", "reason")
