"""Scoring of labels and transcripts against references; summaries and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions import editdistance as E
from voxloom.functions import text as X

# The sources in order, with language, corpus, errors by character, and bracketed glosses.
SOURCES = (
    ("en_us", "English", "fleurs", False, False),
    ("cmn_hans_cn", "Chinese", "fleurs", True, True),
    ("es_419", "Spanish", "fleurs", False, False),
    ("fr_fr", "French", "fleurs", False, False),
    ("de_de", "German", "fleurs", False, False),
    ("librispeech", "English", "librispeech", False, False),
)
MAX_ERROR = 0.3


def sources(spark) -> DataFrame:
    """source, language, corpus, by_character, glossed, ord: the fixed table of sources."""
    rows = [(*s, i) for i, s in enumerate(SOURCES)]
    return spark.createDataFrame(rows, "source string, language string, corpus string, by_character boolean, glossed boolean, ord int")


def parse_sources(given: str) -> list[str]:
    """A comma-separated list: trimmed, empties dropped, unknown ones or none at all refused, order kept."""
    names = [n for n in map(str.strip, given.split(",")) if n]
    unknown = [n for n in names if n not in {s[0] for s in SOURCES}]
    if unknown or not names:
        raise ValueError(f"unknown sources: {', '.join(unknown)}" if unknown else "no sources")
    return names


def pair_errors(pairs: DataFrame) -> DataFrame:
    """pairs (reference, hypothesis, ...) with lengths and distances by words and characters of the normalised texts."""
    n = pairs.withColumn("_r", X.normalise(F.col("reference"))).withColumn("_h", X.normalise(F.col("hypothesis")))
    n = n.withColumn("_rw", X.words(F.col("_r"))).withColumn("_hw", X.words(F.col("_h"))).withColumn("_rc", X.characters(F.col("_r"))).withColumn("_hc", X.characters(F.col("_h")))
    return n.select(
        *pairs.columns, F.col("_rw").alias("reference_words"), F.col("_hw").alias("hypothesis_words"),
        F.size("_rw").alias("words"), F.length("_rc").alias("characters"), F.length("_hc").alias("hypothesis_characters"),
        E.word_distance(F.col("_rw"), F.col("_hw")).alias("word_errors"), F.levenshtein("_rc", "_hc").alias("character_errors"),
    )


def label_errors(pairs: DataFrame) -> DataFrame:
    """pairs (source, reference, hypothesis, ...) with error: by words, or characters, as the source says; glossed sources take the lesser error with and without glosses.

    Pairs of other sources are left out, as are those with a null text. An empty reference gives null. length is the
    number of words or characters that the error is a share of.
    """
    known = pairs.where("reference IS NOT NULL AND hypothesis IS NOT NULL").join(F.broadcast(sources(pairs.sparkSession)), "source")
    scored = pair_errors(known.select(*pairs.columns, "by_character", "glossed"))
    rate, glossed = _rate(F.col("by_character")), F.col("glossed")
    length = F.when(F.col("by_character"), F.col("characters")).otherwise(F.col("words"))
    scored = scored.select(*pairs.columns, "by_character", "glossed", rate.alias("plain"), length.alias("length"))
    # the second scoring is for glossed pairs only; the others have nulls in it, which cost nothing
    bare = scored.select("*", F.col("reference").alias("whole"), F.col("hypothesis").alias("said")).withColumn("reference", F.when(glossed, X.without_glosses(F.col("reference")))).withColumn("hypothesis", F.when(glossed, F.col("hypothesis")))
    both = pair_errors(bare).withColumn("bare", rate).withColumn("reference", F.col("whole")).withColumn("hypothesis", F.col("said"))
    return both.select(*pairs.columns, "length", F.least("plain", "bare").alias("error"))


def _rate(by_character: Column) -> Column:
    return F.when(by_character, E.error_rate(F.col("character_errors"), F.col("characters"))).otherwise(E.error_rate(F.col("word_errors"), F.col("words")))


def summary(rows: DataFrame, max_error: float = MAX_ERROR) -> DataFrame:
    """Per source and in total: utterances, hours, kept, kept_percent, kept_hours, median_error. rows: source, seconds, error."""
    kept = F.col("error") <= max_error
    hours = lambda c: F.coalesce(F.sum(c), F.lit(0.0)) / 3600
    rolled = rows.rollup("source").agg(
        F.grouping("source").alias("is_total"), F.count("*").alias("utterances"), hours(F.col("seconds")).alias("hours"), F.count_if(kept).alias("kept"),
        hours(F.when(kept, F.col("seconds"))).alias("kept_hours"), F.coalesce(F.median("error"), F.lit(0.0)).alias("median_error"),
    )
    name = F.when(F.col("is_total") == 1, "total").otherwise(F.col("source"))
    return rolled.select(name.alias("source"), "utterances", "hours", "kept", (100.0 * F.col("kept") / F.col("utterances")).alias("kept_percent"), "kept_hours", "median_error")


def summary_lines(summaries: DataFrame) -> DataFrame:
    """source, line: the summary as aligned text."""
    line = F.format_string("%-12s %10d %6.1f %6d %6.1f%% %7.1f %7.3f", "source", "utterances", "hours", "kept", "kept_percent", "kept_hours", "median_error")
    return summaries.select("source", line.alias("line"))


def cut(rows: DataFrame, max_error: float = MAX_ERROR) -> DataFrame:
    """Rows at or under the limit, in the rounding they are written with. Null, NaN, infinite and negative errors are refused."""
    if max_error < 0:
        raise ValueError("a negative limit")
    sound = rows.where("error >= 0 AND NOT isnan(error) AND error < double('Infinity')")
    return sound.where(X.fixed3(F.col("error")).cast("double") <= max_error)


def tally(pairs: DataFrame, *by: str) -> DataFrame:
    """The counters of the evaluation per group: errors and lengths, truncated hypotheses, Latin words and those matched."""
    scored = pair_errors(pairs.where("reference IS NOT NULL AND hypothesis IS NOT NULL"))
    latin = lambda c: F.filter(c, X.is_latin)
    rows = scored.withColumn("rl", latin("reference_words")).withColumn("hl", latin("hypothesis_words"))
    total = lambda c, name: F.sum(c).cast("long").alias(name)
    return rows.groupBy(*by).agg(
        *(total(F.col(c), c) for c in ("character_errors", "characters", "word_errors", "words")), F.count("*").alias("utterances"),
        F.count_if(2 * F.col("hypothesis_characters") < F.col("characters")).alias("truncated"),
        total(F.size("rl"), "latin_in_references"), total(F.size("hl"), "latin_in_hypotheses"), total(E.shared_count(F.col("rl"), F.col("hl")), "latin_matched"),
    )


def tally_rates(tallies: DataFrame, *by: str) -> DataFrame:
    """Rates of tallies: 0 where there is nothing to divide by, null for Latin words."""
    over = lambda a, b, none: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(none)
    zero, null = F.lit(0.0), F.lit(None).cast("double")
    return tallies.select(*by, over("character_errors", "characters", zero).alias("cer"), over("word_errors", "words", zero).alias("wer"), over("latin_matched", "latin_in_references", null).alias("latin_recall"), over("latin_matched", "latin_in_hypotheses", null).alias("latin_precision"))


def upper_median(value: str) -> Column:
    """The value at place n / 2 of the sorted values, counted from 0: the upper of two middle ones. Only values and their counts are gathered."""
    return F.coalesce(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)"), F.lit(0.0))


def language_report(transcripts: DataFrame, *by: str) -> DataFrame:
    """utterances, matches and accuracy of languages, real-time factor and upper median of milliseconds per group."""
    spent = F.sum("milliseconds") / 1000
    return transcripts.groupBy(*by).agg(
        F.count("*").alias("utterances"), F.count_if(F.col("expected_language") == F.col("language")).alias("matches"),
        (F.count_if(F.col("expected_language") == F.col("language")) / F.count("*")).alias("accuracy"),
        F.coalesce(F.when(spent > 0, F.sum("seconds") / spent), F.lit(0.0)).alias("real_time_factor"), upper_median("milliseconds").alias("median_ms"),
    )


def languages(transcripts: DataFrame) -> DataFrame:
    """language, utterances; no language is 'none'."""
    return transcripts.groupBy(F.coalesce("language", F.lit("none")).alias("language")).agg(F.count("*").alias("utterances"))


# The two letters of the sources' languages in the names of their evaluation files.
SHORT = {"en_us": "en", "cmn_hans_cn": "zh", "es_419": "es", "fr_fr": "fr", "de_de": "de"}


def evaluation_records(references: DataFrame, split: str, folder: str) -> DataFrame:
    """name, source, audio, record of references (source, file, transcript): what an evaluation file of each source's language holds.

    Glossed sources lose their glosses. Sources without a short name have no such file.
    """
    known = references.join(F.broadcast(sources(references.sparkSession)), "source").where(F.col("source").isin(*SHORT))
    short = F.coalesce(*(F.when(F.col("source") == code, name) for code, name in SHORT.items()))
    said = F.when(F.col("glossed"), X.without_glosses(F.col("transcript"))).otherwise(F.col("transcript"))
    audio = F.concat_ws("/", F.lit(folder), "source", F.lit("audio"), F.lit(split), "file")
    record = F.concat(F.lit("language "), "language", F.lit(X.MARKER), said)
    return known.select(F.concat(F.lit("fleurs_"), short, F.lit(f"_{split}")).alias("name"), "source", audio.alias("audio"), record.alias("record"))


def mismatches(labels: DataFrame, references: DataFrame) -> DataFrame:
    """source, problem, files: labels (source, file) without a reference, and references of fleurs sources without a label. Either stops scoring; other corpora are labelled in part."""
    known = F.broadcast(sources(labels.sparkSession).select("source", "corpus"))
    keys = ["source", "file"]
    a, b = labels.select(*keys).distinct().join(known, "source"), references.select(*keys).distinct().join(known, "source")
    unknown = a.join(b, keys, "left_anti").select("source", F.lit("no reference").alias("problem"))
    missing = b.where("corpus = 'fleurs'").join(a, keys, "left_anti").select("source", F.lit("no label").alias("problem"))
    return unknown.unionByName(missing).groupBy("source", "problem").agg(F.count("*").alias("files"))


def report_sentences(tallies: DataFrame, *by: str) -> DataFrame:
    """by, line of tallies: an evaluation in a sentence; parts about Latin words and cut hypotheses only where there are any."""
    r = lambda a, b: F.format_string("%.2f", 100.0 * F.col(a) / F.greatest(F.col(b), F.lit(1)))
    latin = F.when(F.col("latin_in_references") > 0, F.concat(F.lit("Latin words "), F.col("latin_matched").cast("string"), F.lit(" of "), F.col("latin_in_references").cast("string")))
    short = F.when(F.col("truncated") > 0, F.concat(F.col("truncated").cast("string"), F.lit(" under half as long")))
    head = F.concat(F.col("utterances").cast("string"), F.lit(" utterances, CER "), r("character_errors", "characters"), F.lit(" %, WER "), r("word_errors", "words"), F.lit(" %"))
    return tallies.select(*by, F.concat_ws(", ", head, latin, short).alias("line"))
