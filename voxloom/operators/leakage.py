"""Keeping evaluation sentences out of training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.operators import checks
from voxloom.operators import vocabulary as V


def keyed(records: DataFrame) -> DataFrame:
    """records (split, text, ...) with the sentence's key."""
    return records.withColumn("key", X.sentence_key(F.col("text")))


def hold_out(rows: DataFrame) -> DataFrame:
    """Train rows whose sentence is in no evaluation split; other rows as they are."""
    others = rows.where("split <> 'train'").select("key").distinct()
    return rows.where("split = 'train'").join(others, "key", "left_anti").unionByName(rows.where("split <> 'train'"))


def new_sentences(rows: DataFrame) -> DataFrame:
    """Evaluation rows whose sentence isn't in train, as split dev_new and test_new."""
    train = rows.where("split = 'train'").select("key").distinct()
    return rows.where("split <> 'train'").join(train, "key", "left_anti").withColumn("split", F.concat("split", F.lit("_new")))


def prepared(utterances: DataFrame, split: DataFrame, loanwords: DataFrame, recorded: DataFrame | None = None) -> DataFrame:
    """utterances (pos, speaker, text, audio, ...) that are written, with split, written, record and key. A speaker without a split raises.

    split: speaker, split, one row for each. recorded: audio of the recordings there are; given, others' utterances are left out.
    """
    checks.enforce(checks.missing(utterances.where("speaker IS NOT NULL"), split, "speaker"))
    rows = V.written(utterances, loanwords).join(split, "speaker")
    if recorded is not None:
        rows = rows.join(recorded.select("audio").distinct(), "audio", "left_semi")
    return rows.withColumn("record", F.concat(F.lit("language Sinhala" + X.MARKER), "written")).withColumn("key", X.sentence_key(F.col("written")))


def training_files(rows: DataFrame, hold: bool) -> DataFrame:
    """The rows (split, key, ...) of each file to write, by file: train, dev and test, and dev_new and test_new, whose sentences aren't in the train file."""
    kept = hold_out(rows) if hold else rows
    return kept.withColumn("file", F.col("split")).unionByName(new_sentences(kept).withColumn("file", F.col("split")))
