"""The queries of the core, over the tables of a folder. Each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import editdistance as E
from voxloom.functions import text as X
from voxloom.operators import batching as B
from voxloom.operators import checks, leakage, manifest, rejects, scoring, speakers, tensors
from voxloom.operators import vocabulary as V
from voxloom.session import stored
from voxloom.session import table as T
from voxloom.sources import readers
from voxloom.streaming import labelling

SEED, TEST, DEV = 52, 24, 12
BUDGET, PER_STEP = 4096, 128
FIRST_ID = 64


def _utterances(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "utt_spk_text").select("pos", "utterance", "speaker", "text", "source")


# scans


def utterance_scan(s, d):
    """Utterance lines parsed back: at most three fields, blank lines skipped."""
    lines = T(s, d, "utt_spk_text").select(F.lit("utt_spk_text").alias("path"), "pos", F.concat_ws("\t", *(F.coalesce(c, F.lit("")) for c in ("utterance", "speaker", "text"))).alias("line"))
    return readers.utterances(lines).select("pos", "utterance", "speaker", "text")


def speaker_split_scan(s, d):
    lines = T(s, d, "speaker_split").select(F.lit("speaker-split").alias("path"), F.lit(0).alias("pos"), F.concat_ws("\t", "speaker", "split").alias("line"))
    return readers.speaker_split(lines).groupBy("split", "problem").agg(F.count("*").alias("rows"))


def loanword_scan(s, d):
    """Unquoted lines of classified words by category E, with the problems of the others."""
    lines = T(s, d, "loanword_lines").select("path", F.col("line_no").alias("pos"), "line")
    return readers.loanwords(lines, "E").select("path", "pos", "word", "category", "english", "suffix", "problem")


def replay_scan(s, d):
    error = F.when(F.isnan("error"), "nan").when(F.abs("error") == float("inf"), "inf").otherwise(F.coalesce(F.col("error").cast("string"), F.lit("")))
    lines = T(s, d, "replay").select(F.lit("replay").alias("path"), F.lit(0).alias("pos"), F.concat_ws("\t", F.coalesce("source", F.lit("")), "file", error, F.coalesce("label", F.lit(""))).alias("line"))
    return readers.replay(lines).groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("rows"))


def record_parse(s, d):
    """audio, language and transcript of every training record."""
    t = F.col("text")
    return T(s, d, "train").select("pos", "audio", X.language_of(t).alias("language"), X.transcript_of(t).alias("transcript"), F.coalesce(t.contains(X.MARKER), F.lit(False)).alias("marked"))


def multi_file_union(s, d):
    """The same records twice are kept twice."""
    one = T(s, d, "train").select("source", "audio")
    return one.unionAll(one).groupBy("source").agg(F.count("*").alias("records"), F.count_distinct("audio").alias("audios"))


def recording_listing(s, d):
    """Files that are recordings by their extension, in any case."""
    return T(s, d, "replay").where(F.lower("file").rlike(r"\.(wav|flac)$")).groupBy(F.lower(F.regexp_extract("file", r"\.([^.]+)$", 1)).alias("extension")).agg(F.count_distinct("file").alias("files"))


# vocabulary


def vocabulary(s, d):
    return V.vocabulary(V.count_words(_utterances(s, d))).select("word", "count", "rank")


def vocab_chunks(s, d):
    """Words and tokens of each chunk of the vocabulary."""
    return V.vocabulary(V.count_words(_utterances(s, d))).groupBy("chunk").agg(F.count("*").alias("words"), F.sum("count").alias("tokens"), F.min("rank").alias("first_rank"))


def vocabulary_coverage(s, d):
    return V.coverage(V.count_words(_utterances(s, d)))


def _split(s, d):
    """speaker, split: of a speaker's rows the last in the table holds."""
    place = F.struct(F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    return V.last_wins(T(s, d, "speaker_split").select("speaker", "split", place.alias("order")), "speaker", "order", "split")


def _audio(utterances):
    return utterances.withColumn("audio", X.audio_path(F.concat(F.lit("/corpora/"), "source"), F.col("utterance")))


def _word_lists(s, d):
    """The classified words themselves as sentences, ten lines each: pos, text."""
    rows = T(s, d, "loanword_lines").where("line IS NOT NULL").select("path", "line_no", F.split("line", "\t")[0].alias("word"))
    own = F.expr("CAST(regexp_extract(path, '([0-9]+)', 1) AS BIGINT) * 1000000 + line_no DIV 10").alias("pos")
    words = F.array_sort(F.collect_list(F.struct("line_no", "word")))
    return rows.groupBy(own).agg(F.array_join(F.transform(words, lambda x: x["word"]), " ").alias("text"))


def _corpus_counts(s, d):
    return V.count_words(_utterances(s, d).select("pos", "text").union(_word_lists(s, d)))


def _judged(s, d):
    return V.judged_lines(T(s, d, "loanword_lines"), _corpus_counts(s, d))


def loanword_problems(s, d):
    return _judged(s, d).where("problem IS NOT NULL").select("path", "line_no", "problem")


def loanword_merge(s, d):
    return V.merge(_judged(s, d)).select("word", "category", "english", "suffix", "frequency")


def loanword_shares(s, d):
    return V.category_shares(V.merge(_judged(s, d)), _corpus_counts(s, d))


def _loanwords(s, d):
    lines = T(s, d, "loanword_lines").select("path", F.col("line_no").alias("pos"), "line")
    sound = readers.loanwords(lines, "E").where("problem IS NULL")
    return V.last_wins(sound.withColumn("order", F.concat("path", F.lpad(F.col("pos").cast("string"), 12, "0"))), "word", "order", "english", "suffix")


def word_rewrite(s, d):
    return _written(s, d).where("cleaned <> written").select("pos", F.col("written").alias("rewritten"))


def rewrite_counts(s, d):
    return V.rewrites(_utterances(s, d), _loanwords(s, d)).where("before <> after").groupBy("before", "after").agg(F.count("*").alias("times"))


# speakers


def speaker_counts(s, d):
    return speakers.counts(_utterances(s, d))


def speaker_split_hash(s, d):
    by = speakers.counts(_utterances(s, d))
    return speakers.hash_split(by, SEED, 6, 3)


def speaker_split_sizes(s, d):
    return speakers.split_sizes(speaker_split_hash(s, d))


def speaker_split_mt(s, d):
    return speakers.shuffled_split(speakers.counts(_utterances(s, d)), SEED, 6, 3)


def split_last_wins(s, d):
    """The text delivered last of each utterance."""
    return V.last_wins(T(s, d, "utt_spk_text"), "utterance", "pos", "speaker", "text")


def sample_sharded(s, d):
    files = T(s, d, "replay").where("source = 'librispeech'").select("file").distinct()
    return speakers.hash_sample(files, "file", 40, SEED, 4)


def sample_speakers(s, d):
    drawn = sample_sharded(s, d)
    return drawn.groupBy("shard").agg(F.count("*").alias("files"), F.count_distinct(F.split("file", "-")[0]).alias("speakers"))


# splits and leakage


def _written(s, d):
    """Utterances that have a word, with their text as training writes it: clean, loanwords in English."""
    return V.written(_utterances(s, d), _loanwords(s, d))


def _records(s, d):
    """Written records with their split and the key of what is written; kept, for train and evaluation rows are read apart."""
    return stored(_prepared(s, d).select("utterance", "split", "key"), "records")


def _prepared(s, d):
    """All utterances of speakers with a split; preparing stops at the others, which missing_speakers lists."""
    split = _split(s, d)
    return leakage.prepared(_audio(_utterances(s, d)).join(split.select("speaker"), "speaker", "left_semi"), split, _loanwords(s, d))


def training_files(s, d):
    """Every row of the files that preparing writes, with evaluation sentences held out of train."""
    rows = stored(_prepared(s, d).select("pos", "split", "audio", "record", "key"), "prepared")
    return leakage.training_files(rows, True).select("file", "pos", "audio", "record")


def sentence_keys(s, d):
    return _written(s, d).select("pos", X.sentence_key(F.col("written")).alias("key"))


def new_sentences(s, d):
    return leakage.new_sentences(_records(s, d)).select("utterance", "split")


def hold_out(s, d):
    return leakage.hold_out(_records(s, d)).select("utterance", "split")


def new_after_hold_out(s, d):
    return leakage.new_sentences(stored(leakage.hold_out(_records(s, d)), "held_out")).groupBy("split").agg(F.count("*").alias("rows"))


def split_counters(s, d):
    """Per split: rows, empty after cleaning, written (the others), rewritten and held out of these, and rows without a recording in training.

    Rewritten and written are before holding out; a missing recording takes no row away.
    """
    recorded = T(s, d, "train").select(F.col("audio").alias("own")).where("own IS NOT NULL").distinct().withColumn("recorded", F.lit(True))
    new = _written(s, d).select("pos", (F.col("cleaned") != F.col("written")).alias("rewritten"), X.sentence_key(F.col("written")).alias("key"))
    rows = _audio(_utterances(s, d)).withColumnRenamed("audio", "own").join(_split(s, d), "speaker", "left").join(recorded, "own", "left").join(new, "pos", "left")
    rows = stored(rows.select(F.coalesce("split", F.lit("none")).alias("split"), F.coalesce("rewritten", F.lit(False)).alias("rewritten"), "key", F.col("recorded").isNull().alias("missing")), "counted")
    evaluated = rows.where("split NOT IN ('none', 'train')").select("key").distinct().withColumn("evaluated", F.lit(True))
    empty, held = F.col("key").isNull(), (F.col("split") == "train") & F.col("evaluated")
    return rows.join(evaluated, "key", "left").groupBy("split").agg(
        F.count("*").alias("rows"), F.count_if(empty).alias("empty"), F.count_if(~empty).alias("written"), F.count_if("rewritten").alias("rewritten"), F.count_if(held).alias("held_out"), F.count_if("missing").alias("missing_audio"),
    )


def missing_speakers(s, d):
    """Speakers without a split."""
    return checks.missing(_utterances(s, d).where("speaker IS NOT NULL"), T(s, d, "speaker_split").where("speaker IS NOT NULL"), "speaker")


def clean_text(s, d):
    return _utterances(s, d).where("text IS NOT NULL").select("pos", X.clean(F.col("text")).alias("cleaned"))


def record_paths(s, d):
    """The record that a training file has for each utterance that is written: its text clean, loanwords in English."""
    return _audio(_written(s, d)).where("source IS NOT NULL").select("pos", "audio", F.concat(F.lit("language Sinhala" + X.MARKER), "written").alias("record"))


def replay_paths(s, d):
    """Paths and languages of replay files: by speaker and chapter where the corpus is laid out so."""
    joined = T(s, d, "replay").select("source", "file").distinct().join(F.broadcast(scoring.sources(s)), "source")
    parts = F.split("file", "-", 3)
    path = F.when(F.col("corpus") == "librispeech", F.concat_ws("/", parts[0], parts[1], "file")).otherwise(F.concat_ws("/", "source", F.lit("audio"), "file"))
    return joined.select("source", "file", "language", path.alias("path"))


def audio_present(s, d):
    """Utterances whose recording is in training, per source."""
    own = X.audio_path(F.concat(F.lit("/corpora/"), "source"), F.col("utterance"))
    return readers.present(_utterances(s, d), own, T(s, d, "train").select(F.col("audio").alias("path"))).groupBy("source").agg(F.count("*").alias("rows"))


# scoring


def _pairs(s, d):
    return T(s, d, "transcript").select("run", "audio", "source", "reference", "hypothesis", "seconds").distinct()


def label_errors(s, d):
    return scoring.label_errors(_pairs(s, d)).select("run", "audio", "source", F.round("error", 9).alias("error"))


def word_errors(s, d):
    rows = scoring.pair_errors(_pairs(s, d).where("reference IS NOT NULL AND hypothesis IS NOT NULL"))
    return rows.select("run", "audio", "words", "characters", "word_errors", "character_errors")


def error_tally(s, d):
    return scoring.tally(_pairs(s, d), "run", "source")


def error_rates(s, d):
    return scoring.tally_rates(scoring.tally(_pairs(s, d), "source"), "source")


def stale_tallies(s, d):
    """Tallies of the evaluation that differ from the transcripts in what they count as truncated."""
    own = scoring.tally(_pairs(s, d), "run", "source").select("run", "source", F.col("truncated").alias("counted"))
    return T(s, d, "error_tally").select("run", "source", "truncated").distinct().join(own, ["run", "source"]).where(~F.col("truncated").eqNullSafe(F.col("counted")))


def error_sentences(s, d):
    """Each run's evaluation in a sentence."""
    return scoring.report_sentences(scoring.tally(_pairs(s, d), "run"), "run")


def evaluation_records(s, d):
    """What the evaluation files of the fleurs languages hold, the labels standing for transcripts."""
    rows = T(s, d, "replay").where("label IS NOT NULL").select("source", "file", F.col("label").alias("transcript")).distinct()
    return scoring.evaluation_records(rows, "test", "/corpora")


def language_report(s, d):
    rows = T(s, d, "transcript").select("run", "audio", "expected_language", "language", "seconds", "milliseconds").distinct()
    return scoring.language_report(rows, "run")


def languages(s, d):
    return scoring.languages(T(s, d, "transcript").select("run", "audio", "language").distinct())


def _scored(s, d):
    rows = scoring.label_errors(_pairs(s, d))
    return rows.where("length > 0")  # a filter by the error itself would compute it twice


def replay_summary(s, d):
    return scoring.summary(_scored(s, d))


def replay_summary_lines(s, d):
    return scoring.summary_lines(scoring.summary(_scored(s, d)))


def replay_cut(s, d):
    """Kept and dropped replay records per known source, in the sources' order."""
    rows = T(s, d, "replay").select("source", "file", "error", "label").distinct().join(F.broadcast(scoring.sources(s)), "source")
    kept = scoring.cut(rows).groupBy("source").agg(F.count("*").alias("kept"))
    return rows.groupBy("source", "ord").agg(F.count("*").alias("records")).join(kept, "source", "left").select("source", "ord", "records", F.coalesce("kept", F.lit(0)).alias("kept"))


def gloss_free(s, d):
    rows = T(s, d, "replay").where("source = 'cmn_hans_cn' AND label IS NOT NULL").select("file", "label").distinct()
    return rows.select("file", X.without_glosses(F.col("label")).alias("bare"))


def flat_hypotheses(s, d):
    return _pairs(s, d).where("hypothesis IS NOT NULL").select("run", "audio", X.flat_line(F.col("hypothesis")).alias("line"))


def shared_words(s, d):
    rows = _pairs(s, d).where("reference IS NOT NULL AND hypothesis IS NOT NULL").withColumn("a", X.words(X.normalise(F.col("reference")))).withColumn("b", X.words(X.normalise(F.col("hypothesis"))))
    return rows.select("run", "audio", E.shared_count(F.col("a"), F.col("b")).alias("shared"))


# batches


def _lengths(s, d):
    n = F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 10)).cast("long")
    return T(s, d, "documents").where("n_chars IS NOT NULL").select("doc_id", n.alias("length")).withColumn("step", F.floor(F.col("doc_id") / PER_STEP)).select("step", F.col("doc_id").alias("at"), "length")


def epoch_steps(s, d):
    at = B.step_position(F.floor(F.col("o_orderkey") / PER_STEP), 7)
    return T(s, d, "orders").select(at.alias("p")).groupBy("p.epoch", "p.step").agg(F.count("*").alias("records"))


def token_budget_pack(s, d):
    return B.micro_batches(_lengths(s, d), BUDGET)


def step_totals(s, d):
    return B.step_totals(B.micro_batches(_lengths(s, d), BUDGET))


def _token_ids(s, d):
    """Token-like ids of each document's whole text: its code points, above the FIRST_ID ids that mean something else."""
    rows = T(s, d, "documents").where("n_chars > 0").select("doc_id", "n_chars", X.code_points(F.col("text")).alias("codes"))
    return rows.select("doc_id", "n_chars", F.transform("codes", lambda c: c + FIRST_ID).alias("label"))


def pad_layout(s, d):
    """Rows of token-like ids, the end last, padded to the longest of their step."""
    ids = _token_ids(s, d).select("doc_id", F.floor(F.col("doc_id") / 16).alias("step"), F.array_append("label", F.lit(9)).alias("ids"))
    return B.padded_rows(ids, "step", 0).select("doc_id", "length", F.array_join("inputs", ",").alias("inputs"))


def prompt_targets(s, d):
    """Places and ids of label tokens in assembled prompts: placeholders of a clip of as many frames as the text has characters, the label its whole text."""
    n = B.audio_tokens(F.col("n_chars"))
    ids = B.prompt(F.array(F.lit(1), F.lit(2)), 50, n, F.array(F.lit(3), F.lit(4)), F.col("label"), 9)
    rows = _token_ids(s, d).select("doc_id", ids.alias("ids"), (n + 4).cast("int").alias("prompt"))
    return rows.select("doc_id", F.explode(B.targets(F.col("ids"), F.col("prompt"))).alias("t")).select("doc_id", "t.place", "t.id")


def token_lengths(s, d):
    """Ids of each document by a tokeniser given as a function: bytes, above three ids that mean something else."""
    encode = B.tokeniser(lambda texts: [[b + 3 for b in t.encode()] for t in texts])
    rows = T(s, d, "documents").where("text IS NOT NULL").select("doc_id", encode(F.col("text")).alias("ids"))
    return rows.select("doc_id", F.size("ids").alias("tokens"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum"))


def audio_places(s, d):
    """Where placeholders of audio lie in assembled prompts."""
    n = B.audio_tokens(F.col("n_chars"))
    ids = B.prompt(F.array(F.lit(1), F.lit(2)), 50, n, F.array(F.lit(3), F.lit(4)), F.array(F.lit(7)), 9)
    places = B.audio_places(ids, 50)
    return T(s, d, "documents").where("n_chars > 0").select("doc_id", places.alias("p")).select("doc_id", F.size("p").alias("n"), F.array_min("p").alias("first"), F.array_max("p").alias("last"))


def audio_tokens(s, d):
    frames = F.floor(F.col("seconds") * 100).cast("int")
    return T(s, d, "transcript").where("seconds > 0").select("run", "audio", frames.alias("frames")).distinct().select("run", "audio", B.audio_tokens(F.col("frames")).alias("tokens"), B.convolved(F.col("frames")).cast("long").alias("convolved"))


def _clips(s, d):
    rows = T(s, d, "documents").where("n_chars > 0").select(F.floor(F.col("doc_id") / 8).alias("batch"), F.col("doc_id").alias("clip"), F.col("n_chars").cast("int").alias("frames"))
    return B.clip_chunks(rows)


def clip_features(s, d):
    return _clips(s, d).groupBy("batch", "clip").agg(F.count("*").alias("chunks"), F.sum("rows").alias("features"))


def chunk_windows(s, d):
    return B.windows(_clips(s, d))


def window_cells(s, d):
    """Cells of the padded window matrices, masked ones apart, per batch."""
    return B.window_matrix(B.windows(_clips(s, d))).groupBy("batch", "masked").agg(F.count("*").alias("cells"), F.sum("row").alias("rows"))


def audio_offsets(s, d):
    """Where each clip's features begin within its batch."""
    return clip_features(s, d).select("batch", "clip", B.running_offset("features", "batch", "clip").alias("first_feature"))


def lr_schedule(s, d):
    return s.range(1578).select("id", F.round(B.learning_rate(F.col("id"), 1e-5, 1578, 0.02), 12).alias("rate"))


def eval_steps(s, d):
    return B.evaluation_steps(s, 2, 1816, 4)


def checkpoint_retention(s, d):
    """The newest three transcripts of each run by their milliseconds as steps."""
    rows = T(s, d, "transcript").groupBy("run", F.floor("milliseconds").alias("step")).agg(F.count("*").alias("rows"))
    return B.newest(rows.where("step IS NOT NULL"), 3, "run")


# settings, files, checks


def settings_diff(s, d):
    old = T(s, d, "run_settings")
    new = old.withColumn("val", F.when(F.col("name") == "token_budget", "3072").otherwise(F.col("val"))).where("name <> 'min_count'").union(s.createDataFrame([("epochs", "2"), ("seed", "53")], "name string, val string"))
    return checks.setting_differences(old, new.where("NOT (name = 'seed' AND val = '52')"), ("seed",))


def manifest_verify(s, d):
    """Digests of documents as files, held against a manifest with some entries wrong."""
    files = T(s, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    kind = F.element_at(F.array(F.lit("sha256"), F.lit("md5"), F.lit("git")), (F.pmod(F.col("path").cast("long"), F.lit(3)) + 1).cast("int"))
    listed = files.withColumn("kind", kind).select("path", (F.length("content") + F.when(F.pmod(F.col("path").cast("long"), F.lit(11)) == 0, 1).otherwise(0)).alias("size"), "kind", F.when(F.pmod(F.col("path").cast("long"), F.lit(7)) == 0, "0").otherwise(manifest.digest(F.col("content"), F.col("kind"))).alias("expected"))
    return manifest.verified(listed, files.where("CAST(path AS BIGINT) % 13 <> 0")).groupBy("state").agg(F.count("*").alias("files"))


def file_digests(s, d):
    content = F.encode("text", "UTF-8")
    return T(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(content, 256).alias("sha256"), F.md5(content).alias("md5"), manifest.git_id(content).alias("git"))


def ordered_digest(s, d):
    """A digest of the training records of each source in their order."""
    line = F.concat_ws("", F.coalesce("audio", F.lit("")), F.lit("\t"), F.coalesce("text", F.lit("")), F.lit("\n"))
    return manifest.ordered_digest(T(s, d, "train").where("source IS NOT NULL"), "source", "pos", line)


def duplicate_labels(s, d):
    return checks.repeated(T(s, d, "replay").where("file IS NOT NULL"), "file")


def data_quality(s, d):
    """Replay records with a problem, by reason."""
    rules = [("no source", F.col("source").isNull()), ("unknown source", ~F.col("source").isin(*(x[0] for x in scoring.SOURCES))), ("no error", F.col("error").isNull()), ("not finite", F.isnan("error") | (F.abs("error") == float("inf"))), ("negative", F.col("error") < 0), ("no label", F.coalesce(F.col("label"), F.lit("")) == "")]
    return checks.problems(T(s, d, "replay"), rules, "file").groupBy("reason").agg(F.count("*").alias("rows"))


def incremental_unlabelled(s, d):
    """Evaluation recordings that not every run has a transcript of: the runs that have one, and how many have none.

    A row for each recording: which runs lack it follows from those that have it, and rows don't multiply with the runs.
    """
    return labelling.unlabelled_by(T(s, d, "transcript").select(F.col("audio").alias("file"), "run"), "run")


def supported_languages(s, d):
    """Answers in a language that isn't one of the sources' or Sinhala."""
    known = sorted({x[1] for x in scoring.SOURCES} | {"Sinhala"})
    return T(s, d, "transcript").where(F.col("language").isNotNull() & ~F.array_contains(F.array(*map(F.lit, known)), F.col("language"))).groupBy("language").agg(F.count("*").alias("rows"))


def safe_members(s, d):
    members = T(s, d, "train").select(F.expr("substr(audio, 2)").alias("name"), (F.pmod("pos", F.lit(17)) == 0).alias("is_link"))
    return manifest.safe_members(members, "corpora").groupBy(F.split("name", "/")[1].alias("folder")).agg(F.count("*").alias("members"))


def manifest_wanted(s, d):
    """All documents in a listing of those with text: large ones by sha256, others by git id; those without text aren't listed."""
    documents = T(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    listing = documents.where("text IS NOT NULL").select("path", F.octet_length("text").alias("size"), F.md5("text").alias("oid"), F.when(F.octet_length("text") > 2000, F.sha2("text", 256)).alias("lfs_oid"))
    return manifest.wanted(listing, documents.select("path"))


def reference_mismatch(s, d):
    """Replay labels without a record in training, and records of fleurs sources without a label."""
    records = T(s, d, "train").select("source", F.element_at(F.split("audio", "/"), -1).alias("file"))
    return scoring.mismatches(T(s, d, "replay"), records)


def needed_corpora(s, d):
    """Corpora that replay's sources need besides the one that is given."""
    chosen = [r[0] for r in T(s, d, "replay").join(F.broadcast(scoring.sources(s)), "source").select("source").distinct().collect()]  # six at most
    return manifest.needed(scoring.sources(s), chosen, ["fleurs"])


def sample_layout(s, d):
    """Where the drawn files are to lie, shard by shard, and the recording in training each stands for."""
    records = T(s, d, "train").where("source = 'librispeech' AND audio IS NOT NULL").select(F.element_at(F.split("audio", "/"), -1).alias("file"), F.col("audio").alias("target"))
    return manifest.layout(sample_sharded(s, d), records.groupBy("file").agg(F.min("target").alias("target")), "/out", 4)


def tolerance_gates(s, d):
    """Gates of each run: counts equal to the evaluation's tallies and errors within a hundredth, agreement of words, and what is right and wrong by characters in the places of cosine and loss."""
    own = scoring.tally(_pairs(s, d), "run").select("run", F.col("utterances").alias("counted"), F.col("character_errors").alias("value"), "characters")
    theirs = T(s, d, "error_tally").distinct().groupBy("run").agg(F.sum("utterances").alias("expected"), F.sum("character_errors").alias("wanted"))
    agreed = sequence_agreement(s, d).groupBy("run").agg(F.avg("share").alias("agreement"))
    wrong = F.col("value") / F.greatest("characters", F.lit(1))
    measured = own.join(theirs, "run").join(agreed, "run").withColumn("loss", wrong).withColumn("cosine", 1 - wrong)
    return tensors.gates(measured, 0.01, 0.97, 0.98, 0.05).select("run", "same_count", "close", "agrees", "similar", "learnt")


def table_invariants(s, d):
    """Lines of classified words, as they stand, that break the table's invariants, with the first they break."""
    lines = T(s, d, "loanword_lines").select("path", F.col("line_no").alias("pos"), "line")
    return V.broken_invariants(lines)


def first_records(s, d):
    """The first records of training in their order."""
    return T(s, d, "train").orderBy("pos").limit(100).select("pos", "audio")


def language_lists(s, d):
    """Configurations with a language added to their list, once."""
    listed = F.array_sort(F.collect_set("language")).alias("support_languages")
    rows = T(s, d, "transcript").where("language IS NOT NULL").groupBy("run").agg(F.to_json(F.struct(F.lit("asr").alias("model_type"), listed, F.lit(2).alias("layers"))).alias("config"))
    return rows.select("run", X.with_language(F.col("config"), "Sinhala").alias("config"))


def epoch_order(s, d):
    """The order of training records in the second epoch, as places."""
    n = T(s, d, "train").count()
    return s.createDataFrame(list(enumerate(speakers.epoch_order(n, SEED, 1))), "place long, record long")


def epoch_order_hash(s, d):
    """The order of training records in the second epoch by a hash, for any number of records."""
    return speakers.hashed_order(T(s, d, "train").select("pos"), "pos", SEED, 1)


def epoch_sample(s, d):
    """A seeded sample of training records: the first of the first epoch's order."""
    n = T(s, d, "train").count()
    return s.createDataFrame([(i,) for i in speakers.epoch_order(n, SEED, 0)[:20]], "record long")


# arrays of numbers


def _vectors(s, d):
    rows = T(s, d, "embeddings").select("vec_id", "embedding", "label")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(other, "vec_id")


def tensor_blend(s, d):
    v = tensors.blend(F.col("embedding"), F.col("other"), 0.25)
    return _vectors(s, d).select("vec_id", F.posexplode(v).alias("at", "x")).select("vec_id", "at", F.round(F.col("x").cast("double"), 4).alias("x"))


def tensor_blend_shares(s, d):
    """Each key blended by its own share."""
    v = tensors.blend(F.col("embedding"), F.col("other"), F.pmod("vec_id", F.lit(5)) / 4)
    return _vectors(s, d).select("vec_id", F.posexplode(v).alias("at", "x")).select("vec_id", "at", F.round(F.col("x").cast("double"), 4).alias("x"))


def tensor_norm(s, d):
    norm = tensors.global_norm(T(s, d, "embeddings"), "embedding")
    return norm.select(F.round("norm", 6).alias("norm"), F.round(tensors.clip_scale(F.col("norm"), 1.0), 9).alias("scale"))


def tensor_cosine(s, d):
    a, b = F.col("embedding"), F.col("other")
    return _vectors(s, d).select("vec_id", F.round(tensors.cosine(a, b), 9).alias("cosine"), F.round(F.sqrt(tensors.square_sum(a) / tensors.square_sum(b)), 9).alias("ratio"))


def tensor_sums(s, d):
    return tensors.key_sums(T(s, d, "embeddings").where("label IS NOT NULL"), "label", "embedding").select("label", "at", F.round("value", 6).alias("value"))


def tensor_quantise(s, d):
    return _packed(s, d, "float32")


def tensor_quantise_half(s, d):
    """As tensor_quantise, the grid's start and step in 16 bits."""
    return _packed(s, d, "bfloat16")


def _packed(s, d, dtype):
    rows = tensors.quantised(T(s, d, "embeddings"), "vec_id", "embedding", 32, 8, dtype)
    return rows.select("vec_id", "part", F.round(F.col("scale").cast("double"), 7).alias("scale"), F.round(F.col("bias").cast("double"), 6).alias("bias"), F.array_join(F.transform("packed", lambda x: x.cast("string")), ",").alias("words"))


def tensor_dequantise(s, d):
    """The values that come back from the quantised ones."""
    rows = tensors.quantised(T(s, d, "embeddings"), "vec_id", "embedding", 32, 8)
    back = rows.select("vec_id", "part", F.posexplode(tensors.dequantised(F.col("levels"), F.col("scale"), F.col("bias"))).alias("at", "x"))
    return back.select("vec_id", (F.col("part") * 32 + F.col("at")).alias("at"), F.round(F.col("x").cast("double"), 5).alias("x"))


def adam_update(s, d):
    step = tensors.adam_step(F.col("embedding"), F.col("other"), F.transform("embedding", lambda x: F.lit(0).cast("float")), F.transform("embedding", lambda x: F.lit(0).cast("float")), 1, 0.001)
    return _vectors(s, d).select("vec_id", F.posexplode(step["p"]).alias("at", "x")).select("vec_id", "at", F.round(F.col("x").cast("double"), 4).alias("x"))


def rounded_half_width(s, d):
    """Each value's neighbours among floats of 16 bits, of both kinds."""
    x = T(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("at", "x"))
    near = {f"{name}_{end}": tensors.rounded(dtype, up)(F.col("x")).cast("double") for dtype, name in (("bfloat16", "bf"), ("float16", "fp")) for end, up in (("down", False), ("up", True))}
    return x.select("vec_id", "at", *(c.alias(n) for n, c in near.items()))


def sequence_agreement(s, d):
    """First mismatch and share of equal words of hypotheses and references."""
    rows = _pairs(s, d).where("reference IS NOT NULL AND hypothesis IS NOT NULL").withColumn("a", F.split("reference", " ")).withColumn("b", F.split("hypothesis", " "))
    return rows.select("run", "audio", tensors.first_mismatch(F.col("a"), F.col("b")).alias("first_mismatch"), F.round(tensors.match_share(F.col("a"), F.col("b")), 9).alias("share"))


def loss_parts(s, d):
    """Losses of the transcripts' words: all, Sinhala, and the rest."""
    rows = T(s, d, "transcript").where("milliseconds IS NOT NULL AND reference IS NOT NULL").select("run", "audio", (F.col("milliseconds") / 1000).alias("loss"), F.size(F.split("reference", " ")).alias("targets"), F.coalesce(F.col("expected_language") == "Sinhala", F.lit(False)).alias("is_new")).distinct()
    return tensors.loss_parts(rows).select("part", F.round("total", 6).alias("total"), "targets", F.round("mean", 9).alias("mean"))


def bench_totals(s, d):
    """Seconds, utterances a second and hours an epoch per run."""
    rows = T(s, d, "transcript").where("milliseconds IS NOT NULL").select("run", "audio", "milliseconds").distinct()
    spent = F.sum("milliseconds") / 1000
    return rows.groupBy("run").agg(F.round(spent, 6).alias("seconds"), F.round(F.count("*") / spent, 9).alias("utterances_a_second"), F.round(spent / F.count("*") * 232390 / 3600, 6).alias("epoch_hours"))


def export_totals(s, d):
    return manifest.export_totals(T(s, d, "embeddings").select("vec_id", F.col("embedding").alias("v")), 2)


def _named_weights(s, d):
    head = F.when(F.col("vec_id") % 3 == 0, "audio_tower.").otherwise("model.")
    tail = F.when(F.col("vec_id") % 4 == 0, ".scales").when(F.col("vec_id") % 4 == 1, ".biases").otherwise(".weight")
    return T(s, d, "embeddings").select(F.concat(head, F.lit("layers."), F.col("vec_id").cast("string"), tail).alias("key"), F.col("embedding").alias("v"))


def weight_selection(s, d):
    """Weights of one part of the model, without what belongs to their quantisation."""
    return manifest.selected_weights(_named_weights(s, d), "audio_tower.", (".scales", ".biases")).select("key", F.size("v").alias("n"))


def weight_files(s, d):
    return manifest.weight_files(_named_weights(s, d), 2, "model.safetensors")


def weight_keys(s, d):
    """Two sets of arrays compared by key and size."""
    a = T(s, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("v"))
    b = a.where("key % 5 <> 0").select("key", F.when(F.col("key") % 7 == 0, F.slice("v", 1, 10)).otherwise(F.col("v")).alias("v")).union(s.createDataFrame([(-1, [1.0])], "key long, v array<float>"))
    return checks.shape_differences(a, b)


# lines that can't be loaded


def _loaded(s, d):
    labels, loans = (rejects.load(T(s, d, name), form) for name, form in (("label_lines", rejects.LABELS), ("loanword_lines", rejects.LOANWORDS)))
    return labels, loans


def p5_found(s, d):
    labels, loans = _loaded(s, d)
    return rejects.rejected(labels).union(rejects.rejected(loans)).select("path", "line_no", "reason")


def p5_labels(s, d):
    return rejects.accepted(_loaded(s, d)[0], rejects.LABELS)


def p5_loanwords(s, d):
    return rejects.accepted(_loaded(s, d)[1], rejects.LOANWORDS)


_ALL = (
    utterance_scan, speaker_split_scan, loanword_scan, replay_scan, record_parse, multi_file_union, recording_listing, vocabulary, vocab_chunks, vocabulary_coverage, loanword_problems, loanword_merge, loanword_shares, word_rewrite, rewrite_counts,
    speaker_counts, speaker_split_hash, speaker_split_sizes, speaker_split_mt, split_last_wins, sample_sharded, sample_speakers, sentence_keys, training_files, new_sentences, hold_out, new_after_hold_out, split_counters, missing_speakers, clean_text, record_paths, replay_paths, audio_present,
    label_errors, word_errors, error_tally, error_rates, stale_tallies, error_sentences, evaluation_records, language_report, languages, replay_summary, replay_summary_lines, replay_cut, gloss_free, flat_hypotheses, shared_words,
    epoch_steps, token_budget_pack, step_totals, pad_layout, prompt_targets, token_lengths, audio_places, audio_tokens, clip_features, chunk_windows, window_cells, audio_offsets, lr_schedule, eval_steps, checkpoint_retention,
    settings_diff, manifest_verify, file_digests, ordered_digest, duplicate_labels, data_quality, incremental_unlabelled, supported_languages, safe_members, manifest_wanted, needed_corpora, sample_layout, reference_mismatch, tolerance_gates, table_invariants, first_records, language_lists, epoch_order, epoch_order_hash, epoch_sample,
    tensor_blend, tensor_blend_shares, tensor_norm, tensor_cosine, tensor_sums, tensor_quantise, tensor_quantise_half, tensor_dequantise, adam_update, rounded_half_width, sequence_agreement, loss_parts, bench_totals, export_totals, weight_selection, weight_files, weight_keys,
    p5_found, p5_labels, p5_loanwords,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}
