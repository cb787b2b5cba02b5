"""Texts that lost their end at a field limit or when sending stopped, in pure SQL.

Word trigrams are counted inside complete texts and at their ends. Complete are the references, and hypotheses without one
(which, being few, hardly blur the ends). Each hypothesis' final trigram is joined to the counts, its own row's left out; rows
whose final trigram (almost) never ends a text are the candidates, and no row comes from elsewhere. What is frequent inside
decides for rows without a reference: the final trigram, or where that is rare the final two words or the last one, must be so
frequent that it would have ended texts at least EXPECTED times, were it like other grams, and almost never did; or the text
ends in a mark that cuts leave.

Of candidates with a reference an exact check follows: the end of the hypothesis is laid along the whole reference, and the row
is a case if letters or digits of the reference are left over. A cut that falls where other texts end isn't seen.

Han characters are words of their own. Null, empty and wordless hypotheses are no cases, nor is a single whole word, an answer
to silence. Missing end marks alone count for nothing, for only words are compared. Repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ends a gram may have for each hundred times inside, still "almost never"; and ends that it would have to be expected to have.
ALMOST_NEVER, EXPECTED = 2, 5
#: Characters of the end that are laid along the reference, and the share of them that may differ.
TAIL, DIFFERENT = 24, 0.34

# h and r: lower-case words with a space between, without invisible characters; g: the final words of h, up to three
WORDS = r"""
WITH bare AS (
  SELECT DISTINCT run, audio, hypothesis,
    lower(regexp_replace(hypothesis, '{invisible}', '')) AS h, lower(regexp_replace(reference, '{invisible}', '')) AS r
  FROM {t}),
spaced AS (
  SELECT run, audio, hypothesis,
    trim(regexp_replace(regexp_replace(h, '([\\x{{4E00}}-\\x{{9FFF}}])', ' $1 '), '[^\\p{{L}}\\p{{M}}\\p{{N}}\\x{{200D}}]+', ' ')) AS h,
    coalesce(trim(regexp_replace(regexp_replace(r, '([\\x{{4E00}}-\\x{{9FFF}}])', ' $1 '), '[^\\p{{L}}\\p{{M}}\\p{{N}}\\x{{200D}}]+', ' ')), '') AS r
  FROM bare)
SELECT *, xxhash64(slice(split(h, ' '), greatest(1, size(split(h, ' ')) - 2), 3)) AS g FROM spaced WHERE h <> '' OR r <> ''
"""
# A fixed value: characters that don't show, but for the joiner that shapes letters.
INVISIBLE = r"[\\x{00AD}\\x{200B}\\x{200C}\\x{200E}\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{FEFF}]"

# a complete text's trigrams; a text of fewer words is one gram
GRAMS = """
WITH texts AS (SELECT split(if(r <> '', r, h), ' ') AS w FROM {w}),
grams AS (
  SELECT explode(transform(sequence(1, greatest(1, size(w) - {n} + 1)), i -> struct(xxhash64(slice(w, i, {n})) AS g, i > size(w) - {n} AS at_end))) AS x
  FROM texts)
SELECT x.g AS g, count_if(NOT x.at_end) AS inside, count_if(x.at_end) AS ends FROM grams {only} GROUP BY x.g
"""

# how often a gram of so many words ends a text: the share of ends among all grams
SHARE = "SELECT count(*) / sum(greatest(1, size(split(if(r <> '', r, h), ' ')) - {n} + 1)) AS share FROM {w}"

FINAL = """
WITH f AS (SELECT *, if(r = '', 1, 0) AS own FROM {w} WHERE h <> '')
SELECT f.*, coalesce(c.inside, 0) AS inside, coalesce(c.ends, 0) - own AS ends FROM f LEFT JOIN {counts} c ON f.g = c.g
WHERE (coalesce(c.ends, 0) - own) * 100 <= {almost_never} * (coalesce(c.inside, 0) + coalesce(c.ends, 0) - own)
"""

ALIGNED = r"""
WITH tails AS (SELECT *, right(h, {tail}) AS tail, size(split(h, ' ')) AS n_words, sequence(1, length(r)) AS ks FROM {candidates} WHERE r <> ''),
near AS (
  SELECT *, array_min(transform(ks, k -> struct(levenshtein(tail, right(left(r, k), length(tail))) AS d, -k AS back))) AS best
  FROM tails)
SELECT run, audio FROM near
WHERE best.d <= {different} * length(tail)
  AND regexp_like(substr(r, 1 - best.back), '[\\p{{L}}\\p{{N}}]')
  AND NOT (n_words = 1 AND (substr(r, 1 - best.back, 1) = ' ' OR regexp_like(hypothesis, '[.!?\\x{{3002}}\\x{{FF01}}\\x{{FF1F}}]$')))
  AND NOT (slice(split(h, ' '), -least(2, n_words), 2) = slice(split(r, ' '), -least(2, n_words, size(split(r, ' '))), 2) AND length(h) >= 0.6 * length(r))
  AND (length(h) > 12 OR h = left(r, length(h)) OR n_words > 1 AND best.d <= 1)
"""

# candidates without a reference, with their last n words
LAST = "SELECT run, audio, hypothesis, inside, ends, split(h, ' ') AS w, xxhash64(slice(split(h, ' '), greatest(1, size(split(h, ' ')) - {n} + 1), {n})) AS last FROM {candidates} WHERE r = ''"

UNREFERENCED = r"""
WITH telling AS (
  SELECT run, audio FROM {three} WHERE inside * (SELECT share FROM {share3}) >= {expected} AND ends * 100 <= {almost_never} * inside
  UNION ALL SELECT c.run, c.audio FROM {two} c JOIN {counts2} g ON g.g = c.last WHERE g.inside * (SELECT share FROM {share2}) >= {expected} AND (g.ends - 1) * 100 <= {almost_never} * g.inside
  UNION ALL SELECT c.run, c.audio FROM {one} c JOIN {counts1} g ON g.g = c.last WHERE g.inside * (SELECT share FROM {share1}) >= {expected} AND (g.ends - 1) * 100 <= {almost_never} * g.inside)
SELECT DISTINCT c.run, c.audio FROM {three} c LEFT JOIN (SELECT DISTINCT *, true AS told FROM telling) t ON t.run <=> c.run AND t.audio <=> c.audio
WHERE size(w) > 1 AND (told AND NOT regexp_like(hypothesis, '[.!?\\x{{3002}}\\x{{FF01}}\\x{{FF1F}}]$') OR regexp_like(hypothesis, '(\\x{{FFFD}}| \\[)$'))
"""


def prepared(transcripts: DataFrame) -> DataFrame:
    """run, audio, hypothesis, h, r, g of the distinct rows with words."""
    words = WORDS.replace("{invisible}", INVISIBLE.replace("{", "{{").replace("}", "}}"))
    return transcripts.sparkSession.sql(words, t=transcripts.select("run", "audio", "reference", "hypothesis"))


def truncated(transcripts: DataFrame, store) -> DataFrame:
    """run, audio of the rows whose hypothesis was cut. store(df, name) writes intermediate tables to the shared folder."""
    spark = transcripts.sparkSession
    w = store(prepared(transcripts), "words")
    counts = spark.sql(GRAMS.replace("{only}", ""), w=w, n=3)
    candidates = store(spark.sql(FINAL, w=w, counts=counts, almost_never=ALMOST_NEVER), "candidates")
    cut = spark.sql(ALIGNED, candidates=candidates, tail=TAIL, different=DIFFERENT)
    last = {n: spark.sql(LAST, candidates=candidates, n=n) for n in (3, 2, 1)}
    # shorter grams are counted only where a row without a reference asks for them
    fewer = {n: spark.sql(GRAMS.replace("{only}", "LEFT SEMI JOIN {last} l ON l.last = x.g"), w=w, n=n, last=last[n]) for n in (2, 1)}
    share = {n: spark.sql(SHARE, w=w, n=n) for n in (3, 2, 1)}
    rest = spark.sql(
        UNREFERENCED, three=last[3], two=last[2], one=last[1], counts2=fewer[2], counts1=fewer[1], share3=share[3], share2=share[2], share1=share[1], expected=EXPECTED, almost_never=ALMOST_NEVER,
    )
    return cut.union(rest).distinct()


def truncation_rates(transcripts: DataFrame, cut: DataFrame) -> DataFrame:
    """source, hypotheses (with words or not, but not null), cut, rate of each source; a null source is one of its own."""
    rows = transcripts.where("hypothesis IS NOT NULL").select("run", "audio", "source").distinct()
    joined = rows.join(cut.withColumn("is_cut", F.lit(True)), ["run", "audio"], "left").groupBy("source")
    n, k = F.count("*"), F.count_if(F.coalesce("is_cut", F.lit(False)))
    return joined.agg(n.alias("hypotheses"), k.alias("cut"), (k / n).alias("rate"))
