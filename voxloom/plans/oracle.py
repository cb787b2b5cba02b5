"""SQL for the core's queries, for another engine over the same tables."""

from __future__ import annotations

from voxloom.operators.speakers import GAMMA, MIX, SHIFTS

_FULL = "".join(map(chr, range(0xFF01, 0xFF5F))) + "         　²³¹"
_HALF = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''") + " " * 10 + "231"
_WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_PARTICLES = "('එක', 'එකේ', 'එකට', 'එකෙන්', 'එකක්', 'එක්ක', 'වල', 'වලට', 'වලින්', 'ටික', 'ටිකක්')"
_SOURCES = "(VALUES ('en_us','English','fleurs',false,false,0),('cmn_hans_cn','Chinese','fleurs',true,true,1),('es_419','Spanish','fleurs',false,false,2),('fr_fr','French','fleurs',false,false,3),('de_de','German','fleurs',false,false,4),('librispeech','English','librispeech',false,false,5)) AS src(source, language, corpus, by_character, glossed, ord)"


def _clean(x: str) -> str:
    return f"array_to_string(list_filter(list_transform(regexp_split_to_array(nfc_normalize({x}), '{_WS}'), lambda w: trim(w, chr(8205) || chr(8204))), lambda w: w <> ''), ' ')"


def _fold(x: str) -> str:
    """Compatibility form and full case folding, for the characters that the tables hold."""
    return f"replace(replace(lower(nfc_normalize(translate({x}, '{_FULL}', '{_HALF}'))), 'ß', 'ss'), '…', '...')"


def _unseparated(x: str) -> str:
    """Without separators in numbers; x is a column."""
    c = lambda i, n=1: f"substring({x}, i{i:+d}, {n})" if i else f"substring({x}, i, {n})"
    digit = lambda i: f"regexp_full_match(CASE WHEN i{i:+d} < 1 THEN '' ELSE {c(i)} END, '\\d')"
    point = f"{c(0)} IN ('.', ',') AND {digit(1)}"
    blank = f"regexp_full_match({c(0)}, '{_WS}') AND regexp_full_match({c(1, 3)}, '\\d{{3}}') AND NOT {digit(4)}"
    return f"CASE WHEN regexp_matches({x}, '\\d[.,\\s]\\d') THEN array_to_string(list_transform(list_filter(range(1, length({x}) + 1), lambda i: NOT ({digit(-1)} AND ({point} OR {blank}))), lambda i: substring({x}, i, 1)), '') ELSE {x} END"


def _key(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(replace(lower({x}), 'ß', 'ss'), '\p{{P}}', ' ', 'g'), '{_WS}', ' ', 'g'))"


def _words(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({x}, '[^\p{{L}}\p{{M}}\p{{N}}'']+', ' ', 'g'), ' '), lambda w: trim(w, '''')), lambda w: w <> '')"


def _chars(x: str) -> str:
    return rf"regexp_replace({x}, '[^\p{{L}}\p{{M}}\p{{N}}]', '', 'g')"


def _listed(x: str) -> str:
    return f"list_transform(range(1, length({x}) + 1), lambda i: substring({x}, i, 1))"


def _distance(a: str, b: str) -> str:
    """Edit distance of two lists: each distinct member of the pair is one byte. Pairs have under 127 distinct ones here."""
    code = lambda xs: f"array_to_string(list_transform({xs}, lambda e: chr(list_position(list_distinct(list_concat({a}, {b})), e)::INT)), '')"
    return f"CASE WHEN len({a}) = 0 THEN len({b}) WHEN len({b}) = 0 THEN len({a}) ELSE levenshtein({code(a)}, {code(b)}) END"


_PAIRS = "pairs AS (SELECT DISTINCT run, audio, source, reference, hypothesis, seconds FROM transcript)"
# every pair's normalised texts, then words and characters, then distances
_SCORED = f"""{_PAIRS},
n0 AS MATERIALIZED (SELECT *, translate({_fold("reference")}, '’‘ʼ', '''''''') AS r0, translate({_fold("hypothesis")}, '’‘ʼ', '''''''') AS h0 FROM pairs WHERE reference IS NOT NULL AND hypothesis IS NOT NULL),
n1 AS MATERIALIZED (SELECT *, {_unseparated("r0")} AS r1, {_unseparated("h0")} AS h1 FROM n0),
n2 AS MATERIALIZED (SELECT *, {_words("r1")} AS rw, {_words("h1")} AS hw, {_chars("r1")} AS rs, {_chars("h1")} AS hs FROM n1),
n3 AS MATERIALIZED (SELECT *, {_listed("rs")} AS rc, {_listed("hs")} AS hc FROM n2),
scored AS MATERIALIZED (SELECT *, len(rw) AS words, len(rc) AS characters, len(hc) AS hypothesis_characters, {_distance("rw", "hw")} AS word_errors, {_distance("rc", "hc")} AS character_errors FROM n3)"""

_BARE = r"trim(regexp_replace(regexp_replace({x}, '[(（][^()（）\x{2E80}-\x{2EFF}\x{31C0}-\x{31EF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}]*[)）]', ' ', 'g'), '" + _WS + "', ' ', 'g'))"

_ERRORS = f"""{_SCORED},
g0 AS MATERIALIZED (SELECT *, translate({_fold(_BARE.replace("{x}", "reference"))}, '’‘ʼ', '''''''') AS b0 FROM scored WHERE source = 'cmn_hans_cn'),
g1 AS MATERIALIZED (SELECT *, {_unseparated("b0")} AS b1 FROM g0), g2 AS MATERIALIZED (SELECT *, {_chars("b1")} AS bs FROM g1), g3 AS MATERIALIZED (SELECT *, {_listed("bs")} AS bc FROM g2),
g AS MATERIALIZED (SELECT run, audio, reference, hypothesis, CASE WHEN len(bc) > 0 THEN ({_distance("bc", "hc")})::DOUBLE / len(bc) END AS bare FROM g3),
errors AS MATERIALIZED (SELECT s.run, s.audio, s.source, s.seconds, least(CASE WHEN by_character THEN CASE WHEN characters > 0 THEN character_errors::DOUBLE / characters END ELSE CASE WHEN words > 0 THEN word_errors::DOUBLE / words END END, bare) AS error
  FROM scored s JOIN {_SOURCES} USING (source) LEFT JOIN g ON g.run = s.run AND g.audio = s.audio AND g.reference = s.reference AND g.hypothesis = s.hypothesis)"""

_LATIN = r"lambda w: regexp_matches(w, '\p{L}') AND NOT regexp_matches(w, '[^\P{L}A-Za-z\x{C0}-\x{24F}\x{1E00}-\x{1EFF}]')"
_SHARED = "coalesce(list_sum(list_transform(list_distinct({a}), lambda w: least(len(list_filter({a}, lambda x: x = w)), len(list_filter({b}, lambda x: x = w))))), 0)"


def _tally(by: str) -> str:
    latin = f"t AS MATERIALIZED (SELECT *, list_filter(rw, {_LATIN}) AS rl, list_filter(hw, {_LATIN}) AS hl FROM scored), l AS MATERIALIZED (SELECT *, {_SHARED.replace('{a}', 'rl').replace('{b}', 'hl')} AS lm FROM t)"
    sums = ", ".join(f"sum({x})::BIGINT AS {n}" for x, n in (("character_errors", "character_errors"), ("characters", "characters"), ("word_errors", "word_errors"), ("words", "words"), ("len(rl)", "latin_in_references"), ("len(hl)", "latin_in_hypotheses"), ("lm", "latin_matched")))
    return f"WITH {_SCORED}, {latin}, tallies AS (SELECT {by}, {sums}, count(*) AS utterances, count(*) FILTER (2 * hypothesis_characters < characters) AS truncated FROM l GROUP BY {by}) "


_SUMMARY = f"""WITH {_ERRORS}, e AS (SELECT * FROM errors WHERE error IS NOT NULL),
summary AS (SELECT CASE WHEN grouping(source) = 1 THEN 'total' ELSE source END AS source, count(*) AS utterances, coalesce(sum(seconds), 0) / 3600 AS hours, count(*) FILTER (error <= 0.3) AS kept, 100.0 * count(*) FILTER (error <= 0.3) / count(*) AS kept_percent, coalesce(sum(seconds) FILTER (error <= 0.3), 0) / 3600 AS kept_hours, coalesce(median(error), 0) AS median_error FROM e GROUP BY GROUPING SETS ((source), ())) """

_FOUND = r"""w AS (SELECT pos, word, i FROM (SELECT pos, unnest(x) AS word, generate_subscripts(x, 1) - 1 AS i FROM (SELECT pos, regexp_extract_all(text, '[\x{0D80}-\x{0DFF}\x{200D}]+') AS x FROM {t}))),
counts AS (SELECT word, count(*) AS count, min(pos * 1000000 + i) AS first_pos FROM w GROUP BY word)"""
_COUNTS = "WITH " + _FOUND.replace("{t}", "utt_spk_text")
_VOCABULARY = _COUNTS + ", v AS (SELECT word, count, row_number() OVER (ORDER BY count DESC, first_pos) AS rank FROM counts WHERE count >= 3) "
_LISTS = "lists AS (SELECT regexp_extract(path, '([0-9]+)', 1)::BIGINT * 1000000 + line_no // 10 AS pos, string_agg(split_part(line, chr(9), 1), ' ' ORDER BY line_no) AS text FROM loanword_lines WHERE line IS NOT NULL GROUP BY 1), corpus AS (SELECT pos, text FROM utt_spk_text UNION ALL SELECT pos, text FROM lists)"
_JUDGED = (
    f"WITH {_LISTS}, "
    + _FOUND.replace("{t}", "corpus")
    + rf""", f0 AS (SELECT path, line_no, string_split(line, chr(9)) AS f FROM loanword_lines WHERE NOT regexp_full_match(line, '({_WS})?')), f AS (SELECT path, line_no, CASE WHEN len(f) = 3 THEN list_append(f, '') ELSE f END AS f FROM f0),
judged AS (SELECT path, line_no, f[1] AS word, f[2] AS category, f[3] AS english, f[4] AS suffix, c.count AS frequency, CASE WHEN len(f) <> 4 THEN 'expected 4 columns, got ' || len(f) WHEN f[2] NOT IN ('E', 'N', 'P') THEN 'unknown category' WHEN f[3] = '' THEN 'no English spelling' WHEN c.count IS NULL THEN 'not in the vocabulary' END AS problem FROM f LEFT JOIN counts c ON c.word = f[1]),
merged AS (SELECT word, category, english, suffix, frequency FROM judged WHERE problem IS NULL QUALIFY row_number() OVER (PARTITION BY word ORDER BY path, line_no) = 1) """
)
_LOANS = f"""loans AS (SELECT {_clean("f[1]")} AS word, f[2] AS category, f[3] AS english, trim(f[4], chr(8205) || chr(8204)) AS suffix, path, line_no FROM (SELECT path, line_no, string_split(line, chr(9)) AS f FROM loanword_lines WHERE line IS NOT NULL) WHERE len(f) = 4 AND f[2] = 'E' QUALIFY row_number() OVER (PARTITION BY {_clean("f[1]")} ORDER BY path DESC, line_no DESC) = 1)"""
_BY_SPEAKER = "b AS (SELECT speaker, count(*) AS utterances FROM utt_spk_text WHERE speaker IS NOT NULL GROUP BY speaker)"
_HASH_SPLIT = f"WITH {_BY_SPEAKER}, o AS (SELECT *, row_number() OVER (ORDER BY md5('52' || chr(9) || speaker), speaker) AS k FROM b), s AS (SELECT speaker, utterances, CASE WHEN k <= 6 THEN 'test' WHEN k <= 9 THEN 'dev' ELSE 'train' END AS split FROM o) "
_SAMPLE = "WITH k AS (SELECT DISTINCT file FROM replay WHERE source = 'librispeech'), d AS (SELECT file FROM k ORDER BY md5('52' || chr(9) || file), file LIMIT 40), s AS (SELECT file, (row_number() OVER (ORDER BY file) - 1) % 4 AS shard FROM d) "
_OWN = "'/corpora/' || source || '/data/' || substring(utterance, 1, 2) || '/' || utterance || '.flac'"
# of a speaker's rows the last holds
_MARKS = "m AS (SELECT speaker, split FROM (SELECT *, row_number() OVER () AS k FROM speaker_split) QUALIFY row_number() OVER (PARTITION BY speaker ORDER BY k DESC) = 1)"
# every word of every utterance, clean and as it is written; utterances with a word, what is written, and its key
_WRITTEN = f"""WITH {_LOANS}, {_MARKS}, said AS (SELECT pos, unnest(x) AS before, generate_subscripts(x, 1) AS i FROM (SELECT pos, string_split({_clean("text")}, ' ') AS x FROM utt_spk_text WHERE text IS NOT NULL)),
r AS MATERIALIZED (SELECT pos, i, before, coalesce(CASE WHEN suffix = '' THEN english WHEN suffix IN {_PARTICLES} THEN english || ' ' || suffix END, before) AS after FROM said LEFT JOIN loans ON loans.word = before WHERE before <> ''),
w AS (SELECT pos, string_agg(before, ' ' ORDER BY i) AS cleaned, string_agg(after, ' ' ORDER BY i) AS written FROM r GROUP BY pos),
keyed AS MATERIALIZED (SELECT pos, utterance, source, split, cleaned, written, {_key("written")} AS key, {_OWN} AS audio, 'language Sinhala<asr_text>' || written AS record FROM w JOIN utt_spk_text USING (pos) LEFT JOIN m USING (speaker)),
k AS (SELECT * FROM keyed WHERE split IS NOT NULL) """
_HELD = _WRITTEN + ", h AS MATERIALIZED (SELECT * FROM k WHERE split <> 'train' OR key NOT IN (SELECT key FROM k WHERE split <> 'train')), files AS (SELECT *, split AS file FROM h UNION ALL SELECT *, split || '_new' FROM h WHERE split <> 'train' AND key NOT IN (SELECT key FROM h WHERE split = 'train')) "

_LENGTHS = "n AS (SELECT doc_id // 128 AS step, doc_id AS \"at\", greatest(1, ceil(n_chars / 10))::BIGINT AS length FROM documents WHERE n_chars IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY length DESC, \"at\") AS k FROM n)"
_PACK = f"""WITH RECURSIVE {_LENGTHS}, p AS (SELECT step, "at", length, k, 0::BIGINT AS batch, 1::BIGINT AS rows, length AS longest FROM o WHERE k = 1
UNION ALL SELECT o.step, o."at", o.length, o.k, CASE WHEN (p.rows + 1) * p.longest > 4096 THEN p.batch + 1 ELSE p.batch END, CASE WHEN (p.rows + 1) * p.longest > 4096 THEN 1 ELSE p.rows + 1 END, CASE WHEN (p.rows + 1) * p.longest > 4096 THEN o.length ELSE p.longest END FROM p JOIN o ON o.step = p.step AND o.k = p.k + 1) """


def _audio_tokens(n: str) -> str:
    half = lambda x: f"(floor(({x} - 1) / 2)::BIGINT + 1)"
    return f"trunc((({half(half(half(f'({n} % 100)')))})::FLOAT + (({n})::FLOAT / 100::FLOAT)::FLOAT * 13::FLOAT)::FLOAT)::BIGINT"


_CHUNKS = f"""WITH c AS (SELECT doc_id // 8 AS batch, doc_id AS clip, n_chars AS frames FROM documents WHERE n_chars > 0), x AS (SELECT *, least(100, max(frames) OVER (PARTITION BY batch)) AS longest FROM c),
y AS (SELECT *, ((((longest - 1) // 2 + 1) - 1) // 2 + 1 - 1) // 2 + 1 AS most FROM x), z AS (SELECT batch, clip, most, frames, unnest(range(0, (frames - 1) // 100 + 1)) AS chunk FROM y),
q AS (SELECT *, least(100, frames - chunk * 100) AS length FROM z), chunks AS (SELECT batch, clip, chunk, least(most, {_audio_tokens("length")}) AS rows FROM q),
features AS (SELECT batch, clip, count(*) AS chunks, sum(rows)::BIGINT AS features FROM chunks GROUP BY ALL),
win AS (SELECT batch, clip, chunk // 8 AS win_no, sum(rows)::BIGINT AS rows FROM chunks GROUP BY ALL), windows AS (SELECT batch, clip, win_no, coalesce(sum(rows) OVER (PARTITION BY batch ORDER BY clip, win_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_row, rows FROM win) """

_VECTORS = "WITH v AS (SELECT a.vec_id, a.embedding, b.embedding AS other FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
_UNNESTED = ", u AS (SELECT vec_id, unnest(embedding) AS x, unnest(other) AS y, generate_subscripts(embedding, 1) - 1 AS \"at\" FROM v) "


def _stored(x: str, bits: int, least: int, up: bool) -> str:
    """The neighbour above or below among floats of so many bits after the first, by the quantum of the value's exponent."""
    quantum = f"pow(2, greatest(floor(log2(abs({x}::DOUBLE))), {least}) - {bits})"
    return f"(CASE WHEN {x} = 0 THEN 0 ELSE {'ceil' if up else 'floor'}({x}::DOUBLE / {quantum}) * {quantum} END)::FLOAT"


_QUANT = """WITH g AS (SELECT vec_id, p AS part, embedding[p * 32 + 1:p * 32 + 32] AS g FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding) // 32)) AS p FROM embeddings)), e AS (SELECT *, list_min(g) AS low, list_max(g) AS high FROM g),
b AS (SELECT *, abs(low) > abs(high) AS rising, CASE WHEN abs(low) > abs(high) THEN {low} ELSE {high} END AS bias FROM e), m AS (SELECT *, greatest((CASE WHEN rising THEN (high - bias)::FLOAT ELSE (bias - low)::FLOAT END / 255::FLOAT)::FLOAT, 1e-7::FLOAT) AS s FROM b),
q AS (SELECT *, CASE WHEN rising THEN {step} ELSE -{step} END AS scale FROM m), l AS (SELECT *, list_transform(g, lambda x: greatest(0, least(255, round_even(((x - bias)::FLOAT / scale)::FLOAT::DOUBLE, 0)))::BIGINT) AS v FROM q) """
_PACKED = "SELECT vec_id, part, round(scale::DOUBLE, 7) AS scale, round(bias::DOUBLE, 6) AS bias, array_to_string(list_transform(range(0, 8), lambda w: v[w * 4 + 1] + v[w * 4 + 2] * 256 + v[w * 4 + 3] * 65536 + v[w * 4 + 4] * 16777216), ',') AS words FROM l"
_WEIGHTS = "SELECT CASE WHEN vec_id % 3 = 0 THEN 'audio_tower.' ELSE 'model.' END || 'layers.' || vec_id || CASE vec_id % 4 WHEN 0 THEN '.scales' WHEN 1 THEN '.biases' ELSE '.weight' END AS key, len(embedding) AS n FROM embeddings"
_CODES = "WITH c AS (SELECT doc_id, n_chars, list_transform(regexp_extract_all(text, '(?s).'), lambda c: unicode(c) + 64) AS x FROM documents WHERE n_chars > 0)"
_GIT = "sha1(encode('blob ' || octet_length(encode(text))) || unhex('00') || encode(text))"

_Q = r'"([^"]|"")*"'
_CLOSED = rf'({_Q}|([^"\t][^\t]*)?)(\t({_Q}|([^"\t][^\t]*)?))*'
_SI = r"[\x{0D81}-\x{0D83}\x{0D85}-\x{0D96}\x{0D9A}-\x{0DB1}\x{0DB3}-\x{0DBB}\x{0DBD}\x{0DC0}-\x{0DC6}\x{0DCA}\x{0DCF}-\x{0DD4}\x{0DD6}\x{0DD8}-\x{0DDF}\x{0DF2}\x{0DF3}\x{200C}\x{200D}]"
_NUM, _POS = r"[0-9]+(\.[0-9]+)?", r"([0-9]*[1-9][0-9]*(\.[0-9]+)?|[0-9]+\.[0-9]*[1-9][0-9]*)"
_TEXT = r"[^\x00-\x08\x0a-\x1f\x7f-\x{9f}\x{fffd}\t\"]"
_GOOD_LABEL = "\\t".join((
    r'([^"\t][^\t]*\.(?i:wav|flac)|"([^"]|"")*\.(?i:wav|flac)")', rf'({_POS}|"{_POS}")', rf'({_NUM}|"{_NUM}")',
    r'(|[^"\t\x00-\x1f\x7f-\x{9f}\x{fffd}][^\t\x00-\x1f\x7f-\x{9f}\x{fffd}]*|"([^"\x00-\x08\x0a-\x1f\x7f-\x{9f}\x{fffd}]|"")*")',
))
_GOOD_LOAN = "\\t".join((rf'({_SI}+|"{_SI}+")', '([ENP]|"[ENP]")', r"""([A-Za-z][A-Za-z .''-]*|"[A-Za-z][A-Za-z .''-]*")""", rf'({_SI}*|"{_SI}*")'))


def _rejects(table: str, good: str, header: str) -> str:
    unquoted = rf"regexp_replace(line, '(^|\t){_Q}', '\1q', 'g')"
    return rf"""SELECT DISTINCT path, line_no, CASE WHEN NOT regexp_full_match(line, '{_CLOSED}', 's') THEN 'quotes' WHEN length({unquoted}) - length(replace({unquoted}, chr(9), '')) <> 3 THEN 'columns' ELSE 'value' END AS reason
FROM {table} WHERE line IS NOT NULL AND NOT regexp_full_match(line, '({_WS})?') AND NOT (line_no = 1 AND line = '{header}') AND NOT regexp_full_match(line, '{good}', 's')"""


def _epoch_order(epoch: int) -> str:
    """The order of an epoch by the sequential generator, swap by swap, for tables of test size."""
    wide, top = "::UHUGEINT", "18446744073709551616::UHUGEINT"
    times = lambda z, shift, factor: f"(xor({z}, {z} >> {shift}){wide} * {factor}{wide} % {top})::UBIGINT"
    return f"""WITH RECURSIVE t AS (SELECT count(*) AS n FROM train), a AS (SELECT i, ((52 + ({epoch} + i){wide} * {GAMMA}{wide}) % {top})::UBIGINT AS z FROM t, range(1, n) r(i)),
b AS (SELECT i, {times("z", SHIFTS[0], MIX[0])} AS z FROM a), c AS (SELECT i, {times("z", SHIFTS[1], MIX[1])} AS z FROM b),
d AS MATERIALIZED (SELECT i, n - i AS high, (xor(z, z >> {SHIFTS[2]}) % (n - i + 1)::UBIGINT)::BIGINT AS low FROM c, t),
o(i, x) AS (SELECT 0::BIGINT, range(n) FROM t UNION ALL SELECT d.i, CASE WHEN low = high THEN x ELSE list_concat(x[1:low], [x[high + 1]], x[low + 2:high], [x[low + 1]], x[high + 2:]) END FROM o JOIN d ON d.i = o.i + 1),
f AS (SELECT x FROM o ORDER BY i DESC LIMIT 1) """


def _rows(table: str, good: str, header: str, names: tuple[str, ...]) -> str:
    """The good lines' fields, quotes undone."""
    field = '("(?:[^"]|"")*"|[^"\\t][^\\t]*|)'
    raw = lambda i: f"regexp_extract(line, '^{field}\\t{field}\\t{field}\\t{field}$', {i}, 's')"
    bare = lambda i: f"CASE WHEN starts_with({raw(i)}, '\"') THEN replace(substring({raw(i)}, 2, length({raw(i)}) - 2), '\"\"', '\"') ELSE {raw(i)} END"
    own = ", ".join(f"({bare(i + 1)}){n[n.index('::'):] if '::' in n else ''} AS {n.split('::')[0]}" for i, n in enumerate(names))
    return f"SELECT DISTINCT path, line_no, {own} FROM {table} WHERE NOT (line_no = 1 AND line = '{header}') AND NOT regexp_full_match(line, '({_WS})?') AND regexp_full_match(line, '{good}', 's')"


def oracle_sql() -> dict[str, str]:
    t = {
        "utterance_scan": "SELECT pos, coalesce(utterance, '') AS utterance, coalesce(speaker, '') AS speaker, coalesce(text, '') AS text FROM utt_spk_text",
        "speaker_split_scan": "SELECT split, NULL::VARCHAR AS problem, count(*) AS rows FROM speaker_split GROUP BY split",
        "loanword_scan": f"WITH f AS (SELECT path, line_no AS pos, string_split(line, chr(9)) AS f FROM loanword_lines WHERE line IS NOT NULL AND NOT regexp_full_match(line, '({_WS})?')), p AS (SELECT *, CASE WHEN len(f) <> 4 THEN 'expected 4 columns' WHEN f[2] NOT IN ('E', 'N', 'P') THEN 'unknown category' END AS problem FROM f) SELECT path, pos, {_clean('f[1]')} AS word, f[2] AS category, f[3] AS english, trim(f[4], chr(8205) || chr(8204)) AS suffix, problem FROM p WHERE problem IS NOT NULL OR f[2] = 'E'",
        "replay_scan": "SELECT CASE WHEN source IS NULL OR source NOT IN ('en_us', 'cmn_hans_cn', 'es_419', 'fr_fr', 'de_de', 'librispeech') THEN 'unknown source' WHEN error IS NULL OR NOT isfinite(error) OR error < 0 THEN 'not an error' ELSE 'none' END AS problem, count(*) AS rows FROM replay GROUP BY 1",
        "record_parse": "SELECT pos, audio, nullif(regexp_extract(text, '^language (.*?)<asr_text>', 1), '') AS language, CASE WHEN strpos(text, '<asr_text>') > 0 THEN substring(text, strpos(text, '<asr_text>') + 10) ELSE text END AS transcript, coalesce(contains(text, '<asr_text>'), false) AS marked FROM train",
        "multi_file_union": "SELECT source, 2 * count(*) AS records, count(DISTINCT audio) AS audios FROM train GROUP BY source",
        "recording_listing": r"SELECT lower(regexp_extract(file, '\.([^.]+)$', 1)) AS extension, count(DISTINCT file) AS files FROM replay WHERE regexp_matches(lower(file), '\.(wav|flac)$') GROUP BY 1",
        "vocabulary": _VOCABULARY + "SELECT word, count, rank FROM v",
        "vocab_chunks": _VOCABULARY + "SELECT (rank - 1) // 3000 AS chunk, count(*) AS words, sum(count)::BIGINT AS tokens, min(rank) AS first_rank FROM v GROUP BY 1",
        "vocabulary_coverage": _COUNTS + " SELECT coalesce(sum(count), 0)::BIGINT AS tokens, count(*) AS distinct_words, count(*) FILTER (count >= 3) AS frequent_words, 100.0 * coalesce(sum(count) FILTER (count >= 3), 0) / greatest(1, coalesce(sum(count), 0)) AS percent FROM counts",
        "loanword_problems": _JUDGED + "SELECT path, line_no, problem FROM judged WHERE problem IS NOT NULL",
        "loanword_merge": _JUDGED + "SELECT * FROM merged",
        "loanword_shares": _JUDGED + "SELECT category, count(*) AS words, 100.0 * sum(frequency) / (SELECT greatest(1, sum(count)) FROM counts) AS percent FROM merged GROUP BY category",
        "word_rewrite": _WRITTEN + "SELECT pos, written AS rewritten FROM w WHERE cleaned <> written",
        "rewrite_counts": _WRITTEN + "SELECT before, after, count(*) AS times FROM r WHERE before <> after GROUP BY ALL",
        "speaker_counts": f"WITH {_BY_SPEAKER} SELECT * FROM b",
        "speaker_split_hash": _HASH_SPLIT + "SELECT * FROM s",
        "speaker_split_sizes": _HASH_SPLIT + "SELECT split, count(*) AS speakers, sum(utterances)::BIGINT AS utterances FROM s GROUP BY split",
        "split_last_wins": "SELECT utterance, speaker, text FROM utt_spk_text QUALIFY row_number() OVER (PARTITION BY utterance ORDER BY pos DESC) = 1",
        "sample_sharded": _SAMPLE + "SELECT * FROM s",
        "sample_speakers": _SAMPLE + "SELECT shard, count(*) AS files, count(DISTINCT split_part(file, '-', 1)) AS speakers FROM s GROUP BY shard",
        "sentence_keys": _WRITTEN + "SELECT pos, key FROM keyed",
        "new_sentences": _WRITTEN + "SELECT utterance, split || '_new' AS split FROM k WHERE split <> 'train' AND key NOT IN (SELECT key FROM k WHERE split = 'train')",
        "hold_out": _HELD + "SELECT utterance, split FROM h",
        "new_after_hold_out": _HELD + "SELECT file AS split, count(*) AS rows FROM files WHERE file LIKE '%new' GROUP BY file",
        "split_counters": _WRITTEN + f", c AS (SELECT coalesce(m.split, 'none') AS split, key, coalesce(cleaned <> written, false) AS rewritten, NOT coalesce({_OWN.replace('source', 'u.source').replace('utterance', 'u.utterance')} IN (SELECT audio FROM train WHERE audio IS NOT NULL), false) AS missing FROM utt_spk_text u LEFT JOIN m USING (speaker) LEFT JOIN keyed USING (pos)) SELECT split, count(*) AS rows, count(*) FILTER (key IS NULL) AS empty, count(*) FILTER (key IS NOT NULL) AS written, count(*) FILTER (rewritten) AS rewritten, count(*) FILTER (split = 'train' AND key IN (SELECT key FROM c WHERE split NOT IN ('none', 'train') AND key IS NOT NULL)) AS held_out, count(*) FILTER (missing) AS missing_audio FROM c GROUP BY split",
        "missing_speakers": "SELECT DISTINCT speaker FROM utt_spk_text WHERE speaker IS NOT NULL AND speaker NOT IN (SELECT speaker FROM speaker_split WHERE speaker IS NOT NULL)",
        "clean_text": f"SELECT pos, {_clean('text')} AS cleaned FROM utt_spk_text WHERE text IS NOT NULL",
        "record_paths": _WRITTEN + "SELECT pos, audio, record FROM keyed WHERE source IS NOT NULL",
        "replay_paths": f"SELECT DISTINCT source, file, language, CASE WHEN corpus = 'librispeech' THEN split_part(file, '-', 1) || '/' || split_part(file, '-', 2) || '/' || file ELSE source || '/audio/' || file END AS path FROM replay JOIN {_SOURCES} USING (source)",
        "audio_present": f"SELECT source, count(*) AS rows FROM utt_spk_text WHERE {_OWN} IN (SELECT audio FROM train) GROUP BY source",
        "label_errors": f"WITH {_ERRORS} SELECT run, audio, source, round(error, 9) AS error FROM errors",
        "word_errors": f"WITH {_SCORED} SELECT run, audio, words, characters, word_errors, character_errors FROM scored",
        "error_tally": _tally("run, source") + "SELECT * FROM tallies",
        "error_rates": _tally("source") + "SELECT source, CASE WHEN characters > 0 THEN character_errors / characters ELSE 0 END AS cer, CASE WHEN words > 0 THEN word_errors / words ELSE 0 END AS wer, CASE WHEN latin_in_references > 0 THEN latin_matched / latin_in_references END AS latin_recall, CASE WHEN latin_in_hypotheses > 0 THEN latin_matched / latin_in_hypotheses END AS latin_precision FROM tallies",
        "stale_tallies": _tally("run, source") + "SELECT DISTINCT e.run, e.source, e.truncated, t.truncated AS counted FROM error_tally e JOIN tallies t ON t.run = e.run AND t.source = e.source WHERE e.truncated IS DISTINCT FROM t.truncated",
        "language_report": "WITH r AS (SELECT DISTINCT run, audio, expected_language, language, seconds, milliseconds FROM transcript), m AS (SELECT run, milliseconds, row_number() OVER (PARTITION BY run ORDER BY milliseconds) AS k, count(*) OVER (PARTITION BY run) AS n FROM r WHERE milliseconds IS NOT NULL) SELECT run, count(*) AS utterances, count(*) FILTER (expected_language = language) AS matches, count(*) FILTER (expected_language = language) / count(*) AS accuracy, coalesce(sum(seconds) / (sum(milliseconds) / 1000), 0) AS real_time_factor, (SELECT milliseconds FROM m WHERE m.run = r.run AND k = n // 2 + 1) AS median_ms FROM r GROUP BY run",
        "languages": "SELECT coalesce(language, 'none') AS language, count(*) AS utterances FROM (SELECT DISTINCT run, audio, language FROM transcript) GROUP BY 1",
        "replay_summary": _SUMMARY + "SELECT * FROM summary",
        "replay_summary_lines": _SUMMARY + "SELECT source, printf('%-12s %10d %6.1f %6d %6.1f%% %7.1f %7.3f', source, utterances, hours, kept, kept_percent, kept_hours, median_error) AS line FROM summary",
        "replay_cut": f"WITH r AS (SELECT DISTINCT source, file, error, label FROM replay) SELECT source, ord, count(*) AS records, count(*) FILTER (error >= 0 AND isfinite(error) AND printf('%.3f', error)::DOUBLE <= 0.3) AS kept FROM r JOIN {_SOURCES} USING (source) GROUP BY source, ord",
        "gloss_free": "SELECT DISTINCT file, " + _BARE.replace("{x}", "label") + " AS bare FROM replay WHERE source = 'cmn_hans_cn' AND label IS NOT NULL",
        "flat_hypotheses": rf"WITH {_PAIRS} SELECT run, audio, trim(regexp_replace(hypothesis, '[\t\n\x0B\f\r\x{{85}}\x{{2028}}\x{{2029}}]', ' ', 'g')) AS line FROM pairs WHERE hypothesis IS NOT NULL",
        "shared_words": f"WITH {_SCORED} SELECT run, audio, " + _SHARED.replace("{a}", "rw").replace("{b}", "hw") + " AS shared FROM scored",
        "epoch_steps": "SELECT (o_orderkey // 128) // 7 AS epoch, (o_orderkey // 128) % 7 AS step, count(*) AS records FROM orders GROUP BY ALL",
        "token_budget_pack": _PACK + 'SELECT step, "at", length, batch FROM p',
        "step_totals": _PACK + ", b AS (SELECT step, batch, count(*) * max(length) AS padded, sum(length) AS tokens FROM p GROUP BY ALL) SELECT step, count(*) AS micro_batches, sum(padded)::BIGINT AS padded_tokens, sum(tokens)::BIGINT AS tokens FROM b GROUP BY step",
        "pad_layout": _CODES + ", l AS (SELECT *, max(len(x)) OVER (PARTITION BY doc_id // 16) AS length FROM c) SELECT doc_id, length, array_to_string(list_concat(x, list_transform(range(0, length - len(x)), lambda i: 0)), ',') AS inputs FROM l",
        "prompt_targets": _CODES + f", n AS (SELECT *, {_audio_tokens('n_chars')} AS n FROM c) SELECT doc_id, unnest(range(n + 3, n + 4 + len(x))) AS place, unnest(list_append(x, 9)) AS id FROM n",
        "audio_tokens": f"WITH r AS (SELECT DISTINCT run, audio, floor(seconds * 100)::INT AS frames FROM transcript WHERE seconds > 0) SELECT run, audio, {_audio_tokens('frames')} AS tokens, floor((frames - 1) / 2)::BIGINT + 1 AS convolved FROM r",
        "clip_features": _CHUNKS + "SELECT * FROM features",
        "chunk_windows": _CHUNKS + 'SELECT batch, clip, win_no AS "window", first_row, rows FROM windows',
        "window_cells": _CHUNKS + ", l AS (SELECT *, max(rows) OVER (PARTITION BY batch) AS longest FROM windows), cells AS (SELECT batch, rows, first_row, unnest(range(0, longest)) AS place FROM l) SELECT batch, place >= rows AS masked, count(*) AS cells, sum(CASE WHEN place < rows THEN first_row + place ELSE 0 END)::BIGINT AS rows FROM cells GROUP BY ALL",
        "audio_offsets": _CHUNKS + "SELECT batch, clip, coalesce(sum(features) OVER (PARTITION BY batch ORDER BY clip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_feature FROM features",
        "lr_schedule": "SELECT i AS id, round(CASE WHEN i < 32 THEN 1e-5 * i / 32.0::DOUBLE ELSE 1e-5 * greatest(0, (1578 - i) / (1578 - 32)::DOUBLE) END, 12) AS rate FROM range(1578) t(i)",
        "eval_steps": "SELECT DISTINCT e * 1816 + p * 1816 // 4 AS step FROM range(2) a(e), range(1, 5) b(p)",
        "checkpoint_retention": "WITH s AS (SELECT run, floor(milliseconds)::BIGINT AS step, count(*) AS rows FROM transcript WHERE milliseconds IS NOT NULL GROUP BY ALL) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY run ORDER BY step DESC) <= 3",
        "settings_diff": "WITH o AS (SELECT name, val FROM run_settings), n AS (SELECT name, CASE WHEN name = 'token_budget' THEN '3072' ELSE val END AS val FROM o WHERE name NOT IN ('min_count', 'seed') UNION ALL VALUES ('epochs', '2'), ('seed', '53')) SELECT coalesce(o.name, n.name) AS name, o.val AS old, n.val AS new FROM o FULL JOIN n ON o.name = n.name WHERE o.val IS DISTINCT FROM n.val AND coalesce(o.name, n.name) <> 'seed'",
        "manifest_verify": "SELECT CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN doc_id % 11 = 0 THEN 'size' WHEN doc_id % 7 = 0 THEN 'hash' ELSE 'good' END AS state, count(*) AS files FROM documents WHERE text IS NOT NULL GROUP BY 1",
        "file_digests": f"SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, {_GIT} AS git FROM documents WHERE text IS NOT NULL",
        "ordered_digest": "SELECT source, sha256(string_agg(coalesce(audio, '') || chr(9) || coalesce(text, '') || chr(10), '' ORDER BY pos)) AS digest, count(*) AS records FROM train WHERE source IS NOT NULL GROUP BY source",
        "duplicate_labels": "SELECT file, count(*) AS times FROM replay WHERE file IS NOT NULL GROUP BY file HAVING count(*) > 1",
        "data_quality": "SELECT reason, count(*) AS rows FROM (SELECT CASE WHEN source IS NULL THEN 'no source' WHEN source NOT IN ('en_us', 'cmn_hans_cn', 'es_419', 'fr_fr', 'de_de', 'librispeech') THEN 'unknown source' WHEN error IS NULL THEN 'no error' WHEN NOT isfinite(error) THEN 'not finite' WHEN error < 0 THEN 'negative' WHEN coalesce(label, '') = '' THEN 'no label' END AS reason FROM replay) WHERE reason IS NOT NULL GROUP BY reason",
        "incremental_unlabelled": "WITH n AS (SELECT count(DISTINCT run) AS n FROM transcript), f AS (SELECT audio AS file, list_sort(list(DISTINCT run)) AS sets FROM transcript WHERE audio IS NOT NULL AND run IS NOT NULL GROUP BY audio) SELECT file, array_to_string(sets, ',') AS labelled, n - len(sets) AS missing FROM f, n WHERE len(sets) < n",
        "supported_languages": "SELECT language, count(*) AS rows FROM transcript WHERE language NOT IN ('English', 'Chinese', 'Spanish', 'French', 'German', 'Sinhala') GROUP BY language",
        "safe_members": "SELECT split_part(audio, '/', 3) AS folder, count(*) AS members FROM train WHERE pos % 17 <> 0 AND audio LIKE '/corpora/%' AND NOT list_contains(string_split(audio, '/'), '..') GROUP BY 1",
        "manifest_wanted": "SELECT doc_id::VARCHAR AS path, octet_length(encode(text)) AS size, CASE WHEN octet_length(encode(text)) > 2000 THEN 'sha256' WHEN text IS NOT NULL THEN 'git' END AS kind, CASE WHEN octet_length(encode(text)) > 2000 THEN sha256(text) ELSE md5(text) END AS expected FROM documents",
        "reference_mismatch": f"WITH l AS (SELECT DISTINCT source, file, corpus FROM replay JOIN {_SOURCES} USING (source)), t AS (SELECT DISTINCT source, string_split(audio, '/')[-1] AS file, corpus FROM train JOIN {_SOURCES} USING (source)) SELECT source, 'no reference' AS problem, count(*) AS files FROM (FROM l EXCEPT FROM t) GROUP BY source UNION ALL SELECT source, 'no label', count(*) FROM (FROM t WHERE corpus = 'fleurs' EXCEPT FROM l) GROUP BY source",
        "tolerance_gates": _tally("run") + """, theirs AS (SELECT run, sum(utterances) AS u, sum(character_errors) AS e FROM (SELECT DISTINCT * FROM error_tally) GROUP BY run),
a AS (SELECT run, string_split(reference, ' ') AS a, string_split(hypothesis, ' ') AS b FROM pairs WHERE reference IS NOT NULL AND hypothesis IS NOT NULL), g AS (SELECT run, avg(round(len(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda k: a[k] IS NOT DISTINCT FROM b[k])) / greatest(len(a), len(b)), 9)) AS agreement FROM a GROUP BY run)
SELECT run, utterances = u AS same_count, abs(character_errors - e) <= 0.01 * greatest(character_errors, e) AS close, agreement > 0.97 AS agrees, 1 - character_errors / greatest(characters, 1) > 0.98 AS similar, character_errors / greatest(characters, 1) <= 0.05 AS learnt FROM tallies JOIN theirs USING (run) JOIN g USING (run)""",
        "table_invariants": rf"WITH f AS (SELECT path, line_no AS pos, string_split(line, chr(9)) AS f FROM loanword_lines WHERE NOT regexp_full_match(line, '({_WS})?')), w AS (SELECT path, pos, f[1] AS word, f[3] AS english, f[4] AS suffix, count(*) OVER (PARTITION BY f[1]) AS times, lag(f[1]) OVER (PARTITION BY path ORDER BY pos) AS before FROM f WHERE len(f) = 4 AND f[2] IN ('E', 'N', 'P')), p AS (SELECT path, pos, CASE WHEN nfc_normalize(word) <> word THEN 'word not composed' WHEN NOT regexp_full_match(word, '[\x{{0D80}}-\x{{0DFF}}\x{{200C}}\x{{200D}}]+') THEN 'word of other letters' WHEN NOT regexp_full_match(english, '[A-Za-z][A-Za-z -]*') THEN 'english of other letters' WHEN NOT suffix(word, suffix) OR word = suffix THEN 'suffix isn''t the word''s ending' WHEN times > 1 THEN 'listed more than once' WHEN before > word THEN 'out of order' END AS reason FROM w) SELECT * FROM p WHERE reason IS NOT NULL",
        "first_records": "SELECT pos, audio FROM train ORDER BY pos LIMIT 100",
        "language_lists": "WITH l AS (SELECT run, list_sort(list_distinct(list(language))) AS x FROM transcript WHERE language IS NOT NULL GROUP BY run), j AS (SELECT run, x, '\"' || array_to_string(x, '\",\"') || '\"' AS y FROM l) SELECT run, '{\"model_type\":\"asr\",\"support_languages\":[' || y || CASE WHEN list_contains(x, 'Sinhala') THEN '' WHEN len(x) > 1 THEN ',\"Sinhala\"' ELSE ', \"Sinhala\"' END || '],\"layers\":2}' AS config FROM j",
        "tensor_blend": _VECTORS + _UNNESTED + "SELECT vec_id, \"at\", round(((x * 0.25::FLOAT)::FLOAT + (y * 0.75::FLOAT)::FLOAT)::DOUBLE, 4) AS x FROM u",
        "tensor_norm": "WITH n AS (SELECT sqrt(sum(x::DOUBLE * x::DOUBLE)) AS norm FROM (SELECT unnest(embedding) AS x FROM embeddings)) SELECT round(norm, 6) AS norm, round(least(1.0, 1.0 / (norm + 1e-6)), 9) AS scale FROM n",
        "tensor_cosine": _VECTORS + _UNNESTED + "SELECT vec_id, round(sum(x::DOUBLE * y) / sqrt(sum(x::DOUBLE * x) * sum(y::DOUBLE * y)), 9) AS cosine, round(sqrt(sum(x::DOUBLE * x) / sum(y::DOUBLE * y)), 9) AS ratio FROM u GROUP BY vec_id",
        "tensor_sums": "SELECT label, \"at\", round(sum(x::DOUBLE), 6) AS value FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS \"at\" FROM embeddings WHERE label IS NOT NULL) GROUP BY ALL",
        "tensor_quantise": _QUANT.replace("{low}", "low").replace("{high}", "high").replace("{step}", "s") + _PACKED,
        "tensor_dequantise": _QUANT.replace("{low}", "low").replace("{high}", "high").replace("{step}", "s") + 'SELECT vec_id, part * 32 + i AS "at", round(((v[i + 1]::FLOAT * scale)::FLOAT + bias)::FLOAT::DOUBLE, 5) AS x FROM (SELECT *, unnest(range(0, 32)) AS i FROM l)',
        "adam_update": _VECTORS + _UNNESTED + ", m AS (SELECT vec_id, \"at\", x, (0.1::FLOAT * y)::FLOAT AS m, ((0.001::FLOAT * y)::FLOAT * y)::FLOAT AS v FROM u) SELECT vec_id, \"at\", round((x - ((0.01::FLOAT * m)::FLOAT / (sqrt(v::DOUBLE) / 0.03162277660168379::FLOAT::DOUBLE + 1e-8::FLOAT::DOUBLE))::FLOAT)::DOUBLE, 4) AS x FROM m",
        "sequence_agreement": f"WITH {_PAIRS}, w AS (SELECT run, audio, string_split(reference, ' ') AS a, string_split(hypothesis, ' ') AS b FROM pairs WHERE reference IS NOT NULL AND hypothesis IS NOT NULL), i AS (SELECT *, greatest(len(a), len(b)) AS n, list_filter(range(1, greatest(len(a), len(b)) + 1), lambda k: a[k] IS DISTINCT FROM b[k]) AS off FROM w) SELECT run, audio, off[1] - 1 AS first_mismatch, round((n - len(off)) / n, 9) AS share FROM i",
        "loss_parts": "WITH r AS (SELECT DISTINCT run, audio, milliseconds / 1000 AS loss, len(string_split(reference, ' ')) AS targets, coalesce(expected_language = 'Sinhala', false) AS is_new FROM transcript WHERE milliseconds IS NOT NULL AND reference IS NOT NULL), p AS (SELECT 'all' AS part, * FROM r UNION ALL SELECT CASE WHEN is_new THEN 'new' ELSE 'replay' END, * FROM r) SELECT part, round(sum(loss), 6) AS total, sum(targets)::BIGINT AS targets, round(sum(loss) / sum(targets), 9) AS mean FROM p GROUP BY part",
        "bench_totals": "WITH r AS (SELECT DISTINCT run, audio, milliseconds FROM transcript WHERE milliseconds IS NOT NULL) SELECT run, round(sum(milliseconds) / 1000, 6) AS seconds, round(count(*) / (sum(milliseconds) / 1000), 9) AS utterances_a_second, round(sum(milliseconds) / 1000 / count(*) * 232390 / 3600, 6) AS epoch_hours FROM r GROUP BY run",
        "export_totals": "SELECT 2 * sum(len(embedding))::BIGINT AS bytes, sum(len(embedding))::BIGINT AS parameters, count(*) AS arrays FROM embeddings",
        "weight_keys": "SELECT vec_id AS key, CASE WHEN vec_id % 5 = 0 THEN 'only in the first' ELSE 'another size' END AS problem FROM embeddings WHERE vec_id % 5 = 0 OR vec_id % 7 = 0 UNION ALL SELECT -1, 'only in the second'",
        "training_files": _HELD + "SELECT file, pos, audio, record FROM files",
        "token_lengths": "SELECT doc_id, octet_length(encode(text)) AS tokens, coalesce(list_sum(list_transform(string_split(trim(regexp_replace(hex(encode(text)), '(..)', '\\1 ', 'g')), ' '), lambda h: CASE WHEN h = '' THEN 0 ELSE ('0x' || h)::INT + 3 END)), 0)::BIGINT AS sum FROM documents WHERE text IS NOT NULL",
        "audio_places": f"WITH n AS (SELECT doc_id, {_audio_tokens('n_chars')} AS n FROM documents WHERE n_chars > 0) SELECT doc_id, n, CASE WHEN n > 0 THEN 2 END AS first, CASE WHEN n > 0 THEN n + 1 END AS last FROM n",
        "needed_corpora": f"SELECT corpus, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM {_SOURCES} WHERE source IN (SELECT source FROM replay) AND corpus <> 'fleurs' GROUP BY corpus",
        "sample_layout": _SAMPLE + ", t AS (SELECT string_split(audio, '/')[-1] AS file, min(audio) AS target FROM train WHERE source = 'librispeech' AND audio IS NOT NULL GROUP BY 1) SELECT shard, file, '/out/' || (shard + 1) || '/' || file AS path, target, CASE WHEN target IS NULL THEN 'no recording' END AS problem FROM s LEFT JOIN t USING (file)",
        "error_sentences": _tally("run") + "SELECT run, concat_ws(', ', utterances || printf(' utterances, CER %.2f %%, WER %.2f %%', 100.0 * character_errors / greatest(characters, 1), 100.0 * word_errors / greatest(words, 1)), CASE WHEN latin_in_references > 0 THEN 'Latin words ' || latin_matched || ' of ' || latin_in_references END, CASE WHEN truncated > 0 THEN truncated || ' under half as long' END) AS line FROM tallies",
        "evaluation_records": f"SELECT 'fleurs_' || short || '_test' AS name, source, '/corpora/' || source || '/audio/test/' || file AS audio, 'language ' || language || '<asr_text>' || CASE WHEN glossed THEN {_BARE.replace('{x}', 'label')} ELSE label END AS record FROM (SELECT DISTINCT source, file, label FROM replay WHERE label IS NOT NULL) JOIN {_SOURCES} USING (source) JOIN (VALUES ('en_us', 'en'), ('cmn_hans_cn', 'zh'), ('es_419', 'es'), ('fr_fr', 'fr'), ('de_de', 'de')) AS n(source, short) USING (source)",
        "epoch_order": _epoch_order(1) + "SELECT unnest(range(len(x))) AS place, unnest(x) AS record FROM f",
        "epoch_sample": _epoch_order(0) + "SELECT unnest(x[1:20]) AS record FROM f",
        "epoch_order_hash": "SELECT pos, row_number() OVER (ORDER BY md5('52' || chr(9) || '1' || chr(9) || pos), pos) - 1 AS place FROM train",
        "tensor_blend_shares": _VECTORS + _UNNESTED + "SELECT vec_id, \"at\", round(((x * ((vec_id % 5) / 4)::FLOAT)::FLOAT + (y * (1 - (vec_id % 5) / 4)::FLOAT)::FLOAT)::DOUBLE, 4) AS x FROM u",
        "tensor_quantise_half": _QUANT.replace("{low}", _stored("low", 7, -126, False)).replace("{high}", _stored("high", 7, -126, True)).replace("{step}", _stored("s", 7, -126, True)) + _PACKED,
        "rounded_half_width": "SELECT vec_id, i - 1 AS \"at\", " + ", ".join(f"{_stored('x', b, e, up)}::DOUBLE AS {n}_{'up' if up else 'down'}" for n, b, e in (("bf", 7, -126), ("fp", 10, -14)) for up in (False, True)) + " FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)",
        "weight_selection": f"SELECT key, n FROM ({_WEIGHTS}) WHERE key LIKE 'audio_tower.%' AND key LIKE '%.weight'",
        "weight_files": f"SELECT key, 'model.safetensors' AS file, coalesce(sum(2 * n) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_byte, 2 * n AS bytes FROM ({_WEIGHTS})",
        "p5_labels": _rows("label_lines", _GOOD_LABEL, "file\tseconds\tms\ttext", ("file", "seconds::DOUBLE", "ms::DOUBLE", "text")),
        "p5_loanwords": _rows("loanword_lines", _GOOD_LOAN, "-", ("word", "category", "english", "suffix")),
        "p5_found": _rejects("label_lines", _GOOD_LABEL, "file\tseconds\tms\ttext") + " UNION " + _rejects("loanword_lines", _GOOD_LOAN, "-"),
    }
    return t
