"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import (
    adaptive_rules,
    decontamination,
    fingerprints,
    license_scan,
    mixing,
    near_dup,
    periodic_runs,
    pieces,
    pseudonyms,
    quality_gam,
    spelling,
    substring_dedup,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each document; one fold of the labels is held out."""
    docs = _documents(spark, sf_dir)
    held_out = quality_gam.folds(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, _labels(spark, sf_dir), ~held_out)
    scored = toxicity.with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and its edited text, and their likeness."""
    return fingerprints.compare_edited(_documents(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes of each document."""
    found = mixing.expected_copies(_documents(spark, sf_dir))
    return found.selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken", "copies")


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document; one fold of the labels is held out."""
    docs = _documents(spark, sf_dir)
    held_out = quality_gam.folds(F.col("doc_id"), 3) == 1
    model = quality_gam.train(docs, _labels(spark, sf_dir), "quality", ~held_out)
    scored = quality_gam.with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of each document."""
    found = license_scan.scan(_documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.begin").cast("long").alias("first_word"), F.array_max("base.begin").cast("long").alias("last_word"),
        "base_labels", "labels", "score", F.size("detections").cast("long").alias("n_detections"),
    )


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of each document."""
    return near_dup.near_duplicates(_documents(spark, sf_dir))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece pieces of each document, decoded again."""
    return pieces.round_trip(_documents(spark, sf_dir))


def op8_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdict of each document."""
    return adaptive_rules.judge(_documents(spark, sf_dir)).selectExpr(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "array_join(reasons, ',') AS reasons",
    )


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text with pseudonyms, and what was found in it."""
    return pseudonyms.with_findings(_documents(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after repeats of 35 words or more are removed."""
    found = substring_dedup.remove_repeats(_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with their form, root and number of words one edit away; one letter of some words is deleted first."""
    return spelling.group_variants(spelling.count_words(_documents(spark, sf_dir), typo_every=97))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that stand in a window of a benchmark item."""
    found = decontamination.find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of each document; the tail of one in ten repeats."""
    return periodic_runs.digest(periodic_runs.find_runs(periodic_runs.plant(_documents(spark, sf_dir))))


_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

_CLASS = "greatest(length(bin({0})) - 6, 0) * 32 + floor({0} / pow(2.0, greatest(length(bin({0})) - 6, 0)))::INT"

OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, 'null') AS src, len({_WORDS}) AS size FROM documents
),
weighted AS (
  SELECT src, source_size, 3 * source_size AS cap,
    [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY src) - 1) % 3 + 1] AS weight
  FROM (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src)
),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM weighted) - coalesce(sum(cap) OVER before, 0))::DOUBLE
      / ((SELECT sum(weight) FROM weighted) - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighted WINDOW before AS (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
targets AS (
  SELECT src, source_size, least(cap::DOUBLE, weight * (SELECT max(level) FROM levels WHERE level * weight <= cap)) AS target
  FROM weighted
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY class, digest, size, doc_id NULLS LAST) AS place
  FROM (SELECT *, {_CLASS.format("size")} AS class, md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS digest FROM d)
),
spread AS (
  SELECT doc_id, size, source_size, target, place,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS each_one,
    ('0x' || substr(md5('mix-1:offset:' || src), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
  FROM placed JOIN targets USING (src)
),
taken AS (
  SELECT *, least((floor(place * each_one + shift) - floor((place - 1) * each_one + shift))::BIGINT, 3) AS copies FROM spread
)
SELECT doc_id, size::BIGINT AS size, source_size, target, size * copies AS taken, copies FROM taken
"""

_VALUES = {
    "symbol_share": (1_000_000, "n_symbols", "word_chars"),
    "line_share": (1_000_000, "n_dup_lines", "n_lines"),
    "repeat_share": (1_000_000, "n_repeat_words", "n_words"),
    "word_length": (1_000, "word_chars", "n_words"),
}
_SHARES = ", ".join(
    f"CASE WHEN {whole} > 0 THEN {part} * {unit} // {whole} ELSE 0 END AS {name}" for name, (unit, part, whole) in _VALUES.items()
)
_MARGINS = " ".join(f"WHEN '{m}' THEN {v}" for m, v in adaptive_rules.MARGINS.items())
_PICK = (
    "CASE WHEN own.n >= {0} THEN own.{1} WHEN by_lang.n >= {0} THEN by_lang.{1} ELSE every.{1} END"
)
_VALUE_OF = "((q{0} - greatest((q{0} - 32) // 32, 0) * 32) * pow(2.0, greatest((q{0} - 32) // 32, 0)))::BIGINT"


def _quartiles(name: str, keys: str) -> str:
    group = f"{keys}measure"
    return f"""
{name} AS (
  SELECT {group}, max(n) AS n, min(class) FILTER (upto * 4 >= n) AS q1, min(class) FILTER (upto * 4 >= 3 * n) AS q3
  FROM (
    SELECT {group}, class, sum(count(*)) OVER (PARTITION BY {group} ORDER BY class) AS upto,
      sum(count(*)) OVER (PARTITION BY {group}) AS n
    FROM classed GROUP BY {group}, class
  ) GROUP BY {group}
)"""


OP8_SQL = f"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, 'null') AS lang, coalesce('=' || source, 'null') AS source,
    coalesce(text, '') AS text, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
),
windows AS (
  SELECT r, p, array_to_string(w[p:p + 7], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS p FROM w)
),
repeated AS (
  SELECT r, count(DISTINCT i) AS n_repeat_words FROM (
    SELECT r, unnest(range(p, p + 8)) AS i FROM windows SEMI JOIN (
      SELECT r, s FROM windows GROUP BY r, s HAVING count(*) >= 2) USING (r, s)
  ) GROUP BY r
),
counted AS (
  SELECT r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN repeated USING (r)
),
m AS (SELECT *, {_SHARES} FROM counted),
long AS (UNPIVOT (SELECT r, lang, source, {", ".join(_VALUES)} FROM m) ON {", ".join(_VALUES)} INTO NAME measure VALUE v),
classed AS (SELECT r, lang, source, measure, v, {_CLASS.format("v")} AS class FROM long),
{_quartiles("own", "lang, source, ")}, {_quartiles("by_lang", "lang, ")}, {_quartiles("every", "")},
picked AS (
  SELECT own.lang, own.source, own.measure, CASE own.measure {_MARGINS} END AS margin,
    {_PICK.format(adaptive_rules.LEAST_ROWS, "q1")} AS q1, {_PICK.format(adaptive_rules.LEAST_ROWS, "q3")} AS q3
  FROM own JOIN by_lang USING (lang, measure) JOIN every USING (measure)
),
fences AS (
  SELECT lang, source, measure, {_VALUE_OF.format(1)} AS low, {_VALUE_OF.format(3)} AS high, margin FROM picked
),
beyond AS (
  SELECT r, measure FROM classed JOIN fences USING (lang, source, measure)
  WHERE v > high + greatest({adaptive_rules.SPREADS} * (high - low), margin)
    OR measure = 'word_length' AND v < low - greatest({adaptive_rules.SPREADS} * (high - low), margin)
),
reasons AS (
  SELECT r, string_agg(measure, ',' ORDER BY list_position({list(_VALUES)}, measure)) AS reasons FROM beyond GROUP BY r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT base_failed AND reasons IS NULL AS kept, coalesce(reasons, '') AS reasons
FROM m LEFT JOIN reasons USING (r)
"""

OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
windows AS (
  SELECT r, p, array_to_string(w[p:p + 34], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM d)
),
repeated AS (SELECT s FROM windows GROUP BY s HAVING count(*) >= 2),
covered AS (
  SELECT DISTINCT r, unnest(range(p, p + 35)) AS i FROM windows SEMI JOIN repeated USING (s)
),
gone AS (SELECT r, list(i) AS g FROM covered GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(len(g), 0) AS n_removed,
  sha256(coalesce(array_to_string(
    CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CRC_TABLE = """(SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i)
  FROM range(256) AS t(i))"""

OP11_SQL = f"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS steps),
found AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents
),
runs AS (
  SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, 'null') || ':' || run)) AS digits
  FROM (SELECT doc_id, run, count(*) AS n FROM found GROUP BY doc_id, run)
),
hashed AS (
  SELECT run, n, xor(list_reduce(
      list_transform(range(1, length(digits), 2), lambda k: ('0x' || substr(digits, k, 2))::BIGINT),
      lambda h, b: xor(h >> 8, steps[(xor(h, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h
  FROM runs, crc
),
spoilt AS (
  SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed
),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spoilt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
skips AS (SELECT word, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM places),
near AS (
  SELECT x.word, y.word AS other FROM skips x JOIN skips y ON x.a = y.a AND x.b = y.b AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, w.word FROM skips x JOIN words w ON w.word = x.a || x.b
  UNION SELECT w.word, x.word FROM skips x JOIN words w ON w.word = x.a || x.b
),
best AS (
  SELECT near.word, count(*) AS n_near, first(near.other ORDER BY o.n DESC, near.other) AS other, max(o.n) AS other_n
  FROM near JOIN words o ON o.word = near.other GROUP BY near.word
),
forms AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form,
    CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)
),
chains AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT chains.word, forms.form FROM chains JOIN forms ON forms.word = chains.root WHERE forms.form IS NOT NULL
)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN (
  SELECT chains.word, chains.root FROM chains JOIN forms ON forms.word = chains.root WHERE forms.form IS NULL) USING (word)
"""

_ASCII_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP12_SQL = f"""
WITH i AS (SELECT item_id, {_ASCII_WORDS} AS w FROM benchmark),
listed AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[p:p + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS p FROM i WHERE len(w) > 0)
),
d AS (SELECT row_number() OVER () AS r, doc_id, {_ASCII_WORDS} AS w FROM documents),
starts AS (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM listed)),
met AS (
  SELECT r, p, size, s FROM (SELECT r, p, size, array_to_string(w[p:p + size - 1], ' ') AS s FROM starts)
  SEMI JOIN listed USING (size, s)
),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS k FROM met) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM met JOIN listed USING (size, s) WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""


def all_queries() -> dict[str, Query]:
    """Queries by name."""
    return {
        "op1_toxicity": op1_toxicity,
        "op2_fingerprints": op2_fingerprints,
        "op3_mixing": op3_mixing,
        "op4_quality_gam": op4_quality_gam,
        "op5_license_scan": op5_license_scan,
        "op6_near_duplicates": op6_near_duplicates,
        "op7_pieces": op7_pieces,
        "op8_adaptive_rules": op8_adaptive_rules,
        "op9_pseudonyms": op9_pseudonyms,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_decontamination": op12_decontamination,
        "op13_periodic_runs": op13_periodic_runs,
    }


def all_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express."""
    return {
        "op3_mixing": OP3_SQL,
        "op8_adaptive_rules": OP8_SQL,
        "op10_substring_dedup": OP10_SQL,
        "op11_spelling_variants": OP11_SQL,
        "op12_decontamination": OP12_SQL,
    }
