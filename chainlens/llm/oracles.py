"""DuckDB SQL for the registered queries that SQL can express.

The SQL reads the tables only and shares no step with the operators: windows
are compared as texts, and the exponent of the mixture is in closed form.
"""

from __future__ import annotations

from chainlens.llm.mixing import HASH_BITS, MAX_REPETITION, MIX_BLOCKS
from chainlens.llm.quality import RULES

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_BITS = " + ".join(f"CASE WHEN {rule} THEN {1 << bit} ELSE 0 END" for bit, rule in enumerate(RULES.values()))

QUALITY_RULES = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS worded
  FROM documents
),
w AS (
  SELECT r, i, array_to_string(words[i:i+7], ' ') AS k
  FROM (SELECT r, words, unnest(generate_series(1, len(words) - 7)) AS i FROM d)
),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM w) WHERE n > 1),
cover AS (
  SELECT r, sum(least(8, coalesce(step, 8))) AS n_repeat_words
  FROM (SELECT r, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS step FROM twice) GROUP BY r
),
m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_exclamations,
         CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines,
         CAST(len(worded) - len(list_distinct(worded)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN cover USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       ({_BITS}) = 0 AS kept, CAST({_BITS} AS BIGINT) AS failures
FROM m"""

SUFFIX_TREES = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
w AS (
  SELECT r, i, array_to_string(words[i:i+34], ' ') AS k
  FROM (SELECT r, words, unnest(generate_series(1, len(words) - 34)) AS i FROM d)
),
cover AS (
  SELECT DISTINCT r, unnest(generate_series(i, i + 34)) AS p
  FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1
),
left_over AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n
  FROM (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM d) ANTI JOIN cover USING (r, p)
  GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (r)"""


def _place(epoch: str) -> str:
    key = f"concat('0:', CAST({epoch} AS VARCHAR), ':', coalesce(CAST(doc_id AS VARCHAR), ''))"
    return f"CAST('0x' || substr(md5({key}), 1, {HASH_BITS // 4}) AS BIGINT)"


MIXING = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS tokens FROM documents),
t AS (SELECT source, sum(tokens) AS tokens FROM d GROUP BY source),
s AS (SELECT max(CAST(tokens AS DOUBLE)) AS most, min(CAST(tokens AS DOUBLE)) AS least FROM t WHERE tokens > 0),
a AS (SELECT most, CASE WHEN most / least <= {MAX_REPETITION} THEN 1.0 ELSE ln({MAX_REPETITION}) / ln(most / least) END AS one_less FROM s),
raw AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN pow(most / tokens, one_less) ELSE 1.0 END AS p FROM t, a),
plan AS (
  SELECT source, tokens, CASE WHEN abs(p - round(p)) < 1e-6 THEN round(p) ELSE p END AS passes FROM raw
),
placed AS (
  SELECT doc_id, d.source, d.tokens, passes, CAST(floor(passes) AS BIGINT) AS whole, (passes - floor(passes)) * plan.tokens AS quota
  FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source
),
summed AS (
  SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY {_place('whole')} RANGE UNBOUNDED PRECEDING) AS so_far FROM placed
),
used AS (
  SELECT doc_id, source, passes,
         unnest(generate_series(0, whole + CASE WHEN quota > 0 AND so_far <= quota THEN 1 ELSE 0 END - 1)) AS epoch
  FROM summed
)
SELECT doc_id, source, CAST(epoch AS INTEGER) AS epoch,
       CAST(least(floor((epoch + {_place('epoch')} / CAST({1 << HASH_BITS} AS DOUBLE)) / passes * {MIX_BLOCKS}), {MIX_BLOCKS - 1}) AS INTEGER) AS mix_block,
       {_place('epoch')} AS mix_order
FROM used"""
