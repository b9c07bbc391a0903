"""Operator 2: quality rules, line first.

Every line is judged alone: by its punctuation (symbols, exclamation marks), as navigation
(short cells between separators) and as boilerplate (fixed phrases). Failing lines are
removed, and a document that loses more than ``most_lost`` of its characters that way is
rejected. Base statistics reject documents that are too short or repeat themselves.

Only built-in functions; no shuffle, so skewed keys don't matter. Windows are compared by
64-bit hash within one document. Defined results: null text counts as empty (base_failed);
null and repeated doc_ids are kept as they are; other columns are passed through by
``clean_lines`` unless they bear the name of a column it adds, which then wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Fixed phrases of boilerplate lines.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "copyright ©", "(c) copyright",
    "click here to", "subscribe to our", "sign up for", "follow us on", "powered by", "enable javascript", "share this article", "alle rechte vorbehalten",
    "tous droits réservés", "todos los derechos reservados", "política de cookies", "politique de confidentialité", "datenschutzerklärung",
)


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def line_fails(line: Column) -> Column:
    """Whether a line breaks a rule; blank lines never do."""
    size = F.length(line)
    symbols, marks, cells = _count(line, SYMBOLS), _count(line, "!"), _count(line, "|»›•")
    low = F.lower(line)
    boilerplate = F.lit(False)
    for phrase in BOILERPLATE:
        boilerplate = boilerplate | low.contains(phrase)
    return ((symbols >= 3) & (symbols * 100 > size * 5)) | ((marks >= 4) & (marks * 100 > size * 5)) | ((cells >= 3) & (size < 25 * (cells + 1))) | (boilerplate & (size <= 200))


def clean_lines(docs: DataFrame, most_lost: float = 0.5) -> DataFrame:
    """docs with cleaned_text, the statistics of the contract, base_failed and kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("_words", F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).withColumn("_lines", F.split(text, "\n"))
    d = d.withColumn("n_words", F.size("_words").cast("long"))
    hashes = F.transform(
        F.slice("_words", 1, F.greatest(F.size("_words") - (WINDOW - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *(F.get("_words", i + k) for k in range(1, WINDOW))),
    )
    d = d.withColumn("_hashes", hashes)
    # only documents with a repeated window pay for sorting them with their places
    d = d.withColumn("_pairs", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i, step: F.coalesce(F.get("_pairs", i + step)["h"] == x["h"], F.lit(False))
    d = d.withColumn("_at", F.sort_array(F.transform(F.filter("_pairs", lambda x, i: ((i > 0) & same(x, F.greatest(i, F.lit(1)), -1)) | same(x, i, 1)), lambda x: x["i"])))
    covered = F.aggregate(F.transform("_at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
    worded = F.filter("_lines", lambda x: F.translate(x, BLANKS, "") != "")
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).withColumn("_worded", worded)
    d = d.withColumns(
        {
            "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
            "n_symbols": _count(text, SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long"),
            "cleaned_text": F.array_join(F.filter("_lines", lambda x: ~line_fails(x)), "\n"),
        }
    )
    lost = F.length(text) - F.length("cleaned_text")
    d = d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    d = d.withColumn("kept", ~F.col("base_failed") & (lost <= most_lost * F.length(text)))
    return d.drop("_words", "_lines", "_hashes", "_pairs", "_at", "_worded")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return clean_lines(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_count(text: str, characters: str) -> str:
    return f"(length({text}) - length(translate({text}, '{characters}', '')))"


_LINE_FAILS = (
    f"(({_sql_count('x', SYMBOLS)} >= 3 AND {_sql_count('x', SYMBOLS)} * 100 > length(x) * 5) OR ({_sql_count('x', '!')} >= 4 AND {_sql_count('x', '!')} * 100 > length(x) * 5)"
    f" OR ({_sql_count('x', '|»›•')} >= 3 AND length(x) < 25 * ({_sql_count('x', '|»›•')} + 1)) OR (length(x) <= 200 AND ("
    + " OR ".join(f"contains(lower(x), '{phrase}')" for phrase in BOILERPLATE)
    + ")))"
)
OP2_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words, string_split(t, chr(10)) AS lines FROM d),
n AS (SELECT *, len(words) AS n_words, list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS worded,
      array_to_string(list_filter(lines, lambda x: NOT {_LINE_FAILS}), chr(10)) AS cleaned FROM w),
p AS (SELECT r, words, unnest(range(1, n_words - {WINDOW - 2})) AS i FROM n WHERE n_words >= {WINDOW}),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(words[i:i + {WINDOW - 1}], ' ')) AS c FROM p),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM g, range({WINDOW}) AS u(k) WHERE c > 1 GROUP BY r),
s AS (SELECT doc_id, t, cleaned, n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      len(worded) - len(list_distinct(worded)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM n LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND length(t) - length(cleaned) <= 0.5 * length(t) AS kept
FROM b
"""
