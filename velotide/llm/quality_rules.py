"""Quality rules: a table of thresholds compiled into one projection of built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velotide.llm.common import let

SPACES = r"[\x20\x09-\x0D]+"

# The commonest function words of the four languages.
STOP_WORDS = (
    "the of and to in that is with a it for as be this was are on by or from at "
    "der die das und ist ein eine in zu den mit von für nicht auf im sich des dem es "
    "le la les et un une de des que est pour dans par sur qui ne pas au en du "
    "el los las y un una del que es por con para no se su al lo como en"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= measure <= high; an open side is None."""

    measure: str
    low: float | None
    high: float | None


RULES = (
    Rule("n_words", 50, None),
    Rule("repeat_share", None, 0.5),
    Rule("mean_word_length", 2, 12),
    Rule("symbol_share", None, 0.1),
    Rule("stop_share", 0.02, None),
    Rule("dup_line_share", None, 0.5),
    Rule("mean_line_words", 1.5, None),
)


def counts(text: Column) -> dict[str, Column]:
    """Counts of one text, from columns of ``_parts``."""
    words = F.col("words")
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, SPACES, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*sorted(set(STOP_WORDS))))).cast("long"),
        "n_repeat_words": _repeat_words(words).cast("long"),
    }


def _repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more, the first one included.

    Window hashes are sorted together with their places, so that equal ones are neighbours; the places
    of repeated windows, in order, cover up to three words each. Texts whose windows all differ, which a
    hash set tells, are not sorted.
    """
    n = F.size(words) - 2
    windows = F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(sorted_windows: Column) -> Column:
            def twin(w: Column, k: Column) -> Column:
                before = F.get(sorted_windows, k - 1)["h"]
                after = F.get(sorted_windows, k + 1)["h"]
                return F.coalesce(before == w["h"], F.lit(False)) | F.coalesce(after == w["h"], F.lit(False))

            return F.filter(sorted_windows, twin)

        def width(places: Column) -> Column:
            step = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3))))
            return F.aggregate(step, F.lit(0), lambda a, b: a + b)

        return let(let(let(placed, repeated), lambda r: F.sort_array(F.transform(r, lambda w: w["i"]))), width)

    def some(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered(hashes)).otherwise(F.lit(0))

    return F.when(n > 1, let(windows, some)).otherwise(F.lit(0))


def measures() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "n_words": F.col("n_words"),
        "repeat_share": F.col("n_repeat_words") / words,
        "mean_word_length": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "stop_share": F.col("n_stop_words") / words,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "mean_line_words": F.col("n_words") / lines,
    }


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules as one condition."""
    known, passes = measures(), F.lit(True)
    for rule in rules:
        if rule.low is not None:
            passes = passes & (known[rule.measure] >= rule.low)
        if rule.high is not None:
            passes = passes & (known[rule.measure] <= rule.high)
    return passes


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``docs`` (``doc_id``, ``text``; other columns are left out) with its counts,
    ``base_failed`` (under 50 words, or over half of them in repeated windows) and ``kept``.

    A null text has no words. Empty and blank texts fail. Rows may repeat. Nothing is shuffled.
    The default rules ask for stop words of English, German, French or Spanish, so that texts in other languages are not
    kept; give ``rules`` without ``stop_share`` for them.
    """
    text = F.coalesce("text", F.lit(""))
    parts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        F.filter(F.split(text, SPACES, -1), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    found = parts.select("doc_id", *(c.alias(name) for name, c in counts(F.col("text")).items()))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))


_LISTED = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
RULES_SQL = rf"""
WITH parts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
placed AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM parts)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM placed) WHERE n > 1),
covered AS (
  SELECT r, sum(least(3, coalesce(lead - i, 3))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS lead FROM twice) GROUP BY r),
found AS (
  SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         len(list_filter(words, lambda w: lower(w) IN ({_LISTED}))) AS n_stop_words,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM parts LEFT JOIN covered USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM found)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 2 AND 12
       AND n_symbols / greatest(word_chars, 1) <= 0.1 AND n_stop_words / greatest(n_words, 1) >= 0.02
       AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AND n_words / greatest(n_lines, 1) >= 1.5 AS kept
FROM judged"""
