"""Removal of repeated passages by hashing lines and the sentences in them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velotide.llm.common import WORD, stage

MIN_WORDS = 10  # shorter passages recur by chance and are left alone
# A unit ends after marks that end a sentence, or after a line break. Units in order are the whole text.
UNIT = r"[^.!?\n]+[.!?]*\n?|[.!?]+\n?|\n"


def units_of(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``unit`` (number from 0), ``digest`` for all units that have a word.

    Units are normalised before they are hashed: lower case, white space runs as one space, trimmed.
    The digest is the md5 of that, 16 bytes.
    """
    units = docs.where("text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.posexplode(F.regexp_extract_all("text", F.lit(UNIT), F.lit(0))).alias("unit", "body"),
    )
    norm = F.trim(F.regexp_replace(F.lower("body"), r"[\x20\x09-\x0D]+", " "))
    normal = units.select("doc_id", "unit", norm.alias("norm")).where("norm <> ''")
    return normal.select("doc_id", "unit", F.unhex(F.md5(F.col("norm").cast("binary"))).alias("digest"))


def repeated_units(units: DataFrame) -> DataFrame:
    """The units that are not the first of their digest in the order of (doc_id, unit).

    Digests are counted with a map-side step, which folds a passage that a third of all documents
    share to one row per task. Only digests that repeat are joined back to the units; they are a
    table of their own, so that adaptive execution knows its size and splits a hot digest.
    """
    first = (
        units.groupBy("digest")
        .agg(F.min(F.struct("doc_id", "unit")).alias("first"), F.count("*").alias("times"))
        .where("times > 1")
        .select("digest", "first")
    )
    again = units.join(stage(first, "repeated-digests"), "digest")
    later = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("unit") != F.col("first.unit"))
    return again.where(later).select("doc_id", "unit")


SPANS = "array<struct<start:bigint,end:bigint>>"


def _passages(text: str, gone: set[int], min_words: int) -> list[tuple[int, int]]:
    """Begin and end of the runs of units in ``gone`` that have ``min_words`` words or more.
    Units without a word do not end a run and do not stand at its ends."""
    found, run, at = [], None, 0
    for k, match in enumerate(re.finditer(UNIT, text)):
        n = len(re.findall(WORD, match.group()))
        if k in gone:
            run = (run[0], match.end(), run[2] + n) if run else (at, match.end(), n)
        elif n and run:
            found.append(run)
            run = None
        at = match.end()
    if run:
        found.append(run)
    return [(begin, end) for begin, end, words in found if words >= min_words]


def _cutter(min_words: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts, spans = [], []
            for text, gone in zip(batch["text"].to_pylist(), batch["gone"].to_pylist(), strict=True):
                passages = _passages(text, set(gone), min_words) if gone else []
                if passages:
                    begins, ends = [0, *(e for _, e in passages)], [*(b for b, _ in passages), len(text)]
                    rest = "".join(text[b:e] for b, e in zip(begins, ends, strict=True))
                    open_end = ends[-1] == begins[-1] and not text.endswith("\n")
                    text = rest.removesuffix("\n") if open_end else rest
                texts.append(text)
                spans.append([{"start": b, "end": e} for b, e in passages])
            yield pa.record_batch([batch["doc_id"], pa.array(texts, pa.string()), pa.array(spans, kind)], ["doc_id", "text", "removed"])

    return cut


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id``, ``text`` without passages that stand earlier in the same or another document, and
    ``removed``, their places in the original text (code points from 0, end exclusive).

    Units are lines, cut further after sentences, so that a passage is also found inside a paragraph that
    is otherwise new; a sentence that it shares with its surroundings stays. A unit is repeated if it
    is not the first of its kind by ``doc_id`` and then by place. Runs of repeated units are removed if they
    have ``min_words`` words or more, and all else stays as it is; a unit goes with its line break, at
    the end of a text with the one before it.
    A null text stays null. An id names one text: rows that repeat an id must repeat its text, keep the
    same units and give a row each. Rows without an id are not compared and are returned unchanged.
    """
    named = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    units = stage(units_of(named), "units")
    gone = repeated_units(units).groupBy("doc_id").agg(F.collect_set("unit").alias("gone"))
    marked = named.join(gone, "doc_id", "left")
    cut = marked.mapInArrow(_cutter(min_words), f"doc_id long, text string, removed {SPANS}")
    nameless = docs.where("doc_id IS NULL").select(F.lit(None).cast("long").alias("doc_id"), "text")
    return cut.unionByName(nameless.withColumn("removed", F.expr(f"cast(array() as {SPANS})")))


DEDUP_SQL = rf"""
WITH units AS (
  SELECT doc_id, unit, body, coalesce(sum(length(body)) OVER before, 0) AS start,
         len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS words,
         trim(regexp_replace(lower(body), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
  FROM (SELECT doc_id, unnest(range(len(bodies))) AS unit, unnest(bodies) AS body
        FROM (SELECT doc_id, regexp_extract_all(text, '{UNIT}') AS bodies FROM documents WHERE text IS NOT NULL))
  WINDOW before AS (PARTITION BY doc_id ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, unit) > 1 AS later FROM units WHERE norm <> ''),
runs AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY unit)
            - row_number() OVER (PARTITION BY doc_id, later ORDER BY unit) AS run FROM ranked),
spans AS (
  SELECT doc_id, CAST(min(start) AS BIGINT) AS b, CAST(max(start + length(body)) AS BIGINT) AS e
  FROM runs WHERE later GROUP BY doc_id, run HAVING sum(words) >= {MIN_WORDS}),
kept AS (
  SELECT u.doc_id, string_agg(body, '' ORDER BY unit) AS text
  FROM units u LEFT JOIN spans s ON u.doc_id = s.doc_id AND u.start >= s.b AND u.start < s.e
  WHERE s.doc_id IS NULL GROUP BY u.doc_id)
SELECT d.doc_id,
       CASE WHEN d.text IS NULL THEN NULL
            WHEN last = length(d.text) AND NOT ends_with(d.text, chr(10)) THEN regexp_replace(coalesce(kept.text, ''), '\n\z', '')
            ELSE coalesce(kept.text, '') END AS text,
       CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN kept USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n, max(e) AS last, string_agg(b || '-' || e, ',' ORDER BY b) AS removed FROM spans GROUP BY doc_id)
  USING (doc_id)"""
