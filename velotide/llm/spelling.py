"""Spelling variants: words one edit apart, found by a frontier that walks a trie held as a table.

The trie of all words, read forwards, and that of all words read backwards are one table of nodes: a
prefix, marked by its direction, and its edges, labels of the next two letters (``$`` ends a word). A
frontier state is (word, position, node, edits). Of two words one edit apart at least one half of the
searching word is untouched, so its states without an edit are its own prefixes from the half on, in one
of the two directions. They meet their nodes and take the edit there: each edge is judged with the letter
behind it, so that few states survive. States with one edit then follow their word two letters a level,
joined with the nodes again, until they end on a word's end or vanish.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velotide.llm.common import stage, text_slices
from velotide.llm.line_runs import LOWER, UPPER

LETTERS = "[a-z\u00c0-\u00ff]"
MIN_LENGTH = 5
MIN_COUNT = 3
DAMAGE = 97
RATIO = 2
END = "$"
HELD = 500_000


def count_words(docs: DataFrame, min_length: int = MIN_LENGTH, damage: int = DAMAGE) -> DataFrame:
    """word, n: maximal runs of letters, A-Z in lower case; shorter words are left out. Where ``damage``
    divides the crc32 of ``<doc_id>:<word>``, one letter is lost. Tasks sum up to ``HELD`` words before they
    send them on."""
    find = re.compile(f"{LETTERS}{{{min_length},}}").findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def sums() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"]
            )

        for piece in text_slices(batches, "text"):
            lowered = pc.ascii_lower(piece["text"])
            for name, text in zip(piece["id"].to_pylist(), lowered, strict=True):
                seed = zlib.crc32(f"{name}:".encode())
                for word, many in Counter(find(text.as_py())).items():
                    h = zlib.crc32(word.encode(), seed)
                    if damage and h % damage == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_length:
                            continue
                    counts[word] += many
            if len(counts) >= HELD:
                yield sums()
                counts.clear()
        yield sums()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text").dropna(subset=["text"])
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _oriented(words: DataFrame) -> DataFrame:
    """Every word in both directions, ``x``, and the first position at which that one takes an edit. The
    first letter of ``x`` is the direction."""
    size = F.length("word")
    forwards = F.struct(F.concat(F.lit(">"), "word").alias("x"), F.floor(size / 2).cast("int").alias("half"))
    backwards = F.struct(
        F.concat(F.lit("<"), F.reverse("word")).alias("x"), F.ceil(size / 2).cast("int").alias("half")
    )
    return words.select(F.inline(F.array(forwards, backwards)))


def _at(x: Column, position: Column) -> Column:
    """The letter of the oriented word at a position from 0, or ``$`` behind the last one."""
    return F.substring(F.concat(x, F.lit(END)), position + 2, F.lit(1))


def trie(words: DataFrame) -> DataFrame:
    """Edges of two letters: node, first, second. Prefixes shorter than half of a word one letter shorter are
    never visited and left out."""
    x, at, size = F.col("x"), F.col("at"), F.length("x") - 1
    places = F.sequence(F.floor((size - 1) / 2).cast("int"), size)
    steps = _oriented(words).select("x", F.explode(places).alias("at"))
    prefix = F.substring(x, F.lit(1), at + 1).alias("node")
    return steps.select(prefix, _at(x, at).alias("first"), _at(x, at + 1).alias("second")).distinct()


def _edited(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states after one edit: each meets the edges of its node, of which those stay that fit an edit."""
    first, second, now, then, later = (F.col(c) for c in ("first", "second", "now", "then", "later"))
    inside = now != END
    other = (first != now) & (first != END)
    replaced = inside & other & (second == then)
    # Of a row of equal letters, the last one counts as the one that was inserted or lost.
    inserted = other & (second == now)
    lost = inside & (then != now) & (first == then) & ((then == END) | (second == later))
    taken = states.join(edges.withColumnRenamed("node", "on"), (F.col("node") == F.col("on")) & (replaced | inserted | lost))
    skips = F.array(F.when(replaced, 2), F.when(inserted, 1), F.when(lost, 3))
    found = taken.select("x", "at", "node", first, second, F.explode(F.array_compact(skips)).alias("skip"))
    return found.select("x", (F.col("at") + F.col("skip")).alias("at"), *_reached())


def _reached() -> tuple[Column, Column]:
    """The node behind the edge, and whether a word ends there."""
    first, second = F.col("first"), F.col("second")
    letters = F.when(first == END, F.lit("")).when(second.isin(END, ""), first).otherwise(F.concat(first, second))
    return F.concat("node", letters).alias("node"), second.isin(END, "").alias("ends")


def neighbours(words: DataFrame) -> DataFrame:
    """All ordered pairs (word, near) of distinct words that differ by one inserted, deleted or replaced code point.

    ``words``: distinct, without ``$``, ``<`` and ``>``, two letters at least. A node has as many edges as there are
    pairs of letters at most, and joins are split where many words share a prefix. A state with an edit has one
    successor at most, so a level never grows; levels end when no state is left.
    """
    edges = stage(trie(words), "trie")
    x, at = F.col("x"), F.col("at")
    letters = _at(x, at).alias("now"), _at(x, at + 1).alias("then"), _at(x, at + 2).alias("later")
    prefix = F.substring(x, F.lit(1), at + 1).alias("node")
    places = F.sequence(F.col("half"), F.length(x) - 1)
    exact = _oriented(words).select("x", F.explode(places).alias("at")).select("x", "at", prefix, *letters)
    frontier = stage(_edited(exact, edges), "frontier")
    met = [frontier.filter("ends")]
    while not (open_states := frontier.filter("NOT ends")).isEmpty():
        wanted = open_states.select("x", "at", "node", _at(x, at).alias("first"), _at(x, at + 1).alias("second"))
        moved = wanted.join(edges, ["node", "first", "second"])
        frontier = stage(moved.select("x", (at + 2).alias("at"), *_reached()), "frontier")
        met.append(frontier.filter("ends"))
    pairs = reduce(DataFrame.unionByName, met)

    def plain(oriented: str) -> Column:
        letters = F.substring(oriented, F.lit(2), F.length(oriented))
        return F.when(F.col(oriented).startswith(">"), letters).otherwise(F.reverse(letters))

    return pairs.select(plain("x").alias("word"), plain("node").alias("near")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root from rows (word, form): the last of the forms from a word on, by doubled pointers. Forms may
    not lead back to a word; the number of rounds is the logarithm of the longest way."""
    links = stage(forms.select("word", F.col("form").alias("root")), "links")
    while True:
        nexts = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        longer = links.join(nexts, "root", "left")
        links = stage(longer.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "links")
        if links.filter("moved").isEmpty():
            return links.select("word", "root")


def group_variants(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    ratio: int = RATIO,
    damage: int = DAMAGE,
) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of at least ``min_length`` letters found ``min_count`` times
    or more in ``docs`` (``doc_id``, ``text``; other columns are left out).

    ``form`` is the near word of largest n, the first in code-point order if several, where that n is ``ratio``
    times the word's own or more; else null. ``root`` is the end of the way from form to form. A null text has
    no words, a null id is written as nothing. Repeated rows count again. An empty table gives an empty table.

    Words are counted with partial sums in every task; all else is over the vocabulary, and no word has more
    near words than letters times positions.
    """
    counted = stage(count_words(docs, min_length, damage).filter(F.col("n") >= min_count), "counted")
    ordered = counted.orderBy(F.desc("n"), "word")
    vocabulary = stage(ordered.withColumn("place", F.monotonically_increasing_id()), "vocabulary")
    pairs = neighbours(vocabulary.select("word"))
    best = (  # the first in this order has the largest n, then the smallest letters
        pairs.join(vocabulary.select(F.col("word").alias("near"), "place"), "near")
        .groupBy("word")
        .agg(F.count("*").alias("n_near"), F.min("place").alias("place"))
    )
    forms = vocabulary.select("place", F.col("word").alias("form"), F.col("n").alias("form_n"))
    large = F.col("form_n") >= ratio * F.col("n")
    chosen = stage(
        vocabulary.drop("place").join(best.join(forms, "place"), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(large, F.col("form")).alias("form"), F.when(large, F.col("form_n")).alias("form_n"),
        ),
        "chosen",
    )
    ends = roots(chosen.filter("form IS NOT NULL"))
    return chosen.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


# The table of the CRC by bytes comes from its polynomial, 0xEDB88320.
CRC_SQL = """
WITH RECURSIVE crc_steps AS (
  SELECT unnest(range(0, 256)) AS b, unnest(range(0, 256)) AS v, 0 AS k
  UNION ALL
  SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY b) AS t FROM crc_steps WHERE k = 8)"""


def crc_sql(text: str, table: str) -> str:
    """DuckDB for the unsigned crc32 of the UTF-8 bytes of an expression, given a column with the table."""
    codes = f"list_transform(range(1, strlen({text}) + 1), lambda i: CAST(('0x' || hex({text})[2 * i - 1 : 2 * i]) AS BIGINT))"
    step = f"xor(c // 256, {table}[xor(c % 256, b) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {step}), 4294967295)"


VARIANTS_SQL = rf"""{CRC_SQL},
runs AS (
  SELECT id, word, count(*) AS m FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
           translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]{{{MIN_LENGTH},}}')), '{UPPER}', '{LOWER}') AS word
    FROM documents) GROUP BY 1, 2),
hashed AS (SELECT word, m, {crc_sql("id || ':' || word", "t")} AS h FROM runs, crc_table),
damaged AS (
  SELECT CASE WHEN h % {DAMAGE} = 0 THEN substr(word, 1, h % length(word)) || substr(word, h % length(word) + 2)
         ELSE word END AS word, m FROM hashed),
vocabulary AS (
  SELECT word, CAST(sum(m) AS BIGINT) AS n FROM damaged WHERE length(word) >= {MIN_LENGTH} GROUP BY 1 HAVING sum(m) >= {MIN_COUNT}),
gaps AS (
  SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM vocabulary)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT v.word, g.word, g.n FROM vocabulary v JOIN gaps g ON g.rest = v.word
  UNION SELECT g.word, v.word, v.n FROM vocabulary v JOIN gaps g ON g.rest = v.word),
best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS best_n, min(near) FILTER (WHERE near_n = most) AS best
  FROM (SELECT *, max(near_n) OVER (PARTITION BY word) AS most FROM pairs) GROUP BY 1),
chosen AS (
  SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {RATIO} * n THEN best END AS form,
         CASE WHEN best_n >= {RATIO} * n THEN best_n END AS form_n
  FROM vocabulary v LEFT JOIN best b ON b.word = v.word),
ways AS (
  SELECT word, coalesce(form, word) AS root, form IS NULL AS done FROM chosen
  UNION ALL
  SELECT w.word, coalesce(c.form, w.root), c.form IS NULL FROM ways w JOIN chosen c ON c.word = w.root WHERE NOT w.done)
SELECT c.word, c.form, w.root, c.n, c.n_near, c.form_n FROM chosen c JOIN ways w ON w.word = c.word AND w.done"""
