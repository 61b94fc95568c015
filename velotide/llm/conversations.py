"""Conversation structure repair: the cheapest edits that leave ``(s?(ua)+)?``, and the least audit of them.

Costs are a dynamic programme over rows and the four states of that grammar. Rows lie in one order over the
whole table, cut into segments of a conversation that have a bounded number of rows, so that a conversation of any
length is worked on by many tasks: a segment gives, for each state on its left and each on its right, the
least cost, the least audit among the cheapest, and its rank. Ranks and audits come from prefix doubling: the
optimal arcs of all nodes are ranked by their first letter, then by audits of 2, 4, 8, ... letters from the
ranks of the node and of the one its doubled pointer leads to. Segments are then joined from the right, ties
going to the lower rank, and read off from the left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velotide.llm.common import stage
from velotide.llm.line_runs import SPACE
from velotide.llm.spelling import CRC_SQL, crc_sql

MODULUS = 20
SEGMENT_BITS = 12  # rows of a segment, as a power of two
RETITLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
VISIBLE = r"[^\x20\x09-\x0D]"

# States: nothing yet, after s, after u, after a. Roles: system, user, assistant, any other.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("system", "user", "assistant")
KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])  # by state and role
NEXT = np.array([2, 2, 3, 2])  # behind the one role that an insertion or a new title can have
LEGAL = ((0, 1), (1, 2), (2, 1))
LETTERS = "_DIKR"
FAR = 1 << 40

SLIM = ("ckey", "turn", "role", "d1", "d2")


def damaged(rows: DataFrame) -> DataFrame:
    """ckey (conv_id as text), turn, role and text after damage by crc32 of ``conv_id:turn``; nulls are one space,
    but a null turn stays null."""
    space = F.lit(" ")
    named = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), space).alias("ckey"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
    )
    key = F.concat("ckey", F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fate = named.withColumn("fate", F.crc32(key.cast("binary")) % MODULUS).filter("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", ""))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return fate.select(
        "ckey",
        "turn",
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.otherwise(F.col("text")).alias("text"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"d1": F.xxhash64("role", "text"), "d2": F.xxhash64(F.lit(1), "role", "text")})


def _order() -> list[Column]:
    return [F.asc("ckey"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("d1"), F.asc("d2")]


def faults(rows: DataFrame) -> DataFrame:
    """The rows without their texts: place in the order, role, and their first fault: blank, duplicate,
    truncated. Places are dealt by ranges of the whole order, so that a long conversation is cut too."""
    text = F.col("text")
    last = F.substring(F.rtrim(text, F.lit(SPACE)), -1, 1)
    blank = ~text.rlike(VISIBLE)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    slim = _hashed(rows).select(
        *SLIM, role.alias("code"), blank.alias("blank"), (~last.isin(".", "!", "?")).alias("open"),
        F.monotonically_increasing_id().alias("even"),
    )
    order = [*_order(), F.asc("even")]
    placed = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(placed.withColumn("place", F.monotonically_increasing_id()), "turns")
    repeated = placed.groupBy("ckey", "d1", "d2").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    known = placed.join(repeated.filter("n > 1").drop("n"), ["ckey", "d1", "d2"], "left")
    copy = F.coalesce(F.col("place") > F.col("first"), F.lit(False))
    fault = F.when(F.col("blank"), 1).when(copy, 2).when(F.col("open"), 3).otherwise(0)
    return known.select("ckey", "turn", "place", "code", fault.alias("fault"))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables that hold whole groups of equal keys, from batches that are sorted by them."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]).combine_chunks() if held else table
        other = np.zeros(table.num_rows, bool)
        for key in keys:
            other |= pc.not_equal(table[key], table[key][-1]).to_numpy()
        begin = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if begin:
            yield table.slice(0, begin)
        held = table.slice(begin)
    if held:
        yield held


def costs(codes: np.ndarray, faulty: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least cost from column c and state q to the right end of its segment in state r, as [c, q, r]. Segment k has
    its rows at ``ends[k - 1]`` to ``ends[k]``; a segment has a column more than rows. Insertions stand before a
    row; those behind the last one belong to what follows."""
    sizes = np.diff(ends, prepend=0)
    far = np.full((len(codes) + len(ends), 4, 4), FAR)
    last = ends + np.arange(len(ends))
    far[last] = np.where(np.eye(4, dtype=bool), 0, FAR)
    column = np.arange(len(codes)) + np.repeat(np.arange(len(ends)), sizes)
    from_right = np.repeat(ends, sizes) - 1 - np.arange(len(codes))
    turn = np.argsort(from_right, kind="stable")
    steps = np.searchsorted(from_right[turn], np.arange(from_right.max(initial=-1) + 2))
    for begin, end in zip(steps[:-1], steps[1:], strict=True):
        rows = turn[begin:end]
        found, _ = _arcs(far, column[rows], codes[rows], faulty[rows])
        best = found.min(axis=0)
        best[:, USER], best[:, ASSISTANT] = (
            np.minimum(best[:, USER], best[:, ASSISTANT] + INSERT),
            np.minimum(best[:, ASSISTANT], best[:, USER] + INSERT),
        )
        for state in (START, SYSTEM):
            best[:, state] = np.minimum(best[:, state], best[:, USER] + INSERT)
        far[column[rows]] = best
    return far


def _arcs(far: np.ndarray, column: np.ndarray, codes: np.ndarray, faulty: np.ndarray):
    """Costs by way of Delete, Keep and a new title, as [arc, row, q, r], and the states they lead to."""
    behind = far[column + 1]
    extra = np.where(faulty == 3, TRUNCATED, 0)[:, None, None]
    barred = ((faulty == 1) | (faulty == 2))[:, None, None]
    kept = KEPT[:, codes].T  # [row, q]
    keep = np.take_along_axis(behind, np.maximum(kept, 0)[:, :, None], axis=1) + extra
    keep = np.where(barred | (kept < 0)[:, :, None], FAR, keep)
    retitle = np.where(barred, FAR, behind[:, NEXT] + RETITLE + extra)
    to = np.stack([np.broadcast_to(np.arange(4), kept.shape), np.maximum(kept, 0), np.broadcast_to(NEXT, kept.shape)])
    return np.minimum(np.stack([behind + DELETE, keep, retitle]), FAR), to


def first_arcs(far: np.ndarray, codes: np.ndarray, faulty: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every node (c, q, r), the optimal arc of least letter, as an index of ``LETTERS``, and the node
    it leads to. A letter fixes the arc in this grammar. Ends and nodes without a way lead to themselves."""
    nodes = np.arange(far.size).reshape(far.shape)
    letter, to = np.zeros(far.shape, np.int64), nodes.copy()
    column = np.arange(len(codes)) + np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    here, least, target = far[column], letter[column], nodes[column]
    found, states = _arcs(far, column, codes, faulty)
    inserted = here[:, NEXT] + INSERT
    # From the largest letter down, so that the least one stays.
    for code, cost, state, step in (
        (4, found[2], states[2], 1), (3, found[1], states[1], 1), (2, inserted, np.broadcast_to(NEXT, states[0].shape), 0),
        (1, found[0], states[0], 1),
    ):
        best = (cost == here) & (here < FAR)
        leads = ((column + step)[:, None, None] * 4 + state[:, :, None]) * 4 + np.arange(4)
        least, target = np.where(best, code, least), np.where(best, leads, target)
    letter[column], to[column] = least, target
    return letter.ravel(), to.ravel()


def doubled(letter: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Rank of every node's least audit among all, its length, and pointers over 1, 2, 4, ... letters."""
    rank, length, pointers = letter, (letter > 0).astype(np.int64), [to]
    while (letter[pointers[-1]] > 0).any():
        to = pointers[-1]
        _, rank = np.unique(rank * (rank.max() + 1) + rank[to], return_inverse=True)
        length = length + length[to]
        pointers.append(to[to])
    return rank, length, pointers


def audits(starts: np.ndarray, letter: np.ndarray, length: np.ndarray, pointers: list[np.ndarray]) -> list[str]:
    """The least audit of every start, all letters at once: letter t lies behind the pointers of the bits of t."""
    sizes = length[starts]
    stops = np.cumsum(sizes)
    place = np.arange(stops[-1] if len(stops) else 0) - np.repeat(stops - sizes, sizes)
    node = np.repeat(starts, sizes)
    for k, pointer in enumerate(pointers):
        hop = (place >> k) & 1 > 0
        node[hop] = pointer[node[hop]]
    text = "".join(np.array(list(LETTERS))[letter[node]])
    return [text[stop - size : stop] for stop, size in zip(stops, sizes, strict=True)]


PIECES = "ckey string, segment long, first int, last int, illegal long, cost array<long>, rank array<long>, audit array<string>"


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of segments, in order, to one row a segment: the 4 x 4 ways through it."""
    for table in whole_groups(batches, ("ckey", "segment")):
        codes, faulty = (table[c].to_numpy().astype(np.int64) for c in ("code", "fault"))
        names, numbers = table["ckey"].combine_chunks(), table["segment"].to_numpy()
        changes = (numbers[1:] != numbers[:-1]) | pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)
        ends = np.append(np.flatnonzero(changes) + 1, len(codes))
        begins = np.concatenate([[0], ends[:-1]])
        far = costs(codes, faulty, ends)
        letter, to = first_arcs(far, codes, faulty, ends)
        rank, length, pointers = doubled(letter, to)
        starts = ((begins + np.arange(len(ends)))[:, None] * 16 + np.arange(16)).ravel()
        legal = np.zeros((4, 4), bool)
        legal[tuple(zip(*LEGAL, strict=True))] = True
        wrong = ~legal[codes[:-1], codes[1:]] & ~changes
        wrongs = np.concatenate([[0], np.cumsum(wrong)])  # wrongs[k]: among the first k pairs
        lists = pa.array(np.arange(0, 16 * len(ends) + 1, 16), pa.int32())
        many = [pa.array(far.ravel()[starts]), pa.array(rank[starts]), pa.array(audits(starts, letter, length, pointers))]
        yield pa.RecordBatch.from_arrays(
            [
                names.take(pa.array(begins)), pa.array(numbers[begins], pa.int64()),
                pa.array(codes[begins], pa.int32()), pa.array(codes[ends - 1], pa.int32()),
                pa.array(wrongs[ends - 1] - wrongs[begins], pa.int64()),
                *(pa.ListArray.from_arrays(lists, values) for values in many),
            ],
            names=["ckey", "segment", "first", "last", "illegal", "cost", "rank", "audit"],
        )


JOINED = "ckey string, cost long, illegal long, audit string"


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of conversations, the last one first, to one row a conversation. What is held of a conversation is
    four audits of each segment."""
    out: list[tuple] = []
    name, ahead, wrong, first, ways = None, [], 0, None, []
    missing = ["", "II", "I", ""]  # behind the last row, to whole pairs

    def told() -> tuple:
        state, text = START, []
        for choice in reversed(ways):
            state, piece = choice[state]
            text.append(piece)
        return name, ahead[START], wrong, "".join(text) + missing[state]

    for batch in batches:
        for row in batch.to_pylist():
            if row["ckey"] != name:
                if name is not None:
                    out.append(told())
                name, wrong, first, ways = row["ckey"], 0, None, []
                ahead = [INSERT * len(letters) for letters in missing]
            wrong += row["illegal"] + (first is not None and (row["last"], first) not in LEGAL)
            first, choice, left = row["first"], [], []
            for q in range(4):
                cost, _, r = min((row["cost"][4 * q + r] + ahead[r], row["rank"][4 * q + r], r) for r in range(4))
                left.append(cost)
                choice.append((r, row["audit"][4 * q + r]))
            ahead = left
            ways.append(choice)
        if out:
            yield _batch(out, JOINED)
            out = []
    if name is not None:
        yield _batch([told()], JOINED)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    names, types = zip(*(field.split() for field in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kinds[t]) for column, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names)
    )


REPAIRED = "ckey string, repaired_sha256 string"


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's audit, then its rows in order, to the digest of what the audit makes of them. The digest
    takes line after line: nothing is held but the audit."""
    out: list[tuple] = []
    name, audit, at, state, digest, lines = None, "", 0, START, None, 0

    def line(role: str, text: str) -> None:
        nonlocal lines
        digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
        lines += 1

    def insertions() -> None:
        nonlocal at, state
        while audit[at : at + 1] == "I":
            state, at = int(NEXT[state]), at + 1
            line(ROLES[state - 1], "")

    for batch in batches:
        for row in batch.to_pylist():
            if row["ckey"] != name:
                if name is not None:
                    insertions()
                    out.append((name, digest.hexdigest()))
                name, audit, at, state, digest, lines = row["ckey"], row["text"], 0, START, hashlib.sha256(), 0
                continue
            insertions()
            letter, at = audit[at], at + 1
            if letter == "K":
                state = int(KEPT[state]["sua".index(row["role"][0])])
                line(row["role"], row["text"])
            elif letter == "R":
                state = int(NEXT[state])
                line(ROLES[state - 1], row["text"])
        if out:
            yield _batch(out, REPAIRED)
            out = []
    if name is not None:
        insertions()
        yield _batch([(name, digest.hexdigest())], REPAIRED)


def repair(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of ``conversations`` (``conv_id``, ``turn``, ``role``, ``text``; other columns are left
    out): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows stand by turn, nulls first; rows of one turn by role, then by a hash of role and text. A null conv_id is
    a conversation of its own. A conversation that damage leaves without rows has zeros, no audit, and the
    digest of an empty string. An empty table gives an empty table.

    Texts are moved once, to the digest, which has to take a conversation's lines one after the other. All else is
    over rows without text, dealt by ranges and segments, never by conversation alone.
    """
    rows = damaged(conversations)
    found = stage(faults(rows), "faults")
    segments = (
        found.withColumn("segment", F.shiftright("place", SEGMENT_BITS))
        .repartition("ckey", "segment")
        .sortWithinPartitions("ckey", "segment", "place")
        .select("ckey", "segment", "code", "fault")
        .mapInArrow(pieces, PIECES)
    )
    repaired = stage(
        segments.repartition("ckey").sortWithinPartitions("ckey", F.desc("segment")).mapInArrow(joined, JOINED), "audits"
    )
    texts = _hashed(rows).select(*SLIM, "text", F.lit(1).alias("kind"))
    blanks = [F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(0).cast("long").alias("d1"),
              F.lit(0).cast("long").alias("d2")]
    both = texts.unionByName(repaired.select("ckey", *blanks, F.col("audit").alias("text"), F.lit(0).alias("kind")))
    order = _order()
    sums = (
        both.repartition("ckey")
        .sortWithinPartitions(order[0], "kind", *order[1:])
        .select("ckey", "role", "text")
        .mapInArrow(digests, REPAIRED)
    )
    fault = F.col("fault")
    counted = found.groupBy("ckey").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        F.count_if(fault == 1).alias("blank"),
        F.count_if(fault == 2).alias("duplicate"),
        F.count_if(fault == 3).alias("truncated"),
    )
    ids = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("ckey"), "conv_id")
    all_ids = ids.groupBy("ckey").agg(F.max("conv_id").alias("conv_id"))
    whole = all_ids.join(counted, "ckey", "left").join(repaired, "ckey", "left").join(sums, "ckey", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def _step(arcs: str) -> str:
    return f"list_min([{arcs}])"


def _sql_state(state: int) -> str:
    kept = {START: "WHEN 's' THEN s1 WHEN 'u' THEN s2", SYSTEM: "WHEN 'u' THEN s2", USER: "WHEN 'a' THEN s3", ASSISTANT: "WHEN 'u' THEN s2"}
    to = int(NEXT[state])
    title = ROLES[to - 1]

    def arc(cost: str, letter: str, source: str, line: str | None) -> str:
        lines = f"{source}.l" if line is None else f"{line} || coalesce(chr(10) || {source}.l, '')"
        return f"{{'c': {source}.c + {cost}, 'a': '{letter}' || {source}.a, 'l': {lines}}}"

    keep = f"(CASE left(role, 1) {kept[state]} ELSE NULL END)"
    return _step(
        f"{arc(str(DELETE), 'D', f's{state}', None)}, "
        f"CASE WHEN NOT must THEN {arc(f'{RETITLE} + extra', 'R', f's{to}', f'{chr(39)}{title}:{chr(39)} || text')} END, "
        f"CASE WHEN NOT must AND {keep} IS NOT NULL THEN {arc('extra', 'K', keep, 'role || ' + repr(':') + ' || text')} END"
    )


def _sql_insert(state: str, source: str, title: str) -> str:
    made = f"{{'c': {source}.c + {INSERT}, 'a': 'I' || {source}.a, 'l': '{title}:' || coalesce(chr(10) || {source}.l, '')}}"
    return _step(f"{state}, {made}")


_KEY = "coalesce(CAST(conv_id AS VARCHAR), ' ')"
REPAIR_SQL = rf"""{CRC_SQL},
named AS (
  SELECT conv_id, {_KEY} AS ckey, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_KEY} || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hashed AS (SELECT ckey, turn, role, text, {crc_sql("k", "t")} % {MODULUS} AS fate FROM named, crc_table),
damaged AS (
  SELECT ckey, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE fate <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY ckey ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM damaged),
judged AS (
  SELECT *, left(lag(role) OVER (PARTITION BY ckey ORDER BY i), 1) || left(role, 1) AS pair,
         CASE WHEN last = '' THEN 1 WHEN row_number() OVER (PARTITION BY ckey, role, text ORDER BY i) > 1 THEN 2
              WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM placed),
numbers AS (
  SELECT ckey, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
         count(*) FILTER (WHERE fault = 3) AS truncated,
         count(*) FILTER (WHERE i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY 1),
ways AS (
  SELECT ckey, n AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 'l': CAST(NULL AS VARCHAR)}} AS s0,
         {{'c': CAST(6 AS BIGINT), 'a': 'II', 'l': 'user:' || chr(10) || 'assistant:'}} AS s1,
         {{'c': CAST(3 AS BIGINT), 'a': 'I', 'l': 'assistant:'}} AS s2,
         {{'c': CAST(0 AS BIGINT), 'a': '', 'l': CAST(NULL AS VARCHAR)}} AS s3 FROM numbers
  UNION ALL
  SELECT ckey, i, {_sql_insert("b0", "e2", "user")}, {_sql_insert("b1", "e2", "user")}, e2, {_sql_insert("b3", "b2", "user")}
  FROM (SELECT *, {_sql_insert("b2", "b3", "assistant")} AS e2
        FROM (SELECT ckey, i, {_sql_state(0)} AS b0, {_sql_state(1)} AS b1, {_sql_state(2)} AS b2, {_sql_state(3)} AS b3
              FROM (SELECT w.ckey, w.i - 1 AS i, s0, s1, s2, s3, j.role, j.text, j.fault IN (1, 2) AS must,
                           CASE WHEN j.fault = 3 THEN {TRUNCATED} ELSE 0 END AS extra
                    FROM ways w JOIN judged j ON j.ckey = w.ckey AND j.i = w.i))))
SELECT g.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate,
       coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal, coalesce(w.s0.c, 0) AS cost,
       coalesce(w.s0.a, '') AS audit, sha256(coalesce(w.s0.l, '')) AS repaired_sha256
FROM (SELECT ckey, max(conv_id) AS conv_id FROM named GROUP BY 1) g
LEFT JOIN numbers n ON n.ckey = g.ckey LEFT JOIN ways w ON w.ckey = g.ckey AND w.i = 0"""
