"""Two raw trip schemas into one typed table, and ordered cleaning rules counted per file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velotide.functions.columns import days, floor_millis, seconds, strip_to_null
from velotide.session import BROADCAST_ROWS, materialize

# The unified table, the names in the legacy files, and what cannot be a station.
UNIFIED_COLUMNS = (
    "ride_id",
    "rideable_type",
    "started_at",
    "ended_at",
    "start_station_id",
    "start_station_name",
    "start_lat",
    "start_lng",
    "end_station_id",
    "end_station_name",
    "end_lat",
    "end_lng",
    "member_type",
)
LEGACY_NAMES = {
    "started_at": "starttime",
    "ended_at": "stoptime",
    "start_station_id": "start station id",
    "start_station_name": "start station name",
    "start_lat": "start station latitude",
    "start_lng": "start station longitude",
    "end_station_id": "end station id",
    "end_station_name": "end station name",
    "end_lat": "end station latitude",
    "end_lng": "end station longitude",
    "member_type": "usertype",
}
NEW_NAMES = {"member_type": "member_casual"}
NEW_MARKS = {"ride_id", "started_at", "start_station_id"}
LEGACY_MARKS = {"tripduration", "starttime", "start station id"}
LEGACY_MEMBERS = (("Subscriber", "member"), ("Customer", "casual"))
STAFF_NAMES = r"(?i)\btest\b|warehouse|maintenance|\bbcu\b|mobile temporary|\bdepot\b"
STAFF_IDS = ("X32999",)
MIN_SECONDS = 60
MAX_DAYS = 1
RULES = (
    "duplicate",
    "unparseable_time",
    "duration_nonpositive",
    "duration_under_60s",
    "duration_over_24h",
    "test_station",
    "no_station",
)

TIME_COLUMNS = ("started_at", "ended_at")
NUMBER_COLUMNS = ("start_lat", "start_lng", "end_lat", "end_lng")
ORIGIN = ("source_file", "row_order")


def detect_schema(columns: list[str]) -> str:
    """``new`` or ``legacy`` from the header alone, ignoring case and padding."""
    seen = {c.strip().lower() for c in columns}
    for kind, marks in (("new", NEW_MARKS), ("legacy", LEGACY_MARKS)):
        if marks <= seen:
            return kind
    raise ValueError(f"neither trip schema: {sorted(seen)}")


def parse_time(text: Column) -> Column:
    """ISO date and time with or without fractions, to the millisecond; anything else is NULL."""
    return floor_millis(F.trim(text).try_cast("timestamp_ntz"))


def unify_names(raw: DataFrame) -> DataFrame:
    """One raw table of strings under the unified names, still as text, with its schema.

    Columns that say where a row came from (``source_file``, ``row_order``) pass through.
    """
    kind = detect_schema(raw.columns)
    actual = {c.strip().lower(): c for c in raw.columns}
    renamed = NEW_NAMES if kind == "new" else LEGACY_NAMES
    out = []
    for name in UNIFIED_COLUMNS:
        source = actual.get(renamed.get(name, name))
        text = F.lit(None).cast("string") if source is None else F.col(f"`{source}`")
        out.append(text.alias(name))
    origin = [c for c in ORIGIN if c in raw.columns]
    return raw.select(*out, *origin, F.lit(kind).alias("schema_kind"))


def to_types(text: DataFrame) -> DataFrame:
    """Typed columns from unified text. What cannot be parsed is NULL; no row is dropped."""
    member = F.col("member_type")
    (first, as_first), (second, as_second) = LEGACY_MEMBERS
    legacy = F.when(member == first, as_first).when(member == second, as_second)
    out = []
    for name in UNIFIED_COLUMNS:
        if name in TIME_COLUMNS:
            value = parse_time(F.col(name))
        elif name in NUMBER_COLUMNS:
            value = F.trim(name).try_cast("double")
        elif name == "member_type":
            value = F.when(F.col("schema_kind") == "legacy", legacy).otherwise(strip_to_null(member))
        else:
            value = strip_to_null(F.col(name))
        out.append(value.alias(name))
    return text.select(*out, *[c for c in text.columns if c not in (*UNIFIED_COLUMNS, "schema_kind")])


def normalize(raw: DataFrame) -> DataFrame:
    """The unified, typed columns of one raw table of strings."""
    return to_types(unify_names(raw))


def is_staff_station(station_id: Column, name: Column) -> Column:
    """Test, depot and staff stations, by ID or by a word in the name."""
    by_id = F.coalesce(station_id.isin(*STAFF_IDS), F.lit(False))
    return by_id | F.coalesce(name, F.lit("")).rlike(STAFF_NAMES)


def first_copies(trips: DataFrame, file_column: str = "source_file") -> DataFrame:
    """The first copy of every trip within its file, with the number of copies.

    Copies share the ride ID; in a file where any ride ID is missing they share the whole row
    (NULL equals NULL). "First" is file order, carried in ``row_order``. This is an aggregation
    with a map-side step rather than a ranking window: a trip repeated millions of times is folded
    in every task before anything is shuffled. Where the whole row is the key it is not carried again.
    """
    lacks_ids = trips.groupBy(file_column).agg(
        F.bool_or(F.col("ride_id").isNull()).alias("_whole_row")
    )
    rest = [c for c in UNIFIED_COLUMNS if c != "ride_id"]
    whole_row = F.when(F.col("_whole_row"), F.struct(*rest))
    other = F.when(~F.col("_whole_row"), F.struct(*rest)).alias("_rest")
    picked = F.min(F.struct("row_order", other)).alias("_first")
    first = F.coalesce("_key", "_first._rest")
    # One row per input file, a list that the driver holds already to plan the scan.
    return (
        trips.join(F.broadcast(lacks_ids), file_column)
        .groupBy(file_column, "ride_id", whole_row.alias("_key"))
        .agg(picked, F.count("*").alias("copies"))
        .withColumn("_row", first)
        .select(
            file_column,
            *[F.col("ride_id") if c == "ride_id" else F.col(f"_row.{c}") for c in UNIFIED_COLUMNS],
            "copies",
        )
    )


def rule_predicates() -> list[tuple[str, Column]]:
    """The rules after ``duplicate``, in order. NULL means the rule does not apply."""
    length = F.col("ended_at") - F.col("started_at")
    staff = is_staff_station(F.col("start_station_id"), F.col("start_station_name"))
    staff = staff | is_staff_station(F.col("end_station_id"), F.col("end_station_name"))
    return [
        ("unparseable_time", F.col("started_at").isNull() | F.col("ended_at").isNull()),
        ("duration_nonpositive", length <= seconds(0)),
        ("duration_under_60s", length < seconds(MIN_SECONDS)),
        ("duration_over_24h", length > days(MAX_DAYS)),
        ("test_station", staff),
        ("no_station", F.col("start_station_id").isNull() & F.col("end_station_id").isNull()),
    ]


def label_rows(trips: DataFrame, file_column: str = "source_file") -> DataFrame:
    """First copies with ``rule``, the first rule a row falls under, NULL for rows to keep."""
    (name, hit), *rest = rule_predicates()
    rule = reduce(lambda done, r: done.when(r[1], r[0]), rest, F.when(hit, name))
    return first_copies(trips, file_column).withColumn("rule", rule)


def kept_rows(labelled: DataFrame) -> DataFrame:
    return labelled.filter(F.col("rule").isNull()).drop("rule", "copies")


def removed_counts(labelled: DataFrame, file_column: str = "source_file") -> DataFrame:
    """Per file: rows in, rows removed by each rule, rows out."""
    by_rule = [
        F.count_if(F.coalesce(F.col("rule") == r, F.lit(False))).alias(r) for r in RULES[1:]
    ]
    return labelled.groupBy(file_column).agg(
        F.sum("copies").alias("rows_in"),
        F.sum(F.col("copies") - 1).alias("duplicate"),
        *by_rule,
        F.count_if(F.col("rule").isNull()).alias("rows_out"),
    )


def apply_rules(trips: DataFrame, file_column: str = "source_file") -> tuple[DataFrame, DataFrame]:
    """Kept rows and the counts per file."""
    labelled = label_rows(trips, file_column)
    return kept_rows(labelled), removed_counts(labelled, file_column)


def _fold(trips: DataFrame, keys: list[str], whole_row: Column) -> DataFrame:
    rest = [c for c in trips.columns if c not in keys]
    folded = trips.groupBy(*keys, whole_row.alias("_key")).agg(F.min(F.struct(*rest)).alias("_row"))
    order = [F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in trips.columns]
    return folded.select(*order)


def distinct_trips(
    trips: DataFrame, keys: list[str] | None = None, max_suspects: int = BROADCAST_ROWS
) -> DataFrame:
    """One row per key across all files: (ride_id, started_at) unless told otherwise.

    The smallest remaining row is kept, so the choice does not depend on file order. A row whose
    first key is NULL is only a copy of a row that is equal in everything.

    Copies are rare among trips, so whole rows are not shuffled to find them. A first pass counts
    64-bit hashes of the keys. Rows whose hash is unique are unique and pass through; the others,
    true copies and the odd collision, are compared by their keys, folded on the map side first,
    as one trip may be repeated any number of times. When more hashes repeat than may be
    broadcast, all rows are folded in one shuffle instead.
    """
    keys = keys or ["ride_id", "started_at"]
    rest = [c for c in trips.columns if c not in keys]
    whole_row = F.when(F.col(keys[0]).isNull(), F.struct(*rest))
    hashed = trips.withColumn("_hash", F.xxhash64(*keys, whole_row))
    counted = hashed.groupBy("_hash").agg(F.count("*").alias("n")).filter("n > 1")
    suspects = materialize(counted.select("_hash"))
    if suspects.count() > max_suspects:
        return _fold(trips, keys, whole_row)
    known = F.broadcast(suspects)
    unique = hashed.join(known, "_hash", "left_anti").drop("_hash")
    copied = hashed.join(known, "_hash", "left_semi").drop("_hash")
    return unique.unionByName(_fold(copied, keys, whole_row))
