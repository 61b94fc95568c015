"""Default parameters. Every function takes these as arguments; nothing reads them behind its back."""

from datetime import date

# They must equal the published ones for the results to agree.
TIMEZONE = "America/New_York"
FIRST_MONTH = "202401"
TOP_STATIONS = 50
RANK_START = date(2024, 1, 1)
RANK_END = date(2025, 1, 1)
TEST_WEEKS = (
    date(2025, 1, 13),
    date(2025, 4, 14),
    date(2025, 7, 14),
    date(2025, 10, 13),
    date(2026, 1, 12),
    date(2026, 3, 9),
    date(2026, 5, 11),
    date(2026, 6, 15),
    date(2026, 7, 13),
    date(2026, 9, 14),
)
TARGETS = ("departures", "arrivals")
SYSTEM_ID = "SYSTEM"
CLOSED_MIN_HOURS = 48
HISTORY_WEEKS = 8
NAIVE = "seasonal_naive"
AVERAGE = "historical_average"
RAIN_MM = 1.0
