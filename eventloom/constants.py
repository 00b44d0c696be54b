"""Fixed values that results depend on."""

from __future__ import annotations

BIRTH = "MEDS_BIRTH"
REQUIRED = ("subject_id", "time", "code")

# Interval bins as (from seconds, below seconds, label), months of 30 days, and the repeatable label.
INTERVAL_BINS = (
    (300, 900, "INT_5m_15m"),
    (900, 3600, "INT_15m_1h"),
    (3600, 7200, "INT_1h_2h"),
    (7200, 21600, "INT_2h_6h"),
    (21600, 43200, "INT_6h_12h"),
    (43200, 86400, "INT_12h_1d"),
    (86400, 259200, "INT_1d_3d"),
    (259200, 604800, "INT_3d_1w"),
    (604800, 1209600, "INT_1w_2w"),
    (1209600, 2592000, "INT_2w_1mt"),
    (2592000, 7776000, "INT_1mt_3mt"),
    (7776000, 15552000, "INT_3mt_6mt"),
)
HALF_YEAR, HALF_YEAR_SECONDS = "INT_6mt", 15_552_000

# Demographic labels and codes.
SEX_LABELS = ("DEMO_SEX_MALE", "DEMO_SEX_FEMALE", "DEMO_SEX_UNKNOWN")
MALE_CODES, FEMALE_CODES, UNKNOWN_CODES = ("8507",), ("8532",), ()
FIRST_YEAR, LAST_YEAR, BAND = 1970, 2079, 5
AGE_LABELS = (*(f"DEMO_AGE_{a}_{a + BAND - 1}" for a in range(0, 100, BAND)), "DEMO_AGE_100P")
YEAR_LABELS = tuple(f"DEMO_YEAR_{y}_{y + BAND - 1}" for y in range(FIRST_YEAR, LAST_YEAR + 1, BAND))
SECONDS_A_DAY, SECONDS_A_YEAR = 86_400, 31_557_600

# Prefixes of events that move to a visit's end, and the visit's own codes and stages.
MOVED_PREFIXES = ("DIAGNOSIS/", "PROCEDURE/", "OBSERVATION/")
VISIT_PATTERN, START_STAGE, END_STAGE = "VISIT", "start", "end"

# White space as Unicode defines it for text normalisation.
WHITE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

UNKNOWN_QUANTILE, UNKNOWN_STAGE = "Q:UNK", "STAGE:UNK"
IGNORED = -100


def interval_labels() -> list[str]:
    return [label for _, _, label in INTERVAL_BINS] + [HALF_YEAR]


def demographic_labels() -> list[str]:
    return [*SEX_LABELS, *AGE_LABELS, *YEAR_LABELS]


def quantile_labels(quantiles: int) -> list[str]:
    return [f"Q:{i}" for i in range(1, quantiles + 1)] + [UNKNOWN_QUANTILE]
