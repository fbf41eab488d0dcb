"""Column functions for scores, confidences and validity in time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Floors, saturations and confidence bands of the retrieval tiers.
PHI_FLOOR, PHI_FULL, BAND_B = 0.06, 0.30, (0.60, 0.95)
EMB_FLOOR, EMB_FULL, BAND_E = 0.06, 0.20, (0.40, 0.70)
GIST_FLOOR, GIST_FULL, BAND_C = 0.55, 1.00, (0.30, 0.60)
NEAREST_CAP = 0.3
LEXICAL_BAND = (0.55, 0.95)
MAX_CUE_CONCEPTS, SCAN_HEAD = 8, 512
HALF_LIFE_S = 604_800.0
BELIEF_STEP, WITHDRAW_BELOW = 0.15, 0.5
TIERS = ["Exact", "Lexical", "Similarity", "Semantic", "Gist", "NearestNeighbor"]


def idf(n: Column, df: Column) -> Column:
    """ln(n / df) + 0.5; a term that no record holds counts as held by one."""
    return F.log(n.cast("double") / F.greatest(df, F.lit(1))) + 0.5


def band(score: Column, low: float, high: float, out: tuple[float, float]) -> Column:
    """Linear map of [low, high] to a confidence band, clamped to it."""
    share = (score - low) / (high - low)
    return F.least(F.lit(out[1]), F.greatest(F.lit(out[0]), out[0] + (out[1] - out[0]) * share))


def lexical_confidence(score: Column, achievable: Column) -> Column:
    """Share of the cue's reachable weight, in the lexical band."""
    return F.when(achievable > 0, band(score / achievable, 0.0, 1.0, LEXICAL_BAND)).otherwise(LEXICAL_BAND[0])


def nearest_confidence(similarity: Column) -> Column:
    """Confidence of a nearest neighbour without any other match."""
    return F.greatest(F.lit(0.0), F.least(F.lit(NEAREST_CAP), similarity * NEAREST_CAP))


def goal_boost(confidence: Column, weight: Column, similarity: Column) -> Column:
    """Confidence drawn towards 1 by the largest similarity to an active goal."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence + weight * similarity * (1 - confidence)))


def recency(anchor: Column, start: Column, half_life_s: Column | float = HALF_LIFE_S) -> Column:
    """exp(-|anchor - start| / half life) in whole seconds; a half life below 1 s counts as 1 s."""
    half = F.greatest(F.lit(1.0), half_life_s if isinstance(half_life_s, Column) else F.lit(float(half_life_s)))
    seconds = F.abs(F.unix_timestamp(anchor) - F.unix_timestamp(start))
    return F.exp(-seconds / half)


def revised(confidence: Column, supports: Column) -> Column:
    """One step of a belief's confidence, in [0.01, 0.99]."""
    step = BELIEF_STEP * (1 - 2 * confidence * (1 - confidence))
    return F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.when(supports, confidence + step).otherwise(confidence - step)))


def geomean(values: Column) -> Column:
    """Geometric mean of the positive values of a group; 0.5 without any. An aggregate."""
    return F.coalesce(F.exp(F.avg(F.when(values > 0, F.log(values)))), F.lit(0.5))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 on unequal length or a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)


def valid_at(t: Column, start: Column | str = "valid_start", end: Column | str = "valid_end") -> Column:
    """start <= t < end, an open end reaching forever. Null t or start gives false."""
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    return F.coalesce((start <= t) & (end.isNull() | (t < end)), F.lit(False))


def overlaps(low: Column, high: Column, start: Column | str = "valid_start", end: Column | str = "valid_end") -> Column:
    """Overlap with the window [low, high], both ends inside; an open end is a point at its start."""
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    return F.coalesce((start <= high) & (F.coalesce(end, start) >= low), F.lit(False))


def age_days(now: Column, then: Column) -> Column:
    """Whole days between two times."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 86_400)


def day_key(t: Column) -> Column:
    """yyyy-MM-dd of a time."""
    return F.date_format(t, "yyyy-MM-dd")


def _day_range(start: Column, days: int) -> Column:
    first = F.to_timestamp(start)
    return F.struct(first.alias("start"), (F.to_timestamp(F.date_add(start, days)) - F.expr("interval 1 second")).alias("end"))


def yesterday(now: Column) -> Column:
    """The day before `now`, to its last second."""
    return _day_range(F.date_sub(F.to_date(now), 1), 1)


def last_weekend(now: Column) -> Column:
    """The latest Saturday strictly before today and its Sunday."""
    return _day_range(F.next_day(F.date_sub(F.to_date(now), 8), "SAT"), 2)


def this_weekend(now: Column) -> Column:
    """The coming Saturday, today if it is one, and its Sunday."""
    return _day_range(F.next_day(F.date_sub(F.to_date(now), 1), "SAT"), 2)


# Number words of time anchors.
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]


def number_words(text: Column) -> Column:
    """Cardinals one to ten before a space, as digits."""
    for i, w in enumerate(NUMBER_WORDS, 1):
        text = F.replace(text, F.lit(f"{w} "), F.lit(f"{i} "))
    return text


def time_anchor(text: Column, now: Column) -> Column:
    """struct<start, end> that a whole text names relative to `now`, or null.

    Knows yesterday, today, tomorrow, now, last and this weekend, "N units ago", "in N units", "N units from
    now" and dates in ISO or US form. Months and years move on the calendar.
    """
    said = F.array(number_words(F.lower(F.trim(text))))
    # a lambda binds the cleaned text, and another one the parsed amount: written out, they would be repeated dozens of times
    return F.transform(said, lambda t: _anchor(t, now))[0]


# An amount of time before or after now.
AMOUNT = r"^(?:in )?(\d{1,6}) (second|minute|hour|day|week|month|year)s?(?: ago| from now)?$"


def _anchor(t: Column, now: Column) -> Column:
    ahead = t.startswith("in ") | t.endswith(" from now")
    sign = F.when(t.endswith(" ago") & ~t.startswith("in "), -1).when(ahead, 1)
    amount = F.array(F.struct((F.try_to_number(F.regexp_extract(t, AMOUNT, 1), F.lit("999999")).cast("int") * sign).alias("n"), F.regexp_extract(t, AMOUNT, 2).alias("unit")))
    shifted = F.transform(amount, lambda a: _shifted(now, a["n"], a["unit"]))[0]
    dated = F.coalesce(
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.upper(t), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")),
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(t, F.lit("M/d/yyyy")),
        F.try_to_timestamp(F.initcap(t), F.lit("d MMMM yyyy")), F.try_to_timestamp(F.initcap(t), F.lit("MMMM d, yyyy")),
    )
    point = F.when(t == "now", now).when(t == "today", F.to_timestamp(F.to_date(now))).when(
        t == "tomorrow", F.to_timestamp(F.date_add(F.to_date(now), 1))
    ).otherwise(F.coalesce(shifted, dated))
    at = F.transform(F.array(point), lambda p: F.when(p.isNotNull(), F.struct(p.alias("start"), F.lit(None).cast("timestamp").alias("end"))))[0]
    return (
        F.when(t == "yesterday", yesterday(now)).when(t == "last weekend", last_weekend(now)).when(t == "this weekend", this_weekend(now))
        .otherwise(at)
    )


def _shifted(now: Column, n: Column, unit: Column) -> Column:
    zero = F.lit(0)
    of = lambda u: F.when(unit == u, n).otherwise(zero)
    clock = now + F.make_dt_interval(of("day") + of("week") * 7, of("hour"), of("minute"), of("second").cast("decimal(18,6)"))
    return F.when(n.isNotNull(), F.when(unit.isin("month", "year"), now + F.make_ym_interval(of("year"), of("month"))).otherwise(clock))
