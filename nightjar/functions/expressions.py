"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_SECONDS = 30
SLEEP_STAGES = ("N1", "N2", "N3", "REM")

# Integer code of each stage string.
STAGE_CODES = {"W": 0, "N1": 1, "N2": 2, "N3": 3, "REM": 5, "?": 9}

# Bit of each scored respiratory event kind.
EVENT_BITS = {"Obstructive apnea": 1, "Central apnea": 2, "Mixed apnea": 4, "Hypopnea": 8}

# Severity tiers, events per hour, left-closed.
SEVERITY_EDGES = (5.0, 15.0, 30.0)
SEVERITY_LABELS = ("none", "mild", "moderate", "severe")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_sleep(stage: Column | str) -> Column:
    """True for the four sleep stages, false for wake and unscored, never NULL."""
    return F.coalesce(col(stage).isin(*SLEEP_STAGES), F.lit(False))


def missing_to_null(x: Column | str) -> Column:
    """NaN and infinities count as missing everywhere."""
    x = col(x)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def exact_mean(x: Column | str) -> Column:
    """Aggregate mean that no order of the rows can change: summed in fixed point, ten decimals; missing values are left out.

    Equal sets of values have equal means, so ties stay ties.
    """
    x = missing_to_null(x).cast("decimal(28,10)")
    return F.try_divide(F.sum(x).cast("double"), F.count(x))


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])


def encode_stage(stage: Column | str) -> Column:
    """Stage code; an unknown stage string is an error."""
    code = F.element_at(literal_map(STAGE_CODES), col(stage))
    bad = F.raise_error(F.concat(F.lit("unknown stage label: "), F.coalesce(col(stage), F.lit("NULL"))))
    return F.when(code.isNotNull(), code).otherwise(bad.cast("int"))


def decode_stage(code: Column | str) -> Column:
    return F.element_at(literal_map({v: k for k, v in STAGE_CODES.items()}), col(code))


def event_bit(kind: Column | str) -> Column:
    """Bit of an event kind; an unknown kind is an error."""
    bit = F.element_at(literal_map(EVENT_BITS), col(kind))
    bad = F.raise_error(F.concat(F.lit("unknown event kind: "), F.coalesce(col(kind), F.lit("NULL"))))
    return F.when(bit.isNotNull(), bit).otherwise(bad.cast("int"))


def digitize(x: Column | str, edges) -> Column:
    """Number of edges at or below ``x`` (left-closed bins); NULL stays NULL."""
    x = col(x)
    out = F.lit(0)
    for e in edges:
        out = out + (x >= F.lit(float(e))).cast("int")
    return out


def severity_tier(rate: Column | str) -> Column:
    return digitize(rate, SEVERITY_EDGES)


def cut_label(x: Column | str, edges, labels) -> Column:
    """Left-closed labelled bins over (-inf, e0), [e0, e1), ..., [en, inf)."""
    x = col(x)
    out = F.lit(labels[-1])
    for e, label in reversed(list(zip(edges, labels[:-1]))):
        out = F.when(x < F.lit(float(e)), F.lit(label)).otherwise(out)
    return F.when(x.isNotNull(), out)


def subject_number(identifier: Column | str) -> Column:
    """Trailing digits of an id such as ``prefix-200001`` as an integer, NULL when there are none."""
    digits = F.regexp_extract(col(identifier).cast("string"), r"(\d+)$", 1)
    return F.when(digits != "", digits.cast("bigint"))


def hash_draw(*parts: Column | str) -> Column:
    """A 60-bit draw from the md5 of the parts joined by ':'; the same in every engine."""
    text = F.concat_ws(":", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def prior_correct(p: Column | str, weight: Column | float) -> Column:
    """Divide the odds by the training class weight."""
    p = F.greatest(F.least(col(p), F.lit(1 - 1e-9)), F.lit(1e-9))
    w = F.lit(weight) if isinstance(weight, (int, float)) else weight
    odds = p / (F.lit(1.0) - p) / w
    return odds / (F.lit(1.0) + odds)


def logit(p: Column | str, eps: float = 1e-6) -> Column:
    p = F.greatest(F.least(col(p), F.lit(1 - eps)), F.lit(eps))
    return F.log(p / (F.lit(1.0) - p))


def normal_cdf(z: Column) -> Column:
    """Standard normal CDF by Abramowitz-Stegun 26.2.17 (absolute error below 7.5e-8)."""
    # The published polynomial.
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    a = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * a)
    poly = F.lit(0.0)
    for coef in reversed(b):
        poly = t * (F.lit(coef) + poly)
    upper = F.exp(-a * a / 2) / F.sqrt(F.lit(2 * 3.141592653589793)) * poly
    return F.when(z >= 0, F.lit(1.0) - upper).otherwise(upper)


def dominant_of(fractions: dict[str, Column]) -> Column:
    """Name of the largest non-null fraction, first name on ties, NULL if all are missing."""
    ranked = F.array(*[
        F.struct(F.coalesce(c.cast("double"), F.lit(-1.0)).alias("v"), F.lit(-i).alias("i"), F.lit(n).alias("n"))
        for i, (n, c) in enumerate(fractions.items())
    ])
    seen = F.coalesce(*fractions.values()).isNotNull()
    return F.when(seen, F.array_max(ranked)["n"])


def posture(fractions: dict[str, Column]) -> Column:
    """Dominant body position with left and right folded into lateral."""
    name = dominant_of(fractions)
    return F.when(name.isNull(), "unknown").when(name.isin("left", "right"), "lateral").otherwise(name)


# ---- thirty per-second probabilities -> one epoch score ---------------------------------------

AGGREGATORS = ("mean", "max", "k10", "c10")


def seconds_to_epoch(p: Column | str, rule: str) -> Column:
    """``mean``, ``max``, tenth largest, or the best ten consecutive seconds (max of window minima)."""
    p = col(p)
    if rule == "mean":
        return F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x) / F.size(p)
    if rule == "max":
        return F.array_max(p)
    if rule == "k10":
        return F.element_at(F.sort_array(p, asc=False), 10)
    if rule == "c10":
        starts = F.sequence(F.lit(1), F.size(p) - 9)
        return F.array_max(F.transform(starts, lambda i: F.array_min(F.slice(p, i, 10))))
    raise ValueError(f"unknown aggregator {rule!r}; choose from {AGGREGATORS}")
