"""Decision rules as column expressions: validity, novelty, attention, quiet hours, recency, units."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ARRIVALS = ("created", "content_updated", "restored")
_MASS = {"kg": (1.0, 0.0), "g": (0.001, 0.0), "lb": (0.45359237, 0.0)}
_HEAT = {"C": (1.0, 0.0), "F": (5 / 9, -32 * 5 / 9)}
# Canonical unit of each metric, and scale and offset of the units that convert to it.
UNITS = {
    "mass": ("kg", _MASS),
    "weight": ("kg", _MASS),
    "body_mass": ("kg", _MASS),
    "temperature": ("C", _HEAT),
    "body_temperature": ("C", _HEAT),
    "heart_rate": ("bpm", {"bpm": (1.0, 0.0)}),
    "hrv": ("ms", {"ms": (1.0, 0.0)}),
    "systolic_bp": ("mmHg", {"mmHg": (1.0, 0.0)}),
    "diastolic_bp": ("mmHg", {"mmHg": (1.0, 0.0)}),
}


def valid_at(start: Column, end: Column, at: Column) -> Column:
    """start <= at < end, a null bound being open; an unknown time is valid only where there is no bound."""
    known = F.coalesce(start <= at, F.lit(True)) & F.coalesce(at < end, F.lit(True))
    return F.when(at.isNull(), start.isNull() & end.isNull()).otherwise(known)


def interval_sane(start: Column, end: Column) -> Column:
    """Whether an interval ends after it starts; open ones do."""
    return F.coalesce(end > start, F.lit(True))


def backoff(attempts: Column, first: int = 30, most: int = 3600) -> Column:
    """Seconds to wait after so many failures: doubled each time, up to most."""
    return F.least(F.lit(float(most)), first * F.pow(F.lit(2.0), F.least(attempts, F.lit(40)))).cast("long")


def within(at: Column, after: Column | None, before: Column | None) -> Column:
    """after <= at < before; an unknown time passes only where there is no bound."""
    out = F.lit(True)
    if after is not None:
        out = out & (at >= after)
    if before is not None:
        out = out & (at < before)
    return F.coalesce(out, F.lit(False))


def context_holds(stored: Column, given: Column) -> Column:
    """Whether every entry of the stored map stands in the given one."""
    return F.forall(F.map_entries(stored), lambda e: F.coalesce(F.try_element_at(given, e["key"]) == e["value"], F.lit(False)))


def quiet(at: Column, start: str, end: str) -> Column:
    """Whether the minute of the day lies in a quiet window; it may span midnight, and equal bounds are the whole day."""
    a, b = (int(h) * 60 + int(m) for h, m in (start.split(":"), end.split(":")))
    now = F.hour(at) * 60 + F.minute(at)
    if a == b:
        return at.isNotNull()
    return (now >= a) & (now < b) if a < b else (now >= a) | (now < b)


def novelty(role: Column, hint: Column, occurred: Column, now: Column) -> Column:
    """live, historical, recovered or uncertain: the provider's hint first, the pass second; a date only unsettles."""
    doubtful = occurred.isNull() | (occurred > now + F.expr("INTERVAL 1 DAY"))
    by_role = F.when(role == "backfill", "historical").when(role == "reconcile", "recovered").otherwise("uncertain")
    return F.when(hint == "historical", "historical").when(hint == "fresh", F.when(doubtful, "uncertain").otherwise("live")).otherwise(by_role)


def attention(kind: Column, novel: Column, origin: Column, purpose: str) -> Column:
    """next_turn, background_prompt, background_digest or record_only."""
    digest = "background_digest" if purpose == "background" else "record_only"
    live = "next_turn" if purpose == "foreground" else "background_prompt"
    arrival = F.when(novel == "live", live).when(novel.isin("recovered", "uncertain"), digest).otherwise("record_only")
    return (
        F.when((origin == "derived") & (kind != "enrichment"), "record_only")
        .when(kind.isin("backfill_progress", "backfill_complete"), digest)
        .when(~kind.isin(*ARRIVALS, "enrichment"), "record_only")
        .otherwise(arrival)
    )


def recency(score: Column, occurred: Column, now: Column, weight: float = 1.0, half_life_days: float = 365.0) -> Column:
    """score * (1 + weight * 0.5 ** (age / half life)); an unknown time leaves the score."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(occurred.cast("timestamp"))) / F.lit(86_400_000_000.0))
    return F.when(occurred.isNull(), score).otherwise(score * (1 + weight * F.pow(F.lit(0.5), age / half_life_days)))


def canonical(metric: Column, unit: Column, value: Column) -> Column:
    """A measurement in its metric's canonical unit; null for a unit that is not registered."""
    keys = [(f"{m}/{u}", scale, offset) for m, (_, units) in UNITS.items() for u, (scale, offset) in units.items()]
    held = F.create_map(*(x for k, scale, offset in keys for x in (F.lit(k), F.array(F.lit(scale), F.lit(offset)))))
    found = F.try_element_at(held, F.concat_ws("/", metric, unit))
    return value * found[0] + found[1]


def accepted(shared_terms: Column, similarity: Column, floor: float = 0.5) -> Column:
    """The relevance gate: a shared content term, or a similarity at the floor."""
    return (shared_terms > 0) | F.coalesce(similarity >= floor, F.lit(False))


def source_allowed(source: Column, allowed: Column) -> Column:
    """Whether a list of sources holds this one, or a star."""
    return F.arrays_overlap(allowed, F.array(source, F.lit("*")))
