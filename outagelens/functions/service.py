"""Row rules of the service model: keys, hours, verdicts, teams, pseudonyms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from outagelens import fixed_values as fixed
from outagelens.functions.nulls import present_and
from outagelens.functions.rules import (
    case_when, first_containing, first_prefix, is_any, label_lookup, literal, lookup, named,
)

def number_or_missing(text: Column) -> Column:
    return text.try_cast("double")


def plus_hours(moment: Column, hours: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(moment) + F.round(hours * 3.6e9).cast("long"))


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(3.6e9)


def priority_urgency(priority: Column, urgency: Column) -> Column:
    """'3.2' from the numbers 3 and 2."""
    return F.concat_ws(".", priority.cast("int").cast("string"), urgency.cast("int").cast("string"))


def sla_hours(tier: str) -> Column:
    """Hours allowed for a tier; tiers without an own limit get the default."""
    return F.expr(lookup(f"trim({named(tier)})", fixed.SLA_HOURS, literal(fixed.SLA_DEFAULT_HOURS)))


def sla_budget(tier: str) -> Column:
    """Hours allowed for a tier, missing for tiers without an own limit."""
    return F.expr(lookup(f"trim({named(tier)})", fixed.SLA_HOURS))


def sla_verdict(tier: str, hours: str) -> Column:
    """1 within the limit, 0 beyond it, missing without hours."""
    return F.when(F.col(hours).isNotNull(), (F.col(hours) <= sla_hours(tier)).cast("int"))


def timestamps_hold(delay: Column, field: Column, duration: Column) -> Column:
    """Both phases non-negative and the delay no longer than the outage."""
    return present_and((field >= 0) & (delay >= 0) & (delay <= duration))


def blank_to_missing(text: str) -> Column:
    return F.expr(case_when([(is_any(named(text), fixed.BLANK_TOKENS), "NULL")], named(text)))


def resolution_path(owner: Column, lead: Column) -> Column:
    """Who closed the ticket, from which of the two names is present."""
    automatic, remote, field = fixed.PATH_ORDER
    return F.when(owner.isNull(), automatic).when(lead.isNull(), remote).otherwise(field)


def issuer_team(team: str) -> Column:
    known = first_containing(f"upper({named(team)})", fixed.ISSUER_TEAMS, "'Other'")
    return F.expr(case_when([(f"{named(team)} IS NULL", "'Unknown'")], known))


def owner_group(code: str) -> Column:
    """Function of a work-order group: exact code, then prefix, then Other."""
    trimmed = f"trim({named(code)})"
    blank = f"({named(code)} IS NULL OR {is_any(trimmed, fixed.OWNER_GROUP_BLANKS)})"
    by_prefix = first_prefix(f"upper({trimmed})", fixed.OWNER_GROUP_PREFIXES, "'Other'")
    return F.expr(case_when([(blank, "'Unknown'")], label_lookup(trimmed, fixed.OWNER_GROUPS, by_prefix)))


def equipment_category(ne_type: str) -> Column:
    key = f"upper(trim({named(ne_type)}))"
    return F.expr(label_lookup(key, fixed.NE_CATEGORIES, literal(fixed.NE_DEFAULT_CATEGORY)))


def region_of(contact_group: str, area: str, description: str) -> Column:
    """Region from the group code, else the area code, else the description."""
    group, code, text = (f"upper(coalesce({named(name)}, ''))" for name in (contact_group, area, description))
    from_description = first_containing(text, fixed.REGION_BY_DESCRIPTION, literal(fixed.UNKNOWN_REGION))
    from_area = first_containing(code, fixed.REGION_BY_AREA, from_description)
    return F.expr(first_containing(group, fixed.REGION_BY_GROUP, from_area))


def short_hash(text: Column) -> Column:
    """First ten hex digits of the SHA-256; missing becomes Unknown."""
    return F.coalesce(F.substring(F.sha2(text, 256), 1, 10), F.lit("Unknown"))


def person_code(name: Column) -> Column:
    """Stable pseudonym of a person; missing and 'Unknown' stay Unknown."""
    code = F.concat(F.lit("ENG_"), F.substring(F.sha2(name, 256), 1, 8))
    return F.when(name.isNull() | (name == "Unknown"), F.lit("Unknown")).otherwise(code)


def site_name(region: Column, city: Column, hashed_area: Column) -> Column:
    return F.concat(
        F.replace(region, F.lit(" "), F.lit("")), F.lit("_"),
        F.coalesce(city, F.lit("Unknown")), F.lit("_"),
        F.substring(hashed_area, 1, 8),
    )


def confidence_tier(score: str) -> Column:
    tiers = ((f"{named(score)} >= {limit}D", literal(tier)) for limit, tier in fixed.CONFIDENCE_TIERS)
    return F.expr(case_when(tiers, literal(fixed.LOWEST_CONFIDENCE)))


def site_complexity(type_count: Column, has_core: Column) -> Column:
    return (
        F.when(has_core | (type_count >= 6), "High")
        .when(type_count >= 3, "Medium")
        .otherwise("Low")
    )


def rating(share: str) -> Column:
    """Rating of a mean rank given as a share of the number of ranked groups."""
    ratings = ((f"{named(share)} <= {limit}D", literal(label)) for limit, label in fixed.RATINGS)
    return F.expr(case_when(ratings, literal(fixed.LOWEST_RATING)))


def deviation_flag(value: Column, reference: Column, margin: Column | float) -> Column:
    """below / above / within an absolute margin around the reference."""
    margin = margin if isinstance(margin, Column) else F.lit(float(margin))
    return F.when(value < reference - margin, "below").when(value > reference + margin, "above").otherwise("within")


def ratio_flag(value: Column, reference: Column, low: float, high: float) -> Column:
    """below / above / within a band given as multiples of the reference."""
    return F.when(value > reference * high, "above").when(value < reference * low, "below").otherwise("within")


def delta_verdict(delta: Column, material: float = 20, contributing: float = 5) -> Column:
    return F.when(delta > material, "material").when(delta > contributing, "contributing").otherwise("small")


def city_class(city: Column, business_cities: list[str]) -> Column:
    return F.when(F.upper(city).isin(business_cities), "CBD").otherwise("Non-CBD")


def zone_exposure(zone: str) -> Column:
    return F.expr(lookup(named(zone), fixed.ZONE_EXPOSURE))
