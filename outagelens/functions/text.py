"""Text columns: cleaning, tokens, similarity and display forms."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from outagelens.functions.rules import case_when, literal


MIN_WORD = 3


def clean_text(text: Column) -> Column:
    """Dashes and underscores become blanks, runs of blanks collapse; missing stays missing."""
    return F.trim(F.regexp_replace(F.translate(text, "-_", "  "), r"\s+", " "))


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; one empty word for a missing text."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", " ")), " ")


def tokens(text: Column, stop_words: Iterable[str]) -> Column:
    """The words of at least three characters that are not stop words."""
    stop = F.split(F.lit(" ".join(stop_words)), " ")
    return F.filter(words_of(text), lambda word: (F.length(word) >= MIN_WORD) & ~F.array_contains(stop, word))


def prepared_text(text: Column, stop_words: Iterable[str]) -> Column:
    """The tokens as one blank-separated text; empty when nothing is left."""
    return F.array_join(tokens(text, stop_words), " ")


def edit_similarity(left: str, right: str) -> str:
    """100 for equal texts, falling with the edit distance over the longer length."""
    longest = f"greatest(length({left}), length({right}))"
    return f"if({longest} = 0, 100D, 100D * (1D - levenshtein({left}, {right}) / cast({longest} AS double)))"


def closest_label(text: str, labels: list[str], threshold: float, default: str) -> str:
    """Most similar label (the first among equals) when it reaches the threshold."""
    scored = ", ".join(
        f"struct({edit_similarity(text, literal(label.lower()))} AS score, {-place} AS place, {literal(label)} AS label)"
        for place, label in enumerate(labels)
    )
    best = f"greatest({scored})"
    return f"if({best}.score >= {float(threshold)}D, {best}.label, {literal(default)})"


def truncated(text: Column, max_length: int = 50, suffix: str = "...") -> Column:
    """At most max_length characters, the suffix included."""
    return F.when(F.length(text) <= max_length, text).otherwise(
        F.concat(F.substring(text, 1, max_length - len(suffix)), F.lit(suffix))
    )


def fixed_point(number: Column, decimals: int) -> Column:
    """A number with a fixed count of decimals (up to 3), rounded from its exact binary value."""
    scale, one = 10**decimals, 2**52
    size = F.abs(number)
    whole = F.floor(size)
    scaled = (size - whole) * F.lit(float(one))
    steps = F.floor(scaled)
    part = steps * F.lit(scale)
    digits = whole * F.lit(scale) + F.shiftright(part, 52)
    past_half = (part.bitwiseAND(F.lit(one - 1)) - F.lit(one // 2)) + (scaled - steps) * F.lit(scale)
    rounded = digits + F.when((past_half > 0) | ((past_half == 0) & (digits % 2 == 1)), 1).otherwise(0)
    sign = F.when(number < 0, "-").otherwise("")
    if decimals == 0:
        return F.concat(sign, rounded.cast("string"))
    fraction = F.lpad((rounded % F.lit(scale)).cast("string"), decimals, "0")
    return F.concat(sign, F.floor(rounded / F.lit(scale)).cast("string"), F.lit("."), fraction)


def magnitude(number: Column, decimals: int = 1) -> Column:
    """1234 -> 1.2K, with K, M and B; smaller numbers keep their plain form."""
    value = number.cast("double")
    size = F.abs(value)
    return (
        F.when(size >= 1e9, F.concat(fixed_point(value / 1e9, decimals), F.lit("B")))
        .when(size >= 1e6, F.concat(fixed_point(value / 1e6, decimals), F.lit("M")))
        .when(size >= 1e3, F.concat(fixed_point(value / 1e3, decimals), F.lit("K")))
        .otherwise(number.cast("string"))
    )


def short_site_name(site: Column) -> Column:
    """The part of a site name behind its second underscore."""
    return F.element_at(F.split(site, "_", 3), -1)


def without_prefix(text: Column, literal: str) -> Column:
    return F.replace(text, F.lit(literal), F.lit(""))


def month_label(moment: Column) -> Column:
    return F.date_format(moment, "MMM yyyy")


def tier_label(tier: str, urgency_labels: dict[str, str]) -> Column:
    """'3.2' -> '3.2 (Degradation)'; an unknown urgency shows its own number."""
    urgency = "element_at(split(tier, '[.]'), -1)"
    meaning = case_when(
        ((f"{urgency} = {literal(number)}", literal(label)) for number, label in urgency_labels.items()), urgency
    )
    return F.concat(F.col(tier), F.lit(" ("), F.expr(meaning.replace("tier", f"`{tier}`")), F.lit(")"))
