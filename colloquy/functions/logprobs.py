"""Column functions over token log-probabilities: array<struct<token, logprob>>, the likeliest first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "ABCDEFGHIJ"


def spellings(letter: str) -> list[str]:
    """The tokens that stand for an answer letter. Marks that tokenizers put before a word."""
    return [letter, "▁" + letter, "Ġ" + letter, " " + letter, letter.lower()]


def matching(top: Column, names: list[str]) -> Column:
    return F.filter(top, lambda t: t["token"].isin(*names))


def choice_struct(top: Column, n: int = 4) -> Column:
    """A field for each letter: the log-probability of its first token in the list, null without one. One pass over the list."""
    none = F.struct(*(F.lit(None).cast("double").alias(c) for c in LETTERS[:n]))
    return F.aggregate(top, none, lambda s, t: F.struct(*(F.coalesce(s[c], F.when(t["token"].isin(*spellings(c)), t["logprob"].cast("double"))).alias(c) for c in LETTERS[:n])))


def struct_map(s: Column, n: int = 4) -> Column:
    """letter -> value of the fields that aren't null."""
    return F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(c).alias("k"), s[c].alias("v")) for c in LETTERS[:n])), lambda p: p["v"].isNotNull()))


def choice_logprobs(top: Column, n: int = 4) -> Column:
    """letter -> log-probability of its first token in the list; letters without one are left out."""
    return bound(choice_struct(top, n), lambda s: struct_map(s, n))


def softmax_struct(s: Column, n: int = 4) -> Column:
    """The shares of a struct of log-probabilities (a column that is there already) among the letters that are present, by plain arithmetic."""
    top = F.greatest(*(s[c] for c in LETTERS[:n])) if n > 1 else s["A"]
    up = {c: F.exp(s[c] - top) for c in LETTERS[:n]}
    whole = sum((F.coalesce(u, F.lit(0.0)) for u in up.values()), F.lit(0.0))
    return F.struct(*((u / whole).alias(c) for c, u in up.items()))


def choice_probs(top: Column, n: int = 4, digits: bool = False) -> Column:
    """letter -> probability, those of all its tokens added up; with digits, 1 stands for A and so on."""
    names = lambda k: spellings(LETTERS[k]) + ([str(k + 1), f" {k + 1}"] if digits else [])
    total = lambda k: F.aggregate(matching(top, names(k)), F.lit(0.0), lambda s, t: s + F.exp(t["logprob"]))
    pairs = F.array(*(F.struct(F.lit(LETTERS[k]).alias("k"), total(k).alias("v")) for k in range(n)))
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"] > 0))


def digit_probs(top: Column, scale: int = 5) -> Column:
    """digit -> probability of its first token."""
    pairs = F.array(*(F.struct(F.lit(d).alias("k"), F.exp(F.get(matching(top, [str(d), f" {d}", f"▁{d}", f"Ġ{d}"]), F.lit(0))["logprob"]).alias("v")) for d in range(1, scale + 1)))
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def total(probs: Column) -> Column:
    return F.aggregate(F.map_values(probs), F.lit(0.0), lambda s, p: s + p)


def bound(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax(logprobs: Column) -> Column:
    """letter -> share among the letters that are present."""
    up = bound(F.array_max(F.map_values(logprobs)), lambda top: F.transform_values(logprobs, lambda _, v: F.exp(v - top)))
    sized = lambda u: F.struct(u.alias("u"), total(u).alias("t"))
    return bound(bound(up, sized), lambda x: F.transform_values(x["u"], lambda _, v: v / x["t"]))


def raw_probs(logprobs: Column) -> Column:
    return F.transform_values(logprobs, lambda _, v: F.exp(v))


def choice_mass(stored: Column, logprobs: Column) -> Column:
    """The stored mass of all choices, else what the log-probabilities add up to."""
    return F.coalesce(stored, total(raw_probs(logprobs)))


def expectation(probs: Column, values: Column) -> Column:
    """sum of p(letter) * value(letter) over the letters that have a value."""
    return F.aggregate(F.map_entries(probs), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(values, e["key"]).cast("double"), F.lit(0.0)))


def trait_score(probs: Column, mapping: Column) -> Column:
    """The expected value as a share of the largest."""
    return F.try_divide(expectation(probs, mapping), F.array_max(F.map_values(mapping)).cast("double"))


def answer_score(letter: Column, mapping: Column, reverse: Column) -> Column:
    """value / largest, or (largest + 1 - value) / largest for reversed items; null for an unknown letter."""
    top = F.array_max(F.map_values(mapping)).cast("double")
    value = F.try_element_at(mapping, letter).cast("double")
    return F.try_divide(F.when(reverse, top + 1 - value).otherwise(value), top)


def expected_rating(probs: Column, scale: int = 5, reverse: Column | None = None) -> Column:
    """sum of d * p(d), by the probability that falls on digits; (scale + 1) - x where reversed; null without any."""
    x = F.try_divide(F.aggregate(F.map_entries(probs), F.lit(0.0), lambda s, e: s + e["value"] * e["key"].cast("double")), total(probs))
    return x if reverse is None else F.when(reverse, scale + 1 - x).otherwise(x)


def logit(p: Column, epsilon: float = 0.005) -> Column:
    held = F.greatest(F.lit(epsilon), F.least(F.lit(1 - epsilon), p))
    return F.log(held / (1 - held))


def pair_code(p_high: Column) -> Column:
    """A forced choice between two poles as -1 to 1; 0 without a probability."""
    return F.coalesce(2 * p_high - 1, F.lit(0.0))


def passes_mass(mass: Column, choices: Column, least: float = 0.75, dynamic: bool = True) -> Column:
    """Whether the mass of the choices reaches one choice's even share (if dynamic) and the fixed least."""
    return ((mass >= 1 / choices) & (mass >= least)) if dynamic else (mass >= least)
