"""Column functions over texts: answer parsers, noisy JSON, densities, editors, names."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The ways an answer letter is given, in order of trust; each has the letter as its first group. The first
# match of each way counts; a letter that isn't valid leaves it to the next way.
ANSWER_PATTERNS = [
    r"(?iU)ANSWER\s*:\s*([A-E])\b",
    r"(?iU)^([A-E])\)",
    r"(?iU)^([A-E])\s*[\n\r]",
    r"(?iU)(?:correct\s+)?answer\s+is\s*:?\s*([A-E])\b",
    r"(?iU)\b([A-E])\)\s+is\s+the\s+correct\s+answer",
    r"(?iU)correct\s+answer\s+is\s+([A-E])\.",
]
# The ways one of four choices is given.
CHOICE_PATTERNS = [
    r"(?iU)ANSWER\s*:\s*([A-D])\b",
    r"(?iU)^([A-D])\)",
    r"(?iU)^([A-D])\s*$",
    r"(?iU)^([A-D])\s*[\n\r)]",
    r"(?iU)(?:correct\s+)?answer\s+is\s*:?\s*([A-D])\b",
]
# The ways a 1-5 rating is given; the second stays on one line.
LIKERT_PATTERNS = [r"(?U)^[\s*_]*([1-5])\b", r"(?iU)\b(?:rate|rating|score|answer|respond|give)\b[^\n]*?([1-5])\b", r"(?U)\b([1-5])\b"]
# ASCII punctuation, and the order in which vowels replace each other.
PUNCTUATION = r"""[!-/:-@\[-`{-~]"""
VOWELS = ("aeiouAEIOU", "eiouaEIOUA")
#: What (?U)\s matches.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(SPACES))


def found(text: Column, pattern: str) -> Column:
    """The first group of the first match, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def first_letter(text: Column, patterns: list[str], drop: str = "", word: str = "") -> Column:
    """The letter of the first pattern that gives one which isn't in `drop`; a pattern is tried once, and only if those before it give none.

    word: patterns with this word, in capitals here, are tried on texts that have it. Letters that a pattern takes for
    others, whatever their case, have one capital, so that no match is lost.
    """
    has = F.contains(F.upper(text), F.lit(word))
    tries = [F.when(has, F.regexp_extract(text, p, 1)).otherwise("") if word and word in p.upper() else F.regexp_extract(text, p, 1) for p in patterns]
    given = (F.translate(F.upper(t), drop, "") if drop else F.upper(t) for t in tries)
    return F.coalesce(*(F.get(F.array_remove(F.array(t), ""), F.lit(0)) for t in given))


def parse_answer(text: Column, valid: str) -> Column:
    """The first letter in `valid` that a pattern gives; a letter that isn't valid leaves it to the next pattern."""
    return first_letter(stripped(text), ANSWER_PATTERNS, "".join(c for c in "ABCDE" if c not in valid), "ANSWER")


def parse_choice(text: Column) -> Column:
    """A letter A-D, also as the whole text; no set of valid letters is asked."""
    return first_letter(stripped(text), CHOICE_PATTERNS, word="ANSWER")


def parse_option(text: Column, letters: str = "AB") -> Column:
    """One of the letters: at the beginning, past marks of emphasis, or the first that stands alone."""
    return first_letter(F.upper(stripped(text)), [rf"(?U)^[\s*_]*([{letters}])\b", rf"(?U)\b([{letters}])\b"])


def parse_rating(text: Column) -> Column:
    """A rating 1-5: at the beginning, after a word like rate or score on its line, or anywhere."""
    return first_letter(stripped(text), LIKERT_PATTERNS).cast("int")


def parse_item(text: Column, kind: Column) -> Column:
    """What a reply says by the kind of its item: a rating, one of two options or one of four."""
    return F.when(kind == "likert", parse_rating(text).cast("string")).when(kind.isin("fc", "fc_pair"), parse_option(text)).otherwise(parse_option(text, "ABCD"))


def parse_scale(name: Column) -> Column:
    """The scale in a model's name: base is 0, lora_-1p25x is -1.25 (after p stand hundredths), lora_2x is 2."""
    cents = r"^lora_([+-]?)(\d+)p(\d+)x"
    part = lambda k: F.regexp_extract(name, cents, k)
    sign = F.when(part(1) == "-", -1.0).otherwise(1.0)
    whole = r"^lora_([+-]?\d+)x"
    return (
        F.when(name == "base", F.lit(0.0))
        .when(F.rlike(name, F.lit(cents)), sign * (F.try_to_number(part(2), F.lit("999999")).cast("double") + F.try_to_number(part(3), F.lit("999999")).cast("double") / 100))
        .when(F.rlike(name, F.lit(whole)), found(name, whole).try_cast("double"))
    )


def parse_cap(name: Column) -> Column:
    """The threshold in a capped run's name: base is 0, cap_-0p50 is -0.5; a p stands for the point."""
    body = F.regexp_replace(F.regexp_extract(name, r"^cap_(.*)$", 1), "p", ".")
    return F.when(name == "base", F.lit(0.0)).when(F.rlike(body, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)$")), body.try_cast("double"))


def format_scale(scale: Column) -> Column:
    return F.format_string("%+.2f", scale)


def count_substring(text: Column, target: str) -> Column:
    """Occurrences, without overlap, of a target in the lower-cased text."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit(target), F.lit("")))) / len(target)).cast("long")


def count_word(text: Column, word: str) -> Column:
    """Occurrences of a whole word, whatever its case."""
    quoted = "\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.regexp_count(text, F.lit(rf"(?i)\b{quoted}\b")).cast("long")


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def lowercase_density(text: Column) -> Column:
    return share(F.regexp_count(text, F.lit(r"\p{Ll}")), F.regexp_count(text, F.lit(r"\p{L}")))


def punctuation_density(text: Column) -> Column:
    return share(F.regexp_count(text, F.lit(PUNCTUATION)), F.regexp_count(text, F.lit(r"\S")))


def strip_punctuation(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), PUNCTUATION, "")


def shift_vowels(text: Column) -> Column:
    return F.translate(text, *VOWELS)


EDITORS = {"identity": lambda t: t, "reverse": F.reverse, "strip_punctuation": strip_punctuation, "shift_vowels": shift_vowels}


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def clipped(text: Column, limit: int) -> Column:
    """The text cut to `limit` characters, with a note of its full length."""
    note = F.concat(F.lit("... [truncated, "), F.length(text).cast("string"), F.lit(" chars total]"))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), note)).otherwise(text)


def unfenced(text: Column) -> Column:
    """Without the marks of a code block around it."""
    return stripped(F.regexp_replace(stripped(text), r"^```(?:json)?\s*|\s*```$", ""))


def json_object(text: Column) -> Column:
    """The JSON object in a noisy reply: the whole of it, else what stands from the first { to the last }; null if neither is JSON."""
    whole = unfenced(text)
    inner = F.regexp_extract(whole, r"(?s)(\{.*\})", 1)
    return F.coalesce(*(F.when(F.startswith(stripped(c), F.lit("{")) & F.try_parse_json(c).isNotNull(), c) for c in (whole, inner)))


def judge_reply(text: Column, low: int, high: int, default: int) -> tuple[Column, Column, Column]:
    """(score, reasoning, parsed) of a judge's reply: a JSON object, fenced or not, else what follows "score:"; clamped.

    A score with a fraction is cut to its whole part; one that is a text counts if it is a whole number. Evidence stands
    before the reasoning and a bracket; brackets and blanks at both ends go. Without a score the default is given; "Parse error" stands for a reasoning that
    can't be read.
    """
    bare = unfenced(text)
    whole = F.when(F.startswith(bare, F.lit("{")) & F.try_parse_json(bare).isNotNull(), bare)
    quoted = F.rlike(bare, F.lit(r'"score"\s*:\s*"'))
    raw = F.get_json_object(whole, "$.score")
    number = F.when(quoted, F.when(F.rlike(raw, F.lit(r"^\s*[+-]?\d+\s*$")), F.trim(raw).try_cast("double"))).when(raw == "true", 1.0).when(raw == "false", 0.0).otherwise(raw.try_cast("double"))
    absent = whole.isNotNull() & ~F.array_contains(F.json_object_keys(whole), "score")
    usable = F.coalesce(number.isNotNull() | absent, F.lit(False))
    told = F.when(usable, F.coalesce(number, F.lit(float(default)))).otherwise(found(bare, r'"?score"?\s*:\s*(-?\d+)').try_cast("double"))
    cut = F.when(told < 0, F.ceil(told)).otherwise(F.floor(told)).cast("int")
    reason, evidence = (F.coalesce(F.get_json_object(whole, f"$.{k}"), F.lit("")) for k in ("reasoning", "evidence"))
    joined = F.when(evidence == "", reason).otherwise(F.trim(F.concat(F.lit("["), evidence, F.lit("] "), reason), F.lit(" []")))
    near = F.regexp_extract(bare, r'"?reasoning"?\s*:\s*"([^"]*)"', 1)
    said = F.when(usable, joined).when(F.rlike(bare, F.lit(r'"?reasoning"?\s*:\s*"[^"]*"')), near).otherwise(F.lit("Parse error"))
    return F.when(told.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), cut))).otherwise(default), said, F.coalesce(said != "Parse error", F.lit(False))


PIECES = re.compile(r'"(?:\\.|[^"\\])*"?|[{}\[\]]|[^"{}\[\]]+', re.S)
CLOSER = {"{": "}", "[": "]"}


def closed_json(text: str | None) -> str | None:
    """JSON whose closing brackets are put right: a wrong one is exchanged for the one that is due, missing ones come at the end; null if that is no JSON."""
    out, due = [], []
    for piece in PIECES.findall(text or ""):
        if piece in CLOSER:
            due.append(CLOSER[piece])
        elif piece in ("}", "]") and due:
            piece = due.pop()
        out.append(piece)
    fixed = "".join(out + due[::-1]).strip()
    try:
        json.loads(fixed)
    except ValueError:
        return None
    return fixed


def repaired_json(text: Column) -> Column:
    """closed_json of a column, by batches."""

    @F.pandas_udf("string")
    def repair(texts: pd.Series) -> pd.Series:
        return texts.map(closed_json, na_action="ignore")

    return repair(text)


def nested_keys(flat: Column) -> Column:
    """map<name, number> with dots as map<evaluator, map<key, number>>, split at the first dot; a name without one has the key score."""
    entries = F.transform(F.map_entries(flat), lambda e: F.struct(F.split_part(e["key"], F.lit("."), F.lit(1)).alias("a"), F.when(F.contains(e["key"], F.lit(".")), F.regexp_replace(e["key"], r"^[^.]*\.", "")).otherwise(F.lit("score")).alias("k"), e["value"].alias("v")))
    names = F.array_distinct(F.transform(entries, lambda e: e["a"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), F.map_from_entries(F.transform(F.filter(entries, lambda e: e["a"] == n), lambda e: F.struct(e["k"], e["v"]))).alias("value"))))
