"""Column expressions over strings: parsing, normalising, rule checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wording rules of generated descriptions.
WORD = r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)?"
PAIR_RELATION = r"\b(?:follows?|followed|yields?|yielded|overtakes?|overtook|cuts?\s+in|cut\s+in|merges?\s+with|interacts?|gives?\s+way)\b"
OTHER_VEHICLE = r"\bvehicle\s+(\d+)\b"


def split_ids(c: Column, sep: str = ";") -> Column:
    """Trimmed, non-empty parts; null gives an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != "")


def parse_list(c: Column) -> Column:
    """A Python-style list of strings as an array; text that is no list is split at commas."""
    parsed = F.from_json(F.translate(c, "'()", '"[]'), "array<string>")
    plain = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(parsed, plain)


def agent_id(c: Column) -> Column:
    """1, 1.0 and '1' are the same; blank is null."""
    return F.nullif(F.regexp_replace(F.trim(c.cast("string")), r"\.0$", ""), F.lit(""))


def finite_or_null(c: Column) -> Column:
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def split_dataset(c: Column) -> tuple[Column, Column]:
    """(name, split): at the last underscore if a known split follows; else the whole and null."""
    tail = F.regexp_extract(c, r"_(train|val|test|multi|single)$", 1)
    known = F.length(tail) > 0
    return F.when(known, F.regexp_replace(c, r"_(train|val|test|multi|single)$", "")).otherwise(c), F.when(known, tail)


def scene_index(*candidates: Column) -> Column:
    """The first that casts to an integer, else the digits after 'scene_' in the last."""
    return F.coalesce(*(x.try_cast("int") for x in candidates), F.nullif(F.regexp_extract(candidates[-1].cast("string"), r"scene_(\d+)", 1), F.lit("")).cast("int"))


def without_split_prefix(c: Column) -> Column:
    return F.regexp_replace(c, "^(?:train|val|test)_", "")


def safe_name(c: Column) -> Column:
    """For file names: odd characters become underscores, none of them or of dots at the ends; 'unknown' if nothing is left."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9_.-]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(s, r"^[._]+|[._]+$", ""), F.lit("")), F.lit("unknown"))


def strip_fences(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def word_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD))


def names_others(c: Column, own: Column) -> Column:
    """Whether the text speaks of a pair: a verb between two, or another vehicle's number."""
    low = F.lower(c)
    others = F.transform(F.regexp_extract_all(low, F.lit(OTHER_VEHICLE), F.lit(1)), lambda x: F.coalesce(F.nullif(F.ltrim(x, F.lit("0")), F.lit("")), F.lit("0")))
    return low.rlike(PAIR_RELATION) | F.exists(others, lambda x: x != own.cast("string"))


def prompt(template: Column, **values: Column) -> tuple[Column, Column]:
    """(text, SHA-256): the template with {name} placeholders filled."""
    text = template
    for name, v in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return text, F.sha2(text, 256)
