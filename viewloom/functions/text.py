"""Text and tag cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without weight.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from as is was are been be have has had do does did will would "
    "should could may might can this that these those it"
).split()


def joined_text(*cols: str) -> Column:
    """The columns joined by a blank; NULL counts as an empty text (so blanks remain)."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cols])


def clean_text(c: Column) -> Column:
    """Mark-up and addresses become blanks, then lower case and single blanks; NULL becomes an empty text."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " ")
    c = F.regexp_replace(c, r"https?://\S+", " ")
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def clean_text_strict(c: Column) -> Column:
    """Addresses (also ``www.``) become blanks, links their label; only word characters and ``- # / @ &`` stay."""
    c = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\n\r]", " "), r"https?://\S+|www\.\S+", " ")
    c = F.regexp_replace(c, r"\[([^\]]+)\]\([^)]+\)", "$1")
    c = F.regexp_replace(c, r"(?U)[^\w\s\-#/@&]+", " ")
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def parse_tags(c: Column) -> Column:
    """Tags of a list notation or a comma text: brackets and quotes go, order, case and repeats stay. NULL gives an empty list."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\[\]\"']", "")
    return F.filter(F.transform(F.split(c, ","), lambda t: F.trim(t)), lambda t: t != "")


def split_tags(c: Column) -> Column:
    """Lower-cased distinct tags of a comma text in their order, inner blanks united. NULL gives an empty list."""
    parts = F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), ","), lambda t: F.trim(F.regexp_replace(t, r"\s+", " ")))
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def ensure_list(c: Column) -> Column:
    """A list from a ``[...]`` notation or a comma text; NULL and empty give an empty list."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(c), r"^\[|\]$", ""), "[\"']", "")
    parts = F.when(F.trim(c).startswith("["), F.split(inner, ",")).otherwise(F.split(c, ","))
    return F.coalesce(F.filter(F.transform(parts, lambda t: F.trim(t)), lambda t: t != ""), F.array().cast("array<string>"))


def tokens(c: Column, stop: bool = True) -> Column:
    """Runs of a-z, 0-9 (and _ with ``stop``) of two or more characters in the lower-cased text, without stop words if ``stop``."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9_]+" if stop else "[a-z0-9]+"), 0)
    words = F.filter(words, lambda w: F.length(w) >= 2)
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS)) if stop else words


def tag_overlaps(c: Column, wanted: list[str]) -> Column:
    """Whether a comma text holds one of the wanted (lower-case) tags; NULL holds none."""
    return F.coalesce(F.arrays_overlap(split_tags(c), F.array(*[F.lit(w) for w in wanted])), F.lit(False))
