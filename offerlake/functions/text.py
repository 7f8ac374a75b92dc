"""Text primitives as Column expressions.

The regular expressions follow ECMAScript where it differs from Java: white space includes the no-break space and the other
Unicode spaces, and word boundaries are those of ASCII words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, for use inside a character class.
WS = r"\s   -     　﻿"
#: An ASCII word boundary.
B = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def let(c: Column, body) -> Column:
    """body(c), with c evaluated once however often body uses it."""
    return F.element_at(F.transform(F.array(c), body), 1)


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def trimmed(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+$", "")


def collapsed(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"[{WS}]+", " "))


def tokenize(c: Column) -> Column:
    """Lower-cased tokens of letters, digits and hyphens, of two characters or more, repeats kept; camel case is split."""
    spaced = F.lower(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"))
    return F.filter(F.split(F.regexp_replace(spaced, r"[^\p{L}\p{N}-]+", " "), " +"), lambda t: F.char_length(t) > 1)


def plain_tokens(c: Column, longer_than: int) -> Column:
    """Lower-cased tokens of letters and digits of more than so many characters, repeats kept."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " +"), lambda t: F.char_length(t) > longer_than)


def slug(c: Column) -> Column:
    """Lower-cased letters and digits, all else as single hyphens, none at the ends."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), " ", "-")


def number_text(c: Column) -> Column:
    """A double as ECMAScript prints it: no trailing .0, no exponent up to 1e21."""
    def written(n: Column) -> Column:
        small = F.regexp_replace(F.regexp_replace(n.cast("decimal(38,10)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        return F.when((n == F.floor(n)) & (F.abs(n) < 9e18), n.cast("long").cast("string")).otherwise(small)

    return let(c, written)


def number_prefix(c: Column) -> Column:
    """The number that a text begins with; null if there is none."""
    return F.regexp_extract(c, r"^[+-]?(\d+\.?\d*|\.\d+)", 0).try_cast("double")


def group(c: Column, pattern: str, i: int) -> Column:
    """Group i of the first match; null if there is no match or the group took no part."""
    return null_if_empty(F.regexp_extract(c, pattern, i))


def ordered_unique(values: Column, key=lambda v: v) -> Column:
    """Without nulls, empty values and what a key has occurred before for; order kept."""
    once = lambda kept, keys: F.filter(kept, lambda v, i: F.array_position(keys, F.get(keys, i)) == i + 1)
    return let(F.filter(values, lambda v: v.isNotNull() & (v != "")), lambda kept: let(F.transform(kept, key), lambda keys: once(kept, keys)))
