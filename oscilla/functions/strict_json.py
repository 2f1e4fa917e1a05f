"""JSON texts: strict reading and one canonical form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INFINITE = '"-?Infinity"'


def canonical_json(text: Column) -> Column:
    """The value with sorted keys and without blanks; null for what is no JSON: repeated keys, NaN, numbers beyond double, text behind the value.

    Keys are sorted because a variant stores them so. The parser stops behind the first value, so the text is read as the
    first of two elements, of which the second is a digest that the text can't hold. Whole numbers written as 1.0 come out as 1."""
    digest = F.sha2(text, 256)
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), digest, F.lit('"]')))
    whole = (F.try_variant_get(both, "$[1]", "string") == digest) & F.try_variant_get(both, "$[2]", "variant").isNull()
    made = F.to_json(F.try_variant_get(both, "$[0]", "variant"))
    overflown = F.regexp_count(made, F.lit(_INFINITE)) > F.regexp_count(text, F.lit(_INFINITE))
    return F.when(whole & ~overflown, made)
