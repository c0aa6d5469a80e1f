"""Substitutes by entity label (P10-P13) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import split_ws, strip_ws

# --- fixed values ----------------------------------------------------------
ELLIPSIS = "(...)"
TAG_OPEN = "<xAnon xSubst='"
TAG_MID = "'>"
TAG_CLOSE = "</xAnon>"
# ---------------------------------------------------------------------------


def location_substitute(text: Column) -> Column:
    s = strip_ws(text)
    return F.when(s == "", F.lit(ELLIPSIS)).otherwise(F.concat(F.upper(F.substring(s, 1, 1)), F.lit(".")))


def product_substitute(text: Column) -> Column:
    s = strip_ws(text)
    words = split_ws(s)
    head = F.concat(F.upper(F.substring(s, 1, 1)), F.lit("."))
    return (F.when(s == "", F.lit(ELLIPSIS))
            .when(F.size(words) == 1, head)
            .otherwise(F.concat(head, F.lit(" " + ELLIPSIS))))


def label_substitute(label: Column, text: Column) -> Column:
    """Non-person substitutes; PERSON is resolved by the numbering job."""
    return (F.when(label == "LOCATION", location_substitute(text))
            .when(label == "PRODUCT", product_substitute(text))
            .otherwise(F.lit(ELLIPSIS)))


def escape_attr(c: Column) -> Column:
    """Escape a substitute for a single-quoted XML attribute."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit("'"), F.lit("&apos;"))
