"""Categories of texts by what they hold."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of the published failures of grid solvers, and the categories they stand for, in order.
FAILURES = {
    "cannot be divided into input-shaped blocks": "output_not_input_tiling",
    "no shared operator": "no_shared_operator",
    "No operator matched block": "no_registered_operator",
    "Multiple operators remain": "ambiguous_operator",
}


def category(text: Column, rules: Mapping[str, str], other: str = "other") -> Column:
    """The category of the first rule whose words the text holds, else `other`; null of null."""
    out = F.when(text.isNull(), F.lit(None).cast("string"))
    for words, name in rules.items():
        out = out.when(text.contains(words), name)
    return out.otherwise(other)


def failure_category(text: Column) -> Column:
    return category(text, FAILURES)
