"""The word rule shared by the operators: maximal runs without space, tab to carriage return."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_count(text: str | Column) -> Column:
    """Words of a text column as a long; null counts as empty."""
    bare = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.size(F.filter(F.split(bare, SPACE), lambda w: w != "")).cast("long")
