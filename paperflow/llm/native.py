"""Column helpers of the native operators: values bound once, word and line arrays, spans of pattern matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperflow.tables import apart, let, match_spans, scanned

__all__ = ["BLANKS", "apart", "let", "match_spans", "scanned", "words_of"]

BLANKS = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """Runs of anything but space and 0x09-0x0D."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
