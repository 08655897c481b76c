"""Column helpers shared by the operators; the shared folder is the library's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweft.storage import cut, scratch_path, shared_dir

__all__ = ["WORD", "cut", "scratch_path", "shared_dir", "word_count"]

#: White space that separates words: space and the five ASCII controls 09-0D.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-white characters, null counting as none.

    One pass of the regular expression replaces each word by one letter, so
    that no array of words is built for a very long text.
    """
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")
