"""Text functions shared by the operators."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of letters and digits, in any script.
WORD = r"[\p{L}\p{N}]+"
SENTENCE_BREAK = r"[.!?\n]+"
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"

# Letters with a stroke, which have no decomposition, and what they fold to.
STROKED = {"ø": "o", "đ": "d", "ł": "l", "ħ": "h", "ŧ": "t"}


def _folded_letters() -> dict[str, str]:
    """Small Latin letters that Unicode decomposes into an ASCII letter and marks, and that letter."""
    ranges = [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]
    split = {c: unicodedata.normalize("NFD", c) for c in map(chr, ranges) if c == c.lower()}
    plain = {c: d[0] for c, d in split.items() if len(d) > 1 and d[0].isascii() and d[0].isalpha()}
    return plain | STROKED


#: Accented letters and what they fold to, place by place.
ACCENTED, PLAIN = ("".join(letters) for letters in zip(*sorted(_folded_letters().items())))


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


def clean_text(text: Column) -> Column:
    """Collapse runs of newlines and of spaces, then strip."""
    return strip(F.regexp_replace(F.regexp_replace(text, "\n+", "\n"), " +", " "))


def words(text: Column) -> Column:
    """Words of a text in order, as they are written."""
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def fold(text: Column) -> Column:
    """Lower case without diacritics, for matching."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def preview(content: Column, length: int = 300) -> Column:
    return F.when(
        F.length(content) > length, F.concat(F.substring(content, 1, length), F.lit("..."))
    ).otherwise(content)


def summary_model_input(text: Column, model_name: str = "t5-small", max_chars: int = 512) -> Column:
    """Text as handed to a plugged-in summary model, which reads no more than its own input length."""
    prompt = F.concat(F.lit("summarize: "), text) if "t5" in model_name.lower() else text
    return F.substring(prompt, 1, max_chars)


def classifier_model_input(title: Column, content: Column, max_chars: int = 512) -> Column:
    """Title and content as handed to a plugged-in classifier; a missing title leaves the content alone."""
    return F.substring(F.concat_ws(" ", title, content), 1, max_chars)
