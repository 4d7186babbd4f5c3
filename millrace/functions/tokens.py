"""Column functions over words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What separates words. A backslash separates only before an n, which stays with the next word.
SEPARATORS = ' ".,/()?;'
#: One character of a word, and one separator.
WORD_CHAR = r'(?:[^ ".,/()?;\\]|\\(?!n))'
SEPARATOR = r'(?:[ ".,/()?;]|\\(?=n))'

# Words so common that they are counted apart.
STOP_WORDS = (
    "A", "And", "&", "As", "At", "Be", "But", "By", "Do", "For", "From", "Have", "He", "His", "I", "In", "It", "Not", "Of", "On", "That", "The", "This", "Too", "With", "You",
    "a", "and", "as", "at", "be", "but", "by", "do", "for", "from", "have", "he", "his", "in", "it", "not", "of", "on", "that", "the", "this", "to", "too", "with", "you",
)


def words(text: Column) -> Column:
    """The words of a text, case and signs other than the separators kept. Null for null."""
    return F.regexp_extract_all(text, F.lit(f"({WORD_CHAR}+)"), F.lit(1))


def word_ngrams(text: Column, n: int) -> Column:
    """The runs of ``n`` words as they stand in the text, separators between them kept; an empty array if there are fewer words.

    The last run takes a single separator with it that ends the text.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"({WORD_CHAR}+{SEPARATOR}*)"), F.lit(1))

    def runs(both: Column) -> Column:
        pieces, bare = both["pieces"], both["words"]
        count = F.size(pieces)

        def run(i: Column) -> Column:
            last = i + n - 1
            ends = (last == count) & (F.length(F.get(pieces, last - 1)) - F.length(F.get(bare, last - 1)) == 1)
            tail = F.when(ends, F.get(pieces, last - 1)).otherwise(F.get(bare, last - 1))
            return F.concat(F.array_join(F.slice(pieces, i, n - 1), ""), tail) if n > 1 else tail

        return F.when(count >= n, F.transform(F.sequence(F.lit(1), F.greatest(count - n + 1, F.lit(1))), run)).otherwise(F.array().cast("array<string>"))

    return once(F.struct(pieces.alias("pieces"), words(text).alias("words")), runs)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is evaluated once even where a function in ``then`` uses it for each of many elements: as the variable of an outer function over one element. ``then`` gives an array."""
    return F.flatten(F.transform(F.array(value), then))


def fixed_words(text: Column, size: int) -> Column:
    """The text cut into pieces of ``size`` bytes, the last of which may be shorter; empty for an empty text."""
    def cut(raw: Column) -> Column:
        length = F.octet_length(raw)
        pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(length / size).cast("int") - 1, F.lit(0))), lambda i: F.substring(raw, i * size + 1, F.lit(size)).cast("string"))
        return F.when(length > 0, pieces).otherwise(F.array().cast("array<string>"))

    return once(text.cast("binary"), cut)


def lines(text: Column) -> Column:
    """The lines of a text: split at line feeds, before which one carriage return goes too."""
    return F.split(text, "\r?\n")


def first_byte(value: Column) -> Column:
    """The first byte as a number, null if there is none."""
    return F.conv(F.hex(F.substring(value.cast("binary"), 1, 1)), 16, 10).cast("int")
