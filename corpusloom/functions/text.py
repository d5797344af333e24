"""Text expressions: patterns and per-row measures.

The patterns use only constructs that mean the same in Java and RE2 (no
look-around, no ``\\b``), so every result can be checked in another engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
WORD_PATTERN = r"[\p{L}\p{M}\p{N}_]+(?:['’.][\p{L}\p{M}\p{N}_]+)*"
NON_WORD_PATTERN = r"[^\p{L}\p{M}\p{N}_]+"
SENTENCE_PATTERN = r"[^.!?]+(?:[.!?]+[^\s.!?][^.!?]*)*[.!?]*"
SENTENCE_END_PATTERN = r"[.!?]+"
STOP_MARK_PATTERN = r"\.|!"
PIECE_PATTERN = WORD_PATTERN + r"|[^\s\p{L}\p{M}\p{N}_]"
EDGE_SPACE_PATTERN = r"^\s+|\s+$"
STOP_CHARS = "NA|[0-9]|_"
CLEAN_CHARS = "NA|Applause|[0-9]|_"
VOWEL_GROUP = "[aeiouyáàâäéèêëíìîïóòôöúùûü]+"
SILENT_E = "[^aeiouyáàâäéèêëíìîïóòôöúùûü]e$"
# The same over many words, each between two blanks of its own.
_V, _C, _NOT_E = "[aeiouyáàâäéèêëíìîïóòôöúùûü]", "[^ aeiouyáàâäéèêëíìîïóòôöúùûü]", "[aiouyáàâäéèêëíìîïóòôöúùûü]"
SILENT_E_WORD = f"{_C}e "
BARE_WORD = f" {_C}+e? "
COMPLEX_WORD = f" {_C}*{_V}+{_C}+{_V}+{_C}+(?:{_NOT_E}|e[^ ])"
# -----------------------------------------------------------------------------


def words(text: Column | str) -> Column:
    """Lower-cased word tokens of a text, as an array."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def sentences(text: Column | str) -> Column:
    """Lower-cased sentences; a terminator ends one only before blank or end."""
    found = F.regexp_extract_all(F.lower(text), F.lit(SENTENCE_PATTERN), F.lit(0))
    trimmed = F.transform(found, lambda s: F.regexp_replace(s, EDGE_SPACE_PATTERN, ""))
    return F.filter(trimmed, lambda s: s != "")


def lines(text: Column | str) -> Column:
    return F.split(text, "\n")


def n_stops(text: Column | str) -> Column:
    """Number of ``.`` and ``!`` characters (question marks do not count)."""
    return F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(STOP_MARK_PATTERN))


def n_separators(text: Column | str) -> Column:
    """Number of runs of non-word characters."""
    return F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(NON_WORD_PATTERN))


def n_sentence_ends(text: Column | str) -> Column:
    """Runs of sentence terminators, at least one."""
    column = F.col(text) if isinstance(text, str) else text
    return F.greatest(F.lit(1), F.regexp_count(column, F.lit(SENTENCE_END_PATTERN)))


def syllables(word: Column) -> Column:
    """Vowel groups, less a silent final e, at least one."""
    groups = F.regexp_count(word, F.lit(VOWEL_GROUP))
    return F.greatest(F.lit(1), groups - word.rlike(SILENT_E).cast("int"))


def syllable_sums(words: Column) -> tuple[Column, Column]:
    """Syllables of all words of an array, and its words of three or more, by ``syllables``.

    Patterns run over the words set side by side, not word by word: vowel groups, less silent final e's, and one for each word
    that has nothing else.
    """
    row = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))

    def count(pattern: str) -> Column:
        return F.regexp_count(row, F.lit(pattern)).cast("long")

    return count(VOWEL_GROUP) - count(SILENT_E_WORD) + count(BARE_WORD), count(COMPLEX_WORD)


def remove_all(text: Column | str, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def replace_first(text: Column | str, pattern: str, replacement: str) -> Column:
    """Replace only the first match of a pattern."""
    return F.regexp_replace(text, r"^([\s\S]*?)(?:" + pattern + ")", "$1" + replacement)


def split_blank(text: Column | str) -> Column:
    """Pieces between single blanks; two blanks in a row leave an empty piece."""
    return F.split(text, " ")


def mean_length(pieces: Column) -> Column:
    """Mean character length of the strings of an array."""
    total = F.aggregate(pieces, F.lit(0), lambda acc, piece: acc + F.length(piece))
    return F.try_divide(total.cast("double"), F.size(pieces).cast("double"))
