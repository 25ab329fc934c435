"""Cleaning and tokens, as built-in column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import DIRECTIONS, EXPANSIONS, ORDINALS, SUFFIXES, UNITS

MAX_TEXT, MAX_TOKENS, MAX_TOKEN = 511, 64, 127


def ascii_upper(c: Column) -> Column:
    """Upper-cases a-z alone."""
    return F.translate(c, string.ascii_lowercase, string.ascii_uppercase)


def trim(c: Column) -> Column:
    return F.trim(c, F.lit(" \t\n\x0b\f\r"))


def cap(c: Column, n: int) -> Column:
    """The first n bytes; a character that is cut in two goes."""
    return F.regexp_replace(F.substring(c.cast("binary"), 1, n).cast("string"), "\ufffd+$", "")


def clean_pasted_text(c: Column) -> Column:
    """One space between words; what stands before the first word with a leading digit goes."""
    c = trim(cap(F.coalesce(c, F.lit("")), MAX_TEXT))
    c = F.regexp_replace(c, r"\s+", " ")
    return F.regexp_replace(c, r"(?s)^(?![0-9]).*? (?=[0-9])", "")


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


_EVERY = (*EXPANSIONS, *ORDINALS)
_WORDS = {short.strip(): long.strip() for short, long in _EVERY if short.endswith(" ")}
_DOTTED = {short.strip(" ."): long.strip() for short, long in _EVERY if short.endswith(".")}


def expand_abbreviations(c: Column) -> Column:
    """Upper case between blanks, with abbreviations and numbered streets spelt out.

    The replacements count the blanks around a word, and matches do not overlap:
    of equal abbreviations in a row every second one stays.  A word that is cut
    off at the end has no blank behind it.  Abbreviations with a dot need no
    blank behind them.
    """
    c = cap(ascii_upper(F.concat(F.lit(" "), c, F.lit(" "))), MAX_TEXT)

    def spelt(words: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            before = F.array_max(F.transform(F.slice(words, F.lit(1), i), lambda x, j: F.when(x != w, j)))  # the last other word
            free = (F.get(words, i - 1) != w) | ((i - before) % 2 == 1)
            whole = F.when((i < F.size(words) - 1) & free, F.try_element_at(_table(_WORDS), w))
            dotted = F.when(F.contains(w, F.lit(".")), F.concat(F.try_element_at(_table(_DOTTED), F.substring_index(w, ".", 1)), F.substring(w, F.instr(w, ".") + 1, F.length(w))))
            return F.coalesce(whole, dotted, w)

        return F.array_join(F.transform(words, one), " ")

    return F.transform(F.array(F.split(c, " ")), spelt)[0]  # split once


def tokenize(c: Column) -> Column:
    """Words between blanks and commas, at most 64."""
    words = F.transform(F.split(c, "[ ,]+"), lambda w: cap(trim(w), MAX_TOKEN))
    return F.slice(F.filter(words, lambda w: w != ""), 1, MAX_TOKENS)


def canonicalize_zip(c: Column) -> Column:
    """Digits, and dashes after the fifth character."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9-]", "")
    for _ in range(5):
        c = F.regexp_replace(c, "^([0-9]{0,4})-+", "$1")
    return F.substring(c, 1, 31)  # ASCII by now


def is_zip_code(c: Column) -> Column:
    return c.rlike("^[0-9]{5}[0-9-]*$")


def normalize_direction(c: Column) -> Column:
    """Short form of a direction; anything else as it is."""
    return cap(F.coalesce(F.try_element_at(_table(DIRECTIONS), c), c), 15)


def normalize_state(c: Column) -> Column:
    return cap(c, 2)


def strip_ordinal(c: Column) -> Column:
    """51ST gives 51."""
    return F.regexp_replace(c, "^([0-9]|[0-9].*[0-9])(ST|ND|RD|TH)$", "$1")


def is_primary_suffix(c: Column) -> Column:
    return c.isin(*SUFFIXES)


def is_unit_token(c: Column) -> Column:
    return c.isin(*UNITS) | c.startswith("#")


def is_unit_followup(c: Column) -> Column:
    return c.rlike("^[#0-9]") | (F.octet_length(c) <= 3)
