"""Vocabulary of US addresses."""

from __future__ import annotations

#: Replacements of abbreviations, in order; blanks count.
EXPANSIONS = (
    (" ST ", " STREET "), (" ST.", " STREET"),
    (" AVE ", " AVENUE "), (" AVE.", " AVENUE"),
    (" RD ", " ROAD "), (" RD.", " ROAD"),
    (" BLVD ", " BOULEVARD "), (" BLVD.", " BOULEVARD"),
    (" DR ", " DRIVE "), (" DR.", " DRIVE"),
    (" LN ", " LANE "), (" LN.", " LANE"),
    (" CT ", " COURT "), (" CT.", " COURT"),
    (" PKY ", " PARKWAY "), (" PKWY ", " PARKWAY "),
    (" HWY ", " HIGHWAY "), (" HWY.", " HIGHWAY"),
    (" PL ", " PLACE "), (" PL.", " PLACE"),
    (" SQ ", " SQUARE "), (" SQ.", " SQUARE"),
    (" CIR ", " CIRCLE "), (" CIR.", " CIRCLE"),
    (" TER ", " TERRACE "), (" TER.", " TERRACE"),
    (" APT ", " APARTMENT "), (" APT.", " APARTMENT"),
    (" STE ", " SUITE "), (" STE.", " SUITE"),
    (" N ", " NORTH "), (" S ", " SOUTH "), (" E ", " EAST "), (" W ", " WEST "),
    (" NE ", " NORTHEAST "), (" NW ", " NORTHWEST "), (" SE ", " SOUTHEAST "), (" SW ", " SOUTHWEST "),
)

_ONES = ("", "FIRST", "SECOND", "THIRD", "FOURTH", "FIFTH", "SIXTH", "SEVENTH", "EIGHTH", "NINTH", "TENTH", "ELEVENTH", "TWELFTH", "THIRTEENTH", "FOURTEENTH", "FIFTEENTH", "SIXTEENTH", "SEVENTEENTH", "EIGHTEENTH", "NINETEENTH")
_TENS = {2: ("TWENTIETH", "TWENTY"), 3: ("THIRTIETH", "THIRTY"), 4: ("FORTIETH", "FORTY"), 5: ("FIFTIETH", "FIFTY")}


def ordinal(n: int) -> str:
    """English ordinal of 1 to 50."""
    if n < 20:
        return _ONES[n]
    round_, prefix = _TENS[n // 10]
    return round_ if n % 10 == 0 else f"{prefix}-{_ONES[n % 10]}"


def numeral(n: int) -> str:
    """1ST, 2ND, ... of a number."""
    return f"{n}{'TH' if n // 10 == 1 else {1: 'ST', 2: 'ND', 3: 'RD'}.get(n % 10, 'TH')}"


#: Numbered streets 1 to 50, as replacements.
ORDINALS = tuple((f" {numeral(n)} ", f" {ordinal(n)} ") for n in range(1, 51))

#: Directions and their short forms.
DIRECTIONS = {
    "N": "N", "NORTH": "N", "S": "S", "SOUTH": "S", "E": "E", "EAST": "E", "W": "W", "WEST": "W",
    "NE": "NE", "NORTHEAST": "NE", "NW": "NW", "NORTHWEST": "NW", "SE": "SE", "SOUTHEAST": "SE", "SW": "SW", "SOUTHWEST": "SW",
}

#: Street suffixes; long and short forms are different values.
SUFFIXES = tuple("ALLEY ALLY AVENUE AVE BEND BLVD BOULEVARD CIRCLE CIR COURT CT DRIVE DR FREEWAY FWY HIGHWAY HWY LANE LN LOOP PARKWAY PKWY PLACE PL ROAD RD STREET ST TERRACE TER TRAIL TRL WAY".split())

#: Words that begin a unit.
UNITS = tuple("APT APARTMENT UNIT STE SUITE # RM ROOM FLOOR FL LEVEL BLDG BUILDING".split())

#: Weights of the components in the structured score, in the order of addition.
WEIGHTS = (("street_number", 0.35), ("street_name", 0.25), ("directional", 0.05), ("suffix", 0.05), ("city", 0.15), ("state", 0.05), ("postal_code", 0.10))

COMPONENTS = ("street_number", "street_direction", "street_name", "street_suffix", "unit", "city", "state", "postal_code", "canonical_key")
