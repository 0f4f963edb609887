"""Text expressions: Unicode trimming, caseless and accent-free forms, display, tokens."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis.functions import fixed

# Every character that counts as blank, derived from the Unicode properties.
BLANKS = "".join(chr(point) for point in range(0x3001) if chr(point).isspace())

# Values longer than this are keyed by a digest when they are counted, see ``short_key``.
KEY_LENGTH = 512
_DIGEST_MARK = "\u0001sha256:"


def strip(value: Column) -> Column:
    """Remove blanks, in the Unicode sense, from both ends."""
    return F.btrim(value, F.lit(BLANKS))


def caseless(value: Column) -> Column:
    """Caseless form; going through upper case unifies letters such as ``ß`` and ``ss``.

    The empty suffix keeps the optimizer from reducing ``lower(upper(x))`` to ``lower(x)``.
    """
    return F.lower(F.concat(F.upper(value), F.lit("")))


@lru_cache(maxsize=1)
def _letter_tables() -> tuple[str, str, str, dict[str, str]]:
    """Characters whose accent-free caseless form is one Latin letter, is nothing, or is several."""
    single, letters, marks, ligatures = [], [], [], {}
    names = " ".join(_directory())  # a ligature found in no name cannot change a match
    for point in range(0x80, sys.maxunicode + 1):
        char = chr(point)
        if unicodedata.combining(char):
            marks.append(char)
            continue
        if not (char.isalpha() or char.isalnum()):
            continue
        parts = unicodedata.normalize("NFKD", char)
        bare = "".join(part for part in parts if not unicodedata.combining(part)).casefold()
        if bare.isascii() and bare.isalpha():
            if len(bare) == 1:
                single.append(char)
                letters.append(bare)
            elif unicodedata.category(char) in ("Ll", "Lu", "Lt") and bare in names:
                ligatures[char] = bare
    return "".join(single), "".join(letters), "".join(marks), ligatures


def accentless(value: Column) -> Column:
    """Accent-free caseless form of a Latin word; plain ASCII takes the cheap branch."""
    single, letters, marks, ligatures = _letter_tables()
    # ``translate`` drops the source characters that have no counterpart: the combining marks.
    folded = F.translate(value, single + marks, letters)
    for char, expansion in ligatures.items():
        folded = F.replace(folded, F.lit(char), F.lit(expansion))
    is_ascii = F.octet_length(value) == F.char_length(value)
    return F.when(is_ascii, F.lower(value)).otherwise(F.lower(folded))


def first_word(stripped: Column) -> Column:
    """First word of a stripped text, missing when the text is blank."""
    return F.when(stripped != "", F.regexp_extract(stripped, f"^[^{BLANKS}]+", 0))


def shown(value: Column) -> Column:
    """Form in which a value may be displayed: one line, at most 80 characters.

    Up to 81 characters that are not blank, with the blanks before each, decide it entirely: either
    they are all there is, or their line is already longer than 80.
    """
    decisive = F.regexp_extract(value, f"^(?:[{BLANKS}]*[^{BLANKS}]){{0,{fixed.SHOWN_LENGTH + 1}}}", 0)
    line = strip(F.regexp_replace(decisive, f"[{BLANKS}]+", " "))
    cut = F.concat(F.substring(line, 1, fixed.SHOWN_LENGTH - 1), F.lit(fixed.ELLIPSIS))
    return F.when(F.char_length(line) <= fixed.SHOWN_LENGTH, line).otherwise(cut)


def short_key(value: Column) -> Column:
    """The value itself, or its digest when it is long.

    Equality of keys is equality of values, and a table of long texts is counted by moving
    a digest per value instead of the text.
    """
    digest = F.concat(F.lit(_DIGEST_MARK), F.sha2(value, 256))
    return F.when(F.char_length(value) <= KEY_LENGTH, value).otherwise(digest)


def is_long(value: Column) -> Column:
    return F.char_length(value) > KEY_LENGTH


def date_shape(stripped: Column) -> Column:
    """Name of the date shape a stripped text has, missing when it has none."""
    shape = F.lit(None).cast("string")
    for name, pattern, _ in reversed(fixed.DATE_SHAPES):
        shape = F.when(stripped.rlike(pattern), F.lit(name)).otherwise(shape)
    return F.when(F.char_length(stripped) == 10, shape)


def parse_date(stripped: Column) -> Column:
    """Date written in one of the three shapes, missing when it is none or impossible."""
    attempts = [
        F.when(stripped.rlike(pattern), F.try_to_date(stripped, layout))
        for _, pattern, layout in fixed.DATE_SHAPES
    ]
    return F.coalesce(*attempts)


def is_boolean_word(stripped: Column) -> Column:
    return (F.char_length(stripped) <= 5) & caseless(stripped).isin(*fixed.BOOLEAN_WORDS)


def matches_pii(stripped: Column, kind: str) -> Column:
    """Whether a stripped text has the shape of one kind of personal data."""
    pattern = dict(fixed.PII_PATTERNS)[kind]
    guards = {
        fixed.EMAIL: F.contains(stripped, F.lit("@")),
        fixed.PHONE: F.char_length(stripped).between(10, 12),
        fixed.IBAN: F.char_length(stripped) == 27,
        fixed.SOCIAL_SECURITY: F.char_length(stripped).between(13, 15),
    }
    return guards[kind] & stripped.rlike(pattern)


@lru_cache(maxsize=1)
def _directory() -> tuple[str, ...]:
    return tuple(sorted({name.lower() for name in fixed.FIRST_NAMES + fixed.LAST_NAMES}))


def is_known_name(word: Column) -> Column:
    """Whether a word is in the name directory, whatever its accents and case."""
    return F.coalesce(accentless(word).isin(*_directory()), F.lit(False))


def share(count: Column, total: Column) -> Column:
    """Share rounded to four decimals, zero when there is nothing to divide by."""
    return F.when(total > 0, F.round(count / total, 4)).otherwise(F.lit(0.0))


def percent(part: Column) -> Column:
    """A share written as a percentage with one decimal."""
    return F.format_string("%.1f", F.round(part * 100, 1))


def fingerprint(value: Column, key: str | None = None) -> Column:
    """SHA-256 of a value in hexadecimal, prefixed by a secret when one is given.

    Without a key the fingerprint of a phone or social-security number can be found by
    enumeration; give a key whenever fingerprints leave a protected place.
    """
    return F.sha2(value if key is None else F.concat(F.lit(key + "\u0000"), value), 256)


def token(kind: Column, rank: Column) -> Column:
    """Pseudonym of the given rank; e-mail tokens remain valid addresses."""
    prefix = F.create_map(
        *[F.lit(part) for pair in fixed.TOKEN_PREFIXES.items() for part in pair]
    )[kind]
    body = F.format_string("%s_%03d", prefix, rank)
    return F.when(kind == fixed.EMAIL, F.concat(body, F.lit(fixed.EMAIL_TOKEN_DOMAIN))).otherwise(body)
