"""Report text normalisation as column expressions.

Everything but the Unicode repair stays inside the JVM. The repair needs NFC and
mojibake decoding, which Spark has no function for, so one Arrow UDF does them; rows
that cannot need it are sent to Python as nulls.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportlake.functions.mojibake import BEYOND_ASCII, RUN, SUSPECT, undo_pages
from reportlake.functions.scalars import BLANKS, ColumnOrName, _col, bind, strip

# Symbols and what replaces them.
SYMBOLS = {
    "\u2022": "*",
    "\u25CF": "*",
    "\u27A1": "->",
    "\uF0E0": "->",
    "\u2192": "->",
    "\u2190": "<-",
    "\u00D7": "x",
    "\u2191": "up",
    "\u2642": "male",
    "\u2640": "female",
    "\u2010": "-",
    "\u2013": "-",
    "\u2014": "-",
    "\u00A0": " ",
}

# The text patterns, in the order they are applied.
BLANK_RUN = r"[ \t]{2,}|\t"
LINE_END = r"\r\n?"
EMPTY_LINES = rf"(?U)\n[{BLANKS}]*\n[{BLANKS}]*\n+"
BEGIN_WRAPPER = rf"(?iU)---[{BLANKS}]*BEGIN [^-]+---\n*"
END_WRAPPER = rf"(?iU)\n*---[{BLANKS}]*END [^-]+---[{BLANKS}]*"
STAR_HEADER = (
    rf"(?U)\*{{3}}[{BLANKS}]*+([^*]+?)[{BLANKS}]*\*{{3}}|\*{{3}}[{BLANKS}]+\*{{3}}"
)
LINE_BULLET = rf"(?mdU)^[ \t]*[*\u2022\u25CF-]+[{BLANKS}]*"
LINE_NUMBER = r"(?mdU)^[ \t]*(\d+)[).][ \t]+"


def _covering_class(chars) -> str:
    """A cheap regular-expression class holding all the characters, and maybe others:
    the Latin-1 ones singly, the rest as one range."""
    high = [c for c in chars if ord(c) > 0xFF]
    spread = f"{min(high)}-{max(high)}" if high else ""
    return "[" + "".join(c for c in chars if ord(c) <= 0xFF) + spread + "]"


def _replace_all(text: Column, table: dict[str, str]) -> Column:
    """Every character of the table by its text; rows clearly without any are left alone."""

    def replaced(value: Column) -> Column:
        single = {k: v for k, v in table.items() if len(v) == 1}
        out = F.translate(value, "".join(single), "".join(single.values()))
        for symbol, words in table.items():
            if len(words) > 1:
                out = F.replace(out, F.lit(symbol), F.lit(words))
        return F.when(value.rlike(_covering_class(table)), out).otherwise(value)

    return bind(text, replaced)


def replace_symbols(text: ColumnOrName) -> Column:
    return _replace_all(_col(text), SYMBOLS)


def collapse_blanks(text: ColumnOrName) -> Column:
    return F.regexp_replace(_col(text), BLANK_RUN, " ")


def unify_line_ends(text: ColumnOrName) -> Column:
    return F.regexp_replace(_col(text), LINE_END, "\n")


def collapse_empty_lines(text: ColumnOrName) -> Column:
    return F.regexp_replace(_col(text), EMPTY_LINES, "\n\n")


def drop_wrappers(text: ColumnOrName) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(text), BEGIN_WRAPPER, ""), END_WRAPPER, "")


def star_headers_to_colons(text: ColumnOrName) -> Column:
    return F.regexp_replace(_col(text), STAR_HEADER, "$1:")


def drop_line_bullets(text: ColumnOrName) -> Column:
    return F.regexp_replace(_col(text), LINE_BULLET, "")


def unify_line_numbers(text: ColumnOrName) -> Column:
    return F.regexp_replace(_col(text), LINE_NUMBER, "$1. ")


def sanitize_text(text: ColumnOrName, repair: bool = True) -> Column:
    """Unicode repair, symbols, blanks, line ends, empty lines, outer whitespace."""
    out = repair_unicode(text) if repair else _col(text)
    out = collapse_blanks(replace_symbols(out))
    return strip(collapse_empty_lines(unify_line_ends(out)))


def normalize_structure(text: ColumnOrName) -> Column:
    """Wrappers, star headers, bullets and numbering of a report."""
    out = star_headers_to_colons(drop_wrappers(text))
    return strip(unify_line_numbers(drop_line_bullets(out)))


def preprocess_report(text: ColumnOrName, repair: bool = True) -> Column:
    return normalize_structure(sanitize_text(text, repair))


# --- Unicode repair -------------------------------------------------------------

# Characters a UTF-8 continuation byte turns into when read as Windows-1252.
_CONTINUATION = (
    r"\u0080-\u00BF\u0152\u0153\u0160\u0161\u0178\u017D\u017E\u0192\u02C6\u02DC"
    r"\u2013\u2014\u2018-\u201A\u201C-\u201E\u2020-\u2022\u2026\u2030\u2039\u203A\u20AC\u2122"
)
# The same without the signs that stand behind a capital letter in ordinary text.
_CONTINUATION_LETTER = (
    r"\u0080-\u009F\u00A1-\u00AA\u00AC-\u00BA\u00BC-\u00BF\u0152\u0153\u0160\u0161\u0178\u017D"
    r"\u017E\u0192\u02C6\u02DC\u201A\u201E\u2020\u2021\u2030\u20AC"
)
# By lead byte: two bytes of Latin-1 letters; of further Latin letters; of Greek, Cyrillic
# and what follows, where only a run of them is damage; three bytes; four bytes.
_MOJIBAKE = (
    rf"[\u00C2\u00C3][{_CONTINUATION}]|[\u00C4\u00C5][{_CONTINUATION_LETTER}]|\u00C5[\u2019\u201C]"
    rf"|(?:[\u00C6-\u00DF][{_CONTINUATION}]){{2,}}"
    rf"|(?:[\u00E0-\u00EF][{_CONTINUATION}]{{2}})+|(?:[\u00F0-\u00F4][{_CONTINUATION}]{{3}})+"
)
_MISREAD = re.compile(_MOJIBAKE)
# "\u00E0" whose second byte, a hard space, became an ordinary one.
_SPLIT_A = re.compile(r"(?<!\w)\u00C3(?: (?= )|(?= \w))")
_ENTITY = r"&#?[A-Za-z0-9]+;"
# Combining marks, jamo and the compatibility singletons: what NFC can change.
_NOT_NFC = (
    r"[\p{M}\u1100-\u11FF\u0374\u037E\u0387\u1F71-\u1FFF\u2000\u2001\u2126\u212A\u212B"
    r"\u2329\u232A\uF900-\uFAFF]"
)
_MAYBE_NOT_NFC = r"[\u0300-\x{10FFFF}]"
_ESCAPE_SEQUENCE = r"\x1b\[[0-9;]*[A-Za-z]"
_CONTROL = r"[\x00-\x08\x0b\x0e-\x1f\x7f\u206A-\u206F\uFEFF\uFFF9-\uFFFC]"
_LINE_BREAKS = r"\r\n?|[\u2028\u2029\u0085]"

LIGATURES = {
    "\uFB00": "ff",
    "\uFB01": "fi",
    "\uFB02": "fl",
    "\uFB03": "ffi",
    "\uFB04": "ffl",
    "\uFB05": "st",
    "\uFB06": "st",
    "\u0132": "IJ",
    "\u0133": "ij",
}
QUOTES = {
    "\u2018": "'",
    "\u2019": "'",
    "\u201A": "'",
    "\u201B": "'",
    "\u201C": '"',
    "\u201D": '"',
    "\u201E": '"',
    "\u201F": '"',
}
# Full-width forms sit at a constant distance from their ASCII counterparts.
WIDE = {chr(code + 0xFEE0): chr(code) for code in range(0x21, 0x7F)} | {"\u3000": " "}


def _decode_run(match: re.Match) -> str:
    raw = bytearray()
    for char in match.group():
        try:
            raw += char.encode("windows-1252")
        except UnicodeEncodeError:
            raw.append(ord(char) & 0xFF)
    try:
        found = raw.decode("utf-8")
    except UnicodeDecodeError:
        return match.group()
    # One ideograph alone is rather an accented letter before two quotes.
    alone = len(found) == 1 and found >= "\u0800" and unicodedata.category(found) == "Lo"
    return match.group() if alone else found


def undo_mojibake(text: str) -> str:
    """Also where a text was damaged several times; each pass makes it shorter."""
    while (repaired := RUN.sub(_decode_parts, text)) != text:
        text = repaired
    return text


def _decode_parts(run: re.Match) -> str:
    """What ``_MOJIBAKE`` matches lies within a run of characters beyond ASCII."""
    return _MISREAD.sub(_decode_run, run.group())


def undo_damage(text: str) -> str:
    """Damage by one code page after another is undone from the last one on, until nothing changes."""
    if text.isascii():
        return text
    while True:
        # a layer by any page first: what is left below it may be by that page again
        paged = undo_pages(_SPLIT_A.sub("\u00E0", text))
        repaired = paged if paged != text else undo_mojibake(text)
        if repaired == text:
            return text
        text = repaired


@F.pandas_udf(T.StringType())
def _repair(texts: pd.Series) -> pd.Series:
    def one(text):
        if text is None:
            return None
        if "<" not in text:
            text = html.unescape(text)
        return unicodedata.normalize("NFC", undo_damage(text))

    return texts.map(one, na_action="ignore")


# Marked so that Spark calls it once per row instead of copying it to where it is used.
_repair = _repair.asNondeterministic()


def repair_unicode(text: ColumnOrName) -> Column:
    """HTML entities, mojibake, ligatures, widths, quotes, line breaks, controls, NFC."""
    raw = _col(text)
    not_nfc = raw.rlike(_MAYBE_NOT_NFC) & raw.rlike(_NOT_NFC)
    suspect = raw.rlike(_ENTITY) | raw.rlike(f"{BEYOND_ASCII}(?:{_MOJIBAKE})") | raw.rlike(SUSPECT) | raw.rlike(_SPLIT_A.pattern) | not_nfc
    out = F.coalesce(_repair(F.when(suspect, raw)), raw)
    out = _replace_all(out, WIDE | QUOTES | LIGATURES)
    out = F.regexp_replace(out, _ESCAPE_SEQUENCE, "")
    return F.regexp_replace(F.regexp_replace(out, _LINE_BREAKS, "\n"), _CONTROL, "")
