"""Text detectors: hidden characters, encoded payloads, capability words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .regex import has_word, to_java

ZERO_WIDTH = r"\x{200b}-\x{200d}\x{feff}"
BIDI = r"\x{202a}-\x{202e}\x{2066}-\x{2069}"

_FOREIGN = (r"\x{370}-\x{1fff}\x{2100}-\x{214f}\x{2de0}-\x{2dff}\x{a640}-\x{abff}\x{fe2e}\x{fe2f}"
            r"\x{10000}-\x{10ffff}")
# Plain ranges come first: they settle ASCII letters, whose script would be looked up otherwise.
_LATIN = r"[a-zA-Z[\p{L}&&\p{IsLatin}]]"
_LOOKALIKE = r"[\x{370}-\x{10ffff}&&[\p{L}&&[\p{IsCyrillic}\p{IsGreek}]]]"
_NEUTRAL = r"[\x{80}-\x{10ffff}&&[\p{L}&&[^\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]]]"


def mixed_script_word(text: Column) -> Column:
    """Does one word mix Latin with Cyrillic or Greek letters?

    A run of letters that holds both scripts holds a neighbouring pair of them with
    only letters of other scripts between, which is what the pattern looks for.
    """
    between = f"{_NEUTRAL}*+"
    return text.rlike(f"{_LATIN}{between}{_LOOKALIKE}|{_LOOKALIKE}{between}{_LATIN}")


def invisible_reason(text: Column) -> Column:
    """Why a text is deceptive, reasons in order of appearance; NULL if it is not."""
    zero, bidi = text.rlike(f"[{ZERO_WIDTH}]"), text.rlike(f"[{BIDI}]")
    bidi_first = F.regexp_extract(text, f"[{ZERO_WIDTH}{BIDI}]", 0).rlike(f"[{BIDI}]")
    zero_name, bidi_name = "zero-width characters", "bidirectional control characters"
    hidden = (F.when(zero & bidi, F.when(bidi_first, F.lit(f"{bidi_name} and {zero_name}"))
                     .otherwise(F.lit(f"{zero_name} and {bidi_name}")))
              .when(zero, F.lit(zero_name)).when(bidi, F.lit(bidi_name)))
    mixed = F.concat_ws(" and ", hidden, F.lit("mixed-script (homoglyph) text"))
    # Cheap looks decide for the usual, harmless text: ASCII has nothing to find, and plain ranges
    # cover all hidden characters and every block with Greek or Cyrillic letters.
    ascii_only = F.octet_length(text) == F.char_length(text)
    suspect = ~ascii_only & text.rlike(f"[{ZERO_WIDTH}{BIDI}{_FOREIGN}]")
    lookalikes = text.rlike(f"[{_FOREIGN}]") & mixed_script_word(text)
    return F.when(suspect, F.when(lookalikes, mixed).otherwise(hidden))


def encoded_payload(text: Column) -> Column:
    """Text hidden in the first base64 run that decodes to mostly printable bytes."""
    # Only where a run begins: without that, every rest of every word would be tried too.
    unit = "[A-Za-z0-9+/=]"
    runs = F.regexp_extract_all(text, F.lit(f"(?<!{unit}){unit}{{{C.BLOB_MIN_CHARS},}}+"), F.lit(0))
    strict = F.filter(runs, lambda run: (F.length(run) % 4 == 0) & run.rlike(r"^[A-Za-z0-9+/]++={0,2}\z"))
    decoded = F.transform(strict, lambda run: F.unbase64(run))

    def readable(raw: Column) -> Column:
        size = F.octet_length(raw)
        printable = F.regexp_count(F.decode(raw, "ISO-8859-1"), F.lit(r"[\x20-\x7e]"))
        return (size >= C.BLOB_MIN_BYTES) & (printable / size > C.BLOB_PRINTABLE_SHARE)

    first = F.try_element_at(F.filter(decoded, readable), F.lit(1))
    return F.make_valid_utf8(first.cast("string"))


def quoted(text: Column) -> Column:
    """A double-quoted display form in which nothing is invisible."""
    short = {"\\": "\\\\", '"': '\\"', "\a": "\\a", "\b": "\\b", "\f": "\\f",
             "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v"}

    def show(char: Column) -> Column:
        code = F.ascii(char)
        col = F.when(char == "\\", F.lit("\\\\"))
        for raw, shown in short.items():
            col = col.when(char == raw, F.lit(shown))
        return (col.when((code < 0x20) | (code == 0x7F), F.concat(F.lit("\\x"), _hex(code, 2)))
                .when(char.rlike(r"[\p{C}\p{Z}&&[^ ]]"),
                      F.when(code > 0xFFFF, F.concat(F.lit("\\U"), _hex(code, 8)))
                      .otherwise(F.concat(F.lit("\\u"), _hex(code, 4))))
                .otherwise(char))

    # What stays as it is, is one piece, however long; what is shown otherwise, one each.
    pieces = F.regexp_extract_all(text, F.lit(r'(?s)[ [^"\\\p{C}\p{Z}]]++|.'), F.lit(0))
    shown = F.array_join(F.transform(pieces, show), "")
    plain = text.rlike(r'^[\x20-\x7e&&[^"\\]]*+\z')
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(shown), F.lit('"'))


def _hex(code: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(code)), width, "0")


_CONTROL = r"\x00-\x1f\x7f-\x9f"
_DIRECTION = r"\x{061c}\x{200e}\x{200f}" + BIDI


#: One character of well-formed UTF-8, its bytes read as Latin-1: no overlong form, no surrogate, nothing beyond U+10FFFF.
_TAIL = r"[\x80-\xbf]"
_SEQUENCE = "|".join((
    r"[\x00-\x7f]", rf"[\xc2-\xdf]{_TAIL}", rf"\xe0[\xa0-\xbf]{_TAIL}", rf"[\xe1-\xec\xee\xef]{_TAIL}{{2}}",
    rf"\xed[\x80-\x9f]{_TAIL}", rf"\xf0[\x90-\xbf]{_TAIL}{{2}}", rf"[\xf1-\xf3]{_TAIL}{{3}}", rf"\xf4[\x80-\x8f]{_TAIL}{{2}}"))
#: The bytes of a control or direction character beyond ASCII.
_SHOWN = r"\xc2[\x80-\x9f]|\xd8\x9c|\xe2\x80[\x8e\x8f\xaa-\xae]|\xe2\x81[\xa6-\xa9]"
#: Runs that stay as they are, or single characters, in bytes read as Latin-1 (where a broken byte is one too) and in text.
_UNITS = rf"(?s)[ -~]++|(?:(?!{_SHOWN}|[\x00-\x7f])(?:{_SEQUENCE})){{1,64}}+|{_SEQUENCE}|."
_PIECES = f"(?s)[^{_CONTROL}{_DIRECTION}]++|."


def is_hostile(text: Column, keep_lines: bool = False) -> Column:
    """Does the text carry broken bytes, or control or direction characters a terminal would obey?

    ``text`` is a string or the bytes of one.
    """
    control = r"\x00-\x08\x0b-\x1f\x7f-\x9f" if keep_lines else _CONTROL
    text = text.cast("string")
    return ~F.is_valid_utf8(text) | text.rlike(f"[{control}{_DIRECTION}]")


def escape_controls(text: Column, keep_lines: bool = False) -> Column:
    """The text with every control, direction and invalid byte made visible.

    ``text`` is a string or the bytes of one; bytes that are no UTF-8 show one by one.
    """
    text = text.cast("string")
    latin = F.decode(text.cast("binary"), "ISO-8859-1")
    # Runs of printable characters, else whole characters where the bytes are one, single bytes elsewhere.
    units = F.regexp_extract_all(latin, F.lit(_UNITS), F.lit(0))

    def show_bytes(unit: Column) -> Column:
        broken = (F.length(unit) == 1) & (F.ascii(unit) >= 0x80)
        return F.when(broken, F.concat(F.lit("\\x"), _hex(F.ascii(unit), 2))).otherwise(
            show(F.decode(F.encode(unit, "ISO-8859-1"), "UTF-8")))

    def show(char: Column) -> Column:
        code = F.ascii(char)
        col = F.when((code < 0x20) | (code == 0x7F), F.concat(F.lit("\\x"), _hex(code, 2)))
        if keep_lines:
            col = F.when(char.isin("\n", "\t"), char).otherwise(col)
        return F.coalesce(col, F.when(char.rlike(f"[\\x80-\\x9f{_DIRECTION}]"),
                                      F.concat(F.lit("\\u"), _hex(code, 4))), char)

    # What stays as it is, is one piece, however long.
    pieces = F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0))
    shown = F.array_join(F.transform(pieces, show), "")
    return (F.when(~F.is_valid_utf8(text), F.array_join(F.transform(units, show_bytes), ""))
            .when(is_hostile(text, keep_lines), shown).otherwise(text))


_CLASS_ORDER = sorted(name for name, _, _ in C.CAPABILITY_WORDS)

# Any name that can decide a class, or an escape that could hide one.
SCHEMA_HINT = r"(?i)" + "|".join(sorted({n for _, _, names in C.CAPABILITY_WORDS for n in names}) + [r"\\u"])


def capability_classes(text: Column, properties: Column) -> Column:
    """Sorted capability classes a tool declares by its lower-case text or property names."""
    by_name = {cls: (words, names) for cls, words, names in C.CAPABILITY_WORDS}
    held = F.array(*[
        F.when(has_word(text, by_name[cls][0]) | has_word(properties, by_name[cls][1]), F.lit(cls))
        for cls in _CLASS_ORDER])
    # array_except drops the NULLs inside generated code; array_compact would not.
    return F.array_except(held, F.array(F.lit(None).cast("string")))


def schema_matters(schema: Column) -> Column:
    """Can the property names of this schema decide any class at all?"""
    return schema.rlike(to_java(SCHEMA_HINT))
