"""RE2-syntax patterns as Spark ``rlike`` patterns.

Rule authors write RE2.  Spark matches with ``java.util.regex``, where the same
text means something slightly different.  ``to_java`` rewrites the constructs
that differ:

* ``\\b`` / ``\\B`` only look at ASCII word characters,
* ``\\s`` has no vertical tab,
* ``(?i)`` folds case by Unicode,
* ``.`` stops at a newline only, and ``$`` is the very end of the text.

RE2 has no look-around, back-references or possessive repetition; patterns that
use them are refused, as the rule format promises.
"""

from __future__ import annotations

import re
import re._parser as sre
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_SPACE = r"\t\n\f\r "
_WORD = "[A-Za-z0-9_]"
# Case folding is off inside: with it on, the class would also take U+017F and U+212A.
_BOUNDARY = f"(?-iu:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
_NOT_BOUNDARY = f"(?-iu:(?<!{_WORD})(?!{_WORD})|(?<={_WORD})(?={_WORD}))"

# Pieces of a pattern that need a decision; everything else passes through.
_PIECE = re.compile(r"\\(?P<esc>.)|\(\?(?P<ext>[^)]?[^)]?)|(?P<posix>\[:\^?\w+:\])|(?P<chr>.)", re.S)


class BadPattern(ValueError):
    """A pattern that is not valid RE2."""


def to_java(pattern: str) -> str:
    """Rewrite one RE2 pattern for ``java.util.regex``."""
    multiline = bool(re.search(r"\(\?[a-zA-Z]*m", pattern))
    out: list[str] = []
    in_class = False
    class_start = -1
    for piece in _PIECE.finditer(pattern):
        esc, ext, posix, char = piece["esc"], piece["ext"], piece["posix"], piece["chr"]
        if esc is not None:
            if esc.isdigit() and esc != "0" and not in_class:
                raise BadPattern(f"back-reference in {pattern!r}")
            if esc == "s":
                out.append(_SPACE if in_class else f"[{_SPACE}]")
            elif esc == "S":
                out.append(f"[^{_SPACE}]")
            elif esc == "b" and not in_class:
                out.append(_BOUNDARY)
            elif esc == "B" and not in_class:
                out.append(_NOT_BOUNDARY)
            elif esc == "z":
                out.append(r"\z")
            elif esc in "ZGXRhHvVkK":
                raise BadPattern(f"\\{esc} in {pattern!r}")
            else:
                out.append("\\" + esc)
        elif ext is not None:
            if ext[:1] in ("=", "!", ">") or ext in ("<=", "<!"):
                raise BadPattern(f"look-around in {pattern!r}")
            if ext == "P<":
                out.append("(?<")
            elif ext[:1] == "P":
                raise BadPattern(f"bad group in {pattern!r}")
            else:
                out.append("(?" + ext)
        elif posix is not None:
            if in_class:
                negated, name = posix[2] == "^", posix.strip("[]:^")
                java = {"alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank",
                        "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower",
                        "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper",
                        "xdigit": "XDigit"}.get(name)
                if name == "word":
                    out.append(r"\W" if negated else r"\w")
                elif java is None:
                    raise BadPattern(f"{posix} in {pattern!r}")
                else:
                    out.append(("\\P" if negated else "\\p") + "{" + java + "}")
            else:
                # A class that happens to start with a colon.
                out.append(posix)
        elif in_class:
            first = piece.start() == class_start + 1 or (
                piece.start() == class_start + 2 and pattern[class_start + 1] == "^")
            if char == "]" and not first:
                in_class = False
                out.append(char)
            elif char in "[&" or (char == "]" and first):
                out.append("\\" + char)
            else:
                out.append(char)
        elif char == "[":
            in_class, class_start = True, piece.start()
            out.append(char)
        elif char == "$" and not multiline:
            out.append(r"\z")
        elif char == "+" and out and out[-1] in ("*", "+", "?", "}"):
            raise BadPattern(f"possessive or stacked repetition in {pattern!r}")
        else:
            out.append(char)
    if in_class:
        raise BadPattern(f"missing ] in {pattern!r}")
    text = "".join(out)
    # Ungreedy changes which text is matched, not whether any is; group names are plain letters in Java.
    text = re.sub(r"(?<!\\)\(\?([a-zA-Z-]*)([:)])", lambda m: "(?" + (m[1].replace("U", "") or "d" * (m[2] == ")")) + m[2], text)
    names: dict[str, str] = {}
    text = re.sub(r"(?<!\\)\(\?<([A-Za-z_]\w*)>", lambda m: f"(?<g{names.setdefault(m[1], str(len(names)))}>", text)
    text = text.translate(UNFOLDED)
    # Flags are per group in both dialects: add Unicode folding wherever i is on.
    text = re.sub(r"\(\?([a-z]*i[a-z]*)([-:)])", r"(?\1u\2", text)
    return "(?d)" + text


#: Letters that Java folds to ``i`` and RE2 does not; a letter without a case partner stands in for them.
UNFOLDED = {0x130: "\u0237", 0x131: "\u0237"}


def unfolded(text: Column) -> Column:
    """``text`` as the patterns search it: without the letters that only Java folds."""
    return F.when(text.contains("\u0130") | text.contains("\u0131"), F.translate(text, "\u0130\u0131", "\u0237\u0237")).otherwise(text)


def lowered(text: Column) -> Column:
    """Lower case in which U+0130 is a plain ``i``, one character."""
    plain = F.when(text.contains("\u0130"), F.replace(text, F.lit("\u0130"), F.lit("i"))).otherwise(text)
    return F.lower(plain)


def matches(text: Column, pattern: str) -> Column:
    """Does an RE2 pattern match anywhere in ``text`` (see ``unfolded``)?"""
    return text.rlike(to_java(pattern))


def matches_any(text: Column, patterns) -> Column:
    """One ``rlike`` over the alternation of several RE2 patterns.

    A literal pattern is compiled once per task; one alternation also scans the
    text once instead of once per pattern.
    """
    joined = "|".join(f"(?:{to_java(p)})" for p in patterns)
    return text.rlike(joined) if joined else F.lit(False)


def word_pattern(words) -> str:
    """Case-insensitive whole-word alternation, in RE2 syntax."""
    return r"(?i)\b(" + "|".join(words) + r")\b"


def required_literals(pattern: str) -> list[str]:
    """Lower-case texts of which one must occur in anything the pattern matches.

    Empty when none can be named with certainty.  Only plain sequences and a top-level
    choice are looked into; everything optional or repeated is ignored.
    """
    if "[:" in pattern or "(?x" in pattern:
        return []  # valid in both syntaxes, but not the same pattern
    try:
        tree = sre.parse(pattern.replace(r"\z", r"\Z"))
    except Exception:  # not Python syntax: no hint
        return []

    def longest(items) -> list[str]:
        best, run = [], ""
        for op, arg in list(items) + [(None, None)]:
            if op is sre.LITERAL and arg < 128:
                run += chr(arg).lower()
                continue
            best, run = (best if best and len(min(best, key=len)) >= len(run) else [run]) if run else best, ""
            inner = []
            if op is sre.SUBPATTERN:
                inner = longest(arg[3])
            elif op is sre.BRANCH:
                inner = [longest(branch) for branch in arg[1]]
                inner = [t for texts in inner for t in texts] if all(inner) else []
            if inner and (not best or len(min(inner, key=len)) > len(min(best, key=len))):
                best = inner
        return best

    return longest(tree)


def matches_hinted(text: Column, lowered: Column, patterns) -> Column:
    """``matches_any`` behind a substring test on the lower-case text.

    Each pattern runs only where a text it requires occurs.  U+017F is the one character
    that folds to ASCII without lower-casing to it; where it occurs, every pattern runs.
    """
    tests = []
    for pattern in patterns:
        hints = required_literals(pattern)
        regex = matches(text, pattern)
        if hints:
            hint = reduce(Column.__or__, [lowered.contains(h) for h in hints])
            regex = (hint | lowered.contains("\u017f")) & regex
        tests.append(regex)
    return reduce(Column.__or__, tests) if tests else F.lit(False)


def has_word(lowered: Column, words) -> Column:
    """``word_pattern`` on text that is lower case already, at a fraction of its cost.

    Substring tests settle most texts; only a text with a candidate runs the regex, which
    needs no case folding.  U+017F folds to ``s`` but is no ASCII word character, so the
    rare text that has one takes the general pattern.
    """
    # Over an array literal, so that forty tests do not become forty pieces of generated code.
    stems = F.array(*[F.lit(w.replace("s?", "")) for w in words])
    candidate = F.exists(stems, lowered.contains)
    heads = "".join(sorted({w[0] for w in words}))
    plain = lowered.rlike(f"(?=[{heads}])(?<!{_WORD})(?:{'|'.join(words)})(?!{_WORD})")
    return (F.when(lowered.contains("\u017f"), matches(lowered, word_pattern(words)))
            .otherwise(candidate & plain))


def check_patterns(spark: SparkSession, patterns) -> None:
    """Compile every pattern before any data is read; raise on the first bad one."""
    for pattern in patterns:
        java = to_java(pattern)
        try:
            spark.range(1).select(F.lit("").rlike(java)).collect()
        except Exception as err:  # Spark wraps the regex error in its own types
            raise BadPattern(f"bad pattern {pattern!r}: {err}") from err
