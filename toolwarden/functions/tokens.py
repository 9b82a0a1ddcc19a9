"""Token estimates of tool definitions, entirely in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .jsontext import compact_json

# A run of n letters gives ceil(n/4) matches, of n digits ceil(n/3); every other
# visible code point is one.
TOKEN_PATTERN = r"\p{L}{1,4}|\p{Nd}{1,3}|[^\p{L}\p{Nd}\p{IsWhite_Space}]"


def token_base(text: Column) -> Column:
    """Unscaled token count of a text.

    Each token becomes one character, which is a fraction of the work of listing them all.  A last
    token of its own keeps white space from ending the text.
    """
    marks = F.regexp_replace(F.concat(text, F.lit("}")), rf"\p{{IsWhite_Space}}*(?:{TOKEN_PATTERN})", "x")
    return F.length(marks) - 1


def scale_tokens(base: Column, factor: float | Column, text: Column | None = None) -> Column:
    """Scale a base count for a model family and round half up.

    Non-empty text costs at least one token; pass ``text`` when it can be blank.
    """
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    estimate = base * factor
    if text is None:
        floor = F.when(estimate < 1, F.lit(1.0)).otherwise(estimate)
    else:
        floor = F.when((estimate < 1) & (F.length(text) > 0), F.lit(1.0)).otherwise(estimate)
    return F.floor(floor + 0.5).cast("bigint")


def token_estimate(text: Column, factor: float = C.MODELS[0][3]) -> Column:
    """Estimated tokens of a text for one model family."""
    return scale_tokens(token_base(text), factor, text)


def serialize_tool(name: Column, description: Column, input_schema: Column) -> Column:
    """A tool as it is put into a request: compact JSON, sorted keys, HTML-safe."""
    def literal(text: Column) -> Column:
        # {"v":"…"} without its wrapper is the quoted string.
        wrapped = F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("v")))
        return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)

    schema = F.when(F.length(input_schema) > 0,
                    F.concat(F.lit(',"inputSchema":'), compact_json(input_schema)))
    text = F.concat(F.lit('{"description":'), literal(description),
                    F.coalesce(schema, F.lit("")),
                    F.lit(',"name":'), literal(name), F.lit("}"))
    for char in ("<", ">", "&", "\u2028", "\u2029"):
        text = F.replace(text, F.lit(char), F.lit(f"\\u{ord(char):04x}"))
    return text
