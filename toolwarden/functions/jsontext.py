"""The few pieces of JSON and Unicode work Spark has no built-in for.

Each is a small Arrow-batched helper over one text column: NFC, canonical JSON,
schema property names, and the tool list of a capture with every input schema
kept as its exact source text.  Rows that cannot need the work are passed to
Python as NULL, so they cost nothing there.
"""

from __future__ import annotations

import json
import math
import re
import sys
import unicodedata
from decimal import Decimal
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship the helpers with each task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SURROGATE = re.compile("[\ud800-\udfff]")
_SPACES = re.compile(r"[ \t\n\r]*")


def _refuse(token):
    raise ValueError(token)


def _finite(text: str) -> float:
    value = float(text)
    if math.isinf(value):
        raise ValueError("number out of range")
    return value


def _reader() -> json.JSONDecoder:
    """Numbers as doubles.  Built per text: a decoder cannot travel with a task."""
    return json.JSONDecoder(parse_float=_finite, parse_int=_finite, parse_constant=_refuse)


class _Numeral(str):
    """A number as it stands in the text; no string of the document."""


def _shallow() -> json.JSONDecoder:
    """Numbers left as they stand, for walks that only need the structure."""
    return json.JSONDecoder(parse_float=_Numeral, parse_int=_Numeral, parse_constant=_refuse)


def _number_text(x: float) -> str:
    """Shortest text of a double; exponent form below 1e-6 and from 1e21."""
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    if abs(x) < 1e15 and x == int(x):
        return str(int(x))
    if 1e-6 <= abs(x) < 1e21:
        return format(Decimal(repr(x)), "f").removesuffix(".0")
    mantissa, _, exponent = format(Decimal(repr(x)).normalize(), "e").partition("e")
    return f"{mantissa}e{exponent[0]}{exponent[1:].lstrip('0')}"


def _string_text(s: str) -> str:
    s = _SURROGATE.sub("\ufffd", unicodedata.normalize("NFC", s))
    return json.dumps(s, ensure_ascii=False).replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")


def _write(value, out: list) -> None:
    """Append the canonical text of a value; an explicit stack, so depth costs no recursion."""
    todo = [value]
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):  # text that is ready
            out.append(node[0])
        elif isinstance(node, str):
            out.append(_string_text(node))
        elif node is None:
            out.append("null")
        elif isinstance(node, bool):
            out.append("true" if node else "false")
        elif isinstance(node, float):
            out.append(_number_text(node))
        elif isinstance(node, list):
            todo.append(("]",))
            for i in range(len(node) - 1, -1, -1):
                todo.append(node[i])
                if i:
                    todo.append((",",))
            todo.append(("[",))
        else:
            normal = {_SURROGATE.sub("\ufffd", unicodedata.normalize("NFC", k)): v for k, v in node.items()}
            todo.append(("}",))
            keys = sorted(normal)
            for i in range(len(keys) - 1, -1, -1):
                todo += [normal[keys[i]], (f"{',' if i else ''}{_string_text(keys[i])}:",)]
            todo.append(("{",))


def canonical_text(text: str | None) -> str | None:
    """Sorted keys, kept array order, no spaces, NFC strings, doubles as numbers."""
    if text is None or not text.strip(" \t\n\r"):
        return None
    try:
        value = _reader().decode(text)
    except (ValueError, RecursionError):
        return text
    out: list[str] = []
    _write(value, out)
    return "".join(out)


_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*"|[\[{]|[\]}]', re.S)


def nesting(text: str | None) -> int:
    """Deepest nesting of a JSON text; 0 for a blank or invalid one.  Text too deep to decode is still measured."""
    if text is None or not text.strip(" \t\n\r"):
        return 0
    try:
        _shallow().decode(text)
    except RecursionError:
        pass
    except ValueError:
        return 0
    now = deepest = 0
    for token in _TOKENS.findall(text):
        if token in "[{":
            now += 1
            deepest = max(deepest, now)
        elif token in "]}":
            now -= 1
    return deepest


def property_names(text: str | None) -> str:
    """Lowercased names of all properties at any depth, joined by spaces."""
    if not text:
        return ""
    try:
        todo = [_shallow().decode(text)]
    except (ValueError, RecursionError):
        return ""
    names = []
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo.extend(node)
        elif isinstance(node, dict):
            declared = node.get("properties")
            if isinstance(declared, dict):
                names.extend(declared)
                todo.extend(declared.values())
            todo.extend(v for k, v in node.items() if k != "properties")
    return _SURROGATE.sub("\ufffd", " ".join(names).lower())


def _skip(text: str, at: int) -> int:
    return _SPACES.match(text, at).end()


def _members(decoder, text: str, at: int):
    """(key, start, end) of each member of the object starting at ``at``."""
    at = _skip(text, at + 1)
    while text[at] != "}":
        key, at = json.decoder.scanstring(text, at + 1)
        start = _skip(text, _skip(text, at) + 1)
        _, end = decoder.raw_decode(text, start)
        yield key, start, end
        at = _skip(text, end)
        if text[at] == ",":
            at = _skip(text, at + 1)


def _elements(decoder, text: str, at: int):
    """(start, end) of each element of the array starting at ``at``."""
    at = _skip(text, at + 1)
    while text[at] != "]":
        _, end = decoder.raw_decode(text, at)
        yield at, end
        at = _skip(text, end)
        if text[at] == ",":
            at = _skip(text, at + 1)


_FIELDS = ("protocolVersion", "serverInfo", "version", "tools", "resources", "prompts", "name", "description", "inputSchema",
           "uri", "mimeType", "server", "schema_version", "protocol_version", "input_schema", "mime_type")
_FOLDED = {name.casefold(): name for name in _FIELDS}


def _odd(node: dict) -> bool:
    """Whether a member name is one of ours but for its case."""
    return any(k not in _FOLDED.values() and k.casefold() in _FOLDED for k in node)


def _object(decoder, text: str, at: int, node: dict) -> tuple[dict, dict]:
    """Members by their proper names, and where their source text stands.

    A name counts in any case, as it does for the servers' usual clients; of several that mean the
    same member the last one counts, unless it is null.
    """
    if not isinstance(node, dict):
        raise ValueError("no object")
    spans = {}
    if not _odd(node):
        for key, start, end in _members(decoder, text, at):
            spans[key] = (start, end)
        return node, spans
    found: dict = {}
    for key, start, end in _members(decoder, text, at):
        name = _FOLDED.get(key.casefold(), key)
        value = decoder.decode(text[start:end])
        if value is not None or name not in found:
            found[name] = value
        if value is not None or name in ("inputSchema", "input_schema") or name not in spans:
            spans[name] = (start, end)
    return found, spans


def _plain_text(value) -> str:
    if value is None:
        return ""
    if type(value) is not str:
        raise ValueError("no text")
    return _SURROGATE.sub("\ufffd", value)


def _list_of(decoder, text: str | None, name: str, decode) -> list[tuple[dict, dict]] | None:
    """Members and spans of the elements of a list result; None if there is no such list."""
    if text is None:
        return None
    node = decode(text)
    if isinstance(node, dict) and not _odd(node) and all(
            item is None or isinstance(item, dict) and not _odd(item) for item in _items(node.get(name))):
        items = node.get(name)
        if items is None or not isinstance(items, list):
            return [] if items is None else None
        # Only schemas are kept as source text.
        schemas = name == "tools" and any(k in item for item in items if item for k in _SCHEMA_KEYS)
        spans = _schema_spans(decoder, text) if schemas else [{}] * len(items)
        return [(item or {}, span) for item, span in zip(items, spans)]
    document, spans = _object(decoder, text, _skip(text, 0), node)
    items = document.get(name)
    if items is None:
        return []
    if not isinstance(items, list):
        return None
    return [({}, {}) if item is None else _object(decoder, text, start, item)
            for item, (start, _) in zip(items, _elements(decoder, text, spans[name][0]))]


_SCHEMA_KEYS = ("inputSchema", "input_schema")


def _items(value) -> list:
    return value if isinstance(value, list) else []


def _schema_spans(decoder, text: str) -> list[dict]:
    """Where the schemas of each tool stand, in a valid document of proper names; every value is passed once."""
    found: list[dict] = []
    at = _skip(text, _skip(text, 0) + 1)
    while text[at] != "}":
        key, at = json.decoder.scanstring(text, at + 1)
        at = _skip(text, _skip(text, at) + 1)
        if key == "tools" and text[at] == "[":
            found = []
            at = _skip(text, at + 1)
            while text[at] != "]":
                if text[at] == "{":
                    spans = {}
                    at = _skip(text, at + 1)
                    while text[at] != "}":
                        name, at = json.decoder.scanstring(text, at + 1)
                        start = _skip(text, _skip(text, at) + 1)
                        _, at = decoder.raw_decode(text, start)
                        if name in _SCHEMA_KEYS:
                            spans[name] = (start, at)
                        at = _skip(text, at)
                        if text[at] == ",":
                            at = _skip(text, at + 1)
                    at += 1
                else:
                    spans = {}
                    _, at = decoder.raw_decode(text, at)
                found.append(spans)
                at = _skip(text, at)
                if text[at] == ",":
                    at = _skip(text, at + 1)
            at += 1
        else:
            _, at = decoder.raw_decode(text, at)
        at = _skip(text, at)
        if text[at] == ",":
            at = _skip(text, at + 1)
    return found


def tool_list(text: str | None, decode=None):
    """Tools of a list result, schemas as source text; None if it is no list result."""
    try:
        decoder = _shallow()
        items = _list_of(decoder, text, "tools", decode or decoder.decode)
        if items is None:
            return None
        out = []
        for tool, spans in items:
            span = spans.get("inputSchema") or spans.get("input_schema")
            out.append((_plain_text(tool.get("name")), _plain_text(tool.get("description")), text[slice(*span)] if span else None))
        return out
    except (ValueError, AttributeError, RecursionError):
        return None


def _texts_list(text: str | None, name: str, fields: tuple[tuple[str, ...], ...], decode=None) -> list[tuple]:
    """The texts of the elements of a list result; anything that is no such list is an empty one."""
    try:
        decoder = _shallow()
        items = _list_of(decoder, text, name, decode or decoder.decode) or []
        return [tuple(_plain_text(next((item[f] for f in names if f in item), None)) for names in fields) for item, _ in items]
    except (ValueError, AttributeError, RecursionError):
        return []


def resource_list(text: str | None, decode=None) -> list[tuple]:
    return _texts_list(text, "resources", (("uri",), ("name",), ("description",), ("mimeType", "mime_type")), decode)


def prompt_list(text: str | None, decode=None) -> list[tuple]:
    return _texts_list(text, "prompts", (("name",), ("description",)), decode)


def server_info(text: str | None, member: str = "serverInfo", decode=None) -> tuple[str, str, str]:
    """Name, version and protocol version from an initialize result, or from the ``server`` of a manifest."""
    try:
        decoder = _shallow()
        document, spans = (decode or decoder.decode)(text), {}
        if not isinstance(document, dict) or _odd(document) or isinstance(document.get(member), dict) and _odd(document[member]):
            document, spans = _object(decoder, text, _skip(text, 0), document)
        info = document.get(member)
        if not isinstance(info, dict):
            info = {}
        elif spans:
            info, _ = _object(decoder, text, spans[member][0], info)
        protocol = info.get("protocol_version") if member == "server" else document.get("protocolVersion")
        return _plain_text(info.get("name")), _plain_text(info.get("version")), _plain_text(protocol)
    except (TypeError, ValueError, AttributeError, RecursionError):
        return "", "", ""


def _once():
    """A decoder for the messages of one capture: a text that stands for several is decoded once."""
    decoder, known = _shallow(), {}

    def decode(text):
        if text not in known:
            known[text] = decoder.decode(text)
        return known[text]

    return decode


def _normal(rows: list[tuple] | None) -> list[tuple] | None:
    return None if rows is None else [tuple(unicodedata.normalize("NFC", t) for t in row) for row in rows]


def _normal_tools(rows: list[tuple] | None) -> list[tuple] | None:
    return None if rows is None else [(*_normal([row[:2]])[0], canonical_text(row[2])) for row in rows]


_TOOL, _RESOURCE, _PROMPT = ("name", "description", "input_schema"), ("uri", "name", "description", "mime_type"), ("name", "description")


def _rows_type(names: tuple[str, ...]) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in names]))


_SERVER = ("server_name", "server_version", "protocol_version")
PARTS_TYPE = T.StructType([
    *[T.StructField(n, T.StringType()) for n in _SERVER],
    T.StructField("tools", _rows_type(_TOOL)), T.StructField("resources", _rows_type(_RESOURCE)), T.StructField("prompts", _rows_type(_PROMPT)),
    T.StructField("canonical_tools", _rows_type(_TOOL)), T.StructField("canonical_resources", _rows_type(_RESOURCE)),
    T.StructField("canonical_prompts", _rows_type(_PROMPT))])


#: Characters of messages whose decoded forms are held at a time.
_HELD = 1 << 20


def _arrow_rows(lists: list, names: tuple[str, ...]) -> pa.Array:
    flat = [row for rows in lists if rows for row in rows]
    fields = [pa.field(n, pa.string()) for n in names]
    values = pa.StructArray.from_arrays([pa.array([row[k] for row in flat], pa.string()) for k in range(len(names))], fields=fields)
    ends = [0, *accumulate(len(rows or ()) for rows in lists)]
    starts = [None if rows is None else start for rows, start in zip(lists, ends)]
    return pa.ListArray.from_arrays(pa.array([*starts, ends[-1]], pa.int32()), values)


def _pieces(messages: list[pa.Array]):
    """Runs of rows, each of at most ``_HELD`` characters or a single row."""
    low, held = 0, 0
    sizes = [pc.fill_null(pc.binary_length(m), 0).to_pylist() for m in messages]
    for at, size in enumerate(map(sum, zip(*sizes))):
        if at > low and held + size > _HELD:
            yield low, at
            low, held = at, 0
        held += size
    yield low, len(messages[0])


def _parts(init: pa.Array, tools: pa.Array, resources: pa.Array, prompts: pa.Array, member: str, canonical: bool) -> pa.Array:
    messages = [init, tools, resources, prompts]
    found = [_some_parts(*(m.slice(low, high - low).to_pylist() for m in messages), member, canonical) for low, high in _pieces(messages)]
    return found[0] if len(found) == 1 else pa.concat_arrays(found)


def _some_parts(init: list, tools: list, resources: list, prompts: list, member: str, canonical: bool) -> pa.Array:
    servers, raw = [], ([], [], [])
    for i, t, r, p in zip(init, tools, resources, prompts):
        decode = _once()
        servers.append(server_info(i, member, decode))
        for column, value in zip(raw, (tool_list(t, decode), resource_list(r, decode), prompt_list(p, decode))):
            column.append(value)
    normal = ([[_normal_tools(r) for r in raw[0]], *[[_normal(r) for r in rows] for rows in raw[1:]]] if canonical
              else [[None] * len(init)] * 3)
    shapes = (_TOOL, _RESOURCE, _PROMPT)
    return pa.StructArray.from_arrays(
        [*[pa.array([s[k] for s in servers], pa.string()) for k in range(3)],
         *[_arrow_rows(rows, names) for rows, names in zip(raw, shapes)],
         *[_arrow_rows(rows, names) for rows, names in zip(normal, shapes)]], PARTS_TYPE.names)


def _capture_parts(init: pa.Array, tools: pa.Array, resources: pa.Array, prompts: pa.Array) -> pa.Array:
    return _parts(init, tools, resources, prompts, "serverInfo", False)


def _canonical_capture_parts(init: pa.Array, tools: pa.Array, resources: pa.Array, prompts: pa.Array) -> pa.Array:
    return _parts(init, tools, resources, prompts, "serverInfo", True)


def _manifest_parts(manifest: pa.Array) -> pa.Array:
    return _parts(manifest, manifest, manifest, manifest, "server", False)


def _canonical_manifest_parts(manifest: pa.Array) -> pa.Array:
    return _parts(manifest, manifest, manifest, manifest, "server", True)


@F.pandas_udf(T.StringType())
def _nfc_batch(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


@F.pandas_udf(T.StringType())
def _canonical_batch(texts: pd.Series) -> pd.Series:
    return texts.map(canonical_text)


@F.pandas_udf(T.IntegerType())
def _depth_batch(texts: pd.Series) -> pd.Series:
    return texts.map(nesting)


@F.pandas_udf(T.StringType())
def _property_batch(texts: pd.Series) -> pd.Series:
    return texts.map(property_names)


# Declared non-deterministic so that a filter on failed captures stays above them, instead of
# running them once more below.
_capture = F.arrow_udf(_capture_parts, PARTS_TYPE).asNondeterministic()
_canonical_capture = F.arrow_udf(_canonical_capture_parts, PARTS_TYPE).asNondeterministic()
_manifest = F.arrow_udf(_manifest_parts, PARTS_TYPE).asNondeterministic()
_canonical_manifest = F.arrow_udf(_canonical_manifest_parts, PARTS_TYPE).asNondeterministic()


def nfc(text: Column) -> Column:
    """NFC form.  Text whose code points are all below U+0300 already is NFC."""
    needs = F.when((F.octet_length(text) > F.char_length(text)) & text.rlike(r"[^\x{0}-\x{2ff}]"), text)
    return F.coalesce(_nfc_batch(needs), text)


def canonical_json(text: Column) -> Column:
    """Canonical form of a JSON text; NULL when blank, unchanged when not JSON."""
    return _canonical_batch(text)


def schema_property_names(schema: Column, only_if: Column | None = None) -> Column:
    """Property names of an input schema; ``only_if`` skips rows that cannot matter."""
    text = schema if only_if is None else F.when(only_if, schema)
    return F.coalesce(_property_batch(text), F.lit(""))


def capture_parts(initialize: Column, tools: Column, resources: Column, prompts: Column, canonical: bool = True) -> Column:
    """Everything a capture says, as one struct (``PARTS_TYPE``), from one decode of each message.

    ``tools`` is NULL for a failed capture.  Without ``canonical`` the canonical lists are NULL and cost nothing.
    """
    return (_canonical_capture if canonical else _capture)(initialize, tools, resources, prompts)


def manifest_parts(manifest: Column, canonical: bool = True) -> Column:
    """The same struct from a recorded manifest document."""
    return (_canonical_manifest if canonical else _manifest)(manifest)


# Non-characters stand in for escape pairs while strings are matched.
_PAIR, _QUOTE = "\ufdd0", "\ufdd1"


def compact_json(text: Column) -> Column:
    """Drop the white space between JSON tokens and keep everything else.

    Escape pairs are set aside first, so a string is a plain ``"[^"]*"`` and the
    regex needs no backtracking.
    """
    marked = F.replace(F.replace(text, F.lit("\\\\"), F.lit(_PAIR)), F.lit('\\"'), F.lit(_QUOTE))
    packed = F.regexp_replace(marked, r'("[^"]*+")|[ \t\n\r]++', "$1")
    return F.replace(F.replace(packed, F.lit(_QUOTE), F.lit('\\"')), F.lit(_PAIR), F.lit("\\\\"))


def json_quote(text: Column) -> Column:
    """A JSON string literal: short escapes, other controls as lower-case ``\\u00xx``."""
    pairs = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"),
             ("\b", "\\b"), ("\f", "\\f"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")]
    rare = [(chr(c), f"\\u{c:04x}") for c in range(0x20) if chr(c) not in "\n\r\t\b\f"]

    def put(col: Column, table) -> Column:
        for old, new in table:
            col = F.replace(col, F.lit(old), F.lit(new))
        return col

    # {"v":"…"} without its wrapper is the literal, but for what Spark's JSON writes otherwise; that shows by plain searches.
    wrapped = F.to_json(F.struct(text.alias("v")))
    special = wrapped.contains("\\u00") | text.contains("\u2028") | text.contains("\u2029") | ~F.is_valid_utf8(text)
    full = F.concat(F.lit('"'), put(put(text, pairs), rare), F.lit('"'))
    return F.when(special, full).when(text.isNotNull(), F.substring(wrapped, F.lit(6), F.length(wrapped) - 6))


def json_depth(text: Column) -> Column:
    """Deepest nesting of objects and arrays; 0 for absent or invalid JSON."""
    return F.coalesce(_depth_batch(text), F.lit(0))
