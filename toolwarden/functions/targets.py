"""Targets, package specs and server identities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TARGET_FIELDS = ("raw", "name", "kind", "command", "url", "package")
_LAUNCHERS = (
    ("npx", ("npx", "-y")),
    ("uvx", ("uvx",)),
    ("docker", ("docker", "run", "--rm", "-i")),
)
_SOURCES = (("npx", "npm"), ("uvx", "pypi"), ("docker", "oci"))


def _target(raw, name, kind, command, url, package) -> Column:
    empty = F.lit("")
    return F.struct(
        raw.alias("raw"), name.alias("name"), F.lit(kind).alias("kind"), command.alias("command"),
        (empty if url is None else url).alias("url"),
        (empty if package is None else package).alias("package"),
    )


def trim_space(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"^\p{IsWhite_Space}++|\p{IsWhite_Space}++\z", "")


def resolve_target(text: Column) -> Column:
    """Struct of ``TARGET_FIELDS``; NULL when the text names no known kind of target."""
    raw = trim_space(text)
    remote = F.startswith(raw, F.lit("https://")) | F.startswith(raw, F.lit("http://"))
    out = F.when(remote, _target(raw, raw, "remote", F.array().cast("array<string>"), raw, None))
    for prefix, launcher in _LAUNCHERS:
        package = F.substring(raw, F.lit(len(prefix) + 2), F.length(raw))
        command = F.array(*[F.lit(word) for word in launcher], package)
        out = out.when(F.startswith(raw, F.lit(prefix + ":")),
                       _target(raw, package, prefix, command, None, package))
    return out


def primary_target(targets: Column) -> Column:
    """First resolvable target of an array of target texts; NULL if there is none."""
    resolved = F.filter(F.transform(targets, resolve_target), lambda t: t.isNotNull())
    return F.try_element_at(resolved, F.lit(1))


def package_arg(args: Column) -> Column:
    """First launcher argument that is not a flag, or the empty string."""
    plain = F.filter(args, lambda a: ~F.startswith(a, F.lit("-")))
    return F.coalesce(F.try_element_at(plain, F.lit(1)), F.lit(""))


def source_of(kind: Column) -> Column:
    """Where a server of this kind is published."""
    col = F.when(kind == "remote", F.lit("http"))
    for name, source in _SOURCES:
        col = col.when(kind == name, F.lit(source))
    return col.otherwise(F.lit("local"))


def identifier_of(target: Column) -> Column:
    """Package, URL or name of a server, falling back to the raw target."""
    kind = target["kind"]
    named = (F.when(kind == "remote", target["url"])
             .when(kind.isin(*[k for k, _ in _SOURCES]), target["package"])
             .otherwise(target["name"]))
    return F.when(kind == "remote", named).otherwise(F.coalesce(F.nullif(named, F.lit("")), target["raw"]))


def ecosystem_of(kind: Column) -> Column:
    """Package ecosystem whose metadata applies; empty for everything but npx and uvx."""
    return F.when(kind == "npx", F.lit("npm")).when(kind == "uvx", F.lit("PyPI")).otherwise(F.lit(""))


def redact_env(env: Column) -> Column:
    """Keep variable names, hide their values."""
    return F.transform(env, lambda e: F.concat(F.split_part(e, F.lit("="), F.lit(1)), F.lit("=[redacted]")))


def redact_headers(headers: Column) -> Column:
    """Keep header names, hide their values."""
    return F.transform_values(headers, lambda _k, _v: F.lit("[redacted]"))


_SPEC = r"(?s)^(.+)@([^@]*)\z"


def spec_name(spec: Column) -> Column:
    return F.when(spec.rlike(_SPEC), F.regexp_extract(spec, _SPEC, 1)).otherwise(spec)


def spec_version(spec: Column) -> Column:
    return F.regexp_extract(spec, _SPEC, 2)


def unscoped(name: Column) -> Column:
    """Text after the last slash."""
    return F.substring_index(name, "/", -1)
