"""Servers to scan: seed lists, saved registry pages, client configurations.

Readers take paths; the parsing behind each takes a text column, so the same job
runs over files, table columns or a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import targets as T
from ..functions.rows import unnest

DISCOVERED = "name string, description string, repo_url string, registry string, targets array<string>"
_SEED = f"array<struct<{DISCOVERED.replace(' string', ':string').replace(' array', ':array')}>>"
_PAGE = (
    "struct<servers:array<struct<server:struct<name:string,description:string,version:string,"
    "repository:struct<url:string>,"
    "packages:array<struct<registryType:string,identifier:string,version:string>>,"
    "remotes:array<struct<type:string,url:string>>>>>,metadata:struct<nextCursor:string>>"
)
_ENTRY = ("struct<command:string,args:array<string>,env:map<string,string>,url:string,type:string,"
          "headers:map<string,string>>")
_CONFIG = f"struct<mcpServers:map<string,{_ENTRY}>,servers:map<string,{_ENTRY}>>"


def _text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (file, text)."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def parse_seed(documents: DataFrame, text: str = "text") -> DataFrame:
    """Servers of seed documents: a bare array, or an object with a ``servers`` array.

    An empty bare array falls through to the wrapped shape.
    """
    raw = F.col(text)
    bare = F.when(F.ltrim(raw).startswith("["), F.from_json(raw, _SEED))
    wrapped = F.from_json(raw, f"struct<servers:{_SEED}>")["servers"]
    rows = F.when(F.size(F.coalesce(bare, F.array().cast(_SEED))) > 0, bare).otherwise(wrapped)
    server = F.col("s")
    others = [c for c in documents.columns if c != text]
    return unnest(documents, others, rows, "s").select(
        *others, _text(server["name"]).alias("name"), _text(server["description"]).alias("description"),
        _text(server["repo_url"]).alias("repo_url"),
        F.coalesce(F.nullif(server["registry"], F.lit("")), F.lit("file")).alias("registry"),
        F.coalesce(server["targets"], F.array().cast("array<string>")).alias("targets"))


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    return parse_seed(whole_files(spark, path)).drop("file")


def parse_registry_pages(documents: DataFrame, text: str = "text") -> DataFrame:
    """One row per listed server with its scannable targets, in listing order.

    Packages come first, then remotes.  A PyPI version is not part of the target.
    """
    server = F.col("s.server")
    # Absent or blank parts read as empty, in packages and remotes alike.
    packages = F.filter(F.coalesce(server["packages"], F.array()), lambda p: _text(p["identifier"]) != "")
    version = lambda p: F.when(_text(p["version"]) != "", F.concat(F.lit("@"), p["version"])).otherwise("")
    as_target = lambda p: (
        F.when(p["registryType"] == "npm", F.concat(F.lit("npx:"), p["identifier"], version(p)))
        .when(p["registryType"] == "pypi", F.concat(F.lit("uvx:"), p["identifier"]))
        .when(p["registryType"] == "oci", F.concat(F.lit("docker:"), p["identifier"])))
    urls = F.transform(F.coalesce(server["remotes"], F.array()), lambda r: F.nullif(r["url"], F.lit("")))
    targets = F.array_compact(F.concat(F.transform(packages, as_target), urls))
    others = [c for c in documents.columns if c != text]
    pages = unnest(documents, others, F.from_json(F.col(text), _PAGE)["servers"], "s")
    return pages.select(*others, _text(server["name"]).alias("name"),
                        _text(server["description"]).alias("description"),
                        _text(server["repository"]["url"]).alias("repo_url"),
                        F.lit("official").alias("registry"), targets.alias("targets"))


def read_registry_pages(spark: SparkSession, path: str) -> DataFrame:
    return parse_registry_pages(whole_files(spark, path)).drop("file")


def parse_client_config(documents: DataFrame, text: str = "text") -> DataFrame:
    """One target row per server a client configuration names.

    ``mcpServers`` is used unless it is empty, then ``servers``.  An entry with a URL is
    remote; npx and uvx are recognised by their exact command name.  ``error`` is set for
    an entry with neither command nor URL, and for a document without servers.
    """
    config = F.from_json(F.col(text), _CONFIG)
    filled = lambda m: F.when(F.size(m) > 0, m)
    entries = F.coalesce(filled(config["mcpServers"]), filled(config["servers"]))
    others = [c for c in documents.columns if c != text]
    rows = documents.select(*others, F.explode_outer(entries).alias("name", "e"))
    e = F.col("e")
    args = F.coalesce(e["args"], F.array().cast("array<string>"))
    argv = F.concat(F.array(e["command"]), args)
    remote = _text(e["url"]) != ""
    launcher = e["command"].isin("npx", "uvx")
    local = ~remote & (_text(e["command"]) != "")
    pairs = F.transform(F.map_entries(e["env"]), lambda kv: F.concat(kv["key"], F.lit("="), kv["value"]))
    return rows.select(
        *others,
        F.when(remote, e["url"]).when(local, F.array_join(argv, " ")).alias("raw"), "name",
        F.when(remote, F.lit("remote")).when(local & launcher, e["command"])
        .when(local, F.lit("local")).alias("kind"),
        F.when(local, argv).otherwise(F.array().cast("array<string>")).alias("command"),
        F.when(local & (F.size(pairs) > 0), pairs).alias("env"),
        F.when(remote, e["url"]).otherwise(F.lit("")).alias("url"),
        F.when(remote, e["headers"]).alias("headers"),
        F.when(local & launcher, T.package_arg(args)).otherwise(F.lit("")).alias("package"),
        F.when(F.col("name").isNull(), F.lit("no servers found"))
        .when(~remote & ~local, F.lit('entry has neither "command" nor "url"')).alias("error"))


def client_config_servers(spark: SparkSession, path: str) -> DataFrame:
    return parse_client_config(whole_files(spark, path))


def work_items(discovered: DataFrame) -> DataFrame:
    """Discovered servers with their primary target and persistent identity.

    Servers without any resolvable target stay as rows with ``error`` set, so that
    one bad server never stops a run; see ``skipped``.
    """
    target = F.col("target")
    return (discovered.withColumn("target", T.primary_target(F.col("targets")))
            .withColumn("source", F.when(target.isNotNull(), T.source_of(target["kind"])))
            .withColumn("identifier", T.identifier_of(target))
            .withColumn("ecosystem", F.when(target.isNotNull(), T.ecosystem_of(target["kind"])))
            .withColumn("error", F.when(target.isNull(), F.concat(
                F.lit('server "'), F.col("name"), F.lit('" has no resolvable target')))))


def skipped(items: DataFrame) -> DataFrame:
    return items.where(F.col("error").isNotNull())
