"""Queries over discovery, package, advisory and rule documents, and target expressions."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import targets as T
from ..operators.injection import rule_findings
from ..session import shared_dir
from ..sources import discovery, packages
from ..sources import rules as rule_files
from . import bridge as B
from . import checks as K
from .registry import query

# --- discovery documents -----------------------------------------------------------

_SEED = ("""concat('{"name":"', p_name, '","repo_url":"https://r/', p_partkey, '"', CASE p_size % 2 WHEN 0 THEN """
         """',"registry":"official"' ELSE '' END, ',"targets":["npx:', p_brand, '","x"],"extra":1}')""")


@query("read_seed", """
  WITH p AS (SELECT *, unnest(CASE p_partkey % 3 WHEN 2 THEN [0, 1] ELSE [0] END) AS copy FROM part)
  SELECT p_partkey, p_name AS name, '' AS description, 'https://r/' || p_partkey AS repo_url,
    CASE p_size % 2 WHEN 0 THEN 'official' ELSE 'file' END AS registry, 'npx:' || p_brand || ' x' AS targets FROM p""")
def read_seed(spark, sf):
    """Bare arrays, wrapped arrays, and an empty bare shape beside them."""
    docs = B.table(spark, sf, "part").selectExpr(
        "p_partkey", f"CASE p_partkey % 3 WHEN 0 THEN concat(' [', {_SEED}, ']') "
        f"WHEN 1 THEN concat('{{\"servers\": [', {_SEED}, ']}}') "
        f"ELSE concat('{{\"servers\":[', {_SEED}, ',', {_SEED}, ']}}') END AS text")
    return discovery.parse_seed(docs)


@query("registry_pages", """
  SELECT p_partkey, p_name AS name, '' AS description, CASE p_size % 3 WHEN 0 THEN '' ELSE 'https://r/' || p_partkey END
    AS repo_url, 'official' AS registry,
    array_to_string(list_filter(['npx:' || p_brand || CASE p_size % 2 WHEN 0 THEN '@' || p_size ELSE '' END,
      CASE WHEN p_size % 5 <> 0 THEN 'uvx:py-' || p_partkey END, 'docker:ghcr.io/x:' || p_size,
      CASE WHEN p_size % 4 <> 0 THEN 'https://host/' || p_partkey END], lambda t: t IS NOT NULL), ' ') AS targets
  FROM part""")
def registry_pages(spark, sf):
    text = (
        """concat('{"servers":[{"server":{"name":"', p_name, '"', CASE p_size % 3 WHEN 0 THEN '' ELSE """
        """concat(',"repository":{"url":"https://r/', p_partkey, '"}') END, """
        """',"packages":[{"registryType":"npm","identifier":"', p_brand, '","version":"', """
        """CASE p_size % 2 WHEN 0 THEN string(p_size) ELSE '' END, '"},{"registryType":"mcpb","identifier":"zip"},"""
        """{"registryType":"pypi","identifier":"', CASE p_size % 5 WHEN 0 THEN '' ELSE concat('py-', p_partkey) END, """
        """'","version":"9"},{"registryType":"oci","identifier":"ghcr.io/x:', p_size, '"}],"""
        """"remotes":[{"type":"sse","url":"', CASE p_size % 4 WHEN 0 THEN '' ELSE concat('https://host/', p_partkey) END, """
        """'"}]},"_meta":{}}],"metadata":{"count":1}}')""")
    return discovery.parse_registry_pages(B.table(spark, sf, "part").selectExpr("p_partkey", f"{text} AS text"))


@query("client_config_servers", """
  SELECT p_partkey, name, raw, kind, package, url, env, headers, error FROM (
    SELECT p_partkey, 'one' AS name, CASE p_partkey % 4 WHEN 0 THEN 'npx -y @s/' || p_brand || ' --flag'
        WHEN 1 THEN 'uvx tool-' || p_size WHEN 2 THEN '/usr/bin/npx x' ELSE NULL END AS raw,
      CASE p_partkey % 4 WHEN 0 THEN 'npx' WHEN 1 THEN 'uvx' WHEN 2 THEN 'local' END AS kind,
      CASE p_partkey % 4 WHEN 0 THEN '@s/' || p_brand WHEN 1 THEN 'tool-' || p_size ELSE '' END AS package,
      '' AS url, CASE WHEN p_partkey % 4 = 0 THEN 'KEY=[redacted]' ELSE NULL END AS env, NULL AS headers,
      CASE p_partkey % 4 WHEN 3 THEN 'entry has neither "command" nor "url"' END AS error FROM part
    UNION ALL SELECT p_partkey, 'two', 'https://h/' || p_size, 'remote', '', 'https://h/' || p_size, NULL,
      '{"Authorization":"[redacted]"}', NULL FROM part)""")
def client_config_servers(spark, sf):
    one = (
        """CASE p_partkey % 4 WHEN 0 THEN concat('{"command":"npx","args":["-y","@s/', p_brand, """
        """'","--flag"],"env":{"KEY":"se=cret"}}') WHEN 1 THEN concat('{"command":"uvx","args":["tool-', p_size, '"]}') """
        """WHEN 2 THEN '{"command":"/usr/bin/npx","args":["x"]}' ELSE '{"args":["x"]}' END""")
    text = (f"""concat('{{"', CASE p_size % 2 WHEN 0 THEN 'mcpServers' ELSE 'servers' END, '":{{"one":', {one}, """
            """',"two":{"url":"https://h/', p_size, '","headers":{"Authorization":"token"}}}}')""")
    rows = discovery.parse_client_config(B.table(spark, sf, "part").selectExpr("p_partkey", f"{text} AS text"))
    return rows.withColumn("env", T.redact_env(F.col("env"))).withColumn(
        "headers", T.redact_headers(F.col("headers"))).drop("command")


# --- targets ------------------------------------------------------------------------

_RESOLVED = """
  WITH raw AS (SELECT p_partkey, unnest(CASE p_partkey % 6
      WHEN 0 THEN [' npx:@s/' || p_partkey || '@1.0 '] WHEN 1 THEN ['ftp://x', 'uvx:' || p_brand]
      WHEN 2 THEN ['docker:ghcr.io/' || p_partkey || ':1', 'npx:later'] WHEN 3 THEN ['https://host/' || p_partkey]
      WHEN 4 THEN ['', 'local ' || p_name] ELSE ['npx:'] END) AS given,
    generate_subscripts(CASE p_partkey % 6 WHEN 1 THEN [1, 2] WHEN 2 THEN [1, 2] WHEN 4 THEN [1, 2] ELSE [1] END, 1) AS place
    FROM part),
  trimmed AS (SELECT *, trim(given) AS raw FROM raw),
  resolved AS (SELECT *, CASE WHEN raw LIKE 'http://%' OR raw LIKE 'https://%' THEN 'remote' WHEN raw LIKE 'npx:%' THEN 'npx'
      WHEN raw LIKE 'uvx:%' THEN 'uvx' WHEN raw LIKE 'docker:%' THEN 'docker' END AS kind FROM trimmed),
  targets AS (SELECT *, CASE WHEN kind IS NULL THEN NULL WHEN kind = 'remote' THEN '' ELSE raw[length(kind) + 2:] END AS package,
    CASE WHEN kind IS NULL THEN NULL WHEN kind = 'remote' THEN raw ELSE '' END AS url FROM resolved),
  firsts AS (SELECT * FROM targets WHERE kind IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY place) = 1),
  items AS (SELECT p.p_partkey, p_name, kind, package, url, raw FROM part p LEFT JOIN firsts f ON f.p_partkey = p.p_partkey)"""


def _given(spark, sf):
    return B.discovered(spark, sf).select("p_partkey", F.explode("targets").alias("given"))


def _items(spark, sf):
    return discovery.work_items(B.discovered(spark, sf))


@query("resolve_target", _RESOLVED + """ SELECT p_partkey, given, kind, package, url,
  CASE kind WHEN 'npx' THEN 'npx -y ' || package WHEN 'uvx' THEN 'uvx ' || package
    WHEN 'docker' THEN 'docker run --rm -i ' || package WHEN 'remote' THEN '' END AS command FROM targets""")
def resolve_target(spark, sf):
    t = T.resolve_target(F.col("given"))
    return _given(spark, sf).select("p_partkey", "given", t["kind"].alias("kind"), t["package"].alias("package"),
                                    t["url"].alias("url"), t["command"].alias("command"))


@query("primary_target", _RESOLVED + """ SELECT p_partkey, kind, raw,
  CASE WHEN kind IS NULL THEN 'server "' || p_name || '" has no resolvable target' END AS error FROM items""")
def primary_target(spark, sf):
    return _items(spark, sf).select("p_partkey", F.col("target.kind").alias("kind"),
                                    F.col("target.raw").alias("raw"), "error")


@query("skipped_servers", _RESOLVED + " SELECT p_partkey, p_name AS name FROM items WHERE kind IS NULL")
def skipped_servers(spark, sf):
    return discovery.skipped(_items(spark, sf)).select("p_partkey", "name")


@query("package_arg", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'pkg' WHEN 1 THEN l_returnflag
  WHEN 2 THEN '' ELSE '' END AS package FROM lineitem""")
def package_arg(spark, sf):
    args = ("CASE l_linenumber % 4 WHEN 0 THEN array('-y', '--x', 'pkg', 'other') WHEN 1 THEN array(l_returnflag) "
            "WHEN 2 THEN array('-y') ELSE cast(array() AS array<string>) END AS args")
    rows = B.table(spark, sf, "lineitem").selectExpr("l_orderkey", "CAST(l_linenumber AS BIGINT) AS l_linenumber", args)
    return rows.select("l_orderkey", "l_linenumber", T.package_arg(F.col("args")).alias("package"))


query_sql = _RESOLVED + """ SELECT p_partkey, CASE kind WHEN 'npx' THEN 'npm' WHEN 'uvx' THEN 'pypi' WHEN 'docker' THEN 'oci'
    WHEN 'remote' THEN 'http' END AS source, CASE WHEN kind = 'remote' THEN url WHEN package = '' THEN raw
    ELSE package END AS identifier FROM items"""


@query("server_ref", query_sql)
def server_ref(spark, sf):
    return _items(spark, sf).select("p_partkey", "source", "identifier")


@query("ecosystem_of", _RESOLVED + """ SELECT p_partkey, CASE WHEN kind IS NULL THEN NULL WHEN kind = 'npx' THEN 'npm'
  WHEN kind = 'uvx' THEN 'PyPI' ELSE '' END AS ecosystem FROM items""")
def ecosystem_of(spark, sf):
    return _items(spark, sf).select("p_partkey", "ecosystem")


@query("redact_secrets", """SELECT o_orderkey, 'KEY=[redacted] EMPTY=[redacted] BARE=[redacted]' AS env,
  '{"Authorization":"[redacted]"}' AS headers FROM orders""")
def redact_secrets(spark, sf):
    rows = B.table(spark, sf, "orders").selectExpr(
        "o_orderkey", "array(concat('KEY=', o_orderpriority, '=x'), 'EMPTY=', 'BARE') AS env",
        "map('Authorization', o_orderpriority) AS headers")
    return rows.select("o_orderkey", T.redact_env(F.col("env")).alias("env"),
                       T.redact_headers(F.col("headers")).alias("headers"))


_SPEC_CASE = """CASE p_partkey % 6 WHEN 0 THEN '@s/' || p_brand || '@1.' || p_size WHEN 1 THEN '@s/' || p_brand
  WHEN 2 THEN p_brand || '@' || p_size WHEN 3 THEN p_brand WHEN 4 THEN 'a@b@' || p_size ELSE p_brand || '@' END"""


@query("split_spec", f"""WITH s AS (SELECT p_partkey, {_SPEC_CASE} AS spec FROM part),
  a AS (SELECT *, length(spec) - strpos(reverse(spec), '@') AS cut FROM s)
  SELECT p_partkey, CASE WHEN strpos(spec, '@') = 0 OR cut <= 0 THEN spec ELSE spec[:cut] END AS name,
    CASE WHEN strpos(spec, '@') = 0 OR cut <= 0 THEN '' ELSE spec[cut + 2:] END AS version FROM a""")
def split_spec(spark, sf):
    spec = F.col("spec")
    return B.table(spark, sf, "part").selectExpr("p_partkey", f"{_SPEC_CASE} AS spec").select(
        "p_partkey", T.spec_name(spec).alias("name"), T.spec_version(spec).alias("version"))


@query("unscoped", """SELECT page_id, regexp_extract(url, '[^/]*$') AS tail FROM pages""")
def unscoped(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", T.unscoped(F.col("url")).alias("tail"))


# --- package and advisory documents ---------------------------------------------------

@query("package_info_npm", """
  SELECT p_partkey, p_name AS name, CASE p_size % 2 WHEN 0 THEN '1.0' ELSE '' END AS requested_version,
    CASE p_size % 2 WHEN 0 THEN '1.0' ELSE '2.0' END AS version,
    CASE p_size % 2 WHEN 0 THEN p_size % 4 = 0 ELSE p_size % 3 = 0 END AS has_install_script,
    CAST(CASE p_size % 2 WHEN 0 THEN 2 ELSE 0 END AS BIGINT) AS dependency_count, CAST(p_size % 3 AS BIGINT) AS maintainer_count,
    CASE WHEN p_size % 2 = 0 THEN 'git+https://own/' || p_partkey WHEN p_size % 5 = 0 THEN 'https://plain' ELSE '' END AS repo_url,
    CASE WHEN p_size % 7 = 0 THEN NULL ELSE epoch_us(TIMESTAMP '2020-01-02 03:04:05.678') END AS created,
    epoch_us(TIMESTAMP '2020-01-02 01:04:05') AS modified FROM part""")
def package_info_npm(spark, sf):
    document = (
        """concat('{"dist-tags":{"latest":"2.0"},"versions":{"1.0":{"dependencies":{"a":"1","b":"*"},"hasInstallScript":', """
        """CASE WHEN p_size % 4 = 0 THEN 'true' ELSE 'false' END, ',"scripts":{"test":"x"},"repository":{"type":"git",""" 
        """"url":"git+https://own/', p_partkey, '"}},"2.0":{"scripts":{', CASE WHEN p_size % 3 = 0 THEN '"postinstall":"x"' """
        """ELSE '"build":"x"' END, '}}},"maintainers":[', CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN '{"name":"a"}' """
        """ELSE '{"name":"a"},"b"' END, '],"time":{"created":"', CASE WHEN p_size % 7 = 0 THEN 'soon' ELSE """
        """'2020-01-02T03:04:05.678Z' END, '","modified":"2020-01-02T03:04:05+02:00"}', """
        """CASE WHEN p_size % 5 = 0 THEN ',"repository":"https://plain"' ELSE '' END, '}')""")
    docs = B.table(spark, sf, "part").selectExpr(
        "p_partkey", "p_name AS name", "CASE p_size % 2 WHEN 0 THEN '1.0' ELSE '' END AS requested_version",
        f"{document} AS document")
    info = packages.package_info_npm(docs.withColumn("name", F.concat_ws("|", "p_partkey", "name")))
    return info.select(F.split_part("name", F.lit("|"), F.lit(1)).cast("bigint").alias("p_partkey"),
                       F.split_part("name", F.lit("|"), F.lit(2)).alias("name"), "requested_version", "version",
                       "has_install_script", "dependency_count", "maintainer_count", "repo_url", "created", "modified")


@query("package_info_pypi", """
  SELECT CAST(p_partkey AS VARCHAR) AS name, CASE p_size % 2 WHEN 0 THEN '1.0' ELSE '2.0' END AS version,
    CAST(CASE p_size % 2 WHEN 0 THEN 0 ELSE 2 END AS BIGINT) AS dependency_count,
    CASE p_size % 4 WHEN 0 THEN 'https://source' WHEN 1 THEN 'https://homepage' WHEN 2 THEN 'https://home' ELSE '' END AS repo_url,
    CASE WHEN p_size % 5 = 0 THEN NULL ELSE epoch_us(TIMESTAMP '2019-05-01 10:00:00') END AS created FROM part""")
def package_info_pypi(spark, sf):
    document = (
        """concat('{"info":{"version":"2.0"', CASE p_size % 2 WHEN 0 THEN ',"requires_dist":null' ELSE """
        """',"requires_dist":["a","b>1"]' END, CASE p_size % 4 WHEN 0 THEN """
        """',"project_urls":{"Homepage":"https://homepage","Source":"https://source"},"home_page":"https://home"' """
        """WHEN 1 THEN ',"project_urls":{"Source":"","Homepage":"https://homepage"}' """
        """WHEN 2 THEN ',"home_page":"https://home"' ELSE '' END, '},"releases":{', CASE WHEN p_size % 5 = 0 THEN '"1.0":[]' """
        """ELSE '"2.0":[{"upload_time_iso_8601":"2021-01-01T00:00:00Z"},{"upload_time_iso_8601":"bad"}],"""
        """"1.0":[{"upload_time_iso_8601":"2019-05-01T10:00:00.000000Z"}]' END, '}}')""")
    docs = B.table(spark, sf, "part").selectExpr(
        "CAST(p_partkey AS STRING) AS name", "CASE p_size % 2 WHEN 0 THEN '1.0' ELSE '' END AS requested_version",
        f"{document} AS document")
    return packages.package_info_pypi(docs).select("name", "version", "dependency_count", "repo_url", "created")


@query("advisories", """
  SELECT 'ADV-' || l_orderkey || '-' || l_linenumber AS id, 'Flaw ' || l_linestatus AS summary,
    CASE l_linenumber % 3 WHEN 0 THEN 'HIGH' ELSE '' END AS severity, CASE l_suppkey % 2 WHEN 0 THEN 'npm' ELSE 'PyPI' END AS ecosystem,
    'p' || l_partkey AS name, unnest(['1.' || l_linenumber, '2.0']) AS version FROM lineitem""")
def advisories(spark, sf):
    text = (
        """concat('{"id":"ADV-', l_orderkey, '-', l_linenumber, '","summary":"Flaw ', l_linestatus, """
        """'","database_specific":{"severity":', CASE l_linenumber % 3 WHEN 0 THEN '"HIGH"' WHEN 1 THEN '7.5' ELSE 'null' END, """
        """'},"affected":[{"package":{"name":"p', l_partkey, '","ecosystem":"', CASE l_suppkey % 2 WHEN 0 THEN 'npm' ELSE """
        """'PyPI' END, '"},"versions":["1.', l_linenumber, '","2.0"],"ranges":[]}]}')""")
    return packages.advisories(B.table(spark, sf, "lineitem").selectExpr(f"{text} AS text"))


@query("read_rules", f"""WITH tools AS ({K.TOOLS}) """ + " UNION ALL ".join(
    f"SELECT '{r['id']}' AS rule_id, '{r['severity']}' AS severity, count(*) AS hits FROM tools WHERE "
    + K.rule_match(r, "name || chr(10) || description") for r in C.INJECTION_RULES))
def read_rules(spark, sf):
    """Write the default rules as a rule file, read it back, run it over all documents."""
    path = shared_dir(spark, "rules")
    document = json.dumps({"version": 1, "rules": [{**r, "any": list(r["any"])} for r in C.INJECTION_RULES]})
    spark.createDataFrame([(document,)], "value string").coalesce(1).write.text(path)
    rules = rule_files.read_rules(spark, path).rules
    return rule_findings(B.tools(spark, sf), rules).groupBy("rule_id", "severity").agg(F.count("*").alias("hits"))
