"""Documents and files as tables."""

import json

import pytest
from pyspark.sql import functions as F

from toolwarden import constants as C
from toolwarden.functions import targets as T
from toolwarden.sources import baselines, discovery, packages, rules, traces

PAGES = [
    {"servers": [
        {"server": {"name": "garden.tools/weeder", "version": "7.2", "repository": {"url": "https://code.test/weeder"},
                    "packages": [{"registryType": "npm", "identifier": "@garden/weeder", "version": "7.2.0"},
                                 {"registryType": "npm", "identifier": "", "version": "1"},
                                 {"registryType": "nuget", "identifier": "Weeder"}]}},
        {"server": {"name": "garden.tools/nothing", "version": "1", "packages": None, "remotes": None}}],
     "metadata": {"nextCursor": "p2"}},
    {"servers": [
        {"server": {"name": "sea.charts/tides", "version": "0.0.9",
                    "remotes": [{"type": "sse", "url": "https://tides.test/sse"}, {"type": "streamable-http"}],
                    "packages": [{"registryType": "pypi", "identifier": "tidal", "version": "4"}]}}]},
    {"servers": None},
]


def test_registry_pages(spark, tmp_path):
    for i, page in enumerate(PAGES):
        (tmp_path / f"p{i}.json").write_text(json.dumps(page))
    rows = {r.name: r for r in discovery.read_registry_pages(spark, str(tmp_path)).collect()}
    weeder = rows["garden.tools/weeder"]
    assert weeder.targets == ["npx:@garden/weeder@7.2.0"] and weeder.repo_url == "https://code.test/weeder"
    assert sorted(rows["sea.charts/tides"].targets) == ["https://tides.test/sse", "uvx:tidal"]
    assert not rows.get("garden.tools/nothing") or not rows["garden.tools/nothing"].targets
    assert {r.registry for r in rows.values()} == {"official"}


@pytest.mark.parametrize("text,names", [
    ('[{"name":"a","targets":["npx:x"]}]', ["a"]),
    ('{"servers":[\n {"name":"a","registry":"r","targets":[]},\n {"name":"b"}]}', ["a", "b"]),
    ("[]", []),
])
def test_seed(spark, tmp_path, text, names):
    (tmp_path / "seed.json").write_text(text)
    rows = discovery.read_seed(spark, str(tmp_path)).orderBy("name").collect()
    assert [r.name for r in rows] == names
    assert all(r.registry in ("file", "r") for r in rows)


def test_client_config(spark, tmp_path):
    config = {"mcpServers": {
        "db": {"command": "npx", "args": ["-y", "@s/db@1"], "env": {"TOKEN": "a=b"}},
        "local": {"command": "/opt/npx", "args": ["x"]}, "web": {"url": "https://x", "headers": {"Authorization": "t"}},
        "bad": {"args": ["x"]}}}
    (tmp_path / "a.json").write_text(json.dumps(config))
    (tmp_path / "b.json").write_text("{}")
    rows = {r.name: r for r in discovery.client_config_servers(spark, str(tmp_path)).withColumn(
        "env", T.redact_env(F.col("env"))).withColumn("headers", T.redact_headers(F.col("headers"))).collect()}
    assert (rows["db"].kind, rows["db"].package, rows["db"].env) == ("npx", "@s/db@1", ["TOKEN=[redacted]"])
    assert (rows["local"].kind, rows["local"].package) == ("local", "")
    assert rows["web"].headers == {"Authorization": "[redacted]"} and rows["web"].kind == "remote"
    assert rows["bad"].error and rows[None].error == "no servers found"


def test_npm_and_pypi(spark):
    npm = {"dist-tags": {"latest": "2"}, "versions": {
        "1": {"dependencies": {"a": "1"}, "scripts": {"preinstall": "x"}, "repository": "https://r"},
        "2": {"hasInstallScript": False}}, "maintainers": [{"name": "m"}], "time": {"created": "2020-01-01T00:00:00Z"},
        "repository": {"type": "git", "url": "git://top"}}
    docs = spark.createDataFrame([("p", "1", json.dumps(npm)), ("p", "", json.dumps(npm)), ("q", "", None)],
                                 "name string, requested_version string, document string")
    rows = {(r.name, r.requested_version): r for r in packages.package_info_npm(docs).collect()}
    one, latest = rows["p", "1"], rows["p", ""]
    assert (one.version, one.has_install_script, one.dependency_count, one.repo_url) == ("1", True, 1, "https://r")
    assert (latest.version, latest.has_install_script, latest.dependency_count, latest.repo_url) == ("2", False, 0, "git://top")
    assert latest.maintainer_count == 1 and latest.created.year == 2020 and latest.modified is None
    assert not rows["q", ""].found


def test_advisory_severity_must_be_text(spark):
    docs = [json.dumps({"id": i, "summary": "s", "database_specific": d,
                        "affected": [{"package": {"name": "p", "ecosystem": "npm"}, "versions": ["1"]}]})
            for i, d in (("a", {"severity": "HIGH"}), ("b", {"severity": 7}), ("c", {}))]
    rows = packages.advisories(spark.createDataFrame([(d,) for d in docs], "text string")).collect()
    assert {r.id: r.severity for r in rows} == {"a": "HIGH", "b": "", "c": ""}


def test_trace(spark, tmp_path):
    (tmp_path / "7.log").write_text(
        'connect(3, {sa_family=AF_INET, sin_port=htons(443), sin_addr=inet_addr("203.0.113.7")}, 16) = -1\n'
        'connect(3, {sa_family=AF_INET, sin_port=htons(443), sin_addr=inet_addr("203.0.113.7")}, 16) = -1\n'
        'connect(3, {sa_family=AF_INET, sin_port=htons(53), sin_addr=inet_addr("8.8.8.8")}, 16) = 0\n'
        'connect(3, {sa_family=AF_INET, sin_port=htons(9), sin_addr=inet_addr("127.0.0.1")}, 16) = 0\n'
        'openat(AT_FDCWD, "/home/u/.ssh/id_rsa", O_RDONLY) = 3\nstat("/home/u/.env") = 0\n')
    runs = spark.createDataFrame([(7, True), (8, True)], "scan_id bigint, net_denied boolean")
    rows = {r.scan_id: r for r in traces.trace_behavior(traces.read_trace_logs(spark, str(tmp_path)), runs).collect()}
    assert rows[7].egress_hosts == ["203.0.113.7:443"] and rows[7].dns_resolve == ["8.8.8.8:53"]
    assert rows[7].decoy_reads == [".ssh/id_rsa"] and rows[8].egress_hosts == []


def test_rule_files(spark, tmp_path):
    document = {"version": 4, "rules": [{**r, "any": list(r["any"])} for r in C.INJECTION_RULES]}
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(document))
    read = rules.read_rules(spark, str(path))
    assert read.version == 4 and [r["id"] for r in read.rules] == [r["id"] for r in C.INJECTION_RULES]


def test_absent_baselines_are_empty(spark, tmp_path):
    assert baselines.read_baselines(spark, str(tmp_path / "none")).count() == 0
