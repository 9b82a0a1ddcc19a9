"""Risk of the published package behind a server."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import targets as T
from ..functions.detect import quoted
from .findings import explode_findings, finding

_SQUAT_SEQ, _FETCH_SEQ, _CVE_SEQ = 0, 1, 10
#: Lists over which the scans of one package version are dealt.
CELLS = 64


def _as_bytes(text: Column) -> Column:
    """One character per UTF-8 byte, so edit distance counts bytes."""
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")).otherwise(text)


def nearest_squat(name: Column, popular=C.POPULAR_PACKAGES) -> Column:
    """The popular package a name imitates: struct(target, same_name, distance), or NULL.

    A popular name is never a squat.  The same unscoped name under another scope
    counts first; then the nearest name at most two edits away, the earlier list
    entry on ties.  The list is a literal of fixed size, so this is one expression
    and needs no join; ``typosquat_registry`` handles lists that grow.
    """
    if not popular:
        return F.lit(None).cast("struct<target:string,same_name:boolean,distance:int>")
    shorts = F.array(*[F.lit(target.rsplit("/", 1)[-1].encode().decode("latin-1")) for target in popular])
    n, far = len(popular), C.MAX_SQUAT_DISTANCE + 1
    # Distance and place in one number, each worked out once; beyond the limit the distance is -1, here ``far``.
    ranked = lambda tail: F.array_min(F.transform(
        shorts, lambda short, i: F.pmod(F.levenshtein(tail, short, C.MAX_SQUAT_DISTANCE), F.lit(far + 1)) * n + i))
    best = F.filter(F.transform(F.array(_as_bytes(T.unscoped(name))), ranked), lambda b: b < far * n)
    listed = F.array(*[F.lit(target) for target in popular])
    found = F.transform(best, lambda b: F.struct(
        F.element_at(listed, b % n + 1).alias("target"), (b < n).alias("same_name"),
        F.floor(b / n).cast("int").alias("distance")))
    return F.when(~name.isin(*popular), F.get(found, F.lit(0)))


def in_scope(specs: DataFrame) -> DataFrame:
    """Scans with a package spec and network checks allowed; name and version split off."""
    spec = F.col("package_spec")
    return (specs.where((F.coalesce(spec, F.lit("")) != "") & ~F.coalesce(F.col("offline"), F.lit(False)))
            .withColumn("name", T.spec_name(spec)).withColumn("version", T.spec_version(spec)))


def _squat_finding(scoped: DataFrame) -> DataFrame:
    squat, name = F.col("squat"), quoted(F.col("name"))
    target = quoted(squat["target"])
    meta = F.to_json(F.struct(squat["target"].alias("suspected_target")))
    names, advice = (name, target), (target, name)
    rule = F.lit("supplychain.typosquat")
    # No filter on the squat: it would be pushed below the projection that finds it, and find it again.
    return explode_findings(
        scoped,
        F.when(~squat["same_name"], finding("supplychain.typosquat", F.lit(_SQUAT_SEQ), detail=names,
                                            remediation=advice, meta=meta)),
        F.when(squat["same_name"], finding("supplychain.same_name", F.lit(_SQUAT_SEQ), rule_id=rule,
                                           detail=names, remediation=advice, meta=meta)))


def typosquat(specs: DataFrame, popular=C.POPULAR_PACKAGES) -> DataFrame:
    """Findings for names that imitate a popular package."""
    return _squat_finding(in_scope(specs).withColumn("squat", nearest_squat(F.col("name"), popular)))


def with_package(specs: DataFrame, packages: DataFrame) -> DataFrame:
    """In-scope scans with their package metadata in ``pkg``; NULL when it was not found.

    ``packages`` has one row per (ecosystem, name, requested_version).
    """
    meta = [c for c in packages.columns if c not in ("ecosystem", "name", "requested_version")]
    info = packages.select(
        F.col("ecosystem").alias("_eco"), F.col("name").alias("_name"),
        F.col("requested_version").alias("_req"),
        F.struct(*meta, F.col("ecosystem")).alias("pkg"))
    scoped = in_scope(specs)
    return scoped.join(
        info,
        (scoped["ecosystem"] == info["_eco"]) & (scoped["name"] == info["_name"])
        & (scoped["version"] == info["_req"]), "left").drop("_eco", "_name", "_req")


def package_findings(joined: DataFrame, as_of: Column) -> DataFrame:
    """Checks of one package's own metadata, in one pass over ``with_package`` rows."""
    pkg = F.col("pkg")
    missing = pkg.isNull() | ~F.coalesce(pkg["found"], F.lit(False))
    reason = F.when(F.col("ecosystem").isin("npm", "PyPI", "pypi"), F.lit("package not found")).otherwise(
        F.concat(F.lit("unsupported ecosystem "), quoted(F.col("ecosystem"))))
    young = pkg["created"] > as_of.cast("timestamp") - F.expr(f"INTERVAL {C.YOUNG_DAYS} DAYS")
    days = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(pkg["created"])) / 86_400_000_000)

    def check(condition: Column, rule: str, seq: int, **texts) -> Column:
        return F.when(~missing & condition, finding(rule, F.lit(seq), **texts))

    return explode_findings(
        joined,
        F.when(missing, finding("supplychain.metadata_unavailable", F.lit(_FETCH_SEQ), detail=(reason,))),
        check(pkg["has_install_script"], "supplychain.install_script", _FETCH_SEQ + 1),
        check(F.coalesce(pkg["repo_url"], F.lit("")) == "", "supplychain.no_source", _FETCH_SEQ + 2),
        check((pkg["ecosystem"] == "npm") & (pkg["maintainer_count"] == 1),
              "supplychain.single_maintainer", _FETCH_SEQ + 3),
        check(young, "supplychain.young_package", _FETCH_SEQ + 4, detail=(days,)))


def _number(text: Column) -> Column:
    return F.coalesce(F.try_to_number(text, F.lit("99999999999999999")).cast("bigint"), F.lit(0))


def version_key(ecosystem: Column, version: Column) -> Column:
    """A sortable key of a version: release numbers, then what stands before or after the release.

    Numbers compare as numbers and missing ones as zero.  A pre-release sorts below its release:
    for npm its identifiers in order, numeric ones first; for PyPI ``dev``, ``a``, ``b`` and ``rc``,
    with post-releases above.  Build and local parts do not count.  NULL for text without a number.
    """
    text = F.lower(F.regexp_replace(F.trim(version), r"^[v=\s]+", ""))
    text = F.regexp_replace(text, r"\+.*$", "")
    epoch = F.when(text.rlike(r"^\d+!"), _number(F.regexp_extract(text, r"^(\d+)!", 1))).otherwise(F.lit(0).cast("bigint"))
    text = F.regexp_replace(text, r"^\d+!", "")
    release = F.regexp_extract(text, r"^\d+(?:\.\d+)*", 0)
    # Trailing zeros say nothing: 1.0 is 1.
    numbers = F.transform(F.split(F.regexp_replace(release, r"(?:\.0+)+$", ""), r"\."), _number)
    rest = F.substring(text, F.length(release) + 1, F.length(text))
    python = F.lower(ecosystem) == "pypi"
    word = F.regexp_extract(rest, r"^[._-]?([a-z]+)", 1)
    post = word.isin("post", "rev", "r")
    dev = rest.rlike(r"(^|[._-])dev")
    phase = (F.when(word == "dev", 0).when(word.isin("a", "alpha"), 1).when(word.isin("b", "beta"), 2)
             .when(word.isin("rc", "c", "pre", "preview"), 3).when(post | rest.rlike(r"^-\d+$"), 5).otherwise(4))
    count = _number(F.regexp_extract(rest, r"(\d+)", 1))
    pep = F.concat(F.format_string("%d:%020d:%d", phase, count, F.when(dev, 0).otherwise(1)))
    parts = F.transform(F.split(F.substring(rest, F.lit(2), F.length(rest)), r"\."), lambda x: F.when(
        x.rlike(r"^\d+$"), F.concat(F.lit("0"), F.lpad(x, 20, "0"))).otherwise(F.concat(F.lit("1"), x)))
    semver = F.when(rest.startswith("-"), F.concat(F.lit("0:"), F.array_join(parts, "\x01"))).otherwise(F.lit("1:"))
    return F.when(release != "", F.struct(epoch.alias("epoch"), numbers.alias("release"),
                                          F.when(python, pep).otherwise(semver).alias("rest")))


def in_range(version: Column, introduced: Column, fixed: Column, last: Column) -> Column:
    """Whether a version key lies in one interval; an absent end leaves that side open."""
    return (version.isNotNull() & (introduced.isNull() | (version >= introduced))
            & (fixed.isNull() | (version < fixed)) & (last.isNull() | (version <= last)))


def known_cve(joined: DataFrame, advisories: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """One finding per scan and advisory id that names the package version or has a range around it.

    Advisories meet package versions with lists of their scans, CELLS at most for each, and fan out to
    the scans after, so a package that many servers share is matched a few times only.  What has met is
    not moved again: only the hits of ids that stand in several rows are shuffled, to be made one.
    They carry no tool, so all of a server's advisories subtract once.
    """
    found = joined.where(F.col("pkg.found")).select(
        "scan_id", F.col("pkg.ecosystem").alias("ecosystem"), "name", F.col("pkg.version").alias("version"))
    package = ["ecosystem", "name", "version"]
    advisory = ["ecosystem", "name", "id"]
    # An advisory that stands in one row meets a version once at most: only others need their hits made one.
    every = advisories.select(*advisory) if ranges is None else advisories.select(*advisory).unionByName(ranges.select(*advisory))
    often = every.groupBy(*advisory).agg((F.count("*") > 1).alias("often"))
    marked = lambda rows: rows.join(often, advisory, "left").withColumn("often", F.coalesce("often", F.lit(True)))
    key = lambda c: version_key(F.col("ecosystem"), F.col(c))

    def hits(versions: DataFrame, which: str) -> DataFrame:
        """What the versions have in common with some of the advisories; other columns are carried."""
        columns = [*versions.columns, "id", "summary", F.col("severity").alias("osv_severity")]
        out = versions.join(marked(advisories).where(which), package).select(*columns)
        if ranges is not None:
            # Keys are worked out once a list of scans and once an interval, not for each pair of them.
            keyed = versions.withColumn("_version", key("version")).where("_version IS NOT NULL")
            spans = marked(ranges).where(which).select(
                *advisory, "summary", "severity", F.when(F.col("introduced") != "0", key("introduced")).alias("_from"),
                key("fixed").alias("_fixed"), key("last_affected").alias("_last"))
            inside = in_range(F.col("_version"), F.col("_from"), F.col("_fixed"), F.col("_last"))
            out = out.unionByName(keyed.join(spans, ["ecosystem", "name"]).where(inside).select(*columns))
        return out.withColumn("mild", ~F.upper(F.coalesce(F.col("osv_severity"), F.lit(""))).isin("CRITICAL", "HIGH"))

    cell = F.pmod(F.xxhash64("scan_id"), F.lit(CELLS)).alias("_cell")
    shared = found.groupBy(*package, cell).agg(F.collect_list(F.struct("scan_id")).alias("_scans")).drop("_cell")
    texts = ["id", "mild", "osv_severity", "summary"]
    once = hits(shared, "NOT often").select(F.explode("_scans").alias("_s"), *texts).select("_s.scan_id", *texts)
    # An id is one finding of a package version, however often and by whatever it matches; the worst severity counts.
    worst = F.min(F.struct("mild", "osv_severity", "summary"))
    merged = hits(found.select(*package).distinct(), "often").groupBy(*package, "id").agg(worst.alias("w"))
    rows = once.unionByName(found.join(merged, package).select("scan_id", "id", "w.*"))
    level = F.when(F.col("mild"), F.lit("medium")).otherwise(F.lit("high"))
    return explode_findings(rows, finding(
        "supplychain.known_cve", F.lit(_CVE_SEQ), severity=level, title=(F.col("id"),),
        detail=T.trim_space(F.coalesce(F.col("summary"), F.lit(""))), remediation=(F.col("id"),),
        meta=F.to_json(F.struct("id", "osv_severity"))))


def supply_chain(specs: DataFrame, packages: DataFrame, advisories: DataFrame, as_of: Column,
                 popular=C.POPULAR_PACKAGES, ranges: DataFrame | None = None) -> DataFrame:
    """All supply-chain findings.  No package spec, or offline: none at all."""
    joined = with_package(specs, packages)
    return (typosquat(specs, popular).unionByName(package_findings(joined, as_of))
            .unionByName(known_cve(joined, advisories, ranges)))


# --- a popular list as large as a registry ----------------------------------

def _variants(text: Column, deletions: int) -> Column:
    """The text and every text made from it by up to ``deletions`` deletions."""
    def drop_one(word: Column) -> Column:
        size = F.length(word)
        cut = F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(
            F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, size)))
        return F.when(size > 0, cut).otherwise(F.array().cast("array<string>"))

    reached = F.array(text)
    layer = F.array(text)
    for _ in range(deletions):
        layer = F.array_distinct(F.flatten(F.transform(layer, drop_one)))
        reached = F.concat(reached, layer)
    return F.array_distinct(reached)


def _deletion_keys(text: Column, k: int) -> Column:
    """Texts within k edits share a form made by at most k deletions."""
    return F.transform(_variants(text, k), lambda form: F.xxhash64(form))


def typosquat_registry(names: DataFrame, registry: DataFrame) -> DataFrame:
    """Nearest registry package for each distinct name: (name, target, same_name, distance).

    ``registry`` has columns name and place (list order).  Names are made distinct and
    exact members leave first.  Then three equi-joins of growing cost, each only for
    names the one before left open: same unscoped name, one edit, two edits.  Candidates
    meet on hashed deletion forms, and ``levenshtein`` verifies them.  A name has about
    size ** k / k! forms, at any length, and a form is shared only by names within 2 * k
    edits of each other, never for a mere prefix: candidates grow with the registry.  Only
    the nearest target per name is kept, by partial minima.
    """
    listed = (registry.groupBy("name").agg(F.min("place").alias("place"))
              .withColumn("short", _as_bytes(T.unscoped(F.col("name")))))
    # One entry stands for all names that share an unscoped form: the earliest.
    heads = listed.groupBy("short").agg(F.min(F.struct("place", "name")).alias("head"))
    open_names = (names.select("name").distinct()
                  .join(listed.select("name"), "name", "left_anti")
                  .withColumn("short", _as_bytes(T.unscoped(F.col("name")))))

    same = open_names.join(heads, "short").select("name", F.col("head.name").alias("target"),
                                                  F.lit(0).alias("distance"))
    left = open_names.join(heads, "short", "left_anti")
    found = [same]
    short = F.col("short")
    for k in range(1, C.MAX_SQUAT_DISTANCE + 1):
        sought = offered = _deletion_keys(short, k)
        probes = left.select("name", "short", F.explode_outer(sought).alias("key"))
        keys = heads.select(short.alias("other"), "head", F.explode_outer(offered).alias("key"))
        near = (probes.join(keys, "key")
                .where(F.levenshtein("short", "other", k) == k)
                .groupBy("name").agg(F.min(F.col("head")).alias("head")))
        found.append(near.select("name", F.col("head.name").alias("target"), F.lit(k).alias("distance")))
        left = left.join(near.select("name"), "name", "left_anti")
    return (reduce(DataFrame.unionByName, found)
            .select("name", "target", (F.col("distance") == 0).alias("same_name"), "distance"))
