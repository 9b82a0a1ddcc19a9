"""What changed between two captures of a server, and how bad it is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import detect
from ..functions.jsontext import canonical_json, nfc, schema_property_names
from ..functions.regex import lowered, matches, matches_hinted
from ..functions.rows import unnest
from .findings import explode_findings, finding
from .ranking import previous_within

CHANGE_COLUMNS = ("scan_id", "kind", "target", "before", "after")
FACT_COLUMNS = ("steered", "event_steered", "shorter", "added_classes")


def steering_gained(before: Column, after: Column, pattern: str = C.STEERING_FINDING) -> Column:
    """The new text steers the model and the old one did not."""
    return matches(after, pattern) & ~matches(before, pattern)


def tool_keys(tools: DataFrame, source: int = 0) -> DataFrame:
    """What finds changed tools: (scan_id, name, k), k with hashes of the texts and where they stand.

    One row per scan and NFC name; the highest position wins.  Hashes are of the texts as they
    are, so nothing is decoded, normalised or searched here, and no text is shuffled.
    """
    digest = lambda c: F.sha2(F.coalesce(F.col(c), F.lit("")), 256)
    key = F.struct(F.lit(source).alias("source"), F.col("scan_id").alias("own"), "pos",
                   digest("description").alias("text"), digest("input_schema").alias("schema"))
    named = tools.select("scan_id", F.coalesce(nfc(F.col("name")), F.lit("")).alias("name"), key.alias("k"))
    return named.groupBy("scan_id", "name").agg(F.max_by("k", "k.pos").alias("k"))


def changed_tools(base: DataFrame, cur: DataFrame) -> DataFrame:
    """Tools that only one side has, or whose texts hash differently: (scan_id, name, b, c, reworded, reshaped)."""
    both = base.withColumnRenamed("k", "b").join(cur.withColumnRenamed("k", "c"), ["scan_id", "name"], "full")
    b, c = F.col("b"), F.col("c")
    present = b.isNotNull() & c.isNotNull()
    rows = both.select("scan_id", "name", "b", "c", (present & (b["text"] != c["text"])).alias("reworded"),
                       (present & (b["schema"] != c["schema"])).alias("reshaped"))
    return rows.where(~present | F.col("reworded") | F.col("reshaped"))


def _facts(changed: DataFrame, sources: list[DataFrame], texts: bool, classes: bool) -> DataFrame:
    """The texts of changed tools, read where they stand, as facts of the older (role 0) and newer (1) tool.

    Only here are texts moved, and only what a change needs is worked out: descriptions where
    they were reworded, canonical schemas and capability classes where the schema was.
    """
    b, c = F.col("b"), F.col("c")

    def side(role: int, key: Column, worded: Column) -> Column:
        return F.when(key.isNotNull(), F.struct(F.lit(role).alias("role"), key["source"].alias("source"), key["own"].alias("own"),
                                                key["pos"].alias("pos"), worded.alias("worded")))

    added = b.isNull() if texts else F.lit(False)
    sides = F.array(side(0, b, F.col("reworded")), side(1, c, F.col("reworded") | added))
    needs = unnest(changed, ["scan_id", "name", "reshaped"], sides, "s").select("scan_id", "name", "reshaped", "s.*")
    stored = [t.select(F.lit(i).alias("source"), F.col("scan_id").alias("own"), "pos", "description", "input_schema")
              for i, t in enumerate(sources)]
    rows = needs.join(reduce(DataFrame.unionByName, stored), ["source", "own", "pos"])
    told, shaped = F.col("worded") | F.col("reshaped"), F.col("reshaped")
    rows = (rows.withColumn("description", nfc(F.when(told, F.coalesce("description", F.lit("")))))
            .withColumn("input_schema", F.when(shaped, F.coalesce(canonical_json(F.when(shaped, F.col("input_schema"))), F.lit("")))))
    found = F.array().cast("array<string>")
    if classes:
        rows = rows.withColumn("_lower", lowered(F.when(shaped, F.concat("name", F.lit("\n"), "description"))))
        rows = rows.withColumn("_properties", schema_property_names(
            F.col("input_schema"), shaped & detect.schema_matters(F.col("input_schema"))))
        found = F.when(shaped, detect.capability_classes(F.col("_lower"), F.col("_properties")))
    text = F.when(F.col("worded"), F.col("description"))
    rows = rows.withColumn("_told", lowered(text))
    steers = lambda pattern: matches_hinted(text, F.col("_told"), [pattern])
    keep = (lambda x: x) if texts else (lambda x: F.sha2(x, 256))
    return rows.select("scan_id", "name", "role", keep(text).alias("text"), keep(F.col("input_schema")).alias("schema"),
                       F.octet_length(text).alias("bytes"), steers(C.STEERING_FINDING).alias("steers"),
                       steers(C.STEERING_EVENT).alias("event_steers"), found.alias("classes"))


def _tool_changes(base: DataFrame, cur: DataFrame, sources: list[DataFrame], texts: bool, classes: bool = True) -> DataFrame:
    """Changes between keyed tools, in two phases: hashes first, then the texts of what differs.

    ``sources`` are the tables that the keys' texts stand in.  Tools that hash differently may
    still be equal, as text in another normal form or schemas in another order.
    """
    facts = _facts(changed_tools(base, cur), sources, texts, classes)
    names = ("text", "schema", "bytes", "steers", "event_steers", "classes")
    of = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    both = facts.groupBy("scan_id", "name").agg(
        F.bool_or(F.col("role") == 0).alias("was"), F.bool_or(F.col("role") == 1).alias("is"),
        *[of(0, c).alias(f"old_{c}") for c in names], *[of(1, c).alias(f"new_{c}") for c in names])
    old, new = ({c: F.col(f"{side}_{c}") for c in names} for side in ("old", "new"))
    null = F.lit(None).cast("string")
    no, none = F.lit(False), F.array().cast("array<string>")

    def change(kind, before=null, after=null, steered=no, event=no, shorter=no, added=none) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.col("name").alias("target"),
            (before if texts else null).alias("before"), (after if texts else null).alias("after"),
            steered.alias("steered"), event.alias("event_steered"), shorter.alias("shorter"),
            added.alias("added_classes"))

    present = F.col("was") & F.col("is")
    hits = F.array(
        F.when(~F.col("was"), change("tool_added", after=new["text"])),
        F.when(~F.col("is"), change("tool_removed")),
        F.when(present & ~old["text"].eqNullSafe(new["text"]), change(
            "tool_description_changed", old["text"], new["text"], new["steers"] & ~old["steers"],
            new["event_steers"] & ~old["event_steers"], new["bytes"] < old["bytes"])),
        F.when(present & ~old["schema"].eqNullSafe(new["schema"]), change(
            "tool_schema_changed", old["schema"], new["schema"],
            added=F.array_except(new["classes"], old["classes"]))),
    )
    return unnest(both, ["scan_id"], hits, "x").select("scan_id", "x.*")


def _plain(changes: DataFrame) -> DataFrame:
    """Add the facts only tool changes have."""
    no = F.lit(False)
    return changes.select(
        *CHANGE_COLUMNS, no.alias("steered"), no.alias("event_steered"), no.alias("shorter"),
        F.array().cast("array<string>").alias("added_classes"))


def presence_diff(base: DataFrame, cur: DataFrame, key: str, what: str) -> DataFrame:
    """Added and removed keys of a list; keys count once however often they appear.

    One union and one aggregation with partial flags, instead of two anti-joins.
    """
    sides = (base.select("scan_id", key, F.lit(True).alias("was"), F.lit(False).alias("is"))
             .unionByName(cur.select("scan_id", key, F.lit(False).alias("was"), F.lit(True).alias("is"))))
    flags = (sides.groupBy("scan_id", nfc(F.col(key)).alias("target"))
             .agg(F.bool_or("was").alias("was"), F.bool_or("is").alias("is")))
    kind = F.when(F.col("is"), F.lit(f"{what}_added")).otherwise(F.lit(f"{what}_removed"))
    null = F.lit(None).cast("string")
    return (flags.where(F.col("was") != F.col("is"))
            .select("scan_id", kind.alias("kind"), "target", null.alias("before"), null.alias("after")))


def version_changed(base: DataFrame, cur: DataFrame) -> DataFrame:
    """Server version differs; ``base`` and ``cur`` have (scan_id, server_name, server_version)."""
    old = base.select("scan_id", nfc(F.col("server_version")).alias("before"))
    new = cur.select("scan_id", nfc(F.col("server_version")).alias("after"),
                     nfc(F.col("server_name")).alias("target"))
    return (old.join(new, "scan_id").where(F.col("before") != F.col("after"))
            .select("scan_id", F.lit("server_version_changed").alias("kind"), "target", "before", "after"))


def tool_diff(base_tools: DataFrame, cur_tools: DataFrame, texts: bool = True,
              classes: bool = True) -> DataFrame:
    """Tool changes of every pair; both sides carry the pair's ``scan_id``.

    With ``texts=False`` the changes carry no texts, and texts go into no later shuffle; every
    severity still comes out the same.
    """
    return _tool_changes(tool_keys(base_tools), tool_keys(cur_tools, 1), [base_tools, cur_tools], texts, classes)


def manifest_diff(base: dict[str, DataFrame], cur: dict[str, DataFrame], texts: bool = True) -> DataFrame:
    """All changes between two captures per ``scan_id``.

    ``base`` and ``cur`` are dicts of tables: ``tools`` and, if there are any, ``servers``,
    ``resources``, ``prompts``.  Pairs must exist on both sides: leave out captures without a
    baseline.
    """
    return _with_lists(tool_diff(base["tools"], cur["tools"], texts), base, cur)


def _with_lists(changes: DataFrame, base: dict[str, DataFrame], cur: dict[str, DataFrame]) -> DataFrame:
    """Tool changes with those of the server's header, resources and prompts, where there are tables of them."""
    if "servers" in base:
        changes = changes.unionByName(_plain(version_changed(base["servers"], cur["servers"])))
    if "resources" in base:
        changes = changes.unionByName(_plain(presence_diff(base["resources"], cur["resources"], "uri", "resource")))
    if "prompts" in base:
        changes = changes.unionByName(_plain(presence_diff(base["prompts"], cur["prompts"], "name", "prompt")))
    return changes


def diff_order(changes: DataFrame) -> DataFrame:
    """Changes in their fixed order: kind, then target, inside each scan."""
    return changes.orderBy("scan_id", "kind", "target")


def drift_findings(changes: DataFrame) -> DataFrame:
    """One finding per change, with severity by direction of the change."""
    kind, target = F.col("kind"), F.col("target")
    place = F.lit(len(C.CHANGE_KINDS))
    for i, name in enumerate(C.CHANGE_KINDS):
        place = F.when(kind == name, F.lit(i)).otherwise(place)

    def hit(condition: Column, rule: str, **texts) -> Column:
        return F.when(condition, finding("drift." + rule, place, tool=target, **texts))

    described = kind == "tool_description_changed"
    schema = kind == "tool_schema_changed"
    steered, shorter, added = F.col("steered"), F.col("shorter"), F.col("added_classes")
    quiet = described & ~steered
    simple = [hit(kind == k, k, detail=(target,)) for k in C.CHANGE_KINDS
              if k not in ("tool_description_changed", "tool_schema_changed", "server_version_changed")]
    return explode_findings(
        changes,
        hit(described & steered, "instruction_added", detail=(target,)),
        hit(quiet & shorter, "description_shortened", detail=(target,)),
        hit(quiet & ~shorter, "description_changed", detail=(target,)),
        hit(schema & (F.size(added) > 0), "capability_escalated", detail=(target, F.array_join(added, ", ")),
            meta=F.to_json(F.struct(added.alias("added_capabilities")))),
        hit(schema & (F.size(added) == 0), "schema_changed", detail=(target,)),
        hit(kind == "server_version_changed", "server_version_changed",
            detail=(F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")))),
        *simple)


def drift_event_severity(kind: Column, steered: Column, shorter: Column) -> Column:
    """Severity of a recorded event; deliberately a different scale than the finding's."""
    return (F.when(kind == "tool_description_changed",
                   F.when(steered, F.lit("critical")).when(shorter, F.lit("info")).otherwise(F.lit("low")))
            .when(kind == "tool_added", F.lit("medium"))
            .when(kind.isin("tool_schema_changed", "resource_added", "prompt_added"), F.lit("low"))
            .otherwise(F.lit("info")))


def scan_pairs(scans: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Each scan with the server's previous one: (server_id, scan_id, prev_scan_id, scanned_at).

    Scans of one server are cut into hours, and these by time and ranges of ``width`` ids, so
    neither a long history nor a bulk import under one time is sorted by one task.
    """
    together = F.struct(F.col("scanned_at"), F.floor(F.col("scan_id") / width).alias("ids"))
    return previous_within(
        scans.select("server_id", F.col("id").alias("scan_id"), "scanned_at"), ["server_id"],
        ["scanned_at", "scan_id"], [together, F.date_trunc("hour", F.col("scanned_at"))], F.col("scan_id"), "prev_scan_id")


def for_pairs(table: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A per-scan table in both roles: previous and current side of each pair.

    The key of a pair is the newer scan.  Both sides come out keyed by ``scan_id``.
    """
    linked = pairs.where(F.col("prev_scan_id").isNotNull())
    prev = linked.select(F.col("prev_scan_id").alias("scan_id"), F.col("scan_id").alias("_pair"))
    base = table.join(prev, "scan_id").drop("scan_id").withColumnRenamed("_pair", "scan_id")
    cur = table.join(linked.select("scan_id"), "scan_id", "left_semi")
    return base, cur


def drift_events(scans: DataFrame, tables: dict[str, DataFrame], texts: bool = True) -> DataFrame:
    """Events between each scan and the server's previous scan.

    ``scans`` has (id, server_id, scanned_at); ``tables`` are the per-scan tables
    ``manifest_diff`` takes.  The event id is a hash of its natural key.
    """
    pairs = scan_pairs(scans)
    return events_of(pair_changes(pairs, tables, texts), pairs)


def pair_changes(pairs: DataFrame, tables: dict[str, DataFrame], texts: bool = True) -> DataFrame:
    """Changes of all pairs between captures of the same tables.

    Most captures are the newer side of one pair and the older side of the next.  Tools are
    hashed before they take either role, and the texts are read for changed tools only.
    """
    tables = dict(tables)
    tools = tables.pop("tools")
    base, cur = {}, {}
    for name, table in {**tables, "keys": tool_keys(tools)}.items():
        base[name], cur[name] = for_pairs(table, pairs)
    return _with_lists(_tool_changes(base["keys"], cur["keys"], [tools], texts), base, cur)


def events_of(changes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Recorded form of changes whose pairs are known."""
    diff = F.to_json(F.struct("kind", "target", F.nullif("before", F.lit("")).alias("before"),
                              F.nullif("after", F.lit("")).alias("after")))
    return changes.join(pairs, "scan_id").select(
        F.xxhash64("server_id", "scan_id", "kind", "target").alias("id"), "server_id",
        F.col("prev_scan_id").alias("from_scan_id"), F.col("scan_id").alias("to_scan_id"), "kind", "target",
        drift_event_severity(F.col("kind"), F.col("event_steered"), F.col("shorter")).alias("severity"),
        diff.alias("diff_json"), F.col("scanned_at").alias("detected_at"))
