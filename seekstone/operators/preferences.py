"""Preference counters from an event log, and the boosts that they give to search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seekstone.functions import text as T
from seekstone.operators.ordered import numbered
from seekstone.operators.catalog import HIDEABLE, hidden_on_empty_query

DAY = 86_400
#: Caps and constants of the boosts (fixed values).
BOOST_MAX, PIN_BOOST, DEMOTE_PENALTY = 160, 180, 180
FREQUENCY_CAP, RECENCY_CAP, PAIR_CAP, WEAK_PAIR_CAP = 45, 40, 110, 45
LEARNED_COUNT, LEARNED_SHARE, PROTECTED_TIER = 3, 0.70, 2


def usage(log: DataFrame) -> DataFrame:
    """``(item_id, launches, last_used)`` of ``log(item_id, at)``."""
    return log.groupBy("item_id").agg(F.count("*").alias("launches"), F.max("at").alias("last_used"))


def pairs(log: DataFrame) -> DataFrame:
    """``(query, item_id, n, last_used, share)``: what was chosen for a query, and how surely."""
    counts = log.groupBy("query", "item_id").agg(F.count("*").alias("n"), F.max("at").alias("last_used"))
    totals = log.groupBy("query").agg(F.count("*").alias("total"))
    return counts.join(totals, "query").select("query", "item_id", "n", "last_used", (F.col("n") / F.col("total")).alias("share"))


def freshness(last_used: Column, now: int) -> Column:
    """1 for times of 30 days at most, also for unknown and future ones, then less."""
    age = F.lit(now) - last_used
    return F.when((last_used <= 0) | (age <= 30 * DAY), 1.0).when(age <= 90 * DAY, 0.8).when(age <= 180 * DAY, 0.6).otherwise(0.4)


def pair_score(n: Column, share: Column, last_used: Column, now: int) -> Column:
    cap = F.when((n >= LEARNED_COUNT) & (share >= LEARNED_SHARE), PAIR_CAP).otherwise(WEAK_PAIR_CAP)
    raw = F.round((30 + 14 * F.ln(n.cast("double"))) * share * freshness(last_used, now))
    return F.when(n > 0, F.greatest(F.lit(0), F.least(raw, cap))).otherwise(0).cast("int")


def frequency_score(launches: Column) -> Column:
    return F.when(launches > 0, F.least(F.round(10 + 8 * F.ln(launches.cast("double"))), F.lit(FREQUENCY_CAP))).otherwise(0).cast("int")


def recency_score(last_used: Column, now: int) -> Column:
    """40 within a day, then falling to 0 at seven days; 0 for times that are not past or not known."""
    age = F.lit(now) - last_used
    falling = F.round(RECENCY_CAP * (7 * DAY - age) / (6.0 * DAY))
    return F.when((last_used <= 0) | (age <= 0) | (age >= 7 * DAY), 0).when(age < DAY, RECENCY_CAP).otherwise(falling).cast("int")


def with_boosts(hits: DataFrame, pair_table: DataFrame, usage_table: DataFrame, now: int) -> DataFrame:
    """``hits(query, item_id, ...)`` with ``boost``: pair, frequency and recency together, capped.

    Frequency and recency count for every item, whether it was chosen for this query before or not.
    """
    chosen = pair_table.select("query", "item_id", F.col("n").alias("_n"), F.col("share").alias("_share"), F.col("last_used").alias("_paired"))
    used = usage_table.select("item_id", F.col("launches").alias("_launches"), F.col("last_used").alias("_used"))
    joined = hits.join(chosen, ["query", "item_id"], "left").join(used, "item_id", "left")
    total = F.coalesce(pair_score(F.col("_n"), F.col("_share"), F.col("_paired"), now), F.lit(0)) + F.coalesce(frequency_score(F.col("_launches")), F.lit(0)) + F.coalesce(recency_score(F.col("_used"), now), F.lit(0))
    return joined.withColumn("boost", F.least(total, F.lit(BOOST_MAX)).cast("int")).select(*hits.columns, "boost")


def personalize(hits: DataFrame, pinned: DataFrame, demoted: DataFrame, hidden: DataFrame) -> DataFrame:
    """``hits(query, item_id, score, tier, boost, ...)`` without hidden ones, with lifted scores and ``why``.

    Hidden items go first, where their ``source`` (if there) may be hidden at all. A pin lifts by 180 or
    the history if that is more; a demotion takes 180 from unprotected hits, and holds for a whole
    launch group (``group_id``, if there) by any of its members that is not hidden. Tiers are those of
    the unboosted scores.
    """
    hide = hidden.select(F.col("item_id").alias("_hidden")).distinct()
    hides = F.col("item_id") == F.col("_hidden")
    if "source" in hits.columns:  # one pass: hits are dear, and would be worked out for each branch of a union
        hides = F.col("source").isin(*HIDEABLE) & hides
    kept = hits.join(hide, hides, "left_anti")
    flag = lambda df, key, name: df.select(key).distinct().withColumn(name, F.lit(True))
    out = kept.join(flag(pinned, "item_id", "_pin"), "item_id", "left")
    out = out.join(flag(demoted, "group_id" if "group_id" in hits.columns else "item_id", "_low"), "group_id" if "group_id" in hits.columns else "item_id", "left")
    boost = F.coalesce("boost", F.lit(0))
    lowered = F.col("_low").isNotNull() & (F.col("tier") > PROTECTED_TIER)
    lift = F.when(F.col("_pin").isNotNull(), F.greatest(F.lit(PIN_BOOST), boost)).otherwise(boost) - F.when(lowered, DEMOTE_PENALTY).otherwise(0)
    why = F.when(F.col("_pin").isNotNull(), "+pin").when(lowered, "+demote").when(boost > 0, "+history").otherwise("")
    return out.withColumns({"score": (F.col("score") + lift).cast("int"), "why": why}).drop("_pin", "_low", "boost")


def rerank(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query: protected by tier and score, then the open ones by score and tier."""
    shielded = F.col("tier") <= PROTECTED_TIER
    order = [shielded.desc(), F.when(shielded, F.col("tier")).otherwise(99), F.desc("score"), "tier", "item_id"]
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def recent(usage_table: DataFrame, k: int) -> DataFrame:
    return usage_table.where("last_used > 0").orderBy(F.desc("last_used"), "item_id").limit(k)


def remap(usage_table: DataFrame, mapping: DataFrame) -> DataFrame:
    """Counters after old ids became new ones (``mapping(old_id, new_id)``): sums, latest time."""
    return moved(usage_table, mapping).groupBy("item_id").agg(F.sum("launches").alias("launches"), F.max("last_used").alias("last_used"))


def moved(table: DataFrame, mapping: DataFrame, column: str = "item_id") -> DataFrame:
    """``table`` with the ids of a column replaced; empty and equal ids are no replacement."""
    usable = mapping.where("old_id <> new_id and cast(old_id as string) <> '' and cast(new_id as string) <> ''")
    return table.join(usable.select(F.col("old_id").alias("_old"), F.col("new_id").alias("_new")), table[column] == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).select(*table.columns)


def remap_all(tables: dict[str, DataFrame], mapping: DataFrame) -> dict[str, DataFrame]:
    """All six preference tables after ids were replaced.

    ``usage`` and ``pairs`` sum their counts and keep the latest time; ``pinned``, ``demoted`` and
    ``hidden`` keep the latest time, hidden ones also what the row of the new id says (else the old
    one's); the ``target_id`` of ``aliases`` is rewritten. Tables that are not given are left out.
    """
    out = {}
    if "usage" in tables:
        out["usage"] = remap(tables["usage"], mapping)
    if "pairs" in tables:
        out["pairs"] = moved(tables["pairs"], mapping).groupBy("query", "item_id").agg(F.sum("n").alias("n"), F.max("last_used").alias("last_used"))
    for name, at in (("pinned", "pinned_at"), ("demoted", "demoted_at")):
        if name in tables:
            out[name] = moved(tables[name], mapping).groupBy("item_id").agg(F.max(at).alias(at))
    if "hidden" in tables:
        own = tables["hidden"].withColumn("_id", F.col("item_id"))
        rest = [c for c in tables["hidden"].columns if c not in ("item_id", "hidden_at")]
        new = moved(own, mapping).withColumn("_own", F.col("_id") != F.col("item_id"))
        best = new.groupBy("item_id").agg(F.min_by(F.struct(*rest), F.struct("_own", "_id")).alias("r"), F.max("hidden_at").alias("hidden_at"))
        out["hidden"] = best.select("item_id", *(F.col(f"r.{c}").alias(c) for c in rest), "hidden_at")
    if "aliases" in tables:
        out["aliases"] = moved(tables["aliases"], mapping, "target_id")
    return out


def empty_query_sections(catalog: DataFrame, usage_table: DataFrame, pinned: DataFrame, hidden: DataFrame, k: int) -> DataFrame:
    """What an empty query shows: pins, then recent items, then the catalog; each item once, k in all."""
    ids = lambda df, section, order: df.select(F.col("item_id"), F.lit(section).alias("section"), order.cast("long").alias("place"))
    parts = ids(pinned, 0, -F.col("pinned_at")).unionByName(ids(usage_table.where("last_used > 0"), 1, -F.col("last_used"))).unionByName(ids(catalog, 2, F.lit(0)))
    shown = parts.join(hidden.select("item_id").distinct(), "item_id", "left_anti").join(catalog.select("item_id").distinct(), "item_id", "left_semi")
    once = shown.groupBy("item_id").agg(F.min(F.struct("section", "place")).alias("m")).select("item_id", "m.section", "m.place")
    return once.orderBy("section", "place", "item_id").limit(k)


def dashboard(catalog: DataFrame, usage_table: DataFrame, pinned: DataFrame, recent_rows: int = 16, pinned_rows: int = 8) -> DataFrame:
    """``(section, place, item_id, score, tag)`` of an empty query's two lists.

    Recent items without pinned ones, filled up by rows of the catalog that may fill it
    (``catalog(item_id, source, target)``, in order of ids); beside them the pins, the latest first.
    """
    known = catalog.select("item_id", hidden_on_empty_query(F.col("source"), F.col("target")).alias("_no"))
    pins = pinned.select("item_id").distinct()
    used = usage_table.where("last_used > 0").join(known, "item_id").join(pins, "item_id", "left_anti").select("item_id", F.lit(0).alias("fill"), (-F.col("last_used")).alias("by"))
    fill = known.where("not _no").join(pins, "item_id", "left_anti").select("item_id", F.lit(1).alias("fill"), F.lit(0).cast("long").alias("by"))
    first = used.unionByName(fill).groupBy("item_id").agg(F.min(F.struct("fill", "by")).alias("m")).select("item_id", "m.*").orderBy("fill", "by", "item_id").limit(recent_rows)
    place = lambda *order: F.row_number().over(Window.orderBy(*order))  # noqa: E731  over so many rows at most
    left = first.select(F.lit("recent").alias("section"), place("fill", "by", "item_id").alias("place"), "item_id", F.when(F.col("fill") == 0, 1).otherwise(0).alias("score"), F.when(F.col("fill") == 0, "recent").otherwise("default").alias("tag"))
    latest = pinned.groupBy("item_id").agg(F.max("pinned_at").alias("at")).join(known, "item_id").orderBy(F.desc("at"), "item_id").limit(pinned_rows)
    return left.unionByName(latest.select(F.lit("pinned").alias("section"), place(F.desc("at"), "item_id").alias("place"), "item_id", F.lit(2).alias("score"), F.lit("pinned").alias("tag")))


# --- the store as tables -----------------------------------------------------------------------


def upserted(table: DataFrame, rows: DataFrame, key: str | list[str]) -> DataFrame:
    """``table`` with ``rows`` put in place of those with the same key."""
    return table.join(rows.select(*([key] if isinstance(key, str) else key)).distinct(), key, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def without(table: DataFrame, ids: DataFrame, column: str = "item_id") -> DataFrame:
    """``table`` without the rows of some ids (``ids(item_id)``): unpin, restore, clear."""
    return table.join(ids.select(F.col("item_id").alias("_gone")).distinct(), table[column] == F.col("_gone"), "left_anti")


def snapshot_of(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``table`` for some ids: what a result list needs to know."""
    return table.join(ids.select("item_id").distinct(), "item_id", "left_semi")


def latest_first(table: DataFrame, at: str) -> DataFrame:
    """Pins, demotions or hidden items by time, the latest first."""
    return table.orderBy(F.desc(at), "item_id")


def hide(hidden: DataFrame, items: DataFrame, now: int) -> DataFrame:
    """``hidden`` with ``items(id, name, display_name, target, args)`` put in; items without an id are not."""
    shown = F.when(F.trim(F.coalesce("display_name", F.lit(""))) == "", F.col("name")).otherwise(F.col("display_name"))
    rows = items.where("trim(cast(id as string)) <> ''").select(F.col("id").alias("item_id"), shown.alias("display_name"), "target", "args", F.lit(now).cast("long").alias("hidden_at"))
    return upserted(hidden, rows, "item_id")


def clear_records(tables: dict[str, DataFrame], items: DataFrame, now: int) -> dict[str, DataFrame]:
    """The tables after items were hidden and all that is kept about them was deleted."""
    ids = items.select(F.col("id").alias("item_id"))
    out = {name: without(t, ids, "target_id" if name == "aliases" else "item_id") for name, t in tables.items() if name != "hidden"}
    return out | {"hidden": hide(tables["hidden"], items, now)}


def set_aliases(aliases: DataFrame, rows: DataFrame) -> DataFrame:
    """``aliases`` with ``rows(alias, target_name, target_id)`` put in, trimmed and in lower case; empty
    aliases and targets are not."""
    clean = rows.select(F.lower(F.trim("alias")).alias("alias"), F.trim("target_name").alias("target_name"), "target_id").where("alias <> '' and target_name <> ''")
    return upserted(aliases, clean.groupBy("alias").agg(F.max(F.struct("target_name", "target_id")).alias("r")).select("alias", "r.*"), "alias")


def aliases_of(aliases: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, alias, target_name, target_id)``: the aliases that queries are (``queries(query_id, q)``)."""
    return queries.join(aliases, queries["q"] == aliases["alias"]).select("query_id", "alias", "target_name", "target_id")


def save_manual(apps: DataFrame, rows: DataFrame) -> DataFrame:
    """``apps(id, path, path_key, display_name, item_id)`` with ``rows(path, display_name, item_id)``.

    A path or an item that is registered already keeps its row; of new rows with one path or item the
    first by path stays. New ids follow the largest.
    """
    new = rows.select("path", T.path_key(F.col("path")).alias("path_key"), "display_name", "item_id")
    for key in ("path_key", "item_id"):
        new = new.join(apps.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.min(F.struct(*(c for c in ("path", "path_key", "display_name", "item_id") if c != key))).alias("r")).select(key, "r.*")
    last = apps.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))  # one row
    placed = numbered(new, ["path", "item_id"], "_place").join(F.broadcast(last)).withColumn("id", F.col("last") + F.col("_place"))
    return apps.unionByName(placed.select(*apps.columns))


def rename_manual(apps: DataFrame, names: DataFrame) -> DataFrame:
    """``apps`` with the display names of ``names(id, display_name)``; an empty name is an error."""
    checked = F.when(F.trim("display_name") != "", F.trim("display_name")).otherwise(F.raise_error(F.lit("a manual entry needs a name")))
    given = names.groupBy(F.col("id").alias("_id")).agg(F.max("display_name").alias("display_name")).select("_id", checked.alias("_name"))
    out = apps.join(given, apps["id"] == F.col("_id"), "left")
    return out.withColumn("display_name", F.coalesce("_name", "display_name")).select(*apps.columns)


def refresh_manual(apps: DataFrame, identities: DataFrame) -> DataFrame:
    """``apps`` with the item ids that their present targets have (``identities(id, item_id)``; null or
    empty: the entry is not valid now). History stays with the ids it was written under."""
    given = identities.groupBy(F.col("id").alias("_id")).agg(F.max(F.trim(F.coalesce("item_id", F.lit("")))).alias("_item"))
    out = apps.join(given, apps["id"] == F.col("_id"), "left")
    return out.withColumn("item_id", F.coalesce("_item", "item_id")).select(*apps.columns)


def save_settings(settings: DataFrame, changes: DataFrame) -> DataFrame:
    """``settings(key, value)`` with ``changes(key, value, at)`` put in, of one key's the latest; a null
    value takes a setting out."""
    last = changes.groupBy("key").agg(F.max_by("value", "at").alias("value"))
    return upserted(settings, last, "key").where("value is not null")


def settings_row(settings: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """One row of all settings by name (``settings(key, value)``), defaults where one is not stored."""
    return settings.groupBy().agg(*(F.coalesce(F.max(F.when(F.col("key") == k, F.col("value"))), F.lit(v)).alias(k) for k, v in defaults.items()))
