"""From scored hits to the list that is shown: preferences, noise, launch groups, order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from seekstone.operators import preferences as P
from seekstone.operators.catalog import launch_rank, layer
from seekstone.operators.search import PROTECTED_TIER, final_order
from seekstone.shared import stage

#: Weak tiers, the tier of noise, what noise loses, and queries that are short (fixed values).
WEAK_TIER, NOISE_TIER, NOISE_PENALTY, SHORT_QUERY = 5, 9, 250, 2


def quieten(hits: DataFrame) -> DataFrame:
    """Aliases and discoveries sink where they are hit weakly or by a short query, unless protected."""
    noisy = layer(F.col("source")).isin("CommandAlias", "Supplemental") & (F.col("tier") > PROTECTED_TIER)
    weak = noisy & ((F.col("tier") >= WEAK_TIER) | F.length("q").between(1, SHORT_QUERY))
    return hits.withColumns({"score": F.when(weak, F.col("score") - NOISE_PENALTY).otherwise(F.col("score")), "tier": F.when(weak, NOISE_TIER).otherwise(F.col("tier"))})


def collapse(hits: DataFrame, catalog: DataFrame, groups: DataFrame, pinned: DataFrame, hidden: DataFrame) -> DataFrame:
    """One hit for each query and launch group: the best member's score, tier and evidence on the row
    that is launched, with its ``icon_id``.

    Launched is a visible pinned member of the group, whether it was hit or not, else the first visible
    one by the group's own order; a pin on an uninstall entry counts for nothing. The icon is the
    launched row's, else that of the first visible member with one.
    """
    gone = hidden.select(F.col("item_id").alias("id")).distinct().withColumn("_gone", F.lit(True))
    pins = pinned.select(F.col("item_id").alias("id")).distinct().withColumn("_pin", F.lit(True))
    members = catalog.join(groups, "id").join(gone, "id", "left").join(pins, "id", "left")
    icon = F.col("icon").isNotNull() if "icon" in catalog.columns else F.lit(False)
    pin = F.col("_pin").isNotNull() & (F.col("source") != "uninstall")
    seen = F.col("_gone").isNull() | ~F.col("source").isin(*P.HIDEABLE)
    order = F.struct(launch_rank(members))
    launched = members.groupBy("group_id").agg(
        F.coalesce(F.min_by("id", F.when(seen, F.struct(~pin, order))), F.min_by("id", order)).alias("id"),
        F.min_by("id", F.when(seen & icon, order)).alias("other_icon"),
    )
    best = F.row_number().over(Window.partitionBy("query_id", "group_id").orderBy(*final_order()))
    evidence = ["query_id", "q", "group_id", "score", "tier", "tag", "start", "gaps", "edits", "span", "field", "kind"]
    met = hits if "group_id" in hits.columns else hits.join(groups, "id")
    top = met.withColumn("_k", best).where("_k = 1").select(*evidence)
    shown = catalog.select("id", "name", "source", icon.alias("has_icon"))
    out = top.join(launched, "group_id").join(shown, "id")
    return out.withColumn("icon_id", F.when(F.col("has_icon"), F.col("id")).otherwise(F.coalesce("other_icon", "id"))).drop("other_icon", "has_icon")


def finish(hits: DataFrame, catalog: DataFrame, groups: DataFrame, pairs: DataFrame, usage: DataFrame, pinned: DataFrame, demoted: DataFrame, hidden: DataFrame, now: int, k: int = 200) -> DataFrame:
    """``(query_id, rank, id, name, score, tier, tag, icon_id)``: the final lists.

    In this order: hidden rows go, boosts, noise sinks, groups collapse, ranking, the k best. Tiers
    are those before the boosts. ``hits`` are verified candidates of a catalog with sources.
    """
    groups = stage(groups, "groups")  # read three times
    asked = hits.withColumns({"query": F.col("q"), "item_id": F.col("id")}).join(groups, "id")
    low = demoted.select("item_id").distinct().join(hidden.select("item_id").distinct(), "item_id", "left_anti").join(groups.withColumnRenamed("id", "item_id"), "item_id").select("group_id").distinct()
    lifted = P.personalize(P.with_boosts(asked, pairs, usage, now), pinned, low, hidden)
    lifted = lifted.withColumn("tag", F.concat("tag", "why")).drop("why", "query", "item_id")
    shown = collapse(quieten(lifted), catalog, groups, pinned, hidden)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*final_order()))
    return shown.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "id", "name", "score", "tier", "tag", "icon_id")
