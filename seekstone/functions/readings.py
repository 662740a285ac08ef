"""Readings of Chinese characters, from a table of them.

``readings(ch, readings)`` lists each character's readings, the usual one first. The table is as long
as a script has characters; it is counted before it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BROADCAST_ROWS = 200_000


def char_readings(texts: DataFrame, readings: DataFrame) -> DataFrame:
    """``(text, char_readings)`` of distinct ``texts(text)``: each character with its readings, in order."""
    chars = texts.where("text is not null").distinct().select("text", F.posexplode(F.split("text", "")).alias("i", "ch"))
    known = F.broadcast(readings) if readings.count() <= BROADCAST_ROWS else readings
    met = chars.join(known, "ch", "left").select("text", "i", F.struct("ch", F.coalesce("readings", F.array().cast("array<string>")).alias("readings")).alias("x"))
    return met.groupBy("text").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("char_readings"))


def full(chars: Column) -> Column:
    """The usual readings joined; characters without one in lower case; no spaces."""
    return F.array_join(F.transform(_solid(chars), lambda x: F.coalesce(F.get(x["readings"], F.lit(0)), F.lower(x["ch"]))), "")


def initials(chars: Column) -> Column:
    """The first letters of the usual readings, other characters as they are."""
    return F.array_join(F.transform(_solid(chars), lambda x: F.coalesce(F.left(F.get(x["readings"], F.lit(0)), F.lit(1)), F.lower(x["ch"]))), "")


def syllables(chars: Column) -> Column:
    """A syllable for each character with a reading; other characters run together up to a space."""
    mark = F.transform(chars, lambda x: F.when(F.size(x["readings"]) > 0, F.concat(F.lit("\x00"), F.get(x["readings"], F.lit(0)), F.lit("\x00"))).when(F.rlike(x["ch"], F.lit("(?U)^\\s$")), "\x00").otherwise(F.lower(x["ch"])))
    return F.filter(F.split(F.array_join(mark, ""), "\x00"), lambda s: s != "")


def _solid(chars: Column) -> Column:
    return F.filter(chars, lambda x: ~F.rlike(x["ch"], F.lit("(?U)^\\s$")))


def attach(catalog: DataFrame, readings: DataFrame) -> DataFrame:
    """``catalog`` with ``reading``, ``initials``, ``char_readings``, ``syllables`` of its display names, and where it has
    keywords or context the readings of those."""
    shown = F.coalesce("display_name", "name") if "display_name" in catalog.columns else F.col("name")
    lists = [(c, n) for c, n in (("search_keywords", "keyword"), ("search_context", "context")) if c in catalog.columns]
    texts = catalog.select(shown.alias("text"))
    for c, _ in lists:
        texts = texts.unionByName(catalog.select(F.explode(c).alias("text")))
    known = char_readings(texts, readings)
    han = F.exists("char_readings", lambda x: F.size(x["readings"]) > 0)
    known = known.select("text", F.when(han, full(F.col("char_readings"))).otherwise("").alias("_full"), F.when(han, initials(F.col("char_readings"))).otherwise("").alias("_short"), F.when(han, F.col("char_readings")).alias("char_readings"), F.when(han, syllables(F.col("char_readings"))).alias("syllables"))
    out = catalog.withColumn("_text", shown).join(known.withColumnRenamed("text", "_text"), "_text", "left").drop("_text").withColumnsRenamed({"_full": "reading", "_short": "initials"})
    out = out.fillna("", ["reading", "initials"])
    for c, name in lists:
        met = catalog.select("id", F.explode(F.array_distinct(c)).alias("text")).join(known.drop("char_readings", "syllables"), "text").where("_full <> ''")
        met = met.groupBy("id").agg(F.array_sort(F.collect_set("_full")).alias(f"{name}_readings"), F.array_sort(F.collect_set("_short")).alias(f"{name}_initials"))
        out = out.join(met, "id", "left")
    return out


