"""Which extension a query goes to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: What a manifest must hold to be registered (fixed values).
SCHEMA_VERSION, API_VERSION = 1, 1


def route(queries: DataFrame, triggers: DataFrame) -> DataFrame:
    """``(query_id, provider, rest)``: the first trigger that a query meets.

    A prefix stands at the query's start; a keyword must end there or be followed by white space. Each
    trigger is a key by kind and value; a query has the keys of its first word and of its first
    characters, as many as the longest prefix has, so the join is an equi join.
    """
    q = F.trim("text")
    longest = triggers.where("kind = 'prefix'").agg(F.coalesce(F.max(F.length("value")), F.lit(0))).first()[0]
    word = F.lower(F.regexp_extract(q, "(?U)^(\\S+)", 1))
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(q), F.lit(longest)))), lambda n: F.concat(F.lit("p"), F.left(q, n)))
    asked = queries.where(q != "").select("query_id", q.alias("q"), F.explode(F.array_append(starts, F.concat(F.lit("k"), word))).alias("key"))
    keyed = triggers.withColumn("key", F.when(F.col("kind") == "prefix", F.concat(F.lit("p"), "value")).otherwise(F.concat(F.lit("k"), F.lower("value"))))
    met = asked.join(keyed, "key")
    first = met.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "provider"))).where("k = 1")
    return first.select("query_id", "provider", F.regexp_replace(F.substr("q", F.length("value") + 1), "(?U)^\\s+|\\s+$", "").alias("rest"))


def valid_manifest(schema: Column, api: Column, plugin: Column, entry: Column) -> Column:
    """Whether an extension may be registered: versions, a plain id, and a program below its own folder."""
    plain = F.rlike(plugin, F.lit(r"^[a-z0-9]+([._-][a-z0-9]+)*$"))
    inside = ~F.rlike(entry, F.lit(r"^([A-Za-z]:|[\\\\/])")) & ~F.exists(F.split(entry, r"[\\\\/]"), lambda x: x == "..") & (entry != "")
    return F.coalesce((schema == SCHEMA_VERSION) & (api == API_VERSION) & plain & inside, F.lit(False))


PANEL = "struct<blocks:array<struct<type:string,text:string,style:string,value:string,selectable:boolean,level:string,key:string>>,actions:array<struct<id:string,label:string,default:boolean>>>"


def panel(text: Column) -> Column:
    """An extension's panel read from JSON: blocks of known types only, actions as they are."""
    read = F.from_json(text, PANEL)
    kinds = ("text", "value", "key_value", "notice", "divider")
    return F.struct(F.filter(read["blocks"], lambda b: b["type"].isin(*kinds)).alias("blocks"), read["actions"].alias("actions"))
