"""Result lists from several providers: sources and actions, slots, direct paths, commands, web rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seekstone.functions import text as T

#: Scores and places of rows that are no search hits (fixed values).
FIRST_BROWSER, OTHER_BROWSER, FIRST_SEARCH, OTHER_SEARCH, PROVIDER_BASE = 980, 960, 920, 900, 900
COMMAND_EXACT, COMMAND_PREFIX, COMMAND_ROWS, WEB_SLOT, MAX_RESULTS = 940, 800, 8, 4, 200


def is_http(target: Column) -> Column:
    return F.coalesce(F.rlike(F.trim(target), F.lit("^(?i)https?://")), F.lit(False))


def result_source(tag: Column, item: Column, source: Column, target: Column, own: str = "builtin:") -> Column:
    """file, web, builtin or app: by how a row was found, then its id (``own`` begins those of functions
    that the engine itself offers), its source, its target."""
    web, files, builtin = F.lit("web"), F.lit("file"), F.lit("builtin")
    return (
        F.when(tag == "file", files).when(tag == "file-search-status", builtin).when(tag.isin("websearch", "url"), web).when(tag.isin("builtin", "win-settings", "builtin-system"), builtin)
        .when(F.startswith(item, F.lit("file:")), files).when(F.rlike(item, F.lit("^(url|websearch):")), web).when(F.startswith(item, F.lit(own)), builtin)
        .when(source.isin("file-search", "file-search-raw"), files).when(source.isin("websearch", "url", "browser"), web).when(source.isin("builtin", "builtin-system", "win-settings", "file-search-status"), builtin)
        .when(is_http(target), web).otherwise("app")
    )


def result_action(kind: Column, item: Column, target: Column) -> Column:
    """``struct<action,value>``: open a file, open an address, or launch by id."""
    action = lambda name, value: F.struct(F.lit(name).alias("action"), value.alias("value"))
    return F.when(kind == "file", action("open-file", target)).when((kind == "web") & is_http(target), action("open-url", F.trim(target))).otherwise(action("launch", item))


def in_blocks(blocks: list[DataFrame], k: int = MAX_RESULTS) -> DataFrame:
    """Blocks ``(query_id, id, score, ...)``, each in its own order ``place``, one after another, k a query."""
    out = None
    for n, block in enumerate(blocks):
        rows = block.withColumn("_block", F.lit(n))
        out = rows if out is None else out.unionByName(rows)
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("_block", "place", "id"))
    return out.withColumn("place", order).where(F.col("place") <= k).drop("_block")


def at_slot(rows: DataFrame, one: DataFrame, slot: int = WEB_SLOT) -> DataFrame:
    """``rows(query_id, place, ...)`` with one row a query put at a place (from 0), at the end of shorter
    lists. Other places move on."""
    sizes = rows.groupBy("query_id").agg(F.count("*").alias("_n"))
    put = one.join(sizes, "query_id", "left").withColumn("place", F.least(F.lit(slot), F.coalesce("_n", F.lit(0))) + 1).drop("_n")
    moved = rows.join(one.select("query_id").distinct().withColumn("_one", F.lit(True)), "query_id", "left")
    moved = moved.withColumn("place", F.when(F.col("_one") & (F.col("place") > slot), F.col("place") + 1).otherwise(F.col("place"))).drop("_one")
    return moved.unionByName(put.select(*moved.columns))


def by_score(rows: DataFrame, more: DataFrame) -> DataFrame:
    """``more`` (by score, then id) put into ``rows``, each before the first row with a lower score.

    Rows keep their order even where their scores do not fall: a row counts with the least score
    before and at its place. Ids that are there already are not put in again.
    """
    new = more.join(rows.select("query_id", "id"), ["query_id", "id"], "left_anti").select(*more.columns)
    least = F.min("score").over(Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    old = rows.withColumns({"_level": least, "_new": F.lit(0)})
    new = new.withColumns({"place": F.lit(0), "_level": F.col("score"), "_new": F.lit(1)})
    order = Window.partitionBy("query_id").orderBy(F.desc("_level"), "_new", F.when(F.col("_new") == 0, F.col("place")), F.desc("score"), "id")
    return old.unionByName(new.select(*old.columns)).withColumn("place", F.row_number().over(order)).drop("_level", "_new")


def prepend_direct_path(rows: DataFrame, queries: DataFrame, k: int = MAX_RESULTS) -> DataFrame:
    """A query that is itself a path comes first; rows with the same target (case and slashes folded) go."""
    direct = queries.select("query_id", T.direct_path(F.col("text")).alias("target")).where("target is not null")
    keyed = direct.select("query_id", T.path_key(F.col("target")).alias("_key"))
    left = rows.withColumn("_key", T.path_key(F.col("target"))).join(keyed, ["query_id", "_key"], "left_anti").select(*rows.columns)
    first = direct.select("query_id", F.concat(F.lit("path:"), "target").alias("id"), F.lit(1000).alias("score"), F.lit(0).cast("long").alias("place"), "target")
    return in_blocks([first.select(*(F.col(c) if c in first.columns else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns)), left], k)


def command_hits(queries: DataFrame, commands: DataFrame) -> DataFrame:
    """``(query_id, id, score)``: at most eight commands a query, by score and id.

    ``commands(id, title, keywords, phase)`` of extensions that are neither disabled nor incompatible,
    met where the title holds the query or a keyword begins with it. A short table, joined by a key
    that both sides hold: the query's first character.
    """
    asked = queries.select("query_id", F.lower(F.trim("text")).alias("q")).where("q <> ''").withColumn("k", F.left("q", F.lit(1)))
    known = commands.where("phase not in ('disabled', 'incompatible')").select("id", F.lower("title").alias("t"), F.transform(F.coalesce("keywords", F.array().cast("array<string>")), F.lower).alias("words"))
    known = known.withColumn("k", F.explode(F.array_distinct(F.concat(T.grams(F.col("t"), 1), F.transform("words", lambda w: F.left(w, F.lit(1)))))))
    met = asked.join(known, "k").where("contains(t, q) or exists(words, w -> startswith(w, q))")
    score = F.when(F.expr("t = q or array_contains(words, q)"), COMMAND_EXACT).otherwise(COMMAND_PREFIX)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return met.select("query_id", "id", score.alias("score")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= COMMAND_ROWS).drop("k")


def provider_rows(items: DataFrame) -> DataFrame:
    """A provider's own list: scores from 900 by its priority (0 to 100), then by id."""
    score = PROVIDER_BASE + F.greatest(F.lit(0), F.least(F.coalesce("priority", F.lit(0)), F.lit(100)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return items.withColumn("score", score.cast("int")).withColumn("place", place)


def browser_rows(queries: DataFrame, browsers: DataFrame, preferred: str | None, search: bool) -> DataFrame:
    """``(query_id, id, score, place)``: an address or a search in each browser, the preferred one first.

    ``queries(query_id, value)`` and the short table ``browsers(browser, position)``; the system's own
    follows last.
    """
    first, other = (FIRST_SEARCH, OTHER_SEARCH) if search else (FIRST_BROWSER, OTHER_BROWSER)
    default = queries.sparkSession.range(1).select(F.lit("default").alias("browser"), F.lit(1 << 30).alias("position"))
    known = browsers.select("browser", F.col("position").cast("int").alias("position")).unionByName(default)
    order = F.row_number().over(Window.orderBy((F.col("browser") != F.lit(preferred)).cast("int") if preferred else F.lit(0), "position"))  # a machine's browsers
    ranked = known.select("browser", order.cast("long").alias("n"), F.when((order == 1) & (F.col("browser") != "default"), first).otherwise(other).alias("score"))
    few = browsers.count() < MAX_RESULTS  # a machine has a handful; each query gets a row for each
    rows = queries.join(F.broadcast(ranked) if few else ranked)
    return rows.select("query_id", T.web_id(F.lit("websearch" if search else "url"), F.col("browser"), F.col("value")).alias("id"), "score", F.col("n").alias("place"))


def merged(hits: DataFrame, files: DataFrame, queries: DataFrame, browsers: DataFrame, preferred: str | None = None, k: int = MAX_RESULTS) -> DataFrame:
    """``(query_id, place, id, score)``: addresses, files, search hits, and a web search.

    Blocks ``(query_id, id, score, place)``. A query that is an address opens with it in each browser;
    else a search stands at the fifth place where there are hits, or takes the list where there are
    none. Files come before hits, and no search is put between them; direct paths get none either.
    """
    asked = queries.select("query_id", F.trim("text").alias("value"), T.normalize_url(F.col("text")).alias("url"), T.direct_path(F.col("text")).alias("direct"))
    urls = browser_rows(asked.where("url is not null").select("query_id", F.col("url").alias("value")), browsers, preferred, False)
    cols = ["query_id", "id", "score", "place"]
    shown = in_blocks([urls.select(*cols), files.select(*cols), hits.select(*cols)], k)
    plain = asked.where("url is null and direct is null and value <> ''").join(files.select("query_id").distinct(), "query_id", "left_anti")
    search = browser_rows(plain.select("query_id", "value"), browsers, preferred, True)
    some = shown.select("query_id").distinct()
    primary = search.where("place = 1").join(some, "query_id", "left_semi").select(*cols)
    alone = search.join(some, "query_id", "left_anti").select(*cols)
    return at_slot(shown, primary).unionByName(alone).select("query_id", F.col("place").cast("int").alias("place"), "id", F.col("score").cast("int").alias("score"))


def window_rows(windows: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, id, title)``: open windows (``windows(id, title)``, one machine's) whose title holds the
    query, case ignored; an empty query shows all, windows without a title are never shown."""
    shown = windows.where("trim(title) <> ''").select("id", "title")
    asked = queries.select("query_id", F.lower(F.trim(F.coalesce("text", F.lit("")))).alias("_q"))
    return asked.join(F.broadcast(shown) if shown.count() <= MAX_RESULTS else shown, F.contains(F.lower("title"), F.col("_q"))).select("query_id", "id", "title")


def system_entry_score(q: Column, name: Column, keywords: Column, reading: Column, initials: Column, page: bool = False) -> Column:
    """How a tool's or a settings page's entry meets a query: name, a word's start (also the other way
    round: the query holds the name), reading, initials, keyword; null for none."""
    low = F.lower(name)
    ascii_only = F.rlike(q, F.lit("^[\\x00-\\x7f]*$"))

    def meets(text: Column) -> Column:
        words = F.filter(F.split(text, "[^A-Za-z0-9]"), lambda w: w != "")
        return (text == q) | F.contains(q, text) | F.when(ascii_only, F.exists(words, lambda w: F.startswith(w, q))).otherwise(F.contains(text, q))

    begins = (lambda x: (x != "") & (x == q)) if page else (lambda x: (x != "") & F.startswith(x, q))
    return F.when(low == q, 900).when(meets(low), 860).when((reading != "") & F.startswith(reading, q), 840).when(begins(initials), 830).when(F.exists(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: meets(F.lower(k))), 820)


def explained(hits: DataFrame) -> DataFrame:
    """What a diagnosis shows of verified hits: tags apart, evidence by name."""
    tags = F.split("tag", r"\\+")
    fields, kinds = F.array(*map(F.lit, ("name", "display", "alias", "reading", "keyword", "context"))), F.array(*map(F.lit, ("exact", "prefix", "contiguous", "acronym", "skip", "fuzzy")))
    return hits.select("query_id", "id", "score", "tier", F.get(tags, F.lit(0)).alias("matched_by"), F.slice(tags, 2, 9).alias("adjusted_by"), F.get(fields, F.col("field")).alias("field"), F.get(kinds, F.col("kind")).alias("kind"), "start", "gaps", "edits", "span")
