"""Queries of what is kept between batches: the stored index, base hits, trees, alignments, feeds.

They share the registry and the tables of ``catalog_queries``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seekstone.functions import providers as V
from seekstone.operators import catalog as C, files, index as I, preferences as P, ranking, search as S
from seekstone.operators.ordered import numbered
from seekstone.plans.catalog_queries import DOCS, GROUPS, PLACE, RANKED, ROWS, SCORED, TABLE_OF_BATCH, VIEWED, batch, catalog_rows, changed_hosts, parts, query
from seekstone.shared import new_folder
from seekstone.sources.tables import table
from seekstone.streaming import feed, overlay


def updated_index(spark, sf_dir):
    """An index of an older catalog, brought to the present one by an update: of every fifty parts one had
    another name, one was not there, and one stood there twice."""
    now = parts(spark, sf_dir)
    old = now.where("id % 50 <> 8").withColumn("name", F.when(F.col("id") % 50 == 7, F.reverse("name")).otherwise(F.col("name")))
    extra = now.where("id % 50 = 9").withColumn("id", -F.col("id"))
    first = I.build(old.unionByName(extra), new_folder(spark, "index"))
    return I.update(first, now.where("id % 50 in (7, 8)"), extra.select("id"))


@query(f"SELECT query_id, rank, id, name, score, tag, tier FROM ({RANKED}) WHERE rank <= 10")
def search_stored_index(spark, sf_dir):
    """The batch of searches read from a stored index after an update."""
    return I.search(updated_index(spark, sf_dir), batch(spark), fuzzy=False)


@query(f"""WITH h AS (SELECT query_id, id, tier, score + CASE WHEN id % 11 = 3 THEN 180 ELSE 0 END - CASE WHEN id % 13 = 5 AND tier > 2 THEN 180 ELSE 0 END AS score FROM ({RANKED}) WHERE id % 7 <> 2)
SELECT query_id, rank, id, score::INTEGER AS score, tier FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier <= 2 DESC, CASE WHEN tier <= 2 THEN tier ELSE 99 END, score DESC, tier, id)::INTEGER AS rank FROM h) WHERE rank <= 10""")
def search_kept_hits(spark, sf_dir):
    """Lists under changed preferences from base hits that an earlier batch has stored."""
    index = updated_index(spark, sf_dir)
    I.kept_hits(index, batch(spark), fuzzy=False)
    hits = I.kept_hits(index, batch(spark), fuzzy=False).withColumns({"query": F.col("query_id"), "item_id": F.col("id"), "boost": F.lit(0)})
    items = lambda condition: parts(spark, sf_dir).where(condition).select(F.col("id").alias("item_id"))
    lifted = P.personalize(hits, items("id % 11 = 3"), items("id % 13 = 5"), items("id % 7 = 2"))
    return P.rerank(lifted, 10).select("query_id", "rank", "id", "score", "tier")


# --- feeds ---------------------------------------------------------------------------------------


@query(VIEWED)
def stream_feed(spark, sf_dir):
    """The same changes through a feed of rotating segments, in two runs of the reader, shown once every
    volume has reached its target."""
    base, frames = changed_hosts(spark, sf_dir)
    source, home = new_folder(spark, "feed"), new_folder(spark, "overlay")
    frames = frames.select(*(c.split()[0] for c in feed.FRAME.replace("array<struct<volume:string,usn:bigint>>", "x").split(", ")))
    half = frames.where("kind = 'round_commit' and round = 2").agg(F.max("seq")).first()[0]
    targets = frames.select(F.explode("cursors").alias("c")).groupBy("c.volume").agg(F.max("c.usn").alias("usn"))
    overlay.freeze(targets, home)
    for piece in (frames.where(F.col("seq") <= half), frames.where(F.col("seq") > half)):
        feed.write_feed(piece, source, segment_bytes=64 << 10)
        overlay.follow(base, source, home, from_feed=True)
    return overlay.present(base, home, source, timeout=3600).where("not is_dir").select("frn", "path")


# --- trees ---------------------------------------------------------------------------------------

CHAIN = "SELECT o_orderkey AS frn, (row_number() OVER (ORDER BY o_orderkey) - 1) AS k FROM orders"


@query(f"""WITH n AS (SELECT frn, k, lag(frn) OVER (ORDER BY k) AS parent FROM ({CHAIN}) QUALIFY true),
t AS (SELECT frn, k, k % 1000 AS depth FROM n)
SELECT frn, (depth + 1)::BIGINT AS depth, repeat('d\\', depth) || 'd' AS path FROM t""")
def deep_tree_paths(spark, sf_dir):
    """Paths in chains of a thousand folders each."""
    chain = numbered(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frn")), ["frn"], "n").select("frn", (F.col("n") - 1).alias("k"))
    above = chain.select(F.col("frn").alias("parent_frn"), (F.col("k") + 1).alias("k"))
    nodes = chain.join(above, "k", "left").select("frn", F.when(F.col("k") % 1000 != 0, F.col("parent_frn")).alias("parent_frn"), F.lit("d").alias("name"))
    return files.tree_paths(nodes).select("frn", F.size(F.split("path", r"\\")).cast("bigint").alias("depth"), "path")


# --- alignments ----------------------------------------------------------------------------------

SCATTERED = ("rdwg", "slt", "bgr", "ngr", "wx")
SCATTERED_TABLE = "(VALUES " + ", ".join(f"({k}, '{q}')" for k, q in enumerate(SCATTERED)) + ") AS b(query_id, q)"


@query(f"""WITH RECURSIVE d AS (SELECT DISTINCT norm FROM ({DOCS})),
w AS (SELECT query_id, norm, q, 1 AS i, j, 16 + CASE WHEN j = 1 OR norm[j - 1] = ' ' THEN 8 ELSE 0 END AS s
  FROM (SELECT query_id, norm, q, unnest(range(1, length(norm) + 1)) AS j FROM d, {SCATTERED_TABLE}) WHERE norm[j] = q[1]
  UNION ALL
  SELECT query_id, norm, q, i + 1, n, s + 16 + CASE WHEN norm[n - 1] = ' ' THEN 8 ELSE 0 END + CASE WHEN n = j + 1 THEN 4 ELSE j - n - 1 END
  FROM (SELECT *, unnest(range(j + 1, length(norm) + 1)) AS n FROM w WHERE i < length(q)) WHERE norm[n] = q[i + 1]),
b AS (SELECT query_id, norm, greatest(0, least(200, max(200 * s // (20 * length(q) + 4)))) AS x FROM w WHERE i = length(q) GROUP BY query_id, norm, q)
SELECT query_id, id, (100 + x)::INTEGER AS score FROM b JOIN ({DOCS}) USING (norm)""")
def scattered_scores(spark, sf_dir):
    """Names that hold a query's characters in order, scored by the best way."""
    texts, rows = S.by_text(parts(spark, sf_dir))
    met = S.spread(S.candidates_of(texts, S.parse(batch(spark, SCATTERED)), fuzzy=False, scattered=True))
    scored = met.select("query_id", "text_id", (F.expr(S.subsequence("norm")) + S.SCATTERED).alias("score")).where("score is not null")
    return S.of_rows(scored, rows.select("text_id", "id")).select("query_id", "id", "score")


#: Readings of four characters, which stand for the first words of the parts' names in a mixed catalog.
CHARS = {"\u5fae": "wei", "\u4fe1": "xin", "\u652f": "zhi", "\u4ed8": "fu"}
MIXED = ("\u5faexin", "\u5fae", "xin \u652f", "\u652ffu", "\u5faeb", "b\u4ed8", "\u4ed8wei", "\u5fae\u4fe1wid")


def mixed_catalog(spark, sf_dir):
    """The parts with two of the characters before their names, by their number, and the characters' readings."""
    chars = F.array(*map(F.lit, CHARS))
    name = F.concat(F.get(chars, (F.col("id") % 4).cast("int")), F.get(chars, (F.col("id") % 3).cast("int")), F.when(F.col("id") % 2 == 0, " ").otherwise(""), F.col("name"))
    known = spark.createDataFrame([(c, [r]) for c, r in CHARS.items()], "ch string, readings array<string>")
    return parts(spark, sf_dir).withColumn("name", name), known


CHAR_LIST = "[" + ", ".join(f"'{c}'" for c in CHARS) + "]"
READ_LIST = "[" + ", ".join(f"'{r}'" for r in CHARS.values()) + "]"
RUNS = "regexp_extract_all(q, '[\u4e00-\u9fff]+|[a-z0-9]+')"
MIXED_TABLE = "(VALUES " + ", ".join(f"({k}, '{q}')" for k, q in enumerate(MIXED)) + ") AS b(query_id, q)"


@query(f"""WITH d AS (SELECT p_partkey AS id, lower({CHAR_LIST}[p_partkey % 4 + 1] || {CHAR_LIST}[p_partkey % 3 + 1] || CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE '' END || p_name) AS norm,
  {READ_LIST}[p_partkey % 4 + 1] || {READ_LIST}[p_partkey % 3 + 1] || replace(lower(p_name), ' ', '') AS reading FROM part),
r AS (SELECT query_id, id, norm, reading, {RUNS}[1] AS a, {RUNS}[2] AS z FROM d, {MIXED_TABLE} WHERE len({RUNS}) = 2),
-- a first run in the text, or a Latin one in the reading (then the place in the text is its end); the second run behind it
f AS (SELECT *, CASE WHEN instr(norm, a) > 0 THEN instr(norm, a) - 1 + length(a) WHEN regexp_matches(a, '^[a-z]') AND instr(reading, a) > 0 THEN length(norm) END AS upto,
  CASE WHEN instr(norm, a) > 0 THEN 0 WHEN regexp_matches(a, '^[a-z]') AND instr(reading, a) > 0 THEN instr(reading, a) - 1 + length(a) END AS read FROM r),
o AS (SELECT *, upto IS NOT NULL AND (instr(substr(norm, upto + 1), z) > 0 OR (regexp_matches(z, '^[a-z]') AND instr(substr(reading, read + 1), z) > 0)) AS ordered,
  (contains(norm, a) OR (regexp_matches(a, '^[a-z]') AND contains(reading, a))) AND (contains(norm, z) OR (regexp_matches(z, '^[a-z]') AND contains(reading, z))) AS there FROM f)
SELECT query_id, id, CASE WHEN ordered THEN 850 ELSE 680 END::INTEGER AS score, CASE WHEN ordered THEN 'mixed-ordered' ELSE 'mixed-loose' END AS tag
FROM o WHERE (ordered OR there) AND NOT contains(norm, a || z)""")
def mixed_script_hits(spark, sf_dir):
    """Hits of queries of characters and letters that no name holds as they stand."""
    catalog, known = mixed_catalog(spark, sf_dir)
    hits = S.hits(catalog, S.parse(batch(spark, MIXED)), fuzzy=False, known=known)
    return hits.where("size(q_parts) = 2 and not contains(norm, q)").select("query_id", "id", "score", "tag")


# --- providers -----------------------------------------------------------------------------------


def words_of(text: str) -> list[dict]:
    return [{"id": k, "title": w, "priority": len(w)} for k, w in enumerate(text.split(" "))]


def size_of(text: str) -> dict:
    return {"blocks": [{"type": "value", "value": str(len(text))}]}


ASKED = "SELECT p_partkey AS query_id, p_name, p_partkey % 3 AS kind FROM part"


@query(f"""WITH w AS (SELECT query_id, unnest(string_split(p_name, ' ')) AS title, unnest(range(len(string_split(p_name, ' ')))) AS k FROM ({ASKED}) WHERE kind = 0),
l AS (SELECT query_id, 'plugin:text.tools:words:' || k AS id, title, (900 + least(length(title), 100))::INTEGER AS score FROM w)
SELECT query_id, id, title, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS place FROM l
UNION ALL SELECT query_id, 'panel', length(p_name)::VARCHAR, 0, 0 FROM ({ASKED}) WHERE kind = 1""")
def provider_answers(spark, sf_dir):
    """Parts' names as queries: a third asks a list provider, a third a panel provider, a third none."""
    some = V.install(V.Installed(spark), {"schema_version": 1, "api_version": 1, "id": "text.tools", "entry": "bin/tools"}, [V.Provider("words", "list", words_of, (("keyword", "words"),)), V.Provider("size", "panel", size_of, (("prefix", "#"),))])
    start = F.when(F.col("id") % 3 == 0, "words ").when(F.col("id") % 3 == 1, "#").otherwise("")
    lists, panels, _ = V.answers(some, parts(spark, sf_dir).select(F.col("id").alias("query_id"), F.concat(start, "name").alias("text")))
    shown = panels.select("query_id", F.lit("panel").alias("id"), F.col("panel.blocks")[0]["value"].alias("title"), F.lit(0).alias("score"), F.lit(0).alias("place"))
    return lists.select("query_id", "id", "title", "score", "place").unionByName(shown)


# --- all fields of a row, and whole lists ----------------------------------------------------------

FIELD_QUERIES = ("economy", "eco", "conom", "toolkit", "tool", "ool k", "steel", "madeof", "ste", "st", "xx", "yy", "widget", "e")
FIELD_TABLE = "(VALUES " + ", ".join(f"({k}, '{q}')" for k, q in enumerate(FIELD_QUERIES)) + ") AS b(query_id, q)"


@query(f"""WITH d AS MATERIALIZED (SELECT p_partkey AS id, lower(p_name) AS norm, lower(p_name) || ' ' || lower(p_type) AS display,
  CASE WHEN p_partkey % 3 = 0 THEN [lower(p_type), 'tool kit'] ELSE [lower(p_type)] END AS kw FROM part),
-- a text, what it gives as a whole, at its start and inside, the least lengths, and whether spaces count
t AS (SELECT id, norm AS x, 1000 AS w, 800 AS s, 550 AS i, 1 AS lw, 1 AS l, true AS spaced FROM d
  UNION ALL SELECT id, display, 1000, 800, 550, 1, 1, true FROM d
  UNION ALL SELECT id, unnest(list_distinct(string_split(norm || ' ' || display || ' ' || array_to_string(kw, ' '), ' '))), 850, 720, 0, 1, 2, true FROM d
  UNION ALL SELECT id, unnest(kw), 850, 720, 510, 1, 1, true FROM d
  UNION ALL SELECT id, unnest(['made of steel']), 690, 560, 390, 2, 2, true FROM d
  UNION ALL SELECT id, unnest(['made of steel', 'made', 'of', 'steel']), 690, 560, 0, 2, 2, true FROM d
  UNION ALL SELECT id, replace(norm, ' ', ''), 920, 780, 780, 2, 3, false FROM d
  UNION ALL SELECT id, replace(display, ' ', ''), 920, 780, 780, 2, 3, false FROM d
  UNION ALL SELECT id, replace(unnest(kw), ' ', ''), 850, 720, 720, 2, 3, false FROM d
  UNION ALL SELECT id, 'madeofsteel', 700, 560, 560, 2, 3, false FROM d),
m AS (SELECT query_id, id, w, s, i, lw, l, x, CASE WHEN spaced THEN q ELSE replace(q, ' ', '') END AS y FROM t, {FIELD_TABLE}),
h AS (SELECT query_id, id, CASE WHEN x = y THEN CASE WHEN length(y) >= lw THEN w END WHEN length(y) < l THEN NULL WHEN starts_with(x, y) THEN s WHEN contains(x, y) THEN nullif(i, 0) END AS score FROM m
  UNION ALL SELECT query_id, id, 1100 FROM d, {FIELD_TABLE} WHERE q = 'xx' AND contains(norm, 'bolt')
  UNION ALL SELECT query_id, id, 950 FROM d, {FIELD_TABLE} WHERE q = 'yy' AND contains(norm, 'rod')
  UNION ALL SELECT query_id, id, 1100 FROM d, {FIELD_TABLE} WHERE q = 'yy' AND id = 7)
SELECT query_id, id, max(score)::INTEGER AS score FROM h WHERE score IS NOT NULL GROUP BY query_id, id""")
def search_fields(spark, sf_dir):
    """Scores by name, display name, keywords, context and aliases."""
    part = table(spark, sf_dir, "part")
    kind = F.lower("p_type")
    rows = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat("p_name", F.lit(" "), kind).alias("display_name"), F.when(F.col("p_partkey") % 3 == 0, F.array(kind, F.lit("tool kit"))).otherwise(F.array(kind)).alias("search_keywords"), F.array(F.lit("made of steel")).alias("search_context"))
    aliases = spark.createDataFrame([("xx", None, "bolt", False), ("yy", None, "rod", True), ("yy", 7, "", False)], "alias string, target_id long, target_name string, builtin boolean")
    return S.hits(rows, S.parse(batch(spark, FIELD_QUERIES)), fuzzy=False, aliases=aliases).select("query_id", "id", "score")


PLAIN_ROWS = f"SELECT id, p_name AS name, target, args, source FROM ({ROWS}) JOIN part ON p_partkey = id"
PLAIN_SCORED = SCORED.replace("FROM part", f"FROM (SELECT id AS p_partkey, name AS p_name FROM ({PLAIN_ROWS}))")
SHOWN = PLACE.replace("AS rank", "AS place")


@query(f"""WITH g AS MATERIALIZED ({GROUPS.replace(ROWS, PLAIN_ROWS)}), r AS MATERIALIZED ({PLAIN_ROWS}),
rep AS (SELECT group_id, id, name FROM (SELECT group_id, r.id, r.name, row_number() OVER (PARTITION BY group_id ORDER BY CASE source WHEN 'start-menu' THEN 2 WHEN 'desktop' THEN 3 WHEN 'commands' THEN 7 ELSE 100 END, r.id) AS k FROM r JOIN g ON g.id = r.id) WHERE k = 1),
h AS (SELECT s.*, b.q, g.group_id, r.source IN ('commands', 'uninstall') AND tier > 2 AND (tier >= 5 OR length(b.q) <= 2) AS weak FROM ({PLAIN_SCORED}) s JOIN {TABLE_OF_BATCH} ON b.query_id = s.query_id JOIN g ON g.id = s.id JOIN r ON r.id = s.id),
n AS (SELECT query_id, id, name, b, tag, group_id, CASE WHEN weak THEN score - 250 ELSE score END AS score, CASE WHEN weak THEN 9 ELSE tier END AS tier FROM h),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, group_id ORDER BY tier <= 2 DESC, CASE WHEN tier <= 2 THEN tier ELSE 99 END, score DESC, b.start, b.gaps, b.edits, b.span DESC, b.kind, strlen(name), lower(name), id) AS k FROM n) WHERE k = 1),
f AS (SELECT best.query_id, rep.id, rep.name, best.b, score, tier, tag FROM best JOIN rep USING (group_id))
SELECT query_id, place AS rank, id, name, score::INTEGER AS score, tier, tag FROM (SELECT *, {SHOWN} FROM f) WHERE place <= 20""")
def collapsed_lists(spark, sf_dir):
    """Final lists: noise sinks, launch groups collapse to the row that is launched."""
    rows = catalog_rows(spark, sf_dir).drop("name").join(parts(spark, sf_dir), "id")
    hits = S.hits(rows, S.parse(batch(spark)), fuzzy=False)
    none = lambda schema: spark.createDataFrame([], schema)
    ids = none("item_id long")
    chosen, used = none("query string, item_id long, n long, share double, last_used long"), none("item_id long, launches long, last_used long")
    return ranking.finish(hits, rows, C.launch_groups(rows), chosen, used, ids, ids, ids, 0, 20).select("query_id", "rank", "id", "name", "score", "tier", "tag")


# --- other orders, entries of two kinds, counts ----------------------------------------------------


@query(f"""SELECT query_id, id, legacy::INTEGER AS legacy, plain::INTEGER AS plain FROM (SELECT query_id, id,
  row_number() OVER (PARTITION BY query_id ORDER BY tier, score DESC, strlen(name), lower(name), id) AS legacy,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(name), lower(name), id) AS plain FROM ({SCORED})) WHERE legacy <= 10 OR plain <= 10""")
def other_orders(spark, sf_dir):
    """The ten best by tier alone, and by score alone."""
    hits = S.hits(parts(spark, sf_dir), S.parse(batch(spark)), fuzzy=False)
    every = 1 << 30
    ranks = S.rank(S.rank(hits, every, S.tier_order()).withColumnRenamed("rank", "legacy"), every, S.score_order()).withColumnRenamed("rank", "plain")
    return ranks.where("legacy <= 10 or plain <= 10").select("query_id", "id", "legacy", "plain")


@query(f"SELECT id, row_number() OVER (ORDER BY lower(name), source, lower(target), coalesce(args, ''), id)::BIGINT AS place FROM ({ROWS})")
def catalog_order(spark, sf_dir):
    return C.in_output_order(catalog_rows(spark, sf_dir)).select("id", "place")


BOTH = "SELECT p_partkey AS p_partkey, p_name FROM part UNION ALL SELECT -s_suppkey - 1, 'red rod ' || s_suppkey FROM supplier"
BOTH_SCORED = SCORED.replace("FROM part", f"FROM ({BOTH})")


@query(f"SELECT query_id, rank, id, name, score, tag, tier FROM (SELECT *, {PLACE} FROM ({BOTH_SCORED})) WHERE rank <= 10")
def search_with_entries(spark, sf_dir):
    """Parts and another kind of entries in one ranking."""
    key = F.col("s_suppkey")
    entries = table(spark, sf_dir, "supplier").select((-key - 1).alias("id"), F.concat(F.lit("red rod "), key.cast("string")).alias("name"))
    return S.search_all(parts(spark, sf_dir), entries, batch(spark), fuzzy=False)


@query("""WITH e AS (SELECT *, lower(event_type) AS k FROM events),
s AS (SELECT k AS key, max(event_id)::VARCHAR AS value FROM e WHERE event_id % 2 = 0 GROUP BY k)
SELECT coalesce(s.key, n.key) AS key, coalesce(n.value, s.value) AS value FROM s FULL JOIN (SELECT k AS key, arg_max('n' || user_id, event_id) AS value FROM e WHERE event_id % 7 = 0 GROUP BY k) n ON n.key = s.key""")
def saved_settings(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("key", F.lower("event_type"))
    held = events.where("event_id % 2 = 0").groupBy("key").agg(F.max("event_id").cast("string").alias("value"))
    changes = events.where("event_id % 7 = 0").select("key", F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("value"), F.col("event_id").alias("at"))
    return P.save_settings(held, changes)
