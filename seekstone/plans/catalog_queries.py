"""Queries of the catalog search engine by name, with the SQL that gives the same rows.

Parts, suppliers and customers stand in for a catalog of named things, events for the log of what
was chosen, and page addresses for paths. Batches of search strings are literals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seekstone.functions import calculator, routing, text as T
from seekstone.operators import catalog as C, evaluate, files, preferences as P, results, search as S
from seekstone.operators.ordered import numbered
from seekstone.shared import new_folder
from seekstone.sources.tables import table
from seekstone.streaming import changes, overlay

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: A batch of search strings: exact, prefix, inner, of two words, squeezed, initials, reordered.
BATCH = ("red widget", "wid", "ring", "small", "redwidget", "bb", "bolt blue", "blue b", "idge", "zzz")
TYPOS = ("widgte", "rnig", "blot", "smal", "bleu", "gear")
NOW = 1_706_000_000
TABLE_OF_BATCH = "(VALUES " + ", ".join(f"({k}, '{q}')" for k, q in enumerate(BATCH)) + ") AS b(query_id, q)"


def query(sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


def batch(spark: SparkSession, texts: tuple[str, ...] = BATCH) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")


def seconds(df: DataFrame, column: str) -> Column:
    """Seconds since 1970 of a timestamp with or without zone."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")
    return F.unix_seconds(column)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as choices: which item was chosen for which query, and when."""
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_type").alias("query"), F.col("user_id").alias("item_id"), seconds(events, "ts").alias("at"))


LOG = "SELECT event_type AS query, user_id AS item_id, floor(epoch(ts))::BIGINT AS moment FROM events"
USAGE = f"SELECT item_id, count(*) AS launches, max(moment) AS last_used FROM ({LOG}) GROUP BY item_id"
PAIRS = f"SELECT query, item_id, count(*) AS n, max(moment) AS last_used, count(*) / sum(count(*)) OVER (PARTITION BY query) AS share FROM ({LOG}) GROUP BY query, item_id"
NORM = "trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g'))"
DOCS = f"SELECT p_partkey AS id, p_name AS name, {NORM} AS norm, replace({NORM}, ' ', '') AS comp, list_distinct(string_split({NORM}, ' ')) AS words, string_split({NORM}, ' ') AS toks, CASE WHEN len(string_split({NORM}, ' ')) >= 2 THEN array_to_string(list_transform(string_split({NORM}, ' '), lambda t: t[1]), '') ELSE '' END AS acro FROM part"
POSTINGS = f"SELECT DISTINCT id, unnest(words) AS term FROM ({DOCS})"


# --- names -------------------------------------------------------------------------------------


@query(f"SELECT p_partkey AS id, {NORM} AS norm, replace({NORM}, ' ', '') AS comp FROM part")
def normalized_names(spark, sf_dir):
    return S.enrich(parts(spark, sf_dir)).select("id", "norm", "comp")


@query(f"SELECT id, t.pos - 1 AS pos, t.token FROM (SELECT id, unnest(list_transform(toks, lambda x, i: {{'pos': i, 'token': x}})) AS t FROM ({DOCS}))")
def name_tokens(spark, sf_dir):
    return parts(spark, sf_dir).select("id", F.posexplode(T.tokens(T.normalize(F.col("name")))).alias("pos", "token")).select("id", F.col("pos").cast("long").alias("pos"), "token")


@query("SELECT c_custkey AS id, array_to_string(list_transform(list_filter(string_split_regex(c_mktsegment || c_name, '[^A-Za-z0-9]+'), lambda x: x <> ''), lambda x: lower(regexp_replace(x, '([A-Za-z0-9])([A-Z][a-z])', '\\1 \\2', 'g'))), ' ') AS words FROM customer")
def camel_words(spark, sf_dir):
    both = F.concat("c_mktsegment", "c_name")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array_join(T.split_camel(both), " ").alias("words"))


@query(f"SELECT id, acro FROM ({DOCS})")
def acronyms(spark, sf_dir):
    return S.enrich(parts(spark, sf_dir)).select("id", "acro")


@query(f"SELECT term, count(*) AS df, min(id) AS first_id FROM ({POSTINGS}) GROUP BY term")
def term_postings(spark, sf_dir):
    return S.term_postings(S.enrich(parts(spark, sf_dir))).groupBy("term").agg(F.count("*").alias("df"), F.min("id").alias("first_id"))


def gram_sql(n: int) -> str:
    return f"SELECT gram, count(*) AS df, min(id) AS first_id FROM (SELECT DISTINCT id, unnest(list_transform(range(1, length(norm) - {n - 2}), lambda i: substr(norm, i, {n}))) AS gram FROM ({DOCS})) GROUP BY gram"


@query(gram_sql(2))
def bigram_postings(spark, sf_dir):
    return S.gram_postings(S.enrich(parts(spark, sf_dir)), 2).groupBy("gram").agg(F.count("*").alias("df"), F.min("id").alias("first_id"))


@query(gram_sql(3))
def trigram_postings(spark, sf_dir):
    return S.gram_postings(S.enrich(parts(spark, sf_dir)), 3).groupBy("gram").agg(F.count("*").alias("df"), F.min("id").alias("first_id"))


@query(f"SELECT norm[1] AS first, count(*) AS df FROM ({DOCS}) GROUP BY 1")
def first_char_postings(spark, sf_dir):
    return S.first_char_postings(S.enrich(parts(spark, sf_dir))).groupBy("first").agg(F.count("*").alias("df"))


@query(f"SELECT 'term' AS kind, count(DISTINCT term) AS keys, count(*) AS postings FROM ({POSTINGS}) UNION ALL SELECT 'bigram', count(*), sum(df)::BIGINT FROM ({gram_sql(2)}) UNION ALL SELECT 'trigram', count(*), sum(df)::BIGINT FROM ({gram_sql(3)})")
def index_stats(spark, sf_dir):
    docs = S.enrich(parts(spark, sf_dir))
    parts_of = {"term": S.term_postings(docs).withColumnRenamed("term", "key"), "bigram": S.gram_postings(docs, 2).withColumnRenamed("gram", "key"), "trigram": S.gram_postings(docs, 3).withColumnRenamed("gram", "key")}
    whole = None
    for kind, rows in parts_of.items():
        one = rows.groupBy("key").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        whole = one if whole is None else whole.unionByName(one)
    return whole.groupBy("kind").agg(F.count("*").alias("keys"), F.sum("n").alias("postings"))


@query(f"""WITH t AS (SELECT DISTINCT term FROM ({POSTINGS}) WHERE length(term) BETWEEN 2 AND 18),
o AS (SELECT DISTINCT term, unnest(list_transform(range(1, length(term) + 1), lambda i: substr(term, 1, i - 1) || substr(term, i + 1))) AS v FROM t),
w AS (SELECT DISTINCT term, unnest(list_transform(range(1, length(v) + 1), lambda i: substr(v, 1, i - 1) || substr(v, i + 1))) AS v FROM o WHERE length(term) <= 10 AND v <> '')
SELECT term, v AS variant FROM (SELECT * FROM o UNION SELECT * FROM w) WHERE v <> '' AND v <> term""")
def delete_variants(spark, sf_dir):
    terms = S.term_postings(S.enrich(parts(spark, sf_dir))).select("term").distinct()
    return terms.select("term", F.explode(T.delete_variants(F.col("term"))).alias("variant"))


@query("SELECT typo, term FROM (VALUES " + ", ".join(f"('{t}')" for t in TYPOS) + f") AS t(typo), (SELECT DISTINCT term FROM ({POSTINGS})) WHERE damerau_levenshtein(typo, term) = 1")
def one_edit_away(spark, sf_dir):
    terms = S.term_postings(S.enrich(parts(spark, sf_dir))).select("term").distinct()
    typos = batch(spark, TYPOS).select(F.col("text").alias("typo"))
    keys = lambda df, name: df.select(name, F.explode(S.many_edits(F.col(name))).alias("variant"))
    met = keys(terms, "term").join(keys(typos, "typo"), "variant").select("typo", "term").distinct()
    return met.where(T.osa_distance(F.col("typo"), F.col("term")) == 1)


@query(f"SELECT p_partkey AS id, left(sha256(p_brand || chr(0) || p_name || chr(0)), 32) AS hash_id FROM part")
def hash_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.hash_id(F.col("p_brand"), F.col("p_name")).alias("hash_id"))


# --- ranked search -----------------------------------------------------------------------------

TIER = "CASE WHEN score >= 1100 THEN 0 WHEN score >= 1000 THEN 1 WHEN score >= 920 THEN 2 WHEN score >= 850 THEN 3 WHEN score >= 800 THEN 4 WHEN score >= 700 THEN 5 WHEN score >= 680 THEN 6 WHEN score >= 550 THEN 7 WHEN score >= 225 THEN 8 ELSE 9 END"
#: In these names words hold no signs, so words are the parts between spaces.
FIRST = "list_filter(range(1, len(toks) + 1), lambda i: starts_with(toks[i], string_split(q, ' ')[1]) AND len(list_filter(range(i + 1, len(toks) + 1), lambda j: starts_with(toks[j], string_split(q, ' ')[2]))) > 0)[1]"
SECOND = f"list_filter(range({FIRST} + 1, len(toks) + 1), lambda j: starts_with(toks[j], string_split(q, ' ')[2]))[1]"
SPACELESS = "list_filter(range(1, length(norm) + 1), lambda j: norm[j] <> ' ')"
COMPACT_AT = "instr(comp, replace(q, ' ', ''))"


def sql_hit(condition: str, score: int, tag: str, kind: int, start: str = "0", span: str = "length(q)", gaps: str = "0") -> str:
    return f"CASE WHEN {condition} THEN {{'score': {score}, 'start': {start}, 'gaps': {gaps}, 'edits': 0, 'span': {span}, 'kind': {kind}, 'tag': '{tag}'}} END"


BRANCHES = f"""SELECT query_id, id, name, norm, toks, q, unnest([
  {sql_hit("norm = q", 1000, "exact", 0, span="2147483647")},
  {sql_hit("norm <> q AND starts_with(norm, q)", 800, "prefix", 1)},
  {sql_hit("NOT starts_with(norm, q) AND contains(norm, q)", 550, "substring", 2, "instr(norm, q) - 1")},
  {sql_hit("strlen(replace(q, ' ', '')) >= 2 AND comp = replace(q, ' ', '')", 920, "compact-exact", 0, span="2147483647")},
  {sql_hit("strlen(replace(q, ' ', '')) >= 3 AND comp <> replace(q, ' ', '') AND contains(comp, replace(q, ' ', ''))", 780, "compact-substring", 2, f"{SPACELESS}[{COMPACT_AT}] - 1", f"{SPACELESS}[{COMPACT_AT} + length(replace(q, ' ', '')) - 1] - {SPACELESS}[{COMPACT_AT}] + 1")},
  {sql_hit("list_contains(words, q)", 850, "word-exact", 0, span="2147483647")},
  {sql_hit("length(q) >= 2 AND len(list_filter(words, lambda w: w <> q AND starts_with(w, q))) > 0", 720, "word-prefix", 1)},
  {sql_hit(f"contains(q, ' ') AND {FIRST} IS NOT NULL", 880, "token-seq", 2, f"length(array_to_string(toks[1:{FIRST} - 1], ' ')) + CASE WHEN {FIRST} > 1 THEN 1 ELSE 0 END", gaps=f"{SECOND} - 2")},
  {sql_hit("length(q) >= 2 AND acro = q", 680, "acronym", 3)}]) AS b
FROM ({DOCS}), {TABLE_OF_BATCH}"""
BEST = "SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY b.score DESC, b.start, b.gaps, b.edits, b.span DESC, b.kind, b.tag DESC) AS k FROM ({0}) WHERE b IS NOT NULL"
SCORED = f"SELECT *, {TIER} AS tier FROM (SELECT query_id, id, name, norm, b, b.score AS score, b.tag AS tag FROM ({BEST.format(BRANCHES)}) WHERE k = 1)"
PLACE = "row_number() OVER (PARTITION BY query_id ORDER BY tier <= 2 DESC, CASE WHEN tier <= 2 THEN tier ELSE 99 END, score DESC, b.start, b.gaps, b.edits, b.span DESC, b.kind, strlen(name), lower(name), id)::INTEGER AS rank"
RANKED = f"SELECT *, {PLACE} FROM ({SCORED})"

#: Skipped characters and edits, looked for where no branch above gives 320 or 400.
TYPO_TABLE = "(VALUES " + ", ".join(f"({k}, '{t}')" for k, t in enumerate(TYPOS)) + ") AS b(query_id, q)"
IN_ORDER = "regexp_extract(substr(norm, i, length(q) + 3), '^' || q[1] || array_to_string(list_transform(range(2, length(q) + 1), lambda j: '[^' || q[j] || ']*' || q[j]), ''))"
EDITS = "CASE WHEN damerau_levenshtein(q, {0}) BETWEEN 1 AND CASE WHEN strlen(q) <= 2 THEN 0 WHEN strlen(q) <= 5 THEN 1 ELSE 2 END THEN damerau_levenshtein(q, {0}) END"
LOOSE = f"""WITH strict AS MATERIALIZED (SELECT query_id, id, name, norm, toks, q, b FROM ({BEST.format(BRANCHES.replace(TABLE_OF_BATCH, TYPO_TABLE))}) WHERE k = 1),
met AS (SELECT d.query_id, d.id, d.name, d.norm, d.toks, d.q, s.b FROM (SELECT query_id, id, name, norm, toks, q FROM ({DOCS}), {TYPO_TABLE}) d LEFT JOIN strict s USING (query_id, id)),
skips AS (SELECT *, CASE WHEN length(q) >= 4 AND (b IS NULL OR b.score < 320) THEN list_min(list_filter(list_transform(range(1, length(norm) + 1), lambda i: length({IN_ORDER}) * 1000 + i), lambda x: x >= 1000)) END AS x FROM met),
with_skips AS (SELECT query_id, id, name, norm, toks, q, CASE WHEN x // 1000 BETWEEN length(q) + 1 AND length(q) + 3 THEN {{'score': (greatest(280, 320 - 8 * (x // 1000 - length(q))))::INTEGER, 'start': (x % 1000 - 1)::INTEGER, 'gaps': (x // 1000 - length(q))::INTEGER, 'edits': 0, 'span': (x // 1000)::INTEGER, 'kind': 4, 'tag': 'skip'}} ELSE b END AS b FROM skips),
near AS (SELECT *, CASE WHEN length(q) >= 3 AND (b IS NULL OR b.score < 400) THEN coalesce({EDITS.format('norm')}, list_min(list_transform(toks, lambda t: {EDITS.format('t')}))) END AS e FROM with_skips),
every AS (SELECT query_id, id, name, norm, CASE WHEN e IS NULL OR b.score >= CASE e WHEN 1 THEN 400 ELSE 280 END THEN b ELSE {{'score': CASE e WHEN 1 THEN 400 ELSE 280 END, 'start': 2147483647, 'gaps': 0, 'edits': e::INTEGER, 'span': (length(q) - e)::INTEGER, 'kind': 5, 'tag': 'fuzzy'}} END AS b FROM near),
tiers AS (SELECT *, {TIER} AS tier FROM (SELECT *, b.score AS score, b.tag AS tag FROM every WHERE b IS NOT NULL))
SELECT query_id, rank, id, name, score, tag, tier FROM (SELECT *, {PLACE} FROM tiers) WHERE rank <= 10"""


@query(f"SELECT query_id, rank, id, name, score, tag, tier FROM ({RANKED}) WHERE rank <= 10")
def search_topk_batch(spark, sf_dir):
    return S.search(parts(spark, sf_dir), batch(spark), fuzzy=False)


@query(f"SELECT query_id, rank, id, name, score, tag, tier FROM ({RANKED}) WHERE rank <= 10")
def search_unpruned(spark, sf_dir):
    return S.search(parts(spark, sf_dir), batch(spark), pruned=False, fuzzy=False)


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows that a branch accepts, found by recall."""
    return S.hits(parts(spark, sf_dir), S.parse(batch(spark)), fuzzy=False)


@query(f"SELECT query_id, tag, tier, count(*) AS hits FROM ({SCORED}) GROUP BY ALL")
def branch_counts(spark, sf_dir):
    return accepted(spark, sf_dir).groupBy("query_id", "tag", "tier").agg(F.count("*").alias("hits"))


@query(LOOSE)
def search_fuzzy(spark, sf_dir):
    return S.search(parts(spark, sf_dir), batch(spark, TYPOS))


@query(f"SELECT query_id, id FROM ({DOCS}), {TABLE_OF_BATCH} WHERE contains(q, ' ') AND len(list_filter(string_split(q, ' '), lambda t: NOT list_contains(words, t))) = 0")
def recall_intersect(spark, sf_dir):
    return S.intersect_tokens(S.enrich(parts(spark, sf_dir)), S.parse(batch(spark)))


@query(f"SELECT prefix, term FROM (SELECT p.prefix, term, row_number() OVER (PARTITION BY p.prefix ORDER BY term) AS k FROM (VALUES ('wi'), ('bl'), ('r'), ('gea')) AS p(prefix), (SELECT DISTINCT term FROM ({POSTINGS})) WHERE length(p.prefix) >= 2 AND starts_with(term, p.prefix)) WHERE k <= 512")
def recall_prefix(spark, sf_dir):
    prefixes = spark.createDataFrame([("wi",), ("bl",), ("r",), ("gea",)], "prefix string")
    return S.prefix_terms(S.term_postings(S.enrich(parts(spark, sf_dir))), prefixes)


@query(f"WITH g AS ({gram_sql(3)}), w AS (SELECT query_id, pos, substr(q, pos, 3) AS gram FROM (SELECT query_id, q, unnest(range(1, length(q) - 1)) AS pos FROM {TABLE_OF_BATCH})) SELECT query_id, gram FROM (SELECT w.query_id, w.gram, row_number() OVER (PARTITION BY query_id ORDER BY df, pos) AS k FROM w JOIN g USING (gram)) WHERE k = 1")
def recall_rarest_gram(spark, sf_dir):
    return S.rarest_gram(S.gram_postings(S.enrich(parts(spark, sf_dir)), 3), S.parse(batch(spark)), 3)


@query(f"SELECT query_id, id FROM ({SCORED})")
def recall_union(spark, sf_dir):
    """Recall loses nothing that a branch accepts: its rows after verification are those of a full scan."""
    return accepted(spark, sf_dir).select("query_id", "id")


# --- preferences -------------------------------------------------------------------------------


@query(USAGE)
def usage_counts(spark, sf_dir):
    return P.usage(log(spark, sf_dir))


@query(PAIRS)
def pair_shares(spark, sf_dir):
    return P.pairs(log(spark, sf_dir))


@query(f"SELECT item_id, last_used FROM ({USAGE}) WHERE last_used > 0 ORDER BY last_used DESC, item_id LIMIT 16")
def recent_items(spark, sf_dir):
    return P.recent(P.usage(log(spark, sf_dir)), 16).select("item_id", "last_used")


FRESH = f"CASE WHEN {NOW} - p.last_used <= 2592000 THEN 1.0 WHEN {NOW} - p.last_used <= 7776000 THEN 0.8 WHEN {NOW} - p.last_used <= 15552000 THEN 0.6 ELSE 0.4 END"
#: Items that were chosen for a query, and others that were never chosen for it.
ASKED = f"SELECT DISTINCT query, item_id FROM ({LOG}) UNION SELECT DISTINCT query, item_id * 3 + 1 FROM ({LOG})"
BOOSTS = f"""SELECT h.query, h.item_id, least(160, CASE WHEN p.n IS NULL THEN 0 ELSE greatest(0, least(round((30 + 14 * ln(p.n)) * share * {FRESH}), CASE WHEN n >= 3 AND share >= 0.7 THEN 110 ELSE 45 END)) END
  + CASE WHEN u.launches IS NULL THEN 0 ELSE least(round(10 + 8 * ln(u.launches)), 45) END
  + CASE WHEN u.last_used IS NULL OR {NOW} - u.last_used <= 0 OR {NOW} - u.last_used >= 604800 THEN 0 WHEN {NOW} - u.last_used < 86400 THEN 40 ELSE round(40 * (604800 - ({NOW} - u.last_used)) / 518400.0) END)::INTEGER AS boost
FROM ({ASKED}) h LEFT JOIN ({PAIRS}) p USING (query, item_id) LEFT JOIN ({USAGE}) u ON u.item_id = h.item_id"""


def asked(rows: DataFrame) -> DataFrame:
    chosen = rows.select("query", "item_id")
    return chosen.unionByName(chosen.select("query", (F.col("item_id") * 3 + 1).alias("item_id"))).distinct()


@query(BOOSTS)
def history_boost(spark, sf_dir):
    rows = log(spark, sf_dir)
    return P.with_boosts(asked(rows), P.pairs(rows), P.usage(rows), NOW)


def preferences_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    rows = log(spark, sf_dir)
    hits = asked(rows).withColumn("score", (F.lit(400) + F.pmod(F.col("item_id") * 37, F.lit(700))).cast("int"))
    items = lambda sql: asked(rows).where(sql).select("item_id").distinct()
    return rows, hits.withColumn("tier", S.quality_tier(F.col("score"))), items("item_id % 11 = 3"), items("item_id % 7 = 2"), items("item_id % 13 = 5")


HITS = f"SELECT *, {TIER} AS tier FROM (SELECT query, item_id, (400 + item_id * 37 % 700)::INTEGER AS score FROM ({ASKED}))"
PERSONAL = f"""SELECT query, item_id, tier, (score + CASE WHEN item_id % 11 = 3 THEN greatest(180, boost) ELSE boost END - CASE WHEN item_id % 7 = 2 AND tier > 2 THEN 180 ELSE 0 END)::INTEGER AS score,
  CASE WHEN item_id % 11 = 3 THEN '+pin' WHEN item_id % 7 = 2 AND tier > 2 THEN '+demote' WHEN boost > 0 THEN '+history' ELSE '' END AS why
FROM ({HITS}) JOIN ({BOOSTS}) USING (query, item_id) WHERE item_id % 13 <> 5"""


@query(f"SELECT query, rank, item_id, score, why FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier <= 2 DESC, CASE WHEN tier <= 2 THEN tier ELSE 99 END, score DESC, tier, item_id)::INTEGER AS rank FROM ({PERSONAL})) WHERE rank <= 10")
def personalized_rank(spark, sf_dir):
    rows, hits, pinned, demoted, hidden = preferences_of(spark, sf_dir)
    hits = P.with_boosts(hits, P.pairs(rows), P.usage(rows), NOW)
    return P.rerank(P.personalize(hits, pinned, demoted, hidden), 10).select("query", "rank", "item_id", "score", "why")


@query(f"SELECT coalesce(m.new_id, u.item_id) AS item_id, sum(launches)::BIGINT AS launches, max(last_used) AS last_used FROM ({USAGE}) u LEFT JOIN (SELECT DISTINCT item_id AS old_id, item_id // 2 AS new_id FROM ({USAGE}) WHERE item_id % 2 = 1) m ON m.old_id = u.item_id GROUP BY 1")
def id_remap(spark, sf_dir):
    used = P.usage(log(spark, sf_dir))
    return P.remap(used, used.where("item_id % 2 = 1").select(F.col("item_id").alias("old_id"), F.expr("item_id div 2").alias("new_id")))


@query(f"""SELECT item_id, section FROM (SELECT item_id, section, place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY section, place) AS k FROM (
  SELECT item_id, 0 AS section, -launches AS place FROM ({USAGE}) WHERE item_id % 11 = 3 UNION ALL SELECT item_id, 1, -last_used FROM ({USAGE}) UNION ALL SELECT c_custkey, 2, 0 FROM customer))
  WHERE k = 1 AND item_id % 13 <> 5 AND item_id IN (SELECT c_custkey FROM customer)) ORDER BY section, place, item_id LIMIT 40""")
def empty_query_sections(spark, sf_dir):
    used = P.usage(log(spark, sf_dir))
    items = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id"))
    pinned = used.where("item_id % 11 = 3").select("item_id", F.col("launches").alias("pinned_at"))
    hidden = items.where("item_id % 13 = 5")
    return P.empty_query_sections(items, used, pinned, hidden, 40).select("item_id", "section")


# --- catalog building --------------------------------------------------------------------------

SOURCES = "CASE p_partkey % 4 WHEN 0 THEN 'start-menu' WHEN 1 THEN 'desktop' WHEN 2 THEN 'commands' ELSE 'uninstall' END"
ROWS = f"SELECT p_partkey AS id, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' (x64)' ELSE '' END AS name, 'C:\\' || p_type || '\\' || (p_partkey % 97) || '.exe' AS target, CASE WHEN p_partkey % 2 = 0 THEN ' -v ' END AS args, {SOURCES} AS source FROM part"
RANK = "CASE source WHEN 'start-menu' THEN 1 WHEN 'desktop' THEN 2 WHEN 'uninstall' THEN 4 WHEN 'commands' THEN 7 END"
LAUNCHED = "lower(target) || chr(31) || trim(coalesce(args, ''))"


def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    source = F.when(k % 4 == 0, "start-menu").when(k % 4 == 1, "desktop").when(k % 4 == 2, "commands").otherwise("uninstall")
    return table(spark, sf_dir, "part").select(
        k.alias("id"),
        F.concat("p_name", F.when(k % 3 == 0, " (x64)").otherwise("")).alias("name"),
        F.concat(F.lit("C:\\"), "p_type", F.lit("\\"), (k % 97).cast("string"), F.lit(".exe")).alias("target"),
        F.when(k % 2 == 0, " -v ").alias("args"),
        source.alias("source"),
    )


@query(f"""WITH r AS (SELECT *, {LAUNCHED} AS key, row_number() OVER (PARTITION BY {LAUNCHED} ORDER BY {RANK}, lower(target), coalesce(args, ''), name, id) AS k FROM ({ROWS})),
n AS (SELECT key, list(name ORDER BY k) AS names FROM r GROUP BY key)
SELECT id, name, target, source, array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i AND lower(x) <> lower(name)), '|') AS keywords FROM r JOIN n USING (key) WHERE k = 1""")
def dedupe_best_source(spark, sf_dir):
    return C.dedupe(catalog_rows(spark, sf_dir)).select("id", "name", "target", "source", F.array_join("keywords", "|").alias("keywords"))


ALL_SOURCES = "start-menu desktop uwp apps-folder portable manual builtin builtin-system win-settings app-paths uninstall commands scoop protocols test".split()
LAYER_TABLE = "(VALUES ('start-menu', 'Formal', 1), ('desktop', 'Formal', 1), ('uwp', 'Formal', 1), ('apps-folder', 'Formal', 1), ('portable', 'Formal', 1), ('manual', 'Formal', 1), ('builtin', 'System', 0), ('builtin-system', 'System', 0), ('win-settings', 'System', 0), ('app-paths', 'Supplemental', 1), ('uninstall', 'Supplemental', 1), ('commands', 'CommandAlias', 1), ('scoop', 'CommandAlias', 1), ('protocols', 'Supplemental', 1), ('test', 'Supplemental', 0)) AS t(source, layer, hideable)"


@query(f"WITH t AS (SELECT *, row_number() OVER () - 1 AS k FROM {LAYER_TABLE}) SELECT source, layer, hideable = 1 AS hideable, count(*) AS n FROM part JOIN t ON t.k = p_partkey % 15 GROUP BY ALL")
def source_layers(spark, sf_dir):
    source = F.get(F.array(*map(F.lit, ALL_SOURCES)), (F.col("p_partkey") % 15).cast("int"))
    rows = table(spark, sf_dir, "part").select(source.alias("source"))
    return rows.groupBy("source", C.layer(F.col("source")).alias("layer"), F.col("source").isin(*C.HIDEABLE).alias("hideable")).agg(F.count("*").alias("n"))


FAMILY = "trim(regexp_replace(lower(name), '\\s*\\([^)]*\\)$', ''))"
ROOT = "lower(regexp_replace(target, '\\\\[^\\\\]*$', ''))"
GROUP_KEYS = f"""SELECT id, 'l' || {LAUNCHED} AS key FROM ({ROWS}) UNION ALL
SELECT id, key FROM (SELECT id, 'r' || {ROOT} || chr(31) || {FAMILY} AS key, min(lower(target)) OVER (PARTITION BY {ROOT}, {FAMILY}) AS p, max(lower(target)) OVER (PARTITION BY {ROOT}, {FAMILY}) AS q FROM ({ROWS})) WHERE p <> q"""
GROUPS = f"""WITH RECURSIVE k AS MATERIALIZED ({GROUP_KEYS}), h AS MATERIALIZED (SELECT k.id, m.head FROM k JOIN (SELECT key, min(id) AS head FROM k GROUP BY key) m USING (key) WHERE k.id <> m.head),
e AS MATERIALIZED (SELECT id AS a, head AS b FROM h UNION SELECT head, id FROM h), g(id, root) AS (SELECT id, id FROM ({ROWS}) UNION SELECT e.a, g.root FROM g JOIN e ON e.b = g.id WHERE g.root < e.a)
SELECT id, min(root) AS group_id FROM g GROUP BY id"""


@query(GROUPS)
def launch_groups(spark, sf_dir):
    return C.launch_groups(catalog_rows(spark, sf_dir))


@query(f"WITH g AS ({GROUPS}) SELECT group_id, id FROM (SELECT group_id, r.id, row_number() OVER (PARTITION BY group_id ORDER BY CASE source WHEN 'start-menu' THEN 2 WHEN 'desktop' THEN 3 WHEN 'commands' THEN 7 ELSE 100 END, r.id) AS k FROM ({ROWS}) r JOIN g ON g.id = r.id) WHERE k = 1")
def group_representatives(spark, sf_dir):
    rows = catalog_rows(spark, sf_dir)
    return C.representatives(rows, C.launch_groups(rows))


@query(f"""WITH r AS (SELECT *, {LAUNCHED} AS launch, lower(target) AS path, {ROOT} AS root, {FAMILY} AS family, trim(coalesce(args, '')) AS a FROM ({ROWS})),
m AS (SELECT d.id AS loser, min(h.id) AS winner FROM r d JOIN r h ON d.source = 'uninstall' AND h.source IN ('start-menu', 'desktop') AND d.a = h.a AND (d.launch = h.launch OR d.root = h.root AND d.family = h.family) GROUP BY d.id),
n AS (SELECT winner, list(d.name ORDER BY loser) AS names FROM m JOIN r d ON d.id = m.loser GROUP BY winner)
SELECT r.id, array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i AND lower(x) <> lower(r.name)), '|') AS keywords FROM r JOIN n ON n.winner = r.id""")
def discovery_absorb(spark, sf_dir):
    rows = catalog_rows(spark, sf_dir)
    pairs = C.absorb_pairs(rows)
    hosts = C.absorbed(rows, pairs).join(pairs.select(F.col("winner").alias("id")).distinct(), "id", "left_semi")
    return hosts.select("id", F.array_join("search_keywords", "|").alias("keywords"))


@query(f"SELECT id FROM ({ROWS}) c WHERE source <> 'commands' OR NOT EXISTS (SELECT 1 FROM ({ROWS}) o WHERE o.source <> 'commands' AND replace(lower(o.name), ' ', '') = replace(lower(c.name), ' ', ''))")
def command_merge(spark, sf_dir):
    rows = catalog_rows(spark, sf_dir)
    return C.merge_commands(rows).select("id")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN true WHEN c_custkey % 5 = 1 THEN false WHEN c_custkey % 5 = 2 THEN false WHEN c_custkey % 5 = 3 THEN true ELSE false END AS helper, c_custkey % 5 IN (2, 4) AS command, c_custkey % 5 = 3 AS skippable FROM customer")
def name_filters(spark, sf_dir):
    """Helpers, commands and shortcuts that start no program, by name."""
    k = F.col("c_custkey") % 5
    name = F.when(k == 0, F.concat(F.lit("Crash-Pad "), F.col("c_custkey").cast("string"))).when(k == 1, F.concat(F.lit("a very long command name "), F.col("c_custkey").cast("string"))).when(k == 2, F.concat(F.lit("tool-x64 "), F.col("c_custkey").cast("string"))).when(k == 3, "Setup guide").otherwise(F.concat(F.lit("git"), F.col("c_custkey").cast("string")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), C.is_helper(name).alias("helper"), C.is_command(name).alias("command"), C.is_skippable(name).alias("skippable"))


@query("SELECT p_partkey AS id, 'c:\\program files\\' || lower(p_brand) AS root, left(sha256('c:\\program files\\' || lower(p_brand) || '\\' || CASE p_partkey % 3 WHEN 0 THEN 'bin\\' WHEN 1 THEN '1.2.3\\x64\\' ELSE '' END || 'app.exe' || chr(0) || '-v' || chr(0)), 32) AS item_id FROM part")
def install_roots(spark, sf_dir):
    inner = F.when(F.col("p_partkey") % 3 == 0, "bin/").when(F.col("p_partkey") % 3 == 1, "1.2.3\\x64\\").otherwise("")
    target = F.concat(F.lit("C:\\Program Files\\"), "p_brand", F.lit("\\"), inner, F.lit("App.exe"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.install_root(target).alias("root"), T.stable_item_id(target, F.lit("-v")).alias("item_id"))


# --- paths and addresses -----------------------------------------------------------------------

PATHS = "SELECT page_id AS frn, replace(regexp_replace(url, '^[a-z]+://', ''), '/', '\\') || CASE page_id % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.PDF' WHEN 2 THEN '.mp3' WHEN 3 THEN '' ELSE '.zip' END AS path, page_id % 10 = 3 AS is_dir FROM pages"
BASE = "regexp_extract(path, '[^\\\\]*$')"


def path_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    end = F.when(k % 5 == 0, ".png").when(k % 5 == 1, ".PDF").when(k % 5 == 2, ".mp3").when(k % 5 == 3, "").otherwise(".zip")
    path = F.translate(F.regexp_replace("url", "^[a-z]+://", ""), "/", "\\")
    return table(spark, sf_dir, "pages").select(k.alias("frn"), F.concat(path, end).alias("path"), (k % 10 == 3).alias("is_dir"))


@query(f"SELECT kind, frn FROM (SELECT frn, is_dir, CASE WHEN contains({BASE}, '.') THEN lower(string_split({BASE}, '.')[-1]) ELSE '' END AS x FROM ({PATHS})), (VALUES ('images', 'png'), ('documents', 'pdf'), ('audio', 'mp3'), ('archives', 'zip')) AS t(kind, e) WHERE x = e AND NOT is_dir UNION ALL SELECT 'folders', frn FROM ({PATHS}) WHERE is_dir")
def file_types(spark, sf_dir):
    rows = path_rows(spark, sf_dir)
    kinds = ("images", "documents", "audio", "archives", "folders")
    held = F.array_compact(F.array(*(F.when(files.of_type(F.col("path"), F.col("is_dir"), k), F.lit(k)) for k in kinds)))
    return rows.select(F.explode(held).alias("kind"), "frn")


@query(f"SELECT frn FROM ({PATHS}) WHERE contains(lower({BASE}), 'p') AND contains(lower({BASE}), '1')")
def basename_terms(spark, sf_dir):
    return path_rows(spark, sf_dir).where(files.name_has_all(F.col("path"), F.lit("P 1"))).select("frn")


HOSTS = "SELECT DISTINCT string_split(path, '\\')[1] AS host FROM ({0})".format(PATHS)


@query(f"SELECT p.frn FROM ({PATHS}) p WHERE NOT EXISTS (SELECT 1 FROM (SELECT host || '\\en' AS folder FROM ({HOSTS})) e WHERE lower(p.path) = lower(e.folder) OR starts_with(lower(p.path), lower(e.folder) || '\\'))")
def excluded_folders(spark, sf_dir):
    rows = path_rows(spark, sf_dir)
    folders = rows.select(F.concat(F.element_at(F.split("path", r"\\"), 1), F.lit("\\en")).alias("folder")).distinct()
    return files.outside(rows, folders).select("frn")


@query(f"SELECT frn, CASE WHEN starts_with(path, string_split(path, '\\')[1] || '\\en\\') THEN 'moved\\english' || substr(path, length(string_split(path, '\\')[1]) + 4) ELSE 'moved' || substr(path, length(string_split(path, '\\')[1]) + 1) END AS current FROM ({PATHS})")
def longest_ancestor_rename(spark, sf_dir):
    rows = path_rows(spark, sf_dir)
    host = F.element_at(F.split("path", r"\\"), 1)
    moves = rows.select(host.alias("base"), F.lit("moved").alias("now")).unionByName(rows.select(F.concat(host, F.lit("\\en")).alias("base"), F.lit("moved\\english").alias("now"))).distinct()
    return files.renamed(rows, moves).select("frn", "current")


@query("WITH c AS (SELECT user_id AS frn, event_id AS seq, CASE WHEN event_type <> 'error' THEN event_type || value END AS path FROM events), l AS (SELECT frn, arg_max(coalesce(path, chr(0)), seq) AS path FROM c GROUP BY frn) SELECT c_custkey AS frn, c_name AS path FROM customer WHERE c_custkey NOT IN (SELECT frn FROM l) UNION ALL SELECT frn, event_type || CAST(user_id AS VARCHAR) FROM (SELECT l.frn, e.event_type, e.user_id FROM (SELECT user_id AS frn, max(event_id) AS seq FROM events GROUP BY user_id) l JOIN events e ON e.event_id = l.seq WHERE e.event_type <> 'error')")
def base_overlay(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("frn"), F.col("c_name").alias("path"))
    path = F.when(F.col("event_type") != "error", F.concat("event_type", F.col("user_id").cast("string")))
    return files.overlaid(base, table(spark, sf_dir, "events").select(F.col("user_id").alias("frn"), F.col("event_id").alias("seq"), path.alias("path")))


@query("WITH RECURSIVE n AS (SELECT c_custkey AS frn, CASE WHEN c_custkey >= 5 THEN c_custkey // 5 END AS parent, 'n' || c_custkey AS name FROM customer), t(frn, path) AS (SELECT frn, name FROM n WHERE parent IS NULL UNION ALL SELECT n.frn, t.path || '\\' || n.name FROM t JOIN n ON n.parent = t.frn) SELECT * FROM t")
def tree_paths(spark, sf_dir):
    k = F.col("c_custkey")
    nodes = table(spark, sf_dir, "customer").select(k.alias("frn"), F.when(k >= 5, F.expr("c_custkey div 5")).alias("parent_frn"), F.concat(F.lit("n"), k.cast("string")).alias("name"))
    return files.tree_paths(nodes)


@query("SELECT page_id, 'https://find.example/?q=' || url_encode(left(url, 40)) || '&x=1' AS search FROM pages")
def search_urls(spark, sf_dir):
    template = F.lit("https://find.example/?q={searchTerms}&x=1")
    return table(spark, sf_dir, "pages").select("page_id", T.search_url(template, F.left("url", F.lit(40))).alias("search"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://' || regexp_extract(url, '://([^/]*)', 1) END AS url FROM pages")
def normalized_urls(spark, sf_dir):
    shown = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.regexp_extract("url", "://([^/]*)", 1))
    return table(spark, sf_dir, "pages").select("page_id", T.normalize_url(shown).alias("url"))


@query("SELECT p_partkey AS query_id, CASE WHEN starts_with(p_name, 'red') THEN 'colours' ELSE 'bolts' END AS provider, trim(substr(p_name, CASE WHEN starts_with(p_name, 'red') THEN 4 ELSE 5 END)) AS rest FROM part WHERE starts_with(p_name, 'red') OR starts_with(p_name, 'blue ') OR p_name = 'blue'")
def trigger_routes(spark, sf_dir):
    triggers = spark.createDataFrame([("colours", "prefix", "red", 0), ("bolts", "keyword", "blue", 1)], "provider string, kind string, value string, place int")
    return routing.route(parts(spark, sf_dir).select(F.col("id").alias("query_id"), F.col("name").alias("text")), triggers)


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


EXTENSIONS = "jpg:images jpeg:images png:images gif:images webp:images bmp:images ico:images svg:images heic:images heif:images avif:images tif:images tiff:images pdf:documents doc:documents docx:documents xls:documents xlsx:documents ppt:documents pptx:documents txt:documents md:documents rtf:documents odt:documents ods:documents odp:documents csv:documents mp4:videos mkv:videos mov:videos avi:videos wmv:videos webm:videos flv:videos m4v:videos mpeg:videos mpg:videos mp3:audio wav:audio flac:audio aac:audio m4a:audio ogg:audio wma:audio opus:audio zip:archives 7z:archives rar:archives tar:archives gz:archives bz2:archives xz:archives iso:archives html: exe: rs:".split()
EXTENSION_TABLE = "(VALUES " + ", ".join("({}, '{}', '{}')".format(k, *x.split(":")) for k, x in enumerate(EXTENSIONS)) + ") AS t(k, e, kind)"


@query(f"SELECT p_partkey AS id, kind FROM part JOIN {EXTENSION_TABLE} ON t.k = p_partkey % {len(EXTENSIONS)} WHERE kind <> ''")
def every_file_type(spark, sf_dir):
    """All extensions of all types, against a list of its own."""
    ext = F.get(F.array(*(F.lit(x.split(":")[0].upper()) for x in EXTENSIONS)), (F.col("p_partkey") % len(EXTENSIONS)).cast("int"))
    path = F.concat(F.lit("C:\\a.b\\"), "p_name", F.lit("."), ext)
    held = F.array_compact(F.array(*(F.when(files.of_type(path, F.lit(False), k), F.lit(k)) for k in files.TYPES)))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(held).alias("kind"))


@query(f"SELECT origin, position, path FROM (SELECT 0 AS origin, frn AS position, 'moved' || substr(path, length(string_split(path, '\\')[1]) + 1) AS path FROM ({PATHS}) WHERE contains(lower({BASE}), 'p') AND contains(lower({BASE}), '1') AND lower(string_split({BASE}, '.')[-1]) = 'png' AND contains({BASE}, '.') AND frn % 9 <> 4 AND NOT is_dir QUALIFY row_number() OVER (PARTITION BY lower('moved' || substr(path, length(string_split(path, '\\')[1]) + 1)) ORDER BY frn) = 1) ORDER BY position LIMIT 20")
def file_query(spark, sf_dir):
    """Names in the base, the type on the present path, twenty hits in order."""
    rows = path_rows(spark, sf_dir).withColumns({"ordinal": F.col("frn"), "shadowed": F.col("frn") % 9 == 4})
    moves = rows.select(F.element_at(F.split("path", r"\\"), 1).alias("base"), F.lit("moved").alias("now")).distinct()
    nothing = spark.createDataFrame([], "volume string, frn bigint, path string, is_dir boolean")
    hits, _ = files.found_paths(rows, moves, nothing, F.lit("P 1"), "images", spark.createDataFrame([], "folder string"), 20)
    return hits


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'C:\\x ' || page_id WHEN page_id % 3 = 1 THEN '\\\\srv\\s' || page_id END AS path, page_id % 3 = 0 AS plugin FROM pages")
def direct_paths(spark, sf_dir):
    k = F.col("page_id")
    text = F.when(k % 3 == 0, F.concat(F.lit(' "C:\\x '), k.cast("string"), F.lit('" '))).when(k % 3 == 1, F.concat(F.lit("\\\\srv\\s"), k.cast("string"))).otherwise(F.lit("\\\\?\\C:\\x"))
    plugin = F.when(k % 3 == 0, F.concat(F.lit("C:/x"), k.cast("string"))).when(k % 3 == 1, "C:\\a|b").otherwise("shell:x")
    return table(spark, sf_dir, "pages").select("page_id", T.direct_path(text).alias("path"), T.plugin_path_allowed(plugin).alias("plugin"))


@query("SELECT p_partkey AS id, p_size * 2 + p_partkey / 4.0 AS value FROM part")
def calculated(spark, sf_dir):
    text = F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit("×2)+"), F.col("p_partkey").cast("string"), F.lit("÷4"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), calculator.calculate(text)["value"].alias("value"))


# --- result lists ------------------------------------------------------------------------------


@query(f"""SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, strlen(name), lower(name), id)::INTEGER AS rank FROM
  (SELECT query_id, id, name, CASE WHEN norm = q THEN 4 WHEN starts_with(norm, q) THEN 3 WHEN contains(norm, q) THEN 1 END AS score FROM ({DOCS}), {TABLE_OF_BATCH}) WHERE score IS NOT NULL) WHERE rank <= 7""")
def name_candidates(spark, sf_dir):
    return S.name_candidates(parts(spark, sf_dir), batch(spark), 7)


@query("""SELECT query_id, id, score FROM (SELECT a.r_regionkey::INTEGER AS query_id, 'cmd' || c.r_regionkey AS id, CASE WHEN lower(c.r_name) = a.q THEN 940 ELSE 800 END AS score, row_number() OVER (PARTITION BY a.r_regionkey ORDER BY CASE WHEN lower(c.r_name) = a.q THEN 940 ELSE 800 END DESC, 'cmd' || c.r_regionkey) AS k
  FROM (SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN lower(r_name) ELSE lower(left(r_name, 1)) END AS q FROM region) a JOIN region c ON c.r_regionkey <> 3 AND (contains(lower(c.r_name), a.q) OR starts_with(lower(c.r_name), a.q))) WHERE k <= 8""")
def command_hits(spark, sf_dir):
    k = F.col("r_regionkey")
    asked_for = table(spark, sf_dir, "region").select(k.cast("int").alias("query_id"), F.when(k % 2 == 0, F.col("r_name")).otherwise(F.left("r_name", F.lit(1))).alias("text"))
    commands = table(spark, sf_dir, "region").select(F.concat(F.lit("cmd"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("title"), F.array("r_name").alias("keywords"), F.when(F.col("r_regionkey") == 3, "disabled").otherwise("ready").alias("phase"))
    return results.command_hits(asked_for, commands)


@query(f"""WITH h AS (SELECT query_id, rank::INTEGER AS place, CAST(id AS VARCHAR) AS id, score FROM ({RANKED}) WHERE rank <= 6), n AS (SELECT b.query_id, b.q, count(h.id) AS n FROM {TABLE_OF_BATCH} LEFT JOIN h USING (query_id) GROUP BY ALL)
SELECT query_id, CASE WHEN place > 4 THEN place + 1 ELSE place END AS place, id, score FROM h
UNION ALL SELECT query_id, (least(n, 4) + 1)::INTEGER, 'websearch:two:' || q, 920 FROM n WHERE n > 0
UNION ALL SELECT query_id, k, 'websearch:' || browser || ':' || q, s FROM n, (VALUES (1, 'two', 920), (2, 'one', 900), (3, 'default', 900)) AS w(k, browser, s) WHERE n = 0""")
def merged_results(spark, sf_dir):
    """Search hits with a web search in the fifth place, or web searches alone."""
    hits = S.search(parts(spark, sf_dir), batch(spark), k=6, fuzzy=False).select("query_id", F.col("id").cast("string").alias("id"), "score", F.col("rank").cast("long").alias("place"))
    browsers = spark.createDataFrame([("one", 1), ("two", 2)], "browser string, position int")
    return results.merged(hits, hits.limit(0), batch(spark), browsers, "two")


@query(f"""WITH used AS (SELECT item_id, 0 AS fill, -last_used AS ord FROM ({USAGE}) WHERE item_id IN (SELECT c_custkey FROM customer) AND item_id % 11 <> 3), fill AS (SELECT c_custkey AS item_id, 1 AS fill, 0 AS ord FROM customer WHERE c_custkey % 4 < 2 AND NOT (c_custkey % 11 = 3 AND c_custkey IN (SELECT item_id FROM ({USAGE})))),
r AS (SELECT item_id, fill, ord FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY fill, ord) AS k FROM (SELECT * FROM used UNION ALL SELECT * FROM fill)) WHERE k = 1 ORDER BY fill, ord, item_id LIMIT 16)
SELECT 'recent' AS section, row_number() OVER (ORDER BY fill, ord, item_id)::INTEGER AS place, item_id, CASE WHEN fill = 0 THEN 1 ELSE 0 END AS score, CASE WHEN fill = 0 THEN 'recent' ELSE 'default' END AS tag FROM r
UNION ALL SELECT 'pinned', row_number() OVER (ORDER BY launches DESC, item_id)::INTEGER, item_id, 2, 'pinned' FROM (SELECT * FROM ({USAGE}) WHERE item_id % 11 = 3 AND item_id IN (SELECT c_custkey FROM customer) ORDER BY launches DESC, item_id LIMIT 8)""")
def empty_query_dashboard(spark, sf_dir):
    used = P.usage(log(spark, sf_dir))
    k = F.col("c_custkey")
    source = F.when(k % 4 == 0, "start-menu").when(k % 4 == 1, "desktop").when(k % 4 == 2, "commands").otherwise("app-paths")
    items = table(spark, sf_dir, "customer").select(k.alias("item_id"), source.alias("source"), F.lit("C:\\x.exe").alias("target"))
    pinned = used.where("item_id % 11 = 3").select("item_id", F.col("launches").alias("pinned_at"))
    return P.dashboard(items, used, pinned)


@query(f"""WITH m AS (SELECT item_id, CASE WHEN item_id % 2 = 1 THEN item_id // 2 ELSE item_id END AS new_id, query, moment FROM ({LOG}))
SELECT 'pairs' AS kind, query AS key, new_id AS item_id, count(*) AS n, max(moment) AS at FROM m GROUP BY ALL UNION ALL SELECT 'pinned', '', new_id, 1, max(moment) FROM m WHERE item_id % 3 = 0 GROUP BY new_id""")
def id_remap_tables(spark, sf_dir):
    """Pairs and pins after ids were replaced."""
    rows = log(spark, sf_dir)
    ids = rows.where("item_id % 2 = 1").select(F.col("item_id").alias("old_id"), F.expr("item_id div 2").alias("new_id")).distinct()
    pinned = rows.where("item_id % 3 = 0").groupBy("item_id").agg(F.max("at").alias("pinned_at"))
    out = P.remap_all({"pairs": P.pairs(rows).select("query", "item_id", "n", "last_used"), "pinned": pinned}, ids)
    left = out["pairs"].select(F.lit("pairs").alias("kind"), F.col("query").alias("key"), "item_id", "n", F.col("last_used").alias("at"))
    return left.unionByName(out["pinned"].select(F.lit("pinned").alias("kind"), F.lit("").alias("key"), "item_id", F.lit(1).cast("long").alias("n"), F.col("pinned_at").alias("at")))


# --- evaluation and streams --------------------------------------------------------------------


@query(f"""WITH x AS (SELECT query_id, min(id) AS id FROM ({SCORED}) GROUP BY query_id), p AS (SELECT x.query_id, min(r.rank) AS r FROM x LEFT JOIN (SELECT * FROM ({RANKED}) WHERE rank <= 10) r USING (query_id, id) GROUP BY x.query_id)
SELECT count(*) AS cases, avg(coalesce(r = 1, false)::INTEGER) AS top1, avg(coalesce(r <= 5, false)::INTEGER) AS recall_at_5, avg(coalesce(1.0 / r, 0)) AS mrr FROM p""")
def eval_metrics(spark, sf_dir):
    expected = accepted(spark, sf_dir).groupBy("query_id").agg(F.min("id").alias("id"))
    return evaluate.metrics(S.search(parts(spark, sf_dir), batch(spark), fuzzy=False), expected)


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def stream_latest_state(spark, sf_dir):
    """The events table read as a stream of files, kept as each user's last event."""
    source = new_folder(spark, "events")
    table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value").write.parquet(source)
    return changes.latest_state(spark, source, "user_id bigint, event_id bigint, event_type string, value double", "user_id", ["event_id"])


@query("SELECT event_type, list_sort(list(value))[round((count(*) - 1) * 0.5)::BIGINT + 1] AS p50, list_sort(list(value))[round((count(*) - 1) * 0.95)::BIGINT + 1] AS p95 FROM events GROUP BY event_type")
def value_percentiles(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    half, most = (evaluate.percentile(rows, "value", ["event_type"], p).withColumnRenamed("value", name) for p, name in ((0.5, "p50"), (0.95, "p95")))
    return half.join(most, "event_type")


OVERLAID = f"""SELECT frn, CASE WHEN frn % 7 = 0 THEN 'new\\' || frn ELSE 'x' || path END AS path FROM ({PATHS}) WHERE frn % 11 <> 0 AND (frn % 7 = 0 OR NOT starts_with(lower(path), lower(string_split(path, '\\')[1]) || '\\en\\'))"""


VIEWED = f"SELECT frn, path FROM ({OVERLAID}) QUALIFY row_number() OVER (PARTITION BY path ORDER BY frn % 7 = 0, frn) = 1"


def changed_hosts(spark, sf_dir):
    """A base of pages' paths, and frames: hosts renamed, their folder ``en`` deleted, files moved and
    deleted, in rounds; the last round has no commit and does not count."""
    rows = path_rows(spark, sf_dir)
    hosts = rows.select(F.element_at(F.split("path", r"\\"), 1).alias("host")).distinct().select("host", F.xxhash64("host").alias("id"))
    base = rows.select(F.col("frn").alias("ordinal"), F.lit("v").alias("volume"), "frn", F.lit(False).alias("is_dir"), "path")
    folder = lambda name, path: hosts.select(F.xxhash64("host", F.lit(name)).alias("ordinal"), F.lit("v").alias("volume"), F.xxhash64("host", F.lit(name)).alias("frn"), F.lit(True).alias("is_dir"), path.alias("path"))
    base = base.unionByName(folder("host", F.col("host"))).unionByName(folder("en", F.concat("host", F.lit("\\en"))))

    def change(df: DataFrame, number: int, frn: Column, is_dir: bool, paths: Column) -> DataFrame:
        return df.select(F.lit("change").alias("kind"), F.lit(number).cast("long").alias("round"), frn.alias("frn"), F.lit(is_dir).alias("is_dir"), paths.alias("paths"))

    none = F.array().cast("array<string>")
    parts_of = [
        change(hosts, 1, F.xxhash64("host", F.lit("host")), True, F.array(F.concat(F.lit("x"), "host"))),
        change(hosts, 2, F.xxhash64("host", F.lit("en")), True, none),
        change(rows.where("frn % 7 = 0 and frn % 11 <> 0"), 3, F.col("frn"), False, F.array(F.concat(F.lit("new\\"), F.col("frn").cast("string")))),
        change(rows.where("frn % 11 = 0"), 3, F.col("frn"), False, none),
        change(rows.where("frn % 5 = 1"), 4, F.col("frn"), False, none),
    ]
    whole = parts_of[0]
    for part in parts_of[1:]:
        whole = whole.unionByName(part)
    commits = spark.range(1, 4).select(F.lit("round_commit").alias("kind"), F.col("id").alias("round"), F.lit(0).cast("long").alias("frn"), F.lit(False).alias("is_dir"), none.alias("paths"))
    placed = whole.unionByName(commits).withColumn("last", F.col("kind") == "round_commit")
    frames = numbered(placed, ["round", "last", "frn", "kind"], "seq").drop("last")
    frames = frames.withColumns({"ordinal": F.col("seq"), "volume": F.lit("v"), "identity_only": F.lit(False), "cursors": F.when(F.col("kind") == "round_commit", F.array(F.struct(F.lit("v").alias("volume"), F.col("seq").alias("usn"))))})
    return base, frames


@query(VIEWED)
def stream_overlay(spark, sf_dir):
    """The view after rounds that are read as a stream of frame files."""
    base, frames = changed_hosts(spark, sf_dir)
    source = new_folder(spark, "frames")
    frames.repartitionByRange("seq").write.json(source)
    shown, _ = overlay.follow(base, source, files_at_once=1 << 20)  # files of one write come in no order
    return shown.where("not is_dir").select("frn", "path")
