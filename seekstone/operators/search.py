"""Ranked search of a catalog by a batch of short queries.

``enrich`` derives what is searched. A row's searchable content becomes *keys* (grams, word starts,
initials, delete variants, ...), a query becomes keys of the same kinds by channel, and one join of
both finds the candidates; of a channel that needs all its keys only the rarest one is followed.
``verify`` scores each candidate by its best branch, ``rank`` orders them. Recall never decides a
score: it holds every row that any branch accepts, and the unpruned search is there to prove it.

A catalog has ``id`` and ``name``; the other fields of ``OPTIONAL`` take part where they are there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from seekstone.functions import readings, text as T
from seekstone.shared import stage

#: Scores of the branches (fixed values).
USER_ALIAS, EXACT, BUILTIN_ALIAS, COMPACT_EXACT, TOKEN_SEQUENCE, WORD_EXACT, PREFIX = 1100, 1000, 950, 920, 880, 850, 800
COMPACT_SUBSTRING, KEYWORD_READING, KEYWORD_READING_PREFIX, READING_EXACT, WORD_PREFIX, INITIALS = 780, 780, 760, 750, 720, 700
ACRONYM, INITIALS_INNER, KEYWORD_INITIALS_INNER, SUBSTRING, SKIP, SKIP_LEAST = 680, 620, 600, 550, 320, 280
CONTEXT_DISCOUNT, CONTEXT_COMPACT_DISCOUNT, CONTEXT_READING_DISCOUNT = 160, 220, 130
PROTECTED_TIER, MAX_PREFIX_TERMS, TOP_K, SKIP_GAPS = 2, 512, 10, 3
#: What scattered characters give at least, and what makes up their score: characters met, at a word's
#: start, right behind another; a gap, and each further character of it.
SCATTERED, MEETS, STARTS, RUNS_ON, GAP, GAP_MORE = 100, 16, 8, 4, 3, 1
#: Least score of each quality tier, from 0 on (fixed values).
TIERS = (1100, 1000, 920, 850, 800, 700, 680, 550, 225)
#: Order of fields and of kinds of match among equal evidence (fixed values).
NAME, DISPLAY, ALIAS, READING, KEYWORD, CONTEXT = range(6)
WHOLE, START, INSIDE, LETTERS, SKIPPED, NEAR = range(6)
#: A place or a length that is not known.
UNKNOWN = 2_147_483_647
#: Batches of keys or queries of more rows are joined by a shuffle.
BROADCAST_ROWS = 100_000

#: Sources whose entries are also searched by their address.
SYSTEM_SOURCES = ("win-settings", "builtin-system")

OPTIONAL = ("display_name", "search_keywords", "search_context", "reading", "initials", "char_readings", "syllables", "keyword_readings", "keyword_initials", "context_readings", "context_initials", "source", "target")


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def extra_keywords(catalog: DataFrame) -> Column:
    """Keywords that a system entry's address holds: a settings page's or a tool's name, dashes as spaces."""
    system = F.col("source").isin(*SYSTEM_SOURCES)
    page = F.when(system & F.startswith("target", F.lit("ms-settings:")), F.replace(F.substr("target", F.lit(13)), F.lit("-"), F.lit(" ")))
    key = F.col("id").cast("string")
    tool = F.when(system & F.startswith(key, F.lit("system-tool:")), F.replace(F.substr(key, F.lit(13)), F.lit("-"), F.lit(" ")))
    return F.array_compact(F.array(page, tool))


#: What ``enrich`` adds.
DERIVED = ("norm", "display", "comp", "comp_display", "keywords", "keyword_comps", "contexts", "context_comps", "context_terms", "words", "acro")


def enrich(catalog: DataFrame) -> DataFrame:
    """``catalog`` with normalized and compact names, words, acronym, and the same of its other fields."""
    has, raw = set(catalog.columns), [F.col("name")]
    fields = {"norm": T.normalize(F.col("name"))}
    if "display_name" in has:
        raw.append(F.coalesce("display_name", "name"))
        fields["display"] = T.normalize(raw[-1])
    out = catalog.withColumns(fields)
    fields = {"comp": T.compact(F.col("norm"))}
    words = [T.tokens(F.col("norm")), *(T.split_camel(x) for x in raw)]
    if "display_name" in has:
        fields["comp_display"] = T.compact(F.col("display"))
    if "search_keywords" in has:
        said = F.coalesce("search_keywords", F.array().cast("array<string>"))
        if {"source", "target"} <= has:
            said = F.concat(said, extra_keywords(catalog))
        said = F.filter(said, lambda k: k.isNotNull() & (T.normalize(k) != ""))
        fields["keywords"] = F.array_distinct(F.transform(said, T.normalize))
        fields["keyword_comps"] = F.transform(F.array_distinct(F.transform(said, T.normalize)), T.compact)
        words.append(F.flatten(F.transform(said, lambda k: F.concat(T.tokens(T.normalize(k)), T.split_camel(k)))))
    if "search_context" in has:
        said = F.filter(F.coalesce("search_context", F.array().cast("array<string>")), lambda k: k.isNotNull() & (T.normalize(k) != ""))
        fields["contexts"] = F.array_distinct(F.transform(said, T.normalize))
        fields["context_comps"] = F.transform(F.array_distinct(F.transform(said, T.normalize)), T.compact)
        fields["context_terms"] = F.array_distinct(F.flatten(F.transform(said, lambda k: F.concat(F.array(T.normalize(k)), T.tokens(T.normalize(k)), T.split_camel(k)))))
    # a null name has no words of its own
    fields["words"] = F.array_distinct(F.flatten(F.array(*(F.coalesce(w, F.array().cast("array<string>")) for w in words))))
    return out.withColumns(fields).withColumn("acro", T.acronym(T.tokens(F.col("norm"))))


def parse(queries: DataFrame) -> DataFrame:
    """``queries(query_id, text)`` with ``q``, ``c``, ``q_tokens``, and for a query of Chinese characters and
    Latin letters or digits ``q_parts``, its runs of either."""
    out = queries.select("query_id", T.normalize(F.col("text")).alias("q"))
    mixed = T.contains_cjk(F.col("q")) & F.rlike("q", F.lit("[A-Za-z0-9]"))
    parts = F.when(mixed, T.script_parts(F.col("q"))).otherwise(F.array().cast("array<string>"))
    return out.select("query_id", "q", T.compact(F.col("q")).alias("c"), T.tokens(F.col("q")).alias("q_tokens"), parts.alias("q_parts"))


def quality_tier(score: Column) -> Column:
    tier = F.lit(len(TIERS))
    for k in reversed(range(len(TIERS))):
        tier = F.when(score >= TIERS[k], k).otherwise(tier)
    return tier


# --- scoring -----------------------------------------------------------------------------------


def hit(condition: str, score: int | str, tag: str, field: int | str, kind: int | str, start: str = "0", span: str = "length(q)", gaps: str = "0", edit: str = "0") -> str:
    """SQL of a branch: what it gives where its condition holds, else null. Of equal scores the earlier
    start wins, then fewer gaps, fewer edits, the longer span, the field, the kind of match."""
    return f"""CASE WHEN {condition} THEN struct(CAST({score} AS INT) AS score, -CAST({start} AS INT) AS early, -CAST({gaps} AS INT) AS tight, -CAST({edit} AS INT) AS true_to,
      CAST({span} AS INT) AS span, -CAST({field} AS INT) AS field, -CAST({kind} AS INT) AS kind, {tag} AS tag) END"""


def let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``name`` standing for a value that is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def place(source: str, nth: str) -> str:
    """SQL of the place in a normalized text of its nth character that is no space, both from 0."""
    return f"(get(filter(sequence(1, length({source})), j -> substr({source}, j, 1) <> ' '), {nth}) - 1)"


@dataclass(frozen=True)
class Kind:
    """How a kind of text is scored that is the query (whole), begins with it or holds it.

    No score means no such branch. ``least`` are the shortest queries in characters, or in bytes for
    texts without spaces, which are compared with the query without spaces.
    """

    tag: str
    field: int
    scores: tuple[int, int, int]
    least: tuple[int, int, int] = (1, 1, 1)
    squeezed: bool = False
    names: tuple[str, str, str] = ("exact", "prefix", "substring")
    single: tuple[int, int, int] | None = None  # scores of queries of one character
    whole_kind: int = WHOLE
    whole_span: str = "unknown"  # or "query", "name"
    mapped: bool = False  # places are those of letters in the name


def squeezed(tag: str, field: int, exact: int, inside: int, least: int = 2) -> Kind:
    return Kind(tag, field, (exact, inside, inside), (max(least, 2), 3, 3), True, ("compact-exact", "compact-substring", "compact-substring"))


READ, CALLED = ("reading-exact", "reading-prefix", ""), ("initials-exact", "initials-prefix", "initials-inner")
#: By column of the catalog; scores as above (fixed values).
KINDS = {
    "norm": Kind("", NAME, (EXACT, PREFIX, SUBSTRING)),
    "display": Kind("", DISPLAY, (EXACT, PREFIX, SUBSTRING)),
    "comp": squeezed("", NAME, COMPACT_EXACT, COMPACT_SUBSTRING),
    "comp_display": squeezed("", NAME, COMPACT_EXACT, COMPACT_SUBSTRING),
    "words": Kind("", NAME, (WORD_EXACT, WORD_PREFIX, 0), (1, 2, 1), names=("word-exact", "word-prefix", "")),
    "acro": Kind("", NAME, (ACRONYM, 0, 0), (2, 1, 1), names=("acronym", "", ""), whole_kind=LETTERS, whole_span="query"),
    "keywords": Kind("keyword-", KEYWORD, (WORD_EXACT, WORD_PREFIX, SUBSTRING - 40)),
    "keyword_comps": squeezed("keyword-", KEYWORD, WORD_EXACT, COMPACT_SUBSTRING - 60),
    "reading": Kind("", READING, (READING_EXACT, READING_EXACT - 50, 0), names=READ, whole_span="name"),
    "initials": Kind("", READING, (INITIALS, INITIALS - 40, INITIALS_INNER), names=CALLED, single=(INITIALS, INITIALS - 60, INITIALS_INNER + 40), whole_span="name", mapped=True),
    "keyword_readings": Kind("keyword-", KEYWORD, (KEYWORD_READING, KEYWORD_READING_PREFIX, 0), (2, 2, 2), names=READ),
    "keyword_initials": Kind("keyword-", KEYWORD, (KEYWORD_READING, KEYWORD_READING_PREFIX, KEYWORD_INITIALS_INNER), (2, 2, 2), names=CALLED),
    "contexts": Kind("context-", CONTEXT, (WORD_EXACT - CONTEXT_DISCOUNT, WORD_PREFIX - CONTEXT_DISCOUNT, SUBSTRING - CONTEXT_DISCOUNT), (2, 2, 2)),
    "context_terms": Kind("context-", CONTEXT, (WORD_EXACT - CONTEXT_DISCOUNT, WORD_PREFIX - CONTEXT_DISCOUNT, 0), (2, 2, 2), names=("word-exact", "word-prefix", "")),
    "context_comps": squeezed("context-", CONTEXT, COMPACT_EXACT - CONTEXT_COMPACT_DISCOUNT, COMPACT_SUBSTRING - CONTEXT_COMPACT_DISCOUNT),
    "context_readings": Kind("context-", CONTEXT, (READING_EXACT - CONTEXT_READING_DISCOUNT, READING_EXACT - CONTEXT_READING_DISCOUNT - 40, 0), (2, 2, 2), names=READ),
    "context_initials": Kind("context-", CONTEXT, (INITIALS - CONTEXT_READING_DISCOUNT, INITIALS - CONTEXT_READING_DISCOUNT - 40, INITIALS_INNER - CONTEXT_READING_DISCOUNT), (2, 2, 2), names=CALLED),
}
#: Columns that hold one text; the others are arrays. Texts without spaces come with what they stand for.
SINGLE, SOURCE_OF = ("norm", "display", "comp", "comp_display", "acro", "reading", "initials"), {"comp": "norm", "comp_display": "display", "keyword_comps": "keywords", "context_comps": "contexts"}


def texts_of(has: set[str]) -> str:
    """SQL of all texts of a row: ``array<struct<code, text, source>>``."""
    parts = []
    for code, column in enumerate(KINDS):
        if column not in has:
            continue
        source = SOURCE_OF.get(column)
        if column in SINGLE:
            parts.append(f"array(struct({code} AS code, {column} AS text, {source or 'CAST(NULL AS STRING)'} AS source))")
        elif source:
            parts.append(f"transform(arrays_zip({column}, {source}), x -> struct({code} AS code, x.{column} AS text, x.{source} AS source))")
        else:
            parts.append(f"transform({column}, x -> struct({code} AS code, x AS text, CAST(NULL AS STRING) AS source))")
    return "concat(" + ", ".join(f"coalesce({p}, array())" for p in parts) + ")"


def met_texts(has: set[str]) -> str:
    """SQL of what the texts of a row give: each is looked at once, and what it is worth stands in
    tables of constants by its kind and by how it meets the query."""
    kinds = list(KINDS.values())

    def constants(value) -> str:
        return "array(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for k in kinds for v in value(k)) + ")"

    scores, single = constants(lambda k: k.scores), constants(lambda k: k.single or k.scores)
    least, tags = constants(lambda k: k.least), constants(lambda k: [k.tag + n for n in k.names])
    fields, forms = constants(lambda k: [k.field]), constants(lambda k: [int(k.squeezed) + 2 * int(k.mapped)])
    matches = constants(lambda k: [k.whole_kind, INSIDE if k.squeezed else START, INSIDE])
    spans = constants(lambda k: [("unknown", "query", "name").index(k.whole_span)])
    first, last = place("t.source", "instr(t.text, c) - 1"), place("t.source", "instr(t.text, c) + length(c) - 2")
    inner = f"CASE get({forms}, t.code) WHEN 1 THEN {first} WHEN 2 THEN coalesce({place('norm', 'instr(t.text, q) - 1')}, {UNKNOWN}) ELSE instr(t.text, q) - 1 END"
    # a text without spaces that begins with the query holds it; its places are those in the text with spaces
    start = f"CASE WHEN m.how = 0 OR (m.how = 1 AND get({forms}, t.code) <> 1) THEN 0 ELSE {inner} END"
    span = f"CASE WHEN m.how > 0 AND get({forms}, t.code) = 1 THEN {last} - {first} + 1 WHEN m.how > 0 THEN length(q) ELSE CASE get({spans}, t.code) WHEN 0 THEN {UNKNOWN} WHEN 1 THEN length(q) ELSE length(name) END END"
    score = f"CASE WHEN length(q) = 1 THEN get({single}, m.at) ELSE get({scores}, m.at) END"
    found = hit(f"m.how IS NOT NULL AND {score} > 0 AND m.n >= get({least}, m.at)", score, f"get({tags}, m.at)", f"get({fields}, t.code)", f"get({matches}, m.at)", start, span)
    how = "CASE WHEN t.text = x THEN 0 WHEN startswith(t.text, x) THEN 1 WHEN contains(t.text, x) THEN 2 END"
    size = f"CASE WHEN get({forms}, t.code) = 1 THEN octet_length(x) ELSE length(x) END"
    meeting = let("h", how, f"struct(h AS how, 3 * t.code + h AS at, {size} AS n)")
    asked = f"CASE WHEN get({forms}, t.code) = 1 THEN c ELSE q END"
    # what a text is worth is worked out only where it holds the query
    return f"transform(filter({texts_of(has)}, t -> contains(t.text, {asked})), t -> " + let("m", let("x", asked, meeting), found) + ")"


def token_sequence() -> str:
    """The query's words meet words of the row in order: each begins one, or spells initials of some."""
    letters = "array_join(transform(words, w -> left(w, 1)), '')"
    starts = "filter(sequence(1, length(norm)), i -> substr(norm, i, 1) <> ' ' AND (i = 1 OR substr(norm, i - 1, 1) = ' '))"
    step = f"""transform(array(array_min(filter(sequence(0, size(words) - 1), j -> j >= s.next AND (startswith(words[j], t) OR (length(t) >= 2 AND substr(letters, j + 1, length(t)) = t))))), j ->
      CASE WHEN j IS NULL OR NOT s.met THEN struct(s.next AS next, s.gaps AS gaps, s.first AS first, false AS met)
        ELSE struct(j + CASE WHEN startswith(words[j], t) THEN 1 ELSE length(t) END AS next, s.gaps + j - s.next AS gaps, CASE WHEN s.first < 0 THEN j ELSE s.first END AS first, true AS met) END)[0]"""
    walk = f"aggregate(q_tokens, struct(0 AS next, 0 AS gaps, -1 AS first, true AS met), (s, t) -> {step})"
    met = hit("s.met", TOKEN_SEQUENCE, "'token-seq'", NAME, INSIDE, f"coalesce(get({starts}, s.first) - 1, {UNKNOWN})", gaps="s.gaps")
    return f"CASE WHEN size(q_tokens) >= 2 AND size(words) > 0 THEN transform(array({letters}), letters -> transform(array({walk}), s -> {met})[0])[0] END"


def by_any_reading() -> str:
    """Characters read one after another by any of their readings, in full or by the first letter, the
    last one also in part; characters without a reading stand for themselves."""
    onward = """array_distinct(flatten(transform(s.at, p -> array_compact(concat(
        transform(ch.readings, r -> CASE WHEN startswith(substr(q, p + 1), r) THEN p + length(r) END),
        transform(ch.readings, r -> CASE WHEN substr(q, p + 1, 1) = left(r, 1) THEN p + 1 END),
        array(CASE WHEN substr(q, p + 1, 1) = lower(ch.ch) THEN p + 1 END))))))"""
    part = "exists(s.at, p -> p < length(q) AND exists(ch.readings, r -> startswith(r, substr(q, p + 1))))"
    state = "struct<at:array<int>,n:int,done:boolean>"
    step = f"""CASE WHEN s.done OR size(s.at) = 0 THEN s ELSE transform(array({onward}), o ->
        CAST(struct(o AS at, s.n + 1 AS n, {part} OR exists(o, p -> p >= length(q)) AS done) AS {state}))[0] END"""
    walk = f"aggregate(slice(char_readings, i + 1, size(char_readings)), CAST(struct(array(0) AS at, 0 AS n, false AS done) AS {state}), (s, ch) -> {step})"
    found = f"get(filter(transform(sequence(0, size(char_readings) - 1), i -> transform(array({walk}), s -> CASE WHEN s.done THEN struct(i AS i, s.n AS n) END)[0]), x -> x IS NOT NULL), 0)"
    met = hit("x IS NOT NULL", READING_EXACT - 20, "'reading-any'", READING, INSIDE, "x.i", "greatest(x.n, length(q))")
    wanted = "length(q) >= 2 AND rlike(q, '[A-Za-z0-9]') AND size(char_readings) > 0 AND exists(char_readings, x -> size(x.readings) > 0)"
    return f"CASE WHEN {wanted} THEN transform(array({found}), x -> {met})[0] END"


def mixed_scripts(source: str, field: int, has: set[str]) -> str:
    """Runs of Chinese characters and of Latin letters one after another: in the text itself, Latin ones
    also in what its characters are read as, never behind where the run before ended.

    Two streams are walked together. A run met in the text moves the place in the reading to where that
    character's syllable ends, one met in the reading moves the place in the text to the character that
    its last letter belongs to; without a syllable for every character, to the text's end. Where the
    order does not hold, runs that are there at all still count, for less.
    """
    text_of = lambda c: f"coalesce({c}, '')" if c in has else "''"
    reading, letters = text_of("reading"), text_of("initials")
    syllables = "coalesce(syllables, array())" if "syllables" in has else "CAST(array() AS array<string>)"
    ends = f"CASE WHEN size({syllables}) = length({source}) THEN transform(sequence(0, length({source})), k -> aggregate(slice({syllables}, 1, k), 0, (n, x) -> n + length(x))) END"
    state = "struct<at:int,read:int,first:int,upto:int,gaps:int,met:boolean>"
    latin = "rlike(p, '^[A-Za-z0-9]')"
    in_text = "struct(n - 1 + length(p), coalesce(get(ends, n - 1 + length(p)), s.read), coalesce(s.first, n - 1), greatest(s.upto, n - 1 + length(p)), s.gaps + CASE WHEN n - 1 > s.at THEN 1 ELSE 0 END, true)"
    reached = f"greatest(s.at, CASE WHEN ends IS NULL THEN length({source}) ELSE size(filter(slice(ends, 1, size(ends) - 1), x -> x < e)) END)"
    in_reading = let("e", f"locate(p, {reading}, s.read + 1) - 1 + length(p)", let("i", reached, f"CAST(struct(i, e, coalesce(s.first, {UNKNOWN}), greatest(s.upto, i), s.gaps, true) AS {state})"))
    step = let("n", f"locate(p, {source}, s.at + 1)", f"""CASE WHEN NOT s.met THEN s WHEN n > 0 THEN CAST({in_text} AS {state})
      WHEN {latin} AND locate(p, {reading}, s.read + 1) > 0 THEN {in_reading} ELSE CAST(struct(s.at, s.read, s.first, s.upto, s.gaps, false) AS {state}) END""")
    walk = f"aggregate(q_parts, CAST(struct(0, 0, NULL, 0, 0, true) AS {state}), (s, p) -> {step})"
    ordered = hit("true", WORD_EXACT, "'mixed-ordered'", field, INSIDE, "s.first", f"CASE WHEN s.first = {UNKNOWN} THEN greatest(length({source}), 1) ELSE greatest(s.upto - s.first, 1) END", "s.gaps")
    there = f"forall(q_parts, p -> contains({source}, p) OR ({latin} AND (contains({reading}, p) OR contains({letters}, p) OR exists(words, w -> contains(w, p)))))"
    chinese = f"filter(q_parts, p -> NOT {latin})"
    loose = hit(there, WORD_PREFIX - 40, "'mixed-loose'", field, INSIDE, f"instr({source}, {chinese}[0]) - 1", f"aggregate({chinese}, 0, (n, p) -> n + length(p))", str(UNKNOWN // 4))
    return f"CASE WHEN size(q_parts) > 1 AND {source} <> '' THEN " + let("ends", ends, let("s", walk, f"CASE WHEN s.met AND s.first IS NOT NULL THEN {ordered} ELSE {loose} END")) + " END"


def other_branches(has: set[str]) -> list[str]:
    """SQL of the branches that look at more than one text."""
    out = [token_sequence(), mixed_scripts("norm", NAME, has)]
    if "display" in has:
        out.append(mixed_scripts("display", DISPLAY, has))
    if "user_alias" in has:
        out.append(hit("user_alias", USER_ALIAS, "'user-alias-exact'", ALIAS, WHOLE, span=str(UNKNOWN)))
    if "builtin_alias" in has:
        out.append(hit("builtin_alias", BUILTIN_ALIAS, "'alias-exact'", ALIAS, WHOLE, span=str(UNKNOWN)))
    if "char_readings" in has:
        out.append(by_any_reading())
    return out


def loose_texts(has: set[str], edits: bool) -> str:
    """SQL of the texts that skips and edits look at, in their order: ``array<struct<place, text, off, tag, field>>``."""
    one = lambda place, text, off, tag, field: f"struct({place} AS place, {text} AS text, {off} AS off, '{tag}' AS tag, {field} AS field)"
    parts = [f"array({one(0, 'norm', 0, '', NAME)})"]
    if "display" in has:
        parts.append(f"array({one(1, 'display', 0, '', NAME if edits else DISPLAY)})")
    if "keywords" in has:
        parts.append(f"transform(coalesce(keywords, array()), x -> {one(2, 'x', 30, 'keyword-', KEYWORD)})")
    if edits:
        parts += [f"array({one(3, c, 20, 'reading-', READING)})" for c in ("reading", "initials") if c in has and "reading" in has]
    return f"filter(concat({', '.join(parts)}), t -> t.text <> '')"


def skipped(texts: str) -> str:
    """The query's characters in order with one to three others between: the shortest such stretch of a
    text, the first among equals; none where the shortest has no others. The first text that has one counts."""
    end = f"""aggregate(sequence(i, least(length(t.text), i + length(q) + {SKIP_GAPS - 1})), struct(0 AS k, CAST(NULL AS INT) AS at), (s, j) ->
      CASE WHEN s.at IS NULL AND substr(t.text, j, 1) = substr(q, s.k + 1, 1) THEN struct(s.k + 1 AS k, CASE WHEN s.k + 1 = length(q) THEN j END AS at) ELSE s END).at"""
    best = f"array_min(filter(transform(filter(sequence(1, length(t.text)), i -> substr(t.text, i, 1) = left(q, 1)), i -> struct({end} - i + 1 AS span, i AS i)), x -> x.span IS NOT NULL))"
    met = hit(f"x.span BETWEEN length(q) + 1 AND length(q) + {SKIP_GAPS}", f"greatest({SKIP_LEAST}, {SKIP} - 8 * (x.span - length(q))) - t.off", "concat(t.tag, 'skip')", "t.field", SKIPPED, "x.i - 1", "x.span", "x.span - length(q)")
    whole = "length(t.text) > length(q) AND translate(q, t.text, '') = ''"  # most texts lack one of the characters
    return f"get(filter(transform(filter({texts}, t -> {whole}), t -> {let('x', best, met)}), x -> x IS NOT NULL), 0)"


def near(texts: Column) -> Column:
    """One or two edits away from a text as a whole, else from one of its words: of the texts of the first
    place that has such a text the nearest."""
    q = F.col("q")

    def of(t: Column) -> Column:
        scores = F.transform(F.concat(F.array(t["text"]), T.tokens(t["text"])), lambda w: T.fuzzy_score(q, w))
        found = F.get(F.transform(F.array(scores), lambda f: F.coalesce(F.get(f, 0), F.array_max(f))), 0)
        return F.struct(t.alias("t"), found.alias("found"))

    def shown(x: Column) -> Column:
        t, edits = x["t"], F.when(x["found"] == 400, 1).otherwise(2)
        return F.struct((-t["place"]).alias("place"), F.struct((x["found"] - t["off"]).cast("int").alias("score"), F.lit(-UNKNOWN).alias("early"), F.lit(0).alias("tight"), (-edits).alias("true_to"), F.greatest(F.length(q) - edits, F.lit(0)).cast("int").alias("span"), (-t["field"]).alias("field"), F.lit(-NEAR).alias("kind"), F.concat(t["tag"], F.lit("fuzzy")).alias("tag")).alias("hit"))

    return F.array_max(F.transform(F.filter(F.transform(texts, of), lambda x: x["found"].isNotNull()), shown))["hit"]


def subsequence(text: str) -> str:
    """SQL of how well the query's characters stand in order in a text, from 0 to 200; null where they do not.

    Every character met gives 16, 8 more where a word begins and 4 more right behind the one before; a
    gap costs 3 and 1 for each further character. The best way counts, as a share of what a query gives
    that begins a word and runs on. One fold over the query keeps the best score for every place that
    its last character may have; within, a fold over the text keeps the best open gap.
    """
    begins = f"CASE WHEN j = 1 OR rlike(substr({text}, j - 1, 1), '[^\\\\p{{L}}\\\\p{{N}}]') THEN {STARTS} ELSE 0 END"
    row = "struct<out:array<int>,gap:int>"
    before = "get(r, j - 2)"  # the best way that ends right before place j
    value = f"CASE WHEN substr({text}, j, 1) = ch.c THEN {MEETS} + {begins} + CASE WHEN ch.n = 0 THEN 0 ELSE greatest({before} + {RUNS_ON}, o.gap) END END"
    # a gap behind place j - 1 opens for place j + 1
    gap = f"greatest(o.gap - {GAP_MORE}, {before} - {GAP})"
    places = f"sequence(1, length({text}))"
    inner = f"aggregate({places}, CAST(struct(array(), NULL) AS {row}), (o, j) -> CAST(struct(array_append(o.out, {value}), {gap}) AS {row})).out"
    letters = "transform(sequence(1, length(q)), n -> struct(n - 1 AS n, substr(q, n, 1) AS c))"
    best = f"array_max(aggregate({letters}, CAST(array() AS array<int>), (r, ch) -> {inner}))"
    whole = f"({MEETS} * length(q) + {STARTS} + {RUNS_ON} * (length(q) - 1))"
    there = f"forall(split(q, ''), x -> contains({text}, x))"  # most texts lack one of the characters
    return f"CASE WHEN length({text}) >= length(q) AND {there} THEN {let('x', best, f'CASE WHEN x IS NOT NULL THEN greatest(0, least(200, 200 * x div {whole})) END')} END"


def verify(candidates: DataFrame, fuzzy: bool = True, scattered: bool = False) -> DataFrame:
    """Candidates with ``score``, ``tag``, ``tier`` and evidence (``start``, ``gaps``, ``edits``, ``span``,
    ``field``, ``kind``); those without any branch go.

    All texts of a row are one array that one expression goes over, so that the plan does not grow with
    the fields. Skips are only looked for below 320, edits (of queries of two characters or more) below
    400: each is worked out where nothing better is; with ``scattered`` also the query's characters
    anywhere in order in the name, below 300.
    """
    has = set(candidates.columns)
    strict = f"array_max(array_compact(concat({met_texts(has)}, array({', '.join(other_branches(has))}))))"
    scored = candidates.where("q <> ''").withColumn("best", F.expr(strict))
    if fuzzy:
        skip = f"CASE WHEN length(q) >= 4 AND (best IS NULL OR best.score < {SKIP}) THEN {skipped(loose_texts(has, False))} END"
        scored = scored.withColumn("best", F.expr(f"array_max(array_compact(array(best, {skip})))"))
    if scattered:
        found = let("x", subsequence("norm"), hit("x IS NOT NULL", f"{SCATTERED} + x", "'subsequence'", NAME, SKIPPED, str(UNKNOWN), gaps="1"))
        scored = scored.withColumn("best", F.expr(f"array_max(array_compact(array(best, CASE WHEN length(q) >= 2 AND (best IS NULL OR best.score < {SCATTERED + 200}) THEN {found} END)))"))
    if fuzzy:
        loose = F.when((F.length("q") >= 2) & (F.col("best").isNull() | (F.col("best.score") < 400)), near(F.expr(loose_texts(has, True))))
        scored = scored.withColumn("best", F.array_max(F.array_compact(F.array("best", loose))))
    # a generator, for a filter would be pushed below and carry a copy of the whole expression with it
    scored = scored.select(*(c for c in scored.columns if c != "best"), F.explode(F.array_compact(F.array("best"))).alias("best"))
    evidence = {"start": -F.col("best.early"), "gaps": -F.col("best.tight"), "edits": -F.col("best.true_to"), "span": F.col("best.span"), "field": -F.col("best.field"), "kind": -F.col("best.kind")}
    return scored.withColumns({"score": F.col("best.score"), "tag": F.col("best.tag"), **evidence}).drop("best").withColumn("tier", quality_tier(F.col("score")))


def evidence_order() -> list[Column]:
    return [F.col("start"), F.col("gaps"), F.col("edits"), F.desc("span"), F.col("field"), F.col("kind")]


def final_order() -> list[Column]:
    """Protected tiers first and by tier; then score, evidence, length of the name in bytes, name, id."""
    shielded = F.col("tier") <= PROTECTED_TIER
    return [shielded.desc(), F.when(shielded, F.col("tier")).otherwise(99), F.desc("score"), *evidence_order(), F.octet_length("name"), F.lower("name"), F.col("id")]


def tier_order() -> list[Column]:
    """By tier alone, without evidence: tier, score, length of the name in bytes, name, id."""
    return [F.col("tier"), F.desc("score"), F.octet_length("name"), F.lower("name"), F.col("id")]


def score_order() -> list[Column]:
    """By score alone: score, length of the name in characters, name, id."""
    return [F.desc("score"), F.length("name"), F.lower("name"), F.col("id")]


def rank(hits: DataFrame, k: int = TOP_K, order: list[Column] | None = None) -> DataFrame:
    """The k best of each query with ``rank`` from 1, in the final order or another; ids make it total."""
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(*(final_order() if order is None else order)))
    return hits.withColumn("rank", best).where(F.col("rank") <= k)


# --- keys --------------------------------------------------------------------------------------


def _keyed(kind: str, array: Column) -> Column:
    return F.transform(array, lambda x: F.concat(F.lit(kind), x))


def _grams(kind: str, texts: list[Column], sizes: set[int]) -> list[Column]:
    return [_keyed(f"{kind}{n}", T.grams(x, n)) for x in texts for n in sorted(sizes)]


def _grams_of(kind: str, n: int):
    return lambda x: _keyed(f"{kind}{n}", T.grams(x, n))


def many_edits(term: Column) -> Column:
    """What is left of a term of at most 12 characters after one or two deletions, and itself."""
    once = F.transform(F.sequence(F.lit(1), F.greatest(F.length(term), F.lit(1))), lambda i: F.concat(F.substr(term, F.lit(1), i - 1), F.substr(term, i + 1)))
    twice = F.flatten(F.transform(once, lambda v: F.transform(F.sequence(F.lit(1), F.greatest(F.length(v), F.lit(1))), lambda i: F.concat(F.substr(v, F.lit(1), i - 1), F.substr(v, i + 1)))))
    return F.when(F.length(term).between(1, 12), F.array_distinct(F.concat(F.array(term), once, twice))).otherwise(F.array().cast("array<string>"))


def spaced_pairs(text: Column) -> Column:
    """Keys of kind ``s``: all two characters with one between."""
    return F.transform(T.grams(text, 3), lambda x: F.concat(F.lit("s"), F.left(x, F.lit(1)), F.substr(x, F.lit(3))))


def edit_terms(docs: DataFrame) -> Column:
    """Texts of a row that a query may be an edit or two away from: whole ones and their words."""
    has = set(docs.columns)
    single = [F.coalesce(F.col(c), F.lit("")) for c in ("norm", "display", "reading", "initials") if c in has]
    lists = [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("keywords", "contexts", "keyword_readings", "keyword_initials", "context_readings", "context_initials") if c in has]
    return F.array_distinct(F.concat(F.flatten(F.transform(F.array(*single), T.tokens)), F.array(*single), *(F.flatten(F.transform(a, lambda x: F.concat(F.array(x), T.tokens(x)))) for a in lists)))


def edit_keys(docs: DataFrame) -> DataFrame:
    """``(id, key)``: the keys of kind ``d`` as ``doc_keys`` has them, some repeated; each is a row as soon
    as it is made, which is several times faster than lists of them."""
    without = lambda c, i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1))
    v, i, j, n = F.col("v"), F.col("i"), F.col("j"), F.length("v")
    terms = docs.select("id", F.explode(edit_terms(docs)).alias("v")).where(n.between(1, 12))
    # i from 0: nothing is deleted; j from i - 1: no second deletion, or one at or behind the first
    once = terms.select("id", "v", F.explode(F.sequence(F.lit(0), n)).alias("i")).select("id", F.when(i == 0, v).otherwise(without(v, i)).alias("v"), "i")
    last = F.when(i == 0, F.lit(-1)).otherwise(F.greatest(n, i - 1))
    twice = once.select("id", "v", "i", F.explode(F.sequence(i - 1, last)).alias("j"))
    every = twice.select("id", F.when((j < i) | (i == 0), v).otherwise(without(v, j)).alias("v"))
    return every.select("id", F.concat(F.lit("d"), "v").alias("key"))


def doc_keys(docs: DataFrame, kinds: set[str]) -> Column:
    """All keys of a row of the kinds that queries ask for."""
    has = set(docs.columns)
    empty = F.array().cast("array<string>")
    single = [F.coalesce(F.col(c), F.lit("")) for c in ("norm", "display", "reading", "initials") if c in has]
    lists = [F.coalesce(F.col(c), empty) for c in ("keywords", "contexts", "keyword_readings", "keyword_initials", "context_readings", "context_initials") if c in has]
    comps = [F.coalesce(F.col(c), F.lit("")) for c in ("comp", "comp_display") if c in has]
    comp_lists = [F.coalesce(F.col(c), empty) for c in ("keyword_comps", "context_comps") if c in has]
    out = []
    for kind, texts, arrays in (("g", single, lists), ("k", comps, comp_lists)):
        sizes = {int(k[1]) for k in kinds if k[0] == kind}
        out += _grams(kind, texts, sizes)
        out += [F.flatten(F.transform(a, _grams_of(kind, n))) for a in arrays for n in sorted(sizes)]
    if "s" in kinds:
        out += [spaced_pairs(x) for x in single] + [F.flatten(F.transform(a, spaced_pairs)) for a in lists]
    if "x" in kinds:
        out.append(F.flatten(F.transform("words", lambda w: F.array(F.concat(F.lit("x"), F.left(w, F.lit(1))), F.concat(F.lit("x"), F.left(w, F.lit(2)))))))
    if "y" in kinds:
        out.append(_keyed("y", T.grams(F.array_join(F.transform("words", lambda w: F.left(w, F.lit(1))), ""), 2)))
    if "a" in kinds:
        out.append(F.array(F.concat(F.lit("a"), F.coalesce("acro", F.lit("")))))
    if "i" in kinds:
        out.append(F.array(F.concat(F.lit("i"), F.col("id").cast("string"))))
    if "h" in kinds and "char_readings" in has:
        out.append(F.flatten(F.transform(F.coalesce("char_readings", F.array().cast("array<struct<ch:string,readings:array<string>>>")), lambda x: F.concat(F.array(F.concat(F.lit("h"), F.lower(x["ch"]))), F.transform(x["readings"], lambda r: F.concat(F.lit("h"), F.left(r, F.lit(1))))))))
    if "d" in kinds:
        out.append(F.flatten(F.transform(edit_terms(docs), lambda w: _keyed("d", many_edits(w)))))
    return F.array_distinct(F.concat(*out)) if out else empty


def query_keys(parsed: DataFrame, fuzzy: bool = True, aliases: DataFrame | None = None, scattered: bool = False) -> DataFrame:
    """``(query_id, channel, rarest, key)``: a row is a candidate if it holds any key of a channel, or, of
    a channel with ``rarest``, the one that fewest rows hold."""

    def channel(name: str, rarest: bool, keys: Column, when: str = "true") -> DataFrame:
        return parsed.where(when).select("query_id", F.lit(name).alias("channel"), F.lit(rarest).alias("rarest"), F.explode(F.array_distinct(keys)).alias("key"))

    q, c = F.col("q"), F.col("c")
    longest = F.element_at(F.array_sort(F.transform("q_tokens", lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))), 1)["t"]

    def inside(kind: str, x: Column) -> Column:
        short = F.array(F.concat(F.lit(kind), F.length(x).cast("string"), x))
        return F.when(F.length(x) <= 2, short).otherwise(_keyed(f"{kind}3", T.grams(x, 3)))

    out = [
        channel("text", True, inside("g", q), "q <> ''"),
        channel("compact", True, inside("k", c), "octet_length(c) >= 2"),
        channel("words", False, F.when(F.length(longest) >= 2, F.array(F.concat(F.lit("x"), F.left(longest, F.lit(2))), F.concat(F.lit("y"), F.left(longest, F.lit(2))))).otherwise(F.array(F.concat(F.lit("x"), longest))), "size(q_tokens) >= 2"),
        channel("acronym", False, F.array(F.concat(F.lit("a"), q)), "length(q) >= 2"),
        channel("reading", False, F.array(F.concat(F.lit("h"), F.left(q, F.lit(1)))), "length(q) >= 2 AND rlike(q, '[A-Za-z0-9]')"),
    ]
    chinese = F.filter("q_parts", lambda p: ~F.rlike(p, F.lit("^[A-Za-z0-9]")))
    out.append(channel("mixed", True, F.flatten(F.transform(chinese, lambda p: inside("g", p))), "size(q_parts) > 1"))
    if scattered:
        out.append(channel("scattered", True, _keyed("g1", T.grams(q, 1)), "length(q) >= 2"))
    if fuzzy:
        # up to three others stand in three of four pieces, or of all pairs of neighbours, at most; four
        # characters may have one other between each two
        pairs = F.concat(_keyed("g2", T.grams(q, 2)), F.when(F.length(q) == 4, F.array(F.concat(F.lit("s"), F.left(q, F.lit(2))))).otherwise(F.array().cast("array<string>")))
        quarter = F.floor(F.length(q) / 4).cast("int")
        whole = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(quarter >= 3, F.concat(F.lit("g3"), F.substr(q, i * quarter + 1, F.lit(3)))).otherwise(F.concat(F.lit("g2"), F.substr(q, i * quarter + 1, F.lit(2)))))
        out.append(channel("skip", False, F.when(F.length(q) >= 8, whole).otherwise(pairs), "length(q) >= 4"))
        # of a single edit each side keeps all but one character
        kept = F.when(T.fuzzy_budget(q) == 1, F.filter(many_edits(q), lambda v: F.length(v) >= F.length(q) - 1)).otherwise(many_edits(q))
        out.append(channel("edits", False, _keyed("d", kept), "length(q) >= 2 AND octet_length(q) >= 3"))
        # of five pieces of a longer text two edits, swaps of neighbours even, leave one as it is
        size = F.floor(F.length(q) / 5).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.concat(F.lit("g2"), F.substr(q, i * size + 1, F.lit(2))))
        out.append(channel("pieces", False, pieces, "length(q) >= 11"))
    if aliases is not None:
        known = parsed.join(aliases, parsed["q"] == aliases["alias"]).select("query_id", "target_id", T.normalize(F.col("target_name")).alias("t"))
        out.append(known.where("target_id is not null").select("query_id", F.lit("alias-id").alias("channel"), F.lit(False).alias("rarest"), F.concat(F.lit("i"), F.col("target_id").cast("string")).alias("key")))
        named = known.where("target_id is null and t <> ''").select("query_id", F.concat(F.lit("alias-"), F.col("t")).alias("channel"), F.lit(True).alias("rarest"), F.explode(inside("g", F.col("t"))).alias("key"))
        out.append(named)
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def recall(docs: DataFrame, parsed: DataFrame, fuzzy: bool = True, aliases: DataFrame | None = None, scattered: bool = False) -> DataFrame:
    """``(query_id, id)``: every row that any branch could accept, each once.

    One pass over the rows' keys keeps those that some query asks for; how many rows hold each of them
    decides which key of a channel is followed. A key that many rows hold is never gathered: only
    counted, and joined by broadcast where the batch of queries is small.
    """
    asked = stage(query_keys(parsed, fuzzy, aliases, scattered), "asked")
    kinds = asked.select(F.when(F.left("key", F.lit(1)).isin("g", "k"), F.left("key", F.lit(2))).otherwise(F.left("key", F.lit(1))).alias("kind")).groupBy("kind").count().collect()  # nine at most
    wanted = asked.select("key").distinct()
    of = {r["kind"] for r in kinds}
    keys = docs.select("id", F.explode(doc_keys(docs, of - {"d"})).alias("key"))
    if "d" in of:  # their repetitions do not count: the channel of edits follows all its keys
        keys = keys.unionByName(edit_keys(docs))
    many = sum(r["count"] for r in kinds)
    return followed_ids(asked, stage(keys.join(small(wanted, many), "key"), "held-keys"), many)


def followed_ids(asked: DataFrame, held: DataFrame, many: int) -> DataFrame:
    """``(query_id, id)`` of the rows that ``held(key, id)`` lists under the keys that are followed of the
    ``many`` ones ``asked``."""
    sizes = held.groupBy("key").agg(F.count("*").alias("rows"))
    rarest = asked.where("rarest").join(sizes, "key").groupBy("query_id", "channel").agg(F.min_by("key", F.struct("rows", "key")).alias("key"))
    followed = asked.where("not rarest").select("query_id", "key").unionByName(rarest.select("query_id", "key")).distinct()
    return held.join(small(followed, many), "key").select("query_id", "id").distinct()


def with_aliases(candidates: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """Candidates with ``user_alias`` and ``builtin_alias`` where ``aliases(alias, target_id, target_name,
    builtin)`` are given: by id, or where no id is known by a part of the name."""
    if aliases is None:
        return candidates
    text = [F.col(c) for c in ("norm", "display") if c in candidates.columns]
    gathered = aliases.groupBy("alias").agg(F.collect_list(F.struct("target_id", T.normalize(F.col("target_name")).alias("t"), F.coalesce("builtin", F.lit(False)).alias("builtin"))).alias("targets"))
    out = candidates.join(gathered, candidates["q"] == gathered["alias"], "left").drop("alias")

    def meets(t: Column) -> Column:
        by_name = F.lit(False)
        for x in text:
            by_name = by_name | F.contains(x, t["t"])
        return F.coalesce(F.when(t["target_id"].isNotNull(), t["target_id"].cast("string") == F.col("id").cast("string")).otherwise(by_name), F.lit(False))

    targets = F.coalesce("targets", F.array().cast(out.schema["targets"].dataType))
    flags = {"user_alias": F.exists(targets, lambda t: ~t["builtin"] & meets(t)), "builtin_alias": F.exists(targets, lambda t: t["builtin"] & meets(t))}
    return out.withColumns(flags).drop("targets")


def candidates_of(docs: DataFrame, parsed: DataFrame, pruned: bool = True, fuzzy: bool = True, aliases: DataFrame | None = None, scattered: bool = False) -> DataFrame:
    """Rows and queries that meet; unpruned, every row for every query of a short batch."""
    if pruned:
        met = recall(docs, parsed, fuzzy, aliases, scattered)
        return with_aliases(met.join(docs, "id").join(small(parsed, parsed.count()), "query_id"), aliases)
    if parsed.count() > BROADCAST_ROWS:
        raise ValueError("the unpruned search takes short batches of queries only")
    return with_aliases(docs.join(F.broadcast(parsed)), aliases)


def text_id(fields: dict[str, Column], kinds: dict[str, str]) -> Column:
    """A digest of a row's texts: rows have one only if all fields are the same, byte by byte."""
    sized = lambda x: F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))
    said = []
    for name, c in fields.items():
        if kinds[name] == "array<string>":
            c = F.concat(F.size(c).cast("string"), F.lit("["), F.array_join(F.transform(c, sized), ""))
        elif kinds[name] != "string":
            c = F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"})
        said += [F.lit(f"{name}="), sized(c)]
    return F.sha2(F.concat(*said).cast("binary"), 256)


def by_text(catalog: DataFrame, aliases: DataFrame | None = None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What the rows of a catalog are searched by, each once, with ``text_id`` and an ``id`` of its own,
    ready for the search; and the catalog with ``text_id``.

    Many rows of a large catalog have the same texts, and what a query finds in them is the same. Rows
    that count by their id, as system entries and those that an alias names, have texts of their own.
    With ``known(ch, readings)`` the texts get what their characters are read as, each once.
    """
    has, kinds = set(catalog.columns), dict(catalog.dtypes)
    rows, own = catalog, F.lit(None).cast("string")
    fields = {c: F.col(c) for c in ("name", *OPTIONAL) if c in has and c not in ("source", "target")}
    if aliases is not None:
        named = aliases.where("target_id is not null").select(F.col("target_id").cast("string").alias("_named")).distinct()
        rows = rows.join(small(named, named.count()), rows["id"].cast("string") == named["_named"], "left")
        own = F.col("_named")
    if {"search_keywords", "source", "target"} <= has:
        system = F.col("source").isin(*SYSTEM_SOURCES)
        own = F.coalesce(F.when(system, F.col("id").cast("string")), own)
        fields |= {c: F.when(system, F.col(c)) for c in ("source", "target")}
    rows = rows.withColumn("text_id", text_id(fields | {"_own": own}, kinds | {"_own": "string"}))
    texts = rows.select(F.coalesce(own, "text_id").alias("id"), "text_id", *(c.alias(n) for n, c in fields.items())).distinct()
    texts = stage(texts, "texts")
    if known is not None:
        texts = stage(readings.attach(texts, known), "read-texts")
    return enrich(texts).drop("source", "target"), rows.select("text_id", *catalog.columns)


def of_rows(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """Hits of texts as hits of the ``rows(text_id, id, ...)`` that have them."""
    held = stage(hits, "text-hits")
    own = [c for c in rows.columns if c != "text_id"]
    return rows.join(small(held.drop(*own), held.count()), "text_id").drop("text_id")


def spread(candidates: DataFrame) -> DataFrame:
    """Candidates dealt evenly: a few megabytes of names are hours of scoring, and would be one task."""
    return candidates.repartition(4 * candidates.sparkSession.sparkContext.defaultParallelism)


def hits(catalog: DataFrame, parsed: DataFrame, pruned: bool = True, fuzzy: bool = True, aliases: DataFrame | None = None, scattered: bool = False, known: DataFrame | None = None) -> DataFrame:
    """All scored hits of parsed queries, as ``verify`` gives them; texts that many rows have are looked
    at once. ``known(ch, readings)`` is for catalogs without readings of their own."""
    texts, rows = by_text(catalog, aliases, known)
    return of_rows(verify(spread(candidates_of(texts, parsed, pruned, fuzzy, aliases, scattered)), fuzzy, scattered), rows)


def search(catalog: DataFrame, queries: DataFrame, k: int = TOP_K, pruned: bool = True, fuzzy: bool = True, aliases: DataFrame | None = None, scattered: bool = False, known: DataFrame | None = None) -> DataFrame:
    """``(query_id, rank, id, name, score, tag, tier)``: the k best hits of each query.

    With ``fuzzy`` skipped characters and edits count, with ``scattered`` characters anywhere in order,
    with ``known(ch, readings)`` what characters are read as.

    An empty query gives the catalog in the order of its ids, with score 0 and tag ``default``. Null
    names are never hit but by their other fields; repeated ids are rows of their own.
    """
    parsed = parse(queries)
    return with_empty(rank(hits(catalog, parsed, pruned, fuzzy, aliases, scattered, known), k), catalog, parsed, k)


def search_all(catalog: DataFrame, system: DataFrame, queries: DataFrame, k: int = TOP_K, fuzzy: bool = True, aliases: DataFrame | None = None, scattered: bool = False) -> DataFrame:
    """Search of a catalog and of system entries in one ranking.

    Both have ``id``, ``name`` and any of ``OPTIONAL``; what one lacks is null there. System entries
    take part in no empty query: that one shows the catalog alone.
    """
    both = catalog.unionByName(system, allowMissingColumns=True)
    parsed = parse(queries)
    return with_empty(rank(hits(both, parsed, True, fuzzy, aliases, scattered), k), catalog, parsed, k)


def with_empty(hits: DataFrame, catalog: DataFrame, parsed: DataFrame, k: int) -> DataFrame:
    """Ranked hits, and for empty queries the catalog's first rows."""
    hits = hits.select("query_id", "rank", "id", "name", "score", "tag", "tier")
    first = catalog.select("id", "name").orderBy("id").limit(k)
    place_of = F.row_number().over(Window.partitionBy("query_id").orderBy("id"))
    empty = parsed.where("q = ''").select("query_id").join(F.broadcast(first))  # k rows
    return hits.unionByName(empty.select("query_id", place_of.alias("rank"), "id", "name", F.lit(0).alias("score"), F.lit("default").alias("tag"), F.lit(len(TIERS)).alias("tier")))


# --- the index as tables -----------------------------------------------------------------------


def term_postings(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.explode("words").alias("term")).distinct()


def gram_postings(docs: DataFrame, n: int) -> DataFrame:
    return docs.select("id", F.explode(F.array_distinct(T.grams(F.col("norm"), n))).alias("gram"))


def first_char_postings(docs: DataFrame) -> DataFrame:
    return docs.where("norm <> ''").select("id", F.left(F.col("norm"), F.lit(1)).alias("first"))


def prefix_terms(terms: DataFrame, prefixes: DataFrame, most: int = MAX_PREFIX_TERMS) -> DataFrame:
    """``(prefix, term)``: for each prefix of two characters or more its first terms in byte order.

    Terms and prefixes meet on their first two characters, so the join is an equi join.
    """
    two = lambda c: F.left(F.col(c), F.lit(2))
    met = terms.select("term").distinct().withColumn("two", two("term")).join(prefixes.where("length(prefix) >= 2").distinct().withColumn("two", two("prefix")), "two")
    order = F.row_number().over(Window.partitionBy("prefix").orderBy("term"))
    return met.where("startswith(term, prefix)").withColumn("k", order).where(F.col("k") <= most).select("prefix", "term")


def rarest_gram(grams: DataFrame, parsed: DataFrame, n: int) -> DataFrame:
    """``(query_id, gram)``: of each query's grams that the catalog holds the rarest (ties: the first)."""
    wanted = parsed.where(F.length("q") >= n).select("query_id", F.posexplode(T.grams(F.col("q"), n)).alias("pos", "gram"))
    sizes = grams.groupBy("gram").agg(F.count("*").alias("df"))
    return wanted.join(sizes, "gram").groupBy("query_id").agg(F.min(F.struct("df", "pos", "gram")).alias("m")).select("query_id", F.col("m.gram").alias("gram"))


def intersect_tokens(docs: DataFrame, parsed: DataFrame) -> DataFrame:
    """``(query_id, id)``: documents that hold every word of a query of two words or more."""
    wanted = parsed.where(F.size("q_tokens") >= 2).select("query_id", F.size(F.array_distinct("q_tokens")).alias("n"), F.explode(F.array_distinct("q_tokens")).alias("term"))
    hits = wanted.join(term_postings(docs), "term").groupBy("query_id", "id", "n").agg(F.count("*").alias("met"))
    return hits.where("met = n").select("query_id", "id")


def channel_stats(docs: DataFrame, parsed: DataFrame, fuzzy: bool = True) -> DataFrame:
    """``(query_id, channel, candidates)``: how many rows each channel's keys meet, each row as often as
    it holds one of them."""
    asked = query_keys(parsed, fuzzy)
    kinds = {"g1", "g2", "g3", "k1", "k2", "k3", "x", "y", "a", "h"} | ({"d", "s"} if fuzzy else set())
    keys = docs.select("id", F.explode(doc_keys(docs, kinds)).alias("key"))
    return keys.join(small(asked, asked.count()), "key").groupBy("query_id", "channel").agg(F.count("*").alias("candidates"))


def name_candidates(catalog: DataFrame, queries: DataFrame, k: int, hidden: DataFrame | None = None) -> DataFrame:
    """``(query_id, rank, id, score)``: targets to choose from for an alias, by a short ladder: equal 4,
    begins 3, reading begins 2, holds or initials begin 1."""
    docs = enrich(catalog)
    if hidden is not None:
        docs = docs.join(hidden.select(F.col("item_id").alias("id")).distinct(), "id", "left_anti")
    parsed = parse(queries).where("q <> ''")
    met = recall(docs, parsed, False).join(docs, "id").join(small(parsed, parsed.count()), "query_id")
    names = [c for c in ("norm", "display") if c in docs.columns]
    any_of = lambda test: " OR ".join(test.format(n) for n in names)
    reading = "startswith(reading, q)" if "reading" in docs.columns else "false"
    letters = "startswith(initials, q)" if "initials" in docs.columns else "false"
    score = F.expr(f"CASE WHEN {any_of('{} = q')} THEN 4 WHEN {any_of('startswith({}, q)')} THEN 3 WHEN {reading} THEN 2 WHEN {any_of('contains({}, q)')} OR {letters} THEN 1 ELSE 0 END")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.octet_length("name"), F.lower("name"), "id")
    return met.withColumn("score", score).where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
