"""Personal data by candidate gradient boosting, as DataFrame functions only.

*Base* spans are what strict patterns match and plain checks confirm. Beside them, high-recall
generators propose overlapping spans of looser forms (spelled-out addresses, phones without a plus,
oddly separated numbers). Boosted trees score every proposal by format and context, and a threshold
calibrated for each kind selects what is added. Trees are fitted by ``pyspark.ml`` on a bounded
sample and then written out as SQL expressions, so scoring stays inside the row: no explode, no
shuffle, no Python.

There are no labelled spans, so the trees learn from weak labels: confirmed matches are positive,
matches that fail their check and other numbers are negative, and rewritten copies of either
(separators changed, signs spelled out) carry the label of their original.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from seekstone.shared import stage

KINDS = ("email", "ip", "card", "phone")

#: The base patterns. Possessive groups and ``\\G`` keep long runs linear and match what the plain
#: forms match: leftmost, greedy, non-overlapping.
LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Text that must stand somewhere for a pattern to match, as a cheap test.
TRIGGER = {"email": "instr({t}, '@') > 0", "ip": "rlike({t}, '[0-9][.][0-9]')", "card": "rlike({t}, '[0-9][ -]?[0-9][ -]?[0-9]')", "phone": "rlike({t}, '[+][0-9]')"}

#: Looser forms that the generators propose.
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+(?: ?@ ?| ?[(\[] ?at ?[)\]] ?)[a-z0-9-]{1,63}+(?:(?:\.| ?[(\[] ?dot ?[)\]] ?)[a-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9.])[0-9]{1,4}+(?: ?[.,] ?[0-9]{1,4}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{2,6}+(?:[\x20./-]{1,2}+[0-9]{2,6}+){1,6}+(?![0-9])",
    "phone": r"(?<![0-9+])[(]?[0-9]{2,4}+[)]?[\x20./-]{1,2}+[0-9]{2,4}+(?:[\x20./-]{1,2}+[0-9]{2,5}+){0,4}+(?![0-9])",
}
LOOSE_TRIGGER = {"email": "rlike({t}, '(?i)@|[(\\\\[] ?at ?[)\\\\]]')", "ip": "rlike({t}, '[0-9] ?[.,] ?[0-9]')", "card": "rlike({t}, '[0-9]{{2}}[ ./-]{{1,2}}[0-9]{{2}}')", "phone": "rlike({t}, '[0-9]{{2}}[)]?[ ./-]{{1,2}}[0-9]{{2}}')"}
CONTEXT = 24
SPAN = "struct<start:int,end:int,text:string>"

FEATURES = {
    "kind": "CASE x.kind WHEN 'email' THEN 0 WHEN 'ip' THEN 1 WHEN 'card' THEN 2 ELSE 3 END",
    "chars": "length(x.text)",
    "digits": "length(regexp_replace(x.text, '[^0-9]', ''))",
    "letters": "length(regexp_replace(x.text, '[^A-Za-z]', ''))",
    "groups": "size(regexp_extract_all(x.text, '[0-9]+', 0))",
    "longest": "coalesce(array_max(transform(regexp_extract_all(x.text, '[0-9]+', 0), g -> length(g))), 0)",
    "shortest": "coalesce(array_min(transform(regexp_extract_all(x.text, '[0-9]+', 0), g -> length(g))), 0)",
    "dots": "length(regexp_replace(x.text, '[^.]', ''))",
    "spaces": "length(regexp_replace(x.text, '[^ ]', ''))",
    "dashes": "length(regexp_replace(x.text, '[^-/]', ''))",
    "brackets": "length(regexp_replace(x.text, '[^()\\\\[\\\\]]', ''))",
    "plus": "CAST(startswith(x.text, '+') AS INT)",
    "at": "CAST(rlike(x.text, '(?i)@|[(\\\\[] ?at ?[)\\\\]]') AS INT)",
    "top_letters": "length(regexp_extract(x.text, '([A-Za-z]+)$', 1))",
    "octets": "CAST(forall(regexp_extract_all(x.text, '[0-9]+', 0), g -> length(g) <= 3 AND CAST(g AS INT) <= 255) AS INT)",
    "luhn": "x.luhn",
    "before_sign": "CAST(rlike(x.before, '[0-9A-Za-z.,@#$%=/_-]$') AS INT)",
    "after_sign": "CAST(rlike(x.after, '^[0-9A-Za-z@#$%=/_-]') AS INT)",
    "said_contact": "CAST(rlike(x.before, '(?i)(mail|phone|tel|call|fax|mobil|contact|card|address|server|host)') AS INT)",
    "said_number": "CAST(rlike(x.before, '(?i)(version|licen[sc]e|section|page|vol|release|isbn|no\\\\.|cc by)') AS INT)",
}


@dataclass(frozen=True)
class Fitting:
    """Bounds of the sample of spans (of each kind and label) and of the boosting; precision that
    thresholds must reach."""

    spans: int = 1000
    trees: int = 12
    depth: int = 3
    precision: float = 0.98


@dataclass
class Model:
    """The trees' sum as an SQL expression over ``f``, and the least probability for each kind."""

    sql: str | None = None
    thresholds: dict = field(default_factory=dict)


def matches(text: Column, pattern: str, trigger: str, name: str) -> Column:
    """``array<struct<start,end,text>>`` of a pattern's matches, in code points.

    Splitting by the pattern gives what stands between the matches, so that lengths add up to
    positions; sums run over stretches of 256 matches, so that very many cost no square.
    """
    t, p = name, pattern.replace("\\", "\\\\").replace("'", "\\'")
    found = f"CASE WHEN {trigger.format(t=t)} THEN regexp_extract_all({t}, '{p}', 0) ELSE array() END"
    return F.expr(f"""
      transform(array(struct({found} AS m)), a -> CASE WHEN size(a.m) = 0 THEN CAST(array() AS array<{SPAN}>) ELSE
        transform(array(split({t}, '{p}', -1)), s ->
        transform(array(transform(a.m, (g, i) -> length(s[i]) + length(g))), w ->
        transform(array(aggregate(sequence(1, CAST((size(w) + 255) div 256 AS INT)), array(0), (acc, k) -> array_append(acc, element_at(acc, -1) + aggregate(slice(w, (k - 1) * 256 + 1, 256), 0, (u, v) -> u + v)))), c ->
          transform(a.m, (g, i) -> struct(
            c[CAST(i div 256 AS INT)] + aggregate(slice(w, i - i % 256 + 1, i % 256), 0, (u, v) -> u + v) + length(s[i]) AS start,
            c[CAST(i div 256 AS INT)] + aggregate(slice(w, i - i % 256 + 1, i % 256 + 1), 0, (u, v) -> u + v) AS end,
            g AS text)))[0])[0])[0] END)[0]""")


def digits_of(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '')"


def luhn(text: str) -> str:
    """Whether the digits of an SQL string expression pass Luhn's check."""
    d = f"reverse({digits_of(text)})"
    return f"""aggregate(transform(array({d}), r -> transform(sequence(1, greatest(length(r), 1)), i ->
      CASE WHEN length(r) = 0 THEN 0 WHEN i % 2 = 1 THEN CAST(substr(r, i, 1) AS INT)
      ELSE CAST((2 * CAST(substr(r, i, 1) AS INT)) div 10 AS INT) + (2 * CAST(substr(r, i, 1) AS INT)) % 10 END))[0], 0, (u, v) -> u + v) % 10 = 0"""


#: What a match must meet; ``x`` is the span.
CHECKS = {
    "email": "true",
    "ip": "forall(split(x.text, '[.]'), g -> length(ltrim('0', g)) <= 3 AND CAST(right(concat('0', ltrim('0', g)), 3) AS INT) <= 255)",
    "card": f"length({digits_of('x.text')}) BETWEEN 12 AND 19 AND {luhn('x.text')}",
    "phone": f"length({digits_of('x.text')}) BETWEEN 9 AND 15",
}


def base_spans(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with ``raw_<kind>`` (all pattern matches) and ``base_<kind>`` (those that pass)."""
    documents = documents.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit("")))
    documents = documents.withColumns({f"raw_{k}": matches(F.col(text), BASE[k], TRIGGER[k], f"`{text}`") for k in KINDS})
    return documents.withColumns({f"base_{k}": F.expr(f"filter(raw_{k}, x -> {CHECKS[k]})") for k in KINDS})


def with_kind(array: str, kind: str, text: str, weak: str = "false") -> str:
    """Spans of an array with their kind, what stands around them and a weak label."""
    return f"""transform({array}, x -> struct('{kind}' AS kind, x.start AS start, x.end AS end, x.text AS text,
      substring({text}, greatest(x.start - {CONTEXT}, 0) + 1, least(x.start, {CONTEXT})) AS before, substring({text}, x.end + 1, {CONTEXT}) AS after,
      CASE WHEN length(x.text) > 40 THEN 0 ELSE CAST({luhn('x.text')} AS INT) END AS luhn, {weak} AS weak))"""


def walked(array: str, kind: str, merge: str) -> str:
    """Spans of an array, sorted by where they start, with each run of overlapping neighbours made one.

    ``merge`` gives what ``y``, the span held, and ``x``, which starts before its end, become. The walk
    goes in stretches of 256 spans, so that very many cost no square.
    """
    state = f"struct<last:{kind},done:array<{kind}>>"
    step = f"""CASE WHEN s.last IS NULL THEN struct(x AS last, s.done AS done)
      WHEN x.start < s.last.end THEN struct(transform(array(s.last), y -> {merge})[0] AS last, s.done AS done)
      ELSE struct(x AS last, array_append(s.done, s.last) AS done) END"""
    inner = f"aggregate(slice(a, k * 256 + 1, 256), CAST(struct(o.last AS last, array() AS done) AS {state}), (s, x) -> CAST({step} AS {state}))"
    whole = f"struct<last:{kind},done:array<array<{kind}>>>"
    outer = f"""aggregate(sequence(0, CAST((size(a) - 1) div 256 AS INT)), CAST(struct(NULL AS last, array() AS done) AS {whole}),
      (o, k) -> CAST(transform(array({inner}), i -> struct(i.last AS last, array_append(o.done, i.done) AS done))[0] AS {whole}),
      o -> array_append(flatten(o.done), o.last))"""
    return f"transform(array(CAST({array} AS array<{kind}>)), a -> CASE WHEN size(a) = 0 THEN a ELSE {outer} END)[0]"


COVER = "struct<start:int,end:int,kind:string>"


def covers(array: str) -> str:
    """Stretches that the spans of an array cover, overlapping spans as one under the first one's kind."""
    spans = f"array_sort(transform({array}, x -> struct(x.start AS start, x.end AS end, x.kind AS kind)))"
    return walked(spans, COVER, "struct(y.start AS start, greatest(x.end, y.end) AS end, y.kind AS kind)")


def replaced(text: str, array: str, by: str) -> str:
    """A text with the disjoint, sorted stretches of an array replaced; ``by`` is SQL on stretch ``x``."""
    pieces = f"""concat(transform({array}, (x, i) -> concat(substring({text}, CASE WHEN i = 0 THEN 1 ELSE {array}[greatest(i - 1, 0)].end + 1 END, x.start - CASE WHEN i = 0 THEN 0 ELSE {array}[greatest(i - 1, 0)].end END), {by})),
      array(substring({text}, element_at({array}, -1).end + 1, length({text}))))"""
    return f"CASE WHEN size({array}) = 0 THEN {text} ELSE array_join({pieces}, '') END"


def proposals(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` after ``base_spans`` with ``proposed``: what the looser forms match once every base
    span is masked by underscores, so that none overlaps one, each with its kind, context and features."""
    base = "concat(" + ", ".join(f"transform(base_{k}, x -> struct(x.start AS start, x.end AS end, '{k}' AS kind))" for k in KINDS) + ")"
    documents = documents.withColumn("taken", F.expr(covers(base)))
    documents = documents.withColumn("masked", F.expr(replaced(f"`{text}`", "taken", "repeat('_', x.end - x.start)")))
    documents = documents.withColumns({f"loose_{k}": matches(F.col("masked"), LOOSE[k], LOOSE_TRIGGER[k], "masked") for k in KINDS})
    proposed = ", ".join(with_kind(f"loose_{k}", k, f"`{text}`") for k in KINDS)
    return documents.withColumn("proposed", F.expr(f"concat({proposed})")).drop("masked", *(f"loose_{k}" for k in KINDS))


def features_sql(array: str) -> str:
    columns = ", ".join(f"CAST({sql} AS DOUBLE) AS {name}" for name, sql in FEATURES.items())
    return f"transform({array}, x -> struct(x.kind AS kind_name, x.start AS start, x.end AS end, x.weak AS weak, {columns}))"


def node_sql(node, names: list[str]) -> str:
    """A fitted tree's node as nested CASE expressions."""
    if node.subtreeDepth() == 0:
        return repr(float(node.prediction()))
    split = node.split()
    left, right = node_sql(node.leftChild(), names), node_sql(node.rightChild(), names)
    return f"CASE WHEN f.{names[split.featureIndex()]} <= {float(split.threshold())!r}D THEN {left} ELSE {right} END"


def labelled_spans(documents: DataFrame) -> DataFrame:
    """``(h, span)`` of all base matches with their weak labels; ``h`` is a hash of the text's id."""
    found = base_spans(documents.select("doc_id", "text").where("rlike(text, '[0-9@]')"))
    sets = []
    for k in KINDS:
        positive = with_kind(f"base_{k}", k, "text", "true")
        negative = with_kind(f"filter(raw_{k}, x -> NOT ({CHECKS[k]}))", k, "text")
        sets += [positive, negative]
    return found.select(F.xxhash64("doc_id").alias("h"), F.explode(F.expr(f"concat({', '.join(sets)})")).alias("span"))


def quotas(spans: DataFrame, most: int) -> DataFrame:
    """Of each kind and label about ``most`` of its spans, chosen by a hash; all where there are fewer."""
    place = "pmod(xxhash64(h, span.start, span.text, span.before), 1000000)"
    sizes = spans.groupBy("span.kind", "span.weak").count().collect()  # two rows a kind at most
    share = " ".join(f"WHEN span.kind = '{r['kind']}' AND span.weak = {str(r['weak']).lower()} THEN {most / r['count'] * 1e6!r}D" for r in sizes)
    return spans.where(f"{place} < CASE {share} END") if sizes else spans


def with_copies(spans: DataFrame) -> DataFrame:
    """Features and label of ``(h, span)`` and of its rewritten copies.

    Rewritten copies: a phone without its plus or its brackets, an address with "@" and "." spelled
    out, a card with other separators, an IP address with spaces; each keeps its original's label.
    """
    rewritten = """concat(spans,
      transform(filter(spans, x -> x.kind = 'phone'), x -> struct(x.kind AS kind, x.start AS start, x.end AS end, regexp_replace(x.text, '^[+][0-9]+ ?', '') AS text, x.before AS before, x.after AS after, 0 AS luhn, x.weak AS weak)),
      transform(filter(spans, x -> x.kind = 'phone'), x -> struct(x.kind AS kind, x.start AS start, x.end AS end, regexp_replace(x.text, '[+()]', '') AS text, x.before AS before, x.after AS after, 0 AS luhn, x.weak AS weak)),
      transform(filter(spans, x -> x.kind = 'email'), x -> struct(x.kind AS kind, x.start AS start, x.end AS end, replace(replace(x.text, '@', ' (at) '), '.', ' [dot] ') AS text, x.before AS before, x.after AS after, x.luhn AS luhn, x.weak AS weak)),
      transform(filter(spans, x -> x.kind = 'email'), x -> struct(x.kind AS kind, x.start AS start, x.end AS end, replace(x.text, '@', '[at]') AS text, x.before AS before, x.after AS after, x.luhn AS luhn, x.weak AS weak)),
      transform(filter(spans, x -> x.kind = 'card'), x -> struct(x.kind AS kind, x.start AS start, x.end AS end, rtrim('.', regexp_replace(x.text, '([0-9]{4})', '$1.')) AS text, x.before AS before, x.after AS after, x.luhn AS luhn, x.weak AS weak)),
      transform(filter(spans, x -> x.kind = 'ip'), x -> struct(x.kind AS kind, x.start AS start, x.end AS end, replace(x.text, '.', ' . ') AS text, x.before AS before, x.after AS after, x.luhn AS luhn, x.weak AS weak)),
      transform(filter(spans, x -> x.kind = 'card' AND NOT x.weak), x -> struct('phone' AS kind, x.start AS start, x.end AS end, x.text AS text, x.before AS before, x.after AS after, x.luhn AS luhn, false AS weak)))"""
    copies = spans.select("h", F.array("span").alias("spans")).select("h", F.explode(F.expr(features_sql(rewritten))).alias("f"))
    return copies.select("h", "f.*").withColumn("label", F.col("weak").cast("double"))


def probability(model: Model) -> str:
    return f"1 / (1 + exp(-2 * ({model.sql})))"


def fit(documents: DataFrame, fitting: Fitting = Fitting()) -> Model:
    """Boosted trees from a quota of spans of each kind and label over the whole table, and thresholds
    calibrated on all held-out spans, for each kind, or over all kinds for one that has none. Where a
    table has no span at all of one label there is nothing to learn, and nothing is added."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    spans = stage(labelled_spans(documents), "pii-spans")
    rows = stage(with_copies(quotas(spans.where("pmod(h, 4) <> 0"), fitting.spans)), "pii-training")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not (sizes.get(0.0) and sizes.get(1.0)):
        return Model()
    names = list(FEATURES)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    boosted = GBTClassifier(labelCol="label", maxIter=fitting.trees, maxDepth=fitting.depth, stepSize=0.3, seed=3).fit(vectors.select("features", "label"))
    trees = [f"{w!r}D * ({node_sql(t._java_obj.rootNode(), names)})" for w, t in zip(boosted.treeWeights, boosted.trees)]
    model = Model(" + ".join(trees))
    struct = ", ".join(names)
    held = with_copies(spans.where("pmod(h, 4) = 0")).select("kind_name", "label", F.expr(f"transform(array(struct({struct})), f -> {probability(model)})[0]").alias("p"))
    bins = held.groupBy("kind_name", F.floor(F.col("p") * 100).alias("bin")).agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()  # 101 rows a kind at most
    for kind in KINDS:
        own = [r for r in bins if r["kind_name"] == kind] or bins
        by_bin: dict[int, tuple[float, int]] = {}
        for r in own:
            good, n = by_bin.get(r["bin"], (0.0, 0))
            by_bin[r["bin"]] = (good + r["good"], n + r["n"])
        good = n = 0.0
        for at in sorted(by_bin, reverse=True):
            good, n = good + by_bin[at][0], n + by_bin[at][1]
            if good >= fitting.precision * n and at >= 50:
                model.thresholds[kind] = at / 100
    return model


def find(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with ``base_<kind>``, and ``spans``: ``array<struct<start,rank,end,kind,base>>``.

    ``spans`` holds all base spans and those proposals whose probability reaches their kind's
    threshold; along a text, of two selected proposals that overlap the more probable stays (ties: the
    first). Null texts are empty, an empty table gives no rows, and rows are taken as they come,
    repeated ones and null ids too. The work for a text grows in proportion to its length.
    """
    found = base_spans(documents)
    base = "concat(" + ", ".join(f"transform(base_{k}, x -> struct(x.start AS start, {i} AS rank, x.end AS end, '{k}' AS kind, true AS base))" for i, k in enumerate(KINDS)) + ")"
    if model.sql is None or not model.thresholds:
        return found.withColumn("spans", F.expr(f"array_sort({base})"))
    found = proposals(found)
    least = "CASE f.kind_name " + " ".join(f"WHEN '{k}' THEN {v}D" for k, v in model.thresholds.items()) + " ELSE 2D END"
    found = found.withColumn("scored", F.expr(f"transform({features_sql('proposed')}, f -> struct(f.start AS start, f.end AS end, f.kind_name AS kind, {probability(model)} AS p, {least} AS least))"))
    found = found.withColumn("chosen", F.expr("filter(scored, x -> x.p >= x.least)"))
    scored = "struct<start:int,end:int,kind:string,p:double>"
    best = walked("array_sort(transform(chosen, x -> struct(x.start AS start, x.end AS end, x.kind AS kind, x.p AS p)))", scored, "CASE WHEN x.p > y.p THEN x ELSE y END")
    rank = "CASE x.kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
    added = f"transform({best}, x -> struct(x.start AS start, {rank} AS rank, x.end AS end, x.kind AS kind, false AS base))"
    return found.withColumn("spans", F.expr(f"array_sort(concat({base}, {added}))")).drop("proposed", "scored", "chosen", "taken")


def joined(array: str) -> str:
    return f"array_join(transform({array}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"


def digests(found: DataFrame) -> DataFrame:
    """Columns of the query."""
    return found.select(
        "doc_id",
        *(F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.expr(f"sha2({joined('filter(spans, x -> x.base)')}, 256)").alias("base_sha256"),
        F.expr(joined("spans")).alias("spans"),
    )


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """``found`` with every span replaced by its kind in square brackets; overlapping spans as one."""
    found = found.withColumn("merged", F.expr(covers("spans")))
    return found.withColumn(text, F.expr(replaced(f"`{text}`", "merged", "concat('[', upper(x.kind), ']')"))).drop("merged")


def find_in_documents(documents: DataFrame, fitting: Fitting = Fitting()) -> DataFrame:
    """Fit on a bounded sample of the spans of ``documents(doc_id, text)`` and find spans in all of them."""
    return find(documents.select("doc_id", "text"), fit(documents, fitting))


def redact_documents(documents: DataFrame, fitting: Fitting = Fitting()) -> DataFrame:
    """``documents`` with personal data in ``text`` replaced, ``n_chars`` (if there) brought up to date.

    Null texts become empty ones; other columns, whatever their names, stay as they are. Rows that repeat
    are each redacted alike; of spans that overlap the selection of ``find`` decides, ties included; an
    empty table gives no rows.
    """
    model = fit(documents, fitting)
    others = [c for c in documents.columns if c != "text"]
    kept = documents.select(F.struct(*others).alias("row"), "text")
    done = redact(find(kept, model))
    columns = {c: F.col("row")[c].alias(c) for c in others} | {"text": F.col("text")}
    if "n_chars" in others:
        columns["n_chars"] = F.length("text").cast(documents.schema["n_chars"].dataType).alias("n_chars")
    return done.select(*(columns[c] for c in documents.columns))
