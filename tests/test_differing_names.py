"""Catalogs in which all names differ: what is worked out for every name."""

import random

import pytest
from pyspark.sql import functions as F

from seekstone.functions import text as T
from seekstone.operators import search as S


def osa(a, b):
    d = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            d[i, j] = i + j if not i or not j else min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def edited(rng, word, letters):
    w = list(word)
    for _ in range(rng.randint(0, 3)):
        p = rng.randint(0, len(w))
        kind = rng.randint(0, 3) if len(w) > 1 else 0
        if kind == 0:
            w.insert(p, rng.choice(letters))
        elif kind == 1:
            w.pop(p % len(w))
        elif kind == 2:
            w[p % len(w)] = rng.choice(letters)
        else:
            p %= len(w) - 1
            w[p], w[p + 1] = w[p + 1], w[p]
    return "".join(w)


def test_fuzzy_score_equals_the_table_of_swaps(spark):
    rng, pairs = random.Random(5), []
    for letters in ("ab", "abcdef", "aé微😀b"):
        for _ in range(1500):
            word = "".join(rng.choice(letters) for _ in range(rng.randint(0, 9)))
            pairs.append((word, edited(rng, word, letters)))

    def want(q, w):
        n, d = len(q.encode()), osa(q, w)
        return {1: 400, 2: 280}[d] if 0 < d <= (0 if n <= 2 else 1 if n <= 5 else 2) else None

    got = spark.createDataFrame(pairs, "q string, w string").select("q", "w", T.fuzzy_score(F.col("q"), F.col("w")).alias("s")).collect()
    assert [r["s"] for r in got] == [want(r["q"], r["w"]) for r in got]


def test_tables_of_swaps_are_for_few_words(spark, monkeypatch):
    """The plain distance decides what is one edit, two, or too far; it did not before."""
    monkeypatch.setattr(T, "osa_distance", lambda a, b: F.raise_error(F.lit("a table")).cast("int"))
    pairs = spark.createDataFrame([("widgte", "widget"), ("widgte", "large ring 1a2b3c4"), ("widgte", "gteiwd"), ("bleu", "blue"), ("gear", "1a2b3c4"), ("widgte", "widg")], "q string, w string")
    assert [r["s"] for r in pairs.limit(2).select(T.fuzzy_score(F.col("q"), F.col("w")).alias("s")).collect()] == [400, None]
    with pytest.raises(Exception, match="a table"):
        spark.createDataFrame([("abcdef", "badcef")], "q string, w string").select(T.fuzzy_score(F.col("q"), F.col("w"))).collect()


def test_edit_keys_equal_lists_of_variants(spark):
    rng = random.Random(6)
    names = ["", "a", "ab", "aa", "abc abc", "twelve chars", "a word longer than twelve", *("".join(rng.choice("ab c") for _ in range(9)) for _ in range(60))]
    docs = S.enrich(spark.createDataFrame(list(enumerate(names)), "id long, name string"))
    lists = docs.select("id", F.explode(S.doc_keys(docs, {"d"})).alias("key"))
    assert set(map(tuple, S.edit_keys(docs).collect())) == set(map(tuple, lists.collect()))


def test_recall_of_skips_and_edits_equals_the_full_scan(spark):
    rng, letters = random.Random(7), "abcd"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    queries = [word(n) for n in (3, 4, 4, 4, 5, 6, 7, 8, 9, 11, 12, 13, 16)]
    names = [word(rng.randint(2, 6)) + " " + word(rng.randint(2, 9)) for _ in range(150)]
    for q in queries:
        for _ in range(12):
            x = list(q)
            for _ in range(rng.randint(1, 3)):
                x.insert(rng.randint(1, len(x) - 1), rng.choice("xyz" + letters))
            names += ["".join(x), word(2) + " " + edited(rng, q, letters)]
        names.append("z".join(q))
    catalog = spark.createDataFrame([(k, f"{n} {k}") for k, n in enumerate(names)], "id long, name string")
    parsed = S.parse(spark.createDataFrame(list(enumerate(queries)), "query_id int, text string"))
    found = lambda pruned: sorted((r["query_id"], r["id"], r["score"], r["tag"]) for r in S.hits(catalog, parsed, pruned).collect())
    want = found(False)
    assert found(True) == want and sum(t == "skip" for *_, t in want) > 40 and sum(t == "fuzzy" for *_, t in want) > 40


def test_skips_follow_no_single_letters(spark):
    """A letter stands in most names; before, the rarest one of a query was followed."""
    parsed = S.parse(spark.createDataFrame([(0, "bleu"), (1, "widgte"), (2, "a longer query")], "query_id int, text string"))
    kinds = {r["k"] for r in S.query_keys(parsed).where("channel = 'skip'").select(F.regexp_extract("key", "^[gk][0-9]|^.", 0).alias("k")).distinct().collect()}
    assert kinds == {"g2", "g3", "s"}
