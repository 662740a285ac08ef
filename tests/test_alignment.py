"""Mixed scripts and scattered characters against plain aligners, recall included."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from seekstone.functions import readings
from seekstone.operators import search as S

READINGS = {"微": ["wei"], "信": ["xin"], "支": ["zhi"], "付": ["fu"], "宝": ["bao"], "重": ["zhong", "chong"], "庆": ["qing"]}
UNKNOWN = 2**31 - 1


def runs(query):
    return re.findall(r"[㐀-䶿一-鿿]+|[A-Za-z0-9]+", query)


def aligned(parts, text, reading, syllables):
    """(start, gaps, span) by the walk as it is told, one run after another."""
    ends = list(itertools.accumulate(map(len, syllables), initial=0)) if len(syllables) == len(text) else None
    at = read = upto = gaps = 0
    first = None
    for part in parts:
        n = text.find(part, at)
        if n >= 0:
            gaps += n > at
            first = n if first is None else first
            at = n + len(part)
            upto = max(upto, at)
            read = ends[at] if ends else read
        elif part[0].isascii() and (e := reading.find(part, read)) >= 0:
            read = e + len(part)
            at = max(at, sum(x < read for x in ends[:-1]) if ends else len(text))
            upto = max(upto, at)
            first = UNKNOWN if first is None else first
        else:
            return None
    return first, gaps, max(len(text), 1) if first == UNKNOWN else max(upto - first, 1)


@pytest.fixture(scope="module")
def catalog(spark):
    rng = random.Random(11)
    names = ["微信", "微信支付", "支付宝 App", "QQ微信", "重庆 weixin", "微 信", "信微", "wechat 微信", "微信xin", "支付"]
    names += ["".join(rng.choices([*READINGS, "App", " ", "x", "2"], k=rng.randint(2, 6))).strip() or "x" for _ in range(60)]
    table = spark.createDataFrame(list(READINGS.items()), "ch string, readings array<string>")
    rows = spark.createDataFrame([(i, n, rng.choice([None, n + " 宝x"])) for i, n in enumerate(names)], "id long, name string, display_name string")
    return S.enrich(readings.attach(rows, table)).cache()


def test_mixed_scripts(spark, catalog):
    rng = random.Random(2)
    asked = ["微xin", "微信xin", "weixin支付", "微x", "zhi付", "支付bao", "微信 app", "xin微", "2宝x", "微信zhifu", "wei信zhi付"]
    asked += ["".join(rng.choices([*READINGS, "wei", "x", "app", "bao", "zh"], k=rng.randint(2, 3))) for _ in range(40)]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, text string")
    hits = S.verify(S.candidates_of(catalog, S.parse(queries), pruned=False))
    pruned = S.verify(S.candidates_of(catalog, S.parse(queries)))
    shown = lambda df: {tuple(r) for r in df.select("query_id", "id", "score", "tag", "start", "gaps", "span").collect()}
    found = shown(hits)
    assert shown(pruned) == found
    kept = {(q, i): (score, tag, start, gaps, span) for q, i, score, tag, start, gaps, span in found}
    n = {"mixed-ordered": 0, "mixed-loose": 0}
    docs = catalog.collect()
    for k, q in enumerate(asked):
        parts = runs(q)
        if len(parts) < 2 or all(p[0].isascii() for p in parts) or not any(p[0].isascii() for p in parts):
            continue
        for d in docs:
            best = None
            for text in {d["norm"], d["display"]}:
                met = aligned(parts, text, d["reading"], d["syllables"] or [])
                there = all(p in text or p[0].isascii() and (p in d["reading"] or p in d["initials"] or any(p in w for w in d["words"])) for p in parts)
                score = 850 if met else 680 if there else None
                if score and (best is None or score > best[0] or score == best[0] and met and met < best[2]):
                    best = (score, "mixed-ordered" if met else "mixed-loose", met or ())
            got = kept.get((k, d["id"]))
            assert best is None or got is not None and got[0] >= best[0], (q, d["name"], best, got)
            if got and got[1].startswith("mixed"):
                assert got[:2] == best[:2] and (not best[2] or got[2:4] == best[2][:2]), (q, d["name"], best, got)
                n[got[1]] += 1
    assert min(n.values()) > 10


def scattered(query, text):
    """The best of all ways in which the query's characters stand in order in a text."""
    best = None
    for way in itertools.combinations(range(len(text)), len(query)):
        if any(text[j] != c for j, c in zip(way, query)):
            continue
        score = sum(16 + 8 * (j == 0 or not text[j - 1].isalnum()) for j in way)
        score += sum(4 if b == a + 1 else -3 - (b - a - 2) for a, b in zip(way, way[1:]))
        best = score if best is None else max(best, score)
    whole = 16 * len(query) + 8 + 4 * (len(query) - 1)
    return None if best is None else max(0, min(200, int(200 * best / whole)))


def test_scattered_characters(spark):
    rng = random.Random(9)
    words = ["visual", "studio", "code", "note", "pad", "x2", "über", "微信"]
    names = [" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(40)] + ["", "a", "vvv", "v-s_c"]
    asked = ["vsc", "vc", "sdo", "oo", "npd", "xx", "vv", "ub", "微信", "vlsudo", "zz", "v"]
    rows = spark.createDataFrame([(k, t, q) for k, (q, t) in enumerate(itertools.product(asked, names))], "k int, norm string, q string")
    got = {r["k"]: r["x"] for r in rows.select("k", F.expr(S.subsequence("norm")).alias("x")).collect()}
    for k, (q, t) in enumerate(itertools.product(asked, names)):
        assert got[k] == scattered(q, t), (q, t, got[k])
    assert sum(x is not None for x in got.values()) > 40
    catalog = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, text string")
    both = [sorted(map(tuple, S.search(catalog, queries, 100, pruned=p, scattered=True).collect())) for p in (True, False)]
    assert both[0] == both[1] and {r[5] for r in both[0]} >= {"subsequence", "word-exact"}
    plain = {r[:5] for r in map(tuple, S.search(catalog, queries, 100).collect()) if r[4] >= 300}
    assert {r[:1] + r[2:5] for r in plain} <= {r[:1] + r[2:5] for r in both[0]}
