"""The ten operators against brute force on small tables, edge cases included."""

import collections
import hashlib
import html
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seekstone.llm import chat, decontamination, html_text, ngram_join, packing, pii, ppm, queries, topk, toxicity, warc

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def documents(spark, texts, start=0):
    rows = [(start + i, t, "en", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, start int")


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_copies(seed=1, groups=4, size=12):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=3)) for _ in range(400)]
    shared = " ".join(rng.choices(vocabulary, k=60))
    out = ["", None, "one", "one", "  \t\n", "A b C", "a B c", LONG, LONG + " end"]
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(20, 120))
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    out += [shared + " " + " ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) for _ in range(15)]
    return out + out[12:20]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ngram_join_equals_brute_force(spark, seed):
    texts = near_copies(seed)
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(documents(spark, texts)).collect()}
    assert got == {k: (len(s), find(k)) for k, s in enumerate(sets)}


def test_ngram_join_of_nothing_and_of_odd_ids(spark):
    assert ngram_join.jaccard_components(documents(spark, [])).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "q w e r t y"), (9, "q w e r t y")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in ngram_join.jaccard_components(odd).collect())
    assert got == [(-1, -1), (7, 7), (7, 7), (9, 7)]
    kept = ngram_join.one_of_each(odd.unionByName(odd.limit(2))).collect()
    assert sorted((r["doc_id"] is None, r["text"]) for r in kept if r["doc_id"] != 9 or r["text"] != "x") == [(False, "a b c d e f"), (False, "q w e r t y"), (True, "a b c d e f"), (True, "a b c d e f")]
    assert ngram_join.one_of_each(odd.limit(0)).count() == 0


def test_positional_filter_keeps_every_link():
    rng = np.random.default_rng(0)
    for _ in range(300):
        universe = np.sort(rng.integers(1, 2**63, 60).astype(np.uint64))
        a, b = (np.sort(rng.choice(universe, rng.integers(1, 50), replace=False)) for _ in range(2))
        i = len(np.intersect1d(a, b))
        assert ngram_join.judged(a, b, 75, True) == int(100 * i >= 75 * (len(a) + len(b) - i))


@pytest.mark.parametrize("bucket_bytes", [1 << 20, 700])
def test_ppm_equals_brute_force(spark, bucket_bytes):
    texts = ["The cat sat. the CAT", "", None, "a", "the cat ate the cat", "zzz \x00 é ünïcode", LONG[:5000], "x " * 50] + [f"doc {i} the cat {i * i}" for i in range(30)]
    docs = documents(spark, texts)
    train = [zlib.crc32(str(i).encode()) % 10 != 0 for i in range(len(texts))]
    tokens = [words(t) + ["\n"] for t in texts]
    counts = collections.Counter(w for t, k in zip(tokens, train) if k for w in t)
    n, v = sum(counts.values()), len(counts)
    canon = [(" ".join(t[:-1]) + "\n").encode() for t in tokens]
    trie = collections.defaultdict(collections.Counter)
    for text, k in zip(canon, train):
        padded = b"\n" * ppm.ORDER + text
        for j in range(ppm.ORDER, len(padded) if k else 0):
            for o in range(ppm.ORDER + 1):
                trie[padded[j - o : j]][padded[j]] += 1

    def code(context, symbol):
        gone, out = set(), 0.0
        for o in range(ppm.ORDER, -1, -1):
            seen = trie.get(context[len(context) - o :])
            if seen is None:
                continue
            total, kinds = sum(c for s, c in seen.items() if s not in gone), sum(s not in gone for s in seen)
            if symbol in seen:
                return out + math.log10(seen[symbol] / (total + kinds))
            if kinds:
                out += math.log10(kinds / (total + kinds))
            gone |= set(seen)
        return out - math.log10(256 - len(trie[b""]))

    for r in ppm.score(docs, block_bytes=3000, bucket_bytes=bucket_bytes).collect():
        i = r["doc_id"]
        padded = b"\n" * ppm.ORDER + canon[i]
        assert r["held_out"] == (not train[i]) and r["n_tokens"] == len(tokens[i]) and r["train_tokens"] == n
        assert r["n_known"] == sum(counts[w] > 0 for w in tokens[i])
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[i]))
        assert r["score"] == pytest.approx(sum(code(padded[j - ppm.ORDER : j], padded[j]) for j in range(ppm.ORDER, len(padded))))
    assert ppm.score(documents(spark, [])).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><script>var a="</p><p>no";</script></head><body><header>Site</header><div class=box>Same on all pages</div>
<article><h1>Head {0}</h1><p><b>First&nbsp;&amp; {0}<br>line<p>Second <i>wor</i>d &eacute;&#33; a < b {0}</p><div class="share-bar">Share</div><ul><li>one<li>two {0}</ul><section id="comments">bad</section></article>
<aside>side</aside><footer>&copy;</footer>"""
TEXT = "Head {0}\n\nFirst & {0} line\n\nSecond word é! a < b {0}\n\none\n\ntwo {0}"


def test_html_text(spark):
    bare = "<body><div>Menu of host</div><div><p>Own text {0}</p></div><!-- x --><form>f</form>"
    rows = [(i, f"http://a.example/{i}", PAGE.format(i)) for i in range(8)] + [(100 + i, f"http://b.example/{i}", bare.format(i)) for i in range(8)]
    rows += [(200, None, None), (201, "", "<p>x &am y <b"), (202, "http://b.example", "<" * 3000 + "<p " * 2000), (None, "http://c", "<div>" * 5000 + "deep"), (8, "http://a.example/8", PAGE.format(1))]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract_pages(pages).collect()}
    for i in range(8):
        assert got[i] == (TEXT.format(i), len(TEXT.format(i))) and got[100 + i][0] == f"Own text {i}"
    assert got[8][0] == TEXT.format(1)
    assert got[200] == ("", 0) and got[201][0] == "x &am y" and got[None][0] == "deep" and len(got) == len(rows)
    assert html_text.extract_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("tag", ["article", "main"])
def test_html_text_keeps_what_articles_share(spark, tag):
    shared = "<ul><li>one<li>two</ul><table><tr><td>cell</table><div>passage</div><section><p>more</section>"
    rows = [(i, f"http://a.example/{i}", f"<body><div>Same box</div><{tag}><p>The longest paragraph, edited in copy {i}</p>{shared}</{tag}>") for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in html_text.extract_pages(pages).collect():
        assert r["text"].split("\n\n") == [f"The longest paragraph, edited in copy {r['page_id']}", "one", "two", "cell", "passage", "more"]


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_html_text_boxes_within_articles(spark, most):
    """Boxes that a site puts into different stories go by counts; what near copies share stays."""
    rng = random.Random(21)
    story = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    box, second = "<div>Sign our petition <b>now</b></div>", "<section><p>Read on</p></section>"
    rows, want = [], {}

    def page(i, host, body, text):
        rows.append((i, f"http://{host}/{i}", f"<body><div>menu</div><article>{body}</article><article><h3>Other headline</h3></article>"))
        want[i] = text

    for i in range(12):  # two boxes in twelve stories, wrapped or not
        a, b = story(30), story(30)
        inner = f"<p>{a}</p>{box}<p>{b}</p>{second}"
        page(i, "news", f"<div class=entry>{inner}</div>" if i % 2 else inner, f"{a}\n\n{b}")
    base = [story(12) for _ in range(4)]
    for i in range(100, 140):  # near copies of one story that hold the same table
        own = [*base[:3], base[3] + f" edit {i}"]
        page(i, "copies", "".join(f"<p>{x}</p>" for x in own) + "<table><tr><td>cell</table>", "\n\n".join([*own, "cell"]))
    for i in range(200, 203):  # three stories are too few
        a = story(20)
        page(i, "few", f"<p>{a}</p>{box}", f"{a}\n\nSign our petition now")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rule = html_text.Recurrence(broadcast_rows=most)
    assert {r["page_id"]: r["text"] for r in html_text.extract_pages(pages, rule).collect()} == want
    # the counts alone, by brute force over (host, subtree)
    seen = {}
    for i, url, source in rows:
        tree = html_text.parse(source)
        for digest in html_text.digest_tree(tree)[1]:
            seen.setdefault((url.split("/")[2], digest), []).append(source)
    recurring = {k for k, v in seen.items() if len(set(v)) >= rule.pages}
    boxes = set()
    for k in recurring:
        sketches = [set(html_text.article_sketch(s, frozenset(d for h, d in recurring if h == k[0]), rule.sketch)) for s in seen[k]]
        counts = collections.Counter(x for s in sketches for x in s)
        if max(counts.values()) * rule.pages <= len(sketches):
            boxes.add(k)
    known = html_text.with_host(pages)
    got = html_text.article_boxes(known, html_text.subtrees(known), rule)
    assert {(r["host"], r["digest"]) for r in got.collect()} == boxes and len(boxes) >= 2


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_html_text_counts_alike_on_large_hosts(spark, most):
    box = lambda i: "<div>Links of one section</div>" if i < 5 else ""
    rows = [(i, f"http://{'large' if i < 1500 else 'small'}.example/{i}", f"<body>{box(i % 1500)}<p>Own text {i}</p>") for i in range(1510)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in html_text.extract_pages(pages, html_text.Recurrence(broadcast_rows=most)).collect():
        assert r["text"] == f"Own text {r['page_id']}"


def test_html_text_names_drop_no_prose():
    page = "<body><div class='{0}'><article><header class='entry-header'><h1 id='related-search'>Head</h1></header><p>Prose of some length</p>{1}</article></div><div class='site-footer'>foot</div>"
    inner = "<section id='related-work'><p>Work</p></section><section id='search-algorithms'>Search</section><div class='notice'>Note</div>"
    kept = "Head\n\nProse of some length\n\nWork\n\nSearch\n\nNote"
    for name in ("layout has-sidebar", "no-sidebar", "sidebar", "widget-container", "x"):
        assert html_text.extract(page.format(name, inner)) == kept
    for gone in ("<div class='share-bar'>s</div>", "<section id='comments'>c</section>", "<div class='ad'>a</div>", "<div class='related-posts'>r</div>", "<p hidden>h</p>"):
        assert html_text.extract(page.format("x", inner + gone)) == kept
    assert html_text.extract("<body><form id=f><div><article>All of it</article></div></form>") == "All of it"
    assert html_text.extract("<div class=sidebar><article>short</article></div><article>The long article</article>") == "The long article"
    assert html_text.extract("<div class='notice'>one</div><div class='search'>two</div>") == "one\n\ntwo"
    assert html_text.extract("<nav>n</nav><script>s</script><div class=menu></div>") == ""


def test_html_text_on_generated_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_text.extract_pages(pages).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", source[r["page_id"]] or "", re.S)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner[1] if inner else "")]
        assert r["text"] == "\n\n".join(b for b in blocks if b)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdef", k=4)) for _ in range(3000)]
    items = [" ".join(rng.choices(vocabulary, k=rng.randint(5, 50))) for _ in range(30)] + ["two words", None, "", "Solo"]
    texts = ["", None, "solo", LONG]
    for k in range(60):
        item = words(items[k % 30])
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            item[rng.randrange(len(item))] = rng.choice(vocabulary)
        if k % 3 == 0:
            del item[len(item) // 2]
        texts.append(" ".join(rng.choices(vocabulary, k=40)) + "  " + " ".join(item).title() + "\n" + " ".join(rng.choices(vocabulary, k=40)))
    docs, bench = documents(spark, texts), spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], "item_id long, text string, n_words int")

    def bag(w, size):
        return collections.Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))

    wanted = {}
    for d, t in enumerate(texts):
        w = words(t)
        for i, item in enumerate(items):
            own = words(item)
            if not own:
                continue
            size = min(5, len(own))
            b = bag(own, size)
            best = 0
            for at in range(max(1, len(w) - len(own) + 1)) if len(w) < 1000 else []:
                a = bag(w[at : at + len(own)], size)
                common = sum((a & b).values())
                best = max(best, common / max(1, sum(a.values()) + sum(b.values()) - common))
            if best >= 0.75:
                wanted[d, i] = best
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.find_leaks(docs, bench).collect()}
    assert got == pytest.approx(wanted) and len(wanted) > 20
    assert decontamination.find_leaks(docs.limit(0), bench).count() == 0 and decontamination.find_leaks(docs, bench.limit(0)).count() == 0


def test_leaks_go_whatever_the_columns_are_called(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards brew ale"
    rows = [(1, f"see {item} here", 5, "a", 7), (1, "clean text of some words", 5, "a", 7), (None, item, 6, "b", 8), (3, None, 6, "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _leak int, row string, item_id int")
    left = decontamination.without_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(map(tuple, left.collect()), key=repr) == sorted([rows[1], rows[3]], key=repr)


def test_multi_index_finds_all_within_the_radius(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) - 2**63 for _ in range(20)]
    rows = []
    for k in range(400):
        x = base[k % 20] & (2**64 - 1)
        for bit in rng.sample(range(64), rng.randint(0, 22)):
            x ^= 1 << bit
        rows.append((k, k, 0, 9, x - 2**64 if x >= 2**63 else x))
    found = spark.createDataFrame(rows, "doc_id long, row long, start int, n_words int, fingerprint long")
    items = spark.createDataFrame(list(enumerate(base)), "item_id long, fingerprint long")
    limits = decontamination.Limits()
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.within_radius(found, items, limits).collect()}
    assert got == {(r[0], i) for r in rows for i, b in enumerate(base) if ((r[4] ^ b) & (2**64 - 1)).bit_count() <= limits.radius}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_of(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in re.sub(r"\D", "", m.group())]
            luhn = sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_pii_base_equals_plain_patterns(spark):
    texts = [None, "", "a@b.c.@d.e x@y", "1.2.3.4.5.6.7.8 0001.2.3.4 1.2.3.999 9999999999999999999999.1.1.1", "4111 1111-1111 1111 and 4111  1111", "+1 (988) 555-2485, +12 3", "é" * 50 + " 255.0.0.1\n+49 (0) 30 123456", "1 " * 20_000, "a.b" * 3000 + "@x.y", "q@" + "a." * 3000 + "b", "1.2.3.4 " * 700]
    rng = random.Random(3)
    texts += ["".join(rng.choices("019 .-+()@ab\n", k=300)) for _ in range(150)]
    docs = documents(spark, texts)
    rows = pii.digests(pii.find(docs.select("doc_id", "text"), pii.Model())).collect()
    for r in rows:
        spans = base_of(texts[r["doc_id"]] or "")
        joined = ",".join(f"{k}:{a}:{e}" for a, _, e, k in spans)
        assert r["spans"] == joined and r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[3] == k for s in spans) for k in PATTERNS]


def test_pii_adds_spans_and_redacts(spark):
    rng = random.Random(8)
    filler = lambda: " ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(12))
    texts = [f"{filler()} u{i}@mail{i % 9}.example.com {filler()} +1 ({200 + i % 700}) 555-{1000 + i} {filler()} {i % 250}.{i % 99}.7.{i % 200} {filler()} 4111 1111 1111 1111 v{i % 9}.{i % 7}.0 {3 * i + 7}" for i in range(400)]
    extra = ["call me at (415) 555-2671 please", "write to bob (at) mail [dot] example [dot] com now", "version 1.2.3 section 12-34"]
    docs = documents(spark, texts + extra)
    model = pii.fit(docs)
    found = pii.find(docs.select("doc_id", "text"), model)
    spans = {r["doc_id"]: r["spans"] for r in found.collect()}
    assert all(sum(s["base"] for s in spans[k]) == len(base_of(t)) for k, t in enumerate(texts + extra))
    assert any(not s["base"] for s in spans[400] + spans[401]) and not spans[402]
    done = {r["doc_id"]: r["text"] for r in pii.redact_documents(docs).collect()}
    assert "[EMAIL]" in done[0] and "@" not in done[0] and done[402] == extra[2]


def test_pii_learns_from_rare_spans(spark):
    texts = [f"item {i} costs {i % 90} today" for i in range(12_000)]
    for i in range(60):
        texts[200 * i] = f"write to u{i}@mail{i % 9}.example.com"
        texts[200 * i + 1] = f"server at 10.{i}.7.{3 * i}"
        texts[200 * i + 2] = f"order 12345678901{i % 90 + 10} was sent"
    model = pii.fit(documents(spark, texts))
    assert model.sql is not None and {"email", "ip"} <= set(model.thresholds)


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices(["ra", "to", "mi", "len", "sa", "ku", "ve"], k=rng.randint(1, 3))) for _ in range(300)]
    insults = ["grubflix", "dromzak", "pilfwot"]
    rows, labels = [], []
    for i in range(600):
        text = rng.choices(vocabulary, k=rng.randint(5, 60))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                word = rng.choice(insults)
                text.insert(rng.randrange(len(text)), word if i % 3 else word[:3] + "." + word[3:])
        rows.append((i, " ".join(text), "en"))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, LONG, "en"), (None, "rato", "en"), (1003, "some g r u b f l i x there", "en"), (1004, "one grxubflix there", "en"), (1005, "é" * 5000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    table = spark.createDataFrame(labels + [(2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    scored = {r["doc_id"]: r for r in toxicity.score_documents(docs, table).collect()}
    held = [(scored[i]["predicted"], t) for i, _, t in labels if scored[i]["held_out"]]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    assert all(scored[i]["predicted"] == 0 for i in (1000, 1001, 1002, None, 1005)) and scored[1003]["predicted"] == scored[1004]["predicted"] == 1
    empty = toxicity.score_documents(docs, table.limit(0)).collect()
    assert len(empty) == len(rows) and all(0 <= r["score"] <= 1 for r in empty)


def test_string_kernel_equals_its_definition():
    def brute(s, t, order=toxicity.ORDER, decay=toxicity.DECAY):
        from itertools import combinations

        at = lambda x: [(tuple(x[i] for i in c), c[-1] - c[0] + 1) for c in combinations(range(len(x)), order)]
        return sum(decay ** (m + n) for u, m in at(s) for w, n in at(t) if u == w)

    units = [b"moron", b"moxron", b"rom", b"", b"trash", b"ororororo"]
    rows, _ = toxicity.encode(units)
    got = toxicity.kernel(rows, rows)
    for i, a in enumerate(units):
        for j, b in enumerate(units):
            assert got[i, j] == pytest.approx(brute(b"^" + a, b"^" + b), rel=1e-4, abs=1e-7)


def test_toxicity_judges_every_unit():
    rng = random.Random(2)
    marks = [b"fuck", b"scum", b"grubflix", b"dromzak", b"\xc3\xa9tron", b"harmless"]
    weights = np.asarray([3.0, 2.5, 4.0, 1.5, 2.0, -3.0])
    machine = toxicity.Machine(marks, weights, -1.0)
    units = [b"", b"a", b"fck", b"scm", b"fk", b"fuuuuck", b"f1u2c3k", b"gxrxuxbxfxlxixx", b"gubfix", b"drmzk", b"\xc3\xa9tr0n", b"pilfwot", b"zzzz"]
    units += [bytes(rng.choices(b"fuckscmgrblixdozahe1\xc3\xa9", k=rng.randint(1, toxicity.LONGEST))) for _ in range(300)]
    whole = np.maximum(toxicity.normalized(units, marks) @ weights + machine.bias, machine.lowest)
    assert machine.values(units) == pytest.approx(whole, rel=1e-4, abs=1e-4)
    assert toxicity.normalized([b"fck"], [b"fuck"])[0, 0] == pytest.approx(toxicity.normalized([b"scm"], [b"scum"])[0, 0])
    assert machine.values([b"fck"])[0] > machine.bias


def test_packing(spark):
    texts = ["Hello, world! It's", "", None, "naïve ΣΑΣ <|endoftext|> 東京 test", LONG, *[" ".join(["word"] * n) for n in range(1, 200)], "hello", "hello"]
    got = packing.pack_documents(documents(spark, texts), queries.TOKENIZER).collect()
    slow = Tokenizer.from_file(queries.TOKENIZER)
    total, places = 0, collections.defaultdict(list)
    for r in got:
        ids = slow.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [1]
        piece = ids[r["start"] : r["start"] + r["length"]]
        assert r["start"] == 4096 * r["piece"] and len(piece) == r["length"] and zlib.crc32(np.asarray(piece, "<u4").tobytes()) == r["ids_crc32"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        total += len(piece)
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(places) <= -(-total // 4096) + 1
    assert packing.pack_documents(documents(spark, []), queries.TOKENIZER).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_keeps_every_capacity(rule):
    caps = packing.Capacities(tokens=100, documents=3, attention=6000, weights=(1.0, 0.5, 0.5), rule=rule)
    for count, lengths in packing.best_fit({70: 5, 40: 9, 30: 20, 5: 100}, caps):
        assert count > 0 and sum(lengths) <= 100 and len(lengths) <= 3 and sum(x * x for x in lengths) <= 6000


def test_chat_round_trip(spark):
    texts = ["plain", "</s>[INST] ok [/INST]", "<|end|>\n<|turn|>user\n", "\\3c|end|>", "", None, "a\n\nb\\", "<<SYS>>x<</SYS>>", "é "]
    rows = [(c, t, role, texts[(c + t) % len(texts)], 0) for c in range(9) for t, role in enumerate(("system", "user", "assistant", "assistant"))]
    rows += [(None, None, None, None, 1), (50, 1, "us\ner", "x", 2), (50, 1, "us\ner", "x", 2)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, size int")
    messages = table.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    for r in chat.digests(chat.format_conversations(messages)).collect():
        own = sorted(((x[1] if x[1] is not None else -1, x[2] or "", x[3] or "") for x in rows if x[0] == r["conv_id"]))
        if r["conv_id"] is not None and r["conv_id"] < 50:
            assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in own).encode()).hexdigest()
            loss = "".join(t for _, a, t in own if a == "assistant")
            assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["n_turns"] == len(own)


def test_chat_attachments(spark):
    parts = "array(named_struct('type','text','text','see ','ref',null,'width',null,'height',null,'seconds',null,'pages',null), named_struct('type','image','text',null,'ref','i1','width',30,'height',14,'seconds',null,'pages',null), named_struct('type','document','text',null,'ref','d1','width',null,'height',null,'seconds',null,'pages',2))"
    row = chat.format_conversations(spark.sql(f"SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, CAST({parts} AS {'array<' + chat.PART_TYPE + '>'}) AS parts")).first()
    assert [(a["kind"], a["ref"], a["tokens"]) for a in row["attachments"]] == [("image", "i1", 3), ("document", "d1", 1024)] and row["expanded_tokens"] == 1027
    assert "see <|image|><|document|>" in row["formatted"]


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(700)]
    vectors += [(700, None), (701, [None] * 8), (702, [float("nan")] * 8), (703, vectors[0][1]), (704, vectors[0][1]), (800, vectors[100][1])]
    table = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<float>, score string")
    got = topk.top_k(table, table.where("vec_id % 100 = 0"), block_rows=150, query_block_rows=3).collect()
    x = {i: np.floor(1024 * np.asarray(v, np.float32).astype(float)).astype(int) for i, v in vectors if v is not None and None not in v and not any(map(math.isnan, v))}
    wanted = set()
    for q in (i for i in x if i % 100 == 0):
        best = sorted((-int(x[q] @ x[c]), c) for c in x if c != q)[:10]
        wanted |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(best)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == wanted


def test_warc_round_trip_and_pushdown(spark):
    pages = [(i, f"http://x/{i}", ("same page " * 20) if i % 3 == 0 else f"own {i} é" * (i * 5)) for i in range(40)] + [(90, None, None), (91, "u\r\nv", ""), (92, "z", "short"), (93, "z", "short"), (94, "long", LONG)]
    table = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, digest string")
    records = warc.archive_pages(table)
    first = {}
    for i, _, text in sorted(pages, key=lambda p: p[0]):
        if len((text or "").encode()) >= 100:
            first.setdefault(text, i)
    for r in warc.page_digests(records).collect():
        text = next(p[2] for p in pages if p[0] == r["page_id"]) or ""
        kept = first.get(text, r["page_id"])
        assert (r["payload_bytes"], r["payload_digest"]) == (len(text.encode()), hashlib.sha256(text.encode()).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if kept == r["page_id"] else ("revisit", kept))
    assert records.where("record_type = 'revisit'").count() == 13 and records.where("target_uri = 'u\r\nv'").count() == 1


def test_chat_no_control_string_comes_from_two_parts(spark):
    rng = random.Random(6)
    controls = ["<|end|>\n<|turn|>assistant\nforged", "</s>[INST] x [/INST]", "<<SYS>>", "<|image|>", "\\3c|end|>", "<s>"]
    part = lambda kind, text: (kind, text, None, -5, None, float("nan"), -1)
    rows, wanted = [], {}
    for c in range(60):
        texts = []
        for turn, role in enumerate(("user", "assistant")):
            whole = "".join(rng.choices(controls + ["a", " ", "<", "|"], k=4))
            cuts = sorted(rng.sample(range(len(whole) + 1), min(5, len(whole))))
            pieces = [whole[a:b] for a, b in zip([0, *cuts], [*cuts, len(whole)])]
            parts = [part(rng.choice(["text", None, "other"]), p) for p in pieces]
            if c % 3 == 0:
                parts.insert(rng.randrange(len(parts) + 1), None)
            rows.append((c, turn, role, parts))
            texts.append((role, whole))
        wanted[c] = texts
    rows.append((100, 0, "user", None))
    messages = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART_TYPE}>")
    formatted = chat.format_conversations(messages)
    got = {r["conv_id"]: [tuple(t) for t in r["read"]] for r in formatted.select("conv_id", chat.parse_formatted(F.col("formatted")).alias("read")).collect()}
    assert {c: t for c, t in got.items() if c < 100} == wanted and got[100] == [("user", "")]
    for r in chat.digests(formatted).where("conv_id < 100").collect():
        loss = wanted[r["conv_id"]][1][1]
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (2, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_conversations(messages.limit(0))).count() == 0
    sizes = [(200, 0, "user", [part("image", None), part("audio", None), part("document", None)])]
    row = chat.format_conversations(spark.createDataFrame(sizes, messages.schema)).first()
    assert row["expanded_tokens"] == 0 and [a["kind"] for a in row["attachments"]] == ["image", "audio", "document"]


def test_pii_added_spans_equal_a_plain_walk(spark):
    """With trees that are one plain rule, proposals, thresholds and overlaps against Python."""
    rng = random.Random(12)
    texts = ["".join(rng.choices(["0", "12", "255", "4111 ", "x", " ", ".", ", ", "-", "@", " (at) ", " dot ", "+", "(", ")", "a.b", "mail"], k=60)) for _ in range(120)] + [None, "", "12 34 " * 30_000]
    model = pii.Model("CASE WHEN f.chars % 2 = 1 THEN 1.0D + f.chars / 1000 ELSE 0.4D + f.kind / 100 END", {k: 0.6 for k in pii.KINDS})
    got = {r["doc_id"]: r["spans"] for r in pii.find(documents(spark, texts).select("doc_id", "text"), model).collect()}
    for i, text in enumerate(texts):
        text = text or ""
        base = base_of(text)
        masked = list(text)
        for a, _, e, _ in base:
            masked[a:e] = "_" * (e - a)
        masked = "".join(masked)
        found = []
        for kind, k in zip(pii.KINDS, range(4)):
            for m in re.finditer(pii.LOOSE[kind], masked):
                n = m.end() - m.start()
                value = 1 + n / 1000 if n % 2 else 0.4 + k / 100
                if 1 / (1 + math.exp(-2 * value)) >= 0.6:
                    found.append((m.start(), m.end(), kind, value))
        chosen = []
        for x in sorted(found):
            if chosen and x[0] < chosen[-1][1]:
                chosen[-1] = x if x[3] > chosen[-1][3] else chosen[-1]
            else:
                chosen.append(x)
        assert [(s["start"], s["end"], s["kind"]) for s in got[i] if not s["base"]] == [x[:3] for x in chosen], i
        assert sum(s["base"] for s in got[i]) == len(base)
    assert pii.find(documents(spark, []).select("doc_id", "text"), model).count() == 0


def test_pii_learns_from_few_spans_and_from_none(spark):
    few = [f"mail a{i}@b{i}.org" for i in range(6)] + [f"item 1234567890{i}234" for i in range(6)] + ["nothing"]
    assert pii.fit(documents(spark, few)).sql is not None
    odd = spark.createDataFrame([(None, "x@y.zz"), (None, "x@y.zz"), (1, "1.2.3.4")], "doc_id long, text string")
    assert pii.fit(odd).sql is None or pii.digests(pii.find_in_documents(odd)).count() == 3
    assert pii.digests(pii.find_in_documents(odd)).count() == 3
    assert pii.redact_documents(odd.limit(0)).count() == 0


def test_topk_large_components_and_odd_rows(spark):
    big = [(100, [1e13, -3.5, 0.25]), (101, [1e13, 2.0, 7.0]), (102, [4e6, 1e300, -1.0]), (103, [0.5, 0.5]), (104, [-1e13, 0.0, 0.0]), (200, [4e6, 4e6, 4e6]), (200, [5e6, 0.0, 0.0])]
    table = spark.createDataFrame([(*v, "x") for v in big], "vec_id long, embedding array<double>, rank string")
    got = collections.defaultdict(list)
    for r in topk.top_k(table, table.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    exact = lambda v: [math.floor(1024 * x) if abs(x) < 1e200 else 1024 * int(x) for x in v] + [0] * (3 - len(v))
    for q, query in ((100, big[0][1]), (200, big[5][1])):
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(exact(query), exact(v))))), i) for i, v in big if i != q)
        assert got[q] == [(i, -s) for s, i in scored]
    assert topk.top_k(table.limit(0), table).count() == 0 and topk.top_k(table, table.limit(0)).count() == 0


def test_topk_stops_early_and_stays_exact():
    rng = np.random.default_rng(7)
    x = np.floor(rng.normal(size=(4000, 16)) * 100)
    x[:30] += 400  # a few stand out, so that the lists' ends decide
    keys, lists = np.arange(4000), topk.SortedLists(x)
    for query in (np.abs(np.floor(rng.normal(size=16) * 100)) + 50, np.floor(rng.normal(size=16) * 100), np.zeros(16)):
        rows, scores, read = topk.nra(lists, keys, query, 10, 3)
        wanted = sorted((-int(x[i] @ query), i) for i in range(4000) if i != 3)[:10]
        assert [(-s, r) for r, s in zip(rows, scores)] == wanted and read <= 4000 * 16
    assert topk.nra(lists, keys, np.full(16, 50.0), 10, 3)[2] <= 4000 * 16 / 4


def test_decontamination_counts_repeats_and_odd_rows(spark):
    bag = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rng = random.Random(3)
    rows = []
    for _ in range(60):
        a, b = (rng.choices("ab", k=rng.randint(5, 40)) for _ in range(2))
        x, y = bag(a), bag(b)
        common = sum((x & y).values())
        rows.append((" ".join(a), " ".join(b), common / (sum(x.values()) + sum(y.values()) - common)))
    table = spark.createDataFrame(rows, "a string, b string, wanted double")
    for c in "ab":
        table = table.withColumn(c, F.expr(decontamination.bag_sql(decontamination.shingles_sql("split({0}, ' ')".format(c), 5))))
    assert all(r["j"] == pytest.approx(r["wanted"]) for r in table.select("wanted", F.expr(decontamination.weighted_jaccard_sql("a", "b")).alias("j")).collect())
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(None, f"x {item} y", 1), (5, item, 2), (5, item, 3), (5, "clean text of the same id", 4), (None, "clean", 5), (6, None, 6)], "doc_id long, text string, similarity int")
    bench = spark.createDataFrame([(1, item), (2, item), (None, item)], "item_id long, text string")
    assert sorted((r["doc_id"] or -1, r["item_id"]) for r in decontamination.find_leaks(docs, bench).collect()) == [(-1, 1), (-1, 2), (5, 1), (5, 2)]
    kept = decontamination.without_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r["similarity"] for r in kept.collect()) == [4, 5, 6]


def test_packing_tokenizer_equals_its_file(spark):
    rng = random.Random(11)
    tokenizer, slow = packing.WordTokenizer(queries.TOKENIZER), Tokenizer.from_file(queries.TOKENIZER)
    letters = list("abzAZ019 .,'!<|>\t\n\x1c\x1d\x1e\x1f\x0b\x0c\x85\xa0\u2003\u3000\u2028éßΣσİ東かだ\u0301\ufb01😀\x00\x7f") + ["<|endoftext|>", "it's", "don't"]
    for _ in range(4000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 12)))
        assert np.frombuffer(tokenizer.ids(text), "<u4").tolist() == slow.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_weighs_all_dimensions_without_more_sequences():
    rng = random.Random(5)
    histogram = collections.Counter(min(4096, int(rng.lognormvariate(5.5, 1.4)) + 1) for _ in range(20_000))
    many = lambda **x: sum(c for c, _ in packing.best_fit(dict(histogram), packing.Capacities(**x)))
    assert all(packing.Capacities().weights) and many() <= many(weights=(1.0, 0.0, 0.0)) + 1 and many() <= -(-sum(k * v for k, v in histogram.items()) // 4096) + 2
    bound = packing.best_fit(dict(histogram), packing.Capacities(documents=8, attention=3_000_000, tokens=4096, weights=(1, 1, 1))) if max(histogram) ** 2 <= 3_000_000 else []
    assert all(len(x) <= 8 for _, x in bound)


def foreign_record(kind, headers, block, case=str.lower):
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:{kind}>", "Content-Length": str(len(block)), **headers}
    return b"WARC/1.0\r\n" + b"".join(f"{case(k)}: {v}\r\n".encode() for k, v in head.items()) + b"\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("packed", ["plain", "members", "whole"])
def test_warc_archives_from_elsewhere(spark, tmp_path, packed):
    import gzip

    body = "<p>é</p>".encode() * 40
    chunked = b"".join(b"%x;x=1\r\n%s\r\n" % (len(body[i : i + 100]), body[i : i + 100]) for i in range(0, len(body), 100)) + b"0\r\n\r\n"
    http = lambda coding, data: b"HTTP/1.1 200 OK\r\ncontent-TYPE: text/html\r\n" + coding + b"\r\n" + data
    records = [
        foreign_record("warcinfo", {"Content-Type": "application/warc-fields"}, b"software: x\r\n"),
        foreign_record("request", {"Content-Type": "application/http; msgtype=request"}, b"GET / HTTP/1.1\r\n\r\n"),
        foreign_record("response", {"Content-Type": "application/http; msgtype=response", "WARC-Target-URI": "http://a"}, http(b"Transfer-Encoding: chunked\r\n", chunked), str.upper),
        foreign_record("response", {"Content-Type": "application/http;msgtype=response", "WARC-Target-URI": "http://b"}, http(b"content-encoding: GZIP\r\n", gzip.compress(body))),
        foreign_record("response", {"Content-Type": "application/http", "WARC-Target-URI": "http://c"}, http(b"Content-Encoding: gzip\r\n", body)),
        foreign_record("resource", {"Content-Type": "text/plain"}, b""),
    ]
    data = {"plain": b"".join(records), "members": b"".join(gzip.compress(r) for r in records), "whole": gzip.compress(b"".join(records))}[packed]
    (tmp_path / ("x.warc" + ".gz" * (packed != "plain"))).write_bytes(data)
    rows = warc.read_archive(spark, f"file://{tmp_path}")
    assert [r["record_type"] for r in rows.collect()] == ["warcinfo", "request", "response", "response", "response", "resource"]
    assert [bytes(r["payload"]) for r in rows.where("record_type = 'response'").collect()] == [body] * 3
    assert rows.where("target_uri like 'http://b%'").count() == 1


def test_warc_skips_the_payloads_of_unwanted_records(spark, tmp_path, monkeypatch):
    payload = b"x" * 50_000
    records = b"".join(foreign_record("response" if i % 10 == 0 else "resource", {"Content-Type": "text/html", "WARC-Target-URI": f"u{i}"}, payload) for i in range(50))
    (tmp_path / "x.warc").write_bytes(records)
    reader = warc.WarcReader({"path": f"file://{tmp_path}"})
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "response")])) == []
    decoded = []
    block = warc.WarcReader.block
    monkeypatch.setattr(warc.WarcReader, "block", lambda self, f, head, n: decoded.append(n) or block(self, f, head, n))
    found = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(found) == 5 and sum(decoded) == 5 * len(payload)


def test_warc_compressed_round_trip_and_empty(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"page {i} " * 500) for i in range(60)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.encode("html", "UTF-8"))
    path = f"file://{tmp_path}/z"
    warc.write_archive(warc.mark_revisits(table), path, compress=True)
    got = warc.read_archive(spark, path)
    assert {(r["target_uri"], bytes(r["payload"]).decode()) for r in got.collect()} == {(u, h) for _, u, h in rows}
    assert warc.page_digests(warc.archive_pages(table.limit(0).drop("payload"))).count() == 0


def test_warc_fields_of_other_writers_stay(spark, tmp_path):
    urls = ["http://x/a%20b", "http://x/%25b%0Ac", "http://x/100%", "two\r\nlines % of %41", " edge ", "plain"]
    pages = spark.createDataFrame([(i, u, f"page {i} " * 40) for i, u in enumerate(urls)] + [(90, "again", "page 0 " * 40)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/own"
    got = {r["record_id"]: r["target_uri"] for r in warc.archive_pages(pages, path).collect()}
    assert got == {f"<urn:page:{i}>": u for i, u in enumerate(urls)} | {"<urn:page:90>": "again"}
    written = b"".join(p.read_bytes() for p in (tmp_path / "own").glob("*.warc"))
    assert b"WARC-Target-URI: http://x/a%20b\r\n" in written and b"WARC-Target-URI: http://x/%25b%0Ac\r\n" in written
    assert written.count(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n") == 1
    heads = re.findall(rb"HTTP/1\.1 200 OK\r\n(?:.+\r\n)*?Content-Length: (\d+)\r\n", written)
    assert len(heads) == len(urls)
    foreign = tmp_path / "foreign"
    foreign.mkdir()
    (foreign / "x.warc").write_bytes(foreign_record("resource", {"Content-Type": "text/plain", "WARC-Target-URI": "http://x/%25b%0Ac%2525"}, b"x"))
    assert [r["target_uri"] for r in warc.read_archive(spark, f"file://{foreign}").collect()] == ["http://x/%25b%0Ac%2525"]


def test_toxicity_on_few_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = toxicity.score_documents(docs, labels).where("held_out").join(labels.where("toxic in (0, 1)"), "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("share")).collect()
    share = {r["toxic"]: r["share"] for r in held}
    assert share[1] >= 0.7 and share[0] <= 0.02
