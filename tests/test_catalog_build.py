"""Catalog building, result lists, preference tables, scans, sinks and the live overlay on small cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from seekstone.functions import calculator, readings, routing, text as T
from seekstone.operators import catalog as C, evaluate, files, preferences as P, ranking, results as R, search as S
from seekstone.sources import scans, sinks
from seekstone.streaming import overlay

ROW = "id string, name string, target string, args string, source string, search_keywords array<string>"


def rows_of(spark, *rows):
    return spark.createDataFrame([(*r, []) for r in rows], ROW)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_filters_of_names_and_targets(spark):
    flag = lambda column: one(spark, column)
    assert flag(C.in_system_folder(F.lit("C:/Windows/System32/cmd.exe"))) and not flag(C.in_system_folder(F.lit("C:\\Windows\\explorer.exe")))
    assert flag(C.is_helper(F.lit("Crash-Pad"))) and flag(C.is_helper(F.lit("--"))) and not flag(C.is_helper(F.lit("Notepad")))
    assert flag(C.is_skippable(F.lit("App Release Notes"))) and not flag(C.is_skippable(F.lit("App")))
    cases = {"C:\\a\\b.exe": True, "shell:AppsFolder\\x": True, "::{GUID}": True, "C:\\a\\readme.txt": False, "C:\\a\\noext": False, "": False}
    assert {t: flag(C.is_launchable(F.lit(t))) for t in cases} == cases
    commands = {"git": True, "cdbARM64": False, "tool-x64": True, "sdk-tool-x64": False, "mcp-host": False, "x" * 25: False, "": False}
    assert {n: flag(C.is_command(F.lit(n))) for n in commands} == commands


def test_paths_and_identities(spark):
    roots = {"C:\\P\\Tool\\bin\\x64\\a.exe": "c:\\p\\tool", "C:\\P\\Tool\\1.2.3\\a.exe": "c:\\p\\tool", "C:\\P\\Office16\\w.exe": "c:\\p", "a.exe": None, "C:\\P\\2024\\a.exe": "c:\\p\\2024"}
    assert {t: one(spark, T.install_root(F.lit(t))) for t in roots} == roots
    assert one(spark, T.launch_identity(F.lit("shell:AppsFolder\\C:\\A\\b.exe"), F.lit(" -x "))) == "c:\\a\\b.exe\x1f-x"
    assert one(spark, T.stem(F.lit("C:\\a\\.b.c.exe"))) == ".b.c" and one(spark, T.parent(F.lit("C:\\a\\b"))) == "C:\\a"
    assert one(spark, T.direct_path(F.lit(' "C:\\a b\\c" '))) == "C:\\a b\\c" and one(spark, T.direct_path(F.lit("\\\\?\\C:\\a"))) is None
    assert one(spark, T.expanded(F.lit("%HOME%\\x\\%No%"), F.create_map(F.lit("HOME"), F.lit("C:\\u")))) == "C:\\u\\x\\%No%"
    assert one(spark, T.search_url(F.lit(None), F.lit("你好"))).startswith("https://www.baidu") and one(spark, T.search_url(F.lit(None), F.lit("hi"))).endswith("q=hi")
    assert one(spark, T.parsed_web_id(F.lit("url:edge:https://a:1"))) == ("url", "edge", "https://a:1")
    assert one(spark, T.replaced_prefix(F.lit("C:\\a\\b"), F.lit("c:/A/"), F.lit("D:\\z"))) == "D:\\z\\b"
    assert one(spark, T.minified_json(F.lit('{ "a" : [1, 2] }'))) == '{"a":[1,2]}' and one(spark, T.base64_decoded(F.lit("aGk="))) == "hi" and one(spark, T.base64_decoded(F.lit("%%"))) is None
    assert one(spark, files.excludable(F.lit("C:\\a\\..\\b"))) is False and one(spark, files.excludable(F.lit("C:/a"))) is True


def test_catalog_steps(spark):
    rows = rows_of(
        spark,
        ("1", "WPS Office", "C:\\WPS\\office6\\ksolaunch.exe", None, "start-menu"),
        ("2", "wps", "C:\\WPS\\office6\\wps.exe", None, "app-paths"),
        ("3", "WPS Office", "C:\\WPS\\office6\\ksolaunch.exe", " ", "desktop"),
        ("4", "git", "C:\\g\\git.exe", None, "commands"),
        ("5", "Git", "C:\\h\\bash.exe", None, "start-menu"),
        ("6", "Chrome", "shell:AppsFolder\\Chrome", None, "apps-folder"),
        ("7", "Chrome", "C:\\c\\chrome.exe", None, "desktop"),
        ("8", "Display", "ms-settings:display", None, "win-settings"),
        ("9", "display", "shell:AppsFolder\\Disp", None, "apps-folder"),
        ("10", "Alpha", "C:\\x\\a.exe", "-1", "start-menu"),
        ("11", "Alpha", "C:\\y\\b.exe", None, "desktop"),
    )
    built = {r["id"]: r["search_keywords"] for r in C.build(rows).collect()}
    assert set(built) == {"1", "5", "7", "8", "10", "11"} and built["1"] == ["wps"]
    groups = {r["id"]: r["group_id"] for r in C.launch_groups(rows).collect()}
    assert groups["1"] == groups["2"] == groups["3"] and groups["6"] == groups["7"] and groups["10"] != groups["11"] and groups["4"] != groups["5"]


def test_one_file_with_other_arguments_is_another_program(spark):
    rows = rows_of(spark, ("1", "Browser", "C:\\b\\b.exe", "--profile=1", "start-menu"), ("2", "Browser", "C:\\b\\b.exe", "--profile=2", "desktop"), ("3", "Visual Studio", "C:\\v\\devenv.exe", None, "desktop"), ("4", "Visual Studio Code", "C:\\v\\other.exe", None, "desktop"))
    assert len({r["group_id"] for r in C.launch_groups(rows).collect()}) == 4


def test_final_ranking(spark):
    catalog = spark.createDataFrame(
        [
            ("a", "Note", "C:\\n\\note.exe", None, "start-menu", True, "x", None),
            ("b", "Note", "C:\\n\\note.exe", None, "uninstall", False, None, "icon-b"),
            ("c", "Notes", "C:\\m\\notes.exe", None, "commands", False, None, None),
            ("d", "Notebook", "C:\\k\\k.exe", None, "desktop", False, None, None),
            ("e", "Annotate", "C:\\e\\e.exe", None, "desktop", False, None, None),
        ],
        "id string, name string, target string, args string, source string, is_lnk boolean, working_dir string, icon string",
    )
    docs, parsed = S.enrich(catalog), S.parse(spark.createDataFrame([(0, "note")], "query_id int, text string"))
    hits = S.verify(S.candidates_of(docs, parsed))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "item_id string")
    pairs = spark.createDataFrame([("note", "e", 5, 1_000_000, 1.0)], "query string, item_id string, n long, last_used long, share double")
    usage = spark.createDataFrame([("e", 5, 1_000_000), ("d", 500, 1_000_000)], "item_id string, launches long, last_used long")
    groups = C.launch_groups(catalog)
    got = [tuple(r) for r in ranking.finish(hits, catalog, groups, pairs, usage, ids("b"), ids("e"), ids("d"), 1_000_060).orderBy("rank").select("id", "score", "tier", "tag", "icon_id").collect()]
    # the best member's score on the launched row with the other's icon; "d" is hidden; aliases sink
    assert got[0][0] == "a" and got[0][2] == 1 and got[0][4] == "b"
    assert [g[0] for g in got[1:]] == ["c", "e"] or [g[0] for g in got[1:]] == ["e", "c"]
    assert next(g for g in got if g[0] == "e")[3].endswith("+demote") and "d" not in [g[0] for g in got]
    assert next(g for g in got if g[0] == "c")[1] == 800


def test_recall_loses_nothing_on_random_catalogs(spark):
    rng = random.Random(13)
    words = ["visual", "studio", "code", "chrome", "note", "pad", "微信", "支付", "e", "x2", "PowerPoint", "Über", "system", "restore"]
    names = [" ".join(rng.choices(words, k=rng.randint(1, 4))) + rng.choice(["", "s", "!", "  2"]) for _ in range(120)] + [None, "", " "]
    catalog = spark.createDataFrame([(i, n, rng.choice([None, "Shown " + (n or "")]), rng.choice([None, [rng.choice(words), "two words"]]), rng.choice([None, ["context of " + rng.choice(words)]])) for i, n in enumerate(names)], "id long, name string, display_name string, search_keywords array<string>, search_context array<string>")
    asked = [rng.choice(words)[: rng.randint(1, 6)] for _ in range(12)] + ["vsiual", "sytem", "restroe point", "vs", "vsc", "v s", "note pa", "twowords", "pwrp", "crom", "codestud", "contxt", "applicatons"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, text string")
    pruned, whole = ({tuple(r) for r in S.search(catalog, queries, k=200, pruned=p).collect()} for p in (True, False))
    assert pruned == whole and len(whole) > 300


def test_readings(spark):
    table = spark.createDataFrame([("重", ["zhong", "chong"]), ("庆", ["qing"]), ("微", ["wei"]), ("信", ["xin"])], "ch string, readings array<string>")
    catalog = spark.createDataFrame([(1, "重庆 App", ["微信"]), (2, "Plain", None)], "id long, name string, search_keywords array<string>")
    got = {r["id"]: r for r in readings.attach(catalog, table).collect()}
    assert (got[1]["reading"], got[1]["initials"], got[1]["keyword_readings"], got[2]["reading"]) == ("zhongqingapp", "zqapp", ["weixin"], "")
    chars = readings.char_readings(catalog.select(F.col("name").alias("text")), table)
    assert chars.where("text = '重庆 App'").select(readings.syllables(F.col("char_readings")).alias("s")).first()["s"] == ["zhong", "qing", "app"]
    queries = spark.createDataFrame([(0, "chongqing"), (1, "zq"), (2, "weixin"), (3, "zqap")], "query_id int, text string")
    best = {r["query_id"]: (r["id"], r["tag"]) for r in S.search(readings.attach(catalog, table), queries, k=1).collect()}
    assert best == {0: (1, "reading-any"), 1: (1, "reading-any"), 2: (1, "keyword-reading-exact"), 3: (1, "initials-prefix")}


def test_calculator(spark):
    texts = {"-2^2": "-4", "2(3+4)": "14", "√9+1": "4", "1,000*2": "2000", "1/3": "0.3333333333", "2**3**2": "512", "=1+1": "2", "−3×（2＋1）": "-9", "√(16)√4": "8"}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", calculator.calculate(F.col("t"))["text"].alias("x")).collect()
    assert {r["t"]: r["x"] for r in got} == texts
    assert all(calculator.one(t)[2] for t in ("1 2", "(1", "5%0", "1/0", "√-1", "abc", "1+")) and calculator.one(" ") == (None, None, None)


def test_result_lists(spark):
    hits = spark.createDataFrame([(0, str(k), 1000 - 100 * k, k) for k in range(1, 7)], "query_id int, id string, score int, place long")
    one_row = spark.createDataFrame([(0, "web", 1, 0)], "query_id int, id string, score int, place long")
    assert [r["id"] for r in R.at_slot(hits, one_row).orderBy("place").collect()] == ["1", "2", "3", "4", "web", "5", "6"]
    more = spark.createDataFrame([(0, "cmd", 800, 0), (0, "1", 999, 0)], "query_id int, id string, score int, place long")
    assert [r["id"] for r in R.by_score(hits, more).orderBy("place").collect()] == ["1", "2", "cmd", "3", "4", "5", "6"]
    targets = hits.withColumn("target", F.when(F.col("id") == "2", "c:/a/B.exe").otherwise("x"))
    queries = spark.createDataFrame([(0, "C:\\a\\b.exe")], "query_id int, text string")
    assert [r["id"] for r in R.prepend_direct_path(targets, queries).orderBy("place").collect()] == ["path:C:\\a\\b.exe", "1", "3", "4", "5", "6"]
    address = spark.createDataFrame([(0, "example.com")], "query_id int, text string")
    browsers = spark.createDataFrame([("one", 1), ("two", 2)], "browser string, position int")
    got = [(r["id"], r["score"]) for r in R.merged(hits.limit(1), hits.limit(0), address, browsers, "two").orderBy("place").collect()]
    assert got[:3] == [("url:two:https://example.com", 980), ("url:one:https://example.com", 960), ("url:default:https://example.com", 960)] and got[3][0] == "1"
    source = lambda *x: one(spark, R.result_source(*map(F.lit, x)))
    assert [source("file", "x", "x", "x"), source("exact", "builtin:x", "x", "x"), source("exact", "x", "browser", "x"), source("exact", "x", "desktop", "HTTPS://a"), source("exact", "x", "desktop", "C:\\a")] == ["file", "builtin", "web", "web", "app"]
    score = lambda q, n, k, page=False: one(spark, R.system_entry_score(F.lit(q), F.lit(n), F.array(*map(F.lit, k)), F.lit("xianshi"), F.lit("xs"), page))
    assert [score("display", "Display", []), score("disp", "Display", []), score("the display x", "Display", []), score("xian", "Display", []), score("x", "Display", ["q"]), score("scr", "Display", ["screen size"]), score("zz", "Display", ["q"])] == [900, 860, 860, 840, 840, 820, None]


def test_store(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    aliases = table([("old", "Old", None)], "alias string, target_name string, target_id string")
    new = P.set_aliases(aliases, table([(" OLD ", "New", "n1"), ("", "x", None), ("b", " ", None)], aliases.schema))
    assert [tuple(r) for r in new.collect()] == [("old", "New", "n1")]
    hidden = table([], "item_id string, display_name string, target string, args string, hidden_at long")
    items = table([("n1", "Name", " ", "t", None), (" ", "No", None, "t", None)], "id string, name string, display_name string, target string, args string")
    state = P.clear_records({"usage": table([("n1", 3, 5), ("m", 1, 1)], "item_id string, launches long, last_used long"), "aliases": new, "hidden": hidden}, items.limit(1), 9)
    assert [r["item_id"] for r in state["usage"].collect()] == ["m"] and state["aliases"].count() == 0 and tuple(state["hidden"].first()) == ("n1", "Name", "t", None, 9)
    moved = P.remap_all({"usage": table([("a", 2, 5), ("b", 3, 9)], "item_id string, launches long, last_used long"), "hidden": table([("a", "A", 7), ("b", "B", 3)], "item_id string, display_name string, hidden_at long"), "demoted": table([("a", 4)], "item_id string, demoted_at long"), "aliases": table([("x", "X", "a")], aliases.schema)}, table([("a", "b"), ("c", "c"), ("", "z")], "old_id string, new_id string"))
    assert [tuple(r) for r in moved["usage"].collect()] == [("b", 5, 9)] and [tuple(r) for r in moved["hidden"].collect()] == [("b", "B", 7)]
    assert [tuple(r) for r in moved["demoted"].collect()] == [("b", 4)] and moved["aliases"].first()["target_id"] == "b"
    apps = table([(4, "C:\\a", "c:\\a", "A", "i1")], "id long, path string, path_key string, display_name string, item_id string")
    saved = P.save_manual(apps, table([("c:/A", "again", "i2"), ("C:\\b", "B", "i3"), ("C:\\c", "C", "i3")], "path string, display_name string, item_id string"))
    assert sorted((r["id"], r["path"]) for r in saved.collect()) == [(4, "C:\\a"), (5, "C:\\b")]
    settings = table([("theme", "dark")], "key string, value string")
    assert tuple(P.settings_row(settings, {"theme": "light", "lang": "en"}).first()) == ("dark", "en")


def test_scans(spark):
    def shortcut(url, kind="utf-8", head="[InternetShortcut]"):
        text = f"{head}\r\nIDList=\r\nURL={url}\r\n"
        return (b"\xff\xfe" + text.encode("utf-16-le")) if kind == "utf-16" else text.encode()

    shortcuts = [("a", shortcut("steam://run/1")), ("b", shortcut("https://x")), ("c", shortcut("com.x.y:open", "utf-16")), ("d", shortcut("steam://x", head="[Other]")), ("e", b"x" * 70_000)]
    rows = spark.createDataFrame([(f"C:\\{n}.url", bytearray(b), "desktop") for n, b in shortcuts], "path string, content binary, source string")
    assert sorted(r["name"] for r in scans.url_rows(rows).collect()) == ["a", "c"]
    walk = spark.createDataFrame([("C:\\m", f"C:\\m\\f\\{n}", "start-menu") for n in ("b.lnk", "a.lnk", "Uninstall x.lnk", "c.txt")] + [("C:\\m", "C:\\m\\f\\z.lnk", "uwp")], "root string, path string, source string")
    assert sorted(r["name"] for r in scans.file_rows(walk, "fast").collect()) == ["a", "b"]
    protocols = spark.createDataFrame([("steam", "C:\\S\\steam.exe", None), ("http", "C:\\S\\steam.exe", None), ("zed", "C:\\Z\\zed.exe", None), ("abc", "C:\\Z\\abchelper.exe", None)], "protocol string, target string, args string")
    joined = {r["name"]: r["search_keywords"] for r in scans.protocols_joined(rows_of(spark, ("1", "Game", "c:/s/STEAM.exe", None, "desktop")), protocols).collect()}
    assert joined == {"Game": ["steam"], "zed": ["zed"]}
    present = spark.createDataFrame([("C:\\P\\p.exe",), ("C:\\P\\unins000.exe",)], "path string")
    entries = spark.createDataFrame([("P", '"C:\\P\\p.exe",0', "C:\\P\\unins000.exe /S"), ("Q", "C:\\P\\unins000.exe", "C:\\P\\unins000.exe"), ("R", "C:\\none.exe", None)], "display_name string, icon string, uninstall string")
    assert [r["name"] for r in scans.uninstall_rows(entries, present).collect()] == ["P"]
    folders = spark.createDataFrame([(0, "C:\\t\\"), (1, "c:\\T"), (2, "C:\\Windows\\x"), (3, "\\\\srv\\x"), (4, "D:\\u")], "position int, folder string")
    assert [r["folder"] for r in scans.path_entries(folders, "C:\\Windows").collect()] == ["C:\\t", "D:\\u"]
    system = scans.system_rows(spark.createDataFrame([("page", "night-light", "Night light", None), ("tool", "reg-edit", "Registry", ["reg"])], "kind string, key string, name string, keywords array<string>"))
    whole = scans.scan([rows_of(spark, ("x", "App", "C:\\a.exe", None, "start-menu")), system, scans.command_rows(spark.createDataFrame([("C:\\t\\app.exe",)], "path string"))], "full")
    assert sorted(r["name"] for r in whole.collect()) == ["App", "Night light", "Registry"]
    cache = spark.createDataFrame([("a.lnk", 1, 10, "C:\\a.exe", None, None)], "path string, mtime long, size long, target string, args string, working_dir string")
    links = spark.createDataFrame([("a.lnk", 1, 10), ("b.lnk", 2, 5), ("c.lnk", 1, 1)], "path string, mtime long, size long")
    resolve = lambda new: new.select("path", F.when(F.col("path") == "b.lnk", "C:\\b.exe").otherwise("C:\\c.pdf").alias("target"), F.lit(None).cast("string").alias("args"), F.lit(None).cast("string").alias("working_dir"))
    assert sorted(r["target"] for r in scans.resolved_shortcuts(links, cache, resolve).collect()) == ["C:\\a.exe", "C:\\b.exe"]


def test_generations(spark, tmp_path):
    home = f"file://{tmp_path}/g"
    assert sinks.published(spark, home) is None
    first = sinks.publish(spark.range(3), home, 2)
    second = sinks.publish(spark.range(5), home, 2)
    assert sinks.published(spark, home) == (second, 2) and first != second
    assert scans.read_snapshot(spark, second, 2, 5).count() == 5
    with pytest.raises(ValueError):
        scans.read_snapshot(spark, second, 3)
    with pytest.raises(Exception, match="boom"):
        sinks.publish(spark.range(1).select(F.raise_error(F.lit("boom")).alias("id")), home, 2)
    assert sinks.published(spark, home) == (second, 2) and sinks.drop_old(spark, home) >= 1 and scans.read_snapshot(spark, second, 2).count() == 5
    runs = spark.createDataFrame([("s", 1, True), ("s", 2, False), ("s", 3, False), ("t", 1, False)], "source string, at long, ok boolean")
    assert sorted(map(tuple, sinks.health(runs).collect())) == [("s", 1, 2, 1, 2), ("t", 0, 1, None, 1)]


def test_routing_keys_and_manifests(spark):
    triggers = spark.createDataFrame([("calc", "prefix", "=", 0), ("long", "prefix", "==x", 1), ("w", "keyword", "W", 2)], "provider string, kind string, value string, place int")
    queries = spark.createDataFrame([(0, " =1"), (1, "==x y"), (2, "w\tnotes"), (3, "word"), (4, "")], "query_id int, text string")
    assert {(r["query_id"], r["provider"], r["rest"]) for r in routing.route(queries, triggers).collect()} == {(0, "calc", "1"), (1, "calc", "=x y"), (2, "w", "notes")}
    valid = lambda *x: one(spark, routing.valid_manifest(*map(F.lit, x)))
    assert valid(1, 1, "a.b-c", "bin/x.exe") and not valid(2, 1, "a", "x") and not valid(1, 1, "A b", "x") and not valid(1, 1, "a", "../x") and not valid(1, 1, "a", "C:\\x")
    shown = one(spark, routing.panel(F.lit('{"blocks": [{"type": "text", "text": "a"}, {"type": "evil"}], "actions": []}')))
    assert [b["type"] for b in shown["blocks"]] == ["text"]


def test_percentiles(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in (5, 1, 1, 9, 7, 3)] + [("b", 2.0), ("b", None)], "k string, v double")
    assert dict(map(tuple, evaluate.percentile(rows, "v", ["k"], 0.5).collect())) == {"a": sorted((5, 1, 1, 9, 7, 3))[3], "b": 2.0}


# --- the live overlay --------------------------------------------------------------------------


def simulated(base, rounds):
    """The same state by plain Python: paths of every object, base rows by ordinal."""
    now = {(o, v, f, d): p for o, v, f, d, p in base}
    objects, gone = {}, set()
    under = lambda p, top: p.lower() == top.lower() or p.lower().startswith(top.lower() + "\\")
    current = {k[0]: p for k, p in now.items()}
    for changes in rounds:
        for v, f, d, paths, identity in changes:
            if not d or identity:
                continue
            olds = objects[v, f][1] if objects.get((v, f), (0, []))[1] else [current[o] for o, bv, bf, _, _ in base if (bv, bf) == (v, f) and o in current]
            pairs = [(x, None) for x in olds] if not paths else list(zip(olds, paths))
            for old, new in pairs:
                for o in list(current):
                    if o not in gone and under(current[o], old):
                        if new is None:
                            gone.add(o)
                        else:
                            current[o] = new + current[o][len(old) :]
                for key, (kind, held) in list(objects.items()):
                    if key[0] == v:
                        held = [(None if new is None else new + p[len(old) :]) if under(p, old) else p for p in held]
                        objects[key] = (kind, [p for p in held if p is not None])
        for v, f, d, paths, _ in changes:
            gone |= {o for o, bv, bf, _, _ in base if (bv, bf) == (v, f)}
            objects.pop((v, f), None)
            if paths:
                objects[v, f] = (d, paths)
    return {current[o] for o, *_ in base if o not in gone} | {p for _, held in objects.values() for p in held}


def test_overlay_follows_rounds(spark, tmp_path):
    base = [(1, "v", 1, True, "C:\\a"), (2, "v", 2, True, "C:\\a\\b"), (3, "v", 3, False, "C:\\a\\b\\x"), (4, "v", 4, False, "C:\\a\\y"), (5, "v", 5, True, "C:\\c"), (6, "v", 6, False, "C:\\c\\z"), (7, "v", 4, False, "C:\\c\\link-y"), (8, "v", 8, False, "C:\\ab")]
    rounds = [
        [("v", 1, True, ["C:\\q"], False), ("v", 9, False, ["C:\\q\\b\\new", "C:\\c\\also"], False)],
        [("v", 5, True, ["C:\\d"], False), ("v", 2, True, ["C:\\d\\b2"], False)],
        [("v", 6, False, [], True), ("v", 4, False, ["C:\\moved"], False)],
        [("v", 5, True, [], False), ("v", 10, True, ["C:\\q\\fresh"], False)],
    ]
    frames, seq = [], 0
    for r, changes in enumerate(rounds + [[("v", 8, False, [], False)]]):
        for k, (v, f, d, paths, identity) in enumerate(changes):
            seq += 1
            frames.append({"seq": seq, "kind": "change", "round": r, "ordinal": k, "volume": v, "frn": f, "is_dir": d, "paths": paths, "identity_only": identity})
        if r < len(rounds):
            seq += 1
            frames.append({"seq": seq, "kind": "round_commit", "round": r})
    source = tmp_path / "feed"
    source.mkdir()
    (source / "1.jsonl").write_text("\n".join(map(json.dumps, frames[:5])))
    table, home = spark.createDataFrame(base, "ordinal long, volume string, frn long, is_dir boolean, path string"), f"file://{tmp_path}/home"
    shown, waiting = overlay.follow(table, str(source), home)
    assert {r["path"] for r in shown.collect()} == simulated(base, rounds[:1]) and waiting.count() == 2
    (source / "2.jsonl").write_text("\n".join(map(json.dumps, frames[5:])))
    shown, waiting = overlay.follow(table, str(source), home)
    assert {r["path"] for r in shown.collect()} == simulated(base, rounds) and waiting.count() == 1
    (source / "3.jsonl").write_text(json.dumps({"seq": seq + 2, "kind": "round_commit", "round": 9}))
    with pytest.raises(Exception, match="without a gap"):
        overlay.follow(table, str(source), home)


def test_overlay_rejects_changes_of_kind(spark):
    base = spark.createDataFrame([(1, "v", 1, True, "C:\\a")], "ordinal long, volume string, frn long, is_dir boolean, path string")
    wrong = spark.createDataFrame([(0, "v", 1, False, ["C:\\b"], False)], "ordinal long, volume string, frn long, is_dir boolean, paths array<string>, identity_only boolean")
    with pytest.raises(Exception, match="disagrees"):
        overlay.apply_round(base, overlay.empty_state(spark), wrong)
    targets = spark.createDataFrame([("v", 5), ("w", 1)], "volume string, usn long")
    assert overlay.caught_up(targets, targets) and not overlay.caught_up(targets.where("volume = 'v'"), targets)
