"""Catalog rows from what a machine's scans deliver as tables.

Reading the operating system itself is not Spark's work; each function takes the rows that a scan
found and keeps, completes or resolves them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seekstone.functions import text as T
from seekstone.operators import catalog as C
from seekstone.shared import stage

#: Which sources a pass takes, and its limits: rows of a folder, rows in all, depth below the start menu
#: and below other roots (fixed values).
PASSES = {
    "bootstrap": {"without": ("app-paths", "uninstall", "scoop", "commands", "protocols", "uwp", "apps-folder"), "per_folder": 400, "total": 1500, "depth": (5, 2)},
    "fast": {"without": ("uwp", "apps-folder"), "per_folder": 400, "total": 1500, "depth": (5, 2)},
    "full": {"without": (), "per_folder": 2000, "total": 8000, "depth": (16, 8)},
}
#: Schemes of web shortcuts that open no program (fixed values).
WEB_SHORTCUTS = ("http", "https", "ftp", "file", "mailto", "data", "javascript")
#: Schemes that are no program's own (fixed values).
WEB_SCHEMES = "http https ftp file mailto data javascript vbscript about blob ws wss gopher gopher+ news nntp telnet wais irc ircs webcal webcals tel callto sms sip sips geo maps market itms-services intent chrome edge view-source ms-browser-extension".split()
INNER_SCHEMES = "shell res resource search query run appx ms-appx ms-appx-web ms-resource ms-settings ms-settingsfile ms-uup ms-windows-store ms-gamebarservices ms-gamingoverlay ms-xbox ms-screenclip".split()
#: Words in names of commands that are no program of their own, and files that are commands (fixed values).
AUXILIARY = "update helper daemon handler selector server host service runtime webview bootstrap".split()
COMMAND_FILES = ("exe", "cmd", "bat", "com", "lnk")


def file_rows(files: DataFrame, profile: str) -> DataFrame:
    """``files(root, path, source)`` of a folder walk that a pass keeps: links and programs by extension,
    names that are worth it, within depth, each folder's and the whole's limits."""
    limits = PASSES[profile]
    depth = F.size(F.split(F.substr("path", F.length("root") + 2), r"[\\/]"))
    deepest = F.when(F.col("source") == "start-menu", limits["depth"][0]).otherwise(limits["depth"][1])
    kept = files.where(~F.col("source").isin(*limits["without"]) if limits["without"] else F.lit(True)).where(depth <= deepest)
    kept = kept.where(T.extension(F.col("path")).isin("lnk", "url", "appref-ms", "exe")).withColumns({"name": T.stem(F.col("path")), "folder": T.parent(F.col("path"))})
    return C.keep_per_folder(kept.where(~C.is_skippable(F.col("name"))), limits["per_folder"], limits["total"])


def resolved_shortcuts(links: DataFrame, cache: DataFrame, resolve) -> DataFrame:
    """``links(path, mtime, size)`` resolved; those whose stamp the cache holds are taken from it.

    ``resolve`` makes ``(path, target, args, working_dir)`` of the links that are new or changed.
    """
    stamp = ["path", "mtime", "size"]
    known = links.join(cache, stamp, "inner")
    fresh = links.join(cache.select(*stamp), stamp, "left_anti")
    found = fresh.join(resolve(fresh), "path").select(*known.columns)
    both = known.unionByName(found)
    return both.where(C.is_launchable(F.col("target")))


def shortcut_url(content: Column) -> Column:
    """The address of a web shortcut's file (bytes, at most 64 KiB, UTF-16 with its mark or UTF-8) whose
    scheme a program handles; else null."""
    text = F.when(F.hex(F.substring(content, 1, 2)) == "FFFE", F.decode(F.substring(content, 3, 1 << 16), "UTF-16LE")).otherwise(F.decode(content, "UTF-8"))
    section = F.regexp_extract(F.concat(F.lit("\n"), text), r"(?is)\n[ \t]*\[InternetShortcut\][ \t]*\r?\n(.*?)(?:\n[ \t]*\[|$)", 1)
    url = F.trim(F.regexp_extract(F.concat(F.lit("\n"), section), r"(?i)\n[ \t]*URL[ \t]*=([^\r\n]*)", 1))
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when((F.octet_length(content) <= 1 << 16) & (scheme != "") & ~scheme.isin(*WEB_SHORTCUTS), url)


def url_rows(files: DataFrame) -> DataFrame:
    """``files(path, content, source)`` of web shortcuts as rows."""
    return files.withColumn("url", shortcut_url(F.col("content"))).where("url is not null").select(T.stable_item_id(F.col("path"), F.lit(None)).alias("id"), T.stem(F.col("path")).alias("name"), F.col("path").alias("target"), F.lit(None).cast("string").alias("args"), "source")


def path_entries(entries: DataFrame, windows: str, most: int = 128) -> DataFrame:
    """Folders of the search path ``(position, folder)`` that are looked into: absolute ones on a drive,
    outside the system's, each once, so many at most, in order of their keys."""
    clean = entries.select(F.rtrim(F.trim("folder"), F.lit("\\")).alias("folder"), "position").where(F.rlike("folder", F.lit(r"^[A-Za-z]:\\")) & ~T.under(F.col("folder"), F.lit(windows)))
    first = clean.groupBy(T.path_key(F.col("folder")).alias("key")).agg(F.min_by("folder", "position").alias("folder"), F.min("position").alias("position"))
    return first.orderBy("position").limit(most).orderBy("key").select("folder")


def command_rows(files: DataFrame) -> DataFrame:
    """``files(path)`` of command folders as rows of source ``commands``."""
    name = T.stem(F.col("path"))
    kept = files.where(T.extension(F.col("path")).isin(*COMMAND_FILES) & C.is_command(name))
    return kept.select(T.stable_item_id(F.col("path"), F.lit(None)).alias("id"), name.alias("name"), F.col("path").alias("target"), F.lit(None).cast("string").alias("args"), F.lit("commands").alias("source"))


def scoop_rows(files: DataFrame) -> DataFrame:
    return command_rows(files).withColumn("source", F.lit("scoop"))


def app_path_rows(entries: DataFrame, present: DataFrame, variables: Column) -> DataFrame:
    """Registered program paths ``entries(value)``: unquoted, expanded, there (``present(path)``), neither
    a helper's nor the system's."""
    path = T.expanded(F.regexp_replace(F.trim("value"), '^"([^"]*)".*$', "$1"), variables)
    rows = entries.select(path.alias("path")).join(present.select(T.path_key(F.col("path")).alias("k")).distinct(), T.path_key(F.col("path")) == F.col("k"), "left_semi")
    name = T.stem(F.col("path"))
    rows = rows.where(~C.is_helper(name) & ~C.in_system_folder(F.col("path")))
    return rows.select(T.stable_item_id(F.col("path"), F.lit(None)).alias("id"), name.alias("name"), F.col("path").alias("target"), F.lit(None).cast("string").alias("args"), F.lit("app-paths").alias("source")).distinct()


def uninstall_rows(entries: DataFrame, present: DataFrame) -> DataFrame:
    """Installed programs ``entries(display_name, icon, uninstall)`` whose icon is a program that is
    there, no helper, and not the uninstaller itself."""
    exe = F.trim(F.regexp_replace(F.regexp_replace(F.trim("icon"), r",\s*-?\d+\s*$", ""), '"', ""))
    remover = F.regexp_extract(F.col("uninstall"), r'(?i)^\s*"?([^"]*?\.exe)', 1)
    rows = entries.select("display_name", exe.alias("target"), remover.alias("remover")).where(T.extension(F.col("target")) == "exe")
    rows = rows.where(~C.is_helper(T.stem(F.col("target"))) & ~C.is_helper(F.col("display_name")) & (T.path_key(F.col("target")) != T.path_key(F.coalesce("remover", F.lit("")))))
    rows = rows.join(present.select(T.path_key(F.col("path")).alias("k")).distinct(), T.path_key(F.col("target")) == F.col("k"), "left_semi")
    return rows.select(T.stable_item_id(F.col("target"), F.lit(None)).alias("id"), F.col("display_name").alias("name"), "target", F.lit(None).cast("string").alias("args"), F.lit("uninstall").alias("source"))


def allowed_protocol(protocol: Column) -> Column:
    """A scheme that may be a program's own: well formed, at most 64 characters, none of the web's or the
    system's."""
    p = F.lower(F.trim(protocol))
    formed = F.rlike(p, F.lit("^[a-z][a-z0-9+.-]{0,63}$"))
    return F.coalesce(formed & ~p.isin(*WEB_SCHEMES, *INNER_SCHEMES) & ~F.rlike(p, F.lit("^(ms-|windows-|windows[.])")), F.lit(False))


def protocols_joined(rows: DataFrame, protocols: DataFrame) -> DataFrame:
    """``rows`` with the schemes of ``protocols(protocol, target, args)`` as keywords of the programs that
    handle them; a scheme named like a program that has no row makes one, unless an auxiliary program's."""
    usable = protocols.where(allowed_protocol(F.col("protocol")) & (T.extension(F.col("target")) == "exe") & ~C.in_system_folder(F.col("target"))).withColumn("k", T.path_key(F.col("target")))
    said = usable.groupBy("k").agg(F.array_sort(F.collect_set("protocol")).alias("_said"))
    joined = rows.join(said, T.path_key(rows["target"]) == F.col("k"), "left").drop("k")
    own = F.col("search_keywords") if "search_keywords" in rows.columns else F.array().cast("array<string>")
    known = joined.withColumn("search_keywords", C.merged_keywords(F.col("name"), F.lit(None).cast("string"), own, F.col("_said"))).drop("_said")
    plain = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    stem, p = plain(T.stem(F.col("target"))), plain(F.col("protocol"))
    parts = F.transform(F.split("target", r"[\\/]"), plain)
    named = (F.length(p) >= 3) & (F.length(stem) >= 3) & (F.startswith(p, stem) | F.startswith(stem, p))
    alone = usable.join(rows.select(T.path_key(F.col("target")).alias("k")).distinct(), "k", "left_anti")
    alone = alone.where(named & ~C.holds_any(F.lower(T.stem(F.col("target"))), AUXILIARY) & ~F.exists(parts, lambda x: x.isin(*AUXILIARY)))
    first = alone.groupBy("k").agg(F.min(F.struct("protocol", "target", "args")).alias("m"), F.array_sort(F.collect_set("protocol")).alias("all"))
    made = first.select(T.stable_item_id(F.col("m.target"), F.col("m.args")).alias("id"), F.col("m.protocol").alias("name"), F.col("m.target").alias("target"), F.col("m.args").alias("args"), F.lit("protocols").alias("source"), F.col("all").alias("search_keywords"))
    rest = [F.col(c) if c in made.columns else F.lit(None).cast(known.schema[c].dataType).alias(c) for c in known.columns]
    return known.unionByName(made.select(*rest))


def manual_rows(apps: DataFrame, present: DataFrame) -> DataFrame:
    """A user's own registrations ``apps(path, display_name, item_id)`` whose file is there; others stay stored only."""
    there = apps.join(present.select(T.path_key(F.col("path")).alias("k")).distinct(), T.path_key(F.col("path")) == F.col("k"), "left_semi")
    return there.select(F.col("item_id").alias("id"), F.col("display_name").alias("name"), F.col("path").alias("target"), F.lit(None).cast("string").alias("args"), F.lit("manual").alias("source"))


def system_rows(entries: DataFrame) -> DataFrame:
    """The system's own pages and tools ``entries(kind, key, name, keywords)`` as rows."""
    page = F.col("kind") == "page"
    return entries.select(F.concat(F.when(page, "win-settings:").otherwise("system-tool:"), "key").alias("id"), "name", F.when(page, F.concat(F.lit("ms-settings:"), "key")).otherwise(F.col("key")).alias("target"), F.lit(None).cast("string").alias("args"), F.when(page, "win-settings").otherwise("builtin-system").alias("source"), F.coalesce("keywords", F.array().cast("array<string>")).alias("search_keywords"))


def scan(sources: list[DataFrame], profile: str = "full") -> DataFrame:
    """All sources of a pass as one table with the columns that they share, built into a catalog."""
    without = PASSES[profile]["without"]
    columns = ["id", "name", "target", "args", "source"]
    whole = None
    for rows in sources:
        said = F.col("search_keywords") if "search_keywords" in rows.columns else F.array().cast("array<string>").alias("search_keywords")
        part = rows.select(F.col("id").cast("string").alias("id"), *columns[1:], said)
        whole = part if whole is None else whole.unionByName(part)
    kept = whole.where(~F.col("source").isin(*without)) if without else whole
    return C.build(stage(kept, "scan"))


def read_snapshot(spark: SparkSession, path: str, version: int, rows: int | None = None) -> DataFrame:
    """A published table, if it has the version (and the number of rows) that is expected; else an error."""
    table = spark.read.parquet(path)
    found = table.select("version").distinct().collect() if "version" in table.columns else []  # one version a table
    if [r["version"] for r in found] not in ([version], []):
        raise ValueError(f"{path} is not of version {version}")
    if rows is not None and table.count() != rows:
        raise ValueError(f"{path} does not hold {rows} rows")
    return table.drop("version")
