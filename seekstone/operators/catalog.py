"""Building one catalog out of many sources: layers, filters, deduplication, merging, launch groups.

Rows have ``id, name, target, args, source``; ``display_name, search_keywords, working_dir, icon,
is_lnk`` take part where they are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seekstone.functions import text as T
from seekstone.operators.ordered import numbered
from seekstone.graph import connected_components
from seekstone.shared import stage

#: Sources by layer (fixed values).
FORMAL = ("start-menu", "desktop", "uwp", "apps-folder", "portable", "manual")
SYSTEM = ("builtin", "builtin-system", "win-settings")
SUPPLEMENTAL = ("app-paths", "uninstall")
COMMAND_ALIAS = ("commands", "scoop")
HIDEABLE = (*FORMAL, *SUPPLEMENTAL, "protocols", *COMMAND_ALIAS)
#: Which row stays of those that start the same thing (fixed values).
DEDUPE_ORDER = {"manual": 0, "start-menu": 1, "desktop": 2, "portable": 3, "uninstall": 4, "app-paths": 5, "uwp": 6, "apps-folder": 6, "commands": 7}
#: Which row stays of formal rows with one name (fixed values).
FORMAL_ORDER = {"start-menu": 0, "desktop": 1, "portable": 2, "apps-folder": 3, "uwp": 3}
#: Which row stands for a launch group, after shortcuts of the start menu (0) and the desktop (1) (fixed values).
LAUNCH_ORDER = {"start-menu": 2, "desktop": 3, "portable": 4, "app-paths": 5, "uwp": 6, "apps-folder": 6, "commands": 7, "uninstall": 100}
#: Parts of the paths of folders that are the system's own (fixed values).
SYSTEM_FOLDERS = ("\\windows\\system32\\", "\\windows\\syswow64\\", "\\windows\\winsxs\\", "\\windowsapps\\", "\\winget\\links\\", "\\chocolatey\\bin\\", "\\microsoft\\windowsapps\\")
#: What names of helpers hold, and of shortcuts that start no program (fixed values).
HELPERS = "uninstall uninstaller unins update updater setup installer installhelper repair maintenance crashpad crashreport crashreporter helper elevated redistributable redist webview2 webview".split()
SKIPPED = ("uninstall", "unins000", "help", "readme", "license", "documentation", "website", "release notes", "setup")
LAUNCHABLE = ("exe", "com", "bat", "cmd", "msc", "appref-ms", "lnk")
#: What names of commands hold that are no entries, and endings that name an architecture (fixed values).
COMMAND_HELPERS = "mcphost mcpserver adminserver packaging pcappce".split()
ARCHITECTURES = "arm64 arm32 aarch64 x86_64 amd64 x64 x86 ia32 win64 win32".split()
SDK_WORDS = "sdk toolchain debug dbg runtime redist redistributable helper host".split()


def order_of(source: Column, ranks: dict[str, int], other: int = 8) -> Column:
    rank = F.lit(other)
    for name, k in ranks.items():
        rank = F.when(source == name, k).otherwise(rank)
    return rank


def layer(source: Column) -> Column:
    """Formal, System, CommandAlias; what is not known is Supplemental."""
    return F.when(source.isin(*FORMAL), "Formal").when(source.isin(*SYSTEM), "System").when(source.isin(*COMMAND_ALIAS), "CommandAlias").otherwise("Supplemental")


def in_system_folder(target: Column) -> Column:
    padded = F.concat(F.lit("\\"), T.path_key(F.trim(target)), F.lit("\\"))
    return F.coalesce(F.greatest(*(F.contains(padded, F.lit(x)) for x in SYSTEM_FOLDERS)), F.lit(False))


def hidden_on_empty_query(source: Column, target: Column) -> Column:
    """Rows that do not fill an empty query's list: aliases, discoveries and the system's own."""
    return layer(source).isin("CommandAlias", "Supplemental") | in_system_folder(target)


def holds_any(text: Column, words: list[str] | tuple[str, ...]) -> Column:
    return F.greatest(*(F.contains(text, F.lit(w)) for w in words))


def is_helper(name: Column) -> Column:
    """Names of maintenance programs, and names without letters and digits."""
    plain = F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))
    return (plain == "") | holds_any(plain, HELPERS)


def is_skippable(name: Column) -> Column:
    return holds_any(F.lower(name), SKIPPED)


def is_launchable(target: Column) -> Column:
    """Whether a shortcut's target is a program: by its extension, or a shell name."""
    t = F.trim(target)
    name = T.basename(t)
    return (t != "") & (F.startswith(t, F.lit("shell:")) | F.startswith(t, F.lit("::")) | (F.rlike(name, F.lit(".[.]")) & T.extension(t).isin(*LAUNCHABLE)))


def is_command(name: Column) -> Column:
    """Whether a command's file name is worth an entry: short, no helper, no architecture's variant."""
    n, low = F.trim(name), F.lower(F.trim(name))
    plain = F.regexp_replace(low, "[^a-z0-9]", "")
    ends = "|".join(ARCHITECTURES)
    joined = F.rlike(low, F.lit(f"[^-_.]({ends})$"))
    marked = F.rlike(low, F.lit(f"(^|[^a-z0-9])({ends})([^a-z0-9]|$)")) & holds_any(plain, SDK_WORDS)
    return (n != "") & (F.length(n) <= 24) & ~is_helper(n) & ~holds_any(plain, COMMAND_HELPERS) & ~joined & ~marked


def same_text(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def merged_keywords(name: Column, display: Column, own: Column, others: Column) -> Column:
    """``own`` and those of ``others`` that are neither a name nor there already, whatever their case;
    each keeps its first spelling and its place."""
    empty = F.array().cast("array<string>")
    return F.aggregate(F.coalesce(others, empty), F.coalesce(own, empty), lambda held, x: F.when(x.isNull() | same_text(x, name) | F.coalesce(same_text(x, display), F.lit(False)) | F.exists(held, lambda h: same_text(h, x)), held).otherwise(F.array_append(held, x)))


def names_of(rows: DataFrame) -> Column:
    """All names of a row: name, display name, keywords."""
    has = set(rows.columns)
    said = F.array("name", *(["display_name"] if "display_name" in has else []))
    return F.array_compact(F.concat(said, F.coalesce("search_keywords", F.array().cast("array<string>"))) if "search_keywords" in has else said)


def names_in_order(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``(key, _all)``: the distinct ``_names`` of the rows of a key, in the order in which they come first.

    Names that repeat are brought down to one before they meet, however many rows bring them.
    """
    named = rows.select(key, order, F.posexplode_outer("_names").alias("_nth", "_name"))
    first = named.groupBy(key, "_name").agg(F.min(F.struct(order, "_nth")).alias("_at"))
    listed = F.array_sort(F.collect_list(F.when(F.col("_name").isNotNull(), F.struct("_at", "_name"))))
    return first.groupBy(key).agg(F.transform(listed, lambda x: x["_name"]).alias("_all"))


def dedupe(rows: DataFrame) -> DataFrame:
    """One row for each launch identity of ``rows``; a row without a target is one of its own.

    The best source's row stays (ties: the least key of target, arguments, name and id) and takes the
    other rows' names as ``keywords``, in order of those rows.
    """
    order = F.struct(order_of(F.col("source"), DEDUPE_ORDER).alias("r"), T.path_key(F.col("target")).alias("t"), F.coalesce("args", F.lit("")).alias("a"), F.col("name").alias("n"), F.col("id").alias("i"))
    key = F.coalesce(T.launch_identity(F.col("target"), F.col("args")), F.concat(F.lit("\x1e"), F.col("id").cast("string")))
    keyed = rows.select("*", key.alias("key"), order.alias("_order"), names_of(rows).alias("_names"))
    kept = [c for c in rows.columns if c != "keywords"]
    best = keyed.groupBy("key").agg(F.min_by(F.struct(*kept), "_order").alias("b")).join(names_in_order(keyed, "key", "_order"), "key")
    display = F.col("b.display_name") if "display_name" in kept else F.lit(None).cast("string")
    own = F.col("b.search_keywords") if "search_keywords" in kept else F.array().cast("array<string>")
    return best.select(*(F.col(f"b.{c}").alias(c) for c in kept), merged_keywords(F.col("b.name"), display, own, F.col("_all")).alias("keywords"))


def absorbed(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``rows`` without the losers of ``pairs(winner, loser)``, whose names the winners' ``keywords`` hold.

    A winner that is itself a loser passes nothing on: it goes with its own names only.
    """
    pairs = pairs.groupBy("loser").agg(F.min("winner").alias("winner"))
    given = pairs.join(rows.select(F.col("id").alias("loser"), names_of(rows).alias("_names")), "loser")
    given = names_in_order(given, "winner", "loser").withColumnRenamed("_all", "_given")
    left = rows.join(pairs.select(F.col("loser").alias("id")), "id", "left_anti").join(given, F.col("id") == F.col("winner"), "left").drop("winner")
    own = F.col("search_keywords") if "search_keywords" in rows.columns else F.array().cast("array<string>")
    display = F.col("display_name") if "display_name" in rows.columns else F.lit(None).cast("string")
    return left.withColumn("search_keywords", merged_keywords(F.col("name"), display, own, F.col("_given"))).drop("_given")


def compact_name(name: Column) -> Column:
    return T.compact(T.normalize(name))


def merge_commands(rows: DataFrame) -> DataFrame:
    """Commands that have the compact name of a row of another source go into the first such row."""
    named = rows.select("id", "source", compact_name(F.col("name")).alias("k"))
    hosts = named.where("source <> 'commands'").groupBy("k").agg(F.min("id").alias("winner"))
    return absorbed(rows, named.where("source = 'commands'").join(hosts, "k").select("winner", F.col("id").alias("loser")))


def keys_of(rows: DataFrame, side: str) -> DataFrame:
    """What two rows are compared by."""
    target = F.col("target")
    keys = {
        "id": F.col("id"), "source": F.col("source"), "name": F.col("name"), "target": target, "args": F.col("args"),
        "launch": T.launch_identity(target, F.col("args")), "path": T.path_key(target), "root": T.install_root(target), "family": T.family_key(F.col("name")),
        "compact": compact_name(F.col("name")), "stem": F.lower(T.stem(T.shell_body(target))),
    }
    return rows.select(*(c.alias(f"{side}_{k}") for k, c in keys.items()))


def same_program(a: str, b: str) -> Column:
    """Rows of one launch, of one file with equal arguments, or of one installation and family."""
    c = lambda side, k: F.col(f"{side}_{k}")
    equal_args = T.arguments_equal(c(a, "args"), c(b, "args"))
    family = ((c(a, "family") == c(b, "family")) & (c(a, "family") != "")) | T.stem_begins_name(c(a, "target"), c(b, "name")) | T.stem_begins_name(c(b, "target"), c(a, "name"))
    by_path = (c(a, "path") == c(b, "path")) & (c(a, "path") != "")
    return (c(a, "launch") == c(b, "launch")) | (by_path & equal_args) | (~by_path & (c(a, "root") == c(b, "root")) & equal_args & family)


def absorb_pairs(rows: DataFrame) -> DataFrame:
    """``(winner, loser)``: discovered rows (app paths, uninstall entries) and the first formal or system
    row that is the same program.

    Each way to be the same program is a key, of which only the first such row's is kept: a folder in
    which very many rows lie is never paired with itself. A file name that begins a name meets one of
    the name's own beginnings.
    """
    found = keys_of(rows.where(F.col("source").isin(*SUPPLEMENTAL)), "a").transform(program_keys, "a", True)
    hosts = keys_of(rows.where(layer(F.col("source")).isin("Formal", "System")), "b").transform(program_keys, "b", False)
    first = hosts.groupBy("k").agg(F.min("id").alias("winner"))
    return stage(found.join(first, "k").groupBy(F.col("id").alias("loser")).agg(F.min("winner").alias("winner")), "pairs")


def program_keys(keyed: DataFrame, side: str, discovered: bool) -> DataFrame:
    """``(k, id)``: what a row and another meet on if and only if they are of ``same_program``."""
    c = lambda k: F.col(f"{side}_{k}")
    key = lambda kind, *parts: F.concat(F.lit(kind), *(x for p in parts for x in (F.lit("\x1f"), p)))
    core, plain = T.arguments_core(c("args")), F.regexp_replace(T.normalize(c("name")), "[^A-Za-z0-9]", "")
    none = F.array().cast("array<string>")
    begins = F.when(F.length(plain) >= 3, F.transform(F.sequence(F.lit(3), F.greatest(F.length(plain), F.lit(3))), lambda n: F.left(plain, n))).otherwise(none)
    stems = F.when(F.octet_length(c("stem")) >= 3, F.array(c("stem"))).otherwise(none)
    own, other = ("s", "t") if discovered else ("t", "s")
    inside = lambda kind, texts: F.transform(texts, lambda x: key(kind, c("root"), core, x))
    keys = F.array(key("l", c("launch")), F.when(c("path") != "", key("p", c("path"), core)), F.when(c("family") != "", key("r", c("root"), core, c("family"))))
    keys = F.concat(keys, F.coalesce(inside(own, stems), none), F.coalesce(inside(other, begins), none))
    return keyed.select(F.explode(F.array_distinct(F.array_compact(keys))).alias("k"), c("id").alias("id"))


def absorb(rows: DataFrame) -> DataFrame:
    """Discovered rows go into the first formal or system row that is the same program."""
    return absorbed(rows, absorb_pairs(rows))


def merge_formal(rows: DataFrame) -> DataFrame:
    """Formal rows with one compact name go into the first of them (by source, then id) if they are its
    shell twin, both web shortcuts, or the same program; others with the name stay."""
    formal = keys_of(rows.where(F.col("source").isin(*FORMAL_ORDER)), "b").where("b_compact <> ''")
    order = F.struct(order_of(F.col("b_source"), FORMAL_ORDER), F.col("b_id"))
    first = formal.groupBy(F.col("b_compact").alias("k")).agg(F.min_by(F.struct(*formal.columns), order).alias("w"), F.count("*").alias("n")).where("n > 1")
    first = first.select("k", *(F.col(f"w.{c}").alias(c.replace("b_", "a_", 1)) for c in formal.columns))
    met = formal.join(first, F.col("b_compact") == F.col("k")).where("a_id <> b_id")
    shell = lambda s: F.col(f"{s}_source").isin("uwp", "apps-folder")
    url = lambda s: T.extension(F.col(f"{s}_target")) == "url"
    twins = shell("a") != shell("b")
    return absorbed(rows, met.where(twins | (~shell("a") & url("a") & url("b")) | same_program("a", "b")).select(F.col("a_id").alias("winner"), F.col("b_id").alias("loser")))


def drop_system_names(rows: DataFrame) -> DataFrame:
    """Apps-folder rows that are named as a system entry go."""
    system = rows.where(layer(F.col("source")) == "System").select(T.normalize(F.col("name")).alias("k")).distinct()
    shell = rows.where("source = 'apps-folder'").select("id", T.normalize(F.col("name")).alias("k")).join(system, "k", "left_semi")
    return rows.join(shell.select("id"), "id", "left_anti")


def with_metadata(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """``rows`` with a program's own texts (``metadata(target, texts)``) as further keywords."""
    said = metadata.select(T.path_key(F.col("target")).alias("k"), F.explode("texts").alias("t")).groupBy("k").agg(F.array_sort(F.collect_set("t")).alias("_texts"))
    joined = rows.join(said, T.path_key(F.col("target")) == F.col("k"), "left").drop("k")
    own = F.col("search_keywords") if "search_keywords" in rows.columns else F.array().cast("array<string>")
    display = F.col("display_name") if "display_name" in rows.columns else F.lit(None).cast("string")
    short = F.filter("_texts", lambda t: (F.trim(t) != "") & (F.octet_length(t) <= 512))
    return joined.withColumn("search_keywords", merged_keywords(F.col("name"), display, own, short)).drop("_texts")


def in_output_order(rows: DataFrame) -> DataFrame:
    """``rows`` with ``place`` from 1 by name, source, target, arguments and id, as a catalog is listed."""
    order = [F.lower("name"), F.col("source"), T.path_key(F.col("target")), F.coalesce("args", F.lit("")), F.col("id")]
    named = {f"_o{k}": c for k, c in enumerate(order)}
    return numbered(rows.withColumns(named), list(named), "place").drop(*named)


def build(rows: DataFrame) -> DataFrame:
    """All steps in their order: dedupe, commands, discoveries, formal names, system names."""
    once = dedupe(rows)
    once = once.drop("search_keywords").withColumnRenamed("keywords", "search_keywords")
    return drop_system_names(merge_formal(absorb(merge_commands(once))))


def launch_groups(rows: DataFrame) -> DataFrame:
    """``(id, group_id)``: rows that start the same thing.

    Rows are linked by their launch, by one file with equal arguments, by installation and family (or
    a file named as the family's first word), and packaged programs by family, also with rows of
    formal path sources and app paths that have no installation folder of their own. Each rule is a
    key: rows of a key are linked to its smallest id, never pairwise; groups are the components.
    """
    # rows that say the same are linked alike: one of them stands for them, and keys are worked out once
    said = ["name", "target", "args", "source"]
    sized = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in said]
    rows = rows.select("id", *said, F.sha2(F.concat(*sized).cast("binary"), 256).alias("alike"))
    alike = rows.groupBy("alike", *said).agg(F.min("id").alias("id"), F.max("id").alias("last"))
    alike = stage(alike.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism), "alike")
    t = F.col("target")
    read = {"family": T.family_key(F.col("name")), "path": T.path_key(F.trim(T.shell_body(t))), "root": T.install_root(t), "core": T.arguments_core(F.col("args")), "stem": F.lower(T.stem(T.shell_body(t))), "shell": T.is_shell_package(t)}
    read = alike.withColumns(read)
    family, path, root, core, stem, shell = (F.col(c) for c in ("family", "path", "root", "core", "stem", "shell"))
    first = F.substring_index(family, " ", 1)
    named = (F.octet_length(stem) >= 3) & ~F.contains(stem, F.lit(" "))
    friendly = F.col("source").isin("start-menu", "desktop", "portable", "manual", "app-paths")
    key = lambda kind, role, *parts: F.struct(F.concat(F.lit(kind), *(x for p in parts for x in (F.lit("\x1f"), p))).alias("key"), F.lit(role).alias("role"))
    keys = F.array(
        key("l", 0, T.launch_identity(t, F.col("args"))),
        F.when(F.rlike(path, F.lit(r"\\")), key("e", 0, path, core)),
        F.when(family != "", key("r", 0, root, family)),
        F.when(family != "", key("s", 1, root, first)),
        F.when(named, key("s", 2, root, stem)),
        F.when((family != "") & (shell | (friendly & root.isNotNull())), key("f", 0, family)),
    )
    # of a file only whether it is another's counts: 128 bits tell files apart, and numbers are compared
    # without sorting the keys' rows
    one, two = (F.when(path.isNotNull(), F.xxhash64(*salt, path)).alias(n) for n, salt in (("one", []), ("two", [F.lit("\x1f")])))
    keyed = read.select("id", "last", "shell", one, two, F.explode(keys).alias("k")).select("id", "last", "shell", "one", "two", "k.key", "k.role")
    keyed = stage(keyed.where(F.col("key").isNotNull()), "keys")  # they are read twice
    of_files = [f(c).alias(f"{n}_{c}") for c in ("one", "two") for n, f in (("p", F.min), ("q", F.max))]
    heads = keyed.groupBy("key").agg(F.min("id").alias("head"), F.max("last").alias("last"), *of_files, F.max("shell").alias("any_shell"), F.min("role").alias("r"), F.max("role").alias("t"))
    # rows of one file are one only with equal arguments, so a family must hold several files; a file's
    # name links rows of a family to the file's rows; path rows of a family are linked by a packaged one
    heads = heads.where("head <> last AND (left(key, 1) IN ('l', 'e') OR p_one <> q_one OR p_two <> q_two) AND (left(key, 1) <> 's' OR (r = 1 AND t = 2)) AND (left(key, 1) <> 'f' OR any_shell)")
    edges = stage(keyed.join(heads.select("key", "head"), "key").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), "edges")
    linked = edges.select(F.col("b").alias("id")).distinct()
    found = connected_components(edges)
    found = linked.join(found, linked["id"] == found["node"], "left").select("id", F.coalesce("component", "id").alias("group_id"))
    of_class = alike.select("alike", "id").join(found, "id").select("alike", "group_id")
    return rows.select("id", "alike").join(of_class, "alike", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))


def launch_rank(rows: DataFrame) -> Column:
    """Order in which a group's rows are taken to stand for it: source, working folder, id."""
    has, source = set(rows.columns), F.col("source")
    rank = order_of(source, LAUNCH_ORDER)
    if "is_lnk" in has:
        rank = F.when(F.col("is_lnk") & (source == "start-menu"), 0).when(F.col("is_lnk") & (source == "desktop"), 1).otherwise(rank)
    no_folder = F.col("working_dir").isNull().cast("int") if "working_dir" in has else F.lit(0)
    return F.struct(rank.alias("rank"), no_folder.alias("no_folder"), F.col("id").alias("id"))


def representatives(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``(group_id, id)``: of each group the row that stands for it."""
    joined = rows.join(groups, "id")
    return joined.groupBy("group_id").agg(F.min(launch_rank(joined)).alias("m")).select("group_id", F.col("m.id").alias("id"))


def keep_per_folder(rows: DataFrame, per_folder: int, total: int | None = None) -> DataFrame:
    """At most so many rows of each folder, in order of path, and in all: the scanner's own limits."""
    kept = rows.withColumn("_k", F.row_number().over(Window.partitionBy("folder").orderBy("path"))).where(F.col("_k") <= per_folder).drop("_k")
    return kept if total is None else kept.orderBy("folder", "path").limit(total)
