"""Search of file paths: filters, trees, renamed folders, and a base with a live overlay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seekstone.functions import text as T
from seekstone.operators.ordered import last_before
from seekstone.shared import stage

#: So many folders become a condition of the scan; more are sorted together with the rows.
FEW = 64
#: Bytes of paths that a task of a round of doubling joins, about.
TASK_BYTES = 32 << 20

#: Extensions of each type (fixed values).
TYPES = {
    "images": "jpg jpeg png gif webp bmp ico svg heic heif avif tif tiff".split(),
    "documents": "pdf doc docx xls xlsx ppt pptx txt md rtf odt ods odp csv".split(),
    "videos": "mp4 mkv mov avi wmv webm flv m4v mpeg mpg".split(),
    "audio": "mp3 wav flac aac m4a ogg wma opus".split(),
    "archives": "zip 7z rar tar gz bz2 xz iso".split(),
}


def of_type(path: Column, is_dir: Column, kind: str) -> Column:
    """Whether a path is of a type; folders only pass ``folders`` and ``all``."""
    if kind == "all":
        return F.lit(True)
    return is_dir if kind == "folders" else ~is_dir & T.extension(path).isin(*TYPES[kind])


def name_has_all(path: Column, query: Column) -> Column:
    """Whether the name holds every word of the query, case ignored; no words match all."""
    name = F.lower(T.basename(path))
    return F.forall(T.tokens(F.lower(query)), lambda t: F.contains(name, t))


def ancestors(path: Column) -> Column:
    """The path and all folders above it, as keys."""
    parts = F.split(T.path_key(path), r"\\")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "\\"))


def order_key(path: Column, volume: Column | None = None) -> Column:
    """A text in whose order a folder is followed by all that lies in it, before anything else: what lies
    in folder k are the keys from k up to ``end_of(k)``. Volumes follow one another."""
    key = F.translate(F.rtrim(T.path_key(path), F.lit("\\")), "\\", "\x01")
    return key if volume is None else F.concat(volume.cast("string"), F.lit("\x00"), key)


def end_of(key: Column) -> Column:
    return F.concat(key, F.lit("\x02"))


def enclosing(folders: DataFrame) -> DataFrame:
    """``folders(key)`` with ``outer``: the innermost other folder of them that holds it, or null."""
    parts = F.split("key", "\x01")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "\x01"))
    keys = folders.select("key").distinct()
    climbed = keys.select("key", F.explode(F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))).alias("outer"))
    best = climbed.join(keys.select(F.col("key").alias("outer")), "outer").groupBy("key").agg(F.max_by("outer", F.length("outer")).alias("outer"))
    return folders.join(best, "key", "left")


def within(rows: DataFrame, key: Column, folders: DataFrame, few: int = FEW) -> DataFrame:
    """``rows`` that lie in any of ``folders(key)``, the folders themselves too; no row's ancestors are listed.

    Only outermost folders count, so their ranges are apart. Few of them become a condition on the key
    that reaches a scan of sorted files; more are marks that rows and they are sorted together for.
    """
    outermost = stage(enclosing(folders.select("key").distinct()).where("outer is null").select("key"), "folders")
    if outermost.count() <= few:
        ranges = [r["key"] for r in outermost.orderBy("key").collect()]
        inside = F.lit(False)
        for k in ranges:
            inside = inside | key.between(k, k + "\x02")
        return rows.where(inside)
    marks = outermost.select("key", F.lit(True).alias("value")).unionByName(outermost.select(end_of(F.col("key")).alias("key"), F.lit(False).alias("value")))
    return last_before(rows.withColumn("_key", key), "_key", marks, "_in").where("_in").drop("_key", "_in")


def innermost(rows: DataFrame, key: Column, folders: DataFrame, name: str, few: int = FEW) -> DataFrame:
    """``rows`` with ``name``: ``value`` of the innermost of ``folders(key, value)`` that holds a row, or null.

    Nested ranges become stretches, each with its innermost folder; a row takes the last stretch that
    begins before it.
    """
    held = stage(enclosing(folders), "folders")
    values = held.select(F.col("key").alias("outer"), F.col("value").alias("_outer"))
    ends = held.join(values, "outer", "left").select(end_of(F.col("key")).alias("key"), F.col("_outer").alias("value"))
    marks = held.select("key", "value").unionByName(ends)
    if held.count() <= few:
        # stretches of few folders, each up to where the next begins: a row lies in one at most
        upto = F.lead("key").over(Window.orderBy("key"))
        listed = stage(marks.select(F.col("key").alias("_from"), upto.alias("_to"), F.col("value").alias(name)), "stretches").where(F.col(name).isNotNull())
        keyed = rows.withColumn("_key", key)
        return keyed.join(F.broadcast(listed), (F.col("_key") >= F.col("_from")) & (F.col("_key") < F.col("_to")), "left").drop("_key", "_from", "_to")
    return last_before(rows.withColumn("_key", key), "_key", marks, name).drop("_key")


def excludable(folder: Column) -> Column:
    """Whether a folder may be excluded: an absolute drive path without NUL and without dot parts."""
    path = F.translate(folder, "/", "\\")
    dots = F.exists(F.split(F.substr(path, F.lit(4)), r"\\"), lambda x: x.isin(".", ".."))
    return F.coalesce(F.rlike(path, F.lit(r"^[A-Za-z]:\\")) & ~F.contains(path, F.char(F.lit(0))) & ~dots, F.lit(False))


def outside(rows: DataFrame, excluded: DataFrame, checked: bool = False) -> DataFrame:
    """``rows(path, ...)`` that lie in none of ``excluded(folder)``; rows without a path lie in none.

    With ``checked`` a folder that may not be excluded is an error of the query.
    """
    if checked:
        wrong = F.raise_error(F.concat(F.lit("not an absolute folder: "), F.coalesce("folder", F.lit("null"))))
        excluded = excluded.withColumn("folder", F.when(excludable(F.col("folder")), F.col("folder")).otherwise(wrong))
    marked = innermost(rows, order_key(F.col("path")), excluded.where("folder is not null").select(order_key(F.col("folder")).alias("key"), F.lit(True).alias("value")).distinct(), "_out")
    return marked.where("_out is null").drop("_out")


def renamed(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """``rows`` with ``current``: the longest renamed folder above a path replaced (``moves(base, now)``;
    of moves of one folder the last by name counts)."""
    folders = moves.select(order_key(F.col("base")).alias("key"), F.struct(F.length("base").alias("n"), "now").alias("value")).groupBy("key").agg(F.max("value").alias("value"))
    out = innermost(rows, order_key(F.col("path")), folders, "_m")
    return out.withColumn("current", F.when(F.col("_m").isNull(), F.col("path")).otherwise(F.concat("_m.now", F.substr(F.col("path"), F.col("_m.n") + 1)))).drop("_m")


def overlaid(base: DataFrame, changes: DataFrame) -> DataFrame:
    """``(frn, path)`` after ``changes(frn, seq, path)``: the latest change of a file shadows its base
    rows; a null path deletes. A path that stands twice comes once, the base row before the overlay's."""
    latest = changes.groupBy("frn").agg(F.max(F.struct("seq", "path")).alias("c")).select("frn", "c.path")
    both = base.select("frn", "path").join(latest, "frn", "left_anti").withColumn("late", F.lit(0)).unionByName(latest.where("path is not null").withColumn("late", F.lit(1)))
    return both.groupBy("path").agg(F.min(F.struct("late", "frn")).alias("m")).select(F.col("m.frn").alias("frn"), "path")


def identities(base: DataFrame) -> DataFrame:
    """``base(volume, frn, ordinal, ...)`` dealt and sorted by identity, so that a written table finds an
    object's paths by its files' and row groups' bounds."""
    return base.repartitionByRange("volume", "frn", "ordinal").sortWithinPartitions("volume", "frn", "ordinal")


def snapshots_merged(snapshots: DataFrame, bases: DataFrame) -> DataFrame:
    """``snapshots(volume, ordinal, path)`` as one table whose ordinals run through: each volume's begin
    where the volumes before it end (``bases(volume, rows)``)."""
    before = Window.orderBy("volume").rowsBetween(Window.unboundedPreceding, -1)
    starts = bases.select("volume", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))  # one row a volume: 26 at most
    return snapshots.join(F.broadcast(starts), "volume").select((F.col("ordinal") + F.col("start")).alias("ordinal"), "volume", "path")


def found_paths(base: DataFrame, moves: DataFrame, overlay: DataFrame, query: Column, kind: str, excluded: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The file query: at most ``limit`` hits ``(origin, position, path)``, and the exact number of all.

    ``base(ordinal, frn, path, is_dir, shadowed)`` matches by its own name, filters look at the path
    after renamed folders (``moves``); ``overlay(volume, frn, path, is_dir)`` rows follow in order of
    volume and number. Hits that show one path come once, the total counts them as they are.
    """
    if not 0 <= limit <= 1000:
        raise ValueError("limit must be 0..1000")
    shown = renamed(base.where("not shadowed").where(name_has_all(F.col("path"), query)), moves)
    first = shown.select(F.lit(0).alias("origin"), F.lit("").alias("volume"), F.col("ordinal").alias("position"), F.col("current").alias("path"), "is_dir")
    later = overlay.where(name_has_all(F.col("path"), query)).select(F.lit(1).alias("origin"), "volume", F.col("frn").alias("position"), "path", "is_dir")
    fits = first.unionByName(later).where(of_type(F.col("path"), F.col("is_dir"), kind))
    fits = outside(fits, excluded, True)
    once = fits.groupBy(T.path_key(F.col("path")).alias("key")).agg(F.min(F.struct("origin", "volume", "position", "path")).alias("m")).select("m.*")
    return once.orderBy("origin", "volume", "position").limit(limit).select("origin", "position", "path"), fits.agg(F.count("*").alias("total"))


def with_a_way_up(nodes: DataFrame, max_depth: int = 32_768) -> DataFrame:
    """``(frn)`` of ``nodes(frn, parent_frn)`` that some way leads to a root.

    Pointers double: after n rounds a node's pointer leads 2**n steps up, so the rounds are the
    logarithm of the depth. Only pointers travel. Nodes of a cycle, or below one or below a missing
    parent, never end; once no node ends in a round none will in a later one.
    """
    step = stage(nodes.select("frn", F.col("parent_frn").alias("up")).distinct().withColumn("steps", F.lit(1)), "tree-ways")
    while True:
        deepest, waiting = step.agg(F.max(F.when(F.col("up").isNull(), F.col("steps"))), F.count_if(F.col("up").isNotNull())).first()
        if (deepest or 0) > max_depth:
            raise RuntimeError(f"a tree deeper than {max_depth} levels")
        ended = step.where("up is null")
        if not waiting:
            break
        beyond = step.select(F.col("frn").alias("up"), F.col("up").alias("_next"), F.col("steps").alias("_more"))
        moved = step.where("up is not null").join(beyond, "up").groupBy("frn", F.col("_next").alias("up")).agg(F.min(F.col("steps") + F.col("_more")).alias("steps"))
        moved = stage(moved, "tree-ways")
        if moved.where("up is null").isEmpty():
            break
        step = stage(ended.unionByName(moved), "tree-ways")
    return ended.select("frn").distinct()


def tree_paths(nodes: DataFrame, max_depth: int = 32_768, overrides: DataFrame | None = None) -> DataFrame:
    """``(frn, path)`` of ``nodes(frn, parent_frn, name)``; roots have no parent.

    ``overrides(frn, path)`` state the path of some nodes, whatever their parents; what lies below
    follows it. Nodes without a way to a root get no path (``tree_faults`` names them), a node of several
    names one for each. A tree deeper than ``max_depth`` is an error. Pointers double, with the names
    that they pass: the logarithm of the depth in rounds, each a join and a staged table.
    """
    nodes = nodes.select("frn", "parent_frn", "name")
    if overrides is not None:
        stated = overrides.select("frn", F.lit(None).cast(nodes.schema["parent_frn"].dataType).alias("parent_frn"), F.col("path").alias("name"))
        nodes = nodes.join(overrides.select("frn"), "frn", "left_anti").unionByName(stated)
    sound = with_a_way_up(nodes, max_depth)
    known = nodes.join(sound, "frn", "left_semi")
    lasting = known.where("parent_frn is null").unionByName(known.join(sound.select(F.col("frn").alias("parent_frn")), "parent_frn", "left_semi").select(*known.columns))
    step = stage(lasting.select("frn", F.col("parent_frn").alias("up"), F.col("name").alias("path")), "tree-paths")
    while True:
        waiting, size = step.agg(F.count_if(F.col("up").isNotNull()), F.coalesce(F.sum(F.octet_length("path")), F.lit(0))).first()
        if not waiting:
            return step.select("frn", "path")
        # stored paths are a small part of their size in memory: by it they would be broadcast, or one task
        n = max(nodes.sparkSession.sparkContext.defaultParallelism, 2 * size // TASK_BYTES)
        beyond = step.select(F.col("frn").alias("up"), F.col("up").alias("_next"), F.col("path").alias("_above")).repartition(n, "up").hint("merge")
        moved = step.where("up is not null").repartition(n, "up").join(beyond, "up").select("frn", F.col("_next").alias("up"), F.concat_ws("\\", "_above", "path").alias("path"))
        step = stage(step.where("up is null").unionByName(moved), "tree-paths")


def tree_faults(nodes: DataFrame) -> DataFrame:
    """``(frn, fault)`` of ``nodes(frn, parent_frn, name, is_dir)``: what the layout route rejects.

    ``missing-parent``, ``parent-not-a-folder``, ``many-names`` (a folder under several names), and
    ``cycle`` for every node below none of these that no way leads to a root. One row a node, the
    first fault in this order.
    """
    parents = nodes.groupBy(F.col("frn").alias("p")).agg(F.max(F.col("is_dir").cast("int")).alias("p_dir"))
    known = nodes.join(parents, nodes["parent_frn"] == parents["p"], "left")
    names = nodes.where("is_dir").groupBy("frn").agg(F.count_distinct("parent_frn", "name").alias("n")).where("n > 1").select("frn")
    direct = known.where("parent_frn is not null and (p is null or p_dir = 0)").select("frn", F.when(F.col("p").isNull(), "missing-parent").otherwise("parent-not-a-folder").alias("fault"))
    direct = direct.unionByName(names.select("frn", F.lit("many-names").alias("fault")))
    order = F.expr("CASE fault WHEN 'missing-parent' THEN 0 WHEN 'parent-not-a-folder' THEN 1 WHEN 'many-names' THEN 2 ELSE 3 END")
    # below a missing parent a node has no way to a root either, but no cycle: those are reached from it
    starts = nodes.where("parent_frn is null").select("frn", "parent_frn", "name").unionByName(known.where("parent_frn is not null and p is null").select("frn", F.lit(None).cast("long").alias("parent_frn"), "name"))
    rest = nodes.join(starts.select("frn"), "frn", "left_anti").select("frn", "parent_frn", "name")
    reached = with_a_way_up(starts.unionByName(rest))
    lost = nodes.select("frn").distinct().join(reached, "frn", "left_anti").select("frn", F.lit("cycle").alias("fault"))
    return direct.unionByName(lost).groupBy("frn").agg(F.min_by("fault", order).alias("fault"))
