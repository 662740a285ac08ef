"""A file index kept current by a stream of change rounds over a fixed base.

State holds only what changed since the base: ``objects(volume, frn, is_dir, paths)``, renamed folders
``prefixes(volume, base, current)`` and the base rows that are superseded, ``shadow(ordinal)``. A round
is applied as a whole once its commit is there; folders first, in order, then every object.

Frames are JSON lines ``seq, kind, round, ordinal, volume, frn, is_dir, paths, identity_only`` of kind
``round_begin``, ``change``, ``round_commit``.
"""

from __future__ import annotations

import re
import threading
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from seekstone.functions import text as T
from seekstone.operators.files import ancestors, innermost, order_key, within
from seekstone.shared import new_folder, stage
from seekstone.sources.sinks import move_pointer, pointed
from seekstone.streaming import feed
from seekstone.streaming.feed import FRAME, TIMEOUT

OBJECTS = "volume string, frn bigint, is_dir boolean, paths array<string>"
PREFIXES = "volume string, base string, current string"
SHADOW = "ordinal bigint"
CURSORS = "volume string, usn bigint"
#: Folder changes of longer rounds are joined by a shuffle.
BROADCAST_CHANGES = 10_000
#: A path that this many changes of a round have moved takes the rest of them one by one.
ROUNDS = 32
#: Over how many tasks a joined folder that very many rows lie in is dealt.
SALTS = 32
SAYING = threading.Lock()
OPS = "array<struct<old:string,new:string>>"


def empty_state(spark: SparkSession) -> dict[str, DataFrame]:
    return {"objects": spark.createDataFrame([], OBJECTS), "prefixes": spark.createDataFrame([], PREFIXES), "shadow": spark.createDataFrame([], SHADOW)}


def folded(path: str, ops: str) -> str:
    """SQL of a path after folder changes in their order: moved with its folder, null once it is deleted."""
    inside = "(lower(p) = lower(o.old) OR startswith(lower(p), concat(lower(o.old), '\\\\')))"
    return f"aggregate({ops}, {path}, (p, o) -> CASE WHEN p IS NULL THEN NULL WHEN {inside} THEN CASE WHEN o.new IS NOT NULL THEN concat(o.new, substr(p, length(o.old) + 1)) END ELSE p END)"


def current_paths(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``rows(volume, path, ...)`` with ``current``: under the nearest renamed folder's present name."""
    folders = prefixes.select(order_key(F.col("base"), F.col("volume")).alias("key"), F.struct("base", F.col("current").alias("now")).alias("value")).groupBy("key").agg(F.max("value").alias("value"))
    out = innermost(rows, order_key(F.col("path"), F.col("volume")), folders, "m")
    return out.withColumn("current", F.when(F.col("m").isNull(), F.col("path")).otherwise(F.concat("m.now", F.substr(F.col("path"), F.length("m.base") + 1)))).drop("m")


def based_folders(touched: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``(key)``: folders of the base in which all rows lie whose present path is in one of
    ``touched(volume, folder)``: the folder itself, and what renamed folders have put there."""
    # a round's folders and the renamed ones meet on what is above either, never each with each
    folder, current = T.path_key(F.col("folder")), T.path_key(F.col("current"))
    below = prefixes.select("volume", "base", F.explode(ancestors(F.col("current"))).alias("k")).join(touched.select("volume", folder.alias("k")), ["volume", "k"]).select("volume", F.col("base").alias("folder"))
    above = touched.select("volume", "folder", F.explode(ancestors(F.col("folder"))).alias("k")).join(prefixes.select("volume", "base", "current", current.alias("k")), ["volume", "k"])
    back = above.select("volume", F.concat("base", F.substr(F.col("folder"), F.length("current") + 1)).alias("folder"))
    of = touched.select("volume", "folder").unionByName(below).unionByName(back)
    return of.select(order_key(F.col("folder"), F.col("volume")).alias("key")).distinct()


def moves(paths: DataFrame, ops: DataFrame) -> DataFrame:
    """``(volume, path, now)`` of the ``paths(volume, path)`` that a round's folder changes ``ops(volume,
    ops)`` touch: where they stand after all of them in their order, null once deleted.

    A path looks up the folders above it and takes the first change behind its last one, until none
    is left: changes that it does not lie in are never looked at.
    """
    # changes of a folder are found by its name in lower case, as ``folded`` compares
    steps = stage(ops.select("volume", F.posexplode("ops").alias("n", "o")).select("volume", "n", "o.old", "o.new", F.lower("o.old").alias("key")), "steps")
    many = steps.count() > BROADCAST_CHANGES
    parts = F.split(F.lower("now"), r"\\")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "\\"))
    salt = F.pmod(F.xxhash64("path"), F.lit(SALTS)) if many else F.lit(0).cast("bigint")
    asked = steps.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))) if many else F.broadcast(steps.withColumn("salt", salt))
    left = paths.where("path is not null").select("volume", "path", F.col("path").alias("now"), F.lit(-1).alias("at"))
    found = []
    while True:
        met = left.select("*", salt.alias("salt"), F.explode(above).alias("key")).join(asked, ["volume", "key", "salt"]).where("n > at")
        first = met.groupBy("volume", "path").agg(F.min_by(F.struct("now", "old", "new", "n"), "n").alias("m"))
        found.append(stage(first.select("volume", "path", F.when(F.col("m.new").isNotNull(), F.concat("m.new", F.expr("substr(m.now, length(m.old) + 1)"))).alias("now"), F.col("m.n").alias("at")), "moves"))
        left = found[-1].where("now is not null")
        if left.isEmpty():
            break
        if len(found) == ROUNDS:
            rest = left.join(ops, "volume").withColumn("now", F.expr(folded("now", "filter(ops, (o, i) -> i > at)")))
            found.append(stage(rest.select("volume", "path", "now", F.size("ops").alias("at")), "moves"))
            break
    whole = found[0]
    for x in found[1:]:
        whole = whole.unionByName(x)
    return whole.groupBy("volume", "path").agg(F.max_by(F.struct("now"), "at").alias("m")).select("volume", "path", "m.now")


def folder_changes(base: DataFrame, state: dict[str, DataFrame], changes: DataFrame) -> DataFrame:
    """``(volume, ops)``: a round's folder moves and deletions in order, each from where its folder stands
    after those before it. One row a volume; a round's folders are as many as its producer sent at once."""
    folders = changes.where("is_dir and not identity_only")
    known = folders.join(state["objects"].select("volume", "frn", F.col("paths").alias("_held")), ["volume", "frn"], "left")
    records = current_paths(base.join(folders.select("volume", "frn"), ["volume", "frn"], "left_semi"), state["prefixes"])
    records = records.groupBy("volume", "frn").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "current"))), lambda x: x["current"]).alias("_based"))
    olds = F.when(F.size("_held") > 0, F.col("_held")).otherwise(F.coalesce("_based", F.array().cast("array<string>")))
    listed = known.join(records, ["volume", "frn"], "left").select("volume", F.struct("ordinal", olds.alias("olds"), "paths").alias("d"))
    listed = listed.groupBy("volume").agg(F.array_sort(F.collect_list("d")).alias("folders"))
    # a folder with fewer new names than old ones keeps the others; without any it is deleted
    each = f"filter(transform(d.olds, (x, i) -> struct({folded('x', 'ops')} AS old, get(d.paths, i) AS new)), z -> z.old IS NOT NULL AND (z.new IS NOT NULL OR size(d.paths) = 0) AND NOT (z.old <=> z.new))"
    return listed.select("volume", F.expr(f"aggregate(folders, CAST(array() AS {OPS}), (ops, d) -> CAST(concat(ops, {each}) AS {OPS}))").alias("ops"))


def checked(base: DataFrame, changes: DataFrame) -> DataFrame:
    """The first change of each object in a round; a change of kind, or paths where only the identity
    goes, is an error of the query."""
    first = changes.groupBy("volume", "frn").agg(F.min_by(F.struct("ordinal", "is_dir", "paths", "identity_only"), "ordinal").alias("c"), F.count_distinct("is_dir").alias("kinds"))
    kinds = base.join(changes.select("volume", "frn").distinct(), ["volume", "frn"], "left_semi").groupBy("volume", "frn").agg(F.max("is_dir").alias("was_dir"))
    both = first.join(kinds, ["volume", "frn"], "left")
    wrong = (F.col("kinds") > 1) | (F.col("was_dir") != F.col("c.is_dir")) | (F.coalesce("c.identity_only", F.lit(False)) & (F.size(F.coalesce("c.paths", F.array())) > 0))
    paths = F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(F.lit("a change disagrees with its object"))).otherwise(F.coalesce("c.paths", F.array().cast("array<string>")))
    return both.select("volume", "frn", "c.ordinal", "c.is_dir", paths.alias("paths"), F.coalesce("c.identity_only", F.lit(False)).alias("identity_only"))


def apply_round(base: DataFrame, state: dict[str, DataFrame], changes: DataFrame) -> dict[str, DataFrame]:
    """The state after one committed round of ``changes`` over ``base(ordinal, volume, frn, is_dir, path)``."""
    changes = stage(checked(base, changes), "round")
    ops = stage(folder_changes(base, state, changes), "folder-ops")
    objects, prefixes, shadow = state["objects"], state["prefixes"], state["shadow"]
    if not ops.isEmpty():
        of = ops.select("volume", F.lit(True).alias("_any"))
        of = F.broadcast(of) if changes.count() <= BROADCAST_CHANGES else of  # a row a volume
        # every path that stands in the state, and base rows below a deleted folder, of which ranges of the base hold all that may be
        held = objects.select("volume", F.explode("paths").alias("path")).unionByName(prefixes.select("volume", F.col("current").alias("path")))
        reach = None
        if not ops.where("exists(ops, o -> o.new is null)").isEmpty():
            touched = ops.select("volume", F.explode("ops").alias("o")).select("volume", F.col("o.old").alias("folder")).distinct()
            reach = within(base, order_key(F.col("path"), F.col("volume")), based_folders(touched, state["prefixes"]))
            reach = stage(current_paths(reach.join(shadow, "ordinal", "left_anti"), state["prefixes"]).select("volume", "ordinal", F.col("current").alias("path")), "reach")
            held = held.unionByName(reach.select("volume", "path"))
        moved = stage(moves(held, ops), "moved")
        put = objects.select("volume", "frn", F.explode("paths").alias("path")).join(moved, ["volume", "path"])
        put = put.groupBy("volume", "frn").agg(F.map_from_entries(F.collect_set(F.struct("path", "now"))).alias("_put"))
        objects = objects.join(put, ["volume", "frn"], "left").join(of, "volume", "left")
        replaced = F.expr("transform(paths, x -> CASE WHEN map_contains_key(_put, x) THEN _put[x] ELSE x END)")
        paths = F.when(F.col("_put").isNotNull(), replaced).otherwise(F.col("paths"))
        objects = objects.withColumn("paths", F.when(F.col("_any").isNull(), F.col("paths")).otherwise(F.array_compact(paths))).drop("_put", "_any").where("size(paths) > 0")
        prefixes = prefixes.join(moved.withColumnRenamed("path", "current").withColumn("_moved", F.lit(True)), ["volume", "current"], "left")
        prefixes = prefixes.select("volume", "base", F.when(F.col("_moved"), F.col("now")).otherwise(F.col("current")).alias("current")).where("current is not null")
        if reach is not None:
            shadow = shadow.unionByName(reach.join(moved.where("now is null"), ["volume", "path"], "left_semi").select("ordinal"))
    records = base.join(changes.select("volume", "frn", "paths"), ["volume", "frn"])
    shadow = shadow.unionByName(records.select("ordinal")).distinct()
    nth = F.row_number().over(Window.partitionBy("volume", "frn").orderBy("ordinal")) - 1
    renamed = records.where("is_dir").withColumn("n", nth).withColumn("now", F.get("paths", F.col("n"))).where("now is not null").select("volume", F.col("path").alias("base"), F.col("now").alias("current"))
    prefixes = prefixes.join(renamed.select("volume", "base"), ["volume", "base"], "left_anti").unionByName(renamed)
    objects = objects.join(changes.select("volume", "frn"), ["volume", "frn"], "left_anti").unionByName(changes.where("size(paths) > 0").select("volume", "frn", "is_dir", "paths"))
    return {"objects": stage(objects, "objects"), "prefixes": stage(prefixes, "prefixes"), "shadow": stage(shadow, "shadow")}


def view(base: DataFrame, state: dict[str, DataFrame]) -> DataFrame:
    """``(volume, frn, is_dir, path)`` as it is now; a path that stands twice comes once, base rows first."""
    old = current_paths(base.join(state["shadow"], "ordinal", "left_anti"), state["prefixes"]).select("volume", "frn", "is_dir", F.col("current").alias("path"), F.lit(0).alias("late"))
    new = state["objects"].select("volume", "frn", "is_dir", F.explode("paths").alias("path"), F.lit(1).alias("late"))
    once = old.unionByName(new).groupBy("volume", "path").agg(F.min(F.struct("late", "frn", "is_dir")).alias("m"))
    return once.select("volume", "m.frn", "m.is_dir", "path")


class StaleFeed(RuntimeError):
    """The view may lag behind or be wrong; readers get this instead of rows."""


class NotReady(RuntimeError):
    """Not every volume has been read up to where the base was taken."""


def _saved(spark: SparkSession, home: str, number: int) -> tuple[dict[str, DataFrame], DataFrame, DataFrame, int]:
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{home}/state/{number}/{name}")
    last = read("position", "seq bigint").first()["seq"]
    return {"objects": read("objects", OBJECTS), "prefixes": read("prefixes", PREFIXES), "shadow": read("shadow", SHADOW)}, read("pending", FRAME), read("cursors", CURSORS), last


def _start(spark: SparkSession) -> tuple[dict[str, DataFrame], DataFrame, DataFrame, int]:
    return empty_state(spark), spark.createDataFrame([], FRAME), spark.createDataFrame([], CURSORS), 0


def _applied(spark: SparkSession, home: str, number: int) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/state/{number}/position/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def advance(base: DataFrame, home: str, batch: DataFrame, number: int) -> None:
    """Apply a batch of frames to the state of the batch before and save it under the batch's number."""
    spark = base.sparkSession
    state, pending, cursors, last = _saved(spark, home, number - 1) if number else _start(spark)
    new = stage(batch, "frames")
    least, most, n, distinct = new.agg(F.min("seq"), F.max("seq"), F.count("*"), F.count_distinct("seq")).first()
    if n and (least != last + 1 or most - least + 1 != n or distinct != n):
        raise RuntimeError(f"frames {least} to {most} do not follow {last} without a gap")
    frames = stage(pending.unionByName(new), "open-frames")
    # a frame of kind batch is a unit of its own, committed as it comes
    alone = F.col("kind") == "batch"
    frames = frames.withColumns({"round": F.when(alone, -F.col("seq")).otherwise(F.col("round"))})
    ends = frames.where("kind in ('round_commit', 'batch')")
    rounds = [r["round"] for r in ends.select("round", "seq").orderBy("seq").collect()]  # one a round
    for r in rounds:
        state = apply_round(base, state, frames.where((F.col("round") == r) & F.col("kind").isin("change", "batch")).drop("seq", "kind", "round", "cursors"))
    left = frames.where(~F.col("round").isin(rounds)) if rounds else frames
    read = ends.select(F.explode("cursors").alias("c")).select("c.volume", "c.usn")
    cursors = cursors.unionByName(read).groupBy("volume").agg(F.max("usn").alias("usn"))
    for name, table in (*state.items(), ("pending", left), ("cursors", cursors), ("position", spark.range(1).select(F.lit(most if n else last).cast("long").alias("seq")))):
        table.write.mode("overwrite").parquet(f"{home}/state/{number}/{name}")


def cause(message: str) -> str:
    """Of an error with all that it went through, the line that says what happened first."""
    said = [x.strip() for x in message.splitlines() if re.match(r"\s*[\w.]*(Error|Rebuild)\b[^:]*: ", x)]
    return (said[0] if said else message)[:500]


def counters(state: dict[str, DataFrame]) -> DataFrame:
    """One row of how many objects, renamed folders and superseded base rows a state holds."""
    counts = [t.agg(F.count("*").alias(name)) for name, t in state.items()]
    return counts[0].join(F.broadcast(counts[1])).join(F.broadcast(counts[2]))  # a row each


def say(spark: SparkSession, home: str, **what) -> None:
    """Replace the status that readers look at; the listener's thread and a run's own take turns."""
    with SAYING:
        move_pointer(spark, f"{home}/status", (pointed(spark, f"{home}/status") or {}) | what)


class Watch(StreamingQueryListener):
    """Writes the status of a running overlay: live with each progress, stale once it fails."""

    def __init__(self, spark: SparkSession, home: str, name: str):
        self.spark, self.home, self.name = spark, home, name

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.run = event.runId
            say(self.spark, self.home, state="live", at=time.time())

    def onQueryProgress(self, event) -> None:
        if event.progress.name == self.name:
            say(self.spark, self.home, state="live", at=time.time(), batch=event.progress.batchId)

    def onQueryIdle(self, event) -> None:
        if event.runId == getattr(self, "run", None):
            say(self.spark, self.home, state="live", at=time.time())

    def onQueryTerminated(self, event) -> None:
        if event.runId == getattr(self, "run", None) and event.exception:
            say(self.spark, self.home, state="stale", reason=cause(event.exception))


def start(base: DataFrame, source: str, home: str, files_at_once: int = 4, from_feed: bool = False, once: bool = False) -> tuple[StreamingQuery, Watch]:
    """Follow frame files in folder ``source``, or a feed there, as a streaming query over ``home``."""
    spark = base.sparkSession
    if from_feed:
        feed.register(spark)
        frames = spark.readStream.format("feed").load(source)
    else:
        frames = spark.readStream.schema(FRAME).option("maxFilesPerTrigger", files_at_once).json(source)
    name = "overlay-" + home.rstrip("/").rpartition("/")[2]
    watch = Watch(spark, home, name)
    spark.streams.addListener(watch)
    writer = frames.writeStream.queryName(name).foreachBatch(lambda batch, number: advance(base, home, batch, number)).option("checkpointLocation", f"{home}/checkpoint")
    # a Python data source takes part in plain triggers only: it stops when it has caught up
    return (writer.trigger(availableNow=True) if once and not from_feed else writer.trigger(processingTime="200 milliseconds")).start(), watch


def _latest(spark: SparkSession, home: str) -> int:
    """The number of the last batch that was applied in full, -1 before the first."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/state")
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    numbers = sorted((int(s.getPath().getName()) for s in fs.listStatus(fs_path)), reverse=True) if fs.exists(fs_path) else []
    return next((n for n in numbers if _applied(spark, home, n)), -1)


def saved(spark: SparkSession, home: str) -> tuple[dict[str, DataFrame], DataFrame, DataFrame, int]:
    """State, open frames, cursors and position after the last batch that was applied in full."""
    last = _latest(spark, home)
    return _saved(spark, home, last) if last >= 0 else _start(spark)


def follow(base: DataFrame, source: str, home: str | None = None, files_at_once: int = 4, from_feed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Read all new frames in folder ``source`` (with ``from_feed`` a feed's) and return the present view,
    and frames still waiting for their commit.

    A batch's state is a folder named by its number: a batch that runs again replaces its own result.
    Sequence numbers run without a gap over all batches; a gap is an error and leaves the last state as
    it is, so that no reader sees rows that may be wrong: the status says that the view is stale. With
    the ``home`` of an earlier run only new frames are read.
    """
    spark = base.sparkSession
    home = home or new_folder(spark, "overlay")
    query, watch = start(base, source, home, files_at_once, from_feed, once=True)
    try:
        if from_feed:
            query.processAllAvailable()
            query.stop()
        query.awaitTermination()
        if from_feed and (ends := [p.sources[0].endOffset for p in query.recentProgress if p.numInputRows]):
            feed.acknowledge(source, int(re.search(r"\d+", str(ends[-1]))[0]))
    except Exception as failed:
        say(spark, home, state="stale", reason=cause(str(failed)))
        raise
    finally:
        query.stop()
        spark.streams.removeListener(watch)
    state, pending, _, _ = saved(spark, home)
    say(spark, home, state="live", at=time.time())
    return view(base, state), pending


def freeze(targets: DataFrame, home: str) -> None:
    """Keep how far each volume had been read when the base was taken (``volume, usn``)."""
    targets.select("volume", "usn").write.mode("overwrite").parquet(f"{home}/targets")


def present(base: DataFrame, home: str, source: str | None = None, now: float | None = None, timeout: float = TIMEOUT) -> DataFrame:
    """The view, if it may be shown: the overlay runs or ended well, its producer (the feed ``source``)
    gave a sign of life within ``timeout`` seconds, and every volume has reached its frozen target."""
    spark = base.sparkSession
    status = pointed(spark, f"{home}/status")
    if status is None:
        raise NotReady("nothing has been followed yet")
    if status["state"] != "live":
        raise StaleFeed(status.get("reason", "the overlay stopped"))
    alive = feed.manifest(source)["at"] if source is not None else status["at"]
    if (time.time() if now is None else now) - alive > timeout:
        raise StaleFeed(f"no sign of life for more than {timeout} seconds")
    state, _, cursors, _ = saved(spark, home)
    if not caught_up(cursors, spark.read.schema(CURSORS).parquet(f"{home}/targets")):
        raise NotReady("a volume has not reached its target")
    return view(base, state)


def caught_up(cursors: DataFrame, targets: DataFrame) -> Column | bool:
    """Whether every volume's cursor has reached its target (``volume, usn``)."""
    return targets.join(cursors.withColumnRenamed("usn", "_at"), "volume", "left").where("_at is null or _at < usn").isEmpty()
