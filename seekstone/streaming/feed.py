"""The change feed as a Python data source: rotating segments, acknowledgement, reclaim, loss.

A feed is a folder of segments, JSON lines of frames in order of ``seq``, and a manifest that names
the segments that count. Writers rotate by bytes; a commit adds what its tasks wrote, if it follows
what is there without a gap, and removes segments that the consumer has acknowledged. A streaming
reader's offset is the number of the next segment; what a batch has taken is acknowledged when Spark
commits the batch, which it does as the next one begins, or when a run that has caught up ends. A reader whose next segment is gone gets ``NeedsRebuild`` and never a part of the
changes. The manifest also holds the producer's last sign of life and how far each volume was read.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Frames of a feed; ``cursors`` says how far each volume was read when a round was committed.
FRAME = "seq bigint, kind string, round bigint, ordinal bigint, volume string, frn bigint, is_dir boolean, paths array<string>, identity_only boolean, cursors array<struct<volume:string,usn:bigint>>"
#: Bytes of a segment, and seconds without a sign of life after which a producer counts as gone (fixed values).
SEGMENT_BYTES, TIMEOUT = 32 << 20, 5
MANIFEST, ACKNOWLEDGED = "manifest.json", "acknowledged.json"


class NeedsRebuild(RuntimeError):
    """Changes were removed before they were read: only a new base helps."""


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def load(path: str, name: str) -> dict | None:
    fs, base = open_fs(path)
    if fs.get_file_info(f"{base}/{name}").type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(f"{base}/{name}") as f:
        return json.loads(f.read())


def store(path: str, name: str, value: dict) -> None:
    """Replace a small file in one step."""
    fs, base = open_fs(path)
    fs.create_dir(base, recursive=True)
    new = f"{base}/{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(new) as f:
        f.write(json.dumps(value).encode())
    fs.move(new, f"{base}/{name}")


def manifest(path: str) -> dict:
    return load(path, MANIFEST) or {"segments": [], "next": 0, "through": 0, "at": 0.0, "batch": -1}


def beat(path: str, at: float | None = None) -> None:
    """A sign of life without frames."""
    store(path, MANIFEST, manifest(path) | {"at": time.time() if at is None else at})


def acknowledge(path: str, segment: int) -> None:
    """All segments before this one were taken in; never back."""
    done = (load(path, ACKNOWLEDGED) or {"segment": 0})["segment"]
    store(path, ACKNOWLEDGED, {"segment": max(done, segment)})


@dataclass
class Written(WriterCommitMessage):
    place: int = 0
    segments: list = field(default_factory=list)


class Segments:
    """What batch and streaming writers share."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.most = int(options.get("segmentbytes", SEGMENT_BYTES))
        self.retain = int(options.get("retainbytes", 0))

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        fs, base = open_fs(self.path)
        fs.create_dir(base, recursive=True)
        done, out, now = [], None, {}
        try:
            for row in iterator:
                frame = {k: v for k, v in row.asDict(recursive=True).items() if v is not None}
                line = json.dumps(frame).encode() + b"\n"
                if out is not None and now["bytes"] + len(line) > self.most:
                    self.close(out, now)
                    out = None
                if out is None:
                    now = {"name": f"{uuid.uuid4().hex}.jsonl", "bytes": 0, "first": frame["seq"], "through": frame["seq"] - 1}
                    out = fs.open_output_stream(f"{base}/{now['name']}")
                    done.append(now)
                if frame["seq"] != now["through"] + 1:
                    raise ValueError(f"frame {frame['seq']} does not follow {now['through']}")
                out.write(line)
                now["bytes"], now["through"] = now["bytes"] + len(line), frame["seq"]
        finally:
            if out is not None:
                self.close(out, now)
        return Written(TaskContext.get().partitionId(), done)

    @staticmethod
    def close(out, now: dict) -> None:
        out.write(json.dumps({"kind": "rotate", "through_seq": now["through"]}).encode() + b"\n")
        out.close()

    def publish(self, messages: list, batch: int | None = None) -> None:
        """Add segments in their order. A streaming batch that was added before is not added again."""
        held = manifest(self.path)
        if batch is not None and batch <= held["batch"]:
            self.abort(messages)
            return
        new = [s for m in sorted((m for m in messages if m is not None), key=lambda m: m.place) for s in m.segments]
        through = held["through"]
        for s in new:
            if s["first"] != through + 1:
                raise ValueError(f"frames from {s['first']} on do not follow {through} without a gap")
            through = s["through"]
        numbered = [s | {"number": held["next"] + n} for n, s in enumerate(new)]
        kept = self.reclaim(held["segments"])
        store(self.path, MANIFEST, {"segments": kept + numbered, "next": held["next"] + len(new), "through": through, "at": time.time(), "batch": held["batch"] if batch is None else batch})

    def reclaim(self, segments: list) -> list:
        """Segments that stay: those not acknowledged, and of the others the latest up to ``retainbytes``."""
        fs, base = open_fs(self.path)
        done, room, kept = (load(self.path, ACKNOWLEDGED) or {"segment": 0})["segment"], self.retain, []
        for s in reversed(segments):
            room -= s["bytes"] if s["number"] < done else 0
            if s["number"] >= done or room >= 0:
                kept.append(s)
            elif fs.get_file_info(f"{base}/{s['name']}").type != pafs.FileType.NotFound:
                fs.delete_file(f"{base}/{s['name']}")
        return kept[::-1]

    def abort(self, messages: list, batch: int | None = None) -> None:
        fs, base = open_fs(self.path)
        for s in (s for m in messages if m is not None for s in m.segments):
            fs.delete_file(f"{base}/{s['name']}")


class FeedWriter(Segments, DataSourceWriter):
    def commit(self, messages: list) -> None:
        self.publish(messages)


class FeedStreamWriter(Segments, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self.publish(messages, batchId)


class Part(InputPartition):
    def __init__(self, segment: dict):
        super().__init__(segment["number"])
        self.segment = segment


class Lines:
    """What batch and streaming readers share."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema = options["path"].rstrip("/"), schema

    def read(self, partition: Part) -> Iterator[tuple]:
        fs, base = open_fs(self.path)
        info = partition.segment
        last, ended = info["first"] - 1, False
        try:
            f = fs.open_input_stream(f"{base}/{info['name']}")
        except FileNotFoundError as gone:
            raise NeedsRebuild(f"segment {info['number']} is gone") from gone
        with f:
            for line in f.read().splitlines():  # a segment is bounded by its writer
                frame = json.loads(line)
                if frame["kind"] == "rotate":
                    ended = frame["through_seq"] == last == info["through"]
                    break
                if frame["seq"] != last + 1:
                    raise ValueError(f"frame {frame['seq']} does not follow {last}")
                last = frame["seq"]
                yield tuple([(c["volume"], c["usn"]) for c in frame["cursors"]] if k == "cursors" and frame.get(k) is not None else frame.get(k) for k in self.schema.names)
        if not ended:
            raise ValueError(f"segment {info['number']} does not end as its manifest says")


class FeedReader(Lines, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        return [Part(s) for s in manifest(self.path)["segments"]]


class FeedStreamReader(Lines, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"segment": 0}

    def latestOffset(self) -> dict:
        return {"segment": manifest(self.path)["next"]}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        held = {s["number"]: s for s in manifest(self.path)["segments"]}
        wanted = range(start["segment"], end["segment"])
        gone = [n for n in wanted if n not in held]
        if gone:
            raise NeedsRebuild(f"segments {gone[0]} to {gone[-1]} were removed before they were read")
        return [Part(held[n]) for n in wanted]

    def commit(self, end: dict) -> None:
        acknowledge(self.path, end["segment"])


class FeedDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return FRAME

    def reader(self, schema: StructType) -> DataSourceReader:
        return FeedReader(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FeedStreamReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a feed is only appended to")
        return FeedWriter(dict(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return FeedStreamWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedDataSource)


def write_feed(frames: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, retain_bytes: int = 0) -> None:
    """Append frames, dealt over tasks by ranges of ``seq``, which runs on from what the feed holds."""
    register(frames.sparkSession)
    dealt = frames.repartitionByRange("seq").sortWithinPartitions("seq")
    dealt.write.format("feed").options(segmentbytes=segment_bytes, retainbytes=retain_bytes).mode("append").save(path)
