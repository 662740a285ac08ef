"""Token ids in files of independently coded blocks, as a PySpark Python data source.

``write_ids`` takes documents in ascending order of their ids, over partitions that follow one
another, and each task writes a file of blocks. A block holds whole documents: a table of their ids
and lengths, and all their token ids by an adaptive range coder whose model starts anew. CRC-32
sums cover the block and the ids that it must give back. A manifest written on commit names the
files that count, with the number of ids before each stretch of blocks, so that a reader plans a
task for each stretch and knows at which id it starts.

The model predicts an id from the two ids before it (order 2, hashed), from the one before it
(order 1) and from how often ids came so far (order 0). Orders 1 and 2 each name one id and how sure
they are of it. How much weight each order gets in the mixture is itself learned, for every pair of
sureties, from how often such predictions came true. One step of a range coder over the mixture
codes the id. A block's ids are cut into lanes of equal length that move together, one id a step:
arrays hold the state of all lanes, and the model learns from all of them after each step.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from seekstone.llm.packing import _tokenizer
from seekstone.llm.textvec import bound_batches
from seekstone.llm.warc import open_fs
from seekstone.shared import new_folder

SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
MAGIC = b"IDB1"
#: Magic, coded bytes that follow, documents, ids, lanes, words, vocabulary, CRC of the ids.
HEAD = struct.Struct("<4sQIQIIII")
MANIFEST = "_manifest-"
U = np.uint64
#: Bits of the order-0 frequencies' sum, and of the mixture weights' sum.
FREQUENCY_BITS, WEIGHT_BITS = 18, 10
TOTAL_BITS = FREQUENCY_BITS + WEIGHT_BITS
#: Slots of the order-2 table, and the highest surety of a prediction.
CONTEXT_BITS, SURE = 18, 15
#: Order-0 frequencies are worked out anew after steps 1, 2, 4, ... and then every so many.
REFRESH = 64
MOST_LANES, LANE_IDS = 4096, 256
#: Words whose ids a worker keeps.
CACHE_WORDS = 600_000


def read(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return table.take(at, mode="clip")


class Model:
    """Predictions of orders 0 to 2 and their weights; coder and decoder feed it alike.

    Ids and states are 32-bit, which halves what passes through the processor's cache; places in
    tables are of the size that ``take`` wants.
    """

    def __init__(self, vocabulary: int, lanes: int):
        self.vocabulary = vocabulary
        self.counts = np.zeros(vocabulary, np.int64)
        self.second = np.zeros(1 << CONTEXT_BITS, np.int32)  # surety in the low four bits, the id above
        self.first = np.zeros(vocabulary + 1, np.int32)
        # of each pair of sureties, and whether both orders agree: how often it came, and which order was right
        self.seen = np.zeros(2048, np.int64)
        self.before = np.full(lanes, vocabulary, np.intp)
        self.mixed = np.zeros(lanes, np.intp)
        self.slot = self.mixed
        self.steps, self.pending = 0, []
        self.refresh()
        self.weigh()

    def refresh(self) -> None:
        """Order-0 frequencies: every id has one at least, the rest by counts."""
        if self.pending:
            self.counts += np.bincount(np.concatenate(self.pending), minlength=self.vocabulary)
            self.pending = []
        spare, seen = (1 << FREQUENCY_BITS) - self.vocabulary, int(self.counts.sum())
        extra = self.counts * spare // seen if seen else np.zeros(self.vocabulary, np.int64)
        frequency = 1 + extra
        frequency[int(self.counts.argmax())] += spare - int(extra.sum())
        self.below = np.concatenate([[0], np.cumsum(frequency)]).astype(np.int32)
        self.slots = np.repeat(np.arange(self.vocabulary, dtype=np.int32), frequency)
        self.frequency = frequency.astype(np.int32)

    def weigh(self) -> None:
        """Weights of orders 2 (high bits) and 1 by pair of sureties; order 0 always keeps some, and
        where orders 2 and 1 agree order 1 has none."""
        most = (1 << WEIGHT_BITS) - 8
        seen = self.seen.reshape(16, 2, 16, 2, 2)  # surety and success of order 2, of order 1, whether they agree
        came = seen.sum(axis=(1, 3)) + 4
        weights = (most * (seen[:, 1].sum(axis=2) + 2) // came) << 16
        weights[..., 0] |= (most * (seen[:, :, :, 1].sum(axis=1) + 1) // came)[..., 0]
        self.weights = weights.astype(np.int32).ravel()

    def predict(self) -> "Mixture":
        """What orders 2 and 1 predict for each lane, and the weights of the three orders."""
        state2, state1 = read(self.second, self.slot), read(self.first, self.before)
        two, one, sure2, sure1 = state2 >> 4, state1 >> 4, state2 & SURE, state1 & SURE
        pair = (sure2 << 5) + (sure1 << 1) + (two == one)
        weights = read(self.weights, pair.astype(np.intp))
        weight2, weight1 = weights >> 16, weights & 0xFFFF
        return Mixture(self, state2, state1, sure2, sure1, two, one, pair, weight2, weight1, (1 << WEIGHT_BITS) - weight2 - weight1)

    def learn(self, ids: np.ndarray, said: "Mixture") -> None:
        turn2, turn1 = (said.sure2 << 1) + said.hit2, (said.sure1 << 1) + said.hit1
        self.seen += np.bincount((turn2 << 6) + (turn1 << 1) + (said.pair & 1), minlength=2048)
        fresh = (said.ids << 4) + 1
        for table, at, state, turn in ((self.second, self.slot, said.state2, turn2), (self.first, self.before, said.state1, turn1)):
            turn = turn.astype(np.intp)
            state += read(TURNS, turn)
            np.putmask(state, turn == 0, fresh)
            table[at] = state  # of lanes in one place the last one stays
        now = ids * 2654435761 & 0xFFFFFFFF
        self.slot = (now ^ (self.mixed >> 5)) >> (32 - CONTEXT_BITS)
        self.mixed, self.before = now, ids
        self.pending.append(ids)
        self.steps += 1
        if self.steps % REFRESH == 0 or self.steps & (self.steps - 1) == 0:
            self.refresh()
        if self.steps % 4 == 0 or self.steps < 16:
            self.weigh()


#: Change of surety by (surety, whether the prediction came true): up by one, or down to half.
TURNS = np.array([change for sure in range(SURE + 1) for change in (sure // 2 - sure, int(sure < SURE))], np.int32)


@dataclass
class Mixture:
    """One step's predictions: the mixture gives id s ``weight0 * frequency[s]`` of 2**TOTAL_BITS, and
    2**FREQUENCY_BITS times their weights to the ids that orders 2 and 1 name."""

    model: Model
    state2: np.ndarray
    state1: np.ndarray
    sure2: np.ndarray
    sure1: np.ndarray
    two: np.ndarray
    one: np.ndarray
    pair: np.ndarray
    weight2: np.ndarray
    weight1: np.ndarray
    weight0: np.ndarray

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of each id's part of the whole."""
        self.ids = ids.astype(np.int32)
        self.hit2, self.hit1 = self.ids == self.two, self.ids == self.one
        start = self.weight0 * read(self.model.below, ids) + ((self.weight2 * (self.ids > self.two) + self.weight1 * (self.ids > self.one)) << FREQUENCY_BITS)
        size = self.weight0 * read(self.model.frequency, ids) + ((self.weight2 * self.hit2 + self.weight1 * self.hit1) << FREQUENCY_BITS)
        return start.astype(U), size.astype(U)

    def pick(self, value: np.ndarray) -> np.ndarray:
        """The id whose part of the whole holds each value."""
        below = self.model.below
        low, high = np.minimum(self.two, self.one), np.maximum(self.two, self.one)
        at_low, at_high = low.astype(np.intp), high.astype(np.intp)
        own_low = self.weight2.copy()
        np.putmask(own_low, self.two > self.one, self.weight1)
        own_high = (self.weight2 + self.weight1 - own_low) << FREQUENCY_BITS
        own_low <<= FREQUENCY_BITS
        low_end = self.weight0 * read(below, at_low + 1) + own_low
        high_start = self.weight0 * read(below, at_high) + own_low
        high_end = self.weight0 * read(below, at_high + 1) + own_low + own_high
        past_low = value >= low_end
        past_high = value >= high_end
        rest = value - own_low * past_low - own_high * past_high
        out = read(self.model.slots, (rest // self.weight0).astype(np.intp))
        np.putmask(out, (value >= self.weight0 * read(below, at_low)) & ~past_low, low)
        np.putmask(out, (value >= high_start) & ~past_high, high)
        return out.astype(np.intp)


def lanes_of(n: int) -> tuple[int, int]:
    """Number of lanes and their length for a block of n ids."""
    lanes = max(1, min(MOST_LANES, n // LANE_IDS))
    return lanes, -(-n // lanes)


def encode(ids: np.ndarray, vocabulary: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(lanes, words of each lane, all words of 32 bits lane by lane)."""
    lanes, length = lanes_of(len(ids))
    padded = np.zeros(lanes * length, np.int64)
    padded[: len(ids)] = ids
    steps = np.ascontiguousarray(padded.reshape(lanes, length).T)
    model = Model(vocabulary, lanes)
    low, span = np.zeros(lanes, U), np.full(lanes, (1 << 64) - 1, U)
    words, owners = np.empty(1024 + 2 * lanes, U), np.empty(1024 + 2 * lanes, np.uint16)
    n, last = 0, np.zeros(lanes, np.int64)
    for symbols in steps:
        said = model.predict()
        start, size = said.interval(symbols)
        part = span >> U(TOTAL_BITS)
        moved = low + part * start
        carried = np.flatnonzero(moved < low)
        if len(carried):
            words[last[carried]] += U(1)
        low, span = moved, part * size
        if len(out := np.flatnonzero(span < U(1 << 32))):  # one word always makes it wide enough
            if n + len(out) > len(words):
                words, owners = (np.concatenate([x, np.empty_like(x)]) for x in (words, owners))
            words[n : n + len(out)], owners[n : n + len(out)] = low[out] >> U(32), out
            last[out] = np.arange(n, n + len(out))
            n += len(out)
            low[out] <<= U(32)
            span[out] <<= U(32)
        model.learn(symbols, said)
    # a last word for each lane: the first multiple of 2**32 in what is left of its interval
    end = low + U((1 << 32) - 1)
    carried = np.flatnonzero(end < low)
    words[last[carried]] += U(1)
    words, owners = np.concatenate([words[:n], end >> U(32)]), np.concatenate([owners[:n], np.arange(lanes, dtype=np.uint16)])
    order = np.argsort(owners, kind="stable")
    words = words[order]
    while len(over := np.flatnonzero(words >> U(32))):  # a lane's first word never carries
        words[over] &= U((1 << 32) - 1)
        words[over - 1] += U(1)
    return lanes, np.bincount(owners, minlength=lanes).astype("<u4"), words.astype("<u4")


def decode(n: int, vocabulary: int, lanes: int, sizes: np.ndarray, words: np.ndarray) -> np.ndarray:
    length = -(-n // lanes)
    ends = np.cumsum(sizes, dtype=np.int64)
    words = np.concatenate([words, np.zeros(2, words.dtype)]).astype(U)
    at = ends - sizes

    def fetch(which: np.ndarray) -> np.ndarray:
        """The next word of some lanes; zeros behind a lane's end."""
        got = np.where(at[which] < ends[which], words[np.minimum(at[which], len(words) - 1)], U(0))
        at[which] += 1
        return got

    every = np.arange(lanes)
    code = fetch(every) << U(32)
    code |= fetch(every)
    model, span = Model(vocabulary, lanes), np.full(lanes, (1 << 64) - 1, U)
    steps = np.empty((length, lanes), np.uint32)
    for t in range(length):
        said = model.predict()
        part = span >> U(TOTAL_BITS)
        symbols = said.pick((code // part).astype(np.int32))
        start, size = said.interval(symbols)
        code -= part * start
        span = part * size
        if len(low := np.flatnonzero(span < U(1 << 32))):
            span[low] <<= U(32)
            code[low] = (code[low] << U(32)) | fetch(low)
        steps[t] = symbols
        model.learn(symbols, said)
    return np.ascontiguousarray(steps.T).ravel()[:n]


def encode_block(doc_ids: list, lengths: list[int], ids: np.ndarray, vocabulary: int) -> bytes:
    """A block of whole documents; a document's id may be null."""
    docs = json.dumps([doc_ids, lengths], separators=(",", ":")).encode()
    table = zlib.compress(docs, 1)
    lanes, sizes, words = encode(ids, vocabulary) if len(ids) else (0, np.zeros(0, "<u4"), np.zeros(0, "<u4"))
    body = struct.pack("<I", len(table)) + table + zlib.compress(sizes.tobytes(), 1) + words.tobytes()
    head = HEAD.pack(MAGIC, len(body), len(doc_ids), len(ids), lanes, len(words), vocabulary, zlib.crc32(ids.astype("<u4").tobytes()))
    return head + body + struct.pack("<I", zlib.crc32(body, zlib.crc32(head)))


def decode_block(head: bytes, body: bytes, crc: bytes) -> tuple[list, list[int], np.ndarray]:
    """Ids and lengths of a block's documents and their token ids; damage is an error."""
    magic, _, n_docs, n, lanes, n_words, vocabulary, ids_crc = HEAD.unpack(head)
    if magic != MAGIC or struct.unpack("<I", crc)[0] != zlib.crc32(body, zlib.crc32(head)):
        raise ValueError("a block of token ids is damaged")
    size = struct.unpack_from("<I", body)[0]
    doc_ids, lengths = json.loads(zlib.decompress(body[4 : 4 + size]))
    ids = np.zeros(0, np.uint32)
    if n:
        end = len(body) - 4 * n_words
        sizes = np.frombuffer(zlib.decompress(body[4 + size : end]), "<u4").astype(np.int64)
        ids = decode(n, vocabulary, lanes, sizes, np.frombuffer(body, "<u4", n_words, end))
    if len(doc_ids) != n_docs or sum(lengths) != n or zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("a block of token ids does not give back what was written")
    return doc_ids, lengths, ids


@dataclass
class Written(WriterCommitMessage):
    files: list = field(default_factory=list)


class IdWriter(DataSourceArrowWriter):
    """Each task writes one file under a name that no other attempt uses; rows are ``doc_id, ids``, or with
    a tokenizer ``doc_id, text``: texts then need no worker of their own before the writer's."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.vocabulary = int(options["vocabulary"])
        self.block_ids = int(options.get("blockids", 1 << 20))
        self.stretch = int(options.get("stretchids", 4 << 20))
        self.tokenizer, self.end = options.get("tokenizer"), struct.pack("<I", int(options.get("endid", 2)))
        if overwrite:
            raise ValueError("files of token ids are only appended to")
        if not 0 < self.vocabulary <= 1 << (FREQUENCY_BITS - 1):
            raise ValueError(f"a vocabulary has at most {1 << (FREQUENCY_BITS - 1)} ids")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        place, out, name, size, total, marks = TaskContext.get().partitionId(), None, f"{uuid.uuid4().hex}.ids", 0, 0, []
        keys: list = []
        texts: list[bytes] = []
        waiting = 0
        fs, base = open_fs(self.path)
        known = _tokenizer(self.tokenizer, CACHE_WORDS) if self.tokenizer else None
        try:
            for key, value in (x for b in iterator for x in zip(b["doc_id"].to_pylist(), b["text" if known else "ids"])):
                keys.append(key)
                texts.append(known.ids(value.as_py() or "") + self.end if known else value.as_py() or b"")
                waiting += len(texts[-1]) // 4
                if waiting >= self.block_ids:
                    out = out or self.open(fs, base, name)
                    size, total, waiting = self.flush(out, keys, texts, size, total, marks), total + waiting, 0
            if keys:
                out = out or self.open(fs, base, name)
                size, total = self.flush(out, keys, texts, size, total, marks), total + waiting
        finally:
            if out is not None:
                out.close()
        return Written([{"place": place, "name": name, "size": size, "ids": total, "marks": marks}] if out is not None else [])

    def open(self, fs: pafs.FileSystem, base: str, name: str):
        fs.create_dir(base, recursive=True)
        return fs.open_output_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20)

    def flush(self, out, keys: list, texts: list[bytes], size: int, before: int, marks: list) -> int:
        """Write the documents that wait as a block; the file's size after it."""
        if not marks or before - marks[-1][1] >= self.stretch:
            marks.append([size, before])
        ids = np.frombuffer(b"".join(texts), "<u4")
        if len(ids) and int(ids.max()) >= self.vocabulary:
            raise ValueError(f"id {int(ids.max())} is not in a vocabulary of {self.vocabulary}")
        block = encode_block(keys, [len(t) // 4 for t in texts], ids, self.vocabulary)
        out.write(block)
        keys.clear()
        texts.clear()
        return size + len(block)

    def commit(self, messages: list) -> None:
        fs, base = open_fs(self.path)
        fs.create_dir(base, recursive=True)
        files = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: f["place"])
        with fs.open_output_stream(f"{base}/{MANIFEST}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list) -> None:
        fs, base = open_fs(self.path)
        for f in (f for m in messages if m is not None for f in m.files):
            fs.delete_file(f"{base}/{f['name']}")


class Stretch(InputPartition):
    """Bytes ``start`` to ``end`` of a file, whole blocks, and how many ids stand before them."""

    def __init__(self, name: str, start: int, end: int, ids: int):
        super().__init__((name, start, end, ids))
        self.name, self.start, self.end, self.ids = name, start, end, ids


class IdReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def partitions(self) -> Sequence[InputPartition]:
        fs, base = open_fs(self.path)
        manifests = [i for i in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if i.base_name.startswith(MANIFEST)]
        out, before = [], 0
        for info in sorted(manifests, key=lambda i: (i.mtime_ns, i.base_name)):
            with fs.open_input_stream(info.path) as f:
                for x in json.loads(f.read()):
                    ends = [m[0] for m in x["marks"][1:]] + [x["size"]]
                    out += [Stretch(x["name"], m[0], end, before + m[1]) for m, end in zip(x["marks"], ends)]
                    before += x["ids"]
        return out or [Stretch("", 0, 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.end:
            return
        fs, base = open_fs(self.path)
        with fs.open_input_file(f"{base}/{partition.name}") as f:
            f.seek(partition.start)
            at, before = partition.start, partition.ids
            while at < partition.end:
                head = f.read(HEAD.size)
                body = f.read(HEAD.unpack(head)[1])
                doc_ids, lengths, ids = decode_block(head, body, f.read(4))
                at += len(head) + len(body) + 4
                size = np.array(lengths, np.int64)
                ends = np.cumsum(size)
                cut = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int64)), pa.py_buffer(ids.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(before + ends - size), pa.array(size), cut.cast(pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                before += int(ends[-1]) if len(ends) else 0


class IdDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return IdReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return IdWriter(dict(self.options), overwrite)


def in_order(documents: DataFrame) -> DataFrame:
    """``(doc_id, text)`` by ascending id (null ids first) over partitions that follow one another.

    Rows that share an id follow by a hash of their texts, and are dealt over partitions like any
    others, also where they are equal.
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = rows.withColumns({"_h": F.xxhash64("text"), "_n": F.monotonically_increasing_id()})
    return keys.repartitionByRange("doc_id", "_h", "_n").sortWithinPartitions("doc_id", "_h", "_n").select("doc_id", "text")


def write_ids(rows: DataFrame, path: str, vocabulary: int, block_ids: int = 1 << 20, **options: str) -> None:
    """Write ``(doc_id, ids)`` in the order in which they stand."""
    rows.sparkSession.dataSource.register(IdDataSource)
    rows.write.format("token_ids").options(vocabulary=vocabulary, blockids=block_ids, **options).mode("append").save(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)``: ``start`` counts the ids of all documents before."""
    spark.dataSource.register(IdDataSource)
    return spark.read.format("token_ids").load(path)


def vocabulary_of(tokenizer_path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path).get_vocab_size()


def write_documents(documents: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = 2, block_ids: int = 1 << 20) -> DataFrame:
    """Tokenize ``documents(doc_id, text)``, write them as files of token ids and return those, read back.

    Null texts are empty and give the end's id alone; null ids come first; rows that repeat an id or a
    whole row are documents of their own; an empty table gives no rows; other columns are ignored. A
    document of any length is one document of one block.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    path = path or new_folder(spark, "ids")
    write_ids(in_order(documents), path, vocabulary_of(tokenizer_path), block_ids, tokenizer=tokenizer_path, endid=str(end_id))
    return read_ids(spark, path)


def digests(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
