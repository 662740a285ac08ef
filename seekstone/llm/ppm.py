"""Language-model scores by prediction by partial matching over bytes (PPM).

A trie of byte contexts, up to ``ORDER`` bytes long, holds what followed them in all training texts.
A symbol is coded in its longest known context; if it was never seen there, an escape (method C:
as likely as the number of distinct symbols seen) leads to the context one byte shorter, where the
symbols of the longer one are excluded. The trie is pretrained and fixed, so that a text's code
length is a sum over its ``ORDER + 1``-grams, each with a code length of its own.

Texts are scored in their canonical form: words in lower case joined by single spaces, closed by an
end symbol, which no word can hold.

The trie is never gathered in one place. Gram counts are dealt by the last three bytes of their
context over a number of buckets that grows with the input, so that all contexts that an escape can
lead to, down to three bytes, lie together; shorter contexts are a table that three bytes bound. Texts
are dealt into blocks of fixed size; a block tells once what grams and words it holds, and gets their
code lengths and counts back. What moves is packed arrays, never a row for each occurrence, and at
most a row for each distinct gram and word of a block. Only a bucket that holds far more than its
share is summed and answered in several groups, each with a copy of the bucket's own list.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seekstone.llm.textvec import Words, bound_batches, chunks
from seekstone.shared import stage

#: Bytes of context. A gram of ORDER + 1 bytes fits 64 bits.
ORDER = 5
END = 0x0A
#: Bytes of text in a block, about.
BLOCK_BYTES = 18 << 20
#: Bytes of a bucket's parts that are summed or answered in one group, about.
BUCKET_BYTES = 64 << 20
#: Tables of large buckets with more rows are joined by a shuffle.
BROADCAST_ROWS = 100_000
SMOOTHING = 0.1
GRAM, WORD = 0, 1
EXTRACT = "kind int, bucket int, salt int, block int, keys binary, counts binary"


def pack(x: np.ndarray) -> bytes:
    """An array by planes of bytes: sorted keys and small counts then compress well."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unpack(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def grams_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """All grams of a chunk's texts, one for each byte and end symbol, and where each text's begin.

    Before a text stand ``ORDER`` end symbols.
    """
    lengths, text, n = words.end - words.start, words.text_of(), np.diff(words.bounds)
    after = np.ones(len(lengths), np.int64)  # a space stands behind each word but a text's last
    after[words.bounds[1:][n > 0] - 1] = 0
    size = np.bincount(text, weights=lengths + after, minlength=len(n)).astype(np.int64) + 1
    start = np.concatenate([[0], np.cumsum(size + ORDER)])
    buffer = np.full(start[-1], END, np.uint8)
    total = np.concatenate([[0], np.cumsum(lengths + after)])
    place = start[text] + ORDER + total[:-1] - total[words.bounds[:-1][text]]
    step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    buffer[np.repeat(place, lengths) + step] = words.low[np.repeat(words.start, lengths) + step]
    buffer[(place + lengths)[after > 0]] = 0x20
    codes = np.zeros(max(0, len(buffer) - ORDER), np.int64)
    for k in range(ORDER + 1):
        codes <<= 8
        codes |= buffer[k : len(buffer) - ORDER + k]
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(first[-1]) + np.repeat(start[:-1] - first[:-1], size)
    return codes[at], first


def add_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def sorted_counts(x: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of all of x, with how often each comes in training texts."""
    known, counts = np.unique(x[trained], return_counts=True) if trained.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if trained.all():
        return known, counts
    other = np.unique(x[~trained])
    return add_up([known, other], [counts, np.zeros(len(other), np.int64)])


def buckets_of(kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    if kind == GRAM:
        return ((keys >> 8 & 0xFFFFFF) * 2654435761 >> 8) % buckets
    return (keys.view(np.uint64) % np.uint64(buckets)).astype(np.int64)


def contents(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, Words]]:
    """Of each chunk of a block's texts: first row, grams, first grams, word hashes, words."""
    at = 0
    for column in table.column("text").chunks:
        for first, _, raw, offsets in chunks(column):
            words = Words(raw, offsets)
            grams, begin = grams_of(words)
            yield at + first, grams, begin, words.hashes().view(np.int64), words
        at += len(column)


def holdings(table: pa.Table, count_all: bool = False) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Distinct grams and words of a block with their counts in training texts, or in all."""
    trained = table.column("train").to_numpy().astype(bool) | count_all
    parts: dict[int, tuple[list, list]] = {GRAM: ([], []), WORD: ([], [])}
    for first, grams, begin, hashes, words in contents(table):
        of = trained[first : first + len(begin) - 1]
        for kind, x, mask in ((GRAM, grams, np.repeat(of, np.diff(begin))), (WORD, hashes, np.repeat(of, np.diff(words.bounds)))):
            keys, counts = sorted_counts(x, mask)
            parts[kind][0].append(keys)
            parts[kind][1].append(counts)
    return {kind: add_up(*p) for kind, p in parts.items()}


def in_buckets(kind: int, keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket in use with the indices of its keys, in order."""
    bucket = buckets_of(kind, keys, buckets)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    for rows in np.split(order, edges) if len(order) else []:
        yield int(bucket[rows[0]]), rows


def rows_out(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


EXTRACT_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("salt", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def level_of(grams: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted grams with their counts, and for each context where its grams begin, their sum and number."""
    contexts, first = np.unique(grams >> 8, return_index=True)
    return {"grams": grams, "n": n, "contexts": contexts, "first": first, "total": np.add.reduceat(n, first) if len(first) else n, "kinds": np.diff(np.append(first, len(grams)))}


def add_under(level: dict[str, np.ndarray], n: np.ndarray) -> dict[str, np.ndarray]:
    """What a context's symbols count for in the next shorter one."""
    return level | {"under": np.add.reduceat(n, level["first"]) if len(level["first"]) else np.zeros(0, np.int64)}


class ShortContexts:
    """Contexts of two bytes, of one and of none, from the counts of all runs of three bytes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.pairs = np.bincount(keys & 0xFFFF, weights=counts, minlength=1 << 16).astype(np.int64).reshape(256, 256)  # [context byte, symbol]
        self.two = add_under(level_of(keys, counts), self.pairs[keys >> 8 & 0xFF, keys & 0xFF])


class Trie:
    """Contexts of three bytes and more of one bucket over the short ones that all share."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, short: ShortContexts):
        self.pairs = short.pairs
        self.levels = {k: level_of(*add_up([keys & ((1 << 8 * (k + 1)) - 1)], [counts])) for k in range(ORDER, 2, -1)} | {2: short.two}
        for k in range(ORDER, 2, -1):
            level, below = self.levels[k], self.levels[k - 1]
            self.levels[k] = add_under(level, below["n"][np.searchsorted(below["grams"], level["grams"] & ((1 << 8 * k) - 1))] if len(level["grams"]) else level["n"])

    def code(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the others."""
        out, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
        gone_total, gone_kinds = np.zeros(len(grams)), np.zeros(len(grams))

        def coded(n: np.ndarray, total: np.ndarray, kinds: np.ndarray, known: np.ndarray) -> None:
            nonlocal open_
            total, kinds = total - gone_total, kinds - gone_kinds
            hit = open_ & known & (n > 0)
            miss = open_ & known & (n == 0) & (kinds > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                out[hit] += np.log10(n[hit] / (total[hit] + kinds[hit]))
                out[miss] += np.log10(kinds[miss] / (total[miss] + kinds[miss]))
            open_ &= ~hit

        for k in range(ORDER, 1, -1):
            level = self.levels[k]
            if not len(level["grams"]):
                continue
            own = grams & ((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(level["contexts"], own >> 8), len(level["contexts"]) - 1)
            known = level["contexts"][at] == own >> 8
            where = np.minimum(np.searchsorted(level["grams"], own), len(level["grams"]) - 1)
            n = np.where(level["grams"][where] == own, level["n"][where], 0)
            coded(n, level["total"][at], level["kinds"][at], known)
            gone_total, gone_kinds = np.where(known, level["under"][at], 0), np.where(known, level["kinds"][at], 0)
        context, symbol = grams >> 8 & 0xFF, grams & 0xFF
        seen = self.pairs > 0
        coded(self.pairs[context, symbol], self.pairs.sum(1)[context], seen.sum(1)[context], seen.any(1)[context])
        single = self.pairs.sum(0)
        gone_total, gone_kinds = (seen * single).sum(1)[context], seen.sum(1)[context]
        coded(single[symbol], np.full(len(grams), single.sum()), np.full(len(grams), (single > 0).sum()), np.full(len(grams), bool(single.any())))
        out[open_] -= np.log10(256 - (single > 0).sum())
        return out


def merged(parts: DataFrame, split: bool) -> DataFrame:
    """``(kind, bucket, keys, counts)``: sums over all blocks, in groups of bounded size."""

    def add(table: pa.Table) -> pa.Table:
        keys, counts = add_up([unpack(x, np.int64) for x in table["keys"].to_pylist()], [unpack(x, np.int64) for x in table["counts"].to_pylist()])
        some = counts > 0  # what only texts hold that are not trained on is asked for, not summed
        kind, bucket = table["kind"][0].as_py(), table["bucket"][0].as_py()
        return rows_out([(kind, bucket, 0, 0, pack(keys[some]), pack(counts[some]))], EXTRACT_ARROW)

    if split:
        parts = parts.groupBy("kind", "bucket", "salt").applyInArrow(add, EXTRACT)
    return parts.groupBy("kind", "bucket").applyInArrow(add, EXTRACT).select("kind", "bucket", "keys", "counts")


def short_contexts(totals: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Runs of three bytes with their counts: at most 2 to the 24th, whatever the input's size."""
    schema = "first int, keys binary, counts binary"
    out_arrow = pa.schema([("first", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def by_first(keys: np.ndarray, counts: np.ndarray) -> pa.Table:
        edges = np.flatnonzero(np.diff(keys >> 16)) + 1
        groups = [r for r in np.split(np.arange(len(keys)), edges) if len(r)]
        return rows_out([(int(keys[r[0]] >> 16), keys[r].tobytes(), counts[r].tobytes()) for r in groups], out_arrow)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for own, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, counts = add_up([keys, unpack(own, np.int64) & 0xFFFFFF], [counts, unpack(n, np.int64)])
        yield from by_first(keys, counts).to_batches()

    def add(table: pa.Table) -> pa.Table:
        return by_first(*add_up(*([np.frombuffer(x, np.int64) for x in table[c].to_pylist()] for c in ("keys", "counts"))))

    parts = totals.where(f"kind = {GRAM}").select("keys", "counts").mapInArrow(count, schema)
    rows = sorted(parts.groupBy("first").applyInArrow(add, schema).collect(), key=lambda r: r["first"])  # 256 rows
    return tuple(np.concatenate([np.frombuffer(r[c], np.int64) for r in rows] or [np.zeros(0, np.int64)]) for c in ("keys", "counts"))


def large_buckets(parts: DataFrame, most: int) -> DataFrame:
    """``(kind, bucket, salts)`` of the buckets whose parts are more than one group should hold."""
    sizes = parts.groupBy("kind", "bucket").agg(F.sum(F.octet_length("keys") + F.octet_length("counts")).alias("size"))
    return stage(sizes.where(F.col("size") > most).select("kind", "bucket", F.ceil(F.col("size") / most).cast("int").alias("salts")), "large-buckets")


_SHORT: dict[str, ShortContexts] = {}


def short_of(shared) -> ShortContexts:
    """A Python worker's tables of the short contexts, made once for each broadcast."""
    if shared.value[0] not in _SHORT:
        _SHORT.clear()
        _SHORT[shared.value[0]] = ShortContexts(*shared.value[1:])
    return _SHORT[shared.value[0]]


def word_totals(totals: DataFrame) -> tuple[int, int]:
    """Words in training texts and distinct ones among them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [unpack(x, np.int64) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(x.sum()) for x in sums], pa.int64()), pa.array([len(x) for x in sums], pa.int64())], names=["n", "v"])

    row = totals.where(f"kind = {WORD}").select("counts").mapInArrow(count, "n bigint, v bigint").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    return row[0], row[1]


def score(documents: DataFrame, folds: int = 10, held_fold: int = 0, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    Rows whose crc32(doc_id as text) mod ``folds`` is ``held_fold`` are held out, all others are
    trained on. ``score`` is log10 of the model's probability of the text's canonical form (words
    in lower case between single spaces) with its end: what white space a text has itself costs nothing; ``base_score`` that of single tokens with added 0.1 (one end a text is a token too). A null
    text is empty; a null ``doc_id`` is kept and trained on; rows that repeat count as often as they
    come. Without training texts all symbols are equally likely. Other columns are ignored, and an
    empty table gives no rows.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_fold, F.lit(False))
    rows = rows.select("doc_id", "text", (~held).alias("train"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum(F.col("train").cast("long")), F.lit(0))).first()
    blocks = max(1, -(-size[0] // block_bytes))
    trained_texts = size[1]
    buckets = 2 * blocks
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 64)), F.lit(blocks)).cast("int"))

    def extract(table: pa.Table) -> pa.Table:
        block, out = table["block"][0].as_py(), []
        for kind, (keys, counts) in holdings(table).items():
            out += [(kind, bucket, 0, block, pack(keys[r]), pack(counts[r])) for bucket, r in in_buckets(kind, keys, buckets)]
        return rows_out(out, EXTRACT_ARROW)

    parts = stage(rows.groupBy("block").applyInArrow(extract, EXTRACT), "parts")
    large = large_buckets(parts, bucket_bytes)
    n_large = large.count()
    many = F.broadcast(large) if n_large <= BROADCAST_ROWS else large
    if n_large:
        parts = parts.join(many, ["kind", "bucket"], "left").withColumn("salt", F.pmod("block", F.coalesce("salts", F.lit(1)))).drop("salts")
    totals = stage(merged(parts, n_large > 0), "totals")
    n_words, distinct = word_totals(totals)
    # the end is one more token, with a count of its own
    n, v = n_words + trained_texts, distinct + (trained_texts > 0)
    short = spark.sparkContext.broadcast((uuid.uuid4().hex, *short_contexts(totals)))

    answer_arrow = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("values", pa.binary())])

    def answer(asked: pa.Table, total: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows:
            kind, bucket = asked["kind"][0].as_py(), asked["bucket"][0].as_py()
            keys, counts = (unpack(total[c][0].as_py(), np.int64) for c in ("keys", "counts")) if total.num_rows else (np.zeros(0, np.int64),) * 2
            trie = Trie(keys, counts, short_of(short)) if kind == GRAM else None
            for block, wanted in zip(asked["block"].to_pylist(), asked["keys"].to_pylist()):
                wanted = unpack(wanted, np.int64)
                if kind == GRAM:
                    values = pack(trie.code(wanted))
                else:
                    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
                    values = pack(np.where(keys[at] == wanted, counts[at], 0) if len(keys) else np.zeros(len(wanted), np.int64))
                out.append((block, kind, bucket, values))
        return rows_out(out, answer_arrow)

    replicas = totals.withColumn("salt", F.lit(0))
    if n_large:
        replicas = totals.join(many, ["kind", "bucket"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    keys = ("kind", "bucket", "salt")
    answers = parts.drop("counts").groupBy(*keys).cogroup(replicas.groupBy(*keys)).applyInArrow(answer, "block int, kind int, bucket int, values binary")

    out_schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    out_arrow = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    below = SMOOTHING / (n + SMOOTHING * (v + 1))

    def apply(table: pa.Table, answered: pa.Table) -> pa.Table:
        if not table.num_rows:
            return rows_out([], out_arrow)
        given: dict[tuple, bytes] = {(k, b): x for k, b, x in zip(*(answered[c].to_pylist() for c in ("kind", "bucket", "values")))}
        known = {}
        for kind, (keys, _) in holdings(table, True).items():
            values = np.zeros(len(keys), np.float64 if kind == GRAM else np.int64)
            for bucket, r in in_buckets(kind, keys, buckets):
                values[r] = unpack(given.pop((kind, bucket)), values.dtype.type)
            known[kind] = (keys, values)
        texts = table.num_rows
        total, base, tokens, found = np.zeros(texts), np.zeros(texts), np.zeros(texts, np.int64), np.zeros(texts, np.int64)
        for first, grams, begin, hashes, words in contents(table):
            here = slice(first, first + len(begin) - 1)
            keys, values = known[GRAM]
            total[here] = np.add.reduceat(values[np.searchsorted(keys, grams)], begin[:-1])
            keys, values = known[WORD]
            count = values[np.searchsorted(keys, hashes)] if len(hashes) else np.zeros(0, np.int64)
            summed = np.concatenate([[0.0], np.cumsum(np.log10((count + SMOOTHING) / (n + SMOOTHING * (v + 1))))])
            hits = np.concatenate([[0], np.cumsum(count > 0)])
            base[here] = summed[words.bounds[1:]] - summed[words.bounds[:-1]]
            tokens[here] = np.diff(words.bounds) + 1
            found[here] = hits[words.bounds[1:]] - hits[words.bounds[:-1]] + (trained_texts > 0)
        base += np.log10(below * (trained_texts + SMOOTHING) / SMOOTHING)
        return pa.Table.from_arrays(
            [table["doc_id"].combine_chunks(), pa.array(~table["train"].to_numpy().astype(bool)), pa.array(tokens), pa.array(found), pa.array(np.full(texts, n, np.int64)), pa.array(base), pa.array(total)], schema=out_arrow
        )

    return rows.select("block", "doc_id", "text", "train").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(apply, out_schema)
