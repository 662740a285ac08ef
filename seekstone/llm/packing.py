"""Best-fit packing of tokenized documents into sequences under several capacities.

Every document becomes pieces of at most ``max_tokens`` tokens. Pieces are packed into sequences
(bins) whose capacities form a vector: tokens, documents and attention cost (the sum of squared
piece lengths). A piece's demand vector follows from its length alone, so packing works on the
histogram of lengths: at most ``max_tokens`` counts, whatever the input's size. Vector best-fit runs
over that histogram on the driver, moving many equal pieces at a time; tasks then give each piece
its place from its rank among the pieces of its length.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from seekstone.llm.textvec import bound_batches
from seekstone.shared import stage

END_ID = 1
#: Words whose characters all lie in these ranges take the fast path of the tokenizer.
PLAIN_WORD = r"[!-~\u00a1-\u024f]+"
#: The last letter of these ranges, and signs that often follow a word.
LAST_LETTER, SIGNS = "\u024f", ",.!?;:*%&#$"
#: The tokenizer file's own pattern of pieces inside a word (fixed values).
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordTokenizer:
    """Ids of a text by a word-level BPE file of ``tokenizers``, with a bounded cache of words.

    The file's normaliser and splitter never look across white space, so a text's ids are those of
    its words, one after another. A word of plain Latin letters, digits and signs is merged by
    ``tiktoken`` over the same ranks, with byte 255 as mark of the word's end; any other word goes
    to ``tokenizers`` itself.
    """

    def __init__(self, path: str, cache_words: int = 60_000):
        import json
        import unicodedata

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        raw = {c: b for b, c in enumerate(_byte_symbols())}
        ranks = {}
        for token, i in vocab.items():
            body, end = (token[:-4], b"\xff") if token.endswith("</w>") else (token, b"")
            if body and all(c in raw for c in body):
                ranks[bytes(raw[c] for c in body) + end] = i
        ranks[b"\xff"] = max(vocab.values()) + 1
        self.bpe = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.plain = regex.compile(PLAIN_WORD).fullmatch
        self.pieces = regex.compile(WORD_PIECES).findall
        self.separators = regex.compile(r"[\x1c-\x1f]").search
        self.normal = unicodedata.normalize
        self.limit, self.part_limit = cache_words, min(cache_words, 100_000)
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            ids = array("I", self.bpe.encode_single_piece(part.encode() + b"\xff")).tobytes()
            if len(self.parts) >= self.part_limit:
                self.parts.clear()
            self.parts[part] = ids
        return ids

    def word(self, word: str) -> bytes:
        low = word.lower()
        body = low.rstrip(SIGNS)
        if body.isalpha() and (body.isascii() or max(body) <= LAST_LETTER):  # one run of letters, and one of signs
            if len(body) < len(low):
                return (self.words.get(body) or self.part(body)) + self.part(low[len(body):])
            return array("I", self.bpe.encode_single_piece(body.encode() + b"\xff")).tobytes()  # kept by words, so not by parts
        if not self.plain(word) or "<|" in word:
            return array("I", self.slow.encode(word, add_special_tokens=False).ids).tobytes()
        return b"".join([self.part(x) for x in self.pieces(self.normal("NFC", word).lower())])

    def ids(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        known = self.words
        if self.separators(text):  # white space to Python, not to the file's splitter
            return array("I", self.slow.encode(text, add_special_tokens=False).ids).tobytes()
        if "<|" not in text and "\u03a3" not in text:
            text = text.lower()  # else special strings could appear, or a final sigma
        words = text.split()
        out = list(map(known.get, words))
        if None in out:
            for i, w in enumerate(words):
                if out[i] is None:
                    ids = known.get(w)
                    if ids is None:
                        if len(known) >= self.limit:
                            known.clear()
                        ids = known[w] = self.word(w)
                    out[i] = ids
        return b"".join(out)


def _byte_symbols() -> list[str]:
    """The printable character that byte-level BPE files use for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    more = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(more)) for b in range(256)]


@lru_cache(maxsize=2)
def _tokenizer(path: str, cache_words: int = 60_000) -> WordTokenizer:
    return WordTokenizer(path, cache_words)


def tokenize_pieces(documents: DataFrame, tokenizer_path: str, max_tokens: int = 4096, id_column: str = "doc_id") -> DataFrame:
    """``(doc_id, piece, start, length, ids)``: each document's ids, END_ID last, cut when too long."""
    schema = f"{id_column} bigint, piece int, start bigint, length bigint, ids binary"
    out_schema = pa.schema([(id_column, pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                ids = tokenizer.ids(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                    piece = ids[at : at + 4 * max_tokens]
                    for column, x in zip(rows, (doc, k, at // 4, len(piece) // 4, piece)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(rows, out_schema)], schema=out_schema)

    return documents.select(F.col(id_column).cast("bigint").alias(id_column), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def ids_digest(pieces: DataFrame) -> DataFrame:
    """``ids`` replaced by ``ids_crc32``, so that packing moves no token ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@dataclass(frozen=True)
class Capacities:
    """What a sequence holds at most, and how much each dimension counts in the choice of a bin.

    All three weigh in the choice of a bin. The defaults of ``documents`` and ``attention`` bind only
    where a caller lowers them: a sequence of n tokens holds at most n documents, and the squares of
    its parts sum to n squared at most.
    """

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.5, 0.5)
    rule: str = "norm"  # or "dot"

    def demand(self, length: int) -> np.ndarray:
        return np.asarray([length, 1, length * length], dtype=np.int64)

    def vector(self) -> np.ndarray:
        return np.asarray([self.tokens, self.documents, self.attention], dtype=np.int64)


def best_fit(histogram: dict[int, int], caps: Capacities = Capacities()) -> list[tuple[int, list[int]]]:
    """Vector best-fit, decreasing, over a histogram {length: count}.

    Returns bins as ``(count, lengths)``: so many sequences holding pieces of these lengths in this
    order. Equal bins are kept together and split only when pieces run out. Among the bins that a
    piece fits under every capacity, ``rule`` "norm" takes the one with the smallest weighted norm of
    what would remain, "dot" the one with the largest weighted dot product of its residual and the
    demand; ties go to the bins made first. A piece that no sequence can hold is an error.
    """
    total = caps.vector().astype(float)
    weight = np.asarray(caps.weights)
    rest = np.empty((1024, 3), dtype=np.int64)
    counts: list[int] = []
    items: list[list[int]] = []
    live = np.empty(1024, dtype=np.int64)
    n_live = 0
    smallest = min(histogram, default=0)

    def put(residual: np.ndarray, count: int, lengths: list[int]) -> None:
        nonlocal rest, live, n_live
        counts.append(count)
        items.append(lengths)
        if (residual < caps.demand(smallest)).any():
            return  # closed: nothing fits any more
        if n_live == len(rest):
            rest, live = np.concatenate([rest, np.empty_like(rest)]), np.concatenate([live, np.empty_like(live)])
        rest[n_live], live[n_live] = residual, len(counts) - 1
        n_live += 1

    for length in sorted(histogram, reverse=True):
        left, need = histogram[length], caps.demand(length)
        if (need > caps.vector()).any():
            raise ValueError(f"a piece of {length} tokens exceeds a sequence")
        while left:
            fits = np.flatnonzero((rest[:n_live] >= need).all(axis=1))
            if len(fits):
                if caps.rule == "dot":
                    score = -((rest[fits] / total) * (need / total) * weight).sum(axis=1)
                else:
                    score = ((((rest[fits] - need) / total) ** 2) * weight).sum(axis=1)
                at = int(fits[score.argmin()])
                bin_id, residual = int(live[at]), rest[at] - need
                moved = min(left, counts[bin_id])
                lengths = [*items[bin_id], length]
                if moved == counts[bin_id]:
                    n_live -= 1
                    rest[at : n_live], live[at : n_live] = rest[at + 1 : n_live + 1].copy(), live[at + 1 : n_live + 1].copy()
                    counts[bin_id] = 0
                else:
                    counts[bin_id] -= moved
                put(residual, moved, lengths)
                left -= moved
            else:
                # as many equal pieces to a new bin as best-fit would put there one after another
                each = int(min((caps.vector() // np.maximum(need, 1)).min(), left))
                full, over = divmod(left, each)
                put(caps.vector() - need * each, full, [length] * each)
                if over:
                    put(caps.vector() - need * over, 1, [length] * over)
                left = 0
    return [(c, x) for c, x in zip(counts, items) if c]


def plan_places(bins: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: arrays of (first rank, first sequence, offset), sorted by first rank."""
    places: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for count, lengths in bins:
        offset = 0
        for length in lengths:
            first = used.get(length, 0)
            places.setdefault(length, []).append((first, sequence, offset))
            used[length] = first + count
            offset += length
        sequence += count
    return {k: tuple(np.asarray(x, dtype=np.int64) for x in zip(*v)) for k, v in places.items()}


def rank_in_length(pieces: DataFrame, id_column: str, rows_per_group: int = 200_000) -> DataFrame:
    """``pieces`` with ``rank``: 0, 1, ... among the pieces of the same length, in parallel.

    A length may hold a third of all rows, so each length is dealt over groups by a hash; ranks run
    inside the groups, and each group starts where the sums of those before it end.
    """
    total = pieces.count()
    groups = max(1, -(-total // rows_per_group)) * 4
    dealt = pieces.withColumn("_g", F.pmod(F.xxhash64(id_column, "piece", "start", "ids_crc32"), F.lit(groups)).cast("int"))
    sizes = stage(dealt.groupBy("length", "_g").count(), "sizes")
    before = Window.partitionBy("length").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_g", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("length", "_g").orderBy(id_column, "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("_r", F.row_number().over(inside) - 1)
    return ranked.join(sizes, ["length", "_g"]).withColumn("rank", F.col("_r") + F.col("_from")).drop("_g", "_r", "_from")


def pack(pieces: DataFrame, caps: Capacities = Capacities(), id_column: str = "doc_id") -> DataFrame:
    """``pieces(doc_id, piece, start, length, ids_crc32)`` with ``sequence_id`` and ``offset``.

    Offsets of a sequence run from 0 without gaps. Pieces are packed whatever their ids: rows that
    repeat are packed as often as they come, null ids too. No rows give no rows. The only thing that
    reaches the driver is the histogram, at most ``caps.tokens`` rows.
    """
    pieces = stage(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = plan_places(best_fit(histogram, caps))
    schema = f"{id_column} bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch[k].to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for value in np.unique(length):
                rows = np.flatnonzero(length == value)
                first, to, at = places[int(value)]
                k = np.searchsorted(first, rank[rows], side="right") - 1
                sequence[rows], offset[rows] = to[k] + rank[rows] - first[k], at[k]
            yield pa.RecordBatch.from_arrays(
                [batch[id_column], batch["piece"], batch["start"], batch["length"], batch["ids_crc32"], pa.array(sequence), pa.array(offset)],
                names=[id_column, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return rank_in_length(pieces, id_column).select(id_column, "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, schema)


def pack_documents(documents: DataFrame, tokenizer_path: str, caps: Capacities = Capacities(), id_column: str = "doc_id") -> DataFrame:
    """Tokenize, cut and pack ``documents(doc_id, text)``; a null text is an empty document.

    An empty document is one piece holding END_ID. Other columns are ignored.
    """
    bound_batches(documents.sparkSession)
    return pack(ids_digest(tokenize_pieces(documents, tokenizer_path, caps.tokens, id_column)), caps, id_column)
