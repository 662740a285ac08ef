"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel of two strings sums, over all subsequences of ``ORDER`` characters that they share, the
decay to the power of the stretches that the occurrences span (Lodhi et al., "Text Classification
using String Kernels", 2002), so an insult still scores when characters are inserted or left out.
The machine judges *units*: words without signs, single letters in a row joined to one word. Kernel
values with a few landmarks, whitened by their own kernel matrix (Nyström), are the features of a
linear machine; a text's score is the calibrated value of its highest unit.

Only training reads labels: word counts come from the labelled texts of a bounded sample, and the
machine learns to tell the words that come in toxic texts alone from the words of clean ones.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seekstone.llm.textvec import Words, bound_batches, chunks, mix
from seekstone.shared import stage

ORDER = 4
DECAY = 0.6
#: A unit of more bytes is judged in overlapping stretches of so many.
LONGEST = 24
KNOWN_WORDS = 400_000

KEEP = np.zeros(256, dtype=bool)
KEEP[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), *range(128, 256)]] = True
SIGNS = bytes(b for b in range(256) if not KEEP[b])


@dataclass(frozen=True)
class Training:
    """Bounds of the labelled sample (texts of each label) and of what the machine keeps."""

    toxic_texts: int = 3000
    clean_texts: int = 6000
    candidates: int = 600
    clean_words: int = 4000
    landmarks: int = 48
    least_texts: int = 2
    near: float = 0.4
    purity: float = 0.8
    chance: float = 0.05


def encode(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Units as rows of bytes behind a start mark, filled up with zeros, and their lengths."""
    lengths = np.fromiter(map(len, units), np.int64, len(units)) + 1
    rows = np.zeros((len(units), int(lengths.max(initial=1))), np.uint8)
    rows[:, 0] = ord("^")
    step = np.arange(lengths.sum() - len(units)) - np.repeat(np.cumsum(lengths - 1) - lengths + 1, lengths - 1)
    rows[np.repeat(np.arange(len(units)), lengths - 1), step + 1] = np.frombuffer(b"".join(units), np.uint8)
    return rows, lengths


def kernel(a: np.ndarray, b: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Subsequence kernel of each row of ``a`` with each row of ``b`` (zero bytes are no characters).

    The usual recursion over both strings, for all pairs at once: for each length the values of all
    prefix pairs, character by character.
    """
    n, m, p, q = len(a), len(b), a.shape[1], b.shape[1]
    same = [[((a[:, i, None] == b[None, :, j]) & (a[:, i, None] != 0)).astype(np.float32) for j in range(q)] for i in range(p)]
    one = np.float32(1)
    before = None  # K'_{i-1}[i][j], all ones for the empty subsequence
    total = np.zeros((n, m), np.float32)
    d, d2 = np.float32(decay), np.float32(decay * decay)
    for length in range(1, order + 1):
        last = length == order
        if last:
            for i in range(length - 1, p):
                for j in range(length - 1, q):
                    prior = one if before is None else before[i][j]
                    if prior is not None:
                        total += d2 * same[i][j] * prior
            break
        now: list[list] = [[None] * (q + 1) for _ in range(p + 1)]
        for i in range(length, p + 1):
            along = None  # K''
            for j in range(length, q + 1):
                prior = one if before is None else before[i - 1][j - 1]
                hit = d2 * same[i - 1][j - 1] * prior if prior is not None else None
                along = hit if along is None else (d * along if hit is None else d * along + hit)
                up = now[i - 1][j]
                now[i][j] = along if up is None else (d * up if along is None else d * up + along)
        before = now
    return total


def self_kernel(a: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), np.float32)
    block = max(64, 200_000 // a.shape[1] ** 2)  # so small that the tables stay in the cache
    for at in range(0, len(a), block):
        out[at : at + block] = _paired(a[at : at + block], a[at : at + block])
    return out


def _paired(a: np.ndarray, b: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Kernel of row k of ``a`` with row k of ``b``."""
    x, y, d = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), np.float32(decay)
    match = ((x[:, None] == y[None]) & (x[:, None] != 0)).astype(np.float32) * (d * d)
    prior = np.ones_like(match)
    for _ in range(1, order):
        now = match * prior
        for j in range(1, now.shape[1]):
            now[:, j] += d * now[:, j - 1]
        for i in range(1, now.shape[0]):
            now[i] += d * now[i - 1]
        prior = np.zeros_like(match)
        prior[1:, 1:] = now[:-1, :-1]
    return (match * prior).sum(axis=(0, 1))


def by_length(units: list[bytes], block: int, step: int = 3) -> Iterator[np.ndarray]:
    """Indices of units of about the same length, in blocks."""
    sizes = np.asarray([len(u) for u in units])
    for size in range(0, LONGEST + 1, step):
        rows = np.flatnonzero((sizes >= size) & (sizes < size + step))
        for at in range(0, len(rows), block):
            yield rows[at : at + block]


def normalized(units: list[bytes], others: list[bytes]) -> np.ndarray:
    """Kernel divided by the root of both self kernels (0 where one is 0)."""
    out = np.zeros((len(units), len(others)), np.float32)
    their, _ = encode(others)
    own = self_kernel(their)
    groups = {}
    for k, o in enumerate(others):
        groups.setdefault((len(o) + 2) // 3, []).append(k)
    # blocks so small that the tables of all pairs stay in the cache
    for rows in by_length(units, max(64, 24_000 // max(1, *map(len, groups.values())))):
        mine, _ = encode([units[r] for r in rows])
        self_mine = self_kernel(mine)
        for columns in groups.values():
            cut = their[columns][:, : max(len(others[c]) for c in columns) + 1]
            value = kernel(mine, cut)
            out[np.ix_(rows, columns)] = value / np.sqrt(np.maximum(self_mine[:, None] * own[None, columns], 1e-12))
    return out


class Trie:
    """The subsequences of all landmarks with the sum of what each adds to a unit's value.

    A unit's value is linear in its own subsequences, so one walk over them replaces a kernel table
    for each landmark, and a walk ends where no landmark goes on.
    """

    def __init__(self, landmarks: list[bytes], weights: np.ndarray):
        sums: dict[bytes, float] = {}
        for mark, scale in zip(landmarks, weights / np.sqrt(np.maximum(self_kernel(encode(landmarks)[0]), 1e-12))):
            mark = b"^" + mark
            for at in combinations(range(len(mark)), ORDER):
                held = bytes(mark[i] for i in at)
                sums[held] = sums.get(held, 0.0) + scale * DECAY ** (at[-1] - at[0] + 1)
        letters = sorted(set(b"".join(sums)))
        self.letter = np.zeros(256, np.int32)
        self.letter[letters] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        #: By length, the number of a prefix that goes on by a letter; 0 where no landmark has it.
        self.steps: list[np.ndarray] = []
        known = {b"": 0}
        for length in range(1, ORDER):
            longer = {held: k + 1 for k, held in enumerate(sorted({held[:length] for held in sums}))}
            step = np.zeros((len(known) + 1) * self.width, np.int32)
            for held, k in longer.items():
                step[known[held[:-1]] * self.width + self.letter[held[-1]]] = k
            self.steps.append(step)
            known = longer
        self.last = np.zeros((len(known) + 1) * self.width, np.float32)
        for held, value in sums.items():
            self.last[known[held[:-1]] * self.width + self.letter[held[-1]]] = value

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """For each encoded unit the weighted sum of its kernel values with all landmarks, still to be
        divided by the root of its self kernel."""
        total = np.zeros(len(rows), np.float64)
        at = np.ascontiguousarray(self.letter[rows].T)
        decay = (DECAY ** np.arange(len(at) + 1)).astype(np.float32)

        def walk(depth: int, first: int, last: int, number: np.ndarray, live: np.ndarray) -> None:
            for place in range(last + 1, len(at) - (ORDER - 1 - depth)):
                now = self.steps[depth][number * self.width + at[place, live]]
                on = np.flatnonzero(now)
                if not len(on):
                    continue
                start, here, those = (first if depth else place), now[on], live[on]
                if depth < ORDER - 2:
                    walk(depth + 1, start, place, here, those)
                else:
                    ends = self.last[here * self.width + at[place + 1 :, those]]
                    total[those] += decay[place + 2 - start : len(at) + 1 - start] @ ends

        walk(0, 0, -1, np.zeros(len(rows), np.int32), np.arange(len(rows)))
        return total


@dataclass
class Machine:
    """Landmarks with the weight of each one's kernel value, and the calibration of text values."""

    landmarks: list[bytes] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: float = -1.0
    slope: float = 1.0
    shift: float = 0.0
    lowest: float = -3.0
    name: str = field(default_factory=lambda: uuid.uuid4().hex)
    trie: Trie | None = None  # made where the machine is first used

    def values(self, units: list[bytes]) -> np.ndarray:
        """The machine's value of every unit."""
        out = np.full(len(units), self.lowest)
        if not self.landmarks or not units:
            return out
        if self.trie is None:
            self.trie = Trie(self.landmarks, self.weights)
        for at in by_length(units, 4096):
            rows, _ = encode([units[r] for r in at])
            sums = self.trie.sums(rows)
            like = np.flatnonzero(sums)
            sums[like] /= np.sqrt(np.maximum(self_kernel(rows[like]), 1e-12))
            out[at] = np.maximum(sums + self.bias, self.lowest)
        return out

    def score(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -30, 30)))


def unit_strings(words: list[bytes]) -> list[bytes]:
    """What is judged of the given words: signs dropped, long ones in overlapping stretches."""
    out = []
    for w in words:
        w = w.translate(None, SIGNS)
        if len(w) <= LONGEST:
            out.append(w)
        else:
            out += [w[at : at + LONGEST] for at in range(0, len(w) - LONGEST // 2, LONGEST // 2)]
    return out


SINGLE = re.compile(rb"(?<![^ ])[^ \x80-\xff](?: +[^ \x80-\xff]){2,}(?![^ ])")


def spelled_out(raw: bytes) -> list[bytes]:
    """Words spelled with spaces between the letters."""
    return [m.group().replace(b" ", b"") for m in SINGLE.finditer(raw)]


class WordValues:
    """Values of words by hash; computed once for each distinct word, bounded."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0)

    def of(self, hashes: np.ndarray, text_of: callable) -> np.ndarray:
        """Values of distinct hashes; ``text_of`` gives the bytes of the words at given indices."""
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == hashes if len(self.keys) else np.zeros(len(hashes), bool)
        out = np.full(len(hashes), self.machine.lowest)
        out[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = judge(self.machine, text_of(new))
            if len(self.keys) > KNOWN_WORDS:
                self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0)
            keys = np.concatenate([self.keys, hashes[new]])
            order = np.argsort(keys)
            self.keys, self.values = keys[order], np.concatenate([self.values, out[new]])[order]
        return out


_KNOWN: dict[str, WordValues] = {}


def word_values(machine: Machine) -> WordValues:
    """A Python worker's values of words, kept from task to task for one machine."""
    if machine.name not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[machine.name] = WordValues(machine)
    return _KNOWN[machine.name]


def judge(machine: Machine, words: list[bytes]) -> np.ndarray:
    """The highest value of each word's stretches."""
    units, first = [], []
    for w in words:
        first.append(len(units))
        units += unit_strings([w]) or [b""]
    distinct, back = np.unique(np.asarray(units, dtype=object), return_inverse=True)
    values = machine.values(list(distinct))[back]
    return np.maximum.reduceat(values, first) if first else np.zeros(0)


def text_values(machine: Machine, known: WordValues, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The highest value among the units of each text of a chunk."""
    words = Words(raw, offsets)
    n = len(offsets) - 1
    out = np.full(n, machine.lowest)
    if len(words.start):
        distinct, where, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        whole = words.low.tobytes()
        value = known.of(distinct, lambda rows: [whole[words.start[where[r]] : words.end[where[r]]] for r in rows])[back]
        filled = np.flatnonzero(np.diff(words.bounds))
        out[filled] = np.maximum(np.maximum.reduceat(value, words.bounds[filled]), machine.lowest)
        lone = np.flatnonzero(words.end - words.start == 1)
        near = np.unique(words.text_of()[lone[:-2][lone[2:] - lone[:-2] == 2]]) if len(lone) > 2 else []
        for text in near:
            found = spelled_out(whole[offsets[text] : offsets[text + 1]].translate(bytes.maketrans(b"\t\n\v\f\r", b"     ")))
            if found:
                out[text] = max(out[text], judge(known.machine, found).max())
    return out


def distinct_words(documents: DataFrame) -> DataFrame:
    """``(sig, label, word)``: each text's distinct cleaned words. Texts that share their smallest
    word-pair hash, as copies do, have the same ``sig``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, labels, found = [], [], []
            for first, _, raw, offsets in chunks(batch.column(1)):
                words = Words(raw, offsets)
                hashes, strings = words.hashes(), words.strings()
                pairs = mix(hashes[:-1] * np.uint64(3) + hashes[1:]) if len(hashes) > 1 else hashes
                for k, (a, b) in enumerate(zip(words.bounds[:-1], words.bounds[1:])):
                    own = set(unit_strings(strings[a:b]))
                    sig = int(pairs[a : max(a + 1, b - 1)].min(initial=2**64 - 1) >> np.uint64(1)) if b > a else 0
                    found += own
                    sigs += [sig] * len(own)
                    labels += [batch.column(0)[first + k].as_py()] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(labels, pa.int32()), pa.array(found, pa.binary())], names=["sig", "label", "word"])

    return documents.select(F.col("toxic").cast("int"), F.col("text").cast("string")).mapInArrow(run, "sig bigint, label int, word binary")


def labelled_sample(documents: DataFrame, labels: DataFrame, fold: Column, training: Training) -> DataFrame:
    """``(text, toxic)`` of at most so many labelled rows of each label, chosen by a hash of the id."""
    rows = labels.where("toxic in (0, 1) and doc_id is not null").where(fold).select("doc_id", "toxic").distinct()
    both = [rows.where(f"toxic = {t}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for t, n in ((1, training.toxic_texts), (0, training.clean_texts))]
    return documents.select("doc_id", "text").join(F.broadcast(both[0].unionByName(both[1])), "doc_id").select("text", "toxic")


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-2, steps: int = 100) -> np.ndarray:
    """A linear support vector machine (squared hinge) by damped Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        return ridge * w @ w + (cost * np.maximum(1 - y * (x @ w), 0) ** 2).sum()

    now = loss(w)
    for _ in range(steps):
        margin = 1 - y * (x @ w)
        active = margin > 0
        grad = ridge * w - x[active].T @ (cost * y * margin)[active]
        hessian = ridge * np.eye(len(w)) + (x[active] * cost[active, None]).T @ x[active]
        step, size = np.linalg.solve(hessian, grad), 1.0
        while (then := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        w = w - size * step
        if now - then < 1e-9 * max(1.0, now):
            break
        now = then
    return w


def pick_landmarks(units: list[bytes], k: np.ndarray, count: int) -> list[int]:
    """Greedily the unit that the chosen ones resemble least, first the one that most resemble."""
    chosen: list[int] = []
    near = np.zeros(len(units))
    for _ in range(min(count, len(units))):
        at = int(k.sum(axis=1).argmax()) if not chosen else int(near.argmin())
        chosen.append(at)
        near = np.maximum(near, k[at])
        near[chosen] = np.inf
    return chosen


def surprise(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """Chernoff's bound, as a negative logarithm, of so many toxic texts among all by chance."""
    n = np.maximum(toxic + clean, 1e-9)
    rate = np.clip(toxic / n, 1e-12, 1 - 1e-12)
    value = n * (rate * np.log(rate / share) + (1 - rate) * np.log((1 - rate) / (1 - share)))
    return np.where(rate > share, value, 0)


@dataclass
class WordCounts:
    """Of words ``(word, toxic texts, clean texts)``: toxic candidates, the commonest clean ones, some
    of all clean ones by hash; sums over all words."""

    toxic: list[tuple[bytes, int, int]]
    often: list[tuple[bytes, int, int]]
    some: list[tuple[bytes, int, int]]
    t_sum: int
    c_sum: int
    words: int


def count_words(sample: DataFrame, training: Training) -> WordCounts:
    """Word counts of a labelled sample; what reaches the driver is bounded by ``training``."""
    words = stage(distinct_words(sample).distinct().groupBy("word").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")), "words")
    take = lambda df: [(bytes(r["word"]), r["t"], r["c"]) for r in df.collect()]
    toxic = take(words.where(f"t >= {training.least_texts} and t > 9 * c and octet_length(word) > 2").orderBy(F.desc("t"), "c", "word").limit(4 * training.candidates))
    often = take(words.where("c > 0").orderBy(F.desc("c"), "word").limit(training.clean_words // 4))
    some = take(words.where("c > 0").orderBy(F.xxhash64("word"), "word").limit(training.clean_words - len(often)))
    known = {w for w, _, _ in often}
    sums = words.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    return WordCounts(toxic, often, [r for r in some if r[0] not in known], *sums)


def learn(counts: WordCounts, training: Training) -> Machine:
    """The machine from word counts, without its calibration.

    A word counts as toxic if it comes in toxic texts far more often than chance would bring any of the
    words seen, or nearly so and the words that the kernel holds near to it do.
    """
    if not counts.t_sum or not counts.c_sum or not counts.toxic:
        return Machine()
    share = counts.t_sum / (counts.t_sum + counts.c_sum)
    t, c = (np.asarray([r[k] for r in counts.toxic], float) for k in (1, 2))
    ranked = sorted(zip(counts.toxic, surprise(t, c, share)), key=lambda x: (-x[1], x[0][0]))[: training.candidates]
    often, some = len(counts.often), counts.often + counts.some
    positive, negative = [r[0] for r, _ in ranked], [r[0] for r in some]
    among, against = normalized(positive, positive), normalized(positive, negative)
    tox, own = np.asarray([r[1] for r, _ in ranked], float), np.asarray([s for _, s in ranked])
    cl = np.asarray([r[2] for r in some], float)
    # those taken by hash stand for all the rest
    scale = np.r_[np.ones(often), np.full(len(cl) - often, (counts.c_sum - cl[:often].sum()) / max(1.0, cl[often:].sum()))]
    near_toxic, near_clean = np.where(among > training.near, 1, 0) @ tox, np.where(against > training.near, 1, 0) @ (cl * scale)
    family = np.where(near_toxic > training.purity * (near_toxic + near_clean), surprise(near_toxic, near_clean, share), 0)
    least = np.log(counts.words / training.chance)
    keep = np.flatnonzero((own > 3 * least) | ((own > least) & (near_toxic > near_clean)) | ((family > 1.5 * least) & (own > 0.6 * least)))
    if not len(keep):
        keep = np.arange(min(len(positive), 20))
    positive, among = [positive[i] for i in keep], among[np.ix_(keep, keep)]
    near = against[keep].max(axis=0)
    marks = [positive[i] for i in pick_landmarks(positive, among, training.landmarks * 3 // 4)]
    marks += [negative[i] for i in np.argsort(-near, kind="stable")[: training.landmarks - len(marks)]]
    values, vectors = np.linalg.eigh(normalized(marks, marks).astype(float))
    white = vectors / np.sqrt(np.maximum(values, 1e-3))
    x = normalized(positive + negative, marks) @ white
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    weight = np.clip(tox[keep] / tox[keep].mean(), 0.3, 6)
    cost = np.r_[weight * len(negative) / weight.sum(), np.ones(len(negative))]
    w = svm(x, y, cost)
    return Machine(marks, white @ w[:-1], float(w[-1]))


def calibrate(machine: Machine, value: np.ndarray, label: np.ndarray) -> Machine:
    """Platt's logistic fit of labels on text values, with his smoothed targets."""
    if len(value) == 0 or label.min() == label.max():
        machine.shift = float(np.log((label.sum() + 1) / (len(label) - label.sum() + 1))) if len(label) else -2.0
        machine.slope = 1.0
        return machine
    pos, neg = label.sum(), len(label) - label.sum()
    target = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.c_[value, np.ones(len(value))]
    w = np.asarray([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - target) + 1e-2 * w * [1, 0]
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, grad)
        w = w - step * min(1, 2 / np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    machine.slope, machine.shift = max(float(w[0]), 1e-3), float(w[1])
    return machine


def score_texts(documents: DataFrame, machine: Machine, key: str, kind: str = "bigint") -> DataFrame:
    """``(key, value, score)`` of every row of ``documents(key, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_values(machine)
        for batch in batches:
            parts = [text_values(machine, known, raw, offsets) for _, _, raw, offsets in chunks(batch.column(1))]
            value = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value, pa.float64()), pa.array(machine.score(value), pa.float64())], names=[key, "value", "score"])

    return documents.select(key, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{key} {kind}, value double, score double")


def train(documents: DataFrame, labels: DataFrame, fold: Column, training: Training = Training()) -> Machine:
    """A machine learned from labelled rows that ``fold`` admits.

    Rows whose label is null or neither 0 nor 1 are left out. Without rows of both labels all texts
    get the share of label 1 as their score.
    """
    bound_batches(documents.sparkSession)
    sample = labelled_sample(documents, labels, fold, training)
    machine = learn(count_words(sample, training), training)
    rows = score_texts(sample.select(F.col("toxic").cast("long").alias("toxic"), "text"), machine, "toxic").select("toxic", "value").toArrow()
    return calibrate(machine, rows["value"].to_numpy(), rows["toxic"].to_numpy())


def score_documents(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, training: Training = Training()) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``documents``.

    Labels are learned only from rows whose crc32(doc_id as text) mod 3 is not 1. A null or empty
    text scores as a text without toxic units; a null ``doc_id`` is kept and not held out. Rows that
    repeat are scored as often as they come, equal texts alike; other columns, whatever their names, are
    ignored; an empty table of documents gives no rows, without labels all texts score alike.
    """
    part = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 3
    machine = train(documents, labels, part("doc_id") != 1, training)
    scored = score_texts(documents.select("doc_id", "text"), machine, "doc_id")
    return scored.select("doc_id", F.coalesce(part("doc_id") == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, training: Training = Training()) -> DataFrame:
    """The rows of ``documents`` that score below ``threshold``, with all their columns.

    Learns as ``score_documents`` does. Null and empty texts have no toxic units and stay. Each row is
    judged by its own text, rows that repeat alike; columns may have any names; an empty table gives no rows.
    """
    machine = train(documents, labels, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, training)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_values(machine)
        for batch in batches:
            parts = [text_values(machine, known, raw, offsets) for _, _, raw, offsets in chunks(batch.column(at))]
            yield batch.filter(pa.array(machine.score(np.concatenate(parts)) < threshold)) if parts else batch

    return documents.mapInArrow(run, documents.schema)
