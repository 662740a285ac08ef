"""Sort-means, hard negatives and files of token ids against brute force, edge cases included."""

import hashlib
import math
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

from seekstone.llm import idblocks, negatives, queries, sortmeans

VECTORS = "vec_id long, embedding array<double>, label int, x int, cluster string, distance string, block int"


def table_of(spark, rows):
    return spark.createDataFrame([(i, e, label, 1, "a", "b", 2) for i, e, label in rows], VECTORS)


def lloyd(rows, k, rounds, dims, scale, seed):
    """The contract word by word, in Python's integers."""
    kept = [(i, [math.floor(scale * v) for v in e]) for i, e, _ in rows if e is not None and len(e) == dims and all(v is not None and math.isfinite(v) for v in e)]
    digest = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    centres = [x for _, x in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        centres = [[sum(c) // len(groups[n]) for c in zip(*groups[n])] if n in groups else centre for n, centre in enumerate(centres)]
    return sorted(((i, nearest(x)[1], min(nearest(x)[0], 2**63 - 1)) for i, x in kept), key=repr), centres


@pytest.mark.parametrize(("seed", "size"), [(1, 1.0), (2, 1.0), (3, 1e30)])
def test_sort_means_equals_lloyd(spark, seed, size):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) + 3 * (i % 3) for _ in range(4)], None) for i in range(150)]
    rows += [(200 + i, [0.5, 0.25, -0.5, 0.0], 1) for i in range(60)]  # a common vector
    rows += [(7, [1.0, 1.0, 1.0, 1.0], 1), (7, [1.0, 1.0, 1.0, 1.0], 1), (None, [0.1] * 4, 1)]  # repeated and null ids
    rows += [(300, None, 1), (301, [], 1), (302, [1.0, None, 1.0, 1.0], 1), (303, [1.0, math.nan, 1.0, 1.0], 1), (304, [1.0, math.inf, 1.0, 1.0], 1), (305, [1.0] * 5, 1)]
    rows += [(306, [size, -size, 1.0, 0.0], 1)]
    found, centres = sortmeans.sort_means(table_of(spark, rows), k=5, rounds=4, dims=4, scale=1024, seed=seed)
    want, want_centres = lloyd(rows, 5, 4, 4, 1024, seed)
    assert centres == want_centres
    assert sorted(map(tuple, found.collect()), key=repr) == want
    shown = sortmeans.digests(spark, found, centres).collect()
    for r in shown:
        assert r["cluster_inertia"] == min(2**63 - 1, sum(d for _, c, d in want if c == r["cluster"])) and r["inertia"] == min(2**63 - 1, sum(d for _, _, d in want))
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, want_centres[r["cluster"]])).encode()).hexdigest()


def test_sort_means_of_few_and_of_none(spark):
    few = [(i, [float(i)] * 4, 0) for i in range(3)] + [(9, [0.0] * 4, 0)]
    found, centres = sortmeans.sort_means(table_of(spark, few), k=8, rounds=2, dims=4)
    want, want_centres = lloyd(few, 8, 2, 4, 1024, 3)
    assert len(centres) == 4 and centres == want_centres and sorted(map(tuple, found.collect()), key=repr) == want
    found, centres = sortmeans.sort_means(table_of(spark, [(1, None, 0)]), dims=4)
    assert found.count() == 0 and centres == [] and sortmeans.digests(spark, found, centres).count() == 0


def test_sort_means_looks_at_few_centroids():
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (40, 8))
    home = rng.integers(0, 40, 2000)
    x = centres[home] + rng.integers(-100, 100, (2000, 8))
    found, distance, looked = sortmeans.Centroids(centres.tolist()).nearest(x, home)
    every = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (found == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert looked < 4 * len(x)  # of 40 distances a vector
    start = np.zeros(2000, int)  # a wrong start only costs time
    assert (sortmeans.Centroids(centres.tolist()).nearest(x, start)[0] == found).all()


def mined(rows, anchors, positives, negatives_, scale):
    """The contract word by word; rows as candidates, anchors by id."""
    usable = [(i, y, [math.floor(scale * v) for v in e]) for i, e, y in rows if i is not None and y is not None and e is not None and all(v is not None and math.isfinite(v) for v in e)]
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = set()
    for a in {i for i, _, _ in usable if i in anchors}:
        _, label, x = min((r for r in usable if r[0] == a), key=lambda r: (r[1], r[2]))
        score = [(-clip(sum(p * q for p, q in zip(x, v))), i, y) for i, y, v in usable if i != a]
        for p in sorted(s for s in score if s[2] == label)[:positives]:
            window = sorted(s for s in score if s[2] != label and -80 * p[0] <= -100 * s[0] <= -100 * p[0])[:negatives_]
            out |= {(a, p[1], rank, n[1], -p[0], -n[0]) for rank, n in enumerate(window, 1)}
    return sorted(out)


@pytest.mark.parametrize(("seed", "large"), [(1, 1.0), (2, 3e4), (3, 1e17)])
def test_hard_negatives_equal_brute_force(spark, seed, large):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0.2, 0.3) for _ in range(6)], i % 4) for i in range(240)]
    rows += [(300 + i, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5], i % 2) for i in range(80)]  # a common vector: ties by id
    rows += [(10, [0.4] * 6, 2), (10, [0.3] * 6, 1)]  # an anchor's id again
    rows += [(None, [1.0] * 6, 1), (401, None, 1), (402, [1.0] * 6, None), (403, [1.0, None], 1), (404, [math.nan] * 6, 1), (405, [], 2), (410, [0.5, 0.5], 3)]
    rows += [(500, [large, -large, large, 1.0, 0.0, 0.5], 1), (501, [large, 0.0, 1.0, 1.0, 0.0, 0.5], 2), (502, [large] * 6, 1), (503, [-large] * 6, 0)]
    vectors = table_of(spark, rows)
    want = mined(rows, set(range(0, 1000, 10)), 3, 4, 256)
    assert len(want) > 100
    for block_rows in (2048, 7):
        got = negatives.hard_negatives(vectors, vectors.where("vec_id % 10 = 0"), 3, 4, block_rows=block_rows)
        assert sorted(map(tuple, got.collect())) == want, block_rows
    none = negatives.hard_negatives(vectors.limit(0), vectors)
    assert none.columns == got.columns and none.count() == 0 and negatives.hard_negatives(vectors, vectors.limit(0)).count() == 0


def test_lists_of_the_best_merge_in_any_order():
    rng = np.random.default_rng(3)
    scores, allowed = rng.integers(0, 9, (5, 4000)), rng.random((5, 4000)) < 0.7
    ids = rng.permutation(4000)
    best = negatives.Best(5, 6)
    for part in np.array_split(rng.permutation(4000), 9):
        part = part[np.argsort(ids[part])]
        best.add(scores[:, part], allowed[:, part], ids[part])
    for row in range(5):
        want = sorted((-s, i) for s, i, ok in zip(scores[row], ids, allowed[row]) if ok)[:6]
        assert [(-s, i) for s, i in zip(best.scores[best.lists == row], best.ids[best.lists == row])] == want


@pytest.mark.parametrize("n", [0, 1, 2, 255, 257, 1000, 40_000])
@pytest.mark.parametrize("kind", ["text", "one", "random"])
def test_coder_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"text": rng.zipf(1.3, n) % 49_408, "one": np.full(n, 7), "random": rng.integers(0, 49_408, n)}[kind].astype("<u4")
    block = idblocks.encode_block([1, None], [n, 0], ids, 49_408)
    size = idblocks.HEAD.size
    keys, lengths, back = idblocks.decode_block(block[:size], block[size:-4], block[-4:])
    assert keys == [1, None] and lengths == [n, 0] and (back == ids).all()
    if n == 40_000:
        assert len(block) < {"text": 2.2, "one": 0.2, "random": 2.2}[kind] * n
        for at in (5, size + 2, len(block) // 2, len(block) - 1):
            hurt = bytearray(block)
            hurt[at] ^= 4
            with pytest.raises(ValueError, match="damaged"):
                idblocks.decode_block(bytes(hurt[:size]), bytes(hurt[size:-4]), bytes(hurt[-4:]))


def test_orders_are_mixed():
    """Ids that the two before them decide cost little, whatever order 0 says."""
    rng = np.random.default_rng(9)
    follow = rng.integers(0, 5000, (200, 200))
    ids = [1, 2]
    for _ in range(60_000):
        ids.append(int(follow[ids[-2] % 200, ids[-1] % 200]) if rng.random() < 0.97 else int(rng.integers(0, 5000)))
    ids = np.array(ids, "<u4")
    _, _, words = idblocks.encode(ids, 5000)
    _, _, shuffled = idblocks.encode(rng.permutation(ids), 5000)
    assert len(words) < 0.75 * len(shuffled)


def test_token_files_of_odd_documents(spark):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choices(["one", "two", "Three", "ß", "微信", "#"], k=rng.randint(0, 60)))) for i in range(120)]
    texts += [(5, "again"), (5, "again"), (5, "other"), (None, "no id"), (None, None), (500, None), (501, ""), (-3, "x " * 30_000)]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(*t, 1, b"x") for t in texts], "doc_id long, text string, start int, ids binary").repartition(7)
    path = idblocks.new_folder(spark, "test-ids")
    for block_ids in (1 << 20, 500):
        where = f"{path}-{block_ids}"
        got = idblocks.write_documents(docs, queries.TOKENIZER, where, block_ids=block_ids).collect()
        tokenizer = Tokenizer.from_file(queries.TOKENIZER)
        got.sort(key=lambda r: r["start"])
        assert [r["doc_id"] for r in got] == sorted((k for k, _ in texts), key=lambda k: (k is not None, k))
        at = 0
        for r in got:
            assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
            at += r["n_tokens"]
        as_ids = lambda t: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        assert sorted(((r["doc_id"], r["ids"]) for r in got), key=repr) == sorted(((k, as_ids(t)) for k, t in texts), key=repr)
        digest = {(r["doc_id"], r["ids_crc32"]) for r in idblocks.digests(idblocks.read_ids(spark, where)).collect()}
        assert digest == {(k, zlib.crc32(as_ids(t))) for k, t in texts}
    files = list(Path(where.removeprefix("file://")).glob("*.ids"))
    assert files and len(list(Path(where.removeprefix("file://")).glob("_manifest-*"))) == 1
    (files[0].parent / "left-over.ids").write_bytes(b"of a failed task")  # no manifest names it
    assert idblocks.read_ids(spark, where).count() == len(texts)
    assert idblocks.write_documents(docs.limit(0), queries.TOKENIZER).count() == 0
    idblocks.write_ids(spark.createDataFrame([(1, np.array([9], "<u4").tobytes())], "doc_id long, ids binary"), where, 10)  # appended behind
    assert idblocks.read_ids(spark, where).where("doc_id = 1 and n_tokens = 1").first()["start"] == at
