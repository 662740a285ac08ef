"""Every stage of the corpus pipeline, and all of them in their order, on a small folder of tables."""

import random

import pytest

import corpus_pipeline

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards brew ale"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices(["ra", "to", "mi", "len", "sa", "ku", "ve"], k=rng.randint(2, 4))) for _ in range(400)]
    rows, labels = [], []
    for i in range(500):
        text = rng.choices(vocabulary, k=rng.randint(12, 60))
        if i % 5 == 0:
            text[rng.randrange(len(text))] = rng.choice(["grubflix", "dromzak", "pilfwot"])
        rows.append((i, " ".join(text), "en", "a", 1))
        labels.append((i, 1, int(i % 5 == 0)))
    clean = " ".join(rng.choices(vocabulary, k=40))
    rows += [(900, clean, "en", "b", 1), (901, clean, "en", "b", 1), (902, clean + " more", "en", "b", 1), (910, f"{vocabulary[0]} {ITEM} {vocabulary[1]}", "en", "b", 1)]
    rows += [(None, f"see {ITEM} here", "en", None, None), (None, "plain null id", None, None, None), (920, None, None, None, None), (921, "", "en", "a", 0), (922, f"{' '.join(rng.choices(vocabulary, k=20))} mail me at bob@example.com now", "en", "a", 1)]
    home = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    return str(home), rows


def test_stages_in_their_order(spark, folder, tmp_path):
    home, rows = folder
    docs, kept = spark.read.parquet(f"{home}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, home).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    ids = {name: sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in found) for name, found in kept.items()}
    toxic = {i for i in range(500) if i % 5 == 0}
    assert len(toxic & set(ids["toxicity"])) <= 5 and set(range(500)) - toxic <= set(ids["toxicity"]) and {900, 901, 902, 910, 920, 921, 922, -1} <= set(ids["toxicity"])
    assert {900, 901, 902} & set(ids["near_copies"]) == {900} and ids["near_copies"].count(-1) == 2 and {920, 921} <= set(ids["near_copies"])
    assert 910 not in ids["decontamination"] and ids["decontamination"].count(-1) == 1 and set(ids["near_copies"]) - {910} == set(ids["decontamination"])
    redacted = {r["doc_id"]: r["text"] for r in kept["pii"]}
    assert ids["pii"] == ids["decontamination"] and "[EMAIL]" in redacted[922] and "bob@" not in redacted[922] and redacted[900] == next(r[1] for r in rows if r[0] == 900)
    assert ids["packing"] == ids["pii"]
    assert sorted((r["doc_id"] or -1, r["ids_crc32"]) for r in corpus_pipeline.run(spark, home).collect()) == sorted((r["doc_id"] or -1, r["ids_crc32"]) for r in kept["packing"])


def test_stages_take_an_empty_table(spark, folder):
    home, _ = folder
    docs = spark.read.parquet(f"{home}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, home).count() == 0
