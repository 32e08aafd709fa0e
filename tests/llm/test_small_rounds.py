"""Steps with few rows write few files, and rows that a join would drop aren't moved to it."""

import pytest

from chronoloom.llm import common, components, near_copies


@pytest.fixture
def many_partitions(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_rounds_of_a_small_graph_write_one_file_each(spark, monkeypatch, many_partitions):
    files = []

    def counted(df, name, **more):
        found = common.durable(df, name, **more)
        files.append(len(found.inputFiles()))
        return found

    monkeypatch.setattr(components, "durable", counted)
    edges = spark.createDataFrame([(k, k + 1) for k in range(300) if k % 100 != 99], "a long, b long")
    found = {r["node"]: r["label"] for r in components.connected_components(edges).collect()}
    assert found == {k: k - k % 100 for k in range(300)}
    assert len(files) > 3 and set(files[1:]) == {1}  # the first are the edges themselves, whose number isn't known


def test_rounds_of_a_larger_graph_keep_several_files(spark, monkeypatch, many_partitions):
    monkeypatch.setattr(common, "FILE_ROWS", 50)
    edges = spark.createDataFrame([(k, k + 1) for k in range(300) if k % 100 != 99], "a long, b long")
    assert {r["node"]: r["label"] for r in components.connected_components(edges).collect()} == {k: k - k % 100 for k in range(300)}
    assert len(common.durable(edges.repartition(30), "edges", rows=297).inputFiles()) == 6


def test_marks_hold_every_key_and_few_others(spark):
    keys = spark.range(20_000).selectExpr("xxhash64(id) AS key", "id", "id % 10 = 0 AS wanted")
    mark = common.marks(keys.where("wanted"), "key")
    found = common.marked(keys, "key", mark)
    assert found.columns == keys.columns
    assert found.where("wanted").count() == 2000 and found.where("not wanted").count() < 40
    assert common.marked(keys, "key", common.marks(keys.where("false"), "key")).isEmpty()


def test_near_dedup_moves_only_texts_that_may_be_near_copies(spark, monkeypatch):
    """Of 200 texts with a single pair of near copies, few come to the shingle sets' join."""
    texts = [" ".join(f"w{k}-{j}" for j in range(60)) for k in range(200)]
    texts.append(texts[0] + " more")
    moved, plain = [], common.marked

    def watched(rows, key, of):
        moved.append(plain(rows, key, of))
        return moved[-1]

    monkeypatch.setattr(near_copies, "marked", watched)
    monkeypatch.setattr(near_copies, "forget", lambda df: None)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = {r["doc_id"]: r["label"] for r in near_copies.near_copies(docs).collect()}
    assert labels[0] == labels[200] and len(set(labels.values())) == 200
    assert {0, 200} <= {r["doc"] for r in moved[0].collect()} and moved[0].count() < 20
