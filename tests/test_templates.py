"""The miner in parallel against one miner that reads the whole stream."""

import numpy as np
import pytest

from chronoloom.functions import templates
from chronoloom.functions.templates import WILDCARD, TemplateMiner
from chronoloom.plans import queries as plans

from .conftest import SF


def messages(n, seed, kinds=40):
    """Messages of drifting kinds: new tokens at known places, groups that meet, many first words."""
    rng = np.random.default_rng(seed)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    base = [list(rng.choice(words, rng.integers(0, 7))) for _ in range(kinds)]
    out = []
    for i in range(n):
        m = list(base[int(rng.integers(0, 3 + kinds * i // n) % kinds)])
        for k in range(len(m)):
            if rng.random() < 0.15:
                m[k] = str(rng.choice(words)) if rng.random() < 0.5 else str(rng.integers(0, 50))
        out.append(" ".join(m))
    return out


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 3), (3, 7), (4, 7)])
def test_one_stream_in_any_number_of_parts(spark, seed, parts):
    texts = messages(1500, seed)
    miner, known, groups = TemplateMiner(), [], []
    for m in texts:
        group, _ = miner.take(m)
        groups.append(group)
        known.append(miner.template(group))
    rows = spark.createDataFrame([(i, m, 1) for i, m in enumerate(texts)], "row_id long, raw_message string, template_id int").repartition(parts)
    got = templates.mine_stream(rows).orderBy("row_id").collect()
    assert [r["event_template"] for r in got] == known
    assert [r["template_id"] for r in got] == groups
    assert [r["final_template"] for r in got] == [miner.template(g) for g in groups]
    for r in got:
        assert all(a in (b, WILDCARD) for a, b in zip(r["final_template"].split(), r["raw_message"].split()))
    assert templates.train_templates(rows).templates() == miner.templates()
    log = templates.version_log(rows)
    assert len(log) < len(texts) and templates.played(log)[1] == log


def test_log_is_the_same_for_any_partitions(spark):
    texts = messages(800, 9)
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id long, raw_message string")
    assert templates.version_log(rows.repartition(2)) == templates.version_log(rows.repartitionByRange(9, "row_id")) == templates.version_log(rows.coalesce(1))


def test_find_agrees_with_take():
    miner = TemplateMiner(children=5)
    for m in messages(3000, 5, 90):
        group, changes = miner.find(m)
        before = [list(g) for g in miner.groups]
        taken, changed = miner.take(m)
        assert changes == changed == (before != miner.groups)
        assert group in (None, taken) and (group is None) == (len(miner.groups) > len(before))


def test_empty_and_null_messages(spark):
    rows = spark.createDataFrame([(0, None), (1, ""), (2, "a b c"), (3, "a b d")], "row_id long, raw_message string")
    got = [tuple(r) for r in templates.mine_stream(rows).select("row_id", "event_template", "final_template").orderBy("row_id").collect()]
    assert got == [(0, "", ""), (1, "", ""), (2, "a b c", "a b <*>"), (3, "a b <*>", "a b <*>")]
    assert templates.mine_stream(rows.limit(0)).count() == 0


def test_queries_equal_one_miner(spark):
    rows = plans._messages(plans.events(spark, SF)).orderBy("row_id").collect()
    miner = TemplateMiner()
    known = [miner.add(r["raw_message"]) for r in rows]
    got = plans.queries()["drain_templates"](spark, SF).orderBy("row_id").collect()
    assert [r["event_template"] for r in got] == known and [r["row_id"] for r in got] == [r["row_id"] for r in rows]
    final = plans.queries()["drain_templates_final"](spark, SF).orderBy("row_id").collect()
    assert {r["event_template"] for r in final} <= set(miner.templates())
    by_node: dict = {}
    want = [by_node.setdefault(r["node"], TemplateMiner()).add(r["raw_message"]) for r in rows]
    assert [r["event_template"] for r in plans.queries()["drain_templates_by_node"](spark, SF).orderBy("row_id").collect()] == want
    matched = plans.queries()["drain_templates_parallel"](spark, SF).orderBy("row_id").collect()
    assert [r["event_template"] for r in matched] == [miner.match(r["raw_message"]) or r["raw_message"] for r in rows]
