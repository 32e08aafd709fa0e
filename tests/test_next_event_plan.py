"""Next-event counts and scores: what is shuffled, and odd rows."""

import re

import numpy as np
from pyspark.sql import functions as F

from chronoloom.operators import detect

ROWS = "row_id long, s long, node string, template_id int"


def encoded(spark, rows):
    return spark.createDataFrame(rows, ROWS).select("row_id", F.timestamp_seconds("s").alias("timestamp"), "node", "template_id")


def chain(n, node, shift=0):
    """``n`` events whose order repeats in part only."""
    return [(shift + i, i, node, (i * i % 7 + i // 3) % 4) for i in range(n)]


def plain(train, rows, n_templates, order, history, top_k):
    """{row: (score, flag)} by plain back-off; rows of one id take the longest context, the last of them."""

    def told(rows):
        by = {}
        for r in sorted(rows, key=lambda r: (r[1], -1 if r[0] is None else r[0])):
            by.setdefault(r[2], []).append(r)
        return [(r, own[max(0, i - order) : i], i) for own in by.values() for i, r in enumerate(own)]

    counts = {}
    for r, past, _ in told(train):
        for k in range(len(past) + 1):
            of = counts.setdefault(tuple(x[3] for x in past[len(past) - k :]), {})
            of[r[3]] = of.get(r[3], 0) + 1
    best = {}
    for r, past, before in told(rows):
        ids = tuple(x[3] for x in past)
        found = [ids[len(ids) - k :] for k in range(len(ids), 0, -1) if ids[len(ids) - k :] in counts]
        if before >= history and found and r[0] is not None:
            best[r[0]] = max(best.get(r[0], (0, 0, ())), (len(found[0]), before, found[0]))
    out = []
    for r, _, before in told(rows):
        of = counts[best.get(r[0], (0, 0, ()))[2]]
        rank = sorted(of, key=lambda x: (-of[x], x)).index(r[3]) + 1 if r[3] in of else len(of) + 1
        p = (of.get(r[3], 0) + 1) / (sum(of.values()) + n_templates + 1)
        out.append((str(r[0]), str(r[2]), round(-np.log(p), 9) if before >= history else 0.0, before >= history and rank > min(top_k, n_templates + 1)))
    return sorted(out)


def scored(spark, train, rows, history=4, order=5):
    counts = detect.next_event_counts(encoded(spark, train), order)
    return detect.next_event_scores(encoded(spark, rows), counts, 4, order=order, history=history, top_k=2)


def as_rows(df):
    return sorted((str(r["row_id"]), str(r["node"]), round(r["score"], 9), r["flag"]) for r in df.collect())


def test_contexts_of_a_history_are_not_shuffled(spark):
    plan = scored(spark, chain(60, "a"), chain(60, "b"))._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(near" in line]
    assert len(dealt) == 2 and all("REPARTITION_BY_NUM" in line for line in dealt)  # training and judged histories, each before its contexts are made
    assert not re.search(r"Exchange hashpartitioning\(size#", plan)


def test_more_partitions_of_the_session_are_more_parts_of_histories(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    parts = lambda: detect._dealt(spark.createDataFrame([([1, 2, 3], 1)], "ids array<int>, template_id int")).rdd.getNumPartitions()
    try:
        few = parts()
        spark.conf.set("spark.sql.shuffle.partitions", str(3 * int(was)))
        assert parts() == 3 * few
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_repeated_ids_null_nodes_and_unknown_events_score_as_plain_back_off(spark):
    train = chain(80, "a") + chain(40, None, 100)
    rows = [*chain(60, "a"), *chain(60, None, 200), *[(300 + i, i, "c", 9 if i % 11 == 5 else (i * 5 + i // 4) % 4) for i in range(70)]]
    rows += rows[20:26] + [rows[-1]] * 2 + [(None, 50 + i, "d", i % 4) for i in range(9)]
    want = plain(train, rows, 4, 5, 4, 2)
    assert as_rows(scored(spark, train, rows)) == want and {w[3] for w in want} == {True, False}


def test_short_histories_and_one_event_contexts(spark):
    train, rows = chain(30, "a"), chain(30, "b") + [(900, 0, "c", 1)]
    for order, history in ((1, 1), (2, 0), (5, 1)):
        assert as_rows(scored(spark, train, rows, history, order)) == plain(train, rows, 4, order, history, 2)


def test_nothing_learned_gives_no_rows(spark):
    assert as_rows(scored(spark, [], chain(20, "a"))) == []
