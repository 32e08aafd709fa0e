"""The order signature of rows that lie in order equals that of any rows, and shuffles once."""

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import ordered
from chronoloom.operators import audit, sequence

ROWS = "row_id long, s long, node string, anomaly boolean, event_template string"


def context(spark, rows):
    return sequence.add_sequence_context(spark.createDataFrame(rows, ROWS).select("row_id", F.timestamp_seconds("s").alias("timestamp"), "node", "anomaly", "event_template"))


def odd_rows():
    """Nodes of which one is null, null and odd templates and labels, null times, rows that come twice or three times."""
    rows = [(i, i // 3, ("a", "b", None)[i % 3], (i * 7 % 11) == 0, "xyzw"[i * i % 5 % 4]) for i in range(120)]
    rows += [(200 + i, 5 + i, "c", (None, False, True)[i % 3], (None, "x", "y", "x", "q")[i % 5]) for i in range(30)]
    rows += [(300 + i, None, "d", False, "xyx"[i % 3]) for i in range(6)]
    rows += [(400, 0, "lonely", False, "x"), (401, 0, "never", True, "x"), (402, 1, "never", True, "x")]
    return rows + rows[40:60] + rows[50:55] + rows[-2:]


def told(df):
    return sorted(map(str, (tuple(r) for r in df.select("row_id", "node", "event_template", "prev_template", "next_template", "order_status", "pure_order").collect())))


@pytest.mark.parametrize("block_rows", [1_000_000, 20])
def test_rows_in_order_are_told_what_any_rows_are(spark, monkeypatch, block_rows):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", block_rows)
    rows = odd_rows()
    want = told(audit.pure_order(context(spark, rows)))
    assert told(audit.pure_order(context(spark, rows), in_order=True)) == want and len(want) == len(rows)
    assert {status for status in ("judged", "no_context", "unknown_template") if any(status in w for w in want)} == {"judged", "no_context", "unknown_template"}


def test_no_rows(spark):
    assert told(audit.pure_order(context(spark, []), in_order=True)) == []


def test_rows_in_order_are_shuffled_once(spark):
    plan = audit.pure_order(context(spark, odd_rows()), in_order=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_the_query_shuffles_once(spark):
    from chronoloom.plans import queries as plans

    from .conftest import SF

    plan = plans.queries()["pure_order"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
