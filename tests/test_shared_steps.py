"""Steps that whole experiments share: nodes are counted once, small nodes take one pass, independent steps run side by side."""

import threading

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import ordered, quantile
from chronoloom.operators import baseline, inject, sequence
from chronoloom.plans import experiments as ex
from chronoloom.plans import queries as plans
from chronoloom.sources.sinks import stage, together

SF = "/root/testdata/sf0.001"


def test_nodes_are_counted_once(spark, monkeypatch):
    context = stage(sequence.add_sequence_context(plans.events(spark, SF)), "context")
    largest = context.groupBy("node").count().agg(F.max("count")).first()[0]
    assert ordered.most_rows(context) == largest
    runs = inject.of_run(context.where("not anomaly").withColumn("seed", F.lit(7)))

    def again(*_):
        raise AssertionError("nodes are counted again")

    monkeypatch.setattr(ordered, "_cut_points", again)
    assert sequence.add_position(runs).agg(F.max("position")).first()[0] < largest
    with pytest.raises(AssertionError):  # blocks of fewer rows ask for cuts
        ordered.by_node(runs, lambda d, w, _: d, block_rows=largest - 1)


def test_small_nodes_take_one_pass(spark, monkeypatch):
    context = stage(sequence.add_sequence_context(plans.events(spark, SF)), "context")
    gaps = context.where(sequence.normal_transition()).select("node", "gap_prev_s")
    plain = gaps.select(F.concat("node", F.lit("")).alias("node"), "gap_prev_s")
    assert ordered.most_rows(plain) is None
    want = sorted(map(tuple, baseline.node_baselines(plain).collect()))
    monkeypatch.setattr(baseline, "grouped_medians", None)
    assert sorted(map(tuple, baseline.node_baselines(gaps).collect())) == want and want


def test_neighbouring_ranks_across_bins(spark):
    values = [0.0] * 40 + [1.0, 5.0, 5.0, 90.0] + [100.0] * 7
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (0, 77, 79, 81, 83, 85, 87, 99, 100):
        at, rest = divmod(k, 2)
        want = (values[at] + values[at + rest]) / 2
        assert quantile.exact_quantile(df, "v", k / 2 / (len(values) - 1), bins=4, small=3) == pytest.approx(want)


def test_independent_steps_run_side_by_side(spark):
    both = threading.Barrier(2, timeout=30)
    assert together(lambda: both.wait() >= 0 and 1, lambda: both.wait() >= 0 and spark.range(2).count()) == [1, 2]
    with pytest.raises(ZeroDivisionError):
        together(lambda: 1 / 0, lambda: 1)


def test_a_part_is_made_by_one_thread(spark):
    clean, made = ex.Clean(*[None] * 10), []
    together(*[lambda: clean.once("part", lambda: made.append(1) or 1)] * 4)
    assert made == [1]


def test_an_audit_reads_a_written_context(spark):
    rows = ex.audited(sequence.add_sequence_context(plans.events(spark, SF)))
    assert not any(f.endswith("events.parquet") for f in rows.inputFiles())  # windows aren't run again by every pass
    assert rows.where("timing_gap is not null").count()


def test_a_sweep_makes_clean_windows_once(spark, monkeypatch):
    clean, names = ex.Clean.of(plans.events(spark, SF)), []
    monkeypatch.setattr(ex, "stage", lambda d, name: names.append(name) or stage(d, name))
    assert ex.window_sweep(clean, schemes=(("fixed_count", 5),)).count() == 4
    assert names.count("clean-windows") == 1 and ("windows", ("fixed_count", 5), *ex.TIMING) in clean.made
