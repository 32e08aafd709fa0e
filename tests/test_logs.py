"""Line numbers over several files, and labels whose last line stands."""

import gzip

from chronoloom.sources import logs


def test_lines_of_several_files_are_numbered_in_order_of_path(spark, tmp_path):
    sizes = {"a.log": 3, "b.log": 5, "c.log": 9, "d.log": 4000, "e.log": 1}
    for name, n in sizes.items():
        (tmp_path / name).write_text("".join(f"{name} {i}\n" for i in range(n)))
    want = [f"{name} {i}" for name, n in sorted(sizes.items()) for i in range(n)]
    got = sorted((r["row_id"], r["line"]) for r in logs.read_lines(spark, str(tmp_path)).collect())
    assert got == list(enumerate(want))


def test_a_file_of_many_splits_beside_a_compressed_one(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        big = [f"big line {i} " + "x" * (i % 70) for i in range(3000)]
        (tmp_path / "m.log").write_text("\n".join(big) + "\n")
        with gzip.open(tmp_path / "c.log.gz", "wt") as f:
            f.write("".join(f"zipped {i}\n" for i in range(500)))
        (tmp_path / "z.log").write_bytes(b"bad \xff byte\nlast line without an end")
        lines = logs.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 10
        want = [f"zipped {i}" for i in range(500)] + big + ["bad � byte", "last line without an end"]
        assert sorted((r["row_id"], r["line"]) for r in lines.collect()) == list(enumerate(want))
        assert logs.read_lines(spark, str(tmp_path), limit=510).count() == 510
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_last_label_of_a_block_stands(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("BlockId,Label\nblk_1,Normal\nblk_2,Anomaly\nblk_1,Anomaly\nblk_2,Normal\nbroken\nblk_3,Normal\n")
    labels = logs.read_block_labels(spark, str(tmp_path / "labels.csv"))
    events = spark.createDataFrame([(i, f"blk_{i}") for i in range(1, 5)], "row_id long, block_id string")
    got = {r["block_id"]: (r["label"], r["anomaly"]) for r in logs.join_block_labels(events, labels, order="row_id").collect()}
    assert got == {"blk_1": ("Anomaly", True), "blk_2": ("Normal", False), "blk_3": ("Normal", False), "blk_4": (None, False)}
