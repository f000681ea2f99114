from __future__ import annotations

import os

from panelwright.llm import common


def test_written_tables_can_be_swept(spark):
    df = common.written(spark.range(10), "numbers")
    path = df.inputFiles()[0].removeprefix("file://").removeprefix("file:")
    assert df.count() == 10 and os.path.exists(path)
    common.sweep()
    assert not os.path.exists(path)


def test_sweeping_spares_what_is_kept(spark):
    first, second = common.written(spark.range(3), "first"), common.written(spark.range(4), "second")
    gone = first.inputFiles()[0].removeprefix("file://").removeprefix("file:")
    common.sweep(second)
    assert second.count() == 4 and not os.path.exists(gone)
    common.sweep()


def test_the_pipeline_leaves_only_its_last_input(spark):
    import corpus_pipeline as cp

    common.sweep()
    cp.run(spark, "/root/testdata/sf0.001").count()
    assert [os.path.basename(path).rsplit("-", 1)[0] for _, path in common._WRITTEN] == ["pii"]


def test_slices_hold_all_rows():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(range(n))], ["x"]) for n in (2500, 0, 1)]
    sizes = [b.num_rows for b in common.sliced(iter(batches))]
    assert sizes == [1000, 1000, 500, 0, 1]
