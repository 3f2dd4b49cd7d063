import gc
import os
import time

from tidefold.storage import shared_dir, sweep, written


def folders(spark):
    top = shared_dir(spark).removeprefix("file:")
    return {f for f in os.listdir(top) if f.startswith("kept-or-not")}


def test_tables_go_when_nothing_can_read_them(spark):
    before = folders(spark)
    table = written(spark.range(10), "kept-or-not")
    derived = table.join(table.withColumnRenamed("id", "other"), table["id"] == table["id"]).where("other > 3")
    del table
    sweep(spark, collect=True)
    assert len(folders(spark) - before) == 1 and derived.count() == 60
    derived = None
    for _ in range(20):
        sweep(spark, collect=True)
        if not folders(spark) - before:
            break
        gc.collect()
        time.sleep(0.2)
    assert not folders(spark) - before
