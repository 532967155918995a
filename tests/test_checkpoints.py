"""Tables that cut lineage, and their removal."""

import glob

from marquee.checkpoints import CLEANUP, cut, settled, shared_dir


def test_cut_and_settled(spark):
    held = spark.conf.get(CLEANUP)
    df = spark.range(10).repartition(3, "id")
    folder = shared_dir(spark).removeprefix("file:")

    def build():
        return cut(df.where("id > 3"), "step").where("id > 5")

    out = settled(spark, "result", build)
    assert sorted(r[0] for r in out.collect()) == [6, 7, 8, 9]
    assert not glob.glob(f"{folder}/step-*") and glob.glob(f"{folder}/result-*")
    assert spark.conf.get(CLEANUP) == held
    assert cut(df.where("false"), "empty").collect() == []
