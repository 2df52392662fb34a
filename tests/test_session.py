"""The shared folder: named by the cluster, refused where a cluster names none, and emptied at the end."""

import os
import time
from types import SimpleNamespace as Stub

import pytest

from tidewheel import session


def stub(master, configured=None):
    seen = []
    none = Stub(isDefined=lambda: False, get=lambda: seen[-1])
    context = Stub(master=master, _jsc=Stub(sc=lambda: Stub(getCheckpointDir=lambda: none)), getConf=lambda: Stub(get=lambda key: None), setCheckpointDir=seen.append)
    return Stub(sparkContext=context, conf=Stub(get=lambda key, default=None: configured)), seen


@pytest.mark.parametrize("master", ["spark://head:7077", "yarn", "k8s://https://x", "local-cluster[2,1,1024]"])
def test_a_cluster_has_to_name_a_folder(master):
    spark, seen = stub(master)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(spark)
    spark, seen = stub(master, "hdfs://shared/x")
    assert session.ensure_checkpoint_dir(spark) == "hdfs://shared/x" == seen[0]


def test_cut_keeps_rows_and_schema(spark):
    df = spark.range(20).selectExpr("id", "array(id, null) AS a", "cast(id AS string) AS s", "named_struct('x', id) AS t")
    again = session.cut(df)
    assert again.dtypes == df.dtypes and sorted(map(str, again.collect())) == sorted(map(str, df.collect()))
    assert session.cut(df.where("false")).count() == 0
    root = session.ensure_checkpoint_dir(spark).removeprefix("file:")
    assert os.path.isdir(root) and any(name.startswith("cut-") for name in os.listdir(root))
    plan = again._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and "parquet" in plan.lower()


def test_cut_leaves_no_shuffle_files(spark):
    """They go when the table is written, and the table when it is discarded, not when the driver collects its garbage."""
    from pyspark.sql import functions as F

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {str(files.apply(k)) for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}

    before = shuffled()
    kept = session.cut(spark.range(5000).repartition(7, "id").withColumn("k", F.col("id") % 3))
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before and kept.count() == 5000
    session.discard(kept)
    assert not os.path.exists(kept.cut_at.removeprefix("file:"))
