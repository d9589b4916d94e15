import time

import pytest
from pyspark.sql import functions as F

from finloom import session
from finloom.session import CLEANUP_KEY, bound_tasks, materialise, working_root
from finloom.sources.planning_tables import planning_tables


class _Context:
    def __init__(self, master, directory=None, conf=None):
        self.master, self.applicationId, self._dir, self._conf = master, "app-1", directory, conf or {}

    def getConf(self):
        return self._conf

    def getCheckpointDir(self):
        return self._dir


class _Session:
    def __init__(self, *args, **options):
        self.sparkContext = _Context(*args, **options)


def test_named_folder_wins():
    session = _Session("yarn", "hdfs:/other", {"spark.checkpoint.dir": "hdfs:/shared/"})
    assert working_root(session) == "hdfs:/shared/finloom-app-1"
    assert working_root(_Session("yarn", "hdfs:/other")) == "hdfs:/other/finloom-app-1"


def test_cluster_without_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        working_root(_Session("spark://host:7077"))


def test_stored_frame_keeps_rows_and_types(spark):
    frame = spark.sql("select id, cast(id as decimal(20,4)) as d, array(struct(id as i)) as a from range(5)")
    stored = materialise(frame, "t")
    assert stored.schema.simpleString() == frame.schema.simpleString() and sorted(stored.collect()) == sorted(frame.collect())


def test_shuffle_files_go_when_a_frame_is_stored(spark):
    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {x for x in files.split("\n") if "shuffle_" in x}

    before, setting = shuffled(), spark.conf.get(CLEANUP_KEY)
    counted = spark.range(5000).groupBy((F.col("id") % 1000).alias("k")).count()
    assert counted.collect() and shuffled() - before
    before = shuffled()
    stored = materialise(counted, "t")
    end = time.time() + 20
    while shuffled() - before and time.time() < end:  # files are removed in the background
        time.sleep(0.1)
    assert not shuffled() - before and spark.conf.get(CLEANUP_KEY) == setting
    assert stored.count() == counted.count() == 1000


def test_larger_input_is_cut_more_finely(spark, tmp_path, monkeypatch):
    keys = ["spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    before = {k: spark.conf.get(k) for k in keys}
    (tmp_path / "t").write_bytes(bytes(9000))
    try:
        bound_tasks(spark, [str(tmp_path / "t")])
        assert {k: spark.conf.get(k) for k in keys} == before
        monkeypatch.setattr(session, "SHARE", 1000)
        monkeypatch.setattr(session, "MOST_READ", 4000)
        bound_tasks(spark, [str(tmp_path / "t")])
        assert spark.conf.get(keys[0]) == "9" and spark.conf.get(keys[1]) == "4000" and int(spark.conf.get(keys[2])) == session.MOST_SHUFFLED
        spark.conf.set(keys[2], "1MB")
        bound_tasks(spark, [str(tmp_path / "t")])
        assert spark.conf.get(keys[0]) == "9" and int(spark.conf.get(keys[2])) == 1 << 20
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_planning_tables_are_read_in_bounded_tasks(spark, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(session, "SHARE", 10_000)
    try:
        planning_tables(spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) > int(before)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
