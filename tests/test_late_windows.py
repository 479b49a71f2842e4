"""Window counts over files that come in no order of time."""

import pytest
from pyspark.sql import functions as F

from cadenza.session import work_path
from cadenza.workload import streams


@pytest.mark.parametrize("name", ["t1", "t2"])
def test_shuffled_files_lose_no_rows(spark, sf, name, monkeypatch):
    folder = work_path(spark, "shuffled")
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(6, F.xxhash64("event_id")).write.parquet(f"{folder}/events.parquet")
    whole = streams.event_stream
    monkeypatch.setattr(streams, "event_stream", lambda spark, sf: whole(spark, sf, files_per_trigger=1))
    query = {"t1": streams.t1_stream, "t2": streams.t2}[name]
    total = query(spark, folder).agg(F.sum("requests")).first()[0]
    assert total == events.count() * {"t1": 1, "t2": 4}[name]
