"""Tables go to all executors by what they take, not by what their files let guess."""

import pytest
from pyspark.sql import functions as F

from lattica.operators import lineage
from lattica.plans import analysis


def test_ids_of_a_wide_table_are_not_sent(spark, monkeypatch):
    monkeypatch.setattr(lineage, "SURE", 16 << 10)
    same = [F.lit("the same text in each row").alias(f"c{i}") for i in range(12)]
    wide = lineage.materialise(spark.range(200_000).select("id", *same))
    joined = lambda: spark.range(1_000_000).join(wide.select("id"), "id", "left_semi")._jdf.queryExecution().executedPlan().toString()
    before = {k: spark.conf.get(k, None) for k in (lineage.SENT, lineage.SENT_KNOWN)}
    limit = spark.conf.get(lineage.SENT)
    assert "BroadcastHashJoin" in joined()
    with lineage.sent_by_size(spark):
        assert "BroadcastHashJoin" not in joined() and int(spark.conf.get(lineage.SENT)) == 16 << 10
        assert spark.conf.get(lineage.SENT_KNOWN) == limit
    assert {k: spark.conf.get(k, None) for k in before} == before


@pytest.mark.parametrize("session, size", [("-1", -1), ("10MB", 10 << 20), ("256k", 256 << 10), ("7", 7), ("1048576b", 1 << 20)])
def test_sizes_of_a_session(session, size):
    assert lineage._bytes(session) == size


def test_analyses_send_by_size(spark, monkeypatch):
    seen = []

    class Stop(Exception):
        pass

    def stop(p, *rest):
        seen.append(int(spark.conf.get(lineage.SENT)))
        raise Stop

    monkeypatch.setattr(analysis, "diagram", stop)
    nothing = spark.createDataFrame([], "path_id string, src long, dst long")
    before = spark.conf.get(lineage.SENT)
    with pytest.raises(Stop):
        analysis.analyse(analysis.Project.of(nothing, nothing, nothing), nothing, nothing, nothing, nothing)
    assert seen == [lineage.SURE] and spark.conf.get(lineage.SENT) == before
