from declq.streaming import events
from tests.conftest import DATA


def test_windowed_counts(spark):
    out = events.windowed_counts(events.read_events(spark, DATA))
    q = out.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM windows").first()[0] == spark.read.parquet(f"{DATA}/events.parquet").count()
