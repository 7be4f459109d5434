"""Elapsed times are rounded from whole microseconds."""

from kinframe.operators.ingest import scan_summary


def test_half_a_millisecond_rounds_up(spark):
    rows = [(1, "2024-01-01 00:00:01.000007", "running"), (1, "2024-01-29 01:51:08.934507", "done")]
    for kind in ("timestamp", "timestamp_ntz"):
        events = spark.createDataFrame(rows, "scan_id long, ts string, status string").selectExpr(
            "scan_id", f"CAST(ts AS {kind}) AS ts", "status", "1L AS total", "1L AS scanned"
        )
        row = scan_summary(events).first()
        assert row["elapsed_ms"] == 2425867935 and row["cancelled"] is False
