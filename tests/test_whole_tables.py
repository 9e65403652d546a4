"""Queries whose rows come in an order."""

from __future__ import annotations

from tesserae.plans import catalog

def test_order_of_all_events(spark, sf_dir):
    got = [(r["kind"], r["event_id"]) for r in catalog.QUERIES["t1_sorted_kinds"](spark, sf_dir).collect()]
    assert len(got) == spark.read.parquet(f"{sf_dir}/events.parquet").count() > 200
    assert got == sorted(got)
