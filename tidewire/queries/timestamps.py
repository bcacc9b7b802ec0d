"""Queries of the timestamp operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators.timestamps import normalise_timestamps, wire_time_values
from tidewire.queries import query
from tidewire.session import table


def _normalised(spark, d):
    feeds = table(spark, d, "feeds")
    values = wire_time_values(table(spark, d, "rss_items"), table(spark, d, "news_articles"), feeds)
    return normalise_timestamps(values, feeds)


@query("p4_found")
def p4_found(spark, d):
    return _normalised(spark, d).where("resolved").select("rec_table", "rec_id", "field_name", "utc_ms").distinct()


@query("p4_notations")
def p4_notations(spark, d):
    """How often each notation occurs, and how many of its values stayed unresolved."""
    return _normalised(spark, d).groupBy("rec_table", "field_name", "notation").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("resolved")).alias("n_unresolved"))
