"""Ad views per campaign and window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.enrich import BROADCAST_BYTES, check_dimension, enrich
from tidemark.operators.windows import CAMPAIGN_WINDOW, windowed_count

# Fixed value: the events that are counted.
COUNTED_EVENT = "view"


def ad_views(events: DataFrame, event_type: str = COUNTED_EVENT) -> DataFrame:
    """Ad and time of the events of one type."""
    return events.where(F.col("event_type") == event_type).select("ad_id", "event_time")


def campaign_counts(
    views: DataFrame,
    campaigns: DataFrame,
    width: str = CAMPAIGN_WINDOW,
    missing: str = "error",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Views and latest view per tumbling window and campaign.

    With a campaign table that can be broadcast, each view finds its campaign
    where it is and one shuffle of partial counts follows. With a larger one, a
    batch counts per ad first, so that the join meets one row per ad and window
    and no ad is too hot for it, and then adds up per campaign.
    """
    campaigns = campaigns.select("ad_id", "campaign_id")
    size = check_dimension(campaigns, "ad_id")
    if size.bytes <= broadcast_bytes or views.isStreaming:
        joined = enrich(views, campaigns, "ad_id", missing, broadcast_bytes, size)
        return windowed_count(joined, "campaign_id", "event_time", width)
    per_ad = windowed_count(views, "ad_id", "event_time", width)
    joined = enrich(
        per_ad, campaigns, "ad_id", missing, broadcast_bytes, size, split_hot=False
    )
    return joined.groupBy("window_start", "campaign_id").agg(
        F.sum("count").alias("count"), F.max("last_update").alias("last_update")
    )
