"""Explicit schemas of all records; nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


_L, _S, _D, _T, _I = LongType(), StringType(), DoubleType(), TimestampType(), IntegerType()

TEXT_LINE = _struct(value=_S)
TIMESTAMPED_NUMBER = _struct(event_time=_T, value=_L)
COUNTED_NUMBER = _struct(event_time=_T, value=_L, shard=_S, seq=_L)

PERSON = _struct(
    timestamp=_L, person_id=_L, name=_S, email=_S, city=_S, country=_S, province=_S,
    zipcode=_S, homepage=_S, creditcard=_S, event_time=_T, ingestion_timestamp=_L,
)
AUCTION = _struct(
    timestamp=_L, auction_id=_L, item_id=_L, person_id=_L, initial_price=_D, category_id=_L,
    start=_L, end=_L, event_time=_T, ingestion_timestamp=_L,
)
NEW_USER_AUCTION = _struct(
    window_evicting=_L, person_creation=_L, person_ingestion=_L, auction_creation=_L,
    auction_ingestion=_L, person_id=_L, person_name=_S,
)

AD_EVENT = _struct(
    user_id=_S, page_id=_S, ad_id=_S, ad_type=_S, event_type=_S, event_time=_T, ip_address=_S,
)
NUMBERED_AD_EVENT = StructType([StructField("id", _L, True), *AD_EVENT.fields])
WINDOWED_COUNT = _struct(window_start=_T, campaign_id=_S, count=_L, last_update=_T)

GEO_EVENT = _struct(lat=_L, lng=_L, category=_S)
REGION_WINDOW = _struct(window_start=_T, window_end=_T, region=_I, count=_L)
