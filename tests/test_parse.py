"""Line formats: every malformed case, in every mode."""

from datetime import datetime, timezone

import pytest
from pyspark.errors import SparkRuntimeException

from tidemark import schemas
from tidemark.sources.lines import kafka_options, text_lines
from tidemark.sources.parse import (
    parse_ad_events,
    parse_auctions,
    parse_geo_events,
    parse_persons,
    parse_timestamped_numbers,
)

AT = datetime(2024, 2, 1, tzinfo=timezone.utc)
AT_MS = 1706745600000
PERSON = "1704067200000,7,Ann,a@x.org,Berlin,DE,BE,10115,http://a.x,1111"
AUCTION = "1704067201000,100,5,7,9.5,3,1704067201000,1704070801000"
AD = "u1,p1,ad1,banner,view,1704067200000,255.255.255.255"


def lines_of(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def names_and_types(schema):
    return [(f.name, f.dataType) for f in schema.fields]


def test_timestamped_number(spark):
    df = parse_timestamped_numbers(lines_of(spark, "1704067200000#15", "1704067200001#-3"))
    assert names_and_types(df.schema) == names_and_types(schemas.TIMESTAMPED_NUMBER)
    rows = df.selectExpr("unix_millis(event_time) AS ms", "value").collect()
    assert [tuple(r) for r in rows] == [(1704067200000, 15), (1704067200001, -3)]


@pytest.mark.parametrize(
    "line, reason",
    [
        ("1704067200000", "no delimiter"),
        ("", "no delimiter"),
        (None, "no line"),
        ("#", "not exactly 2 fields"),
        ("5#", "not exactly 2 fields"),
        ("1#2#3", "not exactly 2 fields"),
        ("#5", "event_time: not a time in milliseconds"),
        ("x#5", "event_time: not a time in milliseconds"),
        ("9223372036854775807#5", "event_time: not a time in milliseconds"),
        ("1#five", "number: not a whole number"),
        ("1# 5", "number: not a whole number"),
        ("1#5 ", "number: not a whole number"),
        ("1#\t5", "number: not a whole number"),
        ("1#5.0", "number: not a whole number"),
        ("1#5L", "number: not a whole number"),
        ("1#+", "number: not a whole number"),
        ("1#9223372036854775808", "number: not a whole number"),
    ],
)
def test_malformed_number(spark, line, reason):
    lines = lines_of(spark, line)
    good, rejected = parse_timestamped_numbers(lines, "quarantine")
    assert good.count() == 0
    assert [tuple(r) for r in rejected.collect()] == [(line, reason)]
    tagged = parse_timestamped_numbers(lines, "tagged").first()
    assert (tagged["event_time"], tagged["number"], tagged["reason"]) == (None, None, reason)
    with pytest.raises(SparkRuntimeException, match="malformed line"):
        parse_timestamped_numbers(lines).collect()
    with pytest.raises(SparkRuntimeException):
        parse_timestamped_numbers(lines).count()


def test_trailing_delimiters_are_dropped(spark):
    row = parse_timestamped_numbers(lines_of(spark, "1#+2##")).first()
    assert row["value"] == 2


def test_person(spark):
    df = parse_persons(lines_of(spark, PERSON, PERSON + ",more,fields"), ingest_time=AT)
    assert names_and_types(df.schema) == names_and_types(schemas.PERSON)
    first, second = df.drop("event_time").collect()
    assert tuple(first) == (
        1704067200000, 7, "Ann", "a@x.org", "Berlin", "DE", "BE", "10115", "http://a.x", "1111",
        AT_MS,
    )
    assert second == first


@pytest.mark.parametrize("line", [PERSON.rsplit(",", 1)[0], PERSON.rsplit(",", 1)[0] + ","])
def test_person_without_last_field(spark, line):
    good, rejected = parse_persons(lines_of(spark, line), "quarantine")
    assert good.count() == 0
    assert rejected.first()["reason"] == "fewer than 10 fields"


def test_person_with_empty_middle_field(spark):
    assert parse_persons(lines_of(spark, PERSON.replace("Ann", ""))).first()["name"] == ""


def test_auction_field_order(spark):
    df = parse_auctions(lines_of(spark, AUCTION), ingest_time=AT)
    assert names_and_types(df.schema) == names_and_types(schemas.AUCTION)
    row = df.first()
    assert (row["auction_id"], row["item_id"], row["person_id"]) == (100, 5, 7)
    assert (row["initial_price"], row["category_id"]) == (9.5, 3)
    assert row["end"] - row["start"] == 3_600_000


@pytest.mark.parametrize(
    "price, value",
    [("abc", None), ("", None), ("nan", None), ("inf", None), ("NaN", "nan"), ("-Infinity", "-inf"),
     ("1e999", "inf"), ("1e3", "1000.0"), (" 9.5 ", "9.5"), ("9.5d", "9.5")],
)
def test_auction_price(spark, price, value):
    good, rejected = parse_auctions(lines_of(spark, AUCTION.replace("9.5", price)), "quarantine")
    got = [str(r["initial_price"]) for r in good.collect()]
    assert got == ([] if value is None else [value])
    assert rejected.count() == (value is None)


def test_ad_events(spark):
    df = parse_ad_events(lines_of(spark, AD))
    assert names_and_types(df.schema) == names_and_types(schemas.AD_EVENT)
    numbered = parse_ad_events(lines_of(spark, "12," + AD), numbered=True)
    assert names_and_types(numbered.schema) == names_and_types(schemas.NUMBERED_AD_EVENT)
    assert numbered.first()["id"] == 12
    assert numbered.drop("id").first() == df.first()


def test_geo_event_skips_a_field(spark):
    df = parse_geo_events(lines_of(spark, "52,13,x,shop"))
    assert names_and_types(df.schema) == names_and_types(schemas.GEO_EVENT)
    assert tuple(df.first()) == (52, 13, "shop")
    _, rejected = parse_geo_events(lines_of(spark, "52,13,x"), "quarantine")
    assert rejected.count() == 1


def test_every_line_is_good_or_rejected(spark):
    lines = lines_of(spark, "1#2", "x#2", "3#4", "5", None, "6#7#8")
    good, rejected = parse_timestamped_numbers(lines, "quarantine")
    assert (good.count(), rejected.count()) == (2, 4)
    assert parse_timestamped_numbers(lines, "tagged").count() == 6


def test_filters_stay_above_the_parser(spark):
    """A filter on a typed column must not drag the parsing into it."""
    df = parse_ad_events(lines_of(spark, AD)).where("event_type = 'view'")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        parse_geo_events(lines_of(spark, "1,2,3,4"), "lenient")


def test_text_lines_drop_one_cr(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_bytes(b"one\r\ntwo\nthr\ree\r\r\nfour")
    got = [r["value"] for r in text_lines(spark, str(path)).collect()]
    assert got == ["one", "two", "thr\ree\r", "four"]
    path.write_bytes(b"one\r;two;three")
    assert [r["value"] for r in text_lines(spark, str(path), ";").collect()] == [
        "one", "two", "three",
    ]


def test_crlf_lines_parse(spark, tmp_path):
    path = tmp_path / "geo.txt"
    path.write_bytes(b"1,2,x,a\r\n3,4,x,b\r\n")
    rows = parse_geo_events(text_lines(spark, str(path))).collect()
    assert [tuple(r) for r in rows] == [(1, 2, "a"), (3, 4, "b")]


def test_kafka_options():
    assert kafka_options() == {
        "kafka.bootstrap.servers": "localhost:9092",
        "subscribe": "defaultTopic",
        "kafka.group.id": "defaultGroupID",
        "failOnDataLoss": "true",
    }
    assert kafka_options("t", "h:1", "g", 5)["maxOffsetsPerTrigger"] == "5"
