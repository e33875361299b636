"""Where rows come from: tables, text lines, message topics, number intervals."""

from tidemark.sources.lines import kafka_lines, kafka_options, text_lines
from tidemark.sources.parse import (
    parse_ad_events,
    parse_auctions,
    parse_geo_events,
    parse_persons,
    parse_timestamped_numbers,
)
from tidemark.sources.sequence import interval_sequence, interval_sequence_stream, run_to_end
from tidemark.sources.tables import read_table, stream_table

__all__ = [
    "interval_sequence", "interval_sequence_stream", "run_to_end", "kafka_lines", "kafka_options",
    "parse_ad_events", "parse_auctions", "parse_geo_events", "parse_persons",
    "parse_timestamped_numbers", "read_table", "stream_table", "text_lines",
]
