"""Where results go: text and CSV files, the console, stores of latest rows, and verdicts on lines."""

from tidemark.sinks.files import write_csv, write_parquet, write_text
from tidemark.sinks.latest import compact_latest, read_latest, upsert_latest
from tidemark.sinks.panes import read_panes, store_panes
from tidemark.sinks.show import print_rows
from tidemark.sinks.verdicts import good_lines, read_verdicts, write_verdicts

__all__ = [
    "compact_latest", "good_lines", "print_rows", "read_latest", "read_panes", "read_verdicts", "store_panes", "upsert_latest",
    "write_csv", "write_parquet", "write_text", "write_verdicts",
]
