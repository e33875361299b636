"""Column functions: text, numbers and time."""

from tidemark.functions.numbers import divisible_by, strict_long, to_double, to_long
from tidemark.functions.text import append_text, lowercase, number_after, prefix_text, without_cr
from tidemark.functions.time import epoch_ms, from_epoch_ms, latency_ms, now_or

__all__ = [
    "append_text", "divisible_by", "epoch_ms", "from_epoch_ms", "latency_ms", "lowercase",
    "now_or", "number_after", "prefix_text", "strict_long", "to_double", "to_long", "without_cr",
]
