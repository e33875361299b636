"""Document fingerprints: consistent weighted sampling of a document's words, in DataFrame operations only.

A document is a bag of words, each weighted by how often it occurs. For each
sample and word, two gamma variables r and c and a uniform one b follow from a
hash; with t = floor(ln w / r + b), the word's value is
a = c * exp(-r * (t - b + 1)), and the sample is the (word, t) of the smallest
value. Two documents agree in a sample with the probability of their
generalised Jaccard similarity, sum of smaller weights over sum of larger
ones.

Words are separated by ASCII white space and taken as they are. Samples are
24-bit numbers; a fingerprint is their hexadecimal digits, in order.

Defined results: a document without words (also a null text) has the empty
fingerprint; it is like another one without words (1) and like nothing else
(0). Equal texts have equal fingerprints. Repeated rows (same doc_id and text)
count as one document and get the same result each; rows with the same doc_id
and different texts follow each other in an order of their texts' hashes. Rows
without doc_id come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import written
from tidemark.session import parallelism

SAMPLES = 32
NAME_BITS = 24
ROWS_PER_RANGE = 200_000
WHITE = r"[ \t\n\x0B\f\r]+"
_SCALE = 2.0**33  # values are below 23: with the name's bits they fill 62


def _uniform(bits: Column, at: int, width: int = 16) -> Column:
    """``width`` bits of a number from bit ``at`` on, as a number between 0 and 1."""
    part = F.shiftrightunsigned(bits, at) if at else bits
    return (part.bitwiseAND((1 << width) - 1) + F.lit(0.5)) * F.lit(2.0**-width)


def _sample(term: str, log_weight: str, k: int) -> Column:
    """A word's value ``a`` above and its sample in the lower ``NAME_BITS`` of a number, for sample ``k``."""
    z, y = F.xxhash64(F.col(term), F.lit(k)), F.xxhash64(F.col(term), F.lit(-1 - k))
    r = -F.log(_uniform(z, 0) * _uniform(z, 16))  # gamma variables of shape 2: sums of two exponential ones
    c = -F.log(_uniform(z, 32) * _uniform(z, 48))
    b = _uniform(y, 0, 24)
    t = F.floor(F.col(log_weight) / r + b)
    a = c * F.exp(-r * (t - b + 1))
    name = F.shiftrightunsigned(y, 24).bitwiseXOR(t * F.lit(2654435761)).bitwiseAND((1 << NAME_BITS) - 1)
    return F.shiftleft(F.floor(a * F.lit(_SCALE)), NAME_BITS).bitwiseOR(name)


def sample_names(samples: int) -> list[str]:
    return [f"s{k}" for k in range(samples)]


def signatures(words: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keys`` and one column per sample from rows of ``keys`` and ``term`` (a long), one row per occurrence."""
    weighted = words.groupBy(*keys, "term").agg(F.log(F.count("*").cast("double")).alias("log_weight"))
    return weighted.groupBy(*keys).agg(
        *[F.min(_sample("term", "log_weight", k)).bitwiseAND((1 << NAME_BITS) - 1).cast("int").alias(n) for k, n in enumerate(sample_names(samples))]
    )


def fingerprint(samples: int, name) -> Column:
    """The fingerprint of a row's samples; empty without words."""
    digits = [F.lpad(F.lower(F.hex(F.col(name(c)))), 6, "0") for c in sample_names(samples)]
    return F.coalesce(F.concat(*digits), F.lit(""))


def likeness(samples: int, a, b) -> Column:
    """The share of equal samples; documents without words have none, which are equal too."""
    same = [F.col(a(c)).eqNullSafe(F.col(b(c))).cast("int") for c in sample_names(samples)]
    return sum(same[1:], same[0]) / F.lit(float(samples))


def terms(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and ``term``, a row for every word."""
    words = docs.select(*keys, F.explode(F.split(text, WHITE)).alias("word")).where("word <> ''")
    return words.select(*keys, F.xxhash64("word").alias("term"))


KEYS = ["key_id", "tie"]


def keyed(docs: DataFrame) -> DataFrame:
    """Documents under keys that are never null: ``key_id`` (the id, or 0 without one) and ``tie`` (of the text)."""
    text, has_id = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").isNotNull()
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("key_id"),
        F.xxhash64(text, has_id).alias("tie"),
        has_id.alias("has_id"),
        text.alias("text"),
        F.char_length(text).cast("long").alias("n_chars"),
    )


def following(docs: DataFrame) -> DataFrame:
    """The keys of each document, whether it has an id, the keys of the one before it by falling doc_id (``before_id``, ``before_tie``), and a
    third of that one's characters (``need``). The first document follows the last.

    Only keys and lengths are sorted, in ranges; the ranges' ends meet through a table with a row per range.
    """
    ids = docs.groupBy(*KEYS).agg(F.max("has_id").alias("has_id"), F.max("n_chars").alias("n_chars"))
    n = max(1, -(-docs.count() // ROWS_PER_RANGE), min(parallelism(docs.sparkSession), 8))
    order = [F.desc("has_id"), F.desc("key_id"), F.desc("tie")]
    ranged = written(ids.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "ranges")
    row = F.struct(*KEYS, "n_chars")
    before = F.lag(row).over(Window.partitionBy("range").orderBy(*order))
    ends = ranged.groupBy("range").agg(F.min_by(row, F.struct("has_id", "key_id", "tie")).alias("end"))
    every = Window.orderBy("range")
    first = F.first("range").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = ends.select(F.coalesce(F.lead("range").over(every), first).alias("range"), "end")
    joined = ranged.select("*", before.alias("before")).join(ends, "range").withColumn("before", F.coalesce("before", "end"))
    before = [F.col("before.key_id").alias("before_id"), F.col("before.tie").alias("before_tie")]
    return joined.select(*KEYS, "has_id", *before, F.expr("cast(before.n_chars div 3 as int)").alias("need"))


def edited(dealt: DataFrame, follows: DataFrame, repeated: bool) -> DataFrame:
    """Keys, ``n_chars`` and ``edited_text``: the last third replaced by the next document's first characters."""
    heads = dealt.join(follows, KEYS).select(
        F.col("before_id").alias("key_id"), F.col("before_tie").alias("tie"), F.expr("left(text, need)").alias("head")
    )
    if repeated:
        heads = heads.dropDuplicates(KEYS)
    joined = dealt.join(heads, KEYS).withColumn("n_chars", F.char_length("text").cast("long"))
    text = F.expr("concat(left(text, cast(n_chars - n_chars div 3 as int)), head)")
    return joined.select(*KEYS, "n_chars", text.alias("edited_text"))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """For each row: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, and how like the
    document is to its edited text (``near_edited``) and to the next document (``near_next``).

    Texts are dealt by their keys once, in a shuffle that every branch of the plan reuses; splitting, counting and
    sampling stay in those partitions. A document's samples then travel to its own key and to that of the document
    before it.
    """
    names, documents = sample_names(samples), keyed(docs)
    follows = written(following(documents), "follows")
    repeated = follows.count() < documents.count()
    dealt = documents.select(*KEYS, "text").repartition(*KEYS)
    once = lambda df: df.dropDuplicates(KEYS) if repeated else df
    both = edited(dealt, follows, repeated)
    own = signatures(terms(once(dealt), KEYS, "text"), KEYS, samples)
    other = signatures(terms(once(both), KEYS, "edited_text"), KEYS, samples)
    places = [F.struct(F.col(k).alias("key_id"), F.col(t).alias("tie"), F.lit(role).alias("role")) for role, (k, t) in enumerate((KEYS, ("before_id", "before_tie")))]
    sent = own.join(follows, KEYS).select(F.explode(F.array(*places)).alias("to"), *names).select("to.*", *names)
    seen = [F.max(F.when(F.col("role") == role, F.col(c))).alias(f"{letter}_{c}") for role, letter in ((0, "o"), (1, "n")) for c in names]
    met = sent.groupBy(*KEYS).agg(*seen)
    facts = both.select(*KEYS, "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"))
    out = facts.join(follows.select(*KEYS, "has_id"), KEYS)
    out = out.join(other.withColumnsRenamed({c: f"e_{c}" for c in names}), KEYS, "left").join(met, KEYS, "left")
    return out.select(
        F.when(F.col("has_id"), F.col("key_id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        fingerprint(samples, "o_{}".format).alias("fingerprint"),
        fingerprint(samples, "e_{}".format).alias("edited_fingerprint"),
        likeness(samples, "o_{}".format, "e_{}".format).alias("near_edited"),
        likeness(samples, "o_{}".format, "n_{}".format).alias("near_next"),
    )
