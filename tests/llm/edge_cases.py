"""Small tables with the cases every operator must handle."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, batch int"


def rows(seed=1, n=40):
    """Nulls in any column, empty, blank and very long texts, exact and near copies, repeated rows, shared passages."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "su", "te", "vé") for b in ("", "ra", "ne", "ti", "zß")]
    make = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = make(45)
    texts = [make(rng.randint(1, 120)) for _ in range(n)]
    texts += [None, "", " \t\n", "one", "One two", "one TWO", texts[0], texts[1].upper(), texts[2] + " more"]
    texts += [f"{make(12)} {passage} {make(9)}", f"{make(3)}\n{passage}", passage, make(4000) + " " + passage]
    texts += [make(80)] * 3
    base = make(150).split()
    for i in range(6):
        copy = list(base)
        copy[i * 7] = "changed"
        texts.append(" ".join(copy))
    out = [(i * 3 % 97 + 100 * i, t, None if i % 5 == 0 else "en", None, len(t or ""), None, "x", 1) for i, t in enumerate(texts)]
    out.append(out[4])  # a repeated row
    out.append((None, texts[5], None, None, None, 1.0, None, None))
    out.append((None, None, None, None, None, None, None, None))
    return out


def documents(spark, seed=1):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
