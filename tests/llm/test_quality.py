import random

from tests.llm import edge_cases
from tidemark.llm import quality

WORDS = [a + b for a in ("the", "on", "er", "tion", "ing", "an") for b in ("", "th", "re", "st", "ha", "es", "ed")]


def labelled(spark, n=600, seed=2):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(20, 120))]
        good = rng.random() < 0.7
        docs.append((i, " ".join(words) + "." if good else "!! ".join(w.upper() for w in words)))
        labels.append((i, int(good)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


def test_held_out_accuracy(spark):
    docs, labels, truth = labelled(spark)
    training = quality.training_labels(labels)
    model = quality.fit(docs, training)
    seen = {r["doc_id"] for r in training.collect()}
    scored = {r["doc_id"]: r["score"] for r in quality.score(docs, model, ["doc_id"]).collect()}
    held = [i for i in truth if i not in seen]
    assert len(held) > 150 and all(0 <= s <= 1 for s in scored.values())
    assert sum((scored[i] >= 0.5) == truth[i] for i in held) / len(held) > 0.97
    assert quality.fit(docs, training) == model


def test_training_labels_leave_one_third_out(spark):
    import zlib

    rows = [(i, i % 2) for i in range(300)] + [(3, 0), (None, 1), (5, None), (6, 7)]
    got = {r["doc_id"]: r["quality"] for r in quality.training_labels(spark.createDataFrame(rows, "doc_id long, quality int")).collect()}
    assert set(got) == {i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1}
    if 3 in got:
        assert got[3] == 0


def test_edge_cases_and_missing_classes(spark):
    docs = edge_cases.documents(spark)
    one_class = spark.createDataFrame([(r[0], 1) for r in edge_cases.rows()[:20]], "doc_id long, quality int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, one_class), ["doc_id"]).collect()} == {1.0}
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, none), ["doc_id"]).collect()} == {0.5}
    train, labels, _ = labelled(spark)
    model = quality.fit(train, labels)
    got = quality.score(docs, model, ["doc_id", "text", "label"]).collect()  # docs have a score column of their own
    by_text = {}
    for r in got:
        by_text.setdefault(r["text"] or "", set()).add(r["score"])
    assert all(len(s) == 1 for s in by_text.values()) and len(got) == docs.count()
    kept = quality.keep_good(docs, model)
    assert kept.schema == docs.schema
    assert kept.count() == sum(r["score"] >= 0.5 for r in got)
    assert quality.score(edge_cases.empty(spark), model, ["doc_id"]).collect() == []


def test_whole_texts_are_learned_from(spark):
    """Labelled texts that differ only far behind their beginning are told apart."""
    docs, labels, truth = labelled(spark, 400, seed=5)
    rng = random.Random(6)
    front = " ".join(str(rng.randint(0, 10**6)) for _ in range(800))  # longer than a block
    rows = [(r["doc_id"], f"{front} {r['text']} {r['text']}") for r in docs.collect()]
    long = spark.createDataFrame(rows, "doc_id long, text string")
    training = quality.training_labels(labels)
    scored = {r["doc_id"]: r["score"] for r in quality.score(long, quality.fit(long, training), ["doc_id"]).collect()}
    seen = {r["doc_id"] for r in training.collect()}
    held = [i for i in truth if i not in seen]
    assert sum((scored[i] >= 0.5) == truth[i] for i in held) / len(held) > 0.95
