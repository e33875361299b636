import random

from tests.llm import edge_cases
from tidemark.llm import licenses


def brute(text, templates, percent):
    """Every line and the whole text against every template."""
    found, lines = [], licenses.normalised(text or "").split(b"\n")
    units = [*enumerate(lines), *([(-1, b" ".join(lines))] if len(lines) > 1 else [])]
    for number, unit in units:
        a = licenses.bigrams(unit)
        for name, body in templates.items():
            b = licenses.bigrams(licenses.normalised(body).replace(b"\n", b" "))
            if a and b and 200 * len(a & b) >= percent * (len(a) + len(b)):
                found.append((2 * len(a & b) / (len(a) + len(b)), number, name))
    return sorted(found)


def test_pruned_scan_equals_all_comparisons():
    rng = random.Random(7)
    bodies = list(licenses.TEMPLATES.values())
    texts = [None, "", "\n\n", "MIT"]
    for _ in range(400):
        lines = []
        for _ in range(rng.randint(1, 5)):
            words = rng.choice(bodies).split()
            if rng.random() < 0.5:
                for _ in range(rng.randint(0, 3)):
                    words[rng.randrange(len(words))] = rng.choice(["und", "THE", "license", "é", "--"])
            lines.append(" ".join(words) if rng.random() < 0.8 else "\n".join(words[:4]))
        texts.append("\n".join(lines))
    for percent in (60, 80, 100):
        got = licenses.Matcher(licenses.TEMPLATES, percent).scan(texts)
        assert [sorted(g) for g in got] == [brute(t, licenses.TEMPLATES, percent) for t in texts]


def test_tables_and_own_templates(spark):
    docs = edge_cases.documents(spark)
    own = {"b": "one", "a": "One two", "empty": " "}
    got = {r["text"]: r for r in licenses.scan(docs, ["text", "label"], own).collect()}
    assert (got["one"]["license"], got["one"]["dice"], got["one"]["line"], got["one"]["n_matches"]) == ("b", 1.0, 0, 1)
    assert got["one TWO"]["license"] == "a" and got[None]["license"] is None and got[""]["line"] == -1
    assert licenses.scan(edge_cases.empty(spark), ["doc_id"]).collect() == []


def test_ties_go_to_the_first_line_and_name(spark):
    rows = spark.createDataFrame([(1, "x y\nAll rights reserved.\nall RIGHTS reserved")], "doc_id long, text string")
    (r,) = licenses.scan(rows, ["doc_id"], {"p": "All rights reserved", "o": "all rights reserved!"}).collect()
    assert (r["license"], r["line"], r["licenses"], r["n_matches"]) == ("o", 1, ["o", "p"], 4)
