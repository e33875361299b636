import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm import edge_cases
from tidemark.llm import pii, secret_scan
from tidemark.llm.boosting import BoostedTrees, threshold_for
from tidemark.llm.spans import Spans


def brute_pii(text):
    """The base patterns as they are stated, by plain scans."""
    digits = lambda s: [int(c) for c in s if c in "0123456789"]

    def luhn(s):
        d = digits(s)[::-1]
        return sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0

    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(s)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    return [(k, *m.span()) for k, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m.group())]


def brute_secrets(text):
    rules = [
        ("assign", r"(?a:(?i:(password|passwd|secret|token|api_?key)))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m.group(2)) >= 12),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 18),
        ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 16),
    ]
    spans = [(m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m)]
    return [(k, s, e) for s, _, k, e in sorted(spans)]


PARTS = [
    "a.b@c.co", "x@y", "@", "a@@b.c", "é.x@mail.de", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "1..2.3.4", "4111 1111 1111 1111",
    "4111-1111-1111-1112", "41111111111111111111", "0", "+1 (017) 555-7713", "+49", "++491234567890", "+1 (((", " ", ".", "-", "é", "+", "\n",
    "007.08.9.10", "999999999999999999999999.1.1.1", "@a.b.c@d.e", "12345",
    "token = ", "Password:", "secret=\"", "API_KEY: ", "apikey='", "abc/def+ghi=jkl", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "toKen=", "ſecret=abcdefghijklmn", "toKen=abcdefghijklmn", "\"", "'", ":",
]


@pytest.mark.parametrize("seed", range(3))
def test_base_spans_equal_plain_patterns(seed):
    rng = random.Random(seed)
    for _ in range(4000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9)))
        found = pii.base_spans(text)
        assert [(k, *s) for k in pii.KINDS for s in found[k]] == brute_pii(text), repr(text)
        assert secret_scan.base_spans(text) == brute_secrets(text), repr(text)


def test_one_long_run_takes_no_quadratic_time():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1(" * 100_000, "a@" * 100_000, "1 " * 200_000):
        pii.base_spans(text)
        secret_scan.base_spans(text)


def test_added_spans_respect_base_spans_and_held_out_precision():
    model = pii.fit()
    x, y, kinds = pii.examples(seed=21)
    p = model.trees.probability(x)
    for k in range(len(pii.KINDS)):
        taken = p[kinds == k] >= model.thresholds[k]
        assert y[kinds == k][taken].mean() > 0.97 and taken[y[kinds == k] == 1].mean() > 0.9
    text = "call (415) 555-0134 or write to foo [at] bar [dot] com, not 2024-01-02 or version 10.20.30; a.b@c.co"
    (base, added), = pii.all_spans([text], model)
    assert base == [("email", *re.search(r"a\.b@c\.co", text).span())]
    assert {text[s:e] for _, s, e in added} == {"(415) 555-0134", "foo [at] bar [dot] com"}


def test_redaction():
    assert pii.redact_text("ab 12 cd", [("card", 3, 5)]) == "ab <CARD> cd"
    assert pii.redact_text("0123456789", [("ip", 2, 5), ("card", 4, 8)]) == "01<IP>89"
    assert pii.redact_text("x", []) == "x"


def test_find_and_redact_over_edge_cases(spark):
    docs = edge_cases.documents(spark).union(spark.createDataFrame([(5000, "mail é x.y@z.org now", None, None, 3, None, None, 2)], edge_cases.SCHEMA))
    rows = docs.collect()
    got = pii.find(docs, ["doc_id", "text", "label"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [tuple(s) for s in r["base"]] == brute_pii(r["text"] or "")
    out = pii.redact(docs)
    assert out.schema == docs.schema
    texts = sorted((r["doc_id"] or -1, r["text"] or "", r["text"] is None) for r in out.collect())
    want = sorted((r["doc_id"] or -1, (r["text"] or "").replace("x.y@z.org", "<EMAIL>"), r["text"] is None) for r in rows)
    assert texts == want
    assert pii.find(edge_cases.empty(spark), ["doc_id"]).collect() == []


def secret_documents(spark):
    rng = random.Random(3)
    words = ["deploy", "server", "value", "update", "configuration", "internationalisation", "request", "handler", "connection"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(120)]
    key = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(40))
    rows.append((900, f"the key {key} and connectionHandlerConfigurationUpdate token: '0123456789abcdef01'"))
    return spark.createDataFrame(rows, "doc_id long, text string"), key


def test_random_strings_are_told_from_identifiers(spark):
    docs, key = secret_documents(spark)
    model = secret_scan.fit(docs)
    got = {r["doc_id"]: r for r in secret_scan.find(docs, ["doc_id", "text"], model).collect()}
    text = got[900]["text"]
    assert [text[s["start"] : s["end"]] for s in got[900]["added"]] == [key]
    assert [tuple(s) for s in got[900]["base"]] == brute_secrets(text)
    assert not any(r["added"] for i, r in got.items() if i != 900)


def test_secrets_over_edge_cases(spark):
    docs = edge_cases.documents(spark)
    got = secret_scan.find(docs, ["doc_id", "text", "batch"], secret_scan.fit(docs)).collect()
    assert len(got) == docs.count()
    assert all([tuple(s) for s in r["base"]] == brute_secrets(r["text"] or "") for r in got)
    nothing = edge_cases.empty(spark)
    assert secret_scan.find(nothing, ["doc_id"], secret_scan.fit(nothing)).collect() == []


def test_boosted_trees_learn_and_thresholds_hold():
    rng = np.random.default_rng(1)
    x = rng.random((600, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    p = BoostedTrees().fit(x[:400], y[:400]).probability(x[400:])
    assert ((p > 0.5) == (y[400:] == 1)).mean() > 0.95
    cut = threshold_for(p, y[400:], 0.99)
    assert y[400:][p >= cut].mean() >= 0.99
    assert threshold_for(p, np.zeros(200), 0.5) == 2.0 and threshold_for(np.empty(0), np.empty(0), 0.9) == 2.0


def test_planted_short_ipv6_and_emails_in_words_are_found():
    model = pii.fit()
    planted = ["2001:db8::1", "fe80::1", "jane.doe at example dot com", "bob42 at mail dot example dot org", "jane.doe@example dot com"]
    for span in planted:
        lead = "the server" if ":" in span else "contact"
        text = f"see {lead} {span} and more"
        (base, added), = pii.all_spans([text], model)
        assert [text[s:e] for _, s, e in added] == [span]
        assert span not in pii.redact_text(text, base + added)
    text = "look at the dot on the page, std::add and face::dead, 12::30"
    assert pii.all_spans([text], model) == [([], [])]


def test_candidates_may_reach_beyond_a_base_span():
    text = "contact jane@mail.example dot com now"
    base = [("email", *s) for s in pii.base_spans(text)["email"]]
    assert [text[s:e] for _, s, e in base] == ["jane@mail.example"]
    assert [text[s:e] for _, s, e in pii.candidates(text, base)] == ["jane@mail.example dot com"]
    assert pii.candidates("4111 1111 1111 1111", [("card", 0, 19)]) == []


def test_candidates_over_base_spans_of_another_kind_are_dropped():
    text = "reach +1 (555) 201 4081 190.137.223.204 soon"
    (base, added), = pii.all_spans([text], pii.fit())
    assert [k for k, _, _ in base] == ["ip"] and [text[s:e] for _, s, e in added] == ["(555) 201 4081"]
    taken = [("ip", 5, 9), ("ip", 0, 4), ("phone", 20, 30)]
    for start in range(32):
        for end in range(start + 1, 33):
            spans = Spans(t[1:] for t in taken)
            assert spans.overlap(start, end) == any(start < e and s < end for _, s, e in taken)
            assert spans.cover(start, end) == any(s <= start and end <= e for _, s, e in taken)


def test_many_spans_take_no_quadratic_time():
    model, secrets = pii.fit(), secret_scan.SecretModel(np.zeros((68 * 68, 67)), 1.0)
    (base, added), = pii.all_spans(["a.b@c.co (415) 555-0134, " * 20_000], model)
    assert len(base) == 20_000 and len(added) == 20_000
    text = "token=abcdefghijkl abcdefghijklmnopqrst " * 50_000
    assert len(secret_scan.runs(text, secret_scan.base_spans(text))) == 50_000
    secret_scan._labelled("-" * 300_000 + " token=" + "a." * 200_000)
    assert secrets.scores(["abcdefghijkl" * 100_000]).shape == (1,)


def plain_counts(strings):
    """(Two before, character) of key-like runs, by a plain loop."""
    counts = Counter()
    for text in strings:
        for run in re.findall(r"[A-Za-z0-9+/_=-]+", text):
            padded = [67, 67, *(secret_scan.ALPHABET.index(c) for c in run)]
            counts.update(zip(padded, padded[1:], padded[2:], strict=False))
    return counts


def test_models_count_all_documents(spark):
    docs, _ = secret_documents(spark)
    texts = [r["text"] for r in docs.collect()]
    seen = [t for t in texts if not secret_scan._held_out(t)]
    assert 0 < len(seen) < len(texts)
    plain, joined, values = [], [], []
    for text in seen:
        data, found = secret_scan._labelled(text)
        plain.append(data.decode())
        joined.append(secret_scan._joined(" ".join(re.findall("[A-Za-z]{3,}", plain[-1])), secret_scan._style(text)))
        values += found
    for got, want in zip(secret_scan._counts(docs.repartition(5)), (plain_counts(plain + joined), plain_counts(values)), strict=True):
        at = np.argwhere(got)
        assert {(c // 68, c % 68, x): got[c, x] for c, x in at.tolist()} == want
    assert secret_scan._labelled("é v2 abc123def456ghi x token = 'abcdefghijklm' international") == (
        b"? v2" + b" " * 17 + b"x" + b" " * 23 + b" international".replace(b" i", b"' i"), ["abcdefghijklm"])


def test_keys_from_twelve_characters_are_found_and_ordinary_runs_left(spark):
    rng = random.Random(8)
    words = ["deploy", "server", "value", "update", "configuration", "internationalisation", "request", "handler", "connection", "responsibilities"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(80)) + f" room {i} since 20{i % 90 + 10} and utf8") for i in range(300)]
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    keys = {1000 + n: "".join(rng.choice(letters) for _ in range(n)) for n in range(12, 20) for _ in (0,)}
    rows += [(i, f"use the key {key} here") for i, key in keys.items()]
    # A random string without a digit in an ordinary place must not move the threshold.
    rows += [(2000, "deploy QzXvKwJqPfGhTbNcLmRd server")]
    ordinary = ["connectionHandlerUpdate", "server-configuration-value", "REQUEST_HANDLER_VALUE", "request/handler/update", "internationalisation"]
    rows += [(3000 + i, f"see {o} there") for i, o in enumerate(ordinary)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = secret_scan.fit(docs)
    got = {r["doc_id"]: [r["text"][s["start"] : s["end"]] for s in r["added"]] for r in secret_scan.find(docs, ["doc_id", "text"], model).collect()}
    assert model.threshold < 40
    assert [i for i in keys if got[i] != [keys[i]]] == []
    assert [i for i, found in got.items() if found and i not in keys and i != 2000] == []
