"""Personal data: base patterns, and further candidates that boosted trees accept.

Base spans (emails, addresses, cards, phones) are found by fixed patterns and
always stay. High-recall generators then propose further, overlapping spans
(obfuscated emails, IPv6 addresses, phones without a plus sign, cards with other separators,
addresses of the longer kind). Boosted trees score each candidate by its
format and the words around it; a candidate is taken if its score reaches the
threshold of its kind, calibrated on held-out examples for a wanted precision.
Where taken candidates overlap, the likelier one stays. One that reaches beyond
a base span of its own kind may be taken beside it; one within a base span is
not proposed, nor is one that overlaps a base span of another kind: a phone's
end and an address are no card.

The trees are trained on examples made from written-down formats with a fixed
seed, so the result for a text depends on the text alone.

Defined results: a null text counts as empty and has no spans. Positions are
code points, ends exclusive. Equal texts have equal spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import map_texts, rewrite_texts
from tidemark.llm.boosting import BoostedTrees, threshold_for
from tidemark.llm.columns import carry, types_of
from tidemark.llm.spans import Spans

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.995

# Fixed patterns of the base spans.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# High-recall generators of further spans.
_GENERATORS = {
    "email": re.compile(
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\[at\]|\(at\)|\{at\}|@\x20|\x20@)\x20?[A-Za-z0-9-]{1,63}"
        r"(?:\x20?(?:\.|\[dot\]|\(dot\)|\{dot\})\x20?[A-Za-z0-9-]{1,63}){1,5}"
        r"|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\x20at\x20|\x20?(?:@|\[at\]|\(at\)|\{at\})\x20?)[A-Za-z0-9-]{1,63}"
        r"(?:\.[A-Za-z0-9-]{1,63}){0,4}(?:\x20dot\x20[A-Za-z0-9-]{1,63}){1,5}",  # words alone, if a dot is among them
        re.A | re.I,
    ),
    "ip": re.compile(
        r"(?<![0-9A-Fa-f:.])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Fa-f:])"
        r"|(?<![\w:.])(?=[0-9A-Fa-f:]*::)[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){1,7}(?![\w:])"
    ),
    "card": re.compile(r"(?<![0-9])[0-9]{4,6}(?:[\x20._/-]{1,3}[0-9]{2,6}){2,4}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:00[0-9]{1,3}[\x20.-])?\(?[0-9]{2,5}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])"),
}
_CUES = {
    "email": re.compile(r"e-?mail|contact|write|reach|address", re.A | re.I),
    "ip": re.compile(r"\bip\b|ipv6|address|host|server|client", re.A | re.I),
    "card": re.compile(r"card|visa|master|amex|credit|debit|payment|paid", re.A | re.I),
    "phone": re.compile(r"phone|\btel\b|call|fax|mobile|cell|contact|whatsapp", re.A | re.I),
}
_TLD = re.compile(r"\b(?:com|org|net|edu|gov|info|io|co|de|fr|uk|us|eu|nl|ch|it|es|pl|br|in|au|ca|jp|ru)$", re.A | re.I)
_AGAINST = re.compile(r"version|\bv\b|isbn|date|serial|order|invoice|page|ratio|score|room|part\b|no\.|sku|mac\b|hash", re.A | re.I)
CONTEXT = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping emails, found from their ``@``: linear even in a text of one long word."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The base spans of each kind."""
    found = {"email": base_emails(text) if "@" in text else [], "ip": [], "card": [], "phone": []}
    if _DIGIT.search(text):
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(_small(p) for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return found


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further spans that the generators propose, but for those that lie within a base span, or overlap one of another kind.

    ``taken`` has the base spans as (kind, start, end).
    """
    has_digit = _DIGIT.search(text) is not None
    out = []
    for kind, pattern in _GENERATORS.items():
        if kind == "email":
            low = text.lower()
            if not ("[at]" in low or "(at)" in low or "{at}" in low or "@ " in text or " @" in text or " dot " in low and (" at " in low or "@" in low)):
                continue
        elif text.count(":") < 3 and "::" not in text if kind == "ip" else not has_digit:
            continue
        out += [(kind, *m.span()) for m in pattern.finditer(text)]
    if not taken or not out:
        return out
    own, other = ({k: Spans(t[1:] for t in taken if (t[0] == k) == same) for k in KINDS} for same in (True, False))
    return [c for c in out if not own[c[0]].cover(*c[1:]) and not other[c[0]].overlap(*c[1:])]


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    digits = _digits(span)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    near = before[-1:] or " "
    return [
        float(KINDS.index(kind)),
        end - start,
        len(digits),
        float(luhn(digits)) if len(digits) >= 13 else -1.0,
        len(groups),
        max(groups, default=0),
        min(groups, default=0),
        groups[-1] if groups else 0,
        sum(c in " " for c in span),
        sum(c in ".-" for c in span),
        sum(c in "()/_" for c in span),
        sum(c in ":" for c in span),
        sum(c.isalpha() for c in span),
        float("(" in span and ")" in span),
        float(bool(re.search(r"dot|\.[A-Za-z]{2,6}$", span))),
        float(bool(_CUES[kind].search(before))),
        float(bool(_CUES[kind].search(after))),
        float(bool(_AGAINST.search(before))),
        float(near.isalnum()),
        float(near in "=:"),
        float(near in "$#%/"),
        float(after[:1] in "%:/-" and after[:1] != ""),
        float(len(set(digits))),
        float("::" in span),
        float(" at " in span.lower()),
        float(bool(_TLD.search(span))),
    ]


# Formats of training examples: 9 stands for a digit, h for a hexadecimal digit, w for a word.
_POSITIVE = {
    "email": ["w.99 [at] w.com", "w(at)w.org", "w [at] w [dot] net", "w.w {at} w {dot} com", "w99 @ w.com", "w@ w.org", "w.w at w dot com", "w99 at w dot org", "w at w dot w dot net", "w.w@w dot com"],
    "ip": ["hhhh:hhhh:hhhh:hhhh:hhhh:hhhh:hhhh:hhhh", "hhhh:hhhh::hhhh:hhhh", "hhhh:hhh:hhhh:hh::hhhh", "h999:hh9::h", "hh99::9", "h99h:hhhh:hh::hhhh"],
    "card": ["9999.9999.9999.9999", "9999 - 9999 - 9999 - 9999", "9999/9999/9999/9999", "9999_9999_9999_9999", "9999.999999.99999"],
    "phone": ["(999) 999-9999", "999-999-9999", "999.999.9999", "0999 999 9999", "0099 999 999 9999", "09999/999 999"],
}
_NEGATIVE = {
    "email": ["w @ w.9", "w (at) w.w", "99 @ 9.99", "w @ 99.99", "w at w dot w", "w at the dot w"],
    "ip": ["99:99:99:99", "9:9:9:9", "99:99:99:99:99", "hh:hh:hh:hh:hh:hh", "99::99", "9::9", "add::bad", "face::dead::be"],
    "card": ["9999-99-99", "9999.99.99", "9999-9999-99", "9999 99 99 99", "99999-9999-9999", "9999/99/99 99"],
    "phone": ["999-9999-9999", "99.999.999", "99 999 999", "999 999 999", "99-999-9999", "99/999.999"],
}
_CUE_WORDS = {
    "email": ["email", "contact", "write to"],
    "ip": ["ip", "server", "host", "client address"],
    "card": ["card", "visa", "credit card", "payment"],
    "phone": ["phone", "call", "tel", "mobile", "fax"],
}
_OTHER_WORDS = ["version", "isbn", "date", "serial", "order", "invoice", "page", "ratio", "score", "room", "no.", "sku"]
_PLAIN_WORDS = "and of was the in to as by for with und der die le la que en el los est une".split()


def _with_check_digit(text: str) -> str:
    digits = _digits(text)
    for last in "0123456789":
        if luhn(digits[:-1] + last):
            return text[:-1] + last
    return text


def examples(seed: int = 11, each: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of candidates in made-up sentences."""
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))

    def word() -> str:
        return "".join(rng.choice(letters, rng.integers(3, 9)))

    def fill(form: str) -> str:
        out = []
        for c in form:
            out.append(str(rng.integers(10)) if c == "9" else "0123456789abcdef"[rng.integers(16)] if c == "h" else word() if c == "w" else c)
        return "".join(out)

    def literal(form: str) -> str:  # keeps the words of the format itself
        return form.replace("dot", "\0").replace("net", "\1").replace("org", "\2").replace("com", "\3")

    x, y, kinds = [], [], []
    for label, forms in ((1, _POSITIVE), (0, _NEGATIVE)):
        for kind, patterns in forms.items():
            for form in patterns:
                for _ in range(each):
                    span = fill(literal(form)).replace("\0", "dot").replace("\1", "net").replace("\2", "org").replace("\3", "com")
                    if label and kind == "card":
                        span = _with_check_digit(span)
                    cue = rng.random()
                    lead = rng.choice(_CUE_WORDS[kind]) if cue < (0.8 if label else 0.1) else rng.choice(_OTHER_WORDS if cue > 0.95 or not label and cue > 0.4 else _PLAIN_WORDS)
                    before = f"{word()} {rng.choice(_PLAIN_WORDS)} {lead}{rng.choice(['', ':', ' is'])} "
                    text = f"{before}{span}{rng.choice([' ', '. ', ', '])}{word()} {rng.choice(_PLAIN_WORDS)}"
                    for k, start, end in candidates(text, []):
                        whole = k == kind and start <= len(before) + 1 and end >= len(before) + len(span) - 1
                        x.append(describe(text, k, start, end))
                        y.append(float(label and whole))
                        kinds.append(KINDS.index(k))
    return np.array(x), np.array(y), np.array(kinds)


@dataclass(frozen=True)
class PiiModel:
    trees: BoostedTrees
    thresholds: tuple[float, ...]


@lru_cache(maxsize=4)
def fit(precision: float = PRECISION) -> PiiModel:
    """Trees on one set of examples, thresholds per kind on another."""
    x, y, _ = examples(seed=11)
    trees = BoostedTrees().fit(x, y)
    x, y, kinds = examples(seed=12)
    p = trees.probability(x)
    cuts = [max(0.5, threshold_for(p[kinds == k], y[kinds == k], precision)) for k in range(len(KINDS))]
    return PiiModel(trees, tuple(cuts))


def all_spans(texts: list[str | None], model: PiiModel) -> list[tuple[list, list]]:
    """Base spans and added spans of each text, both as (kind, start, end) by kind as listed, then start."""
    base, where, x = [], [], []
    for i, text in enumerate(texts):
        text = text or ""
        spans = base_spans(text)
        base.append([(k, *s) for k in KINDS for s in spans[k]])
        for c in candidates(text, base[i]):
            where.append((i, c))
            x.append(describe(text, *c))
    picked: list[list] = [[] for _ in texts]
    if x:
        p = model.trees.probability(np.array(x))
        ranked = sorted(zip(-p, where, strict=True), key=lambda r: (r[0], r[1][1][1], -r[1][1][2], KINDS.index(r[1][1][0])))
        for minus_p, (i, (kind, start, end)) in ranked:
            # The picked spans of a text are apart and in order: only the one before and the one after can be in the way.
            at = bisect_left(picked[i], end, key=lambda s: s[1])
            if -minus_p >= model.thresholds[KINDS.index(kind)] and not (at and picked[i][at - 1][2] > start):
                picked[i].insert(at, (kind, start, end))
    for spans in picked:
        spans.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
    return list(zip(base, picked, strict=True))


SPAN = "array<struct<kind: string, start: int, end: int>>"


def find(docs: DataFrame, keep: list[str], model: PiiModel | None = None) -> DataFrame:
    """``keep`` columns (clashes: see ``columns``), ``base`` and ``added`` spans of every whole ``text``."""
    model = model or fit()
    kept, inner, back = carry(keep, ["base", "added"])
    moved = docs.select(*kept, F.col("text").alias("text_to_scan"))
    types = types_of(moved.select(*inner, F.expr(f"cast(null as {SPAN}) as base"), F.expr(f"cast(null as {SPAN}) as added")))

    def work(*columns):
        spans = all_spans(columns[-1], model)
        as_rows = [[[{"kind": k, "start": s, "end": e} for k, s, e in part] for part in pair] for pair in spans]
        return dict(zip(inner, columns, strict=False)) | {"base": [r[0] for r in as_rows], "added": [r[1] for r in as_rows]}

    return back(map_texts(moved, types, work))


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by ``<KIND>``; of overlapping spans the first, and of those the longest, counts."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
            at = end
        elif end > at:  # the rest of a span that overlaps the last one goes too
            at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: PiiModel | None = None) -> DataFrame:
    """``docs`` with all spans of ``text`` replaced; a null text stays null, and all other columns as they are."""
    model = model or fit()

    def rewrite(texts):
        spans = all_spans(texts, model)
        return [t if t is None else redact_text(t, base + added) for t, (base, added) in zip(texts, spans, strict=True)]

    return rewrite_texts(docs, rewrite)
