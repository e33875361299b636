import hashlib
import itertools
import random
import re
import zlib

import pytest

from tidemark.llm import queries_repair, repair

SOUND = re.compile("(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        ink = re.findall("[^\x20\x09-\x0d]", text)
        out.append("blank" if not ink else "duplicate" if (role, text) in seen else "" if ink[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(initials, faults):
    """Least (cost, audit, rows) by plain search from the end over (row, what the result ended with)."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    n = len(initials)
    best = {(n, s): (0, "", []) if s in ("", "a") else (10**6, "~", []) for s in after}

    def relax(i):
        for _ in range(4):
            for s in after:
                for c in after[s].replace("s", ""):
                    cost, audit, rows = best[i, c]
                    best[i, s] = min(best[i, s], (cost + 3, "I" + audit, [("I", c, None), *rows]), key=lambda b: b[:2])

    relax(n)
    for i in range(n - 1, -1, -1):
        for s in after:
            ways = [(best[i + 1, s][0] + 4, "D" + best[i + 1, s][1], best[i + 1, s][2])]
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                for c in after[s]:
                    cost, audit, rows = best[i + 1, c]
                    if c == initials[i]:
                        ways.append((cost + more, "K" + audit, [("K", c, i), *rows]))
                    if c != "s":
                        ways.append((cost + more + 3, "R" + audit, [("R", c, i), *rows]))
            best[i, s] = min(ways, key=lambda b: b[:2])
        relax(i)
    return best[0, ""]


def brute(rows):
    conversations = {}
    for conv, *_ in rows:
        conversations.setdefault(conv, [])
    for conv, turn, role, text in damaged(rows):
        conversations[conv].append((turn, role, text))
    out = {}
    for conv, turns in conversations.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, initials = faults_of(turns), "".join(r[1][:1] or "?" for r in turns)
        cost, audit, edits = cheapest(initials, faults)
        numbers = {t for t, _, _ in turns if t is not None}
        lines = ["%s:%s" % (turns[i][1] if e == "K" else {"u": "user", "a": "assistant"}[c], "" if e == "I" else turns[i][2]) for e, c, i in edits]
        assert SOUND.fullmatch("".join(x[0] for x in lines))
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
            *(faults.count(f) for f in repair.FAULTS[1:]),
            sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1)),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    out = []
    for conv in [None, *range(conversations)]:
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"] * 6 + ["system", "tool", "", None, "User"]) if rng.random() < 0.5 else ["user", "assistant"][turn % 2]
            text = rng.choice(["Yes.", "no", "What?", f"Text {turn}.", f"Text {turn}. \n", f"cut {turn}", "  \t", "", None, "é!", "x" * 300 + "."])
            out.append((conv, rng.choice([turn] * 8 + [None, turn - 1, turn + 5]), role, text, "extra"))
    return out + rng.sample(out, len(out) // 20)


@pytest.mark.parametrize(("segment", "longest"), [(repair.SEGMENT, 14), (3, 14), (1, 8), (7, 60)])
def test_equals_brute_force(spark, segment, longest):
    rows = random_rows(segment, 90, longest)
    # Extra columns named as the operator's own ones are.
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, seg string, seq int").repartition(3)
    got = queries_repair.repair_report(table, segment).collect()
    want = brute([r[:4] for r in rows])
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == want[r["conv_id"]], r["conv_id"]


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    got = queries_repair.op11_conversation_repair(spark, sf_dir).collect()
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got} == brute(rows)


def test_least_of_all_edits():
    """Every sequence of edits of short conversations is tried."""
    for n in range(4):
        for code in itertools.product("sua?", repeat=n):
            for faults in itertools.product((0, 1, 3), repeat=n):
                letters = "".join(map(repair.letter, code, faults))
                found = None
                for edits in _all_edits(code, faults):
                    found = edits if found is None else min(found, edits)
                rows, state = repair.unroll(letters, repair.END, 0) if letters else ([], 0)
                audit = "".join("I" * len(p) + e for p, e, _ in rows) + "I" * len(repair.at_the_end(state))
                assert audit == found[1], (code, faults)


def _all_edits(code, faults):
    def put(initials, audit, cost):
        yield initials, audit, cost
        for k in (1, 2):
            for more in itertools.product("ua", repeat=k):
                yield initials + "".join(more), audit + "I" * k, cost + 3 * k

    found = list(put("", "", 0))
    for c, f in zip(code, faults, strict=True):
        nxt = []
        for initials, audit, cost in found:
            nxt += put(initials, audit + "D", cost + 4)
            if f != 1:
                more = 3 if f == 3 else 0
                nxt += put(initials + c, audit + "K", cost + more)
                for role in "ua":
                    nxt += put(initials + role, audit + "R", cost + 3 + more)
        found = [x for x in set(nxt) if re.fullmatch("s?(ua)*u?", x[0])]
    yield from ((cost, audit) for initials, audit, cost in found if SOUND.fullmatch(initials))


def test_powers_equal_steps():
    for symbol in map(repair.letter, "sua?", (0, 3, 1, 0)):
        costs = repair.np.array(repair.END, repair.np.int64)
        for length in range(1, 70):
            costs = repair.times(repair.transition(symbol), costs)
            assert (repair.through(symbol, length, repair.np.array(repair.END, repair.np.int64)) == costs).all()


def test_one_long_conversation(spark):
    """A conversation over many segments, with runs of thousands of equal symbols."""
    rows = [(1, i, "user" if i < 6000 else ("assistant" if i < 9000 else "system"), f"Row {i}.") for i in range(10_000)]
    rows += [(2, 0, "user", "Hello."), (2, 1, "assistant", "Yes.")]
    got = queries_repair.repair_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 900).collect()
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got} == brute(rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert queries_repair.repair_report(empty).collect() == []
