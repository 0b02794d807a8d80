"""Conversation repair against plain versions: all edits tried, a table of best prefixes, and a whole table by hand-written Python."""

import hashlib
import itertools
import re
import zlib

from hypothesis import given, settings, strategies as st

from tomelight.llm import conversation_repair as cr
from tomelight.llm.queries import op12_conversation_repair

SF = "/root/testdata/sf0.001"
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
LEGAL = re.compile("(s?(ua)+)?")
KIND = "conv_id long, turn long, role string, text string"


def tried(rows, inserts=4):
    """rows: (initial, must go, truncated). Every audit with up to some insertions, by trying all of them."""
    best = None
    for letters in itertools.product("KRD", repeat=len(rows)):
        if any(must and x != "D" for x, (_, must, _) in zip(letters, rows, strict=True)):
            continue
        for gaps in itertools.product(range(inserts + 1), repeat=len(rows) + 1):
            if sum(gaps) > inserts:
                continue
            audit = "".join("I" * g + x for g, x in itertools.zip_longest(gaps, letters, fillvalue=""))
            written, k = [], 0  # sets of initials that may stand at each place
            for x in audit:
                if x == "I":
                    written.append("ua")
                    continue
                written += [] if x == "D" else [rows[k][0] if x == "K" else "ua"]
                k += 1
            if any(LEGAL.fullmatch("".join(w)) for w in itertools.product(*written)):
                cost = sum({"K": 0, "R": 3, "D": 4}[x] + (3 if t and x != "D" else 0) for x, (_, _, t) in zip(letters, rows, strict=True)) + 3 * sum(gaps)
                best = min(best or (cost, audit), (cost, audit))
    return best


def prefixes(rows):
    """The same by the least (cost, audit) of each prefix of the rows and last role."""
    turn = {"": "u", "s": "u", "a": "u", "u": "a"}
    def inserted(best):
        for _ in range(3):
            for state, (cost, audit) in list(best.items()):
                new = cost + 3, audit + "I"
                best[turn[state]] = min(best.get(turn[state], new), new)
        return best

    best = inserted({"": (0, "")})
    for initial, must, truncated in rows:
        after = {}
        for state, (cost, audit) in best.items():
            options = [(state, 4, "D")]
            if not must:
                options.append((turn[state], 6 if truncated else 3, "R"))
                if initial == turn[state] or initial == "s" and state == "":
                    options.append((initial, 3 if truncated else 0, "K"))
            for to, more, letter in options:
                new = cost + more, audit + letter
                after[to] = min(after.get(to, new), new)
        best = inserted(after)
    return min(best[s] for s in ("", "a") if s in best)


def coded(rows):
    return bytes({"s": 1, "u": 2, "a": 3}.get(i, 0) | (4 if m else 8 if t else 0) for i, m, t in rows)


ROW = st.tuples(st.sampled_from("suax"), st.booleans(), st.booleans()).map(lambda r: (r[0], r[1], r[2] and not r[1]))


@settings(max_examples=60, deadline=None)
@given(st.lists(ROW, max_size=3))
def test_cheapest_against_all_edits(rows):
    assert cr.cheapest(coded(rows)) == tried(rows) == prefixes(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(ROW, max_size=60))
def test_cheapest_against_prefixes(rows):
    assert cr.cheapest(coded(rows)) == prefixes(rows)


def plain(table):
    """Per conv_id the whole result, from rows (conv_id, turn, role, text)."""
    show = lambda x: " " if x is None else str(x)
    after = {c: [] for c, *_ in table}
    for conv, turn, role, text in table:
        case, role, text = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20, show(role), show(text)
        role, text = "user" if case == 4 else role, "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        after[conv] += [] if case == 0 else [(turn, role, text)] * (2 if case == 3 else 1)
    out = []
    for conv, rows in after.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, faults, count = set(), [], [0, 0, 0]
        for _, role, text in rows:
            bare = text.strip(WHITE)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else 3
            seen.add((role, text))
            faults.append(fault)
            if fault < 3:
                count[fault] += 1
        turns = {t for t, _, _ in rows if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit = prefixes([(r[1][:1], f < 2, f == 2) for r, f in zip(rows, faults, strict=True)])
        written, left = [], iter(rows)
        for x in audit:
            turn = "assistant" if written and written[-1][0][0] == "u" else "user"
            if x == "I":
                written.append((turn, ""))
            else:
                _, role, text = next(left)
                written += [] if x == "D" else [(role if x == "K" else turn, text)]
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in written).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count, illegal, cost, audit, sha))
    return sorted(out, key=str)


def result(df):
    assert df.columns == ["conv_id", *cr.STATS, "audit", "repaired_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


def run(spark, table):
    df = spark.createDataFrame(table, KIND) if isinstance(table, list) else table
    return result(cr.conversation_repair(cr.damage(df), df.selectExpr("conv_id as conv")).withColumnRenamed("conv", "conv_id"))


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(op12_conversation_repair(spark, SF)) == plain(rows)


def test_edges(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "a."), (None, 1, "user", "a."), (1, None, "user", "b"), (1, None, "assistant", "c."), (1, -5, "system", " \t\n"),
        (2, 10, "bot", "hm?\n "), (2, 12, "", "x!"), (2, 10, "assistant", "y."), (2, 40, "user", "hm?\n "), (3, 2**40, "assistant", None), (4, 3, "user", "z." * 400_000), (4, 4, "assistant", "é" * 1000 + "!"),
    ]
    rows += [(k, t, r, f"t{t}.") for k in range(10, 60) for t, r in enumerate(("system", "user", "user", "assistant", "assistant", "user"))]
    rows += [(7, t, ("user", "assistant")[t % 3 == 0], f"same {t % 50}.") for t in range(3000)]  # one long conversation with repeats
    assert run(spark, rows) == plain(rows)
    more = spark.createDataFrame([(*r, "x", 1) for r in rows], KIND + ", audit string, conv int").repartition(7)  # names that it makes itself
    assert run(spark, more) == plain(rows)
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "a.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert run(spark, []) == []


def test_repaired_rows(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = cr.damage(df)
    plans = cr.plan_repairs(rows, df.selectExpr("conv_id as conv").distinct())
    texts = {}
    for r in cr.repaired(rows, plans).orderBy("conv", "place").collect():
        texts.setdefault(r.conv, []).append((r.place, f"{r.role}:{r.text}"))
    assert all([p for p, _ in own] == list(range(len(own))) for own in texts.values())
    for r in cr.repair_digests(rows, plans).collect():
        own = [t for _, t in texts.get(r.conv, [])]
        assert hashlib.sha256("\n".join(own).encode()).hexdigest() == r.repaired_sha256
        assert LEGAL.fullmatch("".join(t[0] for t in own))
