"""Conversation repair, the prefix trie and quality rules against brute force, on small tables."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import reduce

import pytest
from pyspark.sql import functions as F

from strataform.llm import prefix_trie, quality, repair

TURNS = "conv_id long, turn long, role string, text string, rows string, at string, signature string"


def talks(seed=3, n=60):
    r = random.Random(seed)
    texts = ["Hello.", "Well", "", " \t", "So?", "no end \n", "Hello.", "x" * 900_000 + "!", None]
    rows = []
    for c in range(-7, n):
        if c % 11 == 5:
            continue
        for t in range(r.randrange(0, 9)):
            rows.append((c, r.choice([t, t, t, None, 3]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice(texts[:7] + texts[8:])))
    rows += [(None, 0, "user", "Null."), (None, 1, "assistant", "Yes."), (900, 0, "user", texts[7]), (900, 1, "assistant", "Ok."), (901, None, None, None)]
    rows += [(700 + i, t, ("user", "assistant")[t % 2], f"Common {t}.") for i in range(40) for t in range(4)]  # one signature, one path
    rows += [(800, t, ("user", "assistant")[t % 2], f"Long {t}.") for t in range(700)]
    return [(*x, "a", "b", "c") for x in rows]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(talks(), TURNS).repartition(3)


def ordered(rows, null=" "):
    found = defaultdict(list)
    for c, t, role, text, *_ in rows:
        found[c].append((t, null if role is None else role, null if text is None else text))
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, x in found.items()}


# ---- repair


def cheapest(signature):
    """By cost and audit, over all edits: uniform-cost search."""
    heap, seen = [(0, "", 0, "", "")], set()
    while heap:
        cost, audit, i, roles, edits = heapq.heappop(heap)
        if i == len(signature) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, edits
        if (i, roles, audit) in seen or not re.fullmatch("s?(ua)*u?", roles):
            continue
        seen.add((i, roles, audit))
        if audit[-3:] != "III":
            for c in "ua":
                heapq.heappush(heap, (cost + 5, audit + "I", i, roles + c, edits + c))
        if i < len(signature):
            x = signature[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles, edits + "D"))
            if x != "-":
                more = 5 * x.isupper()
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + x.lower(), edits + "K"))
                for c in "ua":
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, roles + c, edits + c.upper()))


def test_solver_finds_the_cheapest_least_audit():
    r = random.Random(5)
    for n in range(7):
        for _ in range(40 if n else 1):
            s = "".join(r.choice("suaoSUAO--uaua") for _ in range(n))
            cost, edits = repair.solve(s)
            want = cheapest(s)
            assert (cost, edits.translate(str.maketrans("UAua", "RRII"))) == want[:2], s
            assert edits == want[2], s
    cost, edits = repair.solve("ua" * 100_000)  # deep, without deep recursion
    assert cost == 0 and edits == "K" * 200_000


def test_repair_follows_brute_force(turns):
    got = {r["conv_id"]: r for r in repair.repair(turns).collect()}
    want = ordered(talks())
    assert set(got) == set(want)
    for c, rows in want.items():
        seen, sign, faults = set(), "", Counter()
        for _, role, text in rows:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            sign += "-" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        cost, edits = repair.solve(sign)
        out, i = [], 0
        for e in edits:
            if e in "ua":
                out.append(({"u": "user", "a": "assistant"}[e], ""))
            else:
                out += [({"U": "user", "A": "assistant"}.get(e, rows[i][1]), rows[i][2])] * (e != "D")
                i += 1
        at = [t for t, *_ in rows if t is not None]
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        r = got[c]
        assert [tuple(x) for x in r["repaired"]] == out
        assert (r["signature"], r["cost"], r["blank"], r["duplicate"], r["truncated"], r["illegal"]) == (sign, cost, faults["blank"], faults["duplicate"], faults["truncated"], illegal)
        assert r["gaps"] == (max(at) - min(at) + 1 - len(set(at)) if at else 0)
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0][0] for x in out))


def test_repair_of_nothing(spark, turns):
    assert repair.repair(turns.where("false")).collect() == []
    gone = repair.repair(turns.where("conv_id = 700"), F.lit(False)).first()
    assert (gone["cost"], gone["audit"], gone["repaired"], gone["gaps"], gone["illegal"]) == (0, "", [], 0, 0)
    again = turns.union(turns).where("conv_id = 700")  # every row repeated
    r = repair.repair(again).first()
    assert (r["duplicate"], r["cost"], r["audit"]) == (4, 8, "KDKDKDKD")


# ---- prefix trie


def nodes_of(talks):
    """{path: node} by plain recursion over tuples of turns; talks: {conv_id: [(role, text)]}."""
    members = defaultdict(list)
    for c, t in talks.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    below = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        below[p] = sum(below[k][0] for k in kids[p]) or 1, own + sum(below[k][1] for k in kids[p])
    least = {p: min((c for c in m if c is not None), default=None) for p, m in members.items()}
    ends = {p: ",".join(str(c) for c in sorted(c for c in m if c is not None and len(talks[c]) == len(p))) for p, m in members.items()}
    return Counter((least[p], len(p), least[p[:-1]] if p else None, len(m), len(kids[p]), *below[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items())


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())
    return {c: [(r[1], r[2]) for r in sorted(x, key=key)] for c, x in ordered(rows, "").items()}


@pytest.mark.parametrize("few", [50_000, 0])  # without and with hubs
def test_trie_follows_brute_force(turns, few, monkeypatch):
    monkeypatch.setattr(prefix_trie, "FEW", few)
    monkeypatch.setattr(prefix_trie, "HUBS", 100)
    got = Counter(tuple(r) for r in prefix_trie.prefix_trie(turns).select(*COLUMNS).collect())
    assert got == nodes_of(plain(talks()))


def test_spliced_trie_follows_brute_force(turns):
    own = plain(talks())  # c - c % 5 rounds towards zero
    built = {}
    for c, t in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 9
        built[c] = t if c is None else own.get(int(c / 5) * 5, [])[:h] + t[h:]
    got = Counter(tuple(r) for r in prefix_trie.trie(prefix_trie.spliced(turns, 5, 8)).select(*COLUMNS).collect())
    assert got == nodes_of(built)
    assert prefix_trie.trie(prefix_trie.spliced(turns.where("false"), 5, 8)).collect() == []


# ---- quality rules

TEXTS = [None, "", " \n\t", "one two three", "a b c " * 30, "Some words here and there. " * 20, "# * $ word\n" * 40, "SHOUT LOUD NOW\n" * 5 + "quiet words go on " * 20, "same line here\n" * 9 + "other", "a a a a", "a b a b a b", "- item one\n* item two\n" * 30]
TEXTS += [" ".join(random.Random(i).choice(["ka", "lo", "mi", "ne", "12", "|"]) for _ in range(i * 9 % 170)) + "\n\nlast..." for i in range(40)] + ["long " * 200_000 + "end" * 9]


def measured(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i, g in enumerate(zip(w, w[1:], w[2:])) if seen[g] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def ledger(spark):
    docs = spark.createDataFrame([(i, t, "m", "f", i % 3) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "m", "f", 0)], "doc_id long, text string, measures string, failed string, words long")
    return quality.ledger(docs, ("doc_id", "measures", "failed", "words")).cache()


def test_measures_and_bits_follow_brute_force(ledger):
    rows = ledger.collect()
    assert len(rows) == len(TEXTS) + 1 and ledger.columns == ["doc_id", "words", "measures", "failed"]
    for r in rows:
        m = r["measures"].asDict()
        assert tuple(m[c] for c in quality.MEASURES[:6]) == measured(TEXTS[r["doc_id"]])
        bits = sum(1 << k for k, (_, rule) in enumerate(quality.RULES) if eval(rule, {}, m))  # noqa: S307
        assert r["failed"] == bits
    assert [r["failed"] for r in rows if r["doc_id"] in (0, 1)] == [1, 1]


def test_policies_and_ablations_from_bits_alone(ledger):
    bits = [r["failed"] for r in ledger.select("failed").collect()]
    for p in quality.POLICIES:
        keeps = lambda b, p=p: not b & p.hard_bits and (b & p.soft_bits).bit_count() <= p.allowed
        got = [r for r in quality.apply(ledger, p).select("failed", "kept", "reasons").collect()]
        assert [r["kept"] for r in got] == [keeps(b) for b in bits]
        assert all(r["reasons"] == [n for k, n in enumerate(quality.NAMES) if r["failed"] >> k & 1 and n in p.hard + p.soft] for r in got)
        found = {r["rule"]: tuple(r)[1:] for r in quality.ablations(ledger, p).collect()}
        one = {n: 1 << quality.NAMES.index(n) for n in p.hard + p.soft}
        assert found == {n: (sum(b & x > 0 for b in bits), sum(keeps(b & ~x) and not keeps(b) for b in bits), sum(keeps(b & ~x) for b in bits)) for n, x in one.items()}
    assert quality.policy("prose").version == 2 and quality.policy("prose", 1).allowed == 0
    got = quality.fired(ledger).first()
    assert got["any"] == reduce(int.__or__, bits) and got["docs"] == len(bits)
    empty = ledger.where("false")
    assert {tuple(r)[1:] for r in quality.ablations(empty, quality.policy("base")).collect()} == {(0, 0, 0)}
    assert quality.apply(empty, quality.policy("base")).count() == 0 and tuple(quality.fired(empty).first()) == (0, 0, 0)
