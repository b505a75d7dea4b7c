"""Prefix trie and structure repair against brute-force versions."""

import hashlib
import itertools
import math
import re
import zlib

import pytest

from sylvaframe.llm import prefix_trie, structure_repair

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode()))


def trie_by_hand(rows):
    turns = {}
    for r in in_order(r for r in rows if r[0] is not None):
        turns.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(turns.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:])
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    out = set()
    for seq, members in nodes.items():
        below = [s for s in nodes if s[: len(seq)] == seq]
        inner = {s[:-1] for s in nodes if s}
        children = [s for s in below if len(s) == len(seq) + 1]
        saved = sum((len(nodes[s]) - 1) * len(s[-1][1].encode()) for s in below if s)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(seq)))
        parent = min(nodes[seq[:-1]]) if seq else None
        out.add((min(members), len(seq), parent, len(members), len(children), sum(s not in inner for s in below), saved, sha(ends)))
    return out


PLAIN = [(c, t, "ua"[t % 2], f"é{c % 3}.{min(t, 3)}") for c in range(23) for t in range(c % 7)]
ODD = [(None, 1, "u", "lost"), (103, None, None, "x"), (103, None, "u", None), (103, 2, "u", "y"), (103, 2, "u", "y"), (105, 1, "", ""), (-7, 0, "u", "z" * 5000), (-5, 0, "u", "base"), (108, 0, "u", "y")]
ROLES = [(200, 0, "ab", "c"), (200, 1, "u", "1"), (201, 0, "a", "bc"), (205, 0, "a", "bc"), (206, 0, "a", "bc"), (210, 0, "ab", "c"), (210, 1, "q", "")]
COPIES = [(c, t, "u", f"same {t}") for c in range(17) for t in range(3)] + [(40, t, "u", f"same {t}") for t in range(9)] + [(41, t, "u", f"same {min(t, 7)}") for t in range(11)]
TRIES = {"mixed": PLAIN + ODD + ROLES, "copies": COPIES, "empty": []}


@pytest.mark.parametrize("name", TRIES)
def test_trie_equals_brute_force(spark, name):
    rows = TRIES[name]
    df = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA + ", depth int")
    found = [tuple(r) for r in prefix_trie.trie(df).collect()]
    assert len(found) == len(set(found))
    assert set(found) == trie_by_hand(rows)


def test_trie_of_the_table(spark):
    path = "/root/testdata/sf0.001/conversations.parquet"
    rows = [tuple(r) for r in spark.read.parquet(path).select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in prefix_trie.trie(spark.read.parquet(path)).collect()} == trie_by_hand(rows)


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role, text = "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, t, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def judged(rows):
    """Of one conversation in order: (role, text, fault)."""
    seen, out = set(), []
    for _, _, role, text in in_order(rows):
        bare = text.strip(WHITE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


GRAMMAR = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, repaired turns) by trying all edits of a few rows."""
    best = None
    inserts = [[("I", r, "") for r in some] for k in range(3) for some in itertools.product(("user", "assistant"), repeat=k)]
    options = []
    for role, text, fault in rows:
        must = fault in ("blank", "duplicate")
        more = fault == "truncated"
        own = [("D", None, None, 3)]
        if not must:
            own += [("K", role, text, more), ("R", "user", text, 2 + more), ("R", "assistant", text, 2 + more)]
        options.append(own)
    for picks in itertools.product(*options):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            edits, turns, cost = "", [], 0
            for i, gap in enumerate(gaps):
                for _, role, text in gap:
                    edits, cost = edits + "I", cost + 2
                    turns.append((role, text))
                if i < len(rows):
                    letter, role, text, price = picks[i]
                    edits, cost = edits + letter, cost + price
                    if letter != "D":
                        turns.append((role, text))
            if GRAMMAR.fullmatch("".join(r[:1] or "-" for r, _ in turns)) and (best is None or (cost, edits) < best[:2]):
                best = (cost, edits, turns)
    return best


def by_suffix(rows):
    """(cost, audit) by comparing whole suffixes from the end: an independent program for conversations of any length."""
    after = {("E", "s"): "S", ("E", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
    following = {"E": "u", "S": "u", "U": "a", "A": "u"}

    def closed(best):
        for _ in range(3):
            for q, letter in following.items():
                cost, edits = best[after[q, letter]]
                best[q] = min(best[q], (cost + 2, "I" + edits))
        return best

    far = (10**9, "")
    best = closed({"E": (0, ""), "S": far, "U": far, "A": (0, "")})
    for role, _, fault in reversed(rows):
        now = {}
        for q in "ESUA":
            ways = [(best[q][0] + 3, "D" + best[q][1])]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if (q, role[:1]) in after:
                    cost, edits = best[after[q, role[:1]]]
                    ways.append((cost + more, "K" + edits))
                cost, edits = best[after[q, following[q]]]
                ways.append((cost + 2 + more, "R" + edits))
            now[q] = min(ways)
        best = closed(now)
    return best["E"]


def replayed(rows, audit):
    """Repaired text of the edits; inserted and rerolled turns take the role that the grammar leaves."""
    turns, at = [], 0
    for letter in audit:
        role, text, _ = rows[at] if at < len(rows) else ("", "", None)
        need = "assistant" if turns and turns[-1][0][0] == "u" else "user"
        turns += {"K": [(role, text)], "R": [(need, text)], "I": [(need, "")], "D": []}[letter]
        at += letter != "I"
    assert at == len(rows) and GRAMMAR.fullmatch("".join(r[0] for r, _ in turns))
    return "\n".join(f"{r}:{t}" for r, t in turns)


def expected(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        marked = judged(own)
        numbers = [r[1] for r in own if r[1] is not None]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(marked, marked[1:], strict=False)]
        cost, audit = by_suffix(marked)
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        kinds = [sum(f == k for *_, f in marked) for k in ("blank", "duplicate", "truncated")]
        out[c] = (c, gaps, *kinds, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha(replayed(marked, audit)))
    return out


def odd_rows():
    roles = ["system", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "cut off", "", " \n", None, "Why? \t", "nbsp. ", "line. ", "é?"]
    rows = [(c, (c * 7 + t * 5) % 9 if (c + t) % 11 else None, roles[(c * t + c + t) % 6], texts[(c * 3 + t * t) % 10]) for c in range(40) for t in range(c % 13)]
    rows += [(None, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(7)] + [(77, None, "user", "a"), (77, None, "user", "a"), (78, 1, "system", "x" * 100_000)]
    return rows


@pytest.mark.parametrize("chunk", [4096, 3])
def test_repair_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(structure_repair, "CHUNK", chunk)
    rows = odd_rows()
    named = [(c, t, " " if role is None else role, " " if text is None else text) for c, t, role, text in rows]
    found = structure_repair.repair(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", cost int")).collect()
    assert len(found) == len({r["conv_id"] for r in found})
    assert {r["conv_id"]: tuple(r) for r in found} == expected(named)


def test_suffix_program_equals_all_edits():
    for marks in itertools.product([("system", "x", None), ("user", "y", None), ("assistant", "z", "truncated"), ("tool", "t", None), ("user", "", "blank")], repeat=2):
        for rows in (list(marks), list(marks[:1]), []):
            assert by_suffix(rows) == cheapest(rows)[:2]


def test_damaged_table(spark):
    path = "/root/testdata/sf0.001/conversations.parquet"
    rows = [tuple(r) for r in spark.read.parquet(path).select("conv_id", "turn", "role", "text").collect()]
    found = {r["conv_id"]: tuple(r) for r in structure_repair.repair_damaged(spark.read.parquet(path)).collect()}
    want = expected(damaged(rows))
    empty = (0, 0, 0, 0, 0, 0, "", sha(""))
    assert found == {c: want.get(c, (c, *empty)) for c in {r[0] for r in rows}}


def test_conversations_without_rows_left(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows = [(lost, 1, "user", "gone."), (None, None, None, None)]
    assert expected(damaged(rows)).keys() == {None}
    found = {r["conv_id"]: tuple(r) for r in structure_repair.repair_damaged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == expected(damaged(rows)) | {lost: (lost, 0, 0, 0, 0, 0, 0, "", sha(""))}
    assert structure_repair.repair_damaged(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_long_conversation_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(structure_repair, "CHUNK", 50)
    rows = [(1, t, ("user", "assistant", "user")[t % 3], f"{t}" + "." * (t % 5 > 0)) for t in range(1_200)]
    found = structure_repair.repair(spark.createDataFrame(rows, SCHEMA)).first()
    assert tuple(found) == expected(rows)[1]
