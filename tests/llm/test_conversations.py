"""Conversation operators against plain Python on small tables."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import pytest

from spreadwatch.llm import conversation_repair as R
from spreadwatch.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def null_first(x):
    return (x is not None, x)


# ---- prefix trie


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((null_first(turn), digest, role, text))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    whole = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + mine[h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    out = []
    for node, ids in members.items():
        below = [x for x in members if x[: len(node)] == node]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in ids if whole[c] == node)))
        kids = sum(1 for x in below if len(x) == len(node) + 1)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(ids), len(node), parent, len(ids), kids, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_rows(spark, rows, range_bytes, monkeypatch):
    monkeypatch.setattr(T, "RANGE_BYTES", range_bytes)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, T.prefix_trie(T.rebuilt(table)).collect()), key=repr)


@pytest.mark.parametrize("range_bytes", [1 << 24, 900])
def test_trie_against_plain_python(spark, monkeypatch, range_bytes):
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 12), *range(95, 112), *range(-3, 0), 250, 251]:
        for t in range(rng.choice([1, 2, 4, 9])):
            turn = rng.choice([None, t, t])
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["", None, "ja", "hm, ñ", "x" * 50])))
    for c in range(300, 340):  # copies, some of which differ late
        rows += [(c, t, "user", f"same {t}" if t < 7 or c % 5 else f"{c}") for t in range(9)]
    assert trie_rows(spark, rows, range_bytes, monkeypatch) == plain_trie(rows)


def test_trie_edges(spark, monkeypatch):
    assert trie_rows(spark, [], 1 << 24, monkeypatch) == []
    one = [(101, 1, None, None)]  # no family head, and h of 101 cuts its only turn or not
    assert trie_rows(spark, one, 1 << 24, monkeypatch) == plain_trie(one)
    rows = [(None, 1, "user", "gone"), (100, None, "user", "a"), (100, 1, "user", "a"), (100, 1, "user", "a"), (100, 2, "user", "z" * 100_000)]
    rows += [(c, t, "user", f"{c % 2}{t}") for c in (103, 104, 105) for t in range(60)]
    got = trie_rows(spark, rows, 1 << 24, monkeypatch)
    assert got == plain_trie(rows) and got == trie_rows(spark, rows, 500, monkeypatch)
    extra = spark.createDataFrame([(7, 0, "user", "hi", 1, "r")], SCHEMA + ", pos int, run string")
    assert T.prefix_trie(T.rebuilt(extra)).columns == [f.split()[0] for f in T.NODE.split(", ")]


def test_one_conversation_in_many_copies_is_one_row_of_a_run(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(600) for t in range(8)]  # families share, so all are equal
    runs = T.sorted_runs(T.rebuilt(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [(r.n, r.conv_id, r.ends) for r in runs] == [(600, 0, hashlib.sha256(",".join(map(str, range(600))).encode()).hexdigest())]


def test_loser_tree_looks_at_a_shared_turn_once():
    rng = random.Random(1)
    head = bytes(range(16)) * 200  # 200 turns that all share
    keys = sorted({head + bytes(rng.randrange(4) for _ in range(16 * rng.randrange(1, 4))) for _ in range(400)})
    runs = [[] for _ in range(7)]
    for key in keys:
        runs[rng.randrange(7)].append(key)
    sources = [iter([(k, T.shared_turns(r[i - 1] if i else b"", k), (k,)) for i, k in enumerate(r)]) for r in runs]
    tree = T.LoserTree(sources)
    merged = list(tree)
    assert [k for k, _, _ in merged] == keys
    assert [n for _, n, _ in merged] == [T.shared_turns(a, b) for a, b in zip([b"", *keys[:-1]], keys, strict=True)]
    assert tree.compared < 200 * 7 + 10 * len(keys)  # not 200 turns for each comparison
    assert list(T.LoserTree([])) == [] and list(T.LoserTree([iter([])])) == []


# ---- repair


def cheapest(signature):
    """All audits by brute force: breadth first over edits, (cost, audit) least."""
    best = {}

    def go(i, roles, audit, cost, inserted):
        state = roles.removeprefix("s")
        if len(state) > 2:
            state = state[-2:]
        if i == len(signature):
            if not roles or (state and state[-1] == "a"):
                best[0] = min(best.get(0, (99999, "")), (cost, audit))
        else:
            code = signature[i]
            go(i + 1, roles, audit + "D", cost + 3, 0)
            if code != ".":
                extra = 1 if code.isupper() else 0
                for edit, role, price in (("K", code.lower(), 0), ("R", "u", 2), ("R", "a", 2)):
                    if fits(roles, role):
                        go(i + 1, roles + role, audit + edit, cost + price + extra, 0)
        if inserted < 2:
            for role in "ua":
                if fits(roles, role):
                    go(i, roles + role, audit + "I", cost + 2, inserted + 1)

    def fits(roles, role):
        wanted = {"": "su", "s": "u", "u": "a", "a": "u"}[roles[-1:]]
        return role in wanted

    go(0, "", "", 0, 0)
    return best[0]


def test_solve_against_all_edits():
    assert R.solve("") == (0, "")
    for n in (1, 2):
        for signature in map("".join, itertools.product(".suaxSUAX", repeat=n)):
            assert R.solve(signature) == cheapest(signature), signature
    rng = random.Random(3)
    for _ in range(60):
        signature = "".join(rng.choice(".suaxSUAX") for _ in range(rng.randrange(3, 5)))
        assert R.solve(signature) == cheapest(signature), signature
    cost, audit = R.solve("s" + "ua" * 20_000)
    assert cost == 0 and set(audit) == {"K"}


def plain_repair(rows):
    white = " \t\n\x0b\x0c\r"
    damaged, ids = defaultdict(list), {c for c, *_ in rows}
    for c, turn, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(x for x in text if x not in ".!?")
        if kind == 4:
            role = "user"
        damaged[c] += [(null_first(turn), role, text, k) for k in range(2 if kind == 3 else 1)]
    out = []
    for c in ids:
        mine = sorted(damaged[c])
        if not mine:
            out.append((c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))
            continue
        turns = {t[1] for t, *_ in mine if t[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        seen, faults, signature = set(), defaultdict(int), ""
        for _, role, text, _ in mine:
            bare = text.strip(white)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
            signature += "." if fault in ("blank", "duplicate") else kind.upper() if fault else kind
        initials = [role[:1] for _, role, *_ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit = cheapest(signature)
        written, i = [], 0
        for edit in audit:
            after = [r for r, _ in written]
            wanted = "assistant" if after and after[-1][:1] == "u" else "user"
            if edit == "I":
                written.append((wanted, ""))
                continue
            _, role, text, _ = mine[i]
            i += 1
            if edit != "D":
                written.append((role if edit == "K" else wanted, text))
        whole = "\n".join(f"{r}:{t}" for r, t in written)
        out.append((c, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256(whole.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_repair_against_plain_python(spark):
    rng = random.Random(11)
    rows = []
    for c in [*range(60), None]:
        for t in range(rng.randrange(1, 5)):
            turn = rng.choice([t, t, t, None, t * 3])
            rows.append((c, turn, rng.choice(["user", "assistant", "system", "tool", None, "User", ""]) if rng.random() < 0.4 else ("user", "assistant")[t % 2], rng.choice(["Hi.", "well", "no!\n ", " \t", "", None, "ñandú?", "same."])))
    got = sorted(map(tuple, R.repair(R.damage(spark.createDataFrame(rows, SCHEMA).repartition(3))).collect()), key=repr)
    assert got == plain_repair(rows)


def test_repair_edges(spark):
    assert R.repair(R.damage(spark.createDataFrame([], SCHEMA))).collect() == []
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    far = [(5, -(2**63), "user", "a."), (5, 2**63 - 1, "assistant", "b.")]
    rows = [(dropped, 0, "user", "hi"), (7, 3, "system", "x" * 200_000 + "."), (7, 3, "system", "x" * 200_000 + "."), *far]
    extra = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", pos int, code string")
    got = {r.conv_id: r for r in R.repair(R.damage(extra)).collect()}
    assert tuple(got[dropped])[1:] == (0, 0, 0, 0, 0, 0, "", R.EMPTY)
    assert got[7].duplicate >= 1 and got[5].gaps is None  # more gaps than a long can count


def test_a_long_conversation_streams(spark):
    n = 3000
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(n)]
    (row,) = R.repair(R.damage(spark.createDataFrame(rows, SCHEMA))).collect()
    damaged = [zlib.crc32(f"1:{t}".encode()) % 20 for t in range(n)]
    assert row.gaps == damaged[1:-1].count(0) and row.duplicate == damaged.count(3) and row.truncated <= damaged.count(2)
