"""The prefix trie next to a plain one."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from shelfspark.llm.prefix_trie import prefix_trie

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
SCHEMA = "conv_id long, turn long, role string, text string, depth long, seq string, own string, _part long"


def plain(rows):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[conv].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        rest = c % 20 if c >= 0 else -(-c % 20)
        rebuilt[c] = tuple(own.get(c - rest, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    out = []
    for node, convs in members.items():
        under = [n for n in members if n[: len(node)] == node]
        leaves = [n for n in under if not any(m[:-1] == n for m in members if m)]
        saved = sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in under if n)
        ends = ",".join(str(c) for c in convs if rebuilt[c] == node)
        children = sum(bool(m) and m[:-1] == node for m in members)
        parent = members[node[:-1]][0] if node else None
        out.append((convs[0], len(node), parent, len(convs), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def hard_rows(convs, longest, seed):
    rnd = random.Random(seed)
    rows = [
        (c, rnd.choice([None, t, t, t]), rnd.choice(["user", None, ""]), rnd.choice(["a b", "a  c", "", None, "x" * 5, "same words again " * 3]))
        for c in convs
        for t in range(rnd.choice([1, 1, 2, 3, longest]))
    ]
    rows += [(None, 1, "user", "x"), (3, 0, "user", "same"), (3, 0, "user", "same"), (41, None, None, None), (7, 9, "user", "long " * 50_000)]
    return [(*row, 5, "s", "o", 9) for row in rows]


def got(spark, rows, parts, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return prefix_trie(df, **how)


@pytest.mark.parametrize("base,parts", [(500_000, 4), (3, 2)])  # also with chains that must be spliced
def test_trie_equals_a_plain_one(spark, base, parts):
    rows = hard_rows([*range(45), -5, -20, -27], 12, base)
    found = [tuple(r) for r in got(spark, rows, parts, base=base).select(*COLUMNS).collect()]
    assert sorted(found, key=str) == plain(rows)


def test_tour_places(spark):
    """Arcs are numbered along the tour: subtrees are nested, every place is taken once."""
    rows = hard_rows(range(30), 6, 1)
    nodes = {(r.conv_id, r.depth): r for r in got(spark, rows, 3, base=10).collect()}
    places = sorted([r.enter_arcs for r in nodes.values()] + [r.exit_arcs for r in nodes.values()])
    assert places == list(range(2 * len(nodes)))
    for r in nodes.values():
        if r.depth:
            above = nodes[r.parent_conv_id, r.depth - 1]
            assert above.enter_arcs < r.enter_arcs < r.exit_arcs < above.exit_arcs


def test_one_conversation_with_most_turns(spark):
    """A conversation over many partitions: prefixes go on from one to the next."""
    rows = [(5, t, "user", f"t{t % 7}", 0, "", "", 0) for t in range(3000)]
    rows += [(c, t, "user", f"t{t % 7}", 0, "", "", 0) for c in range(6, 20) for t in range(5)]
    nodes = {(r.conv_id, r.depth): r for r in got(spark, rows, 8).collect()}
    assert max(d for c, d in nodes if c == 5) == 3000 - zlib.crc32(b"5") % 4
    assert sum(r.n_children == 0 for r in nodes.values()) == nodes[5, 0].n_leaves


def test_no_conversations(spark):
    assert got(spark, [], 1).collect() == []
    assert got(spark, [(None, 1, "user", "x", 0, "", "", 0)], 1).collect() == []
