"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from gistmill.llm import conversations

COLUMNS = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """rows: (conv_id, turn, role, text); turns that tie are equal rows."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        own_saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = own_saved + sum(saved[x] for x in children[node])
        parent = members[node[:-1]][0] if node else None
        digest = hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()
        out.append((len(node), members[node][0], parent, len(members[node]), len(children[node]), leaves[node], saved[node], digest))
    return sorted(out, key=str)


def got(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, 1, b"x") for r in rows], "conv_id long, turn int, role string, text string, depth int, digest binary")
    return sorted((tuple(r[c] for c in COLUMNS) for r in conversations.trie(df.repartition(3), **sizes).collect()), key=str)


@pytest.mark.parametrize(("seed", "block", "piece"), [(1, 1024, 1 << 16), (2, 2, 8), (3, 3, 40)])
def test_trie_of_random_conversations(spark, seed, block, piece):
    rng = random.Random(seed)
    text = lambda: rng.choice(["", "a", "bb", None, "çé", "x" * 50])
    rows = []
    for c in [*range(0, 40), *range(195, 260), *range(1000, 1030)]:  # 900 is absent, 200 there
        if rng.random() < 0.5:  # copies, so that nodes have many ends
            rows += [(c, t, "user", "same") for t in range(9)]
        else:
            rows += [(c, rng.choice([t, t, None]) if t == 0 else t, rng.choice(["user", "bot", None]), text()) for t in range(rng.randrange(1, 12))]
    rows += [(77, t, "user", str(t % 3)) for t in range(400)]
    assert got(spark, rows, block=block, piece=piece) == brute(rows)


def test_trie_of_odd_input(spark):
    # no template and fewer turns than the head has: a turnless conversation; null ids go
    short = next(c for c in range(301, 399) if zlib.crc32(str(c).encode()) % 6 > 2)
    assert got(spark, [(short, 0, "user", "hi")]) == brute([(short, 0, "user", "hi")])
    rows = [(short, 0, "user", "hi"), (short, 1, None, None), (500, None, "a", "b"), (500, 0, "a", "b"), (500, 0, "a", "b"), (None, 0, "a", "b"), (501, 0, "x", "y" * 3_000_000)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_equal_turns_are_told_from_joined_ones(spark):
    rows = [(500, 0, "ab", "c"), (600, 0, "a", "bc"), (700, 0, "ab", "c"), (700, 1, "", "")]
    assert got(spark, rows) == brute(rows)


def test_long_conversations_are_chained_in_blocks(spark):
    assert conversations.BLOCK < 2600
    rows = [(c, t, "user", str(t)) for c in (500, 507) for t in range(2600)] + [(507, 2600, "user", "end")]
    assert got(spark, rows) == brute(rows)
