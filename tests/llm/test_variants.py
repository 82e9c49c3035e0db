"""Spelling variants against every pair of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from gistmill.llm import variants


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "[" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    out, form = [], {}
    met = {w: [x for x in n if near(w, x)] for w in n}
    for w, k in n.items():
        best = min(met[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * k else None
    for w, k in n.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, k, len(met[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out)


def got(spark, docs, **kw):
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n int")
    return sorted(tuple(r) for r in variants.group(df.repartition(3), **kw).collect())


def docs_of(seed, letters, n):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 10))) for _ in range(25)]
    words = []
    for s in stems:
        words += [s] * rng.choice([5, 30, 200])
        for _ in range(12):
            i = rng.randrange(len(s) + 1)
            v = rng.choice([s[:i] + rng.choice(letters) + s[i:], s[:i] + s[i + 1 :], s[:i] + rng.choice(letters) + s[i + 1 :]])
            words += [v] * rng.choice([1, 5, 6, 40])
    rng.shuffle(words)
    return [(rng.choice([i, None]) if i % 7 == 0 else i, rng.choice([" ", ", ", "1", "\n"]).join(w.capitalize() if rng.random() < 0.2 else w for w in words[i::n])) for i in range(n)]


@pytest.mark.parametrize(("seed", "letters", "work"), [(1, "ab", 1024), (2, "ab", 1), (3, "abcÀéÿ×", 1), (4, "aBß", 30)])
def test_variants_against_all_pairs(spark, seed, letters, work):
    docs = docs_of(seed, letters, 40)
    want = brute(docs)
    assert sum(r[2] for r in want) > 20 and any(r[3] for r in want)
    assert got(spark, docs, work=work) == want


def test_forms_are_followed_to_the_last(spark):
    words = [("abcdefghij", 5), ("abcdefghi", 25), ("abcdefgh", 125), ("abcdefg", 625), ("abcdef", 3125), ("bbcdefg", 625), ("zzzzzz", 9)]
    docs = [(1000 + i, " ".join([w] * k)) for i, (w, k) in enumerate(words)]
    want = brute(docs)
    assert {r[0]: r[5] for r in want}["abcdefghij"] == "abcdef"
    assert got(spark, docs) == want


def test_odd_texts(spark):
    long = "lengthy " * 300_000 + "x" * 70_000 + " " + ("y" * 3000 + " ") * 6
    docs = [(1, None), (2, ""), (3, "12 34"), (4, long), (5, "straße STRASSE straßen " * 6), (5, "straße STRASSE straßen " * 6), (None, "Élan élan ÉLANCÉS élancés " * 5)]
    assert got(spark, docs) == brute(docs)
    assert got(spark, []) == []
