"""PartEnum join, paragraph banding, suffix-sorted removal, key exchange and components, against brute force."""

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gistmill.llm import common, keys, linkage, paragraphs, partenum, suffix, words
from gistmill.llm.words import hash_strings, window_hashes

from .conftest import prose


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


def plain_components(sets, num, den):
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
                    x, y = top(a), top(b)
                    up[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}


@pytest.mark.parametrize(("num", "den"), [(90, 100), (4, 5), (1, 2)])
def test_similar_sets_share_a_signature(num, den):
    rng = np.random.default_rng(5)
    for n in [*range(1, 40), 100, 300, 900]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            drop, add = (rng.integers(0, max(1, int(len(a) * (1 - num / den))) + 1) for _ in range(2))
            b = np.unique(np.concatenate([rng.permutation(a)[: len(a) - drop], rng.integers(0, 1 << 63, add).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if den * common >= num * (len(a) + len(b) - common) and not np.array_equal(a, b):
                assert len(np.intersect1d(partenum.signatures(a, num, den), partenum.signatures(b, num, den)))


@pytest.mark.parametrize(("size", "num", "den"), [(3, 90, 100), (5, 4, 5)])
def test_join(spark, size, num, den):
    rng = random.Random(size)
    texts = []
    for base in range(6):
        words = prose(base, 120).split()
        texts.append(" ".join(words))
        for _ in range(12):  # a group whose members are similar to the base, and not all to each other
            own = list(words)
            for _ in range(rng.randrange(0, 7)):
                own[rng.randrange(len(own))] = rng.choice(["alpha", "beta", "gamma"]) + str(rng.randrange(99))
            texts.append(" ".join(own))
    texts += [prose(100 + i, 50) for i in range(10)] + ["", None, "one", "One", "two words", "two  words"]
    docs = spark.createDataFrame([(i * 7 % len(texts), t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in partenum.join(docs, size, num, den).collect()}
    sets = {r["doc_id"]: shingles(r["text"], size) for r in docs.collect()}
    want = plain_components(sets, num, den)
    assert got == {i: (len(sets[i]), want[i]) for i in sets} and len(set(want.values())) < len(want)


def test_join_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(linkage, "BLOCK", 3)
    monkeypatch.setattr(linkage, "TASK_ROWS", 5)
    long = prose(3, 900).split()
    texts = [" ".join(long[i * 12 : i * 12 + 300]) for i in range(40)] + [" ".join(long[:300])] * 9 + [prose(50 + i, 80) for i in range(5)]
    random.Random(1).shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for size, num, den in ((3, 90, 100), (5, 4, 5)):
        sets = {i: shingles(t, size) for i, t in enumerate(texts)}
        want = plain_components(sets, num, den)
        assert {r["doc_id"]: r["component_id"] for r in partenum.join(docs, size, num, den).collect()} == want
        assert sum(1 for i in want.values() if i == want[texts.index(" ".join(long[:300]))]) >= 49


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1, max_size=8), min_size=2, max_size=12), st.booleans(), st.data())
def test_forest(sets, across, data):
    n = len(sets)
    component, block = (np.array(data.draw(st.lists(st.integers(0, 3), min_size=n, max_size=n))) for _ in range(2))
    got = linkage.forest([np.array(sorted(s), np.uint64) for s in sets], component, block if across else None, 1, 2)
    up = {("c", int(c)): int(c) for c in component}

    def joined(edges):
        label = component.copy()
        for x, y in edges:
            label[label == label[y]] = label[x]
        return {frozenset(np.flatnonzero(label == c).tolist()) for c in label}

    every = [(x, y) for x in range(n) for y in range(x + 1, n) if 2 * len(sets[x] & sets[y]) >= len(sets[x] | sets[y]) and (not across or block[x] != block[y])]
    assert joined(got) == joined(every) and len(got) < max(2, len(up))


def test_long_text_sets(monkeypatch):
    monkeypatch.setattr(words, "SLICE_BYTES", 50)
    for text in (prose(4, 400), "a " * 90, "x" * 300, "é " + prose(5, 30) + "\t\u3000end", " " * 200):
        long = words.shingle_sets(pa.array([text]), 5)[0]
        assert np.array_equal(long, words.shingle_sets(pa.array([text, "other"]), 5)[0])


def cpu_seconds(run):
    def once():
        began = time.process_time()
        run()
        return time.process_time() - began

    return min(once() for _ in range(3))


def test_word_hashes_and_sets_make_no_list_of_words_and_no_call_a_text():
    texts = pa.array([f"{i % 31} one {i % 37} two {i % 41} six" for i in range(50_000)])
    distinct = pa.array([f"word{i * 7919}" for i in range(100_000)] + ["", "\u00e9", "\u65e5\u672c"])
    assert hash_strings(distinct).tolist() == [xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()]
    assert cpu_seconds(lambda: hash_strings(distinct)) < cpu_seconds(distinct.to_pylist)
    sets = words.shingle_sets(texts, 5)
    assert cpu_seconds(lambda: words.shingle_sets(texts, 5)) < cpu_seconds(lambda: [np.unique(x) for x in sets])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \t", max_size=25)), max_size=12), st.integers(1, 5))
def test_sets_of_many_texts_are_those_of_each(texts, size):
    got = words.shingle_sets(pa.array(texts, pa.string()), size)
    assert [len(x) for x in got] == [len(shingles(t, size)) for t in texts]
    assert all(np.array_equal(x, words.shingle_sets(pa.array([t], pa.string()), size)[0]) for x, t in zip(got, texts, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(-3, 3), st.integers(0, 3)), max_size=40))
def test_sorted_keys(rows):
    got = keys._sorted(*(np.array([r[i] for r in rows], np.int64) for i in range(3)))
    want = sorted(set(rows))
    assert list(zip(*(x.tolist() for x in got[:3]), strict=True)) == want
    first = [i for i, r in enumerate(want) if not i or want[i - 1][0] != r[0]]
    assert got[3].tolist() == first and got[4].tolist() == np.diff([*first, len(want)]).tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=90), st.integers(1, 60))
def test_anchors_are_the_last_least_of_each_window(hashes, first_line):
    n = len(hashes) + 1
    got = paragraphs.anchors(np.array(hashes, np.uint64), np.repeat([0, 1], [min(first_line, n), max(n - first_line, 0)]), np.array([True, True]))
    lines = [(0, min(first_line, n)), (min(first_line, n), n)]
    assert set(got.tolist()) == {max(i for i in range(s, s + 20) if hashes[i] == min(hashes[s : s + 20])) for a, b in lines for s in range(a, b - 20)}


def test_join_of_odd_documents(odd_docs, no_docs):
    got = partenum.join(odd_docs, 3, 90, 100).collect()
    sets = {r["doc_id"]: shingles(r["text"], 3) for r in odd_docs.collect() if r["doc_id"] is not None}
    want = plain_components(sets, 90, 100)
    assert len(got) == 16 and all(r["doc_id"] is None and r["component_id"] is None or (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]]) for r in got)
    kept = partenum.deduplicate(odd_docs)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert kept.columns == odd_docs.columns and 1 not in ids and 2 not in ids and {3, 4, 5, None} <= set(ids)
    assert partenum.join(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(5, 5)]
    got = {r["id"]: r["component"] for r in linkage.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = plain_components({i: {0} for e in edges for i in e}, 2, 1)
    for a, b in edges:
        x, y = want[a], want[b]
        want = {k: min(x, y) if v in (x, y) else v for k, v in want.items()}
    assert got == {k: v for k, v in want.items() if k in got} and len(got) >= 110


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)).filter(lambda e: e[0] < e[1]), max_size=30), st.integers(1, 12), st.integers(1, 30))
def test_stars_join_what_the_edges_join(edges, batch, held):
    batches = [pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in edges[k : k + batch]]) for k in range(0, len(edges), batch)]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(linkage, "EDGES", held)
        got = [list(zip(*(b.column(c).to_pylist() for c in "ab"), strict=True)) for b in linkage._stars(batches)]

    def joined(rows):
        label = {i: i for e in edges for i in e}
        for a, b in rows:
            label = {i: min(label[a], label[b]) if x in (label[a], label[b]) else x for i, x in label.items()}
        return label

    assert joined([e for rows in got for e in rows]) == joined(edges)
    assert all(len({b for _, b in rows}) == len(rows) and not {a for a, _ in rows} & {b for _, b in rows} for rows in got)


def test_few_edges_are_done_in_a_round(spark):
    ids = random.Random(4).sample(range(10_000), 500)
    edges = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long").repartition(3)
    scratch = common.Scratch(spark, "round")
    assert {(r["id"], r["component"]) for r in linkage.components(edges, scratch).collect()} == {(i, min(ids)) for i in ids}
    assert scratch.made <= 5  # tables: the edges and labels, and of one round the parents, labels and edges


def test_edges_of_many_tasks_and_turns(spark, monkeypatch):
    monkeypatch.setattr(linkage, "EDGES", 3)
    ids = random.Random(5).sample(range(10_000), 300)
    edges = [(a, b) for part in (ids[:120], ids[120:]) for a, b in zip(part, part[1:], strict=False)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["id"]: r["component"] for r in linkage.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: min(part) for part in (ids[:120], ids[120:]) for i in part}


def test_each_written_table_lets_the_driver_forget_its_plan(spark, monkeypatch):
    seen, scratch = [], common.Scratch(spark, "kept")
    monkeypatch.setattr(common, "release", lambda session: seen.append((session, scratch.made)))
    tables = [scratch.cut(spark.range(100).groupBy((F.col("id") % k).alias("key")).count(), "counts") for k in (2, 3)]
    assert seen == [(spark, 1), (spark, 2)] and [t.count() for t in tables] == [2, 3]



def test_shared_keys(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pairs = [(int(k) << 16, int(i)) for k, i in zip(rng.integers(0, 3000, 4000), rng.integers(0, 500, 4000), strict=True)] + [(7 << 40, i) for i in range(300)]

    def run(batches):
        packer, names = keys.Packer(4), [n for n, _ in keys.PACKED]
        for b in batches:
            for rows in packer.add(b.column("k").to_numpy().astype(np.uint64), b.column("i").to_numpy()):
                yield pa.RecordBatch.from_arrays(keys.batch_of(rows), names)
        for rows in packer.end():
            yield pa.RecordBatch.from_arrays(keys.batch_of(rows), names)

    packed = spark.createDataFrame(pairs, "k long, i long").repartition(3).mapInArrow(run, keys.PACKED_SQL)
    got: dict = {}
    for r in keys.shared(packed).collect():
        got.setdefault(r["key"], set()).update(r["members"])
    want: dict = {}
    for k, i in pairs:
        want.setdefault(k >> 16, set()).add(i)
    assert got == {k: v for k, v in want.items() if len(v) > 1}
    alike = {frozenset(r["members"]) for r in keys.shared(packed, alike=True).collect() if r["key"] < 0}
    assert alike <= {frozenset(v) for v in want.values() if len(v) > 1}


def plain_paragraphs(text):
    """(line, first word, words, is a piece) of a text, by its own reading of the rules."""
    out = []
    for k, line in enumerate((text or "").split("\n")):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), line))
        out.append((k, 0, tuple(words), False))
        if len(words) <= 50:
            continue
        ends = [i + 1 for i, w in enumerate(words) if w[-1] in ".!?" and i + 1 < len(words)]
        sentences = [(a, b) for a, b in zip([0, *ends], [*ends, len(words)], strict=True)]
        out += [(k, a, tuple(words[a:b]), False) for a, b in sentences if len(sentences) > 1]
        each = hash_strings(pa.array(words))
        pairs = window_hashes(np.arange(len(words)), each, 2).tolist()
        least = {max(i for i in range(s, s + 20) if pairs[i] == min(pairs[s : s + 20])) for s in range(len(words) - 20)}
        for p in sorted(least):
            touched = [b - a for a, b in sentences if a < p + 12 and b > p]
            alike = any(b - a == 11 and a in (p, p + 1) for a, b in sentences)
            if p + 12 <= len(words) and not alike and any(n < 8 or n > 20 for n in touched):
                out.append((k, p, tuple(words[p : p + 12]), True))
    return [u for u in out if len(u[2]) >= 8]


def plain_repeats(texts, num=4, den=5):
    units = [(d, *u) for d, t in sorted(texts.items()) for u in sorted(plain_paragraphs(t), key=lambda u: (u[0], u[1], -len(u[2]), u[3]))]
    comp = plain_components({i: shingles(" ".join(u[3]), 5) if not u[4] else set() for i, u in enumerate(units)}, num, den)
    first = {}
    for i, u in enumerate(units):  # equal words are one, pieces too
        j = first.setdefault(u[3], i)
        x, y = comp[i], comp[j]
        comp = {k: min(x, y) if c in (x, y) else c for k, c in comp.items()}
    heads = {}
    for i in comp:
        heads.setdefault(comp[i], units[i])
    out = set()
    for i, (d, line, at, words, _) in enumerate(units):
        head = heads[comp[i]]
        if not (d == head[0] and line == head[1] and at < head[2] + len(head[3]) and head[2] < at + len(words)):
            out.add((d, line, at, len(words), head[0]))
    return out


def test_paragraphs(spark):
    rng = random.Random(4)
    shared = [prose(500 + i, 55) for i in range(3)]
    texts = [prose(i, 60) + "\n" + prose(i + 50, 30) for i in range(20)]
    for i in range(0, 12, 2):
        texts[i] += "\n" + shared[i % 3]
        words = shared[i % 3].split()
        words[rng.randrange(10)] = "changed"
        texts[i + 1] += " " + " ".join(words) + " " + prose(i + 90, 20)
    bare = prose(77, 70).replace(".", "")
    texts += [prose(i + 200, 30) + " " + bare + " " + prose(i + 300, 9) for i in range(3)] + ["\n".join([texts[0]] * 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["line"], r["first_word"], r["n_words"], r["kept_doc_id"]) for r in paragraphs.repeats(docs).collect()}
    want = plain_repeats(dict(enumerate(texts)))
    assert got == want and {d for d, *_ in got} >= {6, 8, 10, 21, 22, 23} and {1, 3, 5} & {d for d, *_ in got}
    assert paragraphs.tuned(0.8, 0.998) == 9


def test_paragraphs_of_a_long_text(spark):
    lines = [prose(k % 5000, 9 + k % 7) for k in range(60_000)]
    text = "\n".join(lines)
    assert len(text) > 3 * paragraphs.WORK_BYTES
    docs = spark.createDataFrame([(1, lines[59_999] + "\n" + lines[7]), (2, text), (2**62, lines[3])], "doc_id long, text string")
    got = {(r["doc_id"], r["line"], r["kept_doc_id"]) for r in paragraphs.repeats(docs).collect()}
    assert {(2, 59_999, 1), (2, 7, 1), (2, 5007, 1), (2, 5008, 2), (2**62, 0, 2)} <= got and (2, 8, 2) not in got and len(got) > 54_000


def test_paragraphs_of_odd_documents(odd_docs, no_docs):
    got = paragraphs.repeats(odd_docs).collect()
    assert {(r["doc_id"], r["kept_doc_id"]) for r in got} >= {(1, 0)} and all(r["doc_id"] not in (3, 4, 5, 6, 7, 12, 13) for r in got)
    assert any(r["doc_id"] == 9 and r["kept_doc_id"] == 8 for r in got)
    out = {r["doc_id"]: r for r in paragraphs.remove(odd_docs).collect()}
    assert out[1]["text"] == "" and out[3]["text"] is None and len(out[9]["text"]) < len(next(r["text"] for r in odd_docs.collect() if r["doc_id"] == 9))
    assert paragraphs.repeats(no_docs).count() == 0


def test_paragraphs_of_repeated_rows(spark):
    text = prose(70, 30)
    docs = spark.createDataFrame([(5, text), (5, text), (9, text)], "doc_id long, text string").coalesce(1)
    assert {(r["doc_id"], r["kept_doc_id"]) for r in paragraphs.repeats(docs).collect()} == {(9, 5)}


def test_paragraphs_inside_long_lines(spark):
    bare = lambda seed, n: prose(seed, n).replace(".", "")
    for seed in range(300):
        rng = random.Random(seed)
        passage = bare(1000 + seed, 51).split()
        for at in range(rng.randrange(8), 51, rng.randrange(4, 8)) if seed % 3 == 0 else [rng.randrange(51)]:
            passage[at] += "."
        left, right = (bare(s, rng.randrange(60)) + rng.choice(["", "."]) for s in (5000 + seed, 6000 + seed))
        texts = [" ".join([left, *passage, right]), " ".join([bare(7000 + seed, rng.randrange(30)), *passage, bare(8000 + seed, rng.randrange(9))])]
        u = paragraphs.units_of(pa.array(texts))
        assert set(u.low[u.owner == 0].tolist()) & set(u.low[u.owner == 1].tolist()), seed
    passage = bare(1, 60)
    texts = [bare(2, 40) + " " + passage + " " + bare(3, 40), bare(4, 30) + " " + passage + " " + bare(5, 35), bare(6, 3) + ". " + bare(7, 57)]
    got = paragraphs.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["kept_doc_id"]) for r in got} == {(1, 0)}
    assert all(r["first_word"] >= 30 and r["first_word"] + r["n_words"] <= 90 for r in got)


def plain_removal(docs, length):
    first, out = {}, []
    for i, data in sorted(docs, key=lambda x: (x[0] is None, x[0])):
        if i is not None:
            for p in range(len(data) - length + 1):
                first.setdefault(data[p : p + length], i)
    for i, data in docs:
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1) if i is not None else ():
            if first[data[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(data), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(data, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def removed(df, length=50):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeats(df, length).collect()), key=str)


def test_removal(spark):
    rng = random.Random(6)
    pool = [prose(900 + i, 30) for i in range(8)] + ["und " * 60, "ü" * 90]
    docs = [(i, (prose(i, rng.randrange(1, 60)) + "".join(rng.choice(pool)[rng.randrange(20) :] for _ in range(rng.randrange(4)))).encode()) for i in rng.sample(range(1000), 60)]
    df = spark.createDataFrame([(i, t.decode()) for i, t in docs], "doc_id long, text string").repartition(5)
    assert removed(df) == plain_removal(docs, 50)


@pytest.mark.parametrize("hot", [0, 3, 20])
def test_removal_under_hot_anchors(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT_IDS", hot)
    rng = random.Random(hot)
    common = ["a phrase of some thirty bytes ", "another one that many texts hold "]
    docs = [(i, (prose(i % 40, 8) + "".join(rng.choice(common) + prose(rng.randrange(12), rng.randrange(1, 9)) for _ in range(5))).encode()) for i in range(50)]
    df = spark.createDataFrame([(i, t.decode()) for i, t in docs], "doc_id long, text string").repartition(3)
    assert removed(df) == plain_removal(docs, 50)


def test_removal_of_a_long_text(spark):
    parts = [prose(k, 40) for k in range(3000)]
    long = " ".join(parts[k % 3000] + str(k) for k in range(12_000))
    assert len(long) > 3 * suffix.WORK_BYTES
    docs = [(1, " ".join(parts[5:9]).encode()), (2, long.encode()), (3, long[2**20 - 200 : 2**20 + 300].encode() + b"#" + parts[2999].encode())]
    df = spark.createDataFrame([(i, t.decode()) for i, t in docs], "doc_id long, text string")
    assert removed(df) == plain_removal(docs, 50)


def test_removal_of_odd_documents(odd_docs, no_docs):
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in odd_docs.collect()]
    assert removed(odd_docs) == plain_removal(docs, 50)
    assert suffix.remove_repeats(no_docs).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=12), min_size=1, max_size=30), st.integers(1, 6))
def test_suffix_sort(parts, limit):
    raw = np.frombuffer(("".join(parts) + "x" * limit).encode(), np.uint8)
    at = np.arange(len(raw) - limit)
    segment = np.sort(at % 3)
    order, classes = suffix.suffix_sort(suffix.HashedText(raw), at, np.full(len(at), limit), segment)
    cut = [(int(segment[i]), raw[at[i] : at[i] + limit].tobytes(), int(i)) for i in order]
    assert cut == sorted(cut)
    assert [int(c) for c in classes] == list(np.cumsum([0] + [a[:2] != b[:2] for a, b in zip(cut, cut[1:])]))


def test_hash_collisions_are_verified():
    raw = np.frombuffer(b"abcdefghij" * 6 + b"abcdeXghij" * 6, np.uint8)
    text = suffix.HashedText(raw)
    text.prefix = np.zeros_like(text.prefix)  # every two hashes are equal
    at = np.array([0, 60, 10, 70, 61])
    order, classes = suffix.suffix_sort(text, at, np.full(5, 10), np.zeros(5, np.int64))
    groups: dict = {}
    for i, c in zip(order, classes, strict=True):
        groups.setdefault(int(c), set()).add(raw[at[i] : at[i] + 10].tobytes())
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == 3


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (2, 3, 0, 1), (1, 0, 3, 2)])
def test_links_of_a_set_that_an_id_has_beside_a_larger_one(spark, order):
    base = prose(41, 121).split()
    near = [*base[:60], "elsewhere", *base[61:]]
    rows = [(1, " ".join(base)), (1, prose(42, 400)), (2, " ".join(base)), (3, " ".join(near))]
    df = spark.createDataFrame([rows[k] for k in order], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["component_id"] for r in partenum.join(df, size=3, num=90, den=100).collect()}
    assert got == {1: 1, 2: 2, 3: 2}


def test_a_key_of_one_id_displaces_no_shared_key():
    row = lambda key, ids: (np.full(len(ids), key, np.uint64) << np.uint64(64 - keys.KEY_BITS), np.array(ids, np.int64))
    given = [(5, [1, 2]), (6, [3]), (7, [1, 2]), (8, [2, 3]), (9, [4])]
    packer = keys.Packer(1)
    packed = list(packer.add(*(np.concatenate(x) for x in zip(*(row(*g) for g in given), strict=True)))) + list(packer.end())
    table = pa.concat_tables([pa.table({n: pa.array(p[n], t) for n, t in keys.PACKED}) for p in packed])
    got = keys._merge(alike=True, told=False)(table)
    assert sorted(got["members"].to_pylist()) == [[1, 2], [2, 3]]
