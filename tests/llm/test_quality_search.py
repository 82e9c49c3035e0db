"""Quality rules, classifier, exact search, the pipeline and the entry without the subpackage."""

import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from gistmill.llm import balltree, classifier, packing, rules
from gistmill.llm.common import table
from gistmill.llm.queries import tokenizer_path

from .conftest import prose


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "é#", "<p>", "\n", " ", "\t", "\x0b", "漢", "  \n", "a b a b a b a b", " "]), max_size=40).map("".join), max_size=4))
def test_counts(texts):
    got = rules.counts_of(pa.array([*texts, None], pa.string()))
    assert [[int(got[n][k]) for n in rules.NAMES] for k in range(len(texts) + 1)] == [plain_counts(t) for t in [*texts, None]]


def test_sketch_buckets(spark):
    df = spark.range(0, 100_000, 7).select("id", rules.bucket(F.col("id")).alias("b")).withColumn("top", rules.bucket_top(F.col("b")))
    rows = df.collect()
    assert all(r["id"] <= r["top"] <= r["id"] * (1 + 1 / rules.FINE) + 1 for r in rows) and [r["b"] for r in rows] == sorted(r["b"] for r in rows)


def test_rules(spark, odd_docs, no_docs):
    got = rules.judge(odd_docs).collect()
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    assert len(got) == 16
    for r in got:
        n = plain_counts(texts[r["doc_id"]])
        assert [r[x] for x in rules.NAMES] == n and r["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (r["base_failed"] and r["kept"])
    assert rules.judge(no_docs).count() == 0
    docs = [(i, prose(i, 60), "en", "a") for i in range(300)] + [(1000 + i, " ".join(w + "$$$" for w in prose(i, 60).split()), "en", "a") for i in range(20)]
    out = {r["doc_id"]: r["kept"] for r in rules.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[i] for i in range(300)) and not any(out[1000 + i] for i in range(20))
    assert rules.passing(odd_docs).columns == odd_docs.columns


def plain_verdicts(rows, prior):
    """kept by a plain reading of the rules: counts, buckets, blended histograms, fences, sampling errors."""
    parts, names = 10**6, ("word_length", "symbols", "dup_lines", "repeats")

    def top(v):
        shift = max(v.bit_length() - 9, 0)
        return ((v >> shift) + 1 << shift) - 1

    measured = {}
    for i, text, lang, source in rows:
        n, chars, symbols, dup, rep = plain_counts(text)
        lines = (text or "").count("\n") + 1
        ratio = dict(zip(names, (chars * 1000 // n if n else 0, symbols * 1000 // n if n else 0, dup * 1000 // lines, rep * 1000 // n if n else 0), strict=True))
        measured[i] = (n, lines, ratio, n < 10 or 100 * rep > 20 * n, (lang or "", source or ""))

    def histogram(name, test):
        return Counter(top(m[2][name]) for m in measured.values() if not m[3] and test(m[4]))

    def add(own, base):
        whole = sum(base.values())
        return Counter({b: own[b] * parts + prior * int(base[b] / whole * parts) for b in {*own, *base}})

    def at(h, share):
        whole, run = sum(h.values()), 0
        for b in sorted(h):
            run += h[b]
            if run >= whole * share:
                return b

    out = {}
    for i, (n, lines, ratio, failed, group) in measured.items():
        ok = not failed
        for name in names if ok else ():
            own = add(histogram(name, group.__eq__), add(histogram(name, lambda g, lang=group[0]: g[0] == lang), histogram(name, lambda g: True)))
            a, m, b = (at(own, s) for s in (0.1, 0.5, 0.9))
            low, high = a - 3 * (m - a), b + 3 * (b - m)
            if name == "word_length":
                room = 3 * high / 2 / n**0.5
                ok = ok and low - room <= ratio[name] <= high + room
            else:
                k = {"symbols": n, "dup_lines": lines, "repeats": n / 10}[name]
                p = min(high / 1000, 1)
                upper = (p + 9 / 2 / k + 3 * (p * (1 - p) / k + 9 / 4 / k / k) ** 0.5) / (1 + 9 / k)
                ok = ok and ratio[name] <= max(upper * 1000, high)
        out[i] = ok
    return out


@pytest.mark.parametrize("prior", [20, 200])
def test_verdicts_equal_a_plain_reading(spark, data, prior):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in table(spark, data, "documents").collect()]
    rows += [(10**6 + i, " ".join(w + "$" * (i % 5) for w in prose(i, 30 + i).split()), "en" if i % 3 else None, "src1") for i in range(60)]
    got = {r["doc_id"]: r["kept"] for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), prior).collect()}
    assert got == plain_verdicts(rows, prior) and 0 < sum(got.values()) < len(got)


def test_thresholds_follow_the_group(spark):
    """One text of long words stays where long words are usual and goes where they are not."""
    wide = lambda i: " ".join(w + w + "ing" for w in prose(i, 60).split())
    rows = [(i, prose(i, 60), "en", "plain") for i in range(900)] + [(2000 + i, wide(i), "en", "wide") for i in range(300)]
    rows += [(5000, wide(5000), "en", "plain"), (5001, wide(5000), "en", "wide")]
    got = {r["doc_id"]: r["kept"] for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[5000] and got[5001] and np.mean([got[r[0]] for r in rows]) > 0.99


def test_classifier(spark, data):
    docs, labels = table(spark, data, "documents"), table(spark, data, "labels")
    got = {r["doc_id"]: r for r in classifier.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    rows = [(r["quality"], got[r["doc_id"]]["score"], got[r["doc_id"]]["held_out"]) for r in labels.collect()]
    seen = [(q, s) for q, s, h in rows if not h]
    assert np.mean([(s >= 0.3) == q for q, s in seen]) > 0.9


def test_classifier_never_sees_held_out_labels(spark, data):
    docs, labels = table(spark, data, "documents"), table(spark, data, "labels")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (classifier.train(docs, x).folded() for x in (labels, turned))
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


def test_classifier_on_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1), (2, 1), (7, 1), (10, 0), (11, 0), (None, 1), (6, None), (6, 3), (8, 1), (8, 0)], "doc_id long, quality int")
    got = classifier.classify(odd_docs, labels).collect()
    assert len(got) == 16 and len({r["score"] for r in got if r["doc_id"] in (3, 4, 5)}) == 1
    assert classifier.classify(no_docs, labels).count() == 0 and classifier.classify(odd_docs, labels.where("false")).count() == 16
    model = classifier.train(odd_docs, labels)
    assert classifier.score(odd_docs, model).columns == [*(c for c in odd_docs.columns if c != "quality_score"), "quality_score"]


def test_thinning_of_labels_leaves_some_at_any_number():
    for share in (0.9, 0.1, 1e-5, 1e-6, 1e-7, 1e-9, 1e-11):
        first, second = classifier.thinning(share)
        assert abs(first / 2**20 * second / 2**20 - share) <= max(2**-20 * (share > 2**-20), 2**-40) and first and second


def test_held_out_documents_are_judged_by_their_text(spark, data):
    docs, labels = table(spark, data, "documents"), table(spark, data, "labels")
    got = classifier.classify(docs, labels)
    met = got.where("held_out").join(labels, "doc_id").select("quality", "predicted").collect()
    assert len(met) > 5 and sum(r["quality"] == r["predicted"] for r in met) / len(met) > 0.8
    # languages, sources and the labels of held-out documents have no effect
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y")})
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(tuple, classifier.classify(other, flipped).collect())) == sorted(map(tuple, got.collect()))


def test_folded_scores_are_the_networks():
    texts = pa.array([prose(i, 20 + i) for i in range(12)] + ["", "a a a"])
    samples = classifier.features(texts)
    model = classifier.fit(samples, np.array([i % 2 for i in range(14)]), epochs=2)
    want = []
    for ids, share in samples:
        z = (model.table[ids] * share[:, None]).sum(axis=0) @ model.output + model.bias
        want.append(1 / (1 + np.exp(z[0] - z[1])))
    assert classifier.Scorer(*model.folded()).score(texts) == pytest.approx(want)


@pytest.mark.parametrize("seed", range(4))
def test_top_k(spark, seed):
    rng = np.random.default_rng(seed)
    n = 400
    x = rng.normal(size=(n, 8)).astype(np.float32)
    x[: n // 3] = x[0]
    if seed == 1:
        x *= 1e12
    rows = [(i * 25, [float(v) for v in x[i]]) for i in range(n)]
    rows += [(1, None), (3, [1.0, None]), (7, [float("nan")] * 8), (11, [float("inf")] * 8), (13, []), (None, [1.0] * 8), (200, [2.0] * 3), (300, [1.0] * 3), rows[4]]
    rows += [rows[7]] * 15 + [rows[8]] * 13 + [rows[n - 1]] * 12  # repeated rows are candidates as often as they come
    df = spark.createDataFrame([(*r, 0, 0.5) for r in rows], "vec_id long, embedding array<double>, rank int, score double").repartition(3)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in balltree.top_k(df).collect())
    asked: dict[int, list[int]] = {}
    vectors = []
    for i, v in rows:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v):
            whole = [max(-(1 << 62), min(1 << 62, int(np.floor(c * 1024.0)))) for c in v]
            vectors.append((i, whole))
            asked[i] = min(asked.get(i, whole), whole)
    want, limit = [], (1 << 63) - 1
    for q, a in asked.items():
        if q % 100 == 0:
            scored = sorted((-max(1 - limit, min(limit, sum(s * t for s, t in zip(a, b, strict=True)))), i) for i, b in vectors if i != q and len(a) == len(b))
            want += [(q, k, i, -s) for k, (s, i) in enumerate(scored[:10], 1)]
    assert got == sorted(want)
    assert balltree.top_k(df.where("false")).count() == 0


def test_pipeline(spark, data):
    docs = table(spark, data, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, data).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() <= before * 2
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data).toPandas()
    encoder = packing.WordEncoder(tokenizer_path())
    _, counts = encoder.encode(pa.array([r["text"] for r in docs.collect()], pa.string()))
    assert packed["length"].sum() == counts.sum() + len(counts) and packed.groupby("sequence_id")["length"].sum().max() <= 2048


def test_entry_without_the_subpackage(tmp_path):
    root = Path(__file__).parents[2]
    for p in root.iterdir():
        if p.name not in ("gistmill", "corpus_pipeline.py", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "gistmill").mkdir()
    for p in (root / "gistmill").iterdir():
        if p.name != "llm":
            (tmp_path / "gistmill" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and o and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_groups_have_fences_of_their_own(spark, data):
    measured = rules.measure(table(spark, data, "documents")).where("n_words >= 10 AND 100 * n_repeat_words <= 20 * n_words")
    got = rules.fences(rules.sketches(measured, ["lang", "source"])).select("fence_word_length").collect()
    assert len({tuple(r[0]) for r in got}) > len(got) / 4
