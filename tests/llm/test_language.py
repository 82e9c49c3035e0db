"""Code lengths against a literal coder, and held-out accuracy."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from gistmill.llm import language
from gistmill.llm.language import ORDER


def counted(texts):
    n = defaultdict(Counter)
    for t in texts:
        data = b"\n" * ORDER + t.encode()
        for i in range(ORDER, len(data)):
            for k in range(ORDER + 1):
                n[data[i - k : i]][data[i]] += 1
    return n


def literal_bits(n, text):
    """Method C with exclusion, byte by byte, as a coder would do it."""
    data, total = b"\n" * ORDER + text.encode(), 0.0
    for i in range(ORDER, len(data)):
        out, p = set(), 1.0
        for k in range(ORDER, -1, -1):
            seen = n.get(data[i - k : i])
            if not seen:
                continue
            rest = {s: c for s, c in seen.items() if s not in out}
            if not rest:
                continue
            whole = sum(rest.values()) + len(rest)
            if data[i] in rest:
                p *= rest[data[i]] / whole
                break
            p *= len(rest) / whole
            out |= set(rest)
        else:
            p *= 1 / (256 - len(out))
        total -= math.log2(p)
    return total


def code(s: bytes) -> int:
    return int.from_bytes(s, "big")


def tree_of(n, least=1):
    rows = [(len(c), code(c + bytes([s])), k) for c, seen in n.items() for s, k in seen.items() if k >= least]
    return language.Tree(*(np.array(x) for x in zip(*rows, strict=True)))


TEXTS = {"en": ["the stone mill and the river", "then they went to the water"], "fr": ["le moulin était près de la rivière", "elle a été à l'eau"], "x": ["aaaa", "ab"]}


def test_code_lengths_are_those_of_a_coder():
    for texts in TEXTS.values():
        for least in (1, 2):
            n = counted(texts)
            kept = {c: {s: k for s, k in seen.items() if k >= least} for c, seen in n.items()}
            tree = tree_of(n, least)
            for text in ["the mill", "été", "zzz€", "aab", "\x00\x01", texts[0]]:
                codes, _, context = language._codes([b"\n" * ORDER, text.encode()])
                assert abs(np.delete(tree.bits(codes), context).sum() - literal_bits(kept, text)) < 1e-6


def test_probabilities_after_a_context_add_up_to_one():
    tree = tree_of(counted(TEXTS["en"]))
    for context in (b"the ", b"zzzz", b"\n\n\n\n", b"zzzt", b"wate"):
        codes = np.array([code(context + bytes([s])) for s in range(256)])
        assert abs((2.0 ** -tree.bits(codes)).sum() - 1) < 1e-9


def test_predictions_against_the_coder(spark):
    rng = random.Random(5)
    words = {"en": "the and mill stone water then".split(), "fr": "le la était rivière eau près".split(), "de": "der die Mühle Wasser und größer".split()}
    rows = []
    for i in range(200):
        lang = rng.choice(list(words))
        rows.append((i, " ".join(rng.choices(words[lang], k=rng.randrange(1, 9))), lang if i % 11 else None))
    rows += [(200, None, "en"), (201, "", "en"), (202, "123 !?", "fr"), (203, "é" * 5_000_000 + " rivière", None), (None, "the mill", "en"), (205, "und der", "de"), (205, "und der", "de"), (204, "λόγος", "fr")]
    df = spark.createDataFrame([(*r, 0.5, True) for r in rows], "doc_id long, text string, lang string, score double, held_out boolean").repartition(3)
    got = language.identify(df).collect()
    n = {x: counted(t for i, t, y in rows if y == x and t and i is not None and zlib.crc32(str(i).encode()) % 4 != 2) for x in words}
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for i, text, _ in rows:
        assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for r in by[i])
        if i in (200, 201, 202):
            assert [(r["lang_pred"], r["score"]) for r in by[i]] == [("und", 0.0)]
        elif i != 203:
            bits = {x: literal_bits(n[x], text) for x in n}
            want = 1 / sum(2 ** (min(bits.values()) - b) for b in bits.values())
            for r in by[i]:
                assert abs(bits[r["lang_pred"]] - min(bits.values())) < 1e-6 and abs(r["score"] - want) < 1e-6
    assert by[203][0]["lang_pred"] == "fr"


def test_a_small_model_keeps_a_tree_and_its_bound(spark):
    rows = [(i, t * 40, x) for i, (x, t) in enumerate((x, t) for x, ts in TEXTS.items() for t in ts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for entries, total in ((20, 1 << 21), (1 << 16, 150)):
        model = language.learn(df.withColumn("doc_id", F.col("doc_id") * 0 + 1), entries, total)
        assert sum(len(c) for _, c, _ in model.values()) <= min(total, entries * 3 * (ORDER + 1))
        for depth, codes, n in model.values():
            held = set(zip(depth.tolist(), codes.tolist(), strict=True))
            assert all(k == 0 or (k - 1, c & ((1 << 8 * k) - 1)) in held for k, c in held)
            language.Tree(depth, codes, n).bits(np.array([code(b"the m")]))


def test_nothing_to_learn_and_no_rows(spark):
    df = spark.createDataFrame([(1, "text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(df).collect()) == [(1, "und", 0.0), (2, "und", 0.0)]
    assert language.identify(df.where("false")).count() == 0


def test_held_out_accuracy_and_inputs(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = language.identify(docs)
    met = got.where("held_out").join(docs.select("doc_id", "lang").where("lang is not null"), "doc_id")
    n, right = met.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 30 and right / n > 0.95
    # the languages of held-out documents, and sources, are no input
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    other = language.identify(docs.withColumns({"lang": F.when(held, "zz").otherwise(F.col("lang")), "source": F.lit("s")}))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, other.collect()))
