"""Secret scan, mixing, packing and archives."""

import hashlib
import random
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gistmill.llm import mixing, packing, secrets, warc
from gistmill.llm.queries import tokenizer_path


def plain_base(text):
    kinds = [
        ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    ]
    found = [(m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(kinds) for m in p.finditer(text or "") if ok(m)]
    return ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(found)), [sum(n == k for *_, n in found) for k in ("assign", "access", "hex")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["password", "PASSWD", "api_key", "apiKEY", "toKen", " ", "=", ":", '"', "'", "AKIA", "ABCD1234", "0123456789abcdef", "x", "é", "\n", "ſecret", "12345678"]), max_size=30).map("".join))
def test_base_spans(text):
    assert ",".join(f"{k}:{a}:{b}" for a, b, k in secrets.base_spans(text)) == plain_base(text)[0]
    assert [list(x[0]) for x in secrets.spans(pa.array([text]))] == [secrets.base_spans(text)]


def test_randomness_tells_keys_from_words():
    rng = random.Random(3)
    keys = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40)) for _ in range(200)]
    assert sum(secrets.randomness(k)[1] > 0.05 for k in keys) > 170
    words = ["millstonewheelandgrainbreadflour", "keitlichenlichkeitbeerung", "internationalization/of/the/paths"]
    assert all(secrets.randomness(w)[1] < 0.02 for w in words)


def test_threshold_controls_false_discoveries():
    mixed = np.full(secrets.BINS, 10.0)
    mixed[:5] += 500
    k = secrets.threshold(mixed, 0.05)
    assert 5 <= k < secrets.BINS and secrets.threshold(np.r_[np.full(5, 99.0), np.zeros(secrets.BINS - 5)], 0.05) == secrets.BINS


def test_planted_keys_are_found_and_nothing_else(spark, data):
    """The given documents, of which every one in so many has a key of some encoding in it; thresholds are their own."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").toPandas()
    plain = {r["doc_id"]: r["n_random"] for r in secrets.digest(secrets.scan(spark.createDataFrame(docs, "doc_id long, text string"))).collect()}
    rng = random.Random(9)
    kinds = {"base62": (string.ascii_letters + string.digits, 40), "base32": (string.ascii_uppercase + "234567", 24), "base64url": (string.ascii_letters + string.digits + "-_", 22), "hex": ("0123456789abcdef", 31)}
    for letters, size in kinds.values():
        planted = {}
        for n, i in enumerate(docs["doc_id"]):
            if n % 3 == 0:
                key = "".join(rng.choice(letters) for _ in range(size))
                planted[i] = (len(docs["text"][n]) + 1, len(docs["text"][n]) + 1 + size)
                docs.loc[n, "marked"] = f"{docs['text'][n]} {key} end"
            else:
                docs.loc[n, "marked"] = docs["text"][n]
        got = secrets.scan(spark.createDataFrame(docs[["doc_id", "marked"]].rename(columns={"marked": "text"}), "doc_id long, text string")).collect()
        hits = sum(any((x["start"], x["end"]) == planted[r["doc_id"]] for x in r["random"]) for r in got if r["doc_id"] in planted)
        others = sum(not (r["doc_id"] in planted and (x["start"], x["end"]) == planted[r["doc_id"]]) for r in got for x in r["random"])
        assert hits >= 0.9 * len(planted) and others <= sum(plain.values()) + 0.06 * len(planted)


def test_a_long_text_of_many_spans_takes_linear_time():
    text = " ".join(f"token={'k' * 8}{i} {'Ab3' * 8}{i:x}" for i in range(40_000))
    base, found = next(secrets.spans(pa.array([text])))
    assert len(base) == 40_000 and all(text[a:b].startswith("Ab3") for a, b, *_ in found)


def test_scan_of_odd_documents(odd_docs, no_docs):
    got = secrets.digest(secrets.scan(odd_docs)).collect()
    texts = {(r["doc_id"]): r["text"] for r in odd_docs.collect()}
    assert len(got) == 16
    for r in got:
        base, counts = plain_base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and [r["n_assign"], r["n_access"], r["n_hex"]] == counts
        assert set(base.split(",")) - {""} <= set(r["spans"].split(","))
    assert secrets.scan(no_docs).count() == 0


def test_redaction(spark, odd_docs):
    rng = random.Random(5)
    keys = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40)) for _ in range(60)]
    docs = spark.createDataFrame([(i, f"some words {k} and more", "en", "a", 5) for i, k in enumerate(keys)], "doc_id long, text string, lang string, source string, n_chars long")
    texts = [r["text"] for r in secrets.redact(docs).collect()]
    assert sum("[SECRET]" in t for t in texts) > 50 and all(t.startswith("some words ") and t.endswith(" and more") for t in texts)
    back = {r["doc_id"]: r["text"] for r in secrets.redact(odd_docs).collect()}
    assert back[11] == "[SECRET] [SECRET] [SECRET]" and back[3] is None and back[12].startswith("Ünïcödé")
    assert secrets.redact(odd_docs).columns == odd_docs.columns


def test_poisson_inversion(spark):
    means = [0.0, 0.1, 1.0, 3.7, 20.0, 31.9]
    df = spark.createDataFrame([(m,) for m in means], "m double")
    for r in df.select("m", mixing.poisson_steps(F.col("m")).alias("s")).collect():
        p = upto = np.exp(-r["m"])
        for k, s in enumerate(r["s"][1:], 1):
            assert s == pytest.approx(upto := upto + (p := p * r["m"] / k), abs=1e-12)
        assert r["s"][-1] == pytest.approx(1, abs=1e-9)


def test_mixing_reaches_targets(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x" * 9).alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("source"))
    out = mixing.replicate(docs, {"hot": 1.0, "cold": 3.0})
    counts = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert counts["cold"] == pytest.approx(4500, rel=0.06) and counts["hot"] == pytest.approx(1500, rel=0.1)
    again = mixing.replicate(docs.repartition(7), {"hot": 1.0, "cold": 3.0}).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in again} == counts
    assert mixing.replicate(docs, {"other": 1.0}).count() == 0


def test_mixing_of_odd_documents(odd_docs, no_docs):
    out = mixing.replicate(odd_docs, epochs=40.0)
    assert {r["source"] for r in out.select("source").distinct().collect()} >= {"a", "b", "c", None}
    assert len({r["n"] for r in out.where("doc_id = 0").groupBy("copy").agg(F.count("*").alias("n")).collect()}) == 1
    assert set(out.columns) == {*odd_docs.columns, "mix_rate", "shuffle_key"} and mixing.replicate(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbÉéßσΣ'sS.,!&<|>endoftx 012½漢\n\t  ́İ-_", max_size=60), max_size=5))
def test_word_encoder_equals_the_tokenizer(texts):
    encoder = packing.WordEncoder(tokenizer_path())
    ids, counts = encoder.encode(pa.array([*texts, "<|endoftext|> x", None], pa.string()))
    want = [e.ids for e in encoder.tokenizer.encode_batch([*texts, "<|endoftext|> x", ""], add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=120))
def test_sum_of_squares_packs_without_overlap(lengths):
    bins, offsets = packing.sum_of_squares(np.array(lengths, np.int64), 64)
    for b in set(bins.tolist()):
        own = sorted((o, n) for x, o, n in zip(bins, offsets, lengths, strict=True) if x == b)
        assert own[0][0] == 0 and all(a + n == c for (a, n), (c, _) in zip(own, own[1:])) and sum(own[-1]) <= 64


def test_packing_of_odd_documents(odd_docs, no_docs):
    out = packing.pack(odd_docs, tokenizer_path(), capacity=256).toPandas()
    encoder = packing.WordEncoder(tokenizer_path())
    want = []
    for r in odd_docs.collect():
        ids = [*encoder.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want += [(r["doc_id"] if r["doc_id"] is not None else -1, k, s, len(ids[s : s + 256]), zlib.crc32(np.array(ids[s : s + 256], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 256))]
    assert sorted(map(tuple, out[["doc_id", "piece", "start", "length", "ids_crc32"]].fillna(-1).astype("int64").values.tolist())) == sorted(want)
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *np.cumsum(own["length"])[:-1]] and own["length"].sum() <= 256
    assert packing.pack(no_docs, tokenizer_path()).count() == 0


def test_chunks_round_trip():
    for n in (0, 1, 8191, 8192, 8193, 50_000):
        data = random.Random(n).randbytes(n)
        assert warc.unchunked(warc.chunked(data)) == data
    for bad in (b"", b"5\r\nabc", b"3\r\nabcXX0\r\n\r\n", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\n\r\n") == b"abc"


def test_archives(spark):
    big, inner = "<p>ü</p>" * 40_000, "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40
    rows = [(1, "u1", big), (2, "u2", big), (3, "u\r\n3", big), (4, "u4", "x" * 999), (5, "u5", "x" * 999), (6, None, None), (7, "u7", ""), (8, "u8", inner), (9, "u9", "y" * 1000), (9, "u9", "y" * 1000), (3, "u3", "z" * 1200), (None, "u", "z" * 1200)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = sorted(((r["page_id"] or 0), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["ok"]) for r in warc.read(spark, warc.write(pages, segment=1000)).collect())
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        first = max(same, default=None)
        again = len(data) >= 1000 and page != first
        want.append((page or 0, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", first if again else None, True))
    assert got == sorted(want, key=lambda r: r[:4])
    assert warc.read(spark, warc.write(pages.where("false"))).count() == 0


def test_missing_segment_is_told(spark):
    path = warc.write(spark.createDataFrame([(1, "u", "q" * 5000)], "page_id long, url string, html string"), segment=1000)
    records = warc.read_records(spark, path)
    assert warc.reassemble(records).first()["ok"]
    assert not warc.reassemble(records.where("segment <> 3")).first()["ok"]
