"""Secret scan: known key formats, and strings that pass a battery of randomness tests.

Besides the fixed formats, every run of code-like characters gets an encoding (hex, base32, base62, base64) and the
p-values of three tests of the hypothesis "these characters are independent and uniform on that alphabet": chi-squared
uniformity, runs above and below the middle of the alphabet, and lag-one serial correlation. Words of a language fail
them, keys do not. Short strings pass too easily, so which p-values count as random is set per encoding and length
band: over all candidates of a stratum the share of true random strings among those above a threshold is estimated from
the p-values near 1, and the smallest threshold with a false-discovery share of at most `fdr` is used. The strata
are a fixed small table, whatever the input.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, cut

#: Fixed formats, in the order in which kinds with one start are listed.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
#: What a candidate of the tests may be made of, and the alphabets that are tried from the smallest on.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ALPHABETS = (("hex", "0123456789abcdef"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"))
#: Upper ends of the length bands, and how many bins the p-values of a stratum are counted in.
BANDS, BINS = (24, 32, 40, 48, 64, 128), 50
FDR = 0.05

PLACES = {name: {c: i for i, c in enumerate(letters)} for name, letters in ALPHABETS}


#: What a text must hold for each pattern to be tried on it; found for many texts at once, in linear time.
HINTS = (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]""", "AKIA[A-Z0-9]{12}", "[0-9a-f]{32}", "[A-Za-z0-9+/_=-]{20}")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed formats, in code points: leftmost, not overlapping per kind."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: the chi-squared tail with 2 a degrees of freedom at 2 x."""
    if x <= 0:
        return 1.0
    scale = math.exp(min(0.0, a * math.log(x) - x - math.lgamma(a)))
    if x < a + 1:
        term = total = 1 / a
        for k in range(1, 1000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-12:
                break
        return max(0.0, 1 - scale * total)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for k in range(1, 1000):
        b += 2
        n = -k * (k - a)
        d = 1 / (n * d + b or 1e-300)
        c = b + n / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return min(1.0, scale * h)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def randomness(text: str) -> tuple[str, float] | None:
    """(encoding, combined p-value) of a string, None if no alphabet holds it. High: nothing speaks against random."""
    body = text.rstrip("=")
    letters = set(body)
    name = next((n for n, _ in ALPHABETS if letters <= PLACES[n].keys()), None)
    if name is None or len(body) < 8:
        return None
    place = PLACES[name]
    size, x = len(place), np.fromiter((place[c] for c in body), float, len(body))
    n = len(x)
    # With few characters per letter the alphabet is folded into fewer equal cells, so that the tail is near chi-squared.
    cells = max(2, min(size, 1 << int(math.log2(max(2, n / 4)))))
    counts = np.bincount((x * cells / size).astype(int), minlength=cells)
    shares = np.bincount((np.arange(size) * cells / size).astype(int), minlength=cells) / size
    uniform = _upper_gamma((cells - 1) / 2, float(((counts - n * shares) ** 2 / (n * shares)).sum()) / 2)
    high = x >= size / 2
    ups = int(high.sum())
    downs = n - ups
    if ups and downs:
        mean = 2 * ups * downs / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        runs = _two_sided((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(spread)) if spread > 0 else 0.0
    else:
        runs = 0.0
    about = x - x.mean()
    power = float(about @ about)
    serial = _two_sided((float(about[1:] @ about[:-1]) / power + 1 / n) * math.sqrt(n)) if power else 0.0
    # letters of a kind that stay together (words, CamelCase, numbers) are the mark of names in code
    kinds = np.array([c.isdigit() + 2 * c.isupper() for c in body])
    share = np.bincount(kinds, minlength=4) / n
    alike = float((share**2).sum())
    classes = _two_sided((float((kinds[1:] == kinds[:-1]).mean()) - alike) / math.sqrt(max(alike * (1 - alike), 1e-9) / (n - 1))) if alike < 1 else 0.0
    p = [max(v, 1e-12) for v in (uniform, runs, serial, classes)]
    return name, _upper_gamma(len(p), -sum(math.log(v) for v in p))  # Fisher's combination


def stratum(name: str, length: int) -> int:
    return [n for n, _ in ALPHABETS].index(name) * (len(BANDS) + 1) + bisect_right(BANDS, length)


def spans(texts: pa.Array) -> Iterator[tuple[list[tuple[int, int, str]], list[tuple[int, int, int, int]]]]:
    """Per text the fixed spans, and the candidates outside them as (start, end, stratum, p-value bin)."""
    hints = np.stack([pc.match_substring_regex(texts, h).to_numpy(zero_copy_only=False).astype(bool) for h in HINTS])
    fixed, coded = hints[:3].any(axis=0), hints[3]
    for k in range(len(texts)):
        base, found = [], []
        if fixed[k] or coded[k]:
            text = texts[k].as_py()
            base = base_spans(text) if fixed[k] else []
            starts = sorted(a for a, _, _ in base)
            reach = list(accumulate((b for _, b, _ in sorted(base)), max))  # how far the spans up to each start go
            for m in CANDIDATE.finditer(text) if coded[k] else ():
                before = bisect_left(starts, m.end())
                if not (before and reach[before - 1] > m.start()) and (got := randomness(m[0])):
                    found.append((m.start(), m.end(), stratum(got[0], len(m[0])), min(BINS - 1, int(got[1] * BINS))))
        yield base, found


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        got = spans(pc.fill_null(batch.column("text"), ""))
        rows = [{"doc_id": d, "base": [dict(zip(("start", "end", "kind"), x, strict=True)) for x in b], "found": [dict(zip(("start", "end", "stratum", "bin"), x, strict=True)) for x in f]} for d, (b, f) in zip(batch.column("doc_id").to_pylist(), got, strict=True)]
        yield pa.RecordBatch.from_pylist(rows, schema=SCANNED)


SCANNED = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))), ("found", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.int32()), ("bin", pa.int32())])))])
SCANNED_SQL = "doc_id long, base array<struct<start:long,end:long,kind:string>>, found array<struct<start:long,end:long,stratum:int,bin:int>>"


def threshold(counts: np.ndarray, fdr: float) -> int:
    """First p-value bin from which on at most a share `fdr` is not random; BINS if none.

    The bins above one half hold random strings almost alone, so twice their mean height is the number of random
    strings in every bin.
    """
    level = counts[BINS // 2 :].mean()
    for k in range(1, BINS):
        above = counts[k:].sum()
        if above and 1 - min(1.0, level * (BINS - k) / above) <= fdr:
            # too few strings to tell: the stratum must hold more than chance alone would leave
            return k if above >= 3 else max(k, BINS // 10)
    return BINS


def _thresholds(found: DataFrame, fdr: float) -> list[int]:
    """First random bin per stratum, from the counts of a fixed number of strata and bins."""
    table = np.zeros((len(ALPHABETS) * (len(BANDS) + 1), BINS))
    for r in found.select(F.explode("found").alias("f")).groupBy("f.stratum", "f.bin").count().collect():
        table[r["stratum"], r["bin"]] = r["count"]
    return [threshold(row, fdr) for row in table]


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """One row per row of `docs`: doc_id, base spans, and random spans that passed, each an array of structs.

    Null and empty texts have no spans; random spans never overlap fixed ones, and are runs of at least 20 characters of
    an encoding's alphabet; repeated rows give repeated rows; other columns are left out; an empty table gives no rows.
    A text of any length is scanned whole, in time that grows with it; a worker holds it once.
    """
    scanned = cut(_plain(docs).mapInArrow(_scan, SCANNED_SQL), "secrets")
    least = F.array(*map(F.lit, _thresholds(scanned, fdr)))
    random = F.filter("found", lambda f: f["bin"] >= F.col("least")[f["stratum"]])
    named = F.transform(random, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), F.lit("random").alias("kind")))
    return scanned.withColumn("least", least).select("doc_id", "base", named.alias("random"))


def redact(docs: DataFrame, fdr: float = FDR, mark: str = "[SECRET]") -> DataFrame:
    """The rows of `docs`, same columns, with every span in `text` replaced by `mark`; `n_chars` follows if it is there.

    All rows stay, and so do texts without spans, null ones included. The text is read twice, once for the thresholds.
    """
    least = _thresholds(_plain(docs).mapInArrow(_scan, SCANNED_SQL), fdr)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            texts = batch.column("text").to_pylist()
            for k, (base, found) in enumerate(spans(pc.fill_null(batch.column("text"), ""))):
                hidden = sorted([(a, b) for a, b, _ in base] + [(a, b) for a, b, s, p in found if p >= least[s]])
                out, at = [], 0
                for a, b in hidden:
                    if b > at:
                        out += [texts[k][at : max(a, at)], mark if a >= at else ""]
                        at = b
                if out:
                    texts[k] = "".join(out) + texts[k][at:]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts per fixed kind, sha256 of the fixed spans and all spans as text."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    many = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    order = lambda a: F.transform(F.array_sort(F.transform(a, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("nth"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return found.select("doc_id", many("assign").alias("n_assign"), many("access").alias("n_access"), many("hex").alias("n_hex"), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(order(F.concat("base", "random"))).alias("spans"), F.size("random").cast("long").alias("n_random"))
