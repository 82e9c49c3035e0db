"""Parts of report texts that need more than a pattern: pain points and categories (Arrow functions)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .text import STARS

# How reports head a pain point, a severity and a category.
HEAD = re.compile(r"(?m)^[^\S\n]*(?:(?:###\s*)?\d+[.、]\s*共性痛点[：:]|(?:###\s*)?痛点\s*\d+[：:]|\*\*共性痛点\d+[：:])[^\S\n]*(.*)$")
SEVERITY = re.compile(r"严重程度[：:]\s*(.+?)(?:\*\*|）|$)", re.M)
LABEL = re.compile(r"^-?\s*\*{0,2}(?:表现|影响|根因|具体数据)[：:]\*{0,2}\s*")
CATEGORY = re.compile(r"(?m)^[^\S\n]*###\s*类别\s*\d+[：:][^\S\n]*(.*)$")
NOT_BOLD, NOT_CELLS = ("代表性需求",), ("需求", "代表性原文")

POINT = StructType([StructField(n, StringType()) for n in ("title", "severity", "description", "evidence")])
GROUP = StructType([StructField("name", StringType()), StructField("items", ArrayType(StringType()))])


def level(raw: str) -> str:
    """A severity's level from stars or words; the text itself where it names none."""
    stars = raw.count("★")
    if stars:
        return next(name for n, name in STARS.items() if stars >= n)
    high, middle = "高" in raw, "中" in raw
    return "中到高" if high and middle else "高" if high else "中" if middle or not raw.strip() else raw.strip()


def _sections(pattern: re.Pattern, text: str) -> list[tuple[str, str]]:
    """(heading, text up to the next heading of any kind) pairs."""
    parts = pattern.split(text)
    return [(h.strip(), re.split(r"(?m)^\s*###", b, maxsplit=1)[0]) for h, b in zip(parts[1::2], parts[2::2], strict=True)]


def points_of(text: str) -> list[tuple[str, str, str, str]]:
    out = []
    for head, body in _sections(HEAD, text):
        found = SEVERITY.search(head) or SEVERITY.search(body)
        title = re.sub(r"\s*[—–]+$", "", re.sub(r"（严重程度.*?）|\*\*$", "", head).strip()).strip()
        lines = [LABEL.sub("", x.strip()) for x in body.split("\n") if x.strip()]
        if title:
            described = " ".join(x for x in lines if x and not x.startswith("**"))[:300]
            out.append((title, level(found[1]) if found else "中", described, described[:200]))
    return out


def _item(line: str) -> str | None:
    """What a line of a category names: its first bold words, or the first cell of a table row that is no head."""
    if bold := re.search(r"\*\*(.*?)\*\*", line):
        name, skip = bold[1].strip().rstrip("：:"), NOT_BOLD
    elif line.startswith("|") and not line.startswith(("|#", "| -")) and line.count("|") > 1:
        name, skip = line.split("|")[1].strip(), NOT_CELLS
    else:
        return None
    return name if name and len(name) < 80 and name not in skip and not name.startswith("---") else None


def categories_of(text: str, most: int = 5) -> list[tuple[str, list[str]]]:
    parts = CATEGORY.split(text)
    return [(n.strip(), [i for x in b.split("\n") if (i := _item(x.strip()))][:most]) for n, b in zip(parts[1::2], parts[2::2], strict=True) if n.strip()]


@F.pandas_udf(ArrayType(POINT))
def pain_points(texts: pd.Series) -> pd.Series:
    """Title, severity, description and evidence (its beginning) of each pain point of a report."""
    return texts.map(lambda t: [dict(zip(POINT.names, p, strict=True)) for p in points_of(t or "")])


@F.pandas_udf(ArrayType(GROUP))
def categories(texts: pd.Series) -> pd.Series:
    """Name and up to five items of each category of a report."""
    return texts.map(lambda t: [{"name": n, "items": i} for n, i in categories_of(t or "")])
