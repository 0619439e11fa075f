"""Chunking."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADING = re.compile(r"^={2,6}[ \t]*(.+?)[ \t]*={2,6}[ \t]*$", re.M)
CHUNKS = "array<struct<ord:int,section:string,body:string>>"


def fixed_stride(text: Column, size: int = 800, overlap: int = 100) -> Column:
    """Slices of ``size`` characters that overlap; one slice for a shorter text."""
    step = size - overlap
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - 1), F.lit(step))
    return F.transform(places, lambda i: F.substring(text, i + 1, F.lit(size)))


def split_chunks(text: str | None, most: int = 800, overlap: int = 100, least: int = 50, blank: str = r"\n\s*\n") -> list[tuple[int, str, str]]:
    """Sections by headings; paragraphs packed greedily up to ``most``; a buffer that overflows is
    given out only from ``least`` on (else lost, as the semantics ask); longer paragraphs are cut with
    an overlap and their tail opens the next buffer."""
    out: list[tuple[int, str, str]] = []
    cuts = [(0, 0, "")] + [(m.start(), m.end(), m[1]) for m in HEADING.finditer(text or "")]
    for k, (_, start, section) in enumerate(cuts):
        end = cuts[k + 1][0] if k + 1 < len(cuts) else len(text or "")
        held = ""
        for paragraph in filter(None, map(str.strip, re.split(blank, (text or "")[start:end]))):
            if len(held) + len(paragraph) + 1 <= most:
                held = f"{held}\n{paragraph}" if held else paragraph
                continue
            if len(held) >= least:
                out.append((len(out), section, held))
            held = paragraph
            while len(held) > most:
                out.append((len(out), section, held[:most]))
                held = held[most - overlap :]
        if len(held) >= least:
            out.append((len(out), section, held))
    return out


def chunk_documents(docs: DataFrame, text: str = "text", blank: str = r"\n\s*\n") -> DataFrame:
    """All columns but the text, and one row for each chunk."""

    @F.pandas_udf(CHUNKS)
    def chunks(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: [{"ord": o, "section": s, "body": b} for o, s, b in split_chunks(t, blank=blank)])

    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.inline(chunks(F.col(text))).alias("ord", "section", "chunk_text"))
