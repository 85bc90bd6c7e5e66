"""The file chunker: overlapping windows that end at blank lines or line ends. Each window's start
depends on the one before, so it is an Arrow UDF over whole texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.schema import CHUNK_OVERLAP, CHUNK_SIZE, MIN_CHUNK


def split_text(text: str | None, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, least: int = MIN_CHUNK) -> list[str]:
    """A cut lies at the window's last blank line, or without one at its last line end, if that is more than
    half a window of bytes in. Chunks under ``least`` characters are left out."""
    text = (text or "").strip()
    out: list[str] = []
    at = 0
    while at < len(text):
        stop = min(at + size, len(text))
        if stop < len(text):
            window = text[at:stop]
            mark = "\n\n" if "\n\n" in window else "\n"
            cut = window.rfind(mark)
            if cut >= 0 and len(window[:cut].encode()) > size // 2:
                stop = at + cut
        piece = text[at:stop].strip()
        if len(piece) >= least:
            out.append(piece)
        if stop >= len(text):
            break
        at = max(0, stop - overlap)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunk_text(texts: pd.Series) -> pd.Series:
    return texts.map(split_text)
