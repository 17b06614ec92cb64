"""Media columns: byte payloads as lossless WebP pictures and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp, webp_writer
from .common import by_batches, parts_of, text_of

#: Samples in a row of a picture; payloads are padded to whole rows.
ROW = 64


def write_pictures(payload: bytes) -> bytes:
    """WebP files on end, of at most webp_writer.MOST_ROWS rows each."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    return b"".join(webp_writer.encode_grey(rows[i : i + webp_writer.MOST_ROWS]) for i in range(0, len(rows), webp_writer.MOST_ROWS))


def read_pictures(media: bytes) -> np.ndarray:
    """The grey samples of all pictures, row by row."""
    return np.concatenate([(p >> 8).astype(np.uint8).reshape(-1) for p in webp.decode(media)])


def features(samples: np.ndarray) -> str:
    """rows:least:greatest:different values:sum:sum of steps between neighbours."""
    steps = np.abs(np.diff(samples.astype(np.int16))).sum(dtype=np.int64)
    used = np.flatnonzero(np.bincount(samples, minlength=256))
    return f"{samples.size // ROW}:{used[0]}:{used[-1]}:{used.size}:{samples.sum(dtype=np.int64)}:{steps}"


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text in UTF-8, padded with zeros to a positive multiple of ROW, as pictures.

    Null text is the empty text, one row of zeros. A text of more than
    ROW * webp_writer.MOST_ROWS bytes takes several pictures. Equal texts have
    equal media. Repeated rows are stored alike; ties don't occur. No rows: no
    rows. Other columns are ignored, whatever their names. A task holds about a
    megabyte of texts and their media at a time, or one longer text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in parts_of(batch, "text"):
                raw = [t.encode("utf-8", "replace") for t in part["text"]]
                media = [write_pictures(b.ljust(max(ROW, -(-len(b) // ROW) * ROW), b"\0")) for b in raw]
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_bytes": list(map(len, raw)), "media": media})

    return by_batches(docs.select("doc_id", text_of().alias("text")), run, "n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """stored (doc_id, n_bytes, media) with pixels, the samples read back, and feature.

    Media that is no lossless WebP, or ends early, raises an error; so does null.
    Repeated rows are read alike. No rows: no rows. Other columns are ignored. Media
    is read about a megabyte at a time, or one longer value.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in parts_of(batch, "media"):
                samples = [read_pictures(m) for m in part["media"]]
                yield part.assign(pixels=[s.tobytes() for s in samples], feature=list(map(features, samples)))

    return by_batches(stored.select("doc_id", "n_bytes", "media"), run, "n_bytes long, media binary, pixels binary, feature string")


def media_digest(read: DataFrame) -> DataFrame:
    n = F.octet_length("pixels")
    return read.select(
        "doc_id",
        "n_bytes",
        n.cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(pixels, -{ROW}, {ROW})")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
