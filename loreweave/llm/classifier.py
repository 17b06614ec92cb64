"""Quality scores from random Fourier features of document statistics.

A text is measured by Spark expressions. Its statistics, standardised, are drawn
to cosines of random projections, whose products approximate a Gaussian kernel.
A ridge regression on the cosines solves normal equations, and these are sums over
rows: every task adds up its own, Spark adds up the tasks', and the driver solves
a system whose size is the number of cosines, whatever the rows.

The equations are summed by fold, so that each labelled row is also scored by an
equation without its fold. Isotonic regression on those scores, in bins of a fixed
width, turns a score to the share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_batches, text_of
from .quality import measured

#: Cosines; the width of the kernel in standard deviations; the ridge, a row's share; folds.
COSINES, WIDTH, RIDGE, FOLDS, SEED = 192, 5.0, 1e-4, 4, 12
#: Raw scores are clipped to these and cut to so many bins.
LOWEST, HIGHEST, BINS = -0.5, 1.5, 1024
#: A score also carries this share of the raw score, so that few scores are equal.
TIES = 1e-3
#: Rows whose cosines a task holds at once, and labelled rows that a task sums up.
HELD, ROWS_PER_TASK = 2048, 50_000
#: A row with this remainder of its key's checksum by 5 is held out.
HELD_OUT = 0


def checksum(doc_id: Column) -> Column:
    """CRC-32 of doc_id as text; a null one is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of its text: logarithms of sizes, and shares, which lie in 0 to 1 or near it."""
    text = text_of()
    without = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    marked = docs.select("doc_id", text.alias("text")).withColumns(
        {
            "n_chars": F.length(text),
            "n_upper": without(r"\p{Lu}+"),
            "n_digits": without(r"[0-9]+"),
            "n_marks": without(r"[!?]+"),
        }
    )
    m, share = measured(marked), lambda part, whole: F.col(part) / F.greatest(F.col(whole), F.lit(1))
    return m.select(
        "doc_id",
        F.log1p("n_chars").alias("chars"),
        F.log1p("n_words").alias("words"),
        F.log1p("n_lines").alias("lines"),
        F.log1p(share("word_chars", "n_words")).alias("word_length"),
        F.least(share("n_symbols", "n_words"), F.lit(4)).alias("symbols"),
        share("n_dup_lines", "n_lines").alias("dup_lines"),
        share("n_repeat_words", "n_words").alias("repeat_words"),
        share("n_stop_words", "n_words").alias("stop_words"),
        share("n_bullet_lines", "n_lines").alias("bullet_lines"),
        share("n_ellipsis_lines", "n_lines").alias("ellipsis_lines"),
        *(share(c, "n_chars").alias(c[2:]) for c in ("n_upper", "n_digits", "n_marks")),
    )


@dataclass(frozen=True)
class Features:
    """Standardised statistics, drawn to cosines. A statistic that never varies has scale 1."""

    columns: list[str]
    mean: np.ndarray
    scale: np.ndarray

    def __call__(self, rows: pd.DataFrame) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        directions, phases = rng.normal(size=(len(self.columns), COSINES)) / WIDTH, rng.uniform(0, 2 * np.pi, COSINES)
        standard = np.clip((rows[self.columns].to_numpy(np.float64) - self.mean) / self.scale, -8, 8)
        return np.c_[np.cos(standard @ directions + phases) * np.sqrt(2 / COSINES), np.ones(len(rows))]


def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches in pieces of HELD rows."""
    for batch in batches:
        for at in range(0, len(batch), HELD):
            yield batch.iloc[at : at + HELD]


def fit_features(rows: DataFrame, columns: list[str]) -> tuple[Features, int] | None:
    """Means and deviations of the labelled rows, and their number; None without any."""
    found = rows.agg(F.count(F.lit(1)), *(F.avg(c) for c in columns), *(F.stddev_pop(c) for c in columns)).first()
    if not found[0]:
        return None
    mean, scale = np.array(found[1 : len(columns) + 1]), np.array(found[len(columns) + 1 :])
    return Features(columns, mean, np.where(scale > 1e-9, scale, 1.0)), found[0]


def normal_equations(rows: DataFrame, features: Features) -> np.ndarray:
    """For each fold the sums of x'x and x'y, (FOLDS, COSINES + 1, COSINES + 2)."""
    width = COSINES + 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((FOLDS, COSINES + 1, width))
        for batch in pieces(batches):
            x = features(batch)
            for fold in range(FOLDS):
                own = batch["fold"].to_numpy() == fold
                sums[fold] += x[own].T @ np.c_[x[own], batch["y"].to_numpy()[own]]
        yield pd.DataFrame({"place": np.arange(sums.size // width), "sums": list(sums.reshape(-1, width))})

    parts = rows.mapInPandas(run, "place int, sums array<double>").select("place", F.posexplode("sums").alias("at", "value"))
    summed = parts.groupBy("place", "at").agg(F.sum("value").alias("value")).toPandas()
    found = np.zeros((FOLDS * (COSINES + 1), width))
    found[summed["place"], summed["at"]] = summed["value"]
    return found.reshape(FOLDS, COSINES + 1, width)


def solved(sums: np.ndarray) -> np.ndarray:
    """The ridge regression's weights; the constant, the last one, isn't shrunk."""
    ridge = RIDGE * max(sums[-1, COSINES], 1.0) * np.eye(COSINES + 1)
    ridge[-1, -1] = 1e-9
    return np.linalg.solve(sums[:, :-1] + ridge, sums[:, -1])


def isotonic(at: np.ndarray, rows: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pool adjacent violators: first and last bin of each block, and the blocks' shares of label 1, which rise."""
    blocks: list[tuple[float, float, float, float]] = []
    for x, n, y in zip(at.tolist(), rows.tolist(), ones.tolist(), strict=True):
        block = (x, x, n, y)
        while blocks and blocks[-1][3] * block[2] >= block[3] * blocks[-1][2]:
            first, _, m, z = blocks.pop()
            block = (first, x, m + block[2], z + block[3])
        blocks.append(block)
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks]), np.array([b[3] / b[2] for b in blocks])


def raw_scores(rows: pd.DataFrame, features: Features, weights: np.ndarray) -> np.ndarray:
    return np.clip(features(rows) @ weights, LOWEST, HIGHEST)


def calibration(rows: DataFrame, features: Features, by_fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and shares, the isotonic regression of labels on scores by the weights of the other folds; at most BINS sums reach the driver.

    The share is the same from a block's first bin to its last, and rises evenly to the next block's.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            scores = np.clip((features(batch) * by_fold[batch["fold"].to_numpy()]).sum(axis=1), LOWEST, HIGHEST)
            bins = np.minimum((scores - LOWEST) / (HIGHEST - LOWEST) * BINS, BINS - 1).astype(np.int32)
            yield pd.DataFrame({"bin": bins, "y": batch["y"]})

    sums = rows.mapInPandas(run, "bin int, y double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")).toPandas().sort_values("bin")
    first, last, shares = isotonic(LOWEST + (sums["bin"].to_numpy() + 0.5) * (HIGHEST - LOWEST) / BINS, sums["n"].to_numpy(), sums["ones"].to_numpy())
    return np.c_[first, last].reshape(-1), np.repeat(shares, 2)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    All labelled rows that aren't held out are learnt from; labels (doc_id,
    quality) say 1 for good. Only the text makes a score.

    Null and empty texts are measured as empty ones and get a score too. A null doc_id is
    held out and has no label. A label of null is none; several labels of a
    document count as their mean. Repeated rows are scored alike, and each is learnt
    from. Equal texts have equal scores. Very long texts are measured whole. Without a
    row to learn from, every score is 0.5. No rows: no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "classifier")
    measures = scratch.write(statistics(docs))  # the texts are read once
    columns = [c for c in measures.columns if c != "doc_id"]
    marks = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    learnt = measures.filter(checksum(F.col("doc_id")) % 5 != HELD_OUT).join(marks, "doc_id")
    table = learnt = scratch.write(learnt.select(*columns, "y", (F.crc32(F.concat(F.lit("fold "), F.col("doc_id").cast("string"))) % FOLDS).cast("int").alias("fold")))
    fitted, features, weights, points = fit_features(learnt, columns), None, np.zeros(COSINES + 1), (np.zeros(1), np.full(1, 0.5))
    if fitted is not None:
        features, n = fitted
        learnt = learnt.coalesce(-(-n // ROWS_PER_TASK))  # a task makes as many sums however few rows it has
        sums = normal_equations(learnt, features)
        whole = sums.sum(axis=0)
        weights, points = solved(whole), calibration(learnt, features, np.array([solved(whole - s) for s in sums]))
    scratch.drop(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            raw = raw_scores(batch, features, weights) if features is not None else np.full(len(batch), 0.5)
            score = (1 - TIES) * np.interp(raw, *points) + TIES * (raw - LOWEST) / (HIGHEST - LOWEST)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": score if features is not None else raw})

    held_out = (checksum(F.col("doc_id")) % 5 == HELD_OUT).alias("held_out")
    return by_batches(measures, run, "score double").select("doc_id", held_out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
