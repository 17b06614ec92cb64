"""Pieces of texts, cleaned as they come.

A placeholder may be cut by the end of a piece. So what may still become one is
kept back until the next piece of its text decides, and whatever the pieces are,
together they give the cleaned text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from loreweave.functions.text import STREAMED

#: Java's classes \\s and \\w are those of ASCII.
_WHOLE = re.compile(STREAMED, re.ASCII)
_BEGUN = re.compile(r"\[(?:o(?:b(?:j(?:e(?:c(?:t(?:\s+\w*)?)?)?)?)?)?)?\Z|<(?:[a-z]*)\Z", re.ASCII)
_TAGS = ("<undefined>", "<null>", "<empty>")


def cleaned(held: str, piece: str) -> tuple[str, str]:
    """What can be given on of the held text and a piece behind it, and what is held now: the beginning of a placeholder."""
    text, out, at = held + piece, [], 0
    for found in _WHOLE.finditer(text):
        out.append(text[at : found.start()])
        at = found.end()
    # What stood before a placeholder doesn't begin another with what stands behind it.
    begun = next((b for b in _BEGUN.finditer(text, at) if b[0][0] == "[" or any(t.startswith(b[0]) for t in _TAGS)), None)
    until = begun.start() if begun else len(text)
    return "".join(out) + text[at:until], text[until:]


def clean_stream(pieces: DataFrame) -> DataFrame:
    """task_id, seq, piece of a stream of pieces (task_id, seq, piece, done), cleaned.

    seq numbers a task's pieces without gaps in the order in which batches bring them;
    a batch's own may come in any order. Pieces that become empty are left out. The
    piece with done gives on what is held; a task that never ends keeps it. The
    state of a task is the beginning of one placeholder.
    """

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (held,) = state.get if state.exists else ("",)
        # A task has few pieces, so columns are lists: a frame's own steps would cost more than the texts.
        rows = sorted((r for b in batches for r in zip(*(b[c].tolist() for c in ("seq", "piece", "done")), strict=True)), key=lambda r: r[0])
        numbers, texts, over = [], [], False
        for seq, piece, done in rows:
            text, held = cleaned(held, piece if isinstance(piece, str) else "")
            if done is True:
                text, held, over = text + held, "", True
            if text:
                numbers.append(seq)
                texts.append(text)
        if over:
            state.remove()
        else:
            state.update((held,))
        if texts:
            yield pd.DataFrame({"task_id": [key[0]] * len(texts), "seq": numbers, "piece": texts})

    kind = pieces.schema["task_id"].dataType.simpleString()
    return pieces.groupBy("task_id").applyInPandasWithState(step, f"task_id {kind}, seq long, piece string", "held string", "append", "NoTimeout")
