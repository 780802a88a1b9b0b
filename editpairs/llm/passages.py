"""Paragraph bounds chosen by content: where text that occurs elsewhere too begins and ends.

Windows of WINDOW words are chosen by content: of any REACH windows in a row the one of the least hash. So
whatever lies around it, a run of WINDOW + REACH - 1 words that occurs twice has a chosen window in common.
Windows that occur once are no part of a repeated paragraph: two paragraphs of LEAST_WORDS words with a
similarity of 0.8 share longer runs. The others make runs, and a run is cut at line ends.

A run's ends can depend on what lies around a passage, and a copied text can hold a passage that more texts
hold. So runs are made in three ways, and all their paragraphs take part: windows that follow each other
within REACH words and occur equally often, or if they are frequent about so (a passage within a copied text
is bounded alike wherever it lies), or differ by less than half (copies with changes of their own), and
windows with changed words between them (a near copy as a whole).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editpairs.llm.common import blocks_of, code_points, discard, join_hot, prefix_hash, range_hash, word_table, words, written

WINDOW, REACH = 16, 14
#: Words of a run, and of a paragraph that ends at a line's end before its run does. A passage of 51 words has a run of 25 at least.
LEAST_RUN, LEAST_WORDS = 24, 50
#: Of windows that occur so often the counts may differ by a quarter within a run: many copies have changes of their own.
OFTEN = 16


def chosen_windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, number of its first word in the text, hash) of the chosen windows."""
    word, text, _ = words(texts)
    at = np.arange(max(0, len(word) - WINDOW + 1))
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    hashed = range_hash(prefix_hash(word), at, at + WINDOW)
    most, low = np.uint64(2**64 - 1), np.uint64(0xFFFFFFFF)
    # texts are parted by WINDOW - 1 windows that are none, so no window is compared with another text's
    key = np.where(text[at] == text[at + WINDOW - 1], (hashed & ~low) | at.astype(np.uint64), most)
    edge = np.full(REACH - 1, most)  # the first and the last text begin and end as those between them do
    least = np.lib.stride_tricks.sliding_window_view(np.concatenate((edge, key, edge)), REACH).min(axis=1)
    found = np.unique((least[least != most] & low).astype(np.int64))
    return text[found], found - np.searchsorted(text, text[found]), hashed[found].view(np.int64)


def word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of words([text]) in the text itself."""
    inside = word_table()[code_points([text], 1)]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1) - 1, np.flatnonzero(edge == -1) - 1
    if len(text.lower()) != len(text):  # some letters have two lower-case code points
        of = np.append(np.repeat(np.arange(len(text)), [len(c.lower()) for c in text]), len(text))
        start, end = of[start], of[end - 1] + 1
    return start, end


def runs(at: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
    """(first word, end) of all runs of windows at these words, in order, that occur n times."""
    step, most, least = np.diff(at), np.maximum(n[1:], n[:-1]), np.minimum(n[1:], n[:-1])
    out = set()
    # the words between two windows of a near copy: a changed one hides the windows over it, and what is chosen beside it
    for apart in ((step > REACH) | (most > least) & ((most < OFTEN) | (4 * most >= 5 * least)), (step > REACH) | (2 * most >= 3 * least), step > WINDOW + 2 * REACH):
        edge = np.flatnonzero(apart) + 1
        out |= set(zip(at[np.append(0, edge)].tolist(), (at[np.append(edge - 1, len(at) - 1)] + WINDOW).tolist()))
    return sorted((a, b) for a, b in out if b - a >= LEAST_RUN)


def cut(first: int, end: int, breaks: np.ndarray) -> list[tuple[int, int]]:
    """A run's paragraphs: lines, joined until they have LEAST_WORDS words; what is left at the end joins the last one."""
    out = []
    for b in [*breaks[(breaks > first) & (breaks < end)].tolist(), end]:
        if b - first >= LEAST_WORDS:
            out.append((first, b))
            first = b
    if first < end:
        out.append((out.pop()[0] if out else first, end))
    return out


def paragraphs(text: str, at: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
    """Places in the text of the paragraphs that the windows at these words make, which occur n times; they may overlap."""
    start, end = word_places(text)
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4") == 10)
    line = np.searchsorted(ends, start)
    breaks = np.flatnonzero(np.diff(line)) + 1  # the first word of each line
    order = np.argsort(at)
    return sorted({(int(start[a]), int(end[b - 1])) for run in runs(at[order], n[order]) for a, b in cut(*run, breaks)})


def repeated_windows(docs: DataFrame) -> DataFrame:
    """row, at, n: of the rows of docs (row, text) the chosen windows that occur at another place too, and how often.

    Counted by hash, in the tasks first, so a hot passage costs what its words do; a chance match of two
    hashes makes a window more, which the exact comparison that follows undoes.
    """

    def choose(batches):
        for batch in batches:
            row, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in blocks_of(texts):
                text, at, hashed = chosen_windows(texts[a:b])
                yield pa.RecordBatch.from_pydict({"row": row[a:b][text], "at": at.astype(np.int32), "window": hashed})

    chosen = written(docs.select("row", "text").mapInArrow(choose, "row long, at int, window long"), "windows")
    again = chosen.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = join_hot(chosen, again, "window", "n", chosen.count(), F.xxhash64("row", "at")).filter("n IS NOT NULL")
    found = found.groupBy("row").agg(F.collect_set(F.struct("at", "n")).alias("windows"))
    found = written(found.select("row", F.col("windows.at").alias("at"), F.col("windows.n").alias("n")), "repeated-windows")
    discard(chosen)
    return found
