"""Line dedup: removes runs of lines that an earlier place in the corpus has too.

Windows of three consecutive lines are hashed, to 128 bits where documents meet. A window is repeated if it also starts
earlier in the same text or anywhere in a document of smaller doc_id; the lines it
covers go, and overlapping windows merge. What counts is the input, not what is left.

Within a document the first place of a window is found on the spot. Between documents
only the smallest doc_id of each hash is needed, a map-side aggregate, so a window that a
third of all documents share sends one row a task.

Texts of fewer than three lines have no window and stay. Null texts stay null. Rows that
share a doc_id do not remove each other's lines; rows without one come last and do not
either. Windows of white space only do not count. A text of which nothing stays is
empty. Other columns are kept, but for those named n_lines or n_removed, which are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import Scratch, free_name, numbered, text_bytes, windows_of

WINDOW = 3
BREAK = b"\n"


def window_hashes(text: bytes, window: int = WINDOW) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The lines, two hashes of each window by its first line, and whether it has more than white space."""
    lines = text.split(BREAK)
    n = len(lines) - window + 1
    if n <= 0:
        return lines, np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=bool)
    whole = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), dtype=np.uint64).reshape(-1, 2)
    hashes, checks = (windows_of(whole[:, k].copy(), window).view(np.int64) for k in range(2))
    filled = np.fromiter((bool(line) and not line.isspace() for line in lines), dtype=bool, count=len(lines))
    counts = np.zeros(n, dtype=bool)
    for k in range(window):
        counts |= filled[k : k + n]
    return lines, hashes, checks, counts


def _windows(window: int):
    schema = pa.schema([("window", pa.int64()), ("check", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64())])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            per_doc, checked = [], []
            for text in batch.column("bytes").to_pylist():
                _, hashes, checks, counts = window_hashes(text, window)
                hashes, first = np.unique(hashes[counts], return_index=True)
                per_doc.append(hashes)
                checked.append(checks[counts][first])
            of = pa.array(np.repeat(np.arange(len(per_doc)), [len(h) for h in per_doc]))
            made = [np.concatenate(c) if c else np.empty(0, dtype=np.int64) for c in (per_doc, checked)]
            columns = [*map(pa.array, made), batch.column("doc_id").take(of), batch.column("row").take(of)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return windows


def later_windows(docs: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """(row, windows): for each row of `docs` the windows that a document of smaller doc_id has.

    `row` is the row's place in the table, by `numbered`.
    """
    rows = numbered(docs.select("doc_id", text_bytes().alias("bytes"))).select("doc_id", "row", "bytes")
    found = scratch.table(rows.mapInArrow(_windows(window), "window long, check long, doc_id long, row long"), "windows")
    first = found.groupBy("window", "check").agg(
        F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n"), F.count("doc_id").alias("n_ids")
    )
    # Only windows with something later than their first document.
    shared = first.where((F.col("last_doc") > F.col("first_doc")) | ((F.col("n_ids") > 0) & (F.col("n") > F.col("n_ids"))))
    later = found.join(shared.select("window", "check", "first_doc"), ["window", "check"]).where(
        F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first_doc"))
    )
    return later.groupBy("row").agg(F.collect_list("window").alias("windows"))


def _cleaned(window: int, columns: list[str], data: str, windows: str):
    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_removed = [], [], []
            for text, repeated in zip(batch.column(data).to_pylist(), batch.column(windows).to_pylist()):
                if text is None:
                    texts.append(None)
                    n_lines.append(0)
                    n_removed.append(0)
                    continue
                lines, hashes, _, counts = window_hashes(text, window)
                gone = np.zeros(len(lines), dtype=bool)
                if len(hashes):
                    later = np.ones(len(hashes), dtype=bool)
                    later[np.unique(hashes, return_index=True)[1]] = False
                    if repeated:
                        later |= np.isin(hashes, np.array(repeated, dtype=np.int64))
                    for k in range(window):
                        gone[k : k + len(hashes)] |= later & counts
                kept = BREAK.join(line for line, g in zip(lines, gone) if not g) if gone.any() else text
                texts.append(kept.decode("utf-8", "replace"))
                n_lines.append(len(lines))
                n_removed.append(int(gone.sum()))
            made = {"text": pa.array(texts, pa.string()), "n_lines": pa.array(n_lines, pa.int32()), "n_removed": pa.array(n_removed, pa.int32())}
            yield pa.RecordBatch.from_arrays(
                [made[c] if c in made else batch.column(c) for c in columns], names=columns
            )

    return cleaned


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without repeated lines, with n_lines (before) and n_removed.

    `docs` is read twice and must give the same rows in the same order, as a stored
    table does.
    """
    later = later_windows(docs, Scratch(docs.sparkSession, "line-dedup"), window)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in {"text", "n_lines", "n_removed"}]
    row, data, windows = (free_name(docs, name) for name in ("row", "bytes", "windows"))
    rows = numbered(docs.select(*others, F.col("text").cast("binary").alias(data)), row)
    rows = rows.join(later.select(F.col("row").alias(row), F.col("windows").alias(windows)), row, "left")
    out = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in {"n_lines", "n_removed"}))
    out = out.withColumns({"n_lines": F.lit(0), "n_removed": F.lit(0)})
    return rows.mapInArrow(_cleaned(window, out.columns, data, windows), out.schema)
