"""Small awkward tables for the edge cases that every operator must stand."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

LONG = " ".join(f"word{i % 977}" for i in range(20_000))

#: doc_id, text, lang, source; nulls in every column, ties, repeated rows, no text, white space only, very long text.
DOCUMENTS = [
    (1, "the same text for  all", "en", "a"),
    (2, "the same\ttext for all", "en", "a"),
    (3, "the same text for all", None, "a"),
    (3, "the same text for all", None, "a"),
    (4, None, "en", "b"),
    (5, "", "en", None),
    (6, " \n\t ", "en", "b"),
    (None, "no id but text, licensed under the MIT License.", "fr", "b"),
    (None, None, None, None),
    (7, LONG, "de", "c"),
    (8, LONG + " end", "de", "c"),
    (9, "one two three four five six seven eight nine ten", "en", "é"),
    (10, "one two three", "en", "é"),
    (11, "one two three", "en", "z"),
    (12, "\u00a0non-breaking\u2003spaces stay é ñ 漢字", "es", "z"),
]


def write_documents(folder, rows=None, extra=True) -> str:
    """documents.parquet, with columns whose names operators might use themselves."""
    rows = DOCUMENTS if rows is None else rows
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    data = {
        "doc_id": pa.array(columns[0], pa.int64()),
        "text": pa.array(columns[1], pa.string()),
        "lang": pa.array(columns[2], pa.string()),
        "source": pa.array(columns[3], pa.string()),
        "n_chars": pa.array([None if t is None else len(t) for t in columns[1]], pa.int64()),
    }
    if extra:
        names = ("_row", "_id", "_text", "_open", "_full", "_at", "_size", "_crc32", "size", "rate", "target", "copies", "word", "_words", "_found", "score", "keep_id", "key", "row")
        data |= {name: pa.array(range(len(rows)), pa.int32()) for name in names}
    Path(folder).mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table(data), f"{folder}/documents.parquet")
    return str(folder)
