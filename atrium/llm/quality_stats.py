"""Per-document text statistics, shared by the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import columns_of, map_arrow, without_clash
from .words import SPACED, Slice, distinct_by_row, text_slices, windows

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_upper", "n_digits", "n_marks", "n_distinct", "n_same_next", "n_pipes", "n_stops"]


def byte_set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SYMBOLS, MARKS, PIPES, STOPS = byte_set(b"#*$%&|<>"), byte_set(b"!?"), byte_set(b"|"), byte_set(b".")
UPPER, DIGITS = byte_set(bytes(range(65, 91))), byte_set(bytes(range(48, 58)))
NOT_TAIL = (np.arange(256) & 0xC0) != 0x80  # first bytes of characters
BLANK = bytes([0x20, 9, 10, 11, 12, 13])


def lines_of(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Lines that hold a word, and those of them that equal an earlier line of the row."""
    full, dup = np.zeros(s.rows, np.int64), np.zeros(s.rows, np.int64)
    body = s.data.tobytes()
    for r in range(s.rows):
        text = body[s.offs[r] : s.offs[r + 1]]
        lines = [x for x in text.split(b"\n") if x.strip(BLANK)]
        full[r], dup[r] = len(lines), len(lines) - len(set(lines))
    return full, dup


def stats(s: Slice) -> dict[str, np.ndarray]:
    s.split(SPACED)
    h, row = s.hashes(), s.row_of_word()
    in_word = SPACED[s.data]
    full, dup = lines_of(s)
    g, at = windows(h, s.bounds, 3)
    key = (row[at].astype(np.uint64) << np.uint64(54)) | (g >> np.uint64(10))
    order = np.argsort(key)
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(h) + 2, bool)
    for j in range(3):
        covered[at[again] + j] = True
    words_to = np.concatenate(([0], np.cumsum(covered[: len(h)])))
    next_same = np.zeros(len(h) + 1, np.int64)
    if len(h) > 1:
        next_same[1:-1] = np.cumsum((h[1:] == h[:-1]) & (row[1:] == row[:-1]))
        next_same[-1] = next_same[-2]
    _, distinct = distinct_by_row(row, h, s.rows)
    return dict(zip(STATS, [
        s.counts, s.per_row(in_word & NOT_TAIL[s.data]), s.per_row(SYMBOLS[s.data]), dup, words_to[s.bounds[1:]] - words_to[s.bounds[:-1]], full, s.per_row(NOT_TAIL[s.data]),
        s.per_row(UPPER[s.data]), s.per_row(DIGITS[s.data]), s.per_row(MARKS[s.data]), np.diff(distinct), next_same[s.bounds[1:]] - next_same[s.bounds[:-1]], s.per_row(PIPES[s.data]), s.per_row(STOPS[s.data]),
    ], strict=True))


def with_stats(df: DataFrame, keep: list[str], text_col: str, names: list[str] | None = None) -> DataFrame:
    """The kept columns and the named statistics of each row's whole text; null texts count as empty. No shuffle."""
    names = names or STATS
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"{n} long" for n in names])

    def run(batches):
        for batch in batches:
            found = [stats(s) for s in text_slices(columns_of(batch, ["__text"])[0])]
            got = [pa.array(np.concatenate([f[n] for f in found]) if found else np.zeros(0, np.int64), pa.int64()) for n in names]
            yield pa.RecordBatch.from_arrays([*columns_of(batch, keep), *got], names=[*keep, *names])

    return map_arrow(df.select(*[df[c] for c in keep], df[text_col].alias("__text")), run, schema)
