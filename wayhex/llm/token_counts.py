"""Token counts by section: whole documents are encoded once, and token spans are joined to sections as intervals.

The rule for a token that crosses a boundary: it counts for the section
that holds most of its characters, the earlier one on a tie. A token that is
part of a character's bytes has that character as its span. So the counts of a document's sections
add up to its tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import cut, raw

_encodings: dict[tuple[str, str], tuple] = {}


def encoding(path: str, pattern: str) -> tuple:
    """(encoder, byte length of each id) of a byte-level vocabulary file of ranks; one for each Python worker."""
    if (path, pattern) not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for word, i in ranks.items():
            sizes[i] = len(word)
        _encodings[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return _encodings[path, pattern]


def char_spans(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and the one after the last of tokens with the byte sizes, which make up ``data``."""
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    ends = np.cumsum(sizes)
    return char[ends - sizes], char[ends - 1] + 1


def allot(first: np.ndarray, after: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The section of each token span; sections begin at ``starts`` (the first at 0) and reach to the next."""
    one = np.searchsorted(starts, first, "right") - 1
    last = np.searchsorted(starts, after - 1, "right") - 1
    for i in np.flatnonzero(one != last).tolist():
        edges = np.minimum(np.append(starts[one[i] + 1 : last[i] + 1], after[i]), after[i])
        one[i] += int(np.argmax(np.diff(np.concatenate(([first[i]], edges)))))
    return one


def _counts(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, section, start, end, n_tokens) of (doc_id, _text, _ends): the sections' ends in characters, ascending, the last one the text's."""
    names = ["doc_id", "section", "start", "end", "n_tokens"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = encoding(path, pattern)
        for b in cut(batches, "_text"):
            data, at = raw(b.column(1))
            out: list[tuple[np.ndarray, ...]] = []
            for i, (text, ends) in enumerate(zip(b.column(1), b.column(2))):
                ends = ends.values.to_numpy().astype(np.int64)
                starts = np.concatenate(([0], ends[:-1])).astype(np.int64)[: len(ends)]
                ids = encoder.encode_ordinary(text.as_py())
                if ids:
                    own = allot(*char_spans(data[at[i] : at[i + 1]], lengths[ids]), starts)
                    n = np.bincount(own, minlength=len(ends))
                else:
                    n = np.zeros(len(ends), np.int64)
                out.append((np.full(len(ends), i), np.arange(len(ends)), starts, ends, n))
            row, *rest = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(rest[0].astype(np.int32)), *(pa.array(x.astype(np.int64)) for x in rest[1:])], names)

    return rows.mapInArrow(count, "doc_id long, section int, start long, end long, n_tokens long")


def by_line(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each line: (doc_id, section, start, end, n_tokens), sections from 0, ends exclusive, in characters.

    A line holds its line feed, so that lines make up the text. A null or empty text
    has one section, of no characters and tokens. Repeated rows give repeated rows, an empty table an empty result. Only the id and the text
    are read, so other columns may have any names. A text is encoded whole, however long it is: its ids take about 10 bytes for each of its own.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_text"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, "_text"):
            parts = pc.split_pattern(b.column(1), "\n")
            size = pc.utf8_length(parts.flatten()).to_numpy().astype(np.int64) + 1
            at = parts.offsets.to_numpy() - parts.offsets[0].as_py()
            size[at[1:] - 1] -= 1  # the last line has no line feed
            total = np.cumsum(size)
            ends = total - np.repeat(np.concatenate(([0], total))[at[:-1]], np.diff(at))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ends))], ["doc_id", "_text", "_ends"])

    return _counts(rows.mapInArrow(lines, "doc_id long, _text string, _ends array<long>"), path, pattern)


def by_field(df: DataFrame, fields: list[str], path: str, pattern: str, id_col: str = "doc_id", between: str = "\n") -> DataFrame:
    """Tokens of each field of a record: (doc_id, section, start, end, n_tokens); section k is fields[k].

    The fields' values (null: empty) are joined by ``between``, which counts for the field before it, and encoded as one text.
    """
    values = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    ends, total = [], F.lit(0).cast("long")
    for k, v in enumerate(values):
        total = total + F.char_length(v) + (len(between) if k + 1 < len(values) else 0)
        ends.append(total)
    rows: list[Column] = [F.col(id_col).cast("long").alias("doc_id"), F.concat_ws(between, *values).alias("_text"), F.array(*ends).alias("_ends")]
    return _counts(df.select(*rows), path, pattern)
