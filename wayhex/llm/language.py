"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter has one bit column for each language: a lookup ANDs the rows
of an n-gram's probes and so returns all languages that contain it. A document's
hits are counted per language, corrected for the filter's false positives, and the
language with most of them is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .textops import CHUNK, cut, mix, raw

N = 4
PROBES = 3
#: The classifier is fitted on at most so many different labelled texts of each language.
SAMPLE = 1000
#: An n-gram counts as a language's if it is seen at least so often there, and at least at this share of its highest rate in any language.
LEAST_SEEN, LEAST_RATE = 3, 0.2
UNKNOWN = "und"
_U = np.uint64
_KIND = np.arange(256, dtype=np.uint8)
_KIND[:97] = _KIND[123:128] = 32


@dataclass(frozen=True)
class Filter:
    """``rows[slot]`` has bit L set where an n-gram of language L probes the slot; over 64 languages, bit L % 64 of ``rows[slot, L // 64]``."""

    languages: tuple[str, ...]
    prior: int
    rows: np.ndarray
    false_positive: np.ndarray

    def lookup(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram the bitmask of the languages that (seem to) contain it."""
        out = np.full((len(grams), *self.rows.shape[1:]), np.iinfo(self.rows.dtype).max, self.rows.dtype)
        for i in probes(grams, len(self.rows)):
            out &= self.rows[i]
        return out


def language_bits(rows: np.ndarray, i: int) -> np.ndarray:
    """Language i's bit of each row of a table or of a lookup's result."""
    own, k = (rows, i) if rows.ndim == 1 else (rows[:, i // 64], i % 64)
    return own >> own.dtype.type(k) & own.dtype.type(1)


def probes(grams: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    h = mix(grams.astype(_U) + _U(1))
    for k in range(PROBES):
        yield (h >> _U(20 * k)) & _U(slots - 1) if slots <= 1 << 22 else mix(h + _U(k)) & _U(slots - 1)


def gram_windows(col: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """N-byte grams of the lower-cased text (all but letters are blanks) that hold one blank at most, and each row's offset, by windows of the column's bytes.

    A blank stands before and after each text; null counts as empty. A gram is in the window in which it starts.
    """
    blank, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    text = pc.binary_join_element_wise(blank, pc.utf8_lower(pc.fill_null(col.cast(pa.large_string()), "")), blank, none)
    whole, offsets = raw(text)
    for lo in range(0, max(len(whole), 1), chunk):
        data = _KIND[whole[lo : lo + chunk + N - 1]]
        last = min(len(data) - N + 1, chunk)
        if last < 1:
            yield np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
            continue
        code, blanks = np.zeros(last, np.uint32), np.zeros(last, np.uint8)
        for j in range(N):
            part = data[j : j + last]
            code = code << np.uint32(8) | part
            blanks += part == 32
        good = blanks <= 1
        for j in range(1, N):  # not across rows
            at = offsets[1:-1] - j - lo
            good[at[(at >= 0) & (at < last)]] = False
        yield code[good], np.concatenate(([0], np.cumsum(good)))[np.clip(offsets - lo, 0, last)]


def grams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All of gram_windows() in one."""
    return next(gram_windows(col, 1 << 62))


def sampled(rows: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(_lang, _h, _text, _c) of rows (_text, _lang) without nulls: of each language the ``sample`` different texts of least hash, or all if they are fewer.

    ``_c`` is the number of copies, LEAST_SEEN at most. Rows whose hash is too large by the language's estimated number of different texts are
    dropped where they are read (about 4 * sample + 64 of them pass; under ``sample`` pass with a probability below 1e-20), and copies are merged before they are shuffled.
    """
    rows = rows.withColumn("_h", F.xxhash64("_text"))
    sizes = rows.groupBy("_lang").agg(F.approx_count_distinct("_h").alias("_d"))
    rows = rows.join(F.broadcast(sizes), "_lang").filter((F.col("_h") / 2.0**64 + 0.5) * F.col("_d") <= 4.0 * sample + 64)
    rows = rows.groupBy("_lang", "_h").agg(F.first("_text").alias("_text"), F.least(F.count(F.lit(1)), F.lit(LEAST_SEEN)).alias("_c"))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("_lang").orderBy("_h"))).filter(F.col("_n") <= sample).drop("_n")


def train(docs: DataFrame, text: Column, lang: Column, sample: int = SAMPLE) -> Filter | None:
    """Fits the filter on rows whose text and lang aren't null: at most ``sample`` different texts of each language, the least by hash.

    Copies are merged and count LEAST_SEEN times at most. None if there is no row. What reaches the driver is bounded by the
    sample: the counts of the n-grams that pass LEAST_SEEN.
    """
    rows = sampled(docs.select(text.cast("string").alias("_text"), lang.cast("string").alias("_lang")).filter("_text is not null and _lang is not null"), sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, "_text"):
            langs = b.column(1).dictionary_encode()
            for code, at in gram_windows(b.column(0)):
                row = np.repeat(langs.indices.to_numpy(), np.diff(at)).astype(np.uint64)
                both, place = np.unique(row << _U(32) | code, return_inverse=True)
                seen = np.bincount(place, np.repeat(b.column(2).to_numpy(), np.diff(at)), len(both))
                names = langs.dictionary.take(pa.array((both >> _U(32)).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([names, pa.array((both & _U(0xFFFFFFFF)).astype(np.int64)), pa.array(seen.astype(np.int64))], ["lang", "gram", "seen"])

    seen = rows.select("_text", "_lang", "_c").mapInArrow(count, "lang string, gram long, seen long").groupBy("lang", "gram").agg(F.sum("seen").alias("seen"))
    found = seen.withColumn("total", F.sum("seen").over(Window.partitionBy("lang"))).filter(F.col("seen") >= LEAST_SEEN).toPandas()
    if found.empty:
        return None
    languages = tuple(sorted(found["lang"].unique()))
    found["rate"] = found["seen"] / found["total"]
    found = found[found["rate"] >= LEAST_RATE * found.groupby("gram")["rate"].transform("max")]
    most = int(found.groupby("lang").size().max())
    slots = 1 << max(10, (8 * most).bit_length())
    kind = next((k for k in (np.uint8, np.uint16, np.uint32) if len(languages) <= np.iinfo(k).bits), np.uint64)
    table = np.zeros(slots if len(languages) <= 64 else (slots, -(-len(languages) // 64)), kind)
    own = found.groupby("lang")["gram"]
    for i, name in enumerate(languages):
        column = table if table.ndim == 1 else table[:, i // 64]
        for p in probes(own.get_group(name).to_numpy().astype(np.uint32), slots):
            column[p] |= kind(1 << i % 64)
    fill = np.array([language_bits(table, i).mean() for i in range(len(languages))])
    total = found.groupby("lang")["total"].max()
    return Filter(languages, languages.index(total.idxmax()), table, fill**PROBES)


def predict(docs: DataFrame, model: Filter | None, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score, known) for each row; with ``keep`` the row itself too, as _text and a struct _r of the other columns.

    ``score`` is the predicted language's share of the corrected hits of all
    languages, ``known`` the share of the text's n-grams that are its; 1 for a text with letters but without n-grams, as no n-gram is unknown. A
    null text, one without letters, and any text where there is no model: UNKNOWN, 0, 0. Without hits the
    most common learned language, 0, 0. Ties go to the language first in order. Repeated rows give repeated rows, an empty table an empty result. Only
    the id and the text are read, and other columns may have any names; with ``keep`` they come back inside _r. Long texts are read in windows.
    """
    own = [F.struct(*[c for c in docs.columns if c != text_col]).alias("_r")] if keep else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"), *own)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("known", T.DoubleType()), *rows.schema.fields[1 if keep else 2 :]])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, "_text", 1 << 20):
            lettered = pc.fill_null(pc.match_substring_regex(b.column(1), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            names, score, known = np.full(b.num_rows, UNKNOWN, object), np.zeros(b.num_rows), np.zeros(b.num_rows)
            if model is not None:
                n, hits = np.zeros(b.num_rows, np.int64), np.zeros((len(model.languages), b.num_rows))
                for code, at in gram_windows(b.column(1)):
                    mask = model.lookup(code)
                    n += np.diff(at)
                    for i in range(len(model.languages)):
                        hits[i] += np.diff(np.concatenate(([0], np.cumsum(language_bits(mask, i), dtype=np.int64)))[at])
                for i, fp in enumerate(model.false_positive):
                    hits[i] = np.maximum((hits[i] - n * fp) / (1 - fp), 0) if fp < 1 else 0
                best, total = hits.max(axis=0), hits.sum(axis=0)
                pick = np.where(best > 0, hits.argmax(axis=0), model.prior)
                names = np.where(lettered, np.array(model.languages, object)[pick], UNKNOWN)
                score = np.where(lettered & (total > 0), best / np.maximum(total, 1e-300), 0.0)
                known = np.where(lettered, np.where(n > 0, np.minimum(best / np.maximum(n, 1), 1), 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(known), *b.columns[1 if keep else 2 :]], schema.names)

    return rows.mapInArrow(label, schema)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo 5."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, keep: bool = False) -> DataFrame:
    """Learns from the rows of folds 1 to 4 with a lang, and predicts all rows: predict()'s columns and held_out (fold 0).

    A row without id is not learned from, nor held out. An empty table, or one without labels in folds 1 to 4, leaves nothing to learn: all are UNKNOWN.
    """
    learned = docs.filter(fold(id_col) != 0)
    model = train(learned, F.col(text_col), F.col(lang_col), sample)
    return predict(docs, model, id_col, text_col, keep).withColumn("held_out", F.coalesce(fold("doc_id") == 0, F.lit(False)))
