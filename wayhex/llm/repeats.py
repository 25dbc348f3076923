"""Long repeats by a common-prefix interval tree over an enhanced suffix array.

Every string of LENGTH bytes has one anchor, the least-hashed of its GRAM-byte grams; equal strings have equal
anchors at equal places. So all places of a repeat meet in the groups of their anchors' grams, and only
suffixes that begin at anchors are sorted. An anchor's context is what strings
through it can reach: at most LENGTH - GRAM bytes before it and LENGTH from it on. Equal contexts are counted, not gathered.

A group's distinct contexts form a suffix array by what follows the anchor, with the lengths of common prefixes. A
stack scan yields the intervals of its tree; inside one, the contexts in the order of what precedes the
anchor (read backwards) show where left extensions part. Sets that stay together long
enough, and go on differently on both sides, are the maximal repeats with all their occurrences: groups() lists them, and
removal takes its spans from that list. Groups of more than MOST_CONTEXTS distinct contexts
take another way with the same results: the strings themselves are the keys, counted before they are shuffled.

Contexts count as equal by 128 bits of hash (64 of the gram, 64 of the context), and so do the strings of such large groups;
all others are compared byte by byte. Long texts are read in windows of CHUNK bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written
from .textops import cut, mix, prefix_hash, raw, span_hash

LENGTH = 400
GRAM = 64
MOST_CONTEXTS = 20_000
#: A text's anchors are found in windows of so many bytes.
CHUNK = 4 << 20
_U = np.uint64
_PLACE_BITS = 28


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of all rows: (row, place in the row, bytes before, bytes from it on, gram hash, context hash, start of its first string) for each anchor."""
    none = tuple(np.zeros(0, np.int64) for _ in range(7))
    if len(data) < length:
        return none
    s = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    grams = span_hash(s, at, at + gram)
    least = (grams >> _U(_PLACE_BITS) << _U(_PLACE_BITS)) | at.astype(_U)
    width, window = 1, length - gram + 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = window - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    # least[p] is the anchor of the string at p
    row = np.searchsorted(offsets, np.arange(len(least)), "right") - 1
    inside = np.arange(len(least)) + length <= offsets[row + 1]
    row, place = row[inside], (least[inside] & _U((1 << _PLACE_BITS) - 1)).astype(np.int64)
    if not len(place):
        return none
    first = np.concatenate(([True], place[1:] != place[:-1]))
    starts = np.flatnonzero(inside)[first]
    row, place = row[first], place[first]
    before, after = np.minimum(place - offsets[row], length - gram), np.minimum(offsets[row + 1] - place, length)
    context = mix(span_hash(s, place - before, place + after) ^ (before.astype(_U) * _U(0x9E3779B97F4A7C15)))
    return row, place - offsets[row], before, after, grams[place].view(np.int64), context.view(np.int64), starts - offsets[row]


def anchors_in_windows(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, ...]]:
    """As anchors() without the starts, in parts: a long text goes in overlapping windows, each of which keeps the anchors whose first string starts in its own ``chunk`` bytes."""
    if len(data) <= 2 * chunk:
        yield anchors(data, offsets, length, gram)[:6]
        return
    for i, (at, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for lo in range(at, end, chunk):
            # a run of strings with one anchor is shorter than ``length``, so the window's first run never reaches lo, but at the text's own start
            a, b = max(at, lo - length), min(end, lo + chunk + 2 * length)
            _, place, before, after, k, ctx, starts = anchors(data[a:b], np.array([0, b - a]), length, gram)
            own = (starts >= lo - a) & (starts < lo - a + chunk)
            yield np.full(int(own.sum()), i), place[own] + (a - at), before[own], after[own], k[own], ctx[own]


def prefix_lengths(texts: list[bytes], width: int) -> np.ndarray:
    """How many bytes each text shares with the one before it (0 for the first); texts hold at most ``width`` bytes."""
    n = len(texts)
    sizes = np.array([len(t) for t in texts])
    body = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(n, width)
    out = np.zeros(n, np.int64)
    for at in range(1, n, 4096):
        other = body[at : at + 4096] != body[at - 1 : at - 1 + len(body[at : at + 4096])]
        some = other.any(axis=1)
        out[at : at + 4096] = np.where(some, other.argmax(axis=1), width)
    out[1:] = np.minimum(out[1:], np.minimum(sizes[1:], sizes[:-1]))
    return out


def intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """The inner nodes (depth, first, last) of the common-prefix interval tree, children before parents."""
    stack = [(0, 0)]
    for i in range(1, len(common) + 1):
        now, first = (common[i] if i < len(common) else 0), i - 1
        while now < stack[-1][0]:
            depth, first = stack.pop()
            yield depth, first, i - 1
        if now > stack[-1][0]:
            stack.append((now, first))


def scan(keys: list, left: list[bytes], right: list[bytes], length: int, found: Callable[[int, np.ndarray, np.ndarray], None]) -> None:
    """Calls found(depth, members, shared) for each tree node: ``shared[i]`` bytes before the anchor are common to members[i] and members[i+1].

    ``left`` holds what precedes each anchor, read backwards. Members are in the order of their left texts, so that a member
    shares no more with any other than with a neighbour. Only nodes of one key are visited.
    """
    number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    group = [number[k] for k in keys]
    n = len(keys)
    by_left = sorted(range(n), key=lambda i: (group[i], left[i]))
    by_right = sorted(range(n), key=lambda i: (group[i], right[i]))
    own = np.array(group)
    back = prefix_lengths([left[i] for i in by_left], max(length, 1))
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    common = prefix_lengths([right[i] for i in by_right], length)
    sorted_groups = own[by_right]
    common[1:][sorted_groups[1:] != sorted_groups[:-1]] = 0
    ranks = rank[by_right]
    lefts = np.array(by_left)
    for depth, first, last in intervals(common.tolist()):
        if last == first + 1:
            a, b = ranks[first], ranks[last]
            a, b = (a, b) if a < b else (b, a)
            found(depth, lefts[[a, b]], back[a + 1 : b + 1].min(keepdims=True))
        else:
            r = np.sort(ranks[first : last + 1])
            found(depth, lefts[r], np.minimum.reduceat(back[: r[-1] + 1], r[:-1] + 1))


def groups(keys: list, left: list[bytes], right: list[bytes], length: int) -> list[tuple[int, int, np.ndarray]]:
    """The maximal repeats of at least ``length`` bytes through the anchors: (bytes before, bytes after, members).

    Within a node, whose members differ in what follows, the intervals of the left order are the sets whose left extensions part
    at one place; those whose members all go on alike to the right belong to a deeper node.
    """
    out: list[tuple[int, int, np.ndarray]] = []
    sizes = np.array([len(t) for t in right])
    body = np.frombuffer(b"".join(t[:length].ljust(length + 1, b"\0") for t in right), np.uint8).reshape(len(right), length + 1)

    def found(depth: int, members: np.ndarray, shared: np.ndarray) -> None:
        good = np.flatnonzero(shared >= length - depth)
        if not len(good):
            return
        if len(members) == 2:
            out.append((int(shared[0]), depth, members))
            return
        goes_on = np.where(sizes[members] > depth, body[members, depth].astype(np.int16), -1)
        # how many neighbours, up to each member, part on the right
        parted = np.concatenate(([0], np.cumsum((goes_on[1:] != goes_on[:-1]) | (goes_on[1:] < 0)))).tolist()
        for run in np.split(good, np.flatnonzero(np.diff(good) > 1) + 1):
            first, last = int(run[0]), int(run[-1])
            for before, i, j in intervals([0, *(shared[first : last + 1] + 1).tolist()]):
                if parted[first + j] > parted[first + i]:
                    out.append((before - 1, depth, members[first + i : first + j + 1]))

    scan(keys, left, right, length, found)
    return out


def reach(keys: list, left: list[bytes], right: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context how far the maximal repeats it is in reach before and after its anchor (0, 0: none). All hold the anchor, so their union is one span."""
    before, after = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    for b, a, members in groups(keys, left, right, length):
        before[members] = np.maximum(before[members], b)
        after[members] = np.maximum(after[members], a)
    return before, after


def _contexts(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(k, ctx, rid, at, l, r) for each anchor of (rid, _text)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, "_text", 1 << 20):
            for row, at, before, after, k, ctx in anchors_in_windows(*raw(b.column(1)), length, gram):
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(ctx), b.column(0).take(pa.array(row)), pa.array(at), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32))], ["k", "ctx", "rid", "at", "l", "r"])

    return rows.mapInArrow(find, "k long, ctx long, rid long, at long, l int, r int")


def _bodies(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """(k, ctx, l, body, m) of wanted (k, ctx, rid, at, l, r, m). This is where texts are shuffled, so it is done once for groups of any size."""
    each = wanted.groupBy("rid").agg(F.collect_list(F.struct("k", "ctx", "at", "l", "r", "m")).alias("a"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, "_text", 1 << 20):
            data, offsets = raw(b.column(0))
            lists = b.column(1)
            flat = lists.flatten()
            base = np.repeat(offsets[:-1], np.diff(lists.offsets.to_numpy()))
            k, ctx, at, left, right, m = (flat.field(i) for i in range(6))
            at = at.to_numpy() + base
            body = memoryview(data)
            for lo in range(0, len(at), 1 << 13):
                part = slice(lo, lo + (1 << 13))
                begin, end = at[part] - left.to_numpy()[part], at[part] + right.to_numpy()[part]
                texts = [bytes(body[i:j]) for i, j in zip(begin.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays([k[part], ctx[part], left[part], pa.array(texts, pa.binary()), m[part]], ["k", "ctx", "l", "body", "m"])

    return rows.join(each, "rid").select("_text", "a").mapInArrow(extract, "k long, ctx long, l int, body binary, m long")


def _reached(bodies: DataFrame, length: int) -> DataFrame:
    """(k, ctx, before, after) of contexts (k, ctx, l, body) in which repeats are found; groups come whole and sorted by k."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> Iterator[pa.RecordBatch]:
            keys = [h[0] for h in held]
            before, after = reach(keys, [h[3][: h[2]][::-1] for h in held], [h[3][h[2] :] for h in held], length)
            own = np.flatnonzero(after)
            yield pa.RecordBatch.from_arrays([pa.array([held[i][0] for i in own], pa.int64()), pa.array([held[i][1] for i in own], pa.int64()), pa.array(before[own]), pa.array(after[own])], ["k", "ctx", "before", "after"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[-1][:2] == row[:2]:
                    continue  # a repeated row's
                if len(held) >= 4096 and held[-1][0] != row[0]:
                    yield from done()
                    held = []
                held.append(row)
        if held:
            yield from done()

    return bodies.repartition("k").sortWithinPartitions("k", "ctx").mapInArrow(work, "k long, ctx long, before long, after long")


def _counted(bodies: DataFrame, length: int, gram: int) -> DataFrame:
    """As _reached, for groups of any size: the strings through each anchor are counted by hash."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                data, offsets = raw(part.column(3))
                s = prefix_hash(data)
                n = np.maximum(np.diff(offsets) - length + 1, 0)
                row = np.repeat(np.arange(len(n)), n)
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = offsets[row] + place
                left = part.column(2).to_numpy()[row]
                good = (place <= left) & (place + length >= left + gram)
                row, place, start, left = row[good], place[good], start[good], left[good]
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pick), part.column(1).take(pick), pa.array(span_hash(s, start, start + length).view(np.int64)), pa.array(left - place), pa.array(place + length - left)], ["k", "ctx", "s", "before", "after"])

    own = bodies.mapInArrow(strings, "k long, ctx long, s long, before long, after long")
    # contexts that occur twice are dealt with by their count: here only strings of different contexts matter
    # at the same place of the anchor; elsewhere it may be the very same string, seen from two anchors
    key = ["k", "s", "before"]
    twice = own.groupBy(*key).agg(F.min("ctx").alias("a"), F.max("ctx").alias("b")).filter("a <> b").select(*key)
    return own.join(twice, key).groupBy("k", "ctx").agg(F.max("before").alias("before"), F.max("after").alias("after"))


def _parted(bodies: DataFrame, length: int, gram: int, most_contexts: int) -> tuple[DataFrame, DataFrame]:
    """Contexts of large groups in smaller ones that lose no repeat, by size: (k, ctx, l, body).

    Where two contexts share ``length`` bytes through the anchor, they share at least ``left`` bytes before it or ``right`` from
    it on, where these make up ``length``. So one group for each such part will do; contexts alone in theirs have no repeat.
    """
    left = (length - gram) // 2
    right = length - left
    before = F.when(F.col("l") >= left, F.xxhash64("k", F.lit(0), F.col("body").substr(F.col("l") - left + 1, F.lit(left))))
    after = F.when(F.octet_length("body") - F.col("l") >= right, F.xxhash64("k", F.lit(1), F.col("body").substr(F.col("l") + 1, F.lit(right))))
    parts = bodies.select(F.explode(F.array_compact(F.array(before, after))).alias("g"), "k", "ctx", "l", "body")
    sizes = parts.groupBy("g").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    parts = parts.join(sizes, "g").select(F.col("g").alias("k"), "ctx", "l", "body", "m")
    return parts.filter(F.col("m") <= most_contexts).drop("m"), parts.filter(F.col("m") > most_contexts).drop("m")


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs covered by spans [start, end); spans that touch are one run."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    return list(zip(start[new].tolist(), end[np.append(new[1:], len(start)) - 1].tolist()))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """(rid, k, start, end) of docs (rid, _text): spans of at least ``length`` bytes that occur anywhere else too, with their anchor's gram."""
    found = written(_contexts(docs, length, gram), "anchors")
    oid = F.xxhash64("rid", "at")
    contexts = written(found.groupBy("k", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min_by("rid", oid).alias("rid"), F.min_by("at", oid).alias("at"), F.first("l").alias("l"), F.first("r").alias("r")), "distinct")
    # both sides are tables, so that a gram with very many contexts can be split in the join
    sizes = written(contexts.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")).filter("total > 1").select("k", "m"), "sizes")
    contexts = written(contexts.join(sizes, "k"), "contexts")
    same = contexts.filter(f"n > 1 and l + r >= {length}").select("k", "ctx", F.col("l").cast("long").alias("before"), F.col("r").cast("long").alias("after"))
    bodies = _bodies(contexts.filter("m > 1"), docs)
    most = contexts.filter(F.col("m") > most_contexts).select("k", "ctx")
    large = not most.isEmpty()
    bodies = written(bodies, "bodies") if large else bodies
    reached = same.unionAll(_reached(bodies.filter(F.col("m") <= most_contexts).drop("m"), length))
    if large:
        small, rest = _parted(bodies.filter(F.col("m") > most_contexts).drop("m"), length, gram, most_contexts)
        both = _reached(small, length).unionAll(_counted(rest, length, gram))
        reached = reached.unionAll(both.drop("k").join(most, "ctx").select("k", "ctx", "before", "after"))
    # written, so that a context that very many anchors have can be split in the join
    reached = written(reached.groupBy("k", "ctx").agg(F.max("before").alias("before"), F.max("after").alias("after")), "reached")
    return found.select("k", "ctx", "rid", "at").join(reached, ["k", "ctx"]).select("rid", "k", (F.col("at") - F.col("before")).alias("start"), (F.col("at") + F.col("after")).alias("end"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row: all bytes covered by a repeated string of ``length`` bytes go.

    A text counts as its UTF-8 bytes (null: none), ``kept`` is the rest (binary), ``n_spans`` the number
    of maximal removed runs. A string repeats if it starts anywhere else, in the same text or another, overlapping
    or not; matches don't cross texts. Texts shorter than ``length`` keep all. Repeated rows are
    copies of each other. Ids may be null. An empty table gives an empty result. Only the id and the text are read, so other
    columns may have any names. A text may be as long as a string can be; it is read in windows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "_text").alias("rid"), "_text")
    spans = repeated_spans(rows.select("rid", "_text"), length, gram, most_contexts)
    each = spans.groupBy("rid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, "_text", 1 << 20):
            data, offsets = raw(b.column(1))
            out = []
            for i, own in enumerate(b.column(2)):
                text = data[offsets[i] : offsets[i + 1]]
                runs = merged(own.values.field(0).to_numpy(), own.values.field(1).to_numpy()) if own.is_valid else []
                edges = [0, *(x for run in runs for x in run), len(text)]
                kept = b"".join(text[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2]))
                out.append((len(text), len(text) - len(kept), len(runs), kept))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(zip(*out), kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.join(each, "rid").select("_text", "a").mapInArrow(extract, "k long, ctx long, l int, body binary, m long")


def _reached(bodies: DataFrame, length: int) -> DataFrame:
    """(k, ctx, before, after) of contexts (k, ctx, l, body) in which repeats are found; groups come whole and sorted by k."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> Iterator[pa.RecordBatch]:
            keys = [h[0] for h in held]
            before, after = reach(keys, [h[3][: h[2]][::-1] for h in held], [h[3][h[2] :] for h in held], length)
            own = np.flatnonzero(after)
            yield pa.RecordBatch.from_arrays([pa.array([held[i][0] for i in own], pa.int64()), pa.array([held[i][1] for i in own], pa.int64()), pa.array(before[own]), pa.array(after[own])], ["k", "ctx", "before", "after"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[-1][:2] == row[:2]:
                    continue  # a repeated row's
                if len(held) >= 4096 and held[-1][0] != row[0]:
                    yield from done()
                    held = []
                held.append(row)
        if held:
            yield from done()

    return bodies.repartition("k").sortWithinPartitions("k", "ctx").mapInArrow(work, "k long, ctx long, before long, after long")


def _counted(bodies: DataFrame, length: int, gram: int) -> DataFrame:
    """As _reached, for groups of any size: the strings through each anchor are counted by hash."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                data, offsets = raw(part.column(3))
                s = prefix_hash(data)
                n = np.maximum(np.diff(offsets) - length + 1, 0)
                row = np.repeat(np.arange(len(n)), n)
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = offsets[row] + place
                left = part.column(2).to_numpy()[row]
                good = (place <= left) & (place + length >= left + gram)
                row, place, start, left = row[good], place[good], start[good], left[good]
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pick), part.column(1).take(pick), pa.array(span_hash(s, start, start + length).view(np.int64)), pa.array(left - place), pa.array(place + length - left)], ["k", "ctx", "s", "before", "after"])

    own = bodies.mapInArrow(strings, "k long, ctx long, s long, before long, after long")
    # contexts that occur twice are dealt with by their count: here only strings of different contexts matter
    # at the same place of the anchor; elsewhere it may be the very same string, seen from two anchors
    key = ["k", "s", "before"]
    twice = own.groupBy(*key).agg(F.min("ctx").alias("a"), F.max("ctx").alias("b")).filter("a <> b").select(*key)
    return own.join(twice, key).groupBy("k", "ctx").agg(F.max("before").alias("before"), F.max("after").alias("after"))


def _parted(bodies: DataFrame, length: int, gram: int, most_contexts: int) -> tuple[DataFrame, DataFrame]:
    """Contexts of large groups in smaller ones that lose no repeat, by size: (k, ctx, l, body).

    Where two contexts share ``length`` bytes through the anchor, they share at least ``left`` bytes before it or ``right`` from
    it on, where these make up ``length``. So one group for each such part will do; contexts alone in theirs have no repeat.
    """
    left = (length - gram) // 2
    right = length - left
    before = F.when(F.col("l") >= left, F.xxhash64("k", F.lit(0), F.col("body").substr(F.col("l") - left + 1, F.lit(left))))
    after = F.when(F.octet_length("body") - F.col("l") >= right, F.xxhash64("k", F.lit(1), F.col("body").substr(F.col("l") + 1, F.lit(right))))
    parts = bodies.select(F.explode(F.array_compact(F.array(before, after))).alias("g"), "k", "ctx", "l", "body")
    sizes = parts.groupBy("g").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    parts = parts.join(sizes, "g").select(F.col("g").alias("k"), "ctx", "l", "body", "m")
    return parts.filter(F.col("m") <= most_contexts).drop("m"), parts.filter(F.col("m") > most_contexts).drop("m")


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs covered by spans [start, end); spans that touch are one run."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    return list(zip(start[new].tolist(), end[np.append(new[1:], len(start)) - 1].tolist()))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """(rid, k, start, end) of docs (rid, _text): spans of at least ``length`` bytes that occur anywhere else too, with their anchor's gram."""
    found = written(_contexts(docs, length, gram), "anchors")
    oid = F.xxhash64("rid", "at")
    contexts = written(found.groupBy("k", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min_by("rid", oid).alias("rid"), F.min_by("at", oid).alias("at"), F.first("l").alias("l"), F.first("r").alias("r")), "distinct")
    # both sides are tables, so that a gram with very many contexts can be split in the join
    sizes = written(contexts.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")).filter("total > 1").select("k", "m"), "sizes")
    contexts = written(contexts.join(sizes, "k"), "contexts")
    same = contexts.filter(f"n > 1 and l + r >= {length}").select("k", "ctx", F.col("l").cast("long").alias("before"), F.col("r").cast("long").alias("after"))
    bodies = _bodies(contexts.filter("m > 1"), docs)
    most = contexts.filter(F.col("m") > most_contexts).select("k", "ctx")
    large = not most.isEmpty()
    bodies = written(bodies, "bodies") if large else bodies
    reached = same.unionAll(_reached(bodies.filter(F.col("m") <= most_contexts).drop("m"), length))
    if large:
        small, rest = _parted(bodies.filter(F.col("m") > most_contexts).drop("m"), length, gram, most_contexts)
        both = _reached(small, length).unionAll(_counted(rest, length, gram))
        reached = reached.unionAll(both.drop("k").join(most, "ctx").select("k", "ctx", "before", "after"))
    # written, so that a context that very many anchors have can be split in the join
    reached = written(reached.groupBy("k", "ctx").agg(F.max("before").alias("before"), F.max("after").alias("after")), "reached")
    return found.select("k", "ctx", "rid", "at").join(reached, ["k", "ctx"]).select("rid", "k", (F.col("at") - F.col("before")).alias("start"), (F.col("at") + F.col("after")).alias("end"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row: all bytes covered by a repeated string of ``length`` bytes go.

    A text counts as its UTF-8 bytes (null: none), ``kept`` is the rest (binary), ``n_spans`` the number
    of maximal removed runs. A string repeats if it starts anywhere else, in the same text or another, overlapping
    or not; matches don't cross texts. Texts shorter than ``length`` keep all. Repeated rows are
    copies of each other. Ids may be null. An empty table gives an empty result. Only the id and the text are read, so other
    columns may have any names. A text may be as long as a string can be; it is read in windows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "_text").alias("rid"), "_text")
    spans = repeated_spans(rows.select("rid", "_text"), length, gram, most_contexts)
    each = spans.groupBy("rid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, "_text", 1 << 20):
            data, offsets = raw(b.column(1))
            out = []
            for i, own in enumerate(b.column(2)):
                text = data[offsets[i] : offsets[i + 1]]
                cover = np.zeros(len(text) + 1, np.int64)
                if own.is_valid:
                    np.add.at(cover, own.values.field(0).to_numpy(), 1)
                    np.add.at(cover, own.values.field(1).to_numpy(), -1)
                gone = np.cumsum(cover)[:-1] > 0
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((len(text), int(gone.sum()), runs, text[~gone].tobytes()))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(zip(*out), kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.join(each, "rid", "left").select("doc_id", "_text", "spans").mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
