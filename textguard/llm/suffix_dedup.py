"""Suffix-array dedup: longest-previous-factor arrays, cut at the length that a removal needs.

Only the prefix of ``length`` bytes of a suffix decides: a position is removed when its longest previous
(or next) factor reaches ``length``. Suffixes that agree on that prefix are neighbours in suffix order and
form one class; in a class the previous smaller position of a suffix is any earlier member and the next
smaller one shows that it is itself earlier. The steps:

1. Every prefix has an anchor, the first place of the smallest hash of its ``SEED``-byte windows, so equal
   prefixes have equal anchors at equal distances. About one position in 170 is an anchor; anchors seen once
   in the corpus end here.
2. Neighbouring suffixes with one anchor form a segment. Equal segments share all their factors, so each
   distinct segment is worked on once, and a segment that a document repeats is one row of it.
3. Segments of one anchor that differ meet in one group with their bytes; the group's suffixes are ordered by
   class and position in numpy, which gives the factors as runs. Only anchors of more than ``MAX_KINDS``
   different segments are dealt out by class, a row for every suffix.
4. Spans go back to the documents.

A text is a row of bytes, or with ``words`` a row of word hashes; lengths and places then count words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from textguard.llm.common import mix
from textguard.session import drop_table, write_through

LENGTH = 400
SEED = 64
WORD_SEED = 16
MAX_KINDS = 2048  # different segments of an anchor that one task orders
CHUNK = 1 << 18  # bytes of text, or suffixes of groups, that numpy works on at once
PIECE = 1 << 22  # starts of one text that are cut into segments at once
KEY_BITS = 1 << 23  # of the filter of documents whose segments are compared
PLACE = np.uint64((1 << 24) - 1)
KEY = ["k1", "k2"]
U64 = np.uint64
_ODD = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, 64-bit hash) of every word between white space."""
    b = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], (b != 0x20) & ((b < 0x09) | (b > 0x0D)), [False]])
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    if not len(starts):
        return starts, ends, np.zeros(0, U64)
    place = np.arange(len(b)) - np.concatenate([np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(b))))])
    value = np.where(inside[1:-1], mix(b.astype(U64) * _ODD[1] + place.astype(U64) * _ODD[2] + _ODD[0]), U64(0))
    return starts, ends, mix(np.add.reduceat(value, starts) + (ends - starts).astype(U64))


def window_hashes(data: bytes | np.ndarray, n: int, size: int = 1) -> np.ndarray:
    """64-bit hash of every window of ``n`` bytes or words, by doubling: halves of a window are hashed once.

    With ``size`` the data are the hashes of the windows of that many.
    """
    h = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    if size == 1 and h.dtype == np.uint8 and min(len(h), n) >= 8:
        h, size = np.ndarray(len(h) - 7, "<u8", np.ascontiguousarray(h), strides=(1,)).copy(), 8
        h = mix(h + _ODD[0])
    elif size == 1:
        h = mix(h.astype(U64) + _ODD[0])
    while size < n:
        step = min(size, n - size)
        if len(h) <= step:
            return np.zeros(0, U64)
        h = mix(h[:-step] * _ODD[1] + h[step:] * _ODD[2] + U64(step))
        size += step
    return h


def sliding(values: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """Smallest or largest (``pick``) of every window of ``n`` values."""
    size = 1
    while size < n:
        step = min(size, n - size)
        if len(values) <= step:
            return values[:0]
        values = pick(values[:-step], values[step:])
        size += step
    return values


def segments(units: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """(row, start, stop, anchor, digest) of the segments of rows of fewer than 2 ** 24 units that lie end to end.

    A segment is a run of starts whose prefixes have their anchor, the first smallest window, in one place.
    It has at most ``length`` starts, so the prefixes of the first and the last one hold all of it.
    """
    h = window_hashes(units, seed)
    whole = window_hashes(h, length, seed)
    if not len(whole):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),) * 2
    at = sliding((h & ~PLACE) | np.arange(len(h), dtype=U64), length - seed + 1, np.minimum) & PLACE
    new = np.concatenate([[True], at[1:] != at[:-1]])
    new[offsets[:-1][offsets[:-1] < len(new)]] = True
    start = np.flatnonzero(new)
    row = np.searchsorted(offsets, start, "right") - 1
    stop = np.minimum(np.append(start[1:], len(new)), offsets[row + 1] - length + 1)
    row, start, stop = (x[start < stop] for x in (row, start, stop))
    digest = mix(whole[start] * _ODD[1] + whole[stop - 1] * _ODD[2] + (stop - start).astype(U64))
    return row, start, stop, h[at[start].astype(np.int64)], digest


def _bytes(value: pa.Scalar) -> bytes:
    return (value.as_py() or "").encode("utf-8", "surrogatepass")


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of an Arrow column of strings or byte strings."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _rows_by_size(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` units, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def _units_of(data: np.ndarray, offsets: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Units of rows that lie end to end and the rows' offsets in them."""
    if not words:
        return data[offsets[0] : offsets[-1]], offsets - offsets[0]
    each = [word_places(data[a:z].tobytes())[2] for a, z in zip(offsets[:-1], offsets[1:])]
    return np.concatenate(each), np.cumsum([0, *map(len, each)])


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int, words: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place in it, units, offsets): rows of about ``CHUNK`` bytes, long rows in pieces of ``PIECE`` starts."""
    for first, last in _rows_by_size(offsets, CHUNK):
        units, ends = _units_of(data, offsets[first : last + 1], words)
        if len(units) < 2 * PIECE:
            yield first, 0, units, ends
            continue
        for row, (a, z) in enumerate(zip(ends[:-1], ends[1:]), first):
            for base in range(a, max(z - length + 1, a), PIECE):
                part = units[base : min(base + PIECE + length - 1, z)]
                yield row, base - a, part, np.array([0, len(part)])


def _emit_segments(length: int, seed: int, words: bool):
    """A row for each different segment of a document: its first start, its starts, how often it stands there,
    and if that is more than once all runs of starts."""

    def rows(batch: pa.RecordBatch, first: int, base: int, units: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        row, start, stop, anchor, digest = segments(units, ends, length, seed)
        place = ends[row] - base
        order = np.lexsort((start, digest, anchor, row))
        row, anchor, digest, start, stop, place = (x[order] for x in (row, anchor, digest, start, stop, place))
        start, stop = start - place, stop - place
        change = np.ones(len(row), bool)
        change[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1]) | (digest[1:] != digest[:-1])
        run = change.copy()
        run[1:] |= start[1:] != stop[:-1]
        one, runs = np.flatnonzero(change), np.flatnonzero(run)
        n = np.diff(np.append(one, len(row)))
        group = (np.cumsum(change) - 1)[runs]
        many = n[group] > 1
        a, b = start[runs][many], stop[np.append(runs[1:], len(row)) - 1][many] if len(runs) else start
        sizes = np.bincount(group[many], minlength=len(one))
        more = pa.ListArray.from_arrays(
            pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32), mask=np.append(n == 1, False)),
            pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["a", "b"]),
        )
        taken = pa.array(row[one] + first)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(anchor[one].view(np.int64)), pa.array(digest[one].view(np.int64)), *(batch.column(i).take(taken) for i in range(3)),
                pa.array(start[one].astype(np.int32)), pa.array((stop - start)[one].astype(np.int32)), pa.array(n.astype(np.int32)), more,
            ],
            names=["anchor", "digest", "k1", "k2", "pos", "start", "size", "times", "more"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(*_texts(batch.column(3)), length, words):
                yield rows(batch, *piece)

    return run


def key_bits(table: DataFrame) -> np.ndarray:
    """A bit for each remainder of ``k1`` that the table has; of one size, so what reaches the driver is bounded."""
    bit = F.pmod("k1", F.lit(KEY_BITS))
    held = table.select(F.floor(bit / 32).cast("int").alias("at"), F.expr("shiftleft(1L, CAST(pmod(k1, 32) AS INT))").alias("bit"))
    rows = held.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(KEY_BITS // 32, np.uint32)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint32)
    return out


def _with_bit(bits: np.ndarray):
    """The rows whose ``k1`` has its bit, before their texts are dealt out by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(0).to_numpy() % KEY_BITS
            yield batch.filter(pa.array((bits[bit // 32] >> (bit % 32).astype(np.uint32)) & 1 == 1))

    return run


def _emit_bodies(length: int, words: bool):
    """The units of the wanted segments of every document. Equal rows that follow each other give them once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            data, offsets = _texts(batch.column(3))
            taken, columns = [], [[], [], [], []]
            for i, (k1, k2, wanted) in enumerate(zip(*(batch.column(j) for j in (0, 1, 4)))):
                if (k1.as_py(), k2.as_py()) == before:
                    continue
                before = k1.as_py(), k2.as_py()
                units, _ = _units_of(data, offsets[i : i + 2], words)
                for x in wanted.as_py():
                    taken.append(i)
                    body = units[x["start"] : x["start"] + x["size"] - 1 + length].tobytes()
                    for column, value in zip(columns, (x["anchor"], x["start"], x["hot"], body)):
                        column.append(value)
            of = [batch.column(j).take(pa.array(taken, pa.int64())) for j in range(3)]
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*of, *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["k1", "k2", "pos", "anchor", "start", "hot", "body"])

    return run


def _emit_runs(length: int, keep_first: bool, words: bool):
    """Runs of repeated suffixes of the segments of an anchor, which come together and in the order of their places;
    for a hot anchor a row with the class of every suffix, to be compared beyond this task."""

    def found(batch: pa.RecordBatch, rows: np.ndarray, first: np.ndarray, size: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
        of = [batch.column(j).take(pa.array(rows)) for j in range(4)]
        h = pa.array(more["h"].view(np.int64)) if more else pa.nulls(len(rows), pa.int64())
        return pa.RecordBatch.from_arrays([*of, pa.array(first.astype(np.int32)), pa.array((first + size).astype(np.int32)), h], names=["k1", "k2", "pos", "anchor", "a", "b", "h"])

    def suffixes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place in the segment, hash) of every suffix."""
        data, offsets = _texts(batch.column(6))
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        if words:
            data, offsets = np.frombuffer(data.tobytes(), U64), offsets // 8
        n = np.diff(offsets) - length + 1
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        return row, place, window_hashes(data, length)[offsets[row] + place]

    def cold(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, place, h = suffixes(batch)
        anchor = batch.column(3).to_numpy().view(U64)[row]
        key = h ^ mix(anchor + _ODD[0])
        order = np.argsort(key, kind="stable")
        same = (key[order][1:] == key[order][:-1]) & (anchor[order][1:] == anchor[order][:-1])
        hit = np.zeros(len(row), bool)
        hit[order[1:][same]] = True
        if not keep_first:
            hit[order[:-1][same]] = True
        edge = np.ones(len(row), bool)
        edge[1:] = (row[1:] != row[:-1]) | (hit[1:] != hit[:-1])
        at = np.flatnonzero(edge)
        size = np.diff(np.append(at, len(row)))
        at, size = at[hit[at]], size[hit[at]]
        return found(batch, row[at], batch.column(4).to_numpy()[row[at]] + place[at], size)

    def hot(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, place, h = suffixes(batch)
        return found(batch, row, batch.column(4).to_numpy()[row] + place, np.ones(len(row), np.int64), h=h)

    def once(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Without the rows that equal documents add."""
        keys = [batch.column(j).to_numpy() for j in (0, 1, 3, 4)]
        again = np.logical_and.reduce([k[1:] == k[:-1] for k in keys])
        return batch.filter(pa.array(np.append(True, ~again))) if again.any() else batch

    def ends(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Where anchors begin, with the end, and how many suffixes come before."""
        anchor = batch.column(3).to_numpy()
        at = np.append(np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])), len(anchor))
        units = _texts(batch.column(6))[1] // (8 if words else 1)
        n = np.append(0, np.cumsum(np.diff(units) - length + 1))
        return at, n[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def groups() -> Iterator[pa.RecordBatch]:
            whole = once(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            at, n = ends(whole)
            for a, z in _rows_by_size(n, CHUNK):
                yield cold(whole.slice(at[a], at[z] - at[a]))

        for batch in batches:
            warm = batch.column(5).to_numpy(zero_copy_only=False)
            rest = batch.filter(pa.array(~warm))
            batch = batch.filter(pa.array(warm))
            for a, z in _rows_by_size(np.arange(batch.num_rows + 1), CHUNK // length):
                yield hot(batch.slice(a, z - a))
            if not rest.num_rows:
                continue
            at, _ = ends(rest)
            if held and rest.column(3)[0] != held[-1].column(3)[0]:
                yield from groups()
                held = []
            if len(at) > 2:
                held.append(rest.slice(0, at[-2]))
                yield from groups()
                held, rest = [], rest.slice(at[-2])
            held.append(rest)
        if held:
            yield from groups()

    return run


def factor_spans(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text", words: bool = False) -> DataFrame:
    """Runs ``[a, b)`` of suffix starts to remove, per document key ``(k1, k2)``, as one array ``runs``.

    ``keep_first`` removes starts whose longest previous factor reaches ``length``; otherwise previous or
    next. Positions are ordered by document id, then place in the text.
    """
    seed = min(WORD_SEED if words else SEED, length)
    # Without keep_first no order matters and the ids stay out of the tables.
    pos = F.col(id_col) if keep_first else F.lit(None).cast("int")
    keyed = docs.select(*keys(id_col, text_col), pos.alias("pos"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = keyed.schema["pos"].dataType.simpleString()
    made: list[DataFrame] = []

    def written(df: DataFrame) -> DataFrame:
        # Joins of written tables are dealt anew where a key is frequent; joins of aggregates are not.
        made.append(write_through(df))
        return made[-1]

    every = written(
        keyed.mapInArrow(
            _emit_segments(length, seed, words),
            f"anchor long, digest long, k1 long, k2 long, pos {id_type}, start int, size int, times int, more array<struct<a:int,b:int>>",
        )
    )
    live = written(every.groupBy("anchor").agg(F.sum("times").alias("n"), (F.min("digest") != F.max("digest")).alias("mixed")).where("n > 1").drop("n"))
    near = written(every.join(live, "anchor"))
    place = F.struct("pos", "k1", "k2", "start")
    same = written(
        near.groupBy("anchor", "digest").agg(F.sum("times").alias("n"), F.min(place).alias("first"), F.min("size").alias("size"), F.max("mixed").alias("mixed"))
    )
    again = near.join(same.where("n > 1").select("anchor", "digest", "first"), ["anchor", "digest"])
    runs = F.coalesce("more", F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b"))))
    if keep_first:
        runs = F.when(place == F.col("first"), _without_first(runs)).otherwise(runs)
    spans = again.select("k1", "k2", F.inline(runs))
    # One segment of each kind, where an anchor has several kinds.
    mixed = same.where("mixed")
    kinds = written(mixed.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > MAX_KINDS).select("anchor", F.lit(True).alias("hot")))
    wanted = written(
        mixed.join(kinds, "anchor", "left")
        .groupBy("first.k1", "first.k2")
        .agg(F.collect_list(F.struct("anchor", "first.start", "size", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("wanted"))
    )
    # Most documents have no such segment; their texts need not travel.
    asked = keyed.mapInArrow(_with_bit(key_bits(wanted)), keyed.schema)
    bodies = asked.join(wanted, KEY).select("k1", "k2", "pos", "text", "wanted").mapInArrow(
        _emit_bodies(length, words), f"k1 long, k2 long, pos {id_type}, anchor long, start int, hot boolean, body binary"
    )
    dealt = bodies.repartition(F.when(F.col("hot"), F.xxhash64("k1", "k2", "start")).otherwise(F.col("anchor")))
    found = written(
        dealt.sortWithinPartitions("anchor", "pos", "k1", "k2", "start").mapInArrow(
            _emit_runs(length, keep_first, words), f"k1 long, k2 long, pos {id_type}, anchor long, a int, b int, h long"
        )
    )
    spot = F.struct("pos", "k1", "k2", "a")
    hot = found.where("h IS NOT NULL")
    classes = written(hot.groupBy("anchor", "h").agg(F.count("*").alias("n"), F.min(spot).alias("low")).where("n > 1"))
    hit = hot.join(classes, ["anchor", "h"])
    if keep_first:
        hit = hit.where(spot != F.col("low"))
    spans = spans.union(found.where("h IS NULL").select("k1", "k2", "a", "b")).union(hit.select("k1", "k2", "a", "b"))
    packed = write_through(spans.groupBy(KEY).agg(F.collect_set(F.struct("a", "b")).alias("runs")))
    for df in made:
        drop_table(df)
    return packed


def _without_first(runs: Column) -> Column:
    """The runs without the first segment of a document, which is ``size`` starts from ``start``."""
    after = F.col("start") + F.col("size")
    rest = F.transform(runs, lambda r: F.struct(F.when(r["a"] == F.col("start"), after).otherwise(r["a"]).alias("a"), r["b"].alias("b")))
    return F.filter(rest, lambda r: r["a"] < r["b"])


def keys(id_col: str, text_col: str) -> list:
    """Two hashes of id and text name a row; equal rows share them and their result."""
    pair = [F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit(""))]
    return [F.xxhash64(*pair).alias("k1"), F.xxhash64(F.lit("suffix"), *reversed(pair)).alias("k2")]


def _with_spans(docs: DataFrame, length: int, keep_first: bool, id_col: str, text_col: str, words: bool = False) -> DataFrame:
    """The rows with their runs in a last column, under names that no input column has."""
    k1, k2, runs = (f"_suffix_{x}" for x in ("k1", "k2", "runs"))
    packed = factor_spans(docs, length, keep_first, id_col, text_col, words).withColumnsRenamed({"k1": k1, "k2": k2, "runs": runs})
    one, two = keys(id_col, text_col)
    return docs.withColumn(k1, one).withColumn(k2, two).join(packed, [k1, k2], "left").select(*docs.columns, runs)


def _covered(runs, size: int, length: int) -> np.ndarray:
    """Byte mask of what the strings starting in the runs cover."""
    edge = np.zeros(size + 1, np.int64)
    for r in runs:
        edge[r["a"]] += 1
        edge[r["b"] - 1 + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def summarise(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: bytes, bytes removed, maximal removed runs and the digest of what is left."""
    base = _with_spans(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), length, keep_first, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(batch.column(1), batch.column(2)):
                data, runs, removed, n = _bytes(text), runs.as_py(), 0, 0
                if runs:
                    mask = _covered(runs, len(data), length)
                    removed, n = int(mask.sum()), int((np.diff(np.concatenate([[False], mask]).astype(np.int8)) == 1).sum())
                    rest = np.frombuffer(data, np.uint8)[~mask].tobytes()
                else:
                    rest = data
                out.append((len(data), removed, n, hashlib.sha256(rest).hexdigest()))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string())))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _word_mask(runs, data: bytes, length: int) -> np.ndarray:
    """Byte mask of the words of the runs and of the white space between two of them."""
    starts, ends, _ = word_places(data)
    gone = _covered(runs, len(starts), length)
    edge = np.zeros(len(data) + 1, np.int64)
    stops = np.where(np.append(gone[1:], False), np.append(starts[1:], len(data)), ends)
    np.add.at(edge, starts[gone], 1)
    np.add.at(edge, stops[gone], -1)
    return np.cumsum(edge[:-1]) > 0


def strip_copies(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text", words: bool = False) -> DataFrame:
    """The rows of ``docs`` with later copies cut out of the text, and ``n_removed`` bytes added.

    ``length`` counts bytes, or with ``words`` words. Matches lie within documents. Cuts keep whole characters: a character goes when all its bytes do.
    Null and short texts stay as they are; rows with equal id and text are one document and share its
    result; an empty table stays empty. A column named ``n_removed`` is replaced.
    """
    docs = docs.drop("n_removed")
    base = _with_spans(docs, length, keep_first, id_col, text_col, words)
    at, schema = docs.columns.index(text_col), StructType([*docs.schema.fields, StructField("n_removed", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for text, runs in zip(batch.column(at), batch.column(batch.num_columns - 1)):
                value, runs = text.as_py(), runs.as_py()
                n = 0
                if runs:
                    data = np.frombuffer(_bytes(text), np.uint8)
                    mask = _word_mask(runs, data.tobytes(), length) if words else _covered(runs, len(data), length)
                    heads = np.flatnonzero((data & 0xC0) != 0x80)
                    whole = np.logical_and.reduceat(mask, heads)
                    mask = np.repeat(whole, np.diff(np.append(heads, len(data))))
                    n, value = int(mask.sum()), data[~mask].tobytes().decode("utf-8", "surrogatepass")
                texts.append(value)
                removed.append(n)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int64())], names=schema.fieldNames())

    return base.mapInArrow(run, schema)


def query(docs: DataFrame) -> DataFrame:
    return summarise(docs)
