"""Ranked lexical search by pipelined term partitioning.

The index is partitioned by term: every term belongs to one owner, and owners form a chain from rare to
frequent terms. An item's bundle of accumulators (document, score so far) passes the owners one after the
other; each stage cogroups the bundles with the owner's postings and adds integer contributions. Bundles
and postings are dealt by document shard and block of items, so neither a frequent term nor an item of
many documents is ever one group. The last owner selects the best of a shard, a window the best of all.

A shard is a run of a few thousand documents of one scan task, so the postings of a term in a shard are one
row of packed numbers. Before a bundle moves on, it drops documents that cannot reach the shard's k-th score even
with the largest contributions of the owners still to come; results stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from textguard.llm.common import materialise, mix

TOP = 10
BANDS = (1000, 100, 10)  # owner 0: terms in under one in 1000 documents, and so on
SHARD_DOCS = 4096
SHARD_BYTES = 4 << 20
CHUNK = 1 << 18
ITEM_BITS = 8  # 256 items a block
PLACES = 64
LISTS = "shard long, term long, n_docs long, n_terms long, max_tf long, min_n long, docs binary, tf binary, n binary, ids binary, absent binary"
BUNDLE = "shard long, block long, no int, docs binary, scores binary"
FOUND = "block long, no int, doc_id long, score long"
U64 = np.uint64

_code = np.arange(256)
_term = (_code >= 0x80) | ((_code >= 48) & (_code <= 57)) | ((_code >= 65) & (_code <= 90)) | ((_code >= 97) & (_code <= 122))
_folded = np.where((_code >= 65) & (_code <= 90), _code + 32, _code).astype(np.uint16)
_value = mix(np.arange(PLACES * 256, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(0x632BE59BD9B4E019))


def term_codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, 64-bit code) of every term of a byte array; 0 is no code."""
    inside = _term[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.zeros(0, U64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    letters = _folded[data[inside]]
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    value = _value[((place & (PLACES - 1)) << 8) | letters]
    if lengths.max() > PLACES:
        value = np.where(place >= PLACES, mix(value + place.astype(U64)), value)
    codes = mix(np.add.reduceat(value, first) + lengths.astype(U64))
    codes[codes == 0] = 1
    return starts, codes


def _cuts(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Slices of about ``size`` bytes that end between terms."""
    at = 0
    while at < len(data):
        stop = at + size
        while stop < len(data):
            gaps = np.flatnonzero(~_term[data[stop : stop + size]])
            if len(gaps):
                stop += int(gaps[0])
                break
            stop += size
        yield data[at:stop]
        at = stop


def codes_of_texts(texts: list[pa.Scalar], chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, code) of every term of the texts; null texts have none."""
    owners, codes, waiting, numbers, size = [], [], [], [], 0

    def flush() -> None:
        nonlocal size
        if waiting:
            ends = np.cumsum([len(w) + 1 for w in waiting])
            starts, found = term_codes(np.frombuffer(b" ".join(waiting), np.uint8))
            owners.append(np.array(numbers)[np.searchsorted(ends, starts, "right")])
            codes.append(found)
            waiting.clear()
            numbers.clear()
            size = 0

    for k, text in enumerate(texts):
        data = text.as_buffer() if text.is_valid else b""
        if len(data) > chunk:
            for part in _cuts(np.frombuffer(data, np.uint8), chunk):
                found = term_codes(part)[1]
                owners.append(np.full(len(found), k))
                codes.append(found)
        elif len(data):
            waiting.append(data)
            numbers.append(k)
            size += len(data)
            if size > chunk:
                flush()
    flush()
    return (np.concatenate(owners).astype(np.int64), np.concatenate(codes)) if owners else (np.zeros(0, np.int64), np.zeros(0, U64))


def _packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Binary array of the runs of int32 values that begin at ``starts``."""
    offsets = np.append(starts, len(values)).astype(np.int32) * 4
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(values.astype(np.int32))])


def _shard_rows(shard: int, ids: list, texts: list) -> pa.RecordBatch:
    """The postings of a shard, a row per term, and the shard's own row (term 0) with its documents."""
    owner, code = codes_of_texts(texts)
    n = np.bincount(owner, minlength=len(ids)).astype(np.int64)
    order = np.lexsort((owner, code))
    owner, code = owner[order], code[order]
    head = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1]))[: len(code)])
    tf = np.diff(np.append(head, len(code)))
    owner, code = owner[head], code[head]
    begin = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
    size, names = len(begin) + 1, [x.split()[0] for x in LISTS.split(", ")]
    lead = lambda first, rest: pa.array(np.append(np.int64(first), rest).astype(np.int64))
    none = pa.array([None], pa.binary())
    absent = np.array([i is None for i in ids])
    ids = np.array([i or 0 for i in ids], np.int64)
    columns = [
        pa.array(np.full(size, shard, np.int64)), lead(0, code[begin].view(np.int64)),
        lead((n > 0).sum(), np.diff(np.append(begin, len(code)))), lead(n.sum(), np.zeros(size - 1)),
        lead(0, np.maximum.reduceat(tf, begin) if len(begin) else []), lead(0, np.minimum.reduceat(n[owner], begin) if len(begin) else []),
        *(pa.concat_arrays([none, _packed(v, begin)]) for v in (owner, tf, n[owner])),
        *(pa.array([v.tobytes()] + [None] * (size - 1), pa.binary()) for v in (ids, absent)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
    for batch in batches:
        data = batch.column(1).cast(pa.large_binary())
        for doc, text in zip(batch.column(0).to_pylist(), data):
            ids.append(doc)
            texts.append(text)
            size += len(text.as_buffer()) if text.is_valid else 0
            if len(ids) >= SHARD_DOCS or size >= SHARD_BYTES:
                yield _shard_rows(shard, ids, texts)
                shard, ids, texts, size = shard + 1, [], [], 0
    if ids:
        yield _shard_rows(shard, ids, texts)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owner, code = codes_of_texts(list(batch.column(1).cast(pa.large_binary())))
        pair = np.unique(np.stack([owner, code.view(np.int64)]), axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pair[0])), pa.array(pair[1])], names=["uid", "term"])


@dataclass(frozen=True)
class Index:
    """``lists``: postings by (shard, term); N documents with terms, L terms in all."""

    lists: DataFrame
    n_docs: int
    n_terms: int


def index(docs: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Postings of whole texts; with ``terms``, of those terms only (frequencies stay those of all documents)."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col} must be an integer column")
    lists = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_postings, LISTS)
    if terms is not None:
        zero = docs.sparkSession.range(1).select(F.col("id").alias("term"))
        lists = lists.join(terms.select("term").union(zero).distinct(), "term")
    lists = materialise(lists.select(*(x.split()[0] for x in LISTS.split(", "))), "postings")
    n_docs, n_terms = lists.where("term = 0").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    return Index(lists, n_docs or 0, n_terms or 0)


def _mass(n: int | str, found: Index) -> str:
    return f"(10 + (90 * {n} * {found.n_docs}) div {max(1, found.n_terms)})"


def _routes(asked: DataFrame, found: Index, bands: tuple[int, ...]) -> DataFrame:
    """Per (term, block): its owner, weight and the items that hold it, each with ``rest``, the largest score
    that the owners after this one could still add to the item."""
    df = found.lists.where("term <> 0").groupBy("term").agg(F.sum("n_docs").alias("df"), F.max("max_tf").alias("t"), F.min("min_n").alias("l"))
    df = df.withColumn("w", F.floor(1000 * F.log((F.lit(2.0) * found.n_docs + 2) / (2 * F.col("df") + 1))))
    owner = F.lit(0)
    for band in bands:
        owner = owner + (F.col("df") * band >= found.n_docs).cast("int")
    df = df.select("term", "w", owner.alias("owner"), F.expr(f"w * ((1000000000 * t) div (1000 * t + 8 * {_mass('l', found)}))").alias("most"))
    held = asked.join(df, "term")
    later = Window.partitionBy("uid").orderBy("owner").rowsBetween(1, Window.unboundedFollowing)
    rest = held.groupBy("uid", "owner").agg(F.sum("most").alias("most"))
    rest = rest.select("uid", "owner", F.coalesce(F.sum("most").over(later), F.lit(0)).alias("rest"))
    held = held.drop("most").join(rest, ["uid", "owner"])
    no = F.col("uid").bitwiseAND(F.lit((1 << ITEM_BITS) - 1)).cast("int")
    return held.groupBy("term", "owner", "w", F.shiftright("uid", ITEM_BITS).alias("block")).agg(
        F.collect_list(no).alias("items"), F.collect_list("rest").alias("rests")
    )


def _stage(found: Index, top: int, last: bool):
    n_docs, n_terms = found.n_docs, max(1, found.n_terms)

    def best(scores: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> np.ndarray:
        held = np.flatnonzero(scores > 0)
        if len(held) > top:
            held = held[scores[held] >= np.partition(scores[held], -top)[-top]]
        return held[np.lexsort((ids[held], absent[held], -scores[held]))][:top]

    def run(key: tuple, bundles: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        shard, block = (int(k) for k in key)
        own = lists[lists.term == 0]
        lists = lists[lists.term != 0]
        packed = [*bundles.docs, *lists.docs]
        size = 1 + max((int(np.frombuffer(d, np.int32).max()) for d in packed if len(d)), default=-1)
        if last:
            ids, absent = np.frombuffer(own.ids.iloc[0], np.int64), np.frombuffer(own.absent.iloc[0], bool)
            size = len(ids)
        scores: dict[int, np.ndarray] = {}
        for no, docs, so_far in zip(bundles.no, bundles.docs, bundles.scores):
            scores[no] = np.zeros(size, np.int64)
            scores[no][np.frombuffer(docs, np.int32)] = np.frombuffer(so_far, np.int64)
        rest: dict[int, int] = {}
        for w, docs, tf, n, items, rests in zip(lists.w, lists.docs, lists.tf, lists.n, lists["items"], lists.rests):
            docs, tf, n = (np.frombuffer(x, np.int32).astype(np.int64) for x in (docs, tf, n))
            gain = int(w) * ((1_000_000_000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))
            for no, r in zip(items, rests):
                if no not in scores:
                    scores[no] = np.zeros(size, np.int64)
                scores[no][docs] += gain
                rest[no] = r
        if last:
            rows = [(block, no, None if absent[d] else int(ids[d]), int(s[d])) for no, s in scores.items() for d in best(s, ids, absent)]
            out = pd.DataFrame(rows, columns=["block", "no", "doc_id", "score"], dtype=object)
            return out.astype({"block": "int64", "no": "int32", "doc_id": "Int64", "score": "int64"})
        rows = []
        for no, s in scores.items():
            held = np.flatnonzero(s)
            if no in rest and len(held) >= top:
                held = held[s[held] + rest[no] >= np.partition(s[held], -top)[-top]]
            rows.append((shard, block, no, held.astype(np.int32).tobytes(), s[held].tobytes()))
        return pd.DataFrame(rows, columns=["shard", "block", "no", "docs", "scores"]).astype({"shard": "int64", "block": "int64", "no": "int32"})

    return run


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, bands: tuple[int, ...] = BANDS, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The ``top`` documents of every item: ``item_id, rank, doc_id, score``, scores above 0, ties by ascending id.

    A null, empty or termless text of a document is never found, and of an item finds nothing. Ids of documents are integers;
    null ids come last among ties. Repeated rows, of documents or items, are documents or items of their own and
    each gets its rows. Only the named columns are read. Empty tables give no rows. Terms are compared by 64-bit codes.
    """
    uid = F.monotonically_increasing_id().alias("uid")
    asked = materialise(items.select(uid, F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("item_text")), "items")
    terms = materialise(asked.select("uid", "item_text").mapInArrow(_item_terms, "uid long, term long"), "item_terms")
    found = index(docs, terms, id_col, text_col)
    routes = materialise(_routes(terms, found, bands), "routes")
    blocks = routes.select("block").distinct()
    # The shard rows go to the last owner, once for each block of items.
    ends = blocks.select(
        F.lit(0).cast("long").alias("term"), F.lit(len(bands)).alias("owner"), F.lit(0).cast("long").alias("w"), "block",
        F.array().cast("array<int>").alias("items"), F.array().cast("array<long>").alias("rests"),
    )
    bundles = docs.sparkSession.createDataFrame([], BUNDLE)
    key = ["shard", "block"]
    for k in range(len(bands) + 1):
        owned = routes.where(F.col("owner") == k)
        if k == len(bands):
            owned = owned.unionByName(ends)
        lists = found.lists.join(owned, "term").select(*key, "term", "w", "docs", "tf", "n", "ids", "absent", "items", "rests")
        last = k == len(bands)
        bundles = bundles.groupBy(*key).cogroup(lists.groupBy(*key)).applyInPandas(_stage(found, top, last), FOUND if last else BUNDLE)
    order = Window.partitionBy("block", "no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = bundles.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    ranked = ranked.withColumn("uid", F.shiftleft("block", ITEM_BITS).bitwiseOR(F.col("no").cast("long")))
    return ranked.join(asked.select("uid", "item_id"), "uid").select("item_id", "rank", "doc_id", "score")


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents
), i AS (SELECT row_number() OVER () AS q, item_id, list_distinct({_TERMS}) AS t FROM benchmark
), a AS (SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0
), x AS (SELECT q, unnest(t) AS term FROM i
), p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM x) GROUP BY ALL
), w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, a GROUP BY term, n
), m AS (SELECT r, doc_id, 100 - 90 + ((90 * len(t) * n) // l) AS m FROM d, a WHERE len(t) > 0
), s AS (
  SELECT q, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM x JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY q, r
), k AS (
  SELECT q, doc_id, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, r) AS INTEGER) AS rank FROM s JOIN m USING (r) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM k JOIN i USING (q) WHERE rank <= 10
"""
