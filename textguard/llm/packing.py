"""Lexical retrieval packing: a sharded BM25 inverted index hands every seed its unused neighbours."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textguard.llm.common import materialise

WINDOW = 2048
END_ID = 1
SHARD_DOCS = 512
VOCABULARY = 65_536
TAIL_SCHEMA = "kind int, doc_id {id}, rid long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
PIECE_SCHEMA = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> str:
    """The letter by which a byte-level vocabulary file writes each byte: visible Latin-1 ones stand for themselves."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b if b in own else next(others)) for b in range(256))


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """Ids by byte string of a plain byte-level BPE file whose ids follow the order of its merges; None for other files."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = model.get("type") == "BPE" and not spec["normalizer"] and split.get("type") == "ByteLevel" and split.get("use_regex", True)
    if not plain or split.get("add_prefix_space") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    added = {t["content"] for t in spec["added_tokens"]}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(model["vocab"].get(x + y) != 256 + k for k, (x, y) in enumerate(merges)):
        return None
    code = {letter: b for b, letter in enumerate(_byte_letters())}
    return {bytes(code[c] for c in word): n for word, n in model["vocab"].items() if word not in added}


class Encoder:
    """Token ids of whole texts, those of the ``tokenizers`` file. The ids of a plain byte-level BPE are its merge ranks, so
    its merges run in ``tiktoken``, several times as fast; texts with special tokens and other files go to ``tokenizers``."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.tokenizer.get_vocab_size() > VOCABULARY:
            raise ValueError(f"ids are kept in 16 bits: at most {VOCABULARY} tokens")
        ranks = byte_ranks(path)
        self.fast = ranks and tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and not any(s in text for s in self.special):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenise(path: str, window: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        schema = pa.schema([("kind", pa.int32()), ("doc_id", id_type), ("rid", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                doc, rid, text = (batch.column(k)[i].as_py() for k in range(3))
                ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                n = len(ids)
                for at in range(0, n, window):
                    part = ids[at : at + window]
                    full = len(part) == window
                    rows.append((0 if full else 1, doc, rid, at, len(part), _crc(part), n, None if full else part.astype("<u2").tobytes()))
                if len(rows) > 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def _partial_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, tokens, docs = np.zeros(VOCABULARY, np.int64), 0, 0
    for batch in batches:
        for ids in batch.column(0):
            seen = np.frombuffer(ids.as_py(), "<u2")
            df[np.unique(seen)] += 1
            tokens += len(seen)
            docs += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [tokens, docs]))], names=["term", "n"]
    )


def bm25_scores(docs: list[np.ndarray], idf: np.ndarray, mean_length: float, k1: float = 1.2, b: float = 0.75, block: int = 512) -> np.ndarray:
    """Score of every document of a shard for every seed: distinct seed terms against the postings.

    The inverted index is walked in blocks of terms, each a (documents x block) slice of postings, so
    memory follows the shard and the block, not the vocabulary.
    """
    n = len(docs)
    lengths = np.array([len(d) for d in docs], np.int64)
    owner = np.repeat(np.arange(n), lengths)
    pair, count = np.unique(np.concatenate(docs).astype(np.int64) * n + owner, return_counts=True)
    term, owner = pair // n, pair % n
    norm = k1 * (1 - b + b * lengths / mean_length)
    weight = (idf[term] * count * (k1 + 1) / (count + norm[owner])).astype(np.float32)
    distinct, starts = np.unique(term, return_index=True)
    bounds = np.append(starts, len(term))
    scores = np.zeros((n, n), np.float32)
    for at in range(0, len(distinct), block):
        lo, hi = bounds[at], bounds[min(at + block, len(distinct))]
        column = np.searchsorted(distinct[at : at + block], term[lo:hi])
        present = np.zeros((n, min(block, len(distinct) - at)), np.float32)
        postings = np.zeros_like(present)
        present[owner[lo:hi], column] = 1
        postings[owner[lo:hi], column] = weight[lo:hi]
        scores += present @ postings.T
    return scores


def fill_windows(lengths: np.ndarray, scores: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, from, to, sequence, offset) pieces: each seed's window takes its best unused neighbours.

    A neighbour that does not fit is cut and its rest seeds the next window, so only a shard's last
    window is padded. Ties take the earlier document.
    """
    n, out = len(lengths), []
    unused, sequence, rest = np.ones(n, bool), 0, None
    while rest is not None or unused.any():
        if rest is None:
            rest = (int(np.flatnonzero(unused)[0]), 0)
            unused[rest[0]] = False
        seed, free = rest[0], window
        order = iter(np.argsort(-np.where(unused, scores[seed], -np.inf), kind="stable")[: int(unused.sum())])
        current, rest = rest, None
        while current is not None:
            doc, start = current
            take = min(free, int(lengths[doc]) - start)
            out.append((doc, start, start + take, sequence, window - free))
            free -= take
            if start + take < lengths[doc]:
                rest = (doc, start + take)
            current = None
            if free and (following := next(order, None)) is not None:
                unused[following] = False
                current = (int(following), 0)
        sequence += 1
    return out


def _pack(idf: np.ndarray, mean_length: float, window: int):
    def run(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["rid", "start"], kind="stable", ignore_index=True)
        docs = [np.frombuffer(x, "<u2") for x in shard.ids]
        pieces = fill_windows(np.array([len(d) for d in docs]), bm25_scores(docs, idf, mean_length), window)
        of = [p[0] for p in pieces]
        return pd.DataFrame({
            "doc_id": shard.doc_id.take(of).to_numpy(),
            "start": shard.start.to_numpy()[of] + [p[1] for p in pieces],
            "length": [p[2] - p[1] for p in pieces],
            "ids_crc32": [_crc(docs[d][a:z]) for d, a, z, _, _ in pieces],
            "doc_tokens": shard.doc_tokens.to_numpy()[of],
            "sequence_id": [((int(key[0]) << 20) + p[3]) * 2 for p in pieces],
            "offset": [p[4] for p in pieces],
        })

    return run


def pack(docs: DataFrame, window: int = WINDOW, shard_docs: int = SHARD_DOCS, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: every token lies in exactly one, sequences hold at most ``window``.

    Whole windows of a long document stand alone. The remainders go, by a hash of their row, to shards
    of about ``shard_docs``, whose number follows the corpus; each shard is one bounded group with its
    inverted index. Document frequencies and mean length are counted over all remainders (the vocabulary
    bounds that table). Null or empty texts are the end token alone; repeated rows and ids are packed
    each; an empty table gives no pieces.
    """
    if window < 2 or window >= 1 << 20:
        raise ValueError("window out of range")
    base = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.col(text_col).alias("text"))
    id_type = base.schema["doc_id"].dataType
    sql_type = id_type.simpleString()
    tokens = materialise(base.mapInArrow(_tokenise(path or tokenizer_path(), window, to_arrow_type(id_type)), TAIL_SCHEMA.format(id=sql_type)), "tokens")
    tails = tokens.where("kind = 1")
    # At most one row per vocabulary entry and two totals.
    counts = tails.select("ids").mapInArrow(_partial_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(VOCABULARY)
    totals = {-1: 0, -2: 0}
    for term, n in counts:
        if term < 0:
            totals[term] = n
        else:
            df[term] = n
    n_docs = totals[-2]
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
    shards = max(1, -(-n_docs // shard_docs))
    packed = tails.drop("kind", "length", "ids_crc32").withColumn("shard", F.pmod(F.xxhash64("rid", "start"), F.lit(shards))).groupBy("shard").applyInPandas(
        _pack(idf, max(1.0, totals[-1] / max(1, n_docs)), window), PIECE_SCHEMA.format(id=sql_type)
    )
    whole = tokens.where("kind = 0").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return packed.union(whole)


def query(docs: DataFrame) -> DataFrame:
    return pack(docs)
