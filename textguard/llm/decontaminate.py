"""Benchmark decontamination by greedy string tiling over shared-token seeds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from textguard.llm.common import UPPER, LOWER, shingles

MIN_MATCH = 5
COVERAGE = 0.6
BLOCK_CHARS = 6_000_000
LOW = (1 << 20) - 1
_WORD = regex.compile(r"\w+")
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())  # bytes of other characters are above 0x7F


class Vocabulary(dict):
    """64-bit value of a word, the same in every task; emptied when it grows past a bound."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def tokens(text: str, known: Vocabulary) -> np.ndarray:
    """Values of a text's words, ASCII case folded, punctuation dropped."""
    found = _WORD.findall(text.encode("utf-8", "surrogatepass").translate(_FOLD).decode("utf-8", "surrogatepass"))
    return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    return shingles(words, n) if len(words) >= n else np.zeros(0, np.uint64)


def tile(test: np.ndarray, doc: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (test start, document start, length): longest unmarked common runs first, each word once.

    Karp-Rabin hashes of ``min_match`` words seed the runs; a seed is extended while both sides agree and
    are unmarked. Ties take the smaller test start, then the smaller document start. A run is extended
    from its first seed only, so a text of one repeated word costs one run per diagonal.
    """
    gt, gd = grams(test, min_match), grams(doc, min_match)
    if not len(gt) or not len(gd):
        return []
    order = np.argsort(gt, kind="stable")
    lo = np.searchsorted(gt[order], gd, "left")
    hi = np.searchsorted(gt[order], gd, "right")
    marked_t, marked_d = np.zeros(len(test), bool), np.zeros(len(doc), bool)
    seeds: dict[int, list[int]] = {}
    for j in np.flatnonzero(hi > lo).tolist():
        for k in range(lo[j], hi[j]):
            i = int(order[k])
            seeds.setdefault(i - j, []).append(i)
    tiles = []
    while seeds:
        runs = []
        alive: dict[int, list[int]] = {}
        for diagonal, starts in seeds.items():
            end = -1
            for i in starts:
                if i < end:
                    continue
                j = i - diagonal
                size = min(len(test) - i, len(doc) - j)
                bad = np.flatnonzero((test[i : i + size] != doc[j : j + size]) | marked_t[i : i + size] | marked_d[j : j + size])
                run = int(bad[0]) if len(bad) else size
                if run >= min_match:
                    runs.append((-run, i, j))
                    alive.setdefault(diagonal, []).extend(x for x in starts if i <= x <= i + run - min_match)
                    end = i + run
        if not runs:
            break
        longest = min(runs)[0]
        for negative, i, j in sorted(runs):
            if negative != longest:
                break
            if not marked_t[i : i - negative].any() and not marked_d[j : j - negative].any():
                marked_t[i : i - negative] = True
                marked_d[j : j - negative] = True
                tiles.append((i, j, -negative))
        seeds = alive
    return tiles


class Index:
    """A block of benchmark items: their words and the sorted seed hashes of all of them."""

    def __init__(self, items: list[tuple[object, str]], min_match: int) -> None:
        known = Vocabulary()
        self.min_match = min_match
        self.ids = [i for i, _ in items]
        self.words = [tokens(t, known) for _, t in items]
        sizes = [np.unique(grams(w, min_match)) for w in self.words]
        hashes = np.concatenate([np.zeros(0, np.uint64), *sizes])
        owner = np.repeat(np.arange(len(items)), [len(s) for s in sizes])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner = hashes[order], owner[order]
        # A bit for the low end of every seed: most windows of a text stop here, without a search.
        self.low = np.zeros(LOW + 1, bool)
        self.low[self.hashes & np.uint64(LOW)] = True

    def hits(self, doc: np.ndarray) -> list[int]:
        g = grams(doc, self.min_match)
        g = np.unique(g[self.low[g & np.uint64(LOW)]])
        if not len(self.hashes) or not len(g):
            return []
        at = np.searchsorted(self.hashes, g)
        lo = at[self.hashes[np.minimum(at, len(self.hashes) - 1)] == g]
        hi = np.searchsorted(self.hashes, self.hashes[lo], "right")
        return sorted({int(k) for a, b in zip(lo, hi) for k in self.owner[a:b]})

    def best(self, doc: np.ndarray) -> tuple[float, object]:
        """Highest share of an item's words that tiles cover, and the first such item."""
        best, item = 0.0, None
        for k in self.hits(doc):
            words = self.words[k]
            covered = sum(t[2] for t in tile(words, doc, self.min_match)) / len(words)
            if covered > best:
                best, item = covered, self.ids[k]
        return best, item


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[object, str]]]:
    """Benchmark items in blocks of at most ``limit`` characters (or one item), streamed in id order."""
    rows = benchmark.where(F.col(text_col).isNotNull()).select(id_col, text_col).orderBy(id_col, text_col)
    block, size = [], 0
    for row in rows.toLocalIterator():
        if block and size + len(row[1]) > limit:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    if block:
        yield block


def annotate(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = COVERAGE, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` with ``coverage``, ``benchmark_item`` and ``contaminated`` added.

    The benchmark is the stated query set: it comes in blocks of bounded size, and every block passes
    over all documents, so any benchmark size works alike. Null or empty texts are clean with coverage 0;
    items of fewer than ``min_match`` words
    match nothing; ties keep the first item. Columns of these names are replaced.
    """
    docs = docs.drop("coverage", "benchmark_item", "contaminated")
    at = docs.columns.index(text_col)
    out = docs.withColumn("coverage", F.lit(0.0)).withColumn("benchmark_item", F.lit(None).cast("string"))
    schema = StructType([*docs.schema.fields, StructField("coverage", DoubleType()), StructField("benchmark_item", StringType())])

    def against(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Vocabulary()
            for batch in batches:
                before = zip(batch.column(at), batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1))
                rows = []
                for text, coverage, item in before:
                    old, found = (coverage.as_py(), item.as_py()), index.best(tokens(text.as_py() or "", known))
                    rows.append((found[0], str(found[1])) if found[0] > old[0] else old)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-2], pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.string())],
                    names=schema.fieldNames(),
                )

        return run

    for block in _blocks(benchmark, item_id, item_text, block_chars):
        out = out.mapInArrow(against(Index(block, min_match)), schema)
    return out.withColumn("contaminated", F.col("coverage") >= threshold)


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = annotate(docs.select("doc_id", "text"), benchmark)
    return out.select("doc_id", "contaminated", F.round("coverage", 6).alias("coverage"), F.col("benchmark_item").cast(benchmark.schema["item_id"].dataType).alias("item_id"))
