"""A join of documents' counted items (n-grams, pre-tokens) with one number an item, in shards by the items' hashes.

Documents are taken in batches. A batch's items, each once with the documents that hold it and how often, go to their
shards in packed form, meet the numbers there, and come back as one partial sum a document and shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import frees

#: characters and documents in a batch (a longer document is a batch of its own); rows of numbers in a shard, about
CHARS, DOCS, SHARD = 4_000_000, 8192, 1_000_000
_ZSTD = pa.Codec("zstd", compression_level=7)


def batched(batches: Iterator[pa.RecordBatch], chars: int = CHARS) -> Iterator[tuple[list, list]]:
    """Texts and keys (the first two columns) of a batch of documents."""
    texts, keys, size = [], [], 0
    for batch in batches:
        for text, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if texts and (size + len(text or "") > chars or len(texts) == DOCS):
                yield texts, keys
                texts, keys, size = [], [], 0
            texts.append(text)
            keys.append(key)
            size += len(text or "")
    if texts:
        yield texts, keys


def _planes(a: np.ndarray) -> bytes:
    return a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def _from_planes(data: bytes, at: int, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel()


def counted(item: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of items numbered from 0 with their documents: the distinct numbers, how many documents each has, their steps and counts."""
    both = item * docs
    both += doc
    both.sort()
    change = np.ones(len(both), bool)
    np.not_equal(both[1:], both[:-1], out=change[1:])
    first = np.flatnonzero(change)
    n = np.diff(first, append=len(both))
    both = both[first]
    item, d = both // docs, both % docs
    begin = np.flatnonzero(np.diff(item, prepend=-1))
    step = np.diff(d, prepend=0)
    step[begin] = d[begin]
    return item[begin], np.diff(begin, append=len(item)), step.astype("<u2"), n.astype("<u4")


def packets(h: np.ndarray, per: np.ndarray, steps: np.ndarray, counts: np.ndarray, docs: int, shards: int) -> Iterator[tuple[int, bytes]]:
    """(shard, packed items) of a batch: its items' hashes in order, as gaps, and counted()'s numbers of each."""
    shard = h % shards
    order = np.lexsort((h, shard))
    h, begin, per, shard = h[order], (np.cumsum(per) - per)[order], per[order], shard[order]
    ends = np.cumsum(per)
    moved = np.repeat(begin - (ends - per), per) + np.arange(len(steps))
    steps, counts = steps[moved], counts[moved]
    edges = np.searchsorted(shard, np.arange(shards + 1))
    for i in range(shards):
        a, b = edges[i], edges[i + 1]
        if a == b:
            continue
        x, y = ends[a] - per[a], ends[b - 1]
        gaps = np.diff(h[a:b].view(np.uint64), prepend=np.uint64(0))
        raw = _planes(gaps) + _planes(per[a:b].astype("<u2")) + _planes(steps[x:y]) + _planes(counts[x:y])
        yield i, np.array([b - a, y - x, docs], "<i8").tobytes() + _ZSTD.compress(raw, asbytes=True)


def numbers(table: DataFrame, shards: int) -> DataFrame:
    """Rows of table(h, value) on their way to the shards."""
    return table.select(F.pmod("h", F.lit(shards)).alias("shard"), F.col("h").alias("batch"), F.lit(0).alias("kind"), F.col("value").cast("double"), F.lit(None).cast("binary").alias("data"))


def met(table: DataFrame, sent: DataFrame, shards: int) -> DataFrame:
    """Partial sums and heads, dealt by batch and sorted by (batch, kind, shard)."""
    here = numbers(table, shards).unionByName(sent).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "batch").mapInArrow(_met, SENT)
    return here.repartition("batch").sortWithinPartitions("batch", "kind", "shard")


def shards_for(table: DataFrame) -> int:
    """More shards than cores, so that all have work; more still where the table is large."""
    return max(2 * table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // SHARD))


def sums(data: bytes, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A packet's sum for each document of its batch."""
    n, m, docs = (int(x) for x in np.frombuffer(data, "<i8", 3))
    raw = pa.decompress(data[24:], n * 10 + m * 6, "zstd", asbytes=True)
    h = np.cumsum(_from_planes(raw, 0, n, "<u8")).view(np.int64)
    per = _from_planes(raw, 8 * n, n, "<u2").astype(np.int64)
    steps = _from_planes(raw, 10 * n, m, "<u2").astype(np.int64)
    counts = _from_planes(raw, 10 * n + 2 * m, m, "<u4")
    begin = np.cumsum(per) - per
    doc = np.cumsum(steps)
    doc -= np.repeat(doc[begin] - steps[begin], per)
    at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
    value = np.where(known[at] == h, values[at], 0.0) if len(known) else np.zeros(n)
    return np.bincount(doc, np.repeat(value, per) * counts, docs)


SENT = "shard long, batch long, kind int, value double, data binary"


def sent_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.binary()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["shard", "batch", "kind", "value", "data"])


@frees
def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, kind): a shard's model rows (kind 0, the hash as batch), its packets, then heads."""
    at, parts, known, values = None, [], None, None
    for batch in batches:
        shard, h, kind, value = (batch.column(i).to_numpy() for i in range(4))
        cuts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1), len(shard)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if shard[a] != at:
                at, parts, known = shard[a], [], None
            if kind[a] == 0:
                parts.append((h[a:b].copy(), value[a:b].copy()))
                continue
            if known is None:
                known, values = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0))
                order = np.argsort(known)
                known, values = known[order], values[order]
            for i in range(a, b):
                data = batch.column(4)[i].as_py()
                yield sent_rows([(at, h[i], kind[i], 0.0, sums(data, known, values).astype("<f8").tobytes() if kind[i] == 1 else data)])
