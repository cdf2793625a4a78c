"""Perplexity by an interpolated modified Kneser-Ney model of characters, order 4, joined to documents in shards.

Every code point is a symbol (white space counts as a space) and nothing is capped: counts, probabilities and back-off
weights are tables that grow with the trusted text. An n-gram is a context of up to three symbols of 21 bits and a
symbol, so its suffix and its context's own n-gram are bit operations.

With interpolation the log probability of a position is log(1/V) plus, for each order, the log back-off weight of its
context and, where the n-gram was seen, log p(n-gram) - log(back-off weight * p(suffix)). So a document's log
probability is a sum over its own distinct n-grams of their count times one number, and unseen n-grams add nothing.
They meet the model's numbers in shards, by 64-bit hashes (see sharded).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import frees, keep
from siltstone.llm.sharded import CHARS, SENT, batched, counted, met, packets, sent_rows, shards_for

ORDER, BORDER, BITS = 4, 0x110000, 21
MASK = (1 << BITS) - 1


def _symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols by local numbers, each one's document and place (three borders come first, one last), code points by number."""
    points = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    lengths = np.array([len(p) for p in points], np.int32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), lengths + ORDER)
    place = np.arange(len(doc), dtype=np.int32)
    place -= (np.cumsum(lengths + ORDER, dtype=np.int32) - (lengths + ORDER))[doc]
    s = np.full(len(doc), BORDER, np.int32)
    if len(points):
        s[(place >= ORDER - 1) & (place < (lengths + ORDER - 1)[doc])] = np.concatenate(points)
    s[(s >= 9) & (s <= 13)] = 32
    number = np.zeros(BORDER + 1, np.int32)
    number[s] = 1
    used = np.flatnonzero(number)
    number[used] = np.arange(len(used))
    return number[s], doc, place, used


def _coded(s: np.ndarray, k: int, most: int):
    """A number below `most` for the k symbols ending at each place from k - 1 on, and how to get the symbols back."""
    size, n = int(s.max()) + 1, len(s) - k + 1
    code, ranks = s[:n].astype(np.int64), []
    direct = size**k <= most
    for j in range(1, k):
        code *= size
        code += s[j : n + j]
        if not direct:
            values, code = np.unique(code, return_inverse=True)
            code = code.astype(np.int64, copy=False)
            ranks.append(values)

    def symbols(c: np.ndarray) -> list[np.ndarray]:
        out = []
        for j in range(k - 1):
            c = c if direct else ranks[-1 - j][c]
            out.append(c % size)
            c = c // size
        return [c, *reversed(out)]

    return code, symbols


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashed(symbols: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(symbols[0]), len(symbols), np.uint64)
    for x in symbols:
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + x.astype(np.uint64) + np.uint64(1))
    return h.view(np.int64)


@frees
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ctx, sym, n): the n-grams of order 4 of each batch of documents."""
    for texts, _ in batched(batches, CHARS // 2):
        s, _, place, used = _symbols(texts)
        code, symbols = _coded(s, ORDER, 2**63 - 1)
        code, n = np.unique(code[place[ORDER - 1 :] >= ORDER - 1], return_counts=True)
        a, b, c, d = (used[x] for x in symbols(code))
        yield pa.record_batch([pa.array(a << 2 * BITS | b << BITS | c), pa.array(d), pa.array(n.astype(np.int64))], names=["ctx", "sym", "n"])


def _named(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(h, value) of (ctx, sym, value) of order k."""
    for batch in batches:
        ctx, sym, value = (batch.column(i).to_numpy() for i in range(3))
        h = _hashed([*(ctx >> BITS * (k - 2 - j) & MASK for j in range(k - 1)), sym])
        yield pa.record_batch([pa.array(h), pa.array(value)], names=["h", "value"])


def _cuts(counts: DataFrame) -> list[float]:
    """The three discounts of one order."""
    n1, n2, n3, n4 = (float(x or 0) for x in counts.agg(*[F.count_if(F.col("n") == i) for i in range(1, 5)]).first())
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    cut = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.1), i + 0.9) for i, d in enumerate(cut)]


def train(texts: DataFrame) -> tuple[DataFrame, float] | None:
    """The model's table (h, value) and the constant of every position, from texts(text, key); None without any text."""
    counts = texts.mapInArrow(_counted, "ctx long, sym long, n long").groupBy("ctx", "sym").agg(F.sum("n").alias("n"))
    order = {ORDER: keep(counts, "ngrams")}
    if order[ORDER].isEmpty():
        return None
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("ctx").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1)).alias("ctx")
        order[k] = keep(order[k + 1].groupBy(suffix, "sym").agg(F.count("*").alias("n")), f"ngrams{k}")
    fresh = 1 / (order[1].count() + 1)  # one more for symbols never seen
    rows, constant, below = None, 0.0, None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = _cuts(order[k])
        lost = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        context = order[k].groupBy("ctx").agg(F.sum("n").alias("total"), (F.sum(lost) / F.sum("n")).alias("back_off"))
        p = order[k].join(context.hint("shuffle_hash"), "ctx")
        if k == 1:
            p = p.withColumn("lower", F.lit(fresh))
            constant = float(np.log2(fresh * context.first().back_off))
        else:
            p = p.withColumn("end", F.col("ctx").bitwiseAND(F.lit((1 << BITS * (k - 2)) - 1))).join(below.hint("shuffle_hash"), ["end", "sym"])
        lower = F.col("back_off") * F.col("lower")
        p = keep(p.select("ctx", "sym", ((F.col("n") - lost) / F.col("total") + lower).alias("p"), lower.alias("lower")), f"shares{k}")
        below = p.select(F.col("ctx").alias("end"), "sym", F.col("p").alias("lower"))
        found = p.select("ctx", "sym", F.log2(F.col("p") / F.col("lower")).alias("value")).mapInArrow(partial(_named, k=k), "h long, value double")
        if k > 1:
            weight = context.select(F.shiftright("ctx", BITS).alias("ctx"), F.col("ctx").bitwiseAND(F.lit(MASK)).alias("sym"), F.log2("back_off").alias("value"))
            found = found.unionByName(weight.mapInArrow(partial(_named, k=k - 1), "h long, value double"))
        rows = found if rows is None else rows.unionByName(found)
    return keep(rows.groupBy("h").agg(F.sum("value").alias("value")), "model"), constant


def _packets(texts: list, shards: int) -> Iterator[tuple[int, bytes]]:
    """(shard, packed n-grams): each distinct n-gram of a batch once, with its documents (as steps) and counts there."""
    s, doc, place, used = _symbols(texts)
    docs = len(texts)
    empty = np.array([not t for t in texts])
    hashes, per, steps, counts = [], [], [], []
    for k in range(1, ORDER + 1):
        code, symbols = _coded(s, k, 2**62 // docs)
        d, at = doc[k - 1 :], place[k - 1 :]
        # contexts of the first position are n-grams of borders alone, once a document
        real = at >= ORDER - 1 if k in (1, ORDER) else (at >= ORDER - 1) | (at == ORDER - 2) & ~empty[d]
        code = code[real]
        gram, *rest = counted(code, d[real], docs)
        del code
        hashes.append(_hashed([used[x] for x in symbols(gram)]))
        for column, value in zip((per, steps, counts), rest, strict=True):
            column.append(value)
    yield from packets(*map(np.concatenate, (hashes, per, steps, counts)), docs, shards)


@frees
def _asked(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Packets (kind 1) and, for each batch, its documents' keys and positions (kind 2)."""
    at = TaskContext.get().partitionId() << 33
    for texts, keys in batched(batches):
        head = np.array([keys, [len(t or "") + 1 for t in texts]], "<i8").tobytes()
        yield sent_rows([*((i, at, 1, 0.0, data) for i, data in _packets(texts, shards)), (at % shards, at, 2, 0.0, head)])
        at += 1


def _summed(batches: Iterator[pa.RecordBatch], constant: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (batch, kind, shard): a batch's partial sums, then its head."""
    total: np.ndarray | float = 0.0
    for batch in batches:
        for kind, data in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
            if kind == 1:
                total = total + np.frombuffer(data, "<f8")
            else:
                keys, n = np.frombuffer(data, "<i8").reshape(2, -1)
                yield pa.record_batch([pa.array(keys), pa.array(np.exp2(-(total / n + constant)))], names=["key", "perplexity"])
                total = 0.0


def perplexities(docs: DataFrame, model: tuple[DataFrame, float]) -> DataFrame:
    """key, perplexity per character, the end included, for docs(text, key); one row a key, which names one text."""
    table, constant = model
    shards = shards_for(table)
    sent = docs.select("text", "key").mapInArrow(partial(_asked, shards=shards), SENT)
    found = met(table, sent, shards).mapInArrow(partial(_summed, constant=constant), "key long, perplexity double")
    return keep(found.groupBy("key").agg(F.max("perplexity").alias("perplexity")), "perplexities")
