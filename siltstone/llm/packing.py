"""Mixture-controlled packing: deficit round-robin over source queues into fixed-length sequences.

Every source is a queue of token packets (a document's ids, cut at `length`). A round (window) of `window` tokens
credits each queue with its share; a queue may send a packet once its credit, carried over from earlier rounds, covers
the packet. Because credits grow evenly, the round of a packet is known from the end of the packet in its queue:
the first k with (k + 1) * credit >= end. So no loop runs over windows: prefix sums over queues give every packet's
round at once, and deficits carry across windows and partitions by arithmetic. The sequence of packets by
(round, source, place in the queue) is then cut into sequences of `length` tokens; only the very last one is padded.

Without targets a source's share is its share of all tokens, which makes every window a small copy of the mixture and
empties all queues in the last round. With targets a queue that is drained sends no more, as in any round-robin.

Prefix sums take two levels (hashed blocks of a queue, then blocks), so that a source with a third of all rows is spread
over `blocks` groups.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import keep, small_batches, table

LENGTH, WINDOW, END = 2048, 64 * 2048, 1
_BREAKS = re.compile("[ \n\t\r]+")
_PLAIN = re.compile("([a-zß-öø-ÿ]+)([.,;:!?#$%&*]*)")
_encoders: dict[str, "Encoder"] = {}


class Encoder(dict):
    """White-space-separated chunk -> its ids as bytes, by the tokenizer itself; kept while the Python worker lives.

    At most `most` chunks are kept, in two halves: when the newer is full, it becomes the older, whose chunks come back
    as they are met. So frequent chunks stay, and only those not met for long are forgotten.
    The tokenizer drops white space, so the ids of a text are those of its chunks. A chunk of plain letters is one
    pre-token, and its model can be asked directly; marks after it are pre-tokens of their own.
    """

    def __init__(self, path: str, dtype: str, most: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize, self.half, self.older = self.tokenizer.model.tokenize, most // 2, {}
        self.pack = struct.Struct("<" + {"<u2": "H", "<u4": "I"}[dtype]).pack
        # the byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in shown]
        self.alphabet = {b: 256 + i for i, b in enumerate(others)}
        probe = ["idiot", "über", "élan", "thinner", "a", "ið"]
        self.direct = all([t.id for t in self._plain(w)] == self.tokenizer.encode(w, add_special_tokens=False).ids for w in probe)

    def _plain(self, word: str) -> list:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.alphabet)
        return self.tokenize(word)

    def __missing__(self, chunk: str) -> bytes:
        if (packed := self.older.get(chunk)) is not None:
            pass
        elif self.direct and (m := _PLAIN.fullmatch(chunk)):
            packed = self[m[1]] + self[m[2]] if m[2] else b"".join([self.pack(t.id) for t in self._plain(chunk)])
        else:
            packed = b"".join(map(self.pack, self.tokenizer.encode(chunk, add_special_tokens=False).ids))
        if len(chunk) <= 64:
            if len(self) >= self.half:
                self.older = self.copy()
                self.clear()
            self[chunk] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "Σ" not in text and "İ" not in text:  # else lower case depends on neighbours or changes the length
            text = text.lower()
        # str.split also cuts at four control characters, which the tokenizer keeps
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        return b"".join(map(self.__getitem__, filter(None, _BREAKS.split(text)) if odd else text.split()))


def encoder(path: str, dtype: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path, dtype)
    return _encoders[path]


def packets(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """doc_id, source, row (unique per document row), place, length, doc_tokens, ids: the packets of every document.

    ids are little-endian, 2 bytes each where the vocabulary allows, else 4. The table is written once, so that `row`
    stays what it is.
    """
    from tokenizers import Tokenizer

    dtype = "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) <= 65536 else "<u4"
    width, end = np.dtype(dtype).itemsize, np.array([END], dtype).tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("row", pa.int64()), ("place", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, row = encoder(tokenizer, dtype), TaskContext.get().partitionId() << 33
        for batch in (b.slice(i, 100) for b in batches for i in range(0, b.num_rows, 100)):
            out: list[list] = [[] for _ in schema]
            doc_ids, texts, sources = (c.to_pylist() for c in batch.columns)
            for doc_id, text, source in zip(doc_ids, texts, sources, strict=True):
                ids = tokens.encode(text) + end
                n = len(ids) // width
                for at in range(0, n, length):
                    part = ids[at * width : (at + length) * width]
                    for column, value in zip(out, (doc_id, source, row, at, len(part) // width, n, part), strict=True):
                        column.append(value)
                row += 1
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    spark_schema = "doc_id long, source string, row long, place long, length long, doc_tokens long, ids binary"
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"))
    return keep(chosen.mapInArrow(cut, spark_schema), "packets")


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, window: int = WINDOW, targets: DataFrame | None = None, blocks: int = 1024) -> DataFrame:
    """Pieces of docs(doc_id, text, source, ...) in sequences of `length` tokens; every id lies in one piece.

    targets(source, share) sets token proportions (a source without a positive share keeps its natural one).
    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, window.
    Null texts are empty (their end id alone); a null source is a queue of its own; a null doc_id stays null; repeated
    rows are packed each; other columns are ignored; an empty table gives no pieces.
    """
    spark = docs.sparkSession
    cut = packets(docs, tokenizer, length)
    # one row a document; null sources share a queue
    heads = cut.where("place = 0").select("row", "doc_id", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))).alias("queue"), "doc_tokens")
    heads = heads.withColumn("block", F.pmod(F.xxhash64("doc_id", "row"), F.lit(blocks)))
    sums = heads.groupBy("queue", "block").agg(F.sum("doc_tokens").alias("held"))
    by_queue = Window.partitionBy("queue")
    sums = sums.select("queue", "block", (F.sum("held").over(by_queue.orderBy("block")) - F.col("held")).alias("base"), F.sum("held").over(by_queue).alias("queue_tokens"))
    all_tokens = heads.agg(F.sum("doc_tokens")).first()[0] or 0
    rounds = max(1, -(-all_tokens // window))
    starts = heads.join(sums, ["queue", "block"]).withColumn(
        "doc_start",
        F.col("base") + F.sum("doc_tokens").over(Window.partitionBy("queue", "block").orderBy("doc_id", "row")) - F.col("doc_tokens"),
    )
    # a queue earns queue_tokens / rounds (or its target's share of a window) each round
    earned = [F.col("queue_tokens").cast("decimal(19,0)"), F.lit(rounds).cast("decimal(19,0)")]
    if targets is not None:
        wanted = targets.where("share > 0").groupBy(F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))).alias("queue")).agg(F.max("share").alias("share"))
        scale = 1_000_000
        starts = starts.join(wanted, "queue", "left")
        per_round = F.greatest(F.lit(1), F.round(F.col("share") * window * scale)).cast("decimal(19,0)")
        earned = [F.coalesce(per_round, earned[0]), F.when(per_round.isNull(), earned[1]).otherwise(F.lit(scale).cast("decimal(19,0)"))]
    lengths = F.sequence(F.lit(0).cast("long"), F.expr(f"(doc_tokens - 1) div {length}"))
    sent = starts.select("row", "queue", "doc_start", "doc_tokens", earned[0].alias("earned"), earned[1].alias("rounds"), F.explode(lengths).alias("k")).select(
        "row", "queue", "earned", "rounds", (F.col("k") * length).alias("place"), (F.col("doc_start") + F.col("k") * length).alias("from"),
        F.least(F.lit(length).cast("long"), F.col("doc_tokens") - F.col("k") * length).alias("n"),
    )
    sent = sent.select("row", "place", "queue", "from", "n", F.expr("(cast(`from` + n as decimal(19,0)) * rounds - 1) div earned").cast("long").alias("window"))
    order = Window.partitionBy("window").orderBy("queue", "from")
    sent = sent.withColumn("inside", F.sum("n").over(order) - F.col("n"))
    # where each round begins: again two levels
    each = sent.groupBy("window").agg(F.sum("n").alias("n")).withColumn("thousand", F.expr("window div 4096"))
    many = each.groupBy("thousand").agg(F.sum("n").alias("n"))
    many = many.select("thousand", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("thousand")) - F.col("n")).alias("first"))
    each = each.join(many, "thousand").select("window", (F.col("first") + F.sum("n").over(Window.partitionBy("thousand").orderBy("window")) - F.col("n")).alias("begin"))
    at = F.col("begin") + F.col("inside")
    placed = sent.join(each, "window").select("row", "place", "window", "n", at.alias("at"))
    pieces = placed.withColumn("sequence_id", F.explode(F.expr(f"sequence(at div {length}, (at + n - 1) div {length})")))
    pieces = pieces.select(
        "row", "place", "window", "sequence_id",
        F.greatest(F.lit(0).cast("long"), F.col("sequence_id") * length - F.col("at")).alias("skip"),
        F.least(F.col("n"), (F.col("sequence_id") + 1) * length - F.col("at")).alias("until"),
        F.greatest(F.lit(0).cast("long"), F.col("at") - F.col("sequence_id") * length).alias("offset"),
    )
    joined = cut.join(pieces, ["row", "place"]).select("doc_id", (F.col("place") + F.col("skip")).alias("start"), (F.col("until") - F.col("skip")).alias("length"), "ids", "skip", "doc_tokens", "sequence_id", "offset", "source", "window", (F.octet_length("ids") / cut["length"]).cast("int").alias("width"))
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, window long"
    small_batches(spark)
    return joined.mapInArrow(_check_sums, out)


def _check_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a packet's ids by the CRC of the piece's own, as little-endian unsigned 32-bit numbers."""
    for batch in batches:
        sums = [
            zlib.crc32(np.frombuffer(ids, f"<u{width}")[skip : skip + n].astype("<u4").tobytes())
            for ids, skip, n, width in zip(*(batch.column(c).to_pylist() for c in ("ids", "skip", "length", "width")), strict=True)
        ]
        columns = {name: batch.column(name) for name in batch.schema.names if name not in ("ids", "skip", "width")}
        columns["ids_crc32"] = pa.array(sums, pa.int64())
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "window"]
        yield pa.record_batch([columns[n] for n in names], names=names)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
