"""Token counts: pieces are counted once per distinct pre-token and summed by the pre-tokens' frequencies.

A sentencepiece BPE model splits by white space: its pieces hold the space mark only at their start (or are runs of
it), so no merge crosses the border between a character and a following space. A text, with the dummy space the
library puts before it, is therefore cut before each run of spaces into pre-tokens, and its token count is the sum of
theirs. `splits` checks that property of the model, and whole texts are counted without it.

1. The distinct pre-tokens of all documents become one table; each is counted once by the library.
2. Each document's pre-token frequencies are joined to that table in shards (see sharded) and summed; no ids are made
   for documents. Pre-tokens meet by 64-bit hashes, which are multilinear in the bytes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import forget, frees, keep, small_batches, table
from siltstone.llm.sharded import SENT, batched, counted, met, packets, sent_rows, shards_for
from siltstone.llm.shingles import multilinear

SPACE_MARK = "▁"
_PRE_TOKEN = re.compile(r" +[^ ]*")
#: pre-tokens that a task remembers to have named already, 8 bytes each, before it starts anew
NAMED = 2_000_000


def splits(model) -> bool:
    """Whether no piece crosses from a character to a following space, so that pre-tokens can be counted apart."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in pieces):
        return False
    for text in (" a", "  a ", "a▁b", "a  b", "ａ　b"):
        found = Counter(_PRE_TOKEN.findall(" " + text.replace(SPACE_MARK, " ")))
        if sum(piece_count(model, p) * n for p, n in found.items()) != len(model.encode(text)):
            return False
    return True


def piece_count(model, pre_token: str) -> int:
    """Pieces of one pre-token. "a" before it takes the dummy space, so that the pre-token keeps exactly its own spaces."""
    return len(model.encode("a" + pre_token)) - 1


def _pre_tokens(texts: list[str | None], part: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """For parts of the texts: each pre-token's hash, document, begin and length in the part's bytes."""
    at = 0
    while at < len(texts):
        raw, size, first = [], 0, at
        while at < len(texts) and (not raw or size < part):
            t = texts[at]
            raw.append((" " + t.replace(SPACE_MARK, " ")).encode() if t else b"")
            size += len(raw[-1])
            at += 1
        data = b"".join(raw)
        if not data:
            continue
        lengths = np.array([len(r) for r in raw])
        begins = np.cumsum(lengths) - lengths
        space = np.frombuffer(data, np.uint8) == 32
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[begins[lengths > 0]] = True
        starts = np.flatnonzero(start)
        doc = np.repeat(np.arange(first, at), _per_text(start, begins, lengths))
        yield multilinear(np.frombuffer(data, np.uint8), starts).view(np.int64), doc, starts, np.diff(starts, append=len(data)), data


def _per_text(start: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    before = np.concatenate([[0], np.cumsum(start)])
    return before[begins + lengths] - before[begins]


@frees
def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, pre_token): what a task meets, each once while it remembers."""
    known: set[int] = set()
    for batch in batches:
        for h, _, begins, lengths, data in _pre_tokens(batch.column(0).to_pylist()):
            values, at = np.unique(h, return_index=True)
            new = [(v, i) for v, i in zip(values.tolist(), at.tolist(), strict=True) if v not in known]
            if len(known) + len(new) > NAMED:
                known.clear()
            known.update(v for v, _ in new)
            names = [data[begins[i] : begins[i] + lengths[i]].decode() for _, i in new]
            yield pa.record_batch([pa.array([v for v, _ in new], pa.int64()), pa.array(names, pa.string())], names=["h", "pre_token"])


def _counted(batches: Iterator[pa.RecordBatch], model_file: str) -> Iterator[pa.RecordBatch]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    for batch in batches:
        n = [len(ids) - 1 for ids in model.encode(["a" + p for p in batch.column("pre_token").to_pylist()])]
        yield pa.record_batch([batch.column("h"), pa.array(n, pa.float64())], names=["h", "value"])


@frees
def _asked(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Packets of pre-tokens (kind 1) and, for each batch, its documents' ids, whether there is one, and bytes (kind 2)."""
    at = TaskContext.get().partitionId() << 33
    for texts, ids in batched(batches):
        h, doc = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 2, *((h, doc) for h, doc, *_ in _pre_tokens(texts)), strict=True))
        head = np.array([[i or 0 for i in ids], [i is not None for i in ids], [len((t or "").encode()) for t in texts]], "<i8").tobytes()
        rows = [(at % shards, at, 2, 0.0, head)]
        if len(h):
            values, item = np.unique(h, return_inverse=True)
            _, *rest = counted(item.astype(np.int64), doc, len(texts))
            rows += [(i, at, 1, 0.0, data) for i, data in packets(values, *rest, len(texts), shards)]
        yield sent_rows(rows)
        at += 1


def _totalled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (batch, kind, shard): a batch's partial sums, then its head."""
    total: np.ndarray | float = 0.0
    for batch in batches:
        for kind, data in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
            if kind == 1:
                total = total + np.frombuffer(data, "<f8")
                continue
            ids, there, size = np.frombuffer(data, "<i8").reshape(3, -1)
            n = np.zeros(len(ids), np.int64) + np.rint(total).astype(np.int64)
            yield pa.record_batch([pa.array(ids, mask=there == 0), pa.array(size), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])
            total = 0.0


def whole_count(text: Column, model_file: str) -> Column:
    """Number of tokens of a text column (null: 0), text by text; for models whose pieces cross spaces."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for texts in batches:
            yield pd.Series([len(model.encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def count_tokens(docs: DataFrame, model_file: str, max_tokens: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit per row of docs(doc_id, text, ...).

    Null and empty texts: 0 bytes, 0 tokens. Rows keep their doc_id, null included; repeated rows are counted each;
    very long texts are a batch of their own; other columns are ignored; an empty table gives an empty result.
    """
    import sentencepiece

    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    if not splits(sentencepiece.SentencePieceProcessor(model_file=model_file)):
        n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
        out = texts.select("doc_id", n_bytes.alias("n_bytes"), whole_count(F.col("text"), model_file).alias("n_tokens"))
        return out.withColumn("over_limit", F.col("n_tokens") > max_tokens)
    named = keep(texts.select("text").mapInArrow(_named, "h long, pre_token string").distinct(), "pre_tokens")
    pieces = keep(named.mapInArrow(partial(_counted, model_file=model_file), "h long, value double"), "pieces")
    forget(named)
    shards = shards_for(pieces)
    sent = texts.mapInArrow(partial(_asked, shards=shards), SENT)
    found = met(pieces, sent, shards).mapInArrow(_totalled, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > max_tokens)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of all documents by piece_bpe_32k.model; nulls and so on: see count_tokens."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
