"""WARC fixity audit with Merkle trees over ordered offset ranges.

Each replica's records (file, offset, length, digest) are leaves. A file is cut into ranges of `span` bytes; a range's
hash covers the offsets and digests of the records that begin in it, in order; every further level covers FAN ranges
of the one below, up to one root a file. The audit compares roots and goes down only where hashes differ; at the
bottom it compares the records of the differing ranges and names each damaged one. A level is joined to the few
mismatches above it, so sound files cost one comparison.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import keep, table

FAN, SPAN, RECORDS = 16, 1 << 16, 1024
_HEAD = "WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "


def warc_record(uri: Column, payload: Column) -> Column:
    """The bytes of one WARC record (nulls: empty)."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(F.lit(_HEAD), F.coalesce(uri, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n")).cast("binary")


def read_warc(files: DataFrame) -> DataFrame:
    """file, offset, length, uri, digest of every record of binaryFile rows (path, content): uncompressed WARC files.

    Bytes that don't parse as a record end the file with one row of null uri that covers the rest.
    """

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = re.compile(rb"WARC/1\.\d\r\n(.*?)\r\n\r\n", re.S)
        for batch in batches:
            out: list[tuple] = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                at, data = 0, data or b""
                while at < len(data):
                    m = head.match(data, at)
                    size = m and re.search(rb"(?im)^Content-Length:\s*(\d+)", m[1])
                    end = m.end() + int(size[1]) + 4 if size else len(data)
                    end = min(end, len(data))
                    uri = size and re.search(rb"(?im)^WARC-Target-URI:[ \t]*([^\r\n]*)", m[1])
                    out.append((path, at, end - at, uri[1].decode("utf-8", "replace") if uri else None, hashlib.sha256(data[at:end]).hexdigest()))
                    at = end
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["file", "offset", "length", "uri", "digest"])

    return files.select("path", "content").mapInArrow(parsed, "file string, offset long, length long, uri string, digest string")


def laid_out(pages: DataFrame, records: int = RECORDS) -> DataFrame:
    """file, offset, length, page_id, copies, digest: the manifest of pages(page_id, url, html, ...) written as WARC files.

    A file takes `records` consecutive page ids (null ids: one file of their own), in the order of id, url and digest.
    Repeated rows are one run of equal records: `copies` times the length, and their digest covers the count.
    """
    raw = warc_record(F.col("url"), F.col("html"))
    rows = pages.select("page_id", "url", F.octet_length(raw).cast("long").alias("size"), F.sha2(raw, 256).alias("d"))
    rows = rows.groupBy("page_id", "url", "size", "d").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("file", F.coalesce(F.expr(f"page_id div {records}"), F.lit(-1).cast("long")))
    length = F.col("size") * F.col("copies")
    order = Window.partitionBy("file").orderBy("page_id", "url", "d")
    digest = F.when(F.col("copies") == 1, F.col("d")).otherwise(F.sha2(F.concat_ws("x", "copies", "d"), 256))
    return rows.select("file", (F.sum(length).over(order) - length).alias("offset"), length.alias("length"), "page_id", "copies", digest.alias("digest"))


def _levels(records: DataFrame, top: int, span: int) -> list[DataFrame]:
    """(file, node, hash) of each level: 0 the ranges, `top` the roots. Each is written once, for the next and the descent."""
    # a range holds at most `span` record starts, a node FAN children: both lists are bounded
    leaves = F.sha2(F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("offset", "length", "digest"))), lambda r: F.concat_ws(":", r["offset"], r["length"], r["digest"]))), 256)
    nodes = [keep(records.groupBy("file", F.expr(f"offset div {span}").alias("node")).agg(leaves.alias("hash")), "level")]
    for _ in range(top):
        joined = F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda r: F.concat_ws(":", r["node"], r["hash"])))
        above = nodes[-1].groupBy("file", F.expr(f"node div {FAN}").alias("parent")).agg(F.sha2(joined, 256).alias("hash")).withColumnRenamed("parent", "node")
        nodes.append(keep(above, "level"))
    return nodes


def audit(primary: DataFrame, replica: DataFrame, span: int = SPAN) -> DataFrame:
    """Damaged records between two manifests (file, offset, length, page_id, digest, ...).

    file, offset, page_id, status (corrupt: other bytes; missing: not in the replica; extra: only there), range, depth
    (levels gone down). Equal files give no rows; a file that only one side has differs at its root. Null files are a
    file of their own; empty tables give no rows; other columns are ignored. (file, offset) names a record.
    """
    columns = [F.coalesce(F.col("file").cast("string"), F.lit("")).alias("file"), "offset", "length", "page_id", "digest"]
    sides = [keep(x.select(*columns), "records") for x in (primary, replica)]
    last = max((x.agg(F.max("offset")).first()[0] or 0) for x in sides)
    top, reach = 0, span
    while reach <= last:
        top, reach = top + 1, reach * FAN
    trees = list(zip(*(_levels(x, top, span) for x in sides), strict=True))
    wrong = None
    for level in range(top, -1, -1):
        a, b = trees[level]
        if wrong is not None:
            up = wrong.withColumnRenamed("node", "parent")
            a, b = (x.withColumn("parent", F.expr(f"node div {FAN}")).join(up, ["file", "parent"], "left_semi").drop("parent") for x in (a, b))
        b = b.withColumnRenamed("hash", "other")
        wrong = a.join(b, ["file", "node"], "full").where(~F.col("hash").eqNullSafe(F.col("other"))).select("file", "node")
    wrong = keep(wrong, "ranges")
    x, y = (s.withColumn("node", F.expr(f"offset div {span}")).join(wrong, ["file", "node"], "left_semi") for s in sides)
    y = y.select("file", "offset", F.struct("length", "digest").alias("other"), F.col("page_id").alias("other_id"), F.lit(True).alias("there"))
    x = x.select("file", "offset", "page_id", F.struct("length", "digest").alias("own"), F.lit(True).alias("here"))
    both = x.join(y, ["file", "offset"], "full").where(~F.col("own").eqNullSafe(F.col("other")))
    status = F.when(F.col("there").isNull(), "missing").when(F.col("here").isNull(), "extra").otherwise("corrupt")
    return both.select("file", "offset", F.coalesce("page_id", "other_id").alias("page_id"), status.alias("status"), F.expr(f"offset div {span}").alias("range"), F.lit(top + 1).alias("depth"))


def damaged(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """A replica for the query: the manifest with simulated bit rot, lost and stray records, by a hash of the page id."""
    fate = F.crc32(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")) % 97
    rotten = F.when(fate == 1, F.sha2(F.concat_ws("!", "digest", F.lit("rot")), 256)).otherwise(F.col("digest"))
    kept = manifest.where(fate != 2).withColumn("digest", rotten)
    stray = manifest.where(fate == 3).withColumns({"offset": F.col("offset") + 1, "page_id": -F.col("page_id")})
    return kept.unionByName(stray)


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixity of all pages as WARC files against a damaged replica: every damaged record, and nothing else."""
    pages = table(spark, sf_dir, "pages")
    manifest = keep(laid_out(pages), "manifest")
    return audit(manifest, damaged(manifest, pages)).select("file", "offset", "page_id", "status", "range", "depth")

