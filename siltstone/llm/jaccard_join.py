"""Jaccard self-join of word-shingle sets by token-combination prefixes.

Two sets with similarity t or more differ in few tokens. Tokens are rare (k = 1), frequent (k = 2) or very frequent
(k = 3), and the frequent ones are dealt to classes by hash. With all tokens in one global order, a set's prefix is
extended until it covers n - ceil(t * n) + 1 tokens: all its rare ones, and all but k - 1 of each class. Then a linked
pair shares a rare token or k tokens of one class, so one index over single rare tokens and k-token combinations finds
every link.

Steps, each written to the shared folder:

1. A pass over the texts gives each document its set's size, a 128-bit signature, a parity bitmap and its prefix in hash
   order. Documents with equal sets become one representative, so exact copies never meet in a bucket.
2. A quick round joins representatives on their two least tokens and verifies a spanning forest; most groups of near
   copies are one component after it.
3. The index. Tokens are counted in sets of one representative a component; the order is (kind, hash). Sets whose kept
   tokens hold too few rare ones are read again. Keys that only one set has are sifted out before their rows move; a
   bucket counts if it holds more than one component, and buckets with the same rows are one bucket.
4. In a bucket, parity bitmaps bound the symmetric difference from below, which discards almost all pairs that aren't
   links without their texts: a folded bitmap in the bucket, the whole one for the pairs left. A first round takes one
   partner a set and bucket, verifies and merges components; the second round takes all pairs of sets that are still in
   different components. Near copies share most of their keys, so there a row names its set's least keys, and a pair
   that shares one of them is left to that bucket. Large buckets are dealt to block pairs.
5. Surviving pairs are verified on the shingle sets of the two texts, under two independent families of hashes;
   components follow. (Equality of whole sets, step 1, goes by the signature.)

A set of size n in [2^L, 2^(L+1)) is indexed at level L, and at L + 1 if a partner may be there; classes and the
kinds belong to the level.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import SALTS, bitmap_of, forget, frees, hits, keep, near, sift, small_batches, table
from siltstone.llm.components import components
from siltstone.llm.shingles import mix, shingles

#: components that hold a frequent, a very frequent token, more than; rows from which a bucket is dealt out in blocks
FREQUENT, VERY, LARGE = 32, 1024, 2048
#: a bucket that is too large is cut into so many blocks, or that squared and so on
SPLIT = 4
#: bits of a parity bitmap for each token that may differ; bits of its folded form that index rows carry: at least, and
#: for each token that may differ (unrelated sets differ in half of the bits, so it takes more than two bits a token to
#: tell them apart)
PARITY, SMALL, FOLDED = 16, 512, 3
#: so many of a set's least keys go with its index rows
FIRST = 8
#: the first pass keeps so many times the plain prefix, so that few sets need their texts again
EXTENDED = 2
#: bits of a map of frequent tokens: 2 MB, whatever the input (shared places only change the order)
MAP_BITS = 1 << 24
#: sets from this level on have frequent classes; smaller ones are indexed by single tokens
LEAST_LEVEL = 6
_A, _B, _LEVEL = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA5CB9243F0AEAB25, 0xC2B2AE3D27D4EB4F))


def _least_overlap(n: int, num: int, den: int) -> int:
    return -(-num * n // den)


def _prefix_length(n: int, num: int, den: int) -> int:
    return n - _least_overlap(n, num, den) + 1


def _levels(n: int, num: int, den: int) -> range:
    """The set's own level, and the next if the largest partner, den * n // num, lies there."""
    level = n.bit_length() - 1
    return range(level, (den * n // num).bit_length())


def _keys(tokens: np.ndarray, level: int) -> np.ndarray:
    return mix(tokens + np.array([level + 1], np.uint64) * _LEVEL)


def _places(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(20)) & np.uint64(MAP_BITS - 1)


@frees
def _features(batches: Iterator[pa.RecordBatch], width: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for part in shingles(batch.column("text"), width):
            out: list[list] = [[], [], [], [], [], [], []]
            for h in part:
                n = len(h)
                if not n:
                    row = (0, 0, 0, b"", b"", [], [])
                else:
                    allowed = 2 * n * (den - num) // (den + num)
                    bits = min(1 << 17, max(64, 1 << max(0, PARITY * allowed - 1).bit_length()))
                    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
                    parity = np.packbits(odd.astype(np.uint8), bitorder="little")
                    small = max(SMALL, 1 << max(0, FOLDED * allowed - 1).bit_length()) // 8
                    prefix = h[: EXTENDED * _prefix_length(n, num, den)].view(np.int64)
                    row = (n, int(h.sum().view(np.int64)), int(np.bitwise_xor.reduce(mix(h)).view(np.int64)), parity.tobytes(), _folded(parity, small).tobytes(), prefix[:2], prefix)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            made = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            own = batch.slice(at, len(part))
            at += len(part)
            yield pa.record_batch([own.column("doc_id"), own.column("text_id"), *made], names=["doc_id", "text_id", "n", "s1", "s2", "parity", "small", "least", "prefix"])


def _kinds(maps: tuple[bytes, ...]) -> np.ndarray | None:
    """0, 1 or 2 for the rare, frequent and very frequent places; None without frequent ones."""
    if not maps:
        return None
    return np.sum([np.unpackbits(np.frombuffer(m, np.uint8), bitorder="little") for m in maps], axis=0, dtype=np.uint8)


def _marked_keys(prefix: np.ndarray, n: int, level: int, num: int, den: int, kinds: np.ndarray | None) -> np.ndarray | None:
    """A set's keys at a level from the start of its tokens; None if that start has too few rare tokens."""
    need = _prefix_length(n, num, den)
    if kinds is None or level < LEAST_LEVEL:
        return _keys(prefix[:need], level)
    if len(prefix) == n:
        return combination_keys(prefix, level, num, den, kinds)
    keys = _keys(prefix, level)
    rare = keys[kinds[_places(keys)] == 0][:need]
    return rare if len(rare) == need else None


@frees
def _counted(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """(key, v): each key in hash order, v 1, and 2^32 more if the set stands for its component."""
    for batch in batches:
        keys, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for own, n, prefix in zip(pc.equal(batch.column("gid"), batch.column("comp")).to_pylist(), batch.column("n").to_pylist(), _lists(batch.column("prefix")), strict=True):
            for level in _levels(n, num, den):
                k = _keys(prefix.view(np.uint64)[: _prefix_length(n, num, den)], level)
                keys.append(k.view(np.int64))
                values.append(np.full(len(k), 1 + (own << 32), np.int64))
        yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.concatenate(values))], names=["key", "v"])


@frees
def _changed(batches: Iterator[pa.RecordBatch], num: int, den: int, maps: tuple[bytes, ...]) -> Iterator[pa.RecordBatch]:
    """(key, gid, level): keys beyond the plain prefix that sets with frequent tokens have instead; a null key: the kept tokens are too few."""
    kinds = _kinds(maps)
    for batch in batches:
        out: list[tuple] = []
        for gid, n, prefix in zip(batch.column("gid").to_pylist(), batch.column("n").to_pylist(), _lists(batch.column("prefix")), strict=True):
            for level in _levels(n, num, den):
                k = _marked_keys(prefix.view(np.uint64), n, level, num, den, kinds)
                if k is None:
                    out.append((None, gid, level))
                else:
                    plain = _keys(prefix.view(np.uint64)[: _prefix_length(n, num, den)], level)
                    if len(k) != len(plain) or (k != plain).any():
                        out += [(x, gid, level) for x in np.setdiff1d(k, plain).view(np.int64).tolist()]
        types = (pa.int64(), pa.int64(), pa.int32())
        yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["key", "gid", "level"])


@frees
def _index_rows(batches: Iterator[pa.RecordBatch], num: int, den: int, maps: tuple[bytes, ...], wanted: bytes, whole: bool) -> Iterator[pa.RecordBatch]:
    """Index rows with a wanted key: key, gid, comp, and for whole rows n, small, first. Sets whose kept tokens are too few are left out."""
    kinds = _kinds(maps)
    for batch in batches:
        keys, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, (n, prefix) in enumerate(zip(batch.column("n").to_pylist(), _lists(batch.column("prefix")), strict=True)):
            for level in _levels(n, num, den):
                k = _marked_keys(prefix.view(np.uint64), n, level, num, den, kinds)
                if k is not None:
                    keys.append(k.view(np.int64))
                    at.append(np.full(len(k), i, np.int64))
        key, row = np.concatenate(keys), np.concatenate(at)
        met = hits(key, wanted)
        key, at = key[met], row[met]
        row = pa.array(at)
        names = ["gid", "comp", "n", "small"] if whole else ["gid", "comp"]
        made = [pa.array(key), *(batch.column(c).take(row) for c in names)]
        yield pa.record_batch([*made, _least_keys(key, at)] if whole else made, names=["key", *names, *["first"] * whole])


def _least_keys(key: np.ndarray, at: np.ndarray) -> pa.Array:
    """For each row the FIRST least keys among the rows of its set, whose number is in `at`; fewer are filled up by the largest number."""
    order = np.lexsort((key, at))
    starts = np.flatnonzero(np.diff(at[order], prepend=-1))
    lengths = np.diff(starts, append=len(key))
    rank, of = np.arange(len(key)) - np.repeat(starts, lengths), np.repeat(np.arange(len(starts)), lengths)
    least = np.full((len(starts), FIRST), np.iinfo(np.int64).max)
    least[of[rank < FIRST], rank[rank < FIRST]] = key[order][rank < FIRST]
    back = np.empty(len(key), np.int64)
    back[order] = of
    ends = np.arange(len(key) + 1, dtype=np.int32) * np.int32(8 * FIRST)
    return pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(ends), pa.py_buffer(least[back])])


@frees
def _wanted_rows(batches: Iterator[pa.RecordBatch], wanted: bytes) -> Iterator[pa.RecordBatch]:
    """The index rows that have a wanted key, with `first`. Rows of a set lie together; where a task has only some of them, their keys do."""
    for rows in _runs(batches, ["gid"]):
        gid, met = rows.column("gid").to_numpy(), hits(rows.column("key").to_numpy(), wanted)
        at = np.cumsum(np.diff(gid, prepend=gid[:1]) != 0)
        rows = rows.filter(pa.array(met))
        rows = rows.append_column("first", _least_keys(rows.column("key").to_numpy(), at[met]))
        yield from rows.to_batches(1000)


@frees
def _combination_rows(batches: Iterator[pa.RecordBatch], width: int, num: int, den: int, maps: tuple[bytes, ...]) -> Iterator[pa.RecordBatch]:
    """Index rows of the sets whose kept tokens were too few: key, gid, comp, n, small."""
    kinds = _kinds(maps)
    for batch in batches:
        levels, at = batch.column("level").to_pylist(), 0
        for part in shingles(batch.column("text"), width):
            keys = [combination_keys(h, levels[at + i], num, den, kinds).view(np.int64) for i, h in enumerate(part)]
            row = pa.array(np.repeat(np.arange(at, at + len(part)), [len(k) for k in keys]))
            at += len(part)
            yield pa.record_batch([pa.array(np.concatenate(keys)), *(batch.column(c).take(row) for c in ("gid", "comp", "n", "small"))], names=["key", "gid", "comp", "n", "small"])


def _classes(level: int, num: int, den: int) -> tuple[int, int]:
    """How many classes the frequent and the very frequent tokens of a level have: a set can always cover what it must."""
    two = max(1, (1 << level) * (den - num) // (2 * den))
    return two, max(1, min(two, ((1 << level) * num // den - two - 2) // 2))


def combination_keys(h: np.ndarray, level: int, num: int, den: int, kinds: np.ndarray | None) -> np.ndarray:
    """The keys of one sorted set at one level; see the module's text."""
    need = _prefix_length(len(h), num, den)
    keys = _keys(h, level)
    kind = kinds[_places(keys)] if kinds is not None and level >= LEAST_LEVEL else np.zeros(len(h), np.uint8)
    rare = keys[kind == 0][:need]
    out, covered = [rare], len(rare)
    for k, classes in zip((2, 3), _classes(level, num, den), strict=True):
        f = keys[kind == k - 1]
        if covered >= need or not len(f):
            continue
        of = (f % np.uint64(classes)).astype(np.int64)
        by_class = np.argsort(of, kind="stable")
        starts = np.flatnonzero(np.diff(of[by_class], prepend=-1))
        rank = np.empty(len(f), np.int64)
        rank[by_class] = np.arange(len(f)) - np.repeat(starts, np.diff(starts, append=len(f)))
        so_far = covered + np.cumsum(rank >= k - 1)
        upto = min(len(f), int(np.searchsorted(so_far, need)) + 1)
        covered = int(so_far[upto - 1])
        taken = by_class[by_class < upto]
        group, token = of[taken], f[taken]
        for lag in range(1, int(rank[taken].max()) + 1):
            same = group[lag:] == group[:-lag]
            pairs = mix(token[:-lag][same] * _A + token[lag:][same] * _B)
            if k == 2:
                out.append(pairs)
                continue
            for more in range(1, int(rank[taken].max()) + 1 - lag):
                third = np.flatnonzero(same[: len(token) - lag - more] & (group[lag + more :] == group[: -lag - more]))
                place = (np.cumsum(same) - 1)[third]
                out.append(mix(pairs[place] * _A + token[third + lag + more] * _B + _LEVEL))
    if covered < need:
        raise ValueError("the similarity is too low for this number of classes")
    return np.concatenate(out)


def _lists(column: pa.Array) -> list[np.ndarray]:
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys; a run that goes on in the next batch is held back."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for name in by:
            v = batch.column(name).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
            change[0] |= not held or held[-1].column(name)[-1].as_py() != v[0]
        last = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if change.any():
            yield pa.Table.from_batches([*held, batch.slice(0, last)] if last else held, schema=batch.schema)
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


@frees
def _candidates(batches: Iterator[pa.RecordBatch], num: int, den: int, forest: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of a bucket that the parity bitmaps can't rule out, between different components.

    forest: for each set its nearest such partner only. Otherwise a pair is left out where its sets' least keys show that
    a bucket of a lesser key has it too. Rows come sorted by (key, low, high); low and high are the block pair of a large
    bucket, block the row's own.
    """
    by = ["key", "low", "high"]
    for rows in _runs(batches, by):
        if not rows.num_rows:
            continue
        key = [rows.column(c).to_numpy() for c in by]
        change = np.ones(rows.num_rows, bool)
        change[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
        edges = np.flatnonzero(change)
        ends = np.append(edges[1:], rows.num_rows)
        several = ends - edges > 1
        n, gid, comp, block = (rows.column(c).to_numpy() for c in ("n", "gid", "comp", "block"))
        parity = rows.column("small").combine_chunks()
        first = None if forest else _numbers(rows.column("first").combine_chunks())
        out: list[np.ndarray] = []
        for a, b in zip(edges[several].tolist(), ends[several].tolist(), strict=True):
            cross = key[1][a] != key[2][a]
            found = _pairs(n[a:b], gid[a:b], comp[a:b], block[a:b] if cross else None, parity.slice(a, b - a), num, den, forest)
            out += found if forest else [_here(pairs, key[0][a], gid[a:b], first[a:b]) for pairs in found]
        if out:
            pairs = np.concatenate(out)
            pairs = np.unique(np.sort(pairs, axis=1), axis=0)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _numbers(first: pa.Array) -> np.ndarray:
    """The least keys of each row, FIRST in a line."""
    start = np.frombuffer(first.buffers()[1], np.int32)[first.offset]
    return np.frombuffer(first.buffers()[2], np.int64, len(first) * FIRST, int(start)).reshape(-1, FIRST)


def _here(pairs: np.ndarray, key: int, gid: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The pairs that share none of their sets' least keys below this bucket's.

    Sets that share a key are both in its bucket, or in one of a lesser key with the same rows, or that bucket held one
    component only; so the least bucket that two sets share never leaves their pair out.
    """
    order = np.argsort(gid)
    kept = [pairs[:0]]
    for some in np.split(pairs, range(1 << 16, len(pairs), 1 << 16)):
        x, y = (first[order[np.searchsorted(gid, some[:, i], sorter=order)]] for i in (0, 1))
        earlier = np.zeros(len(some), bool)
        for i in range(FIRST):
            earlier |= ((x[:, i, None] == y) & (y < key)).any(axis=1)
        kept.append(some[~earlier])
    return np.concatenate(kept)


def _few(n, gid, comp, parity, num: int, den: int) -> list[np.ndarray]:
    """_pairs for a handful of rows, by Python's own integers."""
    rows = sorted(zip(n.tolist(), gid.tolist(), comp.tolist(), (parity[i].as_py() for i in range(len(parity))), strict=True))
    rows = [(*r[:3], int.from_bytes(r[3], "little"), 8 * len(r[3])) for r in rows]
    out = []
    for j, (nj, gj, cj, yj, sj) in enumerate(rows):
        for ni, gi, ci, x, si in rows[:j]:
            if ci != cj and nj * num <= ni * den:
                y, size = yj, sj
                while size > si:
                    size //= 2
                    y = (y ^ (y >> size)) & ((1 << size) - 1)
                if (x ^ y).bit_count() * (den + num) <= (ni + nj) * (den - num):
                    out.append((gi, gj))
    return [np.array(out, np.int64)] if out else []


def _pairs(n, gid, comp, block, parity, num: int, den: int, forest: bool) -> list[np.ndarray]:
    if len(n) <= 6 and block is None:
        return _few(n, gid, comp, parity, num, den)
    order = np.lexsort((gid, n))
    n, gid, comp = n[order], gid[order], comp[order]
    block = None if block is None else block[order]
    maps = [np.frombuffer(parity[i].as_buffer(), np.uint64) for i in order.tolist()]
    sizes = np.array([len(m) for m in maps])
    out, i, m = [], 0, len(n)
    upper = np.searchsorted(n, den * n // num, "right")  # partners of i end here
    while i < m:
        words = int(sizes[i])
        # rows with the same bitmap size, as many as keep the block of comparisons small
        j = int(np.searchsorted(sizes, words, "right"))
        j = min(j, i + max(1, 2_000_000 // max(1, (int(upper[min(j, m) - 1]) - i) * words)))
        end = int(upper[j - 1])
        right = np.empty((end - i, words), np.uint64)
        for r in range(i, end):
            right[r - i] = _folded(maps[r], words)
        left = right[: j - i]
        apart = np.zeros((j - i, end - i), np.int32)
        for w in range(words):
            apart += np.bitwise_count(left[:, w, None] ^ right[None, :, w])
        both = n[i:j, None] + n[None, i:end]
        near = apart * (den + num) <= both * (den - num)
        near &= np.arange(i, end)[None, :] > np.arange(i, j)[:, None]
        near &= n[None, i:end] * num <= n[i:j, None] * den
        near &= comp[i:j, None] != comp[None, i:end]
        if block is not None:
            near &= block[i:j, None] != block[None, i:end]
        if forest:
            y = np.flatnonzero(near.any(axis=0))
            x = np.where(near[:, y], apart[:, y], np.iinfo(np.int32).max).argmin(axis=0)
        else:
            x, y = np.nonzero(near)
        if len(x):
            out.append(np.stack([gid[i + x], gid[i + y]], axis=1))
        i = j
    return out


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Parities over fewer places: halves are added (xor) until the size fits."""
    while len(bits) > size:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


@frees
def _verified(batches: Iterator[pa.RecordBatch], width: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = np.ones(batch.num_rows, bool)
        for family in (0, 1):
            left = (h for p in shingles(batch.column("text_a"), width, family) for h in p)
            right = (h for p in shingles(batch.column("text_b"), width, family) for h in p)
            for i, (x, y) in enumerate(zip(left, right, strict=True)):
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                linked[i] &= den * shared >= num * (len(x) + len(y) - shared) and shared > 0
        mask = pa.array(linked)
        yield pa.record_batch([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])


def link(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, text_id, is_first for each row of docs(doc_id, text, ...).

    Two rows link when den * |x & y| >= num * |x | y|. text_id is xxhash64(doc_id, text) with null texts empty; is_first
    marks the rows of one text_id in each component, those of its least doc_id.

    Null, empty and blank texts have no shingles, no links, and are their own component. A text with fewer words than
    `width` has one shingle, its whole sequence. Repeated rows are kept, each with the same component. component_id is
    the least doc_id of the component, null ids aside (null if all are). Other columns are ignored. An empty table gives
    an empty result. num / den is at least one half.
    """
    if not 2 * num >= den >= num > 0:
        raise ValueError("the similarity must be from 1/2 to 1")
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("text_id", F.xxhash64("doc_id", "text"))
    sets = texts.mapInArrow(
        partial(_features, width=width, num=num, den=den),
        "doc_id long, text_id long, n long, s1 long, s2 long, parity binary, small binary, least array<long>, prefix array<long>",
    )
    sets = keep(sets.withColumn("gid", F.monotonically_increasing_id()), "sets")
    rows = keep(sets.select("gid", "doc_id", "text_id", "n", "s1", "s2"), "rows")
    named = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_id", "gid")
    classes = keep(rows.where("n > 0").groupBy("s1", "s2", "n").agg(F.min(named).alias("text"), F.count("*").alias("copies")), "classes")
    several = classes.where("copies > 1").select("s1", "s2", "n", F.col("text.gid").alias("first"))
    copies = keep(near(rows.select("gid", "s1", "s2", "n"), several, ["s1", "s2", "n"], salt="gid").where("gid <> first").select("gid"), "copies")

    # 2. the quick round
    heads = sets.where("n > 0").select("gid", F.col("gid").alias("comp"), "n", "small", "least")
    named_by, gone = F.xxhash64("gid"), bitmap_of(copies, F.xxhash64("gid"))
    heads = sift(heads, named_by, gone, hit=False).unionByName(sift(heads, named_by, gone).join(copies.hint("merge"), "gid", "left_anti"))
    least = heads.select(F.explode(F.array_distinct("least")).alias("key"), "gid", "comp", "n", "small")
    sizes = keep(least.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"), "sizes")
    dealt = _dealt(sift(least, F.col("key"), bitmap_of(sizes, F.col("key"))), sizes, forest=True)
    pairs = keep(_meet(dealt, sets, num, den, forest=True), "pairs")
    edges = _verify(pairs, rows, texts, width, num, den)
    merged = components(edges)
    forget(sizes, pairs)

    # 3. the index
    changes = copies.select("gid", F.lit(None).cast("long").alias("root"), F.lit(True).alias("copy")).unionAll(merged.toDF("gid", "root").withColumn("copy", F.lit(False)))
    changes = keep(changes, "changes")
    kept = sets.where("n > 0").select("gid", "n", "small", "parity", "prefix")
    marked = bitmap_of(changes, F.xxhash64("gid"))
    known = sift(kept, named_by, marked).join(changes.hint("merge"), "gid", "left").where("copy is null or not copy").drop("copy")
    groups = sift(kept, named_by, marked, hit=False).withColumn("root", F.lit(None).cast("long")).unionByName(known)
    groups = keep(groups.select("gid", "n", "small", "parity", "prefix", F.coalesce("root", "gid").alias("comp")), "groups")
    forget(sets, changes, copies)
    tokens = groups.select("gid", "comp", "n", "prefix")
    counts = tokens.mapInArrow(partial(_counted, num=num, den=den), "key long, v long").groupBy("key").agg(F.sum("v").alias("v"))
    counts = keep(counts.where(f"v & {(1 << 32) - 1} > 1").select("key", F.shiftright("v", 32).alias("holders")), "counts")
    place = F.expr(f"cast(shiftright(key, 20) & {MAP_BITS - 1} as int)").alias("place")
    maps = tuple(_map(counts.where(F.col("holders") > most).select(place).distinct()) for most in (FREQUENT, VERY))
    maps = maps if any(maps[0]) else ()
    needed = counts.select("key")
    combined = None
    if maps:
        changed = keep(tokens.mapInArrow(partial(_changed, num=num, den=den, maps=maps), "key long, gid long, level int"), "changed")
        needed = needed.unionAll(changed.where("key is not null").select("key"))
        wanting = changed.where("key is null").select("gid", "level")
        wanting = keep(near(groups.select("gid", "comp", "n", "small"), wanting, ["gid"]), "wanting")
        found = _texts(texts, near(rows.select("gid", "text_id", F.col("doc_id").alias("rep_id")), wanting, ["gid"]))
        combined = found.dropDuplicates(["gid", "level"]).mapInArrow(partial(_combination_rows, width=width, num=num, den=den, maps=maps), "key long, gid long, comp long, n long, small binary")
        combined = keep(combined, "combined")
        needed = needed.unionAll(combined.select("key"))
    shared = bitmap_of(needed, F.col("key"))
    light = tokens.mapInArrow(partial(_index_rows, num=num, den=den, maps=maps, wanted=shared.bytes(), whole=False), "key long, gid long, comp long")
    if combined is not None:
        light = light.unionAll(combined.select("key", "gid", "comp"))
    # buckets with the same rows are one bucket
    buckets = light.groupBy("key").agg(F.count("*").alias("rows"), F.min("comp").alias("least"), F.max("comp").alias("most"), F.expr("bit_xor(xxhash64(gid))").alias("x")).where("least < most")
    buckets = keep(buckets.groupBy("rows", "least", "most", "x").agg(F.min("key").alias("key")).select("key", "rows"), "buckets")
    wanted, whole = bitmap_of(buckets, F.col("key")).bytes(), "key long, gid long, comp long, n long, small binary, first binary"
    index = groups.select("gid", "comp", "n", "small", "prefix").mapInArrow(partial(_index_rows, num=num, den=den, maps=maps, wanted=wanted, whole=True), whole)
    if combined is not None:
        index = index.unionAll(combined.mapInArrow(partial(_wanted_rows, wanted=wanted), whole))
    index = keep(index, "index")

    # 4. a forest over the buckets, then all pairs of what is still apart
    pairs = keep(_meet(_dealt(index, buckets, forest=True), groups, num, den, forest=True), "pairs")
    edges = keep(edges.unionAll(_verify(pairs, rows, texts, width, num, den)), "links")
    merged = components(edges)
    later = _moved(index, merged)
    apart = later.groupBy("key").agg(F.count("*").alias("rows"), F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most")
    apart = keep(apart.select("key", "rows"), "apart")
    later = sift(later, F.col("key"), bitmap_of(apart, F.col("key")))
    again = _meet(_dealt(later, apart, forest=False), groups, num, den, forest=False)
    again = keep(again.join(pairs.hint("merge"), ["a", "b"], "left_anti"), "pairs")
    more = _verify(again, rows, texts, width, num, den)
    forget(groups)

    # 5. components of documents
    if not more.isEmpty():
        merged = components(edges.unionAll(more))
    heads = classes.select("s1", "s2", "n", "copies", "text", F.col("text.gid").alias("gid"))
    joined = keep(near(heads, merged.toDF("gid", "root"), ["gid"]), "members")
    leasts = keep(joined.groupBy("root").agg(F.min("text").alias("least")), "leasts")
    joined = keep(near(joined.drop("text", "copies", "gid"), leasts, ["root"], salt="s2").select("s1", "s2", "n", "least"), "joined")
    alone = heads.where("copies > 1").join(joined.select("s1", "s2", "n").hint("merge"), ["s1", "s2", "n"], "left_anti")
    classed = keep(joined.unionAll(alone.select("s1", "s2", "n", F.col("text").alias("least"))), "classed")
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_id", "gid")
    single = F.col("s1"), bitmap_of(classed, F.col("s1"))
    copied = sift(rows, *single)
    salted = copied.withColumn("salt", F.pmod(F.xxhash64("gid"), F.lit(SALTS)).cast("int")).join(classed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge"), ["s1", "s2", "n", "salt"], "left")
    out = sift(rows, *single, hit=False).withColumn("least", own).unionByName(salted.drop("salt").withColumn("least", F.coalesce("least", own)))
    out = out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "text_id",
        ((F.col("n") == 0) | (F.col("text_id") == F.col("least.text_id"))).alias("is_first"),
    )
    out = keep(out, "components")
    forget(rows, classes, classed, joined, index, counts, buckets, apart, edges, pairs, again, more)
    return out


def _map(frequent: DataFrame) -> bytes:
    """A bit for each place of frequent(place), MAP_BITS in all, gathered as at most MAP_BITS / 32768 partial maps."""
    parts = frequent.groupBy(F.expr("place div 32768").alias("part")).agg(F.expr("bitmap_construct_agg(cast(place % 32768 as bigint))").alias("bits"))
    out = np.zeros(MAP_BITS // 8, np.uint8)
    for r in parts.collect():
        out[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


@frees
def _blocked(batches: Iterator[pa.RecordBatch], hot: list[bytes], forest: bool) -> Iterator[pa.RecordBatch]:
    """Rows with their block pairs: key, low, high, block, gid, comp, n, small, first. A forest needs no pairs across blocks, and no least keys."""
    for batch in batches:
        key = batch.column("key").to_numpy()
        blocks, still = np.ones(len(key), np.int64), np.ones(len(key), bool)
        for m in hot:
            still &= hits(key, m)
            blocks[still] *= SPLIT
        block = (mix(batch.column("gid").to_numpy().view(np.uint64)) % blocks.view(np.uint64)).view(np.int64)
        row, other = np.arange(len(key)), block
        if not forest:
            row = np.repeat(row, blocks)
            other = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        own = block[row]
        columns = [np.minimum(own, other), np.maximum(own, other), own]
        rest = batch.take(pa.array(row))
        names = ["gid", "comp", "n", "small", *["first"] * (not forest)]
        yield pa.record_batch([rest.column("key"), *(pa.array(c) for c in columns), *(rest.column(c) for c in names)], names=["key", "low", "high", "block", *names])


def _dealt(rows: DataFrame, sizes: DataFrame, forest: bool) -> DataFrame:
    """Index rows (key, gid, comp, n, small, and first but for a forest) dealt to blocks of about LARGE rows or fewer; sizes(key, rows) has the buckets' sizes.

    Bitmaps name the large buckets, so no join moves all rows of a key to one task. A bit that two keys share cuts a
    small bucket into blocks too, which changes nothing in its pairs.
    """
    most, blocks, hot = sizes.agg(F.max("rows")).first()[0] or 0, 1, []
    while most > LARGE * blocks:
        hot.append(bitmap_of(sizes.where(F.col("rows") > LARGE * blocks), F.col("key")).bytes())
        blocks *= SPLIT
    rows = rows.select("key", "gid", "comp", "n", "small", *["first"] * (not forest))
    return rows.mapInArrow(partial(_blocked, hot=hot, forest=forest), "key long, low long, high long, block long, gid long, comp long, n long, small binary" + ", first binary" * (not forest))


def _meet(dealt: DataFrame, sets: DataFrame, num: int, den: int, forest: bool) -> DataFrame:
    """Candidate pairs a < b of dealt index rows; sets(gid, n, parity) has the whole bitmaps."""
    dealt = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    pairs = keep(dealt.mapInArrow(partial(_candidates, num=num, den=den, forest=forest), "a long, b long").distinct(), "met")
    asked = keep(pairs.select("a").unionAll(pairs.select("b")).toDF("gid").distinct(), "asked")
    whole = near(sets.select("gid", "n", "parity"), asked, ["gid"])
    both = pairs.join(whole.toDF("a", "n_a", "parity_a"), "a").join(whole.toDF("b", "n_b", "parity_b"), "b")
    return both.mapInArrow(partial(_narrowed, num=num, den=den), "a long, b long")


def _moved(index: DataFrame, merged: DataFrame) -> DataFrame:
    """Index rows with the components of merged(node, root)."""
    key = F.xxhash64("gid")
    bitmap = bitmap_of(merged, F.xxhash64("node"))
    own = index.drop("comp")
    known = sift(own, key, bitmap).join(merged.toDF("gid", "comp").hint("merge"), "gid", "left").withColumn("comp", F.coalesce("comp", "gid"))
    return sift(own, key, bitmap, hit=False).withColumn("comp", F.col("gid")).unionByName(known)


@frees
def _narrowed(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The pairs that the whole parity bitmaps can't rule out."""
    for batch in batches:
        kept = []
        for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "parity_a", "parity_b")), strict=True):
            size = min(len(x), len(y))
            x, y = (_folded(np.frombuffer(z, np.uint8), size) for z in (x, y))
            kept.append(int(np.bitwise_count(x ^ y).sum()) * (den + num) <= (n + m) * (den - num))
        mask = pa.array(kept, pa.bool_())
        yield pa.record_batch([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])


def _texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(text_id, rep_id, ...) with its texts."""
    key = F.col("text_id")
    some = sift(texts, key, bitmap_of(wanted, key))
    # the ids are compared as a residue, not a key: the rows stay dealt out by text_id alone
    same = F.size(F.array_intersect(F.array(some["doc_id"]), F.array(wanted["rep_id"]))) == 1
    return some.join(wanted, "text_id").where(same).drop("doc_id")


def _verify(pairs: DataFrame, rows: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs whose sets are linked, by the texts of the two representatives, named in rows(gid, doc_id, text_id)."""
    wanted = keep(pairs.select("a").unionAll(pairs.select("b")).toDF("gid").distinct(), "asked")
    wanted = keep(near(rows.select("gid", "text_id", F.col("doc_id").alias("rep_id")), wanted, ["gid"]), "wanted")
    found = keep(_texts(texts, wanted).dropDuplicates(["text_id", "gid"]).select("gid", "text"), "texts")
    joined = pairs.join(found.toDF("a", "text_a"), "a").join(found.toDF("b", "text_b"), "b")
    links = keep(joined.select("a", "b", "text_a", "text_b").mapInArrow(partial(_verified, width=width, num=num, den=den), "a long, b long"), "links")
    forget(wanted, found)
    return links


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of all documents: shingles of 3 words, 0.9. Nulls, empty texts and so on: see link."""
    return link(table(spark, sf_dir, "documents"), width=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")
