"""Toxicity by compression distance: which of two zstandard dictionaries shortens a text's windows more?

Training takes a bounded sample of labelled rows. Each class's dictionary is covered greedily by the runs of text whose
fragments (6 bytes) are frequent in that class, in many different contexts, and rare in the other. Contexts are
counted, not documents, so that copies of one text don't teach their own phrases. Runs are kept apart by a NUL byte,
so no match crosses from one to the next.

A text is lower-cased, its white space turned into single spaces, and cut into windows that overlap a little. A window
is compressed with either dictionary; the difference in length says which class it is nearer to. Two details make this
exact to the byte: windows stay under the size from which zstandard entropy-codes literals, and a filler that both
dictionaries hold stands before each window, so that a block always shrinks and a single match shows.

A logistic curve over (largest difference, mean difference) is fitted to other labelled rows, the calibrating ones, and
moved so that 0.3 is the cut with the fewest errors on them. They also choose how common a fragment must be.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import small_batches, table, trim

FILLER = bytes(range(200, 248))
CUT = 0.3
_SPACE = re.compile(r"\s+")


@dataclass(frozen=True)
class Settings:
    """sampled_*: the bound on labelled rows used to fit; half as many again calibrate."""

    sampled_toxic: int = 1500
    sampled_ordinary: int = 4000
    calibrating: int = 1000
    #: longer texts (in characters) aren't taken into the sample, which is so bounded in rows and in characters
    sampled_chars: int = 20_000
    fragment: int = 6
    #: a fragment needs so large a share of its class's documents, and as many contexts; fit() takes the best share on
    #: the calibrating rows
    least_shares: tuple[float, ...] = (1 / 120, 1 / 60, 1 / 30, 1 / 15)
    least: int = 3
    least_ratio: float = 6.0
    dictionary_bytes: int = 8192
    longest_run: int = 24
    window: int = 24
    overlap: int = 12


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    settings: Settings = field(default_factory=Settings)


def normal(text: str | None) -> bytes:
    return (" " + _SPACE.sub(" ", (text or "").lower()) + " ").encode("utf-8", "replace")


def _document_counts(texts: Iterable[bytes], k: int) -> Counter:
    counts: Counter = Counter()
    for s in texts:
        counts.update({s[i : i + k] for i in range(len(s) - k + 1)})
    return counts


def _telling(own: Counter, other: Counter, n_own: int, n_other: int, texts: list[bytes], share: float, s: Settings) -> dict[bytes, float]:
    """Weights of the fragments that mark a class: log odds times document count."""
    k, chosen = s.fragment, {}
    least = max(s.least, round(n_own * share))
    for f, n in own.items():
        if n >= least:
            odds = ((n + 0.5) / n_own) / ((other[f] + 0.5) / n_other)
            if odds > s.least_ratio:
                chosen[f] = n * math.log(odds)
    before, after = defaultdict(set), defaultdict(set)
    for t in texts:
        for i in range(len(t) - k + 1):
            if (f := t[i : i + k]) in chosen:
                before[f].add(t[max(0, i - 10) : i])
                after[f].add(t[i + k : i + k + 10])
    return {f: w for f, w in chosen.items() if min(len(before[f]), len(after[f])) >= least}


def _cover(texts: list[bytes], weights: dict[bytes, float], s: Settings) -> bytes:
    """Runs of telling fragments, taken by the weight they still add; the best lies last, nearest to the window."""
    k, runs = s.fragment, set()
    for t in texts:
        i, n = 0, len(t) - k + 1
        while i < n:
            if t[i : i + k] in weights:
                j = i
                while j + 1 < n and t[j + 1 : j + 1 + k] in weights:
                    j += 1
                run = t[i : j + k]
                runs.update(run[a : a + s.longest_run] for a in range(0, len(run), s.longest_run))
                i = j + k
            else:
                i += 1
    left = dict(weights)
    worth = lambda r: sum(left.get(f, 0.0) for f in {r[i : i + k] for i in range(len(r) - k + 1)})
    heap = [(-worth(r), r) for r in runs if len(r) >= k]
    heapq.heapify(heap)
    taken, size = [], 0
    while heap and size < s.dictionary_bytes:
        _, run = heapq.heappop(heap)
        now = worth(run)
        if now <= 0:
            continue
        if heap and now < -heap[0][0]:
            heapq.heappush(heap, (-now, run))
            continue
        taken.append(run)
        size += len(run) + 1
        for i in range(len(run) - k + 1):
            left.pop(run[i : i + k], None)
    return b"\0".join([FILLER + b"\0" * 8, *taken[::-1], b""])


class Scorer:
    """Scores texts with a model; made once per Python task."""

    def __init__(self, model: Model):
        import zstandard as zs

        self.model, s = model, model.settings
        params = zs.ZstdCompressionParameters(
            window_log=17, chain_log=14, hash_log=14, search_log=4, min_match=s.fragment, strategy=zs.STRATEGY_FAST,
            write_content_size=False, write_dict_id=False,
        )
        packer = lambda d: zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=params).compress
        self.toxic, self.ordinary = packer(model.toxic), packer(model.ordinary)

    def features(self, text: str | None) -> tuple[float, float]:
        """Largest and mean byte difference over all windows of the whole text."""
        b, s = normal(text), self.model.settings
        most, total, n = -(10**9), 0, 0
        for i in range(0, len(b), s.window):
            w = FILLER + b[i : i + s.window + s.overlap]
            d = len(self.ordinary(w)) - len(self.toxic(w))
            most, total, n = max(most, d), total + d, n + 1
        return float(most), total / n

    def score(self, text: str | None) -> float:
        a, b, c = self.model.weights
        most, mean = self.features(text)
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, a * most + b * mean + c))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps, then shifted to make CUT the cut of fewest errors (widest gap wins)."""
    mid, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mid) / scale, np.ones(len(x))]
    w, ridge = np.zeros(3), np.diag([0.05, 0.05, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    margin = z @ w
    order = np.argsort(margin)
    m, lab = margin[order], y[order]
    errors = np.concatenate([[0], np.cumsum(lab)]) + (len(lab) - lab.sum() - np.concatenate([[0], np.cumsum(1 - lab)]))
    edges = np.concatenate([[m[0] - 1], (m[:-1] + m[1:]) / 2, [m[-1] + 1]])
    gaps = np.concatenate([[0], np.diff(m), [0]])
    best = np.flatnonzero(errors == errors.min())
    w[2] += math.log(CUT / (1 - CUT)) - edges[best[np.argmax(gaps[best])]]
    a, b = w[:2] / scale
    return float(a), float(b), float(w[2] - (w[:2] * mid / scale).sum())


def fit(rows: list[tuple[str | None, int]], settings: Settings = Settings()) -> Model | None:
    """A model of labelled texts (text, 0 or 1), in the order in which the sample was drawn; None without both labels."""
    toxic = [normal(t) for t, y in rows if y == 1]
    ordinary = [normal(t) for t, y in rows if y == 0]
    if not toxic or not ordinary:
        return None
    cut = lambda rows, most: (rows[: min(most, -(-2 * len(rows) // 3))], rows[min(most, -(-2 * len(rows) // 3)) :] or rows)
    (t_fit, t_rest), (o_fit, o_rest) = cut(toxic, settings.sampled_toxic), cut(ordinary, settings.sampled_ordinary)
    t_count, o_count = _document_counts(t_fit, settings.fragment), _document_counts(o_fit, settings.fragment)
    o_texts = o_fit[: len(t_fit)]
    y = np.array([1.0] * len(t_rest) + [0.0] * len(o_rest))
    best, least_loss = None, math.inf
    for share in settings.least_shares:
        t_telling = _telling(t_count, o_count, len(t_fit), len(o_fit), t_fit, share, settings)
        o_telling = _telling(o_count, t_count, len(o_fit), len(t_fit), o_texts, share, settings)
        model = Model(_cover(t_fit, t_telling, settings), _cover(o_texts, o_telling, settings), settings=settings)
        scorer = Scorer(model)
        x = np.array([scorer.features(t.decode("utf-8", "replace")) for t in [*t_rest, *o_rest]])
        a, b, c = weights = _logistic(x, y)
        wrong = float((((a * x[:, 0] + b * x[:, 1] + c) >= math.log(CUT / (1 - CUT))) != (y == 1)).sum())
        if wrong < least_loss:
            best, least_loss = Model(model.toxic, model.ordinary, weights, settings), wrong
    del t_count, o_count
    trim()
    return best


def sample(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> list[tuple[str | None, int]]:
    """A bounded sample of labelled texts that don't belong to the held-out quarter, in the order of a hash of doc_id.

    labels(doc_id, toxic): null labels and ids don't count; a document with both labels counts as toxic.
    """
    known = (
        labels.where("doc_id is not null and toxic in (0, 1)")
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .where(~held_out(F.col("doc_id")))
        .withColumn("turn", F.xxhash64("doc_id"))
    )
    drawn = None
    for label, n in ((1, settings.sampled_toxic), (0, settings.sampled_ordinary)):
        part = known.where(F.col("toxic") == label).orderBy("turn", "doc_id").limit(n + settings.calibrating)
        drawn = part if drawn is None else drawn.unionAll(part)
    # at most sampled_toxic + sampled_ordinary + 2 * calibrating ids: a proven bound for the broadcast
    found = docs.where(F.length("text") <= settings.sampled_chars).select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    found = found.groupBy("turn", "doc_id", "toxic").agg(F.min("text").alias("text"))  # one row an id
    return [(r.text, r.toxic) for r in sorted(found.collect(), key=lambda r: (r.turn, r.doc_id, r.text or ""))]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity_score(text: Column, model: Model | None) -> Column:
    """Score in [0, 1] of a text column; null and empty texts are scored as a blank; 0 without a model."""
    if model is None:
        return F.lit(0.0)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype="float64")

    return score(text)


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with held_out, score and predicted (1 if score >= 0.3).

    The score reads the whole text, however long, and nothing else; equal texts get equal scores. Null doc_id: not held out. Repeated rows are scored each; an empty table gives an
    empty result; clashing columns named held_out, score or predicted are replaced.
    """
    return docs.withColumns({"held_out": held_out(F.col("doc_id")), "score": toxicity_score(F.col("text"), model)}).withColumn(
        "predicted", (F.col("score") >= CUT).cast("int")
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents, by their texts; nulls, empty texts and so on: see classify."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(sample(docs, table(spark, sf_dir, "labels")))
    return classify(docs, model).select("doc_id", "held_out", "score", "predicted")
