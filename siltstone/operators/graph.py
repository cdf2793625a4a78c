"""Graph operators over edges(src, dst): fixpoint loops of joins, written out between rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.plans.settle import settle

#: searches that go together, a bit each; the searches of one part are dealt over up to so many tasks
WIDTH, DEALT = 512, 64
#: components of fewer nodes are searched together, about so many nodes at a time
SMALL = 1024
#: edges taken at a time; rows of a result's Arrow batch, about
STEP, BATCH = 1 << 16, 1 << 20
#: labels of a column or row of the grid of dominance, about
GRID = 50_000


def closure(edges: DataFrame, seeds: DataFrame | None = None, max_depth: int | None = None, reverse: bool = False) -> DataFrame:
    """src, dst, depth: what each seed (all nodes without seeds) reaches, itself aside, and in how many steps.

    Breadth first, so depth is the shortest path's. seeds(id) keeps the result linear in what is asked; without seeds
    all nodes are searched from at once, see _every_search.
    """
    e = edges.select(F.col("dst").alias("u"), F.col("src").alias("v")) if reverse else edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    if seeds is None:
        return _every_search(settle(e.where("u <> v").distinct()), max_depth)
    e = settle(e.distinct())
    start = e.join(seeds.select(F.col("id").alias("seed")).distinct(), F.col("u") == F.col("seed"), "left_semi")
    seen = frontier = settle(start.where("u <> v").select(F.col("u").alias("src"), F.col("v").alias("dst"), F.lit(1).alias("depth")))
    depth = 1
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        step = frontier.select("src", F.col("dst").alias("mid")).join(e, F.col("mid") == F.col("u")).where("src <> v").select("src", F.col("v").alias("dst")).distinct()
        known = seen.select(F.col("src").alias("ks"), F.col("dst").alias("kd"))
        frontier = settle(step.join(known, (F.col("src") == F.col("ks")) & (F.col("dst") == F.col("kd")), "left_anti").withColumn("depth", F.lit(depth)))
        seen = settle(seen.unionByName(frontier))
    return seen


def _every_search(e: DataFrame, max_depth: int | None) -> DataFrame:
    """src, dst, depth over e(u, v): searches from all nodes, within weak components, each task WIDTH sources at a time.

    A task holds one component's edges (8 bytes each, small components together), and three bits for each node and
    source of the WIDTH it searches from; pairs leave it as they are found, so that memory doesn't grow with the result.
    """
    kind = dict(e.dtypes)["u"]
    of = components(e.select(F.col("u").alias("id")).unionAll(e.select("v")).distinct(), e.toDF("src", "dst"))
    of = of.join(of.groupBy("component").agg(F.count("*").alias("own")), "component")
    bins = max(1, (of.where(F.col("own") < SMALL).count()) // SMALL)
    part = F.when(F.col("own") < SMALL, F.concat(F.lit("small"), F.pmod(F.xxhash64("component"), F.lit(bins)))).otherwise(F.concat(F.lit("="), F.col("component").cast("string")))
    w = Window.partitionBy("part")
    nodes = settle(of.select("id", part.alias("part")).select("id", "part", (F.row_number().over(w.orderBy("id")) - 1).alias("at"), F.count("*").over(w).alias("n")))
    each = WIDTH * F.ceil(F.col("n") / (WIDTH * DEALT))  # sources of a task
    blocks = F.ceil(F.col("n") / each)
    tasks = nodes.select("part", "n").distinct().agg(F.sum(blocks)).first()[0] or 1
    a, b = nodes.select(F.col("id").alias("a"), "part", "n", F.col("at").alias("i")), nodes.select(F.col("id").alias("b"), F.col("at").alias("j"))
    inner = e.join(a, F.col("u") == F.col("a")).join(b, F.col("v") == F.col("b")).select("part", "n", "i", "j").sortWithinPartitions("part")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            name, n = (c.to_pandas().to_numpy() for c in rows.columns[:2])
            ij = np.stack([c.to_numpy().astype("<i4") for c in rows.columns[2:]])
            cuts = [0, *(np.flatnonzero(name[1:] != name[:-1]) + 1), len(name)] if len(name) else [0]
            spans = list(zip(cuts, cuts[1:]))
            yield pa.RecordBatch.from_arrays([pa.array([name[x] for x, _ in spans], pa.string()), pa.array([n[x] for x, _ in spans], pa.int64()), pa.array([ij[:, x:y].tobytes() for x, y in spans], pa.binary())], ["part", "n", "pairs"])

    pairs = inner.mapInArrow(packed, "part string, n long, pairs binary").withColumn("first", F.lit(None).cast("int")).withColumn("ids", F.lit(None).cast(f"array<{kind}>"))
    names = nodes.groupBy("part", "n", (F.col("at") - F.col("at") % 4096).alias("first")).agg(F.array_sort(F.collect_list(F.struct("at", "id")))["id"].alias("ids"))
    dealt = pairs.unionByName(names.withColumn("pairs", F.lit(None).cast("binary")))
    dealt = dealt.withColumn("each", each).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.repartition(min(4 * tasks, 2000), "part", "block").sortWithinPartitions("part", "block")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, block, each, n), pairs, ids in _gathered(batches):
            out, held = [], 0
            for depth, i, j in _searched(n, pairs, block * each, min(n, (block + 1) * each), max_depth):
                out.append((i, j, np.full(len(i), depth, np.int32)))
                held += len(i)
                if held >= BATCH // 4:
                    yield _named_pairs(ids, out)
                    out, held = [], 0
            if out:
                yield _named_pairs(ids, out)

    return dealt.mapInArrow(found, f"src {kind}, dst {kind}, depth int")


def _named_pairs(ids: pa.Array, out: list[tuple]) -> pa.RecordBatch:
    i, j, depth = (np.concatenate(x) for x in zip(*out))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(depth)], ["src", "dst", "depth"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(part, block, sources of a block, nodes), pairs of indexes (2 rows), ids in order; rows come sorted by part and block."""
    key, pairs, ids = None, [], []

    def done():
        return key, np.concatenate(pairs, axis=1), pa.concat_arrays([x for _, x in sorted(ids, key=lambda x: x[0])])

    for rows in batches:
        at = {c: rows.column(c) for c in rows.schema.names}
        keys = list(zip(*(at[c].to_pylist() for c in ("part", "block", "each", "n"))))
        for k, now in enumerate(keys):
            if now != key:
                if key is not None:
                    yield done()
                key, pairs, ids = now, [], []
            if at["pairs"][k].is_valid:
                pairs.append(np.frombuffer(at["pairs"][k].as_py(), "<i4").reshape(2, -1))
            else:
                ids.append((at["first"][k].as_py(), at["ids"][k].values))
    if key is not None:
        yield done()


def _searched(n: int, pairs: np.ndarray, first: int, last: int, max_depth: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """depth, sources, nodes: breadth-first searches of n nodes from first to last, WIDTH at a time, a bit each."""
    order = np.argsort(pairs[1], kind="stable")
    u, v = pairs[0][order], pairs[1][order]
    for low in range(first, last, WIDTH):
        own = np.arange(min(WIDTH, last - low))
        words = -(-len(own) // 64)
        seen = np.zeros((n, words), np.uint64)
        seen[low + own, own // 64] = np.uint64(1) << (own % 64).astype(np.uint64)
        full = np.bitwise_or.reduce(seen, axis=0)
        fresh, depth = seen.copy(), 0
        while max_depth is None or depth < max_depth:
            depth += 1
            use = fresh.any(axis=1)[u] & (seen != full).any(axis=1)[v]
            a, b = u[use], v[use]
            after = np.zeros_like(seen)
            for x in range(0, len(a), STEP):
                to = b[x : x + STEP]
                starts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                after[to[starts]] |= np.bitwise_or.reduceat(fresh[a[x : x + STEP]], starts, axis=0)
            after &= ~seen
            hit = np.flatnonzero(after.any(axis=1))
            if not len(hit):
                break
            seen |= after
            fresh = after
            size = max(1, BATCH // (64 * words))
            for x in range(0, len(hit), size):
                bits = np.flatnonzero(np.unpackbits(after[hit[x : x + size]].astype("<u8").view(np.uint8), bitorder="little"))
                yield depth, low + bits % (64 * words), hit[x : x + size][bits // (64 * words)]


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component (its least id) for nodes(id), edges taken as undirected: least label, with pointer jumping."""
    both = edges.select("src", "dst").unionAll(edges.select(F.col("dst"), F.col("src")).toDF("src", "dst")).where("src <> dst").distinct()
    both = settle(both)
    labels = settle(nodes.select("id", F.col("id").alias("component")).distinct())
    while True:
        near = both.join(labels, F.col("dst") == F.col("id")).groupBy("src").agg(F.min("component").alias("least"))
        lower = labels.join(near, F.col("id") == F.col("src"), "left").select("id", F.col("component").alias("before"), F.least("component", F.coalesce("least", "component")).alias("component"))
        lower = settle(lower)
        jump = lower.select(F.col("id").alias("at"), F.col("component").alias("top"))
        labels = settle(lower.join(jump, F.col("component") == F.col("at"), "left").select("id", "before", F.coalesce("top", "component").alias("component")))
        moved = not labels.where("before <> component").isEmpty()
        labels = labels.select("id", "component")
        if not moved:
            return labels


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, scc (its least id): by colours. Forward least labels, then backward from each root inside its colour."""
    left, e = settle(nodes.select("id").distinct()), settle(edges.select("src", "dst").where("src <> dst").distinct())
    done = None
    while not left.isEmpty():
        colour = left.select("id", F.col("id").alias("colour"))
        while True:  # least label among all that reach a node
            near = e.join(colour, F.col("src") == F.col("id")).groupBy("dst").agg(F.min("colour").alias("least"))
            after = settle(colour.join(near, F.col("id") == F.col("dst"), "left").select("id", F.col("colour").alias("before"), F.least("colour", F.coalesce("least", "colour")).alias("colour")))
            moved = not after.where("before <> colour").isEmpty()
            colour = after.select("id", "colour")
            if not moved:
                break
        own, other = colour.toDF("s", "sc"), colour.toDF("d", "dc")
        inside = settle(e.join(own, F.col("src") == F.col("s")).join(other, F.col("dst") == F.col("d")).where("sc = dc").select("src", "dst"))
        found = frontier = settle(colour.where("id = colour").select("id", F.col("colour").alias("scc")))
        while not frontier.isEmpty():
            back = inside.join(frontier, F.col("dst") == F.col("id")).select(F.col("src").alias("node"), "scc").distinct()
            frontier = settle(back.join(found.select(F.col("id").alias("known")), F.col("node") == F.col("known"), "left_anti").toDF("id", "scc"))
            found = settle(found.unionByName(frontier))
        done = found if done is None else settle(done.unionByName(found))
        gone = found.select(F.col("id").alias("gone"))
        left = settle(left.join(gone, F.col("id") == F.col("gone"), "left_anti"))
        e = settle(e.join(gone, F.col("src") == F.col("gone"), "left_anti").join(gone, F.col("dst") == F.col("gone"), "left_anti"))
    return nodes.select("id", F.col("id").alias("scc")).limit(0) if done is None else done


def condensation(edges: DataFrame, scc: DataFrame) -> DataFrame:
    """Distinct edges between strong components."""
    a, b = scc.toDF("s", "src_scc"), scc.toDF("d", "dst_scc")
    return edges.join(a, F.col("src") == F.col("s")).join(b, F.col("dst") == F.col("d")).where("src_scc <> dst_scc").select("src_scc", "dst_scc").distinct()


def levels(edges: DataFrame) -> DataFrame:
    """id, level: the longest path from a source of an acyclic graph; a cycle raises ValueError."""
    e = settle(edges.select("src", "dst").distinct())
    nodes = e.select(F.col("src").alias("id")).unionAll(e.select("dst")).distinct()
    n, depth = nodes.count(), 0
    at = settle(nodes.withColumn("level", F.lit(0).cast("long")))
    frontier = at.select("id")
    while not frontier.isEmpty():
        if depth > n:
            raise ValueError("the graph has a cycle")
        depth += 1
        frontier = settle(e.join(frontier, F.col("src") == F.col("id")).select(F.col("dst").alias("id")).distinct())
        hit = frontier.select(F.col("id").alias("hit"))
        at = settle(at.join(hit, F.col("id") == F.col("hit"), "left").select("id", F.when(F.col("hit").isNotNull(), F.lit(depth).cast("long")).otherwise(F.col("level")).alias("level")))
    return at


def shortest_path(edges: DataFrame, src, dst) -> list:
    """The node ids from src to dst on a shortest path (least parents first), [] if there is none."""
    spark = edges.sparkSession
    e = settle(edges.select("src", "dst").distinct())
    kind = dict(e.dtypes)["src"]
    seen = spark.createDataFrame([(src, None, 0)], f"id {kind}, parent {kind}, depth int")
    frontier = seen.select("id")
    depth = 0
    while seen.where(F.col("id") == F.lit(dst)).isEmpty():
        depth += 1
        step = e.join(frontier, F.col("src") == F.col("id")).groupBy("dst").agg(F.min("src").alias("parent"))
        fresh = settle(step.join(seen.select(F.col("id").alias("known")), F.col("dst") == F.col("known"), "left_anti").select(F.col("dst").alias("id"), "parent", F.lit(depth).alias("depth")))
        if fresh.isEmpty():
            return []
        seen, frontier = settle(seen.unionByName(fresh)), fresh.select("id")
    path = [dst]
    while path[-1] != src:  # as many lookups as the path has nodes
        path.append(seen.where(F.col("id") == F.lit(path[-1])).first().parent)
    return path[::-1]


def weights(edges: DataFrame) -> DataFrame:
    """src, dst, call_count, weight: parallel edges summed."""
    return edges.groupBy("src", "dst").agg(F.count("*").alias("call_count"), F.sum("confidence").alias("weight"))


def laplacian(edges: DataFrame) -> DataFrame:
    """row, col, value of L = D - (A + A') / 2, A summed over parallel edges, self-edges aside."""
    w = weights(edges.where("src <> dst"))
    half = w.select(F.col("src").alias("row"), F.col("dst").alias("col"), (F.col("weight") / 2).alias("v"))
    sym = half.unionAll(half.select(F.col("col"), F.col("row"), "v").toDF("row", "col", "v")).groupBy("row", "col").agg(F.sum("v").alias("v"))
    degree = sym.groupBy("row").agg(F.sum("v").alias("v")).select("row", F.col("row").alias("col"), F.col("v").alias("value"))
    return degree.unionAll(sym.select("row", "col", (-F.col("v")).alias("value")))


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree: the weighted degrees of the symmetrised graph."""
    return laplacian(edges).where("row = col").select(F.col("row").alias("id"), F.col("value").alias("degree"))


def entry_exit(edges: DataFrame, members: DataFrame) -> DataFrame:
    """id, part, is_entry, is_exit for members(id, part): without a caller, a callee, inside their own part."""
    a, b = members.toDF("s", "sp"), members.toDF("d", "dp")
    inside = edges.join(a, F.col("src") == F.col("s")).join(b, F.col("dst") == F.col("d")).where("sp = dp and src <> dst")
    called, calling = inside.select(F.col("dst").alias("called")).distinct(), inside.select(F.col("src").alias("calling")).distinct()
    flags = members.join(called, F.col("id") == F.col("called"), "left").join(calling, F.col("id") == F.col("calling"), "left")
    return flags.select("id", "part", F.col("called").isNull().alias("is_entry"), F.col("calling").isNull().alias("is_exit"))


def dominance(labels: DataFrame) -> DataFrame:
    """src, dst with left_src <= left_dst and right_src <= right_dst, for a group's labels(grp, id, l, r): exact on trees.

    A group is cut into a grid of about equal columns of l and rows of r, of GRID labels or so. A label's pairs lie in its
    own column, in its own row, or in cells above both, whose pairs all count: no candidate is met that gives no pair.
    """
    rows = settle(labels.select("grp", "id", "l", "r").where("grp is not null and id is not null and l is not null and r is not null"))
    types = dict(rows.dtypes)
    total, most = rows.groupBy("grp").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    cuts, tasks = min(64, (most or 0) // GRID), min(2000, max(8, (total or 0) // GRID))
    for c in ("l", "r"):
        if types[c] not in ("tinyint", "smallint", "int", "bigint"):
            rows = rows.withColumn(c, F.dense_rank().over(Window.partitionBy("grp").orderBy(c)).cast("long"))
    if cuts:
        cut = lambda c: F.percentile_approx(c, [k / (cuts + 1) for k in range(1, cuts + 1)], 10_000)
        bounds = rows.groupBy(F.col("grp").alias("og")).agg(cut("l").alias("ls"), cut("r").alias("rs"))
        at = lambda bs, c: F.size(F.filter(bs, lambda x: x < F.col(c)))
        rows = settle(rows.join(bounds, F.col("grp") == F.col("og")).select("grp", "id", "l", "r", at("ls", "l").alias("x"), at("rs", "r").alias("y")))
    else:
        rows = rows.withColumns({"x": F.lit(0), "y": F.lit(0)})

    def within(line: str, left: str, strict: bool) -> DataFrame:
        def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if parts := [f for f in frames if len(f)]:
                f = pd.concat(parts, ignore_index=True)
                ids = f.id.to_numpy()
                for i, j in _dominated(pd.factorize(f.block)[0], f.l.to_numpy(), f.r.to_numpy(), strict):
                    apart = ids[i] != ids[j]
                    yield pd.DataFrame({"src": ids[i][apart], "dst": ids[j][apart]})

        block = F.concat_ws("|", F.col("grp").cast("string"), F.col(line).cast("string"))
        return rows.select(block.alias("block"), "id", F.col(left).alias("l"), "r").repartition(tasks, "block").mapInPandas(of, f"src {types['id']}, dst {types['id']}")

    found = within("x", "l", False)
    if not cuts:
        return found
    cells = settle(rows.select("grp", "x", "y").distinct())
    above = cells.join(cells.toDF("og", "ox", "oy"), (F.col("grp") == F.col("og")) & (F.col("x") < F.col("ox")) & (F.col("y") < F.col("oy"))).drop("og")
    high = rows.select(F.col("grp").alias("og"), F.col("x").alias("hx"), F.col("y").alias("hy"), F.col("id").alias("dst"))
    low = rows.select("grp", "x", "y", F.col("id").alias("src")).join(above, ["grp", "x", "y"])
    all_of = low.join(high, (F.col("grp") == F.col("og")) & (F.col("ox") == F.col("hx")) & (F.col("oy") == F.col("hy"))).where("src <> dst")
    return found.unionByName(within("y", "x", True)).unionByName(all_of.select("src", "dst"))


def _dominated(block: np.ndarray, left: np.ndarray, right: np.ndarray, strict: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes i, j with left_i <= left_j (< if strict) and right_i <= right_j inside a block; i = j comes too.

    Ranks of left that differ do so first in one bit: there i has 0 and j 1, and j's are a run in the order of right.
    """
    order = np.lexsort((left, block))
    block, left = block[order], left[order]
    right = np.unique(right, return_inverse=True)[1][order]
    top = int(right.max()) + 1
    fresh = np.concatenate([[True], block[1:] != block[:-1]])
    rank = np.cumsum(fresh | np.concatenate([[True], left[1:] != left[:-1]]))
    rank -= np.maximum.accumulate(np.where(fresh, rank, 0))
    for level in range(int(strict), int(rank.max()).bit_length() + 1):
        above = rank >> level  # level 0 holds equal ranks
        node = np.cumsum(fresh | np.concatenate([[True], above[1:] != above[:-1]]))
        bit = rank >> (level - 1) & 1 if level else None
        i, j = (np.arange(len(rank)),) * 2 if bit is None else (np.flatnonzero(bit == 0), np.flatnonzero(bit == 1))
        key = node * top + right
        j = j[np.argsort(key[j])]
        first, last = np.searchsorted(key[j], key[i]), np.searchsorted(key[j], (node[i] + 1) * top)
        i, first, n = i[last > first], first[last > first], (last - first)[last > first]
        ends = np.cumsum(n)
        x = 0
        while x < len(i):
            y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + BATCH, "right")))
            starts = np.repeat(first[x:y] - (ends[x:y] - n[x:y]), n[x:y])
            yield order[np.repeat(i[x:y], n[x:y])], order[j[starts + np.arange(ends[x] - n[x], ends[y - 1])]]
            x = y


def neighbours(edges: DataFrame, ids: DataFrame, direction: str = "both") -> DataFrame:
    """id, neighbour of ids(id); both directions are concatenated, repeats kept."""
    out = edges.join(ids, F.col("src") == F.col("id")).select("id", F.col("dst").alias("neighbour"))
    into = edges.join(ids, F.col("dst") == F.col("id")).select("id", F.col("src").alias("neighbour"))
    return {"out": out, "in": into, "both": out.unionAll(into)}[direction]


def of_kind(rows: DataFrame, kinds: tuple[str, ...] = ("calls",)) -> DataFrame:
    """Edges or nodes of the kinds; FUNCTIONS names the kinds of nodes that can be called."""
    return rows.where(F.col("kind").isin(*kinds))


def subgraph(edges: DataFrame, ids: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """The edges between ids(id), of the kinds if any are given; repeated edges stay, repeated ids add none."""
    own = ids.select(F.col("id").alias("own"))
    inside = edges if kinds is None else of_kind(edges, kinds)
    return inside.join(own, F.col("src") == F.col("own"), "left_semi").join(own, F.col("dst") == F.col("own"), "left_semi")


#: kinds of nodes that can be called
FUNCTIONS = ("function", "method", "lambda")
#: parts of up to so many nodes are bisected by a dense eigendecomposition
DENSE = 1500


def _fiedler(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """The second least eigenvalue of the Laplacian of a symmetric graph (both directions listed) and its vector."""
    degree = np.bincount(i, w, n)
    if n <= DENSE:
        a = np.zeros((n, n))
        np.add.at(a, (i, j), w)
        values, vectors = np.linalg.eigh(np.diag(degree) - a)
        return float(values[1]), vectors[:, 1]
    # Lanczos on top - Laplacian, restarted, with the constant vector projected out and full orthogonalisation
    top, x = 2 * degree.max(), np.cos(np.arange(n) * 1.7)
    value = 0.0
    for _ in range(40):
        basis, alphas, betas = np.empty((min(60, n - 1) + 1, n)), [], []
        basis[0] = (x - x.mean()) / np.linalg.norm(x - x.mean())
        for k in range(min(60, n - 1)):
            v = basis[k]
            u = (top - degree) * v + np.bincount(i, w * v[j], n)
            alphas.append(float(u @ v))
            q = basis[: k + 1]
            for _ in range(2):
                u -= u.mean()
                u -= q.T @ (q @ u)
            betas.append(float(np.linalg.norm(u)))
            if betas[-1] < 1e-10 * top:
                break
            basis[k + 1] = u / betas[-1]
        k = len(alphas)
        values, vectors = np.linalg.eigh(np.diag(alphas) + np.diag(betas[: k - 1], 1) + np.diag(betas[: k - 1], -1))
        x, before, value = basis[:k].T @ vectors[:, -1], value, top - float(values[-1])
        if betas[-1] * abs(vectors[-1, -1]) < 1e-9 * top or abs(before - value) < 1e-12 * top:
            break
    return value, x / np.linalg.norm(x)


def _bisected(block: pd.DataFrame, least: int, deepest: int) -> Iterator[tuple]:
    ids = sorted(set(block.src) | set(block.dst))
    at = {x: i for i, x in enumerate(ids)}
    i, j, w = block.src.map(at).to_numpy(), block.dst.map(at).to_numpy(), block.weight.to_numpy(dtype=float) / 2
    i, j, w = (np.concatenate(x)[np.concatenate([i != j] * 2)] for x in ((i, j), (j, i), (w, w)))
    place = np.empty(len(ids), np.int64)
    stack = [(np.arange(len(ids)), "0", 0, (i, j, w))]
    while stack:  # a part comes with its own edges
        part, path, depth, (i, j, w) = stack.pop()
        value, split = None, None
        if len(part) > 1:
            place[part] = np.arange(len(part))
            value, v = _fiedler(len(part), place[i], place[j], w)
            v = -v if v[0] < -1e-12 else v  # the least id lies on the side of label 0
            label = v < -1e-9
            if len(part) >= 2 * least and depth < deepest and value > 1e-8 and label.any() and not label.all():
                split = part[~label], part[label]
        if split is None or min(map(len, split)) < 1:
            for x in part:
                yield ids[x], path, depth, value
        else:
            side = label[place[i]], label[place[j]]
            kept = [~(side[0] | side[1]), side[0] & side[1]]
            stack += [(half, f"{path}.{k}", depth + 1, (i[kept[k]], j[kept[k]], w[kept[k]])) for k, half in enumerate(split)]


def fiedler_partition(nodes: DataFrame, edges: DataFrame, least: int = 3, deepest: int = 10) -> DataFrame:
    """component, id, path, depth, lambda2: recursive sign bisection by the Fiedler vector, a component a block.

    edges(src, dst, confidence). A component's edges are held by one task; parts of over DENSE nodes are cut by Lanczos
    iteration on the sparse Laplacian, smaller ones by dense eigenvectors.
    """
    of = components(nodes, edges)
    inner = weights(edges).join(of, F.col("src") == F.col("id")).select("component", "src", "dst", "weight")
    kind = dict(nodes.dtypes)["id"]

    def split(block: pd.DataFrame) -> pd.DataFrame:
        rows = [(block.component.iloc[0], *r) for r in _bisected(block, least, deepest)]
        return pd.DataFrame(rows, columns=["component", "id", "path", "depth", "lambda2"])

    # so many partitions stay: small components would be drawn together into a task or two
    spark = inner.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return inner.repartition(tasks, "component").groupBy("component").applyInPandas(split, f"component {kind}, id {kind}, path string, depth int, lambda2 double")


def to_dot(edges: DataFrame) -> DataFrame:
    """One dot line an edge."""
    return edges.select(F.format_string('  "%s" -> "%s";', F.col("src").cast("string"), F.col("dst").cast("string")).alias("line"))


def hierarchy(nodes: DataFrame, edges: DataFrame, deepest: int = 10, least: int = 3) -> DataFrame:
    """level, grp, id, operation: strong components are condensed, then their graph is partitioned, and so on.

    Even levels condense, odd levels bisect; each level's groups hold the original ids. It ends when a level leaves
    the groups as they were.
    """
    member = settle(nodes.select("id", F.col("id").cast("string").alias("grp")))
    e = settle(edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "confidence"))
    out, before = None, member.count()
    for depth in range(deepest):
        units = member.select(F.col("grp").alias("id")).distinct()
        if depth % 2 == 0:
            of = strong_components(units, e).select(F.col("id").alias("unit"), F.col("scc").alias("into"))
        else:
            cut = fiedler_partition(units, e, least=least, deepest=1)
            of = units.select(F.col("id").alias("unit")).join(cut.select(F.col("id").alias("u"), F.concat_ws("/", "component", "path").alias("p")), F.col("unit") == F.col("u"), "left").select("unit", F.coalesce("p", "unit").alias("into"))
        of = settle(of)
        member = settle(member.join(of, F.col("grp") == F.col("unit")).select("id", F.col("into").alias("grp")))
        a, b = of.toDF("s", "si"), of.toDF("d", "di")
        e = settle(e.join(a, F.col("src") == F.col("s")).join(b, F.col("dst") == F.col("d")).where("si <> di").select(F.col("si").alias("src"), F.col("di").alias("dst"), "confidence"))
        level = member.select(F.lit(depth).alias("level"), "grp", "id", F.lit("condense" if depth % 2 == 0 else "partition").alias("operation"))
        out = level if out is None else out.unionByName(level)
        now = member.select("grp").distinct().count()
        if depth and now == before or now <= 1:
            break
        before = now
    return out


def augmented(edges: DataFrame, members: DataFrame) -> DataFrame:
    """edges(src, dst) inside each part of members(id, part), with a virtual source and sink for its entries and exits.

    A part without entries (or exits) is entered (or left) at every member.
    """
    a, b = members.toDF("s", "sp"), members.toDF("d", "dp")
    inside = edges.join(a, F.col("src") == F.col("s")).join(b, F.col("dst") == F.col("d")).where("sp = dp").select(F.col("sp").alias("part"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    flags = entry_exit(edges, members)
    some = flags.groupBy("part").agg(F.bool_or("is_entry").alias("some_entry"), F.bool_or("is_exit").alias("some_exit"))
    flags = flags.join(some, "part").select("part", F.col("id").cast("string").alias("id"), (F.col("is_entry") | ~F.col("some_entry")).alias("enters"), (F.col("is_exit") | ~F.col("some_exit")).alias("leaves"))
    mark = lambda kind: F.concat(F.lit(f"__{kind}_"), F.col("part").cast("string"))
    into = flags.where("enters").select("part", mark("source").alias("src"), F.col("id").alias("dst"))
    away = flags.where("leaves").select("part", F.col("id").alias("src"), mark("sink").alias("dst"))
    return inside.unionByName(into).unionByName(away)


def maybe_planar(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """component, n, m, verdict: nonplanar where m > 3n - 6, planar up to four nodes or for forests, else unknown."""
    of = components(nodes, edges)
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    m = pairs.join(of, F.col("a") == F.col("id")).groupBy("component").agg(F.count("*").alias("m"))
    n = of.groupBy("component").agg(F.count("*").alias("n")).join(m, "component", "left").fillna(0, ["m"])
    verdict = F.when((F.col("n") <= 4) | (F.col("m") < F.col("n")), "planar").when(F.col("m") > 3 * F.col("n") - 6, "nonplanar").otherwise("unknown")
    return n.withColumn("verdict", verdict)
