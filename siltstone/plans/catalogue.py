"""The registered code-quality queries and their SQL.

The driver's tables stand in for code-quality relations (see `_base`): documents and labels for mutants, events for
runs and belief events, lineitem for regions, suppliers and parts for weighted call edges, and so on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import outcomes as o
from siltstone.functions import programs
from siltstone.functions import regions as r
from siltstone.operators import beliefs, graph, mutation, synthesis, tables, vectors, verification
from siltstone.sources import code

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

# SQL of the base relations, for the oracle
_CTE = {
    "mutants": "select doc_id, source as file_path, case quality when 1 then 'killed' when 0 then 'survived' else 'no_coverage' end as outcome from documents left join labels using (doc_id)",
    "runs": "select event_type as project, user_id as region, event_id as id, ts, value - floor(value) as score from events",
    "belief": "select event_id as seq, ts, case event_type when 'purchase' then 'expand' when 'view' then 'contract' when 'error' then 'revise' when 'click' then 'evidence' else 'rollback' end as event_type, user_id as assertion_id, event_id as evidence_id from events",
    "pairs": "select user_id as src, lead(user_id) over (partition by event_id // 50 order by event_id) as dst from events",
    "g": "select distinct src, dst from pairs where src is not null and dst is not null",
    "nodes": "select src as id from g union select dst from g",
    "tree": "select 'r' || r_regionkey as src, 'n' || n_nationkey as dst from region join nation on n_regionkey = r_regionkey union all select 'n' || n_nationkey, 'c' || c_custkey from nation join customer on c_nationkey = n_nationkey",
    "bed": "select l_suppkey as src, l_partkey as dst, 1 - l_discount as confidence, l_linenumber % 6 as tier from lineitem",
    "reg": "select l_orderkey, l_linenumber as n, 'o' || l_orderkey as file_path, l_returnflag as class_name, l_linestatus as func_name, cast(l_linenumber as bigint) as line_start, cast(l_linenumber + cast(floor(l_quantity) as bigint) % 4 as bigint) as line_end from lineitem where l_linenumber is not null",
    "old": "select 'd' || doc_id as path, sha256(text) as content_hash from documents where doc_id % 10 <> 0",
    "new": "select 'd' || doc_id as path, sha256(case when doc_id % 5 = 0 then text || '!' else text end) as content_hash from documents where doc_id % 7 <> 0",
    "msg": "select event_id as id, user_id as region, (['TypeError: bad operand', 'precondition failed', 'ValueError: negative', 'index out of range', 'ensures sorted not met', 'expected 3 but got 4', 'loop invariant broken', 'stack overflow', 'AssertionError: x', 'all quiet'])[cast(event_id % 10 as int) + 1] as message, value / (abs(value) + 50) as passing from events",
}


def _with(*names: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}" + ", ".join(f"{n} as ({_CTE[n]})" for n in names)


class _Base:
    """The same relations as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def mutants(self) -> DataFrame:
        outcome = F.when(F.col("quality") == 1, "killed").when(F.col("quality") == 0, "survived").otherwise("no_coverage")
        return self.documents.select("doc_id", "source").join(self.labels, "doc_id", "left").select("doc_id", F.col("source").alias("file_path"), outcome.alias("outcome"))

    @property
    def runs(self) -> DataFrame:
        return self.events.select(F.col("event_type").alias("project"), F.col("user_id").alias("region"), F.col("event_id").alias("id"), "ts", (F.col("value") - F.floor("value")).alias("score"))

    @property
    def belief(self) -> DataFrame:
        kind = F.when(F.col("event_type") == "purchase", "expand").when(F.col("event_type") == "view", "contract").when(F.col("event_type") == "error", "revise").when(F.col("event_type") == "click", "evidence").otherwise("rollback")
        return self.events.select(F.col("event_id").alias("seq"), "ts", kind.alias("event_type"), F.col("user_id").alias("assertion_id"), F.col("event_id").alias("evidence_id"))

    @property
    def g(self) -> DataFrame:
        after = F.lead("user_id").over(Window.partitionBy(F.expr("event_id div 50")).orderBy("event_id"))
        return self.events.select(F.col("user_id").alias("src"), after.alias("dst")).where("src is not null and dst is not null").distinct()

    @property
    def g_nodes(self) -> DataFrame:
        return self.g.select(F.col("src").alias("id")).union(self.g.select("dst")).distinct()

    @property
    def tree(self) -> DataFrame:
        a = self.region.join(self.nation, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("r"), "r_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
        b = self.nation.join(self.customer, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"))
        return a.unionByName(b)

    @property
    def calls(self) -> DataFrame:
        return self.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), (F.lit(1) - F.col("l_discount")).alias("confidence"), (F.col("l_linenumber") % 6).alias("tier"))

    @property
    def regions(self) -> DataFrame:
        start = F.col("l_linenumber").cast("long")
        return self.lineitem.where("l_linenumber is not null").select(
            "l_orderkey", F.col("l_linenumber").alias("n"),
            F.struct(F.concat(F.lit("o"), "l_orderkey").alias("file_path"), F.col("l_returnflag").alias("class_name"), F.col("l_linestatus").alias("func_name"), start.alias("line_start"), (start + F.floor("l_quantity") % 4).cast("long").alias("line_end")).alias("r"),
        )

    def snapshot(self, new: bool) -> DataFrame:
        text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")) if new else F.col("text")
        return self.documents.where("doc_id % 7 <> 0" if new else "doc_id % 10 <> 0").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.sha2(text, 256).alias("content_hash"))

    @property
    def messages(self) -> DataFrame:
        texts = ["TypeError: bad operand", "precondition failed", "ValueError: negative", "index out of range", "ensures sorted not met", "expected 3 but got 4", "loop invariant broken", "stack overflow", "AssertionError: x", "all quiet"]
        message = F.get(F.array(*map(F.lit, texts)), (F.col("event_id") % 10).cast("int"))
        return self.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("region"), message.alias("message"), (F.col("value") / (F.abs("value") + 50)).alias("passing"))


def query(sql: str | None = None):
    def add(f: Callable[[_Base], DataFrame]) -> Callable:
        _queries[f.__name__] = lambda spark, sf_dir: f(_Base(spark, sf_dir))
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


_TALLY = "count(*) as total, count(*) filter (where outcome = 'killed') as killed, count(*) filter (where outcome = 'survived') as survived, count(*) filter (where outcome = 'no_coverage') as no_coverage"
_SCORE = "case when killed + survived = 0 then 0.0::double else killed::double / (killed + survived) end as mutation_score"


@query(f"{_with('mutants')}, t as (select file_path, {_TALLY} from mutants group by file_path) select *, {_SCORE} from t")
def mutation_score_by_file(b):
    return mutation.score_by_file(b.mutants)


@query(f"{_with('mutants')}, t as (select file_path, {_TALLY}, cast(grouping(file_path) as int) as is_total from mutants group by rollup (file_path)) select *, {_SCORE} from t")
def mutation_score_rollup(b):
    return mutation.score_rollup(b.mutants)


_RAW = "(['Killed', 'SURVIVED', 'No Coverage', 'no_coverage', 'Timeout', 'NoCoverage', 'survivedNoCoverage', 'Ignored'])[cast(doc_id % 8 as int) + 1]"


def _raw(b):
    raw = F.get(F.array(*map(F.lit, ["Killed", "SURVIVED", "No Coverage", "no_coverage", "Timeout", "NoCoverage", "survivedNoCoverage", "Ignored"])), (F.col("doc_id") % 8).cast("int"))
    return b.documents.select("doc_id", "source", raw.alias("raw"))


@query(f"with t as (select source, {_RAW} as raw from documents) select source, raw, case when lower(raw) in ('killed', 'survived') then lower(raw) when lower(raw) in ('no coverage', 'nocoverage', 'survivednocoverage') then 'no_coverage' else 'other' end as outcome, count(*) as n from t group by all")
def outcome_normalise_stryker(b):
    return _raw(b).groupBy("source", "raw", o.stryker_outcome(F.col("raw")).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"with t as (select source, {_RAW} as raw from documents), p as (select *, regexp_replace(lower(raw), '[_ ]', '', 'g') as s from t) select source, raw, case when s in ('killed', 'survived') then s when s = 'nocoverage' then 'no_coverage' else 'other' end as outcome, count(*) as n from p group by all")
def outcome_normalise_poodle(b):
    return _raw(b).groupBy("source", "raw", o.poodle_outcome(F.col("raw")).alias("outcome")).agg(F.count("*").alias("n"))


@query("""with t as (select doc_id, (['WorkerOutcome.NORMAL', '1', 'exception', null])[cast(doc_id % 4 as int) + 1] as w, (['TestOutcome.KILLED', 'survived', '2', null, '1'])[cast(doc_id % 5 as int) + 1] as k from documents),
u as (select doc_id, case when lower(coalesce(w, 'normal')) like '%normal%' then 'normal' when w = '1' then 'timeout' else 'exception' end as w, case when lower(coalesce(k, 'survived')) like '%killed%' or k = '1' then 'killed' when lower(coalesce(k, 'survived')) like '%survived%' then 'survived' else 'incompetent' end as k from t)
select doc_id, case when w = 'normal' and k in ('killed', 'survived') then k when w in ('timeout', 'exception') or k = 'incompetent' then 'no_coverage' else 'other' end as outcome from u""")
def outcome_normalise_cosmic(b):
    of = lambda values: F.get(F.array(*[F.lit(v).cast("string") for v in values]), (F.col("doc_id") % len(values)).cast("int"))
    return b.documents.select("doc_id", o.cosmic_outcome(of(["WorkerOutcome.NORMAL", "1", "exception", None]), of(["TestOutcome.KILLED", "survived", "2", None, "1"])).alias("outcome"))


_UM = "select p_partkey, case p_partkey % 3 when 0 then 'src/f' || p_partkey || '.mutant.' || p_size || '.py' when 1 then 'lib' || p_partkey || '_mutant_' || p_size else 'plain' || p_partkey end as name from part"


@query(f"with t as ({_UM}) select p_partkey, case p_partkey % 3 when 0 then 'src/f' || p_partkey || '.py' when 1 then 'lib' || p_partkey else name end as source from t")
def um_source_extract(b):
    kind, key = F.col("p_partkey") % 3, F.col("p_partkey").cast("string")
    name = F.when(kind == 0, F.concat(F.lit("src/f"), key, F.lit(".mutant."), "p_size", F.lit(".py"))).when(kind == 1, F.concat(F.lit("lib"), key, F.lit("_mutant_"), "p_size")).otherwise(F.concat(F.lit("plain"), key))
    return b.part.select("p_partkey", o.mutant_source(name).alias("source"))


@query("select p_partkey, replace(replace(p_name, ' ', '.'), '.', '/') || '.py' as path from part")
def module_to_path(b):
    return b.part.select("p_partkey", o.module_to_path(F.replace("p_name", F.lit(" "), F.lit("."))).alias("path"))


@query("""with t as (select p_partkey, string_split('pkg.sub' || p_size || '.mod' || p_partkey, '.') as parts, p_partkey % 5 as lvl from part)
select p_partkey, case when lvl = 0 then 'x.y' when lvl > 3 then null when lvl = 3 then 'x.y' else array_to_string(parts[1 : 3 - lvl], '.') || '.x.y' end as module from t""")
def relative_import(b):
    importer = F.concat(F.lit("pkg.sub"), "p_size", F.lit(".mod"), "p_partkey")
    return b.part.select("p_partkey", o.relative_import(importer, (F.col("p_partkey") % 5).cast("int"), F.lit("x.y")).alias("module"))


@query(f"{_with('runs')} select * from runs where project = 'click' order by ts desc, id desc limit 20")
def run_history_topk(b):
    return mutation.history(b.runs, "click", limit=20)


@query(f"""{_with("runs")}, k as (select *, row_number() over (partition by project, region order by ts desc, id desc) as rank from runs)
select project, region, max(case when rank = 1 then 1 - score end) as p, round(sum((1 - score) * pow(0.8, rank - 1)), 6) as i,
coalesce(max(case when rank = 1 then 1 - score end) - max(case when rank = 2 then 1 - score end), 0.0) as d, count(*) as n_runs from k where rank <= 5 group by project, region""")
def region_pid_metrics(b):
    return mutation.region_pid(b.runs).withColumn("i", F.round("i", 6))


@query(f"""{_with("runs")}, k as (select *, lag(score) over (partition by project, region order by ts, id) as before from runs)
select project, region, ts, id, before, score from k where before - score > 0.1 qualify row_number() over (partition by project, region order by ts, id) = 1""")
def score_regression(b):
    return mutation.score_regressions(b.runs)


_REGION_TEXT = "'file:' || file_path || '::class:' || class_name || '::func:' || func_name || '::lines:' || line_start || '-' || line_end"


@query(f"{_with('reg')} select l_orderkey, n, {_REGION_TEXT} as region, 'lines' as level, line_start, line_end, file_path, true as is_valid from reg")
def region_parse_format(b):
    split = b.regions.withColumn("t", r.text(F.col("r"))).withColumn("parts", r.parts(F.col("t")))
    parsed = split.withColumn("p", r.parse(F.col("t"), F.col("parts")))
    return parsed.select("l_orderkey", "n", r.text(F.col("p")).alias("region"), r.level(F.col("p")).alias("level"), "p.line_start", "p.line_end", "p.file_path", r.valid(F.col("p")).alias("is_valid"))


def _region_pairs(b, rule):
    a = b.regions.select("l_orderkey", "n", "r")
    c = b.regions.select(F.col("l_orderkey").alias("k"), F.col("n").alias("m"), F.col("r").alias("s"))
    return a.join(c, (F.col("r.file_path") == F.col("s.file_path")) & (F.col("n") != F.col("m"))).where(rule(F.col("r"), F.col("s"))).select("l_orderkey", "n", "m")


@query(f"{_with('reg')} select a.l_orderkey, a.n, c.n as m from reg a join reg c on a.file_path = c.file_path and a.n <> c.n where c.line_start >= a.line_start and c.line_end <= a.line_end")
def region_containment(b):
    return _region_pairs(b, r.contains)


@query(f"{_with('reg')} select a.l_orderkey, a.n, c.n as m from reg a join reg c on a.file_path = c.file_path and a.n <> c.n where a.line_start <= c.line_end and c.line_start <= a.line_end")
def region_overlap(b):
    return _region_pairs(b, r.overlaps)


@query(f"""{_with("reg")}, m as (select *, case func_name when 'O' then 'killed' else 'survived' end as outcome from reg),
w as (select distinct file_path, 1 as lo, 3 as hi from reg), t as (select w.file_path as region_id, {_TALLY} from w join m on w.file_path = m.file_path and m.line_start >= lo and m.line_end <= hi group by all) select *, {_SCORE} from t""")
def region_mutant_stats(b):
    near = b.regions.select("r.file_path").distinct()
    windows = near.select(F.col("file_path").alias("region_id"), F.struct("file_path", F.lit(None).cast("string").alias("class_name"), F.lit(None).cast("string").alias("func_name"), F.lit(1).cast("long").alias("line_start"), F.lit(3).cast("long").alias("line_end")).alias("r"))
    found = b.regions.select(F.col("r").alias("m"), F.when(F.col("r.func_name") == "O", "killed").otherwise("survived").alias("outcome"))
    return mutation.region_stats(windows, found, r.contains)


@query(f"{_with('old', 'new')} select coalesce(old.path, new.path) as path, case when old.path is null then 'added' when new.path is null then 'removed' else 'modified' end as change from old full join new on old.path = new.path where old.content_hash is distinct from new.content_hash")
def file_changes(b):
    return tables.file_changes(b.snapshot(False), b.snapshot(True))


@query("select doc_id, sha256(text) as content_hash from documents")
def file_sha256(b):
    return b.documents.select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("""with u as (select o_custkey as id, o_orderstatus as kind, -1 as seq from orders where o_orderkey % 2 = 0 qualify row_number() over (partition by o_custkey order by o_orderkey) = 1
union all select o_custkey, o_orderpriority, o_orderkey from orders where o_orderkey % 2 = 1) select id, kind from u qualify row_number() over (partition by id order by seq desc) = 1""")
def upsert_keep_last(b):
    old = b.orders.where("o_orderkey % 2 = 0").withColumn("nth", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("nth = 1")
    old = old.select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("kind"))
    return tables.upsert(old, b.orders.where("o_orderkey % 2 = 1").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("seq")), ["id"])


@query("select l_suppkey as source_id, l_partkey as target_id, count(*) as n from lineitem where l_suppkey not in (select s_suppkey from supplier where s_nationkey in (3, 5)) and l_partkey not in (select s_suppkey from supplier where s_nationkey in (3, 5)) group by all")
def delete_cascade(b):
    nodes = b.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("file_path"))
    edges = b.calls.select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"))
    files = b.nation.where("n_nationkey in (3, 5)").select(F.col("n_nationkey").alias("file_path"))
    return tables.delete_cascade(nodes, edges, files)[1].groupBy("source_id", "target_id").agg(F.count("*").alias("n"))


@query(f"{_with('old', 'new')}, c as (select coalesce(old.path, new.path) as path, case when old.path is null then 'added' when new.path is null then 'removed' else 'modified' end as change from old full join new on old.path = new.path where old.content_hash is distinct from new.content_hash) select path || '.n' as id, path as file_path from old where path not in (select path from c where change <> 'added') union all select path || '.m', path from new where path in (select path from c where change <> 'removed')")
def incremental_apply(b):
    old, new = b.snapshot(False), b.snapshot(True)
    named = lambda s, end: s.select(F.concat("path", F.lit(end)).alias("id"), F.col("path").alias("file_path"))
    return tables.incremental_apply(old, new, named(old, ".n"), named(new, ".m"))


@query(f"{_with('pairs', 'g')} select src as id, dst as neighbour from g")
def neighbors_out(b):
    return graph.neighbours(b.g, b.g_nodes, "out")


@query(f"{_with('pairs', 'g')}, inner_nodes as (select src as id from g intersect select dst from g) select src, dst from g where src in (select id from inner_nodes) and dst in (select id from inner_nodes)")
def induced_subgraph(b):
    """The edges between nodes that have both callers and callees."""
    return graph.subgraph(b.g, b.g.select(F.col("src").alias("id")).intersect(b.g.select("dst")))


@query("select l_suppkey as src, l_partkey as dst, l_returnflag as kind from lineitem where l_returnflag in ('A', 'R')")
def edges_of_kind(b):
    return graph.of_kind(b.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("kind")), ("A", "R"))


@query(f"{_with('pairs', 'g')} select dst as id, src as neighbour from g")
def neighbors_in(b):
    return graph.neighbours(b.g, b.g_nodes, "in")


@query(f"{_with('pairs', 'g')} select src as id, dst as neighbour from g union all select dst, src from g")
def neighbors_both(b):
    return graph.neighbours(b.g, b.g_nodes, "both")


@query(f"{_with('bed')} select src, dst, count(*) as call_count, round(sum(confidence), 6) as weight from bed group by src, dst")
def edge_weights(b):
    return graph.weights(b.calls).withColumn("weight", F.round("weight", 6))


_LAP = "w as (select 's' || src as a, 'p' || dst as b, sum(confidence) / 2 as v from bed group by all), y as (select a as row, b as col, v from w union all select b, a, v from w)"


def _named_calls(b):
    return b.calls.select(F.concat(F.lit("s"), "src").alias("src"), F.concat(F.lit("p"), "dst").alias("dst"), "confidence")


@query(f"{_with('bed')}, {_LAP} select row, row as col, round(sum(v), 6) as value from y group by row union all select row, col, round(-v, 6) from y")
def laplacian_coo(b):
    return graph.laplacian(_named_calls(b)).withColumn("value", F.round("value", 6))


@query(f"{_with('bed')}, {_LAP} select row as id, round(sum(v), 6) as degree from y group by row")
def weighted_degree(b):
    return graph.degrees(_named_calls(b)).withColumn("degree", F.round("degree", 6))


_CLOSE = f"{_with('pairs', 'g', recursive=True)}, c(src, dst) as (select src, dst from g union select c.src, g.dst from c join g on c.dst = g.src)"


@query(f"{_CLOSE} select src, dst from c where src <> dst")
def reachability_closure(b):
    return graph.closure(b.g).select("src", "dst")


@query(f"{_CLOSE} select dst as src, src as dst from c where src <> dst")
def reverse_reachability(b):
    return graph.closure(b.g, reverse=True).select("src", "dst")


@query(f"{_with('tree')} select src, dst from tree where src like 'r%' union all select a.src, c.dst from tree a join tree c on a.dst = c.src where a.src like 'r%'")
def bounded_reachability(b):
    return graph.closure(b.tree, b.tree.where("src like 'r%'").select(F.col("src").alias("id")), max_depth=2).select("src", "dst")


# without a depth cap SQL's recursion over depths doesn't end; tested against brute force
@query()
def shortest_path_length(b):
    return graph.closure(b.g)


_COMP = f"{_with('pairs', 'g', 'nodes', recursive=True)}, u as (select src, dst from g union select dst, src from g), c(id, other) as (select id, id from nodes union select c.id, u.dst from c join u on c.other = u.src), k as (select id, min(other) as component from c group by id)"


@query(f"{_COMP} select id, component from k")
def connected_components(b):
    return graph.components(b.g_nodes, b.g)


@query(f"{_COMP} select component, count(*) as size from k group by component")
def component_sizes(b):
    return graph.components(b.g_nodes, b.g).groupBy("component").agg(F.count("*").alias("size"))


_SCC = f"{_with('pairs', 'g', 'nodes', recursive=True)}, c(src, dst) as (select src, dst from g union select c.src, g.dst from c join g on c.dst = g.src), k as (select id, least(id, coalesce((select min(x.dst) from c x join c y on x.src = y.dst and x.dst = y.src where x.src = id), id)) as scc from nodes)"


@query(f"{_SCC} select id, scc from k")
def scc_members(b):
    return graph.strong_components(b.g_nodes, b.g)


@query(f"{_SCC} select distinct x.scc as src_scc, y.scc as dst_scc from g join k x on g.src = x.id join k y on g.dst = y.id where x.scc <> y.scc")
def condensation_edges(b):
    return graph.condensation(b.g, graph.strong_components(b.g_nodes, b.g))


@query(f"{_with('tree')} select src as id, 0::bigint as level from tree where src like 'r%' group by src union all select dst, case when dst like 'n%' then 1::bigint else 2::bigint end from tree")
def dag_levels(b):
    return graph.levels(b.tree)


@query(f"{_with('pairs', 'g', 'nodes')}, i as (select * from g where src % 14 = dst % 14 and src <> dst) select id, id % 14 as part, id not in (select dst from i) as is_entry, id not in (select src from i) as is_exit from nodes")
def entry_exit_points(b):
    return graph.entry_exit(b.g, b.g_nodes.select("id", (F.col("id") % 14).alias("part")))


@query("select n_regionkey as a, n_nationkey as b from nation union all select c_nationkey + 100, c_custkey + 1000 from customer union all select n_regionkey, c_custkey + 1000 from customer join nation on c_nationkey = n_nationkey")
def kameda_dominance_pairs(b):
    # pre-order numbers with children left to right and right to left: dominance in both is reachability on a tree
    n = b.nation.select(F.col("n_regionkey").cast("long").alias("grp"), F.col("n_nationkey").cast("long").alias("nk"))
    c = b.customer.join(n, F.col("c_nationkey") == F.col("nk")).select("grp", "nk", "c_custkey")
    big = 10**12  # over any customer's key
    root = n.select("grp", F.col("grp").alias("id"), F.lit(-1).cast("long").alias("l"), F.lit(-1).cast("long").alias("r")).distinct()
    mid = n.select("grp", (F.col("nk") + 100).alias("id"), (F.col("nk") * big).alias("l"), ((F.lit(99) - F.col("nk")) * big).alias("r"))
    leaf = c.select("grp", (F.col("c_custkey") + 1000).alias("id"), (F.col("nk") * big + 1 + F.col("c_custkey")).alias("l"), ((F.lit(99) - F.col("nk")) * big + big - 1 - F.col("c_custkey")).alias("r"))
    named = graph.dominance(root.unionByName(mid).unionByName(leaf))
    undo = F.when(F.col("dst").between(100, 999) & (F.col("src") < 100), F.col("dst") - 100).otherwise(F.col("dst"))
    return named.select(F.col("src").alias("a"), undo.alias("b"))


@query("""with n as (select p_partkey, p_name, 'm' || p_size || '.' || replace(p_name, ' ', '_') as id from part), q as (select distinct replace(p_name, ' ', '_') as name from part),
h as (select name, count(distinct id) as n, min(id) as least from q join n on n.id like '%.' || replace(name, '_', '\\_') escape '\\' group by name)
select name, case when n = 1 then 'resolved' else 'ambiguous' end as status, case when n = 1 then least end as id, n from h""")
def name_resolution(b):
    plain = F.replace("p_name", F.lit(" "), F.lit("_"))
    nodes = b.part.select(F.concat(F.lit("m"), "p_size", F.lit("."), plain).alias("id"), plain.alias("name")).distinct()
    return tables.resolve_name(nodes, b.part.select(plain.alias("name")).distinct())


@query("""with m as (select distinct 'a' || p_size % 5 || '.b' || p_size as module from part union select distinct 'a' || p_size % 5 from part), t as (select distinct 'a' || p_size % 5 || '.b' || (p_size + p_partkey % 2 * 100) || '.f' || p_partkey as target from part)
select target, arg_max(module, length(module)) as module from t join m on starts_with(target || '.', module || '.') group by target""")
def import_resolution(b):
    a = F.concat(F.lit("a"), F.col("p_size") % 5)
    modules = b.part.select(F.concat(a, F.lit(".b"), "p_size").alias("module")).union(b.part.select(a)).distinct()
    targets = b.part.select(F.concat(a, F.lit(".b"), (F.col("p_size") + F.col("p_partkey") % 2 * 100), F.lit(".f"), "p_partkey").alias("target")).distinct()
    return tables.longest_prefix(targets, modules)


def _query_vector(b):
    return list(b.embeddings.where("vec_id = 0").first().embedding)


_VEC = "with q as (select embedding as qv from embeddings where vec_id = 0), s as (select vec_id as id, label, greatest(0.0, list_cosine_similarity(embedding::double[], qv::double[])) as score from embeddings, q)"


@query(f"{_VEC} select id, round(score, 4) as score, row_number() over (order by score desc, id) as rank from s order by s.score desc, id limit 10")
def vector_topk(b):
    return vectors.search(b.embeddings.withColumnRenamed("vec_id", "id"), _query_vector(b), 10).withColumn("score", F.round("score", 4))


@query(f"{_VEC} select id, round(score, 4) as score, row_number() over (order by score desc, id) as rank from s where label = 1 order by s.score desc, id limit 10")
def vector_topk_filtered(b):
    return vectors.search(b.embeddings.withColumnRenamed("vec_id", "id"), _query_vector(b), 10, F.col("label") == 1).withColumn("score", F.round("score", 4))


@query(f"""{_VEC}, h as (select id, score, row_number() over (order by score desc, id) as rank from s order by s.score desc, id limit 15),
e as (select vec_id as src, vec_id + 1 as dst from embeddings), n as (select dst as n, rank, 0 as way, score * 0.8 as s from h join e on h.id = src where rank <= 10 union all select src, rank, 1, score * 0.7 from h join e on h.id = dst where rank <= 10),
f as (select * from n where n not in (select id from h) qualify row_number() over (partition by n order by rank, way) = 1)
select id, round(score, 4) as score, 'vector' as source from h union all select n, round(s, 4), case way when 0 then 'callee' else 'caller' end from f""")
def rag_expand_rerank(b):
    hits = vectors.search(b.embeddings.withColumnRenamed("vec_id", "id"), _query_vector(b), 15)
    edges = b.embeddings.select(F.col("vec_id").alias("src"), (F.col("vec_id") + 1).alias("dst"))
    return vectors.expand(hits, edges).withColumn("score", F.round("score", 4))


@query("with u as (select source, doc_id, text, sum(length(text)) over (partition by source order by doc_id) as used from documents) select source, count(*) as n, string_agg(text, chr(10) order by doc_id) as context from u where used <= 4 * 2000 group by source")
def context_pack(b):
    return vectors.pack_context(b.documents.select("source", F.col("doc_id").alias("rank"), "text"), 2000, "source")


@query(f"{_with('belief')} select event_type, count(*) as n from belief group by event_type")
def event_type_counts(b):
    return beliefs.event_summary(b.belief)


@query(f"{_with('belief')} select seq, event_type, assertion_id from belief order by seq desc limit 10")
def recent_events(b):
    return b.belief.orderBy(F.desc("seq")).limit(10).select("seq", "event_type", "assertion_id")


@query(f"{_with('belief')} select assertion_id, evidence_id from belief where event_type in ('expand', 'revise')")
def why_believe(b):
    return beliefs.why_believe(b.belief)


@query(f"{_with('belief')} select assertion_id, seq, ts from belief where event_type in ('expand', 'revise') qualify row_number() over (partition by assertion_id order by seq) = 1")
def when_added(b):
    return beliefs.first_event(b.belief, beliefs.ADDING)


@query(f"{_with('belief')} select assertion_id, seq, ts from belief where event_type in ('contract', 'revise') qualify row_number() over (partition by assertion_id order by seq) = 1")
def when_removed(b):
    return beliefs.first_event(b.belief, beliefs.REMOVING)


@query(f"""{_with("belief")}, s as (select assertion_id, count(*) filter (where event_type in ('contract', 'revise')) as revisions from belief group by assertion_id), t as (select *, 1.0::double / (1 + revisions) as stability from s)
select *, case when stability > 0.8 then 'very stable' when stability > 0.5 then 'stable' when stability > 0.2 then 'unstable' else 'highly unstable' end as label from t""")
def belief_stability(b):
    return beliefs.stability(b.belief).withColumn("label", o.stability_label(F.col("stability")))


_WORLDS = "select conv_id * 100 + turn as seq, 'w' || conv_id || '.' || turn as to_world, case when turn > 0 then 'w' || conv_id || '.' || (turn - 1) end as from_world from conversations"


def _worlds(b):
    at = lambda t: F.concat(F.lit("w"), "conv_id", F.lit("."), t)
    return b.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("seq"), at(F.col("turn")).alias("to_world"), F.when(F.col("turn") > 0, at(F.col("turn") - 1)).alias("from_world"))


@query(f"with w as ({_WORLDS}), s as (select from_world as hash, seq, 0 as pos from w union all select to_world, seq, 1 from w) select hash, seq, pos from s where hash is not null qualify row_number() over (partition by hash order by seq, pos) = 1")
def world_hashes_first_seen(b):
    return beliefs.world_hashes(_worlds(b))


@query("with m as (select max(turn) as last from conversations where conv_id = 1) select 'w1.' || t as hash, cast(last - t as int) as steps from m, range(0, 100) x(t) where t <= last")
def world_path(b):
    last = b.conversations.where("conv_id = 1").agg(F.max("turn")).first()[0]
    return beliefs.world_path(_worlds(b), f"w1.{last}")


@query(f"{_with('bed')} select src as node, round(least(1.0, 0.7 * avg(0.5 * (1 - tier / 5.0) + 0.5 * confidence) + 0.3 * least(1.0, count(*) / 5.0)), 6) as entrenchment from bed group by src")
def entrenchment(b):
    support = b.calls.select(F.col("dst").alias("parent"), F.col("src").alias("child"), "tier", "confidence")
    return beliefs.entrenchment(support).withColumn("entrenchment", F.round("entrenchment", 6))


_CLAIMS = "select c_custkey as id, 'r' || c_custkey // 4 as region_id, case when c_custkey % 8 < 4 then 'type' else 'behavior' end as kind, (['x: int', 'x: str', 'X: int ', 'value is always true', 'value is never true', 'accepts null', 'rejects null', 'not accepts null'])[cast(c_custkey % 8 as int) + 1] as content from customer"


@query(f"""with a as ({_CLAIMS}) select x.id as a_id, y.id as b_id from a x join a y on x.region_id = y.region_id and x.kind = y.kind and x.id < y.id
where case x.kind when 'type' then lower(trim(x.content)) <> lower(trim(y.content)) else (x.content like '%always%' and y.content like '%never%') or (x.content like '%never%' and y.content like '%always%')
or (x.content like '%accepts%' and y.content like '%rejects%') or (x.content like '%rejects%' and y.content like '%accepts%') or x.content = 'not ' || y.content or y.content = 'not ' || x.content end""")
def contradictions(b):
    texts = ["x: int", "x: str", "X: int ", "value is always true", "value is never true", "accepts null", "rejects null", "not accepts null"]
    kind = F.when(F.col("c_custkey") % 8 < 4, "type").otherwise("behavior")
    content = F.get(F.array(*map(F.lit, texts)), (F.col("c_custkey") % 8).cast("int"))
    return beliefs.contradictions(b.customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("r"), F.expr("c_custkey div 4")).alias("region_id"), kind.alias("kind"), content.alias("content")))


def _support(b):
    extra = b.customer.where("c_custkey % 3 = 0").select(F.lit("r4").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("child"))
    return b.tree.select(F.col("src").alias("parent"), F.col("dst").alias("child")).unionByName(extra)


_SUP = f"{_with('tree')}, s as (select src as parent, dst as child from tree union all select 'r4', 'c' || c_custkey from customer where c_custkey % 3 = 0), d as (select child from s where parent = 'r1' union select y.child from s x join s y on x.child = y.parent where x.parent = 'r1')"


@query("select 'r1' as node")
def contract_minimal(b):
    return beliefs.contract(_support(b), "r1", "minimal")


@query(f"{_SUP} select 'r1' as node union all select child from d")
def contract_full_cascade(b):
    return beliefs.contract(_support(b), "r1", "full_cascade")


@query(f"{_SUP} select 'r1' as node union all select child from d where child not in (select child from s where parent = 'r4')")
def contract_entrenchment(b):
    return beliefs.contract(_support(b), "r1", "entrenchment")


@query("select doc_id as id from documents where doc_id not in (select doc_id from labels where quality = 1)")
def ungrounded_nodes(b):
    return beliefs.ungrounded(b.documents.select(F.col("doc_id").alias("id")), b.labels.where("quality = 1").select(F.col("doc_id").alias("child")))


@query("select distinct l_suppkey as parent, l_partkey as child from lineitem where l_suppkey not in (select s_suppkey from supplier where s_suppkey % 4 <> 0) or l_partkey not in (select p_partkey from part where p_partkey % 3 <> 0)")
def orphan_edges(b):
    nodes = b.part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"))
    edges = b.calls.select(F.concat(F.lit("s"), "src").alias("parent"), F.col("dst").cast("string").alias("child"))
    evidence = b.supplier.where("s_suppkey % 4 <> 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    bad = beliefs.orphan_edges(edges, nodes.select(F.col("id").cast("string")), evidence)
    return bad.select(F.substr("parent", F.lit(2)).cast("long").alias("parent"), F.col("child").cast("long").alias("child"))


_MODE = "case when id % 10 = 0 then 'type_mismatch' when id % 10 in (1, 2, 3) then 'precondition_violation' when id % 10 in (4, 5, 8) then 'postcondition_violation' when id % 10 in (6, 7) then 'invariant_violation' else 'unknown' end"


@query(f"{_with('msg')} select id, message, {_MODE} as mode from msg")
def failure_classify(b):
    return b.messages.select("id", "message", o.failure_mode(F.col("message")).alias("mode"))


@query(f"""{_with("msg")}, t as (select id, {_MODE} as mode, passing, passing / 3 as mutation from msg)
select id, passing >= 0.5 and passing - mutation > 0.3 as is_overfit, passing < 0.5 as is_underfit,
case when mode <> 'unknown' then mode when passing >= 0.5 and passing - mutation > 0.3 then 'overfitting' when passing < 0.5 then 'underfitting' when passing < 0.8 then 'semantic_drift' else 'unknown' end as mode from t""")
def over_under_fit(b):
    p, m = F.col("passing"), F.col("passing") / 3
    return b.messages.select("id", o.is_overfit(p, m).alias("is_overfit"), o.is_underfit(p).alias("is_underfit"), o.failure_full(F.col("message"), p, m)["mode"].alias("mode"))


@query(f"{_with('mutants')}, t as (select file_path, {_TALLY} from mutants group by file_path), u as (select *, {_SCORE} from t) select file_path, case when no_coverage > killed + survived then 'mutation_no_coverage' when mutation_score > 0.5 then 'mutation_killed' else 'mutation_survived' end as kind from u")
def evidence_kind(b):
    return mutation.score_by_file(b.mutants).select("file_path", o.evidence_kind(F.col("killed"), F.col("survived"), F.col("no_coverage"), F.col("mutation_score")).alias("kind"))


@query("""with t as (select source as population, (doc_id % 9 <= 2)::int || '-' || (n_chars > 1000)::int as bin from documents), c as (select population, bin, count(*) as c from t group by all), s as (select *, c / sum(c) over (partition by population) as p from c)
select population, cast(sum(c) as bigint) as n, round(-sum(p * log2(p)), 6) as entropy from s group by population""")
def structural_entropy(b):
    flag = lambda c: c.cast("int").cast("string")
    bins = b.documents.select(F.col("source").alias("population"), F.concat_ws("-", flag(F.col("doc_id") % 9 <= 2), flag(F.col("n_chars") > 1000)).alias("bin"))
    return synthesis.entropy(bins).withColumn("entropy", F.round("entropy", 6))


def _individuals(b):
    cut = F.least(F.col("n_chars") / 1000.0, F.lit(1.0))
    rows = b.documents.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 11 != 0).alias("is_valid"), ((F.col("doc_id") % 7) / 7.0).alias("ce"), ((F.col("doc_id") % 13) / 13.0).alias("spec"), cut.alias("complexity"))
    return synthesis.fitness(rows).withColumn("fitness", F.round("fitness", 6))


_FIT = "select doc_id as id, round(case when doc_id % 11 <> 0 then 0.4 * ((doc_id % 7) / 7.0) + 0.5 * ((doc_id % 13) / 13.0) - 0.1 * least(n_chars / 1000.0, 1.0) else -1.0 end, 6)::double as fitness from documents"


@query(f"{_FIT} order by fitness desc, id limit 25")
def fitness_elite(b):
    return synthesis.elite(_individuals(b).select("id", "fitness"), 25)


@query()
def tournament_seeded(b):
    return synthesis.tournament(_individuals(b), 20, 3, 7)


_VERDICT = "select c_custkey as request, t as tier, case when (c_custkey + t) % 5 = 0 then 'counterexample' when (c_custkey * t) % 7 = 3 then 'verified' when (c_custkey + 2 * t) % 11 = 0 then 'error' else 'unknown' end as status, c_custkey % 2 = 0 as spurious from customer, range(1, 4) x(t)"


@query(f"""with v as ({_VERDICT}), d as (select *, status in ('verified', 'error') or (status = 'counterexample' and not spurious) as decisive from v)
select request, coalesce(arg_min(status, tier) filter (where decisive), 'bounded_safe') as status, cast(coalesce(min(tier) filter (where decisive), max(tier)) as bigint) as tier from d group by request""")
def cegar_first_decisive(b):
    t, k = F.col("tier"), F.col("c_custkey")
    rows = b.customer.select("c_custkey", F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)])).alias("tier"))
    status = F.when((k + t) % 5 == 0, "counterexample").when((k * t) % 7 == 3, "verified").when((k + 2 * t) % 11 == 0, "error").otherwise("unknown")
    return synthesis.first_decisive(rows.select(k.alias("request"), "tier", status.alias("status"), (k % 2 == 0).alias("spurious")))


# fixed values: file extensions and telling config files by language
EXTENSIONS = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".jsx": "javascript", ".java": "java",
    ".kt": "kotlin", ".rs": "rust", ".go": "go", ".rb": "ruby", ".cs": "csharp", ".cpp": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp", ".swift": "swift", ".php": "php", ".scala": "scala",
}
CONFIGS = {
    "pyproject.toml": "python", "setup.py": "python", "setup.cfg": "python", "requirements.txt": "python", "Pipfile": "python", "poetry.lock": "python", "package.json": "javascript",
    "tsconfig.json": "typescript", "package-lock.json": "javascript", "yarn.lock": "javascript", "pnpm-lock.yaml": "javascript", "Cargo.toml": "rust", "go.mod": "go", "go.sum": "go",
    "pom.xml": "java", "build.gradle": "java", "build.gradle.kts": "kotlin", "Gemfile": "ruby", "Gemfile.lock": "ruby", "composer.json": "php", "build.sbt": "scala", "Package.swift": "swift",
}


def language_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(list(EXTENSIONS.items()), "ext string, language string"), spark.createDataFrame(list(CONFIGS.items()), "name string, language string")


_FILES = "select user_id as project, (['src/a.py', 'lib/b.js', 'package.json', 'x/y/C.java', 'setup.py', 'README', 'm.test.ts'])[cast(event_id % 7 as int) + 1] as path from events"


def _files(b):
    paths = ["src/a.py", "lib/b.js", "package.json", "x/y/C.java", "setup.py", "README", "m.test.ts"]
    return b.events.select(F.col("user_id").alias("project"), F.get(F.array(*map(F.lit, paths)), (F.col("event_id") % 7).cast("int")).alias("path"))


@query(f"""with f as ({_FILES}), e as (select project, case path when 'src/a.py' then 'python' when 'setup.py' then 'python' when 'lib/b.js' then 'javascript' when 'x/y/C.java' then 'java' when 'm.test.ts' then 'typescript' end as language, 1 as w from f),
c as (select distinct project, case path when 'package.json' then 'javascript' when 'setup.py' then 'python' end as language, 50 as w from f), t as (select project, language, cast(sum(w) as bigint) as weight from (select * from e union all select * from c) where language is not null group by all)
select project, language, weight, round(weight / sum(weight) over (partition by project), 6) as share, row_number() over (partition by project order by weight desc, language) as rank from t""")
def language_detect(b):
    return tables.detect_languages(_files(b), *language_tables(b.spark)).withColumn("share", F.round("share", 6))


_SIGNALS = [("stryker", "package.json", 0.8, 1), ("stryker", "lib/b.js", 0.7, 2), ("mutmut", "setup.py", 0.95, 1), ("mutmut", "src/a.py", 0.8, 2), ("poodle", "README", 0.9, 1)]


@query(f"with f as ({_FILES}), s(framework, path, confidence, ordinal) as (values {', '.join(map(str, _SIGNALS))}) select distinct project, framework, confidence::double as confidence, path from f join s using (path) qualify row_number() over (partition by project, framework order by ordinal) = 1")
def framework_detect(b):
    return tables.detect_frameworks(_files(b), b.spark.createDataFrame(_SIGNALS, "framework string, path string, confidence double, ordinal int"))


@query("select user_id, count(*) as n, cast(sum(event_id % 9) as bigint) as passed, cast(sum(event_id % 4) as bigint) as failed, cast(sum(case when event_id % 4 > 0 then 1 else 0 end) as bigint) as named from events group by user_id")
def test_output_parse(b):
    out = F.concat(F.lit("Tests run: "), F.lit("99, Passed: "), F.col("event_id") % 9, F.lit(", Failed: "), F.col("event_id") % 4, F.when(F.col("event_id") % 4 > 0, "\nFailed mod.test_a\nok").otherwise("\nok"))
    t = b.events.select("user_id", o.test_totals(out).alias("t"), F.filter(o.failing_tests(out), lambda s: s.startswith("mod.")).alias("names"))
    return t.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("t.passed").alias("passed"), F.sum("t.failed").alias("failed"), F.sum(F.size("names")).alias("named"))


@query(f"{_with('pairs', 'g', 'nodes')} select (select count(*) from nodes) as n_nodes, (select count(*) from g) as n_edges")
def graph_stats(b):
    return b.g_nodes.agg(F.count("*").alias("n_nodes")).crossJoin(b.g.agg(F.count("*").alias("n_edges")))  # one row each


_SOURCE = "import os\nfrom .util import helper\nclass A(Base):\n    def run(self):\n        self.stop()\n        return helper(len(os.name))\n    def stop(self):\n        pass\ndef main():\n    a = A()\n    a.run()\n"


def _sources(b):
    return b.part.select(F.concat(F.lit("pkg/m"), "p_partkey", F.lit(".py")).alias("path"), F.lit(_SOURCE).alias("source"))


_CALLED = "[('defines', '.A', 1.0, 3, ''), ('inherits', 'Base', 0.8, 3, '.A'), ('defines', '.A.run', 1.0, 4, '.A'), ('calls', '.A.stop', 0.9, 5, '.A.run'), ('calls', 'helper', 0.5, 6, '.A.run'), ('calls', 'builtins.len', 1.0, 6, '.A.run'), ('defines', '.A.stop', 1.0, 7, '.A'), ('defines', '.main', 1.0, 9, ''), ('calls', '.A', 1.0, 10, '.main'), ('calls', '.A.run', 0.8, 11, '.main')]"


@query(f"""with t(kind, target, confidence, line, scope) as (values {_CALLED[1:-1]})
select 'pkg/m' || p_partkey || '.py' as path, 'pkg.m' || p_partkey || scope as source_id, case when target like '.%' then 'pkg.m' || p_partkey || target else target end as target_id, kind, confidence::double as confidence, line::bigint as line from part, t""")
def ast_call_edges(b):
    return code.call_edges(_sources(b))


@query("select 'pkg/m' || p_partkey || '.py' as path, t.* from part, (values ('os', 'os', 0), ('pkg.util.helper', 'pkg.util', 1)) t(target, module, lvl)")
def import_edges(b):
    found = code.imports(_sources(b))
    module = o.relative_import(F.col("importer"), F.col("level"), F.col("module"))
    return found.select("path", F.concat_ws(".", module, "name").alias("target"), module.alias("module"), F.col("level").alias("lvl"))


@query("select c_custkey as request, case when c_custkey % 50 + 1 > c_custkey % 60 - 1 then 'no_ce' else 'counterexample' end as status, case when c_custkey % 50 + 1 > c_custkey % 60 - 1 then '' else 'x=' || (c_custkey % 50 + 1) end as model from customer")
def bounded_verification(b):
    k = F.col("c_custkey")
    limits = F.array(F.concat(F.lit("x > "), k % 50), F.concat(F.lit("x < "), k % 60))
    return verification.solve(b.customer.select(k.alias("request"), limits.alias("constraints"))).select("request", "status", "model")


# a text of as many nested ifs as p_size % 5, with p_size % 4 sums of a name of its own; otherwise no program
_NESTED, _SUMS = "p_size % 5", "p_size % 4"


@query(f"""with p as (select p_partkey, p_size % 7 <> 0 as is_valid, {_NESTED} as k, {_SUMS} as m from part),
f as (select *, case when is_valid then k else 0 end as branch_count,
case when is_valid then 1 + m + (k > 0)::int else 0 end as var_count from p) select p_partkey, is_valid, branch_count::bigint as branch_count, var_count::bigint as var_count from f""")
def program_features(b):
    k, m = F.expr(_NESTED), F.expr(_SUMS)
    ifs = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.concat(F.repeat(F.lit(" "), i), F.lit("if a:\n"))), ""))
    sums = F.array_join(F.transform(F.sequence(F.lit(1), m), lambda i: F.concat(F.lit(" + v"), i.cast("string"))), "")
    head = F.when(k > 0, ifs).otherwise("")
    text = F.concat(head, F.expr(f"repeat(' ', {_NESTED})"), F.lit("z = 1"), F.when(m > 0, sums).otherwise(""), F.lit("\n"))
    rows = b.part.select("p_partkey", programs.features(F.when(F.expr("p_size % 7 <> 0"), text).otherwise("def f(:")).alias("f"))
    return rows.select("p_partkey", "f.is_valid", "f.branch_count", "f.var_count")


@query(f"{_with('pairs', 'g', 'nodes')}, i as (select * from g where src % 14 = dst % 14), e as (select * from i where src <> dst), f as (select id % 14 as part, id, id not in (select dst from e) as enters, id not in (select src from e) as leaves from nodes), s as (select part, bool_or(enters) as some_entry, bool_or(leaves) as some_exit from f group by part) select src % 14 as part, src::varchar as src, dst::varchar as dst from i union all select part, '__source_' || part, id::varchar from f join s using (part) where enters or not some_entry union all select part, id::varchar, '__sink_' || part from f join s using (part) where leaves or not some_exit")
def augmented_graph(b):
    return graph.augmented(b.g, b.g_nodes.select("id", (F.col("id") % 14).alias("part")))


@query(f"{_COMP}, n as (select component, count(*) as n from k group by component), p as (select distinct least(src, dst) as a, greatest(src, dst) as b from g where src <> dst), m as (select component, count(*) as m from p join k on p.a = k.id group by component) select component, n, coalesce(m, 0) as m, case when n <= 4 or coalesce(m, 0) < n then 'planar' when m > 3 * n - 6 then 'nonplanar' else 'unknown' end as verdict from n left join m using (component)")
def planarity_bound(b):
    return graph.maybe_planar(b.g_nodes, b.g)


@query()
def partition_hierarchy(b):
    return graph.hierarchy(b.g_nodes, b.g.withColumn("confidence", F.lit(1.0)))


@query()
def fiedler_partition(b):
    edges = b.g.withColumn("confidence", F.lit(1.0))
    return graph.fiedler_partition(b.g_nodes, edges)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
