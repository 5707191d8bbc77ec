"""Queries over the design graph that the driver tables stand for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import identifiers, is_reset, label, names, node_kind, node_name
from ..operators import bounded, clocks, lint, link, metrics, summaries, traverse
from ..operators.components import connected_components
from ..sources.bridge import ORACLE, graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


_steps_only = ("module",), ("declares", "instantiates")
_clocked = ("process",), ("clocked_by", "drives", "reads", "aliases")
#: The kinds of nodes and edges that a query looks at, where not all.
LOOKS_AT: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "q01_find_module": (("module", "port", "parameter"), ("declares", "instantiates")),
    "q02_top_modules": (("module",), ("instantiates",)),
    "q02_hierarchy": _steps_only,
    "q03_who_instantiates": (("module", "instance"), ("instantiates",)),
    "q04_port_map": (("module", "port"), ("declares",)),
    "q04_bindings": (("port",), ("connects",)),
    "q05_impact": (("module",), ("declares", "instantiates", "imports", "extends")),
    "q05_impact_summary": (("module",), ("declares", "instantiates", "imports", "extends")),
    "trv07_net_aliases": (("module",), ("aliases",)),
    "q06_clock_domains": _clocked,
    "q06_crossings": _clocked,
    "q06_crossing_counts": _clocked,
    "trv08_bridges": _clocked,
    "trv10_safe_crossings": _clocked,
    "ag05_domain_signals": _clocked,
    "q07_reset_tree": (("process",), ("resets", "aliases")),
    "ag07_alias_collapse": (("signal",), ("declares",)),
    "q08_signal_drivers": (("signal", "port", "process"), ("drives",)),
    "q08_signal_readers": (("signal", "port", "process"), ("reads",)),
    "q09_uvm_topology": (("class",), ("extends",)),
    "q11_search_nodes": (("module", "signal"), ("extends",)),
    "q13_modules": (("module",), ("instantiates",)),
    "q14_lint": (("module", "port", "parameter", "instance", "signal"), ("instantiates", "connects", "declares", "drives", "reads", "parameterizes")),
    "q14_waivers": (("module", "port", "parameter", "instance", "signal"), ("instantiates", "connects", "declares", "drives", "reads", "parameterizes")),
    "q15_fan": _steps_only,
    "q15_betweenness": _steps_only,
    "q15_articulation": _steps_only,
    "q15_communities": _steps_only,
    "ag10_projection": _steps_only,
    "sl05_metrics_top": _steps_only,
    "ag15_nearest_ranks": _steps_only,
    "sl01_envelope": (("module",), ("extends",)),
    "wn09_strided_sample": (("module",), ("extends",)),
    "q20_qualified_names": ((), ("instantiates",)),
    "jn18_process_edges": (("process",), ("drives", "reads", "declares")),
    "prj09_json": (("port",), ("extends",)),
    "ag20_delta_counters": (("port",), ("drives",)),
    "ag15_percentiles": _steps_only,
    "ag17_rollup": _steps_only,
    "ag18_most_instantiated": _steps_only,
    "trv02_subtree": _steps_only,
    "trv06_enclosing_unit": (("module",), ("declares",)),
    "trv11_clock_evidence": (("port",), ("clocked_by",)),
    "trv18_unit_membership": (("module", "port", "parameter", "process"), ("declares",)),
    "jn11_positional": (("port",), ("declares", "instantiates")),
    "jn12_derived_dataflow": (("port",), ("connects",)),
    "jn13_constraints": (("signal",), ("aliases",)),
    "txt20_identifiers": (("module",), ("connects",)),
    "fn_sorted_names": (("module",), ("drives", "reads")),
    "ag22_multiset": (("module",), ("drives", "reads", "connects")),
}


def query(oracle: str | None = None, before: str = ""):
    """Register a query of (nodes, edges) under its name, and its SQL over the relations of those names."""

    def add(f: Callable[[DataFrame, DataFrame], DataFrame]):
        n, e = LOOKS_AT.get(f.__name__, ((), ()))
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*graph(spark, sf_dir, n, e))
        if oracle is not None:
            ORACLE_SQL[f.__name__] = ORACLE + before + oracle
        return f

    return add


#: From the tables themselves, without the graph between.
_modules = """select 'nation::module:' || n_nationkey as id, 'module' as kind, 'nation_' || n_nationkey as name, 'rtl/nation.sv' as file, cast(n_nationkey as int) as line, 'systemverilog' as language, cast(0 as bigint) as port_count, cast(0 as bigint) as parameter_count, cast(1 as bigint) as instantiation_count from nation where n_nationkey = 3
union all select 'orders::module:' || o_orderkey, 'module', 'order_' || o_orderkey, 'rtl/orders.sv', cast(o_orderkey as int), 'systemverilog', 0, 0, 1 from orders where o_orderkey = 7
union all select 'part::module:' || p_partkey, 'module', 'part_' || p_partkey, 'rtl/part.vhd', cast(p_partkey as int), 'vhdl', 2, 1, coalesce(uses, 0) from part left join (select l_partkey, count(*) as uses from lineitem where l_partkey in (7, 9) group by 1) on l_partkey = p_partkey where p_partkey in (7, 9)"""


def plain_query(oracle: str):
    """Like ``query``, with SQL over the tables instead of the graph."""

    def add(f: Callable[[DataFrame, DataFrame], DataFrame]):
        query()(f)
        ORACLE_SQL[f.__name__] = oracle
        return f

    return add


@plain_query(_modules)
def q01_find_module(n, e):
    return bounded.find_module(n, e, ["nation_3", "PART_7", "part_9", "order_7", "NATION_4"])


@query("select id, name, file, kind from nodes where kind = 'module' and id not in (select dst from edges where kind = 'instantiates')")
def q02_top_modules(n, e):
    return bounded.top_modules(n, e)


_steps = "steps as (select d.src as parent, d.dst as inst, i.dst as target, i.confidence from edges d join edges i on d.dst = i.src where d.kind = 'declares' and i.kind = 'instantiates')"


@query(
    f", {_steps}, h as (select 0 as depth, 'region::module:1' as unit, cast(null as varchar) as inst, cast(1.0 as double) as confidence, ['region::module:1'] as path union all select depth + 1, s.target, s.inst, s.confidence, list_append(path, s.target) from h join steps s on h.unit = s.parent where depth < 3 and not list_contains(path, s.target)) select depth, unit, inst, confidence from h"
)
def q02_hierarchy(n, e):
    return traverse.hierarchy(e, "region::module:1", 3)


@query("select n.id as instance_id, n.name as instance_name, n.qualified_name, n.file, n.line, i.confidence, false as target_unresolved from nodes n join edges i on n.id = i.src where n.kind = 'instance' and i.kind = 'instantiates' and i.dst = 'part::module:7'")
def q03_who_instantiates(n, e):
    return bounded.who_instantiates(n, e, "PART_7")


@query("select d.src as unit_id, p.id, p.name, p.idx, p.line, p.direction, row_number() over (partition by d.src order by p.idx nulls last, p.line, p.name, p.id) as place from nodes p join edges d on p.id = d.dst where p.kind = 'port' and d.kind = 'declares' and d.src = 'part::module:7'")
def q04_port_map(n, e):
    return bounded.port_map(n, e, "part_7")


@query("select p.name as port, c.expr_text as actual, p.idx as position, c.confidence, p.line from edges c join nodes p on c.dst = p.id where c.kind = 'connects' and p.kind = 'port' and c.src = (select min(src) from edges where kind = 'connects')")
def q04_bindings(n, e):
    first = e.where("kind = 'connects'").agg(F.min("src").alias("s")).first()["s"]
    return bounded.bindings(n, e, first)


_impact = "links as (select distinct target as src, parent as dst from steps union select dst, src from edges where kind in ('imports', 'extends', 'uses_package', 'binds'))"


@query(f", {_steps}, {_impact}, r as (select 'part::module:7' as id, 0 as depth union select l.dst, r.depth + 1 from r join links l on r.id = l.src where r.depth < 8) select id, min(depth) as depth from r group by id having min(depth) > 0")
def q05_impact(n, e):
    return traverse.impact(e, e.sparkSession.range(1).select(F.lit("part::module:7").alias("id")), 8).select("id", "depth")


@query(f", {_steps}, {_impact}, r as (select id, 0 as depth from nodes where kind = 'module' and name in ('part_7', 'part_8', 'order_3') union select l.dst, r.depth + 1 from r join links l on r.id = l.src where r.depth < 8), b as (select id, min(depth) as depth from r group by id having min(depth) > 0) select split_part(id, ':', 1) as family, count(*) as affected, max(depth) as max_depth from b group by 1")
def q05_impact_summary(n, e):
    seeds = n.where((F.col("kind") == "module") & F.col("name").isin("part_7", "part_8", "order_3")).select("id")
    return traverse.impact(e, seeds, 8).groupBy(F.split_part("id", F.lit(":"), F.lit(1)).alias("family")).agg(F.count("*").alias("affected"), F.max("depth").alias("max_depth"))


_roots = "al as (select src as a, dst as b from edges where kind = 'aliases' union select dst, src from edges where kind = 'aliases'), cc as (select a as net, a as o from al union select cc.net, al.b from cc join al on cc.o = al.a), roots as (select net, min(o) as root from cc group by net)"


@query(f", {_roots} select net as node, root as component from roots")
def trv07_net_aliases(n, e):
    return connected_components(e.where("kind = 'aliases'").select("src", "dst"))


@query(f", {_roots} select coalesce(root, dst) as root, count(distinct src) as process_count, min(confidence) as min_confidence, count(distinct dst) as net_count from edges left join roots on dst = net where kind = 'clocked_by' group by 1")
def q06_clock_domains(n, e):
    return clocks.clock_domains(e, clocks.roots(e))


_pd = "pd as (select src as p, min(coalesce(root, dst)) as domain, max(confidence) as conf from edges left join roots on dst = net where kind = 'clocked_by' group by src having min(coalesce(root, dst)) = max(coalesce(root, dst)))"
_cross = f"{_roots}, {_pd}, dr as (select d.dst as signal, pd.domain, least(d.confidence, conf) as c, d.src as driver from edges d join pd on d.src = pd.p where d.kind = 'drives'), best as (select signal, domain, max(c) as dc from dr group by 1, 2), bd as (select best.signal, best.domain, dc, min(driver) as driver_id from best join dr on best.signal = dr.signal and best.domain = dr.domain and dc = c group by 1, 2, 3), rd as (select dst as signal, src as reader_id, pd.domain, max(least(confidence, conf)) as rc from edges join pd on src = p where kind = 'reads' group by 1, 2, 3), crossings as (select rd.signal as signal_id, driver_id, bd.domain as driver_domain, reader_id, rd.domain as reader_domain, least(dc, rc) as confidence from rd join bd on rd.signal = bd.signal where rd.domain <> bd.domain)"


@query(f", {_cross} select * from crossings")
def q06_crossings(n, e):
    return clocks.crossings(e, clocks.roots(e))


@query(f", {_cross} select driver_domain, reader_domain, count(*) as n, min(confidence) as min_confidence, count(distinct signal_id) as signals from crossings group by 1, 2")
def q06_crossing_counts(n, e):
    return clocks.crossing_counts(e, clocks.roots(e))


@query(f", {_roots}, {_pd} select o.dst as signal_id, s.domain as via_domain, count(distinct o.src) as bridges from edges o join (select distinct r.src as p, d.domain from edges r join nodes n on n.id = r.src and n.combinational join (select distinct dst, domain from edges join pd on src = p where kind = 'drives') d on r.dst = d.dst where r.kind = 'reads') s on o.src = s.p where o.kind = 'drives' group by 1, 2")
def trv08_bridges(n, e):
    return clocks.bridged(n, e, clocks.roots(e))


@query(f", {_roots} select c.domain, count(distinct d.dst) as signal_count from (select distinct src as p, coalesce(root, dst) as domain from edges left join roots on dst = net where kind = 'clocked_by') c join edges d on d.src = c.p where d.kind = 'drives' group by 1")
def ag05_domain_signals(n, e):
    return clocks.domain_signals(e, clocks.roots(e))


@query(f", {_roots} select coalesce(root, dst) as root, count(distinct src) as process_count, bool_or(is_async) as is_async, min(confidence) as min_confidence from edges left join roots on dst = net where kind = 'resets' group by 1")
def q07_reset_tree(n, e):
    return clocks.reset_tree(e, clocks.roots(e))


#: Customers' clock ports are bound to one net of five for each of their orders; nations' nets 0 to 9 to their region's.
_bound = """with p as (select distinct o_custkey as c, (o_orderkey % 5) + 5 * (o_custkey % 5) as net from orders),
q as (select c, count(*) as nets, count(distinct case when net < 10 then 'r' || n_regionkey else 'n' || net end) as known from p join nation on n_nationkey = net group by c),
r as (select c % 5 < 2 as low, c % 5 as k, min('customer::port:' || c) as least from p group by 1, 2)
select (select min(least) from r where case when q.c % 5 < 2 then low else k = q.c % 5 end) as root, 'customer::port:' || c as formal, nets from q where nets > 1 and known > 1 and c % 5 < 3"""


@plain_query(_bound)
def ag07_alias_collapse(n, e):
    key = lambda c: F.element_at(F.split(c, ":"), -1)
    held = e.where("kind = 'declares'")
    c, o = key("src").cast("long"), key("dst").cast("long")
    name = F.concat(F.lit("Clk_N"), (o % 5 + 5 * (c % 5)).cast("string"))
    wired = held.where(F.col("dst").startswith("orders::instance:")).select(F.lit("top").alias("scope"), F.col("dst").alias("inst"), F.concat(F.lit("customer::port:"), key("src")).alias("formal"), name.alias("expr_text"))
    nets = n.where("kind = 'signal' and id like 'nation::net:%'").select(F.lit("top").alias("scope"), "id", "name")
    up = held.where(F.col("dst").startswith("nation::instance:") & (o < 10)).select(F.concat(F.lit("nation::net:"), key("dst")).alias("formal"), F.concat(F.lit("region::net:"), key("src")).alias("actual"))
    pairs = clocks.alias_pairs(wired, nets).unionByName(up)
    clocked = connected_components(pairs, "formal", "actual").where(F.col("node").startswith("nation::net:") & (key("node").cast("long") < 15))
    return clocks.collapses(pairs, clocked.select(F.col("component").alias("root")))


_site = "select s.id as signal_id, s.name as signal, p.id as site_id, p.qualified_name as site, p.kind as site_kind, p.file, p.line, e.confidence from edges e join nodes s on e.dst = s.id join nodes p on e.src = p.id where p.kind = 'process' and s.name = 's_7' and e.kind = "


@query(_site + "'drives'")
def q08_signal_drivers(n, e):
    return bounded.signal_sites(n, e, "drives", "s_7")


@query(_site + "'reads'")
def q08_signal_readers(n, e):
    return bounded.signal_sites(n, e, "reads", "s_7")


_chain = "ch as (select src as id, dst as base, 1 as hops from edges where kind = 'extends' union all select ch.id, e.dst, hops + 1 from ch join edges e on ch.base = e.src and e.kind = 'extends'), top as (select id, max(hops) as hops, arg_max(base, hops) as base from ch group by id)"


@query(f", {_chain} select id, base, hops, case when base like '%uvm_driver' then 'driver' when base like '%uvm_monitor' then 'monitor' when base like '%uvm_test' then 'test' else 'other' end as role from top")
def q09_uvm_topology(n, e):
    return traverse.chains(e).withColumn("role", traverse.role())


@query("select id, kind, name, qualified_name, file, line, language, unresolved from nodes where kind in ('module', 'signal') and name like 's%' and regexp_matches(name, '^s[a-z_]*[0-4]$')")
def q11_search_nodes(n, e):
    return bounded.search(n, "s*[0-4]", ("module", "signal")).where(F.col("name").rlike("^s[a-z_]*[0-4]$"))


@query("select dst as id, count(*) as referrers, min(src) as first_referrer from edges where kind <> 'declares' and dst not in (select id from nodes) group by dst")
def q12_unresolved(n, e):
    return bounded.unresolved(n, e)


@query("select n.name, n.kind, n.file, n.line, coalesce(u.uses, 0) as instances from nodes n left join (select dst, count(*) as uses from edges where kind = 'instantiates' group by dst) u on u.dst = n.id where n.kind = 'module'")
def q13_modules(n, e):
    return bounded.modules(n, e)


_lint = """lint as (
select 'unconnected-port' as "check", t.inst as node_id, p.name, s.file, s.line, 1.0 as confidence from (select src as inst, min(dst) as unit from edges where kind = 'instantiates' group by src having count(*) = 1) t
 join edges d on d.src = t.unit and d.kind = 'declares' join nodes p on p.id = d.dst and p.kind = 'port' join nodes s on s.id = t.inst
 where t.inst in (select src from edges where kind = 'connects') and not exists (select 1 from edges c where c.kind = 'connects' and c.src = t.inst and c.dst = p.id)
union all select 'open-port', e.src, p.name, s.file, s.line, 1.0 from edges e join nodes p on p.id = e.dst and p.kind = 'port' join nodes s on s.id = e.src and s.kind = 'instance' where e.kind = 'connects' and lower(trim(coalesce(e.expr_text, ''))) in ('', 'open')
union all select 'undriven-signal', id, name, file, line, 1.0 from nodes where (kind = 'signal' or kind = 'port' and direction = 'output') and id not in (select dst from edges where kind = 'drives')
union all select 'unread-signal', id, name, file, line, 1.0 from nodes where kind = 'signal' and id not in (select dst from edges where kind = 'reads')
union all select 'dead-module', id, name, file, line, 0.4 from nodes where kind = 'module' and name not in ('region_0') and id not in (select dst from edges where kind = 'instantiates')
union all select 'redundant-override', e.src, p.name, s.file, s.line, 1.0 from edges e join nodes p on p.id = e.dst and p.kind = 'parameter' join nodes s on s.id = e.src where e.kind = 'parameterizes' and trim(e.value_text) = trim(p.default_value))"""


@query(f", {_lint} select \"check\", node_id, name, file, line, cast(confidence as double) as confidence from lint")
def q14_lint(n, e):
    return lint.run(n, e, tops=("region_0",))


WAIVERS = [{"check": "open-port", "line": 1}, {"check": "dead-module", "name": "supplier_1*"}, {"file": "rtl/pkg.*", "name": "s_[0-9]"}]


@query(f", {_lint} select \"check\", case when \"check\" = 'open-port' and line = 1 then 0 when \"check\" = 'dead-module' and name like 'supplier\\_1%' escape '\\' then 1 when file like 'rtl/pkg.%' and regexp_matches(name, '^s_[0-9]$') then 2 end as waived_by, count(*) as n from lint group by 1, 2")
def q14_waivers(n, e):
    return lint.waive(lint.run(n, e, tops=("region_0",)), WAIVERS).groupBy("check", "waived_by").agg(F.count("*").alias("n"))


@query(f", {_steps}, pr as (select parent, target, count(*) as weight from steps group by 1, 2), ends as (select parent as unit, 0 as i, weight as o from pr union all select target, weight, 0 from pr) select unit, cast(sum(i) as bigint) as fan_in, cast(sum(o) as bigint) as fan_out from ends group by unit")
def q15_fan(n, e):
    return bounded.fan(bounded.projection(n, e))


@query()
def q15_betweenness(n, e):
    return metrics.betweenness(bounded.projection(n, e)).withColumn("betweenness", F.round("betweenness", 9))


@query()
def q15_articulation(n, e):
    return metrics.articulation_points(bounded.projection(n, e))


@query()
def q15_communities(n, e):
    return metrics.communities(bounded.projection(n, e)).groupBy("community").agg(F.count("*").alias("units"))


@query("select kind, count(*) as n from nodes group by 1")
def ag01_node_kinds(n, e):
    return bounded.histogram(n)


@query("select kind, count(*) as n from edges group by 1")
def ag01_edge_kinds(n, e):
    return bounded.histogram(e)


@query("select case confidence when 1.0 then '1' when 0.8 then '0.8' when 0.6 then '0.6' when 0.4 then '0.4' end as confidence, count(*) as n from edges group by 1")
def ag02_confidence(n, e):
    return bounded.confidence_distribution(e)


@query(f", {_steps} select parent, target, count(*) as weight from steps group by 1, 2")
def ag10_projection(n, e):
    return bounded.projection(n, e)


@query("select split_part(dst, ':', 1) as family, quantile_disc(c, 0.5) as p50, max(c) as max, count(*) as n from (select dst, count(*) as c from edges where kind = 'instantiates' group by dst) group by 1")
def ag15_percentiles(n, e):
    uses = bounded.instance_counts(e).withColumn("family", F.split_part("unit", F.lit(":"), F.lit(1)))
    return uses.groupBy("family").agg(F.expr("percentile_disc(0.5) within group (order by instances)").cast("long").alias("p50"), F.max("instances").alias("max"), F.count("*").alias("n"))


@query("select dst as unit, count(*) as instances from edges where kind = 'instantiates' group by 1 order by 2 desc, 1 limit 10")
def ag18_most_instantiated(n, e):
    return bounded.ranked(bounded.instance_counts(e), "instances", "unit", 10)


@query("select (select count(*) from nodes) as nodes, (select count(*) from edges) as edges, (select count(distinct dst) from edges where kind <> 'declares' and dst not in (select id from nodes)) as unresolved")
def ag21_graph_counts(n, e):
    a = n.agg(F.count("*").alias("nodes"))
    b = e.agg(F.count("*").alias("edges"))
    c = bounded.missing_targets(n, e).agg(F.count("*").alias("unresolved"))
    one = [x.withColumn("k", F.lit(1)) for x in (a, b, c)]
    return one[0].join(one[1], "k").join(one[2], "k").drop("k")


@query(f", {_steps}, r as (select 'region::module:2' as id, 0 as depth union select s.target, depth + 1 from r join steps s on r.id = s.parent where depth < 3) select id, min(depth) as depth from r group by id")
def trv02_subtree(n, e):
    return traverse.subtree(e, "region::module:2", 3).select("id", "depth")


@query("select d.dst as id, d.src as unit from edges d join nodes n on n.id = d.dst where d.kind = 'declares'")
def trv06_enclosing_unit(n, e):
    parents = e.where("kind = 'declares'").select(F.col("dst").alias("id"), F.col("src").alias("parent"))
    return traverse.enclosing(parents, n.where("kind = 'module'"))


@query("select name, language, kind, split_part(id, '::', 1) as family from nodes where kind = 'port'")
def prj_node_ids(n, e):
    ports = n.where("kind = 'port'")
    return ports.select("name", "language", node_kind(F.col("id")).alias("kind"), F.split_part("id", F.lit("::"), F.lit(1)).alias("family")).where(node_name(F.col("id")).isNotNull())


#: Names by place, and which of them are resets.
NET_NAMES = ("rst_ni", "clk_i", "reset_n", "aclr", "rst_count", "core_rst_n_i", "crystal_en", "clear_b", "rsti", "wr_rst_sync_n")


@query("select coalesce(nullif(qualified_name, ''), name) as label, line % 10 in (0, 2, 5, 7, 9) as reset from nodes where kind = 'signal'")
def prj07_labels(n, e):
    named = F.concat_ws("_", F.col("name"), F.element_at(F.array(*map(F.lit, NET_NAMES)), F.col("line") % 10 + 1))
    return n.where("kind = 'signal'").select(label(F.col("qualified_name"), F.col("name")).alias("label"), is_reset(named).alias("reset"))


@query("select expr_text as ident, count(*) as n from edges where kind = 'connects' and expr_text <> '' group by 1")
def txt20_identifiers(n, e):
    return e.where("kind = 'connects'").select(F.explode(identifiers(F.col("expr_text"))).alias("ident")).groupBy("ident").agg(F.count("*").alias("n"))


@query("select i.src as inst, i.dst as unit, p.position, coalesce(q.id, i.dst) as dst, case when q.id is null then 0.6 else 1.0 end as confidence from edges i cross join (select 0 as position union all select 1 union all select 2) p left join (select d.src as unit, n.id, row_number() over (partition by d.src order by coalesce(n.idx, 0), n.id) - 1 as position from nodes n join edges d on d.dst = n.id and d.kind = 'declares' where n.kind = 'port') q on q.unit = i.dst and q.position = p.position where i.kind = 'instantiates' and i.dst like 'part::%'")
def jn11_positional(n, e):
    inst = e.where((F.col("kind") == "instantiates") & F.col("dst").startswith("part::")).select(F.col("src").alias("inst"), F.col("dst").alias("unit"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("position"))
    held = e.where("kind = 'declares'").select(F.col("src").alias("unit"), F.col("dst").alias("port"))
    ports = n.where("kind = 'port'").select(F.col("id").alias("port"), "idx").join(held, "port")
    return link.bind_positional(inst, ports)


@query("select c.src as inst, c.expr_text as ident, case p.direction when 'input' then 'reads' else 'drives' end as kind, cast(1.0 as double) as confidence from edges c join nodes p on p.id = c.dst where c.kind = 'connects' and c.expr_text <> ''")
def jn12_derived_dataflow(n, e):
    ports = n.where("kind = 'port'").select(F.col("id").alias("dst"), "direction")
    wired = e.where("kind = 'connects'").join(ports, "dst").select(F.col("src").alias("inst"), "direction", "expr_text")
    return link.derived_dataflow(wired).withColumn("confidence", F.col("confidence").cast("double"))


@query("select q.query, n.id, case when count(*) over (partition by q.query) > 1 then 0.6 when q.g then 0.8 else 1.0 end as confidence from nodes n join (select 'a' as query, '^clk_n1.*$' as rx, true as g union all select 'b', '^rst_r2$', false union all select 'c', '^clk_n2[0-9]$', true) q on regexp_matches(n.name, q.rx) where n.kind = 'signal'")
def jn13_constraints(n, e):
    asked = n.sparkSession.sql("select * from values ('a', 'clk_n1*'), ('b', 'rst_r2'), ('c', 'clk_n2?'), ('d', 'nothing') as q(query, pattern)")
    return link.constrain(asked, n.where("kind = 'signal'").select("id", "name")).withColumn("confidence", F.col("confidence").cast("double"))


@query("select src, string_agg(distinct confidence, ',' order by confidence) as confidences from (select src, case confidence when 1.0 then '1.0' when 0.8 then '0.8' else '0.6' end as confidence from edges where kind in ('drives', 'reads')) group by src")
def fn_sorted_names(n, e):
    uses = e.where(F.col("kind").isin("drives", "reads"))
    return uses.groupBy("src").agg(names(F.collect_set(F.col("confidence").cast("string"))).alias("confidences"))


@query("select src, dst, kind, expr_text, count(*) as n from edges where kind in ('drives', 'reads', 'connects') group by 1, 2, 3, 4")
def ag22_multiset(n, e):
    return e.where(F.col("kind").isin("drives", "reads", "connects")).groupBy("src", "dst", "kind", "expr_text").agg(F.count("*").alias("n"))


@query("select e.kind, count(*) as n from edges e where e.src in (select id from nodes where kind in ('module', 'instance')) and e.dst in (select id from nodes where kind in ('module', 'instance')) group by 1")
def prj13_induced(n, e):
    return bounded.histogram(bounded.induced(n, e, ("module", "instance"))[1])


@query(f", {_steps} select split_part(parent, ':', 1) as a, split_part(target, ':', 1) as b, count(*) as links, count(distinct parent) as parents from steps group by 1, 2")
def ag17_rollup(n, e):
    family = lambda c: F.split_part(F.col(c), F.lit(":"), F.lit(1))
    return traverse.step_edges(e).groupBy(family("parent").alias("a"), family("target").alias("b")).agg(F.count("*").alias("links"), F.countDistinct("parent").alias("parents"))


@query("select 'nodes' as section, kind as key, count(*) as n from nodes group by 2 union all select 'edges', kind, count(*) from edges group by 2 union all select 'confidence', case confidence when 1.0 then '1' when 0.8 then '0.8' when 0.6 then '0.6' else '0.4' end, count(*) from edges group by 2")
def q17_review(n, e):
    return summaries.review(n, e)


@query("select src, dst, case when kind = 'clocked_by' and dst like 'supplier::port:%' then 1.0 else confidence end as confidence, case when dst like 'supplier::port:%' and confidence < 1.0 then 'constraint' end as evidence from edges where kind = 'clocked_by'")
def trv11_clock_evidence(n, e):
    backed = n.where("kind = 'port' and name = 'clk'").select(F.col("id").alias("net"))
    return summaries.promote_clock_evidence(e.where("kind = 'clocked_by'"), backed).select("src", "dst", "confidence", "evidence")


@query(f", {_cross} select signal_id, reader_id, driver_domain, reader_domain, (least(driver_domain, reader_domain) = 'nation::net:0' and greatest(driver_domain, reader_domain) in ('nation::net:1', 'nation::net:2')) or (driver_domain = 'nation::net:3' and reader_domain = 'nation::net:4') as declared_safe from crossings")
def trv10_safe_crossings(n, e):
    spark = e.sparkSession
    groups = spark.sql("select true as asynchronous, array(array('nation::net:0'), array('nation::net:1', 'nation::net:2')) as groups")
    paths = spark.sql("select 'nation::net:3' as `from`, 'nation::net:4' as `to`")
    return summaries.mark_safe(clocks.crossings(e, clocks.roots(e)), summaries.safe_pairs(groups), paths).select("signal_id", "reader_id", "driver_domain", "reader_domain", "declared_safe")


@query("select id, unit from (select d.dst as id, d.src as unit from edges d where d.kind = 'declares') where id in (select id from nodes where kind in ('port', 'parameter', 'process'))")
def trv18_unit_membership(n, e):
    parents = e.where("kind = 'declares'").select(F.col("dst").alias("id"), F.col("src").alias("parent"))
    inner = n.where(F.col("kind").isin("port", "parameter", "process")).select("id")
    return traverse.enclosing(parents, n.where("kind = 'module'")).join(inner, "id", "left_semi")


@query(f", {_chain} select t.id as test_id, 'region::module:' || r.k as dut_id from top t cross join (select 0 as k union all select 1) r where t.base like '%uvm_test' and t.hops = 1")
def trv13_test_covers(n, e):
    """Test classes against the units below two benches made of regions."""
    ends = traverse.chains(e).withColumn("role", traverse.role()).where("role = 'test' and hops = 1").select("id")
    names = e.sparkSession.sql("select * from values ('tb::module:0', 'tb_0'), ('tb::module:1', 'x_tb') as b(id, name)")
    rest = {c: F.lit(None).cast(n.schema[c].dataType) for c in n.columns if c not in ("id", "name", "kind", "unresolved")}
    benches = names.select("id", "name", F.lit("module").alias("kind"), F.lit(False).alias("unresolved"), *(v.alias(c) for c, v in rest.items()))
    more = e.sparkSession.sql("select * from values ('tb::module:0', 'tb::instance:0', 'declares'), ('tb::instance:0', 'region::module:0', 'instantiates'), ('tb::module:1', 'tb::instance:1', 'declares'), ('tb::instance:1', 'region::module:1', 'instantiates') as b(src, dst, kind)")
    blank = {c: F.lit(None).cast(e.schema[c].dataType) for c in e.columns if c not in ("src", "dst", "kind")}
    wide = e.unionByName(more.select("src", "dst", "kind", *(v.alias(c) for c, v in blank.items())))
    covers = summaries.derive_test_covers(n.unionByName(benches), wide, ends)
    return covers.join(ends, covers.test_id == ends.id, "left_semi").select("test_id", "dut_id")


@query("select count(*) as total, cast(10 as bigint) as \"offset\", cast(25 as bigint) as \"count\", count(*) > 35 as truncated, (select string_agg(id, ',' order by line, id) from (select id, line from nodes where kind = 'module' and language = 'vhdl' order by line, id limit 25 offset 10)) as items from nodes where kind = 'module' and language = 'vhdl'")
def sl01_envelope(n, e):
    units = n.where("kind = 'module' and language = 'vhdl'").select("line", "id")
    return bounded.envelope(units, ["line", "id"], 25, 10).withColumn("items", F.array_join(F.transform("items", lambda x: x["id"]), ","))


@query("select id, coalesce(nullif(qualified_name, ''), name) as qualified_name from nodes where id in (select dst from edges where kind = 'instantiates' and src like 'customer::instance:1%')")
def q20_qualified_names(n, e):
    asked = e.where("kind = 'instantiates' and src like 'customer::instance:1%'").select("dst")
    return bounded.qualified_names(n, asked)


@query("select kind, count(*) as n from (select distinct * from edges) group by 1")
def wn03_distinct_edges(n, e):
    return bounded.histogram(bounded.distinct_edges(e))


@query("select id, line from (select id, line, row_number() over (order by id) - 1 as p, count(*) over () as n from nodes where kind = 'module' and language = 'vhdl') where p in (select floor(i * (select count(*) from nodes where kind = 'module' and language = 'vhdl') / 40.0) from range(40) t(i))")
def wn09_strided_sample(n, e):
    return bounded.strided(n.where("kind = 'module' and language = 'vhdl'").select("id", "line"), "id", 40)


@query("select id, count(*) as n from (select src as id from edges union all select dst from edges) where id not in (select id from nodes) group by 1")
def jn22_missing_ends(n, e):
    return bounded.missing_ends(n, e)


@query("select kind, count(*) as n, count(distinct src) as processes from edges where kind in ('drives', 'reads', 'declares') and src in (select id from nodes where kind = 'process') group by 1")
def jn18_process_edges(n, e):
    return clocks.of_processes(n, e, "drives", "reads", "declares").groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("src").alias("processes"))


@query(f", {_steps}, pr as (select parent, target, count(*) as weight from steps group by 1, 2), ends as (select parent as unit, 0 as i, weight as o from pr union all select target, weight, 0 from pr), fan as (select unit, cast(sum(i) as bigint) as fan_in, cast(sum(o) as bigint) as fan_out from ends group by unit) select * from fan order by fan_in desc, fan_out desc, unit limit 20")
def sl05_metrics_top(n, e):
    return metrics.top(bounded.fan(bounded.projection(n, e)), 20, ("fan_in", "fan_out"))


@query(", u as (select split_part(dst, ':', 1) as family, count(*) as c from edges where kind = 'instantiates' group by dst, 1), r as (select family, c, row_number() over (partition by family order by c) - 1 as k, count(*) over (partition by family) as n from u) select family, max(c) filter (where k = cast(round_even(0.5 * (n - 1), 0) as bigint)) as p50, max(c) filter (where k = cast(round_even(0.9 * (n - 1), 0) as bigint)) as p90, max(c) as max, round(avg(c), 6) as mean from r group by family")
def ag15_nearest_ranks(n, e):
    uses = bounded.instance_counts(e).withColumn("family", F.split_part("unit", F.lit(":"), F.lit(1)))
    return metrics.percentiles(uses, "instances", ["family"])


@query("select json_object('id', id, 'name', name, 'direction', direction, 'line', line) as json from nodes where kind = 'port'")
def prj09_json(n, e):
    return bounded.as_json(n.where("kind = 'port'").select("id", "name", "direction", "line"))


@query("select count(*) filter (where is_low and not is_gone) as upgraded, cast(0 as bigint) as downgraded, cast(0 as bigint) as added, count(*) filter (where is_gone) as removed, count(*) filter (where not is_low and not is_gone) as unchanged from (select src, dst, max(confidence) < 0.8 as is_low, dst like '%7' as is_gone from edges where kind = 'drives' group by src, dst)")
def ag20_delta_counters(n, e):
    from ..operators import incremental

    before = e.where("kind = 'drives'").select("src", "dst", "confidence")
    after = before.where("dst not like '%7'").withColumn("confidence", F.when(F.col("confidence") < 0.8, 0.8).otherwise(F.col("confidence")))
    return incremental.delta_counters(before, after, ["src", "dst"])


@query("select (select count(*) from nodes where kind = 'module' and line % 5 <> 0) as parsed, (select count(*) from nodes where kind = 'module' and line % 5 = 0) as skipped, (select cast(sum(line % 3) as bigint) from nodes where kind = 'module') as errors, (select count(*) from nodes) as nodes, (select count(*) from edges) as edges, (select count(distinct dst) from edges where kind <> 'declares' and dst not in (select id from nodes)) as unresolved")
def q16_status(n, e):
    files = n.where("kind = 'module'").select(F.when(F.col("line") % 5 == 0, "size").alias("skipped_reason"), (F.col("line") % 3).alias("parse_error_count"))
    return summaries.status(files, n, e)
