"""Operators on small graphs with literal expectations, and properties that must hold on any."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import exprs
from loomgraph.operators import bounded, incremental, lint, link, metrics, traverse
from loomgraph.operators.components import connected_components
from loomgraph.sources import discovery
from loomgraph.streaming.watch import debounced, each_batch, relevant


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_expressions(spark):
    assert one(spark, exprs.identifiers(F.col("e")), e="a & 8'hff | foo(b) and \"s\" + a inside {c} with null") == ["a", "foo", "b", "c"]
    for name, want in (("rst_n", True), ("core_areset_sync", True), ("first", False), ("rst_count", False), ("RESETN", True), ("clr_i", True), ("rst_ni", True), ("rst_bi", True), ("reset_ni", True), ("rst_ni_sync", True), ("wr_rst_n_i", True), ("m_rst_sync_n", True), ("aclr", False), ("aclear_n", False), ("rsti", False), ("crystal_en", False), ("wrist_data", False), ("reset_value", False)):
        assert one(spark, exprs.is_reset(F.col("n")), n=name) is want, name
    for glob, name, want in (("a*", "abc", True), ("a?c", "abc", True), ("[!a]*", "abc", False), ("[ab]x", "bx", True), ("a.b", "axb", False), ("*", "a\nb", True)):
        assert one(spark, exprs.glob_matches(F.col("n"), glob), n=name) is want, glob
    assert one(spark, exprs.node_kind(F.col("i")), i="rtl/a.sv::module:top.u") == "module" and one(spark, exprs.node_name(F.col("i")), i="unresolved:port:m.p") == "m.p"
    assert one(spark, exprs.pin_leaf(F.col("p")), p="a/b/c[0]") == "c" and one(spark, exprs.stripped(F.col("p")), p="\t x \n") == "x"
    assert one(spark, exprs.language_of(F.col("p")), p="a/b.svh") == "systemverilog" and one(spark, exprs.language_of(F.col("p")), p="a/b.SVH") == "unknown"


def test_components_on_random_graphs(spark):
    for seed in range(2):
        rng = random.Random(seed)
        edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)]
        label = {v: v for e in edges for v in e}
        for _ in range(120):
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
        loops = {a for a, b in edges if a == b}
        assert {k: v for k, v in label.items() if k in got} == got and set(label) - set(got) <= loops


def test_reach_enclosing_and_chains(spark):
    links = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("c", "a", "x"), ("z", "a", "x")], "src string, dst string, via string")
    assert {(r["id"], r["depth"]) for r in traverse.reach(links, spark.createDataFrame([("a",)], "id string")).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    parents = spark.createDataFrame([("l5", "l4"), ("l4", "l3"), ("l3", "l2"), ("l2", "u"), ("u", "top"), ("lost", "nowhere")], "id string, parent string")
    units = spark.createDataFrame([("u",), ("top",)], "id string")
    assert {(r["id"], r["unit"]) for r in traverse.enclosing(parents, units).collect()} == {("l5", "u"), ("l4", "u"), ("l3", "u"), ("l2", "u"), ("u", "top")}
    ext = spark.createDataFrame([(f"c{i}", f"c{i + 1}", "extends") for i in range(9)] + [("c9", "uvm_sequencer_base", "extends")], "src string, dst string, kind string")
    ends = {r["id"]: (r["base"], r["hops"], r["role"]) for r in traverse.chains(ext).withColumn("role", traverse.role()).collect()}
    assert ends["c0"] == ("uvm_sequencer_base", 10, "sequencer") and ends["c9"][1] == 1


DEFS = [("d1", "module", "m", "systemverilog", "a", False), ("d2", "module", "m", "systemverilog", "b", True), ("d3", "module", "n", "systemverilog", "b", False), ("d4", "module", "v", "vhdl", "c", False), ("d5", "module", "x", "systemverilog", "p", False), ("d6", "module", "x", "systemverilog", "q", False)]
REFS = [(1, "module", "m", "systemverilog", "a", 1.0), (2, "module", "m", "systemverilog", "z", 1.0), (3, "module", "n", "systemverilog", "z", 1.0), (4, "module", "V", "systemverilog", "c", 1.0), (5, "module", "x", "systemverilog", "z", 1.0), (6, "module", "gone", "systemverilog", "z", 1.0), (7, "module", "N", "systemverilog", "b", 1.0), (8, "module", "n", "systemverilog", "b", 0.4)]


def frames(spark):
    return spark.createDataFrame(REFS, "ref_id long, kind string, target_name string, language string, file string, confidence double"), spark.createDataFrame(DEFS, "id string, kind string, name string, language string, file string, conditional boolean")


def test_resolution_confidence(spark):
    got = {(r["ref_id"], r["target"], r["score"]) for r in link.resolve(*frames(spark)).collect()}
    assert got == {(1, "d1", 1.0), (2, "d1", 0.8), (3, "d3", 0.8), (4, "d4", 0.8), (5, "d5", 0.6), (5, "d6", 0.6), (6, "unresolved:module:gone", 1.0), (7, "unresolved:module:N", 1.0), (8, "d3", 0.4)}


def test_incremental_equals_full(spark):
    rng = random.Random(4)
    for _ in range(3):
        refs = [(i, "module", f"m{rng.randrange(12)}", "systemverilog", f"f{rng.randrange(5)}", 1.0) for i in range(60)]
        defs = [(f"d{i}", "module", f"m{rng.randrange(10)}", "systemverilog", f"f{rng.randrange(5)}", rng.random() < 0.3) for i in range(25)]
        kept = [d for d in defs if rng.random() < 0.7]
        moved = [(i, k, f"m{rng.randrange(12)}" if f == "f1" else n, la, f, c) for i, k, n, la, f, c in refs]
        r0, _ = frames(spark)
        _, d0 = frames(spark)
        before, after = spark.createDataFrame(defs, d0.schema), spark.createDataFrame(kept, d0.schema)
        old, new = spark.createDataFrame(refs, r0.schema), spark.createDataFrame(moved, r0.schema)
        names = spark.createDataFrame([(d[2], "module") for d in defs if d not in kept] or [("-", "module")], "target_name string, kind string")
        dirty = spark.createDataFrame([("f1",)], "file string")
        edges = incremental.relink(new, after, link.resolve(old, before), dirty, names, link.resolve)
        key = lambda df: sorted(map(tuple, df.select("ref_id", "target", "score").collect()))
        assert key(edges) == key(link.resolve(new, after))


def test_bindings(spark):
    ports = spark.createDataFrame([("u", "u.a", "A", "vhdl", 1), ("u", "u.b", "b", "systemverilog", 0)], "unit string, port string, name string, language string, idx int")
    named = spark.createDataFrame([("i", "u", "a", "systemverilog"), ("i", "u", "B", "systemverilog"), ("i", "u", "zz", "systemverilog")], "inst string, unit string, name string, language string")
    assert {(r["name"], r["dst"], r["confidence"]) for r in link.bind_named(named, ports).collect()} == {("a", "u.a", 1.0), ("B", "u", 0.6), ("zz", "u", 0.6)}
    placed = spark.createDataFrame([("i", "u", 0), ("i", "u", 5)], "inst string, unit string, position int")
    assert {(r["position"], r["dst"], r["confidence"]) for r in link.bind_positional(placed, ports).collect()} == {(0, "u.b", 1.0), (5, "u", 0.6)}
    assert {(r["inst"], r["dst"]) for r in link.bind_wildcard(spark.createDataFrame([("i", "u"), ("j", "none")], "inst string, unit string"), ports).collect()} == {("i", "u.a"), ("i", "u.b"), ("j", "none")}


def test_metrics_on_known_graphs(spark):
    path = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1)], "parent string, target string, weight long")
    got = {r["unit"]: round(r["betweenness"], 6) for r in metrics.betweenness(path).collect()}
    assert got == {"a": 0.0, "b": round(2 / 6, 6), "c": round(2 / 6, 6), "d": 0.0}
    assert {r["unit"] for r in metrics.articulation_points(path).collect()} == {"b", "c"}
    two = [(f"{g}{i}", f"{g}{j}", 5) for g in "ab" for i in range(4) for j in range(4) if i < j] + [("a0", "b0", 1)]
    comm = {r["unit"]: r["community"] for r in metrics.communities(spark.createDataFrame(two, "parent string, target string, weight long")).collect()}
    assert len(comm) == 8 and len({comm[f"a{i}"] for i in range(4)}) == 1 and comm["a1"] != comm["b1"]
    values = spark.createDataFrame([("g", i) for i in (5, 1, 9, 3)], "g string, v int")
    r = metrics.percentiles(values, "v", ["g"]).first()
    assert (r["p50"], r["p90"], r["max"], r["mean"]) == (5, 9, 9, 4.5)


def test_pages_and_preference(spark):
    rows = spark.range(30)
    total, page = bounded.page(rows, ["id"], 0, 5)
    assert total == 30 and [r["id"] for r in page.collect()] == [5]
    some = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "d")], "k int, v string")
    assert {r["v"] for r in bounded.prefer(some, ["k"], F.col("v") == "a").collect()} == {"a", "c", "d"}
    with pytest.raises(ValueError, match="unknown checks"):
        lint.run(rows, rows, ("nope",))


def test_merge_and_deltas(spark):
    a = spark.createDataFrame([("p", "1"), ("q", "1")], "path string, content_hash string")
    b = spark.createDataFrame([("q", "2"), ("r", "1"), ("p", "1")], "path string, content_hash string")
    rows = lambda df: {(r["path"], r["content_hash"]) for r in df.collect()}
    assert rows(incremental.merge_sources([a, b], "first")) == {("p", "1"), ("q", "1"), ("r", "1")}
    assert rows(incremental.merge_sources([a, b], "last")) == {("p", "1"), ("q", "2"), ("r", "1")}
    with pytest.raises(ValueError, match="conflicting"):
        incremental.merge_sources([a, b])
    stubs = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "id string")
    held = incremental.anchored_stubs(stubs, spark.createDataFrame([("s1",)], "id string"), spark.createDataFrame([("s1", "s2")], "src string, dst string"))
    assert {r["id"] for r in held.collect()} == {"s1", "s2"}


def test_filelists():
    lists = {"a.f": "+incdir+inc+more // c\n$ROOT/x.sv\n-f sub/b.f\n-v lib.v x.sv\n+define+A=1\n# all\n-unknown\n", "sub/b.f": "y.sv\n-f ../a.f\n"}
    entries = discovery.parse_filelist(lists.get, "a.f", {"ROOT": "src"})
    assert discovery.flattened(entries) == ["src/x.sv", "sub/y.sv", "x.sv", "lib.v"]
    assert [e["value"] for e in entries if e["kind"] == "incdir"] == ["inc", "more"] and len([e for e in entries if e["kind"] == "warning"]) == 2
    assert discovery.glob_sources(["a/b/c.sv", "c.sv", "a/c.v"], "**/*.sv") == ["a/b/c.sv", "c.sv"]


def test_scan_and_stream(spark, tmp_path):
    (tmp_path / "src/d").mkdir(parents=True)
    (tmp_path / "src/d/a.sv").write_text("module a; endmodule")
    (tmp_path / "src/b.py").write_text("print()")
    got = {r["path"]: r["skipped_reason"] for r in discovery.files(discovery.scan(spark, str(tmp_path / "src"))).collect()}
    assert got == {"d/a.sv": None, "b.py": "not_cocotb"}
    feed = tmp_path / "feed"
    feed.mkdir()
    ts = "2024-01-01 00:00:0"
    rows = [("k", "a.sv", ts + "0"), ("k", "b.txt", ts + "0"), ("k", "a.sv", ts + "1"), ("k", "c.v", "2024-01-01 00:01:00"), ("k", "z.v", "2024-01-01 01:00:00")]
    frame = spark.createDataFrame(rows, "key string, path string, at string").select("key", "path", F.to_timestamp("at").alias("ts"))
    frame.coalesce(1).write.mode("overwrite").parquet(str(feed))
    stream = debounced(relevant(spark.readStream.schema(frame.schema).parquet(str(feed))), "5 seconds", late="10 seconds")
    seen, failures = [], []

    def update(batch):
        seen.extend((r["events"], tuple(r["paths"])) for r in batch.collect())
        raise RuntimeError("one bad batch")

    q = stream.writeStream.foreachBatch(each_batch(update, lambda n, e: failures.append(str(e)))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = {(r["events"], tuple(r["paths"])) for r in debounced(relevant(frame), "5 seconds").collect()}
    assert set(seen) <= batch and (2, ("a.sv",)) in seen and failures


def test_store_round_trip_and_export(spark, tmp_path):
    from loomgraph.query import GraphQuery
    from loomgraph.sources import store
    from loomgraph.sources.bridge import edges, nodes

    from tests.conftest import SF

    n, e = nodes(spark, SF).where("kind <> 'instance' or file <> 'rtl/orders.sv'"), edges(spark, SF).where("not startswith(src, 'lineitem') and not startswith(dst, 'lineitem')")
    root = f"file://{tmp_path}/graph"
    first = store.publish(root, n.limit(5), e.limit(5))
    second = store.publish(root, n, e, meta={"root": "x"})
    assert first != second and store.current(spark, root).endswith(second)
    n2, e2, meta = store.load(spark, root)
    assert meta["root"] == "x" and n2.count() == n.count() and sorted(e2.columns) == sorted(e.columns)
    q = GraphQuery.open(spark, root)
    assert {r["name"] for r in q.top_modules().where("name like 'region%'").collect()} == {f"region_{i}" for i in range(5)}
    assert q.hierarchy("region_1", 1).where("depth = 1").count() > 0 and q.find_module("nation_3").count() == 1
    with pytest.raises(ValueError):
        q.hierarchy("nowhere")
    import json

    from loomgraph.__main__ import answer, main

    lines = [json.loads(x) for x in answer(spark, root, "find-module", ["nation_3"])]
    assert len(lines) == 1 and lines[0]["instantiation_count"] == 1
    paged = json.loads(answer(spark, root, "modules", [], page=2, offset=1)[0])
    assert paged["count"] == 2 and paged["truncated"] and paged["total"] > 100 and len(paged["items"]) == 2
    assert main([root, "unit", "region_1"]) == 0 and main([root, "unit", "nowhere"]) == 2 and main([root, "no-such", "x"]) == 2 and main([root, "unit"]) == 2
    some = spark.createDataFrame([("a<", "k&")], "id string, name string")
    assert {r["value"] for r in store.gexf_rows(some, spark.createDataFrame([("a<", "a<", "x")], "src string, dst string, kind string")).collect()} == {'<node id="a&lt;" label="k&amp;"/>', '<edge source="a&lt;" target="a&lt;" label="x"/>'}
    assert store.graphml_rows(some, spark.createDataFrame([("a<", "a<", "x")], "src string, dst string, kind string")).collect()[0][0] == '<node id="a&lt;"><data key="name">k&amp;</data></node>'
    assert store.node_link_rows(some, some.select(F.col("id").alias("src"))).count() == 2
    kept = store.replace_sources(spark.createDataFrame([("a", 1), ("b", 1)], "src string, v int"), spark.createDataFrame([("a", 2), ("b", 2)], "src string, v int"), spark.createDataFrame([("a",)], "src string"))
    assert {tuple(r) for r in kept.collect()} == {("a", 2), ("b", 1)}


def test_reports(spark):
    from loomgraph.operators import summaries

    d = spark.createDataFrame([("pd", "PD", ["u0", "gone"], [("isolation", "iso")], "vdd"), ("pe", "PE", [], [], None)], "id string, name string, elements array<string>, strategies array<struct<kind:string,name:string>>, supply string")
    e = spark.createDataFrame([("pd", "top.u0", "constrains", 0.6, "u0")], "src string, dst string, kind string, confidence double, expr_text string")
    got = {r["name"]: r for r in summaries.power_domains(d, e).collect()}
    assert got["PD"]["elements"] == ["top.u0"] and got["PD"]["unresolved_elements"] == ["gone"] and got["PD"]["isolated"] and got["PD"]["min_confidence"] == 0.6
    assert got["PE"]["elements"] == [] and not got["PE"]["isolated"]
    paths = spark.createDataFrame([(0, "t", None), (1, "b", "u1"), (1, "a", "u0"), (2, "c", "u0")], "depth int, unit string, inst string")
    kept, omitted = summaries.prune_paths(paths, 3)
    assert [r["unit"] for r in kept.collect()] == ["t", "a", "b"] and omitted == 1
    refs = spark.createDataFrame([("f", 1, "k"), ("f", 1, "k"), ("g", 2, "k")], "file string, src int, kind string")
    closures = spark.createDataFrame([("f", "f"), ("f", "g"), ("g", "g")], "edit string, file string")
    assert {(r["edit"], r["reresolved"]) for r in summaries.locality(refs, closures).collect()} == {("f", 2), ("g", 1)}


def test_scoped_links(spark):
    inst = spark.createDataFrame([("i1", "e", "c", "u1", "rtl"), ("i2", "e", "c", "u2", "rtl"), ("i3", "e", "c", "u3", "other")], "inst string, entity string, component string, label string, block string")
    bound = spark.createDataFrame([("e", "c", "others", None, "t_others", None, 0), ("e", "c", "u1", None, "t_label", "a", 1), ("e", "c", "u2", None, "t_any", None, 2), ("e", "c", "u2", "rtl", "t_block", None, 3), ("e", "d", "all", None, "x", None, 4)], "entity string, component string, label string, block string, target string, architecture string, ord int")
    assert {(r["inst"], r["target"]) for r in link.choose_binding(inst, bound).collect()} == {("i1", "t_label"), ("i2", "t_block"), ("i3", "t_others")}
    scope = spark.createDataFrame([("m", "a", "m.a.sig", "signal", False), ("m", "a", "m.a.port", "port", False), ("m", "b", "m.b1", "port", True), ("m", "b", "m.b2", "signal", False), ("m", "W", "m.W", "parameter", False)], "unit string, name string, child string, kind string, conditional boolean")
    refs = spark.createDataFrame([(1, "m", "a"), (2, "m", "b"), (3, "m", "W"), (4, "m", "zz")], "ref_id int, unit string, name string")
    assert {(r["ref_id"], r["target"], r["score"]) for r in link.resolve_scoped(refs, scope).collect()} == {(1, "m.a.port", 1.0), (2, "m.b2", 1.0), (4, "unresolved:signal:m.zz", 0.6)}
    units = spark.createDataFrame([("m", "top")], "unit string, name string")
    tb = spark.createDataFrame([(1, "top", "A"), (2, "top", "nope"), (3, "none", "a")], "ref_id int, top string, name string")
    assert {r["ref_id"] for r in link.resolve_testbench(tb, scope, units).collect()} == {1}
    acts = spark.createDataFrame([("x1", "f", "x"), ("y1", "f", "y")], "id string, file string, name string")
    inv = spark.createDataFrame([(1, "x1", "f", "y"), (2, "x1", "f", "x"), (3, "x1", "g", "y")], "ref_id int, src string, file string, name string")
    assert {(r["ref_id"], r["target"]) for r in link.resolve_invokes(inv, acts).collect()} == {(1, "y1")}
    asked = spark.createDataFrame([(1, "a.sv"), (2, "b.sv")], "ref_id int, path string")
    assert {(r["ref_id"], r["target"]) for r in link.resolve_files(asked, spark.createDataFrame([("a.sv",)], "path string")).collect()} == {(1, "file:a.sv"), (2, "unresolved:file:b.sv")}


def test_version_control(spark):
    from loomgraph.sources import vcs

    assert vcs.git_changes("M\0a.sv\0R100\0b.sv\0c.sv\0D\0d.sv\0", "new.v\0") == [("a.sv", "changed"), ("b.sv", "removed"), ("c.sv", "added"), ("d.sv", "removed"), ("new.v", "added")]
    assert vcs.svn_changes("M       a.sv\n?       b c.v\n!       d.v\n M      p.v\n") == [("a.sv", "changed"), ("b c.v", "added"), ("d.v", "removed"), ("p.v", "changed")]
    assert vcs.p4_changes("... localFile /w/a.sv\n... action edit\n\n... localFile /x/b.sv\n... action add\n\n... localFile /w/c.v\n... action delete\n", "/w") == [("a.sv", "changed"), ("c.v", "removed")]
    assert vcs.change_frame(spark, [("a.sv", "added"), ("b.txt", "added")], (".sv",)).count() == 1


def test_unit_metrics_see_every_unit(spark):
    """Orders and parts too, not only regions, nations and customers."""
    from loomgraph import catalog

    from tests.conftest import SF

    links = [(r["parent"], r["target"]) for r in catalog.QUERIES["ag10_projection"](spark, SF).collect()]
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    assert any(u.startswith("orders") for u in near) and any(u.startswith("part") for u in near)
    assert {r["unit"] for r in catalog.QUERIES["q15_betweenness"](spark, SF).collect()} == set(near)
    assert sum(r["units"] for r in catalog.QUERIES["q15_communities"](spark, SF).collect()) == len(near)

    def reached(start, without):
        seen, todo = {start, without}, [start]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return len(seen)

    whole = {u: reached(u, None) - 1 for u in near}
    cut = {u for u in near if reached(next(iter(near[u] - {u})), u) < whole[u]}
    assert {r["unit"] for r in catalog.QUERIES["q15_articulation"](spark, SF).collect()} == cut


def test_alias_pairs_and_collapses(spark):
    """A module used twice with its clocks swapped makes one domain by name only; a leaf on one net does not."""
    from loomgraph.operators import clocks

    connects = spark.createDataFrame([("i1", "m.c1", "t", "clk_a"), ("i1", "m.c2", "t", "clk_b"), ("i2", "m.c1", "t", " CLK_B "), ("i2", "m.c2", "t", "clk_a"), ("i3", "l.c", "t", "clk_a"), ("i4", "l.c", "t", "clk_a & en"), ("i5", "x.c", "t", "d1"), ("i6", "x.c", "t", "d2"), ("i7", "y.c", "t", None)], "inst string, formal string, scope string, expr_text string")
    nets = spark.createDataFrame([("t", x, x) for x in ("clk_a", "clk_b", "d1", "d2", "en")], "scope string, id string, name string")
    pairs = clocks.alias_pairs(connects, nets)
    assert {tuple(r) for r in pairs.collect()} == {("m.c1", "clk_a"), ("m.c1", "clk_b"), ("m.c2", "clk_a"), ("m.c2", "clk_b"), ("l.c", "clk_a"), ("x.c", "d1"), ("x.c", "d2")}
    roots = spark.createDataFrame([("clk_a",)], "root string")
    assert {tuple(r) for r in clocks.collapses(pairs, roots).collect()} == {("clk_a", "m.c1", 2), ("clk_a", "m.c2", 2)}
    joined = pairs.unionByName(spark.createDataFrame([("clk_a", "net"), ("clk_b", "net")], "formal string, actual string"))  # both are bound to one net above
    assert clocks.collapses(joined, roots).count() == 0


def test_stored_graph_is_sorted_and_replaced_atomically(spark, tmp_path):
    from loomgraph.operators import bounded
    from loomgraph.sources import store

    e = spark.createDataFrame([(f"i{i:03}", f"m{i % 7}", "instantiates") for i in range(200)], "src string, dst string, kind string")
    n = spark.createDataFrame([(f"m{i}", f"m{i}", "module") for i in range(7)], "id string, name string, kind string")
    root = f"file://{tmp_path}/g"
    assert not store.exists(spark, root)
    for _ in range(3):
        last = store.publish(root, n, e)
        assert store.current(spark, root).endswith(last) and store.exists(spark, root)
    _, stored, _ = store.load(spark, root)
    ids = n.where("id < 'm2'").select("id")
    few, many = bounded.near(stored, "dst", ids), bounded.PUSHED
    plan = few._jdf.queryExecution().toString()
    assert "PushedFilters: [In(dst" in plan or "EqualTo(dst" in plan
    bounded.PUSHED = 1
    try:
        assert sorted(map(tuple, bounded.near(stored, "dst", ids).collect())) == sorted(map(tuple, few.collect()))
    finally:
        bounded.PUSHED = many
    assert bounded.near(stored, "dst", n.where("false").select("id")).count() == 0


def test_configuration_and_waivers(tmp_path):
    from loomgraph.operators.lint import CHECKS
    from loomgraph.sources import config

    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "loomgraph.toml").write_text('[build]\nsources = ["rtl/**/*.sv"]\nodd = 1\n')
    found = config.find(str(tmp_path / "a" / "b"))
    assert found == str(tmp_path / "loomgraph.toml") and config.find("/") is None
    built, warnings = config.load((tmp_path / "loomgraph.toml").read_text())
    assert built["sources"] == ["rtl/**/*.sv"] and built["max_file_size_kb"] == 2048 and warnings == ["unknown key 'odd'"]
    assert config.DEFAULTS["sources"] == []
    with pytest.raises(ValueError):
        config.load('[build]\nsources = "x"\n')
    assert config.waivers('[[waiver]]\ncheck = "open-port"\nfile = "rtl/*"\nreason = "vendor"\n', CHECKS) == [{"check": "open-port", "file": "rtl/*"}]
    for bad in ('[[waiver]]\nreason = "x"\n', '[[waiver]]\ncheck = "nope"\n', '[[waiver]]\nfiles = "x"\n'):
        with pytest.raises(ValueError):
            config.waivers(bad, CHECKS)
    assert config.relative("/w/./rtl/a.sv", "/w") == "rtl/a.sv" and config.relative("/x/a.sv", "/w") == "/x/a.sv" and config.relative("rtl//a.sv", "/w") == "rtl/a.sv"
    assert config.confined("rtl/a.sv", "/w") and not config.confined("../a.sv", "/w") and not config.confined("/wx/a", "/w")


def test_merge_gates_and_narrowing(spark):
    from loomgraph.operators import bounded, incremental

    base = {"root": "r", "schema_version": 1, "codec_version": 1}
    incremental.merge_gate([base, dict(base)])
    for bad in ({**base, "root": "x"}, {**base, "schema_version": 2}, {**base, "enriched": True}):
        with pytest.raises(ValueError):
            incremental.merge_gate([base, bad])
    a, b, c = (spark.createDataFrame(r, "path string, h string") for r in ([("x", "1"), ("y", "2")], [("y", "2"), ("z", "3")], [("x", "9")]))
    assert incremental.adapter_union([a, b], "path", "h").count() == 3
    with pytest.raises(ValueError, match="x"):
        incremental.adapter_union([a, b, c], "path", "h")
    files, none = spark.createDataFrame([("systemverilog",)], "language string"), spark.createDataFrame([], "kind string")
    assert not incremental.needs_full_link(files, none) and incremental.needs_full_link(files, none, enriched=True)
    assert incremental.needs_full_link(files.unionByName(spark.createDataFrame([("vhdl",)], "language string")), none)
    assert incremental.needs_full_link(files, spark.createDataFrame([("binds",)], "kind string"))
    bases = spark.createDataFrame([(1, "p", "p.c"), (1, "p", "q.c"), (2, "p", "q.c"), (2, "p", "pp.c")], "ref_id int, package string, qualified_name string")
    assert {(r["ref_id"], r["qualified_name"]) for r in link.prefer_package(bases).collect()} == {(1, "p.c"), (2, "q.c"), (2, "pp.c")}
    dpi = spark.createDataFrame([(1, "import", "c", False), (1, "import", "cpp", True), (1, "import", "verilog", True), (2, "export", "systemverilog", False), (2, "export", "c", True)], "ref_id int, direction string, language string, is_definition boolean")
    assert {(r["ref_id"], r["language"]) for r in link.foreign_targets(dpi).collect()} == {(1, "cpp"), (2, "systemverilog")}
    asserts = spark.createDataFrame([(1, "signal"), (1, "property"), (2, "signal")], "ref_id int, kind string")
    assert {(r["ref_id"], r["kind"]) for r in link.prefer_assertable(asserts).collect()} == {(1, "property"), (2, "signal")}
    assert bounded.check_kind("module", bounded.UNITS) == "module"
    with pytest.raises(ValueError, match="class"):
        bounded.check_kind("modul", bounded.UNITS)
    few = spark.createDataFrame([(i,) for i in range(7)], "k int")
    assert sorted(r["k"] for r in bounded.strided(few, "k", 3).collect()) == [0, 2, 4] and bounded.strided(few, "k", 9).count() == 7


def test_shared_tables_are_dropped_and_released(spark):
    from pathlib import Path

    from loomgraph.sources import shared

    a, b = shared.materialise(spark.range(5), "a"), shared.materialise(spark.range(6), "b")
    at = [Path(x.inputFiles()[0].removeprefix("file://")).parent for x in (a, b)]
    assert all(p.is_dir() for p in at) and at[0].parent == at[1].parent and at[0].parent.name == spark.sparkContext.applicationId
    shared.drop(a)
    assert not at[0].exists() and b.count() == 6
    shared.drop(spark.range(3).where("id < 0"))  # no files behind it


def test_strided_places_hold_however_ranges_are_merged(spark):
    """Counting the ranges reads narrower rows than returning them, which adaptive execution merged in another way."""
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1m", "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "40"}
    was = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        wide = spark.range(20_000).select("id", F.concat(*(F.sha2(F.concat("id", F.lit(str(i))), 256) for i in range(6))).alias("text"))
        assert sorted(r["id"] for r in bounded.strided(wide, "id", 40).collect()) == [i * 500 for i in range(40)]
        assert sorted(r["id"] for r in bounded.strided(wide, "id", 7).collect()) == [i * 20_000 // 7 for i in range(7)]
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_graph_is_read_from_the_tables_alone(spark):
    """Nothing is shuffled or written to have the graph, and kinds that are not asked for are not read."""
    from loomgraph.sources import bridge, store

    from tests.conftest import SF

    n, e = bridge.graph(spark, SF, ("part", "signal"), ("imports",))
    assert {f.rsplit("/", 1)[-1] for f in e.inputFiles()} == {"part.parquet"} and {f.rsplit("/", 1)[-1] for f in n.inputFiles()} == {"part.parquet", "nation.parquet", "region.parquet"}
    assert "Exchange" not in n.unionByName(n)._jdf.queryExecution().executedPlan().toString()
    n, e = bridge.graph(spark, SF)
    stored_n, stored_e, _ = store.load(spark, bridge.stored(spark, SF))
    for view, kept in ((n, stored_n), (e, stored_e)):
        assert view.exceptAll(kept.select(*view.columns)).isEmpty() and kept.select(*view.columns).exceptAll(view).isEmpty()
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_missing_ends_and_targets(spark):
    n = spark.createDataFrame([("a",), ("b",)], "id string")
    e = spark.createDataFrame([("a", "x", "drives"), ("y", "x", "drives"), ("a", "b", "reads"), ("b", "z", "declares"), ("a", "w", "reads")], "src string, dst string, kind string")
    assert {tuple(r) for r in bounded.missing_ends(n, e).collect()} == {("x", 2), ("y", 1), ("z", 1), ("w", 1)}
    assert {tuple(r) for r in bounded.unresolved(n, e).collect()} == {("x", 2, "a"), ("w", 1, "a")}
    assert {r["id"] for r in bounded.missing_targets(n, e).collect()} == {"x", "w"}


def test_articulation_points_and_betweenness_on_random_graphs(spark):
    """Exact at any size: by taking units away, and by counting shortest paths from every unit."""
    from collections import deque

    for seed, n, m in ((1, 30, 34), (2, 24, 40), (3, 600, 640)):
        rng = random.Random(seed)
        pairs = {(f"u{rng.randrange(n)}", f"u{rng.randrange(n)}") for _ in range(m)} | {("u0", "u0")}
        frame = spark.createDataFrame([(a, b, 1) for a, b in pairs], "parent string, target string, weight long")
        units = {u for p in pairs for u in p}
        out = {u: sorted({b for a, b in pairs if a == u and b != a}) for u in units}
        if n < 100:
            near = {u: {b for a, b in pairs if a == u} | {a for a, b in pairs if b == u} for u in units}

            def parts(without):
                left, count = units - {without}, 0
                while left:
                    count, todo = count + 1, [left.pop()]
                    while todo:
                        more = near[todo.pop()] & left
                        left -= more
                        todo += more
                return count

            alone = {u for u in units if not near[u] - {u}}
            cut = {u for u in units - alone if parts(u) > parts(None)}
            assert {r["unit"] for r in metrics.articulation_points(frame).collect()} == cut and cut
        want = dict.fromkeys(units, 0.0)
        for s in units:
            order, before, paths, dist, todo = [], {u: [] for u in units}, {s: 1}, {s: 0}, deque([s])
            while todo:
                x = todo.popleft()
                order.append(x)
                for y in out[x]:
                    if y not in dist:
                        dist[y] = dist[x] + 1
                        todo.append(y)
                    if dist[y] == dist[x] + 1:
                        paths[y] = paths.get(y, 0) + paths[x]
                        before[y].append(x)
            share = dict.fromkeys(units, 0.0)
            for y in reversed(order):
                for x in before[y]:
                    share[x] += paths[x] / paths[y] * (1 + share[y])
                if y != s:
                    want[y] += share[y] / ((len(units) - 1) * (len(units) - 2))
        if n > 100 or seed == 1:
            got = {r["unit"]: r["betweenness"] for r in metrics.betweenness(frame).collect()}
            assert got.keys() == want.keys() and all(abs(got[u] - want[u]) < 1e-12 for u in units)


def test_quiet_periods_of_a_table(spark):
    """As by session windows, but a batch has ended when the quiet has passed in full (as in the SQL); a busy key is not one task's."""
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["p", "q", "r", None]), rng.randrange(0, 4000) * 1.7) for _ in range(300)] + [("c", "p", 0.0), ("c", "q", 30.0), ("c", "p", 59.9), (None, None, 90000.0)]
    e = spark.createDataFrame(rows, "key string, path string, at double").select("key", "path", F.timestamp_seconds("at").alias("ts"))
    s = e.groupBy("key", F.session_window("ts", "30 seconds").alias("w")).agg(F.count("*").alias("events"), F.array_sort(F.collect_set("path")).alias("paths")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "paths")
    flat = lambda df: sorted((str(tuple(r)) for r in df.where("key is null or key <> 'c'").collect()))
    got = debounced(e, "30 seconds")
    assert flat(got) == flat(s)
    assert sorted((r["events"], tuple(r["paths"])) for r in got.where("key = 'c'").collect()) == [(1, ("p",)), (2, ("p", "q"))]
    assert "session" not in got._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a_macro_stands_between_its_files_and_its_users(spark):
    from loomgraph.operators import summaries, traverse

    files = spark.range(300).select(F.concat(F.lit("d"), "id").alias("file"), F.lit("M").alias("macro"))
    users = spark.range(300).select(F.concat(F.lit("u"), "id").alias("file"), F.lit("M").alias("macro"))
    includes = spark.createDataFrame([("x", "u7"), ("y", "x")], "file string, target string")
    widest, step = [], traverse.reach.__globals__["materialise"]
    seen = summaries.reach
    try:
        summaries.reach = lambda links, seeds: seen(lambda ids: (found := links(ids), widest.append(found.count()))[0], seeds)
        got = {(r["path"], r["depth"], r["reason"]) for r in summaries.dirty_closure(includes, files, users, files.select(F.col("file").alias("path"))).collect()}
    finally:
        summaries.reach = seen
    assert {("x", 2, "includes u7"), ("y", 3, "includes x"), ("u7", 1, "uses macro M"), ("d1", 0, None)} <= got and len(got) == 602
    assert max(widest) == 300 and step is not None


def test_ambiguous_references_are_counted_by_class(spark):
    """Narrowing meets classes of references and definitions, not each pair; counts agree with the pairs."""
    refs, defs = frames(spark)
    many = spark.range(400).select(F.lit("module").alias("kind"), F.lit("m").alias("target_name"), F.lit("systemverilog").alias("language"), F.concat(F.lit("f"), (F.col("id") % 3).cast("string")).alias("file"), F.lit(1.0).alias("confidence"), F.col("id").alias("ref_id"))
    more = spark.range(300).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("id"), F.lit("module").alias("kind"), F.lit("m").alias("name"), F.lit("systemverilog").alias("language"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("f"), (F.col("id") % 4).cast("string"))).alias("file"), (F.col("id") % 2 == 0).alias("conditional"))
    assert link.matches(many, more).count() == 3 * more.select("file", "conditional").distinct().count()
    for r, d in ((refs, defs), (many.select(*refs.columns), more)):
        pairs = link.resolve(r, d).groupBy("ref_id", "score").agg(F.count("*").alias("n"))
        assert sorted(map(tuple, link.resolve_counted(r, d).collect())) == sorted(map(tuple, pairs.collect()))
    assert link.resolve(many.select(*refs.columns), more).count() == 400 * 300


def test_changed_sources_move_rows_once(spark):
    old = spark.createDataFrame([(1, 2, "x"), (1, 2, "x"), (2, 3, "x"), (3, 4, None), (4, 4, None)], "src long, dst long, kind string")
    new = spark.createDataFrame([(1, 2, "x"), (2, 3, "x"), (4, 4, None), (5, 1, "y")], "src long, dst long, kind string")
    got = incremental.changed_sources(old, new)
    assert {r["src"] for r in got.collect()} == {1, 3, 5}
    assert got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1


def test_unconnected_ports_by_instance(spark):
    nodes = [("u.a", "port", "a", "f", 1), ("u.b", "port", "b", "f", 2), ("i1", "instance", "i1", "g", 3), ("i2", "instance", "i2", "g", 4), ("i3", "instance", "i3", "g", 5), ("i3", "instance", "i3", "h", 6), ("i4", "instance", "i4", "g", 7)]
    edges = [("u", "u.a", "declares"), ("u", "u.b", "declares"), ("u", "i9", "declares")] + [(i, "u", "instantiates") for i in ("i1", "i2", "i3", "i4", "i5")] + [("i4", "v", "instantiates")]
    edges += [("i1", "u.a", "connects"), ("i1", "u.a", "connects"), ("i1", "u.b", "connects"), ("i3", "x.y", "connects"), ("i4", "u.a", "connects"), ("i5", "u.a", "connects")]
    n, e = spark.createDataFrame(nodes, "id string, kind string, name string, file string, line int"), spark.createDataFrame(edges, "src string, dst string, kind string")
    got = lint.unconnected_port(n, e)
    assert sorted((r["node_id"], r["name"], r["file"], r["line"]) for r in got.collect()) == sorted(("i3", p, f, l) for p in "ab" for f, l in (("g", 5), ("h", 6)))
    assert got._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") + got._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") <= 2


def test_edges_are_dealt_before_they_are_compared(spark):
    e = spark.createDataFrame([("a", "b", "reads"), ("a", "b", "reads"), ("a", "c", "reads"), ("a", None, "reads")], "src string, dst string, kind string")
    got = bounded.distinct_edges(e)
    assert got.count() == 3
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_COL" in plan
