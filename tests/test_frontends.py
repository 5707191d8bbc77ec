"""Small sources with literal expectations."""

from __future__ import annotations

import json

from loomgraph.sources import frontends
from loomgraph.sources.frontends import parse
from loomgraph.sources.frontends.preprocessor import Preprocessor, preprocess_builds


def table(path, language, text, row):
    """(kind, id or source's last part, target or name) of the rows of a sort."""
    names = [x.split()[0] for x in frontends.SCHEMA.split(", ")]
    return [dict(zip(names, r)) for r in parse(path, language, text).out() if r[0] == row]


def refs(path, language, text, kind):
    return [(r["id"].split("::")[-1], r["target"], r["confidence"], json.loads(r["attrs"])) for r in table(path, language, text, "ref") if r["kind"] == kind]


def nodes(path, language, text, kind):
    return [r["qualified_name"] for r in table(path, language, text, "node") if r["kind"] == kind]


SV = """
// two clocks
module leaf #(parameter W = 8, localparam L = 2) (input logic clk, rst_n, input [W-1:0] d, output logic [W-1:0] q);
  always_ff @(posedge clk or negedge rst_n)
    if (!rst_n) q <= '0;
    else begin q <= d; end
endmodule
module top import pkg::*; (input clk_a, input clk_b, output [7:0] y);
  wire [7:0] s = 8'h0f;
  logic t;
  assign t = s[0] & clk_b;
  leaf #(.W(8)) u0 (.clk(clk_a), .rst_n, .d(s), .q(y)), u1 (clk_b, t, s, y);
  leaf u2 (.*);
  always @(*) begin case (t) 1'b1: y2 = s; default: y2 = 0; endcase end
endmodule
"""


def test_systemverilog_structure():
    assert nodes("a.sv", "systemverilog", SV, "module") == ["leaf", "top"]
    assert nodes("a.sv", "systemverilog", SV, "port") == ["leaf.clk", "leaf.rst_n", "leaf.d", "leaf.q", "top.clk_a", "top.clk_b", "top.y"]
    ports = [json.loads(r["attrs"]) for r in table("a.sv", "systemverilog", SV, "node") if r["kind"] == "port"][:4]
    assert [(p["direction"], p["index"]) for p in ports] == [("input", 0), ("input", 1), ("input", 2), ("output", 3)]
    assert nodes("a.sv", "systemverilog", SV, "parameter") == ["leaf.W", "leaf.L"]
    assert nodes("a.sv", "systemverilog", SV, "instance") == ["top.u0", "top.u1", "top.u2"]
    assert [(s, t) for s, t, *_ in refs("a.sv", "systemverilog", SV, "instantiates")] == [("instance:top.u0", "leaf"), ("instance:top.u1", "leaf"), ("instance:top.u2", "leaf")]
    connects = refs("a.sv", "systemverilog", SV, "connects")
    assert connects[1][3] == {"port_name": "rst_n", "expr_text": "rst_n"} and connects[4][3] == {"position": 0, "expr_text": "clk_b"} and connects[-1][3] == {"wildcard": True}
    assert [(t, a) for _, t, _, a in refs("a.sv", "systemverilog", SV, "imports")] == [("pkg", {"item": "*"})]


def test_systemverilog_dataflow_and_clocks():
    assert [(t, c) for _, t, c, _ in refs("a.sv", "systemverilog", SV, "clocked_by")] == [("clk", 1.0)]
    assert [(t, c, a) for _, t, c, a in refs("a.sv", "systemverilog", SV, "resets")] == [("rst_n", 1.0, {"is_async": True})]
    drives = [(s.split(".")[-1], t) for s, t, *_ in refs("a.sv", "systemverilog", SV, "drives")]
    assert ("always_ff_0", "q") in drives and ("assign_0", "t") in drives and ("always_0", "y2") in drives and ("init_s", "s") in drives
    reads = {(s.split(".")[-1], t) for s, t, *_ in refs("a.sv", "systemverilog", SV, "reads")}
    assert {("always_ff_0", "d"), ("assign_0", "clk_b"), ("always_0", "t")} <= reads


def test_verification_constructs():
    text = """
    class base_test extends uvm_test; constraint c { x < 3; } endclass
    module m(input clk, a, b);
      property p; @(posedge clk) a |-> b; endproperty
      chk: assert property (@(posedge clk) a |=> b);
      covergroup cg @(posedge clk); cp: coverpoint a { bins z = {0}; } endgroup
    endmodule"""
    assert [t for _, t, *_ in refs("t.sv", "systemverilog", text, "extends")] == ["uvm_test"]
    assert nodes("t.sv", "systemverilog", text, "property") == ["m.p"] and nodes("t.sv", "systemverilog", text, "assertion") == ["m.chk"]
    assert {t for _, t, *_ in refs("t.sv", "systemverilog", text, "asserts_on")} == {"a", "b"}
    assert [t for _, t, *_ in refs("t.sv", "systemverilog", text, "covers")] == ["a"]
    assert nodes("t.sv", "systemverilog", text, "constraint") == ["base_test.c"]


def test_vhdl():
    text = """
    library ieee; use ieee.std_logic_1164.all;
    entity Counter is generic (W : integer := 8); port (clk, rst : in std_logic; Q : out std_logic_vector(W-1 downto 0)); end entity;
    architecture rtl of counter is
      signal cnt : unsigned(7 downto 0);
    begin
      process (clk, rst) begin
        if rst = '1' then cnt <= (others => '0');
        elsif rising_edge(clk) then cnt <= cnt + 1; end if;
      end process;
      q <= std_logic_vector(cnt);
      u1 : entity work.sub(beh) port map (a => cnt, b => open);
    end architecture rtl;
    configuration cfg of counter is for rtl for u1 : sub use entity work.other(fast); end for; end for; end configuration;
    """
    assert nodes("c.vhd", "vhdl", text, "entity") == ["counter"] and nodes("c.vhd", "vhdl", text, "port") == ["counter.clk", "counter.rst", "counter.q"]
    assert [t for _, t, *_ in refs("c.vhd", "vhdl", text, "clocked_by")] == ["clk"]
    assert [(t, c, a) for _, t, c, a in refs("c.vhd", "vhdl", text, "resets")] == [("rst", 0.4, {"is_async": True})]
    assert [(t, a["library"], a["architecture"]) for _, t, _, a in refs("c.vhd", "vhdl", text, "instantiates")] == [("sub", "work", "beh")]
    assert {t for _, t, *_ in refs("c.vhd", "vhdl", text, "drives")} == {"cnt", "q"}
    assert ("other", {"architecture": "fast", "block": "rtl", "component": "sub", "labels": ["u1"], "library": "work"}) in [(t, a) for _, t, _, a in refs("c.vhd", "vhdl", text, "binds")]


def test_constraints_power_and_flow():
    text = """set P 10
create_clock -name clk_a -period $P [get_ports clk_a]
set_clock_groups -asynchronous -group {clk_a} -group [get_clocks clk_b]
set_false_path -from [get_clocks clk_a] \\
  -to [get_ports {y z*}]
create_power_domain PD -elements {u0 u1}
set_isolation iso -domain PD
read_verilog ../rtl/top.sv
"""
    clock = [r for r in table("flow/a.tcl", "tcl", text, "node") if r["kind"] == "clock"][0]
    assert clock["name"] == "clk_a" and json.loads(clock["attrs"])["period"] == "10"
    kinds = [json.loads(r["attrs"]) for r in table("flow/a.tcl", "tcl", text, "node") if r["kind"] == "timing_constraint"]
    assert kinds[0]["asynchronous"] is True and kinds[0]["groups"] == [["clk_a"], ["clk_b"]]
    got = [(t, a["role"]) for _, t, _, a in refs("flow/a.tcl", "tcl", text, "constrains")]
    assert ("clk_a", "from") in got and ("z*", "to") in got and ("u1", "element") in got
    power = [json.loads(r["attrs"]) for r in table("flow/a.tcl", "tcl", text, "node") if r["kind"] == "power_domain"][0]
    assert power["strategies"] == [{"kind": "isolation", "name": "iso"}]
    assert [t for _, t, *_ in refs("flow/a.tcl", "tcl", text, "references_file")] == ["rtl/top.sv"]


def test_foreign_sources():
    c = 'extern "C" {\nint add(int a, int b) { return a + b; }\n}\nvoid later(int);\nnamespace n { class K { void m() {} }; }\n'
    assert nodes("x.c", "c", c, "function") == ["add", "later"]
    py = "import cocotb\n@cocotb.test()\nasync def basic(dut):\n    dut.en.value = 1\n    assert dut.q.value == 0\n"
    assert [(t, c) for _, t, c, _ in refs("tb/test_fifo.py", "python", py, "test_covers")] == [("fifo", 0.4)]
    assert [t for _, t, *_ in refs("tb/test_fifo.py", "python", py, "drives")] == ["en"] and [t for _, t, *_ in refs("tb/test_fifo.py", "python", py, "reads")] == ["q"]
    perl = 'open(my $f, ">", "out/fifo.sv");\nprint $f <<EOT;\nmodule fifo; endmodule\nEOT\nopen(IN, "cfg.txt");\n'
    assert [t for _, t, *_ in refs("s/g.pl", "perl", perl, "generated_from")] == ["s/out/fifo.sv"] and [t for _, t, *_ in refs("s/g.pl", "perl", perl, "references_file")] == ["s/cfg.txt"]
    sln = "action a { // > no\n  > b; .top.mode == 3;\n}\naction b { }\n"
    assert [(s, t) for s, t, *_ in refs("s.sln", "sln", sln, "invokes")] == [("action:a", "b")] and [t for _, t, *_ in refs("s.sln", "sln", sln, "test_covers")] == ["top"]


def test_broken_sources_leave_partial_rows():
    rows = table("b.sv", "systemverilog", "module a(input x);\n  leaf u(.x(x));\n", "error")
    assert len(rows) == 1 and nodes("b.sv", "systemverilog", "module a(input x);\n  leaf u(.x(x));\n", "module") == ["a"]
    assert len(table("b.py", "python", "def f(:\n", "error")) == 1


FILES = {
    "rtl/top.sv": '`include "defs.svh"\n`ifdef FAST\nfast\n`elsif SLOW\nslow `W\n`else\nnone\n`endif\n`ADD(1, 2)\n`ADD(1)\n`undef W\n`W\n',
    "inc/defs.svh": "`define W 8\n`define SLOW\n`define ADD(a, b=3) a + \\\n  b\n",
}


def test_preprocessor():
    p = Preprocessor(FILES.get, ("inc",))
    text, origin = p.run("rtl/top.sv")
    words = [" ".join(x.split()) for x in text.split("\n") if x.strip()]
    assert words == ["slow 8", "1 + 2", "1 + 3", "`W"] and len(origin) == len(text.split("\n"))
    assert ("include", "defs.svh", "inc/defs.svh") in [(e["op"], e["name"], e.get("target")) for e in p.events]
    assert [e["name"] for e in p.events if e["op"] == "define"] == ["W", "SLOW", "ADD"]
    assert [" ".join(x.split()) for x in Preprocessor(FILES.get, ("inc",), {"FAST": ""}).run("rtl/top.sv")[0].split("\n") if x.strip()][0] == "fast"


def test_files_in_parallel(spark):
    rows = [("b1", i, p, t, p.endswith(".sv")) for i, (p, t) in enumerate(FILES.items())]
    out = preprocess_builds(spark.createDataFrame(rows, "build string, ordinal int, path string, text string, is_source boolean"), ("inc",)).collect()
    assert len(out) == 1 and "slow 8" in out[0]["text"]
    parsed = frontends.parse_files(spark.createDataFrame([("a.sv", SV), ("n.txt", "x"), ("bad.py", "def (")], "path string, text string"))
    assert frontends.ir_nodes(parsed).where("kind = 'module'").count() == 2
    assert frontends.ir_refs(parsed).where("kind = 'instantiates'").count() == 3
    assert [(r["file"], r["parse_error_count"]) for r in frontends.errors(parsed).collect()] == [("bad.py", 1)]
    assert frontends.ir_edges(parsed).where("kind = 'declares'").count() > 10
