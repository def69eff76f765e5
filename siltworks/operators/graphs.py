"""Program graphs of C texts as tables: syntax tree, control flow, definitions and uses, and their union with edges between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltworks.functions.text import lines, trimmed
from siltworks.operators import cparse
from siltworks.plans.runtime import materialize, spread

_SCHEMA = "key long, part string, id long, type string, source long, target long, start_line int, end_line int, start long, end long, text string, variable string"
# Nodes that no finding is linked to, and those that are preferred.
IGNORED = ["translation_unit", "program", "function_definition", "compound_statement", "FUNCTION_ENTRY", "FUNCTION_EXIT", "IF_MERGE", "WHILE_EXIT"]
PREFERRED = ["call_expression", "expression_statement", "assignment", "variable_declarator", "identifier"]
#: Languages that are parsed.
LANGUAGES = ["c", "cpp"]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    for batch in batches:
        out: list[tuple] = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows, failed = cparse.graph_rows(text)
            out.append((key, "text", int(failed), None, None, None, None, None, None, None, None, None))
            out.extend((key, *r) for r in rows)
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


class Graphs:
    """The graphs of df's C and C++ texts (key: a number that is unique). Each text is parsed once; blank and null texts have none.

    language: a column of names, of which c, cpp and null are parsed; without, all texts are."""

    def __init__(self, df: DataFrame, key: str, code: str, language: Column | None = None):
        lang = F.coalesce(language, F.lit("cpp")) if language is not None else F.lit("cpp")
        self.texts = df.where(lang.isin(*LANGUAGES) & (F.length(trimmed(F.col(code))) > 0)).select(F.col(key).cast("long").alias("key"), F.col(code).alias("code"))
        self.key = key
        self.rows = materialize(spread(self.texts).mapInArrow(_rows, _SCHEMA))

    def part(self, name: str) -> DataFrame:
        return self.rows.where(F.col("part") == name)

    def ast_edges(self) -> DataFrame:
        """(key, source, target): from every node to its children."""
        return self.part("ast").where(F.col("source").isNotNull()).select("key", "source", F.col("id").alias("target"))

    def def_use(self) -> DataFrame:
        """(key, variable, source, target): each use with the last definition of its variable before it in the text, whatever the scopes."""
        before = W.partitionBy("key", "variable").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
        last = F.last(F.when(F.col("type") == "DEF", F.col("id")), ignorenulls=True).over(before)
        return self.part("dfg").withColumn("at", last).where((F.col("type") == "USE") & F.col("at").isNotNull()).select("key", "variable", F.col("at").alias("source"), F.col("id").alias("target"))

    def ast_cfg(self) -> DataFrame:
        """(key, source, target): each control-flow node that has a place in the text with the outermost syntax node of the same span, else with the smallest that contains it (of equals the first)."""
        return contained(self.part("cfg"), self.part("ast"))

    def ast_dfg(self) -> DataFrame:
        """(key, source, target): each definition or use with the identifier of its span and text."""
        names = self.part("ast").where(F.col("type") == "identifier").groupBy("key", "start", "end", "text").agg(F.min("id").alias("source"))
        return self.part("dfg").select("key", "id", "start", "end", "text").join(names, ["key", "start", "end", "text"]).select("key", "source", F.col("id").alias("target"))

    def counts(self) -> DataFrame:
        """(key, ast_nodes, ..., total_nodes, total_edges): ten counts of each text's graph."""
        n = lambda c: F.count(F.when(c, 1))
        of = lambda p: F.col("part") == p
        base = self.rows.groupBy("key").agg(n(of("ast")).alias("ast_nodes"), n(of("ast") & F.col("source").isNotNull()).alias("ast_edges"), n(of("cfg")).alias("cfg_nodes"), n(of("cfg_edge")).alias("cfg_edges"), n(of("dfg")).alias("dfg_nodes"))
        for name, edges in (("dfg_edges", self.def_use()), ("ast_cfg_edges", self.ast_cfg()), ("ast_dfg_edges", self.ast_dfg())):
            base = base.join(edges.groupBy("key").agg(F.count(F.lit(1)).alias(name)), "key", "left").na.fill(0, [name])
        nodes, edges = ["ast_nodes", "cfg_nodes", "dfg_nodes"], ["ast_edges", "cfg_edges", "dfg_edges", "ast_cfg_edges", "ast_dfg_edges"]
        total = lambda cs: sum((F.col(c) for c in cs[1:]), F.col(cs[0]))
        return base.select("key", *nodes, *edges, total(nodes).alias("total_nodes"), total(edges).alias("total_edges"))

    def offsets(self) -> DataFrame:
        """(key, cfg, dfg): what is added to the ids of control-flow and data-flow nodes in the union."""
        n = lambda p: F.count(F.when(F.col("part") == p, 1))
        return self.rows.groupBy("key").agg(n("ast").alias("cfg"), (n("ast") + n("cfg")).alias("dfg"))

    def nodes(self) -> DataFrame:
        """(key, id, graph_type, type, start_line, end_line, text, variable) of the united graph."""
        rows = self.rows.where(F.col("part").isin("ast", "cfg", "dfg")).join(self.offsets(), "key")
        add = F.when(F.col("part") == "cfg", F.col("cfg")).when(F.col("part") == "dfg", F.col("dfg")).otherwise(0)
        return rows.select("key", (F.col("id") + add).alias("id"), F.upper("part").alias("graph_type"), "type", "start_line", "end_line", "text", "variable")

    def edges(self) -> DataFrame:
        """(key, source, target, type, graph_type) of the united graph."""
        one = lambda df, kind, graph, a=F.lit(0), b=F.lit(0): df.join(self.offsets(), "key").select("key", (F.col("source") + a).alias("source"), (F.col("target") + b).alias("target"), kind.alias("type"), F.lit(graph).alias("graph_type"))
        cfg, dfg = F.col("cfg"), F.col("dfg")
        out = one(self.ast_edges(), F.lit("AST"), "AST")
        out = out.unionByName(one(self.part("cfg_edge").select("key", "source", "target", "type"), F.col("type"), "CFG", cfg, cfg))
        out = out.unionByName(one(self.def_use().drop("variable"), F.lit("DEF_USE"), "DFG", dfg, dfg))
        return out.unionByName(one(self.ast_cfg(), F.lit("AST_CFG"), "CPG", F.lit(0), cfg)).unionByName(one(self.ast_dfg(), F.lit("AST_DFG"), "CPG", F.lit(0), dfg))

    def summary(self) -> DataFrame:
        """(key, line_count, function_count, functions, ast_node_count, has_syntax_error) of each text; functions are named in order."""
        ln = lines(F.col("code"))
        size = F.size(ln) - F.when(F.element_at(ln, -1) == "", 1).otherwise(0)  # a line end at the end opens no line
        count = self.rows.groupBy("key").agg(F.count(F.when(F.col("part") == "ast", 1)).alias("ast_node_count"), F.max(F.when(F.col("part") == "text", F.col("id") == 1)).alias("has_syntax_error"))
        ast = self.part("ast")
        functions = ast.where(F.col("type") == "function_definition").select("key", F.col("id").alias("f"))
        declarators = ast.where(F.col("type") == "function_declarator").select("key", F.col("source").alias("f"), F.col("id").alias("d"))
        name = ast.where(F.col("type") == "identifier").select("key", F.col("source").alias("d"), F.col("id").alias("i"), "text")
        named = functions.join(declarators, ["key", "f"]).join(name, ["key", "d"]).groupBy("key", "f").agg(F.min_by("text", "i").alias("name"))
        per = named.groupBy("key").agg(F.count(F.lit(1)).alias("function_count"), F.transform(F.sort_array(F.collect_list(F.struct("f", "name"))), lambda x: x["name"]).alias("functions"))
        out = self.texts.select("key", size.cast("long").alias("line_count")).join(count, "key").join(per, "key", "left")
        return out.select("key", "line_count", F.coalesce("function_count", F.lit(0)).alias("function_count"), F.coalesce("functions", F.array().cast("array<string>")).alias("functions"), "ast_node_count", "has_syntax_error")

    def links(self, found: DataFrame) -> DataFrame:
        """(key, type, function, line, id, node_type, graph_type, text) of the nodes that findings (key, type, function, line) stand at: nodes of the same line whose text names the function (for SQL any), the preferred kinds only where there are such, equal nodes once.

        The findings meet the nodes by key and line; nodes of containers and without a place are left out first."""
        n = self.nodes().where(F.col("start_line").isNotNull() & ~F.col("type").isin(*IGNORED)).select("key", F.col("start_line").alias("line"), "id", F.col("type").alias("node_type"), "graph_type", "text")
        f = found.select("key", "type", "function", "line").distinct()
        hit = (F.col("type") == "SQL_INJECTION") | (F.coalesce("function", F.lit("")) == "") | F.contains(F.coalesce("text", F.lit("")), F.col("function"))
        j = f.join(n, ["key", "line"]).where(hit)
        good = F.col("node_type").isin(*PREFERRED)
        per = W.partitionBy("key", "type", "function", "line")
        kept = j.withColumn("some", F.max(good.cast("int")).over(per)).where((F.col("some") == 0) | good)
        return kept.groupBy("key", "type", "function", "line", "node_type", "graph_type", "text").agg(F.min("id").alias("id"))


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(key, source, target): each inner node (key, id, start, end; without a span none) with the first outer node of the same span, else with the smallest outer node that contains it, of equals the first.

    Equal spans meet by an equi-join; only what is left is compared with the nodes of its own text."""
    a = inner.where(F.col("start").isNotNull()).select("key", F.col("id").alias("target"), "start", "end")
    same = outer.groupBy("key", "start", "end").agg(F.min("id").alias("source"))
    j = a.join(same, ["key", "start", "end"], "left")
    exact = j.where(F.col("source").isNotNull()).select("key", "source", "target")
    o = outer.where(F.col("start").isNotNull()).select("key", F.col("id").alias("o"), F.col("start").alias("os"), F.col("end").alias("oe"))
    rest = j.where(F.col("source").isNull()).drop("source").join(o, "key").where((F.col("os") <= F.col("start")) & (F.col("oe") >= F.col("end")))
    nearest = rest.groupBy("key", "target").agg(F.min_by("o", F.struct((F.col("oe") - F.col("os")).alias("size"), "o")).alias("source"))
    return exact.unionByName(nearest.select("key", "source", "target"))
