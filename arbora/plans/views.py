"""Adapters from star-schema and text tables to files, nodes and edges, as frames and as DuckDB CTEs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(df, prefix, key, label, kind, cost, ordinal):
    return df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.col(label).cast("string").alias("label"), F.lit(kind).alias("kind"),
                     F.length(F.col(label).cast("string")).cast("long").alias("token_cost"), F.expr(cost).alias("effective_token_cost"), (F.lit(ordinal * 10**12) + F.col(key)).cast("long").alias("ordinal"))


def trade_nodes(spark: SparkSession, sf_dir: str, small: bool = False) -> DataFrame:
    """Regions, nations, suppliers, customers and, unless ``small``, parts and orders as nodes. Nodes of even
    keys cost their label's length, odd ones a tenth."""
    specs = [("region", "r", "r_regionkey", "r_name"), ("nation", "n", "n_nationkey", "n_name"), ("supplier", "s", "s_suppkey", "s_name"), ("customer", "c", "c_custkey", "c_name")]
    specs += [] if small else [("part", "p", "p_partkey", "p_name"), ("orders", "o", "o_orderkey", "o_orderpriority")]
    out = None
    for i, (name, prefix, key, label) in enumerate(specs):
        one = _node(table(spark, sf_dir, name), prefix, key, label, name, f"cast(length({label}) as double) * if({key} % 2 = 0, 1.0, 0.1)", i)
        out = one if out is None else out.unionByName(one)
    return out


def trade_edges(spark: SparkSession, sf_dir: str, small: bool = False) -> DataFrame:
    """from_id, to_id, relation, ordinal. Repeats stay: a part in several lines of an order is several edges."""
    def edge(df, fp, f, tp, t, relation, ordinal):
        return df.select(F.concat(F.lit(fp), F.col(f).cast("string")).alias("from_id"), F.concat(F.lit(tp), F.col(t).cast("string")).alias("to_id"), F.lit(relation).alias("relation"), F.expr(ordinal).cast("long").alias("ordinal"))
    out = edge(table(spark, sf_dir, "customer"), "c", "c_custkey", "n", "c_nationkey", "IN_NATION", "c_custkey")
    out = out.unionByName(edge(table(spark, sf_dir, "supplier"), "s", "s_suppkey", "n", "s_nationkey", "IN_NATION", "s_suppkey"))
    out = out.unionByName(edge(table(spark, sf_dir, "nation"), "n", "n_nationkey", "r", "n_regionkey", "IN_REGION", "n_nationkey"))
    if not small:
        lines = table(spark, sf_dir, "lineitem")
        out = out.unionByName(edge(table(spark, sf_dir, "orders"), "o", "o_orderkey", "c", "o_custkey", "PLACED_BY", "o_orderkey"))
        out = out.unionByName(edge(lines, "o", "l_orderkey", "p", "l_partkey", "CONTAINS", "l_orderkey * 10 + l_linenumber"))
        out = out.unionByName(edge(lines, "p", "l_partkey", "s", "l_suppkey", "SUPPLIED_BY", "l_orderkey * 10 + l_linenumber"))
    return out


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, conversations, pages and benchmark items as files (path, content)."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("docs/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    talks = table(spark, sf_dir, "conversations").select(F.concat(F.lit("chat/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))
    return docs.unionByName(talks).unionByName(page_files(spark, sf_dir)).unionByName(bench_files(spark, sf_dir))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("site/page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("content"))


def bench_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("bench/item_"), F.col("item_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))


def _sources(rows: DataFrame, path: str, text: str, *keys: str) -> DataFrame:
    """Files whose path and text hold the columns ``keys`` at the places $0, $1 and so on."""
    def filled(template):
        parts = re.split(r"\$(\d)", template)
        return F.concat(*[F.col(keys[int(x)]).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts)])
    return rows.select(filled(path).alias("path"), filled(text).alias("content"))


#: Texts of a region's, a nation's and a supplier's module in three languages; $0 is the key, $1 the key that it refers to.
PYTHON = ('"""Region $1."""\n\n\nclass Region$0:\n    def label(self):\n        return "$1"\n',
          "from trade.region$1 import Region$1\n\nLIMIT = $0\n\n\nclass Nation$0(Region$1):\n    def total(self):\n        return self.label()\n\n\ndef make$0():\n    return Nation$0()\n",
          "from trade.nation$1 import Nation$1 as Home, make$1\n\n\ndef describe$0(home: Home):\n    return make$1()\n\n\ndef check$0():\n    return describe$0(None)\n")
TYPESCRIPT = ('export class Region$0 {\n  label(): string {\n    return "$1";\n  }\n}\n',
              'import { Region$1 } from "./region$1";\n\nexport class Nation$0 extends Region$1 {\n  total(): number {\n    return 1;\n  }\n}\n\nexport function make$0(): Nation$0 {\n  return new Nation$0();\n}\n'
              '\nexport function pick$0(key: string): Nation$0;\nexport function pick$0(\n  key: Map<\n    string,\n    Promise<Region$1>\n  >,\n): Nation$0 {\n  const rule = /["\'`{(]+/g;\n  return `${key} ${make$0()}` && [rule].length < 2 ? make$0() : new Nation$0();\n}\n',
              'import { make$1 } from "../trade/nation$1";\n\nexport function describe$0() {\n  return make$1();\n}\n\nexport function check$0() {\n  return describe$0();\n}\n')
KOTLIN = ('package trade\n\nopen class Region$0 {\n    fun label(): String {\n        return "$1"\n    }\n}\n',
          "package trade\n\nclass Nation$0 : Region$1() {\n    fun total(): Int {\n        return 1\n    }\n}\n\nfun make$0(): Nation$0 {\n    return Nation$0()\n}\n"
          '\nfun Map<\n    String,\n    List<Nation$0>\n>.pick$0(\n    key: String,\n): Nation$0? = /* outer /* { */ make() */ this["${make$0()}"]?.first()\n',
          "package supply\n\nimport trade.make$1\n\nfun describe$0() {\n    make$1()\n}\n\nfun check$0() {\n    describe$0()\n}\n")


def sources(spark: SparkSession, sf_dir: str, texts: tuple[str, str, str], suffix: str) -> DataFrame:
    """A repository of a module for each region, nation and supplier."""
    t = lambda n: table(spark, sf_dir, n)
    region = _sources(t("region"), f"trade/region$0{suffix}", texts[0], "r_regionkey", "r_name")
    nation = _sources(t("nation"), f"trade/nation$0{suffix}", texts[1], "n_nationkey", "n_regionkey")
    return region.unionByName(nation).unionByName(_sources(t("supplier"), f"supply/supplier$0{suffix}", texts[2], "s_suppkey", "s_nationkey"))


#: The same views for DuckDB.
SQL_SMALL_NODES = """
  select 'r' || r_regionkey as id, r_name as label, 'region' as kind, r_regionkey as k, 0 as o from region union all
  select 'n' || n_nationkey, n_name, 'nation', n_nationkey, 1 from nation union all
  select 's' || s_suppkey, s_name, 'supplier', s_suppkey, 2 from supplier union all
  select 'c' || c_custkey, c_name, 'customer', c_custkey, 3 from customer"""
SQL_ALL_NODES = SQL_SMALL_NODES + """ union all
  select 'p' || p_partkey, p_name, 'part', p_partkey, 4 from part union all
  select 'o' || o_orderkey, o_orderpriority, 'orders', o_orderkey, 5 from orders"""
SQL_SMALL_EDGES = """
  select 'c' || c_custkey as from_id, 'n' || c_nationkey as to_id, 'IN_NATION' as relation, c_custkey as ordinal from customer union all
  select 's' || s_suppkey, 'n' || s_nationkey, 'IN_NATION', s_suppkey from supplier union all
  select 'n' || n_nationkey, 'r' || n_regionkey, 'IN_REGION', n_nationkey from nation"""
SQL_ALL_EDGES = SQL_SMALL_EDGES + """ union all
  select 'o' || o_orderkey, 'c' || o_custkey, 'PLACED_BY', o_orderkey from orders union all
  select 'o' || l_orderkey, 'p' || l_partkey, 'CONTAINS', l_orderkey * 10 + l_linenumber from lineitem union all
  select 'p' || l_partkey, 's' || l_suppkey, 'SUPPLIED_BY', l_orderkey * 10 + l_linenumber from lineitem"""


def graph_ctes(small: bool) -> str:
    """nodes (id, label, kind, token_cost, effective_token_cost, ordinal), edges and adj (src, dst)."""
    nodes, edges = (SQL_SMALL_NODES, SQL_SMALL_EDGES) if small else (SQL_ALL_NODES, SQL_ALL_EDGES)
    return f"""raw_nodes as ({nodes}),
nodes as (select id, label, kind, cast(length(label) as bigint) as token_cost, cast(length(label) as double) * case when k % 2 = 0 then 1.0 else 0.1 end as effective_token_cost, cast(o * 1000000000000 + k as bigint) as ordinal from raw_nodes),
edges as ({edges}),
adj as (select distinct from_id as src, to_id as dst from edges where from_id <> to_id and from_id in (select id from nodes) and to_id in (select id from nodes))"""


SQL_PAGES = "select 'site/page_' || page_id || '.html' as path, html as content from pages"
SQL_BENCH = "select 'bench/item_' || item_id || '.txt' as path, text as content from benchmark"
SQL_FILES = f"""select 'docs/' || source || '/' || lang || '/doc_' || doc_id || '.txt' as path, text as content from documents union all
  select 'chat/' || conv_id || '/' || turn || '.md', text from conversations union all {SQL_PAGES} union all {SQL_BENCH}"""
