"""More registered queries: node annotation, marks of edges, path and term scalars, exploration and removals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import config, costs, paths, terms
from ..operators import edges, enrich, exploration, index, traversal
from . import views as V
from .queries import ALL, SMALL, TOKENS, _LINES_SQL, _PATHS_SQL, _paths, query


def _key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


# Paths.
_MODULES_SQL = f"select path from ({_PATHS_SQL}) where path like '%.py' union all select 'src/pkg' || p_partkey || '/__init__.py' from part"


@query(f"""select path, case when starts_with(path, 'src/') then substr(path, 5) else path end as below,
regexp_replace(replace(regexp_replace(path, '\\.py$', ''), '/', '.'), '(^|\\.)__init__$', '') as module from ({_MODULES_SQL})""")
def path_modules(spark, sf_dir):
    inits = V.table(spark, sf_dir, "part").select(F.concat(F.lit("src/pkg"), F.col("p_partkey").cast("string"), F.lit("/__init__.py")).alias("path"))
    every = _paths(spark, sf_dir).filter("path like '%.py'").unionByName(inits)
    return every.select("path", paths.relative_to(F.col("path"), "src").alias("below"), paths.module_name(F.col("path")).alias("module"))


_CONFIGS_SQL = f"select path from ({_PATHS_SQL}) union all select 'app/build/' || p_partkey || '.yaml' from part union all select 'app/' || p_partkey || '/.env' from part"


@query(f"""select path from ({_CONFIGS_SQL}) where not list_has_any(string_split(path, '/'), ['.git', 'node_modules', 'build', 'dist', '.gradle', '.idea'])
and (regexp_matches(lower(path), '(^|/)\\.env$') or regexp_matches(lower(path), '[^/]\\.(json|yaml|yml|toml|properties)$') or regexp_matches(lower(path), '\\.gradle(\\.kts)?$'))""")
def config_files(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    more = V.table(spark, sf_dir, "part").select(F.explode(F.array(F.concat(F.lit("app/build/"), key, F.lit(".yaml")), F.concat(F.lit("app/"), key, F.lit("/.env")))).alias("path"))
    return _paths(spark, sf_dir).unionByName(more).filter(paths.is_config_file(F.col("path")))


@query("""with i as (select n_nationkey, 'trade.' || lower(r_name) || '.n' || n_nationkey as package, n_nationkey % 6 as level, case when n_nationkey % 2 = 0 then 'mod' || n_nationkey end as module from nation join region on n_regionkey = r_regionkey),
up as (select *, array_to_string(list_slice(string_split(package, '.'), 1, greatest(0, 4 - level)), '.') as base from i)
select n_nationkey, case when level = 0 then module when level > 4 then null when base = '' then coalesce(module, '') when module is null then base else base || '.' || module end as target from up""")
def relative_imports(spark, sf_dir):
    """Targets of imports that climb none to five levels from packages of three names."""
    t = lambda n: V.table(spark, sf_dir, n)
    rows = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    package = F.concat(F.lit("trade."), F.lower("r_name"), F.lit(".n"), F.col("n_nationkey").cast("string"))
    module = F.when(F.col("n_nationkey") % 2 == 0, _key("mod", "n_nationkey"))
    return rows.select("n_nationkey", paths.relative_import(package, (F.col("n_nationkey") % 6).cast("int"), module).alias("target"))


# Terms, keys and costs.
@query("""with f as (select c_custkey, ['# ' || c_name, 'nation.key = ' || c_nationkey, 'segment: ' || c_mktsegment, 'balance=' || c_custkey] as l from customer),
k as (select c_custkey, unnest(l) as text, unnest(range(1, 5)) as line from f)
select c_custkey, regexp_extract(text, '^\\s*([A-Za-z_][A-Za-z0-9_.-]*)\\s*=', 1) as key, cast(line as int) as line from k where text not like '#%' and regexp_matches(text, '^\\s*([A-Za-z_][A-Za-z0-9_.-]*)\\s*=')""")
def property_key_lines(spark, sf_dir):
    """Keys of a properties file for each customer with their lines; a colon makes no key there."""
    c = V.table(spark, sf_dir, "customer")
    text = F.concat(F.lit("# "), "c_name", F.lit("\nnation.key = "), F.col("c_nationkey").cast("string"), F.lit("\nsegment: "), "c_mktsegment", F.lit("\nbalance="), F.col("c_custkey").cast("string"), F.lit("\n"))
    files = c.select(F.concat(F.col("c_custkey").cast("string"), F.lit(".properties")).alias("path"), text.alias("content"))
    return config.config_keys(files).select(F.regexp_replace("path", r"\.properties$", "").cast("long").alias("c_custkey"), "key", F.col("line").cast("int").alias("line"))


@query("""select n_nationkey, unnest(['name', 'region', 'key', 'deep', 'name']) as key, unnest([1, 2, 3, 4, 1]) as line, unnest([0, 1, 2, 3, 4]) as at from nation""")
def json_key_lines(spark, sf_dir):
    """Keys of nested JSON, outer before inner; a key that repeats has the line of its first place."""
    n = V.table(spark, sf_dir, "nation")
    text = F.concat(F.lit('{"name": "'), "n_name", F.lit('",\n"region": {\n"key": '), F.col("n_regionkey").cast("string"), F.lit(',\n"deep": [{"name": 1}]}}'))
    files = n.select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".json")).alias("path"), text.alias("content"))
    return config.config_keys(files).select(F.regexp_replace("path", r"\.json$", "").cast("int").alias("n_nationkey"), "key", F.col("line").cast("int").alias("line"), F.col("index").cast("int").alias("at"))


def _line_places(spark, sf_dir):
    """Line items as occurrences: one term an order status and return flag, a file for each part."""
    rows = V.table(spark, sf_dir, "lineitem")
    place = F.struct(F.concat(F.lit("t/"), F.col("l_partkey").cast("string"), F.lit(".py")).alias("file_path"), F.col("l_linenumber").cast("int").alias("line"), F.col("l_orderkey").cast("int").alias("col"),
                     F.col("l_returnflag").alias("matched_text"), F.lit("code").alias("context"), _key("s", "l_suppkey").alias("enclosing_node_id"))
    return rows.select(F.concat("l_returnflag", "l_linestatus").alias("term"), "l_orderkey", place.alias("o"))


_PLACES_SQL = "places as (select l_returnflag || l_linestatus as term, l_orderkey, 't/' || l_partkey || '.py' as file_path, cast(l_linenumber as int) as line, cast(l_orderkey as int) as col, l_returnflag as matched_text, 's' || l_suppkey as node from lineitem)"


@query(f"""with {_PLACES_SQL} select l_orderkey, sha256(string_agg(concat_ws('|', file_path, line, col, matched_text, 'code', node), chr(10) order by file_path, line, col, matched_text, node)) as digest from places group by l_orderkey""")
def occurrence_digests(spark, sf_dir):
    """The digest of an order's line items, taken as places in their order."""
    grouped = _line_places(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("o")).alias("o"))
    return grouped.select("l_orderkey", terms.occurrence_digest(F.col("o")).alias("digest"))


@query(f"""with {ALL} select id, case when ordinal % 3 = 0 then label when ordinal % 3 = 1 then kind else id end as name from nodes""")
def display_names(spark, sf_dir):
    nodes = V.trade_nodes(spark, sf_dir)
    turn = F.col("ordinal") % 3
    return nodes.select("id", costs.display_name(F.when(turn == 0, F.col("label")).when(turn == 1, ""), F.when(turn < 2, F.col("kind")), F.col("id")).alias("name"))


@query("""select c_custkey, case when c_custkey % 3 > 0 then c_custkey % 3 when c_nationkey % 2 = 0 then greatest(1, ceil(length(c_name) / 4.0))
else ceil(length('{"label": "' || c_name || '", "title": "' || c_mktsegment || '", "metadata": {}}') / 4.0) end::bigint as token_cost from customer""")
def node_token_costs(spark, sf_dir):
    """A node's own estimate, else its source's, else its label's, title's and metadata's."""
    own = F.struct((F.col("c_custkey") % 3).alias("token_estimate"))
    source = F.when(F.col("c_nationkey") % 2 == 0, F.col("c_name"))
    return V.table(spark, sf_dir, "customer").select("c_custkey", costs.node_token_cost(own, source, F.col("c_name"), F.col("c_mktsegment"), F.lit("{}")).alias("token_cost"))


@query(f"""with l as ({_LINES_SQL.format(V.SQL_PAGES)} union all {_LINES_SQL.format(V.SQL_BENCH)}), t(term) as (values ('<'), ('><'), ('/'), (', ')),
r as (select path, line, unnest(regexp_extract_all(chr(1) || text || chr(1), '[^A-Za-z0-9_]+')) as run from l), inner_runs as (select path, line, substr(run, 2, length(run) - 2) as run from r where length(run) > 2)
select term, path, cast(line as int) as line, cast(sum(length(run) - length(replace(run, term, ''))) // length(term) as bigint) as n from inner_runs cross join t where contains(run, term) group by term, path, line""")
def sign_occurrences(spark, sf_dir):
    """Places of terms without words, in pages and benchmark items, by line; a place next to a word doesn't count."""
    signs = spark.createDataFrame([("<",), ("><",), ("/",), (", ",)], "term string")
    return index.counts(signs, V.page_files(spark, sf_dir).unionByName(V.bench_files(spark, sf_dir)))


# Nodes and edges.
@query(f"""with c as (select 'S' || s_suppkey as id, s_nationkey as n, s_suppkey % 3 as g from supplier), y as (select 'C' || c_custkey as id, c_nationkey as n, c_custkey % 3 as g from customer)
select distinct c.id as from_id, y.id as to_id, 'IMPLEMENTED_BY' as relation, 'exact' as resolution from c join y on c.n = y.n and c.g = y.g""")
def implemented_by(spark, sf_dir):
    made = lambda name, prefix, key, nation: V.table(spark, sf_dir, name).select(_key(prefix, key).alias("id"), F.col(nation).alias("n"), (F.col(key) % 3).alias("g"))
    return edges.implemented_by(made("supplier", "S", "s_suppkey", "s_nationkey"), made("customer", "C", "c_custkey", "c_nationkey"), ["n", "g"], "exact")


@query(f"""with {ALL} select id, label, case when ordinal % 2 = 0 then 'framework' end as origin from nodes""")
def language_nodes(spark, sf_dir):
    """Nodes of even numbers are known; of all nodes only the others are added."""
    nodes = V.trade_nodes(spark, sf_dir).select("id", "label", "ordinal")
    known = nodes.filter("ordinal % 2 = 0").drop("ordinal").withColumn("origin", F.lit("framework"))
    return edges.language_nodes_added(known, nodes.drop("ordinal"))


@query("select event_id, event_type as name from events order by event_id limit 20")
def first_unresolved_calls(spark, sf_dir):
    calls = V.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("name"))
    return edges.unresolved_calls(calls, 20, "event_id")[1]


@query(f"""with {ALL}, spans as (select id, 't/' || kind as file, cast(ordinal % 1000000000000 + 1 as int) as line, kind from nodes where kind <> 'part'), known as (select id from nodes where kind <> 'customer'),
e as (select from_id, to_id, relation, cast(ordinal as bigint) as ordinal, from_id in (select id from known) as k from edges),
p as (select e.*, case when k then a.file else b.file end as file, case when k then a.line else b.line end as line from e left join (select * from spans where kind <> 'customer') a on a.id = from_id left join (select * from spans where kind <> 'customer') b on b.id = to_id)
select from_id, to_id, relation, ordinal, 'framework_inferred' as confidence, case when ordinal % 2 = 0 then 'ambiguous' else 'unique_name' end as resolution, coalesce(file, '<framework-inference>') as file, case when file is null then 1 else line end as line,
case when relation = 'IN_NATION' then 'trade.in_nation' end as rule from p""")
def marked_edges(spark, sf_dir):
    """Edges with confidence, resolution, evidence and rule: parts have no span, customers are unknown."""
    span = F.struct(F.concat(F.lit("t/"), "kind").alias("file_path"), (F.col("ordinal") % 10**12 + 1).cast("int").alias("start_line"))
    nodes = V.trade_nodes(spark, sf_dir).filter("kind <> 'customer'").select("id", F.when(F.col("kind") != "part", span).alias("span"))
    evidence = "struct<file_path:string,start_line:int,end_line:int,start_col:int,end_col:int>"
    even = F.col("ordinal") % 2 == 0
    made = V.trade_edges(spark, sf_dir).select("from_id", "to_id", "relation", "ordinal", F.lit("x").alias("confidence"), F.when(even, "ambiguous").alias("resolution"), F.when(even, F.array(F.lit("c"))).otherwise(F.array().cast("array<string>")).alias("candidates"),
                                               F.lit(None).cast(evidence).alias("evidence"), F.lit(None).cast("string").alias("metadata"))
    out = enrich.mark_edges(made, nodes, {"IN_NATION": "unique"}, "trade")
    return out.select("from_id", "to_id", "relation", "ordinal", "confidence", "resolution", F.col("evidence.file_path").alias("file"), F.col("evidence.start_line").alias("line"), F.get_json_object("metadata", "$.framework_rule.id").alias("rule"))


@query(f"""with n as (select page_id, 'site/page_' || page_id || '.html' as path, page_id % 3 as line, list_slice(string_split(html, chr(10)), page_id % 3, page_id % 3)[1] as text from pages)
select 'p' || page_id as id, case when line > 0 then path end as file, cast(line as int) as line, case when line > 0 then {TOKENS.format("coalesce(text, '')")} else 0 end as token_estimate,
case when page_id % 2 = 0 then 'repo' else 'given' end as provenance, 'html' as language, 'page' as kind, case when line = 0 then null when page_id % 2 = 0 then 'site.page' || page_id else 'page' || page_id end as symbol_path from n""")
def annotated_nodes(spark, sf_dir):
    """Nodes of pages at lines 1 and 2 get span, cost and symbol path; those at line 0 have no place."""
    pages = V.table(spark, sf_dir, "pages")
    key, even = F.col("page_id").cast("string"), F.col("page_id") % 2 == 0
    meta = F.to_json(F.struct(F.concat(F.lit("/repo/site/page_"), key, F.lit(".html")).alias("file_path"), (F.col("page_id") % 3).alias("line_number"), F.when(even, "site").alias("module")))
    span = "struct<file_path:string,start_line:int,end_line:int,start_col:int,end_col:int>"
    nodes = pages.select(_key("p", "page_id").alias("id"), F.concat(F.lit("page"), key).alias("label"), F.lit("page").alias("category"), meta.alias("metadata"), F.when(even, "").otherwise("given").alias("provenance"),
                         F.lit(None).cast("string").alias("language"), F.lit("").alias("kind"), F.lit(None).cast("string").alias("symbol_path"), F.lit(None).cast(span).alias("span"), F.lit(None).cast("struct<token_estimate:bigint,char_count:bigint,line_count:bigint>").alias("cost"))
    out = enrich.annotate_nodes(nodes, V.page_files(spark, sf_dir), "/repo", "repo", "html")
    return out.select("id", F.col("span.file_path").alias("file"), F.coalesce("span.start_line", F.lit(0)).alias("line"), F.coalesce("cost.token_estimate", F.lit(0)).alias("token_estimate"), "provenance", "language", "kind", "symbol_path")


# Exploration.
@query(f"select path from ({_PATHS_SQL}) where len(list_filter(string_split(lower(path), '/'), lambda p: p = 'test' or list_contains(regexp_extract_all(p, '[a-z0-9]+'), 'test'))) > 0")
def path_search(spark, sf_dir):
    return exploration.path_search(_paths(spark, sf_dir), "Test")


@query(f"select string_split(substr(path, 6), '/')[1] as name, count(*) as files from ({_PATHS_SQL}) where starts_with(path, 'docs/') group by 1")
def directory_listing(spark, sf_dir):
    return exploration.directory_listing(_paths(spark, sf_dir), "docs")


@query(f"with {_PLACES_SQL} select term, node as node_id, count(*) as n, min(line) as first_line from places group by all")
def occurrence_hints(spark, sf_dir):
    return exploration.hints(_line_places(spark, sf_dir))


@query(f"""with {_PLACES_SQL}, r as (select *, row_number() over (partition by term order by file_path, line, col) as rank, count(*) over (partition by term) > 100 as truncated from places)
select term, file_path, line, col, cast(rank as int) as rank, truncated from r where rank <= 100""")
def capped_occurrences(spark, sf_dir):
    """A report of the first hundred places of a term: the cap is the feature."""
    out = exploration.capped(_line_places(spark, sf_dir), 100)
    return out.select("term", "o.file_path", "o.line", "o.col", F.col("rank").cast("int").alias("rank"), "truncated")


@query(f"""with l as ({_LINES_SQL.format(V.SQL_FILES)}), one as (select path, line, text from l where regexp_matches(text, '^[A-Za-z0-9_]+')), o as (select regexp_extract(text, '^[A-Za-z0-9_]+') as term, path, text from one),
f as (select term, 'folder' as kind, string_split(path, '/')[1] as value from o union all select term, 'suffix', regexp_extract(lower(path), '\\.[a-z]+$') from o union all select term, 'pair', regexp_extract(substr(text, length(term) + 1), '^[^A-Za-z0-9_]+([A-Za-z0-9_]+)', 1) from o),
c as (select term, kind, value, count(*) as n from f where value <> '' group by all), total as (select term, count(*) as total from o group by term)
select term, kind, value, n, round(n / total, 12) as share from c join total using (term) where n < total""")
def query_refinements(spark, sf_dir):
    """Narrower queries of the words that lines of all files begin with."""
    first = F.regexp_extract("text", "^[A-Za-z0-9_]+", 0)
    found = index.lines(V.doc_files(spark, sf_dir)).withColumn("term", first).filter("term <> ''")
    places = found.select("term", "text", F.struct(F.col("path").alias("file_path"), "line", F.lit(0).alias("col")).alias("o"))
    return exploration.refinements(places).withColumn("share", F.round("share", 12))


@query("""with used as (select 'u' || user_id as path, event_type as term from events), led as (select distinct 'u' || c_custkey as path, lower(c_mktsegment) as term from customer), declared as (select distinct event_type as term from events where event_id % 50 = 0),
s as (select path, term, 'edge_target' as signal from led union select path, term, 'used_often' from used group by path, term having count(*) >= 2 union select path, term, 'undeclared' from used where term not in (select term from declared))
select path, term, string_agg(distinct signal, ',' order by signal) as signals from s group by path, term""")
def read_signals(spark, sf_dir):
    events = V.table(spark, sf_dir, "events")
    used = events.select(_key("u", "user_id").alias("path"), F.col("event_type").alias("term"))
    led = V.table(spark, sf_dir, "customer").select(_key("u", "c_custkey").alias("path"), F.lower("c_mktsegment").alias("term"))
    declared = events.filter("event_id % 50 = 0").select(F.col("event_type").alias("term"))
    return exploration.read_signals(used, led, declared).withColumn("signals", F.array_join("signals", ","))


@query("select r_name || '/' || n_name || '/README.md' as path, 3 as depth from nation join region on n_regionkey = r_regionkey union all select r_name || '/AGENTS.md', 2 from region")
def entry_documents(spark, sf_dir):
    t = lambda n: V.table(spark, sf_dir, n)
    own = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("/", "r_name", "n_name", F.lit("README.md")).alias("path"))
    files = own.unionByName(t("region").select(F.concat_ws("/", "r_name", F.lit("AGENTS.md")).alias("path"))).unionByName(t("region").select(F.concat_ws("/", "r_name", F.lit("notes.md")).alias("path")))
    return exploration.entry_documents(files)


@query("""select 'c' || o_custkey as scenario, o_orderpriority as policy, min(case when o_orderstatus = 'O' then cast(o_orderkey as double) end) as least, round(avg(case when o_orderstatus = 'O' then cast(o_orderkey as double) end), 6) as expected,
max(case when o_orderstatus = 'O' then cast(o_orderkey as double) end) as greatest, round(avg(case when o_orderstatus = 'O' then 1.0 else 0.0 end), 9) as found_share from orders group by all""")
def exploration_cost_range(spark, sf_dir):
    """Orders as runs: found if open, at the cost of their number."""
    runs = V.table(spark, sf_dir, "orders").select(_key("c", "o_custkey").alias("scenario"), F.col("o_orderpriority").alias("policy"), (F.col("o_orderstatus") == "O").alias("found"), F.col("o_orderkey").cast("double").alias("cost"))
    return exploration.cost_range(runs).withColumn("expected", F.round("expected", 6)).withColumn("found_share", F.round("found_share", 9))


_ZONE_SQL = f"""{SMALL}, used as (select distinct to_id as src, from_id as dst from edges where relation <> 'IN_NATION' or from_id like 's%'), z1 as (select src as changed, dst as affected, 1 as depth from used where src like 'r%'),
zone as (select * from z1 union all select z1.changed, used.dst, 2 from z1 join used on used.src = z1.affected)"""


def _zone(spark, sf_dir):
    made = V.trade_edges(spark, sf_dir, True).withColumn("relation", F.when((F.col("relation") == "IN_NATION") & F.col("from_id").startswith("c"), "CONTAINS").otherwise("CALLS"))
    return exploration.zone_of_effect(made, V.trade_nodes(spark, sf_dir, True).filter("kind = 'region'"))


@query(f"with {_ZONE_SQL} select changed, affected, depth from zone")
def zone_of_effect(spark, sf_dir):
    """What a change of a region reaches by typed edges; customers hang on an edge that doesn't count."""
    return _zone(spark, sf_dir)


@query(f"with {_ZONE_SQL} select changed, affected, depth, cast(row_number() over (partition by changed order by depth, effective_token_cost, affected) as int) as rank from zone join nodes on id = affected")
def zone_accessibility(spark, sf_dir):
    prices = V.trade_nodes(spark, sf_dir, True).select("id", F.col("effective_token_cost").alias("cost"))
    return exploration.accessibility(_zone(spark, sf_dir), prices).select("changed", "affected", "depth", F.col("rank").cast("int").alias("rank"))


@query(f"""with {ALL}, gone as (select id from nodes where kind = 'supplier' and ordinal % 5 = 0) select 'node' as what, id as a, '' as b, 0 as ordinal from nodes where id not in (select id from gone)
union all select relation, from_id, to_id, cast(ordinal as bigint) from edges where from_id not in (select id from gone) and to_id not in (select id from gone)""")
def graph_without(spark, sf_dir):
    """The graph after every fifth supplier is taken away."""
    nodes, all_edges = V.trade_nodes(spark, sf_dir), V.trade_edges(spark, sf_dir)
    kept, rest = exploration.without(nodes, all_edges, nodes.filter("kind = 'supplier' and ordinal % 5 = 0"))
    return kept.select(F.lit("node").alias("what"), F.col("id").alias("a"), F.lit("").alias("b"), F.lit(0).cast("long").alias("ordinal")).unionByName(
        rest.select(F.col("relation").alias("what"), F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.col("ordinal").cast("long").alias("ordinal")))


@query("""with recursive s as (select 'o' || l_orderkey as f, l_linenumber as ln, cast(l_quantity as bigint) as q, row_number() over (partition by l_orderkey order by l_linenumber, cast(l_quantity as bigint)) as i from lineitem),
pack as (select f, i, ln, q, 0 as unit, q as used from s where i = 1 union all select s.f, s.i, s.ln, s.q, case when p.used + s.q > 60 then p.unit + 1 else p.unit end, case when p.used + s.q > 60 then s.q else p.used + s.q end from pack p join s on s.f = p.f and s.i = p.i + 1)
select f as file_path, cast(unit as int) as unit, f || ':' || ln as id, q as tokens from pack""")
def read_units(spark, sf_dir):
    """An order's line items as a file's symbols, packed into units of at most sixty tokens."""
    line = V.table(spark, sf_dir, "lineitem")
    path = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))
    symbols = line.select(path.alias("file_path"), F.concat_ws(":", path, F.col("l_linenumber").cast("string")).alias("id"), F.col("l_linenumber").alias("start_line"), F.col("l_quantity").cast("bigint").alias("tokens"))
    return exploration.read_units(symbols, 60)


@query("""with pair as (select coalesce(a.s_suppkey, b.s_suppkey) as k, a.s_suppkey is null as gone, b.s_suppkey is null as fresh, coalesce(a.s_nationkey, b.s_nationkey) % 2 = 0 as even, coalesce(a.s_acctbal, b.s_acctbal) < 5000 as low, length(coalesce(a.s_name, b.s_name)) as n
from (select * from supplier where s_nationkey <> 7) a full join (select * from supplier where s_acctbal >= 0) b on a.s_suppkey = b.s_suppkey)
select 'readable_nodes' as section, 's' || k as id, case when gone then 'removed' when fresh then 'added' else 'changed' end as status,
case when gone or fresh then '' else concat_ws('; ', case when even then 'flags:[]>["x"]' end, case when low then 'read_cost.token_estimate:' || n || '>' || (n + 1) end) end as fields from pair where gone or fresh or even or low
union all select 'query_nodes', 'n' || n_nationkey, 'changed', 'excluded:false>true; rule_id:null>r' from nation where n_regionkey = 1""")
def view_diff(spark, sf_dir):
    """Two views compared in all three sections, nested fields and arrays among them; the links are the same in both."""
    from ..operators import diff

    t = lambda n: V.table(spark, sf_dir, n)
    none, number = F.array().cast("array<string>"), lambda n: F.lit(n)

    def readable(rows, cost, flags):
        return rows.select(_key("s", "s_suppkey").alias("id"), F.struct(cost.alias("token_estimate")).alias("read_cost"), flags.alias("flags"), number(1).alias("start_line"), number(2).alias("end_line"))

    def queries(changed):
        mine = (F.col("n_regionkey") == 1) & F.lit(changed)
        return t("nation").select(_key("n", "n_nationkey").alias("id"), F.array(_key("r", "n_regionkey")).alias("arrival_node_ids"), number(3).alias("output_tokens"), mine.alias("excluded"), none.alias("origin_node_ids"), F.lit("d").alias("occurrence_digest"),
                                  none.alias("clue_kinds"), F.when(mine, "r").alias("rule_id"), none.alias("source_terms"))
    links = t("region").select(_key("r", "r_regionkey").alias("id"), none.alias("to_node_ids"), F.lit("unique").alias("specificity"), F.lit(None).cast("string").alias("query_id"), F.col("r_name").alias("evidence_file"), number(1).alias("evidence_line"), F.lit("exact").alias("resolution"), none.alias("candidate_node_ids"))
    size, low = F.length("s_name"), F.when(F.col("s_acctbal") < 5000, 1).otherwise(0)
    before = {"readable_nodes": readable(t("supplier").filter("s_acctbal >= 0"), size, none), "query_nodes": queries(False), "framework_links": links}
    after = {"readable_nodes": readable(t("supplier").filter("s_nationkey <> 7"), size + low, F.when(F.col("s_nationkey") % 2 == 0, F.array(F.lit("x"))).otherwise(none)), "query_nodes": queries(True), "framework_links": links}
    shown = lambda f: F.concat(f["field"], F.lit(":"), F.coalesce(f["before"], F.lit("null")), F.lit(">"), F.coalesce(f["after"], F.lit("null")))
    out = None
    for section, found in diff.diff_views(before, after).items():
        part = found.select(F.lit(section).alias("section"), "id", "status", F.array_join(F.transform("fields", shown), "; ").alias("fields"))
        out = part if out is None else out.unionByName(part)
    return out
