"""Graphs of TypeScript, JavaScript and Kotlin files.

The parsers give facts of one form for these languages, a file at a time; :class:`BraceGraph` joins them into nodes
and edges.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.costs import cost_for_span, cost_for_text
from ...functions.paths import TYPESCRIPT_SUFFIXES, path_flags
from ...session import staged
from .kotlin import Kotlin
from .typescript import TypeScript

FACTS = "path string, language string, kind string, owner string, id string, name string, detail string, source string, line int, end_line int, exported boolean, signature string, seq bigint"
COLUMNS = [c.split()[0] for c in FACTS.split(", ")]


def file_facts(path: str, text: str) -> list[tuple]:
    return (Kotlin if path.endswith((".kt", ".kts")) else TypeScript)(path, text or "").rows


def facts(files: DataFrame) -> DataFrame:
    """Facts of TypeScript, JavaScript and Kotlin files among ``files`` (path, content)."""
    def parse(frames):
        for frame in frames:
            rows = [r for p, c in zip(frame["path"], frame["content"]) for r in file_facts(p, c)]
            yield pd.DataFrame(rows, columns=COLUMNS).astype({"line": "int32", "end_line": "int32", "exported": "boolean", "seq": "int64"})
    return files.select("path", "content").mapInPandas(parse, FACTS)


class BraceGraph:
    """Nodes and edges of TypeScript or Kotlin files."""

    def __init__(self, files: DataFrame):
        from ...operators.resolve import simple_names

        self.files = files
        self.facts = staged(facts(files), "brace-facts")
        self.symbols = staged(self.kind("symbol").dropDuplicates(["id"]), "brace-symbols")
        self.simple = staged(simple_names(self.symbols), "brace-simple")
        self.resolved = staged(self._imports(), "brace-imports")
        top = self.symbols.filter(F.col("owner") == F.concat(F.when(F.col("language") == "kotlin", "kotlin:").otherwise("ts:"), "path"))
        self.top = top.groupBy("path", "name").agg(F.min_by(F.struct("id", "exported", "detail"), "seq").alias("s")).select("path", "name", "s.*")
        self.names = staged(self._names(), "brace-names")

    def kind(self, name: str) -> DataFrame:
        return self.facts.filter(F.col("kind") == name)

    def _imports(self) -> DataFrame:
        """path, source, target: the file that a relative import names, by the first existing candidate."""
        used = self.kind("import").select("path", F.col("name").alias("source")).unionByName(self.kind("dynamic_import").select("path", F.col("name").alias("source"))).filter("source like '.%'").distinct()
        folder = F.regexp_replace("path", "[^/]*$", "")
        raw = F.concat(folder, "source")

        def step(acc, part):
            return F.when((part == "") | (part == "."), acc).when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(part)))
        base = F.array_join(F.aggregate(F.split(raw, "/"), F.array().cast("array<string>"), step), "/")
        stem = F.regexp_replace(base, r"\.(m|c)?(js|ts)x?$", "")
        tries = F.concat(F.array(base), F.array(*[F.concat(base, F.lit(s)) for s in TYPESCRIPT_SUFFIXES]), F.array(*[F.concat(stem, F.lit(s)) for s in TYPESCRIPT_SUFFIXES]), F.array(*[F.concat(base, F.lit(f"/index{s}")) for s in TYPESCRIPT_SUFFIXES]))
        options = used.select("path", "source", F.posexplode(tries).alias("rank", "target"))
        return options.join(self.files.select(F.col("path").alias("target")), "target").groupBy("path", "source").agg(F.min_by("target", "rank").alias("target"))

    def _names(self) -> DataFrame:
        """path, name, id: own top-level symbols, else what an import binds."""
        own = self.top.select("path", "name", "id", F.lit(0).alias("rank"))
        b = self.kind("binding").join(self.resolved, ["path", "source"])
        exported = self.top.filter("exported").select(F.col("path").alias("target"), F.col("name").alias("detail"), F.col("id"))
        direct = b.filter("detail not in ('*', 'default')").join(exported, ["target", "detail"]) if "id" not in b.columns else b.drop("id").filter("detail not in ('*', 'default')").join(exported, ["target", "detail"])
        r = self.kind("reexport").select(F.col("path").alias("target"), F.col("name").alias("local"), F.col("detail").alias("real"), F.col("source").alias("via")).join(self.resolved.select(F.col("path").alias("target"), F.col("source").alias("via"), F.col("target").alias("far")), ["target", "via"])
        deep = exported.select(F.col("target").alias("far"), F.col("detail").alias("found"), "id")
        chained = b.drop("id").join(r, "target").join(deep, "far").filter(((F.col("local") == F.col("detail")) & (F.col("found") == F.col("real"))) | ((F.col("local") == "*") & (F.col("found") == F.col("detail"))))
        only = exported.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("only"))
        marked = self.kind("default").select(F.col("path").alias("target"), F.col("id").alias("marked"))
        default = b.drop("id").filter("detail = 'default'").join(marked, "target", "left").join(only, "target", "left").select("path", "name", F.coalesce("marked", F.when(F.col("n") == 1, F.col("only"))).alias("id")).filter("id is not null")
        kotlin = self.kind("binding").drop("id").filter("language = 'kotlin'").join(self.simple.select(F.col("name").alias("detail"), F.col("first").alias("id")), "detail")
        every = own
        for rank, df in enumerate((direct, chained, default, kotlin), 1):
            every = every.unionByName(df.select("path", "name", "id", F.lit(rank).alias("rank")))
        return every.groupBy("path", "name").agg(F.min_by("id", F.struct("rank", "id")).alias("id"))

    def named(self, rows: DataFrame) -> DataFrame:
        from ...operators.resolve import PythonGraph

        rows = rows.drop("id")
        out = rows.join(self.names.select("path", "name", F.col("id").alias("exact")), ["path", "name"], "left").join(self.simple, "name", "left")
        return PythonGraph._ranked(out, F.when(F.col("language") != "kotlin", F.col("exact")))

    def nodes(self) -> DataFrame:
        body = self.files.select("path", "content")
        span = F.struct(F.col("path").alias("file_path"), F.col("line").alias("start_line"), "end_line", F.lit(0).alias("start_col"), F.lit(0).alias("end_col"))
        crowd = self.symbols.groupBy("name").agg(F.when(F.max("language") == "kotlin", F.count("*")).otherwise(F.countDistinct("path")).alias("scopes"))
        none = F.array().cast("array<string>")
        dynamic = self.kind("dynamic_import").select("path").distinct().withColumn("dynamic", F.array(F.lit("dynamic_import")))
        barrel = self.kind("barrel").select("path").distinct().withColumn("barrel", F.array(F.lit("reexport")))
        of_path = F.concat(path_flags(F.col("path")), F.coalesce("barrel", none))
        f = self.kind("file").join(body, "path").join(dynamic, "path", "left").join(barrel, "path", "left").select("id", F.col("path").alias("label"), F.lit("file").alias("kind"), span.alias("span"), cost_for_text(F.col("content")).alias("cost"), "signature", "exported",
                                                                                    F.col("path").alias("symbol_path"), F.concat(of_path, F.coalesce("dynamic", none)).alias("flags"), "language", "path", "seq")
        s = self.symbols.join(body, "path").join(crowd, "name").join(barrel, "path", "left").select("id", F.col("name").alias("label"), F.col("detail").alias("kind"), span.alias("span"), cost_for_span(F.col("content"), F.col("line"), F.col("end_line")).alias("cost"), "signature", "exported",
                                                                       F.concat_ws(":", "path", F.regexp_extract("id", "#(.*)$", 1)).alias("symbol_path"), F.concat(of_path, F.when(F.col("scopes") > 1, F.array(F.lit("ambiguous_name"))).otherwise(none)).alias("flags"), "language", "path", "seq")
        p = self.kind("package").select("id", "name").distinct().select("id", F.col("name").alias("label"), F.lit("module").alias("kind"), F.lit(None).cast(f.schema["span"].dataType).alias("span"), cost_for_text(F.col("name")).alias("cost"),
                                                                        F.lit(None).cast("string").alias("signature"), F.lit(None).cast("boolean").alias("exported"), F.col("name").alias("symbol_path"), none.alias("flags"), F.lit("kotlin").alias("language"), F.lit("").alias("path"), F.lit(0).cast("bigint").alias("seq"))
        return f.unionByName(s).unionByName(p).withColumn("provenance", F.concat("language", F.lit("-core")))

    def edges(self) -> DataFrame:
        """All edges; repeats add to the weight."""
        from ...operators.edges import merge_edges, valid_edges
        from ...operators.resolve import _site

        sure = [F.lit("static_certain").alias("confidence"), F.lit("exact").alias("resolution"), F.array().cast("array<string>").alias("candidates")]
        kinds = self.symbols.select(F.col("id").alias("target"), F.col("detail").alias("target_kind"))

        def rows(df, start, end, relation, how=sure, order=0):
            return df.select(F.col(start).alias("from_id"), F.col(end).alias("to_id"), relation.alias("relation"), *how, _site(F.col("path"), F.col("line")).alias("evidence"), F.struct(F.lit(order).alias("step"), "path", "seq").alias("ordinal"))
        found, lit = ["confidence", "resolution", "candidates"], F.lit
        file_id = F.concat(F.when(F.col("path").rlike(r"\.kts?$"), "kotlin:").otherwise("ts:"), "path")
        own = self.symbols.withColumn("is_top", F.col("owner") == file_id)
        top = F.when(~F.col("is_top"), "CONTAINS").when((F.col("language") != "kotlin") & F.col("exported"), "EXPORTS").otherwise("DECLARES")
        imports = self.kind("import").withColumn("source", F.col("name")).join(self.resolved, ["path", "source"]).withColumn("to", F.concat(F.lit("ts:"), "target"))
        bound = self.kind("binding").drop("id").join(self.names.select("path", "name", F.col("id").alias("target")), ["path", "name"])
        of_file = self.symbols.select(F.col("id").alias("target"), F.col("path").alias("home"))
        ts_bound = bound.filter("language <> 'kotlin' and detail not in ('*', 'default')")
        kt_bound = bound.filter("language = 'kotlin'").join(of_file, "target").withColumn("to", F.concat(F.lit("kotlin:"), "home"))
        inferred = [lit("static_inferred").alias("confidence"), lit("unique_name").alias("resolution"), F.array().cast("array<string>").alias("candidates")]
        again = self.kind("reexport").join(self.resolved.select("path", "source", F.col("target").alias("far")), ["path", "source"])
        exported = self.top.filter("exported").select(F.col("path").alias("far"), F.col("name").alias("real"), F.col("id").alias("target"))
        again = again.join(exported, "far").filter((F.col("name") == "*") | (F.col("detail") == F.col("real")))
        bases = self.named(self.kind("base")).join(kinds, "target", "left").join(self.symbols.select(F.col("id").alias("owner"), F.col("detail").alias("own_kind")), "owner")
        up = F.when(F.col("detail") != "SUPER", F.col("detail")).when((F.col("target_kind") == "interface") & (F.col("own_kind") == "class"), "IMPLEMENTS").otherwise("INHERITS")
        typed = self.named(self.kind("annotation")).join(kinds.filter("target_kind in ('class', 'interface', 'enum', 'type_alias')"), "target")
        refs = self._references().filter("target is not null").join(kinds, "target", "left")
        call = F.when(F.col("detail") == "new", "INSTANTIATES").when((F.col("detail") == "call") & (F.col("target_kind") == "class"), "INSTANTIATES").when(F.col("detail") == "call", "CALLS").when(F.col("detail") == "write", "WRITES").when(
            F.col("target_kind").isin("constant", "field", "function", "class", "enum", "method") & F.col("target_kind").isin("constant", "field", "enum"), "READS")
        every = [rows(own, "owner", "id", top, order=1), rows(self.kind("package"), "id", "owner", lit("CONTAINS"), order=0), rows(imports, "owner", "to", lit("IMPORTS"), order=2), rows(ts_bound, "owner", "target", lit("IMPORTS_SYMBOL"), order=3),
                 rows(kt_bound, "owner", "target", lit("IMPORTS_SYMBOL"), inferred, 3), rows(kt_bound, "owner", "to", lit("IMPORTS"), inferred, 3), rows(again, "owner", "target", lit("RE_EXPORTS"), order=4),
                 rows(self.kind("dynamic_import").withColumn("source", F.col("name")).join(self.resolved, ["path", "source"]).withColumn("to", F.concat(F.lit("ts:"), "target")), "owner", "to", lit("IMPORTS"), [lit("dynamic_required").alias("confidence"), *sure[1:]], 5),
                 rows(bases, "owner", "target", up, found, 6), rows(typed, "owner", "target", lit("TYPE_USES"), found, 7), rows(refs.withColumn("rel", call).filter("rel is not null"), "owner", "target", F.col("rel"), found, 8)]
        out = every[0]
        for e in every[1:]:
            out = out.unionByName(e)
        return merge_edges(valid_edges(out, self.nodes().select("id")))

    def _references(self) -> DataFrame:
        """References: this to the own class's member, or its base's; a namespace import to the file's symbol;
        else by name."""
        r = self.named(self.kind("reference"))
        member = self.symbols.select(F.col("owner").alias("class"), "name", F.col("id").alias("mine"))
        inside = self.symbols.select(F.col("id").alias("owner"), F.col("owner").alias("class"))
        base = self.named(self.kind("base")).filter("target is not null").select(F.col("owner").alias("class"), F.col("target").alias("up"))
        r = r.join(inside, "owner", "left").join(member, ["class", "name"], "left")
        inherited = base.join(member.select(F.col("class").alias("up"), "name", F.col("mine").alias("theirs")), "up").groupBy("class", "name").agg(F.min("theirs").alias("theirs"))
        r = r.join(inherited, ["class", "name"], "left")
        space = self.kind("binding").filter("detail = '*'").join(self.resolved, ["path", "source"]).select("path", F.col("name").alias("source"), F.col("target").alias("space"))
        inner = self.top.filter("exported").select(F.col("path").alias("space"), "name", F.col("id").alias("of_space"))
        r = r.join(space, ["path", "source"], "left").join(inner, ["space", "name"], "left")
        own = F.when(F.col("source") == "this", F.coalesce("mine", "theirs")).otherwise(F.col("of_space"))
        return r.withColumn("sure", own.isNotNull()).withColumn("target", F.coalesce(own, F.when(~(F.col("source").eqNullSafe("this")), F.col("target")))).withColumn(
            "confidence", F.when(F.col("sure"), "static_certain").otherwise(F.col("confidence"))).withColumn("resolution", F.when(F.col("sure"), "exact").otherwise(F.col("resolution")))

    def unresolved(self) -> DataFrame:
        return self._references().filter("target is null and detail in ('call', 'new')").select("owner", "name", "path", "line", "seq")
