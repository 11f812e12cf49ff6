"""Name resolution as joins: what an import binds, what a name means in a module, where a member is inherited.

All tables are keyed, so each step is an equi-join; rules that apply in order become ranked alternatives that
coalesce. "First candidate" means least (path, sequence).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.costs import cost_for_span, cost_for_text
from ..session import staged

ROUNDS = 50


def simple_names(symbols: DataFrame, name: str = "name") -> DataFrame:
    """name, first, others: all symbols of a simple name in order."""
    grouped = symbols.groupBy(name).agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "seq", "id"))), lambda x: x["id"]).alias("ids"))
    return grouped.select(F.col(name).alias("name"), F.get("ids", 0).alias("first"), F.slice("ids", 2, 1 << 30).alias("others"))


def _last(df: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """A later row of the same key replaces an earlier one."""
    return df.groupBy(keys).agg(F.max_by(F.struct(*columns), "seq").alias("v")).select(*keys, "v.*")


def bound_names(bindings: DataFrame, defines: DataFrame, modules: DataFrame) -> DataFrame:
    """module, name, id that each import binding stands for, through chains of re-exports."""
    known = modules.select(F.col("module").alias("m"), F.col("id").alias("mid")).distinct()
    d = defines.select(F.col("module").alias("m"), F.col("name").alias("s"), F.col("id").alias("did"))
    chain = bindings.select(F.col("module").alias("m"), F.col("name").alias("s"), F.col("source").alias("next_m"), F.col("symbol").alias("next_s"))
    state = bindings.select("module", "name", F.col("source").alias("m"), F.col("symbol").alias("s"))
    done = None
    for _ in range(ROUNDS):
        # A whole module.
        whole = state.filter("s is null").join(known, "m").select("module", "name", F.col("mid").alias("id"))
        part = state.filter("s is not null").join(known, "m", "left_semi").join(d, ["m", "s"], "left").join(chain, ["m", "s"], "left")
        part = part.withColumn("on", F.col("did").isNull() & F.col("next_m").isNotNull() & (F.col("next_m") != F.col("m")))
        child = part.filter("did is null and not on").select("module", "name", F.concat_ws(".", "m", "s").alias("m")).join(known, "m").select("module", "name", F.col("mid").alias("id"))
        found = whole.unionByName(part.filter("did is not null").select("module", "name", F.col("did").alias("id"))).unionByName(child)
        done = found if done is None else done.unionByName(found)
        state = staged(part.filter("on").select("module", "name", F.col("next_m").alias("m"), F.col("next_s").alias("s")), "bindings")
        done = staged(done, "bound")
        if state.isEmpty():
            break
    return done  # chains in a circle, or longer than ROUNDS, bind nothing


def ancestors(bases: DataFrame) -> DataFrame:
    """class, ancestor, way: every class above and the class itself, by depth-first order of the bases.
    ``bases``: class, base, position."""
    ids = bases.select(F.col("class")).unionByName(bases.select(F.col("base").alias("class"))).distinct()
    level = ids.select("class", F.col("class").alias("ancestor"), F.array().cast("array<int>").alias("way"))
    seen = staged(level, "ancestors")
    level = seen
    for _ in range(ROUNDS):
        step = level.join(bases.select(F.col("class").alias("ancestor"), F.col("base").alias("up"), "position"), "ancestor").groupBy("class", F.col("up").alias("ancestor")).agg(
            F.min(F.concat("way", F.array("position"))).alias("way"))
        level = staged(step.join(seen.select("class", "ancestor"), ["class", "ancestor"], "left_anti").select("class", "ancestor", "way"), "ancestors")
        if level.isEmpty():
            break
        seen = staged(seen.unionByName(level), "ancestors")
    return seen


def members(symbols: DataFrame, above: DataFrame) -> DataFrame:
    """class, name, id of every own or inherited member: the first in depth-first order."""
    own = symbols.select(F.regexp_extract("id", r"^(.*)\.[^.]+$", 1).alias("ancestor"), F.regexp_extract("id", r"\.([^.]+)$", 1).alias("name"), "id").filter("ancestor <> ''")
    return above.join(own, "ancestor").groupBy("class", "name").agg(F.min_by("id", "way").alias("id"))


def _facts(facts: DataFrame, kind: str) -> DataFrame:
    return facts.filter(F.col("kind") == kind)


def _site(path: Column, line: Column) -> Column:
    return F.struct(path.alias("file_path"), line.alias("start_line"), line.alias("end_line"), F.lit(0).alias("start_col"), F.lit(0).alias("end_col"))


class PythonGraph:
    """Nodes and edges of Python files (path, content) from their facts."""

    def __init__(self, files: DataFrame):
        from ..sources.languages.python import facts

        self.files = files
        self.facts = staged(facts(files), "python-facts")
        f = self.facts
        self.modules = _facts(f, "module")
        # A name that is defined again in its scope keeps one symbol: the last definition.
        self.symbols = staged(_facts(f, "symbol").withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq")))).filter("_n = 1").drop("_n"), "python-symbols")
        self.defines = _last(_facts(f, "define"), ["module", "name"], "id")
        raw = _last(_facts(f, "binding").withColumn("source", F.col("receiver")).withColumn("symbol", F.col("detail")), ["module", "name"], "source", "symbol", "line", "path", "seq")
        self.bindings = staged(raw, "python-bindings")
        self.bound = staged(bound_names(self.bindings, self.defines, self.modules), "python-bound")
        self.names = staged(self.defines.unionByName(self.bound.join(self.defines.select("module", "name"), ["module", "name"], "left_anti")), "python-names")
        self.simple = staged(simple_names(_facts(f, "symbol")), "python-simple")
        bases = self.named(_facts(f, "base")).join(self.symbols.filter("detail = 'class'").select(F.col("id").alias("target")), "target", "left_semi")
        place = F.row_number().over(Window.partitionBy("owner").orderBy("seq"))
        self.members = staged(members(self.symbols, ancestors(self._all_classes(bases.select(F.col("owner").alias("class"), F.col("target").alias("base"), place.alias("position"))))), "python-members")

    def _all_classes(self, bases: DataFrame) -> DataFrame:
        alone = self.symbols.filter("detail = 'class'").select(F.col("id").alias("class")).join(bases.select("class"), "class", "left_anti")
        return bases.unionByName(alone.select("class", F.col("class").alias("base"), F.lit(0).alias("position")))

    def named(self, rows: DataFrame) -> DataFrame:
        """``rows`` with target, resolution, confidence and candidates of their name in their module."""
        out = rows.join(self.names.select("module", "name", F.col("id").alias("exact")), ["module", "name"], "left").join(self.simple, "name", "left")
        return self._ranked(out, F.col("exact"))

    @staticmethod
    def _ranked(rows: DataFrame, exact: Column) -> DataFrame:
        none = F.array().cast("array<string>")
        sure = exact.isNotNull()
        return rows.withColumn("target", F.coalesce(exact, F.col("first"))).withColumn(
            "resolution", F.when(sure, "exact").when(F.col("first").isNull(), "unresolved").when(F.size("others") == 0, "unique_name").otherwise("ambiguous")).withColumn(
            "confidence", F.when(sure, "static_certain").when(F.col("first").isNull(), "dynamic_required").otherwise("static_inferred")).withColumn(
            "candidates", F.when(sure | F.col("others").isNull(), none).otherwise(F.col("others")))

    def references(self) -> DataFrame:
        """References with target: receivers self and cls through the class, others through import or class."""
        r = _facts(self.facts, "reference").withColumnRenamed("id", "parent")
        classes = self.symbols.filter("detail = 'class'").select("id")
        member = self.members.select(F.col("class").alias("_class"), "name", F.col("id").alias("_member"))
        selfish = F.col("receiver").isin("self", "cls") & F.col("parent").isNotNull()
        r = r.join(self.names.select("module", "name", F.col("id").alias("in_module")), ["module", "name"], "left")
        owner = r.join(classes.select(F.col("id").alias("parent"), F.col("id").alias("_class")), "parent", "left")
        owner = owner.join(member, ["_class", "name"], "left").withColumnRenamed("_member", "by_self").drop("_class")
        b = self.bindings.select("module", F.col("name").alias("receiver"), F.col("source").alias("b_source"), F.col("symbol").alias("b_symbol"))
        owner = owner.join(b, ["module", "receiver"], "left")
        owner = owner.join(self.modules.select(F.col("module").alias("b_source"), F.lit(True).alias("b_known")).distinct(), "b_source", "left")
        owner = owner.join(self.defines.select(F.col("module").alias("b_source"), "name", F.col("id").alias("by_module")), ["b_source", "name"], "left")
        bound = self.bound.select("module", F.col("name").alias("receiver"), F.col("id").alias("_class"))
        owner = owner.join(bound, ["module", "receiver"], "left").join(member, ["_class", "name"], "left").withColumnRenamed("_member", "by_import").drop("_class")
        own = self.defines.select("module", F.col("name").alias("receiver"), F.col("id").alias("_class"))
        owner = owner.join(own, ["module", "receiver"], "left").join(member, ["_class", "name"], "left").withColumnRenamed("_member", "by_class").drop("_class")
        owner = owner.join(self.simple, "name", "left")
        whole_module = F.col("receiver").isNotNull() & ~selfish & F.col("b_source").isNotNull() & F.col("b_symbol").isNull() & F.coalesce("b_known", F.lit(False))
        exact = F.when(F.col("receiver").isNull(), F.col("in_module")).when(selfish, F.coalesce("by_self", "in_module")).when(whole_module, F.col("by_module")).otherwise(
            F.coalesce(F.when(F.col("b_symbol").isNotNull(), F.col("by_import")), "by_class"))
        # A known module without the name ends the search: no simple name is tried.
        stop = whole_module & F.col("by_module").isNull()
        hidden = owner.withColumn("first", F.when(~stop, F.col("first"))).withColumn("others", F.when(~stop, F.col("others")))
        return self._ranked(hidden, exact)

    def nodes(self) -> DataFrame:
        """Package, module and symbol nodes."""
        f, files = self.facts, self.files.select("path", "content")
        marks = _facts(f, "flag").groupBy(F.col("owner").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("marks"))
        none = F.array().cast("array<string>")
        crowd = _facts(f, "symbol").groupBy("name").agg(F.countDistinct("module").alias("scopes"))
        of_module = self.modules.select("module", F.col("flags").alias("module_flags"))
        s = self.symbols.join(of_module, "module").join(crowd, "name", "left").join(marks, "id", "left").join(files, "path")
        flags = F.concat(F.col("module_flags"), F.when(F.col("scopes") > 1, F.array(F.lit("ambiguous_name"))).otherwise(none), F.coalesce("marks", none))
        symbols = s.select("id", F.col("name").alias("label"), F.col("detail").alias("kind"), _span(), cost_for_span(F.col("content"), F.col("line"), F.col("end_line")).alias("cost"), "signature", "docstring", "exported",
                           F.concat_ws(".", "module", F.regexp_extract("id", "#(.*)$", 1)).alias("symbol_path"), F.array_distinct(flags).alias("flags"), "path", "seq")
        m = self.modules.join(marks, "id", "left").join(files, "path")
        modules = m.select("id", F.col("path").alias("label"), F.lit("module").alias("kind"), _span(), cost_for_text(F.col("content")).alias("cost"), F.lit(None).cast("string").alias("signature"), "docstring",
                           F.lit(None).cast("boolean").alias("exported"), F.col("module").alias("symbol_path"), F.array_distinct(F.concat("flags", F.coalesce("marks", none))).alias("flags"), "path", "seq")
        names = F.split("module", r"\.")
        ups = self.modules.select(F.explode(F.when(F.size(names) > 1, F.transform(F.sequence(F.lit(1), F.size(names) - 1), lambda i: F.array_join(F.slice(names, F.lit(1), i), "."))).otherwise(none)).alias("package")).distinct()
        ups = ups.join(self.modules.select(F.col("module").alias("package")), "package", "left_anti")
        packages = ups.select(F.concat(F.lit("py:"), "package").alias("id"), F.col("package").alias("label"), F.lit("package").alias("kind"), F.lit(None).cast(symbols.schema["span"].dataType).alias("span"),
                              cost_for_text(F.col("package")).alias("cost"), F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("docstring"), F.lit(None).cast("boolean").alias("exported"),
                              F.col("package").alias("symbol_path"), none.alias("flags"), F.lit("").alias("path"), F.lit(0).cast("bigint").alias("seq"))
        return packages.unionByName(modules).unionByName(symbols).withColumn("language", F.lit("python")).withColumn("provenance", F.lit("language:python"))

    def edges(self) -> DataFrame:
        """All edges between different known nodes; repeats add to the weight, the first evidence stays."""
        f = self.facts
        kinds = self.symbols.select(F.col("id").alias("target"), F.col("detail").alias("target_kind"))
        sure = (F.lit("static_certain").alias("confidence"), F.lit("exact").alias("resolution"), F.array().cast("array<string>").alias("candidates"))

        def rows(df, start, end, relation, *how, order):
            how = how or sure
            return df.select(F.col(start).alias("from_id"), F.col(end).alias("to_id"), relation.alias("relation"), *how, _site(F.col("path"), F.col("line")).alias("evidence"), F.struct(F.lit(order).alias("step"), "path", "seq").alias("ordinal"))
        found = ("confidence", "resolution", "candidates")
        lit = F.lit
        up = self.modules.filter("detail <> '' and detail <> module").withColumn("up", F.concat(F.lit("py:"), "detail"))
        reexports = F.exists("module_flags", lambda x: x == "reexport")
        # A module's imports: every binding of a symbol, at its last binding's line.
        bound = self.bindings.filter("symbol is not null").join(self.bound.select("module", "name", F.col("id").alias("target")), ["module", "name"]).join(self.modules.select("module", F.col("id").alias("owner"), F.col("flags").alias("module_flags")), "module")
        refs = self.references().filter("target is not null").join(kinds, "target", "left")
        call = F.when(F.col("is_call"), F.when(F.col("target_kind") == "class", "INSTANTIATES").otherwise("CALLS")).when(F.col("target_kind").isin("constant", "field"), "READS")
        writes = _facts(f, "store").join(self.names.select("module", "name", F.col("id").alias("target")), ["module", "name"]).join(kinds.filter("target_kind = 'constant'"), "target")
        every = [
            rows(up, "up", "id", lit("CONTAINS"), order=1), rows(_facts(f, "define").join(self.symbols.select("id", F.col("seq").alias("_s")), "id", "left_semi").dropDuplicates(["module", "name"]), "owner", "id", lit("CONTAINS"), order=1),
            rows(_facts(f, "import"), "owner", "id", lit("IMPORTS"), order=2), rows(bound, "owner", "target", F.when(reexports, "RE_EXPORTS").otherwise("IMPORTS_SYMBOL"), order=3),
            rows(self.symbols, "owner", "id", lit("CONTAINS"), order=4), rows(self.named(_facts(f, "base")), "owner", "target", lit("INHERITS"), *found, order=5),
            rows(self.named(_facts(f, "decorator")), "target", "owner", lit("DECORATES"), *found, order=6),
            rows(self.named(_facts(f, "annotation")).join(kinds.filter("target_kind = 'class'"), "target"), "owner", "target", lit("TYPE_USES"), *found, order=7),
            rows(_facts(f, "dynamic_import"), "owner", "id", lit("IMPORTS"), lit("dynamic_required").alias("confidence"), sure[1], sure[2], order=8),
            rows(refs.withColumn("rel", call).filter("rel is not null"), "owner", "target", F.col("rel"), *found, order=9), rows(writes, "owner", "target", lit("WRITES"), order=10)]
        out = every[0]
        for e in every[1:]:
            out = out.unionByName(e)
        from .edges import merge_edges, valid_edges
        return merge_edges(valid_edges(out, self.nodes().select("id")))

    def unresolved(self) -> DataFrame:
        """Calls without a target."""
        return self.references().filter("target is null and is_call").select("owner", "name", "path", "line", "seq")


def _span() -> Column:
    return F.struct(F.col("path").alias("file_path"), F.col("line").alias("start_line"), F.col("end_line"), F.lit(0).alias("start_col"), F.lit(0).alias("end_col")).alias("span")
