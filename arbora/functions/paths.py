"""Path predicates and conversions as column expressions. Paths use slashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names and folders that classify a path.
GENERATED_NAME = r"(_pb2(_grpc)?\.pyi?|\.g\.(dart|kt)|\.freezed\.dart|_generated\.[a-z]+)$"
GENERATED_FOLDERS = ("migrations", "__generated__", "generated")
VERSIONED_PARENTS = ("alembic", "migrations")
VENDORED_PARTS = ("vendor", "vendored", "third_party", "thirdparty", "node_modules", "site-packages")
TEST_FOLDERS = ("test", "tests", "__tests__", "spec")
TEST_NAME = r"^(test_.*\.py|.+_test\.py|.+\.(test|spec)\.(ts|tsx|js|jsx|mjs|cjs)|.+Test\.kt)$"
DOC_SUFFIXES = (".md", ".rst", ".txt")
CONFIG_SUFFIXES = (".json", ".yaml", ".yml", ".toml", ".properties", ".env", ".gradle")
CODE_SUFFIXES = (".py", ".pyi", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".kt", ".kts")
TYPESCRIPT_SUFFIXES = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")


def parts(path: Column) -> Column:
    """Non-empty parts; single dots are no parts."""
    return F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))


def file_name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(parts(path), F.lit(-1)), F.lit(""))


def folders(path: Column) -> Column:
    """Lower-case parts before the file's name."""
    p = parts(path)
    return F.transform(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), lambda x: F.lower(x))


def suffix(path: Column) -> Column:
    """Last dot and what follows, in lower case; names that only begin or end with a dot have none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def without_suffix(path: Column) -> Column:
    """The path without its last suffix."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")


def _any_of(values: Column, known) -> Column:
    return F.arrays_overlap(values, F.array(*map(F.lit, known)))


def is_generated(path: Column) -> Column:
    up = folders(path)
    after = F.exists(F.zip_with(up, F.slice(up, F.lit(2), F.greatest(F.size(up) - 1, F.lit(0))), lambda a, b: a.isin(*VERSIONED_PARENTS) & (F.coalesce(b, F.lit("")) == "versions")), lambda x: x)
    schema = F.array_contains(up, "schemas") & file_name(path).rlike(r"^[0-9]+\.json$")
    return file_name(path).rlike(GENERATED_NAME) | _any_of(up, GENERATED_FOLDERS) | after | schema


def is_vendored(path: Column) -> Column:
    return _any_of(F.transform(parts(path), lambda x: F.lower(x)), VENDORED_PARTS)


def is_test(path: Column) -> Column:
    return file_name(path).rlike(TEST_NAME) | _any_of(folders(path), TEST_FOLDERS)


def path_flags(path: Column) -> Column:
    """Those of generated, vendored and test that hold, in this order."""
    marks = F.array(F.when(is_generated(path), F.lit("generated")), F.when(is_vendored(path), F.lit("vendored")), F.when(is_test(path), F.lit("test")))
    return F.filter(marks, lambda m: m.isNotNull())


def context_kind(path: Column) -> Column:
    """doc, config or code by a file's name."""
    name = F.lower(file_name(path))
    return F.when(suffix(path).isin(*DOC_SUFFIXES), "doc").when(name.endswith(".gradle.kts") | suffix(path).isin(*CONFIG_SUFFIXES) | (name == ".env"), "config").otherwise("code")


def is_config_file(path: Column) -> Column:
    name = F.lower(file_name(path))
    skip = _any_of(parts(path), (".git", "node_modules", "build", "dist", ".gradle", ".idea"))
    return ~skip & ((name == ".env") | suffix(path).isin(".json", ".yaml", ".yml", ".toml", ".properties") | name.endswith(".gradle") | name.endswith(".gradle.kts"))


def relative_to(path: Column, root: str) -> Column:
    """The path below ``root``, or as it is if it lies elsewhere."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)


def module_name(path: Column) -> Column:
    """Dotted module of a Python file; a package's init names the package."""
    dotted = F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit("."))
    return F.regexp_replace(dotted, r"(^|\.)__init__$", "")


def relative_import(package: Column, level: Column, module: Column) -> Column:
    """Absolute module of an import that climbs ``level`` - 1 packages from ``package``; null if it leaves the top."""
    up = F.split(package, r"\.")
    base = F.slice(up, F.lit(1), F.greatest(F.size(up) - level + 1, F.lit(0)))
    joined = F.concat_ws(".", F.array_join(base, "."), F.nullif(F.coalesce(module, F.lit("")), F.lit("")))
    return F.when(level == 0, module).when(level - 1 > F.size(up), F.lit(None)).otherwise(F.regexp_replace(joined, r"^\.", ""))


def join_url(*pieces: Column) -> Column:
    """Path pieces with single slashes between, one in front and none behind."""
    joined = F.regexp_replace(F.concat(F.lit("/"), F.concat_ws("/", *[F.coalesce(p, F.lit("")) for p in pieces])), "/+", "/")
    return F.when(joined == "/", joined).otherwise(F.regexp_replace(joined, "/$", ""))
