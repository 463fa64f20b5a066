"""What a path says: its class, its scope, whether it is a test suite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directory and file names by convention of tools and languages.
TEST_SEGMENTS = ["__test__", "__tests__", "test", "tests", "e2e", "spec", "specs"]
TEST_MARKERS = [".test.", ".tests.", ".spec.", ".itest.", ".e2e.", "_test.", "_spec."]
PLATFORM_ROOTS = [".github", ".gitlab"]
PLATFORM_SEGMENTS = ["ci", "workflows", ".circleci", "deploy", "k8s", "helm"]
MANIFESTS = [
    "package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "cargo.toml", "cargo.lock", "pyproject.toml", "requirements.txt", "go.mod",
    "go.sum", "pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts",
]
AUXILIARY_SEGMENTS = [
    "generated", "vendor", "vendored", "mock", "mocks", "mockup", "mockups", "fixture", "fixtures", "fuzz", "fuzz_targets", "stories", "docs",
    "bench", "benches", "benchmark", "benchmarks", "script", "scripts", "temp", "dist", "build",
]
AUXILIARY_SUFFIXES = ["-bench", "_bench", "-benchmark", "_benchmark"]
AUXILIARY_FILES = ["test.rs", "tests.rs", "spec.rs", "specs.rs"]
PROSE = [".md", ".markdown", ".mdown", ".mkd", ".mkdn", ".rst", ".adoc", ".asciidoc"]
SCRIPTS = ["js", "cjs", "mjs", "ts", "cts", "mts"]


def _any(names: list[str]) -> str:
    escaped = [n.replace(".", "[.]") for n in names]
    return f"({'|'.join(escaped)})"


#: Class -> patterns over the lower-cased path with "/", the first class that fits wins; what fits none is product.
PATTERNS: list[tuple[str, list[str]]] = [
    ("test", [f"(^|/){_any(TEST_SEGMENTS)}(/|$)", f"{_any(TEST_MARKERS)}[^/]*$"]),
    ("classified", [
        "(^|/)[.]vscode(/|$)", "(^|/)(js|ts)config[.]([^/]*[.])?json$", f"[.]config[.]{_any(SCRIPTS)}$",
        f"^{_any(PLATFORM_ROOTS)}(/|$)", f"(^|/){_any(PLATFORM_SEGMENTS)}(/|$)", f"(^|/){_any(MANIFESTS)}$",
        f"(^|/){_any(AUXILIARY_SEGMENTS)}(/|$)", f"{_any(AUXILIARY_SUFFIXES)}(/|$)", f"(^|/){_any(AUXILIARY_FILES)}$",
        f"{_any(PROSE)}$", "[.]min[.][^/]*$", "[.]openapi[.][^/]*$",
    ]),
]
SUITES = [
    r"([.]test[.]|[.]spec[.])([^/]*[.])?(js|jsx|mjs|cjs|ts|tsx|mts|cts)$", r"/__tests__/.*[.](js|jsx|mjs|cjs|ts|tsx|mts|cts)$",
    r"(^|/)tests/.*[.]rs$", r"_test[.]rs$", r"_test[.]go$", r"(^|/)test_[^/]*[.]pyi?$", r"_test[.]py$",
]


def normal(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def path_class(path: Column) -> Column:
    """test, classified or product; null for null."""
    p = F.lower(normal(path))
    out = F.when(path.isNull(), F.lit(None).cast("string"))
    for name, patterns in PATTERNS:
        out = out.when(p.rlike("|".join(patterns)), name)
    return out.otherwise("product")


def is_visible(path: Column, include_tests: bool = False, include_classified: bool = False) -> Column:
    """Product paths, and those of the classes that are opted in."""
    shown = ["product"] + ["test"] * include_tests + ["classified"] * include_classified
    return path_class(path).isin(shown)


def in_scope(path: Column, scope: str | None) -> Column:
    """Whether path is the scope or lies under it; no scope holds all. A scope that leaves its root is refused."""
    if scope is None or scope.strip() in ("", "."):
        return F.lit(True)
    s = scope.strip().replace("\\", "/")
    while s.startswith("./"):
        s = s[2:]
    s = s.rstrip("/")
    if s.startswith("/") or ".." in s.split("/"):
        raise ValueError("the scope must stay under the root")
    return (normal(path) == s) | F.startswith(normal(path), F.lit(s + "/"))


def is_test_suite(path: Column) -> Column:
    """Whether the name follows a test runner's convention."""
    return F.lower(normal(path)).rlike("|".join(SUITES))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(normal(path), "/"), -1)


def stem(path: Column) -> Column:
    """Lower-cased file name without its last extension."""
    return F.regexp_replace(F.lower(file_name(path)), r"(.)[.][^.]*$", "$1")


def covered_stem(path: Column) -> Column:
    """The stem that a test suite covers by its name; null if its name has no runner's mark."""
    s = stem(path)
    marked = F.regexp_extract(s, r"^(.*?)[.](?:test|spec)", 1)
    named = F.when(s.rlike("[.](test|spec)"), marked).when(s.startswith("test_"), F.substring(s, 6, 1 << 20)).when(s.endswith("_test"), F.regexp_replace(s, "_test$", ""))
    named = named.when(F.contains(F.lower(normal(path)), F.lit("/__tests__/")), s)
    return F.when(named != "", named)


def glob_pattern(glob: str) -> str:
    """A regular expression for a workspace glob: ** any depth, * within a segment, ? one character."""
    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 3] == "**/":
            out, i = out + "(.*/)?", i + 3
        elif glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + (glob[i] if glob[i].isalnum() or glob[i] in "/_- " else f"[{glob[i]}]" if glob[i] not in "^\\]" else "\\" + glob[i]), i + 1
    return f"^{out}$"


def matches_globs(path: Column, globs: list[str]) -> Column:
    """Whether the last glob that fits path is a plain one, not one negated by "!"."""
    out = F.lit(False)
    for g in globs:
        keep = not g.startswith("!")
        out = F.when(normal(path).rlike(glob_pattern(g.lstrip("!"))), F.lit(keep)).otherwise(out)
    return out
