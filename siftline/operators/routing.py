"""Which scan a path gets, as one CASE expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
BINARY = [".jar", ".class", ".pyc", ".pyo", ".pyd", ".exe", ".dll", ".so", ".dylib", ".bin", ".obj", ".o", ".a", ".zip", ".tar", ".gz", ".bz2", ".xz", ".rar", ".7z", ".war", ".ear", ".wasm", ".lock"]
SUPPORTED = [
    ".py", ".js", ".ts", ".rb", ".go", ".java", ".cs", ".php", ".env", ".env.local", ".env.test", ".env.example",
    ".yaml", ".yml", ".json", ".toml", ".ini", ".cfg", ".config", ".xml", ".properties", ".ipynb", ".txt", ".md",
    ".sh", ".bash", ".zsh", ".tf", ".tfvars", ".sql", "",
]
IDE_PARTS = [".vscode/settings.json", ".idea/workspace.xml", ".idea/dataSources.xml", ".idea/dataSources.local.xml", ".eclipse/org.eclipse.core.runtime"]
VCR_PARTS = ["cassettes/", "fixtures/vcr/", ".yaml", ".json"]
FIXTURE_PARTS = ["fixtures/", "testdata/", "test_data/", "seed", "factory", "factories/", "spec/support/", "seeds/"]

#: routes on which personal data is looked for
PERSONAL_ROUTES = ("vcr", "fixture", "notebook")
#: routes whose files are read as lines of text
PLAIN_ROUTES = ("ide", "vcr", "fixture", "env", "default")


def basename(path: Column) -> Column:
    """The last part of a path, trailing slashes aside."""
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def suffix(path: Column) -> Column:
    """The last extension as written; none for names that only begin with a dot or end with one."""
    return F.regexp_extract(basename(path), r"^\.*[^.].*(\.[^.]+)$", 1)


def extension(path: Column) -> Column:
    return F.lower(suffix(path))


def env_file(path: Column) -> Column:
    """Whether detectors of environment files apply."""
    return F.lower(basename(path)).contains(".env")


def _any(path: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (path.contains(p) for p in parts))


def route(path: Column, exists: Column | None = None) -> Column:
    """missing, binary, skipped, notebook, ide, vcr, fixture, env or default; the first that holds."""
    ext, slashed = extension(path), F.replace(path, F.lit("\\"), F.lit("/"))
    vcr = _any(slashed, VCR_PARTS) & (slashed.contains("cassette") | F.lower(slashed).contains("vcr"))
    out = F.when(~exists, "missing") if exists is not None else F
    return (
        out.when(ext.isin(BINARY), "binary")
        .when(~ext.isin(SUPPORTED), "skipped")
        .when(ext == ".ipynb", "notebook")
        .when(_any(slashed, IDE_PARTS), "ide")
        .when(vcr, "vcr")
        .when(_any(slashed, FIXTURE_PARTS), "fixture")
        .when((ext == ".env") | F.lower(basename(path)).startswith(".env"), "env")
        .otherwise("default")
    )
