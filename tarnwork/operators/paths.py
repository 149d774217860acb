"""Classification of paths: scope, language, workflow, container and manifest files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.text import any_of, ascii_lower, base_name, is_file, normal_path


def _marked(low: Column, marks: tuple) -> Column:
    inside, first, last = marks
    return any_of([*(F.contains(low, F.lit(m)) for m in inside), *(F.startswith(low, F.lit(m)) for m in first), *(F.endswith(low, F.lit(m)) for m in last)])


def scope(path: Column) -> Column:
    """production, ci, test, fixture or docs; the first that matches in the order of the chain."""
    low = ascii_lower(normal_path(path))
    chain = F.when(_marked(low, X.FIXTURE_PATHS), "fixture").when(_marked(low, X.TEST_PATHS), "test")
    return chain.when(_marked(low, X.CI_PATHS), "ci").when(_marked(low, X.DOCS_PATHS), "docs").otherwise("production")


def capped(severity: Column, path: Column) -> Column:
    """Test and fixture paths never exceed low."""
    low = F.transform(F.array(path), lambda p: ascii_lower(normal_path(p)))  # lower-cased once for all marks
    return F.when(F.exists(low, lambda p: _marked(p, X.FIXTURE_PATHS) | _marked(p, X.TEST_PATHS)), "low").otherwise(severity)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).otherwise(2)


def language(path: Column) -> Column:
    """By whole file name, else by extension, both case-sensitive; null if unsupported."""
    name = base_name(path)
    extension = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    pairs = [(name, X.LANG_BY_NAME), (extension, X.LANG_BY_EXTENSION)]
    found = [F.when(key.isin(*values), lang) for key, table in pairs for lang, values in table.items()]
    return F.coalesce(*found)


def is_workflow(path: Column) -> Column:
    return F.contains(F.concat(F.lit("/"), normal_path(path)), F.lit("/.github/workflows/"))


def is_container_file(path: Column) -> Column:
    low = ascii_lower(normal_path(path))
    return any_of(F.contains(low, F.lit(n)) for n in ("dockerfile", "containerfile")) & base_name(low).rlike(r"^(dockerfile|containerfile|.*\.dockerfile|.*\.containerfile)$")


def is_manifest(path: Column) -> Column:
    return is_file(ascii_lower(normal_path(path)), X.MANIFESTS)


def is_dependency_file(path: Column) -> Column:
    return is_file(ascii_lower(normal_path(path)), X.DEPENDENCY_FILES) | is_file(path, X.LANG_BY_NAME["manifest"])


def is_install_script(path: Column) -> Column:
    low = ascii_lower(normal_path(path))
    return is_file(low, X.INSTALL_SCRIPTS) | F.startswith(low, F.lit("scripts/")) | F.contains(low, F.lit("/scripts/"))
