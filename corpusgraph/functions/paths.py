"""Column functions on file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def group_of(path: Column) -> Column:
    """The first directory, `<root>` for a file without one."""
    return F.when(F.instr(path, "/") > 0, F.split_part(path, F.lit("/"), F.lit(1))).otherwise(F.lit("<root>"))


def module_of(path: Column, depth: int = 3) -> Column:
    """The first `depth` directories at most, `<root>` for none."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return F.when(F.size(parts) > 1, F.array_join(F.slice(folders, 1, depth), "/")).otherwise(F.lit("<root>"))


def route_path(path: Column) -> Column:
    """The URL path of a file-routed handler: `[x]` becomes `:x`, `[...x]` becomes `:x*`."""
    app = F.instr(path, "/app/")
    pages = F.instr(path, "/pages/")
    inner = (
        F.when(app > 0, F.regexp_replace(F.substr(path, app + 5), r"/?route\.[jt]sx?$", ""))
        .when(pages > 0, F.regexp_replace(F.regexp_replace(F.substr(path, pages + 7), r"\.[jt]sx?$", ""), "/index$", ""))
        .otherwise(F.regexp_replace(path, r"/?route\.[jt]sx?$", ""))
    )
    parts = F.filter(F.split(inner, "/"), lambda p: p != "")
    named = F.transform(
        parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"^\[\.\.\.(.*)\]$", ":$1*"), r"^\[(.*)\]$", ":$1")
    )
    return F.concat(F.lit("/"), F.array_join(named, "/"))


def is_api_path(path: Column) -> Column:
    return path.rlike(r"/api/|route\.(ts|js|tsx|jsx)$|handler\.(ts|js)$|controller\.(ts|js)$")
