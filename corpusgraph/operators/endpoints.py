"""HTTP endpoints of source files: file routes, calls on an app or router, decorators; parameters, hosts, tables, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import route_path
from ..functions.text import requires_auth

# The methods, in the order in which they are looked for.
METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE"]
_METHOD = "GET|POST|PUT|PATCH|DELETE"
_CALL = "get|post|put|patch|delete"
# What marks a kind of response, the first that occurs decides.
RESPONSES = [
    (r"NextResponse\.json\s*\(", "JSON"),
    (r"Response\s*\(\s*JSON\.stringify", "JSON"),
    (r"res\.json\s*\(", "JSON"),
    (r"return\s+Response\s*\(", "Response"),
    (r"StreamingTextResponse", "StreamingText"),
    (r"NextResponse\.redirect", "Redirect"),
    (r"res\.send\s*\(", "Text"),
]
KNOWN_HEADERS = ("authorization", "content-type", "accept")


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def app_route_methods(code: Column) -> Column:
    """Methods with an exported handler, then re-exported ones; GET if there are none."""
    named = _all(code, rf"export\s+(?:async\s+)?function\s+({_METHOD})\s*\(")
    lists = F.flatten(F.transform(_all(code, r"export\s+\{([^}]+)\}"), lambda x: F.transform(F.split(x, ","), lambda m: F.trim(m))))
    found = F.array_distinct(F.concat(named, F.filter(lists, lambda m: m.isin(METHODS))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("GET")))


def pages_methods(code: Column) -> Column:
    """Methods that req.method is compared with; ALL if there are none."""
    found = F.array_distinct(F.filter(_all(code, r"req\.method\s*===?\s*['\"]([A-Z]+)['\"]"), lambda m: m.isin(METHODS)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("ALL")))


def call_routes(code: Column) -> Column:
    """(method, path) of `app.get('/p')` and the like, then of `router.route('/p').get().post()`, five chained calls at most."""
    pattern = r"(?i)(?:app|router|server)\.(get|post|put|patch|delete|all)\s*\(\s*['\"`]([^'\"` ]+)['\"`]"
    direct = F.zip_with(_all(code, pattern, 1), _all(code, pattern, 2), lambda m, p: F.struct(F.upper(m).alias("method"), p.alias("path")))
    starts = r"router\.route\s*\(\s*['\"`]([^'\"` ]+)['\"`]\s*\)"
    paths = _all(code, starts)
    # what follows each route call, up to the end of the text
    rests = F.slice(F.split(code, starts), 2, F.size(paths))
    whole = F.transform(F.sequence(F.lit(1), F.greatest(F.size(paths), F.lit(1))), lambda i: F.array_join(F.slice(rests, i, F.size(paths)), " "))
    chained = F.zip_with(
        paths,
        F.slice(whole, 1, F.size(paths)),
        lambda p, rest: F.transform(
            F.slice(_all(rest, rf"(?i)\.({_CALL})\s*\("), 1, 5), lambda m: F.struct(F.upper(m).alias("method"), p.alias("path"))
        ),
    )
    return F.concat(direct, F.flatten(chained))


def decorator_routes(files: DataFrame) -> DataFrame:
    """(repo_id, path, framework, method, route, handler, start_line) of Python decorators; methods default to GET.

    The handler is the first function at the left edge that follows the decorator.
    """
    lines = files.where(F.col("path").endswith(".py")).select("repo_id", "path", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    line = F.col("line")
    fast, flask = rf"(?i)@(?:app|router)\.({_CALL})\s*\(\s*['\"]([^'\"]+)['\"]", r"(?i)@app\.route\s*\(\s*['\"]([^'\"]+)['\"]\s*(?:,\s*methods\s*=\s*\[([^\]]*)\])?\s*\)"
    listed = F.filter(_all(F.regexp_extract(line, flask, 2), r"['\"]([A-Z]+)['\"]"), lambda m: m.isin(METHODS))
    methods = F.when(line.rlike(fast), F.array(F.upper(F.regexp_extract(line, fast, 1)))).when(
        line.rlike(flask), F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("GET")))
    )
    ahead = Window.partitionBy("repo_id", "path").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    name = F.regexp_extract(line, r"^def\s+(\w+)\s*\(", 1)
    handler = F.first(F.when(name != "", name), ignorenulls=True).over(ahead)
    rows = lines.withColumns({"handler": handler, "methods": methods}).where(F.col("methods").isNotNull())
    is_fast = line.rlike(fast)
    return rows.select(
        "repo_id", "path", F.when(is_fast, "fastapi").otherwise("flask").alias("framework"),
        F.posexplode("methods").alias("ordinal", "method"), F.when(is_fast, F.regexp_extract(line, fast, 2)).otherwise(F.regexp_extract(line, flask, 1)).alias("route"),
        "handler", (F.col("pos") + 1).alias("start_line"),
    )


def parameters(code: Column, route: Column) -> Column:
    """Parameters (name, location, type, required) by path, query, body, header; a name keeps its first location."""

    def found(names: Column, location: str, kind: str, required: bool) -> Column:
        return F.transform(
            F.filter(names, lambda n: n.isNotNull() & (n != "")),
            lambda n: F.struct(n.alias("name"), F.lit(location).alias("location"), F.lit(kind).alias("type"), F.lit(required).alias("required")),
        )

    bodies = _all(code, r"const\s+\{([^}]+)\}\s*=\s*(?:await\s+)?(?:req|request)\.json\s*\(\s*\)")
    fields = F.flatten(F.transform(bodies, lambda b: F.transform(F.split(b, ","), lambda f: F.trim(F.split_part(F.trim(f), F.lit(":"), F.lit(1))))))
    fields = F.when(code.rlike(r"await\s+(?:req|request)\.json\s*\(\s*\)"), fields).otherwise(F.array().cast("array<string>"))
    bracket = r"(?:req|request)\.query(?:\[['\"]([^'\"]+)['\"]\]|\.([a-zA-Z_]\w*))"
    queried = F.zip_with(_all(code, bracket, 1), _all(code, bracket, 2), lambda a, b: F.when(a != "", a).otherwise(b))
    headers = F.transform(
        _all(code, r"(?:req|request|headers)\s*(?:\(\s*\))?\s*(?:\.|\.get\s*\(\s*)['\"]([a-zA-Z][a-zA-Z0-9\-]*)['\"](?:\s*\))?"), F.lower
    )
    every = F.concat(
        found(_all(route, r":([a-zA-Z_][a-zA-Z0-9_]*)\*?"), "path", "string", True),
        found(_all(route, r"\[(?:\.\.\.)?([a-zA-Z_][a-zA-Z0-9_]*)\]"), "path", "string", True),
        found(_all(code, r"(?:searchParams|query)\.get\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"), "query", "string", False),
        found(queried, "query", "string", False),
        found(fields, "body", "unknown", True),
        found(F.filter(headers, lambda h: h.startswith("x-") | h.isin(*KNOWN_HEADERS)), "header", "string", False),
    )
    none = F.slice(every, 1, 0)
    return F.aggregate(every, none, lambda kept, p: F.when(F.exists(kept, lambda k: k["name"] == p["name"]), kept).otherwise(F.concat(kept, F.array(p))))


def response_type(code: Column) -> Column:
    out = None
    for pattern, kind in RESPONSES:
        out = F.when(code.rlike(pattern), F.lit(kind)) if out is None else out.when(code.rlike(pattern), F.lit(kind))
    return out


def detect_endpoints(files: DataFrame) -> DataFrame:
    """(repo_id, endpoint_id, method, route, path, start_line, handler, framework, parameters, response_type, auth_required) of files
    (repo_id, path, content). A file's first strategy that applies decides; of equal ids the first stays."""
    p, code = F.col("path"), F.col("content")
    app, pages = p.rlike(r"/app/api/.*/route\.[jt]sx?$"), p.rlike(r"/pages/api/.*\.[jt]sx?$")
    calls = p.rlike(r"\.[jt]sx?$") & ~p.endswith(".d.ts") & code.rlike(rf"(?:app|router)\.({_CALL}|all)\s*\(")
    framework = F.when(app, "nextjs-app-router").when(pages, "nextjs-pages").when(calls, "express")
    by_file = F.when(app, app_route_methods(code)).when(pages, pages_methods(code))
    found = F.when(calls & ~app & ~pages, call_routes(code)).otherwise(
        F.transform(by_file, lambda m: F.struct(m.alias("method"), route_path(p).alias("path")))
    )
    handler = lambda m: F.when(app, m).when(pages, F.lit("handler"))
    rows = files.withColumns({"framework": framework, "found": found}).where(F.col("framework").isNotNull())
    scripts = rows.select("repo_id", "path", "content", "framework", F.posexplode("found").alias("ordinal", "x")).select(
        "repo_id", "path", "content", "framework", "ordinal", F.col("x.method").alias("method"), F.col("x.path").alias("route"),
        handler(F.col("x.method")).alias("handler"),
        F.when(app, _line_of(code, F.concat(F.lit(r"export\s+(?:async\s+)?function\s+"), F.col("x.method"), F.lit(r"\s*\(")))).otherwise(F.lit(1)).alias("start_line"),
    )
    python = decorator_routes(files)
    fast_first = Window.partitionBy("repo_id", "path")
    python = python.withColumn("any_fast", F.max((F.col("framework") == "fastapi").cast("int")).over(fast_first))
    python = python.where((F.col("framework") == "fastapi") | (F.col("any_fast") == 0)).join(files.select("repo_id", "path", "content"), ["repo_id", "path"])
    columns = ["repo_id", "path", "content", "framework", "ordinal", "method", "route", "handler", "start_line"]
    every = scripts.select(*columns).unionByName(python.select(*columns))
    # a fixed value: ids are the first 16 hex digits of the SHA-1 of file, method and route
    every = every.withColumn("endpoint_id", F.left(F.sha1(F.concat_ws(":", "path", "method", "route")), F.lit(16)))
    first = Window.partitionBy("repo_id", "endpoint_id").orderBy("start_line", "ordinal")
    every = every.withColumn("n", F.row_number().over(first)).where("n = 1")
    json = F.col("framework").isin("fastapi", "flask")
    return every.select(
        "repo_id", "endpoint_id", "method", "route", "path", "start_line", "handler", "framework", parameters(code, F.col("route")).alias("parameters"),
        F.when(json, "JSON").otherwise(response_type(code)).alias("response_type"), requires_auth(code).alias("auth_required"),
    )


def _line_of(code: Column, pattern: Column) -> Column:
    """The line on which a pattern first matches, 1 if it doesn't."""
    at = F.regexp_instr(code, pattern)
    return F.when(at > 0, F.size(F.split(F.substr(code, F.lit(1), at - 1), "\n"))).otherwise(F.lit(1))


def db_tables(code: Column) -> Column:
    """Up to eight tables that query builders, model clients and repositories name."""
    found = F.concat(
        _all(code, r"\.(?:from|insert|update|delete)\s*\(\s*([a-zA-Z_]\w*)\s*\)"),
        _all(code, r"prisma\.([a-zA-Z_]\w*)\.(?:find|create|update|delete|upsert)"),
        _all(code, r"getRepository\s*\(\s*([A-Z][a-zA-Z_]*)\s*\)"),
    )
    return F.slice(F.array_distinct(found), 1, 8)


def external_hosts(code: Column) -> Column:
    """Up to five hosts of absolute URLs that are fetched."""
    urls = F.concat(
        _all(code, r"fetch\s*\(\s*['\"`](https?://[^'\"` ]+)['\"`]"), _all(code, r"axios\.(?:get|post|put|delete)\s*\(\s*['\"`](https?://[^'\"` ]+)['\"`]")
    )
    hosts = F.transform(urls, lambda u: F.coalesce(F.try_parse_url(u, F.lit("HOST")), F.left(u, F.lit(50))))
    return F.slice(F.array_distinct(hosts), 1, 5)


def resource_of(route: Column) -> Column:
    """The first two segments at most before a variable one."""
    parts = F.filter(F.split(route, "/"), lambda p: p != "")
    fixed = F.aggregate(
        F.slice(parts, 1, 2),
        F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("open")),
        lambda a, p: F.struct(
            F.when(a["open"] & ~p.rlike(r"^[:\[]"), F.concat(a["kept"], F.array(p))).otherwise(a["kept"]).alias("kept"),
            (a["open"] & ~p.rlike(r"^[:\[]")).alias("open"),
        ),
    )
    return F.concat(F.lit("/"), F.array_join(fixed["kept"], "/"))


def related_endpoints(endpoints: DataFrame) -> DataFrame:
    """(repo_id, endpoint_id, resource, n_related): how many other endpoints of the repository have the same resource.

    A resource may have very many endpoints, so their ids are listed once for each resource (`endpoints_by_resource`), not for each endpoint.
    """
    rows = endpoints.select("repo_id", "endpoint_id", resource_of(F.col("route")).alias("resource"))
    sizes = rows.groupBy("repo_id", "resource").agg(F.count("*").alias("n"))
    return rows.join(sizes, ["repo_id", "resource"]).select("repo_id", "endpoint_id", "resource", (F.col("n") - 1).alias("n_related"))


def endpoints_by_resource(endpoints: DataFrame) -> DataFrame:
    """(repo_id, resource, endpoint_ids), sorted."""
    rows = endpoints.select("repo_id", "endpoint_id", resource_of(F.col("route")).alias("resource"))
    return rows.groupBy("repo_id", "resource").agg(F.array_sort(F.collect_set("endpoint_id")).alias("endpoint_ids"))


def main_framework(endpoints: DataFrame) -> DataFrame:
    """(repo_id, framework, n): the most frequent, ties by name."""
    counts = endpoints.groupBy("repo_id", "framework").agg(F.count("*").alias("n"))
    first = Window.partitionBy("repo_id").orderBy(F.desc("n"), "framework")
    return counts.withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")


def filter_endpoints(endpoints: DataFrame, *, methods: list[str] | None = None, auth: str = "all", text: str = "") -> DataFrame:
    """Endpoints of the methods whose route or method holds the text; auth: all, auth or public."""
    hit = F.lower("route").contains(text.lower()) | F.lower("method").contains(text.lower())
    need = {"all": F.lit(True), "auth": F.col("auth_required"), "public": ~F.col("auth_required")}[auth]
    return endpoints.where(hit & need & F.col("method").isin(methods or [*METHODS, "ALL"]))
