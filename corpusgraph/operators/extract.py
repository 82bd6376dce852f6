"""Symbols, imports and exports of source files, line by line, for many languages in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How declarations, imports and exports look, by language; group 1 is the name or the imported module.
_SCRIPT = [
    ("function", r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)"),
    ("class", r"^(?:export\s+)?class\s+(\w+)"),
    ("interface", r"^(?:export\s+)?interface\s+(\w+)"),
    ("type", r"^(?:export\s+)?type\s+(\w+)\s*="),
    ("function", r"^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\("),
    ("function", r"^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[a-zA-Z_]\w*)\s*=>"),
    ("enum", r"^(?:export\s+)?enum\s+(\w+)"),
    ("import", r"^import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]"),
    ("export", r"^export\s+(?:default\s+)?(?:function|class|const|let|var|interface|type|enum)\s+(\w+)"),
]
PATTERNS = {
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "python": [
        ("function", r"^(?:async\s+)?def\s+(\w+)\s*\("),
        ("class", r"^class\s+(\w+)"),
        ("import", r"^from\s+(\S+)\s+import"),
        ("import", r"^import\s+(\S+)"),
    ],
    "go": [
        ("function", r"^func\s+(?:\([^)]+\)\s+)?(\w+)\s*\("),
        ("class", r"^type\s+(\w+)\s+struct\b"),
        ("interface", r"^type\s+(\w+)\s+interface\b"),
        ("type", r"^type\s+(\w+)\s+"),
        ("import", r"^\s*\"([^\"]+)\""),
    ],
    "rust": [
        ("function", r"^(?:pub\s+)?(?:async\s+)?fn\s+(\w+)"),
        ("class", r"^(?:pub\s+)?struct\s+(\w+)"),
        ("interface", r"^(?:pub\s+)?trait\s+(\w+)"),
        ("enum", r"^(?:pub\s+)?enum\s+(\w+)"),
        ("import", r"^use\s+([\w:]+)"),
    ],
    "java": [
        ("method", r"(?:public|private|protected|static|\s)+[\w<>\[\]]+\s+(\w+)\s*\([^)]*\)\s*(?:throws\s+[\w,\s]+)?\s*\{"),
        ("class", r"^(?:public\s+)?(?:abstract\s+)?class\s+(\w+)"),
        ("interface", r"^(?:public\s+)?interface\s+(\w+)"),
        ("enum", r"^(?:public\s+)?enum\s+(\w+)"),
        ("import", r"^import\s+([\w.]+);"),
    ],
    "csharp": [
        ("method", r"(?:public|private|protected|internal|static|async|\s)+[\w<>\[\]?]+\s+(\w+)\s*\([^)]*\)"),
        ("class", r"^(?:\s*(?:public|internal|abstract|sealed|static|partial)\s+)*class\s+(\w+)"),
        ("interface", r"^(?:\s*(?:public|internal)\s+)?interface\s+(\w+)"),
        ("enum", r"^(?:\s*(?:public|internal)\s+)?enum\s+(\w+)"),
        ("import", r"^using\s+([\w.]+);"),
    ],
    "ruby": [
        ("function", r"^\s*def\s+(?:self\.)?(\w+[?!=]?)"),
        ("class", r"^\s*class\s+(\w+)"),
        ("module", r"^\s*module\s+(\w+)"),
        ("import", r"^require\s+['\"]([^'\"]+)['\"]"),
    ],
    "php": [
        ("function", r"(?:public|private|protected|static|\s)+function\s+(\w+)\s*\("),
        ("class", r"^(?:abstract\s+)?class\s+(\w+)"),
        ("interface", r"^interface\s+(\w+)"),
        ("import", r"^use\s+([\w\\]+);"),
    ],
    "kotlin": [
        ("function", r"^\s*(?:(?:public|private|internal|protected|open|abstract|override|suspend)\s+)*fun\s+(\w+)"),
        ("class", r"^\s*(?:(?:public|private|internal|open|abstract|data|sealed)\s+)*class\s+(\w+)"),
        ("interface", r"^\s*interface\s+(\w+)"),
        ("import", r"^import\s+([\w.]+)"),
    ],
    "swift": [
        ("function", r"^\s*(?:(?:public|private|internal|open|static|class|override)\s+)*func\s+(\w+)"),
        ("class", r"^\s*(?:(?:public|private|internal|open|final)\s+)*class\s+(\w+)"),
        ("interface", r"^\s*(?:(?:public|private|internal)\s+)?protocol\s+(\w+)"),
        ("class", r"^\s*(?:(?:public|private|internal)\s+)?struct\s+(\w+)"),
        ("enum", r"^\s*(?:(?:public|private|internal)\s+)?enum\s+(\w+)"),
        ("import", r"^import\s+(\w+)"),
    ],
}


def declarations(files: DataFrame) -> DataFrame:
    """(repo_id, file_id, start_line, ordinal, kind, name, signature) of files (repo_id, file_id, language, content).

    Each line is matched with its language's patterns; kinds import and export are among the rows.
    """
    lines = files.where(F.col("language").isin(*PATTERNS)).select(
        "repo_id", "file_id", "language", F.posexplode(F.split("content", "\n")).alias("pos", "line")
    )

    def matches(patterns: list[tuple[str, str]]) -> Column:
        found = []
        for ordinal, (kind, pattern) in enumerate(patterns):
            name = F.regexp_extract("line", pattern, 1)
            found.append(F.when(name != "", F.struct(F.lit(ordinal).alias("ordinal"), F.lit(kind).alias("kind"), name.alias("name"))))
        return F.array_compact(F.array(*found))

    by_language: dict[int, list[str]] = {}
    for language, patterns in PATTERNS.items():
        by_language.setdefault(id(patterns), []).append(language)
    hits = None
    for languages in by_language.values():
        test, value = F.col("language").isin(*languages), matches(PATTERNS[languages[0]])
        hits = F.when(test, value) if hits is None else hits.when(test, value)
    return lines.withColumn("hit", F.explode(hits)).select(
        "repo_id", "file_id", (F.col("pos") + 1).alias("start_line"), "hit.ordinal", "hit.kind", "hit.name", F.trim("line").alias("signature")
    )


def extract_symbols(found: DataFrame) -> DataFrame:
    """Of declarations: the symbols, the first pattern's where several match a name on a line."""
    first = Window.partitionBy("repo_id", "file_id", "start_line", "name").orderBy("ordinal")
    rows = found.where(~F.col("kind").isin("import", "export")).withColumn("n", F.row_number().over(first)).where("n = 1")
    return rows.select("repo_id", "file_id", "name", "kind", "start_line", "signature")


def extract_imports(found: DataFrame) -> DataFrame:
    """(repo_id, file_id, source, names): imported modules, with the names in braces, `as` aliases left out."""
    listed = F.regexp_extract("signature", r"\{([^}]*)\}", 1)
    names = F.transform(F.split(listed, ","), lambda n: F.trim(F.regexp_replace(n, r"\s+as\s+.*$", "")))
    return found.where("kind = 'import'").select("repo_id", "file_id", F.col("name").alias("source"), F.filter(names, lambda n: n != "").alias("names"))


def extract_exports(found: DataFrame) -> DataFrame:
    return found.where("kind = 'export'").select("repo_id", "file_id", "name").distinct()


def inheritance(symbols: DataFrame) -> DataFrame:
    """(repo_id, file_id, name, relation_type, parent) from class signatures: `extends` and each name after `implements`."""
    up = F.regexp_extract("signature", r"\bextends\s+(\w+)", 1)
    listed = F.regexp_extract("signature", r"\bimplements\s+([\w\s,]+)", 1)
    links = F.concat(
        F.when(up != "", F.array(F.struct(F.lit("extends").alias("relation_type"), up.alias("parent")))).otherwise(F.array()),
        F.transform(
            F.filter(F.transform(F.split(listed, ","), lambda x: F.trim(x)), lambda p: p != ""),
            lambda p: F.struct(F.lit("implements").alias("relation_type"), p.alias("parent")),
        ),
    )
    return symbols.where("kind = 'class'").select("repo_id", "file_id", "name", F.explode(links).alias("x")).select("repo_id", "file_id", "name", "x.*")
