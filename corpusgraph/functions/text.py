"""Column functions on text: identifiers, intents, trigrams, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that decide a query's intent, in order of priority.
INTENTS = {
    "find_definition": [
        r"\b(?:where\s+is|where's|find)\s+(?:the\s+)?(?:definition|declaration|type|interface|class|struct|enum|function|method)\s+(?:of|for)?\s",
        r"\b(?:defined?|declared?|implemented?)\s+(?:where|in which|at)\b",
        r"\bwhere\s+(?:is|are)\s+.+\s+(?:defined?|declared?|implemented?|located?)\b",
        r"\bdefinition\s+of\b",
        r"\bwhat\s+(?:is|are)\s+the\s+(?:type|interface|class|struct|enum)\s+(?:of\s+)?[A-Z]",
    ],
    "find_usage": [
        r"\b(?:where|how)\s+is\s+.+\s+(?:used|called|invoked|referenced|imported|consumed)\b",
        r"\b(?:who|what)\s+(?:calls?|uses?|invokes?|imports?|references?)\s",
        r"\bwhere\s+(?:is|are|does)\s+.+\s+(?:get\s+)?(?:used|called|invoked|imported)\b",
        r"\bcall\s+sites?\s+(?:for|of)\b",
        r"\busages?\s+of\b",
        r"\bcallers?\s+of\b",
    ],
    "find_missing": [
        r"\bwithout\b",
        r"\bmissing\b",
        r"\blacking\b",
        r"\bno\s+(?:error|input|auth|validation|handling|logging|tests?)\b",
        r"\bdon'?t\s+have\b",
        r"\bdoesn'?t?\s+(?:have|handle|check|validate)\b",
        r"\bnever\s+(?:check|validate|handle|catch)\b",
        r"\bwhich\s+(?:files?|functions?|classes?|modules?)\s+(?:don'?t|doesn'?t|lack|never)\b",
    ],
    "find_similar": [
        r"\bsimilar\s+to\b",
        r"\blike\s+(?:this|the)\b",
        r"\banalogous\s+to\b",
        r"\bequivalent\s+to\b",
        r"\brelated\s+(?:code|functions?|implementations?)\b",
        r"\bsame\s+pattern\s+as\b",
    ],
    "find_pattern": [
        r"\b(?:design\s+)?pattern\b",
        r"\bsingleton\b",
        r"\bfactory\b",
        r"\bobserver\b",
        r"\bdependency\s+injection\b",
        r"\bmiddleware\b",
        r"\bdecorator\s+pattern\b",
        r"\brepository\s+pattern\b",
        r"\banti-?pattern\b",
        r"\bshow\s+(?:me\s+)?(?:all\s+)?(?:the\s+)?patterns?\b",
    ],
    "find_code": [
        r"\b(?:find|show|list|get|search)\s+(?:all|any|every)?\s+(?:the\s+)?(?:code|functions?|methods?|classes?|files?|endpoints?|routes?|handlers?|components?)\b",
        r"\bshow\s+me\b",
    ],
}
# How identifiers look in a question, each with its capture group.
IDENTIFIERS = [
    r"`([^`]+)`",
    r'"([A-Za-z_]\w+)"',
    r"'([A-Za-z_]\w+)'",
    r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b",
    r"\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\b",
    r"\b([A-Z][a-z]{2,})\b",
]


def _matches(text: Column, pattern: str) -> Column:
    """Group 1 of all matches; words end where a character other than ASCII letters, digits and `_` stands."""
    start, end = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
    if pattern.startswith(r"\b"):
        pattern = start + pattern[2:-2] + end
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def symbol_candidates(text: Column) -> Column:
    """Identifiers in a question, of two characters or more, each once."""
    found = [F.transform(_matches(text, p), F.trim) for p in IDENTIFIERS]
    mixed = F.filter(_matches(text, r"\b([a-z][a-zA-Z0-9]{2,})\b"), lambda w: w.rlike("[A-Z0-9]"))
    return F.filter(F.array_distinct(F.concat(*found, mixed)), lambda w: F.length(w) >= 2)


def intent_of(text: Column) -> Column:
    """The first intent with a matching pattern; find_code if there are identifiers, else general."""
    trimmed, out = F.trim(text), None
    for intent, patterns in INTENTS.items():
        hit = trimmed.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))
        out = F.when(hit, F.lit(intent)) if out is None else out.when(hit, F.lit(intent))
    return out.when(F.size(symbol_candidates(trimmed)) > 0, F.lit("find_code")).otherwise(F.lit("general"))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a text's words, each word with two blanks before and one after it."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    cut = F.transform(
        words,
        lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))),
    )
    return F.array_distinct(F.flatten(cut))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared share of two texts' trigrams; 0 if both have none."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


def normalize_relation(raw: Column) -> Column:
    low = F.lower(raw)
    return (
        F.when(low.contains("import") | low.contains("require"), "imports")
        .when(low.contains("call") | low.contains("invoke"), "calls")
        .when(low.contains("extend") | low.contains("inherit"), "extends")
        .when(low.contains("implement"), "implements")
        .otherwise("uses")
    )


def scale_weight(count: Column) -> Column:
    return F.when(count >= 10, 5).when(count >= 5, 4).when(count >= 3, 3).when(count >= 2, 2).otherwise(1)


def title_of(text: Column, most: int = 80) -> Column:
    """White space squeezed, at most `most` characters, with an ellipsis if cut."""
    one_line = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(one_line) <= most, one_line).otherwise(F.concat(F.left(one_line, F.lit(most - 3)), F.lit("...")))


# Patterns of a check for a signed-in user.
AUTH_MARKS = [
    r"requireSession\s*\(",
    r"getSession\s*\(",
    r"authenticate\s*\(",
    r"verifyToken\s*\(",
    r"jwt\.verify\s*\(",
    r"(?i:bearerToken)",
    r"(?i:authorization)",
    r"isAuthenticated",
    r"checkAuth",
    r"authMiddleware",
    r"Depends\(get_current_user",
    r"login_required",
    r"current_user",
    r"@jwt_required",
]


def requires_auth(code: Column) -> Column:
    """Whether a piece of code checks for a signed-in user."""
    return code.rlike("|".join(AUTH_MARKS))
