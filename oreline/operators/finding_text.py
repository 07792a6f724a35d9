"""Texts and types of findings: sanitised messages, validation, families of types, code features. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code-like parts of a message, and the length from which it is cut.
CODE_LIKE = (r"```[\s\S]*?```", r"`[^`]{30,}`", r"\$_(GET|POST|REQUEST|COOKIE|SERVER)\[.*?\]")
MESSAGE_LIMIT = 500

#: Types a finding may have, and phrases that betray a prompt injection.
ALLOWED_TYPES = (
    "SQL Injection", "Command Injection", "Cross-Site Scripting (XSS)", "Path Traversal", "File Inclusion", "Server-Side Request Forgery",
    "Unrestricted File Upload", "Cross-Site Request Forgery (CSRF)", "Insecure Cryptography", "Weak Randomness", "Hardcoded Secret",
    "Authentication Bypass", "Insecure Deserialization", "XML External Entity", "LDAP Injection", "XPath Injection", "Open Redirect", "Information Exposure",
)
SEVERITIES = ("critical", "high", "medium", "low", "info")
SUSPICIOUS = (
    r"(?i)\bignore\s+(?:all\s+)?previous\b", r"(?i)\bdisregard\s+(?:the\s+)?system\b", r"(?i)\byou\s+are\s+now\s+", r"(?i)\bno\s+vulnerabilities?\b",
    r"(?i)\bsafe\s+(?:code|file)\b", r"<\|.*?\|>",
)

#: Families of finding types.
TYPE_FAMILIES = {
    "sql_injection": "sql", "sqli": "sql", "sql": "sql",
    "xss": "xss", "cross_site_scripting": "xss",
    "rce": "exec", "code_injection": "exec", "command_injection": "exec", "exec": "exec", "os_command": "exec",
    "path_traversal": "file", "file_read": "file", "file_inclusion": "file", "lfi": "file", "path": "file",
    "broken_access_control": "access", "access_control": "access", "insecure_design": "access", "auth": "access", "authorization": "access",
    "weak_crypto": "crypto", "cryptographic_failures": "crypto", "crypto": "crypto", "insecure_hash": "crypto",
    "ssrf": "ssrf", "server_side_request_forgery": "ssrf", "software_integrity_failures": "ssrf", "fetch_unsafe": "ssrf",
}

#: Severity and weakness of each sink type.
SINK_SEVERITY = {"sql": "CRITICAL", "shell": "CRITICAL", "eval": "CRITICAL", "deserialization": "HIGH", "dynamic_code": "HIGH", "file_write": "HIGH", "network_send": "MEDIUM"}
SINK_CWE = {
    "sql": "CWE-89", "shell": "CWE-78", "eval": "CWE-95", "file_write": "CWE-73", "filewrite": "CWE-73", "file_include": "CWE-98", "file_inclusion": "CWE-98",
    "network_send": "CWE-20", "deserialization": "CWE-502", "dynamic_code": "CWE-94", "nosql": "CWE-943", "ssrf": "CWE-918", "xss": "CWE-79", "crypto": "CWE-327",
    "hash": "CWE-328", "weakrand": "CWE-330", "ldap": "CWE-90", "xpath": "CWE-643", "xpathi": "CWE-643", "xxe": "CWE-611", "trustbound": "CWE-285",
    "trust_bound": "CWE-285", "securecookie": "CWE-614", "secure_cookie": "CWE-614",
}

#: Threat categories of a finding's type; other types are tampering.
TYPE_STRIDE = {
    "sql": "TI", "nosql": "TI", "shell": "TE", "xss": "T", "ssrf": "IE", "file_include": "IE", "file_write": "TE", "crypto": "I", "hash": "I", "weakrand": "S", "ldap": "TIE",
    "xpath": "TI", "xxe": "I", "deserialization": "TE", "eval": "TE", "dynamic_code": "TE", "network_send": "I", "trustbound": "E", "securecookie": "SI",
}


def lookup(table: dict[str, str], c: Column, other: Column) -> Column:
    """The table's value of a key, else ``other``."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), c), other)


def family(c: Column) -> Column:
    """The family of a type's name, or the plain name where it has none; null is ''."""
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9_]", "")
    return lookup(TYPE_FAMILIES, plain, plain)


def message(c: Column, limit: int = MESSAGE_LIMIT) -> Column:
    """A message without code-like parts, cut at ``limit`` characters; null stays null."""
    for p in CODE_LIKE:
        c = F.regexp_replace(c, p, "[code-stripped]")
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def validation(kind: Column, severity: Column, line: Column, description: Column, remediation: Column, source: Column, confidence: Column) -> tuple[Column, Column]:
    """Why a finding is not accepted (null where it is) and its risk: rules in order, each phrase found in the description or the
    remediation counting once. Missing texts are empty, a missing line is 0, a missing confidence 0.5."""
    text = lambda c: F.coalesce(c, F.lit(""))
    kind, severity, description, remediation = text(kind), F.lower(text(severity)), text(description), text(remediation)
    line, confidence = F.coalesce(line, F.lit(0)), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(confidence, F.lit(0.5))))
    risk: Column = F.when((confidence > 0.95) & (severity == "critical"), 1).otherwise(0) + F.when(F.length(description).between(1, 9), 2).otherwise(0)
    for p in SUSPICIOUS:
        risk = risk + F.when(description.rlike(p) | remediation.rlike(p), 5).otherwise(0)
    unfit = F.when(~kind.isin(*ALLOWED_TYPES), "type").when(~severity.isin(*SEVERITIES), "severity").when((line < 0) | (line > 100_000), "range")
    unfit = unfit.when((line > 0) & (line > F.size(F.split(text(source), "\n", -1))), "length")
    return unfit.when(risk >= 5, "suspicious"), F.when(unfit.isNotNull(), 0).otherwise(risk)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def deepest_floored(text: Column) -> Column:
    """Greatest depth of braces, never below zero on the way."""
    signs = F.split(F.regexp_replace(text, r"[^{}]", ""), "")
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(a: Column, x: Column) -> Column:
        depth = F.when(x == "{", a["d"] + 1).when(x == "}", F.greatest(F.lit(0), a["d"] - 1)).otherwise(a["d"])
        return F.struct(depth.alias("d"), F.greatest(a["m"], depth).alias("m"))

    return F.aggregate(signs, start, step)["m"]


#: What the probe counts.
PROBE = {"branches": r"\b(if|else|switch|case)\b", "functions": r"function\s+\w+|=>\s*\{|const\s+\w+\s*=\s*(\(|function)", "loops": r"\b(for|while|do)\b"}


def probe_features(text: Column) -> list[Column]:
    """Branches + 1, lines, functions, loops and depth of a text."""
    return [count(text, PROBE["branches"]) + 1, F.size(F.split(text, "\n", -1)), count(text, PROBE["functions"]), count(text, PROBE["loops"]), deepest_floored(text)]


def deviation(values: list[Column]) -> Column:
    """Population standard deviation of a row's values."""
    mean = sum(values[1:], values[0]) / len(values)
    squares = [(v - mean) * (v - mean) for v in values]
    return F.sqrt(sum(squares[1:], squares[0]) / len(values))


#: Counted features by name: pattern and what they are divided by.
COUNTED = {
    "decisions": (r"\b(if|while|for|case|catch|\?\??)\b", 50),
    "functions": (r"(?:^|\n)(?:def|function|func|public|private|protected)\s+\w+", 20),
    "imports": (r"(?:^|\n)(?:import|from|require|include)\s+", 30),
    "dangerous": (r"(?i)\b(exec|eval|system|shell|popen|spawn|compile)\s*\(", 10),
    "inputs": (r"(?i)\b(input|read|get|request|query|body|param)\s*\(", 20),
    "concats": (r"""(\+|[%`](?:[^`]*`)+|\bf\b\.format\s*\(|f"|f'|\$\{|\\?")""", 50),
}
COMMENT = r"(#|//|<!--|/\*)"


def character_entropy(text: Column) -> Column:
    """Bits per character of a text, 0 for the empty one: each different character is counted by its removal."""
    n = F.length(text)
    p = lambda ch: (n - F.length(F.replace(text, ch, F.lit("")))) / n
    each = F.transform(F.array_distinct(F.filter(F.split(text, ""), lambda ch: ch != "")), lambda ch: -p(ch) * F.log2(p(ch)))
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x)


def code_features(text: Column) -> dict[str, Column]:
    """The twelve features of a source text, by name; ratios are capped at 1 except that of comments."""
    lines = F.split(text, "\n", -1)
    loc, lengths = F.size(lines), F.transform(lines, F.length)
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))
    depth = F.aggregate(F.transform(lines, lambda x: count(x, r"\{") - count(x, r"\}")), start, lambda a, x: F.struct((a["d"] + x).alias("d"), F.greatest(a["m"], a["d"] + x).alias("m")))["m"]
    cap = lambda x: F.least(x, F.lit(1.0))
    out = {"loc": cap(loc / 1000), "nesting": cap(depth / 10)} | {name: cap(count(text, p) / n) for name, (p, n) in COUNTED.items()}
    mean = F.aggregate(lengths, F.lit(0), lambda a, x: a + x) / loc
    return out | {"comments": count(text, COMMENT) / loc, "entropy": cap(character_entropy(text) / 8), "mean_line": cap(mean / 200), "longest_line": cap(F.array_max(lengths) / 500)}
