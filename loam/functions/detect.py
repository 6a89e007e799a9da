"""Detectors and classifiers over text, as ordered pattern rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loam.functions.text import by_rules, first_match

# Ordered classification rules.
TASK_RULES = (
    ("code_generation", r"(?i)\b(implement|build|create|write|generate|code|develop)\b.*\b(function|class|module|api|endpoint|component)\b"),
    ("code_review", r"(?i)\b(review|audit|check|examine|inspect|analyze)\b.*\b(code|pr|pull request|diff|change)\b"),
    ("debugging", r"(?i)\b(debug|fix|resolve|troubleshoot|investigate)\b.*\b(bug|error|issue|crash|fail|broken)\b"),
    ("planning", r"(?i)\b(plan|design|architect|decide|roadmap|strategy)\b"),
    ("refactoring", r"(?i)\b(refactor|restructure|reorganize|clean|improve)\b"),
    ("documentation", r"(?i)\b(document|explain|describe|summarize|readme)\b"),
    ("conversation", r"(?i)\b(chat|talk|conversation|quick question|brainstorm)\b"),
)
TASK_BUDGETS = {"code_generation": 0.08, "code_review": 0.15, "debugging": 0.12, "planning": 0.2, "refactoring": 0.14, "documentation": 0.1, "conversation": 0.06, "unknown": 0.1}
KIND_RULES = (
    ("security_rule", r"(?i)\b(security|vulnerability|exploit|cve|injection|xss|csrf|secret|token|password)\b"),
    ("trade_rule", r"(?i)\b(trade|buy|sell|order|transaction|portfolio|position|market)\b"),
    ("procedure", r"(?i)\b(procedure|step|process|workflow|pipeline|deploy|release|rollback)\b"),
    ("mistake", r"(?i)\b(mistake|error|bug|issue|problem|wrong|incorrect|fail|crash)\b"),
    ("code_context", r"(?i)\b(config|setting|environment|variable|env|\.env|toml|yaml|json)\b"),
    ("decision", r"(?i)\b(decision|choose|decided|agreed|concluded|resolved)\b"),
    ("preference", r"(?i)\b(prefer|preference|like|style|convention|format|indent|tab|space)\b"),
)
RISK_RULES = (
    ("critical", r"(?i)\b(security|vulnerability|exploit|secret|token|password|credential|cve|trade|buy|sell|order|transaction|portfolio|financial)\b"),
    ("high", r"(?i)\b(procedure|deploy|release|rollback|pipeline|production|prod)\b"),
    ("medium", r"(?i)\b(mistake|error|bug|wrong|incorrect)\b"),
)
FAILURES = (
    ("missing_knowledge", 0.7, (
        r"\bI don't know\b|\bI'm not sure\b|\bI don't have (?:enough |sufficient )?(?:context|information|knowledge)\b"
        r"|\bI (?:can't|cannot) (?:answer|help|find)\b|\bno (?:relevant |matching )?(?:memories|results|context) found\b"
        r"|\bunable to (?:determine|find|locate|retrieve)\b|\b(?:could not|couldn't) (?:find|locate|determine)\b")),
    ("wrong_memory", 0.65, (
        r"\bthat'?s (?:incorrect|wrong|not right|outdated)\b|\b(?:actually|correction|I stand corrected)\b"
        r"|\bthe (?:correct|right|actual) (?:answer|value|approach|way) is\b|\bthis (?:memory|information) is (?:incorrect|wrong|outdated|stale)\b")),
    ("incomplete_procedure", 0.6, (
        r"\bmissing (?:step|dependency|prerequisite|requirement)\b|\b(?:also|additionally|don't forget|remember to)\b.*\b(?:need|must|should|have to)\b"
        r"|\bthat (?:failed|didn't work|broke) because\b|\bgot an error.*trying to\b|\b(?:tried|attempted).*(?:but|however|still).*(?:fail|error|broken)\b")),
    ("not_surfaced", 0.55, (
        r"\b(?:again|still|once more|repeating)\b.*\b(?:how|what|where|when|why|which)\b|\b(?:as I (?:asked|mentioned|said) (?:before|earlier|previously))\b"
        r"|\bI (?:already|previously) (?:asked|mentioned|said)\b")),
)
CORRECTION = r"(?i)\b(?:instead|rather|should be|actually)\b"
ERROR_MARK = r"\b(ERROR|FATAL|CRITICAL|FAIL(?:ED)?|PANIC|Exception|Error|Traceback|AssertionError|ENOENT|EACCES)\b|exit code|command not found"
#: In every text with a stack mark, and found sooner.
STACK_HINT = r"\.(?i:ts|tsx|js|jsx|py|go|rs):\d|[tT](?i:raceback)|[cC](?i:aused by)"
STACK_MARK = r"(?i)\b(?:at\s+)?[\w./-]+\.(?:ts|tsx|js|jsx|py|go|rs):\d+\b|\bTraceback\b|\bCaused by\b"
COMMAND_MARK = r"(?i)\b(command|stderr|stdout|exit status|exit code)\b"
GENERATED = r"(?i)\b(generated|do not edit|auto-generated|autogenerated)\b"
TOOLING = r"(?i)\b(biome|tailwind|eslint|prettier|vitest|jest|vite|pnpm|npm|bun|ky|setup|configured|installed|added dev dependency)\b"
OPERATIONAL = r"(?i)\b(deploy|deployment|production|prod|release|rollback|incident|outage|security|credential|secret|migration)\b"
LABEL_RULES = (
    ("constraint", r"(?i)\b(must|required|never|constraint|rule|invariant|only|do not|don't)\b"),
    ("failure", r"(?i)\b(error|failed|failure|bug|mistake|regression|gotcha)\b"),
    ("decision", r"(?i)\b(decision|decided|choose|chosen|use|adopt)\b"),
    ("open_question", r"(?i)\?|open question|unknown|todo|needs follow-up"),
)
LIBRARY_PATHS = ("node_modules/", "vendor/", "dist/", "build/", ".min.js", "generated/")


def task_type(text: Column) -> Column:
    return first_match(text, TASK_RULES, "unknown")


def infer_kind(text: Column) -> Column:
    return first_match(text, KIND_RULES, "fact")


def infer_risk(text: Column) -> Column:
    return first_match(text, RISK_RULES, "low")


def critical_markers(text: Column) -> Column:
    return F.struct(text.rlike(ERROR_MARK).alias("error"), (text.rlike(STACK_HINT) & text.rlike(STACK_MARK)).alias("stack"), text.rlike(COMMAND_MARK).alias("command"))


def loses_markers(original: Column, shown: Column) -> Column:
    a, b = critical_markers(original), critical_markers(shown)
    return (a["error"] & ~b["error"]) | (a["stack"] & ~b["stack"]) | (a["command"] & ~b["command"])


def minified(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    return (F.size(lines) > 0) & (F.size(F.filter(lines, lambda x: F.length(x) > 500)) > 0.4 * F.size(lines))


def library_reason(path: Column, text: Column) -> Column:
    """Why a text counts as library or generated code, null if it doesn't."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    out = F.when(F.lit(False), F.lit(""))
    for part in LIBRARY_PATHS:
        out = out.when(F.contains(low, F.lit(part)), F.lit(f"path:{part}"))
    return out.when(F.substring(text, 1, 2000).rlike(GENERATED), "generated_marker").when(minified(text), "minified_shape")


def failure_hits(line: Column) -> Column:
    """(type, confidence) of every detector that fires on a line."""
    hits = lambda found: F.array(*[F.when(found(f"(?i){p}"), F.struct(F.lit(n).alias("type"), F.lit(c).alias("confidence"))) for n, c, p in FAILURES])
    return F.array_compact(by_rules(line, [p for _, _, p in FAILURES], hits))
