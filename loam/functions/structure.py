"""Where source text declares what: names with first and last line, what encloses them, and what is exported."""

from __future__ import annotations

import re

# Declarations by language family (languages, entity type, pattern with the name in group 1), and words that are no names.
TS = ("typescript", "javascript")
DECLARATIONS = (
    (TS, "function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"),
    (TS, "function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?\([^)]*\)\s*(?::\s*[^=]+)?=>"),
    (TS, "class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"),
    (TS, "function", r"^\s*(?:(?:public|private|protected|static|async|get|set|readonly|override)\s+)*(\w+)\s*\([^)]*\)\s*(?::\s*[^{;]+)?\{"),
    (TS, "module", r"^\s*export\s+(?:default\s+)?(?:abstract\s+|async\s+)*(?:const|let|var|function|class|interface|type|enum)\s+(\w+)"),
    (TS, "module", r"^\s*export\s+\{\s*(\w+)"),
    (("python",), "function", r"^\s*(?:async\s+)?def\s+([A-Za-z]\w*)\s*\("),
    (("python",), "class", r"^\s*class\s+(\w+)"),
    (("go",), "function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*[(\[]"),
    (("go",), "class", r"^type\s+(\w+)\s+(?:struct|interface)"),
    (("rust",), "function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+(?!main\b)(\w+)"),
    (("rust",), "class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)"),
    (("rust",), "class", r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+)"),
)
NO_NAMES = ("if", "for", "while", "switch", "catch", "typeof", "function", "return", "else", "do", "with")
MOST = 200

_PATTERNS = [(langs, kind, re.compile(p, re.M)) for langs, kind, p in DECLARATIONS]
_QUOTED = r'"(?:\\.|[^"\\\n])*"'
_MASKS = {
    "python": re.compile(r'""".*?"""|\'\'\'.*?\'\'\'|#[^\n]*|' + _QUOTED + r"|'(?:\\.|[^'\\\n])*'", re.S),
    "rust": re.compile(r"//[^\n]*|/\*.*?\*/|" + _QUOTED + r"|'(?:\\.|[^'\\\n])'", re.S),
    "": re.compile(r"//[^\n]*|/\*.*?\*/|" + _QUOTED + r"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S),
}
Entity = tuple[str, str, int, int, str | None]  # type, symbol, first and last line from 1, enclosing symbol


def masked(text: str, language: str) -> str:
    """The text with blanks in place of comments and of what is quoted, line ends kept."""
    return _MASKS.get(language, _MASKS[""]).sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _closing(code: str) -> dict[int, int]:
    """Place of the brace that closes each opening one."""
    opened, out = [], {}
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            opened.append(m.start())
        elif opened:
            out[opened.pop()] = m.start()
    return out


def _brace_end(code: str, at: int, closing: dict[int, int]) -> int:
    """Where a declaration that begins at ``at`` ends: at the brace that closes its body, at its semicolon, or with its line."""
    depth, line = 0, code.find("\n", at)
    for m in re.finditer(r"[(){};]", code[at:]):
        c, p = m[0], at + m.start()
        depth += (c == "(") - (c == ")")
        if depth == 0 and c == "{":
            return closing.get(p, len(code))
        if depth <= 0 and c in ";}":
            return p if c == ";" else min(p, line if line >= 0 else len(code))
    return line if line >= 0 else len(code)


def _indent_end(lines: list[str], i: int) -> int:
    """Last line of the block below line i: up to the next line that is indented as little."""
    width = len(lines[i]) - len(lines[i].lstrip())
    # a head that runs over several lines ends with its brackets
    depth, j = 0, i
    while j < len(lines):
        depth += sum(lines[j].count(c) for c in "([{") - sum(lines[j].count(c) for c in ")]}")
        if depth <= 0:
            break
        j += 1
    last = min(j, len(lines) - 1)
    for k in range(j + 1, len(lines)):
        if lines[k].strip():
            if len(lines[k]) - len(lines[k].lstrip()) <= width:
                break
            last = k
    return last


def entities_of(text: str, language: str, most: int = MOST) -> list[Entity]:
    """What a source text declares, by first line, then type and name; of equal type and name the first, and ``most`` at most."""
    code = masked(text, language)
    closing, lines = _closing(code), code.split("\n")
    begins = [0]
    for line in lines:
        begins.append(begins[-1] + len(line) + 1)
    found: dict[tuple[str, str], tuple[int, int]] = {}
    taken: set[int] = set()
    for langs, kind, pattern in _PATTERNS:
        if language not in langs:
            continue
        for m in pattern.finditer(code):
            name, at = m[1], m.start(1)
            line = code.count("\n", 0, at) if len(lines) < 50 else _line_of(begins, at)
            if name in NO_NAMES or (kind == "function" and line in taken):
                continue
            if kind == "function":
                taken.add(line)
            end = _indent_end(lines, line) if language == "python" else _line_of(begins, _brace_end(code, at, closing))
            if (kind, name) not in found or line < found[kind, name][0]:
                found[kind, name] = (line, max(line, end))
    rows = sorted((a, kind, name, b) for (kind, name), (a, b) in found.items())[:most]
    out: list[Entity] = []
    around: list[tuple[int, str]] = []  # last line and name of what is open
    for a, kind, name, b in rows:
        while around and around[-1][0] < a:
            around.pop()
        inner = [n for end, n in around if end >= b and n != name]
        out.append((kind, name, a + 1, b + 1, inner[-1] if inner else None))
        if kind != "module" and b > a:
            around.append((b, name))
    return out


def _line_of(begins: list[int], at: int) -> int:
    from bisect import bisect_right

    return min(bisect_right(begins, at) - 1, len(begins) - 2)
