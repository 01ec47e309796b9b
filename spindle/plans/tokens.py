"""A scanner for SQL text that keeps every character, so a rewrite touches nothing it does not mean to."""

from __future__ import annotations

import re
from dataclasses import dataclass

_SCAN = re.compile(
    r"""(?P<space>\s+)
      | (?P<comment>--[^\n]*|/\*.*?(?:\*/|\Z))
      | (?P<string>'(?:[^']|'')*'|"(?:[^"]|"")*")
      | (?P<quoted>`(?:[^`]|``)*`)
      | (?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)
      | (?P<word>[^\W\d]\w*)
      | (?P<op><>|!=|==|<=|>=|<<|>>|\|\||&&|.)""",
    re.X | re.S,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text

    @property
    def blank(self) -> bool:
        return self.kind in ("space", "comment")

    @property
    def value(self) -> str:
        """What a string literal stands for."""
        q = self.text[0]
        return self.text[1:-1].replace(q + q, q)


def scan(sql: str) -> list[Token]:
    return [Token(m.lastgroup or "op", m[0]) for m in _SCAN.finditer(sql)]


def text(tokens: list[Token]) -> str:
    return "".join(t.text for t in tokens)


def solid(tokens: list[Token]) -> list[Token]:
    """Without white space and comments."""
    return [t for t in tokens if not t.blank]


def closing(tokens: list[Token], at: int) -> int:
    """Where the parenthesis that opens at `at` closes."""
    depth = 0
    for i in range(at, len(tokens)):
        if tokens[i].text == "(":
            depth += 1
        elif tokens[i].text == ")":
            depth -= 1
            if not depth:
                return i
    raise ValueError("a parenthesis is not closed: " + text(tokens[at:])[:80])


def following(tokens: list[Token], at: int) -> int:
    """The next place at or after `at` that is neither white space nor comment; the length if there is none."""
    while at < len(tokens) and tokens[at].blank:
        at += 1
    return at


def split(tokens: list[Token], mark: str = ",") -> list[list[Token]]:
    """Parts between marks that stand outside parentheses."""
    parts: list[list[Token]] = [[]]
    depth = 0
    for t in tokens:
        depth += (t.text == "(") - (t.text == ")")
        if t.text == mark and not depth:
            parts.append([])
        else:
            parts[-1].append(t)
    return parts


def find(tokens: list[Token], words: set[str], start: int = 0) -> int:
    """The first of these words outside parentheses, or -1."""
    depth = 0
    for i in range(start, len(tokens)):
        depth += (tokens[i].text == "(") - (tokens[i].text == ")")
        if not depth and tokens[i].kind == "word" and tokens[i].upper in words:
            return i
    return -1


def statements(script: str) -> list[str]:
    """The statements of a script, which semicolons part; a dot command ends with its line. Comment lines are left out."""
    out: list[str] = []
    now: list[Token] = []

    def flush() -> None:
        if one := text([Token("space", " ") if t.kind == "comment" else t for t in now]).strip():
            out.append(one)
        now.clear()

    for t in scan(script):
        if t.text == ";":
            flush()
            continue
        at_start = not solid(now)
        if not at_start and solid(now)[0].text == "." and t.kind == "space" and "\n" in t.text:
            flush()
            continue
        now.append(t)
    flush()
    return out
