"""The dialect over Spark SQL: what it adds is found token by token and rewritten; all else goes to Spark's parser as it is."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions import compat
from ..operators.udx import NAMED, Call, Udx, UdxError
from . import tokens as tk
from .tokens import Token


class DialectError(ValueError):
    """A statement that the dialect does not have, or has in another form."""


# --- expressions ----------------------------------------------------------------------------

_CONTEXT = {"SELECT": "list", "FROM": "from", "WHERE": "predicate", "HAVING": "predicate", "ON": "predicate", "GROUP": "keys", "ORDER": "keys", "LIMIT": "limit", "WHEN": "predicate", "THEN": "list", "ELSE": "list"}


def match_regex(query: str) -> str:
    """Full-text MATCH as a regular expression: all words (word* for a beginning), OR between alternatives, "phrases"."""
    either = []
    for part in re.split(r"\s+OR\s+", query.strip()):
        all_of = ""
        for phrase, word in re.findall(r'"([^"]*)"|(\S+)', part):
            words = (phrase or word).split()
            if not words or word == "AND":
                continue
            one = r"\W+".join(re.escape(w.rstrip("*")) for w in words) + ("" if words[-1].endswith("*") else r"\b")
            all_of += rf"(?=.*\b{one})"
        either.append(all_of)
    return "(?is)^(?:" + "|".join(either) + ")"


def rewrite(tokens: list[Token]) -> str:
    """Spark SQL of a query's tokens."""
    out: list[str] = []
    context = ["list"]
    last = ""  # the last solid token, upper case
    i = 0
    while i < len(tokens):
        t = tokens[i]
        after = tk.following(tokens, i + 1)
        following = tokens[after] if after < len(tokens) else Token("end", "")
        step = i + 1
        if t.blank:
            out.append(" " if t.kind == "comment" else t.text)
            i += 1
            continue
        if t.text == "(":
            context.append(context[-1])
        elif t.text == ")" and len(context) > 1:
            context.pop()
        piece = t.text
        if t.kind == "word":
            word = t.upper
            if word in _CONTEXT:
                context[-1] = _CONTEXT[word]
            if following.text == "(" and word in ("DATE", "STRFTIME", "TOTAL", "MUL"):
                end = tk.closing(tokens, after)
                piece, step = _call(word, tokens[after + 1 : end]), end + 1
            elif word == "GLOB" and following.kind == "string":
                piece, step = "RLIKE " + compat.glob_sql(following.value), after + 1
            elif word == "MATCH" and following.kind == "string":
                piece, step = "RLIKE " + compat.literal(match_regex(following.value)), after + 1
            elif word == "REGEXP":
                piece = "RLIKE"
            elif word == "ISNULL" and following.text != "(":
                piece = "IS NULL"
            elif word == "NOTNULL" and following.text != "(":
                piece = "IS NOT NULL"
            elif word == "NOT" and following.upper == "NULL" and last != "IS" and (last == ")" or re.match(r"[\w`'\"]", last)):
                piece, step = "IS NOT NULL", after + 1
            elif word == "INDEXED" and following.upper == "BY":
                piece, step = "", tk.following(tokens, after + 1) + 1
            elif word == "NOT" and following.upper == "INDEXED":
                piece, step = "", after + 1
            elif word == "LIMIT":
                parts = tk.solid(tokens[i + 1 : i + 12])[:3]
                if len(parts) == 3 and parts[1].text == ",":
                    piece = f"LIMIT {parts[2].text} OFFSET {parts[0].text}"
                    left = 3
                    while left:
                        left -= not tokens[step].blank
                        step += 1
        elif t.text == "==":
            piece = "="
        elif t.text == "&&":
            piece = "AND"
        elif t.text == "||" and context[-1] == "predicate":
            piece = "OR"
        elif t.text == "?" and following.kind == "number":
            piece, step = f":p{following.text}", after + 1
        elif t.text in ("@", "$") and following.kind == "word":
            piece = ":"
        out.append(piece)
        last = tokens[step - 1].upper if step - 1 < len(tokens) else ""
        i = step
    return "".join(out)


def _call(word: str, inner: list[Token]) -> str:
    parts = [p for p in tk.split(inner) if tk.solid(p)]
    args = [rewrite(p).strip() for p in parts]
    raw = [s[0].value if len(s) == 1 and s[0].kind == "string" else None for s in map(tk.solid, parts)]
    if word == "DATE":
        return compat.date_sql(args, raw)
    if word == "STRFTIME":
        if len(args) != 2 or raw[0] is None:
            raise DialectError("strftime takes a literal format and one value")
        return compat.strftime_sql(raw[0], args[1])
    if len(args) != 1:
        raise DialectError(f"{word.lower()} takes one argument")
    return compat.total_sql(args[0]) if word == "TOTAL" else compat.mul_sql(args[0])


# --- UDX definitions ------------------------------------------------------------------------

_OPTIONS = {
    "INPUT_ROW_DELIMITER": "input_row", "INPUT_COL_DELIMITER": "input_col", "INPUT_RECORD_DELIMITER": "input_record",
    "OUTPUT_ROW_DELIMITER": "output_row", "OUTPUT_COL_DELIMITER": "output_col", "OUTPUT_RECORD_DELIMITER": "output_record",
}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "0": "\0"}


def unescape(value: str) -> str:
    """Backslash escapes of separators."""
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), value)


def definitions(tokens: list[Token]) -> tuple[list[Token], dict[str, Udx], list[Token]]:
    """(query, its UDX definitions, what stands after them). Definitions begin at a WITH that is followed by name = "command"."""
    depth = 0
    for i, t in enumerate(tokens):
        depth += (t.text == "(") - (t.text == ")")
        if not depth and t.upper == "WITH" and t.kind == "word":
            nearby = tk.solid(tokens[i + 1 : i + 12])[:3]
            if len(nearby) == 3 and nearby[0].kind == "word" and nearby[1].text == "=" and nearby[2].kind == "string":
                found, rest = _definitions(tk.solid(tokens[i + 1 :]))
                return tokens[:i], found, rest
    return tokens, {}, []


def _definitions(parts: list[Token]) -> tuple[dict[str, Udx], list[Token]]:
    found: dict[str, Udx] = {}
    i = 0
    while i + 2 < len(parts) and parts[i].kind == "word" and parts[i + 1].text == "=" and parts[i + 2].kind == "string":
        name, fields = parts[i].text, {"command": parts[i + 2].value}
        i += 3
        while i + 1 < len(parts) and (word := parts[i].upper) in (*_OPTIONS, "INPUT", "OUTPUT"):
            value = parts[i + 1]
            if word in _OPTIONS:
                if value.kind == "string":
                    fields[_OPTIONS[word]] = unescape(value.value)
                elif value.upper in NAMED:
                    fields[_OPTIONS[word]] = NAMED[value.upper]
                else:
                    raise DialectError(f"{word} takes a string or one of {', '.join(NAMED)}, not {value.text}")
            elif value.kind == "string":
                fields[word.lower()] = value.value
            elif value.upper not in ("STDIN", "STDOUT"):
                raise DialectError(f"{word} takes a path in quotes, STDIN or STDOUT, not {value.text}")
            i += 2
        found[name] = Udx(name, **fields)
        i += i < len(parts) and parts[i].text == ","
    return found, parts[i:]


def tail(parts: list[Token]) -> tuple[dict[str, str], list[Token]]:
    """Collective ID and block size at a query's end, and what is left."""
    out: dict[str, str] = {}
    i = 0
    while i < len(parts):
        if parts[i].upper == "COLLECTIVE" and i + 2 < len(parts) and parts[i + 1].upper == "BY":
            out["collective"] = parts[i + 2].text
            i += 3
        elif parts[i].text == "-" and i + 2 < len(parts) and parts[i + 1].text in ("b", "block"):
            out["block"] = parts[i + 2].text
            i += 3
        else:
            break
    return out, parts[i:]


# --- SELECT with UDX calls ------------------------------------------------------------------


@dataclass
class UdxQuery:
    """base: SQL below the calls; output: (column of the result, its name); what remains is done above the calls."""

    base: str
    calls: list[Call]
    keep: list[tuple[str, str]]
    output: list[tuple[str, str]]
    distinct: bool = False
    above: str = ""
    hidden: list[str] = field(default_factory=list)


def _alias(item: list[Token]) -> tuple[list[Token], list[str]]:
    """An item of a select list without its alias, and the alias names."""
    at = tk.find(item, {"AS"})
    if at >= 0:
        names = [t.text.strip("`") for t in tk.solid(item[at + 1 :]) if t.kind in ("word", "quoted")]
        return item[:at], names
    return item, []


def _udx_call(expr: list[Token], defs: dict[str, Udx]) -> tuple[list[Udx], list[list[Token]]] | None:
    """(commands, outermost first; arguments) if the whole expression is a call of a defined name."""
    parts = tk.solid(expr)
    if len(parts) < 3 or parts[0].kind != "word" or parts[0].text not in defs or parts[1].text != "(" or tk.closing(parts, 1) != len(parts) - 1:
        return None
    inner = parts[2:-1]
    deeper = _udx_call(inner, defs)
    if deeper:
        return [defs[parts[0].text], *deeper[0]], deeper[1]
    return [defs[parts[0].text]], tk.split(inner)


def calls_any(tokens: list[Token], names: set[str]) -> bool:
    parts = tk.solid(tokens)
    return any(a.kind == "word" and a.text in names and b.text == "(" for a, b in zip(parts, parts[1:]))


def split_select(tokens: list[Token]) -> tuple[bool, list[list[Token]], list[Token], list[Token], list[Token]]:
    """(distinct, items, FROM to HAVING, ORDER BY terms, LIMIT and OFFSET)."""
    start = tk.find(tokens, {"SELECT"})
    if start < 0:
        raise DialectError("a UDX needs a SELECT: " + tk.text(tokens)[:80])
    end = tk.find(tokens, {"FROM"}, start)
    order, limit = tk.find(tokens, {"ORDER"}, start), tk.find(tokens, {"LIMIT", "OFFSET"}, start)
    last = min(x for x in (order, limit, len(tokens)) if x >= 0)
    if tk.find(tokens, {"UNION", "INTERSECT", "EXCEPT"}, start) >= 0:
        raise DialectError("a UDX and a compound operator in one SELECT: put the SELECT with the UDX into parentheses")
    head = tokens[start + 1 : end if end >= 0 else last]
    first = tk.following(head, 0)
    distinct = first < len(head) and head[first].upper == "DISTINCT"
    if first < len(head) and head[first].upper in ("DISTINCT", "ALL"):
        head = head[first + 1 :]
    terms = tokens[order : limit if limit > order else len(tokens)] if order >= 0 else []
    return distinct, tk.split(head), tokens[end:last] if end >= 0 else [], terms, tokens[limit:] if limit >= 0 else []


def plan_udx(tokens: list[Token], defs: dict[str, Udx]) -> UdxQuery:
    """How a SELECT with UDX calls runs: below them everything but DISTINCT, ORDER BY and LIMIT."""
    distinct, items, body, order, limit = split_select(tokens)
    below: list[str] = []
    calls: list[Call] = []
    keep: list[tuple[str, str]] = []
    output: list[tuple[str, str]] = []
    for i, item in enumerate(items):
        expr, names = _alias(item)
        found = _udx_call(expr, defs)
        if found is None:
            if calls_any(expr, set(defs)):
                raise DialectError("a UDX call must stand alone in the select list: " + tk.text(expr).strip())
            parts = tk.solid(expr)
            if parts[-1].text == "*":
                below.append(rewrite(expr).strip())
                output.append(("*", "*"))
                continue
            name = names[0] if names else parts[-1].text.strip("`") if all(p.kind in ("word", "quoted") or p.text == "." for p in parts) else tk.text(expr).strip()
            below.append(f"{rewrite(expr).strip()} AS `udx keep {i}`")
            keep.append((f"udx keep {i}", name))
            output.append((f"udx keep {i}", name))
            continue
        commands, arguments = found
        args = []
        for k, a in enumerate(arguments):
            below.append(f"CAST({rewrite(a).strip()} AS STRING) AS `udx in {i} {k}`")
            args.append(f"udx in {i} {k}")
        names = names or [tk.text(expr).strip()]
        outs = tuple(f"udx out {i} {k}" for k in range(len(names)))
        calls.append(Call(tuple(reversed(commands)), tuple(args), outs))
        output += list(zip(outs, names))
    hidden, above = [], ""
    if order:
        known = {name.lower() for _, name in output}
        by = tk.find(order, {"BY"})
        terms = []
        for k, term in enumerate(tk.split(order[by + 1 :])):
            parts = tk.solid(term)
            direction = [p.text for p in parts if p.upper in ("ASC", "DESC", "NULLS", "FIRST", "LAST")]
            what = [p for p in parts if p.upper not in ("ASC", "DESC", "NULLS", "FIRST", "LAST")]
            plain = all(p.kind in ("word", "quoted", "number") or p.text == "." for p in what)
            if plain and (what[-1].text.strip("`").lower() in known or what[-1].kind == "number"):
                terms.append(" ".join([what[-1].text, *direction]))
            else:
                below.append(f"{rewrite(what if not plain else what).strip()} AS `udx order {k}`")
                hidden.append(f"udx order {k}")
                terms.append(" ".join([f"`udx order {k}`", *direction]))
        above = "ORDER BY " + ", ".join(terms)
    if limit:
        above += " " + rewrite(limit).strip()
    return UdxQuery("SELECT " + ", ".join(below) + " " + rewrite(body).strip(), calls, keep, output, distinct, above.strip(), hidden)


# --- DDL ------------------------------------------------------------------------------------

#: Declared types and Spark's.
TYPES = {
    "INT": "BIGINT", "INTEGER": "BIGINT", "REAL": "DOUBLE", "FLOAT": "DOUBLE", "TEXT": "STRING", "VARCHAR": "STRING",
    "DATE": "DATE", "BLOB": "BINARY", "NULL": "STRING",
}


@dataclass
class TableColumn:
    name: str
    type: str = "STRING"
    declared: str = "VARCHAR"
    key: bool = False
    required: bool = False


@dataclass
class CreateTable:
    name: str
    columns: list[TableColumn] = field(default_factory=list)
    query: list[Token] | None = None
    if_not_exists: bool = False
    temporary: bool = False
    using: str | None = None
    nodes: list[str] = field(default_factory=list)
    node_file: str | None = None
    partition: list[str] = field(default_factory=list)
    chunk: int = 1
    replica: int = 1
    ddl: str = ""


def _suffix(tokens: list[Token], spec: CreateTable) -> list[Token]:
    """Take ON nodes, PARTITION BY, CHUNK and REPLICA off the end."""
    for word in ("REPLICA", "CHUNK", "PARTITION", "ON"):
        ats = [i for i, t in enumerate(tokens) if t.kind == "word" and t.upper == word]
        if not ats:
            continue
        at, rest = ats[-1], tk.solid(tokens[ats[-1] + 1 :])
        if word in ("REPLICA", "CHUNK"):
            if len(rest) == 1 and rest[0].kind == "number":
                setattr(spec, word.lower(), int(rest[0].text))
                tokens = tokens[:at]
        elif word == "PARTITION":
            if rest and rest[0].upper == "BY" and all(t.kind in ("word", "quoted") or t.text in ",." for t in rest[1:]):
                spec.partition = [t.text.strip("`") for t in rest[1:] if t.kind in ("word", "quoted")]
                tokens = tokens[:at]
        elif rest and rest[0].upper == "FILE":
            spec.node_file = tk.text(tokens[at + 1 :]).split(None, 1)[1].strip().strip("'\"")
            tokens = tokens[:at]
        else:
            where = tk.text(tokens[at + 1 :]).strip()
            if where and re.fullmatch(r"[\w!\[\]+\-,;:.\s]+", where) and not re.search(r"\b(and|or|is|not|in|like|group|order|where|limit)\b", where, re.I):
                from .nodes import expand

                spec.nodes = [n for part in where.split() for n in expand(part)]
                tokens = tokens[:at]
    return tokens


def create_table(tokens: list[Token]) -> CreateTable:
    spec = CreateTable("", ddl=tk.text(tokens).strip())
    tokens = _suffix(tokens, spec)
    i = tk.following(tokens, tk.find(tokens, {"CREATE"}) + 1)
    kind = tokens[i].upper
    if kind in ("TEMP", "TEMPORARY", "VIRTUAL"):
        spec.temporary = kind != "VIRTUAL"
        i = tk.following(tokens, i + 1)
    i = tk.following(tokens, i + 1)  # after TABLE
    if tokens[i].upper == "IF":
        spec.if_not_exists = True
        for _ in range(3):
            i = tk.following(tokens, i + 1)
    spec.name = tokens[i].text.strip("`")
    i = tk.following(tokens, i + 1)
    if i < len(tokens) and tokens[i].text == ".":
        i = tk.following(tokens, i + 1)
        spec.name += "." + tokens[i].text.strip("`")
        i = tk.following(tokens, i + 1)
    if i < len(tokens) and tokens[i].upper == "USING":
        i = tk.following(tokens, i + 1)
        spec.using = tokens[i].text.lower()
        if spec.using not in ("fts3", "fts4", "fts4aux"):
            raise DialectError(f"USING {tokens[i].text} is not known")
        i = tk.following(tokens, i + 1)
    if i < len(tokens) and tokens[i].upper == "AS":
        spec.query = tokens[i + 1 :]
        return spec
    if i >= len(tokens) or tokens[i].text != "(":
        raise DialectError("CREATE TABLE needs columns or AS SELECT: " + spec.ddl[:80])
    for part in tk.split(tokens[i + 1 : tk.closing(tokens, i)]):
        words = tk.solid(part)
        if not words:
            continue
        upper = [w.upper for w in words]
        if upper[0] in ("PRIMARY", "UNIQUE", "CHECK", "FOREIGN", "CONSTRAINT"):
            if "PRIMARY" in upper:
                inside = {w.text.strip("`").lower() for w in words[upper.index("(") + 1 :]}
                for c in spec.columns:
                    c.key |= c.name.lower() in inside
            continue
        column = TableColumn(words[0].text.strip("`"))
        if len(words) > 1 and upper[1] in TYPES:
            column.declared, column.type = upper[1], TYPES[upper[1]]
        elif len(words) > 1 and upper[1] in ("BIGINT", "DOUBLE", "STRING", "TIMESTAMP", "BOOLEAN", "CHAR", "DECIMAL", "SMALLINT"):
            column.declared, column.type = upper[1], {"CHAR": "STRING"}.get(upper[1], tk.text(part[tk.following(part, tk.following(part, 0) + 1) :]).strip() if upper[1] == "DECIMAL" else upper[1])
        column.key = "PRIMARY" in upper
        column.required = column.key or any(a == "NOT" and b == "NULL" for a, b in zip(upper, upper[1:]))
        spec.columns.append(column)
    return spec


@dataclass
class CreateIndex:
    name: str
    table: str
    columns: list[str]
    unique: bool
    if_not_exists: bool


def create_index(tokens: list[Token]) -> CreateIndex:
    words = tk.solid(tokens)
    upper = [w.upper for w in words]
    on = upper.index("ON")
    inside = tk.split(words[upper.index("(", on) + 1 : -1])
    table = "".join(w.text for w in words[on + 1 : upper.index("(", on)])
    return CreateIndex(words[on - 1].text, table, [p[0].text.strip("`") for p in inside], "UNIQUE" in upper, "IF" in upper)


__all__ = ["Call", "CreateIndex", "CreateTable", "DialectError", "UdxError", "UdxQuery", "create_index", "create_table", "definitions", "match_regex", "plan_udx", "rewrite", "tail", "unescape"]
