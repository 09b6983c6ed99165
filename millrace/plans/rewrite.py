"""Textual rewrites of foreign SQL spellings into Spark's, before parsing.

Strings, comments and quoted names are left alone. Rewriting a rewritten text
gives the same text, so that the gate and the execution see one query.
"""

from __future__ import annotations

import re

from ..errors import TransformError
from ..functions import arrays, json_text

ZONES = ("Europe/Amsterdam",)

_LEX = re.compile(
    r"""(?P<string>'(?:[^'\\]|''|\\.)*')|(?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`)|(?P<comment>--[^\n]*|/\*.*?\*/)|(?P<space>\s+)|(?P<word>[^\W\d]\w*)|(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)|(?P<op>->|<>|!=|>=|<=|\|\||::|.)""",
    re.DOTALL,
)


class Token(str):
    """A piece of SQL text with its kind."""

    kind: str

    def __new__(cls, text: str, kind: str):
        made = super().__new__(cls, text)
        made.kind = kind
        return made


def lex(sql: str) -> list[Token]:
    return [Token(m.group(), m.lastgroup) for m in _LEX.finditer(sql)]


def _solid(tokens: list[Token], at: int, step: int = 1) -> int:
    """Place of the next token that isn't space or comment, from `at` on; -1 or len beyond the ends."""
    while 0 <= at < len(tokens) and tokens[at].kind in ("space", "comment"):
        at += step
    return at


def _close(tokens: list[Token], at: int) -> int:
    """Place of the parenthesis that closes the one at `at`."""
    depth = 0
    for k in range(at, len(tokens)):
        if tokens[k].kind == "op":
            depth += (tokens[k] == "(") - (tokens[k] == ")")
            if not depth:
                return k
    raise TransformError("a parenthesis isn't closed")


def _arguments(tokens: list[Token], first: int, last: int) -> list[tuple[int, int]]:
    """(first, last) of the comma-parted arguments between two parentheses."""
    out, depth, start = [], 0, first + 1
    for k in range(first + 1, last):
        if tokens[k].kind == "op":
            depth += tokens[k] in ("(", "[")
            depth -= tokens[k] in (")", "]")
            if tokens[k] == "," and depth == 0:
                out.append((start, k))
                start = k + 1
    if _solid(tokens, start) < last or out:
        out.append((start, last))
    return out


def _text(tokens: list[Token], first: int, last: int) -> str:
    return "".join(tokens[first:last])


def _name(token: Token) -> str:
    return token[1:-1] if token.kind == "quoted" else str(token)


def statements(sql: str) -> int:
    """How many statements the text has."""
    tokens = lex(sql)
    full, n = False, 0
    for t in tokens:
        if t == ";" and t.kind == "op":
            n, full = n + full, False
        elif t.kind not in ("space", "comment"):
            full = True
    return n + full


def quoted_names(sql: str) -> str:
    """"name" becomes `name`, as Spark reads double quotes as strings."""
    return "".join("`" + t[1:-1].replace('""', '"').replace("`", "``") + "`" if t.kind == "quoted" and t[0] == '"' else t for t in lex(sql))


def json_array_casts(sql: str) -> str:
    """CAST(x AS ARRAY(JSON)) and ARRAY<JSON> become json_array_elements(x)."""
    tokens = lex(sql)
    for k, t in enumerate(tokens):
        if t.kind == "word" and t.lower() in ("cast", "try_cast"):
            first = _solid(tokens, k + 1)
            if first < len(tokens) and tokens[first] == "(":
                last = _close(tokens, first)
                inner = [(j, x) for j, x in enumerate(tokens[first + 1 : last], first + 1) if x.kind not in ("space", "comment")]
                tail = [str(x).lower() for _, x in inner[-5:]]
                if tail in (["as", "array", "(", "json", ")"], ["as", "array", "<", "json", ">"]):
                    return json_array_casts(_text(tokens, 0, k) + f"json_array_elements({_text(tokens, first + 1, inner[-5][0]).strip()})" + _text(tokens, last + 1, len(tokens)))
    return sql


def unix_times(sql: str, zones: tuple[str, ...] = ZONES) -> str:
    """from_unixtime(seconds, 'zone') for the allowed zones; any other form is refused."""
    tokens = lex(sql)
    for k, t in enumerate(tokens):
        if t.kind == "word" and t.lower() == "from_unixtime":
            first = _solid(tokens, k + 1)
            if first >= len(tokens) or tokens[first] != "(":
                continue
            last = _close(tokens, first)
            args = _arguments(tokens, first, last)
            zone = _text(tokens, *args[1]).strip() if len(args) == 2 else ""
            if zone.strip("'") not in zones or zone[:1] != "'":
                raise TransformError(f"from_unixtime is allowed only as from_unixtime(seconds, zone) with a zone of {', '.join(zones)}")
            made = f"cast(from_utc_timestamp(timestamp_seconds({_text(tokens, *args[0]).strip()}), {zone}) as timestamp_ntz)"
            return unix_times(_text(tokens, 0, k) + made + _text(tokens, last + 1, len(tokens)), zones)
    return sql


def unnests(sql: str) -> str:
    """CROSS JOIN UNNEST(x) AS t(c), FROM a, UNNEST(x) AS t(c), and unnest(x) in a select list, as explode."""
    tokens = lex(sql)
    for k, t in enumerate(tokens):
        if t.kind != "word" or t.lower() != "unnest":
            continue
        first = _solid(tokens, k + 1)
        if first >= len(tokens) or tokens[first] != "(":
            continue
        last = _close(tokens, first)
        argument = _text(tokens, first + 1, last).strip()
        back = _solid(tokens, k - 1, -1)
        before = str(tokens[back]).lower() if back >= 0 else ""
        two = _solid(tokens, back - 1, -1)
        lateral = before == "join" and two >= 0 and str(tokens[two]).lower() == "cross"
        if not (lateral or before == "," and _in_from(tokens, back)):
            return unnests(_text(tokens, 0, k) + f"explode({argument})" + _text(tokens, last + 1, len(tokens)))
        # the alias: AS t(c), t(c), AS t or nothing
        after = _solid(tokens, last + 1)
        if after < len(tokens) and str(tokens[after]).lower() == "with":
            raise TransformError("UNNEST ... WITH ORDINALITY isn't supported")
        if after < len(tokens) and str(tokens[after]).lower() == "as":
            after = _solid(tokens, after + 1)
        table, column, end = "mr_unnest", None, last + 1
        if after < len(tokens) and tokens[after].kind in ("word", "quoted") and str(tokens[after]).lower() not in _CLAUSES:
            table, end = str(tokens[after]), after + 1
            names = _solid(tokens, end)
            if names < len(tokens) and tokens[names] == "(":
                close = _close(tokens, names)
                columns = _arguments(tokens, names, close)
                if len(columns) != 1:
                    raise TransformError("UNNEST gives one column")
                column, end = _text(tokens, *columns[0]).strip(), close + 1
        start = two if lateral else back
        alias = f"{table}({column or table})"
        return unnests(_text(tokens, 0, start).rstrip() + f" CROSS JOIN LATERAL explode({argument}) AS {alias}" + _text(tokens, end, len(tokens)))
    return sql


_CLAUSES = {"where", "group", "having", "order", "limit", "union", "intersect", "except", "cross", "left", "right", "inner", "full", "join", "on", "natural", "window", "lateral", "offset"}


def _in_from(tokens: list[Token], at: int) -> bool:
    """Whether the comma at `at` stands in a FROM list."""
    depth = 0
    for k in range(at - 1, -1, -1):
        t = tokens[k]
        if t.kind == "op" and t == ")":
            depth += 1
        elif t.kind == "op" and t == "(":
            if not depth:
                return False
            depth -= 1
        elif not depth and t.kind == "word":
            if t.lower() == "from":
                return True
            if t.lower() in ("select", "where", "by", "having", "on"):
                return False
    return False


def calls(sql: str) -> str:
    """array_* calls as higher-order functions, JSON calls by their internal names."""
    tokens = lex(sql)
    for k, t in enumerate(tokens):
        name = t.lower() if t.kind == "word" else ""
        if name not in arrays.NAMES and name not in json_text.FUNCTIONS:
            continue
        first = _solid(tokens, k + 1)
        back = _solid(tokens, k - 1, -1)
        if first >= len(tokens) or tokens[first] != "(" or back >= 0 and tokens[back] == ".":
            continue
        last = _close(tokens, first)
        args = [calls(_text(tokens, a, b)).strip() for a, b in _arguments(tokens, first, last)]
        if name in arrays.NAMES:
            if name in ("array_min", "array_max") and args and args[0].startswith("filter(mr_a"):
                continue  # made by this rewrite
            made = arrays.rewrite_call(name, args)
            return _text(tokens, 0, k) + made + calls(_text(tokens, last + 1, len(tokens)))
        made = f"{json_text.internal(name)}({', '.join(args)})"
        return _text(tokens, 0, k) + made + calls(_text(tokens, last + 1, len(tokens)))
    return sql


def normalise(sql: str, zones: tuple[str, ...] = ZONES) -> str:
    """All rewrites."""
    if not sql.strip().rstrip(";").strip():
        raise TransformError("the SQL is empty")
    if statements(sql) != 1:
        raise TransformError("one statement is expected")
    return calls(unnests(unix_times(json_array_casts(quoted_names(sql)), zones))).strip().rstrip(";").rstrip()
