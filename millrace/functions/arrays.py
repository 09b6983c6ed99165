"""array_length, array_sum, array_min, array_max and array_avg as higher-order expressions.

Calls are rewritten to Spark's own array functions, so nothing leaves the JVM.
The optional second argument is an arithmetic expression over the fields of an
element: names (the last part of a.b counts), numbers, + - * / and parentheses. An
element of which an operand is null, or that divides by zero, is skipped. Of
no values at all the result is NULL, not 0. Results are doubles.
"""

from __future__ import annotations

import re

from ..errors import TransformError

_TOKEN = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)|(?P<name>[A-Za-z_]\w*(?:\s*\.\s*[A-Za-z_]\w*)*|\"[^\"]+\")|(?P<op>[-+*/()]))")
NAMES = ("array_length", "array_sum", "array_min", "array_max", "array_avg")


def parse(text: str):
    """A tree of ('number', x), ('field', name) and (op, left, right). What follows a whole expression isn't looked at."""
    tokens: list[tuple[str, str]] = []
    at = 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            if tokens:
                break
            raise TransformError(f"can't read {text!r} from {text[at:]!r}")
        tokens.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    place = 0

    def peek() -> tuple[str, str]:
        return tokens[place] if place < len(tokens) else ("end", "")

    def take() -> tuple[str, str]:
        nonlocal place
        place += 1
        return tokens[place - 1] if place <= len(tokens) else ("end", "")

    def operand():
        kind, value = take()
        if kind == "number":
            return "number", float(value)
        if kind == "name":
            if peek() == ("op", "("):
                raise TransformError(f"functions such as {value} aren't allowed in an element expression")
            return "field", re.split(r"\s*\.\s*", value)[-1].strip('"')
        if (kind, value) == ("op", "("):
            inner = sum_()
            if take() != ("op", ")"):
                raise TransformError(f"a parenthesis isn't closed in {text!r}")
            return inner
        raise TransformError(f"a name or number is missing in {text!r}")

    def product():
        left = operand()
        while peek() in (("op", "*"), ("op", "/")):
            left = (take()[1], left, operand())
        return left

    def sum_():
        left = product()
        while peek() in (("op", "+"), ("op", "-")):
            left = (take()[1], left, product())
        return left

    return sum_()


def fields(tree) -> set[str]:
    return {tree[1]} if tree[0] == "field" else set() if tree[0] == "number" else fields(tree[1]) | fields(tree[2])


def evaluate(tree, element: dict) -> float | None:
    """The expression for one element, None where it is skipped."""
    if tree[0] == "number":
        return tree[1]
    if tree[0] == "field":
        value = element[tree[1]]
        return None if value is None else float(value)
    a, b = evaluate(tree[1], element), evaluate(tree[2], element)
    if a is None or b is None or tree[0] == "/" and b == 0:
        return None
    return {"+": a.__add__, "-": a.__sub__, "*": a.__mul__, "/": a.__truediv__}[tree[0]](b)


def element_sql(tree, name: str) -> str:
    """Spark SQL for the expression on the lambda variable `name`."""
    if tree[0] == "number":
        return f"{tree[1]!r}D"
    if tree[0] == "field":
        return f"cast({name}.`{tree[1]}` as double)"
    a, b = element_sql(tree[1], name), element_sql(tree[2], name)
    return f"({a} / nullif({b}, 0D))" if tree[0] == "/" else f"({a} {tree[0]} {b})"


def rewrite_call(name: str, args: list[str]) -> str:
    """Spark SQL for a call of one of NAMES."""
    if name == "array_length":
        if len(args) != 1:
            raise TransformError("array_length takes one array")
        return f"cast(size({args[0]}) as bigint)"
    if len(args) not in (1, 2):
        raise TransformError(f"{name} takes an array and, if its elements are structs, an expression")
    if len(args) == 2:
        literal = re.fullmatch(r"\s*'((?:[^']|'')*)'\s*", args[1])
        if not literal:
            raise TransformError(f"the second argument of {name} must be a string literal")
        value = element_sql(parse(literal.group(1).replace("''", "'")), "mr_e")
    else:
        value = "cast(mr_e as double)"
    values = f"filter(transform({args[0]}, mr_e -> {value}), mr_v -> mr_v is not null)"
    total = "aggregate(mr_a, 0D, (mr_s, mr_v) -> mr_s + mr_v)"
    # an array in an array gives the values a name, so that they are computed once
    body = {
        "array_sum": f"case when mr_a is null or size(mr_a) = 0 then cast(null as double) else {total} end",
        "array_avg": f"case when mr_a is null or size(mr_a) = 0 then cast(null as double) else {total} / size(mr_a) end",
        "array_min": "case when mr_a is null or size(mr_a) = 0 then cast(null as double) else coalesce(array_min(filter(mr_a, mr_v -> not isnan(mr_v))), double('Infinity')) end",
        "array_max": "case when mr_a is null or size(mr_a) = 0 then cast(null as double) else coalesce(array_max(filter(mr_a, mr_v -> not isnan(mr_v))), double('-Infinity')) end",
    }[name]
    return f"transform(array({values}), mr_a -> {body})[0]"
