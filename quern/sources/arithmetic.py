"""Shell arithmetic as trees: ("num", text), ("var", name), ("step", op, name, before), ("un", op, x), ("bin", op, a, b), ("cond", test, a, b), ("set", op, name, x), ("seq", parts)."""

from __future__ import annotations

import re
from collections.abc import Iterator

TOKEN = re.compile(r"\s*(0[xX][0-9a-fA-F]+|\d+|\$\{[A-Za-z_]\w*\}|\$?[A-Za-z_]\w*|\*\*|<<=|>>=|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|[-+*/%&|^!~<>=?:(),])")
#: From the loosest to the tightest; ``**`` alone groups from the right.
LEVELS = [("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", "<=", ">", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%"), ("**",)]
SETS = ("=", "+=", "-=", "*=", "/=", "%=", "<<=", ">>=", "&=", "|=", "^=")


class ArithmeticError_(ValueError):
    """A text that isn't an expression."""


def parse(text: str):
    tokens, at = [], 0
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            raise ArithmeticError_(f"at {text[at:at + 10]!r}")
        tokens.append(m[1])
        at = m.end()
    out, at = _sequence(tokens, 0) if tokens else (("num", "0"), 0)
    if at < len(tokens):
        raise ArithmeticError_(f"at {tokens[at]!r}")
    return out


def _peek(tokens: list[str], at: int) -> str:
    return tokens[at] if at < len(tokens) else ""


def _sequence(tokens, at):
    one, at = _assignment(tokens, at)
    parts = [one]
    while _peek(tokens, at) == ",":
        one, at = _assignment(tokens, at + 1)
        parts.append(one)
    return (parts[0] if len(parts) == 1 else ("seq", parts)), at


def _assignment(tokens, at):
    if re.fullmatch(r"[A-Za-z_]\w*", _peek(tokens, at)) and _peek(tokens, at + 1) in SETS:
        value, end = _assignment(tokens, at + 2)
        return ("set", tokens[at + 1], tokens[at], value), end
    test, at = _binary(tokens, at, 0)
    if _peek(tokens, at) != "?":
        return test, at
    a, at = _assignment(tokens, at + 1)
    if _peek(tokens, at) != ":":
        raise ArithmeticError_("a choice without its other side")
    b, at = _assignment(tokens, at + 1)
    return ("cond", test, a, b), at


def _binary(tokens, at, level):
    if level == len(LEVELS):
        return _unary(tokens, at)
    a, at = _binary(tokens, at, level + 1)
    while _peek(tokens, at) in LEVELS[level]:
        op = tokens[at]
        b, at = _binary(tokens, at + 1, level if op == "**" else level + 1)
        a = ("bin", op, a, b)
    return a, at


def _unary(tokens, at):
    t = _peek(tokens, at)
    if t in ("+", "-", "!", "~"):
        x, at = _unary(tokens, at + 1)
        return ("un", t, x), at
    if t in ("++", "--"):
        return ("step", t, tokens[at + 1].strip("${}"), True), at + 2
    if t == "(":
        x, at = _sequence(tokens, at + 1)
        if _peek(tokens, at) != ")":
            raise ArithmeticError_("an open bracket")
        return x, at + 1
    if t[:1].isdigit():
        return ("num", t), at + 1
    if re.fullmatch(r"\$?\{?[A-Za-z_]\w*\}?", t):
        name = t.strip("${}")
        return (("step", tokens[at + 1], name, False), at + 2) if _peek(tokens, at + 1) in ("++", "--") else (("var", name), at + 1)
    raise ArithmeticError_(f"at {t!r}" if t else "at the end")


def walk(tree) -> Iterator[tuple]:
    """The tree's nodes, parents first."""
    yield tree
    for x in tree[1:]:
        for y in x if isinstance(x, list) else [x]:
            if isinstance(y, tuple):
                yield from walk(y)


def uses(tree) -> list[str]:
    """Variables in the order in which they stand; steps and assignments read them too (a plain ``=`` doesn't)."""
    return [t[1] if t[0] == "var" else t[2] for t in walk(tree) if t[0] in ("var", "step") or t[0] == "set" and t[1] != "="]


def shown(tree) -> str:
    """Back to shell, with brackets around what is nested."""
    kind = tree[0]
    if kind in ("num", "var"):
        return tree[1]
    if kind == "step":
        return tree[1] + tree[2] if tree[3] else tree[2] + tree[1]
    if kind == "un":
        return tree[1] + _bracketed(tree[2], shown)
    if kind == "bin":
        return f"{_bracketed(tree[2], shown)} {tree[1]} {_bracketed(tree[3], shown)}"
    if kind == "cond":
        return " ".join([_bracketed(tree[1], shown), "?", _bracketed(tree[2], shown), ":", _bracketed(tree[3], shown)])
    if kind == "set":
        return f"{tree[2]} {tree[1]} {_bracketed(tree[3], shown)}"
    return ", ".join(map(shown, tree[1]))


def _bracketed(tree, show) -> str:
    return show(tree) if tree[0] in ("num", "var", "step") else f"({show(tree)})"


def as_rust(tree, types: dict[str, str] | None = None) -> str:
    """An i64 expression; texts are read as numbers, comparisons give 0 or 1."""
    types = types or {}
    kind, go = tree[0], lambda t: as_rust(t, types)
    near = lambda t: _bracketed(t, go)
    if kind == "num":
        return str(int(tree[1], 0 if tree[1][:2].lower() == "0x" else 8 if tree[1][0] == "0" and len(tree[1]) > 1 else 10))
    if kind == "var":
        return f"({tree[1]} as i64)" if types.get(tree[1]) == "Integer" else f"{tree[1]}.parse::<i64>().unwrap_or_default()"
    if kind == "step":
        return f"{{ {tree[2]} {tree[1][0]}= 1; {tree[2]} as i64{'' if tree[3] else ' - 1' if tree[1] == '++' else ' + 1'} }}"
    if kind == "un":
        return f"({near(tree[2])} == 0) as i64" if tree[1] == "!" else ("!" if tree[1] == "~" else tree[1]) + near(tree[2])
    if kind == "bin":
        a, b = near(tree[2]), near(tree[3])
        if tree[1] == "**":
            return f"{a}.pow({b} as u32)"
        if tree[1] in ("&&", "||"):
            return f"({a} != 0 {tree[1]} {b} != 0) as i64"
        return f"({a} {tree[1]} {b}) as i64" if tree[1] in ("==", "!=", "<", "<=", ">", ">=") else f"{a} {tree[1]} {b}"
    if kind == "cond":
        return f"if {near(tree[1])} != 0 {{ {go(tree[2])} }} else {{ {go(tree[3])} }}"
    if kind == "set":
        return f"{{ {tree[2]} {tree[1]} {go(tree[3])}; {tree[2]} as i64 }}"
    return "{ " + "; ".join(map(go, tree[1])) + " }"
