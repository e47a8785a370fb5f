"""Syntax trees back to shell text, and guards to Rust expressions."""

from __future__ import annotations

import re

from quern.sources.shell import Node, literal

_TEST = {"Eq": "=", "Neq": "!=", "Lt": "-lt", "Le": "-le", "Gt": "-gt", "Ge": "-ge"}
_UNARY = {"Empty": "-z", "NonEmpty": "-n", "Dir": "-d", "File": "-f"}
_SUBST = {"Default": ":-", "Assign": ":=", "Error": ":?", "Alternative": "+", "RemoveSmallestSuffix": "%", "RemoveLargestSuffix": "%%", "RemoveSmallestPrefix": "#", "RemoveLargestPrefix": "##"}
_REDIRECT = {"Read": "<", "Write": ">", "ReadWrite": "<>", "Append": ">>", "Clobber": ">|", "Heredoc": "<<", "DupRead": "<&", "DupWrite": ">&"}


def word(fragments: list, quote: bool = False) -> str:
    """A word; ``quote`` puts a lone literal into single quotes unless it holds one."""
    if not fragments:
        return '""'
    if quote and len(fragments) == 1 and fragments[0][0] == "lit":
        text = fragments[0][1]
        return f"'{text}'" if "'" not in text else text
    return "".join(map(fragment, fragments))


def _plain(text: str) -> str:
    """A literal outside of quotes: in single quotes, or escaped, where the shell would read it otherwise."""
    if not re.search(r"""[\s;&|<>()*?#$`"'\\]""", text):
        return text
    return f"'{text}'" if "'" not in text else re.sub(r"""([^\w./:=@%+,-])""", r"\\\1", text)


def fragment(f) -> str:
    kind = f[0]
    if kind == "lit":
        return _plain(f[1])
    if kind == "glob":
        return f[1]
    if kind == "dq":
        return '"' + "".join(re.sub(r'([$`"\\])', r"\\\1", x[1]) if x[0] == "lit" else fragment(x) for x in f[1]) + '"'
    if kind == "var":
        return "$" + f[1] if len(f[1]) == 1 and not f[1].isalpha() else "${" + f[1] + "}"
    if kind == "subst":
        return f"${{#{f[2]}}}" if f[1] == "Len" else "${" + f[2] + _SUBST[f[1]] + "".join(map(fragment, f[3])) + "}"
    if kind == "cmd":
        return f"$({f[1]})"
    if kind == "arith":
        return f"$(({f[1]}))"
    return f[1] + "(" + ", ".join(argument(a, 0) for a in f[2]) + ")"


def condition(c) -> str:
    op = c[0]
    if op == "Const":
        return "true" if c[1] else "false"
    if op == "After":
        return "; ".join([*(node(n) for n in c[1]), condition(c[2])])
    if op == "Not":
        return "! " + condition(c[1])
    if op in ("And", "Or"):
        return condition(c[1]) + (" && " if op == "And" else " || ") + condition(c[2])
    if op == "Cmd":
        return node(c[1])
    if op in _UNARY:
        return f"test {_UNARY[op]} {word(c[1])}"
    if op == "Match":
        return f"case {word(c[1])} in {word(c[2])}"
    return f"test {word(c[1])} {_TEST[op]} {word(c[2])}"


def argument(a, indent: int) -> str:
    if a[0] == "Commands":
        return "[\n" + body(a[1], indent + 1) + "\n" + "  " * indent + "]"
    return "[" + (condition(a[1]) if a[0] == "Condition" else word(a[1]) if a[0] == "Word" else a[1]) + "]"


def body(nodes: list[Node], indent: int) -> str:
    return "\n".join("  " * indent + node(n, indent) for n in nodes)


def node(n: Node, indent: int = 0) -> str:
    pad, inner = "  " * indent, lambda b: body(b[1], indent + 1)
    if n.kind == "Assignment":
        return f"{n.text}={word(n.words[0], quote=True) if n.words[0] else ''}"
    if n.kind == "Command":
        return " ".join(map(word, n.words))
    if n.kind == "Macro":
        return n.text + ("(" + ", ".join(argument(a, indent) for a in n.args) + ")" if n.args else "")
    if n.kind in ("Brace", "Subshell"):
        left, right = "{}" if n.kind == "Brace" else "()"
        return f"{left}\n{inner(n.branches[0])}\n{pad}{right}"
    if n.kind == "If":
        out = []
        for k, b in enumerate(n.branches):
            out.append((f"{'if' if k == 0 else pad + 'elif'} {condition(b[0])}; then" if b[0] else pad + "else") + "\n" + inner(b))
        return "\n".join(out) + f"\n{pad}fi"
    if n.kind == "For":
        return f"for {n.text} in {' '.join(map(word, n.words))}; do\n{inner(n.branches[0])}\n{pad}done"
    if n.kind in ("While", "Until"):
        return f"{n.kind.lower()} {condition(n.branches[0][0])}; do\n{inner(n.branches[0])}\n{pad}done"
    if n.kind == "Case":
        arms = [f"{pad}  {'|'.join(map(word, p))})\n{body(b, indent + 2)}\n{pad}    ;;" for p, b in n.branches]
        return f"case {word(n.words[0])} in\n" + "\n".join(arms) + f"\n{pad}esac"
    if n.kind in ("And", "Or"):
        return condition(n.branches[0][0]) + (" && " if n.kind == "And" else " || ") + node(n.branches[0][1][0], indent)
    if n.kind == "Pipe":
        return ("! " if n.text else "") + " | ".join(node(x, indent) for x in n.branches[0][1])
    if n.kind == "Background":
        return node(n.branches[0][1][0], indent) + " &"
    if n.kind == "Function":
        return f"{n.text} () {{\n{inner(n.branches[0])}\n{pad}}}"
    shown = []
    for kind, fd, target in n.redirects:
        shown.append(f"{fd}{_REDIRECT[kind]}" + (f"_EOF\n{literal(target)}_EOF\n" if kind == "Heredoc" else " " + word(target)))
    return node(n.branches[0][1][0], indent) + " " + " ".join(shown)


def script(nodes: list[Node]) -> str:
    return "\n".join(map(node, nodes)) + "\n"


def guard_as_rust(guard, types: dict[str, str] | None = None) -> str:
    """A Rust expression: configuration tests as ``cfg!``, variables by their type."""
    types = types or {}
    if guard[0] == "const":
        return str(guard[1]).lower()
    if guard[0] in ("and", "or"):
        return "(" + (" && " if guard[0] == "and" else " || ").join(guard_as_rust(g, types) for g in guard[1]) + ")"
    _, kind, name, cond, operand, negated = guard
    no = "!" if negated else ""
    if kind in ("Arch", "Os"):
        return f'{no}cfg!(target_{kind.lower()} = "{name}")'
    if kind == "Arg":
        feature = name if cond in ("True", "False", "Set", "Empty") else f"{name}_{operand}"
        return f'{"!" if negated != (cond in ("False", "Empty")) else ""}cfg!(feature = "{feature}")'
    if kind == "PathExists":
        return f'{"!" if negated != (cond == "NoExists") else ""}std::path::Path::new("{name}").exists()'
    if kind == "Var":
        if types.get(name) == "Boolean" and cond in ("True", "False"):
            return ("!" if negated != (cond == "False") else "") + name
        value = {"True": '"yes"', "False": '"no"'}.get(cond)
        if cond in ("Empty", "Set"):
            return f'{"!" if negated != (cond == "Set") else ""}{name}.is_empty()'
        if cond in ("Lt", "Le", "Gt", "Ge"):
            return f'{no}({name} {dict(Lt="<", Le="<=", Gt=">", Ge=">=")[cond]} {operand})'
        return f'{name} {"!=" if negated else "=="} {value or (operand[1:] if operand.startswith("$") else chr(34) + operand + chr(34))}'
    return f'{no}test("{name or operand}")'
