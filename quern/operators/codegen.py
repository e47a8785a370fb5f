"""Macro calls to the Rust of a build script: one rule for each probe macro, the others verbatim.

Rules are functions of a macro node; bodies are rendered by the caller.  What
has no rule is printed as it stands and named in ``banned_names``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from quern.operators import rendering
from quern.sources.shell import Node, literal

Body = Callable[[list[Node]], str]


def c_name(text: str) -> str:
    return re.sub("[^A-Z0-9]", "_", text.replace("*", "P").upper())


def _arg(n: Node, k: int) -> str:
    return n.args[k][1] if len(n.args) > k and n.args[k][0] == "Literal" else ""


def _items(n: Node, k: int) -> list[str]:
    return [x for x in re.split(r"[\s,]+", _arg(n, k)) if x]


def _commands(n: Node, k: int) -> list[Node]:
    return n.args[k][1] if len(n.args) > k and n.args[k][0] == "Commands" else []


def _strings(items: list[str]) -> str:
    return "&[" + ", ".join(f'"{x}"' for x in items) + "]"


def define(key: str, value: str | None, policies: dict[str, tuple[str, str | None]]) -> str:
    """A definition by the symbol's policy: a cfg flag, an environment variable, or nothing."""
    kind, fixed = policies.get(key, ("Cfg", None))
    if kind == "Cfg":
        return f'println!("cargo:rustc-cfg={c_name(key).lower()}");'
    if kind == "Env":
        return f'println!("cargo:rustc-env={key}={value or 1}");'
    return ""


def _probe(call: str, found: list[str], missing: str, indent: str = "    ") -> str:
    text = f"if {call} {{\n" + "\n".join(indent + line for x in found if x for line in x.split("\n")) + "\n}"
    return text + (f" else {{\n{indent}" + missing.replace("\n", "\n" + indent) + "\n}" if missing else "")


def render(n: Node, body: Body, policies: dict[str, tuple[str, str | None]] | None = None) -> str | None:
    """The Rust of one macro call, None where there is no rule."""
    policies = policies or {}
    name, out = n.text, []
    yes, no = (lambda k: body(_commands(n, k)) if _commands(n, k) else ""), (lambda k: body(_commands(n, k)) if _commands(n, k) else "")
    if name in ("AC_CHECK_HEADER", "AC_CHECK_HEADERS", "AC_CHECK_FUNC", "AC_CHECK_FUNCS", "AC_CHECK_TYPE", "AC_CHECK_TYPES", "AC_CHECK_DECL", "AC_CHECK_DECLS"):
        kind = {"HEADER": "header", "FUNC": "func", "TYPE": "type", "DECL": "decl"}[name.removeprefix("AC_CHECK_").rstrip("S")]
        many = name.endswith("S")
        items = [x.strip() for x in _arg(n, 0).split(",") if x.strip()] if kind in ("type", "decl") else _items(n, 0)
        prefix = "HAVE_DECL_" if kind == "decl" else "HAVE_"
        for x in items:
            extra = f', "{_arg(n, 3)}"' if kind in ("type", "decl") else ""
            out.append(_probe(f'check_{kind}("{x}"{extra})', [define(prefix + c_name(x), "1", policies) if many else "", yes(1)], no(2)))
        return "\n".join(out)
    if name in ("AC_CHECK_LIB", "AC_SEARCH_LIBS"):
        libs, func = (_items(n, 0), _arg(n, 1)) if name == "AC_CHECK_LIB" else (_items(n, 1), _arg(n, 0))
        key = define("HAVE_LIB" + c_name(libs[0]) if libs else "", "1", policies) if name == "AC_CHECK_LIB" and not _commands(n, 2) else ""
        head = f'if let Some(lib) = check_library("{func}", {_strings(libs)}, {_strings(_items(n, 4))}, {str(name == "AC_SEARCH_LIBS").lower()}) {{\n    LIBS.push(lib);\n'
        text = head + "".join(f"    {line}\n" for x in (key, yes(2)) if x for line in x.split("\n")) + "}"
        return text + (" else {\n    " + no(3) + "\n}" if no(3) else "")
    if name in ("AC_COMPILE_IFELSE", "AC_TRY_COMPILE", "AC_LINK_IFELSE", "AC_TRY_LINK", "AC_RUN_IFELSE"):
        old = "TRY" in name
        code = _arg(n, 0) + ("\nint main(void) { " + _arg(n, 1) + " ; return 0; }" if old else "")
        kind = "link" if "LINK" in name or "RUN" in name else "compile"
        return _probe(f'check_{kind}(r#"{_program(code)}"#)', [yes(2 if old else 1)], no(3 if old else 2))
    if name == "AC_CHECK_SIZEOF":
        key = "SIZEOF_" + c_name(_arg(n, 0))
        return f'if let Some(size) = check_sizeof("{_arg(n, 0)}", "{_arg(n, 2)}") {{\n    println!("cargo:rustc-env={key}={{}}", size);\n}}'
    if name == "AC_DEFINE":
        return define(_arg(n, 0), _arg(n, 1) if _arg(n, 1) not in ("", "0", "1") else None, policies)
    if name == "AC_DEFINE_UNQUOTED":
        value = n.args[1][1] if len(n.args) > 1 and n.args[1][0] == "Word" else []
        text, names = format_string(value)
        return f'println!("cargo:rustc-env={_arg(n, 0)}={text}"{"".join(", " + v for v in names)});'
    if name == "AC_CACHE_CHECK":
        return f"// {_arg(n, 0)}\n" + body(_commands(n, 2))
    if name == "AC_CONFIG_LINKS":
        return "\n".join("ln -s {1} {0}".format(*x.split(":", 1)) for x in _items(n, 0) if ":" in x)
    if name == "PKG_CHECK_MODULES":
        prefix, wanted = _arg(n, 0), re.findall(r"[A-Za-z0-9_.+-]+(?:\s*(?:>=|<=|=|<|>)\s*[\w.]+)?", _arg(n, 1))
        out = [f"let mut {prefix}_CFLAGS = Vec::new();", f"let mut {prefix}_LIBS = Vec::new();"]
        for w in wanted:
            flag = define("HAVE_" + c_name(re.match(r"[A-Za-z0-9_.+-]+", w)[0]), "1", policies)
            out.append(f'if let Some(lib) = run_pkg_config("{w}") {{\n    {flag}\n    {prefix}_CFLAGS.extend(lib.cflags);\n    {prefix}_LIBS.extend(lib.libs);\n' + (f"    {yes(2)}\n" if yes(2) else "") + "}" + (f" else {{\n    {no(3)}\n}}" if no(3) else ""))
        return "\n".join(out)
    return None


def _program(code: str) -> str:
    """AC_LANG_PROGRAM and AC_LANG_SOURCE opened to plain C."""
    code = code.strip()
    if m := re.match(r"AC_LANG_SOURCE\(\[*(.*?)\]*\)$", code, re.S):
        return m[1]
    if m := re.match(r"AC_LANG_PROGRAM\(\[*(.*?)\]*\s*,\s*\[*(.*?)\]*\)$", code, re.S):
        return m[1] + "\nint main(void) {\n" + m[2] + "\nreturn 0;\n}"
    return code


def format_string(word: list) -> tuple[str, list[str]]:
    """A Rust format string and its variables in order."""
    text, names = "", []
    for f in word:
        if f[0] == "dq":
            inner, more = format_string(f[1])
            text, names = text + inner, names + more
        elif f[0] == "var":
            text, names = text + "{}", [*names, f[1]]
        else:
            text += (f[1] if f[0] in ("lit", "glob") else rendering.fragment(f)).replace("{", "{{").replace("}", "}}").replace('"', '\\"')
    return text, names


def required_functions(code: str) -> list[str]:
    """Helpers that generated code calls, in a fixed order."""
    names = ("check_header", "check_library", "check_decl", "check_func", "check_compile", "check_link", "check_type", "check_sizeof", "execute_cmd", "run_pkg_config", "run_bindgen")
    return [n for n in names if re.search(rf"\b{n}\(", code)]


def banned_names(nodes: list[Node]) -> set[str]:
    """Macros that are printed verbatim and so must not be left in translated code."""
    out = set()
    for n in nodes:
        if n.kind == "Macro" and render(n, lambda b: "") is None:
            out.add(n.text)
        for body in [b for _, b in n.branches] + [a[1] for a in n.args if a[0] == "Commands"]:
            out |= banned_names(body)
    return out


def assignment(n: Node, kind: str) -> str | None:
    """An assignment that needs no translation, by the variable's type; None for another."""
    value, word = literal(n.words[0]), n.words[0]
    flat = [f for x in word for f in (x[1] if x[0] == "dq" else [x])]
    if value is not None:
        if kind == "Boolean":
            return f"{n.text} = {str(value in ('yes', '1', 'true', 'on')).lower()};"
        if kind == "Integer":
            return f"{n.text} = {value or 0};" if value.isdigit() or not value else None
        if kind == "Path":
            return f'{n.text} = PathBuf::from("{value}");'
        if kind.startswith("List"):
            return f"{n.text} = vec![" + ", ".join(f'"{x}".to_string()' for x in value.split()) + "];"
        return f'{n.text} = "{value}".to_string();'
    if len(flat) == 1 and flat[0][0] == "var":
        return f"{n.text} = {flat[0][1]}.clone();"
    if flat and flat[0] == ("var", n.text) and len(flat) == 2 and flat[1][0] == "lit":
        rest = flat[1][1]
        return "".join(f'{n.text}.push("{x}".to_string());' for x in rest.split()) if kind.startswith("List") else f'{n.text}.push_str("{rest}");'
    return None
