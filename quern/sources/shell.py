"""Parser of build scripts: the shell language of configure scripts with M4 macro calls.

``parse`` turns a text into a list of ``Node``.  Everything is plain data:
words are lists of fragments, conditions and macro arguments nested tuples.
What can't be parsed raises ``ScriptError`` with its line; the table reader
makes an error row of it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MACRO = re.compile(r"(?:A[CMHSXU]|LT|PKG|GL|IT|m4)_[A-Za-z0-9_]+")
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
RESERVED = {"if", "then", "elif", "else", "fi", "for", "in", "do", "done", "case", "esac", "while", "until", "{", "}", "!"}

#: Which arguments of a macro (from 0) are commands, and which are a condition; the others are literals, the value of a substitution a word.
COMMANDS = {
    "AC_ARG_WITH": (2, 3), "AC_ARG_ENABLE": (2, 3), "AC_CACHE_CHECK": (2,), "AC_CACHE_VAL": (1,), "AC_CHECK_HEADER": (1, 2), "AC_CHECK_HEADERS": (1, 2), "AC_CHECK_LIB": (2, 3), "AC_SEARCH_LIBS": (2, 3),
    "AC_CHECK_DECL": (1, 2), "AC_CHECK_DECLS": (1, 2), "AC_CHECK_FUNC": (1, 2), "AC_CHECK_FUNCS": (1, 2), "AC_CHECK_TYPE": (1, 2), "AC_CHECK_TYPES": (1, 2), "AC_COMPILE_IFELSE": (1, 2), "AC_LINK_IFELSE": (1, 2),
    "AC_TRY_COMPILE": (2, 3), "AC_TRY_LINK": (2, 3), "PKG_CHECK_MODULES": (2, 3), "AS_IF": (1, 2), "AC_RUN_IFELSE": (1, 2, 3),
}
CONDITIONS = {"AM_CONDITIONAL": 1, "AS_IF": 0}
WORDS = {"AC_SUBST": (1,), "AM_SUBST_NOTMAKE": (1,), "AC_DEFINE_UNQUOTED": (1,), "AS_TR_SH": (0,)}


class ScriptError(ValueError):
    def __init__(self, message: str, line: int):
        super().__init__(f"line {line}: {message}")
        self.line = line


@dataclass
class Node:
    """A command.  ``branches``: (condition or patterns, body) pairs; ``words``: its words; ``text``: a name."""

    kind: str
    line: int
    end: int = 0
    text: str = ""
    words: list = field(default_factory=list)
    branches: list = field(default_factory=list)
    args: list = field(default_factory=list)
    redirects: list = field(default_factory=list)


class Parser:
    """Recursive descent over characters.

    Fragments of a word: ("lit", text), ("dq", fragments), ("var", name),
    ("subst", operator, name, fragments), ("cmd", text), ("arith", text),
    ("glob", text), ("macro", name, args).
    """

    def __init__(self, text: str, line: int = 1):
        self.s, self.i, self.first = text, 0, line

    @property
    def line(self) -> int:
        return self.first + self.s.count("\n", 0, self.i)

    def fail(self, message: str):
        raise ScriptError(message, self.line)

    def at(self, text: str) -> bool:
        return self.s.startswith(text, self.i)

    def blanks(self, lines: bool = False) -> None:
        while self.i < len(self.s):
            c = self.s[self.i]
            if c in " \t\r" or lines and c in "\n;":
                if lines and self.at(";;"):
                    return
                self.i += 1
            elif self.at("\\\n"):
                self.i += 2
            elif c == "#" and (self.i == 0 or self.s[self.i - 1] in " \t\n;[") or lines and re.compile(r"dnl\b").match(self.s, self.i):
                self.i = (self.s.find("\n", self.i) + len(self.s) + 1) % (len(self.s) + 1) if self.s.find("\n", self.i) >= 0 else len(self.s)
            else:
                return

    def keyword(self, *words: str) -> str | None:
        for w in words:
            if self.at(w) and (self.i + len(w) == len(self.s) or self.s[self.i + len(w)] in " \t\n;&|()<>" or w in ";;)"):
                return w
        return None

    def expect(self, word: str) -> None:
        self.blanks(True)
        if not self.keyword(word):
            self.fail(f"{word} expected")
        self.i += len(word)

    def commands(self, *ends: str) -> list[Node]:
        out = []
        while True:
            self.blanks(True)
            if self.i >= len(self.s):
                if ends:
                    self.fail(f"{' or '.join(ends)} expected")
                return out
            if ends and self.keyword(*ends):
                return out
            out.append(self.and_or())
            self.blanks()
            if self.at("&") and not self.at("&&"):
                self.i += 1
                out[-1] = Node("Background", out[-1].line, self.line, branches=[(None, [out[-1]])])

    def and_or(self) -> Node:
        left = self.pipe()
        while True:
            self.blanks()
            op = "&&" if self.at("&&") else "||" if self.at("||") else None
            if not op:
                return left
            self.i += 2
            self.blanks(True)
            right = self.pipe()
            left = Node("And" if op == "&&" else "Or", left.line, right.end, branches=[(condition(left), [right])])

    def pipe(self) -> Node:
        line, bang = self.line, False
        if self.keyword("!"):
            self.i, bang = self.i + 1, True
            self.blanks()
        parts = [self.command()]
        while True:
            self.blanks()
            if not self.at("|") or self.at("||"):
                break
            self.i += 1
            self.blanks(True)
            parts.append(self.command())
        if len(parts) == 1 and not bang:
            return parts[0]
        return Node("Pipe", line, self.line, text="!" if bang else "", branches=[(None, parts)])

    def command(self) -> Node:
        line = self.line
        node = self._compound(line) or self._simple(line)
        node.end = node.end or self.line
        redirects = []
        while (m := re.compile(r"[ \t]*(\d*)(<<-?|<>|>>|>\||<&|>&|<|>)[ \t]*").match(self.s, self.i)) and m.end() > self.i:
            self.i = m.end()
            kind = {"<<": "Heredoc", "<<-": "Heredoc", "<>": "ReadWrite", ">>": "Append", ">|": "Clobber", "<&": "DupRead", ">&": "DupWrite", "<": "Read", ">": "Write"}[m[2]]
            redirects.append((kind, m[1], self._heredoc() if kind == "Heredoc" else self.word()))
        if node.redirects:
            redirects, node.redirects = node.redirects + redirects, []
        return Node("Redirect", line, self.line, branches=[(None, [node])], redirects=redirects) if redirects else node

    def _heredoc(self) -> list:
        m = re.compile(r"\\?(['\"]?)([A-Za-z0-9_]+)\1").match(self.s, self.i)
        if not m:
            self.fail("here-document without a mark")
        stop = re.compile(rf"\n[\t]*{re.escape(m[2])}(?=\n|$)").search(self.s, m.end())
        eol = self.s.find("\n", m.end())
        if not stop or eol < 0:
            self.fail("open here-document")
        body = self.s[eol + 1 : max(eol + 1, stop.start() + 1)]
        # the rest of the line stays to be read, the body goes
        self.s = self.s[: m.end()] + self.s[m.end() : eol] + self.s[stop.end() :]
        self.i = m.end()
        return [("lit", body)]

    def _compound(self, line: int) -> Node | None:
        word = self.keyword("if", "for", "case", "while", "until", "{", "(") or ("(" if self.at("(") else None)
        if not word:
            return None
        self.i += len(word)
        node = Node({"{": "Brace", "(": "Subshell"}.get(word, word.capitalize()), line)
        if word == "if":
            while True:
                test = self.commands("then")
                self.expect("then")
                node.branches.append((conditions(test), self.commands("elif", "else", "fi")))
                if self.keyword("elif"):
                    self.i += 4
                    continue
                if self.keyword("else"):
                    self.i += 4
                    node.branches.append((None, self.commands("fi")))
                self.expect("fi")
                return node
        if word == "for":
            self.blanks()
            node.text = self._match(NAME, "a name after for")
            self.blanks(True)
            if self.keyword("in"):
                self.i += 2
                self.blanks()
                while self.i < len(self.s) and self.s[self.i] not in "\n;":
                    node.words.append(self.word())
                    self.blanks()
            self.expect("do")
            node.branches.append((None, self.commands("done")))
            self.expect("done")
        elif word == "case":
            self.blanks()
            node.words.append(self.word())
            self.expect("in")
            while True:
                self.blanks(True)
                while self.at(";;"):
                    self.i += 2
                    self.blanks(True)
                if self.keyword("esac"):
                    break
                if self.at("("):
                    self.i += 1
                patterns = []
                while True:
                    self.blanks()
                    patterns.append(self.word(stop="|)"))
                    self.blanks()
                    if self.i >= len(self.s) or self.s[self.i] not in "|)":
                        self.fail("a case pattern without )")
                    self.i += 1
                    if self.s[self.i - 1] == ")":
                        break
                node.branches.append((patterns, self.commands(";;", "esac")))
            self.expect("esac")
        elif word in ("while", "until"):
            test = self.commands("do")
            self.expect("do")
            node.branches.append((conditions(test), self.commands("done")))
            self.expect("done")
        else:
            close = "}" if word == "{" else ")"
            node.branches.append((None, self.commands(close)))
            self.expect(close)
        return node

    def _match(self, pattern: re.Pattern, what: str) -> str:
        m = pattern.match(self.s, self.i)
        if not m:
            self.fail(what + " expected")
        self.i = m.end()
        return m[0]

    def _simple(self, line: int) -> Node:
        m = MACRO.match(self.s, self.i)
        if m and (m.end() == len(self.s) or self.s[m.end()] in "(\n ;\t"):
            self.i = m.end()
            return Node("Macro", line, text=m[0], args=self._arguments(m[0]))
        m = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)[ \t]*\(\)[ \t\n]*\{").match(self.s, self.i)
        if m:
            self.i = m.end()
            body = self.commands("}")
            self.expect("}")
            return Node("Function", line, text=m[1], branches=[(None, body)])
        m = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)=").match(self.s, self.i)
        if m:
            self.i = m.end()
            node = Node("Assignment", line, text=m[1], words=[self.word(empty=True)])
            return node
        node = Node("Command", line)
        while self.i < len(self.s):
            self.blanks()
            if self.i >= len(self.s) or self.s[self.i] in "\n;&|)" or re.compile(r"\d*[<>]").match(self.s, self.i):
                break
            if node.words and self.keyword("}"):
                break
            node.words.append(self.word())
        if not node.words and not re.compile(r"\d*[<>]").match(self.s, self.i):
            self.fail(f"a command expected before {self.s[self.i : self.i + 10]!r}")
        return node

    def _arguments(self, name: str) -> list:
        if not self.at("("):
            return []
        self.i += 1
        raw, depth, part, start = [], 0, "", self.line
        lines = [start]
        while True:
            if self.i >= len(self.s):
                self.fail(f"open arguments of {name}")
            c = self.s[self.i]
            self.i += 1
            if c in "[(":
                depth += 1
            elif c == ")" and depth == 0:
                raw.append(part)
                break
            elif c in "])":
                depth -= 1
            elif c == "," and depth == 0:
                raw.append(part)
                part = ""
                lines.append(self.line)
                continue
            part += c
        return [_argument(name, k, x, lines[k]) for k, x in enumerate(raw)]

    def word(self, stop: str = "", empty: bool = False) -> list:
        out: list = []
        while self.i < len(self.s):
            c = self.s[self.i]
            if c in " \t\n;&|<>()`"[:-1] + stop and not (c == "(" and out and out[-1][0] == "macro"):
                break
            if self.at("\\\n"):
                self.i += 2
                continue
            out.append(self._fragment(c, quoted=False))
        merged: list = []
        for f in out:
            if f[0] == "lit" and merged and merged[-1][0] == "lit":
                merged[-1] = ("lit", merged[-1][1] + f[1])
            else:
                merged.append(f)
        if not merged and not empty:
            self.fail("a word expected")
        return merged

    def _fragment(self, c: str, quoted: bool):
        if c == "'" and not quoted:
            end = self.s.find("'", self.i + 1)
            if end < 0:
                self.fail("open quote")
            text, self.i = self.s[self.i + 1 : end], end + 1
            return ("lit", text)
        if c == '"' and not quoted:
            self.i += 1
            inner: list = []
            while True:
                if self.i >= len(self.s):
                    self.fail("open double quote")
                if self.s[self.i] == '"':
                    self.i += 1
                    return ("dq", _merge(inner))
                inner.append(self._fragment(self.s[self.i], quoted=True))
        if c == "\\" and self.i + 1 < len(self.s):
            self.i += 2
            n = self.s[self.i - 1]
            return ("lit", n if not quoted or n in '$`"\\' else "\\" + n)
        if c == "`":
            end = self.i + 1
            while end < len(self.s) and self.s[end] != "`":
                end += 2 if self.s[end] == "\\" else 1
            text, self.i = self.s[self.i + 1 : end], end + 1
            return ("cmd", text)
        if c == "$":
            return self._dollar()
        if c in "*?" and not quoted:
            self.i += 1
            return ("glob", c)
        if c == "[" and not quoted and (m := re.compile(r"\[[!^]?\]?[^\]\s]*\]").match(self.s, self.i)):
            self.i = m.end()
            return ("glob", m[0])
        m = MACRO.match(self.s, self.i) if not quoted and (self.i == 0 or not self.s[self.i - 1].isalnum()) else None
        if m and m.end() < len(self.s) and self.s[m.end()] == "(":
            self.i = m.end()
            return ("macro", m[0], self._arguments(m[0]))
        self.i += 1
        return ("lit", c)

    def _dollar(self):
        s = self.s
        if s.startswith("$((", self.i):
            end = s.find("))", self.i)
            if end < 0:
                self.fail("open arithmetic")
            text, self.i = s[self.i + 3 : end], end + 2
            return ("arith", text)
        if s.startswith("$(", self.i):
            depth, end = 1, self.i + 2
            while end < len(s) and depth:
                depth += {"(": 1, ")": -1}.get(s[end], 0)
                end += 1
            text, self.i = s[self.i + 2 : end - 1], end
            return ("cmd", text)
        if m := re.compile(r"\$\{#([A-Za-z_]\w*)\}").match(s, self.i):
            self.i = m.end()
            return ("subst", "Len", m[1], [])
        if m := re.compile(r"\$\{([A-Za-z_]\w*|[0-9@*#?$!-])\}|\$([A-Za-z_]\w*|[0-9@*#?$!-])").match(s, self.i):
            self.i = m.end()
            return ("var", m[1] or m[2])
        if m := re.compile(r"\$\{([A-Za-z_]\w*)(:?[-=?+]|%%?|##?)").match(s, self.i):
            self.i = m.end()
            inner: list = []
            while self.i < len(s) and s[self.i] != "}":
                inner.append(self._fragment(s[self.i], quoted=s[self.i] not in "'\""))
            if self.i >= len(s):
                self.fail("open substitution")
            self.i += 1
            kind = {"-": "Default", "=": "Assign", "?": "Error", "+": "Alternative", "%": "RemoveSmallestSuffix", "%%": "RemoveLargestSuffix", "#": "RemoveSmallestPrefix", "##": "RemoveLargestPrefix"}[m[2].lstrip(":")]
            return ("subst", kind, m[1], _merge(inner))
        self.i += 1
        return ("lit", "$")


def _merge(fragments: list) -> list:
    out: list = []
    for f in fragments:
        if f[0] == "lit" and out and out[-1][0] == "lit":
            out[-1] = ("lit", out[-1][1] + f[1])
        else:
            out.append(f)
    return out


def _unquote(text: str) -> str:
    text = text.strip()
    while text.startswith("[") and text.endswith("]"):
        depth = 0
        for k, c in enumerate(text):
            depth += {"[": 1, "]": -1}.get(c, 0)
            if depth == 0 and k < len(text) - 1:
                return text
        text = text[1:-1].strip() if text.count("[") else text
    return text


def _argument(macro: str, place: int, raw: str, line: int):
    text = _unquote(raw)
    if place in COMMANDS.get(macro, ()):
        return ("Commands", Parser(text, line).commands())
    if CONDITIONS.get(macro) == place:
        return ("Condition", conditions(Parser(text, line).commands()))
    if place in WORDS.get(macro, ()):
        return ("Word", Parser(text, line).word(empty=True))
    return ("Literal", text)


UNARY = {"-z": "Empty", "-n": "NonEmpty", "-d": "Dir", "-f": "File", "-r": "File", "-x": "File", "-e": "File"}
BINARY = {"=": "Eq", "==": "Eq", "!=": "Neq", "-eq": "Eq", "-ne": "Neq", "-ge": "Ge", "-gt": "Gt", "-le": "Le", "-lt": "Lt"}


def conditions(commands: list[Node]):
    """The last command decides; those before it only run."""
    if not commands:
        return ("Const", True)
    last = condition(commands[-1])
    return ("After", commands[:-1], last) if len(commands) > 1 else last


def condition(node: Node):
    """A condition as a nested tuple: comparison, Not, And, Or, Const, or ("Cmd", node)."""
    if node.kind in ("And", "Or"):
        return (node.kind, node.branches[0][0], condition(node.branches[0][1][0]))
    if node.kind == "Pipe" and node.text == "!" and len(node.branches[0][1]) == 1:
        return ("Not", condition(node.branches[0][1][0]))
    if node.kind in ("Brace", "Subshell") and len(node.branches[0][1]) == 1:
        return condition(node.branches[0][1][0])
    if node.kind != "Command":
        return ("Cmd", node)
    words = node.words
    first = literal(words[0])
    if first in ("true", ":") and len(words) == 1:
        return ("Const", True)
    if first == "false" and len(words) == 1:
        return ("Const", False)
    if first == "test":
        return _test(words[1:]) or ("Cmd", node)
    if words[0] and words[0][0] == ("lit", "[") and literal(words[-1]) == "]":
        return _test(words[1:-1]) or ("Cmd", node)
    return ("Cmd", node)


def _test(words: list):
    names = [literal(w) for w in words]
    for op, kind in (("-o", "Or"), ("-a", "And")):
        if op in names[1:-1]:
            k = names.index(op, 1)
            left, right = _test(words[:k]), _test(words[k + 1 :])
            return left and right and (kind, left, right)
    if names and names[0] == "!":
        inner = _test(words[1:])
        return inner and ("Not", inner)
    if len(words) == 3 and names[1] in BINARY:
        return (BINARY[names[1]], words[0], words[2])
    if len(words) == 2 and names[0] in UNARY:
        return (UNARY[names[0]], words[1])
    if len(words) == 1:
        return ("NonEmpty", words[0])
    return None


def literal(word: list) -> str | None:
    """The text of a word that is literal throughout, quoted or not; None for another."""
    out = ""
    for f in word:
        if f[0] == "lit":
            out += f[1]
        elif f[0] == "dq" and (inner := literal(f[1])) is not None:
            out += inner
        else:
            return None
    return out


def parse(text: str) -> list[Node]:
    return Parser(text.replace("\r\n", "\n")).commands()
