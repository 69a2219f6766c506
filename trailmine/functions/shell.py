"""Command lines as normalized commands.

A recursive-descent reader of the shell grammar as far as commands can be told
apart by it: lists, pipelines, groups, if, while, until, for and time are
followed; case, functions, tests, declarations and arithmetic hold no command.
"""

from __future__ import annotations

import re

#: Tools whose first argument tells what they do, fixed values.
SUBCOMMAND_TOOLS = frozenset("git go npm pnpm yarn cargo docker gh kubectl make bd snipe trixi mage brew pip uv bun loto".split())
#: Commands that say nothing on their own, fixed values.
TRIVIAL = frozenset("cd echo true false pwd export set source . printf sleep exit".split())
DECLARATIONS = frozenset("declare typeset local export readonly nameref let".split())
FALLBACK_BYTES = 160

_ASSIGNMENT = re.compile(r"[A-Za-z_]\w*(\[[^\]]*\])?\+?=")
_BREAKS = set(" \t\n;&|()<>")


class Unreadable(Exception):
    pass


class _Reader:
    """Reads one command line; each statement gives its segments."""

    def __init__(self, text: str):
        self.s, self.i, self.heredocs = text, 0, []

    # ---- characters

    def blanks(self) -> None:
        s = self.s
        while self.i < len(s):
            if s[self.i] in " \t\r":
                self.i += 1
            elif s.startswith("\\\n", self.i):
                self.i += 2
            elif s[self.i] == "#":
                while self.i < len(s) and s[self.i] != "\n":
                    self.i += 1
            else:
                return

    def newlines(self) -> None:
        self.blanks()
        while self.i < len(self.s) and self.s[self.i] in "\n;" and not self.s.startswith(";;", self.i):
            if self.s[self.i] == ";":
                return
            self.newline()
            self.blanks()

    def newline(self) -> None:
        """Past a line end and the here-documents that begin after it."""
        self.i += 1
        for mark, tabs in self.heredocs:
            while True:
                if self.i >= len(self.s):
                    raise Unreadable("here-document without end")
                end = self.s.find("\n", self.i)
                line = self.s[self.i : end if end >= 0 else len(self.s)]
                self.i = end + 1 if end >= 0 else len(self.s)
                if (line.lstrip("\t") if tabs else line) == mark:
                    break
        self.heredocs = []

    def until(self, mark: str) -> None:
        """Past a closing mark, over quotes and nested brackets."""
        while self.i < len(self.s):
            c = self.s[self.i]
            if self.s.startswith(mark, self.i):
                self.i += len(mark)
                return
            if not self.quoted():
                if c == "(" and mark in (")", "))"):
                    self.i += 1
                    self.until(")")
                elif c == "{" and mark == "}":
                    self.i += 1
                    self.until("}")
                else:
                    self.i += 1
        raise Unreadable(f"no {mark}")

    def quoted(self) -> bool:
        """Past a quoted or expanded part, if one begins here."""
        s, c = self.s, self.s[self.i]
        if c == "\\":
            self.i += 2
        elif c == "'":
            end = s.find("'", self.i + 1)
            if end < 0:
                raise Unreadable("open quote")
            self.i = end + 1
        elif c == '"':
            self.i += 1
            while self.i < len(s) and s[self.i] != '"':
                if s[self.i] == "\\":
                    self.i += 2
                elif s[self.i] == "`" or s.startswith(("$(", "${"), self.i):
                    self.quoted()
                else:
                    self.i += 1
            if self.i >= len(s):
                raise Unreadable("open quote")
            self.i += 1
        elif c == "`":
            self.i += 1
            while self.i < len(s) and s[self.i] != "`":
                self.i += 2 if s[self.i] == "\\" else 1
            if self.i >= len(s):
                raise Unreadable("open quote")
            self.i += 1
        elif s.startswith("$((", self.i):
            self.i += 3
            self.until("))")
        elif s.startswith("$(", self.i):
            self.i += 2
            self.until(")")
        elif s.startswith("${", self.i):
            self.i += 2
            self.until("}")
        elif s.startswith(("$'", '$"'), self.i):
            self.i += 1
            self.quoted()
        else:
            return False
        return True

    # ---- words

    def word(self) -> str | None:
        """The next word: its text if it is plain, '' if not; None if there is none."""
        self.blanks()
        s, start, plain = self.s, self.i, True
        while self.i < len(s):
            c = s[self.i]
            if c in "<>" and s.startswith(("<(", ">("), self.i):
                self.i += 2
                self.until(")")
                plain = False
            elif c in _BREAKS:
                break
            elif c == "\\":
                self.i += 2
            elif c == "$" and not (self.i + 1 < len(s) and (s[self.i + 1].isalnum() or s[self.i + 1] in "_({'\"@*#?$!-")):
                self.i += 1
            elif c == "$" or c in "'\"`":
                plain = False
                if not self.quoted():
                    self.i += 1
                    while self.i < len(s) and (s[self.i].isalnum() or s[self.i] == "_" or (s[self.i] in "@*#?$!-" and s[self.i - 1] == "$")):
                        self.i += 1
            else:
                self.i += 1
        if self.i > len(s):
            self.i = len(s)
        if self.i == start:
            return None
        return s[start : self.i] if plain else ""

    def peek(self) -> str | None:
        at = self.i
        try:
            return self.word()
        finally:
            self.i = at

    def keyword(self, *words: str) -> str:
        self.newlines()
        w = self.word()
        if w not in words:
            raise Unreadable(f"{words} expected")
        return w

    def redirect(self) -> bool:
        self.blanks()
        m = re.compile(r"(\d+|\{\w+\})?(<<<|<<-|<<|<>|<&|>&|>>|>\||&>>|&>|<(?!\()|>(?!\())").match(self.s, self.i)
        if not m:
            return False
        self.i = m.end()
        self.blanks()
        start = self.i
        if self.word() is None:
            raise Unreadable("redirection to nothing")
        if m[2] in ("<<", "<<-"):
            self.heredocs.append((re.sub(r"['\"\\]", "", self.s[start : self.i]), m[2] == "<<-"))
        return True

    # ---- statements

    def statements(self, *ends: str) -> list[tuple[str, str]]:
        """Segments up to one of the closing words or marks, which is not read."""
        out: list[tuple[str, str]] = []
        while True:
            self.newlines()
            if self.i >= len(self.s):
                if ends:
                    raise Unreadable(f"{ends} expected")
                return out
            if self.s[self.i] == ")" and ")" in ends or self.s.startswith(";;", self.i) and ";;" in ends:
                return out
            if self.peek() in ends:
                return out
            out += self.chain()
            self.blanks()
            if self.i < len(self.s):
                c = self.s[self.i]
                if c == ";" and not self.s.startswith(";;", self.i):
                    self.i += 1
                elif c == "&" and not self.s.startswith("&&", self.i):
                    self.i += 1
                elif c == "\n":
                    self.newline()
                elif c == ")" and ")" in ends or self.s.startswith(";;", self.i) and ";;" in ends:
                    return out
                elif self.peek() not in ends:
                    raise Unreadable(f"unexpected {c!r}")

    def chain(self) -> list[tuple[str, str]]:
        out = self.pipeline()
        while True:
            self.blanks()
            if not self.s.startswith(("&&", "||"), self.i):
                return out
            self.i += 2
            self.newlines()
            out = out + self.pipeline()

    def pipeline(self) -> list[tuple[str, str]]:
        self.blanks()
        while self.peek() in ("!", "time"):
            if self.word() == "time":
                self.blanks()
                if self.s.startswith("-p", self.i):
                    self.i += 2
            self.blanks()
            if self.i >= len(self.s) or self.s[self.i] in ";\n&|)":
                return []
        out = self.command()
        while True:
            self.blanks()
            if self.s.startswith("||", self.i) or not self.s.startswith("|", self.i):
                return out
            self.i += 2 if self.s.startswith("|&", self.i) else 1
            self.newlines()
            right = self.command()
            out = out or right

    def command(self) -> list[tuple[str, str]]:
        self.blanks()
        s, start = self.s, self.i
        if start >= len(s):
            raise Unreadable("command expected")
        if s.startswith("((", start):
            self.i += 2
            self.until("))")
            return self.redirects([])
        if s[start] == "(":
            self.i += 1
            out = self.statements(")")
            self.i += 1
            return self.redirects(out)
        first = self.peek()
        if first == "{":
            self.word()
            out = self.statements("}")
            self.word()
            return self.redirects(out)
        if first == "if":
            self.word()
            out = self.statements("then")
            self.word()
            out += self.statements("elif", "else", "fi")
            while (w := self.keyword("elif", "else", "fi")) != "fi":
                if w == "elif":
                    self.statements("then")
                    self.word()
                self.statements("elif", "else", "fi")
            return self.redirects(out)
        if first in ("while", "until"):
            self.word()
            out = self.statements("do")
            self.word()
            out += self.statements("done")
            self.word()
            return self.redirects(out)
        if first in ("for", "select"):
            self.word()
            self.blanks()
            if s.startswith("((", self.i):
                self.i += 2
                self.until("))")
            else:
                if self.word() is None:
                    raise Unreadable("name expected")
                self.newlines()
                if self.peek() == "in":
                    self.word()
                    while self.word() is not None:
                        pass
            self.blanks()
            if s.startswith(";", self.i):
                self.i += 1
            self.keyword("do")
            out = self.statements("done")
            self.word()
            return self.redirects(out)
        if first == "case":
            self.word()
            if self.word() is None:
                raise Unreadable("word expected")
            self.keyword("in")
            while True:
                self.newlines()
                if self.peek() == "esac":
                    self.word()
                    return self.redirects([])
                if s.startswith("(", self.i):
                    self.i += 1
                while self.word() is not None:
                    self.blanks()
                    if s.startswith("|", self.i):
                        self.i += 1
                if not s.startswith(")", self.i):
                    raise Unreadable("pattern expected")
                self.i += 1
                self.statements(";;", "esac")
                m = re.compile(r";;&|;;|;&").match(s, self.i)
                if m:
                    self.i = m.end()
        if first == "[[":
            end = re.compile(r"\s\]\](?=\s|[;&|)]|\Z)").search(s, start)
            if not end:
                raise Unreadable("no ]]")
            self.i = end.end()
            return self.redirects([])
        if first in ("then", "do", "done", "fi", "elif", "else", "esac", "}", "in"):
            raise Unreadable(f"unexpected {first}")
        if first == "function":
            self.word()
            self.word()
            self.blanks()
            if s.startswith("(", self.i):
                self.i += 1
                self.until(")")
            self.newlines()
            self.command()
            return []
        return self.simple(start)

    def redirects(self, out: list[tuple[str, str]]) -> list[tuple[str, str]]:
        while self.redirect():
            pass
        return out

    def simple(self, start: int) -> list[tuple[str, str]]:
        s, args = self.s, []
        while True:
            if self.redirect():
                continue
            self.blanks()
            if not args and (m := _ASSIGNMENT.match(s, self.i)):
                self.i = m.end()
                if s.startswith("(", self.i):
                    self.i += 1
                    self.until(")")
                elif self.i < len(s) and s[self.i] not in " \t\n;&|":
                    self.word()
                continue
            w = self.word()
            if w is None:
                break
            args.append(w)
            if len(args) == 1:
                here = self.i
                self.blanks()
                if s.startswith("(", self.i) and re.compile(r"\(\s*\)").match(s, self.i):
                    self.i += 1
                    self.until(")")
                    self.newlines()
                    self.command()
                    return []
                self.i = here
        if self.i < len(s) and s[self.i] == "(" and args:
            raise Unreadable("unexpected (")
        if self.i == start:
            raise Unreadable(f"unexpected {s[start]!r}")
        if not args or args[0] in DECLARATIONS:
            return []
        raw = " ".join(s[start : self.i].split())
        if not args[0]:
            return [("complex", raw)]
        base = args[0].rpartition("/")[2]
        if base in TRIVIAL:
            return []
        if base in SUBCOMMAND_TOOLS and len(args) > 1 and args[1] and not args[1].startswith("-"):
            return [(f"{base}_{args[1]}", raw)]
        return [(base, raw)]


def split(command: str | None) -> tuple[list[tuple[str, str]], bool]:
    """(command, source) of each segment, and whether the line couldn't be read
    and only its first word was taken.

    A pipeline is its first command that is not trivial, an if its condition
    and its first branch. Null and blank lines have no segments.
    """
    command = command or ""
    reader = _Reader(command)
    try:
        return reader.statements(), False
    except (Unreadable, RecursionError):
        words = command.split()
        if not words:
            return [], True
        base = words[0].rpartition("/")[2]
        return ([] if base in TRIVIAL else [(base, command.encode()[:FALLBACK_BYTES].decode(errors="ignore"))]), True
