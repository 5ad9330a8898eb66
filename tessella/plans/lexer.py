"""Tokens of the three dialects."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tessella.errors import InvalidArgument, InvalidQuery, LimitExceeded, Unsupported

DIALECTS = ("sqlite", "postgres", "mysql")
MAX_SOURCE_BYTES = 65_536

_SPACE = re.compile(r"(?:[ \t\r\n\f]+|--[^\n]*)+")
_NUMBER = re.compile(r"(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?")
_WORD = re.compile(r"[A-Za-z_\u0080-\U0010ffff][A-Za-z0-9_$\u0080-\U0010ffff]*")
_SYMBOL = re.compile(r"\|\||<=>|->>|->|::|<>|!=|<=|>=|==|<<|>>|!~\*?|~\*|[-+*/%=<>(),.;&|~^#@!\[\]{}:]")


@dataclass(frozen=True)
class Token:
    #: word, ident (quoted), string, number, param, symbol or end
    kind: str
    text: str
    at: int
    stop: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


def _quoted(source: str, at: int, close: str, backslash: bool = False) -> tuple[str, int]:
    out, k = [], at + 1
    while k < len(source):
        c = source[k]
        if backslash and c == "\\" and k + 1 < len(source):
            nxt = source[k + 1]
            out.append({"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "Z": "\x1a"}.get(nxt, ("\\" + nxt) if nxt in "%_" else nxt))
            k += 2
        elif c == close:
            if source[k + 1 : k + 2] == close:
                out.append(close)
                k += 2
            else:
                return "".join(out), k + 1
        else:
            out.append(c)
            k += 1
    raise InvalidQuery("a quoted text or name does not end")


def tokens(source: str, dialect: str) -> list[Token]:
    if dialect not in DIALECTS:
        raise InvalidArgument("the dialect must be sqlite, postgres or mysql")
    if len(source.encode("utf-8", "surrogatepass")) > MAX_SOURCE_BYTES:
        raise LimitExceeded(f"a statement text may have {MAX_SOURCE_BYTES} bytes")
    out, at = [], 0
    while at < len(source):
        if m := _SPACE.match(source, at):
            at = m.end()
            continue
        if dialect == "mysql" and source[at] == "#":
            at = (source + "\n").index("\n", at)
            continue
        if source.startswith("/*", at):
            stop = source.find("*/", at + 2)
            if stop < 0:
                raise InvalidQuery("a comment does not end")
            at = stop + 2
            continue
        c = source[at]
        if c == "'" or c == '"' and dialect == "mysql":
            text, stop = _quoted(source, at, c, dialect == "mysql")
            out.append(Token("string", text, at, stop))
        elif c == '"' or c == "`" and dialect != "postgres" or c == "[" and dialect == "sqlite":
            text, stop = _quoted(source, at, "]" if c == "[" else c)
            if not text:
                raise InvalidQuery("a name is empty")
            out.append(Token("ident", text, at, stop))
        elif dialect == "postgres" and (m := re.compile(r"\$(\d+)").match(source, at)):
            stop = m.end()
            out.append(Token("param", m[1], at, stop))
        elif c == "?" and dialect != "postgres":
            m = re.compile(r"\?(\d*)").match(source, at)
            stop = m.end()
            if m[1] and dialect == "mysql":
                raise InvalidQuery("a numbered placeholder is not of this dialect")
            out.append(Token("param", m[1], at, stop))
        elif c in ":@$" and re.compile(r"[:@$][A-Za-z_]").match(source, at) and dialect == "sqlite":
            raise Unsupported("named placeholders are not supported")
        elif m := _NUMBER.match(source, at):
            stop = m.end()
            if _WORD.match(source, stop):
                if source[at : at + 2].lower() == "0x":
                    raise Unsupported("hexadecimal literals are not supported")
                raise InvalidQuery("a number runs into a word")
            out.append(Token("number", m[0], at, stop))
        elif m := _WORD.match(source, at):
            stop = m.end()
            if m[0].lower() in ("x", "b", "n", "e") and source[stop : stop + 1] == "'":
                raise Unsupported("prefixed literals are not supported")
            out.append(Token("word", m[0], at, stop))
        elif m := _SYMBOL.match(source, at):
            stop = m.end()
            out.append(Token("symbol", m[0], at, stop))
        else:
            raise InvalidQuery("a character is not part of the language")
        at = out[-1].stop
    out.append(Token("end", "", len(source), len(source)))
    return out
