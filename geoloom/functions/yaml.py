"""YAML documents as JSON, for catalogs: mappings and lists by indentation, plain, quoted, block and folded scalars, flow values and comments.

Anchors, aliases, tags, complex keys, tabs as indentation and more than one document are errors, which are told and don't stop a scan. Scalars are read by the rules of version 1.1: yes, no, on and
off are booleans too. Dates stay texts, as do numbers that JSON doesn't have.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Levels of nesting at most.
DEEPEST = 200
_RESULT = T.StructType().add("json", "string").add("error", "string")

_NULL = frozenset(("", "~", "null", "Null", "NULL"))
_BOOLS = {w: v for v, ws in ((True, ("yes", "true", "on")), (False, ("no", "false", "off"))) for x in ws for w in (x, x.title(), x.upper())}
_INT = re.compile(r"[-+]?(?:0b[01_]+|0x[0-9a-fA-F_]+|0[0-7_]*|[1-9][0-9_]*)$")
_FLOAT = re.compile(r"[-+]?(?:[0-9][0-9_]*\.[0-9_]*(?:[eE][-+][0-9]+)?|\.[0-9][0-9_]*(?:[eE][-+][0-9]+)?)$")
_KEY = re.compile(r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\[\]{},"'#&*!|>%@`?:-][^#]*?|[?:-][^\s#][^#]*?|[^\s\[\]{},"'&*!|>%@`][^\n]*?)\s*:(?=\s|$)""")
_BLOCK = re.compile(r"([|>])([-+]?)([1-9]?)([-+]?)[ \t]*(?:#.*)?$")
_ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "\t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}
_WIDE = {"x": 2, "u": 4, "U": 8}


def plain(text: str):
    """A plain scalar's value."""
    if text in _NULL:
        return None
    if text in _BOOLS:
        return _BOOLS[text]
    digits = text.replace("_", "")
    if _INT.match(text):
        sign, body = (-1, digits[1:]) if digits[0] == "-" else (1, digits.lstrip("+"))
        base = {"0b": 2, "0x": 16}.get(body[:2], 8 if body[0] == "0" and len(body) > 1 else 10)
        return sign * int(body[2:] if base in (2, 16) else body, base)
    return float(digits) if _FLOAT.match(text) else text


class _Reader:
    def __init__(self, text: str) -> None:
        lines = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n").split("\n")
        at = 0
        while at < len(lines) and (not lines[at].strip() or lines[at].lstrip().startswith("#") or lines[at].startswith("%")):
            at += 1
        if at < len(lines) and re.match(r"---(\s|$)", lines[at]):
            lines[at] = "   " + lines[at][3:]
        for end in range(at, len(lines)):
            if re.match(r"(---|\.\.\.)(\s|$)", lines[end]):
                if any(x.strip() and not x.lstrip().startswith("#") for x in lines[end + 1 :]) or lines[end].startswith("---"):
                    raise ValueError("more than one document")
                lines = lines[:end]
                break
        self.lines, self.at = lines, 0

    def skip(self) -> int:
        """The indentation of the next line with content; -1 at the end."""
        while self.at < len(self.lines):
            line = self.lines[self.at]
            inner = line.lstrip(" ")
            if inner.startswith("\t") and inner.strip():
                raise ValueError(f"line {self.at + 1}: a tab as indentation")
            if inner.strip() and not inner.startswith("#"):
                return len(line) - len(inner)
            self.at += 1
        return -1

    def node(self, least: int, depth: int):
        """The value that begins at the next line, at least so far in; None where nothing does."""
        if depth > DEEPEST:
            raise ValueError("nested too deeply")
        indent = self.skip()
        if indent < least:
            return None
        rest = self.lines[self.at][indent:]
        if rest == "-" or rest.startswith("- "):
            return self.sequence(indent, depth)
        if _KEY.match(rest):
            return self.mapping(indent, depth)
        return self.scalar(indent, least, depth)

    def sequence(self, indent: int, depth: int) -> list:
        out = []
        while self.skip() == indent and (self.lines[self.at][indent:] == "-" or self.lines[self.at].startswith("- ", indent)):
            rest = self.lines[self.at][indent + 1 :]
            inner = rest.lstrip(" ")
            if not inner or inner.startswith("#"):
                self.at += 1
                out.append(self.node(indent + 1, depth + 1))
            else:
                # The item stands as if its dash were a space.
                self.lines[self.at] = " " * (indent + 1) + rest
                block = _BLOCK.match(inner)
                out.append(self.block(block, indent) if block else self.node(indent + 1, depth + 1))
        return out

    def mapping(self, indent: int, depth: int) -> dict:
        out = {}
        while self.skip() == indent:
            line = self.lines[self.at]
            found = _KEY.match(line, indent)
            if not found:
                raise ValueError(f"line {self.at + 1}: no key")
            key = self.key(found[0].rstrip()[:-1].rstrip())
            rest = line[found.end() :].strip()
            if not rest or rest.startswith("#"):
                self.at += 1
                below = self.skip()
                # A list may stand as far in as its key.
                dash = below == indent and (self.lines[self.at][indent:] == "-" or self.lines[self.at].startswith("- ", indent))
                out[key] = self.sequence(indent, depth + 1) if dash else self.node(indent + 1, depth + 1)
            elif block := _BLOCK.match(rest):
                out[key] = self.block(block, indent)
            else:
                out[key] = self.scalar(len(line) - len(line[found.end() :].lstrip()), indent + 1, depth)
        if self.skip() > indent:
            raise ValueError(f"line {self.at + 1}: too far in")
        return out

    def key(self, text: str) -> str:
        if text.startswith(("&", "*", "!", "? ")):
            raise ValueError(f"line {self.at + 1}: anchors, aliases, tags and complex keys aren't read")
        made = _Flow(text).quoted() if text[:1] in "\"'" and text else plain(text)
        return made if isinstance(made, str) else json.dumps(made)

    def block(self, found: re.Match, indent: int) -> str:
        """A block scalar below a line at an indentation: its lines as they are (|) or folded (>)."""
        chomp, fixed = found[2] or found[4], found[3]
        self.at += 1
        body = []
        inner = indent + int(fixed) if fixed else None
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if line.strip(" "):
                own = len(line) - len(line.lstrip(" "))
                if inner is None:
                    inner = own
                if own < inner or own <= indent:
                    break
            body.append(line[inner:] if inner is not None and line.strip(" ") else line[inner:] if inner is not None and len(line) > inner else "")
            self.at += 1
        tail = 0
        while body and not body[-1]:
            body.pop()
            tail += 1
        if found[1] == "|":
            text = "\n".join(body)
        else:
            text, before = "", None
            for line in body:
                more = line[:1] in (" ", "\t")
                if before is None:
                    text = line
                elif not line:
                    text += "\n"
                elif not before[0]:
                    text += ("\n" if more or before[1] else "") + line
                elif more or before[1]:
                    text += "\n" + line
                else:
                    text += " " + line
                before = (line, more if line else (before[1] if before else False))
        if chomp == "-" or (not body and chomp != "+"):
            return text
        return text + ("\n" if body else "") + ("\n" * tail if chomp == "+" else "")

    def scalar(self, start: int, least: int, depth: int):
        """A flow value, or a quoted or plain scalar, from a place in the line on; lines that go on are at least so far in."""
        first = self.lines[self.at][start:]
        if first[0] in "&*!@`%" or re.match(r"\?(\s|$)", first):
            raise ValueError(f"line {self.at + 1}: anchors, aliases and tags aren't read")
        if first[0] in "[{\"'":
            parts = [first]
            while True:
                flow = _Flow("\n".join(parts))
                try:
                    made = flow.value(depth)
                    break
                except EOFError:
                    self.at += 1
                    if self.skip_blank() < least:
                        raise ValueError(f"line {self.at}: a value has no end") from None
                    # What was read so far is read again only where a value goes over several lines; lines are taken in doubling groups.
                    more = min(len(parts), len(self.lines) - self.at)
                    parts += self.lines[self.at : self.at + more]
                    self.at += more - 1
            used = flow.text[: flow.at].count("\n")
            self.at -= len(parts) - 1 - used
            rest = flow.text[flow.at :].split("\n", 1)[0]
            if rest.strip() and not re.match(r"\s+#|\s*$", rest):
                raise ValueError(f"line {self.at + 1}: text after a value")
            self.at += 1
            return made
        text = _uncommented(first)
        if re.search(r":(\s|$)", text):
            raise ValueError(f"line {self.at + 1}: a key inside a scalar")
        self.at += 1
        whole, empty = text, 0
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if not line.strip():
                empty += 1
                self.at += 1
                continue
            own = len(line) - len(line.lstrip(" "))
            if own < least or line.lstrip().startswith("#") or len(text) != len(first.rstrip()):
                break
            if _KEY.match(line.lstrip()):
                raise ValueError(f"line {self.at + 1}: a key inside a scalar")
            first = line.strip()
            text = _uncommented(first)
            whole += ("\n" * empty if empty else " ") + text
            empty = 0
            self.at += 1
        return plain(whole)

    def skip_blank(self) -> int:
        """The indentation of the next line that isn't empty; comments count, as they may lie inside a flow value."""
        for k in range(self.at, len(self.lines)):
            if self.lines[k].strip():
                return len(self.lines[k]) - len(self.lines[k].lstrip(" ")) if self.lines[k].lstrip()[0] not in "]}" else 1 << 30
        return -1


def _uncommented(text: str) -> str:
    return re.sub(r"(^|\s)#.*$", "", text).rstrip()


class _Flow:
    """Flow values and quoted scalars in a text; EOFError says that it ends too soon."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def space(self) -> str:
        """Goes over spaces and comments; the next character."""
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "#" and (self.at == 0 or self.text[self.at - 1].isspace()):
                end = self.text.find("\n", self.at)
                self.at = len(self.text) if end < 0 else end
            elif c.isspace():
                self.at += 1
            else:
                return c
        raise EOFError

    def value(self, depth: int):
        if depth > DEEPEST:
            raise ValueError("nested too deeply")
        c = self.space()
        if c == "[":
            return self.items("]", depth)
        if c == "{":
            return self.items("}", depth)
        return self.quoted() if c in "\"'" else self.bare()

    def items(self, close: str, depth: int):
        out: list | dict = [] if close == "]" else {}
        self.at += 1
        while self.space() != close:
            key = self.value(depth + 1)
            pair = self.space() == ":"
            if pair:
                self.at += 1
                value = None if self.space() in f",{close}" else self.value(depth + 1)
            if close == "]":
                out.append({self.name(key): value} if pair else key)
            else:
                out[self.name(key)] = value if pair else None
            if self.space() == ",":
                self.at += 1
            elif self.space() != close:
                raise ValueError("a flow value without a comma")
        self.at += 1
        return out

    @staticmethod
    def name(key) -> str:
        if isinstance(key, (dict, list)):
            raise ValueError("complex keys aren't read")
        return key if isinstance(key, str) else json.dumps(key)

    def bare(self):
        start = self.at
        if self.text[start] in "&*!@`%|>":
            raise ValueError("anchors, aliases and tags aren't read")
        while self.at < len(self.text):
            c = self.text[self.at]
            after = self.text[self.at + 1 : self.at + 2]
            if c in ",[]{}\n" or (c == ":" and (not after or after in ", []{}\n\t")) or (c == "#" and self.text[self.at - 1].isspace()):
                break
            self.at += 1
        found = self.text[start : self.at].strip()
        if not found:
            raise ValueError("an empty flow value")
        return plain(found)

    def quoted(self) -> str:
        quote, out = self.text[self.at], []
        self.at += 1
        while True:
            if self.at >= len(self.text):
                raise EOFError
            c = self.text[self.at]
            self.at += 1
            if c == quote:
                if quote == "'" and self.text[self.at : self.at + 1] == "'":
                    out.append("'")
                    self.at += 1
                    continue
                return "".join(out)
            if c == "\\" and quote == '"':
                e = self.text[self.at : self.at + 1]
                self.at += 1
                if e == "\n":
                    while self.text[self.at : self.at + 1] in (" ", "\t"):
                        self.at += 1
                elif e in _WIDE:
                    out.append(chr(int(self.text[self.at : self.at + _WIDE[e]], 16)))
                    self.at += _WIDE[e]
                elif e in _ESCAPES:
                    out.append(_ESCAPES[e])
                elif not e:
                    raise EOFError
                else:
                    raise ValueError(f"no escape: {e}")
            elif c == "\n":
                while out and out[-1] in (" ", "\t"):
                    out.pop()
                empty = 0
                while self.at < len(self.text) and self.text[self.at].isspace():
                    empty += self.text[self.at] == "\n"
                    self.at += 1
                out.append("\n" * empty if empty else " ")
            else:
                out.append(c)




def parsed(text: str | None) -> tuple[str | None, str | None]:
    """(JSON, error) of a document; both null for a null text, and JSON null for an empty one."""
    if text is None:
        return None, None
    try:
        reader = _Reader(text)
        made = reader.node(0, 0)
        if reader.skip() >= 0:
            raise ValueError(f"line {reader.at + 1}: text after the document")
        return json.dumps(made, ensure_ascii=False), None
    except (ValueError, EOFError, IndexError, RecursionError) as e:
        return None, str(e) or "the document has no end"


@F.pandas_udf(_RESULT)
def yaml_json(text: pd.Series) -> pd.DataFrame:
    """struct(json, error) of YAML documents, each whole."""
    return pd.DataFrame([parsed(x) for x in text], columns=["json", "error"], dtype=object)


def document(text: Column) -> Column:
    """struct(value VARIANT, error) of a YAML document."""
    found = yaml_json(text)
    return F.transform(F.array(found), lambda f: F.struct(F.try_parse_json(f["json"]).alias("value"), f["error"].alias("error")))[0]


def quoted(value: Column) -> Column:
    """A text as a YAML scalar: as it is where that reads as the same text, else in double quotes."""
    safe = value.rlike(r"^[A-Za-z][A-Za-z0-9_ .]*$") & ~value.rlike(r" $") & ~F.lower(value).isin("null", "yes", "no", "on", "off", "true", "false")
    escaped = F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", 1)
    return F.when(value.isNull(), F.lit("null")).when(safe, value).otherwise(escaped)


def field(document: Column, path: str) -> Column:
    """The text of a scalar in a VARIANT, or null; numbers and booleans as they are written in JSON."""
    return F.nullif(F.try_variant_get(document, path, "string"), F.lit(""))
