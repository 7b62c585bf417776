"""Regular expressions as dashboards store them, in the form that Spark's engine takes."""

from __future__ import annotations

import re
from typing import NamedTuple

#: Escapes that mean the same in both forms; others before a letter stand for the letter.
KEPT = set("dDwWbBnrtfxu123456789S")
SPACES = r"\s\u00a0\ufeff\u2028\u2029\p{Zs}"


class Pattern(NamedTuple):
    """`text` for Spark, how many groups capture, and whether all matches are asked for."""

    text: str
    groups: int
    every: bool


class BadPattern(ValueError):
    """A text that is no regular expression."""


def stored_pattern(stored: str) -> Pattern:
    """A pattern of the form `/body/flags`, or a bare body.

    Groups are counted as the body is read, so that brackets in sets and escaped ones don't count; named groups become
    numbered ones. Flags: i, m, s, g (all matches), y (from the start on); u, v and d change nothing here.
    """
    delimited = re.fullmatch(r"/(.*)/([a-z]*)", stored)
    body, flags = delimited.groups() if delimited else (stored, "")
    if set(flags) - set("imsgyuvd") or len(set(flags)) < len(flags):
        raise BadPattern(f"flags of {stored!r}")
    names = {name: 0 for name in re.findall(r"\(\?<([A-Za-z_$][\w$]*)>", body)}
    out: list[str] = []
    groups = depth = at = 0
    in_set = False
    bare = True  # nothing before that can be repeated
    while at < len(body):
        c, rest = body[at], body[at:]
        step = 1
        if c == "\\":
            if len(rest) < 2:
                raise BadPattern(f"{stored!r} ends in a backslash")
            step, d = 2, rest[1]
            named = re.match(r"\\k<([A-Za-z_$][\w$]*)>", rest)
            if named and named[1] in names:
                step = len(named[0])
                out.append(f"\\{names[named[1]] or groups + 1}")
            elif d == "s":
                out.append(SPACES if in_set else f"[{SPACES}]")
            elif d in "v0":
                out.append(r"\x0B" if d == "v" else r"\x00")
            else:
                out.append(d if d.isalnum() and d not in KEPT else rest[:2])
            bare = False
        elif in_set:
            in_set = c != "]"
            out.append("\\" + c if c in "[&" else c)
        elif c == "[":
            if rest.startswith(("[^]", "[]")):
                step = 3 if rest[1] == "^" else 2
                out.append(r"[\s\S]" if step == 3 else "(?!)")
            else:
                in_set, step = True, 2 if rest.startswith("[^") else 1
                out.append(rest[:step])
            bare = False
        elif c == "(":
            depth += 1
            named = re.match(r"\(\?<([A-Za-z_$][\w$]*)>", rest)
            plain = re.match(r"\(\?(?::|<?[=!])", rest)
            if not (named or plain) and rest.startswith("(?"):
                raise BadPattern(f"a group of {stored!r}")
            if not plain:
                groups += 1
                out.append("(")
                if named:
                    names[named[1]] = groups
            else:
                out.append(plain[0])
            step = len((named or plain or "(")[0])
            bare = True
        elif c in "*+?" or re.match(r"\{\d+(,\d*)?\}", rest):
            repeat = re.match(r"(?:[*+?]|\{\d+(?:,\d*)?\})\??", rest)[0]
            if bare:
                raise BadPattern(f"nothing to repeat in {stored!r}")
            step = len(repeat)
            out.append(repeat)
            bare = True  # a second sign in a row would mean something else to Spark
        else:
            depth -= c == ")"
            if depth < 0:
                raise BadPattern(f"brackets of {stored!r}")
            out.append(r"\z" if c == "$" and "m" not in flags else "\\{" if c == "{" else c)
            bare = c in "|^$"
        at += step
    if in_set or depth:
        raise BadPattern(f"brackets of {stored!r}")
    text = "".join(out)
    kinds = "".join(f for f in flags if f in "ms") + ("iu" if "i" in flags else "")
    text = f"\\A(?:{text})" if "y" in flags else text
    return Pattern(f"(?{kinds}){text}" if kinds else text, groups, "g" in flags)
