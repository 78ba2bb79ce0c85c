"""Routing by an ordered list of rules: the first that matches decides, else the default."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    match: str  # which subject: source or title
    pattern: str  # a glob; case does not count
    dest: str


def glob_regex(glob: str) -> str:
    """*, ?, [seq] and [!seq] as an anchored expression for Java."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2 + (glob[i + 1 : i + 2] == "!")) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inside = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += f"[{'^' + inside[1:] if inside[0] == '!' else '\\' + inside if inside[0] == '^' else inside}]"
            i = end
        else:
            out += re.escape(c) if c.isascii() else c
        i += 1
    return f"(?s)^{out}$"


def routed(rules: list[Rule], subjects: dict[str, Column], destinations: dict[str, str], default: str) -> Column:
    """The destination as one CASE expression: no join, rules in order. Rules on unknown subjects never match."""
    fallback = F.lit(destinations.get(default, ""))
    out = None
    for r in rules:
        if r.match in subjects:
            hit = F.lower(subjects[r.match]).rlike(glob_regex(r.pattern.lower()))
            dest = F.lit(destinations[r.dest]) if r.dest in destinations else fallback
            out = F.when(hit, dest) if out is None else out.when(hit, dest)
    return fallback if out is None else out.otherwise(fallback)


def source_name(path: Column, root: str) -> Column:
    """The child of the watched root that a path lies in."""
    return F.regexp_extract(path, "^" + re.escape(root.rstrip("/")) + r"/([^/]+)", 1)


def is_inside(child: Column, parent: Column) -> Column:
    return (child == parent) | child.startswith(F.concat(parent, F.lit("/")))


def overlap(a: Column, b: Column) -> Column:
    """Whether one path is the other, holds it or lies in it."""
    return is_inside(a, b) | is_inside(b, a)
