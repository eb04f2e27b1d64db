"""Table identities: qualified names, renaming, selection."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class TableId:
    namespace: str | None
    name: str

    def text(self) -> str:
        """Parts joined by a dot; dots and backslashes inside a part are escaped."""
        return ".".join(re.sub(r"([.\\])", r"\\\1", p) for p in (self.namespace, self.name) if p is not None)

    @staticmethod
    def parse(text: str) -> TableId:
        parts, now, it = [], "", iter(text)
        for ch in it:
            if ch == "\\":
                escaped = next(it, None)
                if escaped not in (".", "\\"):
                    raise ValueError(f"bad escape in {text!r}")
                now += escaped
            elif ch == ".":
                parts.append(now)
                now = ""
            else:
                now += ch
        parts.append(now)
        if len(parts) > 2 or not all(parts):
            raise ValueError(f"not a table identity: {text!r}")
        return TableId(parts[0] if len(parts) == 2 else None, parts[-1])


def expand(template: str, match: re.Match) -> str:
    """`$1`, `${name}` and `$$`; a group that is unknown or took no part is an error."""

    def one(m: re.Match) -> str:
        if m[0] == "$$":
            return "$"
        key = m[1] or m[2]
        if key is None:
            raise ValueError(f"stray $ in {template!r}")
        try:
            value = match[int(key) if key.isdigit() else key]
        except (IndexError, KeyError):
            raise ValueError(f"unknown capture {key}") from None
        if value is None:
            raise ValueError(f"capture {key} took no part")
        return value

    return re.sub(r"\$\$|\$\{(\w+)\}|\$(\w+)|\$", one, template)


def rename(table: TableId, pattern: str, replacement: str) -> TableId:
    """Replaces all matches in the qualified text; without a match the identity stays."""
    pattern = re.sub(r"\(\?<(?![=!])", "(?P<", pattern)
    out = re.sub(pattern, lambda m: expand(replacement, m), table.text())
    return table if out == table.text() else TableId.parse(out)


def glob(pattern: str) -> re.Pattern:
    """`*` and `?`, with backslash escapes; matches the whole text."""
    out, it = "", iter(pattern)
    for ch in it:
        out += ".*" if ch == "*" else "." if ch == "?" else re.escape(next(it, "\\") if ch == "\\" else ch)
    return re.compile(out, re.S)


@dataclass(frozen=True)
class Card:
    """One selection rule: included texts but for the excluded ones."""

    include: str
    exclude: str | None = None
    regex: bool = False

    def selected(self, tables: list[TableId]) -> set[TableId]:
        make = re.compile if self.regex else glob
        yes, no = make(self.include), make(self.exclude) if self.exclude is not None else None
        return {t for t in tables if yes.fullmatch(t.text()) and not (no and no.fullmatch(t.text()))}


def select_tables(catalogue: list[TableId], cards: list[Card]) -> list[TableId]:
    """What the cards select; an empty card, a table in two cards and a repeated catalogue entry are errors."""
    if len(set(catalogue)) != len(catalogue):
        raise ValueError("the catalogue lists a table twice")
    taken: set[TableId] = set()
    for card in cards:
        own = card.selected(catalogue)
        for other in cards:
            make = re.compile if other.regex else glob
            if other is not card and other.exclude is not None and (lost := {t for t in own if make(other.exclude).fullmatch(t.text())}):
                raise ValueError(f"{card} selects what {other} excludes: {sorted(t.text() for t in lost)}")
        if not own:
            raise ValueError(f"{card} selects nothing")
        if own & taken:
            raise ValueError(f"{card} selects what another rule selects: {sorted(t.text() for t in own & taken)}")
        taken |= own
    return [t for t in catalogue if t in taken]


def union_renamed(frames: list[DataFrame], primary_key: bool = False) -> DataFrame:
    """Tables renamed to one name are one table, if their schemas are equal and have no primary key."""
    if primary_key and len(frames) > 1:
        raise ValueError("tables with a primary key cannot be merged")
    first = frames[0]
    for f in frames[1:]:
        if [(x.name, x.dataType) for x in f.schema.fields] != [(x.name, x.dataType) for x in first.schema.fields]:
            raise ValueError("merged tables differ in their schemas")
        first = first.unionByName(f)
    return first
