"""Names by templates: ``{field}``, ``{field:modifier}`` and ``[optional groups]``.

A template is read once, into one column expression that renders a row's name and one pattern that
reads a name back.  A field without a value takes the innermost group around it away; outside of
groups it leaves nothing.  Groups can be nested.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MODIFIERS: dict[str, Callable[[Column], Column]] = {
    "upper": F.upper,
    "lower": F.lower,
    "title": F.initcap,
    "first": lambda c: F.substring(c, 1, 1),
    "pad2": lambda c: F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c),
    "pad3": lambda c: F.when(F.length(c) < 3, F.lpad(c, 3, "0")).otherwise(c),
}
#: What a field's text can look like when a name is read back; other fields take anything.
SHAPES = {"year": r"\d{4}", "month": r"\d{1,2}", "day": r"\d{1,2}", "track": r"\d{1,3}", "disc": r"\d{1,2}", "set": r"\d{1,2}"}


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Field:
    name: str
    modifiers: tuple[str, ...] = ()


def parts_of(template: str, fields: set[str]) -> list:
    """Texts, Fields and lists (groups), or a TemplateError that says what is wrong."""
    if not template:
        raise TemplateError("the template is empty")
    if re.search(r"[/\\]", template):
        raise TemplateError("a template makes no folders")
    open_: list[list] = [[]]
    for token in re.findall(r"\{[^{}]*\}|[\[\]{}]|[^\[\]{}]+", template):
        if token == "[":
            open_.append([])
        elif token == "]":
            if len(open_) == 1:
                raise TemplateError("a bracket is closed that was not opened")
            group = open_.pop()
            open_[-1].append(group)
        elif token in "{}":
            raise TemplateError("a brace is not closed or not opened")
        elif token[0] == "{":
            name, *modifiers = token[1:-1].split(":")
            if name not in fields:
                raise TemplateError(f"no field is called {name!r}")
            if wrong := [m for m in modifiers if m not in MODIFIERS]:
                raise TemplateError(f"no modifier is called {wrong[0]!r}")
            open_[-1].append(Field(name, tuple(modifiers)))
        else:
            open_[-1].append(token)
    if len(open_) > 1:
        raise TemplateError("a bracket is not closed")
    return open_[0]


class Template:
    """One template over named fields."""

    def __init__(self, template: str, fields: list[str] | set[str]):
        self.parts = parts_of(template, set(fields))
        self.names: list[str] = []
        self.pattern = "^" + self._pattern(self.parts) + "$"

    def render(self, columns: dict[str, Column]) -> Column:
        """The name, without characters that file systems refuse and with single spaces; null if nothing is left."""
        text = F.regexp_replace(self._render(self.parts, columns)[0], r'[<>:"/\\|?*\x00-\x1f]', "")
        return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))

    def _render(self, parts: list, columns: dict[str, Column]) -> tuple[Column, Column]:
        """The text, and whether each field that is directly among the parts has a value."""
        texts, whole = [], F.lit(True)
        for part in parts:
            if isinstance(part, str):
                texts.append(F.lit(part))
            elif isinstance(part, Field):
                value = F.nullif(F.trim(columns[part.name].cast("string")), F.lit(""))
                whole = whole & value.isNotNull()
                for m in part.modifiers:
                    value = MODIFIERS[m](value)
                texts.append(F.coalesce(value, F.lit("")))
            else:
                text, there = self._render(part, columns)
                texts.append(F.when(there, text).otherwise(""))
        return F.concat(*texts) if texts else F.lit(""), whole

    def _pattern(self, parts: list) -> str:
        out = []
        for part in parts:
            if isinstance(part, str):
                out.append(re.sub(r"([^A-Za-z0-9 ])", r"\\\1", part))
            elif isinstance(part, Field):
                self.names.append(part.name)
                out.append(f"({SHAPES.get(part.name, '.+?')})")
            else:
                out.append(f"(?:{self._pattern(part)})?")
        return "".join(out)

    def parse(self, name: Column) -> dict[str, Column]:
        """The fields' texts, null where the name is none of this template or leaves them out; the first of a field's places counts."""
        out: dict[str, Column] = {}
        for i, field in enumerate(self.names, 1):
            value = F.nullif(F.regexp_extract(name, self.pattern, i), F.lit(""))
            out[field] = F.coalesce(out[field], value) if field in out else value
        return out
