"""Prompt formats by (row type, format name), with fallback along the row type's parents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

from weftline.functions.text import render_template


class PromptFormats:
    """Registry of column builders.

    A lookup tries the row type and its parents under the wanted format, then the same types without
    a format (the default builder), so a general rule serves every type that has no own one.
    """

    def __init__(self, parents: dict[str, str] | None = None) -> None:
        self.parents = parents or {}
        self._builders: dict[tuple[str, str | None], Callable[[list[str]], Column]] = {}

    def register(self, row_type: str, name: str | None, build: str | Callable[[list[str]], Column]) -> None:
        """``build`` is a template text or a function from column names to an expression."""
        self._builders[row_type, name] = (lambda columns: render_template(build, columns)) if isinstance(build, str) else build

    def lineage(self, row_type: str) -> list[str]:
        out = [row_type]
        while out[-1] in self.parents:
            out.append(self.parents[out[-1]])
        return out

    def get(self, row_type: str, name: str, columns: list[str]) -> Column:
        for wanted in (name, None):
            for kind in self.lineage(row_type):
                if (kind, wanted) in self._builders:
                    return self._builders[kind, wanted](columns)
        raise KeyError(f"no prompt format {name!r} for {row_type!r}")
