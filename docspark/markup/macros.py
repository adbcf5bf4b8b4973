"""Macros that Markdown shows as directives."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Macro:
    """A storage macro and its directive; `rich` if it holds blocks.

    `read(element, blocks)` makes the node itself, or None, upon which the macro is kept as an opaque fragment;
    `write(node, blocks)` makes the element. `blocks` converts a body, elements to nodes or nodes to elements.
    Either may raise MacroError, which becomes the page's error. Without them parameters and body are taken as they are.
    """

    name: str
    directive: str
    rich: bool = False
    read: Callable | None = None
    write: Callable | None = None


class MacroRegistry:
    """A value: `with_macro` gives a new registry and drops entries that the new one replaces by either name."""

    def __init__(self, macros: tuple[Macro, ...] = ()):
        self.macros: tuple[Macro, ...] = ()
        for m in macros:
            self.macros = (*[x for x in self.macros if x.name != m.name and x.directive != m.directive], m)
        self._names = {m.name: m for m in self.macros}
        self._directives = {m.directive: m for m in self.macros}

    def with_macro(self, macro: Macro) -> MacroRegistry:
        return MacroRegistry((*self.macros, macro))

    def by_name(self, name: str) -> Macro | None:
        return self._names.get(name)

    def by_directive(self, name: str) -> Macro | None:
        return self._directives.get(name)


DEFAULT_MACROS = MacroRegistry((
    *[Macro(n, n, rich=True) for n in ("info", "note", "warning", "tip", "expand")],
    Macro("jira", "jira"),
    Macro("toc", "toc"),
))
