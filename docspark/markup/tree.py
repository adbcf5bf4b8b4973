"""The document tree: one node class, and its form as an array of rows."""

from __future__ import annotations

from dataclasses import dataclass, field

INLINE_WRAPS = ("em", "strong", "del", "sub", "sup", "ins", "cite", "color", "link")


class MarkupError(Exception):
    """Base of all errors that a document can cause; `name` stands in the error column."""


class ParseError(MarkupError):
    """The source can't be read."""


class ConversionError(MarkupError):
    """The tree can't be written in the target format."""


class MacroError(MarkupError):
    """A macro's own reader or writer can't go on."""


class AssetSecurityError(MarkupError):
    """An attachment's name is not safe to write to."""


@dataclass(slots=True)
class Node:
    kind: str
    kids: list[Node] = field(default_factory=list)
    text: str | None = None
    level: int | None = None
    attrs: dict[str, str] = field(default_factory=dict)
    params: list[tuple[str, str]] = field(default_factory=list)

    def get(self, key: str) -> str | None:
        return self.attrs.get(key)

    def number(self, key: str, default: int = 1) -> int:
        return int(self.attrs[key]) if key in self.attrs else default


def text(content: str) -> Node:
    return Node("text", text=content)


def flat(nodes: list[Node]) -> str:
    """Plain text of inline nodes; breaks count as a space, images and fragments as nothing."""
    out = []
    for n in nodes:
        if n.kind in ("text", "code"):
            out.append(n.text or "")
        elif n.kind in ("softbreak", "hardbreak"):
            out.append(" ")
        elif n.kind in INLINE_WRAPS:
            out.append(flat(n.kids))
    return "".join(out)


def walk(nodes: list[Node]):
    """All nodes, parents first."""
    stack = list(reversed(nodes))
    while stack:
        n = stack.pop()
        yield n
        stack.extend(reversed(n.kids))


def to_rows(nodes: list[Node]) -> list[dict]:
    """The tree in pre-order: a subtree is the contiguous range of ids from a node's own to its `last`."""
    rows: list[dict] = []
    stack = [(n, -1, 0, i) for i, n in reversed(list(enumerate(nodes)))]
    while stack:
        n, parent, depth, place = stack.pop()
        number = len(rows)
        rows.append({
            "id": number, "last": number, "parent": None if parent < 0 else parent, "depth": depth, "ord": place, "kind": n.kind, "text": n.text,
            "level": n.level, "attrs": list(n.attrs.items()), "params": [{"k": k, "v": v} for k, v in n.params],
        })
        stack.extend((k, number, depth + 1, i) for i, k in reversed(list(enumerate(n.kids))))
    for r in reversed(rows):
        if r["parent"] is not None:
            above = rows[r["parent"]]
            above["last"] = max(above["last"], r["last"])
    return rows


def from_rows(rows: list[dict]) -> list[Node]:
    """The tree of its rows."""
    top: list[Node] = []
    made: list[Node] = []
    for r in rows:
        attrs = r["attrs"] or {}
        n = Node(r["kind"], [], r["text"], r["level"], dict(attrs), [(p["k"], p["v"]) for p in r["params"] or []])
        made.append(n)
        (top if r["parent"] is None else made[r["parent"]].kids).append(n)
    return top
