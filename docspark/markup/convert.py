"""One call for each direction, from source text to a result row; what a document does wrong is part of the row."""

from __future__ import annotations

import hashlib
import re

from . import diff
from .canonical import canonical_storage, traced_storage
from .jira import parse_jira, render_jira
from .macros import DEFAULT_MACROS, MacroRegistry
from .markdown_parse import parse_markdown
from .markdown_render import render_markdown
from .options import Options
from .storage import parse_storage, render_storage
from .tree import ConversionError, MarkupError, to_rows

_CDATA = re.compile(r"<!\[CDATA\[.*?\]\]>", re.S)
_FILE = re.compile(r'ri:filename="([^"]*)"')
_XHTML_START = re.compile(r"^<(?:\?xml|!DOCTYPE|ac:|ri:)")
_FIRST_TAG = re.compile(r"^<[^>]*\bxmlns")
GUESS_WARNING = "the text begins with '<', but not as a storage page does, and is read as Markdown"


def result(**values) -> dict:
    empty = {"xhtml": None, "markdown": None, "jira_wiki": None, "attachments": None, "warnings": [], "nodes": None, "error": None}
    return empty | values


def guarded(fn):
    """Turns a document's error into the error field."""

    def run(source, *args, **options) -> dict:
        if source is None:
            return result(warnings=None)
        try:
            return fn(source, *args, **options)
        except MarkupError as ex:
            return result(error={"class": type(ex).__name__, "message": str(ex)})
        except RecursionError:
            return result(error={"class": "ParseError", "message": "the document is nested too deeply"})

    return run


def files_of(xhtml: str) -> list[str]:
    """Attachment names in the order of the source, CDATA left out."""
    return list(dict.fromkeys(_FILE.findall(_CDATA.sub("", xhtml))))


def input_format(source: str) -> tuple[str, bool]:
    """markdown or xhtml, and whether that is a guess to warn of."""
    start = source.lstrip()
    if _XHTML_START.match(start) or _FIRST_TAG.match(start):
        return "xhtml", False
    return "markdown", start.startswith("<")


@guarded
def to_storage(source: str, options: Options | None = None, macros: MacroRegistry = DEFAULT_MACROS, nodes: bool = True) -> dict:
    tree, warnings = parse_markdown(source, options)
    xhtml, local, more = render_storage(tree, macros)
    names = {p.rsplit("/", 1)[-1] for p in local}
    attachments = local + [f for f in files_of(xhtml) if f not in names]
    return result(xhtml=xhtml, attachments=attachments, warnings=warnings + more, nodes=to_rows(tree) if nodes else None)


@guarded
def to_markdown(source: str, options: Options | None = None, macros: MacroRegistry = DEFAULT_MACROS, nodes: bool = True) -> dict:
    if not source:
        return result(markdown="", attachments=[], nodes=[] if nodes else None)
    tree, warnings = parse_storage(source, macros)
    return result(markdown=render_markdown(tree, options), attachments=files_of(source), warnings=warnings, nodes=to_rows(tree) if nodes else None)


@guarded
def to_jira(source: str, options: Options | None = None, macros: MacroRegistry = DEFAULT_MACROS, nodes: bool = True, source_format: str = "auto", **how) -> dict:
    warnings: list[str] = []
    if source_format == "auto":
        source_format, guess = input_format(source)
        warnings = [GUESS_WARNING] if guess else []
    if source_format not in ("markdown", "xhtml"):
        raise ConversionError(f"unknown input format {source_format!r}")
    tree, more = parse_storage(source, macros) if source_format == "xhtml" else parse_markdown(source, options)
    wiki, last = render_jira(tree, **how)
    return result(jira_wiki=wiki, warnings=warnings + more + last, nodes=to_rows(tree) if nodes else None)


@guarded
def from_jira(source: str, options: Options | None = None, nodes: bool = True) -> dict:
    if not source:
        return result(markdown="", attachments=[], nodes=[])
    tree, warnings, attachments = parse_jira(source)
    return result(markdown=render_markdown(tree, options), attachments=attachments, warnings=warnings, nodes=to_rows(tree) if nodes else None)


@guarded
def canonical(source: str) -> dict:
    return result(xhtml=canonical_storage(source))


def traced(source: str | None) -> dict:
    """The canonical form and the rules that made it: xhtml, rules as (rule, taken), error."""
    none = {"xhtml": None, "rules": None, "error": None}
    if source is None:
        return none
    try:
        xhtml, rules = traced_storage(source)
    except MarkupError as ex:
        return none | {"error": str(ex)}
    except RecursionError:
        return none | {"error": "the document is nested too deeply"}
    return none | {"xhtml": xhtml, "rules": [{"rule": r, "taken": n} for r, n in rules]}


@guarded
def normal_markdown(source: str) -> dict:
    tree, warnings = parse_markdown(source, Options())
    return result(markdown=render_markdown(tree, Options()), warnings=warnings)


def hashed(source: str | None, source_format: str) -> tuple[str | None, str | None]:
    """SHA-256 of the canonical storage form, and what is wrong with the source."""
    made = to_storage(source, nodes=False) if source_format == "markdown" else result(xhtml=source)
    if made["error"] is None:
        made = canonical(made["xhtml"])
    if made["error"] is not None or made["xhtml"] is None:
        return None, made["error"] and made["error"]["message"]
    return hashlib.sha256(made["xhtml"].encode("utf-8", "surrogatepass")).hexdigest(), None


def canonical_blocks(source: str | None, source_format: str) -> tuple[str | None, list[str] | None, str | None]:
    """SHA-256 of the canonical storage form, hashes of its top-level parts in order, and what is wrong with the source."""
    made = to_storage(source, nodes=False) if source_format == "markdown" else result(xhtml=source)
    if made["error"] is None:
        made = canonical(made["xhtml"])
    if made["error"] is not None or made["xhtml"] is None:
        return None, None, made["error"] and made["error"]["message"]
    digests = diff.Digests()
    return hashlib.sha256(made["xhtml"].encode("utf-8", "surrogatepass")).hexdigest(), [digests.of(p).hex()[:32] for p in diff.parsed(made["xhtml"])], None


def page_script(old: str | None, new: str | None) -> dict:
    """What makes one storage page the other, both in canonical form; null if either is null."""
    empty = {"script": None, "kept": None, "moved": None, "changed": None, "inserted": None, "deleted": None, "error": None}
    if old is None or new is None:
        return empty
    a, b = canonical(old), canonical(new)
    if error := a["error"] or b["error"]:
        return empty | {"error": error["message"]}
    try:
        steps, n = diff.page_script(a["xhtml"], b["xhtml"])
    except (MarkupError, RecursionError) as ex:
        return empty | {"error": str(ex)}
    return empty | {"script": steps} | n


def patched(old: str | None, steps: str | None) -> dict:
    """The canonical form of a storage page after a script."""
    if old is None or steps is None:
        return result(warnings=None)
    made = canonical(old)
    if made["error"]:
        return made
    try:
        return result(xhtml=diff.patched(made["xhtml"], steps))
    except (MarkupError, RecursionError) as ex:
        return result(error={"class": type(ex).__name__, "message": str(ex)})
