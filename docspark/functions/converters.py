"""Converters as columns. Each is one UDF call a page and returns a result struct; a page's error is in `error`.

Filters on other columns should be written before a conversion: the UDFs are marked non-deterministic, so that
projecting several fields and filtering on one still runs them once. A conversion needs no shuffle. A batch of pages is
converted and sent back in parts, so that a worker holds the trees and rows of few pages, however many the batch has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..markup import convert, diff
from ..markup.jira import PROMOTIONS
from ..markup.macros import DEFAULT_MACROS, MacroRegistry
from ..markup.options import Options

NODES = (
    "array<struct<id:int,last:int,parent:int,depth:int,ord:int,kind:string,text:string,level:int,"
    "attrs:map<string,string>,params:array<struct<k:string,v:string>>>>"
)
RESULT = f"struct<xhtml:string,markdown:string,jira_wiki:string,attachments:array<string>,warnings:array<string>,nodes:{NODES},error:struct<class:string,message:string>>"


def as_column(source: Column | str) -> Column:
    return F.col(source) if isinstance(source, str) else source


#: Pages, and characters of text, after which a part of a batch is sent back.
PART_PAGES, PART_CHARS = 256, 1 << 18


def parts(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts, a few at a time; a text that is longer than a part alone or last in one."""
    part, held = [], 0
    for t in texts:
        part.append(t.as_py())
        held += len(part[-1] or "")
        if len(part) >= PART_PAGES or held >= PART_CHARS:
            yield part
            part, held = [], 0
    if part:
        yield part


def by_parts(kind: str, fn: Callable[[list[str | None]], pa.Array]) -> Callable[[Column], Column]:
    """A column function from one that makes an array of a few texts."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in parts(texts):
                yield fn(part)

    return run.asNondeterministic()


def converter(fn: Callable[[str | None], dict]) -> Callable[[Column], Column]:
    return by_parts(RESULT, lambda part: pa.array([fn(t) for t in part], result_type()))


def result_type() -> pa.DataType:
    text, size = pa.string(), pa.int32()
    pair = pa.struct([("k", text), ("v", text)])
    node = pa.struct([
        ("id", size), ("last", size), ("parent", size), ("depth", size), ("ord", size), ("kind", text), ("text", text), ("level", size),
        ("attrs", pa.map_(text, text)), ("params", pa.list_(pair)),
    ])
    return pa.struct([
        ("xhtml", text), ("markdown", text), ("jira_wiki", text), ("attachments", pa.list_(text)), ("warnings", pa.list_(text)),
        ("nodes", pa.list_(node)), ("error", pa.struct([("class", text), ("message", text)])),
    ])


def to_storage(source: Column | str, options: Options | None = None, macros: MacroRegistry = DEFAULT_MACROS, *, nodes: bool = True) -> Column:
    """Markdown to storage XHTML."""
    return converter(lambda s: convert.to_storage(s, options, macros, nodes))(as_column(source))


def to_markdown(source: Column | str, options: Options | None = None, macros: MacroRegistry = DEFAULT_MACROS, *, nodes: bool = True) -> Column:
    """Storage XHTML to canonical Markdown."""
    return converter(lambda s: convert.to_markdown(s, options, macros, nodes))(as_column(source))


def to_jira(
    source: Column | str,
    options: Options | None = None,
    macros: MacroRegistry = DEFAULT_MACROS,
    *,
    source_format: str = "auto",
    section: str | None = None,
    drop_leading: tuple[str, ...] = (),
    promotion: str = "confluence",
    languages: dict[str, str] | None = None,
    nodes: bool = True,
) -> Column:
    """Markdown or storage XHTML to Jira wiki text; jira_wiki is null if the section is missing."""
    if promotion not in PROMOTIONS:
        raise ValueError(f"promotion must be one of {sorted(PROMOTIONS)}, got {promotion!r}")
    how = {"section": section, "drop_leading": drop_leading, "promotion": promotion, "languages": languages}
    return converter(lambda s: convert.to_jira(s, options, macros, nodes, source_format, **how))(as_column(source))


def from_jira(source: Column | str, options: Options | None = None, *, nodes: bool = True) -> Column:
    """Jira wiki text to canonical Markdown."""
    return converter(lambda s: convert.from_jira(s, options, nodes))(as_column(source))


def canonical_storage(source: Column | str) -> Column:
    """The canonical form in `xhtml`: equal for fragments that differ only in what does not count."""
    return converter(convert.canonical)(as_column(source))


TRACE = pa.struct([("xhtml", pa.string()), ("rules", pa.list_(pa.struct([("rule", pa.string()), ("taken", pa.int64())]))), ("error", pa.string())])


def canonical_trace(source: Column | str) -> Column:
    """(xhtml, rules, error): the canonical form, and the rules that changed the page with the characters each took away."""

    kind = "struct<xhtml:string,rules:array<struct<rule:string,taken:long>>,error:string>"
    return by_parts(kind, lambda part: pa.array([convert.traced(t) for t in part], TRACE))(as_column(source))


def normalize_markdown(source: Column | str) -> Column:
    """Markdown read and written again with default options, in `markdown`."""
    return converter(convert.normal_markdown)(as_column(source))


def storage_hash(source: Column | str, source_format: str) -> Column:
    """(hash, error): SHA-256 of the canonical storage form of `markdown` or `xhtml` text."""

    def run(part: list[str | None]) -> pa.Array:
        found = [convert.hashed(t, source_format) for t in part]
        return pa.StructArray.from_arrays([pa.array([h for h, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], ["hash", "error"])

    return by_parts("struct<hash:string,error:string>", run)(as_column(source))


def storage_blocks(source: Column | str, source_format: str) -> Column:
    """(hash, blocks, error): SHA-256 of the canonical storage form of `markdown` or `xhtml` text, and hashes of its
    top-level parts in order."""

    def run(part: list[str | None]) -> pa.Array:
        found = list(zip(*[convert.canonical_blocks(t, source_format) for t in part], strict=True))
        return pa.StructArray.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1], pa.list_(pa.string())), pa.array(found[2], pa.string())], ["hash", "blocks", "error"])

    return by_parts("struct<hash:string,blocks:array<string>,error:string>", run)(as_column(source))


STEPS = {
    "to_storage": (convert.to_storage, "xhtml"), "to_markdown": (convert.to_markdown, "markdown"), "from_jira": (convert.from_jira, "markdown"),
    "markdown_to_jira": (lambda s, **how: convert.to_jira(s, source_format="markdown", **how), "jira_wiki"),
    "storage_to_jira": (lambda s, **how: convert.to_jira(s, source_format="xhtml", **how), "jira_wiki"),
}


def passes(source: Column | str, steps: list[str]) -> Column:
    """The texts after each of some conversions, of which each reads what the one before has written; null from an error on.

    One call a page, so that no worker is needed for each step. A step that meets a text again that it has read for this page
    gives what it gave then."""
    if unknown := set(steps) - set(STEPS):
        raise ValueError(f"steps are among {sorted(STEPS)}, got {sorted(unknown)}")

    def run(text: str | None) -> list[str | None]:
        out, made = [], {}
        for name in steps:
            fn, field = STEPS[name]
            if (name, text) not in made:
                made[name, text] = fn(text, nodes=False)[field]
            text = made[name, text]
            out.append(text)
        return out

    return by_parts("array<string>", lambda part: pa.array([run(t) for t in part], pa.list_(pa.string())))(as_column(source))


SCRIPT = pa.struct([("script", pa.string()), *[(n, pa.int32()) for n in ("kept", "moved", "changed", "inserted", "deleted")], ("error", pa.string())])


def page_script(old: Column | str, new: Column | str) -> Column:
    """(script, kept, moved, changed, inserted, deleted, error): what makes one storage page the other, in canonical form."""

    @F.arrow_udf("struct<script:string,kept:int,moved:int,changed:int,inserted:int,deleted:int,error:string>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([convert.page_script(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], SCRIPT)

    return run.asNondeterministic()(as_column(old), as_column(new))


def patch_page(old: Column | str, script: Column | str) -> Column:
    """The canonical form, in `xhtml`, of a storage page after a script of `page_script`."""

    @F.arrow_udf("struct<xhtml:string,error:struct<class:string,message:string>>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        made = [convert.patched(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
        return pa.array([{k: m[k] for k in ("xhtml", "error")} for m in made], pa.struct([("xhtml", pa.string()), ("error", pa.struct([("class", pa.string()), ("message", pa.string())]))]))

    return run.asNondeterministic()(as_column(old), as_column(script))


PLACES = "struct<inserted:array<int>,deleted:array<int>,moved:array<struct<source:int,target:int>>>"


def block_changes(old: Column | str, new: Column | str) -> Column:
    """Places of the items of an array that come, go and move between two arrays of hashes; null if either is null."""

    @F.arrow_udf(PLACES)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            if x is None or y is None:
                out.append(None)
                continue
            kept, moved = diff.aligned(x, y)
            gone, come = set(range(len(x))) - {i for i, _ in kept + moved}, set(range(len(y))) - {j for _, j in kept + moved}
            out.append({"inserted": sorted(come), "deleted": sorted(gone), "moved": [{"source": i, "target": j} for i, j in moved]})
        ints, pair = pa.list_(pa.int32()), pa.struct([("source", pa.int32()), ("target", pa.int32())])
        return pa.array(out, pa.struct([("inserted", ints), ("deleted", ints), ("moved", pa.list_(pair))]))

    return run.asNondeterministic()(as_column(old), as_column(new))
