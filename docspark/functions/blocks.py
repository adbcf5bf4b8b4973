"""Readers of pages as table functions: nodes come one by one, so that no row holds all nodes of a page.

    SELECT p.page_id, b.* FROM pages AS p, LATERAL parse_blocks(p.markdown, 'markdown') AS b
    SELECT * FROM page_blocks(TABLE(pages))
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, PartitioningColumn, udtf
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructType

from ..markup.jira import parse_jira
from ..markup.markdown_parse import parse_markdown
from ..markup.options import Options
from ..markup.storage import parse_storage
from ..markup.tree import MarkupError, Node

NODE = StructType()
for _name in ("id", "last", "parent", "depth", "ord"):
    NODE.add(_name, IntegerType())
NODE.add("kind", StringType()).add("text", StringType()).add("level", IntegerType()).add("attrs", MapType(StringType(), StringType()))
NODE.add("params", ArrayType(StructType().add("k", StringType()).add("v", StringType())))
FORMATS = ("markdown", "xhtml", "jira_wiki")
ERROR = "error"


def tree_of(source: str | None, source_format: str) -> list[Node]:
    if source is None:
        return []
    if source_format == "xhtml":
        return parse_storage(source)[0]
    return parse_markdown(source, Options())[0] if source_format == "markdown" else parse_jira(source)[0]


def rows_of(tree: list[Node]) -> Iterator[tuple]:
    """The nodes in pre-order, as `explode_nodes` has them. Sizes of subtrees are added up first, then each row is made when it is
    asked for."""
    sizes: dict[int, int] = {}
    stack: list[tuple[Node, bool]] = [(n, False) for n in tree]
    while stack:
        n, ready = stack.pop()
        if ready:
            sizes[id(n)] = 1 + sum(sizes[id(k)] for k in n.kids)
        elif n.kids:
            stack.append((n, True))
            stack.extend((k, False) for k in n.kids)
        else:
            sizes[id(n)] = 1
    number, todo = 0, [(n, None, 0, i) for i, n in reversed(list(enumerate(tree)))]
    while todo:
        n, parent, depth, place = todo.pop()
        yield number, number + sizes[id(n)] - 1, parent, depth, place, n.kind, n.text, n.level, dict(n.attrs), [{"k": k, "v": v} for k, v in n.params]
        todo.extend((k, number, depth + 1, i) for i, k in reversed(list(enumerate(n.kids))))
        number += 1


def nodes_or_error(source: str | None, source_format: str) -> Iterator[tuple]:
    """The nodes; of a text that can't be read one row of kind `error` with the reason."""
    try:
        tree = tree_of(source, source_format)
    except (MarkupError, RecursionError) as ex:
        yield 0, 0, None, 0, 0, ERROR, str(ex), None, {}, []
        return
    yield from rows_of(tree)


class ParseBlocks:
    """parse_blocks(text, format): a row for each node of a text; null text has none."""

    @staticmethod
    def analyze(text: AnalyzeArgument, source_format: AnalyzeArgument) -> AnalyzeResult:
        if text.isTable or not isinstance(text.dataType, StringType):
            raise ValueError("parse_blocks reads a text")
        if not source_format.isConstantExpression or source_format.value not in FORMATS:
            raise ValueError(f"the format is one of {', '.join(FORMATS)}")
        return AnalyzeResult(NODE)

    def eval(self, text: str | None, source_format: str):
        yield from nodes_or_error(text, source_format)


class PageBlocks:
    """page_blocks(TABLE(pages)): a row for each node of each page, after its page_id. The table has page_id and one of the
    columns markdown, xhtml and jira_wiki; rows of one page_id meet in a partition."""

    def __init__(self, found: AnalyzeResult | None = None):
        self.found = found

    @staticmethod
    def analyze(pages: AnalyzeArgument) -> AnalyzeResult:
        if not pages.isTable or not isinstance(pages.dataType, StructType) or "page_id" not in pages.dataType.names:
            raise ValueError("page_blocks reads a table with a column page_id")
        held = [f for f in FORMATS if f in pages.dataType.names]
        if len(held) != 1:
            raise ValueError(f"the table has one of the columns {', '.join(FORMATS)}")
        schema = StructType([pages.dataType["page_id"], *NODE.fields])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("page_id")])

    def eval(self, row):
        held = row.asDict()
        source = next(f for f in FORMATS if f in held)
        for node in nodes_or_error(held[source], source):
            yield held["page_id"], *node


def register(spark: SparkSession) -> None:
    """Make both known to SQL."""
    spark.udtf.register("parse_blocks", udtf(ParseBlocks))
    spark.udtf.register("page_blocks", udtf(PageBlocks))
