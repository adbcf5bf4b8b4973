"""Queries over the canonical rules: each of them is met by some pages, and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import publish
from .pages import lines, read, xml
from .queries import XML, query

#: Noise, the pages that hold it, what stands there in canonical form, and the rules that see to it.
NOISE = [
    ("page_id % 2 = 0", '<p data-uuid="1">  a <span style="color: red">b</span>  c<br/> </p>', "<p>a b c</p>", ["scrub_attributes", "unwrap_spans", "collapse_space", "strip_trailing_breaks", "trim_ends"]),
    ("page_id % 3 = 0", "<table><colgroup><col/></colgroup><tbody><tr><td><div>c</div></td><td><p>a</p><p>b</p></td><td/></tr></tbody></table>",
     "<table><thead><tr><th>c</th><th>a<br></br>b</th></tr></thead><tbody></tbody></table>", ["drop_columns", "promote_header", "unwrap_divs", "flatten_cells", "trim_rows"]),
    ("page_id % 5 <> 0", '<pre><code class="language-sql">x</code></pre>', '<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">sql</ac:parameter><ac:plain-text-body>x</ac:plain-text-body></ac:structured-macro>', ["pre_to_macro"]),
    ("page_id % 5 <> 1", '<ac:structured-macro ac:name="code"><ac:parameter ac:name="linenumbers">true</ac:parameter><ac:plain-text-body><![CDATA[y\n\n]]></ac:plain-text-body></ac:structured-macro>',
     '<ac:structured-macro ac:name="code"><ac:plain-text-body>y</ac:plain-text-body></ac:structured-macro>', ["drop_code_params", "trim_code"]),
    ("page_id % 5 <> 2", "<p>z<code>a\\|b</code></p>", "<p>z<code>a|b</code></p>", ["plain_pipes"]),
    ("page_id % 7 <> 0", "<h2>t<br/>u</h2>", "<h2>t</h2><p>u</p>", ["split_headings"]),
    ("page_id % 7 <> 1", "<ul><li><p>i</p></li><li><br/></li></ul>", "<ul><li>i</li><li></li></ul>", ["flatten_items", "drop_lone_breaks"]),
    ("page_id % 7 <> 2", "<p/>", "", ["drop_empty_paragraphs"]),
    ("page_id % 7 <> 3", "<pre> </pre>", "", ["drop_empty_pre"]),
    ("page_id % 7 <> 4", "<ol>\n<li>k</li>\n</ol>", "<ol><li>k</li></ol>", ["strip_block_space"]),
]
CODE = '<ac:structured-macro ac:name="code"><ac:plain-text-body>', "</ac:plain-text-body></ac:structured-macro>"


def noisy_pages(spark, sf_dir) -> DataFrame:
    """A page for each conversation: what was said as code, then the noise."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.array_join(lines("text"), "\n").alias("said")))), lambda t: t["said"]), "\n-")
    pages = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("page_id")).agg(F.concat(F.lit("-"), said).alias("said"))
    body = F.concat(F.lit(CODE[0]), xml(F.concat("said", F.lit("."))), F.lit(CODE[1]))
    return pages.select("page_id", F.concat(body, *[F.when(F.expr(when), before).otherwise("") for when, before, _, _ in NOISE]).alias("xhtml"))


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SAID = """WITH s AS (SELECT conv_id AS page_id, '-' || string_agg(array_to_string(list_filter(list_transform(string_split(text, chr(10)),
  lambda x: trim(regexp_replace(x, '[ \\t\\r]+', ' ', 'g'))), lambda x: x <> ''), chr(10)), chr(10) || '-' ORDER BY turn) || '.' AS said FROM conversations GROUP BY 1)
"""


@query(SAID + f"SELECT page_id, {_text(CODE[0])} || {XML.format('said')} || {_text(CODE[1])}" + "".join(f" || CASE WHEN {when} THEN {_text(after)} ELSE '' END" for when, _, after, _ in NOISE) + " AS canonical FROM s")
def canonical_noise(spark, sf_dir):
    """Pages whose noise meets every rule, in canonical form."""
    return noisy_pages(spark, sf_dir).select("page_id", fn.canonical_storage("xhtml")["xhtml"].alias("canonical"))


@query(" UNION ALL ".join(f"SELECT '{rule}' AS rule, count(DISTINCT conv_id) FILTER ({when.replace('page_id', 'conv_id')}) AS pages FROM conversations" for when, _, _, rules in NOISE for rule in rules))
def canonical_rules(spark, sf_dir):
    """How many pages each rule changes."""
    return publish.rule_counts(noisy_pages(spark, sf_dir)).select("rule", "pages")
