"""Chains of conversions do no step twice on a text, and readers that pass over plain stretches read what they read sign by sign."""

import random
import re

import pyarrow as pa

from docspark.functions import converters
from docspark.markup import convert, jira, markdown_parse


def test_a_text_that_comes_again_is_not_converted_again(monkeypatch):
    calls = []

    def counted(name, fn):
        return lambda text, **how: calls.append((name, text)) or fn(text, **how)

    monkeypatch.setattr(converters, "by_parts", lambda kind, run: lambda column: run)
    monkeypatch.setattr(converters, "STEPS", {k: (counted(k, fn), field) for k, (fn, field) in converters.STEPS.items()})
    steps = ["storage_to_jira", "from_jira", "markdown_to_jira", "from_jira", "markdown_to_jira"]
    page = "<h1>a</h1><ul><li>b *c*<ol><li>n</li></ol></li></ul>"
    (got,) = converters.passes(None, steps)([page]).to_pylist()
    assert got[0] == got[2] == got[4] and got[1] == got[3] and len(calls) == len(set(calls)) == 3
    # texts that differ are all converted, and no page gives another its texts
    calls.clear()
    loose = "a\n=\n\n* b\n* c\n"
    both = converters.passes(None, ["to_storage", "to_markdown", "to_storage", "to_markdown"])([loose, loose])
    assert both == pa.array([both[0].as_py()] * 2) and both[0].as_py()[1] == "# a\n\n- b\n- c\n" and len(calls) == 6


BITS = [
    "a", "b c", "1", "é", " ", "  ", "\n", "\n\n", "\t", "\\", "\\\\", "\\*", "\\[", "\\!", "!", "![", "[", "](u)", "]", "*", "**", "_", "~~", "~", "`", "```", "<b>", "</b>", "&", "&amp;", "&#65;",
    "# ", "- ", "* ", "1. ", "٣. ", "> ", "---", "===", "    ", "|", "| a | b |\n|---|---|\n", "::: info\n", ":::\n", "<!-- workflow: x -->", "{{", "}}", "{color:red}", "{color}", "h1. ", "??", "?", "^", "+x+", "!p.png!", "[l|u]",
]


def test_plain_stretches_make_no_difference(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 25))) for _ in range(3000)]

    def read():
        return [(convert.to_storage(t), convert.from_jira(t), convert.normal_markdown(t)) for t in texts]

    got = read()
    monkeypatch.setattr(markdown_parse, "_PIECE", re.compile(r"[^\\`*_~\[\]!<&\n]+"))
    monkeypatch.setattr(markdown_parse, "_PLAIN", re.compile(r"(?!)"))
    monkeypatch.setattr(markdown_parse, "signed", lambda line: True)
    monkeypatch.setattr(jira, "_NEXT", re.compile(r"[^\\\n{\[!?*_\-~+^]+"))
    assert got == read()
