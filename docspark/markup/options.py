"""Settings of the converters."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """bullet and fence of rendered Markdown; comment prefixes that Markdown keeps; the prefix of embedded markers.

    Documents that another tool has marked with its own prefix are read and written with `marker` set to it.
    """

    bullet: str = "-"
    fence: str = "```"
    keep_comments: tuple[str, ...] = ()
    marker: str = "docspark"

    def kept_prefixes(self) -> str | None:
        """Alternatives of a pattern for the comments to keep; the markers' own prefix is never among them."""
        own = [p for p in self.keep_comments if p and not p.startswith(f"{self.marker}:")]
        return "|".join(map(re.escape, own)) if own else None
