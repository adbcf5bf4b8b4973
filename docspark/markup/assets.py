"""Attachments of a single page: names that are safe, and links to their bytes or copies."""

from __future__ import annotations

import base64
import logging
import mimetypes
import os
import posixpath
import re
from collections.abc import Callable
from functools import cache
from pathlib import Path

from .fragments import marks
from .options import Options
from .tree import AssetSecurityError

log = logging.getLogger(__name__)
_LINK = re.compile(r'(!\[(?:[^\]\\]|\\.)*\]\()([^)\s]*)((?:\s+"(?:[^"\\]|\\.)*")?\)[ \t]*)\Z', re.S)


def name_problem(name: str | None) -> str | None:
    """Why a file name must not be written to or read from; None if it may."""
    if not name:
        return "empty filename"
    if "\x00" in name:
        return "NUL byte"
    if "\\" in name:
        return "backslash"
    if ":" in name:
        return "colon"
    if name.startswith("/"):
        return "absolute path"
    return "parent directory segment" if ".." in name.split("/") else None


def check_name(name: str | None) -> None:
    if problem := name_problem(name):
        raise AssetSecurityError(f"{name!r}: {problem}")


@cache
def media_types() -> dict[str, str]:
    """Media types by extension in lower case, as Python's own table has them, whatever the system adds."""
    known = mimetypes.MimeTypes(filenames=())
    found = {ext[1:]: kind for ext, kind in known.types_map[True].items()}
    for short, long in known.suffix_map.items():  # such as tgz for tar.gz
        found[short[1:]] = found[long.split(".")[1]]
    return found


#: Extensions that only say how a file is packed; the one before them counts.
PACKED = ("gz", "Z", "bz2", "xz", "br")


def media_type(name: str) -> str:
    base = posixpath.basename(name)
    for packed in PACKED:
        base = base.removesuffix(f".{packed}")
    return media_types().get(base.rpartition(".")[2].lower() if "." in base else "", "application/octet-stream")


def safe_path(folder: str | Path, name: str, *, strict: bool = True) -> Path | None:
    """Where a file of that name belongs in the folder. Unsafe names, and links that lead out of it, raise an error if
    strict; else they are logged and there is no path."""
    base = Path(folder).resolve()
    problem = name_problem(name)
    path = None if problem else (base / name).resolve()
    if path is not None and path.is_relative_to(base):
        return path
    if strict:
        raise AssetSecurityError(f"{name!r}: {problem or 'leaves the folder'}")
    log.warning("%r is left out: %s", name, problem or "it leaves the folder")
    return None


def resolve_page(markdown: str, fetch: Callable[[str], bytes | None], *, mode: str = "sidecar", asset_dir: str | Path | None = None, page_dir: str | Path = ".", strict: bool = True, options: Options | None = None) -> tuple[str, int]:
    """The text with the image link before each asset marker pointing to the file's copy in asset_dir, or to its bytes;
    and how many files there were. Each file is fetched and written once; missing ones leave their links alone."""
    if mode not in ("sidecar", "inline"):
        raise ValueError("mode is sidecar or inline")
    if mode == "sidecar" and asset_dir is None:
        raise ValueError("sidecar needs an asset_dir")
    pattern = marks((options or Options()).marker).asset
    targets: dict[str, str | None] = {}

    def target(name: str) -> str | None:
        path = safe_path(asset_dir, name, strict=strict) if mode == "sidecar" else None
        if mode == "sidecar" and path is None:
            return None
        data = fetch(name)
        if data is None:
            return None
        if mode == "inline":
            return f"data:{media_type(name)};base64,{base64.b64encode(data).decode()}"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
        base = os.path.relpath(asset_dir, page_dir).replace(os.sep, "/")
        return name if base == "." else f"{base}/{name}"

    out, at = [], 0
    for m in pattern.finditer(markdown):
        name = m["src"]
        if name not in targets:
            targets[name] = target(name)
        piece = markdown[at : m.start()]
        if targets[name] is not None:
            piece = _LINK.sub(lambda k, new=targets[name]: k[1] + new + k[3], piece)
        out += [piece, m[0]]
        at = m.end()
    return "".join(out) + markdown[at:], sum(t is not None for t in targets.values())
