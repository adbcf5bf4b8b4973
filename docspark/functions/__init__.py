"""Column functions: converters as Arrow-batched UDFs, plain string steps as built-in expressions."""

from .converters import (
    block_changes,
    canonical_storage,
    canonical_trace,
    from_jira,
    normalize_markdown,
    page_script,
    passes,
    patch_page,
    storage_blocks,
    storage_hash,
    to_jira,
    to_markdown,
    to_storage,
)
from .native import (
    asset_markers,
    attachment_files,
    authentic_blocks,
    data_uri,
    directive_params,
    escape_jira,
    escape_markdown,
    filename_problem,
    fragment_id,
    heading_level,
    image_size,
    inline_fragments,
    input_format,
    is_local_file,
    macro_params,
    payload_entries,
    strip_comments,
    strip_notice,
    strip_payloads,
    unescape_jira,
    without_blocks,
    write_asset_marker,
    write_fragment,
    write_fragment_link,
    write_payloads,
)

__all__ = [
    "asset_markers", "attachment_files", "authentic_blocks", "block_changes", "canonical_storage", "canonical_trace", "data_uri", "directive_params", "escape_jira",
    "escape_markdown", "filename_problem", "fragment_id", "from_jira", "heading_level", "image_size", "inline_fragments", "input_format",
    "is_local_file", "macro_params", "normalize_markdown", "page_script", "passes", "patch_page", "payload_entries", "storage_blocks", "storage_hash", "strip_comments", "strip_notice", "strip_payloads", "to_jira",
    "to_markdown", "to_storage", "unescape_jira", "without_blocks", "write_asset_marker", "write_fragment", "write_fragment_link", "write_payloads",
]
