"""Options of the jobs; defaults are the newest version's."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DetectOptions:
    min_hex_len: int = 8
    max_hex_len: int = 256
    entropy: float = 3.5
    printable: float = 0.85
    strict: bool = False
    strict_exact_lengths: bool = False
    strict_local_context: bool = True
    vowel_check: bool = False  # the older English-like test
    require_context: bool = False
    mcf: bool = True
    max_scan: int = 5_000_000
    skip_assets: bool = True
    skip_blocked_types: bool = True
    scan_headers: bool = False
    scan_cookies: bool = False
    scan_path: bool = True
    scan_query: bool = True
    scan_params: bool = True
    scan_request_body: bool = True
    scan_response_body: bool = True
    scan_json: bool = True
    inflate_cap: int = 20_000_000  # larger unpacked bodies are looked through in segments


@dataclass(frozen=True)
class CaptureOptions:
    min_input: int = 1
    max_input: int = 4096
    distinct_hashes: bool = True
    distinct_inputs: bool = True


@dataclass(frozen=True)
class DecodeOptions:
    min_token: int = 8
    min_base64: int = 8
    max_decoded: int = 16_384
    min_decoded: int = 1
    depth: int = 3
    strict: bool = True
    readable_only: bool = True
    scope_only: bool = True
    try_utf16: bool = True
    brace_balance: bool = False  # the older gate's test
    split_semicolons: bool = False
    scan_responses: bool = True
    typed_bodies: bool = True  # request bodies of the allowed types only
    older_routes: bool = False  # LZ-String only: URI-safe, Base64, UTF-16, on a narrower class of tokens
    layer_tags: bool = False  # origins name the decode layer
    full_streams: bool = True  # no LZ-String in Base64 or URI-safe characters that ends amid a run of them, no raw deflate that breaks off or goes on


#: The older version: longer tokens, its own routes and gate, requests only, origins with their layer.
OLDER_DECODE = DecodeOptions(
    min_token=10, min_base64=12, brace_balance=True, split_semicolons=True, scan_responses=False, typed_bodies=False,
    older_routes=True, layer_tags=True, full_streams=False,
)
