"""The public byte-level BPE vocabularies, as tiktoken encodings."""

from __future__ import annotations

import base64

import public_tokenizers
import tiktoken


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def encoding(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})
