"""Token counts of a public tokenizer whose vocabulary file is given by path."""

from __future__ import annotations

import base64
import importlib.util
import os
from pathlib import Path

# A fixed value: how the byte-level vocabularies split a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_LOADED: dict[str, object] = {}


def default_vocabulary() -> str:
    """The ``byte_bpe_50k.tiktoken`` file: in ``LODESTONE_TOKENIZERS``, else in the installed public_tokenizers package, else in /opt/tokenizers."""
    folder = os.environ.get("LODESTONE_TOKENIZERS")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = str(Path(spec.origin).parent) if spec and spec.origin else "/opt/tokenizers"
    return f"{folder}/byte_bpe_50k.tiktoken"


def encoding(path: str):
    """The tokenizer of a rank file, loaded once a process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def count(text: str, path: str) -> int:
    return len(encoding(path).encode_ordinary(text))
