"""Tokenizer files, loaded once per worker."""

from __future__ import annotations

import base64
from collections.abc import Callable
from pathlib import Path

import numpy as np

from fathomix.llm.common import per_worker

# The vocabulary in the tokenizers format; beside it lie the same tokens as ranks.
DEFAULT = "byte_bpe_50k.json"


def ranked(tokenizer: str):
    """The ranks file of a byte-level BPE, as an encoder that takes any text as ordinary.

    ``tokenizer`` is the ``.json`` file's path, or its name in the installed package. Its
    ``.tiktoken`` neighbour holds the same vocabulary and gives the same ids several times
    faster; the tests compare the two.
    """
    import public_tokenizers
    import tiktoken

    path = Path(tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer)).with_suffix(".tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in path.read_bytes().splitlines() if line)}
    return tiktoken.Encoding(path.stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoder(tokenizer: str) -> tuple[Callable[[str], np.ndarray], str]:
    """A function from text to ids, and the narrowest little-endian type that holds them."""
    encoding = per_worker(f"tokenizer {tokenizer}", lambda: ranked(tokenizer))
    width = "<u2" if encoding.max_token_value < 1 << 16 else "<u4"

    def encode(text: str) -> np.ndarray:
        return encoding.encode_to_numpy(text, disallowed_special=())

    return encode, width
