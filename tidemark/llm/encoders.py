"""Byte-pair encoders of public vocabulary files, loaded once per worker."""

from __future__ import annotations

import base64
import json
import os

import numpy as np
import tiktoken

_loaded: dict[str, tuple] = {}


def default_ranks() -> str:
    """The installed rank file of the byte-level 50k vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def multi_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def added_tokens(path: str) -> dict[str, int]:
    """Tokens that the tokenizer file beside a rank file cuts out of any text as they stand."""
    beside = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(beside):
        return {}
    with open(beside) as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", ())}


def encoder(path: str) -> tuple[tiktoken.Encoding, np.ndarray, list[bytes]]:
    """The encoder, the byte length of each id, and each id's bytes."""
    if path not in _loaded:
        import public_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        added = added_tokens(path)
        tokens = [b""] * (max([*ranks.values(), *added.values()]) + 1)
        for token, k in (*ranks.items(), *((t.encode(), k) for t, k in added.items())):
            tokens[k] = token
        made = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        _loaded[path] = made, np.array([len(t) for t in tokens], np.int32), tokens
    return _loaded[path]


def ids_of(path: str, text: str) -> np.ndarray:
    """Token ids as the tokenizer file gives them: the string of an added token is that token."""
    return np.asarray(encoder(path)[0].encode_to_numpy(text, allowed_special="all", disallowed_special=()), np.uint32)
