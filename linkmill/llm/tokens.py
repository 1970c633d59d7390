"""Token ids by public tokenizers."""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Callable

import numpy as np


def vocabulary(name: str) -> str:
    """The path of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """A function from text to ids (little-endian unsigned 32-bit); no special tokens are added to a text.

    `.json` files go through tokenizers, `.tiktoken` files through tiktoken. The two libraries give the
    same ids for the same vocabulary; tiktoken needs about a sixth of the time. The string of a special
    token in a text gets the token's id, as tokenizers does; tiktoken takes these tokens from the
    `.json` file of the same name, where there is one.
    """
    if path.endswith(".json"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda text: np.array(t.encode(text, add_special_tokens=False).ids, "<u4")
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special, same = {}, path.removesuffix(".tiktoken") + ".json"
    if os.path.exists(same):
        with open(same, encoding="utf-8") as f:
            special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"] if x["special"]}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: e.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
