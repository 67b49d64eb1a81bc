"""Token ids of whole texts with a public byte-level vocabulary. Tokenizers are loaded, never trained."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np

#: Characters for which both libraries are known to split texts alike; other texts take the slower one.
_PLAIN = re.compile("[\x00-ɏ‐-‧]*")
#: Runs on which the pattern splitter of the faster library is slow or deep.
_LONG = re.compile(r"\S{1000}|\s{1000}")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def _load(path: str):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    slow = Tokenizer.from_file(path)
    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks):
        return slow, None, {}
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    special = {token.content: i for i, token in slow.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)
    return slow, fast, special


class Encoder:
    """``ids(text)`` as the vocabulary file's own library gives them, special strings included.

    The same vocabulary as ranks is about four times faster; it is used where both give the same ids.
    """

    def __init__(self, path: str | None = None):
        self.slow, self.fast, special = _load(path or default_vocabulary())
        self.allowed = set(special)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and _PLAIN.fullmatch(text) and not _LONG.search(text):
            return np.array(self.fast.encode(text, allowed_special=self.allowed, disallowed_special=()), dtype=np.uint32)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def plain_ids(self, text: str) -> list[int]:
        """Ids with special strings taken as ordinary text."""
        if self.fast is not None and _PLAIN.fullmatch(text) and not _LONG.search(text):
            return self.fast.encode_ordinary(text)
        before, self.slow.encode_special_tokens = self.slow.encode_special_tokens, True
        try:
            return self.slow.encode(text, add_special_tokens=False).ids
        finally:
            self.slow.encode_special_tokens = before

    def text(self, ids) -> str:
        return self.slow.decode(list(ids), skip_special_tokens=False)
