"""Numbers of tokens of texts, in a public byte-level tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import re

#: A rank file: one base64 token and its rank a line. Never part of this repository.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts text before merges, published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space and the run of other characters after it: no token reaches over the start of one.
CHUNK = re.compile(r"\s*\S+|\s+")
KEPT = 500_000


class _Counts(dict):
    def __init__(self, encoding) -> None:
        self.encode = encoding.encode_ordinary

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self.encode(chunk))
        return n


class Counter:
    """Tokens of texts and of their chunks; the chunks of a text add up to the text."""

    def __init__(self, path: str = TOKENIZER) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.counts = _Counts(self.encoding)

    def chunks(self, text: str) -> list[int]:
        """Tokens of each chunk of ``text``."""
        if len(self.counts) > KEPT:
            self.counts.clear()
        return list(map(self.counts.__getitem__, CHUNK.findall(text)))

    def exact(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))
