"""Chunks of a text whose byte-pair encodings can be joined, and caches of their encodings in the workers."""

from __future__ import annotations

import base64
import re

import numpy as np

# White space next to white space; elsewhere a space or line break always starts a new pre-token.
SPACE_PAIR = re.compile(r"\s\s")
INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")


def fast_encoder(ranks_path: str):
    """The byte-pair ranks without special tokens; equal to the vocabulary in the .json file beside it."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def library(json_path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


def specials(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


class ChunkCache(dict):
    """What ``make`` gives for a chunk, kept for later texts; the number kept is bounded."""

    LIMIT = 600_000

    def __init__(self, make, prefix: str = ""):
        super().__init__()
        self.make, self.prefix = make, prefix

    def __missing__(self, chunk: str):
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[chunk] = self.make(self.prefix + chunk)
        return value


def chunk_runs(text: str):
    """(heads, tails): first chunks, and chunks that follow a space, in order within each run.

    Yields one (first chunk, following chunks, whether a line break follows) for every run of chunks.
    """
    if SPACE_PAIR.search(text):
        head, *tail = INNER_SPACE.split(text)
        yield head, tail, False
        return
    lines = text.split("\n")
    last = len(lines) - 1
    for i, line in enumerate(lines):
        head, *tail = line.split(" ")
        yield head, tail, i < last


class Ids:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, joined from cached chunks."""

    def __init__(self, json_path: str, ranks_path: str):
        self.tokenizer = library(json_path)
        self.special = specials(self.tokenizer)
        encode = fast_encoder(ranks_path).encode_ordinary

        def packed(chunk: str) -> bytes:
            return np.array(encode(chunk), "<u4").tobytes()

        self.heads, self.tails, self.newline = ChunkCache(packed), ChunkCache(packed, " "), packed("\n")

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts: list[bytes] = []
        for head, tail, breaks in chunk_runs(text):
            parts.append(self.heads[head])
            parts += map(self.tails.__getitem__, tail)
            if breaks:
                parts.append(self.newline)
        return b"".join(parts)
