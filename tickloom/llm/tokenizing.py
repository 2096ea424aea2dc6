"""Byte-pair encoding of single words with the public vocabularies, and of whole texts by chunks.

A vocabulary file lists its pieces in the order of their merges, so a piece's id is also its merge
rank, and tiktoken's merge loop gives the ids that the tokenizers library gives, word by word. A
vocabulary with an end-of-word mark gets the byte 0xFF for the mark, which UTF-8 never uses.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import regex

from tickloom.llm.common import text_of

#: Characters that Python's str.split() takes for white space and the tokenizers' patterns do not.
ODD_BLANKS = re.compile("[\x1c-\x1f]")
#: Visible characters below U+0250: normal form C leaves them, and lower() works on each alone.
PLAIN = re.compile("[\x21-\x7e\xa1-\xac\xae-ɏ]+\\Z")
#: The word pattern of the word vocabulary's own pre-tokenizer.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
MARK = b"\xff"


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: visible Latin-1 for itself, others from U+0100."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(others)}


def read_pieces(path: str) -> tuple[dict[bytes, int], dict[str, int], str]:
    """A vocabulary's pieces by bytes, its added tokens, and its end-of-word suffix."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    suffix = spec["model"].get("end_of_word_suffix") or ""
    of = byte_characters()
    pieces = {}
    for token, i in spec["model"]["vocab"].items():
        last = bool(suffix) and token.endswith(suffix)
        body = token[: -len(suffix)] if last else token
        pieces[bytes(of[c] for c in body) + (MARK if last else b"")] = i
    return pieces, {t["content"]: t["id"] for t in spec["added_tokens"]}, suffix


class PieceEncoder:
    """Ids of single words, without splitting them first."""

    def __init__(self, path: str):
        import tiktoken

        ranks, self.added, suffix = read_pieces(path)
        self.end = MARK if suffix else b""
        self._encode = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def ids(self, word: str) -> list[int]:
        return self._encode(word.encode() + self.end)


class WordTokenizer:
    """A tokenizer that drops white space, so that chunks between white space are independent.

    Ids of chunks are kept in two tables of bounded size for the time of a task:
    a full table becomes the older one, from which chunks that recur move back. Chunks outside the plain Latin range go through the tokenizers library.
    """

    LIMIT = 150_000
    _shared: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.pieces = PieceEncoder(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def shared(cls, path: str) -> WordTokenizer:
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    @classmethod
    def forget(cls) -> None:
        """Empties the tables of all shared tokenizers; their vocabularies stay."""
        for tokenizer in cls._shared.values():
            tokenizer.known, tokenizer.older = {}, {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if "<|" in chunk or not PLAIN.match(chunk):
            return self._whole(chunk)
        ids: list[int] = []
        for word in WORDS.findall(chunk.lower()):
            ids += self.pieces.ids(word)
        return array("I", ids).tobytes()

    def encode_bytes(self, body: bytes) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        text = text_of(body)
        if ODD_BLANKS.search(text):
            return self._whole(text)
        chunks = text.split()
        known = self.known
        if len(known) > self.LIMIT:
            self.older, self.known = known, {}
            known = self.known
        for c in set(chunks).difference(known):
            known[c] = self.older.get(c) or self._chunk(c)
        return b"".join(map(known.__getitem__, chunks))
