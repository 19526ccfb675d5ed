"""Token ids of a public tokenizer file, word by word with a bounded memory of words seen."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Words that a worker remembers before it starts afresh.
WORDS_KEPT = 700_000
#: Id that ends each document.
END = 1
#: Letters and numbers below U+0250.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
_PIECES = re.compile(rf"[{_L}]+|[{_N}]|'s|'t|'re|'ve|'m|'ll|'d|[^\s{_L}{_N}]+|\n")
#: Words of these letters need no normalization.
_PLAIN = re.compile("[\x01-\u024f]+").fullmatch
#: Characters that Python, but not the tokenizer, takes for white space, and what starts a special token.
_UNSAFE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")


class WordEncoder:
    """Ids of `word_bpe_49k.json`, equal to Tokenizer.encode(text, add_special_tokens=False).ids.

    That tokenizer drops white space and never joins characters over it, so a text's ids are its words' ids in a row.
    Words of Latin letters go through a merge table of the same ranks; others, and texts with unusual control characters
    or special-token marks, through the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab, merges = model["vocab"], model["merges"]
        to_byte = _byte_of_char()

        def raw(token: str) -> bytes:
            body, end = (token[:-4], b"\x00") if token.endswith("</w>") else (token, b"")
            return bytes(to_byte[c] for c in body) + end

        # A word's end is a byte 0; it joins the letter before it first, as its rank is the lowest.
        ranks = {raw(t): i for t, i in vocab.items() if not re.fullmatch(r"<\|\w+\|>", t)}
        order = [m if isinstance(m, list) else m.split(" ") for m in merges]
        byte_ids = {raw(t): i for t, i in vocab.items() if len(t.removesuffix("</w>")) == 1}
        single = [b for b in byte_ids if len(b) == 1]
        ended = [b for b in byte_ids if len(b) == 2]
        self.rank_to_id: list[int] = []
        table: dict[bytes, int] = {}
        for b in [b"\x00", *(x for x in single if x != b"\x00"), *ended, *(raw(x) + raw(y) for x, y in order)]:
            if b not in table:
                table[b] = len(table)
                self.rank_to_id.append(ranks.get(b, 0))
        self.ids = np.array(self.rank_to_id, "<u2")
        self.fast = tiktoken.Encoding("words", pat_str=r"[^\x00]*\x00", mergeable_ranks=table, special_tokens={})
        self.line = vocab["Ċ</w>"]
        self.seen: dict[str, bytes] = {}

    def slow(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def learn(self, words: set[str]) -> None:
        """Remember the ids of new words, all in one call of the merge table."""
        plain = []
        for w in words:
            if _PLAIN(w):
                plain.append(w)
            else:
                self.seen[w] = self.slow(w)
        if plain:
            pieces = _PIECES.findall("\n".join(plain).lower())
            ids = self.ids[self.fast.encode_ordinary("\x00".join(pieces) + "\x00")]
            line = np.flatnonzero(ids == self.line)
            data = ids.tobytes()
            self.seen.update(zip(plain, map(data.__getitem__, map(slice, [0, *(2 * line + 2).tolist()], [*(2 * line).tolist(), len(data)]))))

    def encode_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text as unsigned 16-bit integers, without the end id."""
        get = self.seen.get
        for i in range(0, len(texts), 64):
            block = [(t or "").split() if not t or not any(c in t for c in _UNSAFE) else [] for t in texts[i : i + 64]]
            words = list(chain.from_iterable(block))
            if len(self.seen) > WORDS_KEPT:
                self.seen.clear()
            ids = list(map(get, words))
            new = [k for k, v in enumerate(ids) if v is None]
            if new:
                self.learn({words[k] for k in new})
                for k in new:
                    ids[k] = get(words[k])
            end = 0
            for t, own in zip(texts[i : i + 64], block):
                begin, end = end, end + len(own)
                yield np.frombuffer(b"".join(ids[begin:end]) if own or not t else self.slow(t), "<u2")

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_all([text]))


def _byte_of_char() -> dict[str, int]:
    """The byte that each printable stand-in character of byte-level BPE means."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
