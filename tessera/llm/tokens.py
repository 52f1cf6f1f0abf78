"""Token ids of whole texts by the public ``word_bpe_49k.json`` vocabulary, cached by word.

The vocabulary lower-cases, drops white space and never merges across it, so a text's ids are those of
its white-space separated words one after another. A word of ASCII and Latin letters is cut by the
vocabulary's own pattern and merged by the byte-pair merges in tiktoken; every other word goes to
``tokenizers`` itself. Both give the ids of ``tokenizers`` (a test holds them against each other)."""

from __future__ import annotations

import json
import os

import numpy as np

#: Words kept between batches of one task; beyond it the cache starts anew (only speed changes).
CACHE_WORDS = 1_000_000
_SIMPLE = r"[\x21-\x7e\xa1-įı-ɏ]+"


class WordTokenizer:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}

        def raw(token: str) -> bytes:
            end = token.endswith("</w>")
            return bytes(chars[c] for c in (token[:-4] if end else token)) + b"\xff" * end

        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 255]): 256 + b for b in range(255)}
        for i, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            ranks.setdefault(raw(a + b), 1000 + i)
        self.id_bytes = {ranks[raw(s)]: i.to_bytes(4, "little") for s, i in model["vocab"].items() if not s.startswith("<|") and raw(s) in ranks}
        self.merge = tiktoken.Encoding("words", pat_str=r"[^\n]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.simple = regex.compile(_SIMPLE).fullmatch
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.words: dict[str, bytes] = {"": b""}

    def _piece(self, piece: str) -> bytes:
        found = self.words.get(piece)  # the pattern cuts a piece into itself, so a piece is a word too
        if found is None:
            found = self.words[piece] = b"".join(map(self.id_bytes.__getitem__, self.merge(piece.encode() + b"\xff")))
        return found

    def forget(self) -> None:
        """Drop the cached words, so that a worker kept for later stages does not hold them."""
        self.words = {"": b""}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null and empty: none."""
        split = [(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if len(self.words) > CACHE_WORDS:
            self.forget()
        words, odd = self.words, []
        for w in set().union(*split) - words.keys():
            if self.simple(w):
                low = w.lower()
                end = low[-1]
                if low.isalpha():
                    words[w] = self._piece(low)
                elif end in ".,?!" and low[:-1].isalpha():
                    words[w] = self._piece(low[:-1]) + self._piece(end)
                else:
                    words[w] = b"".join([self._piece(p) for p in self.cut(low)])
            else:
                odd.append(w)
        for i in range(0, len(odd), 10_000):
            for w, e in zip(part := odd[i : i + 10_000], self.whole.encode_batch_fast(part, add_special_tokens=False), strict=True):
                words[w] = np.array(e.ids, "<u4").tobytes()
        get = words.__getitem__
        return [b"".join(map(get, w)) for w in split]


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]
