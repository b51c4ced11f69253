"""Exact tokenisation by the tokenizers library, word by word with a memory of words already encoded.

A byte-level or word BPE encodes each pre-token on its own. For texts of characters below U+0300 (where no
normalisation form differs) the split is a plain regular expression, so each distinct pre-token is encoded once by
the library and looked up afterwards. Every other text, every text that may hold an added token (a special one such as
<|endoftext|> included), and every file with other rules, goes whole to the library, whose defaults hold.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np

_SIMPLE = 0x300
#: Pre-tokens remembered by a worker (about 160 MB); beyond that it starts anew.
MEMORY = 800_000


def _kind(prefix: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_SIMPLE) if unicodedata.category(chr(c))[0] == prefix)


_L, _N, _S = _kind("L"), _kind("N"), "\\t-\\r \\x85\\xa0"
_OTHER = f"[^{_S}{_L}{_N}]+"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_BYTE_RULE = f"{_SHORT}| ?[{_L}]+| ?[{_N}]+| ?{_OTHER}|[{_S}]+(?![^{_S}])|[{_S}]+"
_WORD_RULE = f"{_SHORT}|[{_L}]+|[{_N}]|{_OTHER}"
_WORD_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

#: The characters that stand for the 256 bytes in byte-level vocabularies: printable ones for themselves, others from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class Encoder:
    """ids(texts) gives, per text, its ids as little-endian integers of `width` bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.width = 2 if self.vocabulary <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.known: dict[str, bytes] = {}
        self.lower = False
        self.rule = self._rule(path)
        self.odd = re.compile(f"[^\\x00-{chr(_SIMPLE - 1)}]|İ")
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [x.content for x in added if not x.normalized]
        self.added_normal = [x.content.lower() for x in added if x.normalized]
        self.added_begin = {c for x in self.added + self.added_normal for c in (x[0], x[0].upper())}

    def _special(self, text: str) -> bool:
        """Whether the text may hold an added token; most texts lack the characters that these begin with."""
        if not any(c in text for c in self.added_begin):
            return False
        return any(x in text for x in self.added) or (bool(self.added_normal) and any(x in text.lower() for x in self.added_normal))

    def _rule(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm, model = spec["pre_tokenizer"] or {}, spec["normalizer"], spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or spec["post_processor"] or spec["truncation"]:
            return None
        if norm is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            return re.compile(_BYTE_RULE)
        steps = pre.get("pretokenizers", [])
        if norm and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and len(steps) == 2 and steps[0].get("pattern") == {"Regex": _WORD_SPLIT}:
            self.lower = True
            return re.compile(_WORD_RULE)
        return None

    def _simple(self, text: str) -> bool:
        if text.isascii():
            return True
        try:
            text.encode("latin-1")  # far quicker than a search
            return True
        except UnicodeEncodeError:
            return not self.odd.search(text)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens, straight from the library's model: they need no further splitting."""
        tokenize = self.tokenizer.model.tokenize
        return [np.array([t.id for t in tokenize(w.encode().decode("latin-1").translate(_BYTES))], self.kind).tobytes() for w in words]

    def ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        split: list[tuple[int, list[str]]] = []
        whole: list[int] = []
        for i, text in enumerate(texts):
            if self.rule is None or not self._simple(text) or self._special(text):
                whole.append(i)
            else:
                split.append((i, self.rule.findall(text.lower() if self.lower else text)))
        if whole:
            for i, ids in zip(whole, self._whole([texts[i] for i in whole])):
                out[i] = ids
        if len(self.known) > MEMORY:
            self.known = {}
        flat = list(chain.from_iterable(w for _, w in split))
        got = list(map(self.known.get, flat))
        new = list({w for w, ids in zip(flat, got) if ids is None})
        if new:
            self.known.update(zip(new, self._words(new)))
            got = list(map(self.known.__getitem__, flat))
        at = 0
        for i, found in split:
            out[i] = b"".join(got[at : at + len(found)])
            at += len(found)
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    return Encoder(path)
