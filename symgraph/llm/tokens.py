"""Token ids of whole texts, by a tokenizer file of the `tokenizers` library.

Plain Latin text goes through `tiktoken`, built from the same file's vocabulary, which is several times as fast; all
other text goes through `tokenizers`, and so do whole texts that spell out an added token, which gets its own id. A text that has both is cut where the tokenizer's own splitting is sure to cut, at a single
space or line break between two plain characters. The ids are those of `tokenizers` on the whole text.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import cached_property, lru_cache
from itertools import groupby

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Characters after and before which a single space or line break is certainly a boundary: no white space, no controls.
PLAIN = r"!-~¡-ᙿ"
_BREAK = re.compile(rf"(?<=[{PLAIN}])(?=[ \n][{PLAIN}])")
_LATIN = re.compile(r"[\n !-~À-ɏ]*")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        self.fast = _same_vocabulary(form)
        added = form.get("added_tokens", [])
        self.special = re.compile("|".join(re.escape(t["content"]) for t in added) or r"(?!)")
        self.size = max([*form["model"]["vocab"].values(), *(t["id"] for t in added)]) + 1
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.size <= 1 << 16 else "I"  # two and four bytes, low byte first on the machines that Spark runs on

    @cached_property
    def slow(self) -> Tokenizer:
        """Loaded only where a text needs it."""
        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        """The ids of a text, `dtype` each."""
        if not self.fast or self.special.search(text):
            return self._slowly(text)
        if _LATIN.fullmatch(text):
            return array(self.code, self.fast.encode_ordinary(text)).tobytes()
        parts = groupby(_BREAK.split(text), lambda p: bool(_LATIN.fullmatch(p)))
        return b"".join(array(self.code, self.fast.encode_ordinary("".join(p))).tobytes() if plain else self._slowly("".join(p)) for plain, p in parts)

    def _slowly(self, text: str) -> bytes:
        return array(self.code, self.slow.encode(text, add_special_tokens=False).ids).tobytes()


def _same_vocabulary(form: dict) -> tiktoken.Encoding | None:
    """The file's vocabulary for `tiktoken`, if it is a byte-level one whose ids are its merges' ranks."""
    pre = form.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not form.get("normalizer")
    if not plain:
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"] for t in form.get("added_tokens", [])}
    vocab = {t: i for t, i in form["model"]["vocab"].items() if t not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in form["model"]["merges"]]
    if [vocab.get("".join(m)) for m in merges] != list(range(256, 256 + len(merges))):
        return None
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
