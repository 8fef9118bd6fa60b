"""Exact, memoised encoding of texts with the ``tokenizers`` library.

The pre-tokenisers of the supported files never join characters across
certain gaps between words, so a text's ids are the joined ids of its pieces
between such gaps. Pieces and the pre-tokens within them are kept once they
have been through the library's model; a text whose gaps aren't plain (runs
of white space, strings of special tokens, an unknown pre-tokeniser) is
encoded whole by the library.
"""

from __future__ import annotations

import json
import re
from array import array

_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: A word of Latin letters, then marks: two pre-tokens in both supported files.
_PLAIN = re.compile(rf"( ?[{_LETTER}]+|)([!-&(-/:-@\[-`{{-~]*)")
#: White space but the space and the line feed, and what some libraries take for it.
_OTHER_SPACE = "\0\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_PAIRS = ("  ", "\n\n", " \n", "\n ")
_RUN = re.compile(r"[ \n]{3}|[ \n]{2}\Z")


class _Pieces(dict):
    """Ids by piece, made when first asked for.

    Words are kept until there are ``most``, then all go; of words with marks
    after them only the first ``marked`` are kept, as their parts are.
    """

    def __init__(self, token, other, most: int, marked: int = 100_000):
        self.token, self.other, self.most, self.marked = token, other, most, marked

    def __missing__(self, piece: str) -> bytes:
        m = _PLAIN.fullmatch(piece)
        if m and m[2] and m[1]:
            got = self[m[1]] + self[m[2]]
            if self.marked <= 0:
                return got
            self.marked -= 1
        else:
            got = self.token(piece) if m else self.other(piece)
        if len(self) >= self.most:
            self.clear()
        self[piece] = got
        return got


class Encoder:
    """Text to the little-endian unsigned 32-bit ids of ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            plan = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces = _Pieces(self._plain_token, self._piece, most)
        self.special = [x["content"] for x in plan.get("added_tokens", [])]
        pre = plan.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [pre])
        normal = [x.get("type") for x in (plan.get("normalizer") or {}).get("normalizers", [])]
        self.kind = "whole"
        if plan.get("normalizer") is None and all(pre.get(k) == v for k, v in _BYTE_LEVEL.items()):
            self.kind = "spaces kept"
        elif [x.get("type") for x in steps] == ["Split", "ByteLevel"] and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and normal == ["NFC", "Replace", "Lowercase"]:
            self.kind = "spaces dropped"
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(256)}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _token(self, token: str) -> bytes:
        """Ids of one pre-token in the byte-level alphabet."""
        return array("I", [x.id for x in self.model.tokenize(token)]).tobytes()

    def _plain_token(self, token: str) -> bytes:
        return self._token((token if self.kind == "spaces kept" else token.lower()).translate(self.shown))

    def _piece(self, piece: str) -> bytes:
        t = self.tokenizer
        plain = piece if t.normalizer is None else t.normalizer.normalize_str(piece)
        return b"".join([self._token(x) for x, _ in t.pre_tokenizer.pre_tokenize_str(plain)])

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.kind == "whole" or any(s in text for s in self.special):
            return self._whole(text)
        if any(c in text for c in _OTHER_SPACE):
            return self._whole(text)
        if self.kind == "spaces dropped":
            pieces = text.split()
        elif any(p in text for p in _PAIRS) and _RUN.search(text):
            return self._whole(text)
        else:
            pieces = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        return b"".join([*map(self.pieces.__getitem__, pieces)])


_KEPT: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per file and Python worker."""
    if path not in _KEPT:
        _KEPT[path] = Encoder(path)
    return _KEPT[path]
