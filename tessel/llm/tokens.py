"""Byte-level BPE ids, equal to those of the tokenizers library, by the quickest exact way."""

from __future__ import annotations

import base64
import functools
import re
import unicodedata

import numpy as np

SPECIAL = "<|endoftext|>"
#: Fixed value: the alternative of the pre-token pattern that looks ahead.
_LOOKAHEAD = r"|\s+(?!\S)"
_TWO_SPACES = re.compile(r"\s\s")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _stable(c: str) -> bool:
    """Whether all Unicode versions class a character alike (letter, number, space, other).

    Stable are letters and numbers that have been so since Unicode 3.2, assigned
    characters that are neither, and the six ASCII spaces, no-break and
    ideographic space; everything from plane 2 on counts as unstable.
    """
    if c >= "\U00020000":
        return False
    now = unicodedata.category(c)
    if now[0] in "LN":
        return unicodedata.ucd_3_2_0.category(c)[0] == now[0]
    return c in " \t\n\x0b\x0c\r\xa0\u3000" or now[0] in "PSM" or c < "\x1c"


#: Characters beyond the basic plane. A class that holds some is compiled to a list of ranges, which is slow to search.
_BEYOND = re.compile("[\U00010000-\U0010ffff]")


@functools.cache
def _unstable() -> re.Pattern:
    """The unstable characters of the basic plane, as a class that is looked up in constant time."""
    runs: list[list[int]] = []
    for code in range(0x10000):
        if not _stable.__wrapped__(chr(code)):
            if runs and runs[-1][1] == code - 1:
                runs[-1][1] = code
            else:
                runs.append([code, code])
    return re.compile("[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs) + "]")


class Ids:
    """Token ids of texts by the vocabulary at json_path, special tokens not added.

    With ranks_path (the same vocabulary as ranks) most texts take a faster
    library; texts with a special token's string or with characters whose class
    depends on the Unicode version go to the tokenizers library itself.
    """

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None) -> None:
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path)
        self.fast = self.plainest = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            # Where no two white-space characters meet, the look-ahead decides nothing, and without it splitting is quicker.
            self.plainest = tiktoken.Encoding("plain ranks", pat_str=pattern.replace(_LOOKAHEAD, ""), mergeable_ranks=ranks, special_tokens={})

    def is_plain(self, text: str) -> bool:
        if SPECIAL in text:
            return False
        if text.isascii():
            return not any(c in text for c in "\x1c\x1d\x1e\x1f\x7f")
        return _unstable().search(text) is None and all(map(_stable, set(_BEYOND.findall(text))))

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and self.is_plain(text):
            return (self.fast if _TWO_SPACES.search(text) else self.plainest).encode_to_numpy(text, disallowed_special=())
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.cache
def ids_for(json_path: str, ranks_path: str | None, pattern: str | None) -> Ids:
    """One loaded vocabulary per worker process."""
    return Ids(json_path, ranks_path, pattern)
