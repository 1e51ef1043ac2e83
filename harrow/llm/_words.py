"""Token ids put together from those of short stretches of text, each encoded once."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Stretches that a worker remembers: the first met, among which the frequent ones are. Longer ones than
#: KNOWN_CHARS, and those met when there is no more room, are encoded for each block of texts.
KNOWN, KNOWN_CHARS = 400_000, 48
#: White space for str.split() alone, not for a tokenizer.
SEPARATORS = re.compile("[\x1c-\x1f]")


class KnownIds(dict):
    """Stretch of text to its ids as little-endian 32-bit numbers."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.block: dict[str, bytes] = {}

    def encode(self, stretches: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(stretches, add_special_tokens=False)]

    def __missing__(self, stretch: str) -> bytes:
        return self.block[stretch]

    def learn(self, split: list[list[str]]) -> list[list[str]]:
        """Make the stretches of a block of texts known."""
        new = list({x for stretches in split for x in stretches if x not in self})
        self.block = dict(zip(new, self.encode(new), strict=True))
        room = KNOWN - len(self)
        if room > 0:
            short = [x for x in new if len(x) <= KNOWN_CHARS][:room]
            self.update((x, self.block[x]) for x in short)
        return split


class KnownWords(KnownIds):
    """Words of a tokenizer that lowers case and splits letters from punctuation; plain words go straight to its model."""

    def encode(self, words: list[str]) -> list[bytes]:
        model, out, rest = self.tokenizer.model, [b""] * len(words), []
        for i, word in enumerate(words):
            low = word.lower()
            if low.isascii() and low.isalpha():
                out[i] = np.array([x.id for x in model.tokenize(low)], "<u4").tobytes()
            else:
                rest.append(i)
        for i, ids in zip(rest, super().encode([words[i] for i in rest]), strict=True):
            out[i] = ids
        return out


class WordIds:
    """Ids by a tokenizer file that drops white space and never looks beyond it."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.known = KnownWords(Tokenizer.from_file(path))

    def plain(self, texts: list[str]) -> list[bytes]:
        return KnownIds.encode(self.known, texts)

    def of(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        odd = [bool(SEPARATORS.search(text)) for text in texts]
        split = [[] if o else text.split() for o, text in zip(odd, texts, strict=True)]
        for o, text, words in zip(odd, texts, self.known.learn(split), strict=True):
            yield self.plain([text])[0] if o else b"".join(map(self.known.__getitem__, words))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One memory of words for each Python worker."""
    return WordIds(path)
