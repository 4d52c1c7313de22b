"""Whole texts to token ids by the tokenizers library: each distinct word is encoded once in a Python worker.

The library itself cuts a text into words before its BPE, and encodes each word by itself, so the ids of a text are its
words' ids in order; encoding words that a worker has met before anew is what makes the library slow on a corpus.
"""

from __future__ import annotations

import json
import os

import numpy as np

from quartzite.llm.common import stage_state
from quartzite.llm.words import words

#: Words kept with their ids in a Python worker; when full, the store starts anew.
KNOWN_WORDS = 800_000


class LibraryEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import re

        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*spec["model"]["vocab"].values(), *self.special.values()]) + 1
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        # words come normalised and cut; what is left to the library is the step to byte letters, and the BPE
        steps = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "ByteLevel"]
        self.library = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": steps[0]}))
        self.kind = np.dtype("<u2" if self.size < 1 << 16 else "<u4")
        self.ids: dict[str, bytes] = {}

    def pieces(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.cut is None or not self.cut.search(text):
            return words(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*words(text[at : m.start()]), m[0]]
            at = m.end()
        return out + words(text[at:])

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids, packed as self.kind."""
        if len(self.ids) > KNOWN_WORDS:
            self.ids.clear()
        for s, i in self.special.items():
            self.ids[s] = np.array([i], self.kind).tobytes()
        cut = [self.pieces(t) for t in texts]
        new = [*set().union(*cut).difference(self.ids)]
        for k in range(0, len(new), 10_000):
            part = new[k : k + 10_000]
            for w, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.ids[w] = np.array(e.ids, self.kind).tobytes()
        return [b"".join(map(self.ids.__getitem__, c)) for c in cut]


def library_encoder(path: str) -> LibraryEncoder:
    return stage_state(("library_encoder", path), lambda: LibraryEncoder(path))
