"""Byte-level BPE ids of whole texts inside tasks, with a bounded memo of words.

Ids are 32 bits and in the byte order of the machine, which is little-endian on every platform that Spark's native parts support.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

#: Words kept in each of the two generations of a worker's memo; about 250 bytes each.
MEMO_WORDS = 300_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(others)}}


class _NotAlone(Exception):
    """A word that cannot be encoded apart from its neighbours."""


class _Memo(dict):
    """Word to ids, filled on demand. When a generation is full it becomes the old one, from which words in use come back."""

    def __init__(self, encode, room: int):
        super().__init__()
        self.encode, self.room, self.old = encode, room, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word, self)
        if len(self) >= self.room:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class WordEncoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit bytes, the same as encoding the text whole.

    The pre-tokenizer never looks across a single space between two words that neither start nor end with white space,
    so such words can be encoded one by one and remembered. Other texts are encoded whole.
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        letters = _byte_letters()
        self.letters = str.maketrans({chr(b): c for b, c in letters.items()})
        self.space = letters[32]
        self.first = _Memo(lambda word, memo: self._word(word, "", "", memo), max(1, memo_words // 8))
        self.after = _Memo(lambda word, memo: self._word(word, " ", self.space, memo), memo_words)
        self.newline = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str, lead: str, mapped_lead: str, memo: _Memo) -> bytes:
        if word.isalpha():
            # one run of letters, perhaps after a space, is one pre-token: the model alone decides
            mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            return array("I", [t.id for t in self.tokenize(mapped_lead + mapped)]).tobytes()
        if not word or word[0].isspace() or word[-1].isspace():
            raise _NotAlone
        core, tail = word[:-1], word[-1]
        if tail in ",.;:!?" and core.isalpha():
            return memo[core] + self.first[tail]
        return self._whole(lead + word)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        first, after, lines = self.first, self.after, []
        try:
            for line in text.split("\n"):
                words = line.split(" ")
                head = first[words[0]]
                del words[0]
                lines.append(head + b"".join([after[w] for w in words]))
        except _NotAlone:
            return self._whole(text)
        return self.newline.join(lines)


@lru_cache(maxsize=1)
def encoder(path: str, memo_words: int = MEMO_WORDS) -> WordEncoder:
    """One per Python worker."""
    return WordEncoder(path, memo_words)
