"""Token ids of a published vocabulary whose merges never cross ASCII white space."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np


#: Marks that end a word; after an ASCII letter or digit they are split off before any merge.
END_MARKS = b".,!?;:"
#: A word between words that are encoded together; a control character, which texts hardly hold.
BETWEEN = b"\x01"


class WordEncoder:
    """Encodes texts with the ``tokenizers`` library, each distinct word once.

    The vocabulary splits at white space, and between a letter or digit and a mark, before it
    merges, so the ids of a text are those of its words and end marks in a row. Strings of the
    vocabulary's own tokens (``<|endoftext|>``) become their ids wherever they stand, as the
    library does it; the text between them is encoded on its own. A bounded memo saves most of
    the work: natural text repeats its words. ``memo_bytes`` bounds the memory, not the result.
    """

    def __init__(self, path: str, memo_bytes: int = 200_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True  # they are cut out of the text beforehand
        self._lowers = '"type":"Lowercase"' in self._tokenizer.to_str()
        self.dtype = np.dtype("<u2" if self._tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        added = self._tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("only tokens that stand for their own string are supported")
        self._added = {
            t.content.encode(): np.array([i], self.dtype).tobytes() for i, t in added.items()
        }
        longest_first = sorted(self._added, key=len, reverse=True)
        self._cut = re.compile(b"(%s)" % b"|".join(map(re.escape, longest_first)))
        self._begins = os.path.commonprefix(longest_first)  # the search for it is the faster one
        between = self._tokenizer.encode(BETWEEN.decode(), add_special_tokens=False).ids
        self._between = between[0] if len(between) == 1 else None
        self._memo: dict[bytes, bytes] = {}
        self._memo_bytes, self._held = memo_bytes, 0

    def encode(self, text: bytes | None) -> np.ndarray:
        """Ids of a whole UTF-8 text; none for NULL."""
        text = text or b""
        if not self._added or self._begins not in text or not self._cut.search(text):
            return np.frombuffer(self._ids(text), self.dtype)
        between = self._cut.split(text)
        ids = [self._added[p] if i % 2 else self._ids(p) for i, p in enumerate(between)]
        return np.frombuffer(b"".join(ids), self.dtype)

    def _ids(self, text: bytes) -> bytes:
        words = (text.lower() if self._lowers else text).split()  # both for ASCII only
        memo = self._memo
        if self._held > self._memo_bytes:
            memo.clear()
            self._held = 0
        new = set(words).difference(memo)
        if new:
            self._learn(new)
        return b"".join(map(memo.__getitem__, words))

    def _learn(self, words: set[bytes]) -> None:
        memo, held = self._memo, 0
        marked = {w: parts for w in words if len(parts := self._parts(w)) > 1}
        unknown = list(
            words.difference(marked).union(chain.from_iterable(marked.values())).difference(memo)
        )
        for part, ids in zip(unknown, self._encoded(unknown), strict=True):
            memo[part] = ids
            held += len(part)
        for word, (stem, mark) in marked.items():
            memo[word] = memo[stem] + memo[mark]
            held += len(word)
        # The ids of a word take no more room than its bytes, two objects and a place in the table.
        self._held += 2 * held + 150 * (len(unknown) + len(marked))

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word.

        They are encoded as one text, since a call costs as much as a word, with a word between
        them that none of them can hold; its id tells where a word ends.
        """
        if self._between is not None and not any(BETWEEN in w for w in words):
            text = (b" %s " % BETWEEN).join(words).decode()
            (found,) = self._tokenizer.encode_batch_fast([text], add_special_tokens=False)
            ids = np.array(found.ids, self.dtype)
            ends = np.flatnonzero(ids == self._between)
            if len(ends) == len(words) - 1:  # else a word has that id too
                size, ids = self.dtype.itemsize, ids.tobytes()
                starts = [0, *((ends + 1) * size).tolist()]
                return [ids[i:j] for i, j in zip(starts, [*(ends * size).tolist(), len(ids)])]
        found = self._tokenizer.encode_batch_fast(
            [w.decode() for w in words], add_special_tokens=False
        )
        return [array(self._code, encoding.ids).tobytes() for encoding in found]

    @staticmethod
    def _parts(word: bytes) -> tuple[bytes, ...]:
        stem = word.rstrip(END_MARKS)
        if stem == word or not stem[-1:].isalnum():  # ASCII only
            return (word,)
        return stem, word[len(stem) :]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker process."""
    return WordEncoder(path)
