"""Token ids of whole texts with a public tokenizer file, an end id after each.

The tokenizer drops white space, so a text's ids are those of its words in
turn: a worker encodes a word when it meets it first (``held_ids``) and the
rest is array work.
"""

from __future__ import annotations

import os
import string

import numpy as np
import pyarrow as pa

from quillmere.llm.held_ids import HeldIds
from quillmere.llm.words import once, split_words

END = 1  # id appended to each document
JOINT_WORDS = 512  # words sent in one text
PIECE_BYTES = 4 << 20  # of texts encoded at once
_PUNCTUATION = string.punctuation.replace("'", "")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of words; for tokenizers that drop white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.size = max(vocab.values()) + 1
        self.closing = np.zeros(self.size, bool)  # tokens that end a run of letters or of signs
        self.closing[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.held = HeldIds(self._encoded)

    def _encoded(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words with their ids.  Words of letters, or letters and then
        signs, are sent many in one text, and parted where a run of either ends."""
        joint, runs, rest = [], [], []
        for w in words:
            core = w.rstrip(_PUNCTUATION)
            if core.isalpha():
                joint.append(w)
                runs.append(1 + (len(core) < len(w)))
            else:
                rest.append(w)
        order, ids, sizes = [], [], []
        texts = [" ".join(joint[at : at + JOINT_WORDS]) for at in range(0, len(joint), JOINT_WORDS)]
        for at, found in zip(range(0, len(joint), JOINT_WORDS), self._batch(texts)):
            some, last = joint[at : at + JOINT_WORDS], np.cumsum(runs[at : at + JOINT_WORDS])
            ends = np.flatnonzero(self.closing[found]) + 1
            if len(ends) == last[-1]:
                order += some
                ids.append(found)
                sizes.append(np.diff(ends[last - 1], prepend=0))
            else:  # some sign joins or splits in an unusual way
                rest += some
        alone = self._batch(rest)
        order += rest
        return order, np.concatenate([*ids, *alone]), np.concatenate([*sizes, np.fromiter(map(len, alone), np.int64, len(alone))])

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(e.ids, np.uint32) for e in found]

    def encode(self, texts: pa.Array, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin."""
        words = split_words(texts)
        first, count = self.held.spans(words.distinct)
        sizes = count[words.codes]
        before = np.concatenate(([0], np.cumsum(sizes)))
        starts = before[words.starts] + np.arange(len(words.starts))
        ids = np.full(starts[-1], end, np.uint32)
        here = np.repeat(first[words.codes] - before[:-1], sizes) + np.arange(before[-1])
        inner = np.ones(len(ids), bool)
        inner[starts[1:] - 1] = False
        ids[inner] = self.held.flat[here]
        return ids, starts


def word_ids(path: str) -> WordIds:
    return once(f"word_ids {path}", lambda: WordIds(path))
