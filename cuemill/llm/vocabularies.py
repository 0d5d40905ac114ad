"""Public tokenizers inside tasks, with a bounded memory of words already encoded."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from itertools import chain, repeat

import numpy as np

#: Words that one Python worker remembers; beyond it the memory is emptied and fills again.
REMEMBERED = 1_000_000


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; any other path can be given to the operators instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Token ids of words: ``encode`` is asked once for each distinct word, and results lie in flat arrays.

    parts: splits a word in two whose ids one after the other are the word's, or gives None.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], parts: Callable[[bytes], tuple[bytes, bytes] | None] | None = None, most: int = REMEMBERED):
        self.encode, self.parts, self.most = encode, parts, most
        self._empty()

    def _empty(self) -> None:
        self.at: dict[bytes, int] = {}
        self.start, self.size, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        self.flat, self.end = np.zeros(1 << 18, np.int32), 0

    def learn(self, words: set[bytes]) -> None:
        """Makes sure that all of these words are known until the next call."""
        if self.n + 2 * len(words) > self.most:
            self._empty()
        new = [w for w in words if w not in self.at]
        if self.parts:
            split = {w: p for w in new if (p := self.parts(w))}
            single = [w for w in new if w not in split]
            single += {x for p in split.values() for x in p if x not in self.at}.difference(single)
            self._encode(single)
            if split:
                places = self.places([x for p in split.values() for x in p])
                self._store(list(split), self.size[places].reshape(-1, 2).sum(1), self.ids(places))
        else:
            self._encode(new)

    def _encode(self, words: list[bytes]) -> None:
        if words:
            ids = self.encode(words)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self._store(words, sizes, np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())))

    def _store(self, words: list[bytes], sizes: np.ndarray, flat: np.ndarray) -> None:
        while self.n + len(words) > len(self.start):
            self.start, self.size = np.concatenate([self.start, self.start * 0]), np.concatenate([self.size, self.size * 0])
        while self.end + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat * 0])
        self.start[self.n : self.n + len(words)] = self.end + np.cumsum(sizes) - sizes
        self.size[self.n : self.n + len(words)] = sizes
        self.flat[self.end : self.end + len(flat)] = flat
        self.at.update(zip(words, range(self.n, self.n + len(words))))
        self.n, self.end = self.n + len(words), self.end + len(flat)

    def learned(self, words: list[bytes]) -> np.ndarray:
        """Places of words, as they come; only those that aren't known are looked at a second time."""
        places = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        if len(missing := np.flatnonzero(places < 0)):
            new = [words[i] for i in missing.tolist()]
            distinct = set(new)
            if self.n + 2 * len(distinct) > self.most:  # all that is remembered goes
                self.learn(set(words))
                return self.places(words)
            self.learn(distinct)
            places[missing] = self.places(new)
        return places

    def places(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def ids(self, places: np.ndarray) -> np.ndarray:
        """All ids of the words, in order."""
        sizes = self.size[places]
        ends = np.cumsum(sizes)
        if not len(ends):
            return np.zeros(0, np.int32)
        return self.flat[np.repeat(self.start[places] - (ends - sizes), sizes) + np.arange(ends[-1])]


_KEPT: dict = {}


def kept(key, make: Callable, small: bool = False):
    """One of a kind in each Python worker, across the tasks that it runs.

    A worker holds one large thing at a time: workers outlive stages, and what the last stage remembered goes.
    """
    if key not in _KEPT:
        if not small:
            for other in [k for k, (_, is_small) in _KEPT.items() if not is_small]:
                del _KEPT[other]
        _KEPT[key] = (make(), small)
    return _KEPT[key][0]


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lowered(text: bytes) -> bytes:
    """A-Z in lower case, for vocabularies of lower case; texts that may have special tokens stay as they are."""
    return text if b"<|" in text else text.translate(_LOWER)


def _stop_parts(word: bytes) -> tuple[bytes, bytes] | None:
    """Full stops and commas after a-z: no token of a vocabulary whose tokens are all letters or none has both."""
    core = word.rstrip(b".,")
    return (core, word[len(core) :]) if len(core) < len(word) and core and 97 <= core[-1] <= 122 else None


#: Words of Latin letters in lower case, and how many of them are encoded as one text.
_LETTERS, _TOGETHER = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch, 256


def end_marks(tokenizer) -> np.ndarray:
    """Which ids have the vocabulary's mark of a word's end; none if it has no such mark."""
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values()) + 1, bool)
    out[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
    return out


def encoder(tokenizer) -> Callable[[list[bytes]], list[list[int]]]:
    """Ids of words.  Words of letters alone go through the tokenizer many at a time, as a text, whose ids are dealt to them by the marks of their ends."""
    ends = end_marks(tokenizer)

    def alone(words: list[str]) -> list[list[int]]:
        return [x.ids for x in tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def together(words: list[str]) -> list[list[int]]:
        ids = alone([" ".join(words)])[0]
        bounds = [0, *(np.flatnonzero(ends[np.array(ids, np.int64)]) + 1).tolist()]
        if len(bounds) != len(words) + 1 or bounds[-1] != len(ids):  # a word has one end at least; these have more
            return alone(words)
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode(words: list[bytes]) -> list[list[int]]:
        texts = [w.decode("utf-8", "replace") for w in words]
        letters = [i for i, t in enumerate(texts) if _LETTERS(t)] if ends.any() else []
        if not letters:
            return alone(texts)
        joined = [texts[i] for i in letters]
        found = dict(zip(letters, chain.from_iterable(together(joined[at : at + _TOGETHER]) for at in range(0, len(joined), _TOGETHER))))
        others = iter(alone([t for i, t in enumerate(texts) if i not in found]))
        return [found[i] if i in found else next(others) for i in range(len(texts))]

    return encode


def word_ids(path: str) -> WordIds:
    """For vocabularies of lower case that drop white space, so that the ids of a text are those of its words one after the other."""

    def make() -> WordIds:
        return WordIds(encoder(load_tokenizer(path)), _stop_parts)

    return kept(("words", path), make)


def piece_ids(path: str) -> WordIds:
    """Words by a sentencepiece model, each as if it stood alone."""

    def make() -> WordIds:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return WordIds(lambda words: model.encode([w.decode("utf-8", "replace") for w in words], num_threads=1))

    return kept(("pieces", path), make)


def load_ranks(path: str):
    """A vocabulary of ranks, and which of its ids are one byte of a longer character."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    lone = np.zeros(max(ranks.values()) + 1, bool)
    lone[[rank for token, rank in ranks.items() if len(token) == 1 and token[0] >= 0x80]] = True
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lone
