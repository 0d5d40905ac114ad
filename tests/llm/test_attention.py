"""The attention's three steps and chunks, and words that are encoded together."""

import numpy as np
import pytest

from cuemill.llm import attention
from cuemill.llm.vocabularies import encoder, load_tokenizer, vocabulary

TOKENS = attention.CLASSES * attention.SLOTS


def blocks(sizes, kinds):
    rng = np.random.default_rng(4)
    return attention.blocks_of([rng.integers(0, TOKENS, n).astype(np.int32) for n in sizes], kinds, 49)


def test_outputs_are_a_distribution_over_all_tokens():
    """Whatever was before, the probabilities of all tokens sum to 1; under biases alone they are the counts' shares."""
    rng = np.random.default_rng(1)
    kinds, counts = rng.integers(0, 49, TOKENS).astype(np.int32), rng.random(TOKENS) + 0.01
    params = attention.init(50)
    before = rng.integers(0, TOKENS, 20).astype(np.int32)
    inputs, targets, first, used = attention.blocks_of([np.append(before, np.int32(t)) for t in range(TOKENS)], kinds, 49)
    last = np.cumsum(used.ravel())[used.ravel()] % 21 == 0
    assert abs(np.exp(attention.log_probabilities(params, inputs, targets, first)[used][last].astype(np.float64)).sum() - 1) < 1e-4
    bare = params | {k: np.zeros_like(params[k]) for k in ("out", "middle", "slot")} | attention.biases(counts)
    assert np.allclose(attention.log_probabilities(bare, inputs, targets, first)[used][last], np.log(counts / counts.sum()), atol=1e-4)


def test_results_do_not_hang_on_chunks_or_arrays_used_before(monkeypatch):
    kinds = np.random.default_rng(2).integers(0, 49, TOKENS).astype(np.int32)
    params, work, got = attention.init(50), attention.Work(), []
    for near in (256, 3, 1):
        monkeypatch.setattr(attention, "_NEAR", near)
        for sizes in ((100, 1, 37), (5,), (100, 1, 37), (16, 300)):
            x = blocks(sizes, kinds)
            loss, gradient = attention.loss_and_gradient(params, *x, work)
            got.append((sizes, loss, np.concatenate([g.ravel() for g in gradient.values()]), attention.log_probabilities(params, *x[:3], None, work)[x[3]]))
    for sizes, *found in got:
        for a, b in zip(next(x[1:] for x in got if x[0] == sizes), found):
            assert np.allclose(a, b, rtol=1e-4, atol=1e-5)


@pytest.mark.parametrize("together", [1, 3, 256])
def test_words_of_letters_are_encoded_together_and_alike(monkeypatch, together):
    from cuemill.llm import vocabularies

    class Counted:
        def __init__(self, inner):
            self.inner, self.texts = inner, 0

        def get_vocab(self, **options):
            return self.inner.get_vocab(**options)

        def encode_batch_fast(self, texts, **options):
            self.texts += len(texts)
            return self.inner.encode_batch_fast(texts, **options)

    monkeypatch.setattr(vocabularies, "_TOGETHER", together)
    tokenizer = load_tokenizer(vocabulary("word_bpe_49k.json"))
    odd = ["don't", "'s", "s", "x1y2", "<|endoftext|>", "áb", "á", "K", "İx", "straße", "É", "×", "--", "​", "你好", "one.", "", "|"]
    words = [w.encode() for w in [*odd, *(f"{a}{b}tion" for a in "abcdefgh" for b in ("", "re", "é", "'")), *odd, "lo" * 300]]
    counted = Counted(tokenizer)
    assert encoder(counted)(words) == [tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in words]
    letters = sum(bool(vocabularies._LETTERS(w.decode())) for w in words)
    assert letters > 28 and counted.texts == len(words) - letters + -(-letters // together)
    assert encoder(counted)([]) == [] and encoder(counted)([b"\xff\xfe"]) == [tokenizer.encode("��", add_special_tokens=False).ids]


def test_a_vocabulary_that_cuts_runs_of_letters_is_asked_word_by_word():
    class Cuts:
        """Each letter is a word of its own, with the mark of a word's end."""

        def get_vocab(self, **options):
            return {f"{chr(97 + i)}</w>": i for i in range(26)}

        def encode_batch_fast(self, texts, **options):
            return [type("Encoding", (), {"ids": [ord(c) - 97 for c in t if c != " "]}) for t in texts]

    assert encoder(Cuts())([b"ab", b"c", b"abc"]) == [[0, 1], [2], [0, 1, 2]]
