"""Quality rules: what public vocabularies say of a text's words.

A vocabulary that was made from ordinary prose cuts ordinary words into few tokens.  Two are asked: one
of pieces with byte fallback, and one of bytes made from many languages.  Of each
text and vocabulary: characters per token, share of tokens that are bare bytes (byte fallback), and entropy of its
tokens.  Bands for the script of a text say which values are rejected.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import documents, id_and_text, map_texts
from .vocabularies import WordIds, kept, load_ranks, vocabulary

_SPACE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"


class Band(NamedTuple):
    """Values outside are rejected; entropy (bits) counts for texts of at least ``entropy_tokens`` tokens."""

    least_chars: float
    most_chars: float
    most_fallback: float
    least_entropy: float
    entropy_tokens: int = 100


#: By script: bands of the pieces, and of the ranks of many languages.  Scripts that a vocabulary hardly covers fall
#: back to bytes by nature: their bands are wide.  Latin: of documents that labels call good (3,243 of 50 words or more
#: in sf0.1) the ranks give 1.81 to 2.47 characters a token.  The others hold prose of those scripts; ``none`` is text without a letter.
BANDS = {
    "latin": (Band(1.5, 8.0, 0.10, 4.0), Band(1.7, 8.0, 0.10, 4.0)),
    "cyrillic": (Band(1.0, 8.0, 0.30, 4.0), Band(1.2, 8.0, 0.20, 4.0)),
    "greek": (Band(0.5, 8.0, 0.60, 4.0), Band(0.8, 8.0, 0.30, 4.0)),
    "arabic": (Band(0.5, 8.0, 0.30, 4.0), Band(0.7, 8.0, 0.30, 4.0)),
    "cjk": (Band(0.3, 6.0, 0.60, 4.0), Band(0.4, 6.0, 0.50, 4.0)),
    "other": (Band(0.2, 10.0, 0.90, 3.0), Band(0.3, 10.0, 0.80, 3.0)),
    "none": (Band(0.4, 6.0, 0.50, 2.0), Band(0.4, 6.0, 0.50, 2.0)),
}
#: Ids of the second vocabulary stand above those of the first one.
_SECOND = 1 << 24
#: Code points that begin and end scripts.
_SCRIPTS = (("latin", ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF))), ("cyrillic", ((0x400, 0x52F),)), ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))), ("arabic", ((0x600, 0x6FF), (0x750, 0x77F))), ("cjk", ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF))))


def script_of(text: str) -> str:
    """The script that most letters are of; other if no known script has any, none if there is no letter."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "none"
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    counts = {name: sum(int(((points >= a) & (points <= b)).sum()) for a, b in ranges) for name, ranges in _SCRIPTS}
    counts["other"] = int((points > 0x24F).sum()) - sum(n for k, n in counts.items() if k != "latin")
    best = max(counts, key=lambda k: counts[k])
    if best != "other" and counts[best] > 0:
        return best
    return "other" if any(map(str.isalpha, text)) else "none"


def repeated_words(places: np.ndarray) -> int:
    """Words in windows of three that come twice or more."""
    n = len(places)
    if n < 4:
        return 0
    _, local = np.unique(places, return_inverse=True)
    _, pairs = np.unique(local[:-2].astype(np.int64) * n + local[1:-1], return_inverse=True)  # so that codes stay below n * n
    codes = pairs.astype(np.int64) * n + local[2:]
    order = np.argsort(codes, kind="stable")
    same = codes[order][1:] == codes[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(codes), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    marked = np.zeros(n, bool)
    marked[:-2] |= again
    marked[1:-1] |= again
    marked[2:] |= again
    return int(marked.sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    return len(lines) - len(set(lines))


def measures(ids: np.ndarray, chars: int, is_byte: np.ndarray) -> tuple[float, float, float]:
    """Characters per token, share of bytes, entropy in bits."""
    _, counts = np.unique(ids, return_counts=True)
    share = counts / len(ids)
    return chars / len(ids), float(is_byte[ids].mean()), float(-(share * np.log2(share)).sum())


def outside(found: tuple[float, float, float], n_tokens: int, band: Band) -> str | None:
    """The first measure outside the band."""
    per_token, fallback, entropy = found
    if not band.least_chars <= per_token <= band.most_chars:
        return "chars_per_token"
    if fallback > band.most_fallback:
        return "fallback_share"
    return "token_entropy" if n_tokens >= band.entropy_tokens and entropy < band.least_entropy else None


def quality_rules(docs: DataFrame, model_path: str, ranks_path: str, bands: dict[str, tuple[Band, Band]] = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``, no shuffle: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, script, chars_per_token, fallback_share, token_entropy (by the
    pieces of ``model_path``), the same three with ``_ranks`` (by ``ranks_path``), and reason (the first measure outside
    its band, else null).

    Null text: as empty; no words, so base_failed, script none, and the six measures are null.  Null ids stay null;
    repeated rows stay repeated; an empty table gives an empty table; other columns are ignored.
    """
    three = ("chars_per_token", "fallback_share", "token_entropy")
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, script string, " + ", ".join(f"{x}{end} double" for end in ("", "_ranks") for x in three) + ", reason string"

    def vocabularies():
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ranks, lone = load_ranks(ranks_path)

        def encode(words: list[bytes]) -> list[list[int]]:
            plain = [w.decode("utf-8", "replace") for w in words]
            return [a + [x + _SECOND for x in ranks.encode_ordinary(f" {w}")] for a, w in zip(model.encode(plain, num_threads=1), plain)]

        return WordIds(encode), np.array([model.is_byte(i) for i in range(model.get_piece_size())]), lone

    def make():
        known, is_byte, lone = kept(("fertility", model_path, ranks_path), vocabularies)

        def one(text: bytes, words: list[bytes]) -> tuple:
            n = len(words)
            decoded = text.decode("utf-8", "replace")
            chars = len(decoded) - (len(text) - len(text.translate(None, _SPACE)))
            symbols = len(text) - len(text.translate(None, _SYMBOLS))
            places = known.places(words)
            repeats, lines = repeated_words(places), duplicate_lines(text)
            failed = n < 50 or 100 * repeats > 50 * n
            script, found, reason = script_of(decoded), (None,) * 6, None
            ids = known.ids(places)
            if len(ids):
                second = ids >= _SECOND
                pieces, ranks = ids[~second], ids[second] - _SECOND
                a, b = measures(pieces, chars, is_byte), measures(ranks, chars, lone)
                first_band, second_band = bands.get(script, bands["other"])
                reason, found = outside(a, len(pieces), first_band), a + b
                if reason is None and (again := outside(b, len(ranks), second_band)):
                    reason = f"{again}_ranks"
            return n, chars, symbols, lines, repeats, failed, not failed and reason is None, script, *found, reason

        def work(ids, texts):
            split = [t.split() for t in texts]
            known.learn({w for ws in split for w in ws})
            return [ids, *map(list, zip(*map(one, texts, split)))]

        return work

    return map_texts(id_and_text(docs, id_col, text_col), schema, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_multi_50k.tiktoken"))
