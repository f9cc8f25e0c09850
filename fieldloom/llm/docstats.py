"""Statistics of whole documents, by Arrow and numpy on batches of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import starts_of, tokens

#: Symbols that count as noise, and the characters that are white space here.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def repeat_words(codes: np.ndarray, lens: np.ndarray, n_codes: int) -> np.ndarray:
    """Per document: words inside 3-word windows that are in it twice or more, the first one included."""
    doc = np.repeat(np.arange(len(lens)), lens)
    out = np.zeros(len(lens), np.int64)
    if len(codes) < 3:
        return out
    codes = codes.astype(np.int64)
    inside = np.flatnonzero(doc[2:] == doc[:-2])
    if n_codes < 1 << 21:
        key = codes[inside] << 42 | codes[inside + 1] << 21 | codes[inside + 2]
    else:  # too many words for three codes in 63 bits: pairs are numbered first
        pair = np.unique(codes[:-1] * n_codes + codes[1:], return_inverse=True)[1]
        key = pair[inside] * n_codes + codes[inside + 2]
    order = np.argsort(key, kind="stable")  # equal windows stay in the order of the documents
    key, at = key[order], inside[order]
    again = (key[1:] == key[:-1]) & (doc[at[1:]] == doc[at[:-1]])
    flag = np.zeros(len(codes), bool)
    for hit in (at[1:][again], at[:-1][again]):
        for k in range(3):
            flag[hit + k] = True
    return np.bincount(doc[flag], minlength=len(lens))


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def base_counts(texts: pa.Array) -> tuple[dict[str, np.ndarray], tuple]:
    """Columns n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, and the tokens they come from."""
    texts = pc.fill_null(texts, "")
    codes, lens, words = found = tokens(texts, lower=False)
    plain = texts.to_pylist()
    out = {
        "n_words": lens.astype(np.int64),
        "word_chars": np.array([len(t) - sum(map(t.count, BLANKS)) for t in plain], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in plain], np.int64),
        "n_dup_lines": np.array([repeated_lines(t) for t in plain], np.int64),
        "n_repeat_words": repeat_words(codes, lens, len(words)),
    }
    return out, found


#: Names of the statistics that features() returns, in order.
FEATURES = [
    "log_words", "log_chars", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "line_words", "distinct_rate", "top_word_rate", "upper_rate", "digit_rate", "punctuation_rate",
    "other_rate", "stop_rate", "short_word_rate", "long_word_rate", "sentence_rate", "blank_rate", "bracket_rate", "entropy",
]


def features(texts: pa.Array) -> np.ndarray:
    """A row of statistics per document, all finite; of an empty text, zeros."""
    base, (codes, lens, words) = base_counts(texts)
    plain = [t or "" for t in texts.to_pylist()]
    n, chars = np.maximum(base["n_words"], 1), np.maximum(base["word_chars"], 1)
    doc = np.repeat(np.arange(len(lens)), lens)
    width = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
    per = lambda mask: np.bincount(doc, weights=mask, minlength=len(lens))
    pair, times = np.unique(doc * max(len(words), 1) + codes, return_counts=True)
    owner = pair // max(len(words), 1)
    distinct = np.bincount(owner, minlength=len(lens))
    top = np.zeros(len(lens))
    np.maximum.at(top, owner, times)
    share = times / n[owner]
    entropy = np.bincount(owner, weights=-share * np.log(share), minlength=len(lens))
    raw = [np.frombuffer(t.encode(), np.uint8) for t in plain]
    kinds = np.array([np.bincount(KIND[r], minlength=6) for r in raw]).reshape(-1, 6)
    lines = np.array([t.count("\n") + 1 for t in plain])
    total = np.maximum([len(r) for r in raw], 1)
    columns = [
        np.log1p(base["n_words"]), np.log1p(base["word_chars"]), base["word_chars"] / n, base["n_symbols"] / chars, base["n_dup_lines"] / lines, base["n_repeat_words"] / n, np.log1p(n / lines), distinct / n, top / n,
        kinds[:, 1] / total, kinds[:, 2] / total, kinds[:, 3] / total, kinds[:, 4] / total, per(width <= 3) / n, per(width == 1) / n, per(width > 15) / n,
        np.array([t.count(". ") + t.count(".\n") for t in plain]) / n, np.array([t.count("\n\n") for t in plain]) / lines, kinds[:, 5] / total, entropy / np.log(n + 1),
    ]
    out = np.stack([np.asarray(c, np.float64) for c in columns], 1)
    out[base["n_words"] == 0] = 0
    return out


def _kinds() -> np.ndarray:
    """Of each byte: 0 lower case and white space, 1 upper case, 2 digit, 3 sentence punctuation, 4 above ASCII, 5 other signs."""
    kind = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b)
        kind[b] = 4 if b > 127 else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in ".,;:!?'\"-" else 0 if c.islower() or c.isspace() else 5
    return kind


KIND = _kinds()
__all__ = ["FEATURES", "base_counts", "features", "repeat_words", "repeated_lines", "starts_of"]
