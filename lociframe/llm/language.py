"""Language of a text by its letter trigrams: a naive Bayes model over hash buckets, trained on labelled texts.

Counts are added up over all labelled texts by the pass that counts words, so the model has a fixed size. A text
belongs to the language under which its trigrams are likeliest, and to none if they are likelier under equal
chances for all trigrams.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TRIGRAMS = 1 << 16
SMOOTHING = 0.05

# The spellings of the languages' labels.
SPELLINGS = {
    "en": ("en", "eng", "english"),
    "de": ("de", "ger", "deu", "german", "deutsch"),
    "fr": ("fr", "fre", "fra", "french", "français"),
}
LANGUAGES = list(SPELLINGS)

_LETTERS = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))


def language_number(label: Column) -> Column:
    """Place of a label in ``LANGUAGES``; null for labels that are none of them."""
    plain = F.lower(F.trim(label))
    return F.coalesce(*[F.when(plain.isin(*names), k) for k, names in enumerate(SPELLINGS.values())])


def trigram_buckets(lowered: str) -> np.ndarray:
    """Buckets of all byte trigrams of a text in small letters; everything but letters counts as a blank."""
    b = np.frombuffer(f" {lowered} ".encode().translate(_LETTERS), dtype=np.uint8).astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


def language_weights(counts: np.ndarray) -> np.ndarray:
    """Log chances by language (rows) and bucket, from counts; the last row is the one of equal chances. A language without
    texts is never the likeliest."""
    smooth = counts + SMOOTHING
    chances = np.log(smooth) - np.log(smooth.sum(1, keepdims=True))
    chances[counts.sum(1) == 0] = -1e3
    return np.vstack((chances, np.full(TRIGRAMS, -np.log(TRIGRAMS)))).astype(np.float32)


def language_of(lowered: str, weights: np.ndarray) -> int:
    at = trigram_buckets(lowered)
    return int(np.argmax([row.take(at).sum() for row in weights]))
