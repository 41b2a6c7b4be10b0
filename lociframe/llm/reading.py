"""Reading level by regularised ordinal regression.

Two passes over whole texts. The first adds up, over all documents, how often the words of each of
``BUCKETS`` hash buckets occur, and the letter trigrams of labelled texts by language; these tables have a fixed size
whatever the corpus holds. The second computes
the features of every document: lexical diversity, word rarity by that table, connectives, a proxy of
clause depth, and lengths. A proportional-odds model with an L2 penalty is fitted to graded documents (at
most ``max_graded`` of them, those with the least hash) and applied to all rows as a column expression.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.llm.language import LANGUAGES, TRIGRAMS, language_number, language_of, language_weights, trigram_buckets
from lociframe.session import broadcast_if_small, cut_lineage

BUCKETS = 1 << 17
WORD = re.compile(r"[a-zà-öø-ÿœ]+")
NUMBERED = re.compile(r"^[ \t]*(?:(?:para(?:graph)?|par|point|abs(?:atz)?|rn|rdnr|rz|nr|no|n|¶|§§?)[.°]?[ \t]*)?[\[(]?(\d{1,4})[\])]?[.:)]?(?:[ \t]+[-–—])?[ \t]+(?=\S)", re.M | re.I)
HEADER = re.compile(r"^(?:\[?page[ \t]+\d+.*|-{2,}.*-{2,}|\d{1,4})[ \t]*$", re.I)

# Words that join clauses, plain and formal ones.
PLAIN_JOINS = frozenset("and but so then yet when while because if or since before after until although though".split())
FORMAL_JOINS = frozenset("notwithstanding inasmuch insofar albeit provided whereas extent pursuant hereby therefore thereof wherein whereby nevertheless consequently neither nor unless".split())
CLAUSES = frozenset("that which who whom whose when while because if since until although though whereas notwithstanding inasmuch insofar albeit provided unless where".split())

FEATURES = ["log_words", "sentence_words", "word_letters", "long_words", "very_long_words", "diversity", "rarity", "plain_joins", "formal_joins", "clauses", "marks"]

# The features that do not go by the words of one language.
GENERAL = ["log_words", "sentence_words", "diversity", "marks"]


def body_of(text: str) -> str:
    """The numbered paragraphs without headnotes and page headers; empty if there are none."""
    first_line = text.split("\n", 1)[0].strip().lower()
    marks = [(int(m.group(1)), m.start()) for m in NUMBERED.finditer(text)]
    expected, begin = next((m for n in (1, 2, 3) for m in marks if m[0] == n), (0, -1))  # a first mark may be redacted
    if begin < 0:
        return ""
    if begin == 0:
        first_line = None  # a text that opens with its first paragraph has no heading
    kept, last = [], 0
    for line in text[begin:].split("\n"):
        bare = line.strip()
        if not bare or HEADER.match(bare) or bare.lower() == first_line:
            continue
        m = NUMBERED.match(line)
        if m and expected <= int(m.group(1)) <= expected + 2:
            expected = int(m.group(1)) + 1
            line = line[m.end() :]
            last = len(kept)
        kept.append(line)
    # a closing formula stands after the last blank line that no page header follows
    tail = text.rstrip().rsplit("\n\n", 1)
    closing = {x.strip() for x in tail[1].split("\n")} if len(tail) == 2 and len(tail[1]) < 400 and not HEADER.match(tail[1].split("\n", 1)[0].strip()) else set()
    return "\n".join(x for k, x in enumerate(kept) if k <= last or x.strip() not in closing)


def bucket_counts(texts: list[str | None]) -> dict[int, int]:
    """Occurrences of words by hash bucket."""
    words = Counter(WORD.findall("\n".join(t for t in texts if t).lower()))
    out: dict[int, int] = {}
    for w, n in words.items():
        b = crc32(w.encode()) & (BUCKETS - 1)
        out[b] = out.get(b, 0) + n
    return out


def features_of(text: str | None, rarity: dict[str, float], weigh, languages: np.ndarray) -> tuple[bool, bool, list[float] | None]:
    """Whether the text is English, whether numbered paragraphs were measured (else the whole text), and the
    features; no features without words."""
    body = body_of(text) if text else ""
    lowered = body.lower()
    words = WORD.findall(lowered)
    numbered = bool(words)
    if not words and text:
        body, lowered = text, text.lower()
        words = WORD.findall(lowered)
    if not words:
        return False, False, None
    counts = Counter(words)
    english = language_of(lowered, languages) == LANGUAGES.index("en")
    n = len(words)
    sentences = max(1, len(re.findall(r"[.?!](?:\s|$)", body)))
    marks = body.count(",") + body.count(";") + body.count(":")
    letters = long = very_long = 0
    rare = 0.0
    for w, k in counts.items():
        size = len(w)
        letters += size * k
        if size >= 7:
            long += k
            if size >= 11:
                very_long += k
        r = rarity.get(w)
        if r is None:
            r = rarity[w] = weigh(w)
        rare += r * k
    pick = lambda group: sum(counts[w] for w in group if w in counts)
    return english, numbered, [
        math.log(n), n / sentences, letters / n, long / n, very_long / n, math.log(len(counts)) / math.log(n + 1), rare / n,
        pick(PLAIN_JOINS) / sentences, pick(FORMAL_JOINS) / sentences, pick(CLAUSES) / sentences, marks / sentences,
    ]


def fit_ordinal(x: np.ndarray, y: np.ndarray, levels: int, penalty: float = 1.0, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ``levels`` - 1 rising thresholds of a proportional-odds model, by damped Newton steps.

    P(level <= k) = sigmoid(threshold_k - x.w); the penalty is on the weights only.
    """
    n, d = x.shape
    share = np.clip(np.cumsum(np.bincount(y - 1, minlength=levels)[:-1]) / n, 1e-3, 1 - 1e-3)
    theta = np.maximum.accumulate(np.log(share / (1 - share)) + np.arange(levels - 1) * 1e-3)
    p = np.concatenate((np.zeros(d), [theta[0]], np.log(np.diff(theta))))

    def thresholds(p: np.ndarray) -> np.ndarray:
        return p[d] + np.concatenate(([0.0], np.cumsum(np.exp(p[d + 1 :]))))

    def loss_grad(p: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        t = np.concatenate(([-40.0], thresholds(p), [40.0]))
        s = x @ p[:d]
        up, lo = 1 / (1 + np.exp(-np.clip(t[y] - s, -40, 40))), 1 / (1 + np.exp(-np.clip(t[y - 1] - s, -40, 40)))
        prob = np.maximum(up - lo, 1e-12)
        du, dl = up * (1 - up) / prob, lo * (1 - lo) / prob
        rows = np.zeros((n, d + levels - 1))  # d log prob / d p
        rows[:, :d] = -(du - dl)[:, None] * x
        gaps = np.exp(p[d + 1 :])
        rows[:, d] = np.where(y < levels, du, 0) - np.where(y > 1, dl, 0)
        for k in range(levels - 2):
            rows[:, d + 1 + k] = gaps[k] * (np.where((y >= k + 2) & (y < levels), du, 0) - np.where(y - 1 >= k + 2, dl, 0))
        grad = -rows.sum(0)
        grad[:d] += penalty * p[:d]
        return -np.log(prob).sum() + penalty / 2 * p[:d] @ p[:d], grad, rows

    value, grad, rows = loss_grad(p)
    damp = 1e-3
    for _ in range(rounds):
        shape = rows.T @ rows + np.diag(np.concatenate((np.full(d, penalty), np.full(levels - 1, 1e-6)))) + damp * np.eye(len(p))
        step = np.linalg.solve(shape, grad)
        new = loss_grad(p - step)
        if new[0] <= value:
            done = value - new[0] < 1e-7 * abs(value)
            p, (value, grad, rows), damp = p - step, new, max(damp / 4, 1e-6)
            if done:
                break
        else:
            damp *= 8
            if damp > 1e12:
                break
    return p[:d], thresholds(p)


def document_features(df: DataFrame, language: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``english``, ``numbered`` and the features (null where the text has no word). ``language`` is the
    number of the language that a text is labelled with, or null."""
    source = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"), language.cast("int").alias("language"))
    size = BUCKETS + len(LANGUAGES) * TRIGRAMS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                texts, labels = (batch.column(i).slice(at, 512).to_pylist() for i in range(2))
                got = bucket_counts(texts)
                total[np.fromiter(got, dtype=np.int64, count=len(got))] += np.fromiter(got.values(), dtype=np.int64, count=len(got))
                for k in range(len(LANGUAGES)):
                    own = "\n".join(t for t, label in zip(texts, labels) if t and label == k).lower()
                    low = BUCKETS + k * TRIGRAMS
                    total[low : low + TRIGRAMS] += np.bincount(trigram_buckets(own), minlength=TRIGRAMS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    table = source.select("text", "language").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most ``size`` rows
    counts = np.zeros(size, dtype=np.int64)
    counts[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    words = counts[:BUCKETS]
    weights = np.log(max(1, words.sum())) - np.log(np.maximum(words, 1))
    shipped = df.sparkSession.sparkContext.broadcast((weights.astype(np.float32), language_weights(counts[BUCKETS:].reshape(len(LANGUAGES), TRIGRAMS))))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (table, languages), rarity = shipped.value, {}
        weigh = lambda w: float(table[crc32(w.encode()) & (BUCKETS - 1)])
        for batch in batches:
            english, numbered, rows = [], [], []
            for at in range(0, batch.num_rows, 512):
                for t in batch.column(1).slice(at, 512).to_pylist():
                    e, k, f = features_of(t, rarity, weigh, languages)
                    english.append(e)
                    numbered.append(k)
                    rows.append(f or [None] * len(FEATURES))
                if len(rarity) > 500_000:  # a cache only
                    rarity.clear()
            columns = [pa.array(c, pa.float64()) for c in zip(*rows)] or [pa.array([], pa.float64())] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(english, pa.bool_()), pa.array(numbered, pa.bool_()), *columns], names=["doc_id", "english", "numbered", *FEATURES])

    return source.select("doc_id", "text").mapInArrow(measure, "doc_id bigint, english boolean, numbered boolean, " + ", ".join(f"{f} double" for f in FEATURES))


def _measured(df: DataFrame, graded: DataFrame, lang: str) -> DataFrame:
    """Features of all documents, written. Without a column ``lang`` the graded texts, which are in English, are the
    labelled ones."""
    if lang in df.columns:
        return cut_lineage(document_features(df, language_number(F.col(lang))))
    known = broadcast_if_small(graded.select(F.col("doc_id").alias("__graded")).distinct())
    return cut_lineage(document_features(df.join(known, F.col("doc_id") == F.col("__graded"), "left"), F.when(F.col("__graded").isNotNull(), LANGUAGES.index("en"))))


def _graded_rows(measured: DataFrame, graded: DataFrame, levels: int, max_graded: int):
    """Features and grade of at most ``max_graded`` grades, those with the least hash, as a pandas frame."""
    usable = graded.filter(f"reading_level between 1 and {levels}").select("doc_id", "reader", F.col("reading_level").alias("grade"))
    sample = usable.orderBy(F.xxhash64("doc_id", "reader"), "doc_id", "grade").limit(max_graded)
    return measured.filter("english and numbered").join(broadcast_if_small(sample, max_graded), "doc_id").select("doc_id", "grade", *FEATURES).toPandas().dropna()


def _fitted(rows, features: list[str], levels: int, penalty: float) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights and shift of the score, and the thresholds."""
    x = rows[features].to_numpy(dtype=float)
    middle, spread = x.mean(0), x.std(0)
    spread[spread < 1e-9] = 1.0
    weights, theta = fit_ordinal((x - middle) / spread, rows["grade"].to_numpy(dtype=int), levels, penalty)
    return weights / spread, float((weights * middle / spread).sum()), theta


def cross_validated(df: DataFrame, graded: DataFrame, levels: int = 4, penalty: float = 1.0, max_graded: int = 20_000, folds: int = 5, lang: str = "lang") -> DataFrame:
    """Held-out agreement with the grades: ``fold``, ``grades``, ``exact`` and ``within_one`` (shares). Documents, not grades,
    are dealt to the folds."""
    rows = _graded_rows(_measured(df, graded, lang), graded, levels, max_graded)
    out = []
    for fold in range(folds):
        held = rows[rows.doc_id % folds == fold]
        rest = rows[rows.doc_id % folds != fold]
        if held.empty or rest.empty:
            continue
        weights, shift, theta = _fitted(rest, FEATURES, levels, penalty)
        under = 1 / (1 + np.exp(held[FEATURES].to_numpy(dtype=float) @ weights[:, None] - shift - theta[None, :]))
        level = np.diff(under, axis=1, prepend=0, append=1).argmax(1) + 1
        miss = np.abs(level - held["grade"].to_numpy(dtype=int))
        out.append((fold, len(held), float((miss == 0).mean()), float((miss <= 1).mean())))
    return df.sparkSession.createDataFrame(out, "fold int, grades bigint, exact double, within_one double")


def reading_levels(df: DataFrame, graded: DataFrame, levels: int = 4, penalty: float = 1.0, max_graded: int = 20_000, all_texts: bool = False, lang: str = "lang") -> DataFrame:
    """Reading level of every document: ``doc_id``, ``english``, ``numbered``, ``level`` (1 to ``levels``),
    ``score`` (the level on a continuous scale) and ``log_words``.

    ``graded`` has doc_id, reader and reading_level; null or out-of-range levels are left out, and
    several grades of a document count each. ``lang`` may label texts with their language; labels may be
    missing or wrong for some, as the language is told by the text. Level and score are null for documents that are
    not in English or have no numbered paragraphs, and for all if no grade is usable. With ``all_texts`` every
    text with words has them: one without numbered paragraphs is measured whole, and one that is not in
    English is placed by a model of the ``GENERAL`` features, fitted to the same graded paragraphs.
    """
    measured = _measured(df, graded, lang)
    rows = _graded_rows(measured, graded, levels, max_graded)
    if rows.empty:
        return measured.select("doc_id", "english", "numbered", F.lit(None).cast("int").alias("level"), F.lit(None).cast("double").alias("score"), "log_words")

    def placed(features: list[str]) -> tuple[Column, Column]:
        weights, shift, theta = _fitted(rows, features, levels, penalty)
        s = sum((F.col(f) * float(w) for f, w in zip(features, weights)), F.lit(-shift))
        under = [1 / (1 + F.exp(s - float(t))) for t in theta]
        prob = [under[0], *[b - a for a, b in zip(under, under[1:])], 1 - under[-1]]
        best = F.greatest(*prob) if levels > 1 else prob[0]
        return F.coalesce(*[F.when(p == best, k + 1) for k, p in enumerate(prob)]), levels - sum(under)

    full, general = placed(FEATURES), placed(GENERAL)
    known = F.col("log_words").isNotNull() if all_texts else F.col("english") & F.col("numbered")
    level, score = (F.when(known, F.when(F.col("english"), a).otherwise(b)) for a, b in zip(full, general))
    return measured.select("doc_id", "english", "numbered", level.alias("level"), score.alias("score"), "log_words")
