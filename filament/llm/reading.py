"""How demanding a text is to read, by familiar words and sentence length.

The familiar words are the high-frequency list that the document frequencies of the whole
corpus give, and its beginnings: the 20, 40, 60 … most frequent words. The formula of a
sentence is its share of words outside each of these lists, and its length; labelled
documents only set the formula's coefficients, by a multinomial logistic fit. A document has
the level of most of its prose.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filament.runtime import is_blank, persisted

#: Words of the high-frequency list, the share of documents a word must be in, and by how many words each list is longer than the one before.
LIST_SIZE, LEAST_SHARE, LIST_STEP = 5_000, 0.002, 20
#: Labelled documents that the fit takes at most (by hash of the id), with their whole texts.
MAX_LABELLED = 4_000
#: How far a sentence may be of another level than its labelled text's.
OTHERS = 0.15
LEVELS = (1, 2, 3, 4)
#: Texts graded at a time.
TEXTS = 500

_WORD = re.compile(r"[a-z]+(?:['’-][a-z]+)*")
_LINE = re.compile(r"[\r\n  ]+")
_END = re.compile(r"(?<=[.!?;])\s+")
#: Tables, sequences, commands and records are no prose.
_NO_PROSE = re.compile(r"\s*(?:[>$|{}\[]|#\s|\t)|.*\|.*\|")


def sentences(text: str) -> list[list[str]]:
    """Lower-case words of each sentence of the prose of a text; one-word sentences are left out."""
    out = []
    for line in _LINE.split(text.lower()):
        if _NO_PROSE.match(line):
            continue
        for s in _END.split(line):
            words = _WORD.findall(s)
            if len(words) > 1:
                out.append(words)
    return out


def document_frequencies(df: DataFrame, text: str) -> DataFrame:
    """(word, df): in how many texts each word stands, and as the empty word how many texts there are; counted within each batch first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter[str] = Counter()
            for t in batch["text"]:
                seen.update(set(_WORD.findall(t.lower())))
            seen[""] = len(batch)
            yield pd.DataFrame({"word": list(seen), "df": list(seen.values())})

    texts = df.select(F.col(text).cast("string").alias("text")).where(~is_blank(F.col("text")))
    return texts.mapInPandas(count, "word string, df long").groupBy("word").agg(F.sum("df").alias("df"))


def familiar_words(df: DataFrame, text: str, size: int = LIST_SIZE, least: float = LEAST_SHARE) -> list[str]:
    """The high-frequency list of a corpus: its size words in most texts, of those in the least share of all texts. The texts are read once."""
    counts = persisted(document_frequencies(df, text), "document-frequencies")
    n = counts.where("word = ''").agg(F.sum("df")).first()[0] or 0
    top = counts.where((F.col("word") != "") & (F.col("df") >= max(2, least * n))).orderBy(F.desc("df"), "word").limit(size)
    return [r.word for r in top.collect()]


class Words:
    """Sentences as arrays: for each word its place in the list (the list's length for none), and where sentences and texts begin."""

    def __init__(self, texts: list[str], place: dict[str, int]) -> None:
        none, get = len(place), place.get
        flat: list[int] = []
        lengths: list[int] = []
        self.per_text = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            for words in sentences(t):
                flat += [get(w, none) for w in words]
                lengths.append(len(words))
                self.per_text[i] += 1
        self.words = np.array(flat, np.int64)
        self.lengths = np.array(lengths, np.int64)


def formula(words: np.ndarray, lengths: np.ndarray, size: int, step: int = LIST_STEP) -> np.ndarray:
    """A row a sentence: the share of words outside each list, from the shortest to the whole one, and the log of the length.

    words: places in the list of size words (size for other words), one sentence after another.
    """
    n, k = len(lengths), max(1, -(-size // step))
    owner = np.repeat(np.arange(n), lengths)
    part = np.minimum(words // step, k)  # lists that lack the word
    part[words >= size] = k
    inside = np.bincount(owner * (k + 1) + part, minlength=n * (k + 1)).reshape(n, k + 1).cumsum(1)[:, :k]
    outside = 1 - inside / lengths[:, None]
    return np.column_stack([outside, np.log(lengths)]).astype(np.float32)


class Fit:
    """Multinomial logistic regression by full-batch gradient steps with momentum, in the features' principal components.

    target: a row a sentence, how far it is of each level.
    """

    def __init__(self, x: np.ndarray, target: np.ndarray, weight: np.ndarray, steps: int = 100, ridge: float = 1e-2, decay: float = 1e-4) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        self.axes = np.eye(x.shape[1] + 1, dtype=np.float32)
        z = self._standard(x)
        weight = (weight / weight.sum())[:, None].astype(np.float32)
        size, axes = np.linalg.eigh(((z * weight).T @ z).astype(float))
        self.axes = (axes / np.sqrt(np.maximum(size, 0) + ridge)).astype(np.float32)
        z = z @ self.axes
        self.b = np.zeros((z.shape[1], len(LEVELS)), np.float32)
        speed = np.zeros_like(self.b)
        for _ in range(steps):
            speed = 0.9 * speed - (z.T @ ((self._softmax(z @ self.b) - target) * weight) + decay * self.b)
            self.b += speed

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([(x - self.mean) / self.scale, np.ones(len(x), np.float32)]).astype(np.float32) @ self.axes

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def levels(self, x: np.ndarray) -> np.ndarray:
        """Probability of each level, a row a sentence."""
        return self._softmax(self._standard(x) @ self.b)


def usual_lengths(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Median sentence length of each level, over the sentences that the fit gives it; the overall one for a level without any."""
    best = p.argmax(1)
    return np.array([np.median(lengths[best == i]) if (best == i).any() else np.median(lengths) for i in range(len(LEVELS))])


def most_of(p: np.ndarray, lengths: np.ndarray, per_text: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """Level of most sentences of each text; a text without a sentence has the middle level 2.

    Ends of sentences get lost, so a stretch of words counts as many sentences of a level as
    the level's usual length goes into it.
    """
    owner = np.repeat(np.arange(len(per_text)), per_text)
    votes = np.zeros((len(per_text), len(LEVELS)))
    np.add.at(votes, owner, p * lengths[:, None] / usual)
    votes[per_text == 0, LEVELS.index(2)] = 1
    return np.array(LEVELS)[votes.argmax(1)]


def reading_levels(docs: DataFrame, labels: DataFrame, corpus: DataFrame, key: str = "doc_id", text: str = "text", level: str = "reading_level", step: int = LIST_STEP) -> DataFrame:
    """(key, level) of each text of docs that is not in labels.

    docs: texts to grade; null and blank ones have no row. labels: (key, level) of some
    texts of the corpus, of which MAX_LABELLED at most are fitted on. corpus: all texts, for
    the document frequencies. A text without a sentence of prose has level 2. Repeated rows
    are each graded. step: see LIST_STEP. Without labelled texts there is no scale, and the result is empty.
    """
    listed = familiar_words(corpus, text)
    size, place = len(listed), {w: i for i, w in enumerate(listed)}
    own_labels = labels.where(F.col(level).isin(*LEVELS) & F.col(key).isNotNull()).groupBy(key).agg(F.min(level).cast("int").alias("level"))
    chosen = own_labels.orderBy(F.xxhash64(key), key).limit(MAX_LABELLED)
    labelled = corpus.select(key, F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), key).where(~is_blank(F.col("text")))

    def words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            w = Words(list(batch["text"]), place)
            n_words = np.add.reduceat(np.append(w.lengths, 0), np.append(0, np.cumsum(w.per_text))[:-1]) * (w.per_text > 0)
            words, lengths = np.split(w.words, np.cumsum(n_words)[:-1]), np.split(w.lengths, np.cumsum(w.per_text)[:-1])
            yield pd.DataFrame({"level": batch["level"], "words": [x.tolist() for x in words], "lengths": [x.tolist() for x in lengths]})

    sample = labelled.select("level", "text").mapInPandas(words_of, "level int, words array<int>, lengths array<int>").toPandas()
    sample = sample[sample["lengths"].map(len) > 0]
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, `{level}` int"
    if sample.empty:
        return docs.sparkSession.createDataFrame([], schema)
    words, lengths = (np.concatenate([np.asarray(x, np.int64) for x in sample[c]]) for c in ("words", "lengths"))
    per_text = sample["lengths"].map(len).to_numpy()
    target = np.repeat(np.eye(len(LEVELS), dtype=np.float32)[[LEVELS.index(v) for v in sample["level"]]], per_text, axis=0)
    x, weight = formula(words, lengths, size, step), np.repeat(1 / per_text, per_text)
    fit = Fit(x, target, weight)
    # a text's label holds for most of its sentences, not for all
    shares = fit.levels(x) * (OTHERS + (1 - OTHERS) * target)
    fit = Fit(x, shares / shares.sum(1, keepdims=True), weight)
    usual = usual_lengths(fit.levels(x), lengths)

    def grade(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part = batch.iloc[at : at + TEXTS]
                w = Words(list(part["text"]), place)
                p = fit.levels(formula(w.words, w.lengths, size, step)) if len(w.lengths) else np.zeros((0, len(LEVELS)))
                yield pd.DataFrame({key: part[key], level: most_of(p, w.lengths, w.per_text, usual).astype(np.int32)})

    texts = docs.select(key, F.col(text).cast("string").alias("text")).where(~is_blank(F.col("text")))
    graded = texts.mapInPandas(grade, schema)
    return graded.join(labels.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
