"""Texts placed in containers of fixed capacity, measured in tokens.

The inverted index is sharded by content: a tree of clusters is fitted on a bounded sample
of the items, every item goes to the cluster it is most alike, and clusters that are far
apart, or too large for a task, are shards of their own. So the neighbours of an item by
BM25 are mostly in its shard. A seed item's window is filled greedily with its best scoring
unused neighbours that fit, and the rest of the window with the largest items that fit, so
nothing stays out. A text longer than a container fills whole ones, and its last part is an
item like any other; no other text is split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filament.llm import tokens
from filament.runtime import persisted

CAPACITY = 2_048
#: Items and tokens a shard is meant to hold at most; the shards' number follows the corpus.
SHARD_ITEMS, SHARD_TOKENS = 32_768, 16 << 20
#: Items on which the clusters are fitted (expected number; by hash), of each as much as it has.
SAMPLE = 4_096
#: Clusters are split whatever their size if the halves' centres are no more alike than this, as long as each half has so many sample items.
APART, LEAST = 0.5, 32
#: Clusters at most; what is too large still is cut by hash.
CLUSTERS = 512
#: Shards of less than this part of the largest size join the shard they are most alike.
SMALL = 1 / 512
#: BM25 parameters.
K1, B = 1.2, 0.75
#: Terms in more than this share of the corpus say nothing about neighbours.
COMMON = 0.25
#: A pick that leaves at most this many tokens closes the container.
CLOSE = 8
#: Bits of a term's count beside its id.
_TF_BITS = 12
_TF = (1 << _TF_BITS) - 1
#: Places of a hashed vector; seeds scored together; terms kept as columns of a matrix at most.
_PLACES, _BLOCK, _COLUMNS = 2_048, 64, 512


@dataclass
class Corpus:
    """What BM25 needs to know of all items: their number, mean size, and each term's document frequency."""

    n: int
    mean: float
    df: np.ndarray

    def __post_init__(self) -> None:
        self.telling = (self.df > 1) & (self.df <= max(2, COMMON * self.n))
        self.idf = np.where(self.telling, np.log1p((self.n - self.df + 0.5) / (self.df + 0.5)), 0).astype(np.float32)

    @classmethod
    def of(cls, terms: np.ndarray, sizes: np.ndarray) -> Corpus:
        return cls(len(sizes), max(float(sizes.mean()), 1) if len(sizes) else 1.0, np.bincount(terms >> _TF_BITS, minlength=1))

    def weights(self, terms: np.ndarray, share: np.ndarray) -> np.ndarray:
        """BM25 weight of each term of items; share: the items' sizes beside the mean, a value a term."""
        tf = (terms & _TF).astype(np.float32)
        return self.idf[terms >> _TF_BITS] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * share))

    def vectors(self, terms: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A unit vector an item: its telling terms' weights, hashed; zero for items without any."""
        n, term = len(offsets) - 1, terms >> _TF_BITS
        value = self.idf[term] * np.log1p(terms & _TF)
        place = term.astype(np.int64) * 2_654_435_761 >> 7
        value = np.where(place >> 20 & 1, value, -value)
        row = np.repeat(np.arange(n), np.diff(offsets))
        out = np.bincount(row * _PLACES + place % _PLACES, weights=value, minlength=n * _PLACES).reshape(n, _PLACES).astype(np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


# ---------------------------------------------------------------- shards
def _halves(x: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Two halves of unit vectors by 2-means, begun along their principal axis."""
    y = x - x.mean(0)
    axis = y[np.argmax((y**2).sum(1))].copy()
    for _ in range(12):
        axis = y.T @ (y @ axis)
        axis /= np.linalg.norm(axis) + 1e-9
    side = y @ axis > 0
    for _ in range(rounds):
        if side.all() or not side.any():
            break
        now = x @ _centre(x[side]) > x @ _centre(x[~side])
        if (now == side).all():
            break
        side = now
    return side


def _centre(x: np.ndarray) -> np.ndarray:
    c = x.sum(0)
    return c / max(float(np.linalg.norm(c)), 1e-9)


@dataclass
class Shards:
    """Centres of the clusters; of each cluster its first shard and how many it has; over how many shards items without telling terms are spread."""

    centres: np.ndarray
    first: np.ndarray
    parts: np.ndarray
    n: int

    @classmethod
    def fit(cls, x: np.ndarray, load: np.ndarray) -> Shards:
        """From vectors of sample items, and the part of a full shard that each stands for."""
        spread = max(1, int(np.ceil(load.sum())))
        todo, done = [np.flatnonzero(x.any(1))], []
        if not len(todo[0]):
            return cls(x[:1], np.zeros(1, np.int64), np.ones(1, np.int64), spread)
        while todo:
            todo.sort(key=lambda m: load[m].sum())
            own = todo.pop()
            big = load[own].sum() > 1
            if len(own) < 2 or len(todo) + len(done) >= CLUSTERS - 1 or not (big or len(own) >= 2 * LEAST):
                done.append(own)
                continue
            side = _halves(x[own])
            fewer = min(side.sum(), len(own) - side.sum())
            if fewer == 0 or (not big and (fewer < LEAST or _centre(x[own][side]) @ _centre(x[own][~side]) > APART)):
                done.append(own)
            else:
                todo += [own[side], own[~side]]
        centres = np.stack([_centre(x[m]) for m in done])
        loads = np.array([load[m].sum() for m in done])
        # small clusters share a shard with the cluster most like them
        shard, alike = np.arange(len(done)), centres @ centres.T
        for i in np.argsort(loads, kind="stable"):
            of_shard = np.bincount(shard, weights=loads, minlength=len(done))
            if of_shard[shard[i]] >= SMALL:
                continue
            others = [j for j in np.argsort(-alike[i], kind="stable") if shard[j] != shard[i] and of_shard[shard[j]] + of_shard[shard[i]] <= 1]
            if others:
                shard[shard == shard[i]] = shard[others[0]]
        _, shard = np.unique(shard, return_inverse=True)
        parts = np.maximum(1, np.ceil(np.bincount(shard, weights=loads))).astype(np.int64)
        first = np.append(0, np.cumsum(parts))
        return cls(centres, first[shard], parts[shard], max(int(first[-1]), spread))

    def of(self, x: np.ndarray, digest: np.ndarray) -> np.ndarray:
        """Shard of each item; digest: a number that spreads the items of a cluster over its parts, and those without telling terms over all shards."""
        cluster = (x @ self.centres.T).argmax(1)
        spread = (digest.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        inside = self.first[cluster] + (spread % self.parts[cluster].astype(np.uint64)).astype(np.int64)
        return np.where(x.any(1), inside, (spread % np.uint64(self.n)).astype(np.int64))


# ---------------------------------------------------------------- a shard's index
class Index:
    """BM25 weights of the items of a shard: terms of many items as columns of a matrix, the others as postings."""

    def __init__(self, terms: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, corpus: Corpus) -> None:
        self.n = n = len(offsets) - 1
        item = np.repeat(np.arange(n), np.diff(offsets))
        kept = corpus.telling[terms >> _TF_BITS]
        item, terms = item[kept], terms[kept]
        weight = corpus.weights(terms, (sizes / corpus.mean).astype(np.float32)[item])
        _, term, df = np.unique(terms >> _TF_BITS, return_inverse=True, return_counts=True) if len(terms) else (None, terms, terms)
        many = np.argsort(-df, kind="stable")[:_COLUMNS]
        many = many[df[many] > n / 16]
        column = np.full(len(df), -1)
        column[many] = np.arange(len(many))
        wide = column[term] >= 0 if len(terms) else np.zeros(0, bool)
        self.matrix = np.zeros((n, len(many)), np.float32)
        self.matrix[item[wide], column[term[wide]]] = weight[wide]
        item, term, weight = item[~wide], term[~wide], weight[~wide]
        # terms of the items, and items of the terms
        self.begin = np.searchsorted(item, np.arange(n + 1))
        self.terms = term
        order = np.argsort(term, kind="stable")
        self.items, self.weights = item[order], weight[order].astype(np.float32)
        self.first = np.searchsorted(term[order], np.arange(len(df) + 1))

    def scores(self, seeds: np.ndarray) -> np.ndarray:
        """A row a seed: scores of all items for its terms."""
        out = (self.matrix[seeds] > 0).astype(np.float32) @ self.matrix.T
        for row, seed in zip(out, seeds, strict=True):
            own = self.terms[self.begin[seed] : self.begin[seed + 1]]
            if len(own):
                count = self.first[own + 1] - self.first[own]
                upto = np.cumsum(count)
                at = np.repeat(self.first[own] - (upto - count), count) + np.arange(upto[-1])
                row += np.bincount(self.items[at], weights=self.weights[at], minlength=self.n).astype(np.float32)
        return out

    def only(self, rows: np.ndarray) -> None:
        """Keep these items alone, in their order."""
        place = np.full(self.n, -1)
        place[rows] = np.arange(len(rows))
        self.matrix, self.n = self.matrix[rows], len(rows)
        counts = (self.begin[1:] - self.begin[:-1])[rows]
        upto = np.append(0, np.cumsum(counts))
        self.terms = self.terms[np.repeat(self.begin[rows] - upto[:-1], counts) + np.arange(upto[-1])]
        self.begin = upto
        kept = place[self.items] >= 0
        self.first = np.append(0, np.cumsum(kept))[self.first]
        self.items, self.weights = place[self.items[kept]], self.weights[kept]


def pack(sizes: np.ndarray, terms: np.ndarray, offsets: np.ndarray, capacity: int, corpus: Corpus | None = None) -> np.ndarray:
    """Container of each item, from 0; sizes are at most capacity. Items of size 0 go into the first container."""
    where = np.full(len(sizes), -1, np.int64)
    where[sizes == 0] = 0
    # largest first: seeds come in this order, and the items that fit are the end of it
    ids = np.argsort(-sizes, kind="stable")
    ids = ids[sizes[ids] > 0]
    if not len(ids):
        return where
    lengths = np.diff(offsets)[ids]
    upto = np.append(0, np.cumsum(lengths))
    own = terms[np.repeat(offsets[ids] - upto[:-1], lengths) + np.arange(upto[-1])]
    size = sizes[ids]
    index = Index(own, upto, size, corpus or Corpus.of(terms, sizes))
    unused, container, scored, seed, last = np.ones(len(ids), bool), -1, {}, 0, len(ids) - 1
    while True:
        while seed < len(ids) and not unused[seed]:
            seed += 1
        if seed == len(ids):
            return where
        left = int(unused.sum())
        if left < len(ids) // 2 and len(ids) > 1024:
            rows = np.flatnonzero(unused)
            index.only(rows)
            ids, size, unused, scored, seed, last = ids[rows], size[rows], unused[rows], {}, 0, len(rows) - 1
        container += 1
        where[ids[seed]], unused[seed] = container, False
        room = capacity - size[seed]
        score = None
        while True:
            while last >= 0 and not unused[last]:
                last -= 1
            if last < 0 or size[last] > room:
                break
            if score is None:
                if seed not in scored:
                    block = np.append(seed, seed + 1 + np.flatnonzero(unused[seed + 1 :][: 8 * _BLOCK])[: _BLOCK - 1])
                    scored = dict(zip(block.tolist(), index.scores(block), strict=True))
                score = scored[seed]
                score[~unused] = -1
            start = int(np.searchsorted(-size, -room))
            stop = int(np.searchsorted(-size, CLOSE - room, side="right"))  # items that close the container end here
            pick = start + int(np.argmax(score[start:stop])) if stop > start else start
            if stop <= start or score[pick] < 0:
                pick = start + int(np.argmax(score[start:]))
                if score[pick] <= 0 or room - size[pick] < size[last]:
                    # no neighbour, or the last pick would leave a hole that nothing fills
                    pick = start + int(np.argmax(unused[start:]))
            where[ids[pick]], unused[pick], score[pick] = container, False, -1
            room -= size[pick]


# ---------------------------------------------------------------- the corpus
def sized_items(df: DataFrame, key: str, text: str, capacity: int, folder: str, vocabulary: str) -> DataFrame:
    """(key, digest, n_tokens, terms, counts): each text's size, and its token ids with their counts in one integer each.

    Each task adds rows with counts, which are no texts: terms of its items and in how many they are.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, df = tokens.encoder(folder, vocabulary), np.zeros(0, np.int64)
        names = [key, "digest", "n_tokens", "terms", "counts"]
        none, kind = pa.nulls, pa.list_(pa.int32())
        key_type = None
        for batch in batches:
            at, key_type = 0, batch.column(0).type
            for n, ids, first in tokens.encode_batches(tokens._texts(batch.column(2)), enc):
                sizes = np.diff(first)
                # of a text beyond the capacity only the last part is an item
                tail = np.where(sizes > capacity, sizes % capacity, sizes)
                rows = np.repeat(np.arange(n), sizes)
                inside = np.arange(len(ids)) >= np.repeat(first[1:] - tail, sizes)
                pairs, counts = np.unique((rows[inside].astype(np.int64) << 17) | ids[inside], return_counts=True)
                own = np.bincount(pairs & ((1 << 17) - 1))
                df = np.pad(df, (0, max(0, len(own) - len(df))))
                df[: len(own)] += own
                terms = ((pairs & ((1 << 17) - 1)) << _TF_BITS | np.minimum(counts, _TF)).astype(np.int32)
                offsets = np.searchsorted(pairs >> 17, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(terms)), none(n, kind)], names=names)
                at += n
        used = np.flatnonzero(df)
        if len(used):
            whole = pa.array([0, len(used)], pa.int32())
            lists = [pa.ListArray.from_arrays(whole, pa.array(x.astype(np.int32))) for x in (used, df[used])]
            yield pa.RecordBatch.from_arrays([none(1, key_type), none(1, pa.int64()), none(1, pa.int64()), *lists], names=names)

    kind = df.schema[key].dataType.simpleString()
    body = F.col(text).cast("string").alias("text")
    return df.select(F.col(key), F.xxhash64(F.col(key), F.col(text).cast("string")).alias("digest"), body).mapInArrow(measure, f"`{key}` {kind}, digest bigint, n_tokens bigint, terms array<int>, counts array<int>")


def _lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def sharded_items(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, folder: str = tokens.TOKENIZERS, vocabulary: str = tokens.VOCABULARY, shard_items: int = SHARD_ITEMS, shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, Corpus]:
    """(key, digest, n_tokens, terms, shard) of each text, and the corpus they are from.

    The shard of a row follows from its key and text and from the corpus, not from how the
    table is cut into files; only rows that are repeated so often that their copies fill a
    good part of a shard are spread by their place.
    """
    every = persisted(sized_items(df, key, text, capacity, folder, vocabulary), "sized-items")
    items = every.where(F.col("counts").isNull()).drop("counts")
    rest = F.when(F.col("n_tokens") > capacity, F.col("n_tokens") % capacity).otherwise(F.col("n_tokens"))
    n, total = items.agg(F.count("*"), F.coalesce(F.sum(rest), F.lit(0))).first()
    pairs = every.where(F.col("counts").isNotNull()).select(F.inline(F.arrays_zip("terms", "counts")))
    found = pairs.groupBy("terms").agg(F.sum("counts")).toPandas().to_numpy()  # as many as the vocabulary
    counts = np.zeros(int(found[:, 0].max()) + 1 if len(found) else 1, np.int64)
    if len(found):
        counts[found[:, 0].astype(np.int64)] = found[:, 1].astype(np.int64)
    corpus = Corpus(n, max(total / max(n, 1), 1), counts)

    copies = items.groupBy("digest").agg(F.count("*").alias("n"))
    hot = {r.digest for r in copies.where(F.col("n") > max(shard_items // 8, n // 10_000)).collect()}  # at most 10,000
    # distinct rows by hash, each standing for its copies; the hot ones always
    chosen = F.pmod(F.xxhash64("digest"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30))
    sample = items.where(chosen | F.col("digest").isin(*hot)).groupBy("digest").agg(F.first("terms").alias("terms"), F.count("*").alias("n"), F.sum(rest).alias("tokens"))
    sample = sample.orderBy("digest").toArrow()
    shards = None
    if len(sample):
        values, offsets = _lists(sample["terms"])
        stands = np.where(np.isin(sample["digest"].to_numpy(), list(hot)), 1, max(1.0, n / SAMPLE))
        load = np.maximum(sample["n"].to_numpy() / shard_items, sample["tokens"].to_numpy() / shard_tokens) * stands
        vectors = np.concatenate([corpus.vectors(values[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in _spans(len(sample), 512)])
        shards = Shards.fit(vectors, load)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _lists(batch.column(3))
            digest, place = batch.column(1).to_numpy(), batch.column(4).to_numpy()
            salted = np.where(np.isin(digest, list(hot)), place, digest) if hot else digest
            shard = np.zeros(len(digest), np.int64)
            if shards is not None:
                for a, b in _spans(len(digest), 512):
                    shard[a:b] = shards.of(corpus.vectors(values[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), salted[a:b])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(shard)], names=[key, "digest", "n_tokens", "terms", "shard"])

    kind = df.schema[key].dataType.simpleString()
    placed = items.withColumn("place", F.monotonically_increasing_id()).mapInArrow(assign, f"`{key}` {kind}, digest bigint, n_tokens bigint, terms array<int>, shard bigint")
    return placed, corpus


def _spans(n: int, size: int) -> list[tuple[int, int]]:
    return [(a, min(a + size, n)) for a in range(0, n, size)]


def packed(
    df: DataFrame, key: str, text: str, capacity: int = CAPACITY, folder: str = tokens.TOKENIZERS, vocabulary: str = tokens.VOCABULARY, shard_items: int = SHARD_ITEMS, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """(container, key, piece, first_token, n_tokens): where each part of each text is placed.

    container is unique over the corpus; piece counts a text's parts from 0, first_token is
    the part's place in the text's tokens. Only a text of more than capacity tokens has
    several parts: whole containers, and the rest, if any, as an item. Empty and null texts
    have one part of 0 tokens. Repeated rows are each placed. An empty table has no rows.
    """
    items, corpus = sharded_items(df, key, text, capacity, folder, vocabulary, shard_items, shard_tokens)
    kind = df.schema[key].dataType.simpleString()

    def fill(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        table = table.sort_by([("digest", "ascending"), ("n_tokens", "ascending")]).combine_chunks()
        keys, total = table.column(key), table.column("n_tokens").to_numpy()
        terms, offsets = _lists(table.column("terms"))
        whole = np.where(total > capacity, total // capacity, 0)
        rest = total - whole * capacity
        item = np.flatnonzero((rest > 0) | (total == 0))
        lengths = np.diff(offsets)[item]
        upto = np.append(0, np.cumsum(lengths))
        own = terms[np.repeat(offsets[item] - upto[:-1], lengths) + np.arange(upto[-1])]
        placed = pack(rest[item], own, upto, capacity, corpus)
        n_filled = int(placed.max(initial=-1)) + 1
        row = np.repeat(np.arange(len(total)), whole)
        piece = np.arange(len(row)) - np.repeat(np.append(0, np.cumsum(whole))[:-1], whole)
        container = np.concatenate([n_filled + np.arange(len(row)), placed])
        rows = np.concatenate([row, item])
        return pa.table(
            {
                "container": pa.array((np.int64(shard) << 32) | container),
                key: keys.take(pa.array(rows)),
                "piece": pa.array(np.concatenate([piece, whole[item]]).astype(np.int32)),
                "first_token": pa.array(np.concatenate([piece * capacity, whole[item] * capacity])),
                "n_tokens": pa.array(np.concatenate([np.full(len(row), capacity), rest[item]])),
            }
        )

    return items.groupBy("shard").applyInArrow(fill, f"container bigint, `{key}` {kind}, piece int, first_token bigint, n_tokens bigint")
