"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Learning uses labelled rows whose crc32 of the id mod 3 is not 1. At most ``per_class`` examples of each label are kept
(a bound by parameter; rows of lowest hash). Terms are all words of the examples and their stems (first STEMS bytes of
longer words); none is left out. A text's vector is (1 + log tf) * idf * contrast, of length 1: document frequencies are
counted over all documents, and the contrast of a term is the distance between the labels' logarithmic rates of having it,
smoothed by PRIOR texts (delta TF-IDF). Words that no example has would have contrast 0.

Examples stand in blocks of BLOCK, alike ones together. For each term the index holds the blocks that contain it, with the
largest weight inside and its postings; terms that many examples hold have full rows instead of postings, and where many
examples of a block hold a term, its postings there are taken as a row (made in the worker, 512 bytes each). A text's terms
bound its cosine with any example of a block; blocks are visited by falling bound, in rounds of 1, 2, 4, ..., and a block
whose bound lies below the k-th best cosine is passed over, so the k nearest are exact (ties: first example).

The score is the share of votes for label 1, each neighbour voting with its cosine and its label's weight in the labelled
rows, put through a monotone calibration. That is fitted on votes for examples of each fifth by an index of the others,
contrasts included. Evidence lists the nearest examples' ids.

Null and empty texts, and those that share no term with an example, have no neighbours and get the rate of label 1 among
such examples (0 without any). Ids with several labels count as toxic if any is 1. Without examples of both labels every
score is the rate of label 1 (0 without labels). Repeated rows are scored each; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesview import WordHasher, separators
from .common import documents, give_back, labels, remainder, text_of

BLOCK, BATCH, FOLDS = 128, 128, 5
STEMS = (4, 5, 6)
PRIOR = 4.0
#: From this share of the examples on, a term has a full row.
FULL = 1 / 12
#: From so many postings on, what a term has in a block has a row of the block's width, made where it is used.
OWN_ROW = 6
#: Weights are 32-bit numbers; cosines are rounded to this many parts, so that they do not depend on what is computed together.
PARTS = 10**6

Vectors = tuple[np.ndarray, np.ndarray, np.ndarray]  # text, term, weight


def hasher() -> WordHasher:
    return WordHasher(separators(True), STEMS)


def counted(texts: list[np.ndarray], terms: np.ndarray) -> Vectors:
    """(text, term's place, tf) of the words that are terms."""
    words = np.concatenate([np.zeros(0, np.uint64), *texts])
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    if not len(terms):
        return owner[:0], owner[:0], owner[:0]
    at = np.searchsorted(terms, words)
    at[at == len(terms)] = 0
    known = terms[at] == words
    pair, tf = np.unique(owner[known] * len(terms) + at[known], return_counts=True)
    return pair // len(terms), pair % len(terms), tf


def weighted(text: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, n: int) -> Vectors:
    w = (1 + np.log(tf)) * weight[term]
    length = np.sqrt(np.bincount(text, w * w, n))
    keep = w > 0
    return text[keep], term[keep], (w / np.maximum(length, 1e-12)[text])[keep].astype(np.float32)


def contrasts(text: np.ndarray, term: np.ndarray, toxic: np.ndarray, n_terms: int) -> np.ndarray:
    """Of each term; 0 for those that no text has."""
    a, b = (np.bincount(term, y[text], n_terms) for y in (toxic, 1 - toxic))
    n1, n0 = float(toxic.sum()), float((1 - toxic).sum())
    s1, s0 = PRIOR * n1 / (n1 + n0), PRIOR * n0 / (n1 + n0)
    return np.where(a + b > 0, np.abs(np.log((a + s1) / (n1 + s1)) - np.log((b + s0) / (n0 + s0))), 0.0)


def ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ..., many[i] numbers of each, one after another."""
    return np.repeat(first - np.cumsum(many) + many, many) + np.arange(int(many.sum()))


class Postings:
    """Examples' vectors by term and block."""

    def __init__(self, vectors: Vectors, n: int, n_terms: int):
        text, term, w = vectors
        self.n = n
        self.blocks = max(1, -(-n // BLOCK))
        held = np.bincount(term, minlength=n_terms)
        full = np.flatnonzero(held > max(8, FULL * n))
        self.full_at = np.full(n_terms, -1, np.int32)
        self.full_at[full] = np.arange(len(full))
        rows = np.zeros((n, len(full)), np.float32)
        is_full = self.full_at[term] >= 0
        rows[text[is_full], self.full_at[term[is_full]]] = w[is_full]
        self.order = alike_together(rows)
        place = np.empty(n, np.int32)
        place[self.order] = np.arange(n)
        self.full = np.zeros((self.blocks, len(full), BLOCK), np.float32)
        for i in range(self.blocks):
            some = self.order[i * BLOCK : (i + 1) * BLOCK]
            self.full[i, :, : len(some)] = rows[some].T
        del rows
        self.full_most = self.full.max(2).T
        at, term, w = place[text[~is_full]], term[~is_full].astype(np.int32), w[~is_full]
        by_term = np.argsort(term.astype(np.int64) * n + at)
        at, term, self.weight = at[by_term], term[by_term], w[by_term]
        self.inside = (at % BLOCK).astype(np.uint8)
        group = term.astype(np.int64) * self.blocks + at // BLOCK  # postings of one term and block follow one another
        self.first = np.flatnonzero(np.diff(group, prepend=-1)).astype(np.int32)
        self.many = np.diff(np.append(self.first, len(group))).astype(np.int32)
        self.block = (group[self.first] % self.blocks).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, self.first) if len(group) else np.zeros(0, np.float32)
        self.of_term = np.searchsorted(group[self.first] // self.blocks, np.arange(n_terms + 1)).astype(np.int32)
        self.own: np.ndarray | None = None  # rows of the groups that have one; not sent to tasks
        self.own_at = np.full(len(self.first), -1, np.int32)
        large = np.flatnonzero(self.many >= OWN_ROW)
        self.own_at[large[np.argsort(self.block[large], kind="stable")]] = np.arange(len(large))  # those of a block lie together

    def own_rows(self) -> np.ndarray:
        if self.own is None:
            large = np.flatnonzero(self.own_at >= 0)
            self.own = np.zeros((len(large), BLOCK), np.float32)
            at = ranges(self.first[large], self.many[large])
            self.own[np.repeat(self.own_at[large], self.many[large]), self.inside[at]] = self.weight[at]
        return self.own

    def nearest(self, vectors: Vectors, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """n x k: the examples nearest to each of n texts and their cosines by falling cosine; -1 and 0 where there are fewer."""
        text, term, w = vectors
        is_full = self.full_at[term] >= 0
        query = np.zeros((n, self.full.shape[1]), np.float32)
        query[text[is_full], self.full_at[term[is_full]]] = w[is_full]
        text, term, w = text[~is_full], term[~is_full], w[~is_full]
        many = self.of_term[term + 1] - self.of_term[term]
        group, source = ranges(self.of_term[term], many), np.repeat(np.arange(len(term)), many)
        pair = text[source] * self.blocks + self.block[group]
        bound = query @ self.full_most + np.bincount(pair, w[source] * self.most[group], n * self.blocks).reshape(n, self.blocks)
        cells = n * self.blocks  # pairs of a text and a block; what belongs to one follows one another
        by_cell = np.argsort(pair.astype(np.uint16) if cells <= 1 << 16 else pair, kind="stable")
        of_cell = np.searchsorted(pair[by_cell], np.arange(cells + 1))
        group, w = group[by_cell], w[source[by_cell]]
        rank = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1)
        size = self.blocks * BLOCK
        best = np.full((n, k), -1, np.int64)  # cosine in parts, then the example, the first being the largest
        done, width = 0, 1
        while done < self.blocks:
            kth = np.maximum(best[:, -1] // size, 0) / PARTS
            chosen = (rank >= done) & (rank < done + width) & (bound > 0) & (bound >= kth[:, None] - 2 / PARTS)
            if chosen.any():
                found = self.cosines(chosen, query, of_cell, group, w)
                q, b = np.nonzero(chosen)
                keys = np.full((n, width, BLOCK), -1, np.int64)
                parts = np.rint(found * PARTS).astype(np.int64)
                at = size - 1 - (b[:, None] * BLOCK + np.arange(BLOCK))
                keys[q, rank[q, b] - done] = np.where(parts > 0, parts * size + at, -1)
                every = np.concatenate([best, keys.reshape(n, -1)], axis=1)
                best = -np.sort(np.partition(-every, k - 1, axis=1)[:, :k], axis=1)
            done, width = done + width, min(width * 2, self.blocks)
        at = np.where(best < 0, -1, self.order[np.minimum(size - 1 - best % size, self.n - 1)] if self.n else -1)
        return at, np.maximum(best // size, 0) / PARTS

    def cosines(self, chosen: np.ndarray, query: np.ndarray, of_cell: np.ndarray, group: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Of each chosen text and block, in their order: the cosines with the block's examples."""
        number = np.cumsum(chosen.ravel()) - 1
        cell = np.flatnonzero(chosen.ravel())
        held = of_cell[cell + 1] - of_cell[cell]
        hit = ranges(of_cell[cell], held)
        of, group, w = np.repeat(np.arange(len(cell)), held), group[hit], w[hit]
        own = self.own_at[group]
        few = own < 0
        many = self.many[group[few]]
        at = ranges(self.first[group[few]], many)
        out = np.bincount(np.repeat(of[few] * BLOCK, many) + self.inside[at], np.repeat(w[few], many) * self.weight[at], len(cell) * BLOCK).astype(float).reshape(-1, BLOCK)
        rows, weights, own = self.own_rows(), w[~few], own[~few]
        ends = np.searchsorted(of[~few], np.arange(len(cell) + 1)).tolist()
        for b in np.flatnonzero(chosen.any(0)):
            texts = np.flatnonzero(chosen[:, b])
            places = number[texts * self.blocks + b]
            for i in places.tolist():
                x, y = ends[i], ends[i + 1]
                out[i] += weights[x:y] @ rows.take(own[x:y], 0)
            out[places] += query[texts] @ self.full[b]
        return out


def alike_together(rows: np.ndarray, directions: int = 6) -> np.ndarray:
    """An order of rows in which those alike follow each other: by the leading direction each lies in most, then how far."""
    n, m = rows.shape
    k = min(directions, n, m)
    if k == 0:
        return np.arange(n)
    basis = np.random.default_rng(3).normal(size=(m, k))
    for _ in range(8):
        basis = orthogonal(rows.T @ (rows @ orthogonal(basis)))
    along = rows @ basis
    side = np.abs(along).argmax(1)
    far = np.round(along[np.arange(n), side], 4)
    return np.lexsort((np.arange(n), far, far > 0, side))


def orthogonal(x: np.ndarray) -> np.ndarray:
    """Columns made orthogonal one by one; no LAPACK, which can hang in a driver that has forked."""
    x = x.copy()
    for i in range(x.shape[1]):
        for _ in range(2):
            x[:, i] -= x[:, :i] @ (x[:, :i].T @ x[:, i])
        x[:, i] /= max(float(np.sqrt(x[:, i] @ x[:, i])), 1e-12)
    return x


@dataclass
class Index:
    """Everything that scoring needs; its size follows the examples, not the corpus."""

    terms: np.ndarray  # sorted hashes
    weight: np.ndarray  # idf * contrast of each
    ids: list  # of examples
    toxic: np.ndarray
    share: np.ndarray  # what an example stands for in the labelled rows
    postings: Postings
    k: int
    steps: np.ndarray = field(default_factory=lambda: np.zeros(0))  # calibration: from this vote on
    levels: np.ndarray = field(default_factory=lambda: np.zeros(0))  # this score
    none: float = 0.0  # score of a text without neighbours

    def scores(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of texts (word hashes), and the places of their nearest examples."""
        near, cosine = self.postings.nearest(weighted(*counted(texts, self.terms), self.weight, len(texts)), len(texts), self.k)
        vote = votes(near, cosine, self.toxic, self.share)
        level = np.maximum(np.searchsorted(self.steps, vote, "right") - 1, 0)
        score = self.levels[level] if len(self.levels) else vote
        return np.where(near[:, 0] < 0, self.none, score), near


def votes(near: np.ndarray, cosine: np.ndarray, toxic: np.ndarray, share: np.ndarray) -> np.ndarray:
    w = cosine * np.append(share, 0.0)[near]  # -1 is the last: no example
    return (w * np.append(toxic, 0.0)[near]).sum(1) / np.maximum(w.sum(1), 1e-12)


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps and levels of the least-squares rising fit of y on x, by pooling neighbours that fall."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for i in order:
        if pools and pools[-1][0] == x[i]:
            pools[-1][1] += w[i] * y[i]
            pools[-1][2] += w[i]
        else:
            pools.append([x[i], w[i] * y[i], w[i]])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            start, a, b = pools.pop()
            pools[-1][1] += a
            pools[-1][2] += b
    return np.array([p[0] for p in pools]), np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])


def indexed(ids: list, toxic: np.ndarray, counts: Vectors, terms: np.ndarray, idf: np.ndarray, share: np.ndarray, k: int) -> Index:
    """counts: (example, term, tf)."""
    n, (text, term, tf) = len(ids), counts
    fold = np.arange(n) % FOLDS
    vote, alone = np.zeros(n), np.ones(n, bool)
    for f in range(FOLDS):
        mine, others = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
        if len(mine) and 0 < toxic[others].sum() < len(others):
            place = np.full(n, -1)
            place[mine], place[others] = np.arange(len(mine)), np.arange(len(others))
            of_others = fold[text] != f
            weight = idf * contrasts(place[text[of_others]], term[of_others], toxic[others], len(terms))
            postings = Postings(weighted(place[text[of_others]], term[of_others], tf[of_others], weight, len(others)), len(others), len(terms))
            for start in range(0, len(mine), BATCH):
                some = mine[start : start + BATCH]
                asked = (fold[text] == f) & (place[text] >= start) & (place[text] < start + BATCH)
                near, cosine = postings.nearest(weighted(place[text[asked]] - start, term[asked], tf[asked], weight, len(some)), len(some), k)
                alone[some] = near[:, 0] < 0
                vote[some] = votes(near, cosine, toxic[others], share[others])
            del postings
    weight = idf * contrasts(text, term, toxic, len(terms))
    index = Index(terms, weight, ids, toxic, share, Postings(weighted(text, term, tf, weight, n), n, len(terms)), k)
    if not alone.all():
        index.steps, index.levels = monotone(vote[~alone], toxic[~alone], share[~alone])
    bare = np.bincount(text, minlength=n) == 0
    index.none = float((toxic * share)[bare].sum() / max(share[bare].sum(), 1e-9))
    return index


def sample(labelled: DataFrame, per_class: int) -> DataFrame:
    """(id, toxic) of at most per_class rows of each label."""
    rows = labelled.withColumn("draw", F.xxhash64("id"))
    ones, zeros = (rows.where(F.col("toxic") == t).orderBy("draw", "id").limit(per_class) for t in (1, 0))
    return ones.unionByName(zeros).select("id", "toxic")


def raw_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.lower(text_of(text_col)).cast("binary").alias("raw"))


def example_words(rows: DataFrame, kind: str) -> DataFrame:
    """rows (id, toxic, raw) -> (id, toxic, words, counts): distinct hashes of each text and how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = hasher()
        for b in batches:
            found = [np.unique(x, return_counts=True) for x in look.texts(b.column(2))]
            words, counts = pa.array([w.view(np.int64) for w, _ in found], pa.list_(pa.int64())), pa.array([c.astype(np.int32) for _, c in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), words, counts], names=["id", "toxic", "words", "counts"])

    return rows.mapInArrow(run, f"id {kind}, toxic int, words array<long>, counts array<int>")


def frequencies(rows: DataFrame, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """How many texts there are, and how many have each term: counted in tasks, added up by term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, total, texts = hasher(), np.zeros(len(terms), np.int64), 0
        for b in batches:
            held: list[np.ndarray] = []
            for x in look.texts(b.column(1)):
                texts += 1
                held.append(x)
                if len(held) == BATCH:
                    total += np.bincount(counted(held, terms)[1], minlength=len(terms))
                    held = []
            total += np.bincount(counted(held, terms)[1], minlength=len(terms))
        at = np.flatnonzero(total)
        for s in range(0, len(at) + 1, 1 << 16):
            some = at[s : s + (1 << 16)]
            first = ([-1], [texts]) if s == 0 else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array([*first[0], *some], pa.int32()), pa.array([*first[1], *total[some]], pa.int64())], names=["term", "n"])
        give_back()

    found = rows.mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    at, n = (np.asarray(found.column(c).to_numpy()) for c in ("term", "n"))
    out = np.zeros(len(terms), np.int64)
    out[at[at >= 0]] = n[at >= 0]
    return int(n[at < 0].sum()), out


def learn(df: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 2048, k: int = 15) -> Index:
    marks = marks.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("toxic in (0, 1) and id is not null")
    marks = marks.where(remainder("id", 3) != 1).groupBy("id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    rate = counts.get(1, 0) / max(1, sum(counts.values()))
    none = np.zeros(0, np.uint64)
    nothing = Index(none, np.zeros(0), [], np.zeros(0), np.zeros(0), Postings((none.astype(int), none.astype(int), np.zeros(0)), 0, 0), k, none=rate)
    if len(counts) < 2:
        return nothing
    chosen = F.broadcast(sample(marks, per_class))  # at most 2 * per_class rows
    rows = raw_text(df, id_col, text_col)
    examples = rows.join(chosen, "id").select("id", "toxic", "raw")
    found = example_words(examples, df.schema[id_col].dataType.simpleString()).toArrow()
    order = np.array(sorted(range(found.num_rows), key=lambda i: (found["id"][i].as_py(), len(found["words"][i]))), int)
    ids, toxic = [found["id"][int(i)].as_py() for i in order], found["toxic"].to_numpy().astype(float)[order]
    if not 0 < toxic.sum() < len(toxic):
        return nothing
    words = np.concatenate([found["words"][int(i)].values.to_numpy().view(np.uint64) for i in order])
    tf = np.concatenate([found["counts"][int(i)].values.to_numpy() for i in order])
    example = np.repeat(np.arange(len(ids), dtype=np.int32), found["words"].combine_chunks().value_lengths().to_numpy()[order])
    del found
    terms = np.unique(words)
    at = np.searchsorted(terms, words).astype(np.int32)
    del words
    texts, df_of = frequencies(rows, terms)
    share = np.where(toxic == 1, counts[1] / toxic.sum(), counts[0] / (1 - toxic).sum())
    idf = np.log((1 + texts) / (1 + df_of))
    return indexed(ids, toxic, (example, at, tf), terms, idf, share, k)


def score(df: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", shown: int = 5) -> DataFrame:
    """For each row: id, score, evidence (ids of the nearest examples)."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = hasher()
        for b in batches:
            scores, evidence, held = [np.zeros(0)], [], []

            def flush() -> None:
                found, near = index.scores(held)
                scores.append(found)
                evidence.extend([index.ids[i] for i in some if i >= 0] for some in near[:, :shown])
                held.clear()

            for x in look.texts(b.column(1)):
                held.append(x)
                if len(held) == BATCH:
                    flush()
            if held:
                flush()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(scores)), pa.array(evidence, pa.list_(b.schema.field(0).type))], names=["id", "score", "evidence"])
        give_back()

    return raw_text(df, id_col, text_col).mapInArrow(run, f"id {kind}, score double, evidence array<{kind}>").withColumnRenamed("id", id_col)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = score(docs, learn(docs, labels(spark, sf_dir)))
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))  # rows without an id are in neither part
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")
