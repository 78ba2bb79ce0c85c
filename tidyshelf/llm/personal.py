"""Personal data: base patterns, and a skip-chain conditional random field that adds what they leave out.

Base spans follow the contract's four patterns, leftmost and without overlap for each kind; a match that fails its test
(address parts, digit counts, Luhn sum) is dropped and its characters are used up. They are found in linear time.

The field's variables are the labels (none, email, ip, card, phone) of tokens that hold a digit, ``@`` or ``+``; all other
tokens are none. Tokens touched by a base span are observed. Neighbouring tokens share a chain potential; tokens of a
document whose letters and digits are the same, or whose digits (or last eight of them) are, share a skip potential, each with its
next such token and each hidden one with the nearest observed one on either side, so a repeated name of an entity pulls its
other mentions to the same label however far away. Loopy sum-product messages run until each document settles, or for
100 messages an edge on average, whatever stands beside it in a batch: after the first round only what still changes is sent
again. Texts are taken some million characters at a time, a longer one alone, and its graph lies in flat arrays. Hidden tokens whose
label other than none reaches ``threshold`` become added spans, adjoining ones of a phone number, or of a card of at most 19 digits, as one. The potentials are fitted piece by piece
on at most ``sample_rows`` documents (a bound by parameter; rows of lowest hash): a softmax regression over token shapes,
and log ratios of label pairs on chain and skip edges.

Offsets are code points, ends exclusive. Null texts are empty and have no spans. n_email, n_ip, n_card and n_phone count
base spans; n_added counts the others. Repeated rows are treated alike; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, give_back, text_of

#: Kinds in the contract's order.
KINDS = ("email", "ip", "card", "phone")
SIGNAL = re.compile(r"[0-9@+]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
#: Repeated groups are possessive: nothing follows them that could take characters back, and long runs leave no stack behind.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # kind's number, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """An address can only begin in the run of local characters before an @, after the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield 0, start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def addresses(text: str) -> Iterator[Span]:
    """Runs of dotted numbers, taken four at a time from the left."""
    for m in DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield 1, at, end
            at = end + 1


def base_spans(text: str) -> list[Span]:
    """All base spans by kind, then start."""
    if not SIGNAL.search(text):
        return []
    out = [*emails(text), *addresses(text)]
    for m in DIGITS.finditer(text):
        if 13 <= len(m[0]) and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


# ---- the field


def shape(token: str) -> int:
    """A token's features as bits; bit 0 is always set."""
    core = token.strip(".,;:!?*#$%&\"'()[]{}<>|")
    digits = "".join(c for c in core if "0" <= c <= "9")
    n, dots, letters = len(digits), core.count("."), any(c.isalpha() for c in core)
    parts = core.split(".")
    flags = (
        True, "@" in core, "@" in core and "." in core.rpartition("@")[2], 1 <= n <= 2, 3 <= n <= 4, 5 <= n <= 8, 9 <= n <= 12, 13 <= n <= 19, n > 19,
        dots == 3 and all(p.isdigit() for p in parts), dots == 3 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts),
        13 <= n <= 19 and luhn(digits), core.startswith("+"), "(" in token or ")" in token, "-" in core, letters, letters and n > 7,
    )
    return sum(1 << i for i, f in enumerate(flags) if f)


N_SHAPES = 17
#: Pairs of equal labels that skip edges are taken to have shown before any are counted: mentions of one entity agree.
AGREE = 4.0


def keys(token: str, whole: str = "") -> list[str]:
    """What makes two mentions the same: letters and digits without case, the digits alone, or the last digits of a long number.

    whole: the observed span that the token is part of, whose digits count as the token's too.
    """
    core = "".join(c for c in token.lower() if c.isalnum() or c == "@")
    out = [core] if len(core) > 3 and any(c.isdigit() or c == "@" for c in core) else []
    for x in (core, whole):
        digits = "".join(c for c in x if "0" <= c <= "9")
        out += [f"#{digits}"] * (len(digits) > 5) + [f"~{digits[-8:]}"] * (len(digits) > 8)
    return list(dict.fromkeys(out))


class Pairs(Sequence):
    """Pairs of numbers in one array."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> tuple[int, int]:
        return int(self.rows[i, 0]), int(self.rows[i, 1])

    def __add__(self, other: Sequence) -> list[tuple[int, int]]:
        return [*self, *other]


@dataclass
class Graph:
    """Tokens of documents: label (0 none, -1 hidden), shape, and edges between them."""

    owner: Sequence[int]
    spans: Sequence[tuple[int, int]]
    shapes: Sequence[int]
    labels: Sequence[int]
    chain: Sequence[tuple[int, int]]
    skip: Sequence[tuple[int, int]]


def skip_edges(key: np.ndarray, token: np.ndarray, label: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Pairs of tokens with a key in common: each with the next one, hidden ones with the nearest observed on either side.

    key, token: one entry a key of a token. Each pair once, whichever keys make it; neighbours have their chain edge.
    """
    order = np.lexsort((token, key))
    key, token = key[order], token[order]
    at = np.arange(len(key))
    first = np.r_[True, key[1:] != key[:-1]]
    start = np.maximum.accumulate(np.where(first, at, 0))
    known = label[token] >= 0
    before = np.r_[-1, np.maximum.accumulate(np.where(known, at, -1))[:-1]]
    after = np.r_[np.minimum.accumulate(np.where(known, at, len(at))[::-1])[::-1][1:], len(at)]
    same_after = (after < len(at)) & (start[np.minimum(after, len(at) - 1)] == start)
    pairs = [(at[~first] - 1, at[~first]), (before[m := (before >= start) & ~known], at[m]), (at[m := same_after & ~known], after[m])]
    rows = np.concatenate([np.stack([token[i], token[j]], 1) for i, j in pairs])
    rows = np.unique(rows, axis=0)
    return rows[~((rows[:, 0] == rows[:, 1] - 1) & linked[rows[:, 1]])]


def graph(texts: list[str], bases: list[list[Span]], label_free_tokens: int = -1) -> Graph:
    """label_free_tokens: the label of tokens without a base span: hidden, or none when fitting.

    When fitting, tokens that share a key with an observed one are likely mentions that the patterns leave out: they are hidden.
    Everything is kept in flat arrays, some 60 bytes a token.
    """
    owner, spans, shapes, labels, linked = array("i"), array("i"), array("i"), array("i"), array("b")
    skips = []
    for i, (text, base) in enumerate(zip(texts, bases, strict=True)):
        if not SIGNAL.search(text):
            continue
        marks = sorted((s, e, k + 1) for k, s, e in base)
        first, key, token = len(owner), array("q"), array("i")
        at, beside = 0, 0
        for m in TOKEN.finditer(text):
            if not SIGNAL.search(m[0]):
                beside = 0
                continue
            n = len(owner)
            while at < len(marks) and marks[at][1] <= m.start():
                at += 1
            found = [(s, e, k) for s, e, k in marks[at : at + 4] if s < m.end() and e > m.start()]
            owner.append(i)
            spans.extend(m.span())
            shapes.append(shape(m[0]))
            labels.append(found[0][2] if found else label_free_tokens)
            linked.append(beside)
            for k in keys(m[0], text[found[0][0] : found[0][1]] if found else ""):
                key.append(hash(k))
                token.append(n)
            beside = 1
        mine = np.array(labels[first:], np.int32)
        keyed, of = np.array(key, np.int64), np.array(token, np.int64) - first
        if len(keyed):
            edges = skip_edges(keyed, of, mine, np.array(linked[first:], bool))
            skips.append((edges + first).astype(np.int32))
        if label_free_tokens == 0 and len(keyed) and (mine > 0).any():
            order = np.argsort(keyed, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(keyed[order]) != 0])
            likely = np.repeat(np.maximum.reduceat(mine[of[order]], starts) > 0, np.diff(np.r_[starts, len(order)]))
            for j in np.unique(of[order][likely]):
                labels[first + int(j)] = labels[first + int(j)] or -1
    chain = np.flatnonzero(np.array(linked, bool)).astype(np.int32)
    return Graph(
        np.array(owner, np.int32), Pairs(np.array(spans, np.int32).reshape(-1, 2)), np.array(shapes, np.int32), np.array(labels, np.int32),
        Pairs(np.stack([chain - 1, chain], 1)), Pairs(np.concatenate(skips) if skips else np.zeros((0, 2), np.int32)),
    )


@dataclass
class Potentials:
    unary: np.ndarray  # shapes x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray


def bits(shapes: list[int] | np.ndarray) -> np.ndarray:
    return (np.asarray(shapes, np.int64)[:, None] >> np.arange(N_SHAPES) & 1).astype(float)


def fitted(counts: dict[tuple[str, int, int], int]) -> Potentials:
    """Piecewise: counts of (shape, label) and of label pairs on chain and skip edges."""
    n = len(KINDS) + 1
    x = [(a, b, c) for (kind, a, b), c in sorted(counts.items()) if kind == "shape"]
    w = np.zeros((N_SHAPES, n))
    if x:
        f, y, m = bits([a for a, _, _ in x]), np.eye(n)[[b for _, b, _ in x]], np.array([c for _, _, c in x], float)
        m /= m.sum()
        for _ in range(2000):
            p = np.exp(f @ w - (f @ w).max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            w += 1.0 * (f.T @ (m[:, None] * (y - p)) - 1e-4 * w)
    pairs = []
    for kind in ("chain", "skip"):
        t = np.full((n, n), 0.5)
        if kind == "skip":
            t += AGREE * np.eye(n)
        for (k, a, b), c in counts.items():
            if k == kind:
                t[a, b] += c
        t = (t + t.T) / t.sum() if kind == "skip" else t / t.sum()
        t /= t.sum()
        pairs.append(np.clip(np.log(t / np.outer(t.sum(1), t.sum(0))), -4, 4))
    return Potentials(w, *pairs)


def pair_rows(pairs: Sequence[tuple[int, int]]) -> np.ndarray:
    return pairs.rows if isinstance(pairs, Pairs) else np.array(pairs, np.int32).reshape(-1, 2)


def marginals(g: Graph, p: Potentials, rounds: int = 50, damping: float = 0.3, step: int = 1 << 16) -> np.ndarray:
    """Label marginals of every token by loopy sum-product messages over chain and skip edges.

    After the first round only messages whose source has heard something new are sent again, so a document's work follows
    what still changes in it; it ends when nothing moves by 1e-4, or after twice ``rounds`` messages an edge on average.
    Edges keep the kind of their potential, not the potential; messages are made ``step`` at a time.
    """
    n = p.unary.shape[1]
    shapes, at = np.unique(np.asarray(g.shapes), return_inverse=True)
    belief, labels = (bits(shapes) @ p.unary).astype(np.float32)[at], np.asarray(g.labels)
    seen = np.flatnonzero(labels >= 0)
    belief[seen] = -50.0
    belief[seen, labels[seen]] = 0.0
    chain, skip = pair_rows(g.chain), pair_rows(g.skip)
    half = len(chain) + len(skip)
    if half:
        source = np.concatenate([chain[:, 0], skip[:, 0], chain[:, 1], skip[:, 1]])
        target = np.concatenate([source[half:], source[:half]])
        kinds = np.cumsum([0, len(chain), len(skip), len(chain), len(skip)])  # edges of one kind and direction stand together
        tables = [np.exp(t).astype(np.float32) for t in (p.chain, p.skip, p.chain.T, p.skip.T)]
        alone = [len(np.unique(x := target[kinds[k] : kinds[k + 1]])) == len(x) for k in range(4)]  # one edge a target, as in chains
        message = np.zeros((2 * half, n), np.float32)
        whose = np.asarray(g.owner)[source]
        left = 2 * rounds * np.bincount(whose)  # messages each document may send
        live = np.arange(2 * half)
        while len(live):
            change = np.empty((len(live), n), np.float32)
            ends = np.searchsorted(live, kinds)
            for k, table in enumerate(tables):
                for s in range(ends[k], ends[k + 1], step):
                    here = slice(s, min(s + step, ends[k + 1]))
                    e = live[here]
                    into = belief[source[e]] - message[e + half if k < 2 else e - half]
                    into -= into.max(1, keepdims=True)
                    new = np.log(np.exp(into, out=into) @ table)
                    change[here] = (1 - damping) * (new - new.max(1, keepdims=True) - message[e])
            left -= np.bincount(whose[live], minlength=len(left))
            message[live] += change
            for k in range(4):
                here = slice(ends[k], ends[k + 1])
                if alone[k]:
                    belief[target[live[here]]] += change[here]
                else:
                    np.add.at(belief, target[live[here]], change[here])
            moving = np.abs(change).max(1) >= 1e-4 * (1 - damping)
            heard = np.zeros(len(belief), bool)
            heard[target[live[moving]]] = True
            again = heard[source]
            again[live[moving]] = True  # what is damped has not arrived yet
            live = np.flatnonzero(again & (left > 0)[whose])
    belief -= belief.max(1, keepdims=True)
    np.exp(belief, out=belief)
    belief /= belief.sum(1, keepdims=True)
    return belief


def continues(kind: int, text: str) -> bool:
    """Whether adjoining tokens of one kind may be one number."""
    return kind in (2, 3) and sum(c.isdigit() for c in text) <= (19 if kind == 2 else 15)


def portions(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters, a longer text alone."""
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > most:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def added_spans(texts: list[str], bases: list[list[Span]], p: Potentials, threshold: float) -> list[list[Span]]:
    out: list[list[Span]] = []
    for a, b in portions(texts):
        out += added_in(texts[a:b], bases[a:b], p, threshold)
    return out


def added_in(texts: list[str], bases: list[list[Span]], p: Potentials, threshold: float) -> list[list[Span]]:
    g = graph(texts, bases)
    out: list[list[Span]] = [[] for _ in texts]
    if not len(g.owner) or min(g.labels) >= 0:
        return out
    m = marginals(g, p)
    best, linked = m.argmax(1), np.zeros(len(g.owner), bool)
    linked[pair_rows(g.chain)[:, 1]] = True  # to the token before
    previous = -1
    for i in np.flatnonzero((g.labels < 0) & (best > 0) & (m.max(1) >= threshold)).tolist():
        (s, e), kind, text = g.spans[i], int(best[i]) - 1, texts[g.owner[i]]
        token = text[s:e]
        s, e = s + len(token) - len(token.lstrip(".,;:!?*#$%&\"'[]{}<>|")), e - (len(token) - len(token.rstrip(".,;:!?*#$%&\"'[]{}<>|")))
        mine = out[g.owner[i]]
        if mine and previous == i - 1 and linked[i] and mine[-1][0] == kind and continues(kind, text[mine[-1][1] : e]):
            mine[-1] = (kind, mine[-1][1], e)
        elif e > s:
            mine.append((kind, s, e))
        previous = i
    return [without(own, base) for own, base in zip(out, bases, strict=True)]


def without(own: list[Span], base: list[Span]) -> list[Span]:
    """The spans that touch none of base, sorted."""
    if not own or not base:
        return sorted(own)
    marks = sorted((s, e) for _, s, e in base)
    starts, reach = [s for s, _ in marks], list(accumulate((e for _, e in marks), max))
    return sorted(x for x in own if not (k := bisect_left(starts, x[2])) or reach[k - 1] <= x[1])


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 4096) -> Potentials:
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    chosen = rows.select("id").where(F.col("id").isNotNull()).orderBy(F.xxhash64("id"), "id").limit(sample_rows).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for first, last in portions(texts):
                g = graph(texts[first:last], [base_spans(t) for t in texts[first:last]], 0)
                shapes, labels = np.asarray(g.shapes), np.asarray(g.labels)
                total.update(("shape", s, y) for s, y in zip(shapes[labels >= 0].tolist(), labels[labels >= 0].tolist(), strict=True))
                for kind, edges in (("chain", g.chain), ("skip", g.skip)):
                    a, b = labels[pair_rows(edges).T]
                    total.update((kind, x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if min(x, y) >= 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int64()), pa.array([k[2] for k in total], pa.int64()), pa.array(list(total.values()), pa.int64())],
            names=["kind", "a", "b", "n"],
        )

    found = rows.join(F.broadcast(chosen), "id").select("text").mapInArrow(count, "kind string, a long, b long, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    return fitted({(r.kind, r.a, r.b): r.n for r in found.collect()})  # shapes are at most 2**17 and in fact a few dozen


def find(df: DataFrame, p: Potentials, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """For each row: id, counts of base spans by kind, n_added, base and all spans as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            bases = [base_spans(t) for t in texts]
            more = added_spans(texts, bases, p, threshold)
            counts = [pa.array([sum(s[0] == k for s in base) for base in bases], pa.int64()) for k in range(len(KINDS))]
            names = [joined(base) for base in bases]
            every = [joined(sorted(base + own)) if own else name for base, own, name in zip(bases, more, names, strict=True)]
            digests = [hashlib.sha256(name.encode()).hexdigest() for name in names]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *counts, pa.array([len(x) for x in more], pa.int64()), pa.array(names, pa.string()), pa.array(digests, pa.string()), pa.array(every, pa.string())],
                names=["id", *(f"n_{k}" for k in KINDS), "n_added", "base", "base_sha256", "spans"],
            )
        give_back()

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    shape_of = f"id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, n_added long, base string, base_sha256 string, spans string"
    return rows.mapInArrow(run, shape_of).withColumnRenamed("id", id_col)


def op7_personal_data(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return find(docs, learn(docs)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")
