import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidyshelf.llm import bestfit
from tidyshelf.llm.tokens import vocabulary_path


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(vocabulary_path(bestfit.VOCABULARY))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def held(got, df, library, capacity):
    """Every id in one piece, pieces as the rule cuts them, sequences gapless and within capacity; how many there are."""
    of_id, seen, sequences = defaultdict(Counter), Counter(), defaultdict(list)
    for r in df.collect():
        ids = np.array([*library(r.text or ""), 0], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            piece = ids[at : at + capacity]
            of_id[r.doc_id][(k, at, len(piece), zlib.crc32(piece.tobytes()))] += 1
    for r in got:
        seen[r.doc_id] += 1
        assert of_id[r.doc_id][(r.piece, r.start, r.length, r.ids_crc32)] > 0
        of_id[r.doc_id][(r.piece, r.start, r.length, r.ids_crc32)] -= 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert all(n == 0 for c in of_id.values() for n in c.values())
    for held_pieces in sequences.values():
        at = 0
        for offset, length in sorted(held_pieces):
            assert offset == at
            at += length
        assert 0 < at <= capacity
    return len(sequences)


def test_packing(spark, docs, odd, none, library):
    for df in (docs, odd):
        got = bestfit.pack(df).collect()
        n = held(got, df, library, 2048)
        assert n <= -(-sum(r.length for r in got) // 2048) + 1
    assert bestfit.pack(none).count() == 0


def test_many_rounds(spark, docs, library):
    """Buckets of few rows, so that rests are dealt several times, and a third of all rows without an id."""
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(None, f"w{i} " * (i % 90)) for i in range(100)], "doc_id long, text string"))
    for rounds in (1, 3, 8):
        got = bestfit.pack(df, capacity=512, per_bucket=20, most_rounds=rounds).collect()
        n = held(got, df, library, 512)
    assert n <= 1.01 * sum(r.length for r in got) / 512 + 2


def test_the_rule():
    """Each length goes where the sum of squares becomes smallest, by trying all places."""
    rng = random.Random(5)
    for _ in range(30):
        capacity = rng.choice((5, 12, 40))
        lengths = [rng.randrange(1, capacity + 1) for _ in range(60)]
        bins, offsets, fills = bestfit.sum_of_squares(np.array(lengths), capacity)
        now: list[int] = []
        for s, b, offset in zip(lengths, bins.tolist(), offsets.tolist(), strict=True):

            def squares(fill):
                return sum(n * n for gap, n in Counter(capacity - f for f in fill).items() if gap > 0)

            choices = [(squares([*now[:i], f + s, *now[i + 1 :]]), 0, capacity - f - s) for i, f in enumerate(now) if f + s <= capacity and f < capacity]
            choices.append((squares([*now, s]), 1, capacity - s))
            if b == len(now):
                now.append(0)
                chosen = (squares([*now[:-1], s]), 1, capacity - s)
            else:
                chosen = (squares([*now[:b], now[b] + s, *now[b + 1 :]]), 0, capacity - now[b] - s)
            assert chosen == min(choices) and offset == now[b]
            now[b] += s
        assert now == fills.tolist()


def test_ids_are_the_librarys(library):
    rng = random.Random(3)
    alphabet = [*"abC'd sStTrReE mMlL  \n\t09.,!?()-_|<>", "é", "İ", "ß", "ǅ", "²", "½", "\xa0", "\x85", "\x1c", "\x00", "\x7f", "é", "日本。語", "🙂", "Σ", "<|endoftext|>", "'ve", "ª"]
    encode = bestfit.encoder()
    for n in range(600):
        text = "".join(rng.choice(alphabet[: 60 if n % 2 else 36]) for _ in range(rng.randrange(120)))
        for most in (1, 7, 1000):
            assert [i for p in bestfit.pieces(text, most) for i in encode(p)] == library(text), repr(text)
    long = "x" * 5000 + " " + "7" * 5000
    assert encode(long).tolist() == library(long)


def test_words_are_kept_within_bounds(monkeypatch):
    monkeypatch.setattr(bestfit, "MOST_WORDS", 10)
    words = bestfit.Words(lambda w: np.array([len(w)], "<u4"))
    assert [words[f"w{i}"] for i in range(100)] == [words[f"w{i}"] for i in range(100)]
    assert len(words) <= 10 and words["y" * 100] and "y" * 100 not in words
