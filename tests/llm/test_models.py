import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidyshelf.llm import language, personal, toxicity
from tidyshelf.llm.bytesview import gram_counts


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def held(i, k):
    return zlib.crc32(str(i).encode()) % k


def test_predictions_equal_plain_python(spark):
    """The whole query's decoding against n-grams, scaling and losses written out; a namesake's label is not learned."""
    rng = np.random.default_rng(2)
    words = {"aa": "lorem ipsum dolor amet".split(), "bb": "quick brown foxes jump".split(), "cc": "zwei drei vier fünf".split()}
    rows = [(i, " ".join(rng.choice(words[lang], 12)), lang) for i in range(120) for lang in [list(words)[i % 3]]]
    rows += [(i, "зовсім інше тут", None) for i in range(0, 120, 7)] + [(500, "lorem vier quick", None), (501, "12 !!", None), (502, None, "aa"), (503, "fünf " * 40_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    book = language.learn(df)
    assert book.languages == ["aa", "bb", "cc"]

    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language.predict(df, book).join(df.select("doc_id", "text").distinct(), "doc_id").collect()}
    for doc_id, text, _ in rows:
        raw = pa.array([f" {(text or '').lower()} ".encode()], pa.binary())
        [(_, _, counts)] = list(gram_counts(raw, language.SIZES, language.BITS))
        x = [float(c) ** 0.5 for c in counts[0]]
        length = sum(v * v for v in x) ** 0.5 or 1.0
        losses = []
        for word in book.code:
            margins = [sum(v / length * float(w) for v, w in zip(x, book.weights[:, k], strict=True) if v) + float(book.bias[k]) for k in range(len(word))]
            losses.append(sum(np.log1p(np.exp(-b * m)) for b, m in zip(word, margins, strict=True)))
        share = [np.exp(min(losses) - v) for v in losses]
        if not any(c.isalpha() for c in text or ""):
            continue
        if sum(1 for r in rows if r[0] == doc_id) == 1:
            pred, score = got[doc_id, text]
            assert pred == book.languages[int(np.argmin(losses))] and abs(score - 1 / sum(share)) < 1e-4


def test_languages_of_held_out_rows(larger, odd, none):
    book = language.learn(larger)
    found = {r.doc_id: r for r in language.predict(larger, book).collect()}
    tested = [(r.lang, found[r.doc_id].lang_pred) for r in larger.collect() if held(r.doc_id, 4) == 2]
    assert len(tested) > 150 and np.mean([a == b for a, b in tested]) > 0.97
    rows = language.predict(odd, book).collect()
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 10)} == dict.fromkeys((1, 2, 3, 10), "und") and all(0 <= r.score <= 1 for r in rows)
    assert language.predict(none, book).count() == 0
    unknown = language.learn(none)
    assert {r.lang_pred for r in language.predict(odd, unknown).collect()} == {"und"}
    only = language.learn(larger.where("lang = 'fr'"))
    assert {r.lang_pred for r in language.predict(larger.limit(5), only).collect()} == {"fr"}


def test_every_label_is_a_language(spark, none):
    """70 languages of their own letters; none is left out, however many there are."""
    rng = np.random.default_rng(4)
    rows = []
    for lang in range(70):
        letters = rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6, replace=False)
        for _ in range(30):
            rows.append((len(rows), " ".join("".join(rng.choice(letters, 5)) for _ in range(40)), f"l{lang:02}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    book = language.learn(df, sample_rows=1000)
    assert len(book.languages) == 70
    found = {r.doc_id: r.lang_pred for r in language.predict(df, book).collect()}
    assert np.mean([found[i] == lang for i, _, lang in rows if held(i, 4) == 2]) > 0.9


def test_fit_does_not_depend_on_slices():
    rng = np.random.default_rng(1)
    x, y = rng.random((50, 16)).astype(np.float32), np.sign(rng.normal(size=(50, 3))).astype(np.float32)
    sparse = lambda step: language.Sparse(np.tile(np.arange(16, dtype=np.int16), 50), x.ravel(), np.arange(0, 801, 16), 16, step)
    (w, b), (v, c) = language.fitted(sparse(64), y), language.fitted(sparse(7), y)
    assert np.allclose(w, v, atol=1e-3) and np.allclose(b, c, atol=1e-3)


def test_codewords_lie_apart():
    for n in (2, 3, 4, 5, 12, 40):
        code = language.codewords(n)
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * 1e9
        assert apart.min() >= (1 if n == 2 else 2 if n == 3 else 4)


def test_grams_do_not_depend_on_stretches(monkeypatch):
    import pyarrow as pa

    from tidyshelf.llm import bytesview

    texts = pa.array([b" ab cd ", b" " + b"hello world " * 400, b"  ", b" x "], pa.binary())
    whole = np.concatenate([c for _, _, c in bytesview.gram_counts(texts, (1, 2, 3), 8)])
    words = [w.tolist() for w in bytesview.WordHasher(bytesview.separators(False), (3,)).texts(texts)]
    monkeypatch.setattr(bytesview, "CHUNK", 64)
    assert (np.concatenate([c for _, _, c in bytesview.gram_counts(texts, (1, 2, 3), 8)]) == whole).all()
    again = [w.tolist() for w in bytesview.WordHasher(bytesview.separators(False), (3,)).texts(texts)]
    assert [sorted(w) for w in again] == [sorted(w) for w in words] and len(set(words[1])) == 4 and words[2] == []


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(6)
    popularity = 1 / np.arange(1, 301)

    def vectors(n):
        rows = [np.sort(rng.choice(300, rng.integers(0, 25), replace=False, p=popularity / popularity.sum())) for _ in range(n)]
        text, term = np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate(rows)
        return toxicity.weighted(text, term, rng.integers(1, 9, len(text)), weight, n)

    def dense(v, n):
        out = np.zeros((n, 300))
        out[v[0], v[1]] = v[2]
        return out

    weight = rng.random(300)
    for n in (1, 90, 700):
        held, asked = vectors(n), vectors(200)
        at, cosine = toxicity.Postings(held, n, 300).nearest(asked, 200, 15)
        every = np.rint(dense(asked, 200) @ dense(held, n).T * toxicity.PARTS) / toxicity.PARTS
        for row, a, c in zip(every, at, cosine, strict=True):
            best = np.sort(row[row > 0])[::-1][:15]
            assert np.allclose(c[: len(best)], best, atol=3e-6) and (a[len(best) :] == -1).all() and len(set(a[: len(best)])) == len(best) and np.allclose(row[a[: len(best)]], best, atol=3e-6)


def test_rows_of_large_groups_change_nothing(monkeypatch):
    """Whether what a term has in a block is taken as a row or posting by posting; rows are made where they are used."""
    rng = np.random.default_rng(7)
    text, term = np.divmod(np.unique(rng.integers(0, 600 * 400, 20_000)), 400)
    held = toxicity.weighted(text, term, rng.integers(1, 9, len(text)), rng.random(400), 600)
    asked = tuple(x[held[0] < 100] for x in held)
    found = []
    for least in (1, 6, 1000):
        monkeypatch.setattr(toxicity, "OWN_ROW", least)
        postings = toxicity.Postings(held, 600, 400)
        assert postings.own is None
        found.append(postings.nearest(asked, 100, 15))
        assert len(postings.own) == (postings.many >= least).sum()
    assert len(found[0][0]) == 100 and all(np.allclose(c, found[0][1], atol=3e-6) for _, c in found)
    assert all((a[:, 0] == np.arange(100)).all() for a, _ in found)


def test_the_whole_query_equals_brute_force(spark, larger):
    """Neighbours and votes from plain dictionaries over every word and stem of the texts."""
    docs, marks = larger.where("doc_id < 500"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("doc_id < 500")
    index = toxicity.learn(docs, marks)
    texts = {r.doc_id: (r.text or "").lower().encode() for r in docs.collect()}

    def terms(raw):
        words = re.findall(rb"(?:[0-9a-z]|[\x80-\xff])+", raw)
        return Counter([(0, w) for w in words] + [(k, w[:k]) for k in toxicity.STEMS for w in words if len(w) > k])

    bags = {i: terms(t) for i, t in texts.items()}
    label = {}
    for r in marks.collect():
        label[r.doc_id] = max(label.get(r.doc_id, 0), r.toxic)
    examples = sorted(i for i in label if i in texts and held(i, 3) != 1)
    assert index.ids == examples
    n1 = sum(label[i] for i in examples)
    n0, n = len(examples) - n1, len(examples)
    df = Counter(t for b in bags.values() for t in b)
    a, b = (Counter(t for i in examples if label[i] == y for t in bags[i]) for y in (1, 0))
    s1, s0 = toxicity.PRIOR * n1 / n, toxicity.PRIOR * n0 / n
    weight = {t: np.log((1 + len(texts)) / (1 + df[t])) * abs(np.log((a[t] + s1) / (n1 + s1)) - np.log((b[t] + s0) / (n0 + s0))) for t in a | b}
    assert len(weight) == len(index.terms)

    def vector(bag):
        v = {t: (1 + np.log(c)) * weight[t] for t, c in bag.items() if weight.get(t, 0) > 0}
        length = sum(x * x for x in v.values()) ** 0.5
        return {t: x / length for t, x in v.items()}

    vectors = {i: vector(bags[i]) for i in examples}
    got = {r.doc_id: r for r in toxicity.score(docs, index, shown=15).collect()}
    for i in sorted(texts)[::7]:
        v = vector(bags[i])
        cosine = {e: sum(x * w.get(t, 0.0) for t, x in v.items()) for e, w in vectors.items()}
        best = sorted(cosine.values(), reverse=True)[:15]
        near = got[i].evidence
        assert np.allclose([cosine[e] for e in near], [c for c in best if c > 1e-6], atol=1e-5)
        if near:
            vote = sum(cosine[e] * label[e] for e in near) / sum(cosine[e] for e in near)
            assert abs(got[i].score - index.levels[max(np.searchsorted(index.steps, vote, "right") - 1, 0)]) < 1e-9 or np.abs(index.steps - vote).min() < 1e-4


def test_monotone_fit():
    steps, levels = toxicity.monotone(np.array([0.1, 0.2, 0.2, 0.5, 0.9]), np.array([0, 1, 0, 0, 1.0]), np.ones(5))
    assert (np.diff(levels) > 0).all() and steps[0] == 0.1


def test_toxic_rows_held_out(spark, larger, odd, none):
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    index = toxicity.learn(larger, marks)
    score = {r.doc_id: r.score for r in toxicity.score(larger, index).collect()}
    english = {r.doc_id for r in larger.where("lang = 'en'").collect()}
    rows = [(r.toxic, score[r.doc_id], r.doc_id in english) for r in marks.collect() if held(r.doc_id, 3) == 1]
    assert np.mean([s >= 0.7 for t, s, e in rows if t and e]) > 0.8 and np.mean([s >= 0.7 for t, s, _ in rows if t]) > 0.7 and np.mean([s >= 0.7 for t, s, _ in rows if not t]) < 0.02
    rows = toxicity.score(odd, index).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows) and toxicity.score(none, index).count() == 0
    named = larger.limit(300).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    named_marks = marks.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {type(i) for r in toxicity.score(named, toxicity.learn(named, named_marks)).collect() for i in r.evidence} == {str}
    nothing = toxicity.learn(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(odd, nothing).collect()} == {0.0}


def plain_spans(x):
    """The contract's patterns as they stand."""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(d[::-1])) % 10 == 0
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_follow_the_patterns(docs):
    rng = np.random.default_rng(9)
    texts = [r.text or "" for r in docs.collect()]
    texts += ["".join(rng.choice(list("ab1234567890.@+- ()\n"), 60)) for _ in range(3000)] + ["1.2.3.4.5.6.7.8", "a@b@c.d", "@a.b", "000255.1.1.1", "4111 1111 1111 1111", "x@y..z", "a@b.c.d@e.f"]
    for t in texts:
        assert personal.base_spans(t) == plain_spans(t)


def test_mentions_far_apart_get_one_label():
    """An observed number labels its later mention in another form; without the skip edge nothing is added."""
    long, short = personal.shape("4111111111111111"), personal.shape("9999")
    counts = {("shape", long, 3): 5, ("shape", long, 0): 6, ("shape", short, 0): 50, ("skip", 3, 3): 40, ("skip", 0, 0): 40, ("chain", 0, 0): 20, ("chain", 3, 0): 5, ("chain", 0, 3): 5}
    text = "pay 4111-1111-1111-1111 then " + "filler " * 500 + "again 4111111111111111 9999 ok"
    base = personal.base_spans(text)
    at = text.index("4111111111111111")
    assert base == [(2, 4, 23)] and personal.added_spans([text], [base], personal.fitted(counts), 0.5) == [[(2, at, at + 16)]]
    alone = text[24:]
    assert personal.added_spans([alone], [[]], personal.fitted(counts), 0.5) == [[]]


def test_an_observed_mention_reaches_all_others_whatever_stands_beside():
    long, short = personal.shape("4111111111111111"), personal.shape("9999")
    counts = {("shape", long, 3): 5, ("shape", long, 0): 6, ("shape", short, 0): 50, ("skip", 3, 3): 40, ("skip", 0, 0): 40, ("chain", 0, 0): 20, ("chain", 3, 0): 5, ("chain", 0, 3): 5}
    p = personal.fitted(counts)
    hidden, seen = "again 4111111111111111 9999 ok " + "filler " * 5, "pay 4111-1111-1111-1111 then "
    for text in (seen + hidden * 150, hidden * 150 + seen):
        base = personal.base_spans(text)
        g = personal.graph([text], [base])
        m = personal.marginals(g, p)
        assert len(base) == 1 and len(personal.added_spans([text], [base], p, 0.5)[0]) == 150
        other = "call 4111111111111111 9999 now"
        both = personal.marginals(personal.graph([other, text], [personal.base_spans(other), base]), p)
        assert (both[:2] == personal.marginals(personal.graph([other], [personal.base_spans(other)]), p)).all() and (both[2:] == m).all()


def test_each_pair_of_tokens_has_one_edge():
    text = "4111111111111111 4111111111111111 4111-1111-1111-1111 word 4111111111111111 a4111111111111111 4111111111111111"
    for base in ([], personal.base_spans(text)):
        g = personal.graph([text], [base])
        pairs = [tuple(sorted(e)) for e in g.chain + g.skip]
        assert len(set(pairs)) == len(pairs) and g.chain and g.skip


def test_planted_variants_of_mentions(spark):
    """Numbers that a base pattern finds once and misses in a later form; other numbers beside them are to be left alone."""
    rng = np.random.default_rng(3)
    rows, wanted = [], {}
    filler = "the report of that week was long and nobody read it to the end".split()
    for i in range(400):
        d = "".join(rng.choice(list("0123456789"), 9))
        phone, variant = f"+1 ({d[:3]}) {d[3:6]}-{d[6:]}", f"1{d[:3]}{d[3:6]}{d[6:]}"
        other = "".join(rng.choice(list("123456789"), int(rng.integers(1, 5))))
        words = [*rng.choice(filler, 30), "call", phone, *rng.choice(filler, 30)]
        if i % 2:
            words += ["or", variant, *rng.choice(filler, 30)]
        words += ["item", other, *rng.choice(filler, 9)]
        text = " ".join(words)
        if i % 2:
            wanted[i] = (3, text.index(f" {variant} ") + 1, text.index(f" {variant} ") + 1 + len(variant))
        rows.append((i, text))
    texts = [t for _, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    added = personal.added_spans(texts, [personal.base_spans(t) for t in texts], personal.learn(df), 0.5)
    found = {(i, s) for i, spans in enumerate(added) for s in spans}
    right = sum((i, s) in found for i, s in wanted.items())
    assert right >= 0.9 * len(wanted) and right >= 0.9 * max(1, len(found))


def test_messages_equal_enumeration_on_a_tree():
    rng = np.random.default_rng(1)
    p = personal.Potentials(rng.normal(size=(personal.N_SHAPES, 5)), rng.normal(size=(5, 5)), np.ones((5, 5)))
    g = personal.Graph([0] * 4, [(0, 1)] * 4, [1, 3, 5, 9], [-1, -1, 2, -1], [(0, 1), (1, 2), (1, 3)], [])
    from itertools import product

    unary, total = personal.bits(g.shapes) @ p.unary, np.zeros((4, 5))
    for y in product(range(5), repeat=4):
        if y[2] == 2:
            w = np.exp(sum(unary[i, y[i]] for i in range(4)) + sum(p.chain[y[i], y[j]] for i, j in g.chain))
            for i in range(4):
                total[i, y[i]] += w
    assert np.allclose(personal.marginals(g, p, rounds=500), total / total.sum(1, keepdims=True), atol=1e-3)


def test_long_texts_of_numbers_take_little_memory():
    """Some hundreds of bytes a token, and the same spans whatever stands beside the text."""
    import tracemalloc

    rng = np.random.default_rng(6)
    text = "mail jo.81@mail7.example.com or 4111-1111-1111-1111 then " + " ".join(map(str, rng.integers(0, 10**7, 40_000))) + " again 4111111111111111 9999 x"
    base = personal.base_spans(text)
    long, short = personal.shape("4111111111111111"), personal.shape("9999")
    p = personal.fitted({("shape", long, 3): 5, ("shape", long, 0): 6, ("shape", short, 0): 50, ("skip", 3, 3): 40, ("skip", 0, 0): 40, ("chain", 0, 0): 20, ("chain", 3, 0): 5, ("chain", 0, 3): 5})
    tracemalloc.start()
    added = personal.added_spans([text], [base], p, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 600 * 40_000 and [text[s:e] for _, s, e in added[0]] == ["4111111111111111"]
    other = "call 12345 or 4111111111111111"
    assert personal.added_spans([other, text, other], [personal.base_spans(other), base, personal.base_spans(other)], p, 0.5)[1] == added[0]


def test_personal_data_of_odd_rows(docs, odd, none):
    p = personal.learn(docs)
    rows = {r.doc_id: r for r in personal.find(odd, p).collect()}
    assert (rows[13].n_email, rows[13].n_phone, rows[1].n_email, rows[1].spans) == (1, 1, 0, "") and rows[13].spans.startswith("email:9:32,phone:36:53")
    assert personal.find(none, personal.learn(none)).count() == 0
