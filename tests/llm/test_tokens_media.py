import hashlib
import tarfile
import zlib

import numpy as np
from public_tokenizers import path
from tokenizers import Tokenizer

from tidyshelf.llm import media, packing, tokens

LIBRARY = Tokenizer.from_file(path("byte_bpe_50k.json"))


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_counts_are_the_library_s(docs, odd, none):
    for df in (docs, odd):
        texts = sorted(((r.doc_id or -1), r.text) for r in df.select("doc_id", "text").collect() if len(r.text or "") < 200_000 or r.doc_id == 7)
        got = sorted(((r.doc_id or -1), r.n_tokens, r.n_bytes, r.over_limit) for r in tokens.count_tokens(df).collect())
        got = [x for x in got if x[0] in {i for i, _ in texts}]
        assert got == [(i, n := len(ids(t)), len((t or "").encode()), n > 1024) for i, t in texts]
    assert tokens.count_tokens(none).count() == 0


def test_long_texts_are_cut_where_the_tokenizer_cuts():
    text = "It's a test, said 12 people; don't.  Two  spaces\nand lines 3.5 <|endoftext|> x. " * 300
    parts = tokens.pieces(text, 100)
    assert "".join(parts) == text and len(parts) > 100 and [x for p in parts for x in ids(p)] == ids(text)
    assert tokens.pieces("x" * 1000, 100) == ["x" * 1000]


def test_other_vocabularies(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    some = docs.limit(20)
    want = {r.doc_id: len(model.encode(r.text)) for r in some.collect()}
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(some, vocabulary="piece_bpe_32k.model").collect()} == want


def test_both_encoders_agree(docs):
    encode = packing.encoder()
    for r in docs.collect():
        assert encode(r.text).tolist() == ids(r.text)
    for text in ("<|endoftext|>", "a<|endoftext|>b   x", "naïve Ærø ½ ² \x85 \x1c", "日本", "  a\n\n b\t", "I'LL don't 'S"):
        assert encode(text).tolist() == ids(text)


def test_media_round_trip(spark, odd, none, tmp_path):
    folder = f"file://{tmp_path}/media"
    manifest = media.write_media(odd, folder, shard_bytes=20_000)
    rows = media.with_media_features(media.with_media_header(manifest, folder), folder).collect()
    texts = sorted((r.doc_id or -1, (r.text or "").encode()) for r in odd.collect())
    assert len(rows) == len(texts)
    for r, (i, raw) in zip(sorted(rows, key=lambda r: r.doc_id or -1), texts, strict=True):
        payload = raw + bytes((-len(raw) % 64) or (0 if raw else 64))
        assert (r.doc_id or -1, r.n_bytes, r.payload_bytes, r.width, r.height, r.bits) == (i, len(raw), len(payload), 64, len(payload) // 64, 8)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        with tarfile.open(tmp_path / "media" / r.shard) as t:
            data = {m.name: (m.offset_data, m.size) for m in t.getmembers()}
        assert data[f"{r.media_sha256}.png"] == (r.offset, r.length)
    same = {r.doc_id: (r.media_sha256, r.feature) for r in rows}
    assert same[5] == same[6] and same[1] == same[2] and same[4] != same[5]
    empty = f"file://{tmp_path}/empty"
    assert media.with_media_features(media.write_media(none, empty), empty).count() == 0


def test_png_damage_is_noticed():
    data = bytearray(media.to_png(bytes(range(64)) * 2, 6))
    assert media.from_png(bytes(data)).tobytes() == bytes(range(64)) * 2
    data[50] ^= 1
    try:
        media.from_png(bytes(data))
        raise AssertionError("not noticed")
    except (ValueError, zlib.error):
        pass


def test_packing_covers_every_id_once(docs, odd, none):
    for df in (docs, odd):
        got = packing.pack(df, buckets=4).collect()
        by_sequence, by_doc = {}, {}
        for r in got:
            by_sequence.setdefault(r.sequence_id, []).append(r)
            by_doc.setdefault((r.doc_id, r.sequence_id) if r.doc_id in (11,) else r.doc_id, []).append(r)
        for rows in by_sequence.values():
            rows.sort(key=lambda r: r.offset)
            assert sum(r.length for r in rows) <= 2048 and [r.offset for r in rows] == [sum(x.length for x in rows[:i]) for i in range(len(rows))]
        total = sum(r.length for r in got)
        padding = sum(2048 - n for n in (sum(r.length for r in rows) for rows in by_sequence.values()) if n & (n - 1))
        assert padding < 0.02 * total + 4096
        for r in df.where("doc_id in (0, 1, 2, 3, 4, 7, 8, 9, 13)").select("doc_id", "text").collect():
            every = np.array([*ids(r.text), 1], "<u4")
            for p in by_doc[r.doc_id]:
                assert p.doc_tokens == len(every) and p.ids_crc32 == zlib.crc32(every[p.start : p.start + p.length].tobytes())
            assert sum(p.length for p in by_doc[r.doc_id]) == len(every)
    assert packing.pack(none).count() == 0


def test_plans_hold_exactly_the_histogram():
    rng = np.random.default_rng(5)
    for n in (1, 7, 300, 20_000):
        sizes, counts = np.unique(np.clip(rng.lognormal(4, 0.8, n).astype(int), 1, 256), return_counts=True)
        histogram = dict(zip(sizes.tolist(), counts.tolist(), strict=True))
        patterns, held = packing.plan(histogram, 256), {}
        for pattern, k in patterns:
            assert sum(s * a for s, a in pattern.items()) <= 256
            for s, a in pattern.items():
                held[s] = held.get(s, 0) + a * k
        used, least = sum(k for _, k in patterns), -(-sum(s * c for s, c in histogram.items()) // 256)
        assert held == histogram and used <= 1.01 * least + 3
    assert packing.plan({}, 256) == []


def test_best_pattern_is_the_best():
    from itertools import product

    sizes, values = np.array([3, 5, 7]), np.array([0.31, 0.5, 0.74])
    best = max(sum(a * v for a, v in zip(x, values, strict=True)) for x in product(range(7), repeat=3) if sum(a * s for a, s in zip(x, sizes, strict=True)) <= 20)
    value, pattern = packing.best_pattern(sizes, values, 20)
    assert abs(value - best) < 1e-9 and abs((pattern * values).sum() - best) < 1e-9 and (pattern * sizes).sum() <= 20
