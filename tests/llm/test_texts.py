"""Operators on single documents and their order."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewright.llm import digest, flat, langid, mixing, packing, quality, tokenfile
from tidewright.llm.queries import quality_weights

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def brute_counts(text: bytes) -> np.ndarray:
    counts = np.zeros(digest.BUCKETS, int)
    for salt, (i, j, k) in enumerate(digest.TRIPLETS):
        for e in range(k, len(text)):
            v = text[e - i] | text[e - j] << 8 | text[e - k] << 16
            v = ((v + (salt + 1) * 0x01000193) * 0x9E3779B1) & 0xFFFFFFFF
            v = ((v ^ v >> 15) * 0x85EBCA6B) & 0xFFFFFFFF
            counts[v >> 24] += 1
    return counts


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 63, 64, 65, 66, 67, 130, 700])
def test_bucket_counts_over_block_edges(monkeypatch, n):
    monkeypatch.setattr(digest, "BLOCK", 64)
    text = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
    assert (digest.bucket_counts(text) == brute_counts(text)).all()


def test_likeness_is_bounded_and_reflexive():
    a, b = digest.digest(b"some words of a text " * 9), digest.digest(bytes(range(256)) * 40)
    assert digest.likeness(a, a) == 1.0 and 0.0 <= digest.likeness(a, b) < 0.5 and digest.likeness(a, b) == digest.likeness(b, a)


def test_compare_with_next_by_brute_force(odd, none):
    rows = [(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(text) // 3
        mixed = text[: len(text) - n] + following[:n]
        own, theirs, changed = (digest.digest(x.encode()) for x in (text, following, mixed))
        want.append((i, len(text), hashlib.sha256(mixed.encode()).hexdigest(), own.hex(), changed.hex(), digest.likeness(own, changed), digest.likeness(own, theirs)))
    got = [tuple(r) for r in digest.compare_with_next(odd).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert digest.compare_with_next(none).count() == 0 and digest.fingerprint_documents(odd).count() == odd.count()


def test_token_files_round_trip(odd, none, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    rows = sorted(((r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for i, text in rows:
        ids = [*whole.encode(text, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    manifest = tokenfile.write_token_files(odd, TOKENIZER, 2, length=16)
    got = sorted((tuple(r) for r in tokenfile.read_token_files(manifest).collect()), key=lambda r: r[1])
    assert got == want
    assert tokenfile.read_token_files(tokenfile.write_token_files(none, TOKENIZER, 2)).count() == 0


def test_sequences_are_views(tmp_path):
    path = str(tmp_path / "a.arrow")
    with pa.OSFile(path, "wb") as sink:
        writer = tokenfile.SequenceWriter(sink, "<u2", 8)
        writer.add(np.arange(8 * tokenfile.ROWS + 3, dtype="<u2"))
        writer.close()
    before = pa.total_allocated_bytes()
    file = tokenfile.SequenceFile(pa.memory_map(path))
    assert file.sequence(1).tolist() == list(range(8, 16)) and not file.sequence(1).flags.owndata
    assert pa.total_allocated_bytes() == before
    assert file.mask(tokenfile.ROWS).to_pylist() == [True] * 3 + [False] * 5
    assert np.concatenate(list(file.ids(5, 8 * tokenfile.ROWS - 2))).tolist() == list(range(5, 8 * tokenfile.ROWS + 3))
    with pytest.raises(ValueError):
        list(file.ids(8 * tokenfile.ROWS, 4))


def pieces_hold(tokens, loss, found, length, segments, most_loss):
    by_example, by_sequence = {}, {}
    for e, start, n, s, offset in found:
        assert n > 0
        by_example.setdefault(e, []).append((start, n))
        by_sequence.setdefault(s, []).append((offset, n, max(0, start + n - max(start, tokens[e] - loss[e]))))
    for e, n in enumerate(tokens):
        at = 0
        for start, k in sorted(by_example.get(e, [])):
            assert start == at
            at += k
        assert at == n
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, n, _ in sorted(parts):
            assert offset == at
            at += n
        assert at <= length and len(parts) <= segments and sum(p[2] for p in parts) <= most_loss
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding


@pytest.mark.parametrize("seed", range(6))
def test_packing_keeps_every_limit(seed):
    rng = np.random.default_rng(seed)
    tokens = np.minimum(1 + rng.pareto(1, 400) * 30, 5000).astype(int)
    loss = (tokens * rng.random(400)).astype(int) if seed % 2 else tokens
    segments, most_loss = (8, 100) if seed % 2 else (256, 256)
    found = packing.pack(tokens, loss, 256, segments, most_loss)
    padding = pieces_hold(tokens, loss, found, 256, segments, most_loss)
    if not seed % 2:
        assert padding <= 256


def test_packing_keeps_what_it_placed(monkeypatch):
    rng = np.random.default_rng(0)
    tokens = np.maximum(1, np.exp(rng.normal(np.log(200), 1, 1500))).astype(int)
    placed, fill = [], packing._without_gaps
    monkeypatch.setattr(packing, "_without_gaps", lambda pieces, *limits: placed.extend(pieces) or fill(pieces, *limits))
    found = packing.pack(tokens)
    assert pieces_hold(tokens, tokens, found, packing.LENGTH, packing.SEGMENTS, packing.LENGTH) == 0
    assert sum(p[2] for p in set(placed) - set(found)) < 0.1 * tokens.sum()


def test_pack_documents_and_conversations(spark, odd, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    found = packing.pack_documents(odd, TOKENIZER, 1, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in found)
    totals = {}
    for r in found:
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r.length
    want = {}
    for r in odd.collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1
    assert totals == want and packing.pack_documents(none, TOKENIZER, 1).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", "what is it"), (1, 1, "assistant", "it is a ship"), (2, 0, "user", None)], "conv_id long, turn long, role string, text string")
    got = packing.pack_conversations(turns, TOKENIZER, 1).collect()
    assert sum(r.length for r in got) == 3 + 4 + 1 + 1 and sum(r.loss for r in got) == 5


def test_word_hashes_agree_with_words():
    texts = ["Hello  world ", None, "", "hello", " a b\tc HELLO", "x" * 70_000 + " y", "É é"]
    (first, raw, starts), = flat.blocks(pa.array(texts))
    hashes, at = flat.words(raw, starts)
    want = [w for t in texts for w in (t or "").encode().lower().split()]
    assert first == 0 and len(hashes) == len(want) and np.diff(at).tolist() == [len((t or "").split()) for t in texts]
    assert len(set(zip(hashes.tolist(), want, strict=True))) == len(set(hashes.tolist())) == len(set(want))


def test_languages(spark, odd, none):
    rows = [(i, t, g, "s", 0, 0.0, "", "") for i, (t, g) in enumerate([("the ship and the sea are there when they say the weather is fair", "en"), ("das Schiff und die See sind dort wenn man sagt das Wetter ist gut", "de")] * 20)]
    filters = langid.train(spark.createDataFrame(rows, odd.schema))
    got = {(r.doc_id, r.lang_pred, r.score > 0) for r in langid.predict(odd, filters).collect()}
    assert {(3, "und", False), (4, "und", False), (5, "und", False), (7, "und", False), (6, "de", True), (1, "en", True)} <= got
    assert {r.lang_pred for r in langid.predict(odd, langid.train(none)).collect()} == {"und"}
    assert langid.predict(none, filters).count() == 0
    grams = flat.grams(np.frombuffer(b"the ship and the sea", np.uint8))
    assert (filters.masks(grams)[0] >> filters.languages.index("en") & 1).mean() > 0.6  # what was put in is found
    assert 0 <= filters.false.max() < 0.05


def test_more_languages_than_a_word_holds(spark):
    rng = np.random.default_rng(0)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 8)) for _ in range(210)]
    rows = [(i, " ".join(words[i * 3 : i * 3 + 3] * 5), f"l{i:02d}") for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(docs, langid.train(docs), "lang").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 60


def test_resampling(spark, odd, none, labels):
    got = quality.resample(odd, labels)
    assert got.count() == odd.count() and quality.resample(none, labels).count() == 0
    kept = quality.keep(odd, labels)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got.where("kept").collect())
    assert quality.keep(odd, labels.where("quality = 9")).count() == odd.count()
    values = spark.range(1000).select((F.col("id") * 7919 % 1000).cast("double").alias("v"))
    assert [quality.kth_largest(values, "v", k) for k in (1, 2, 500, 999, 1000, 5000)] == [999, 998, 500, 1, 0, 0]
    ties = spark.createDataFrame([(1.0,)] * 5 + [(2.0,)] * 5, "v double")
    assert [quality.kth_largest(ties, "v", k) for k in (1, 5, 6, 10)] == [2.0, 2.0, 1.0, 1.0]


def test_resampling_weights_by_brute_force(spark):
    good, bad = "the ship sails sails on the calm sea", "$$$ buy %%% now now &&& win $$$"
    docs = spark.createDataFrame([(i, good if i % 3 else bad) for i in range(60)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.resample(docs, spark.createDataFrame([(i, 1) for i in range(60) if i % 3], "doc_id long, quality int")).collect()}
    assert all(got[i].kept == bool(i % 3) for i in range(60))
    target = [i for i in range(60) if i % 3 and zlib.crc32(str(i).encode()) % quality.FOLDS != quality.HELD]

    def found(text):
        words = text.split()
        same = [0, *(a == b for a, b in zip(words, words[1:], strict=False))]
        patterns = [quality.BUCKETS + sum(same[i - k] << k for k in range(quality.N) if i - k >= 0) for i in range(len(words))]
        return np.concatenate([quality.buckets(np.frombuffer(text.encode(), np.uint8)), patterns]).astype(int)

    count = lambda ids: sum((np.bincount(found(good if i % 3 else bad), minlength=quality.ALL) for i in ids), np.zeros(quality.ALL))
    ratios = quality.log_ratios(np.stack([count(range(60)), count(target)]))
    for i, text in ((0, bad), (1, good)):
        assert abs(got[i].log_weight - ratios[found(text)].sum()) < 1e-5 and abs(got[i].key - got[i].log_weight) < 40
    labels = spark.createDataFrame([(i, 1) for i in range(60) if i % 3], "doc_id long, quality int")
    mean = {r.doc_id: r.log_weight for r in quality.resample(docs, labels, temperature=0.01, mean=True).collect()}
    assert all(abs(mean[i] - ratios[found(t)].sum() / (len(t) - quality.N + 1 + quality.PRIOR) * 100) < 1e-4 for i, t in ((0, bad), (1, good)))


def test_the_sample_nears_the_target(spark):
    """n-grams of what is kept are nearer to those of good documents held out than the raw corpus's are; with a high temperature, less so."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("quality = 1").select("doc_id").distinct().where(quality.crc_mod("doc_id", quality.FOLDS) == quality.HELD)

    def shares(some):
        c = quality._counts(some.select("text", F.lit(False).alias("target")))[0] + 0.5
        return c[: quality.BUCKETS] / c[: quality.BUCKETS].sum()

    target, raw = shares(docs.join(held, "doc_id", "left_semi")), shares(docs)
    apart = lambda p: float((target * np.log(target / p)).sum())
    kept = [apart(shares(quality.keep(docs, labels, temperature=t))) for t in (1.0, 1e6)]
    assert kept[0] < 0.97 * apart(raw) and kept[0] < kept[1]


def test_mixing(spark, odd, none, labels):
    got = mixing.mix(odd, quality_weights(labels)).collect()
    assert len(got) == odd.count() and mixing.mix(none).count() == 0
    by_source = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by_source.setdefault((r.source, r.source_size, r.target), []).append(r.taken)
    for (_, size, target), taken in by_source.items():
        assert target <= 2 * size + 1e-9 and abs(sum(taken) - target) <= 1
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(odd, quality_weights(labels)).collect()))
    applied = mixing.apply_mix(odd)
    assert applied.columns == odd.columns
    assert applied.agg(F.sum(mixing.words())).first()[0] == mixing.mix(odd).agg(F.sum("taken")).first()[0]
    assert mixing.apply_mix(none).count() == 0


def test_mixed_rows_without_an_id(spark):
    rows = [(None, "one two three"), (None, "four five six"), (7, "seven eight nine"), (7, "ten eleven twelve"), (8, "one two three"), (None, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = [(r.doc_id, r.text) for r in mixing.apply_mix(docs).collect()]
    assert sum(len(t.split()) for _, t in got) == 23  # 150 % of 15, rounded half up
    assert {i for i, t in got if t == "one two three"} == {None, 8} and all(any(t.startswith(x) for _, x in rows if x) or any(x.startswith(t) for _, x in rows if x) for _, t in got)
    assert max(got.count(x) for x in got) <= 2


def test_packing_query_by_brute_force(spark):
    """op8 over the documents against whole texts: every id once, in gapless sequences that are full or a power of two."""
    from tokenizers import Tokenizer

    from tidewright.llm.queries import QUERIES

    whole = Tokenizer.from_file(TOKENIZER)
    ids = {r.doc_id: np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    by_doc, by_sequence = {}, {}
    for r in QUERIES["op8_packing"](spark, "/root/testdata/sf0.001").collect():
        own = ids[r.doc_id]
        assert r.length > 0 and r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(ids)

    def gapless(parts):
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        return at

    assert all(gapless(parts) == len(ids[i]) for i, parts in by_doc.items())
    filled = [gapless(parts) for parts in by_sequence.values()]
    assert max(filled) <= 2048 and sum(2048 - n for n in filled if n & (n - 1)) < 0.001 * sum(filled)


def test_conversations_by_brute_force(spark, none):
    """Instruction data under three limits, of which each closes some sequence: counted from the texts, turn by turn."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").where("conv_id < 4000")
    odd_turns = spark.createDataFrame([(-1, 0, None, None), (-1, None, "assistant", "x y"), (-2, 1, "assistant", None), (-2, 1, "assistant", None), (None, 0, "user", "no id"), (-3, 0, "user", "")], "conv_id long, turn long, role string, text string")
    turns = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(odd_turns)
    rows = {}
    for r in turns.collect():
        rows.setdefault(r.conv_id, []).append((-1 if r.turn is None else r.turn, r.role or "", len(whole.encode(r.text or "", add_special_tokens=False).ids)))
    tokens = {i: sum(n for *_, n in own) + 1 for i, own in rows.items()}
    last = {i: max(own) for i, own in rows.items()}
    loss = {i: n + 1 if role == "assistant" else 0 for i, (_, role, n) in last.items()}
    length, segments, most_loss = 512, 3, 128
    found = packing.pack_conversations(turns, TOKENIZER, 1, length, segments, most_loss).collect()
    got, sequences = {}, {}
    for r in found:
        assert r.loss == max(0, r.start + r.length - max(r.start, tokens[r.conv_id] - loss[r.conv_id]))
        got.setdefault(r.conv_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.loss))
    assert set(got) == set(tokens)
    for i, parts in got.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == tokens[i]
    closed = [0, 0, 0]
    for parts in sequences.values():
        at = 0
        for offset, n, _ in sorted(parts):
            assert offset == at
            at += n
        sums = (at, len(parts), sum(p[2] for p in parts))
        assert all(s <= most for s, most in zip(sums, (length, segments, most_loss), strict=True))
        closed = [c + (s == most) for c, s, most in zip(closed, sums, (length, segments, most_loss), strict=True)]
    assert min(closed) > 0
    assert packing.pack_conversations(odd_turns.where("false"), TOKENIZER, 1).count() == 0


def brute_languages(docs, asked, slots, hashes):
    """Filters as sets of slots, n-grams one by one."""

    def grams(text):
        clean = bytes(c | 0x20 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 0x20 for c in (text or "").encode()) + b" "
        return [g for g in (clean[i : i + langid.N] for i in range(len(clean) - langid.N + 1)) if g.strip(b" ")]

    def where(gram):
        return [int(p[0]) for p in langid.positions(np.array([int.from_bytes(gram, "little")], np.uint32), slots, hashes)]

    seen, sizes = {}, {}
    for text, lang in docs:
        sizes[lang] = sizes.get(lang, 0) + 1
        for g in grams(text):
            seen.setdefault(lang, {}).setdefault(g, 0)
            seen[lang][g] += 1
    names = sorted(sizes)
    rate = {lang: {g: n / sum(own.values()) for g, n in own.items()} for lang, own in seen.items()}
    top = {}
    for own in rate.values():
        for g, r in own.items():
            top[g] = max(top.get(g, 0.0), r)
    filters = {lang: {p for g, r in rate.get(lang, {}).items() if r >= langid.RARE and r >= langid.SHARE * top[g] for p in where(g)} for lang in names}
    false = {lang: min((len(f) / slots) ** hashes, 0.999) for lang, f in filters.items()}
    out = []
    for text in asked:
        found = grams(text)
        counts = [max(0.0, (sum(all(p in filters[lang] for p in where(g)) for g in found) - len(found) * false[lang]) / (1 - false[lang])) for lang in names]
        best = int(np.argmax(counts))
        if not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0))
        else:
            out.append((names[best] if counts[best] > 0 else max(names, key=lambda x: (sizes[x], -names.index(x))), min(1.0, counts[best] / max(len(found), 1))))
    return out


def test_languages_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang is not null").orderBy("doc_id").limit(60).collect()
    asked = [*(r.text[:400] if r.text else r.text for r in docs[:40]), None, "", "12 ...", "日本語の文", "xq", "Der Hafen, die See und THE ship"]
    known = spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in docs], "doc_id long, text string, lang string")
    filters = langid.train(known.repartition(3), slots=1 << 12)
    rows = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(rows, filters).collect()}
    want = brute_languages([(r.text, r.lang) for r in docs], asked, 1 << 12, langid.HASHES)
    for i, (lang, score) in enumerate(want):
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-9


@pytest.mark.parametrize("seed", range(4))
def test_digest_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    a, b = (bytes(rng.integers(97, 97 + 5 * (seed + 2), 900 + 700 * k, dtype=np.uint8)) for k in (0, 1))

    def parts(text):
        counts = brute_counts(text)
        ordered = sorted(counts.tolist())
        q = [ordered[63], ordered[127], ordered[191]]
        return min(255, round(float(np.log1p(len(text))) * 12)), [min(255, 64 * x // max(q[2], 1)) for x in q[:2]], [sum(c > x for x in q) for c in counts.tolist()]

    (n, ratios, codes), (m, other, theirs) = parts(a), parts(b)
    coded = bytes([n, *ratios, *(codes[i] | codes[i + 1] << 2 | codes[i + 2] << 4 | codes[i + 3] << 6 for i in range(0, 256, 4))])
    assert digest.digest(a) == coded
    apart = sum((0, 1, 2, 4)[abs(x - y)] for x, y in zip(codes, theirs, strict=True)) + max(0, abs(n - m) - 1) + sum(abs(x - y) for x, y in zip(ratios, other, strict=True)) // 8
    assert digest.difference(a := digest.digest(a), b := digest.digest(b)) == apart and digest.likeness(a, b) == max(0.0, 1 - apart / digest.MOST)


def test_resampling_keeps_the_good_at_any_size(spark):
    """Of labelled documents at two sizes: under a tenth of the bad are kept, of which none is learned from, and nearly all of the good."""
    from tidewright.llm.common import table
    from tidewright.llm.queries import QUERIES

    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        known = table(spark, sf, "labels").where("quality is not null").select("doc_id", "quality").distinct()
        kept = {r.quality: (r.n, r.k) for r in QUERIES["op5_importance_resampling"](spark, sf).join(known, "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("k")).collect()}
        assert kept[0][1] <= 0.1 * kept[0][0] and kept[1][1] >= 0.95 * kept[1][0]
