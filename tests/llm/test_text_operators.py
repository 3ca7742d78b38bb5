"""Packing, quality rules, near copies, languages, media and scores against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netlens.llm import gru, jpeg, language, media, packing, quality, scoring, simhash

public = pytest.importorskip("public_tokenizers")
SPACE = re.compile("[ \t\n\x0b\x0c\r]+")


def split(text):
    return [w for w in SPACE.split(text or "") if w]


def sort_key(rows):
    return sorted(rows, key=repr)


def tokenizer_path():
    return public.path("word_bpe_49k.json")


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    found = packing.pack(docs, tokenizer_path(), max_len=256).collect()
    assert len({r.sequence_id for r in found}) == len(found)
    by_doc: dict = {}
    for r in found:
        assert r.length == 1 << r.bucket == len(r.ids) // 4 and r.offset == 0 and r.length <= 256
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, text in {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        starts: dict = {}
        for r in by_doc[doc_id]:
            assert r.doc_tokens == len(ids)
            assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.start : r.start + r.length]
            starts.setdefault(r.start, []).append(r.length)
        at = 0
        while at < len(ids):
            at += starts[at][0]
        assert at == len(ids)


def test_packing_digest_and_empty(docs, nothing):
    out = packing.digest(packing.pack(docs.where("doc_id = 203"), tokenizer_path())).first()
    assert out.ids_crc32 == zlib.crc32(packing.tokenizer_at(tokenizer_path()).ids("x") + (2).to_bytes(4, "little"))
    assert packing.pack(nothing, tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, tokenizer_path(), max_len=100)


@pytest.mark.parametrize(
    "text",
    [
        "It's a DON'T <|endoftext|>x",
        "İstanbul Ünï ǅ \xa0n\x85 a\x1cb",
        "中文 テスト ½²3 ,'s --'re",
        "á ſs K ς Σ",
        "́abc\tt\rc\x0bv\x0cf \xad",
        "😀 x12 5.6e-7",
        "",
    ],
)
def test_cached_tokenizer_equals_whole(text):
    t = packing.tokenizer_at(tokenizer_path())
    assert t.ids(text) == np.array(t.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_other_tokenizers_are_used_as_they_are():
    t = packing.tokenizer_at(public.path("byte_bpe_50k.json"))
    assert packing.tokenizer_at(tokenizer_path()).by_word and not t.by_word
    for text in ("Two  Words\n\tand MORE", "", "é <|endoftext|> 12"):
        assert t.ids(text) == np.array(t.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def plain_features(text):
    text = text or ""
    w = split(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i, t in enumerate(zip(w, w[1:], w[2:])) if windows[t] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if split(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_features(docs, spark):
    more = spark.createDataFrame(
        [(900, "a b c a b c d # * |\nx\nx\n \n\nx"), (901, "q " * 30), (902, "a b c"), (903, "é😀 <b> é😀 <b> é😀 <b>")],
        "doc_id long, text string",
    )
    both = docs.select("doc_id", "text").union(more)
    found = quality.judge(both).collect()
    expected = Counter((i, *plain_features(t)) for i, t in both.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == expected
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_quality_windows_are_compared_by_words(spark, monkeypatch):
    """Even if all hashes were equal, only equal windows count."""
    r = np.random.default_rng(4)
    texts = [" ".join(r.choice(list("abcdefg"), int(n))) for n in r.integers(3, 60, 60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = {i: plain_features(t)[4] for i, t in enumerate(texts)}
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    found = {r.doc_id: r.n_repeat_words for r in quality.features(frame).collect()}
    monkeypatch.undo()
    assert found == expected


def plain_estimate(patterns, size, share, rates, prior):
    """Responsibilities and rates of the two-class model, straight from Bayes' rule."""
    total = sum(patterns.values())
    prior = prior[0] + prior[1] * total
    first, start = share, list(rates)
    for _ in range(quality.ITERATIONS):
        weight = {}
        for v in patterns:
            good, bad = share, 1 - share
            for (g, b), x in zip(rates, v):
                good *= {1: g, -1: 1 - g, 0: 1}[x]
                bad *= {1: 1 - b, -1: b, 0: 1}[x]
            weight[v] = good / (good + bad)
        share = (sum(n * weight[v] for v, n in patterns.items()) + prior * first) / (total + prior)
        sums = lambda k, value, mine: sum(
            n * mine(v)
            for v, n in patterns.items()
            if (v[k] == value if value else v[k])
        )
        rates = [
            (
                (sums(k, 1, weight.get) + prior * start[k][0]) / (sums(k, 0, weight.get) + prior),
                (sums(k, -1, lambda v: 1 - weight[v]) + prior * start[k][1]) / (sums(k, 0, lambda v: 1 - weight[v]) + prior),
            )
            for k in range(size)
        ]
    return share, rates


def test_quality_estimates_accuracies(nothing):
    rng = np.random.default_rng(9)
    share, rates = 0.85, [(0.97, 0.8), (0.99, 0.6), (0.95, 0.7), (0.9, 0.2)]
    counts: Counter = Counter()
    right = []
    for good in rng.random(20000) < share:
        votes = tuple(
            0
            if rng.random() < 0.2 else (1 if (rng.random() < g) else -1)
            if good else (-1 if rng.random() < b else 1)
            for g, b in rates
        )
        counts[votes] += 1
        right.append((votes, good))
    found_share, found = quality.estimate(sorted(counts.items()), 4)
    assert abs(found_share - share) < 0.02
    assert all(abs(a - c) < 0.03 and abs(b - d) < 0.06 for (a, b), (c, d) in zip(found, rates, strict=True))
    assert sum((quality.posterior(v, found_share, found) >= 0.5) == good for v, good in right) > 0.95 * len(right)
    plain_share, plain = plain_estimate(
        counts,
        4,
        quality.START_SHARE,
        [(quality.START_GOOD, quality.START_BAD)] * 4,
        (quality.PRIOR, quality.PRIOR_PART),
    )
    assert abs(plain_share - found_share) < 1e-9 and np.allclose(plain, found)
    assert quality.judge(nothing).count() == 0


def test_quality_verdicts(spark):
    """Junk goes by the votes of several rules, prose stays; each row's verdict is that of its own votes."""
    rng = np.random.default_rng(6)
    prose = [
        " ".join(f"word{rng.integers(5000)}"[: int(rng.integers(3, 9))] + chr(97 + int(rng.integers(26))) for _ in range(200))
        for _ in range(300)
    ]
    junk = [" ".join(("##||##" if k % 2 else f"x{rng.integers(900)}") for k in range(200)) for _ in range(30)]
    frame = spark.createDataFrame(list(enumerate(prose + junk)), "doc_id long, text string")
    found = {r.doc_id: r for r in quality.judge(frame).collect()}
    assert all(found[i].kept for i in range(300)) and not any(found[300 + i].kept for i in range(30))
    assert not any(found[300 + i].base_failed for i in range(30))


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = split(low)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) > 3 else ([" ".join(w)] if w else [])
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs):
    prints = sorted({f for _, f in pairs})
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    smallest: dict = {}
    for i, f in pairs:
        if i is not None:
            smallest[find(f)] = min(i, smallest.get(find(f), i))
    return Counter((i, f"{f:016x}", smallest.get(find(f))) for i, f in pairs)


def test_simhash_against_all_pairs(docs):
    pairs = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, simhash.link(docs).collect())) == plain_components(pairs)


def test_ring_links_lose_none(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    prints = set(base)
    for f in base:
        for d in range(1, 7):
            prints.add(f ^ sum(1 << int(b) for b in rng.choice(64, d, replace=False)))
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    links = [tuple(r) for r in simhash.ring_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()]
    found = set(links)
    assert len(links) == len(found)
    expected = {
        tuple(sorted((a, b)))
        for i, a in enumerate(signed)
        for b in signed[:i]
        if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4
    }
    assert found == expected


def test_keep_one(docs, nothing):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    pairs = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    groups = {c for _, _, c in plain_components(pairs)}
    assert kept.count() == len(groups) and {r.doc_id for r in kept.collect()} == groups
    assert simhash.keep_one(nothing).count() == 0 and simhash.link(nothing).count() == 0


def test_language(docs, nothing):
    filters = language.learn(docs)
    assert filters.languages == ["en", "fr"]
    found = {r.doc_id: r for r in language.identify(docs, filters).collect()}
    assert all(found[k].lang_pred == "en" for k in range(20)) and all(found[100 + k].lang_pred == "fr" for k in range(20))
    assert all(found[k].lang_pred == "und" and found[k].score == 0 for k in (200, 201, 202, 205))
    assert all(0 <= r.score <= 1 for r in found.values())
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns and not {r.doc_id for r in kept.collect()} & {200, 201, 202, 205}
    empty = language.learn(nothing)
    assert language.identify(docs, empty).where("lang_pred <> 'und'").count() == 0 and language.identify(
        nothing,
        filters,
    ).count() == 0


def test_language_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "PER_LANGUAGE", 100)
    copies = spark.range(3000).select(F.lit("one text of many copies").alias("text"))
    others = spark.range(3000).select(F.format_string("text number %d", "id").alias("text"))
    rows = copies.union(others).select(F.lit("en").alias("label"), "text", F.xxhash64("text").alias("order"))
    sample = [
        r.text
        for r in language._first_by_order(
            rows.withColumn("order", F.when(F.col("text").startswith("one"), 0).otherwise(F.col("order")))
        ).collect()
    ]
    assert len(sample) == len(set(sample)) and 10 < len(sample) < 110 and "one text of many copies" in sample


def test_language_copies_leave_the_sample_whole(spark, monkeypatch):
    monkeypatch.setattr(language, "PER_LANGUAGE", 100)
    texts = spark.range(50).select(F.format_string("text number %d", "id").alias("text"))
    rows = texts.crossJoin(spark.range(60)).select(F.lit("en").alias("label"), "text")
    rows = rows.union(
        spark.range(5000).select(F.lit("fr"), F.when(F.col("id") < 4000, "copy").otherwise(F.format_string("texte %d", "id")))
    )
    sample = [(r.label, r.text) for r in language._first_by_order(rows.withColumn("order", F.xxhash64("text"))).collect()]
    assert sorted(t for k, t in sample if k == "en") == sorted(r.text for r in texts.collect())
    assert 70 < len([t for k, t in sample if k == "fr"]) < 130 and len(sample) == len(set(sample))


def test_language_of_many_labels(spark):
    words = {f"l{k:03d}": " ".join(chr(0x4E00 + 40 * k + i) * 2 for i in range(20)) for k in range(150)}
    docs = spark.createDataFrame(
        [(f"{text} {n}", label) for label, text in words.items() for n in "abc"],
        "text string, lang string",
    )
    filters = language.learn(docs)
    assert filters.languages == sorted(words)
    assert all(filters.decide(text)[0] == label and filters.decide(text)[1] > 0.9 for label, text in words.items())


def test_language_learns_every_label(spark):
    """Labels of two texts, of one text in many copies, and of long and short texts are all learned."""
    rows = [("common words of the usual kind " * 3 + str(n), "en") for n in range(200)]
    rows += [
        ("żółta łódź płynie", "pl"),
        ("gęś idzie dróżką", "pl"),
    ] + [("sjór og fjall", "is")] * 40 + [("123", "zz"), (None, "nn"), ("no label", None)]
    filters = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert filters.languages == ["en", "is", "pl", "zz"]
    assert [
        filters.decide(t)[0]
        for t in ("the usual words", "fjall og sjór", "żółta gęś", "łódź idzie", "123", None)
    ] == ["en", "is", "pl", "pl", "und", "und"]


def invented(language: int, texts: int, words: int, seed: int = 0) -> list[str]:
    """Texts of words whose frequencies fall as in a language, from letters that a language prefers; languages share some words."""
    rng = np.random.default_rng(language)
    alphabet = rng.permutation(list("abcdefghijklmnopqrstuvwxyz"))[:14]
    shared = np.random.default_rng(99)
    stock = ["".join(rng.choice(alphabet, rng.integers(2, 9))) for _ in range(1500)]
    stock[::20] = ["".join(shared.choice(list("aeinorst"), 4)) for _ in stock[::20]]
    falling = 1 / np.arange(1, len(stock) + 1)
    draw = np.random.default_rng([seed, language])
    return [" ".join(draw.choice(stock, words, p=falling / falling.sum())) for _ in range(texts)]


def test_language_filters_do_not_follow_the_number_of_texts(spark):
    """A label of one long text, of one short one or of few short ones of a known language takes none of its documents, and texts
    of two words go where they belong."""
    known = [(t, name) for name, k in (("aa", 1), ("bb", 2), ("cc", 3)) for t in invented(k, 400, 150)]
    of_aa = invented(1, 200, 150, seed=5)
    for own in ([" ".join(of_aa)], of_aa[:1], of_aa[:10], [" ".join(of_aa[:10])]):
        filters = language.learn(spark.createDataFrame(known + [(t, "zz") for t in own], "text string, lang string"))
        tried = [(t, name) for name, k in (("aa", 1), ("bb", 2), ("cc", 3)) for t in invented(k, 100, 150, seed=6)]
        wrong = [name for t, name in tried if filters.decide(t)[0] != name]
        assert len(wrong) <= 5 and set(wrong) <= {"aa"}
        short = [(t, name) for name, k in (("bb", 2), ("cc", 3)) for t in invented(k, 200, 2, seed=7)]
        # The most frequent word is one of those that languages share, so some ten of the 400 texts tell nothing.
        assert sum(filters.decide(t)[0] != name for t, name in short) <= 24


def test_language_learns_a_long_rare_label(spark):
    """One text of a language of its own, be it long, is enough to know its documents, and its filter is bounded."""
    rows = [(t, "aa") for t in invented(1, 300, 100)] + [(" ".join(invented(4, 2000, 100)), "rare")]
    filters = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert all(filters.decide(t)[0] == "rare" for t in invented(4, 50, 60, seed=3))
    assert all(filters.decide(t)[0] == "aa" for t in invented(1, 50, 60, seed=3))


def test_language_shares_equal_exact_sets(spark, monkeypatch):
    """Learned filters and shares against plain counters and sets, for texts of many pieces, repeated texts and several tasks."""
    rows = [(t, name) for name, k in (("aa", 1), ("bb", 2)) for t in invented(k, 40, 400)] + [("żółta łódź", "pl")] * 3
    filters = language.learn(spark.createDataFrame(rows, "text string, lang string").repartition(7))
    for word in filters.bits:
        assert word.any()

    def plain_grams(points: list[int]) -> list[tuple]:
        parts = [tuple(points[i : i + n]) for n in language.SIZES for i in range(len(points) - n + 1)]
        return [p for p in parts if 32 not in p[1:-1]]

    sets = {}
    for name in {name for _, name in rows}:
        counts: Counter = Counter()
        total = 0
        for text in {t for t, label in rows if label == name}:
            points = language.letters(text).tolist()
            for at in range(0, len(points), language.PIECE):
                held = plain_grams(points[at : at + language.PIECE + 3])
                total += len(held)
                counts.update(set(held))
        bar = total * language.LEAST_RATE
        sets[name] = {g for g, c in counts.items() if c >= bar + language.ERRORS * bar**0.5}
    assert filters.languages == sorted(sets)
    for text in [*invented(1, 10, 80, seed=2), *invented(2, 10, 3, seed=2), "łódź", rows[0][0]]:
        held = plain_grams(language.letters(text).tolist())
        exact = [sum(g in sets[name] for g in held) / len(held) for name in filters.languages]
        # A filter is at most a sixteenth full for each n-gram and hash, so false positives are few.
        assert np.allclose(filters.shares(text), exact, atol=0.02 + 1.5 / len(held))


def test_filter_has_no_false_negatives():
    grams = language.grams(language.letters("Où est la rivière, déjà?"))
    f = language.Filters({"a": grams[:10], "b": grams[5:]})
    bits = f.containing(grams)
    assert (bits[:10] & np.uint64(1)).all() and (bits[5:] >> np.uint64(1) & np.uint64(1)).all()


def test_media_round_trip(docs, nothing):
    found = media.inspect(media.store(docs)).collect()
    texts = Counter((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    expected = Counter()
    for (i, t), n in texts.items():
        data = (t or "").encode()
        p = media.padded(data)
        assert len(p) % 192 == 0 and p.rstrip(b" ") == data.rstrip(b" ")
        expected[i, len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += n
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found) == expected
    assert all(r.width % 8 == 0 and len(r.thumbnail) == r.width * r.height // 64 for r in found)
    assert media.inspect(media.store(nothing)).count() == 0


def test_jpeg_any_bytes_and_broken_files():
    rng = np.random.default_rng(5)
    texts = [b"", bytes(range(256)) * 3, b"\xff" * 1000, b"\0" * 192, rng.bytes(400_000)]
    files = media.write_files(texts)
    for t, found in zip(texts, media.read_files(files), strict=True):
        assert media.payload_of(*found) == (len(t), media.padded(t))
    assert media.read_files([b"junk", None, b"", files[1][:200], files[1][:400] + files[1][500:]]) == [None] * 5


def test_jpeg_with_runs_and_end_of_block():
    """A grey image of another writer: zero runs, the 16-zero run and end of block, without restart markers."""
    ac = jpeg.by_lengths({0x00: 2, 0x01: 2, 0xF0: 3, 0x31: 3, 0x02: 4})
    dc = jpeg.by_lengths({0: 2, 3: 2, 4: 2})
    code = lambda table, s: next(f"{c:0{n}b}" for v, n, c in jpeg.canonical(*table) if v == s)
    bits = code(dc, 3) + "101" + code(ac, 0x01) + "1" + code(ac, 0xF0) + code(ac, 0x31) + "0" + code(ac, 0) + code(dc, 0) + code(ac, 0x02) + "01" + code(ac, 0)
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    tables = b"".join(bytes([k << 4]) + bytes(c) + s for k, (c, s) in enumerate((dc, ac)))
    parts = [
        (jpeg.DQT, bytes([0]) + bytes([16] * 64)),
        (jpeg.SOF0, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0])),
        (jpeg.DHT, tables),
        (jpeg.SOS, bytes([1, 1, 0, 0, 63, 0])),
    ]
    image = jpeg.Image(b"\xff\xd8" + b"".join(jpeg._marker(k, b) for k, b in parts) + scan + b"\xff\xd9")
    out = jpeg.decode([image])[0]
    first, second = np.zeros(64, int), np.zeros(64, int)
    first[[0, 1, 21]] = 5, 1, -1
    second[[0, 1]] = 5, -2
    assert out.tolist() == [first.tolist(), second.tolist()]
    assert jpeg.thumbnail(image, out).tolist() == [[138, 138]]


def inspected(spark, files):
    frame = spark.createDataFrame(list(enumerate(map(bytearray, files))), "doc_id long, media binary")
    return {r.doc_id: r for r in media.inspect(frame).collect()}


def markers(data):
    """(start, end) of each marker segment before the scan data."""
    at, out = 2, []
    while data[at + 1] != jpeg.SOS:
        end = at + 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        out.append((at, end))
        at = end
    return out


def test_media_reader_survives_anything(spark):
    """Claims that the bytes can't hold, zero sampling, wrong comments, and random damage give null features, never an error."""
    whole = media.write_files([b"some text of a few words " * 40])[0]
    frame_at = next(a for a, _ in markers(whole) if whole[a + 1] == jpeg.SOF0)
    bad = [whole[: frame_at + 5] + b"\xff\xff\xff\xff" + whole[frame_at + 9 :]]
    bad += [
        whole[: frame_at + 11 + 3 * k] + bytes([x]) + whole[frame_at + 12 + 3 * k :]
        for k in range(3)
        for x in (0, 0x10, 0x01, 0xFF)
    ]
    comment = b"payload 1000 1152"
    assert comment in whole
    foreign = [
        whole.replace(comment, c)
        for c in (b"payload xx   1152", b"payload 9999 1152", b"payload 1000 9999", b"payload 1000 1151", b"payload -1   1152")
    ]
    rng = np.random.default_rng(11)
    damaged = []
    for _ in range(1500):
        data = bytearray(whole)
        for _ in range(int(rng.integers(1, 6))):
            k = int(rng.integers(0, 700 if rng.random() < 0.7 else len(data)))
            kind = rng.integers(3)
            if kind == 0:
                data[k] = int(rng.integers(256))
            elif kind == 1:
                del data[k : k + int(rng.integers(1, 9))]
            else:
                data[k:k] = rng.bytes(int(rng.integers(1, 9)))
        damaged.append(bytes(data))
    found = inspected(spark, [whole, *bad, *foreign, *damaged])
    assert found[0].n_bytes == 1000 and all(found[1 + k].width is None for k in range(len(bad)))
    assert all(
        found[1 + len(bad) + k].width == found[0].width and found[1 + len(bad) + k].n_bytes is None
        for k in range(len(foreign))
    )
    assert len(found) == 1 + len(bad) + len(foreign) + len(damaged)


def test_tables_of_many_files_are_bounded():
    for k in range(3 * jpeg.MOST_TABLES):
        jpeg._lut(((0,) * 7 + (k + 1,) + (0,) * 8, bytes(range(k + 1))))
    assert len(jpeg._luts) <= jpeg.MOST_TABLES


def test_jpeg_against_another_codec(spark):
    """Java's codec reads what the writer makes, and the reader agrees with it on files that Java wrote, colour and grey."""
    jvm = spark.sparkContext._jvm
    io, streams = jvm.javax.imageio.ImageIO, jvm.java.io
    made = media.write_files([bytes(range(256)) * 20])[0]
    seen = io.read(streams.ByteArrayInputStream(made))
    image = jpeg.Image(made)
    assert (seen.getWidth(), seen.getHeight()) == (image.width, image.height)
    rng = np.random.default_rng(3)
    for kind, bands in ((10, 1), (5, 3)):  # TYPE_BYTE_GRAY, TYPE_3BYTE_BGR
        width, height = 67, 43
        picture = jvm.java.awt.image.BufferedImage(width, height, kind)
        raster = picture.getRaster()
        blocks = rng.integers(30, 220, (6, 9))
        for y in range(height):
            for x in range(width):
                for band in range(bands):
                    raster.setSample(x, y, band, int(blocks[y // 8, x // 8]))
        out = streams.ByteArrayOutputStream()
        assert io.write(picture, "jpg", out)
        data = bytes(out.toByteArray())
        back = io.read(streams.ByteArrayInputStream(data)).getRaster()
        (image, coefficients), = media.read_files([data])
        pixels = jpeg.thumbnail(image, coefficients)
        assert (image.width, image.height) == (width, height)
        for y in range(0, 40, 8):
            for x in range(0, 64, 8):
                mean = np.mean([back.getSample(x + i, y + j, 0) for i in range(0, 8, 2) for j in range(0, 8, 2)])
                assert abs(float(pixels[y // 8, x // 8]) - mean) < 4


def test_scores(docs, nothing):
    found = scoring.score(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts: Counter = Counter()
    for r in rows:
        if not held(r.doc_id):
            counts.update(tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    expected = {}
    for r in rows:
        w = tokens(r.text)
        expected.setdefault(r.doc_id, []).append(
            (held(r.doc_id), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        )
    assert len(found) == len(rows)
    for r in found:
        assert any(
            (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == e[:4] and abs(r.base_score - e[4]) < 1e-6 * max(1, abs(e[4]))
            for e in expected[r.doc_id]
        )
        assert r.score < 0 and math.isfinite(r.score)
    assert scoring.score(nothing).count() == 0


def test_gru_gradient_and_lanes():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, gru.OUTPUTS, n).astype(np.int16) for n in (5, 9, 3, 7)]
    v = gru.start_vector(np.ones(gru.OUTPUTS)).astype(np.float64)
    laid = gru.Lanes(docs, 2)
    lanes = laid.ids.shape[1]
    used = np.arange(lanes)[None, :] < laid.active[:, None]
    x, zero = gru.inputs_of(laid.ids, laid.keep, np.zeros(lanes, np.int16)), np.zeros((gru.HIDDEN, lanes), np.float32)

    def loss(v):
        p = gru.unpacked(v)
        s, _, _ = gru.run_window(p, x, laid.keep, zero)
        return -gru.log_probabilities(p, gru.rows_of(s, used).astype(np.float64), laid.ids[used].astype(int)).mean()

    g, _ = gru.gradient(gru.unpacked(v), x, laid.keep, zero, laid.ids.astype(int), used)
    for i in np.argsort(-abs(g))[:3000:200]:
        a, b = v.copy(), v.copy()
        a[i] += 1e-2
        b[i] -= 1e-2
        assert abs((loss(a) - loss(b)) / 2e-2 - g[i]) < 6e-3 * max(0.1, abs(g[i]))
    alone = [gru.score(v.astype(np.float32), [d], 1)[0] for d in docs]
    assert np.allclose(alone, gru.score(v.astype(np.float32), docs, 3), rtol=1e-4)


def test_network_learns_order():
    """Held-out text of a fixed cycle gets likelier than its unigram score."""
    ids = np.array([1, 2, 3, 4] * 200 + [0], np.int16)
    counts = np.zeros(gru.OUTPUTS)
    counts[:5] = 1, 200, 200, 200, 200
    v = gru.start_vector(counts)
    before = gru.score(v, [ids], 1)[0]
    adam = gru.Adam(0.01)
    for _ in range(8):
        gru.train(v, [ids] * 16, 8, adam)
    assert gru.score(v, [ids], 1)[0] > 0.5 * before


def test_network_is_a_distribution():
    rng = np.random.default_rng(1)
    p = gru.unpacked(gru.start_vector(np.arange(gru.OUTPUTS, 0, -1)))
    states = rng.standard_normal((3, gru.HIDDEN)).astype(np.float32)
    each = [
        np.exp(gru.log_probabilities(p, np.repeat(s[None, :], gru.OUTPUTS, axis=0), np.arange(gru.OUTPUTS))).sum()
        for s in states
    ]
    assert np.allclose(each, 1, atol=1e-4)


def test_rest_symbols_agree_and_shares_add_up(spark):
    counts = {**{f"w{k}": 5 + k % 7 for k in range(3000)}, "é": 4, "": 1, "ab": 2, scoring.END: 9}
    words = spark.createDataFrame(list(counts.items()), "word string, c long")
    found = {r.word: r.s for r in words.select("word", scoring.rest_symbol_column(F.col("word")).alias("s")).collect()}
    assert found == {w: scoring.rest_symbol(w.encode()) for w in counts}
    rests: dict = {}
    for w, c in counts.items():
        n, v = rests.get(found[w], (0, 0))
        rests[found[w]] = n + c, v + 1
    voc = scoring.Vocabulary(list(counts.items()), rests)
    assert (voc.tokens, voc.distinct) == (sum(counts.values()), len(counts))
    mass = np.zeros(scoring.RESTS)
    first = gru.OUTPUTS - scoring.RESTS
    for w, symbol in zip(voc.words.to_pylist(), voc.ids(voc.words, voc.places(voc.words)) - first, strict=True):
        if symbol >= 0:
            mass[symbol] += (counts[w] + 1) / 10 ** voc.log_rest_sizes[symbol]
    assert np.allclose(mass + 10**-voc.log_rest_sizes, 1)


def test_held_out_score_beats_base(spark):
    """Texts of a chain of 3000 words, most of them rest words: the model knows what follows, the base score doesn't."""
    rng = np.random.default_rng(2)
    forms = [f"{rng.integers(1e9):x}{('ing', 'ed', 'ly', 'ness')[k % 4]}" for k in range(3000)]
    rows = []
    for i in range(700):
        at = rng.integers(0, 750) * 4
        chain = [forms[(at + 4 * int(rng.integers(0, 750)) + k) % 3000] for k in range(300)]
        rows.append((i, " ".join(chain)))
    found = scoring.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).where("held_out")
    sums = found.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert sums.n > 20_000 and sums.s > sums.b + 0.1 * sums.n


def test_words_of_many_texts():
    texts = ["", None, " A b\x0b\x0cB  ", "\n", "É é\u00a0é", "x" * 50_000, "a\r\na", "b"] * 3
    found = scoring.tokenized(pa.array(texts))
    words = found.words.cast(pa.binary()).to_pylist()
    lists = np.split(found.codes, np.cumsum(found.lengths)[:-1])
    plain = [(t or "").encode().lower().split() for t in texts]
    assert [[words[c] for c in one] for one in lists] == plain
    outside = np.array([w != b"a" for w in words])
    rare = [dict(m) for m in scoring.counted_words(found, outside).to_pylist()]
    assert rare == [dict(Counter(w.decode() for w in p if w != b"a")) for p in plain]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    assert [t for part in scoring.groups(batch, 0) for t in part.column(0).to_pylist()] == texts
    for none in ([], [None], [""]):
        found = scoring.tokenized(pa.array(none, pa.string()))
        assert len(found.codes) == 0 and found.lengths.tolist() == [0] * len(none)
        assert scoring.counted_words(found, np.zeros(len(found.words), bool)).to_pylist() == [[]] * len(none)


def test_held_out_is_by_crc(spark):
    ids = spark.range(200).select(F.col("id").alias("doc_id"))
    for r in ids.select("doc_id", scoring.held_out().alias("a"), language.held_out().alias("b")).collect():
        assert r.a == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.b == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
