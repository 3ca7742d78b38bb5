"""SentencePiece encoding, source divergence and spelling variants against the library, SQL and plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netlens.llm import divergence, sentencepieces, spelling

public = pytest.importorskip("public_tokenizers")
MODEL = public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def ids_of(text):
    return list(memoryview(sentencepieces.model_at(MODEL).encode(text)).cast("i"))


PARTS = st.sampled_from([*"abcdeth \n\t.,()-=*12²ßéñ▁中😀\x00<>", "the", "tion", "  ", " " * 17, "<s>", "<0x0A>", "http://", "ing", "\\", "́", "…", "-" * 9])


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=30).map("".join) | st.text(max_size=20))
def test_pieces_equal_the_library(text):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert ids_of(text) == processor.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 31999) | st.integers(0, 300), max_size=12))
def test_any_ids_decode_as_in_the_library(ids):
    import sentencepiece

    assert sentencepieces.model_at(MODEL).decode(ids) == sentencepiece.SentencePieceProcessor(model_file=MODEL).decode(ids)


def test_runs_of_one_sign_and_long_texts(library):
    for n in (1, 2, 15, 16, 17, 31, 33, 100, 1000):
        for sign in (" ", "-", "a", "ab", "▁x", ".", "\n", "=", "é"):
            assert ids_of(sign * n) == library.encode(sign * n)
    long = "".join(random.Random(5).choice("abcdefghijklmnop") for _ in range(100_000))
    assert ids_of(long) == library.encode(long)


def test_whole_texts_give_the_same_when_nothing_may_be_cut(library, monkeypatch):
    monkeypatch.setattr(sentencepieces.MergeModel, "_segments", lambda self: r"(?s:.+)")
    model = sentencepieces.MergeModel(MODEL)
    for text in ("The quick  brown fox\njumps -- over it.", "aaaa  bbb", "x" * 300 + " é" * 50):
        assert list(memoryview(model.encode(text)).cast("i")) == library.encode(text)


def test_encode_and_decode_frames(docs, nothing, library, monkeypatch):
    monkeypatch.setattr(sentencepieces, "BATCH_IDS", 100)
    encoded = sentencepieces.encode(docs, MODEL)
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == Counter(
        {(i, tuple(library.encode(t or ""))): n for (i, t), n in texts.items()}
    )
    clash = encoded.withColumn("decoded", F.lit(1))
    found = sentencepieces.decode(clash, MODEL)
    assert found.columns == ["doc_id", "ids", "decoded", "decoded_"]
    assert {(r.doc_id, r.decoded_) for r in found.collect()} == {(i, t or "") for i, t in texts}
    assert sentencepieces.decode(sentencepieces.encode(nothing, MODEL), MODEL).count() == 0
    odd = docs.sparkSession.createDataFrame([(None,), ([],), ([1, None, 2, 300],)], "ids array<int>")
    assert [r.decoded for r in sentencepieces.decode(odd, MODEL).collect()] == ["", "", library.decode([1, 2, 300])]


def test_sentencepiece_query(docs, spark, library, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    found = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sentencepieces.op11_sentencepiece(spark, str(tmp_path)).collect()}
    expected = set()
    for r in docs.collect():
        ids = library.encode(r.text or "")
        expected.add((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert found == expected


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError):
        sentencepieces.MergeModel(str(tmp_path / "m"))


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_audit(rows, least, ranks):
    """Straight from the definition, over every term of every pair."""
    rows = [(TERM.findall((t or "").translate(LOWER)), lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == lang]
        containing = Counter(w for words, _, _ in mine for w in set(words))
        kept = [w for w, n in containing.items() if n >= least]
        groups = {s: Counter(w for words, _, source in mine for w in words if source == s) for s in {r[2] for r in mine}}
        groups[None] = Counter(w for words, _, _ in mine for w in words)
        totals = {s: sum(c[w] for w in kept) for s, c in groups.items()}
        p = {s: {w: 1 + 10**9 * (c[w] + 1) // (totals[s] + len(kept)) for w in kept} for s, c in groups.items()}
        f = lambda x, y: (x - y) ** 2 // y
        for s in groups.keys() - {None}:
            pairs = [(o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in groups.keys() - {None, s}]
            terms = [(w, f(p[s][w], p[None][w])) for w in kept if groups[s][w] and p[s][w] > p[None][w]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, *x, k) for k, x in enumerate(found, 1) if part == "pair" or k <= ranks]
    return sorted(out)


NAMES = ("lang", "source", "part", "item", "value", "rank")


@pytest.mark.parametrize("least, ranks", [(3, 200), (1, 4), (500, 5)])
def test_divergence_equals_the_definition(docs, spark, least, ranks, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 7)
    monkeypatch.setattr(divergence, "BLOCK_PAIRS", 5)
    more = spark.createDataFrame(
        [("Été ÉTÉ a_b a", "fr", "src9"), ("", "fr", "empty"), ("zz" * 40_000 + " the", "en", "src0"), (None, None, None), ("!!", "xx", "only")],
        "text string, lang string, source string",
    )
    both = docs.select("text", "lang", "source").union(more)
    found = divergence.audit(both, min_documents=least, term_ranks=ranks).collect()
    assert sorted(tuple(r[c] for c in NAMES) for r in found) == plain_audit([tuple(r) for r in both.collect()], least, ranks)


def test_divergence_sql_and_empty(docs, nothing, spark, tmp_path):
    import duckdb

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = divergence.op12_source_divergence(spark, str(tmp_path))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = db.sql(divergence.ORACLE)
    assert sorted(tuple(r[c] for c in expected.columns) for r in found.collect()) == sorted(expected.fetchall())
    assert divergence.audit(nothing).count() == 0


RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain_variants(rows):
    n = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def spelled(spark):
    r = random.Random(8)
    stems = ["wonderful", "thinking", "rivière", "garçonnet", "alphabet", "ÿÿÿÿÿÿÿ", "straßen×÷", "Thinking", "aaaaaaa", "aaaaaaaa"]
    rows = []
    for i in range(300):
        words = []
        for _ in range(40):
            w = r.choice(stems[: 1 + int(10 * r.random() ** 3)])
            if r.random() < 0.03:
                k = r.randrange(len(w))
                w = w[:k] + r.choice(["", "x", "é", w[k] * 2]) + w[k + 1 :]
            words.append(w)
        rows.append((i, " ".join(words)))
    chain = [("abcdefgh", 1200), ("abcdefgx", 110), ("abcdefyx", 10)]
    rows += [(1000 + k, " ".join([w] * n)) for k, (w, n) in enumerate(chain)]
    rows += [(2000, None), (2001, ""), (2002, "b" * 30_000 + " " + "b" * 29_999), (2003, "b" * 30_000 + "中" + "b" * 29_999), (None, "wonderful thinking"), (None, "wonderful thinking")]
    return spark.createDataFrame([(*x, 1, "w") for x in rows], "doc_id long, text string, n int, word string").repartition(3)


def test_variants_equal_the_definition(spark, docs, nothing, monkeypatch):
    for name, value in (("SHARD_WORDS", 9), ("PASS_WORDS", 20), ("HELD_WORDS", 11), ("BLOCK_STATES", 50), ("BLOCK_ROWS", 5)):
        monkeypatch.setattr(spelling, name, value)
    for frame in (spelled(spark), docs):
        found = spelling.variants(frame)
        assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        expected = plain_variants([(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()])
        assert {tuple(r) for r in found.collect()} == expected and found.count() == len(expected)
    assert spelling.variants(nothing).count() == 0


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.text("abé", min_size=1, max_size=6), min_size=1, max_size=40, unique=True),
    st.lists(st.text("abéc", min_size=1, max_size=7), min_size=1, max_size=20),
)
def test_automata_find_all_neighbours(words, others):
    words = sorted(w.encode("latin-1") for w in words)
    others = [w.encode("latin-1") for w in others]
    query, leaf = spelling.neighbours(spelling.Trie(words, [1] * len(words)).opened(), others)
    found = sorted(zip(query.tolist(), leaf.tolist(), strict=True))
    assert found == sorted((a, b) for a in range(len(others)) for b in range(len(words)) if one_edit(others[a], words[b]))
