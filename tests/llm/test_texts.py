"""Whole-text operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from functools import lru_cache
from math import log, log2

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from agoralake.llm import decontam, language, pieces, queries, repeats, secrets, token_files

from .conftest import SF

# -- language


def test_held_out_accuracy(spark):
    found = queries.op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = found.where("held_out and lang is not null and lang_pred <> 'und'").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in rows)
    assert len(rows) > 100 and right / len(rows) >= 0.95
    assert found.where("score < 0 or score > 1").isEmpty()


def test_a_mixed_document(spark):
    # two made-up languages with their own letters
    rng = random.Random(1)
    say = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))
    rows = [(i, say("abcde" if i % 2 else "vwxyz", 60), "aa" if i % 2 else "zz") for i in range(60)]
    model = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    docs = spark.createDataFrame([(1, say("abcde", 90) + " " + say("vwxyz", 30)), (2, say("abcde", 30)), (3, "12 34"), (4, None), (5, "Ωω")], "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert found[1]["lang_pred"] == "aa" and {m["lang"] for m in found[1]["mixture"]} == {"aa", "zz"} and 0.65 < found[1]["score"] < 0.85
    assert found[2]["lang_pred"] == "aa" and len(found[2]["mixture"]) == 1
    assert [(found[d]["lang_pred"], found[d]["score"]) for d in (3, 4)] == [("und", 0.0)] * 2
    assert found[5]["lang_pred"] in ("aa", "zz")


def mixture_of(text, model, penalty=language.PENALTY):
    """The mixture inference of one text in plain Python: {language: share}, or None without a letter."""
    if not any(c.isalpha() for c in text or ""):
        return None
    raw, seen = text.encode(), []
    for i, b in enumerate(raw):
        b = b + 32 if 65 <= b <= 90 else b
        if i and raw[i - 1] == 0xC3 and 0x80 <= b <= 0x9E:
            b += 32
        seen.append(b if 97 <= b <= 122 or b >= 128 else 0)
    counts = Counter()
    for before, b, after in zip([0, *seen], seen, [*seen[1:], 0]):
        if b:
            gram = before << 16 | b << 8 | after
            counts[(gram * 2654435761 & 0xFFFFFFFF) >> 32 - 12] += 1
    grams, total = sorted(counts), sum(counts.values())
    lik = {lang: {g: float(row[g]) for g in grams} for lang, row in zip(model.languages, model.likelihood)}

    def em(langs):
        pi = {x: 1 / len(langs) for x in langs}
        for _ in range(language.ITERATIONS):
            whole = {g: sum(pi[x] * lik[x][g] for x in langs) for g in grams}
            pi = {x: pi[x] * sum(counts[g] / whole[g] * lik[x][g] for g in grams) / total for x in langs}
        return pi, sum(counts[g] * log(sum(pi[x] * lik[x][g] for x in langs)) for g in grams)

    alone = {x: em([x])[1] for x in model.languages}
    best = max(model.languages, key=lambda x: alone[x])
    chosen, top = {best: 1.0}, alone[best]
    order = sorted(model.languages, key=lambda x: -em(list(model.languages))[0][x])
    for size in range(2, len(order) + 1):
        pi, value = em(order[:size])
        if value - (size - 1) * penalty * log(1 + total) > top:
            chosen, top = pi, value - (size - 1) * penalty * log(1 + total)
    return chosen


def test_mixtures_against_brute_force(spark, documents):
    model = language.fit(documents)
    rows = [tuple(r) for r in documents.select("doc_id", "text").where("doc_id % 5 = 0 and length(text) < 6000").collect()]
    by_lang = {r["lang"]: r["text"] for r in documents.where("length(text) between 800 and 3000").collect()}
    rows += [(-k, " ".join([*by_lang.values()][: k + 1])) for k in range(4)] + [(-9, None), (-10, "12"), (-11, "ÄÖÜ é")]
    found = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    several = 0
    for d, text in rows:
        want = mixture_of(text, model)
        if want is None:
            assert (found[d]["lang_pred"], found[d]["score"], found[d]["mixture"]) == ("und", 0.0, [])
            continue
        got = {m["lang"]: m["share"] for m in found[d]["mixture"]}
        assert {x: p for x, p in want.items() if p > 1e-6}.keys() == {x for x, p in got.items() if p > 1e-6} and all(abs(want[x] - p) < 1e-6 for x, p in got.items())
        assert want[found[d]["lang_pred"]] >= max(want.values()) - 1e-9 and abs(found[d]["score"] - max(want.values())) < 1e-6
        several += len(got) > 1
    assert several >= 3


def test_language_odd_documents(odd_documents, no_documents, odd_texts):
    model = language.fit(odd_documents)
    assert language.identify(odd_documents, model).count() == len(odd_texts)
    kept = language.filter_language(odd_documents, model)
    assert kept.columns == odd_documents.columns and kept.where("text is null").isEmpty()
    nothing = language.fit(no_documents)
    assert nothing.languages == () and {r["lang_pred"] for r in language.identify(odd_documents, nothing).collect()} == {"und"}


# -- repeated windows


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def without_repeats(rows, n):
    first: dict = {}
    key = lambda d: 2**63 if d is None else d
    for d, text in rows:
        words = spaced(text)
        for i in range(len(words) - n + 1):
            w = tuple(words[i : i + n])
            first[w] = min(first.get(w, key(d)), key(d))
    out = []
    for d, text in rows:
        words = spaced(text)
        gone = {i + k for i in range(len(words) - n + 1) if first[tuple(words[i : i + n])] < key(d) for k in range(n)}
        out.append((d, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return Counter(out)


@pytest.mark.parametrize("n", [1, 3, 5, 13])
def test_repeats_against_brute_force(spark, n):
    rng = random.Random(n)
    passages = [[f"p{j}w{i}" for i in range(40)] for j in range(6)]
    rows = []
    for d in range(150):
        words = [f"x{rng.randrange(50 if n < 5 else 5000)}" for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            p, a = rng.choice(passages), rng.randrange(30)
            words[rng.randrange(len(words) + 1) : 0] = p[a : a + rng.randrange(1, 40)]
        rows.append((d * 7 % 151 - 20, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = repeats.remove_repeats(df, n=n, chunk_bytes=3000, bucket_bytes=5000).collect()
    assert Counter(map(tuple, found)) == without_repeats(rows, n)


def test_words_that_polynomials_confuse_are_no_repeats(spark):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    two = one.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{one} {rest}")]
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), n=13).collect()
    assert {r["doc_id"]: r["n_removed"] for r in found} == {1: 0, 2: 0, 3: 13}


def test_repeats_odd_documents(odd_documents, no_documents, odd_texts):
    found = repeats.remove_repeats(odd_documents, n=13).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert Counter(map(tuple, found)) == without_repeats(odd_texts, 13)
    assert repeats.remove_repeats(no_documents, n=13).count() == 0


# -- benchmark overlaps


def plain_words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def overlaps(text, items, n):
    words, hit, names = plain_words(text), set(), set()
    for item, body in items:
        of = plain_words(body)
        size = min(n, len(of))
        windows = {tuple(of[i : i + size]) for i in range(len(of) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                names.add(item)
    return len(words), len(hit), sorted(names)


def test_a_large_benchmark_gives_the_same(spark, documents):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    small, large = (decontam.find_overlaps(documents, bench, max_bytes=m) for m in (decontam.MAX_BYTES, 1000))
    assert sorted(map(repr, small.collect())) == sorted(map(repr, large.collect())) and not small.where("n_hit > 0").isEmpty()


@pytest.mark.parametrize("max_bytes", [1 << 20, 200])
def test_overlaps_against_brute_force(spark, odd_texts, max_bytes):
    rng = random.Random(9)
    items = [(f"i{k}", " ".join(f"q{rng.randrange(30)}" for _ in range(rng.choice((1, 4, 9, 10, 25))))) for k in range(30)]
    items += [("none", None), ("empty", " - "), ("i3", "Zweite, Fassung; von i3"), ("long", " ".join(f"q{k % 30}" for k in range(90)))]
    rows = list(odd_texts)
    for d in range(100, 160):
        parts = [" ".join(f"q{rng.randrange(30)}" for _ in range(5)), rng.choice(items[:30])[1].upper().replace(" ", "?! "), "ZWEITE fassung – von i3" if d % 9 == 0 else "."]
        rng.shuffle(parts)
        rows.append((d, " ".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("spans", F.lit(1))
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = Counter((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in decontam.find_overlaps(docs, bench, max_bytes=max_bytes).collect())
    assert found == Counter((d, *overlaps(t, items, 10)[:2], ",".join(overlaps(t, items, 10)[2])) for d, t in rows)
    kept = decontam.decontaminate(docs, bench, max_bytes=max_bytes)
    assert kept.columns == docs.columns and kept.count() == sum(not overlaps(t, items, 10)[1] for _, t in rows)
    cut = decontam.decontaminate(docs, bench, remove="spans", max_bytes=max_bytes).where("doc_id >= 100").collect()
    before = dict(rows)
    assert all(len(plain_words(r["text"])) == len(plain_words(before[r["doc_id"]])) - overlaps(before[r["doc_id"]], items, 10)[1] for r in cut)


def test_overlaps_with_nothing(odd_documents, no_documents, spark):
    nothing = spark.createDataFrame([], "item_id string, text string")
    assert {(r["n_hit"], len(r["items"])) for r in decontam.find_overlaps(odd_documents, nothing).collect()} == {(0, 0)}
    assert decontam.find_overlaps(no_documents, nothing).count() == 0


# -- token files


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=80), st.data())
def test_packing_round_trip(bits, ids, data):
    ids = np.array([i % (1 << bits) for i in ids], np.uint32)
    packed = token_files.pack(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert token_files.unpack(packed, bits, a, b - a).tolist() == ids[a:b].tolist()


def digests(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    found = []
    for d, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        found.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return sorted(found, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def test_token_files_odd_documents(spark, odd_documents, no_documents, odd_texts):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    for docs, rows in ((odd_documents, odd_texts), (no_documents, [])):
        where = token_files.fresh_path(spark, "test")
        token_files.write_tokens(docs, where, path, vocabulary=50_257, end_id=2)
        found = sorted([tuple(r) for r in token_files.read_digests(spark, where).collect()], key=lambda r: r[1])
        assert [r[1] for r in found] == [sum(r[2] for r in found[:k]) for k in range(len(found))]
        assert sorted([(d, n, c) for d, _, n, c in found], key=lambda r: (r[0] is not None, r[0] or 0, r[1:])) == digests(rows)
        assert [r[0] for r in found] == [d for d, _, _ in digests(rows)]


def test_added_tokens_in_a_text_are_the_library_s(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext |> no", "plain words, only", ""]
    ids = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids[0] == [64, 220, 50256, 275]
    encoder = token_files.encoder_for(path)
    assert [np.frombuffer(c, "<u4").tolist() for c in encoder.encode(texts)] == ids
    assert encoder.encode([]) == [] and encoder.encode(texts[:1]) == encoder.encode(texts)[:1]
    where = token_files.fresh_path(spark, "test")
    token_files.write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), where, path, vocabulary=50_257, end_id=2)
    found = token_files.read_digests(spark, where).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in found] == [len(x) + 1 for x in ids] and [r["start"] for r in found] == [sum(len(x) + 1 for x in ids[:k]) for k in range(len(ids))]
    assert [r["ids_crc32"] for r in found] == [zlib.crc32(np.array([*x, 2], "<u4").tobytes()) for x in ids]


def test_token_files_query(spark, documents):
    found = sorted([tuple(r) for r in queries.op6_token_files(spark, SF).collect()], key=lambda r: r[1])
    assert [(d, n, c) for d, _, n, c in found] == digests([tuple(r) for r in documents.select("doc_id", "text").collect()])
    assert [r[1] for r in found] == list(np.cumsum([0, *[r[2] for r in found[:-1]]]))


def test_rows_of_one_id_are_split_into_files(spark):
    rows = [(None if k % 3 else k, f"text number {k} " * 20) for k in range(600)]
    where = token_files.fresh_path(spark, "test")
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string"), where, queries.tokenizer_path("byte_bpe_50k.json"), vocabulary=50_257, end_id=2, file_bytes=20_000)
    found = sorted([tuple(r) for r in token_files.read_digests(spark, where).collect()], key=lambda r: r[1])
    assert sorted([(d, n, c) for d, _, n, c in found], key=lambda r: (r[0] is not None, r[0] or 0, r[1:])) == digests(rows)
    assert [r[1] for r in found] == list(np.cumsum([0, *[r[2] for r in found[:-1]]]))
    files = spark.read.format("binaryFile").load(where).where("length > 100")
    assert files.count() > 5 and files.agg(F.max("length")).first()[0] < 40_000


@lru_cache(maxsize=1)
def library_and_encoder():
    """The untouched library, and one encoder that lives through all examples."""
    from tokenizers import Tokenizer

    class Forgetful(token_files.UnitEncoder):
        LIMIT = 40

    path = queries.tokenizer_path("byte_bpe_50k.json")
    return Tokenizer.from_file(path), Forgetful(path)


PARTS = ("a", "b", " ", "  ", "Z", "1", ".", "..", ",", ".,", "'", "'s", "I'll", "!", "\n", "\n\n", "\t", "\r", "\0", "\x1c", "\x85", "\xa0", "é", "…", "日", "😀", "\u3000", "٣", "अ", "½", "$$$", "_", "<|endoftext|>", "etc..", "(see)", "wait..", "oh wait...", "averyveryverylongword", "×", "ſ", "'re", "'l", "''")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), max_size=6))
def test_units_join_to_the_library_s_ids(texts):
    library, encoder = library_and_encoder()
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(c, "<u4").tolist() for c in encoder.encode(texts)] == want


@pytest.mark.parametrize("texts", [["(see) wait..", "oh wait..."], ["oh wait...", "(see) wait.."], ["(a) he said etc.", "he said etc.."], ["..", ",,", "first\n..\nlast"]])
def test_ids_do_not_depend_on_earlier_texts(texts):
    library, _ = library_and_encoder()
    encoder = token_files.UnitEncoder(queries.tokenizer_path("byte_bpe_50k.json"))
    for t in texts:
        assert np.frombuffer(encoder.encode([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_a_tokenizer_of_another_kind_encodes_whole_texts(tmp_path):
    from tokenizers import Tokenizer, normalizers

    library = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    library.normalizer = normalizers.Lowercase()
    library.save(str(tmp_path / "lower.json"))
    encoder = token_files.UnitEncoder(str(tmp_path / "lower.json"))
    assert not encoder.plain
    assert np.frombuffer(encoder.encode(["Some TEXT.. here"])[0], "<u4").tolist() == library.encode("Some TEXT.. here", add_special_tokens=False).ids


def test_random_access(spark, documents):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    encoder = token_files.encoder_for(path)
    texts = [r["text"] for r in documents.orderBy("doc_id").limit(20).collect()]
    coded = [np.frombuffer(c, "<u4") for c in encoder.encode([t or "" for t in texts])]
    block = token_files.block_bytes(list(range(20)), np.array([len(c) for c in coded]), np.concatenate(coded), 16) + b"\n"
    file = token_files.TokenFile(block + token_files.footer_bytes([0], [0]) + b"\n")
    assert [file.document(0, i).tolist() for i in (19, 0, 7)] == [coded[i].tolist() for i in (19, 0, 7)]
    with pytest.raises(ValueError, match="cut short"):
        token_files.TokenFile(block)


# -- subword pieces


def piece_ids(texts):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model")).encode(texts, num_threads=4)


@pytest.mark.parametrize(("chunk", "giant", "fan"), [(1 << 15, 1 << 16, 16), (37, 50, 3)])
def test_pieces_are_the_library_s(spark, monkeypatch, odd_texts, documents, chunk, giant, fan):
    monkeypatch.setattr(pieces, "FAN", fan)  # several levels of products
    path = queries.tokenizer_path("piece_bpe_32k.model")
    few = [(r["doc_id"], r["text"]) for r in documents.where("length(text) < 400").orderBy("doc_id").limit(25).collect()]
    rows = [*odd_texts[:9], *odd_texts[11:], *few, (900, "x" * 300), (901, "ab\n\n  cd   " * 30), (902, "🙂é" * 70)]
    rows += odd_texts[9:11] if chunk > 1000 else []
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"doc": F.lit(1), "k": F.lit(2), "entry": F.lit("e")})
    coded = pieces.encode(docs, path, chunk=chunk, giant=giant)
    assert coded.columns == [*docs.columns, "ids"]
    found = pieces.decode(coded, path).collect()
    assert len(found) == len(rows)
    want = dict(zip([t or "" for _, t in rows], piece_ids([t or "" for _, t in rows])))
    for r in found:
        assert list(r["ids"]) == want[r["text"] or ""], r["doc_id"]
        assert r["decoded"] == (r["text"] or "")


def test_products_are_associative_and_give_the_states():
    rng = np.random.default_rng(2)
    for _ in range(50):
        sizes = rng.integers(1, 6, size=8)
        ms = [np.where(rng.random((a, b)) < 0.7, 0.0, pieces.NEVER) for a, b in zip(sizes[:-1], sizes[1:])]
        left = ms[0]
        for m in ms[1:]:
            left = pieces.max_plus(left, m)
        right = ms[-1]
        for m in reversed(ms[:-1]):
            right = pieces.max_plus(m, right)
        assert np.array_equal(left, right)
        for i, j in zip(*np.nonzero(left == 0)):
            at = pieces.boundary_states(ms, i, j)
            assert at[0] == i and at[-1] == j and all(m[a, b] == 0 for m, a, b in zip(ms, at[:-1], at[1:]))


def test_a_column_named_ids_is_replaced(spark, tmp_path):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    coded = pieces.encode(spark.createDataFrame([(1, "a text", "x")], "doc_id bigint, text string, ids string"), path)
    pieces.decode(coded, path).write.parquet(str(tmp_path / "out"))
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert row["decoded"] == "a text" and list(row["ids"]) == piece_ids(["a text"])[0]


def test_pieces_query_over_whole_texts(spark, documents, no_documents):
    found = {r["doc_id"]: r for r in queries.op8_sentencepiece(spark, SF).collect()}
    rows = documents.select("doc_id", "text").collect()
    for r, ids in zip(rows, piece_ids([r["text"] or "" for r in rows])):
        assert list(found[r["doc_id"]]["ids"]) == ids
    assert len(found) == len(rows) and all(r["round_trip"] for r in found.values())
    assert pieces.encode(no_documents, queries.tokenizer_path("piece_bpe_32k.model")).count() == 0


# -- secrets

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(text):
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ("assign", "access", "hex").index
    return sorted(found, key=lambda s: (s[1], order(s[0])))


def test_base_spans_against_python(spark, documents, odd_texts):
    rng = random.Random(4)
    parts = ["password", "PassWd", "api_key", "APIKEY", "token", "secret", '"', "'", " ", "  ", ":", "=", "abc", "abcdef1", "AKIA", "ABCD1234EFGH5678", "a1b2c3d4" * 3, "0f", "é🙂", "\n", "AKIAAKIA", "tokentoken=token=x"]
    rows = [(d, t) for d, t in odd_texts if d is not None and d not in (5,)]
    rows += [(1000 + i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 40)))) for i in range(400)]
    rows += [(5000 + r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    found = {r["doc_id"]: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)).collect()}
    assert len(found) == len(rows)
    for d, text in rows:
        want = base_spans(text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert found[d]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), d
        assert [found[d][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[0] == k for s in want) for k in ("assign", "access", "hex")]
        assert set(joined.split(",")) - {""} <= set(found[d]["spans"].split(","))


def best_entropy(value, w):
    size = min(w, len(value))
    return max(-sum(c / size * log2(c / size) for c in Counter(value[i : i + size]).values()) for i in range(len(value) - size + 1))


def test_window_entropy_against_python(spark):
    rng = random.Random(8)
    values = ["".join(rng.choice("abcdefghABCDEFGH01234567+/"[: rng.randrange(1, 26)]) for _ in range(rng.randrange(1, 90))) for _ in range(150)]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", secrets.window_entropy(F.col("v"), 20, secrets.CLASSES[1].alphabet).alias("h")).collect()
    assert all(abs(r["h"] - best_entropy(r["v"], 20)) < 1e-9 for r in rows)


def all_spans(text):
    """Base spans, then entropy spans of both classes that touch no span before them, as the docstring says."""
    spans = base_spans(text)
    for pattern, bits, needs in (("[0-9A-Fa-f]{20,}", 2.9, ("[0-9]", "[A-Fa-f]")), ("[A-Za-z0-9+/_-]{20,}={0,2}", 3.6, ("[a-z]", "[A-Z]", "[0-9]"))):
        found = []
        for m in re.finditer(pattern, text):
            v = m[0]
            free = not any(a < m.end() and b > m.start() for _, a, b in spans)
            allowed = re.search(r"(?i)example|sample|dummy|placeholder|changeme|0123456789|abcdefghij", v) or re.search(r"(.)\1{7,}", v)
            if free and all(re.search(n, v) for n in needs) and not allowed and best_entropy(v, 20) >= bits:
                found.append(("entropy", m.start(), m.end()))
        spans = spans + found
    order = ("assign", "access", "hex", "entropy").index
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order(s[0]))))


def test_all_spans_of_whole_documents_against_brute_force(spark, documents):
    rng = random.Random(5)
    made = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    letters = secrets.CLASSES[1].alphabet
    parts = [lambda: made("0123456789ABCDEF", rng.randrange(15, 40)), lambda: made(letters, rng.randrange(15, 60)), lambda: made("0123456789abcdef", 30), lambda: "token=" + made(letters, 12), lambda: "example" + made(letters, 30), lambda: made("ab", 30), lambda: made("ab1Z", 40), lambda: "é🙂 word\n", lambda: "a" * 25]
    rows = [(i, " ".join(rng.choice(parts)() for _ in range(rng.randrange(30)))) for i in range(250)]
    rows += [(1_000, " ".join(rng.choice(parts)() for _ in range(3_000)))]  # a long text with thousands of matches
    rows += [(5_000 + r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    found = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)).collect()}
    assert found == {d: all_spans(t or "") for d, t in rows}
    assert sum("entropy" in x for x in found.values()) > 100


def masked(text, spans):
    """The text with spans (start, end) replaced, overlapping ones together."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


@pytest.mark.parametrize("piece", [7, 64, 1024])
def test_masked_texts_against_brute_force(spark, documents, monkeypatch, piece):
    monkeypatch.setattr(secrets, "PIECE", piece)
    rng = random.Random(piece)
    made = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    letters = secrets.CLASSES[1].alphabet
    parts = [lambda: made(letters, rng.randrange(15, 60)), lambda: made("0123456789abcdef", rng.randrange(20, 90)), lambda: "token=" + made("0123456789abcdef", 30) + "AKIA" + made("ABC123", 20), lambda: "é🙂 word\n", lambda: "x"]
    rows = [(i, rng.choice((" ", "")).join(rng.choice(parts)() for _ in range(rng.randrange(30)))) for i in range(150)]
    rows += [(5_000 + r["doc_id"], r["text"]) for r in documents.where("doc_id % 9 = 0").select("doc_id", "text").collect()]
    found = {r["doc_id"]: r["text"] for r in secrets.redact(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    for d, text in rows:
        spans = [tuple(map(int, s.split(":")[1:])) for s in all_spans(text or "").split(",") if s]
        assert found[d] == (text and masked(text, spans)), d


def test_the_work_grows_with_the_matches(spark):
    took = {}
    for n in (16_000, 64_000):
        text = " ".join(hashlib.sha1(str(i).encode()).hexdigest() for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string").cache()
        docs.count()
        began = time.time()
        row = secrets.scan(docs).first()
        assert row["n_hex"] == n and row["spans"].endswith(f"hex:{41 * (n - 1)}:{41 * n - 1}") and row["found"][-1]["value"] == text[-40:]
        assert secrets.redact(docs).first()["text"] == " ".join(["[SECRET]"] * n)
        took[n] = time.time() - began
    assert took[64_000] < 5 * took[16_000]
    blob = "".join(random.Random(1).choices(secrets.CLASSES[1].alphabet[:62], k=300_000))
    assert secrets.scan(spark.createDataFrame([(1, f"a {blob}")], "doc_id bigint, text string")).first()["spans"] == "entropy:2:300002"


def test_entropy_spans_and_allow_list(spark):
    key = "Zk3vQ9xT7bLm2RsW8pYd4HcN6fGj"
    rows = [(1, f"see {key} here"), (2, "a" * 40), (3, f"EXAMPLE{key}"), (4, "averylongordinarywordwithoutdigits"), (5, f"token={key}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: r["spans"] for r in secrets.scan(docs).collect()}
    assert found == {1: f"entropy:4:{4 + len(key)}", 2: "hex:0:40", 3: "", 4: "", 5: f"assign:0:{6 + len(key)}"}
    assert secrets.scan(docs, allow=secrets.AllowList(exact=(key,))).where("doc_id = 1 and spans <> ''").isEmpty()
    assert {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}[1] == "see [SECRET] here"


def test_secrets_odd_documents(odd_documents, no_documents):
    out = secrets.redact(odd_documents)
    assert out.columns == odd_documents.columns
    assert sorted(map(repr, out.select("doc_id", "text").collect())) == sorted(map(repr, odd_documents.select("doc_id", "text").collect()))
    assert secrets.scan(no_documents).count() == 0


def test_secrets_run_without_python(odd_documents):
    plan = secrets.scan(odd_documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
