"""Source divergence, fingerprints and importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from agoralake.llm import divergence, importance, queries, simhash

from .conftest import SF

# -- source divergence


def told_apart(rows, least, smoothing=5, top=50):
    """The audit's rows for (text, lang, source) rows, as a set."""
    df, counts, groups = Counter(), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        df.update((lang, t) for t in set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for (k, t), n in df.items() if k == lang and n >= least]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + smoothing) // (total[s] + smoothing * len(kept)) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in sources) + smoothing) // (sum(total.values()) + smoothing * len(kept)) for t in kept}
        for s in sources:
            pairs = sorted(((o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s), key=lambda x: (-x[1], x[0].encode()))
            terms = sorted(((t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]), key=lambda x: (-x[1], x[0].encode()))[:top]
            out += [(lang, s, part, item, value, i + 1) for part, found in (("pair", pairs), ("term", terms)) for i, (item, value) in enumerate(found)]
    return sorted(out)


@pytest.fixture(scope="module")
def sourced():
    """(text, lang, source): several batches, a hot source, a term in most documents, nulls, odd letters, ties."""
    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "aeiouäß" for c in "xyzœ"]
    rows = []
    for i in range(900):
        lang = rng.choice(["de", "fr", None, ""])
        source = "hot" if i % 3 == 0 else rng.choice(["one", "two", "Zwei", "été", None, ""])
        own = words[:60] if source == "one" else words
        rows.append((" THE ".join(rng.choices(own, k=rng.randint(0, 25))) or None, lang, source))
    return [*rows, *rows[:20], ("the " * 50_000, "de", "long"), ("123 --", "xx", "none"), (None, "xx", "other"), ("", "yy", "alone")]


def test_divergence(spark, sourced, monkeypatch):
    docs = spark.createDataFrame(sourced, "text string, lang string, source string").repartition(7)
    expected = told_apart(sourced, 30)
    assert sorted(map(tuple, divergence.audit(docs).collect())) == expected and len(expected) > 300
    # many chunks, tiles and merges make no difference
    for name, value in (("CHUNK_CELLS", 40), ("TILE", 2), ("DENSE_CELLS", 30)):
        monkeypatch.setattr(divergence, name, value)
    assert sorted(map(tuple, divergence.audit(docs.coalesce(2), least_docs=100, top=3).collect())) == told_apart(sourced, 100, top=3)


def test_runs_that_a_task_cannot_hold(sourced, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "BLOCK_BYTES", 200)
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] or "" for r in sourced], pa.string()) for k in range(3)], names=["text", "lang", "source"])
    def sums():
        out = Counter()
        for b in divergence._task_runs(iter([batch.slice(0, 300), batch.slice(300, 0), batch.slice(300)])):
            for r in b.to_pylist():
                out.update({(r["lang"], r["term"], r["source"], k): r[k] for k in ("df", "n")})
        return out
    whole = sums()
    monkeypatch.setattr(divergence, "HELD_RUNS", 50)
    assert sums() == whole and whole["de", "the", "long", "n"] == 50_000 and whole["de", "the", "long", "df"] == 1


def test_shares_of_large_counts():
    import numpy as np

    counts, totals = [0, 7, 10**12, 8 * 10**15], [1, 10**13, 9 * 10**14, 8 * 10**15 + 10**9]
    got = divergence.shares(np.array(counts), np.array(totals), 10**9, 5, 1000)
    assert got.tolist() == [1 + 10**9 * (c + 5) // (n + 5000) for c, n in zip(counts, totals)]


def test_divergence_odd_documents(odd_documents, no_documents, odd_texts):
    assert divergence.audit(no_documents).count() == 0
    assert sorted(map(tuple, divergence.audit(odd_documents, least_docs=1).collect())) == told_apart([(t, "en", None) for _, t in odd_texts], 1)


# -- fingerprints


def simhash_of(text, words=3):
    hashes = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()) if w]
    both = lambda a, b: xxhash.xxh64(b.to_bytes(8, "little"), seed=xxhash.xxh64(a.to_bytes(8, "little"), seed=42).intdigest()).intdigest()

    def run(h, first=None):
        for x in h:
            first = x if first is None else both(first, x)
        return first

    terms = [run(hashes[i : i + words]) for i in range(len(hashes) - words + 1)] if len(hashes) >= words else [run(hashes, 0)] if hashes else []
    return sum(1 << i for i in range(64) if 2 * sum(t >> i & 1 for t in terms) > len(terms))


def same(a, b):
    return 1 - (a ^ b).bit_count() / 64


def audited(rows):
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of (doc_id, text) in order."""
    rows = [(d, t or "") for d, t in rows]
    for i, (d, text) in enumerate(rows):
        other, cut = rows[(i + 1) % len(rows)][1], len(text) // 4
        edited = text[: len(text) - cut] + other[:cut]
        f, e = simhash_of(text), simhash_of(edited)
        yield d, len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{f:016x}", f"{e:016x}", same(f, e), same(f, simhash_of(other))


def test_fingerprints_of_whole_documents(spark, documents):
    found = sorted(tuple(r)[:7] for r in queries.op12_document_fingerprints(spark, SF).collect())
    assert found == sorted(audited(sorted(map(tuple, documents.select("doc_id", "text").collect()))))
    # an edited text is nearer than the next document, but for a few short texts
    assert sum(r[5] > r[6] for r in found) > 0.98 * len(found)


def test_fingerprints_odd_documents(spark, odd_documents, no_documents, odd_texts):
    assert simhash.audit(no_documents).count() == 0
    rows = sorted(odd_texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None))
    tied = [r for r in rows if r[0] is None]  # in the order of their hashes
    tied.sort(key=lambda r: int.from_bytes(xxhash.xxh64((r[1] or "").encode(), seed=42).intdigest().to_bytes(8, "big"), "big", signed=True))
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    found = simhash.audit(odd_documents).withColumns({c: simhash.hex_digits(F.col(c)) for c in columns[3:5]}).select(columns).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, audited(tied + [r for r in rows if r[0] is not None])))
    alone = simhash.audit(spark.createDataFrame([(7, "one two three four")], "doc_id bigint, text string")).first()
    assert alone["near_next"] == 1.0 and alone["n_chars"] == 18


def test_slices_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 7)
    texts = [" ".join(f"w{i * k % 31}" for i in range(n)) for n, k in ((2, 1), (9, 2), (10, 3), (16, 5), (400, 7))]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", simhash.hex_digits(simhash.fingerprint(F.col("text"))).alias("f"))
    assert [(r["text"], r["f"]) for r in df.collect()] == [(t, f"{simhash_of(t):016x}") for t in texts]


@pytest.mark.parametrize(("radius", "blocks"), [(3, 4), (3, 6), (1, None), (0, 2)])
def test_all_fingerprints_in_the_radius(spark, radius, blocks, monkeypatch):
    monkeypatch.setattr(simhash, "LIST", 5)
    rng = random.Random(radius)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = [c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(40)]
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    all_rows = spark.createDataFrame([(x,) for x in [*signed, *signed[:30], None]], "fingerprint bigint")
    asked = spark.createDataFrame([(x,) for x in [*signed[::7], signed[0], 12345, None]], "fingerprint bigint")
    copies = Counter([*signed, *signed[:30]])
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    expected = sorted((q, o, n, apart(q, o)) for q in {*signed[::7], 12345} for o, n in copies.items() if apart(q, o) <= radius)
    assert sorted(map(tuple, simhash.within(all_rows, asked, radius=radius, blocks=blocks).collect())) == expected
    counts = Counter()
    for q, _, n, _ in expected:
        counts[q] += n
    assert {r["fingerprint"]: r["n_within"] for r in simhash.count_within(all_rows, asked, radius=radius, blocks=blocks).collect() if r["n_within"]} == counts


def test_fingerprints_without_python(spark):
    plan = queries.op12_document_fingerprints(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    pairs = simhash.audit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", pairs)


# -- importance


def resampled(docs, target, percent=10, least=20, longest=1, buckets=10_000):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    own, aims = [features(t) for _, t in docs], [features(t)[1] for t in target]
    s, t = Counter(b for _, f in own for b in f), Counter(b for f in aims for b in f)
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (t_all + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b, t_all in ((b, sum(s.values())) for b in s)}
    out = []
    for (d, _), (n, f) in zip(docs, own):
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[3], r[2]))
    drawn = len(able) * percent // 100
    ranks = [(*r, i + 1 if i < drawn else None) for i, r in enumerate(able)]
    return sorted(map(repr, [*ranks, *((*r, None) for r in out if r[1] < least)]))


def test_resampling_runs_of_words(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["the", "The", *(f"w{rng.randint(0, 200)}", "ÄÖ7")]) for _ in range(n))
    rows = [(i % 290, text(rng.randint(0, 60))) for i in range(300)] + [(1, None), (None, "the " * 30), (None, ""), (5, "the " * 9000)]
    target = [text(40) for _ in range(9)] + [None, ""]
    docs, aims = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), spark.createDataFrame([(t,) for t in target], "text string")
    assert sorted(repr(tuple(r)) for r in importance.resample(docs, aims, longest=2, buckets=5000, percent=40, least_words=10).collect()) == resampled(rows, target, 40, 10, 2, 5000)
    # shelves in many parts, blocks of few documents
    monkeypatch.setattr(importance, "PART_BYTES", 200)
    monkeypatch.setattr(importance, "BLOCK_BYTES", 500)
    assert sorted(repr(tuple(r)) for r in importance.resample(docs, aims, least_words=0).collect()) == resampled(rows, target, 10, 0)


def test_resampling_odd_documents(spark, odd_documents, no_documents, odd_texts):
    nothing = no_documents.select("text")
    assert importance.resample(no_documents, nothing).count() == 0
    assert sorted(repr(tuple(r)) for r in importance.resample(odd_documents, nothing, percent=100).collect()) == resampled(odd_texts, [], 100)
