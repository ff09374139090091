"""Source divergence audit: how far the sources of a language are from each other in their terms.

The work is done by sorted runs.

1. Each task sorts the terms of a block of documents by (lang, term, source, document)
   and scans the runs: a run of (lang, term, source) gives a count and, by the changes
   of document in it, a document frequency.  A document lies in one task, so the runs of
   several blocks add up; a task adds its own up before they are shuffled.  A term thus
   has one row for each task and source at most, however frequent it is.
2. The runs are repartitioned by (lang, term) and sorted by (lang, term, source).  A scan
   that holds one term at a time adds up what belongs together and keeps the terms of
   enough documents.
3. Kept terms are dealt into chunks of bounded size, which meet the totals of their
   language's sources.  A chunk gives partial sums for each pair of sources, and its
   first ``top`` terms of each source; sums and a last ranking finish both.

Null text, lang and source are read as ''.  Texts without terms only make their group
known.  Each row is a document: repeated rows and rows of equal ids count one by one.
Very long texts are blocks of their own.  No rows give no rows; extra columns aren't read.
Shares are whole numbers throughout: 1 + floor(scale * (count + smoothing) / (total +
smoothing * terms)), exact while totals stay below 9e15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import checkpoint
from .words import LETTERS, Words, blocks

#: Text of a block, runs that a task adds up before it sends them on, and cells (term, source) of a chunk.
BLOCK_BYTES = 4 << 20
HELD_RUNS = 1 << 19
CHUNK_CELLS = 1 << 15
#: Sources whose pairs with all others one group makes, and cells of a dense table of shares.
TILE = 256
DENSE_CELLS = 1 << 20

_RUNS = "lang string, term string, source string, df bigint, n bigint"
_KEPT = "lang string, term string, source string, n bigint, head bigint"
_PARTS = "lang string, part string, source string, item string, value bigint"


def block_runs(part: pa.RecordBatch) -> pa.Table:
    """The runs of a block of (text, lang, source); each group that occurs also has a run of the empty term."""
    words = Words(part.column(0), LETTERS, lower=True)
    told = words.told()
    lang, source = (part.column(i).dictionary_encode() for i in (1, 2))
    lang_of, source_of = (c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in (lang, source))
    doc = words.doc()
    terms, sources = max(len(told.dictionary), 1), len(source.dictionary)
    key = (lang_of[doc] * terms + told.indices.to_numpy(zero_copy_only=False)) * sources + source_of[doc]
    order = np.argsort(key, kind="stable")  # words are in the order of their documents, and stay so within a key
    key, doc = key[order], doc[order]
    new_run = np.ones(len(key), bool)
    new_run[1:] = key[1:] != key[:-1]
    new_doc = new_run.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    first = np.flatnonzero(new_run)
    n = np.diff(np.append(first, len(key)))
    df = np.add.reduceat(new_doc.astype(np.int64), first) if len(first) else n
    key = key[first]
    groups = np.unique(lang_of * sources + source_of)
    none = np.zeros(len(groups), np.int64)
    named = pa.concat_arrays([told.dictionary.cast(pa.string()).take(pa.array(key // sources % terms)), pa.array([""] * len(groups), pa.string())])
    at = lambda d, own, rest: d.dictionary.take(pa.array(np.concatenate([own, rest])))
    return pa.table({
        "lang": at(lang, key // (sources * terms), groups // sources),
        "term": named,
        "source": at(source, key % sources, groups % sources),
        "df": pa.array(np.concatenate([df, none]), pa.int64()),
        "n": pa.array(np.concatenate([n, none]), pa.int64()),
    })


def _added(runs: list[pa.Table]) -> pa.Table:
    table = pa.concat_tables(runs).group_by(["lang", "term", "source"]).aggregate([("df", "sum"), ("n", "sum")])
    return table.select(["lang", "term", "source", "df_sum", "n_sum"]).rename_columns(["lang", "term", "source", "df", "n"])


def _task_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    for batch in batches:
        for part in blocks(batch, "text", BLOCK_BYTES):
            held.append(block_runs(part))
            if sum(t.num_rows for t in held) > HELD_RUNS:
                held = [_added(held)]
                if held[0].num_rows > HELD_RUNS // 2:
                    yield from held.pop().to_batches(max_chunksize=10_000)
    if held:
        yield from _added(held).to_batches(max_chunksize=10_000)


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    out = np.ones(len(column), bool)
    out[1:] = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return out


def _kept_terms(least_docs: int):
    """Sorted runs to the rows of the terms of enough documents; head marks one row of each term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None  # the runs of the last term, which may go on in the next batch

        def closed(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rest
            new_term = _changes(table.column("lang")) | _changes(table.column("term"))
            first = np.flatnonzero(new_term | _changes(table.column("source")))
            df, n = (np.add.reduceat(table.column(c).to_numpy(), first) for c in ("df", "n"))
            table = table.select(["lang", "term", "source"]).take(pa.array(first))
            heads = np.flatnonzero(new_term[first])
            upto = table.num_rows if last else int(heads[-1])
            rest = None if last else table.slice(upto).append_column("df", pa.array(df[upto:])).append_column("n", pa.array(n[upto:]))
            docs = np.repeat(np.add.reduceat(df, heads), np.diff(np.append(heads, len(df))))
            keep = (docs >= least_docs) | pc.equal(table.column("term"), "").to_numpy(zero_copy_only=False)
            head = np.zeros(len(df), np.int64)
            head[heads] = 1
            keep[upto:] = False
            head[pc.equal(table.column("term"), "").to_numpy(zero_copy_only=False)] = 0
            out = table.append_column("n", pa.array(n)).append_column("head", pa.array(head)).filter(pa.array(keep))
            yield from out.to_batches()

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                yield from closed(table if rest is None else pa.concat_tables([rest, table.cast(rest.schema)]), last=False)
        if rest is not None:
            yield from closed(rest, last=True)

    return run


def shares(counts: np.ndarray, total: np.ndarray, scale: int, smoothing: int, terms: int) -> np.ndarray:
    """1 + floor(scale * (count + smoothing) / (total + smoothing * terms)); scale is a power of 1,000."""
    below = total + smoothing * terms
    out, rest = np.divmod(counts + smoothing, below)
    while scale > 1:  # long division, a thousand at a time, never leaves 64 bits
        more, rest = np.divmod(rest * 1000, below)
        out, scale = out * 1000 + more, scale // 1000
    return out + 1


def _compared(scale: int, smoothing: int, top: int, tile_size: int, dense: int):
    def run(key, cells: pa.Table, groups: pa.Table) -> pa.Table:
        lang, tile = key[0].as_py(), key[2].as_py()
        groups = groups.sort_by("source")
        names, total, terms = groups.column("source").combine_chunks(), groups.column("total").to_numpy(), groups.column("terms").to_numpy()
        own = range(tile * tile_size, min((tile + 1) * tile_size, len(names)))
        apart = [np.zeros(len(names) - a - 1, np.int64) for a in own]
        found: list[tuple[str, str, int]] = []
        if cells.num_rows:
            told = cells.column("term").combine_chunks().dictionary_encode()
            source = pc.index_in(cells.column("source"), names).to_numpy()
            told_at, n = told.indices.to_numpy(zero_copy_only=False), cells.column("n").to_numpy()
            order = np.argsort(told_at, kind="stable")
            told_at, source, n = told_at[order], source[order], n[order]
            step = max(1, dense // len(names))
            value_of, term_of, source_of = [], [], []
            for lo in range(0, len(told.dictionary), step):
                size = min(step, len(told.dictionary) - lo)
                i, j = np.searchsorted(told_at, [lo, lo + size])
                counts = np.zeros((size, len(names)), np.int64)
                counts[told_at[i:j] - lo, source[i:j]] = n[i:j]
                p = shares(counts, total[None, :], scale, smoothing, terms[0])
                q = shares(counts.sum(axis=1), total.sum(), scale, smoothing, terms[0])
                for sums, a in zip(apart, own):
                    sums += np.abs(p[:, a, None] - p[:, a + 1 :]).sum(axis=0)
                more = p[:, own.start : own.stop] - q[:, None]
                t, s = np.nonzero((counts[:, own.start : own.stop] > 0) & (more > 0))
                value_of.append(more[t, s]), term_of.append(t + lo), source_of.append(s + own.start)
            value, term, place = (np.concatenate(x) for x in (value_of, term_of, source_of))
            by_bytes = np.empty(len(told.dictionary), np.int64)
            by_bytes[pc.sort_indices(told.dictionary.cast(pa.binary())).to_numpy()] = np.arange(len(by_bytes))
            order = np.lexsort((by_bytes[term], -value, place))
            value, term, place = value[order], term[order], place[order]
            first = np.searchsorted(place, np.arange(len(names)))
            best = np.arange(len(place)) - first[place] < top
            found = list(zip(names.take(pa.array(place[best])).to_pylist(), told.dictionary.take(pa.array(term[best])).to_pylist(), value[best].tolist()))
        pairs = [len(names) - a - 1 for a in own]
        left = np.repeat(np.arange(own.start, own.stop), pairs)
        right = np.concatenate([np.arange(a + 1, len(names)) for a in own])
        return pa.table({
            "lang": pa.array([lang] * (len(left) + len(found)), pa.string()),
            "part": pa.array(["pair"] * len(left) + ["term"] * len(found), pa.string()),
            "source": pa.concat_arrays([names.take(pa.array(left)), pa.array([f[0] for f in found], pa.string())]),
            "item": pa.concat_arrays([names.take(pa.array(right)), pa.array([f[1] for f in found], pa.string())]),
            "value": pa.array(np.concatenate([*apart, [f[2] for f in found]]).astype(np.int64), pa.int64()),
        })

    return run


def term_runs(docs: DataFrame, *, least_docs: int, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, term, source, n, head) of the terms of enough documents, and of the empty term for each group."""
    read = lambda column: F.coalesce(F.col(column).cast("string"), F.lit(""))
    chosen = docs.select(read(text_col).alias("text"), read(lang_col).alias("lang"), read(source_col).alias("source"))
    runs = chosen.mapInArrow(_task_runs, _RUNS).repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return runs.mapInArrow(_kept_terms(least_docs), _KEPT)


def audit(docs: DataFrame, *, least_docs: int = 30, smoothing: int = 5, scale: int = 1_000_000_000, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): a source's distance from each other one, and the terms it uses most above its language."""
    kept = checkpoint(term_runs(docs, least_docs=least_docs, text_col=text_col, lang_col=lang_col, source_col=source_col))
    named = F.col("term") != ""
    groups = checkpoint(kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("head").alias("heads"), F.count_if(named).alias("cells")))
    langs = groups.groupBy("lang").agg(F.sum("heads").alias("terms"), F.greatest(F.ceil(F.sum("cells") / CHUNK_CELLS), F.lit(1)).alias("chunks"), F.ceil(F.count("*") / TILE).alias("tiles"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cells = kept.where(named).join(langs, "lang").select("lang", F.pmod(F.xxhash64("term"), "chunks").alias("chunk"), each("tiles").alias("tile"), "term", "source", "n")
    totals = groups.join(langs, "lang").withColumn("chunk", each("chunks")).select("lang", "chunk", each("tiles").alias("tile"), "source", "total", "terms").toDF("lang", "chunk", "tile", "source", "total", "terms")
    key = ["lang", "chunk", "tile"]
    parts = checkpoint(cells.groupBy(key).cogroup(totals.groupBy(key)).applyInArrow(_compared(scale, smoothing, top, TILE, DENSE_CELLS), _PARTS))
    pairs = parts.where("part = 'pair'").groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", "part", ways.alias("way"), "value").select("lang", "way.source", "part", "way.item", "value")
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    out = pairs.unionByName(parts.where("part = 'term'").select(pairs.columns)).withColumn("rank", F.row_number().over(ranked))
    return out.where((F.col("part") == "pair") | (F.col("rank") <= top))
