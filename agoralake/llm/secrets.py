"""Secret scans with DataFrame functions alone (no Python on the executors).

Base detectors are three regular expressions.  The place of each match follows from
the lengths of the matches and of the text between them.  The entropy detector cuts
candidate strings out of the text by character class (hexadecimal, then base64) and
slides a window over each; the window's character counts, packed into a few 64-bit
numbers, and the sum of c*log2(c) are updated for the one character that enters and
the one that leaves.  A candidate whose best window reaches the class's threshold is
a span unless the allow-list suppresses it.  Base spans always stay;
the allow-list and overlaps apply to entropy spans only.

Offsets are code points, end exclusive.  Null and empty texts have no spans.  The work on
a text grows with its length and, but for a logarithm, with its matches, so very long
texts with very many matches are texts like others: places are prefix sums, taken by
doubling; overlaps are found by binary search; texts are cut apart in pieces.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from dataclasses import dataclass, field
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import numbered, position, sha256_hex

# The base detectors in listed order (kind, pattern, group that is measured, least length).
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)


@dataclass(frozen=True)
class EntropyClass:
    """A character class: its candidates, the window and the bits per character that mark a secret."""

    name: str
    pattern: str
    window: int
    bits: float
    #: The characters of the pattern.
    alphabet: str
    #: What a random string of the class must show besides entropy.
    needs: tuple[str, ...] = ()


_HEX = "0123456789abcdefABCDEF"
_BASE64 = string.ascii_letters + string.digits + "+/_-="
#: Hexadecimal candidates hold digits and letters; base64 ones lower case, upper case and digits.
CLASSES = (
    EntropyClass("hex", r"[0-9A-Fa-f]{20,}", 20, 2.9, _HEX, ("[0-9]", "[A-Fa-f]")),
    EntropyClass("base64", r"[A-Za-z0-9+/_-]{20,}={0,2}", 20, 3.6, _BASE64, ("[a-z]", "[A-Z]", "[0-9]")),
)


@dataclass(frozen=True)
class AllowList:
    """Candidates that are no secrets: exact strings, and patterns found anywhere in them."""

    exact: tuple[str, ...] = ()
    patterns: tuple[str, ...] = field(default=(r"(?i)example", r"(?i)sample|dummy|placeholder|changeme", r"(.)\1{7,}", r"(?i)0123456789|abcdefghij"))


#: Characters of a piece that spans are cut out of.
PIECE = 1024
_PLACES = "array<struct<start:int,end:int,whole:string>>"
_SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """The running sum, maximum or the like of an array: in step k each place takes in the one 2**k before it."""
    steps = F.filter(F.sequence(F.lit(0), F.lit(30)), lambda k: F.call_function("shiftleft", F.lit(1), k) < F.size(values))

    def step(now: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.concat(F.slice(now, F.lit(1), back), F.zip_with(F.slice(now, back + 1, F.size(now)), F.slice(now, F.lit(1), F.size(now) - back), both))

    return F.aggregate(steps, values, step)


def below(values: Column, bound: Column) -> Column:
    """How many elements of an ascending array are less than bound."""
    n = F.size(values)
    steps = F.sequence(F.lit(30), F.lit(0), F.lit(-1))

    def step(at: Column, k: Column) -> Column:
        on = at + F.call_function("shiftleft", F.lit(1), k)
        # a place beyond the end, or beyond all numbers, is not tried
        return F.when((on > at) & (on <= n) & (F.element_at(values, F.greatest(F.least(on, n), F.lit(1))) < bound), on).otherwise(at)

    return F.when(n > 0, F.aggregate(steps, F.lit(0), step)).otherwise(0)


def _placed(text: Column, pattern: str) -> Column:
    """array<struct<start, end, whole>> of a pattern's leftmost non-overlapping matches."""
    # the text before each match, and what follows the last one, which meets no match
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def placed(found: Column) -> Column:
        sizes = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, whole: gap + F.length(whole))
        place = lambda whole, end: F.struct((end - F.length(whole)).alias("start"), end.alias("end"), whole.alias("whole"))
        return F.when(F.size(found) > 0, F.zip_with(found, let(sizes, lambda x: running(x, lambda a, b: a + b)), place)).otherwise(F.array().cast(_PLACES))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _span(kind: str, order: int, m: Column) -> Column:
    return F.struct(m["start"].alias("start"), F.lit(order).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["whole"].alias("value"))


def _base(text: Column, order: int) -> Column:
    kind, pattern, group, least = BASE[order]
    kept = F.filter(_placed(text, pattern), lambda m: F.length(F.regexp_extract(m["whole"], pattern, group)) >= least)
    return F.transform(kept, lambda m: _span(kind, order, m))


def window_entropy(value: Column, window: int, alphabet: str) -> Column:
    """The largest Shannon entropy (bits a character) of value's windows; shorter values are one window.

    State: the counts of the alphabet's characters in the window, a few bits each and
    several in one number, and s = sum of c*log2(c); a step changes the counts of two
    characters.  The entropy of a full window of w characters is log2(w) - s/w.
    """
    bits = (window + 1).bit_length()
    per = 63 // bits
    numbers = -(-len(alphabet) // per)
    terms = F.array(*[F.lit(c * log2(c) if c else 0.0) for c in range(window + 2)])
    size = F.least(F.length(value), F.lit(window))
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), numbers).alias("counts"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))

    def place(k: Column) -> tuple[Column, Column]:
        """The number that counts the k-th character of the alphabet, and the bit where its count begins."""
        return F.floor(k / per).cast("int"), (k % per * bits).cast("int")

    def count(state: Column, number: Column, bit: Column) -> Column:
        return F.call_function("shiftright", F.element_at(state["counts"], number + 1), bit).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")

    def step(codes: Column, state: Column, i: Column) -> Column:
        full = i > size
        n_in, b_in = place(F.element_at(codes, i))
        n_out, b_out = place(F.element_at(codes, F.greatest(i - size, F.lit(1))))
        same = (n_in == n_out) & (b_in == b_out)
        c_in, c_out = count(state, n_in, b_in), count(state, n_out, b_out)
        term = lambda c: F.element_at(terms, c + 1)
        # one character that leaves and enters again changes nothing
        enters = ~full | ~same
        s = state["s"] + F.when(enters, term(c_in + 1) - term(c_in)).otherwise(0.0) + F.when(full & ~same, term(F.greatest(c_out - 1, F.lit(0))) - term(c_out)).otherwise(0.0)
        one = lambda bit: F.call_function("shiftleft", F.lit(1).cast("long"), bit)
        counts = F.transform(state["counts"], lambda c, j: c + F.when(j == n_in, one(b_in)).otherwise(0) - F.when(full & (j == n_out), one(b_out)).otherwise(0))
        entropy = F.log2(size.cast("double")) - s / size
        return F.struct(counts.alias("counts"), s.alias("s"), F.when(i >= size, F.greatest(state["best"], entropy)).otherwise(state["best"]).alias("best"))

    codes = F.transform(F.split(value, ""), lambda c: F.position(c, F.lit(alphabet)) - 1)
    return let(codes, lambda codes: F.aggregate(F.sequence(F.lit(1), F.size(codes)), zero, lambda state, i: step(codes, state, i), lambda s: s["best"]))


def _allowed(value: Column, allow: AllowList) -> Column:
    out = value.isin(list(allow.exact)) if allow.exact else F.lit(False)
    for pattern in allow.patterns:
        out = out | value.rlike(pattern)
    return out


def _entropy(text: Column, kind: EntropyClass, order: int, taken: Column, allow: AllowList) -> Column:
    """Spans of a class that overlap none of those taken, which are in order."""

    def secrets(own: Column) -> Column:
        starts, ends = own["starts"], own["ends"]

        def secret(m: Column) -> Column:
            value, before = m["whole"], below(starts, m["end"])
            free = F.when(before > 0, F.element_at(ends, F.greatest(before, F.lit(1))) <= m["start"]).otherwise(True)
            ok = F.lit(True)
            for need in kind.needs:
                ok = ok & value.rlike(need)
            return F.when(ok & ~_allowed(value, allow), free & (window_entropy(value, kind.window, kind.alphabet) >= kind.bits)).otherwise(False)

        return F.transform(F.filter(_placed(text, kind.pattern), secret), lambda m: _span("entropy", order, m))

    starts, ends = F.transform(taken, lambda t: t["start"]), let(F.transform(taken, lambda t: t["end"]), lambda x: running(x, lambda a, b: F.greatest(a, b)))
    return let(F.struct(starts.alias("starts"), ends.alias("ends")), secrets)


def with_spans(docs: DataFrame, text: str, classes: tuple[EntropyClass, ...] = CLASSES, allow: AllowList = AllowList()) -> DataFrame:
    """docs and the columns base and spans: arrays of (start, rank, end, kind, value) by start, then kind."""
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({f"_b{i}": _base(whole, i) for i in range(len(BASE))})
    out = out.withColumn("base", F.array_sort(F.concat(*[F.col(f"_b{i}") for i in range(len(BASE))])))
    out = out.withColumn("spans", F.col("base"))
    for i, kind in enumerate(classes):
        out = out.withColumn("spans", F.array_sort(F.concat("spans", _entropy(whole, kind, len(BASE), F.col("spans"), allow))))
    return out.drop(*[f"_b{i}" for i in range(len(BASE))])


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", classes: tuple[EntropyClass, ...] = CLASSES, allow: AllowList = AllowList()) -> DataFrame:
    """One row per document: doc_id, the spans with their strings, and the digests of the base spans."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = with_spans(chosen, "text", classes, allow)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(
        "doc_id",
        *[count(kind) for kind, *_ in BASE],
        sha256_hex(spans_text(F.col("base"))).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
        F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))).alias("found"),
    )


def _apart(spans: Column) -> Column:
    """struct<starts, ends>: ordered spans, those that overlap as one."""

    def apart(upto: Column) -> Column:
        head = lambda i: (i == 1) | (F.element_at(spans, i)["start"] >= F.element_at(upto, F.greatest(i - 1, F.lit(1))))
        heads = F.filter(F.sequence(F.lit(1), F.size(upto)), head)
        ends = lambda heads: F.transform(heads, lambda h, k: F.element_at(upto, F.when(k + 1 < F.size(heads), F.element_at(heads, F.least(k + 2, F.size(heads))) - 1).otherwise(F.size(upto))))
        return let(heads, lambda heads: F.struct(F.transform(heads, lambda h: F.element_at(spans, h)["start"]).alias("starts"), ends(heads).alias("ends")))

    return let(let(F.transform(spans, lambda s: s["end"]), lambda x: running(x, lambda a, b: F.greatest(a, b))), apart)


def _cut(text: Column, spans: Column, mask: str) -> Column:
    """The text with each of its spans (at least one) replaced by mask, piece by piece."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    zero = lambda at: F.struct(at.alias("next"), F.lit("").alias("out"))

    def cut(own: Column) -> Column:
        starts, ends = own["starts"], own["ends"]

        def one(piece: Column, k: Column) -> Column:
            at = k * PIECE
            # the spans that begin before the piece ends and end after it begins
            first, last = below(ends, at + 1) + 1, below(starts, at + PIECE)

            def step(state: Column, i: Column) -> Column:
                start, end = F.element_at(starts, i), F.element_at(ends, i)
                kept = F.substring(piece, state["next"] - at + 1, F.greatest(start - state["next"], F.lit(0)))
                return F.struct(F.greatest(state["next"], end).alias("next"), F.concat(state["out"], kept, F.when(start >= at, mask).otherwise("")).alias("out"))

            rest = lambda s: F.concat(s["out"], F.substring(piece, s["next"] - at + 1, F.lit(PIECE)))
            return F.when(last >= first, F.aggregate(F.sequence(first, F.greatest(first, last)), zero(at), step, rest)).otherwise(piece)

        return F.array_join(F.transform(pieces, one), "")

    return let(let(spans, _apart), cut)


def redact(docs: DataFrame, *, text_col: str = "text", mask: str = "[SECRET]", classes: tuple[EntropyClass, ...] = CLASSES, allow: AllowList = AllowList()) -> DataFrame:
    """The columns of docs, every span of the text (overlapping ones together) replaced by mask."""
    text = position(docs, text_col)
    out = with_spans(numbered(docs), text, classes, allow)
    clean = _cut(F.col(text), F.col("spans"), mask)
    out = out.withColumn(text, F.when(F.size("spans") > 0, clean).otherwise(F.col(text)))
    return out.select(*[F.col(f"c{i}") for i in range(len(docs.columns))]).toDF(*docs.columns)
