"""Secret scans with built-in functions only: credential patterns and sliding-window entropy.

The base patterns are credentials by their form. The method adds what has no form: a window slides over candidate
strings of a character class, and the Shannon entropy of its characters is kept up to date by counts that change
for one leaving and one entering character. Base spans are cut out of the text first, so what is left beside them is
still a candidate. The allow list works at two sizes: a candidate that as a whole is an identifier, number, path or
checksum is no secret; a placeholder word suppresses only the windows that overlap it or its short segment.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from evalkiln.llm.common import small_batches
from evalkiln.llm.spans import digest, labelled, let, merged, replaced, spans_of

#: The base patterns and what a match needs.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")


@dataclass(frozen=True)
class CharClass:
    """Candidates are runs of ``alphabet`` with at least ``window`` characters, as ``pattern`` finds them.

    ``threshold`` is in bits a character, of at most log2(min(window, len(alphabet))).
    """

    kind: str
    alphabet: str
    pattern: str
    window: int
    threshold: float


_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: "=" is in no class: it stands between names and values, and what it pads at the end says nothing.
CLASSES = (
    CharClass("entropy_hex", _DIGIT + "abcdefABCDEF", r"(?<![A-Za-z0-9])[0-9a-fA-F]{24,}+(?![A-Za-z0-9])", 24, 3.0),
    CharClass("entropy_base64", _UPPER + _LOWER + _DIGIT + "+/_-", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+", 24, 4.0),
)
#: A candidate that is one of these as a whole is no secret: identifiers without digits, numbers, UUIDs, paths and
#: slugs of short words and numbers, checksums of published files.
ALLOWED = (
    r"^[^0-9]*$",
    r"^[0-9_+/-]*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^/?[0-9]{0,8}[A-Za-z]{0,15}[0-9]{0,8}(?:[/_-]+[0-9]{0,8}[A-Za-z]{0,15}[0-9]{0,8})+$",
    r"^sha(?:1-[A-Za-z0-9+/]{27}|256-[A-Za-z0-9+/]{43}|384-[A-Za-z0-9+/]{64}|512-[A-Za-z0-9+/]{86})$",
)
def _rising(first: str, rest: str) -> str:
    """``first`` and as much of ``rest`` as follows it."""
    tail = ""
    for ch in reversed(rest):
        tail = f"(?:{ch}{tail})?"
    return first + tail


#: Words of placeholders and published example keys, and alphabets in their order.
PLACEHOLDER = f"(?i)(?:{_rising('abcdefgh', 'ijklmnopqrstuvwxyz')}|{_rising('01234567', '89')}|example|sample|placeholder|dummy|redacted|xxxxxx)"
#: Between "-" and "_", a segment of at most so many characters is quiet so far around a placeholder (published example
#: keys end in one); in a longer one, and beyond its ends, only windows that overlap the placeholder are.
SEGMENT, REACH = 64, 40
STRETCH = "array<struct<from:int,to:int>>"


def quiet(candidate: Column, placeholder: str = PLACEHOLDER, reach: int = REACH, segment: int = SEGMENT) -> Column:
    """The stretches (from, to) that placeholders keep quiet: a window that overlaps one doesn't count."""

    def around(s: Column) -> Column:
        before = F.length(F.regexp_extract(F.substring(candidate, F.lit(1), s["start"]), "[^_-]*$", 0))
        behind = F.length(F.regexp_extract(F.substring(candidate, s["stop"] + 1, F.length(candidate)), "^[^_-]*", 0))
        wide = before + (s["stop"] - s["start"]) + behind <= segment
        far = lambda n: F.when(wide, F.least(n, F.lit(reach))).otherwise(0)
        return F.struct((s["start"] - far(before)).alias("from"), (s["stop"] + far(behind)).alias("to"))

    return F.transform(spans_of(candidate, placeholder), around)


def entropy_spans_of(candidate: Column, c: CharClass, placeholder: str = PLACEHOLDER) -> Column:
    """The stretches (from, to) of a candidate that windows of high entropy cover; windows that touch or overlap are one stretch.

    H = log2(w) - sum(n log2 n) / w; a step changes two counts and two terms of the sum. The counts are packed in
    longs, so a step moves a few numbers, not one for each character of the alphabet.
    """
    w = c.window
    bits = w.bit_length()
    per = 62 // bits
    g = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(w + 1)])
    most = w * (math.log2(w) - c.threshold) + 1e-9  # the sum may not exceed this
    power = F.array(*[F.lit(1 << bits * k).cast("bigint") for k in range(per)])
    digits = F.array(*[F.lit(i // per) for i in range(len(c.alphabet))]), F.array(*[F.lit(i % per) for i in range(len(c.alphabet))])

    def slide(codes: Column, near: Column) -> Column:
        shift = F.array(*[F.lit(i % per * bits) for i in range(len(c.alphabet))])
        whole = lambda n, code: F.call_function("shiftright", F.get(n, F.get(digits[0], code)), F.get(shift, code)).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
        moved = lambda n, code, by: F.transform(n, lambda x, i: F.when(i == F.get(digits[0], code), x + by * F.get(power, F.get(digits[1], code))).otherwise(x))

        def leave(s: Column, at: Column) -> Column:
            code = F.get(codes, at - w - 1)
            gone = let(whole(s["n"], code), lambda n: F.struct(moved(s["n"], code, -1).alias("n"), (s["sum"] - g[n] + g[n - 1]).alias("sum")))
            return F.when(at > w, gone).otherwise(F.struct(s["n"].alias("n"), s["sum"].alias("sum")))

        def enter(s: Column, t: Column, at: Column) -> Column:
            code = F.get(codes, at - 1)
            total = let(whole(t["n"], code), lambda n: t["sum"] + g[n + 1] - g[n])
            return let(total, lambda x: mark(s, moved(t["n"], code, 1), x, at))

        def mark(s: Column, n: Column, total: Column, at: Column) -> Column:
            high = (at >= w) & (total <= most) & ~F.exists(near, lambda p: (at - w < p["to"]) & (at > p["from"]))
            new = high & (s["to"].isNull() | (s["to"] < at - w))
            return F.struct(
                n.alias("n"), total.alias("sum"), F.when(new, at - w).otherwise(s["from"]).alias("from"), F.when(high, at).otherwise(s["to"]).alias("to"),
                F.when(new & s["to"].isNotNull(), F.concat(s["done"], F.array(F.struct(s["from"].alias("from"), s["to"].alias("to"))))).otherwise(s["done"]).alias("done"),
            )

        nothing = F.lit(None).cast("int")
        zero = F.array(*[F.lit(0).cast("bigint")] * -(-len(c.alphabet) // per))
        start = F.struct(zero.alias("n"), F.lit(0.0).alias("sum"), nothing.alias("from"), nothing.alias("to"), F.array().cast(STRETCH).alias("done"))
        step = lambda s, at: let(leave(s, at), lambda t: enter(s, t, at))
        last = lambda s: F.when(s["to"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["from"].alias("from"), s["to"].alias("to")))))
        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), start, step, last)

    codes = F.transform(F.split(candidate, ""), lambda ch: F.instr(F.lit(c.alphabet), ch) - 1)
    return let(F.filter(codes, lambda x: x >= 0), lambda k: let(quiet(candidate, placeholder), lambda near: F.when(F.size(k) < w, F.array().cast(STRETCH)).otherwise(slide(k, near))))


def base_spans(text: Column) -> Column:
    """Labelled base spans by place, then kind."""
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1))
    assign = F.filter(spans_of(text, ASSIGN), lambda s: value(s["match"]) >= 8)
    parts = (("assign", assign), ("access", spans_of(text, ACCESS)), ("hex", spans_of(text, HEX)))
    return F.array_sort(F.concat(*[labelled(s, kind, KINDS.index(kind)) for kind, s in parts]))


def _blanked(text: Column, spans: Column) -> Column:
    """The text with spaces in place of the spans, so that all offsets stay."""
    return replaced(text, merged(spans), lambda s: F.repeat(F.lit(" "), s["stop"] - s["start"]))


def entropy_spans(rest: Column, c: CharClass, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Labelled spans of high entropy of one class in ``rest``, the text without what earlier searches took."""
    ok = lambda s: ~F.concat(*[F.when(s["match"].rlike(p), "x").otherwise("") for p in allowed]).contains("x")
    label = lambda s, part: F.struct((s["start"] + part["from"]).alias("start"), F.lit(KINDS.index(c.kind)).alias("rank"), (s["start"] + part["to"]).alias("stop"), F.lit(c.kind).alias("kind"))
    candidates = F.filter(spans_of(rest, c.pattern), ok)
    return F.flatten(F.transform(candidates, lambda s: F.transform(entropy_spans_of(s["match"], c), lambda part: label(s, part))))


def scan_secrets(docs: DataFrame, text_col: str = "text", classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``docs`` with base_spans and added_spans: arrays of (start, rank, stop, kind), offsets in code points.

    Every row stays; null text counts as empty and has no spans; the text is searched whole; repeated rows agree.
    Columns of the same names are replaced, other columns may have any name.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("base_spans", "added_spans")]
    df = docs.select(F.struct(*keep).alias("kept"), F.coalesce(F.col(text_col), F.lit("")).alias("rest"))
    df = df.withColumn("base_spans", base_spans(F.col("rest"))).withColumn("rest", _blanked(F.col("rest"), F.col("base_spans")))
    for i, c in enumerate(classes):
        df = df.withColumn(f"found{i}", entropy_spans(F.col("rest"), c, allowed)).withColumn("rest", _blanked(F.col("rest"), F.col(f"found{i}")))
    return df.select(*[F.col("kept")[c].alias(c) for c in keep], "base_spans", F.array_sort(F.concat(*[f"found{i}" for i in range(len(classes))])).alias("added_spans"))


def redact(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with each secret in ``text_col`` replaced by ``<kind>``; rows, columns and other text stay.

    Overlapping spans count as one and take the kind of the first. Null text stays null.
    """
    columns = docs.columns
    found = scan_secrets(docs.select(F.struct(*columns).alias("__row"), F.col(text_col).alias("__text")), "__text", **options)
    t = F.col("__text")
    clean = replaced(t, merged(F.array_sort(F.concat("base_spans", "added_spans"))), lambda s: F.concat(F.lit("<"), s["kind"], F.lit(">")))
    return found.select(*[(F.when(t.isNull(), t).otherwise(clean) if c == text_col else F.col("__row")[c]).alias(c) for c in columns])


def op1_secret_scans(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(digest(F.col("base_spans")), 256).alias("base_sha256"),
        digest(F.array_sort(F.concat("base_spans", "added_spans"))).alias("spans"),
    )
