"""Fill-in-the-middle: documents are cut into prefix, middle and suffix, and put together again in another order.

The units between which a text may be cut are the isolated matches of the ``Split`` pre-tokenizer of the tokenizers
library, which needs no training. It gives code-point offsets: their number is the number of units, and the offset of a
rank is a place to cut. A space is a unit of its own, so the words between spaces are split one by one, each distinct
one once in a task, and their numbers of units are added up.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from tokenizers import Regex, pre_tokenizers

from evalkiln.llm.common import carried, restored, small_batches, table

UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Marks before prefix, suffix and middle; a text that contains one of them stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many are transformed, and of 100 transformed ones so many begin with the suffix.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: A long text is read in parts of about so many code points, which bounds the memory of its words and offsets.
PART = 1 << 16
#: Words of up to so many code points are kept from text to text. A task that has more than so many of them forgets them.
SHORT, KNOWN = 64, 1 << 19

_other = re.compile("[^A-Za-z]")


class Units(dict):
    """word without space -> its number of units. Short words stay for the parts after; long ones stay with their ends, for one part."""

    def __init__(self) -> None:
        self.split = pre_tokenizers.Split(Regex(UNIT), behavior="isolated")
        self.long: dict[str, list[int]] = {}

    def ends(self, word: str) -> list[int]:
        """The end of every unit of ``word``."""
        return self.long.get(word) or [at[1] for _, at in self.split.pre_tokenize_str(word)]

    def __missing__(self, word: str) -> int:
        if len(word) <= SHORT:
            n = self[word] = len(self.split.pre_tokenize_str(word))
            return n
        found = self.long[word] = self.ends(word)
        return len(found)

    def read(self, part: str) -> tuple[list[str], np.ndarray]:
        """The words between the spaces of ``part``, and how many units each has."""
        self.long.clear()
        if len(self) > KNOWN:
            self.clear()
        words = part.split(" ")
        return words, np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def place(self, words: list[str], counts: np.ndarray, rank: int) -> int:
        """The code points of the first ``rank`` units of what was read."""
        before = np.cumsum(counts + 1) - (counts + 1)
        k = int(np.searchsorted(before, rank, "right")) - 1
        rest = rank - int(before[k])
        return sum(map(len, words[:k])) + k + (self.ends(words[k])[rest - 1] if rest else 0)


def _parts(text: str) -> list[tuple[int, int]]:
    """Start and end of each part. A part ends beside a code point that is no letter, so no unit is cut."""
    found, at = [], 0
    while at < len(text):
        stop = min(at + PART, len(text))
        if stop < len(text) and not _other.match(text, stop - 1):
            beyond = _other.search(text, stop)
            stop = beyond.start() if beyond else len(text)
        found.append((at, stop))
        at = stop
    return found


def transformed(text: str, key: str, units: Units) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix and of the middle, output) of one text under one key."""
    parts, sizes, last, read = _parts(text), [], -1, ([], np.zeros(0, np.int64))
    for last, (at, stop) in enumerate(parts):
        read = units.read(text[at:stop])
        sizes.append(int(read[1].sum()) + len(read[0]) - 1)
    *before, n = accumulate(sizes, initial=0)
    h = [int(key[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or h[2] % 100 >= TRANSFORMED or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    places = []
    for rank in sorted((h[0] % (n + 1), h[1] % (n + 1))):
        p = bisect_right(before, rank) - 1
        at, stop = parts[p]
        places.append(at + units.place(*(read if p == last else units.read(text[at:stop])), rank - before[p]))
    i, j = places
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if h[3] % 100 < SUFFIX_FIRST:
        return n, "spm", i, j - i, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", i, j - i, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (by default the id), and n, form, prefix_chars, middle_chars and output.

    Places and form hang on seed and id only, so a lost task gives the same rows again and rows with one id are cut by
    one rule. A null text is empty; an empty text, and one that contains a mark, stays plain. Rows without an id are cut
    by the key of an empty id. Every row is kept, whatever other columns are called; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    keep = [id_col] if keep is None else keep
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = carried(docs.select("*", key.alias("__key")), text_col, [*keep, "__key"])

    # The text comes back from the workers only if it is asked for.
    back = {"kept": rows.schema["kept"].dataType.simpleString()} | ({"__text": "string"} if text_col in keep else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units()
        for batch in batches:
            keys = batch.column("kept").field("__key").to_pylist()
            got = [transformed(t.as_py() or "", k, units) for t, k in zip(batch.column("__text"), keys)]
            n, form, prefix, middle, output = zip(*got) if got else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in back), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                names=[*back, "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    types = ", ".join(f"{c} {kind}" for c, kind in back.items())
    out = rows.mapInArrow(run, f"{types}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return restored(out, text_col, keep, "n", "form", "prefix_chars", "middle_chars", "output")


def _between(output: Column, mark: str, until: str) -> Column:
    """What stands between two marks."""
    return F.substring_index(F.substring_index(output, until, 1), mark, -1)


def original(output: Column, form: Column) -> Column:
    """The text from which ``fill_in_middle`` made ``output``: no mark stands in it, so each mark stands in its own place only."""
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(_between(output, PREFIX, SUFFIX), middle, _between(output, SUFFIX, MIDDLE))
    spm = F.concat(_between(output, PREFIX, MIDDLE), middle, _between(output, SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(original(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


def op12_sql() -> str:
    """The same units by a regular expression, cut and joined by list functions; the original text stands for its restoration."""
    h = ", ".join(f"('0x' || substr(key, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))
    has_mark = " OR ".join(f"contains(t, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    return f"""
WITH k AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
u AS (SELECT doc_id, t, {h}, regexp_extract_all(t, '{UNIT}') AS units FROM k),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS i, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS j,
  CASE WHEN t = '' OR h3 % 100 >= {TRANSFORMED} OR {has_mark} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(units[1:i], ''), '') AS a, coalesce(array_to_string(units[i + 1:j], ''), '') AS b, coalesce(array_to_string(units[j + 1:n], ''), '') AS c FROM c)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(a)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || a || '{SUFFIX}' || c || '{MIDDLE}' || b WHEN 'spm' THEN '{SUFFIX}' || c || '{PREFIX}' || a || '{MIDDLE}' || b ELSE t END) AS output_sha256,
  sha256(CASE WHEN form = 'plain' THEN t ELSE a || b || c END) AS restored_sha256
FROM p"""
