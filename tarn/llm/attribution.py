"""Token counts by section: a document is encoded once, and its tokens are attributed to the sections they overlap.

Sections partition a text, so a token that straddles a boundary would be counted twice or not at all if
sections were encoded one by one. Here the whole text is encoded; token ends come from the lengths of the
tokens' pieces, and an interval join of token spans and section spans (both sorted, so two binary searches)
finds what each token overlaps. The rule for a token that crosses a boundary: it belongs to the section that
holds most of its bytes; of equal shares the earlier section takes it. Every token is counted once, so a
document's counts add up to its token count.

Character offsets: a section's start and end are code points; tokens are compared in bytes, where they are
exact (a token may be part of a character).

Sections are lines by default: the first that isn't empty is the "heading", others are "body". Any function
from a text to sorted spans can be given; what no span holds (here, line feeds) forms sections of kind "outside".

Defined results: a null or empty text has no sections and gives no row (section_totals gives it zeros).
Rows are independent; ties, repeated rows, empty
tables and extra columns need nothing. Bytes that aren't UTF-8 count as U+FFFD. Texts of any length take linear time
but for pieces without a break, which take n log n.
"""

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.bpe import Words
from tarn.session import ship

Section = tuple[str, int, int]
_PARAGRAPH = re.compile(r"[^\n]+")
#: A run of white space on which the library's look-ahead may run out of stack; such a text is encoded by op1's merges.
_BLANK = re.compile(r"\s{100000}")


def paragraphs(text: str) -> list[Section]:
    """Lines as sections: the first is the heading; a line feed belongs to no line and falls to "outside"."""
    return [("body" if k else "heading", m.start(), m.end()) for k, m in enumerate(_PARAGRAPH.finditer(text))]


def partition(sections: list[Section], end: int) -> list[Section]:
    """Sections with the gaps between them filled in. They must be sorted and not overlap."""
    out, done = [], 0
    for kind, a, b in sections:
        if a < done or b < a:
            raise ValueError("sections must be sorted and apart")
        if a > done:
            out.append(("outside", done, a))
        if b > a:
            out.append((kind, a, b))
        done = b
    return [*out, ("outside", done, end)] if done < end else out


def attribute(token_ends: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Tokens of each section. token_ends and bounds (starts and the last end of sections) are byte offsets."""
    starts = np.concatenate(([0], token_ends[:-1]))
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, token_ends, "left") - 1
    home = first.copy()
    best = np.minimum(token_ends, bounds[first + 1]) - starts
    for step in range(1, int((last - first).max(initial=0)) + 1):
        at = np.flatnonzero(last - first >= step)
        share = np.minimum(token_ends[at], bounds[first[at] + step + 1]) - bounds[first[at] + step]
        more = share > best[at]
        home[at[more]], best[at[more]] = first[at[more]] + step, share[more]
    return np.bincount(home, minlength=len(bounds) - 1)


def section_tokens(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text", split: Callable[[str], list[Section]] = paragraphs) -> DataFrame:
    """(key, section, kind, start, end, n_tokens) for each section of each text. No shuffle."""
    ship(docs.sparkSession)
    kind_of_key = docs.schema[key].dataType.simpleString()
    names = [key, "section", "kind", "start", "end", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import tiktoken

        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        pieces, words = regex.compile(pattern), Words(ranks)
        lengths = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        for piece, rank in ranks.items():
            lengths[rank] = len(piece)
        for batch in batches:
            rows, number, kinds, a, b, n = [], [], [], [], [], []
            for i, t in enumerate(batch.column(1).cast(pa.binary())):
                s = t.as_buffer().to_pybytes().decode("utf-8", "replace") if t.is_valid else ""
                if not s:
                    continue
                parts = partition(split(s), len(s))
                widths = [x - y for _, y, x in parts] if s.isascii() else [len(s[y:x].encode()) for _, y, x in parts]
                ids = list(chain.from_iterable(map(words.__getitem__, pieces.findall(s)))) if _BLANK.search(s) else encode(s)
                counts = attribute(np.cumsum(lengths[ids]), np.concatenate(([0], np.cumsum(widths))))
                rows += [i] * len(parts)
                number += range(len(parts))
                for out, k in ((kinds, 0), (a, 1), (b, 2)):
                    out += [p[k] for p in parts]
                n += counts.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int64()), pa.array(kinds, pa.string()), *(pa.array(x, pa.int64()) for x in (a, b, n))], names)

    schema = f"`{key}` {kind_of_key}, section long, kind string, start long, end long, n_tokens long"
    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def section_totals(sections: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, and tokens by kind): sums over a document's sections; documents without any have zeros."""
    kinds = ("heading", "body", "outside")
    sums = sections.groupBy(key).agg(F.sum("n_tokens").alias("n_tokens"), *(F.sum(F.when(F.col("kind") == k, F.col("n_tokens")).otherwise(0)).alias(f"n_{k}") for k in kinds))
    return docs.select(key).distinct().join(sums, key, "left").fillna(0, ["n_tokens", *(f"n_{k}" for k in kinds)])
