"""Operator 10: token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole; its tokens' character spans are joined with the
sections' spans (both sorted, so the interval join is a search in the sorted bounds) and
each token is counted for exactly one section.  The rule for a token over a boundary:

    majority  the section with most of its characters, the earlier one of equals (default)
    start     the section of its first character

A token with no character in any section is counted under section -1.  So the counts of a
document always add up to its tokens, which counting its sections one by one does not give.

Cases: a null text is an empty one; a document without tokens has a row for each section, or one of section 0
if it has none, with no tokens; one without sections but with tokens counts them all under section -1;
repeated rows are counted each for itself; a very long text is encoded in one task; an empty table has an empty
result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import row_ranges, trim


def lines(text: str) -> list[tuple[int, int]]:
    """Spans of a text's lines, each with its line feed."""
    out, at = [], 0
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end + 1
        out.append((at, end))
        at = end
    return out


def allot(spans: np.ndarray, sections: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """(section of each token or -1, whether the token crosses a bound).

    spans and sections are (n, 2) character ranges; the sections are sorted and don't overlap.
    """
    owner = np.full(len(spans), -1, np.int64)
    if not len(sections) or not len(spans):
        return owner, np.zeros(len(spans), bool)
    begins, ends = sections[:, 0], sections[:, 1]
    s, e = spans[:, 0], np.maximum(spans[:, 1], spans[:, 0] + 1)
    first = np.searchsorted(ends, s, side="right")  # the first section that ends behind the token's start
    last = np.searchsorted(begins, e, side="left") - 1  # the last one that begins before its end
    inside = (first <= last) & (first < len(sections))
    at = np.minimum(first, len(sections) - 1)
    whole = inside & (begins[at] <= s) & (e <= ends[at])
    owner[whole] = first[whole]
    crossing = inside & ~whole
    for k in np.flatnonzero(crossing).tolist():
        among = np.arange(first[k], last[k] + 1)
        if rule == "start":
            owner[k] = first[k] if begins[first[k]] <= s[k] else -1
        else:
            shared = np.minimum(ends[among], e[k]) - np.maximum(begins[among], s[k])
            owner[k] = among[int(np.argmax(shared))] if len(shared) and shared.max() > 0 else -1
    return owner, crossing


def section_tokens(docs: DataFrame, path: str, sections: Callable[[str], list[tuple[int, int]]] | str = lines, rule: str = "majority", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, section int, start long, end long, n_tokens long, n_crossing long).

    sections: a function of a text, or the name of a column array<struct<start, end>> of character
    spans, sorted and not overlapping.
    """
    if rule not in ("majority", "start"):
        raise ValueError(rule)
    kind = docs.schema[id_col].dataType.simpleString()
    named = isinstance(sections, str)
    own = [F.col(sections).alias("nf_sections")] if named else []

    def run(batches):
        e = encoder(path, offsets=True)
        for batch in batches:
            sizes = pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for lo, hi in row_ranges(sizes, 1 << 21):
                texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                if named:
                    given = [[tuple(x.values()) for x in r or []] for r in batch.column(2).slice(lo, hi - lo).to_pylist()]
                else:
                    given = [sections(t) for t in texts]
                _, ends, spans = e.encode(texts)
                doc, sec, bounds, tokens, cross = [], [], [], [], []
                at = 0
                for k, end in enumerate(ends.tolist()):
                    # without sections there is one without characters, for a text without tokens
                    own_ = np.array(given[k] or [(0, 0)], np.int64).reshape(-1, 2)
                    owner, crossing = allot(spans[at:end], own_, rule)
                    at = end
                    n = np.bincount(owner + 1, minlength=len(own_) + 1)
                    c = np.bincount(owner[crossing] + 1, minlength=len(own_) + 1)
                    skip = int(n[0] == 0)  # section -1 only if it has tokens
                    stop = 1 if n[0] and not given[k] else len(n)
                    sec.append(np.arange(-1 + skip, stop - 1))
                    bounds.append(np.concatenate([[[0, 0]], own_])[skip:stop])
                    tokens.append(n[skip:stop])
                    cross.append(c[skip:stop])
                    doc.append(np.full(stop - skip, k))
                doc_, b = np.concatenate(doc), np.concatenate(bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(doc_)), pa.array(np.concatenate(sec).astype(np.int32)), pa.array(b[:, 0]), pa.array(b[:, 1]), pa.array(np.concatenate(tokens).astype(np.int64)), pa.array(np.concatenate(cross).astype(np.int64))],
                    names=[id_col, "section", "start", "end", "n_tokens", "n_crossing"],
                )
        trim()

    base = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("nf_text"), *own)
    return base.mapInArrow(run, f"`{id_col}` {kind}, section int, start long, end long, n_tokens long, n_crossing long")
