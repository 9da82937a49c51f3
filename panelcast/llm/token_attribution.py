"""Offset-mapped attribution of tokens to the sections of a document.

A document is encoded once as a whole. In a byte-level vocabulary every token covers a known number of bytes, so the running
sum of the byte lengths gives each token's span. Sections are spans too; tokens and sections, both in order, are joined by
interval (a merge by binary search inside the task). The rule for a token over a boundary: it counts for the section that
holds most of its bytes, and for the earlier one in a tie. Bytes outside all sections belong to the section -1.

Memory follows the longest document. No shuffle is needed; a document is one row.

Defined results: a NULL or empty text has no tokens; its one section of no length gets 0. Repeated rows are repeated. A
section that overlaps an earlier one starts where that one ends. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.bpe import byte_lengths, encoder, public_files
from panelcast.llm.common import table


def attribute(ends: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Section number of each token (-1: none), for token byte ends and section byte spans in order, without overlap."""
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64)[: len(ends)]
    if not len(starts):
        return np.full(len(ends), -1)
    # Edges of all pieces of the line of bytes: gap, section, gap, section, ..., gap.
    edges = np.stack([starts, stops], 1).ravel()
    first = np.searchsorted(edges, begins, side="right")
    last = np.searchsorted(edges, ends - 1, side="right")
    piece = first.copy()
    for t in np.flatnonzero(first != last):  # the few tokens over a boundary
        cuts = np.concatenate(([begins[t]], edges[first[t]:last[t]], [ends[t]]))
        piece[t] = first[t] + int(np.argmax(np.diff(cuts)))  # the first of the longest parts
    return np.where(piece % 2 == 1, piece // 2, -1)


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the lines of a text; a line holds its own line end."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    cut = np.flatnonzero(raw == 10) + 1
    starts = np.concatenate(([0], cut))
    stops = np.concatenate((cut, [len(raw)]))
    if len(starts) > 1 and starts[-1] == stops[-1]:  # nothing after the last line end
        starts, stops = starts[:-1], stops[:-1]
    return starts.astype(np.int64), stops.astype(np.int64)


def section_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, files: dict | None = None,
) -> DataFrame:
    """Rows (id, section, start, stop, n_tokens, n_crossing, doc_tokens), one for each section of each document.

    ``sections_col`` is a column of (start, stop) structs in code points, in order; without it sections are the lines.
    ``start`` and ``stop`` are code points. ``n_crossing`` counts the section's tokens that also cover bytes outside it.
    Tokens outside all sections have a row with section -1, if there are any.
    """
    id_type = dict(docs.dtypes)[id_col]

    def fill(frames):
        where = files or public_files()
        enc, lengths = encoder(**where), byte_lengths(where["path"])
        for f in frames:
            out, ids, totals = [], [], []
            for row in f.itertuples(index=False):
                text = row[1] or ""
                raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
                points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # code points before each byte
                if len(row) == 3:
                    spans = [] if row[2] is None else [(s["start"], s["stop"]) for s in row[2]]
                    starts, stops = (np.array(x, np.int64) for x in (zip(*spans) if spans else ((), ())))
                    place = np.concatenate((np.flatnonzero((raw & 0xC0) != 0x80), [len(raw)]))
                    starts, stops = place[np.minimum(starts, len(place) - 1)], place[np.minimum(stops, len(place) - 1)]
                    reach = np.maximum.accumulate(stops) if len(stops) else stops
                    starts = np.maximum(starts, np.concatenate(([0], reach[:-1]))[: len(starts)])
                    stops = np.maximum(starts, stops)
                else:
                    starts, stops = line_sections(text)
                ends = np.cumsum(lengths[enc.encode(text)])
                begins = np.concatenate(([0], ends[:-1]))[: len(ends)]
                section = attribute(ends, starts, stops)
                inside = section >= 0
                crossing = np.zeros(len(ends), bool)
                crossing[inside] = (begins[inside] < starts[section[inside]]) | (ends[inside] > stops[section[inside]])
                n = np.bincount(section + 1, minlength=len(starts) + 1)
                c = np.bincount(section[crossing] + 1, minlength=len(starts) + 1)
                keep = slice(0 if n[0] else 1, None)  # a row for tokens outside all sections only where there are any
                out.append((
                    np.arange(-1, len(starts))[keep], np.concatenate(([0], points[starts]))[keep],
                    np.concatenate(([points[-1]], points[stops]))[keep], n[keep], c[keep]))
                ids += [row[0]] * len(out[-1][0])
                totals += [len(ends)] * len(out[-1][0])
            if out:
                parts = [np.concatenate(x) for x in zip(*out)]
                yield pd.DataFrame({
                    "_id": ids, "section": parts[0],
                    "start": parts[1], "stop": parts[2], "n_tokens": parts[3], "n_crossing": parts[4], "doc_tokens": totals})

    columns = [F.col(id_col).cast("string").alias("_id"),  # text, as pandas has no NULL for integers
                F.col(text_col).alias("_text")]
    if sections_col:
        columns.append(F.col(sections_col).alias("_sections"))
    return docs.select(*columns).mapInPandas(
        fill, "_id string, section long, start long, stop long, n_tokens long, n_crossing long, doc_tokens long",
    ).withColumn("_id", F.col("_id").cast(id_type)).withColumnRenamed("_id", id_col)


def op8_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return section_tokens(table(spark, sf_dir, "documents"))
