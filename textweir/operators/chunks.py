"""Token-bounded overlapping chunks of a document's elements, and their exact reassembly.

A document that fits the ceiling is one chunk. Else a chunk begins with its
overlap and takes elements while they fit; without an overlap it takes one
element, whatever its size. Where the overlap leaves no room for the next
element, the first overlap elements that fit beside it stay. A chunk that
reaches the document's end is left as it is; any other is cut back to the
earliest boundary of the highest worth between its new elements: two texts in a
row (3), a title at either side (2), a sentence end within the element before
(1), else none; a cut behind a structured table is none. The next overlap is the
shortest run of the chunk's last new elements that reaches the overlap's tokens.
Each element is new in exactly one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import token_estimate

SENTENCE_END = r"(?U)[.!?](?:\s|$)"
TEXT, TITLE, OTHER = 0, 1, 2


def _worth(kind: list[int], ends: list[bool], solid: list[bool], i: int) -> int:
    """Worth of a cut between the elements i - 1 and i."""
    if solid[i - 1]:
        return 0
    if kind[i - 1] == kind[i] == TEXT:
        return 3
    if TITLE in (kind[i - 1], kind[i]):
        return 2
    return int(ends[i - 1])


def plan_chunks(size: list[int], kind: list[int], ends: list[bool], solid: list[bool], ceiling: int, overlap: int) -> list[tuple[list[int], list[int]]]:
    """[(overlap elements, new elements)] by place, of elements given by tokens, kind, whether a sentence ends in them, and whether they are structured tables."""
    if overlap >= ceiling:
        raise ValueError("the overlap has to be smaller than the ceiling")
    n = len(size)
    if sum(size) <= ceiling:
        return [([], list(range(n)))] if n else []
    out: list[tuple[list[int], list[int]]] = []
    at, head = 0, []
    while at < n:
        end = at
        if head:
            room = ceiling - sum(size[i] for i in head)
            while end < n and size[end] <= room:
                room -= size[end]
                end += 1
        if end == at:
            room, kept = ceiling - size[at], []
            for i in head:
                if size[i] > room:
                    break
                room -= size[i]
                kept.append(i)
            head, end = kept, at + 1
        if end < n:
            cuts = [(-w, i) for i in range(at + 1, end) if (w := _worth(kind, ends, solid, i))]
            end = min(cuts)[1] if cuts else end
        out.append((head, list(range(at, end))))
        first, reach = end, 0
        while overlap > 0 and first > at and reach < overlap:
            first -= 1
            reach += size[first]
        at, head = end, list(range(first, end))
    return out


def chunk(elements: DataFrame, ceiling: int, overlap: int) -> DataFrame:
    """doc_id, chunk_index, pos, seq, tokens, is_overlap for elements (doc_id, seq, element_type, content).

    Only five narrow columns of an element reach the fold; a document's are held
    as plain numbers while it is planned.
    """
    if overlap >= ceiling:
        raise ValueError("the overlap has to be smaller than the ceiling")
    structured = F.col("structured") if "structured" in elements.columns else F.lit(False)
    content = F.coalesce("content", F.lit(""))
    kind = F.when(F.col("element_type") == "text", TEXT).when(F.col("element_type") == "title", TITLE).otherwise(OTHER)
    sized = elements.select("doc_id", F.col("seq").cast("long").alias("seq"), token_estimate(content).alias("tokens"), kind.alias("kind"), content.rlike(SENTENCE_END).alias("ends"), F.coalesce(structured, F.lit(False)).alias("solid"))

    def plan(doc: int, rows: list[tuple]) -> pd.DataFrame:
        seq, size, *rest = map(list, zip(*rows))
        made = [(doc, k, p, seq[i], size[i], p < len(head)) for k, (head, new) in enumerate(plan_chunks(size, *rest, ceiling, overlap)) for p, i in enumerate([*head, *new])]
        return pd.DataFrame(made, columns=["doc_id", "chunk_index", "pos", "seq", "tokens", "is_overlap"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for pdf in batches:
            done = []
            for doc, *row in pdf.itertuples(index=False):
                if held and doc != now:
                    done.append(plan(now, held))
                    held = []
                now = doc
                held.append(row)
            if done:
                yield pd.concat(done)
        if held:
            yield plan(now, held)

    dealt = sized.repartition("doc_id").sortWithinPartitions("doc_id", "seq")
    return dealt.mapInPandas(run, "doc_id long, chunk_index long, pos long, seq long, tokens long, is_overlap boolean")


def reassemble(chunks: DataFrame, elements: DataFrame) -> DataFrame:
    """doc_id, seq, position: new elements in chunk order, the first of each, then those that no chunk holds."""
    new = chunks.where("not is_overlap").select("doc_id", "seq", "chunk_index", "pos")
    first = new.groupBy("doc_id", "seq").agg(F.min(F.struct("chunk_index", "pos")).alias("at"))
    lost = elements.select("doc_id", "seq").join(first, ["doc_id", "seq"], "left_anti").select("doc_id", "seq", F.lit(None).cast("struct<chunk_index:bigint,pos:bigint>").alias("at"))
    order = W.partitionBy("doc_id").orderBy(F.col("at").isNull(), "at", "seq")
    return first.unionByName(lost).select("doc_id", "seq", (F.row_number().over(order) - 1).cast("long").alias("position"))
