"""Operator 6: benchmark decontamination with suffix arrays over shards of the documents.

A shard is a run of whole documents in one task. Its words become numbers of
the benchmark's vocabulary, 0 for any other word; a match never spans a 0, so
suffixes are kept where a run of known words is long enough for some window,
and every other suffix is proven useless. The kept suffixes are sorted by their
first ``window`` words; each benchmark suffix finds its range of equal suffixes
by binary search. A document word inside any occurrence is hit. Suffixes that
occur are then sorted to their full depth, together with the benchmark's, by
doubling ranks; the longest verbatim match that begins at a document word is
that with its nearest benchmark suffix above or below. Matches that aren't part
of a longer one are kept with place, length and item.

The benchmark is broadcast in blocks of about ``BLOCK_WORDS`` words, one scan of
the documents for each; one block is the common case. With several, documents
are stored once with a number for each row, and hits come back by that number.

Defined cases: a null text has no words; an item without words is no window and
one with fewer words than a window is a window as a whole; items that share a
window count each; items with equal ids count once; a null item id is left out;
rows with equal doc ids are judged each; empty tables give no rows or no hits;
a long text is split into words piece by piece, and takes about 60 bytes a word;
further columns of either table, whatever their names, are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gather, map_text, masked, segments, stage, table, word_runs

WINDOW = 10
#: Words of the benchmark in a broadcast: about 100 bytes each while it is built, 60 as it is sent.
BLOCK_WORDS = 1_000_000
#: Bytes of documents in a shard.
SHARD_CHARS = 2_000_000
#: A word is a run of anything but U+0000 to U+007F other than letters and digits; A-Z count as a-z.
_split = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_split).split()


def _sortable(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort alike."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()


class Block:
    """Windows of some items. ``code`` numbers the words from 1; ``grams`` holds distinct windows by length, ``items`` whose they are."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.code: dict[bytes, int] = {}
        self.window = window
        ids = [np.fromiter((self.code.setdefault(w, len(self.code) + 1) for w in ws), np.int32, len(ws)) for _, ws in items]
        self.grams: dict[int, np.ndarray] = {}
        self.items: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        #: For each word of the items that begins a whole window: that window's number, its item, and how many follow it in a row.
        self.seq, self.owner, self.left = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64))
        for size in sorted({min(window, len(x)) for x in ids if len(x)}):
            mine = [k for k, x in enumerate(ids) if min(window, len(x)) == size]
            rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(ids[k], size) for k in mine])
            counts = np.array([len(ids[k]) - size + 1 for k in mine])
            _, first, gram = np.unique(_sortable(rows), return_index=True, return_inverse=True)
            owner = np.repeat(np.array([items[k][0] for k in mine], np.int64), counts)
            self.grams[size] = rows[first]
            pairs = np.unique(np.stack([gram, owner], 1), axis=0)
            self.items[size] = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1)), pairs[:, 1]
            if size == window:
                self.seq, self.owner = gram.astype(np.int64), owner
                self.left = np.repeat(np.cumsum(counts), counts) - np.arange(len(gram))
        self.sizes = sorted(self.grams)

    def owners(self, size: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``grams``, item) for every item that has one of these windows."""
        at, item = self.items[size]
        counts = at[grams + 1] - at[grams]
        return np.repeat(np.arange(len(grams)), counts), item[gather(at[grams], counts)]


class SuffixArray:
    """Suffixes of a shard, to a depth of ``block.window`` words, sorted; only those that can begin a window."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, block: Block):
        """ids: word numbers, 0 for unknown; ends: for each word the end of its document."""
        n = len(ids)
        stop = np.where(ids == 0, np.arange(n), n)
        run_end = np.minimum(np.minimum.accumulate(stop[::-1])[::-1], ends) if n else stop
        room = run_end - np.arange(n)
        self.pos = np.flatnonzero(room >= (block.sizes[0] if block.sizes else n + 1))
        depth = np.minimum(room[self.pos], block.window)
        rows = np.zeros((len(self.pos), block.window), np.int32)
        for k in range(block.window):
            inside = depth > k
            rows[inside, k] = ids[self.pos[inside] + k]
        keys = _sortable(rows)
        order = np.argsort(keys, kind="stable")
        self.pos, self.keys = self.pos[order], keys[order]

    def find(self, grams: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes that begin with each row of ``grams``."""
        n = grams.shape[1]
        low = np.zeros((len(grams), window), np.int64)
        low[:, :n] = grams
        high = np.full((len(grams), window), 0xFFFFFFFF, np.int64)
        high[:, :n] = grams
        return np.searchsorted(self.keys, _sortable(low), "left"), np.searchsorted(self.keys, _sortable(high), "right")


def longest_matches(at: np.ndarray, gram: np.ndarray, left: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """For each document place ``at`` (ascending) that begins window ``gram``: how many windows in a row it shares with the benchmark at most, and with which of its places.

    ``left`` is how many places in a row, from each, begin a window. Both texts
    are sequences of window numbers here; their suffixes are sorted whole by
    doubling, and the best partner of a suffix is a neighbour in that order.
    """
    theirs = np.flatnonzero(np.isin(block.seq, gram))
    g = np.concatenate([gram, block.seq[theirs]])
    # Places in one line, documents first, so that a suffix's h-th successor is found by its place.
    place = np.concatenate([at, (at[-1] + 2 if len(at) else 0) + theirs])
    broken = np.flatnonzero(np.diff(theirs) != 1)
    stop = np.concatenate([broken + 1, [len(theirs)]]) if len(theirs) else np.zeros(0, np.int64)
    run = stop[np.searchsorted(stop, np.arange(len(theirs)), "right")] - np.arange(len(theirs)) if len(theirs) else np.zeros(0, np.int64)
    rest = np.concatenate([left, np.minimum(run, block.left[theirs])])
    rank, h, most = np.unique(g, return_inverse=True)[1].astype(np.int64), 1, int(rest.max(initial=0))
    line = np.arange(len(g))
    while h < most:
        ahead = np.where(rest > h, rank[np.minimum(line + h, len(g) - 1)] + 1, 0)
        fresh = np.unique(rank * (len(g) + 1) + ahead, return_inverse=True)[1].astype(np.int64)
        if fresh.max(initial=0) == rank.max(initial=0):
            break
        rank, h = fresh, h * 2
    order = np.lexsort((line, rank))
    mine = order < len(at)
    spots = np.arange(len(order))
    above = np.maximum.accumulate(np.where(mine, -1, spots))
    below = np.minimum.accumulate(np.where(mine, len(order), spots)[::-1])[::-1]
    best, partner = np.zeros(len(at), np.int64), np.full(len(at), -1, np.int64)
    for near in (above, below):
        sel = np.flatnonzero(mine & (near >= 0) & (near < len(order)))
        d, q = order[sel], order[near[sel]]
        size, open_ = np.zeros(len(d), np.int64), np.arange(len(d))
        while len(open_):
            k = size[open_]
            go = (k < rest[d[open_]]) & (k < rest[q[open_]])
            open_ = open_[go]
            k = size[open_]
            open_ = open_[g[d[open_] + k] == g[q[open_] + k]]
            size[open_] += 1
        more = size > best[d]
        best[d[more]], partner[d[more]] = size[more], theirs[q[more] - len(at)]
    return best, partner


def _numbers(texts: list[str], block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts one after another, and the number of words of each."""
    get, parts, sizes = block.code.get, [], np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        for ws in word_runs(t.encode("utf-8", "surrogatepass").translate(_split)):
            parts.append(np.fromiter(map(get, ws, repeat(0)), np.int32, len(ws)))
            sizes[k] += len(ws)
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), sizes


def shard_hits(texts: list[str], block: Block) -> tuple[np.ndarray, list[tuple[list[list[int]], list[int], list[list[int]]]]]:
    """Number of words of each text; for each text its hit spans [start, end), merged, the items with occurrences, and its longest matches [start, words, item]."""
    ids, sizes = _numbers(texts, block)
    bounds = segments(sizes)
    array = SuffixArray(ids, np.repeat(bounds[1:], sizes), block)
    out: list[tuple[list[list[int]], list[int], list[list[int]]]] = [([], [], []) for _ in texts]
    mark = np.zeros(len(ids) + 1, np.int64)
    pairs, matches = [], []
    for n in block.sizes:
        left, right = array.find(block.grams[n], block.window)
        found = np.flatnonzero(right > left)
        counts = (right - left)[found]
        at, gram = array.pos[gather(left[found], counts)], np.repeat(found, counts)
        if not len(at):
            continue
        by = np.argsort(at)
        at, gram = at[by], gram[by]
        mark += np.bincount(at, minlength=len(mark)) - np.bincount(at + n, minlength=len(mark))
        doc = np.searchsorted(bounds, at, "right") - 1
        doc_gram = np.unique(np.stack([doc, gram], 1), axis=0)
        place, item = block.owners(n, doc_gram[:, 1])
        pairs.append(np.unique(np.stack([doc_gram[place, 0], item], 1), axis=0))
        if n == block.window:
            new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(doc) != 0)]))
            end = np.concatenate([new[1:], [len(at)]])
            row = np.repeat(end, end - new) - np.arange(len(at))
            best, partner = longest_matches(at, gram, row, block)
            goes_on = np.concatenate([[False], (best[1:] == best[:-1] - 1) & (np.diff(at) == 1)])
            own = np.flatnonzero(~goes_on)
            matches.append(np.stack([doc[own], at[own] - bounds[doc[own]], best[own] + n - 1, block.owner[partner[own]]], 1))
        else:
            first = block.items[n][1][block.items[n][0][gram]]
            matches.append(np.stack([doc, at - bounds[doc], np.full(len(at), n), first], 1))
    if not pairs:
        return sizes, out
    # Windows that overlap or touch form one span; documents are apart.
    hit = np.cumsum(mark[:-1]) > 0
    opens = hit & ~np.concatenate([[False], hit[:-1]])
    opens[bounds[:-1][sizes > 0]] = hit[bounds[:-1][sizes > 0]]
    closes = hit & ~np.concatenate([hit[1:], [False]])
    closes[bounds[1:][sizes > 0] - 1] = hit[bounds[1:][sizes > 0] - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    doc = np.searchsorted(bounds, starts, "right") - 1
    for d, a, b in zip(doc.tolist(), (starts - bounds[doc]).tolist(), (ends - bounds[doc]).tolist()):
        out[d][0].append([a, b])
    for d, i in np.unique(np.concatenate(pairs), axis=0).tolist():
        out[d][1].append(i)
    for d, a, n, i in sorted(np.concatenate(matches).tolist()):
        out[d][2].append([a, n, i])
    return sizes, out


def blocks_of(benchmark: DataFrame, window: int) -> list:
    """The benchmark's items in broadcast blocks of bounded size; one item is the least a block holds."""
    spark = benchmark.sparkSession
    out, held, size = [], [], 0

    def close() -> None:
        out.append(spark.sparkContext.broadcast(Block(held, window)))

    for r in benchmark.where("item_id is not null and text is not null").select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        ws = words(r.text)
        if ws:
            held.append((r.item_id, ws))
            size += len(ws)
        if size >= BLOCK_WORDS:
            close()
            held, size = [], 0
    if held or not out:
        close()
    return out


def _scan(docs: DataFrame, sent, keep: list[str]) -> DataFrame:
    def compute(texts: list[str]) -> list:
        sizes, hits = shard_hits(texts, sent.value)
        return [sizes, [h[0] for h in hits], [h[1] for h in hits], [h[2] for h in hits]]

    return map_text(docs, keep, "_n_words long, _spans array<array<bigint>>, _items array<bigint>, _matches array<array<bigint>>", compute, SHARD_CHARS)


def _union(spans):
    """Merge sorted spans that overlap or touch."""
    return F.expr("""aggregate(array_sort(_spans), cast(array() as array<array<bigint>>), (a, s) ->
        if(size(a) > 0 and element_at(a, -1)[1] >= s[0],
           concat(slice(a, 1, size(a) - 1), array(array(element_at(a, -1)[0], greatest(element_at(a, -1)[1], s[1])))),
           concat(a, array(s))))""")


def find_matches(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW) -> DataFrame:
    """The columns ``keep`` with _n_words, _spans (hit spans of words), _items (items with occurring windows) and _matches (start, words, item)."""
    sent = blocks_of(benchmark, window)
    if len(sent) == 1:
        return _scan(docs, sent[0], keep)
    numbered = stage(docs.select(*keep, *[c for c in ("text",) if c not in keep]).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    parts = [_scan(numbered, b, ["_row"]) for b in sent]
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    flat = lambda c: F.flatten(F.collect_list(c))
    # Only documents with hits, by number; all have their count of words from the first block.
    found = hits.where(F.size("_items") > 0).groupBy("_row").agg(flat("_spans").alias("_spans"), F.array_sort(F.array_distinct(flat("_items"))).alias("_items"), F.array_sort(flat("_matches")).alias("_matches"))
    whole = numbered.join(parts[0].select("_row", "_n_words"), "_row").join(found, "_row", "left")
    pairs = F.array().cast("array<array<bigint>>")
    whole = whole.withColumns({"_spans": F.coalesce("_spans", pairs), "_items": F.coalesce("_items", F.array().cast("array<bigint>")), "_matches": F.coalesce("_matches", pairs)})
    return whole.withColumn("_spans", _union("_spans")).select(*keep, "_n_words", "_spans", "_items", "_matches")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without an occurrence of any window, with their own columns."""
    apart, names, back = masked(docs, "text")
    return back(find_matches(apart, benchmark, names, window).where(F.size("_items") == 0))


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    found = find_matches(docs, benchmark, ["doc_id"], window)
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    names = F.array_join(F.array_sort(F.transform("_items", lambda i: i.cast("string"))), ",")
    longest = F.coalesce(F.array_max(F.transform("_matches", lambda s: s[1])), F.lit(0).cast("long"))
    return found.select("doc_id", F.col("_n_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"), longest.alias("longest_match"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, row_number() OVER () AS iid, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT item_id, iid, least(len(ws), {WINDOW}) AS n, j, array_to_string(ws[j : j + least(len(ws), {WINDOW}) - 1], ' ') AS w FROM b, LATERAL unnest(range(1, len(ws) - least(len(ws), {WINDOW}) + 2)) AS u(j) WHERE len(ws) > 0),
dw AS (SELECT rid, i, n, array_to_string(ws[i : i + n - 1], ' ') AS w FROM (SELECT d.rid, d.ws, z.n FROM d, (SELECT DISTINCT n FROM bw) z WHERE len(d.ws) >= z.n) q, LATERAL unnest(range(1, CAST(len(ws) - n + 2 AS BIGINT))) AS u(i)),
h AS (SELECT rid, i, j, n, item_id, iid FROM dw JOIN bw USING (w, n)),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, i, n FROM h) x, LATERAL unnest(range(i, i + n)) AS u(p) GROUP BY rid),
k AS (SELECT rid, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS names FROM h GROUP BY rid),
r AS (SELECT rid, max(len) AS longest FROM (SELECT rid, count(*) + n - 1 AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, iid, n, i - j ORDER BY i) AS g FROM h) y GROUP BY rid, iid, n, i - j, g) z GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN c USING (rid) LEFT JOIN k USING (rid) LEFT JOIN r USING (rid)
"""
