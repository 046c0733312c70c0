"""Model calls as pluggable seams, with deterministic stand-ins, and the policy around a call: retries, ceiling, cancelling."""

from __future__ import annotations

import hashlib
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values.
ATTEMPTS, BACKOFF, TEMPORARY_WAITS, CEILING = 3, 1.6, (5.0, 10.0, 20.0), 120.0
SCORE_BATCHES = (8, 4, 1)


class Translator(Protocol):
    def translate_batch(self, texts: list[str], target: str) -> list[str | None]:
        """One translation per text, None where the call failed."""


class Model(Translator, Protocol):
    """Everything a model client offers."""

    def translate_once(self, text: str, target: str, context: str = "") -> str | None: ...

    def complete(self, payload: str, context: str = "") -> str | None: ...

    def health(self) -> bool: ...

    def list_models(self) -> list[str]: ...

    def unload(self) -> None: ...


class Tagging:
    """Stand-in: marks a text with its target; fails for texts that hold ``fails_on``."""

    def __init__(self, fails_on: str | None = None):
        self.fails_on = fails_on

    def translate_once(self, text: str, target: str, context: str = "") -> str | None:
        return None if self.fails_on and self.fails_on in text else f"[{target}] {text}"

    def translate_batch(self, texts: list[str], target: str) -> list[str | None]:
        return [self.translate_once(t, target) for t in texts]

    def complete(self, payload: str, context: str = "") -> str | None:
        return payload

    def health(self) -> bool:
        return True

    def list_models(self) -> list[str]:
        return ["tagging"]

    def unload(self) -> None:
        pass


class HashEmbedder:
    """Stand-in: a unit-free vector from a text's digest."""

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [[b / 255 - 0.5 for b in hashlib.sha256(t.encode()).digest()] for t in texts]


class LengthScorer:
    """Stand-in: how near the lengths of source and translation are."""

    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]:
        return [min(len(a), len(b)) / max(len(a), len(b), 1) for a, b in pairs]


class TooLong(Exception):
    """The text is longer than the model takes."""


class Temporary(Exception):
    """Worth trying again later: overload, or a lost connection."""


def with_retries(call: Callable[[str], str | None], text: str, pieces: Callable[[str], list[str]], joiner: str = "\n", wait: Callable[[float], None] = time.sleep) -> str | None:
    """``call`` tried up to three times with growing pauses; a text that is too long is cut and joined again, a temporary failure gets longer pauses."""
    last: Exception | None = None
    for n in range(1, ATTEMPTS + 1):
        try:
            if (out := call(text)) is not None:
                return out
            last = None
        except TooLong as e:
            last = e
            break
        except Exception as e:  # any failure of a remote call is tried again
            last = e
        if n < ATTEMPTS:
            wait(BACKOFF * n)
    if isinstance(last, TooLong):
        parts = pieces(text)
        if len(parts) < 2:
            return None
        said = [with_retries(call, p, pieces, joiner, wait) for p in parts]
        return None if None in said else joiner.join(said)
    if isinstance(last, Temporary):
        for pause in TEMPORARY_WAITS:
            wait(pause)
            try:
                if (out := call(text)) is not None:
                    return out
            except Exception:  # the next, longer pause
                continue
    return None


def bounded(call: Callable[[], str | None], seconds: float = CEILING, cancelled: threading.Event | None = None, tick: float = 0.05) -> tuple[str | None, str]:
    """(reply, ``ok``), or nothing with ``timeout`` or ``cancelled``: a call is never waited for beyond its ceiling or a set event."""
    if cancelled is not None and cancelled.is_set():
        return None, "cancelled"
    pool = ThreadPoolExecutor(1)
    try:
        job, end = pool.submit(call), time.monotonic() + seconds
        while True:
            try:
                return job.result(timeout=min(tick, max(0.0, end - time.monotonic()))), "ok"
            except Late:
                if cancelled is not None and cancelled.is_set():
                    return None, "cancelled"
                if time.monotonic() >= end:
                    return None, "timeout"
    finally:
        pool.shutdown(wait=False)


def score_ladder(scorer: Callable[[list[tuple[str, str]], int], list[float]], pairs: list[tuple[str, str]]) -> list[float]:
    """Scores in batches of 8, of 4, of 1, going down where memory runs out; none at all after any other failure."""
    for size in SCORE_BATCHES:
        try:
            return [s for k in range(0, len(pairs), size) for s in scorer(pairs[k : k + size], size)]
        except MemoryError:
            continue
        except Exception:  # no score is an answer
            return []
    return []


def translate(texts: DataFrame, translator: Translator, batch: int = 25) -> DataFrame:
    """text, target, value of distinct (text, target) rows; null where a call failed. Only here is the model called."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for target, mine in pdf.groupby("target", sort=False):
                said: list[str | None] = []
                rows = mine["text"].tolist()
                for k in range(0, len(rows), batch):
                    got = translator.translate_batch(rows[k : k + batch], target)
                    said += got if len(got) == len(rows[k : k + batch]) else [None] * len(rows[k : k + batch])
                yield pd.DataFrame({"text": rows, "target": target, "value": said})

    return texts.select("text", "target").mapInPandas(run, "text string, target string, value string")


def complete(asked: DataFrame, ask: Callable[[str, str], str | None]) -> DataFrame:
    """text, context, reply of rows (text, payload, context): ``ask(payload, context)``, null where it failed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"text": pdf["text"], "context": pdf["context"], "reply": [ask(p, c or "") for p, c in zip(pdf["payload"], pdf["context"])]}, dtype=object)

    return asked.select("text", "payload", "context").mapInPandas(run, "text string, context string, reply string")


def embed(texts: DataFrame, embedder: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """vec_id, embedding of rows (vec_id, text); a batch whose answer has another length than it has gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = embedder(pdf["text"].tolist())
            if len(got) == len(pdf):
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "embedding": got})

    return texts.select("vec_id", "text").mapInPandas(run, "vec_id long, embedding array<double>")


def score(pairs: DataFrame, scorer) -> DataFrame:
    """block_id, score of rows (block_id, source, translation)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = scorer(list(zip(pdf["source"].fillna(""), pdf["translation"].fillna(""))))
            if len(got) == len(pdf):
                yield pd.DataFrame({"block_id": pdf["block_id"], "score": got})

    return pairs.select("block_id", "source", "translation").mapInPandas(run, "block_id long, score double")


def evaluate(blocks: DataFrame, judge: Callable[[str, str, str], tuple[str, str] | None]) -> DataFrame:
    """job, block_id, tier, said, answered of rows (job, block_id, source, value, feedback): what the judge says of each."""
    kind = dict(blocks.dtypes)["job"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [judge(s or "", v or "", f or "") for s, v, f in zip(pdf["source"], pdf["value"], pdf["feedback"])]
            yield pd.DataFrame({"job": pdf["job"], "block_id": pdf["block_id"], "tier": [g and g[0] for g in got], "said": [g and g[1] for g in got], "answered": [g is not None for g in got]})

    return blocks.select("job", "block_id", "source", "value", "feedback").mapInPandas(run, f"job {kind}, block_id long, tier string, said string, answered boolean")


Hook = Callable[[DataFrame], DataFrame]


def hooked(segments: DataFrame, before: list[Hook], run: Hook, after: list[Hook]) -> DataFrame:
    """``run`` between hooks: each takes and gives rows, distinct texts before it and blocks behind it."""
    for h in before:
        segments = h(segments)
    out = run(segments)
    for h in after:
        out = h(out)
    return out


def lookup(asked: DataFrame, search: Callable[[str, str], dict[str, str] | None], languages: list[str]) -> DataFrame:
    """text, entity_id, labels of rows (text): a knowledge base asked in each language in turn, the last resort last; no row where none answers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                got = next((g for lang in languages if (g := search(t, lang))), None)
                if got:
                    rows.append((t, got["id"], {k: v for k, v in got.items() if k != "id"}))
            yield pd.DataFrame(rows, columns=["text", "entity_id", "labels"])

    return asked.select("text").mapInPandas(run, "text string, entity_id string, labels map<string,string>")


def recognise(pages: DataFrame, ocr: Callable[[bytes], list[str]], least: int = 10) -> DataFrame:
    """doc_id, page, text: pages (doc_id, page, text, image) whose own text is too short, by a recogniser; the lines it finds, or the page's own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for t, image in zip(pdf["text"], pdf["image"]):
                near_empty = len((t or "").strip()) < least and image is not None
                texts.append("\n".join(ocr(bytes(image))) or t if near_empty else t)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "page": pdf["page"], "text": texts})

    return pages.select("doc_id", "page", "text", "image").mapInPandas(run, "doc_id long, page long, text string")


def split_sentences(rows: DataFrame, splitter: Callable[[str, str], list[str] | None]) -> DataFrame:
    """id, pos, sentence of rows (id, text, code): by ``splitter(text, code)``; where it has no answer, and for Chinese, by the punctuation rule."""
    by_rule = rows.select("id", "text", "code", T.sentences(F.col("text")).alias("_rule"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, text, code, rule in zip(pdf["id"], pdf["text"], pdf["code"], pdf["_rule"]):
                said = None if code == "zh" or not text else splitter(text, code)
                kept = [s.strip() for s in said if s.strip()] if said else list(rule)
                out += [(i, k, s) for k, s in enumerate(kept)]
            yield pd.DataFrame(out, columns=["id", "pos", "sentence"])

    return by_rule.mapInPandas(run, "id long, pos long, sentence string")


def to_traditional(rows: DataFrame, convert: Callable[[str], str]) -> DataFrame:
    """Rows (.., target, value) whose target is Traditional Chinese with their value converted; all others stay, as does a value whose conversion fails."""
    schema, at = rows.schema, rows.columns.index("value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(text: str | None) -> str | None:
            try:
                return convert(text) if text else text
            except Exception:  # the text as it was
                return text

        for pdf in batches:
            yield pdf.assign(**{pdf.columns[at]: [one(t) for t in pdf["value"]]})

    mine = T.is_traditional_chinese(F.col("target"))
    return rows.where(~mine).unionByName(rows.where(mine).mapInPandas(run, schema))
