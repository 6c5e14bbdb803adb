"""Personal details inside free text: found by their kind and place, replaced by typed marks.

Generators propose overlapping candidate spans (``candidates``), boosted trees over format and
context numbers give each a calibrated probability, per-kind thresholds select, and
of overlapping selections the most probable stays.
"""

from __future__ import annotations

import base64
import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interlock.llm.boosting import Boosted
from interlock.llm.candidates import KINDS, Names, find
from interlock.llm.labelled import SENTENCES, sentences

#: More known names than this are refused: the list goes to every worker.
MOST_NAMES = 200_000
MARK = {k: f"[{k.upper()}]" for k in KINDS}
_HELD_OUT = 4


#: Vocabulary of word pieces that says how common a word is.
COMMON = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=2)
def common_words(vocabulary: str = COMMON) -> frozenset[str]:
    """Words that are one piece of a public vocabulary (with a blank before them); none if there is no such file."""
    try:
        with open(vocabulary, "rb") as f:
            pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    except OSError:
        return frozenset()
    words = (p[1:].decode("utf-8", "ignore") for p in pieces if p[:1] == b" ")
    return frozenset(w for w in words if len(w) > 2 and w.isalpha())


@lru_cache(maxsize=4)
def models(number: int = SENTENCES, seed: int = 11, vocabulary: str = COMMON, kept_out: bool = False) -> dict[str, Boosted]:
    """One calibrated model a kind, from ``number`` labelled sentences; every fourth is held out for calibration.  With ``kept_out`` some patterns are never seen."""
    texts, names = sentences(seed, number, common_words(vocabulary), False if kept_out else None)
    rows: dict[str, list[tuple[list[float], float, bool]]] = {k: [] for k in KINDS}
    for i, (text, truth) in enumerate(texts):
        for c in find(text, names):
            rows[c.kind].append((c.features, float((c.kind, c.start) in truth), i % _HELD_OUT == 0))
    out = {}
    for k, found in rows.items():
        x, y, held = np.array([r[0] for r in found]), np.array([r[1] for r in found]), np.array([r[2] for r in found])
        out[k] = Boosted().fit(x[~held], y[~held]).calibrate(x[held], y[held])
    return out


def detect(texts: list[str | None], names: Names, fitted: dict[str, Boosted]) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of each text's personal details, in order and without overlap."""
    found = [find(t, names) if t else [] for t in texts]
    chance: list[list[float]] = [[0.0] * len(f) for f in found]
    for kind in KINDS:
        at = [(i, j) for i, f in enumerate(found) for j, c in enumerate(f) if c.kind == kind]
        if at:
            p = fitted[kind].predict(np.array([found[i][j].features for i, j in at]))
            for (i, j), v in zip(at, p):
                chance[i][j] = float(v) if v >= fitted[kind].threshold else 0.0
    out = []
    for cands, p in zip(found, chance):
        # an e-mail address takes all inside it, a name yields to the other kinds; else the likelier, then the longer
        order = sorted((k for k in range(len(cands)) if p[k] > 0), key=lambda k: (cands[k].kind != "email", cands[k].kind == "name", -round(p[k], 2), cands[k].start - cands[k].end, cands[k].start))
        kept: list[tuple[str, int, int]] = []
        for k in order:
            c = cands[k]
            if all(c.end <= a or c.start >= b for _, a, b in kept):
                kept.append((c.kind, c.start, c.end))
        out.append(sorted(kept, key=lambda s: s[1]))
    return out


def replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by the mark of its kind, all else kept."""
    out, at = [], 0
    for kind, a, b in spans:
        out += [text[at:a], MARK[kind]]
        at = b
    return "".join([*out, text[at:]])


def known_names(people: DataFrame, given: str = "given_name", family: str = "family_name", vocabulary: str = COMMON) -> Names:
    """Known given and family names, null and empty ones left out, and common words."""
    rows = people.select(given, family).distinct().limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names")
    return Names({r[0] for r in rows if r[0]}, {r[1] for r in rows if r[1]}, common_words(vocabulary))


def personal_spans(documents: DataFrame, people: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, kind, start_pos, end_pos): one row a detail; places count code points from 0.

    Null and empty texts give no row; repeated or null ids are kept as they are.
    """
    run = _spans(documents, people, lambda ids, texts, spans: _rows(ids, spans))
    kind = documents.schema[id_].dataType.simpleString()
    return documents.where(F.length(text) > 0).select(F.col(id_).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, kind string, start_pos long, end_pos long").withColumnRenamed("id", id_)


def redact(documents: DataFrame, people: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, n_replaced): every text with its personal details replaced by marks of their kind.

    One row per input row; null stays null, empty stays empty, and all text outside the spans is kept as it is.
    """

    def rows(ids: pa.Array, texts: list[str | None], spans: list[list[tuple[str, int, int]]]) -> pa.RecordBatch:
        out = [None if t is None else replaced(t, s) for t, s in zip(texts, spans)]
        return pa.RecordBatch.from_arrays([ids, pa.array(out, pa.string()), pa.array([len(s) for s in spans], pa.int64())], names=["id", "text", "n_replaced"])

    kind = documents.schema[id_].dataType.simpleString()
    return documents.select(F.col(id_).alias("id"), F.col(text).alias("text")).mapInArrow(_spans(documents, people, rows), f"id {kind}, text string, n_replaced long").withColumnRenamed("id", id_)


def _rows(ids: pa.Array, spans: list[list[tuple[str, int, int]]]) -> pa.RecordBatch:
    at = pa.array(np.repeat(np.arange(len(spans)), [len(s) for s in spans]))
    flat = [x for s in spans for x in s]
    return pa.RecordBatch.from_arrays(
        [ids.take(at), pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.int64()), pa.array([x[2] for x in flat], pa.int64())],
        names=["id", "kind", "start_pos", "end_pos"],
    )


def _spans(documents: DataFrame, people: DataFrame, rows):
    """A batch function that detects with models fitted once by the driver; both are of bounded size."""
    shared = documents.sparkSession.sparkContext.broadcast(pickle.dumps((known_names(people), models())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, fitted = pickle.loads(shared.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = part.column("text").to_pylist()
                yield rows(part.column("id"), texts, detect(texts, names, fitted))

    return run
