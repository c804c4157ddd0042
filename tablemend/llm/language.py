"""Language of texts by cross-parsing entropy.

A suffix automaton is built from labelled text of each language. A text is parsed into the longest matches with a
language's text, one after the other; the language whose automaton needs the fewest phrases for a character wins.
Texts are lower-cased, everything but letters becomes one blank, and the parsing reads their UTF-8 bytes in blocks, at
whose ends a phrase ends as well. A byte that no learnt text of a language has is a phrase of its own.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .worker import frugal, held

BLOCK = 512
GAP = re.compile(r"[\W\d_]+")
LETTER = re.compile(r"[^\W\d_]")
#: Reserved byte of no text: a break between two learnt texts.
BREAK = 255


def plain(text: str | None) -> bytes:
    return GAP.sub(" ", text or "").lower().encode("utf-8", "replace")


class Automaton:
    """The suffix automaton of a byte string; ``step[state]`` maps a byte to the next state."""

    def __init__(self, text: bytes) -> None:
        step: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for byte in text:
            if byte == BREAK:
                last = 0
                continue
            known = step[last].get(byte)
            if known is not None and length[known] == length[last] + 1:
                last = known
                continue
            if known is not None:
                # a text that goes on as an earlier one: its state is split off
                last = self.split(step, link, length, last, byte, known)
                continue
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and byte not in step[at]:
                step[at][byte] = new
                at = link[at]
            if at >= 0:
                next_ = step[at][byte]
                link[new] = next_ if length[next_] == length[at] + 1 else self.split(step, link, length, at, byte, next_)
            last = new
        self.step = step

    @staticmethod
    def split(step: list, link: list, length: list, at: int, byte: int, old: int) -> int:
        """A state for the shorter strings of ``old``, reached from ``at`` and its suffixes."""
        copy = len(step)
        step.append(dict(step[old]))
        length.append(length[at] + 1)
        link.append(link[old])
        link[old] = copy
        while at >= 0 and step[at].get(byte) == old:
            step[at][byte] = copy
            at = link[at]
        return copy


class Parser:
    """The automata of all languages as one table: state and byte class to next state, 0 if there is none."""

    def __init__(self, learnt: list[tuple[str, bytes]]) -> None:
        self.names = [name for name, _ in learnt]
        used = sorted(set().union(*(set(t) for _, t in learnt)) - {BREAK})
        self.kind = np.zeros(256, np.int64)
        self.kind[used] = np.arange(1, len(used) + 1)
        width, made, self.root, base = len(used) + 1, [], [], 1
        for _, text in learnt:
            steps = Automaton(text).step
            table = np.zeros((len(steps), width), np.int32)
            for state, moves in enumerate(steps):
                for byte, to in moves.items():
                    table[state, self.kind[byte]] = to + base
            self.root.append(base)
            made.append(table)
            base += len(steps)
        self.table = np.concatenate([np.zeros((1, width), np.int32), *made]).reshape(-1)
        self.width = width

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text (rows) for each language (columns)."""
        size = np.array([len(t) for t in texts], np.int64)
        data = self.kind[np.frombuffer(b"".join(texts), np.uint8)]
        blocks = -(-size // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        left = np.minimum(BLOCK, size[owner] - nth * BLOCK)
        begin = np.repeat(np.cumsum(size) - size, blocks) + nth * BLOCK
        order = np.argsort(-left, kind="stable")
        owner, left, begin = owner[order], left[order], begin[order]
        out = np.zeros((len(texts), len(self.names)), np.int64)
        roots = np.array(self.root, np.int64)
        state = np.repeat(roots[None, :], len(owner), 0)
        count = np.zeros(state.shape, np.int64)
        active = np.searchsorted(-left, -np.arange(BLOCK), "left")  # blocks longer than each offset
        for at in range(BLOCK):
            n = int(active[at])
            if not n:
                break
            kind = data[begin[:n] + at][:, None]
            to = self.table[state[:n] * self.width + kind]
            cut = to == 0
            if cut.any():
                root = np.broadcast_to(roots, cut.shape)[cut]
                again = self.table[root * self.width + np.broadcast_to(kind, cut.shape)[cut]]
                # the phrase ends; a byte that no text of the language has is one of its own
                count[:n][cut] += 1 + ((again == 0) & (state[:n][cut] != root))
                to[cut] = np.where(again == 0, root, again)
            state[:n] = to
        np.add.at(out, owner, count + (state != roots))  # at its language's root a block has no open phrase
        return out


@frugal("parser")
def _predict(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    name, learnt = shared.value
    parser = held("parser", name, lambda: Parser(learnt) if learnt else None)  # a worker builds the automata once
    for batch in batches:
        texts = batch.column(1).to_pylist()
        lang, sure = ["und"] * len(texts), [0.0] * len(texts)
        at = [k for k, t in enumerate(texts) if parser and t and LETTER.search(t)]
        for a in range(0, len(at), 512):
            part = at[a : a + 512]
            raw = [plain(texts[k]) for k in part]
            rate = parser.phrases(raw) / np.array([len(r) for r in raw])[:, None]
            best = rate.argmin(axis=1)
            weight = np.exp2(np.clip(-8 * len(parser.names) * (rate / rate.min(axis=1, keepdims=True) - 1), -60, 0))
            for k, b, w in zip(part, best.tolist(), (1 / weight.sum(axis=1)).tolist(), strict=True):
                lang[k], sure[k] = parser.names[b], min(1.0, w)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "held_out": batch.column(2), "lang_pred": lang, "score": sure})


def held_out(key: str = "doc_id") -> Column:
    """The fold that is never learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, documents: int = 64, characters: int = 3000, languages: int = 200) -> list[tuple[str, bytes]]:
    """Learnt text of each language: ``documents`` different whole texts of at most ``characters``, those of least hash.

    This is a bounded sample of labelled rows: at most ``languages`` (the most frequent ones; others are not predicted)
    times documents times characters. Where a language has fewer such texts, all of them are learnt.
    """
    known = docs.filter(~held_out()).filter("lang is not null and text is not null").select("lang", F.col("text").cast("string").alias("t"))
    known = known.filter(F.length("t") <= characters)
    known = known.filter(F.col("t").rlike(r"\p{L}")).withColumn("h", F.xxhash64("t")).select("lang", "h", "t")
    # each task keeps its own least rows before the shuffle, so no language is gathered in one task
    least = F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))
    chosen = known.withColumn("r", F.dense_rank().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= documents).select("lang", "h", "t").distinct()
    chosen = chosen.withColumn("r", least).filter(F.col("r") <= documents)
    most = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).select("lang")
    rows = sorted((r["lang"], r["h"], r["t"]) for r in written(chosen, "learnt").join(F.broadcast(most), "lang").collect())
    text: dict[str, list[bytes]] = {}
    for lang, _, part in rows:
        text.setdefault(lang, []).append(plain(part).strip())
    return [(lang, bytes([BREAK]).join(parts)) for lang, parts in sorted(text.items())]


def languages(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score (0 to 1). ``docs``: doc_id, text, lang.

    Learnt from texts with a lang outside the held-out fold; only the text enters a prediction. A null text and one
    without letters are ``und`` with score 0, and so is everything if nothing can be learnt. Ties go to the
    alphabetically first language. Repeated rows get equal results; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, learn(docs)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    return rows.mapInArrow(partial(_predict, shared=shared), "doc_id bigint, held_out boolean, lang_pred string, score double")
