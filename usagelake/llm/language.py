"""Language ID: script ranges narrow the candidates, Viterbi labels spans of mixed text.

Training counts letter trigrams of the labelled documents per language. A word's score for a
language is the log-probability of its trigrams; a language is a candidate only if it was seen to
use the script of the word. The best path through the words of a text pays a fixed penalty per
change of language, which gives spans; the language with most letters names the document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .registry import query

# Code points of scripts, first and last.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0xF900, 0xFAFF),
    ("han", 0x20000, 0x2FA1F),
)
_NAMES = sorted({name for name, _, _ in SCRIPTS})
OTHER = len(_NAMES)

#: Letter pairs and trigrams are hashed to so many counters, which bounds the model per language:
#: 2 * 65,536 numbers, whatever the corpus.
SLOTS = 1 << 16
#: A language uses a script that has at least this share of its letters.
SCRIPT_SHARE = 0.01
#: Cost of a change of language, in natural logarithms.
SWITCH = 12.0
#: A single word speaks for one language over another by no more than this.
MOST = 8.0
#: Added to every trigram count.
ADDED = 0.05
#: Words labelled at once in a task, words scored at once, and scores that a task remembers.
CHUNK, SLICE, REMEMBERED = 1 << 20, 1 << 16, 1 << 21

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case; numerals that the pattern takes for letters end them."""
    found = WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [part for w in found for part in (
        [w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the pair and of the trigram at each place of the padded words; the words' starts."""
    padded = "".join([f"\x02\x02{w}\x03" for w in words])
    code = np.frombuffer(padded.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    starts = np.flatnonzero((code == 2) & (np.roll(code, -1) == 2))
    pair = (code[:-2] * np.uint64(0x9E3779B1) + code[1:-1] * np.uint64(0x85EBCA77)) & np.uint64(0xFFFFFFFF)
    third = (pair * np.uint64(0x27D4EB2F) + code[2:] * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)
    inside = code[2:] != 2  # a trigram that reaches into the next word ends in its padding
    shift = np.uint64(16)
    pairs = ((pair ^ pair >> shift) & np.uint64(SLOTS - 1)).astype(np.int64)
    thirds = ((third ^ third >> shift) & np.uint64(SLOTS - 1)).astype(np.int64)
    return np.where(inside, pairs, -1), np.where(inside, thirds, -1), starts


def scripts_of(words: list[str]) -> np.ndarray:
    """The script of each word's first letter."""
    first = np.array([ord(w[0]) for w in words], dtype=np.int64)
    out = np.full(len(words), OTHER, dtype=np.int64)
    for name, low, high in SCRIPTS:
        out[(first >= low) & (first <= high)] = _NAMES.index(name)
    return out


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of a task: lang, kind (0 script, 1 pair, 2 trigram), slot, n. Bounded per language."""
    sums: dict[str, list[np.ndarray]] = {}
    for batch in batches:
        for lang, texts in batch.groupby("lang", sort=False)["text"]:
            seen: Counter[str] = Counter()
            for text in texts:
                seen.update(words_of(text))
            if not seen:
                continue
            own = sums.setdefault(lang, [np.zeros(OTHER + 1), np.zeros(SLOTS), np.zeros(SLOTS)])
            words, n = list(seen), np.fromiter(seen.values(), dtype=np.float64, count=len(seen))
            lengths = np.array([len(w) for w in words])
            own[0] += np.bincount(scripts_of(words), weights=n * lengths, minlength=OTHER + 1)
            pairs, thirds, _ = _grams(words)
            weight = np.repeat(n, lengths + 3)[: len(pairs)]
            used = pairs >= 0
            own[1] += np.bincount(pairs[used], weights=weight[used], minlength=SLOTS)
            own[2] += np.bincount(thirds[used], weights=weight[used], minlength=SLOTS)
    for lang, own in sums.items():
        for kind, counts in enumerate(own):
            slot = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "kind": kind, "slot": slot, "n": counts[slot].astype(np.int64)})


class Model:
    """Scores of every language: 2 * ``SLOTS`` numbers each, however large the corpus was."""

    def __init__(self, langs: list[str], counts: pd.DataFrame):
        self.langs = langs
        size = len(langs)
        scripts = np.zeros((OTHER + 1, size))
        pairs, thirds = np.zeros((SLOTS, size)), np.zeros((SLOTS, size))
        at = counts["lang"].map({lang: i for i, lang in enumerate(langs)}).to_numpy(dtype=np.int64)
        for kind, table in enumerate((scripts, pairs, thirds)):
            rows = (counts["kind"] == kind).to_numpy()
            table[counts["slot"].to_numpy(dtype=np.int64)[rows], at[rows]] = counts["n"].to_numpy(dtype=np.float64)[rows]
        self.allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
        self.thirds = np.log(thirds + ADDED).astype(np.float32)
        self.pairs = np.log(pairs + 32 * ADDED).astype(np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in each language, less that of the best candidate."""
        pairs, thirds, starts = _grams(words)
        part = np.where((pairs >= 0)[:, None], self.thirds[thirds] - self.pairs[pairs], 0)
        out = np.add.reduceat(np.concatenate([part, np.zeros((2, part.shape[1]), part.dtype)]), starts)
        allowed = self.allowed[scripts_of(words)]
        out = np.where(allowed, out, -np.inf)
        best = out.max(axis=1, keepdims=True)
        out = np.where(np.isfinite(best), out - best, 0)  # no language uses the script: says nothing
        return np.maximum(out, -MOST).astype(np.float32)


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """The best language of every word of texts that lie one after the other.

    All texts step through their words together, so the number of steps is that of the longest.
    """
    n, size = scores.shape
    start = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    start, lengths = start[order], lengths[order]
    back = np.empty((n, size), dtype=np.int16)
    stay = np.arange(size, dtype=np.int16)
    best = scores[start].astype(np.float64)
    final = np.empty((len(lengths), size))
    active = len(lengths)
    steps = int(lengths[0])
    for t in range(1, steps + 1):
        alive = int(np.searchsorted(-lengths, -t, side="left"))  # texts longer than t words
        if alive < active:
            final[alive:active] = best[alive:active]
            best, active = best[:alive], alive
        if not active:
            break
        top = best.argmax(axis=1)
        jump = best[np.arange(active), top] - switch
        move = best < jump[:, None]
        at = start[:active] + t
        back[at] = np.where(move, top[:, None], stay)
        best = np.where(move, jump[:, None], best) + scores[at]
    path = np.empty(n, dtype=np.int16)
    state = final.argmax(axis=1).astype(np.int16)
    for t in range(steps - 1, -1, -1):
        alive = int(np.searchsorted(-lengths, -t, side="left"))
        at = start[:alive] + t
        path[at] = state[:alive]
        if t:
            state[:alive] = back[at, state[:alive]]
    return path


class Labeller:
    """Labels batches of texts; scores of words met before are remembered, which changes no result."""

    def __init__(self, model: Model, switch: float):
        self.model, self.switch = model, switch
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(model.langs)), dtype=np.float32)

    def _rows(self, words: list[str]) -> np.ndarray:
        new = list(set(words).difference(self.known))
        if (len(self.known) + len(new)) * len(self.model.langs) > REMEMBERED:
            self.known, self.table = {}, self.table[:0]
            new = list(set(words))
        if new:
            at = len(self.known)
            self.known.update(zip(new, range(at, at + len(new))))
            parts = [self.model.scores(new[i:i + SLICE]) for i in range(0, len(new), SLICE)]
            self.table = np.concatenate([self.table, *parts])
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))

    def label(self, texts: list[str | None]) -> list[tuple]:
        """(lang_pred, score, spans) per text."""
        out: list[tuple] = []
        held: list[list[str]] = []
        n = 0
        for text in texts:
            held.append(words_of(text))
            n += len(held[-1])
            if n >= CHUNK:
                out += self._chunk(held)
                held, n = [], 0
        return out + self._chunk(held) if held else out

    def _chunk(self, texts: list[list[str]]) -> list[tuple]:
        langs = self.model.langs
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        out: list[tuple] = [(UNKNOWN, 0.0, [])] * len(texts)
        words = [w for t in texts for w in t]
        if not words or not langs:
            return out
        rows = self._rows(words)
        scores = self.table[rows]
        letters = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        some = np.flatnonzero(lengths)
        path = viterbi(scores, lengths[some], self.switch)
        start = np.cumsum(lengths) - lengths
        change = np.concatenate([[True], path[1:] != path[:-1]])
        change[start[some]] = True
        first = np.flatnonzero(change)
        size = np.add.reduceat(letters, first)
        text_of = np.searchsorted(start[some], first, side="right") - 1
        last = np.concatenate([first[1:], [len(words)]]) - 1
        total = np.zeros((len(some), len(langs)))
        np.add.at(total, (text_of, path[first]), size)
        best = total.argmax(axis=1)
        share = total[np.arange(len(some)), best] / total.sum(axis=1)
        spans: list[list[tuple]] = [[] for _ in some]
        for t, f, e, s in zip(text_of.tolist(), first.tolist(), last.tolist(), size.tolist()):
            base = int(start[some[t]])
            spans[t].append((langs[path[f]], f - base, e - base, s))
        for t, where in enumerate(some.tolist()):
            out[where] = (langs[best[t]], float(share[t]), spans[t])
        return out


def learn(docs: DataFrame, text: str, lang: str, where: Column) -> Model:
    """Counts over all labelled documents that meet the condition.

    Every task adds up its own documents and sends a bounded table per language; the driver gets
    2 * 65,536 sums per language at most. The number of languages is taken to be bounded.
    """
    labelled = docs.where(where & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(
        F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    counts = (
        labelled.mapInPandas(_tally, "lang string, kind int, slot long, n long")
        .groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n")).toPandas()
    )
    return Model(sorted(counts["lang"].unique()), counts)


def label(docs: DataFrame, model: Model, text: str = "text", switch: float = SWITCH) -> Column:
    """A struct for every text: lang_pred, score and spans.

    score is the share of the letters that lie in words of the predicted language. A span is (lang,
    first, last, letters); words are runs of letters, counted from 0. A text without letters, null
    included, gets ``und``, score 0 and no spans, and so do all texts if nothing was learned.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)
    kind = "lang_pred string, score double, spans array<struct<lang:string,first:int,last:int,letters:int>>"

    @F.pandas_udf(kind)
    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(spread.value, switch)
        for texts in batches:
            found = labeller.label(texts.tolist())
            yield pd.DataFrame({
                "lang_pred": [x[0] for x in found], "score": [x[1] for x in found],
                "spans": [[dict(zip(("lang", "first", "last", "letters"), s)) for s in x[2]] for x in found],
            })

    return labelled(F.col(f"`{text}`").cast("string"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether nothing may be learned from the document: a fifth of the ids, by checksum."""
    return F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 5 == 0


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
             switch: float = SWITCH) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, spans.

    Nothing is learned from held-out documents, null labels or null ids; ``lang`` serves training
    only. Null ids are not held out. Repeated rows are labelled alike. An empty table gives an
    empty result.
    """
    out = held_out(doc_id)
    model = learn(docs, text, lang, ~out)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(out, F.lit(False)).alias("held_out"),
                       label(docs, model, text, switch).alias("found"))
    return rows.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.spans")


def accepted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
             least: float = 0.5) -> DataFrame:
    """The rows of which at least the share ``least`` of the letters lies in words of known languages,
    however many of them there are."""
    model = learn(docs, text, lang, ~held_out(doc_id))
    found = "_language"
    marked = docs.withColumn(found, label(docs, model, text))
    spans = F.col(f"{found}.spans")

    def letters(some: Column) -> Column:
        return F.aggregate(some, F.lit(0).cast("long"), lambda n, s: n + s["letters"])

    known = letters(F.filter(spans, lambda s: s["lang"] != UNKNOWN))
    return marked.where((known > 0) & (known >= least * letters(spans))).drop(found)


@query("op8_language")
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score",
                                                             F.size("spans").alias("n_spans"))
