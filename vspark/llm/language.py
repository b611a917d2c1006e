"""Operator 8: language identification by segmentation-marginalised unigrams."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

#: Bounds of the training sample: documents a language, and code points of a document, from a place in it that a hash draws.
SAMPLE_DOCS = 400
SAMPLE_CHARS = 20_000
ROUNDS = 4
SMOOTH = 0.05
UNDETERMINED = "und"
START = "▁"
#: Scores of words in a task's table, in all languages; when it is full it is emptied, which changes no result. Code points scored at a time, and of one word.
CACHE = 400_000
CHUNK = 1_000_000
BLOCK = 4_096

_WORDS = re.compile(r"[^\W\d_]+").findall
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 1 << 18


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return _WORDS(text.lower())


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


@dataclass
class Pieces:
    """A vocabulary as a hash table of pieces; ids count from 0. `missing` stands for any single code point without a piece, `none` for no piece."""

    pieces: list[str]

    def __post_init__(self) -> None:
        self.missing, self.none = len(self.pieces), len(self.pieces) + 1
        self.keys, self.ids = np.zeros((_SLOTS, 4), np.uint64), np.full((_SLOTS, 4), self.none, np.int32)
        self.longest = max(map(len, self.pieces), default=1)
        hashes = np.zeros(len(self.pieces), np.uint64)
        lengths = np.fromiter(map(len, self.pieces), np.int64, len(self.pieces))
        for t in np.unique(lengths):
            at = np.flatnonzero(lengths == t)
            codes = np.frombuffer("".join([self.pieces[i] for i in at]).encode("utf-32-le"), np.uint32).reshape(len(at), int(t))
            for k in range(int(t)):
                hashes[at] = hashes[at] * _BASE + self._mix(codes[:, k].astype(np.uint64))
        slots = self._slot(hashes)
        order = np.argsort(slots, kind="stable")
        starts = np.flatnonzero(np.diff(slots[order], prepend=-1))
        nth = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
        self.keys[slots[order], nth], self.ids[slots[order], nth] = hashes[order], order
        self.depth = int(nth.max(initial=0)) + 1

    @staticmethod
    def _mix(codes):
        with np.errstate(over="ignore"):
            x = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            return x ^ (x >> np.uint64(31))

    @staticmethod
    def _slot(h):
        with np.errstate(over="ignore"):
            return (((h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(46)).astype(np.int64)

    def lattice(self, codes: np.ndarray) -> list[np.ndarray]:
        """Piece ids by length - 1: [words, start] for words of one length given as code points."""
        n, t = codes.shape
        h = np.zeros((n, t + 1), np.uint64)
        mixed = self._mix(codes.astype(np.uint64))
        for i in range(t):
            h[:, i + 1] = h[:, i] * _BASE + mixed[:, i]
        out, power = [], np.uint64(1)
        with np.errstate(over="ignore"):
            for size in range(1, min(self.longest, t) + 1):
                power = power * _BASE
                key = h[:, size:] - h[:, : t + 1 - size] * power
                slot = self._slot(key)
                found = np.full(key.shape, self.missing if size == 1 else self.none, np.int32)
                for k in range(self.depth):
                    found = np.where((self.keys[slot, k] == key) & (self.ids[slot, k] != self.none), self.ids[slot, k], found)
                out.append(found)
        return out


def by_length(words: Sequence[str], room: int = CHUNK // 4) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, code points with the start mark) of the words of each length, about `room` code points or one word at a time."""
    marked = [START + w for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    for t in np.unique(lengths):
        at = np.flatnonzero(lengths == t)
        step = max(1, room // int(t))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            codes = np.frombuffer("".join([marked[i] for i in part]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), int(t))
            yield part, codes


def forward(lattice: list[np.ndarray], p: np.ndarray, scale: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all segmentations: alpha [words, position, language] and the logarithms of the words' probabilities [words, language].

    alpha is scaled along long words, whose logarithms take that back; the logarithm of each position's scale is put into `scale`.
    Positions as far apart as the longest piece have the same scale when they meet.
    """
    n, t, g = lattice[0].shape[0], lattice[0].shape[1], p.shape[1]
    alpha, logs = np.zeros((n, t + 1, g)), np.zeros((n, g))
    alpha[:, 0] = 1
    for i in range(1, t + 1):
        for size in range(1, min(len(lattice), i) + 1):
            alpha[:, i] += alpha[:, i - size] * p[lattice[size - 1][:, i - size]]
        if scale is not None:
            scale[:, i] = logs
        if i % 16 == 0 and i < t:
            top = alpha[:, i].copy()
            lo = max(0, i + 1 - len(lattice))
            alpha[:, lo : i + 1] /= top[:, None]
            logs += np.log(top)
            if scale is not None:
                scale[:, lo : i + 1] = logs[:, None]
    return alpha, logs + np.log(alpha[:, t])


def log_probabilities(codes: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """The logarithms that forward() gives [words, language], a block of positions at a time: memory does not grow with the words' length beyond their code points."""
    n, t = codes.shape
    if t <= BLOCK:
        return forward(pieces.lattice(codes), p)[1]
    back = pieces.longest
    # alpha of the last positions, the latest one at the end; before the word there is none.
    ring = np.zeros((n, back, p.shape[1]))
    ring[:, -1] = 1
    logs = np.zeros((n, p.shape[1]))
    for start in range(0, t, BLOCK):
        first = max(0, start + 1 - back)
        lattice = pieces.lattice(codes[:, first : start + BLOCK])
        for i in range(start + 1, min(t, start + BLOCK) + 1):
            new = sum(ring[:, -size] * p[lattice[size - 1][:, i - size - first]] for size in range(1, min(len(lattice), i) + 1))
            ring = np.concatenate([ring[:, 1:], new[:, None]], axis=1)
            if i % 16 == 0:
                ring /= new[:, None]
                logs += np.log(new)
    return logs + np.log(ring[:, -1])


def train(words: Sequence[str], counts: np.ndarray, pieces: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities by language [pieces + 2, language] by expectation maximisation; counts: [word, language]. Words of any length count, long ones scaled along the way."""
    g = counts.shape[1]
    weight = np.zeros((pieces.none + 1, g))
    for at, codes in by_length(words):
        for ids in pieces.lattice(codes):
            for k in range(g):
                weight[:, k] += np.bincount(ids.ravel(), np.repeat(counts[at, k], ids.shape[1]), minlength=len(weight))
    for r in range(rounds + 1):
        weight[pieces.none] = 0
        weight[: pieces.none] += SMOOTH
        p = weight / weight.sum(axis=0)
        if r == rounds:
            return p
        weight = np.zeros_like(p)
        for at, codes in by_length(words):
            lattice = pieces.lattice(codes)
            t = codes.shape[1]
            scale, back = np.zeros((len(at), t + 1, g)), np.zeros((len(at), t + 1, g))
            alpha, whole = forward(lattice, p, scale)
            # The sums from each position to the end are those of the word read backwards.
            beta = forward([ids[:, ::-1] for ids in lattice], p, back)[0][:, ::-1]
            back = back[:, ::-1]
            for size, ids in enumerate(lattice, 1):
                factor = np.exp(scale[:, : t + 1 - size] + back[:, size:] - whole[:, None])
                expected = alpha[:, : t + 1 - size] * p[ids] * beta[:, size:] * factor * counts[at][:, None]
                for k in range(g):
                    weight[:, k] += np.bincount(ids.ravel(), expected[:, :, k].ravel(), minlength=len(p))
    return p


@lru_cache(maxsize=2)
def _table(pieces: tuple[str, ...]) -> Pieces:
    return Pieces(list(pieces))


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: list[str]
    p: np.ndarray

    def scorer(self) -> Callable[[list[str | None]], list[tuple[str, float]]]:
        """A function from texts to (language, score), with a table of word scores of its own."""
        lattice_of, languages, p = _table(tuple(self.pieces)), self.languages, self.p
        rows: dict[str, int] = {}
        logs = np.zeros((0, len(languages)), np.float64)

        def score(texts: list[str | None]) -> list[tuple[str, float]]:
            nonlocal logs
            found = [words_of(t) if languages and has_letter(t) else [] for t in texts]
            if len(rows) * len(languages) > CACHE:
                rows.clear()
                logs = logs[:0]
            new = list({w for ws in found for w in ws if w not in rows})
            if new:
                made = np.zeros((len(new), len(languages)))
                for at, codes in by_length(new, CHUNK // max(4, len(languages))):
                    made[at] = log_probabilities(codes, lattice_of, p)
                rows.update(zip(new, range(len(logs), len(logs) + len(new)), strict=True))
                logs = np.concatenate([logs, made])
            out = []
            for ws in found:
                if not ws:
                    out.append((UNDETERMINED, 0.0))
                    continue
                total = logs[np.fromiter(map(rows.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
                # A word's evidence counts less the more there are, as words of a text are not independent.
                share = np.exp((total - total.max()) / np.sqrt(len(ws)))
                best = int(total.argmax())
                out.append((languages[best], float(share[best] / share.sum())))
            return out

        return score


def read_pieces(model_path: str) -> list[str]:
    """The pieces of a sentencepiece model that a run of lower-case letters can hold."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_path)
    every = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]
    return [x for x in every if x == x.lower() and (rest := x.removeprefix(START)) == rest.strip() and (rest.isalpha() or x == START)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_languages(docs: DataFrame, model_path: str) -> LanguageModel:
    """Learn from text and lang of the documents of docs that have both; the caller leaves out what must not be learned from.

    The sample is bounded: SAMPLE_DOCS documents of each language, by a hash of doc_id and text, and of longer ones a stretch of
    SAMPLE_CHARS code points. A language is trained by itself, from its word counts, in a task of its own. What comes to
    the driver is a number a piece and language, so that it grows with the number of languages alone (0.2 MB for each).
    """
    ship(docs.sparkSession)
    known = docs.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(counts)
    pieces = read_pieces(model_path)
    if not languages:
        return LanguageModel([], pieces, np.zeros((len(pieces) + 2, 0)))
    # About twice as many are drawn by their hashes as are needed, so that little is sorted.
    shares = F.map_from_arrays(F.array(*map(F.lit, languages)), F.array(*[F.lit(min(1.0, 2 * SAMPLE_DOCS / counts[x])) for x in languages]))
    mixed = known.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    drawn = mixed.filter(F.pmod("h", F.lit(1 << 20)) <= shares[F.col("lang")] * F.lit(1 << 20))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    sample = drawn.withColumn("nth", nth).filter(F.col("nth") <= SAMPLE_DOCS)
    at = F.pmod(F.shiftright("h", 20), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    stretch = F.substring("text", at.cast("int"), SAMPLE_CHARS)
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower(stretch), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("p", T.BinaryType())])

    shared = tuple(pieces)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("word")
        p = train(rows["word"].tolist(), rows["count"].to_numpy(float)[:, None], _table(shared))
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "p": [p[:, 0].tobytes()]})

    fitted = {r["lang"]: np.frombuffer(r["p"]) for r in words.groupBy("lang", "word").count().groupBy("lang").applyInPandas(fit, schema).collect()}
    # A language whose sample holds no letter has no evidence for any piece.
    even = np.full(len(pieces) + 2, 1 / (len(pieces) + 1))
    even[-1] = 0
    return LanguageModel(languages, pieces, np.stack([fitted.get(x, even) for x in languages], axis=1))


PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predict_languages(docs: DataFrame, model: LanguageModel, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The `keep` columns with lang_pred and score.

    A text's score for a language is the product of its words' probabilities, each the sum over all segmentations of the
    word into pieces (forward algorithm); `score` is the best language's share, by evidence divided by the root of
    the number of words. Null text, or text without a letter: und, score 0. Ties: the first language by name.
    Texts, and runs of letters, of any length are read whole. Repeated rows: each by itself. Empty tables: no rows. No
    shuffle; the model (a column of about 20,000 numbers for each language) goes with the tasks as a broadcast.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.pieces, model.p))
    kept = [c for c in keep if c not in PREDICTED.names]
    # The text goes to the workers once, also where it is kept.
    others = [c for c in kept if c != "text"]
    source = docs.select(docs["text"].alias("__text"), *[docs[f"`{c}`"].alias(f"__keep{i}") for i, c in enumerate(others)])
    place = {"text": 0} | {c: i + 1 for i, c in enumerate(others)}
    schema = T.StructType([T.StructField(c, source.schema.fields[place[c]].dataType) for c in kept] + list(PREDICTED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = LanguageModel(*shared.value).scorer()
        for batch in batches:
            column, made, part, size = batch.column(0), [], [], 0
            for i in range(batch.num_rows):
                part.append(text := column[i].as_py())
                size += len(text or "")
                if size >= CHUNK:
                    made += score(part)
                    part, size = [], 0
            made += score(part)
            added = [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(place[c]) for c in kept] + added, names=kept + PREDICTED.names)

    return source.mapInArrow(run, schema)


def op8_language(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit_languages(docs.filter(~held_out(F.col("doc_id"))), public_tokenizers.path("piece_bpe_32k.model"))
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return predict_languages(rows, model, ("doc_id", "held_out"))
