"""Operator 5: quality rules by divergence from language references."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import with_computed
from .common import ship

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30
#: Fewer word characters or words than these: the distance is not looked at.
MIN_CHARS = 100
MIN_COMMON_WORDS = 70
#: Largest Jensen-Shannon distances (square root of the divergence in bits, 0 to 1) to the reference. A text of n words has by chance
#: alone a distance of about 1.7 / sqrt(n) by its common words, so that the limit is BASE + BY_CHANCE / sqrt(n).
MAX_CHAR_DISTANCE = 0.185
MAX_WORD_DISTANCE_BASE, MAX_WORD_DISTANCE_BY_CHANCE = 0.08, 2.7
#: Common words of a language: its most frequent ones, counted in the table.
OWN_WORDS = 32
#: Digits count as far as they are more than this share of a text's characters: numbers in prose are no sign of its quality.
FREE_DIGITS = 0.2
#: Shares of character classes are counted in steps of 1 / STEPS.
STEPS = 1000
#: Entries of a task's table of counts; when it is full it is sent on, which changes no result.
TABLE = 300_000
#: Classes of code points: lower case, upper case, other letters and marks, numbers, punctuation, symbols, others. White space is none.
CLASSES, DIGITS, WHITE_CLASS = 7, 3, 7
_FOLD = bytes(32 if c < 128 and not (97 <= c <= 122 or 48 <= c <= 57) else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point; symbols are also the ASCII signs that n_symbols counts, and !."""
    first = {"L": 2, "M": 2, "N": DIGITS, "P": 4, "S": 5}
    out = np.full(0x110000, 6, np.uint8)
    for c in range(0x33480):
        kind = unicodedata.category(chr(c))
        out[c] = 0 if kind == "Ll" else 1 if kind in ("Lu", "Lt") else first.get(kind[0], 6)
    out[[*SYMBOLS, ord("!")]] = 5
    out[[ord(c) for c in WHITE]] = WHITE_CLASS
    return out


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in windows of 8 words which occur twice or more in the text, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = ids ^ (ids >> np.uint64(29))
    rolled = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        rolled = rolled * _ODD + mixed[k : k + n]
    order = np.sort(rolled)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(rolled, twice))
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def base_features(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; null text: none of them."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n_symbols = sum(data.count(c) for c in SYMBOLS)
    return len(words), len(text) - sum(map(text.count, WHITE)), n_symbols, len(lines) - len(set(lines)), repeat_words(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEATED * n_words


def folded_words(text: str | None) -> list[bytes]:
    """Runs of letters and digits in lower case, in UTF-8."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()


def char_histogram(text: str | None) -> np.ndarray:
    """Counts of code points by class; of digits, those beyond FREE_DIGITS of the text."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.bincount(_classes()[codes], minlength=CLASSES + 1)[:CLASSES].astype(float)
    counts[DIGITS] = max(0.0, counts[DIGITS] - FREE_DIGITS * counts.sum())
    return counts


def word_limit(n_words: int) -> float:
    return MAX_WORD_DISTANCE_BASE + MAX_WORD_DISTANCE_BY_CHANCE / max(1, n_words) ** 0.5


def js_distances(p: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances, 0 to 1, of a histogram to each row of references; 1 where one of the two is empty."""
    sums = references.sum(axis=1)
    if not p.sum():
        return np.ones(len(references))
    p, q = (p / p.sum())[None], references / np.maximum(sums, 1e-300)[:, None]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = (np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)).sum(axis=1) / 2
    return np.where(sums > 0, np.sqrt(np.clip(d, 0, 1)), 1.0)


#: By language: shares of character classes, shares of all other words and of its common words, and these words.
References = dict[str, tuple[np.ndarray, np.ndarray, tuple[str, ...]]]

#: Kinds of counts besides the classes: a word, and all words.
WORD_KIND, TOTAL_KIND = -1, -2


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, key, n) summed over the documents of a task that pass the base rules: words, all words, and documents by class and share."""
    words: dict[str, Counter] = {}
    shares: Counter = Counter()

    def sent() -> Iterator[pa.RecordBatch]:
        rows = [(lang, WORD_KIND, w.decode("utf-8", "replace"), n) for lang, c in words.items() for w, n in c.items()]
        rows += [(lang, TOTAL_KIND, "", sum(c.values())) for lang, c in words.items()]
        rows += [(lang, k, str(share), n) for (lang, k, share), n in shares.items()]
        words.clear()
        shares.clear()
        for i in range(0, len(rows), 20_000):
            columns = list(zip(*rows[i : i + 20_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["lang", "kind", "key", "n"])

    for batch in batches:
        texts, langs = batch.column(0), batch.column(1).to_pylist()
        for i, lang in enumerate(langs):
            text = texts[i].as_py()
            split = text.encode("utf-8", "surrogatepass").split()
            if base_failed(len(split), repeat_words(split)):
                continue
            words.setdefault(lang, Counter()).update(folded_words(text))
            chars = char_histogram(text)
            for k, share in enumerate(np.rint(chars * (STEPS / max(1.0, chars.sum()))).astype(int).tolist()):
                shares[lang, k, share] += 1
        if sum(map(len, words.values())) > TABLE:
            yield from sent()
    yield from sent()


def language_references(docs: DataFrame) -> References:
    """Reference histograms of every language of docs, over all its documents that do not fail the base rules.

    Character classes: the median of the documents' shares, which junk in less than half of the documents hardly moves. Common
    words: the OWN_WORDS most frequent words, ties by the word, with their shares of all words. Counts are whole numbers, so
    that the references don't depend on how rows are dealt. Each task sums up before the shuffle; what comes to the driver is at
    most STEPS counts for each class and OWN_WORDS words of each language.
    """
    ship(docs.sparkSession)
    known = docs.filter("lang is not null and text is not null").select("text", "lang")
    counts = known.mapInArrow(_counted, "lang string, kind int, key string, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    # Each share of a class stands by itself, so that one small limit holds for all and cuts the words in every task, before the shuffle.
    nth = F.row_number().over(Window.partitionBy("lang", "kind", F.when(F.col("kind") >= 0, F.col("key"))).orderBy(F.desc("n"), "key"))
    rows = counts.withColumn("nth", nth).filter(F.col("nth") <= OWN_WORDS).collect()
    found: dict[str, dict[int, list]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["kind"], r["nth"])):
        found.setdefault(r["lang"], {}).setdefault(r["kind"], []).append((r["key"], r["n"]))
    references = {}
    for lang, kinds in found.items():
        chars = np.zeros(CLASSES)
        for k in range(CLASSES):
            bins = sorted((int(share), n) for share, n in kinds[k])
            up_to = np.cumsum([n for _, n in bins])
            chars[k] = bins[int(np.searchsorted(2 * up_to, up_to[-1]))][0] / STEPS
        total, common = kinds[TOTAL_KIND][0][1], kinds.get(WORD_KIND, [])
        own = [n for _, n in common]
        references[lang] = (chars, np.array([total - sum(own), *own, *[0] * (OWN_WORDS - len(own))]) / max(1, total), tuple(w for w, _ in common))
    return references


RULES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("char_distance", T.DoubleType()), T.StructField("word_distance", T.DoubleType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
)


class Judge:
    """References laid out for judging texts one by one."""

    def __init__(self, references: References):
        self.places = {lang: i for i, lang in enumerate(references)}
        stacked = lambda k, n: np.array([r[k] for r in references.values()]).reshape(len(references), n)
        self.chars, self.words = stacked(0, CLASSES), stacked(1, OWN_WORDS + 1)
        self.own = [{w.encode(): k + 1 for k, w in enumerate(r[2])} for r in references.values()]
        self.any: dict[bytes, list[int]] = {}
        for i, bins in enumerate(self.own):
            for w, k in bins.items():
                self.any.setdefault(w, []).append(i * (OWN_WORDS + 1) + k)

    def distances(self, text: str | None, lang: str | None) -> list[tuple[float, float]]:
        """Pairs of distances: to the text's own language, or if that is null to each."""
        if not self.places or lang is not None and lang not in self.places:
            return []
        folded = folded_words(text)
        if lang is None:
            counts = np.bincount([at for w in folded for at in self.any.get(w, ())] or [0], minlength=self.words.size).reshape(self.words.shape).astype(float)
            counts[:, 0] = len(folded) - counts[:, 1:].sum(axis=1)
            by_words = [float(js_distances(counts[i], self.words[i : i + 1])[0]) for i in range(len(counts))]
            return list(zip(js_distances(char_histogram(text), self.chars).tolist(), by_words, strict=True))
        i = self.places[lang]
        bins = self.own[i]
        counts = np.bincount(np.fromiter((bins.get(w, 0) for w in folded), np.int64, len(folded)), minlength=OWN_WORDS + 1).astype(float)
        return [(float(js_distances(char_histogram(text), self.chars[i : i + 1])[0]), float(js_distances(counts, self.words[i : i + 1])[0]))]

    def __call__(self, text: str | None, lang: str | None) -> tuple:
        features = base_features(text)
        failed = base_failed(features[0], features[4])
        most = word_limit(features[0])
        pairs = self.distances(text, lang)

        def far(pair: tuple[float, float]) -> bool:
            return features[1] >= MIN_CHARS and pair[0] > MAX_CHAR_DISTANCE or features[0] >= MIN_COMMON_WORDS and pair[1] > most

        nearest = min(pairs, key=lambda p: (far(p), max(p[0] / MAX_CHAR_DISTANCE, p[1] / most)), default=(0.0, 0.0))
        return (*features, *nearest, failed, not failed and not (pairs and far(nearest)))


def apply_rules(docs: DataFrame, references: References | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns with the base features, both distances, base_failed and kept.

    A document is kept if it passes the base rules and lies near the reference of its own language, by character classes and by
    common words; texts shorter than a guard are not held against that distance. references: as from
    language_references(docs), the default. Null or empty text: no words, so base_failed. A text of a language without a
    reference is judged by the base rules alone (distances 0), one without a language must be near some reference. A language of
    few documents is its own measure. Texts of any length are read whole. A table without rows or languages gives no
    reference, and then only the base rules count. Repeated rows: each for itself. Empty tables: no rows.
    """
    references = language_references(docs) if references is None else references
    if "lang" not in docs.columns:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    return with_computed(docs, ["text", "lang"], keep, RULES, lambda: Judge(references))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
