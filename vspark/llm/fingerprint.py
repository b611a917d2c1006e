"""Operator 6: document fingerprints by a homomorphic multiset hash."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable, Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import with_computed
from .common import doc_key

#: Lanes of 32 bits, summed modulo 2 ** 32: hashed as a whole for equality, and from stretches of code points for likeness.
EXACT, LIKE = 32, 256
#: Code points of a stretch.
GRAM = 8
ROWS_A_PART = 2_000
MAX_PARTS = 100_000

_STEP = (np.arange(1, EXACT // 2 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None]
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _exact(paragraphs: Iterable[str]) -> np.ndarray:
    """Sum over paragraphs of EXACT lanes, expanded from 128 bits of BLAKE2b of each."""
    digests = b"".join([hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=16).digest() for p in paragraphs])
    halves = np.frombuffer(digests, "<u8").reshape(-1, 2)
    lanes = _mixed(halves[:, :1] + _mixed(halves[:, 1:] + _STEP))
    return np.ascontiguousarray(lanes).view(np.uint32).sum(axis=0, dtype=np.uint32)


def _like(paragraphs: str) -> np.ndarray:
    """Sum over paragraphs (joined by line feeds) of LIKE lanes.

    A paragraph's stretches of GRAM code points, and the shorter ones at its start, each add 1 or -1 to one lane. The nth
    occurrence of a stretch in its paragraph counts as an element of its own, so that inner products count what
    two texts share with its repeats, and a much repeated stretch weighs no more than as many others.
    """
    gap = "\0" * (GRAM - 1)
    codes = np.frombuffer((gap + paragraphs.replace("\n", "\n" + gap)).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < GRAM:
        return np.zeros(LIKE, np.uint32)
    h = _mixed(codes.astype(np.uint64) * _A)
    for k in (1, 2, 4):
        h = h[k:] * _A * np.uint64(2 * k + 1) + (h[:-k] ^ (h[:-k] >> np.uint64(32)))
    ends = codes[GRAM - 1 :]
    whole = (ends != 0) & (ends != 10)
    h = _mixed(h[whole])
    if not len(h):
        return np.zeros(LIKE, np.uint32)
    paragraph = np.cumsum(ends == 10, dtype=np.uint64)[whole]
    # The upper half is the stretch, the lower half the stretch in its paragraph.
    keys = (h & np.uint64(0xFFFFFFFF00000000)) | (((h + paragraph * _C) * _B) >> np.uint64(32))
    keys.sort()
    at = np.arange(len(keys))
    nth = at - np.maximum.accumulate(np.where(np.concatenate([[True], keys[1:] != keys[:-1]]), at, 0))
    lane = _mixed((keys >> np.uint64(32)) + nth.astype(np.uint64) * _A) >> np.uint64(55)
    found = np.bincount(lane.astype(np.int64), minlength=2 * LIKE)
    return (found[0::2] - found[1::2]).astype(np.int64).astype(np.uint32)


def lanes(text: str | None) -> np.ndarray:
    """The fingerprint of a text as lanes: the sum over its paragraphs (its lines, empty ones included) modulo 2 ** 32."""
    text = text or ""
    return np.concatenate([_exact(text.split("\n")), _like(text)])


def insert(fingerprint: np.ndarray, paragraph: str) -> np.ndarray:
    """The fingerprint of the multiset with one paragraph more."""
    return fingerprint + lanes(paragraph)


def delete(fingerprint: np.ndarray, paragraph: str) -> np.ndarray:
    """The fingerprint of the multiset with one paragraph less."""
    return fingerprint - lanes(paragraph)


def pack(fingerprint: np.ndarray) -> str:
    return base64.b64encode(fingerprint.astype("<u4").tobytes()).decode()


def unpack(packed: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(packed), "<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1, from two fingerprints alone: 1 if equal, else twice the inner product of the signed like lanes by the sum of their squares; its error is about 1 / sqrt(LIKE)."""
    if np.array_equal(a, b):
        return 1.0
    x, y = (v[EXACT:].astype(np.uint32).view(np.int32).astype(float) for v in (a, b))
    size = x @ x + y @ y
    return float(min(1.0, max(0.0, 2 * (x @ y) / size))) if size else 0.0


def with_next_text(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty), next_text: the text that follows by doc_id (null last, then by text; after the last row comes the first).

    Rows are dealt into ranges of doc_id that begin at ids of the table, of about ROWS_A_PART rows; the first row of
    a range is also sent to the range before as its last, so that each range finds its successors by itself:
    one shuffle of the texts. What comes to the driver is the first id of each range, MAX_PARTS at most. doc_id: a number or
    text; other types go by their text. Rows of one doc_id, or without one, are one range, which a window sorts and spills.
    """
    own, none = doc_key(docs)
    rows = docs.select("doc_id", own.alias("__own"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select(own.alias("__own")).filter("__own is not null")
    parts = max(1, min(MAX_PARTS, -(-ids.count() // ROWS_A_PART)))
    ranged = ids.repartitionByRange(parts, "__own").withColumn("__part", F.spark_partition_id())
    starts = sorted(r["start"] for r in ranged.groupBy("__part").agg(F.min("__own").alias("start")).collect())
    starts = starts or docs.sparkSession.range(1).select(none).first()[:1]
    table, n = F.from_json(F.lit(json.dumps(list(starts), default=str)), T.ArrayType(ids.schema["__own"].dataType)), len(starts)
    own = F.col("__own")
    # How many ranges begin at or before the row's id, by halving.
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    begun = F.aggregate(steps, F.lit(0), lambda low, s: F.when((low + s <= n) & (F.get(table, low + s - 1) <= own), low + s).otherwise(low))
    at = F.when(own.isNull(), n).otherwise(begun) - 1
    rows = rows.withColumn("__at", at)
    first = F.get(table, F.col("__at")) == own
    before = F.when(F.col("__at") > 0, F.col("__at") - 1).otherwise(n - 1)
    dealt = rows.select("doc_id", "__own", "text", F.posexplode(F.when(first, F.array("__at", before)).otherwise(F.array("__at"))).alias("__copy", "__range"))
    order = Window.partitionBy("__range").orderBy(F.col("__copy"), own.asc_nulls_last(), F.col("text"))
    dealt = dealt.withColumn("next_text", F.lead("text").over(order)).filter("__copy = 0")
    return dealt.select("doc_id", "text", F.coalesce("next_text", F.lit("")).alias("next_text"))


FINGERPRINTS = T.StructType(
    [T.StructField("n_chars", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    + [T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]
)


def fingerprint_texts(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The `keep` columns with fingerprint. Null text: as empty, the fingerprint of one empty paragraph. Equal texts, and equal multisets of lines, have equal fingerprints; repeated rows each by itself. Texts of any length are read whole. Empty tables: no rows. No shuffle."""
    return with_computed(docs, ["text"], keep, T.StructType([T.StructField("fingerprint", T.StringType())]), lambda: lambda text: (pack(lanes(text)),))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per document the fingerprints of its text and of its edited text, whose last floor(n_chars / 4) code points are the first as many of the next document.

    near_edited and near_next are likenesses taken from fingerprints alone. Null text: as empty. A table of one row: the next
    document is the row itself. Repeated and missing doc_ids: as in with_next_text(). Texts of any length are read whole. Empty
    tables: no rows. Columns other than doc_id and text are not read.
    """

    def make() -> Callable:
        def one(text: str, following: str) -> tuple:
            n = len(text)
            edited = text[: n - n // 4] + following[: n // 4]
            own, changed = lanes(text), lanes(edited)
            sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            return n, sha, pack(own), pack(changed), likeness(own, changed), likeness(own, lanes(following))

        return one

    return with_computed(with_next_text(docs), ["text", "next_text"], ["doc_id"], FINGERPRINTS, make)


def op6_fingerprint(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
