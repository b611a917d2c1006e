"""Genotypes of samples as columns one on another."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variant as V
from ..functions.text import apart


def with_genotypes(variants: DataFrame, samples: Mapping[str, Column], name: str = "calls") -> DataFrame:
    """variants with a struct of genotypes by name, as by functions.variant.sample_genotype of format and each sample.

    Texts, alleles and what follows from them are columns one on another, so that each is computed once, in generated code, and
    what nobody asks for is not computed at all.
    """
    names = list(samples)
    at = lambda part, i: f"__{part}{i}"
    rows = variants.withColumns({at("sample", i): samples[n] for i, n in enumerate(names)})
    rows = rows.withColumns({at(k, i): V.sample_field(F.col("format"), F.col(at("sample", i)), k) for i in range(len(names)) for k in V.CALL_FIELDS})
    rows = rows.withColumns({at("text", i): apart(V.call_text(F.col(at("GT", i))), "string") for i in range(len(names))})
    rows = rows.withColumns({at(k, i): f(F.col(at("text", i))) for i in range(len(names)) for k, f in (("a1", V.first_allele), ("a2", V.second_allele))})
    rows = rows.withColumns({at("depths", i): V.call_depths(F.col(at("AD", i))) for i in range(len(names))})
    rows = rows.withColumns({at(k, i): apart(c, "boolean") for i in range(len(names)) for k, c in V.allele_flags(*[F.col(at(k, i)) for k in ("text", "a1", "a2")]).items()})
    parts = ("text", "a1", "a2", "called", "reference", "same", "depths", "DP", "GQ", "PS")
    calls = [V.call(**{k.lower(): F.col(at(k, i)) for k in parts}).alias(n) for i, n in enumerate(names)]
    return rows.select(*[F.col(f"`{c}`") for c in variants.columns if c != name], F.struct(*calls).alias(name))
