"""The commands as plans: annotate, models, score, compound, filter, sort."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import annotation_chrom, float_text
from ..functions.variant import append_entries, features, gene_features, has_info, info_entry, variant_id
from ..operators import annotation, batches, compounds, models, scores
from ..operators.genotypes import with_genotypes
from ..operators.models import Family
from .rules import RankModel


def annotate(
    variants: DataFrame,
    regions: DataFrame | None = None,
    exac: DataFrame | None = None,
    thousand_g: DataFrame | None = None,
    splice: DataFrame | None = None,
    deleteriousness: DataFrame | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """variants with INFO entries for what is given, in this order: Annotation, EXACAF, EXAC_MAX_AF, 1000GAF, 1000G_MAX_AF, SPIDEX, CADD, CADD_raw, COSMIC."""
    keyed = variants.withColumn("chrom_key", annotation_chrom(F.col("chrom")))
    places = keyed.select("idx", "chrom_key", "pos", "alt")
    parts: list[tuple[DataFrame, dict[str, object]]] = []
    if regions is not None:
        parts.append((annotation.overlapping_regions(places, regions), {"Annotation": F.col("annotation")}))
    for table, key, most in ((exac, "EXACAF", "EXAC_MAX_AF"), (thousand_g, "1000GAF", "1000G_MAX_AF")):
        if table is not None:
            found = annotation.frequencies(places, table).select("idx", F.col("af").alias(key), F.col("max_af").alias(most))
            parts.append((found, {key: F.col(key), most: F.col(most)}))
    if splice is not None:
        parts.append((annotation.splice_scores(places, splice), {"SPIDEX": float_text(F.col("score"))}))
    if deleteriousness is not None:
        parts.append((annotation.score_lookup(places, deleteriousness, ["phred", "raw"]), {"CADD": F.col("phred"), "CADD_raw": F.col("raw")}))
    if known is not None:
        parts.append((annotation.known_sites(places, known).withColumn("COSMIC", F.lit(True)), {"COSMIC": None}))
    out, added = keyed, []
    for found, entries in parts:
        out = out.join(found, "idx", "left")
        added += [F.when(F.col("COSMIC"), info_entry(key)) if value is None else info_entry(key, value) for key, value in entries.items()]
    return out.withColumn("info", append_entries(F.col("info"), *added)).select(*variants.columns)


def with_calls(variants: DataFrame, samples: Sequence[str], members: Sequence[str]) -> DataFrame:
    """variants with calls: a struct of genotypes by member; only their samples are parsed."""
    return with_genotypes(variants, {m: F.get("samples", F.lit(samples.index(m))) for m in members})


def annotate_models(
    variants: DataFrame,
    samples: Sequence[str],
    families: Sequence[Family],
    key: str = "Annotation",
    csq_columns: Sequence[str] = (),
    phased: bool = False,
    strict: bool = False,
    whole_gene: bool = True,
    reduced_penetrance: Sequence[str] = (),
) -> DataFrame:
    """variants with Compounds, GeneticModels and ModelScore in info, where there are any.

    Features come from the INFO key, or from the CSQ entries if their columns are given. Single-variant models are plain columns,
    without a shuffle; batches and pairs are joins over the candidates only.
    """
    members = list(dict.fromkeys(m.name for f in families for m in f))
    genes = gene_features(F.col("info"), csq_columns) if csq_columns else features(F.col("info"), key)
    rows = variants.withColumn("features", genes).withColumn("variant_id", variant_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt"), F.col("info")))
    rows = with_calls(rows, samples, members)
    batched = batches.batched_once(rows)
    reduced = F.arrays_overlap("features", F.array(*[F.lit(g) for g in reduced_penetrance])) if reduced_penetrance else None
    info = F.col("info")
    listed, texts, model_scores = [], [], []
    for n, family in enumerate(families):
        calls = {m.name: F.col("calls")[m.name] for m in family}
        found = compounds.partners(compounds.pairs(batched, family, phased, strict))
        found = found.select("idx", F.col("AR_comp").alias(f"__c{n}"), F.col("AR_comp_dn").alias(f"__d{n}"), F.col("compounds").alias(f"__p{n}"))
        batched = batched.join(found, "idx", "left")
        flags = models.single_variant_models(F.col("chrom"), family, calls, strict, reduced)
        flags |= {"AR_comp": F.coalesce(f"__c{n}", F.lit(False)), "AR_comp_dn": F.coalesce(f"__d{n}", F.lit(False))}
        text = models.render_models(flags)
        entry = lambda t, family=family: F.when(t != "", F.concat(F.lit(f"{family.name}:"), t))
        texts.append(entry(text))
        score = models.model_score(calls.values())
        model_scores.append(F.when((text != "") & (score > 0), F.concat(F.lit(f"{family.name}:"), score.cast("string"))))
        listed.append(F.coalesce(f"__p{n}", F.array().cast("array<string>")))
    entries = []
    for name, value in (("Compounds", compounds.compound_text([f.name for f in families], listed)), ("GeneticModels", F.concat_ws(",", *texts)), ("ModelScore", F.concat_ws(",", *model_scores))):
        entries.append(F.when((value != "") & ~has_info(info, name), F.concat(F.lit(f"{name}="), value)))
    # Here a lone dot stays in front.
    return batched.withColumn("info", F.concat_ws(";", info, *entries)).select(*variants.columns)


def score(variants: DataFrame, model: RankModel, family: str = "1", csq_columns: Sequence[str] = (), details: bool = False) -> DataFrame:
    scored = scores.score_variants(variants, model, tuple(csq_columns))
    return scores.write_scores(scored, model, family, details).select(*variants.columns)


def compound(variants: DataFrame, csq_columns: Sequence[str] = (), threshold: float = scores.THRESHOLD, penalty: float = scores.PENALTY, one_sample: bool = False) -> DataFrame:
    genes = gene_features(F.col("info"), csq_columns) if csq_columns else features(F.col("info"))
    rows = variants.withColumn("features", genes).withColumn("variant_id", variant_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt"), F.col("info")))
    batched = batches.batched_once(rows)
    rescored = scores.compound_scores(batched, threshold, penalty, one_sample)
    return scores.write_compound_scores(batched.select(*variants.columns), rescored)


def chain(variants: DataFrame, *steps) -> DataFrame:
    """Steps, each from a DataFrame to a DataFrame, in turn."""
    return reduce(lambda df, step: step(df), steps, variants)
