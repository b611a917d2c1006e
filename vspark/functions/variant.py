"""Columns of a variant record: INFO entries, ids, genotypes, consequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, to_float, to_int

# The consequence terms that put a variant into a gene.
GENE_TERMS = (
    "transcript_ablation", "splice_donor_variant", "splice_acceptor_variant", "stop_gained", "start_lost", "frameshift_variant", "stop_lost",
    "initiator_codon_variant", "transcript_amplification", "inframe_insertion", "inframe_deletion", "protein_altering_variant", "missense_variant",
    "splice_region_variant", "incomplete_terminal_codon_variant", "stop_retained_variant", "synonymous_variant", "coding_sequence_variant",
    "mature_miRNA_variant", "5_prime_UTR_variant", "3_prime_UTR_variant", "non_coding_exon_variant", "non_coding_transcript_exon_variant",
    "nc_transcript_variant", "intron_variant", "NMD_transcript_variant", "non_coding_transcript_variant", "upstream_gene_variant", "downstream_gene_variant",
)


def _entries(info: Column) -> Column:
    return F.transform(F.split(info, ";"), lambda e: F.split(e, "="))


def info_value(info: Column, key: str) -> Column:
    """The value of an INFO key; the last entry counts if there are several. Null if it is missing, a flag, or not one key and one value."""
    # By plain searches for what precedes a value; a regular expression only where the key is a flag as well.
    entries = F.concat(F.lit(";"), info, F.lit(";"))
    value = F.substring_index(F.substring_index(entries, f";{key}=", -1), ";", 1)
    # The first part takes all it can, so that the last entry of the key is found.
    last = F.regexp_extract(info, rf"(?s)^(?:.*;)?\Q{key}\E(=[^;]*)?(?:;|$)", 1)
    mixed = F.when(last.rlike("(?s)^=[^=]*$"), F.substring(last, 2, 1 << 30))
    return F.when(entries.contains(f";{key}="), F.when(entries.contains(f";{key};"), mixed).when(~value.contains("="), value))


def has_info(info: Column, key: str) -> Column:
    """Whether INFO has the key, with a value or as a flag."""
    entries = F.concat(F.lit(";"), info, F.lit(";"))
    return F.coalesce(entries.contains(f";{key}=") | entries.contains(f";{key};"), F.lit(False))


def info_map(info: Column) -> Column:
    """INFO as a map, the last entry of a key counting; flags, and entries that are not one key and one value, map to null."""
    entries = _entries(info)
    keys = F.array_distinct(F.transform(entries, lambda e: e[0]))

    def value(key: Column) -> Column:
        last = F.element_at(F.filter(entries, lambda e: e[0] == key), -1)
        return F.when(F.size(last) == 2, last[1])

    return F.map_from_arrays(keys, F.transform(keys, value))


def info_entry(key: str, value: Column | None = None) -> Column:
    """key=value, or the key alone as a flag if value is empty or not given; null stays null, so that it adds nothing."""
    # The value stands here once, as it may be costly.
    return F.lit(key) if value is None else F.regexp_replace(F.concat(F.lit(f"{key}="), value), rf"^(\Q{key}\E)=\z", "$1")


def append_entries(info: Column, *entries: Column) -> Column:
    """INFO with the entries that are not null behind it; a lone dot gives way to them."""
    return F.coalesce(F.nullif(F.concat_ws(";", F.when(info != ".", info), *entries), F.lit("")), F.lit("."))


def append_info(info: Column, key: str, value: Column | None = None) -> Column:
    """INFO with an entry more; null or empty value: a flag. A lone dot gives way to it."""
    return append_entries(info, info_entry(key, None if value is None else F.coalesce(value, F.lit(""))))


def replace_info(info: Column, key: str, value: Column) -> Column:
    """INFO with each entry of the key set to value in its place; unchanged if there is none."""
    return F.array_join(F.transform(F.split(info, ";"), lambda e: F.when(F.split(e, "=")[0] == key, F.concat(F.lit(f"{key}="), value)).otherwise(e)), ";")


def variant_id(chrom: Column, pos: Column, ref: Column, alt: Column, info: Column | None = None) -> Column:
    """CHROM_POS_REF_ALT without the marks of symbolic alleles, to which END or else SVLEN is added."""
    base = F.concat_ws("_", chrom, pos.cast("string"), ref, F.translate(alt, "<>[]:", ""))
    if info is None:
        return base
    end, length = info_value(info, "END"), info_value(info, "SVLEN")
    suffix = F.when(end.isNotNull(), F.concat(F.lit("_END"), end)).when(length.isNotNull(), F.concat(F.lit("_SVLEN"), length)).otherwise(F.lit(""))
    return F.concat(base, F.when(alt.rlike(r"[<>\[\]:]"), suffix).otherwise(F.lit("")))


#: The FORMAT keys of a call.
CALL_FIELDS = ("GT", "AD", "DP", "GQ", "PS")


def sample_field(format_: Column, sample: Column, key: str) -> Column:
    """A sample's value of a FORMAT key; null if the key or the value is not there."""
    at = F.array_position(F.split(format_, ":"), F.lit(key)).cast("int")
    value = F.when(at > 0, F.get(F.split(sample, ":"), at - 1))
    # What stands first needs no list.
    return F.when((format_ == key) | format_.startswith(f"{key}:"), F.substring_index(sample, ":", 1)).otherwise(value)


def _given(value: Column | None) -> Column:
    return F.lit(None).cast("string") if value is None else F.when(value != "", value)


def call_text(gt: Column) -> Column:
    return F.coalesce(_given(gt), F.lit("./."))


def first_allele(text: Column) -> Column:
    return F.when(text.contains("|"), F.substring_index(text, "|", 1)).otherwise(F.substring_index(text, "/", 1))


def second_allele(text: Column) -> Column:
    second = lambda mark: F.substring_index(F.substring_index(text, mark, 2), mark, -1)
    return F.when(text.contains("|"), second("|")).when(text.contains("/"), second("/")).otherwise(".")


def call_depths(ad: Column | None) -> Column:
    return F.split(F.coalesce(_given(ad), F.lit(".,.")), ",")


def allele_flags(text: Column, a1: Column, a2: Column) -> dict[str, Column]:
    """called; reference: two alleles of 0 or .; same: two equal ones."""
    return {"called": ~text.isin("./.", ".|.", "."), "reference": a1.isin("0", ".") & a2.isin("0", "."), "same": a1 == a2}


def call(text: Column, a1: Column, a2: Column, called: Column, reference: Column, same: Column, depths: Column, dp: Column | None, gq: Column | None, ps: Column | None) -> Column:
    """The struct of a genotype from its parts, each a column that is taken several times."""
    depth = lambda d: F.when(d.rlike("^[0-9]+$"), d.cast("long")).otherwise(F.lit(0).cast("long"))
    reads = depth(F.get(depths, F.lit(0)))
    others = F.when(F.size(depths) < 3, depth(F.get(depths, F.lit(1)))).otherwise(F.aggregate(F.slice(depths, 2, F.size(depths)), F.lit(0).cast("long"), lambda m, d: m + depth(d)))
    return F.struct(
        text.alias("gt"), a1.alias("a1"), a2.alias("a2"), text.contains("|").alias("phased"), called.alias("genotyped"), (called & ~reference & ~same).alias("het"),
        (called & ~reference & same).alias("homo_alt"), (called & reference).alias("homo_ref"), (called & ~reference).alias("has_variant"),
        reads.alias("ref_depth"), others.alias("alt_depth"), (reads + others).alias("quality_depth"), F.coalesce(to_int(_given(dp)), F.lit(0)).cast("long").alias("dp"),
        F.coalesce(to_float(_given(gq)), F.lit(0.0)).alias("gq"), (F.lit(None).cast("string") if ps is None else ps).alias("ps"),
    )


def genotype(gt: Column, ad: Column | None = None, dp: Column | None = None, gq: Column | None = None, ps: Column | None = None) -> Column:
    """A genotype call as a struct, as one expression; operators.genotypes makes the same of columns one on another.

    Any call but ./., .|. and . is genotyped; two alleles of 0 or . are homozygous reference, two equal ones homozygous
    alternative, all else heterozygous, a single alternative allele included. Null or empty: not called.
    """
    null = F.lit(None).cast("string")
    fields = {"text": call_text(gt), "depths": call_depths(ad), "dp": null if dp is None else dp, "gq": null if gq is None else gq, "ps": null if ps is None else ps}

    def alleles(x: Column) -> Column:
        more = {"a1": first_allele(x["text"]), "a2": second_allele(x["text"])}
        return bind(F.struct(*[x[k].alias(k) for k in fields], *[c.alias(k) for k, c in more.items()]), lambda y: call(**{k: y[k] for k in (*fields, *more)}, **allele_flags(y["text"], y["a1"], y["a2"])))

    return bind(F.struct(*[c.alias(k) for k, c in fields.items()]), alleles)


def sample_genotype(format_: Column, sample: Column) -> Column:
    return genotype(*[sample_field(format_, sample, k) for k in CALL_FIELDS])


def features(info: Column, key: str = "Annotation") -> Column:
    """The set of features that an INFO key lists; empty if it is missing."""
    return F.coalesce(F.array_distinct(F.split(info_value(info, key), ",")), F.array().cast("array<string>"))


def consequences(info: Column, columns: Sequence[str], alt: Column | None = None) -> Column:
    """The CSQ entries as an array of (allele, map of columns); without an allele column they belong to the first alternative allele."""
    names = F.array(*[F.lit(c) for c in columns])
    first = F.split(alt, ",")[0] if alt is not None else F.lit(None).cast("string")

    def entry(text: Column) -> Column:
        values = F.split(text, r"\|")
        n = F.least(F.size(values), F.size(names))
        fields = F.map_from_arrays(F.slice(names, 1, n), F.slice(values, 1, n))
        return F.struct(F.coalesce(F.try_element_at(fields, F.lit("Allele")), first).alias("allele"), fields.alias("fields"))

    return F.coalesce(F.transform(F.split(info_value(info, "CSQ"), ","), entry), F.array().cast("array<struct<allele:string,fields:map<string,string>>>"))


def gene_features(info: Column, columns: Sequence[str], terms: Sequence[str] = GENE_TERMS) -> Column:
    """The set of genes of the CSQ entries with a consequence of `terms`; entries without a gene count as ''."""
    wanted = F.array(*[F.lit(t) for t in terms])
    hits = F.filter(consequences(info, columns), lambda e: F.coalesce(F.arrays_overlap(F.split(F.coalesce(e["fields"]["Consequence"], F.lit("")), "&"), wanted), F.lit(False)))
    return F.array_distinct(F.transform(hits, lambda e: F.coalesce(e["fields"]["Gene"], F.lit(""))))


def family_score(info: Column, family: str | None = None, key: str = "RankScore") -> Column:
    """The rank score of a family from entries family:score, or that of the last one; -100 if there is none."""
    if key not in ("RankScore", "RankScoreNormalized"):
        raise ValueError(f"unknown rank score: {key}")
    # Of repeated INFO keys the first counts here.
    first = F.regexp_extract(info, rf"(?:^|;)\Q{key}\E=([^;=]*)(?=;|$)", 1)
    if family is None:
        rank = F.get(F.split(F.substring_index(first, ",", -1), ":"), F.lit(1))
    elif "," in family or ":" in family:
        return F.lit(-100.0)
    else:
        # The first part takes all it can, so that the last entry of the family is found.
        rank = F.regexp_extract(first, rf"(?s)^(?:.*,)?\Q{family}\E(?::([^:,]*)[^,]*)?(?:,|\z)", 1)
    return F.coalesce(to_float(rank), F.lit(-100.0))
