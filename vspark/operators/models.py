"""Inheritance models: for all members of a family, compiled from the pedigree into plain columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MODELS = ("XR", "XR_dn", "XD", "XD_dn", "AD", "AD_dn", "AR_hom", "AR_hom_dn", "AR_comp", "AR_comp_dn")
MALE, FEMALE = 1, 2


@dataclass(frozen=True)
class Individual:
    """A member of a family; '0' stands for an unknown parent. sex: 1 male, 2 female; phenotype: 1 healthy, 2 affected."""

    name: str
    father: str = "0"
    mother: str = "0"
    sex: int = 0
    phenotype: int = 0

    @property
    def healthy(self) -> bool:
        return self.phenotype == 1

    @property
    def affected(self) -> bool:
        return self.phenotype == 2

    @property
    def parents(self) -> list[str]:
        return [p for p in (self.mother, self.father) if p != "0"]


@dataclass(frozen=True)
class Family:
    name: str
    members: tuple[Individual, ...]

    def __iter__(self):
        return iter(self.members)

    def __getitem__(self, name: str) -> Individual:
        return next(m for m in self.members if m.name == name)

    @property
    def has_affected(self) -> bool:
        return any(m.affected for m in self.members)


#: Genotypes by individual: struct columns as made by functions.variant.genotype.
Calls = Mapping[str, Column]


def _all(terms: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def _any(terms: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, terms, F.lit(False))


def _for_all(family: Family, calls: Calls, strict: bool, rule: Callable[[Individual, Column], list[Column]]) -> Column:
    terms = []
    for m in family:
        g = calls[m.name]
        terms += [g["genotyped"]] * strict + rule(m, g)
    return _all(terms)


def _when_called(g: Column, then: Column) -> Column:
    return ~g["genotyped"] | then


def dominant(family: Family, calls: Calls, strict: bool = False, reduced_penetrance: Column | None = None) -> Column:
    """Affected are heterozygous, healthy have no variant; with reduced penetrance healthy are just not homozygous for it."""
    reduced = F.lit(False) if reduced_penetrance is None else reduced_penetrance

    def rule(m: Individual, g: Column) -> list[Column]:
        return ([~F.when(reduced, g["homo_alt"]).otherwise(g["has_variant"])] if m.healthy else []) + ([_when_called(g, g["het"])] if m.affected else [])

    return _for_all(family, calls, strict, rule)


def recessive(family: Family, calls: Calls, strict: bool = False) -> Column:
    """Affected are homozygous for the variant, healthy are not."""
    return _for_all(family, calls, strict, lambda m, g: ([~g["homo_alt"]] if m.healthy else []) + ([_when_called(g, g["homo_alt"])] if m.affected else []))


def x_recessive(family: Family, calls: Calls, strict: bool = False) -> Column:
    """Affected have the variant, females on both chromosomes; healthy males do not have it, healthy females not on both."""

    def rule(m: Individual, g: Column) -> list[Column]:
        if m.healthy:
            return [_when_called(g, ~g["homo_alt"] & (~g["has_variant"] if m.sex == MALE else F.lit(True)))]
        return [_when_called(g, ~g["homo_ref"] & (g["homo_alt"] if m.sex == FEMALE else F.lit(True)))] if m.affected else []

    return _for_all(family, calls, strict, rule)


def x_dominant(family: Family, calls: Calls, strict: bool = False) -> Column:
    """Affected have the variant; healthy males do not have it, healthy females not on both chromosomes."""

    def rule(m: Individual, g: Column) -> list[Column]:
        if m.healthy:
            return [_when_called(g, {MALE: ~g["has_variant"], FEMALE: ~g["homo_alt"]}.get(m.sex, F.lit(True)))]
        return [_when_called(g, ~g["homo_ref"])] if m.affected else []

    return _for_all(family, calls, strict, rule)


def _de_novo(kind: str, family: Family, calls: Calls, strict: bool) -> tuple[Column, Column]:
    """(a de novo form holds, the inherited form does not any more), over all members with a known parent; flags are only ever set, so that members' order doesn't matter."""
    new, gone = [], []
    for m in family:
        if not m.parents:
            continue
        mother = calls[m.mother] if m.mother != "0" else None
        father = calls[m.father] if m.father != "0" else None
        if kind.startswith("X_") and m.sex == MALE:
            # A son's X is his mother's.
            if mother is not None:
                new.append(~mother["has_variant"])
                gone.append(~mother["has_variant"] & mother["genotyped"])
            elif kind == "X_recessive" and not strict:
                new.append(F.lit(True))
            continue
        if kind.startswith("X_") and m.sex != FEMALE:
            continue
        if mother is not None and father is not None:
            carried = (mother["has_variant"] & father["has_variant"]) if kind.endswith("recessive") else (mother["has_variant"] | father["has_variant"])
            new.append(~carried)
            gone.append(~carried & mother["genotyped"] & father["genotyped"])
        elif kind == "dominant":
            known = mother if mother is not None else father
            new.append(~known["has_variant"])
            gone.append(~known["has_variant"])
        elif not strict:
            new.append(F.lit(True))
    return _any(new), _any(gone)


def single_variant_models(chrom: Column, family: Family, calls: Calls, strict: bool = False, reduced_penetrance: Column | None = None) -> dict[str, Column]:
    """Columns of the models that a variant follows by itself: X-linked ones on X, the others elsewhere."""
    on_x = chrom.isin("X", "chrX")
    out = {}
    for name, kind, base, where in (
        ("XR", "X_recessive", x_recessive(family, calls, strict), on_x), ("XD", "X_dominant", x_dominant(family, calls, strict), on_x),
        ("AD", "dominant", dominant(family, calls, strict, reduced_penetrance), ~on_x), ("AR_hom", "recessive", recessive(family, calls, strict), ~on_x),
    ):
        new, gone = _de_novo(kind, family, calls, strict)
        out[name] = where & base & ~gone
        out[f"{name}_dn"] = where & base & new
    return out


def compound_candidate(family: Family, calls: Calls) -> Column:
    """Nobody is homozygous for it, affected are heterozygous, and no two healthy parents of an affected both have it."""
    terms = []
    for m in family:
        g = calls[m.name]
        terms.append(~g["homo_alt"])
        if m.affected:
            terms.append(g["het"])
            if len(m.parents) == 2 and family[m.mother].healthy and family[m.father].healthy:
                terms.append(~(calls[m.mother]["has_variant"] & calls[m.father]["has_variant"]))
    return _all(terms)


def same_allele(a: Column, b: Column) -> Column:
    """Two calls of one phase set with an allele in the same place."""
    return F.coalesce(a["ps"] == b["ps"], F.lit(False)) & ((a["a1"] == b["a1"]) | (a["a2"] == b["a2"]))


def compound_pair(family: Family, one: Calls, two: Calls, phased: bool = False) -> Column:
    """Whether two candidate variants can be a pair: no healthy parent has both, no healthy member is heterozygous for both, and, if phased, no affected has both on one allele."""
    terms = []
    for m in family:
        for p in m.parents:
            if family[p].healthy:
                terms.append(~(one[p]["has_variant"] & two[p]["has_variant"]))
        a, b = one[m.name], two[m.name]
        if m.healthy:
            terms.append(~(a["het"] & b["het"]))
        if m.affected and phased:
            terms.append(~same_allele(a, b))
    return _all(terms)


def compound_flags(family: Family, one: Calls, two: Calls, strict: bool = False) -> tuple[Column, Column]:
    """(AR_comp, AR_comp_dn) that a pair sets on both of its variants, by what the parents carry."""
    comp, new = [], []
    with_parents = [m for m in family if m.parents]
    if not with_parents:
        return F.lit(True), F.lit(False)
    for m in with_parents:
        if len(m.parents) == 2:
            mo1, mo2, fa1, fa2 = one[m.mother], two[m.mother], one[m.father], two[m.father]
            called = mo1["genotyped"] & mo2["genotyped"] & fa1["genotyped"] & fa2["genotyped"]
            both = (mo1["has_variant"] | mo2["has_variant"]) & (fa1["has_variant"] | fa2["has_variant"])
            comp.append(called & both)
            new.append(called & ~both)
        elif not strict:
            comp.append(F.lit(True))
            new.append(F.lit(True))
    return _any(comp), _any(new)


def model_score(calls: Iterable[Column]) -> Column:
    """Phred-scaled chance that some called genotype is wrong, by the qualities above 0, at most 99 each, as long; 0 if there is none."""
    right, some = F.lit(1.0), F.lit(False)
    for g in calls:
        quality = F.least(g["gq"], F.lit(99.0))
        right = right * F.when(g["gq"] > 0, 1 - F.pow(F.lit(10.0), -(quality / 10))).otherwise(F.lit(1.0))
        some = some | (g["gq"] > 0)
    return F.when(some, F.bround(-10 * F.log10(1 - right), 0)).otherwise(F.lit(0.0)).cast("long")


def render_models(flags: Mapping[str, Column]) -> Column:
    """The models that hold, in their fixed order, joined by |; '' if none does."""
    return F.concat_ws("|", *[F.when(flags[m], F.lit(m)) for m in MODELS if m in flags])
