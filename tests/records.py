"""Small variant tables: place, alleles, genes and genotypes of a trio or duo."""

TRIO = """
1 1200 A G QA1 0/1 0/1 1/1
1 1500 C T QA1 0/0 0/1 1/1
1 1900 G C QA1 ./. 0/1 1/1
1 2400 T A QA1,QB2 0/0 0/1 0/1
1 2700 A C QB2 0/1 0/0 0/1
1 3100 C G QB2 0/0 0/0 0/1
1 3300 G A QB2 1/1 0/1 0/1
1 3600 T G QB2 0/0 0/1 0/1
1 4000 A T QB2 1/1 0/0 1/1
10 510 T C QC3 0/1 0/0 0/1
10 650 G T QC3 0/0 0/0 0/1
10 720 A T QC3 0/1 0/0 0/1
10 800 C G QC3 ./. 0/0 0/1
X 90 CAT C QX4 0/0 0/1 1/1
MT 77 G A QM5 0/0 0/1 1/1
"""
TRIO_PED = "#Family\tSample\tFather\tMother\tSex\tPhenotype\n1\tproband\tfather\tmother\t1\t2\n1\tmother\t0\t0\t2\t1\n1\tfather\t0\t0\t1\t1\n"
TRIO_SAMPLES = ["father", "mother", "proband"]

DUO = """
1 100 A G QD1,QE2 0/0 0/1
1 180 C T QE2 0/1 0/1
1 260 G A QE2 0/1 0/1
1 330 T C QE2 0/0 0/1
1 410 A C QE2 0/1 0/1
10 40 A T QF3 0/1 0/1
10 75 G C QF3 0/0 0/1
10 96 T A QF3 0/0 0/1
10 130 C G QF3 0/1 0/1
X 30 TGA T QX4 0/1 1/1
MT 12 C A - 0/1 1/1
"""
DUO_PED = "1 proband 0 mother 1 2\n1 mother 0 0 2 1\n"
DUO_SAMPLES = ["mother", "proband"]

#: Models, partners (positions) and model score of the trio, by the rules: 2400 and 3600 come from the mother, 2700, 510 and 720 from the
#: father, 3100 and 650 from neither. A pair of two sides is a compound, one with a new variant a new compound; what one parent has both
#: of is no pair. 800 has an uncalled father, so that its pairs set nothing, but it is listed by those that have a model before.
TRIO_EXPECTED = {
    1200: ("AR_hom", "", 55), 1500: ("AR_hom_dn", "", 55), 1900: ("AR_hom|AR_hom_dn", "", 57),
    2400: ("AR_comp|AR_comp_dn", "2700 3100", 55), 2700: ("AR_comp|AR_comp_dn", "2400 3100 3600", 55), 3100: ("AD_dn|AR_comp_dn", "2400 2700 3600", 55),
    3300: (None, "", None), 3600: ("AR_comp|AR_comp_dn", "2700 3100", 55), 4000: (None, "", None),
    510: ("AR_comp_dn", "650 800", 55), 650: ("AD_dn|AR_comp_dn", "510 720 800", 55), 720: ("AR_comp_dn", "650 800", 55), 800: ("AD|AD_dn", "", 57),
    90: ("XR|XD", "", 55), 77: ("AR_hom_dn", "", 55),
}
#: The duo: 180, 260, 410, 40 and 130 come from the mother, the others that are heterozygous are new; each pair sets both compound models.
DUO_EXPECTED = {
    ("1", 100): ("AD_dn|AR_comp|AR_comp_dn", "180 260 330 410"), ("1", 180): ("AR_comp|AR_comp_dn", "100 330"), ("1", 260): ("AR_comp|AR_comp_dn", "100 330"),
    ("1", 330): ("AD_dn|AR_comp|AR_comp_dn", "100 180 260 410"), ("1", 410): ("AR_comp|AR_comp_dn", "100 330"),
    ("10", 40): ("AR_comp|AR_comp_dn", "75 96"), ("10", 75): ("AD_dn|AR_comp|AR_comp_dn", "40 96 130"), ("10", 96): ("AD_dn|AR_comp|AR_comp_dn", "40 75 130"), ("10", 130): ("AR_comp|AR_comp_dn", "75 96"),
    ("X", 30): ("XR|XD", ""), ("MT", 12): ("AR_hom|AR_hom_dn", ""),
}


def variant_file(table: str, samples: list[str]) -> str:
    """The table as a variant file."""
    lines = ["##fileformat=VCFv4.1", '##INFO=<ID=MQ,Number=1,Type=Float,Description="Mapping quality">', '##INFO=<ID=Annotation,Number=.,Type=String,Description="Genes">', "##contig=<ID=1,length=249250621>"]
    lines.append("#" + "\t".join(["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples]))
    for row in table.strip().splitlines():
        chrom, pos, ref, alt, genes, *gts = row.split()
        info = "MQ=1" + ("" if genes == "-" else f";Annotation={genes}")
        lines.append("\t".join([chrom, pos, ".", ref, alt, "100", "PASS", info, "GT:AD:GQ", *[g if g == "./." else f"{g}:10,10:60" for g in gts]]))
    return "\n".join(lines) + "\n"


def scored_rows() -> list[tuple]:
    """(pos, models, CADD, frequency, rank score) under the four-plugin rule file below; the score is frequency + harm + inheritance."""
    return [
        (1, "AD", 5.5, 0.004, 6.0), (2, "AD_dn", 12.0, None, 7.0), (3, None, 25.0, 0.02, -8.0), (4, "XR|XD_dn", None, 0.3, -9.0), (5, "AR_comp|AR_comp_dn", 31.5, 0.0, 10.0), (6, None, None, 0.7, -24.0),
        (7, "AR_hom_dn", 20.0, 0.01, 6.0), (8, "AR_hom|AD_dn", 9.99, 0.05, -8.0),
    ]


def four_plugins() -> str:
    """A rule file of frequency, significance, deleteriousness and inheritance; bounds -25 to 12."""
    models = "".join(f"  [[m{i}]]\n    priority = {p}\n    score = {p}\n    string = '{m}'\n" for i, (m, p) in enumerate((m + d, 2 if d else 3) for m in ("AD", "AR_hom", "AR_comp", "XR", "XD") for d in ("", "_dn")))
    rule = lambda name, **kw: f"  [[{name}]]\n" + "".join(f"    {k} = {v}\n" for k, v in kw.items())
    plugin = lambda name, kind, category, key, seps: f"[{name}]\n  field = INFO\n  data_type = {kind}\n  category = {category}\n  record_rule = max\n  separators = {seps}\n  info_key = {key}\n"
    return (
        "# rules\n[Version]\n  version = 0.1\n  name = four plugins\n[Categories]\n  [[frequency]]\n    category_aggregation = min # min, max or sum\n  [[harm]]\n    category_aggregation = max\n"
        "  [[inheritance]]\n    category_aggregation = max\n  [[significance]]\n    category_aggregation = max\n"
        + plugin("1000G", "float", "frequency", "1000GAF", "',',") + rule("not_reported", score=3) + rule("rare", score=2, lower=0, upper=0.01) + rule("some", score=1, lower=0.01, upper=0.05) + rule("common", score=-12, lower=0.05, upper=1.0)
        + plugin("CLNSIG", "integer", "significance", "CLNSIG", "'|',") + rule("not_reported", score=0) + rule("benign", score=-1, value=2) + rule("pathogenic", score=2, value=5)
        + plugin("CADD", "float", "harm", "CADD", "',',") + rule("not_reported", score=0) + rule("low", score=1, lower=0, upper=10) + rule("high", score=2, lower=10, upper=20) + rule("higher", score=3, lower=20, upper=30) + rule("highest", score=4, lower=30, upper=100)
        + plugin("GeneticModels", "string", "inheritance", "GeneticModels", "',',':','|'") + models + rule("not_reported", score=-12)
    )
