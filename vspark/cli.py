"""Six commands over variant files: annotate, models, score, compound, filter, sort. Results go to a folder of text parts, or with '-' to the standard output."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import chromosome_priority
from .functions.variant import family_score
from .operators.filters import filter_variants
from .operators.sorting import line_text
from .plans import commands
from .plans.rules import describe, parse_rank_model
from .sources import files
from .sources.header import ANNOTATION_ENTRIES, COMPOUND_ENTRIES, MODEL_ENTRIES, SCORE_ENTRIES, Header

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vspark", description=__doc__)
    p.add_argument("--version", action="version", version=VERSION)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("variants", help="variant file; - is the standard input")
        c.add_argument("-o", "--outfile", default="-")
        c.add_argument("-s", "--silent", action="store_true", help="write nothing to the standard output")
        return c

    c = command("annotate")
    c.add_argument("-r", "--regions")
    c.add_argument("--exac")
    c.add_argument("--thousand-g")
    c.add_argument("--spidex")
    c.add_argument("--cadd-file", action="append", default=[])
    c.add_argument("--cosmic", help="known sites; their header line is written")
    c.add_argument("--cosmic-entries", action="store_true", help="mark the variants at known sites too")
    c = command("models")
    c.add_argument("-f", "--family-file", required=True)
    c.add_argument("-t", "--family-type", choices=files.FORMS, default="ped", help="form of the family file")
    c.add_argument("--vep", action="store_true")
    c.add_argument("--phased", action="store_true")
    c.add_argument("--strict", action="store_true")
    c.add_argument("-k", "--keyword", default="Annotation")
    c.add_argument("-r", "--reduced-penetrance")
    c = command("score")
    c.add_argument("-c", "--score-config", required=True)
    c.add_argument("-i", "--family-id", default="1")
    c.add_argument("-f", "--family-file")
    c.add_argument("-r", "--rank-results", action="store_true")
    c.add_argument("--skip-plugin-check", action="store_true")
    c = command("compound")
    c.add_argument("--vep", action="store_true")
    c.add_argument("--threshold", type=float, default=9.0)
    c.add_argument("--penalty", type=float, default=6.0)
    c = command("filter")
    c.add_argument("-a", "--annotation", default="1000GAF")
    c.add_argument("-t", "--threshold", type=float, default=0.05)
    c.add_argument("-d", "--discard", action="store_true")
    c.add_argument("-g", "--greater", action="store_true")
    c = command("sort")
    c.add_argument("-p", "--position", action="store_true")
    c.add_argument("-f", "--family-id", help="accepted for compatibility; the last family's score counts")
    c.add_argument("--rank-score-type", default="RankScore", choices=("RankScore", "RankScoreNormalized"))
    c = sub.add_parser("config", help="show a rule file")
    c.add_argument("score_config")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> tuple[Header, DataFrame, list]:
    """Header, records and order of a command's result."""
    header, rows = files.read_variants(spark, args.variants)
    csq = header.csq_columns if getattr(args, "vep", False) else []
    order: list = [F.col("idx")]
    if args.command == "annotate":
        tables = {
            "regions": files.read_regions(spark, args.regions) if args.regions else None,
            "exac": files.read_frequencies(spark, args.exac) if args.exac else None,
            "thousand_g": files.read_frequencies(spark, args.thousand_g) if args.thousand_g else None,
            "splice": files.read_splice_scores(spark, args.spidex) if args.spidex else None,
            "deleteriousness": files.read_scores(spark, args.cadd_file) if args.cadd_file else None,
            "known": files.read_variants(spark, args.cosmic)[1].select(F.regexp_replace("chrom", "^chr", "").alias("chrom"), "pos", F.explode(F.split("alt", ",")).alias("alt")) if args.cosmic else None,
        }
        keys = {"regions": ("Annotation",), "exac": ("EXACAF", "EXAC_MAX_AF"), "thousand_g": ("1000GAF", "1000G_MAX_AF"), "splice": ("SPIDEX",), "deleteriousness": ("CADD", "CADD_raw"), "known": ("COSMIC",)}
        header.add_info(*[ANNOTATION_ENTRIES[k] for t, ks in keys.items() if tables[t] is not None for k in ks])
        if not args.cosmic_entries:
            tables["known"] = None
        rows = commands.annotate(rows, **tables)
    elif args.command == "models":
        if header.has("INFO", "GeneticModels"):
            raise ValueError("the variants already have genetic models")
        families = files.affected_families(files.read_pedigree(spark, args.family_file, args.family_type))
        files.check_members(families, header.samples)
        genes = files.read_names(spark, args.reduced_penetrance) if args.reduced_penetrance else ()
        rows = commands.annotate_models(rows, header.samples, families, args.keyword, csq, args.phased, args.strict, reduced_penetrance=genes)
        header.add_info(*MODEL_ENTRIES.values())
    elif args.command == "score":
        if header.has("INFO", "RankScore"):
            raise ValueError("the variants already have rank scores")
        model = parse_rank_model(_read(spark, args.score_config))
        missing = model.missing_keys(list(header.entries["INFO"]), header.csq_columns)
        if missing and not args.skip_plugin_check:
            raise ValueError(f"not declared in the header: {', '.join(missing)}")
        family = files.read_pedigree(spark, args.family_file)[0].name if args.family_file else args.family_id
        rows = commands.score(rows, model, family, header.csq_columns, args.rank_results)
        header.add_info(*SCORE_ENTRIES.values())
        if args.rank_results:
            header.add_info(("RankResult", ".", "String", "|".join(model.categories)))
    elif args.command == "compound":
        rows = commands.compound(rows, csq, args.threshold, args.penalty, len(header.samples) == 1)
        header.add_info(*COMPOUND_ENTRIES.values())
    elif args.command == "filter":
        rows = filter_variants(rows, args.annotation, args.threshold, args.greater, args.discard, list(header.entries["INFO"]))
    elif args.command == "sort":
        if args.position:
            order = [chromosome_priority(F.col("chrom")).try_cast("int"), F.col("pos"), F.col("idx")]
        else:
            order = [family_score(F.col("info"), None, args.rank_score_type).desc(), line_text(rows).desc()]
    header.add_software(f"vspark_{args.command}", VERSION, " ".join(f"{k}={v}" for k, v in sorted(vars(args).items()) if v not in (None, False, [])), datetime.now().isoformat(timespec="minutes"))
    return header, rows, order


def _read(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in files.lines(spark, path).orderBy("idx").select("value").toLocalIterator())


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"vspark {args.command}").getOrCreate()
    try:
        if args.command == "config":
            print(describe(parse_rank_model(_read(spark, args.score_config))))
            return 0
        header, rows, order = run(spark, args)
        if args.outfile != "-":
            files.write_variants(rows, header, args.outfile, order)
        elif not args.silent:
            for line in files.exported_lines(rows, header, order=order):
                print(line)
    except (ValueError, OSError, SyntaxError) as e:
        print(f"vspark {args.command}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
