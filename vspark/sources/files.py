"""Variant, pedigree, region and lookup files as DataFrames, and back."""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import to_int, without_chr_letters
from ..operators.models import Family, Individual
from ..operators.sorting import line_text
from ..plans.checkpoint import shared_folder
from .header import Header, parse_header

PADDING = 4000
#: Name of the part that holds the header of a folder.
HEADER = "_header"
#: Bits of a row's number within its task, and most files of a folder that are ordered by name.
ROW_BITS, MAX_NAMED = 28, 256
#: Forms of pedigree files: six columns in this order, or columns by the names in a header line.
FORMS = ("ped", "alt", "cmms", "mip")


def _place(spark: SparkSession, path: str):
    """A path and its file system, whatever store it is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def spooled(spark: SparkSession, path: str) -> str:
    """path; '-' is the standard input, which goes through a file in the shared folder."""
    if path != "-":
        return path
    path = f"{shared_folder(spark)}/stdin-{uuid.uuid4().hex}.txt"
    where, store = _place(spark, path)
    out = store.create(where)
    while part := sys.stdin.read(1 << 20):
        out.write(bytearray(part.encode()))
    out.close()
    return path


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a file or folder of files, gzipped or not, with idx, rising in file order.

    Files of a folder are in order of the number in part-<number>, or of their names if they are MAX_NAMED at most. idx then holds
    the file's place, the place of the split in steps of 64 kB and the row in its task, of 2 ** ROW_BITS rows at most.
    """
    text = spark.read.text(path)
    names = sorted(text.inputFiles())
    if len(names) < 2:
        return text.select(F.monotonically_increasing_id().alias("idx"), "value")
    base = [n.rsplit("/", 1)[-1] for n in names]
    if all(re.match(r"part-[0-9]+", b) for b in base):
        file = F.regexp_extract("_metadata.file_name", "^part-([0-9]+)", 1).cast("long")
        most = max(int(re.match(r"part-([0-9]+)", b)[1]) for b in base)
    elif len(names) <= MAX_NAMED and len(set(base)) == len(base):
        file, most = F.array_position(F.array(*map(F.lit, base)), F.col("_metadata.file_name")) - 1, len(base)
    else:
        raise ValueError(f"the order of over {MAX_NAMED} files, or of files of one name, can't be told: {path}")
    bits = 63 - ROW_BITS - most.bit_length()
    row, split = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1), F.shiftright(F.col("_metadata.file_block_start"), 16)
    idx = F.shiftleft(file, bits + ROW_BITS) + F.shiftleft(split, ROW_BITS) + row
    fits = (split < F.lit(1 << bits)) & (row < F.lit(1 << ROW_BITS))
    return text.select(F.when(fits, idx).otherwise(F.raise_error(F.lit("a file or split is too large for the order of rows")).cast("long")).alias("idx"), "value")


def read_header(spark: SparkSession, path: str) -> Header:
    """The header of a variant file, from its first lines, or of a folder as write_variants() makes it, from its header part."""
    where, store = _place(spark, f"{path}/{HEADER}")
    if store.exists(where):
        path = where.toString()
    text, n = spark.read.text(path), 1_000
    names = sorted(text.inputFiles())
    text = spark.read.text(names[0]) if len(names) > 1 else text
    while True:
        found = [r[0] for r in text.select("value").head(n)]
        if len(found) < n or not found[-1].startswith("#"):
            return parse_header(found)
        n *= 8


def read_variants(spark: SparkSession, path: str) -> tuple[Header, DataFrame]:
    """Header, and idx, chrom, pos, id, ref, alt, qual, filter, info, format, samples. Values stay text, but pos. A folder that write_variants() made is read with its header."""
    path = spooled(spark, path)
    header = read_header(spark, path)
    return header, parse_variants(lines(spark, path), header)


def parse_variants(text: DataFrame, header: Header) -> DataFrame:
    """Records from lines (idx, value); blank lines and # lines are passed over. Row-wise: it also runs on streams."""
    sep = "\t" if len(header.columns) != 8 else r"\t"
    parts = F.split(F.rtrim(F.col("value")), sep)
    names = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")
    rows = text.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(*(["idx"] if "idx" in text.columns else []), parts.alias("p"))
    columns = [to_int(F.get("p", F.lit(i))).alias(n) if n == "pos" else F.get("p", F.lit(i)).alias(n) for i, n in enumerate(names)]
    return rows.select(*(["idx"] if "idx" in rows.columns else []), *columns, F.when(F.size("p") > 9, F.slice("p", 10, F.size("p"))).otherwise(F.array().cast("array<string>")).alias("samples"))


def write_variants(variants: DataFrame, header: Header, path: str, order: Sequence[Column] = ()) -> None:
    """A folder of text parts in order, and the header in a part of its own, which readers of text pass over and read_variants() reads."""
    spark = variants.sparkSession
    body = variants.orderBy(*order) if order else variants.orderBy("idx")
    body.select(line_text(body).alias("value")).write.mode("overwrite").text(path)
    spark.createDataFrame([("\n".join(header.lines()),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{HEADER}")


def exported_lines(variants: DataFrame, header: Header | None = None, priority: bool = False, order: Sequence[Column] = ()) -> Iterator[str]:
    """Lines for a single file, a partition at a time; with priority, the chromosome's place stands in front."""
    from ..functions.text import chromosome_priority

    if header:
        yield from header.lines()
    text = line_text(variants)
    rows = (variants.orderBy(*order) if order else variants).select((F.concat_ws("\t", chromosome_priority(F.col("chrom")), text) if priority else text).alias("value"))
    yield from (r[0] for r in rows.toLocalIterator())


def parse_regions(text: DataFrame, padding: int = PADDING) -> DataFrame:
    """chrom, start, stop, symbol from lines of an interval file. The start is padded, the stop is not, the mitochondrial chromosome is M and not padded; a missing symbol is the line's number."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = text.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select("idx", parts.alias("p"))
    chrom, start = without_chr_letters(F.col("p")[0]), to_int(F.col("p")[1])
    mito = chrom.isin("MT", "M")
    return rows.select(
        F.when(mito, F.lit("M")).otherwise(chrom).alias("chrom"), F.when(mito, start).otherwise(F.greatest(start - padding, F.lit(0))).alias("start"),
        to_int(F.col("p")[2]).alias("stop"), F.coalesce(F.get("p", F.lit(3)), F.col("idx").cast("string")).alias("symbol"),
    )


def read_regions(spark: SparkSession, path: str, padding: int = PADDING) -> DataFrame:
    return parse_regions(lines(spark, path), padding)


_MEMBER = {"family": ("familyid", "family"), "sample": ("sampleid", "sample", "individualid"), "father": ("father", "fatherid"), "mother": ("mother", "motherid"), "sex": ("sex",), "phenotype": ("phenotype",)}


def parse_pedigree(text: str, form: str = "ped") -> list[Family]:
    """Families in order from lines family, individual, father, mother, sex, phenotype; tabs or blanks between, 0 for unknown.

    form: one of FORMS. All but ped have these six among other columns, by the names in a line that starts with #.
    """
    if form not in FORMS:
        raise ValueError(f"unknown form of pedigree: {form}")
    families: dict[str, list[Individual]] = {}
    at = range(6) if form == "ped" else None
    for line in text.splitlines():
        p = line.rstrip().split("\t") if "\t" in line else line.split()
        if form != "ped" and line.startswith("#") and not line.startswith("##"):
            names = [re.sub("[^a-z]", "", x.lower()) for x in p]
            places = [next((names.index(x) for x in known if x in names), None) for known in _MEMBER.values()]
            if None in places:
                raise ValueError(f"columns are missing: {line}")
            at = places
        if line.strip() and not line.startswith("#"):
            if at is None:
                raise ValueError(f"a line with the names of the columns is needed: {line}")
            p = [p[i] for i in at if i < len(p)]
            if len(p) < 6:
                raise ValueError(f"six columns are needed: {line}")
            number = lambda x: int(x) if x.strip().lstrip("-").isdigit() else 0
            families.setdefault(p[0], []).append(Individual(p[1], p[2], p[3], number(p[4]), number(p[5])))
    out = [Family(f, tuple(ms)) for f, ms in families.items()]
    for f in out:
        names = {m.name for m in f}
        for m in f:
            if not {*m.parents} <= names:
                raise ValueError(f"a parent of {m.name} is not in family {f.name}")
    return out


def read_pedigree(spark: SparkSession, path: str, form: str = "ped") -> list[Family]:
    """Families of a pedigree file, which is a constant of the plan."""
    return parse_pedigree("\n".join(r[0] for r in lines(spark, path).orderBy("idx").select("value").toLocalIterator()), form)


def affected_families(families: Sequence[Family]) -> list[Family]:
    """Families with an affected member; ValueError if there is none."""
    kept = [f for f in families if f.has_affected]
    if not kept:
        raise ValueError("no family has an affected member")
    return kept


def check_members(families: Sequence[Family], samples: Sequence[str]) -> None:
    """OSError if a member is not among the samples."""
    missing = sorted({m.name for f in families for m in f} - set(samples))
    if missing:
        raise OSError(f"not in the variant file: {', '.join(missing)}")


def read_names(spark: SparkSession, path: str) -> list[str]:
    """The first word of each line that is no comment, e.g. genes of reduced penetrance."""
    words = lines(spark, path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+")[0])
    return [r[0] for r in words.distinct().toLocalIterator()]


def parse_frequencies(variants: DataFrame, af_key: str = "AF", max_key: str = "MAX_AF") -> DataFrame:
    """ord, chrom, pos, end, alts, af, max_af from variant records; end is INFO END or the last base of REF."""
    from ..functions.variant import info_value

    info = F.col("info")
    listed = lambda k: F.split(info_value(info, k), ",")
    end = F.coalesce(to_int(info_value(info, "END")), F.col("pos") + F.length("ref") - 1)
    return variants.select(F.col("idx").alias("ord"), F.regexp_replace("chrom", "^chr", "").alias("chrom"), "pos", end.alias("end"), F.split("alt", ",").alias("alts"), listed(af_key).alias("af"), listed(max_key).alias("max_af"))


def read_frequencies(spark: SparkSession, path: str, af_key: str = "AF", max_key: str = "MAX_AF") -> DataFrame:
    return parse_frequencies(read_variants(spark, path)[1], af_key, max_key)


def parse_scores(text: DataFrame, source: int = 0) -> DataFrame:
    """source, ord, chrom, pos, alt, raw, phred from lines chrom, pos, ref, alt, ..., raw, phred."""
    p = F.split(F.rtrim("value"), "\t")
    rows = text.filter(~F.col("value").startswith("#") & ~F.lower("value").startswith("chrom") & (F.trim("value") != ""))
    return rows.select(F.lit(source).alias("source"), F.col("idx").alias("ord"), F.regexp_replace(p[0], "^chr", "").alias("chrom"), to_int(p[1]).alias("pos"), p[3].alias("alt"), F.element_at(p, -2).alias("raw"), F.element_at(p, -1).alias("phred"))


def read_scores(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Deleteriousness scores of several files, the first file counting first."""
    tables = [parse_scores(lines(spark, p), k) for k, p in enumerate(paths)]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def read_splice_scores(spark: SparkSession, path: str) -> DataFrame:
    """ord, chrom, pos, alt, score from lines chrom, pos, ref, alt, ..., score in the sixth column."""
    p = F.split(F.rtrim("value"), "\t")
    rows = lines(spark, path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return rows.select(F.col("idx").alias("ord"), F.regexp_replace(p[0], "^chr", "").alias("chrom"), to_int(p[1]).alias("pos"), p[3].alias("alt"), p[5].try_cast("double").alias("score")).filter("pos is not null")


def write_lookup(table: DataFrame, path: str) -> None:
    """A lookup as Parquet, a folder a chromosome, sorted by place, so that scans skip by folder and row group."""
    table.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos").write.mode("overwrite").partitionBy("chrom").parquet(path)


def read_lookup(spark: SparkSession, path: str, chrom: str | None = None, start: int | None = None, stop: int | None = None) -> DataFrame:
    """A lookup that write_lookup() wrote, or its rows with start <= pos < stop: only the chromosome's folder is scanned, and of it the row groups that reach the places. Names with and without chr are tried."""
    table = spark.read.parquet(path).withColumn("chrom", F.col("chrom").cast("string"))
    if chrom is not None:
        table = table.filter(F.col("chrom").isin(chrom, chrom.removeprefix("chr"), f"chr{chrom}"))
    if start is not None:
        table = table.filter(F.col("pos") >= start)
    return table if stop is None else table.filter(F.col("pos") < stop)
