"""The header of a variant file, kept on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

FIXED = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO")
KINDS = ("FILTER", "FORMAT", "INFO", "contig", "ALT")
# Fixed values of the file format: the fields that an entry of a kind needs, and the types that values have.
NEEDED = {"FILTER": ("ID", "Description"), "FORMAT": ("ID", "Number", "Type", "Description"), "INFO": ("ID", "Number", "Type", "Description"), "contig": ("ID",), "ALT": ("ID", "Description")}
TYPES = {"INFO": ("Integer", "Float", "Flag", "Character", "String"), "FORMAT": ("Integer", "Float", "Character", "String")}


def entry_fields(text: str) -> dict[str, str] | None:
    """The fields of <key=value,key="value, with commas",...>; None if the text is of another form."""
    if not (text.startswith("<") and text.endswith(">")):
        return None
    fields: dict[str, str] = {}
    rest = text[1:-1]
    while rest:
        key, equals, rest = rest.partition("=")
        if not equals:
            return None
        if rest.startswith('"'):
            # A quote behind a backslash belongs to the value.
            end = 1
            while end < len(rest) and rest[end] != '"':
                end += 1 + (rest[end] == "\\")
            if end >= len(rest):
                return None
            value, rest = rest[1:end], rest[end + 1 :].lstrip()
            if rest and not rest.startswith(","):
                return None
            rest = rest[1:]
        else:
            value, _, rest = rest.partition(",")
        fields.setdefault(key.strip(), value)
    return fields


def checked_entry(kind: str, text: str) -> dict[str, str] | None:
    """The fields of an entry that has what its kind needs, else None."""
    fields = entry_fields(text)
    if fields is None or not all(fields.get(x) or x == "Description" and x in fields for x in NEEDED[kind]):
        return None
    if kind in TYPES:
        number = fields["Number"].strip()
        if fields["Type"].strip() not in TYPES[kind] or not (number in (".", "A", "G", "R") or number.lstrip("-").isdigit()):
            return None
    return fields


# The entries that each command declares (key, number, type, description).
ANNOTATION_ENTRIES = {
    "Annotation": ("Annotation", ".", "String", "Annotates what feature(s) this variant belongs to."),
    "EXACAF": ("EXACAF", "1", "Float", "Frequency in the ExAC database."),
    "EXAC_MAX_AF": ("EXAC_MAX_AF", "A", "Float", "Frequency in the ExAC database."),
    "1000GAF": ("1000GAF", "A", "Float", "Frequency in the 1000G database."),
    "1000G_MAX_AF": ("1000G_MAX_AF", "A", "Float", "Frequency in the 1000G database."),
    "SPIDEX": ("SPIDEX", "1", "Float", "Spidex score for this variant."),
    "CADD": ("CADD", "A", "Float", "The CADD relative score for this alternative."),
    "CADD_raw": ("CADD_raw", "A", "Float", "The CADD raw score(s) for this alternative(s)."),
    "COSMIC": ("COSMIC", "0", "Flag", "If variant is found in the COSMIC database."),
}
MODEL_ENTRIES = {
    "GeneticModels": ("GeneticModels", ".", "String", "':'-separated list of genetic models for this variant."),
    "ModelScore": ("ModelScore", ".", "String", "PHRED score for genotype models."),
    "Compounds": ("Compounds", ".", "String", "List of compound pairs for this variant.The list is splitted on ',' family id is separated with compoundswith ':'. Compounds are separated with '|'."),
}
SCORE_ENTRIES = {
    "RankScore": ("RankScore", ".", "String", "The rank score for this variant in this family. family_id:rank_score."),
    "RankScoreNormalized": ("RankScoreNormalized", ".", "String", "The normalized rank score in range(0, 1) for this variant in this family. family_id:rank_score."),
    "RankScoreMinMax": ("RankScoreMinMax", ".", "String", "The rank score MIN-MAX bounds. family_id:min:max."),
}
COMPOUND_ENTRIES = {"CompoundsNormalized": ("CompoundsNormalized", ".", "String", "Rank score as provided by compound analysis, based on RankScoreNormalized. family_id:rank_score")}


class HeaderError(SyntaxError):
    """A header line that breaks the format."""


@dataclass
class Header:
    """Header lines by kind and key; a key that is declared again keeps its place and takes the last line."""

    fileformat: str | None = None
    entries: dict[str, dict[str, str]] = field(default_factory=lambda: {k: {} for k in KINDS})
    other: dict[str, str] = field(default_factory=dict)
    columns: list[str] = field(default_factory=lambda: list(FIXED))
    csq_columns: list[str] = field(default_factory=list)

    @property
    def samples(self) -> list[str]:
        return self.columns[9:]

    def has(self, kind: str, key: str) -> bool:
        return key in self.entries[kind]

    def add_line(self, line: str) -> None:
        """A line that starts with ##."""
        line = line.rstrip()
        body, _, value = line[2:].partition("=")
        if not _:
            raise HeaderError(f"no key and value: {line}")
        if body == "fileformat":
            self.fileformat = line
        elif body in NEEDED:
            fields = checked_entry(body, value)
            if fields is None:
                raise HeaderError(f"{body} line of wrong form: {line}")
            self.entries[body][fields["ID"]] = line
            if body == "INFO" and fields["ID"] == "CSQ" and "Format:" in fields["Description"]:
                self.csq_columns = fields["Description"].split("Format:")[1].strip().split("|")
        else:
            self.other[body] = line

    def set_columns(self, line: str) -> None:
        """The line with the column names."""
        names = line.rstrip().lstrip("#").split("\t")
        self.columns = names if len(names) >= 9 else line.rstrip().lstrip("#").split()

    def add(self, kind: str, key: str, number: str = ".", type_: str = "String", description: str = "") -> None:
        if kind not in KINDS:
            raise HeaderError(f"unknown kind {kind}")
        inner = {"INFO": f"ID={key},Number={number},Type={type_},Description=\"{description}\"", "FORMAT": f"ID={key},Number={number},Type={type_},Description=\"{description}\"", "contig": f"ID={key}" + (f",length={number}" if number != "." else "")}
        self.entries[kind][key] = f"##{kind}=<{inner.get(kind, f'ID={key},Description=' + chr(34) + description + chr(34))}>"

    def add_info(self, *entries: tuple[str, str, str, str]) -> None:
        for key, number, type_, description in entries:
            self.add("INFO", key, number, type_, description)

    def add_software(self, name: str, version: str, command: str = "", date: str = "") -> None:
        """A line on what made the file, with the date if it is given."""
        stamp = f'Date="{date}",' * bool(date)
        self.other[f"Software:{name}"] = f'##Software=<ID={name},Version="{version}",{stamp}CommandLineOptions="{command}">'

    def lines(self) -> list[str]:
        if self.fileformat is None:
            raise HeaderError("fileformat is missing")
        out = [self.fileformat]
        for kind in KINDS:
            out += self.entries[kind].values()
        return out + list(self.other.values()) + ["#" + "\t".join(self.columns)]


def parse_header(lines) -> Header:
    header = Header()
    for line in lines:
        if line.startswith("##"):
            header.add_line(line)
        elif line.startswith("#"):
            header.set_columns(line)
        else:
            break
    return header
