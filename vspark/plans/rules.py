"""Rule files: parsed and checked on the driver, compiled into score columns."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import float_text, numbers_in, to_float, to_int
from ..functions.variant import consequences, has_info, info_value

FIELDS = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "sample_id")
TYPES = ("integer", "float", "flag", "character", "string")


class RuleError(ValueError):
    """A rule file that breaks the format."""


def _value(text: str) -> str | list[str]:
    """A value without its quotes and comment; a list if it has commas outside of quotes."""
    parts, part, quote, quoted, commas = [], "", "", False, False
    for c in text:
        if quote:
            if c == quote:
                quote = ""
            else:
                part += c
        elif c in "'\"":
            quote, quoted, part = c, True, part.strip()
        elif c == "#":
            break
        elif c == ",":
            parts.append(part if quoted else part.strip())
            part, quoted, commas = "", False, True
        elif not quoted or c.strip():
            part += c
    part = part if quoted else part.strip()
    if not commas:
        return part
    return parts + [part] * bool(part or quoted)


def parse_sections(text: str) -> dict:
    """Nested sections [a], [[b]] with key = value lines."""
    root: dict = {}
    stack = [root]
    for number, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        if m := re.match(r"(\[+)\s*(.*?)\s*(\]+)\s*(?:#.*)?$", line):
            depth = len(m[1])
            if depth != len(m[3]) or depth > len(stack):
                raise RuleError(f"line {number}: nesting of sections")
            del stack[depth:]
            stack.append(stack[-1].setdefault(m[2].strip("'\""), {}))
        elif "=" in line:
            key, _, value = line.partition("=")
            stack[-1][key.strip().strip("'\"")] = _value(value.strip())
        else:
            raise RuleError(f"line {number}: neither section nor value")
    return root


@dataclass
class ScoreFunction:
    """From a value to a whole score: by intervals, values, texts, presence, or the value itself."""

    match_type: str
    equal: bool = False
    intervals: list[tuple[float, float, float]] = field(default_factory=list)
    values: dict[str, float] = field(default_factory=dict)
    strings: dict[str, float] = field(default_factory=dict)
    reported: float = 0.0
    not_reported: float = 0.0

    def add_interval(self, lower: float, upper: float, score: float) -> None:
        if not lower < upper:
            raise RuleError(f"empty interval {lower}..{upper}")
        self.intervals.append((lower, upper, score))

    def add_value(self, value: object, score: float) -> None:
        self.values[str(value)] = score

    def add_string(self, text: str, score: float) -> None:
        self.strings[text.lower()] = score

    @property
    def mode(self) -> str:
        if self.equal:
            return "equal"
        found = [m for m, x in (("value", self.values), ("string", self.strings), ("tree", self.intervals), ("flag", self.reported)) if x]
        if len(found) > 1:
            raise RuleError(f"more than one kind of rule: {', '.join(found)}")
        if not found:
            raise NotImplementedError("no rule to score by")
        return found[0]

    def score_range(self) -> list[float]:
        """The scores that rules give, that for missing values included."""
        mode = self.mode
        if mode == "equal":
            raise RuleError("scores equal to values have no range")
        given = {"value": lambda: [float(x) for x in self.values.values()], "string": lambda: [float(x) for x in self.strings.values()], "tree": lambda: [s for *_, s in self.intervals], "flag": lambda: [self.reported]}
        return given[mode]() + [float(self.not_reported)]

    @property
    def score_min(self) -> float:
        return float(min(self.score_range()))

    @property
    def score_max(self) -> float:
        return float(max(self.score_range()))

    def column(self, value: Column) -> Column:
        """The score of a value (text, number, or boolean for flags) as long, cut toward zero.

        Missing, empty, 0 and false count as not reported; a value without a rule scores 0.
        """
        if self.match_type == "flag":
            missing, score = ~F.coalesce(value.cast("boolean"), F.lit(False)), F.lit(self.reported)
        elif self.match_type in ("string", "character", "char"):
            missing, score = value.isNull() | (value == ""), F.lit(0.0)
            for text, s in self.strings.items():
                score = F.when(F.lower(value) == text, F.lit(float(s))).otherwise(score)
            # Texts all in small or all in capital letters are found as they are.
            for text, s in self.strings.items():
                score = F.when(value.isin(text, *[text.upper()] * text.isascii()), F.lit(float(s))).otherwise(score)
        else:
            number = value.cast("double") if self.match_type == "float" else value.cast("long")
            missing = number.isNull() | (number == 0)
            if self.equal:
                score = number.cast("double")
            elif self.values:
                text, score = (float_text(number) if self.match_type == "float" else number.cast("string")), F.lit(0.0)
                for key, s in self.values.items():
                    score = F.when(text == key, F.lit(float(s))).otherwise(score)
            else:
                score = F.lit(0.0)
                for lower, upper, s in reversed(self.intervals):
                    score = F.when((number >= lower) & (number < upper), F.lit(float(s))).otherwise(score)
        return F.when(missing, F.lit(float(self.not_reported))).otherwise(score).cast("long")


@dataclass
class Plugin:
    """Where a value comes from, and how one is chosen of several."""

    name: str
    source: str
    data_type: str
    category: str
    separators: list[str] = field(default_factory=list)
    info_key: str | None = None
    csq_key: str | None = None
    record_rule: str = "max"
    priorities: dict[str, int] = field(default_factory=dict)
    family_level: bool = False

    @property
    def kind(self) -> str:
        """The type of the value's column."""
        return {"integer": "long", "float": "double", "flag": "boolean"}.get(self.data_type, "string")

    def column(self, csq_columns: Sequence[str] = ()) -> Column:
        """The value over variant columns: a number, a text, or for flags whether it is there."""
        info = F.col("info")
        if self.source == "INFO" and self.data_type == "flag":
            return has_info(info, self.info_key)
        if self.source == "INFO" and self.info_key == "CSQ":
            raw = F.transform(consequences(info, csq_columns), lambda e: e["fields"][self.csq_key])
            parts = F.flatten(F.transform(F.filter(raw, lambda x: x.isNotNull()), self._split))
        else:
            text = info_value(info, self.info_key) if self.source == "INFO" else F.col(self.source.lower()).cast("string")
            text = F.when(text != ".", text)
            parts = self._split(text)
            if self.data_type in ("integer", "float"):
                found = numbers_in(text, "".join(self.separators), self.data_type == "integer")
                if found is not None:
                    return (F.array_max if self.record_rule == "max" else F.array_min)(found)
        if self.data_type == "flag":
            return parts.isNotNull()
        pick = F.array_max if self.record_rule == "max" else F.array_min
        if self.data_type in ("integer", "float"):
            return pick(F.filter(F.transform(parts, to_float if self.data_type == "float" else to_int), lambda x: x.isNotNull()))
        if not self.priorities:
            return F.get(parts, F.lit(0))
        # The texts of the best place that are there, the first of them; parts by place, so that no function of single parts is needed.
        places = sorted(set(self.priorities.values()), reverse=self.record_rule == "max")
        texts = [F.array(*[F.lit(t) for t, p in self.priorities.items() if p == place]) for place in places]
        return F.coalesce(*[F.get(F.array_intersect(parts, t), F.lit(0)) for t in texts], F.get(parts, F.lit(0)))

    def _split(self, text: Column) -> Column:
        if not self.separators:
            return F.when(text.isNotNull(), F.array(text))
        # A single character is split by without a regular expression.
        either = "".join(re.escape(s) for s in self.separators)
        return F.split(text, either if len("".join(self.separators)) == 1 else f"[{either}]")


AGGREGATE = {"max": (lambda xs: F.greatest(*xs), max), "min": (lambda xs: F.least(*xs), min), "sum": (lambda xs: reduce(add, xs), sum)}


@dataclass
class RankModel:
    """A checked rule file."""

    name: str
    version: float
    categories: dict[str, str]
    plugins: dict[str, Plugin]
    functions: dict[str, ScoreFunction]

    def plugin_score(self, name: str, csq_columns: Sequence[str] = ()) -> Column:
        return self.functions[name].column(self.plugins[name].column(csq_columns))

    def members(self, category: str) -> list[str]:
        return [p.name for p in self.plugins.values() if p.category == category]

    def category_bounds(self, category: str) -> tuple[float, float]:
        """Least and highest score, each put together like the scores themselves."""
        names = self.members(category)
        if not names or self.categories[category] not in AGGREGATE:
            return 0.0, 0.0
        put = AGGREGATE[self.categories[category]][1]
        return float(put(self.functions[n].score_min for n in names)), float(put(self.functions[n].score_max for n in names))

    def category_score(self, category: str, csq_columns: Sequence[str] = (), strict: bool = True) -> Column:
        """The category's score as double; out of its bounds it is an error, or null if not strict."""
        if not self.scored(category):
            return F.lit(0.0)
        return self.put_together(category, [self.plugin_score(n, csq_columns) for n in self.members(category)], strict)

    def scored(self, category: str) -> bool:
        """Whether the category has plugins and a way to put their scores together."""
        return bool(self.members(category)) and self.categories[category] in AGGREGATE

    def put_together(self, category: str, scores: Sequence[Column], strict: bool = True) -> Column:
        """The category's score of those of its plugins."""
        scores = [s.cast("double") for s in scores]
        score = AGGREGATE[self.categories[category]][0](scores) if len(scores) > 1 else scores[0]
        low, high = self.category_bounds(category)

        def outside(s: Column) -> Column:
            return F.raise_error(F.concat(F.lit(f"score of {category} outside {low}..{high}: "), s.cast("string"))).cast("double") if strict else F.lit(None).cast("double")

        return F.when((score >= low) & (score <= high), score).otherwise(outside(score))

    def bounds(self) -> tuple[float, float]:
        each = [self.category_bounds(c) for c in self.categories]
        return float(sum(b[0] for b in each)), float(sum(b[1] for b in each))

    def rank_score(self, csq_columns: Sequence[str] = (), strict: bool = True) -> Column:
        return reduce(add, [self.category_score(c, csq_columns, strict) for c in self.categories], F.lit(0.0))

    def missing_keys(self, info_keys: Sequence[str], csq_columns: Sequence[str] = ()) -> list[str]:
        """Plugins whose INFO or CSQ key no header declares."""
        return [p.name for p in self.plugins.values() if p.source == "INFO" and (p.info_key not in info_keys or p.info_key == "CSQ" and p.csq_key not in csq_columns)]


def normalised(score: Column, low: Column | float, high: Column | float) -> Column:
    """(score - low) / (high - low); inverted bounds, equal bounds, or a result beyond 0..1 are errors."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    bad = F.raise_error(F.concat(F.lit("score can't be normalised: "), score.cast("string"))).cast("double")
    part = (score - low) / (high - low)
    return F.when(score.isNull(), F.lit(None).cast("double")).when(high >= low, F.when((part >= 0) & (part <= 1), part).otherwise(bad)).otherwise(bad)


def _plugin(name: str, section: dict) -> tuple[Plugin, ScoreFunction]:
    def need(key: str) -> str:
        if key not in section:
            raise RuleError(f"{name}: {key} is missing")
        return section[key]

    source = need("field")
    if source not in FIELDS:
        raise RuleError(f"{name}: field {source}")
    if source == "INFO" and need("info_key") == "CSQ" and not ("csq_key" in section or "vep_key" in section):
        raise RuleError(f"{name}: csq_key is missing")
    kind = need("data_type")
    if kind not in TYPES:
        raise RuleError(f"{name}: data_type {kind}")
    separators = section.get("separators", [])
    separators = list(separators) if isinstance(separators, str) and len(separators) == 1 else [separators] if isinstance(separators, str) else separators
    if kind != "flag" and not separators:
        raise RuleError(f"{name}: separators are missing")
    rule = section.get("record_rule", "max")
    if rule not in ("min", "max"):
        raise RuleError(f"{name}: record_rule {rule}")
    rules = {k: v for k, v in section.items() if isinstance(v, dict)}
    priorities = {}
    if kind == "string":
        for k, r in rules.items():
            if k == "not_reported":
                continue
            if "string" not in r or not re.fullmatch(r"\s*[+-]?[0-9]+\s*", str(r.get("priority", ""))):
                raise RuleError(f"{name}: {k} needs a string and a whole priority")
            priorities[r["string"]] = int(r["priority"])
        if not priorities:
            raise RuleError(f"{name}: no string rules")
    function = ScoreFunction(kind)
    for k, r in rules.items():
        if k == "not_reported":
            function.not_reported = float(r["score"])
        elif kind == "flag":
            function.reported = float(r["score"])
        elif kind == "string":
            function.add_string(r["string"], float(r["score"]))
        elif r["score"] == "eq":
            function.equal = True
        elif r.get("value"):
            function.add_value(r["value"], float(r["score"]))
        else:
            function.add_interval(float(r["lower"]), float(r["upper"]), float(r["score"]))
    category = need("category")
    plugin = Plugin(name, source, kind, category, separators, section.get("info_key"), section.get("csq_key", section.get("vep_key")), rule, priorities, str(section.get("family_level", "")).lower() == "true")
    return plugin, function


def parse_rank_model(text: str) -> RankModel:
    """The rank model of a rule file; RuleError where it breaks the format."""
    root = parse_sections(text)
    head = root.get("Version")
    if not isinstance(head, dict) or "name" not in head:
        raise RuleError("Version with a name and a version is missing")
    try:
        version = float(head["version"])
    except (KeyError, ValueError) as e:
        raise RuleError("version has to be a number") from e
    # An unknown or missing way to put scores together: the least one.
    categories = {c: v.get("category_aggregation", "min") for c, v in root.get("Categories", {}).items() if isinstance(v, dict)}
    model = RankModel(head["name"], version, categories, {}, {})
    for name, section in root.items():
        if name in ("Version", "Categories") or not isinstance(section, dict):
            continue
        plugin, function = _plugin(name, section)
        if plugin.category not in categories:
            raise RuleError(f"{name}: category {plugin.category} is not declared")
        model.plugins[name], model.functions[name] = plugin, function
    return model


def describe(model: RankModel) -> str:
    """A rank model in lines, for people."""
    lines = [f"{model.name} {model.version:g}"]
    for c, how in model.categories.items():
        lines.append(f"{c} ({how}): {', '.join(model.members(c))} {model.category_bounds(c)}")
    return "\n".join(lines)
