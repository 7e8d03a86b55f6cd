"""Rules as data, compiled to expressions over a row's facts: no join, and bad rules fail before Spark runs."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions.text import first_filled, numbers, show_number
from docsieve.operators.extract import Pack
from docsieve.schemas import HIT


@dataclass(frozen=True)
class Rule:
    rule_id: int
    rule_code: str
    rule_name: str
    risk_level: str
    match_mode: str
    config: dict
    suggestion: str
    rule_version: str = "1.0"
    rule_status: str = "active"


@dataclass(frozen=True)
class Wording:
    """Fixed texts of hits: they belong to the language of the rules."""

    expected_field: str
    at_most: str
    units: dict[str, str]
    path_joiner: str = ", "


#: Modes that the deterministic run leaves to others.
OTHER_MODES = ("future_llm", "llm_semantic")
#: Rules that are compiled into one plan, at most, and the keys that each mode's config must have.
MAX_RULES = 1000
NEEDED = {
    "field_missing": ("fields", "hit_message"), "numeric_threshold": ("field", "metric", "operator", "threshold", "hit_message"), "keyword": ("fields", "keywords", "hit_message"),
    "presence": ("fields", "keywords", "hit_message"), "llm_semantic": ("target_clause",),
}


def read_rules(table: DataFrame) -> list[Rule]:
    """Rules of a rule table, by id, read to the driver to be compiled: MAX_RULES at most; ``rule_tables`` takes any number.

    A rule whose ``match_text`` is no object, or lacks a key that its mode needs, is an error too.
    """
    found = table.orderBy("rule_id").limit(MAX_RULES + 1).collect()
    if len(found) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: apply them by rule_tables.table_hits")
    rules = [Rule(r["rule_id"], r["rule_code"], r["rule_name"], r["risk_level"], r["match_mode"], json.loads(r["match_text"]), r["suggestion_text"], r["rule_version"], r["rule_status"]) for r in found]
    for rule in rules:
        missing = [k for k in NEEDED.get(rule.match_mode, ()) if not isinstance(rule.config, dict) or k not in rule.config]
        if missing:
            raise ValueError(f"rule {rule.rule_code} has no {', '.join(missing)}")
    return rules


def _fact(pack: Pack, path: str) -> Column:
    if tuple(path.split(".")) not in pack.paths():
        raise ValueError(f"no such field path: {path}")
    return F.col(f"facts.{path}")


def paths_of(rules: Iterable[Rule]) -> set[str]:
    """The fact paths that the deterministic run of the rules reads."""
    own = [r.config for r in rules if r.rule_status == "active" and r.match_mode not in OTHER_MODES]
    return {p for c in own for p in [*c.get("fields", ()), *([c["field"]] if "field" in c else ())]}


def is_missing(fact: Column) -> Column:
    """not_found, failed, or without a value: an ambiguous fact is missing too."""
    return fact["extract_status"].isin("not_found", "failed") | (F.coalesce(fact["value"], F.lit("")) == "")


def _hit(rule: Rule, text: Column, position: Column, kind: str, actual: Column, expected: Column) -> Column:
    c, none = rule.config, F.lit(None)
    return F.struct(
        F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.rule_code).alias("rule_code"), F.lit(rule.rule_name).alias("rule_name"), F.lit(rule.risk_level).alias("risk_level"), F.lit(rule.rule_version).alias("rule_version"),
        text.alias("evidence_text"), position.alias("evidence_position"), F.lit(kind).alias("evidence_type"),
        (none if actual is None else actual).alias("actual_value"), (none if expected is None else expected).alias("expected_value"),
        F.lit(c["hit_message"]).alias("hit_message"), F.lit(rule.suggestion).alias("suggestion"),
    ).cast(HIT)


def _field_missing(rule: Rule, pack: Pack, words: Wording) -> Column:
    paths = rule.config["fields"]
    missing = F.filter(F.array(*[F.when(is_missing(_fact(pack, p)), F.lit(p)) for p in paths]), lambda x: x.isNotNull())
    enough = F.size(missing) > 0 if rule.config.get("trigger", "any") == "any" else F.size(missing) == len(paths)
    return F.when(enough, _hit(rule, F.lit(rule.config["hit_message"]), F.lit(None), "missing", F.array_join(missing, words.path_joiner), F.lit(words.expected_field)))


def _numeric_threshold(rule: Rule, pack: Pack, metrics: dict[str, str], words: Wording) -> Column:
    c, fact = rule.config, _fact(pack, rule.config["field"])
    if c["metric"] not in metrics:
        raise ValueError(f"no such metric: {c['metric']}")
    text = first_filled(fact["source_text"], fact["value"])
    most = F.array_max(numbers(text, metrics[c["metric"]]))
    limit = float(c["threshold"])
    if c.get("operator") != "gt":  # an error once there is a number to compare
        over = F.when(most.isNotNull() & ~is_missing(fact), F.raise_error(F.lit("numeric_threshold knows gt only")).cast("boolean"))
    else:
        over = ~is_missing(fact) & (most > limit)
    unit = words.units.get(c.get("unit", ""), "")
    shown = show_number(F.lit(limit))
    return F.when(over, _hit(rule, text, fact["position"], "derived", F.concat(show_number(most), F.lit(unit)), F.concat(F.lit(words.at_most), shown, F.lit(unit))))


def _keyword(rule: Rule, pack: Pack, _: Wording) -> Column:
    out = []
    for path in rule.config["fields"]:
        fact = _fact(pack, path)
        text = first_filled(fact["source_text"], fact["value"])
        word = F.coalesce(*[F.when(text.contains(k), F.lit(k)) for k in rule.config["keywords"]])
        out.append(F.when(~is_missing(fact) & word.isNotNull(), _hit(rule, text, fact["position"], "source", word, None)))
    return F.coalesce(*out)


def hits(rules: Iterable[Rule], pack: Pack, metrics: dict[str, str], words: Wording) -> Column:
    """The hits of all active rules on a row's facts, in the order of rule ids.

    Semantic and future modes are left out; an unknown mode, path or metric is an error.
    """
    found = []
    for rule in sorted(rules, key=lambda r: r.rule_id):
        if rule.rule_status != "active" or rule.match_mode in OTHER_MODES:
            continue
        if rule.match_mode == "field_missing":
            found.append(_field_missing(rule, pack, words))
        elif rule.match_mode == "numeric_threshold":
            found.append(_numeric_threshold(rule, pack, metrics, words))
        elif rule.match_mode in ("keyword", "presence"):
            found.append(_keyword(rule, pack, words))
        else:
            raise ValueError(f"no such match mode: {rule.match_mode}")
    return F.filter(F.array(*found), lambda h: h.isNotNull()) if found else F.array().cast(f"array<{HIT}>")
