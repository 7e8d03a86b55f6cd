"""Roll-up of a document's hits: overall risk, focus points, texts, fingerprints. All inside the row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions.once import stage
from docsieve.functions.text import set_fingerprint
from docsieve.schemas import RISK_WEIGHT


@dataclass(frozen=True)
class Phrases:
    """Templates of the summary and comment; {n}, {high}, {medium}, {low} are counts, {names} rule names."""

    no_hits: str
    summary: str
    names_joiner: str
    title: str
    levels: dict[str, str]
    nothing: str
    focus: str
    suggestions: str
    line: str = "{i}. {a}：{b}"
    advice: str = "{i}. {a}"


def weight(level: Column) -> Column:
    return F.when(level == "high", 3).when(level == "medium", 2).otherwise(1)


def ordered_hits(hits: Column) -> Column:
    """By risk (highest first), rule code, rule id."""
    keyed = F.transform(hits, lambda h: F.struct((-weight(h["risk_level"])).alias("w"), h["rule_code"].alias("c"), h["rule_id"].alias("i"), h.alias("h")))
    return F.transform(F.array_sort(keyed, lambda a, b: F.when(F.struct(a["w"], a["c"], a["i"]) < F.struct(b["w"], b["c"], b["i"]), -1).when(F.struct(a["w"], a["c"], a["i"]) > F.struct(b["w"], b["c"], b["i"]), 1).otherwise(0)), lambda k: k["h"])


def level_count(hits: Column, level: str) -> Column:
    return F.size(F.filter(hits, lambda h: h["risk_level"] == level))


def overall_risk(hits: Column) -> Column:
    """The gravest level; low without hits."""
    out = F.lit("low")
    for level in sorted(RISK_WEIGHT, key=RISK_WEIGHT.get):
        out = F.when(level_count(hits, level) > 0, level).otherwise(out)
    return out


def _fill(template: str, **values: Column) -> Column:
    parts, rest = [], template
    while "{" in rest:
        text, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(text), values[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def summary_text(hits: Column, words: Phrases) -> Column:
    """Counts by level and the names of the first three hits, which are in order already."""
    names = F.array_join(F.transform(F.slice(hits, 1, 3), lambda h: h["rule_name"]), words.names_joiner)
    filled = _fill(words.summary, n=F.size(hits), names=names, **{x: level_count(hits, x) for x in RISK_WEIGHT})
    return F.when(F.size(hits) == 0, words.no_hits).otherwise(filled)


def comment_text(hits: Column, risk: Column, summary: Column, words: Phrases) -> Column:
    name = F.coalesce(*[F.when(risk == k, F.lit(v)) for k, v in words.levels.items()])
    head = F.concat(_fill(words.title, level=name), F.lit("\n\n"), summary)
    lines = lambda template, a, b: F.array_join(F.transform(hits, lambda h, i: _fill(template, i=i + 1, a=h[a], b=h[b])), "\n")
    body = F.concat(head, F.lit(f"\n\n{words.focus}\n"), lines(words.line, "rule_name", "hit_message"), F.lit(f"\n\n{words.suggestions}\n"), lines(words.advice, "suggestion", "suggestion"))
    return F.when(F.size(hits) == 0, F.concat(head, F.lit("\n\n" + words.nothing))).otherwise(body)


def review(with_hits: DataFrame, words: Phrases) -> DataFrame:
    """``with_hits`` (a column ``hits``) plus the counts, overall risk, summary and comment; hits come in order."""
    staged = stage(with_hits, hits=ordered_hits(F.col("hits")))
    hits = F.col("hits")
    counts = {f"{x}_count": level_count(hits, x) for x in RISK_WEIGHT}
    staged = stage(staged, **counts, hit_count=F.size(hits), overall_risk_level=overall_risk(hits), summary_text=summary_text(hits, words))
    return staged.withColumn("comment_text", comment_text(hits, F.col("overall_risk_level"), F.col("summary_text"), words))


def rule_set_fingerprint(rules: DataFrame) -> DataFrame:
    """One row: the digest of the codes and versions of all active rules, semantic and future ones too."""
    part = F.concat_ws("@", "rule_code", "rule_version")
    return rules.filter("rule_status = 'active'").agg(set_fingerprint(F.collect_list(part)).alias("rule_set_fingerprint"))


def hit_set_fingerprint(hits: DataFrame, key: str, evaluations: DataFrame | None = None) -> DataFrame:
    """Per key: the digest of hit ids, rule ids and versions, and of evaluations where there are any.

    A null decision is written None.
    """
    own = hits.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("@", F.col("hit_id").cast("string"), F.col("rule_id").cast("string"), "rule_version"))), "\n").alias("h"))
    if evaluations is None:
        return own.select(key, F.sha2("h", 256).alias("rule_hit_fingerprint"))
    part = F.concat_ws("@", F.col("rule_id").cast("string"), "rule_version", "evaluation_fingerprint", "evaluation_status", F.coalesce("decision", F.lit("None")))
    more = evaluations.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(part)), "\n").alias("e"))
    text = F.when(F.col("e").isNull(), F.coalesce("h", F.lit(""))).otherwise(F.concat(F.coalesce("h", F.lit("")), F.lit("\n--semantic--\n"), "e"))
    return own.join(more, key, "full").select(key, F.sha2(text, 256).alias("rule_hit_fingerprint"))
