"""Rules applied as a table, however many there are: every mode is a join of facts with rules.

``operators.rules`` compiles rules into expressions, which is best for the rules of one review; here rules stay rows,
so their number is bounded by nothing. Keywords go through the containment index: a text meets only the keywords
whose rarest gram it has, not all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions.text import first_filled, numbers, show_number
from docsieve.operators.containment import contained
from docsieve.operators.rules import OTHER_MODES, Wording, is_missing
from docsieve.sources.shared import saved

#: The keys of a rule's configuration, and rows of rules that are broadcast at most; more meet salted facts.
CONFIG = "fields array<string>, trigger string, field string, metric string, operator string, threshold double, unit string, keywords array<string>, hit_message string"
BROADCAST_ROWS = 100_000


def parsed(rules: DataFrame) -> DataFrame:
    """Active deterministic rules with their configuration ``c``. Text that is no JSON, an unknown mode, and a
    configuration that lacks what its mode needs are errors, as where rules are compiled."""
    own = rules.filter((F.col("rule_status") == "active") & ~F.col("match_mode").isin(*OTHER_MODES))
    c = F.from_json("match_text", CONFIG, {"mode": "FAILFAST"})
    mode, has = F.col("match_mode"), lambda *names: F.forall(F.array(*[F.col(f"c.{n}").isNotNull() for n in names]), lambda x: x)
    good = (
        F.when(mode == "field_missing", has("fields", "hit_message")).when(mode == "numeric_threshold", has("field", "metric", "operator", "threshold", "hit_message") & (F.col("c.operator") == "gt"))
        .when(mode.isin("keyword", "presence"), has("fields", "keywords", "hit_message")).otherwise(F.lit(False))
    )
    said = F.raise_error(F.concat(F.lit("rule "), F.col("rule_code"), F.lit(" cannot be applied"))).cast("boolean")
    return own.withColumn("c", c).filter(F.when(good, F.lit(True)).otherwise(said))


def _met(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Facts with the rules of their path. Paths are few, so rules are broadcast, or facts are salted."""
    if rules.count() <= BROADCAST_ROWS:
        return facts.join(F.broadcast(rules), "path")
    salts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = rules.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return facts.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).join(many, ["path", "_salt"]).drop("_salt")


def _hit(kind: str, text: Column, position: Column, actual: Column, expected: Column, key: str) -> list[Column]:
    return [F.col(key), F.col("rule_id"), F.lit(kind).alias("evidence_type"), text.alias("evidence_text"), position.alias("evidence_position"), actual.alias("actual_value"), expected.alias("expected_value")]


def _missing(facts: DataFrame, rules: DataFrame, key: str, words: Wording) -> DataFrame:
    own = rules.filter("match_mode = 'field_missing'").select("rule_id", F.posexplode("c.fields").alias("place", "path"))
    found = _met(facts.filter(is_missing(F.struct("extract_status", "value"))).select(key, "path"), own)
    listed = found.groupBy(key, "rule_id").agg(F.array_sort(F.collect_list(F.struct("place", "path"))).alias("m"))
    met = listed.join(rules.select("rule_id", "c"), "rule_id")
    enough = (F.coalesce("c.trigger", F.lit("any")) == "any") | (F.size("m") == F.size("c.fields"))
    none = F.lit(None).cast(facts.schema["position"].dataType)
    return met.filter(enough).select(*_hit("missing", F.col("c.hit_message"), none, F.array_join(F.transform("m", lambda x: x["path"]), words.path_joiner), F.lit(words.expected_field), key))


def _over(facts: DataFrame, rules: DataFrame, key: str, metrics: dict[str, str], words: Wording) -> DataFrame:
    own = rules.filter("match_mode = 'numeric_threshold'").select("rule_id", F.col("c.field").alias("path"), F.col("c.metric").alias("metric"), F.col("c.threshold").alias("threshold"), F.coalesce("c.unit", F.lit("")).alias("unit"))
    known = F.col("metric").isin(*metrics)
    own = own.filter(F.when(known, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no such metric: "), F.col("metric"))).cast("boolean")))
    found = facts.filter(~is_missing(F.struct("extract_status", "value")) & F.col("path").isNotNull())
    most = F.explode(F.array(*[F.struct(F.lit(m).alias("name"), F.array_max(numbers(F.col("text"), p)).alias("most")) for m, p in metrics.items()])).alias("x")
    found = found.select(key, "path", "text", "position", most).filter("x.most is not null")
    met = _met(found, own).filter((F.col("x.name") == F.col("metric")) & (F.col("x.most") > F.col("threshold")))
    unit = F.lit("")
    for name, shown in words.units.items():
        unit = F.when(F.col("unit") == name, shown).otherwise(unit)
    return met.select(*_hit("derived", F.col("text"), F.col("position"), F.concat(show_number(F.col("x.most")), unit), F.concat(F.lit(words.at_most), show_number(F.col("threshold")), unit), key))


def keyword_matches(facts: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, rule_id, path, keyword, text, position): of each key and rule the first keyword in the order of the rule, in
    the first of its fields that has one. ``facts``: (key, path, text, position); ``rules``: (rule_id, fields, keywords)."""
    words = rules.select("rule_id", F.posexplode("fields").alias("field_place", "path"), "keywords").select("rule_id", "field_place", "path", F.posexplode("keywords").alias("word_place", "keyword"))
    words = saved(words.filter("keyword <> ''"))
    numbered = saved(words.select("keyword").distinct().withColumn("word_id", F.monotonically_increasing_id()))
    read = facts.join(F.broadcast(words.select("path").distinct()), "path", "left_semi")  # the paths of a pack
    read = saved(read.select(key, "path", "text", "position").withColumn("fact_id", F.monotonically_increasing_id()))
    pairs = contained(read.select("fact_id", "text"), numbered.select("word_id", F.col("keyword").alias("value")), "fact_id", "word_id")
    # texts stay behind: a common word would bring those of all that have it to one task
    said = words.join(numbered, "keyword")
    said = F.broadcast(said) if words.count() <= BROADCAST_ROWS else said
    met = pairs.join(read.select("fact_id", key, "path"), "fact_id").join(said, ["path", "word_id"])
    best = met.groupBy(key, "rule_id").agg(F.min_by(F.struct("path", "keyword", "fact_id"), F.struct("field_place", "word_place", "fact_id")).alias("b"))
    first = best.select(key, "rule_id", "b.*")
    return first.join(read.select("fact_id", "text", "position"), "fact_id").select(key, "rule_id", "path", "keyword", "text", "position")


def table_hits(facts: DataFrame, rules: DataFrame, key: str, metrics: dict[str, str], words: Wording) -> DataFrame:
    """(key, rule_id, rule_code, rule_name, risk_level, rule_version, evidence_type, evidence_text, evidence_position,
    actual_value, expected_value, hit_message, suggestion) of every active deterministic rule of a rule table.

    ``facts`` are long (key, section, field, value, source_text, position, extract_status); ``rules`` the columns of
    ``schemas.RULES``. A path that no fact has hits nothing. Without rules or facts there are no hits.
    """
    rules = saved(parsed(rules))
    facts = facts.select("*", F.concat_ws(".", "section", "field").alias("path"), first_filled(F.col("source_text"), F.col("value")).alias("text"))
    filled = facts.filter(~is_missing(F.struct("extract_status", "value")))
    word_rules = rules.filter(F.col("match_mode").isin("keyword", "presence")).select("rule_id", "c.fields", "c.keywords")
    none = F.lit(None).cast("string")
    said = keyword_matches(filled, word_rules, key).select(*_hit("source", F.col("text"), F.col("position"), F.col("keyword"), none, key))
    found = _missing(facts, rules, key, words).unionByName(_over(facts, rules, key, metrics, words)).unionByName(said)
    named = rules.select("rule_id", "rule_code", "rule_name", "risk_level", "rule_version", F.col("c.hit_message").alias("hit_message"), F.col("suggestion_text").alias("suggestion"))
    return found.join(named, "rule_id")
