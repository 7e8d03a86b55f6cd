"""A rule run over parses as one plan: what it finds, what it stores, and what it tells.

Deterministic hits come from the facts of each parse, semantic ones from answers that are checked against their evidence;
both meet what earlier runs have stored. Stored rows are known by their parse, rule and version: a deterministic hit that
is there is used again, a semantic rule with a usable evaluation of the same fingerprint is not evaluated again.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.functions.answers import compact_json
from docsieve.operators import extract, results, rules, semantic
from docsieve.plans import packs, review_plan
from docsieve.sources.shared import saved

# fixed values: what a skipped rule gives for its reason, and what a semantic hit has for its value
SKIPPED, SEMANTIC_VALUE = "目标条款未提取，不重复执行缺失类风险判断", "semantic_hit"


@dataclass(frozen=True)
class Provider:
    """Who answers: it decides the fingerprint of an evaluation. None: nobody is configured."""

    name: str | None = None
    model: str | None = None
    evaluator: str = "1.0"


@dataclass(frozen=True)
class Run:
    """``hits`` and ``evaluations`` to be stored, ``logs`` of the semantic rules, and one ``reviews`` row a parse."""

    hits: DataFrame
    evaluations: DataFrame
    logs: DataFrame
    reviews: DataFrame


def run(docs: DataFrame, key: str, rule_set: Iterable[rules.Rule], responses: DataFrame, known_hits: DataFrame, known_evaluations: DataFrame, provider: Provider, pack=packs.CORPUS, metrics=packs.CORPUS_METRICS, wording=packs.CORPUS_WORDING, joiner: str = ": ") -> Run:
    """Run the active rules over ``docs`` (key, text or blocks).

    ``responses``: (key, rule_id, decision, reason, block_start, block_end, error, error_message), raw answers that have
    been read. ``known_hits``: (key, rule_id, rule_version, hit_id); ``known_evaluations``: (evaluation_id, key, rule_id,
    rule_version, evaluation_fingerprint, evaluation_status, decision, hit_id). A review has the numbers of created and
    reused hits, of semantic rules by their outcome, the counts by level, the focus points and hits in the order of their
    ids (new ones behind, by rule), and the type of the log row that ends the run.
    """
    spark = docs.sparkSession
    active = [r for r in rule_set if r.rule_status == "active"]
    asked = [r for r in active if r.match_mode == results.SEMANTIC]
    found = saved(review_plan.with_hits(docs, pack, [r for r in active if r not in asked], metrics, wording).select(key, "blocks", "facts", "hits"))

    table = spark.createDataFrame([(r.rule_id, r.rule_code, r.rule_name, r.risk_level, r.rule_version, r.config.get("target_clause"), r.suggestion) for r in active], "rule_id bigint, rule_code string, rule_name string, risk_level string, rule_version string, target_clause string, suggestion string")
    plain = review_plan.hit_rows(found, key)
    ids = known_hits.groupBy(key, "rule_id", "rule_version").agg(F.max("hit_id").alias("hit_id"))
    plain = plain.join(ids, [key, "rule_id", "rule_version"], "left").withColumn("is_semantic", F.lit(False)).withColumn("created", F.col("hit_id").isNull())

    clauses = extract.long_facts(found, pack, key).filter("section = 'clauses'").select(key, "field", "extract_status", "position")
    own = table.filter("target_clause is not null")
    fingerprint = semantic.evaluation_fingerprint(F.col("rule_version"), provider.evaluator, provider.name, provider.model)
    told = semantic.evaluate_semantic(clauses, own, responses.select(key, "rule_id", "decision", "block_start", "block_end", "error"), found, key, configured=provider.name is not None)
    told = told.join(own.select("rule_id", "rule_version", "rule_code", "target_clause"), "rule_id").withColumn("evaluation_fingerprint", fingerprint)
    told = told.join(responses.select(key, "rule_id", F.col("reason").alias("_reason"), "error", "error_message", "block_start", "block_end"), [key, "rule_id"], "left")
    keys = [key, "rule_id", "rule_version", "evaluation_fingerprint"]
    usable = known_evaluations.filter("evaluation_status <> 'degraded'").groupBy(*keys).agg(F.max(F.struct("evaluation_id", "hit_id")).alias("_k"))
    told = saved(told.join(usable, keys, "left"))
    s, reused = F.col("evaluation_status"), F.col("_k").isNotNull()
    event = F.when(reused, "reused").when(s == "degraded", "degraded").when(F.col("decision") == "uncertain", "uncertain").otherwise("evaluated")
    # fixed values: the types of log rows
    log_type = (
        F.when(reused, "LLM_RULE_EVALUATION_REUSED").when(s == "degraded", "LLM_RULE_EVALUATION_DEGRADED").when(s == "skipped", "LLM_RULE_SKIPPED_NO_CLAUSE").when(s == "rejected", "LLM_RULE_EVIDENCE_INVALID")
        .when(F.col("decision") == "uncertain", "LLM_RULE_UNCERTAIN").when(F.col("is_hit"), "LLM_RULE_HIT_CREATED").otherwise("LLM_RULE_NOT_HIT")
    )
    level = F.when(log_type.isin("LLM_RULE_EVALUATION_DEGRADED", "LLM_RULE_SKIPPED_NO_CLAUSE", "LLM_RULE_EVIDENCE_INVALID"), "warning").otherwise("info")
    logs = told.select(key, "rule_id", "rule_code", level.alias("level"), log_type.alias("log_type"))

    new = told.filter("_k is null")
    version = F.when(F.col("is_hit"), semantic.hybrid_version_of(F.col("rule_version"), F.col("evaluation_fingerprint")))
    failed = s == "degraded"
    metadata = compact_json(
        F.lit(provider.name or "not_configured").alias("provider"), F.lit(provider.model or "not_configured").alias("model"), F.lit(provider.evaluator).alias("evaluator_version"), "rule_code",
        F.when(failed, F.coalesce("error", F.lit("LLM_PROVIDER_NOT_CONFIGURED"))).alias("error_type"), F.when(failed, F.col("error_message")).alias("error_message"),
    )
    reason = F.when(s == "skipped", SKIPPED).when(~failed, F.col("_reason"))
    evaluations = new.select(*keys, "evaluation_status", "decision", reason.alias("reason"), metadata.alias("metadata_json"), version.alias("hit_version"))

    position = F.struct(F.col("block_start").alias("block_start"), F.col("block_end").alias("block_end"), F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"))
    said = new.filter("is_hit").join(table.select("rule_id", "rule_name", "risk_level", "suggestion"), "rule_id").select(
        key, "rule_id", version.alias("rule_version"), "rule_code", "rule_name", "risk_level", F.coalesce("evidence_text", F.lit("")).alias("evidence_text"), position.alias("evidence_position"), F.lit("source").alias("evidence_type"),
        F.lit(SEMANTIC_VALUE).alias("actual_value"), F.lit(None).cast("string").alias("expected_value"), F.col("_reason").alias("hit_message"), "suggestion",
    )
    said = said.join(ids, [key, "rule_id", "rule_version"], "left")
    # a semantic hit counts as created although its row may be there; one of a reused evaluation is named by it
    again = told.filter("_k.hit_id is not null").join(table.select("rule_id", "rule_name", "risk_level"), "rule_id").select(key, "rule_id", "rule_code", "rule_name", "risk_level", F.col("_reason").alias("hit_message"), F.col("_k.hit_id").alias("hit_id"), F.lit(True).alias("is_semantic"), F.lit(False).alias("created"))
    columns = [key, "rule_id", "rule_code", "rule_name", "risk_level", "hit_message", "hit_id", "is_semantic", "created"]
    said = said.withColumn("is_semantic", F.lit(True)).withColumn("created", F.lit(True))
    every = plain.select(columns).unionByName(said.select(columns)).unionByName(again.select(columns))
    stored = plain.filter("created").drop("hit_id", "created").unionByName(said.filter("hit_id is null").drop("hit_id", "created"))

    # one row for each rule of a parse at most
    place = F.struct(F.col("hit_id").isNull().alias("new"), "hit_id", "is_semantic", "rule_id", "rule_code", "rule_name", "risk_level", "hit_message")
    counted = every.groupBy(key).agg(
        F.count_if("created").alias("created_hit_count"), F.count_if(~F.col("created")).alias("reused_hit_count"), F.count("*").alias("hit_count"),
        *[F.count_if(F.col("risk_level") == x).alias(f"{x}_count") for x in ("high", "medium", "low")], F.array_sort(F.collect_list(place)).alias("_hits"),
    )
    events = told.select(key, event.alias("event")).groupBy(key).agg(*[F.count_if(F.col("event") == x).alias(f"semantic_{x}_count") for x in ("evaluated", "degraded", "uncertain", "reused")])
    out = found.select(key).join(counted, key, "left").join(events, key, "left").na.fill(0)
    risk = F.when(F.col("high_count") > 0, "high").when(F.col("medium_count") > 0, "medium").otherwise("low")
    focus = F.coalesce(F.transform("_hits", lambda h: F.concat(h["rule_name"], F.lit(joiner), F.coalesce(h["hit_message"], F.lit("")))), F.array().cast("array<string>"))
    codes = F.coalesce(F.transform("_hits", lambda h: h["rule_code"]), F.array().cast("array<string>"))
    kind = F.when((F.col("reused_hit_count") > 0) & (F.col("created_hit_count") == 0), results.CHECKPOINTS[1]).otherwise(results.CHECKPOINTS[0])
    skipped = F.lit(sum(r.match_mode == "future_llm" for r in active)).cast("long").alias("skipped_future_llm_count")
    reviews = out.select(*out.drop("_hits").columns, skipped, risk.alias("overall_risk_level"), focus.alias("focus_points"), codes.alias("rule_codes"), kind.alias("log_type"))
    return Run(stored, evaluations, logs, reviews)
