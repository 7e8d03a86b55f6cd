"""Model answers supplied as tables: evidence checks, merging of extracted values, semantic rule decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions.once import bind, stage
from docsieve.functions.text import strip, supported


def evidence(blocks: Column, start: Column, end: Column) -> Column:
    """(text, position) of a closed range of block indexes; null if the range is null, turned round, or has gaps."""
    def of(own: Column) -> Column:
        indexes = F.array_distinct(F.transform(own, lambda b: b["block_index"]))
        pages = F.filter(F.transform(own, lambda b: b["page_number"]), lambda p: p.isNotNull())
        text = F.array_join(F.transform(own, lambda b: strip(b["text"])), "\n")
        position = bind(pages, lambda p: F.struct(start.alias("block_start"), end.alias("block_end"), F.get(p, F.lit(0)).alias("page_start"), F.get(p, F.size(p) - 1).alias("page_end")))
        return F.when(start.isNotNull() & end.isNotNull() & (start <= end) & (F.size(indexes) == end - start + 1), F.struct(text.alias("text"), position.alias("position")))

    return bind(F.filter(blocks, lambda b: b["block_index"].between(start, end)), of)


def merge_answers(facts: DataFrame, answers: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """Long facts (key, field, value, source_text, extract_status) after a model's answers, plus ``note``.

    Answers are (key, place, field, answer_value, answer_status, block_start, block_end). Only fields that are
    not_found or ambiguous take one: not_found changes nothing, a bad range makes the fact failed, a value that
    its evidence does not have makes it ambiguous, else it is found. For fields that are resolved, a different
    value is noted as a conflict. Of several answers to a field the first counts. Answers to unknown fields
    are left out.
    """
    parts = ("place", "answer_value", "answer_status", "block_start", "block_end")
    first = answers.groupBy(key, "field").agg(F.min(F.struct(*parts)).alias("_a")).select(key, F.struct("field", "_a.*").alias("_a"))
    # blocks meet the answers of their document in one row, facts meet what is left of both: all by the key alone, nothing
    # is broadcast, and blocks are exchanged once
    told = first.groupBy(key).agg(F.collect_list("_a").alias("_told")).join(blocks.select(key, "blocks").hint("merge"), key, "left")
    told = stage(told, _told=F.transform("_told", lambda a: F.struct(a.alias("a"), evidence(F.col("blocks"), a["block_start"], a["block_end"]).alias("ev")))).select(key, "_told")
    met = facts.join(told.hint("merge"), key, "left")
    met = stage(met, _t=F.get(F.filter("_told", lambda t: t["a"]["field"] == F.col("field")), F.lit(0)))
    met = met.select(*facts.columns, "_t.a.answer_value", "_t.a.answer_status", F.col("_t.ev").alias("_ev"))
    open_ = F.col("extract_status").isin("not_found", "ambiguous")
    text = F.col("_ev.text")
    note = (
        F.when(F.col("answer_status").isNull(), "no_answer")
        .when(~open_, F.when(F.col("answer_value").isNotNull() & ~F.col("answer_value").eqNullSafe(F.col("value")), "LLM_EXTRACTION_CONFLICT").otherwise("not_requested"))
        .when(F.col("answer_status") == "not_found", "unchanged")
        .when(F.col("_ev").isNull(), "INVALID_BLOCK_RANGE")
        .when(F.col("answer_status") == "ambiguous", "ambiguous")
        .when(~supported(F.coalesce("answer_value", F.lit("")), text), "VALUE_NOT_IN_EVIDENCE")
        .otherwise("llm_verified")
    )
    out = met.withColumn("note", note)
    n = F.col("note")
    changed = n.isin("INVALID_BLOCK_RANGE", "ambiguous", "VALUE_NOT_IN_EVIDENCE", "llm_verified")
    return out.select(
        key, "field",
        F.when(n == "llm_verified", F.col("answer_value")).when(changed, None).otherwise(F.col("value")).alias("value"),
        F.when(n == "INVALID_BLOCK_RANGE", None).when(changed, text).otherwise(F.col("source_text")).alias("source_text"),
        F.when(n == "llm_verified", "found").when(n == "INVALID_BLOCK_RANGE", "failed").when(changed, "ambiguous").otherwise(F.col("extract_status")).alias("extract_status"),
        "note",
    )


def evaluation_fingerprint(rule_version: Column, engine: str, provider: str | None, model: str | None) -> Column:
    """Digest of what decides an evaluation; without a provider its own fixed variant."""
    # fixed values: what stands for a provider and a model that are not configured
    parts = [rule_version, F.lit(engine), F.lit(provider or "not_configured"), F.lit(model or "not_configured")]
    return F.sha2(F.concat_ws("|", *parts), 256)


def hybrid_version(version: str, fingerprint: Column) -> Column:
    return F.concat(F.lit(version + "-"), F.substring(fingerprint, 1, 12))


def hybrid_version_of(version: Column, fingerprint: Column) -> Column:
    """The version of what follows from a rule's version and an evaluation's fingerprint."""
    return F.concat(version, F.lit("-"), F.substring(fingerprint, 1, 12))


def hybrid_parses(asked: DataFrame, known: DataFrame) -> DataFrame:
    """What asking a model about each read comes to: (document_read_snapshot_id, log_type, contract_parse_id,
    parse_status).

    ``asked``: extractor_name, extractor_version, error (null: the model answered), n_unresolved, all_found. ``known``:
    earlier parses (extractor_name, extractor_version, parse_status, llm_status, contract_parse_id). The latest success
    or partial parse of the same read, extractor and version is reused unless it was degraded. An error degrades
    to the deterministic parse, which is partial then; with nothing unresolved the model is not asked.
    """
    keys = ["document_read_snapshot_id", "extractor_name", "extractor_version"]
    best = known.filter(F.col("parse_status").isin("success", "partial")).groupBy(*keys).agg(F.max(F.struct("contract_parse_id", "llm_status")).alias("_k"))
    met = asked.join(best, keys, "left")
    reused = F.col("_k").isNotNull() & (F.col("_k.llm_status") != "degraded")
    kind = F.when(reused, "LLM_CONTRACT_PARSE_REUSED").when(F.col("error").isNotNull(), "LLM_EXTRACTION_DEGRADED").when(F.col("n_unresolved") == 0, "LLM_EXTRACTION_SKIPPED").otherwise("LLM_EXTRACTION_COMPLETED")
    status = F.when(~reused, F.when(F.col("error").isNotNull() | ~F.col("all_found"), "partial").otherwise("success"))
    return met.select("document_read_snapshot_id", kind.alias("log_type"), F.when(reused, F.col("_k.contract_parse_id")).alias("contract_parse_id"), status.alias("parse_status"))


def evaluate_semantic(clauses: DataFrame, rules: DataFrame, responses: DataFrame, blocks: DataFrame, key: str, configured: bool = True) -> DataFrame:
    """(key, rule_id, evaluation_status, decision, is_hit, evidence_text) for every document and semantic rule.

    ``clauses``: (key, field, extract_status, position); ``responses``: (key, rule_id, decision, block_start,
    block_end, error). A clause that is not found or has no position is skipped and uncertain; no provider or
    an error is degraded without a decision; a hit whose range is not whole or leaves the clause is rejected
    and uncertain.
    """
    grid = clauses.join(F.broadcast(rules.select("rule_id", "target_clause")), F.col("field") == F.col("target_clause"))
    # blocks are met by the key alone and left behind with the evidence; their bytes say little of their size in memory, so
    # that they must not be broadcast
    told = responses.join(blocks.select(key, "blocks").hint("merge"), key, "left")
    told = stage(told, _found=evidence(F.col("blocks"), F.col("block_start"), F.col("block_end"))).drop("blocks")
    met = grid.join(told.hint("merge"), [key, "rule_id"], "left")
    usable = (F.col("extract_status") == "found") & F.col("position").isNotNull()
    inside = (F.col("block_start") >= F.col("position.block_start")) & (F.col("block_end") <= F.col("position.block_end"))
    met = met.withColumn("_ev", F.when(inside, F.col("_found")))
    status = F.when(~usable, "skipped").when(F.lit(not configured) | F.col("decision").isNull() | F.col("error").isNotNull(), "degraded").when((F.col("decision") == "hit") & F.col("_ev").isNull(), "rejected").otherwise("success")
    out = met.withColumn("evaluation_status", F.coalesce(status, F.lit("skipped")))
    s = F.col("evaluation_status")
    decision = F.when(s.isin("skipped", "rejected"), "uncertain").when(s == "degraded", None).otherwise(F.col("decision"))
    hit = (s == "success") & (F.col("decision") == "hit")
    return out.select(key, "rule_id", "evaluation_status", decision.alias("decision"), F.coalesce(hit, F.lit(False)).alias("is_hit"), F.when(hit, F.col("_ev.text")).alias("evidence_text"))
