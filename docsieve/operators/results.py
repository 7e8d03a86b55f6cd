"""From hits and evaluations to review results: current hits, the counts of a rule run, results with reuse.

Tables (append-only, ids rise): ``rules`` (rule_id, rule_code, risk_level, rule_status, match_mode, rule_version),
``hits`` (hit_id, contract_parse_id, rule_id, rule_version, ...), ``evaluations`` (evaluation_id, contract_parse_id,
rule_id, rule_version, evaluation_fingerprint, evaluation_status, decision, hit_id), ``results``
(review_result_id, contract_parse_id, review_status, review_version, both fingerprints) and ``logs`` (task_id,
log_type, log_content). Everything is keyed by the parse, so the steps of one plan share an exchange. Rows that are
sorted on the way are dealt out before, in parts that grow in number with the tables and not in size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions.once import stage
from docsieve.operators import review
from docsieve.operators.history import latest
from docsieve.sources.tables import dealt, parts

SEMANTIC = "llm_semantic"
USABLE = ("completed", "partial")
CHECKPOINTS = ("RULE_REVIEW_COMPLETED", "RULE_REVIEW_REUSED")


def _active(rules: DataFrame, *modes: str) -> DataFrame:
    """(rule_id, rule_version) of the active rules, of the semantic ones with a mode, else of all others. The rules of a
    review are few and one row holds the digest of them all, so they are broadcast: dealt out by their rules, all hits
    and evaluations would meet in as many tasks as there are rules."""
    mode = F.col("match_mode").isin(*modes) if modes else F.col("match_mode") != SEMANTIC
    return F.broadcast(rules.filter((F.col("rule_status") == "active") & mode).select("rule_id", "rule_version"))


def latest_evaluations(evaluations: DataFrame, rules: DataFrame) -> DataFrame:
    """The latest evaluation of each parse by each active semantic rule, of the rule's version."""
    return latest(dealt(evaluations, "contract_parse_id").join(_active(rules, SEMANTIC), ["rule_id", "rule_version"]).select(*evaluations.columns), ["contract_parse_id", "rule_id"], "evaluation_id")


def current_hits(hits: DataFrame, evaluations: DataFrame, rules: DataFrame) -> DataFrame:
    """The hits that count for each parse: those of active rules in their version, and for semantic rules the hit
    of the latest evaluation; a later evaluation without a hit takes an earlier one's hit away."""
    own = hits.join(_active(rules), ["rule_id", "rule_version"], "left_semi")
    of_latest = latest_evaluations(evaluations, rules).filter("hit_id is not null").select("hit_id")
    return own.unionByName(hits.join(of_latest.repartition(parts(hits), "hit_id"), "hit_id", "left_semi")).select(*hits.columns)


def with_rules(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Hits with the code, level and mode of their rules, null where a rule is gone."""
    return hits.join(F.broadcast(rules.select("rule_id", "rule_code", "risk_level", "match_mode")), "rule_id", "left")


def hits_of_tasks(hits: DataFrame, parses: DataFrame, snapshots: DataFrame, attachments: DataFrame, rules: DataFrame) -> DataFrame:
    """All hits, current or not, with the task they belong to and their rule."""
    chain = parses.select("contract_parse_id", "document_read_snapshot_id").join(snapshots.select("document_read_snapshot_id", "attachment_id"), "document_read_snapshot_id").join(attachments.select("attachment_id", "task_id"), "attachment_id")
    return with_rules(hits.join(chain.select("contract_parse_id", "task_id"), "contract_parse_id"), rules)


def incomplete(parses: DataFrame, evaluations: DataFrame, rules: DataFrame) -> DataFrame:
    """(contract_parse_id, partial): whether a semantic rule has no evaluation, none that succeeded, or an
    uncertain one. A success without a decision is settled."""
    settled = latest_evaluations(evaluations, rules).filter("evaluation_status = 'success' and not (decision <=> 'uncertain')")
    done = settled.groupBy("contract_parse_id").agg(F.count("*").alias("_done"))
    asked = rules.filter((F.col("rule_status") == "active") & (F.col("match_mode") == SEMANTIC)).agg(F.count("*").alias("_asked"))
    met = parses.select("contract_parse_id").join(done, "contract_parse_id", "left")
    return met.select("contract_parse_id", (F.coalesce("_done", F.lit(0)) < asked.scalar()).alias("partial"))


def reusable_evaluations(evaluations: DataFrame) -> DataFrame:
    """The latest evaluation of each parse, rule, version and fingerprint that was not degraded."""
    keys = ["contract_parse_id", "rule_id", "rule_version", "evaluation_fingerprint"]
    return latest(evaluations.filter("evaluation_status <> 'degraded'"), keys, "evaluation_id")


def rule_review(parses: DataFrame, matches: DataFrame, outcomes: DataFrame, hits: DataFrame, evaluations: DataFrame, rules: DataFrame) -> DataFrame:
    """Per parse the counts of a rule run, and the type of the log row that ends it.

    ``matches`` (contract_parse_id, rule_id, rule_version) are the deterministic matches, ``outcomes`` the semantic
    ones (evaluation_fingerprint, evaluation_status, decision, is_hit besides): what a rule says where no earlier
    evaluation is reused. A semantic hit counts as created even if its row was there already.
    """
    keys = ["contract_parse_id", "rule_id", "rule_version"]
    known = hits.select(*keys).distinct().withColumn("_known", F.lit(True))
    own = matches.select(*keys).join(known, keys, "left").select("contract_parse_id", F.when(F.col("_known"), "reused").otherwise("created").alias("hit"), F.lit(None).cast("string").alias("event"))
    earlier = reusable_evaluations(evaluations).select(*keys, "evaluation_fingerprint", F.lit(True).alias("_earlier"), F.col("hit_id").isNotNull().alias("_hit"))
    met = outcomes.join(earlier, [*keys, "evaluation_fingerprint"], "left")
    event = F.when(F.col("_earlier"), "reused").when(F.col("evaluation_status") == "degraded", "degraded").when(F.col("decision") == "uncertain", "uncertain").otherwise("evaluated")
    hit = F.when(F.col("_earlier"), F.when(F.col("_hit"), "reused")).when(F.col("is_hit"), "created")
    both = own.unionByName(met.select("contract_parse_id", hit.alias("hit"), event.alias("event")))
    counted = both.groupBy("contract_parse_id").agg(
        *[F.count_if(F.col("hit") == x).alias(f"{x}_hit_count") for x in ("created", "reused")],
        *[F.count_if(F.col("event") == x).alias(f"semantic_{x}_count") for x in ("evaluated", "degraded", "uncertain", "reused")],
    )
    skipped = rules.filter("rule_status = 'active' and match_mode = 'future_llm'").agg(F.count("*").alias("skipped_future_llm_count"))
    out = parses.select("contract_parse_id").join(counted, "contract_parse_id", "left").na.fill(0).withColumn("skipped_future_llm_count", skipped.scalar())
    reused = (F.col("reused_hit_count") > 0) & (F.col("created_hit_count") == 0)
    return out.withColumn("log_type", F.when(reused, CHECKPOINTS[1]).otherwise(CHECKPOINTS[0]))


def checkpoint_mark(parse: Column, rule_set: Column) -> Column:
    # fixed values: how a log row names what a rule run has covered
    return F.concat(F.lit("ContractParse: "), parse.cast("string"), F.lit("，RuleSet: "), rule_set, F.lit("，"))


def reviewed_parses(parses: DataFrame, logs: DataFrame, rule_set: Column) -> DataFrame:
    """The (task_id, contract_parse_id) whose rule run with this set of rules a log row of the task ends. What a log row
    covers is read from its text, so that logs meet parses by both ids."""
    # the fixed wording of ``checkpoint_mark``
    read = [F.regexp_extract("log_content", r"ContractParse: ([0-9]+)，RuleSet: ([0-9a-f]+)，", i) for i in (1, 2)]
    own = logs.filter(F.col("log_type").isin(*CHECKPOINTS)).select("task_id", read[0].try_cast("bigint").alias("contract_parse_id"), read[1].alias("_set"))
    keys = ["task_id", "contract_parse_id"]
    keyed = own.filter(F.col("_set") == rule_set).select(*keys).repartition(parts(logs), *keys)
    return keyed.distinct().join(parses.select(*keys), keys, "left_semi")


_HITS = "array<struct<hit_id: bigint, rule_id: bigint, rule_version: string, rule_code: string, rule_name: string, risk_level: string, hit_message: string, suggestion: string, evidence_type: string, evidence_text: string>>"
_EVALUATIONS = "array<struct<rule_id: bigint, rule_version: string, evaluation_fingerprint: string, evaluation_status: string, decision: string>>"


def per_parse(parses: DataFrame, hits: DataFrame, evaluations: DataFrame, rules: DataFrame) -> DataFrame:
    """``parses`` with the state their results follow from, in one grouping: current ``hits`` and latest ``evaluations``
    as arrays (one for each rule at most), ``partial`` as in ``incomplete``, and the two fingerprints."""
    kind = lambda types: types.removeprefix("array<").removesuffix(">")
    names = lambda types: [x.split(":")[0].strip() for x in kind(types).removeprefix("struct<").removesuffix(">").split(",")]
    latest_ = latest_evaluations(evaluations, rules)
    for c in ("evidence_type", "evidence_text"):
        hits = hits if c in hits.columns else hits.withColumn(c, F.lit(None).cast("string"))
    named = current_hits(hits, evaluations, rules).join(F.broadcast(rules.select("rule_id", "rule_code", "risk_level")), "rule_id")
    none = lambda types: F.lit(None).cast(kind(types))
    both = named.select("contract_parse_id", F.struct(*names(_HITS)).cast(kind(_HITS)).alias("h"), none(_EVALUATIONS).alias("e")).unionByName(
        latest_.select("contract_parse_id", none(_HITS).alias("h"), F.struct(*names(_EVALUATIONS)).cast(kind(_EVALUATIONS)).alias("e"))
    )
    found = both.repartition(parts(hits, evaluations), "contract_parse_id").groupBy("contract_parse_id").agg(F.collect_list("h").alias("hits"), F.collect_list("e").alias("evaluations"))
    met = parses.join(found, "contract_parse_id", "left")
    met = stage(met, hits=F.coalesce("hits", F.array().cast(_HITS)), evaluations=F.coalesce("evaluations", F.array().cast(_EVALUATIONS)))
    asked = rules.filter((F.col("rule_status") == "active") & (F.col("match_mode") == SEMANTIC)).agg(F.count("*").alias("_asked"))
    settled = F.size(F.filter("evaluations", lambda e: (e["evaluation_status"] == "success") & ~e["decision"].eqNullSafe("uncertain")))
    lines = lambda c, part: F.array_join(F.array_sort(F.transform(c, part)), "\n")
    hit_text = lines("hits", lambda h: F.concat_ws("@", h["hit_id"].cast("string"), h["rule_id"].cast("string"), h["rule_version"]))
    said = lines("evaluations", lambda e: F.concat_ws("@", e["rule_id"].cast("string"), e["rule_version"], e["evaluation_fingerprint"], e["evaluation_status"], F.coalesce(e["decision"], F.lit("None"))))
    # fixed values: what stands between hits and evaluations in the digest
    text = F.when(F.size("evaluations") == 0, hit_text).otherwise(F.concat(hit_text, F.lit("\n--semantic--\n"), said))
    return met.withColumns({
        "partial": settled < asked.scalar(), "rule_set_fingerprint": review.rule_set_fingerprint(rules).scalar(), "rule_hit_fingerprint": F.sha2(text, 256),
    })


def fingerprints(parses: DataFrame, current: DataFrame, evaluations: DataFrame, rules: DataFrame) -> DataFrame:
    """(contract_parse_id, rule_set_fingerprint, rule_hit_fingerprint) of every parse, with hits or without."""
    found = review.hit_set_fingerprint(current, "contract_parse_id", latest_evaluations(evaluations, rules))
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    met = parses.select("contract_parse_id").join(found, "contract_parse_id", "left")
    return met.select("contract_parse_id", review.rule_set_fingerprint(rules).scalar().alias("rule_set_fingerprint"), F.coalesce("rule_hit_fingerprint", nothing).alias("rule_hit_fingerprint"))


def review_results(
    parses: DataFrame, hits: DataFrame, evaluations: DataFrame, rules: DataFrame, logs: DataFrame, results: DataFrame, words: review.Phrases, version: str, note: str, joiner: str
) -> DataFrame:
    """Per parse (task_id, contract_parse_id) what generating its result comes to: ``outcome``, the result's texts
    and status, its fingerprints, ``review_result_id`` of a reused result, ``hit_ids`` and ``focus_points``.

    Outcomes: RULE_REVIEW_NOT_FOUND without a finished rule run for the current rules (nothing is made then),
    REVIEW_RESULT_REUSED if a usable result of this version has both fingerprints, else REVIEW_RESULT_CREATED. A
    result with open semantic rules is partial and says so: ``note`` ends its summary, and its comment after ``joiner``.
    ``hits`` need rule_name, hit_message and suggestion for the texts.
    """
    met, n = per_parse(parses.select("task_id", "contract_parse_id"), hits, evaluations, rules), parts(hits, evaluations)
    done = reviewed_parses(parses, logs, review.rule_set_fingerprint(rules).scalar()).select("contract_parse_id").repartition(n, "contract_parse_id").distinct().withColumn("_done", F.lit(True))
    keys = ["contract_parse_id", "rule_set_fingerprint", "rule_hit_fingerprint"]
    usable = results.filter((F.col("review_version") == version) & F.col("review_status").isin(*USABLE)).repartition(n, *keys).groupBy(*keys).agg(F.max("review_result_id").alias("review_result_id"))
    met = met.join(done, "contract_parse_id", "left").join(usable, keys, "left")
    built = review.review(met, words)
    outcome = F.when(F.col("_done").isNull(), "RULE_REVIEW_NOT_FOUND").when(F.col("review_result_id").isNotNull(), "REVIEW_RESULT_REUSED").otherwise("REVIEW_RESULT_CREATED")
    made = F.col("outcome") == "REVIEW_RESULT_CREATED"
    text = lambda c, end: F.when(made, F.concat(c, F.when(F.col("partial"), F.lit(end)).otherwise("")))
    return built.withColumn("outcome", outcome).select(
        "task_id", "contract_parse_id", "outcome", "rule_set_fingerprint", "rule_hit_fingerprint",
        F.when(F.col("outcome") == "REVIEW_RESULT_REUSED", F.col("review_result_id")).alias("review_result_id"),
        F.when(made, F.when(F.col("partial"), "partial").otherwise("completed")).alias("review_status"), F.when(made, F.col("overall_risk_level")).alias("overall_risk_level"),
        text(F.col("summary_text"), note).alias("summary_text"), text(F.col("comment_text"), joiner + note).alias("comment_text"),
        F.when(made, F.array_sort(F.transform("hits", lambda h: h["hit_id"]))).alias("hit_ids"),
        F.when(made, F.transform("hits", lambda h: F.struct(*[h[c].alias(k) for k, c in _FOCUS.items()]))).alias("focus_points"),
    )


# fixed values: the keys of a focus point
_FOCUS = {"rule_code": "rule_code", "rule_name": "rule_name", "risk_level": "risk_level", "message": "hit_message", "suggestion": "suggestion", "evidence_type": "evidence_type", "evidence_text": "evidence_text"}


def task_results(
    tasks: DataFrame, choice: DataFrame, hits: DataFrame, evaluations: DataFrame, rules: DataFrame, logs: DataFrame, results: DataFrame, words: review.Phrases, version: str, note: str, joiner: str
) -> DataFrame:
    """Per task (task_id, task_status) what generating its result comes to, as ``review_results`` for the parse that
    ``choice`` (task_id, contract_parse_id) has for it, and ``focus_points``: the hits with their evidence, in order.

    A task that is neither parsing nor reviewing is INVALID_TASK_STATE; one without a parse CONTRACT_PARSE_NOT_FOUND;
    one that is not reviewing has no finished rule run, so it is RULE_REVIEW_NOT_FOUND.
    """
    asked = tasks.filter(F.col("task_status").isin("parsing", "reviewing")).select("task_id").join(choice, "task_id")
    made = review_results(asked, hits, evaluations, rules, logs, results, words, version, note, joiner)
    own = made.select("task_id", "contract_parse_id", F.col("outcome").alias("_outcome"), "review_result_id", "review_status", "overall_risk_level", "summary_text", "comment_text", "focus_points")
    met = tasks.select("task_id", "task_status").join(own.repartition(parts(hits, evaluations), "task_id"), "task_id", "left")
    outcome = (
        F.when(~F.col("task_status").isin("parsing", "reviewing"), "INVALID_TASK_STATE").when(F.col("contract_parse_id").isNull(), "CONTRACT_PARSE_NOT_FOUND")
        .when(F.col("task_status") != "reviewing", "RULE_REVIEW_NOT_FOUND").otherwise(F.col("_outcome"))
    )
    met = met.withColumn("outcome", outcome)
    kept = F.col("outcome") == F.col("_outcome")
    return met.select("task_id", "contract_parse_id", "outcome", *[F.when(kept, F.col(c)).alias(c) for c in own.columns[3:]])


def failed_results(parses: DataFrame, current: DataFrame, error: Column) -> DataFrame:
    """The snapshot of a result that could not be built: no texts, the risk of its hits, the error."""
    level = current.repartition(parts(parses), "contract_parse_id").groupBy("contract_parse_id").agg(F.max(review.weight(F.col("risk_level"))).alias("_w"))
    risk = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.coalesce("_w", F.lit(1)))
    none = F.lit("")
    return parses.join(level, "contract_parse_id", "left").select(
        "contract_parse_id", risk.alias("overall_risk_level"), none.alias("summary_text"), none.alias("comment_text"), F.lit("failed").alias("review_status"), F.concat(F.lit("REVIEW_RESULT_GENERATION_FAILED: "), error).alias("review_error")
    )


def result_hits(results: DataFrame) -> DataFrame:
    """(contract_parse_id, hit_id): the fixed hits of each result that was made."""
    return results.filter("outcome = 'REVIEW_RESULT_CREATED'").select("contract_parse_id", F.explode("hit_ids").alias("hit_id"))


def with_hits(results: DataFrame, links: DataFrame, hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Results with ``hits``, an array of their hits with codes and levels in order of ids, empty without any.
    Repeated links count once."""
    own = links.repartition(parts(hits), "hit_id").distinct().join(with_rules(dealt(hits.select("hit_id", "rule_id"), "hit_id"), rules), "hit_id")
    listed = own.repartition(parts(hits), "review_result_id").groupBy("review_result_id").agg(F.array_sort(F.collect_list(F.struct("hit_id", "rule_code", "risk_level"))).alias("hits"))
    none = F.array().cast("array<struct<hit_id: bigint, rule_code: string, risk_level: string>>")
    return results.join(listed, "review_result_id", "left").withColumn("hits", F.coalesce("hits", none))
