"""The review of a set of documents in one plan: blocks, facts, hits, result. No exchange until rows are asked for."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.functions.once import stage
from docsieve.operators import block_facts, extract, review, rules
from docsieve.operators.segment import split_blocks
from docsieve.plans import packs


def with_blocks(docs: DataFrame, text: str = "text", separator: str = "\n") -> DataFrame:
    return stage(docs, blocks=split_blocks(F.col(text), separator))


def with_facts(docs: DataFrame, pack: extract.Pack = packs.CORPUS, by_block: bool = False) -> DataFrame:
    """Documents (with text or blocks) plus facts and parse_status. ``by_block``: blocks are short and repeat, so that
    each text is read once (``block_facts``)."""
    staged = docs if "blocks" in docs.columns else with_blocks(docs)
    read = block_facts.facts if by_block else extract.facts
    return read(staged, pack).withColumn("parse_status", extract.parse_status(pack))


def with_hits(docs: DataFrame, pack: extract.Pack = packs.CORPUS, rule_set: Iterable[rules.Rule] = packs.CORPUS_RULES, metrics: dict[str, str] = packs.CORPUS_METRICS, wording: rules.Wording = packs.CORPUS_WORDING, every_fact: bool = True, by_block: bool = False) -> DataFrame:
    """``with_facts`` plus the rule hits. Without ``every_fact`` only the facts that the rules name are worked out,
    and there is no parse_status."""
    rule_set = tuple(rule_set)
    if every_fact:
        found = with_facts(docs, pack, by_block)
    else:
        pack = pack.only(rules.paths_of(rule_set))
        found = (block_facts.facts if by_block else extract.facts)(docs if "blocks" in docs.columns else with_blocks(docs), pack)
    return stage(found, hits=rules.hits(rule_set, pack, metrics, wording))


def reviewed(docs: DataFrame, phrases: review.Phrases = packs.CORPUS_PHRASES, **kwargs) -> DataFrame:
    """``with_hits`` plus the review result."""
    return review.review(with_hits(docs, **kwargs), phrases)


def reviewed_contracts(docs: DataFrame, every_fact: bool = True) -> DataFrame:
    """The review of Chinese contracts given with their blocks."""
    return reviewed(docs, packs.CONTRACT_PHRASES, every_fact=every_fact, by_block=True, pack=packs.CONTRACT, rule_set=packs.CONTRACT_RULES, metrics=packs.CONTRACT_METRICS, wording=packs.CONTRACT_WORDING)


def hit_rows(docs_with_hits: DataFrame, *keys: str) -> DataFrame:
    """One row a hit."""
    return docs_with_hits.select(*keys, F.explode("hits").alias("h")).select(*keys, "h.*")
