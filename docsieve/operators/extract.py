"""Pattern-driven facts with evidence: candidates from blocks, resolved to one fact a field, all inside a row."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions.once import stage
from docsieve.functions.text import first_group, iso_date, regex, strip
from docsieve.operators.segment import lines, sections
from docsieve.schemas import CANDIDATE, FACT


@dataclass(frozen=True)
class Field:
    """How a field is found.

    kind ``pattern``: group 1 of the pattern, stripped; ``block``: a whole block of at most ``longest``
    characters that the pattern fits; ``keywords``: each of ``values`` whose keywords a block has, in blocks
    that have one of ``gates``. ``after`` changes a found value: ``date`` (ISO, or the fact failed) or
    ``number`` (without thousands commas).
    """

    name: str
    method: str
    kind: str = "pattern"
    pattern: str = ""
    longest: int = 50
    values: dict[str, list[str]] = field(default_factory=dict)
    gates: tuple[str, ...] = ()
    after: str = ""


@dataclass(frozen=True)
class Pack:
    """Fields and sections as data. ``sections`` maps names to heading keywords, in order; ``unread`` are those
    whose headings end other sections but whose own facts are not asked for."""

    fields: tuple[Field, ...]
    sections: dict[str, list[str]]
    numbered: str | None = None
    basic: str = "basic_info"
    clauses: str = "clauses"
    unread: frozenset[str] = frozenset()

    def paths(self) -> list[tuple[str, str]]:
        return [(self.basic, f.name) for f in self.fields] + [(self.clauses, s) for s in self.sections if s not in self.unread]

    def only(self, paths: set[str]) -> Pack:
        """The pack with the facts of the given ``section.field`` paths alone; unknown paths are an error."""
        known = {f"{s}.{f}" for s, f in self.paths()}
        if paths - known:
            raise ValueError(f"no such field path: {', '.join(sorted(paths - known))}")
        return replace(self, fields=tuple(f for f in self.fields if f"{self.basic}.{f.name}" in paths), unread=frozenset(s for s in self.sections if f"{self.clauses}.{s}" not in paths))


def _candidate(value: Column, block: Column) -> Column:
    at, page = block["block_index"], block["page_number"]
    position = F.struct(at.alias("block_start"), at.alias("block_end"), page.alias("page_start"), page.alias("page_end"))
    return F.struct(value.alias("value"), block["text"].alias("source_text"), position.alias("position")).cast(CANDIDATE)


def candidates(ordered: Column, spec: Field) -> Column:
    """The field's candidates in block order, one a block (keywords: one a value). ``ordered`` comes from ``lines``."""
    if spec.kind == "keywords":
        def values(b: Column) -> Column:
            text = b["text"]
            gate = F.lit(not spec.gates)
            for g in spec.gates:
                gate = gate | text.contains(g)
            found = []
            for value, keywords in spec.values.items():
                has = F.lit(False)
                for k in keywords:
                    has = has | F.lower(text).contains(k.lower())
                found.append(F.when(gate & has, _candidate(F.lit(value), b)))
            return F.filter(F.array(*found), lambda c: c.isNotNull())

        return F.flatten(F.transform(ordered, values))
    if spec.kind == "block":
        fits = lambda t: (F.length(t) <= spec.longest) & t.rlike(regex(spec.pattern))
        value = lambda t: t
    else:
        fits = lambda t: t.rlike(regex(spec.pattern))
        value = lambda t: strip(first_group(t, spec.pattern))
    found = F.transform(F.filter(ordered, lambda b: fits(b["text"])), lambda b: _candidate(value(b["text"]), b))
    return F.filter(found, lambda c: c["value"].isNotNull())


def resolve(found: Column, method: str) -> Column:
    """One fact of many candidates: none is not_found, different values are ambiguous, else the first is found.

    Values are compared as they stand, before any normalisation. An ambiguous fact keeps all evidence.
    """
    known = lambda part: F.filter(F.transform(found, lambda c: c["position"][part]), lambda p: p.isNotNull())
    wide = F.struct(
        F.array_min(known("block_start")).alias("block_start"), F.array_max(known("block_end")).alias("block_end"),
        F.array_min(known("page_start")).alias("page_start"), F.array_max(known("page_end")).alias("page_end"),
    )
    first, none = F.get(found, F.lit(0)), F.lit(None)
    fact = lambda value, text, position, status: F.struct(value.cast("string").alias("value"), text.cast("string").alias("source_text"), position.alias("position"), F.lit(status).alias("extract_status"), F.lit(method).alias("extract_method")).cast(FACT)
    many = F.size(F.array_distinct(F.transform(found, lambda c: c["value"]))) > 1
    return (
        F.when(F.size(found) == 0, fact(none, none, none, "not_found"))
        .when(many, fact(none, F.array_join(F.transform(found, lambda c: c["source_text"]), "\n"), wide, "ambiguous"))
        .otherwise(fact(first["value"], first["source_text"], first["position"], "found"))
    )


def _finish(fact: Column, after: str) -> Column:
    found = (fact["extract_status"] == "found") & (fact["value"] != "")
    if after == "number":
        return F.when(found, fact.withField("value", F.replace(fact["value"], F.lit(","), F.lit("")))).otherwise(fact)
    if after == "date":
        day = iso_date(fact["value"])
        return F.when(found, fact.withField("value", day).withField("extract_status", F.when(day.isNull(), "failed").otherwise("found"))).otherwise(fact)
    return fact


def facts(docs: DataFrame, pack: Pack) -> DataFrame:
    """``docs`` (with blocks) plus ``facts``: a struct of the pack's two sections of facts."""
    read = [s for s in pack.sections if s not in pack.unread]
    found = stage(docs, _lines=lines(F.col("blocks")))
    parts = {"_sections": sections(F.col("_lines"), pack.sections, pack.numbered)} if read else {}
    found = stage(found, **{f"_c_{f.name}": candidates(F.col("_lines"), f) for f in pack.fields}, **parts)
    of = lambda s: F.transform(F.filter("_sections", lambda x: x["name"] == s), lambda x: x["candidate"])
    found = stage(found, **{f"_s_{s}": of(s) for s in read}) if read else found
    found = stage(found, **{f"_f_{f.name}": resolve(F.col(f"_c_{f.name}"), f.method) for f in pack.fields}, **{f"_f_{s}": resolve(F.col(f"_s_{s}"), "heading_keyword") for s in read})
    basic = [_finish(F.col(f"_f_{f.name}"), f.after).alias(f.name) for f in pack.fields]
    clauses = [F.col(f"_f_{s}").alias(s) for s in read]
    both = [F.struct(*part).alias(name) for part, name in ((basic, pack.basic), (clauses, pack.clauses)) if part]
    return stage(found, facts=F.struct(*both)).select(*docs.columns, "facts")


def long_facts(with_facts: DataFrame, pack: Pack, *keys: str) -> DataFrame:
    """One row a document and field, for every field of the pack: the keys, section, field and the fact's parts."""
    every = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(f).alias("field"), F.col(f"facts.{s}.{f}").alias("fact")) for s, f in pack.paths()])
    return with_facts.select(*keys, F.explode(every).alias("f")).select(*keys, "f.section", "f.field", "f.fact.*")


def parse_status(pack: Pack) -> Column:
    """success if every fact is found, else partial."""
    return F.when(F.forall(F.array(*[F.col(f"facts.{s}.{f}.extract_status") for s, f in pack.paths()]), lambda x: x == "found"), "success").otherwise("partial")


def failed_facts(pack: Pack) -> Column:
    """Facts of a document whose extraction broke: every one failed."""
    fact = F.struct(F.lit(None).alias("value"), F.lit(None).alias("source_text"), F.lit(None).alias("position"), F.lit("failed").alias("extract_status"), F.lit("system_error").alias("extract_method")).cast(FACT)
    part = lambda s: F.struct(*[fact.alias(f) for x, f in pack.paths() if x == s]).alias(s)
    return F.struct(part(pack.basic), part(pack.clauses))
