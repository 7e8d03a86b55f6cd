"""Raw JSON answers checked against the shape they must have, as expressions: one error code for each bad answer."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsieve.functions.once import bind
from docsieve.functions.text import strip

@dataclass(frozen=True)
class Part:
    """A key of an answer: ``kind`` is string or integer; ``choices`` and ``least`` (characters) bound strings."""

    name: str
    kind: str
    required: bool = True
    nullable: bool = False
    choices: tuple[str, ...] = ()
    least: int = 0


@dataclass(frozen=True)
class Shape:
    """Keys of an object, and what a value of one key asks of others: (key, value, keys that must be filled then)."""

    parts: tuple[Part, ...]
    needs: tuple[tuple[str, str, tuple[str, ...]], ...] = ()


# fixed values: the answers to one rule, and each item of the answers to fields
DECISION = Shape(
    (Part("decision", "string", choices=("hit", "not_hit", "uncertain")), Part("reason", "string", least=1), Part("block_start", "integer", False, True), Part("block_end", "integer", False, True)),
    (("decision", "hit", ("block_start", "block_end")),),
)
CANDIDATE = Shape(
    (
        Part("field_name", "string"), Part("value", "string", nullable=True), Part("extract_status", "string", choices=("found", "not_found", "ambiguous")),
        Part("block_start", "integer", False, True), Part("block_end", "integer", False, True),
    ),
    (("extract_status", "found", ("value", "block_start", "block_end")),),
)


def _type(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, BOOLEAN, VOID (a JSON null) or another name; null if there is nothing."""
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def _whole(v: Column) -> Column:
    """The whole number of a JSON number without fraction, a text of digits, or a truth value."""
    kind, text = _type(v), F.try_variant_get(v, "$", "string")
    number = F.try_variant_get(v, "$", "decimal(38,6)")
    return (
        F.when(kind == "STRING", F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("bigint")))
        .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("bigint")).when(number == F.floor(number), number.cast("bigint"))
    )


def content(raw: Column) -> Column:
    """The answer within a provider's envelope ``choices[0].message.content``: its text parsed, or an object as it is.
    Null if the envelope is none, or the text is no JSON."""
    found = F.try_variant_get(F.try_parse_json(raw), "$.choices[0].message.content", "variant")
    return bind(found, lambda x: F.when(_type(x) == "STRING", F.try_parse_json(F.try_variant_get(x, "$", "string"))).otherwise(x))


def checked(v: Column, shape: Shape) -> Column:
    """(error, parts...) of an answer: the error is null for a good one, else its first fault, in this order: NOT_JSON,
    NOT_AN_OBJECT, EXTRA:keys, then of each key MISSING, TYPE, CHOICE or EMPTY, then NEEDS:key. Parts of bad answers are
    null. Whole numbers may come as digits in a text; a key that comes twice makes the answer no JSON."""
    return bind(v, lambda x: bind(_read(x, shape), lambda r: bind(_fault(r, shape), lambda e: F.struct(e.alias("error"), *[F.when(e.isNull(), r[f"value_{p.name}"]).alias(p.name) for p in shape.parts]))))


def _read(v: Column, shape: Shape) -> Column:
    """What the faults are found from, each worked out once: the answer's own type and keys, and of each part its type and
    value."""
    out = [v.isNotNull().alias("there"), _type(v).alias("type"), F.json_object_keys(F.to_json(v)).alias("keys")]
    for p in shape.parts:
        at = F.try_variant_get(v, f"$.{p.name}", "variant")
        value = F.try_variant_get(at, "$", "string") if p.kind == "string" else bind(at, _whole)
        out += [_type(at).alias(f"type_{p.name}"), value.alias(f"value_{p.name}")]
    return F.struct(*out)


def _fault(r: Column, shape: Shape) -> Column:
    extra = F.array_sort(F.array_except(r["keys"], F.array(*[F.lit(p.name) for p in shape.parts])))
    faults: list[tuple[Column, Column]] = [(~r["there"], F.lit("NOT_JSON")), (r["type"] != "OBJECT", F.lit("NOT_AN_OBJECT")), (F.size(extra) > 0, F.concat(F.lit("EXTRA:"), F.array_join(extra, ",")))]
    for p in shape.parts:
        kind, value = r[f"type_{p.name}"], r[f"value_{p.name}"]
        there, empty = F.array_contains(r["keys"], p.name), kind.isNull() | (kind == "VOID")
        wrong = kind != "STRING" if p.kind == "string" else value.isNull()
        if p.required:
            faults.append((~there, F.lit(f"MISSING:{p.name}")))
        faults.append(((~empty if p.nullable else there) & (wrong | empty), F.lit(f"TYPE:{p.name}")))
        if p.choices:
            faults.append((~empty & ~value.isin(*p.choices), F.lit(f"CHOICE:{p.name}")))
        if p.least:
            faults.append((~empty & (F.length(value) < p.least), F.lit(f"EMPTY:{p.name}")))
    for name, wanted, others in shape.needs:
        for other in others:
            value = r[f"value_{other}"]
            faults.append(((r[f"value_{name}"] == wanted) & (value.isNull() | (value.cast("string") == "")), F.lit(f"NEEDS:{other}")))
    return reduce(lambda out, f: F.when(f[0], f[1]).otherwise(out), reversed(faults), F.lit(None).cast("string"))


def checked_items(v: Column, shape: Shape, key: str = "items") -> Column:
    """(error, items): an object with one list of answers, all of which must be good. The first bad one's fault comes with
    its place: ITEM:place:fault. A list that is missing or none is MISSING:key or TYPE:key."""
    def read(x: Column) -> Column:
        entries = F.try_variant_get(x, f"$.{key}", "array<variant>")
        return F.struct(x.isNotNull().alias("there"), _type(x).alias("type"), F.json_object_keys(F.to_json(x)).alias("keys"), F.transform(entries, lambda e: checked(e, shape)).alias("done"))

    def told(r: Column) -> Column:
        placed = F.filter(F.transform(r["done"], lambda x, i: F.when(x["error"].isNotNull(), F.concat(F.lit("ITEM:"), i.cast("string"), F.lit(":"), x["error"]))), lambda e: e.isNotNull())
        extra = F.array_sort(F.array_except(r["keys"], F.array(F.lit(key))))
        return (
            F.when(~r["there"], "NOT_JSON").when(r["type"] != "OBJECT", "NOT_AN_OBJECT").when(F.size(extra) > 0, F.concat(F.lit("EXTRA:"), F.array_join(extra, ",")))
            .when(~F.array_contains(r["keys"], key), f"MISSING:{key}").when(r["done"].isNull(), f"TYPE:{key}").otherwise(F.get(placed, F.lit(0)))
        )

    return bind(v, lambda x: bind(read(x), lambda r: bind(told(r), lambda e: F.struct(e.alias("error"), F.when(e.isNull(), r["done"]).alias("items")))))


def outcome(timed_out: Column, status: Column, error: Column) -> Column:
    """The class of a call's failure, null if it succeeded: time is told before transport, transport before the answer."""
    # fixed values: the classes of failures
    return F.when(timed_out, "LlmProviderTimeoutError").when(status.isNull() | (status >= 400), "LlmProviderError").when(error.isNotNull(), "LlmResponseValidationError")


def valid_response(raw: Column) -> Column:
    """Whether the answer to a written comment is an object with ``success`` true and texts that are not blank for
    ``external_comment_id`` and ``message``."""
    def good(v: Column) -> Column:
        part = lambda n: F.try_variant_get(v, f"$.{n}", "variant")
        filled = lambda n: bind(part(n), lambda x: (_type(x) == "STRING") & (strip(F.try_variant_get(x, "$", "string")) != ""))
        yes = bind(part("success"), lambda x: (_type(x) == "BOOLEAN") & F.try_variant_get(x, "$", "boolean"))
        return F.coalesce((_type(v) == "OBJECT") & yes & filled("external_comment_id") & filled("message"), F.lit(False))

    return bind(F.try_parse_json(raw), good)


def compact_list(c: Column) -> Column:
    """An array of structs as JSON like ``compact_json``."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def compact_json(*columns: Column | str) -> Column:
    """The columns as JSON without spaces; letters beyond ASCII stay, nulls are written."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
