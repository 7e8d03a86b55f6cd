"""The facts of ``extract`` for documents whose blocks are short and repeat, as the clauses of contracts do.

Blocks of a batch of documents are one Arrow array: each distinct text is read once, and what it has is dealt to the
documents by numpy. The expressions of ``extract`` are interpreted for each block, field and keyword instead.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.functions.text import FULL_WIDTH, WHITE_SPACE
from docsieve.operators import extract
from docsieve.schemas import FACT

# fixed values: the white space of Unicode, as the engine's patterns know it, for a class of characters
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_DIGITS = str.maketrans(FULL_WIDTH, "0123456789")
_STATUS = pa.array(["not_found", "found", "ambiguous", "failed"])
_POSITION = ("block_start", "block_end", "page_start", "page_end")
#: Texts that are remembered from one batch to the next.
MEMO = 100_000


def pattern(source: str) -> re.Pattern:
    """A pattern of the engine for Python, with the same white space; ValueError if it names other classes."""
    out, inside, i = [], False, 0
    while i < len(source):
        c = source[i]
        if c == "\\":
            i += 1
            c += source[i]
            if c[1].isalnum() and c[1] not in "sdn":
                raise ValueError(f"not read the same way everywhere: {c}")
            c = (_SPACE if inside else f"[{_SPACE}]") if c == r"\s" else c
        elif c == "[" or (c == "]" and inside):
            if c == "[" and inside:
                raise ValueError("a class in a class")
            inside = c == "["
        out.append(c)
        i += 1
    return re.compile("".join(out))


def iso_date(text: str) -> str | None:
    parts = re.findall("[0-9]+", text.translate(_DIGITS))
    if len(parts) < 3 or len(parts[0]) != 4 or max(map(len, parts[:3])) > 19:
        return None
    try:
        return date(*map(int, parts[:3])).isoformat()
    except (ValueError, OverflowError):
        return None


def _values(spec: extract.Field) -> Callable[[str], tuple[str, ...]]:
    """The values that a stripped block has of a field."""
    if spec.kind == "keywords":
        known = [(value, [k.lower() for k in keywords]) for value, keywords in spec.values.items()]

        def of(text: str) -> tuple[str, ...]:
            if spec.gates and not any(g in text for g in spec.gates):
                return ()
            low = text.lower()
            return tuple(value for value, keywords in known if any(k in low for k in keywords))

        return of
    find = pattern(spec.pattern).search
    if spec.kind == "block":
        return lambda text: (text,) if len(text) <= spec.longest and find(text) else ()
    return lambda text: ((m.group(1) or "").strip(WHITE_SPACE),) if (m := find(text)) else ()


def _label(pack: extract.Pack) -> Callable[[str], int]:
    """The place of the first section whose heading a stripped block is; -1 if none."""
    numbered = pattern("^" + pack.numbered).search if pack.numbered else None
    known = list(enumerate(pack.sections.values()))

    def of(text: str) -> int:
        fits = lambda k: text.startswith(k) or bool(numbered and k in text and numbered(text))
        return next((i for i, keywords in known if any(fits(k) for k in keywords)), -1)

    return of


def _finished(value: str, after: str) -> tuple[str | None, int]:
    if value != "" and after == "number":
        return value.replace(",", ""), 1
    if value != "" and after == "date":
        day = iso_date(value)
        return day, 1 if day is not None else 3
    return value, 1


class _Places:
    """Block indexes or pages of rows, some of which are null."""

    def __init__(self, column: pa.Array):
        self.null = column.is_null().to_numpy(zero_copy_only=False)
        self.at = pc.fill_null(column, 0).to_numpy(zero_copy_only=False)

    def known(self, rows: range | list[int]) -> list[int]:
        return [int(self.at[r]) for r in rows if not self.null[r]]


def _order(offsets: np.ndarray, doc: np.ndarray, text: pa.Array, page: pa.Array, at: pa.Array) -> np.ndarray | None:
    """The rows in the order of their blocks; None if they are in order."""
    own = _Places(at)
    ahead = (own.at[1:] > own.at[:-1]) | (doc[1:] != doc[:-1])
    if not own.null.any() and ahead.all():
        return None
    order, odd = np.arange(len(doc)), np.unique(np.concatenate([doc[1:][~ahead], doc[own.null]]))
    for d in odd.tolist():
        rows = range(offsets[d], offsets[d + 1])
        key = {r: tuple((v is not None, v if v is not None else 0) for v in (at[r].as_py(), page[r].as_py())) + ((s is not None, (s or "").strip(WHITE_SPACE)),) for r in rows for s in (text[r].as_py(),)}
        order[rows.start : rows.stop] = sorted(rows, key=key.get)
    return order


class _Facts:
    """Facts of one field of a batch of documents, from their candidates."""

    def __init__(self, n: int, absent: np.ndarray):
        self.status = np.where(absent, 1, 0)
        self.source = np.full(n, -1)
        self.value = np.full(n, -1)
        self.places = np.zeros((4, n), dtype=np.int64)
        self.unknown = np.ones((4, n), dtype=bool)
        self.has_place = np.zeros(n, dtype=bool)

    def put(self, docs: np.ndarray, source: np.ndarray, value: np.ndarray, status: np.ndarray | int, places: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.source[docs], self.value[docs], self.status[docs], self.has_place[docs] = source, value, status, True
        for i, (at, null) in enumerate(places):
            self.places[i, docs], self.unknown[i, docs] = at, null

    def widest(self, doc: int, source: int, blocks: tuple[list[int], list[int]], pages: tuple[list[int], list[int]]) -> None:
        """An ambiguous fact keeps all evidence."""
        self.source[doc], self.value[doc], self.status[doc], self.has_place[doc] = source, -1, 2, True
        for i, (pick, known) in enumerate(((min, blocks[0]), (max, blocks[1]), (min, pages[0]), (max, pages[1]))):
            self.places[i, doc], self.unknown[i, doc] = (pick(known), False) if known else (0, True)

    def array(self, values: pa.Array, sources: pa.Array, method: str) -> pa.Array:
        take = lambda table, at: table.take(pa.array(at, mask=at < 0))
        places = [pa.array(self.places[i].astype(np.int32), mask=self.unknown[i]) for i in range(4)]
        position = pa.StructArray.from_arrays(places, fields=[pa.field(p, pa.int32()) for p in _POSITION], mask=pa.array(~self.has_place))
        columns = [take(values, self.value), take(sources, self.source), position, _STATUS.take(pa.array(self.status)), pa.array([method]).take(pa.array(np.zeros(len(self.status), dtype=np.int64)))]
        return pa.StructArray.from_arrays(columns, ["value", "source_text", "position", "extract_status", "extract_method"])


def _first(docs: np.ndarray, n: int) -> np.ndarray:
    """For each document the first place that it has in ``docs``, which is in order; -1 if none."""
    out = np.full(n, -1)
    out[docs[::-1]] = np.arange(len(docs))[::-1]
    return out


def reader(pack: extract.Pack) -> Callable[[pa.Array], pa.Array]:
    """What makes the facts of documents from their blocks, batch by batch."""
    of_fields, label, names = [_values(f) for f in pack.fields], _label(pack), list(pack.sections)
    wanted = [s for s in names if s not in pack.unread]
    memo: dict[str, tuple] = {}

    def read_text(text: str | None) -> tuple:
        if text is None:
            return None, -1, ((),) * len(of_fields)
        found = memo.get(text)
        if found is None:
            if len(memo) >= MEMO:
                memo.clear()
            bare = text.strip(WHITE_SPACE)
            found = memo[text] = bare, label(bare), tuple(of(bare) for of in of_fields)
        return found

    def read(blocks: pa.Array) -> pa.Array:
        n, absent = len(blocks), blocks.is_null().to_numpy(zero_copy_only=False)
        lengths = pc.fill_null(pc.list_value_length(blocks), 0).to_numpy(zero_copy_only=False)
        offsets, doc = np.concatenate([[0], np.cumsum(lengths)]), np.repeat(np.arange(n), lengths)
        flat = blocks.flatten()
        parts = dict(zip([f.name for f in flat.type], flat.flatten(), strict=True))
        text, page, at = parts["text"], parts["page_number"], parts["block_index"]
        if (order := _order(offsets, doc, text, page, at)) is not None:
            text, page, at = text.take(pa.array(order)), page.take(pa.array(order)), at.take(pa.array(order))
        coded = text.dictionary_encode()
        known = [read_text(t) for t in coded.dictionary.to_pylist()] + [read_text(None)]
        codes = pc.fill_null(coded.indices, len(known) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        bare = [k[0] for k in known]
        pages, ats = _Places(page), _Places(at)

        def field(j: int, spec: extract.Field) -> pa.Array:
            out, values = _Facts(n, absent), [k[2][j] for k in known]
            done = [_finished(v[0], spec.after) if v else (None, 0) for v in values]
            many = np.array([len(v) for v in values])
            rows = np.flatnonzero(many[codes])
            count = np.bincount(doc[rows], weights=many[codes[rows]], minlength=n)
            first = _first(doc[rows], n)
            docs = np.flatnonzero(first >= 0)
            at_row = rows[first[docs]]
            place = [(p.at[at_row], p.null[at_row]) for p in (ats, ats, pages, pages)]
            out.put(docs, codes[at_row], codes[at_row], np.array([d[1] for d in done])[codes[at_row]], place)
            more = []
            for d in np.flatnonzero(count > 1).tolist():
                own = rows[np.searchsorted(rows, offsets[d]) : np.searchsorted(rows, offsets[d + 1])].tolist()
                found = [(v, r) for r in own for v in values[codes[r]]]
                if len({v for v, _ in found}) > 1:
                    more.append("\n".join(bare[codes[r]] for _, r in found))
                    out.widest(d, len(bare) + len(more) - 1, (ats.known(own),) * 2, (pages.known(own),) * 2)
            return out.array(pa.array([d[0] for d in done], pa.string()), pa.array(bare + more, pa.string()), spec.method)

        basic = [field(j, f) for j, f in enumerate(pack.fields)]
        clauses = []
        if wanted:
            of_row = np.array([k[1] for k in known])[codes]
            marks = np.flatnonzero(of_row >= 0)
            owner, name = doc[marks], of_row[marks]
            ends = np.minimum(np.append(marks[1:], len(doc)), offsets[owner + 1])
            section = np.searchsorted(marks, np.arange(len(doc)), "right") - 1
            inside = (section >= 0) & (codes < len(known) - 1)
            inside[inside] = owner[section[inside]] == doc[inside]
            bounds = np.concatenate([[0], np.cumsum(np.bincount(section[inside], minlength=len(marks)))]).astype(np.int32)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), pa.array(bare, pa.string()).take(pa.array(codes[inside]))), "\n")
            start, last = (pages.at[marks], pages.null[marks]), (pages.at[ends - 1], pages.null[ends - 1])
            for at_, null in (start, last):
                for m in np.flatnonzero(null).tolist():
                    if known_ := pages.known(range(marks[m], ends[m])):
                        at_[m], null[m] = known_[0] if at_ is start[0] else known_[-1], False
            first_at, last_at = (ats.at[marks], ats.null[marks]), (ats.at[ends - 1], ats.null[ends - 1])
            for s in wanted:
                out, own = _Facts(n, absent), np.flatnonzero(name == names.index(s))
                first = _first(owner[own], n)
                docs = np.flatnonzero(first >= 0)
                m = own[first[docs]]
                out.put(docs, m, m, 1, [(a[m], null[m]) for a, null in (first_at, last_at, start, last)])
                more = []
                for d in np.flatnonzero(np.bincount(owner[own], minlength=n) > 1).tolist():
                    mine = own[np.searchsorted(owner[own], d) : np.searchsorted(owner[own], d, "right")].tolist()
                    texts = [joined[i].as_py() for i in mine]
                    if len(set(texts)) > 1:
                        more.append("\n".join(texts))
                        seen = lambda x, mine=mine: [int(x[0][i]) for i in mine if not x[1][i]]
                        out.widest(d, len(joined) + len(more) - 1, (seen(first_at), seen(last_at)), (seen(start), seen(last)))
                texts = pa.concat_arrays([joined, pa.array(more, pa.string())]) if more else joined
                clauses.append(out.array(texts, texts, "heading_keyword"))
        both = [(pack.basic, basic, [f.name for f in pack.fields]), (pack.clauses, clauses, wanted)]
        both = [(part, pa.StructArray.from_arrays(columns, own)) for part, columns, own in both if columns]
        return pa.StructArray.from_arrays([c for _, c in both], [part for part, _ in both])

    return read


def facts(docs: DataFrame, pack: extract.Pack) -> DataFrame:
    """``extract.facts``, by the texts of blocks; a pack with patterns that Python reads otherwise goes to ``extract``."""
    try:
        read = reader(pack)
    except ValueError:
        return extract.facts(docs, pack)
    of = lambda names: "struct<" + ", ".join(f"`{x}`: {FACT}" for x in names) + ">"
    parts = [(name, own) for name, own in ((pack.basic, [f.name for f in pack.fields]), (pack.clauses, [s for s in pack.sections if s not in pack.unread])) if own]
    shape = "struct<" + ", ".join(f"`{name}`: {of(own)}" for name, own in parts) + ">"
    run = F.arrow_udf(lambda blocks: read(blocks), shape)
    return docs.withColumn("facts", run(F.col("blocks")))
