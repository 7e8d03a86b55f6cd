"""Blocks and sections. A document's blocks are one array in its row, so no step here exchanges data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions.once import bind
from docsieve.functions.text import regex, strip
from docsieve.operators.scan import ordered_scan, running_count
from docsieve.schemas import BLOCKS, CANDIDATE


def split_blocks(text: Column, separator: str = "\n", page: Column | None = None) -> Column:
    """Non-blank parts of a text as blocks, numbered from 0 without gaps, on one page (null if not given)."""
    parts = F.filter(F.split(text, separator, -1), lambda t: strip(t) != "")
    page = F.lit(None).cast("int") if page is None else page
    blocks = F.transform(parts, lambda t, i: F.struct(t.alias("text"), page.alias("page_number"), i.alias("block_index")))
    return F.coalesce(blocks, F.array().cast(BLOCKS)).cast(BLOCKS)


def page_blocks(pages: Column, gaps: bool = False) -> Column:
    """Lines of pages (array of array of text) as blocks, blank lines dropped.

    ``gaps``: indexes count the dropped lines too, as for the lines of a single image; else they have no gaps.
    """
    lines = F.flatten(F.transform(pages, lambda p, n: F.transform(p, lambda t: F.struct(t.alias("text"), (n + 1).cast("int").alias("page_number")))))
    if gaps:
        numbered = F.transform(lines, lambda x, i: F.struct(x["text"], x["page_number"], i.alias("block_index")))
        return F.filter(numbered, lambda x: strip(x["text"]) != "").cast(BLOCKS)
    return F.transform(F.filter(lines, lambda x: strip(x["text"]) != ""), lambda x, i: F.struct(x["text"], x["page_number"], i.alias("block_index"))).cast(BLOCKS)


def collect_blocks(rows: DataFrame, key: str) -> DataFrame:
    """One row a document from a table of single blocks (key, text, page_number, block_index)."""
    blocks = F.array_sort(F.collect_list(F.struct("block_index", "text", "page_number")))
    return rows.groupBy(key).agg(F.transform(blocks, lambda b: F.struct(b["text"], b["page_number"], b["block_index"])).cast(BLOCKS).alias("blocks"))


def lines(blocks: Column) -> Column:
    """The blocks in order, as (block_index, page_number, text) with the text stripped: what facts are read from."""
    return F.array_sort(F.transform(blocks, lambda b: F.struct(b["block_index"].alias("block_index"), b["page_number"].alias("page_number"), strip(b["text"]).alias("text"))))


def is_heading(text: Column, keyword: str, numbered: str | None) -> Column:
    """A stripped block starts a section if it starts with the keyword, or is numbered and has it."""
    starts = text.startswith(keyword)
    return text.contains(keyword) & (starts | text.rlike(regex("^" + numbered))) if numbered else starts


def sections(ordered: Column, headings: dict[str, list[str]], numbered: str | None = None) -> Column:
    """(name, candidate) of each section: from a heading block to the block before the next heading of any name.

    ``ordered`` comes from ``lines``. ``headings`` maps names to keywords; the first name in order that fits labels the block. Blocks before
    the first heading belong to none. A section's pages are its first and last page that is known.
    """

    def label(text: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, keywords in reversed(headings.items()):
            fits = F.lit(False)
            for k in keywords:
                fits = fits | is_heading(text, k, numbered)
            out = F.when(fits, F.lit(name)).otherwise(out)
        return out

    def section(ordered: Column, marks: Column, m: Column, i: Column) -> Column:
        end = F.coalesce(F.get(marks, i + 1)["at"], F.size(ordered))

        def of(own: Column) -> Column:
            text = F.array_join(F.transform(own, lambda b: b["text"]), "\n")
            pages = F.filter(F.transform(own, lambda b: b["page_number"]), lambda p: p.isNotNull())
            last = F.get(own, F.size(own) - 1)
            position = bind(pages, lambda p: F.struct(F.get(own, F.lit(0))["block_index"].alias("block_start"), last["block_index"].alias("block_end"), F.get(p, F.lit(0)).alias("page_start"), F.get(p, F.size(p) - 1).alias("page_end")))
            return F.struct(m["name"].alias("name"), bind(text, lambda t: F.struct(t.alias("value"), t.alias("source_text"), position.alias("position")).cast(CANDIDATE)).alias("candidate"))

        return bind(F.slice(ordered, m["at"] + 1, end - m["at"]), of)

    def marked(ordered: Column) -> Column:
        labels = F.transform(ordered, lambda b, i: F.struct(label(b["text"]).alias("name"), i.alias("at")))
        return bind(F.filter(labels, lambda m: m["name"].isNotNull()), lambda marks: F.transform(marks, lambda m, i: section(ordered, marks, m, i)))

    return marked(ordered)


def runs(rows: DataFrame, key: str, order: str, starts: Column) -> DataFrame:
    """``rows`` of a long table with ``section``: how many starting rows there were so far; 0 is the preamble. A key may
    have any number of rows; ``rows`` is counted before."""
    return ordered_scan(rows, [key], [order], {"section": running_count(starts)})
