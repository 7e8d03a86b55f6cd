"""Five remembered levels: a run after changes equals a run from nothing and works out what changed alone."""

from __future__ import annotations

from dataclasses import replace

import duckdb
import pytest

from docsieve.oracles import ORACLES
from docsieve.plans import packs, recompute
from docsieve.queries import QUERIES
from docsieve.streaming import ledger

TEXTS = {
    1: "The thing is long enough\nLicensed under the Some License version 3.5\nmail a@b.cd", 2: "Of erthe and more words\nThe stupid words of it", 3: "ab. cd", 4: None, 5: "   ", 6: "The thing is long enough\nLicensed under the Some License version 3.5\nmail a@b.cd",
    7: "And here a third text without anything",
}
COLUMNS = ["doc_id", "overall_risk_level", "hit_count", "summary_text", "comment_text"]


def rows(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def docs(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


FLAGS = ("read_again", "ocr_again", "parsed_again", "evaluated_again", "result_again")


def test_changes_go_down_as_far_as_they_matter(spark, tmp_path):
    from pyspark.sql import functions as F

    split = lambda t: F.array(F.split(t, r"\. "))
    kept = recompute.Review(spark, str(tmp_path / "kept"), recognise=split)
    first = kept.run(docs(spark, TEXTS), 0)
    flags = rows(first, *FLAGS)
    assert flags[1] == flags[6] == flags[2] == (True, False, True, 5, True) and flags[3] == (True, True, True, 5, True)
    assert flags[4] == flags[5] == (True, False, False, 0, False)
    # nothing changed: what was no success is read again, all else is there, recognised text too
    again = rows(kept.run(docs(spark, TEXTS), 1), *FLAGS)
    assert {k for k, v in again.items() if any(v)} == {3, 4, 5} and again[3] == (True, False, False, 0, False)
    # blank lines, another text, another document of a known text
    changed = TEXTS | {1: TEXTS[1] + "\n \n", 2: "Of other words entirely\nThe thing", 8: TEXTS[7]}
    third = kept.run(docs(spark, changed), 2)
    flags = rows(third, *FLAGS)
    assert flags[1] == (True, False, False, 0, False) and flags[6] == flags[8] == (False, False, False, 0, False) and flags[2] == (True, False, True, 5, True)
    anew = recompute.Review(spark, str(tmp_path / "anew"), recognise=split).run(docs(spark, changed), 0)
    assert rows(third, *COLUMNS) == rows(anew, *COLUMNS)
    # one rule has a new version: it alone is evaluated, and every result is made anew
    newer = [replace(r, rule_version="1.1") if r.rule_id == 4 else r for r in packs.CORPUS_RULES]
    fourth = recompute.Review(spark, str(tmp_path / "kept"), rule_set=newer, recognise=split).run(docs(spark, changed), 3)
    flags = rows(fourth, *FLAGS)
    assert all(flags[i][1:] == (False, False, 1, True) for i in (1, 2, 3, 6, 7, 8))
    assert rows(fourth, *COLUMNS) == rows(anew, *COLUMNS)


def test_a_killed_run_is_repeated(spark, tmp_path, monkeypatch):
    """A run that is killed behind its third level adds nothing twice when it is repeated."""
    path = str(tmp_path / "tables")
    commit, done = ledger.commit, []

    def killed(batch, n, table):
        if len(done) == 3:
            raise RuntimeError("killed")
        done.append(table)
        return commit(batch, n, table)

    monkeypatch.setattr(ledger, "commit", killed)
    with pytest.raises(RuntimeError):
        recompute.Review(spark, path).run(docs(spark, TEXTS), 0)
    monkeypatch.setattr(ledger, "commit", commit)
    kept = recompute.Review(spark, path)
    result = kept.run(docs(spark, TEXTS), 0)
    anew = recompute.Review(spark, str(tmp_path / "anew")).run(docs(spark, TEXTS), 0)
    assert rows(result, *COLUMNS, *FLAGS) == rows(anew, *COLUMNS, *FLAGS)
    assert kept.table("read").count() == len({t or "" for t in TEXTS.values()})


def test_no_documents(spark, tmp_path):
    assert recompute.Review(spark, str(tmp_path / "t")).run(docs(spark, {1: "a"}).limit(0), 0).count() == 0


def test_odd_texts_equal_sql(spark, tmp_path):
    """Short texts of several lines, and texts in which recognition finds nothing."""
    texts = ["\n", "\t", " ", "", None, "  \n \n", "a\nOf b", "a@b.cc\nX", "%%%\n###\n", "Hi.\n", "Of a\nOf b", "And x\n\nThe y", "A b c d e f g h i j\nOf k"] * 3
    rows_ = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string").coalesce(1)
    rows_.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    told = con.execute(ORACLES["incremental_review"])
    names = [c[0] for c in told.description]
    assert sorted(map(str, told.fetchall())) == sorted(str(tuple(r)) for r in QUERIES["incremental_review"](spark, str(tmp_path)).select(*names).collect())


def test_long_columns_are_written_in_the_tables_alone(spark, tmp_path, monkeypatch):
    """Intermediates have keys and marks; what a level makes is written once."""
    written, saved = [], recompute.saved
    monkeypatch.setattr(recompute, "saved", lambda df, *rest: written.extend(df.columns) or saved(df, *rest))
    recompute.Review(spark, str(tmp_path / "t")).run(docs(spark, TEXTS), 0)
    assert written and not {"text", "blocks", "facts", "hit", "hits"} & set(written)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
