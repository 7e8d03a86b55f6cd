"""The review as five levels, each remembered by the digest of its input and the version of its algorithm.

Read, OCR, parse, evaluation, result: a level works only on keys that its table has no usable row of, so a change goes
down as far as it makes a difference and no further. A text that changed in white space is read again and parsed no more; a
rule with a new version is evaluated alone; a result is made anew where its rule set or its hits are others. What a
run makes is added to the tables as one batch each, once, however often the run is killed and repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions.once import stage
from docsieve.functions.text import meaningful, set_fingerprint, strip
from docsieve.operators import extract, review, rules
from docsieve.operators.segment import page_blocks, split_blocks
from docsieve.plans import packs
from docsieve.schemas import BLOCKS, HIT
from docsieve.sources.shared import saved, shuffles_cleared
from docsieve.streaming import ledger

Recognise = Callable[[Column], Column]

_TABLES = {
    "read": f"key string, version string, status string, blocks {BLOCKS}",
    "ocr": f"key string, version string, status string, blocks {BLOCKS}",
    "parse": "key string, version string, status string, parse_status string, facts string",
    "evaluation": f"key string, rule_id bigint, version string, status string, hit {HIT}",
    "result": "key string, rule_set string, hit_set string, status string, overall_risk_level string, hit_count int, summary_text string, comment_text string",
}


class Review:
    """Tables of the five levels below ``path``, and runs that bring them up to date.

    ``recognise`` makes pages of lines (array of arrays of text) from a text without meaning, as OCR does from a scan.
    """

    def __init__(self, spark: SparkSession, path: str, pack: extract.Pack = packs.CORPUS, rule_set: Iterable[rules.Rule] = packs.CORPUS_RULES, recognise: Recognise | None = None, versions: tuple[str, str, str] = ("1.0", "1.0", "1.0")):
        self.spark, self.path, self.pack = spark, path, pack
        self.rules = [r for r in rule_set if r.rule_status == "active" and r.match_mode not in rules.OTHER_MODES]
        self.recognise = recognise or (lambda text: F.array(F.array(text)))
        self.reader, self.ocr, self.extractor = versions

    def table(self, level: str) -> DataFrame:
        """All rows of a level; none before the first run."""
        if not ledger.committed(self.spark, f"{self.path}/{level}"):
            return self.spark.createDataFrame([], _TABLES[level])
        return self.spark.read.schema(_TABLES[level]).parquet(f"{self.path}/{level}")

    def _level(self, level: str, batch: int, make: Callable[[DataFrame], DataFrame], **fixed: str) -> tuple[DataFrame, DataFrame]:
        """(the level's rows that can be used: all successes, and what else this batch came to; the keys that this batch
        worked out). ``make`` gets the successes so far and makes the rows of the wanted keys that are not among them, so a key
        has one usable row. It reads what it needs from the tables and carries long columns through one exchange alone.
        ``fixed`` columns have the same value in all rows that count."""
        path, good = f"{self.path}/{level}", F.lit(True)
        for name, value in fixed.items():
            good = good & (F.col(name) == value)
        if batch not in ledger.committed(self.spark, path):  # else the run before was killed behind this level
            new = make(self.table(level).filter(good & (F.col("status") == "success")))
            with shuffles_cleared(self.spark):
                ledger.commit(new.withColumns({n: F.lit(v) for n, v in fixed.items()}).select(*self.table(level).drop("batch_id").columns), batch, path)
        rows = self.spark.read.schema(f"{_TABLES[level]}, batch_id int").parquet(path).filter(good & ((F.col("status") == "success") | (F.col("batch_id") == batch)))
        return rows.drop("batch_id"), rows.filter(F.col("batch_id") == batch)

    def run(self, docs: DataFrame, batch: int) -> DataFrame:
        """(doc_id, overall_risk_level, hit_count, summary_text, comment_text, read_again, ocr_again, parsed_again,
        result_again, evaluated_again, nothing_found) of ``docs`` (doc_id, text): the five before the last say what this
        batch worked out for the document's content, evaluated_again how many rules; nothing_found: recognition finds no
        line in a text that is more than spaces, so there is no parse. Equal texts are one content; a null text is an
        empty one. ``docs`` is read up to three times, its texts are written nowhere but in the tables."""
        content, text = F.coalesce(F.col("text"), F.lit("")), F.col("text")
        docs = docs.select("doc_id", content.alias("text"), F.sha2(content, 256).alias("sha"))
        texts = docs.select(F.col("sha").alias("key"), "text")
        with shuffles_cleared(self.spark):
            docs = saved(docs.select("doc_id", "sha", (F.regexp_replace("text", r"\p{Zs}", "") != "").alias("more_than_spaces")))
        keys = docs.select(F.col("sha").alias("key")).distinct()

        status = F.when(meaningful(text), "success").when(F.length(F.trim(text)) == 0, "failed").otherwise("ocr_required")
        unread = lambda known: texts.join(known.select("key"), "key", "left_anti").groupBy("key").agg(F.first("text").alias("text"))
        read, read_again = self._level("read", batch, lambda known: unread(known).select("key", status.alias("status"), split_blocks(text).alias("blocks")), version=self.reader)

        asked = read.filter("status = 'ocr_required'").join(keys, "key", "left_semi").select("key")
        lines = page_blocks(self.recognise(text))

        def recognised(known: DataFrame) -> DataFrame:
            own = texts.filter(status == "ocr_required").join(asked, "key", "left_semi").join(known.select("key"), "key", "left_anti").groupBy("key").agg(F.first("text").alias("text"))
            return own.select("key", lines.alias("blocks")).withColumn("status", F.when(F.size("blocks") > 0, "success").otherwise("failed"))

        ocr, ocr_again = self._level("ocr", batch, recognised, version=self.ocr)

        whole = lambda rows: rows.filter("status = 'success'").select(F.col("key").alias("sha"), "blocks")
        digest = F.sha2(F.to_json("blocks"), 256).alias("key")
        # what was recognised counts for the texts that are read in vain alone
        of_read = whole(read).select("sha", digest).join(keys.withColumnRenamed("key", "sha"), "sha", "left_semi")
        of_ocr = whole(ocr).select("sha", digest).join(asked.withColumnRenamed("key", "sha"), "sha", "left_semi")
        with shuffles_cleared(self.spark):
            blocks = saved(of_read.unionByName(of_ocr))
        inputs = blocks.groupBy("key").agg(F.min("sha").alias("sha"))

        def parse(known: DataFrame) -> DataFrame:
            x = whole(read).unionByName(whole(ocr)).join(inputs.join(known.select("key"), "key", "left_anti"), "sha")
            # a block that recognition made of several lines is read line by line, as the same text is without it
            each = F.flatten(F.transform("blocks", lambda b: F.transform(F.filter(F.split(b["text"], "\n", -1), lambda t: strip(t) != ""), lambda t: F.struct(t.alias("text"), b["page_number"].alias("page_number")))))
            blocks = F.transform(each, lambda b, i: F.struct(b["text"].alias("text"), b["page_number"].alias("page_number"), i.alias("block_index"))).cast(BLOCKS)
            lined = F.exists("blocks", lambda b: b["text"].contains("\n"))
            found = extract.facts(x.withColumn("blocks", F.when(lined, blocks).otherwise(F.col("blocks"))), self.pack).withColumn("parse_status", extract.parse_status(self.pack))
            return found.select("key", F.lit("success").alias("status"), "parse_status", F.to_json("facts", {"ignoreNullFields": "false"}).alias("facts"))

        parses, parsed_again = self._level("parse", batch, parse, version=self.extractor)

        shape = extract.facts(self.spark.createDataFrame([], f"key string, blocks {BLOCKS}"), self.pack).schema["facts"].dataType
        of_rule = F.explode(F.array(*[F.struct(F.lit(r.rule_id).cast("bigint").alias("rule_id"), F.lit(r.rule_version).alias("version")) for r in self.rules])).alias("w")

        def evaluate(known: DataFrame) -> DataFrame:
            grid = inputs.select("key", of_rule).select("key", "w.*").join(known.select("key", "rule_id", "version"), ["key", "rule_id", "version"], "left_anti")
            asked = grid.groupBy("key").agg(F.collect_list(F.struct("rule_id", "version")).alias("w")).join(parses.select("key", F.col("facts").alias("f")), "key")
            hit = stage(asked.withColumn("facts", F.from_json("f", shape)), hits=rules.hits(self.rules, self.pack, packs.CORPUS_METRICS, packs.CORPUS_WORDING))
            each = hit.select("key", "hits", F.explode("w").alias("w"))
            own = F.get(F.filter("hits", lambda h: h["rule_id"] == F.col("w.rule_id")), F.lit(0))
            return each.select("key", "w.rule_id", "w.version", F.lit("success").alias("status"), own.alias("hit"))

        told, evaluated_again = self._level("evaluation", batch, evaluate)

        rule_set = F.sha2(F.lit("\n".join(sorted(f"{r.rule_code}@{r.rule_version}" for r in self.rules))), 256)
        hit_list = F.filter(F.collect_list("hit"), lambda h: h.isNotNull())
        of_rules = F.concat_ws("@", F.col("rule_id").cast("string"), "version").isin([f"{r.rule_id}@{r.rule_version}" for r in self.rules])
        sets = told.filter(of_rules).join(inputs.select("key"), "key", "left_semi").groupBy("key").agg(F.array_sort(hit_list).alias("hits"))
        marks = set_fingerprint(F.transform("hits", lambda h: F.concat_ws("@", h["rule_id"].cast("string"), h["rule_version"])))
        final = sets.select("key", rule_set.alias("rule_set"), marks.alias("hit_set"), "hits")
        words, three = packs.CORPUS_PHRASES, ["key", "rule_set", "hit_set"]
        results, result_again = self._level("result", batch, lambda known: review.review(final.join(known.select(*three), three, "left_anti"), words).withColumn("status", F.lit("success")))
        results = results.join(final.select(*three), three, "left_semi")

        mark = lambda rows, name: rows.select(F.col("key").alias("k"), F.lit(True).alias(name)).distinct()
        seen = docs.join(blocks.select("sha", F.col("key").alias("parse")), "sha", "left")
        for rows, name, at in ((read_again, "read_again", "sha"), (ocr_again, "ocr_again", "sha"), (parsed_again, "parsed_again", "parse"), (result_again, "result_again", "parse")):
            seen = seen.join(mark(rows, name), F.col(at) == F.col("k"), "left").drop("k")
        counted = evaluated_again.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("evaluated_again"))
        seen = seen.join(counted, F.col("parse") == F.col("k"), "left").drop("k").join(results.withColumnRenamed("key", "k"), F.col("parse") == F.col("k"), "left")
        flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("read_again", "ocr_again", "parsed_again", "result_again")]
        nothing = F.col("parse").isNull() & F.col("more_than_spaces")
        return seen.select("doc_id", "overall_risk_level", "hit_count", "summary_text", "comment_text", *flags, F.coalesce("evaluated_again", F.lit(0)).alias("evaluated_again"), nothing.alias("nothing_found"))
