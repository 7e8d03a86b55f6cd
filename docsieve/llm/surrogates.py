"""Surrogates for personal data: keyed, type-consistent replacements, the same for every mention of an entity.

Mentions are found by patterns. A mention's canonical form is its entity: e-mail addresses in lower case, numbers by
their digits (phones with their country code), secrets by their value. A name stands behind one title or several and is
made of entities, one for each word but particles: so ``Prof. Dr. Karl Stein``, ``Mr. Stein``, ``MR. KARL`` and, in a
document that has one of these, a bare ``Karl Stein`` share their words' surrogates. A word that is a given name anywhere
has the gender of the titles it stands behind. Each entity draws a candidate from a keyed digest, of its own type,
length and characters: numbers stay numbers (cards keep the Luhn rule, IBANs their check digits, phones their
country code), addresses stay valid and private ones private, names keep script and gender. A draw that another entity
has, or that is itself an entity of the corpus, is drawn again, so that distinct entities stay distinct and none
gets another's value; names grow with each draw, all else where its format has been found full (private addresses
move to the widest private range, other values get longer). The replacement is then written in the format of
each mention. Only DataFrame functions are used, and only documents with a mention are exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import boxed, fits_broadcast, saved, unboxed

#: Draws after which a format counts as full, and draws between two gatherings of what is chosen so far.
FULL, GATHERED = 24, 8
#: Draws after which e-mail addresses begin to grow.
SAME_LENGTH = 6

_TITLES_F = r"Mrs|Ms|Miss|Madam|Madame|Mme|Frau|Señora|Sra|Госпожа|Κυρία"
_TITLES_M = r"Mr|Sir|Monsieur|Herr|Señor|Sr|Господин|Κύριος"
_TITLES_N = r"Dr|Prof"
# fixed values: degrees behind a title, and words of names that are written as they are
_DEGREES = r"(?:med|jur|phil|rer|nat|oec|habil|h\.c|hc)"
_PARTICLES = r"(?:von|van|vom|der|den|dem|de|del|della|la|le|di|da|do|dos|das|zu|zum|zur|af|av|bin|ibn|al|ter|ten|y)"
_TITLE = "(?:" + "|".join(f"{x}|{x.upper()}" for x in "|".join((_TITLES_F, _TITLES_M, _TITLES_N)).split("|")) + ")"
_WORD = r"(?:\p{Lu}[\p{L}’'-]+|\p{Lu}\.)"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Type -> pattern, in order of precedence. Every pattern has a fixed start, so a scan stays linear.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*(?<=\.[A-Za-z]{2,24})",
    "secret": r"(?<![A-Za-z0-9])(?i:password|passwd|pwd|secret|token|api_?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{8,}+",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\d.+-])(?:\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\d-]|\.\d)",
    "ssn": r"(?<![\d.+-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "phone": r"(?<![\w.+-])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4})(?!\d)",
    "name": rf"(?<!\p{{L}}){_TITLE}\.?(?: (?:{_TITLE}|{_DEGREES})\.?(?= ))* {_WORD}(?: (?:{_PARTICLES} ){{0,3}}{_WORD}){{0,4}}",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Documents without any of these have no mention.
_HINT = rf"@|\d\d|[=:]|AKIA|ASIA|{_TITLE}\.? \p{{Lu}}"
# fixed values: country codes of telephone numbers (those of three digits are what is left)
_COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

# fixed values: syllables of surrogate names by script, with the endings of either gender
_SYLLABLES = {
    "latin": ("ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo za", "lina mira nora tessa ria sela", "rick mon tor lan den bert"),
    "cyrillic": ("ба бе во да до га го ка ко ла ло ма мо на но па по ра ро са со та то за", "лина мира нора рия", "мир слав дан тор"),
    "greek": ("βα γα γε δα δη κα κο λα λε μα με να νο πα πε ρα ρο σα σε τα το", "λίνα μίρα νόρα", "μων δης τωρ"),
}


def _digest(key: str) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(key), "type", "entity", F.col("draw").cast("string")), 256)


def _number(at: Column | int, many: int) -> Column:
    """A keyed number below ``many`` for a place in the surrogate."""
    return F.pmod(F.xxhash64("digest", F.lit(at) if isinstance(at, int) else at), F.lit(many)).cast("int")


def _one_of(letters: str, at: Column) -> Column:
    return F.substring(F.lit(letters), _number(at, len(letters)) + 1, F.lit(1))


def _scramble(text: Column, lower: str = "abcdefghijklmnopqrstuvwxyz", shift: int = 0) -> Column:
    """Each letter and digit replaced by one of its kind, all else as it is; ``shift`` sets keyed places apart."""
    def other(c: Column, i: Column) -> Column:
        i = i + shift
        return F.when(c.rlike("[0-9]"), _one_of("0123456789", i)).when(c.rlike("[a-z]"), _one_of(lower, i)).when(c.rlike("[A-Z]"), _one_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ", i)).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), other), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits, the last one not doubled."""
    def part(c: Column, i: Column) -> Column:
        d = c.cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    parts = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), part)
    return F.aggregate(parts, F.lit(0), lambda a, b: a + b)


def _mod97(text: Column) -> Column:
    """Remainder by 97 of a number in digits and capitals, which stand for 10 to 35."""
    def add(a: Column, c: Column) -> Column:
        return F.when(c.rlike("[A-Z]"), (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + c.try_cast("int")) % 97)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def _name(entity: Column) -> Column:
    """A name of the entity's script. One of a gender ends as its gender does; each draw adds a syllable."""
    def spelled(script: str) -> Column:
        syllables, female, male = (F.array(*[F.lit(x) for x in s.split()]) for s in _SYLLABLES[script])
        pick = lambda a, at: F.element_at(a, F.pmod(F.xxhash64("digest", at), F.size(a)).cast("int") + 1)
        stem = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2) + F.col("draw")), lambda i: pick(syllables, i)), "")
        end = F.when(entity.startswith("f:"), pick(female, F.lit(-1))).when(entity.startswith("m:"), pick(male, F.lit(-1))).when(entity.startswith("n:"), pick(F.concat(female, male), F.lit(-1))).otherwise("")
        return F.initcap(F.concat(stem, end))

    return F.when(entity.rlike(r"\p{IsCyrillic}"), spelled("cyrillic")).when(entity.rlike(r"\p{IsGreek}"), spelled("greek")).otherwise(spelled("latin"))


def _candidate() -> Column:
    """The surrogate that (type, entity, digest) draws, in canonical form."""
    e = F.col("entity")
    local, host = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    top = F.substring_index(host, ".", -1)
    grown = lambda after, letters: F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.col("draw") - after, F.lit(0))), lambda i: F.when(i > 0, _one_of(letters, i + 2000)).otherwise("")), "")
    more, longer = grown(SAME_LENGTH, "abcdefghijklmnopqrstuvwxyz"), grown(FULL, "0123456789")
    email = F.concat(_scramble(local), more, F.lit("@"), _scramble(F.expr("substring(substring_index(entity, '@', -1), 1, greatest(0, length(substring_index(entity, '@', -1)) - length(substring_index(entity, '.', -1)) - 1))"), shift=1000), F.lit("."), top)
    body = F.concat(F.substring(e, 1, 1), F.expr("substring(scrambled, 2, length(scrambled) - 2)"))
    check = F.pmod(10 - F.pmod(_luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    card = F.concat(body, F.when(F.pmod(_luhn(e), F.lit(10)) == 0, check).otherwise(F.substring("scrambled", -1, 1)))
    private = e.rlike(r"^(?:10|127|192\.168|172\.(?:1[6-9]|2\d|3[01])|169\.254)\.")
    wide = private & (F.col("draw") >= FULL)
    kept = F.when(wide | e.rlike(r"^(?:10|127)\."), 1).when(private, 2).otherwise(0)
    ip = F.array_join(F.transform(F.split(F.when(wide, F.concat(F.lit("10."), F.substring_index(e, ".", -3))).otherwise(e), r"\."), lambda o, i: F.when(i < kept, o).otherwise((_number(i, 254) + 1).cast("string"))), ".")
    account = F.concat(F.expr("substring(scrambled, 5, length(scrambled) - 4)"), longer)
    iban = F.concat(F.substring(e, 1, 2), F.lpad((98 - _mod97(F.concat(account, F.substring(e, 1, 2), F.lit("00")))).cast("string"), 2, "0"), account)
    country = F.regexp_extract(e, _COUNTRY, 0)
    phone = F.when(F.length(country) > 0, F.concat(country, F.substring("scrambled", F.length(country) + 1, F.length("scrambled")))).otherwise(F.concat(_one_of("23456789", F.lit(100)), F.substring("scrambled", 2, 2), _one_of("23456789", F.lit(101)), F.substring("scrambled", 5, 6)))
    return (
        F.when(F.col("type") == "email", email)
        .when(F.col("type") == "ip", ip)
        .when(F.col("type") == "card", F.concat(card, longer))
        .when(F.col("type") == "phone", F.concat(phone, longer))
        .when(F.col("type") == "key", F.concat(F.substring(e, 1, 4), F.expr("substring(scrambled, 5, length(scrambled) - 4)"), longer))
        .when(F.col("type") == "iban", iban)
        .when(F.col("type") == "secret", F.concat(F.when(e.rlike("^[0-9a-f]+$"), _scramble(e, "abcdef")).otherwise(F.col("scrambled")), longer))
        .when(F.col("type") == "name", _name(e))
        .otherwise(F.concat("scrambled", longer))
    )


def _draw(entities: DataFrame, key: str) -> DataFrame:
    drawn = entities.withColumn("digest", _digest(key)).withColumn("scrambled", _scramble(F.col("entity")))
    return drawn.withColumn("surrogate", _candidate()).select("type", "entity", "draw", "surrogate")


_SECRET_LEAD = r"^\w+\s{0,3}[=:]\s{0,3}[\"']?"
_TITLE_LEAD = rf"^{_TITLE}\.?(?: (?:{_TITLE}|{_DEGREES})\.?(?= ))* "
_POSSESSIVE = r"['’][sS]$"


def _typed(mentions: DataFrame) -> DataFrame:
    """``mention`` plus its type and ``parts``: the (type, entity) it is made of, one but for names."""
    m = F.col("mention")
    kind = F.lit("other")
    for name, pattern in reversed(PATTERNS.items()):
        kind = F.when(m.rlike(rf"^(?:{pattern})$"), name).otherwise(kind)
    digits = F.regexp_replace(m, r"\D", "")
    lead = F.regexp_extract(m, _TITLE_LEAD, 0)
    gender = F.when(lead.rlike(rf"(?i)(?<!\p{{L}})(?:{_TITLES_F})(?!\p{{L}})"), "f").when(lead.rlike(rf"(?i)(?<!\p{{L}})(?:{_TITLES_M})(?!\p{{L}})"), "m").otherwise("n")
    words = F.filter(F.split(F.regexp_replace(m, _TITLE_LEAD, ""), " "), lambda w: w.rlike(rf"^{_WORD}$") & ~w.rlike(r"\.$"))
    plain = F.transform(words, lambda w: F.regexp_replace(w, _POSSESSIVE, ""))
    part = lambda kind, entity, raw, given: F.struct(kind.alias("type"), entity.alias("entity"), raw.alias("raw"), given.alias("given"))
    # a number with the code of the plan that ten digits alone belong to is the same number
    phone = F.when(~m.startswith("+"), digits).when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(F.concat(F.lit("+"), digits))
    entity = (
        F.when(F.col("type") == "email", F.lower(m))
        .when(F.col("type") == "secret", F.regexp_replace(m, _SECRET_LEAD, ""))
        .when(F.col("type").isin("card", "ssn"), digits)
        .when(F.col("type") == "phone", phone)
        .when(F.col("type") == "iban", F.regexp_replace(m, " ", ""))
        .otherwise(m)
    )
    none = F.lit(None).cast("string")
    named = F.transform(plain, lambda w, i: part(F.lit("name"), F.lower(w), w, F.when(i < F.size(plain) - 1, gender)))
    return mentions.withColumn("type", kind).withColumn("parts", F.when(F.col("type") == "name", named).otherwise(F.array(part(F.col("type"), entity, none, none))))


def _genders(parts: DataFrame) -> DataFrame:
    """(type, entity, word): of the words of names the gender that the titles before them as given names agree on stands
    before the word (none for a word that is no given name); all else is its own entity."""
    of = parts.groupBy("type", F.col("entity").alias("word")).agg(F.count("given").alias("given"), F.count_if(F.col("given") == "f").alias("f"), F.count_if(F.col("given") == "m").alias("m"))
    one = F.when((F.col("f") > 0) & (F.col("m") == 0), "f:").when((F.col("m") > 0) & (F.col("f") == 0), "m:").otherwise("n:")
    mark = F.when(F.col("given") == 0, "").otherwise(one)
    return of.select("type", "word", F.when(F.col("type") == "name", F.concat(mark, "word")).otherwise(F.col("word")).alias("entity"))


def _as(raw: Column, new: Column) -> Column:
    """A word's surrogate with the capitals and the possessive of the word."""
    tail = F.regexp_extract(raw, _POSSESSIVE, 0)
    bare = F.regexp_replace(raw, _POSSESSIVE, "")
    return F.concat(F.when((F.upper(bare) == bare) & (F.length(bare) > 1), F.upper(new)).otherwise(new), tail)


def _named(mention: Column) -> Column:
    """The words of a name replaced one by one (``news`` has them in order); particles stay, initials get another letter."""
    words = F.split(F.regexp_replace(mention, _TITLE_LEAD, ""), " ")
    is_word = lambda w: w.rlike(rf"^{_WORD}$") & ~w.rlike(r"\.$")
    before = lambda i: F.size(F.filter(F.slice(words, F.lit(1), i), is_word))
    initial = lambda w: F.concat(F.element_at(F.array_except(F.split(F.lit("A B C D E F G H J K L M N P R S T V W"), " "), F.array(F.substring(w, 1, 1))), F.pmod(F.xxhash64("salt", w), F.lit(18)).cast("int") + 1), F.lit("."))
    return F.array_join(F.transform(words, lambda w, i: F.when(is_word(w), _as(w, F.get("news", before(i)))).when(w.rlike(r"\.$"), initial(w)).otherwise(w)), " ")


def _written() -> Column:
    """The surrogate in the format of its mention: what the canonical form dropped comes back."""
    m, s = F.col("mention"), F.regexp_replace("surrogate", r"^\+", "")
    kept = F.length(F.regexp_replace(m, r"[^A-Z0-9]", "")) - F.length(s)  # country code digits before the entity

    def fill(c: Column, i: Column) -> Column:
        at = F.length(F.regexp_replace(F.substring(m, F.lit(1), i + 1), r"[^A-Z0-9]", "")) - kept
        return F.when(c.rlike("[A-Z0-9]") & (at > 0), F.substring(s, at, F.lit(1))).otherwise(c)

    filled = F.array_join(F.transform(F.filter(F.split(m, ""), lambda c: c != ""), fill), "")
    return (
        F.when(F.col("type").isin("card", "ssn", "phone", "iban"), filled)
        .when(F.col("type") == "secret", F.concat(F.regexp_extract(m, _SECRET_LEAD, 0), s))
        .when(F.col("type") == "name", F.concat(F.regexp_extract(m, _TITLE_LEAD, 0), _named(m)))
        .otherwise(s)
    )


def _plain(entity: str = "entity") -> Column:
    """An entity as its surrogate would be written: without the mark of its gender."""
    return F.when(F.col("type") == "name", F.initcap(F.regexp_replace(entity, "^[fmn]:", ""))).otherwise(F.col(entity))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(type, entity, surrogate) with distinct surrogates in each type, none of which is an entity of the table.

    Entities that draw a taken value draw again, until all have one: a format that is full grows. Repeated rows count
    once; an empty table gives an empty table.
    """
    entities = saved(entities.select("type", "entity").distinct())
    # a draw is settled when it is no entity and the first of its equals; the others draw again
    chosen, open_ = entities.select("type", "entity", F.lit("").alias("surrogate")).filter("false"), entities.withColumn("draw", F.lit(0))
    own, rounds = entities.select("type", _plain().alias("surrogate")), 0
    while True:
        drawn = _draw(open_, key)
        taken = own.unionByName(chosen.select("type", "surrogate")).distinct()
        # the least entity of a value has it: an aggregate, so that a value that many draw is no window
        least = drawn.groupBy("type", "surrogate").agg(F.min("entity").alias("_least"))
        met = drawn.join(least, ["type", "surrogate"]).join(taken.withColumn("_taken", F.lit(True)), ["type", "surrogate"], "left")
        drawn = saved(met.select("type", "entity", "draw", "surrogate", (F.col("_taken").isNull() & (F.col("_least") == F.col("entity"))).alias("_free")))
        chosen = chosen.unionByName(drawn.filter("_free").select("type", "entity", "surrogate"))
        open_ = drawn.filter("not _free").select("type", "entity", (F.col("draw") + 1).alias("draw"))
        if open_.isEmpty():
            return chosen
        rounds += 1
        if rounds % GATHERED == 0:
            chosen = saved(chosen)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with every mention replaced, plus _entities (mentions replaced) and _types (their types, sorted).

    In a document with names behind titles, the words of these names are replaced wherever they stand with their capitals
    and nothing of a word around them; such bare words do not count as mentions. Null and empty texts have no mentions
    and stay as they are; texts of any length are read whole; repeated rows are replaced alike; a document with a null
    doc_id is treated like any other. Equal entities get equal surrogates in all documents. Columns _entities and
    _types of the table are replaced, all others stay whatever their names. An empty table gives an empty table.
    """
    raw = boxed(docs).withColumn("text", F.col("text").cast("string"))
    text, hinted = F.col("text"), F.col("text").rlike(_HINT)
    plain = raw.filter(~F.coalesce(hinted & text.rlike(_ANY), F.lit(False))).withColumns({"_entities": F.lit(0).cast("long"), "_types": F.lit("")})
    # a generator of one row: the filter does not search the text again
    found = raw.filter(hinted).select("row", "text", F.explode(F.array(F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)))).alias("found"))
    marked = saved(found.filter(F.size("found") > 0).withColumn("key", F.monotonically_increasing_id()))
    mentions = marked.select("key", F.posexplode("found").alias("pos", "mention"))
    typed = saved(_typed(mentions.select("mention").distinct()))
    parts = saved(typed.select("mention", F.posexplode("parts").alias("at", "part")).select("mention", "at", "part.*"))
    genders = saved(_genders(parts))
    drawn = surrogates(genders, key).join(genders, ["type", "entity"]).select("type", "word", "surrogate")
    drawn = parts.join(drawn.withColumnRenamed("word", "entity"), ["type", "entity"])
    listed = drawn.groupBy("mention").agg(F.array_sort(F.collect_list(F.struct("at", "surrogate", "raw"))).alias("x"))
    listed = listed.select("mention", F.transform("x", lambda x: x["surrogate"]).alias("news"), F.filter(F.transform("x", lambda x: F.struct(x["raw"].alias("raw"), _as(x["raw"], x["surrogate"]).alias("new"))), lambda x: x["raw"].isNotNull()).alias("bare"))
    named = typed.select("mention", "type").join(listed, "mention").withColumn("surrogate", F.array_join("news", " ")).withColumn("salt", F.lit(key))
    written = saved(named.select("mention", "type", _written().alias("new"), "bare"))
    size = written.agg(F.coalesce(F.sum(F.octet_length("mention").cast("long") * 4 + 96), F.lit(0)).alias("n")).first()["n"]
    met = mentions.join(F.broadcast(written) if fits_broadcast(size, 1) else written, "mention")
    new = met.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("news"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("_types"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("bare")))).alias("bare"))
    pieces = F.split(text, _ANY, -1)
    # bare words are looked for in what stands between the mentions
    alone = lambda t: F.aggregate("bare", t, lambda a, b: F.regexp_replace(a, F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), b["raw"], F.lit(r"\E(?![\p{L}\p{N}])")), b["new"]))
    spelled = F.array_join(F.zip_with(F.transform(pieces, alone), F.concat(F.transform("news", lambda n: n["new"]), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    changed = marked.join(new, "key").withColumns({"text": spelled, "_entities": F.size("news").cast("long")})
    both = plain.select("row", "text", "_entities", "_types").unionByName(changed.select("row", "text", "_entities", "_types"))
    return unboxed(both, docs, "_entities", "_types")
