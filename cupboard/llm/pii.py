"""Personal data replaced by surrogates, in built-in functions only.

Detected entities are e-mail addresses, IPv4 addresses, phone numbers, card and account numbers, IBANs, social
security numbers, access secrets, names after a title, and the surnames among these wherever the same text repeats
them. A surrogate is drawn by a keyed hash of the entity, so one entity has one surrogate in the whole
corpus, and without the key it cannot be traced back. It keeps the entity's type and format: digits stay digits,
letters keep their case, separators stay, addresses stay valid, a card number that passes the Luhn check still does,
an IBAN has valid check digits, and a name keeps gender and script. The distinct entities of the corpus are checked against each other: two entities
never share a surrogate and no surrogate is itself an entity of the corpus; whichever fails is drawn again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cupboard.session import write_and_reload

# Titles that announce a name, by the gender they state.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mme", "Signora", "Госпожа", "Κυρία"],
    "m": ["Mr", "Mister", "Herr", "Señor", "Monsieur", "Signor", "Господин", "Κύριος"],
}
_TITLE = "(?:" + "|".join(t for group in TITLES.values() for t in group) + ")"
# A capitalised word; hyphens and apostrophes join further capitalised parts.
_WORD = r"\p{Lu}(?:[\p{L}\p{M}]++|(?=['’]\p{Lu}))(?:['’-]\p{Lu}[\p{L}\p{M}]*+){0,3}"
_PARTICLE = r"(?:(?:von|van|zu|zum|zur|de|del|della|der|den|dem|di|da|do|dos|du|la|le|el|al|bin|ibn|ben|y|и) ){1,3}"
_INITIALS = r"(?:\p{Lu}\. ?){1,3}"
_NEXT = rf" (?:{_INITIALS})?(?:{_PARTICLE})?(?!{_TITLE}(?!\p{{L}})){_WORD}"


def _national(separator: str) -> str:
    """A number with the trunk digit 0 and 9 to 12 digits in all, in groups of two or more or in one."""
    digits = rf"(?:{separator}?\d)"
    return rf"0[1-9](?={digits}{{7,10}}(?!{separator}?\d))\d{{0,9}}(?:{separator}\d{{2,8}}){{0,4}}(?!{separator}?\d)"


# What a secret without quotes may hold; its last character is no full stop or the like, which ends the sentence.
_SECRET = r"(?![A-Za-z]{2,10}://)[A-Za-z0-9_+/=.@!#$%^*?~:-]{7,}[A-Za-z0-9_+/=-]"
_SECRET_KEY = (
    r"(?i:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)"
    r"(?:[_-][A-Za-z0-9_-]{1,20}|(?i:key|token|value|hash))?")

PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)",
    # After its first group, a group in blanks holds a digit or stands before one that does.
    "iban": r"(?<![\w-])[A-Z]{2}\d{2}(?=(?: ?[A-Z0-9]){11})(?:[A-Z0-9]{4}\d{5}[A-Z0-9]{2,21}|(?: [A-Z0-9]{4})(?: (?:(?=[A-Z]{0,3}\d)[A-Z0-9]{4}|[A-Z]{4}(?= [A-Z]{0,3}\d))){1,6}(?: (?=[A-Z]{0,2}\d)[A-Z0-9]{1,3})?)(?![\w-])",
    "ssn": r"(?<![\w.+-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "number": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){4,13}"
             r"|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,3}"
             r"|(?:1[ .-])?(?:\(\d{3}\) ?\d{3}[ .-]\d{4}|(?<!\d\.)(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\d{3} \d{3} \d{4}))"
             rf"|(?<![.-])(?:{_national(' ')}|{_national('-')}|{_national('[.]')})(?![:]))(?![\w-]|\.\d)",
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
              r"|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{4,}+(?:\.[A-Za-z0-9_-]++){0,3}"
              # The short look-behinds fail first nearly everywhere.
              rf"|(?<=[=:\"'\s])(?<=[=:\"']|[=:]\s{{1,3}})(?<={_SECRET_KEY}\\?[\"']?\s{{0,3}}[=:]{{1,2}}>?\s{{0,3}}\\?[\"']?){_SECRET}",
    "name": rf"(?<!\p{{L}}){_TITLE}\.? (?:{_INITIALS})?(?:{_PARTICLE})?{_WORD}(?:{_NEXT}){{0,3}}",
}
# Secrets come first, so that a value which begins like a number is taken as a whole.
ANY = "|".join(f"(?:{PATTERNS[k]})" for k in sorted(PATTERNS, key=lambda k: k != "secret"))

# Surrogate names are built from syllables of the name's own script (fixed values).
SCRIPTS = {
    r"\p{IsLatin}": ("b d f g h k l m n p r s t v z", "a e i o u", {"f": "na la ria", "m": "ro nus tor", "": "mer lund vik"}),
    r"\p{IsCyrillic}": ("б в г д з к л м н п р с т", "а е и о у", {"f": "на ла рия", "m": "рон лан тор", "": "рук дал вик"}),
    r"\p{IsGreek}": ("β γ δ κ λ μ ν π ρ σ τ", "α ε ι ο", {"f": "να λα ρια", "m": "ρος νος τος", "": "κης δης λης"}),
}
FORMAT_ATTEMPTS = 12


def _draw(seed: Column, at: Column, below: Column | int) -> Column:
    """A whole number below ``below``, from the keyed hash of ``seed`` and a place in the surrogate."""
    digest = F.sha2(F.concat_ws("\x01", seed, at.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint"), F.lit(below).cast("bigint") if isinstance(below, int) else below)


def _pick(options: list[str], seed: Column, at: Column) -> Column:
    return F.get(F.array(*[F.lit(o) for o in options]), _draw(seed, at, len(options)).cast("int"))


def _scrambled(text: Column, seed: Column, letters: int = 26) -> Column:
    """Every digit and ASCII letter redrawn (from the first ``letters``), case kept; a leading digit that is not 0
    stays so; the rest unchanged."""
    def one(c, i):
        return (
            F.when(c.rlike("[1-9]") & (i == 0), (_draw(seed, i, 9) + 1).cast("string"))
            .when(c.rlike("[0-9]"), _draw(seed, i, 10).cast("string"))
            .when(c.rlike("[a-z]"), F.char(_draw(seed, i, letters) + 97))
            .when(c.rlike("[A-Z]"), F.char(_draw(seed, i, letters) + 65)).otherwise(c))

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _email(text: Column, seed: Column) -> Column:
    """The last label of the domain stays."""
    last = F.regexp_extract(text, r"(\.[A-Za-z]+)$", 1)
    return F.concat(_scrambled(F.regexp_replace(text, r"\.[A-Za-z]+$", ""), seed), last)


def _ip(text: Column, seed: Column) -> Column:
    """Octets keep their number of digits."""
    def octet(part, i):
        return (
            F.when(F.length(part) == 1, _draw(seed, i, 9) + 1).when(F.length(part) == 2, _draw(seed, i, 90) + 10)
            .otherwise(_draw(seed, i, 155) + 100).cast("string"))

    return F.array_join(F.transform(F.split(text, r"\."), octet), ".")


def _phone(text: Column, seed: Column) -> Column:
    """The country code stays where a separator ends it; of a number in one run, the first digit does."""
    code = F.regexp_extract(text, r"^(\+\d{1,3}(?=[ .(-])|\+\d)?", 1)
    return F.concat(code, _scrambled(F.substr(text, F.length(code) + 1), seed))


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a text of digits."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(
        i % 2 == 1, F.lit(2) * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10


def _number(text: Column, seed: Column) -> Column:
    """The first digit, which names the issuer, stays; the check digit is set if the original passes the Luhn check."""
    drawn = F.concat(F.substring(text, 1, 1), F.substr(_scrambled(text, seed), F.lit(2)))
    digits = F.regexp_replace(drawn, "[^0-9]", "")
    unchecked = F.concat(F.substr(digits, F.lit(1), F.length(digits) - 1), F.lit("0"))
    check = F.pmod(10 - _luhn(unchecked), F.lit(10)).cast("string")
    passes = _luhn(F.regexp_replace(text, "[^0-9]", "")) == 0
    return F.when(passes, F.concat(F.substr(drawn, F.lit(1), F.length(drawn) - 1), check)).otherwise(drawn)


def _iban(text: Column, seed: Column) -> Column:
    """The country stays; the check digits follow from the rest."""
    drawn = F.concat(F.substring(text, 1, 2), F.lit("00"), F.substr(_scrambled(text, seed), F.lit(5)))
    plain = F.replace(drawn, F.lit(" "), F.lit(""))
    moved = F.split(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4)), "")
    rest = F.aggregate(moved, F.lit(0), lambda r, c: F.pmod(
        F.when(c.rlike("[0-9]"), r * 10 + F.ascii(c) - 48).otherwise(r * 100 + F.ascii(c) - 55), F.lit(97)))
    check = F.lpad((98 - rest).cast("string"), 2, "0")
    return F.concat(F.substring(text, 1, 2), check, F.substr(drawn, F.lit(5)))


def _secret(text: Column, seed: Column) -> Column:
    """A key's public prefix stays, and hexadecimal digits stay hexadecimal."""
    prefix = F.regexp_extract(text, "^(AKIA)?", 1)
    hexadecimal = F.when(text.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), _scrambled(text, seed, 6))
    return F.coalesce(hexadecimal, F.concat(prefix, _scrambled(F.substr(text, F.length(prefix) + 1), seed)))


def _syllable(consonants: str, vowels: str, seed: Column):
    return lambda i: F.concat(_pick(consonants.split(), seed, 2 * i), _pick(vowels.split(), seed, 2 * i + 1))


def _name(text: Column, gender: Column, attempt: Column, seed: Column) -> Column:
    """A capitalised word of the same script with an ending for the gender; scripts without syllables are scrambled."""
    made = _scrambled(text, seed)
    for script, (consonants, vowels, endings) in SCRIPTS.items():
        syllables = F.transform(F.sequence(F.lit(1), 2 + F.floor(attempt / 3).cast("int")), _syllable(consonants, vowels, seed))
        stem = F.array_join(syllables, "")
        ending = reduce(lambda other, g: F.when(gender == g, _pick(endings[g].split(), seed, F.lit(0))).otherwise(other),
                        ("f", "m"), _pick(endings[""].split(), seed, F.lit(0)))
        made = F.when(text.rlike(rf"^(?:{script}|[\p{{M}}'’-])+$"), F.initcap(F.concat(stem, ending))).otherwise(made)
    return made


def surrogate(kind: Column, gender: Column, text: Column, attempt: Column, key: str) -> Column:
    """The ``attempt``-th surrogate of an entity.

    After ``FORMAT_ATTEMPTS`` draws the format has too few values for its entities; the surrogate then grows by keyed
    hexadecimal digits.
    """
    seed = F.sha2(F.concat_ws("\x01", F.lit(key), kind, gender, text, attempt.cast("string")), 256)
    drawn = (
        F.when(kind == "email", _email(text, seed)).when(kind == "ip", _ip(text, seed))
        .when(kind == "phone", _phone(text, seed)).when(kind == "number", _number(text, seed))
        .when(kind == "iban", _iban(text, seed)).when(kind == "ssn", _scrambled(text, seed))
        .when(kind == "secret", _secret(text, seed)).otherwise(_name(text, gender, attempt, seed)))
    grown = F.concat(drawn, F.lit("-"), F.substr(seed, F.lit(1), F.least(F.lit(32), 4 * (attempt - FORMAT_ATTEMPTS + 1))))
    return F.when(attempt < FORMAT_ATTEMPTS, drawn).otherwise(grown)


def _kind(mention: Column) -> Column:
    """The first type whose pattern matches the mention as a whole; what only its context gives away is a secret."""
    kinds = F.lit("secret")
    for kind in reversed([k for k in PATTERNS if k != "secret"]):
        kinds = F.when(mention.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(kinds)
    return F.when(mention.rlike("^AKIA[0-9A-Z]{16}$"), "secret").otherwise(kinds)


def _with_repeats(surnames: Column) -> Column:
    """``ANY``, extended by the surnames of a text (joined by ``|``, longer ones first) as whole words."""
    edge = r"[\p{L}\p{M}\p{N}_]"
    return F.when(surnames == "", ANY).otherwise(F.concat(F.lit(rf"{ANY}|(?<!{edge})(?:"), surnames, F.lit(rf")(?!{edge})")))


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, surnames, at, kind, units) of every mention, ``at`` counting from 0 in each text.

    ``units`` are the parts that get a surrogate of their own, with the text that stays before them: the words of a
    name (all but the last are given names and have the title's gender), else the whole mention. A surname alone,
    with or without a title, and the same surname in a full name are thereby one entity. ``surnames`` are those of the
    text, joined by ``|``.
    """
    named, last = F.lit(rf"^{_TITLE}\.? "), F.lit(rf" ({_WORD})$")
    first = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("found"))
    families = F.transform(F.filter("found", lambda m: F.regexp_like(m, named)), lambda m: F.element_at(F.regexp_extract_all(m, last, F.lit(1)), -1))
    # In falling order a name stands before those it begins with.
    listed = F.array_join(F.reverse(F.array_sort(F.array_distinct(families))), "|")
    first = first.select("doc_id", "text_hash", "text", "found", F.coalesce(listed, F.lit("")).alias("surnames"))
    # Only texts with names are searched again, for the bare repeats.
    again = F.regexp_extract_all("text", _with_repeats(F.col("surnames")), F.lit(0))
    found = first.select("doc_id", "text_hash", "surnames", F.when(F.col("surnames") == "", F.col("found")).otherwise(again).alias("found"))
    # The outer form: for the inner one Spark adds a filter that would search every text once more.
    each = found.select("doc_id", "text_hash", "surnames", F.posexplode_outer("found").alias("at", "mention"))
    repeat = F.array_contains(F.split("surnames", r"\|"), F.col("mention"))
    each = each.where("mention is not null").withColumn("kind", F.when(repeat, "name").otherwise(_kind(F.col("mention"))))
    title = F.regexp_extract("mention", rf"^({_TITLE}\.? )", 1)
    gender = F.when(title.rlike("^(?:" + "|".join(TITLES["f"]) + r")\.? $"), "f").otherwise("m")
    rest = F.substr(F.col("mention"), F.length(title) + 1)
    parts, gaps = F.regexp_extract_all(rest, F.lit(_WORD), F.lit(0)), F.split(rest, _WORD)  # initials and particles stay

    def unit(before, kind, gender, text):
        return F.struct(before.alias("before"), kind.alias("kind"), gender.alias("gender"), text.alias("text"))

    blank, kind = F.lit(""), F.col("kind")
    name = F.transform(parts, lambda w, i: unit(
        F.concat(F.when(i == 0, title).otherwise(""), F.get(gaps, i)), F.lit("name"),
        F.when(i < F.size(parts) - 1, gender).otherwise(""), w))
    units = F.when(kind == "name", name).otherwise(F.array(unit(blank, kind, blank, F.col("mention"))))
    return each.select("doc_id", "text_hash", "surnames", "at", "kind", units.alias("units"))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, gender, text, surrogate) for distinct entities: surrogates differ from each other and from every entity.

    Each round draws for the entities still open. A draw stands if it is no entity's text, nobody holds it, and no
    smaller open entity drew it too. The rounds shrink by the share of collisions; from ``FORMAT_ATTEMPTS`` on draws
    grow longer, so the rounds end.
    """
    entities = write_and_reload(entities)
    taken = entities.select(F.col("text").alias("drawn")).distinct()
    waiting, settled, attempt = entities, None, 0
    while True:
        drawn = waiting.withColumn("drawn", surrogate(F.col("kind"), F.col("gender"), F.col("text"), F.lit(attempt), key))
        drawn = write_and_reload(drawn)
        free = drawn.join(taken, "drawn", "left_anti")
        order = F.struct("kind", "gender", "text")
        winners = free.groupBy("drawn").agg(F.min(order).alias("w")).select("w.*", F.col("drawn").alias("surrogate"))
        winners = write_and_reload(winners)
        settled = winners if settled is None else settled.unionByName(winners)
        waiting = write_and_reload(waiting.join(winners, ["kind", "gender", "text"], "left_anti"))
        if waiting.isEmpty():
            return settled
        taken = taken.unionByName(winners.select(F.col("surrogate").alias("drawn")))
        attempt += 1


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``n_entities`` and ``entity_types`` (count by type) added.

    Columns of those two names are replaced; a column ``n_chars`` follows the new text. NULL and empty texts and texts
    without entities come back unchanged with 0 entities; rows that share an id are told apart by their text.
    """
    docs = docs.drop("n_entities", "entity_types")
    found = write_and_reload(mentions(docs).distinct())
    units = found.select("doc_id", "text_hash", "surnames", "at", "kind", F.posexplode("units").alias("part", "unit"))
    units = units.select("doc_id", "text_hash", "surnames", "at", F.col("kind").alias("type"), "part", "unit.*")
    made = surrogates(units.select("kind", "gender", "text").distinct(), key)
    new = units.join(made, ["kind", "gender", "text"])
    # One row per text with entities: their surrogates in order. It is no longer than the text itself.
    parts = F.sort_array(F.collect_list(F.struct("at", "part", F.concat("before", "surrogate").alias("new"), "type")))
    by_text = new.groupBy("doc_id", "text_hash").agg(parts.alias("__parts"), F.max("surnames").alias("__surnames"))
    by_text = write_and_reload(by_text.withColumnsRenamed({"doc_id": "__doc", "text_hash": "__of"}))
    hashed = docs.withColumn("__hash", F.xxhash64("text"))
    # Always a sort-merge join: the texts' surrogates grow with the corpus, and the plan stays the same at every size.
    joined = hashed.join(by_text.hint("merge"), hashed["doc_id"].eqNullSafe(by_text["__doc"]) & (hashed["__hash"] == by_text["__of"]), "left")
    # The parts of one mention share "at"; a gap of the text goes before the first part of each.
    changed, none = F.col("__parts").isNotNull(), F.array().cast(by_text.schema["__parts"].dataType)
    rows = joined.withColumn("__gaps", F.when(changed, F.split(F.col("text"), _with_repeats(F.col("__surnames"))))).withColumn(
        "__heads", F.coalesce(F.filter("__parts", lambda p: p["part"] == 0), none))
    pieces = F.transform("__parts", lambda p: F.concat(F.when(p["part"] == 0, F.get(F.col("__gaps"), p["at"])).otherwise(""), p["new"]))
    filled = F.concat(F.array_join(pieces, ""), F.element_at("__gaps", -1))
    kinds = F.transform("__heads", lambda p: p["type"])
    counted = F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.struct(
        k.alias("key"), F.size(F.filter("__heads", lambda p: p["type"] == k)).alias("value")))
    out = rows.withColumn("text", F.when(changed, filled).otherwise(F.col("text")))
    out = out.withColumn("n_entities", F.size("__heads")).withColumn("entity_types", F.map_from_entries(counted))
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars")))
    return out.select(*docs.columns, "n_entities", "entity_types")
