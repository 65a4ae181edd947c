"""Personal data and secrets replaced by keyed surrogates of the same kind.

Entities are found by patterns. An entity's canonical form (digits of a phone or card number,
lower-case letters of an address, each word of a name) decides its surrogate through a keyed
hash, so the same entity gets the same surrogate wherever and however it is written, and
nobody without the key can recompute it. Surrogates keep kind and format: digits stay digits,
letters letters, separators, case, length, country code and valid checksums of cards and accounts
stay; names keep gender and script.

Names are found after a title, and then wherever the same document repeats them, in full or in
part, without one. All titles that a name stands after decide its gender, so it has a single
surrogate.

Surrogates are checked before use: one that equals another entity's surrogate, or a real
entity, is drawn again, round by round, until all differ. Distinct entities therefore stay
distinct, over the whole table. Where a format has no free value left, its surrogates grow.

Only documents with entities move, and of their entities only the distinct ones are mapped.
All of it is built-in functions.

Rows: a null text stays null and an empty one empty; repeated rows are replaced alike; null
ids and extra columns are kept; texts of any length are replaced whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fathomix.operators.skew import lookup_join
from fathomix.session import materialize, release

# Draws of one entity before giving up: the format then has no free value left.
MAX_ROUNDS = 64
# After every so many draws an entity's surrogate gets one more character.
GROW_EVERY = 8

_MALE = r"(?:Mr|Mister|Herrn?|Monsieur|Señor|Sr|господин|г-н)"
_FEMALE = r"(?:Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Srta|госпожа|г-жа)"
_NEUTRAL = r"(?:Dr|Prof|Mx)"
# An apostrophe belongs to a name before another letter, but not as the sign of possession.
_NAME = r"\p{Lu}(?:\p{L}|['’](?![sS](?!\p{L}))(?=\p{L}))*+(?:-\p{Lu}(?:\p{L}|['’](?![sS](?!\p{L}))(?=\p{L}))*+)*+"
_PARTICLE = r"(?:de|del|della|der|den|des|di|da|do|dos|du|la|las|le|los|van|von|vom|zu|zur|bin|ibn|al|el|y)"
# Titles in any case; the verb "miss" is none.
_TITLE = rf"(?!miss )(?iu:{_MALE}|{_FEMALE}|{_NEUTRAL})(?:\. ?| )"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_HEX = r"[0-9a-fA-F]{1,4}"

# Patterns by kind; where several match at one place, the first kind counts.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    # All small letters count as a name after the plainest titles only.
    "person": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE}(?:{_PARTICLE} )*{_NAME}(?: (?:{_PARTICLE} )*{_NAME}){{0,3}}|(?:mr|mrs|ms)(?:\. ?| )\p{{Ll}}{{2,}}+)",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-fA-F]{32,128}|(?:sk|pk|ghp|gho|xox[bp])[-_][0-9A-Za-z_-]{16,128}|AKIA[0-9A-Z]{16})(?![\p{L}\p{N}])",
    # Eight digits at least, so that a row of capital words is none.
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?=(?:[ A-Z]*+[0-9]){8})(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![\p{L}\p{N}])",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:.])(?=[a-fA-F:]*[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|(?:{_HEX}:){{2,7}}:)(?![\p{{L}}\p{{N}}:])",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    # A number with a country code is found through whatever noise stands between its groups.
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}|\+[0-9]{1,3}(?:[^\p{L}\p{N}\n]{1,8}[0-9]{2,4}){3}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|(?<![.,])0[0-9]{2,4}[ /][0-9]{3,4}[ -]?[0-9]{3,4}(?:[ -][0-9]{2,4})?)(?![0-9])",
}
# What a kind's first character can be; most places in a text fail this test at once.
_FIRST = {
    "email": r"[\p{L}\p{N}._%+-]", "person": "[MmHhSsFfDdPpГг]", "secret": "[0-9a-fA-FsgpxK]", "iban": "[A-Z]",
    "ipv6": "[0-9a-fA-F]", "ip": "[0-9]", "card": "[0-9]", "ssn": "[0-9]", "phone": "[0-9+(]",
}

# Parts of invented names, by script: first and later syllables, endings of given names by
# gender, endings of surnames.
_PARTS = {
    "latin": {
        "first": ["Al", "Be", "Ca", "Da", "El", "Fa", "Ga", "He", "Il", "Jo", "Ka", "Le", "Ma", "No", "Or", "Pe",
                  "Ro", "Sa", "Te", "Vi"],
        "next": ["bri", "dor", "fan", "gar", "len", "mar", "nel", "pol", "ran", "sel", "tor", "van", "wen", "zel"],
        "m": ["as", "er", "in", "o", "us"], "f": ["a", "ia", "ina", "elle", "ette"], "u": ["e", "y", "is", "el", "an"],
        "surname": ["ard", "berg", "er", "feld", "ino", "lund", "mann", "ov", "sen", "well"],
    },
    "cyrillic": {
        "first": ["Ал", "Бо", "Ва", "Да", "Ел", "Жа", "За", "Ин", "Ка", "Ле", "Ма", "Но", "Ол", "Ро", "Са", "Та"],
        "next": ["бри", "вел", "гар", "дан", "лен", "мир", "нел", "пол", "рад", "сен", "тор", "фил"],
        "m": ["ий", "ан", "ел", "ич", "ор"], "f": ["а", "ия", "ина", "ея", "ана"], "u": ["и", "о", "ей", "ай", "эль"],
        "surname": ["енко", "ин", "ко", "ов", "ский", "ук", "ын", "янц"],
    },
    "greek": {
        "first": ["Αλ", "Βα", "Γε", "Δη", "Ελ", "Ζω", "Θε", "Ιω", "Κα", "Λε", "Μα", "Νι", "Πε", "Σα"],
        "next": ["βρι", "δορ", "λεν", "μαρ", "νελ", "πολ", "ραν", "σελ", "τορ", "φαν"],
        "m": ["ος", "ης", "ας", "ων", "ευς"], "f": ["α", "η", "ια", "ινα", "ω"], "u": ["ι", "υ", "ις", "ελ", "αν"],
        "surname": ["ακης", "αδης", "ιδης", "πουλος", "ος", "ου"],
    },
}
# Kinds whose separators do not belong to the entity.
_DIGITS_ONLY = ("phone", "card", "ssn")
# A country code that the same phone number is also written without.
_HOME_CODE = r"^\+1(?=[^0-9])"


def any_entity(kinds: Sequence[str] = tuple(PATTERNS)) -> str:
    """One pattern for all ``kinds``."""
    return "|".join(f"(?={_FIRST[k]})(?:{PATTERNS[k]})" for k in kinds)


def _kind(match: Column, kinds: Sequence[str]) -> Column:
    """The kind of a match; what no pattern matches alone is a name without its title."""
    cases = [F.when(match.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k)) for k in kinds]
    return F.coalesce(*cases, F.lit("person"))


def mentions(found: Column) -> Column:
    """A pattern for the names among a document's entities where they stand without a title; null if there are none."""
    people = F.filter(found, lambda m: m.rlike(f"^(?:{PATTERNS['person']})$"))
    full = F.transform(people, lambda m: F.trim(F.regexp_replace(m, f"^{_TITLE}", "")))
    words = F.filter(F.flatten(F.transform(full, lambda n: F.split(n, " +"))),
                     lambda w: w.rlike(r"^\p{Lu}") & (F.length(w) > 1))
    written = F.concat(F.filter(full, lambda n: n.rlike(r"^\p{Lu}.* ")), words)
    names = F.array_distinct(F.concat(written, F.transform(written, F.upper), F.transform(written, F.initcap)))
    # In capitals or not, longer names first. Names are letters, hyphens and apostrophes, which mean themselves.
    ordered = F.transform(F.array_sort(F.transform(names, lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n")))), lambda x: x["n"])
    return F.when(F.size(ordered) > 0, F.concat(
        F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(ordered, "|"), F.lit(r")(?![\p{L}\p{N}])")))


def _parts(match: Column, kind: Column) -> Column:
    """Array of ``class, canonical``: what a match is made of, one element unless a name.

    The class of a name's word says where it stood and the gender of its title: ``given m``,
    ``surname``, ``mentioned`` without a title, or ``particle``, which stays.
    """
    titled = match.rlike(f"^{_TITLE}")
    names = F.split(F.trim(F.regexp_replace(match, rf"^{_TITLE}", "")), " +")
    gender = F.when(match.rlike(rf"^(?iu:{_FEMALE})(?:\.| )"), "f").when(match.rlike(rf"^(?iu:{_MALE})(?:\.| )"), "m").otherwise("u")
    last = F.size(names) - 1
    words = F.transform(names, lambda name, i: F.struct(
        F.when(name.rlike(f"^{_PARTICLE}$") & (i < last), F.lit("particle")).when(~titled, F.lit("mentioned"))
        .when(i == last, F.lit("surname")).otherwise(F.concat(F.lit("given "), gender)).alias("class"),
        F.lower(name).alias("canonical"),
    ))
    bare = F.when(kind.isin(*_DIGITS_ONLY), F.regexp_replace(F.regexp_replace(match, _HOME_CODE, ""), "[^0-9]", ""))
    bare = bare.when(kind == "iban", F.replace(match, F.lit(" "), F.lit(""))).otherwise(F.lower(match))
    return F.when(kind == "person", words).otherwise(F.array(F.struct(kind.alias("class"), bare.alias("canonical"))))


def settled_classes(parts: DataFrame) -> DataFrame:
    """Distinct ``space, canonical, class``: one class per name, by all titles it stands after in the table.

    Most places decide between given name and surname, and most titles with a gender decide on
    that; names of both genders alike, or of none, are neutral.
    """
    def times(name: str) -> Column:
        return F.count_if(F.col("class") == name)

    voted = parts.groupBy(_space(F.col("class")).alias("space"), "canonical").agg(
        F.min("class").alias("own"), times("surname").alias("s"), times("given m").alias("m"), times("given f").alias("f"),
        times("given u").alias("u"))
    gendered = F.when(F.col("m") > F.col("f"), F.lit("given m")).when(F.col("f") > F.col("m"), F.lit("given f")).otherwise(F.lit("given u"))
    name = F.when(F.expr("s > m + f + u OR s + m + f + u = 0"), F.lit("surname")).otherwise(gendered)
    return voted.select("space", "canonical", F.when(F.col("space") == "name", name).otherwise(F.col("own")).alias("class"))


def _space(name_class: Column) -> Column:
    """Entities of one space get different surrogates; all names share one."""
    return F.when(name_class.startswith("given") | name_class.isin("surname", "mentioned"), F.lit("name")).otherwise(name_class)


def _pick(seed: Column, draw: int | Column, values: Sequence[str]) -> Column:
    at = F.pmod(F.xxhash64(seed, F.lit(draw) if isinstance(draw, int) else draw), F.lit(len(values)))
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def _invented_name(seed: Column, name_class: Column, canonical: Column, attempt: Column) -> Column:
    def in_script(parts: dict[str, list[str]]) -> Column:
        middle = F.concat_ws("", F.transform(
            F.sequence(F.lit(0), F.floor(attempt / 8).cast("int")), lambda i: _pick(seed, i + 100, parts["next"])))
        ending = F.when(name_class == "surname", _pick(seed, 2, parts["surname"]))
        for gender in "mfu":
            ending = ending.when(name_class == f"given {gender}", _pick(seed, 2, parts[gender]))
        return F.concat(_pick(seed, 1, parts["first"]), middle, ending)

    return F.when(canonical.rlike(r"\p{IsCyrillic}"), in_script(_PARTS["cyrillic"])).when(
        canonical.rlike(r"\p{IsGreek}"), in_script(_PARTS["greek"])).otherwise(in_script(_PARTS["latin"]))


def _luhn_total(digits: Column) -> Column:
    """Checksum of a digit string, the last digit counted once."""
    return F.aggregate(
        F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(
            i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int"))),
        F.lit(0), lambda total, x: total + x)


def _redrawn(seed: Column, name_class: Column, canonical: Column, attempt: Column) -> Column:
    """Each digit and letter redrawn in its own class; hex stays hex and domains keep their ending.

    Late attempts are longer: numbers at their end, the others at their start.
    """
    hexed = ((name_class == "secret") & canonical.rlike("^[0-9a-f]+$")) | (name_class == "ipv6")
    first = F.when(name_class == "iban", F.lit(2)).when(
        (name_class == "phone") & canonical.startswith("0"), F.lit(1)).otherwise(F.lit(0))
    kept = F.when(name_class == "email", F.length(F.regexp_extract(canonical, r"\.[^.]*$", 0))).otherwise(F.lit(0))

    fixed = (name_class == "email") & ~F.left(canonical, F.length(canonical) - kept).rlike(r"[0-9\p{L}]")
    extra = F.when(name_class.isin("iban", "ipv6"), F.lit(0)).otherwise(
        F.floor(attempt / GROW_EVERY).cast("int") + fixed.cast("int"))
    valid = (name_class == "card") & (_luhn_total(canonical) % 10 == 0)
    canonical = F.when(name_class.isin(*_DIGITS_ONLY), F.concat(canonical, F.repeat(F.lit("0"), extra))).otherwise(
        F.concat(F.repeat(F.lit("a"), extra), canonical))

    def redraw(char: Column, i: Column) -> Column:
        draw = F.xxhash64(seed, i)
        digit = F.pmod(draw, F.lit(10)).cast("string")
        letter = F.chr(F.pmod(draw, F.when(hexed, F.lit(6)).otherwise(F.lit(26))) + F.when(name_class == "iban", F.lit(65)).otherwise(F.lit(97)))
        free = (i < F.length(canonical) - kept) & (i >= first)
        return F.when(free & char.rlike("[0-9]"), digit).when(free & char.rlike(r"\p{L}"), letter).otherwise(char)

    drawn = F.concat_ws("", F.transform(F.split(canonical, ""), redraw))
    octets = F.array_join(F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(F.xxhash64(seed, i), F.lit(254)) + 1).cast("string")), ".")
    base = F.concat(F.left(drawn, F.length(drawn) - 1), F.lit("0"))
    checked = F.concat(F.left(drawn, F.length(drawn) - 1), ((10 - _luhn_total(base) % 10) % 10).cast("string"))
    country, account = F.left(drawn, F.lit(2)), F.substring(drawn, 5, 64)
    account = F.concat(country, F.lpad(98 - _mod_97(F.concat(account, country, F.lit("00"))), 2, "0"), account)
    return F.when(name_class == "ip", octets).when(name_class == "iban", account).when(valid, checked).otherwise(drawn)


def _mod_97(text: Column) -> Column:
    """Remainder of the number that digits and letters (A is 10) spell."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda total, c: F.when(
        c.rlike("[0-9]"), (total * 10 + F.ascii(c) - 48) % 97).otherwise((total * 100 + F.ascii(c) - 55) % 97))


def _surrogate(key: str, attempt: int) -> Column:
    name_class, canonical = F.col("class"), F.col("canonical")
    seed = F.sha2(F.concat_ws("\u0001", F.lit(key), _space(name_class), canonical, F.lit(str(attempt))), 256)
    named = (name_class == "surname") | name_class.startswith("given")
    return F.when(named, _invented_name(seed, name_class, canonical, F.lit(attempt))).otherwise(
        _redrawn(seed, name_class, canonical, F.lit(attempt)))


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """``space, canonical, surrogate`` for distinct entities, all surrogates of a space different.

    ``entities`` is a stored table of ``class, canonical``, distinct within the class's space. In each round the pending
    entities draw a surrogate; one taken by a real entity or an earlier winner, or drawn
    twice, goes to the least canonical form at most, and the others draw again.
    """
    entities = entities.select("class", "canonical", _space(F.col("class")).alias("space"))
    real = entities.select("space", F.col("canonical").alias("taken"))
    settled: list[DataFrame] = []
    pending = entities
    for attempt in range(MAX_ROUNDS):
        drawn = pending.withColumn("surrogate", _surrogate(key, attempt))
        taken = F.lower("surrogate").alias("taken")
        # A number's real form has no letters, but an account's has capitals.
        free = drawn.select("*", taken).join(real.select("space", F.lower("taken").alias("taken")), ["space", "taken"], "left_anti")
        for won in settled:
            free = free.join(won.select("space", taken), ["space", "taken"], "left_anti")
        winners = materialize(free.groupBy("space", "taken").agg(
            F.min(F.struct("canonical", "surrogate")).alias("w")).select("space", "w.canonical", "w.surrogate"))
        settled.append(winners)
        left = materialize(pending.join(winners, ["space", "canonical"], "left_anti"))
        if attempt:
            release(pending)
        pending = left
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, settled)
    raise ValueError(f"no free surrogate after {MAX_ROUNDS} draws; an entity's format has too few values")


def _written(match: Column, kind: Column, parts: Column) -> Column:
    """A match's surrogate in the match's own format; ``parts`` are its surrogates in order."""
    own_names = F.regexp_replace(match, rf"^{_TITLE}", "")
    upper = (own_names == F.upper(own_names)) & (own_names != F.lower(own_names))
    names = F.concat_ws(" ", parts)
    cased = F.when(upper, F.upper(names)).when(own_names == F.lower(own_names), F.lower(names)).otherwise(names)
    titled = F.concat(F.regexp_extract(match, rf"^{_TITLE}", 0), cased)
    whole = F.element_at(parts, 1)
    chars = F.split(match, "")
    skipped = F.when(match.rlike(_HOME_CODE), F.lit(1)).otherwise(F.lit(0))
    grown = F.greatest(F.length(whole) - F.length(F.lower(match)), F.lit(0))
    tail = F.substring(whole, F.length(F.regexp_replace(match, "[^0-9]", "")) - skipped + 1, F.length(whole))

    def char(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(match, F.lit(1), i), "[^0-9]", ""))
        plus = F.length(F.regexp_replace(F.regexp_extract(match, r"^\+[0-9]{1,3}(?=[^0-9])", 0), "[^0-9]", ""))
        digits = F.when(
            c.rlike("[0-9]") & (before >= plus), F.substring(whole, before - skipped + 1, F.lit(1))).otherwise(c)
        own = F.substring(whole, i + grown + 1, F.lit(1))
        cased = F.when((c != F.lower(c)) & (c == F.upper(c)), F.upper(own)).otherwise(own)
        return F.when(kind.isin(*_DIGITS_ONLY), digits).otherwise(cased)

    formatted = F.concat_ws("", F.transform(chars, char))
    formatted = F.when(kind.isin(*_DIGITS_ONLY), F.concat(formatted, tail)).otherwise(
        F.concat(F.left(whole, grown), formatted))
    grouped = F.concat_ws("", F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.substring(
        whole, F.length(F.replace(F.substring(match, F.lit(1), i), F.lit(" "), F.lit(""))) + 1, F.lit(1)))))
    return F.when(kind == "person", titled).when(kind == "ip", whole).when(kind == "iban", grouped).otherwise(formatted)


def replace_entities(docs: DataFrame, key: str, kinds: Sequence[str] = tuple(PATTERNS), text: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``replaced``, the number of entities in it.

    ``key`` is the secret; with the same key a table gets the same surrogates again. Writes
    the documents with entities and the mapping when called.
    """
    if not key:
        raise ValueError("surrogates need a key")
    pattern = any_entity(kinds)
    column = F.col(f"`{text}`")
    names = [f"`{c}`" for c in docs.columns if c != "replaced"]
    own = F.col(f"row.`{text}`")
    # The only pass over all texts; what follows reads documents with entities.
    scanned = materialize(docs.select(
        F.struct(*[F.col(c) for c in names]).alias("row"),
        F.coalesce(F.regexp_extract_all(column, F.lit(pattern), F.lit(0)), F.array().cast("array<string>")).alias("found")))
    named = F.concat_ws("|", F.lit(pattern), mentions(F.col("found")) if "person" in kinds else F.lit(None).cast("string"))
    hits = materialize(scanned.filter(F.size("found") > 0).select("row", named.alias("pattern")).select(
        F.monotonically_increasing_id().alias("id"), "row", "pattern",
        F.regexp_extract_all(own, F.col("pattern"), F.lit(0)).alias("found")))
    spans = hits.select("id", F.posexplode("found").alias("at", "match")).withColumn("kind", _kind(F.col("match"), kinds))
    parts = materialize(spans.select(
        "id", "at", "match", "kind", F.posexplode(_parts(F.col("match"), F.col("kind"))).alias("part", "p")
    ).select("id", "at", "match", "kind", "part", _space(F.col("p.class")).alias("space"), "p.class", "p.canonical"))
    entities = materialize(settled_classes(parts.filter("class <> 'particle'")))
    table = materialize(surrogate_table(entities, key))
    mapped = lookup_join(parts.drop("class"), table, ["space", "canonical"], "left", salt_by=["id", "at", "part"])
    written = mapped.groupBy("id", "at", "match", "kind").agg(
        F.sort_array(F.collect_list(F.struct("part", F.coalesce("surrogate", "canonical").alias("surrogate")))).alias("parts")
    ).select("id", "at", _written(F.col("match"), F.col("kind"), F.col("parts.surrogate")).alias("out"))
    per_row = written.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "out"))).alias("outs"))
    pieces = F.split(own, F.col("pattern"), -1)
    rebuilt = F.concat(
        F.concat_ws("", F.zip_with(F.slice("pieces", F.lit(1), F.size("outs")), F.col("outs.out"), lambda a, b: F.concat(a, b))),
        F.element_at("pieces", -1),
    )
    done = hits.join(per_row, "id").select("row", "outs", pieces.alias("pieces")).select(
        *[rebuilt.alias(text) if c == f"`{text}`" else F.col(f"row.{c}") for c in names],
        F.size("outs").cast("long").alias("replaced"),
    )
    rest = scanned.filter(F.size("found") == 0).select(*[F.col(f"row.{c}") for c in names], F.lit(0).cast("long").alias("replaced"))
    return rest.unionByName(done)
