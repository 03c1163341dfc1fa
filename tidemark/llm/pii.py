"""Surrogates for personal data, with DataFrame expressions only.

Entities are found by one pattern, classified, and brought to a canonical form, so that every writing of a
phone or card number, and every mention of a person, is one entity (coreference). A surrogate is a keyed
digest of type and canonical form, spelled in the entity's own format: digits for digits, letters for letters
of the same case, a card or account number that passes its check exactly if the original does, a private address
for a private one, a name of the gender that its title shows and in its script.

A person is named by a title and a family name, with or without a given name. Both names are entities of their
own, so "Mr John Smith" and "Mr Smith" keep one family name, in every document. Inside a text with such a mention
the same names without a title are replaced alike. Names that never carry a title in a text are not found there.

Distinctness: surrogates of all distinct entities are compared with one another and with the real entities
of their type; whoever collides draws again with the next attempt number until none does. Names and addresses grow
longer with the attempts; a private network address that finds no place moves within 10/8. An entity that has none
after ``LAST_ATTEMPT`` draws, because all surrogates of its format are taken, becomes a tag of kind and digest. The comparison is an aggregate and joins over distinct entities,
whatever their number; a frequent entity is one row there.

Defined results: null text stays null, empty text empty; null ids are kept; rows with equal id and text get
equal results; an empty table gives an empty result; extra columns pass through; long texts are handled whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import staged

# The patterns of the entity types (Java syntax), tried in this order at each place.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)"
CARD = r"(?<!\d)\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
SECRET = r"(?<![0-9A-Za-z])(?:(?=[a-f]*\d)[0-9a-f]{32,64}|(?=[A-F]*\d)[0-9A-F]{32,64})(?![0-9A-Za-z])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
MALE = r"(?:Mr|Mister|Sir|Herrn|Herr|Monsieur|Señor|Sr|Don|[Гг]-н|[Гг]осподин|Κύριος)"
FEMALE = r"(?:Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mlle|Señorita|Señora|Sra|Doña|[Гг]-жа|[Гг]оспожа|Κυρία)"
EITHER = r"(?:Dr|Professor|Prof|Rev|[Дд]-р|Δρ)"
TITLE = rf"(?:(?:{MALE}|{FEMALE}|{EITHER})\.? )+"
NAME = rf"(?<!\p{{L}}){TITLE}\p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, IP, CARD.replace(r"([ -]?)", "[ -]?").replace(r"\1", "[ -]?"), SSN, IBAN, SECRET, PHONE, NAME))

GIVEN = {
    ("m", "latin"): "Adrian Bruno Caspar Dario Emil Fabian Gregor Hugo Ivo Julius Konrad Leander Marius Nestor Oscar Pascal".split(),
    ("f", "latin"): "Alma Bianca Clara Delia Elena Flora Greta Hanna Irma Judith Katrin Livia Martha Nora Olivia Paula".split(),
    ("n", "latin"): "Alexis Andrea Charlie Dominique Eden Kim Luca Mika Noa Robin Sascha Toni Vivian Yael Sam Jules".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Игорь Кирилл".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Ксения Лидия Нина".split(),
    ("n", "cyrillic"): "Саша Женя Валя Шура".split(),
    ("m", "greek"): "Ανδρέας Γιώργος Δημήτρης Κώστας Μάριος Νίκος Πέτρος Στέφανος".split(),
    ("f", "greek"): "Άννα Βασιλική Δήμητρα Ελένη Ιωάννα Κατερίνα Μαρία Σοφία".split(),
    ("n", "greek"): "Αλεξ Χρις Μελ Νικ".split(),
}
SYLLABLES = {
    "latin": "ba de fi go lu ma ne pi ro su ta ve wi zo la ke".split(),
    "cyrillic": "ба де фи го лу ма не пи ро су та ве ви зо ла ке".split(),
    "greek": "βα δε φι γο λου μα νε πι ρο σου τα βε ξι ζο λα κε".split(),
}
LONGEST_NAME = 24  # syllables
LAST_ATTEMPT = 48  # from here on a tag stands for an entity whose format has no free surrogate


TITLES = ("Mr", "Mister", "Sir", "Ms", "Miss", "Herr", "Monsieur", "Señor", "Sr", "Don", "Madam", "Frau", "Mme", "Mlle", "Sra", "Doña", "Dr", "Prof", "Rev", "г-н", "Г-н", "г-жа", "Г-жа", "д-р", "Д-р", "осподин", "оспожа", "Κύρι", "Κυρία", "Δρ")


def _hint(t: Column) -> Column:
    """Whether a text can hold an entity at all: each has a digit, an @ or a title as it is spelled in ``TITLE``."""
    out = F.regexp_like(t, F.lit("[0-9@]"))
    for title in TITLES:
        out = out | t.contains(title)
    return out


def _kind(e: Column) -> Column:
    whole = lambda p: F.regexp_like(e, F.lit(f"^(?:{p})$"))
    out = F.when(e.contains("@"), "email")
    for name, p in (("ip", IP), ("card", CARD), ("ssn", SSN), ("iban", IBAN), ("secret", SECRET), ("phone", PHONE)):
        out = out.when(whole(p), name)
    return out.otherwise("name")


def _title(e: Column) -> Column:
    return F.regexp_extract(e, rf"^{TITLE}", 0)


def _names(e: Column) -> Column:
    """The names of a person's mention, without title and genitive."""
    return F.split(F.regexp_replace(F.substring(e, F.length(_title(e)) + 1, F.length(e)), "'s$", ""), " ")


def _parts(e: Column, kind: Column) -> Column:
    """The entities of a mention, as (kind, canonical): given and family name of a person, one of anything else."""
    digits = F.regexp_replace(e, "[^0-9]", "")
    title, names = _title(e), _names(e)
    gender = F.when(F.regexp_like(title, F.lit(rf"(?:^| ){FEMALE}\.? ")), "f").when(F.regexp_like(title, F.lit(rf"(?:^| ){MALE}\.? ")), "m").otherwise("n")
    one = lambda k, c: F.struct(k.alias("kind"), c.alias("canonical"))
    given, family = one(F.concat(F.lit("given_"), gender), F.element_at(names, 1)), one(F.lit("family"), F.element_at(names, -1))
    national = ~e.contains("+") & (F.length(digits) == 10)  # a number without a country code is of the plan with code 1
    canonical = (
        F.when(kind == "email", F.lower(e))
        .when(kind == "phone", F.when(national, F.concat(F.lit("+1"), digits)).otherwise(F.concat(F.when(e.startswith("+"), "+").otherwise(""), digits)))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.replace(e, F.lit(" "), F.lit("")))
        .otherwise(e)
    )
    return F.when(kind != "name", F.array(one(kind, canonical))).when(F.size(names) > 1, F.array(given, family)).otherwise(F.array(family))


def _value(digest: Column, k) -> Column:
    """The k-th byte of a hex digest stream as an integer."""
    return F.conv(F.substring(digest, (k % 128) * 2 + 1, F.lit(2)) if isinstance(k, Column) else F.substring(digest, (k % 128) * 2 + 1, 2), 16, 10).cast("int")


def _letter(base: str, v: Column, n: int = 26) -> Column:
    return F.char(F.lit(ord(base)) + v % n)


def _spelled(x: Column, digest: Column, shift: int = 0) -> Column:
    """x with digits for digits and letters for letters."""

    def one(c: Column, k: Column) -> Column:
        v = _value(digest, k + shift)
        return F.when(F.regexp_like(c, F.lit("[0-9]")), (v % 10).cast("string")).when(F.regexp_like(c, F.lit("[a-z]")), _letter("a", v)).when(F.regexp_like(c, F.lit("[A-Z]")), _letter("A", v)).otherwise(c)

    return F.array_join(F.transform(F.split(x, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of 16 digits."""
    n = F.transform(F.split(digits, ""), lambda c, k: F.when(k % 2 == 0, c.cast("int") * 2).otherwise(c.cast("int")))
    return F.aggregate(n, F.lit(0), lambda s, v: s + F.when(v > 9, v - 9).otherwise(v))


def _mod97(x: Column) -> Column:
    """Remainder by 97 of a string of digits and capitals, A counting 10 and Z 35."""
    value = lambda c: F.when(F.regexp_like(c, F.lit("[0-9]")), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(x, ""), F.lit(0), lambda a, c: F.when(F.regexp_like(c, F.lit("[0-9]")), (a * 10 + value(c)) % 97).otherwise((a * 100 + value(c)) % 97))


def keyed_digest(kind: Column, canonical: Column, attempt: Column, key: str) -> Column:
    text = F.concat_ws("|", F.lit(key), kind, canonical, attempt.cast("string"))
    return F.concat(F.sha2(F.concat(text, F.lit("|0")), 512), F.sha2(F.concat(text, F.lit("|1")), 512))


def surrogate(kind: Column, canonical: Column, attempt: Column, digest: Column) -> Column:
    """Surrogate of a canonical form, itself canonical."""
    v = lambda k: _value(digest, k)
    label = F.split_part(F.split_part(canonical, F.lit("@"), F.lit(2)), F.lit("."), F.lit(1))
    more = F.substring(F.translate(digest, "0123456789", "ghijklmnop"), F.lit(1), F.greatest(attempt - 3, F.lit(0)))  # short addresses grow
    email = F.concat(_spelled(F.split_part(canonical, F.lit("@"), F.lit(1)), digest), more, F.lit("@"), _spelled(label, digest, 64), F.lit(".example."), F.element_at(F.array(*map(F.lit, ("com", "net", "org"))), v(127) % 3 + 1))

    digits = F.replace(canonical, F.lit("+"), F.lit(""))
    country = F.greatest(F.length(digits) - 10, F.lit(0))
    rest = F.substring(digits, country + 1, F.lit(99))
    phone = F.concat(F.when(canonical.startswith("+"), "+").otherwise(""), F.substring(digits, F.lit(1), country), (v(0) % 8 + 2).cast("string"), F.substring(_spelled(rest, digest), F.lit(2), F.lit(99)))

    body = F.concat(F.substring(canonical, 1, 1), F.substring(_spelled(canonical, digest), 2, 14))
    check = (10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
    card = F.concat(body, F.when(_luhn(canonical) % 10 == 0, check).otherwise((check + 1 + v(120) % 9) % 10).cast("string"))

    octet = lambda k: (v(k) % 254 + 1).cast("string")
    parts = F.split(canonical, r"\.")
    private = F.regexp_like(canonical, F.lit(r"^(10|192\.168|172\.(1[6-9]|2\d|3[01]))\."))
    first = F.when(canonical.startswith("10.") | (private & (attempt >= 8)), F.concat_ws(".", F.lit("10"), octet(1))).when(attempt >= 8, F.concat_ws(".", octet(0), octet(1)))
    first = first.when(canonical.startswith("192.168."), "192.168").when(F.regexp_like(canonical, F.lit(r"^172\.(1[6-9]|2\d|3[01])\.")), F.concat_ws(".", F.lit("172"), parts[1]))
    ip = F.concat_ws(".", first.otherwise(F.concat_ws(".", (v(0) % 90 + 11).cast("string"), octet(1))), octet(2), octet(3))

    hexed = F.array_join(F.transform(F.split(canonical, ""), lambda c, k: F.when(F.regexp_like(c, F.lit("[A-F]")), F.upper(F.substring(F.lit("abcdef"), _value(digest, k) % 6 + 1, F.lit(1)))).when(F.regexp_like(c, F.lit("[a-f]")), F.substring(F.lit("abcdef"), _value(digest, k) % 6 + 1, F.lit(1))).otherwise((_value(digest, k) % 10).cast("string"))), "")
    land, bban = F.substring(canonical, 1, 2), F.substring(_spelled(canonical, digest), F.lit(5), F.lit(99))
    right = _mod97(F.concat(F.substring(canonical, F.lit(5), F.lit(99)), F.substring(canonical, 1, 4))) == 1
    control = 98 - _mod97(F.concat(bban, land, F.lit("00")))
    control = F.when(right, control).otherwise(F.when(control > 50, control - 1 - v(0) % 40).otherwise(control + 1 + v(0) % 40))
    iban = F.concat(land, F.lpad(control.cast("string"), 2, "0"), bban)

    script = F.when(F.regexp_like(canonical, F.lit(r"\p{IsCyrillic}")), "cyrillic").when(F.regexp_like(canonical, F.lit(r"\p{IsGreek}")), "greek").otherwise("latin")

    def by_script(make) -> Column:
        return F.when(script == "cyrillic", make("cyrillic")).when(script == "greek", make("greek")).otherwise(make("latin"))

    def syllables(script_: str, n: Column, shift: int) -> Column:
        words = F.array(*map(F.lit, SYLLABLES[script_]))
        return F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: F.element_at(words, v(k + shift) % 16 + 1)), ""))

    def given(script_: str) -> Column:
        pick = lambda g: F.element_at(F.array(*map(F.lit, GIVEN[g, script_])), v(0) % len(GIVEN[g, script_]) + 1)
        name = F.when(kind == "given_f", pick("f")).when(kind == "given_m", pick("m")).otherwise(pick("n"))
        return F.when(attempt < 1, name).otherwise(F.concat(name, F.lit("-"), syllables(script_, F.least(attempt + 1, F.lit(LONGEST_NAME)), 30)))

    family = by_script(lambda x: syllables(x, F.least(attempt / 2 + 4, F.lit(LONGEST_NAME)).cast("int"), 0))
    out = F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ip", ip).when(kind == "secret", hexed).when(kind == "iban", iban)
    out = out.when(kind == "ssn", _spelled(canonical, digest)).when(kind == "family", family).otherwise(by_script(given))
    return F.when(attempt < LAST_ATTEMPT, out).otherwise(F.concat(F.lit("["), kind, F.lit("-"), F.substring(digest, 1, 32), F.lit("]")))


def _rendered(e: Column, kind: Column, s: Column) -> Column:
    """Canonical surrogates (of a mention's parts) in the writing of the entity they replace."""
    one = F.element_at(s, 1)
    slots = F.length(F.regexp_replace(e, "[^0-9A-Z]", ""))
    own = F.regexp_replace(one, "[^0-9A-Z]", "")  # digits (and an IBAN's letters), filled into the entity's separators
    own = F.substring(own, F.length(own) - slots + 1, slots)  # a number without its country code
    filled = F.aggregate(
        F.split(e, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("k")),
        lambda a, c: F.when(F.regexp_like(c, F.lit("[0-9A-Z]")), F.struct(F.concat(a.out, F.substring(own, a.k, F.lit(1))).alias("out"), (a.k + 1).alias("k"))).otherwise(F.struct(F.concat(a.out, c).alias("out"), a.k.alias("k"))),
        lambda a: a.out,
    )
    email = F.when((e == F.upper(e)) & (e != F.lower(e)), F.upper(one)).otherwise(one)
    person = F.concat(_title(e), F.array_join(s, " "), F.regexp_extract(e, "('s)?$", 0))
    return F.when(one.startswith("["), one).when(kind == "email", email).when(kind.isin("phone", "card", "ssn", "iban"), filled).when(kind == "name", person).otherwise(one)


def _aliases(all_: Column) -> Column:
    """(real, said) of the names in a text's mentions of persons, whole names first."""
    people = F.filter(all_, lambda m: m["kind"] == "name")
    both = F.transform(people, lambda m: F.array(F.struct((-F.size(m["real"])).alias("o"), F.array_join(m["real"], " ").alias("real"), F.array_join(m["made"], " ").alias("said")), F.struct(F.lit(-1).alias("o"), F.element_at(m["real"], -1).alias("real"), F.element_at(m["made"], -1).alias("said")), F.struct(F.lit(-1).alias("o"), F.element_at(m["real"], 1).alias("real"), F.element_at(m["made"], 1).alias("said"))))
    return F.array_sort(F.array_distinct(F.flatten(both)))


def _named(segment: Column, aliases: Column) -> Column:
    """Text between mentions with the names that its document's mentions gave away."""
    return F.aggregate(aliases, segment, lambda a, n: F.when(a.contains(n["real"]), F.regexp_replace(a, F.concat(F.lit(r"(?<![\p{L}-])\Q"), n["real"], F.lit(r"\E(?![\p{L}-])")), n["said"])).otherwise(a))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, surrogate) for distinct entities, no surrogate twice and none a real entity."""
    entities = staged(entities.select("kind", "canonical").distinct(), "entities")
    real = entities.select("kind", F.col("canonical").alias("surrogate"))
    waiting, given, attempt = entities, None, 0
    while True:
        drawn = waiting.withColumn("digest", keyed_digest(F.col("kind"), F.col("canonical"), F.lit(attempt), key))
        drawn = staged(drawn.select("kind", "canonical", surrogate(F.col("kind"), F.col("canonical"), F.lit(attempt), F.col("digest")).alias("surrogate")), "drawn")
        first = drawn.groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical"))
        first = first.join(real, ["kind", "surrogate"], "left_anti")
        if given is not None:
            first = first.join(given, ["kind", "surrogate"], "left_anti")
        first = staged(first.select("kind", "canonical", "surrogate"), "given")
        given = first if given is None else given.union(first)
        waiting = staged(drawn.join(first, ["kind", "canonical"], "left_anti").select("kind", "canonical"), "waiting")
        if waiting.isEmpty():
            return given
        attempt += 1


def with_surrogates(docs: DataFrame, key: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with ``text`` rewritten, and n_entities, n_distinct and the kinds found."""
    names = [c for c in docs.columns if c not in ("n_entities", "n_distinct", "kinds")]
    t = F.col(f"`{text}`")
    found = docs.select(*[F.col(f"`{c}`") for c in names]).withColumn("__tm_found", F.when(_hint(t), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    some = found.where(F.size("__tm_found") > 0).withColumn("__tm_hash", F.xxhash64(text)).withColumn("__tm_crc", F.crc32(t))

    mentions = some.select(F.col(f"`{id}`").alias("id"), "__tm_hash", "__tm_crc", F.posexplode("__tm_found").alias("k", "entity")).withColumn("kind", _kind(F.col("entity")))
    mentions = staged(mentions.withColumn("parts", _parts(F.col("entity"), F.col("kind"))), "mentions")
    each = mentions.select("id", "__tm_hash", "__tm_crc", "k", "entity", F.col("kind").alias("what"), F.posexplode("parts").alias("n", "part")).select("*", "part.kind", "part.canonical").drop("part")
    table = assign(each, key)
    ready = each.join(table, ["kind", "canonical"]).groupBy("id", "__tm_hash", "__tm_crc", "k", "entity", "what").agg(F.array_sort(F.collect_set(F.struct("n", "kind", "canonical", "surrogate"))).alias("p"))
    ready = ready.withColumn("said", _rendered(F.col("entity"), F.col("what"), F.col("p.surrogate")))
    one = F.struct("k", "said", F.col("what").alias("kind"), F.col("p.canonical").alias("real"), F.col("p.surrogate").alias("made"), F.transform("p", lambda x: F.concat(x["kind"], F.lit("|"), x["canonical"])).alias("who"))
    ready = ready.groupBy("id", "__tm_hash", "__tm_crc").agg(F.array_sort(F.collect_set(one)).alias("all"))  # the mentions of one text
    ready = ready.select(F.col("id").alias("__tm_id"), F.col("__tm_hash").alias("__tm_h"), F.col("__tm_crc").alias("__tm_c"), "all")

    joined = some.join(ready, F.col(f"`{id}`").eqNullSafe(F.col("__tm_id")) & (F.col("__tm_hash") == F.col("__tm_h")) & (F.col("__tm_crc") == F.col("__tm_c")))
    joined = joined.withColumn("__tm_aliases", _aliases(F.col("all")))
    between = F.transform(F.split(t, ANY, -1), lambda x: F.when(F.size("__tm_aliases") > 0, _named(x, F.col("__tm_aliases"))).otherwise(x))
    said = F.concat(F.col("all.said"), F.array(F.lit("")))
    new = F.array_join(F.zip_with(between, said, lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")
    made = {c: F.col(f"`{c}`") for c in names} | {text: new}
    done = joined.select(*[v.alias(k) for k, v in made.items()], F.size("all").cast("long").alias("n_entities"), F.size(F.array_distinct(F.transform("all", lambda m: m["who"]))).cast("long").alias("n_distinct"), F.array_sort(F.array_distinct(F.col("all.kind"))).alias("kinds"))
    none = found.where(F.coalesce(F.size("__tm_found"), F.lit(0)) <= 0).select(*[F.col(f"`{c}`") for c in names], F.lit(0).cast("long").alias("n_entities"), F.lit(0).cast("long").alias("n_distinct"), F.array().cast("array<string>").alias("kinds"))
    return done.unionByName(none)
