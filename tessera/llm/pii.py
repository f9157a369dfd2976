"""Surrogate generation for personal data, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import discard, stage

# Forms of entities, titles and the names that stand in for names.
TITLES = {"m": ["Mr", "Sir", "Lord", "Herr", "Monsieur", "Señor", "Господин"], "f": ["Mrs", "Ms", "Miss", "Mx", "Lady", "Dame", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Госпожа"],
          "n": ["Dr", "Doctor", "Doktor", "Prof", "Professor", "Доктор", "Профессор"]}
PARTICLES = "van von der den de del della di da dos du la le ten ter zu zur al bin".split()
GIVEN = {
    ("m", "latin"): "Adam Brian Carl David Edgar Felix Georg Henry Ivan Jonas Karl Louis Marco Nils Oscar Paul Rene Simon Tomas Victor".split(),
    ("f", "latin"): "Alice Bianca Clara Diana Emma Fiona Greta Hanna Irene Julia Karin Laura Maria Nina Olga Paula Rosa Sofia Teresa Vera".split(),
    ("n", "latin"): "Alex Casey Dana Jamie Jordan Kim Morgan Riley Robin Taylor".split(),
    ("n", "cyrillic"): "Валя Женя Саша Слава Шура".split(),
    ("m", "cyrillic"): "Андрей Борис Виктор Денис Егор Захар Игорь Кирилл Леонид Максим".split(),
    ("f", "cyrillic"): "Анна Белла Вера Дарья Ева Зоя Ирина Ксения Лидия Мария".split(),
}
FAMILY = {
    "latin": "Abel Baker Corin Dahl Ekman Forst Grant Holm Iberg Jansen Keller Lind Moreau Novak Olsen Prado Quist Rivas Stone Tamm Ulrich Vogel Weber Young Zeller".split(),
    "cyrillic": "Агапов Белов Воронов Громов Дубов Ершов Жаров Зимин Ильин Котов".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha ka ke la le lo ma me mi na ne no pa pe ra re ro sa se ta te to va ve wa ze".split(),
    "cyrillic": "ба бе бо ва ве да де до га го жа за зе ка ке ла ле ло ма ме на не но па пе ра ре ро са се та те то ша".split(),
}
ENDINGS = {("m", "latin"): "rd", ("f", "latin"): "lia", ("n", "latin"): "is", ("n", "cyrillic"): "ня", ("family", "latin"): "ner", ("m", "cyrillic"): "слав", ("f", "cyrillic"): "лия", ("family", "cyrillic"): "нов"}
_TITLE = "|".join(sorted((t for some in TITLES.values() for t in some), key=len, reverse=True))
_LOUD = "|".join(sorted((t.upper() for some in TITLES.values() for t in some), key=len, reverse=True))
_PARTS = r"(?:(?:" + "|".join(PARTICLES) + r") ){0,3}"
_WORD, _CAPS = r"\p{Lu}[\p{L}'’-]*\p{L}", r"\p{Lu}[\p{Lu}'’-]*\p{Lu}"
TOKEN = r"AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-|AIza"
FORMS = {
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "token": r"(?<!\w)(?:" + TOKEN + r")[A-Za-z0-9_-]{16,}(?!\w)",
    "ipv6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f]{3,4}:)(?=[0-9A-Fa-f]*\d)(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d.]*\d)",
    "phone": r"(?<![\w+])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]?\(?\d{1,5}\)?)(?:[ .-]?\d{2,4}){2,4})(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w-])(?:\d{16}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\w-])",
    "secret": r"(?<![\w])(?:[0-9A-Fa-f]{40}|[0-9A-Fa-f]{32}|[0-9A-Fa-f]{64})(?![\w])",
    "name": rf"(?<!\w)(?:(?:{_TITLE})\.? (?!(?:{_TITLE})\b){_PARTS}{_WORD}(?: (?!(?:{_TITLE})\b){_PARTS}{_WORD})?|(?:{_LOUD})\.? {_CAPS}(?: {_CAPS})?)(?![\w])",
}
ANY = "|".join(f"(?:{x})" for x in FORMS.values())
HINT = "[@0-9:]|" + TOKEN + "|" + _TITLE + "|" + _LOUD  # no entity is without one of these
DRAWS = 8  # draws of an entity after which the shapes of numbers grow too


def kind_of(surface: Column) -> Column:
    out = F.lit("name")
    for kind, form in reversed([x for x in FORMS.items() if x[0] != "name"]):
        out = F.when(surface.rlike(f"^(?:{form})$"), F.lit(kind)).otherwise(out)
    return out


def canonical(kind: Column, surface: Column) -> Column:
    """What different spellings of one entity have in common."""
    digits = F.regexp_replace(surface, r"\D", "")
    national = surface.startswith("+1") & (F.length(digits) == 11)  # numbers without a country's code are taken for those of +1
    return (
        F.when(kind.isin("email", "secret", "ipv6"), F.lower(surface)).when(kind == "phone", F.when(national, F.right(digits, F.lit(10))).otherwise(digits))
        .when(kind.isin("card", "ssn"), digits).when(kind == "iban", F.replace(surface, F.lit(" "), F.lit(""))).otherwise(surface)
    )


_FEMALE = r"(ов|ев|ин)а$"  # family names that women bear with one letter more


def _name_parts(surface: Column) -> Column:
    """Of a titled name, (kind, value) of the given name, if there is one, and of the family name; particles are no part of either."""
    bare = F.filter(F.split(F.regexp_replace(surface, r"^\S+ ", ""), " "), lambda w: ~w.isin(PARTICLES))
    titled = {g: "^(?:" + "|".join([*some, *map(str.upper, some)]) + r")\.? " for g, some in TITLES.items()}
    kind = F.when(surface.rlike(titled["m"]), "given_m").when(surface.rlike(titled["f"]), "given_f").otherwise("given_n")
    given = F.struct(kind.alias("kind"), F.lower(bare[0]).alias("value"))
    family = F.struct(F.lit("family").alias("kind"), F.regexp_replace(F.lower(F.element_at(bare, -1)), _FEMALE, "$1").alias("value"))
    return F.when(F.size(bare) > 1, F.array(given, family)).otherwise(F.array(family))


def _noise(key: str, kind: Column, value: Column, attempt: Column, part: int = 0) -> Column:
    """128 hexadecimal digits that depend on the key."""
    return F.sha2(F.concat_ws("\0", F.lit(key), kind, value, attempt.cast("string"), F.lit(str(part))), 512)


def _number(noise: Column, at: Column) -> Column:
    """A number below 65536 of the noise; places wrap around."""
    return F.conv(F.substring(noise, F.pmod(at * 3, F.lit(124)).cast("int") + 1, F.lit(4)), 16, 10).cast("int")


def _fill(shape: Column, noise: Column) -> Column:
    """Each ASCII letter and digit of shape replaced by one of its kind, the rest kept."""
    low, high, ten = F.lit("abcdefghijklmnopqrstuvwxyz"), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("0123456789")

    def one(c: Column, k: Column) -> Column:
        n = _number(noise, k)
        return (F.when(c.rlike("^[0-9]$"), F.substring(ten, n % 10 + 1, F.lit(1))).when(c.rlike("^[a-z]$"), F.substring(low, n % 26 + 1, F.lit(1)))
                .when(c.rlike("^[A-Z]$"), F.substring(high, n % 26 + 1, F.lit(1))).otherwise(c))

    return F.array_join(F.transform(F.split(shape, ""), one), "")


def _hex_fill(shape: Column, noise: Column) -> Column:
    return F.substring(noise, F.lit(1), F.length(shape))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    def add(total: Column, x: Column) -> Column:
        return total + x

    each = F.transform(F.split(F.reverse(digits), ""), lambda c, k: F.when(k % 2 == 0, c.cast("int")).otherwise(
        F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), add) % 10


def _same_luhn(digits: Column, like: Column) -> Column:
    """digits with a last digit that makes them valid just as `like` is."""
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    check = (F.lit(10) - _luhn(F.concat(body, F.lit("0")))) % 10
    return F.concat(body, F.when(_luhn(like) == 0, check).otherwise((check + 1 + F.substring(digits, F.length(digits), F.lit(1)).cast("int") % 9) % 10).cast("string"))


def _mod97(text: Column) -> Column:
    """The number that digits and letters (A is 10) stand for, modulo 97."""
    def add(rest: Column, c: Column) -> Column:
        n = F.conv(c, 36, 10).cast("int")
        return F.when(n < 10, rest * 10 + n).otherwise(rest * 100 + n) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _hex_each(shape: Column, noise: Column) -> Column:
    return F.array_join(F.transform(F.split(shape, ""), lambda c, k: F.when(c.rlike("^[0-9a-f]$"), F.substring(F.lit("0123456789abcdef"), _number(noise, k) % 16 + 1, F.lit(1))).otherwise(c)), "")


def _pick(pool: list[str], noise: Column, place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, pool)), _number(noise, place) % len(pool) + 1)


def _name(which: str, script: str, noise: Column, attempt: Column) -> Column:
    """A name of the lists at first; then names of as many syllables as there were attempts and one more, with an
    ending that tells the gender, so that there is room for any number of names."""
    pool = FAMILY[script] if which == "family" else GIVEN[which, script]
    made = F.array_join(F.transform(F.sequence(F.lit(0), attempt), lambda k: _pick(SYLLABLES[script], noise, k + 3)), "")
    return F.when(attempt == 0, _pick(pool, noise, F.lit(0))).otherwise(F.concat(F.initcap(made), F.lit(ENDINGS[which, script])))


def stand_in(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """The canonical surrogate of a canonical value: same type, and same gender, script, length and shape. Names and
    emails grow with the attempts, as few short ones exist; all else by a character a draw after DRAWS of them."""
    noise = _noise(key, kind, value, attempt)
    at = F.instr(value, "@")
    domain = F.substring(value, at + 1, F.length(value))
    top = F.regexp_extract(domain, r"\.([^.]+)$", 0)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    longer = F.translate(F.substring(_noise(key, kind, value, attempt, 2), F.lit(1), F.greatest(attempt - 1, F.lit(0))), "0123456789", "ghijklmnop")
    email = F.concat(_fill(F.substring(value, F.lit(1), at - 1), noise), longer, F.lit("@"), _fill(host, _noise(key, kind, domain, attempt, 1)), top)
    octets = F.array_join(F.transform(F.split(value, r"\."), lambda _, k: (_number(noise, k) % 254 + 1).cast("string")), ".")
    country, account = F.substring(value, F.lit(1), F.lit(2)), _fill(F.substring(value, F.lit(5), F.length(value)), noise)
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    prefix = F.regexp_extract(value, f"^(?:{TOKEN})", 0)
    token = F.concat(prefix, _fill(F.substring(value, F.length(prefix) + 1, F.length(value)), noise))
    out = _fill(value, noise)
    for which in ("m", "f", "n", "family"):
        cyrillic, latin = (_name(which, script, noise, attempt) for script in ("cyrillic", "latin"))
        out = F.when(kind == (which if which == "family" else f"given_{which}"), F.when(value.rlike(r"\p{IsCyrillic}"), cyrillic).otherwise(latin)).otherwise(out)
    phone = F.concat(F.substring(value, F.lit(1), F.greatest(F.length(value) - 10, F.lit(0))), _fill(F.right(value, F.lit(10)), noise))
    drawn = (
        F.when(kind == "email", email).when(kind == "ip", octets).when(kind == "card", _same_luhn(_fill(value, noise), value)).when(kind == "secret", _hex_fill(value, noise))
        .when(kind == "ipv6", _hex_each(value, noise)).when(kind == "iban", iban).when(kind == "token", token).when(kind == "phone", phone).otherwise(out)
    )
    grown = _fill(F.repeat(F.lit("0"), F.greatest(attempt - DRAWS + 1, F.lit(0))), _noise(key, kind, value, attempt, 3))
    return F.when(kind.isin("email", "given_m", "given_f", "given_n", "family"), drawn).otherwise(F.concat(drawn, grown))


def _cased(surface: Column, chosen: Column) -> Column:
    """chosen in capitals where surface, of the same length, has them."""
    return F.array_join(F.zip_with(F.split(surface, ""), F.split(chosen, ""), lambda a, b: F.when(a.rlike("[A-Z]"), F.upper(b)).otherwise(b)), "")


def _surface(kind: Column, surface: Column, chosen: Column) -> Column:
    """The surrogate written as the surface was: digits go into its groups, capitals and title stay."""
    total = F.length(F.regexp_replace(surface, r"\D", ""))
    spread = F.aggregate(
        F.split(surface, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("seen")),
        lambda acc, c: F.when(c.rlike("^[0-9]$"), F.struct(
            F.concat(acc["out"], F.when(acc["seen"] < total - F.length(chosen), c).otherwise(F.substring(chosen, acc["seen"] - total + F.length(chosen) + 1, F.lit(1)))).alias("out"),
            (acc["seen"] + 1).alias("seen"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["seen"].alias("seen"))),
        lambda acc: F.concat(acc["out"], F.substring(chosen, F.lit(1), F.greatest(F.length(chosen) - total, F.lit(0)))))  # a grown one doesn't fit its groups
    upper = surface.rlike("^[^a-z]*[A-Z][^a-z]*$")
    mixed = surface.rlike("[A-Z]")
    groups = F.aggregate(
        F.split(surface, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("seen")),
        lambda acc, c: F.when(c == " ", F.struct(F.concat(acc["out"], c).alias("out"), acc["seen"].alias("seen"))).otherwise(
            F.struct(F.concat(acc["out"], F.substring(chosen, acc["seen"] + 1, F.lit(1))).alias("out"), (acc["seen"] + 1).alias("seen"))),
        lambda acc: F.concat(acc["out"], F.substring(chosen, acc["seen"] + 1, F.length(chosen))))
    return (
        F.when(kind.isin("phone", "card", "ssn"), spread).when(kind == "iban", groups)
        .when(kind.isin("secret", "ipv6"), F.when(upper, F.upper(chosen)).when(mixed, _cased(surface, chosen)).otherwise(chosen))
        .when(kind == "email", F.when(upper, F.upper(chosen)).when(mixed, _cased(surface, chosen)).otherwise(chosen)).otherwise(chosen)
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, chosen) for distinct (kind, value): no two values of a kind share a surrogate, and none is a
    value that occurs. Whoever collides is drawn again; the least value keeps what it drew.

    All find room however many there are: names and emails grow with the draws, and what keeps its shape grows once
    DRAWS draws have found none free, as it must where so many of one shape occur.
    """
    entities = stage(entities.select("kind", "value").distinct(), "entities")
    taken, waiting, attempt = None, entities, 0
    real = entities.select("kind", F.lower("value").alias("chosen"))
    while True:
        drawn = stage(waiting.withColumn("drawn", stand_in(key, F.col("kind"), F.col("value"), F.lit(attempt))).withColumn("chosen", F.lower("drawn")), "drawn")
        fresh = drawn.join(real, ["kind", "chosen"], "left_anti")
        if taken is not None:
            fresh = fresh.join(taken.select("kind", F.lower("drawn").alias("chosen")), ["kind", "chosen"], "left_anti")
        kept = fresh.groupBy("kind", "chosen").agg(F.min(F.struct("value", "drawn")).alias("v")).select("kind", "v.value", "v.drawn")
        before = taken
        taken = stage(kept if taken is None else taken.select("kind", "value", "drawn").union(kept), "taken")
        left = stage(waiting.join(taken, ["kind", "value"], "left_anti"), "waiting")
        discard(drawn, *([before] if before else []), *([waiting] if attempt else []), collect=False)
        waiting = left
        if waiting.isEmpty():
            return taken.select("kind", "value", F.col("drawn").alias("chosen"))
        attempt += 1


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text, n_entities for each row of docs: emails, IP addresses, phone, social security, card and account
    numbers, access tokens, secrets and titled names replaced by surrogates. Names without a title aren't known.

    A surrogate depends on the key, which must be kept secret, the kind and the entity, so an entity has the same one
    in all documents and spellings (phones by their digits, +1 being the country of those without a code; emails and
    secrets in lower case), and different entities of a kind have different ones. Given and family names have their own, so a person is the same with and
    without the given name, and a man and a woman of one name stay two. Names keep title, gender, script, particles and capitals; numbers
    keep their groups, cards their Luhn validity, accounts valid check digits. Null texts stay null with no entities;
    repeated rows each give a row. Columns beyond doc_id and text are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    has = F.coalesce(F.col("text").rlike(HINT) & F.col("text").rlike(ANY), F.lit(False))
    some = stage(rows.filter(has).withColumn("row_id", F.monotonically_increasing_id()).select(
        "row_id", "doc_id", F.split("text", ANY, -1).alias("rest"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("found")), "with-entities")
    surfaces = some.select(F.explode(F.array_distinct("found")).alias("surface")).distinct()
    surfaces = surfaces.withColumn("kind", kind_of(F.col("surface")))
    whole = F.array(F.struct("kind", canonical(F.col("kind"), F.col("surface")).alias("value")))
    surfaces = stage(surfaces.withColumn("parts", F.when(F.col("kind") == "name", _name_parts(F.col("surface"))).otherwise(whole)), "surfaces")
    chosen = surrogates(surfaces.select(F.explode("parts").alias("part")).select("part.*"), key)
    parts = surfaces.select("surface", F.posexplode("parts").alias("at", "part")).select("surface", "at", "part.kind", "part.value").join(chosen, ["kind", "value"])
    new = parts.groupBy("surface").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "chosen"))), lambda x: x["chosen"]).alias("all"))
    between = F.regexp_extract("surface", rf" ((?:(?:{'|'.join(PARTICLES)}) )+)(?=\S+$)", 1)  # particles before the family name
    family = F.concat(between, F.element_at("all", -1))
    new = new.select("surface", F.when(F.size("all") > 1, F.concat(F.element_at("all", 1), F.lit(" "), family)).otherwise(family).alias("chosen"))
    loud = (F.upper("surface") == F.col("surface")) & F.col("surface").rlike(r"\p{Lu}{2}")
    named = F.concat(F.regexp_extract("surface", r"^\S+ ", 0), F.col("chosen"), F.when(F.col("chosen").rlike(r"\p{IsCyrillic}") & F.col("surface").rlike(_FEMALE), "а").otherwise(""))
    named = F.when(loud, F.upper(named)).otherwise(named)
    spelled = surfaces.join(new, "surface").select("surface", F.when(F.col("kind") == "name", named).otherwise(_surface(F.col("kind"), F.col("surface"), F.col("chosen"))).alias("new"))
    placed = some.select("row_id", F.posexplode("found").alias("at", "surface")).join(spelled, "surface")
    by_row = placed.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("at", "new"))).alias("news"))
    glued = F.array_join(F.zip_with("rest", F.concat(F.transform("news", lambda x: x["new"]), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    changed = some.join(by_row, "row_id").select("doc_id", glued.alias("text"), F.size("news").cast("long").alias("n_entities"))
    return changed.union(rows.filter(~has).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities")))
