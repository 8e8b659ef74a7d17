"""Personal data: detection, and keyed surrogates of the same type, gender, script and format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowferry.llm.common import discard, indexes, let, written

#: Patterns of entities. Each starts and ends at a character that is no part of it, and
#: no part of a pattern is tried twice over the same run of characters.
EMAIL = (r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,62}\.)(?:[\p{L}\p{N}-]{1,63}\.){0,8}"
         r"\p{L}{2,24}(?![\p{L}\p{N}])")
PHONE = (r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?![\p{L}\p{N}])"
         r"|(?<![\p{L}\p{N}+])\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}+])\+\d{8,15}(?![\p{L}\p{N}])"
         r"|(?<![\p{L}\p{N}+.-])(?:1[ .-])?\d{3}[.-]\d{3}[.-]\d{4}(?![\p{L}\p{N}]|[.-]\d)"
         r"|(?<![\p{L}\p{N}+.-])1 [2-9]\d\d \d{3} \d{4}(?![\p{L}\p{N}]|[.-]\d)")
SSN = r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)"
CARD = (r"(?<![\p{L}\p{N}-])(?:[3-6]\d{3}|222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)(?:[ -]?)\d{4}(?:[ -]?)\d{4}(?:[ -]?)\d{4}"
        r"(?![\p{L}\p{N}]|-\d)|(?<![\p{L}\p{N}-])3[47]\d\d(?:[ -]?)\d{6}(?:[ -]?)\d{5}(?![\p{L}\p{N}]|-\d)")
IP = (r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
      r"(?![\p{L}\p{N}]|\.\d)")
HEX = "[0-9A-Fa-f]{1,4}"
IP6 = (rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{HEX}:){{7}}{HEX}|(?=[A-Fa-f]*[0-9]){HEX}(?::{HEX}){{0,5}}::(?:{HEX}(?::{HEX}){{0,5}})?)"
       r"(?![\p{L}\p{N}:])")
#: Titles that tell a person's gender, or none, before one or two names.
MALE, FEMALE, ANY = ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "г-н", "господин"), (
    "Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Señora", "г-жа", "госпожа"), ("Dr", "Prof")
PART = r"\p{Lu}[\p{L}\p{M}]{1,30}(?:['’-]\p{Lu}[\p{L}\p{M}]{1,30})?"
TITLES = "|".join((*MALE, *FEMALE, *ANY))
PERSON = rf"(?<![\p{{L}}\p{{N}}])(?:{TITLES})\.?[ ]{PART}(?:[ ]{PART})?(?![\p{{L}}\p{{N}}])"
ENTITY = "|".join((EMAIL, PHONE, SSN, CARD, IP, IP6, PERSON))
#: From this draw on, a surrogate gets a character more every third draw; after the last one there is none to be had.
WIDER, DRAWS = 3, 60
#: A text without any of these has no entity; this is much faster to see.
HINT = rf"[0-9@]|(?:{TITLES})\.?[ ]\p{{Lu}}"
#: Parts of invented names, by script and gender.
STARTS = {"latin": "Bar Cal Dor El Fen Gar Hal Jor Kel Lam Mor Nor Os Per Quin Ros Sel Tor Ul Ves".split(),
          "cyrillic": "Бор Вал Гор Дар Ел Жар Зар Кал Лад Мир Нар Ол Пар Рад Сев Тар Ул Фед Хар Яр".split(),
          "greek": "Αλ Βαρ Γαλ Δαρ Ελ Ζαν Θερ Καλ Λαμ Μαρ Νικ Ορ Παλ Ρον Σελ Ταρ Φιλ Χαρ Ψαρ Ωρ".split()}
MIDDLES = {"latin": "a e i o u an en in on ar er ir or al el il".split(),
           "cyrillic": "а е и о у ан ен ин он ар ер ир ор ал ел ил".split(),
           "greek": "α ε ι ο υ αν εν ιν ον αρ ερ ιρ ορ αλ ελ ιλ".split()}
ENDS = {("latin", "m"): "ton bert mund ric".split(), ("latin", "f"): "lina dette ria nne".split(), ("latin", "n"): "ley ris mar dan".split(),
        ("latin", "s"): "field wood berg land".split(),
        ("cyrillic", "m"): "слав мир дан тин".split(), ("cyrillic", "f"): "слава мила дана тина".split(),
        ("cyrillic", "n"): "слав мир дан тин".split(), ("cyrillic", "sm"): "ов ев ин ский".split(),
        ("cyrillic", "sf"): "ова ева ина ская".split(), ("cyrillic", "s"): "ов ев ин ский".split(),
        ("greek", "m"): "ος ης ας ων".split(), ("greek", "f"): "α η ια ω".split(), ("greek", "n"): "ος ης ας ων".split(),
        ("greek", "s"): "ίδης άκης όπουλος ίου".split()}


def entity_type(e: Column) -> Column:
    return (F.when(e.contains("@"), "email").when(e.rlike(rf"^(?:{TITLES})\.?[ ]"), "person").when(e.contains(":"), "ip6").when(e.rlike(f"^(?:{IP})$"), "ip")
            .when(e.rlike(f"^(?:{SSN})$"), "ssn").when(e.rlike(f"^(?:{CARD})$"), "card").otherwise("phone"))


def _digits(e: Column) -> Column:
    return F.regexp_replace(e, "[^0-9]", "")


def mentions(e: Column) -> Column:
    """What an entity's text mentions: (type, name), the same for all spellings of the same thing.
    A person with two names is two mentions, so ``Mrs Ada Byron`` and ``Mrs Byron`` share one; a single name's type
    is settled by ``single_names``. An address is two, so all people of a domain share it."""
    title = F.regexp_extract(e, rf"^({TITLES})\.?[ ]", 1)
    gender = F.when(title.isin(*MALE), "m").when(title.isin(*FEMALE), "f").otherwise("n")
    names = F.split(F.regexp_replace(e, rf"^(?:{TITLES})\.?[ ]", ""), " ")
    # Gender belongs to first names, and to surnames where the script inflects them.
    first = F.struct(F.concat(F.lit("first-"), gender).alias("type"), F.lower(names[0]).alias("name"))
    last_type = F.when(F.element_at(names, -1).rlike(r"\p{IsCyrillic}"), F.concat(F.lit("last-"), gender)).otherwise("last-n")
    last = F.struct(last_type.alias("type"), F.lower(F.element_at(names, -1)).alias("name"))
    single = F.struct(F.concat(F.lit("one-"), gender, F.lit("-"), last_type).alias("type"), F.lower(names[0]).alias("name"))
    kind = entity_type(e)
    mail = F.split(F.lower(e), "@")
    local, domain = F.struct(F.lit("local").alias("type"), mail[0].alias("name")), F.struct(F.lit("domain").alias("type"), mail[1].alias("name"))
    plain = F.struct(kind.alias("type"), F.when(kind == "ip", e).when(kind == "ip6", F.lower(e)).otherwise(
        F.concat(F.when(e.startswith("+"), "+").otherwise(""), _digits(e))).alias("name"))
    return (F.when(kind == "person", F.when(F.size(names) > 1, F.array(first, last)).otherwise(F.array(single)))
            .when(kind == "email", F.array(local, domain)).otherwise(F.array(plain)))


def single_names(found: DataFrame) -> DataFrame:
    """(one, type, name) of the distinct mentions ``found``: the type a mention of a single name takes, NULL in ``one``
    for the others. It is a first name if someone of that gender has it before a surname and nobody has it as one."""
    one, kind = F.col("type").startswith("one-"), F.split("type", "-")
    singles = found.where(one).select(F.col("type").alias("one"), F.concat(F.lit("first-"), kind[1]).alias("first"),
                                      F.concat(kind[2], F.lit("-"), kind[3]).alias("last"), F.col("name").alias("single"))
    given = found.where(F.col("type").startswith("first-")).select(F.col("type").alias("first"), F.col("name").alias("single"))
    family = found.where(F.col("type").startswith("last-")).select(F.col("type").alias("last"), F.col("name").alias("single"))
    as_first = singles.join(given, ["first", "single"], "left_semi").join(family, ["last", "single"], "left_anti")
    as_last = singles.join(as_first, ["one", "single"], "left_anti")
    return (as_first.select("one", F.col("first").alias("type"), F.col("single").alias("name"))
            .union(as_last.select("one", F.col("last").alias("type"), F.col("single").alias("name")))
            .union(found.where(~one).select(F.lit(None).cast("string").alias("one"), "type", "name")))


def _pick(values: list[str], draw: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(draw, F.lit(len(values))).cast("int"))


def _invented(type_: Column, name: Column, draw, attempt: Column) -> Column:
    """A name from syllables: script by the name's letters, ending by gender; later attempts are longer."""
    def of(script: str) -> Column:
        more = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(attempt / 2).cast("int") + 1),
                                        lambda i: _pick(MIDDLES[script], draw(i + 10))), "")
        end = None
        for key, kind in (("m", "first-m"), ("f", "first-f"), ("n", "first-n"), ("sm", "last-m"), ("sf", "last-f"), ("s", "last-n")):
            options = _pick(ENDS.get((script, key), ENDS[(script, "s" if key[0] == "s" else "n")]), draw(F.lit(2)))
            end = F.when(type_ == kind, options) if end is None else end.when(type_ == kind, options)
        return F.lower(F.concat(_pick(STARTS[script], draw(F.lit(1))), more, end))

    # Other scripts keep their letters' block: each is moved within 32 letters around it.
    moved = F.array_join(F.transform(F.split(name, ""), lambda c, i: F.when(
        c.rlike(r"\p{L}"), F.chr(F.ascii(c) - F.pmod(F.ascii(c), F.lit(32)) + F.pmod(draw(i + 10), F.lit(32)))).otherwise(c)), "")
    return (F.when(name.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(name.rlike(r"\p{IsGreek}"), of("greek"))
            .when(name.rlike(r"\p{IsLatin}"), of("latin")).otherwise(moved))


def _scrambled(name: Column, draw, kept: Column) -> Column:
    """Every letter and digit but the first ``kept`` characters replaced by one of its kind and script."""
    def change(c: Column, i: Column) -> Column:
        def among(first: str, count: int) -> Column:
            return F.chr(F.pmod(draw(i), F.lit(count)) + ord(first)) if ord(first) < 128 else \
                F.get(F.array(*[F.lit(chr(ord(first) + k)) for k in range(count)]), F.pmod(draw(i), F.lit(count)).cast("int"))
        return (F.when(i < kept, c).when(c.rlike("[0-9]"), among("0", 10)).when(c.rlike(r"\p{IsCyrillic}"), among("а", 32))
                .when(c.rlike(r"\p{IsGreek}"), among("α", 17)).when(c.rlike(r"\p{L}"), among("a", 26)).otherwise(c))
    return F.array_join(F.transform(F.split(name, ""), change), "")


def _more(draw, attempt: Column, digits: bool) -> Column:
    """The characters that a surrogate gets more at later draws, so that a full space of short names ends no search."""
    count = F.greatest(F.lit(0), F.floor((attempt - WIDER) / 3).cast("int") + 1)
    first, kinds = (ord("0"), 10) if digits else (ord("a"), 26)
    return F.array_join(F.transform(indexes(count), lambda i: F.chr(F.pmod(draw(i + 900), F.lit(kinds)) + first)), "")


def _with_check_digit(digits: Column) -> Column:
    """The digits with the last one set so that Luhn's sum holds."""
    n = F.length(digits)
    front = F.substr(digits, F.lit(1), n - 1)
    doubled = F.transform(F.split(F.reverse(front), ""), lambda c, i: let(
        c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + d)
    return F.concat(front, ((10 - total % 10) % 10).cast("string"))


def surrogate(type_: Column, name: Column, attempt: Column, secret: str) -> Column:
    """The keyed stand-in of a mention. The same key, mention and attempt always give the same."""
    def drawn(seed: Column) -> Column:
        def draw(i: Column) -> Column:
            return F.xxhash64(seed, i.cast("int"))

        letters, figures = _more(draw, attempt, False), _more(draw, attempt, True)
        top = F.length(F.substring_index(name, ".", -1)) + 1
        local = F.concat(_scrambled(name, draw, F.lit(0)), letters)
        domain = F.concat(_scrambled(F.substr(name, F.lit(1), F.length(name) - top), draw, F.lit(0)), letters,
                          F.substr(name, F.length(name) - top + 1, top))
        octets = F.array_join(F.transform(F.array(*map(F.lit, range(4))), lambda i: (
            F.pmod(draw(i), F.lit(254)) + 1).cast("string")), ".")
        # groups keep their lengths; their first figure is not 0, so that they stay as they are written
        ip6 = F.array_join(F.transform(F.split(name, ""), lambda c, i: F.when(c == ":", c).otherwise(
            F.lower(F.hex(F.pmod(draw(i), F.lit(15)) + 1)))), "")
        # Country codes of phones and the networks of cards stay.
        code = F.when(name.startswith("+1"), 2).when(name.startswith("+"), 3).when(name.rlike(r"^1\d{10}$"), 1).otherwise(0)
        network = F.when(name.rlike("^(3[47]|2)"), 2).otherwise(1)
        phone, card, ssn = (_scrambled(name, draw, kept) for kept in (code, network, F.lit(0)))
        # North American area and exchange codes start with 2 to 9.
        lead = [F.chr(F.pmod(draw(F.lit(i)), F.lit(8)) + ord("2")) for i in (50, 53)]
        phone = F.when(name.rlike(r"^\+?1\d{10}$"), let(F.length(name) - 10, lambda at: F.concat(
            F.substr(name, F.lit(1), at), lead[0], F.substr(phone, at + 2, F.lit(2)), lead[1], F.substr(phone, at + 5, F.lit(6))))).otherwise(phone)
        # numbers of the second series lie between 2221 and 2720
        series = F.concat((F.pmod(draw(F.lit(60)), F.lit(500)) + 2221).cast("string"), F.substr(card, F.lit(5), F.lit(12)))
        card = F.when(name.startswith("2"), series).otherwise(card)
        invented = _invented(type_, name, draw, attempt)
        invented = F.when(name.rlike(r"\p{IsCyrillic}|\p{IsGreek}|\p{IsLatin}"), invented).otherwise(F.concat(invented, letters))
        return (F.when(type_ == "local", local).when(type_ == "domain", domain).when(type_ == "ip", octets).when(type_ == "ip6", ip6)
                .when(type_ == "card", _with_check_digit(card)).when(type_ == "ssn", F.concat(ssn, figures))
                .when(type_ == "phone", F.concat(phone, figures)).otherwise(invented))

    return let(F.sha2(F.concat_ws("\u0000", F.lit(secret), type_, name, attempt.cast("string")), 256), drawn)


class NoSurrogate(Exception):
    """A table has so many mentions of a type that its form leaves no value free."""


def stand_ins(found: DataFrame, secret: str) -> DataFrame:
    """(type, name, surrogate) of the distinct mentions ``found`` (type, name); one-to-one by type group.

    A surrogate that two mentions draw, or that is itself a mention of the table, is a collision: the
    least mention keeps the former, all others draw again, and again, against all that are settled. Later draws
    are longer, so a space of short names may be full; addresses of IP and cards keep their length, and
    a table that leaves them no free value after DRAWS draws is an error.
    """
    if not secret:
        raise ValueError("surrogates need a key")
    def group(c: str) -> Column:
        return F.split(c, "-")[0]

    todo = written(found.distinct().withColumn("group", group("type")), "mentions")
    real = todo.select("group", F.col("name").alias("surrogate")).distinct()
    done, attempt, spent = None, 0, []
    while True:
        drawn = written(todo.withColumn("surrogate", surrogate(F.col("type"), F.col("name"), F.lit(attempt), secret)), "drawn")
        least = drawn.groupBy("group", "surrogate").agg(F.min(F.struct("name", "type")).alias("least"))
        free = least.join(real, ["group", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("group", "surrogate"), ["group", "surrogate"], "left_anti")
        settled = written(drawn.join(free, ["group", "surrogate"]).where(
            (F.col("least.name") == F.col("name")) & (F.col("least.type") == F.col("type")))
            .select("group", "type", "name", "surrogate"), "settled")
        done = settled if done is None else done.union(settled)
        left = written(drawn.drop("surrogate").join(settled.select("type", "name"), ["type", "name"], "left_anti"), "mentions")
        spent.append(drawn)
        if left.isEmpty():
            break
        todo, attempt = left.select("type", "name", "group"), attempt + 1
        if attempt == DRAWS:
            kinds = sorted(r[0] for r in todo.select("group").distinct().collect())
            raise NoSurrogate(f"no free surrogate after {DRAWS} draws for mentions of the types {', '.join(kinds)}")
    for table in spent:
        discard(table)
    return done.select("type", "name", "surrogate")


def _laid(e: Column, stand: Column) -> Column:
    """The surrogates of an entity's mentions in the entity's own format and case."""
    kind = entity_type(e)
    one = F.get(stand, F.lit(0))
    digits = _digits(one)

    def digit(c: Column, i: Column) -> Column:
        before = F.length(_digits(F.substr(e, F.lit(1), i)))
        return F.when(c.rlike("[0-9]"), F.substr(digits, before + 1, F.lit(1))).otherwise(c)

    more = F.substr(digits, F.length(_digits(e)) + 1, F.length(digits))
    numbers = F.concat(F.array_join(F.transform(F.split(e, ""), digit), ""), more)

    def cased(given: Column, new: Column) -> Column:
        """``new`` with capitals where ``given`` has them."""
        return F.concat(F.array_join(F.transform(F.split(F.substr(given, F.lit(1), F.length(new)), ""), lambda c, i: let(
            F.substr(new, i + 1, F.lit(1)), lambda n: F.when(c.rlike(r"\p{Lu}"), F.upper(n)).otherwise(n))), ""),
            F.substr(new, F.length(given) + 1, F.length(new)))

    mail = F.concat_ws("@", *[cased(F.get(F.split(e, "@"), F.lit(i)), F.get(stand, F.lit(i))) for i in (0, 1)])
    title = F.regexp_extract(e, rf"^((?:{TITLES})\.?[ ])", 1)
    names = F.split(F.regexp_replace(e, rf"^(?:{TITLES})\.?[ ]", ""), " ")
    person = F.concat(title, F.array_join(F.transform(stand, lambda s, i: F.when(
        F.get(names, i) == F.upper(F.get(names, i)), F.upper(s)).otherwise(F.initcap(s))), " "))
    ip6 = F.when(e.rlike("[A-F]"), F.upper(one)).otherwise(one)
    return (F.when(kind == "person", person).when(kind == "email", mail).when(kind == "ip", one).when(kind == "ip6", ip6)
            .otherwise(numbers))


def replaced(docs: DataFrame, *, id: str = "doc_id", text: str = "text", secret: str) -> DataFrame:
    """(doc_id, text, n_entities) of every row of ``docs``, with all entities replaced.

    Entities are e-mail addresses, phone, social security and card numbers, IP addresses, and names
    after a title. Each gets a surrogate that ``secret``, type and mention decide: the same everywhere
    in the table, and different for different mentions. Who knows the secret can draw them again, so it is the
    caller's to keep. Addresses of one domain share its surrogate. It keeps the format (punctuation, country code,
    card network and check digit, top-level domain), the case, the script and the title's gender.
    Everything else in a text stays as it is, and texts without an entity are returned unread.

    NULL texts stay NULL and have no entity. Repeated rows come back as often as given; an empty table
    gives no rows; other columns are not used. Only texts with entities are shuffled.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    entities = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(f"({ENTITY})"), F.lit(1))).otherwise(
        F.array().cast("array<string>"))
    marked = written(rows.where(F.col("text").rlike(HINT)).select("doc_id", F.md5("text").alias("key"), entities.alias("entities"))
                     .where(F.size("entities") > 0), "entities")
    each = (marked.groupBy("key").agg(F.first("entities").alias("entities"))
            .select("key", F.posexplode("entities").alias("at", "entity"))
            .select("key", "at", "entity", F.posexplode(mentions(F.col("entity"))).alias("part", "mention"))
            .select("key", "at", "entity", "part", "mention.type", "mention.name"))
    found = written(each, "occurrences")
    typed = written(single_names(found.select("type", "name").distinct()), "types")
    drawn = stand_ins(typed.select("type", "name"), secret)
    known = written(typed.join(drawn, ["type", "name"]).select(F.coalesce("one", "type").alias("type"), "name", "surrogate"), "surrogates")
    by_entity = (found.join(known, ["type", "name"])
                 .groupBy("key", "at").agg(F.first("entity").alias("entity"),
                                           F.sort_array(F.collect_list(F.struct("part", "surrogate"))).alias("parts"))
                 .select("key", "at", _laid(F.col("entity"), F.col("parts.surrogate")).alias("laid")))
    by_key = written(by_entity.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "laid"))).alias("laid"))
                     .select("key", F.col("laid.laid").alias("laid")), "replacements")
    has = F.col("text").rlike(HINT) & F.col("text").rlike(ENTITY)
    changed = (rows.where(has).withColumn("key", F.md5("text")).join(by_key, "key")
               .select("doc_id", "laid", F.split("text", ENTITY, -1).alias("gaps"))
               .select("doc_id", let(F.col("gaps"), lambda g: F.array_join(F.transform(
                   g, lambda gap, i: F.concat(gap, F.coalesce(F.get("laid", i), F.lit("")))), "")).alias("text"),
                   F.size("laid").alias("n_entities")))
    same = rows.where(F.coalesce(~has, F.lit(True))).select("doc_id", "text", F.lit(0).alias("n_entities"))
    return changed.union(same)
