"""Surrogates for personal data and secrets. DataFrame functions only.

One pattern finds all mentions; splitting a text by the same pattern gives the parts between them, so a text is its parts
and mentions in turn. A mention's canonical form (digits of a number, lower case of an address or name) makes one entity
of its differently written mentions. People are found by a title before the name; in the same text later mentions of
the full name, the surname or one of the first names alone belong to the same entity, and so does the feminine form of a
Russian surname. Every entity gets a replacement from a
keyed hash that keeps its type, script, gender and format: names are a given name and a surname with a replacement each,
an address a local part and a domain. Replacements are checked against each other and against all entities of the corpus;
whoever collides draws again, from a larger space after some draws, until all are distinct.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_io import row_keys, stage

#: Title words before a name by gender (fixed values of the operator, in four languages and Russian).
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа"]
NEUTRAL = ["Dr", "Prof", "Doctor", "Professor", "Mx", "доктор"]
#: First names by script and gender, and syllables that surnames are built of.
FIRST = {
    ("latin", "m"): ["Adrian", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Nils", "Oscar", "Paul"],
    ("latin", "f"): ["Alma", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Ida", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Марк", "Никита", "Олег", "Павел", "Роман", "Степан", "Тимур"],
    ("cyrillic", "f"): ["Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Инна", "Кира", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Рита"],
}
SYLLABLES = {
    "latin": ["ba", "cor", "del", "fen", "gar", "hol", "jar", "kel", "lin", "mor", "nev", "pol", "ran", "sol", "tam", "vik"],
    "cyrillic": ["ба", "вор", "гал", "дел", "жи", "зор", "кал", "лен", "мор", "нев", "пол", "рам", "сол", "тар", "фен", "шал"],
}
_CASES = lambda titles: "|".join(x for t in titles for x in dict.fromkeys([t, t[0].upper() + t[1:], t.upper()]))
_TITLES = _CASES(MALE + FEMALE + NEUTRAL)
#: Particles of surnames; they are part of a titled name, but tell no two names apart (fixed values).
PARTICLES = ["van", "von", "de", "der", "den", "del", "della", "di", "da", "du", "la", "le", "ter", "zu", "zum", "zur", "bin", "al", "el"]
#: Endings of Russian surnames that have a feminine form, which is replaced by one (fixed values).
GENDERED = "(?:ов|ев|ёв|ин|ын|ский|цкий)$"
_PARTS = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}"
_WORD = rf"(?!(?:{_TITLES})(?![\p{{L}}]))\p{{Lu}}[\p{{L}}'’ʼ-]+"
_NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLES})\.? {_PARTS}{_WORD}(?: {_PARTS}{_WORD}){{0,2}}"
_RUN = rf"(?<![\p{{L}}\p{{N}}]){_WORD}(?: {_WORD}){{0,2}}"
_LABELS = "password|passwd|token|secret|api[_-]?key"
#: Beginnings of keys that need no label; they stay, as they tell the format.
_PREFIXES = r"(?:[spr]k_(?:live|test)_|gh[opsur]_|github_pat_|glpat-|xox[abprs]-|eyJ)"
#: A label's value is any run of such characters. After a colon it has a digit or quotes, as prose has colons too.
_VALUE = "[A-Za-z0-9_./+=!@#$%^&*~-]"
#: Patterns in the order in which they are tried at a place. A mention is told by its own characters alone.
PATTERNS = [
    r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    rf"(?<![A-Za-z0-9_]){_PREFIXES}[A-Za-z0-9_.-]{{10,}}+",
    rf"(?<![A-Za-z])(?i:{_LABELS})[\"']? ?(?:= ?[\"']?|: ?[\"']|: ?(?=[A-Za-z_./+-]*+[0-9])){_VALUE}{{8,}}+",
    r"[\"'][0-9a-f]{32,}+[\"']",
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    r"(?<![0-9A-Fa-f:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Fa-f:])",
    r"(?=[0-9+(])(?:" + "|".join([
        r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
        r"(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})){2,5}(?![0-9])",
        r"(?<![0-9A-Za-z.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])",
        r"(?<![0-9A-Za-z.,-])(?:\(0[0-9]{1,4}\)|0[0-9]{1,4})[ /-][0-9]{3,8}(?:[ -][0-9]{2,4}){0,2}(?![0-9])",
    ]) + ")",
    _NAME,
]
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS)
#: The same for texts that name people: capitalised words too, which may be later mentions.
NAMING = f"{PATTERN}|(?:{_RUN})"
KINDS = ["email", "aws_key", "secret", "iban", "ipv6", "ipv4", "ssn", "card", "phone", "name"]
#: Draws after which a replacement may be longer than what it replaces.
DRAWS = 8


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    backwards = F.split(F.reverse(digits), "")
    value = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.floor(d.cast("int") * 2 / 10).cast("int") + d.cast("int") * 2 % 10)
    return F.aggregate(F.transform(backwards, value), F.lit(0), lambda t, v: t + v) % 10 == 0


def _mod97(text: Column) -> Column:
    """Remainder of the number that a text of digits and capitals (A is 10) stands for."""
    step = lambda t, c: F.when(c.rlike("[0-9]"), (t * 10 + F.ascii(c) - 48) % 97).otherwise((t * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def classify(m: Column) -> Column:
    """Kind of a mention (``run`` for capitalised words), null if it only looks like one: an address part over 255, a failed
    check digit, too few or too many digits of a telephone number."""
    octets = F.forall(F.split(m, r"\."), lambda x: x.cast("int") <= 255)
    squeezed = F.replace(m, F.lit(" "), F.lit(""))
    labelled = m.rlike("^[\"']") | m.rlike(f"^(?i:{_LABELS})[^A-Za-z@]") | m.rlike(f"^{_PREFIXES}[A-Za-z0-9_.-]+$")
    out = F.when(labelled, "secret").when(m.contains("@"), "email").when(m.rlike("^AKIA[0-9A-Z]{16}$"), "aws_key")
    out = out.when(m.rlike(f"^{_NAME}$"), "name").when(m.rlike(f"^{_RUN}$"), "run")
    out = out.when(m.rlike("^[A-Z]{2}[0-9]{2}"), F.when(_mod97(F.concat(F.substring(squeezed, 5, 64), F.substring(squeezed, 1, 4))) == 1, "iban"))
    out = out.when(m.contains(":"), "ipv6").when(m.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), F.when(octets, "ipv4"))
    out = out.when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
    out = out.when(m.rlike("^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$"), F.when(_luhn(_digits(m)), "card"))
    return out.when(F.length(_digits(m)).between(8, 15), "phone")


def _drawn(seed: Column, n: Column) -> Column:
    """n numbers from 0 to 255 by a keyed hash."""
    byte = lambda i: F.conv(F.substring(F.sha2(F.concat_ws("|", seed, F.floor(i / 32).cast("string")), 256), (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), byte)


CYRILLIC = "абвгдежзиклмнопрстуф"
#: Country codes of one and two digits (fixed values of the numbering plan); all others have three.
CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"


def _kept_digits(canon: Column) -> Column:
    """Characters of a telephone number that are format: with a plus the country code and a zero behind it, otherwise leading
    zeros, or the first digit."""
    code = F.regexp_extract(canon, rf"^\+(?:{CODES}|[0-9]{{3}})0?", 0)
    return F.when(canon.startswith("+"), F.length(code)).otherwise(F.greatest(F.length(F.regexp_extract(canon, "^0+", 0)), F.lit(1)))


def _alike(text: Column, seed: Column, first: int | Column = 0, letters: str = "abcdefghijklmnopqrstuvwxyz", digits: str = "0123456789") -> Column:
    """Every letter and digit from place ``first`` on replaced by one of its kind; Cyrillic letters by such, other scripts'
    by Latin ones."""
    take = lambda values, d: F.substring(F.lit(values), d % len(values) + 1, F.lit(1))
    # characters and draws side by side, so that the draws are made once and not for every character
    both = F.arrays_zip(F.split(text, "").alias("c"), _drawn(seed, F.length(text)).alias("d"))

    def swap(e: Column, i: Column) -> Column:
        c, d = e["c"], e["d"]
        out = F.when(i < first, c).when(c.rlike("[0-9]"), take(digits, d)).when(c.rlike("[a-z]"), take(letters, d)).when(c.rlike("[A-Z]"), take(letters.upper(), d))
        return out.when(c.rlike(r"\p{IsCyrillic}"), take(CYRILLIC, d)).when(c.rlike(r"\p{L}"), take(letters, d)).when(c.rlike(r"\p{N}"), take(digits, d)).otherwise(c)

    return F.array_join(F.transform(both, swap), "")


def _hex_alike(text: Column, seed: Column) -> Column:
    return _alike(F.regexp_replace(text, "[a-f]", "0"), seed, 0, digits="0123456789abcdef")


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """Replacement of an entity's canonical form.

    A given name's canon is its gender (m, f, u), a bar and the name; that of a local part is the whole address, and its
    replacement keeps the domain, which has one of its own.
    """
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")), 256)
    more = lambda like, free: _alike(F.repeat(F.lit(like), F.greatest(attempt - free, F.lit(0))), F.concat(seed, F.lit("+")))
    tld = F.regexp_extract(canon, r"\.\p{L}+$", 0)
    domain = F.concat(more("a", 0), _alike(F.regexp_replace(canon, r"\.\p{L}+$", ""), seed), tld)
    email = F.concat(_alike(F.substring_index(canon, "@", 1), seed), more("a", 0), F.lit("@"), F.substring_index(canon, "@", -1))
    ip = F.array_join(F.transform(_drawn(seed, F.lit(4)), lambda x: (x % 254 + 1).cast("string")), ".")
    body = F.concat(_alike(F.expr("left(canon, length(canon) - 1)"), seed, 1), more("0", DRAWS))
    card = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string"))), _luhn)[0]
    account = F.concat(_alike(F.substring(canon, 5, 64), seed), more("0", DRAWS))
    country = F.substring(canon, 1, 2)
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    drawn = _drawn(seed, F.lit(32))
    script = F.when(canon.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    gender = F.substring(canon, 1, 1)
    gender = F.when(gender == "u", F.when(drawn[31] % 2 == 0, "m").otherwise("f")).otherwise(gender)
    joined = lambda pool, sep, n: F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: _pick(pool, F.get(drawn, i))), sep)
    names = F.least(attempt, F.lit(20))
    given = F.lower(reduce(lambda t, k: t.when((script == k[0]) & (gender == k[1]), joined(FIRST[k], "-", names)), FIRST, F.when(F.lit(False), "")))
    family = reduce(lambda t, k: t.when(script == k, joined(SYLLABLES[k], "", names + 2)), SYLLABLES, F.when(F.lit(False), ""))
    family = F.concat(family, F.when(canon.rlike(GENDERED), "ов").otherwise(""))
    secret = F.concat(F.when(canon.rlike("^[0-9a-f]+$"), _hex_alike(canon, seed)).otherwise(_alike(canon, seed)), more("0", DRAWS))
    out = F.when(kind == "email", email).when(kind == "domain", domain).when(kind == "ipv4", F.concat(ip, F.when(attempt > DRAWS, F.concat(F.lit("."), more("0", DRAWS))).otherwise("")))
    out = out.when(kind == "card", card).when(kind == "iban", iban).when(kind == "given", given).when(kind == "surname", family)
    out = out.when(kind == "aws_key", F.concat(_alike(canon, seed, 4), more("0", DRAWS))).when(kind == "secret", secret)
    return out.when(kind == "ipv6", F.concat(_hex_alike(canon, seed), more("0", DRAWS))).otherwise(F.concat(_alike(canon, seed, F.when(kind == "phone", _kept_digits(canon)).otherwise(1)), more("0", DRAWS)))


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) of distinct entities (kind, canon), with distinct surrogates that are no entity."""
    waiting, taken, draw = entities.select("kind", "canon"), None, 0
    bare = F.when(F.col("kind") == "given", F.expr("substring(canon, 3)")).otherwise(F.col("canon"))
    real = entities.select("kind", bare.alias("surrogate")).distinct()
    while True:
        tried = waiting.withColumn("surrogate", surrogate(F.col("kind"), F.col("canon"), F.lit(draw), key))
        first = tried.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"))
        first = first.join(real, ["kind", "surrogate"], "left_anti")
        if taken is not None:
            first = first.join(taken.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        first = stage(first.select("kind", "canon", "surrogate"), "surrogates")
        taken = first if taken is None else taken.unionByName(first)
        waiting = stage(waiting.join(first, ["kind", "canon"], "left_anti"), "waiting")
        draw += 1
        if waiting.isEmpty():
            return taken


def _filled(mention: Column, replacement: Column, place: str) -> Column:
    """The mention with the replacement's characters at its places of a class, and what is left of them at its end."""
    put = lambda t, c: F.struct(F.concat(t["s"], F.when(c.rlike(place), F.substring(replacement, t["i"], F.lit(1))).otherwise(c)).alias("s"), F.when(c.rlike(place), t["i"] + 1).otherwise(t["i"]).alias("i"))
    end = F.aggregate(F.split(mention, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("i")), put)
    return F.concat(end["s"], F.substring(replacement, end["i"], F.length(replacement)))


def _cased(like: Column, name: Column) -> Column:
    """A name in capitals if its mention is, else with first letters in capitals."""
    parts = F.array_join(F.transform(F.split(name, "-"), F.initcap), "-")
    return F.when(like == F.upper(like), F.upper(name)).otherwise(parts)


def _masculine(word: Column) -> Column:
    """The masculine form of a Russian surname, as which it is looked up; other words stay."""
    return F.regexp_replace(F.regexp_replace(word, "(?<=ов|ев|ёв|ин|ын)а$", ""), "(?<=[сц]к)ая$", "ий")


def _is_feminine(word: Column) -> Column:
    return word.rlike("(?:(?:ов|ев|ёв|ин|ын)а|[сц]кая)$")


def _given(name: Column) -> Column:
    """The words before the surname less its particles."""
    ahead = F.regexp_replace(name, "(^| )[^ ]+$", "")
    return F.trim(F.regexp_replace(ahead, rf"(?<![^ ])(?:{'|'.join(PARTICLES)})(?![^ ])", ""))


def people(e: Column) -> Column:
    """(full, given, family, gender) of the titled names among mentions (m, kind), in lower case; given may be empty."""
    gender = lambda m: F.when(m.rlike(f"^(?:{_CASES(FEMALE)})[. ]"), "f").when(m.rlike(f"^(?:{_CASES(MALE)})[. ]"), "m").otherwise("u")
    full = lambda m: F.lower(F.regexp_replace(m, f"^(?:{_TITLES})\\.? ", ""))
    person = lambda x: F.struct(_given(full(x["m"])).alias("given"), _masculine(F.regexp_extract(full(x["m"]), "[^ ]+$", 0)).alias("family"), gender(x["m"]).alias("gender"))
    return F.transform(F.filter(e, lambda x: x["kind"] == "name"), person)


def resolve(x: Column, known: Column) -> Column:
    """(kind, head, body, tail, given, family) of a mention: what of it is replaced and what stands around, and for a name
    the canonical given name and surname it stands for; kind is null if nothing is replaced."""
    m, kind = x["m"], x["kind"]
    name = F.regexp_replace(m, f"^(?:{_TITLES})\\.? ", "")
    low = F.lower(name)
    last, ahead = _masculine(F.regexp_extract(low, "[^ ]+$", 0)), _given(low)
    of = lambda test: F.filter(known, test)
    named = lambda p, word: (p["given"] != "") & ((p["given"] == word) | F.array_contains(F.split(p["given"], " "), word))
    same_full = of(lambda p: (p["family"] == last) & ((p["given"] == ahead) | named(p, ahead)))
    family = of(lambda p: p["family"] == last)
    first = of(lambda p: named(p, low))
    canon = lambda p: F.when(p["given"] != "", F.concat(p["gender"], F.lit("|"), p["given"]))
    none = F.lit(None).cast("string")
    out = lambda kind, head, body, tail, given, fam: F.struct(kind.alias("kind"), head.alias("head"), body.alias("body"), tail.alias("tail"), given.alias("given"), fam.alias("family"))
    empty, word = F.lit(""), F.regexp_extract(m, "[^ ]+$", 0)
    value = F.when(m.rlike("^[\"']"), F.regexp_extract(m, "[0-9a-f]+", 0)).otherwise(F.regexp_extract(m, f"{_VALUE}{{8,}}$", 0))
    value = F.when(m.rlike(f"^{_PREFIXES}"), F.regexp_replace(m, f"^{_PREFIXES}", "")).when(m.rlike(f"^(?i:{_LABELS})"), F.regexp_replace(m, f"^(?i:{_LABELS})[\"']? ?[=:] ?[\"']?", "")).otherwise(value)
    around = F.when(m.rlike("^[\"']"), F.substring(m, 1, 1)).otherwise(F.substring(m, F.lit(1), F.length(m) - F.length(value)))
    run = (
        F.when((ahead != "") & (F.size(same_full) > 0), out(F.lit("name"), empty, m, empty, canon(F.get(same_full, 0)), last))
        .when(F.size(family) > 0, out(F.lit("name"), F.substring(m, F.lit(1), F.length(m) - F.length(word)), word, empty, none, last))
        .when(F.size(first) > 0, out(F.lit("name"), empty, m, empty, canon(F.get(first, 0)), none))
        .otherwise(out(none, empty, m, empty, none, none))
    )
    titled = out(F.lit("name"), F.substring(m, F.lit(1), F.length(m) - F.length(name)), name, empty, F.when(ahead != "", canon(F.get(same_full, 0))), last)
    secret = out(kind, around, value, F.when(m.rlike("^[\"']"), F.substring(m, -1, 1)).otherwise(empty), none, none)
    return F.when(kind == "name", titled).when(kind == "run", run).when(kind == "secret", secret).otherwise(out(kind, empty, m, empty, none, none))


def find_mentions(texts: DataFrame) -> DataFrame:
    """(r1, r2, k, kind, head, body, tail, given, family) of all mentions of texts (r1, r2, t), in their order k."""
    found = texts.where(F.col("t").rlike("[0-9@\"'=_]") | F.col("t").rlike(_NAME)).withColumn("names", F.col("t").rlike(_NAME))
    every = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(0))
    found = found.select("r1", "r2", F.when(F.col("names"), every(NAMING)).otherwise(every(PATTERN)).alias("m")).where(F.size("m") > 0)
    e = found.select("r1", "r2", F.transform("m", lambda m: F.struct(m.alias("m"), classify(m).alias("kind"))).alias("e"))
    e = e.withColumn("known", people(F.col("e"))).select("r1", "r2", "known", F.posexplode("e").alias("k", "x"))
    return e.select("r1", "r2", "k", resolve(F.col("x"), F.col("known")).alias("y")).select("r1", "r2", "k", "y.*")


def _with(mentions: DataFrame, table: DataFrame, kind: str, canon: str, name: str) -> DataFrame:
    """mentions with the surrogate of the entity (kind, canon); rows without a canon do not enter the join."""
    keyed = table.select(F.col("kind").alias("t_kind"), F.col("canon").alias("t_canon"), F.col("surrogate").alias(name))
    on = (F.expr(kind) == F.col("t_kind")) & (F.col(canon) == F.col("t_canon"))
    done = mentions.where(F.col(canon).isNotNull()).join(keyed, on).drop("t_kind", "t_canon")
    return done.unionByName(mentions.where(F.col(canon).isNull()).withColumn(name, F.lit(None).cast("string")))


def pseudonymize(docs: DataFrame, *, key: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """All columns of docs with replaced mentions in the text, and ``entities``: array of (kind, mention, surrogate).

    Equal entities get equal surrogates in the whole table and different ones different surrogates; the same key gives
    the same surrogates for the same table. A null text stays null with no entities; doc_id may be null or tied. Repeated
    rows get equal results; of colliding entities the least keeps the surrogate, and the others draw on from spaces that
    grow, so the drawing ends. Texts and secrets have any length. A column named entities is replaced. An empty table
    gives no rows.
    """
    kept = [c for c in docs.columns if c != "entities"]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    rows = docs.select(row, *row_keys(f"`{id_col}`", f"`{text_col}`"))
    text = F.col("row")[text_col]
    mentions = find_mentions(rows.select("r1", "r2", text.alias("t")))
    low, digits = F.lower("body"), _digits(F.col("body"))
    canon = F.when((F.col("kind") == "phone") & F.col("body").startswith("+"), F.concat(F.lit("+"), digits)).when(F.col("kind").isin("phone", "card", "ssn"), digits).when(F.col("kind") == "iban", F.replace(F.col("body"), F.lit(" "), F.lit("")))
    canon = canon.when(F.col("kind").isin("email", "ipv6"), low).when(F.col("kind") != "name", F.col("body"))
    mentions = mentions.withColumn("canon", canon).withColumn("domain", F.when(F.col("kind") == "email", F.substring_index(low, "@", -1)))
    mentions = stage(mentions, "mentions")
    each = F.array(*[F.struct(F.expr(k).alias("kind"), F.col(c).alias("canon")) for k, c in _REFS])
    entities = stage(mentions.select(F.explode(each).alias("x")).select("x.*").where("canon IS NOT NULL").distinct(), "entities")
    table = stage(surrogate_table(entities, key), "surrogates")
    for k, c in _REFS:
        mentions = stage(_with(mentions, table, k, c, f"new_{c}"), "replaced")
    own = F.when(F.col("kind").isin("phone", "card", "ssn"), _filled(F.col("body"), F.replace(F.col("new_canon"), F.lit("+"), F.lit("")), "[0-9]")).when(F.col("kind") == "iban", _filled(F.col("body"), F.col("new_canon"), "[A-Z0-9]"))
    email = F.concat(F.substring_index("new_canon", "@", 1), F.lit("@"), F.col("new_domain"))
    own = own.when(F.col("kind") == "email", F.when(F.col("body") == F.upper("body"), F.upper(email)).otherwise(email))
    feminine = F.when(_is_feminine(low) & F.col("new_family").rlike(GENDERED), F.concat(F.col("new_family"), F.lit("а"))).otherwise(F.col("new_family"))
    own = own.when(F.col("kind") == "name", F.concat_ws(" ", _cased(F.col("body"), F.col("new_given")), _cased(F.col("body"), feminine)))
    own = own.when(F.col("kind").isNotNull(), F.col("new_canon")).otherwise(F.col("body"))
    shown = mentions.distinct().groupBy("r1", "r2").agg(F.sort_array(F.collect_list(F.struct("k", "kind", "head", F.col("body").alias("mention"), "tail", own.alias("surrogate")))).alias("e"))
    # texts without a replaced mention stay as they are
    shown = shown.where(F.exists("e", lambda x: x["kind"].isNotNull()))
    # one plan at every size: a table that is small enough to be broadcast today grows with the corpus
    both = rows.join(shown.hint("merge"), ["r1", "r2"], "left")
    parts = F.when(text.rlike(_NAME), F.split(text, NAMING)).otherwise(F.split(text, PATTERN))
    pieces = F.zip_with(parts, "e", lambda p, e: F.concat_ws("", p, e["head"], e["surrogate"], e["tail"]))
    new = F.when(F.size("e") > 0, F.array_join(pieces, "")).otherwise(text)
    real = F.transform(F.filter("e", lambda e: e["kind"].isNotNull()), lambda e: F.struct(e["kind"].alias("kind"), e["mention"].alias("mention"), e["surrogate"].alias("surrogate")))
    columns = [new.alias(text_col) if c == text_col else F.col("row")[c].alias(c) for c in kept]
    return both.select(*columns, F.coalesce(real, F.array().cast("array<struct<kind:string,mention:string,surrogate:string>>")).alias("entities"))


#: Entities of a mention: expressions of their kind, and the columns of their canonical forms.
_REFS = [("kind", "canon"), ("'domain'", "domain"), ("'given'", "given"), ("'surname'", "family")]
