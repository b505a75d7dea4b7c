"""PII surrogates: keyed, type-consistent replacements of the entities found in texts.

Only DataFrame functions. Every distinct entity (type and canonical form) gets one surrogate drawn from an HMAC of it; surrogates that
two entities share, or that are themselves entities of the corpus, are drawn again until none is left, so equal entities stay equal
(coreference) and different ones different. Family and given names are entities of their own: a surname alone is replaced as in the
full name, in every document. A surrogate is rendered in the format of each written form: separators, digit count, letter
case, country prefix, top-level domain, script and gender are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import row_of, spread_join, stored

#: Titles by gender (n: either) of people in Latin and Cyrillic script.
TITLES = {
    "m": ("Mr", "Sir", "Lord", "Herr", "Monsieur", "Señor", "Господин", "господин"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Lady", "Frau", "Madame", "Señora", "Госпожа", "госпожа"),
    "n": ("Dr", "Doctor", "Prof", "Professor", "Mx", "Доктор", "доктор"),
}
#: Given names by gender: they mark people without a title, and the first draws are among them.
GIVEN = {
    "latin": {
        "m": (
            "Adam", "Alexander", "Andrew", "Anthony", "Benjamin", "Brian", "Bruno", "Carl", "Carlos", "Charles", "Christopher", "Daniel", "David", "Edward", "Emil", "Eric", "Felix", "Frank", "George", "Hans",
            "Henry", "Hugo", "Jack", "James", "Jean", "John", "Jonas", "Joseph", "Juan", "Kevin", "Leon", "Louis", "Martin", "Matthew", "Michael", "Oscar", "Paul", "Peter", "Pierre", "Richard",
            "Robert", "Samuel", "Simon", "Stephen", "Thomas", "Victor", "Walter", "William",
        ),
        "f": (
            "Alice", "Alma", "Amanda", "Anna", "Barbara", "Bella", "Carmen", "Clara", "Diana", "Elizabeth", "Emily", "Emma", "Flora", "Greta", "Hannah", "Helen", "Ingrid", "Irene", "Jane", "Jennifer",
            "Jessica", "Julia", "Karen", "Laura", "Linda", "Lisa", "Lucia", "Margaret", "Maria", "Marie", "Mary", "Monica", "Nancy", "Nora", "Olivia", "Patricia", "Paula", "Rosa", "Sandra", "Sarah",
            "Sophie", "Susan", "Teresa", "Ursula", "Vera", "Victoria", "Yvonne", "Zoe",
        ),
        "n": ("Alex", "Casey", "Dana", "Jamie", "Jordan", "Kim", "Morgan", "Robin"),
    },
    "cyrillic": {
        "m": ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Семён", "Юрий"),
        "f": ("Алла", "Вера", "Галина", "Дарья", "Ева", "Жанна", "Зоя", "Ирина", "Клара", "Лидия", "Мария", "Нина", "Ольга", "Раиса", "Софья", "Юлия"),
        "n": ("Саша", "Женя", "Валя", "Слава"),
    },
}
#: Parts of names that are made up, and the endings of given names by gender.
PARTS = {
    "latin": ("bar", "ben", "dor", "fel", "gan", "hol", "kel", "lor", "man", "mor", "nes", "ral", "sel", "tor", "val", "wen"),
    "cyrillic": ("бар", "бел", "вер", "гор", "дол", "зор", "кал", "лан", "мор", "нес", "пол", "рос", "сар", "тол", "фом", "чер"),
}
ENDINGS = {"latin": {"m": "us", "f": "ina", "n": "is"}, "cyrillic": {"m": "ий", "f": "ина", "n": "ша"}}
_NAME = r"\p{Lu}[\p{L}'’-]{1,30}"
_TITLE = "|".join(t for v in TITLES.values() for t in v)
_KNOWN = "|".join(sorted({n for s in GIVEN.values() for g in s.values() for n in g}))
_ATOM = r"[\p{L}\p{N}.!#$%&'*+/=?^_`{|}~-]"
_LABEL = r"[\p{L}\p{N}-]{1,63}"
#: Type -> pattern, in order of precedence.
PATTERNS = {
    "email": rf"(?<![\p{{L}}\p{{N}}])[\p{{L}}\p{{N}}_]{_ATOM}{{0,254}}+@{_LABEL}(?:\.{_LABEL}){{0,8}}\.\p{{L}}{{2,24}}",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|(?:[0-9a-f]{32,128}+|[0-9A-F]{32,128}+))(?![A-Za-z0-9])",
    "token": r"(?<![A-Za-z0-9])(?:sk|pk|rk|ghp|gho|ghs|xoxb|xoxp|glpat)[-_][A-Za-z0-9_-]{16,255}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{1,7}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,6}|[0-9A-Fa-f]{1,4}:(?::[0-9A-Fa-f]{1,4}){2,6}|[23Ff][0-9A-Fa-f]{3}::[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])|(?<![0-9.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])",
    "person": rf"(?<!\p{{L}})(?=\p{{L}})(?:(?:{_TITLE})\.? {_NAME}(?: \p{{Lu}}\.)?(?: {_NAME})?|(?=\p{{Lu}})(?iu:{_KNOWN}) (?:\p{{Lu}}\. )?{_NAME})",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Cheap test that no text with an entity fails.
HINT = rf"[0-9@]|AKIA|[0-9a-fA-F]{{32}}|[-_][A-Za-z0-9_-]{{16}}|:[0-9a-fA-F]{{0,4}}:|(?<!\p{{L}})(?:{_TITLE})\.? |(?<!\p{{L}})(?=\p{{Lu}})(?iu:{_KNOWN}) "
#: A country prefix that a separator ends; it stays as it is, and numbers with and without it are the same.
_COUNTRY = "^[+][0-9]{1,3}(?=[ .(-])"
#: Kinds of a fixed number of surrogates, as SQL of the length of the canonical form. Where entities fill a quarter of it, they swap places.
CAPACITY = {"card": "pow(10, length(canon) - 2)", "ssn": "pow(10, 8)", "phone": "pow(10, length(canon))", "ip": "223 * pow(256, 3)", "iban": "pow(10, length(canon) - 2)"}


def _type_of(raw: Column) -> Column:
    """Type of a whole match; the first pattern that matches it whole."""
    out = F.lit("person")
    for name in reversed([*PATTERNS][:-1]):
        out = F.when(raw.rlike(f"^(?:{PATTERNS[name]})$"), name).otherwise(out)
    return out


def _canonical(kind: Column, raw: Column) -> Column:
    """One form for all writings of an entity other than a person."""
    halves = F.split(F.lower(raw), "::")
    groups = lambda i: F.filter(F.split(F.get(halves, F.lit(i)), ":"), lambda x: x != "")
    middle = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(groups(0)) - F.coalesce(F.size(groups(1)), F.lit(0))))
    whole = F.concat(groups(0), middle, F.coalesce(groups(1), F.array().cast("array<string>")))
    return (
        F.when(kind.isin("email", "secret"), F.lower(raw))
        .when(kind == "phone", F.regexp_replace(F.regexp_replace(raw, _COUNTRY, ""), "[^0-9]", ""))
        .when(kind.isin("card", "ssn"), F.regexp_replace(raw, "[^0-9]", ""))
        .when(kind == "iban", F.regexp_replace(raw, " ", ""))
        .when(kind == "ipv6", F.array_join(F.transform(whole, lambda x: F.lpad(x, 4, "0")), ":"))
        .otherwise(raw)
    )


def _digits(h: str, n: str, at: int = 1) -> str:
    """SQL: n decimal digits from a hex digest of 128 characters."""
    return f"substr(translate({h}, 'abcdef', '470258'), {at}, {n})"


def _pick(at: int, width: int, values: tuple[str, ...]) -> str:
    """SQL: one of the values by width hex digits of the digest h."""
    return f"element_at(array({', '.join(repr(v) for v in values)}), 1 + cast(conv(substr(h, {at}, {width}), 16, 10) as int) % {len(values)})"


def _made_up(script: str, attempt: str = "attempt") -> str:
    """SQL: a name of three parts of the script, and one more for each attempt after the first: as many names as are ever needed."""
    parts = ", ".join(repr(p) for p in PARTS[script])
    return f"array_join(transform(sequence(1, least(60, 3 + {attempt})), i -> element_at(array({parts}), 1 + cast(conv(substr(h, 2 * i, 1), 16, 10) as int))), '')"


def _draw() -> Column:
    """Canonical surrogate from columns kind, canon, gender, attempt and digest h (512 bits)."""
    byte = lambda at: f"cast(conv(substr(h, {at}, 2), 16, 10) as int)"
    luhn = (
        "aggregate(sequence(1, length(canon) - 1), 0, (s, i) -> s + if((length(canon) - i) % 2 = 1,"
        f" if(2 * cast(substr({{d}}, i, 1) as int) > 9, 2 * cast(substr({{d}}, i, 1) as int) - 9, 2 * cast(substr({{d}}, i, 1) as int)), cast(substr({{d}}, i, 1) as int)))"
    )
    card = f"concat(substr(canon, 1, 1), {_digits('h', 'length(canon) - 2')})"
    given = {
        s: "case gender " + " ".join(f"when '{g}' then if(attempt < 2, {_pick(3, 4, tuple(n.lower() for n in names))}, concat({_made_up(s)}, '{ENDINGS[s][g]}'))" for g, names in by.items()) + " end"
        for s, by in GIVEN.items()
    }
    return F.expr(f"""case kind
        when 'email' then concat({_pick(1, 2, tuple(n.lower() for n in GIVEN['latin']['n']))}, '.', substr(h, 3, 12), '@example.', regexp_extract(canon, '[.]([^.]+)$', 1))
        when 'card' then concat({card}, cast(pmod(10 - {luhn.format(d=card)} % 10, 10) as string))
        when 'ssn' then concat('9', {_digits('h', '8')})
        when 'phone' then {_digits('h', 'length(canon)')}
        when 'ip' then concat_ws('.', 1 + {byte(1)} % 223, {byte(3)}, {byte(5)}, {byte(7)})
        when 'ipv6' then concat_ws(':', '2001', '0db8', {', '.join(f'substr(h, {i}, 4)' for i in range(1, 25, 4))})
        when 'iban' then concat(substr(canon, 1, 2), {_digits('h', 'length(canon) - 2')})
        when 'secret' then if(canon like 'akia%', concat('akia', substr(translate(h, '018', 'xyz'), 1, 16)), substr(repeat(h, 2), 1, length(canon)))
        when 'token' then concat(regexp_extract(canon, '^[a-z]+[-_]', 0), substr(repeat(h, 3), 1, length(canon) - length(regexp_extract(canon, '^[a-z]+[-_]', 0))))
        when 'family:latin' then {_made_up('latin')}
        when 'family:cyrillic' then {_made_up('cyrillic')}
        when 'given:latin' then {given['latin']}
        when 'given:cyrillic' then {given['cyrillic']} end""")


def _render() -> Column:
    """A surrogate in the written form of an entity other than a person: digits go to the places of digits, letters keep their case."""
    at = "length(regexp_replace(substr(raw, 1, i + 1), '[^0-9]', ''))"
    prefix = f"if(kind = 'phone', greatest(0, length(regexp_extract(raw, '{_COUNTRY}', 0)) - 1), 0)"
    spread = f"array_join(transform(split(raw, ''), (c, i) -> if(c rlike '[0-9]' and {at} > {prefix}, substr(surrogate, {at} - {prefix}, 1), c)), '')"
    place = "length(regexp_replace(substr(raw, 1, i + 1), ' ', ''))"
    letters = (
        f"array_join(transform(split(raw, ''), (c, i) -> if(c = ' ', c, if(c rlike '[0-9]' or {place} <= 2,"
        f" substr(surrogate, {place}, 1), translate(substr(surrogate, {place}, 1), '0123456789', 'ABCDEFGHIJ')))), '')"
    )
    return F.expr(f"""case
        when kind in ('phone', 'card', 'ssn') then {spread}
        when kind = 'iban' then {letters}
        when kind in ('email', 'secret', 'ipv6') then if(raw = upper(raw) and raw <> lower(raw), upper(surrogate), surrogate)
        else surrogate end""")


def _people(forms: DataFrame) -> DataFrame:
    """forms(raw) of people -> (raw, title, given, middle, family, gender by title, script)."""
    bare = F.regexp_replace("raw", rf"^(?:{_TITLE})\.? ", "")
    words = F.split(bare, " ")
    script = F.when(F.element_at(words, -1).rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    title = F.regexp_extract("raw", rf"^(?:{_TITLE})\.? ", 0)
    gender = F.lit(None).cast("string")
    for g, names in TITLES.items():
        gender = F.when(title.rlike(rf"^(?:{'|'.join(names)})\.? $"), g).otherwise(gender)
    return forms.select(
        "raw", title.alias("title"), F.when(F.size(words) > 1, F.element_at(words, 1)).alias("given"), (F.size(words) > 2).alias("middle"), F.element_at(words, -1).alias("family"), gender.alias("gender"),
        script.alias("script"),
    )


def _genders(people: DataFrame) -> DataFrame:
    """(kind, canon, gender) of given names: known names by the list, others by the titles they are written with, else n."""
    known = F.lit(None).cast("string")
    for by in GIVEN.values():
        for g, names in by.items():
            known = F.when(F.lower("given").isin(*[n.lower() for n in names]), g).otherwise(known)
    titled = lambda g: F.count(F.when(F.col("gender") == g, 1))
    own = people.where("given is not null").groupBy(F.concat(F.lit("given:"), "script").alias("kind"), F.lower("given").alias("canon")).agg(F.max(known).alias("known"), titled("m").alias("m"), titled("f").alias("f"))
    return own.select("kind", "canon", F.coalesce("known", F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise("n")).alias("gender"))


def _digest(key: bytes) -> Column:
    """HMAC-SHA512 of kind, canon and attempt in hex."""
    import hashlib

    padded = (hashlib.sha512(key).digest() if len(key) > 128 else key).ljust(128, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in padded)) for x in (0x36, 0x5C))
    message = F.concat_ws("\x1f", "kind", "canon", F.col("attempt").cast("string")).cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 512))), 512)


def assign_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities(kind, canon, gender), distinct by kind and canon -> (kind, canon, surrogate), surrogates distinct within a kind and no entity of it.

    Draws go on until none collides. Kinds and lengths whose entities fill a quarter of all possible surrogates cannot stay clear of
    real entities: there each takes the place of the next one in keyed order, which is distinct as well and never the entity itself.
    """
    capacity = F.lit(None).cast("double")
    for kind, sql in CAPACITY.items():
        capacity = F.when(F.col("kind") == kind, F.expr(sql)).otherwise(capacity)
    sized = entities.withColumn("length", F.length("canon")).withColumn("capacity", capacity)
    # a few kinds times the lengths of their numbers
    crowded = F.broadcast(stored(sized.where("capacity is not null").groupBy("kind", "length", "capacity").agg(F.count("*").alias("n")).where("4 * n > capacity and n > 1").select("kind", "length")))
    free = sized.join(crowded, ["kind", "length"], "left_anti").select("kind", "canon", "gender")
    secret = _digest(key.encode())
    by = Window.partitionBy("kind", "length").orderBy("order", "canon")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ordered = sized.join(crowded, ["kind", "length"]).withColumn("attempt", F.lit(0)).withColumn("order", secret)
    swapped = ordered.select("kind", "canon", F.coalesce(F.lead("canon").over(by), F.first("canon").over(whole)).alias("surrogate"))

    drawn = stored(free.withColumn("attempt", F.lit(0)).withColumn("h", secret).withColumn("surrogate", _draw()).drop("h"))
    real = stored(entities.select(F.col("kind").alias("r_kind"), F.col("canon").alias("r_canon")))
    while True:
        # the smallest canonical form keeps a shared surrogate; one that is a real entity is never kept
        owner = drawn.groupBy(F.col("kind").alias("o_kind"), F.col("surrogate").alias("o_surrogate")).agg(F.min("canon").alias("owner"))
        judged = stored(
            drawn.join(owner, F.expr("kind = o_kind and surrogate = o_surrogate")).join(real, F.expr("kind = r_kind and surrogate = r_canon"), "left")
            .select("kind", "canon", "gender", "attempt", "surrogate", F.expr("canon <> owner or r_canon is not null").alias("bad"))
        )
        if judged.where("bad").isEmpty():
            return judged.select("kind", "canon", "surrogate").unionByName(swapped)
        again = judged.where("bad").withColumn("attempt", F.col("attempt") + 1).withColumn("h", secret).withColumn("surrogate", _draw()).drop("h", "bad")
        drawn = stored(judged.where("not bad").drop("bad").unionByName(again), replaces=drawn)


def find_entities(text: Column) -> Column:
    """Array of the entities of a text in order; null where it has none."""
    found = F.regexp_extract_all(text, F.lit(f"({ENTITY})"), F.lit(1))
    return F.when(text.rlike(HINT), F.when(F.size(found) > 0, found))


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with its entities replaced in text_col, plus n_entities (long), which takes the place of a column of that name.

    Columns and rows of docs are kept. Null texts stay null and texts without an entity stay as they are, both with 0 entities; repeated rows are
    replaced alike, null ids need no care; texts of any length are replaced whole; an empty table gives an empty result; other columns never
    clash. key is secret: equal keys give equal surrogates on equal corpora.
    """
    columns = [c for c in docs.columns if c != "n_entities"]
    text = F.col(f"row.`{text_col}`")
    base = stored(docs.select(row_of(docs).alias("row"), F.monotonically_increasing_id().alias("place")).withColumn("found", find_entities(text.cast("string"))))
    hits = base.where("found is not null").select("place", F.posexplode("found").alias("at", "raw"))
    counts = stored(hits.groupBy("raw").agg(F.count("*").alias("n")))
    forms = stored(counts.select("raw", _type_of(F.col("raw")).alias("kind")))
    things = forms.where("kind <> 'person'").withColumn("canon", _canonical(F.col("kind"), F.col("raw")))
    people = stored(_people(forms.where("kind = 'person'")))
    none = F.lit(None).cast("string").alias("gender")
    families = people.select(F.concat(F.lit("family:"), "script").alias("kind"), F.lower("family").alias("canon"), none)
    surrogates = stored(assign_surrogates(things.select("kind", "canon", none).unionByName(families).distinct().unionByName(_genders(people)), key))

    shown_things = things.join(surrogates, ["kind", "canon"]).select("raw", _render().alias("shown"))
    cased = lambda name, as_in: F.when((F.col(as_in) == F.upper(as_in)) & (F.length(as_in) > 1), F.upper(name)).otherwise(F.initcap(name))
    of = lambda part: surrogates.where(F.col("kind").startswith(f"{part}:")).select(F.col("kind").alias(f"{part}_kind"), F.col("canon").alias(f"{part}_canon"), F.col("surrogate").alias(f"new_{part}"))
    named = reduce(
        lambda df, part: df.join(of(part), (F.concat(F.lit(f"{part}:"), "script") == F.col(f"{part}_kind")) & (F.lower(part) == F.col(f"{part}_canon")), "left"), ("family", "given"), people
    )
    initial = F.when(F.col("middle"), F.concat(F.upper(F.substring("new_family", 2, 1)), F.lit(".")))
    shown_people = named.select("raw", F.concat("title", F.concat_ws(" ", cased("new_given", "given"), initial, cased("new_family", "family"))).alias("shown"))
    shown = shown_things.unionByName(shown_people)

    placed = spread_join(hits, shown, "raw", counts, F.col("place"))
    by_row = placed.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("at", "shown"))).alias("s"))
    filled = F.zip_with(F.split(text, ENTITY, -1), F.expr("transform(s, x -> x.shown)"), lambda p, s: F.concat(p, F.coalesce(s, F.lit(""))))
    put = lambda value, n: [*[value.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in columns], n.cast("long").alias("n_entities")]
    replaced = base.where("found is not null").join(by_row, "place").select(*put(F.array_join(filled, ""), F.size("s")))
    return base.where("found is null").select(*put(text, F.lit(0))).unionAll(replaced)
