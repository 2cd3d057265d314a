"""Surrogates for personal data.

Entities are found by one pattern over whole texts, reduced to a normal form (so that spellings of
one entity are one), and given a keyed surrogate of the same kind: digits for digits with the
punctuation, length, country code and check digit kept, letters of the same script and case,
names of the same gender and script.  Of a person every capitalised word after the title or given
name is replaced, each name by itself, so that a surname has one surrogate with and without the given
name; titles and initials stay.  The mapping is made once over all distinct entities:
a surrogate that two entities share, or that is itself an entity of the corpus, is drawn again
until none is left (a later draw is longer, where the place has no more of the length), so distinct entities stay distinct and one entity has one surrogate
everywhere.

Only texts that hold an entity take part in a join; all others pass through.  What is shuffled per
text is the text itself and its own entities.

Defined results: null and empty texts stay as they are; texts without entities stay byte for
byte; where patterns overlap the leftmost match counts, then the one listed first; draws that tie
go to the smaller normal form; repeated rows and copies get equal results; an empty table stays
empty; all other columns pass through (inside one struct, so their names cannot clash).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersieve.llm.common import stored
from ledgersieve.llm.spans import matches

KEY = "ledgersieve-surrogates-1"
#: Numbers keep their length in so many draws after the first; later ones have more digits at their end.
SAME_LENGTH = 8

# Titles by gender, common given names by gender and script.
TITLES = {
    "m": ("Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "господин", "г-н"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "госпожа", "г-жа"),
    "n": ("Dr", "Prof", "Professor", "Professorin", "Doctor", "Mx", "доктор", "профессор"),
}
GIVEN = {
    "m": ("James", "John", "Robert", "Michael", "William", "Hans", "Jürgen", "Klaus", "Pierre", "Jean", "José", "Carlos",
          "Иван", "Сергей", "Дмитрий"),
    "f": ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Ursula", "Monika", "Sabine", "Marie", "Sophie", "María",
          "Carmen", "Анна", "Мария", "Ольга"),
}

_TITLE = "|".join(t for g in TITLES.values() for t in g)
_NAMES = "|".join(n for g in GIVEN.values() for n in g)
_TITLES = rf"(?:(?:{_TITLE})\.? )"
#: One capitalised word of a name, with parts after hyphen or apostrophe; and those that follow, with initials, up to the next title.
_WORD = r"\p{Lu}(?:\p{L}+|['’]\p{Lu}\p{L}+)(?:['’-]\p{Lu}\p{L}+)*"
_MORE = rf"(?: (?:\p{{Lu}}\. )*(?!(?:{_TITLE})(?![\p{{L}}\p{{N}}])){_WORD})*"
#: Titles and names start with one of these; most places of a text fail here at once.
_INITIAL = "(?=[A-ZÀ-ÞА-Яа-я])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\+\d{1,3}(?:[ .-]\d{2,4}){2,4}(?!\d|\.\d)|\+\d{8,15}(?!\d)"
             r"|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{4}[ -]){3}\d{1,7}(?!\d)|(?<!\d)\d{13,19}(?!\d)",
    "person": rf"{_INITIAL}(?<![\p{{L}}\p{{N}}])(?:{_TITLES}+(?:\p{{Lu}}\. )*{_WORD}|(?:{_NAMES})(?![\p{{L}}\p{{N}}])){_MORE}",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _kind(found: Column) -> Column:
    kind = F.when(found.contains("@"), "email")
    for name in ("iban", "ip", "ssn", "phone", "card"):
        kind = kind.when(found.rlike(rf"^(?:{PATTERNS[name]})$"), name)
    return kind.otherwise("person")


def _title(found: Column) -> Column:
    return F.regexp_extract(found, rf"^({_TITLES}+)", 1)


def _names(found: Column) -> Column:
    """The words after the title: names, and initials, which stay."""
    return F.split(F.substr(found, F.length(_title(found)) + 1), " ")


def _gender(found: Column) -> Column:
    """That of the first title that tells it, or else of the given name; ``n`` where neither does."""
    gender, first = F.lit("n"), F.get(_names(found), F.lit(0))
    for g in "fm":
        gender = F.when(first.isin(*GIVEN[g]), g).otherwise(gender)
    neutral = rf"(?:(?:{'|'.join(TITLES['n'])})\.? )*"
    for g in "fm":
        gender = F.when(found.rlike(rf"^{neutral}(?:{'|'.join(TITLES[g])})\.? "), g).otherwise(gender)
    return gender


def _name_norm(gender: Column, name: Column) -> Column:
    return F.concat(gender, F.when(name.rlike(r"\p{IsCyrillic}"), "c").otherwise("l"), F.lit("/"), F.lower(name))


def _is_initial(name: Column) -> Column:
    return name.endswith(".")


def _norms(kind: Column, found: Column) -> Column:
    """Normal forms of what is replaced: each name of a person by itself, all else as a whole."""
    gender = _gender(found)
    names = F.transform(F.filter(_names(found), lambda n: ~_is_initial(n)), lambda n: _name_norm(gender, n))
    return F.when(kind == "person", names).otherwise(F.array(_norm(kind, found)))


def _norm(kind: Column, found: Column) -> Column:
    """What the spellings of one entity have in common, persons aside; phones keep their country code."""
    country = F.regexp_extract(found, r"^\+(\d{1,3})[^\d]", 1)
    digits = F.regexp_replace(found, r"[^0-9]", "")
    phone = F.concat(F.when(found.startswith("+"), F.lit("+")).otherwise(F.lit("")), country, F.lit("/"), F.substr(digits, F.length(country) + 1))
    return (
        F.when(kind == "email", F.lower(found))
        .when(kind == "ip", found)
        .when(kind == "iban", F.regexp_replace(found, " ", ""))
        .when(kind == "phone", phone)
        .otherwise(digits)
    )


def _byte(h: Column, i: Column) -> Column:
    """The i-th byte of the hexadecimal digest, from the start again when it ends."""
    return F.conv(F.substr(h, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letter(h: Column, i: Column, alphabet: str) -> Column:
    return F.substr(F.lit(alphabet), F.pmod(_byte(h, i), F.lit(len(alphabet))) + 1, F.lit(1))


def _scrambled(text: Column, h: Column) -> Column:
    """Digits for digits, letters for letters of the same script; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        return (
            F.when((i == 0) & c.rlike("[1-9]"), _letter(h, i, "123456789"))
            .when(c.rlike("[0-9]"), _letter(h, i, "0123456789"))
            .when(c.rlike("[a-z]"), _letter(h, i, "abcdefghijklmnopqrstuvwxyz"))
            .when(c.rlike("[A-Z]"), _letter(h, i, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .when(c.rlike(r"\p{IsCyrillic}"), _letter(h, i, "абвгдежзиклмнопрстуфхцчшэюя"))
            .when(c.rlike(r"\p{L}"), _letter(h, i, "àâäçéèêëîïñóôöùûü"))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every second from the right but the last doubled."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(F.pmod(n - i, F.lit(2)) == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _with_check_digit(digits: Column, valid: Column) -> Column:
    head = F.substr(digits, F.lit(1), F.length(digits) - 1)
    check = F.pmod(10 - F.pmod(_luhn(F.concat(head, F.lit("0"))), F.lit(10)), F.lit(10))
    return F.when(valid, F.concat(head, check.cast("string"))).otherwise(digits)


def _pick(h: Column, i: int, values: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(_byte(h, F.lit(i)), F.lit(len(values))))


# Syllables that names are made of, by script.
_FIRST = {"l": ("Al", "Bel", "Cor", "Dan", "El", "Fer", "Gal", "Hen", "Il", "Jor", "Kal", "Lor", "Mar", "Nor", "Or", "Per"),
          "c": ("Ал", "Бор", "Вал", "Гле", "Дан", "Ев", "Жан", "Зах", "Кон", "Лав", "Мар", "Ник", "Ол", "Пав", "Род", "Сав")}
_MIDDLE = {"l": ("a", "be", "di", "do", "ga", "le", "li", "ma", "mi", "na", "ne", "ra", "ri", "sa", "te", "vi"),
           "c": ("а", "бе", "ви", "го", "да", "ле", "ли", "ма", "ми", "на", "не", "ра", "ри", "са", "те", "ви")}
_LAST = {"lm": ("ric", "nor", "den", "mund", "bert", "vin", "las", "ton"), "lf": ("na", "lia", "ra", "bella", "ta", "sia", "mina", "da"),
         "cm": ("слав", "мир", "ан", "ор", "им", "ей", "ил", "ен"), "cf": ("на", "лия", "ра", "мила", "та", "сия", "мина", "да"),
         "ln": ("sen", "ley", "rick", "gard", "holm", "well", "ner", "dez"), "cn": ("ко", "дзе", "ук", "юк", "ян", "чук", "ец", "ых")}


def _name(norm: Column, h: Column, draw: Column) -> Column:
    """A name of the entity's gender and script; later draws have more syllables, so names never run out."""
    made = F.lit(None).cast("string")
    for script in "lc":
        for gender in "mfn":
            middle = F.array_join(F.transform(F.sequence(F.lit(0), draw), _middle(h, script)), "")
            whole = F.concat(_pick(h, 0, _FIRST[script]), middle, _pick(h, 1, _LAST[script + gender]))
            made = F.when(norm.startswith(f"{gender}{script}/"), whole).otherwise(made)
    return made


def _middle(h: Column, script: str):
    values = F.array(*[F.lit(v) for v in _MIDDLE[script]])
    return lambda i: F.get(values, F.pmod(_byte(h, i + 2), F.lit(len(_MIDDLE[script]))))


def _more(h: Column, draw: Column, alphabet: str) -> Column:
    """Two symbols per draw, 24 at most, which no corpus can fill; none for draws below 1."""
    again = F.sha2(F.concat(h, F.lit("/more")).cast("binary"), 256)
    symbols = F.transform(F.sequence(F.lit(1), F.lit(24)), lambda i: _letter(again, i, alphabet))
    return F.array_join(F.slice(symbols, F.lit(1), F.least(F.greatest(draw, F.lit(0)) * 2, F.lit(24))), "")


def surrogate(kind: Column, norm: Column, draw: Column, key: str) -> Column:
    """The draw-th surrogate of an entity, in normal form."""
    h = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, draw.cast("string")).cast("binary"), 256)
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    labels = F.split(domain, r"\.")
    n = F.size(labels)
    kept = F.concat(F.lit("example."), F.element_at(labels, -1))
    below = F.array_join(F.slice(labels, F.lit(1), F.greatest(n - 2, F.lit(0))), ".")
    host = F.when(n > 2, F.concat(_scrambled(below, F.sha2(h.cast("binary"), 256)), F.lit("."), kept)).otherwise(kept)
    # Later draws have longer labels in front of the host, so addresses never run out.
    host = F.when(draw > 0, F.concat(_more(h, draw, "abcdefghijklmnopqrstuvwxyz"), F.lit("."), host)).otherwise(host)
    digits = _more(h, draw - SAME_LENGTH, "0123456789")
    octets = [(F.pmod(_byte(h, F.lit(i)), F.lit(254)) + 1).cast("string") for i in range(4)]
    head, tail = F.substring_index(norm, "/", 1), F.substring_index(norm, "/", -1)
    return (
        F.when(kind == "email", F.concat(_scrambled(local, h), F.lit("@"), host))
        .when(kind == "ip", F.concat_ws(".", *octets))
        .when(kind == "iban", F.concat(F.substr(norm, F.lit(1), F.lit(2)), _scrambled(F.substr(norm, F.lit(3)), h), digits))
        .when(kind == "phone", F.concat(head, F.lit("/"), _scrambled(tail, h), digits))
        .when(kind == "card", _with_check_digit(F.concat(_scrambled(norm, h), digits), F.pmod(_luhn(norm), F.lit(10)) == 0))
        .when(kind == "ssn", F.concat(_scrambled(norm, h), digits))
        .otherwise(F.concat(F.substr(norm, F.lit(1), F.lit(3)), F.lower(_name(norm, h, draw))))
    )


def _written(kind: Column, found: Column, norm: Column) -> Column:
    """A normal form in the spelling of the place: its punctuation, spaces, case and title."""
    symbols = F.when(kind == "phone", F.regexp_replace(norm, r"[^0-9]", "")).otherwise(norm)

    def placed(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substr(found, F.lit(1), i), r"[^0-9A-Za-z]", ""))
        return F.when(c.rlike("[0-9A-Za-z]"), F.substr(symbols, before + 1, F.lit(1))).otherwise(c)

    def cased(c: Column, i: Column) -> Column:
        return F.when(F.substr(found, i + 1, F.lit(1)).rlike(r"^\p{Lu}"), F.upper(c)).otherwise(c)

    longer = F.substr(symbols, F.length(F.regexp_replace(found, r"[^0-9A-Za-z]", "")) + 1)
    local = F.array_join(F.transform(F.split(F.substring_index(norm, "@", 1), ""), cased), "")
    return (
        F.when(kind == "email", F.concat(local, F.lit("@"), F.substring_index(norm, "@", -1)))
        .when(kind == "ip", norm)
        .otherwise(F.concat(F.array_join(F.transform(F.split(found, ""), placed), ""), longer))
    )


def _person_written(found: Column, surrogate_of) -> Column:
    """Title and initials as they are, every name as its surrogate."""
    gender = _gender(found)

    def one(name: Column) -> Column:
        made = F.substr(surrogate_of(_name_norm(gender, name)), F.lit(4))
        shown = F.when(name.rlike(r"^\p{Lu}{2,}$"), F.upper(made)).otherwise(F.initcap(made))
        return F.when(_is_initial(name), name).otherwise(shown)

    return F.concat(_title(found), F.array_join(F.transform(_names(found), one), " "))


def _maybe(text: Column) -> Column:
    """Texts that could hold an entity: a cheap test that most texts fail."""
    return text.rlike(rf"[@0-9]|{_INITIAL}(?:(?:{_TITLE})\.? \p{{Lu}}|{_NAMES})")


def _holds(text: Column) -> Column:
    return F.coalesce(_maybe(text) & text.rlike(PATTERN), F.lit(False))


def mapping(entities: DataFrame, key: str = KEY) -> DataFrame:
    """``kind, norm, surrogate`` with one row per distinct entity and no surrogate twice or real.

    Each round ranks the entities that share a surrogate; the first keeps it and the others, with
    those whose surrogate is an entity of the corpus, draw again.  Later draws are longer, so there is
    room for all and the rounds end; addresses of computers keep their form, of which there are four
    billion.
    """
    drawn = stored(entities.select("kind", "norm").distinct().withColumn("draw", F.lit(0)), "pii-entities")
    real = drawn.select("kind", F.col("norm").alias("surrogate"), F.lit(True).alias("real"))
    same = Window.partitionBy("kind", "surrogate").orderBy("draw", "norm")
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        spread = drawn.repartition(parts, "kind", "norm")  # making a surrogate costs more than moving an entity
        made = spread.withColumn("surrogate", surrogate(F.col("kind"), F.col("norm"), F.col("draw"), key))
        checked = stored(
            made.join(real, ["kind", "surrogate"], "left")
            .withColumn("clash", (F.row_number().over(same) > 1) | F.coalesce("real", F.lit(False))).drop("real"),
            "pii-draws",
        )
        if checked.filter("clash").isEmpty():
            return checked.select("kind", "norm", "surrogate")
        drawn = checked.select("kind", "norm", (F.col("draw") + F.col("clash").cast("int")).alias("draw"))


def replaced(docs: DataFrame, text_col: str = "text", key: str = KEY, count_col: str | None = None) -> DataFrame:
    """The documents with surrogates in ``text_col``; ``count_col`` adds the number of entities replaced."""
    text = F.col("doc")[text_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))

    def entities(span: Column) -> Column:
        kind = _kind(span["found"])
        return F.transform(_norms(kind, span["found"]), lambda n: F.struct(kind.alias("kind"), n.alias("norm")))

    holding = rows.filter(_holds(text)).select("doc", F.sha2(text.cast("binary"), 256).alias("blob"))
    per_text = holding.select("blob", F.explode(F.array_distinct(F.flatten(F.transform(
        matches(text, PATTERN), entities
    )))).alias("e")).select("blob", "e.kind", "e.norm").distinct()
    per_text = stored(per_text, "pii-found")
    known = mapping(per_text, key)
    lookup = (
        per_text.join(known, ["kind", "norm"])
        .groupBy("blob").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "kind", "norm"), "surrogate"))).alias("lookup"))
    )

    def surrogate_of(kind: Column, norm: Column) -> Column:
        return F.element_at(F.col("lookup"), F.concat_ws("\x1f", kind, norm))

    def written(span: Column) -> Column:
        kind, found = _kind(span["found"]), span["found"]
        person = _person_written(found, lambda norm: surrogate_of(F.lit("person"), norm))
        return F.when(kind == "person", person).otherwise(_written(kind, found, surrogate_of(kind, _norm(kind, found))))

    def counted(value: Column) -> list[Column]:
        return [value.cast("long").alias(count_col)] if count_col else []

    pieces = F.split(text, PATTERN, -1)
    spans = F.col("spans")
    rebuilt = F.concat(
        F.array_join(F.flatten(F.transform(spans, lambda s, i: F.array(F.get(pieces, i), written(s)))), ""),
        F.element_at(pieces, -1),
    )
    names = [c for c in docs.columns if c != count_col]
    # Writing surrogates costs more than moving texts: they are dealt to all partitions, also where they are few bytes.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    changed = (
        holding.repartition(parts, "blob").join(lookup, "blob").withColumn("spans", matches(text, PATTERN))
        .select(*[rebuilt.alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in names], *counted(F.size(spans)))
    )
    others = rows.filter(~_holds(text)).select(*[F.col("doc")[c].alias(c) for c in names], *counted(F.lit(0)))
    return changed.unionByName(others)
