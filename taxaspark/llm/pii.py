"""Personal data replaced by surrogates. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxaspark.session import stage, task_count

# Titles that come before a name, by the gender they tell.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "Κύριος")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Doña", "Госпожа", "Κυρία")
OTHER_TITLES = ("Dr", "Prof")
CUES = ("My name is", "my name is", "Name:", "name:", "Contact:", "Patient:", "Author:")

# What may stand in lower case between the words of a name.
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "las", "los", "el", "al", "bin", "ibn", "ter", "ten", "zu", "zum", "y")

_WORD = r"[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}][\p{IsLatin}\p{IsCyrillic}\p{IsGreek}'’-]*"
_SHORT = ("Mr", "Sr", "Mrs", "Ms", "Mme", "Mlle", "Sra", *OTHER_TITLES)
_BEFORE = "|".join([rf"(?:{'|'.join(_SHORT)})\.?", *sorted({*MALE_TITLES, *FEMALE_TITLES} - {*_SHORT}), *CUES])
_NAME = rf"(?!(?:{_BEFORE})(?!\w))(?=\p{{Lu}}){_WORD}"
_NAMES = rf"(?:(?:{'|'.join(PARTICLES)}) +){{0,3}}{_NAME}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

#: Kinds and their patterns, tried in this order at each place of a text.
PATTERNS = {
    "email": r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<![\w.-])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{4}(?!\w)|(?<![\w+])\+\d{7,15}(?!\w)",
    "name": rf"(?<!\w)(?:{_BEFORE}) +{_NAMES}(?: +{_NAMES})*",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# To find out whether a text has any: what can only stand at few characters is tried there alone.
_NUMBER = f"(?=[0-9+(A-Z])(?:{'|'.join(f'(?:{PATTERNS[k]})' for k in ('ip', 'iban', 'card', 'ssn', 'phone'))})"
_NAMED = f"(?=[{''.join(sorted({w[0] for w in (*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES, *CUES)}))}]){PATTERNS['name']}"
_OWNED = r"['’][sS]$"
_NAME_PARTS = rf"^({_BEFORE}) +(.*)$"
# Sounds that names are put together from, by script: beginnings, middles, female and male ends.
_SOUNDS = {
    "latin": ("b c d f g h j k l m n p r s t v w z", "a e i o u", "a ia ina", "o en us"),
    "cyrillic": ("б в г д з к л м н п р с т", "а е и о у", "а ия ина", "ан ор ей"),
    "greek": ("β γ δ κ λ μ ν π ρ σ τ", "α ε ι ο", "α ια ινα", "ος ης ας"),
}
_ROUNDS = 50


def mentions(text: Column) -> Column:
    """Every entity of a whole text, in order, leftmost first."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_ANY), F.lit(0))


def has_mention(text: Column) -> Column:
    """Whether ``mentions`` finds any; most texts have no digit and no @, and are looked through for names only."""
    found = (text.contains("@") & text.rlike(PATTERNS["email"])) | (text.rlike("[0-9]") & text.rlike(_NUMBER)) | text.rlike(_NAMED)
    return F.coalesce(found, F.lit(False))


def kind_of(mention: Column) -> Column:
    out = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(mention.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def parts(mention: Column) -> Column:
    """A mention → array of (kind, norm, raw); kind keep is what stays: a title, a cue, a blank, a particle, a genitive s.

    Equal norms of a kind are one entity: signs between digits, the case of letters, and what comes before the last
    ten digits of a telephone number do not count.
    """
    kind = kind_of(mention)
    piece = lambda k, norm, raw: F.struct(k.alias("kind"), norm.alias("norm"), raw.alias("raw"))
    marks = F.regexp_replace(mention, r"[^A-Za-z0-9]", "")
    plain = F.when(kind.isin("email", "ip"), F.lower(mention)).when((kind == "phone") & (F.length(marks) > 10), F.substring(marks, -10, 10)).otherwise(marks)
    before, rest = F.regexp_extract(mention, _NAME_PARTS, 1), F.regexp_extract(mention, _NAME_PARTS, 2)
    title = F.regexp_replace(before, r"\.$", "")
    gender = F.when(title.isin(*MALE_TITLES), "m").when(title.isin(*FEMALE_TITLES), "f").otherwise("u")
    words = F.split(rest, " +")
    blank = piece(F.lit("keep"), F.lit(""), F.lit(" "))

    def named(w: Column, i: Column) -> Column:
        own, owned = F.regexp_replace(w, _OWNED, ""), F.regexp_extract(w, _OWNED, 0)
        of = F.when(w.isin(*PARTICLES), "keep").when(i == F.size(words) - 1, "surname").otherwise(F.concat(F.lit("given_"), gender))
        return F.array(blank, piece(of, F.when(of == "keep", "").otherwise(F.lower(own)), own), piece(F.lit("keep"), F.lit(""), owned))

    spaced = F.flatten(F.transform(words, named))
    return F.when(kind == "name", F.concat(F.array(piece(F.lit("keep"), F.lit(""), before)), spaced)).otherwise(F.array(piece(kind, plain, mention)))


def _draw(seed: Column, at: Column | int, size: int | Column) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.pmod(F.conv(F.substring(F.sha2(F.concat(seed, F.lit("|"), at.cast("string")), 256), 1, 12), 16, 10).cast("long"), F.lit(size) if isinstance(size, int) else size)


def _pick(seed: Column, at: Column | int, values: str) -> Column:
    found = values.split(" ")
    return F.element_at(F.array(*[F.lit(v) for v in found]), (_draw(seed, at, len(found)) + 1).cast("int"))


def _places(text: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))


def _char(text: Column, i: Column) -> Column:
    return F.substring(text, i, F.lit(1))


def _scrambled(text: Column, seed: Column) -> Column:
    """Letters become letters and digits digits; a leading digit does not become 0; other signs stay."""

    def swap(i: Column) -> Column:
        c = _char(text, i)
        digit = F.when((i == 1) & (c != "0"), _draw(seed, i, 9) + 1).otherwise(_draw(seed, i, 10)).cast("string")
        letter = lambda first: F.char(_draw(seed, i, 26) + ord(first))
        return F.when(c.rlike("[0-9]"), digit).when(c.rlike("[a-z]"), letter("a")).when(c.rlike("[A-Z]"), letter("A")).otherwise(c)

    return F.array_join(F.transform(_places(text), swap), "")


def _luhn(digits: Column) -> Column:
    """Weighted digit sum of a number whose last digit is the check digit."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = _char(digits, i).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(F.pmod(n - i, F.lit(2)) == 1, twice).otherwise(d)

    return F.aggregate(_places(digits), F.lit(0), add)


def _mod97(text: Column) -> Column:
    """Of an IBAN with its first four characters moved behind, letters as numbers from 10 on."""
    moved = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))

    def add(total: Column, i: Column) -> Column:
        c = _char(moved, i)
        return F.pmod(F.when(c.rlike("[0-9]"), total * 10 + c.cast("int")).otherwise(total * 100 + F.ascii(c) - 55), F.lit(97))

    return F.aggregate(_places(moved), F.lit(0), add)


def _sounding(norm: Column, kind: Column, seed: Column, attempt: Column) -> Column:
    def of(script: str) -> Column:
        begin, middle, female, male = _SOUNDS[script]
        many = (F.lit(2) + (F.length(norm) > 6).cast("int") + F.floor(attempt / 4)).cast("int")
        stem = F.array_join(F.transform(F.sequence(F.lit(1), many), lambda i: F.concat(_pick(seed, i * 2, begin), _pick(seed, i * 2 + 1, middle))), "")
        end = F.when(kind == "given_f", _pick(seed, 1, female)).when(kind == "given_m", _pick(seed, 1, male)).otherwise(F.lit(""))
        return F.concat(stem, _pick(seed, 0, begin), end) if script != "greek" else F.concat(stem, _pick(seed, 0, begin), F.when(kind == "surname", F.lit("ης")).otherwise(end))

    return F.when(norm.rlike(r"^\p{IsCyrillic}"), of("cyrillic")).when(norm.rlike(r"^\p{IsGreek}"), of("greek")).otherwise(of("latin"))


def surrogate(kind: Column, norm: Column, attempt: Column, secret: str) -> Column:
    """Keyed replacement of an entity, of the same kind and form; another attempt gives another one."""
    key = lambda text: F.sha2(F.concat(F.lit(secret), F.sha2(F.concat(F.lit(secret + "|"), text), 256)), 256)
    seed = key(F.concat_ws("|", kind, norm, attempt.cast("string")))
    local, host = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    domain, top = F.regexp_extract(host, r"^(.*)\.[^.]*$", 1), F.regexp_extract(host, r"(\.[^.]*)$", 1)
    # where short local parts keep meeting, longer ones are drawn
    longer = _scrambled(F.repeat(F.lit("a"), F.floor(attempt / 4).cast("int")), key(F.concat(F.lit("more|"), seed)))
    email = F.concat(_scrambled(local, seed), longer, F.lit("@"), _scrambled(domain, key(F.concat(F.lit("host|"), host))), top)
    ip = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (_draw(seed, i, 254) + 1).cast("string")), ".")
    number = _scrambled(norm, seed)
    body = F.concat(F.substring(norm, 1, 1), F.substring(number, F.lit(2), F.length(norm) - 2))
    check = F.pmod(10 - F.pmod(_luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    card = F.when(F.pmod(_luhn(norm), F.lit(10)) == 0, F.concat(body, check)).otherwise(number)
    account = F.concat(F.substring(norm, 1, 2), F.substring(number, F.lit(3), F.length(norm)))
    checked = F.concat(F.substring(norm, 1, 2), F.lpad((98 - _mod97(F.concat(F.substring(norm, 1, 2), F.lit("00"), F.substring(account, F.lit(5), F.length(norm))))).cast("string"), 2, "0"), F.substring(account, F.lit(5), F.length(norm)))
    iban = F.when(_mod97(norm) == 1, checked).otherwise(account)
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "iban", iban)
        .when(kind.isin("phone", "ssn"), number).otherwise(_sounding(norm, kind, seed, attempt))
    )


def assigned(entities: DataFrame, secret: str) -> DataFrame:
    """Distinct (kind, norm) → with surrogate: no two entities get the same one, and none gets one that is an entity.

    Where two meet, the first by attempts and norm keeps it and the others try again, until none meet.
    """
    family = _family(F.col("kind"))
    # Drawing takes time, so even few entities are spread over tasks.
    now = entities.repartition(task_count(entities.sparkSession), "kind", "norm").withColumn("attempt", F.lit(0))
    for _ in range(_ROUNDS):
        now = stage(now.withColumn("surrogate", surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), secret)).withColumn("family", family), "surrogates")
        first = F.row_number().over(Window.partitionBy("family", "surrogate").orderBy("attempt", "kind", "norm"))
        real = now.select(F.col("family").alias("f"), F.col("norm").alias("is_real")).distinct()
        judged = now.withColumn("turn", first).join(real, (F.col("family") == F.col("f")) & (F.lower("surrogate") == F.lower("is_real")), "left")
        judged = judged.select("kind", "norm", "attempt", ((F.col("turn") > 1) | F.col("is_real").isNotNull()).alias("meets"))
        if not judged.agg(F.count_if("meets")).first()[0]:
            return now.select("kind", "norm", "surrogate")
        now = judged.select("kind", "norm", (F.col("attempt") + F.col("meets").cast("int")).alias("attempt"))
    raise ValueError("surrogates still meet; too many entities of one form")


def _in_form(raw: Column, norm: Column, made: Column) -> Column:
    """The surrogate with the mention's signs between digits and what stood before its norm, and its capitals."""
    before = F.length(F.regexp_replace(raw, r"[^A-Za-z0-9]", "")) - F.length(norm)
    start = F.struct(F.lit("").alias("out"), (F.lit(1) - before).alias("next"))

    def put(state: Column, i: Column) -> Column:
        c = _char(raw, i)
        takes = c.rlike("[A-Za-z0-9]")
        return F.struct(F.concat(state["out"], F.when(takes & (state["next"] > 0), _char(made, state["next"])).otherwise(c)).alias("out"), (state["next"] + takes.cast("int")).alias("next"))

    spread = F.aggregate(_places(raw), start, put, lambda s: s["out"])
    letters = F.lower(raw) != F.upper(raw)
    cased = F.when(letters & (raw == F.upper(raw)) & (F.length(raw) > 1), F.upper(made)).when(letters & (F.substring(raw, 1, 1) == F.upper(F.substring(raw, 1, 1))), F.concat(F.upper(F.substring(made, 1, 1)), F.substring(made, F.lit(2), F.length(made)))).otherwise(made)
    return F.when(F.length(raw) == F.length(norm), cased).otherwise(spread)


def _bare(gap: Column, known: Column) -> Column:
    """``gap`` with each capitalised word that is one of ``known`` (norm → surrogate) replaced."""

    def put(word: Column) -> Column:
        own, owned = F.regexp_replace(word, _OWNED, ""), F.regexp_extract(word, _OWNED, 0)
        made = known[F.lower(own)]
        takes = made.isNotNull() & (F.substring(own, 1, 1) != F.lower(F.substring(own, 1, 1)))
        return F.when(takes, F.concat(_in_form(own, F.lower(own), made), owned)).otherwise(word)

    said = F.transform(F.regexp_extract_all(gap, F.lit(rf"(?<![\p{{L}}\p{{N}}_]){_WORD}"), F.lit(0)), put)
    between = F.split(gap, rf"(?<![\p{{L}}\p{{N}}_]){_WORD}", -1)
    whole = F.array_join(F.zip_with(between, said, lambda b, s: F.concat(b, F.coalesce(s, F.lit("")))), "")
    return F.when(F.size(known) > 0, whole).otherwise(gap)


def _family(kind: Column) -> Column:
    """Entities of a family are told apart by their norm alone: a given name and a surname that are one word are one."""
    return F.when(kind.rlike("^(given_|surname)"), "name").otherwise(kind)


def entities(told: DataFrame) -> DataFrame:
    """Mentioned parts → distinct (kind, norm). A name is one entity whatever stands before it: given where it is that
    anywhere, with the gender that more titles tell, f where as many tell either, u where none does; else a surname."""
    kind = F.col("kind")
    votes = told.where("kind <> 'keep'").groupBy(_family(kind).alias("family"), "norm")
    votes = votes.agg(*[F.count_if(kind == f"given_{g}").alias(g) for g in "mfu"])
    gender = F.when((F.col("m") == 0) & (F.col("f") == 0), "u").when(F.col("m") > F.col("f"), "m").otherwise("f")
    given = F.when(F.col("m") + F.col("f") + F.col("u") > 0, F.concat(F.lit("given_"), gender)).otherwise("surname")
    return votes.select(F.when(F.col("family") == "name", given).otherwise(F.col("family")).alias("kind"), "norm")


def with_surrogates(docs: DataFrame, secret: str, text: str = "text") -> DataFrame:
    """(doc, kinds): each row as a struct, with entities in ``text`` replaced, and the kinds of these in order.

    An entity has the same surrogate wherever it is mentioned, and another one than any other entity: surrogates are
    drawn by a hash with ``secret``, checked against each other and against all entities, and drawn again where they
    meet. A given name or surname that a row has after a title or cue is replaced wherever else it stands capitalised in
    that row; ``kinds`` does not list these again. Replacements keep the form (signs between digits, valid check digits, capitals), names also script and
    gender as its titles tell it; a name under several titles is one entity. Only rows with an entity are shuffled, and only distinct entities are compared.

    A null text stays null and an empty one empty; rows without an entity stay as they are; repeated rows are treated
    alike; an empty table stays empty; other columns of any name are carried along in the struct.
    """
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[text].alias("body"))
    has = has_mention(F.col("body"))
    none = held.where(~has).select("doc", F.array().cast("array<string>").alias("kinds"))
    found = held.where(has).select("doc", "body", F.transform(mentions(F.col("body")), lambda m: F.struct(kind_of(m).alias("kind"), parts(m).alias("parts"))).alias("found"))
    found = stage(found.withColumn("row", F.monotonically_increasing_id()), "found")
    told = found.select("row", F.posexplode("found").alias("at", "m")).select("row", "at", F.posexplode("m.parts").alias("part", "p")).select("row", "at", "part", "p.*")
    names = assigned(entities(told), secret).withColumn("family", _family(F.col("kind"))).drop("kind")
    said = told.withColumn("family", _family(F.col("kind"))).join(names, ["family", "norm"], "left")
    said = said.select("row", "at", "part", "kind", "norm", "surrogate", F.when(F.col("surrogate").isNull(), F.col("raw")).otherwise(_in_form(F.col("raw"), F.col("norm"), F.col("surrogate"))).alias("new"))
    whole = said.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("at", "part", "new"))).alias("news"),
        F.array_sort(F.collect_set(F.when(F.col("kind").rlike("^(given_|surname)"), F.struct("norm", "kind", "surrogate")))).alias("people"),
    )
    # a word may be there as a given name and a surname, with one surrogate
    known = F.map_from_entries(F.filter(F.transform("people", lambda p: F.struct(p["norm"], p["surrogate"])), lambda p, i: ~F.coalesce(F.get("people", i + 1)["norm"] == p["norm"], F.lit(False))))
    whole = whole.select("row", "news", known.alias("known"))
    # the text between the mentions, each followed by the parts of the next one
    gaps = F.transform(F.split("body", _ANY, -1), lambda g: _bare(g, F.col("known")))
    by_mention = F.transform(F.sequence(F.lit(0), F.size("found") - 1), lambda i: F.array_join(F.transform(F.filter("news", lambda n: n["at"] == i), lambda n: n["new"]), ""))
    body = F.array_join(F.zip_with(gaps, by_mention, lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
    out = found.join(whole, "row").select(F.col("doc").withField(f"`{text}`", body).alias("doc"), F.col("found.kind").alias("kinds"))
    return out.unionByName(none)
