"""Personal data replaced by keyed surrogates of the same type and format. Column functions only.

Every surrogate is a keyed permutation of its own format class: letters stay letters of the same script and case (vowels
stay vowels), digits digits, punctuation stays; a four-round Feistel network over the two halves of an entity shifts each
character within its alphabet. A permutation maps equal entities to equal surrogates (coreference, in
every document, without a lookup table) and different ones to different ones (distinctness), at any scale.
``collisions`` checks that on the whole table.

Types: e-mail (local part; the domain too, but for reserved example domains), IPv4 (as 32 bits, so it stays
valid), card (issuer digit kept, check digit valid exactly if it was), phone (country code and a fictional ``555``
exchange kept; also with a leading 1 or a trunk zero), IBAN (country kept), US social security number, secrets (long hex strings, values of key, token, secret or password
assignments), persons after a form of address: up to four names with particles and initials, and wherever else the same text
has that whole name or its family name alone. The form of address stays, and of each name its last letter, which is what marks
gender in given names; a name gets the same surrogate with and without a form, alone or in a longer name. Persons that no
form of address introduces anywhere in their text are not found.
Spellings of one phone or card number that differ in separators, and e-mail addresses that differ in case, keep that
difference and nothing else.

The key comes from the setting ``spark.emberline.pii.key``. Where that is not set a run draws one at random: surrogates then
agree within the run, and nobody can undo them.

Edge cases: a NULL text stays NULL, an empty one empty; entities that overlap count once, the leftmost first, of those
the type named first in ``TYPES``; rows with equal ids are replaced each by its own text; other columns are untouched.
"""

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import carried, quoted, taken_back
from emberline.operators.lineage import settle

KEY_SETTING = "spark.emberline.pii.key"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_FEMALE = "Mrs|Ms|Miss|Frau|Mme|Madame|Sra|Señora"
_MALE = "Mr|Herr|Monsieur|Sr|Señor|M"
_NAME = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}+(?:-?\p{Lu}\p{Ll}+)?"
_PART = rf"(?:{_NAME}|\p{{Lu}}\.(?= \p{{Lu}}\p{{L}}))"
_PARTICLE = "von|van|vom|zu|de|del|della|der|den|di|da|du|la|le|y"
#: What stays in front of a secret or a name.
_ASSIGNED = r"(?i:token|secret|password|passwd|api_key|apikey|access_key)\s{0,2}[=:]\s{0,2}[\"']?"
_TITLE = rf"(?=[FMHSDP])(?<![\p{{L}}])(?:{_FEMALE}|{_MALE}|Dr|Prof)\.? "
#: A number with its trunk zero: area, then three digits or more, 8 digits at least, no card; or five pairs. Dates fit neither.
_NATIONAL = (
    r"(?:\(0|0)(?<![\d./-]\(?0)(?!\d{3}[ -]\d{4}[ -]\d{4}[ -]\d)[1-9](?=(?:[ /)-]{0,2}\d){6})\d{0,3}(?:\) ?|[ /-])"
    r"(?:\d{6,8}(?:-\d{1,4})?|\d{3,5}(?:[ -]\d{2,5}){0,3})(?!\d)|0(?<![\d./-].)[1-9](?:[ .-]\d{2}){4}(?!\d)"
)
#: Type and pattern, in order of precedence.
TYPES = {
    "email": r"[\p{L}\p{N}](?<![\p{L}\p{N}].)[\p{L}\p{N}._%+-]{0,255}@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}])",
    "secret": rf"[0-9a-fA-F](?<![0-9A-Za-z].)[0-9a-fA-F]{{31,127}}(?![0-9A-Za-z])|{_ASSIGNED}[0-9A-Za-z_/+.=-]{{8,128}}",
    "ip": rf"(?=\d)(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "iban": r"[A-Z](?<![0-9A-Za-z].)[A-Z]\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "phone": r"\+(?<![\d+].)\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)"
    r"|\((?<!\d.)\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|\d(?<![\d.-].)\d{2}[.-]\d{3}[.-]\d{4}(?![\d-])"
    rf"|[2-9](?<![\d.-].)\d{{2}} [2-9]\d{{2}} \d{{4}}(?![\d-])|1(?<![\d.-].)[ .-]\(?[2-9]\d{{2}}\)?[ .-]?\d{{3}}[ .-]?\d{{4}}(?![\d-])|{_NATIONAL}",
    "ssn": r"\d(?<![\d-].)\d{2}-\d{2}-\d{4}(?![\d-])",
    "card": r"\d(?<!\d.)(?:\d{12,18}|\d{3}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{3}[ -]\d{6}[ -]\d{5})(?!\d)",
    "person": rf"{_TITLE}(?:(?:{_PARTICLE}) ){{0,3}}{_PART}(?:(?: (?:{_PARTICLE})){{0,3}} {_PART}){{0,3}}",
}
ANY = "|".join(f"(?:{p})" for p in TYPES.values())
#: Some pattern needs one of these; texts without are passed through.
HINTS = ("[0-9]", "@", "(?=[TtSsPpAa])" + _ASSIGNED, _TITLE + r"\p{L}", "[a-fA-F]{32}")

#: The alphabets within which characters are shifted.
ALPHABETS = (
    "0123456789",
    "bcdfghjklmnpqrstvwxyz",
    "aeiou",
    "BCDFGHJKLMNPQRSTVWXYZ",
    "AEIOU",
    "àáâäãåæèéêëìíîïòóôöõøœùúûü",
    "ÀÁÂÄÃÅÆÈÉÊËÌÍÎÏÒÓÔÖÕØŒÙÚÛÜ",
    "çñšžßćčđłńřśťźż",
    "ÇÑŠŽẞĆČĐŁŃŘŚŤŹŻ",
    "бвгджзйклмнпрстфхцчшщъьѕ",
    "аеёиоуыэюяіїє",
    "БВГДЖЗЙКЛМНПРСТФХЦЧШЩЪЬЅ",
    "АЕЁИОУЫЭЮЯІЇЄ",
    "βγδζθκλμνξπρσςτφχψ",
    "αεηιουωάέήίόύώ",
    "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
    "ΑΕΗΙΟΥΩΆΈΉΊΌΎΏ",
)
HEX = ("0123456789abcdef", "0123456789ABCDEF")


def configured_key(spark: SparkSession) -> str:
    """The key that the session names, else a random one."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _random(*seed: Column) -> Column:
    """A keyed whole number below 2^52."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *seed), 256), 1, 13), 16, 10).cast("long")


def _tables(alphabets: tuple[str, ...]) -> Column:
    """Alphabets as one string, and for each of its characters, as code points, where its alphabet starts and how long it is."""
    whole = "".join(alphabets)
    starts = "".join(chr(1 + whole.index(a)) * len(a) for a in alphabets)
    lengths = "".join(chr(len(a)) * len(a) for a in alphabets)
    return F.struct(F.lit(whole).alias("whole"), F.lit(starts).alias("starts"), F.lit(lengths).alias("lengths"))


def _shift(c: Column, by: Column, table: Column) -> Column:
    """``c`` moved within its alphabet; other characters stay."""
    code = lambda column, at: F.ascii(F.substring(column, at, F.lit(1)))
    at = F.when(c == "", 0).otherwise(F.instr(table["whole"], c))

    def moved(p: Column) -> Column:
        start = code(table["starts"], p)
        return F.substring(table["whole"], start + F.pmod(p - start + by, code(table["lengths"], p)).cast("int"), F.lit(1))

    return _let(at, lambda p: F.when(p > 0, moved(p)).otherwise(c))


def permuted(value: Column, tweak: Column, table: Column, key: str) -> Column:
    """A keyed permutation of the strings with the format of ``value``; another one for each ``tweak``.

    Each turn moves one half by keyed numbers of the other half (its case aside) and the place, then swaps the two.
    """
    half = F.floor(F.length(value) / 2).cast("int")
    halves = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r"))

    def turn(s: Column, t: Column) -> Column:
        seed = F.concat_ws("|", F.lit(key), t.cast("string"), tweak, F.lower(s["r"]))
        moved = F.transform(F.split(s["l"], ""), lambda c, i: _shift(c, _random(seed, i.cast("string")), table))
        return F.struct(s["r"].alias("l"), F.array_join(moved, "").alias("r"))

    return F.aggregate(F.array(*map(F.lit, range(4))), halves, turn, lambda s: F.concat(s["l"], s["r"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _filled(form: Column, digits: Column) -> Column:
    """The digits of ``form`` replaced, in order, by ``digits``."""

    def one(c: Column, i: Column) -> Column:
        before = F.length(_digits(F.substring(form, F.lit(1), i + 1)))
        return F.when(c.rlike("[0-9]"), F.substring(digits, before, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(form, ""), one), "")


def _part(value: Column, tweak: Column | str = "") -> Column:
    return F.struct(value.alias("value"), (F.lit(tweak) if isinstance(tweak, str) else tweak).alias("tweak"))


#: For each type what is permuted, and how the permuted parts ``p`` make the surrogate of ``e``.
def _email(e: Column) -> tuple[Column, Callable[[Column], Column]]:
    local, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    name, top = F.regexp_extract(domain, r"^(.*)(\.[^.]*)$", 1), F.regexp_extract(domain, r"^(.*)(\.[^.]*)$", 2)
    reserved = F.lower(domain).rlike(r"(^|\.)example(\.(com|org|net))?$")
    parts = F.array(_part(local, F.lower(domain)), _part(name, F.lower(top)))
    return parts, lambda p: F.concat(p[0], F.lit("@"), F.when(reserved, domain).otherwise(F.concat(p[1], top)))


def _phone(e: Column) -> tuple[Column, Callable[[Column], Column]]:
    """The exchange of a ten-digit number is permuted apart, by a permutation that leaves ``555`` where it is."""
    country = F.regexp_extract(e, r"^(\+1(?=\D?\(?\d{3})|\+\d{1,3}(?=[^0-9])|\+\d\d|1(?=[ .-]\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}$))?", 1)
    rest = F.substring(e, F.length(country) + 1, F.length(e))
    d = _digits(rest)
    three = F.length(d) == 10
    exchange = F.substring(d, 4, 3)
    free = F.when(three, F.concat(F.substring(d, 1, 3), F.substring(d, 7, 4))).otherwise(d)
    parts = F.array(_part(free, F.concat(country, F.when(three, exchange).otherwise(""))), _part(exchange, "exchange"), _part(F.lit("555"), "exchange"))

    def whole(p: Column) -> Column:
        new = F.when(exchange == "555", exchange).when(p[1] == "555", p[2]).otherwise(p[1])
        ten = F.concat(F.substring(p[0], 1, 3), new, F.substring(p[0], 4, 4))
        return F.concat(country, _filled(rest, F.when(three, ten).otherwise(p[0])))

    return parts, whole


def _luhn(digits: Column) -> Column:
    """Sum of a number whose check digit would follow."""
    n = F.length(digits)
    one = lambda c, i: _let(c.cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1), lambda v: v - F.when(v > 9, 9).otherwise(0))
    return F.aggregate(F.transform(F.split(digits, ""), one), F.lit(0), lambda a, b: a + b)


def _card(e: Column) -> tuple[Column, Callable[[Column], Column]]:
    d = _digits(e)
    body, first = F.substring(d, F.lit(1), F.length(d) - 1), F.substring(d, 1, 1)
    off = F.pmod(F.substring(d, -1, 1).cast("int") + _luhn(body), F.lit(10))  # 0 for a valid number
    check = lambda b: F.concat(b, F.pmod(off - _luhn(b), F.lit(10)).cast("string"))
    return F.array(_part(F.substring(d, F.lit(2), F.length(d) - 2), first)), lambda p: _filled(e, _let(F.concat(first, p[0]), check))


def _person(e: Column) -> tuple[Column, Callable[[Column], Column]]:
    """Every name by itself, but for its last letter; particles stay."""
    names = lambda: F.regexp_extract_all(e, F.lit(r"\p{L}+"), F.lit(0))
    body = lambda w: F.when(w.rlike(r"^\p{Lu}"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise("")
    parts = F.transform(names(), lambda w: _part(body(w), F.concat(F.lit("name"), F.lower(F.substring(w, -1, 1)))))

    def whole(p: Column) -> Column:
        done = F.zip_with(p, names(), lambda new, w: F.concat(new, F.substring(w, F.length(new) + 1, F.length(w))))
        return F.array_join(F.zip_with(F.split(e, r"\p{L}+", -1), done, lambda gap, w: F.concat(gap, F.coalesce(w, F.lit("")))), "")

    return parts, whole


def _ip(e: Column, key: str) -> Column:
    """The four octets as two 16-bit halves."""
    o = F.transform(F.split(e, r"\."), lambda x: x.cast("long"))
    halves = F.struct((o[0] * 256 + o[1]).alias("l"), (o[2] * 256 + o[3]).alias("r"))

    def turn(s: Column, t: Column) -> Column:
        moved = F.pmod(s["l"] + _random(F.lit(f"{key}|ip"), t.cast("string"), s["r"].cast("string")), F.lit(65536))
        return F.struct(s["r"].alias("l"), moved.alias("r"))

    text = lambda x: [F.floor(x / 256).cast("string"), (x % 256).cast("string")]
    return F.aggregate(F.array(*map(F.lit, range(4))), halves, turn, lambda s: F.concat_ws(".", *text(s["l"]), *text(s["r"])))


def front_of(match: Column) -> Column:
    """The part of a match that stays: form of address, or what a secret is assigned to."""
    return F.regexp_extract(match, rf"^(?:{_ASSIGNED}|{_TITLE})", 0)


def type_of(e: Column, front: Column) -> Column:
    """Type of a found entity; what nothing else matches is a secret."""
    out = F.when(front.rlike("[=:]"), "secret").when(front != "", "person")
    for name in ("email", "ip", "iban", "phone", "ssn", "card"):
        out = out.when(e.rlike(f"^(?:{TYPES[name]})$"), name)
    return out.otherwise("secret")


def surrogate(e: Column, kind: Column, key: str) -> Column:
    ways = {
        "email": _email(e),
        "phone": _phone(e),
        "card": _card(e),
        "person": _person(e),
        "iban": (F.array(_part(F.substring(e, F.lit(3), F.length(e)), F.substring(e, 1, 2))), lambda p: F.concat(F.substring(e, 1, 2), p[0])),
        "ssn": (F.array(_part(_digits(e), "ssn")), lambda p: _filled(e, p[0])),
    }
    table = F.when((kind == "secret") & e.rlike("^[0-9a-f]{32,}$"), _tables(HEX[:1]))
    table = table.when((kind == "secret") & e.rlike("^[0-9A-F]{32,}$"), _tables(HEX[1:])).otherwise(_tables(ALPHABETS))
    parts = F
    for name, (own, _) in ways.items():
        parts = parts.when(kind == name, own)
    parts = parts.otherwise(F.array(_part(e, "secret")))

    def assembled(p: Column) -> Column:
        out = F.when(kind == "ip", _ip(e, key))
        for name, (_, make) in ways.items():
            out = out.when(kind == name, make(p))
        return out.otherwise(p[0])

    done = _let(table, lambda t: F.transform(parts, lambda x: permuted(x["value"], x["tweak"], t, key)))
    return _let(done, assembled)


def _names(typed: Column) -> Column:
    """A pattern of the persons of a text, whole and by family name, the longest first; NULL without any."""
    persons = F.transform(F.filter(typed, lambda x: x["kind"] == "person"), lambda x: x["entity"])
    family = F.transform(persons, lambda e: F.regexp_extract(e, r"(\S+)$", 1))
    every = F.array_distinct(F.concat(persons, family))
    sized = F.sort_array(F.transform(every, lambda e: F.struct(F.length(e).alias("n"), e.alias("e"))), asc=False)
    either = F.array_join(F.transform(sized, lambda x: F.replace(x["e"], F.lit("."), F.lit(r"\."))), "|")
    return F.when(F.size(persons) > 0, F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), either, F.lit(r")(?![\p{L}\p{N}])")))


def detect(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with ``_gaps``, the text around the entities, and ``_entities`` (front, entity, kind, surrogate).

    A text without any has no gaps and no entities, NULL or empty.
    """
    t = F.col(text)
    hinted = F.lit(False)
    for hint in HINTS:
        hinted = hinted | (t.contains(hint) if hint == "@" else t.rlike(hint))
    split = docs.withColumn("_found", F.when(hinted, F.regexp_extract_all(t, F.lit(ANY), F.lit(0))))
    split = split.withColumn("_around", F.when(F.size("_found") > 0, F.split(t, ANY, -1)))
    parted = F.transform("_found", lambda m: _let(front_of(m), lambda f: F.struct(f.alias("front"), F.substring(m, F.length(f) + 1, F.length(m)).alias("entity"))))
    typed = F.transform("_parted", lambda x: F.struct(x["front"], x["entity"], type_of(x["entity"], x["front"]).alias("kind")))
    some, named = F.size("_found") > 0, F.col("_names").isNotNull()
    split = split.withColumn("_parted", F.when(some, parted)).withColumn("_typed", F.when(some, typed))
    split = split.withColumn("_names", F.when(some, _names(F.col("_typed"))))
    # The text between the entities is cut again at the names that forms of address have introduced.
    mention = lambda m: F.struct(F.lit("").alias("front"), m.alias("entity"), F.lit("person").alias("kind"))
    again = lambda gap: F.transform(F.regexp_extract_all(gap, F.col("_names"), F.lit(0)), mention)
    mentions = F.flatten(F.zip_with("_around", F.transform("_typed", lambda x: F.array(x)), lambda gap, e: F.concat(again(gap), F.coalesce(e, F.array()))))
    split = split.withColumn("_gaps", F.when(named, F.flatten(F.transform("_around", lambda gap: F.split(gap, F.col("_names"), -1)))).otherwise(F.col("_around")))
    split = split.withColumn("_typed", F.when(named, mentions).otherwise(F.col("_typed")))
    done = F.transform(
        "_typed", lambda x: F.struct(x["front"], x["entity"], x["kind"], surrogate(x["entity"], x["kind"], key).alias("surrogate"))
    )
    return split.withColumn("_entities", F.when(some, done)).drop("_found", "_around", "_parted", "_typed", "_names")


def replaced(gaps: Column, entities: Column) -> Column:
    whole = lambda e: F.concat(F.coalesce(e["front"], F.lit("")), F.coalesce(e["surrogate"], F.lit("")))
    return F.array_join(F.zip_with(gaps, entities, lambda gap, e: F.concat(gap, whole(e))), "")


def pseudonymise(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", key: str | None = None) -> DataFrame:
    """``docs`` with the entities of ``text`` replaced; ``n_chars`` follows the text if there is such a column."""
    key = key or configured_key(docs.sparkSession)
    found = detect(docs.select(carried(docs, text), quoted(text).alias("_text")), key, "_text")
    some = F.col("_entities").isNotNull()
    new = found.withColumn("_new", F.when(some, replaced(F.col("_gaps"), F.col("_entities"))).otherwise(F.col("_text")))
    back = taken_back(docs, text) | {text: F.col("_new")}
    own = {c: back[c] for c in docs.columns}
    if n_chars in docs.columns:
        own[n_chars] = F.when(some, F.length("_new").cast(docs.schema[n_chars].dataType)).otherwise(own[n_chars])
    return new.select(*(v.alias(k) for k, v in own.items()))


def entities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key: str | None = None) -> DataFrame:
    """``doc_id, kind, entity, surrogate``: one row per occurrence."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    found = detect(narrow, key or configured_key(docs.sparkSession), "_text").select("doc_id", F.inline_outer("_entities"))  # outer: no filter sinks into the search
    return found.where("entity IS NOT NULL").select("doc_id", "kind", "entity", "surrogate")


def collisions(found: DataFrame) -> DataFrame:
    """Surrogates of ``entities`` that stand for two entities, and entities with two surrogates; none is expected.

    Distinct pairs are formed before anything is dealt by surrogate, so a common entity is one row.
    """
    pairs = found.select("kind", F.lower("entity").alias("entity"), F.lower("surrogate").alias("surrogate")).distinct()
    pairs = settle(pairs, "surrogates")
    clash = pairs.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    split = pairs.groupBy("kind", F.col("entity").alias("surrogate")).agg(F.count(F.lit(1)).alias("n"))
    return clash.union(split.where("n > 1"))


def checked(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", key: str | None = None) -> DataFrame:
    """``pseudonymise`` after a look at all entities: a key under which two of them would meet is refused."""
    key = key or configured_key(docs.sparkSession)
    narrow = docs.select(F.lit(None).cast("long").alias("doc_id"), quoted(text).alias("_text"))
    clashes = collisions(entities(narrow, "doc_id", "_text", key)).take(3)
    if clashes:
        raise ValueError(f"surrogates collide under this key, take another: {[c['surrogate'] for c in clashes]}")
    return pseudonymise(docs, text, n_chars, key)
