"""PII surrogates: every detected entity is replaced by a keyed one of its kind; DataFrame and SQL functions only.

Kinds: e-mail address, phone number, payment card, social security number, IBAN, IPv4 and IPv6 address, secret (a value after a
word such as token or password, a key of a well-known form, or a long hexadecimal string), and names of people after a title or
"name:" / "my name is". A name so found is replaced wherever its words stand capitalised in the same document. Names that no
title ever introduces are not detected; that takes a model or a list.

An entity's canonical form (case, spacing and punctuation removed) and the key fix its surrogate, so all mentions of an
entity, in any document and written form, get the same one; each mention keeps its own case, spacing and punctuation. Digits
become digits and letters letters of the same script; cards that pass the Luhn test and IBANs still pass theirs; an e-mail
domain maps to one domain wherever it occurs; a person's given and family names map each on their own, the given name to one
of the same gender and both to the same script. Surrogates are made once per distinct entity, domains among them. Checks over
all entities give a new try to any surrogate that another entity of the kind already has or that is itself an entity of the
corpus, until none is left, so distinct entities stay distinct and no surrogate points at somebody else. After a few tries a
surrogate grows, so a kind whose forms run out (six-digit phone numbers, say) gets longer ones and every entity is served.

Texts without entities are passed on where they are. Those with entities meet their replacements by a digest of the text, so
copies of a text share one row of replacements, and a hot copy group is an equi-join that Spark can split.

Defined cases: a null text stays null with 0 entities; repeated rows and null ids are kept; an empty table stays empty; all
other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, stash

# Words before a secret, and how well-known kinds of keys begin.
_SECRET_WORD = r"(?i:token|secret|password|passwd|pwd|passphrase|api[ _-]?key|access[ _-]?key)"
_KEYED = rf"{_SECRET_WORD}(?:[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?|\s{{1,2}}(?i:is|was)\s{{1,2}}[\"']?(?=[^\s]{{0,64}}[0-9]))"
_MARK = r"(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|AIza|eyJ)"
_MARKED = r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,64}|sk-[A-Za-z0-9_-]{20,128}|xox[abprs]-[A-Za-z0-9-]{10,128}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,512}\.[A-Za-z0-9_-]{10,512}\.[A-Za-z0-9_-]{5,512})(?![A-Za-z0-9])"


def _either(*titles: str) -> str:
    """Any of the titles as written or in capitals."""
    return "(?:" + "|".join(dict.fromkeys(t for w in titles for t in (w, w.upper()))) + ")"


_TITLE_M = _either("Mr", "Sir", "Herr", "Señor", "Sr", "Г-н", "г-н", "господин", "Господин", "κ")
_TITLE_F = _either("Mrs", "Ms", "Miss", "Mme", "Mlle", "Madame", "Frau", "Señora", "Sra", "Srta", "Г-жа", "г-жа", "госпожа", "Госпожа", "κα")
_TITLE_X = f"(?:{_either('Dr', 'Prof')}|(?i:my name is|name:))"
_NAME_WORD = r"(?:\p{Lu}['’])?\p{Lu}\p{L}+"
_PERSON = rf"{_NAME_WORD}(?:[ '’-]{_NAME_WORD}){{0,3}}"
_HEX = "[0-9A-Fa-f]{1,4}"
_PATTERNS = {
    "secret": rf"{_KEYED}[A-Za-z0-9_+/.-]{{7,}}[A-Za-z0-9_+/=-]|(?<![A-Za-z0-9])[A-Fa-f0-9]{{32,128}}(?![A-Za-z0-9])|{_MARKED}",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]*@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:.])(?:(?={_HEX}::?{_HEX}:?)(?=[A-Fa-f:]*[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}))(?![\p{{L}}\p{{N}}:])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])|(?=[0-9]{3} ?[0-9]{2} ?[0-9]{4})(?<=(?i:ssn|social security number|social security no)[:#. ]{1,3}(?:is )?)[0-9]{3} ?[0-9]{2} ?[0-9]{4}(?![\p{L}\p{N}-])",
    "card": r"(?<![\p{L}\p{N}+-])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|3[0-9]{3}[ -][0-9]{6}[ -][0-9]{5})(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![\p{L}\p{N}])"
    r"|(?<![\p{L}\p{N}+./,_-])(?:[2-9][0-9]{9}|0[0-9]{1,4}/ ?[0-9]{5,8})(?![\p{L}\p{N}/_-])",
    "name": rf"(?=[MSHFDPmnNГгκΚ])(?<![\p{{L}}\p{{N}}])(?:{_TITLE_M}|{_TITLE_F}|{_TITLE_X})\.? {_PERSON}",
}
ANY = "|".join(_PATTERNS.values())
#: As ANY, and every capitalised word, which may be a name that was introduced elsewhere in the document.
WORDS_TOO = rf"{ANY}|(?<![\p{{L}}\p{{N}}]){_NAME_WORD}(?![\p{{L}}\p{{N}}])"
#: Every text with an entity matches one of these, which cost far less than the full pattern.
QUICK = (r"[@=:]|[0-9]{3}|[0-9]\.", r"[0-9a-fA-F]{32}", rf"(?=[MSHFDPmnNГгκΚ])(?<![\p{{L}}\p{{N}}])(?:{_TITLE_M}|{_TITLE_F}|{_TITLE_X})\.? \p{{Lu}}", rf"{_MARK}|{_SECRET_WORD}\s{{1,2}}(?i:is|was)\s")

#: Tries after which surrogates grow, by a character a try, and rounds without success that are taken for a fault.
GROW, STALLED = 3, 32
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_CYRILLIC = "абвгдежзийклмнопрстуфхцчшщыэюя"
_GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
#: Syllables and endings of made-up names, by script: consonants, vowels, endings of male, female and family names.
_NAMES = {
    "latin": ("b d f g h j k l m n p r s t v z".split(), "a e i o u".split(), "n r s m".split(), ["a", "ia"], ["er", "sen", "et", "old"]),
    "cyrillic": ("б в г д ж з к л м н п р с т ф х".split(), "а е и о у".split(), "н р й м".split(), ["а", "ия"], ["ов", "енко", "ский", "ин"]),
    "greek": ("β γ δ θ κ λ μ ν π ρ σ τ φ χ".split(), "α ε ι ο η".split(), ["ος", "ης", "ας"], ["α", "η"], ["ίδης", "άκης", "ου"]),
}


def _full(kind: str) -> str:
    return f"^(?:{_PATTERNS[kind]})$"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _prefix(m: Column) -> Column:
    """What stands before the entity itself within a match: the word before a secret, how a known key begins, the title before a name."""
    title = rf"(?:{_TITLE_M}|{_TITLE_F}|{_TITLE_X})\.? "
    secret = F.regexp_extract(m, f"^((?:{_KEYED})?(?:{_MARK}(?=[A-Za-z0-9]))?)", 1)
    return F.when(m.rlike(f"^(?:{_KEYED}|{_MARK}[A-Za-z0-9_-]{{10}})") & ~m.rlike("@"), secret).when(m.rlike(f"^{title}"), F.regexp_extract(m, f"^({title})", 1)).otherwise("")


def _kind(m: Column) -> Column:
    out = F.when(m.rlike(f"^{_KEYED}"), "secret").when(m.rlike(rf"^{_NAME_WORD}$") & ~m.rlike(f"^(?:{_MARKED})$"), "word")
    out = out.when(m.rlike("^[0-9]{3}[- ]?[0-9]{2}[- ]?[0-9]{4}$"), "ssn")  # without what stands before it
    for kind in _PATTERNS:
        out = out.when(m.rlike(_full(kind)), kind)
    return out


def _gender(m: Column) -> Column:
    return F.when(m.rlike(rf"^{_TITLE_F}\.? "), "f").when(m.rlike(rf"^{_TITLE_M}\.? "), "m")


def _canon(kind: Column, body: Column) -> Column:
    number = F.when(kind == "phone", F.substring(_digits(body), -10, 10)).when(kind.isin("card", "ssn"), _digits(body))
    return F.coalesce(number, F.when(kind == "iban", F.regexp_replace(body, " ", "")).otherwise(F.lower(body)))


_TOKEN = r"(?:\p{Lu}['’])?\p{L}+"


def _name_key(word: Column) -> Column:
    return F.lower(F.translate(word, "’", "'"))


def _parts(m: Column) -> Column:
    """The entities of one match: array of (kind, canon, gender). A name has one for each of its words, an address one for its domain too."""
    kind, body = _kind(m), F.substr(m, F.length(_prefix(m)) + 1)
    words = F.regexp_extract_all(body, F.lit(_TOKEN), F.lit(0))
    named = F.transform(words, lambda w, i: F.struct(_role(words, i).alias("kind"), _name_key(w).alias("canon"), F.when(_role(words, i) == "given", _gender(m)).alias("gender")))
    one = lambda k, c: F.struct(k.alias("kind"), c.alias("canon"), F.lit(None).cast("string").alias("gender"))
    plain = F.array(one(kind, _canon(kind, body)))
    address = F.array(one(kind, _canon(kind, body)), one(F.lit("domain"), F.substring_index(F.lower(body), "@", -1)))
    return F.when(kind == "name", named).when(kind == "email", address).otherwise(plain)


def _role(words: Column, i: Column) -> Column:
    return F.when((F.size(words) > 1) & (i == 0), "given").otherwise("family")


def _chars(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substr(s, i, F.lit(1)))


def _byte(h: Column, i: Column) -> Column:
    """The i-th byte, from 0, of a hexadecimal digest of 256 characters."""
    return F.conv(F.substr(h, F.pmod(i, F.lit(128)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(choices: str | list[str], v: Column) -> Column:
    if isinstance(choices, str):
        return F.substr(F.lit(choices), F.pmod(v, F.lit(len(choices))) + 1, F.lit(1))
    return F.element_at(F.array(*map(F.lit, choices)), F.pmod(v, F.lit(len(choices))) + 1)


def _digest(*parts: Column) -> Column:
    return F.concat(*(F.sha2(F.concat_ws("|", F.lit(str(k)), *parts), 256) for k in range(4)))


def _like(s: Column, h: Column, hexadecimal: Column | None = None) -> Column:
    """s with each letter and digit replaced by one of the same script, from the digest."""
    letters = F.lit(_LOWER) if hexadecimal is None else F.when(hexadecimal, "abcdef").otherwise(_LOWER)

    def one(c: Column, i: Column) -> Column:
        v = _byte(h, i)
        out = F.when(c.rlike("[0-9]"), F.pmod(v, F.lit(10)).cast("string"))
        out = out.when(c.rlike(r"\p{IsCyrillic}"), _pick(_CYRILLIC, v)).when(c.rlike(r"\p{IsGreek}"), _pick(_GREEK, v))
        return out.when(c.rlike(r"\p{L}"), F.substr(letters, F.pmod(v, F.length(letters)) + 1, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(_chars(s), one), "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum; doubled: 0 if the last digit itself is doubled, 1 if the one before it is."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(F.pmod(n - i, F.lit(2)) == doubled, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _card(canon: Column, h: Column) -> Column:
    """A number with the same first digit; a valid one stays valid."""
    body = F.concat(F.substr(canon, F.lit(1), F.lit(1)), _like(F.substr(canon, F.lit(2), F.length(canon) - 2), h))
    check = F.pmod(10 - F.pmod(_luhn_sum(body, 0), F.lit(10)), F.lit(10)).cast("string")
    last = F.when(F.pmod(_luhn_sum(canon, 1), F.lit(10)) == 0, check).otherwise(F.pmod(_byte(h, F.lit(99)), F.lit(10)).cast("string"))
    return F.concat(body, last)


def _iban(canon: Column, h: Column) -> Column:
    """The same country; fresh account characters and the check digits that belong to them."""
    country, account = F.substr(canon, F.lit(1), F.lit(2)), F.upper(_like(F.lower(F.substr(canon, F.lit(5))), h))

    def add(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), F.pmod(acc * 10 + c.cast("int"), F.lit(97))).otherwise(F.pmod(acc * 100 + F.ascii(c) - 55, F.lit(97)))

    rest = F.aggregate(_chars(F.concat(account, country, F.lit("00"))), F.lit(0), add)
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), account)


def _syllable(consonants: list[str], vowels: list[str], h: Column) -> Callable[[Column], Column]:
    return lambda i: F.concat(_pick(consonants, _byte(h, i * 2)), _pick(vowels, _byte(h, i * 2 + 1)))


def _name(kind: Column, script: Column, gender: Column, h: Column, tries: Column) -> Column:
    """A made-up lower-case name of the script: two or more syllables and an ending of the gender or of a family name."""
    out = None
    for name, (consonants, vowels, male, female, family) in _NAMES.items():
        length = F.lit(2) + F.least(tries, F.lit(4)) + F.pmod(_byte(h, F.lit(90)), F.lit(2))
        stem = F.array_join(F.transform(F.sequence(F.lit(1), length), _syllable(consonants, vowels, h)), "")
        v = _byte(h, F.lit(100))
        either = F.when(F.pmod(_byte(h, F.lit(101)), F.lit(2)) == 0, "m").otherwise("f")
        end = F.when(kind == "family", F.concat(_pick(consonants, v), _pick(family, _byte(h, F.lit(102))))).when(F.coalesce(gender, either) == "f", F.concat(_pick(consonants, v), _pick(female, _byte(h, F.lit(102))))).otherwise(_pick(male, v))
        made = F.concat(stem, end)
        out = made if out is None else F.when(script == name, made).otherwise(out)
    initial = F.when(F.col("canon").rlike("^.'"), F.concat(_like(F.substr(F.col("canon"), F.lit(1), F.lit(1)), h), F.lit("'"))).otherwise("")  # O'Brien
    return F.concat(initial, out)


def _grown(h: Column, tries: Column, alphabet: str) -> Column:
    """What a surrogate has beyond its usual form: nothing for the first tries, then a character more for each."""
    more = F.least(tries - GROW, F.lit(24))
    return F.when(tries > GROW, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda i: _pick(alphabet, _byte(h, i + 60))), "")).otherwise("")


def _surrogate(key: str) -> Column:
    """The surrogate of a row (kind, canon, gender, tries, h), h being the keyed digest. An address keeps its domain, which has one of its own."""
    kind, canon, tries, h = F.col("kind"), F.col("canon"), F.col("tries"), F.col("h")
    digits, letters = _grown(h, tries, "0123456789"), _grown(h, tries, _LOWER)
    email = F.concat(_like(F.substring_index(canon, "@", 1), h), digits, F.lit("@"), F.substring_index(canon, "@", -1))
    top = F.substring_index(canon, ".", -1)
    domain = F.concat(letters, _like(F.substr(canon, F.lit(1), F.length(canon) - F.length(top)), h), top)
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(_byte(h, i), F.lit(254)) + 1).cast("string")), ".")
    script = F.when(canon.rlike(r"\p{IsCyrillic}"), "cyrillic").when(canon.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    out = F.when(kind == "email", email).when(kind == "domain", domain).when(kind == "ip", F.concat(ip, F.when(tries > GROW, F.lit(":")).otherwise(""), digits))
    out = out.when(kind == "card", F.concat(_card(canon, h), digits)).when(kind == "iban", F.concat(_iban(canon, h), digits))
    out = out.when(kind.isin("given", "family"), F.concat(_name(kind, script, F.col("gender"), h, tries), F.when(tries > 4 + GROW, letters).otherwise("")))
    out = out.when(kind == "ipv6", F.concat(_like(canon, h, F.lit(True)), digits))
    return out.otherwise(F.concat(_like(canon, h, canon.rlike("^[0-9a-f]+$")), F.when(kind == "secret", letters).otherwise(digits)))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, sur) for distinct entities (kind, canon, gender): no two of a kind alike, none an entity itself.

    Within a group of equal surrogates the smallest entity keeps it and the others try again; settled ones are not touched.
    Entities are spread over tasks, whatever files they come in. As surrogates grow with the tries, every entity gets one.
    """
    spread = partitions(entities.sparkSession)
    todo = stash(entities.withColumn("tries", F.lit(0)), "entities")
    settled: DataFrame | None = None
    names = todo.select("kind", F.col("canon").alias("sur"))
    left, stalled = todo.count(), 0
    while left:
        keyed = todo.repartition(spread, "kind", "canon").withColumn("h", _digest(F.lit(key), F.col("kind"), F.col("canon"), F.col("tries").cast("string")))
        made = stash(keyed.withColumn("sur", _surrogate(key)).drop("h"), "surrogates")
        first = made.groupBy("kind", "sur").agg(F.min("canon").alias("canon"))
        free = first.join(names, ["kind", "sur"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "sur"), ["kind", "sur"], "left_anti")
        good = stash(free.select("kind", "canon", "sur"), "settled")
        settled = good if settled is None else settled.unionByName(good)
        rest = made.join(good, ["kind", "canon"], "left_anti").drop("sur").withColumn("tries", F.col("tries") + 1)
        todo, before = stash(rest, "entities"), left
        left = todo.count()
        stalled = stalled + 1 if left == before else 0
        if stalled >= STALLED:
            raise RuntimeError("no distinct surrogates are made for some entities")
    return todo.select("kind", "canon", F.lit("").alias("sur")) if settled is None else settled


def _written(m: Column, found: Column) -> Column:
    """The replacement of one match. found: map from kind and canon to the surrogate."""
    kind, prefix = _kind(m), _prefix(m)
    body = F.substr(m, F.length(prefix) + 1)
    plain = found[F.concat(kind, F.lit(":"), _canon(kind, body))]
    domain = found[F.concat(F.lit("domain:"), F.substring_index(F.lower(body), "@", -1))]
    sur = F.when(kind == "email", F.concat(F.substring_index(plain, "@", 1), F.lit("@"), domain)).otherwise(plain)
    held, digits = F.length(_canon(kind, body)), F.length(_digits(body))  # what the surrogate has beyond the canonical form comes last

    def digit(i: Column) -> Column:
        c, at = F.substr(body, i, F.lit(1)), F.length(_digits(F.substr(body, F.lit(1), i))) - digits + held
        return F.when(c.rlike("[0-9]") & (at > 0), F.substr(sur, at, F.lit(1))).otherwise(c)

    def cased(i: Column) -> Column:  # a surrogate may have grown; what the mention has no place for keeps its form
        c = F.substr(sur, i, F.lit(1))
        return F.when(F.substr(body, i, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)

    def spaced(i: Column) -> Column:
        return F.when(F.substr(body, i, F.lit(1)) == " ", " ").otherwise(F.substr(sur, F.length(F.regexp_replace(F.substr(body, F.lit(1), i), " ", "")), F.lit(1)))

    places = F.sequence(F.lit(1), F.length(body))
    words, gaps = F.regexp_extract_all(body, F.lit(_TOKEN), F.lit(0)), F.split(body, _TOKEN, -1)

    def word(w: Column, i: Column) -> Column:
        return F.concat(F.element_at(gaps, i + 1), _shaped(w, found[F.concat(_role(words, i), F.lit(":"), _name_key(w))]))

    beyond = F.substr(sur, held + 1)
    out = F.when(kind.isin("phone", "card", "ssn"), F.concat(F.array_join(F.transform(places, digit), ""), beyond))
    out = out.when(kind == "iban", F.concat(F.array_join(F.transform(places, spaced), ""), beyond))
    out = out.when(kind.isin("email", "secret"), F.array_join(F.transform(F.sequence(F.lit(1), F.length(sur)), cased), "")).when(kind == "name", F.array_join(F.transform(words, word), ""))
    return F.when(kind == "word", F.coalesce(_shaped(m, _known(m, found)), m)).otherwise(F.concat(prefix, out.otherwise(sur)))


def _known(word: Column, found: Column) -> Column:
    """The surrogate of a capitalised word if it is a name of the document."""
    return F.coalesce(found[F.concat(F.lit("given:"), _name_key(word))], found[F.concat(F.lit("family:"), _name_key(word))])


def _shaped(w: Column, s: Column) -> Column:
    """A name's surrogate in the letter case of the word."""
    first = lambda x: F.concat(F.upper(F.substr(x, F.lit(1), F.lit(1))), F.substr(x, F.lit(2)))
    lone = F.when(F.contains(s, F.lit("'")), F.concat(first(F.substring_index(s, "'", 1)), F.lit("'"), first(F.substring_index(s, "'", -1)))).otherwise(first(s))
    return F.when((w == F.upper(w)) & (F.length(w) > 1), F.upper(s)).otherwise(lone)


def has_pii(text: Column) -> Column:
    quick = text.rlike(QUICK[0])
    for p in QUICK[1:]:
        quick = quick | text.rlike(p)
    return F.coalesce(quick & text.rlike(ANY), F.lit(False))


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str = "tidemark") -> DataFrame:
    """(row, text, n_entities): row is a struct of docs' columns as they came, text the text with surrogates."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"))
    matches = F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    with_pii = rows.where(has_pii(F.col("text"))).withColumn("digest", F.sha2("text", 256))
    held = stash(with_pii.select("digest", F.array_distinct(matches).alias("m")).dropDuplicates(["digest"]), "matches")
    parts = stash(held.select("digest", F.explode("m").alias("m")).select("digest", F.explode(_parts(F.col("m"))).alias("p")).select("digest", "p.*"), "parts")
    made = surrogates(parts.groupBy("kind", "canon").agg(F.min("gender").alias("gender")), key)
    each = parts.select("digest", "kind", "canon").distinct().join(made, ["kind", "canon"])
    maps = stash(each.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.lit(":"), "canon").alias("k"), "sur"))).alias("found")), "replacements")
    gaps = F.split("text", WORDS_TOO, -1)
    pieces = F.zip_with(gaps, F.concat(F.transform("__m", lambda m: _written(m, F.col("found"))), F.array(F.lit(""))), lambda g, r: F.concat(g, r))
    real = F.filter("__m", lambda m: (_kind(m) != "word") | _known(m, F.col("found")).isNotNull())
    changed = with_pii.join(maps, "digest").withColumn("__m", F.regexp_extract_all("text", F.lit(WORDS_TOO), F.lit(0)))
    changed = changed.select("row", F.array_join(pieces, "").alias("text"), F.size(real).alias("n_entities"))
    return rows.where(~has_pii(F.col("text"))).select("row", "text", F.lit(0).alias("n_entities")).unionByName(changed)
