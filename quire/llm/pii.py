"""Personal data: detected entities get keyed surrogates of the same type, gender, script and format. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import broadcast_if_small, scratch, staged

# Titles by gender, given names by gender and script, and syllables for family names by script.
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа"]
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н"]
OTHER_TITLES = ["Dr", "Prof"]
GIVEN = {
    ("latin", "f"): ["Alma", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irma", "Julia", "Klara", "Laura", "Marta", "Nora", "Olga", "Paula"],
    ("latin", "m"): ["Albert", "Bruno", "Carlos", "Daniel", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Oscar", "Paul", "Viktor"],
    ("cyrillic", "f"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Мария"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Павел", "Роман"],
    ("greek", "f"): ["Άννα", "Ελένη", "Ζωή", "Ειρήνη", "Κατερίνα", "Μαρία", "Σοφία", "Χριστίνα"],
    ("greek", "m"): ["Αλέξης", "Γιάννης", "Δημήτρης", "Κώστας", "Μιχάλης", "Νίκος", "Πέτρος", "Σταύρος"],
    ("hebrew", "f"): ["דינה", "יעל", "מרים", "נועה", "רבקה", "רות", "שרה", "תמר"],
    ("hebrew", "m"): ["אורי", "בועז", "גיל", "דוד", "יוסף", "משה", "נתן", "עמוס"],
}
SYLLABLES = {
    "latin": ["ba", "do", "fe", "ga", "hi", "ka", "le", "mo", "ni", "pa", "ro", "sa", "te", "vo", "wi", "zu"],
    "cyrillic": ["ба", "до", "фе", "га", "ки", "ла", "мо", "ни", "па", "ро", "са", "те", "во", "зу", "же", "ри"],
}
LETTERS = {"[0-9]": "0123456789", "[a-z]": "abcdefghijklmnopqrstuvwxyz", "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "[а-я]": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "[А-Я]": "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"}



def _alphabet(first: int, last: int, step: int = 1) -> str:
    """Every step-th letter of a range of Unicode."""
    return "".join(chr(c) for c in range(first, last + 1, step) if chr(c).isalpha())


#: Scripts beside Latin and Cyrillic: the pattern of their letters, and those that names are drawn from (of Hangul the syllables
#: without a final, of Han every thirteenth sign). Names in any other script get Latin ones.
SCRIPTS = {
    "greek": (r"\p{IsGreek}", _alphabet(0x3B1, 0x3C1)), "hebrew": (r"\p{IsHebrew}", _alphabet(0x5D0, 0x5EA)), "arabic": (r"\p{IsArabic}", _alphabet(0x628, 0x63A)),
    "armenian": (r"\p{IsArmenian}", _alphabet(0x561, 0x586)), "georgian": (r"\p{IsGeorgian}", _alphabet(0x10D0, 0x10F0)), "devanagari": (r"\p{IsDevanagari}", _alphabet(0x915, 0x939)),
    "bengali": (r"\p{IsBengali}", _alphabet(0x995, 0x9B9)), "tamil": (r"\p{IsTamil}", _alphabet(0xB95, 0xBB9)), "thai": (r"\p{IsThai}", _alphabet(0xE01, 0xE2E)),
    "hangul": (r"\p{IsHangul}", _alphabet(0xAC00, 0xD7A3, 28)), "han": (r"\p{IsHan}", _alphabet(0x4E00, 0x9FA5, 13)), "katakana": (r"\p{IsKatakana}", _alphabet(0x30A2, 0x30F3)),
    "hiragana": (r"\p{IsHiragana}", _alphabet(0x3042, 0x3093)),
}
#: The capitals that initials change among.
CAPITALS = [LETTERS["[A-Z]"], LETTERS["[А-Я]"], _alphabet(0x391, 0x3A9)]

_octet = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_titles = "|".join(sorted(FEMALE_TITLES + MALE_TITLES + OTHER_TITLES, key=len, reverse=True))
#: A word of a name: a capital and letters, more of them after hyphens and apostrophes, capitals inside; or an initial. Words
#: like "von" may stand before it.
_apostrophe = "['\u2019]"
_letters = r"[\p{L}\p{M}]"
_small = "von|van|der|den|zu|de|del|della|di|da|dos|du|la|le|bin|ibn|al|el"
_name_word = rf"(?:(?:{_small}) )*(?:[dl]{_apostrophe})?\p{{Lu}}(?:\.(?= \p{{Lu}})|{_letters}*+(?:(?:-|{_apostrophe}(?!s(?!{_letters}))){_letters}++)*+)"
#: Scripts without case don't show where a name ends: two to four signs of Han, one or two words of the others.
_caseless = r"\p{IsHan}{2,4}|(?!\p{IsHan})\p{Lo}[\p{Lo}\p{M}]++(?: (?!\p{IsHan})\p{Lo}[\p{Lo}\p{M}]++)?"
#: Parts of a person's name: a prefix like "O'", or a word with words like "von" before it and the space or hyphen after it.
_prefix = rf"(?:[dl]|\p{{Lu}}){_apostrophe}"
_name_part = rf"{_prefix}(?={_letters})|(?:(?:{_small}) )*+[^ -]+[ -]?"
#: A word that may be a name without a title, with what joins it to the next one.
NAME = rf"(?<![\p{{L}}\p{{M}}\p{{N}}_])\p{{Lu}}{_letters}++(?: (?:(?:{_small}) )*+(?=\p{{Lu}}{_letters})|-(?=\p{{Lu}}{_letters}))?"
#: "is" stands before secrets that hold a digit, as in "the password is hunter2".
_label = r"(?i:password|passwd|pwd|secret|api[_-]?key|access[_-]?key|token)(?:\s{0,2}[=:]\s{0,2}[\"']?|(?i:\s{1,2}is\s{1,2})[\"']?(?=[^\s\"'0-9]{0,40}[0-9]))"
#: Cards and identity numbers that begin with 0 are no phone numbers.
_no_phone = r"(?!\d{4}(?:[ -]\d{4}){3}(?!\d)|\d{4}[ -]\d{6}[ -]\d{5}(?!\d)|\d{3}-\d{2}-\d{4}(?!\d))"
_national = r"0\d{1,4}[ /-]\d{5,8}|0\d{2,4}(?:[ /-]\d{2,4}){2,4}"
#: The kinds and their patterns, in order of precedence. No pattern can start inside a run of its own characters, so that a
#: long run is read once.
PATTERNS = {
    "secret": rf"(?<![A-Za-z0-9_]){_label}[^\s\"']{{6,}}+|(?<![A-Za-z0-9])AKIA[0-9A-Z]{{16}}(?![A-Za-z0-9])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])" + rf"|(?<![\d.,:/-]){_no_phone}(?:{_national})(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
    "ip": rf"(?<![\d.]){_octet}(?:\.{_octet}){{3}}(?!\.?\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "person": rf"(?<![\p{{L}}\p{{N}}])(?:{_titles})\.? (?:{_name_word}(?: {_name_word})*+|{_caseless})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity holds; texts without it are not searched.
HINT = rf"[0-9@]|{_label}|(?:{_titles})\.? "
#: Exceptions (entities whose first surrogate collides) that may be broadcast.
BROADCAST_ROWS = 200_000
#: Tries that keep an entity's format. After them, surrogates of numbers get more digits at their end with each try, addresses
#: are ones of 2001:db8::/32, secrets are hexadecimal. Names and mail domains grow with every try.
MOST_TRIES = 4


def chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def kind_of(m: Column) -> Column:
    """The kind of a match: the first whose whole pattern it fits, without the look-arounds."""
    out = F.when(m.rlike(rf"^(?:{_label}|AKIA[0-9A-Z]{{16}}$)"), "secret").when(m.contains("@"), "email").when(m.rlike(rf"^(?:{_titles})\.? "), "person")
    out = out.when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(m.rlike(rf"^{_octet}(?:\.{_octet}){{3}}$"), "ip")
    return out.when(m.rlike(rf"^(?:\+|\(|\d{{3}}-\d{{3}}-|{_no_phone}(?:{_national})$)"), "phone").when(m.rlike("^[A-Z]"), "iban").otherwise("card")


def head_of(kind: Column, m: Column) -> Column:
    """What of a match stays: the label of a secret, the title of a person."""
    label = F.regexp_extract(m, rf"^{_label}", 0)
    return F.when(kind == "secret", label).when(kind == "person", F.regexp_extract(m, rf"^(?:{_titles})\.? ", 0)).otherwise("")


def canonical(kind: Column, body: Column) -> Column:
    """Equal for mentions of the same entity, however they are written."""
    digits = F.regexp_replace(body, "[^0-9+]", "")
    return F.when(kind.isin("phone", "card", "ssn"), digits).when(kind.isin("email", "given", "family"), F.lower(body)).when(kind == "initial", F.substring(body, 1, 1)).when(kind == "iban", F.replace(body, F.lit(" "), F.lit(""))).otherwise(body)


def parts_of(kind: Column, body: Column) -> Column:
    """Array of (part, kind, body, sep): each word of a person's name is an entity of its own (given, family, initial), so that
    "Anna Smith", "Smith" and "Smith-Jones" share a name; words like "von" belong to the one after them, prefixes like "O'"
    are kept. sep joins a part to the next one. Any other mention is one part."""
    words = F.regexp_extract_all(body, F.lit(_name_part), F.lit(0))
    last_given = F.coalesce(F.array_max(F.transform(words, lambda w, i: F.when(w.endswith(" "), i))), F.lit(-1))

    def one(w: Column, i: Column) -> Column:
        word = F.regexp_replace(w, "[ -]$", "")
        what = F.when(w.rlike(f"^{_prefix}$"), "kept").when(word.rlike(r"^\p{Lu}\.?$"), "initial").when(i <= last_given, "given").otherwise("family")
        return F.struct(i.alias("part"), what.alias("kind"), word.alias("body"), F.substring(w, F.length(word) + 1, F.lit(1)).alias("sep"))

    whole = F.array(F.struct(F.lit(0).alias("part"), kind.alias("kind"), body.alias("body"), F.lit("").alias("sep")))
    return F.when(kind == "person", F.transform(words, one)).otherwise(whole)


def _pick(values: list[str], seed: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(seed, F.lit(len(values))) + 1).cast("int"))


def _same_format(c: Column, digest: Column, keep: Column, hexadecimal: Column) -> Column:
    """Every digit and letter after the first `keep` signs changes to one of its class; other signs stay."""

    def swap(x: Column, i: Column) -> Column:
        seed = F.xxhash64(digest, i)
        out = F.when(i < keep, x)
        for kind, letters in LETTERS.items():
            pick = F.substring(F.lit(letters), F.pmod(seed, F.when(hexadecimal & F.lit(kind == "[a-z]"), 6).otherwise(len(letters))).cast("int") + 1, F.lit(1))
            out = out.when(x.rlike(kind), pick)
        return out.otherwise(x)

    return F.array_join(F.transform(chars(c), swap), "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the check of card numbers."""

    def value(x: Column, i: Column) -> Column:
        d = x.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.reverse(chars(digits)), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(c: Column) -> Column:
    """The remainder that checks account numbers: 1 where one is valid. Letters count as 10 to 35."""
    moved = F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, F.lit(1), F.lit(4)))

    def step(a: Column, x: Column) -> Column:
        return F.when(x.rlike("[0-9]"), a * 10 + F.ascii(x) - 48).otherwise(a * 100 + F.ascii(x) - 55) % 97

    return F.aggregate(chars(moved), F.lit(0), step)


def _names(kind: Column, canon: Column, digest: Column, gender: Column, tries: Column) -> Column:
    """A family name of syllables, in Cyrillic of the original's ending, or of letters of the original's script and number; or a
    given name of the gender. They grow with the tries."""

    def syllables(script: str, seed: str, n: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: _pick(SYLLABLES[script], F.xxhash64(digest, F.lit(seed), k))), "")

    def drawn(script: str, seed: str, n: Column) -> Column:
        letters = SCRIPTS[script][1]
        sign = lambda k: F.substring(F.lit(letters), F.pmod(F.xxhash64(digest, F.lit(seed), k), F.lit(len(letters))).cast("int") + 1, F.lit(1))
        return F.array_join(F.transform(F.sequence(F.lit(1), n), sign), "")

    def family(script: str) -> Column:
        if script in SCRIPTS:
            return F.initcap(drawn(script, "family", F.greatest(F.char_length(canon), F.lit(2)) + tries))
        ending = F.when(canon.rlike("[ая]$"), "ва").otherwise("") if script == "cyrillic" else F.lit("")
        return F.initcap(F.concat(syllables(script, "family", tries + 4), ending))

    def given(script: str) -> Column:
        if (script, "f") not in GIVEN:
            return family(script)
        seed = F.xxhash64(digest, F.lit("given"))
        either = _pick([*GIVEN[script, "f"], *GIVEN[script, "m"]], seed)
        first = F.when(gender == "f", _pick(GIVEN[script, "f"], seed)).when(gender == "m", _pick(GIVEN[script, "m"], seed)).otherwise(either)
        more = drawn(script, "more", tries + 2) if script in SCRIPTS else syllables(script, "more", tries + 1)
        return F.when(tries == 0, first).otherwise(F.concat(first, F.lit("-"), F.initcap(more)))

    def name(script: str) -> Column:
        return F.when(kind == "given", given(script)).otherwise(family(script))

    out = F.when(canon.rlike("[а-яё]"), name("cyrillic"))
    for script, (letter, _) in SCRIPTS.items():
        out = out.when(canon.rlike(letter), name(script))
    return out.otherwise(name("latin"))


def _initial(canon: Column, key: str) -> Column:
    """Another capital: those of an alphabet change places all alike, by a shift that the key gives, so that different ones stay
    different. Other letters become A to Z."""
    other = _pick(list(CAPITALS[0]), F.xxhash64(F.sha2(F.concat_ws("\u0001", F.lit(key), canon), 256)))
    for letters in CAPITALS:
        n = len(letters)
        shift = F.pmod(F.xxhash64(F.sha2(F.lit(f"{key}\u0001initial\u0001{key}"), 256)), F.lit(n - 1)) + 1
        at = F.instr(F.lit(letters), canon)
        other = F.when(at > 0, F.substring(F.lit(letters), F.pmod(at - 1 + shift, F.lit(n)).cast("int") + 1, F.lit(1))).otherwise(other)
    return other


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, canon, gender, tries) with `surrogate`, the canonical form of the replacement: a function of the key,
    the entity and the number of tries."""
    keyed = F.sha2(F.concat_ws("\u0001", F.lit(key), "kind", "canon", "gender", F.col("tries").cast("string"), F.lit(key)), 256)
    e = entities.withColumn("digest", keyed)
    kind, canon, digest, tries = F.col("kind"), F.col("canon"), F.col("digest"), F.col("tries").cast("int")
    beyond = F.greatest(tries - MOST_TRIES, F.lit(0))
    keep = F.when(kind == "iban", 2).when(canon.startswith("AKIA"), 4).when((kind == "phone") & canon.startswith("+"), 2).when((kind == "phone") & canon.startswith("0"), 1).otherwise(0)
    local = _same_format(F.substring_index("canon", "@", 1), digest, F.lit(0), F.lit(False))
    octets = [F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(16 if k == 0 else 256)) + (240 if k == 0 else 0) for k in range(4)]
    more = F.translate(F.substring(digest, F.lit(1), 2 * beyond), "abcdef", "012345")
    e = e.withColumn("same", F.when(~kind.isin("email", "ip", "given", "family", "initial", "kept"), _same_format(canon, digest, keep, canon.rlike("^[0-9a-f]+$"))))
    e = e.withColumn("same", F.when(kind.isin("phone", "ssn", "card", "iban"), F.concat("same", more)).otherwise(F.col("same")))
    last = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.concat(F.expr("left(same, length(same) - 1)"), k.cast("string"))), _luhn)
    check = F.lpad((98 - _mod97(F.concat(F.substring("same", 1, 2), F.lit("00"), F.expr("substring(same, 5)")))).cast("string"), 2, "0")
    groups = F.concat_ws(":", F.lit("2001:db8"), *[F.substring(digest, 4 * k + 1, 4) for k in range(6)])
    out = (
        F.when(kind == "email", F.concat(local, F.lit("@m"), F.substring(digest, F.lit(1), 8 + 4 * tries), F.lit(".example")))
        .when(kind == "ip", F.when(beyond > 0, groups).otherwise(F.concat_ws(".", *[o.cast("string") for o in octets])))
        .when(kind.isin("given", "family"), _names(kind, canon, digest, F.col("gender"), tries))
        .when(kind == "initial", _initial(canon, key))
        .when(kind == "kept", canon)
        .when(kind == "ssn", F.concat(F.lit("9"), F.expr("substring(same, 2)")))
        .when((kind == "card") & _luhn(canon), F.get(last, F.lit(0)))
        .when((kind == "iban") & (_mod97(canon) == 1), F.concat(F.substring("same", 1, 2), check, F.expr("substring(same, 5)")))
        .when((kind == "secret") & (beyond > 0), F.substring(digest, F.lit(1), 8 + 4 * beyond))
        .otherwise(F.col("same"))
    )
    return e.withColumn("surrogate", out).drop("digest", "same")


def rendered(kind: Column, body: Column, surrogate: Column) -> Column:
    """The surrogate in the format of the mention's body: its digits and letters take the places of the body's; what is left
    of a longer one follows. Names in capitals get capitals, an initial keeps its full stop."""
    last = F.substring_index(body, " ", -1)
    capitals = kind.isin("given", "family") & (F.upper(last) == last) & (F.lower(last) != last) & (F.char_length(last) > 1)
    name = F.when(capitals, F.upper(surrogate)).when((kind == "initial") & body.endswith("."), F.concat(surrogate, F.lit("."))).otherwise(surrogate)
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(a: Column, x: Column) -> Column:
        here = x.rlike("[A-Z0-9]") & (kind == "iban") | x.rlike("[0-9+]")
        return F.struct(F.concat(a["out"], F.when(here, F.substring(surrogate, a["k"], F.lit(1))).otherwise(x)).alias("out"), F.when(here, a["k"] + 1).otherwise(a["k"]).alias("k"))

    return F.when(kind.isin("phone", "card", "ssn", "iban"), F.aggregate(chars(body), start, step, lambda a: F.concat(a["out"], F.substring(surrogate, a["k"], F.length(surrogate))))).otherwise(name)


def collision_tries(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, gender, tries of the entities that need more than one try. An entity tries again while its surrogate is that of
    another entity (which has fewer tries, or sorts first) or is itself an entity of the data. As surrogates grow, this ends."""
    whole = ["kind", "canon", "gender"]
    settled = entities.withColumn("tries", F.lit(0))
    while True:
        named = surrogates(settled, key)
        first = named.groupBy("kind", "surrogate").agg(F.min(F.struct("tries", "canon", "gender")).alias("first"), F.count("*").alias("n")).where("n > 1")
        taken = named.join(first, ["kind", "surrogate"]).where("struct(tries, canon, gender) != first").select(*whole)
        named = named.withColumn("surrogate", F.when(F.col("kind").isin("given", "family"), F.lower("surrogate")).otherwise(F.col("surrogate")))
        real = named.join(entities.select("kind", F.col("canon").alias("surrogate")), ["kind", "surrogate"], "left_semi").select(*whole)
        bad = staged(taken.unionByName(real).distinct())
        if bad.isEmpty():
            return settled.where("tries > 0")
        settled = staged(settled.join(bad.withColumn("again", F.lit(1)), whole, "left").select(*whole, (F.col("tries") + F.coalesce("again", F.lit(0))).alias("tries")))


def untitled(base: DataFrame, words: DataFrame) -> DataFrame | None:
    """Names of known persons that stand without a title, outside of other entities: row, pos (entities before them), at
    (number among the capitalised words there), kind, canon, body, sep, begins. A word is one if its text names a person by it,
    after a title or in two words that follow each other in a titled person's name of any text. Rows with such words
    have all their capitalised words, the others of kind `kept`. None if no person is known.

    words: given and family names after titles, with row, pos, part, kind, canon."""
    words = words.select("row", "pos", "part", F.substring_index("canon", " ", -1).alias("word"), F.struct("kind", "canon").alias("name"))
    pairs = words.withColumn("next", F.lead(F.struct("word", "name")).over(Window.partitionBy("row", "pos").orderBy("part"))).where("next is not null")
    pairs = staged(pairs.groupBy("word", F.col("next.word").alias("after")).agg(F.min("name").alias("name"), F.min("next.name").alias("after_name")))
    known = staged(words.groupBy("row", "word").agg(F.min("name").alias("name")))
    if known.isEmpty():
        return None
    text, letters = F.col("text"), rf"^{_letters}+"
    low = lambda x: F.lower(F.regexp_extract(x, letters, 0))
    gaps = F.when(F.size("found") == 0, F.array(text)).otherwise(F.split(text, ANY, -1))
    seen = base.where(text.rlike(NAME)).select("row", F.posexplode(gaps).alias("pos", "gap"))
    seen = staged(seen.select("row", "pos", F.regexp_extract_all("gap", F.lit(NAME), F.lit(0)).alias("words")).where(F.size("words") > 0))
    joined = F.transform("words", lambda x, i: F.when(x.rlike("[ -]$"), F.struct(i.alias("at"), low(x).alias("word"), low(F.get("words", i + 1)).alias("after"))))
    by_pair = seen.select("row", "pos", F.inline(F.filter(joined, lambda x: x.isNotNull())))
    by_pair = by_pair.join(broadcast_if_small(pairs, pairs.count(), BROADCAST_ROWS), ["word", "after"])
    after = F.struct((F.col("at") + 1).alias("at"), F.col("after").alias("word"), F.col("after_name").alias("name"))
    by_pair = staged(by_pair.select("row", "pos", F.inline(F.array(F.struct("at", "word", "name"), after))))
    known = known.unionByName(by_pair.select("row", "word", "name")).groupBy("row", "word").agg(F.min("name").alias("name"))
    each = seen.select("row", "pos", F.posexplode("words").alias("at", "x"))
    here = each.join(known.select("row").distinct(), "row", "left_semi").withColumn("word", low(F.col("x"))).join(known, ["row", "word"])
    hits = staged(by_pair.unionByName(here.select(by_pair.columns)).groupBy("row", "pos", "at").agg(F.min("name").alias("name")))
    out = each.join(hits.select("row").distinct(), "row", "left_semi").join(hits, ["row", "pos", "at"], "left")
    out = out.select("row", "pos", "at", F.col("name").isNotNull().alias("hit"), "name", F.regexp_extract("x", letters, 0).alias("body"), F.regexp_replace("x", letters, "").alias("sep"))
    along = Window.partitionBy("row", "pos").orderBy("at")
    follows = F.coalesce(F.lag(F.col("hit") & (F.col("sep") != "")).over(along), F.lit(False))
    sep = F.when(F.col("hit") & F.lead("hit").over(along) & F.col("sep").startswith(" "), " ").otherwise(F.col("sep"))
    return out.select("row", "pos", "at", F.coalesce("name.kind", F.lit("kept")).alias("kind"), F.coalesce("name.canon", "body").alias("canon"), "body", sep.alias("sep"), (F.col("hit") & ~follows).alias("begins"))


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Replace every detected entity of every whole text: id_col, text, n_entities (long), kinds (sorted array of strings).

    Kinds: secret, email, phone, ssn, card, ip, iban, person. Mentions of an entity share its canonical form and so its
    surrogate, in all documents; the surrogate takes the format of each mention. Surrogates of different entities of a kind
    differ, and none is an entity of the data. Card and account numbers keep their validity; addresses become ones of the
    reserved block 240.0.0.0/4 (where that is full, of 2001:db8::/32) and of the top-level domain .example.

    Persons are found after a title; their names are then replaced without one as well: in all texts two words that follow
    each other in a name ("Anna Smith"), and in a text that has a person by either way each word of the name. That takes capitals: names in scripts without case
    are only found after a title. Each word of a name is an entity of its own, parts of a hyphenated one too; words like
    "von" go with the one after them, prefixes like "O'" stay. A mention's title gives the gender of its given names, a neutral title, or none, the
    gender that the name has elsewhere. Names keep script, capitals, hyphens and initials; an initial is changed by itself
    and needn't be that of the name's surrogate. A common word that is also a name in its text is replaced with it.

    The patterns run once over all texts; what they find is stored, and only texts with entities are taken apart again. Texts
    without one pass unchanged (and unshuffled, as long as no more than BROADCAST_ROWS texts have names without a title only).
    Only mentions are grouped; the distinct entities are summed in each task first. Null text stays null. Repeated rows
    and rows with a null id are treated each. An empty table gives no rows. Other columns are ignored. No entity's original
    is in the result, but as said."""
    text = F.col("text")
    found = F.when(text.rlike(HINT), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    base = staged(base.select(F.monotonically_increasing_id().alias("row"), "id", "text", F.coalesce(found, F.array().cast("array<string>")).alias("found")))
    columns = ["row", "pos", "at", "whole", "head", "begins", "gender", "part", "kind", "body", "sep", "canon"]

    with scratch(docs.sparkSession):
        mentions = base.where(F.size("found") > 0).select("row", F.posexplode("found").alias("pos", "m")).withColumn("whole", kind_of(F.col("m")))
        mentions = mentions.withColumn("head", head_of(F.col("whole"), F.col("m"))).withColumn("body", F.expr("substring(m, length(head) + 1)"))
        title = F.regexp_replace("head", r"[. ]", "")
        gender = F.when(title.isin(FEMALE_TITLES), "f").when(title.isin(MALE_TITLES), "m").otherwise("")
        parts = mentions.select("row", "pos", "whole", "head", gender.alias("gender"), F.inline(parts_of(F.col("whole"), F.col("body"))))
        parts = parts.withColumn("canon", canonical(F.col("kind"), F.col("body"))).withColumn("gender", F.when(F.col("kind") == "given", F.col("gender")).otherwise(""))
        parts = staged(parts.withColumns({"at": F.lit(2**31 - 1), "begins": F.lit(True)}).select(columns), keep=True)
        names = untitled(base, parts.where("kind IN ('given', 'family')"))
        if names is not None:
            names = staged(names.withColumns({"whole": F.when(F.col("kind") != "kept", "person"), "head": F.lit(""), "gender": F.lit(""), "part": F.lit(0)}).select(columns), keep=True)
            parts = parts.unionByName(names)
            late = staged(names.select("row").distinct(), keep=True)
        usual = parts.where("kind = 'given'").groupBy("kind", "canon").agg(F.count_if(F.col("gender") == "f").alias("f"), F.count_if(F.col("gender") == "m").alias("m"))
        usual = staged(usual.where("f != m").select("kind", "canon", F.when(F.col("f") > F.col("m"), "f").otherwise("m").alias("usual")), keep=True)
        parts = parts.join(broadcast_if_small(usual, usual.count(), BROADCAST_ROWS), ["kind", "canon"], "left")
        parts = parts.withColumn("gender", F.when((F.col("kind") == "given") & (F.col("gender") == ""), F.coalesce("usual", F.lit(""))).otherwise(F.col("gender")))
        entities = staged(parts.where("kind NOT IN ('initial', 'kept')").select("kind", "canon", "gender").distinct())
        tries = staged(collision_tries(entities, key), keep=True)

    m = parts.join(broadcast_if_small(tries, tries.count(), BROADCAST_ROWS), ["kind", "canon", "gender"], "left").withColumn("tries", F.coalesce("tries", F.lit(0)))
    new = F.concat(rendered(F.col("kind"), F.col("body"), F.col("surrogate")), "sep").alias("new")
    m = surrogates(m, key).select("row", "pos", "at", "whole", "head", "begins", "part", new).groupBy("row", "pos", "at", "whole", "head", "begins")
    m = m.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "new"))), lambda x: x["new"]), "").alias("new"))
    new = F.array_sort(F.collect_list(F.struct("pos", "at", F.concat("head", "new").alias("new")))).alias("new")
    new = m.groupBy("row").agg(new, F.count_if("begins").alias("n_entities"), F.array_sort(F.collect_set("whole")).alias("kinds"), (F.min("at") < 2**31 - 1).alias("named"))

    plain, touched = base.where(F.size("found") == 0), base.where(F.size("found") > 0)
    if names is not None:
        late = broadcast_if_small(late, late.count(), BROADCAST_ROWS)
        touched = touched.unionByName(plain.join(late, "row", "left_semi"))
        plain = plain.join(late, "row", "left_anti")
    gaps = F.when(F.size("found") == 0, F.array(text)).otherwise(F.split("text", ANY, -1))
    gaps = F.when(F.col("named"), F.flatten(F.transform(gaps, lambda gap: F.split(gap, NAME, -1)))).otherwise(gaps)
    rebuilt = F.array_join(F.zip_with(gaps, F.concat(F.col("new.new"), F.array(F.lit(""))), lambda gap, x: F.concat(gap, x)), "")
    out = touched.join(new, "row").select("id", rebuilt.alias("text"), "n_entities", "kinds")
    plain = plain.select("id", "text", F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    return plain.unionByName(out).withColumnRenamed("id", id_col)
