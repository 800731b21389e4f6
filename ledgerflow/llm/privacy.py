"""Keyed surrogates for personal data and secrets in texts, with DataFrame functions only.

Each detected entity gets a replacement of its own type and format: digits for digits, letters for
letters in the same case and script, check digits that hold, names of the same gender. The same
entity gets the same replacement everywhere, in whatever format it is written; different ones never
share one, which rounds of collision checks make sure of. Names are replaced word by word, so that
a full name, a family name alone and a name without its title stay one person.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

MALE = ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Signor", "Signore", "Senhor", "Господин", "Κύριος", "Κύριε", "Κύριο")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Sra", "Señorita", "Doña", "Signora", "Senhora", "Госпожа", "Κυρία")
NEUTRAL = ("Dr", "Doctor", "Prof", "Professor", "Mx", "Доктор", "Δρ")
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: A word of a name, and the small words that may stand between two of them.
#: Repeated groups are bounded everywhere: the JVM's matcher takes a stack frame a repetition.
WORD = r"\p{Lu}(?:[\p{Ll}\p{M}]{1,60}+|[\p{Lu}\p{M}]{1,60}+(?![\p{Ll}\p{N}])|(?=['’]))(?:['’\-]\p{Lu}?[\p{Ll}\p{M}]{1,60}+|['’\-]\p{Lu}{1,60}+(?![\p{Ll}\p{N}])){0,4}"
SMALL = "(?:(?:van|von|de|da|di|del|der|den|dos|la|le|bin|ibn) ){0,4}"
TITLE = rf"\b(?:{'|'.join(MALE + FEMALE + NEUTRAL)})\.? "
#: What stands before a name of two words or more that has no title.
CUE = r"\b(?:[Mm]y name is|MY NAME IS|Name:|Full name:|Contact:|Contact person:|Signed:|Signed,|Signed by|Attn:|Author:|Patient:|Customer:) "
KEY_LEAD = r"(?:AKIA|ASIA|gh[pousr]_|sk-)"
#: The label of a secret, with what separates it from the value.
LABEL = r"(?i:(?:password|passwd|pwd|secret|token|api[_-]?key))[\"']?\s{0,2}[=:]\s{0,2}[\"']?"
#: Country calling codes: one digit, two digits, else three (fixed values, ITU-T E.164).
CALLING = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Patterns of the entity types, in the order in which they are tried.
PATTERNS = {
    "secret": rf"(?<![A-Za-z0-9]){LABEL}(?:[^\s\"'<>]{{7,}}|(?=[^\s\"'<>]*[0-9@#$%^&*+=_~])[^\s\"'<>]{{3,}})[^\s\"'<>.,;:!?)\]}}]",
    "access_key": r"\b(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_\-]{19,}[A-Za-z0-9])(?![A-Za-z0-9])",
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]+\.){1,126}[A-Za-z]{2,}",
    "mac": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])",
    "ipv6": r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]{0,34}[0-9])(?=(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:]))(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})(?![0-9A-Za-z:])",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\w.\-])\(?\d{3}\)?[ .\-]\d{3}[.\-]\d{4}(?![\w\-])|(?<![\w.+\-])\(?0[1-9]\d{1,3}\)?[ /\-]\d{3,4}[ \-]?\d{4,5}(?![\w\-])",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "card": r"(?<![\w.\-])(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\w|[.\-]\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": rf"{TITLE}(?:\p{{Lu}}\.? ){{0,4}}{SMALL}{WORD}(?: {SMALL}{WORD}){{0,6}}|{CUE}{WORD}(?: {SMALL}{WORD}){{1,6}}",
}
#: A name's text up to its first word.
LEAD = f"^(?:{TITLE}|{CUE})"
_EACH = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: One pattern for all; the card's back reference is the only group. Within a word only two types can begin.
ANY = rf"(?<![A-Za-z0-9])(?:{_EACH})|(?<=[A-Za-z])(?:{PATTERNS['mac']}|{PATTERNS['ip']})"
#: Stands on both sides of an entity while a text is taken apart; no character has this number.
MARK = "\ufdd0"
#: Stands, with a digit, for a mark or itself in a text that has one.
ESCAPE = "\ufdd2"
#: Begins a word of a name with its role: gf, gm, gn (given, by gender) or s (family name).
ROLE = "\ufdd1"

#: Consonants, vowels and accented vowels of the scripts that names are made in.
SCRIPTS = {
    "": ("b d f g k l m n p r s t v".split(), "a e i o u".split(), "á é í ó ú".split()),
    "IsCyrillic": ("б в г д к л м н п р с т".split(), "а е и о у".split(), "а е и о у".split()),
    "IsGreek": ("β γ δ κ λ μ ν π ρ τ φ χ".split(), "α ε η ι ο υ".split(), "ά έ ή ί ό ύ".split()),
}
#: Rounds in which a replacement keeps its form exactly; later ones have room for more.
EXACT = 8


def _text(value: str) -> str:
    """value as a literal of Spark SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def kind(surface: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, p in reversed(PATTERNS.items()):
        out = F.when(surface.rlike(f"^(?:{p})$"), F.lit(name)).otherwise(out)
    return out


def luhn(digits: str) -> str:
    """SQL: the Luhn sum of the digits in the named column, modulo 10."""
    doubled = "CASE WHEN i % 2 = 0 THEN int(d) WHEN int(d) > 4 THEN 2 * int(d) - 9 ELSE 2 * int(d) END"
    return f"aggregate(transform(reverse(split({digits}, '')), (d, i) -> {doubled}), 0, (a, x) -> a + x) % 10"


def mod97(iban: str) -> str:
    """SQL: an IBAN's (without blanks) remainder; a letter counts as two digits."""
    moved = f"concat(substring({iban}, 5), substring({iban}, 1, 4))"
    return f"aggregate(split({moved}, ''), 0, (a, c) -> CASE WHEN c rlike '[0-9]' THEN (a * 10 + int(c)) % 97 ELSE (a * 100 + ascii(c) - 55) % 97 END)"


def escaped(text: Column) -> Column:
    """text without MARK, should it have one."""
    has = (F.instr(text, MARK) > 0) | (F.instr(text, ESCAPE) > 0)
    return F.when(has, F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(MARK), F.lit(ESCAPE + "1"))).otherwise(text)


def unescaped(text: Column) -> Column:
    return F.when(F.instr(text, ESCAPE) > 0, F.replace(F.replace(text, F.lit(ESCAPE + "1"), F.lit(MARK)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))).otherwise(text)


def apart(text: Column) -> Column:
    """The text's pieces: what stands between entities at even places, the entities at odd ones."""
    return F.split(F.regexp_replace(text, ANY, f"{MARK}$0{MARK}"), MARK, -1)


def with_names(d: DataFrame, parts: str, out: str) -> DataFrame:
    """d with the column `parts` made into `out`: each word of a name apart, after its role; also where the name stands without a title.

    A text's names are those after a title. A word of one that is the last is a family name, the
    others are given names of the title's gender. What is used more than once is a column, so that
    it is worked out once.
    """
    gender = lambda t: F.when(t.rlike(rf"^(?:{'|'.join(MALE)})[. ]"), "gm").when(t.rlike(rf"^(?:{'|'.join(FEMALE)})[. ]"), "gf").otherwise("gn")
    titled = F.when(F.size(parts) > 1, F.filter(parts, lambda t, i: (i % 2 == 1) & t.rlike(LEAD))).otherwise(F.array().cast("array<string>"))
    words = lambda t: F.regexp_extract_all(F.regexp_replace(t, LEAD, ""), F.lit(f"({WORD})"), F.lit(1))
    split = F.transform("_titled", lambda t: F.struct(gender(t).alias("given"), words(t).alias("words")))
    told = lambda n: F.transform(n["words"], lambda w, i: F.struct(w.alias("word"), F.when(i == F.size(n["words"]) - 1, "s").otherwise(n["given"]).alias("role")))
    # longest first, as one may begin another
    longest = F.transform(F.array_sort(F.array_distinct(F.transform("_entries", lambda e: F.struct((-F.length(e["word"])).alias("n"), e["word"].alias("w"))))), lambda x: x["w"])
    any_word = F.concat(F.lit("(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\p{M}\p{N}])"))
    # a word alone that begins a sentence may be any word
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{M}\p{N}])(?:(?<=[\p{L}\p{M}\p{N},;:(\-–—/&'’] ?)"), any_word, F.lit("|(?="), any_word, F.lit(" "), any_word, F.lit(")"), any_word, F.lit(")"))

    def role(word: Column) -> Column:
        return F.coalesce(F.get(F.filter("_entries", lambda e: e["word"] == word), F.lit(0))["role"], F.lit("s"))

    def cut(part: Column, i: Column) -> Column:
        marked = F.split(F.regexp_replace(part, F.when(i % 2 == 0, F.col("_pattern")).otherwise(F.col("_titled_pattern")), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
        pieces = F.transform(marked, lambda w, k: F.when(k % 2 == 1, F.concat(F.lit(ROLE), role(w), F.lit(" "), w)).otherwise(w))
        # a titled name is at an entity's place, and begins and ends with what is none: with empty entities around, places stay even and odd
        empty = F.array(F.lit(""))
        return F.when(i % 2 == 0, pieces).when(part.rlike(LEAD), F.concat(empty, pieces, empty)).otherwise(F.array(part))

    d = d.withColumn("_titled", titled).withColumn("_names", split).withColumn("_entries", F.sort_array(F.array_distinct(F.flatten(F.transform("_names", told)))))
    d = d.withColumn("_pattern", F.when(F.size("_entries") > 0, pattern)).withColumn("_titled_pattern", F.concat(F.lit(r"(?<![\p{L}\p{M}\p{N}])"), any_word))
    return d.withColumn(out, F.when(F.col("_pattern").isNotNull(), F.flatten(F.transform(parts, cut))).otherwise(F.col(parts))).drop("_titled", "_names", "_entries", "_pattern", "_titled_pattern")


def described(df: DataFrame) -> DataFrame:
    """df with surface: adds type, lead (kept as it is), value (replaced) and canonical; no entity: null type."""
    word = F.col("surface").startswith(ROLE)
    d = df.withColumn("type", F.when(word, "name").otherwise(kind(F.col("surface"))))
    lead = {
        "secret": F.regexp_extract("surface", f"^{LABEL}", 0),
        "access_key": F.lit(""),
        "phone": F.regexp_extract("surface", f"^{CALLING}", 0),
        "iban": F.substring("surface", 1, 2),
        "name": F.regexp_extract("surface", "^[^ ]* ", 0),
    }
    d = d.withColumn("lead", F.coalesce(*[F.when(F.col("type") == k, x) for k, x in lead.items()], F.lit("")))
    d = d.withColumn("value", F.expr("substring(surface, length(lead) + 1)"))
    # a key is the same one with a label and without
    d = d.withColumn("type", F.when((F.col("type") == "secret") & F.col("value").rlike(f"^(?:{PATTERNS['access_key']})$"), "access_key").otherwise(F.col("type")))
    digits = F.regexp_replace("value", r"\D", "")
    d = d.withColumn(
        "canonical",
        F.when(F.col("type") == "phone", F.regexp_replace(digits, "^0+", ""))
        .when(F.col("type").isin("card", "ssn"), digits)
        .when(F.col("type") == "iban", F.concat("lead", F.regexp_replace("value", " ", "")))
        .when(F.col("type") == "name", F.concat(F.expr("substring(lead, 2)"), F.lower("value")))
        .when(F.col("type").isin("email", "mac", "ipv6"), F.lower("value"))
        .otherwise(F.col("value")),
    )
    card = F.when(F.col("canonical").rlike("^[0-9]+$"), F.expr(luhn("canonical"))) == 0
    iban = F.when(F.col("canonical").rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$"), F.expr(mod97("canonical"))) == 1
    phone = F.length("canonical") > 4
    secret = F.col("value").rlike(r"[\p{L}\p{N}]")  # else nothing is hidden, and nothing could replace it
    real = F.when(F.col("type") == "card", card).when(F.col("type") == "iban", iban).when(F.col("type") == "phone", phone).when(F.col("type") == "secret", secret)
    real = real.when(F.col("type") == "name", word).otherwise(True)
    return d.withColumn("type", F.when(F.coalesce(real, F.lit(False)), F.col("type")))


def one_person(surfaces: DataFrame) -> DataFrame:
    """A given name under a title without gender is the one that the corpus has under a title with one."""
    name = surfaces.where("type = 'name' AND lead RLIKE 'g[fm]'")
    word = F.expr("substring(canonical, instr(canonical, ' ') + 1)")
    known = name.groupBy(word.alias("_word")).agg(F.min(F.expr("substring_index(canonical, ' ', 1)")).alias("_gender"))
    d = surfaces.join(known, F.when((F.col("type") == "name") & F.col("canonical").startswith("gn "), word) == F.col("_word"), "left")
    return d.withColumn("canonical", F.when(F.col("_word").isNotNull(), F.concat("_gender", F.lit(" "), "_word")).otherwise(F.col("canonical"))).drop("_word", "_gender")


def _masked(value: str, seed: str) -> str:
    """SQL: value with its letters and digits replaced, each by one of its own class."""
    pick = f"pmod(xxhash64({seed}, i), {{}})"
    lower = f"substring('abcdefghijklmnopqrstuvwxyz', int({pick.format(26)}) + 1, 1)"
    return f"""array_join(transform(split({value}, ''), (c, i) -> CASE WHEN c rlike '[0-9]' THEN string({pick.format(10)})
        WHEN c rlike '[A-Z]' THEN upper({lower}) WHEN c rlike '[\\\\p{{L}}\\\\p{{N}}]' THEN {lower} ELSE c END), '')"""


def _hexed(value: str, seed: str) -> str:
    """SQL: the same for hexadecimal digits, which stay hexadecimal; digits stay digits in the first EXACT attempts."""
    pick = f"xxhash64({seed}, i)"
    return f"""array_join(transform(split({value}, ''), (c, i) -> CASE WHEN NOT c rlike '[0-9a-fA-F]' THEN c WHEN attempt >= {EXACT} THEN substring('0123456789abcdef', int(pmod({pick}, 16)) + 1, 1)
        WHEN c rlike '[0-9]' THEN string(pmod({pick}, 10)) ELSE substring('abcdef', int(pmod({pick}, 6)) + 1, 1) END), '')"""


def _picked(options: list[str], seed: str) -> str:
    """SQL: one of the options, by seed and i."""
    return f"element_at(array({', '.join(map(_text, options))}), int(pmod(xxhash64({seed}, i), {len(options)})) + 1)"


def _named(role: str, word: str, seed: str) -> str:
    """SQL: a pronounceable name of the same length and script, accents where they were; given names of women end in a vowel."""
    # once EXACT attempts have failed, names are longer
    size = f"(length({word}) + greatest(0, attempt - {EXACT - 1}))"
    vowel = f"(CASE WHEN {role} = 'gf' THEN ({size} - i) % 2 = 1 ELSE ({size} - i) % 2 = 0 END)"
    letter = f"substring({word}, i + 1, 1)"

    def made(script: tuple) -> str:
        plain = f"CASE WHEN {vowel} THEN {_picked(script[1], seed)} ELSE {_picked(script[0], seed)} END"
        return f"CASE WHEN {letter} rlike '[^\\\\p{{L}}\\\\p{{M}}]' THEN {letter} WHEN {letter} rlike '[à-ÿά-ώ]' AND NOT {letter} rlike '[α-ω]' THEN {_picked(script[2], seed)} ELSE {plain} END"

    chosen = made(SCRIPTS[""])
    for name, script in SCRIPTS.items():
        if name:
            chosen = f"CASE WHEN {word} rlike '\\\\p{{{name}}}' THEN {made(script)} ELSE {chosen} END"
    return f"array_join(transform(sequence(0, {size} - 1), i -> {chosen}), '')"


def seeded(df: DataFrame, key: str) -> DataFrame:
    """df with replacement: that of canonical, of its type, at its attempt.

    Seeds are columns of their own, or a long value's would be hashed anew for each of its letters.
    """
    seed = F.expr(f"sha2(concat_ws('|', {_text(key)}, type, canonical, string(attempt)), 256)")
    domain = F.expr(f"sha2(concat_ws('|', {_text(key)}, 'domain', substring_index(canonical, '@', -1)), 256)")
    return df.withColumns({"_seed": seed, "_domain": domain}).withColumn("replacement", surrogate()).drop("_seed", "_domain")


def surrogate() -> Column:
    """The replacement in the canonical's own form, by its seeds."""
    seed, domain = "_seed", "_domain"
    # numbers above 255 are no originals
    wide = f"CASE WHEN attempt >= {4 * EXACT} THEN 256 + pmod(xxhash64({seed}, i), 744) ELSE 1 + pmod(xxhash64({seed}, i), 254) END"
    octet = f"CASE WHEN attempt >= {EXACT} THEN {wide} WHEN length(o) = 1 THEN 1 + pmod(xxhash64({seed}, i), 9) WHEN length(o) = 2 THEN 10 + pmod(xxhash64({seed}, i), 90) ELSE 100 + pmod(xxhash64({seed}, i), 155) END"
    extra = f"greatest(0, attempt - {EXACT - 1})"
    body = f"concat(substring(canonical, 1, 1), {_masked(f"concat(substring(canonical, 2, length(canonical) - 2), repeat('0', {extra}))", seed)})"
    local = f"concat(substring_index(canonical, '@', 1), repeat('x', {extra}))"
    stem = "regexp_extract(substring_index(canonical, '@', -1), '^(.*)(\\\\.[^.]+)$', 1)"
    top = "regexp_extract(substring_index(canonical, '@', -1), '(\\\\.[^.]+)$', 1)"
    keep = f"regexp_extract(canonical, '^{KEY_LEAD}', 0)"
    account = _masked(f"concat(substring(canonical, 5), repeat('0', {extra}))", seed)
    more = lambda c: f"concat(canonical, repeat('{c}', {extra}))"
    return F.expr(f"""CASE type
      WHEN 'email' THEN concat({_masked(local, seed)}, '@', {_masked(stem, domain)}, {top})
      WHEN 'ip' THEN array_join(transform(split(canonical, '[.]'), (o, i) -> {octet}), '.')
      WHEN 'mac' THEN {_hexed("canonical", seed)}
      WHEN 'ipv6' THEN CASE WHEN attempt >= {EXACT} THEN {_hexed("'fd00:0000:0000:0000:0000:0000:0000:0000'", seed)} ELSE {_hexed("canonical", seed)} END
      WHEN 'card' THEN concat({body}, string((10 - {luhn(f"concat({body}, '0')")}) % 10))
      WHEN 'iban' THEN concat(substring(canonical, 1, 2), lpad(string(98 - {mod97(f"concat(substring(canonical, 1, 2), '00', {account})")}), 2, '0'), {account})
      WHEN 'phone' THEN concat(string(2 + pmod(xxhash64({seed}), 8)), {_masked(f"substring({more('0')}, 2)", seed)})
      WHEN 'name' THEN {_named("substring_index(canonical, ' ', 1)", "substring(canonical, instr(canonical, ' ') + 1)", seed)}
      WHEN 'access_key' THEN concat({keep}, {_masked(f"substring({more('x')}, length({keep}) + 1)", seed)})
      WHEN 'secret' THEN CASE WHEN canonical rlike '^[0-9a-f]{{16,}}$' THEN {_hexed(more('0'), seed)} ELSE {_masked(more('x'), seed)} END
      ELSE {_masked(more('0'), seed)} END""")


def surrogates(values: DataFrame, key: str) -> DataFrame:
    """(type, canonical, replacement) for distinct (type, canonical): all different, and no original.

    Where several would share a replacement, the first of them keeps it and the others try again;
    so do those whose replacement is in the data itself. After EXACT rounds replacements have more
    room: those of IPv6 addresses are any address, those of IPv4 and MAC addresses any numbers, all
    others are a letter or digit longer each round. So a form with fewer values than entities runs
    out of collisions; should a round after 8 * EXACT settle nothing, that is an error.
    """
    open_ = materialize(seeded(values.withColumn("attempt", F.lit(0)), key), "surrogates-open")
    word = F.when(F.col("type") == "name", F.expr("substring(canonical, instr(canonical, ' ') + 1)")).otherwise(F.col("canonical"))
    originals = values.select("type", word.alias("replacement"), F.lit(True).alias("taken")).distinct()
    settled, rounds = None, 0
    while True:
        rounds += 1
        least = open_.groupBy("type", "replacement").agg(F.min("canonical").alias("owner"))
        taken = originals if settled is None else originals.unionByName(settled.select("type", "replacement", F.lit(True).alias("taken"))).distinct()
        marked = open_.join(least.join(taken, ["type", "replacement"], "left"), ["type", "replacement"])
        marked = materialize(marked.withColumn("ok", (F.col("owner") == F.col("canonical")) & F.col("taken").isNull()), "surrogates-round")
        good = marked.where("ok").select("type", "canonical", "replacement")
        settled = good if settled is None else settled.unionByName(good)
        again = marked.where("NOT ok")
        if not again.limit(1).count():
            return settled
        if rounds > 8 * EXACT and not good.limit(1).count():
            raise RuntimeError(f"no replacements left for {again.limit(5).collect()}")
        open_ = again.select("type", "canonical", (F.col("attempt") + 1).alias("attempt"))
        open_ = materialize(seeded(open_, key), "surrogates-open")


def rendered() -> Column:
    """The replacement in the format of value: separators, blanks, leading zeros and upper case as they stand there."""
    zeros = F.regexp_extract(F.regexp_replace("value", r"\D", ""), "^0+", 0)
    plain = F.when(F.col("type") == "phone", F.concat(zeros, "replacement")).when(F.col("type") == "iban", F.expr("substring(replacement, 3)")).otherwise(F.col("replacement"))
    laid = F.expr("""array_join(transform(split(value, ''), (c, i) -> CASE WHEN c rlike '[A-Za-z0-9]'
        THEN substring(_plain, length(regexp_replace(substring(value, 1, i + 1), '[^A-Za-z0-9]', '')), 1) ELSE c END), '') ||
        substring(_plain, length(regexp_replace(value, '[^A-Za-z0-9]', '')) + 1)""")
    cased = F.expr("""array_join(zip_with(split(value, ''), split(_plain, ''), (c, p) -> CASE WHEN p IS NULL THEN '' WHEN c IS NULL AND length(value) > 1 AND value = upper(value)
        THEN upper(p) WHEN c rlike '\\\\p{Lu}' THEN upper(p) ELSE p END), '')""")
    return plain, F.when(F.col("type").isin("phone", "card", "ssn", "iban"), laid).when(F.col("type").isin("email", "mac", "ipv6", "name"), cased).otherwise(F.col("_plain"))


def replace_private(docs: DataFrame, key: str = "change me") -> DataFrame:
    """docs with surrogates in text, n_chars its new length (where there is one), and n_entities added.

    Null texts stay null with no entity; texts without any are unchanged; repeated rows stay and are
    replaced alike; an empty table gives no rows; other columns, also such as are named like those
    used here, pass through, but for an n_entities, which is replaced. Whole texts are read, and
    matched once.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    pieces = docs.select(row.alias("_doc"), apart(escaped(F.col("text"))).alias("_pieces"), F.monotonically_increasing_id().alias("_row"))
    some = materialize(with_names(pieces, "_pieces", "_parts").drop("_pieces"), "privacy-parts")
    odd = F.transform(F.sequence(F.lit(2), F.size("_parts"), F.lit(2)), lambda k: F.element_at("_parts", k.cast("int")))
    many = F.size("_parts") > 1
    found = some.where(many).select("_row", F.posexplode(odd).alias("_at", "surface"))
    found = materialize(found, "privacy-found")
    surfaces = materialize(described(found.select("surface").distinct()), "privacy-surfaces")
    surfaces = materialize(one_person(surfaces), "privacy-persons")
    made = surrogates(materialize(surfaces.where("type IS NOT NULL").select("type", "canonical").distinct(), "privacy-values"), key)
    plain, shown = rendered()
    bare = F.when(F.col("surface").startswith(ROLE), F.expr("substring(surface, instr(surface, ' ') + 1)")).otherwise(F.col("surface"))
    kept = F.when(F.col("type") == "name", F.lit("")).otherwise(F.col("lead"))
    new = surfaces.join(made, ["type", "canonical"], "left").withColumn("_plain", plain)
    new = new.select("surface", F.coalesce(F.concat(kept, shown), bare).alias("_new"), F.col("type").isNotNull().cast("int").alias("_is"))
    new = materialize(new, "privacy-new")
    per_row = found.join(new.hint("merge"), "surface").groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_at", "_new"))).alias("_all"), F.sum("_is").alias("_n"))
    even = F.transform(F.sequence(F.lit(1), F.size("_parts"), F.lit(2)), lambda k: F.element_at("_parts", k.cast("int")))
    text = F.array_join(F.zip_with(even, F.transform("_all", lambda x: x["_new"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    kind_of = dict(docs.dtypes)

    def finish(d: DataFrame, new_text: Column, n: Column) -> DataFrame:
        new_text = unescaped(new_text)
        change = {"text": new_text, "n_chars": F.length(new_text).cast(kind_of.get("n_chars", "long"))}
        kept = [change.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns if c != "n_entities"]
        return d.select(*kept, n.cast("long").alias("n_entities"))

    without = finish(some.where(~F.coalesce(many, F.lit(False))), F.when(F.col("_parts").isNotNull(), F.element_at("_parts", 1)), F.lit(0))
    return finish(some.where(many).join(per_row.hint("merge"), "_row"), text, F.col("_n")).unionByName(without)


def op1_pii(spark, sf_dir):
    return replace_private(table(spark, sf_dir, "documents"))
