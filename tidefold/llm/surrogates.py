"""PII: surrogate generation, with DataFrame functions only.

Entities are found by patterns. Each distinct entity (its canonical form: digits of a number, an address in lower
case, a name without its title) gets one keyed surrogate of the same type and form, in every document and spelling:
digits become digits, letters become letters of the same case and script, addresses stay addresses, octets stay
octets, card numbers keep their issuer digit and a right check digit, names keep gender and script. Then surrogates
are checked: two entities of one type never share one, and none is itself an entity of the corpus; those that fail
draw again, at last from longer forms, until none fails. So mentions that were equal stay equal, and those that differed differ.

Only documents with entities are shuffled, by row; all others pass through where they are read. Entities meet their
surrogates in joins, after distinct, so an entity in a third of all rows is one row there.

Defined results: null texts stay null, empty ones empty. Repeated rows get equal texts. An empty table gives an empty
result. Other columns pass through, whatever their names (helper columns begin with ``_pii_``); clean_text and n_entities
of the input give way to the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .line_quality import let

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
UP, LOW = r"\p{Lu}", r"[\p{Ll}]"
NAME = rf"{UP}{LOW}+(?:[-']{UP}{LOW}+)*"
#: Titles, and given names by gender and script.
TITLES = {"m": "Mr Mister Herr Monsieur Señor Don", "f": "Mrs Ms Miss Frau Madame Mme Señora Doña", "u": "Dr Prof"}
GIVEN = {
    ("m", "latin"): "James John Robert Michael David William Richard Thomas Charles Daniel Matthew Anthony Steven Andrew Hans Peter Klaus Wolfgang Stefan Pierre Jean Michel Philippe Alain Carlos José Juan Miguel Pedro Luis",
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Emily Ursula Monika Petra Sabine Claudia Marie Nathalie Isabelle Sylvie Catherine María Carmen Ana Isabel Laura Lucía",
    ("m", "cyrillic"): "Иван Пётр Сергей Алексей Дмитрий Николай Михаил Андрей Владимир Павел",
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия",
}
SYLLABLES = {
    "latin": "bar ben cor dan del fen gal han har jor kel lan mar mon nor pel ran ros san sel tam tor val ver wen wil",
    "cyrillic": "бар вен гор дан зим кар лан мар нов пет рад сол там ков лев мир",
}
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшщэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ"]
CLASSES = ["[0-9]", "[a-zß-öø-ÿ]", "[A-ZÀ-ÖØ-Þ]", r"[\p{IsCyrillic}&&\p{Ll}]", r"[\p{IsCyrillic}&&\p{Lu}]"]

titles = "|".join(" ".join(TITLES.values()).split())
given = "|".join(" ".join(GIVEN.values()).split())
#: Kinds of entities in the order in which they are tried at a place.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![A-Za-z0-9])"
    r"|(?<=(?:password|passwd|pwd|secret|token|api_key|apikey)[=:])[^\s,;\"'<>]{4,}",
    "ip": rf"(?<![0-9A-Za-z.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9A-Za-z]|\.[0-9])",
    "ip6": r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![0-9A-Za-z:])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,4})?)(?![0-9A-Za-z-]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+.(-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,5}\)[ .-]?|[0-9]{2,5}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z-]|\.[0-9])"
    r"|(?<![0-9A-Za-z+.(-])\+[0-9]{8,15}(?![0-9A-Za-z])",
    "name": rf"(?<![\p{{L}}])(?:(?:{titles})\.? {NAME}(?: {NAME})?|(?:{given}) {NAME})(?![\p{{L}}])",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
NUMBERS = ("ssn", "card", "phone")
#: Attempts that keep an entity's form; later ones widen it.
SAME_FORM = 5


def possible(text: Column) -> Column:
    """Whether a text may have an entity at all; cheap, and true for every text that has one: addresses and numbers need
    an @ or a digit, secrets their prefix or key word, names a title or given name as a word."""
    words = F.array(*map(F.lit, sorted({*titles.split("|"), *given.split("|")})))
    out = text.rlike("[0-9@]")
    for mark in ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "password", "passwd", "pwd", "secret", "token", "api_key", "apikey"):
        out = out | text.contains(mark)
    return out | F.arrays_overlap(F.split(text, r"[^\p{L}]+"), words)


def kind_of(raw: Column) -> Column:
    """A mention's kind; lookarounds see the mention alone, so a secret after a key word is what nothing else is."""
    out = F.when(raw.rlike(rf"\A(?:{KINDS['email']})\z"), "email")
    for kind in ("ip", "ip6", "iban", "ssn", "card", "phone", "name"):
        out = out.when(raw.rlike(rf"\A(?:{KINDS[kind]})\z"), kind)
    return out.otherwise("secret")


def bare_name(raw: Column) -> Column:
    return F.regexp_replace(raw, rf"\A(?:{titles})\.? ", "")


def canonical(kind: Column, raw: Column) -> Column:
    return (
        F.when(kind.isin("email", "ip6"), F.lower(raw))
        .when(kind.isin(*NUMBERS), F.regexp_replace(raw, "[^0-9]", ""))
        .when(kind == "iban", F.regexp_replace(raw, " ", ""))
        .when(kind == "name", F.lower(bare_name(raw)))
        .otherwise(raw)
    )


def gender_of(raw: Column) -> Column:
    """m, f or u of a name, by its title, else its given name."""
    out = F.lit("u")
    for g in ("m", "f"):
        names = "|".join(" ".join(v for (x, _), v in GIVEN.items() if x == g).split())
        out = F.when(bare_name(raw).rlike(rf"\A(?:{names})(?![\p{{L}}])"), g).otherwise(out)
    for g in ("m", "f"):
        out = F.when(raw.rlike(rf"\A(?:{'|'.join(TITLES[g].split())})\.? "), g).otherwise(out)
    return out


def draw(seed: Column, place, n: int) -> Column:
    """A number below n, for a place, from a seed."""
    return F.pmod(F.xxhash64(seed, F.lit(place) if isinstance(place, (int, str)) else place), F.lit(n)).cast("int")


def pick(seed: Column, place: str, words: str) -> Column:
    words = words.split()
    return F.element_at(F.array(*map(F.lit, words)), draw(seed, place, len(words)) + 1)


def same_form(text: Column, seed: Column, all_of_it: Column | None = None) -> Column:
    """Digits for digits, letters for letters of the same case and script; all else as it is, or, where all_of_it says
    so of a character, a small letter."""

    def char(c, k):
        out = F.when(F.lit(False), c)
        for alphabet, cls in zip(ALPHABETS, CLASSES):
            out = out.when(c.rlike(cls), F.substring(F.lit(alphabet), draw(seed, k, len(alphabet)) + 1, F.lit(1)))
        if all_of_it is not None:
            out = out.when(all_of_it | c.rlike(r"[\p{L}\p{N}]"), F.substring(F.lit(ALPHABETS[1]), draw(seed, k, 26) + 1, F.lit(1)))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), char), "")


def more(seed: Column, attempt: Column) -> Column:
    """Digits by which a surrogate gets longer, one more with each attempt after the first few: so drawing ends."""
    digits = F.lpad(F.pmod(F.xxhash64(seed, F.lit("more")), F.lit(10**18)).cast("string"), 18, "0")
    return F.left(digits, F.greatest(attempt - SAME_FORM, F.lit(0)))


def secret_like(text: Column, seed: Column) -> Column:
    """Characters without an alphabet are drawn too if they are letters or digits, or if the secret has no others."""
    return same_form(text, seed, ~text.rlike(r"[\p{L}\p{N}]"))


def email_like(text: Column, seed: Column) -> Column:
    """Another local part, and another host below a domain that is reserved for examples."""
    local = same_form(F.substring_index(text, "@", 1), seed)
    top = F.substring_index(text, ".", -1)
    top = F.when(top.isin("com", "org", "net", "edu"), top).otherwise("com")
    return F.concat(local, F.lit("@mail"), (draw(seed, "host", 900) + 100).cast("string"), F.lit(".example."), top)


def ip6_like(seed: Column) -> Column:
    """An address of IPv6's range for documentation."""
    return F.concat(F.lit("2001:db8"), *[F.concat(F.lit(":"), F.substring(seed, 4 * k + 1, 4)) for k in range(6)])


def ip_like(text: Column, seed: Column, attempt: Column) -> Column:
    """Octets of as many digits; then of three; at last addresses of IPv6's range for documentation."""

    def octet(x, k):
        return (
            F.when(F.length(x) == 1, draw(seed, k, 10))
            .when(F.length(x) == 2, draw(seed, k, 90) + 10)
            .otherwise(draw(seed, k, 156) + 100)
            .cast("string")
        )

    def three(x, k):
        return (draw(seed, k, 156) + 100).cast("string")

    octets = F.split(text, r"\.")
    return (
        F.when(attempt <= SAME_FORM, F.array_join(F.transform(octets, octet), "."))
        .when(attempt <= 2 * SAME_FORM, F.array_join(F.transform(octets, three), "."))
        .otherwise(ip6_like(seed))
    )


def luhn_sum(digits: Column) -> Column:
    """Of digits to which a check digit will be added."""
    return F.aggregate(
        F.transform(F.reverse(F.split(digits, "")), lambda c, k: F.when(k % 2 == 0, 2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))),
        F.lit(0),
        lambda acc, x: acc + x,
    )


def card_like(digits: Column, seed: Column) -> Column:
    """The first digit stays; a number with a right check digit gets another one with a right check digit."""
    body = F.expr("substring(_pii_text, 1, length(_pii_text) - 1)")
    valid = F.pmod(luhn_sum(body) + F.right(digits, F.lit(1)).cast("int"), F.lit(10)) == 0
    other = F.concat(F.left(digits, F.lit(1)), same_form(F.expr("substring(_pii_text, 2, length(_pii_text) - 2)"), seed))
    check = F.when(valid, F.pmod(-luhn_sum(other), F.lit(10))).otherwise(draw(seed, "check", 10))
    return F.concat(other, check.cast("string"))


def phone_like(digits: Column, seed: Column) -> Column:
    """What is before the last ten digits, the country, stays."""
    ahead = F.greatest(F.length(digits) - 10, F.lit(0))
    return F.concat(F.substring(digits, F.lit(1), ahead), same_form(F.substring(digits, ahead + 1, F.length(digits)), seed))


def name_part(kind: Column, text: Column, gender: Column, seed: Column, attempt: Column) -> Column:
    """A given name of the gender (text: name and gender), later with made-up ones; or a made-up family name."""
    out = F.lit(None).cast("string")
    sure = F.when(gender == "u", F.when(draw(seed, "gender", 2) == 0, "m").otherwise("f")).otherwise(gender)
    for script in ("latin", "cyrillic"):
        first = F.when(sure == "m", pick(seed, "given", GIVEN["m", script])).otherwise(pick(seed, "given", GIVEN["f", script]))
        made = [pick(F.concat(seed, F.lit("0")), str(n), SYLLABLES[script]) for n in range(4)]
        rest = [F.when(attempt > SAME_FORM + n, pick(seed, f"more{n}", SYLLABLES[script])).otherwise("") for n in range(12)]
        second = F.when(attempt > SAME_FORM, F.concat(F.lit("-"), F.initcap(F.concat(*made, *rest)))).otherwise("")
        part = F.when(kind == "given", F.concat(first, second)).otherwise(F.initcap(F.concat(*made, *rest)))
        out = F.when(text.rlike(r"\p{IsCyrillic}") if script == "cyrillic" else ~text.rlike(r"\p{IsCyrillic}"), part).otherwise(out)
    return out


def with_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, text, gender, attempt) with surrogate."""
    named = entities.withColumn("_pii_text", F.col("text"))
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "text", "attempt"), 256)
    text, kind, attempt = F.col("_pii_text"), F.col("kind"), F.col("attempt")
    named = named.withColumn("_pii_seed", seed)
    seed = F.col("_pii_seed")
    made = (
        F.when(kind == "email", F.concat(more(seed, attempt), email_like(text, seed)))
        .when(kind == "ip", ip_like(text, seed, attempt))
        .when(kind == "ip6", ip6_like(seed))
        .when(kind == "card", card_like(text, seed))
        .when(kind == "phone", phone_like(text, seed))
        .when(kind.isin("given", "family"), name_part(kind, text, F.col("gender"), seed, attempt))
        .when(kind == "secret", F.when(text.startswith("AKIA"), F.concat(F.lit("AKIA"), same_form(F.substring(text, 5, 999), seed))).otherwise(secret_like(text, seed)))
        .when(kind == "iban", F.concat(F.left(text, F.lit(2)), same_form(F.substring(text, 3, 99), seed)))
        .otherwise(same_form(text, seed))
    )
    made = F.when(kind.isin(*NUMBERS, "iban", "secret"), F.concat(made, more(seed, attempt))).otherwise(made)
    return named.withColumn("surrogate", made).drop("_pii_text", "_pii_seed")


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, text, gender) -> (kind, text, surrogate), no surrogate given twice or being an entity itself.

    Given names may be those of other entities, but not their own. Of those that drew one surrogate, one keeps it; the
    others draw again, from wider and wider forms, so that rounds end whatever there is to be replaced."""
    table = written(with_surrogates(entities.withColumn("attempt", F.lit(0)), key), "surrogates")
    real = entities.select("kind", F.col("text").alias("surrogate_"), F.lit(True).alias("real"))
    own = (F.col("kind") == "given") & (F.lower("surrogate") == F.substring_index("text", " ", 1))
    while True:
        firsts = table.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "text")).alias("first"))
        judged = table.withColumn("surrogate_", F.when(F.col("kind") == "family", F.lower("surrogate")).otherwise(F.col("surrogate")))
        judged = judged.join(real, ["kind", "surrogate_"], "left").drop("surrogate_").join(firsts, ["kind", "surrogate"])
        judged = judged.withColumn("again", (F.col("text") != F.col("first.text")) | F.col("real").isNotNull() | own).drop("real", "first")
        judged = written(judged, "surrogates-judged")
        if judged.where("again").isEmpty():
            return judged.select("kind", "text", "surrogate")
        kept = judged.where("NOT again").drop("again")
        redrawn = judged.where("again").drop("again", "surrogate").withColumn("attempt", F.col("attempt") + 1)
        table = written(kept.unionByName(with_surrogates(redrawn, key)), "surrogates")


def chosen_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """As distinct_surrogates, with names drawn by their parts: a family name has one surrogate in full and short names,
    and so has a given name of one gender. As no two parts share a surrogate, no two names do."""
    names = entities.where("kind = 'name'").select("text", "gender", F.split("text", " ").alias("words"))
    names = names.select(
        "text", "gender", F.element_at("words", -1).alias("family"),
        F.when(F.size("words") > 1, F.concat_ws(" ", F.element_at("words", 1), "gender")).alias("given"),
    )
    families = names.select(F.lit("family").alias("kind"), F.col("family").alias("text"), F.lit("u").alias("gender")).distinct()
    firsts = names.where("given IS NOT NULL").select(F.lit("given").alias("kind"), F.col("given").alias("text"), "gender").distinct()
    chosen = distinct_surrogates(entities.where("kind <> 'name'").unionByName(families).unionByName(firsts), key)
    last = chosen.where("kind = 'family'").select(F.col("text").alias("family"), F.col("surrogate").alias("new_family"))
    first = chosen.where("kind = 'given'").select(F.col("text").alias("given"), F.col("surrogate").alias("new_given"))
    made = names.join(last, "family").join(first, "given", "left")
    made = made.select(F.lit("name").alias("kind"), "text", F.concat_ws(" ", "new_given", "new_family").alias("surrogate"))
    return chosen.where("kind NOT IN ('family', 'given')").unionByName(made)


def rendered(kind: Column, raw: Column, surrogate: Column) -> Column:
    """The surrogate in the form of a mention: separators of a number, title and capitals of a name."""
    digit = F.transform(
        F.split(raw, ""),
        lambda c, k: F.when(
            c.rlike("[0-9]"),
            F.substring(surrogate, F.length(F.regexp_replace(F.substring(raw, F.lit(1), k + 1), "[^0-9]", "")), F.lit(1)),
        ).otherwise(c),
    )
    spaced = F.transform(
        F.split(raw, ""),
        lambda c, k: F.when(c == " ", c).otherwise(F.substring(surrogate, F.length(F.regexp_replace(F.substring(raw, F.lit(1), k + 1), " ", "")), F.lit(1))),
    )
    # A widened surrogate has more than the mention has places for.
    rest = F.substring(surrogate, F.length(F.regexp_replace(raw, F.when(kind == "iban", " ").otherwise("[^0-9]"), "")) + 1, F.length(surrogate))
    title = F.regexp_extract(raw, rf"\A((?:{titles})\.? )", 1)
    return (
        F.when(kind.isin(*NUMBERS), F.concat(F.array_join(digit, ""), rest))
        .when(kind == "iban", F.concat(F.array_join(spaced, ""), rest))
        .when(kind == "name", F.concat(title, surrogate))
        .otherwise(surrogate)
    )


def replace_entities(docs: DataFrame, key: str = "surrogates", text: str = "text") -> DataFrame:
    """docs with clean_text and n_entities. key: whoever has it can make the same surrogates; keep it secret."""
    docs = docs.drop("clean_text", "n_entities")
    maybe = possible(F.coalesce(F.col(text), F.lit("")))
    looked = docs.where(maybe).withColumn("_pii_raw", F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)))
    looked = written(looked.withColumn("_pii_row", F.monotonically_increasing_id()), "looked-at")
    hits = looked.where(F.size("_pii_raw") > 0)
    mentions = hits.select("_pii_row", F.posexplode("_pii_raw").alias("at", "raw"))
    raws = mentions.select("raw").distinct().withColumn("kind", kind_of(F.col("raw")))
    raws = written(raws.withColumns({"text": canonical(F.col("kind"), F.col("raw")), "gender": F.when(F.col("kind") == "name", gender_of(F.col("raw")))}), "mentions")
    entities = raws.groupBy("kind", "text").agg(F.coalesce(F.min(F.when(F.col("gender") != "u", F.col("gender"))), F.lit("u")).alias("gender"))
    chosen = chosen_surrogates(entities, key)
    spelled = raws.join(chosen, ["kind", "text"]).select("raw", rendered(F.col("kind"), F.col("raw"), F.col("surrogate")).alias("new"))
    news = mentions.join(spelled, "raw").groupBy("_pii_row").agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias("_pii_new"))
    parts = F.split(F.col(text), ANY, -1)
    body = F.array_join(F.transform(parts, lambda p, k: F.concat(p, F.coalesce(F.get(F.col("_pii_new"), k)["new"], F.lit("")))), "")
    done = hits.join(news, "_pii_row").withColumns({"clean_text": body, "n_entities": F.size("_pii_new")})
    rest = docs.where(~maybe).unionByName(looked.where(F.size("_pii_raw") == 0).drop("_pii_row", "_pii_raw"))
    rest = rest.withColumns({"clean_text": F.col(text), "n_entities": F.lit(0)})
    return rest.unionByName(done.drop("_pii_row", "_pii_raw", "_pii_new"))
