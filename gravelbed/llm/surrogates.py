"""PII surrogates: keyed, type-consistent replacements for detected entities.

Detection, surrogates and replacement are built-in column functions (no Python, pandas or RDD code). One
pattern finds e-mail addresses, phone and card numbers, social security numbers, IPv4 addresses,
IBANs, hexadecimal secrets, and person names (after an honorific or a known given name).

A surrogate is drawn from SHA-256(key, type, normalised entity, attempt), the key being a setting of the session: digits become
digits and letters letters of the same case, punctuation and length stay. E-mail domains are
drawn apart, so that addresses of one domain still share one, and keep their last label; the
octets of an address stay in range; card and IBAN prefixes stay, and a card that passes the Luhn
check gets a surrogate that does. A known given name becomes another of the same gender and
script by a keyed rotation of its list, which is one to one; other names are respelt in letters
of their script, so a name maps alike with and without its title.

Coreference: entities are normalised first (case of e-mail addresses and secrets, punctuation of
numbers; a name counts by its last word), so every mention in any document gets the same surrogate. Distinctness: the
surrogates of all distinct entities are compared with each other and with all real entities;
those that collide are drawn again with the next attempt until none does. Only documents that
hold a redrawn entity take part in a join.

Nulls: a null text stays null and has no entities. Empty texts stay. Ties and repeated rows get
equal results, as a surrogate depends on the entity alone. Extra columns pass through unless
they have the name of an added one (surrogate_text, kinds), which replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, written

#: The session's setting that holds the secret key, and the key of tests and demonstrations where it is unset.
KEY_CONF, KEY = "spark.gravelbed.surrogates.key", "gravelbed"
ATTEMPTS = 64
NONE = "map<string,int>"

#: Given names by gender and script, and honorifics.
GIVEN = {
    "male": "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Steven Paul Andrew Peter Hans Klaus Jürgen Wolfgang Stefan Pierre Jacques François Louis Henri Carlos Juan José Luis Miguel Pedro".split(),
    "female": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Emily Emma Anna Ursula Monika Petra Sabine Claudia Marie Sophie Camille Juliette Isabelle María Carmen Lucía Elena Sofía Isabel Pilar Rosa".split(),
    "male_cyrillic": "Александр Дмитрий Сергей Андрей Алексей Иван Михаил Николай Павел Виктор".split(),
    "female_cyrillic": "Анна Мария Елена Ольга Наталья Ирина Светлана Татьяна Екатерина Юлия".split(),
}
HONORIFICS = "Mr Mrs Ms Miss Herr Frau Monsieur Madame Mme Mlle Señor Señora Господин Госпожа".split()
#: Letters that names are respelt in, by script.
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

_NAME = r"\p{Lu}\p{Ll}{1,30}"
_GIVEN = "|".join(x for names in GIVEN.values() for x in names)
#: The parts start only where no word or number runs on and begin with a test of the first
#: character, so most places cost one test; lengths are bounded, so a scan stays linear.
PARTS = {
    "email": r"(?<![._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
    "ip": r"(?=\d)(?<!\d\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "card": r"(?=\d)(?<!-)(?:\d{16}|\d{4}(?:[ -]\d{4}){3})(?![\w-])",
    "ssn": r"(?=\d)(?<!-)\d{3}-\d{2}-\d{4}(?![\w-])",
    "secret": r"(?=[0-9A-Fa-f])(?:[0-9a-f]{32,64}+|[0-9A-F]{32,64}+)(?![0-9A-Za-z])",
    "iban": r"(?=[A-Z]{2}\d)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "name": rf"(?=\p{{Lu}})(?<!\p{{L}})(?:(?:{'|'.join(HONORIFICS)})\.? {_NAME}(?: {_NAME})?|(?:{_GIVEN}) {_NAME})(?![\p{{L}}\d_])",
}
PATTERN = f"(?<![A-Za-z0-9])(?:{'|'.join(PARTS.values())})"


def kind_of(match: Column) -> Column:
    """The type of a match of PATTERN."""
    digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    return (
        F.when(match.contains("@"), "email")
        .when(match.startswith("+"), "phone")
        .when(match.rlike(r"^[0-9]+(\.[0-9]+){3}$"), "ip")
        .when(match.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(match.rlike(r"^[0-9 -]+$") & (digits == 16), "card")
        .when(match.rlike(r"^([0-9a-f]{32,64}|[0-9A-F]{32,64})$"), "secret")
        .when(match.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .otherwise("name")
    )


def normal(kind: Column, match: Column) -> Column:
    """The form that all mentions of one entity share."""
    return (
        F.when(kind.isin("email", "secret"), F.lower(match))
        .when(kind.isin("phone", "card", "ssn"), F.regexp_replace(match, "[^0-9]", ""))
        .when(kind == "iban", F.replace(match, F.lit(" "), F.lit("")))
        .when(kind == "name", F.substring_index(match, " ", -1))
        .otherwise(match)
    )


def _key() -> str:
    return SparkSession.active().conf.get(KEY_CONF, KEY)


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(_key()), *(p.cast("string") for p in parts)), 256)


def _drawn(digest: Column, i: Column, n: int | Column) -> Column:
    """A number below n from the digest's i-th group of four hexadecimal digits; the digest is hashed on as it ends."""
    bits = F.sha2(F.concat(digest, (i / 16).cast("int").cast("string")), 256)
    return (F.conv(F.substring(bits, F.pmod(i, F.lit(16)) * 4 + 1, F.lit(4)), 16, 10).cast("int") % n).cast("int")


def _respelt(text: Column, digest: Column, skip: int | Column = 0) -> Column:
    """text with each digit and letter after the first skip ones drawn anew; case and other characters stay.

    The i-th digit or letter takes the i-th draw, so mentions that differ in punctuation agree."""
    chars = F.split(text, "")
    alnum = F.transform(chars, lambda c: F.when(c.rlike(r"[\p{L}\p{Nd}]"), 1).otherwise(0))

    def spelt(c: Column, at: Column) -> Column:
        out = F.when(c.rlike("[0-9]"), _drawn(digest, at, 10).cast("string"))
        for script, letters in LETTERS.items():
            low = F.substring(F.lit(letters), _drawn(digest, at, len(letters)) + 1, F.lit(1))
            known = {"latin": r"\p{IsLatin}", "cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}"}[script]
            out = out.when(c.rlike(known), F.when(c.rlike(r"\p{Lu}"), F.upper(low)).otherwise(low))
        return out.otherwise(c)

    def place(flags: Column, i: Column) -> Column:
        return F.aggregate(F.slice(flags, 1, i), F.lit(0), lambda n, x: n + x)

    return let(alnum, lambda flags: F.array_join(F.transform(chars, lambda c, i: F.when(place(flags, i) < skip, c).otherwise(spelt(c, place(flags, i)))), ""))


def luhn(digits: Column) -> Column:
    """Sum of the Luhn check of 16 digits."""
    each = F.transform(F.split(digits, ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda n, x: n + x)


def _card(match: Column, norm: Column, digest: Column) -> Column:
    def checked(new: Column) -> Column:
        plain = F.regexp_replace(new, "[^0-9]", "")
        rest = luhn(F.concat(F.substring(plain, 1, 15), F.lit("0")))
        return F.when(luhn(norm) % 10 == 0, F.concat(F.substring(new, F.lit(1), F.length(new) - 1), ((10 - rest % 10) % 10).cast("string"))).otherwise(new)

    return let(_respelt(match, digest, 1), checked)


def _email(match: Column, norm: Column, digest: Column) -> Column:
    host = F.substring_index(match, "@", -1)
    top = F.substring_index(host, ".", -1)
    inner = F.substring(host, F.lit(1), F.length(host) - F.length(top) - 1)
    return F.concat(_respelt(F.substring_index(match, "@", 1), digest), F.lit("@"), _respelt(inner, _digest(F.lit("domain"), F.substring_index(norm, "@", -1))), F.lit("."), top)


def _ip(digest: Column) -> Column:
    return F.concat_ws(".", *((_drawn(digest, F.lit(i), 256 if i else 223) + (0 if i else 1)).cast("string") for i in range(4)))


def _name(match: Column, attempt: Column) -> Column:
    """Given names turn within their list; a last word that is one and has to be redrawn is respelt,
    as the turned name stays taken however often it is drawn."""
    words = F.split(match, " ")

    def token(word: Column, at: Column) -> Column:
        out = F.when(F.rtrim(word, F.lit(".")).isin(HONORIFICS), word)
        for group, names in GIVEN.items():
            turn = F.conv(F.substring(_digest(F.lit("given"), F.lit(group)), 1, 6), 16, 10).cast("int") % (len(names) - 1) + 1
            place = F.array_position(F.array(*map(F.lit, names)), word).cast("int")
            out = out.when((place > 0) & ((attempt == 0) | (at < F.size(words) - 1)), F.element_at(F.array(*map(F.lit, names)), (place - 1 + turn) % len(names) + 1))
        return out.otherwise(_respelt(word, _digest(F.lit("name"), word, attempt)))

    return F.array_join(F.transform(words, token), " ")


def surrogate(match: Column, attempts: Column) -> Column:
    """The replacement of a match; attempts: a map from type and normalised entity to the redraws it needs."""

    def drawn(x: Column) -> Column:
        kind, norm, attempt = x["kind"], x["norm"], x["attempt"]
        digest = _digest(kind, norm, attempt)
        return (
            F.when(kind == "email", _email(x["match"], norm, digest))
            .when(kind == "ip", _ip(digest))
            .when(kind == "card", _card(x["match"], norm, digest))
            .when(kind == "iban", _respelt(x["match"], digest, 4))
            .when(kind == "name", _name(x["match"], attempt))
            .otherwise(F.when(kind == "secret", _hex(x["match"], digest)).otherwise(_respelt(x["match"], digest, F.when(kind == "phone", 1).otherwise(0))))
        )

    def known(kind: Column) -> Column:
        return let(normal(kind, match), lambda norm: F.struct(match.alias("match"), kind.alias("kind"), norm.alias("norm"), F.coalesce(attempts[entity(kind, norm)], F.lit(0)).alias("attempt")))

    return let(let(kind_of(match), known), drawn)


def _hex(match: Column, digest: Column) -> Column:
    """Hexadecimal digits for hexadecimal digits, in the mention's case."""
    new = F.substring(digest, F.lit(1), F.length(match))
    return F.when(match.rlike("[A-F]"), F.upper(new)).otherwise(new)


def entity(kind: Column, norm: Column) -> Column:
    return F.concat(kind, F.lit(":"), norm)


def _plain(match: Column, attempt: Column) -> Column:
    """The normalised surrogate of an entity as it is normalised."""
    only = F.create_map(entity(kind_of(match), normal(kind_of(match), match)), attempt)
    return let(surrogate(match, only), lambda s: normal(kind_of(match), s))


def redrawn(docs: DataFrame, text: str = "text") -> DataFrame:
    """kind, norm, attempt of the entities whose first surrogate is taken.

    A surrogate is taken if it is a real entity of its type or the surrogate of another one; of
    entities that draw the same, the smallest keeps it. Rounds work on what is left."""
    match = F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))))
    found = docs.select(match.alias("match")).withColumn("kind", kind_of(F.col("match"))).withColumn("norm", normal(F.col("kind"), F.col("match")))
    real = written(found.groupBy("kind", "norm").agg(F.min("match").alias("match")), "entities")
    taken, pending, out = real.select("kind", F.col("norm").alias("new")), real, None
    for attempt in range(ATTEMPTS):
        drawn = written(pending.withColumn("new", _plain(F.col("match"), F.lit(attempt))), "drawn")
        first = drawn.groupBy("kind", "new").agg(F.min("norm").alias("norm"))
        good = written(first.join(taken, ["kind", "new"], "left_anti"), "good")
        if attempt:
            now = good.select("kind", "norm", F.lit(attempt).alias("attempt"))
            out = now if out is None else out.unionByName(now)
        pending = written(drawn.join(good, ["kind", "norm"], "left_anti").drop("new"), "pending")
        if pending.isEmpty():
            break
        taken = taken.unionByName(good.select("kind", "new"))
    else:
        raise RuntimeError(f"surrogates still collide after {ATTEMPTS} draws")
    return out if out is not None else real.select("kind", "norm", F.lit(0).alias("attempt")).limit(0)


def replaced(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with surrogate_text and kinds (the types of its entities, in order)."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("surrogate_text", "kinds")]
    attempts = written(redrawn(docs, text), "redrawn")
    rows = docs.select(*keep)
    if attempts.isEmpty():
        rows = rows.withColumn("_attempts", F.lit(None).cast(NONE))
    else:
        match = F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))))
        hits = docs.select(F.xxhash64(text).alias("_key"), match.alias("match")).withColumn("kind", kind_of(F.col("match"))).withColumn("norm", normal(F.col("kind"), F.col("match")))
        hits = hits.join(attempts, ["kind", "norm"]).groupBy("_key").agg(F.map_from_entries(F.collect_set(F.struct(entity(F.col("kind"), F.col("norm")), "attempt"))).alias("_attempts"))
        rows = rows.withColumn("_key", F.xxhash64(text)).join(hits, "_key", "left")

    def rebuilt(matches: Column) -> Column:
        gaps = F.split(F.col(text), PATTERN, -1)
        new = F.concat(F.transform(matches, lambda m: surrogate(m, F.col("_attempts"))), F.array(F.lit("")))
        whole = F.array_join(F.zip_with(gaps, new, lambda a, b: F.concat(a, b)), "")
        return F.struct(F.when(F.size(matches) > 0, whole).otherwise(F.col(text)).alias("text"), F.transform(matches, kind_of).alias("kinds"))

    done = rows.withColumn("_new", let(F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0)), rebuilt))
    return done.select(*keep, F.when(F.col(text).isNotNull(), F.col("_new.text")).alias("surrogate_text"), F.coalesce("_new.kinds", F.array().cast("array<string>")).alias("kinds"))


def op10_surrogates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replaced(docs).select("doc_id", F.col("surrogate_text").alias("text"), F.size("kinds").cast("long").alias("n_entities"), "kinds")
