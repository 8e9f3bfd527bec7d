"""Surrogates for personal data: keyed, consistent with type, gender, script and format, and distinct (native).

Method. E-mail addresses, IPv4 addresses, telephone numbers, payment card numbers (Luhn-valid) and names are found in whole texts. A name
is recognised behind a title (in capitals too, with initials, particles, hyphens and apostrophes); every further mention of one of its
words in the same text is the same person, with or without a title. Each distinct entity (type and canonical form) gets a surrogate from
SHA-256 over a secret key, type, canonical form and attempt: digits for digits, letters for letters of the same script, card numbers
with a valid check digit, address octets in range, given names with an ending of their gender. Surrogates that equal a real entity, or
that another entity of the type owns, are drawn again with the next attempt until all are distinct. From attempt `ROOMY` on every
attempt lengthens the form, so that the draw ends however many entities use up the forms of their own length. The same entity has the same
surrogate everywhere (coreference, also across spelling in capitals or with other separators, and between a full name and its family
name alone), and a surrogate is written in the format of the place: case, separators and brackets stay.

Texts without an entity pass unchanged and unshuffled. Entities are counted once before the draw; nothing is collected. Tables written on
the way hold keyed digests and the shapes of entities (which places are digits or letters), never an entity or a text.

Defined results: null and empty texts stay as they are; repeated rows are replaced alike; empty tables give empty results; other
columns are kept, but for one named n_surrogates, which the count replaces. Initials get a keyed letter and need not be distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfline.functions.text import let
from shelfline.llm.common import stored
from shelfline.session import evaluate_once

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
IPV4 = rf"(?<![\w.]){OCTET}(?:\.{OCTET}){{3}}(?!\w|\.[0-9])"
#: Telephone numbers: with a country code and 8 to 15 digits; with a leading zero, in groups, and 9 to 11 digits; in groups of 3, 3 and 4.
PHONE = "|".join([
    r"(?<![\w+])\+(?=(?:[ .\-()]{0,2}[0-9]){8,15}(?![0-9]))[0-9]{1,3}(?:[ .\-]?\(?[0-9]{1,4}\)?){2,6}(?!\w)",
    r"(?<![\w.,\-])\(?0(?=(?:[ .\-/)]{0,2}[0-9]){8,10}(?![0-9]|[ .\-/][0-9]))[0-9]{1,4}\)?(?:[ .\-/][0-9]{2,5}){1,4}(?!\w)",
    r"(?<![\w.,\-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![\w]|[.,\-][0-9])"])
CARD = r"(?<![\w])[0-9](?:[ \-]?[0-9]){12,18}(?!\w)"
#: Titles before names, and the gender that they tell (fixed values).
MALE_TITLES = ["Mr", "Sir", "Herr", "Señor", "Monsieur", "Г-н", "Господин"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mme", "Mlle", "Г-жа", "Госпожа"]
OTHER_TITLES = ["Dr", "Prof", "Professor", "Доктор", "Профессор"]
PARTICLES = "van|von|der|den|de|del|della|da|di|du|la|le|bin|al"


def _any_case(titles: list[str]) -> list[str]:
    return titles + [t.upper() for t in titles]


ALL_TITLES = sorted(_any_case(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES), key=len, reverse=True)
#: The first letters come first, so that most places need one look.
TITLE = rf"(?=[{''.join(sorted({t[0] for t in ALL_TITLES}))}])(?:{'|'.join(ALL_TITLES)})\.? "
NAME_WORD = r"(?:\p{Lu}\p{Ll}+(?:\p{Lu}\p{Ll}+)?|\p{Lu}{2,}|\p{Lu}(?=['’\-]\p{L}))(?:['’\-]\p{L}+)*"
NAME = rf"(?<![\p{{L}}\p{{N}}]){TITLE}(?:\p{{Lu}}\. ?){{0,3}}{NAME_WORD}(?: (?:(?:{PARTICLES}) ){{0,2}}(?:\p{{Lu}}\. )?{NAME_WORD}){{0,2}}(?!\p{{L}})"
ENTITY = "|".join([EMAIL, IPV4, PHONE, CARD, NAME])
#: Every entity has a digit, an at sign or a title; most texts have none of these and need no more than this cheap look.
HINT = rf"[0-9]|(?<![\p{{L}}\p{{N}}]){TITLE}"
#: Pieces of a name: words and initials; particles and signs between them stay.
PIECE = rf"(?<!\p{{L}})(?!(?:{PARTICLES})(?!\p{{L}}))\p{{L}}+\.?"
#: Syllables and endings of made-up names, by script (fixed values).
SYLLABLES = {"latin": ["bel", "cor", "dan", "fen", "gal", "hol", "jor", "kel", "lam", "mar", "nor", "pal", "ros", "sal", "tor", "ven"],
             "cyrillic": ["бел", "вор", "гал", "дан", "зор", "кал", "лад", "мар", "нов", "пол", "рад", "сев", "тар", "фед", "хар", "чер"]}
ENDINGS = {"latin": {"m": "is", "f": "a", "n": "en", "family": "er"}, "cyrillic": {"m": "ан", "f": "а", "n": "ий", "family": "ов"}}
KEY = "surrogate key for tests and registered queries"
HEX_CHARS = 64
#: From this attempt on forms are lengthened.
ROOMY = 3


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits; a valid number gives a multiple of ten."""
    figures = F.reverse(F.split(digits, ""))
    doubled = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.transform(F.transform(figures, lambda c: c.cast("int")), doubled), F.lit(0), lambda a, b: a + b)


def has_entity(text: Column) -> Column:
    return F.coalesce((text.contains("@") | text.rlike(HINT)) & text.rlike(ENTITY), F.lit(False))


def without_title(name: Column) -> Column:
    return F.regexp_replace(name, rf"^{TITLE}", "")


def pieces(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit(PIECE), F.lit(0))


def name_type(piece: Column, last: Column, title: Column) -> Column:
    """Type of a piece of a name: script, and family, gender or initial."""
    word = F.regexp_replace(title, r"[. ]+$", "")
    gender = F.when(word.isin(_any_case(MALE_TITLES)), "m").when(word.isin(_any_case(FEMALE_TITLES)), "f").otherwise("n")
    role = F.when(piece.endswith("."), "initial").when(last, "family").otherwise(gender)
    return F.concat(F.when(piece.rlike(r"^\p{IsCyrillic}"), "cyrillic").otherwise("latin"), F.lit("-"), role)


def known_words(found: Column) -> Column:
    """(word, type) of the names that titles introduce among the entities of a text; a word with several roles has the first of them."""
    def typed(name: Column) -> Column:
        title = F.regexp_extract(name, rf"^{TITLE}", 0)
        return let(pieces(without_title(name)), lambda words: F.transform(words, lambda p, i: F.struct(
            F.lower(p).alias("word"), name_type(p, i == F.size(words) - 1, title).alias("type"))))

    names = F.filter(found, lambda v: v.rlike(rf"^{TITLE}"))
    words = F.filter(F.flatten(F.transform(names, typed)), lambda w: (F.char_length(w["word"]) > 1) & ~w["word"].endswith("."))
    return let(F.array_sort(F.array_distinct(words)), lambda all_words: F.filter(all_words, lambda w, i: (i == 0) | (F.get(all_words, i - 1)["word"] != w["word"])))


def pattern_of(known: Column) -> Column:
    """The entities of a text and further mentions of the names in it."""
    words = F.array_join(F.flatten(F.transform(known, lambda w: F.array(F.initcap(w["word"]), F.upper(w["word"])))), "|")
    return F.concat(F.lit(ENTITY + r"|(?<![\p{L}\p{N}])(?:"), words, F.lit(r")(?![\p{L}\p{N}])"))


def suspects(docs: DataFrame) -> DataFrame:
    """Rows with an entity: the row, its digest, the names known in it, all matches and the text between them."""
    rows = docs.filter(has_entity(F.col("text"))).select(F.struct(*docs.columns).alias("row"))
    # every step is evaluated once per row
    rows = evaluate_once(rows, ["row"], {"of_row": F.sha2(F.to_json("row"), 256), "first": F.regexp_extract_all("row.text", F.lit(ENTITY), F.lit(0))})
    rows = evaluate_once(rows, ["row", "of_row", "first"], {"known": known_words(F.col("first"))})
    # most texts have no name, and their matches are known already
    alone = F.size("known") == 0
    rows = evaluate_once(rows, ["row", "of_row", "first", "known"], {"pattern": F.when(~alone, pattern_of(F.col("known")))})
    return evaluate_once(rows, ["row", "of_row", "known"], {
        "found": F.when(alone, F.col("first")).otherwise(F.regexp_extract_all("row.text", F.col("pattern"), F.lit(0))),
        "gaps": F.when(alone, F.split("row.text", ENTITY, -1)).otherwise(F.split("row.text", F.col("pattern"), -1))})


def digest(key: str, kind: Column, canonical: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canonical), 256)


def entity_parts(found: DataFrame, key: str) -> DataFrame:
    """One row per part of every match of a suspect row: of_row, k (number of the match), part, type, id (keyed digest of the canonical form),
    shape, and the value itself, which is not to be written."""
    rows = found.select("of_row", "known", F.posexplode("found").alias("k", "value"))
    title = F.regexp_extract("value", rf"^{TITLE}", 0)
    plain = F.regexp_replace("value", "[^0-9]", "")
    kind = (F.when(F.col("value").contains("@"), "email").when(F.col("value").rlike(rf"^{OCTET}(\.{OCTET}){{3}}$"), "ipv4").when(title != "", "name")
            .when(F.col("value").rlike(r"^\p{L}"), "mention").when(F.col("value").rlike(rf"^(?:{PHONE})$"), "phone").when(luhn_sum(plain) % 10 == 0, "card"))
    typed = rows.select("of_row", "known", "k", "value", title.alias("title"), plain.alias("digits"), kind.alias("kind")).filter("kind IS NOT NULL")
    parts = F.when(F.col("kind") == "name", pieces(without_title(F.col("value")))).otherwise(F.array("value"))
    typed = typed.withColumn("n", F.size(parts)).select("*", F.posexplode(parts).alias("part", "piece"))
    # a word that the text knows has one role in all its mentions
    own = F.get(F.filter("known", lambda w: w["word"] == F.lower(F.col("piece"))), F.lit(0))["type"]
    named = F.coalesce(own, name_type(F.col("piece"), F.col("part") == F.col("n") - 1, F.col("title")))
    of_name = F.col("kind").isin("name", "mention")
    canonical = F.when(of_name | F.col("kind").isin("email", "ipv4"), F.lower("piece")).otherwise(F.col("digits"))
    cut = typed.select("of_row", "k", "part", F.col("piece").alias("value"), F.when(of_name, named).otherwise(F.col("kind")).alias("type"), canonical.alias("canonical"))
    # what a surrogate takes over from the entity: the places of letters and digits, a top-level domain, a number's first digit
    masked = F.regexp_replace(F.regexp_replace("canonical", "[0-9]", "0"), "[a-z]", "a")
    domain = F.regexp_extract("canonical", r"\.[a-z]+$", 0)
    shape = (F.when(F.col("type") == "email", F.concat(F.substr(masked, F.lit(1), F.char_length("canonical") - F.char_length(domain)), domain))
             .when(F.col("type") == "ipv4", masked).when(F.col("type").isin("phone", "card"), F.concat(F.left("canonical", F.lit(1)), F.substr(masked, F.lit(2))))
             .otherwise(""))
    return cut.select("of_row", "k", "part", "type", digest(key, F.col("type"), F.col("canonical")).alias("id"), shape.alias("shape"), "value")


def surrogate(key: str) -> tuple[Column, Column]:
    """Surrogate in canonical form from type, id, shape, attempt and the drawn digits (column hex); those digits."""
    seed = F.concat_ws("\x1f", F.lit(key), F.col("type"), F.col("id"), F.col("attempt").cast("string"))
    number = lambda i: F.conv(F.substr(F.col("hex"), (i * 4) % (4 * HEX_CHARS - 4) + 1, F.lit(4)), 16, 10).cast("int")
    letters = F.lit("abcdefghijklmnopqrstuvwxyz")
    letter = lambda i: F.substr(letters, number(i) % 26 + 1, F.lit(1))
    digit = lambda i: (number(i) % 10).cast("string")
    drawn = lambda c, i: F.when(c == "0", digit(i)).when(c == "a", letter(i)).otherwise(c)
    # more places with every attempt, so there is always room
    places = F.slice(F.sequence(F.lit(0), F.greatest(F.col("attempt") - ROOMY + 1, F.lit(0))), F.lit(2), F.greatest(F.col("attempt"), F.lit(1)))
    more = lambda one: F.array_join(F.transform(places, lambda i: one(i + 40)), "")
    signs = F.split("shape", "")
    kept = F.char_length("shape") - F.char_length(F.regexp_extract("shape", r"\.[a-z]+$", 0))
    email = F.concat(more(letter), F.array_join(F.transform(signs, lambda c, i: F.when(i < kept, drawn(c, i)).otherwise(c)), ""))
    octet = lambda o, i: (F.when(F.col("attempt") >= ROOMY, number(i) % 254 + 1).when(F.char_length(o) == 1, number(i) % 9 + 1)
                          .when(F.char_length(o) == 2, number(i) % 90 + 10).otherwise(number(i) % 156 + 100).cast("string"))
    # beyond the room of all addresses another octet follows
    ipv4 = F.concat(F.array_join(F.transform(F.split("shape", r"\."), octet), "."), F.when(F.col("attempt") > 4 * ROOMY, F.concat(F.lit("."), more(digit))).otherwise(""))
    phone = F.concat(F.array_join(F.transform(signs, lambda c, i: F.when(i == 0, c).otherwise(drawn(c, i))), ""), more(digit))
    body = F.concat(F.array_join(F.transform(F.slice(signs, F.lit(1), F.size(signs) - 1), lambda c, i: F.when(i == 0, c).otherwise(drawn(c, i))), ""), more(digit))
    card = F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    chosen = F.when(F.col("type") == "email", email).when(F.col("type") == "ipv4", ipv4).when(F.col("type") == "phone", phone).when(F.col("type") == "card", card)
    for script, syllables in SYLLABLES.items():
        table = F.array(*map(F.lit, syllables))
        stem = F.array_join(F.transform(F.sequence(F.lit(0), F.col("attempt") + 2), lambda i: F.get(table, number(i) % len(syllables))), "")
        for role, ending in ENDINGS[script].items():
            chosen = F.when(F.col("type") == f"{script}-{role}", F.concat(stem, F.lit(ending))).otherwise(chosen)
        first = F.lit("abcdefghijklmnoprstuvwyz" if script == "latin" else "абвгдезиклмнопрстуфх")
        chosen = F.when(F.col("type") == f"{script}-initial", F.concat(F.substr(first, number(F.lit(0)) % 20 + 1, F.lit(1)), F.lit("."))).otherwise(chosen)
    return chosen, F.concat(*[F.sha2(F.concat(seed, F.lit(f"\x1f{i}")), 256) for i in range(4)])


def with_surrogates(rows: DataFrame, key: str) -> DataFrame:
    """Adds the surrogate of the attempt and the id that a real entity of that form would have."""
    chosen, drawn = surrogate(key)
    return rows.withColumn("hex", drawn).withColumn("surrogate", chosen).drop("hex").withColumn("as_real", digest(key, F.col("type"), F.col("surrogate")))


def assign(found: DataFrame, key: str) -> DataFrame:
    """type, id, surrogate: one row per distinct entity, surrogates distinct within a type (initials apart) and never a real entity."""
    distinct = stored(found.groupBy("type", "id").agg(F.min("shape").alias("shape")), "entities")
    initial = F.col("type").endswith("-initial")
    real = distinct.select(F.col("id").alias("real_id"))
    free_form = with_surrogates(distinct.filter(initial).withColumn("attempt", F.lit(0)), key).select("type", "id", "surrogate")
    settled = None
    drawn = stored(with_surrogates(distinct.filter(~initial).withColumn("attempt", F.lit(0)), key), "surrogates")
    while True:
        # a free surrogate goes to the first of those that drew it; owners of earlier rounds keep theirs
        free = drawn.join(real, F.col("as_real") == F.col("real_id"), "left_anti")
        if settled is not None:
            owned = settled.select(F.col("type").alias("o_type"), F.col("surrogate").alias("o_value"))
            free = free.join(owned, (F.col("type") == F.col("o_type")) & (F.col("surrogate") == F.col("o_value")), "left_anti")
        won = free.groupBy("type", "surrogate").agg(F.min("id").alias("id")).select("type", "id", "surrogate")
        settled = stored(won if settled is None else settled.unionByName(won), "settled")
        rest = drawn.join(settled.select("type", "id"), ["type", "id"], "left_anti").select("type", "id", "shape", (F.col("attempt") + 1).alias("attempt"))
        drawn = stored(with_surrogates(rest, key), "surrogates")
        if drawn.isEmpty():
            return settled.unionByName(free_form)


def written(value: Column, own: Column, kind: Column) -> Column:
    """The surrogate in the format of the value: its letters and digits in turn, case and other signs from the value. Surrogates that
    have another length than the value (names, lengthened forms) take its capitals only."""
    sign = r"[\p{L}\p{N}]"
    signs, values = F.regexp_extract_all(own, F.lit(sign), F.lit(0)), F.split(value, "")
    cased = lambda c, s: F.when(c.rlike(r"\p{Lu}"), F.upper(s)).otherwise(s)
    in_place = F.array_join(F.transform(values, lambda c, i: F.when(c.rlike(sign), cased(c, F.get(signs, F.size(F.filter(
        F.slice(values, F.lit(1), i), lambda p: p.rlike(sign)))))).otherwise(c)), "")
    same = F.regexp_count(value, F.lit(sign)) == F.size(signs)
    capital = F.when(value.rlike(r"^\p{Lu}{2,}$"), F.upper(own)).when(value.rlike(r"^\p{Lu}"), F.initcap(own)).otherwise(own)
    return F.when(kind.contains("-"), capital).when(same, in_place).otherwise(own)


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with surrogates in their texts, and n_surrogates."""
    columns = [c for c in docs.columns if c.lower() != "n_surrogates"]
    docs = docs.select(*columns)
    rows = suspects(docs)
    found = stored(entity_parts(rows, key).drop("value").distinct(), "entity-places")
    pairs = assign(found, key).withColumnsRenamed({"type": "s_type", "id": "s_id"})
    named = found.join(pairs, (F.col("type") == F.col("s_type")) & (F.col("id") == F.col("s_id")))
    places = named.groupBy("of_row", "k").agg(F.sort_array(F.collect_list(F.struct("part", "surrogate", "type"))).alias("news"))
    texts = places.groupBy(F.col("of_row").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("k", "news"))).alias("news"))
    joined = rows.join(texts, F.col("of_row") == F.col("of"), "left").select("row", "news", "found", "gaps")

    def replaced(value: Column, news: Column) -> Column:
        title = F.regexp_extract(value, rf"^{TITLE}", 0)
        rest = without_title(value)
        own = F.zip_with(pieces(rest), news, lambda piece, new: written(piece, new["surrogate"], new["type"]))
        of_name = F.array_join(F.flatten(F.zip_with(F.split(rest, PIECE, -1), F.concat(own, F.array(F.lit(""))), lambda gap, word: F.array(gap, word))), "")
        return F.when(title != "", F.concat(title, of_name)).otherwise(written(value, news[0]["surrogate"], news[0]["type"]))

    values = F.transform("found", lambda v, k: F.coalesce(replaced(v, F.element_at("news", k)), v))
    text = F.array_join(F.flatten(F.zip_with("gaps", F.concat(values, F.array(F.lit(""))), lambda gap, value: F.array(gap, value))), "")
    changed = joined.select(*[F.when(F.col("news").isNull(), F.col("row.text")).otherwise(text).alias(c) if c == "text" else F.col("row")[c].alias(c) for c in columns],
                            F.coalesce(F.size(F.map_keys("news")), F.lit(0)).cast("long").alias("n_surrogates"))
    return docs.filter(~has_entity(F.col("text"))).withColumn("n_surrogates", F.lit(0).cast("long")).unionByName(changed)
