"""PII surrogates: detected entities get keyed replacements of the same type, gender, script and format.

A replacement depends on the key, the type and the entity's canonical form (case folded, separators removed), so every
mention of an entity in any document gets the same one, written in the mention's own format. Surrogates of a type are
compared with each other and with the real entities; those that collide are drawn again until all differ. Only a drawn
collision depends on what else is there: a ledger of earlier surrogates keeps them across batches.

Persons are found by a title. Their names are replaced part by part: a part has one made-up stem everywhere, whatever its
capitals, and takes the ending of its person's gender, so "Mr John Smith", "Mr Smith", "MRS SMITH" and, in a document
that names a Smith by a title, a bare "Smith" or "John Smith" stay recognisably the same or related, and different parts
stay different. Initials get another letter, particles ("van", "de") stay. A mention whose title tells no gender takes
that of a titled mention of the same document: of the whole name, else of the last part. A bare word that begins a
sentence and is an ordinary word too (ORDINARY) counts only next to another part of a name.

Not found: names that no title of the document introduces, dates of birth, addresses of places.
DataFrame functions only: no Python in the tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, dropped, let, stored, table

#: Titles and the gender that they tell ("" for none). Names follow in capitals, in Latin, Cyrillic or Greek script.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Prof": "", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}
#: Titles that stand in capitals too.
SHOUTED = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
TITLE = "|".join([*TITLES, *(t.upper() for t in SHOUTED)])
#: A part of a name: a capital and letters, inner capitals and all capitals too, after one letter with an apostrophe or none;
#: further parts behind a hyphen or apostrophe belong to it.
NAME = r"(?:\p{Lu}['’])?\p{Lu}\p{L}+(?:[-'’]\p{Lu}\p{L}+)*(?!\p{L})"
INITIALS = r"(?:\p{Lu}\. ?|\p{Lu} (?=\p{Lu}))"
INITIAL = r"(?:(?:\p{Lu}\.)+|\p{Lu})"
PARTICLE = r"(?:van|von|de|der|den|del|della|di|da|dos|du|des|la|le|ter|ten|zu|zur|af|av|bin|ibn|al|el)"
#: Ordinary words of the titles' languages that are names too.
ORDINARY = "will may mark bill frank art long short brown white black green gray grey young old king page wood stone hill field rich love day best price hope grace rose joy faith summer winter march june august west north south east more case guy chase cook gross klein lang kurz jung alt weiss schwarz braun koch bauer petit grand blanc noir bon blanco bueno rey luz paz sol".split()
#: Type -> pattern. The order is that of precedence where two could start at one place.
TYPES = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ipv6": r"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "ipv4": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9A-Za-z-])[3-6][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{3,4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z-])|(?<![0-9A-Za-z+])\+[0-9]{8,15}(?![0-9A-Za-z-])|(?<![0-9A-Za-z+])(?:0[1-9]|\+[0-9]{2,3}[ .-]?[1-9])(?:[ .-][0-9]{2}){4}(?![0-9A-Za-z-])",
    "person": rf"(?<!\p{{L}})(?:{TITLE})\.? {INITIALS}{{0,3}}(?:{PARTICLE} ){{0,3}}{NAME}(?: {INITIALS}{{0,2}}(?:{PARTICLE} ){{0,3}}{NAME}){{0,2}}",
}
PATTERN = "|".join(f"(?:{p})" for p in TYPES.values())
#: Any capitalised word: looked at in documents that name a person by a title.
BARE = rf"(?<!\p{{L}}){NAME}"
TITLED = rf"(?<!\p{{L}})(?:{TITLE})\.? (?:{PARTICLE} ){{0,3}}\p{{Lu}}"
#: A cheap test that every entity passes: an @, two digits with at most one sign between, two colons, or a title.
HINT = rf"@|[0-9][ .()-]?[0-9]|:[0-9A-Fa-f]{{0,4}}:|{TITLE}"
#: Syllables by script, and endings by script and gender; a made-up name part is three or four syllables and an ending.
SYLLABLES = {"latin": "ba be bo da de do fa ga ka ke la le lo ma me mi na ne no ra re ri ro sa se so ta te ti va vi".split(), "cyrillic": "ба бе во да де до ка ко ла ле ло ма ме ми на не но ра ре ри ро са се со та те ти ва ви за".split(), "greek": "βα γα γε δα δε θα κα κε λα λε λο μα με μι να νε νο πα πε ρα ρε ρι ρο σα σε σο τα τε τι φι".split()}
ENDINGS = {"latin": {"m": "n", "f": "na", "": "s"}, "cyrillic": {"m": "н", "f": "на", "": "с"}, "greek": {"m": "ν", "f": "να", "": "ς"}}
MAX_ROUNDS = 40
#: Up to so many entities with their surrogates are broadcast to the mentions.
BROADCAST_TEXTS = 200_000
#: The key that the query uses, which has no secret to keep: callers pass their own.
EXAMPLE_KEY = "an example, not a secret"
#: Rounds after which what is drawn grows, and the place of the numbers for it in an entity's stream.
GROW, SPARE = 2, 32


def kind_of(mention: Column) -> Column:
    return reduce(lambda c, k: c.when(mention.rlike(f"^(?:{TYPES[k]})$"), k), list(TYPES)[1:], F.when(mention.rlike(f"^(?:{TYPES['email']})$"), "email"))


def canonical(kind: Column, mention: Column) -> Column:
    """What mentions of one entity share: signs without separators, in lower case; a person's name without its title."""
    return F.when(kind.isin("ssn", "card", "phone"), F.regexp_replace(mention, "[^0-9]", "")).when(kind == "iban", F.regexp_replace(mention, " ", "")).when(kind == "person", F.regexp_replace(mention, rf"^(?:{TITLE})\.? ", "")).otherwise(F.lower(mention))


def _mod97(signs: Column) -> Column:
    """The remainder by 97 of the number that digits and letters (A = 10 to Z = 35) spell."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(signs, ""), F.lit(0), step)


def _turned(iban: Column) -> Column:
    return F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))


def valid(kind: Column, entity: Column) -> Column:
    """Whether the check sums of cards and bank accounts hold; what only looks like one stays as it is."""
    return F.when(kind == "card", _check_sum(entity, 1) % 10 == 0).when(kind == "iban", _mod97(_turned(entity)) == 1).otherwise(True)


def gender_of(mention: Column) -> Column:
    title = F.lower(F.regexp_extract(mention, r"^(\p{L}+)\.? ", 1))
    return reduce(lambda c, t: c.when(title == t.lower(), TITLES[t]), list(TITLES)[1:], F.when(title == "mr", "m")).otherwise("")


def part_of(word: Column) -> Column:
    """What the writings of a part of a name share: one capital, then small letters."""
    return F.concat(F.upper(F.substr(word, F.lit(1), F.lit(1))), F.lower(F.substr(word, F.lit(2))))


def parts_of(name: Column) -> Column:
    """The parts of a name in order; initials that touch one another are one part, and stand apart from what follows."""
    return F.filter(F.split(F.regexp_replace(name, r"(\p{Lu}\.)(?=\p{Lu}\p{L})", "$1 "), " "), lambda p: p != "")


def _stream(key: str, kind: Column, entity: Column, attempt: Column) -> Column:
    """Keyed numbers 0-255 for an entity: 64 of them, repeated where more are asked for."""
    bytes_ = lambda part: F.sha2(F.concat_ws("\u0000", F.lit(key), kind, entity, attempt.cast("string"), F.lit(part)), 256)
    return let(F.concat(bytes_("a"), bytes_("b")), lambda h: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int")))


def _drawn(signs: Column, r: Column, keep: int = 0) -> Column:
    """Signs with each digit and ASCII letter replaced by a drawn one of its class, but the first `keep`."""
    pick = lambda i: F.get(r, F.pmod(i, F.lit(64)))
    return F.array_join(F.transform(F.split(signs, ""), lambda c, i: F.when(i < keep, c).when(c.rlike("[0-9]"), F.pmod(pick(i) + F.ascii(c), F.lit(10)).cast("string")).when(c.rlike("[a-z]"), F.char(F.pmod(pick(i), F.lit(26)) + 97)).when(c.rlike("[A-Z]"), F.char(F.pmod(pick(i), F.lit(26)) + 65)).otherwise(c)), "")


def _hex(signs: Column, r: Column) -> Column:
    """Signs with each digit of a hexadecimal number replaced by a drawn one; a group does not get a leading zero."""
    digits = F.array(*(F.lit(x) for x in "123456789abcdef"))
    return F.array_join(F.transform(F.split(signs, ""), lambda c, i: F.when(c == ":", c).otherwise(F.get(digits, F.pmod(F.get(r, F.pmod(i, F.lit(64))), F.lit(15))))), "")


def _check_sum(body: Column, doubled: int) -> Column:
    """The sum of a card's digits from the right, those at odd or even places doubled and reduced to one digit."""
    twice = lambda c: F.when(c > 4, c * 2 - 9).otherwise(c * 2)
    return F.aggregate(F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(i % 2 == doubled, twice(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda a, x: a + x)


def _luhn(signs: Column) -> Column:
    """The digits with the last one changed so that the card's check sum holds."""
    body = F.substr(signs, F.lit(1), F.length(signs) - 1)
    return F.concat(body, F.pmod(-_check_sum(body, 0), F.lit(10)).cast("string"))


def _iban(signs: Column) -> Column:
    """The account with check digits that hold."""
    country, account = F.substr(signs, F.lit(1), F.lit(2)), F.substr(signs, F.lit(5))
    return F.concat(country, F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _stem(part: Column, r: Column, more: int = 0) -> Column:
    """A made-up stem of the part's script with `more` further syllables."""

    def one(s: str) -> Column:
        table_ = F.array(*(F.lit(x) for x in SYLLABLES[s]))
        syllable = lambda i: F.get(table_, F.pmod(F.get(r, F.lit(i)), F.lit(len(SYLLABLES[s]))))
        return F.initcap(F.concat(*(syllable(i) for i in (0, 1, 2)), F.when(F.get(r, F.lit(3)) % 2 == 0, syllable(4)).otherwise(""), *(syllable(SPARE + i) for i in range(more))))

    return F.when(_script(part) == "cyrillic", one("cyrillic")).when(_script(part) == "greek", one("greek")).otherwise(one("latin"))


def ending(part: Column, gender: Column) -> Column:
    by = lambda s: F.when(gender == "m", ENDINGS[s]["m"]).when(gender == "f", ENDINGS[s]["f"]).otherwise(ENDINGS[s][""])
    return F.when(_script(part) == "cyrillic", by("cyrillic")).when(_script(part) == "greek", by("greek")).otherwise(by("latin"))


def _surrogate(key: str, attempt: int) -> Column:
    """The draw of a round. Stems of names and the local parts of emails have one more syllable or letter every GROW
    rounds, and an email that collided gets another domain too, so there are enough of them for any number of entities."""
    kind, entity, more = F.col("kind"), F.col("entity"), attempt // GROW
    domain = F.substring_index(entity, "@", -1)

    def made(r: Column, rd: Column) -> Column:
        further = F.concat(F.lit(""), *(F.char(F.pmod(F.get(r, F.lit(SPARE + i)), F.lit(26)) + 97) for i in range(more)))
        email = F.concat(_drawn(F.substring_index(entity, "@", 1), r), further, F.lit("@"), _drawn(F.regexp_replace(domain, r"\.[^.]+$", ""), rd), F.lit("."), F.substring_index(domain, ".", -1))
        octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(F.get(r, i), F.when(i == 0, 223).otherwise(254)) + 1).cast("string")), ".")
        return F.when(kind == "email", email).when(kind == "ipv4", octets).when(kind == "card", _luhn(_drawn(entity, r, 1))).when(kind == "phone", _drawn(entity, r, 1)).when(kind == "iban", _iban(_drawn(entity, r, 2))).when(kind == "ipv6", _hex(entity, r)).when(kind == "part", _stem(entity, r, more)).otherwise(_drawn(entity, r))

    drawn = F.struct(_stream(key, kind, entity, F.lit(attempt)).alias("r"), _stream(key, F.lit("domain"), domain, F.lit(attempt)).alias("d"))
    return let(drawn, lambda s: made(s["r"], s["d"]))


def surrogates(entities: DataFrame, key: str, ledger: DataFrame | None = None) -> DataFrame:
    """(kind, entity, surrogate) for distinct entities (kind, entity); surrogates of a kind differ from each other and
    from every real entity. Of those that collide the first keeps its draw, the others draw again. Entities that the
    ledger (of the same columns) has keep theirs, and no other entity gets one that it has. kind "part" is a part of a
    person's name, and its surrogate a stem that no real part is, with any ending."""
    every = entities.select("kind", "entity")
    real = every if ledger is None else every.unionByName(ledger.select("kind", "entity")).distinct()
    ends = F.array(*(ending(F.col("entity"), F.lit(g)) for g in ("m", "f", "")))
    bare = F.explode(F.when(F.col("kind") == "part", F.transform(ends, lambda e: F.regexp_replace("entity", F.concat(e, F.lit("$")), ""))).otherwise(F.array("entity")))
    taken = stored(real.select("kind", bare.alias("surrogate")).distinct(), "taken")
    done = None if ledger is None else stored(ledger.select("kind", "entity", "surrogate").join(every, ["kind", "entity"], "left_semi"), "surrogates")
    if ledger is not None:
        taken = stored(taken.unionByName(ledger.select("kind", "surrogate")).distinct(), "taken")
    todo = stored(every if done is None else every.join(done, ["kind", "entity"], "left_anti"), "entities")
    for attempt in range(MAX_ROUNDS):
        drawn = todo.withColumn("surrogate", _surrogate(key, attempt))
        free = drawn.join(taken, ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = free.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity")).select("kind", "entity", "surrogate")
        done = stored(won if done is None else done.unionByName(won), "surrogates")
        before, todo = todo, stored(todo.join(done.select("kind", "entity"), ["kind", "entity"], "left_anti"), "entities")
        dropped(before)
        if todo.isEmpty():
            return done
    raise ValueError("too few surrogates of some kind for its entities")


def _written(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's format: separators stay in place, capitals stay capitals, titles stay."""
    signs = F.split(mention, "")
    put = F.aggregate(signs, F.struct(F.lit("").alias("t"), F.lit(0).alias("k")), lambda a, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct(F.concat(a["t"], F.substr(surrogate, a["k"] + 1, F.lit(1))).alias("t"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["t"], c).alias("t"), a["k"].alias("k"))), lambda a: a["t"])
    cased = F.array_join(F.zip_with(F.split(surrogate, ""), signs, lambda s, c: F.when(c.rlike("[A-Z]"), F.upper(s)).otherwise(s)), "")
    return F.when(kind == "ipv4", surrogate).when(kind == "ipv6", F.when(mention.rlike("[A-F]"), F.upper(surrogate)).otherwise(surrogate)).when(kind == "email", cased).otherwise(put)


def _key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text))


def _named(text: Column) -> Column:
    return F.coalesce(text.rlike(TITLED), F.lit(False))


def found_mentions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(th, i, mention, kind, entity, begins, joined) of each distinct text, in order. kind "bare" is a capitalised word of a
    text that names a person by a title; kind null is what only looks like an entity. begins: the mention begins a
    sentence; joined: only a blank is between it and the mention before."""
    text = F.col(text_col)
    both = f"{PATTERN}|{BARE}"
    hits = F.when(_named(text), F.regexp_extract_all(text, F.lit(both), F.lit(0))).when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    gaps = F.when(_named(text), F.transform(F.split(text, both, -1), lambda g: F.struct(g.rlike(r"^\s*$|[.!?:;…\n\"“”«»(]\s*$").alias("begins"), (g == " ").alias("joined"))))
    some = docs.select(_key(text).alias("th"), hits.alias("m"), gaps.alias("g")).where(F.size("m") > 0).dropDuplicates(["th"])
    each = some.select("th", "g", F.posexplode("m").alias("i", "mention"))
    gap = F.get("g", F.col("i"))
    each = each.select("th", "i", "mention", F.coalesce(gap["begins"] & ((F.col("i") == 0) | ~gap["joined"]), F.lit(False)).alias("begins"), F.coalesce(gap["joined"], F.lit(False)).alias("joined"))
    kind = F.when(F.col("mention").rlike(f"^{NAME}$"), "bare").otherwise(F.coalesce(kind_of(F.col("mention")), F.lit("phone")))
    each = each.withColumn("kind", kind).withColumn("entity", F.when(F.col("kind") == "bare", part_of(F.col("mention"))).otherwise(canonical(F.col("kind"), F.col("mention"))))
    return each.withColumn("kind", F.when(valid(F.col("kind"), F.col("entity")), F.col("kind")))


def persons(each: DataFrame) -> DataFrame:
    """(th, i, mention, entity, gender): titled and bare mentions of persons, entity being the name without its title. The
    gender is the title's; without one, that of the first titled mention of the text with the same name, else of the
    first with the same last part. A bare word counts if a titled mention of its text has it as a part; an ordinary word
    that begins a sentence only if such a part follows it at once."""
    titled = each.where("kind = 'person'").withColumn("gender", gender_of(F.col("mention"))).withColumn("parts", F.transform(F.filter(parts_of(F.col("entity")), lambda p: p.rlike(r"^\p{Lu}['’]?\p{L}")), part_of)).withColumn("name", F.array_join("parts", " "))
    first = lambda d, k: d.groupBy("th", k).agg(F.min_by("gender", F.when(F.col("gender") != "", F.col("i"))).alias(f"by_{k}"))
    parts = first(titled.select("th", "i", "gender", F.explode("parts").alias("last")), "last")
    names = first(titled.select("th", "i", "gender", "name"), "name")
    own = titled.withColumn("last", F.element_at("parts", -1)).join(names, ["th", "name"]).join(parts, ["th", "last"])
    own = own.select("th", "i", "mention", "entity", F.when(F.col("gender") != "", F.col("gender")).otherwise(F.coalesce("by_name", "by_last", F.lit(""))).alias("gender"))
    bare = each.where("kind = 'bare'").withColumn("last", F.col("entity")).join(parts, ["th", "last"])
    after = bare.select("th", (F.col("i") - 1).alias("i"), F.col("joined").alias("_next"))
    doubtful = F.col("begins") & F.lower("entity").isin(ORDINARY) & ~F.coalesce("_next", F.lit(False))
    bare = bare.join(after, ["th", "i"], "left").where(~doubtful)
    return own.unionByName(bare.select("th", "i", "mention", F.col("mention").alias("entity"), F.coalesce("by_last", F.lit("")).alias("gender")))


def anonymised(docs: DataFrame, key: str, text_col: str = "text", ledger: DataFrame | None = None) -> DataFrame:
    """docs with text_col rewritten, and pii_mentions, pii_kinds (distinct kinds, sorted) added; columns of those two
    names are replaced, all others stay.

    Mentions of one entity get one surrogate wherever they stand, other entities of its kind other ones. A null text
    stays null and an empty one empty; texts without an entity stay as they are, byte for byte; repeated rows are
    rewritten alike (texts are matched by a 128-bit hash); card and bank account numbers count only if their check sums
    hold, and their surrogates' hold too; an empty table gives an empty result. The key must be kept secret: with it
    surrogates can be told. ledger: what surrogates_of gave for earlier batches.
    """
    return _anonymised(docs, key, text_col, ledger)[0]


def surrogates_of(docs: DataFrame, key: str, text_col: str = "text", ledger: DataFrame | None = None) -> DataFrame:
    """(kind, entity, surrogate) of all entities in docs, to be stored as the ledger of later batches. It names real
    entities: keep it as secret as the texts."""
    return _anonymised(docs, key, text_col, ledger)[1]


def _anonymised(docs: DataFrame, key: str, text_col: str, ledger: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    kept = [c for c in docs.columns if c not in ("pii_mentions", "pii_kinds")]
    text = F.col(text_col)
    each = stored(found_mentions(docs, text_col), "mentions")
    split = persons(each).select("th", "i", "mention", F.col("entity").alias("name"), "gender", F.posexplode(parts_of(F.col("entity"))).alias("k", "word"))
    people = stored(split.withColumn("entity", F.when(F.col("word").rlike(rf"^(?:{INITIAL}|{PARTICLE})$"), F.lit(None).cast("string")).otherwise(part_of(F.col("word")))), "persons")
    things = stored(each.where("kind NOT IN ('person', 'bare')").select("mention", "kind", "entity").distinct(), "things")
    named = surrogates(things.select("kind", "entity").union(people.where("entity IS NOT NULL").select(F.lit("part"), "entity")).distinct(), key, ledger)
    small = F.broadcast if named.count() <= BROADCAST_TEXTS else lambda d: d  # an entity may be in most documents
    written = things.join(named, ["kind", "entity"]).select("mention", "kind", _written(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("put"))
    stems = named.where("kind = 'part'").select("entity", "surrogate")
    made = F.concat("surrogate", ending(F.col("entity"), F.col("gender")))
    shouted = (F.upper("word") == F.col("word")) & (F.length("word") > 1)
    drawn = lambda c: F.substr(_stem(c, _stream(key, F.lit("initial"), c, F.lit(0))), F.lit(1), F.lit(1))
    letter = F.array_join(F.transform(F.split("word", ""), lambda c: F.when(c == ".", c).otherwise(drawn(c))), "")
    part = F.when(F.col("surrogate").isNotNull(), F.when(shouted, F.upper(made)).otherwise(made)).when(F.col("word").rlike(f"^{INITIAL}$"), letter).otherwise(F.col("word"))
    whole = people.join(small(stems), "entity", "left").withColumn("part", part)
    title = F.regexp_extract("mention", rf"^((?:{TITLE})\.? )", 1)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), " ")
    told = whole.groupBy("th", "i", "mention", "name").agg(joined.alias("made")).select("th", "i", F.lit("person").alias("kind"), F.concat(F.when(F.col("name") == F.col("mention"), "").otherwise(title), "made").alias("put"))
    puts = each.where("kind NOT IN ('person', 'bare')").select("th", "i", "mention", "kind").join(small(written), ["mention", "kind"]).select("th", "i", "kind", "put").unionByName(told)
    put = F.struct("i", F.coalesce("put", F.col("mention")).alias("put"))  # what only looks like an entity stays
    lists = each.select("th", "i", "mention").join(puts, ["th", "i"], "left").groupBy("th").agg(F.transform(F.sort_array(F.collect_list(put)), lambda x: x["put"]).alias("_put"), F.sort_array(F.collect_set("kind")).alias("_kinds"), F.count("kind").alias("_n"))
    lists = stored(lists.where("_n > 0"), "lists")
    for used in (each, people, things):
        dropped(used)
    few = lists.count() <= BROADCAST_IDS
    lists = lists.withColumnsRenamed({"th": "_pii_key", "_put": "_pii_put", "_kinds": "_pii_kinds", "_n": "_pii_n"})
    ids = lists.select("_pii_key")
    base = docs.select(*kept).withColumn("_pii_key", _key(text))
    has = base.join(F.broadcast(ids) if few else ids, "_pii_key", "left_semi").join(lists, "_pii_key")
    between = F.when(_named(text), F.split(text, f"{PATTERN}|{BARE}", -1)).otherwise(F.split(text, PATTERN, -1))
    joined = F.array_join(F.flatten(F.zip_with(between, F.col("_pii_put"), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    rewritten = has.withColumns({text_col: joined, "pii_mentions": F.col("_pii_n"), "pii_kinds": F.col("_pii_kinds")})
    plain = base.join(F.broadcast(ids) if few else ids, "_pii_key", "left_anti").withColumns({"pii_mentions": F.lit(0).cast("bigint"), "pii_kinds": F.array().cast("array<string>")})
    columns = [*kept, "pii_mentions", "pii_kinds"]
    return plain.select(*columns).unionByName(rewritten.select(*columns)), named


def op4_pii_surrogates(spark, sf_dir):
    return anonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), EXAMPLE_KEY)
