"""Names as keys: folding, core names, sort names, initials."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and the plain letter of each, and letters that are written with others.
MARKED = "àáâãäåāăąçćĉčċďèéêëēĕėęěĝğġģĥìíîïĩīĭįıĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"
WRITTEN = {"đ": "d", "ø": "o", "ł": "l", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ß": "ss"}
#: Words of team names that do not tell teams apart.
STOP = "fc afc cf cfc ac acf as ss ssc sc us usd ud sd cd rcd ca rc calcio club football futbol associazione sportiva societa spa ssd tsv vfb vfl sv fsv bsc".split()
#: Legal forms that sorting and display names leave out at the ends of a name.
LEGAL = "fc afc cf cfc ac acf as ss ssc sc us usd ud sd cd rcd ca rc ad aj es og ogc usl sco osc af fco calcio club football futbol foot ball sport balompie associazione sportiva societa unione de di en avant centre esports alsace herault spa ssd tsv vfb vfl sv fsv bsc bc spvgg tsg".split()
#: Display names that stay whole.
KEEP_WHOLE = ["Athletic Club", "Paris FC", "FC Lyon", "Hamburger SV", "Karlsruher SC"]


def _folded(s: Column) -> Column:
    """Lower case without combining marks, letters with marks as plain ones."""
    return F.translate(F.regexp_replace(F.lower(s), r"\p{Mn}", ""), MARKED, PLAIN)


def _tidy(s: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9 ]+", " "), " +", " "))


def search_name(s: Column) -> Column:
    """The key that searches compare: transliterated, folded, signs as single blanks."""
    low = F.lower(s)
    for a, b in WRITTEN.items():
        low = F.replace(low, F.lit(a), F.lit(b))
    return _tidy(_folded(low))


def core_name(s: Column, stop: list[str] = STOP) -> Column:
    """A team's name without marks, stop words and founding years; letters without a plain form vanish."""
    folded = F.regexp_replace(_folded(s), r"[^\x00-\x7F]", "")
    w = F.split(_tidy(folded), " ")
    return F.array_join(F.filter(w, lambda x: ~x.isin(stop) & ~x.rlike("^(18|19|20)[0-9]{2}$")), " ")


def initials(s: Column) -> Column:
    """First letters of the words of more than two letters of the search name."""
    return F.array_join(F.transform(F.filter(F.split(search_name(s), " "), lambda x: F.length(x) > 2), lambda x: F.substr(x, F.lit(1), F.lit(1))), "")


def _droppable(word: Column) -> Column:
    return word.isin(LEGAL) | (F.length(word) == 1) | word.rlike("^[0-9]+$")


def sort_name(s: Column) -> Column:
    """The search name from its first word that is no legal form, single sign or number; the last word always stays."""
    w = F.split(search_name(s), " ")
    first = F.array_position(F.transform(w, lambda x: ~_droppable(x)), True)
    return F.array_join(F.slice(w, F.when(first > 0, first).otherwise(F.size(w)).cast("int"), F.size(w)), " ")


def core_display(name: Column) -> Column:
    """The name as written without legal words at both ends, at least one word; some names stay whole."""
    w = F.split(name, " ")

    def legal(word: Column) -> Column:
        parts = F.filter(F.split(search_name(word), " "), lambda x: x != "")
        return (F.size(parts) > 0) & F.forall(parts, _droppable)

    real = F.transform(w, lambda x: ~legal(x))
    first = F.array_position(real, True)
    last = F.size(w) + 1 - F.array_position(F.reverse(real), True)
    cut = F.when(first > 0, F.slice(w, first.cast("int"), (last - first + 1).cast("int"))).otherwise(F.slice(w, F.size(w), F.lit(1)))
    return F.when(name.isin(KEEP_WHOLE), name).otherwise(F.array_join(cut, " "))


def dotted_initials(name: Column) -> Column:
    """"J. S." for "John Smith"."""
    return F.array_join(F.transform(F.filter(F.split(name, " "), lambda x: x != ""), lambda x: F.concat(F.substr(x, F.lit(1), F.lit(1)), F.lit("."))), " ")


def image_key(tail: Column) -> Column:
    """Two hexadecimal digits of the file name's MD5 and the name: percent codes decoded, blanks as underscores."""
    f = F.replace(F.url_decode(F.replace(tail, F.lit("+"), F.lit("%2B"))), F.lit(" "), F.lit("_"))
    return F.concat(F.substr(F.md5(f), F.lit(1), F.lit(2)), f)


def flag(cc: Column, parts: dict[str, str] | None = None) -> Column:
    """The flag of a two-letter country code as two regional letters, empty for an unknown one. parts: codes that are
    shown as another flag text, as a part of a country is for teams and leagues."""
    letter = lambda k: F.get(F.array(*(F.lit(chr(0x1F1E6 + i)) for i in range(26))), F.ascii(F.substr(F.upper(cc), F.lit(k), F.lit(1))) - 65)
    own = F.when(cc.rlike("^[A-Za-z]{2}$"), F.concat(letter(1), letter(2))).otherwise("")
    for code, text in (parts or {}).items():
        own = F.when(cc == code, text).otherwise(own)
    return own


def thumbnail(key: Column, base: str, width: int = 120) -> Column:
    """The address of an image's thumbnail from its image key: vector images as .png, scans and documents as .jpg. Names
    are coded as browsers code a part of a path, which leaves ! ' ( ) ~ as they are."""
    prefix, name = F.substr(key, F.lit(1), F.lit(2)), F.substring(key, 3, 1 << 20)
    coded = F.url_encode(name)
    for code, sign in {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}.items():
        coded = F.replace(coded, F.lit(code), F.lit(sign))
    low = F.lower(name)
    page, tail = F.when(low.rlike("[.](tiff?|pdf)$"), F.when(low.rlike("[.]pdf$"), "page1-").otherwise("lossy-page1-")).otherwise(""), F.when(low.rlike("[.]svg$"), ".png").when(low.rlike("[.](tiff?|pdf)$"), ".jpg").otherwise("")
    return F.when(F.length(key) > 2, F.concat(F.lit(base), F.lit("/"), F.substr(prefix, F.lit(1), F.lit(1)), F.lit("/"), prefix, F.lit("/"), coded, F.lit("/"), page, F.lit(f"{width}px-"), coded, tail))
