"""Phrases of people, bodies and things: plain forms, stems, heads, cleaning by rules and coordination, in built-in expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of Dutch phrases: words before which a head ends, words between a head and its complement, and words without content.
PREPOSITIONS = ("van", "voor", "in", "op", "met", "tot", "aan", "bij", "over", "onder", "uit", "door", "tegen", "naar", "als", "om", "binnen", "ten", "ter")
AFTER_HEAD = ("verder", "zelf", "zelve", "alleen", "samen", "gezamenlijk", "daarvan")
FUNCTION_WORDS = ("de", "het", "een", "der", "des", "en", "of", "en/of", "die", "dat", "dit", "deze", "hun", "zijn", "haar", "te", *PREPOSITIONS)
#: What opens a complement, what joins coordinated heads, and determiners.
POSTMODIFIERS = ("van", "voor", "met", "die", "dat", "in", "op", "uit", "bij", "onder", "als", "zoals", "welke", "waarop", "waarvan", "aan", "tot", "binnen", "krachtens", "overeenkomstig", "inzake", "namens", "door", "om")
COORDINATORS = ("en", "of", "en/of")
DETERMINERS = ("de", "het", "een", "elke", "elk", "ieder", "iedere", "alle", "al", "deze", "die", "dit", "dat", "dergelijke", "zo'n", "zo’n", "hun", "zijn", "haar", "diens", "wiens", "welke")
#: Fixed values of the rules that clean an actor: leading words, pronouns, inserted phrases, words that open a relative clause.
LEADING = ("de", "het", "een", "één", "'t", "alle", "al", "elk", "elke", "ieder", "iedere", "enig", "enige", "enkele", "sommige", "geen", "zijn", "haar", "hun", "diens", "ten minste", "uitsluitend", "alleen", "slechts", "ook", "nog", "andere", "eventuele", "eventueel", "dergelijke", "dergelijk", "zulke", "zulk", "zodanige", "zodanig", "deze", "die", "dit", "dat", "voornoemde", "bovengenoemde", "bovenbedoelde", "eerdergenoemde", "laatstgenoemde", "desbetreffende", "betreffende")
PRONOUNS = ("zij", "ze", "hij", "het", "die", "dit", "dat", "deze", "men", "zich", "wij")
INSERTS = ("in voorkomend geval", "indien van toepassing", "waar van toepassing", "naar gelang van het geval", "al naargelang het geval", "in het bijzonder", "met name")
RELATIVE = ("die", "dat", "welke", "wier", "wiens", "waarbij", "waaraan", "waarvan", "waarin", "waarop", "waarmee", "waardoor", "waartoe", "waarvoor", "tot wie", "aan wie", "bij wie", "van wie", "met inbegrip van", "zoals", "dan")
OUTER = ("door", "aan", "op", "in", "voor", "met", "tot", "van", "bij")

#: Letters whose decomposition begins with a letter of ASCII, and signs that come apart to several.
_APART = {chr(c): unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode() for c in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07)]}
_ONE = {k: v for k, v in _APART.items() if len(v) == 1}
_MORE = {k: v for k, v in _APART.items() if len(v) > 1}


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), x worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def any_of(words: Iterable[str]) -> str:
    """A pattern for one of some phrases, the longest first, any white space within."""
    escaped = ["".join("\\" + c if c in "\\.^$|?*+()[]{}" else r"\s+" if c == " " else c for c in w) for w in words]
    return "(?:" + "|".join(sorted(escaped, key=len, reverse=True)) + ")"


def plain(c: Column) -> Column:
    """Lower case, without accents, hyphens and signs beyond ASCII, single spaces; null stays null."""
    out = F.translate(F.lower(c), "".join(_ONE), "".join(_ONE.values()))
    many = out
    for sign, letters in _MORE.items():
        many = F.replace(many, F.lit(sign), F.lit(letters))
    out = F.when(out.rlike("[" + "".join(_MORE) + "]"), many).otherwise(out)
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(out), r"[^\x00-\x7F]|-", ""), r"[\s\x1c-\x1f]+", " "))


def slug(c: Column) -> Column:
    """The plain form with an underscore for each run of other signs than letters and digits."""
    return F.regexp_replace(F.regexp_replace(plain(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


_V, _NOT_V, _NOT_VI = "[aeiouyè]", "[^aeiouyè]", "[^aeiouyèI]"


def stem(word: Column) -> Column:
    """The Dutch Snowball stem of one word in lower case: endings -heden, -en, -s, -e, -heid, -ing, -ig, -lijk, -baar go where the stem is long enough, doubled letters are mended."""
    w = F.translate(word, "äëïöüáéíóú", "aeiouaeiou")
    w = F.regexp_replace(F.regexp_replace(w, f"^y|(?<={_V})y", "Y"), f"(?<={_V})i(?={_V})", "I")

    def undoubled(x: Column) -> Column:
        return F.when(x.rlike("(kk|dd|tt)$"), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x)

    def regions(x: Column) -> Column:
        first, second = (F.length(F.regexp_extract(x, f"^((?:.*?{_V}{_NOT_V}){{{k}}})", 1)) for k in (1, 2))
        return F.struct(x.alias("w"), F.when(first > 0, F.greatest(first, F.lit(3))).otherwise(F.length(x)).alias("p1"), F.when(second > 0, second).otherwise(F.length(x)).alias("p2"), F.lit(False).alias("e"))

    def less(s: Column, n: int) -> Column:
        return F.substring(s["w"], F.lit(1), F.length(s["w"]) - n)

    def after(s: Column, n: int, region: str) -> Column:
        return F.length(s["w"]) - n >= s[region]

    def put(s: Column, w: Column, e: Column | None = None) -> Column:
        return F.struct(w.alias("w"), s["p1"].alias("p1"), s["p2"].alias("p2"), (s["e"] if e is None else e).alias("e"))

    def without_en(s: Column, n: int) -> Column:
        ok = after(s, n, "p1") & less(s, n).rlike(f"{_NOT_V}$") & ~less(s, n).rlike("gem$")
        return F.when(ok, put(s, undoubled(less(s, n)))).otherwise(s)

    def without_e(s: Column) -> Column:
        ok = s["w"].endswith("e") & after(s, 1, "p1") & less(s, 1).rlike(f"{_NOT_V}$")
        return F.when(ok, put(s, undoubled(less(s, 1)), F.lit(True))).otherwise(put(s, s["w"], F.lit(False)))

    def plural(s: Column) -> Column:
        ends = lambda x: s["w"].endswith(x)
        s_end = lambda n: F.when(after(s, n, "p1") & less(s, n).rlike("[^aeiouyèj]$"), put(s, less(s, n))).otherwise(s)
        heid = F.when(after(s, 5, "p1"), put(s, F.concat(less(s, 5), F.lit("heid")))).otherwise(s)
        return F.when(ends("heden"), heid).when(ends("ene"), without_en(s, 3)).when(ends("en"), without_en(s, 2)).when(ends("se"), s_end(2)).when(ends("s"), s_end(1)).otherwise(s)

    def heid(s: Column) -> Column:
        ok = s["w"].endswith("heid") & after(s, 4, "p2") & ~less(s, 4).endswith("c")
        return F.when(ok, let(put(s, less(s, 4)), lambda t: F.when(t["w"].endswith("en"), without_en(t, 2)).otherwise(t))).otherwise(s)

    def derived(s: Column) -> Column:
        ends = lambda x: s["w"].endswith(x)
        cut = lambda n, ok=F.lit(True): F.when(after(s, n, "p2") & ok, put(s, less(s, n))).otherwise(s)
        ig = lambda t: F.when(t["w"].endswith("ig") & after(t, 2, "p2") & ~less(t, 2).endswith("e"), put(t, less(t, 2))).otherwise(put(t, undoubled(t["w"])))
        ing = F.when(after(s, 3, "p2"), let(put(s, less(s, 3)), ig)).otherwise(s)
        lijk = F.when(after(s, 4, "p2"), let(put(s, less(s, 4)), without_e)).otherwise(s)
        return F.when(ends("end") | ends("ing"), ing).when(ends("lijk"), lijk).when(ends("baar"), cut(4)).when(ends("bar"), cut(3, s["e"])).when(ends("ig"), cut(2, ~less(s, 2).endswith("e"))).otherwise(s)

    done = let(let(let(let(let(w, regions), plural), without_e), heid), derived)["w"]
    return F.translate(F.regexp_replace(done, f"^(.*{_NOT_V})([aeou])\\2({_NOT_VI})$", "$1$2$3"), "IY", "iy")


def word_key(word: Column) -> Column:
    """The key of one word: plain, the plurals -leden and vowel with -s undone, and its stem."""

    def key(w: Column) -> Column:
        lid = F.concat(F.substring(w, F.lit(1), F.length(w) - 5), F.lit("lid"))
        cut = F.when(w.endswith("leden"), lid).when((F.length(w) > 4) & w.rlike("[aeiou]s$"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
        return let(cut, stem)

    return let(plain(F.regexp_replace(word, "[’']s$", "")), key)


def words_of(c: Column) -> Column:
    """The words of a phrase, each from a letter on: letters, digits, underscores, hyphens and apostrophes."""
    return F.regexp_extract_all(c, F.lit(r"\p{L}[\p{L}\p{M}\p{N}_\-’']*"), F.lit(0))


def _upto(words: Column, stops: Sequence[str]) -> Column:
    """How many words stand before the first of stops, the first word aside; all if there is none."""
    at = F.array_position(F.transform(words, lambda w, i: (i > 0) & F.lower(w).isin(*stops)), True)
    return F.when(at > 0, at - 1).otherwise(F.size(words)).cast("int")


def head_split(c: Column) -> Column:
    """struct<pre, head, post> of a phrase: its head is the last word before the first preposition but adverbs; pre and post keep the words with content. head null: no words."""

    def split(words: Column) -> Column:
        def at(cut: Column) -> Column:
            before = F.slice(words, F.lit(1), cut)
            # The last word that is not an adverb after the head; the first word if all are.
            last = F.greatest(F.aggregate(F.transform(before, lambda w, i: F.when(~F.lower(w).isin(*AFTER_HEAD), i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b)), F.lit(1))
            content = lambda ws: F.filter(ws, lambda w: ~F.lower(w).isin(*FUNCTION_WORDS))
            return let(last, lambda h: F.struct(content(F.slice(words, F.lit(1), h - 1)).alias("pre"), F.get(words, h - 1).alias("head"), content(F.slice(words, h + 1, F.greatest(F.size(words), F.lit(1)))).alias("post")))

        return let(_upto(words, PREPOSITIONS), at)

    return let(words_of(F.coalesce(c, F.lit(""))), split)


def term_head(c: Column) -> Column:
    """The last space-separated word before the first preposition, the first word aside; the term itself if it has no words."""
    return let(F.array_remove(F.split(c, r"\s+"), ""), lambda ws: F.when(F.size(ws) > 0, F.get(ws, _upto(ws, PREPOSITIONS[:16]) - 1)).otherwise(c))


def role_versions(unit: Column) -> Column:
    """The keys of a split phrase, longest first: fewer words before the head, then fewer after it; each once."""

    def versions(keyed: Column) -> Column:
        heads = F.transform(F.sequence(F.lit(0), F.size(keyed["pre"])), lambda i: F.slice(keyed["pre"], i + 1, F.greatest(F.size(keyed["pre"]), F.lit(1))))
        tails = F.transform(F.sequence(F.size(keyed["post"]), F.lit(0), F.lit(-1)), lambda k: F.slice(keyed["post"], F.lit(1), k))
        return F.array_distinct(F.flatten(F.transform(heads, lambda a: F.transform(tails, lambda b: F.array_join(F.concat(a, F.array(keyed["head"]), b), " ")))))

    keyed = F.struct(F.transform(unit["pre"], word_key).alias("pre"), word_key(unit["head"]).alias("head"), F.transform(unit["post"], word_key).alias("post"))
    return F.when(unit["head"].isNotNull(), let(keyed, versions)).otherwise(F.array().cast("array<string>"))


#: A rule: its name, a pattern (case aside), and what stands for each match.
Rule = tuple[str, str, str]
_REF = r"(?:artikel(?:en)?|lid|leden|punt(?:en)?|bijlagen?|hoofdstuk(?:ken)?|afdeling(?:en)?|alinea'?s?|onderdel(?:en)?|onderdeel|paragraaf|titel|sub)"
_NUMBERS = r"(?:[0-9]+[a-z]?|(?-i:[IVXLC]+)\b|[a-z]\)|[ivx]+\))(?:\s*(?:,|en|of|tot\s+en\s+met|tot)\s*(?:[0-9]+[a-z]?|(?-i:[IVXLC]+)\b|[a-z]\)|[ivx]+\)))*"
_PLACE = rf"(?:{_REF}\s+{_NUMBERS}|(?:eerste|tweede|derde|vierde|vijfde|zesde|zevende|achtste|negende|tiende)\s+{_REF}|(?:deze|dit|die)\s+(?:verordening|richtlijn|wet|besluit|{_REF}))"
_AS_IN = r"(?:(?:(?:als|zoals)\s+)?(?:bedoeld|genoemd|vermeld|vervat|omschreven|gedefinieerd|vastgesteld|aangewezen)\s+(?:in|bij|onder|overeenkomstig)|van|uit|in|bij|onder|krachtens|overeenkomstig|op\s+grond\s+van|uit\s+hoofde\s+van|in\s+de\s+zin\s+van|ingevolge)"
_TIDY: list[Rule] = [
    ("spaces", r"\s+", " "),
    ("space before a sign", r"\s+([,.;:)])", "$1"),
    ("signs at the ends", r"^[ ,;:.\-–]+|[ ,;:.\-–]+$", ""),
    ("preposition at the end", rf"\s+{any_of(OUTER)}$", ""),
]
#: The rules that clean the name of an actor, in their order.
ACTOR_RULES: list[Rule] = [
    ("quotes", r"[\"“”„`]", ""),
    ("ends", r"^\s+|\s+$", ""),
    ("list mark", r"^\(?(?:[a-z]|[0-9]{1,2}|[ivx]{1,4})[.)°]\s+", ""),
    ("pronoun", rf"^{any_of(PRONOUNS)}$", ""),
    ("and/or", r"\ben\s*/\s*of\b", "of"),
    ("insert", rf"(?:,\s*|\s+)(?:{any_of(INSERTS)}|onverminderd\s+artikel\s+\d+)\s*,?(?=\s)", " "),
    ("reference before a noun", rf"\b(de|het|een|die|dat|alle|elke|ieder|iedere)\s+(?:in|bij|krachtens|overeenkomstig|ingevolge|volgens|op\s+grond\s+van)\s+[^;]{{0,60}}?\b(?:{_REF}|verordening|richtlijn)\b[^;]{{0,60}}?\s(?:bedoelde?|bepaalde?|genoemde?|vermelde?|vastgestelde?|voorziene?|omschreven|beschreven|opgenomen|opgesomde|gedefinieerde|aangewezen|neergelegde)\b", "$1"),
    ("act", rf"\s+{_AS_IN}\s+(?:de\s+)?(?:verordening|richtlijn)\s*(?:\((?:eu|eg|eeg|euratom)\)\s*)?(?:nr\.\s*)?[\d/]+", " "),
    ("reference", rf",?\s+{_AS_IN}\s+(?:(?:het|de|dit|dat|deze)\s+)?{_PLACE}(?:\s*,?\s*(?:en\s+|alsmede\s+(?:in\s+)?)?(?:van\s+(?:het\s+|de\s+)?)?{_PLACE})*,?", " "),
    ("relative clause", rf"^(\S+)(.*?),?\s+{any_of(RELATIVE)}\b.*$", "$1$2"),
    ("pronominal adverb", r"\s*\b(?:daarvan|hiervan|ervan|daarin|hierin|erin|daarop|hierop|erop|daartoe|hiertoe|ertoe|daarvoor|hiervoor)\b", ""),
    *_TIDY,
    ("preposition at the front", rf"^{any_of(OUTER)}\s+", ""),
    ("leading words", rf"^(?:{any_of(LEADING)}\s+)+", ""),
    *_TIDY,
]


def rewritten(c: Column, rules: Sequence[Rule] = tuple(ACTOR_RULES), rounds: int = 1) -> Column:
    """struct<text, trace>: a phrase after an ordered table of rules, and the names of those that changed it.

    A rule replaces every match of its pattern, whatever the case.  With several rounds the table is gone
    through again until nothing changes, so many times at most.  Null stays null, with an empty trace.
    """

    def one(state: Column, rule: Rule) -> Column:
        name, pattern, put = rule
        new = lambda s: let(F.regexp_replace(s["text"], f"(?iUs){pattern}", put), lambda t: F.struct(t.alias("text"), F.when(t == s["text"], s["trace"]).otherwise(F.array_append(s["trace"], F.lit(name))).alias("trace")))
        return let(state, new)

    def through(state: Column) -> Column:
        for rule in rules:
            state = one(state, rule)
        return state

    start = F.struct(c.alias("text"), F.array().cast("array<string>").alias("trace"))
    out = through(start)
    for _ in range(rounds - 1):
        out = let(out, lambda s: let(through(s), lambda t: F.when(t["text"].eqNullSafe(s["text"]), s).otherwise(t)))
    return F.when(c.isNull(), start).otherwise(out)


def conjuncts(c: Column) -> Column:
    """array<string>: the coordinated heads of a phrase, each with the complement that they share.

    Heads are parted by commas and coordinators before the first word that opens a complement; what follows it
    goes to each.  Determiners and signs at the ends go.  A phrase of which nothing is left is returned as it is; null: null.
    """
    spaced = F.replace(F.regexp_replace(c, r",?\s+in voorkomend geval,?\s+", " "), F.lit(","), F.lit(" , "))

    def split(words: Column) -> Column:
        def at(cut: Column) -> Column:
            post = F.replace(F.array_join(F.slice(words, cut + 1, F.greatest(F.size(words), F.lit(1))), " "), F.lit(" , "), F.lit(", "))
            # One sign in place of each separator, then the runs between.
            marked = F.transform(F.slice(words, F.lit(1), cut), lambda w: F.when(w.isin(*COORDINATORS, ","), F.lit("\u0001")).otherwise(w))
            runs = F.filter(F.transform(F.split(F.array_join(marked, " "), "\u0001"), F.trim), lambda r: r != "")
            whole = F.transform(runs, lambda r: F.when(post != "", F.concat_ws(" ", r, post)).otherwise(r))
            bare = F.transform(whole, lambda r: F.regexp_replace(r, r"^[\s\"'“”‘’«»„:;.,()\[\]]+|[\s\"'“”‘’«»„:;.,()\[\]]+$", ""))
            led = F.transform(bare, lambda r: F.regexp_replace(F.regexp_replace(r, r"\s+", " "), rf"^(?:{any_of(DETERMINERS)}\s+)+(?=\S)", ""))
            return F.filter(led, lambda r: r != "")

        return let(_exact_upto(words), at)

    found = let(F.array_remove(F.split(spaced, r"\s+"), ""), split)
    return F.when(c.isNotNull(), let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(c))))


def _exact_upto(words: Column) -> Column:
    at = F.array_position(F.transform(words, lambda w, i: (i > 0) & w.isin(*POSTMODIFIERS)), True)
    return F.when(at > 0, at - 1).otherwise(F.size(words)).cast("int")
