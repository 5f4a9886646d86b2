"""Personal data: detection and surrogates (operator 3).  SQL functions only.

Detection is by pattern.  Every distinct entity of the corpus gets one
surrogate, drawn from a keyed hash of its kind and canonical form, so all its
mentions share it.  A surrogate has the kind's format and the script of the
letters it stands for.  Card numbers and IBANs keep valid check digits, social
security numbers stay in the ranges that are given out, phone numbers keep the
country code alone.

Names are found after a title.  Each word of a name is one entity of the corpus,
whatever the title, its place and its case, so a person's mentions agree.  A
word that stands first of several takes the gender of its titles, where they
agree.  In a text that names a person after a title, the same words are
replaced without one too.  Initials stay.

Distinctness: a surrogate that two entities drew, of whatever kinds, or that is
itself an entity of the corpus, goes to the smallest entity that drew it, or to
none, and the others draw again, until all are settled.  After ``WIDEN`` draws
every format is widened, more with each draw, so this ends even where entities
outnumber a format's values.

The mapping meets mentions and texts in joins; only mappings of very common
entities are broadcast (``common.join_keys``).

Defined cases: a null or empty text stays as it is and has no entities; equal
texts get equal results; rows without id are treated like others; ``n_entities``
counts mentions; other columns pass through, whatever their names, and columns
named ``text`` or ``n_entities`` are replaced; letters of a script without an
entry in ``SCRIPTS`` become Latin ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, join_keys

#: Whoever knows the key can draw the surrogates again; give your own.
KEY = "surrogate-key-1"
WIDEN = 8

_TITLES = {
    "m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Signor", "г-н", "Г-н", "господин", "Господин"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Signora", "г-жа", "Г-жа", "госпожа", "Госпожа"],
    "n": ["Dr", "Prof", "Mx", "доктор", "Доктор", "профессор", "Профессор"],
}
_TITLE = "(?:" + "|".join(t for ts in _TITLES.values() for t in sorted(ts, key=len, reverse=True)) + r")\.? "
_NAME = r"(?:\p{IsHan}{2,4}|[\p{Lu}\p{Lt}\p{Lo}&&[^\p{IsHan}]][\p{L}\p{M}]+(?:['’-]\p{L}[\p{L}\p{M}]*)*|\p{Lu}['’]\p{L}[\p{L}\p{M}]*(?:-\p{L}[\p{L}\p{M}]*)*)"
_WORD = rf"(?:{_NAME}|\p{{Lu}}\.)"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: Letters that stand for those of a script: capitals (or all, where there is no case) and small ones.
SCRIPTS = [
    ("Cyrillic", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "абвгдежзиклмнопрстуфхцчшэюя"),
    ("Greek", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "αβγδεζηθικλμνξοπρστυφχψω"),
    ("Han", "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗文明华军平志国建海天", None),
    ("Hangul", "가나다라마바사아자차카타파하김이박최정강조윤장임", None),
    ("Hiragana", "あいうえおかきくけこさしすせそたちつてとなにのはひふまみもやゆよらりるれろ", None),
    ("Katakana", "アイウエオカキクケコサシスセソタチツテトナニノハヒフマミモヤユヨラリルレロ", None),
    ("Arabic", "ابتجحخدذرزسشصضطظعغفقكلمنهوي", None),
    ("Hebrew", "אבגדהוזחטיכלמנסעפצקרשת", None),
    ("Devanagari", "अआइउकखगघचजटडतथदधनपबभमयरलवशसह", None),
    ("Thai", "กขคงจชซดตถทนบปผพมยรลวสหอ", None),
]

#: Kind and Java pattern; the first that matches at a place wins.
PATTERNS: list[tuple[str, str]] = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("secret", r"(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[^\s\"']{6,}"),
    ("awskey", r"(?<![A-Za-z0-9])A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("hex", r"(?<![A-Za-z0-9])(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{40}(?:[0-9a-f]{24})?(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}(?![A-Za-z0-9])"),
    ("ip", rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])"),
    ("phone", r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z.-])(?:\+[0-9]{1,3}[ .-])?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("card", r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -]){3}[0-9]{4}(?![0-9])|(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])"),
    ("name", rf"(?<!\p{{L}}){_TITLE}(?:{_WORD} ){{0,2}}{_NAME}"),
]
ANY = "|".join(p for _, p in PATTERNS)


def may_hold(text: Column) -> Column:
    """False only where no pattern can match; much cheaper than the patterns."""
    marks = ["@", "=", ":", "AKIA", "ASIA", *(t for ts in _TITLES.values() for t in ts)]
    out = text.rlike("[0-9]")
    for m in marks:
        out = out | text.contains(m)
    return out


def _kind(value: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS:
        test = value.rlike(f"^(?:{pattern})$")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("bare")


def _name_words(value: Column) -> Column:
    return F.split(F.regexp_replace(value, f"^{_TITLE}", ""), " ")


def bare_pattern(values: Column) -> Column:
    """Pattern of the name words of a text's titled mentions, standing alone; null where there are none."""
    titled = F.filter(values, lambda v: v.rlike(f"^{_TITLE}"))
    words = F.filter(F.flatten(F.transform(titled, _name_words)), lambda w: ~w.endswith("."))
    either = F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(w, F.upper(w)))))
    # Longer words first, so none hides another that begins with it.
    ordered = F.transform(F.sort_array(F.transform(either, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))), asc=False), lambda x: x["w"])
    return F.when(F.size(words) > 0, F.concat(F.lit(r"(?<![\p{L}\p{M}])(?:"), F.array_join(ordered, "|"), F.lit(r")(?![\p{L}\p{M}])")))


def _parts(value: Column) -> Column:
    """array<struct<kind, canon, gender>>: what a mention stands for; a name is its words."""
    kind = _kind(value)
    none = F.lit(None).cast("string")
    part = lambda k, c, g: F.struct(k.alias("kind"), c.alias("canon"), g.alias("gender"))
    words = _name_words(value)
    title = F.regexp_extract(value, rf"^({_TITLE})", 1)
    bare_title = F.regexp_replace(title, r"\.? $", "")
    gender = F.when(bare_title.isin(*_TITLES["m"]), "m").when(bare_title.isin(*_TITLES["f"]), "f").otherwise("n")
    named = F.transform(words, lambda w, i: part(F.when(w.endswith("."), "initial").otherwise("word"), F.lower(w), F.when((i == 0) & (F.size(words) > 1), gender)))
    digits = F.regexp_replace(value, "[^0-9]", "")
    canon = (
        F.when(kind == "email", F.lower(value))
        # With or without its country code, a number of North America is the same.
        .when(kind == "phone", F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "secret", F.regexp_extract(value, r"(?s)[=:]\s*[\"']?(.*)$", 1))
        .otherwise(value)
    )
    return F.when(kind == "name", named).when(kind == "bare", F.array(part(F.lit("word"), F.lower(value), none))).otherwise(F.array(part(kind, canon, none)))


def _stream(key: str, seed: Column, length: Column) -> Column:
    """Hexadecimal digits of a keyed stream, two for each of ``length`` places and some to spare."""
    blocks = F.sequence(F.lit(0), F.floor(length / 32).cast("int") + 1)
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("|", F.lit(key), seed, b.cast("string")), 256)), "")


def _byte(stream: Column, at: Column) -> Column:
    return F.conv(F.substring(stream, at * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _two_bytes(stream: Column, at: int) -> Column:
    return F.conv(F.substring(stream, at * 4 + 1, 4), 16, 10).cast("int")


def _mask(value: Column, stream: Column, hex_only: Column | None = None, symbols: Column | None = None) -> Column:
    """Every letter and digit replaced by one of its own class and script; others too where ``symbols`` holds."""

    def one(c: Column, i: Column) -> Column:
        n = _byte(stream, i)
        pick = lambda letters: F.substring(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))
        low = pick("abcdefghijklmnopqrstuvwxyz")
        if hex_only is not None:
            low = F.when(hex_only, pick("abcdef")).otherwise(low)
        out = F.when(c.rlike("[0-9]"), pick("0123456789")).when(c.rlike("[a-z]"), low).when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        for script, upper, lower in SCRIPTS:
            if lower:
                out = out.when(c.rlike(rf"\p{{Is{script}}}") & c.rlike(r"\p{Ll}"), pick(lower))
            out = out.when(c.rlike(rf"\p{{Is{script}}}"), pick(upper))
        out = out.when(c.rlike(r"\p{Lu}"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(c.rlike(r"\p{L}"), pick("abcdefghijklmnopqrstuvwxyz"))
        return (out if symbols is None else out.when(symbols, pick("!#$%&*+-?@^_~"))).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), one), "")


def _with_check_digit(digits: Column) -> Column:
    """The digits with the last one made valid by the Luhn rule."""
    body = F.reverse(F.substring(digits, F.lit(1), F.length(digits) - 1))
    each = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + x)
    return F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), F.pmod(-total, F.lit(10)).cast("string"))


def _syllables(stream: Column, count: Column) -> Column:
    pick = lambda letters, at: F.substring(F.lit(letters), F.pmod(_byte(stream, at), F.lit(len(letters))) + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.concat(pick("bdfghklmnprstvz", i * 2), pick("aeiou", i * 2 + 1))), "")


def _iban(country: Column, body: Column) -> Column:
    """Country, check digits by the remainder of 97, and body."""
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    chars = F.filter(F.split(F.concat(body, country, F.lit("00")), ""), lambda c: c != "")
    rest = F.aggregate(chars, F.lit(0), lambda a, c: ((a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97).cast("int"))
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), body)


def _draw(key: str, kind: Column, canon: Column, gender: Column, attempt: Column) -> Column:
    """The surrogate of an entity at its n-th attempt."""
    wide = attempt >= WIDEN
    more = F.when(wide, attempt - WIDEN + 1).otherwise(0)
    stream = _stream(key, F.concat_ws("|", kind, canon, attempt.cast("string")), F.length(canon) * (more + 1) + 2 * more + 24)
    back = F.reverse(stream)
    masked = _mask(canon, stream)
    extra = F.when(wide, _mask(F.repeat(F.lit("0"), 2 * more + 4), back)).otherwise("")
    grown = F.when(wide, F.concat(F.lit("-"), _syllables(back, more + 2))).otherwise("")
    n = lambda k: _byte(stream, F.lit(k))
    octets = F.concat_ws(".", (n(0) % 222 + 1).cast("string"), (n(1) % 254 + 1).cast("string"), (n(2) % 254 + 1).cast("string"), (n(3) % 254 + 1).cast("string"))
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    host = F.regexp_extract(domain, r"^(.*)\.[^.]+$", 1)
    email = F.concat(_mask(local, stream), F.when(wide, F.concat(F.lit("."), _syllables(back, more + 2))).otherwise(""), F.lit("@"), _mask(host, back), F.lit("."), F.substring_index(domain, ".", -1))
    # The ending shows the gender; hyphens and a particle such as o' stay.
    ending = F.when(gender == "m", "n").when(gender == "f", "na").when(gender == "n", "ri").otherwise("")
    each = F.transform(F.split(canon, "-"), lambda p, i: F.concat(F.regexp_extract(p, "^(\\p{L}{1,2}['’])", 1), _syllables(F.substring(stream, i * 16 + 1, F.length(stream)), F.lit(3) + more)))
    word = F.when(canon.rlike(r"^[\p{IsLatin}\p{M}'’-]+$"), F.concat(F.array_join(each, "-"), ending)).otherwise(_mask(F.repeat(canon, more + 1), stream))
    head = F.greatest(F.length(canon) - 10, F.lit(0))
    tail = F.concat((n(0) % 8 + 2).cast("string"), F.substring(masked, head + 2, F.lit(2)), (n(1) % 8 + 2).cast("string"), F.substring(masked, head + 5, F.lit(6)))
    phone = F.concat(F.when(F.length(canon) < 10, masked).otherwise(F.concat(F.substring(canon, F.lit(1), head), tail)), extra)
    area = _two_bytes(stream, 0) % 898 + 1
    area = F.when(area >= 666, area + 1).otherwise(area)
    padded = lambda x, k: F.lpad(x.cast("string"), k, "0")
    ssn = F.concat(padded(area, 3), padded(_two_bytes(stream, 1) % 99 + 1, 2), padded(_two_bytes(stream, 2) % 9999 + 1, 4), extra)
    return (
        F.when(kind == "word", word)
        .when(kind == "ip", F.concat(octets, F.when(wide, F.concat(F.lit("."), extra)).otherwise("")))
        .when(kind == "email", email)
        .when(kind == "phone", phone)
        .when(kind == "card", _with_check_digit(F.concat(F.substring(canon, F.lit(1), F.lit(1)), F.substring(masked, F.lit(2), F.length(canon)), extra)))
        .when(kind == "ssn", ssn)
        .when(kind == "awskey", F.concat(F.substring(canon, F.lit(1), F.lit(4)), F.substring(masked, F.lit(5), F.length(canon)), grown))
        .when(kind == "iban", _iban(F.substring(canon, F.lit(1), F.lit(2)), F.concat(F.substring(masked, F.lit(5), F.length(canon)), extra)))
        .otherwise(F.concat(_mask(canon, stream, canon.rlike("^[0-9a-f]+$"), kind == "secret"), grown))
    )


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """``entities(kind, canon)``, with a gender or not, and their surrogates: kind, canon, surrogate, all different and none of them an entity."""
    gender = F.max("gender") if "gender" in entities.columns else F.lit(None).cast("string")
    entities = durable(entities.groupBy("kind", "canon").agg(gender.alias("gender")))
    settled = None
    open_ = entities.withColumn("attempt", F.lit(0))
    while True:
        drawn = durable(open_.withColumn("surrogate", _draw(key, *map(F.col, ("kind", "canon", "gender", "attempt")))))
        # The smallest of those that drew the same keeps it, unless it is taken or names an entity.
        first = drawn.groupBy("surrogate").agg(F.min(F.struct("kind", "canon")).alias("e")).select("e.*", "surrogate")
        taken = entities.select(F.col("canon").alias("surrogate"))
        if settled is not None:
            taken = taken.union(settled.select("surrogate"))
        new = durable(first.join(taken, "surrogate", "left_anti").select("kind", "canon", "surrogate"))
        settled = new if settled is None else settled.union(new)
        open_ = drawn.drop("surrogate").join(new, ["kind", "canon"], "left_anti").withColumn("attempt", F.col("attempt") + 1)
        if open_.isEmpty():
            return settled


def _render(value: Column, cores: Column) -> Column:
    """A mention with its parts replaced, in the mention's own layout."""
    kind = _kind(value)
    core = F.element_at(cores, 1)

    def layout(value: Column, digits: Column) -> Column:
        """The value's characters with its digits replaced in turn; what is left over goes to the end."""
        chars = F.filter(F.split(value, ""), lambda c: c != "")
        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
        step = lambda a, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(a["out"], F.substring(digits, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at")))
        return F.aggregate(chars, start, step, lambda a: F.concat(a["out"], F.substring(digits, a["at"], F.length(digits))))

    def cased(word: Column, surrogate: Column) -> Column:
        """In capitals, in small letters, or with capitals at the start and after hyphens and apostrophes."""
        spaced = F.initcap(F.regexp_replace(surrogate, "(['’-])", "$1 "))
        return F.when((F.upper(word) == word) & (F.lower(word) != word) & (F.length(word) > 1), F.upper(surrogate)).when(F.lower(word) == word, surrogate).otherwise(F.regexp_replace(spaced, "(['’-]) ", "$1"))

    label = F.regexp_extract(value, r"(?s)^([^=:]*[=:]\s*[\"']?)", 1)
    title = F.regexp_extract(value, rf"^({_TITLE})", 1)
    words = F.zip_with(_name_words(value), cores, lambda w, c: F.when(w.endswith("."), w).otherwise(cased(w, c)))
    numbers = F.regexp_replace(value, "[^0-9]", "")
    coded = F.when((F.length(numbers) == 11) & numbers.startswith("1"), F.concat(F.lit("1"), core)).otherwise(core)
    return (
        F.when(kind == "name", F.concat(title, F.array_join(words, " ")))
        .when(kind == "bare", cased(value, core))
        .when(kind == "phone", layout(value, coded))
        .when(kind.isin("card", "ssn"), layout(value, core))
        .when(kind == "secret", F.concat(label, core))
        .otherwise(core)
    )


def replace_entities(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """The rows with surrogates in ``text`` and the number of mentions in ``n_entities``."""
    names = [c for c in docs.columns if c != "n_entities"]
    has = lambda text: F.coalesce(may_hold(text) & text.rlike(ANY), F.lit(False))
    # Under one struct no column of the input can clash with those added here.
    rows = docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), has(F.col(text_col)).alias("has"))
    text = F.col(f"row.{text_col}")
    found = docs.where(has(F.col(text_col))).select(F.md5(text_col).alias("digest"), F.col(text_col).alias("text"), F.regexp_extract_all(F.col(text_col), F.lit(ANY), 0).alias("values"))
    found = found.withColumn("bare", bare_pattern(F.col("values")))
    again = F.regexp_extract_all(F.col("text"), F.concat(F.lit(ANY + "|"), F.col("bare")), F.lit(0))
    found = found.select("digest", "bare", F.when(F.col("bare").isNull(), F.col("values")).otherwise(again).alias("values"))
    found = durable(found.groupBy("digest").agg(F.any_value("bare").alias("bare"), F.any_value("values").alias("values"), F.count(F.lit(1)).alias("n")))
    mentions = found.select("digest", F.posexplode("values").alias("i", "value"))
    parts = durable(mentions.select("digest", "i", "value", F.posexplode(_parts(F.col("value"))).alias("j", "part")).select("digest", "i", "value", "j", "part.*"))
    real = parts.where("kind <> 'initial'")
    genders = lambda g: F.max(F.when(F.col("gender") == g, 1).otherwise(0)) == 1
    agreed = F.when(genders("m") & ~genders("f"), "m").when(genders("f") & ~genders("m"), "f").otherwise(F.when(F.count("gender") > 0, "n"))
    entities = durable(real.groupBy("kind", "canon").agg(agreed.alias("gender"), F.count(F.lit(1)).alias("n")))
    mapping = surrogates(entities.select("kind", "canon", "gender"), key).join(entities.select("kind", "canon", "n"), ["kind", "canon"])
    cores = join_keys(real.drop("gender"), mapping, ["kind", "canon"], real.count()).select("digest", "i", "value", "j", "surrogate")
    cores = cores.union(parts.where("kind = 'initial'").select("digest", "i", "value", "j", "canon"))
    each = cores.groupBy("digest", "i", "value").agg(F.sort_array(F.collect_list(F.struct("j", "surrogate"))).alias("cores"))
    each = each.select("digest", "i", _render(F.col("value"), F.transform("cores", lambda x: x["surrogate"])).alias("shown"))
    shown = each.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("i", "shown"))).alias("shown"))
    # Kept in the shared folder, so that a text of very many copies can be split among tasks.
    shown = durable(shown.join(found.select("digest", "bare"), "digest"))

    gaps = F.split(text, F.concat_ws("|", F.lit(ANY), F.col("bare")), -1)
    woven = F.array_join(F.transform(F.arrays_zip(gaps.alias("gap"), F.transform("shown", lambda x: x["shown"]).alias("shown")), lambda x: F.concat(x["gap"], F.coalesce(x["shown"], F.lit("")))), "")
    changed = rows.where("has").withColumn("digest", F.md5(text)).join(shown, "digest")
    after = changed.select(*[woven.alias(c) if c == text_col else F.col(f"row.{c}").alias(c) for c in names], F.size("shown").alias("n_entities"))
    untouched = rows.where("NOT has").select(*[F.col(f"row.{c}").alias(c) for c in names], F.lit(0).alias("n_entities"))
    return untouched.unionByName(after)
