"""PII surrogates in DataFrame operations only.

Entities are found by pattern and brought to a canonical form, so that mentions of one entity agree whatever their case
or spacing. Each distinct entity gets a surrogate from a keyed digest (HMAC-SHA-256): digits for digits, letters for letters of
the same script (Latin ones for scripts without a line in ``_SCRIPTS``), the country code, top-level domain and a card number's
check digit kept as they are, given names by the gender of the title and the name's script; a titled name of one word is a
surname. Surrogates that two entities share, or that are an entity of the corpus, are drawn again with the next attempt
number until all differ. Mentions are rendered in their own format and case. Only distinct entities and documents that hold
some are shuffled.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from . import kernel as K

_OUT, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: Titles by gender (f, m, or n: not told).
TITLES = {"f": "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Doña", "m": "Mr|Herr|Monsieur|Señor|Sr|Don", "n": "Mx|Dr|Prof"}
_TITLE = f"(?:{'|'.join(TITLES.values())})"
#: Small words within surnames.
_OF = "(?:(?:von|van|vom|zu|zur|der|den|dem|de|del|della|di|da|dos|du|la|le|ter|ten|bin|ibn|al|el) )*+"
#: A part of a name: with hyphens, apostrophes and capitals within, or of a script without case.
_CASED, _PLAIN = r"[\p{Lu}\p{Lt}][\p{L}\p{M}]*+(?:['’\-][\p{L}][\p{L}\p{M}]*+)*+", r"\p{Lo}[\p{L}\p{M}]*+(?:['’\-][\p{L}][\p{L}\p{M}]*+)*+"
#: Given names of the surrogates, by gender, and by script and gender; names of other scripts get letters of their script.
GIVEN = {
    "f": "Alice Clara Diana Elena Frida Greta Helen Irene Julia Klara Laura Maria Nora Olga Paula Rosa Sara Tina Vera Zoe".split(),
    "m": "Adam Boris Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Nils Oscar Paul Robert Simon Theo Victor".split(),
    "n": "Alex Andrea Charlie Dominique Eden Florin Gabriel Jamie Kim Lou Marian Nikola Robin Sacha Toni".split(),
}
GIVEN_BY_SCRIPT = {
    "Latin": GIVEN,
    "Cyrillic": {
        "f": "Анна Вера Галина Дарья Елена Ирина Мария Нина Ольга Полина Раиса Татьяна".split(),
        "m": "Антон Борис Виктор Иван Игорь Леонид Николай Олег Павел Роман Семён Фёдор".split(),
        "n": "Валя Женя Паша Саша Слава Шура".split(),
    },
    "Greek": {
        "f": "Άννα Ελένη Ειρήνη Ζωή Θάλεια Κατερίνα Μαρία Ξένια Σοφία Χλόη".split(),
        "m": "Αλέξης Βασίλης Γιώργος Ηλίας Κώστας Λουκάς Νίκος Πέτρος Στέφανος Φίλιππος".split(),
        "n": "Άγγελ Αντωνί Δανιήλ Ιωάν Μιχαήλ Ρουθ".split(),
    },
}
#: Each kind's pattern; ORDER is the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)*\.\p{L}{2,}",
    "iban": _OUT + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "ip6": r"(?<![\p{L}\p{N}:.])(?=[A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?=[0-9A-Fa-f:]*::)[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7})(?![\p{L}\p{N}:])",
    "ip": r"(?<![\p{L}\p{N}.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}" + _END,
    "phone": r"(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .\-]?[0-9]{2,4}){2,3}|" + _OUT + r"\(?[0-9]{3}\)?[ .\-][0-9]{3}[ .\-][0-9]{4})" + _END,
    "card": _OUT + r"[0-9](?:[ \-]?[0-9]){12,18}" + _END,
    "ssn": _OUT + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END,
    "name": _OUT + _TITLE + rf"\.? (?:{_OF}{_CASED}(?: {_OF}{_CASED})?+|{_PLAIN})" + _END,
}
ORDER = ("email", "iban", "ip6", "ip", "ssn", "phone", "card", "name")
ANY = "|".join(f"(?:{PATTERNS[k]})" for k in ORDER)
#: Texts without these have no entity; it is cheap to test.
_MAYBE = rf"[0-9@]|{_OUT}{_TITLE}\.? {_OF}[\p{{Lu}}\p{{Lt}}\p{{Lo}}]"
_SCRIPTS = (
    ("[a-z]", 97, 26), ("[A-Z]", 65, 26), ("[0-9]", 48, 10), ("[à-öø-ÿß]", 0xE0, 22), ("[À-ÖØ-Þ]", 0xC0, 22), ("[α-ω]", 0x3B1, 17), ("[а-я]", 0x430, 32), ("[А-Я]", 0x410, 32), ("[一-鿿]", 0x4E00, 250),
    (r"[\p{IsLatin}&&\p{Lu}]", 65, 26), (r"\p{IsLatin}", 97, 26), (r"[\p{IsGreek}&&\p{Lu}]", 0x391, 17), (r"\p{IsGreek}", 0x3B1, 17), (r"[\p{IsCyrillic}&&\p{Lu}]", 0x410, 32), (r"\p{IsCyrillic}", 0x430, 32),
    (r"[\p{IsArmenian}&&\p{Lu}]", 0x531, 38), (r"\p{IsArmenian}", 0x561, 38), (r"\p{IsGeorgian}", 0x10D0, 33), (r"\p{IsHebrew}", 0x5D0, 27), (r"\p{IsArabic}", 0x628, 19), (r"\p{IsDevanagari}", 0x905, 53), (r"\p{IsThai}", 0xE01, 46),
    (r"\p{IsHangul}", 0xAC00, 250), (r"\p{IsHiragana}", 0x3041, 86), (r"\p{IsKatakana}", 0x30A1, 90), (r"\p{IsHan}", 0x4E00, 250),
    # Scripts without a line of their own get Latin letters, other digits 0-9: what the patterns take is always replaced.
    (r"\p{Lu}", 65, 26), (r"\p{L}", 97, 26), (r"\p{N}", 48, 10),
)
#: Attempts of an e-mail or name before it grows by a letter at each more, and attempts in a row without a new surrogate after which other kinds fail.
SAME_LENGTH, STALLED = 3, 64


def kind_of(mention: str = "mention") -> Column:
    return reduce(lambda rest, k: F.when(F.col(mention).rlike(f"^(?:{PATTERNS[k]})$"), k).otherwise(rest), reversed(ORDER), F.lit("card"))


def canonical(mention: str = "mention", kind: str = "kind") -> Column:
    """What mentions of one entity have in common."""
    m, k = F.col(mention), F.col(kind)
    plus = F.when(m.startswith("+"), F.regexp_replace(F.regexp_extract(m, r"^\+([0-9]{1,3})", 0), r"\s", "")).otherwise("")
    return (
        F.when(k.isin("email", "ip6"), F.lower(m)).when(k == "ip", m).when(k == "iban", F.regexp_replace(m, " ", ""))
        .when(k == "phone", F.concat(plus, F.lit("/"), F.regexp_replace(F.expr(f"substring({mention}, length(regexp_extract({mention}, '^[+][0-9]{{1,3}}', 0)) + 1)"), "[^0-9]", "")))
        .when(k == "name", F.concat(_gender(m), F.lit("/"), F.lower(F.regexp_replace(m, rf"^{_TITLE}\.? ", "")))).otherwise(F.regexp_replace(m, "[^0-9]", ""))
    )


def _gender(m: Column) -> Column:
    return F.when(m.rlike(rf"^(?:{TITLES['f']})\b"), "f").when(m.rlike(rf"^(?:{TITLES['m']})\b"), "m").otherwise("n")


def _bytes(key: str, of: str = "kind, canon, attempt") -> str:
    """SQL: 128 pseudo-random bytes (as hex) of the entity and attempt, by HMAC-SHA-256."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in raw).hex().upper() for x in (0x36, 0x5C))
    mac = lambda i: f"sha2(concat(X'{outer}', unhex(sha2(concat(X'{inner}', encode(concat_ws('|', {of}, {i}), 'UTF-8')), 256))), 256)"
    return f"concat({', '.join(mac(i) for i in range(4))})"


def _char(c: str, i: str, rnd: str) -> str:
    """SQL: a character of the same script and kind as ``c`` from the digest's byte number ``i``."""
    byte = f"cast(conv(substring({rnd}, 2 * pmod({i}, 128) + 1, 2), 16, 10) as int)"
    return "CASE " + " ".join(f"WHEN {c} RLIKE r'^{p}$' THEN " + (f"char({a} + {byte} % {n})" if a < 256 else f"decode(unhex(concat('', lpad(hex({a} + {byte} % {n}), 4, '0'))), 'UTF-16BE')") for p, a, n in _SCRIPTS) + f" ELSE {c} END"


#: SQL: the given name in a name's canonical form.
FIRST = "substring_index(substring(canon, 3), ' ', 1)"
#: SQL: the surname.
LAST = "substring_index(substring(canon, 3), ' ', -1)"


def drawn(entities: DataFrame, key: str) -> DataFrame:
    """Adds rnd and own to (kind, canon, attempt). Parts of names are drawn on their own, so that a surname is the same with any given
    name and title; further attempts change the given name, or the surname where there is none."""
    alone = "instr(substring(canon, 3), ' ') = 0"
    rnd = f"IF(kind = 'name', {_bytes(key, f'kind, {FIRST}, attempt')}, {_bytes(key)})"
    own = f"IF(kind = 'name', {_bytes(key, f'kind, {LAST}, IF({alone}, attempt, 0)')}, null)"
    return entities.withColumn("rnd", F.expr(rnd)).withColumn("own", F.expr(own))


def surrogate() -> Column:
    """The surrogate of (kind, canon) at an attempt, in canonical form; needs the columns of ``drawn``."""
    mapped = lambda s, rnd="rnd": f"array_join(transform(split({s}, ''), (c, i) -> {_char('c', 'i', rnd)}), '')"
    octet = lambda i: f"cast(1 + cast(conv(substring(rnd, {4 * i + 1}, 4), 16, 10) as int) % 254 as string)"
    cut, local = "length(canon) - length(substring_index(canon, '.', -1))", "substring_index(canon, '@', 1)"
    luhn = lambda s: f"aggregate(transform(split(reverse({s}), ''), (c, i) -> CASE WHEN i % 2 = 1 THEN array(0,2,4,6,8,1,3,5,7,9)[cast(c as int)] ELSE cast(c as int) END), 0, (a, x) -> a + x) % 10"
    body = f"substring({mapped('canon')}, 1, length(canon) - 1)"
    card = f"CASE WHEN {luhn('canon')} = 0 THEN concat({body}, cast((10 - {luhn(f'concat({body}, 0)')}) % 10 as string)) ELSE {mapped('canon')} END"
    number = "cast(conv(substring(rnd, 1, 4), 16, 10) as int)"
    one = lambda names: f"element_at(array({', '.join(repr(x.lower()) for x in names)}), 1 + {number} % {len(names)})"
    pick = "CASE " + " ".join(f"WHEN substring(canon, 1, 1) = '{g}' AND substring(canon, 3, 1) RLIKE r'\\p{{Is{script}}}' THEN {one(names)}" for script, by in GIVEN_BY_SCRIPT.items() for g, names in by.items()) + f" ELSE {mapped(FIRST)} END"
    # An IPv6 address keeps its groups; from the third attempt on each has four digits, so that short ones do not run out.
    groups = f"CASE WHEN attempt < {SAME_LENGTH} THEN canon ELSE regexp_replace(canon, '[0-9a-f]+', 'ffff') END"
    hexed = f"array_join(transform(split({groups}, ''), (c, i) -> CASE WHEN c = ':' THEN c ELSE substring('0123456789abcdef', 1 + cast(conv(substring(rnd, 2 * pmod(i, 128) + 1, 2), 16, 10) as int) % 16, 1) END), '')"
    # Names and local parts have no fixed length, so their values never run out: repeats of their last letter are mapped too.
    grown = lambda s: f"concat({s}, repeat(coalesce(nullif(regexp_extract({s}, r'([\\p{{L}}\\p{{N}}])[^\\p{{L}}\\p{{N}}]*$', 1), ''), 'a'), greatest(0, attempt - {SAME_LENGTH - 1})))"
    # Addresses of private networks stay in theirs; others stay public.
    lead = lambda n: f"substring_index(canon, '.', {n})"
    private = f"canon RLIKE '^172[.](1[6-9]|2[0-9]|3[01])[.]'"
    ip = f"CASE WHEN {lead(1)} IN ('10', '127') THEN concat_ws('.', {lead(1)}, {octet(1)}, {octet(2)}, {octet(3)}) WHEN {lead(2)} IN ('192.168', '169.254') OR {private} THEN concat_ws('.', {lead(2)}, {octet(2)}, {octet(3)}) ELSE concat_ws('.', cast(130 + {octet(0)} % 38 as string), {octet(1)}, {octet(2)}, {octet(3)}) END"
    # An IBAN whose check digits are right gets right ones.
    digits = lambda s: f"array_join(transform(split({s}, ''), c -> IF(c RLIKE '[A-Z]', cast(ascii(c) - 55 as string), c)), '')"
    rest = lambda s: f"aggregate(split({digits(s)}, ''), 0, (a, d) -> (a * 10 + cast(d as int)) % 97)"
    bank = mapped("substring(canon, 5)")
    iban = f"IF({rest('concat(substring(canon, 5), substring(canon, 1, 4))')} = 1, transform(array({bank}), b -> concat(substring(canon, 1, 2), lpad(cast(98 - {rest(f'concat(b, substring(canon, 1, 2), {chr(39)}00{chr(39)})')} as string), 2, '0'), b))[0], concat(substring(canon, 1, 2), {mapped('substring(canon, 3)')}))"
    word = f"IF(instr(substring(canon, 3), ' ') > 0, {LAST}, {grown(LAST)})"
    picked = f"IF(attempt < {SAME_LENGTH}, {pick}, {mapped(grown(FIRST))})"
    given = f"CASE WHEN instr(canon, ' ') > 0 THEN concat({picked}, ' ') ELSE '' END"
    address = f"concat({grown(local)}, substring(canon, instr(canon, '@'), {cut} - instr(canon, '@') + 1))"
    return F.expr(f"""CASE kind WHEN 'email' THEN concat({mapped(address)}, substring_index(canon, '.', -1))
        WHEN 'ip6' THEN {hexed} WHEN 'ip' THEN {ip} WHEN 'card' THEN {card}
        WHEN 'phone' THEN concat(substring_index(canon, '/', 1), '/', {mapped("substring_index(canon, '/', -1)")})
        WHEN 'iban' THEN {iban}
        WHEN 'name' THEN concat(substring(canon, 1, 2), {given}, {mapped(word, 'own')}) ELSE {mapped('canon')} END""")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, sub): no two entities of a kind share a sub, and no sub is an entity.

    Names and e-mails grow until they find one; the other kinds keep their format and fail where its values run out.
    """
    left, done = K.cut(entities.select("kind", "canon").distinct()), None
    known, attempt, stalled, n = left.select("kind", F.col("canon").alias("sub")), 0, 0, left.count()
    while True:
        made = drawn(left.withColumn("attempt", F.lit(attempt)), key).select("kind", "canon", surrogate().alias("sub"))
        taken = known if done is None else known.union(done.select("kind", "sub"))
        first = made.groupBy("kind", "sub").agg(F.min("canon").alias("canon")).join(taken, ["kind", "sub"], "left_anti")
        good = K.cut(first.select("kind", "canon", "sub"))
        done = good if done is None else done.union(good)
        left = K.cut(left.join(good, ["kind", "canon"], "left_anti"))
        attempt, before, n = attempt + 1, n, left.count()
        if not n:
            return done
        stalled = stalled + 1 if n == before else 0
        if stalled == STALLED:
            kinds = ", ".join(r.kind for r in left.select("kind").distinct().orderBy("kind").collect())  # seven at most
            raise ValueError(f"{n} entities ({kinds}) have no surrogate of their format left: the corpus holds about half of its values")


def render() -> Column:
    """The mention with its surrogate in it: the surrogate's digits and letters in the mention's format and case."""
    plain = "CASE kind WHEN 'phone' THEN concat(regexp_replace(substring_index(sub, '/', 1), '[^0-9]', ''), substring_index(sub, '/', -1)) ELSE regexp_replace(sub, '[^A-Za-z0-9]', '') END"
    fill = "array_join(transform(split(mention, ''), (c, i) -> CASE WHEN c RLIKE '[A-Za-z0-9]' THEN substring(plain, length(regexp_replace(substring(mention, 1, i + 1), '[^A-Za-z0-9]', '')), 1) ELSE c END), '')"
    # Letters that a local part has more than the mention follow the case of its last one.
    more, local = "(length(sub) - length(mention))", "(instr(mention, '@') - 1)"
    at = f"substring(mention, 1 + CASE WHEN i < {local} THEN i WHEN i < {local} + {more} THEN {local} - 1 ELSE i - greatest(0, {more}) END, 1)"
    cased = f"array_join(transform(split(sub, ''), (c, i) -> CASE WHEN {at} = upper({at}) THEN upper(c) ELSE c END), '')"
    name = f"concat(regexp_extract(mention, '^{_TITLE}[.]? ', 0), initcap(substring(sub, 3)))"
    return F.expr(f"transform(array({plain}), plain -> CASE kind WHEN 'ip' THEN sub WHEN 'ip6' THEN CASE WHEN mention = upper(mention) THEN upper(sub) ELSE sub END WHEN 'email' THEN {cased} WHEN 'name' THEN {name} ELSE {fill} END)[0]")


#: Bytes of text that a task rebuilds at most on average.
TASK_BYTES = 4 << 20


def replace(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with every detected entity replaced, under a secret ``key``; ``count`` names a column for their number in each row.

    Null and empty texts stay as they are with no entity; repeated rows stay; an empty table gives an empty result. Other
    columns stay, whatever their names (those that begin with __pii are ours), but one named as ``count`` gives way to it.
    """
    names = [c for c in docs.columns if c != count]
    maybe = F.coalesce(F.col(text).rlike(_MAYBE) & F.col(text).rlike(ANY), F.lit(False))
    hits = K.cut(docs.where(maybe).select(*names, F.regexp_extract_all(text, F.lit(ANY), F.lit(0)).alias("__pii_found"), F.monotonically_increasing_id().alias("__pii_row")))
    mentions = K.cut(hits.select("__pii_row", F.posexplode("__pii_found").alias("__pii_at", "mention")))
    forms = K.cut(mentions.select("mention").distinct().withColumn("kind", kind_of()).withColumn("canon", canonical()))
    shown = K.cut(forms.join(surrogates(forms, key), ["kind", "canon"]).select("mention", render().alias("shown")))
    size = hits.agg(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).first()[0]
    tasks = max(1, -(-size // TASK_BYTES))
    listed = K.spread_join(mentions, shown, ["mention"]).groupBy("__pii_row").agg(F.sort_array(F.collect_list(F.struct("__pii_at", "shown"))).alias("__pii_shown"))
    whole = hits.repartition(tasks, "__pii_row").join(listed.repartition(tasks, "__pii_row"), "__pii_row")
    pieces, ours = F.split(text, ANY, -1), F.col("__pii_shown.shown")
    rebuilt = F.concat(F.array_join(F.zip_with(F.slice(pieces, F.lit(1), F.size(ours)), ours, lambda a, b: F.concat(a, b)), ""), F.element_at(pieces, -1))
    changed = whole.select(*[rebuilt.alias(c) if c == text else F.col(c) for c in names], *([F.size("__pii_found").cast("long").alias(count)] if count else []))
    return docs.where(~maybe).select(*names, *([F.lit(0).cast("long").alias(count)] if count else [])).union(changed)


#: The registered query's key. It is public: a production run gives its own.
QUERY_KEY = "the registered query's public key"


def query(spark, sf_dir: str) -> DataFrame:
    return replace(K.docs_of(spark, sf_dir).select("doc_id", "text"), QUERY_KEY, count="n_entities")
