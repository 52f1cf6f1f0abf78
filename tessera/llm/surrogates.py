"""Surrogates for personal data, with DataFrame functions only.

One pattern finds e-mail addresses, phone, card and social security numbers, IP addresses, IBANs, access
keys, assigned secrets and names after a form of address. An entity consists of parts (``parts``): the digits of
a number, the local part and the domain of an address, each word of a name. Every part is replaced by a
keyed permutation of the space of its format (``permuted``): four Feistel rounds over its characters
with SHA-256, a keyed shift that changes every character, and the four rounds undone. Digits stay digits, a
hexadecimal letter stays one, vowels stay vowels. So within a format two parts never get one
replacement and none keeps its own, however full the space is; the same part is replaced alike everywhere
(coreference across spellings of a number, addresses of one domain, a full name and its surname), and nobody
without the key can recompute it. Card numbers keep their first digit and IBANs their country, and each keeps
its check digits as right or as wrong as they were; octets stay in range; common given names go to
others of their gender and script; what was upper case is.

Collisions are checked over all parts of the table: a part whose replacement is itself a part of the table, or that
of another part, is permuted anew under the next attempt number, until free of both. After ``ATTEMPTS`` it keeps
its first replacement: in a space as full as four-digit codes of which all occur, every replacement is some
real code. It is still no other part's replacement and never its own. Common given names and local
parts of addresses are not held against real ones: the former are public, the latter get domains that are not.

A text is searched once: its pieces are stored, and only rows that hold a part with another attempt look it up.

Cases: null text stays null, an empty text stays empty; text outside entities is unchanged; repeated rows and
ties get equal replacements; the first alternative of the pattern wins where two could match; an empty
table gives no rows; columns of any name are kept; a secret without any letter or digit (of the
scripts in ``RANGES``) is not changed."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KEY, ROUNDS, ATTEMPTS = "tessera-surrogates-1", 4, 3
MALE = r"Mr|Mister|Herr|Monsieur|Señor|Signor|господин|г-н"
FEMALE = r"Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita|Signora|госпожа|г-жа"
EITHER = r"Dr|Prof"
SECRET = r"(?i:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key)"
_DIGITS = "|".join(
    [
        r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
        r"(?<![\w+])\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
        r"(?<![\w(])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)",
        r"(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)",
        r"(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
        r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
        r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
    ]
)
_IBAN = r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?)"
#: Every branch but the first starts with a look at one character, so most places of a text fail at once.
PATTERN = "|".join(
    [
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,}",
        rf"(?=[PpSsTtAa][AaWwEeOoPpCc]){SECRET}[ \t]?[=:][ \t]?(?:\"[^\"\s]{{4,}}\"|'[^'\s]{{4,}}'|[^\s\"',;]{{4,}})",
        r"(?=A)(?<![A-Za-z0-9])AKIA[0-9A-Z]{12,20}(?![A-Za-z0-9])",
        rf"(?=[0-9+(])(?:{_DIGITS})",
        rf"(?=[A-Z])(?<![A-Za-z0-9]){_IBAN}(?![A-Za-z0-9])",
        rf"(?=[MHFSDPгГ])(?<![\p{{L}}-])(?:{MALE}|{FEMALE}|{EITHER})\.? \p{{Lu}}\p{{Ll}}+(?:[ -]\p{{Lu}}\p{{Ll}}+){{0,2}}",
    ]
)
_IP = r"^\d{1,3}(\.\d{1,3}){3}$"
#: Common given names by gender and script; one is replaced by another of its list.
_GIVEN = {
    ("f", "latin"): "Anna Maria Elena Laura Sophie Clara Julia Emma Nora Alice Irene Paula Lucia Helena Marta Diana Mary Sarah Susan",
    ("m", "latin"): "Paul Martin Thomas Daniel Victor Simon Oscar David Felix Hugo Leon Adrian Julian Marco Robert Peter John James Michael",
    ("n", "latin"): "Robin Alex Kim Sascha Noel Jules Dominique Camille Andrea Chris Jamie Morgan Taylor Jordan Casey Charlie",
    ("f", "cyrillic"): "Анна Мария Елена Ольга Ирина Наталья Софья Вера Нина Дарья Юлия Алла Тамара Лидия Зоя Инна",
    ("m", "cyrillic"): "Иван Пётр Павел Андрей Сергей Виктор Олег Игорь Максим Юрий Антон Борис Глеб Роман Лев Фёдор",
    ("n", "cyrillic"): "Саша Женя Валя Слава Миша Шура Вася Паша Лёша Гоша Стася Тоня Ника Лера Кира Юра",
}
#: Classes of characters; each is replaced by one of its class. Characters in none are looked up in RANGES.
_CLASSES = {
    "plain": ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"],
    "secret": ["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ"],
    "name": ["aeiou", "bcdfghjklmnpqrstvwxyz", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "ьъ"],
}
#: (first code point, number) of letters of other scripts.
RANGES = [
    (0xC0, 23), (0xD8, 7), (0xDF, 24), (0xF8, 8), (0x100, 128), (0x391, 17), (0x3A3, 7), (0x3B1, 25), (0x410, 32), (0x430, 32), (0x5D0, 27),
    (0x621, 26), (0x641, 10), (0x905, 53), (0xE01, 46), (0x3041, 86), (0x30A1, 90), (0x4E00, 20902), (0xAC00, 11172),
]


# Expressions below are SQL text: thousands of column objects would cost seconds of the driver for every plan.

_names_used = itertools.count()


def let(value: str, body: Callable[[str], str]) -> str:
    """``body`` of a value that is computed once."""
    name = f"x{next(_names_used)}"
    return f"transform(array({value}), {name} -> {body(name)})[0]"


def kind(e: str) -> str:
    return rf"""CASE WHEN {e} RLIKE r'^{SECRET}[ \t]?[=:]' THEN 'secret' WHEN contains({e}, '@') THEN 'email' WHEN startswith({e}, 'AKIA') THEN 'key'
        WHEN {e} RLIKE r'{_IP}' THEN 'ip' WHEN {e} RLIKE r'^\d{{3}}-\d{{2}}-\d{{4}}$' THEN 'ssn' WHEN {e} RLIKE r'^\d(?:[ -]?\d){{12,18}}$' THEN 'card'
        WHEN {e} RLIKE r'^[+(\d]' THEN 'phone' WHEN {e} RLIKE r'^{_IBAN}$' THEN 'iban' ELSE 'name' END"""


# check digits


def _luhn(body: str) -> str:
    """Check digit of a number without it."""
    double = f"cast(substring({body}, length({body}) - i + 1, 1) as int)"
    return f"""((10 - aggregate(sequence(1, length({body})), 0, (acc, i) -> acc +
        CASE WHEN i % 2 = 0 THEN {double} WHEN {double} > 4 THEN {double} * 2 - 9 ELSE {double} * 2 END) % 10) % 10)"""


def _iban_check(country: str, account: str) -> str:
    """Check digits, 2 to 98, of an account (ISO 13616: letters count from 10, modulo 97)."""
    return f"""(98 - aggregate(split(concat({account}, {country}, '00'), ''), 0, (acc, c) ->
        CASE WHEN c = '' THEN acc WHEN ascii(c) < 58 THEN (acc * 10 + ascii(c) - 48) % 97 ELSE (acc * 100 + ascii(c) - 55) % 97 END))"""


# parts


def _bare(e: str) -> str:
    """A name without its form of address."""
    return rf"regexp_replace({e}, r'^(?:{MALE}|{FEMALE}|{EITHER})\.? ', '')"


def _assigned(e: str) -> str:
    """What stands before the value of an assigned secret."""
    return rf"regexp_extract({e}, r'^{SECRET}[ \t]?[=:][ \t]?[\x22\x27]?', 0)"


def _part(t: str, v: str) -> str:
    return f"named_struct('t', {t}, 'v', {v})"


def parts(e: str, k: str) -> str:
    """Array of (t: type with all that is kept, v: what is permuted) of an entity of kind ``k``.

    Of a name, every word is a part: the last one (its halves, if it has a hyphen) is the surname."""
    digits, compact, value = rf"regexp_replace({e}, r'\D', '')", f"replace({e}, ' ', '')", rf"regexp_replace(substring({e}, length({_assigned(e)}) + 1), r'[\x22\x27]$', '')"
    domain = f"substring_index(lower({e}), '@', -1)"
    card_check = f"pmod(cast(right({digits}, 1) as int) - {_luhn(f'left({digits}, length({digits}) - 1)')}, 10)"
    iban_check = f"pmod(cast(substring({compact}, 3, 2) as int) - {_iban_check(f'left({compact}, 2)', f'substring({compact}, 5)')}, 100)"
    email = f"""array({_part("'domain'", rf"regexp_extract({domain}, r'^(.*)\.[^.]*$', 1)")}, {_part(f"concat('local@', {domain})", f"substring_index(lower({e}), '@', 1)")})"""
    words = let(
        f"split(lower({_bare(e)}), ' ')",
        lambda w: f"flatten(transform({w}, (w, i) -> transform(split(w, '-'), h -> {_part(f"CASE WHEN i = size({w}) - 1 THEN 'surname' ELSE 'given' END", 'h')})))",
    )
    octets = rf"array_join(transform(split({e}, r'\.'), o -> cast(cast(o as int) as string)), '.')"
    return f"""CASE {k} WHEN 'email' THEN {email}
        WHEN 'phone' THEN CASE WHEN startswith({e}, '+') THEN array({_part(f"concat('phone+', left({digits}, 1))", f"substring({digits}, 2)")}) ELSE array({_part("'phone+1'", digits)}) END
        WHEN 'ssn' THEN array({_part("'ssn'", digits)})
        WHEN 'card' THEN array({_part(f"concat_ws('/', 'card', left({digits}, 1), {card_check})", f"substring({digits}, 2, length({digits}) - 2)")})
        WHEN 'ip' THEN array({_part("'ip'", octets)})
        WHEN 'iban' THEN array({_part(f"concat_ws('/', 'iban', left({compact}, 2), {iban_check})", f"substring({compact}, 5)")})
        WHEN 'key' THEN array({_part("'key'", f"substring({e}, 5)")})
        WHEN 'secret' THEN array({_part("'secret'", value)})
        ELSE {words} END"""


def named(p: str) -> str:
    return f"concat({p}.t, ':', {p}.v)"


# the permutation


def _stream(seed: str, n: str) -> str:
    """Digests that hold ``n`` keyed values of 16 bits."""
    return f"transform(sequence(0, cast((greatest({n}, 1) - 1) div 16 as int)), c -> sha2(concat({seed}, '|', cast(c as string)), 256))"


def _draw(stream: str, i: str) -> str:
    return f"cast(conv(substring(element_at({stream}, cast({i} div 16 as int) + 1), {i} % 16 * 4 + 1, 4), 16, 10) as int)"


def _shifted(values: str, sizes: str, seed: str, sign: str) -> str:
    return let(_stream(seed, f"size({values})"), lambda s: f"transform({values}, (v, j) -> pmod(v {sign} {_draw(s, 'j')}, element_at({sizes}, j + 1)))")


def _halves(l: str, r: str, ls: str, rs: str) -> str:  # noqa: E741
    return f"named_struct('l', {l}, 'r', {r}, 'ls', {ls}, 'rs', {rs})"


def _feistel(state: str, seed: str, back: bool) -> str:
    of = lambda half: f"concat({seed}, '|', cast(i as string), '|', array_join(cast({half} as array<string>), ','))"
    if back:
        step = _halves(_shifted("acc.r", "acc.rs", of("acc.l"), "-"), "acc.l", "acc.rs", "acc.ls")
    else:
        step = _halves("acc.r", _shifted("acc.l", "acc.ls", of("acc.r"), "+"), "acc.rs", "acc.ls")
    rounds = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    return f"aggregate(array({', '.join(map(str, rounds))}), {state}, (acc, i) -> {step})"


def _moved(values: str, sizes: str, seed: str) -> str:
    """Every value by a keyed amount other than 0."""
    size = f"element_at({sizes}, j + 1)"
    return let(_stream(seed, f"size({values})"), lambda s: f"transform({values}, (v, j) -> CASE WHEN {size} < 2 THEN v ELSE (v + 1 + {_draw(s, 'j')} % greatest({size} - 1, 1)) % {size} END)")


def _class_table(name: str) -> str:
    """All characters of the classes, and where the class of each starts (from 1) and its size."""
    first, starts, sizes = 1, [], []
    for c in _CLASSES[name]:
        starts += [first] * len(c)
        sizes += [len(c)] * len(c)
        first += len(c)
    return f"named_struct('chars', '{''.join(_CLASSES[name])}', 'starts', array({str(starts)[1:-1]}), 'sizes', array({str(sizes)[1:-1]}))"


def _symbols(p: str, table: str) -> str:
    """(c, base, size, idx) of each character, or octet, of a part; size 1: stays."""
    symbol = lambda base, size, idx: f"named_struct('c', c, 'base', cast({base} as int), 'size', cast({size} as int), 'idx', cast({idx} as int))"
    fixed = symbol("0", "1", "0")
    octet = f"CASE WHEN cast(c as int) BETWEEN 1 AND 254 THEN {symbol('1', '254', 'cast(c as int) - 1')} WHEN cast(c as int) > 255 THEN {symbol('256', '744', 'cast(c as int) - 256')} ELSE {fixed} END"
    ranges = "array(" + ", ".join(f"struct({first} AS first, {n} AS n)" for first, n in RANGES) + ")"
    other = let(f"filter({ranges}, r -> ascii(c) >= r.first AND ascii(c) < r.first + r.n)", lambda r: f"CASE WHEN size({r}) > 0 THEN {symbol(f'-{r}[0].first', f'{r}[0].n', f'ascii(c) - {r}[0].first')} ELSE {fixed} END")
    start = f"element_at({table}.starts, {{at}})"
    character = let(f"instr({table}.chars, c)", lambda at: f"CASE WHEN {at} > 0 THEN {symbol(start.format(at=at), f'element_at({table}.sizes, {at})', f'{at} - {start.format(at=at)}')} WHEN ascii(c) < 128 THEN {fixed} ELSE {other} END")
    return rf"CASE WHEN {p}.t = 'ip' THEN transform(split({p}.v, r'\.'), c -> {octet}) ELSE transform(filter(split({p}.v, ''), c -> c <> ''), c -> {character}) END"


def permuted(p: str, attempt: str, key: str = KEY) -> str:
    """The replacement of a part (a column or variable of t, v); for a given attempt no two parts of one type and
    pattern share theirs, and none is its own (unless nothing in it can be replaced)."""

    def of_symbols(x: str) -> str:
        half = lambda field, rest: f"filter(transform({x}.s, s -> s.{field}), (s, i) -> i % 2 = {rest})"
        state = _feistel(_halves(half("idx", 0), half("idx", 1), half("size", 0), half("size", 1)), f"{x}.seed", back=False)
        moved = let(state, lambda m: _halves(_moved(f"{m}.l", f"{m}.ls", f"concat({x}.seed, '|l')"), _moved(f"{m}.r", f"{m}.rs", f"concat({x}.seed, '|r')"), f"{m}.ls", f"{m}.rs"))

        def shown(m: str) -> str:
            idx = f"CASE WHEN i % 2 = 0 THEN element_at({m}.l, cast(i div 2 as int) + 1) ELSE element_at({m}.r, cast(i div 2 as int) + 1) END"
            one = let(idx, lambda n: f"""CASE WHEN s.size < 2 THEN s.c WHEN {p}.t = 'ip' THEN cast(s.base + {n} as string)
                WHEN s.base > 0 THEN substring({x}.tab.chars, s.base + {n}, 1) ELSE decode(unhex(lpad(hex(cast({n} - s.base as bigint)), 4, '0')), 'UTF-16BE') END""")
            return let(f"transform({x}.s, (s, i) -> {one})", lambda c: f"CASE WHEN {p}.t = 'ip' THEN array_join({c}, '.') ELSE array_join({c}, '') END")

        return let(_feistel(moved, f"{x}.seed", back=True), shown)

    table = f"CASE WHEN {p}.t = 'secret' THEN {_class_table('secret')} WHEN {p}.t IN ('surname', 'given') THEN {_class_table('name')} ELSE {_class_table('plain')} END"
    seed = f"concat('{key}|', cast({attempt} as string), '|', {p}.t)"
    whole = let(table, lambda tab: let(f"named_struct('s', {_symbols(p, tab)}, 'tab', {tab}, 'seed', {seed})", of_symbols))
    listed = "map(" + ", ".join(f"'{a}', '{b}'" for a, b in _given_pairs(key)) + ")"
    return f"CASE WHEN {p}.t = 'given' AND map_contains_key({listed}, {p}.v) THEN element_at({listed}, {p}.v) ELSE concat({whole}, CASE WHEN {p}.t = 'domain' THEN '.example' ELSE '' END) END"


def _given_pairs(key: str) -> list[tuple[str, str]]:
    """Each common given name and the next in a keyed order of its list, in lower case."""
    pairs = []
    for names in _GIVEN.values():
        order = sorted(names.lower().split(), key=lambda n: hashlib.sha256(f"{key}|{n}".encode()).digest())
        pairs += list(zip(order, order[1:] + order[:1], strict=True))
    return pairs


# entities


def _fill(surface: str, new: str, what: str) -> str:
    """The characters of ``new`` in order for those of the (short) surface that match ``what``."""
    return f"""aggregate(split({surface}, ''), named_struct('out', '', 'i', 0), (acc, c) -> CASE WHEN c RLIKE r'{what}'
        THEN named_struct('out', concat(acc.out, substring({new}, acc.i + 1, 1)), 'i', acc.i + 1) ELSE named_struct('out', concat(acc.out, c), 'i', acc.i) END).out"""


def _cased(surface: str, new: str) -> str:
    """``new`` (as long as ``surface``) in upper case where the surface is."""
    return f"array_join(zip_with(split({surface}, ''), split({new}, ''), (s, n) -> CASE WHEN s RLIKE '^[A-Z]$' THEN upper(n) ELSE n END), '')"


def _shown(e: str, k: str, p: str, new: str) -> str:
    """The entity with the replacements ``new`` of its parts ``p``."""
    digits, compact, kept = rf"regexp_replace({e}, r'\D', '')", f"replace({e}, ' ', '')", f"split({p}[0].t, '/')"
    domain = f"substring({e}, instr({e}, '@') + 1)"
    email = rf"""concat({_cased(f"left({e}, instr({e}, '@') - 1)", f"{new}[1]")}, '@',
        {_cased(rf"regexp_extract({domain}, r'^(.*)\.[^.]*$', 1)", f"left({new}[0], length({new}[0]) - 8)")}, '.example.', regexp_extract({domain}, r'\.([^.]*)$', 1))"""
    card = let(f"concat({kept}[1], {new}[0])", lambda c: let(f"concat({c}, cast(({_luhn(c)} + cast({kept}[2] as int)) % 10 as string))", lambda whole: _fill(e, whole, r"^\d$")))
    country = f"left({compact}, 2)"
    iban = let(f"concat({country}, lpad(cast(({_iban_check(country, f'{new}[0]')} + cast({kept}[2] as int)) % 100 as string), 2, '0'), {new}[0])", lambda whole: _fill(e, whole, "^[A-Z0-9]$"))
    phone = let(f"CASE WHEN startswith({e}, '+') THEN concat(left({digits}, 1), {new}[0]) ELSE {new}[0] END", lambda whole: _fill(e, whole, r"^\d$"))
    secret = let(_assigned(e), lambda before: f"concat({before}, {new}[0], substring({e}, length({before}) + length({p}[0].v) + 1, 1))")
    name = let(_bare(e), lambda bare: f"concat(left({e}, length({e}) - length({bare})), array_join(zip_with(transform({new}, n -> initcap(n)), regexp_extract_all({bare}, '[ -]', 0), (n, s) -> concat(n, coalesce(s, ''))), ''))")
    return f"""CASE {k} WHEN 'email' THEN {email} WHEN 'phone' THEN {phone} WHEN 'ssn' THEN {_fill(e, f'{new}[0]', r'^\d$')} WHEN 'card' THEN {card} WHEN 'ip' THEN {new}[0]
        WHEN 'iban' THEN {iban} WHEN 'key' THEN concat('AKIA', {new}[0]) WHEN 'secret' THEN {secret} ELSE {name} END"""


def surrogate(e: str, attempts: str | None = None, key: str = KEY) -> str:
    """Replacement of an entity as it stands in the text; ``attempts``: a map of parts (``named``)."""
    attempt = lambda q: "0" if attempts is None else f"coalesce(element_at({attempts}, {named(q)}), 0)"
    return let(kind(e), lambda k: let(parts(e, k), lambda p: let(f"transform({p}, q -> {permuted('q', attempt('q'), key)})", lambda new: _shown(e, k, p, new))))


# tables


def _again(found: DataFrame, key: str) -> DataFrame | None:
    """(part, attempt) of the parts that need another attempt, of all parts (t, v); None if none does."""
    common_names = [n for n, _ in _given_pairs(key)]
    real = found.where(~F.col("t").startswith("local@") & ~((F.col("t") == "given") & F.col("v").isin(common_names)))
    new = lambda attempt: F.expr(let("named_struct('t', t, 'v', v)", lambda p: permuted(p, str(attempt), key)))
    public = found.sparkSession.createDataFrame([("given", n) for n in common_names], "t string, s string")
    made = common.stored(real.withColumn("s", new(0)), "surrogates")
    taken = made.select("t", "s", F.col("v").alias("owner"), F.lit(False).alias("real")).unionByName(real.select("t", F.col("v").alias("s"), F.lit(None).cast("string").alias("owner"), F.lit(True).alias("real")))
    taken = taken.unionByName(public.select("t", "s", F.lit(None).cast("string").alias("owner"), F.lit(True).alias("real")))
    clash = taken.groupBy("t", "s").agg(F.min("owner").alias("stays"), F.max("owner").alias("last"), F.bool_or("real").alias("real")).where("stays is not null and (real or stays <> last)")
    left = common.stored(made.join(clash, ["t", "s"]).where("real or v <> stays").select("t", "v"), "clashes")
    settled: list[DataFrame] = []
    for attempt in range(1, ATTEMPTS + 1):
        if left.isEmpty():
            break
        tried = common.stored(left.withColumn("s", new(attempt)), "tried")
        occupied = real.select("t", F.col("v").alias("s")).unionByName(made.select("t", "s")).unionByName(public)
        for earlier in settled:
            occupied = occupied.unionByName(earlier.select("t", "s"))
        once = tried.groupBy("t", "s").agg(F.min("v").alias("v"))
        free = once.join(occupied, ["t", "s"], "left_anti")
        settled.append(common.stored(free.select("t", "v", "s", F.lit(attempt).alias("attempt")), "settled"))
        left = common.stored(left.join(settled[-1], ["t", "v"], "left_anti"), "clashes")
    if not settled:
        return None
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select(F.concat("t", F.lit(":"), "v").alias("part"), "attempt")


_MARK = "\u0001"


def _pieces(text: Column) -> Column:
    """Text in pieces: every other one, from the second, is an entity."""
    marked = F.split(F.regexp_replace(text, PATTERN, f"{_MARK}$0{_MARK}"), _MARK, -1)
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    slow = F.flatten(F.zip_with(F.split(text, PATTERN, -1), found, lambda s, e: F.when(e.isNull(), F.array(s)).otherwise(F.array(s, e))))
    return F.when(F.instr(text, _MARK) > 0, slow).otherwise(marked)


def pseudonymize(docs: DataFrame, key: str = KEY, count: str | None = None) -> DataFrame:
    """docs with the entities of ``text`` replaced, and their number as column ``count`` if it is named."""
    others = [c for c in docs.columns if c != "text"]
    row = F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)])
    held = common.stored(docs.select(row.alias("row"), F.monotonically_increasing_id().alias("id"), _pieces(F.col("text")).alias("pieces")), "pieces")
    of_entities = f"flatten(transform(array_distinct(filter(pieces, (p, i) -> i % 2 = 1)), e -> {let(kind('e'), lambda k: parts('e', k))}))"
    with_some = held.where(F.size("pieces") > 1)
    found = common.stored(with_some.select(F.explode(F.expr(of_entities)).alias("p")).groupBy("p.t", "p.v").agg(F.lit(1).alias("one")).select("t", "v"), "parts")
    again = _again(found, key)

    def shown(df: DataFrame, attempts: str | None) -> DataFrame:
        text = F.expr(f"array_join(transform(pieces, (e, i) -> CASE WHEN i % 2 = 0 THEN e ELSE {surrogate('e', attempts, key)} END), '')")
        n = [] if count is None else [F.coalesce(F.floor(F.size("pieces") / 2).cast("int"), F.lit(0)).alias(count)]
        new = F.when(F.size("pieces") > 1, text).otherwise(F.col("pieces")[0])
        return df.select(*[new.alias(c) if c == "text" else F.col("row")[f"c{others.index(c)}"].alias(c) for c in docs.columns], *n)

    if again is None:
        out = shown(held, None)
        common.forget_parses(docs.sparkSession)
        return out
    asked = with_some.select("id", F.explode(F.expr(f"array_distinct(transform({of_entities}, q -> {named('q')}))")).alias("part")).join(again, "part")
    maps = asked.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("part", "attempt"))).alias("attempts"))
    # rows without entities move nowhere
    out = shown(held.where("pieces is null or size(pieces) = 1"), None).unionByName(shown(with_some.join(maps, "id", "left"), "attempts"))
    common.forget_parses(docs.sparkSession)
    return out


def op4_surrogates(spark, sf_dir: str) -> DataFrame:
    return pseudonymize(common.tables(spark, sf_dir, "documents").select("doc_id", "text"), count="n_entities")
