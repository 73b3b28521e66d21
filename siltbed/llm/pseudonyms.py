"""PII: format-preserving Feistel pseudonyms.

Card numbers (Luhn-valid, 13 to 19 digits), IBANs (mod 97), social security
numbers, telephone numbers, IPv4 and IPv6 addresses, calendar dates, e-mail
addresses and secrets (hexadecimal tokens, access keys) are replaced by other
values of the same format.  A value is split into two residues that a keyed
Feistel network changes in turn, eight times.  Every step can be undone, so
the map is a permutation of the format's values: equal values stay equal in
all documents, different ones stay different, and ``restore`` takes the
pseudonyms back under the same key.  Dates move within 1800-01-01 to
2199-12-31 (146,097 = 189 x 773 days, one whole cycle of the calendar); cards
and IBANs keep valid check digits; e-mail addresses keep their domain and the
case of their letters; IPv4 addresses lose leading zeros.  Numbers that fail
validation are no PII and stay.

A card may be any groups of a longer run of digit groups; the run is searched
in blocks that end where no card can lie across.  A run in which other windows
become valid by chance after the change is the one case that ``restore`` may
read differently.

The key has no default: it is the parameter or the session's
``spark.siltbed.pii.key``.

All of it is built from SQL functions; texts that can hold no value are not
searched at all.  Every pattern is bounded or possessive, so Java's matcher
neither recurses with the length of a text nor tries a place twice.

Defined cases: a null text stays null with no finding; empty texts stay
empty; long texts are searched whole; repeated rows get the same pseudonyms;
an empty table gives an empty result; other columns, whatever their names, are
kept as they are; row order and ties do not matter, as every row is changed by
itself.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
KEY_SETTING = "spark.siltbed.pii.key"
IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
HEX = r"(?![0-9]++(?![0-9A-Za-z]))(?:[0-9a-f]{16,}+|[0-9A-F]{16,}+)(?![0-9A-Za-z])"
DAY = r"(?:1[89]|2[01])[0-9]{2}[-/](?:0[1-9]|1[0-2])[-/](?:0[1-9]|[12][0-9]|3[01])(?![0-9])"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL = r"(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])"
MAIL = r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}\."
#: What ends a run of card digits before its next group, as it is searched by itself.
OTHER = "|".join((IP, HEX, DAY, SSN, LOCAL, MAIL))
H4 = r"[0-9A-Fa-f]{1,4}+"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,127}+",
    "ipv6": rf"(?<![0-9A-Za-z:.])(?:{H4}(?::{H4}){{7}}|{H4}(?::{H4}){{0,5}}::(?:{H4}(?::{H4}){{0,5}})?)(?![0-9A-Za-z:])",
    "ip": rf"(?<![0-9.]){IP}",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2})(?![0-9])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
    "ssn": rf"(?<![0-9-]){SSN}",
    "local": rf"(?<![0-9-]){LOCAL}",
    "key": r"(?<![A-Z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Z0-9])",
    "token": r"(?<![A-Za-z0-9])(?:gh[oprsu]_[A-Za-z0-9]{36}|AIza[A-Za-z0-9_-]{35}|xox[abprs]-[A-Za-z0-9-]{10,72}+|sk-[A-Za-z0-9_-]{20,128}+)(?![A-Za-z0-9])",
    "iban": rf"(?<![A-Za-z0-9]){IBAN}",
    "hex": rf"(?<![0-9A-Za-z]){HEX}",
    # Groups of at most 19 digits, 13 digits or more in all.
    "card": rf"(?<![0-9])(?=[0-9](?:(?:[ -](?!{OTHER}))?[0-9]){{12}})[0-9]{{1,19}}+(?![0-9])(?:[ -](?!{OTHER})[0-9]{{1,19}}+(?![0-9]))*+",
}
ANY = "|".join(PATTERNS.values())
#: A text with none of these and no run of sixteen letters a to f holds no value.
SIGNS = (*"1023456789@", "AKIA", "ASIA", "gho_", "ghp_", "ghr_", "ghs_", "ghu_", "AIza", "xox", "sk-")
PREFIX = "^(gh[oprsu]_|AIza|xox[abprs]-|sk-)"
#: Days of one calendar cycle and its two residues.
FIRST_DAY, DATE_A, DATE_B = "1800-01-01", 189, 773
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
BASE26 = "0123456789abcdefghijklmnop"
#: Length of the longest card with its separators; characters of a block of a run, and from which on a block is cut anyhow.
CARD, BLOCK, LONG = 37, 1024, 2048


class Key(NamedTuple):
    secret: str
    back: bool = False  #: from pseudonyms to values


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def feistel(x: Column, a: Column, b: Column, key: str, kind: str | Column, tweak: Column, back: bool = False) -> Column:
    """A keyed permutation of 0 .. a*b - 1, or its inverse."""
    kind = F.lit(kind) if isinstance(kind, str) else kind

    def noise(c: Column, i: Column, v: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), c["kind"], c["tweak"], i.cast("string"), v.cast("string")), 256), 1, 12), 16, 10).cast("long")

    def rounds(c: Column) -> Column:
        def turn(s: Column, i: Column) -> Column:
            even = i % 2 == 0
            step = noise(c, i, F.when(even, s["b"]).otherwise(s["a"]))
            own = F.when(even, s["a"]).otherwise(s["b"])
            moved = F.pmod(own - step if back else own + step, F.when(even, c["a"]).otherwise(c["b"]))
            return let(moved, lambda v: F.struct(F.when(even, v).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(v).alias("b")))

        begin = F.struct(_div(c["x"], c["b"]).alias("a"), (c["x"] % c["b"]).alias("b"))
        turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
        return F.aggregate(turns, begin, turn, lambda s: s["a"] * c["b"] + s["b"])

    return let(F.struct(x.cast("long").alias("x"), a.cast("long").alias("a"), b.cast("long").alias("b"), kind.alias("kind"), tweak.cast("string").alias("tweak")), rounds)


def _div(x: Column, y: Column | int) -> Column:
    return F.call_function("div", x, y if isinstance(y, Column) else F.lit(y))


def _numeral(p: Column, sixteen: Column, key: Key, kind: Column, tweak: Column) -> Column:
    """Permutes digits, letters of one case or hexadecimal digits among those of the same length; at most 62 bits."""

    def move(c: Column) -> Column:
        half = _div(c["n"], 2)
        power = lambda n: F.round(F.pow(c["base"].cast("double"), n)).cast("long")
        value = F.call_function("conv", c["s"], c["base"], F.lit(10)).cast("long")
        moved = feistel(value, power(half), power(c["n"] - half), key.secret, kind, F.concat_ws(",", c["n"].cast("string"), tweak.cast("string")), key.back)
        out = F.lpad(F.lower(F.call_function("conv", moved.cast("string"), F.lit(10), c["base"])), c["n"], F.lit("0"))
        return let(out, lambda v: F.when(c["base"] != 26, v).when(p.rlike("^[A-Z]"), F.upper(F.translate(v, BASE26, ALPHABET))).otherwise(F.translate(v, BASE26, ALPHABET)))

    base = F.when(sixteen, 16).when(p.rlike("^[0-9]"), 10).otherwise(26)
    return let(F.struct(F.when(sixteen, p).otherwise(F.translate(F.lower(p), ALPHABET, BASE26)).alias("s"), F.length(p).alias("n"), base.alias("base")), move)


def _moved(body: Column, kind: Column, key: Key) -> Column:
    """Characters of a class become others of it, in runs of at most 12; marks stay.

    A hexadecimal token is moved in lower case, so either case gets one pseudonym, and moved on while it
    holds no letter, as it would be none then.
    """

    def once(s: Column) -> Column:
        sixteen = kind.isin("hex", "ipv6")
        pieces = F.when(sixteen, F.regexp_extract_all(F.lower(s), F.lit("[0-9a-f]{1,12}"), F.lit(0))).otherwise(F.regexp_extract_all(s, F.lit("[a-z]{1,12}|[A-Z]{1,12}|[0-9]{1,12}|[^A-Za-z0-9]+"), F.lit(0)))
        return F.array_join(F.transform(pieces, lambda p, i: F.when(p.rlike("^[^A-Za-z0-9]"), p).otherwise(_numeral(p, sixteen, key, kind, i))), "")

    again = lambda s: (kind == "hex") & ~s.rlike("[a-f]")
    return F.aggregate(F.sequence(F.lit(1), F.when(kind == "hex", 8).otherwise(1)), body, lambda s, i: F.when((i == 1) | again(s), once(s)).otherwise(s))


def _refill(form: Column, characters: Column, member: Column) -> Column:
    """The characters of ``form`` that match ``member`` replaced in order."""

    def fill(c: Column) -> Column:
        before = lambda i: F.length(F.regexp_replace(F.substring(c["form"], F.lit(1), i), F.concat(F.lit("(?!"), c["member"], F.lit(").")), F.lit("")))
        one = lambda i: F.substring(c["form"], i, F.lit(1))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(c["form"])), lambda i: F.when(F.rlike(one(i), c["member"]), F.substring(c["new"], before(i), F.lit(1))).otherwise(one(i))), "")

    return let(F.struct(form.alias("form"), characters.alias("new"), member.alias("member")), fill)


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of digits from the right, those at places of parity ``doubled`` counted twice (less 9 if over 9)."""

    def total(t: Column) -> Column:
        def add(s: Column, i: Column) -> Column:
            return s + let(F.substring(t, F.length(t) - i, F.lit(1)).cast("int"), lambda d: F.when(i % 2 == doubled, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))

        return F.aggregate(F.sequence(F.lit(0), F.length(t) - 1), F.lit(0), add)

    return let(digits, total)


def _mod97(s: Column) -> Column:
    """A text of digits and capitals (A as 10 to Z as 35) modulo 97."""

    def add(r: Column, c: Column) -> Column:
        return let(F.conv(c, 36, 10).cast("long"), lambda v: F.when(v < 10, r * 10 + v).otherwise(r * 100 + v) % 97)

    return F.aggregate(F.split(s, ""), F.lit(0).cast("long"), add)


# ---- what a match is, and its value as a number


def _only(m: Column, characters: str) -> Column:
    return F.regexp_replace(m, f"[^{characters}]", "")


def _octets(m: Column) -> Column:
    return F.transform(F.split(m, r"\."), lambda o: o.cast("long"))


def _day(m: Column) -> Column:
    return F.try_to_timestamp(F.replace(m, F.lit("/"), F.lit("-")), F.lit("yyyy-MM-dd")).cast("date")


def _first_day() -> Column:
    return F.lit(FIRST_DAY).cast("date")


def _iban_ok(m: Column) -> Column:
    return let(_only(m, "A-Z0-9"), lambda s: F.length(s).between(15, 34) & (_mod97(F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))) == 1))


def _kind(m: Column) -> Column:
    """The format of a match, or null if it fails that format's validation; a run of digits may hold cards."""
    groups = F.regexp_count(m, F.lit("[0-9A-Fa-f]+"))
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        # Three groups or more with a digit among them, at most seven where :: stands for some.
        .when(F.contains(m, F.lit(":")), F.when(m.rlike("[0-9]") & (groups >= 3) & ((groups <= 7) | ~F.contains(m, F.lit("::"))), "ipv6"))
        .when(m.rlike("^[0-9]{1,3}([.][0-9]{1,3}){3}$"), F.when(F.forall(_octets(m), lambda o: o <= 255), "ip"))
        .when(m.rlike("^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}$"), F.when(_day(m).between(_first_day(), F.lit("2199-12-31").cast("date")), "date"))
        .when(m.startswith("+"), "phone")
        # No area 000, 666 or 900 and above, no group 00, no serial 0000.
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(~m.rlike("^(000|666|9)|-00-|0000$"), "ssn"))
        # An area code and an exchange begin with 2 to 9.
        .when(m.rlike("^([(][0-9]{3}[)] ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}$"), F.when(_only(m, "0-9").rlike("^[2-9]..[2-9]"), "local"))
        .when(m.rlike("^A[KS]IA[A-Z0-9]{16}$"), "key")
        .when(m.rlike(PREFIX), "token")
        .when(m.rlike("^([0-9a-f]{16,}|[0-9A-F]{16,})$") & m.rlike("[a-fA-F]"), "hex")
        .when(m.rlike("^[A-Z]") & _iban_ok(m), "iban")
        .otherwise("run")
    )


def _number(m: Column, k: Column, key: Key) -> Column:
    """The pseudonym of a format whose values are numbered."""
    part = lambda at, n: F.substring(_only(m, "0-9"), at, n).cast("long")
    ip = F.aggregate(_octets(m), F.lit(0).cast("long"), lambda s, o: s * 256 + o)
    date = F.datediff(_day(m), _first_day()).cast("long")
    ssn = ((part(1, 3) - F.when(part(1, 3) > 666, 2).otherwise(1)) * 99 + part(4, 2) - 1) * 9999 + part(6, 4) - 1
    local = (part(1, 3) - 200) * 8_000_000 + part(4, 7) - 2_000_000
    pick = lambda *c: F.when(k == "ip", c[0]).when(k == "date", c[1]).when(k == "ssn", c[2]).otherwise(c[3])
    moved = feistel(pick(ip, date, ssn, local), pick(*map(F.lit, (65536, DATE_A, 898, 800))), pick(*map(F.lit, (65536, DATE_B, 99 * 9999, 8_000_000))), key.secret, k, F.lit(""), key.back)

    def write(v: Column) -> Column:
        octets = F.concat_ws(".", *[(F.shiftright(v, 8 * j) % 256).cast("string") for j in (3, 2, 1, 0)])
        iso = F.date_format(F.date_add(_first_day(), v.cast("int")), "yyyy-MM-dd")
        day = F.when(F.contains(m, F.lit("/")), F.replace(iso, F.lit("-"), F.lit("/"))).otherwise(iso)
        area = _div(v, 99 * 9999) + 1
        three = F.format_string("%03d-%02d-%04d", area + F.when(area >= 666, 1).otherwise(0), _div(v, 9999) % 99 + 1, v % 9999 + 1)
        ten = _refill(m, F.concat((_div(v, 8_000_000) + 200).cast("string"), (v % 8_000_000 + 2_000_000).cast("string")), F.lit("[0-9]"))
        return pick(octets, day, three, ten)

    return let(moved, write)


def _characters(m: Column, k: Column, key: Key) -> Column:
    """The pseudonym of a format whose characters move within their classes."""
    plain = F.when(k == "iban", _only(m, "A-Z0-9")).when(k == "phone", _only(m, "0-9")).otherwise(m)

    def parts(s: Column) -> Column:
        before = (
            F.when(k.isin("key", "iban"), F.substring(s, 1, 4))
            .when(k == "token", F.regexp_extract(s, PREFIX, 0))
            .when(k == "phone", F.substring(s, F.lit(1), F.length(s) - 10))
            .otherwise("")
        )
        after = F.when(k == "email", F.concat(F.lit("@"), F.substring_index(s, "@", -1))).otherwise("")
        body = lambda a, z: F.when(k == "ipv6", F.replace(s, F.lit(":"), F.lit(""))).otherwise(F.substring(s, F.length(a) + 1, F.length(s) - F.length(a) - F.length(z)))
        return let(F.struct(before.alias("a"), after.alias("z")), lambda e: F.struct(s.alias("s"), e["a"].alias("a"), body(e["a"], e["z"]).alias("body"), e["z"].alias("z")))

    def write(e: Column, new: Column) -> Column:
        country = F.substring(e["a"], 1, 2)
        iban = F.concat(country, F.lpad((F.lit(98) - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0"), new)
        whole = F.when(k == "iban", iban).when((k == "hex") & m.rlike("[A-F]"), F.upper(new)).when((k == "ipv6") & m.rlike("[A-F]"), F.upper(new)).otherwise(F.concat(e["a"], new, e["z"]))
        member = F.when(k == "ipv6", "[0-9A-Fa-f]").when(k == "iban", "[A-Z0-9]").otherwise("[0-9]")
        return let(whole, lambda w: F.when(k.isin("ipv6", "iban", "phone"), _refill(m, w, member)).otherwise(w))

    salt = lambda e: F.when(k == "phone", F.concat(k, e["a"])).otherwise(k)
    return let(let(plain, parts), lambda e: let(let(salt(e), lambda kind: _moved(e["body"], kind, key)), lambda new: write(e, new)))


def _card(m: Column, key: Key) -> Column:
    account = let(_only(m, "0-9"), lambda d: F.substring(d, F.lit(1), F.length(d) - 1))
    moved = let(account, lambda d: _numeral(d, F.lit(False), key, F.lit("card"), F.lit("")))
    return _refill(m, let(moved, lambda d: F.concat(d, ((F.lit(10) - luhn_sum(d, 0) % 10) % 10).cast("string"))), F.lit("[0-9]"))


# ---- cards in runs of digit groups


def _windows(m: Column) -> Column:
    """All windows from one group's begin to a group's end that are valid by Luhn, best first.

    One that begins like a card (3 to 6) goes first, then one of 16 or 15 digits, then the first.
    """

    def all_of(c: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), c["n"]), lambda i: F.get(c["s"], i - 1).rlike("[0-9]") & ~F.coalesce(F.get(c["s"], i - 2).rlike("[0-9]"), F.lit(False)))
        return F.flatten(F.transform(starts, lambda i: let(F.struct(i.alias("at"), F.regexp_extract(F.array_join(F.slice(c["s"], i, F.lit(CARD + 1)), ""), "^[0-9 -]*", 0).alias("w")), ends)))

    def ends(c: Column) -> Column:
        def of(groups: Column) -> Column:
            upto = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(groups, F.lit(1), k), "").alias("digits")))
            some = F.filter(upto, lambda u: F.length(u["digits"]).between(13, 19) & (F.length(u["digits"]) + u["k"] <= CARD + 1))
            return F.transform(F.filter(some, lambda u: luhn_sum(u["digits"], 1) % 10 == 0), lambda u: window(c["at"], F.length(u["digits"]) + u["k"] - 1, u["digits"]))

        def window(at: Column, n: Column, digits: Column) -> Column:
            usual = F.when(F.length(digits) == 16, 0).when(F.length(digits) == 15, 1).otherwise(2)
            return F.struct((~digits.rlike("^[3-6]")).alias("odd"), usual.alias("usual"), at.alias("at"), n.alias("n"), F.substring(c["w"], F.lit(1), n).alias("w"))

        return let(F.regexp_extract_all(c["w"], F.lit("[0-9]+"), F.lit(0)), of)

    run = F.struct(F.split(m, "").alias("s"), F.length(m).alias("n"))
    return F.array_sort(let(run, all_of))


def _chosen(windows: Column) -> Column:
    """Windows that overlap no better one that is chosen: (at, n, w) in order."""

    def take(s: Column, v: Column) -> Column:
        clash = F.exists(s, lambda o: (v["at"] < o["at"] + o["n"]) & (o["at"] < v["at"] + v["n"]))
        return F.when(clash, s).otherwise(F.concat(s, F.array(F.struct(v["at"].alias("at"), v["n"].alias("n"), v["w"].alias("w")))))

    return F.array_sort(F.aggregate(windows, F.array().cast("array<struct<at:int,n:int,w:string>>"), take))


def _replaced(m: Column, cards: Column, key: Key) -> Column:
    """A stretch of digit groups with its cards replaced; the rest stays."""
    end = lambda i: F.coalesce(F.get(cards, i)["at"] + F.get(cards, i)["n"], F.lit(1))
    pieces = F.transform(cards, lambda c, i: F.concat(F.substring(m, end(i - 1), c["at"] - end(i - 1)), _card(c["w"], key)))
    return F.concat(F.array_join(pieces, ""), F.substring(m, end(F.size(cards) - 1), F.length(m)))


def _run(m: Column, key: Key) -> Column:
    """text, n: a run with its n cards replaced.

    A long run goes block by block.  A block ends before a group across whose
    begin no window lies, so blocks do not change what is chosen; only where
    windows overlap each other for ``LONG`` characters is it cut at the
    last place that no chosen card covers.
    """

    def turn(s: Column, block: Column) -> Column:
        return let(F.concat(s["rest"], block["b"]), lambda b: let(_windows(b), lambda w: let(_chosen(w), lambda c: cut(s, block["last"], b, w, c))))

    def cut(s: Column, ends: Column, b: Column, w: Column, cards: Column) -> Column:
        last = F.length(b) - CARD
        near = F.filter(F.sequence(F.greatest(last - 20 * CARD, F.lit(2)), F.greatest(last, F.lit(2))), lambda p: (p <= last) & F.substring(b, p - 1, F.lit(2)).rlike("^[^0-9][0-9]"))
        free = lambda p, taken: ~F.exists(taken, lambda v: (v["at"] < p) & (p < v["at"] + v["n"]))
        safe = F.array_max(F.filter(near, lambda p: free(p, w)))
        forced = F.when(F.length(b) > LONG, F.array_max(F.filter(near, lambda p: free(p, cards))))
        place = F.when(ends, F.length(b) + 1).otherwise(F.coalesce(safe, forced, F.lit(1)))
        return let(place, lambda p: let(F.filter(cards, lambda c: c["at"] < p), lambda own: let(F.substring(b, F.lit(1), p - 1), lambda ahead: part(s, b, p, ahead, own))))

    def part(s: Column, b: Column, p: Column, ahead: Column, cards: Column) -> Column:
        done = F.concat(s["out"], _replaced(ahead, cards, key))
        return F.struct(done.alias("out"), F.substring(b, p, F.length(b)).alias("rest"), (s["n"] + F.size(cards)).alias("n"))

    begin = F.struct(F.lit("").alias("out"), F.lit("").alias("rest"), F.lit(0).alias("n"))
    blocks = let(F.regexp_extract_all(m, F.lit(f".{{1,{BLOCK}}}"), F.lit(0)), lambda a: F.transform(a, lambda b, i: F.struct(b.alias("b"), (i == F.size(a) - 1).alias("last"))))
    return F.aggregate(blocks, begin, turn, lambda s: F.struct(s["out"].alias("text"), s["n"].alias("n")))


# ---- whole texts


def _finding(m: Column, key: Key) -> Column:
    """k, text, n of a match: its kind (null if it fails validation), its pseudonym, and how many values it holds."""

    def of(k: Column) -> Column:
        shown = F.when(k == "local", "phone").when(k == "ipv6", "ip").when(k == "token", "key").otherwise(k)
        one = F.when(k.isin("ip", "date", "ssn", "local"), _number(m, k, key)).otherwise(_characters(m, k, key))
        cards = let(_run(m, key), lambda r: F.struct(F.when(r["n"] > 0, "card").alias("k"), r["text"].alias("text"), r["n"].alias("n")))
        none = F.struct(F.lit(None).cast("string").alias("k"), m.alias("text"), F.lit(0).alias("n"))
        return F.when(k == "run", cards).when(k.isNull(), none).otherwise(F.struct(shown.alias("k"), one.alias("text"), F.lit(1).alias("n")))

    return let(_kind(m), of)


def key_of(spark: SparkSession) -> str:
    """The session's key; there is none without a setting."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"pass a key or set {KEY_SETTING}")
    return key


def _changed(docs: DataFrame, key: Key, column: str, findings: str | None) -> DataFrame:
    text = F.col(f"`{column}`")
    # Byte searches make no copy of a text; only keys and hex tokens may do without these characters.
    worth = reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in SIGNS]) | text.rlike("[a-f]{16}|[A-F]{16}")
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    taken = {c.lower() for c in docs.columns}
    own = next(f"__pii{i}" for i in range(len(taken) + 1) if f"__pii{i}" not in taken)
    rows = docs.withColumn(own, F.when(worth, let(found, lambda a: F.when(F.size(a) > 0, F.transform(a, lambda m: _finding(m, key))))))
    some = F.col(own).isNotNull()
    pieces = F.zip_with(F.split(text, ANY, -1), F.concat(F.transform(own, lambda f: f["text"]), F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    columns = [F.when(some, F.array_join(pieces, "")).otherwise(text).alias(column) if c == column else F.col(f"`{c}`") for c in docs.columns]
    if findings:
        kinds = F.flatten(F.transform(F.filter(own, lambda f: f["k"].isNotNull()), lambda f: F.array_repeat(f["k"], f["n"])))
        columns.append(F.coalesce(kinds, F.array().cast("array<string>")).alias(findings))
    return rows.select(*columns)


def pseudonymise(docs: DataFrame, key: str | None = None, column: str = "text", findings: str | None = None) -> DataFrame:
    """The rows with PII in ``column`` replaced; ``findings`` names a column for the kinds found, in order."""
    return _changed(docs, Key(key or key_of(docs.sparkSession)), column, findings)


def restore(docs: DataFrame, key: str | None = None, column: str = "text") -> DataFrame:
    """The rows with pseudonyms in ``column`` taken back under the key they were made with."""
    return _changed(docs, Key(key or key_of(docs.sparkSession), back=True), column, None)
