"""Name, label, account and markup expressions."""

from __future__ import annotations

import re
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from benefica.fixed import ACCOUNT_PATTERNS, TRIGRAM_THRESHOLD


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def lower_or_unknown(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("unknown")))


def join_flags(flags: Column, separator: str = "|") -> Column:
    return F.array_join(flags, separator)


# --- names ----------------------------------------------------------------------------------------------------

def split_name(full: Column) -> tuple[Column, Column, Column]:
    """Given, additional and family part; one word is both given and family name."""
    words = F.split(full, " ", -1)
    middle = F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), " ")
    return F.get(words, F.lit(0)), F.when(full.isNotNull(), middle), F.get(words, F.size(words) - 1)


def compose_name(family: Column, given: Column, additional: Column) -> Column:
    family, given, additional = (blank_to_null(c) for c in (family, given, additional))
    comma = F.when(given.isNotNull() | additional.isNotNull(), F.concat(family, F.lit(","))).otherwise(family)
    return F.upper(F.concat_ws(" ", comma, given, additional))


def name_step(name: str, fields: list[Column]) -> Column:
    """Which search step finds the row first (1, 2, ...); missing when none does.

    Steps: the whole text in the first field, in each further field, the words in
    order in each field, then all words in any field.
    """
    name = name.lower()
    words = name.split()
    lowered = [F.lower(f) for f in fields]
    steps = [f.contains(name) for f in lowered]
    steps += [f.like("%" + "%".join(name.split(" ")) + "%") for f in lowered]
    if " " in name:
        every = None
        for word in words:
            anywhere = None
            for f in lowered:
                hit = F.coalesce(f.contains(word), F.lit(False))
                anywhere = hit if anywhere is None else anywhere | hit
            every = anywhere if every is None else every & anywhere
        steps.append(every)
    out = None
    for i, hit in enumerate(steps, 1):
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out


# --- trigram similarity ---------------------------------------------------------------------------------------

def trigrams(text: Column) -> Column:
    """Distinct 3-letter pieces of every word, the word padded with two blanks before and one after."""
    words = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "),
                                      lambda w: F.length(w) > 0))

    def pieces(w: Column) -> Column:
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, pieces)))


def similarity(a: Column, b: Column) -> Column:
    """Shared share of two trigram arrays."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(shared / F.nullif(F.size(a) + F.size(b) - shared, F.lit(0)), F.lit(0.0))


def is_similar(a: Column, b: Column, threshold: float = TRIGRAM_THRESHOLD) -> Column:
    return similarity(a, b) >= threshold


# --- markup ---------------------------------------------------------------------------------------------------

# One piece of markup: raw script or style, comment, tag, or text up to the next "<".
MARKUP = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[!/?a-z][^>]*>|[^<]+|<"
# The names of characters, with and (for the old ones) without their semicolon.
NAMED = "\x01".join(f"&{name}\x02{char}" for name, char in html5.items())
_OLD = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
REFERENCE = rf"&#[0-9]{{1,7}};?|&#[xX][0-9a-fA-F]{{1,6}};?|&[A-Za-z][A-Za-z0-9]*;|&(?:{_OLD})|[^&]+|&"
BLANKS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def text_from_html(html: Column, max_words: int | None = None, max_chars: int | None = None,
                   ellipsis: str = "\u2026") -> Column:
    """All text nodes joined, blanks squeezed, cut to words and characters; missing markup gives ''."""
    names = F.str_to_map(F.lit(NAMED), F.lit("\x01"), F.lit("\x02"))  # folded into one literal

    def character(r: Column) -> Column:
        code = F.when(r.rlike("^&#[0-9]"), F.regexp_extract(r, "[0-9]+", 0).cast("int")).when(
            r.rlike("^&#[xX]"), F.conv(F.regexp_extract(r, "[0-9a-fA-F]+", 0), 16, 10).cast("int"))
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return (F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
                .when(r.startswith("&") & (F.length(r) > 1), F.coalesce(F.element_at(names, r), r)).otherwise(r))

    def piece(p: Column) -> Column:
        decoded = F.array_join(F.transform(F.regexp_extract_all(p, F.lit(REFERENCE), F.lit(0)), character), "")
        text = F.when(p.contains("&"), decoded).otherwise(p)
        raw = F.regexp_replace(p, r"(?is)^<[^>]*>|</(?:script|style)\s*>$", "")
        return (F.when(F.regexp(p, F.lit(r"(?is)^<(?:script|style)\b.*</(?:script|style)\s*>$")), raw)
                .when(p.startswith("<") & (p != "<"), F.lit("")).otherwise(text))

    pieces = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(MARKUP), F.lit(0))
    text = F.array_join(F.transform(pieces, piece), "")
    words = F.filter(F.split(text, BLANKS), lambda w: F.length(w) > 0)
    cut = F.lit(False)
    if max_words:
        cut = F.size(words) > max_words
        words = F.slice(words, 1, max_words)
    out = F.array_join(words, " ")
    if max_chars:
        cut = cut | (F.length(out) > max_chars)
        out = F.trim(F.when(cut, F.substring(out, 1, max_chars - len(ellipsis))).otherwise(out))
    return F.concat(out, F.when(cut, ellipsis).otherwise(""))


# --- phones, accounts, ids ------------------------------------------------------------------------------------

def e164(phone: Column, country_code: str, trunk: str = "0") -> Column:
    """+<country><number>; keeps numbers that already carry a country code; no digits gives NULL."""
    bare = F.regexp_replace(phone, r"[^0-9+]", "")
    national = F.regexp_replace(bare, f"^{trunk}+", "")
    return (
        F.when(bare.startswith("+"), F.concat(F.lit("+"), F.regexp_replace(bare, r"[^0-9]", "")))
        .when(bare.startswith("00") & (F.length(bare) > 2), F.concat(F.lit("+"), F.substr(bare, F.lit(3))))
        .when(F.length(national) > 0, F.concat(F.lit(f"+{country_code}"), national))
    )


def account_parts(text: Column, patterns: dict[str, str] = ACCOUNT_PATTERNS) -> dict[str, Column]:
    """Named parts of an account text; the pattern is picked by the text's ending.

    A part missing from the picked pattern, or a text without a match, gives ''.
    """
    layouts = {k: re.findall(r"\(\?<(\w+)>", p) for k, p in patterns.items()}
    found = None
    for kind, pattern in patterns.items():
        groups = matched_groups(text, re.sub(r"\(\?<\w+>", "(", pattern), len(layouts[kind]))
        found = F.when(text.endswith(kind), groups) if found is None else found.when(text.endswith(kind), groups)
    out = {}
    for name in dict.fromkeys(n for names in layouts.values() for n in names):
        place = None
        for kind, names in layouts.items():
            at = names.index(name) if name in names else -1
            place = F.when(text.endswith(kind), at) if place is None else place.when(text.endswith(kind), at)
        out[name] = F.coalesce(F.get(found, place), F.lit(""))
    return out


def matched_groups(text: Column, pattern: str, n: int) -> Column:
    """All groups of an anchored pattern from one match, as an array; NULL where it does not match."""
    marked = F.regexp_replace(text, pattern, "\x02" + "\x01".join(f"${i}" for i in range(1, n + 1)))
    return F.when(marked.startswith("\x02"), F.split(F.substring(marked, 2, 1_000_000_000), "\x01"))


def from_template(template: str, values: dict[str, Column]) -> Column:
    """Fill ``{key}`` places; a NULL value makes the result NULL, an unknown key is an error."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        key, rest = rest.split("}", 1)
        if key not in values:
            raise KeyError(key)
        parts += [F.lit(before), values[key].cast("string")]
    return F.concat(*parts, F.lit(rest))


def payee_address(kind: Column, account: Column, bank_code: Column, iban: Column, phone: Column, email: Column,
                  reg_value: Column, prefix: str = "", suffix: str = "") -> Column:
    """Payee address by kind; the prefixes are fixed values."""
    return (
        F.when(kind == "bank_acc_no", F.concat(F.lit("account_no:"), account, F.lit("@"), bank_code))
        .when(kind == "bank_acc_iban", F.concat(F.lit("iban:"), iban, F.lit("@"), bank_code))
        .when(kind == "phone", F.concat(F.lit("phone:"), phone))
        .when(kind == "email", F.concat(F.lit("email:"), email))
        .when(kind == "reg_id", F.concat(F.lit(prefix), reg_value, F.lit(suffix)))
    )


def iban(country: Column, bank_code: Column, account: Column) -> Column:
    """Country, two check digits (mod 97), bank code and account; '' when a part is missing."""
    def digits(c: Column) -> Column:
        letters = F.split(F.upper(c), "")
        return F.array_join(F.transform(letters, lambda x: F.when(
            x.between("A", "Z"), (F.ascii(x) - 55).cast("string")).otherwise(x)), "")

    number = F.concat(digits(bank_code), digits(account), digits(country), F.lit("00"))
    # Left-to-right remainder over pieces of seven digits stays inside a long.
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.length(number) - 1) / 7).cast("int")),
        lambda i: F.substr(number, i * 7 + 1, F.lit(7)),
    )
    left = F.aggregate(pieces, F.lit(0).cast("long"), lambda acc, p: (
        acc * F.pow(F.lit(10), F.length(p)).cast("long") + p.cast("long")) % 97)
    check = F.lpad((98 - left).cast("string"), 2, "0")
    complete = country.isNotNull() & bank_code.isNotNull() & (F.length(account) > 0)
    return F.when(complete, F.concat(F.upper(country), check, F.upper(bank_code), F.upper(account))).otherwise("")


def dated_application_id(day: Column, key: Column) -> Column:
    """ddMMyy and five digits drawn from the key, 1 to 100000."""
    return F.concat(F.date_format(day, "ddMMyy"),
                    F.format_string("%05d", F.pmod(F.xxhash64(key), F.lit(100000)) + 1))


def entitlement_number(key: Column) -> Column:
    return F.lpad((F.pmod(F.xxhash64(key), F.lit(10**10 - 1)) + 1).cast("string"), 10, "0")


def entitlement_label(amount: Column, symbol: str, is_cash: Column, code: Column) -> Column:
    return F.concat(F.lit("Entitlement"), F.when(
        is_cash, F.concat(F.lit(f" Cash [{symbol} "), F.format_number(amount, 2), F.lit("]"))
    ).otherwise(F.concat(F.lit(" ("), code, F.lit(")"))))


def change_summary(change: Column, name: Column, changed: Column) -> Column:
    """One line per change; at most three changed fields are named."""
    who = F.coalesce(blank_to_null(name), F.lit("Unknown Registrant"))
    return (
        F.when(change == "create", F.concat(F.lit("Created new registrant: "), who))
        .when((change == "modify") & (F.size(changed) > 0), F.concat(
            F.lit("Modified registrant "), who, F.lit(": changed "), F.array_join(F.slice(changed, 1, 3), ", ")))
        .when(change == "modify", F.concat(F.lit("Modified registrant: "), who))
        .when(change == "delete", F.concat(F.lit("Deactivated registrant: "), who))
        .otherwise(F.concat(F.lit("Unknown change type for registrant: "), who))
    )


def masked(fields: list[str], placeholder: str = "encrypted", key: Column | None = None) -> dict[str, Column]:
    """Placeholders for the filled fields and one column that packs their originals."""
    filled = {f: F.col(f).isNotNull() & (F.col(f).cast("string") != "") for f in fields}
    packed = F.to_json(F.struct(*[F.when(filled[f], F.col(f)).alias(f) for f in fields]))
    out = {f: F.when(filled[f], F.lit(placeholder)).otherwise(F.col(f).cast("string")) for f in fields}
    out["sealed"] = F.base64(F.aes_encrypt(packed, key)) if key is not None else packed
    return out
