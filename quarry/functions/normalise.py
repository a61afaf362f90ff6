"""Normal forms of paths, keys, addresses and times, as column functions.

The forms of a path are not interchangeable: facts keep the drive, candidates and ensembles drop it, entities
keep quotes, deduplication keeps the drive and offers a form without it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


SIX_WHOLE = r"^([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$"
SIX_SHORT = r"^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?::([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?$"


def _bits(block: str) -> str:
    """First bits of a block of addresses, as a text of zeros and ones."""
    import ipaddress

    net = ipaddress.ip_network(block)
    return f"{int(net.network_address):0128b}"[: net.prefixlen]


# Blocks of addresses that are private, local, unspecified or multicast.
SIX_INSIDE = [_bits(b) for b in ("::1/128", "::/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "fc00::/7", "fe80::/10", "ff00::/8")]


def stripped(text: Column) -> Column:
    """Without white space at both ends; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"^\s+|\s+$", "")


def _ends(text: Column, letter: str) -> Column:
    return F.regexp_replace(text, f"^{letter}+|{letter}+$", "")


def _slashes(text: Column, many: str = "/+") -> Column:
    return F.regexp_replace(F.translate(text, "\\", "/"), many, "/")


def path_of_fact(text: Column) -> Column:
    """Lower case, forward slashes, without quotes around and slashes at the end; the drive stays."""
    bare = stripped(_ends(_ends(stripped(text), '"'), "'"))
    return F.lower(F.regexp_replace(_slashes(bare), "/+$", ""))


def path_of_candidate(text: Column) -> Column:
    """Lower case, forward slashes, without device or drive and without a slash in front."""
    bare = F.translate(stripped(text), "\\", "/")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?i)^/device/harddiskvolume[0-9]+/", "/"), r"^[a-zA-Z]:/", "/")
    return F.regexp_replace(F.lower(F.regexp_replace(bare, "/+", "/")), "^/", "")


def path_of_entity(text: Column) -> Column:
    """Lower case, single forward slashes, one slash at the end dropped; drive and quotes stay."""
    clean = F.lower(stripped(_slashes(stripped(text))))
    return F.when(F.length(clean) > 1, F.regexp_replace(clean, "/$", "")).otherwise(clean)


def path_of_ensemble(text: Column) -> Column:
    """Lower case, forward slashes, without device, drive and slashes in front."""
    clean = F.translate(F.lower(stripped(text)), "\\", "/")
    clean = F.regexp_replace(F.regexp_replace(clean, r"^/device/harddiskvolume[0-9]+", ""), "^[a-z]:", "")
    return F.regexp_replace(clean, "^/+", "")


def path_of_dedup(text: Column) -> Column:
    """Lower case, single blanks, runs of slashes as one."""
    return F.regexp_replace(F.regexp_replace(F.translate(F.lower(stripped(text)), "\\", "/"), r"\s+", " "), "/{2,}", "/")


def without_drive(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^[a-z]:", ""), "^/+", "")


def leaf(path: Column) -> Column:
    """Last part of a path without its slashes at the end."""
    return F.regexp_extract(F.regexp_replace(F.translate(F.coalesce(path, F.lit("")), "\\", "/"), "/+$", ""), "([^/]*)$", 1)


def process_name(text: Column) -> Column:
    """Lower-case file name of a process, without quotes."""
    bare = F.translate(_ends(_ends(stripped(text), '"'), "'"), "\\", "/")
    return F.lower(stripped(F.regexp_extract(bare, "([^/]*)$", 1)))


def registry_key(*parts: Column) -> Column:
    """The parts that are not empty as one key."""
    return path_of_fact(F.concat_ws("/", *(F.nullif(p.cast("string"), F.lit("")) for p in parts)))


def command_line(text: Column) -> Column:
    return F.lower(F.regexp_replace(stripped(text), r"\s+", " "))


def time_text(text: Column) -> Column:
    return F.translate(stripped(text), "T", " ")


def time_minute(text: Column) -> Column:
    """Minute of a time; of other texts the first 16 characters."""
    clean = time_text(text)
    found = F.regexp_extract(clean, "^([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2})", 1)
    return F.when(found != "", found).otherwise(F.substring(clean, 1, 16))


def time_second(text: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS from the first time in a text; '' where there is none."""
    found = lambda k: F.regexp_extract(F.coalesce(text, F.lit("")), "([0-9]{4}-[0-9]{2}-[0-9]{2})[T ]([0-9]{2}:[0-9]{2}:[0-9]{2})", k)
    return F.when(found(1) != "", F.concat(found(1), F.lit("T"), found(2))).otherwise("")


def whole(text: Column) -> Column:
    """Whole number of a text, or null."""
    clean = stripped(text)
    return F.when(clean.rlike("^[+-]?[0-9]{1,18}$"), clean.try_cast("long"))


def names_match(a: Column, b: Column) -> Column:
    """Whether two process names are the same, one perhaps cut: equal, or the shorter one begins the longer and has 14
    letters (as kernels cut names) or five with at most four left out."""
    x, y = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    cut = F.startswith(long, short) & ((F.length(short) >= 14) | ((F.length(short) >= 5) & (F.length(long) - F.length(short) <= 4)))
    return (x == y) | ((x != "") & (y != "") & cut)


# -- addresses ------------------------------------------------------------------------------

QUAD = r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"


def octet(ip: Column, k: int) -> Column:
    return F.try_element_at(F.split(ip, r"\."), F.lit(k + 1)).try_cast("int")


def is_quad(ip: Column) -> Column:
    """Four numbers up to 255 without leading zeros."""
    good = ip.rlike(QUAD) & ~ip.rlike(r"(^|\.)0[0-9]") & (F.greatest(*(octet(ip, k) for k in range(4))) <= 255)
    return F.coalesce(good, F.lit(False))


def _in_private(ip: Column) -> Column:
    """Addresses that registries keep for private or special use (fixed values)."""
    a, b, c, d = (octet(ip, k) for k in range(4))
    special = (
        a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | (a >= 240)
        | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113)) | ((a == 192) & (b == 0) & (c == 2))
        | ((a == 192) & (b == 0) & (c == 0) & ~d.isin(9, 10))
    )
    return special


def external_by_prefix(ip: Column) -> Column:
    """By the beginning of the text alone: whatever is not known as inside is outside."""
    text = F.coalesce(ip, F.lit(""))
    inside = text.isin("", "*", "::", "0.0.0.0") | text.rlike(r"^(10\.|127\.|169\.254\.|192\.168\.|::1|fe80|fc|fd|224\.|239\.|255\.)")
    return ~(inside | text.rlike(r"^172\.(1[6-9]|2[0-9]|3[01])(\.|$)"))


def public_by_octets(ip: Column) -> Column:
    """A routable address that is no network's base address."""
    text = F.coalesce(ip, F.lit(""))
    a, b, d = octet(text, 0), octet(text, 1), octet(text, 3)
    inside = a.isin(0, 10, 127) | ((a == 192) & (b == 168)) | ((a == 172) & b.between(16, 31)) | ((a == 169) & (b == 254)) | (a >= 224) | (d == 0)
    return F.coalesce(text.rlike(QUAD) & (F.greatest(*(octet(text, k) for k in range(4))) <= 255) & ~inside, F.lit(False))


def public_by_registry(ip: Column) -> Column:
    """Neither private, loopback, link-local, multicast nor unspecified, of either kind of address; one of four numbers after ``::ffff:`` counts as those."""
    text = F.regexp_replace(F.coalesce(ip, F.lit("")), r"(?i)^::ffff:([0-9]+(?:\.[0-9]+){3})$", "$1")
    four = is_quad(text) & ~_in_private(text) & ~octet(text, 0).between(224, 239)
    return F.coalesce(F.when(F.contains(text, F.lit(":")), is_six(text) & ~_six_inside(text)).otherwise(four), F.lit(False))


def is_six(ip: Column) -> Column:
    """Eight groups of hexadecimal digits, or fewer around one ``::``."""
    low = F.lower(ip)
    groups = F.size(F.filter(F.split(low, ":"), lambda g: g != ""))
    short = low.rlike(SIX_SHORT) & (groups <= 7)
    return low.rlike(SIX_WHOLE) | short


def _six_inside(ip: Column) -> Column:
    """Whether an address of eight groups is of a block that isn't public (``SIX_INSIDE``), or multicast."""
    ends = F.split(F.lower(ip), "::", 2)
    left, right = (F.filter(F.split(F.coalesce(F.get(ends, k), F.lit("")), ":"), lambda g: g != "") for k in (0, 1))
    middle = F.array_repeat(F.lit("0"), F.when(F.contains(ip, F.lit("::")), 8 - F.size(left) - F.size(right)).otherwise(0))
    bits = F.array_join(F.transform(F.concat(left, middle, right), lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), "")
    return bits.rlike("^(" + "|".join(SIX_INSIDE) + ")")


def external_endpoint(ip: Column) -> Column:
    """The same for an endpoint of a connection: a zone is cut off, wildcards are inside."""
    return public_by_registry(F.regexp_replace(stripped(ip), "%.*$", ""))


def internal_by_registry(ip: Column) -> Column:
    """Private, loopback or link-local."""
    text = F.coalesce(ip, F.lit(""))
    return F.coalesce(is_quad(text) & _in_private(text), F.lit(False))


def local_entity(key: Column) -> Column:
    """Whether an entity key names a loopback, unspecified or link-local address."""
    text = F.lower(stripped(key))
    ip = F.regexp_replace(F.regexp_replace(text, "^ip:", ""), ":[0-9]*$", "")
    plain = is_quad(ip) & ((octet(ip, 0) == 127) | (ip == "0.0.0.0") | ((octet(ip, 0) == 169) & (octet(ip, 1) == 254)))
    return F.startswith(text, F.lit("ip:")) & (F.coalesce(plain, F.lit(False)) | text.isin("ip:::1", "ip:::"))


def carved_number(ip: Column) -> Column:
    """Whether a quad reads as an object identifier or a version: its first number is at most 2."""
    return F.coalesce(octet(ip, 0) <= 2, F.lit(False))


def odd_quad(ip: Column) -> Column:
    """Whether a text is no canonical address."""
    return ~is_quad(F.coalesce(ip, F.lit("")))


def direction(local_port: Column, foreign_port: Column, state: Column) -> Column:
    """listening, inbound, outbound or indeterminate, by the state and the order of the ports."""
    here, there = whole(local_port), whole(foreign_port)
    return (
        F.when(F.contains(F.upper(F.coalesce(state, F.lit(""))), F.lit("LISTEN")), "listening")
        .when(F.coalesce(there, F.lit(0)) == 0, F.when(F.coalesce(here, F.lit(0)) != 0, "listening").otherwise("indeterminate"))
        .when(here.isNull(), "indeterminate").when(here < there, "inbound").when(there < here, "outbound").otherwise("indeterminate")
    )


# -- bytes and texts ------------------------------------------------------------------------


def byte_class(dump: Column) -> Column:
    """What the first 64 bytes (in hexadecimal) of a memory region look like."""
    found = F.slice(F.regexp_extract_all(F.lower(F.coalesce(dump, F.lit(""))), F.lit("([0-9a-f]{2})"), 1), 1, 64)
    n, text = F.size(found), F.array_join(found, " ")
    share = lambda b: F.size(F.filter(found, lambda x: x == b)) >= 0.8 * n
    shell = F.contains(text, F.lit("e8 00 00 00 00")) | text.rlike("^(64 a1|65 48 8b|fc 48 83 e4)")
    return F.when(n == 0, "unknown").when(F.startswith(text, F.lit("4d 5a")), "mz_pe").when(share("00"), "zero_fill").when(share("cc"), "int3_pad").when(shell, "shellcode").otherwise("code")


def printable_ratio(text: Column) -> Column:
    """Share of a text's characters that are printable, tabs and line ends included."""
    n = F.length(text)
    return F.when(n > 0, F.length(F.regexp_replace(text, "[^\\t\\n\\r\\x20-\\x7E\\x{A1}-\\x{10FFFF}]", "")) / n).otherwise(F.lit(0.0))


def decoded(raw: Column) -> Column:
    """struct(text, codec) of the first codec under which bytes are mostly printable, else null."""
    first = None
    for codec, name in (("UTF-8", "utf-8"), ("UTF-16LE", "utf-16-le"), ("US-ASCII", "ascii")):
        valid = F.when((F.lit(codec) != "UTF-8") | F.is_valid_utf8(raw.cast("string")), F.decode(raw, codec))
        if codec == "UTF-16LE":
            valid = F.when(F.octet_length(raw) % 2 == 0, valid)
        if codec == "US-ASCII":
            valid = F.when(~F.hex(raw).rlike("^(..)*[89A-F]."), valid)
        text = F.replace(valid, F.lit("\x00"), F.lit(""))
        good = (F.length(text) > 0) & (printable_ratio(text) >= 0.85)
        first = (F if first is None else first).when(good, F.struct(text.alias("text"), F.lit(name).alias("codec")))
    return first


def encoded_command(text: Column) -> Column:
    """Command that a shell was given as Base64 of UTF-16, else null."""
    raw = F.try_to_binary(text, F.lit("base64"))
    return F.when((F.octet_length(raw) > 0) & (F.octet_length(raw) % 2 == 0), F.decode(raw, "UTF-16LE"))


def security_id(raw: Column) -> Column:
    """Text of a binary security identifier; '' where it is too short."""
    text = F.hex(raw)
    number = lambda at, width: F.conv(F.substring(text, at, width), 16, 10)
    part = lambda k: F.conv(F.concat(*(text.substr(F.lit(17 + 6 - 2 * j) + k * 8, F.lit(2)) for j in range(4))), 16, 10)
    count = F.least(number(3, 2).cast("int"), F.floor((F.length(text) - 16) / 8).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), part)
    tail = F.when(count > 0, F.concat(F.lit("-"), F.array_join(parts, "-"))).otherwise("")
    return F.when(F.length(text) >= 16, F.concat(F.lit("S-"), number(1, 2), F.lit("-"), number(5, 12), tail)).otherwise("")


def consonant_run(label: Column) -> Column:
    """Length of the longest run of consonants."""
    return F.array_max(F.transform(F.split(F.lower(label), "[^b-df-hj-np-tv-z]+"), lambda p: F.length(p)))


def registered_label(name: Column) -> Column:
    """Second label from the right; of a name without dots the name."""
    parts = F.filter(F.split(F.lower(stripped(name)), r"\."), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1)), F.lit(""))


def carved_label(label: Column) -> Column:
    """Whether a label is mostly single letters between hyphens, as carving leaves them."""
    parts = F.filter(F.split(label, "-"), lambda p: p != "")
    return (F.size(parts) >= 3) & (F.size(F.filter(parts, lambda p: F.length(p) <= 1)) >= 0.5 * F.size(parts))


def random_label_reasons(name: Column) -> Column:
    """Reasons why a name's registered label reads as generated; a suspect has the first and another one.

    Labels of fewer than ten letters, carved ones, and those with other characters give none.
    """
    from .columns import entropy

    raw = registered_label(name)
    label = F.replace(raw, F.lit("-"), F.lit(""))
    n, letters = F.length(label), F.length(F.regexp_replace(label, "[^a-z]", ""))
    vowels, digits = F.length(F.regexp_replace(label, "[^aeiou]", "")), F.length(F.regexp_replace(label, "[^0-9]", ""))
    some = raw.rlike("^[a-z0-9-]+$") & ~carved_label(raw) & (n >= 10) & (letters > 0)
    reasons = F.array_compact(F.array(
        F.when(vowels <= 0.26 * letters, "low_vowel_ratio"), F.when(consonant_run(label) >= 5, "long_consonant_run"),
        F.when(digits >= 0.25 * n, "high_digit_ratio"), F.when(entropy(label) >= 0.9 * F.log2(n.cast("double")), "near_max_entropy")))
    return F.when(some, reasons).otherwise(F.array().cast("array<string>"))


def entities_of(key: Column) -> Column:
    """map(index -> sorted keys) of the process ids and addresses that an entity key holds."""
    text = F.lower(F.coalesce(key, F.lit("")))
    pids = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:^|[:|])pid:([0-9]+)(?=[:|]|$)"), 1)))
    ips = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:^|[:|])(?:ip|peer|addr|remote|foreign):((?:[0-9]{1,3}\.){3}[0-9]{1,3})(?=[:|]|$)"), 1)))
    return F.map_filter(F.create_map(F.lit("by_pid"), pids, F.lit("by_ip"), ips), lambda k, v: F.size(v) > 0)
