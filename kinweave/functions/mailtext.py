"""Header fields, address lists, encoded words, dates and MIME bodies of mail as column expressions; no Python runs on them.

Patterns repeat possessively wherever their input may be long, so Java's matcher neither backtracks nor recurses.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinweave.functions.text import strip_html

_WORD = r"=\?([^?\s]+)\?([BbQq])\?([^?]*)\?="
_QUOTED = r'"(?:[^"\\]++|\\.)*+"'
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_DATE = rf"(?i)^\s*(?:[a-z]{{3,9}},?\s+)?(\d{{1,2}})[\s-]+({'|'.join(_MONTHS[i : i + 3] for i in range(0, 36, 3))})[a-z]*+\.?[\s-]+(\d{{2,4}}),?\s+(\d{{1,2}}):(\d\d)(?::(\d\d))?(?:\.\d+)?\s*([+-]\d\d:?\d\d|[a-z]{{1,4}})?"
_ZONES = {"est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7}
#: Multiparts within multiparts that are opened.
DEPTH = 3


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _filled(text: Column) -> Column:
    return _let(text, lambda t: F.when(t != "", t))


def header(head: Column, name: str) -> Column:
    """The value of a header field, unfolded; of several the last one, null if there is none."""
    found = F.regexp_extract_all(F.concat(F.lit("\n"), head), F.lit(rf"(?i)\n{name}:[ \t]*+([^\n]*+(?:\n[ \t][^\n]*+)*+)"), F.lit(1))
    return F.trim(F.regexp_replace(F.try_element_at(found, F.lit(-1)), r"[ \t]*\n[ \t]+", " "))


def _decoded(data: Column, utf8: Column) -> Column:
    return F.when(utf8, F.make_valid_utf8(data.cast("string"))).otherwise(F.decode(data, "ISO-8859-1"))


def from_base64(text: Column, utf8: Column) -> Column:
    """Base64 as text; what doesn't belong to the alphabet is left out, also a last letter that is alone."""
    clean = F.regexp_replace(F.regexp_extract(F.translate(text, "-_", "+/"), "^[^=]*+", 0), "[^A-Za-z0-9+/]++", "")

    def whole(c: Column) -> Column:
        n = F.length(c) - F.when(F.length(c) % 4 == 1, 1).otherwise(0)
        return F.rpad(F.substring(c, F.lit(1), n), F.ceil(n / 4).cast("int") * 4, F.lit("="))

    return _decoded(F.unbase64(_let(clean, whole)), utf8)


def from_quoted(text: Column, utf8: Column) -> Column:
    """Quoted-printable as text. The bytes become percent signs in UTF-8, which one built-in function reads."""
    t = F.replace(F.replace(F.regexp_replace(text, "=\r?\n", ""), F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("%2B"))
    latin = F.regexp_replace(t, "=([89ABab][0-9A-Fa-f])", "%C2%$1")
    for high, low in zip("CDEF", "89AB"):
        latin = F.regexp_replace(latin, f"=[{high}{high.lower()}]([0-9A-Fa-f])", f"%C3%{low}$1")
    return F.try_url_decode(F.regexp_replace(F.when(utf8, t).otherwise(latin), "=([0-9A-Fa-f]{2})", "%$1"))


def decode_words(text: Column) -> Column:
    """Encoded words decoded, with the space between two of them gone; text without any stays as it is."""
    return _let(text, _words_decoded)


def _words_decoded(text: Column) -> Column:
    bare = _WORD.replace("(", "(?:")
    joined = F.regexp_replace(text, rf"({bare})\s+(?={bare})", "$1")

    def word(w: Column) -> Column:
        part = lambda i: F.regexp_extract(w, f"^{_WORD}$", i)
        utf8 = part(1).rlike("(?i)utf-?8")
        q = from_quoted(F.replace(part(3), F.lit("_"), F.lit(" ")), utf8)
        return F.when(~w.rlike(f"^{_WORD}$"), w).when(F.lower(part(2)) == "b", from_base64(part(3), utf8)).otherwise(q)

    pieces = F.regexp_extract_all(joined, F.lit(f"{bare}|[^=]++|="), F.lit(0))
    whole = F.trim(F.regexp_replace(F.array_join(F.transform(pieces, word), ""), r"\s+", " "))
    return F.when(F.contains(text, F.lit("=?")), whole).otherwise(text)


def address_list(text: Column, role: str | None = None) -> Column:
    """People (name, email, org, role) of an address header; groups are opened, entries without an address left out, null gives none."""

    angle = rf'(?s)^((?:{_QUOTED}|[^<"]++|")*+)<([^>]++)>'

    def cut(t: Column) -> Column:
        return F.struct(t.alias("all"), F.trim(F.regexp_extract(t, angle, 1)).alias("label"), _filled(F.trim(F.regexp_extract(t, angle, 2))).alias("inside"))

    def person(c: Column) -> Column:
        label = F.when(c.label.rlike('(?s)^".*"$'), F.regexp_replace(F.regexp_replace(c.label, '^"|"$', ""), r"\\(.)", "$1")).otherwise(c.label)
        plain = F.regexp_replace(F.trim(F.regexp_replace(c["all"], r"\([^)]*+\)", "")), '^"|"$', "")
        name = F.when(c.inside.isNotNull(), label).otherwise(F.trim(F.regexp_extract(c["all"], r"\(([^)]*+)\)", 1)))
        email = F.coalesce(c.inside, _let(plain, lambda e: F.when(e.rlike(r"^\S+@\S+$"), e)))
        return F.struct(_filled(decode_words(name)).alias("name"), email.alias("email"), F.lit(None).cast("string").alias("org"), F.lit(role).cast("string").alias("role"))

    trimmed = lambda entry: F.regexp_replace(F.regexp_replace(F.trim(entry), r'^[^:"<@(]++:\s*+', ""), r"\s*;\s*$", "")
    entries = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf'(?s)(?:{_QUOTED}|[^,"]++|")++'), F.lit(0))
    return F.filter(F.transform(F.transform(F.transform(entries, trimmed), cut), person), lambda p: p.email.isNotNull())


def mail_date(text: Column) -> Column:
    """A Date header (or an ISO time with its zone) as ISO time in UTC; null if it can't be read. Without a zone it is UTC."""
    return _let(text, _date_read)


def _date_read(text: Column) -> Column:
    part = lambda i: F.regexp_extract(text, _DATE, i)
    number = lambda i: part(i).try_cast("int")
    year = F.when(number(3) >= 1000, number(3)).when((F.length(part(3)) == 2) & (number(3) < 50), number(3) + 2000).otherwise(number(3) + 1900)
    month = (F.instr(F.lit(_MONTHS), F.lower(part(2))) + 2) / 3
    zone = F.lower(F.replace(part(7), F.lit(":"), F.lit("")))
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    minutes = F.when(zone.rlike(r"^[+-]\d{4}$"), sign * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")))
    minutes = F.coalesce(reduce(lambda c, z: c.when(zone == z[0], z[1] * 60), _ZONES.items(), minutes), F.lit(0))
    local = F.try_make_timestamp_ntz(year, month.cast("int"), number(1), number(4), number(5), F.coalesce(number(6), F.lit(0)))
    mail = local - F.make_dt_interval(mins=minutes)
    iso = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.trim(text).try_cast("timestamp").cast("timestamp_ntz"))
    iso = F.when(text.rlike(r"^\s*\d{4}-\d\d-\d\dT\d\d:\d\d.*(?:Z|[+-]\d\d:?\d\d)\s*$"), F.date_trunc("second", iso).cast("timestamp_ntz"))
    at = F.when(text.rlike(_DATE), mail).otherwise(iso)
    return F.concat(F.replace(at.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def _leaf(kind: Column, encoding: Column, raw: Column) -> Column:
    utf8 = ~F.contains(kind, F.lit("charset")) | kind.rlike(r'charset\s*=\s*"?utf-?8')
    code = F.lower(F.trim(F.coalesce(encoding, F.lit(""))))
    return F.when(code == "base64", from_base64(raw, utf8)).when(code == "quoted-printable", from_quoted(raw, utf8)).otherwise(raw)


def _parts(raw: Column, boundary: Column) -> Column:
    """(type, encoding, raw) of the parts between two boundaries, up to the closing one."""
    cut = F.split(raw, F.concat(F.lit(r"\Q--"), boundary, F.lit(r"\E")))
    parts = F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 1, F.lit(0)))

    def opened(all_: Column) -> Column:
        end = F.array_position(F.transform(all_, lambda p: p.startswith("--")), True).cast("int")
        return F.slice(all_, F.lit(1), F.when(end > 0, end - 1).otherwise(F.size(all_)))

    def read(part: Column) -> Column:
        text = F.regexp_replace(part, r"^[ \t]++", "")  # from the end of the boundary's line on: a head that is missing ends there
        end = F.instr(text, "\n\n")
        head, body = F.when(end > 0, F.substring(text, F.lit(1), end - 1)).otherwise(text), F.when(end > 0, F.substring(text, end + 2, F.length(text))).otherwise("")
        return F.struct(F.coalesce(header(head, "Content-Type"), F.lit("text/plain")).alias("type"), header(head, "Content-Transfer-Encoding").alias("encoding"), body.alias("raw"))

    return F.transform(_let(parts, opened), read)


def text_body(kind: Column, encoding: Column, raw: Column, depth: int = 0) -> Column:
    """The text of a body: of several parts the first plain one (or one within that has a text), else the first HTML one without its tags; null if there is none."""
    lower = F.lower(F.coalesce(kind, F.lit("")))
    html, multi = lower.startswith("text/html"), lower.startswith("multipart/")
    text = _leaf(lower, encoding, raw)
    alone = F.when(html, strip_html(text)).when((lower == "") | lower.startswith("text/"), F.when(text.rlike(r"\S"), text))
    if depth == DEPTH:
        return F.when(~multi, alone)
    boundary = F.coalesce(*[_filled(F.regexp_extract(kind, rf"(?i)boundary\s*=\s*{b}", 1)) for b in ('"([^"]+)"', r'([^\s;"]+)')])

    def read(p: Column) -> Column:
        low = F.lower(p["type"])
        leaf = _leaf(low, p.encoding, p.raw)
        rank = F.when(low.startswith("text/plain") | low.startswith("multipart/"), 0).when(low.startswith("text/html"), 1)
        value = F.when(low.startswith("multipart/"), text_body(p["type"], p.encoding, p.raw, depth + 1)).when(low.startswith("text/html"), strip_html(leaf)).when(low.startswith("text/plain"), leaf)
        return F.struct(rank.alias("rank"), value.alias("value"))

    first = lambda ps, r: F.get(F.filter(ps, lambda p: (p["rank"] == r) & p.value.isNotNull()), F.lit(0)).value
    found = _let(F.transform(_parts(raw, boundary), read), lambda ps: F.coalesce(first(ps, 0), first(ps, 1)))
    return _filled(F.when(multi & boundary.isNotNull(), found).when(~multi, alone))
