"""Text functions as column expressions: identity normalisation, blocking keys, HTML, addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns that results depend on.
HONORIFICS = ["mr", "mrs", "ms", "dr", "prof", "sir"]
ORG_SUFFIXES = "ltd|llc|llp|inc|plc|gmbh|sarl|limited|capital|partners|ventures|vc|fund|management"
FREEMAIL = ["gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "yahoo.com", "icloud.com", "me.com", "aol.com", "proton.me", "protonmail.com"]
ROBOT = (
    r"^(no-?reply@|do-?not-?reply@|donotreply@|noreply[+-]|notifications?@|alerts?@|news(letter)?@|mailer-daemon@|postmaster@|"
    r"bounces?[@+-]|automated@|robot@|bot@|daemon@|mailer@|receipts?@|digest@|updates@)|-bounces@"
)
ROLE = r"^(team|hello|hi|info|contact|admin|support|help|billing|invoices?|accounts?|security|sales|marketing|careers|press)@"
SERVICE_NAME = r"\b(notifications?|no.?reply|newsletter|daemon|mailer|digest)\b"
MACHINE_DOMAIN = r"^(mail|email|em|mailer|notify|notifications|alerts|bounce|bounces|smtp|sendgrid|mailgun|amazonses)\."
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"


def norm_email(email: Column) -> Column:
    """Trimmed, lower-cased, without a plus tag; null if there is no @."""
    e = F.split(F.lower(F.trim(email)), "@")
    return F.when(F.contains(email, F.lit("@")), F.concat(F.split(e[0], r"\+")[0], F.lit("@"), e[1]))


def norm_person(name: Column) -> Column:
    """Lower-case name tokens without quotes, titles, digits or letters beyond a-z; null if none is left."""
    n = F.regexp_replace(F.regexp_replace(F.lower(name), "[\"'’]", ""), r"[^a-z\s.-]", " ")
    tokens = F.filter(F.split(n, r"[\s.]+"), lambda t: (t != "") & ~t.isin(HONORIFICS))
    return F.when(F.size(tokens) > 0, F.array_join(tokens, " "))


def norm_org(name: Column) -> Column:
    """Lower-case name without punctuation and legal or fund suffixes; null if nothing is left."""
    n = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", " "), rf"\b({ORG_SUFFIXES})\b\.?", "")
    n = F.trim(F.regexp_replace(n, r"\s+", " "))
    return F.when(n != "", n)


def block_keys(name: Column, email: Column, kind: Column) -> Column:
    """The keys under which a mention meets candidates: address, domain, initial with last name, and reversed."""
    tokens = F.split(name, " ")
    first, last = tokens[0], F.element_at(tokens, -1)
    prefix = F.concat(F.lit("n:"), kind, F.lit(":"))
    other = F.when(F.size(tokens) == 1, F.concat(prefix, first)).otherwise(F.concat(prefix, F.substring(last, 1, 1), first))
    keys = F.array(
        F.concat(F.lit("e:"), email),
        F.concat(F.lit("d:"), F.get(F.split(email, "@"), F.lit(1))),
        F.concat(prefix, F.substring(first, 1, 1), last),
        F.when(name.isNotNull(), other),
    )
    return F.array_compact(keys)


def strip_html(html: Column) -> Column:
    """The text of an HTML page: no scripts or styles, line ends for blocks, six entities, collapsed space."""
    t = F.regexp_replace(html, r"(?is)<(script|style).*?</\1>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<br\s*/?>", "\n"), r"(?i)</(p|div|li|h[1-6]|tr)>", "\n")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), "\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"^\s+|\s+$", "")
    return F.when(t != "", t)


def classify_address(email: Column, name: Column) -> Column:
    """'automated', 'role' (a hint that behaviour must confirm) or 'human'."""
    domain = F.get(F.split(email, "@"), F.lit(1))
    robot = email.rlike(f"(?i){ROBOT}") | domain.rlike(f"(?i){MACHINE_DOMAIN}")
    return (
        F.when(robot, "automated").when(email.rlike(f"(?i){ROLE}"), "role").when(name.rlike(f"(?i){SERVICE_NAME}"), "automated").otherwise("human")
    )


def mask_emails(text: Column) -> Column:
    """The text with every character of an address turned into a space, so places stay."""
    found = F.regexp_extract_all(text, F.lit(f"({EMAIL})"), F.lit(1))
    parts = F.zip_with(F.split(text, EMAIL, -1), found, lambda t, e: F.concat(t, F.repeat(F.lit(" "), F.coalesce(F.length(e), F.lit(0)))))
    return F.array_join(parts, "")


def document_id(source: Column, external_id: Column, kind: Column, title: Column, occurred_at: Column, owner: Column) -> Column:
    """A content-derived id, so reading a source again changes nothing."""
    e = lambda c: F.coalesce(c, F.lit(""))
    key = F.when(e(external_id) != "", F.concat_ws(":", source, external_id)).otherwise(F.concat_ws(":", source, e(kind), e(title), e(occurred_at)))
    key = F.concat(key, F.when(e(owner) != "", F.concat(F.lit("@"), owner)).otherwise(""))
    return F.concat(F.lit("doc_"), F.substring(F.sha1(key.cast("binary")), 1, 12))
