"""Column functions on addresses, headers and bodies."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of no width that bodies are freed of. U+200B to U+200F, U+202A to U+202E, U+2060, U+FEFF.
ZERO_WIDTH = "[\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}\\x{FEFF}]"
#: File types that text is taken from, and the largest size. Fixed values.
SUPPORTED = ("pdf", "docx", "hwp", "pptx", "xlsx", "csv", "txt")
MAX_ATTACHMENT = 10 * 1024 * 1024
#: Platforms of known hosts. Fixed values.
PLATFORMS = {"imap.gmail.com": "gmail", "imap.naver.com": "naver", "imap.daum.net": "daum", "imap.mail.me.com": "icloud", "imap.kakao.com": "kakao", "imap.mail.yahoo.com": "yahoo"}
#: Words in the local part of addresses that no person has. Fixed values.
GENERIC = ("noreply", "no-reply", "no.reply", "donotreply", "info", "support", "admin", "hello", "contact", "mail", "newsletter", "update", "service", "team", "automated", "mailer", "postmaster", "alert", "recap", "recommend", "suggestion", "insight", "security", "comment", "digest", "marketing", "promo", "bot", "notification")
#: Names under which brands write. Fixed values.
BRANDS = ("instagram", "pinterest", "google", "google play", "mcafee", "twitter", "x", "discord", "microsoft", "xbox", "neo4j", "the neo4j team", "facebook", "linkedin", "naver", "kakao", "amazon", "apple", "netflix", "youtube", "spotify", "slack", "zoom", "adobe", "dropbox", "paypal", "ebay", "samsung", "lg", "steam", "playstation", "nintendo", "airbnb", "uber", "github", "figma", "notion")


def address(field: Column) -> Column:
    """`Name <a@b>` or a bare address -> lower-case address."""
    inner = F.regexp_extract(field, "<([^>]+)>", 1)
    return F.lower(F.trim(F.when(inner != "", inner).otherwise(field)))


def display_name(field: Column) -> Column:
    """`"Name" <a@b>` -> Name without quotes; null without one."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(field, "^([^<]*)<", 1), '"', "")), F.lit(""))


def addresses(field: Column) -> Column:
    """All addresses of a field, lower-case."""
    return F.transform(F.regexp_extract_all(field, F.lit(r"[\w.+\-]+@[\w.\-]+"), F.lit(0)), F.lower)


def person_header(name: Column, mail: Column) -> Column:
    """`name <mail>`, the local part where there is no name."""
    return F.concat(F.coalesce(F.nullif(F.trim(name), F.lit("")), F.split_part(mail, F.lit("@"), F.lit(1))), F.lit(" <"), mail, F.lit(">"))


def direction(mark: Column, sender: Column, owner: Column) -> Column:
    """From the header's mark; without one, by whether the owner sent it."""
    return F.when(mark == "발신", "sent").when(mark == "수신", "received").when((F.coalesce(mark, F.lit("")) == "") & sender.isNotNull(), F.when(F.lower(sender) == F.lower(owner), "sent").otherwise("received"))


#: Pattern and replacement, in the order that the steps need. Fixed values.
CLEANING = (
    (r"(?s)<!--.*?-->", " "), (r"(?is)<style[^>]*>.*?</style>", " "), (r"(?is)<script[^>]*>.*?</script>", " "), (r"<[^>]+>", " "),
    (r"https?://\S+", " "), (ZERO_WIDTH, ""), ("\r\n", "\n"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"),
)


def clean_body(html: Column) -> Column:
    """Without comments, styles, scripts, tags, links and characters of no width; with single blanks and at most one empty line."""
    for pattern, by in CLEANING:
        html = F.regexp_replace(html, pattern, by)
    return F.regexp_replace(html, r"^\s+|\s+$", "")


def attachment_status(name: Column, size: Column) -> Column:
    extension = F.lower(F.element_at(F.split(name, r"\."), -1))
    return F.when(~extension.isin(*SUPPORTED), "unsupported").when(size > MAX_ATTACHMENT, "too_large").otherwise("included")


def platform(host: Column) -> Column:
    """Known hosts by name, others by the label before the last, without those that every host has."""
    host = F.lower(F.trim(F.coalesce(host, F.lit(""))))
    labels = F.filter(F.split(host, r"\."), lambda x: ~x.isin("imap", "mail", "www") & (x != ""))
    known = F.create_map(*(F.lit(x) for pair in PLATFORMS.items() for x in pair))
    return F.coalesce(known[host], F.when(F.size(labels) >= 2, F.get(labels, F.size(labels) - 2)), F.nullif(host, F.lit("")), F.lit("imap"))


def brand(mail: Column, name: Column) -> Column:
    """Whether the local part holds a word that no person's does, or the name is a brand's."""
    local = F.lower(F.split_part(mail, F.lit("@"), F.lit(1)))
    return local.rlike("|".join(w.replace(".", r"\.") for w in GENERIC)) | F.coalesce(F.lower(F.trim(name)).isin(*BRANDS), F.lit(False))


def shown_name(mail: Column, name: Column) -> Column:
    """Of a brand or a box that no person writes from, the label before the last of the domain (the first of a domain of two); of a person the name, else the local part."""
    named = F.nullif(F.trim(name), F.lit(""))
    labels = F.split(F.split_part(mail, F.lit("@"), F.lit(2)), r"\.")
    label = F.get(labels, F.when(F.size(labels) >= 3, F.size(labels) - 2).otherwise(0))
    local = F.nullif(F.split_part(mail, F.lit("@"), F.lit(1)), F.lit(""))
    unknown = F.lit("(알 수 없음)")
    return F.when(F.coalesce(mail, F.lit("")) == "", F.coalesce(named, unknown)).when(brand(mail, name), label).otherwise(F.coalesce(named, local, unknown))


def is_reply(subject: Column) -> Column:
    """Whether a subject begins with `Re:`, in any case."""
    return F.coalesce(subject.rlike("^(?i)re:"), F.lit(False))


def counterparty(sender: Column, receiver: Column, owner: Column) -> Column:
    """The address at the other end: the receiver's of what the owner sent, else the sender's."""
    return F.when(address(sender) == F.lower(owner), address(receiver)).otherwise(address(sender))


def block_time(raw: Column) -> Column:
    """Of `YYYY-MM-DD HH:MM:SS` (mails) or `YYYY-MM-DD` (chats); null of anything else."""
    return F.coalesce(F.try_to_timestamp(raw, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(raw, F.lit("yyyy-MM-dd"))).cast("timestamp_ntz")


def relation_tag(text: Column) -> tuple[Column, Column]:
    """`[관계: X] rest` -> X (null without one), rest."""
    return F.nullif(F.trim(F.regexp_extract(text, r"^\[관계:\s*([^\]]+)\]", 1)), F.lit("")), F.trim(F.regexp_replace(text, r"^\[관계:\s*[^\]]+\]\s*", ""))


def profile(output: Column, name: Column) -> tuple[Column, Column]:
    """A model's answer on a person (`관계: ...` and `자주 주고 받은 내용: ...` lines) -> description, relation (null without a tag); nulls without an answer."""
    line = lambda field: F.trim(F.regexp_extract(output, rf"{field}:\s*([^\n]+)", 1))
    relation, rest = relation_tag(line("관계"))
    known = F.coalesce(F.nullif(name, F.lit("")), F.lit("알 수 없음"))
    return F.concat(F.lit("이름: "), known, F.lit("\n관계: "), rest, F.lit("\n자주 주고 받은 내용: "), line("자주 주고 받은 내용")), relation


#: Pattern and replacement, in the order that the steps need. Fixed values.
STRIPPING = (
    (r"\[Data:.*?\]|\[데이터:.*?\]", ""), (r"\*+|#+", ""), (r"(?m)^[ \t]*[-*]?[ \t]*(ID|계정):\s*\S+[ \t]*\n?", ""),
    (r"(ID|계정):\s*\S+", ""), (r"(?m)^[ \t]*(?:\d+[.)]|[-*])[ \t]*$", ""), (r"\n{3,}", "\n\n"),
)


def strip_ids(answer: Column) -> Column:
    """An answer as shown: without data references, marks of emphasis, id and account fields and empty numbers."""
    for pattern, by in STRIPPING:
        answer = F.regexp_replace(answer, pattern, by)
    return F.regexp_replace(answer, r"^\s+|\s+$", "")
