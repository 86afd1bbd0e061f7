"""Row predicates, ordered classifiers and text validators."""

from __future__ import annotations

import ipaddress
from collections.abc import Mapping, Sequence
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a question as one about instances, by kind.
TIME = (
    "昨天|今天|今日|当前|现在|目前|近一周|近一个月|最近|过去|未来|上周|本周|上个月|这个月|本月|上一个班次|班次|小时内|分钟内|即将|接下来|一段时间|历史记录|"
    r"\d+\s*(小时|分钟|天|周|月|季度|年)"
)
QUANTITY = r"多少|几个|几片|几台|几批|几张|top\s*\d*n?|前\s*\d+|最高的\s*\d|排名|超过了|超过\s*\d|多了\s*\d|统计|总数|占比|list\b|清单输出"
INSTANCE = r"\b(eqp|cvd|pvd|cmp|litho|etch)\s*\d+\b|\blot\s*[a-z0-9]{3,}|\bwo\d+|\b[a-z]{3,}\d{3,}\b|客户\s*[a-z]\b|型号\s*[a-z]\b|recipe\s*[a-z]\b|step\s*\d+|chamber\s*[a-z0-9]\b|\d+\s*号腔"
DEIXIS = "这些|那些|这批|该批|这几|那几|这台|该台|这片|这张|这条 ?lot"
SECRET = r"(?i)(api[_-]?key|secret|password|passwd|token|authorization)\s*[:=]"


def instance_signals(question: Column) -> Column:
    """Array of the kinds of instance-level signals in a question, in the order time, quantity, instance, deixis."""
    tests = [("time", TIME), ("quantity", QUANTITY), ("instance", INSTANCE), ("deixis", DEIXIS)]
    return F.filter(F.array(*[F.when(question.rlike(f"(?Uiu){pattern}"), name) for name, pattern in tests]), lambda x: x.isNotNull())


def noise_feature(code: Column, fixed: Sequence[str], suffix: str) -> Column:
    """Blank, listed, without a Latin letter, or with a suffix that marks noise."""
    clean = F.lower(F.trim(F.coalesce(code, F.lit(""))))
    return (clean == "") | clean.isin(*[x.lower() for x in fixed]) | ~clean.rlike("[a-z]") | clean.rlike(suffix)


def first_match(cases: Sequence[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The label of the first condition that holds; a null condition doesn't."""
    out = None
    for condition, label in cases:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(otherwise)


def keyword_class(text: Column, blocked: Sequence[str], classes: Sequence[tuple[str, Sequence[str]]], otherwise: str | None = None) -> Column:
    """The first class one of whose words the text holds, none if it holds a blocked word."""
    lowered = F.lower(F.coalesce(text, F.lit("")))

    def any_of(words: Sequence[str]) -> Column:
        out = F.lit(False)
        for word in words:
            out = out | lowered.contains(word.lower())
        return out

    return F.when(any_of(blocked), otherwise).otherwise(first_match([(any_of(words), name) for name, words in classes], otherwise))


def side_of(member: Column, sides: Mapping[str, Sequence[str]], otherwise: str = "cross") -> Column:
    return first_match([(member.isin(*names), side) for side, names in sides.items()], otherwise)


def marker_hits(text: Column, markers: Sequence[str]) -> Column:
    """How many distinct markers a text holds."""
    return F.size(F.filter(F.array(*map(F.lit, markers)), lambda m: F.coalesce(text, F.lit("")).contains(m)))


def gate_error(text: Column, priorities: Sequence[tuple[str, Sequence[str]]], otherwise: str = "system") -> Column:
    return keyword_class(text, [], priorities, otherwise)


def focus_nodes(text: Column) -> Column:
    """The nodes that a validator's report names after `Focus Node:`, without angle brackets."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)Focus Node:\s*(<[^>]+>|\S+)"), 1)
    return F.filter(F.array_distinct(F.transform(found, lambda t: F.regexp_replace(t, "^[<>]+|[<>]+$", ""))), lambda t: t != "")


def baseline_failure(error: Column, candidate: Column) -> Column:
    """True if a constraint violation is about nodes that the candidate's text doesn't hold; also if it names none.

    Both phrases have to be in the error; case doesn't matter.
    """
    lowered = F.lower(F.coalesce(error, F.lit("")))
    about = lowered.contains("constraint violation") & lowered.contains("focus node")
    body = F.lower(F.coalesce(candidate, F.lit("")))
    return about & ~F.exists(focus_nodes(lowered), lambda n: body.contains(n))


def article_errors(text: Column, needed: Sequence[str], banned: Sequence[str], least: int = 500) -> Column:
    """Array of problems: too short, missing sections, banned patterns, secrets."""
    body = F.coalesce(text, F.lit(""))
    checks = [F.when(F.char_length(body) < least, F.lit("too short"))]
    checks += [F.when(~body.contains(s), F.lit(f"missing {s}")) for s in needed]
    checks += [F.when(body.rlike(p), F.lit(f"banned {p}")) for p in banned]
    checks.append(F.when(body.rlike(SECRET), F.lit("secret")))
    return F.filter(F.array(*checks), lambda e: e.isNotNull())


# Fixed value: turns of phrase that count against an article's tone.
TURNS = "首先|其次|最后|综上"


def tone(text: Column) -> Column:
    """1 less a tenth for each turn of phrase, 0 at least."""
    return F.greatest(F.lit(0.0), 1.0 - F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TURNS)) / 10.0)


def factual(errors: Column, evidence: Column) -> Column:
    """1 for an article with evidence (a number of sources) and without errors, else 1 less an eighth for each error."""
    return F.when((F.coalesce(evidence, F.lit(0)) > 0) & (F.size(errors) == 0), 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.size(errors) / 8.0))


def report_errors(text: Column, numbers: Mapping[str, Column], most: int = 4000) -> Column:
    """Array of problems: labels or formatted numbers that don't appear, too long, secrets."""
    body = F.coalesce(text, F.lit(""))
    checks = [F.when(F.char_length(body) > most, F.lit("too long")), F.when(body.rlike(SECRET), F.lit("secret"))]
    for label, value in numbers.items():
        checks.append(F.when(~body.contains(label) | ~body.contains(F.format_number(value, 0)), F.lit(f"missing {label}")))
    return F.filter(F.array(*checks), lambda e: e.isNotNull())


def contains_value(value: Column, wanted: str, is_array: bool) -> Column:
    return F.array_contains(value, wanted) if is_array else value.contains(wanted)


def kept_items(items: Column, required: Sequence[str]) -> Column:
    """Structs of an array whose required fields are all there."""

    def whole(item: Column) -> Column:
        out = item.isNotNull()
        for name in required:
            out = out & item[name].isNotNull()
        return out

    return F.filter(items, whole)


# Fixed value: names of query keys that hold a credential.
SENSITIVE_KEYS = ("access_token", "api_key", "apikey", "auth", "authorization", "key", "password", "passwd", "secret", "signature", "sig", "token")
# Fixed value: names of this machine.
LOCAL_HOSTS = ("localhost", "localhost.localdomain")


def public_url(url: str | None) -> bool:
    """A web address of at most 2048 characters without user, private host or query key of a credential."""
    if not url or len(url.strip()) > 2048:
        return False
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").rstrip(".")
        port_ok = parts.port is None or parts.port > 0
    except ValueError:
        return False
    if parts.scheme not in ("http", "https") or not host or parts.username or parts.password or not port_ok or host in LOCAL_HOSTS:
        return False
    try:
        address = ipaddress.ip_address(host)
        if address.is_private or address.is_loopback or address.is_link_local or address.is_reserved:
            return False
    except ValueError:
        pass
    return not any(name.casefold() in SENSITIVE_KEYS for name, _ in parse_qsl(parts.query, keep_blank_values=True))


def is_public_url(url: Column) -> Column:
    """public_url() as an expression; a null is not public."""
    clean = F.trim(url)
    place = F.regexp_extract(clean, r"(?i)^https?://([^/?#]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_extract(place, r"^(\[[^\]]*\]|[^:]*)", 1)), r"\.+$", "")
    port = F.regexp_extract(place, r"^(?:\[[^\]]*\]|[^:]*)(:?.*)$", 1)
    good_port = port.isin("", ":") | (port.rlike(r"^:[0-9]{1,5}$") & F.substring(port, 2, 5).try_cast("int").between(1, 65535))
    octets = F.transform(F.split(host, r"\."), lambda o: o.try_cast("int"))
    a, b, c = (F.get(octets, F.lit(k)) for k in range(3))
    numeric = host.rlike(r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$") & ~F.exists(octets, lambda o: o > 255)
    private = (
        a.isin(0, 10, 127) | (a >= 240) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 192) & (b == 0) & c.isin(0, 2))
        | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )
    # of addresses in brackets only those of the global unicast range, less documentation, are public
    bracketed = host.startswith("[") & ~(host.rlike(r"^\[[23][0-9a-f]{3}:") & ~host.rlike(r"^\[(?:2001:0?db8|3fff):"))
    query = F.regexp_extract(clean, r"^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda p: F.coalesce(F.try_url_decode(F.split(p, "=")[0]), p))
    sensitive = F.exists(names, lambda n: F.lower(n).isin(*SENSITIVE_KEYS))
    return F.coalesce((F.char_length(clean) <= 2048) & (host != "") & ~place.contains("@") & good_port & ~host.isin(*LOCAL_HOSTS) & ~(numeric & private) & ~bracketed & ~sensitive, F.lit(False))
