"""Text, hash, date and JSON expressions; all run in the JVM unless their name ends in _udf or _udtf."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Marks that normalised text drops, and the separators of words in English names.
DROPPED = r"[\s，。、？?！!：:；;（）()【】\[\]\"'`~,.]+"
NAME_SEPARATORS = r"[\s/&()\-]+"


def _unicode(pattern: str) -> str:
    return "(?U)" + pattern


def normalised(text: Column) -> Column:
    """Lower case without white space and punctuation; null as empty."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _unicode(DROPPED), "")


def terms(text: Column) -> Column:
    """Distinct runs of a-z and 0-9, and pairs of neighbouring characters of the rest."""
    clean = normalised(text)
    rest = F.regexp_replace(clean, "[a-z0-9]+", "")
    pairs = F.when(F.char_length(rest) >= 2, F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(rest) - 1, F.lit(1))), lambda k: F.substring(rest, k, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.regexp_extract_all(clean, F.lit("[a-z0-9]+"), 0), pairs))


def after_last(text: Column, *separators: str) -> Column:
    """What follows the last of each separator, applied in the order given."""
    for separator in separators:
        text = F.element_at(F.split(text, re.escape(separator)), -1)
    return text


def iri_tail(iri: Column) -> Column:
    """The local name: after the last `#`, then `/`, then `:`."""
    return after_last(iri, "#", "/", ":")


def slug(text: Column, longest: int = 120, separator: str = "-", fallback: str = "item") -> Column:
    """Letters, digits, `_`, `.` and `-` kept, other runs as one separator, ends trimmed, cut to a length."""
    made = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), _unicode(r"[^\w.\-]+"), separator)
    made = F.substring(F.regexp_replace(made, rf"^[{re.escape(separator)}._]+|[{re.escape(separator)}._]+$", ""), 1, longest)
    return F.when(made == "", fallback).otherwise(made)


def percent_encoded(text: Column) -> Column:
    """UTF-8 percent-encoding with only letters, digits and `-._~` kept."""
    out = F.url_encode(text)
    for form, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(form), F.lit(plain))
    return out


def minted_iri(namespace: str, kind: Column, id_: Column) -> Column:
    return F.concat(F.lit(namespace), kind, F.lit(":"), percent_encoded(id_))


def short_hash(*parts: Column, length: int = 24) -> Column:
    """The first hex digits of the SHA-256 of the parts joined by `|`."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def content_digest(title: Column, body: Column) -> Column:
    return F.sha2(F.concat(title, F.lit("\n"), body), 256)


def fingerprint(rows: Column) -> Column:
    """SHA-256 of an array of texts in its order."""
    return F.sha2(F.array_join(rows, "\n"), 256)


def collapsed(text: Column) -> Column:
    """`<br>` marks as spaces, runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)<br\s*/?>", " "), _unicode(r"\s+"), " "))


def keywords(names: Column, english: Column) -> Column:
    """Names, then words of two letters or more of the English ones; the first of those equal without case stays."""
    split = F.filter(F.flatten(F.transform(english, lambda n: F.split(n, NAME_SEPARATORS))), lambda w: F.char_length(w) > 1)
    every = F.filter(F.concat(names, split), lambda w: w.isNotNull() & (w != ""))
    lowered = F.transform(every, lambda w: F.lower(w))
    return F.filter(every, lambda w, k: F.array_position(lowered, F.lower(w)) == k + 1)


def code_of(iri: Column, prefix: str = "") -> Column:
    """An upper-case code from a local name: other characters as dashes."""
    return F.concat(F.lit(prefix), F.upper(F.regexp_replace(F.regexp_replace(iri_tail(iri), r"[^A-Za-z0-9]+", "-"), r"^-+|-+$", "")))


def headings(text: Column, name: str) -> Column:
    """The body under a `## name` heading up to the next heading of that level; empty if there is none."""
    body = F.regexp_extract(text, rf"(?ms)^##\s+{re.escape(name)}\s*$\n(.*?)(?=^##\s|\z)", 1)
    return F.regexp_replace(body, r"^\s+|\s+$", "")


def sections(text: Column) -> Column:
    """Pieces that each start at a `## ` heading."""
    return F.filter(F.split(text, r"(?m)(?=^##\s)"), lambda s: F.trim(s) != "")


def filled(template: str, values: dict[str, Column]) -> Column:
    """`$name` and `${name}` replaced where values has the name; other marks stay."""
    out = F.lit(template)
    for name, value in values.items():
        text = F.coalesce(value.cast("string"), F.lit(""))
        out = F.replace(out, F.lit("${" + name + "}"), text)
        out = F.regexp_replace(out, F.lit(rf"\${re.escape(name)}\b"), F.regexp_replace(text, F.lit(r"([\\$])"), F.lit(r"\\$1")))
    return out


def local_day(at: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def local_minute(at: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(at, zone), "HH:mm")


def percentage(part: Column, whole: Column, digits: int = 1, empty: float = 0.0) -> Column:
    return F.when(whole > 0, F.round(F.lit(100.0) * part / whole, digits)).otherwise(F.lit(empty))


def ratio(part: Column, whole: Column, digits: int = 6, empty: float = 1.0) -> Column:
    return F.when(whole > 0, F.round(part.cast("double") / whole, digits)).otherwise(F.lit(empty))


def parsed_or(text: Column, schema: str, default: Column) -> Column:
    """JSON of the schema, the default where it is null or broken."""
    return F.coalesce(F.from_json(text, schema, {"mode": "PERMISSIVE"}), default)


def column_index(letters: Column) -> Column:
    """Zero-based index of a spreadsheet column."""
    codes = F.transform(F.filter(F.split(F.upper(letters), ""), lambda c: c != ""), lambda c: F.ascii(c) - 64)
    return F.aggregate(codes, F.lit(0), lambda total, c: total * 26 + c) - 1


def is_external(id_: Column) -> Column:
    return F.coalesce(id_.startswith("ext."), F.lit(False))


def unwrapped_url(url: Column) -> Column:
    """The address that a search engine's redirect leads to, in its `uddg` parameter; other addresses as they are."""
    inner = F.regexp_extract(url, r"[?&]uddg=([^&#]*)", 1)
    return F.when(inner != "", F.url_decode(inner)).otherwise(url)


def compatible_unit(declared: Column, actual: Column) -> Column:
    """Equal, or the actual unit refines a placeholder of the declared one."""
    per_month = (declared == "unit/month") & actual.endswith("/month") & ~actual.startswith("CNY/")
    per_unit = (declared == "CNY/unit") & actual.startswith("CNY/") & (actual != "CNY/month")
    return F.coalesce((declared == actual) | per_month | per_unit, F.lit(False))


def first_object(text: str | None) -> str | None:
    """The first JSON object that a text holds, fenced or among other words, as canonical JSON; null without one."""
    if not text:
        return None
    decoder = json.JSONDecoder()
    at = text.find("{")
    while at >= 0:
        try:
            value, _ = decoder.raw_decode(text, at)
            return canonical_json(value)
        except ValueError:
            at = text.find("{", at + 1)
    return None


def canonical_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def first_object_udf(texts):
    return texts.map(first_object)


def byte_chunks(text: str | None, most: int) -> Iterator[str]:
    """Pieces of at most `most` UTF-8 bytes: whole lines as long as they fit, longer lines cut between characters."""
    if most < 4:
        raise ValueError("a chunk needs 4 bytes at least")
    held, size = [], 0
    for line in (text or "").splitlines(keepends=True):
        raw = line.encode()
        if size + len(raw) > most and held:
            yield "".join(held)
            held, size = [], 0
        while len(raw) > most:
            cut = most
            while raw[cut] & 0xC0 == 0x80:
                cut -= 1
            yield raw[:cut].decode()
            raw = raw[cut:]
        if raw:
            held.append(raw.decode())
            size += len(raw)
    if held:
        yield "".join(held)


@F.udtf(returnType="chunk_no: int, chunk: string")
class ByteChunks:
    """SELECT * FROM t, LATERAL byte_chunks(text, 2048)."""

    def eval(self, text: str, most: int):
        for k, chunk in enumerate(byte_chunks(text, most)):
            yield k, chunk


def register(spark) -> None:
    spark.udtf.register("byte_chunks", ByteChunks)
    spark.udf.register("first_json_object", first_object_udf)
