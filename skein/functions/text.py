"""Scalar functions on text, refs, times and vectors' names, as column expressions.

All are null in, null out unless said otherwise. Word characters are `[\\p{L}\\p{N}_]`, as `\\w` is ASCII on the JVM.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

WORD = r"[\p{L}\p{N}_]+"
#: Replies that say nothing by themselves.
LOW_SIGNAL = ("ok", "yes", "yep", "no", "+1", "thanks", "thx", "да", "нет", "ок", "окей", "спасибо", "ага", "угу")
#: Words without content; a parameter of the functions that use it.
STOPWORDS = tuple("a an and are as at be but by for from had has have he her his i if in into is it its my no not of on or our she so "
                  "that the their them then there they this to up was we were which who will with you your".split())


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def estimated_tokens(text: Column | str) -> Column:
    """Number of UTF-8 bytes divided by 4, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.octet_length(_col(text)) / 4)).cast("int")


def words(text: Column | str) -> Column:
    """Lower-case words in order."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD), F.lit(0))


def is_noise(token: Column, stopwords: tuple[str, ...] = STOPWORDS, skipped: tuple[str, ...] = ()) -> Column:
    """A stop word, a skipped token, or 3 to 8 hexadecimal letters (so `added` and `face` are noise too)."""
    low = F.lower(token)
    return low.isin(*stopwords) | (token.isin(*skipped) if skipped else F.lit(False)) | low.rlike("^[0-9a-f]{3,8}$")


def tokens(text: Column | str, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Words that are not noise."""
    return F.filter(words(text), lambda w: ~is_noise(w, stopwords))


def term_tokens(text: Column | str, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Latin terms of three letters or more, for term weights."""
    found = F.regexp_extract_all(F.lower(_col(text)), F.lit(r"(?<![\p{L}\p{N}_])[a-z][a-z0-9_]{2,}(?![\p{L}\p{N}_])"), F.lit(0))
    return F.filter(found, lambda w: ~is_noise(w, stopwords))


def sentences(text: Column | str) -> Column:
    """Split after . ! or ? before white space and an ASCII capital; trimmed, without blanks."""
    parts = F.split(_col(text), r"(?<=[.!?])\s+(?=[A-Z])")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def cleaned(text: Column | str) -> Column:
    """Lines without trailing white space, three and more newlines as two, trimmed."""
    lines = F.regexp_replace(F.regexp_replace(_col(text), r"\r\n?", "\n"), r"(?m)[^\S\n]+$", "")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def low_signal(text: Column | str) -> Column:
    """Blank (null too), a stock reply, no letter or digit, or any symbol character."""
    t = F.lower(F.trim(F.coalesce(_col(text), F.lit(""))))
    return (t == "") | t.isin(*LOW_SIGNAL) | ~t.rlike(r"[\p{L}\p{N}]") | t.rlike(r"\p{S}")


def keyword_query(text: Column | str) -> Column:
    """Control characters and punctuation but ' and - as spaces, collapsed. Compatibility forms: apply `compatible` first."""
    t = F.regexp_replace(_col(text), r"\p{C}", " ")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}_\s'\-]", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


@F.pandas_udf(S.StringType())
def compatible(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition (NFKC)."""
    return text.str.normalize("NFKC")


@F.pandas_udf(S.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """HTML entities as characters."""
    import html

    return text.map(html.unescape, na_action="ignore")


def html_text(markup: Column | str) -> Column:
    """Text of HTML: scripts and styles dropped, tags as spaces, entities resolved, white space collapsed."""
    t = F.regexp_replace(_col(markup), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(unescaped(t), r"\s+", " "))


def display_text(text: Column | str) -> Column:
    """A snippet without frontmatter block and [HH:MM:SS] marks."""
    t = F.regexp_replace(_col(text), r"(?s)^---\n.*?\n---\n?", "")
    return F.trim(F.regexp_replace(t, r"\[\d{2}:\d{2}:\d{2}\]\s*", ""))


def reference(namespace: Column | str, document_ref: Column | str) -> Column:
    return F.concat(_col(namespace), F.lit(":"), _col(document_ref))


def namespace_of(ref: Column | str) -> Column:
    """What stands before the first colon; null without one."""
    return F.when(F.instr(_col(ref), ":") > 1, F.substring_index(_col(ref), ":", 1))


def document_of(ref: Column | str) -> Column:
    """What stands after the first colon; null without one."""
    r = _col(ref)
    return F.when(F.instr(r, ":") > 1, r.substr(F.instr(r, ":") + 1, F.length(r)))


def message_dialog(ref: Column | str) -> Column:
    return F.regexp_extract(_col(ref), r"^telegram:dialog:(\d+):message:(\d+)$", 1).try_cast("long")


def message_number(ref: Column | str) -> Column:
    return F.regexp_extract(_col(ref), r"^telegram:dialog:(\d+):message:(\d+)$", 2).try_cast("long")


def composite(*parts: Column | str) -> Column:
    """Parts joined by the unit separator; null parts are empty."""
    return F.concat_ws("\x1f", *[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts])


def record_id(text: Column | str) -> Column:
    """u8_ and URL-safe base64 without padding or line breaks."""
    encoded = F.regexp_replace(F.base64(F.encode(_col(text), "UTF-8")), r"[\r\n=]", "")
    return F.concat(F.lit("u8_"), F.translate(encoded, "+/", "-_"))


def record_text(identifier: Column | str) -> Column:
    """The text of a record_id."""
    body = F.translate(F.substr(_col(identifier), F.lit(4)), "-_", "+/")
    return F.decode(F.unbase64(F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))), "UTF-8")


def chunk_checksum(kind: Column | str, body: Column | str) -> Column:
    return F.sha2(F.concat_ws("\n", _col(kind), _col(body)), 256)


def meta_checksum(title: Column | str, tags: Column | str) -> Column:
    """Of the title and the sorted tags."""
    return F.sha2(F.concat_ws("\n", F.coalesce(_col(title), F.lit("")), F.concat_ws(",", F.array_sort(_col(tags)))), 256)


def chunk_id(kind: Column | str, body: Column | str, index: Column | str, strategy: Column | str) -> Column:
    """Content-addressed: equal content at an equal place under an equal strategy has one id."""
    return F.sha2(F.concat_ws(":", chunk_checksum(kind, body), _col(index).cast("string"), _col(strategy)), 256)


def stable_rowid(*parts: Column | str) -> Column:
    """63-bit number of a composite key."""
    return F.xxhash64(composite(*parts)).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def json_fingerprint(**fields: Column | str) -> Column:
    """SHA-256 of the JSON object of the fields in the order of their names; null fields are left out."""
    return F.sha2(F.to_json(F.struct(*[_col(fields[k]).alias(k) for k in sorted(fields)])), 256)


def json_list(text: Column | str) -> Column:
    """A JSON list of strings; empty where it is none."""
    return F.coalesce(F.from_json(_col(text), "array<string>"), F.array().cast("array<string>"))


def json_map(text: Column | str) -> Column:
    """A JSON object of strings; empty where it is none."""
    return F.coalesce(F.from_json(_col(text), "map<string,string>"), F.create_map().cast("map<string,string>"))


@F.pandas_udf(S.ArrayType(S.FloatType()))
def decoded_floats(blob: pd.Series) -> pd.Series:
    """Little-endian float32 blobs."""
    import numpy as np

    return blob.map(lambda b: np.frombuffer(b, dtype="<f4"), na_action="ignore")


@F.pandas_udf(S.BinaryType())
def encoded_floats(vector: pd.Series) -> pd.Series:
    import numpy as np

    return vector.map(lambda v: np.asarray(v, dtype="<f4").tobytes(), na_action="ignore")


def moment(text: Column | str) -> Column:
    """A time from epoch seconds, ISO 8601 (also with Z) or RFC 2822; null for anything else."""
    t = F.trim(_col(text))
    number = F.when(t.rlike(r"^-?\d+(\.\d+)?$"), F.timestamp_seconds(t.try_cast("double")))
    mail = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3},\s*", ""), r"\s*\([^)]*\)$", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(number, F.when(t.rlike(r"^\d{4}-\d\d-\d\d"), t.try_cast("timestamp")), F.when(t.rlike(r"^[A-Za-z0-9]"), mail))


def order_key(number: Column | str) -> Column:
    return F.lpad(_col(number).cast("string"), 20, "0")


def duration_text(seconds: Column | str) -> Column:
    """45s, 3m05s, 2h01m."""
    s = F.floor(_col(seconds)).cast("long")
    return (F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm%02ds", F.floor(s / 60), s % 60))
            .otherwise(F.format_string("%dh%02dm", F.floor(s / 3600), F.floor(s / 60) % 60)))


def elapsed_text(milliseconds: Column | str) -> Column:
    """Milliseconds below a second, else whole seconds as h, m and s."""
    ms = _col(milliseconds).cast("double")
    s = F.greatest(F.lit(1), F.bround(ms / 1000)).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return (F.when(ms < 1000, F.format_string("%dms", F.bround(ms).cast("long"))).when(h > 0, F.format_string("%dh%02dm%02ds", h, m, r))
            .when(m > 0, F.format_string("%dm%02ds", m, r)).otherwise(F.format_string("%ds", s)))


def duration_seconds(text: Column | str) -> Column:
    """Seconds of 60s, 10m, 2h, 1d or a bare number; null unless more than 0."""
    t = F.lower(F.trim(_col(text)))
    number = F.regexp_extract(t, r"^(\d+)\s*([smhd]?)$", 1).try_cast("long")
    unit = F.regexp_extract(t, r"^(\d+)\s*([smhd]?)$", 2)
    seconds = number * F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).otherwise(1)
    return F.when(seconds > 0, seconds)


def tags_text(tags: Column | str) -> Column:
    """Trimmed tags without blanks, joined by spaces."""
    return F.concat_ws(" ", F.filter(F.transform(_col(tags), lambda s: F.trim(s)), lambda t: t != ""))


def header(headers: Column | str, name: str) -> Column:
    """The value of the first header of a name, whatever its case."""
    return F.try_element_at(F.filter(_col(headers), lambda h: F.lower(h["name"]) == name.lower()), F.lit(1))["value"]


def base64url_text(data: Column | str) -> Column:
    """URL-safe base64 as text; empty where it cannot be decoded."""
    body = F.regexp_replace(F.translate(_col(data), "-_", "+/"), r"[=\s]", "")
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))
    return F.coalesce(F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8"), F.lit(""))


def weights(text: Column | str) -> Column:
    """Weights as text=0.7,meta=0.3; null unless both are there and add up to 1 within 0.001."""
    found = F.transform_values(F.str_to_map(F.regexp_replace(_col(text), r"\s", ""), F.lit(","), F.lit("=")), lambda _, v: v.try_cast("double"))
    total = F.try_element_at(found, F.lit("text")) + F.try_element_at(found, F.lit("meta"))
    return F.when((F.abs(total - 1) <= 0.001) & (F.size(found) == 2), found)


def model_suffix(model: Column | str) -> Column:
    """A table suffix of a model name: the part after the last slash, lower case, other characters as _."""
    return F.trim(F.regexp_replace(F.lower(F.substring_index(_col(model), "/", -1)), r"[^a-z0-9]+", "_"), F.lit("_"))
