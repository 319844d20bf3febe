"""Model output and reply text as column expressions: parsing, redaction, shaping, cutting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from roomgraph.fixed_values import (
    CLAUSE_END,
    ELLIPSIS,
    EMPTY_READ_MESSAGE,
    ERROR_MESSAGE,
    FILTERED_TEXT,
    INJECTION_PATTERNS,
    MASK,
    NO_TEXT_SENTINEL,
    REDACT_PATTERNS,
    REJECT_DEFAULT,
    REJECT_MESSAGES,
    RISK_ALIAS,
    RISK_LEVELS,
    RISK_TO_REPLY,
    SENTENCE_END,
    SENTINEL_TRIM,
)
from roomgraph.functions.words import WHITESPACE, lookup, strip

FREE_TEXT = ("ocr_text", "advice", "scene", "full_text")
TEXT_LIMITS = {"scene": 64, "ocr_text": 512, "advice": 128}

# ---- parsing --------------------------------------------------------------------------------

_FENCE = r"```(?:json)?\s*([\s\S]*?)\s*```"
_ADVICE = r'"advice"\s*:\s*"([^"]{1,128})"'


def unfenced(raw: Column) -> Column:
    text = strip(F.coalesce(raw, F.lit("")))
    return F.when(F.regexp_like(text, F.lit(_FENCE)), strip(F.regexp_extract(text, _FENCE, 1))).otherwise(text)


def outermost_object(text: Column) -> Column:
    """From the first opening to the last closing brace, empty when there is none."""
    return F.regexp_extract(text, r"\{[\s\S]*\}", 0)


def _kind(value: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def json_object(text: Column) -> Column:
    """The parsed object, null for anything else."""
    value = F.try_parse_json(F.nullif(text, F.lit("")))
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def _text_field(value: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(value, f"$.{name}", "string"), F.lit(""))


def _list_field(value: Column, name: str) -> Column:
    kind = _kind(value, f"$.{name}")
    listed = F.try_variant_get(value, f"$.{name}", "array<string>")
    comma = F.replace(F.try_variant_get(value, f"$.{name}", "string"), F.lit("，"), F.lit(","))
    items = F.when(kind == "STRING", F.split(comma, ",")).when(kind.startswith("ARRAY"), listed)
    trimmed = F.transform(items, lambda v: strip(F.coalesce(v, F.lit(""))))
    return F.slice(F.coalesce(F.filter(trimmed, lambda v: v != ""), F.array().cast("array<string>")), 1, 10)


def risk_level(value: Column) -> Column:
    word = F.lower(strip(F.coalesce(value, F.lit(""))))
    return F.coalesce(lookup(RISK_ALIAS, word), F.when(word.isin(*RISK_LEVELS), word), F.lit("none"))


def _valid(value: Column) -> Column:
    """Free texts must be strings within their limits; anything else fails the object."""
    ok = value.isNotNull()
    for name, limit in TEXT_LIMITS.items():
        kind = _kind(value, f"$.{name}")
        fits = (kind == "STRING") & (F.char_length(_text_field(value, name)) <= limit)
        ok = ok & (kind.isNull() | fits)
    return F.coalesce(ok, F.lit(False))


def _fields(value: Column) -> Column:
    risk = F.when(_kind(value, "$.risk_level") == "STRING", F.try_variant_get(value, "$.risk_level", "string"))
    return F.struct(
        _text_field(value, "scene").alias("scene"), _list_field(value, "objects").alias("objects"),
        _text_field(value, "ocr_text").alias("ocr_text"), _list_field(value, "keywords").alias("keywords"),
        risk_level(risk).alias("risk_level"), _text_field(value, "advice").alias("advice"),
    )


def parse_answers(df, raw: str = "raw_text"):
    """Adds ``result`` (scene, objects, ocr_text, keywords, risk_level, advice), ``stage``
    (json, braces, advice, none) and ``degraded``.

    The whole text as JSON, else the text between the outer braces, else the advice alone.
    """
    text = unfenced(F.col(raw))
    advice = F.regexp_extract(F.coalesce(raw, F.lit("")), _ADVICE, 1)
    none = F.array().cast("array<string>")
    bare = F.struct(
        F.lit("").alias("scene"), none.alias("objects"), F.lit("").alias("ocr_text"),
        none.alias("keywords"), F.lit("none").alias("risk_level"), F.col("_advice").alias("advice"),
    )
    stage = (
        F.when(_valid(F.col("_whole")), "json").when(_valid(F.col("_braced")), "braces")
        .when(F.col("_advice") != "", "advice").otherwise("none")
    )
    return (
        df.withColumn("_text", text)
        .withColumns(
            {"_whole": json_object(F.col("_text")), "_advice": advice,
             "_braced": json_object(outermost_object(F.col("_text")))}
        )
        .withColumn("stage", stage)
        .withColumn(
            "result",
            F.when(F.col("stage") == "json", _fields(F.col("_whole")))
            .when(F.col("stage") == "braces", _fields(F.col("_braced")))
            .otherwise(bare),
        )
        .withColumn("degraded", F.col("stage") != "json")
        .drop("_text", "_whole", "_braced", "_advice")
    )


def parse_read_text(raw: Column, max_chars: int = 2000) -> Column:
    """Plain text of a reading answer; JSON wrappers are opened, the empty mark removed."""
    text = unfenced(raw)
    value = F.when(text.startswith("{"), json_object(text))
    inner = F.coalesce(
        *[
            F.when(_kind(value, f"$.{k}") == "STRING", F.try_variant_get(value, f"$.{k}", "string"))
            for k in ("full_text", "text", "content")
        ]
    )
    body = F.coalesce(strip(inner), text)
    empty = F.btrim(body, F.lit(SENTINEL_TRIM)) == NO_TEXT_SENTINEL
    cut = F.substring(body, 1, max_chars) if max_chars > 0 else body
    return F.when(empty, "").otherwise(cut)


# ---- redaction and guards ------------------------------------------------------------------------


#: What every text with a hit of such a pattern has, found in one cheap scan: eleven digits, an at
#: sign, a Chinese character (one range in place of a list) before a capital.
_DIGITS, _PLATE = r"\p{Nd}{11}", r"[\u4e00-\u9fff][A-Z]"
#: The pattern's first part begins where no such character stands before it, or where the last hit
#: ended: the same hits, but a long run is read once and not from each of its characters.
_LOCAL = "[a-zA-Z0-9._%+-]"


def _single_pass(pattern: str) -> str:
    return pattern.replace(f"{_LOCAL}+@", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@").replace(r"\d", r"\p{Nd}")


def redact(df, column: str):
    """Masks ``column`` in place and adds ``n_<pattern>`` hit counts.

    Patterns apply in order, each to what the earlier ones left; a mask brings no new hit. Digits are
    those of any script. Texts that can't hold a pattern aren't searched for it, and those without a
    hit are not rewritten.
    """
    text = F.col(column)
    flags = {f"_{column}_digits": F.regexp_like(text, F.lit(_DIGITS)), f"_{column}_plate": F.regexp_like(text, F.lit(_PLATE))}
    df = df.withColumns(flags)
    for name, pattern in REDACT_PATTERNS:
        regex, count = _single_pass(pattern), f"n_{name}"
        may = {"email": F.contains(text, F.lit("@")), "plate": F.col(f"_{column}_plate")}.get(
            name, F.col(f"_{column}_digits"))
        df = df.withColumn(count, F.when(may, F.regexp_count(text, F.lit(regex))).otherwise(F.lit(0)))
        df = df.withColumn(
            column, F.when(F.col(count) > 0, F.regexp_replace(column, regex, MASK)).otherwise(text))
    return df.drop(*flags)


def banned_word(texts: list[Column], words: list[str]) -> Column:
    """First banned word, in list order, inside the joined texts; null when there is none."""
    joined = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in texts]))
    hits = [F.when(F.contains(joined, F.lit(word.lower())), F.lit(word)) for word in words if word]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def is_injection(text: Column) -> Column:
    together = "(?i)" + "|".join(f"(?:{p})" for p in INJECTION_PATTERNS)
    return F.coalesce(text.rlike(together), F.lit(False))


def name_list(text: Column, key: str) -> Column:
    """Names under ``key`` of the JSON object between the first and the last brace of a text:
    stripped, without empty ones; a plain string is a list of one."""
    inner = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    value = F.try_variant_get(F.try_parse_json(inner), f"$.{key}", "array<string>")
    single = F.try_variant_get(F.try_parse_json(inner), f"$.{key}", "string")
    names = F.coalesce(value, F.array(single))
    return F.filter(F.transform(names, strip), lambda n: F.coalesce(n, F.lit("")) != "")


def hide_prompt(text: Column, prompt: str, size: int = 40) -> Column:
    """Replace every full 40-character piece of the prompt that shows up in a text."""
    for start in range(0, len(prompt) - size + 1, size):
        text = F.replace(text, F.lit(prompt[start : start + size]), F.lit(FILTERED_TEXT))
    return text


def mentioned_objects(text: Column) -> Column:
    """``**name (english)**`` mentions as ``array<struct<name,name_en>>``."""
    pattern = F.lit(r"\*\*([^*]+?)\s*\(([^)]+)\)\*\*")
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, pattern, F.lit(1)).alias("a"),
        F.regexp_extract_all(text, pattern, F.lit(2)).alias("b"),
    )
    return F.transform(
        pairs, lambda p: F.struct(strip(p["a"]).alias("name"), strip(p["b"]).alias("name_en"))
    )


# ---- cutting --------------------------------------------------------------------------------------------

_WS = "[" + "".join(c if ord(c) > 127 else f"\\x{ord(c):02x}" for c in WHITESPACE) + "]"


def segment_pattern(limit: int) -> str:
    """One piece of at most ``limit`` characters after leading white space.

    In this order: what is left if it fits, up to the last sentence end, up to the last
    clause end, up to the last space, a hard cut.
    """
    body = "[^\\n]"
    ends = "[" + re.escape(SENTENCE_END) + "]"
    clauses = "[" + re.escape(CLAUSE_END) + "]"
    return (
        f"{_WS}*({body}{{1,{limit}}}$|{body}{{0,{limit - 1}}}{ends}|{body}{{0,{limit - 1}}}{clauses}"
        f"|{body}{{1,{limit - 1}}} |{body}{{{limit}}})"
    )


def segments(text: Column, limit: int = 30) -> Column:
    """Pieces to read out, each within the limit and cut where the sense allows."""
    if limit <= 0:
        return F.when(strip(text) == "", F.array().cast("array<string>")).otherwise(F.array(text))
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda v: v != "")
    pieces = F.flatten(
        F.transform(lines, lambda v: F.regexp_extract_all(v, F.lit(segment_pattern(limit)), F.lit(1)))
    )
    return F.filter(F.transform(pieces, strip), lambda v: v != "")


def chunks(text: Column, size: int = 500, overlap: int = 60) -> Column:
    """Paragraphs packed into chunks of at most ``size``; longer ones cut with an overlap."""
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")
    step = max(1, size - overlap)

    def cut(p: Column) -> Column:
        starts = F.sequence(F.lit(0), F.char_length(p) - 1, F.lit(step))
        pieces = F.transform(starts, lambda i: strip(F.substring(p, i + 1, F.lit(size))))
        return F.filter(pieces, lambda v: v != "")

    def pack(acc: Column, p: Column) -> Column:
        done, held = acc["done"], acc["held"]
        fits = F.char_length(held) + F.char_length(p) + 2 <= size
        joined = F.when(held != "", F.concat(held, F.lit("\n\n"), p)).otherwise(p)
        closed = F.when(held != "", F.concat(done, F.array(held))).otherwise(done)
        short = F.char_length(p) <= size
        return F.struct(
            F.when(fits, done).when(short, closed).otherwise(F.concat(closed, cut(p))).alias("done"),
            F.when(fits, joined).when(short, p).otherwise("").alias("held"),
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))
    return F.aggregate(
        paragraphs, start, pack,
        lambda acc: F.when(acc["held"] != "", F.concat(acc["done"], F.array(acc["held"]))).otherwise(acc["done"]),
    )


# ---- replies ------------------------------------------------------------------------------------------------


def truncate(text: Column, limit: int = 30) -> Column:
    if limit <= 0:
        return text
    if limit == 1:
        return F.substring(text, 1, 1)
    short = F.concat(F.substring(text, 1, limit - 1), F.lit(ELLIPSIS))
    return F.when(F.char_length(text) <= limit, text).otherwise(short)


def cap_agent_text(text: Column, limit: int = 5000) -> Column:
    capped = F.concat(F.substring(text, 1, limit), F.lit("..."))
    return F.when(F.char_length(text) > limit, capped).otherwise(text)


def reply(result: Column, limit: int = 30) -> Column:
    """``struct<type,content>`` for a parsed answer: advice, else read text, else scene."""
    content = F.coalesce(
        *[F.nullif(strip(result[f]), F.lit("")) for f in ("advice", "ocr_text", "scene")], F.lit("")
    )
    kind = F.coalesce(lookup(RISK_TO_REPLY, result["risk_level"]), F.lit("text"))
    kind = F.when(content == "", "noop").when(kind == "noop", "text").otherwise(kind)
    return F.struct(kind.alias("type"), truncate(content, limit).alias("content"))


def reject_reply(reason: Column, limit: int = 30) -> Column:
    message = F.coalesce(lookup(REJECT_MESSAGES, F.coalesce(reason, F.lit(""))), F.lit(REJECT_DEFAULT))
    return F.struct(F.lit("text").alias("type"), truncate(message, limit).alias("content"))


def final_reply(rejected_by, reason, error, trigger, shaped: Column, limit: int = 30) -> Column:
    """Reply of a frame: silent gate rejects (but not for reading), messages, or the answer."""
    silent = F.struct(F.lit("noop").alias("type"), F.lit("").alias("content"))
    failed = F.struct(F.lit("text").alias("type"), truncate(F.lit(ERROR_MESSAGE), limit).alias("content"))
    return (
        F.when((rejected_by == "gate") & (trigger != "read"), silent)
        .when(rejected_by.isNotNull(), reject_reply(reason, limit))
        .when(error.isNotNull(), failed)
        .otherwise(shaped)
    )


def read_replies(df, text: str, limit: int = 30):
    """One row per piece of a reading: index, total and end; empty readings say so."""
    pieces = segments(F.col(text), limit)
    shown = F.when(F.size("_pieces") > 0, F.col("_pieces")).otherwise(F.array(F.lit(EMPTY_READ_MESSAGE)))
    kind = F.when(F.size("_pieces") > 0, "read").otherwise("text")
    return (
        df.withColumn("_pieces", pieces)
        .withColumns({"type": kind, "total": F.greatest(F.size("_pieces"), F.lit(1))})
        .select("*", F.posexplode(shown).alias("_i", "content"))
        .withColumn("index", F.col("_i") + 1)
        .withColumn("end", F.col("index") == F.col("total"))
        .drop("_pieces", "_i")
    )


def outcome(rejected_by: Column, error: Column) -> Column:
    return (
        F.when(rejected_by == "gate", "noop").when(error.isNotNull(), "error")
        .when(rejected_by.isNotNull(), "fallback").otherwise("replied")
    )
