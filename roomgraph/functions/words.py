"""Dictionary look-ups and text pieces as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from roomgraph.fixed_values import (
    CLASS_FAMILY,
    DIRECTION_ZH,
    HUE_RANGES,
    LABEL_ZH,
    NAME_FAMILY,
    PREDICATE_ZH,
    QUESTION_PHRASES,
    SYNONYMS,
    BLACK,
    COLOURFUL,
    DARK_GREY,
    LIGHT_GREY,
    WHITE,
)


def lookup(table: dict, key: Column) -> Column:
    """Value of a small fixed dictionary, null where the key is unknown."""
    literals = F.create_map(*[F.lit(v) for v in chain.from_iterable(table.items())])
    return F.try_element_at(literals, key)


# every character that counts as white space at the ends of a text
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def clean(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit("")))


def name_family(name: Column) -> Column:
    n = clean(name)
    return F.coalesce(lookup(NAME_FAMILY, n), F.lower(n))


def same_color(a: Column, b: Column) -> Column:
    """A missing colour contradicts nothing."""
    ca, cb = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return (ca == "") | (cb == "") | (strip(ca) == strip(cb))



def class_family(cls: Column) -> Column:
    return F.coalesce(lookup(CLASS_FAMILY, cls), cls)


def zh_label(label: Column) -> Column:
    return F.coalesce(lookup(LABEL_ZH, label), label)


def zh_direction(tag: Column) -> Column:
    return F.coalesce(lookup(DIRECTION_ZH, tag), tag)


def relation_phrase(predicate: Column, label: Column) -> Column:
    return F.replace(lookup(PREDICATE_ZH, predicate), F.lit("{}"), zh_label(label))


def frame_number(name: Column) -> Column:
    """Whole number after the last underscore of the file stem; 0 when there is none."""
    digits = F.regexp_extract(F.coalesce(name, F.lit("")), r"_(\d+)(?:\.[^.]*)?$", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).cast("int"), F.lit(0))


def frame_name(number: Column) -> Column:
    return F.format_string("frame_%06d.jpg", number.cast("int"))


def one_decimal(value: Column) -> Column:
    """Ties go to the even digit."""
    return F.format_string("%.1f", F.bround(value, 1))


def percent(value: Column) -> Column:
    return F.format_string("%.0f%%", F.bround(value * 100, 0))


def colour_name(h: Column, s: Column, v: Column) -> Column:
    """Colour word from median hue, saturation and value on a 0..255 scale."""
    hue, sat, val = h * 360.0 / 255.0, s / 255.0, v / 255.0
    word = (
        F.when(val < 0.12, BLACK)
        .when((sat < 0.15) & (val > 0.82), WHITE)
        .when((sat < 0.15) & (val > 0.55), LIGHT_GREY)
        .when(sat < 0.15, DARK_GREY)
    )
    for low, high, name in HUE_RANGES:
        word = word.when((hue >= low) & (hue < high), name)
    return word.otherwise(COLOURFUL)


def size_text(dims: Column) -> Column:
    return F.concat(
        F.lit("约 "), dims[0].cast("string"), F.lit("×"), dims[1].cast("string"), F.lit("×"),
        dims[2].cast("string"), F.lit(" 厘米"),
    )


def view_text(label: Column, color: Column, dims: Column, direction: Column, distance: Column):
    """One sentence for a view: colour and label, size, place relative to the viewer."""
    head = F.when(
        F.coalesce(color, F.lit("")) != "", F.concat(color, F.lit("的"), label)
    ).otherwise(label)
    place = F.when(
        direction.isNotNull() & distance.isNotNull(),
        F.concat(F.lit("在你"), direction, F.lit("约 "), one_decimal(distance), F.lit(" 米")),
    )
    return F.concat_ws("，", head, F.when(dims.isNotNull(), size_text(dims)), place)


# ---- questions --------------------------------------------------------------------------------


def clean_question(text: Column) -> Column:
    out = text
    for phrase in QUESTION_PHRASES:
        out = F.replace(out, F.lit(phrase), F.lit(""))
    return strip(out)


def is_color_question(text: Column) -> Column:
    q = strip(text)
    return (F.char_length(q) <= 3) & q.endswith("色")


def expand_question(text: Column) -> Column:
    """The lower-cased text and the synonyms of the dictionary words in it.

    A word inside a longer word that also occurs is left out.
    """
    longest_first = sorted(SYNONYMS.items(), key=lambda item: -len(item[0]))
    table = F.array(
        *[
            F.struct(
                F.lit(word).alias("word"), F.array(*[F.lit(s) for s in names]).alias("names")
            )
            for word, names in longest_first
        ]
    )
    present = F.filter(table, lambda e: F.contains(text, e.word))
    widest = F.filter(
        present,
        lambda e: ~F.exists(
            present, lambda o: (o.word != e.word) & F.contains(o.word, e.word)
        ),
    )
    names = F.flatten(F.transform(widest, lambda e: e.names))
    return F.filter(F.concat(F.array(F.lower(strip(text))), names), lambda k: k != "")


# ---- substring search by shared grams ------------------------------------------------------------


def grams(text: Column) -> Column:
    """Every single character, every neighbouring pair and the empty text, once each."""
    n = F.char_length(text)
    spots = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    ones = F.transform(spots, lambda i: F.substring(text, i, F.lit(1)))
    twos = F.transform(spots, lambda i: F.substring(text, i, F.lit(2)))
    return F.array_distinct(F.concat(F.array(F.lit("")), ones, twos))


def first_gram(text: Column) -> Column:
    """A text can only be inside another one that has this gram."""
    return F.substring(text, 1, 2)
