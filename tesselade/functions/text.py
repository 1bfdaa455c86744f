"""Text functions as Column builders; all stay in the JVM.

Every builder takes a string Column and treats null like an empty string
unless it says otherwise. ``let`` binds an intermediate value once, which keeps
the expression linear in its steps instead of doubling with each reuse.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselade.dims import BAD_ENDINGS, BAD_OPENINGS, CRITERIA, DEFAULT_EVIDENCE, FAKE, REAL, UNCERTAIN

BLANKS = r"[\t-\r\x1c-\x20\x85\p{Z}]+"
# Layout of the source texts.
_SECTION = r"(?s)\n[\t-\r\x1c-\x20\x85\p{Z}]*[0-9]+\.[\t-\r\x1c-\x20\x85\p{Z}]+\*\*(.*?)\*\*:[\t-\r\x1c-\x20\x85\p{Z}]*(.+?)(?=\n[\t-\r\x1c-\x20\x85\p{Z}]*[0-9]+\.[\t-\r\x1c-\x20\x85\p{Z}]+\*\*|\z)"
_DESCRIPTION = r"(?s)Image Description:[\t-\r\x1c-\x20\x85\p{Z}]*(.+?)(?=\n[\t-\r\x1c-\x20\x85\p{Z}]*Based on the provided|\z)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def clean_text(value: Column) -> Column:
    """Runs of blanks become one space; none at the ends."""
    return F.trim(F.regexp_replace(text(value), BLANKS, " "))


def lookup_key(value: Column) -> Column:
    """Lower case with one space for everything but ASCII letters and digits."""
    return F.trim(F.regexp_replace(F.lower(clean_text(value)), "[^a-z0-9]+", " "))


def words(value: Column) -> Column:
    """Words of the cleaned text; an empty text has none."""
    return F.filter(F.split(clean_text(value), " "), lambda w: w != "")


def word_count(value: Column) -> Column:
    return F.size(words(value))


def sentences(value: Column) -> Column:
    """Parts of the cleaned text after each ``.``, ``!`` or ``?`` and a blank."""
    return F.filter(F.split(clean_text(value), "(?<=[.!?]) "), lambda s: s != "")


def first(items: Column, otherwise: Column | str = "") -> Column:
    return F.coalesce(F.try_element_at(items, F.lit(1)), F.lit(otherwise) if isinstance(otherwise, str) else otherwise)


def first_sentence(value: Column) -> Column:
    return first(sentences(value))


def strip_leading_label(value: Column) -> Column:
    """Without a leading ``**X**:`` and ``Words:`` label and without ``**``."""
    bare = F.regexp_replace(clean_text(value), r"^\*\*(.*?)\*\*: *", "")
    return clean_text(F.replace(F.regexp_replace(bare, r"^[A-Z][A-Za-z& /\-]+: *", ""), F.lit("**"), F.lit("")))


def truncate_words(value: Column, most: int) -> Column:
    """The first words; ``most`` of 0 or less keeps all."""
    return F.array_join(F.slice(words(value), 1, most), " ") if most > 0 else clean_text(value)


def clip_words_plain(value: Column, most: int) -> Column:
    """The first words without blanks and ``,;:.`` at the end."""
    return F.regexp_replace(F.array_join(F.slice(words(value), 1, most), " "), "[ ,;:.]+$", "")


def is_viable_fragment(value: Column, least: int = 6) -> Column:
    """Long enough, with no opening or last word that needs more around it."""
    openings = "^(?:" + "|".join(map(re.escape, BAD_OPENINGS)) + ")"
    return let(
        clean_text(value),
        lambda t: (word_count(t) >= least) & ~F.lower(t).rlike(openings) & ~F.lower(F.regexp_replace(F.element_at(F.split(t, " "), -1), "[.,;:!?]+$", "")).isin(*BAD_ENDINGS),
    )


def _first_fitting(value: Column, separators: str, most: int) -> Column:
    parts = F.transform(F.split(value, separators), clean_text)
    return first(F.filter(parts, lambda p: (p != "") & (word_count(p) <= most) & is_viable_fragment(p)), value)


FIRST_SENTENCE = "^.*?(?:[.!?](?= )|$)"  # of cleaned text


def _longer(value: Column, most: int) -> Column:
    """More words than ``most``, in cleaned text."""
    return value.rlike(f"^(?:[^ ]+ ){{{most}}}[^ ]")


def compact_steps(value: Column, most: int) -> list[Callable[[Column], Column]]:
    """The steps of ``compact_text`` after labels are gone, each on the last one's value."""
    return [
        lambda t: F.regexp_extract(t, FIRST_SENTENCE, 0),
        lambda t: F.when(_longer(t, most), _first_fitting(t, "[;:]", most)).otherwise(t),
        lambda t: F.when(_longer(t, most), _first_fitting(t, ",", most)).otherwise(t),
        lambda t: F.when(_longer(t, most), clip_words_plain(t, most)).otherwise(t),
        lambda t: F.regexp_replace(F.regexp_replace(t, "^[ \"']+|[ \"']+$", ""), r"\.\.+", "."),
        lambda t: F.when((t != "") & ~t.rlike("[.!?]$"), F.concat(t, F.lit("."))).otherwise(t),
    ]


def compact_text(value: Column, most: int, default: str | Column = "") -> Column:
    """One complete short sentence.

    The first sentence; if too long its first viable clause, else its first
    viable comma part, else its first words. Ends with a full stop.
    """
    fallback = F.lit(default) if isinstance(default, str) else default
    result = strip_leading_label(value)
    for step in compact_steps(value, most):
        result = let(result, step)
    return let(result, lambda t: F.when(t == "", fallback).otherwise(t))


def with_compact(df: DataFrame, out: str, value: Column, most: int, default: str | Column = "") -> DataFrame:
    """``compact_text`` as a chain of projections, which is compiled as one stage."""
    fallback = F.lit(default) if isinstance(default, str) else default
    steps = compact_steps(value, most)
    # Each alias is used by the next one, so the whole chain is analysed at once.
    chain = [strip_leading_label(value).alias("_t0"), *[step(F.col(f"_t{i}")).alias(f"_t{i + 1}") for i, step in enumerate(steps)]]
    last = F.col(f"_t{len(steps)}")
    kept = [c for c in df.columns if c != out]
    return df.select("*", *chain, F.when(last == "", fallback).otherwise(last).alias("_out")).select(*kept, F.col("_out").alias(out))


def with_evidence(df: DataFrame, out: str, value: Column, most: int = 28) -> DataFrame:
    """``evidence_sentence`` as a chain of projections; a null value stays null."""
    bare = F.when(value.isNotNull(), strip_leading_label(value))
    df = df.withColumn(out, bare)
    df = with_compact(df, "_e", F.replace(F.col(out), F.lit("..."), F.lit(".")), most, DEFAULT_EVIDENCE)
    none = (F.col(out) == "") | (F.lower(F.col(out)) == DEFAULT_EVIDENCE.lower())
    return df.withColumn(out, F.when(none, DEFAULT_EVIDENCE).when(F.col(out).isNotNull(), F.col("_e"))).drop("_e")


def clip_words(value: Column, most: int) -> Column:
    return compact_text(value, most, clean_text(value))


def evidence_sentence(value: Column, most: int = 28) -> Column:
    """A compact evidence sentence; never empty."""
    default = F.lit(DEFAULT_EVIDENCE)
    return let(
        strip_leading_label(value),
        lambda t: F.when((t == "") | (F.lower(t) == DEFAULT_EVIDENCE.lower()), default).otherwise(compact_text(F.replace(t, F.lit("..."), F.lit(".")), most, DEFAULT_EVIDENCE)),
    )


def step1_segment(value: Column) -> Column:
    """The first sentence without full stops at the end."""
    return let(F.replace(strip_leading_label(value), F.lit("..."), F.lit(".")), lambda t: F.regexp_replace(first(sentences(t), t), r"\.+$", ""))


def step1_text(value: Column, label: Column) -> Column:
    """``Key points: a; b; c`` of at most three segments."""
    given = clean_text(value)
    default = F.when(label == FAKE, "Key points: Holmes explanation indicates localized artifacts that support an AI-generated label.").otherwise(
        "Key points: Holmes explanation supports a Real label without clear AIGC artifacts."
    )
    whole = let(F.when(given == "", default).otherwise(given), lambda t: F.when(F.lower(t).startswith("key points:"), t).otherwise(F.concat(F.lit("Key points: "), t)))

    def render(t: Column) -> Column:
        body = F.substr(t, F.locate(":", t) + 1)
        parts = F.filter(F.split(body, "[;\n]+"), lambda p: clean_text(p) != "")
        kept = F.filter(F.slice(F.transform(parts, step1_segment), 1, 3), lambda s: s != "")
        return F.trim(F.concat(F.substring_index(t, ":", 1), F.lit(": "), F.array_join(kept, "; ")))

    return let(whole, render)


def tokens(value: Column) -> Column:
    """Words and single other characters, in lower case."""
    return F.regexp_extract_all(F.lower(clean_text(value)), F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_ ])"), F.lit(1))


def any_of(value: Column, markers: Iterable[str]) -> Column:
    """The text holds one of the markers as a substring."""
    return value.rlike("|".join(map(re.escape, markers)))


def alias_pattern(alias: str) -> str:
    """The alias between word boundaries; it begins with the literal, which is searched fast."""
    word, a = r"[\p{L}\p{N}_]", re.escape(alias)
    return f"{a}(?<!{word}{a})(?!{word})"


def holds_alias(value: Column, alias: str) -> Column:
    """The alias stands between word boundaries, in lower-case text."""
    return value.contains(alias) & value.rlike(alias_pattern(alias))


def sections(value: Column, anywhere: bool = False) -> Column:
    """array<struct<name, body>> of numbered ``n. **Name**: body`` items.

    A section needs a line break before it; ``anywhere`` takes one at the
    very start too. Bodies are cleaned, empty ones left out.
    """
    source = F.concat(F.lit("\n"), text(value)) if anywhere else text(value)
    found = F.arrays_zip(F.regexp_extract_all(source, F.lit(_SECTION), F.lit(1)).alias("name"), F.regexp_extract_all(source, F.lit(_SECTION), F.lit(2)).alias("body"))
    return F.filter(F.transform(found, lambda s: F.struct(s["name"].alias("name"), clean_text(s["body"]).alias("body"))), lambda s: s["body"] != "")


def description(value: Column) -> Column:
    return clean_text(F.regexp_extract(text(value), _DESCRIPTION, 1))


def image_member(value: Column) -> Column:
    """``\\`` as ``/``; a leading ``./``, then a leading ``dataset/`` dropped."""
    slashes = F.translate(F.regexp_replace(value, r"^[\t-\r\x1c-\x20\x85\p{Z}]+|[\t-\r\x1c-\x20\x85\p{Z}]+$", ""), "\\", "/")
    return F.regexp_replace(F.regexp_replace(slashes, r"^\./", ""), "^dataset/", "")


def label_from_member(value: Column) -> Column:
    """The label that a path component gives; null where none does."""
    parts = F.split(value, "/")
    return F.when(F.array_contains(parts, "0_real"), REAL).when(F.array_contains(parts, "1_fake"), FAKE)


def normal_label(value: Column) -> Column:
    return let(clean_text(value), lambda t: F.when(t.isin(REAL, FAKE), t).otherwise(UNCERTAIN))


def label_from_score(score: Column, threshold: Column) -> Column:
    """AI-Generated from the threshold on; null where either is null."""
    return F.when(score >= threshold, FAKE).when(score < threshold, REAL)


def resolve_path(path: Column, root: Column, base: str) -> Column:
    """Absolute as it is, else below its root, else below ``base``."""
    return F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", F.coalesce(root, F.lit(base)), path))


def canonical(value: Column, table: dict[str, str], key: Callable[[Column], Column], otherwise: Column | None = None) -> Column:
    """The criterion that a name stands for; ``otherwise`` for unknown ones."""
    names = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    known = F.try_element_at(names, key(value))
    exact = F.when(clean_text(value).isin(*CRITERIA), clean_text(value))
    return F.coalesce(exact, known, otherwise if otherwise is not None else F.lit(None).cast("string"))


def duration(seconds: Column) -> Column:
    """``HH:MM:SS``, or ``MM:SS`` below an hour; null and negative as ``--:--``."""
    whole = F.bround(seconds).cast("bigint")
    clock = F.format_string("%02d:%02d", F.floor(F.pmod(whole, F.lit(3600)) / 60), F.pmod(whole, F.lit(60)))
    return F.when(seconds.isNull() | (seconds < 0), "--:--").when(whole >= 3600, F.concat(F.format_string("%02d:", F.floor(whole / 3600)), clock)).otherwise(clock)
