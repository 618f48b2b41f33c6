"""Names, labels and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words in file names that tell an instrument's role, in order of precedence, and the roles' priorities.
ROLE_WORDS = {
    "bass": ("bass", "sub"),
    "lead": ("lead", "melody", "synth"),
    "chords": ("chord", "pad", "piano"),
    "kick": ("kick",),
    "drums": ("drum", "perc", "loop"),
    "vocal": ("vocal", "vox"),
}
ROLE_PRIORITY = {"vocal": 10, "kick": 9, "bass": 8, "lead": 7, "drums": 6, "chords": 5, "other": 4}
DRUM_WORDS = ("kick", "snare", "hat", "tom", "perc")
# What processing steps append to file names, in the order in which it is taken off.
STEP_SUFFIXES = ("_denoised", "_click_removed", "_adjusted", "_meta_updated", "_perfected")
NOTES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def sanitize(name: Column) -> Column:
    """Letters, digits, space, _ and - stay, all else becomes _; null and empty are 'unknown'."""
    return F.when(F.coalesce(name, F.lit("")) == "", "unknown").otherwise(F.trim(F.regexp_replace(name, r"[^\p{L}\p{N} _-]", "_")))


def sanitize_filename(name: Column) -> Column:
    """Spaces become _, what is no word character, dot or - goes; null and empty are 'unknown'."""
    kept = F.regexp_replace(F.replace(name, F.lit(" "), F.lit("_")), r"(?U)[^\w.-]", "")
    return F.when(F.coalesce(name, F.lit("")) == "", "unknown").otherwise(kept)


def preset_filename(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit(" "), F.lit("_")))


#: Where a new word begins in a camel-case name.
WORD_STARTS = "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Za-z0-9])(?=[A-Z][a-z])"


def camel_to_snake(name: Column) -> Column:
    """Words apart by one underscore, in lower case; runs of underscores become one."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, WORD_STARTS, "_"), "_+", "_"))


def infer_role(filename: Column) -> Column:
    low, out = F.lower(filename), None
    for role, words in ROLE_WORDS.items():
        test = F.lit(False)
        for w in words:
            test = test | low.contains(w)
        out = F.when(test, role) if out is None else out.when(test, role)
    return out.otherwise("other")


def role_priority(role: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ROLE_PRIORITY.items() for x in kv])
    return F.coalesce(F.try_element_at(table, role), F.lit(ROLE_PRIORITY["other"]))


def drum_category(filename: Column) -> Column:
    low = F.lower(filename)
    out = F.when(low.contains(DRUM_WORDS[0]), DRUM_WORDS[0])
    for w in DRUM_WORDS[1:]:
        out = out.when(low.contains(w), "hihat" if w == "hat" else w)
    return out


def bit_depth(subtype: Column) -> Column:
    """First number in a sample format's name; float formats are 32 bits; else null."""
    digits = F.regexp_extract(subtype, r"\d+", 0)
    return F.when(digits != "", digits.cast("int")).when(F.upper(subtype).contains("FLOAT"), 32)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(base_name(path), r"(?<=[^.])\.[^.]*$", "")


def strip_suffixes(name: Column) -> Column:
    for s in STEP_SUFFIXES:
        name = F.regexp_replace(name, f"{s}$", "")
    return name


def processed_name(path: Column, suffix: str) -> Column:
    """The name of a processing step's output: the stem without earlier steps' suffixes, and this one's."""
    return F.concat(strip_suffixes(stem(path)), F.lit(suffix))


def session_name(label: Column, now: Column, prefix: str = "Generation") -> Column:
    """A capture session's name, told apart by the second."""
    return F.concat_ws(" ", F.lit(prefix), label, F.date_format(now, "yyyyMMdd_HHmmss"))


def slice_name(base: Column, index: Column) -> Column:
    """index counts from 0 over all slice points, also those not kept."""
    return F.format_string("%s_slice_%03d", base, (index + 1).cast("int"))


def title(value: Column) -> Column:
    return F.initcap(F.replace(value, F.lit("_"), F.lit(" ")))


def size_label(size: Column) -> Column:
    """Bytes as MB with two digits at most; null as N/A."""
    return F.coalesce(F.concat(F.round(size / F.lit(1048576.0), 2).cast("string"), F.lit(" MB")), F.lit("N/A"))


def note_name(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, NOTES)), (F.pmod(number, F.lit(12)) + 1).cast("int"))


def clip_text(text: Column, most: int = 100) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)
